"""The operators against brute force on small dirty inputs, and on what could break them."""

import random
from collections import defaultdict
from datetime import UTC, date, datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylake.contracts import EVENT_COLUMNS
from quarrylake.operators import anomalies, asof, delivery, history, intervals, malformed, rolling, shards
from quarrylake.operators.trusted import contradicting_ids, trusted_events

EVENTS = "record_id bigint, " + ", ".join(f"{c} string" for c in EVENT_COLUMNS) + ", _ingested_at timestamp, _source_file string, extra string"


def event(i, **over):
    base = dict.fromkeys(EVENT_COLUMNS, None) | {"event_id": f"E{i:09d}", "machine_id": "M1", "event_ts": "2026-01-01T00:00:00Z", "site_id": "S1"}
    return (i, *(base | {k: v for k, v in over.items() if k in base}).values(), over.get("at", datetime(2026, 1, 2, tzinfo=UTC)), "f", "x")


def test_trusted_events(spark):
    rows = [
        event(1, status="RUNNING", hour_meter="10.0"), event(2, event_id=" E000000001 ", status=" running ", hour_meter="1e1"),  # agree
        event(3, event_id="E3", hour_meter="1"), event(4, event_id="E3", hour_meter=None),  # missing equals missing only
        event(5, event_id="E5", event_ts="2026-01-01T01:00:00+01:00"), event(6, event_id="E5"),  # one instant
        event(7, event_id="E7", hour_meter="x"), event(8, event_id="E7", hour_meter="y"),  # unreadable text differs
        event(9, event_id="E9", event_ts="soon"), event(10, event_id=None), event(11, event_id=" "), event(12, event_id="E12", machine_id=" "),
        event(13, event_id="E13", downtime_minutes="bad", duration_minutes=" 7 "),
    ]
    df = spark.createDataFrame(rows, EVENTS)
    got = {r.event_id: r for r in trusted_events(df, "site_id", "duration_minutes", "downtime_minutes", "hour_meter").collect()}
    assert set(got) == {"E000000001", "E5", "E13"}
    assert got["E000000001"].hour_meter == 10 and got["E13"].duration_minutes == 7 and got["E13"].downtime_minutes == 0
    assert {r.event_id for r in contradicting_ids(df).collect()} == {"E3", "E7"}
    assert trusted_events(df.limit(0), "site_id").collect() == []


def test_a_copy_without_machine_contradicts(spark):
    df = spark.createDataFrame([event(1, event_id="E1"), event(2, event_id="E1", machine_id=None), event(3, event_id="E3"), event(4, event_id="E3")], EVENTS)
    assert {r.event_id for r in trusted_events(df).collect()} == {"E3"} and {r.event_id for r in contradicting_ids(df).collect()} == {"E1"}


def union_of(spans):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("seed, cut, named", [(0, False, 10_000), (1, True, 10_000), (2, True, 10_000), (3, True, 0)])
def test_periods_against_brute_force(spark, monkeypatch, seed, cut, named):
    r = random.Random(seed)
    far = 10**17 if seed == 2 else 400
    rows = [(r.choice(["a", "b", None, "hot", "hot", "hot"]), r.choice([None, r.randint(-500, 5000)]), r.choice([None, 0, -3, 1, 1, 1, 5, 5, 60, r.choice([60, 60, 400, far])])) for _ in range(400)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "k string, s bigint, n bigint").withColumns({c: F.lit("clash") for c in ("_n", "_cuts", "_b", "_piece", "_island", "end_s")})
    for name, value in (("HOT", 60), ("QUANTILES", 16), ("NAMED", named)):
        monkeypatch.setattr(shards, name, value)
    monkeypatch.setattr(intervals, "PIECE", 5)
    got = defaultdict(list)
    for x in intervals.continuous_periods(df, ["k"], "s", "n", shards.cuts_of(df, "k", "s") if cut else None).collect():
        got[x.k].append((x.start_s, x.end_s, x.next_start_s))
    want = defaultdict(list)
    for k, s, n in rows:
        if s is not None and n and n > 0:
            want[k].append((s, s + n))
    assert got.keys() == want.keys()
    for k in want:
        u = union_of(want[k])
        assert sorted(got[k]) == [(*p, u[i + 1][0] if i + 1 < len(u) else None) for i, p in enumerate(u)]


def test_one_machine_with_most_rows_in_a_week(spark, monkeypatch):
    """Cut by density: no piece holds many more rows than asked for, and periods, gaps and knowledge are those of the whole."""
    r = random.Random(11)
    week, n = 7 * 86_400, 4000
    at = [int(r.betavariate(0.3, 3) * week) for _ in range(n)]
    rows = [("hot" if i % 10 else f"m{i % 70}", t, float(r.choice([0, 0.1, 0.5, 2])), float(r.choice([0, 0.2, 30 * (i % 997 == 0)]))) for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, "machine_id string, epoch_s bigint, duration_minutes double, downtime_minutes double")
    whole = sorted(map(tuple, intervals.periods_and_gaps(df).collect()))
    facts = spark.createDataFrame([(date(1970, 1, d), "hot", f"S{d}", datetime(1970, 1, d, h, tzinfo=UTC)) for d in range(1, 8) for h in (0, 9)], "event_date date, machine_id string, site_id string, _ingested_at timestamp")
    known = sorted(map(tuple, asof.as_known(df, facts, "site_id").collect()), key=str)
    for module, name, value in ((shards, "HOT", 500), (shards, "QUANTILES", 32), (intervals, "PIECE", 60), (asof, "PIECE", 60)):
        monkeypatch.setattr(module, name, value)
    cuts = shards.cuts_of(df, "machine_id", "epoch_s")
    sizes = {x._piece: x["count"] for x in shards.with_piece(df, cuts, "epoch_s", 60).groupBy("_piece").count().collect()}
    assert len(sizes) > 40 and max(v for k, v in sizes.items() if k >= 0) <= 150
    assert set(sizes) - {-1} <= {x._piece for x in shards.pieces(cuts, 60).collect()}
    assert sorted(map(tuple, intervals.periods_and_gaps(df).collect())) == whole
    assert sorted(map(tuple, asof.as_known(df, facts, "site_id").collect()), key=str) == known


def test_gaps_and_empty(spark):
    df = spark.createDataFrame([("M", 0, 1.0, 2.0), ("M", 60, 1.0, 0.0), ("M", 300, 1.0, -1.0), ("M", 300 + 8 * 86400, 1.0, 0.5), ("N", 0, 6e7, 1e300)], "machine_id string, epoch_s bigint, duration_minutes double, downtime_minutes double")
    got = {tuple(r) for r in intervals.periods_and_gaps(df).where("kind <> 'report'").collect()}
    assert got == {("down", "M", 0, 120), ("down", "M", 300 + 8 * 86400, 330 + 8 * 86400), ("gap", "M", 120, 300), ("down", "N", 0, 9 * 10**18)}
    assert {tuple(r) for r in intervals.periods_and_gaps(df).where("kind = 'report' and machine_id = 'N'").collect()} == {("report", "N", 0, 36 * 10**8)}
    assert intervals.periods_and_gaps(df.limit(0)).collect() == []


def test_judge_finds_planted_readings():
    r = np.random.default_rng(1)
    kind = anomalies.READINGS["temperature_c"]
    x = 60 + r.normal(0, 1.5, 2000)
    x[1000:] += 25  # a lasting change is none
    for i, (a, z, v) in enumerate([(50, 51, 110), (90, 92, 10), (200, 203, 130)]):
        x[a:z] = v
    x[300] = -300
    x[400:407] = 61.5
    x[500:505] = 61.7
    group = np.zeros(2000, np.int64)
    state, p = anomalies.judge(x, group, kind)
    want = np.zeros(2000, int)
    want[[50, 90, 91, 200, 201, 202]], want[300], want[400:407] = 1, 3, 2
    assert (state == want).all() and ((p >= 0) & (p <= 1)).all()
    assert (anomalies.judge(np.full(5, np.nan), np.zeros(5, np.int64), kind)[0] == 0).all()
    assert (anomalies.judge(np.array([60.0, 160.0]), np.array([0, 1]), kind)[0] == 0).all()


def test_refuelling_is_no_case_but_a_spike_is():
    kind = anomalies.READINGS["fuel_level_pct"]
    x = np.concatenate([90 - 4.7 * np.arange(15) + np.random.default_rng(i).normal(0, 1, 15) for i in range(40)])
    x[100], x[333] = 5.0, 99.0
    x[450:452] = x[449] + 30
    state, _ = anomalies.judge(x, np.zeros(len(x), np.int64), kind)
    assert set(np.flatnonzero(state == 1)) == {100, 333, 450, 451}


def changing_machine(n=6000, seed=3):
    """A series whose scatter changes halfway, with spikes and stuck runs."""
    r = np.random.default_rng(seed)
    x = np.round(60 + r.normal(0, np.where(np.arange(n) < n // 2, 0.5, 4.0)), 2)
    x[r.choice(n, 90, replace=False)] += 30
    for a in r.choice(n - 50, 8, replace=False):
        x[a : a + 7] = 61.25
    return x


def test_blocks_cuts_and_partitions_change_nothing(spark, monkeypatch):
    x = np.concatenate([changing_machine(), *[changing_machine(100, 10 + i) for i in range(10)]])
    n = len(x)
    machine = np.array(["hot"] * 6000 + [f"m{i // 100}" for i in range(n - 6000)])
    table = pa.table({"event_id": [f"{i:06d}" for i in range(n)], "machine_id": machine, "epoch_s": np.arange(n) * 7, "temperature_c": x})
    df = spark.createDataFrame(table.to_pandas())
    # the whole series at once, by what is usual for its machine
    group = np.unique(machine, return_inverse=True)[1]
    state, _ = anomalies.judge(x, group, anomalies.READINGS["temperature_c"])
    want = {(f"{i:06d}", str(anomalies.NAMES[state[i]])) for i in np.flatnonzero(state)}
    assert len(want) > 100 and {s for _, s in want} == {"spike", "stuck"}
    found = lambda d: {(r.event_id, r.state) for r in anomalies.implausible_readings(d, ("temperature_c",)).collect()}
    assert found(df) == want
    monkeypatch.setattr(shards, "HOT", 1000)
    for quantiles, piece, rows, named in ((16, 6_250, 100_000, 10_000), (8, 100, 100_000, 10_000), (16, 6_250, 500, 10_000), (32, 6_250, 100_000, 0)):
        for module, name, value in ((shards, "QUANTILES", quantiles), (anomalies, "PIECE", piece), (anomalies, "ROWS", rows), (shards, "NAMED", named)):
            monkeypatch.setattr(module, name, value)
        assert found(df.repartition(3)) == want
        monkeypatch.setattr(anomalies, "SHARD", 4)
    assert anomalies.implausible_readings(df.limit(0), ("temperature_c",)).collect() == []
    nulls = df.withColumn("temperature_c", F.lit(None).cast("double"))
    assert anomalies.implausible_readings(nulls, ("temperature_c",)).collect() == []


@pytest.mark.parametrize("field", list(anomalies.READINGS))
def test_runs_of_one_to_six_spikes(field):
    kind = anomalies.READINGS[field]
    drift = {"fuel_level_pct": -0.01, "hour_meter": 3.0}.get(field, 0.0)
    r = np.random.default_rng(2)
    n, least = 1200, kind.least
    x = 90 + drift * np.arange(n) + r.normal(0, least, n)
    want = set()
    for k in range(1, 7):
        at = 150 * k + np.arange(k)
        x[at] -= 60 * least + 15 + r.normal(0, least, k)
        want |= set(at.tolist())
    state, _ = anomalies.judge(x, np.zeros(n, np.int64), kind)
    assert set(np.flatnonzero(state == 1).tolist()) == want


def test_recall_and_precision_on_planted_readings():
    """Machines of 170 readings with all kinds of cases and what is none: level changes, refuelling, moderate rises."""
    r = np.random.default_rng(7)
    kinds = {"temperature_c": (60, 1.5), "vibration_mm_s": (2.2, 0.2), "fuel_level_pct": (0, 1.0), "hour_meter": (500, 0.5)}
    found = true = both = 0
    for field, (level, scatter) in kinds.items():
        xs, cases = [], []
        for m in range(120):
            x, case = level + r.normal(0, scatter, 170), np.zeros(170, bool)
            if field == "fuel_level_pct":
                left = 90.0
                for i in range(170):
                    left = left - r.uniform(2, 6) if left > 20 else r.uniform(80, 95)
                    x[i] = min(100.0, max(0.5, left + r.normal(0, 0.7)))
            elif field == "hour_meter":
                x += np.cumsum(r.uniform(2, 8, 170))
            else:
                x[r.integers(40, 130) :] += 6 * scatter  # a lasting change
                a = r.integers(5, 160)
                x[a : a + 4] += 2.5 * scatter  # a moderate rise
            for a in r.choice(np.arange(8, 160, 12), 3, replace=False):
                k = r.integers(1, 4)
                if field == "fuel_level_pct":
                    x[a : a + k] = r.uniform(1, 5, k) if x[a - 1] > 50 else r.uniform(230, 255, k)
                else:
                    x[a : a + k] = np.abs(x[a : a + k] + r.choice([-1, 1] if level > 10 else [1, 1]) * (40 * scatter + (x[a] if field == "hour_meter" else 0)))
                case[a : a + k] = True
            a = int(r.integers(0, 160))
            if not case[max(0, a - 1) : a + 9].any():
                x[a : a + 7], case[a : a + 7] = np.round(x[a], 2), True
            xs.append(x)
            cases.append(case)
        state, _ = anomalies.judge(np.concatenate(xs), np.repeat(np.arange(120), 170), anomalies.READINGS[field])
        hit, case = state > 0, np.concatenate(cases)
        found, true, both = found + hit.sum(), true + case.sum(), both + (hit & case).sum()
    assert both / true >= 0.99 and both / found >= 0.99


def test_ranges():
    s, seen = delivery.Ranges(), set()
    r = random.Random(5)
    for _ in range(300):
        a = r.randint(0, 400)
        z = a + r.randint(0, 6)
        s.add(np.array([a]), np.array([z]))
        seen |= set(range(a, z + 1))
        assert (s.lo[1:] > s.hi[:-1] + 1).all()
    x = np.arange(-3, 420)
    assert (s.cover(x) == np.array([v in seen for v in x])).all()


def test_deliveries_against_brute_force(spark):
    r = random.Random(2)
    ids = [f"E{r.randint(1, 300):06d}" for _ in range(500)] + ["E000007"] * 700 + ["E7", "odd id", "odd id", "x-1", "E" + "9" * 30, "E" + "9" * 30, None, " "] + [f"P-{r.randint(1, 9) * 70_000}" for _ in range(40)] + [" E000007 "]
    rows = [(i, n, datetime(2026, 1, 1, r.randint(0, 5), tzinfo=UTC) if r.random() < 0.9 else None) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "event_id string, record_id bigint, _ingested_at timestamp").repartition(5)
    judged = delivery.judge_deliveries(df, "event_id", ["_ingested_at", "record_id"])
    got = {x.record_id for x in judged.where("not again").collect()}
    best = {}
    for i, n, t in rows:
        if i and i.strip():
            k = (t is not None, t or 0, n)
            best[i.strip()] = max(best.get(i.strip(), k), k, key=lambda v: (v[0], v[1] if v[0] else 0, v[2]))
    assert got == {k[2] for k in best.values()}
    assert judged.count() == sum(1 for i, *_ in rows if i and i.strip())
    ranges = delivery.seen_ranges(judged.where("not again"), "event_id")
    numbers = {int(k[1:]) for k in best if len(k) == 7 and k[0] == "E"}
    covered = {v for x in ranges.where("producer = 'E#6'").collect() for v in range(x.first, x.last + 1)}
    assert covered == numbers
    again = delivery.judge_deliveries(df.where("event_id like 'E00%' or event_id like 'P-%'"), "event_id", ["_ingested_at", "record_id"], ranges)
    assert again.where("not again").count() == 0
    assert delivery.judge_deliveries(df.limit(0), "event_id", ["record_id"]).collect() == []


def test_deliveries_in_two_batches(spark):
    """Numbered and malformed identifiers: what the first batch accepted is again in the second, whatever its form."""
    batches = [
        ["E000001", "E000002", "odd id", "odd id", "E" + "9" * 30, "=", None],
        [" odd id ", "E000001", "E000003", "new id", "E" + "9" * 30, "E" + "8" * 30, "=", "==", None, "new id"],
        ["new id", "odd id", "E000003", "E000004", "=="],
    ]
    kept, seen, keys = [], None, None
    for b, ids in enumerate(batches):
        df = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "event_id string, record_id bigint").repartition(3)
        judged = delivery.judge_deliveries(df, "event_id", ["record_id"], seen, keys)
        assert judged.count() == sum(i is not None for i in ids)
        fresh = judged.where("not again")
        kept.append(sorted(r.event_id for r in fresh.collect()))
        seen, keys = delivery.seen_ranges(fresh, "event_id", seen), delivery.seen_keys(fresh, "event_id", keys)
    assert kept == [sorted({i for i in batches[0] if i}), ["==", "E000003", "E" + "8" * 30, "new id"], ["E000004"]]
    assert {r.key for r in keys.collect()} == {"odd id", "new id", "=", "==", "E" + "9" * 30, "E" + "8" * 30}
    assert [tuple(r) for r in seen.collect()] == [("E#6", 1, 4)]


EVIDENCE = "event_date date, machine_id string, client_id string, site_id string, model string, assignment_evidence_source string, _ingested_at timestamp"


def evidence(r, n):
    rows = []
    for _ in range(n):
        d = date(2026, 1, 1) + timedelta(r.randint(0, 30))
        at = datetime(2026, 1, 1, tzinfo=UTC) + timedelta((d - date(2026, 1, 1)).days + r.choice([0, 0, 0, 5]), r.randint(0, 86399))
        m = f"M{r.randint(1, 12)}"
        rows.append((d, r.choice([m, f" {m} "]), f"C{hash((m, d.day // 7)) % 2}", r.choice([f"S{hash((m, d.day // 9)) % 3}"] * 30 + ["S9"]), r.choice(["X"] * 20 + [None, " "]), "src", at))
    return rows


def brute_chains(rows):
    by = defaultdict(lambda: defaultdict(set))
    for d, m, c, s, x, *_ in rows:
        if all(v and str(v).strip() for v in (d, m, c, s, x)):
            by[m.strip()][d].add((c.strip(), s.strip(), x.strip()))
    out = set()
    for m, days in by.items():
        if all(len(v) == 1 for v in days.values()):
            last = None
            for d in sorted(days):
                (v,) = days[d]
                if v != last:
                    out.add((m, d, *v))
                last = v
    return out, {m for m, days in by.items() if any(len(v) > 1 for v in days.values())}


def test_history_against_brute_force(spark, tmp_path):
    rows = evidence(random.Random(4), 150)
    df = spark.createDataFrame(rows, EVIDENCE)
    want, disputed = brute_chains(rows)
    pick = lambda h: {(x.machine_id, x.effective_from, x.client_id, x.site_id, x.model) for x in h.collect()}
    chains = history.assignment_history(df)
    assert pick(chains) == want
    usable = history.usable_evidence(df)
    assert {x.machine_id for x in history.disputed_machines(usable).collect()} == disputed
    for x in chains.collect():
        assert x.is_current == (x.effective_to is None) and (x.is_current or x.effective_to >= x.effective_from)
    store = history.ChainStore(spark, str(tmp_path), buckets=4)
    assert store.read() is None
    early = usable.where("event_date < '2026-01-15'")
    store.replace(early, early)
    late = usable.where("event_date >= '2026-01-15'")
    store.replace(usable, late)
    touched = {x.machine_id for x in late.select("machine_id").distinct().collect()}
    have = pick(store.read())
    assert {x for x in have if x[0] in touched} == {x for x in want if x[0] in touched}
    other = history.ChainStore(spark, str(tmp_path), buckets=64)
    assert other.buckets == 4 and pick(other.read()) == have
    number, state = other._state()
    store.replace(usable, late.where("machine_id = 'M1'"))
    with pytest.raises(RuntimeError):  # came second
        other._show(number + 1, state)
    assert pick(other.read()) == have
    before = len(list(tmp_path.iterdir()))
    store.sweep()
    assert pick(store.read()) == have and len(list(tmp_path.iterdir())) < before
    assert history.assignment_history(df.limit(0)).collect() == []
    kept = history.ChainStore(spark, str(tmp_path / "whole"), history.buckets_for(df.count()))
    assert pick(history.maintained_history(df, kept)) == want and pick(kept.read()) == want
    assert history.maintained_history(df.limit(0), history.ChainStore(spark, str(tmp_path / "none"))).collect() == []
    assert [history.buckets_for(n) for n in (0, 10**7, 10**12)] == [16, 40, 65_536]


def test_sources_findings_and_rejected_evidence(spark):
    d = date(2026, 1, 1)
    rows = "event_date date, machine_id string, client_id string, site_id string, model string, _ingested_at timestamp"
    at = datetime(2026, 1, 1, tzinfo=UTC)
    a = spark.createDataFrame([(d, "M1", "C", "S1", "X", at), (d, " M2", "C", "S1", "X", at), (None, "M3", "C", "S", "X", at), (d, "M4", " ", "S", "X", at)], rows)
    b = spark.createDataFrame([(d, "M1", "C", "S2", "X", at), (d, "M2", "C", "S1", "X", at), (d, "M1", "C", "S2", "X", at)], rows)
    evidence = history.named_sources({"a": a, "b": b})
    assert {(r.finding, r.observed_count) for r in history.evidence_findings(evidence).collect()} == {("missing_assignment_identity", 2), ("same_day_assignment_conflict", 1)}
    rejected = sorted((r.machine_id, r.site_id, r.assignment_evidence_source) for r in history.rejected_evidence(evidence).collect())
    assert rejected == [("M1", "S1", "a"), ("M1", "S2", "b"), ("M3", "S", "a"), ("M4", "S", "a")]
    assert history.evidence_findings(evidence.limit(0)).collect() == [] and history.rejected_evidence(evidence.limit(0)).collect() == []
    for bad in ({}, {" ": a}, {"x" * 65: a}, {str(i): a for i in range(21)}):
        with pytest.raises(ValueError):
            history.named_sources(bad)


@pytest.mark.parametrize("named", [0, 10_000])
def test_as_known_against_brute_force(spark, monkeypatch, named):
    r = random.Random(6)
    rows = evidence(r, 150)
    _, disputed = brute_chains(rows)
    usable = history.usable_evidence(spark.createDataFrame(rows, EVIDENCE))
    origin = int(datetime(2026, 1, 1, tzinfo=UTC).timestamp())
    events = [(f"e{i}", r.choice(["hot", f"M{r.randint(1, 13)}"]).replace("hot", "M3"), r.choice([None] + [origin + r.randint(-90_000, 40 * 86_400)] * 9), "clash") for i in range(600)] + [("n", None, origin, "clash")]
    df = spark.createDataFrame(events, "event_id string, machine_id string, epoch_s bigint, _m string")
    facts = defaultdict(list)
    for d, m, c, s, x, _, at in rows:
        if all(v and str(v).strip() for v in (d, m, c, s, x)):
            facts[m.strip()].append((d, at, s.strip()))
    for module, name, value in ((shards, "HOT", 40), (shards, "QUANTILES", 8), (shards, "NAMED", named), (asof, "PIECE", 7)):
        monkeypatch.setattr(module, name, value)
    got = {x.event_id: x for x in asof.as_known(df, usable, "site_id").collect()}
    assert len(got) == len(events) and all(x._m == "clash" for x in got.values())
    for i, m, t, _ in events:
        if m in disputed:
            continue
        known = None
        if m and t is not None:
            now = datetime.fromtimestamp(t, UTC)
            on_hand = [(d, s) for d, at, s in facts[m] if d <= now.date() and at <= now]
            known = max(on_hand)[1] if on_hand else None
        assert got[i].known_site_id == known, (i, m, t)
    assert asof.as_known(df, usable.limit(0), "site_id").where("known_site_id is not null").count() == 0
    assert asof.as_known(df.limit(0), usable, "site_id").collect() == []


def brute_reason(line):
    if line is None:
        return "column_count"
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            j, buf = i + 1, ""
            while True:
                if j >= n:
                    return "quoting"
                if line[j] == '"':
                    if line[j + 1 : j + 2] == '"':
                        buf += '"'
                        j += 2
                        continue
                    break
                buf += line[j]
                j += 1
            i = j + 1
            if i < n and line[i] != ",":
                return "quoting"
        else:
            j = line.find(",", i)
            j = n if j < 0 else j
            buf = line[i:j]
            if '"' in buf:
                return "quoting"
            i = j
        fields.append(buf)
        if i >= n:
            break
        i += 1
    if len(fields) != 20:
        return "column_count"
    import re

    number = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", re.A)
    try:
        t = fields[2].strip(" ")
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-]\d\d:\d\d)", t, re.A)
        datetime.strptime(t[:19], "%Y-%m-%dT%H:%M:%S")
        assert t[17:19] < "60"
    except (AssertionError, ValueError):
        return "event_ts"
    for k, name in ((6, "hour_meter"), (11, "temperature_c")):
        v = fields[k].strip(" ")
        if v and not number.fullmatch(v):
            return name
    return None


def test_lines_against_brute_force(spark):
    r = random.Random(8)
    good = "L1,M1,2026-01-05T10:00:00Z,S,C,Crawler,12.5,telemetry,RUNNING,OK,none,61.0,2.2,50,60,0,0,NONE,0,day".split(",")
    lines = [",".join(good), None, "", ",".join(good) + ",", '"' + '","'.join(good) + '"', ",".join(good[:19]), "x" * 200_000, ("a" * 50 + ",") * 20_000, '"' + '""' * 100_000 + '"', '"' * 99_999]
    noise = ['"', '""', ",", " ", "\n", "x", '"a,b"', '"a""b"', "1e5", "2024-02-29T00:00:00Z", "2023-02-29T00:00:00Z", '" 5 "', ' "5"', '"5" ', "NaN", "2026-01-05T24:00:00Z", "1900-02-29T00:00:00Z", "2000-02-29T00:00:00Z"]
    for _ in range(1500):
        f = list(good)
        for _ in range(r.randint(1, 3)):
            k = r.choice([0, 2, 5, 6, 11, 19])
            f[k] = r.choice([*noise, f[k] + r.choice(noise), r.choice(noise) + f[k]])
        if r.random() < 0.2:
            f.insert(r.randint(0, 20), r.choice(noise))
        lines.append(",".join(f))
    df = spark.createDataFrame(list(enumerate(lines)), "record_id bigint, raw_line string")
    sound, broken = malformed.load_lines(df)
    got = {x.record_id: x.reason for x in broken.collect()}
    for i, line in enumerate(lines):
        assert got.get(i) == brute_reason(line), repr(line)[:200]
    loaded = {x.record_id for x in sound.collect()}
    assert loaded == set(range(len(lines))) - set(got)
    first = sound.where("record_id = 0").first()
    assert first.hour_meter == 12.5 and first.model == "Crawler" and first.operator_shift == "day"
    assert malformed.load_lines(df.limit(0))[1].collect() == []


def test_columns_that_do_not_read(spark):
    rows = [event(1), event(2, event_ts=None), event(3, hour_meter="x", temperature_c="y"), event(4, temperature_c="1,5"), event(5, hour_meter=" ")]
    df = spark.createDataFrame(rows, EVENTS)
    assert {tuple(x) for x in malformed.load_columns(df)[1].collect()} == {(2, "event_ts"), (3, "hour_meter"), (4, "temperature_c")}


def test_trailing_totals_against_brute_force(spark):
    r = random.Random(9)
    start = date(2026, 1, 1)
    rows = [(r.choice(["a", "b", "hot", "hot", None]), r.choice([None] + [start + timedelta(r.randint(0, 70))] * 20), r.choice([None, 0.0, 5.0, 12.25])) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, d date, v double")
    amount, days = defaultdict(float), defaultdict(list)
    for k, d, v in rows:
        if k and d:
            amount[k, d] += v or 0
            days[k].append(d)
    want = {}
    for k, ds in days.items():
        d = min(ds)
        while d <= max(ds):
            want[k, d] = tuple(sum(amount.get((k, d - timedelta(j)), 0) for j in range(n)) for n in (7, 30))
            d += timedelta(1)
    got = {(x.k, x.d): (float(x.total_7d), float(x.total_30d)) for x in rolling.trailing_totals(df, "k", "d", "v").collect()}
    assert got == want
    huge = spark.createDataFrame([("a", start, 6e7), ("a", start + timedelta(8), 0.1), ("b", start, 1e300), ("b", start + timedelta(40), 0.1)], "k string, d date, v double")
    last = {x.k: (float(x.total_7d), float(x.total_30d)) for x in rolling.trailing_totals(huge, "k", "d", "v").where("d = '2026-01-09' or d = '2026-02-10'").collect()}
    assert last == {"a": (0.1, 60000000.1), "b": (0.1, 0.1)}
    assert rolling.trailing_totals(df.limit(0), "k", "d", "v").collect() == []
