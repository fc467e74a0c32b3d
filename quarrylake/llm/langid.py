"""Language of texts and of their lines, by character models.

Each language has an interpolated Kneser-Ney model over the characters of words, trained on labelled samples. The models
of all languages share sorted arrays of n-gram hashes. A line gets the language of the lowest cross-entropy per
character, given what its text is mostly in; what no model explains about as well as it does held-out samples gets none.
"""

from __future__ import annotations

import io
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.functions.shipping import shipped

ORDER = 6
#: Weight of a text's main language for each of its lines, and of all others together.
MAIN = 0.7
#: Bound of the table of scored chunks; beyond it, it starts anew.
MAX_CHUNKS = 200_000
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
_WORD = re.compile(r"[^\W\d_]+(?:['’ʼ][^\W\d_]+)*['’ʼ]?")


def bare(word: str) -> str:
    """The word without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def words_of(chunk: str) -> list[str]:
    """The words of a chunk between white space, in lower case and composed. Codes, that is chunks with a digit or an underscore, have none."""
    if any(c.isdigit() or c == "_" for c in chunk):
        return []
    chunk = unicodedata.normalize("NFC", _INVISIBLE.sub("", chunk)).replace("’", "'").replace("ʼ", "'")
    return _WORD.findall(chunk.lower())


class Models:
    """Kneser-Ney models of several languages in shared sorted hash arrays.

    For each order: hashes of n-grams with the discounted probability of their last character, and hashes of histories
    with the weight of the next lower order; a column per language.
    """

    def __init__(self, words: dict[str, Counter[str]], order: int = ORDER):
        self.langs, self.order = sorted(words), order
        counts = [[Counter() for _ in range(order + 1)] for _ in self.langs]
        for k, lang in enumerate(self.langs):
            for w, times in words[lang].items():
                # accents are lost in places: such a spelling counts beside the full one
                for form in {w, bare(w)}:
                    s = " " * (order - 1) + form + " "
                    for i in range(order - 1, len(s)):
                        counts[k][order][s[i - order + 1 : i + 1]] += times
        for c in counts:  # below the highest order: in how many contexts an n-gram ends
            for n in range(order - 1, 0, -1):
                for g in c[n + 1]:
                    c[n][g[1:]] += 1
        self.alphabet = max(1, len({g for c in counts for g in c[1]}))
        self.tables = []
        for n in range(1, order + 1):
            rows: dict[str, dict[int, float]] = defaultdict(dict)
            back: dict[str, dict[int, float]] = defaultdict(dict)
            for k, c in enumerate(counts):
                ones = sum(v == 1 for v in c[n].values())
                twos = sum(v == 2 for v in c[n].values())
                d = ones / (ones + 2 * twos) if ones and twos else 0.5
                total, kinds = Counter(), Counter()
                for g, v in c[n].items():
                    total[g[:-1]] += v
                    kinds[g[:-1]] += 1
                for g, v in c[n].items():
                    rows[g][k] = max(v - d, 0) / total[g[:-1]]
                for h, v in total.items():
                    back[h][k] = d * kinds[h] / v
            self.tables.append((self._sorted(rows, 0.0), self._sorted(back, 1.0)))

    def _sorted(self, rows: dict[str, dict[int, float]], default: float) -> tuple[np.ndarray, np.ndarray]:
        grams = list(rows)
        n = len(grams[0]) if grams else 0
        codes = np.array([[ord(c) for c in g] for g in grams], np.uint64).reshape(len(grams), n)
        keys = _hash(codes, n)
        values = np.full((len(grams), len(self.langs)), default, np.float32)
        for i, g in enumerate(grams):
            for k, v in rows[g].items():
                values[i, k] = v
        at = np.argsort(keys)
        return keys[at], values[at]

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(natural log of the probability of each word by language, characters of each word, its end counted)."""
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        if not len(words):
            return np.zeros((0, len(self.langs)), np.float32), lengths
        pad = " " * (self.order - 1)
        chars = np.frombuffer((pad + (pad).join([w + " " for w in words])).encode("utf-32-le"), np.uint32).astype(np.uint64)
        ends = np.cumsum(lengths + self.order - 1)
        inside = np.ones(len(chars), bool)
        for i in range(self.order - 1):
            inside[np.r_[0, ends[:-1]] + i] = False
        at = np.flatnonzero(inside)
        p = np.full((len(at), len(self.langs)), 1 / self.alphabet, np.float32)
        for n, ((keys, values), (hkeys, weights)) in enumerate(self.tables, 1):
            window = np.stack([chars[at - n + 1 + i] for i in range(n)], 1)
            found, row = _find(hkeys, _hash(window[:, :-1], n - 1))
            p[found] *= weights[row]
            found, row = _find(keys, _hash(window, n))
            p[found] += values[row]
        logs = np.log(p)
        return np.add.reduceat(logs, np.r_[0, np.cumsum(lengths)[:-1]], axis=0), lengths


def count_words(texts: Iterable[tuple[str, str]]) -> dict[str, Counter[str]]:
    """How often each language's texts hold each word."""
    words: dict[str, Counter[str]] = defaultdict(Counter)
    for lang, text in texts:
        words[lang].update(w for c in text.split() for w in words_of(c))
    return words


def adapt(models: Models, words: dict[str, Counter[str]], labelled: Iterable[tuple[str, str]], doubt: float = 30.0) -> Models:
    """Models that know the labelled texts' words as well.

    A text counts where the models find it in the language of its label; of its lines, those that aren't in another
    language by more than doubt (the logarithm of the ratio of probabilities).
    """
    rows, index = [], {}
    for lang, text in labelled:
        lines = [[w for c in line.split() for w in words_of(c)] for line in text.split("\n")]
        rows.append((lang, [[index.setdefault(w, len(index)) for w in line] for line in lines if line]))
    scores, names = models.score(list(index))[0], list(index)
    more = {lang: Counter(c) for lang, c in words.items()}
    for lang, lines in rows:
        if lang in more and lines:
            k = models.langs.index(lang)
            sums = np.stack([scores[line].sum(0) for line in lines])
            if sums.sum(0).argmax() == k:
                for line, own in zip(lines, sums):
                    if own.max() - own[k] <= doubt:
                        more[lang].update(names[i] for i in line)
    return Models(more, models.order)


def _hash(codes: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(codes), n + 1, np.uint64)
    for i in range(n):
        h = (h ^ codes[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of asked are among the sorted keys, where)."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    found = np.flatnonzero(keys[at] == asked)
    return found, at[found]


class Identifier:
    """The models with what rejects and what tempers, both from samples held out in folds.

    floor: no line is worse explained than the worst held-out sample by more than slack per character. temper: what log
    probabilities are divided by before they become a confidence (characters of a word aren't independent), so that it
    fits best how often held-out snippets of few words are told right.
    """

    def __init__(self, samples: list[tuple[str, str]], labelled: Iterable[tuple[str, str]] = (), folds: int = 4, slack: float = 0.5, snippet: int = 3):
        worst, short, truth = [0.0], [], []
        for f in range(folds):
            part = Models(count_words(x for i, x in enumerate(samples) if i % folds != f))
            for lang, text in samples[f::folds]:
                logs, chars = part.score([w for c in text.split() for w in words_of(c)])
                if len(chars) and part.langs:
                    worst.append(float(logs.sum(0).max() / chars.sum()))
                    if lang in part.langs:
                        parts = np.add.reduceat(logs.astype(float), np.arange(0, len(logs), snippet), axis=0)
                        parts -= parts.max(1, keepdims=True)
                        right = np.zeros_like(parts, bool)
                        right[:, part.langs.index(lang)] = True
                        short.append(parts.ravel())
                        truth.append((right.ravel(), len(part.langs)))
        self.floor = min(worst) - slack
        self.temper = _temper(short, truth)
        words = count_words(samples)
        self.models = adapt(Models(words), words, labelled)

    def to_bytes(self) -> bytes:
        """The fitted identifier as an archive of arrays, to be kept beside the data and read by from_bytes."""
        m, out = self.models, io.BytesIO()
        tables = {f"{n}_{i}_{j}": a for n, pair in enumerate(m.tables) for i, arrays in enumerate(pair) for j, a in enumerate(arrays)}
        np.savez_compressed(out, langs=np.array(m.langs, "U"), scalars=np.array([m.order, m.alphabet, self.floor, self.temper]), **tables)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, content: bytes) -> Identifier:
        with np.load(io.BytesIO(content), allow_pickle=False) as z:
            it, m = cls.__new__(cls), Models.__new__(Models)
            order, alphabet, it.floor, it.temper = z["scalars"].tolist()
            m.langs, m.order, m.alphabet = z["langs"].tolist(), int(order), int(alphabet)
            m.tables = [tuple((z[f"{n}_{i}_0"], z[f"{n}_{i}_1"]) for i in (0, 1)) for n in range(m.order)]
            it.models = m
        return it


def _temper(short: list[np.ndarray], truth: list[tuple[np.ndarray, int]]) -> float:
    """Of some divisors the one under which what is true is most probable."""

    def surprise(t: float) -> float:
        total = 0.0
        for logs, (right, langs) in zip(short, truth):
            rows = logs.reshape(-1, langs) / t
            total += float((np.log(np.exp(rows).sum(1)) - rows.ravel()[right]).sum())
        return total

    return min(np.geomspace(1, 16, 25).tolist(), key=surprise) if short else 3.0


class _Chunks(dict):
    """Row of each chunk's scores in a table that grows; row 0 is for chunks without words."""

    def __init__(self, models: Models):
        self.models, self.pending, self.used = models, [], 1
        self.scores, self.chars = np.zeros((1024, len(models.langs)), np.float32), np.zeros(1024, np.int64)

    def __missing__(self, chunk: str) -> int:
        words = words_of(chunk)
        if not words:
            row = 0
        else:
            row = self.used + len(self.pending)
            self.pending.append(words)
        self[chunk] = row
        return row

    def settle(self) -> None:
        """Scores what is pending, each distinct word once."""
        if not self.pending:
            return
        index: dict[str, int] = {}
        flat = [index.setdefault(w, len(index)) for ws in self.pending for w in ws]
        names = list(index)
        parts = [self.models.score(names[i : i + 20_000]) for i in range(0, len(names), 20_000)]
        logs, chars = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        cuts = np.r_[0, np.cumsum([len(ws) for ws in self.pending])[:-1]]
        need = self.used + len(self.pending)
        if need > len(self.scores):
            grow = max(need, 2 * len(self.scores)) - len(self.scores)
            self.scores = np.concatenate([self.scores, np.zeros((grow, self.scores.shape[1]), np.float32)])
            self.chars = np.concatenate([self.chars, np.zeros(grow, np.int64)])
        self.scores[self.used : need] = np.add.reduceat(logs[flat], cuts, axis=0)
        self.chars[self.used : need] = np.add.reduceat(chars[flat], cuts)
        self.used, self.pending = need, []


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the runs of values that end at ends; 0 for an empty run."""
    starts = np.r_[0, ends[:-1]]
    out = np.zeros((len(ends), *values.shape[1:]), np.float64 if values.dtype == np.float32 else values.dtype)
    some = np.flatnonzero(ends > starts)
    if len(some):
        out[some] = np.add.reduceat(values, starts[some], axis=0)
    return out


def _decide(logs: np.ndarray, chars: np.ndarray, floor: float, temper: float) -> tuple[np.ndarray, np.ndarray]:
    """(language number or -1, confidence) of each row of log probabilities."""
    if not logs.size:  # no rows, or no languages
        return np.full(len(logs), -1), np.zeros(len(logs))
    best = logs.argmax(1)
    top = logs[np.arange(len(logs)), best]
    confidence = 1 / np.exp((logs - top[:, None]) / temper).sum(1)
    known = (chars > 0) & (top >= floor * np.maximum(chars, 1))
    return np.where(known, best, -1), np.where(known, confidence, 0.0)


OUT = "doc_id bigint, line_no int, label string, lang string, confidence double"


def identify(documents: DataFrame, identifier: Identifier) -> DataFrame:
    """doc_id, line_no, label, lang, confidence: a row per line (text split at line feeds, counted from 0) and, with line_no NULL, per document.

    label is the row's own lang. What holds no words of a language gets lang NULL and confidence 0; a NULL or empty text
    has its document row and, when empty, line 0. Confidence is from 0 to 1. One row per line for each row of documents.
    """
    shared = documents.sparkSession.sparkContext.broadcast(identifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                yield _identify(batch.slice(at, 1000), shared)

    return shipped(documents).select("doc_id", F.col("lang").alias("label"), "text").mapInArrow(run, OUT)


_kept: list[tuple[Identifier, _Chunks]] = []


def _identify(batch: pa.RecordBatch, shared: Broadcast) -> pa.RecordBatch:
    it: Identifier = shared.value
    if not _kept or _kept[0][0] is not it or len(_kept[0][1]) > MAX_CHUNKS:
        _kept[:] = [(it, _Chunks(it.models))]
    chunks = _kept[0][1]
    rows: list[int] = []
    line_ends: list[int] = []
    doc_ends: list[int] = []
    look = chunks.__getitem__
    for text in batch.column(2).to_pylist():
        if text is not None:
            for line in text.split("\n"):
                rows += map(look, line.split())
                line_ends.append(len(rows))
        doc_ends.append(len(line_ends))
    chunks.settle()
    at, docs = np.array(rows, np.int64), np.array(doc_ends, np.int64)
    ends = np.array(line_ends, np.int64)
    logs, chars = _sums(chunks.scores[at], ends), _sums(chunks.chars[at], ends)
    doc_logs, doc_chars = _sums(logs, docs), _sums(chars, docs)
    doc_lang, doc_confidence = _decide(doc_logs, doc_chars, it.floor, it.temper)

    # a line is more likely in what its text is mostly in
    n = np.diff(np.r_[0, docs])
    of = np.repeat(np.arange(len(docs)), n)
    others = max(1, len(it.models.langs) - 1)
    main = np.repeat(doc_lang, n)
    has = np.flatnonzero((main >= 0) & (chars > 0))
    prior = np.zeros_like(logs)
    prior[has, main[has]] = np.log(MAIN * others / (1 - MAIN))
    lang, confidence = _decide(logs + prior, chars, it.floor, it.temper)

    names = pa.array([*it.models.langs, None], pa.string())
    take = lambda c, i: c.take(pa.array(i))
    every = np.r_[np.arange(len(docs)), of]
    number = pa.concat_arrays([pa.nulls(len(docs), pa.int32()), pa.array((np.arange(len(of)) - np.repeat(docs - n, n)).astype(np.int32))])
    found = np.r_[doc_lang, lang]
    return pa.RecordBatch.from_arrays(
        [take(batch.column(0), every), number, take(batch.column(1), every), take(names, np.where(found < 0, len(it.models.langs), found)), pa.array(np.r_[doc_confidence, confidence])],
        names=["doc_id", "line_no", "label", "lang", "confidence"],
    )


def stated(label: Column) -> Column:
    """The language that a label states, in lower case; NULL where it states none."""
    code = F.regexp_extract(F.trim(label), r"\A([A-Za-z]{2})(?:[-_](?s:.*))?\z", 1)
    return F.when(code != "", F.lower(code))


def fit(samples: DataFrame, documents: DataFrame | None = None, max_samples: int = 1000, max_labelled: int = 3000) -> Identifier:
    """An identifier from labelled samples (sample_id, lang, sample_text) and documents whose label states one of their languages.

    Both are bounded samples, chosen by a hash over the whole tables: of each language max_samples samples, and of all
    documents about max_labelled, never more, whose own labels may be wrong, see adapt. Of the documents the labels are
    counted first, then the texts read once; what reaches the driver is bounded by these two numbers, whatever ids are
    missing or repeated.
    """
    order = F.xxhash64("sample_id", "sample_text")
    some = samples.where("lang is not null and sample_text is not null").select("lang", "sample_text", "sample_id", order.alias("_h"))
    some = some.withColumn("_r", F.row_number().over(W.partitionBy("lang").orderBy("_h", "sample_id", "sample_text"))).where(F.col("_r") <= max_samples)
    pairs = [(r[0], r[1]) for r in sorted(some.select("lang", "sample_text", "sample_id").collect(), key=lambda r: (r[2] is None, r[2] or 0, r[1]))]
    labelled: list[tuple[str, str]] = []
    if documents is not None and pairs:
        known = documents.select("doc_id", stated(F.col("lang")).alias("lang"), "text").where(F.col("lang").isin(sorted({p[0] for p in pairs})))
        # a little more than the share that is asked for, so that only about as many texts as are taken leave their tasks
        share = min(1.0, 1.2 * max_labelled / max(1, known.select("lang").count()))
        hashed = known.where("text is not null").withColumn("_h", F.xxhash64("doc_id", "text"))
        picked = hashed.where(F.pmod("_h", F.lit(1 << 30)) < int(share * (1 << 30)))
        labelled = [(r[0], r[1]) for r in picked.orderBy("_h", "doc_id", "text", "lang").limit(max_labelled).select("lang", "text").collect()]
    return Identifier(pairs, labelled)
