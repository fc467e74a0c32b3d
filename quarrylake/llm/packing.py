"""Filling containers of fixed capacity with items of varying size.

Items are gathered where they lie, a bounded number of containers at a time; Karmarkar-Karp differencing spreads each
batch over windows of nearly equal load, and the window count rises while a window exceeds the capacity. No shuffle, no
global state: the space lost is that of each batch's rounding, and of one last batch per input partition.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quarrylake.functions.shipping import shipped

#: Containers of a batch, and the share of their room that is left free, which differencing needs to even out.
WIDTH, FREE = 256, 0.001
#: Items put back, while a batch is gathered, because they would overfill it.
HELD = 256
#: How many of the emptiest windows a window that exceeds the capacity is differenced with, one after the other.
PARTNERS = 32


def difference(sizes: list[int], k: int) -> tuple[list[list[int]], list[int]]:
    """(items of each window, load of each window) by multiway differencing into at most k windows; empty windows are left out.

    Each item starts as a partition of its own. The two partitions with the greatest imbalance are merged over and over,
    the fullest windows of one with the emptiest of the other, until one is left. A partition lists its windows that hold
    something by load; the rest are empty.
    """
    left, right = list(range(len(sizes))), [-1] * len(sizes)  # a window's content: an item, or two contents

    def put(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
        left.append(a[1])
        right.append(b[1])
        return a[0] + b[0], len(left) - 1

    parts = {i: [(s, i)] for i, s in enumerate(sizes)}
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = parts.pop(heapq.heappop(heap)[1]), parts.pop(heapq.heappop(heap)[1])
        if len(a) < len(b):
            a, b = b, a
        if len(b) == 1:
            insort(a, put(a.pop(0), b[0]) if len(a) == k else b[0])
        else:
            both = max(0, len(a) + len(b) - k)
            a = sorted([put(x, y) for x, y in zip(a[:both], reversed(b[:both]))] + a[both:] + b[both:])
        key = a[-1][1]
        parts[key] = a
        heapq.heappush(heap, ((a[0][0] if len(a) == k else 0) - a[-1][0], key))
    windows, loads = [], []
    for load, top in next(iter(parts.values()), []):
        items, todo = [], [top]
        while todo:
            x = todo.pop()
            if right[x] < 0:
                items.append(x)
            else:
                todo += (left[x], right[x])
        windows.append(items)
        loads.append(load)
    return windows, loads


def even_out(sizes: list[int], windows: list[list[int]], loads: list[int], capacity: int) -> bool:
    """Differences each window that exceeds capacity once more, with one of the emptiest, into two. Whether none exceeds it then."""
    order = sorted(range(len(windows)), key=loads.__getitem__)
    while order and loads[a := order.pop()] > capacity:
        for at, b in enumerate(order[:PARTNERS]):
            if loads[a] + loads[b] > 2 * capacity:
                return False
            both = windows[a] + windows[b]
            pair, load = difference([sizes[i] for i in both], 2)
            if max(load) <= capacity:
                (windows[a], windows[b]), (loads[a], loads[b]) = [[both[i] for i in w] for w in pair], load
                order.pop(at)
                break
        else:
            return False
    return True


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most capacity, as item numbers; no size is greater than capacity. The window count rises until none exceeds it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows, loads = difference(sizes, k)
        if even_out(sizes, windows, loads, capacity):
            return windows
        k += 1


def pack(items: Iterable[tuple[int, object]], capacity: int) -> Iterator[list[tuple[int, object]]]:
    """Cuts a stream of (size, item), sizes from 1 to capacity, into containers. Holds a bounded number of items.

    A batch's room is filled with the items put back before and then from the stream; what would overfill it waits. An
    item of just the capacity is a container of its own.
    """
    room = int(WIDTH * capacity * (1 - FREE))
    stream, more, held = iter(items), True, []
    while more or held:
        batch, total, kept = [], 0, []
        for x in held:
            if total + x[0] <= room:
                batch.append(x)
                total += x[0]
            else:
                kept.append(x)
        held = kept
        while more and room - total > room >> 12 and len(held) < HELD:
            x = next(stream, None)
            if x is None:
                more = False
            elif x[0] == capacity:
                yield [x]
            elif total + x[0] <= room:
                batch.append(x)
                total += x[0]
            else:
                held.append(x)
        for w in windows_of([x[0] for x in batch], capacity) if batch else ():
            yield [batch[i] for i in w]


def containers(sized: DataFrame, capacity: int = 2048) -> DataFrame:
    """doc_id, piece_no, start_token, n_tokens, container: every text of sized (doc_id, n_tokens) or piece of it, with its container.

    A text of up to capacity tokens is one piece and goes into one container; a longer one is cut into pieces of capacity
    and a rest. Texts of size 0 or NULL are left out; repeated rows are packed each. A container is named by its
    partition and its number there. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[int, object]]:
            for batch in batches:
                for doc, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for k, start in enumerate(range(0, n or 0, capacity)):
                        yield min(capacity, n - start), (doc, k, start)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)

        rows: list[tuple] = []
        part = TaskContext.get().partitionId()
        for number, window in enumerate(pack(pieces(), capacity)):
            name = f"{part}:{number}"
            rows += [(doc, k, start, n, name) for n, (doc, k, start) in window]
            if len(rows) >= 10_000:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)

    return shipped(sized).select("doc_id", "n_tokens").mapInArrow(run, "doc_id bigint, piece_no int, start_token int, n_tokens int, container string")


SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece_no", pa.int32()), ("start_token", pa.int32()), ("n_tokens", pa.int32()), ("container", pa.string())])
