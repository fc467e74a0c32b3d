"""Byte-pair encoding by an automaton over tokens.

The merges are compiled one by one. In an automaton whose states are the last token read, the gadget of merge (u, v)
takes the arc v out of state u and adds the arc uv wherever an arc u leads out; the new token's state starts as a copy of
v's. The paths of the final automaton are exactly the encodings, and each text has one. Its arcs are kept by the gadgets
that made them, so that 50,000 merges take a table of 50,000 pairs and not a square of that.

Texts are read byte by byte through a deterministic table made from it on demand: a state holds the tokens begun and, for
each, the token before it; an arc's label is the last token of the encoding so far. Following labels back from the end
gives the encoding.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from struct import pack as packed

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from quarrylake.functions.shipping import shipped

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: What encodings don't cross: contractions, letters, numbers, other signs (each with a blank before it), white space.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Bounds of the tables made on demand; beyond them they start anew.
MAX_STATES, MAX_WORDS, MAX_UNITS, LONG_UNIT = 100_000, 200_000, 300_000, 200


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    def __init__(self, ids: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ids, self.bytes_of = ids, {i: t for t, i in ids.items()}
        self.birth = {ids[bytes([b])]: 0 for b in range(256)}
        self.halves: dict[int, tuple[int, int]] = {}
        self.cut: dict[tuple[int, int], int] = {}  # (u, v): the merge that takes arc v out of state u
        self.prefixes: set[bytes] = set()
        for k, (u, v) in enumerate(merges, 1):
            self._gadget(k, u, v)
        self._forget()

    def _gadget(self, k: int, u: bytes, v: bytes) -> None:
        a, b, t = self.ids[u], self.ids[v], self.ids[u + v]
        self.cut[a, b] = k
        if t not in self.birth:
            self.birth[t], self.halves[t] = k, (a, b)
            self.prefixes.update((u + v)[:i] for i in range(1, len(u) + len(v)))

    def arc(self, s: int, t: int) -> bool:
        """Whether token t may follow token s."""
        limit = len(self.cut) + 1
        while True:
            if self.cut.get((s, t), limit + 1) <= limit:
                return False
            a, b = self.birth[s], self.birth[t]
            if a == b == 0:
                return True
            if a > b:  # state s began as a copy of its right half's
                s, limit = self.halves[s][1], a - 1
            else:  # arc t was added where an arc of its left half led out
                t, limit = self.halves[t][0], b

    def _forget(self) -> None:
        self.states: list[tuple[tuple[bytes, int], ...]] = [((b"", -1),)]
        self.number = {self.states[0]: 0}
        self.table: dict[int, tuple[int, int]] = {}

    def _make(self, state: int, byte: int) -> tuple[int, int]:
        begun, last = [], -1
        for pending, before in self.states[state]:
            p = pending + bytes([byte])
            t = self.ids.get(p)
            if t is not None and t in self.birth and (before < 0 or self.arc(before, t)):
                last = t
            if p in self.prefixes:
                begun.append((p, before))
        new = (*begun, (b"", last))
        if (k := self.number.get(new)) is None:
            k = self.number[new] = len(self.states)
            self.states.append(new)
        self.table[state << 8 | byte] = move = (k, last)
        return move

    def encode_word(self, word: bytes) -> list[int]:
        state, labels, table = 0, [], self.table
        for b in word:
            move = table.get(state << 8 | b) or self._make(state, b)
            state = move[0]
            labels.append(move[1])
            if len(self.states) > MAX_STATES:  # the state stays, the rest is made again
                here = self.states[state]
                self._forget()
                table = self.table
                state = self.number.setdefault(here, len(self.states))
                if state == len(self.states):
                    self.states.append(here)
        out, at = [], len(word)
        while at:
            out.append(labels[at - 1])
            at -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


class _Units(dict):
    """Encoded bytes (int32) of a text's units, encoded when first asked for. A unit is cut before a blank that a word follows."""

    def __init__(self, lead: str, words: dict[str, bytes], automaton: Automaton):
        self.lead, self.words, self.automaton, self.find = lead, words, automaton, regex.compile(WORDS).findall

    def __missing__(self, unit: str) -> bytes | None:
        """None where no unit may be cut: white space is adjacent."""
        if self.lead and (not unit or unit[0].isspace()):
            self[unit] = None
            return None
        out = []
        for w in self.find(self.lead + unit):
            e = self.words.get(w)
            if e is None:
                ids = self.automaton.encode_word(w.encode("utf-8", "replace"))
                e = packed(f"{len(ids)}i", *ids)
                if len(w) < LONG_UNIT:
                    if len(self.words) > MAX_WORDS:
                        self.words.clear()
                    self.words[w] = e
            out.append(e)
        e = b"".join(out)
        if len(unit) < LONG_UNIT:
            if len(self) > MAX_UNITS:
                self.clear()
            self[unit] = e
        return e


def _of_json(content: bytes) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """(ids, merges in order) of a vocabulary file in JSON."""
    model, letters = json.loads(content)["model"], byte_letters()
    raw = lambda t: bytes([letters[c] for c in t])
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return {raw(t): i for t, i in model["vocab"].items() if not t.startswith("<|")}, [(raw(a), raw(b)) for a, b in pairs]


def _of_ranks(content: bytes) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """(ids, merges in order) of a file of tokens and ranks. A token's merge is of the two parts that the merges before it leave of it."""
    ids = {base64.b64decode(t): int(rank) for t, rank in (line.split() for line in content.splitlines() if line.strip())}
    merges = []
    for token, rank in sorted(ids.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: ids.get(parts[i] + parts[i + 1], rank))
            if ids.get(parts[at] + parts[at + 1], rank) >= rank:
                raise ValueError(f"no two tokens make token {rank}")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        merges.append((parts[0], parts[1]))
    return ids, merges


class Tokenizer:
    """Encodes texts with a byte-level BPE vocabulary: the content of a public file in JSON, or of one of tokens and ranks. Special tokens are never made."""

    _cut = re.compile(r" (?=\S)")

    def __init__(self, vocabulary: bytes):
        self.automaton = Automaton(*(_of_json if vocabulary.lstrip()[:1] == b"{" else _of_ranks)(vocabulary))
        words: dict[str, bytes] = {}
        self._first, self._next = _Units("", words, self.automaton), _Units(" ", words, self.automaton)

    def encode_packed(self, text: str) -> bytes:
        """The ids of a text, four bytes each."""
        parts = text.split(" ")
        try:
            return self._first[parts[0]] + b"".join(map(self._next.__getitem__, parts[1:]))
        except TypeError:  # a None among them
            parts = self._cut.split(text)
            return self._first[parts[0]] + b"".join(map(self._next.__getitem__, parts[1:]))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), np.int32).tolist() if text else []

    def decode(self, ids: list[int]) -> str:
        return self.automaton.decode(ids).decode("utf-8", "replace")


_made: dict[int, Tokenizer] = {}


def _here(vocabulary: Broadcast) -> Tokenizer:
    """The tokenizer of this Python worker, compiled once."""
    key = hash(vocabulary.value)
    if key not in _made:
        _made.clear()
        _made[key] = Tokenizer(vocabulary.value)
    return _made[key]


def _shared(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file, a fixed few MB, for all executors."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoded(column: pa.Array, tokenizer: Tokenizer) -> list[bytes]:
    return [tokenizer.encode_packed(t) if t else b"" for t in column.to_pylist()]


def token_ids(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id and ids (array of int) of each document; NULL and empty texts give an empty list. One row per row of documents."""
    shared = _shared(documents.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoded = _encoded(batch.column(1), _here(shared))
            offsets = np.zeros(len(encoded) + 1, np.int32)
            np.cumsum([len(e) // 4 for e in encoded], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return shipped(documents).select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of each document, 0 for NULL and empty texts."""
    shared = _shared(documents.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(e) // 4 for e in _encoded(batch.column(1), _here(shared))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32())], names=["doc_id", "n_tokens"])

    return shipped(documents).select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens int")
