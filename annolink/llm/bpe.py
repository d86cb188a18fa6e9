"""Byte-level BPE by a contiguous rank array, and exact token counts of a compiled transducer.

`encode` reads whole texts. A null text is the empty text, which has no tokens. Repeated rows give repeated results;
ids, null ones too, go through as they are; other columns never take part.

Texts are split by the `regex` module, whose classes of some rare characters are not the library's. A text that has
one of them is split by a slower pattern over the library's own classes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .chars import Classes, classes_of
from .near import pieces

#: The split of byte-level texts before merging, and the largest rank.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NONE = 1 << 60


def byte_letters() -> dict[str, int]:
    """Letters that stand for the 256 bytes in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Ranks of merged byte strings, ids and added tokens of a byte-level BPE file."""

    def __init__(self, path: str, classes: Classes | None = None, cache: int = 1 << 18):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letter[c] for c in token)

        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        self.bytes = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.rank = {(raw(a), raw(b)): r for r, (a, b) in enumerate(spec["model"]["merges"])}
        self.classes = classes or classes_of(path)
        self.split, self.split_odd = regex.compile(SPLIT), self.classes.split_pattern()
        self.odd, self.odd_byte = self.classes.odd_characters(), self.classes.odd_byte()
        self.stops = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.known: dict[str, tuple[int, ...]] = {}
        self.cache = cache

    def word(self, piece: str) -> tuple[int, ...]:
        found = self.known.get(piece)
        if found is None:
            found = tuple(self.ids[p] for p in self.merge(piece.encode()))
            if len(self.known) >= self.cache:
                self.known.clear()
            if len(piece) <= 64:
                self.known[piece] = found
        return found

    def merge(self, piece: bytes) -> list[bytes]:
        """Boundaries and the rank of each adjacent pair lie in two arrays; the least rank goes first.

        A long piece (no blank for thousands of bytes) keeps its pairs in a heap instead, so that
        the time is n log n rather than n squared.
        """
        if piece in self.ids and len(piece) < 2:
            return [piece]
        if len(piece) > 256:
            return self.merge_long(piece)
        rank = self.rank
        cut = list(range(len(piece) + 1))
        pair = [rank.get((piece[i:i + 1], piece[i + 1:i + 2]), NONE) for i in range(len(piece) - 1)]
        while pair:
            least = min(pair)
            if least == NONE:
                break
            i = pair.index(least)
            del cut[i + 1], pair[i]
            if i < len(pair):
                pair[i] = rank.get((piece[cut[i]:cut[i + 1]], piece[cut[i + 1]:cut[i + 2]]), NONE)
            if i:
                pair[i - 1] = rank.get((piece[cut[i - 1]:cut[i]], piece[cut[i]:cut[i + 1]]), NONE)
        return [piece[a:b] for a, b in zip(cut, cut[1:])]

    def merge_long(self, piece: bytes) -> list[bytes]:
        import heapq

        n, rank = len(piece), self.rank
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))

        def look(i):
            j = end[i]
            if j < n:
                r = rank.get((piece[i:j], piece[j:end[j]]))
                if r is not None:
                    heapq.heappush(heap, (r, i, j, end[j]))

        heap: list = []
        for i in range(n - 1):
            look(i)
        alive = bytearray(b"\x01") * n
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if not alive[i] or end[i] != j or j >= n or not alive[j] or end[j] != k:
                continue
            alive[j] = 0
            end[i] = k
            if k < n:
                before[k] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        return [piece[i:end[i]] for i in range(n) if alive[i]]

    def is_odd(self, text: str) -> bool:
        """Whether the text has a character that the two modules class differently."""
        if text.isascii():
            return False
        high = np.frombuffer(text.encode(), dtype=np.uint8).max(initial=0) >= self.odd_byte
        return bool(high) and not self.odd.isdisjoint(text)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        split = self.split_odd if self.is_odd(text) else self.split
        known, word = self.known.get, self.word
        for part in self.stops.split(text) if self.added else [text]:
            if part in self.added:
                out.append(self.added[part])
            else:
                for piece in split.findall(part):
                    out += known(piece) or word(piece)
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", errors="replace")


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str, classes: Classes | None = None) -> Vocabulary:
    """One vocabulary per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path, classes)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>, decoded string); one output row per input row, null as empty text."""
    classes = classes_of(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, classes)
        for b in pieces(batches, 64):
            ids = [v.encode(x or "") for x in b.column("text").to_pylist()]
            columns = [b.column("key"), pa.array(ids, pa.list_(pa.int32())), pa.array([v.decode(i) for i in ids], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", "decoded"])

    rows = docs.selectExpr(f"`{id_col}` AS key", f"`{text_col}` AS text")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", id_col)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """As `encode`, with digests made beside the ids so that neither ids nor texts leave the task."""
    classes = classes_of(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, classes)
        for b in pieces(batches):
            out = []
            for text in b.column("text").to_pylist():
                ids = v.encode(text or "")
                out.append((len(ids), hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(v.decode(ids).encode()).hexdigest()))
            n, first, second = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
