"""Token counts from a transducer whose transitions carry counts of emitted tokens.

The pre-tokenizer of byte-level BPE is compiled to a finite-state machine over character
classes (letter, number, blank, other space, other, end of text). A text is cut into chunks;
a chunk is a map from each state it may be entered in to the state it is left in, and the maps
are composed by a parallel prefix scan (doubling). With the entry state of each chunk known, all
transitions that close a piece are found at once, and each piece emits its count.

Contractions ('s, 't, ...) and the blank before a word need one character of look-back and are
settled on the pieces the machine marks. A null text is the empty text; it has no tokens. Ids, null ones too, go
through as they are. The classes are the library's own (see chars.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import vocabulary
from .chars import BLANK, SPACE, classes_of
from .near import pieces

CHUNK = 4096


def machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece starts) for a state and a class.

    A state is 2 * class of the last character + whether the piece so far is one single blank,
    which may still open a word.
    """
    step = np.zeros((10, 5), dtype=np.int8)
    opens = np.zeros((10, 5), dtype=bool)
    for state in range(10):
        last, lone = divmod(state, 2)
        for c in range(5):
            step[state, c] = 2 * c + (c == BLANK)
            white, was_white = c in (BLANK, SPACE), last in (BLANK, SPACE)
            opens[state, c] = not (last == c and not white) and not (white and was_white) and not (lone and not white)
    return step, opens


STEP, OPENS = machine()


def entry_states(cls: np.ndarray, start: int) -> np.ndarray:
    """State before each chunk: the chunks' state maps composed by a doubling prefix scan."""
    n = -(-len(cls) // CHUNK)
    maps = np.empty((n, 10), dtype=np.int8)
    for i in range(n):
        # every state reads the chunk; all agree after its last character
        maps[i] = STEP[:, cls[min((i + 1) * CHUNK, len(cls)) - 1]]
    gap = 1
    while gap < n:
        maps[gap:] = np.take_along_axis(maps[gap:], maps[:-gap].astype(np.int64), axis=1)
        gap *= 2
    return np.concatenate([[start], maps[:-1, start]]).astype(np.int64)


def starts(text: str, table: np.ndarray) -> np.ndarray:
    """Positions where pieces start; table: class of every code point."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    cls = table[points].astype(np.int64)
    n = len(cls)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    state = np.empty(n, dtype=np.int64)
    state[1:] = STEP[0, cls[:-1]]
    state[::CHUNK] = entry_states(cls, 2 * SPACE)
    opens = OPENS[state, cls]
    opens[0] = True
    white = (cls == BLANK) | (cls == SPACE)
    # a run of white space gives its last character to what follows
    last = np.flatnonzero(white[:-1] & ~white[1:])
    opens[last] = True
    opens[last + 1] = cls[last] != BLANK
    at = np.flatnonzero(points == 39)
    for i in at:
        # a contraction needs a piece that starts at the quote
        if opens[i]:
            tail = text[i + 1:i + 3]
            size = 2 if tail[:1] in ("s", "t", "m", "d") and tail else 3 if tail in ("re", "ve", "ll") else 0
            if size and i + size < n:
                opens[i + 1:i + size] = False
                rest = i + size
                opens[rest] = True if not white[rest] else opens[rest]
            elif size:
                opens[i + 1:i + size] = False
    return np.flatnonzero(opens)


def count(text: str, v, table: np.ndarray) -> int:
    """Tokens that the machine emits over one text."""
    total = 0
    for part in v.stops.split(text):
        if part in v.added:
            total += 1
        elif part:
            at = starts(part, table).tolist()
            at.append(len(part))
            word = v.word
            for a, b in zip(at, at[1:]):
                total += len(word(part[a:b]))
    return total


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; one row per input row."""
    classes = classes_of(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, table = vocabulary(path, classes), classes.table()
        for b in pieces(batches):
            text = [x or "" for x in b.column("text").to_pylist()]
            n = [count(x, v, table) for x in text]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x.encode()) for x in text], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
