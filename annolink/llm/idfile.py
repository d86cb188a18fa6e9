"""Token-id files in Simple-8b: 64-bit words whose selector says how many ids of which width follow.

A file is a Parquet folder in order of doc_id. One row is one block: its document ids, the places of
their ids (one more than documents), the number of ids, and the words as little-endian bytes.
The top four bits of a word are the selector. Selectors 0 to 13 pack COUNTS[s] ids of 60 // COUNTS[s] bits,
lowest bits first; the last word of a block may be filled with zeros. Selector 15 is the escape: the
word after it holds one id of up to 64 bits. Blocks are decoded apart, all words of a selector at once.

A null text is the empty text: it has the end id alone. Null document ids come first and stay null. Repeated
document ids are repeated documents, in order of a hash of their texts.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Fixed values of the format: ids per word of each selector.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
BLOCK_IDS = 1 << 18
#: Characters encoded in one call, unless a single text is longer.
CALL_CHARS = 1 << 17
SCHEMA = "part int, block int, doc_ids array<bigint>, offsets array<bigint>, n_ids bigint, words binary"


def pack(ids: np.ndarray) -> bytes:
    """Greedy packing: each word takes the most ids that fit."""
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    if n == 0:
        return b""
    place = np.arange(n)
    choice = np.full(n, ESCAPE, dtype=np.int64)
    step = np.ones(n, dtype=np.int64)
    for s in range(len(COUNTS) - 1, -1, -1):
        wide = np.where(ids >> np.uint64(60 // COUNTS[s]) != 0, place, n + 64)
        stop = np.minimum.accumulate(wide[::-1])[::-1]
        fits = stop - place >= np.minimum(COUNTS[s], n - place)
        choice[fits], step[fits] = s, COUNTS[s]
    heads, i, jump = [], 0, step.tolist()
    while i < n:
        heads.append(i)
        i += jump[i]
    heads = np.asarray(heads)
    sel = choice[heads]
    at = np.concatenate([[0], np.cumsum(1 + (sel == ESCAPE))])
    words = np.zeros(at[-1], dtype="<u8")
    at = at[:-1]
    padded = np.concatenate([ids, np.zeros(64, dtype=np.uint64)])
    for s in np.unique(sel):
        mine = sel == s
        h, a = heads[mine], at[mine]
        if s == ESCAPE:
            words[a], words[a + 1] = np.uint64(ESCAPE << 60), ids[h]
            continue
        width = 60 // COUNTS[s]
        word = np.full(len(h), int(s) << 60, dtype=np.uint64)
        for k in range(COUNTS[s]):
            word |= padded[h + k] << np.uint64(k * width)
        words[a] = word
    return words.tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    words = np.frombuffer(data, dtype="<u8")
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    if (sel == ESCAPE).any():
        # a word after an escape is raw, whatever its top bits say
        at = 0
        marks = np.flatnonzero(sel == ESCAPE)
        for m in marks.tolist():
            if m >= at:
                raw[m + 1] = True
                at = m + 2
    size = np.asarray([*COUNTS, 1, 0])[sel]
    size[raw] = 1
    start = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(start[-1], dtype=np.uint64)
    out[start[:-1][raw]] = words[raw]
    for s in np.unique(sel[~raw]):
        if s == ESCAPE:
            continue
        a = np.flatnonzero((sel == s) & ~raw)
        width = 60 // COUNTS[s]
        for k in range(COUNTS[s]):
            out[start[a] + k] = (words[a] >> np.uint64(k * width)) & np.uint64((1 << width) - 1)
    return out[:n]


def write_ids(docs: DataFrame, tokenizer: str, target: str, end_id: int) -> None:
    """Encode whole texts and write the blocks in order of doc_id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from tokenizers import Tokenizer

        # a task is one core: the threads of the library would only add memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = Tokenizer.from_file(tokenizer)
        tok.no_padding()
        tok.no_truncation()
        part, block = TaskContext.get().partitionId(), 0
        keys, held, size = [], [], 0

        def flush():
            offsets = np.cumsum([0, *map(len, held)])
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([keys], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64())),
                pa.array([offsets[-1]], pa.int64()), pa.array([pack(np.concatenate(held))], pa.binary())], ["part", "block", "doc_ids", "offsets", "n_ids", "words"])

        for b in batches:
            for ids, texts in calls(b):
                # no offsets are asked for, and the library's own rows are dropped with the call
                for key, e in zip(ids, tok.encode_batch_fast(texts, add_special_tokens=False)):
                    keys.append(key)
                    held.append(np.array([*e.ids, end_id], dtype=np.uint32))
                    size += len(held[-1])
                    if size >= BLOCK_IDS:
                        yield flush()
                        keys, held, size, block = [], [], 0, block + 1
        if held:
            yield flush()

    parts = max(1, docs.sparkSession.sparkContext.defaultParallelism * 4)
    order = ["doc_id", "tie"]
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered.select("doc_id", "text").mapInArrow(run, SCHEMA).write.parquet(target)


def calls(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    """Ids and texts of a batch in runs of about CALL_CHARS characters."""
    ids, texts, chars = [], [], 0
    for key, text in zip(batch.column(0), batch.column(1)):
        ids.append(key.as_py())
        texts.append(text.as_py() or "")
        chars += len(texts[-1])
        if chars >= CALL_CHARS:
            yield ids, texts
            ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


def read_ids(spark, source: str) -> DataFrame:
    """part, block, nth, doc_id, start, ids checksum and count of each document in a file.

    `start` is the sum of all blocks before (one small row each, summed per part first) and the
    document's place in its block.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, block, keys, offsets, n, words in zip(*b.columns):
                ids = unpack(words.as_py(), n.as_py()).astype("<u4")
                cut = offsets.values.to_numpy()
                many = len(cut) - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([part.as_py()] * many, pa.int32()), pa.array([block.as_py()] * many, pa.int32()), keys.values, pa.array(cut[:-1]), pa.array(np.diff(cut)),
                    pa.array([zlib.crc32(ids[a:e]) for a, e in zip(cut, cut[1:])], pa.int64())], ["part", "block", "doc_id", "place", "n_tokens", "ids_crc32"])

    blocks = spark.read.schema(SCHEMA).parquet(source)
    rows = blocks.select("part", "block", "doc_ids", "offsets", "n_ids", "words").mapInArrow(run, "part int, block int, doc_id bigint, place bigint, n_tokens bigint, ids_crc32 bigint")
    sizes = blocks.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # as many rows as the file has parts
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    inside = sizes.select("part", "block", (F.sum("n_ids").over(W.partitionBy("part").orderBy("block")) - F.col("n_ids")).alias("inside"))
    out = rows.join(inside.join(before, "part"), ["part", "block"])
    return out.select("doc_id", (F.col("before") + F.col("inside") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def shared_folder(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/ids-{uuid.uuid4().hex}"


def stored(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write, then read back."""
    spark = docs.sparkSession
    target = shared_folder(spark)
    write_ids(docs, tokenizer, target, end_id)
    return read_ids(spark, target)
