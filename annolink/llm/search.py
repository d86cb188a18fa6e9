"""Ranked lexical search by MaxScore with bounds for pairs of terms.

1. Forward rows: the asked terms of each document with their counts, and the document's number of terms. Texts are
   read once. Documents and terms are counted on these rows.
2. Index. Each task cuts its documents into segments and writes, for each segment, one list for each asked term
   (places, impacts), and one intersection list for each asked pair (places of documents that hold both, joint
   impacts). Pairs are neighbours among a query's terms in order of weight whose expected intersection is at most
   1 / PAIR_SHARE of the documents. Each task also keeps the k best values of every term and pair that it has met.
3. Thresholds. The k-th best value of a term or a pair over all documents is reached by k documents, so a query's
   k-th best score is no less than the largest of them.
4. Search, segment by segment. A term adds at most its largest impact there. A pair adds at most its largest joint
   impact or, in documents without both, the larger of the two; often much less than their sum. The bound of the
   first i terms is the best combination of single terms and disjoint neighbouring pairs. Terms whose common bound is
   below the threshold are not essential: documents with no other term are skipped unread, and the candidates from
   the other lists are dropped as soon as score and bound of what is left fall below the threshold.

Scores are exact 64-bit integers; skipping is strict, so equal scores are never lost. Null and empty texts have no
terms, match nothing and do not count as documents; nor do queries without terms. Rows of one document id, or with a
null id, are ranked by themselves; a null id comes after all others of the same score. Each query row is ranked by
itself. Only the id and text columns are read. Queries are taken in blocks of about MAX_TERMS terms, so that what tasks are sent
is bounded; each block reads the documents again.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .near import kept_table, lists, pieces
from .text import ITEM_WORD

MAX_TERMS = 200_000
SEGMENT, POSTINGS = 8192, 1_000_000
PAIR_SHARE = 256
IDS, TERM, PAIR, BEST_TERM, BEST_PAIR = range(5)
#: Lower-cases A-Z; all other ASCII characters but letters and digits become spaces.
FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).translate(bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


@dataclass
class Queries:
    """Terms and pairs of a block of queries, by number. A pair is ((term, times), (term, times))."""

    ids: list
    counts: list[Counter]
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    #: for each query (term, times) in order of what they can add, and the number of the pair with the next, or -1
    order: list[list[tuple[int, int]]] = field(default_factory=list)
    neighbours: list[list[int]] = field(default_factory=list)
    pairs: dict[tuple, int] = field(default_factory=dict)

    def __post_init__(self):
        for c in self.counts:
            for t in c:
                self.vocabulary.setdefault(t, len(self.vocabulary))

    def plan(self, n_docs: int, df: np.ndarray, weight: np.ndarray) -> None:
        for c in self.counts:
            own = sorted(((self.vocabulary[t], times) for t, times in c.items() if df[self.vocabulary[t]]), key=lambda x: (x[1] * int(weight[x[0]]), x))
            near = [-1] * len(own)
            for i in range(len(own) - 1):
                if PAIR_SHARE * int(df[own[i][0]]) * int(df[own[i + 1][0]]) <= n_docs * n_docs:
                    near[i] = self.pairs.setdefault((own[i], own[i + 1]), len(self.pairs))
            self.order.append(own)
            self.neighbours.append(near)


def forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), terms and tf (those asked for); documents without terms are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        number = shared.value.get
        for b in pieces(batches):
            at, n, terms, tf = [], [], [], []
            for i, text in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                w = terms_of(text)
                if w:
                    c = Counter(map(number, w))
                    c.pop(None, None)
                    at.append(i)
                    n.append(len(w))
                    terms.append(np.fromiter(c.keys(), np.int32, len(c)))
                    tf.append(np.fromiter(c.values(), np.int64, len(c)))
            columns = [b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), lists(terms).cast(pa.list_(pa.int32())), lists(tf).cast(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tf"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tf array<bigint>")


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)


class Best:
    """The k largest values of every key, 0 where there are fewer."""

    def __init__(self, keys: int, k: int):
        self.top = np.zeros((keys, k), dtype=np.int64)

    def add(self, key: int, values: np.ndarray) -> None:
        k = self.top.shape[1]
        both = np.concatenate([self.top[key], values])
        self.top[key] = np.partition(both, len(both) - k)[len(both) - k:]


def index_rows(segment: int, kind: int, keys: np.ndarray, docs: list[np.ndarray] | None, scores: pa.Array) -> pa.RecordBatch:
    none = pa.nulls(len(keys), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(keys), segment, dtype=np.int64)), pa.array(np.full(len(keys), kind, dtype=np.int32)), pa.array(np.asarray(keys, dtype=np.int32)),
         none if docs is None else lists(docs).cast(pa.list_(pa.int32())), scores], names=["segment", "kind", "key", "docs", "scores"])


def in_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in groups of at most SEGMENT documents and about POSTINGS postings."""
    held, n, postings = [], 0, 0
    for b in pieces(batches, 64):
        held.append(b)
        n, postings = n + b.num_rows, postings + len(b.column("terms").flatten())
        if n >= SEGMENT or postings >= POSTINGS:
            yield pa.Table.from_batches(held)
            held, n, postings = [], 0, 0
    if n:
        yield pa.Table.from_batches(held)


def index(rows: DataFrame, queries: Queries, weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """segment, kind, key, docs (places in the segment), scores: the ids of a segment, term lists, pair lists, and for each task the best values of each."""
    shared = rows.sparkSession.sparkContext.broadcast((list(queries.pairs), weight))

    def run(batches):
        pairs, weight = shared.value
        best = {TERM: Best(len(weight), k), PAIR: Best(len(pairs), k)}
        part, number = TaskContext.get().partitionId(), 0
        for t in in_segments(batches):
            t = t.combine_chunks()
            segment = (part << 32) + number
            number += 1
            terms, tf = (t.column(c).combine_chunks() for c in ("terms", "tf"))
            sizes = np.diff(terms.offsets.to_numpy())
            doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            terms, tf = terms.flatten().to_numpy(), tf.flatten().to_numpy()
            m = 75 + 25 * t.column("n").to_numpy() * n_docs // n_terms
            score = weight[terms] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
            by = np.argsort(terms, kind="stable")
            terms, doc, score = terms[by], doc[by], score[by]
            cut = np.flatnonzero(np.diff(terms, prepend=-1))
            own = {int(terms[a]): (doc[a:z], score[a:z]) for a, z in zip(cut, [*cut[1:], len(terms)])}
            ids = t.column("doc_id").combine_chunks()
            yield index_rows(segment, IDS, np.zeros(1), None, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids))
            for key, (_, s) in own.items():
                best[TERM].add(key, s)
            yield index_rows(segment, TERM, np.array(list(own)), [d for d, _ in own.values()], lists([s for _, s in own.values()]))
            met, docs, scores = [], [], []
            for key, ((a, times), (b, more)) in enumerate(pairs):
                if a in own and b in own:
                    both, at, also = np.intersect1d(own[a][0], own[b][0], assume_unique=True, return_indices=True)
                    if len(both):
                        joint = times * own[a][1][at] + more * own[b][1][also]
                        best[PAIR].add(key, joint)
                        met, docs, scores = [*met, key], [*docs, both], [*scores, joint]
            yield index_rows(segment, PAIR, np.array(met), docs, lists(scores))
        for kind, of in ((BEST_TERM, TERM), (BEST_PAIR, PAIR)):
            top = best[of].top
            some = np.flatnonzero(top.max(axis=1, initial=0))
            yield index_rows(-1, kind, some, None, lists(list(top[some])))

    return rows.mapInArrow(run, "segment bigint, kind int, key int, docs array<int>, scores array<bigint>")


def thresholds(lists_: DataFrame, queries: Queries, k: int) -> np.ndarray:
    """For each query a score that k documents reach, or 0."""
    each = lists_.where(F.col("kind").isin(BEST_TERM, BEST_PAIR)).select("kind", "key", F.explode("scores").alias("s")).where("s > 0")
    w = W.partitionBy("kind", "key").orderBy(F.col("s").desc())
    kth = each.withColumn("at", F.row_number().over(w)).where(F.col("at") <= k).where(F.col("at") == k).select("kind", "key", "s").toPandas()
    value = {(int(a), int(b)): int(s) for a, b, s in zip(kth["kind"], kth["key"], kth["s"])}
    return np.array([max([0, *(times * value.get((BEST_TERM, t), 0) for t, times in own), *(value.get((BEST_PAIR, p), 0) for p in near)])
                     for own, near in zip(queries.order, queries.neighbours)], dtype=np.int64)


def prefix_bounds(most: list[int], joint: list[int | None]) -> list[int]:
    """Bound of the first i terms: single terms and disjoint neighbouring pairs in their best combination.

    joint[i] is the largest joint value of terms i and i + 1, or None where the pair has no list.
    """
    out = [0]
    for i, v in enumerate(most):
        bound = out[i] + v
        if i and joint[i - 1] is not None:
            bound = min(bound, out[i - 1] + max(most[i - 1], v, joint[i - 1]))
        out.append(bound)
    return out


def best_documents(own: list[tuple[int, np.ndarray, np.ndarray]], bounds: list[int], floor: int, k: int, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of documents that can be among the k best, and the least score that counts; exact scores are left in `score` at these places.

    own: times, places, impacts of each term. score: zeros, one for each document of the segment.
    """
    floor = max(floor, 1)
    essential = max(i for i, b in enumerate(bounds) if b < floor)
    for times, docs, impacts in own[essential:]:
        score[docs] += times * impacts
    at = np.flatnonzero(score)
    for i in range(essential - 1, -1, -1):
        if len(at) > k:
            floor = max(floor, int(np.partition(score[at], len(at) - k)[len(at) - k]))
        at = at[score[at] + bounds[i + 1] >= floor]
        if not len(at):
            break
        times, docs, impacts = own[i]
        place = np.minimum(np.searchsorted(docs, at), len(docs) - 1)
        hit = docs[place] == at
        score[at[hit]] += times * impacts[place[hit]]
    if len(at) > k:
        floor = max(floor, int(np.partition(score[at], len(at) - k)[len(at) - k]))
    return at[score[at] >= floor], floor


def found(lists_: DataFrame, queries: Queries, floors: np.ndarray, k: int) -> DataFrame:
    """query, doc_id, score: what each segment has for the k best of each query."""
    shared = lists_.sparkSession.sparkContext.broadcast((queries.order, queries.neighbours, floors))

    def run(rows: pa.Table) -> pa.Table:
        order, neighbours, floors = shared.value
        terms, joint, ids = {}, {}, None
        kinds, keys = rows.column("kind").to_pylist(), rows.column("key").to_pylist()
        docs, scores = rows.column("docs").combine_chunks(), rows.column("scores").combine_chunks()
        for i, (kind, key) in enumerate(zip(kinds, keys)):
            if kind == IDS:
                ids = scores[i].values
            elif kind == TERM:
                terms[key] = (docs[i].values.to_numpy(), scores[i].values.to_numpy())
            else:
                joint[key] = int(scores[i].values.to_numpy().max())
        most = {t: int(s.max()) for t, (_, s) in terms.items()}
        last = ids.is_null().to_numpy(zero_copy_only=False)
        id_order = ids.fill_null(0).to_numpy()
        out = {"query": [], "place": [], "score": []}
        for q, (own, near) in enumerate(zip(order, neighbours)):
            there = [i for i, (t, _) in enumerate(own) if t in terms]
            if not there:
                continue
            # a pair whose second term is missing here leaves the first one alone
            pair = [joint.get(near[i], 0) if j == i + 1 and near[i] >= 0 else None for i, j in zip(there, there[1:])]
            bounds = prefix_bounds([own[i][1] * most[own[i][0]] for i in there], pair)
            if bounds[-1] < max(1, floors[q]):
                continue
            score = np.zeros(len(ids), dtype=np.int64)
            at, _ = best_documents([(own[i][1], *terms[own[i][0]]) for i in there], bounds, int(floors[q]), k, score)
            at = at[np.lexsort((id_order[at], last[at], -score[at]))[:k]]
            out["query"].append(np.full(len(at), q))
            out["place"].append(at)
            out["score"].append(score[at])
        flat = {c: np.concatenate([np.zeros(0, dtype=np.int64), *v]) for c, v in out.items()}
        return pa.table({"query": pa.array(flat["query"], pa.int32()), "doc_id": ids.take(pa.array(flat["place"])), "score": pa.array(flat["score"], pa.int64())})

    segments = lists_.where(F.col("kind").isin(IDS, TERM, PAIR))
    return segments.groupBy("segment").applyInArrow(run, "query int, doc_id bigint, score bigint")


def answers(docs: DataFrame, queries: Queries, k: int) -> DataFrame | None:
    """query, rank, doc_id, score for one block of queries."""
    rows = kept_table(forward(docs, queries.vocabulary))
    total = rows.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    if not total.n:
        return None
    got = rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toPandas()
    df = np.zeros(len(queries.vocabulary), dtype=np.int64)
    df[got["t"].to_numpy(dtype=np.int64)] = got["df"].to_numpy()
    weight = weights(total.n, df)
    queries.plan(total.n, df, weight)
    table = kept_table(index(rows, queries, weight, total.n, total.l, k))
    best = found(table, queries, thresholds(table, queries, k), k)
    w = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, those with a score above 0."""
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    asked = items.select("item_id", "text", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(ITEM_WORD)).alias("n"))
    blocks = max(1, math.ceil((asked.agg(F.sum("n")).first()[0] or 0) / MAX_TERMS))
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for block in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).select("item_id", "text").collect()
        counts = [(r.item_id, Counter(terms_of(r.text.encode()))) for r in got if r.text]
        counts = [x for x in counts if x[1]]
        best = answers(docs, Queries([i for i, _ in counts], [c for _, c in counts]), k) if counts else None
        if best is not None:
            names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(counts)], f"query int, item_id {kind}")
            out = out.unionByName(best.join(names, "query").select("item_id", "rank", "doc_id", "score"))
    return out
