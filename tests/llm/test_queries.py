"""Each query against a brute-force version on a small table with edge rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from annolink.llm import idfile, queries
from annolink.llm.idfile import pack, unpack
from annolink.llm.licences import BASE
from annolink.llm.queries import QUERIES, tokenizer

ITEM, SPACE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SRC = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("llm"))
    docs = spark.read.parquet(f"{SRC}/documents.parquet")
    top = 10_000_000
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    extra = [(top, None, None, None, None), (top + 1, "", "en", "src0", 0), (top + 2, long, "en", "src0", len(long)), (top + 3, long + " end", "en", "src0", len(long) + 4),
             (top + 4, "under the MIT license, under the mit license\nCC BY-NC 4.0 <|endoftext|> it's", "en", "src1", 60), (top + 5, " \n\t ", "en", "src1", 4),
             (top + 6, "one two", "en", "src1", 7), (top + 7, "ONE\x0btwo", "en", "src1", 7), (top + 8, "x" * 5000, "en", "src1", 5000)]
    docs.unionByName(spark.createDataFrame(extra, docs.schema)).write.parquet(f"{d}/documents.parquet")
    items = spark.read.parquet(f"{SRC}/benchmark.parquet")
    items.unionByName(spark.createDataFrame([(900, None), (901, "..."), (902, "one TWO"), (903, "w5 w6 w7")], items.schema)).write.parquet(f"{d}/benchmark.parquet")
    spark.read.parquet(f"{SRC}/labels.parquet").write.parquet(f"{d}/labels.parquet")
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    return d, rows, [(r.item_id, r.text or "") for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]


def result(spark, data, name):
    out = QUERIES[name](spark, data[0]).collect()
    assert len(out) == len(data[1])
    return {r.doc_id: r for r in out}


def test_licence_scan(spark, data):
    got = result(spark, data, "op2_licence_scan")
    for k, text in data[1].items():
        w = ITEM.findall(text.translate(LOWER))
        hit = [(i, label) for p, label in BASE for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        r = got[k]
        assert (r.n_words, r.n_base) == (len(w), len(hit))
        assert r.base_labels == ",".join(sorted({x for _, x in hit}))
        assert (r.first_word, r.last_word) == ((min(hit)[0], max(hit)[0]) if hit else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_simple8b_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 61, 5000):
        for top in (1, 2, 50_000, 1 << 40, 1 << 63):
            ids = rng.integers(0, top, n, dtype=np.uint64)
            assert (unpack(pack(ids), n) == ids).all()


def test_id_files(spark, data):
    from tokenizers import Tokenizer

    tok, at, got = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), 0, result(spark, data, "op3_simple8b")
    for k in sorted(data[1]):
        ids = [*tok.encode(data[1][k], add_special_tokens=False).ids, 2]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), zlib.crc32(np.asarray(ids, dtype="<u4").tobytes()))
        at += len(ids)


def test_counts_and_bpe(spark, data):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    five, ten = result(spark, data, "op5_token_counts"), result(spark, data, "op10_bpe")
    for k, text in data[1].items():
        ids = tok.encode(text, add_special_tokens=False).ids
        assert (five[k].n_bytes, five[k].n_tokens, five[k].over_limit) == (len(text.encode()), len(ids), len(ids) > 512)
        assert (ten[k].n_tokens, ten[k].ids_sha256) == (len(ids), hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest())
        assert ten[k].decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_decontamination(spark, data):
    got, wins = result(spark, data, "op6_decontamination"), defaultdict(set)
    for item, text in data[2]:
        w = ITEM.findall(text.translate(LOWER))
        for i in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[i:i + 10])].add(item)
    for k, text in data[1].items():
        w, hit, items = ITEM.findall(text.translate(LOWER)), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in wins:
                    hit |= set(range(i, i + n))
                    items |= wins[tuple(w[i:i + n])]
        sha = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        assert (got[k].n_words, got[k].n_hit, got[k].n_items, got[k].items_sha256, got[k].contaminated) == (len(w), len(hit), len(items), sha, bool(hit))


def test_line_frequency(spark, data):
    got = result(spark, data, "op7_line_frequency")
    for k, text in data[1].items():
        w = SPACE.findall(text)
        lines = [x for x in text.split("\n") if SPACE.search(x)]
        seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        rep = {j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep))
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_common_lines(spark):
    from annolink.llm.lines import clean, verdicts

    body = " ".join(f"b{i}" for i in range(60))
    rows = [(i, f"{body} {i}x\nSubscribe now {i}", "h", 1) for i in range(9)] + [(9, "only\n" + " ".join(f"c{i} 7" for i in range(40)), "h", 1)]
    rows[1:9] = [(i, "".join(f"q{chr(97 + i)}{j} " for j in range(60)) + f"\nsubscribe NOW {i}", "h", 1) for i in range(1, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, docs int")
    texts = {r.doc_id: r.text for r in clean(docs, max_docs=5).collect()}
    assert len(texts) == 10 and "Subscribe" in texts[0] and "subscribe" not in texts[3].lower()
    assert verdicts(docs.limit(0)).count() == 0 and clean(docs.limit(0)).columns == docs.columns


def test_copies_of_a_common_line_deplete(spark):
    from annolink.llm.lines import clean, verdicts

    def own(k, n):
        return " ".join(f"o{'abcdefghijklmnop'[k]}{'x' * i}" for i in range(n))
    line, rest = " ".join(f"c{'y' * i}" for i in range(9)), "\n".join(" ".join(f"r{'z' * (9 * j + i)}" for i in range(9)) for j in range(5))
    rows = [(k, own(k, 300) + "\n" + line + "\n" + rest, "h") for k in range(8)] + [(9, own(9, 10) + f"\n{line}" * 5 + "\n" + rest, "h")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in verdicts(docs, max_docs=5).collect()}
    assert (got[9].n_words, got[9].removed_words, got[9].base_failed, got[9].kept) == (100, 90, False, False)
    assert got[0].removed_words == 0 and got[1].removed_words == 54 and got[1].kept
    # rows of one id are one document: six rows, two ids
    same = spark.createDataFrame([(k % 2, own(k, 60) + "\nshared line", "h") for k in range(6)], docs.schema)
    assert all(r.removed_words == 0 for r in verdicts(same, max_docs=5).collect()) and clean(same, max_docs=5).count() == 6


def unique_words(k, n):
    return " ".join(f"u{'abcdefghijklmnopqrstuvwxyz'[k]}{'x' * i}" for i in range(n))


def test_a_copy_of_a_common_line_stays(spark):
    from annolink.llm.lines import clean

    def left(rows):
        out = clean(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), max_docs=3).collect()
        return {r.doc_id: r.text for r in out}
    line = "subscribe to our letter"
    # the first holder fails the base rules
    rows = [(0, line, "h")] + [(k, unique_words(k, 60) + "\n" + line, "h") for k in range(1, 7)]
    got = left(rows)
    assert sorted(got) == [1, 2, 3, 4, 5, 6] and [k for k in got if line in got[k]] == [1]
    # the first holder of `line` is depleted by the lines that row 0 holds: the first that stays takes over
    big = unique_words(25, 100)
    got = left([(0, unique_words(0, 90) + "\n" + big, "h"), (1, big + "\n" + line, "h")] + [(k, unique_words(k, 120) + "\n" + big + "\n" + line, "h") for k in range(2, 6)])
    assert sorted(got) == [0, 2, 3, 4, 5] and [k for k in got if line in got[k]] == [2] and [k for k in got if big in got[k]] == [0]
    # all holders are depleted: the first stays whole
    got = left([(0, unique_words(0, 90) + "\n" + big, "h")] + [(k, big + "\n" + line, "h") for k in range(1, 6)])
    assert got == {0: unique_words(0, 90) + "\n" + big, 1: big + "\n" + line}


def test_minhash(spark, data):
    got, sets = result(spark, data, "op9_minhash"), {}
    for k, text in data[1].items():
        w = SPACE.findall(text.translate(LOWER))
        sets[k] = {tuple(w[i:i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())
    keys, root = sorted(sets), {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for k in keys:
        assert (got[k].n_shingles, got[k].component_id, got[k].kept) == (len(sets[k]), find(k), find(k) == k)


def test_empty_tables(spark, data, tmp_path):
    d = str(tmp_path)
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{data[0]}/{name}.parquet").limit(0).write.parquet(f"{d}/{name}.parquet")
    spark.read.parquet(f"{SRC}/embeddings.parquet").limit(0).write.parquet(f"{d}/embeddings.parquet")
    for name, fn in queries.QUERIES.items():
        assert fn(spark, d).count() == 0, name


def test_id_files_with_null_and_repeated_ids(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    big = 2 ** 53 + 1
    rows = [(None, "a b"), (None, None), (5, "x y z"), (5, "x"), (5, "x"), (big, "long " * 50_000), (big + 1, "")]
    got = idfile.stored(spark.createDataFrame(rows, "doc_id bigint, text string"), queries.tokenizer("word_bpe_49k.json")).collect()
    count = [len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows]
    assert sorted(((r.doc_id or 0), r.n_tokens) for r in got) == sorted(((k or 0), n) for (k, _), n in zip(rows, count))
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, None, 5, 5, 5, big, big + 1]
