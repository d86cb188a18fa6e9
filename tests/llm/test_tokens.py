"""Byte-level BPE and token counts against the library, over all code points and odd ids."""

import hashlib

import numpy as np
import pytest

from annolink.llm import bpe, chars, counts
from annolink.llm.queries import tokenizer

PATH = tokenizer("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_code_points_of_every_range(library):
    """The ends of every range of one class and of every range of odd characters, and each 40th code point."""
    v = bpe.vocabulary(PATH)
    table = v.classes.table()
    ends = {p + i for p in [*v.classes.first, *(x for r in v.classes.odd for x in r)] for i in (-1, 0, 1)}
    points = [p for p in sorted(ends | set(range(0, chars.POINTS, 40))) if 0 <= p < chars.POINTS and not chars.SURROGATES[0] <= p < chars.SURROGATES[1]]
    for first in range(0, len(points), 4000):
        text = "".join(f"a{c}b {c}1{c}  {c}'s." for c in map(chr, points[first:first + 4000]))
        ids = library.encode(text, add_special_tokens=False).ids
        assert v.encode(text) == ids and counts.count(text, v, table) == len(ids)


def test_odd_characters_are_met(library):
    v = bpe.vocabulary(PATH)
    odd = [chr(a) for a, _ in v.classes.odd]
    assert odd and all(v.is_odd(f"plain {c} text") for c in odd) and not v.is_odd("plain é “text” 中文 ͸")
    for c in odd:
        text = f"x{c} {c}{c}7 and more"
        assert v.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_ids_stay_exact_beside_nulls(spark, library):
    rows = [(None, "a b"), (2**53 + 1, "c"), (2**53 + 3, None), (5, "x"), (5, "x y"), (None, None)]
    df = spark.createDataFrame([(k, t, 0, "z") for k, t in rows], "doc_id bigint, text string, n_tokens int, key string").repartition(1)
    want = sorted((str(k), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens) for r in bpe.digest(df, PATH).collect()) == want
    assert sorted((str(r.doc_id), r.n_tokens) for r in counts.token_counts(df, PATH).collect()) == want
    got = bpe.encode(df, PATH).collect()
    assert sorted((str(r.doc_id), len(r.ids)) for r in got) == want and {r.decoded for r in got} == {"a b", "c", "", "x", "x y"}
    whole = {r.doc_id: r.ids_sha256 for r in bpe.digest(df, PATH).where("doc_id > 6").collect()}
    assert whole[2**53 + 1] == hashlib.sha256(np.asarray(library.encode("c").ids, dtype="<u4").tobytes()).hexdigest()
    assert bpe.digest(df.where("false"), PATH).collect() == [] and counts.token_counts(df.where("false"), PATH).collect() == []
