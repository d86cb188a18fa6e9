"""Delimited text against Python's csv module, with one file cut into many splits."""

import csv
import io
import random

import pytest

from annolink.sources import delimited
from annolink.sources import files as SF


@pytest.fixture
def small_splits(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


def messy(seed, n, sep, newline):
    """Well-formed and odd records: quotes inside fields, text after a closing quote, doubled quotes, line breaks."""
    rnd = random.Random(seed)
    parts = ["a", "b c", '""', "\n", sep, "é", '"" ""', "\n\n", "x" * 40, ""]

    def one():
        k = rnd.random()
        if k < 0.45:
            return '"' + "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 5))) + '"' + rnd.choice(["", "", "", "tail", ' "t'])
        return rnd.choice(["", "plain", "5'4\"", 'in"side"', " lead", "12.5"])
    rows = [sep.join([str(i), *[one() for _ in range(rnd.randint(1, 4))]]) for i in range(n)]
    for i in range(0, n, 17):
        rows[i] += "\n"
    return "\n".join([sep.join(["id", '"p, q"', "r", "r"]), *rows, ""]).replace("\n", newline)


def plain(text, sep):
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r]


@pytest.mark.parametrize("sep,newline", [(",", "\n"), (";", "\r\n"), ("|", "\n"), ("\t", "\n")])
def test_records_equal_the_csv_module(spark, small_splits, tmp_path, sep, newline):
    want = {}
    for seed in range(3):
        text = messy(seed, 400, sep, newline)
        (tmp_path / f"f{seed}.csv").write_bytes(("﻿" * (seed == 1) + text).encode())
        want[f"f{seed}.csv"] = plain(text, sep)
    lines = delimited.read_lines(spark, str(tmp_path))
    assert lines.select("file", "block").distinct().count() > 30
    got = {}
    from pyspark.sql import functions as F

    for r in delimited.records(lines, sep).select("name", "row", F.transform(delimited.raw_fields(F.col("record"), sep), delimited.unquoted).alias("f")).collect():
        got.setdefault(r.name, {})[r.row] = r.f
    assert got == {name: dict(enumerate(rows, 1)) for name, rows in want.items()}


def test_very_long_fields_and_an_open_quote(spark, tmp_path):
    long = '"' + 'x""y\n' * 50_000 + '"'
    (tmp_path / "a.csv").write_text(f"k,v\n1,{long}\n2,end\n")
    (tmp_path / "b.csv").write_text('k,v\n1,"never closed\n2,end\n\n3,x')
    d = {(r.source_file, r.source_row): (r.k, r.v) for r in SF.read_heterogeneous_csv(spark, [str(tmp_path / f"{c}.csv") for c in "ab"]).collect()}
    assert d == {("a.csv", 2): ("1", 'x"y\n' * 50_000), ("a.csv", 3): ("2", "end"), ("b.csv", 2): ("1", "never closed\n2,end\n\n3,x")}


def test_positions_headers_and_types(spark, small_splits, tmp_path):
    (tmp_path / "s.csv").write_text('﻿"a";b ;b;note_id\n1;"x\ny";60;9\n\n  \n2;"p;q";nine;9\n3\n' + "".join(f'{i};"l\n\n{i}";{i}\n' for i in range(4, 400)))
    got = SF.read_positional_csv(spark, str(tmp_path / "s.csv"), "note_id long, a int, b int, c string").orderBy("note_id").collect()
    assert [(r.score_id, r.note_id, r.a, r.b, r.c) for r in got] == [("s", 0, 1, 60, None), ("s", 1, None, None, None), ("s", 2, 2, None, None), ("s", 3, 3, None, None)] + [("s", i, i, i, None) for i in range(4, 400)]
    (tmp_path / "h.csv").write_text('id,"comment, free",v\n1,"two\nlines",9\n')
    (tmp_path / "g.csv").write_text("v,id\n7,2,surplus\n8\n")
    rows = SF.read_heterogeneous_csv(spark, [str(tmp_path / "h.csv"), str(tmp_path / "g.csv")]).collect()
    assert sorted((r.source_file, r.source_row, r.id, r["comment, free"], r.v) for r in rows) == [("g.csv", 2, "2", None, "7"), ("g.csv", 3, None, None, "8"), ("h.csv", 2, "1", "two\nlines", "9")]
    t = SF.read_table(spark, str(tmp_path / "h.csv"), "v int, id string, absent double").collect()
    assert [(r.v, r.id, r.absent) for r in t] == [(9, "1", None)]
    (tmp_path / "empty.csv").write_text("")
    assert SF.read_table(spark, str(tmp_path / "empty.csv"), "v int").collect() == [] and SF.read_heterogeneous_csv(spark, [str(tmp_path / "empty.csv")]).columns == ["source_file", "source_row"]
    with pytest.raises(ValueError):
        delimited.records(delimited.read_lines(spark, str(tmp_path / "g.csv")), "::")
