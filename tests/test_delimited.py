from __future__ import annotations

import csv
import io
import random

import pytest

from plumbline.sources import delimited
from plumbline.sources.readers import read_dataset, read_delimited, spans_lines


@pytest.fixture
def small_splits(spark):
    """Splits of a few dozen bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "48", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _rows(n, seed, breaks=True):
    rng = random.Random(seed)
    texts = ["plain", 'say ""hi""'.replace('""', '"'), "a, b", "é漢🙂", "", "x" * 70, *(["one\ntwo", "\n", 'q"\n"r', "a\nb\nc\n\nd" * 5, "\r\nx"] if breaks else [])]
    return [(str(k), rng.choice(texts), str(rng.random()), rng.choice(texts)) for k in range(n)]


def _written(path, rows, ends="\n", header=("id", "text", "share", "more")):
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator=ends)
    w.writerow(header)
    w.writerows(rows)
    path.write_bytes(out.getvalue().encode())


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", [1, 2])
def test_line_breaks_in_cells_across_splits(spark, tmp_path, small_splits, ends, seed):
    rows = _rows(60, seed)
    _written(tmp_path / "t.csv", rows, ends)
    assert delimited.lines_of(spark, str(tmp_path / "t.csv")).rdd.getNumPartitions() > 20
    df = read_dataset(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"id": "bigint", "text": "string", "share": "double", "more": "string"}
    got = sorted((r.id, r.text, r.share, r.more) for r in df.collect())
    assert got == sorted((int(a), b or None, float(c), d or None) for a, b, c, d in rows)


def test_a_header_over_lines_and_several_files(spark, tmp_path, small_splits):
    parts = [_rows(20, 3), _rows(20, 4), []]
    (tmp_path / "d").mkdir()
    for k, rows in enumerate(parts):
        _written(tmp_path / "d" / f"{k}.csv", rows, header=("id", "the\ntext", "share", "more"))
    df = read_delimited(spark, str(tmp_path / "d"))
    assert df.columns == ["id", "the\ntext", "share", "more"] and df.count() == 40
    assert sorted(r[1] or "" for r in df.collect()) == sorted(r[1] for p in parts for r in p)


def test_without_line_breaks_types_are_told_by_the_first_pass(spark, tmp_path, small_splits):
    rows = _rows(50, 5, breaks=False)
    _written(tmp_path / "t.csv", rows)
    assert not spans_lines(spark, str(tmp_path / "t.csv"))
    df = read_dataset(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes)["id"] == "bigint" and sorted(r.id for r in df.collect()) == list(range(50))
    given = read_delimited(spark, str(tmp_path / "t.csv"), schema="id int, text string, share float, more string")
    assert dict(given.dtypes) == {"id": "int", "text": "string", "share": "float", "more": "string"} and given.count() == 50


def test_an_open_quote_keeps_the_rest_of_its_file(spark, tmp_path, small_splits):
    (tmp_path / "t.csv").write_text('id,text\n1,a\n2,"open\n' + "".join(f"{k},row\n" for k in range(3, 40)))
    got = {r.id: r.text for r in read_dataset(spark, str(tmp_path / "t.csv")).collect()}
    assert got[1] == "a" and set(got) == {1, 2} and got[2].count("row") == 37
    (tmp_path / "e.csv").write_text("id,text\n")
    assert read_dataset(spark, str(tmp_path / "e.csv")).count() == 0
    (tmp_path / "l.csv").write_text('a\n"1\n2"\n')  # the last record has no split after it
    assert [r.a for r in read_dataset(spark, str(tmp_path / "l.csv")).collect()] == ["1\n2"]


def test_line_breaks_with_a_schema(spark, tmp_path, small_splits):
    rows = _rows(30, 6)
    _written(tmp_path / "t.tsv", rows)
    df = read_delimited(spark, str(tmp_path / "t.tsv"), schema="id bigint, text string, share double, more string")
    assert sorted(r.id for r in df.collect()) == list(range(30)) and dict(df.dtypes)["share"] == "double"
