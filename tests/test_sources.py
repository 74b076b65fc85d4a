from __future__ import annotations

import json
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators.missing import missing_basic
from plumbline.operators.sketches import DISTINCT_ERROR, RANK_ERROR
from plumbline.sources.catalog import Catalog
from plumbline.sources.readers import read_dataset
from plumbline.streaming.profile import profile_batches, windowed_missing

PEOPLE = 'id,name,age,email,ok\n1,"Zoë, ""Z""",31,,TRUE\n2,NULL,NaN,x@y.org,false\n3,Bob,22.5,N/A,\n'


def test_csv_and_tsv(spark, tmp_path):
    (tmp_path / "p.csv").write_text(PEOPLE)
    df = read_dataset(spark, str(tmp_path / "p.csv"))
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "age": "double", "email": "string", "ok": "boolean"}
    assert {r.column: r.missing_count for r in missing_basic(df).collect()} == {"name": 1, "age": 1, "email": 2, "ok": 1}
    assert df.first().name == 'Zoë, "Z"'
    (tmp_path / "p.tsv").write_text("a\tb\n1\tx y\n")
    assert [tuple(r) for r in read_dataset(spark, str(tmp_path / "p.tsv")).collect()] == [(1, "x y")]


def test_json_parquet_feather(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"id": 1, "age": null}, {"id": 2, "age": 3}]')
    assert read_dataset(spark, str(tmp_path / "p.json")).count() == 2
    spark.createDataFrame([(1.0,), (float("nan"),)], "v double").write.parquet(str(tmp_path / "t.parquet"))
    assert read_dataset(spark, str(tmp_path / "t.parquet")).filter("v is null").count() == 1
    import pyarrow as pa
    import pyarrow.feather as feather

    feather.write_feather(pa.table({"a": list(range(10)), "b": [None, *"abcdefghi"]}), str(tmp_path / "t.feather"), chunksize=3)
    got = read_dataset(spark, str(tmp_path / "t.feather"))
    assert sorted(r.a for r in got.collect()) == list(range(10)) and got.filter("b is null").count() == 1


def test_workbook(spark, tmp_path):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="C2" t="b"><v>1</v></c></row><row><c r="B3"><v>2.5</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="one" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId7" Target="worksheets/first.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><t>ok</t></si><si><r><t>An</t></r><r><t>na</t></r></si></sst>')
        z.writestr("xl/worksheets/first.xml", sheet)
    df = read_dataset(spark, str(tmp_path / "t.xlsx"))
    assert [tuple(r) for r in df.collect()] == [("Anna", None, True), (None, 2.5, None)]


def test_unknown_types(spark):
    for kind in ("xls", "doc"):
        with pytest.raises(ValueError, match="support"):
            read_dataset(spark, f"/nowhere/file.{kind}")


def test_catalog(spark, tmp_path):
    (tmp_path / "p.csv").write_text(PEOPLE)
    catalog = Catalog(spark, (tmp_path / "catalog").as_uri())
    assert catalog.datasets_of(4).count() == 0
    row = catalog.ingest(str(tmp_path / "p.csv"), user_id=4, landing=(tmp_path / "landed").as_uri())
    assert catalog.dataset(row["id"], 4)["duplicates"] == 0 and catalog.datasets_of(5).count() == 0
    with pytest.raises(FileNotFoundError):
        catalog.dataset(row["id"], 5)
    assert catalog.update("datasets", F.col("id") == row["id"], {"format": "csv"}) == 1 and catalog.dataset(row["id"])["format"] == "csv"
    user = spark.createDataFrame([(1, "a@b.org", "A", "B", "x", "user", None, None, True, None, None)], catalog.table("users").schema)
    assert catalog.insert_unique("users", user, "email") == 1 and catalog.insert_unique("users", user, "email") == 0
    assert catalog.delete("datasets", F.col("id") == row["id"]) == 1 and catalog.datasets_of(4).count() == 0
    assert len(list((tmp_path / "landed").iterdir())) == 1


def test_unique_inserts(spark, tmp_path):
    catalog = Catalog(spark, (tmp_path / "catalog").as_uri())
    schema = catalog.table("users").schema
    user = lambda k, email: (k, email, f"n{k}", "B", "x", "user", None, None, True, None, None)
    batch = spark.createDataFrame([user(2, "a@x"), user(1, "a@x"), user(3, None), user(4, None), user(5, "b@x"), user(5, "b@x")], schema)
    assert catalog.insert_unique("users", batch, "email") == 2
    assert sorted((r.id, r.email) for r in catalog.table("users").collect()) == [(1, "a@x"), (5, "b@x")]
    assert catalog.insert_unique("users", batch.union(spark.createDataFrame([user(9, "c@x")], schema)), "email") == 1
    assert catalog.insert_unique("users", batch.limit(0), "email") == 0 and catalog.table("users").count() == 3


def test_a_dataset_grows_by_its_new_rows_alone(spark, tmp_path):
    rng = np.random.default_rng(1)
    frames = [pd.DataFrame({"v": rng.normal(size=n) * 5 + 100, "w": rng.integers(0, 400, n), "t": rng.choice(["a", "b", None], n)}) for n in (3000, 500, 1)]
    frames[1].loc[:50, "v"] = np.nan
    frames[1]["late"] = 1.5
    for k, f in enumerate(frames):
        f.to_parquet(tmp_path / f"{k}.parquet")
    catalog = Catalog(spark, (tmp_path / "catalog").as_uri())
    row = catalog.ingest((tmp_path / "0.parquet").as_uri(), user_id=1)
    (tmp_path / "0.parquet").unlink()  # what was ingested isn't read again
    catalog.extend(row["id"], (tmp_path / "1.parquet").as_uri())
    told = catalog.extend(row["id"], (tmp_path / "2.parquet").as_uri())
    with pytest.raises(ValueError, match="already"):
        catalog.extend(row["id"], (tmp_path / "2.parquet").as_uri())
    whole = pd.concat(frames)
    got = {r.column: r for r in catalog.measures_of(row["id"]).collect()}
    for c in ("v", "w"):
        exact = whole[c].dropna()
        assert (got[c].rows, got[c].missing_count) == (len(whole), len(whole) - len(exact))
        assert (got[c]["mean"], got[c]["std"], got[c]["min"], got[c]["max"]) == pytest.approx((exact.mean(), exact.std(), exact.min(), exact.max()))
        for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
            assert (exact < got[c][q]).mean() - RANK_ERROR <= p <= (exact <= got[c][q]).mean() + RANK_ERROR
        assert abs(got[c].distinct - exact.nunique()) <= DISTINCT_ERROR * exact.nunique() + 1
    assert got["t"].distinct == 2 and got["t"]["mean"] is None and got["t"].missing_count == whole.t.isna().sum()
    missing = json.loads(told["missing_values"])
    assert {c: x["count"] for c, x in missing["per_column"].items()} == {"v": 51, "t": int(whole.t.isna().sum()), "late": 3001}
    assert missing["total_missing"] == int(whole.isna().sum().sum()) and abs(told["duplicates"] - whole.duplicated().sum()) <= DISTINCT_ERROR * len(whole)
    assert json.loads(told["summary_stats"])["late"]["count"] == 500 and json.loads(told["data_types"]).keys() == {"v", "w", "t", "late"}


def test_stream_profiles(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "value", "event_type")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_missing(stream, "ts", window="1 day").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").agg(F.sum("rows")).first()[0] == events.count()
    got: list = []
    q = stream.writeStream.foreachBatch(profile_batches(lambda p: got.extend(p.collect()))).start()
    q.processAllAvailable()
    q.stop()
    assert {r.column for r in got} == {"ts", "value", "event_type"}
