"""The catalog of datasets and users: Parquet tables that are appended to, filtered, and rewritten."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.schema import EmptyDatasetError, stored, string_columns
from plumbline.operators.categorical import upload_consistency
from plumbline.operators.duplicates import exact_duplicates
from plumbline.operators.frequency import frequencies
from plumbline.operators.inference import data_types
from plumbline.operators.missing import missing_basic, missing_basic_totals
from plumbline.operators.numeric import describe, numeric_columns
from plumbline.operators.sketches import MEASURES, described, measures, merged

from .readers import file_type, read_dataset

DATASETS = (
    "id string, filename string, file_type string, file_path string, format string, missing_values string, duplicates bigint, "
    "data_types string, categorical_issues string, summary_stats string, created_at timestamp, updated_at timestamp, user_id bigint"
)
USERS = (
    "id bigint, email string, first_name string, last_name string, hashed_password string, role string, company string, "
    "phone_number string, is_active boolean, created_at timestamp, reset_token string"
)
#: Measures of each part of a dataset that was ingested or added to it.
PARTS = "dataset_id string, part string, " + MEASURES


class Catalog:
    """Tables under one folder (a URI that all executors reach). A table is the newest of its numbered version folders
    that was written to the end; a rewrite makes the next version and leaves the one before it,
    so readers see a whole table and a rewrite that fails changes nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> tuple[list[int], int]:
        """The whole versions, and the number that the next one gets."""
        folder, fs = self._folder(name)
        numbers = sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(folder)) if fs.exists(folder) else []
        done = [n for n in numbers if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name, n) + "/_SUCCESS"))]
        return done, (numbers[-1] if numbers else 0) + 1

    def _path(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/v{version:08d}"

    def table(self, name: str) -> DataFrame:
        schema = {"datasets": DATASETS, "users": USERS, "parts": PARTS}[name]
        done, _ = self._versions(name)
        return self.spark.read.schema(schema).parquet(self._path(name, done[-1])) if done else self.spark.createDataFrame([], schema)

    def append(self, name: str, rows: DataFrame) -> None:
        done, following = self._versions(name)
        rows.select(*self.table(name).columns).write.mode("append").parquet(self._path(name, done[-1] if done else following))

    def insert_unique(self, name: str, rows: DataFrame, key: str, order: str = "id") -> int:
        """Appends the rows whose key neither the table nor a row before them (by ``order``, then by all columns) has; how many
        these are. A row without a key is refused."""
        columns = self.table(name).columns
        first = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(order, *[c for c in columns if c != order])).alias("first")).select("first.*")
        new = stored(first.join(self.table(name).select(key), key, "left_anti"))
        self.append(name, new)
        return new.count()

    def _rewrite(self, name: str, rows: DataFrame) -> None:
        done, following = self._versions(name)
        rows.write.parquet(self._path(name, following))
        _, fs = self._folder(name)
        for old in done[:-1]:  # the version just replaced stays for those who read it
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name, old)), True)

    def delete(self, name: str, where: Column) -> int:
        """Drops the rows that ``where`` holds for; a dataset's file stays."""
        rows = self.table(name)
        gone = rows.filter(where).count()
        if gone:
            self._rewrite(name, rows.filter(~F.coalesce(where, F.lit(False))))
        return gone

    def update(self, name: str, where: Column, values: dict[str, object]) -> int:
        rows = self.table(name)
        hit = rows.filter(where).count()
        if hit:
            self._rewrite(name, rows.withColumns({c: F.when(F.coalesce(where, F.lit(False)), F.lit(v)).otherwise(F.col(c)).cast(rows.schema[c].dataType) for c, v in values.items()}))
        return hit

    def datasets_of(self, user_id: int) -> DataFrame:
        return self.table("datasets").filter(F.col("user_id") == user_id)

    def dataset(self, dataset_id: str, user_id: int | None = None) -> dict:
        rows = self.table("datasets").filter(F.col("id") == dataset_id)
        found = (rows if user_id is None else rows.filter(F.col("user_id") == user_id)).limit(1).collect()
        if not found:
            raise FileNotFoundError(f"no dataset {dataset_id}")
        return found[0].asDict()

    def ingest(self, path: str, kind: str | None = None, *, user_id: int, landing: str | None = None) -> dict:
        """Profiles a file and adds its row; with ``landing`` the rows are also written there as Parquet by user."""
        df = read_dataset(self.spark, path, kind)
        profile = upload_profile(df)
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        name = path.rsplit("/", 1)[-1]
        if landing:
            df.write.parquet(f"{landing.rstrip('/')}/user_id={user_id}/{now:%Y%m%d_%H%M%S}_{name}")
        row = {"id": uuid.uuid4().hex, "filename": name, "file_type": kind or file_type(path), "file_path": path, "format": "auto-detect", **{k: json.dumps(v) if k != "duplicates" else v for k, v in profile.items()}, "created_at": now, "updated_at": now, "user_id": user_id}
        self._measure(row["id"], path, df)
        self.append("datasets", self.spark.createDataFrame([row], DATASETS))
        return row

    def _measure(self, dataset_id: str, path: str, df: DataFrame) -> None:
        self.append("parts", measures(df).select(F.lit(dataset_id).alias("dataset_id"), F.lit(path).alias("part"), "*"))

    def measures_of(self, dataset_id: str) -> DataFrame:
        """Measures of all parts of a dataset, merged from what is kept of each; ``sketches.described`` has the columns."""
        parts = self.table("parts").filter(F.col("dataset_id") == dataset_id).drop("dataset_id", "part")
        return described(merged(parts))

    def extend(self, dataset_id: str, path: str, kind: str | None = None) -> dict:
        """Adds a file's rows to a dataset. Only the new rows are read: their measures join those kept, and the dataset's missing values, types, statistics
        and duplicates become the merged ones, whose quartiles and duplicates are estimates within the errors that
        ``sketches`` states. A part that was added already is refused."""
        old = self.dataset(dataset_id)
        if not self.table("parts").filter((F.col("dataset_id") == dataset_id) & (F.col("part") == path)).isEmpty():
            raise ValueError(f"{path} is part of the dataset already")
        df = read_dataset(self.spark, path, kind)
        self._measure(dataset_id, path, df)
        rows = self.measures_of(dataset_id).collect()  # one row for each column
        whole = next(r for r in rows if r.column is None)
        columns = [r for r in rows if r.column is not None]
        cells, lost = whole.rows * len(columns), sum(whole.rows - (r.rows - r.missing_count) for r in columns)
        missing = {r.column: whole.rows - (r.rows - r.missing_count) for r in columns}  # a column that a part lacks is missing there
        values = {
            "missing_values": {"total_missing": lost, "missing_percentage": lost / cells * 100 if cells else 0.0, "per_column": {c: {"count": n, "percentage": n / whole.rows * 100} for c, n in missing.items() if n}},
            "duplicates": whole.duplicates, "data_types": {**{r.column: r.type for r in data_types(df).collect()}, **json.loads(old["data_types"])},
            "summary_stats": {r.column: {"count": r.rows - r.missing_count, **{k: r[k] for k in ("mean", "std", "min", "q25", "q50", "q75", "max")}} for r in columns if r["mean"] is not None},
            "updated_at": datetime.now(timezone.utc).replace(tzinfo=None),
        }
        self.update("datasets", F.col("id") == dataset_id, {k: json.dumps(v) if isinstance(v, dict) else v for k, v in values.items()})
        return self.dataset(dataset_id)


def upload_profile(df: DataFrame) -> dict:
    """What the catalog keeps of a dataset: missing_values, duplicates, data_types, categorical_issues, summary_stats."""
    if not df.columns:
        raise EmptyDatasetError("no columns")
    totals = missing_basic_totals(df).first()
    texts = string_columns(df)
    issues = upload_consistency(frequencies(df, texts)).collect() if texts else []  # one row for each column
    stats = {r.column: {k: r[k] for k in r.asDict() if k != "column"} for r in describe(df).collect()} if numeric_columns(df) else {}
    return {
        "missing_values": {"total_missing": totals.total_missing, "missing_percentage": totals.missing_pct, "per_column": {r.column: {"count": r.missing_count, "percentage": r.missing_pct} for r in missing_basic(df).collect()}},
        "duplicates": exact_duplicates(df).first().duplicate_count,
        "data_types": {r.column: r.type for r in data_types(df).collect()},
        "categorical_issues": {r.column: {"inconsistent_format": r.inconsistent_format, "inconsistent_count": r.inconsistent_count, "rare_values": r.rare_values} for r in issues},
        "summary_stats": stats,
    }


