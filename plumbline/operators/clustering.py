"""The outlier pipeline: scaling, reconstruction error, density clusters, an isolation forest, and the decision."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.schema import feature_columns, stored

from .autoencoder import Autoencoder
from .dbscan import dbscan
from .forest import IsolationForest
from .reconstruction import Reconstruction


def is_outlier(label: Column, score: Column) -> Column:
    """Noise, or a negative forest score."""
    return (label == -1) | F.coalesce(score < 0, F.lit(False))


def outlier_pipeline(
    df: DataFrame, *, id_col: str, features: list[str] | None = None, eps: float = 0.5, min_samples: int = 5, trees: int = 100, tree_size: int = 256, seed: int = 42,
    fitted: Reconstruction | Autoencoder | None = None, forest: IsolationForest | None = None,
) -> tuple[DataFrame, dict]:
    """original_index, is_outlier, if_score, final_cluster_label, reconstruction_error for each row with all
    features, and the run's record, which holds what was fitted (``fitted``: scaler and components, or network; ``forest``). The score is
    0.5 less the anomaly under an isolation forest over the latent features, grown on all rows: negative for what is
    easier to isolate than most; noise has -1. ``fitted`` and ``forest``: those of another run instead
    of this table's own, or an ``Autoencoder`` in place of the components."""
    began = time.time()
    features = features or feature_columns(df)
    fitted = fitted or Reconstruction.fit(df, features)
    errors = stored(fitted.errors(df, id_col))
    latent = [c for c in errors.columns if c.startswith("latent")]
    joined = stored(errors.join(dbscan(errors, latent, id_col=id_col, eps=eps, min_samples=min_samples), id_col))
    forest = forest or IsolationForest.fit(errors, latent, id_col, trees=trees, tree_size=tree_size, seed=seed)
    noise = F.col("label") == -1
    out = forest.scored(joined, id_col, keep=["label", "reconstruction_error"]).withColumn("if_score", F.when(noise, -1.0).otherwise(0.5 - F.col("anomaly")))
    out = stored(out.select(F.col(id_col).alias("original_index"), is_outlier(F.col("label"), F.col("if_score")).alias("is_outlier"), "if_score", F.col("label").alias("final_cluster_label"), "reconstruction_error"))
    sums = out.agg(F.count("*").alias("n"), F.count_if(F.col("final_cluster_label") == -1).alias("noise"), F.count_if("is_outlier").alias("outliers"), F.count_distinct(F.when(F.col("final_cluster_label") >= 0, F.col("final_cluster_label"))).alias("clusters")).first()
    record = {"status": "completed", "start_time": began, "end_time": time.time(), "num_points": sums.n, "num_features": len(features), "num_clusters": sums.clusters, "num_noise": sums.noise, "num_outliers": sums.outliers, "fitted": fitted, "forest": forest}
    return out, record


def save_run(rows: DataFrame, record: dict, folder: str) -> None:
    """A run's artifacts under ``folder``: the labelled rows as Parquet, the record as one JSON line, and scaler, components
    (or network) and forest, which ``load_run`` reads back."""
    folder = folder.rstrip("/")
    rows.write.mode("overwrite").parquet(f"{folder}/cluster_labels.parquet")
    told = {k: v for k, v in record.items() if k not in ("fitted", "forest")}
    if record.get("fitted") is not None:
        record["fitted"].save(folder)
        record["forest"].save(rows.sparkSession, folder)
        told.update(features=record["fitted"].features, latent=record["forest"].features, rebuilt_by=type(record["fitted"]).__name__)
    one = rows.sparkSession.createDataFrame([(json.dumps(told, sort_keys=True),)], "value string")
    one.coalesce(1).write.mode("overwrite").text(f"{folder}/run_summary")


def load_run(spark: SparkSession, folder: str) -> dict:
    """The record of a saved run, with its scaler, components (or network) and forest."""
    folder = folder.rstrip("/")
    record = json.loads(spark.read.text(f"{folder}/run_summary").first().value)
    if "features" in record:
        kind = Autoencoder if record.get("rebuilt_by") == "Autoencoder" else Reconstruction
        record.update(fitted=kind.load(folder, record["features"]), forest=IsolationForest.load(spark, folder, record["latent"]))
    return record
