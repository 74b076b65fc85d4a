"""Rows rebuilt from principal components of their scaled features."""

from __future__ import annotations

from pyspark.ml.feature import PCA, PCAModel, StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.schema import quoted


class Reconstruction:
    """A fitted scaler and principal components; what a run saves to score other rows by."""

    def __init__(self, scaler: StandardScalerModel, model: PCAModel, features: list[str]):
        self.scaler, self.model, self.features = scaler, model, features

    @staticmethod
    def _wide(df: DataFrame, features: list[str], id_col: str | None) -> DataFrame:
        kept = [] if id_col is None else [F.col(id_col)]
        return VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip").transform(df.select(*kept, *[quoted(f).cast("double").alias(f) for f in features]))

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], kept: int | None = None) -> Reconstruction:
        wide = cls._wide(df, features, None)
        scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(wide)
        kept = kept or max(1, min(10, len(features) - 1))
        return cls(scaler, PCA(k=kept, inputCol="scaled", outputCol="latent").fit(scaler.transform(wide)), features)

    def errors(self, df: DataFrame, id_col: str) -> DataFrame:
        """id_col, reconstruction_error (mean squared difference of the scaled features to the point rebuilt from the
        components), and the latent features, for rows that have all features."""
        ways = self.model.pc.toArray()  # features by components
        kept = range(ways.shape[1])
        out = self.model.transform(self.scaler.transform(self._wide(df, self.features, id_col))).select(id_col, vector_to_array("scaled").alias("x"), vector_to_array("latent").alias("z"))
        rebuilt = F.array(*[sum((F.get("z", F.lit(j)) * float(ways[i, j]) for j in kept), F.lit(0.0)) for i in range(len(self.features))])
        error = F.aggregate(F.zip_with("x", rebuilt, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) / len(self.features)
        return out.select(id_col, error.alias("reconstruction_error"), *[F.get("z", F.lit(j)).alias(f"latent{j}") for j in kept])

    def save(self, folder: str) -> None:
        self.scaler.write().overwrite().save(f"{folder}/scaler")
        self.model.write().overwrite().save(f"{folder}/components")

    @classmethod
    def load(cls, folder: str, features: list[str]) -> Reconstruction:
        return cls(StandardScalerModel.load(f"{folder}/scaler"), PCAModel.load(f"{folder}/components"), features)
