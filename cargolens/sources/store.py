"""Batch store and model store."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargolens.constants import LEVELS
from cargolens.functions.columns import col
from cargolens.operators.forest import Forest
from cargolens.operators.models import RiskModel
from cargolens.operators.profile import Profile
from cargolens.plans.staging import freed_shuffles
from cargolens.schema import PREDICTION_SCHEMA


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


class BatchStore:
    """Cleaned and rejected rows, predictions and summaries of batches below one folder.

    Tables are partitioned by batch, predictions by level as well, so reading a batch or a level
    touches only its files. Writing a batch again replaces its folder and no other.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _write(self, df: DataFrame, table: str, batch_id: str, *levels: str) -> None:
        writer = df.write.mode("overwrite").partitionBy(*levels)
        with freed_shuffles(df.sparkSession):  # within a stream that is a session of its own
            writer.parquet(f"{self.path}/{table}/batch_id={batch_id}")

    def _read(self, table: str, batch_id: str) -> DataFrame:
        df = self.spark.read.option("basePath", f"{self.path}/{table}").parquet(
            f"{self.path}/{table}/batch_id={batch_id}"
        )
        return df.drop("batch_id")

    def write_cleaned(self, df: DataFrame, batch_id: str) -> None:
        self._write(df, "cleaned", batch_id)

    def write_predictions(self, df: DataFrame, batch_id: str) -> None:
        self._write(df, "predictions", batch_id, "risk_level")

    def write_summary(self, df: DataFrame, batch_id: str) -> None:
        self._write(df.coalesce(1), "summary", batch_id)

    def write_statuses(self, df: DataFrame, batch_id: str) -> None:
        self._write(df, "statuses", batch_id)

    def write_accounting(self, df: DataFrame, batch_id: str) -> None:
        self._write(df.coalesce(1), "accounting", batch_id)

    def write_rejects(self, df: DataFrame, batch_id: str) -> None:
        self._write(df, "rejects", batch_id)

    def statuses(self, batch_id: str) -> DataFrame:
        return self._read("statuses", batch_id)

    def accounting(self, batch_id: str) -> DataFrame:
        return self._read("accounting", batch_id)

    def rejects(self, batch_id: str) -> DataFrame:
        return self._read("rejects", batch_id)

    def cleaned(self, batch_id: str) -> DataFrame:
        return self._read("cleaned", batch_id)

    def predictions(self, batch_id: str) -> DataFrame:
        return self._read("predictions", batch_id)

    def summary(self, batch_id: str) -> DataFrame:
        return self._read("summary", batch_id)

    def commit(self, batch_id: str) -> None:
        """Mark a batch as whole; a second commit replaces the first."""
        row = self.spark.createDataFrame([(batch_id,)], "id string").coalesce(1)
        self._write(row, "commits", batch_id)

    def commits(self) -> DataFrame:
        """(batch_id) of whole batches."""
        if not _exists(self.spark, f"{self.path}/commits"):
            return self.spark.createDataFrame([], "batch_id string")
        return self.spark.read.schema("id string").parquet(f"{self.path}/commits/*").select(col("id").alias("batch_id"))

    def is_committed(self, batch_id: str) -> bool:
        return _exists(self.spark, f"{self.path}/commits/batch_id={batch_id}/_SUCCESS")

    def committed(self, prefix: str = "") -> DataFrame:
        """Predictions of all whole batches whose id begins with ``prefix``, with ``batch_id``.

        Folders of other batches are not opened.
        """
        ids = sorted(r["batch_id"] for r in self.commits().where(col("batch_id").startswith(prefix)).collect())
        table = f"{self.path}/predictions"
        schema = T.StructType([*PREDICTION_SCHEMA.fields, T.StructField("batch_id", T.StringType())])
        if not ids:
            return self.spark.createDataFrame([], schema)
        paths = [f"{table}/batch_id={i}" for i in ids]
        return self.spark.read.schema(schema).option("basePath", table).parquet(*paths)

    def by_level(self, batch_id: str, level: str) -> DataFrame:
        """One level of one batch; other levels' files are not opened (A1)."""
        if level not in LEVELS:
            raise ValueError(f"unknown level: {level}")
        return self.predictions(batch_id).where(col("risk_level") == level)


class ModelStore:
    """Model runs in folders of their own; a pointer table names the current one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, model: RiskModel, profile: Profile) -> str:
        """Write a run and make it current; earlier runs stay."""
        run_id = uuid.uuid4().hex[:12]
        folder = f"{self.path}/run_id={run_id}"
        model.classifier.write().save(f"{folder}/classifier")
        model.forest.save(f"{folder}/forest")
        profile.save(f"{folder}/profile")
        facts = json.dumps({"features": model.features, "stats": model.stats})
        self.spark.createDataFrame([(facts,)], "facts string").coalesce(1).write.parquet(
            f"{folder}/facts"
        )
        self.make_current(run_id)
        return run_id

    def make_current(self, run_id: str) -> None:
        """Point to a run; also the way back to an earlier one. The log of pointers only grows."""
        now = datetime.now(timezone.utc).replace(tzinfo=None).isoformat()
        self.spark.createDataFrame([(run_id, now)], "run_id string, since string").coalesce(
            1
        ).write.mode("append").parquet(f"{self.path}/current")

    def current(self) -> str:
        """The run that was made current last."""
        pointers = self.spark.read.parquet(f"{self.path}/current")
        return pointers.agg(F.max_by("run_id", "since")).first()[0]

    def load(self, run_id: str | None = None) -> tuple[RiskModel, Profile]:
        folder = f"{self.path}/run_id={run_id or self.current()}"
        facts = json.loads(self.spark.read.parquet(f"{folder}/facts").first()["facts"])
        model = RiskModel(
            PipelineModel.load(f"{folder}/classifier"),
            Forest.load(self.spark, f"{folder}/forest"),
            facts["features"],
            facts["stats"],
        )
        return model, Profile.load(self.spark, f"{folder}/profile")
