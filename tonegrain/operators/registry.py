"""Runs, metrics, model versions and aliases as plain tables."""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Mapping
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonegrain.operators.ranking import max_of_earlier, row_number_in_group
from tonegrain.sources.staging import new_path

# Fixed value: the alias the scoring jobs load.
PRODUCTION = "production"

#: Seconds a writer waits for another one's alias table.
PATIENCE = 60.0

EXPERIMENT = "Default"

_STRING_MAP = T.MapType(T.StringType(), T.StringType())

TABLES = {
    "runs": T.StructType(
        [
            T.StructField("run_id", T.StringType()),
            T.StructField("experiment", T.StringType()),
            T.StructField("run_name", T.StringType()),
            T.StructField("logged_at", T.TimestampType()),
            T.StructField("params", _STRING_MAP),
        ]
    ),
    "metrics": T.StructType(
        [
            T.StructField("run_id", T.StringType()),
            T.StructField("metric", T.StringType()),
            T.StructField("value", T.DoubleType()),
        ]
    ),
    "reports": T.StructType(
        [T.StructField("run_id", T.StringType()), T.StructField("report", T.StringType())]
    ),
    "cv_results": T.StructType(
        [
            T.StructField("run_id", T.StringType()),
            T.StructField("candidate_id", T.LongType()),
            T.StructField("params", _STRING_MAP),
            T.StructField("mean_score", T.DoubleType()),
            T.StructField("std_score", T.DoubleType()),
            T.StructField("rank", T.LongType()),
        ]
    ),
    "model_versions": T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField("version", T.LongType()),
            T.StructField("run_id", T.StringType()),
            T.StructField("path", T.StringType()),
            T.StructField("signature", T.StringType()),
            T.StructField("test_f1_score", T.DoubleType()),
        ]
    ),
    "aliases": T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField("alias", T.StringType()),
            T.StructField("version", T.LongType()),
        ]
    ),
}


def run_name(runs: DataFrame, prefix: str = "name", ts: str = "logged_at") -> DataFrame:
    """``prefix`` and the time floored to the second."""
    stamp = F.date_format(F.date_trunc("second", ts), "yyyy-MM-dd HH:mm:ss")
    return runs.withColumn("run_name", F.concat_ws(" ", prefix, stamp))


def assign_version(runs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Next version numbers per model name, in order of ``(logged_at, run_id)``.

    ``existing`` holds the versions given out before: ``name``, ``version``.
    """
    ranked = row_number_in_group(runs, "name", ["logged_at", "run_id"], "version")
    if existing is None:
        return ranked.withColumn("version", F.col("version").cast("bigint"))
    highest = existing.groupBy("name").agg(F.max("version").alias("_highest"))
    return (
        ranked.join(highest, "name", "left")
        .withColumn("version", F.col("version") + F.coalesce("_highest", F.lit(0)))
        .drop("_highest")
    )


def _no_nan(score: str):
    """NaN compares as greatest in SQL; a run may not log it."""
    return F.when(
        F.isnan(score), F.raise_error(F.lit(f"{score} is NaN")).cast("double")
    ).otherwise(F.col(score))


def promote(versions: DataFrame, aliases: DataFrame, candidates: DataFrame) -> DataFrame:
    """The alias table after candidates met the production versions.

    A candidate takes over if the name has no production version, if that one has
    no score, or if its score is lower; on a tie the holder stays. ``versions``
    hold ``name, version, test_f1_score``; ``candidates`` one such line per name.
    """
    holder = (
        aliases.filter(F.col("alias") == PRODUCTION)
        .select("name", F.col("version").alias("_held"))
        .join(
            versions.select(
                "name",
                F.col("version").alias("_held"),
                F.col("test_f1_score").alias("_held_score"),
            ),
            ["name", "_held"],
            "left",
        )
    )
    offered = candidates.select(
        "name",
        F.col("version").alias("_offered"),
        _no_nan("test_f1_score").alias("_score"),
    )
    takes_over = (
        F.col("_held").isNull()
        | F.col("_held_score").isNull()
        | (F.col("_held_score") < F.col("_score"))
    )
    decided = offered.join(holder, "name", "full_outer").select(
        "name",
        F.lit(PRODUCTION).alias("alias"),
        F.when(F.col("_offered").isNotNull() & takes_over, F.col("_offered"))
        .otherwise(F.col("_held"))
        .alias("version"),
    )
    others = aliases.filter(F.col("alias") != PRODUCTION).select("name", "alias", "version")
    return others.unionByName(decided)


def promotion_history(runs: DataFrame) -> DataFrame:
    """Which runs took production over when each was offered in turn.

    ``runs``: ``name, run_id, logged_at, test_f1_score`` without null scores. A
    run is promoted if it is the first or beats the best score before it.
    """
    checked = runs.withColumn("test_f1_score", _no_nan("test_f1_score"))
    ranked = max_of_earlier(
        checked, "name", ["logged_at", "run_id"], "test_f1_score", "best_before", "version"
    )
    first_or_better = F.col("best_before").isNull() | (
        F.col("test_f1_score") > F.col("best_before")
    )
    return ranked.withColumn("version", F.col("version").cast("bigint")).withColumn(
        "promoted", first_or_better
    )


def production_meta(names: DataFrame, aliases: DataFrame, versions: DataFrame) -> DataFrame:
    """Name, alias, version and run of each model; the last two null if not found."""
    held = aliases.filter(F.col("alias") == PRODUCTION).select("name", "version")
    found = held.join(versions.select("name", "version", "run_id"), ["name", "version"])
    return names.select("name", F.lit(PRODUCTION).alias("alias")).join(found, "name", "left")


class Registry:
    """The tables under one folder, and the saved models next to them.

    Runs, metrics, reports and versions are appended to. The alias table is
    replaced as a whole: a new generation is written, then read as the newest.
    """

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark = spark
        self.root = root or new_path(spark, "registry")

    def read(self, name: str) -> DataFrame:
        """A table, empty before its first append."""
        path = f"{self.root}/{name}"
        if name == "aliases":
            generation = self._alias_generation()
            path = f"{path}/generation={generation}"
            if generation == 0:
                return self.spark.createDataFrame([], TABLES[name])
        elif not self._exists(path):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).option("recursiveFileLookup", "true").parquet(path)

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows in a folder of their own: writers of one folder would clear each other's unfinished files."""
        rows.to(TABLES[name]).write.parquet(f"{self.root}/{name}/{uuid.uuid4().hex}")

    def log_run(
        self,
        run_id: str,
        name: str,
        params: Mapping[str, object],
        metrics: DataFrame,
        report: str | None = None,
        experiment: str = EXPERIMENT,
        search: DataFrame | None = None,
    ) -> None:
        """Append a run, its metrics (``metric, value``), its text report and its ``cv_results`` with ``params``."""
        text_params = {k: str(v) for k, v in params.items()}
        run = self.spark.range(1).select(
            F.lit(run_id).alias("run_id"),
            F.lit(experiment).alias("experiment"),
            F.lit(name).alias("prefix"),
            F.current_timestamp().alias("logged_at"),
            F.from_json(F.lit(json.dumps(text_params)), _STRING_MAP).alias("params"),
        )
        self.append("runs", run_name(run, "prefix").drop("prefix"))
        self.append(
            "metrics", metrics.select(F.lit(run_id).alias("run_id"), "metric", _no_nan("value").alias("value"))
        )
        if search is not None:
            self.append("cv_results", search.withColumns({"run_id": F.lit(run_id), "rank": F.col("rank").cast("long")}))
        if report is not None:
            self.append(
                "reports",
                self.spark.range(1).select(
                    F.lit(run_id).alias("run_id"), F.lit(report).alias("report")
                ),
            )

    def save_model(
        self,
        name: str,
        model: PipelineModel,
        run_id: str,
        test_f1_score: float | None,
        signature: Mapping[str, str],
    ) -> int:
        """Save a fitted pipeline as the next version of a name.

        The number is claimed before anything is written, so writers of one name, also in
        other applications, never share one; a writer that fails leaves its number unused.
        """
        if test_f1_score is not None and math.isnan(test_f1_score):
            raise ValueError("test_f1_score is NaN")
        known = self.read("model_versions").filter(F.col("name") == name)
        version = known.agg(F.coalesce(F.max("version"), F.lit(0)) + 1).first()[0]
        while not self._claim(f"{self.root}/claims/version/{quote(name, safe='')}/{version}"):
            version += 1
        path = f"{self.root}/models/{quote(name, safe='')}/v={version}"
        model.write().overwrite().save(path)
        line = (name, version, run_id, path, json.dumps(signature), test_f1_score)
        self.append(
            "model_versions", self.spark.createDataFrame([line], TABLES["model_versions"])
        )
        return version

    def promote(self, name: str, version: int) -> None:
        """Offer a version for production.

        The next generation of the alias table is claimed before it is derived from the newest one. If
        another writer holds it, its result is waited for, up to ``PATIENCE`` seconds, and built upon; then
        that writer counts as lost and the generation after its own is claimed.
        """
        waited, generation = 0.0, self._alias_generation() + 1
        while not self._claim(f"{self.root}/claims/aliases/{generation}"):
            newest = self._alias_generation()
            if newest < generation and waited < PATIENCE:
                time.sleep(0.2)
                waited += 0.2
            else:
                waited, generation = 0.0, max(newest, generation) + 1
        versions = self.read("model_versions")
        candidate = versions.filter((F.col("name") == name) & (F.col("version") == version))
        after = promote(versions, self.read("aliases"), candidate)
        after.to(TABLES["aliases"]).write.parquet(f"{self.root}/aliases/generation={generation}")

    def production(self, name: str) -> Row:
        """``version, run_id, path`` of the production model of a name."""
        found = (
            self.read("aliases")
            .filter((F.col("name") == name) & (F.col("alias") == PRODUCTION))
            .join(self.read("model_versions"), ["name", "version"])
            .select("version", "run_id", "path")
            .first()
        )
        if found is None:
            raise LookupError(f"model {name!r} has no {PRODUCTION} version")
        return found

    def load_model(self, name: str) -> PipelineModel:
        return PipelineModel.load(self.production(name)["path"])

    def meta(self, name: str) -> DataFrame:
        names = self.spark.range(1).select(F.lit(name).alias("name"))
        return production_meta(names, self.read("aliases"), self.read("model_versions"))

    def _claim(self, path: str) -> bool:
        """Create an empty file; False if it is there, whoever made it."""
        hadoop_path, fs = self._path(path)
        fs.mkdirs(hadoop_path.getParent())
        if fs.getScheme() == "file":  # there, Hadoop looks first and creates then
            return self.spark.sparkContext._jvm.java.io.File(hadoop_path.toUri().getPath()).createNewFile()
        try:
            fs.create(hadoop_path, False).close()
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _path(self, path: str):
        jvm = self.spark.sparkContext._jvm
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path, hadoop_path.getFileSystem(
            self.spark.sparkContext._jsc.hadoopConfiguration()
        )

    def _exists(self, path: str) -> bool:
        hadoop_path, fs = self._path(path)
        return fs.exists(hadoop_path)

    def _alias_generation(self) -> int:
        """Newest completely written alias table; 0 if there is none."""
        hadoop_path, fs = self._path(f"{self.root}/aliases/generation=*/_SUCCESS")
        found = fs.globStatus(hadoop_path) or []
        return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found), default=0)
