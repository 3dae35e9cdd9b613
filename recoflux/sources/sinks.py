"""Results, model tables and parameters."""

from __future__ import annotations

import json
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def save_model(frames: dict[str, DataFrame], path: str, params: dict | None = None) -> None:
    """A model's tables, features included, and its parameters as a table of one JSON row."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    if params is not None and frames:
        spark = next(iter(frames.values())).sparkSession
        spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "params string").coalesce(1).write.mode("overwrite").text(f"{path}/params")


def load_params(spark: SparkSession, path: str) -> dict:
    """The parameters that save_model wrote."""
    return json.loads(spark.read.text(f"{path}/params").first()[0])


def load_model(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def read_params(path: str) -> dict:
    if not os.path.exists(path):
        return {}
    with open(path) as f:
        return json.load(f)


def upsert_params(path: str, name: str, params: dict, value: float) -> dict:
    """Merges one model's best parameters into the JSON file."""
    now = read_params(path) | {name: {"params": params, "value": value}}
    with open(path, "w") as f:
        json.dump(now, f, indent=1, sort_keys=True)
    return now


TRIALS = "study string, trial int, params string, value double, error string"


def append_trials(trials: DataFrame, path: str) -> None:
    trials.write.mode("append").parquet(path)


def append_trial(spark: SparkSession, path: str, study: str, trial: int, params: dict, value: float, error: str | None = None) -> None:
    """One row under the key (study, trial)."""
    append_trials(spark.createDataFrame([(study, trial, json.dumps(params, sort_keys=True), float(value), error)], TRIALS).coalesce(1), path)


def read_trials(spark: SparkSession, path: str, study: str) -> list[dict]:
    """A study's trials from 0 up to the first gap; of a trial stored twice, one row. As many rows as there were trials."""
    try:
        stored = spark.read.schema(TRIALS).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    rows = stored.filter(F.col("study") == study).dropDuplicates(["trial"]).orderBy("trial").select("trial", "params", "value").collect()
    return [{"trial": r.trial, "params": json.loads(r.params), "value": r.value} for i, r in enumerate(rows) if r.trial == i]
