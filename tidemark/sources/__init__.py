"""Reading and writing maps: the driver's tables, and Parquet facts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.dictionary import TemporalMap
from tidemark.domain import Domain


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where the session has none, a local session (one JVM) takes a temporary folder; on a
    cluster each executor would write to its own disk, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_facts(spark: SparkSession, path: str, domain: Domain, coalesced: bool = True) -> TemporalMap:
    return TemporalMap(spark.read.parquet(path), domain, coalesced)


def write_facts(facts: TemporalMap, path: str, mode: str = "error") -> None:
    """Sorted inside each file by key and lo, so that min/max statistics prune lookups."""
    facts.facts.repartition("key").sortWithinPartitions("key", "lo").write.mode(mode).parquet(path)
