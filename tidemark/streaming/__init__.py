"""Keeping a Parquet map up to date from a stream of facts (an extra)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tidemark.dictionary import TemporalMap
from tidemark.domain import Domain
from tidemark.sources import write_facts


def insert_stream(stream: DataFrame, path: str, domain: Domain) -> DataStreamWriter:
    """Each micro-batch's facts (key, value, lo, hi) become a coalesced generation in
    ``path``/batch=N.  Inserts commute and are idempotent, so a replayed batch is harmless;
    readers coalesce the generations."""

    def apply(batch: DataFrame, number: int) -> None:
        write_facts(TemporalMap(batch, domain), f"{path}/batch={number}", "overwrite")

    return stream.writeStream.outputMode("append").foreachBatch(apply)
