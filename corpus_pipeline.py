"""Cleans and packs the documents table, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import common
from keyloom.llm.decontamination import decontamination_stage
from keyloom.llm.line_dedup import line_stage
from keyloom.llm.packing import packing_stage
from keyloom.llm.quality_resampling import quality_stage
from keyloom.llm.simhash_dedup import simhash_stage

STAGES = [("quality", quality_stage), ("lines", line_stage), ("near-copies", simhash_stage), ("benchmark", decontamination_stage), ("packing", packing_stage)]
#: No SQL can express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each result is written as Parquet and reread, and what a stage stored on its way is deleted."""
    docs, start = common.table(spark, sf_dir, "documents"), common.count_stored()
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
        common.discard(spark, start, keep=1)
    return docs
