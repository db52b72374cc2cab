"""Read statistics kept up to date over a stream of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_read_counts(reads: DataFrame) -> DataFrame:
    """Running counts by sample and chromosome: state is a row per pair, pre-aggregated on the map side."""
    mapped = F.col("flag").bitwiseAND(4) == 0
    return reads.groupBy("sample_id", "chrom").agg(F.count("*").alias("reads"), F.count_if(mapped).alias("aligned"))
