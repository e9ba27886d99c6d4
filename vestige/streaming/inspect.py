"""Inspection of a stream of texts: a row's findings depend on that row only, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.textpipe import findings


def inspect_stream(spark: SparkSession, source: str, schema: str, keys: tuple[str, ...], sink: str, checkpoint: str, text_col: str = "text"):
    """Read the Parquet files that are in ``source``, write their findings to ``sink``, and stop; a later call takes new files only."""
    texts: DataFrame = spark.readStream.schema(schema).parquet(source)
    rows = findings(texts, *keys, text_col=text_col)
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
