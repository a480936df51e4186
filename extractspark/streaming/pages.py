"""The per-page operators on streams. Parsing and replay look at one page only, so they keep no state between batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import flexible

PAGES = "page_id bigint, url string, html string"


def read_pages(spark: SparkSession, path: str, schema: str = PAGES, max_files: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def extract_stream(pages: DataFrame, operator: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Run an operator over each batch of pages and append its rows to a Parquet folder, each batch in a folder of its own.

    The operator may join and use windows: a batch is an ordinary table. A batch that is run again replaces its folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def fingerprint_drift(values: DataFrame, time: str = "ts", value: str = "value", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Figures of extracted values for each window of event time, to be held against a learned fingerprint."""
    measured = values.withColumns({f"m_{k}": c for k, c in flexible.shape(F.col(value)).items()})
    means = [F.avg(F.col(f"m_{k}").cast("double")).alias(f"avg_{k}") for k in ("length", "words", "digits", "letters", "currency")]
    return measured.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("count"), *means)
