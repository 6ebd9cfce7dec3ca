"""Row operators over streams: new source files are prepared as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text
from ..operators import prompts


def prepare_stream(stream: DataFrame, task: dict, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Prepare the rows of a stream with the operators that batches use, and append them as Parquet, each exactly once."""
    rows = prompts.prepare_rows(stream, task)
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def sensitive_stream(stream: DataFrame, time: str, content: str, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Rows of each time window that match each pattern of personal data or secrets; rows later than late are dropped."""
    found = text.matches(F.col(content), text.PII | text.SECRETS)
    counted = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("window"))
    return counted.agg(F.count("*").alias("rows"), *(F.count_if(c).alias(n) for n, c in found.items()))
