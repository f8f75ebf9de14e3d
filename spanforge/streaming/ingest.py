"""Filings that arrive as a stream: each micro-batch runs the batch plan.

All operators work within a filing, so nothing is kept between batches and no
watermark is needed. A batch is written under its number, so one that runs again
after a failure replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from spanforge.plans.segmentation import segment_texts


def segment_stream(texts: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query over streaming texts(filing_id, text, fiscal_year_end) that writes items and verdicts."""

    def batch(df: DataFrame, number: int) -> None:
        run = segment_texts(df)
        for name in ("items", "verdicts", "violations"):
            getattr(run, name).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
