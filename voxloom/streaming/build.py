"""Continuous building of training rows.

Filters, frames, tokens and sequences need no state, so the batch functions run
unchanged on a stream.  Subsampling, shuffling, batching and summaries look at
all rows and stay with the written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from voxloom.functions.text import Tokenizer
from voxloom.plans.training import build_rows, rejected_rows, sound_rows
from voxloom.session import LONG_ROWS
from voxloom.vocab import DEFAULT_LAYOUT, TokenLayout


def stream_training_rows(
    stream: DataFrame,
    *,
    max_seconds: float | None = 30,
    tokenizer: Tokenizer | None = None,
    layout: TokenLayout = DEFAULT_LAYOUT,
) -> DataFrame:
    """Standard encoded rows on a stream to training rows."""
    return build_rows(sound_rows(stream, max_seconds=max_seconds), tokenizer=tokenizer, layout=layout)


def stream_rejects(stream: DataFrame, *, max_seconds: float | None = 30) -> DataFrame:
    """Key and reason of the rows that ``stream_training_rows`` leaves out as unsound; a sink of its own."""
    return rejected_rows(stream, max_seconds=max_seconds)


def write_available(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived, append it as Parquet, and stop.

    The checkpoint makes a restart continue where the last run ended, and the
    file sink commits each batch exactly once.
    """
    spark = rows.sparkSession
    writer = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    # The file sink takes Parquet's settings from the session, when it starts, and not from its options.
    before = {key: spark.conf.get(key, None) for key in LONG_ROWS}
    try:
        for key, value in LONG_ROWS.items():
            spark.conf.set(key, value)
        return writer.trigger(availableNow=True).outputMode("append").start(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
