"""Summaries and samples of rows that are still arriving: the same as over the table of all of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxloom.functions import vectors as vx
from voxloom.functions.hashing import order_hash
from voxloom.operators.sampling import SAMPLE_SEED, subsample
from voxloom.streaming.state import MicroState, run_available


@dataclass(frozen=True)
class StreamTotals:
    """Running sums below ``path``: ``sums`` of rows per ``keys``, kept as one row per key.

    A sum has to be of a type whose addition is exact in any order, such as integers
    and decimals.  Rows are pre-aggregated before the keys are shuffled, and a
    micro-batch adds to the sums of the one before, exactly once.
    """

    path: str
    sums: Mapping[str, Column] = field(hash=False)
    keys: Sequence[str] = ()

    @property
    def state(self) -> MicroState:
        return MicroState(self.path)

    def _of(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[F.coalesce(F.sum(value), F.lit(0)).alias(name) for name, value in self.sums.items()])

    def add(self, rows: DataFrame, micro: int) -> None:
        """Take in one micro-batch."""
        spark, state = rows.sparkSession, self.state
        due, done = state.due(spark, micro)
        if not due:
            return
        total = self._of(rows)
        if done is not None:
            both = spark.read.schema(total.schema).parquet(f"{state.folder(done)}/totals").unionByName(total)
            total = both.groupBy(*self.keys).agg(*[F.sum(name).cast(total.schema[name].dataType).alias(name) for name in self.sums])
        total.write.mode("overwrite").parquet(f"{state.folder(micro)}/totals")
        state.finish(spark, micro, kept=1)

    def run(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take in what has arrived on a stream, and stop."""
        return run_available(stream, self.add, checkpoint)

    def read(self, spark: SparkSession) -> DataFrame:
        """The keys and their sums over all micro-batches that are completely written."""
        done = self.state.committed(spark)
        if done is None:
            raise ValueError(f"no micro-batch has been written to {self.path!r}")
        return spark.read.parquet(f"{self.state.folder(done)}/totals")


def summary_totals(path: str) -> StreamTotals:
    """Totals of rounded, scored rows from which ``streamed_summary`` makes the evaluation summary.

    Rounded metrics have four digits, so their sums are kept exactly, as decimals.
    """
    scored = F.col("overall_score").isNotNull()
    sums = {n: F.when(scored, F.col(n)).cast("decimal(30,4)") for n in vx.METRICS}
    present = {f"n_{n}": (scored & F.col(n).isNotNull()).cast("long") for n in vx.METRICS}
    counts = {"samples_evaluated": scored.cast("long"), "samples_failed": (~scored).cast("long")}
    return StreamTotals(path, sums | present | counts)


def streamed_summary(totals: DataFrame) -> DataFrame:
    """``eval_summary`` over all rows that ``summary_totals`` has taken in."""

    def mean(name: str) -> Column:
        value = F.col(name).cast("double") / F.when(F.col(f"n_{name}") > 0, F.col(f"n_{name}"))
        return F.coalesce(vx.round_metric(value), F.lit(0.0)).alias(name)

    return totals.select(*map(mean, vx.METRICS), "samples_evaluated", "samples_failed")


def counter_totals(path: str, *, source: str = "source", error: str = "error") -> StreamTotals:
    """Totals of prepared rows from which ``streamed_counters`` makes the counters of Prepare."""
    sound = F.col(error).isNull()
    counts = {"total": F.lit(1).cast("long"), "processed": sound.cast("long"), "failed_samples": (~sound).cast("long")}
    return StreamTotals(path, counts, (source,))


def streamed_counters(totals: DataFrame, *, source: str = "source") -> DataFrame:
    """``prep_counters`` over all rows that ``counter_totals`` has taken in: per source, and in total (null source)."""
    return totals.rollup(source).agg(*[F.sum(c).alias(c) for c in ("total", "processed", "failed_samples")])


@dataclass(frozen=True)
class StreamSample:
    """The ``n`` rows with the smallest hash of their key among all that have arrived, below ``path``.

    The sample of what was sampled before and of what is new is the sample of all.
    Rows whose hash lies above the largest one kept are left out as they are read.
    """

    path: str
    n: int
    key: Sequence[str]
    seed: int = SAMPLE_SEED

    @property
    def state(self) -> MicroState:
        return MicroState(self.path)

    def add(self, rows: DataFrame, micro: int) -> None:
        """Take in one micro-batch."""
        spark, state = rows.sparkSession, self.state
        due, done = state.due(spark, micro)
        if not due:
            return
        if done is not None:
            bound = state.mark(spark, done)["bound"]
            if bound is not None:
                rows = rows.where(order_hash(self.key, self.seed) <= bound)
            rows = spark.read.schema(rows.schema).parquet(f"{state.folder(done)}/rows").unionByName(rows)
        # The micro-batch's rows are read once for their hashes and once for the sample.
        subsample(rows, self.n, key=self.key, seed=self.seed).write.mode("overwrite").parquet(f"{state.folder(micro)}/rows")
        kept = spark.read.schema(rows.schema).parquet(f"{state.folder(micro)}/rows")
        last = kept.agg(F.count("*").alias("n"), F.max(order_hash(self.key, self.seed)).alias("bound")).first()
        state.finish(spark, micro, bound=last["bound"] if last["n"] >= self.n else None)

    def run(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take in what has arrived on a stream, and stop."""
        return run_available(stream, self.add, checkpoint)

    def read(self, spark: SparkSession) -> DataFrame:
        """The sample of all micro-batches that are completely written."""
        done = self.state.committed(spark)
        if done is None:
            raise ValueError(f"no micro-batch has been written to {self.path!r}")
        return spark.read.parquet(f"{self.state.folder(done)}/rows")
