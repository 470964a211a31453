"""Time the headline jobs and print one JSON line.

BENCH_SF_DIR   tables to run on (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_REPEATS  runs per job; the best counts (default 5)

Stored inputs (raw audio, encoded rows, token sequences) are written before the clock
starts, because the jobs read datasets that already exist.  Every job runs to a
sink that takes whole rows, so no column is pruned away.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Column, DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from voxloom.catalog import QUERIES  # noqa: E402
from voxloom.catalog import fixtures, preparation  # noqa: E402
from voxloom.catalog.decoding import damaged  # noqa: E402
from voxloom.functions.vectors import dtw_similarity  # noqa: E402
from voxloom.operators.report import prep_counters  # noqa: E402
from voxloom.plans import decoding, training  # noqa: E402
from voxloom.plans.preparation import prepare_sources  # noqa: E402
from voxloom.session import local_session, scratch_path  # noqa: E402
from voxloom.sources.readers import load_raw_audio  # noqa: E402
from voxloom.sources.writers import publish_encoded  # noqa: E402
from voxloom.specs import BuildRequest, CategoricalFilter, EncodedSource  # noqa: E402

REGISTERED = (
    "subsample_max_len",
    "global_shuffle",
    "assign_batches",
    "mean_pool",
    "cosine_similarity",
    "dtw_similarity",
    "evaluate_pairs",
)


def build_request() -> BuildRequest:
    """One source as it is under a fixed speaker, one sampled."""
    return BuildRequest(
        [
            EncodedSource(
                "bench/documents",
                key_column="doc_id",
                categorical_filter=CategoricalFilter("lang", "en"),
                speaker_id="Robin",
            ),
            EncodedSource("bench/documents", key_column="doc_id", max_len=2000),
        ],
        per_device_train_batch_size=8,
    )


def long_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices as large as those of half a minute of speech: 13 features by 1300 frames, of every hundredth vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 100 = 0")

    def matrix(shift: int) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(12)),
            lambda k: F.transform(
                F.sequence(F.lit(0), F.lit(1299)),
                lambda t: F.get("embedding", ((t * (k + 1) + shift * t) % 64).cast("int")).cast("double"),
            ),
        )

    return vectors.select("vec_id", matrix(0).alias("a"), matrix(1).alias("b"))


def jobs(spark: SparkSession, sf_dir: str, cpus: int) -> dict[str, Callable[[], DataFrame]]:
    root = scratch_path(spark, "bench")
    publish_encoded(fixtures.encoded(spark, sf_dir).repartition(cpus), root, "bench/documents")
    sequences = f"{root}/sequences"
    damaged(spark, sf_dir).repartition(cpus).write.parquet(sequences)
    raw = {
        "spoken": preparation.spoken(spark, sf_dir),
        "decoded": preparation.decoded(spark, sf_dir),
        "chat": preparation.chat(spark, sf_dir),
    }
    for name, df in raw.items():
        publish_encoded(df.repartition(cpus), root, name)

    def prepared() -> DataFrame:
        specs = (preparation.SPOKEN, preparation.DECODED, preparation.CHAT)
        stored = [(load_raw_audio(spark, root, name), spec) for name, spec in zip(raw, specs)]
        return prepare_sources(stored, fixtures.load_sum_encoder, loader=preparation.LOADER, key="key")

    request = build_request()
    found: dict[str, Callable[[], DataFrame]] = {
        "build_training_set": lambda: training.build_training_set(spark, request, root),
        "make_batches": lambda: training.make_batches(spark, request, root),
        "prepare_sources": prepared,
        "prep_counters": lambda: prep_counters(prepared()),
        "decode_sequences": lambda: decoding.decode_sequences(spark.read.parquet(sequences)),
    }
    long_pairs(spark, sf_dir).repartition(cpus).write.parquet(f"{root}/long-pairs")
    found["dtw_long"] = lambda: spark.read.parquet(f"{root}/long-pairs").select("vec_id", dtw_similarity("a", "b"))
    found["run_build"] = lambda: training.run_build(spark, request, root, f"{root}/built")
    for name in REGISTERED:
        found[name] = lambda name=name: QUERIES[name](spark, sf_dir)
    return found


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "5"))
    spark = local_session(cpus, shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")

    seconds: dict[str, float] = {}
    for name, job in jobs(spark, sf_dir, cpus).items():
        runs = []
        for _ in range(repeats):
            start = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
