from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from voxloom.operators import batching, sampling


def md5(seed, *key):
    return hashlib.md5(":".join([str(seed), *map(str, key)]).encode()).hexdigest()


def in_hash_order(keys, seed=42):
    return sorted(keys, key=lambda k: (md5(seed, k), k))


@pytest.mark.parametrize("n", [1, 7, 499, 500, 501, 10_000])
def test_subsample_is_the_first_n_in_hash_order(spark, n):
    got = {r.id for r in sampling.subsample(spark.range(500), n, key=["id"]).collect()}
    assert got == set(in_hash_order(range(500))[:n])


def test_subsample_options(spark):
    df = spark.range(50)
    assert sampling.subsample(df, None, key=["id"]) is df
    assert sampling.subsample(df, 50, key=["id"], strict=True).count() == 50
    with pytest.raises(ValueError, match="fewer than 51 rows"):
        sampling.subsample(df, 51, key=["id"], strict=True)
    with pytest.raises(ValueError):
        sampling.subsample(df, 0, key=["id"])
    other = {r.id for r in sampling.subsample(df, 10, key=["id"], seed=7).collect()}
    assert other == set(in_hash_order(range(50), 7)[:10])


def test_subsample_shuffles_no_rows(spark):
    """The rows themselves are filtered in place; only hashes are moved."""
    df = spark.range(1000).withColumn("payload", F.repeat(F.lit("x"), 100))
    plan = sampling.subsample(df, 10, key=["id"])._jdf.queryExecution().optimizedPlan().toString()
    main = plan.split("\n+-")[0]
    assert "Join" not in main and "Sort" not in main


def test_shuffle_is_total_order_across_partitions(spark):
    shuffled = sampling.global_shuffle(spark.range(2000), key=["id"], partitions=8)
    placed = shuffled.withColumn("p", F.spark_partition_id()).collect()
    assert [r.id for r in placed] == in_hash_order(range(2000))
    sizes = [sum(r.p == p for r in placed) for p in range(8)]
    assert min(sizes) > 150  # 250 expected


def test_shard(spark):
    df = sampling.shard(spark.range(1000), 4, key=["id"])
    counts = {r.shard: r["count"] for r in df.groupBy("shard").count().collect()}
    assert set(counts) == {0, 1, 2, 3} and min(counts.values()) > 180


@pytest.mark.parametrize("rows,n", [(10, 3), (9, 3), (2, 5), (1, 1), (32, 32)])
def test_shard_ranges(spark, rows, n):
    got = {r.id: r.shard for r in sampling.shard_ranges(spark.range(rows), n, index="id").collect()}
    small, long = divmod(rows, n)
    want = {}
    start = 0
    for shard in range(n):
        size = small + (shard < long)
        want.update({i: shard for i in range(start, start + size)})
        start += size
    assert got == want


def test_ordered_restore(spark):
    df = sampling.global_shuffle(spark.range(300).withColumn("source_idx", F.col("id") % 2), key=["id"])
    got = [(r.source_idx, r.id) for r in sampling.ordered_restore(df, order=["source_idx", "id"]).collect()]
    assert got == sorted(got)


@pytest.mark.parametrize("rows,size,buckets", [(100, 8, 4), (100, 1, 4), (100, 1000, 4), (5, 2, 16), (64, 8, 1)])
def test_batches_are_consecutive(spark, rows, size, buckets):
    df = batching.assign_batches(spark.range(rows), key=["id"], batch_size=size, buckets=buckets)
    got = {r.id: r.batch_id for r in df.collect()}
    assert got == {k: i // size for i, k in enumerate(in_hash_order(range(rows)))}


@pytest.mark.parametrize("rows,size,buckets", [(200, 8, 4), (200, 7, 16), (3, 8, 8), (64, 64, 2), (200, 1, 4)])
def test_batch_length_over_bucket_borders(spark, rows, size, buckets):
    df = spark.range(rows).withColumn("n", ((F.col("id") * 37) % 101).cast("int"))
    out = batching.with_batch_length(df, key=["id"], batch_size=size, length=F.col("n"), buckets=buckets)
    got = {r.id: (r.batch_id, r.max_length) for r in out.collect()}
    order = in_hash_order(range(rows))
    want = {}
    for b in range(0, rows, size):
        group = order[b : b + size]
        longest = max((k * 37) % 101 for k in group)
        want.update({k: (b // size, longest) for k in group})
    assert got == want


def test_row_copies_get_distinct_places(spark):
    """Many equal texts are no hot spot, because the key is the row's own."""
    df = spark.range(900).withColumn("text", F.when(F.col("id") < 300, F.lit("copy")).otherwise(F.col("id").cast("string")))
    hashed = batching.assign_batches(df, key=["id"], batch_size=9, buckets=6)
    sizes = [r["count"] for r in hashed.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 900 and max(sizes) < 250
    assert hashed.groupBy("batch_id").count().where("count != 9").count() == 0


def test_subsample_is_exact_with_equal_and_null_keys(spark):
    rows = [(k, v) for k, v in zip(["a"] * 10 + [None] * 11 + ["b"], range(22))] + [("c", 100)] * 30
    df = spark.createDataFrame(rows, "k string, v int").repartition(3)
    for n in (1, 3, 10, 11, 12, 21, 22, 25, 40, 51, 52):
        got = [tuple(r) for r in sampling.subsample(df, n, key=["k"]).collect()]
        assert len(got) == n
        kept = [r for r in got if r != ("c", 100)]
        assert len(set(kept)) == len(kept) and set(got) <= set(rows)
        assert sorted(got, key=str) == sorted((tuple(r) for r in sampling.subsample(df.repartition(5), n, key=["k"]).collect()), key=str)
    assert sampling.subsample(df, 53, key=["k"]).count() == 52


def test_equal_keys_spread_over_partitions(spark):
    df = spark.range(0, 4000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("k"))
    plain = sampling.global_shuffle(df, key=["k"], partitions=8, unique=False)
    sizes = [r["count"] for r in plain.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000 and plain.columns == ["id", "k"]
    assert plain.select("id").distinct().count() == 4000


def test_batches_of_equal_keys_keep_every_row_once(spark):
    df = spark.range(0, 1003).select("id", F.when(F.col("id") % 2 == 0, "a").alias("k"), (F.col("id") % 37).alias("n"))
    out = batching.with_batch_length(df, key=["k"], batch_size=7, length=F.col("n"), unique=False, buckets=5)
    rows = out.collect()
    assert sorted(r.id for r in rows) == list(range(1003))
    groups = {}
    for r in rows:
        groups.setdefault(r.batch_id, []).append(r)
    assert sorted(groups) == list(range(144)) and all(len(g) == 7 for b, g in groups.items() if b < 143)
    assert all({r.max_length for r in g} == {max(r.n for r in g)} for g in groups.values())


def test_a_users_own_columns_are_kept(spark):
    df = spark.range(40).selectExpr("id", "id * 2 as _h", "'c' as _content", "id % 3 as _rn", "id as `a.b`")
    for out in (
        sampling.global_shuffle(df, key=["_rn"], unique=False),
        sampling.global_shuffle(df, key=["id"]),
        batching.assign_batches(df, key=["_rn"], batch_size=4, unique=False).drop("batch_id"),
        sampling.subsample(df, 17, key=["_rn"]),
    ):
        assert out.columns == df.columns
        assert {r["_h"] for r in out.collect()} <= set(range(0, 80, 2))


def test_the_sample_reads_contents_of_tied_rows_only(spark, tmp_path):
    """Rows of the n-th hash are told apart by content; without ties no other column is read."""
    spark.range(300).selectExpr("id", "id % 4 as k", "repeat('x', 50) as payload").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    text = sampling.subsample(df, 100, key=["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in text and "Union" not in text
    for n in (1, 74, 75, 76, 150, 299, 300):
        found = sampling.subsample(df, n, key=["k"]).collect()
        assert len({r.id for r in found}) == n
        by_key = {}
        for r in found:
            by_key[r.k] = by_key.get(r.k, 0) + 1
        assert sorted(by_key.values())[:-1] == [75] * (len(by_key) - 1) or sorted(by_key.values(), reverse=True)[:-1] == [75] * (len(by_key) - 1)


def test_the_query_of_equal_keys_returns_every_document(spark, small):
    from voxloom.catalog.sampling import assign_batches_equal_keys

    n = spark.read.parquet(f"{small}/documents.parquet").count()
    got = assign_batches_equal_keys(spark, small).collect()
    assert len({r.doc_id for r in got}) == len(got) == n
    assert {(r.n, r.n_batches, r.in_full_batches) for r in got} == {(n, -(-n // 8), n - n % 8)}
