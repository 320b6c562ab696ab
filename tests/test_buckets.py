"""Tables in hash buckets."""
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from thriftline.plans.workspace import new_path
from thriftline.sources import buckets, tables


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, v int")


def content(spark, path, df):
    return sorted((str(r["k"]), r["v"]) for r in buckets.bucketed_read(spark, path, df.schema).collect())


def test_untouched_buckets_keep_their_files(spark):
    path = new_path(spark, "b")
    old = spark.range(1000).select(F.col("id").cast("string").alias("k"), F.lit(0).alias("v"))
    assert buckets.bucketed_upsert(old, path, "k", old.schema, buckets=16) == 1
    before = set(buckets.bucketed_read(spark, path, old.schema).inputFiles())
    new = table(spark, [("7", 1), ("new", 2)])
    touched = {r[0] for r in new.select(buckets.bucket_of("k", 16)).collect()}
    assert buckets.bucketed_upsert(new, path, "k", old.schema, buckets=999) == 2  # the number of buckets stays
    after = set(buckets.bucketed_read(spark, path, old.schema).inputFiles())
    assert len(before - after) == len(after - before) == len(touched) and len(before & after) == 16 - len(touched)
    want = tables.merge_upsert(old, new, "k")
    assert content(spark, path, old) == sorted((r["k"], r["v"]) for r in want.collect())
    asked = table(spark, [("7", 0), ("none", 0)])
    found = buckets.bucketed_read(spark, path, old.schema, asked, "k")
    assert [tuple(r) for r in found.collect()] == [("7", 1)] and len(found.inputFiles()) <= 4
    assert len(set(r["folder"] for r in buckets.bucket_manifest(spark, path, 1).collect()) & set(
        r["folder"] for r in buckets.bucket_manifest(spark, path).collect())) == 16 - len(touched)


def test_feed_reads_written_buckets_only(spark):
    path, day = new_path(spark, "b"), "TIMESTAMP '2024-01-01 00:00:00.000001'"
    old = spark.range(500).select("id", F.expr(day).alias("at"))
    buckets.bucketed_upsert(old, path, "id", old.schema, buckets=16)
    new = spark.range(499, 501).select("id", F.expr(f"{day} + INTERVAL '0.000001' SECOND").alias("at"))
    buckets.bucketed_upsert(new, path, "id", old.schema)
    buckets.bucketed_upsert(old.filter("id = 3"), path, "id", old.schema)  # written, but nothing differs
    feed = buckets.bucketed_feed(spark, path, "id", old.schema, 1)
    full = tables.change_feed(old, tables.merge_upsert(old, new, "id"), "id")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(feed) == key(full) and feed.count() == 3  # one insert, two images of a change of a microsecond
    assert len(feed.inputFiles()) <= 6
    assert buckets.bucketed_feed(spark, path, "id", old.schema, 2, 3).isEmpty()
    assert buckets.bucketed_feed(spark, path, "id", old.schema, 2, 2).isEmpty()


def test_null_keys_repeated_keys_and_empty_sources(spark):
    path = new_path(spark, "b")
    first = table(spark, [(None, 1), ("a", 1)])
    assert buckets.bucketed_upsert(first.limit(0), path, "k", first.schema, buckets=4) == 1
    assert content(spark, path, first) == []
    buckets.bucketed_upsert(first, path, "k", first.schema, buckets=4, files=3)
    buckets.bucketed_upsert(table(spark, [(None, 2)]), path, "k", first.schema)
    assert content(spark, path, first) == [("None", 2), ("a", 1)]
    version = buckets.bucketed_upsert(first.limit(0), path, "k", first.schema)
    assert version == buckets.bucketed_upsert(first.limit(0), path, "k", first.schema)  # nothing is written
    with pytest.raises(ValueError, match="several source rows"):
        buckets.bucketed_upsert(table(spark, [("a", 1), ("a", 2)]), path, "k", first.schema)
    with pytest.raises(ValueError, match="not in the table schema"):
        buckets.bucketed_upsert(first.withColumn("w", F.lit(1)), path, "k", first.schema)


def test_two_writers_lose_nothing(spark):
    path = new_path(spark, "b")
    start = table(spark, [("a", 0), ("b", 0)])
    buckets.bucketed_upsert(start, path, "k", start.schema, buckets=2)
    with ThreadPoolExecutor(2) as pool:
        done = list(pool.map(lambda k: buckets.bucketed_upsert(table(spark, [(k, 1)]), path, "k", start.schema, attempts=8), "ab"))
    assert sorted(done) == [2, 3] and content(spark, path, start) == [("a", 1), ("b", 1)]


def test_a_lost_writers_claim(spark, monkeypatch):
    path = new_path(spark, "b")
    start = table(spark, [("a", 0)])
    buckets.bucketed_upsert(start, path, "k", start.schema, buckets=2)
    assert not buckets.release_claim(spark, path)
    with monkeypatch.context() as patch:  # claimed, but the manifest never comes
        patch.setattr(buckets, "MANIFEST", "not a schema (")
        with pytest.raises(Exception):
            buckets.bucketed_upsert(table(spark, [("a", 1)]), path, "k", start.schema)
    assert content(spark, path, start) == [("a", 0)]
    with pytest.raises(buckets.ConcurrentWrite):
        buckets.bucketed_upsert(table(spark, [("a", 2)]), path, "k", start.schema, attempts=1)
    assert buckets.release_claim(spark, path)
    assert buckets.bucketed_upsert(table(spark, [("a", 2)]), path, "k", start.schema) == 2
    assert content(spark, path, start) == [("a", 2)]
