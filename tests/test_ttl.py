"""The batch TTL cache against a fold over each key's requests."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kbspark.operators import dialogue


def fold(rows, ttl):
    """rows: (request_id, key, seconds) -> {request_id: hit}."""
    out, written = {}, {}
    for i, k, s in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        written[k], out[i] = dialogue.ttl_step(written.get(k), s, ttl)
    return out | {i: False for i, _, s in rows if s is None}


def cached(spark, rows, ttl):
    df = spark.createDataFrame([(i, k, None if s is None else datetime(2024, 1, 1) + timedelta(seconds=s)) for i, k, s in rows], "request_id long, key string, ts timestamp")
    got = dialogue.ttl_cache(df, ttl).collect()
    assert len(got) == len(rows)
    return {r.request_id: r.hit for r in got}


@pytest.mark.parametrize(("ttl", "span"), [(100, 3000), (7, 4000), (5000, 3000)])
def test_equals_fold(spark, ttl, span):
    rng = random.Random(ttl)
    rows = [(n, None if n % 50 == 3 else "hot" if n % 2 else f"k{rng.randrange(40)}", rng.choice([rng.randrange(span), rng.randrange(span) // 60 * 60])) for n in range(600)]
    assert cached(spark, rows, ttl) == fold(rows, ttl)


def test_moments_at_the_end_of_a_life_and_requests_without_a_time(spark):
    rows = [(1, "a", 0), (2, "a", 99), (3, "a", 100), (4, "a", 199.999999), (5, "a", 200), (6, "a", 200), (7, "b", 5), (8, "b", None), (9, "a", 10_000)]
    assert cached(spark, rows, 100) == fold(rows, 100) == {1: False, 2: True, 3: False, 4: True, 5: False, 6: True, 7: False, 8: False, 9: False}
    assert not any(cached(spark, rows, 0).values())
    assert cached(spark, [], 100) == {}


def test_a_hot_key_takes_many_tasks(spark):
    """Half of all requests have one key; no partition of the windows over them holds most of its moments."""
    points = spark.range(8000).select(F.struct((F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string"))).alias("key")).alias("entry"), (F.col("id") * 1_000_000).alias("us"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        held = dialogue._first_from(points, {"next": 600_000_000}, 10_000_000).where("entry.key = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(held) == 4 and max(r["count"] for r in held) < 2000
