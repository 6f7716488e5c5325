from pyspark.sql import functions as F

from cotejo.llm import sharding


def jump(key, n):
    """The published algorithm in plain integers."""
    key %= 1 << 64
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one(spark):
    keys = [0, 1, 2, 7, 10**12, -1, -(1 << 63), (1 << 63) - 1, *range(100, 300)]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    for n in (1, 2, 8, 9, 1000):
        got = {r.k: r.shard for r in sharding.assign_shards(df, "k", n).collect()}
        assert got == {k: jump(k, n) for k in keys}


def test_one_more_shard_moves_only_into_itself(spark):
    df = spark.range(5000)
    both = sharding.assign_shards(sharding.assign_shards(df, "id", 8), "id", 9, shard_col="grown")
    moved = both.where("shard <> grown")
    assert moved.where("grown <> 8").count() == 0
    assert 350 < moved.count() < 800


def test_slots_are_gapless_with_repeats_nulls_and_clashing_columns(spark):
    rows = [(None, "a"), (None, "a"), (5, "x"), (5, "x"), (5, "y"), *[(i, "t") for i in range(200)]]
    df = spark.createDataFrame(rows, "id bigint, t string").withColumns({"shard": F.lit(99), "slot": F.lit(-1), "count": F.lit(0)})
    out = sharding.number_slots(sharding.assign_shards(df, "id", 3), "shard", ["id", "t"]).collect()
    assert len(out) == len(rows)
    for s in range(3):
        own = sorted((r.slot, r.id) for r in out if r.shard == s)
        assert [x[0] for x in own] == list(range(len(own)))
        assert [x[1] for x in own] == sorted((x[1] for x in own), key=lambda v: -1 if v is None else v)


def test_string_keys_and_empty_tables(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("",)], "k string")
    got = {}
    for r in sharding.assign_shards(df, "k", 4).collect():
        got.setdefault(r.k, set()).add(r.shard)
    assert all(len(v) == 1 for v in got.values())
    empty = sharding.assign_shards(df.limit(0), "k", 4)
    assert sharding.number_slots(empty, "shard", ["k"]).count() == 0
