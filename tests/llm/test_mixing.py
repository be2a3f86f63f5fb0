import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcquarry.llm.mixing import draw_counts, mix_blocks, mix_report, mix_slots, permute, plan_mix, sized_records, slot_sources, token_blocks
from srcquarry.llm.running import running_sum
from srcquarry.tables import cut


def test_permutation():
    for n in (1, 2, 7, 64, 1000):
        assert sorted(permute(np.arange(n), n, 99)) == list(range(n))
    assert list(permute(np.arange(1000), 1000, 1)) != list(permute(np.arange(1000), 1000, 2))


def test_draws_have_the_target_mean():
    shares = [0.5, 0.301, 0.199]
    draws = np.array([draw_counts(k, 100, shares, 7) for k in range(2000)])
    assert (draws.sum(1) == 100).all() and np.allclose(draws.mean(0), [50, 30.1, 19.9], atol=0.6)
    assert np.allclose(draws.var(0), [25, 21.04, 15.94], rtol=0.15)  # of a multinomial distribution
    assert (draw_counts(5, 100, shares, 7) == draws[5]).all()
    of = slot_sources(5, draws[5], 7)
    assert (np.bincount(of, minlength=3) == draws[5]).all() and (np.diff(of) != 0).sum() > 30


def test_running_sum(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.randrange(9)) for g in "ab" for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    got = running_sum(df, group=["g"], order=["i"], value="v", name="s", bucket=F.floor(F.col("i") / 37), total="t").collect()
    for r in got:
        own = [v for g, i, v in rows if g == r.g]
        assert r.s == sum(own[: r.i]) and r.t == sum(own)


def test_blocks_hold_every_token_once(spark):
    rng = random.Random(2)
    rows = [(i, "s" if i % 3 else "t", rng.choice([0, 1, 5, 40, 1300])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, source string, n_tokens long")
    got = token_blocks(df, key="id", block=512, bucket_rows=30, n_rows=200).collect()
    size = {}
    for r in got:
        size[r.source, r.block_no] = size.get((r.source, r.block_no), 0) + r.token_end - r.token_start
    for s in "st":
        full = [v for (name, b), v in sorted(size.items()) if name == s]
        assert all(v == 512 for v in full[:-1]) and 0 < full[-1] <= 512
    for i, _, n in rows:
        parts = sorted((r.token_start, r.token_end) for r in got if r.id == i)
        assert sum(b - a for a, b in parts) == n and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a"] * 6 + ["b"] * 3 + ["c"]), "word " * rng.randrange(1, 400), "x") for i in range(1500)] + [(9000, None, "w", ""), (9001, "zz", "w", ""), (9002, "a", None, ""), (9003, "a", "", "")]
    docs = spark.createDataFrame(rows, "id long, source string, text string, tokens string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 1), ("c", 0.28, 4), ("none", 0.02, 9)], "source string, target_share double, max_repeats int")
    sized = cut(sized_records(docs, targets, key="id", text="text", source="source"))
    mixed, plan = mix_blocks(sized, targets, key="id", block=128)
    mixed = mixed.cache()
    slots = mixed.select("shard", "slot", "source", "block_no", "pass_no").distinct().cache()
    assert slots.count() == slots.select("shard", "slot").distinct().count() == slots.select("source", "block_no", "pass_no").distinct().count()
    assert slots.groupBy("shard").agg((F.max("slot") + 1 - F.count("*")).alias("missing")).where("missing <> 0").count() == 0
    report = {r.source: r for r in mix_report(mixed, targets, key="id").collect()}
    assert report["none"].tokens == 0
    for s, share in (("a", 0.5), ("b", 0.2), ("c", 0.28)):
        assert abs(report[s].actual_share - share / 0.98) < 0.03 and 1 <= report[s].most_uses <= report[s].max_repeats
    assert report["c"].most_uses > 1
    again, _ = mix_blocks(sized, targets, key="id", block=128)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, again.collect()))


def test_empty(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    sized = sized_records(spark.createDataFrame([], "id long, source string, text string"), targets, key="id", text="text", source="source")
    mixed, _ = mix_blocks(sized, targets, key="id")
    assert mixed.collect() == [] and mix_report(mixed, targets, key="id").first().tokens == 0


@pytest.mark.parametrize("blocks, share", [(1, 0.01), (1, 0.0003), (60, 0.01), (64, 0.01), (65, 0.0003), (65, 0.01), (200, 0.01)])
def test_scarcest_source_is_used_up_and_ends_the_mix(spark, blocks, share):
    rows = [(i, "small", 512) for i in range(blocks)] + [(1000, "large", 512 * 5_000_000)]
    sized = spark.createDataFrame(rows, "id long, source string, n_tokens long")
    targets = spark.createDataFrame([("small", share, 1), ("large", 1 - share, 1)], "source string, target_share double, max_repeats int")
    slots = mix_slots(spark, plan_mix(sized, targets)).cache()
    used = {r.source: (r.n, r.d) for r in slots.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("block_no").alias("d")).collect()}
    assert used["small"] == (blocks, blocks) and used["large"][0] == used["large"][1]
    n = sum(v[0] for v in used.values())
    assert slots.select("shard", "slot").distinct().count() == n
    assert abs(n - (blocks + 1) / share) < 6 * (blocks + 1) ** 0.5 / share
    slots.unpersist()
