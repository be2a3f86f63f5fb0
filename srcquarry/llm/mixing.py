"""Mixing sources to target weights.

The tokens of each source are packed into blocks of fixed length. Output shards of a fixed number of slots
draw how many slots each source gets from a multinomial distribution; slots are mapped through pseudorandom
permutations of the source's block numbers, one permutation for each pass over the source, and joined to the
blocks by number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running_sum
from .tokens import DEFAULT_VOCABULARY, with_token_counts

BLOCK_TOKENS = 512
SHARD_SLOTS = 1024
#: Rows in one bucket of a source, on average.
BUCKET_ROWS = 20_000


class Plan(NamedTuple):
    """What the driver holds: a few numbers for each source, however many records there are."""

    sources: list[str]
    shares: list[float]
    blocks: list[int]
    tokens: list[int]
    repeats: list[int]
    slots: int


def draw_counts(shard: int, slots: int, shares: list[float], seed: int) -> np.ndarray:
    """Slots of each source in one shard: a multinomial draw."""
    p = np.asarray(shares, dtype=float)
    return np.random.default_rng([seed, shard]).multinomial(slots, p / p.sum()).astype(np.int64)


def slot_sources(shard: int, counts: np.ndarray, seed: int) -> np.ndarray:
    """The source of each slot of a shard: the drawn counts in random order."""
    return np.random.default_rng([seed, shard, 1]).permutation(np.repeat(np.arange(len(counts)), counts))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 applied to ``index``: a four-round Feistel network, walked until inside."""
    if n <= 1:
        return np.zeros_like(index)
    half = max(1, math.ceil(math.log2(n) / 2))
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    x = index.astype(np.uint64)
    todo = np.ones(len(x), dtype=bool)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right = x[todo] >> shift, x[todo] & mask
            for r in range(4):
                k = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xBF58476D1CE4E5B9) % 2**64)
                h = (right ^ k) * np.uint64(0xFF51AFD7ED558CCD)
                h ^= h >> np.uint64(33)
                h *= np.uint64(0xC4CEB9FE1A85EC53)
                h ^= h >> np.uint64(29)
                left, right = right, left ^ (h & mask)
            x[todo] = (left << shift) | right
            todo = x >= np.uint64(n)
    return x.astype(np.int64)


def _source_key(source: str, epoch: int, seed: int) -> int:
    h = 0xCBF29CE484222325
    for b in f"{seed}:{epoch}:{source}".encode():
        h = ((h ^ b) * 0x100000001B3) % 2**64
    return h


def token_blocks(sized: DataFrame, *, key: str, block: int = BLOCK_TOKENS, bucket_rows: int = BUCKET_ROWS, n_rows: int) -> DataFrame:
    """Parts of records in blocks: ``source``, ``block_no`` (from 0), key, ``token_start``, ``token_end``.

    ``sized`` has key, source and ``n_tokens``. Records of a source stand one after the other; a record that
    reaches over a block's end goes on in the next block. The last block of a source may be short. Records
    without tokens are in no block.
    """
    buckets = max(1, -(-n_rows // bucket_rows))
    placed = running_sum(
        sized.where(F.col("n_tokens") > 0),
        group=["source"],
        order=[key],
        value="n_tokens",
        name="at",
        bucket=F.pmod(F.xxhash64(key, "n_tokens"), F.lit(buckets)),
    )
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("n_tokens") - 1) / block)
    parts = placed.select("source", key, "at", "n_tokens", F.explode(F.sequence(first, last)).alias("block_no"))
    start = F.greatest(F.col("block_no") * block - F.col("at"), F.lit(0))
    end = F.least((F.col("block_no") + 1) * block - F.col("at"), F.col("n_tokens"))
    return parts.select("source", F.col("block_no").cast("bigint").alias("block_no"), key, start.cast("bigint").alias("token_start"), end.cast("bigint").alias("token_end"))


def plan_mix(sized: DataFrame, targets: DataFrame, *, block: int = BLOCK_TOKENS) -> Plan:
    """What each source has and may give, and a bound of the slots of the mix.

    The mix ends where its scarcest source is used up (see ``mix_slots``); that is near the least capacity over
    share, and ``slots`` lies far enough above it for the spread of the draws. Sources without tokens cannot
    contribute; their shares go to the others in proportion.
    """
    sums = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    rows = targets.join(sums, "source").where((F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)).orderBy("source").collect()
    if not rows:
        return Plan([], [], [], [], [], 0)
    total = sum(r["target_share"] for r in rows)
    shares = [r["target_share"] / total for r in rows]
    blocks = [-(-int(r["tokens"]) // block) for r in rows]
    repeats = [int(r["max_repeats"]) for r in rows]
    slots = min(math.ceil((c + 12 * math.sqrt(c) + 40) / s) for c, s in zip((b * k for b, k in zip(blocks, repeats)), shares))
    return Plan([r["source"] for r in rows], shares, blocks, [int(r["tokens"]) for r in rows], repeats, slots)


_SLOTS = "shard bigint, slot bigint, source string, block_no bigint, pass_no int"


def mix_slots(spark, plan: Plan, *, seed: int = 7, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Slots of the mix: ``shard``, ``slot``, ``source``, ``block_no``, ``pass_no`` (from 0).

    Shards of equal size draw their counts, and the order of their slots, one after the other without end; the mix
    is all slots before the first one that would exceed its source's repeats. So every slot number is taken
    once, none is left out, and no source is used more often than it may be.
    """
    if not plan.slots:
        return spark.createDataFrame([], _SLOTS)
    shards = -(-plan.slots // shard_slots)
    sources, shares, blocks = plan.sources, plan.shares, plan.blocks
    capacity = [b * k for b, k in zip(blocks, plan.repeats)]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = b.column(0).to_pylist()
            counts = [draw_counts(k, shard_slots, shares, seed) for k in shard]
            n = len(sources)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.asarray(shard, dtype=np.int64), n)),
                    pa.array(np.tile(np.arange(n, dtype=np.int32), len(shard))),
                    pa.array(np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)),
                ],
                ["shard", "source_no", "n"],
            )

    counts = spark.range(shards).mapInArrow(draw, "shard bigint, source_no int, n bigint")
    placed = running_sum(counts, group=["source_no"], order=["shard"], value="n", name="at", bucket=F.floor(F.col("shard") / 4096))
    full = F.array(*[F.lit(c) for c in capacity])[F.col("source_no")]
    last = placed.where(F.col("at") + F.col("n") > full).agg(F.min("shard").alias("s")).first()["s"]
    starts = F.transform(F.array_sort(F.collect_list(F.struct("source_no", "at"))), lambda x: x["at"])  # one entry for each source
    used = (placed.where(F.col("shard") <= last) if last is not None else placed).groupBy("shard").agg(starts.alias("starts"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                of = slot_sources(k, draw_counts(k, shard_slots, shares, seed), seed)
                index = np.empty(len(of), dtype=np.int64)
                for i in range(len(sources)):
                    own = of == i
                    index[own] = at[i] + np.arange(int(own.sum()))
                over = np.flatnonzero(index >= np.asarray(capacity)[of])
                n = int(over[0]) if len(over) else len(of)
                of, index = of[:n], index[:n]
                size = np.asarray(blocks, dtype=np.int64)[of]
                pass_no, number = index // size, index % size
                for i in np.unique(of):
                    for p in np.unique(pass_no[of == i]):
                        own = (of == i) & (pass_no == p)
                        number[own] = permute(number[own], blocks[i], _source_key(sources[i], int(p), seed))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, k, dtype=np.int64)),
                        pa.array(np.arange(n, dtype=np.int64)),
                        pa.array(np.asarray(sources, dtype=object)[of], pa.string()),
                        pa.array(number),
                        pa.array(pass_no.astype(np.int32)),
                    ],
                    ["shard", "slot", "source", "block_no", "pass_no"],
                )

    return used.mapInArrow(fill, _SLOTS)


def sized_records(documents: DataFrame, targets: DataFrame, *, key: str, text: str, source: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """key, ``source``, ``n_tokens`` of the records whose source has a target; others take no part."""
    named = documents.select(F.col(key).alias(key), F.col(source).alias("source"), F.col(text).alias("__body"))
    known = named.join(targets.select("source").distinct(), "source", "left_semi")
    return with_token_counts(known, keep=[key, "source"], text="__body", path=vocabulary)


def mix_blocks(sized: DataFrame, targets: DataFrame, *, key: str, seed: int = 7, block: int = BLOCK_TOKENS) -> tuple[DataFrame, Plan]:
    """The mix: ``shard``, ``slot``, ``source``, ``block_no``, ``pass_no``, key, ``token_start``, ``token_end``.

    ``sized`` comes from ``sized_records`` and should be cut or cached, as it is read several times. Each
    source contributes its share of the slots; a block, and so every token of a record, is used at most
    ``max_repeats`` times. Null or unknown sources, null and empty texts take no part; a source without
    records leaves its share to the others; an empty table gives an empty mix. Repeated keys are distinct
    records. Blocks and slots are joined on (source, number), which spreads a dominant source evenly.
    """
    plan = plan_mix(sized, targets, block=block)
    slots = mix_slots(sized.sparkSession, plan, seed=seed)
    blocks = token_blocks(sized, key=key, block=block, n_rows=sized.count())
    mixed = slots.join(blocks, ["source", "block_no"])
    return mixed.select("shard", "slot", "source", "block_no", "pass_no", key, "token_start", "token_end"), plan


def mix_report(mixed: DataFrame, targets: DataFrame, *, key: str) -> DataFrame:
    """Per source: ``target_share``, ``actual_share`` of all tokens, ``tokens``, ``records``, ``most_uses``, ``max_repeats``."""
    uses = mixed.groupBy("source", key, "token_start", "token_end").agg(F.count("*").alias("uses"))
    per = (
        uses.groupBy("source", key)
        .agg(F.max("uses").alias("uses"), F.sum(F.col("uses") * (F.col("token_end") - F.col("token_start"))).alias("tokens"))
        .groupBy("source")
        .agg(F.count("*").alias("records"), F.max("uses").alias("most_uses"), F.sum("tokens").alias("tokens"))
    )
    total = per.agg(F.sum("tokens").alias("t")).first()["t"] or 1
    return (
        targets.select("source", "target_share", "max_repeats")
        .join(per, "source", "left")
        .select(
            "source",
            "target_share",
            (F.coalesce("tokens", F.lit(0)) / F.lit(total)).alias("actual_share"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("records", F.lit(0)).alias("records"),
            F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
            "max_repeats",
        )
    )
