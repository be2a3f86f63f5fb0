"""Filling fixed-capacity containers with items: best-two-fit.

Items are spread over shards of bounded size by a hash; each shard is packed in one task. A container is
filled greedily with the largest items that fit. Then its smallest item is taken out again if two unpacked
items fit the gap and its place more tightly together. Sizes are counted by value, so one step costs a scan
over sizes, not over items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .tokens import DEFAULT_VOCABULARY, cut_to

#: Items in one shard, on average; the space left in a shard's last container is all that sharding costs.
SHARD_ITEMS = 8_000


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of positions in ``sizes``; every size is at most ``capacity``.

    Items of size 0 go to the first container. Equal sizes are taken in their order, so the result depends
    on the input order only.
    """
    zero = [i for i, s in enumerate(sizes) if s == 0]
    stacks: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        if sizes[i] > 0:
            stacks.setdefault(sizes[i], []).append(i)
    have = np.zeros(capacity + 2, dtype=np.int64)
    for s, stack in stacks.items():
        have[s] = len(stack)
    left = int(have.sum())
    present = np.flatnonzero(have)

    def largest(limit: int) -> int:
        if limit <= 0 or not len(present):
            return 0
        k = int(np.searchsorted(present, limit, side="right")) - 1
        while k >= 0 and have[present[k]] == 0:
            k -= 1
        return int(present[k]) if k >= 0 else 0

    def take(size: int) -> int:
        nonlocal left, present
        have[size] -= 1
        left -= 1
        if have[size] == 0 and np.count_nonzero(have[present]) * 2 < len(present):
            present = present[have[present] > 0]
        return stacks[size].pop()

    def put(size: int, item: int) -> None:
        nonlocal left, present
        if have[size] == 0 and not (present == size).any():
            present = np.sort(np.append(present, size))
        have[size] += 1
        left += 1
        stacks[size].append(item)

    bins: list[list[int]] = []
    while left:
        inside: list[tuple[int, int]] = []
        gap = capacity
        while s := largest(gap):
            inside.append((s, take(s)))
            gap -= s
        while gap and left and inside:
            small, item = min(inside)
            room = gap + small
            first = present[(present <= room) & (have[present] > 0)]
            if not len(first):
                break
            second_limit = room - first
            k = np.searchsorted(first, second_limit, side="right") - 1
            ok = k >= 0
            a, b = first[ok], first[np.maximum(k[ok], 0)]
            same = (a == b) & (have[a] < 2)
            a, b = a[~same], b[~same]
            if not len(a):
                break
            best = int(np.argmax(a + b))
            x, y = int(a[best]), int(b[best])
            if x + y <= small:
                break
            inside.remove((small, item))
            inside += [(x, take(x)), (y, take(y))]
            put(small, item)
            gap = room - x - y
        bins.append([i for _, i in inside])
    if zero:
        if not bins:
            bins.append([])
        bins[0] += zero
    return bins


def pack_documents(
    documents: DataFrame,
    *,
    key: str,
    text: str,
    capacity: int,
    vocabulary: str = DEFAULT_VOCABULARY,
    shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """Containers of at most ``capacity`` tokens: ``container_id``, ``n_tokens``, ``n_items``, ``items``.

    ``items`` holds key, ``part`` (from 1), ``parts``, ``n_tokens`` and ``text``. A text larger than a
    container is cut into parts that fit, each but the last nearly as large as a container; no other text
    is cut. Sizes are those of the very texts given out. Null texts count as empty; empty texts have size 0
    and are put in all the same. An empty table gives no containers; repeated rows are packed each. Only
    the named columns are read.

    The number of shards follows the number of rows, so a shard stays bounded however large the table is, and a
    hash of the key and the row's place in its task spreads rows evenly, however often a key or row is repeated.
    """
    n = documents.count()
    shards = max(1, -(-n // shard_items))
    src = documents.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    key_type = src.schema["k"].dataType.simpleString()
    arrow_key = to_arrow_type(src.schema["k"].dataType)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            keys, part, parts, sizes, texts = [], [], [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                pieces = [("", 0)] if not t else cut_to(t, capacity, vocabulary)
                for i, (piece, size) in enumerate(pieces):
                    keys.append(k)
                    part.append(i + 1)
                    parts.append(len(pieces))
                    sizes.append(size)
                    texts.append(piece)
            at = pa.array(range(seen, seen + len(keys)), pa.int64())
            seen += len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, arrow_key), pa.array(part, pa.int32()), pa.array(parts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(texts, pa.string()), at],
                ["k", "part", "parts", "size", "t", "at"],
            )

    pieces = src.mapInArrow(cut, f"k {key_type}, part int, parts int, size int, t string, at bigint").withColumn(
        "shard", F.pmod(F.xxhash64("k", "at"), F.lit(shards)).cast("int")
    ).drop("at")
    item_type = pa.struct([(key, arrow_key), ("part", pa.int32()), ("parts", pa.int32()), ("n_tokens", pa.int32()), ("text", pa.string())])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("k", "ascending"), ("part", "ascending")])
        sizes = table.column("size").to_pylist()
        shard = table.column("shard")[0].as_py()
        bins = best_two_fit(sizes, capacity)
        flat = [i for b in bins for i in b]
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in bins])]).astype(np.int32)
        took = table.take(pa.array(flat, pa.int64())).combine_chunks()
        column = lambda c, t: took.column(c).combine_chunks().cast(t) if took.num_rows else pa.array([], t)
        items = pa.StructArray.from_arrays(
            [column("k", arrow_key), column("part", pa.int32()), column("parts", pa.int32()), column("size", pa.int32()), column("t", pa.string())],
            fields=list(item_type),
        )
        return pa.table(
            {
                "container_id": pa.array([f"{shard}-{i}" for i in range(len(bins))], pa.string()),
                "n_tokens": pa.array([sum(sizes[i] for i in b) for b in bins], pa.int32()),
                "n_items": pa.array([len(b) for b in bins], pa.int32()),
                "items": pa.ListArray.from_arrays(pa.array(offsets), items),
            }
        )

    schema = f"container_id string, n_tokens int, n_items int, items array<struct<`{key}`:{key_type},part:int,parts:int,n_tokens:int,text:string>>"
    return pieces.groupBy("shard").applyInArrow(pack, schema)
