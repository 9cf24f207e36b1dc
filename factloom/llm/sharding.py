"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups are rows of equal texts (all null texts are one group). They are taken by size, largest first; each enters the
shard with the least remaining capacity that still holds it, found in a balanced tree. What comes to the driver is the
histogram of exact group sizes: different sizes of a total of T bytes are fewer than the square root of 2 T, for a
hundred terabytes 14 million at the very most. Groups of one size are placed in bulk, which is what best fit does with
them: the tightest shard stays the tightest until it is full. Groups find their shard by size and rank.

With a capacity, no shard holds more than it, but for one that holds a single group larger than the capacity. Without
one, a group larger than an even share can't be divided and gets a shard of its own; the rest is spread evenly over the
other shards. A size is the UTF-8 bytes of the text, none for null, plus 16. Repeated rows are rows of their own; ties
among groups go by digest. Empty tables give no rows. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import checkpointed, joined, numbered, small

OVERHEAD = 16


class Tree:
    """A treap of (remaining, shard), balanced by a digest of the key."""

    def __init__(self):
        self.top = None

    @staticmethod
    def _weight(key):
        return hashlib.blake2b(repr(key).encode(), digest_size=8).digest()

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return (node[0], node[1], node[2], low), high
        low, high = self._split(node[2], key)
        return low, (node[0], node[1], high, node[3])

    def _joined(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return a[0], a[1], a[2], self._joined(a[3], b)
        return b[0], b[1], self._joined(a, b[2]), b[3]

    def add(self, key) -> None:
        low, high = self._split(self.top, key)
        self.top = self._joined(self._joined(low, (key, self._weight(key), None, None)), high)

    def remove(self, key) -> None:
        low, high = self._split(self.top, key)
        _, high = self._split(high, (key[0], key[1] + 1))
        self.top = self._joined(low, high)

    def tightest(self, size: float):
        """The least key with `size` remaining or more."""
        node, best = self.top, None
        while node is not None:
            if node[0][0] >= size:
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best

    def roomiest(self):
        node = self.top
        while node[3] is not None:
            node = node[3]
        return node[0]


def best_fit(items: list[tuple[float, int]], shards: int, capacity: float | None = None) -> tuple[list[list[tuple[int, int]]], int]:
    """For each of items (size, count), largest first: how many go to which shard, in order; and the shards used.

    With a capacity, shards are opened as needed. Without one there are `shards` of them, with an even share each but
    for items that are larger than that, and what fits nowhere for want of a gap goes to the emptiest.
    """
    out: list[list[tuple[int, int]]] = []
    tree, used, rest = Tree(), 0, sum(s * n for s, n in items)
    if capacity is None:
        for size, n in items:
            own = []
            while n and shards - used > 1 and size > rest / (shards - used):
                own.append((used, 1))
                used, rest, n = used + 1, rest - size, n - 1
            out.append(own)
            if n:
                break
        capacity, fixed = rest / max(1, shards - used), True
        for k in range(used, shards):
            tree.add((capacity, k))
        used = shards
    else:
        fixed = False
    for k, (size, n) in enumerate(items):
        if k == len(out):
            out.append([])
        n -= sum(c for _, c in out[k])
        while n:
            at = tree.tightest(size)
            if at is None and not fixed:
                at = (max(capacity, size), used)
                used += 1
            elif at is None:
                at = tree.roomiest()
                tree.remove(at)
                fit = 1
            else:
                tree.remove(at)
                fit = n
            if at[0] >= size > 0:
                fit = min(n, int(at[0] // size))
            fit = max(1, min(n, fit if at[0] >= size else 1))
            out[k].append((at[1], fit))
            tree.add((at[0] - fit * size, at[1]))
            n -= fit
    return out, used


def sized(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, digest of the group) of each row."""
    text = F.col(text_column).cast("string")
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("digest"),
    )


def sharded(docs: DataFrame, shards: int = 40, capacity: int | None = None) -> DataFrame:
    """Rows with shard and a slot in it; with a capacity, as few shards as best fit needs, else `shards` even ones."""
    spark = docs.sparkSession
    rows = checkpointed(sized(docs))
    groups = checkpointed(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    items = sorted(((r["bytes"], r["n"]) for r in groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    places, _ = best_fit(items, shards, capacity)
    ranges = []
    for (size, _), place in zip(items, places):
        low = 0
        for shard, n in place:
            ranges.append((size, low, low + n, shard))
            low += n
    ranks = numbered(groups, ["bytes"], ["digest"], "rank")
    spans = small(spark.createDataFrame(ranges, "of long, low long, high long, shard int"), len(ranges))
    on = (F.col("bytes") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = checkpointed(ranks.join(spans, on).select("digest", "n", "shard"))
    found = joined(rows, placed, "digest", rows.count())
    return numbered(checkpointed(found.drop("digest")), ["shard"], ["doc_id"], "slot")


def by_bytes(docs: DataFrame, shards: int = 40) -> DataFrame:
    return sharded(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
