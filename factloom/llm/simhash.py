"""SimHash near-duplicates, with candidates from the pigeonring principle.

A 64-bit fingerprint per text: a bit is set if it is set in over half the XXH64 hashes of the text's word shingles.
Fingerprints link at `distance` 3 or less. Of the four 16-bit segments on a ring, some segment starts a chain whose
running differences stay within 0, 1, 2, 3: the first segment is equal, the second differs in one bit at most, so one
half of the second is equal too. Fingerprints are therefore bucketed by a segment and a half of the next (eight
24-bit keys each), and a pair in a bucket must pass the running budgets of the whole chain before the full Hamming
check. Pairs never become rows: each bucket, read in sorted order with numpy, gives the links of a spanning forest.

Buckets over `CHUNK` members are split into chunks, and pairs of chunks are shared among tasks, so that a bucket with
any share of all fingerprints is neither one task's work nor held whole. Exact copies share one fingerprint and are
counted before. Components come from links by large-star and small-star rounds.

Null and empty texts have fingerprint zero and are linked like any other. Texts under three words are one shingle.
Nodes are fingerprints, so rows that share an id and have unlike texts stay apart. Repeated rows and ids keep their rows;
rows with a null id link like others, and get the smallest id of their component, null if it has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import SMALL, checkpointed, joined, plainly_named, small

SHINGLE = 3
DISTANCE = 3
SEED = 42
CHUNK = 4096
#: Hashes whose bits are counted in one go.
BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    begin = np.cumsum(size) - size
    n = max(1, len(words) - shingle + 1)
    first = begin[:n].tolist()
    stop = (begin + size - 1)[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(first[k : k + BLOCK], stop[k : k + BLOCK])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((2 * ones > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def _fingerprints(keep: list[str]):
    def run(batches):
        for batch in batches:
            pa.default_memory_pool().release_unused()  # a worker that waits for its next task keeps little
            found = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(k) for k in keep] + [pa.array(found, pa.int64())], names=keep + ["fingerprint"])

    return run


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint), the fingerprint's 64 bits as a signed long."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(["doc_id"]), "doc_id long, fingerprint long")


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def chain_passes(difference: np.ndarray, start: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Whether the running differences over the ring of four segments from `start` stay within their budgets."""
    passes = np.ones(len(difference), bool)
    total = np.zeros(len(difference), np.int64)
    for k in range(4):
        segment = difference >> ((start + k) % 4 * 16).astype(np.uint64) & np.uint64(0xFFFF)
        total += _bits(segment)
        passes &= total <= (k + 1) * distance // 4
    return passes


class _Forest:
    """Union of what is linked within one run of rows, so that only links which join something are given out."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        p = self.parent.setdefault(x, x)
        while p != self.parent[p]:
            self.parent[p] = p = self.parent[self.parent[p]]
        return p

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _links_of(start: int, node: np.ndarray, bits: np.ndarray, left: np.ndarray) -> tuple[list[int], list[int]]:
    """Spanning links among one bucket's members; with chunks of two numbers, only between the two."""
    a_, b_, forest = [], [], _Forest()
    two = not left.all() and left.any()
    one = np.flatnonzero(left) if two else np.arange(len(node))
    other = np.flatnonzero(~left) if two else one
    for k, x in enumerate(one.tolist()):
        rest = other if two else other[k + 1 :]
        difference = bits[rest] ^ bits[x]
        near = np.flatnonzero(_bits(difference) <= DISTANCE)
        if len(near):
            near = near[chain_passes(difference[near], np.full(len(near), start))]
        for y in rest[near].tolist():
            if forest.join(int(node[x]), int(node[y])):
                a_.append(int(node[x]))
                b_.append(int(node[y]))
    return a_, b_


def _links(batches):
    """Links within buckets; rows come sorted by bucket, of which at most the last of a batch is carried on."""
    names = ["band", "key", "pair", "left", "node", "fingerprint"]
    held: list[np.ndarray] | None = None

    def of(columns: list[np.ndarray], last: bool):
        band, key, pair, left, node, bits = columns
        n = len(band)
        if not n:
            return columns, [], []
        new = np.ones(n, bool)
        new[1:] = (band[1:] != band[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])
        at = np.flatnonzero(new)
        ends = np.append(at[1:], n)
        keep = n if last else int(at[-1])
        a_, b_ = [], []
        small = ends - at == 2
        x = at[small & (ends <= keep)]
        if len(x):  # buckets of two, most of those that aren't single, all at once
            difference = bits[x] ^ bits[x + 1]
            near = (_bits(difference) <= DISTANCE) & chain_passes(difference, band[x] // 2)
            whole = pair[x] < 0
            near &= whole | (left[x] != left[x + 1])
            a_ += node[x[near]].tolist()
            b_ += node[x[near] + 1].tolist()
        for s, e in zip(at[ends - at > 2].tolist(), ends[ends - at > 2].tolist()):
            if e <= keep:
                more = _links_of(int(band[s]) // 2, node[s:e], bits[s:e], left[s:e])
                a_ += more[0]
                b_ += more[1]
        return [c[keep:] for c in columns], a_, b_

    def rows(a_, b_):
        return pa.record_batch([pa.array(a_, pa.int64()), pa.array(b_, pa.int64())], names=["a", "b"])

    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in names]
        columns[5] = columns[5].astype(np.int64).view(np.uint64)
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
        held, a_, b_ = of(columns, False)
        yield rows(a_, b_)
    if held is not None:
        _, a_, b_ = of(held, True)
        yield rows(a_, b_)


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that join the same nodes as all pairs of nodes (node, fingerprint) within the distance do."""
    bits = F.col("fingerprint")

    def part(segment: int, half: int | None = None):
        shift, mask = (segment % 4 * 16, 0xFFFF) if half is None else (segment % 4 * 16 + 8 * half, 0xFF)
        return F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(mask))

    keys = [
        F.struct(F.lit(2 * s + h).alias("band"), (part(s) * 256 + part(s + 1, h)).cast("int").alias("key"))
        for s in range(4) for h in range(2)
    ]
    rows = nodes.select("node", "fingerprint", F.explode(F.array(*keys)).alias("k")).select("k.band", "k.key", "node", "fingerprint")
    large = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > CHUNK)
    large = checkpointed(large.select("band", "key", F.ceil(F.col("members") / CHUNK).cast("int").alias("chunks")))
    # few buckets are large, as each has over CHUNK members
    marked = rows.join(small(large, large.count()), ["band", "key"], "left")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    low, high = F.least(F.col("c"), F.col("other")), F.greatest(F.col("c"), F.col("other"))
    dealt = (
        marked.withColumn("c", F.coalesce(chunk, F.lit(0)))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks"), F.lit(1)) - 1)))
        .select(
            "band", "key", "node", "fingerprint",
            F.when(F.col("chunks").isNull(), F.lit(-1)).otherwise(low.cast("long") * F.col("chunks") + high).alias("pair"),
            (F.col("c") <= F.col("other")).alias("left"),
        )
    )
    order = ["band", "key", "pair"]
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(_links, "a long, b long")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the least node that each node of edges (a, b) reaches, by large-star and small-star rounds."""

    def starred(e: DataFrame, larger: bool, total: int) -> DataFrame:
        both = e if not larger else e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("a", "m"))
        of_each = joined(both, least, "a", total)  # the centre of a large component is a frequent key
        if larger:
            out = of_each.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = of_each.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.filter(F.col("a") != F.col("b")).distinct()

    now = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct())
    sign = None
    for _ in range(rounds):
        total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == total:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        sign = total
        large = starred(now, True, 2 * total[0])
        large = large if total[0] <= SMALL else checkpointed(large)  # read several times, but then not recomputed
        now = checkpointed(starred(large, False, total[0]))
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def grouped(marked: DataFrame) -> DataFrame:
    """(fingerprint, n, least, component) for rows (doc_id, fingerprint): how many rows have it, their smallest id, and
    the least fingerprint that it reaches."""
    nodes = checkpointed(marked.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")))
    found = components(links(nodes.select(F.col("fingerprint").alias("node"), "fingerprint"))).withColumnRenamed("node", "fingerprint")
    return checkpointed(nodes.join(found, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) for every row."""
    marked = checkpointed(fingerprints(docs))
    each = grouped(marked)
    first = each.groupBy("component").agg(F.min("least").alias("component_id"))
    named = checkpointed(each.join(first, "component").select("fingerprint", "n", "component_id"))
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return joined(marked, named, "fingerprint", marked.count()).select("doc_id", digits.alias("fingerprint"), "component_id")


def kept_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the one with the smallest id, a null id last. Any other columns stay.

    Rows are known by id and text, so rows with one id and unlike texts are told apart; of rows equal in both, one is
    left before anything is shuffled. Fingerprints, links and components carry keys only; texts move once, to the keys of
    the rows that stay. Null and empty texts are one group. An empty table gives no rows.
    """
    # no key is null, so one partitioning serves the rows of one key and the join
    key = {"kept__none": F.col("doc_id").isNull(), "kept__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
        "kept__text": F.xxhash64(F.col("text").cast("string"))}
    rows = docs.select(*[c.alias(k) for k, c in key.items()], F.col("text").cast("string").alias("text"))
    marked = checkpointed(rows.mapInArrow(_fingerprints(list(key)), "kept__none boolean, kept__id long, kept__text long, fingerprint long"))
    each = grouped(marked.withColumnRenamed("kept__id", "doc_id"))
    best = marked.groupBy("fingerprint").agg(F.min(F.struct(*key)).alias("k")).join(each.select("fingerprint", "component"), "fingerprint")
    first = best.groupBy("component").agg(F.min("k").alias("k")).select("k.*")
    inner, back = plainly_named(docs, ["doc_id", "text"])
    once = inner.withColumns(key).dropDuplicates(list(key))
    return back(once.join(first, list(key), "left_semi"))
