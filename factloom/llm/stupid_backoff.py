"""Stupid-backoff language-model scores from n-gram counts of the whole corpus.

A position's score is the relative frequency of its longest n-gram, of up to three words, that the corpus has LEAST
times or more; each step to a shorter one costs a factor of 0.4. All documents are counted and all are scored with
all of their words; a document's score is the mean logarithm over its words. Logarithms are whole multiples of 1 / UNIT,
so that sums are exact and come out alike in any order, on any engine.

n-grams are exploded as windows: every word stands in the middle of one, with the word before and after it, and a mark
where the text begins or ends. Windows are partitioned by the hash of their middle word. All rows of a word, of the pairs
to its left and right and of its triples are in its bucket, so the count tables of the three orders are built there from
its windows and joined to the same windows, without a second shuffle of either. Log scores add up over n-grams, as one of
the table adds its change against the next shorter one, and each part of these changes belongs to some window whose
bucket has its counts. Buckets give a sum for each document, and these meet per block of documents.

Windows of a frequent middle word would be too many for one bucket. They move twice: by middle and first word, which
gives the counts of the left pair and of the triple, and by middle and last word, which gives those of the right pair
and again of the triple; how often the middle word itself occurs is counted beforehand for those words.

Windows move as columns of numbers, one row for each block of documents and bucket, sorted and packed, equal windows of a
document as one with its count. The VOCABULARY most frequent words of a sample have short numbers everywhere; each row
lists the bytes of its other words (the SHA-512 of words over LONGEST bytes). Which words the sample has changes the room
that rows take, not the result. The number of buckets grows with the corpus, so a bucket stays about BUCKET windows. A
row of a block and bucket has fewer windows as there are more buckets, so rows pack less well on larger corpora.

Words are what is between white space, in lower case (A-Z). Null and empty texts have no words, log score 0 and a null
score. Repeated rows and ids are scored row by row. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import checkpointed, slices

LEAST = 2
BACKOFF = 0.4
VOCABULARY = 200_000
LONGEST = 64
#: Windows in a bucket, about, and bytes of text in a block.
BUCKET = 1_600_000
BLOCK = 16 << 20
#: How hard numbers and words are packed.
LEVELS = 1, 3
#: Parts of a natural logarithm's unit.
UNIT = 1 << 32
#: One document in so many is read for the words with short numbers.
SAMPLE = 32
MIX = np.uint64(0x9E3779B97F4A7C15)

ENTRIES = "bucket int, block string, n int, names binary, middle binary, before binary, after binary, documents binary, times binary"
RESULTS = "block string, doc_ids binary, n_words binary, documents binary, sums binary"


def _packed(a: np.ndarray, deltas: bool = False) -> bytes:
    """Numbers as zstandard bytes, the bytes of one place together; deltas: of ascending numbers."""
    if deltas and len(a):
        a = np.concatenate([a[:1], np.diff(a)])
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes(), LEVELS[0])


def _unpacked(data: bytes, kind: str, deltas: bool = False) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    a = np.ascontiguousarray(flat.reshape(width, -1).T).view(kind).ravel()
    return np.cumsum(a, dtype=a.dtype) if deltas else a


def _log(n) -> np.ndarray:
    """Logarithms as whole multiples of 1 / UNIT."""
    return np.rint(np.log(np.maximum(n, 1)) * UNIT).astype(np.int64)


def _sums(index: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sums of whole numbers by index, in two halves, as bincount adds floating-point numbers."""
    high = np.bincount(index, value >> 24)
    return (high.astype(np.int64) << 24) + np.bincount(index, value & 0xFFFFFF).astype(np.int64)


def _split(text) -> list[bytes]:
    return (text.as_py() or "").encode().lower().split()


def words(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents; words over LONGEST bytes are one null row."""

    def run(batches):
        for batch in slices(batches, "text", BLOCK):
            count: Counter = Counter()
            for text in batch.column("text"):
                count.update(_split(text))
            long = sum(count.pop(w) for w in [w for w in count if len(w) > LONGEST])
            names, n = [*count, None], [*count.values(), long]
            yield pa.record_batch([pa.array(names, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def totals(docs: DataFrame, frequent: list[str]) -> tuple[dict[str, int], int]:
    """How often each of a few words occurs in all documents, and the number of all words."""

    def run(batches):
        known = [(w, w.encode()) for w in frequent]
        for batch in slices(batches, "text", BLOCK):
            count: Counter = Counter()
            total = 0
            for text in batch.column("text"):
                each = _split(text)
                total += len(each)
                if known:
                    count.update(each)
            yield pa.record_batch([pa.array([w for w, _ in known] + [None], pa.string()), pa.array([count[b] for _, b in known] + [total], pa.int64())],
                names=["word", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    n = {r["word"]: r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = n.pop(None, 0)
    return n, total


def _bucket(a: np.ndarray, b: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (a ^ (b * MIX)) * MIX
        return ((h ^ (h >> np.uint64(29))) >> np.uint64(16)) % np.uint64(buckets)


def _name(word: bytes) -> bytes:
    """The word, or what stands for a long one: longer than LONGEST itself, so it equals no short word."""
    return word if len(word) <= LONGEST else hashlib.sha512(word).hexdigest().encode()


def entries(docs: DataFrame, short: list[str], frequent: set[str], buckets: int) -> DataFrame:
    """For each block of documents: a row with their ids and lengths, and a row for each bucket of its windows.

    Bucket numbers from 0 hold windows by middle word, from `buckets` on those of frequent middle words by the first
    word too, from twice that on the same by the last word; below 0 are the rows of the documents. Word 0 is the mark.
    """

    def run(batches):
        first = len(short) + 1
        known = {w.encode(): k + 1 for k, w in enumerate(short)}
        digest = np.array([0] + [xxhash.xxh64_intdigest(w) for w in known], np.uint64)
        often = np.array([False] + [w in frequent for w in short])
        number = 0
        for batch in slices(batches, "text", BLOCK):
            local = dict(known)
            texts = [[local.setdefault(w, len(local) + 1) for w in _split(t)] for t in batch.column("text")]
            length = np.array([len(t) for t in texts], np.int64)
            word = np.fromiter((w for t in texts for w in t), np.int32, int(length.sum()))
            del texts
            names = [_name(w) for w in list(local)[first - 1 :]]
            order = sorted(range(len(names)), key=names.__getitem__)  # neighbours in order pack well
            place = np.arange(first + len(names), dtype=np.int32)
            place[first + np.array(order, np.int64)] = first + np.arange(len(names))
            names = [names[k] for k in order]
            word = place[word]
            hashed = np.concatenate([digest, np.array([xxhash.xxh64_intdigest(w) for w in names], np.uint64)])
            owner = np.repeat(np.arange(batch.num_rows, dtype=np.uint32), length)
            # a recomputed task names its blocks as before
            block = f"{TaskContext.get().partitionId()}:{number}"
            number += 1
            ids = pa.record_batch([batch.column("doc_id")], ["d"]).serialize().to_pybytes()
            rows = [(-1 - zlib.crc32(block.encode()) % buckets, block, batch.num_rows, ids, None, None, None, _packed(length.astype(np.int32)), None)]
            if len(word):
                rows += windows(word, owner, names, hashed, often, first, block)
            kinds = [pa.int32(), pa.string(), pa.int32()] + [pa.binary()] * 6
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in ENTRIES.split(", ")])

    def windows(word, owner, names, hashed, often, first, block):
        same = owner[1:] == owner[:-1]
        before, after = np.zeros_like(word), np.zeros_like(word)
        before[1:][same], after[:-1][same] = word[:-1][same], word[1:][same]
        bits = len(hashed).bit_length()
        if 3 * bits < 64:
            code = word.astype(np.int64) << bits
            code |= before
            code <<= bits
            code |= after
            where = np.argsort(code, kind="stable")  # documents are in order already
            del code
        else:
            where = np.lexsort((after, before, word))
        m, a, c, of = word[where], before[where], after[where], owner[where]
        new = np.ones(len(m), bool)
        new[1:] = (m[1:] != m[:-1]) | (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (of[1:] != of[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(m))).astype(np.uint32)
        m, a, c, of = m[at], a[at], c[at], of[at]
        hot = np.append(often, np.zeros(len(names), bool))[m]
        used, into = np.zeros(len(hashed), bool), np.arange(len(hashed), dtype=np.uint32)
        for role, other in enumerate((None, a, c)):
            mine = np.flatnonzero(hot == (role > 0))
            bucket = _bucket(hashed[m[mine]], np.uint64(0) if other is None else hashed[other[mine]], buckets)
            where = np.argsort(bucket, kind="stable")
            mine, bucket = mine[where], bucket[where]
            edge = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            for b in np.flatnonzero(np.diff(edge)).tolist():
                part = mine[edge[b] : edge[b + 1]]
                mac = m[part], a[part], c[part]
                for x in mac:
                    used[x] = True
                rare = first + np.flatnonzero(used[first:])
                into[rare] = first + np.arange(len(rare))
                used[:] = False
                listed = zstandard.compress(b" ".join([names[k] for k in (rare - first).tolist()]), LEVELS[1])
                yield (b + role * buckets, block, len(part), listed, _packed(into[mac[0]], True), _packed(into[mac[1]]), _packed(into[mac[2]]),
                    _packed(of[part]), _packed(times[part]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ENTRIES)


class _Counts:
    """Sums of times by key, gathered in parts, so that no more than the different keys and a part are held."""

    def __init__(self):
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, times: np.ndarray) -> None:
        each, which = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        self.keys, self.n = each, np.bincount(which, np.concatenate([self.n, times]), len(each)).astype(np.int64)

    def at(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, keys)


def _scorer(short: list[str], frequent: dict[str, int], buckets: int, total: int):
    lower, all_words, first = round(math.log(BACKOFF) * UNIT), int(_log(total)), len(short) + 1

    def run(key, table):
        """What one bucket's windows add to each document of each block; rows of documents pass as they are."""
        if key[0].as_py() < 0:
            none = pa.nulls(table.num_rows, pa.binary())
            return pa.table({"block": table["block"], "doc_ids": table["names"], "n_words": table["documents"], "documents": none, "sums": none})
        role = key[0].as_py() // buckets
        names: dict[bytes, int] = {}
        numbers = []
        for listed in table["names"]:
            rare = zstandard.decompress(listed.as_py()).split(b" ")
            numbers.append(np.array([names.setdefault(w, len(names)) for w in rare], np.int64) + first if rare != [b""] else np.zeros(0, np.int64))
        width = first + len(names)
        size = np.array(table["n"].to_pylist())
        # whole rows, together about a bucket at most
        cut = np.flatnonzero(np.diff(np.cumsum(size) // BUCKET, prepend=0)).tolist()
        spans = [(s, e) for s, e in zip([0, *cut], [*cut, len(size)]) if e > s]

        def column(name, s, e, kind, deltas=False):
            return [_unpacked(x.as_py(), kind, deltas).astype(np.int64) for x in table[name].slice(s, e - s)]

        def read(s, e):
            out = []
            for name in ("middle", "before", "after"):
                parts = column(name, s, e, "<u4", name == "middle")
                for k, x in enumerate(parts):
                    rare = np.flatnonzero(x >= first)
                    x[rare] = numbers[s + k][x[rare] - first]
                out.append(np.concatenate(parts))
            return *out, np.concatenate(column("times", s, e, "<u4"))

        held = read(*spans[0]) if len(spans) == 1 else None
        chunks = lambda: ([held] if held else (read(*x) for x in spans))
        alone, left, right, triple = np.zeros(width), _Counts(), _Counts(), _Counts()
        for m, a, c, t in chunks():
            alone += np.bincount(m, t, width)
            if role != 2:
                left.add(m * width + a, t)
            if role != 1:
                right.add(m * width + c, t)
        if role:
            alone = np.array([1.0, *(frequent.get(w, 1) for w in short)] + [1.0] * len(names))
        # a pair's place, not its key, keeps triples within 63 bits
        named = lambda m, a, c: (right.at(m * width + c) * width + a) if role == 2 else (left.at(m * width + a) * width + c)
        for m, a, c, t in chunks():
            triple.add(named(m, a, c), t)
        blocks, documents, sums = [], [], []
        for (s, e), (m, a, c, t) in zip(spans, chunks()):
            log_m = _log(alone)[m]
            n_triple = np.where((a > 0) & (c > 0), triple.n[triple.at(named(m, a, c))], 0)
            in_triple = n_triple >= LEAST
            value = np.zeros(len(m), np.int64)
            if role != 2:
                place = left.at(m * width + a)
                log_left = _log(left.n)[place]
                value += log_m + (2 * lower - all_words)
                value += np.where((a > 0) & (left.n[place] >= LEAST), log_left - log_m + (all_words - lower), 0)
                value += np.where(in_triple, _log(n_triple) - log_left - lower + log_m, 0)
            if role != 1:
                place = right.at(m * width + c)
                value -= np.where((c > 0) & (right.n[place] >= LEAST), log_m, 0)
                value -= np.where(in_triple, _log(right.n)[place], 0)
            value *= t
            begin = 0
            for k, of in enumerate(column("documents", s, e, "<u4")):
                part = _sums(of, value[begin : begin + len(of)])
                each = np.flatnonzero(np.bincount(of))
                begin += len(of)
                blocks.append(table["block"][s + k].as_py())
                documents.append(_packed(each.astype("<u4"), True))
                sums.append(_packed(part[each].astype("<i8")))
        empty = pa.nulls(len(blocks), pa.binary())
        return pa.table({"block": pa.array(blocks, pa.string()), "doc_ids": empty, "n_words": empty, "documents": pa.array(documents, pa.binary()),
            "sums": pa.array(sums, pa.binary())})

    return run


def _finished(table):
    """The documents of one block with the sums from all buckets."""
    rows = table.to_pylist()
    head = next(r for r in rows if r["doc_ids"] is not None)
    names = pa.ipc.read_record_batch(pa.py_buffer(head["doc_ids"]), pa.schema([("d", pa.int64())])).column(0)
    n = _unpacked(head["n_words"], "<i4").astype(np.int64)
    total = np.zeros(len(n), np.int64)
    for r in rows:
        if r["doc_ids"] is None:
            total[_unpacked(r["documents"], "<u4", True)] += _unpacked(r["sums"], "<i8")
    return pa.table({"doc_id": names, "n_words": n, "log_score": total / UNIT})


def vocabulary(count: DataFrame) -> tuple[list, int]:
    """The rows of the most frequent words, VOCABULARY at most, and the number of all words.

    The least count that a word must exceed comes from the histogram of counts, so that only the chosen words come to
    the driver, not every task's best; of words with that count none is taken.
    """
    histogram = count.groupBy("n", F.col("word").isNull().alias("long")).agg(F.count(F.lit(1)).alias("c")).collect()
    # a row for each different count: the square root of the words, at most
    total, upto, least = sum(r["n"] * r["c"] for r in histogram), 0, 0
    for r in sorted((r for r in histogram if not r["long"]), key=lambda r: -r["n"]):
        upto += r["c"]
        if upto > VOCABULARY:
            least = r["n"]
            break
    rows = count.filter(F.col("word").isNotNull() & (F.col("n") > least)).select("word", "n").collect()
    return sorted(rows, key=lambda r: (-r["n"], r["word"])), total


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, log_score, score) of every row. Before a text's third word fewer steps are possible; they cost as if taken."""
    sample = docs.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")), F.lit(SAMPLE)) == 0)
    top, _ = vocabulary(checkpointed(words(sample)))
    short = [r["word"] for r in top]
    frequent, total = totals(docs, [r["word"] for r in top if r["n"] * SAMPLE > BUCKET])
    buckets = max(1, -(-total // BUCKET))
    found = entries(docs, short, set(frequent), buckets)
    sums = found.groupBy("bucket").applyInArrow(_scorer(short, frequent, buckets, total), RESULTS)
    rows = sums.groupBy("block").applyInArrow(_finished, "doc_id long, n_words long, log_score double")
    return rows.withColumn("score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
