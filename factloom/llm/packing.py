"""Sequence packing: shortest-pack-first over the histogram of lengths.

Documents become ids (plus one that ends each; added tokens of the vocabulary are recognised as its library does), are cut into whole sequences and one shorter rest, and only the
histogram of rests, at most `width` lengths, comes to the driver. There the lengths are placed longest first: as
many as fit into packs that are still open, the shortest packs first, the others open new packs. A pack stands for
any number of equal sequences, so the plan is small for any number of documents. It is joined back by length and
by the rank of each rest among those of its length.

Nulls count as empty texts (one id, the end). Repeated rows are packed each for itself. Empty tables give no rows.
Only the id and the text are read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe
from factloom.llm.common import checkpointed, numbered, slices, small

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str, width: int = 2048, end: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document's ids cut at multiples of width: (doc_id, start, length, ids_crc32, doc_tokens)."""

    def run(batches):
        vocabulary = bpe.merge_file(path)
        stop = np.array([end], "<u4")
        for batch in slices(batches, "text", bpe.SLICE):
            pa.default_memory_pool().release_unused()  # a worker that waits for its next task keeps little
            key = batch.column("doc_id").to_pylist()
            out: list[list] = [[], [], [], [], []]
            tokens: dict[int, int] = defaultdict(int)
            held, row = np.zeros(0, "<u4"), 0

            def cut(last: bool, row: int, held: np.ndarray, out=out, key=key, tokens=tokens) -> np.ndarray:
                while len(held) >= width or last and len(held):
                    part, held = held[:width], held[width:]
                    for column, value in zip(out, (key[row], tokens[row], len(part), zlib.crc32(part.tobytes()), row)):
                        column.append(value)
                    tokens[row] += len(part)
                return held

            for now, ids in bpe.encoded(batch, "text", vocabulary):
                if now != row:
                    cut(True, row, np.append(held, stop))
                    held, row = np.zeros(0, "<u4"), now
                held = cut(False, row, np.concatenate([held, ids]) if len(held) else ids)
            cut(True, row, np.append(held, stop))
            out[4] = [tokens[k] for k in out[4]]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, PIECES)


def shortest_pack_first(histogram: dict[int, int], width: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs (lengths, how many sequences are so packed) for a histogram of lengths up to width."""
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        # packs by their filled length, shortest first; each takes one rest of this length or more if they fit
        for filled in sorted(k for k in open_ if k + length <= width):
            if not left:
                break
            for pack in sorted(open_[filled]):
                if not left:
                    break
                count = open_[filled][pack]
                fit = min((width - filled) // length, max(1, left // count))
                used = min(count, left // fit)
                if not used:
                    fit, used = left, 1
                open_[filled][pack] -= used
                if not open_[filled][pack]:
                    del open_[filled][pack]
                grown = pack + (length,) * fit
                open_[filled + fit * length][grown] = open_[filled + fit * length].get(grown, 0) + used
                left -= used * fit
        if left:
            fit = width // length
            if whole := left // fit:
                open_[fit * length][(length,) * fit] = open_[fit * length].get((length,) * fit, 0) + whole
            if rest := left % fit:
                open_[rest * length][(length,) * rest] = open_[rest * length].get((length,) * rest, 0) + 1
    return [(pack, count) for filled in sorted(open_) for pack, count in sorted(open_[filled].items()) if count]


def plan(spark: SparkSession, histogram: dict[int, int], width: int, first: int = 0) -> tuple[DataFrame, int]:
    """Which ranks of a length go to which sequences: (length, low, high, first_sequence, offset), sequences from `first`; and how many rows."""
    rows, used = [], defaultdict(int)
    for pack, count in shortest_pack_first(histogram, width):
        offset = 0
        for length in pack:
            rows.append((length, used[length], used[length] + count, first, offset))
            used[length] += count
            offset += length
        first += count
    return spark.createDataFrame(rows, "plan_length long, low long, high long, first_sequence long, offset long"), len(rows)


def packed(cut: DataFrame, width: int = 2048) -> DataFrame:
    """Pieces with their sequence and their offset in it; cut: as of pieces(), read twice, so keep it first.

    Sequences 0, 1, ... hold the whole pieces, those after them the packs.
    """
    spark = cut.sparkSession
    full = numbered(cut.filter(F.col("length") == width), [], ["doc_id", "start"], "sequence_id").withColumn("offset", F.lit(0).cast("long"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = histogram.pop(width, 0)
    # the plan has a few rows for each of fewer than `width` lengths, whatever the number of documents
    places, rows = plan(spark, histogram, width, whole)
    ranked = numbered(cut.filter(F.col("length") < width), ["length"], ["doc_id", "start"], "rank")
    rest = ranked.join(
        small(places, rows),
        (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")),
    ).withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("low"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return full.select(columns).unionByName(rest.select(columns))


def pack(docs: DataFrame, path: str, width: int = 2048, end: int = 1) -> DataFrame:
    """Documents as packed pieces; the pieces, a few numbers a document, are kept in the shared folder."""
    return packed(checkpointed(pieces(docs, path, width, end)), width)
