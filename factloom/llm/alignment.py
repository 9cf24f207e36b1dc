"""Cross-tokenizer alignment: tokens of two vocabularies over the same bytes, cut into groups where both end.

A text is written as a space and itself, as the piece vocabulary (B) puts a space before every text anyway. The byte
vocabulary (A) encodes that with this package's own merging, B with its library. Both give cumulative byte ends; two
dictionaries lead from an end to the token that ends there, and the sorted intersection of their keys slices both lists of
ids into groups. A group's last tokens, one of A and one of B, end together: that is its link. No token of these
vocabularies is empty, so there is one link a group.

Tokens that end together end with the same bytes, so the shorter is a suffix of the longer. The pairs of ids that can
ever be linked are therefore known from the vocabularies alone (some 200,000 for the public ones), whatever the corpus:
they are numbered, each task counts by that number, the counts of all tasks are added up by a shuffle, and their sum, of
that bounded size, goes back to the tasks. Documents are encoded once: what each has of groups and links is written as a
table in the shared folder and read again for the columns that depend on the corpus.

Null and empty texts, and texts whose tokens don't give back a space and the text (such as those that hold U+2581), have
no tokens: all numbers zero, the digest an empty string. Special tokens' strings are plain text. Repeated rows are rows of
their own, and each counts. Empty tables give no rows. Only the id and the text are read. Memory is bounded by SLICE or
the longest text. The piece vocabulary's library gets each different part between spaces once, as no piece reaches from
a word over the space after it; of a vocabulary that has such pieces it gets whole texts.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import bpe
from factloom.llm.common import shared_folder, slices, utf8

#: Bytes of text that are encoded in one go.
SLICE = 1 << 19
#: What stands for a space in pieces.
MARK = "\u2581"

SLICED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Tokens:
    """Bytes of the ids of a vocabulary, and how long they are."""

    def __init__(self, of: dict[int, bytes]):
        self.of = of
        self.size = np.zeros(max(of) + 1, np.int64)
        self.size[list(of)] = [len(b) for b in of.values()]

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.of.__getitem__, ids))


@lru_cache(4)
def byte_tokens(path: str) -> tuple[bpe.Vocabulary, Tokens]:
    vocabulary = bpe.merge_file(path, special=False)
    return vocabulary, Tokens(vocabulary.bytes)


class Pieces:
    """A piece vocabulary: its library, the bytes of its ids, and the ids of the parts of texts that were seen lately."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        words = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.tokens = Tokens({i: bytes([int(w[3:5], 16)]) if self.library.is_byte(i) else w.replace(MARK, " ").encode() for i, w in enumerate(words)})
        self.lengths = self.tokens.size.tolist().__getitem__
        space = self.library.piece_to_id(MARK)
        #: No piece has a space after anything else, so nothing merges across the begin of a run of spaces.
        self.cuts = space != self.library.unk_id() and not any(MARK in w.lstrip(MARK) for w in words)
        #: The library puts no space before nothing, so a space that ends a text is known beforehand.
        self.last = {b" ": np.array([space], "<u4").tobytes()}
        self.cache: dict[bytes, bytes | None] = dict(self.last)

    def encoded(self, parts: list[bytes]) -> list[bytes | None]:
        """Ids, as little-endian 32-bit bytes, of parts that begin with a space; None where they don't give back the part."""
        if len(self.cache) > bpe.CACHE:
            self.cache = dict(self.last)
        new = [p for p in parts if p not in self.cache]
        found = self.library.encode([p[1:].decode() for p in new], num_threads=1)
        every = list(chain.from_iterable(found))
        flat, upto = np.array(every, "<u4").tobytes(), 0
        same = self.tokens.joined(every) == b"".join(new)
        for part, ids in zip(new, found):
            upto, start = upto + 4 * len(ids), upto
            self.cache[part] = flat[start:upto] if same and sum(map(self.lengths, ids)) == len(part) or self.tokens.joined(ids) == part else None
        return list(map(self.cache.__getitem__, parts))

    def of_texts(self, column: pa.Array) -> list[np.ndarray | None]:
        """Ids of each text in a column, all of which are empty or begin with a space; None where they don't give back the text."""
        data, at = utf8(column)
        begins = np.zeros(int(at[-1]) + 1, bool)
        if self.cuts:
            begins[1:-1] = (data[1 : at[-1]] == 32) & (data[: at[-1] - 1] != 32)
        begins[at] = True
        begins[: at[0]] = False
        begin = np.flatnonzero(begins[:-1])
        parts = pa.Array.from_buffers(
            pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, at[-1])), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        found = self.encoded(parts.dictionary.to_pylist())
        which = parts.indices.to_numpy()
        sizes = np.array([len(f) // 4 if f is not None else 0 for f in found], np.int64)
        upto = np.append(0, np.cumsum(sizes[which]))
        run = np.repeat((np.cumsum(sizes) - sizes)[which] - upto[:-1], sizes[which])
        ids = np.frombuffer(b"".join(f for f in found if f), "<u4")[run + np.arange(len(run))]
        wrong = np.append(0, np.cumsum(np.array([f is None for f in found], bool)[which]))
        edge = np.searchsorted(begin, at)
        return [None if wrong[j] > wrong[i] else ids[upto[i] : upto[j]] for i, j in zip(edge[:-1], edge[1:])]


@lru_cache(4)
def piece_tokens(path: str) -> tuple[Pieces, Tokens]:
    pieces = Pieces(path)
    return pieces, pieces.tokens


@lru_cache(4)
def possible_pairs(path_a: str, path_b: str) -> np.ndarray:
    """All id pairs of which one's bytes end with the other's, as a << 32 | b, sorted."""
    a, b = byte_tokens(path_a)[1].of, piece_tokens(path_b)[1].of
    with_bytes: tuple[dict, dict] = (defaultdict(list), defaultdict(list))
    for known, of in zip(with_bytes, (a, b)):
        for i, s in of.items():
            known[s].append(i)
    found = {i << 32 | j for i, s in a.items() for k in range(len(s)) for j in with_bytes[1].get(s[k:], ())}
    found |= {i << 32 | j for j, s in b.items() for k in range(1, len(s)) for i in with_bytes[0].get(s[k:], ())}
    return np.array(sorted(found), np.int64)


def common_ends(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the tokens of A and of B that end together, in order."""
    at_a, at_b = dict(zip(ends_a, range(len(ends_a)))), dict(zip(ends_b, range(len(ends_b))))
    both = sorted(at_a.keys() & at_b.keys())
    return np.array(list(map(at_a.__getitem__, both)), np.int64), np.array(list(map(at_b.__getitem__, both)), np.int64)


def groups_text(ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> bytes:
    """`a1,a2|b1;a3|b2,b3`; last_a and last_b are the indexes of each group's last tokens."""
    n = 1 << 17
    code_a, code_b = ids_a.astype(np.int64), ids_b.astype(np.int64) + 2 * n
    code_a[last_a] += n
    code_b[last_b] += n
    size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    out = np.empty(len(code_a) + len(code_b), np.int64)
    out[np.arange(len(code_a)) + np.repeat(last_b + 1 - size_b, size_a)] = code_a
    out[np.arange(len(code_b)) + np.repeat(last_a + 1, size_b)] = code_b
    return b"".join(map(_codes(n).__getitem__, out.tolist()))[:-1]


@lru_cache(1)
def _codes(n: int) -> list[bytes]:
    """Ids below n with what follows them: in A's list, at its end, in B's list, at its end."""
    return [f"{i}{mark}".encode() for mark in (",", "|", ",", ";") for i in range(n)]


class Group:
    """What the groups of one text are: both lists of ids and the index of each group's last tokens."""

    def __init__(self, ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray):
        self.ids_a, self.ids_b, self.last_a, self.last_b = ids_a, ids_b, last_a, last_b


def aligned(batch: pa.RecordBatch, path_a: str, path_b: str) -> Iterator[Group | None]:
    """The groups of each text in batch's column text, in order; None if it has no tokens."""
    vocabulary, a = byte_tokens(path_a)
    pieces, b = piece_tokens(path_b)
    texts = batch.column("text").to_pylist()
    spaced = pa.record_batch([pa.array([" " + t if t else "" for t in texts], pa.large_string())], names=["text"])
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for row, ids in bpe.encoded(spaced, "text", vocabulary):
        parts[row].append(ids)
    for text, own, ids_b in zip(texts, parts, pieces.of_texts(spaced.column("text"))):
        if not text or ids_b is None:  # A's merging starts from the bytes themselves, so it always gives them back
            yield None
            continue
        ids_a = np.concatenate(own) if len(own) > 1 else own[0]
        yield Group(ids_a, ids_b, *common_ends(np.cumsum(a.size[ids_a]).tolist(), np.cumsum(b.size[ids_b]).tolist()))


def sliced(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document's token and group counts, digest, and the numbers of its linked pairs with how often it has them."""

    def run(batches):
        pairs = possible_pairs(path_a, path_b)
        for batch in slices(batches, "text", SLICE):
            pa.default_memory_pool().release_unused()
            out: list[list] = [[] for _ in range(7)]
            for group in aligned(batch, path_a, path_b):
                if group is None:
                    row = 0, 0, 0, 0, "", b"", b""
                else:
                    links = group.ids_a[group.last_a].astype(np.int64) << 32 | group.ids_b[group.last_b]
                    known, times = np.unique(links, return_counts=True)
                    known = np.searchsorted(pairs, known)
                    digest = hashlib.sha256(groups_text(group.ids_a, group.ids_b, group.last_a, group.last_b)).hexdigest()
                    steps = np.diff(known, prepend=0).astype("<u4").tobytes()
                    row = len(group.ids_a), len(group.ids_b), len(group.last_a), len(links), digest, steps, times.astype("<u4").tobytes()
                for column, value in zip(out, row):
                    column.append(value)
            columns = [pa.array(c, t) for c, t in zip(out, [*[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()])]
            yield pa.record_batch([batch.column("doc_id"), *columns], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, SLICED)


def pair_counts(rows: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(pair, a_id, b_id, n) over all rows of sliced(): how many links of the corpus hold each pair."""

    def run(batches):
        n = np.zeros(len(possible_pairs(path_a, path_b)), np.int64)
        for batch in batches:
            for steps, times in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist()):
                n[np.cumsum(np.frombuffer(steps, "<u4"))] += np.frombuffer(times, "<u4")
        some = np.flatnonzero(n)
        keys = possible_pairs(path_a, path_b)[some]
        yield pa.record_batch([pa.array(c) for c in (some, keys >> 32, keys & 0xFFFFFFFF, n[some])], names=["pair", "a_id", "b_id", "n"])

    counted = rows.select("pairs", "times").mapInArrow(run, "pair long, a_id long, b_id long, n long")
    return counted.groupBy("pair", "a_id", "b_id").agg(F.sum("n").alias("n"))


def counted(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Documents with their tokens, groups and links, and how frequent the linked pairs are in the whole corpus."""
    spark = docs.sparkSession
    at = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    sliced(docs, path_a, path_b).write.option("compression", "zstd").parquet(at)
    rows = spark.read.schema(SLICED).parquet(at)
    # as many rows as possible_pairs() has at most: bounded by the vocabularies, however many documents there are
    found = pair_counts(rows, path_a, path_b).select("pair", "n").toArrow()
    shared = spark.sparkContext.broadcast((found.column("pair").to_numpy(), found.column("n").to_numpy()))

    def run(batches):
        keys = possible_pairs(path_a, path_b)
        pair, times = shared.value
        n = np.zeros(len(keys), np.int64)
        n[pair] = times
        b = keys & 0xFFFFFFFF
        highest = np.zeros(int(b.max(initial=0)) + 1, np.int64)
        np.maximum.at(highest, b, n)
        best = n == highest[b]
        for batch in batches:
            n_best, count_sum = [], []
            for steps, own in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist()):
                which, own = np.cumsum(np.frombuffer(steps, "<u4")), np.frombuffer(own, "<u4").astype(np.int64)
                n_best.append(int(own[best[which]].sum()))
                count_sum.append(int(own @ n[which]))
            at_end = batch.schema.get_field_index("groups_sha256")
            left = [batch.column(k) for k in range(at_end)]
            yield pa.record_batch(
                [*left, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), batch.column("groups_sha256")],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    return rows.mapInArrow(run, COUNTED)
