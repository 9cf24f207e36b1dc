"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Boundaries are found without a regular expression. Each code point becomes a symbol of a small alphabet (its
class, and for white space and apostrophes what follows it); runs of one symbol shrink to one step; each step is a
function from the tokeniser's state to its next state. Functions compose associatively, so blocks of steps are
composed side by side, chained, and then replayed side by side from their now known first states. Slices between
boundaries are looked up in a bounded cache, and those that miss are merged together with
numpy, one merge per slice and round.

Nulls encode as empty texts. Empty texts have no ids. Long texts are cut where a token begins whatever stands before: at
white space after anything else, and after the last of a run of letters or of digits. So memory is bounded by the slice,
or by the longest such run if that is longer, as a run is one token of the tokeniser and can't be merged in parts.

A vocabulary file's added tokens (`<|endoftext|>`) are found in the text first, as its library does; what stands between
them is encoded as texts of their own.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import slices, utf8

#: Bytes of text that are pre-tokenised in one go.
SLICE = 1 << 19
#: Slices whose ids each worker keeps.
CACHE = 200_000
#: Slices over this many bytes are merged with a heap instead of by rounds.
LONG = 200
#: The rank of a pair that doesn't merge.
NEVER = 1 << 40

# The Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]

LETTER, NUMBER, OTHER, PREFIX, LAST, RUN, QUOTE, CONTRACTED = range(8)
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_PREFIX, IN_SPACE, IN_CONTRACTION = range(7)


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(4 << 16):  # no plane beyond the first four has letters or numbers
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            kinds[c] = LETTER if kind == "L" else NUMBER
    kinds[WHITE_SPACE] = RUN
    return kinds


@lru_cache(1)
def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a token begins, by symbol (plus 8 where a text begins) and state."""
    step, begins = np.zeros((16, 7), np.uint8), np.ones((16, 7), bool)
    step[LETTER], step[NUMBER], step[OTHER] = IN_LETTERS, IN_NUMBERS, IN_OTHERS
    step[PREFIX], step[LAST], step[RUN] = AFTER_PREFIX, CLOSED, IN_SPACE
    step[QUOTE], step[CONTRACTED] = IN_CONTRACTION, IN_LETTERS
    step[QUOTE, [IN_OTHERS, AFTER_PREFIX]] = IN_OTHERS
    step[CONTRACTED, IN_CONTRACTION] = CLOSED
    begins[LETTER, [IN_LETTERS, AFTER_PREFIX]] = False
    begins[NUMBER, [IN_NUMBERS, AFTER_PREFIX]] = False
    begins[[OTHER, QUOTE], IN_OTHERS] = False
    begins[[OTHER, QUOTE], AFTER_PREFIX] = False
    begins[RUN, IN_SPACE] = False
    begins[CONTRACTED, [IN_LETTERS, AFTER_PREFIX, IN_CONTRACTION]] = False
    step[8:] = step[:8, [CLOSED]]
    return step, begins


def _states_before(symbols: np.ndarray) -> np.ndarray:
    """The state before each step, from blocks of composed transition functions."""
    step, _ = _machine()
    n = len(symbols)
    width = max(16, int(n**0.5 / 4))
    blocks = -(-n // width)
    grid = np.full(blocks * width, LETTER, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(blocks, width).T)
    flat = step.ravel()
    whole = np.tile(np.arange(7, dtype=np.intp), (blocks, 1))
    for row in grid:
        whole = flat[(row.astype(np.intp) * 7)[:, None] + whole].astype(np.intp)
    state, first = CLOSED, np.zeros(blocks, np.intp)
    for k, f in enumerate(whole.tolist()):
        first[k] = state
        state = f[state]
    out = np.empty((width, blocks), np.uint8)
    now = first
    for k, row in enumerate(grid):
        out[k] = now
        now = flat[row.astype(np.intp) * 7 + now].astype(np.intp)
    return out.T.ravel()[:n]


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the code points of UTF-8 begin, and their numbers."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[lead].astype(np.int32)
    if len(lead) < len(data):
        room = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        two, three, four = (code >= 0xC0) & (code < 0xE0), (code >= 0xE0) & (code < 0xF0), code >= 0xF0
        for which, mask, more in ((two, 0x1F, 1), (three, 0x0F, 2), (four, 0x07, 3)):
            some = np.flatnonzero(which)
            value = code[some] & mask
            for k in range(1, more + 1):
                value = value << 6 | room[lead[some] + k] & 0x3F
            code[some] = value
    return lead, code


def boundaries(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Offsets in data, UTF-8 of several texts, where a token begins; at: where the texts begin."""
    if not len(data):
        return np.zeros(0, np.int64)
    lead, code = _code_points(data)
    symbol = _classes()[code]
    begins = np.zeros(len(lead) + 1, bool)
    begins[np.searchsorted(lead, at)] = True
    blank = symbol == RUN
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~begins[1:-1])
    symbol[last] = np.where(code[last] == 32, PREFIX, LAST)
    quotes = np.flatnonzero(code == 39)
    if len(quotes):
        room = np.concatenate([code, [0, 0]])
        open1, open2 = ~begins[np.minimum(quotes + 1, len(lead))], ~begins[np.minimum(quotes + 2, len(lead))]
        one, two = room[quotes + 1], room[quotes + 2]
        short = open1 & np.isin(one, [ord(c) for c in "stmd"])
        long = open1 & open2 & ((one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        symbol[quotes[short | long]] = QUOTE
        symbol[quotes[short | long] + 1] = CONTRACTED
        symbol[quotes[long] + 2] = CONTRACTED
    change = np.ones(len(lead), bool)
    change[1:] = (symbol[1:] != symbol[:-1]) | begins[1:-1]
    runs = np.flatnonzero(change)
    steps = symbol[runs] + 8 * begins[runs].astype(np.uint8)
    return lead[runs[_machine()[1][steps, _states_before(steps)]]]


class Vocabulary:
    """Ids of byte strings, and for pairs of ids the order in which they merge and the id that they make."""

    def __init__(self, ids: dict[bytes, int], pairs: dict[tuple[int, int], tuple[int, int]], whole: bool, added: dict[bytes, int] | None = None):
        self.ids, self.whole, self.added = ids, whole, added or {}
        self.pattern = re.compile(b"|".join(re.escape(w) for w in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.bytes = {i: b for b, i in (ids | self.added).items()}
        self.byte = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        self.pairs = pairs
        keys = np.array([a << 20 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.rank = np.array([r for r, _ in pairs.values()], np.int64)[order]
        self.made = np.array([m for _, m in pairs.values()], np.int64)[order]
        self.cache: dict[bytes, bytes] = {}

    def merged_long(self, piece: bytes) -> list[int]:
        """Ids of one slice, with a heap of pairs and a linked list."""
        ids: list[int] = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(p[0], k, ids[k], ids[k + 1], p[1]) for k in range(len(ids) - 1) if (p := self.pairs.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, made = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j], after[k] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for left in (before[k], k):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (p := self.pairs.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (p[0], left, ids[left], ids[right], p[1]))
        return [i for i in ids if i >= 0]

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of slices as little-endian 32-bit bytes: in each round every slice makes its first best merge."""
        out: list[bytes] = [b""] * len(pieces)
        short = []
        for k, p in enumerate(pieces):
            if p in self.added:
                out[k] = self.added[p].to_bytes(4, "little")
            elif self.whole and p in self.ids:
                out[k] = self.ids[p].to_bytes(4, "little")
            elif len(p) > LONG:
                out[k] = np.array(self.merged_long(p), "<u4").tobytes()
            else:
                short.append(k)
        if not short:
            return out
        ids = self.byte[np.frombuffer(b"".join([pieces[k] for k in short]), np.uint8)]
        lengths, owner = np.array([len(pieces[k]) for k in short]), np.array(short)
        end = np.zeros(len(ids), bool)
        end[np.cumsum(lengths) - 1] = True
        rank, made = np.full(len(ids), NEVER), np.zeros(len(ids), np.int64)

        def looked_up(k: np.ndarray) -> None:
            key = ids[k] << 20 | ids[k + 1]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[found] == key
            rank[k], made[k] = np.where(hit, self.rank[found], NEVER), self.made[found]

        looked_up(np.flatnonzero(~end))
        while len(owner):
            starts = np.cumsum(lengths) - lengths
            best = np.minimum.reduceat(rank, starts)
            going = best < NEVER
            if not going.all():
                flat = ids.astype("<u4").tobytes()
                for k in np.flatnonzero(~going).tolist():
                    out[owner[k]] = flat[4 * starts[k] : 4 * (starts[k] + lengths[k])]
            segment = np.repeat(np.arange(len(owner)), lengths)
            at = np.flatnonzero((rank == best[segment]) & (rank < NEVER))
            if not len(at):
                break
            at = at[np.concatenate([[True], segment[at[1:]] != segment[at[:-1]]])]
            ids[at] = made[at]
            end[at] = end[at + 1]
            keep = going[segment]
            keep[at + 1] = False
            now = np.cumsum(keep)[at] - 1
            ids, rank, made, end = ids[keep], rank[keep], made[keep], end[keep]
            lengths, owner = lengths[going] - 1, owner[going]
            rank[now[end[now]]] = NEVER
            before = now[now > 0] - 1
            looked_up(np.concatenate([now[~end[now]], before[~end[before]]]))
        return out

    def encoded(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of different slices as little-endian 32-bit bytes, from the cache where they are in it."""
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        found = list(map(cache.get, pieces))
        if None in found:
            new = [p for p, f in zip(pieces, found) if f is None]
            cache.update(zip(new, self.merged(new)))
            found = list(map(cache.__getitem__, pieces))
        return found


def _split_pairs(ids: dict[bytes, int]) -> dict[tuple[int, int], tuple[int, int]]:
    pairs = {}
    for word, i in ids.items():
        for k in range(1, len(word)):
            if (a := ids.get(word[:k])) is not None and (b := ids.get(word[k:])) is not None:
                pairs[a, b] = i, i
    return pairs


@lru_cache(4)
def rank_file(path: str) -> Vocabulary:
    """A file of base64 bytes and ranks: any two neighbours that make a known string merge, lowest rank first."""
    with open(path, "rb") as f:
        ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Vocabulary(ids, _split_pairs(ids), True)


@lru_cache(4)
def merge_file(path: str, special: bool = True) -> Vocabulary:
    """A JSON file with a vocabulary and a list of merges, bytes written as printable characters; special: added tokens are found in texts."""
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    model, added = content["model"], (content.get("added_tokens") or []) if special else []
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"added tokens that take in white space or need word ends aren't supported: {path}")
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    known = {w: bytes(byte[c] for c in w) for w in model["vocab"] if all(c in byte for c in w)}
    ids = {b: model["vocab"][w] for w, b in known.items()}
    pairs = {}
    for rank, merge in enumerate(model["merges"]):
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        pairs[model["vocab"][a], model["vocab"][b]] = rank, model["vocab"][a + b]
    return Vocabulary(ids, pairs, False, {t["content"].encode(): t["id"] for t in added})


def _next_cut(data: np.ndarray, low: int, stop: int) -> int:
    """The first offset from low on where a token begins whatever stands before it, or stop."""
    size = 4096
    while low < stop:
        a, b = low - 1, min(low + size, stop)
        while data[a] & 0xC0 == 0x80:
            a -= 1
        while b < stop and data[b] & 0xC0 == 0x80:
            b += 1
        lead, code = _code_points(data[a:b])
        kind = _classes()[code]
        run_ends = (kind[1:] != kind[:-1]) & ((kind[:-1] == LETTER) | (kind[:-1] == NUMBER) | (kind[1:] == RUN))
        ok = np.flatnonzero(run_ends)
        if len(ok):
            return a + int(lead[ok[0] + 1])
        low, size = b, min(2 * size, SLICE)
    return stop


def cuts(data: np.ndarray, start: int, stop: int, marks: np.ndarray | None = None) -> list[int]:
    """Offsets that cut one text into parts of about SLICE bytes, none of them inside marks, rows of begin and end."""
    at = [start]
    while stop - at[-1] > SLICE:
        found = _next_cut(data, at[-1] + SLICE, stop)
        if marks is not None and len(marks) and (k := int(np.searchsorted(marks[:, 0], found)) - 1) >= 0:
            found = max(found, int(marks[k, 1]))
        if found >= stop:
            break
        at.append(found)
    return [*at, stop]


def _marks(data: np.ndarray, at: np.ndarray, pattern: re.Pattern | None) -> np.ndarray:
    """Begin and end of each added token in the texts between the offsets at."""
    if pattern is None or not pattern.search(memoryview(data)[int(at[0]) : int(at[-1])]):
        return np.zeros((0, 2), np.int64)
    found = [(int(a) + m.start(), int(a) + m.end()) for a, b in zip(at, at[1:]) for m in pattern.finditer(memoryview(data)[int(a) : int(b)])]
    return np.array(found, np.int64).reshape(-1, 2)


def encoded(batch: pa.RecordBatch, column: str, vocabulary: Vocabulary) -> Iterator[tuple[int, np.ndarray]]:
    """Row and ids of parts of the texts of a batch, in order; a long text has several parts, an empty one has one."""
    data, at = utf8(batch.column(column))
    marks = _marks(data, at, vocabulary.pattern)
    if batch.num_rows == 1:
        parts = cuts(data, int(at[0]), int(at[1]), marks)
        spans = [(np.array([0]), np.array([a, b])) for a, b in zip(parts, parts[1:])]
    else:
        spans = [(np.arange(batch.num_rows), at)]
    for rows, edges in spans:
        low, high = int(edges[0]), int(edges[-1])
        part = data[low:high]
        full = edges[:-1][edges[1:] > edges[:-1]] - low
        own = marks[(marks[:, 0] >= low) & (marks[:, 1] <= high)] - low
        if len(own):
            full = np.unique(np.concatenate([full, own.ravel()]))
            full = full[full < high - low]
        begin = boundaries(part, full)
        if len(own):
            before = np.searchsorted(own[:, 0], begin) - 1
            begin = begin[(before < 0) | (begin >= own[before, 1])]
        # slices as an Arrow column over the same bytes: equal ones are found by Arrow's hash table
        ends = np.append(begin, high - low).astype(np.int32)
        slices_ = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(part))])
        distinct = slices_.dictionary_encode()
        found = vocabulary.encoded(distinct.dictionary.to_pylist())
        which = distinct.indices.to_numpy()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        # each slice's ids are a run in those of the different slices
        size = sizes[which]
        upto = np.append(0, np.cumsum(size))
        run = np.repeat((np.cumsum(sizes) - sizes)[which] - upto[:-1], size)
        ids = np.frombuffer(b"".join(found), "<u4")[run + np.arange(len(run))]
        first = upto[np.searchsorted(begin, edges - low)]
        for k, row in enumerate(rows.tolist()):
            yield row, ids[first[k] : first[k + 1]]


def digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids of every text under the ranks in the file at path, decoded again: counts and digests of both.

    Rows in, rows out: repeated rows give repeated rows. A null text is empty: no ids, digests of nothing. A null id
    stays null. Other columns are not read.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        vocabulary = rank_file(path)
        decimal = {i: str(i).encode() for i in vocabulary.bytes}
        back = vocabulary.bytes
        for batch in slices(batches, "text", SLICE):
            pa.default_memory_pool().release_unused()  # a worker that waits for its next task keeps little
            n, ids_sha, text_sha = [0] * batch.num_rows, [hashlib.sha256() for _ in range(batch.num_rows)], [hashlib.sha256() for _ in range(batch.num_rows)]
            for row, found in encoded(batch, "text", vocabulary):
                ids = found.tolist()
                if not ids:
                    continue
                if n[row]:
                    ids_sha[row].update(b",")
                n[row] += len(ids)
                ids_sha[row].update(b",".join(map(decimal.__getitem__, ids)))
                text_sha[row].update(b"".join(map(back.__getitem__, ids)))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([h.hexdigest() for h in ids_sha]), pa.array([h.hexdigest() for h in text_sha])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids of every text with the byte offset where each begins: (doc_id, part, ids, offsets).

    A text of over SLICE bytes has several parts, in order from 0, so that no row grows without bound. The
    offsets, counted from the part's first byte, allow any span of ids to be decoded or cited alone.
    """
    schema = "doc_id long, part int, ids array<int>, offsets array<long>"

    def run(batches):
        vocabulary = rank_file(path)
        size = np.zeros(max(vocabulary.bytes) + 1, np.int64)
        for i, b in vocabulary.bytes.items():
            size[i] = len(b)
        for batch in slices(batches, "text", SLICE):
            doc, part, ids, offsets, seen = [], [], [], [], {}
            key = batch.column("doc_id").to_pylist()
            for row, found in encoded(batch, "text", vocabulary):
                own = found.astype(np.int32)
                doc.append(key[row])
                part.append(seen.get(row, 0))
                seen[row] = part[-1] + 1
                ids.append(own)
                offsets.append(np.cumsum(size[own]) - size[own])
            yield pa.record_batch(
                [pa.array(doc, pa.int64()), pa.array(part, pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int64()))],
                names=["doc_id", "part", "ids", "offsets"],
            )

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, schema)


def decode(encoded_rows: DataFrame, path: str) -> DataFrame:
    """The bytes of each part that encode() returned: (doc_id, part, bytes)."""

    def run(batches):
        back = rank_file(path).bytes
        for batch in batches:
            texts = [b"".join(back[i] for i in ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("part"), pa.array(texts, pa.binary())], names=["doc_id", "part", "bytes"])

    return encoded_rows.select("doc_id", "part", "ids").mapInArrow(run, "doc_id long, part int, bytes binary")
