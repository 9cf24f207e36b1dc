"""Spelling variant grouping: near words by range searches in k-d trees over letter counts.

Words are runs of letters of at least MIN_LENGTH code points that occur at least twice. A word is a point: how often it has
each of the 90 letters. A replaced letter moves one unit down and one up (an L1 distance of two), an added one moves one up.
So for a length pair (l, l) a search asks for all points one up and one down, for (l, l + 1) all points one up. At each
split (a letter, a count) of the tree, a search goes to the side where its point lies, and over the split only if it lies
next to it and that move isn't spent. That prunes boxes exactly: each near word lies in a box that is visited, and no box
is visited twice.

There is a tree for each length. Its upper part, at most LEAVES boxes in all, is fitted on about SAMPLE words that a hash
of the word chooses (all words up to that number); every word is indexed. Words go to their box, searches to all boxes
that they reach (a dozen or two, as the square of the tree's depth), and one shuffle brings them together, words before
searches. A task holds the words of one box, at most BLOCK at a time (words that share all their letters can't be told
apart by counts and are dealt over blocks by hash, their searches go to each), builds the lower part of the tree over them,
and streams the searches through. Points that are near by counts are verified letter by letter. Pairs never become rows:
a task passes on how many near words each word has there and the best of them.

Chains of forms, which grow tenfold at each step and so are short, are followed by pointer doubling.

Null and empty texts have no words. Repeated rows count again. A null id counts as empty text in the digest that decides on
deletions. Runs of any length are words. Empty tables give no rows. Only the id and the text are read. Words are in Latin
letters, one byte each in Latin-1; other alphabets aren't words here.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import checkpointed

MIN_LENGTH, MIN_COUNT, DELETED, FORM_TIMES = 7, 2, 31, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words on which the upper trees are fitted, about; words of a box and of a leaf in it, about; boxes at most.
SAMPLE, BOX, LEAF, LEAVES = 131_072, 2048, 512, 8192
#: Words of a box that one task holds at a time.
BLOCK = 65_536
#: Cells of a matrix of searches by words.
CELLS = 1 << 22

LETTERS = 90
#: The number of each letter, by its byte in Latin-1.
NUMBER = np.zeros(256, np.int64)
NUMBER[97:123] = np.arange(26)
NUMBER[192:256] = np.arange(26, LETTERS)

WORD, SAME, LONGER = range(3)


def counts_of(letters: np.ndarray) -> np.ndarray:
    """How often each of the words, rows of bytes, has each letter."""
    n = len(letters)
    flat = (np.arange(n)[:, None] * LETTERS + NUMBER[letters]).ravel()
    return np.bincount(flat, minlength=n * LETTERS).reshape(n, LETTERS).astype(np.int32)


def marks_of(counts: np.ndarray) -> np.ndarray:
    """64 bits of which a move of one unit changes at most one: a to z at least once, at least twice; the others by twelves."""
    once, twice = counts[:, :26] > 0, counts[:, :26] > 1
    rest = np.zeros((len(counts), 12), bool)
    for k in range(26, LETTERS):
        rest[:, k % 12] |= counts[:, k] > 0
    return np.packbits(np.hstack([once, twice, rest]), axis=1).view(np.uint64).ravel()


class Tree:
    """A k-d tree: node k splits by letter[k] at more than limit[k] into left[k] and right[k]; leaves have letter -1."""

    def __init__(self, counts: np.ndarray, most: int):
        self.letter, self.limit, self.left, self.right = [-1], [0], [0], [0]
        todo = [(0, np.arange(len(counts)))]
        while todo:
            node, own = todo.pop()
            if len(own) <= most:
                continue
            here = counts[own]
            best = (0, 0, 0)
            for limit in range(int(here.max(initial=0))):
                over = (here > limit).sum(0)
                even = np.minimum(over, len(own) - over)
                k = int(even.argmax())
                if even[k] <= best[0] and limit > 3:
                    break
                best = max(best, (int(even[k]), k, limit), key=lambda x: x[0])
            if not best[0]:
                continue
            _, letter, limit = best
            self.letter[node], self.limit[node] = letter, limit
            over = here[:, letter] > limit
            for side, part in ((self.left, own[~over]), (self.right, own[over])):
                side[node] = len(self.letter)
                for column, empty in ((self.letter, -1), (self.limit, 0), (self.left, 0), (self.right, 0)):
                    column.append(empty)
                todo.append((side[node], part))

    def leaves(self, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each leaf with the points that lie in it."""
        yield from ((leaf, own) for leaf, own in self.reached(counts, False, False))

    def reached(self, counts: np.ndarray, up: bool = True, down: bool = True) -> Iterator[tuple[int, np.ndarray]]:
        """Each leaf with the points from which it is reached by at most one unit up and one down, as far as allowed."""
        none = np.full(len(counts), -1, np.int64)
        spent = np.full(len(counts), -2, np.int64)
        todo = [(0, np.arange(len(counts)), none if up else spent, none if down else spent)]
        while todo:
            node, own, ups, downs = todo.pop()
            letter, limit = self.letter[node], self.limit[node]
            if letter < 0:
                yield node, own
                continue
            at = counts[own, letter] + (ups == letter) - (downs == letter)
            over = at > limit
            rise = (at == limit) & (ups == -1) & (downs != letter)
            fall = (at == limit + 1) & (downs == -1) & (ups != letter)
            to_right, to_left = over | rise, ~over | fall
            if to_right.any():
                todo.append((self.right[node], own[to_right], np.where(rise, letter, ups)[to_right], downs[to_right]))
            if to_left.any():
                todo.append((self.left[node], own[to_left], ups[to_left], np.where(fall, letter, downs)[to_left]))


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words of one length, row by row, differ in exactly one place."""
    return (a != b).sum(1) == 1


def one_added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether b, one longer, is a with one letter added."""
    before = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(1)
    after = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return before + after >= a.shape[1]


class Box:
    """The words of a box, best first: most occurrences, then in code-point order."""

    def __init__(self, letters: np.ndarray, n: np.ndarray):
        order = np.lexsort((as_words(letters), -n))
        self.letters, self.n = letters[order], n[order]
        self.counts = counts_of(self.letters)
        self.marks = marks_of(self.counts)
        tree = Tree(self.counts, LEAF)
        self.tree, self.parts = tree, dict(tree.leaves(self.counts))

    def near(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (search, word) of near words."""
        longer = letters.shape[1] < self.letters.shape[1]
        counts = counts_of(letters)
        marks = marks_of(counts)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for leaf, own in self.tree.reached(counts, True, not longer):
            words = self.parts.get(leaf)
            if words is None:
                continue
            step = max(1, CELLS // len(words))
            for k in range(0, len(own), step):
                some = own[k : k + step]
                i, j = np.nonzero(np.bitwise_count(marks[some][:, None] ^ self.marks[words]) <= (1 if longer else 2))
                i, j = some[i], words[j]
                for m in range(0, len(i), step_ := max(1, CELLS // letters.shape[1])):
                    a, b = i[m : m + step_], j[m : m + step_]
                    same = (one_added if longer else one_replaced)(letters[a], self.letters[b])
                    found.append((a[same], b[same]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def as_words(letters: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(letters).view(f"S{letters.shape[1]}").ravel()


def best_of(of: np.ndarray, other: np.ndarray, letters: np.ndarray, others: np.ndarray, n: np.ndarray) -> tuple[list, list, list, list]:
    """For each different index in `of`: its word, how many pairs it has, and n and word of the first in order of `other`."""
    order = np.lexsort((other, of))
    of, other = of[order], other[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(of)))
    name = [w.decode("latin-1") for w in as_words(letters[of[first]]).tolist()] if len(first) else []
    best = [w.decode("latin-1") for w in as_words(others[other[first]]).tolist()] if len(first) else []
    return name, sizes.tolist(), n[other[first]].tolist(), best


def runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n): all runs of letters that are still long enough after deletions, with how often they occur."""
    doc, text = F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.col(text_column).cast("string")
    pattern = f"[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}"  # a deletion makes no word longer
    each = docs.select(doc.alias("doc"), F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("run"))
    each = each.select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    each = each.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at: Column = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % DELETED == 0, cut).otherwise(F.col("run"))
    return each.select(word.alias("word")).filter(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _by_length(column: pa.Array, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of a binary column as rows of bytes, one length at a time, with their n."""
    words = column.to_pylist()
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        yield np.frombuffer(b"".join([words[k] for k in own]), np.uint8).reshape(-1, size), n[own]


def _fitted(words: list[str], total: int) -> dict[int, Tree]:
    """The upper tree of each length, from a sample of `total` words."""
    share = max(len(words), 1) / max(total, 1)
    most = max(BOX * share, SAMPLE / LEAVES, 1)
    by_length: dict[int, list[bytes]] = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w.encode("latin-1"))
    return {size: Tree(counts_of(np.frombuffer(b"".join(own), np.uint8).reshape(-1, size)), int(most)) for size, own in by_length.items()}


def routed(words: DataFrame, trees: dict[int, Tree], blocks: dict[int, int], searches: bool = True) -> DataFrame:
    """(box, role, words, n): each word in its box, and as a search in each block of each box that it reaches.

    A row has all words of a batch for that box, one after the other as all are of one length, and their n as 64-bit numbers.
    """
    whole = Tree(np.zeros((0, LETTERS), np.int32), 1)

    def run(batches):
        for batch in batches:
            out: list[tuple[int, int, bytes, bytes]] = []
            latin = pa.array([w.encode("latin-1") for w in batch.column("word").to_pylist()], pa.binary())
            for letters, n in _by_length(latin, batch.column("n").to_numpy()):
                size, counts = letters.shape[1], counts_of(letters)
                for role, length in ((WORD, size), (SAME, size), (LONGER, size + 1))[: 3 if searches else 1]:
                    tree = trees.get(length, whole)
                    for leaf, own in tree.leaves(counts) if role == WORD else tree.reached(counts, True, role == SAME):
                        box = length << 20 | leaf
                        dealt = blocks.get(box, 1)
                        place = np.array([zlib.crc32(w) % dealt for w in as_words(letters[own]).tolist()]) if role == WORD and dealt > 1 else None
                        for k in range(dealt):
                            some = own if place is None else own[place == k]
                            if len(some):
                                out.append((box << 16 | k, role, letters[some].tobytes(), n[some].tobytes()))
            columns = zip(*out) if out else [[]] * 4
            types = pa.int64(), pa.int32(), pa.binary(), pa.binary()
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["box", "role", "words", "n"])

    return words.mapInArrow(run, "box long, role int, words binary, n binary")


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each word has of near words in each box; rows come by box, words before searches."""
    names = ["word", "n_near", "best_n", "best"]
    held, parts, box = None, [], None
    for batch in batches:
        boxes, roles = batch.column("box").to_numpy(), batch.column("role").to_numpy()
        words, counts = batch.column("words"), batch.column("n")
        edges = np.append(np.flatnonzero(np.append(True, (np.diff(boxes) != 0) | (np.diff(roles) != 0))), len(boxes))
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if boxes[low] != box:
                held, parts, box = None, [], boxes[low]
            size = int(box >> 36) - int(roles[low] == LONGER)
            letters = np.frombuffer(b"".join(words.slice(low, high - low).to_pylist()), np.uint8).reshape(-1, size)
            n = np.frombuffer(b"".join(counts.slice(low, high - low).to_pylist()), np.int64)
            if roles[low] == WORD:
                parts.append((letters, n))
                continue
            if not parts:
                continue
            if held is None:
                held = Box(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            order = np.lexsort((as_words(letters), -n))
            letters, n = letters[order], n[order]
            search, word = held.near(letters)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(best_of(search, word, letters, held.letters, held.n), TYPES)], names=names)
            if roles[low] == LONGER:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(best_of(word, search, held.letters, letters, n), TYPES)], names=names)


TYPES = pa.string(), pa.int64(), pa.int64(), pa.string()


def nearest(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of each of words (word, n) that has a near word; words are read four times, so keep them first."""
    total = words.count()
    share = min(1.0, SAMPLE / max(total, 1))
    sample = words.filter(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))).select("word").collect()
    trees = _fitted([r.word for r in sample], total)
    held = routed(words, trees, {}, searches=False).groupBy("box").agg(F.sum(F.octet_length("n") / 8).cast("long").alias("words"))
    blocks = {r.box >> 16: -(-r.words // BLOCK) for r in held.filter(F.col("words") > BLOCK).collect()}
    rows = routed(words, trees, blocks).repartition("box").sortWithinPartitions("box", "role")
    found = rows.mapInArrow(_searched, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def rooted(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) for (word, form), by doubling the way at each of a number of steps."""
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(steps):
        now = checkpointed(now)
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return now


def grouped(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word."""
    words = checkpointed(runs(docs, id_column, text_column).filter(F.col("n") >= MIN_COUNT))
    most = words.agg(F.max("n")).first()[0] or 0
    is_form = F.col("best_n") >= FORM_TIMES * F.col("n")
    near = words.join(nearest(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    near = checkpointed(near)
    # a chain's counts grow tenfold a step, from MIN_COUNT at least to the largest at most
    longest = len(str(most // MIN_COUNT))
    roots = rooted(near.filter(F.col("form").isNotNull()), max(0, (longest - 1).bit_length()))
    return near.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
