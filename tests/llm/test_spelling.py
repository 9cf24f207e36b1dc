"""Spelling variants against plain loops over all pairs."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from factloom.llm import spelling

SCHEMA = "doc_id long, text string, n long, word string, run string"


def plain(rows):
    """(word, n, n_near, form, form_n, root) by comparing all pairs."""
    seen = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            seen[word] += len(word) >= 7
    n = {w: c for w, c in seen.items() if c >= 2}
    near = collections.defaultdict(set)
    for a, b in itertools.permutations(n, 2):
        if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b))):
            near[a].add(b)
            near[b].add(a)
    form = {}
    for w in n:
        if near[w] and n[best := min(near[w], key=lambda x: (-n[x], x))] >= 10 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root(w)) for w in n}


def corpus():
    r = random.Random(3)
    base = ["language", "Spracheße", "variation", "spelling", "étésüßer", "mississippi", "abcdefg", "ÉCOLE×ST"]
    texts = []
    for w in base:
        for k in range(120):
            v = list(w)
            at = r.randrange(len(v))
            kind = r.randrange(12)
            if kind == 0:
                v[at] = r.choice("abcxyzéß")
            elif kind == 1:
                del v[at]
            elif kind == 2:
                v.insert(at, r.choice("aeiouÿ"))
            texts.append("".join(v) + " " + "".join(v).upper())
    texts += [("wordone " * 3000), ("wordonf " * 200), ("wordomf " * 15), "wordxmf wordxmf", None, "", "123 !?", "short words only", "z" * 5000 + " " + "z" * 5000, ("z" * 4999 + " ") * 2]
    return [(k if k % 17 else None, t) for k, t in enumerate(texts)] + [(1, texts[1])] * 2


@pytest.mark.parametrize("sizes", [{}, {"SAMPLE": 40, "BOX": 3, "LEAF": 2, "LEAVES": 20}, {"BLOCK": 4, "CELLS": 50}])
def test_equals_all_pairs(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(spelling, name, value)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1, "w", "r") for d, t in rows], SCHEMA).repartition(3)
    assert {tuple(r) for r in spelling.grouped(docs).select("word", "n", "n_near", "form", "form_n", "root").collect()} == plain(rows)


def test_words_of_the_same_letters_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 100)
    words = ["".join(p) + "xx" for p in itertools.islice(itertools.permutations("abcdefg"), 0, 5040, 7)]
    rows = [(0, " ".join(words)), (7, " ".join(words)), (9, " ".join(w[1:] for w in words))]
    docs = spark.createDataFrame([(d, t, 1, "", "") for d, t in rows], SCHEMA)
    assert {tuple(r) for r in spelling.grouped(docs).collect()} == plain(rows)
    kept = spelling.runs(docs).filter("n > 1").withColumn("n", spelling.F.col("n"))
    boxes = spelling.routed(kept, {}, {9 << 20: 8}).filter("role = 0").groupBy("box").count().collect()
    assert sum(r.box >> 36 == 9 for r in boxes) == 8


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert spelling.grouped(none).collect() == []
    assert spelling.grouped(spark.createDataFrame([(1, None, 1, "", "")], SCHEMA)).collect() == []


def test_each_reachable_leaf_is_visited_once():
    r = np.random.default_rng(1)
    counts = np.zeros((400, spelling.LETTERS), np.int32)
    counts[:, :6] = r.integers(0, 4, (400, 6))
    tree = spelling.Tree(counts, 3)
    leaf_of = {int(k): leaf for leaf, own in tree.leaves(counts) for k in own}
    assert len(leaf_of) == 400
    visits = collections.Counter((leaf, int(k)) for leaf, own in tree.reached(counts) for k in own)
    assert max(visits.values()) == 1
    for a, b in itertools.product(range(0, 400, 9), range(400)):
        move = counts[b] - counts[a]
        if move.max() <= 1 and move.min() >= -1 and (move == 1).sum() <= 1 and (move == -1).sum() <= 1:
            assert visits[leaf_of[b], a] == 1
