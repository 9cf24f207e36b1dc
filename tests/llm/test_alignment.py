"""Alignment of two tokenizers against the libraries and plain loops."""

import collections
import hashlib

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from factloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, n_a string, pairs string"
TEXTS = [
    "The cat sat on the mat.", "The cat sat on the mat.", None, "", " ", "  two  spaces ", "tabs\tand\n\nlines \n", "ünïcödé façade Straße",
    "字字字 mixed 字", "😀 emoji 👩‍👩‍👧", "a▁b holds the mark", "▁", "<s> </s> <unk> <|endoftext|> <0x41>", "x" * 9000, "word " * 4000, "\x00 nul \x7f",
    "no break ﻿   marks", "ﬁ ligature Å Å", "0123456789 3.14", "don't we'll I'M",
]


def plain(texts):
    """Groups, links and counts with the libraries, one token at a time."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)}
    of_a = lambda i: bytes(byte[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, counts = [], collections.Counter()
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        whole = (" " + text).encode() if text else b""
        if not text or b"".join(map(of_a, ids_a)) != whole or b"".join(map(of_b, ids_b)) != whole:
            found.append(([], [], [], []))
            continue
        spans = []
        for ids, of in ((ids_a, of_a), (ids_b, of_b)):
            at, ends = 0, []
            for i in ids:
                at += len(of(i))
                ends.append(at)
            spans.append(ends)
        links = [(i, j) for i, e in zip(ids_a, spans[0]) for j, f in zip(ids_b, spans[1]) if e == f] if len(ids_a) < 4000 else None
        cuts = sorted(set(spans[0]) & set(spans[1]))
        if links is None:
            at = [dict(zip(e, ids)) for e, ids in zip(spans, (ids_a, ids_b))]
            links = [(at[0][c], at[1][c]) for c in cuts]
        groups, low = [], 0
        for c in cuts:
            groups.append(tuple(",".join(str(i) for i, e in zip(ids, ends) if low < e <= c) for ids, ends in zip((ids_a, ids_b), spans)) if len(cuts) < 4000 else None)
            low = c
        counts.update(links)
        found.append((ids_a, ids_b, groups, links))
    highest = collections.defaultdict(int)
    for (_, j), n in counts.items():
        highest[j] = max(highest[j], n)
    rows = []
    for ids_a, ids_b, groups, links in found:
        text = ";".join("|".join(g) for g in groups) if None not in groups else None
        digest = hashlib.sha256(text.encode()).hexdigest() if text else text
        rows.append((len(ids_a), len(ids_b), len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return rows


def test_alignment_equals_the_libraries(spark):
    rows = [(k, t, "en", "", "") for k, t in enumerate(TEXTS)] + [(3, "stray", None, "", ""), (3, "stray", None, "", ""), (None, "no id", None, "", "")]
    got = alignment.counted(spark.createDataFrame(rows, SCHEMA).repartition(3), A, B).collect()
    columns = "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    want = sorted(((r[0], *w) for r, w in zip(rows, plain([r[1] for r in rows]))), key=repr)
    have = sorted(((r.doc_id, *(r[c] for c in columns)) for r in got), key=repr)
    assert len(have) == len(want)
    for h, w in zip(have, want):
        assert h[:-1] == w[:-1] and w[-1] in (None, h[-1]), (h, w)


def test_texts_without_tokens(spark):
    rows = spark.createDataFrame([(k, t, "", "", "") for k, t in enumerate([None, "", "a▁b"])], SCHEMA)
    assert {tuple(r)[1:] for r in alignment.counted(rows, A, B).collect()} == {(0, 0, 0, 0, 0, 0, "")}
    assert alignment.counted(rows.limit(0), A, B).count() == 0


def test_pair_counts(spark):
    rows = spark.createDataFrame([(1, "the the the", "", "", ""), (2, "the", "", "", "")], SCHEMA)
    found = alignment.pair_counts(alignment.sliced(rows, A, B), A, B).collect()
    assert [r.n for r in found] == [4]


@pytest.mark.parametrize("size", [10, 1 << 19])
def test_slices_change_nothing(spark, monkeypatch, size):
    monkeypatch.setattr(alignment, "SLICE", size)
    monkeypatch.setattr(alignment.bpe, "SLICE", 64)
    rows = [(k, t, "", "", "") for k, t in enumerate(TEXTS[:9])]
    table = spark.createDataFrame(rows, SCHEMA).coalesce(1).select("doc_id", "text").toArrow().combine_chunks().to_batches()
    got = [None if g is None else (g.ids_a.tolist(), g.ids_b.tolist()) for b in alignment.slices(table, "text", size) for g in alignment.aligned(b, A, B)]
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    assert got == [(a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else None for t in TEXTS[:9]]
