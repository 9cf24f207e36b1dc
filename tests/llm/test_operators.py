"""Each operator against a plain version on small rows: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import bpe, language, neighbours, packing, quality, sharding, simhash, stupid_backoff, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, bucket string"
EN, DE = "the and of with thing hand stand other".split(), "der die und mit keit schaft lich über".split()


def prose(words, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(words) + r.choice(words) for _ in range(n)) + "."


def texts():
    out = [prose(EN, 80 + k, k) for k in range(40)] + [prose(DE, 80 + k, k) for k in range(40)]
    out += [None, "", "   \n\t ", "a", "one two", "12 34", out[0], out[0], out[0] + " tail", "word " * 300, "x" * 5000, "é\n\n'll don't we've 字 　 end ",
        prose(EN, 6000, 99)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, None if k % 13 == 5 else ("en" if k < 40 or k >= 80 else "de"), f"src{k % 3}" if k % 7 else None, 0, "x", "y") for k,
        t in enumerate(texts())]
    rows += [rows[3], (None, "stray the and of", "en", "src0", 1, "x", "y")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


TABLES = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    known = spark.read.parquet(f"{TABLES}/documents.parquet")
    rows = language.identified(known).join(known.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'")
    right = rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert rows.count() > 150 and right >= 0.98


def test_language_ties_go_to_the_more_frequent(spark):
    rows = [(k, "aaa bbb ccc", "xx" if k % 3 else "yy", "s", 0, "", "") for k in range(60)]
    assert {r.lang_pred for r in language.identified(spark.createDataFrame(rows, SCHEMA)).collect()} == {"xx"}


def test_language(docs, nothing):
    rows = {(r.doc_id, r.lang_pred, r.rejected) for r in language.identified(docs).collect()}
    by = {k: (p, j) for k, p, j in rows}
    assert len(rows) == len(texts()) + 1 and language.identified(docs).count() == docs.count()
    assert all(by[k][0] == "en" for k in range(40)) and all(by[k][0] == "de" for k in range(40, 80))
    for k, t in enumerate(texts()):
        if not any(c.isalpha() for c in t or ""):
            assert by[k] == ("und", True)
    assert all(0 <= r.score <= 1 for r in language.identified(docs).select("score").collect())
    assert language.identified(nothing).count() == 0
    kept = language.accepted(docs, ["doc_id", "text", "score"])
    assert kept.columns == ["doc_id", "text", "score"] and kept.filter("doc_id < 80").count() == 81


def plain_fingerprint(text):
    w = words_of(lowered(text))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs):
    """pairs of id and fingerprint; the smallest id that each fingerprint reaches."""
    first = {}
    for i, f in pairs:
        first[f] = min(first.get(f, i), i)
    fps, root = list(first), {f: first[f] for f in first}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 3 and root[a] > root[b]:
                    root[a], changed = root[b], True
    return root


def test_simhash(docs, nothing):
    found = simhash.deduplicated(docs).collect()
    want = {k: plain_fingerprint(t) for k, t in enumerate(texts())}
    assert len(found) == docs.count()
    assert all(int(r.fingerprint, 16) == want[r.doc_id] for r in found if r.doc_id is not None)
    root = plain_components(want.items())
    assert all(r.component_id == root[want[r.doc_id]] for r in found if r.doc_id is not None)
    assert simhash.deduplicated(nothing).count() == 0
    kept = [r.doc_id for r in simhash.kept_one(docs.select("doc_id", "text")).collect() if r.doc_id is not None]
    assert sorted(kept) == sorted({r.component_id for r in found if r.doc_id is not None})


def test_kept_one_tells_rows_of_one_id_apart(spark):
    a, b, c, d = (prose(EN, 90, 500 + k) for k in range(4))
    rows = [(1, a), (1, b), (2, a), (3, b), (None, c), (None, c), (None, a), (4, d), (4, d), (5, None), (None, "")]
    kept = simhash.kept_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(1, a), (1, b), (None, c), (4, d), (5, None)], key=repr)


def test_simhash_of_long_texts_and_of_one_id_with_two_texts(spark):
    long = prose(EN, 40_000, 7)
    rows = [(9, long), (3, long + " x"), (5, "one two three four"), (5, "five six seven eight"), (4, "five six seven eight"), (None, "one two three four"),
        (None, "nine ten eleven")]
    found = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = collections.defaultdict(set)
    for r in found:
        by[r.fingerprint].add((r.doc_id, r.component_id))
    want = {f"{plain_fingerprint(t):016x}" for _, t in rows}
    assert set(by) == want and len(found) == len(rows)
    assert by[f"{plain_fingerprint(long):016x}"] >= {(9, 3)}
    assert by[f"{plain_fingerprint('one two three four'):016x}"] == {(5, 5), (None, 5)}
    assert by[f"{plain_fingerprint('five six seven eight'):016x}"] == {(5, 4), (4, 4)}
    assert by[f"{plain_fingerprint('nine ten eleven'):016x}"] == {(None, None)}


@pytest.mark.parametrize("chunk", [4096, 5])
def test_simhash_links_of_dense_groups(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(6)]
    prints = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(25)})
    signed = [(k, int(np.array([f], np.uint64).view(np.int64)[0])) for k, f in enumerate(prints)]
    nodes = spark.createDataFrame(signed, "node long, fingerprint long")
    found = {x.node: x.component for x in simhash.components(simhash.links(nodes)).collect()}
    root = plain_components(enumerate(prints))
    assert all(found.get(k, k) == root[f] for k, f in enumerate(prints))


def test_chain_of_segments_loses_no_close_pair():
    r = random.Random(1)
    d = np.array([sum(1 << k for k in r.sample(range(64), r.randint(0, 3))) for _ in range(2000)], np.uint64)
    passes = np.zeros(len(d), bool)
    for start in range(4):
        passes |= simhash.chain_passes(d, np.full(len(d), start))
    assert passes.all()


def test_sharding(docs, nothing):
    found = sharding.by_bytes(docs, 4).collect()
    sizes, slots, group = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    known = dict(enumerate(texts())) | {None: "stray the and of"}
    for r in found:
        t = known[r.doc_id]
        assert r.size == 16 + len((t or "").encode()) and r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        group[t].add(r.shard)
    assert len(found) == docs.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in group.values())
    big = 16 + max(len((t or "").encode()) for t in texts())  # a group larger than a share has a shard of its own
    rest = [n for n in sizes.values() if n != big]
    assert max(rest) - min(rest) < 2500
    assert sharding.by_bytes(nothing, 4).count() == 0


def test_sharding_keeps_to_its_capacity_and_to_best_fit(spark):
    r = random.Random(11)
    sizes = [r.choice([*range(1, 3000), 1500, 1500, 1500]) for _ in range(1500)]
    rows = [(k, f"{k:07d}" + "x" * n) for k, n in enumerate(sizes)] + [(9000 + k, "y" * 2000) for k in range(3)] + [(9100, "z" * 40_000), (9101, None),
        (9102, None)]
    found = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), capacity=30_000).collect()
    groups = collections.Counter()
    for _, t in rows:
        groups[t] += 16 + len(t or "")
    room = []  # what is left in each shard, by plain best fit
    for size in sorted(groups.values(), reverse=True):
        fits = [k for k, left in enumerate(room) if left >= size]
        if fits:
            room[min(fits, key=lambda k: (room[k], k))] -= size
        else:
            room.append(max(30_000, size) - size)
    held = collections.Counter()
    for x in found:
        held[x.shard] += x.size
    assert len(held) == len(room) and sum(held.values()) == sum(groups.values())
    assert sorted(held.values())[:-1] == sorted(n for n in held.values() if n <= 30_000) and max(held.values()) == 40_016


def test_best_fit_takes_the_tightest_shard():
    places, used = sharding.best_fit([(6, 2), (4, 1), (3, 2), (1, 1)], 0, capacity=10)
    assert used == 3 and places[1] == [(0, 1)] and places[2] == [(1, 1), (2, 1)] and places[3] == [(1, 1)]


def test_tree_against_a_sorted_list():
    r, tree, known = random.Random(0), sharding.Tree(), set()
    for _ in range(500):
        key = (r.randint(0, 50), r.randint(0, 50))
        if key in known:
            tree.remove(key)
            known.remove(key)
        else:
            tree.add(key)
            known.add(key)
        size = r.randint(0, 50)
        assert tree.tightest(size) == min((k for k in known if k[0] >= size), default=None)
        assert not known or tree.roomiest() == max(known)


def plain_counts(text):
    w = words_of(text)
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if words_of(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


def test_quality(spark, docs, nothing):
    extra = spark.createDataFrame([(500, "a b c a b c\na b c\n\na b c | # x\n \n \n" * 3, "en", "src1", 0, "", ""),
        (501, "# $ % " * 40, "en", "src1", 0, "", "")], SCHEMA)
    rows = docs.unionByName(extra)
    known = {r.doc_id: r.text for r in rows.collect()}
    found = quality.rules(rows).collect()
    assert len(found) == rows.count()
    for r in found:
        counts = plain_counts(known[r.doc_id])
        assert tuple(r[c] for c in quality.COUNTS) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in found if r.kept}
    assert set(range(80)) <= kept and 501 not in kept
    assert quality.rules(nothing).count() == 0
    assert {r.doc_id for r in quality.passed(rows, ["doc_id", "text", "lang", "source"]).collect()} == kept


def test_quality_fences_of_sources_and_languages(spark):
    r = random.Random(9)
    rows = []
    for k in range(900):
        source, lang = ("a", "en") if k < 400 else ("b", "en") if k < 800 else ("c", "de") if k < 850 else ("d", None)
        words = [("w" * r.randint(2, 9 if source == "b" else 6)) + str(r.randint(0, 300)) for _ in range(80)]
        if r.random() < 0.05:
            words += ["| #"] * r.randint(1, 9)
        lines = [" ".join(words[j : j + 10]) for j in range(0, 80, 10)]
        lines += lines[: r.choice([0, 0, 0, 1, 2])]
        rows.append((k, "\n".join(lines), lang, source, 0, "", ""))
    rows += [(1000, rows[0][1] + " $$$$$" * 60, "en", "a", 0, "", ""), (1001, "x" * 40 + " " + " ".join(str(k) * 30 for k in range(80)), "en", "b", 0, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = {x.doc_id: x for x in quality.rules(docs).collect()}
    groups = {x.doc_id: (x.lang, x.source) for x in docs.collect()}

    def ratios(x, n_lines):
        return {
            "symbols": x.n_symbols * 10000 // x.word_chars, "lines": x.n_dup_lines * 10000 // n_lines,
            "repeats": x.n_repeat_words * 10000 // x.n_words, "length": x.word_chars * 100 // x.n_words,
            "unit_symbols": 10000 // x.word_chars, "unit_lines": 10000 // n_lines, "unit_repeats": 20000 // n_lines,
        }

    def low_end(v):  # the least value in the sketch's bucket of v
        step = 1 << max(0, v.bit_length() - 6)
        return v if v < 64 else v // step * step

    value = {k: ratios(x, len([y for y in t.split("\n") if words_of(y)])) for k, t in ((r_[0], r_[1]) for r_ in rows) if (x := found[k]) and not x.base_failed}
    members = collections.defaultdict(list)
    for k, v in value.items():
        for g in (groups[k], groups[k][0], "all"):
            members[g].append(v)

    def top_end(v):
        return v if v < 64 else low_end(v) + (1 << max(0, v.bit_length() - 6)) - 1

    def fence(g, ratio):
        x = sorted(low_end(v[ratio]) for v in members[g])
        at = lambda x, q: x[max(0, -(-q * len(x) // 100) - 1)]
        p = {q: at(x, q) for q in (10, 50, 90, 99)}
        unit = sorted(low_end(max(1, v[f"unit_{ratio}"])) for v in members[g]) if ratio != "length" else None
        if ratio in ("lines", "repeats"):
            return None, 2 * top_end(p[99]) - p[90] if p[99] else at(unit, 50)
        spread = p[90] - p[50]
        return p[10] - 6 * (p[50] - p[10]), top_end(p[90]) + 6 * (max(spread, at(unit, 90)) if unit else spread)

    rejected = 0
    for k, x in found.items():
        lang, source = groups[k]
        g = next(g for g in ((lang, source), lang, "all") if len(members[g]) >= quality.FEW or g == "all")
        fine = not x.base_failed and all(v <= fence(g, n)[1] for n, v in value[k].items() if "unit" not in n) and value[k]["length"] >= fence(g, "length")[0]
        assert x.kept == fine, (k, value.get(k))
        rejected += not x.kept and not x.base_failed
    assert not found[1000].kept and not found[1001].kept and 0 < rejected < 90


def test_quality_keeps_rare_symbols_lines_and_windows(spark):
    r = random.Random(4)
    words = lambda n: [r.choice(EN) + str(r.randint(0, 9999)) for _ in range(n)]
    rows = []
    for k in range(400):
        own = words(r.randint(100, 300))
        if k % 20 == 3:
            own[50] = "5%"  # a twentieth of the texts hold one symbol
        lines = [" ".join(own[j : j + 10]) for j in range(0, len(own), 10)]
        if k == 200:
            lines += lines[:1]  # less than a hundredth repeat a line
        rows.append((k, "\n".join(lines), "en", "a", 0, "", ""))
    rows += [(1000, " ".join(f"{w}#$" for w in words(150)), "en", "a", 0, "", ""), (1001, "\n".join([" ".join(words(12))] * 3 + [" ".join(words(30))]), "en", "a", 0, "", "")]
    found = {x.doc_id: x.kept for x in quality.rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(found[k] for k in range(400)) and not found[1000] and not found[1001]


def test_quality_sketch_buckets_are_ordered_and_tight(spark):
    rows = spark.range(0, 5000).select(F.col("id").alias("v"), quality.bucket(F.col("id")).alias("b"))
    for r in rows.withColumn("low", quality.value_of(F.col("b"))).collect():
        assert r.low <= r.v <= r.low * (1 + 1 / 32)


def test_stupid_backoff(docs, nothing, monkeypatch):
    monkeypatch.setattr(stupid_backoff, "BUCKET", 500)
    rows = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    found = {r.doc_id: r for r in stupid_backoff.scored(rows).collect()}
    known = {r.doc_id: words_of(lowered(r.text)) for r in rows.collect()}
    count = collections.Counter(w for x in known.values() for w in x)
    long = {w for w in count if len(w.encode()) > stupid_backoff.LONGEST}
    seq = {k: [None if w in long else w for w in x] for k, x in known.items()}
    n = collections.Counter()
    for x in seq.values():
        for order in (1, 2, 3):
            n.update(zip(*[x[j:] for j in range(order)]))
    total = sum(count.values())
    for k, x in seq.items():
        score = 0.0
        for j in range(len(x)):
            three, two = tuple(x[j - 2 : j + 1]) if j > 1 else None, tuple(x[j - 1 : j + 1]) if j else None
            if three and n[three] > 1:
                score += math.log(n[three] / n[three[:2]])
            elif two and n[two] > 1:
                score += math.log(0.4 * n[two] / n[two[:1]])
            else:
                score += math.log(0.16 * n[(x[j],)] / total)
        assert found[k].n_words == len(x) and found[k].log_score == pytest.approx(score, abs=1e-6)
        assert (found[k].score is None) == (not x)
    assert stupid_backoff.scored(docs).count() == docs.count()
    assert stupid_backoff.scored(nothing).count() == 0


@pytest.mark.parametrize("sample, bucket", [(1, 300), (10**9, 10**6)])
def test_stupid_backoff_knows_every_word(spark, monkeypatch, sample, bucket):
    for name, value in (("VOCABULARY", 20), ("SAMPLE", sample), ("BUCKET", bucket)):
        monkeypatch.setattr(stupid_backoff, name, value, raising=False)
    r = random.Random(8)
    rare = [f"w{k}" for k in range(200)] + ["l" * 70, "m" * 70, "é" * 40]
    known = {k: [r.choice(["the", "of", "and"]) if r.random() < 0.5 else r.choice(rare) for _ in range(r.randint(1, 60))] for k in range(60)}
    known |= {60: ["the"] * 50, 61: known[0]}
    found = {x.doc_id: x.log_score for x in stupid_backoff.scored(spark.createDataFrame([(k, " ".join(t)) for k, t in known.items()],
        "doc_id long, text string").repartition(3)).collect()}
    n = collections.Counter(g for x in known.values() for order in (1, 2, 3) for g in zip(*[x[j:] for j in range(order)]))
    total = sum(map(len, known.values()))
    for k, x in known.items():
        score = 0.0
        for j, w in enumerate(x):
            three, two = tuple(x[j - 2 : j + 1]) if j > 1 else None, tuple(x[j - 1 : j + 1]) if j else None
            score += math.log(n[three] / n[three[:2]] if three and n[three] > 1 else 0.4 * n[two] / n[two[:1]] if two and n[two] > 1 else 0.16 * n[(w,
                )] / total)
        assert found[k] == pytest.approx(score, abs=1e-6)


def test_warc(spark, tmp_path):
    big = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 9000
    html = {0: "<p>a</p>", 1: None, 2: "", 3: big, 4: big, 5: "z" * 999, 6: "z" * 999, 7: "y" * 1000, 8: "y" * 1000, 9: "y" * 1000, 10: "\r\n" * 700}
    rows = [(k, f"http://x.org/{k}\n", h, "extra") for k, h in html.items()] + [(None, None, "n" * 1200, "extra")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    found = {r.page_id: r for r in warc.round_trip(pages, f"{tmp_path}/a").collect()}
    assert len(found) == len(rows)
    for k, h in html.items():
        data = (h or "").encode()
        assert (found[k].payload_bytes, found[k].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert {k: r.refers_to for k, r in found.items() if r.record_type == "revisit"} == {3: 4, 7: 9, 8: 9}
    chunks = warc.read(spark, f"{tmp_path}/a").filter("page_id = 4").orderBy("chunk_no").collect()
    assert len(chunks) > 2 and b"".join(bytes(c.chunk) for c in chunks) == big.encode() and chunks[-1].last
    assert all(c.sha1_so_far == hashlib.sha1(big.encode()[: c.bytes_so_far]).hexdigest() for c in chunks)
    assert warc.round_trip(pages.limit(0), f"{tmp_path}/b").count() == 0
    again = spark.createDataFrame([(1, "u", "r" * 1500), (1, "u", "r" * 1500), (1, "v", "q" * 1200), (2, "w", "q" * 1200), (None, None, None),
        (None, None, None)], "page_id long, url string, html string")
    twice = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(again, f"{tmp_path}/c").collect()]
    assert sorted(twice, key=repr) == sorted([(1, 1500, "response", None)] * 2 + [(1, 1200, "revisit", 2),
        (2, 1200, "response", None)] + [(None, 0, "response", None)] * 2, key=repr)


def test_warc_chunk_table(spark, monkeypatch):
    monkeypatch.setattr(warc, "BATCH", 1000)
    html = {1: "é" * 5000, 2: "", 3: None, 4: "x" * 400, 5: "y" * 401}
    pages = spark.createDataFrame([(k, None, h, 4 if k == 5 else None) for k, h in html.items()], "page_id long, url string, html string, refers_to long")
    rows = collections.defaultdict(list)
    for r in warc.chunks(pages, 400).orderBy("page_id", "chunk_no").collect():
        rows[r.page_id].append(r)
    for k, h in html.items():
        data = (h or "").encode()
        assert [r.last for r in rows[k]] == [False] * (len(rows[k]) - 1) + [True] and [r.chunk_no for r in rows[k]] == list(range(len(rows[k])))
        assert b"".join(bytes(r.chunk) for r in rows[k]) == (b"" if k == 5 else data) and rows[k][-1].bytes_so_far == len(data)
        assert all(r.payload_sha1 == hashlib.sha1(data[: r.bytes_so_far]).hexdigest() for r in rows[k])
    assert len(rows[1]) > 20 and len(rows[4]) == 1 and len(rows[5]) == 1


def test_packing(docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    special = ["hello <|endoftext|> world", "<|endoftext|>", "<|endoftext|><|endoftext|> a", "b  <|endoftext|>", "<|endoftext", "c<|endoftext|>'s |>  ",
        "<|endof", "text|>", "don't\n\n<|endoftext|>\n x"]
    docs = docs.unionByName(docs.sparkSession.createDataFrame([(800 + k, t, None, None, 0, "", "") for k, t in enumerate(special)], SCHEMA)).coalesce(2)
    once = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    found = packing.pack(once, path, 256).collect()
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in once.collect()}
    covered, places = collections.Counter(), collections.defaultdict(list)
    for r in found:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        covered[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert covered == {k: len(v) for k, v in ids.items()}
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 256
    assert len(places) <= sum(covered.values()) / 256 * 1.1 + 1 and sorted(places) == list(range(len(places)))
    assert packing.pack(docs, path, 256).agg(F.sum("length")).first()[0] > sum(covered.values())
    assert packing.pack(nothing, path).count() == 0


LONG = ["Слово " * 200_000, "слово" * 1000 + "," + "Долгоеслово" * 60_000 + "1" + "б" * 700_000, "漢字かな。" * 150_000,
    ("word  \n\n\t " + "don't 12.5% <|endoftext|>") * 60_000]


def test_packing_of_texts_over_a_slice(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    found = packing.pieces(spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string"), path).orderBy("doc_id", "start").collect()
    ids = [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for t in LONG]
    seen = collections.Counter()
    for r in found:
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        seen[r.doc_id] += r.length
    assert [seen[k] for k in range(len(LONG))] == [len(x) for x in ids]


def test_long_texts_are_cut_where_tokens_begin():
    for text in LONG:
        data = np.frombuffer(text.encode(), np.uint8)
        parts = bpe.cuts(data, 0, len(data))
        assert len(parts) > 2 and max(np.diff(parts)) < 3 * bpe.SLICE
        assert set(parts[1:-1]) <= set(bpe.boundaries(data, np.array([0])).tolist())


def test_shortest_pack_first_places_all():
    r = random.Random(3)
    histogram = {r.randint(1, 100): r.randint(1, 50) for _ in range(40)}
    used = collections.Counter()
    for pack, n in packing.shortest_pack_first(histogram, 100):
        assert sum(pack) <= 100 and n > 0
        for length in pack:
            used[length] += n
    assert used == histogram


@pytest.mark.parametrize("factor", [1.0, 1.5])
def test_neighbours(spark, monkeypatch, factor):
    monkeypatch.setattr(neighbours, "SHARD", 200)
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    monkeypatch.setattr(neighbours, "LEAF", 16)
    r = np.random.default_rng(0)
    x = r.normal(size=(900, 8)).astype(np.float32)
    x[300:600] = x[300]  # one frequent vector
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    rows += [(1000, None, 1), (1010, [0.0] * 8, 1), (1020, [float("nan")] * 8, 1), (1030, [float("inf")] + [1.0] * 7, 1), (1040, [1.0, None], 1),
        (1050, [1.0, 2.0], 1), rows[0]]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)
    found = neighbours.nearest(vectors, F.col("vec_id") % 10 == 0, 10, factor).collect()
    by = collections.defaultdict(list)
    for q in found:
        by[q.query_id].append((q.rank, q.vec_id, q.score))
    ids, hits = np.arange(900), 0
    assert set(by) == set(range(0, 900, 10))
    for q in by:
        d = np.zeros(900)
        for c in range(8):
            d += (x[:, c].astype(float) - float(x[q, c])) ** 2
        d = np.sqrt(d)
        d[q] = np.inf
        want = [(k + 1, int(i), float(d[i])) for k, i in enumerate(np.lexsort((ids, d))[:10])]
        if factor == 1:
            assert sorted(by[q]) == want
        hits += len({w[1] for w in want} & {w[1] for w in by[q]})
    assert hits >= 0.9 * 900
    huge = spark.createDataFrame([(k, [1e150 * (k + 1), 1.0]) for k in range(30)], "vec_id long, embedding array<double>")
    assert neighbours.nearest(huge, F.col("vec_id") % 10 == 0, 3, factor).count() == 9
    assert neighbours.nearest(vectors.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_toxicity(spark, docs, nothing):
    r = random.Random(5)
    rows, labels = [], []
    for k in range(600):
        words = [r.choice(EN) + r.choice(EN) + r.choice(EN) for _ in range(90)]
        if k % 4 == 0:
            for _ in range(4):
                words[r.randrange(90)] = r.choice(["grumpf", "zorkling", "blarg"])
        rows.append((k, " ".join(words), "en", "s", 0, "", ""))
        labels.append((k, 1, int(k % 4 == 0)))
    labels += [labels[0], (None, 1, 1), (700, 0, None)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    many = spark.createDataFrame(rows + [(900, None, None, None, None, None, None), (901, "", "", "", 0, "", ""), rows[1]], SCHEMA)
    found = toxicity.classified(many, known).collect()
    assert len(found) == many.count()
    held = [x for x in found if x.held_out and x.doc_id < 600]
    assert len(held) > 60 and sum(x.predicted == (x.doc_id % 4 == 0) for x in held) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 for x in found) and all(x.predicted == 0 for x in found if x.doc_id >= 900)
    assert toxicity.classified(nothing, known).count() == 0
    assert toxicity.classified(docs, known.limit(0)).count() == docs.count()


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    known = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").filter("toxic is not null")
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(known.select("doc_id"), "doc_id", "left_semi")
    rows = toxicity.classified(docs, known).filter("held_out").join(known, "doc_id").collect()
    hit, named, toxic = (sum(f(r) for r in rows) for f in (lambda r: r.predicted == 1 == r.toxic, lambda r: r.predicted == 1, lambda r: r.toxic == 1))
    assert toxic > 80 and hit / toxic >= 0.65 and hit / named >= 0.85


def test_toxicity_labels_that_disagree_count_as_toxic(spark):
    labels = spark.createDataFrame([(k, t) for k in range(50) for t in ((0, 1) if k % 2 else (0,))], "doc_id long, toxic int")
    docs = spark.createDataFrame([(k, "blarg zork words here " * 5 if k % 2 else "plain words are here " * 5) for k in range(50)], "doc_id long, text string")
    found = {r.doc_id: r.score for r in toxicity.classified(docs, labels).collect()}
    assert min(v for k, v in found.items() if k % 2) >= max(v for k, v in found.items() if k % 2 == 0)


def test_bpe_of_texts_over_a_slice(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts_ = [LONG[0], LONG[2], LONG[3]]
    for r in bpe.digests(spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string"), path).collect():
        ids = plain.encode_ordinary(texts_[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts_[r.doc_id].encode()).hexdigest()


def test_bpe(docs, nothing):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    known = {r.doc_id: r.text or "" for r in docs.collect()}
    found = bpe.digests(docs, path).collect()
    assert len(found) == docs.count()
    for r in found:
        ids = plain.encode_ordinary(known[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(known[r.doc_id].encode()).hexdigest()
    assert bpe.digests(nothing, path).count() == 0
    once = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    encoded = bpe.encode(once, path)
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(encoded, path).collect()}
    assert back == {k: v.encode() for k, v in known.items() if k is not None}
    offsets = {r.doc_id: (r.ids, r.offsets) for r in encoded.collect()}
    ids, at = offsets[0]
    assert all(known[0].encode()[a:b] == plain.decode_single_token_bytes(i) for i, a, b in zip(ids, at, [*at[1:], None]))


def test_bpe_boundaries_on_odd_texts():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(2)
    for _ in range(3000):
        text = "".join(r.choice("aab'sstdrevlm  \n\t 　é字1²,.!?'’\U0001f600") for _ in range(r.randint(0, 40)))
        data = np.frombuffer(text.encode(), np.uint8)
        begin = bpe.boundaries(data, np.array([0])) if text else np.zeros(0, int)
        raw, ends = text.encode(), [*begin[1:].tolist(), len(data)]
        pieces = [raw[a:b] for a, b in zip(begin.tolist(), ends)]
        got = np.frombuffer(b"".join(bpe.rank_file(path).encoded(pieces)), "<u4").tolist()
        assert got == plain.encode_ordinary(text), ascii(text)
