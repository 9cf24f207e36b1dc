"""Toxicity by compression distance: windows of text under a toxic and an ordinary zstandard dictionary.

Both dictionaries end in the same words of ordinary text; the toxic one begins with what is left of toxic texts without
the words that ordinary ones have as well (likelihood ratio, copies of one text counting once), so a window that the toxic
dictionary makes shorter holds toxic wording. Dictionaries of whole windows of toxic and ordinary text, raw or trained,
don't tell the classes apart where toxic wording is a few words of a document: README has the figures.
A text is cut at words into windows of about `WINDOW` bytes; its features are how the two lengths differ over all
windows, and a logistic regression over them calibrates the score.

Words and calibration come from about `SAMPLE` labelled documents of each class with at most `EXCERPT` characters
each, one half for the words and one for the calibration; classes are weighed by their share of all labelled rows.

Null and empty texts have no window and get the score of no evidence. Repeated rows get equal scores. A document with
several labels counts as toxic if one says so. Without labels of both classes every score is the share of toxic ones.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import checkpointed, fold, small
from factloom.llm.compression import compressor, excerpt, sampled

SAMPLE = 4000
EXCERPT = 8192
WINDOW = 64
LEVEL = 9
#: Likelihood ratio from which a word counts as toxic wording; bytes of each dictionary part.
RATIO = 18.0
TOXIC, ORDINARY = 8 << 10, 16_000
#: Bytes of a text that are cut into windows in one go.
PART = 1 << 20

FEATURES = ["most", "second", "count", "share"]


def held_out() -> Column:
    return fold("doc_id", 5) == 0


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def different(texts: list[str]) -> list[str]:
    """The texts without those that share two of their eight least three-word shingles with one before them: copies."""
    seen, out = set(), []
    for t in texts:
        w = _words(t)
        least = sorted({zlib.crc32(b" ".join(w[k : k + 3])) for k in range(max(1, len(w) - 2))})[:8]
        if sum(h in seen for h in least) < min(2, len(least)):
            out.append(t)
        seen.update(least)
    return out


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Content of the toxic and the ordinary dictionary."""
    dt, do = Counter(), Counter()
    toxic, ordinary = different(toxic), different(ordinary)
    for count, texts in ((dt, toxic), (do, ordinary)):
        for t in texts:
            count.update(set(_words(t)))
    nt, no = max(1, len(toxic)), max(1, len(ordinary))

    def ratio(w: bytes) -> float:
        a, b = dt[w], do[w]
        if a / nt <= b / no:
            return 0.0
        each = (a + b) / (nt + no)
        return 2 * (a * math.log(a / (each * nt)) + (b * math.log(b / (each * no)) if b else 0))

    ratios = {w: ratio(w) for w in dt}
    wording = sorted((w for w, r in ratios.items() if r > RATIO), key=lambda w: (ratios[w], w))
    common = b" ".join(sorted(do, key=lambda w: (do[w], w)))[-ORDINARY:]
    return (b" " + b" ".join(wording) + b" ")[-TOXIC:] + common, common


def _windows(text: str | None):
    data = (text or "").encode().lower()
    start = 0
    while start < len(data):
        part = data[start : start + PART]
        if start + PART < len(data):
            cut = max(part.rfind(b" "), part.rfind(b"\n"))
            part = part[: cut + 1] if cut > 0 else part
        start += len(part)
        held, size = [], 0
        for w in part.split():
            held.append(w)
            size += len(w) + 1
            if size >= WINDOW:
                yield b" " + b" ".join(held)
                held, size = [], 0
        if held:
            yield b" " + b" ".join(held)


def _features(content: tuple[bytes, bytes]):
    def run(batches):
        toxic, ordinary = (compressor(c, LEVEL).compress for c in content)
        for batch in batches:
            out: list[list[float]] = [[], [], [], []]
            for text in batch.column("text"):
                most = second = count = n = 0
                for w in _windows(text.as_py()):
                    d = len(ordinary(w)) - len(toxic(w))
                    n += 1
                    count += d >= 4
                    if d > second:
                        most, second = max(most, d), min(max(most, second), d) if d <= most else most
                for column, value in zip(out, (most, second, count, count / max(1, n))):
                    column.append(float(value))
            rest = [batch.column(k) for k in range(batch.num_columns) if batch.schema.names[k] != "text"]
            names = [k for k in batch.schema.names if k != "text"]
            yield pa.record_batch(rest + [pa.array(c, pa.float64()) for c in out], names=names + FEATURES)

    return run


def features(docs: DataFrame, content: tuple[bytes, bytes]) -> DataFrame:
    """The columns of docs but its text, and how the windows' lengths differ."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return docs.mapInArrow(_features(content), kept + "".join(f", {k} double" for k in FEATURES))


def _inputs(columns: list[np.ndarray]) -> np.ndarray:
    most, second, count, share = columns
    return np.column_stack([np.ones(len(most)), most, second, np.log1p(count), 20 * np.minimum(share, 0.25)])


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients of a ridge logistic regression by Newton's method."""
    beta = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * 0.05
    ridge[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[tuple[bytes, bytes], list[float]]:
    """Dictionaries and coefficients, from rows of docs (doc_id, text) with a label (doc_id, toxic) that aren't held out."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = sum(share.values())
    chosen = sampled(known, "toxic", ["doc_id"], sample, share).select("doc_id", "toxic", F.pmod("sample__spot", F.lit(2)).alias("half"))
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", excerpt("text", "doc_id", EXCERPT).alias("text"))
    rows = checkpointed(texts.join(small(chosen, 2 * sample), "doc_id").dropDuplicates(["doc_id"]))
    gathered = rows.filter("half = 0").orderBy("doc_id").select("toxic", "text").collect()
    content = dictionaries(*([r["text"] for r in gathered if (r["toxic"] > 0) == t] for t in (True, False)))
    seen = features(rows.filter("half = 1").select("toxic", "text"), content).collect()
    y = np.array([float(r["toxic"] > 0) for r in seen])
    if not 0 < y.sum() < len(y):
        p = (share.get(1, 0) + 0.5) / (total + 1)
        return content, [math.log(p / (1 - p)), 0.0, 0.0, 0.0, 0.0]
    x = _inputs([np.array([r[k] for r in seen]) for k in FEATURES])
    toxic = sum(n for k, n in share.items() if k > 0)
    weight = np.where(y > 0, toxic / y.sum(), (total - toxic) / (1 - y).sum()) * len(y) / total
    return content, fit(x, y, weight).tolist()


def scored(docs: DataFrame, model: tuple[tuple[bytes, bytes], list[float]]) -> DataFrame:
    """(doc_id, score, predicted, features) of every whole text; lang, source and id aren't looked at."""
    content, beta = model
    rows = features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), content)
    z = (
        F.lit(beta[0]) + F.lit(beta[1]) * F.col("most") + F.lit(beta[2]) * F.col("second")
        + F.lit(beta[3]) * F.log1p("count") + F.lit(beta[4]) * 20 * F.least(F.col("share"), F.lit(0.25))
    )
    score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    return rows.withColumn("score", score).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = learn(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", *FEATURES)
