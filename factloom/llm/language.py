"""Language identification by compression: the language whose dictionary makes the text shortest.

Each language has a raw-content zstandard dictionary of excerpts from about SAMPLE documents, EXCERPT characters each,
of which the last DICTIONARY bytes are kept; that bound is all that the driver gathers. Every whole text, in lower case, is compressed, block by block, with
each dictionary, so memory doesn't grow with the text. A decision is rejected when the runner-up is nearly as short.

A null text and one without a letter have no language: `und`, score 0, rejected. Ties go to the language
with more labelled rows, then to the first in the alphabet. Repeated rows get equal results. With no labelled row every text is `und`. Null ids are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import fold, plainly_named
from factloom.llm.compression import compressor, excerpt, sampled

SAMPLE = 400
EXCERPT = 280
DICTIONARY = 112 << 10
BLOCK = 2048
LEVEL = 6
#: A margin under this many bytes is narrow, and so is one under this share of the shortest length.
NARROW_BYTES = 1
NARROW_SHARE = 0.004

RESULT = "lang_pred string, score double, margin double, rejected boolean"


def learn(labelled: DataFrame, sample: int = SAMPLE, chars: int = EXCERPT) -> dict[str, bytes]:
    """Dictionary content by language, the most frequent first, from (doc_id, text, lang) with non-null lang."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    number = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    chosen = sampled(rows.select("doc_id", "lang", "text"), "lang", ["doc_id", "text"], sample, number)
    parts = chosen.select("lang", "sample__spot", excerpt("text", "doc_id", chars).alias("part")).collect()
    found: dict[str, list[str]] = {}
    for r in sorted(parts, key=lambda r: (r["lang"], r["sample__spot"])):
        found.setdefault(r["lang"], []).append(r["part"])
    return {lang: "\n".join(parts).lower().encode()[-DICTIONARY:] for lang, parts in sorted(found.items(), key=lambda x: (-number[x[0]], x[0]))}


def _predicted(dictionaries: dict[str, bytes], keep: list[str]):
    def run(batches):
        names = list(dictionaries)
        with_ = [compressor(dictionaries[n], LEVEL) for n in names]
        for batch in batches:
            pa.default_memory_pool().release_unused()  # a worker that waits for its next task keeps little
            lang, score, margin, rejected = [], [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                if not names or text is None or not any(map(str.isalpha, text)):
                    lang.append("und"), score.append(0.0), margin.append(0.0), rejected.append(True)
                    continue
                data = text.lower().encode()
                blocks = [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
                sizes = np.array([sum(len(c.compress(b)) for b in blocks) for c in with_], float)
                best = int(sizes.argmin())
                gap = float(np.partition(sizes, 1)[1] - sizes[best]) if len(sizes) > 1 else float(sizes[best])
                lang.append(names[best])
                score.append(float(1 / np.exp(-(sizes - sizes[best]) / 4).sum()))
                margin.append(gap)
                rejected.append(gap < NARROW_BYTES or gap < NARROW_SHARE * sizes[best])
            done = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.record_batch([batch.column(k) for k in keep] + done, names=keep + ["lang_pred", "score", "margin", "rejected"])

    return run


def predict(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """(doc_id, lang_pred, score, margin, rejected) of every text; lang, source and id aren't looked at."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predicted(dictionaries, ["doc_id"]), "doc_id long, " + RESULT)


def held_out() -> Column:
    return fold("doc_id", 4) == 2


def identified(docs: DataFrame) -> DataFrame:
    """Predictions for documents (doc_id, text, lang, ...), learnt from those of them that aren't held out."""
    dictionaries = learn(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs, dictionaries).withColumn("held_out", held_out())


def accepted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The documents that aren't rejected, with the given columns, of which text is one."""
    dictionaries = learn(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    inner, back = plainly_named(docs.select(*columns), ["text"])
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema.fields)
    marked = inner.mapInArrow(_predicted(dictionaries, inner.columns), f"{kept}, {RESULT}")
    return back(marked.filter(~F.col("rejected")))
