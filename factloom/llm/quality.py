"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document gets counts (words, symbols, repeated lines and windows) and four ratios in whole ten-thousandths.
The ratios' distribution in each language and source is kept as a mergeable quantile sketch: a histogram whose
buckets are exact up to 63 and 1/32 wide relative to the value above. Sketches merge by adding counts, in any order
and with the same result, so a lost task changes nothing, and a source with few documents takes the merged sketch of
its language, a rare language that of all. Fences replace fixed cutoffs and are as wide as the sketch says. Symbols and
mean word length may lie above the 90th percentile by WIDE times what lies between that and the median. Repeated lines and
windows, which sound documents have as well, may lie above the 99th percentile by as much as that is above the 90th. Mean
word length has a fence below as well. Documents are filtered by a join with the fences.

Where nearly all documents have none of something, percentiles say nothing about how much is much. So the sketches also hold
units, what one symbol or one repeated line changes in the ratios of a document: symbols have at least WIDE times the unit that
nine of ten documents don't exceed, and where the 99th percentile of repeats is 0, one unit of the median document is allowed.

A null text has no words. Null languages and sources are groups of their own. Texts under three words have no
window. Ratios without a denominator are 0. Repeated rows are judged each for itself. Extra columns stay unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import SPACE, checkpointed, plainly_named, small

#: Documents below which a sketch is merged into the next wider one.
FEW = 200
#: How many times the distance from the median to the 90th (10th) percentile a ratio may lie beyond it.
WIDE = 6
RATIOS = ["symbols", "lines", "repeats", "length"]
#: Ratios whose fence comes from their tail.
TAILED = ["lines", "repeats"]

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def counted(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with COUNTS, n_lines and base_failed, and without the text."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    kept = [F.col(c) for c in rows.columns if c != text]
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    split = rows.select(
        *kept,
        F.array_remove(F.split(t, f"[{SPACE}]+"), "").alias("q__words"),
        lines.alias("q__lines"),
        (F.size(F.split(t, r"[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
    )
    n = F.size("q__words")
    windows = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("q__words", i), F.get("q__words", i + 1), F.get("q__words", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    hashed = split.select(
        *kept, "n_symbols",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("q__words", "")).cast("long").alias("word_chars"),
        F.size("q__lines").cast("long").alias("n_lines"),
        (F.size("q__lines") - F.size(F.array_distinct("q__lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("q__windows"),
    )
    # only texts with a repeated window go through the sort
    repeats = F.size(F.array_distinct("q__windows")) < F.size("q__windows")
    placed = F.transform("q__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = hashed.withColumn("q__sorted", F.when(repeats, F.array_sort(placed))).drop("q__windows")
    same = lambda s, k: F.get("q__sorted", k)["h"].eqNullSafe(s["h"])
    twice = F.filter("q__sorted", lambda s, k: same(s, k - 1) | same(s, k + 1))
    at = F.array_sort(F.transform(twice, lambda s: s["i"]))
    spots = ordered.withColumn("q__at", at).drop("q__sorted")
    start = F.struct(F.lit(-3).alias("before"), F.lit(0).cast("long").alias("total"))
    covered = F.aggregate(
        "q__at", start, lambda s, p: F.struct(p.alias("before"), (s["total"] + F.least(F.lit(3), p - s["before"])).alias("total")), lambda s: s["total"]
    )
    out = spots.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("q__at")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _ratio(above: str, below: str, scale: int = 10_000) -> Column:
    return F.when(F.col(below) > 0, F.floor(F.col(above) * scale / F.col(below))).otherwise(0).cast("long")


def ratios() -> dict[str, Column]:
    return {
        "symbols": _ratio("n_symbols", "word_chars"),
        "lines": _ratio("n_dup_lines", "n_lines"),
        "repeats": _ratio("n_repeat_words", "n_words"),
        "length": _ratio("word_chars", "n_words", 100),
    }


def units() -> dict[str, Column]:
    """What the least change of a count changes in the ratio."""
    return {f"unit_{k}": F.greatest(F.lit(1).cast("long"), F.coalesce(F.floor(F.try_divide(F.lit(scale), F.col(below))), F.lit(0)).cast("long"))
        for k, below, scale in (("symbols", "word_chars", 10_000), ("lines", "n_lines", 10_000), ("repeats", "n_lines", 20_000))}


def bucket(value: Column) -> Column:
    """Number of the sketch's bucket for a whole number from 0."""
    e = F.length(F.bin(value)) - 1
    wide = F.floor(value / F.pow(F.lit(2.0), e - 5)).cast("long")
    return F.when(value < 64, value).otherwise(64 + (e - 6) * 32 + wide - 32).cast("long")


def value_of(b: Column) -> Column:
    """The least value in a bucket."""
    e = F.floor((b - 64) / 32) + 6
    return F.when(b < 64, b).otherwise(((b - 64) % 32 + 32) * F.pow(F.lit(2.0), e - 5)).cast("long")


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n): counts in the buckets, over the rows that pass the base rules."""
    each = F.array(*[F.struct(F.lit(k).alias("ratio"), bucket(v).alias("bucket")) for k, v in (ratios() | units()).items()])
    long = rows.filter(~F.col("base_failed")).select("lang", "source", F.explode(each).alias("r"))
    return long.groupBy("lang", "source", F.col("r.ratio").alias("ratio"), F.col("r.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _fences(sketch: DataFrame, keys: list[str], name: str) -> DataFrame:
    merged = sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "ratio")
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.select(*keys, "ratio", "bucket", F.sum("n").over(upto).alias("upto"), F.sum("n").over(group).alias("all"))
    in_ = lambda p: F.min(F.when(100 * F.col("upto") >= p * F.col("all"), F.col("bucket")))
    tops = [(value_of(in_(p) + 1) - 1).alias(f"top{p}") for p in (90, 99)]  # values of one bucket are on one side of a fence
    q = ranked.groupBy(*keys, "ratio").agg(*[value_of(in_(p)).alias(f"p{p}") for p in (10, 50, 90)], *tops, F.max("all").alias("seen"))
    at = [(k, c) for k in [*RATIOS, *units()] for c in ("p10", "p50", "p90", "top90", "top99")]
    wide = q.groupBy(*keys).agg(F.max("seen").alias(f"{name}_seen"), *[F.max(F.when(F.col("ratio") == k, F.col(c))).alias(f"{k}.{c}") for k, c in at])
    of = lambda k, c: F.col(f"`{k}.{c}`")

    def high(k: str) -> Column:
        if k in TAILED:
            return F.when(of(k, "top99") > 0, 2 * of(k, "top99") - of(k, "p90")).otherwise(of(f"unit_{k}", "p50"))
        spread = of(k, "p90") - of(k, "p50")
        return of(k, "top90") + WIDE * (F.greatest(spread, of(f"unit_{k}", "p90")) if f"unit_{k}" in units() else spread)

    low = lambda k: of(k, "p10") - WIDE * (of(k, "p50") - of(k, "p10"))
    return wide.select(*keys, f"{name}_seen", *[low(k).alias(f"{name}_{k}_low") for k in RATIOS], *[high(k).alias(f"{name}_{k}_high") for k in RATIOS])


def fences(rows: DataFrame) -> DataFrame:
    """(lang, source, and low and high of each ratio): those of the source, or merged ones where it has few documents."""
    sketch = checkpointed(sketches(rows))
    by_source, by_lang, every = _fences(sketch, ["lang", "source"], "s"), _fences(sketch, ["lang"], "l"), _fences(sketch, [], "a")
    langs = by_lang.withColumnRenamed("lang", "lang__l")
    joined = by_source.join(langs, F.col("lang").eqNullSafe(F.col("lang__l"))).crossJoin(F.broadcast(every))  # every is one row
    pick = lambda k, c: F.when(F.col("s_seen") >= FEW, F.col(f"s_{k}_{c}")).when(F.col("l_seen") >= FEW,
        F.col(f"l_{k}_{c}")).otherwise(F.col(f"a_{k}_{c}"))
    return joined.select("lang", "source", *[pick(k, c).alias(f"{k}_{c}") for k in RATIOS for c in ("low", "high")])


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows (counted, with lang and source) and kept: they pass the base rules and every ratio lies within its fences."""
    limits = checkpointed(limits).withColumnsRenamed({"lang": "lang__f", "source": "source__f"})
    # a row for each language and source: where these are few, the documents stay where they are
    limits = small(limits, limits.count())
    on = F.col("lang").eqNullSafe(F.col("lang__f")) & F.col("source").eqNullSafe(F.col("source__f"))
    within = F.lit(True)
    for k, v in ratios().items():
        within = within & (v <= F.col(f"{k}_high"))
    within = within & (ratios()["length"] >= F.col("length_low"))
    joined = rows.join(limits, on, "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(True))).drop(*limits.columns)


def rules(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, kept) for every row of documents."""
    rows = checkpointed(counted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "text")))
    return judged(rows, fences(rows)).select("doc_id", *COUNTS, "base_failed", "kept")


def passed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The documents that are kept, with the given columns.

    Counts and documents are kept in the shared folder together, so they are counted once and the final filter, which
    would otherwise be pushed below the counts and repeat them, stays above. Texts are shuffled only where there are more
    languages and sources than common.SMALL.
    """
    rows, back = plainly_named(docs.select(*columns), ["text", "lang", "source"])
    marked = checkpointed(counted(rows.withColumn("q__text", F.col("text")), "q__text"))
    return back(judged(marked, fences(marked)).filter("kept"))
