"""Structured and fuzzy search over facts: filters, chained steps, scores, facets, pages.

A request becomes Column expressions over one scan. Steps combine booleans of a row, so no step joins or rereads.
Wildcards in a value are ordinary characters. An empty list of values matches nothing for `in` and excludes nothing
for `not_in`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators.timeseries import latest_numeric

TEXTS = ["field_name_cn", "field_key", "theme", "family", "dataset", "value_text", "unit", "source_url"]
NUMBERS = ["value_num", "score", "base_score", "secondary_score"]
SCORES = ["score", "base_score", "secondary_score"]
COLUMNS = {"security_code", "report_date", "event_date", "value_num", "effective_date", *TEXTS, *SCORES}


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    value: object = None
    values: tuple = ()
    lower: object = None
    upper: object = None


@dataclass(frozen=True)
class Step:
    mode: str  # include, exclude, or
    match: str  # exact, prefix, contains, regex, fuzzy, empty, not_empty
    query: str = ""
    columns: tuple = ("field_name_cn",)
    threshold: float = 60


@dataclass(frozen=True)
class Request:
    filters: tuple[Filter, ...] = ()
    base: Step | None = None
    steps: tuple[Step, ...] = ()
    sort: tuple[tuple[str, str], ...] = ()
    page: int = 1
    page_size: int = 100
    tiebreak: tuple[str, ...] = field(default=("security_code", "field_key", "report_date"))


def column(name: str) -> Column:
    if name not in COLUMNS:
        raise ValueError(f"unknown column: {name}")
    return F.coalesce("report_date", "event_date") if name == "effective_date" else F.col(name)


def condition(f: Filter) -> Column:
    """One column filter as a predicate; dates and numbers compare as they are, so Parquet can skip by them."""
    c = column(f.column)
    text = F.coalesce(c.cast("string"), F.lit(""))
    number = f.column in NUMBERS
    op, v = f.operator, f.value
    if op in ("in", "not_in"):
        if not f.values:
            return F.lit(op == "not_in")
        hit = (c if number else text).isin(*f.values)
        return hit if op == "in" else ~hit
    if number and op in ("exact", "not_equal"):
        return c == v if op == "exact" else c != v
    lowered, query = F.lower(text), F.lit(str(v).lower())
    simple = {
        "contains": lambda: F.contains(lowered, query),
        "not_contains": lambda: ~F.contains(lowered, query),
        "prefix": lambda: F.startswith(lowered, query),
        "exact": lambda: lowered == query,
        "not_equal": lambda: lowered != query,
        "gte": lambda: c >= F.lit(v),
        "lte": lambda: c <= F.lit(v),
        "between": lambda: c.between(F.lit(f.lower), F.lit(f.upper)),
        "is_empty": lambda: c.isNull() | (c.cast("string") == ""),
        "not_empty": lambda: c.isNotNull() & (c.cast("string") != ""),
    }
    if op not in simple:
        raise ValueError(f"unknown operator: {op}")
    return simple[op]()


def where(filters: tuple[Filter, ...], but: str | None = None) -> Column:
    """All filters on stored columns, but those on one column."""
    out = F.lit(True)
    for f in filters:
        if f.column not in SCORES and f.column != but:
            out = out & F.coalesce(condition(f), F.lit(False))
    return out


def score_condition(f: Filter) -> Column:
    """A filter on a score: gte, lte, between, exact and not_equal count, is_empty never matches, others are ignored."""
    if f.operator == "is_empty":
        return F.lit(False)
    return condition(f) if f.operator in ("gte", "lte", "between", "exact", "not_equal") else F.lit(True)


def bigrams(text: Column) -> Column:
    """Different pairs of neighbouring characters; a shorter text is its own."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.array_distinct(pairs)


def similarity(value: Column, query: str) -> Column:
    """100 if equal, 96 if contained, else twice the common bigrams over all, in hundredths; any case. 0 for empty texts."""
    v, q = F.lower(F.coalesce(value, F.lit(""))), F.lit(query.lower())
    left, right = bigrams(q), bigrams(v)
    dice = F.round(200 * F.size(F.array_intersect(left, right)) / (F.size(left) + F.size(right)))
    return F.when((v == "") | (q == ""), 0.0).when(v == q, 100.0).when(F.contains(v, q), 96.0).otherwise(dice)


def matched(step: Step) -> tuple[Column, Column]:
    """Whether a row matches a step in any of its columns, and with which score."""
    texts = [F.coalesce(column(c).cast("string"), F.lit("")) for c in step.columns]
    if step.match == "fuzzy":
        best = F.greatest(*[similarity(t, step.query) for t in texts], F.lit(0.0))
        return best >= step.threshold, best
    if step.match == "regex":
        if len(step.query) > 100 or re.search(r"\([^)]*[+*][^)]*\)[+*{]", step.query):
            raise ValueError("the pattern is too long or repeats a repeated group")
        re.compile(step.query)
    query = F.lit(step.query.lower())
    tests = {
        "exact": lambda t: F.lower(t) == query,
        "prefix": lambda t: F.startswith(F.lower(t), query),
        "contains": lambda t: F.contains(F.lower(t), query),
        "regex": lambda t: t.rlike(f"(?i){step.query}"),
        "empty": lambda t: t == "",
        "not_empty": lambda t: t != "",
    }
    hit = F.lit(False)
    for t in texts:
        hit = hit | tests[step.match](t)
    return hit, F.when(hit, 100.0).otherwise(0.0)


def searched(rows: DataFrame, request: Request) -> DataFrame:
    """rows that pass the filters, with a flag for each stage, and the scores.

    An `or` step takes rows from what passed the filters, not only from what is left. base_score is that of the first
    search, secondary_score the mean of the steps' that aren't exclusions, score the mean of all, to four places.
    """
    out = rows.filter(where(request.filters))
    alive, scores = F.lit(True), []
    stages = []
    if request.base:
        hit, s = matched(request.base)
        out = out.withColumn("base_score", F.when(hit, s))
        alive = hit
        scores.append(F.col("base_score"))
    else:
        out = out.withColumn("base_score", F.lit(None).cast("double"))
    stages.append(alive)
    steps = []
    for k, step in enumerate(request.steps):
        hit, s = matched(step)
        alive = {"include": alive & hit, "exclude": alive & ~hit, "or": alive | hit}[step.mode]
        stages.append(alive)
        if step.mode != "exclude":
            steps.append(F.when(hit, s))
    out = out.withColumns({f"stage_{k}": s for k, s in enumerate(stages)})
    present = lambda columns: F.filter(F.array(*columns), lambda x: x.isNotNull())
    mean = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.nullif(F.size(a), F.lit(0)), 4)
    none = F.lit(None).cast("double")
    out = out.withColumns({"secondary_score": mean(present(steps)) if steps else none, "score": mean(present([*scores, *steps])) if scores or steps else none})
    for f in request.filters:
        if f.column in SCORES:
            out = out.filter(score_condition(f))
    return out


def results(rows: DataFrame, request: Request) -> DataFrame:
    return searched(rows, request).filter(F.col(f"stage_{len(request.steps)}"))


def stage_counts(rows: DataFrame, request: Request) -> DataFrame:
    """Rows after each stage, in one pass: all, filters, first search, each step."""
    marked = rows.withColumn("s__f", where(request.filters))
    columns = [F.count(F.lit(1)).alias("raw"), F.count_if("s__f").alias("filtered")]
    alive = F.col("s__f")
    if request.base:
        alive = alive & matched(request.base)[0]
    columns.append(F.count_if(alive).alias("base"))
    for k, step in enumerate(request.steps):
        hit = matched(step)[0]
        alive = {"include": alive & hit, "exclude": alive & ~hit, "or": alive | (F.col("s__f") & hit)}[step.mode]
        columns.append(F.count_if(alive).alias(f"step_{k + 1}"))
    return marked.agg(*columns)


def sorted_page(found: DataFrame, request: Request) -> DataFrame:
    """One page: by the given keys, nulls last either way, else by score and effective date, newest first; ties by the key."""
    keys = request.sort or ((("score", "desc"),) if request.base or request.steps else ()) + (("effective_date", "desc"),)
    order = [column(c).desc_nulls_last() if way == "desc" else column(c).asc_nulls_last() for c, way in keys]
    ordered = found.orderBy(*order, *[F.col(c).asc_nulls_last() for c in request.tiebreak])
    return ordered.offset((request.page - 1) * request.page_size).limit(request.page_size)


def page_numbers(found: DataFrame, page_size: int) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("total")).withColumn("page_count", F.ceil(F.col("total") / page_size))


def facet(rows: DataFrame, request: Request, name: str, limit: int = 50) -> DataFrame:
    """Values of a column and their counts on rows that pass the filters on all other columns; null counts as ''.

    At most `limit` values, the most frequent first; truncated tells whether there are more.
    """
    own = rows.filter(where(request.filters, but=name)).groupBy(F.coalesce(column(name).cast("string"), F.lit("")).alias("value"))
    top = own.agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(limit + 1)
    # limit + 1 rows
    n = F.count(F.lit(1)).over(Window_all())
    place = F.row_number().over(Window_all().orderBy(F.desc("count"), "value"))
    return top.withColumns({"s__p": place, "truncated": n > limit}).filter(F.col("s__p") <= limit).drop("s__p")


def Window_all():  # noqa: N802
    return Window.partitionBy(F.lit(0))


def numeric_facet(rows: DataFrame, request: Request, name: str) -> DataFrame:
    c = column(name)
    return rows.filter(where(request.filters, but=name)).agg(
        F.min(c).alias("minimum"), F.max(c).alias("maximum"), F.count_if(c.isNull()).alias("null_count"), F.count(F.lit(1)).alias("total")
    )


def shortcut(start=None, end=None, theme=None, family=None, low=None, high=None) -> tuple[Filter, ...]:
    """The filters that a simple search stands for."""
    out = []
    if start is not None or end is not None:
        out += [Filter("effective_date", "gte", start)] * (start is not None) + [Filter("effective_date", "lte", end)] * (end is not None)
    out += [Filter(c, "in", values=(v,)) for c, v in (("theme", theme), ("family", family)) if v is not None]
    out += [Filter("value_num", op, v) for op, v in (("gte", low), ("lte", high)) if v is not None]
    return tuple(out)


def any_column_contains(rows: DataFrame, query: str) -> DataFrame:
    """Rows of which some column, as text, contains the query in any case."""
    texts = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns])
    return rows.filter(F.exists(texts, lambda t: F.contains(F.lower(t), F.lit(query.lower()))))


def field_catalogue(facts: DataFrame) -> DataFrame:
    return facts.groupBy("field_key", "field_name_cn", "unit").agg(
        F.count(F.lit(1)).alias("n"), F.min("report_date").alias("first_date"), F.max("report_date").alias("last_date")
    )


def periods(facts: DataFrame) -> DataFrame:
    return facts.select("report_date").filter("report_date is not null").distinct()


# The fields that an overview shows.
HEADLINES = ["TOTAL_OPERATE_INCOME", "PARENT_NETPROFIT", "TOTAL_ASSETS", "TOTAL_LIABILITIES", "MONETARYFUNDS", "ACCOUNTS_RECE", "INVENTORY", "NETCASH_OPERATE",
    "ROEJQ", "ZCFZL"]


def headlines(facts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The latest value of each headline field of a security and family; keep: the columns that are wanted."""
    shown = ["security_code", "field_key", "field_name_cn", "value_num", "value_text", "unit", "report_date", "family"]
    return latest_numeric(facts.filter(F.col("field_key").isin(*HEADLINES)), keep or shown)


def overview(facts: DataFrame) -> DataFrame:
    return facts.groupBy("security_code").agg(
        F.count(F.lit(1)).alias("facts"), F.countDistinct("field_key").alias("fields"), F.countDistinct("family").alias("families"),
        F.min("report_date").alias("first_date"), F.max("report_date").alias("last_date"),
    )
