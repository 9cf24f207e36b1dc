"""Calculus over report periods: trailing twelve months, growth, averages, formulas. All securities at once.

Every operator takes a fact table (security_code, family, dataset, field_key, report_date, value_num, ...) and is
partitioned by security and field, so one frequent field isn't one task's work. Null values take no part.
"""

from __future__ import annotations

import keyword
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.priority import CUMULATIVE, SINGLE_QUARTER, STATEMENTS, formula_priority, looked_up

KEY = ["security_code", "field_key"]


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an ascending order of columns; tasks send one row a key, whatever they have of it."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)]))
    return rows.groupBy(*keys).agg(best.alias("t__b")).select(*[F.col(c) if c in keys else F.col(f"t__b.{c}") for c in rows.columns])


def _newest(date: str) -> Column:
    """Ascends as a date descends, nulls last."""
    return F.coalesce(-F.unix_date(date), F.lit(1 << 30))


def latest_numeric(facts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The latest numeric fact of each security, family and field; ties by event date, record and dataset.

    keep: the columns that are wanted; tasks sort rows of these and of the order alone.
    """
    keep, key = keep or facts.columns, ["security_code", "family", "field_key"]
    order = {"t__r": _newest("report_date"), "t__e": _newest("event_date"), "t__k": F.col("record_key"), "t__d": F.col("dataset")}
    rows = facts.filter(F.col("value_num").isNotNull()).select(*dict.fromkeys([*key, *keep]), *[c.alias(n) for n, c in order.items()])
    best = F.min_by(F.struct(*[c for c in keep if c not in key]), F.struct(*order))
    return rows.groupBy(*key).agg(best.alias("t__b")).select(*[F.col(c) if c in key else F.col(f"t__b.{c}") for c in keep])


def one_per_period(facts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row for each security, field and report date: the family of the highest priority, then family, then dataset."""
    keep = keep or facts.columns
    rows = facts.filter(F.col("value_num").isNotNull() & F.col("report_date").isNotNull())
    used = dict.fromkeys([*keep, *KEY, "report_date", "family", "dataset", "available_at"])
    order = [formula_priority(), F.col("family"), F.col("dataset"), _newest("available_at")]
    return first_by(rows.select(*used), [*KEY, "report_date"], order).select(*keep)


def last_periods(facts: DataFrame, k: int) -> DataFrame:
    """The last k periods of each security and field, newest first in `period_rank`."""
    order = Window.partitionBy(*KEY).orderBy(F.col("report_date").desc())
    return one_per_period(facts).withColumn("period_rank", F.row_number().over(order)).filter(F.col("period_rank") <= k)


def _day(date: Column | str) -> Column:
    """A date as the number yyyymmdd; the same day a year before is 10,000 less."""
    return F.year(date) * 10_000 + F.month(date) * 100 + F.dayofmonth(date)


def _of(facts: DataFrame, families: list[str], order: list[Column]) -> DataFrame:
    rows = facts.filter(F.col("family").isin(*families) & F.col("value_num").isNotNull() & F.col("report_date").isNotNull())
    return first_by(rows.select(*KEY, "report_date", "value_num", "family", "dataset"), [*KEY, "report_date"], [*order, F.col("dataset")])


def _component(date: Column, value: Column, family: Column, role: str) -> Column:
    return F.struct(date.alias("report_date"), value.alias("value"), family.alias("family"), F.lit(role).alias("role"))


def ttm_quarters(facts: DataFrame, strict: bool = False) -> DataFrame:
    """The sum of the last four rows of the single-quarter families up to each; strict: only where they are four quarters
    without a gap. Column `components` has the four."""
    rows = _of(facts, SINGLE_QUARTER, [F.col("family")])
    four = Window.partitionBy(*KEY).orderBy("report_date").rowsBetween(-3, 0)
    quarter = F.year("report_date") * 4 + F.quarter("report_date")
    part = _component(F.col("report_date"), F.col("value_num"), F.col("family"), "add")
    wide = rows.withColumn("components", F.collect_list(part).over(four)).filter(F.size("components") == 4)
    first = F.element_at("components", 1)["report_date"]
    if strict:
        wide = wide.filter(quarter - (F.year(first) * 4 + F.quarter(first)) == 3)
    total = F.aggregate("components", F.lit(0.0), lambda x, y: x + y["value"])
    return wide.select(*KEY, "report_date", total.alias("ttm"), "components")


def ttm_cumulative(facts: DataFrame) -> DataFrame:
    """Last year's total less last year's value of the same day plus this one's, of the cumulative families; in December the value itself."""
    rows = _of(facts, CUMULATIVE, [formula_priority()])
    row = F.struct("report_date", "value_num", "family")
    # a window over the security's own rows instead of two joins
    days = Window.partitionBy(*KEY).orderBy(_day("report_date"))
    year_end = (F.month("report_date") == 12) & (F.dayofmonth("report_date") == 31)
    total = F.last(F.when(year_end, row), ignorenulls=True).over(days.rangeBetween(Window.unboundedPreceding, -1))
    wide = rows.withColumns({"t__y": total, "t__s": F.first(row).over(days.rangeBetween(-10_000, -10_000))})
    december = F.month("report_date") == 12
    whole = F.year("t__y.report_date") == F.year("report_date") - 1
    wide = wide.filter(december | whole & F.col("t__s").isNotNull())
    y, s = F.when(~december, F.col("t__y")), F.when(~december, F.col("t__s"))
    rolled = y["value_num"] - s["value_num"] + F.col("value_num")
    now = lambda role: _component(F.col("report_date"), F.col("value_num"), F.col("family"), role)
    parts = [_component(x["report_date"], x["value_num"], x["family"], role) for x, role in ((y, "add_previous_fy"), (s, "subtract_previous_same"))]
    return wide.select(
        *KEY, "report_date", F.when(december, F.col("value_num")).otherwise(rolled).alias("ttm"),
        F.when(december, F.array(now("current_fy"))).otherwise(F.array(*parts, now("add_current_cumulative"))).alias("components"),
    )


def ttm_components(quarter_facts: DataFrame, cumulative_facts: DataFrame, strict: bool = False) -> DataFrame:
    """Four quarters where there are, else the cumulative method: (key, report_date, ttm, method, formula, components).

    Each component has date, value, family and role; the formula's text has the dates and values that were used.
    """
    four = ttm_quarters(quarter_facts, strict).withColumn("t__k", F.lit(0))
    cum = ttm_cumulative(cumulative_facts).withColumn("t__k", F.lit(1))
    best = first_by(four.unionByName(cum), [*KEY, "report_date"], [F.col("t__k")])
    december = F.month("report_date") == 12
    method = F.when(F.col("t__k") == 0, "FOUR_INDEPENDENT_QUARTERS").when(december, "FULL_YEAR_EQUALS_TTM").otherwise("FY_MINUS_PRIOR_SAME_PLUS_CURRENT")
    term = lambda x: F.concat(F.when(x["role"] == "subtract_previous_same", "- ").otherwise("+ "), x["report_date"].cast("string"), F.lit(":"),
        F.regexp_replace(x["value"].cast("string"), r"\.0$", ""))
    text = F.substring(F.array_join(F.transform("components", term), " "), 3, 1000)
    full = (F.col("t__k") == 1) & december
    text = F.when(full, F.concat(F.col("report_date").cast("string"), F.lit("年报累计值"))).otherwise(text)
    return best.select(*KEY, "report_date", "ttm", method.alias("method"), text.alias("formula"), "components")


def ttm(quarter_facts: DataFrame, cumulative_facts: DataFrame, strict: bool = False) -> DataFrame:
    """(key, report_date, ttm, method, formula)."""
    return ttm_components(quarter_facts, cumulative_facts, strict).drop("components")


def value_as_of(facts: DataFrame, ends: DataFrame) -> DataFrame:
    """VALUE(field): the latest value up to each end (security_code, end); one union and a running last, no range join.

    Every end asks for the fields that its own security has.
    """
    rows = one_per_period(facts, [*KEY, "report_date", "value_num"])
    asked = ends.join(facts.select(*KEY).distinct(), "security_code")
    marks = asked.select("security_code", "field_key", F.col("end").alias("report_date"), F.lit(None).cast("double").alias("value_num"),
        F.lit(1).alias("asked"))
    both = rows.withColumn("asked", F.lit(0)).unionByName(marks)
    upto = Window.partitionBy(*KEY).orderBy("report_date", "asked").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("asked") == 0, F.struct("report_date", "value_num")), ignorenulls=True).over(upto)
    found = both.withColumn("t__v", last).filter("asked = 1 and t__v is not null")
    return found.select(*KEY, F.col("report_date").alias("end"), F.col("t__v.report_date").alias("value_date"), F.col("t__v.value_num").alias("value"))


def yoy(facts: DataFrame) -> DataFrame:
    """Growth of the latest value at each date against the latest value a year before; null without that or where it is 0."""
    rows = one_per_period(facts, [*KEY, "report_date", "value_num"])
    upto = Window.partitionBy(*KEY).orderBy(_day("report_date")).rangeBetween(Window.unboundedPreceding, -10_000)
    return rows.withColumn("prior", F.last("value_num").over(upto)).select(
        *KEY, "report_date", "value_num", "prior", (F.try_divide("value_num", "prior") - 1).alias("yoy")
    )


def qoq(facts: DataFrame) -> DataFrame:
    """Growth against the row before of the same family."""
    rows = facts.filter(F.col("value_num").isNotNull())
    before = Window.partitionBy(*KEY, "family").orderBy("report_date", "dataset")
    return rows.withColumn("prior", F.lag("value_num").over(before)).select(
        *KEY, "family", "report_date", "value_num", (F.try_divide("value_num", "prior") - 1).alias("qoq")
    )


def average(facts: DataFrame, n: int = 4) -> DataFrame:
    """Mean of the last n periods up to each, of fewer where there are fewer."""
    rows = one_per_period(facts, [*KEY, "report_date", "value_num"])
    last = Window.partitionBy(*KEY).orderBy("report_date").rowsBetween(-(n - 1), 0)
    return rows.select(*KEY, "report_date", F.avg("value_num").over(last).alias("average"), F.count("value_num").over(last).alias("periods"))


def cagr(facts: DataFrame, years: int = 3) -> DataFrame:
    """Compound growth over the last `years` intervals between year ends (fewer where there are fewer), both ends positive."""
    ends = one_per_period(facts, [*KEY, "report_date", "value_num"]).filter((F.month("report_date") == 12) & (F.dayofmonth("report_date") == 31))
    order = Window.partitionBy(*KEY).orderBy(F.col("report_date").desc())
    last = ends.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= years + 1)
    g = last.groupBy(*KEY).agg(
        F.max_by("value_num", "report_date").alias("last_value"), F.min_by("value_num", "report_date").alias("first_value"),
            (F.count(F.lit(1)) - 1).alias("intervals")
    )
    fine = (F.col("intervals") > 0) & (F.col("first_value") > 0) & (F.col("last_value") > 0)
    rate = F.pow(F.col("last_value") / F.col("first_value"), 1 / F.col("intervals")) - 1
    return g.select(*KEY, "intervals", "first_value", "last_value", F.when(fine, rate).alias("cagr"))


# Balances among the cash flow's fields, the statements whose values run through a year, and the ratios that
# are calculated from the fields of one security, date and scope, with their names.
BALANCES = ["BEGIN_CCE", "END_CCE", "BEGIN_CASH", "END_CASH", "BEGIN_CASH_EQUIVALENTS", "END_CASH_EQUIVALENTS"]
FLOWS = ["income_statement", "cash_flow"]
RATIOS = {
    "ZCFZL": "TOTAL_LIABILITIES / TOTAL_ASSETS * 100",
    "CURRENT_RATIO": "TOTAL_CURRENT_ASSETS / TOTAL_CURRENT_LIAB",
    "GUARD_SPEED_RATIO": "(TOTAL_CURRENT_ASSETS - INVENTORY - PREPAYMENT - OTHER_CURRENT_ASSET - CONTRACT_ASSET - FINANCE_RECE"
    " - CURRENT_ASSET_OTHER - NONCURRENT_ASSET_1YEAR) / TOTAL_CURRENT_LIAB",
    "XSMLL": "(OPERATE_INCOME - OPERATE_COST) / OPERATE_INCOME * 100",
    "XSJLL": "NETPROFIT / OPERATE_INCOME * 100",
}


def independent_quarters(official: DataFrame) -> DataFrame:
    """Q2, Q3 and Q4 of each security, statement, scope and field as differences of totals that run through the year.

    Keeps all columns; facts without a statement have that of their family, facts without a scope an empty one. Balances of cash are left out, a first quarter is its own total and
    gives no row, and neither does a quarter without the one before it. Of several rows of one date the greatest record counts.
    """
    keys = ["security_code", "statement_type", "scope", "field_key"]
    own = {"statement_type": lambda: looked_up("family", STATEMENTS, F.lit("")), "scope": lambda: F.lit("")}
    official = official.withColumns({c: make() for c, make in own.items() if c not in official.columns})
    flow = official.filter(F.col("statement_type").isin(*FLOWS) & ~F.coalesce("field_key", F.lit("")).isin(*BALANCES))
    ends = flow.filter(F.date_format("report_date", "MM-dd").isin("03-31", "06-30", "09-30", "12-31"))
    rows = _greatest(ends, [*keys, "report_date"]).filter(F.col("value_num").isNotNull() & ~F.isnan("value_num"))
    year = Window.partitionBy(*keys, F.year("report_date")).orderBy(F.quarter("report_date")).rangeBetween(-1, -1)
    wide = rows.withColumn("t__b", F.first(F.struct("report_date", "value_num")).over(year)).filter("t__b is not null")
    kind = F.concat(F.lit("Q"), F.quarter("report_date").cast("string"))
    value = F.col("value_num") - F.col("t__b.value_num")
    date = F.col("report_date").cast("string")
    made = {
        "value_num": value, "value_text": value.cast("string"), "period_type": kind, "source_status": F.lit("FACT_CALCULATED"), "confidence": F.lit("high"),
        "source_row": F.concat(date, F.lit("累计值 - "), F.col("t__b.report_date").cast("string"), F.lit("累计值")),
        "record_key": F.concat_ws("|", F.coalesce("security_code", F.lit("")), date, "statement_type", F.coalesce("field_key", F.lit("")), kind),
    }
    return wide.select(*[made[c].alias(c) if c in made else F.col(c) for c in dict.fromkeys([*official.columns, *made])])


def _greatest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key: of the greatest record, then value."""
    rest = [c for c in rows.columns if c not in keys]
    order = [F.col(c) for c in ("record_key", "value_num") if c in rest]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("t__b"))
    return best.select(*[F.col(c) if c in keys else F.col(f"t__b.{c}") for c in rows.columns])


def ratio_facts(official: DataFrame, formulas: dict[str, str] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Facts calculated from a table of formulas over the fields of one security, date and scope.

    A formula is text of field names, numbers, + - * / ** and brackets. Values of one period type go together where there is such a column. A row needs all of its
    fields; a zero divisor or a result that isn't finite gives none. Each row has its formula as source_row and a tolerance of its own.
    """
    formulas, names = RATIOS if formulas is None else formulas, names or {}
    asked = {k: sorted(set(NAME.findall(f))) for k, f in formulas.items()}
    fields = sorted({x for own in asked.values() for x in own})
    direct = official.filter(F.col("field_key").isin(*fields) & F.col("value_num").isNotNull() & ~F.isnan("value_num"))
    keys = ["security_code", "report_date", "scope", *(["period_type"] if "period_type" in official.columns else [])]
    one = _greatest(direct.select(*keys, "field_key", "value_num", *[c for c in ("record_key",) if c in official.columns]), [*keys, "field_key"])
    wide = one.groupBy(*keys).pivot("field_key", fields).agg(F.first("value_num"))
    each = []
    for key, text in formulas.items():
        unit = "%" if "* 100" in text else "倍"
        value = compiled(text, {x: Formula({}, lambda x=x: F.col(f"`{x}`")) for x in asked[key]}).column()
        each.append(F.struct(F.lit(key).alias("field_key"), F.lit(names.get(key, key)).alias("field_name_cn"), value.cast("double").alias("value_num"),
            F.lit(unit).alias("unit"), F.lit(unit).alias("normalized_unit"), F.lit(text).alias("source_row")))
    found = wide.select(*keys, F.explode(F.array(*each)).alias("r")).select(*keys, "r.*")
    found = found.filter(F.col("value_num").isNotNull() & ~F.isnan("value_num") & (F.abs("value_num") < math.inf))
    date = F.col("report_date").cast("string")
    return found.select(
        *keys, F.lit("官方披露/派生指标").alias("theme"), F.lit("OFFICIAL_DERIVED").alias("family"), F.lit("官方披露派生指标").alias("dataset"),
        F.concat_ws("|", "security_code", date, F.lit("derived"), "field_key").alias("record_key"), F.lit("financial_ratio").alias("statement_type"),
        "field_key", "field_name_cn", "value_num", F.col("value_num").cast("string").alias("value_text"), "unit", "normalized_unit",
        F.lit("FACT_CALCULATED").alias("source_status"), F.lit("由官方披露基础字段计算").alias("source_document"), "source_row",
        F.greatest(F.lit(1e-9), F.abs("value_num") * 1e-8).alias("precision_tolerance"), F.lit("high").alias("confidence"),
    )


def ttm_check(quarter_facts: DataFrame, cumulative_facts: DataFrame) -> DataFrame:
    """Whether both methods agree, within 1 or a share of 1e-10."""
    a = ttm_quarters(quarter_facts).select(*KEY, "report_date", F.col("ttm").alias("independent"))
    b = ttm_cumulative(cumulative_facts).select(*KEY, "report_date", F.col("ttm").alias("cumulative"))
    both = a.join(b, [*KEY, "report_date"], "full_outer")
    allowed = F.greatest(F.lit(1.0), F.greatest(F.abs("independent"), F.abs("cumulative")) * 1e-10)
    missing = F.col("independent").isNull() | F.col("cumulative").isNull()
    status = F.when(missing, "UNRESOLVED").when(F.abs(F.col("independent") - F.col("cumulative")) <= allowed, "PASS").otherwise("FAIL")
    return both.select(*KEY, "report_date", "independent", "cumulative", status.alias("status"))


def resolved_fields(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """The field that each asked name means: a key in any case before a localised name."""
    known = facts.select("field_key", "field_name_cn").distinct()
    names = known.select(F.lower("field_key").alias("name"), "field_key", F.lit(0).alias("rank")).unionByName(
        known.select(F.lower("field_name_cn").alias("name"), "field_key", F.lit(1).alias("rank"))
    )
    best = names.groupBy("name").agg(F.min_by("field_key", F.struct("rank", "field_key")).alias("field_key"))
    return asked.withColumn("name", F.lower("asked")).join(best, "name", "left").select("asked", "field_key")


class Formula:
    """An expression of fields: operators build it up, evaluate() turns all its leaves into one frame and one expression."""

    def __init__(self, leaves: dict[str, tuple[str, str, str | int | None]], column):
        self.leaves, self.column = leaves, column

    def _with(self, other, f) -> Formula:
        other = other if isinstance(other, Formula) else Formula({}, lambda x=float(other): F.lit(x))
        return Formula(self.leaves | other.leaves, lambda: f(self.column(), other.column()))

    def __add__(self, other):
        return self._with(other, lambda a, b: a + b)

    def __sub__(self, other):
        return self._with(other, lambda a, b: a - b)

    def __mul__(self, other):
        return self._with(other, lambda a, b: a * b)

    def __truediv__(self, other):
        return self._with(other, F.try_divide)

    def __pow__(self, other):
        return self._with(other, F.pow)

    def __neg__(self):
        return Formula(self.leaves, lambda: -self.column())

    def __pos__(self):
        return self

    def __radd__(self, other):
        return self + other

    def __rmul__(self, other):
        return self * other

    def __rsub__(self, other):
        return -self + other

    def __rtruediv__(self, other):
        return self._with(other, lambda a, b: F.try_divide(b, a))

    def __rpow__(self, other):
        return self._with(other, lambda a, b: F.pow(b, a))


def _leaf(kind: str, field: str, argument: str | int | None = None) -> Formula:
    name = f"{kind}_{field}".lower() + (f"_{argument}" if argument is not None else "")
    return Formula({name: (kind, field, argument)}, lambda: F.col(f"`{name}`"))


def VALUE(field: str, period: str | None = None) -> Formula:  # noqa: N802
    """The latest value up to the end, or up to a period (yyyy-mm-dd)."""
    return _leaf("VALUE", field, period)


def TTM(field: str) -> Formula:  # noqa: N802
    """Twelve months up to exactly the end."""
    return _leaf("TTM", field)


def YOY(field: str) -> Formula:  # noqa: N802
    """The latest value up to the end against the latest one up to a year before."""
    return _leaf("YOY", field)


def QOQ(field: str) -> Formula:  # noqa: N802
    """The latest value up to the end against the one before of the same family."""
    return _leaf("QOQ", field)


def AVG(field: str, periods: int = 4) -> Formula:  # noqa: N802
    """The mean of the last periods up to the end, of fewer where there are fewer."""
    return _leaf("AVG", field, int(periods))


def CAGR(field: str, years: int = 3) -> Formula:  # noqa: N802
    """Compound growth over the year ends up to the end, over so many intervals or fewer."""
    return _leaf("CAGR", field, int(years))


FUNCTIONS = {"F": VALUE, "VALUE": VALUE, "TTM": TTM, "YOY": YOY, "QOQ": QOQ, "AVG": AVG, "CAGR": CAGR}
NAME = re.compile(r"[A-Za-z_\u4e00-\u9fff][A-Za-z0-9_\u4e00-\u9fff]*")
WORD = re.compile(rf"\s+|\d+(?:\.\d+)?|\*\*|[-+*/(),]|\"[^\"\\]*\"|'[^'\\]*'|{NAME.pattern}")


def compiled(text: str, fields: dict[str, Formula] | None = None) -> Formula:
    """A formula written as text, such as `F("INCOME") / TTM("COST") * 100`; a bare name is the value of a field.

    Nothing but numbers, operators, names, quoted names and the functions above is let through; with fields, nothing but
    those names.
    """
    words, at = [], 0
    while at < len(text):
        m = WORD.match(text, at)
        if not m:
            raise ValueError(f"not allowed in a formula: {text[at:]!r}")
        words.append(m[0])
        at = m.end()
    words = [w for w in words if w.strip()]
    known: dict[str, object] = {}
    for k, w in enumerate(words):
        if not NAME.fullmatch(w):
            continue
        if keyword.iskeyword(w):
            raise ValueError(f"not allowed in a formula: {w}")
        called = words[k + 1 : k + 2] == ["("]
        if fields is not None:
            if called or w not in fields:
                raise ValueError(f"unknown in a formula: {w}")
            known[w] = fields[w]
        elif called:
            if w.upper() not in FUNCTIONS:
                raise ValueError(f"no such function: {w}")
            words[k] = w.upper()
        elif words[k - 1 : k] == ["("] and words[k - 2 : k - 1] and words[k - 2] in FUNCTIONS:
            words[k] = repr(w)  # a function's field may go without quotes
        else:
            known[w] = VALUE(w)
    made = eval(" ".join(words), {"__builtins__": {}, **(FUNCTIONS if fields is None else {})}, known)  # noqa: S307  checked above
    return made if isinstance(made, Formula) else Formula({}, lambda: F.lit(float(made)))


ROW = "struct<report_date:date,value:double,family:string,field_key:string,field_name_cn:string,unit:string,prior_date:date,prior:double,used:int>"


def _lanes(facts: DataFrame, fields: list[str]) -> DataFrame:
    """facts under each asked field: `lane` key where the key is the name in any case, name where the localised name is."""
    hits = F.array(*[
        F.when(F.lower("field_key") == f.lower(), F.struct(F.lit(f).alias("asked"), F.lit("key").alias("lane")))
        .when(F.col("field_name_cn") == f, F.struct(F.lit(f).alias("asked"), F.lit("name").alias("lane"))) for f in fields
    ])
    rows = facts.filter(F.col("value_num").isNotNull() & F.col("report_date").isNotNull())
    rows = rows.select("security_code", "field_key", "field_name_cn", "family", "dataset", "report_date", "value_num", F.coalesce("unit", F.lit("")).alias("unit"),
        F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("h"))
    return rows.select("*", "h.asked", "h.lane").drop("h")


def _row(value: Column | None = None, prior_date: Column | None = None, prior: Column | None = None, used: Column | None = None) -> Column:
    none = lambda kind: F.lit(None).cast(kind)
    parts = [F.col("report_date"), F.col("value_num") if value is None else value, F.col("family"), F.col("field_key"), F.col("field_name_cn"), F.col("unit"),
        none("date") if prior_date is None else prior_date, none("double") if prior is None else prior, none("int") if used is None else used]
    return F.struct(*parts).cast(ROW)


def _hits(facts: DataFrame, fields: set[str]) -> DataFrame:
    return facts.filter(F.lower("field_key").isin(*[f.lower() for f in fields]) | F.col("field_name_cn").isin(*fields))


def _at_dates(leaves: dict[str, tuple], facts: DataFrame) -> DataFrame:
    """(security_code, report_date, a row or null for each part of each leaf): what the fields have at each of their dates.

    The families of a field and date are brought down to one row first; all the rest is of rows as few as that.
    """
    of = lambda *kinds: {f for k, f, _ in leaves.values() if k in kinds}
    best = [formula_priority(), F.col("family"), F.col("dataset")]
    used = ["security_code", "field_key", "field_name_cn", "family", "dataset", "report_date", "value_num", "unit"]
    rows = facts.filter(F.col("value_num").isNotNull() & F.col("report_date").isNotNull()).select(*used)
    own = ["security_code", "asked", "report_date"]
    by_lane = lambda value, order: [F.min_by(value, F.when(F.col("lane") == x, order)).alias(x) for x in ("key", "name")]

    order = F.struct(*[c.alias(f"o{k}") for k, c in enumerate([*best, F.col("field_key")])])
    lanes = _lanes(first_by(rows, ["security_code", "field_key", "field_name_cn", "report_date"], best), sorted(of(*FUNCTIONS)))
    picked = lanes.groupBy(*own).agg(F.min_by(_row(), order).alias("both"), *by_lane(_row(), order))
    year_end = (F.month("report_date") == 12) & (F.dayofmonth("report_date") == 31)
    means = []
    for leaf, (kind, field, n) in leaves.items():
        if kind not in ("AVG", "CAGR"):
            continue
        c = F.col("both.value")
        only = F.col("asked") == field if kind == "AVG" else (F.col("asked") == field) & year_end
        last = Window.partitionBy("security_code", "asked", *([year_end] if kind == "CAGR" else [])).orderBy("report_date").rowsBetween(-(n - 1) if kind == "AVG" else -n, 0)
        first, count = F.first(c).over(last), F.count(F.lit(1)).over(last).cast("int")
        fine = (count > 1) & (first > 0) & (c > 0)
        value = F.avg(c).over(last) if kind == "AVG" else F.when(fine, F.pow(c / first, 1 / (count - 1)) - 1)
        whole = F.struct(F.col("report_date"), value, *[F.col(f"both.{x}") for x in ("family", "field_key", "field_name_cn", "unit")], F.first("report_date").over(last), first, count)
        means.append(F.when(only, whole.cast(ROW)).alias(f"{leaf}|now"))
    cells = [*means]
    for leaf, (kind, field, _) in leaves.items():
        if kind in ("VALUE", "YOY"):
            cells += [F.when(F.col("asked") == field, F.col(x)).alias(f"{leaf}|{x}") for x in ("key", "name")]
    parts = [picked.select("security_code", "report_date", *cells)]
    if fields := of("QOQ"):
        # the row before of the same family counts, so families stay apart until that is known
        series = ["security_code", "asked", "lane", "field_key", "family"]
        one = first_by(_lanes(_hits(rows, fields), sorted(fields)), [*series, "report_date"], [F.col("dataset")])
        before = Window.partitionBy(*series).orderBy("report_date")
        one = one.withColumns({"pd": F.lag("report_date").over(before), "pv": F.lag("value_num").over(before)})
        found = one.groupBy(*own).agg(*by_lane(_row(prior_date=F.col("pd"), prior=F.col("pv")), order))
        parts.append(found.select("security_code", "report_date", *[F.when(F.col("asked") == f, F.col(x)).alias(f"{leaf}|{x}")
            for leaf, (kind, f, _) in leaves.items() if kind == "QOQ" for x in ("key", "name")]))
    if fields := of("TTM"):
        # the key or else the name decides which field is meant, whatever its family and date
        mine = _hits(facts, fields)
        hit = _lanes(mine, sorted(fields))
        names = hit.groupBy("security_code", "asked", "lane", "field_key").agg(F.min("field_name_cn").alias("field_name_cn"), F.min("unit").alias("unit"))
        meant = first_by(names, ["security_code", "asked"], [F.col("lane"), F.col("field_key")]).drop("lane")
        found = ttm_components(mine, mine).join(meant, ["security_code", "field_key"]).withColumn("family", F.col("method"))
        now = _row(F.col("ttm"), used=F.size("components"))
        parts.append(found.select("security_code", "report_date", *[F.when(F.col("asked") == f, now).alias(f"{leaf}|now") for leaf, (kind, f, _) in leaves.items() if kind == "TTM"]))
    long = parts[0]
    for x in parts[1:]:
        long = long.unionByName(x, allowMissingColumns=True)
    names = [c for c in long.columns if c not in ("security_code", "report_date")]
    return long.groupBy("security_code", "report_date").agg(*[F.first(f"`{c}`", ignorenulls=True).alias(c) for c in names])


def evaluate(formula: Formula | str, facts: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(security_code, report_date, leaves, value, reason, trace) of a formula as of every end (security_code, report_date).

    Without ends, every period of a security for which its fields have a fact is one. What each leaf can be stands beside each
    date of the security's facts; running lasts over these rows, and over those of ends that are given, find all leaves at all
    ends, shifted or not; no range join. The reason tells why a value is
    missing: MISSING_INPUT, DIVISION_BY_ZERO or NOT_FINITE. The trace has, for each leaf in order, its function, field, date,
    value, family (of TTM the method), the earlier date and value that it was set against, and how many periods it took.
    """
    formula = compiled(formula) if isinstance(formula, str) else formula
    fields = {f for _, f, _ in formula.leaves.values()}
    own = _hits(facts, fields)
    if ends is not None:
        ends = ends.select("security_code", F.col("report_date").cast("date").alias("report_date")).distinct()
    if not formula.leaves:
        if ends is None:
            ends = own.filter("value_num is not null and report_date is not null").select("security_code", F.col("report_date").cast("date").alias("report_date")).distinct()
        return ends.select("*", formula.column().alias("value"), F.lit(None).cast("string").alias("reason"), F.array().cast(TRACE).alias("trace"))
    rows = _at_dates(formula.leaves, own).withColumn("t__end", F.lit(ends is None))
    if ends is not None:
        rows = rows.unionByName(ends.withColumn("t__end", F.lit(True)), allowMissingColumns=True)
    days = Window.partitionBy("security_code").orderBy(_day("report_date"))
    upto, before = days.rangeBetween(Window.unboundedPreceding, 0), days.rangeBetween(Window.unboundedPreceding, -10_000)
    every = Window.partitionBy("security_code").orderBy(_day("report_date")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    valid = F.col("security_code").isNotNull() & F.col("report_date").isNotNull()
    found = {}
    for leaf, (kind, _, argument) in formula.leaves.items():
        if kind == "TTM":
            found[f"{leaf}|now"] = F.first(F.col(f"`{leaf}|now`"), ignorenulls=True).over(days.rangeBetween(0, 0))
        for x in ("now",) if kind in ("AVG", "CAGR") else ("key", "name") if kind != "TTM" else ():
            c = F.col(f"`{leaf}|{x}`")
            if kind == "VALUE" and argument is not None:
                found[f"{leaf}|{x}"] = F.last(F.when(F.col("report_date") <= F.lit(argument).cast("date"), c), ignorenulls=True).over(every)
            else:
                found[f"{leaf}|{x}"] = F.last(c, ignorenulls=True).over(upto)
            if kind == "YOY":
                found[f"{leaf}|{x}_before"] = F.last(c, ignorenulls=True).over(before)
    wide = rows.select("security_code", "report_date", "t__end", *[F.when(valid, v).alias(k) for k, v in found.items()]).filter("t__end")
    values, traces = {}, []
    for leaf, (kind, field, _) in formula.leaves.items():
        c = lambda p, leaf=leaf: F.col(f"`{leaf}|{p}`")
        before = (None, None)
        if kind in ("AVG", "CAGR"):
            row, value, before = c("now"), c("now")["value"], (c("now")["prior_date"], c("now")["prior"])
        elif kind == "TTM":
            row = c("now")
            value = row["value"]
        else:
            row = F.coalesce(c("key"), c("name"))
            value = row["value"]
            if kind == "YOY":
                past = F.coalesce(c("key_before"), c("name_before"))
                value, before = F.try_divide(value, past["value"]) - 1, (past["report_date"], past["value"])
            elif kind == "QOQ":
                value, before = F.try_divide(value, row["prior"]) - 1, (row["prior_date"], row["prior"])
        values[leaf] = value
        traces.append(F.struct(F.lit(kind).alias("function"), F.coalesce(row["field_key"], F.lit(field)).alias("field_key"), row["field_name_cn"].alias("field_name_cn"),
            row["report_date"].alias("report_date"), value.alias("value"), row["unit"].alias("unit"), row["family"].alias("family"),
            (F.lit(None).cast("date") if before[0] is None else before[0]).alias("prior_date"),
            (F.lit(None).cast("double") if before[1] is None else before[1]).alias("prior"), row["used"].alias("periods")))
    out = wide.select("security_code", "report_date", *[v.alias(k) for k, v in values.items()], F.array(*traces).cast(TRACE).alias("trace"))
    missing = F.lit(False)
    for n in formula.leaves:
        missing = missing | F.col(f"`{n}`").isNull()
    finite = ~F.isnan("value") & (F.abs("value") < math.inf)
    reason = F.when(missing, "MISSING_INPUT").when(F.col("value").isNull(), "DIVISION_BY_ZERO").when(~finite, "NOT_FINITE")
    out = out.withColumn("value", formula.column()).withColumn("reason", reason)
    return out.withColumn("value", F.when(F.col("reason").isNull(), F.col("value"))).select("security_code", "report_date", *[f"`{n}`" for n in formula.leaves], "value", "reason", "trace")


TRACE = (
    "array<struct<function:string,field_key:string,field_name_cn:string,report_date:date,value:double,unit:string,family:string,"
    "prior_date:date,prior:double,periods:int>>"
)
