"""What was knowable when: document versions at a cutoff, and annual and quarterly tables from facts at a cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.priority import UNIT_SCALES, canonical_unit, looked_up

# Which version of a document is preferred.
VERSION_RANKS = {"corrected": 3, "original": 2, "withdrawn": 0}
# Words in titles of corrected and of withdrawn reports, and of those that aren't periodic reports.
CORRECTED = ["更正版", "更正后", "修订版", "修订稿", "更新后"]
WITHDRAWN = ["取消", "作废", "撤回"]
NOT_PERIODIC = ["摘要", "英文版", "H股公告"]
# Target fields with their source keys in order of preference, kind, and whether quarters have them.
FIELDS = {
    "revenue": (["OPERATE_INCOME", "TOTAL_OPERATE_INCOME"], "flow", True),
    "operating_cost": (["OPERATE_COST", "TOTAL_OPERATE_COST"], "flow", True),
    "gross_profit": (["GROSS_PROFIT"], "flow", True),
    "deducted_net_profit": (["DEDUCT_PARENT_NETPROFIT", "KCFJCXSYJLR", "DEDU_PARENT_PROFIT"], "flow", True),
    "operating_cash_flow": (["NETCASH_OPERATE"], "flow", True),
    "accounts_receivable": (["ACCOUNTS_RECE", "ACCOUNTS_RECEIVABLE"], "point", True),
    "inventory": (["INVENTORY"], "point", True),
    "contract_liabilities": (["CONTRACT_LIAB", "CONTRACT_LIABILITY", "CONTRACT_LIABILITIES"], "point", True),
    "capex": (["CONSTRUCT_LONG_ASSET"], "flow", True),
    "interest_bearing_debt": (["INTEREST_BEARING_DEBT"], "point", True),
    "total_equity": (["TOTAL_EQUITY", "TOTAL_EQUITY_PARENT"], "point", True),
    "total_assets": (["TOTAL_ASSETS"], "point", True),
    "cash": (["MONETARYFUNDS", "CASH_AND_DEPOSIT_CENTRAL_BANK"], "point", True),
    "audit_opinion": (["AUDIT_OPINION", "OPINION_TYPE", "AUDIT_RESULT"], "text", False),
    "internal_control_opinion": (["INTERNAL_CONTROL_OPINION", "INTERNAL_CONTROL_AUDIT_OPINION"], "text", False),
}
# Parts of debt, and the fields that financial companies don't have.
DEBT = ["SHORT_LOAN", "LONG_LOAN", "NONCURRENT_LIAB_1YEAR", "BOND_PAYABLE", "LEASE_LIAB"]
INDUSTRIAL_ONLY = ["gross_profit", "accounts_receivable", "inventory", "contract_liabilities", "capex", "interest_bearing_debt"]


def report_identity(title: Column) -> Column:
    """(report_date, kind) of a periodic report's title; null for summaries, other languages and other notices."""
    t = F.regexp_replace(title, r"\s+", "")
    tail = r"(?:全文)?(?:[（(][^）)]*(?:更正|修订|更新)[^）)]*[）)])?$"
    out = None
    for name, day, kind in (("年度报告", "12-31", "annual"), ("(?:第?一|1)季度报告", "03-31", "q1"), ("半年度报告", "06-30", "half"), ("(?:第?三|3)季度报告", "09-30", "q3")):
        year = F.regexp_extract(t, rf"(20\d{{2}})年{name}{tail}", 1)
        value = F.struct(F.concat(year, F.lit(f"-{day}")).alias("report_date"), F.lit(kind).alias("kind"))
        out = F.when(year != "", value) if out is None else out.when(year != "", value)
    return F.when(~t.rlike("|".join(NOT_PERIODIC)), out)


def version_label(title: Column) -> Column:
    t = F.regexp_replace(title, r"\s+", "")
    return F.when(t.rlike("|".join(CORRECTED)), "corrected").when(t.rlike("|".join(WITHDRAWN)), "withdrawn").otherwise("original")


def versions_as_of(documents: DataFrame, cutoff: Column) -> DataFrame:
    """Every document (security_code, report_date, document_id, version_label, available_at) with its part at the cutoff.

    decision is SELECTED for the best version known by then, ELIGIBLE for others, BOUNDARY for later ones; a selected
    one names the latest other eligible one that it supersedes.
    """
    live = documents.filter(F.col("version_label") != "withdrawn")
    known = F.coalesce(F.col("available_at") <= cutoff, F.lit(False))
    rank = looked_up("version_label", VERSION_RANKS, 1)
    period = Window.partitionBy("security_code", "report_date")
    order = period.orderBy(known.desc(), rank.desc(), F.col("available_at").desc(), F.col("document_id").desc())
    marked = live.withColumns({"known": known, "p__n": F.row_number().over(order)})
    chosen = F.col("known") & (F.col("p__n") == 1)
    other = F.when(F.col("known") & (F.col("p__n") > 1), F.struct("available_at", rank.alias("r"), "document_id"))
    last = F.max(other).over(period)["document_id"]
    decision = F.when(chosen, "SELECTED").when(F.col("known"), "ELIGIBLE").otherwise("BOUNDARY")
    return marked.withColumns({"supersedes": F.when(chosen, last), "decision": decision}).drop("known", "p__n")


def missing_periods(documents: DataFrame, requested: DataFrame, cutoff: Column) -> DataFrame:
    """Requested (security_code, report_date) without a version known at the cutoff."""
    found = versions_as_of(documents, cutoff).filter("decision = 'SELECTED'").select("security_code", "report_date")
    return requested.join(found, ["security_code", "report_date"], "left_anti")


def with_disclosures(facts: DataFrame, disclosures: DataFrame) -> DataFrame:
    """available_at from disclosures where a fact has none: the latest of its record, else of its security and date."""
    by_record = disclosures.groupBy(F.col("record_key").alias("d__k"), F.col("security_code").alias("d__c1"),
        F.col("report_date").alias("d__r1")).agg(F.max("available_at").alias("d__a"))
    by_date = disclosures.groupBy(F.col("security_code").alias("d__c"), F.col("report_date").alias("d__r")).agg(F.max("available_at").alias("d__b"))
    out = facts.join(by_record, (facts["record_key"] == F.col("d__k")) & (facts["security_code"] == F.col("d__c1")) & (facts["report_date"] == F.col("d__r1")),
        "left")
    out = out.join(by_date, (facts["security_code"] == F.col("d__c")) & (facts["report_date"] == F.col("d__r")), "left")
    return out.select(*[c for c in facts.columns if c != "available_at"], F.coalesce(facts["available_at"], F.col("d__a"), F.col("d__b")).alias("available_at"))


def source_priority() -> Column:
    suspect = F.upper("source_status").isin("PARSE_SUSPECT", "UNRESOLVED")
    return F.coalesce(F.col("source_priority"), F.when(F.upper("family") == "OFFICIAL_DISCLOSURE", 100).when(suspect, 0).otherwise(60))


def candidates(facts: DataFrame, cutoff: Column) -> DataFrame:
    """Facts in 元 with usability: USABLE, FUTURE_AVAILABLE_AT or AVAILABLE_AT_MISSING at the cutoff."""
    state = F.when(F.col("available_at").isNull(), "AVAILABLE_AT_MISSING").when(F.col("available_at") > cutoff, "FUTURE_AVAILABLE_AT").otherwise("USABLE")
    value = F.col("value_num") * looked_up(F.coalesce("unit", F.lit("")), UNIT_SCALES, 1.0)
    return facts.filter("report_date is not null").withColumns(
        {"field_key": F.upper("field_key"), "value_num": value, "unit": canonical_unit("unit"), "usability": state, "source_priority": source_priority()}
    )


def specs(fields: dict | None = None) -> Column:
    """Target fields as an array of (target, key, rank, kind), to be exploded."""
    rows = [
        F.struct(F.lit(t).alias("target"), F.lit(k).alias("key"), F.lit(r).alias("rank"), F.lit(kind).alias("kind"))
        for t, (keys, kind, _) in (fields or FIELDS).items() for r, k in enumerate(keys)
    ]
    return F.array(*rows)


def selected(facts: DataFrame, cutoff: Column, standalone: bool | None = False, fields: dict | None = None) -> DataFrame:
    """One status and value for each security, report date and target field.

    The latest known value wins, then the source, then the key. Rows of that tier that disagree make it CONFLICTING;
    with only suspect sources it is PARSE_SUSPECT. Running totals and single quarters don't mix; with standalone None both
    are there, and column `single` tells flows from single quarters.

    Both aggregations go by the group, so facts that are dealt by security already aren't shuffled.
    """
    usable = candidates(facts, cutoff).filter("usability = 'USABLE'")
    named = usable.withColumn("s", F.explode(F.filter(specs(fields), lambda x: x["key"] == F.col("field_key")))).select("*", "s.*")
    single = F.coalesce(F.col("period_basis"), F.lit("CUMULATIVE")).isin("STANDALONE", "SINGLE_QUARTER")
    both = standalone is None
    group = ["security_code", "report_date", "target", *(["single"] if both else [])]
    flow = F.col("kind") == "flow"
    named = named.withColumn("single", flow & single) if both else named.filter(~flow | (single if standalone else ~single))
    named = named.withColumns({"p__usable": F.col("source_priority") > 0, "p__rank": -F.col("rank")})
    tier = ["p__usable", "available_at", "source_priority", "p__rank"]
    nulls_last = lambda c: [F.col(c).isNull(), F.col(c)]
    first = F.min_by(F.struct("kind", "value_num", "value_text"), F.struct(*nulls_last("record_key"), *nulls_last("value_num")))
    text = F.trim("value_text")
    # of each tier, then the best tier
    tiers = named.groupBy(*group, *tier).agg(
        first.alias("p__one"), F.min("value_num").alias("p__low"), F.max("value_num").alias("p__high"), F.min(text).alias("p__text"), F.max(text).alias("p__text_"),
        F.count("value_num").alias("p__some"), F.count(F.lit(1)).alias("p__all"),
    )
    rest = [c for c in tiers.columns if c not in group]
    top = tiers.groupBy(*group).agg(F.max_by(F.struct(*rest), F.struct(*tier)).alias("p__b")).select(*group, *[F.col(f"p__b.{c}") for c in rest])
    top = top.select("*", "p__one.*")
    allowed = F.greatest(F.lit(1e-8), F.greatest(F.abs("p__low"), F.abs("p__high"), F.lit(1.0)) * 1e-10)
    same = F.when(F.col("p__some") == F.col("p__all"), F.col("p__high") - F.col("p__low") <= allowed).otherwise(F.coalesce(F.col("p__text") == F.col("p__text_"), F.lit(True)))
    status = F.when(~F.col("p__usable"), "PARSE_SUSPECT").when(~same, "CONFLICTING").otherwise("SOURCE_DIRECT")
    one = top.withColumn("status", status)
    direct = F.col("status") == "SOURCE_DIRECT"
    return one.select(
        *group, "kind", "status", F.when(direct, F.col("value_num")).alias("value"),
        F.when(direct, F.col("value_text")).alias("text"), F.when(direct, F.col("available_at")).alias("available_at"),
    )


def with_gross_profit(chosen: DataFrame) -> DataFrame:
    """Rows of selected() with gross profit derived from revenue and cost where no source gives it."""
    group = Window.partitionBy("security_code", "report_date")
    pick = lambda t, c: F.max(F.when(F.col("target") == t, F.col(c))).over(group)
    wide = chosen.withColumns({"p__v": pick("revenue", "value") - pick("operating_cost", "value"),
        "p__a": F.greatest(pick("revenue", "available_at"), pick("operating_cost", "available_at")),
                               "p__g": F.max((F.col("target") == "gross_profit").cast("int")).over(group)})
    made = {"target": F.lit("gross_profit"), "status": F.lit("DERIVED"), "value": F.col("p__v"), "text": F.lit(None).cast("string"), "available_at": F.col("p__a")}
    own, derived = F.struct(*made), F.struct(*[v.alias(c) for c, v in made.items()])
    hit = F.expr("target = 'revenue' and p__g = 0 and p__v is not null")
    each = wide.withColumn("p__x", F.explode(F.when(hit, F.array(own, derived)).otherwise(F.array(own))))
    return each.select(*[F.col(f"p__x.{c}").alias(c) if c in made else F.col(c) for c in chosen.columns])


def debt_proxy(facts: DataFrame, cutoff: Column) -> DataFrame:
    """Interest-bearing debt as the sum of the parts that there are: status DERIVED_PROXY."""
    parts = selected(facts, cutoff, fields={k: ([k], "point", True) for k in DEBT}).filter("status = 'SOURCE_DIRECT'")
    return parts.groupBy("security_code", "report_date").agg(F.sum("value").alias("value"), F.max("available_at").alias("available_at")).select(
        "security_code", "report_date", F.lit("interest_bearing_debt").alias("target"), F.lit("point").alias("kind"), F.lit("DERIVED_PROXY").alias("status"),
        "value", F.lit(None).cast("string").alias("text"), "available_at",
    )


def with_debt_proxy(chosen: DataFrame, proxies: DataFrame) -> DataFrame:
    """Rows of selected() with debt_proxy() where no source gives the debt itself; what came out unusable makes room for it."""
    key = ["security_code", "report_date", "target"]
    both = chosen.withColumn("p__proxy", F.lit(False)).unionByName(proxies.withColumn("p__proxy", F.lit(True)))
    known = F.col("security_code").isNotNull() & F.col("report_date").isNotNull() & F.col("target").isNotNull()  # nothing is of an unknown one
    of = Window.partitionBy(*key)
    direct = ~F.col("p__proxy") & (F.col("target") == "interest_bearing_debt") & F.col("value").isNotNull()
    seen = both.withColumns({"p__d": known & F.max(direct).over(of), "p__p": known & F.max("p__proxy").over(of)})
    return seen.filter(F.when(F.col("p__proxy"), ~F.col("p__d")).otherwise(~F.col("p__p") | F.col("p__d"))).select(*chosen.columns)


def field_statuses(chosen: DataFrame, periods: DataFrame | None, template: Column) -> DataFrame:
    """A row for each period and target: SOURCE_MISSING where nothing was found, NOT_APPLICABLE by industry template.

    periods: security_code, report_date; None stands for all that were chosen. What was chosen for a period, a few targets,
    is gathered before the targets are laid out, so no row of a target is shuffled.
    """
    cells = ["status", "value", "text", "available_at"]
    every = chosen.groupBy("security_code", "report_date").agg(F.collect_list(F.struct("target", *cells)).alias("p__c"))
    every = every if periods is None else periods.join(every, ["security_code", "report_date"], "left")
    targets = F.explode(F.array(*[F.lit(t) for t in FIELDS])).alias("target")
    out = every.withColumn("template", template).select("security_code", "report_date", "template", "p__c", targets)
    out = out.withColumn("p__x", F.explode_outer(F.filter("p__c", lambda x: x["target"] == F.col("target")))).select("security_code", "report_date", "template", "target",
        *[F.col(f"p__x.{c}").alias(c) for c in cells])
    na = (F.col("template") != "INDUSTRIAL") & F.col("target").isin(*INDUSTRIAL_ONLY)
    status = F.when(na, "NOT_APPLICABLE").otherwise(F.coalesce("status", F.lit("SOURCE_MISSING")))
    hidden = lambda c: F.when(~na, F.col(c)).alias(c)
    return out.select("security_code", "report_date", "target", status.alias("status"), hidden("value"), hidden("text"), hidden("available_at"))


def annual(statuses: DataFrame) -> DataFrame:
    """A row a security and year end, a column a target, and when the last of them was known."""
    ends = statuses.filter((F.month("report_date") == 12) & (F.dayofmonth("report_date") == 31))
    numbers = [t for t, (_, kind, _) in FIELDS.items() if kind != "text"]
    cells = [F.max(F.when(F.col("target") == t, F.col("value"))).alias(t) for t in numbers]
    cells += [F.max(F.when(F.col("target") == t, F.col("text"))).alias(t) for t, (_, kind, _) in FIELDS.items() if kind == "text"]
    return ends.groupBy("security_code", "report_date").agg(*cells, F.max("available_at").alias("available_at"))


def quarterly(cumulative: DataFrame, single: DataFrame) -> DataFrame:
    """Standalone quarters of selected() rows: a single-quarter source, else the difference of running totals; balances as they are."""
    return quarters_of(cumulative.withColumn("single", F.lit(False)).unionByName(single.filter("kind = 'flow'").withColumn("single", F.lit(True))))


def quarters_of(chosen: DataFrame) -> DataFrame:
    """quarterly() of rows of both kinds, as selected() gives them with standalone None; windows over a year of one target, no join."""
    year = ["security_code", "target", F.year("report_date")]
    before = Window.partitionBy(*year, "single").orderBy(F.quarter("report_date")).rangeBetween(-1, -1)
    q, single = F.quarter("report_date"), F.col("single")
    rows = chosen.filter((~single & (F.col("kind") != "text")) | (single & (F.col("status") == "SOURCE_DIRECT")))
    rows = rows.withColumns({"p__v": F.first("value").over(before), "p__a": F.first("available_at").over(before)})
    flow = F.col("kind") == "flow"
    value = F.when(~flow | (q == 1), F.col("value")).otherwise(F.col("value") - F.col("p__v"))
    known = F.when(~flow | (q == 1), F.col("available_at")).otherwise(F.greatest("available_at", "p__a"))
    status = F.when(value.isNull(), F.when(F.col("status") == "SOURCE_DIRECT", "SOURCE_MISSING").otherwise(F.col("status"))).when(flow & (q > 1),
        "DERIVED").otherwise(F.col("status"))
    # each total with the single quarter of its date beside it, if there is one; a single quarter alone where there is no total
    of_date = Window.partitionBy(*year).orderBy(F.unix_date("report_date") * 2 + single.cast("int"))
    valid = F.col("security_code").isNotNull() & F.col("report_date").isNotNull() & F.col("target").isNotNull()
    at = lambda x, k: F.when(valid, F.first(x).over(of_date.rangeBetween(k, k)))
    both = rows.withColumns({"d__v": value, "d__a": known, "d__s": status, "s__v": at(F.col("value"), 1), "s__a": at(F.col("available_at"), 1), "p__t": at(~single, -1)})
    own = single | F.col("s__v").isNotNull()
    pick = lambda c: F.when(single, F.col(c))
    return both.filter(~single | F.col("p__t").isNull()).select(
        "security_code", "report_date", "target", pick("value").when(own, F.col("s__v")).otherwise(F.col("d__v")).alias("value"),
        pick("available_at").when(own, F.col("s__a")).otherwise(F.col("d__a")).alias("available_at"), F.when(own, "SOURCE_DIRECT").otherwise(F.col("d__s")).alias("status"),
    )


def scoped(rows: DataFrame, requests: DataFrame, start: str = "request_annual_from") -> DataFrame:
    """Rows within the request window of their security."""
    r = requests.select(F.col("code").alias("r__c"), F.col(start).alias("r__a"), F.col("request_through").alias("r__z"))
    on = (F.col("security_code") == F.col("r__c")) & F.col("report_date").between(F.col("r__a"), F.col("r__z"))
    return rows.join(r, on, "left_semi")


def industry_template(name: Column) -> Column:
    return (
        F.when(F.contains(name, F.lit("银行")), "BANK").when(F.contains(name, F.lit("保险")), "INSURANCE").when(name.rlike("证券|券商"), "SECURITIES")
        .when(name.rlike("信托|金控|金融租赁|消费金融"), "OTHER_FINANCIAL").otherwise("INDUSTRIAL")
    )


def gaps(facts: DataFrame, statuses: DataFrame, cutoff: Column) -> DataFrame:
    """Why data is missing: facts of unknown or later availability, and target fields that came out unusable."""
    c = candidates(facts, cutoff).filter("usability != 'USABLE'")
    a = c.select("security_code", "report_date", F.col("field_key").alias("field"),
        F.when(F.col("usability") == "FUTURE_AVAILABLE_AT", "FUTURE_EXCLUDED").otherwise("AVAILABLE_AT_MISSING").alias("gap"))
    b = statuses.filter(F.col("status").isin("SOURCE_MISSING", "PARSE_SUSPECT", "CONFLICTING")).select("security_code", "report_date",
        F.col("target").alias("field"), F.col("status").alias("gap"))
    return a.unionByName(b)


def coverage(statuses: DataFrame, template: Column) -> DataFrame:
    return statuses.withColumn("template", template).groupBy("template", "target", "status").agg(F.count(F.lit(1)).alias("n"))


def violations(rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row breaks; a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(*key, F.explode(broken).alias("rule"))


def formal_violations(rows: DataFrame, cutoff: Column, requests: DataFrame | None = None, start: str = "request_annual_from") -> DataFrame:
    """(security_id, report_period, rule) of a table that is to be handed on: one row a security and period, known by the cutoff.

    DUPLICATE_KEY, AVAILABLE_AT_MISSING and FUTURE_ROW; with requests (security_id, start, request_through, status) also
    UNKNOWN_SECURITY, of which no request succeeded, and PERIOD_OUT_OF_RANGE. A table that lacks a column is an error.
    """
    needed = ["security_id", "report_period", "available_at"]
    if absent := sorted(set(needed) - set(rows.columns)):
        raise ValueError(f"SCHEMA_INVALID: {absent}")
    key = ["security_id", "report_period"]
    out = rows.select(*needed).withColumn("p__n", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    known = F.col("available_at").isNotNull() & (F.trim(F.col("available_at").cast("string")) != "")
    rules = {"DUPLICATE_KEY": F.col("p__n") == 1, "AVAILABLE_AT_MISSING": known, "FUTURE_ROW": ~known | (F.col("available_at") <= cutoff)}
    if requests is not None:
        own = requests.filter("status = 'SUCCESS'").groupBy(F.col("security_id").alias("r__id")).agg(F.min(start).alias("r__a"), F.max("request_through").alias("r__z"))
        out = out.join(own, F.col("security_id").cast("string") == F.col("r__id").cast("string"), "left")
        unknown = F.col("r__id").isNull()
        rules |= {"UNKNOWN_SECURITY": ~unknown, "PERIOD_OUT_OF_RANGE": unknown | F.col("report_period").between(F.col("r__a"), F.col("r__z"))}
    return violations(out, key, rules).distinct()


def formal(rows: DataFrame, cutoff: Column, requests: DataFrame | None = None, start: str = "request_annual_from") -> DataFrame:
    """rows, if they break no formal rule; an error that says how often each is broken if they do."""
    broken = formal_violations(rows, cutoff, requests, start).groupBy("rule").agg(F.count(F.lit(1)).alias("n")).collect()
    if broken:  # as many rows as there are rules at most
        raise ValueError(", ".join(sorted(f"{r.rule}: {r.n}" for r in broken)))
    return rows


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def pending(requested: DataFrame, done: DataFrame) -> DataFrame:
    """Requests without a final success; those in flight count as to be tried again."""
    return requested.join(done.filter("status = 'SUCCESS'").select("security_id"), "security_id", "left_anti")
