"""Two-source comparison: contexts classified by rules, a match at three grains, verdicts and a summary.

The official rows of a field and date are gathered before they are joined, so a match at all three grains is one
equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.priority import COMPARE_PRIORITY, INDEPENDENT, STATEMENTS, canonical_unit, looked_up, scaled
from factloom.functions.rules import IDENTITIES, TOLERANCE_GROUPS
from factloom.functions.targets import default_targets
from factloom.operators.normalize import canonical_period, date_of, plain_text, report_label
from factloom.operators.timeseries import first_by

# Classes of statuses.
CONFLICTS = ["MISMATCH", "VERSION_CONFLICT", "SCOPE_CONFLICT", "PERIOD_CONFLICT", "UNIT_CONFLICT"]
MATCHES = ["EXACT_MATCH", "WITHIN_ROUNDING", "DERIVED_MATCH", "TEXT_MATCH_NORMALIZED", "SET_MATCH"]
NOT_COMPARABLE = [
    "NOT_IN_OFFICIAL_SCOPE", "SOURCE_SPECIFIC", "FUTURE_FREE_SOURCE_REQUIRED", "OFFICIAL_PERIOD_NOT_LOADED", "OFFICIAL_SOURCE_UNAVAILABLE",
    "PRE_LISTING_OFFICIAL_SOURCE_NOT_LOADED", "OFFICIAL_REPORT_SUMMARY_SCOPE_GAP", "OFFICIAL_REPORT_NOT_YET_DISCLOSED",
]
UNRESOLVED = ["MISSING_OFFICIAL", "MISSING_EASTMONEY", "OFFICIAL_DOCUMENT_EXTRACTION_FAILED", "POST_LISTING_OFFICIAL_REPORT_NOT_FOUND", "UNRESOLVED"]
# How families are validated, tried in this order; the patterns are parts of family names.
DIRECT = ["RPT_F10_FINANCE_GBALANCE", "RPT_F10_FINANCE_GINCOME", "RPT_F10_FINANCE_GCASHFLOW"]
DERIVED = [
    "RPT_F10_FINANCE_GINCOMEQC", "RPT_F10_FINANCE_GCASHFLOWQC", "RPT_F10_FINANCE_MAINFINADATA", "RPT_F10_QTR_MAINFINADATA",
    "RPT_F10_FINANCE_GRATIO", "RPT_F10_FINANCE_QGRATIO", "RPT_F10_FINANCE_DUPONT", "RPT_PCF10_FINANCEMAINFINADATA",
]
METADATA_KEYS = [
    "SECUCODE", "SECURITY_CODE", "SECURITY_NAME", "SECURITY_NAME_ABBR", "ORG_CODE", "ORG_NAME", "ORG_NAME_ABBR", "REPORT_DATE", "REPORT_TYPE",
    "REPORT_DATE_NAME", "NOTICE_DATE", "PUBLISH_DATE", "UPDATE_DATE", "CURRENCY", "OPINION_TYPE", "OSOPINION_TYPE", "LISTING_STATE",
]
NOT_PERIODIC = [
    "/api/qt/", "BILLBOARD", "OPERATEDEPT_TRADE", "BLOCKTRADE", "MARGIN_STATISTICS", "MUTUAL_STOCK", "NORTH_ORG", "EXCHANGEHOLD", "/infoService",
    "/api/security/ann", "/api/content/ann", "/api/content/rep",
]
SOURCE_SPECIFIC = [
    "PageAjax", "CORETHEME", "COMPETITIVENESS", "POPULAR", "DMSK", "RELATE_RANK", "INDUSTRY_GROWTH", "INDUSTRY_CVALUE", "INDUSTRY_DBFX",
    "MARKETPER", "PREDICT", "ORGRATING", "AI", "TREND", "EXPLAIN",
]
EVENTS = [
    "ORG_BASICINFO", "BASICINFO", "ORGINFO", "MANAINTRO", "STAFF", "EXECUTIVE", "EH_HOLDER", "FREEHOLDER", "HOLDERNUM", "EH_EQUITY",
    "SHAREHOLDER", "DIVIDEND", "CAPITAL", "FN_SEGMENT", "BUSINESS", "GUARANTEE", "LITIGATION", "VIOLATION", "ORIG_REPORT", "ISSUEINFO",
    "RECAPITALIZE", "LIFTFUTURE", "ACCUMDETAILS", "CUSTSUPP", "RDEXPENSE",
]
TECHNICAL = ["HTTP", "API_METADATA", "JSON_STRUCTURE", "TECHNICAL"]


def _any(text: Column, parts: list[str]) -> Column:
    upper = F.upper(text)
    hit = F.lit(False)
    for p in parts:
        hit = hit | F.contains(upper, F.lit(p.upper()))
    return hit


def validation_mode(family: Column, key: Column, category: Column) -> Column:
    """How a field context is validated: ordered rules as one expression."""
    metadata = key.isin(*METADATA_KEYS)
    return (
        F.when(family.isin(*DIRECT), F.when(metadata, "OFFICIAL_METADATA").otherwise("OFFICIAL_DIRECT"))
        .when(family.isin(*DERIVED), "OFFICIAL_DERIVED")
        .when(_any(category, TECHNICAL) | F.startswith(key, F.lit("_")), "EASTMONEY_SOURCE_SPECIFIC")
        .when(_any(family, NOT_PERIODIC), "NOT_IN_PERIODIC_REPORT_SCOPE")
        .when(_any(family, SOURCE_SPECIFIC), "EASTMONEY_SOURCE_SPECIFIC")
        .when(metadata, "OFFICIAL_METADATA")
        .when(_any(family, ["BASICINFO", "ORGINFO"]), "OFFICIAL_METADATA")
        .when(_any(family, EVENTS), "OFFICIAL_DOCUMENT_EVENT")
        .otherwise("FUTURE_FREE_SOURCE_REQUIRED")
    )


def policy(key: Column, name: Column, unit: Column, semantics: Column) -> Column:
    """(method, absolute, relative): how a field is compared, by its key, label, unit and kind."""
    k, n, u = F.upper(key), F.coalesce(name, F.lit("")), F.trim(F.coalesce(unit, F.lit("")))

    def of(method, absolute=None, relative=None):
        return F.struct(F.lit(method).alias("method"), F.lit(absolute).cast("double").alias("absolute"), F.lit(relative).cast("double").alias("relative"))

    return (
        F.when(F.contains(k, F.lit("DATE")) | n.rlike("日期|时间"), of("date"))
        .when(n.rlike("名单|列表|成员"), of("set"))
        .when(k.rlike("EPS|PER_SHARE|BPS") | n.rlike("每股"), of("per_share", 0.0001, 1e-6))
        .when(u.isin("%", "百分点", "百分比") | n.rlike("率|比例|占比|收益率"), of("percentage", 0.01, 1e-6))
        .when(u.isin("人", "户", "家", "股", "次", "个") | k.rlike("COUNT|SHARES|EMPLOYEE|HOLDER_NUM"), of("integer", 0.5, 0.0))
        .when(u.isin("元", "千元", "万元", "亿元"), of("numeric", 1.0, 1e-10))
        .when(F.lower(semantics).isin("point_in_time", "flow"), of("numeric", 1e-9, 1e-9))
        .otherwise(of("text"))
    )


def registry(facts: DataFrame) -> DataFrame:
    """One entry for each field context: mode, statement and comparison policy."""
    contexts = facts.groupBy("theme", "family", "dataset", "field_key").agg(
        *[F.min(c).alias(c) for c in ("field_name_cn", "unit", "data_semantics", "field_category")]
    )
    p = policy(F.col("field_key"), F.col("field_name_cn"), F.col("unit"), F.col("data_semantics"))
    mode = validation_mode(F.col("family"), F.col("field_key"), F.col("field_category"))
    return contexts.select("theme", "family", "dataset", "field_key", mode.alias("mode"), looked_up("family", STATEMENTS, F.lit("")).alias("statement_type"),
        p.alias("p")).select("*", "p.*").drop("p")


def registry_coverage(entries: DataFrame) -> DataFrame:
    return entries.groupBy("mode", "method").agg(F.count(F.lit(1)).alias("contexts"))


def classified(facts: DataFrame, entries: DataFrame) -> DataFrame:
    """Facts with the registry's entry of their context; contexts that it doesn't know have null fields."""
    known = [c for c in entries.columns if c in facts.columns and c not in CONTEXT]
    return facts.drop(*known).join(entries, CONTEXT, "left")


CONTEXT = ["theme", "family", "dataset", "field_key"]


def overridden(entries: DataFrame, overrides: DataFrame) -> DataFrame:
    """Registry entries with the policies of single fields (field_key, method, absolute, relative) put over the inferred ones.

    A null part of an override leaves what was inferred. Overrides are a row a field key; Spark picks the join by their size.
    """
    parts = ["method", "absolute", "relative"]
    named = overrides.select("field_key", *[F.col(c).alias(f"r__{c}") for c in parts])
    out = entries.join(named, "field_key", "left")
    return out.withColumns({c: F.coalesce(f"r__{c}", c) for c in parts}).drop(*[f"r__{c}" for c in parts])


# Themes of official statements, and whether their values are flows or balances.
OFFICIAL_THEMES = {"balance_sheet": "官方披露/资产负债表", "income_statement": "官方披露/利润表", "cash_flow": "官方披露/现金流量表", "summary": "官方披露/摘要"}
OFFICIAL_SEMANTICS = {"balance_sheet": "point_in_time", "income_statement": "flow", "cash_flow": "flow"}


def prepared_primary(facts: DataFrame) -> DataFrame:
    """Facts ready to be compared: canonical period, statement, scope and unit; treasury shares of balances are money."""
    date = F.date_format("report_date", "yyyy-MM-dd") if dict(facts.dtypes)["report_date"] == "date" else F.col("report_date")
    statement = looked_up("family", STATEMENTS, F.lit(""))
    money = (F.col("family") == "RPT_F10_FINANCE_GBALANCE") & (F.col("field_key") == "TREASURY_SHARES")
    unit = F.when(money, "元").otherwise(F.col("unit"))
    return facts.withColumns({
        "period_type": canonical_period(date, F.col("family"), F.col("period_type"), INDEPENDENT), "statement_type": statement,
        "scope": F.when(statement != "", "consolidated").otherwise("entity"), "unit": unit, "normalized_unit": F.coalesce(unit, F.lit("")),
        "source": F.lit("EASTMONEY"), "source_document": F.col("family"), "source_row": F.coalesce("record_key", F.lit("")), "confidence": F.lit("high"),
    })


def prepared_official(rows: DataFrame, include_suspect: bool = False) -> DataFrame:
    """Official rows as facts: suspect ones go unless asked for; theme, dataset, key, period and kind come from the statement."""
    known = rows.withColumn("source_status", F.coalesce("source_status", F.lit("FACT_DIRECT")))
    if not include_suspect:
        known = known.filter(~F.col("source_status").isin("PARSE_SUSPECT", "UNRESOLVED"))
    date = F.date_format("report_date", "yyyy-MM-dd") if dict(rows.dtypes)["report_date"] == "date" else F.col("report_date")
    return known.withColumns({
        "source": F.lit("OFFICIAL_DISCLOSURE"), "family": F.lit("OFFICIAL_DISCLOSURE"), "theme": looked_up("statement_type", OFFICIAL_THEMES, F.lit("官方披露")),
        "dataset": F.col("source_document"), "record_key": F.concat_ws("|", "security_code", date, "statement_type", "field_key"),
        "period_type": canonical_period(date, F.lit(""), F.lit(None).cast("string"), INDEPENDENT),
            "data_semantics": looked_up("statement_type", OFFICIAL_SEMANTICS, F.lit("event")),
        "field_name_cn": F.col("field_name_report"), "field_category": F.lit("PAGE_DISPLAY_FIELD"), "value_num": F.col("value"),
            "value_text": F.col("value").cast("string"),
        "source_url": F.coalesce("source_url", F.lit("")),
    })


def comparison_key(event_date: str | None = "event_date") -> Column:
    """What a compared row is known by: eight parts, empty where null."""
    parts = ["security_code", "report_date", event_date, "period_type", "family", "dataset", "record_key", "field_key"]
    return F.concat_ws("|", *[F.lit("") if p is None else F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])


def source_unavailable(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Missing official values of securities (security_code, message) whose official source couldn't be reached, as what they are."""
    gone = sources.select("security_code", F.col("message").alias("r__m"), F.lit(True).alias("r__gone"))
    out = rows.join(gone, "security_code", "left")
    hit = F.coalesce("r__gone", F.lit(False)) & (F.col("status") == "MISSING_OFFICIAL")
    notes = F.coalesce(F.nullif("r__m", F.lit("")), F.lit("官方披露来源不可用"))
    old = F.col("notes") if "notes" in rows.columns else F.lit(None).cast("string")
    return out.withColumns({"status": F.when(hit, "OFFICIAL_SOURCE_UNAVAILABLE").otherwise(F.col("status")),
        "notes": F.when(hit, notes).otherwise(old)}).drop("r__m", "r__gone")


def date_sets(requested: DataFrame, documents: DataFrame) -> DataFrame:
    """(security_code, report_date, state) of requested and loaded report dates.

    documents: security_code, report_date, scope, extracted (how many facts a report gave). LOADED, SUMMARY_ONLY and
    ZERO_EXTRACTION have a report; without one a date is PENDING after the security's latest report, else MISSING.
    """
    key = ["security_code", "report_date"]
    d = documents.groupBy(*key).agg(F.max(F.col("scope") == "SUMMARY_ONLY").alias("summary"), F.sum("extracted").alias("extracted"))
    both = requested.select(*key).distinct().withColumn("asked", F.lit(True)).join(d.withColumn("there", F.lit(True)), key, "full_outer")
    latest = F.max(F.when(F.col("there"), F.col("report_date"))).over(Window.partitionBy("security_code"))
    state = (
        F.when(F.col("there") & F.col("summary"), "SUMMARY_ONLY").when(F.col("there") & (F.col("extracted") == 0), "ZERO_EXTRACTION").when(F.col("there"),
            "LOADED")
        .when(F.col("report_date") > latest, "PENDING").otherwise("MISSING")
    )
    return both.select(*key, state.alias("state"))


def acceptance(summaries: DataFrame) -> DataFrame:
    """A verdict for each security from its counts: conflicts, contexts without a class, an unreachable source, gaps, else PASS.

    summaries: security_code, conflicts, unresolved, classification_coverage, source_unavailable, parse_suspect_count.
    """
    c = F.col
    verdict = (
        F.when(c("conflicts") > 0, "FAIL_SOURCE_CONFLICT").when(c("classification_coverage") < 1.0, "FAIL_CLASSIFICATION_COVERAGE")
        .when(c("source_unavailable"), "PARTIAL_OFFICIAL_SOURCE_UNAVAILABLE").when((c("unresolved") > 0) | (c("parse_suspect_count") > 0),
            "PASS_WITH_COVERAGE_GAPS").otherwise("PASS")
    )
    return summaries.withColumns({"acceptance_status": verdict, "manual_review_required": c("conflicts") > 0})


# Keys that aren't targets of an extraction.
NOT_TARGETS = [
    "SECUCODE", "SECURITY_CODE", "SECURITY_NAME_ABBR", "ORG_CODE", "ORG_TYPE", "REPORT_DATE", "REPORT_TYPE", "REPORT_DATE_NAME", "SECURITY_TYPE_CODE",
    "NOTICE_DATE", "UPDATE_DATE", "CURRENCY", "OPINION_TYPE", "OSOPINION_TYPE", "LISTING_STATE",
]


def dynamic_targets(facts: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """(family, field_key, label, aliases, statement_type, semantics): what to look for in reports.

    Every numeric field of a primary statement with a label of its own is one, known by all its labels, but for metadata
    and growth. defaults, of the same columns, come first in labels and aliases; without them those of functions.targets.
    """
    defaults = default_targets(facts.sparkSession) if defaults is None else defaults
    label = F.trim(F.coalesce(F.nullif("field_name_cn", F.lit("")), F.col("field_key")))
    key = F.col("field_key")
    rows = facts.filter(F.col("family").isin(*DIRECT) & F.col("value_num").isNotNull() & ~F.startswith(key,
        F.lit("_")) & ~key.isin(*NOT_TARGETS) & ~key.rlike("_(YOY|QOQ)$"))
    named = rows.select("family", "field_key",
        label.alias("label")).filter((F.col("label") != "") & (F.col("label") != F.col("field_key")) & (F.length("label") <= 60))
    each = named.groupBy("family", "field_key").agg(F.array_sort(F.collect_set("label")).alias("found"))
    d = defaults.select("family", "field_key", *[F.col(c).alias(f"r__{c}") for c in ("label", "aliases", "statement_type", "semantics")])
    both = each.join(d, ["family", "field_key"], "full_outer")
    shortest = F.array_min(F.transform("found", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    aliases = F.when(F.col("r__aliases").isNull(), F.col("found")).otherwise(F.array_distinct(F.concat("r__aliases",
        F.coalesce("found", F.array().cast("array<string>")))))
    semantics = F.when(F.col("family") == DIRECT[0], "point_in_time").otherwise("flow")
    return both.select(
        "family", "field_key", F.coalesce("r__label", shortest).alias("label"), aliases.alias("aliases"),
        F.coalesce("r__statement_type", looked_up("family", STATEMENTS, F.lit(""))).alias("statement_type"),
            F.coalesce("r__semantics", semantics).alias("semantics"),
    )


def thin_slice(facts: DataFrame, official: DataFrame, targets: DataFrame) -> DataFrame:
    """Target fields of each report date against official rows: exact within 1, else within the official precision.

    targets: target, family, family_rank, key, key_rank, one row for each family and key that may give it; the first by family,
    then key, is compared. Rows of which neither side has a value aren't there.
    """
    usable = official.filter(~F.coalesce("source_status", F.lit("")).isin("PARSE_SUSPECT", "UNRESOLVED"))
    dates = official.select("security_code", "report_date").distinct()
    named = facts.filter("value_num is not null").withColumnRenamed("field_key", "key").join(targets, ["family", "key"])
    own = named.groupBy("security_code", "report_date", "target").agg(F.min_by(F.struct("value_num", "family"), F.struct("family_rank", "key_rank")).alias("f"))
    own = own.join(dates, ["security_code", "report_date"], "left_semi")
    wanted = targets.select("target").distinct()
    other = usable.withColumnRenamed("field_key", "target").join(wanted, "target", "left_semi").groupBy("security_code", "report_date",
        "target").agg(F.max(F.struct("value", "precision_tolerance")).alias("o"))
    both = own.join(other, ["security_code", "report_date", "target"], "full_outer")
    gap, allowed = F.col("f.value_num") - F.col("o.value"), F.coalesce("o.precision_tolerance", F.lit(1.0))
    status = (
        F.when(F.col("o").isNull(), "MISSING_OFFICIAL").when(F.col("f").isNull(), "MISSING_EASTMONEY")
        .when(F.abs(gap) <= allowed, F.when(F.abs(gap) <= 1.0, "EXACT_MATCH").otherwise("WITHIN_ROUNDING")).otherwise("MISMATCH")
    )
    return both.select(
        "security_code", "report_date", "target", F.col("f.value_num").alias("value_num"), F.col("o.value").alias("official_value"), gap.alias("difference"),
        status.alias("status"), F.when(status.isin("EXACT_MATCH", "WITHIN_ROUNDING"), "A").otherwise("E").alias("grade"),
    )


def searched(rows: DataFrame, word: str = "", status: str | None = None, mode: str | None = None, start=None, end=None) -> DataFrame:
    """Compared rows with a word in key, label, family or notes, and of a status, mode or date (of the report, else the event)."""
    columns = [c for c in ("field_key", "field_name_cn", "family", "notes") if c in rows.columns]
    out = rows
    if word.strip():
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(word.strip().lower()))
        out = out.filter(hit)
    out = out.filter(F.col("status") == status) if status else out
    out = out.filter(F.col("mode") == mode) if mode else out
    date = F.coalesce("report_date", "event_date") if "event_date" in rows.columns else F.col("report_date")
    out = out.filter(date >= F.lit(start)) if start else out
    return out.filter(date <= F.lit(end)) if end else out


def search_page(found: DataFrame, order: list[str], page: int = 1, size: int = 100) -> DataFrame:
    """A page of what searched() found, in an order that the given columns and then all others decide, with the total of all pages."""
    every = found.agg(F.count(F.lit(1)).alias("total"))  # one row
    last = [c for c, kind in found.dtypes if c not in order and not kind.startswith(("map", "variant"))]
    rows = found.orderBy(*[F.asc_nulls_last(c) for c in [*order, *last]]).offset((max(page, 1) - 1) * size).limit(size)
    return rows.crossJoin(F.broadcast(every))


def primary(facts: DataFrame) -> DataFrame:
    """One row for each security, record and field: family of the highest priority, then those with a number, then the latest known."""
    order = [looked_up("family", COMPARE_PRIORITY, 99), F.col("value_num").isNull(), F.coalesce(-F.unix_date("available_at"), F.lit(1 << 30)), F.col("value_num")]
    return first_by(facts, ["security_code", "family", "dataset", "record_key", "field_key"], order)


GRAIN = ["security_code", "report_date", "field_key"]


def beside(rows: DataFrame, other: DataFrame, keys: list[str], cells: list[str], wider: list[str] | None = None, any_of: str | None = None) -> DataFrame:
    """rows with the cells of the row of `other`, which has one a key, that has their keys; null where none has.

    As a left join, but by windows over both, so tables that are dealt by the first key already aren't shuffled. any_of: a
    boolean column of rows that comes true where `other` has a row of the same `wider` keys, the first few of keys. Null keys
    match nothing.
    """
    own = rows.withColumn("b__own", F.lit(True))
    theirs = other.select(*[F.col(k).cast(rows.schema[k].dataType).alias(k) for k in keys], F.struct(*cells).alias("b__x")).withColumn("b__own", F.lit(False))
    both = own.unionByName(theirs, allowMissingColumns=True)
    known = lambda own: F.array_size(F.array_compact(F.array(*[F.col(k).cast("string") for k in own]))) == len(own)
    if any_of:
        both = both.withColumn(any_of, known(wider) & F.max(~F.col("b__own")).over(Window.partitionBy(*wider)))
    found = F.when(known(keys), F.first("b__x", ignorenulls=True).over(Window.partitionBy(*keys)))
    out = both.withColumn("b__x", found).filter("b__own")
    return out.select(*rows.columns, *[F.col(f"b__x.{c}").alias(c) for c in cells])


def _text_of(rows: DataFrame) -> Column:
    return F.col("value_text") if "value_text" in rows.columns else F.lit(None).cast("string")


def comparable_text(text: Column, key: Column) -> Column:
    """Plain text; fields of dates, report labels and security codes by what they mean."""
    t = plain_text(text)
    digits = F.regexp_replace(t, r"\D", "")
    return (
        F.when(key.isin("REPORT_DATE", "NOTICE_DATE", "PUBLISH_DATE", "UPDATE_DATE"), F.coalesce(date_of(F.lower(text)), t))
        .when(key.isin("REPORT_TYPE", "REPORT_DATE_NAME"), report_label(t))
        .when((key == "SECURITY_CODE") & (F.length(digits) >= 6), F.right(digits, F.lit(6)))
        .otherwise(t)
    )


def comparable_set(text: Column, key: Column) -> Column:
    """Different comparable texts of a list, sorted."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[,，;；、|\n]+"), lambda x: comparable_text(x, key))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def matched(facts: DataFrame, official: DataFrame) -> DataFrame:
    """facts (with mode and statement_type) and the official row that each is compared with, or a diagnosis.

    By security, date, period, statement and field; else, but for direct values of primary statements, by the same
    without the statement, but not for research expenses of the research family; derived finance expenses take the
    income statement's first. A consolidated value isn't compared with a parent company's: SCOPE_CONFLICT. If the field
    exists on the date for another period only: PERIOD_CONFLICT, but not for derived values and metadata. `loaded` tells whether
    there are official rows of the security and date at all.
    """
    best = F.struct((F.col("scope") == "parent").alias("parent"), F.col("statement_type").alias("st"), F.col("document_id").alias("doc"),
        F.col("value_num").alias("v"), F.col("unit").alias("u"), F.col("precision_tolerance").alias("tol"), _text_of(official).alias("t"), F.col("scope").alias("scope"))
    candidate = F.struct(F.col("period_type").alias("p"), F.col("statement_type").alias("s"), "b")
    # one official row a period and statement, the few of a field and date together, so that all three grains are one match
    one = official.groupBy(*GRAIN, "period_type", "statement_type").agg(F.min(best).alias("b"))
    of_each = one.groupBy(*GRAIN).agg(F.collect_list(candidate).alias("r__c"))
    out = beside(facts.withColumn("loaded", F.lit(False)), of_each, GRAIN, ["r__c"], ["security_code", "report_date"], "loaded")
    least = lambda hit: F.array_min(F.transform(F.filter("r__c", hit), lambda x: x["b"]))
    of_period = lambda x: x["p"] == F.col("period_type")
    out = out.withColumns({
        "o1": least(lambda x: of_period(x) & (x["s"] == F.col("statement_type"))), "o2": least(of_period),
        "o2i": least(lambda x: of_period(x) & (x["s"] == "income_statement")), "other_period": F.col("r__c").isNotNull(),
    }).drop("r__c")
    research = (F.col("family") == "RPT_F10_BUSINESS_RDEXPENSE") & (F.col("field_key") == "RESEARCH_EXPENSE")
    strict = (F.col("family").isin(*DIRECT) & (F.col("mode") == "OFFICIAL_DIRECT")) | research
    finance = (F.col("field_key") == "FINANCE_EXPENSE") & (F.col("mode") == "OFFICIAL_DERIVED")
    found = F.when(F.col("o1").isNotNull(), F.col("o1")).when(strict, None).when(finance & F.col("o2i").isNotNull(), F.col("o2i")).otherwise(F.col("o2"))
    out = out.withColumn("o", found)
    diagnosis = F.when(F.col("o.parent"), "SCOPE_CONFLICT").when(
        F.col("o").isNull() & ~strict & F.col("other_period") & ~F.col("mode").isin("OFFICIAL_DERIVED", "OFFICIAL_METADATA"), "PERIOD_CONFLICT"
    )
    ok = ~F.coalesce(F.col("o.parent"), F.lit(False))
    return out.withColumn("diagnosis", diagnosis).withColumn("o", F.when(ok, F.col("o"))).drop("o1", "o2", "o2i", "other_period")


def compared(pairs: DataFrame, official: DataFrame) -> DataFrame:
    """A status for each row of matched().

    By the method of the field's policy: numbers within their tolerance, dates, sets or texts. Numbers of which one is
    null are compared as texts. A text that only one side has is MISSING_EASTMONEY or MISSING_OFFICIAL, not a mismatch.
    """
    if "loaded" not in pairs.columns:
        there = official.select(F.col("security_code").alias("l__c"), F.col("report_date").alias("l__d"), F.lit(True).alias("loaded")).distinct()
        pairs = pairs.join(there, (F.col("security_code") == F.col("l__c")) & (F.col("report_date") == F.col("l__d")), "left").drop("l__c", "l__d")
    out = pairs
    a, b = scaled("value_num", "unit"), scaled(F.col("o.v"), F.col("o.u"))
    unit_a, unit_b = canonical_unit(F.coalesce("unit", F.lit(""))), canonical_unit(F.coalesce(F.col("o.u"), F.lit("")))
    blank = lambda u: F.lower(u).isin("", "文本", "text", "none")
    units = ~blank(unit_a) & ~blank(unit_b) & (unit_a != unit_b)
    absolute = F.coalesce(F.greatest("absolute", F.col("o.tol")), F.lit(0.0))
    allowed = F.greatest(absolute, F.greatest(F.abs(a), F.abs(b)) * F.coalesce("relative", F.lit(0.0)))
    derived = F.col("mode") == "OFFICIAL_DERIVED"
    method, key = F.col("method"), F.col("field_key")
    own, other = _text_of(pairs), F.col("o.t")
    text_a, text_b = comparable_text(own, key), comparable_text(other, key)
    date_a, date_b = F.coalesce(date_of(own), F.lit("")), F.coalesce(date_of(other), F.lit(""))
    set_a, set_b = comparable_set(own, key), comparable_set(other, key)
    same = lambda hit, status: F.when(hit, status).otherwise("MISMATCH")
    texts = (
        F.when(method == "date", same((date_a != "") & (date_a == date_b), "TEXT_MATCH_NORMALIZED"))
        .when(method == "set", same((F.size(set_a) > 0) & (set_a == set_b), "SET_MATCH"))
        .when((text_a == "") & (b.isNotNull() | (text_b != "")), "MISSING_EASTMONEY").when((text_a != "") & (text_b == "") & b.isNull(), "MISSING_OFFICIAL")
        .otherwise(same((text_a != "") & (text_a == text_b), "TEXT_MATCH_NORMALIZED"))
    )
    by_number = a.isNotNull() & b.isNotNull() & (~method.isin("date", "text", "set") | (derived & (method == "text")))
    numbers = (
        F.when(units, "UNIT_CONFLICT").when(a == b, F.when(derived, "DERIVED_MATCH").otherwise("EXACT_MATCH"))
        .when(F.abs(a - b) <= allowed, F.when(derived, "DERIVED_MATCH").otherwise("WITHIN_ROUNDING")).otherwise("MISMATCH")
    )
    verdict = F.when(by_number, numbers).otherwise(texts)
    status = (
        F.when(F.col("mode") == "NOT_IN_PERIODIC_REPORT_SCOPE", "NOT_IN_OFFICIAL_SCOPE")
        .when(F.col("mode") == "EASTMONEY_SOURCE_SPECIFIC", "SOURCE_SPECIFIC")
        .when(F.col("mode") == "FUTURE_FREE_SOURCE_REQUIRED", "FUTURE_FREE_SOURCE_REQUIRED")
        .when(~F.coalesce("loaded", F.lit(False)), "OFFICIAL_PERIOD_NOT_LOADED")
        .when(F.col("o").isNull(), F.coalesce("diagnosis", F.lit("MISSING_OFFICIAL")))
        .otherwise(verdict)
    )
    return out.withColumns({"status": status, "official_value": b, "difference": a - b}).drop("loaded")


IDENTITY = ["security_code", "report_date", "period_type", "statement_type", "scope", "field_key"]


def official_only(official: DataFrame, pairs: DataFrame) -> DataFrame:
    """Official rows that no row of matched() is compared with, as MISSING_EASTMONEY.

    A row is known by security, date, period, statement, scope and field; so a parent company's value, or one behind a
    conflict of scopes, stays where only the consolidated one is compared.
    """
    used = pairs.filter(F.col("o").isNotNull()).select("security_code", "report_date", "period_type", F.col("o.st").alias("statement_type"), F.col("o.scope").alias("scope"), "field_key").distinct()
    names = {c: f"o__{c}" for c in IDENTITY}
    used = used.withColumnsRenamed(names)
    on = [F.coalesce(official[c].cast("string"), F.lit("")) == F.coalesce(F.col(n).cast("string"), F.lit("")) for c, n in names.items()]
    rest = official.join(used, on, "left_anti")
    identity = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in IDENTITY], F.lit("OFFICIAL_ONLY"))
    return rest.withColumns({"comparison_key": identity, "status": F.lit("MISSING_EASTMONEY"), "verification_grade": F.lit("E"),
        "root_cause": F.lit("EASTMONEY_VALUE_MISSING")})


def summary(rows: DataFrame) -> DataFrame:
    """Counts and rates of a comparison for each security and for all (a null security); null where there is nothing to divide by."""
    s = F.col("status")
    n = lambda c: F.count_if(c)
    g = rows.rollup("security_code").agg(
        F.count(F.lit(1)).alias("compared"), n(~s.isin(*NOT_COMPARABLE)).alias("comparable"), n(s.isin(*MATCHES, *CONFLICTS)).alias("attempted"),
        n(s.isin(*MATCHES)).alias("matched"), n(s.isin(*CONFLICTS)).alias("conflicts"), n(s.isin(*UNRESOLVED)).alias("unresolved"),
        n(~s.isin(*NOT_COMPARABLE, "MISSING_OFFICIAL")).alias("observed"),
    )
    rate = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return g.withColumns(
        {"coverage": rate("attempted", "comparable"), "accuracy": rate("matched", "attempted"), "extraction": rate("observed", "comparable"),
            "unresolved_rate": rate("unresolved", "comparable")}
    )


# Statuses of values that no official report could give yet.
UNAVAILABLE = [
    "OFFICIAL_PERIOD_NOT_LOADED", "PRE_LISTING_OFFICIAL_SOURCE_NOT_LOADED", "OFFICIAL_DOCUMENT_EXTRACTION_FAILED", "POST_LISTING_OFFICIAL_REPORT_NOT_FOUND",
    "OFFICIAL_REPORT_SUMMARY_SCOPE_GAP", "OFFICIAL_REPORT_NOT_YET_DISCLOSED",
]
OUT_OF_SCOPE = ["NOT_IN_PERIODIC_REPORT_SCOPE", "EASTMONEY_SOURCE_SPECIFIC", "FUTURE_FREE_SOURCE_REQUIRED"]


def gap_groups(rows: DataFrame, entries: DataFrame) -> dict[str, DataFrame]:
    """Five counts of a comparison, nulls kept as groups: what is missing, unavailable, by status, of events, and what is out of scope."""
    s = F.col("status")
    counted = lambda df, *keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("fact_count"))
    event = rows.filter(F.col("report_date").isNull() & s.isin("MISSING_OFFICIAL", "MISSING_EASTMONEY", "UNRESOLVED"))
    return {
        "missing_official": counted(rows.filter(s.isin("MISSING_OFFICIAL", "UNRESOLVED")), "report_date", "period_type", "family", "field_key", "field_name_cn",
            "mode", "status"),
        "unavailable": counted(rows.filter(s.isin(*UNAVAILABLE)), "report_date", "period_type", "family", "mode", "status"),
        "by_status": counted(rows, "mode", "status"), "event_gaps": counted(event, "theme", "family", "dataset", "mode", "status"),
        "out_of_scope": entries.filter(F.col("mode").isin(*OUT_OF_SCOPE)),
    }


def status_groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status", "mode", "family").agg(F.count(F.lit(1)).alias("n"))


def identities(facts: DataFrame, rules: list[tuple] | None = None, groups: list[list[str]] | None = None) -> DataFrame:
    """(security_code, report_date, check_id, description, left, right, difference, tolerance, status) of accounting identities.

    rules as in functions.rules: PASS within the tolerance, else FAIL, UNRESOLVED where a needed side is missing. The tolerance
    is the widest of the fields that the identity's group has on that date (1 if they have none) times the rule's factor.
    Only reported values count, no calculated, suspect or unresolved ones; of several values of a field the greatest record's.
    """
    rules, groups = IDENTITIES if rules is None else rules, TOLERANCE_GROUPS if groups is None else groups
    fields = sorted({f for _, _, left, parts, _ in rules for f in [left, *[p[1] for p in parts]]})
    rows = facts.filter(F.col("field_key").isin(*fields) & F.col("value_num").isNotNull())
    if "source_status" in facts.columns:
        rows = rows.filter(~F.coalesce("source_status", F.lit("")).isin("FACT_CALCULATED", "PARSE_SUSPECT", "UNRESOLVED"))
    tolerance = F.coalesce(F.nullif("precision_tolerance", F.lit(0.0)), F.lit(1.0)) if "precision_tolerance" in facts.columns else F.lit(1.0)
    order = F.struct(*[F.col(c) for c in ("record_key", "value_num") if c in facts.columns])
    one = rows.withColumn("tol", tolerance.cast("double"))
    wide = one.groupBy("security_code", "report_date").pivot("field_key", fields).agg(F.max_by(F.struct("value_num", "tol"), order))
    v, tol = (lambda f: F.col(f"`{f}`.value_num")), (lambda f: F.col(f"`{f}`.tol"))
    each = []
    for name, text, left, parts, times in rules:
        own = {left, *[p[1] for p in parts]}
        group = next((g for g in groups if own <= set(g)), sorted(own))
        known = [f for f in group if f in fields]
        total = F.lit(0.0)
        for sign, f, needed in parts:
            total = total + sign * (v(f) if needed else F.coalesce(v(f), F.lit(0.0)))
        widest = F.coalesce(F.array_max(F.array(*map(tol, known))), F.lit(1.0)) * times
        gap = v(left) - total
        status = F.when(gap.isNull(), "UNRESOLVED").when(F.abs(gap) <= widest, "PASS").otherwise("FAIL")
        each.append(F.struct(F.lit(name).alias("check_id"), F.lit(text).alias("description"), v(left).alias("left_value"), total.alias("right_value"),
            gap.alias("difference"), widest.alias("tolerance"), status.alias("status")))
    return wide.select("security_code", "report_date", F.inline(F.array(*each)))


def note_as_amount(row: Column, value: Column, statement: Column) -> Column:
    """Whether the only number of a statement line is the number of a note: 七、29 after a label without amounts."""
    note = F.regexp_extract(F.trim(row), r"(?:附注\s*)?[一二三四五六七八九十百]+\s*[、.．]\s*(\d{1,3})(?:\s*[（(]\s*\d{1,3}\s*[）)])?\s*$", 1)
    before = F.regexp_replace(F.trim(row), r"(?:附注\s*)?[一二三四五六七八九十百]+\s*[、.．]\s*\d{1,3}(?:\s*[（(]\s*\d{1,3}\s*[）)])?\s*$", "")
    money = statement.isin("balance_sheet", "income_statement", "cash_flow", "summary")
    return F.coalesce(money & (note != "") & ~before.rlike(r"\d") & (F.abs(value - note.try_cast("double")) <= 1e-12), F.lit(False))
