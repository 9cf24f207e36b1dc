"""Research sections, entities, lifecycles and ledgers over facts, observations and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.priority import formula_priority, looked_up
from factloom.operators.documents import company_name
from factloom.operators.normalize import stable_id
from factloom.operators.timeseries import first_by

# Key order of the sections of a cash-flow statement.
CASH_FLOW_ENDS = ("NETPROFIT", "CCE_ADDNOTE")
# Keys of the supplement where a statement lacks one of its ends or has them the wrong way round.
SUPPLEMENT = [
    "NETPROFIT", "MINORITY_INTEREST", "ASSET_IMPAIRMENT", "FA_IR_DEPR", "OILGAS_BIOLOGY_DEPR", "IR_DEPR", "IA_AMORTIZE", "LPE_AMORTIZE",
    "DEFER_INCOME_AMORTIZE", "PREPAID_EXPENSE_REDUCE", "ACCRUED_EXPENSE_ADD", "DISPOSAL_LONGASSET_LOSS", "FA_SCRAP_LOSS", "FAIRVALUE_CHANGE_LOSS",
    "FINANCE_EXPENSE", "INVEST_LOSS", "DEFER_TAX", "DT_ASSET_REDUCE", "DT_LIAB_ADD", "PREDICT_LIAB_ADD", "INVENTORY_REDUCE", "OPERATE_RECE_REDUCE",
    "OPERATE_PAYABLE_ADD", "OTHER", "OPERATE_NETCASH_OTHERNOTE", "OPERATE_NETCASH_BALANCENOTE", "NETCASH_OPERATENOTE", "DEBT_TRANSFER_CAPITAL",
    "CONVERT_BOND_1YEAR", "FINLEASE_OBTAIN_FA", "UNINVOLVE_INVESTFIN_OTHER", "END_CASH", "BEGIN_CASH", "END_CASH_EQUIVALENTS", "BEGIN_CASH_EQUIVALENTS",
    "CCE_ADD_OTHERNOTE", "CCE_ADD_BALANCENOTE", "CCE_ADDNOTE", "USERIGHT_ASSET_AMORTIZE",
]


def best_field(facts: DataFrame, name: str) -> DataFrame:
    """The one row of each security that a field name means: exact key first, then latest, then family and dataset."""
    hit = facts.filter((F.col("field_key") == name) | (F.col("field_name_cn") == name))
    order = Window.partitionBy("security_code").orderBy((F.col("field_key") != name), F.desc("report_date"), formula_priority(), "family", "dataset")
    return hit.withColumn("r__n", F.row_number().over(order)).filter("r__n = 1").drop("r__n")


def united(frames: list[DataFrame], key: str) -> DataFrame:
    """All columns of all frames; of rows with one key, the one of the first frame."""
    out = None
    for k, df in enumerate(frames):
        df = df.withColumn("r__k", F.lit(k))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return first_by(out, [key], [F.col("r__k"), *[F.col(c) for c in out.columns if c not in (key, "r__k")]]).drop("r__k")


# Metrics that profit quality is derived from.
PARENT, ADJUSTED, OPERATING, CAPEX, RESEARCH, CAPITALIZED = (
    "financial.parent_net_profit", "profit_quality.adjusted_parent_net_profit", "cashflow.operating_cash_flow", "cashflow.capital_expenditure",
    "research.rd_investment", "research.capitalized_rd",
)
PERIOD_KEY = ["security_code", "report_date", "event_date", "period_type", "scope"]


def profit_quality(observations: DataFrame) -> DataFrame:
    """Five derived rows for each security, date, event, period and scope that has one of their metrics.

    Non-recurring amount and share, cash flow over adjusted profit, simplified free cash flow and the capitalised part of
    research, each with its formula, unit and the ids of its inputs (of observations that have observation_id). What lacks an
    input or divides by 0 is UNRESOLVED, never 0. Of several observations of one metric the greatest id counts.
    """
    metrics = [PARENT, ADJUSTED, OPERATING, CAPEX, RESEARCH, CAPITALIZED]
    key = [c for c in PERIOD_KEY if c in observations.columns]
    has = "observation_id" in observations.columns
    rows = observations.filter(F.col("metric_id").isin(*metrics)).withColumn("id", F.col("observation_id") if has else F.lit(None).cast("string"))
    wide = rows.groupBy(*key).pivot("metric_id", metrics).agg(F.max_by(F.struct("value_num", "id"), F.struct("id", "value_num")))
    v, i = (lambda m: F.col(f"`{m}`.value_num")), (lambda m: F.col(f"`{m}`.id"))
    gap = v(PARENT) - v(ADJUSTED)
    formulas = [
        ("profit_quality.non_recurring_amount_calculated", gap, "元", "parent_net_profit - adjusted_parent_net_profit", (PARENT, ADJUSTED)),
        ("profit_quality.non_recurring_share", F.try_divide(gap, F.abs(v(PARENT))) * 100, "%",
            "(parent_net_profit - adjusted_parent_net_profit) / abs(parent_net_profit)", (PARENT, ADJUSTED)),
        ("profit_quality.cfo_to_adjusted_profit", F.try_divide(v(OPERATING), v(ADJUSTED)), "x", "operating_cash_flow / adjusted_parent_net_profit", (OPERATING, ADJUSTED)),
        ("profit_quality.simplified_free_cash_flow", v(OPERATING) - v(CAPEX), "元", "operating_cash_flow - capital_expenditure", (OPERATING, CAPEX)),
        ("profit_quality.rd_capitalization_rate", F.try_divide(v(CAPITALIZED), v(RESEARCH)) * 100, "%", "capitalized_rd / rd_investment", (CAPITALIZED, RESEARCH)),
    ]
    each = [F.struct(F.lit(k).alias("metric_id"), x.alias("value_num"), F.lit(u).alias("unit"), F.lit(f).alias("formula"),
        F.array_compact(F.array(*map(i, of))).alias("input_ids")) for k, x, u, f, of in formulas]
    out = wide.select(*key, F.explode(F.array(*each)).alias("m")).select(*key, "m.*")
    return out.withColumn("status", F.when(F.col("value_num").isNull(), "UNRESOLVED").otherwise("FACT_CALCULATED"))


def segments(facts: DataFrame, name: str, revenue: str, cost: str) -> DataFrame:
    """One row for each record_key: the first name, revenue and cost by key patterns; profit and margin derived."""
    first = lambda pattern, col: F.min_by(F.when(F.col("field_key").rlike(pattern), F.col(col)),
        F.when(F.col("field_key").rlike(pattern), F.col("field_key"))).alias
    g = facts.groupBy("security_code", "record_key").agg(first(name, "value_text")("segment"), first(revenue, "value_num")("revenue"),
        first(cost, "value_num")("cost"))
    profit = F.col("revenue") - F.col("cost")
    return g.filter("segment is not null").withColumns({"profit": profit, "margin": F.try_divide(profit, F.col("revenue")) * 100})


def names_within(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name, ...) of names, of at least two characters, that stand in texts (id, text).

    A text is cut into its different runs of three neighbouring characters, once; a name is known by that of its runs which
    the fewest texts have, and is looked for only in texts with this run (names of two characters by pairs in the same way).
    So a text costs its length, whatever the lengths of the names, and a run that every text has is no name's key unless
    the name has no other.
    """
    asked = names.filter(F.length("name") >= 2).distinct()
    long = F.length("name") > 2
    return _with_runs(texts, asked.filter(long), 3).unionByName(_with_runs(texts, asked.filter(~long), 2))


def _with_runs(texts: DataFrame, names: DataFrame, size: int) -> DataFrame:
    runs = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))
    own = texts.filter("text is not null").withColumn("t__run", F.explode(runs(F.col("text"))))
    of_names = names.select("name").distinct().withColumn("t__run", F.explode(runs(F.col("name"))))
    wanted = of_names.select("t__run").distinct()
    frequent = own.join(wanted, "t__run", "left_semi").groupBy("t__run").agg(F.count(F.lit(1)).alias("t__n"))
    rarest = of_names.join(frequent, "t__run", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("t__n", F.lit(0)).alias("n"), "t__run")).alias("b"))
    keys = rarest.filter("b.n > 0").select("name", F.col("b.t__run").alias("t__run"))  # a run that no text has: neither has the name
    hits = own.join(keys, "t__run").filter(F.contains("text", F.col("name"))).select("id", "name")
    return hits.join(names, "name")


def entity_matches(mentions: DataFrame, profiles: DataFrame) -> DataFrame:
    """Which profile (security_code, legal_name, former_names, domain, short_name) a mention (id, text, domain, code) means.

    Rules in order: code, credit code (where both have a column credit_code), legal name, former name, domain, short name
    within the text. Names are compared without company suffixes and marks. Each rule is an equi-join; the last looks, by names_within, for whole
    short names in those texts that no other rule decided.
    """
    p = profiles
    keyed = lambda col, rank, rule: p.select(F.col(col).alias("k"), F.col("security_code").alias("found"), F.lit(rank).alias("rank"),
        F.lit(rule).alias("rule")).filter("k is not null and k != ''")
    former = p.select(F.explode("former_names").alias("k"), F.col("security_code").alias("found"), F.lit(2).alias("rank"), F.lit("FORMER_NAME").alias("rule"))
    by_name = keyed("legal_name", 1, "LEGAL_NAME").unionByName(former).withColumn("k", company_name(F.col("k"))).filter("k != ''")
    hits = (
        mentions.join(keyed("security_code", 0, "CODE"), F.col("code") == F.col("k"))
        .unionByName(mentions.join(by_name, company_name(F.col("text")) == F.col("k"))).unionByName(mentions.join(keyed("domain", 3, "DOMAIN"),
            F.col("domain") == F.col("k")))
    ).select("id", "found", "rank", "rule")
    if "credit_code" in mentions.columns and "credit_code" in p.columns:
        # between the security's code and its names
        credit = keyed("credit_code", 0, "CREDIT_CODE").withColumn("rank", F.lit(0.5)).withColumnRenamed("k", "r__k")
        hits = hits.unionByName(mentions.join(credit, F.col("credit_code") == F.col("r__k")).select("id", "found", "rank", "rule"))
    rest = mentions.join(hits.select("id").distinct(), "id", "left_anti")
    short = keyed("short_name", 4, "SHORT_NAME").filter(F.length("k") >= 2)
    within = names_within(rest.select("id", "text"), short.select(F.col("k").alias("name"), "found"))
    within = within.select("id", "found", F.lit(4).alias("rank"), F.lit("SHORT_NAME").alias("rule"))
    every = hits.unionByName(within.select("id", "found", "rank", "rule"))
    return every.groupBy("id").agg(F.min(F.struct("rank", "found", "rule")).alias("b")).select("id", F.col("b.found").alias("security_code"), "b.rule")


# Metadata of a report with its labels; markets of sources; and for each kind of report its periods, with what
# the report is called, how its name ends, and whether the period is derived.
METADATA = {"SECUCODE": "证券代码（含市场）", "SECURITY_CODE": "证券代码", "REPORT_DATE": "报告期", "REPORT_TYPE": "报告类型", "REPORT_DATE_NAME": "报告期名称",
    "NOTICE_DATE": "公告日期", "PUBLISH_DATE": "发布日期"}
MARKETS = {"SSE": ".SH", "SZSE": ".SZ", "CNINFO": ".SZ", "BSE": ".BJ"}
PERIODS = {
    "annual": [("FY", "年报", "年报", False), ("Q4", "四季度", "四季度", True)],
    "q1": [("Q1", "一季报", "一季报", False)],
    "half": [("H1", "中报", "中报", False), ("Q2", "二季度", "二季度", True)],
    "q3": [("Q3C", "三季报", "三季报", False), ("Q3", "三季度", "三季度", True)],
}


def metadata_facts(documents: DataFrame) -> DataFrame:
    """A fact for each document, period of its kind and metadata key that has a value.

    documents: security_code, report_date, publish_date, report_kind, source, title, url. A report of another kind has one
    period, by its month, and is called by its kind.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kind, date, published = text("report_kind"), F.substring(text("report_date"), 1, 10), F.substring(text("publish_date"), 1, 10)
    period = lambda a, b, c, d: F.struct(a.alias("period_type"), b.alias("report_type"), c.alias("suffix"), d.alias("calculated"))
    known = F.lit(None)
    for k, own in PERIODS.items():
        known = F.when(kind == k, F.array(*[period(*map(F.lit, x)) for x in own])).otherwise(known)
    by_month = looked_up(F.substring(date, 6, 2), {"03": "Q1", "06": "H1", "09": "Q3C", "12": "FY"}, "OTHER")
    market = looked_up(F.upper(F.coalesce(F.nullif(text("source"), F.lit("")), F.lit("OFFICIAL"))), MARKETS, "")
    periods = F.coalesce(known, F.array(period(by_month, kind, kind, F.lit(False))))
    plain = documents.select("report_date", text("security_code").alias("code"), date.alias("date"), published.alias("published"), market.alias("market"), text("title").alias("title"),
        text("url").alias("url"), periods.alias("periods"))
    rows = plain.select("*", F.inline("periods")).drop("periods")
    c = F.col
    values = {
        "SECUCODE": F.when(c("code") != "", F.concat("code", "market")), "SECURITY_CODE": c("code"), "REPORT_DATE": c("date"), "REPORT_TYPE": c("report_type"),
        "REPORT_DATE_NAME": F.concat(F.substring("date", 1, 4), "suffix"), "NOTICE_DATE": c("published"), "PUBLISH_DATE": c("published"),
    }
    each = [F.struct(F.lit(k).alias("field_key"), F.lit(METADATA[k]).alias("field_name_cn"), v.alias("value_text")) for k, v in values.items()]
    out = rows.select("*", F.inline(F.array(*each))).filter("value_text != ''")
    title, empty = c("title"), F.lit("")
    return out.select(
        c("code").alias("security_code"), F.lit("官方披露/报告元数据").alias("theme"), F.lit("OFFICIAL_DISCLOSURE").alias("family"),
        F.when(title == "", "官方报告").otherwise(title).alias("dataset"),
        F.concat_ws("|", "code", "date", F.lit("metadata"), "period_type", "field_key").alias("record_key"), "report_date",
        F.nullif(c("published"), empty).alias("event_date"), "period_type", F.lit("metadata").alias("statement_type"),
        F.lit("entity").alias("scope"), F.lit("metadata").alias("data_semantics"), "field_key", "field_name_cn",
        F.lit("PAGE_DISPLAY_FIELD").alias("field_category"), "value_text", F.lit(None).cast("double").alias("value_num"),
        empty.alias("unit"), empty.alias("normalized_unit"), c("url").alias("source_url"), title.alias("source_document"), F.lit(1).alias("source_page"),
        F.concat(F.lit("报告元数据："), "field_name_cn", F.lit("="), "value_text").alias("source_row"), F.lit(None).cast("double").alias("precision_tolerance"),
        F.lit("high").alias("confidence"), F.when(c("calculated"), "FACT_CALCULATED").otherwise("FACT_DIRECT").alias("source_status"),
    )


# Gates that only a person opens, what that person does, and what is at stake.
PERMISSION = ["HTTP_403", "JS_REQUIRED", "LOGIN_REQUIRED", "CAPTCHA_REQUIRED"]
ACTION = "Use a compliant browser session or provide an official export once; resume this source only."
IMPACT = "Official evidence from this source remains unavailable, but the overall task continues."
NO_MATCH_NOTE = "No exact entity match under the recorded search conditions; no negative fact inferred."


def document_status(attempts: DataFrame) -> DataFrame:
    """Status of a document for each attempt (security_code, source_id, access_status, matched, url, sha256, status_on_success, query, error).

    Without a match of the entity NO_MATCH; behind a gate PERMISSION_BLOCKED with the least that a person must do; not
    downloaded UNRESOLVED; else the status that a success has. The document's id depends on what was found.
    """
    access, matched = F.col("access_status"), F.coalesce("matched", F.lit(True))
    blocked, fine = access.isin(*PERMISSION), F.coalesce(access == "DOWNLOAD_OK", F.lit(False))
    status = F.when(~matched, "NO_MATCH").when(blocked, "PERMISSION_BLOCKED").when(~fine, "UNRESOLVED").otherwise(F.col("status_on_success"))
    found = F.when(~matched, "NO_MATCH").when(fine, F.col("sha256")).otherwise(access)
    about = F.when(~matched | blocked, F.col("query")).otherwise(F.col("url"))
    error = F.nullif("error", F.lit(""))
    notes = (
        F.when(~matched, NO_MATCH_NOTE).when(blocked, F.coalesce(error, F.lit("Permission or dynamic access gate detected; no automatic retry in this run.")))
        .when(~fine, F.coalesce(error, F.lit("Download did not complete."))).otherwise("")
    )
    return attempts.withColumns({
        "document_id": stable_id("doc", F.col("security_code"), F.col("source_id"), about, found, length=32), "status": status,
        "access_status": F.when(~matched, "NO_EXACT_HIT").otherwise(access), "minimum_human_action": F.when(matched & blocked, ACTION).otherwise(""),
        "impact_if_not_resolved": F.when(matched & blocked, IMPACT).otherwise(""), "raw_original_binary_saved": matched & fine, "notes": notes,
    })


def cash_flow_sections(records: DataFrame, of: str = "family") -> DataFrame:
    """Sections of the keys (record, position, key) of each statement by their order: from NETPROFIT to CCE_ADDNOTE
    supplement, the rest primary; YOY and QOQ by name.

    A key's position is its first one in any record; the two ends are those of the statement's own keys. A statement without
    both ends in this order has as supplement the keys that are known as such and those with NOTE.
    """
    first = records.groupBy(of, "key").agg(F.min("position").alias("position"))
    edge = lambda k: F.min(F.when(F.col("key") == k, F.col("position")))
    ends = first.groupBy(of).agg(edge(CASH_FLOW_ENDS[0]).alias("low"), edge(CASH_FLOW_ENDS[1]).alias("high"))
    by_order = F.coalesce(F.col("low") <= F.col("high"), F.lit(False))
    by_name = F.col("key").isin(*SUPPLEMENT) | F.contains("key", F.lit("NOTE"))
    within = F.when(by_order, F.col("position").between(F.col("low"), F.col("high"))).otherwise(by_name)
    section = F.when(F.endswith("key", F.lit("_YOY")), "yoy").when(F.endswith("key", F.lit("_QOQ")), "qoq").when(within, "supplement").otherwise("primary")
    return first.join(ends, of).select(of, "key", section.alias("section"))


def conservation(batches: DataFrame) -> DataFrame:
    """Batches whose requests don't equal their successes, failures and deferrals."""
    n = lambda s: F.count_if(F.col("status") == s)
    g = batches.groupBy("batch").agg(F.count(F.lit(1)).alias("requested"), n("SUCCESS").alias("success"), n("FAILED").alias("failed"),
        n("DEFERRED").alias("deferred"))
    return g.withColumn("conserved", F.col("requested") == F.col("success") + F.col("failed") + F.col("deferred"))


def flag_counts(rows: DataFrame) -> DataFrame:
    return rows.select("report_date", F.explode("flags").alias("flag")).groupBy("report_date", "flag").agg(F.count(F.lit(1)).alias("n"))


def with_evidence(observations: DataFrame, lineage: DataFrame, sources: DataFrame, condition: Column) -> DataFrame:
    """Observations of which some source fact fulfils a condition."""
    hit = lineage.join(sources.filter(condition), "source_fact_id", "left_semi")
    return observations.join(hit, "observation_id", "left_semi")


def with_issue(observations: DataFrame, lineage: DataFrame, sources: DataFrame, issue: str) -> DataFrame:
    """Observations with an issue: parse_suspect (some source is suspect), source_conflict, or unresolved (none is usable)."""
    if issue == "parse_suspect":
        return with_evidence(observations, lineage, sources, (F.col("source_status") == "PARSE_SUSPECT") | F.coalesce("quarantined", F.lit(False)))
    if issue == "source_conflict":
        return observations.filter("status = 'SOURCE_CONFLICT'")
    if issue == "unresolved":
        return observations.filter("status = 'UNRESOLVED' or usable = 0")
    raise ValueError(f"unknown issue: {issue}")
