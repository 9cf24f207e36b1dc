"""Request packages, source selection and batch reduction: contracts as rules, ledgers and verdicts as aggregations.

Batches and securities are rows, not folders: all batches are reduced at once, and a broken contract is a row of the
result (what, which rule), not an exception on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators.point_in_time import violations

# Families that a source key of a target field may come from, and their priorities.
INCOME = ["RPT_F10_FINANCE_GINCOME", "RPT_F10_FINANCE_GINCOMEQC"]
CASH_FLOW = ["RPT_F10_FINANCE_GCASHFLOW", "RPT_F10_FINANCE_GCASHFLOWQC"]
MAIN_FINANCE = ["RPT_F10_FINANCE_MAINFINADATA", "RPT_F10_QTR_MAINFINADATA"]
BALANCE = ["RPT_F10_FINANCE_GBALANCE"]
SOURCES = [
    (INCOME, ["OPERATE_INCOME", "TOTAL_OPERATE_INCOME", "OPERATE_COST", "TOTAL_OPERATE_COST", "DEDUCT_PARENT_NETPROFIT", "DEDU_PARENT_PROFIT"]),
    (MAIN_FINANCE, ["KCFJCXSYJLR"]),
    (CASH_FLOW, ["NETCASH_OPERATE", "CONSTRUCT_LONG_ASSET"]),
    (BALANCE, [
        "ACCOUNTS_RECE", "ACCOUNTS_RECEIVABLE", "INVENTORY", "CONTRACT_LIAB", "CONTRACT_LIABILITY", "CONTRACT_LIABILITIES", "INTEREST_BEARING_DEBT",
        "TOTAL_EQUITY", "TOTAL_EQUITY_PARENT", "TOTAL_ASSETS", "MONETARYFUNDS", "CASH_AND_DEPOSIT_CENTRAL_BANK", "SHORT_LOAN", "LONG_LOAN",
        "NONCURRENT_LIAB_1YEAR", "BOND_PAYABLE", "LEASE_LIAB",
    ]),
    (INCOME[:1], ["AUDIT_OPINION", "OPINION_TYPE", "AUDIT_RESULT"]),
]
STANDALONE = [INCOME[1], CASH_FLOW[1], MAIN_FINANCE[1]]
# Statuses of a security in a batch, and of a batch, that count as done, failed or put off.
DONE, FAILED, DEFERRED = ["COMPLETED", "COMPLETED_WITH_GAPS"], ["FAILED_RETRYABLE", "FAILED_TERMINAL", "BLOCKED"], ["DEFERRED_TIME_BUDGET"]
BATCH_DONE = ["PASS", "PASS_WITH_GAPS"]
# Exchanges and states of a request, tiers that a document's status needs.
EXCHANGES = ["SSE", "SZSE", "BSE"]
REQUEST_STATES = ["PENDING", "RETRY", "FAILED_RETRYABLE"]
DIRECT_TIERS = ["T0_STATUTORY", "T1_GOV_OFFICIAL", "T3_AUTHORIZED"]
SECONDARY_TIERS = ["T3_AUTHORIZED", "T4_SECONDARY"]


def canonical_sources(facts: DataFrame) -> DataFrame:
    """Facts of target fields from the families that may give them, with a value; basis and priority added, copies dropped.

    Ratio families reuse statement keys for percentages, so a key alone doesn't tell. Of equal facts one is left.
    """
    key, family = F.upper(F.coalesce("field_key", F.lit(""))), F.upper(F.coalesce("family", F.lit("")))
    allowed = F.lit(False)
    for families, keys in SOURCES:
        allowed = allowed | (key.isin(*keys) & family.isin(*families))
    some = F.col("value_num").isNotNull() | (F.trim("value_text") != "")
    rows = facts.filter(allowed & F.coalesce(some, F.lit(False))).withColumns({"field_key": key, "family": family})
    out = rows.withColumns({
        "period_basis": F.when(F.col("family").isin(*STANDALONE), "STANDALONE").otherwise("CUMULATIVE"),
        "source_priority": F.when(F.col("family").isin(*MAIN_FINANCE), 80).otherwise(100),
    })
    same = ["security_code", "family", "record_key", "report_date", "available_at", "period_basis", "field_key", "value_num", "value_text", "unit"]
    return out.dropDuplicates([c for c in same if c in out.columns])


def duplicate_resolution(candidates: DataFrame, key: list[str]) -> DataFrame:
    """For each key whose best candidates (rank 1 of column `tier`) differ in value: how many there are, and all of them as JSON.

    candidates: key, tier, field_key, value_num, value_text, available_at, source_url. Values differ by over a share of
    1e-10, or as trimmed texts where one has no number.
    """
    top = F.col("tier") == 1
    low, high = F.min(F.when(top, F.col("value_num"))), F.max(F.when(top, F.col("value_num")))
    each = F.struct("field_key", "value_num", "value_text", "available_at", "source_url")
    g = candidates.groupBy(*key).agg(
        low.alias("low"), high.alias("high"), F.count_if(top & F.col("value_num").isNotNull()).alias("numbers"), F.count_if(top).alias("best"),
        F.countDistinct(F.when(top, F.trim("value_text"))).alias("texts"), F.count(F.lit(1)).alias("candidate_count"),
            F.sort_array(F.collect_list(each)).alias("all"),
    )
    allowed = F.greatest(F.lit(1e-8), F.greatest(F.abs("low"), F.abs("high"), F.lit(1.0)) * 1e-10)
    differ = F.when(F.col("numbers") == F.col("best"), F.col("high") - F.col("low") > allowed).otherwise(F.col("texts") > 1)
    return g.filter(differ).select(*key, F.lit("CONFLICTING").alias("status"), "candidate_count", F.to_json("all").alias("candidate_values"))


def ledgers(stocks: DataFrame) -> DataFrame:
    """Securities of batches (batch_id, security_id, status, ...) with the ledger that each belongs in; OPEN isn't terminal."""
    s = F.col("status")
    return stocks.withColumn("ledger", F.when(s.isin(*DONE), "COMPLETED").when(s.isin(*FAILED), "FAILED").when(s.isin(*DEFERRED), "DEFERRED").otherwise("OPEN"))


def failure_gaps(stocks: DataFrame) -> DataFrame:
    """A gap of the whole security for each one that failed or was put off."""
    rows = ledgers(stocks).filter(F.col("ledger").isin("FAILED", "DEFERRED"))
    return rows.select("batch_id", "security_id", "status", F.coalesce(F.nullif("message", F.lit("")), F.nullif("error_code", F.lit("")),
        F.lit("batch stock did not complete")).alias("reason"))


def batch_reports(stocks: DataFrame, gaps: DataFrame) -> DataFrame:
    """A row for each batch: counts by ledger, whether they add up, gaps, and the batch's status. gaps: (batch_id, ...)."""
    n = lambda ledger: F.count_if(F.col("ledger") == ledger)
    g = ledgers(stocks).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("input_count"), n("COMPLETED").alias("successful_count"), n("FAILED").alias("failed_count"),
            n("DEFERRED").alias("deferred_count"),
        F.count_if(F.col("status").isin("FAILED_TERMINAL", "BLOCKED")).alias("terminal"),
            F.count_if(F.col("status") == "COMPLETED_WITH_GAPS").alias("with_gaps"),
    )
    out = g.join(gaps.groupBy("batch_id").agg(F.count(F.lit(1)).alias("data_gap_rows")), "batch_id", "left").fillna({"data_gap_rows": 0})
    c = F.col
    status = (
        F.when(c("terminal") > 0, "FAILED_TERMINAL").when(c("failed_count") + c("deferred_count") > 0, "FAILED_RECOVERABLE")
        .when((c("with_gaps") > 0) | (c("data_gap_rows") > 0), "PASS_WITH_GAPS").otherwise("PASS")
    )
    conserved = c("successful_count") + c("failed_count") + c("deferred_count") == c("input_count")
    return out.withColumns({"conserved": conserved, "status": status}).drop("terminal", "with_gaps")


def market_violations(batches: DataFrame, expected: DataFrame, completed: DataFrame, requested: DataFrame, formal: DataFrame, cutoff: Column) -> DataFrame:
    """(rule, id) of everything that keeps batches from being one full market.

    batches and expected: (batch_id, status, as_of_date, package_sha256, batch_sha256, n_failed), expected without status
    and count; completed and requested: (security_id); formal: rows (security_id, report_period, available_at).
    """
    want = expected.select("batch_id", *[F.col(c).alias(f"e__{c}") for c in ("as_of_date", "package_sha256", "batch_sha256")])
    n = batches.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    both = batches.join(want.withColumn("e__known", F.lit(True)), "batch_id", "left").join(n, "batch_id")
    of_batches = violations(both, ["batch_id"], {
        "DUPLICATE_BATCH": F.col("n") == 1, "UNKNOWN_BATCH": F.col("e__known"), "BATCH_NOT_SUCCESSFUL": F.col("status").isin(*BATCH_DONE),
        "CUTOFF_MISMATCH": F.col("e__known").isNull() | (F.col("as_of_date") == F.col("e__as_of_date")),
        "PACKAGE_HASH_MISMATCH": F.col("e__known").isNull() | (F.col("package_sha256") == F.col("e__package_sha256")),
        "BATCH_HASH_MISMATCH": F.col("e__known").isNull() | (F.col("batch_sha256") == F.col("e__batch_sha256")),
        "NONTERMINAL_SECURITIES": F.col("n_failed") == 0,
    }).select("rule", F.col("batch_id").alias("id")).distinct()
    named = lambda df, rule, c: df.select(F.lit(rule).alias("rule"), F.col(c).cast("string").alias("id"))
    absent = named(expected.join(batches, "batch_id", "left_anti"), "MISSING_BATCH", "batch_id")
    twice = named(completed.groupBy("security_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "DUPLICATE_SECURITY", "security_id")
    lost = named(requested.join(completed, "security_id", "left_anti").distinct(), "MISSING_SECURITY", "security_id")
    extra = named(completed.join(requested, "security_id", "left_anti").distinct(), "EXTRA_SECURITY", "security_id")
    keys = formal.groupBy("security_id", "report_period").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    key = named(keys.select(F.concat_ws("|", "security_id", "report_period").alias("k")), "DUPLICATE_KEY", "k")
    unknown = named(formal.filter("available_at is null"), "AVAILABLE_AT_MISSING", "security_id").distinct()
    future = named(formal.filter(F.col("available_at") > cutoff), "FUTURE_ROW", "security_id").distinct()
    out = of_batches
    for part in (absent, twice, lost, extra, key, unknown, future):
        out = out.unionByName(part)
    return out


def request_violations(rows: DataFrame, cutoff: Column, batch_size: int) -> DataFrame:
    """(security_id, rule) of request rows that break their contract; rules of whole batches have the batch as id."""
    of_security = Window.partitionBy("security_id")
    marked = rows.withColumn("p__n", F.count(F.lit(1)).over(of_security))
    c = F.col
    broken = violations(marked, ["security_id"], {
        "BATCH_ID_INVALID": c("batch_id").rlike(r"^B\d{3}$"),
        "EXCHANGE_MISMATCH": c("exchange").isin(*EXCHANGES) & (c("security_id") == F.concat_ws(".", "exchange", "code")),
        "SECURITY_ID_INVALID": c("code").rlike(r"^\d{6}$"),
        "NAME_BLANK": F.trim("name") != "",
        "ST_STANDARD_PATH": ~F.coalesce(c("name"), F.lit("")).rlike(r"(?i)^\s*\*?ST"),
        "CUTOFF_MISMATCH": c("request_through") == cutoff,
        "START_AFTER_CUTOFF": (c("request_annual_from") <= c("request_through")) & (c("request_quarterly_from") <= c("request_through")),
        "AVAILABLE_AT_NOT_REQUIRED": c("required_available_at"),
        "REQUEST_STATUS_INVALID": c("request_status").isin(*REQUEST_STATES),
        "DUPLICATE_SECURITY": c("p__n") == 1,
    }).distinct()
    large = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > batch_size)
    return broken.unionByName(large.select(F.col("batch_id").alias("security_id"), F.lit("BATCH_TOO_LARGE").alias("rule")))


def document_violations(documents: DataFrame) -> DataFrame:
    """(document_id, rule) of document rows that break the contract of their status."""
    c, some = F.col, lambda x: F.coalesce(F.col(x), F.lit("")) != ""
    unless = lambda status, ok: F.coalesce(c("status") != status, F.lit(True)) | ok
    return violations(documents, ["document_id"], {
        "FACT_DIRECT_TIER": unless("FACT_DIRECT", c("source_tier").isin(*DIRECT_TIERS)),
        "SECONDARY_TIER": unless("SECONDARY_SOURCE", c("source_tier").isin(*SECONDARY_TIERS)),
        "NO_MATCH_QUERY": unless("NO_MATCH", some("query") & some("search_scope")),
        "NO_MATCH_FILE": unless("NO_MATCH", F.coalesce("file_size_bytes", F.lit(0)) == 0),
        "BLOCKED_ACTION": unless("PERMISSION_BLOCKED", some("minimum_human_action")),
        "HASH_LENGTH": c("sha256").isNull() | (F.length("sha256") == 64),
    })


def index_failures(documents: DataFrame, files: DataFrame) -> DataFrame:
    """(document_id, failure) of a document index; files: document_id of those whose original is there."""
    some = lambda x: F.coalesce(F.col(x), F.lit("")) != ""
    there = documents.join(files.select("document_id", F.lit(True).alias("p__file")).distinct(), "document_id", "left")
    marked = there.withColumn("p__n", F.count(F.lit(1)).over(Window.partitionBy("document_id")))
    saved = F.coalesce("raw_original_binary_saved", F.lit(False))
    return violations(marked, ["document_id"], {
        "duplicate document_id": F.col("p__n") == 1,
        "missing downloaded source file or hash": ~saved | (F.coalesce("p__file", F.lit(False)) & some("sha256")),
        "NO_MATCH missing query": F.coalesce(F.col("status") != "NO_MATCH", F.lit(True)) | some("query"),
        "PERMISSION_BLOCKED missing action": F.coalesce(F.col("status") != "PERMISSION_BLOCKED", F.lit(True)) | some("minimum_human_action"),
    }).withColumnRenamed("rule", "failure").distinct()


SEARCHED = ["document_title", "source_url", "source_organization", "source_id", "pack_id", "status", "notes"]


def documents_found(documents: DataFrame, bodies: DataFrame, word: str, start: str | None = None, end: str | None = None, **equal: str) -> DataFrame:
    """Documents with a word in what is known of them, else in their parsed text (document_id, body); filters on columns and dates.

    Only documents that don't have the word in their own columns look at a body, and of bodies only those with the word move.
    """
    needle = F.lit(word.strip().lower())
    rows = documents
    for column, value in equal.items():
        rows = rows.filter(F.col(column) == value)
    dated = [F.col(c) for c in ("publish_date", "report_period", "retrieved_at_utc") if c in rows.columns]
    date = F.substring(F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in dated], F.lit("")), 1, 10)
    rows = rows.filter(date >= start) if start else rows
    rows = rows.filter(date <= end) if end else rows
    known = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in SEARCHED if c in rows.columns]))
    own = rows.filter(F.contains(known, needle))
    rest = rows.filter(~F.contains(known, needle))
    hits = bodies.filter(F.contains(F.lower("body"), needle)).select("document_id")
    return own.unionByName(rest.join(hits, "document_id", "left_semi"))


def evidence_stats(documents: DataFrame) -> DataFrame:
    """(kind, value, n): documents by status, tier and pack, saved files and parsed texts, and all; one pass, nulls kept."""
    kinds = [("status", F.col("status")), ("source_tier", F.col("source_tier")), ("pack", F.col("pack_id")), ("all", F.lit("documents"))]
    kinds += [("saved", F.when(F.col("raw_original_binary_saved"), F.lit("files"))), ("parsed", F.when(F.col("parsed_text_saved"), F.lit("texts")))]
    each = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds]),
        lambda x: ~x["kind"].isin("saved", "parsed") | x["value"].isNotNull())
    return documents.select(F.explode(each).alias("k")).groupBy("k.kind", "k.value").agg(F.count(F.lit(1)).alias("n"))
