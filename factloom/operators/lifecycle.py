"""What a report date is for a security: listed or not, reported, summarised, extracted, missing or still to come.

One row of states for each security and date, from sets of dates and windows over the security; the comparison is relabelled
by it, and its period table shows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.priority import looked_up
from factloom.operators.normalize import listing_date

# Keys that are listing dates, and which family is asked first.
LISTING_KEYS = ["LISTING_DATE", "LIST_DATE", "LISTED_DATE", "A_LIST_DATE", "A_SHARE_LISTING_DATE", "LISTINGDATE", "LISTDATE"]
LISTING_PRIORITY = {"RPT_F10_ORG_BASICINFO": 0, "RPT_F10_BASIC_ORGINFO": 0, "RPT_PCF10_ORG_ISSUEINFO": 1}
# New status, its grade and its note.
PRE_LISTING = ("PRE_LISTING_OFFICIAL_SOURCE_NOT_LOADED", "N/A",
    "该期间早于证券上市日期，不存在同代码上市公司定期报告；应由招股说明书或发行上市申报文件验证，当前不判为来源冲突")
SUMMARY = ("OFFICIAL_REPORT_SUMMARY_SCOPE_GAP", "N/A", "官方旧版季度报告仅披露主要财务数据摘要，不包含完整三张报表；摘要未直接披露的项目不参与一致性判断")
PENDING = ("OFFICIAL_REPORT_NOT_YET_DISCLOSED", "N/A", "该报告期晚于最新已披露官方报告期，报告尚未公开，不参与一致性判断")
ZERO = ("OFFICIAL_DOCUMENT_EXTRACTION_FAILED", "E", "官方定期报告已发现并下载，但当前解析器未提取到可比事实")
MISSING = ("POST_LISTING_OFFICIAL_REPORT_NOT_FOUND", "E", "证券已上市且该期间理论上应有定期报告，但官方查询未发现对应文件")


def listing_dates(facts: DataFrame) -> DataFrame:
    """(security_code, listed, listing_date_source): the earliest date of the first family that has one, from keys that say so.

    A key is one if, in capitals and with underscores, it is known as one or has LIST and DATE, but not DELIST. The date is
    that of the text, else of the number.
    """
    key = F.regexp_replace(F.regexp_replace(F.upper("field_key"), "[^A-Z0-9]", "_"), "^_+|_+$", "")
    says = key.isin(*LISTING_KEYS) | F.contains(key, F.lit("LIST")) & F.contains(key, F.lit("DATE")) & ~F.contains(key, F.lit("DELIST"))
    date = F.coalesce(listing_date(F.col("value_text")), listing_date(F.col("value_num").cast("decimal(20,0)").cast("string")))
    rows = facts.filter(says).withColumn("listed", date).filter("listed is not null")
    source = F.concat(F.lit("EASTMONEY:"), F.coalesce("family", F.lit("")), F.lit(":"), "field_key")
    order = F.struct(looked_up("family", LISTING_PRIORITY, 100).alias("p"), F.col("listed").alias("d"), source.alias("s"))
    best = rows.groupBy("security_code").agg(F.min(order).alias("b"))
    return best.select("security_code", F.col("b.d").alias("listed"), F.col("b.s").alias("listing_date_source"))


def period_states(requested: DataFrame, listed: DataFrame, documents: DataFrame) -> DataFrame:
    """A row for each security and date that is requested or has a report, with what is known of it.

    requested: security_code, report_date; listed: security_code, listed, listing_date_source; documents: security_code,
    report_date, scope, extracted. latest_available is the security's latest report. A requested date from the listing on
    (any, if that isn't known) without a report is pending after that, else missing; the first of them is the transition
    where it lies in the year of the listing.
    """
    key = ["security_code", "report_date"]
    reports = documents.groupBy(*key).agg(F.max(F.col("scope") == "SUMMARY_ONLY").alias("summary"), F.sum("extracted").alias("extracted"))
    # both by one aggregation on their key; a null in it matches nothing
    one = requested.select(*key).distinct().withColumn("requested", F.lit(True)).unionByName(reports.withColumn("available", F.lit(True)), allowMissingColumns=True)
    apart = F.when(F.col("security_code").isNull() | F.col("report_date").isNull(), F.col("requested").isNull())
    both = one.groupBy(*key, apart.alias("y__apart")).agg(*[F.max(c).alias(c) for c in ("requested", "summary", "extracted", "available")]).drop("y__apart")
    both = both.join(listed.select("security_code", "listed", "listing_date_source"), "security_code", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    asked, there = yes(F.col("requested")), yes(F.col("available"))
    before = yes(F.col("report_date") < F.col("listed"))
    of = Window.partitionBy("security_code")
    latest = F.max(F.when(there, F.col("report_date"))).over(of)
    first = F.min(F.when(asked & ~before, F.col("report_date"))).over(of)
    absent = asked & ~before & ~there
    later = yes(F.col("report_date") > latest)
    summary = yes(F.col("summary"))
    return both.select(
        *key, "listed", "listing_date_source", asked.alias("requested"), there.alias("available"), F.coalesce("extracted", F.lit(0)).cast("long").alias("extracted"),
        (asked & before).alias("pre_listing"), yes(asked & ~before & (F.col("report_date") == first) & (F.year("report_date") == F.year("listed"))).alias("transition"),
        summary.alias("summary_only"), (there & ~summary & (F.col("extracted") == 0)).alias("zero_extraction"), (absent & later).alias("pending"),
        (absent & ~later).alias("post_listing_missing"), latest.alias("latest_available"),
    )


def period_table(states: DataFrame) -> DataFrame:
    """(security_code, listing_date, source, report_date, period_class, coverage_status, found, facts) of requested dates."""
    c = F.col
    reported = lambda rest: F.when(c("summary_only"), SUMMARY[0]).when(c("zero_extraction"), ZERO[0]).otherwise(rest)
    there = F.when(c("available"), "AVAILABLE")
    kind = (
        F.when(c("pre_listing"), "PRE_LISTING_PERIOD").when(c("transition"), "LISTING_TRANSITION_PERIOD")
        .when(c("pending"), "POST_LISTING_PERIOD_NOT_YET_DISCLOSED").otherwise("POST_LISTING_PERIODIC_EXPECTED")
    )
    coverage = (
        F.when(c("pre_listing"), PRE_LISTING[0]).when(c("transition"), reported(there.otherwise(MISSING[0]))).when(c("pending"), PENDING[0])
        .otherwise(reported(F.when(c("post_listing_missing"), MISSING[0]).when(c("available"), "AVAILABLE").otherwise("UNRESOLVED")))
    )
    return states.filter("requested").select(
        "security_code", c("listed").alias("listing_date"), F.coalesce("listing_date_source", F.lit("")).alias("listing_date_source"), "report_date",
        kind.alias("period_class"), coverage.alias("coverage_status"), c("available").alias("official_document_found"),
        c("extracted").alias("extracted_fact_count"),
    )


def relabelled(rows: DataFrame, states: DataFrame) -> DataFrame:
    """Compared rows with the statuses that their dates explain, with a grade and a note.

    In order: before the listing, summaries only, later than the latest report, nothing extracted, no report found; each from
    the statuses of absent official values, the first from a conflict of periods too. Rows of dates that no one asked for can
    be later than the latest report as well.
    """
    flags = ["pre_listing", "summary_only", "zero_extraction", "post_listing_missing"]
    # windows over both tables instead of joins, first of the security and then of its dates, so tables dealt by it stay where they are
    of_date = states.select("security_code", F.col("report_date").cast(rows.schema["report_date"].dataType).alias("report_date"), F.col("latest_available").alias("z__latest"), F.struct(*[F.col(x).alias(f"y__{x}") for x in flags]).alias("y__x"))
    both = rows.withColumn("y__own", F.lit(True)).unionByName(of_date.withColumn("y__own", F.lit(False)), allowMissingColumns=True)
    known, dated = F.col("security_code").isNotNull(), F.col("report_date").isNotNull()
    both = both.withColumn("z__latest", F.when(known, F.max("z__latest").over(Window.partitionBy("security_code"))))
    both = both.withColumn("y__x", F.when(known & dated, F.first("y__x", ignorenulls=True).over(Window.partitionBy("security_code", "report_date"))))
    out = both.filter("y__own").select(*rows.columns, "z__latest", "y__x.*")
    is_ = lambda x: F.coalesce(F.col(f"y__{x}"), F.lit(False))
    status = F.col("status")
    not_loaded = status == "OFFICIAL_PERIOD_NOT_LOADED"
    gap = not_loaded | (status == "MISSING_OFFICIAL")
    late = ~is_("post_listing_missing") & F.coalesce(F.col("report_date") > F.col("z__latest"), F.lit(False))
    rules = [
        (is_("pre_listing") & (gap | (status == "PERIOD_CONFLICT")), PRE_LISTING), (is_("summary_only") & gap, SUMMARY), (late & not_loaded, PENDING),
        (is_("zero_extraction") & gap, ZERO), (is_("post_listing_missing") & gap, MISSING),
    ]

    def by_rule(k: int, old: Column) -> Column:
        new = F.when(rules[0][0], rules[0][1][k])
        for hit, said in rules[1:]:
            new = new.when(hit, said[k])
        return new.otherwise(old)

    old = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    new = {"status": by_rule(0, status), "verification_grade": by_rule(1, old("verification_grade")), "notes": by_rule(2, old("notes"))}
    return out.withColumns(new).drop("z__latest", *[f"y__{x}" for x in flags])
