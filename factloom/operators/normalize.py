"""From semi-structured records to typed, dated, labelled facts: all as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Keys that date an event, and keys that tell when a fact was published, in order of preference.
DATE_KEYS = [
    "REPORT_DATE", "END_DATE", "TRADE_DATE", "NOTICE_DATE", "PUBLISH_DATE", "UPDATE_DATE", "report_date", "notice_date", "publish_time", "showDateTime",
]
AVAILABILITY_KEYS = [
    "NOTICE_DATE", "PUBLISH_DATE", "UPDATE_DATE", "ANNOUNCEMENT_DATE", "DISCLOSURE_DATE", "notice_date", "publish_date", "publish_time", "display_time",
]
# Keys that tell records of one date apart, keys of codes and of names, names that say nothing, and the
# order of families that name a security.
DISCRIMINATORS = ["art_code", "INFO_CODE", "MXID", "HOLDER_RANK", "RANK", "PERSON_CODE"]
CODE_KEYS = ["SECURITY_CODE", "SECUCODE", "SECURITYCODE", "SECURITY_CODE_A", "f57", "code", "secucode", "security_code"]
NAME_KEYS = ["SECURITY_NAME_ABBR", "f58", "SECURITY_NAME", "SECURITY_NAME_A", "short_name", "ORG_NAME_ABBR", "name"]
INVALID_NAMES = ["", "名称获取中", "证券名称", "股票名称", "None", "null", "--", "-"]
NAME_FAMILIES = {"/api/qt/stock/get": 0, "RPT_F10_ORG_BASICINFO": 1, "RPT_HSF9_BASIC_ORGINFO": 2, "PageAjax": 3}
# Families of flows and of balances.
FLOW_FAMILIES = [
    "RPT_F10_FINANCE_GINCOME", "RPT_F10_FINANCE_GINCOMEQC", "RPT_F10_FINANCE_GCASHFLOW", "RPT_F10_FINANCE_GCASHFLOWQC",
    "RPT_F10_FINANCE_MAINFINADATA", "RPT_F10_QTR_MAINFINADATA", "RPT_F10_FINANCE_GRATIO", "RPT_F10_FINANCE_QGRATIO",
]
POINT_FAMILIES = ["RPT_F10_FINANCE_GBALANCE", "RPT_F10_EH_HOLDERNUM", "RPT_F10_EH_HOLDERS", "RPT_F10_EH_FREEHOLDERS", "RPT_F10_EH_EQUITY"]


def json_text(text: Column) -> Column:
    """The JSON in a text that may wrap it in a call: from the first opening bracket to the last closing one."""
    return F.regexp_extract(text, r"(?s)([{\[].*[}\]])", 1)


def decoded(text: Column) -> Column:
    """JSON or JSONP as a variant; null where it is neither."""
    return F.try_parse_json(json_text(text))


def at_path(value: Column, path: str) -> Column:
    """The variant at a dotted path with optional [i]."""
    return F.try_variant_get(value, f"$.{path}" if path else "$", "variant")


def records_at(rows: DataFrame, value: str, path: str) -> DataFrame:
    """A row for each record at a path: a list gives its elements, an object one row, anything else none."""
    found = rows.withColumn("n__v", at_path(F.col(value), path))
    listed = F.try_variant_get("n__v", "$", "array<variant>")
    kind = F.schema_of_variant("n__v")
    each = F.when(F.startswith(kind, F.lit("ARRAY")), listed).when(F.startswith(kind, F.lit("OBJECT")), F.array("n__v"))
    return found.select(*rows.columns, F.posexplode(each).alias("ordinal", "record")).drop(value)


def date_of(text: Column) -> Column:
    """A date as ISO text: numbers over 1e10 are milliseconds, others seconds; text is parsed, else its first ten characters."""
    t = F.trim(text)
    number = F.try_to_number(t, F.lit("99999999999999")).cast("double")
    number = F.when(t.rlike(r"^\d{9,14}$"), number)
    from_number = F.date_format(F.timestamp_seconds(F.when(number > 1e10, number / 1000).otherwise(number)), "yyyy-MM-dd")
    iso = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1)
    compact = F.when(t.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)))
    slashed = F.when(t.rlike(r"^\d{4}/\d{1,2}/\d{1,2}"), F.date_format(F.try_to_date(F.substring_index(t, " ", 1), "yyyy/M/d"), "yyyy-MM-dd"))
    parsed = F.date_format(F.try_to_date(F.coalesce(F.nullif(iso, F.lit("")), compact, F.lit("")), "yyyy-MM-dd"), "yyyy-MM-dd")
    return F.when((text.isNull()) | (t == ""), None).otherwise(F.coalesce(from_number, parsed, slashed, F.substring(t, 1, 10)))


def number_of(text: Column) -> Column:
    """The number in a text, commas left out; not for what isn't finite."""
    return finite(F.replace(text, F.lit(","), F.lit("")).try_cast("double"))


def finite(n: Column) -> Column:
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def first_of(keys: list[str], fields: Column) -> Column:
    """The first value of a map that isn't empty, by an order of keys."""
    return F.coalesce(*[F.nullif(F.try_element_at(fields, F.lit(k)), F.lit("")) for k in keys])


def period_type(explicit: Column, date: Column) -> Column:
    """An explicit label, else by the month of the ISO date; no date is an event."""
    month = F.substring(date, 6, 2)
    by_month = F.when(month == "03", "Q1").when(month == "06", "Q2").when(month == "09", "Q3").when(month == "12", "FY").otherwise("OTHER")
    return F.when(F.trim(explicit) != "", F.trim(explicit)).when(F.coalesce(date, F.lit("")) == "", "EVENT").otherwise(by_month)


def canonical_period(date: Column, family: Column, explicit: Column, independent_families: list[str]) -> Column:
    """Q1, H1, Q3C and FY for running totals, Q1 to Q4 for independent quarters, by label or month."""
    label, month = F.upper(F.trim(F.coalesce(explicit, F.lit("")))), F.substring(date, 6, 2)
    has = lambda *tokens: F.reduce(F.array(*[F.contains(label, F.lit(t)) for t in tokens]), F.lit(False), lambda a, b: a | b)
    alone = family.isin(*independent_families)
    return (
        F.when(has("一季度", "一季报", "Q1") | (month == "03"), "Q1")
        .when(alone & (has("二季度", "Q2") | (month == "06")), "Q2")
        .when(alone & (has("三季度", "Q3") | (month == "09")), "Q3")
        .when(alone & (has("四季度", "Q4") | (month == "12")), "Q4")
        .when(has("半年", "中报", "H1") | (month == "06"), "H1")
        .when(has("三季报", "前三季度", "Q3C") | (month == "09"), "Q3C")
        .when(has("年报", "年度", "FY") | (month == "12"), "FY")
        .otherwise(F.coalesce(F.nullif(label, F.lit("")), F.lit("OTHER")))
    )


def semantics(family: Column) -> Column:
    return F.when(family.isin(*FLOW_FAMILIES), "flow").when(family.isin(*POINT_FAMILIES), "point_in_time").otherwise("event_or_static")


def facts_of(records: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each key of each record (a variant column `record`), but for private keys; nested values stay JSON text."""
    both = records.lateralJoin(records.sparkSession.tvf.variant_explode(F.col("record").outer()))
    public = ~F.startswith("key", F.lit("_")) | F.col("key").isin("_SOURCE_URL", "_FETCHED_AT_UTC")
    # kind before text before number, each made once
    kinds = both.filter(public).select(*keep, F.col("key").alias("field_key"), "value", F.schema_of_variant("value").alias("n__kind"))
    nested = F.col("n__kind").rlike("^(ARRAY|OBJECT)")
    text = F.when(nested, F.to_json("value")).otherwise(F.try_variant_get("value", "$", "string"))
    texts = kinds.select(*keep, "field_key", "n__kind", text.alias("value_text"))
    parsed = F.when(~nested, F.replace("value_text", F.lit(","), F.lit("")).try_cast("double"))
    truth = F.when(F.col("n__kind") == "BOOLEAN", (F.col("value_text") == "true").cast("double"))
    numbers = texts.select(*keep, "field_key", "value_text", F.coalesce(truth, parsed).alias("n__n"))
    return numbers.select(*keep, "field_key", "value_text", finite(F.col("n__n")).alias("value_num"))


def record_key(code: Column, family: Column, date: Column, *parts: Column) -> Column:
    return F.concat_ws("|", code, family, date, *[F.nullif(p, F.lit("")) for p in parts])


def deduplicated(records: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The first of equal records within keys, by a digest of their JSON with sorted keys (a variant sorts them)."""
    marked = records.withColumn("n__h", F.sha2(F.to_json(value), 256))
    first = Window.partitionBy(*keys, "n__h").orderBy(*order)
    return marked.withColumn("n__r", F.row_number().over(first)).filter("n__r = 1").drop("n__h", "n__r")


def layered(patches: DataFrame) -> DataFrame:
    """One entry a key from (key, label, unit, category, layer): the last layer wins."""
    best = F.max_by(F.struct("label", "unit", "category"), "layer").alias("e")
    return patches.groupBy("key").agg(best).select("key", "e.*")


def labelled(facts: DataFrame, general: DataFrame, context: DataFrame) -> DataFrame:
    """Label, unit and category of each fact: of its context before of its key, the key itself where neither is known.

    Both dictionaries are as large as the number of field contexts; Spark picks the join by their measured size.
    """
    c = context.select(*[F.col(x).alias(f"c__{x}") for x in context.columns])
    g = general.select(*[F.col(x).alias(f"g__{x}") for x in general.columns])
    on = F.concat_ws("|", "theme", "family", "dataset", "field_key") == F.col("c__key")
    out = facts.join(c, on, "left").join(g, facts["field_key"] == F.col("g__key"), "left")
    pick = lambda n, other: F.coalesce(f"c__{n}", f"g__{n}", other).alias(n)
    return out.select(*facts.columns, pick("label", F.col("field_key")), pick("unit", F.lit("")), pick("category", F.lit("PAGE_DISPLAY_FIELD")))


def pages_audit(pages: DataFrame) -> DataFrame:
    """Expected pages of each request (explicit number, or total over page size) against the pages that are there."""
    want = F.greatest(F.coalesce("pages", F.lit(1)), F.coalesce(F.ceil(F.col("total") / F.col("page_size")), F.lit(1)))
    g = pages.groupBy("request").agg(F.max(want).alias("expected"), F.countDistinct("page").alias("present"))
    return g.withColumn("complete", F.col("present") >= F.col("expected"))


def record_sets(records: DataFrame, expected: list[str], share: float = 0.7) -> DataFrame:
    """Of (group_id, key, ok): whether enough of the expected keys occur and all payloads are fine."""
    g = records.groupBy("group_id").agg(F.collect_set(F.when(F.col("key").isin(*expected), F.col("key"))).alias("seen"), F.bool_and("ok").alias("ok"))
    return g.select("group_id", (F.size("seen") / len(expected)).alias("coverage"), ((F.size("seen") >= share * len(expected)) & F.col("ok")).alias("accepted"))


def count_violations(groups: DataFrame) -> DataFrame:
    """(group_id, record_count, n_records) of groups that say they have another number of records than they have."""
    return groups.filter(F.col("record_count").isNotNull() & (F.col("record_count") != F.col("n_records"))).select("group_id", "record_count", "n_records")


def best_copies(groups: DataFrame) -> DataFrame:
    """One copy of each group_id: count right, success, most records, most payloads, first on ties."""
    rank = F.struct(F.col("record_count") == F.col("n_records"), F.col("success"), F.col("n_records"), F.col("n_payloads"), -F.col("ordinal"))
    return groups.groupBy("group_id").agg(F.max_by(F.struct("success", "n_records", "n_payloads", "ordinal"), rank).alias("b")).select("group_id", "b.*")


def parsed_code(code: Column) -> Column:
    """Exchange, code with exchange, page code and market of a six-digit security code; null fields where it is none."""
    digits = F.regexp_replace(F.trim(code), r"\D", "")
    ok = digits.rlike(r"^\d{6}$")
    exchange = F.when(digits.rlike("^(4|8|92)"), "BJ").when(digits.rlike("^[0123]"), "SZ").otherwise("SH")
    market = F.when(exchange == "SH", 1).otherwise(0)
    when = lambda x: F.when(ok, x)
    return F.struct(
        when(digits).alias("code"), when(exchange).alias("exchange"), when(F.concat_ws(".", digits, exchange)).alias("secucode"),
        when(F.concat(exchange, digits)).alias("page_code"), when(market).alias("market_id"),
    )


def standard_code(text: Column) -> Column:
    """688521, 688521.SH, SH688521 and 1.688521 as 688521.SH."""
    raw = F.upper(F.trim(text))
    bare = F.regexp_extract(raw, r"^(?:[01]\.|SH|SZ|BJ)?(\d{6})(?:\.(?:SH|SZ|BJ))?$", 1)
    return parsed_code(bare)["secucode"]


def security_digits(text: Column) -> Column:
    """The six digits of a code: a part of six between dots, the last six after an exchange, else the last six of all digits."""
    t = F.upper(F.trim(text))
    dotted = F.get(F.reverse(F.filter(F.split(t, r"\."), lambda x: x.rlike(r"^\d{6}$"))), 0)
    prefixed = F.nullif(F.regexp_extract(t, r"^(?:SH|SZ|BJ).*?(\d{6})$", 1), F.lit(""))
    digits = F.regexp_replace(t, r"\D", "")
    return F.coalesce(dotted, prefixed, F.when(F.length(digits) >= 6, F.right(digits, F.lit(6))))


def valid_name(text: Column, code: Column) -> Column:
    """A name, unless it is empty, a placeholder, a code or over 80 characters."""
    t = F.trim(text)
    bad = t.isin(*INVALID_NAMES) | (t == code) | t.rlike(r"\.(SH|SZ|BJ)$") | t.rlike(r"^\d+$") | (F.length(t) > 80)
    return F.when(~bad, t)


def plain_text(text: Column) -> Column:
    """Lower case, no white space, half-width brackets and commas."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[\s　]+", "")
    return F.translate(t, "（），", "(),")


# Words of report labels, tried in this order.
REPORT_LABELS = [
    ("q4", ["四季度", "第4季度", "第四季度", "q4"]),
    ("q3", ["三季度", "第3季度", "第三季度", "q3"]),
    ("q2", ["二季度", "第2季度", "第二季度", "q2"]),
    ("q1", ["一季度", "第1季度", "第一季度", "一季报", "q1"]),
    ("h1", ["半年度", "半年报", "中报", "h1"]),
    ("q3c", ["三季报", "前三季度", "q3c"]),
    ("fy", ["年度报告", "年报", "年度", "fy"]),
]


def report_label(text: Column) -> Column:
    out = None
    for name, words in REPORT_LABELS:
        hit = text.rlike("|".join(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(text)


def set_of(text: Column) -> Column:
    """Different plain values of a list in text, sorted."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[,，;；、|\n]+"), plain_text)
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def stable_id(prefix: str, *parts: Column, length: int = 24) -> Column:
    """prefix and a digest of the parts, joined by |; a null part is empty."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(text, 256), 1, length))


def language_tag(text: Column) -> Column:
    zh, en = text.rlike(r"[一-鿿]"), text.rlike("[A-Za-z]")
    return F.when(zh & en, "mixed").when(zh, "zh").when(en, "en").otherwise("unknown")


def listing_date(text: Column) -> Column:
    """An explicit date: year, month and day with any of the usual separators, or eight digits."""
    t = F.translate(F.regexp_replace(F.trim(text), "日", ""), "年月/.", "----")
    found = F.regexp_extract(t, r"((?:19|20)\d{2}-(?:1[0-2]|0?[1-9])-(?:3[01]|[12]\d|0?[1-9]))", 1)
    digits = F.regexp_replace(t, r"\D", "")
    eight = F.when(F.length(digits) >= 8, F.try_to_date(F.substring(digits, 1, 8), "yyyyMMdd"))
    return F.when(found != "", F.try_to_date(found, "yyyy-M-d")).otherwise(eight)


def forbidden_characters(rows: DataFrame, text: str) -> DataFrame:
    """Counts of the control characters that spreadsheets forbid, by code point; clean(text) leaves them out."""
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"([\x00-\x08\x0B\x0C\x0E-\x1F])"), F.lit(1)))
    return rows.select(found.alias("c")).groupBy(F.ascii("c").alias("code_point")).agg(F.count(F.lit(1)).alias("removed"))


def affected_strings(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(key, column, removed, code_points, cleaned) of every text that holds forbidden characters, to be reported beside what is written."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("t")) for c in columns])
    hit = rows.select(*key, F.inline(each)).withColumn("found", F.regexp_extract_all(F.col("t"), F.lit(r"([\x00-\x08\x0B\x0C\x0E-\x1F])"), F.lit(1))).filter(F.size("found") > 0)
    points = F.array_sort(F.array_distinct(F.transform("found", lambda c: F.ascii(c))))
    return hit.select(*key, "column", F.size("found").alias("removed"), points.alias("code_points"), clean(F.col("t")).alias("cleaned"))


def clean(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
