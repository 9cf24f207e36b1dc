"""Scans: fact files, nested record groups, document indexes and request batches, each with a fixed schema.

Sources are files, or tables with a text column of what such files hold (a landed topic, an archive that was read
elsewhere). A text that doesn't fit gives null fields and keeps itself in `_corrupt`, so that rules can name it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.normalize import (
    AVAILABILITY_KEYS,
    CODE_KEYS,
    DATE_KEYS,
    DISCRIMINATORS,
    NAME_FAMILIES,
    date_of,
    facts_of,
    period_type,
    record_key,
    security_digits,
    semantics,
    valid_name,
)
from factloom.sources.facts import COLUMNS

DATES = ["report_date", "event_date", "available_at"]
FACTS = ", ".join(f"{c} {'date' if c in DATES else 'double' if c == 'value_num' else 'string'}" for c in COLUMNS)
DOCUMENTS = (
    "document_id string, security_code string, pack_id string, source_tier string, status string, document_title string, source_url string,"
    " publish_date string, query string, search_scope string, minimum_human_action string, sha256 string, file_size_bytes long,"
    " raw_original_binary_saved boolean, parsed_text_saved boolean, attachments array<struct<file_name: string, source_url: string>>,"
    " links array<string>, notes string, _corrupt string"
)
REQUESTS = (
    "batch_id string, security_id string, code string, name string, exchange string, request_annual_from date, request_quarterly_from date,"
    " request_through date, required_available_at boolean, request_status string, _corrupt string"
)
#: Nested parts of an index that may have been written as JSON text.
NESTED = {"attachments": "array<struct<file_name: string, source_url: string>>", "links": "array<string>"}


def padded(code: Column) -> Column:
    """A security code with its leading zeros; longer ones stay as they are."""
    c = F.trim(code.cast("string"))
    return F.when(F.length(c) < 6, F.lpad(c, 6, "0")).otherwise(c)


def fact_scan(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """A fact table from Parquet or CSV with its 18 columns; those that a file lacks are null, codes keep their zeros."""
    if kind == "csv":
        names = spark.read.option("header", True).csv(path).columns
        rows = spark.read.schema(", ".join(f"`{n}` string" for n in names)).option("header", True).csv(path)
    else:
        rows = spark.read.parquet(path)
    return typed(rows)


def typed(rows: DataFrame) -> DataFrame:
    """Rows as facts: the 18 columns with their types."""
    wanted = [tuple(f.split(" ")) for f in FACTS.split(", ")]
    return rows.select(
        *[(F.col(c).try_cast(t) if c in rows.columns else F.lit(None).cast(t)).alias(c) for c, t in wanted if c != "security_code"],
        padded(F.col("security_code")).alias("security_code"),
    ).select(*COLUMNS)


def groups(texts: DataFrame, text: str = "value") -> DataFrame:
    """A row for each record group of run envelopes in JSON: (security_code, group_no, group_id, theme, family, records, payloads)."""
    get = lambda v, path, kind: F.try_variant_get(v, f"$.{path}", kind)
    # a column of its own, so that a text is parsed once
    doc = texts.select(F.try_parse_json(F.col(text)).alias("s__doc"))
    parts = doc.select(get("s__doc", "metadata.security.code", "string").alias("security_code"), get("s__doc", "groups", "array<variant>").alias("s__groups"))
    each = parts.select("security_code", F.posexplode("s__groups").alias("group_no", "g"))
    return each.select(
        "security_code", "group_no", *[F.coalesce(get(F.col("g"), k, "string"), F.lit("")).alias(k) for k in ("group_id", "theme", "family")],
        get(F.col("g"), "records", "array<variant>").alias("records"), get(F.col("g"), "payloads", "array<variant>").alias("payloads"),
    )


def is_object(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))


def _listed(value: str) -> Column:
    """The records of a section: a list, an object with a list `data`, or an object."""
    kind = F.schema_of_variant(value)
    data = F.try_variant_get(value, "$.data", "variant")
    has_list = F.startswith(F.schema_of_variant(data), F.lit("ARRAY"))
    return (
        F.when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get(value, "$", "array<variant>"))
        .when(F.startswith(kind, F.lit("OBJECT")), F.when(has_list, F.try_variant_get(value, "$.data", "array<variant>")).otherwise(F.array(value)))
    )


def sections(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """A row for each record of each named section of page payloads: a list, an object with a list `data`, or an object."""
    spark = payloads.sparkSession
    both = payloads.filter(is_object(F.col(payload))).lateralJoin(spark.tvf.variant_explode(F.col(payload).outer()))
    kept = [c for c in payloads.columns if c != payload]
    return both.select(*kept, F.col("key").alias("section"), F.posexplode(F.filter(_listed("value"), is_object)).alias("ordinal", "record"))


def records(found: DataFrame) -> DataFrame:
    """A row for each record of groups(): the groups' own, and the sections of page payloads as datasets of their own.

    Both in one pass, so that texts are read once: a unit is a record or a payload, and only payloads are taken apart.
    """
    paged = (F.col("family") == "PageAjax") & (F.coalesce(F.size("payloads"), F.lit(0)) > 0)
    each = F.when(paged, F.col("payloads")).otherwise(F.filter("records", is_object))
    marked = found.select("security_code", "group_no", "theme", "family", F.coalesce(paged, F.lit(False)).alias("s__paged"), each.alias("s__each"))
    units = marked.select("security_code", "group_no", "theme", "family", "s__paged", F.posexplode("s__each").alias("s__at", "s__unit"))
    units = units.withColumn("s__payload", F.when(F.col("s__paged") & is_object(F.col("s__unit")), F.col("s__unit")))
    both = units.lateralJoin(found.sparkSession.tvf.variant_explode_outer(F.col("s__payload").outer()))
    page = F.col("s__paged")
    listed = F.when(~page, F.array("s__unit")).otherwise(F.filter(_listed("value"), is_object))
    out = both.select("security_code", "group_no", "theme", "family", "s__paged", "s__at", "key", F.posexplode(listed).alias("s__n", "record"))
    return out.select(
        "security_code", "group_no", F.when(page, F.concat(F.lit("页面汇总/"), "key")).otherwise(F.col("theme")).alias("theme"), "family",
        F.when(page, F.col("s__n")).otherwise(F.col("s__at")).alias("ordinal"), "record",
        F.when(page, F.concat(F.lit("PageAjax/"), "key")).otherwise(F.concat_ws(" / ", "theme", "family")).alias("dataset"),
    )


def record_facts(rows: DataFrame) -> DataFrame:
    """Facts of records(): dates, period and record key are the record's, a row for each key."""
    text = lambda k: F.try_variant_get("record", f"$.{k}", "string")
    first = lambda keys: F.coalesce(*[F.nullif(text(k), F.lit("")) for k in keys])
    # texts before dates before what is made of dates: a step's columns are used several times in the next, so each is made once
    own = ["security_code", "theme", "family", "dataset", "record"]
    texts = rows.select(*own, text("REPORT_DATE").alias("s__r"), first(DATE_KEYS).alias("s__e"), first(AVAILABILITY_KEYS).alias("s__a"),
        F.coalesce(text("REPORT_TYPE"), text("REPORT_DATE_NAME"), F.lit("")).alias("s__x"),
        F.concat_ws("|", *[F.nullif(text(k), F.lit("")) for k in DISCRIMINATORS]).alias("s__k"))
    # a date of an event is most often the report date itself
    dates = texts.select(*own, "s__x", "s__k", "s__r", "s__e", date_of(F.col("s__r")).alias("report_date"), date_of(F.col("s__a")).alias("available_at"))
    dates = dates.withColumn("event_date", F.when(F.col("s__e") == F.col("s__r"), F.col("report_date")).otherwise(date_of(F.col("s__e"))))
    out = dates.withColumns({
        "period_type": period_type(F.col("s__x"), F.col("report_date")), "data_semantics": semantics(F.col("family")),
        "record_key": record_key(F.col("security_code"), F.col("family"), F.coalesce("report_date", "event_date", F.lit("")), F.col("s__k")),
    })
    keep = ["security_code", "theme", "family", "dataset", "record_key", "report_date", "event_date", "available_at", "period_type", "data_semantics"]
    return facts_of(out.select(*keep, "record"), keep)


def names(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(security_code, name): the name that records of a security give it, by the order of families, then the most frequent.

    A name counts only if the same object, a record or one nested in it, also holds the security's own code, so that
    peers, holders and research firms in a payload don't lend theirs.
    """
    spark = rows.sparkSession
    inner = rows.lateralJoin(spark.tvf.variant_explode(F.col("record").outer())).filter(is_object(F.col("value")))
    objects = rows.select("security_code", "family", "record").unionByName(inner.select("security_code", "family", F.col("value").alias("record")))
    text = lambda k: F.try_variant_get("record", f"$.{k}", "string")
    own = F.exists(F.array(*[security_digits(text(k)) for k in CODE_KEYS]), lambda c: c == F.col("security_code"))
    name = F.coalesce(*[valid_name(text(k), F.col("security_code")) for k in keys])
    found = objects.filter(F.coalesce(own, F.lit(False))).withColumn("name", name).filter("name is not null")
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in NAME_FAMILIES.items() for x in kv]), F.col("family")), F.lit(20))
    counted = found.groupBy("security_code", rank.alias("rank"), "name").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("security_code").agg(F.min_by("name", F.struct("rank", -F.col("n"), "name")).alias("name"))


def document_index(lines: DataFrame, text: str = "value") -> DataFrame:
    """Documents of an index in JSON lines; blank lines are left out, nested parts written as JSON text are read as such."""
    plain = ", ".join(f.strip() if f.split()[0] not in NESTED else f"{f.split()[0]} variant" for f in _fields(DOCUMENTS))
    rows = lines.filter(F.trim(text) != "").select(F.from_json(text, plain, {"columnNameOfCorruptRecord": "_corrupt"}).alias("d")).select("d.*")
    revived = {}
    for name, kind in NESTED.items():
        as_text = F.try_variant_get(name, "$", "string")
        revived[name] = F.coalesce(F.try_variant_get(name, "$", kind.replace(": ", ":")), F.from_json(as_text, kind))
    return rows.withColumns(revived)


def _fields(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for k, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:k].strip())
            start = k + 1
    return [*out, schema[start:].strip()]


def requests(lines: DataFrame, text: str = "value") -> DataFrame:
    """Rows of request batches in CSV without their header; what doesn't fit the types is null, the line is in `_corrupt`."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "dateFormat": "yyyy-MM-dd"}
    rows = lines.filter((F.trim(text) != "") & ~F.startswith(text, F.lit("batch_id,")))
    return rows.select(F.from_csv(text, REQUESTS, options).alias("r")).select("r.*")
