"""Canonical observations with lineage, and the evidence graph over them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.lineage import kept
from factloom.functions.ontology import MODULES, metric_of
from factloom.functions.priority import canonical_unit, scaled, source_priority
from factloom.functions.rules import REQUIRED, TOPICS
from factloom.operators.normalize import plain_text, stable_id

KEY = ["security_code", "metric_id", "report_date", "event_date", "period_type", "data_semantics", "scope"]


def resolved(facts: DataFrame) -> DataFrame:
    """Facts with their metric, module, unit, kind and scope by the ontology, and whether it knows their key."""
    m = metric_of(*[F.col(c) for c in ("field_key", "family", "field_name_cn", "unit", "data_semantics", "scope")])
    kept = [c for c in facts.columns if c not in ("unit", "data_semantics", "scope")]
    return facts.select(*kept, m.alias("m__m")).select(*kept, "m__m.*")


def module_views(rows: DataFrame) -> dict[str, DataFrame]:
    """Observations (with research_module) by module, each a filter of one table, in the order of a view."""
    order = [F.asc_nulls_last(c) for c in ("metric_id", "report_date", "period_type")]
    return {m: rows.filter(F.col("research_module") == m).orderBy(*order) for m in MODULES}


def module_ranks(rows: DataFrame) -> DataFrame:
    """All modules' views at once: module_rank is a row's place in the view of its module within its security."""
    order = Window.partitionBy("security_code", "research_module").orderBy(*[F.asc_nulls_last(c) for c in ("metric_id", "report_date", "period_type")])
    return rows.filter(F.col("research_module").isin(*MODULES)).withColumn("module_rank", F.row_number().over(order))


# Metrics that are profit quality as they are.
DIRECT_PROFIT_QUALITY = [
    "profit_quality.adjusted_parent_net_profit", "profit_quality.non_recurring_profit", "cashflow.operating_cash_flow", "cashflow.capital_expenditure",
    "balance.accounts_receivable", "balance.inventory", "balance.contract_assets", "balance.goodwill", "research.rd_expense", "research.capitalized_rd",
    "profitability.gross_margin", "profitability.roe",
]


def direct_topic_rows(rows: DataFrame, topic: str = "profit_quality", metrics: list[str] | None = None) -> DataFrame:
    """Observations of the metrics that a topic shows as they are."""
    return rows.filter(F.col("metric_id").isin(*(metrics or DIRECT_PROFIT_QUALITY))).withColumn("topic", F.lit(topic))


def section_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(section, status, n) of research sections, each with a column status: rows of every status, calculated and unresolved ones too."""
    out = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("section"), "status")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("section", "status").agg(F.count(F.lit(1)).alias("n"))


def lineage_view(lineage_rows: DataFrame, source_rows: DataFrame, observation_rows: DataFrame) -> DataFrame:
    """Observations with their lineage and source facts, those without any too; rank 1 is the source of the highest priority."""
    of_source = source_rows.select("source_fact_id", *[c for c in source_rows.columns if c not in (*observation_rows.columns, *lineage_rows.columns)])
    both = observation_rows.join(lineage_rows, "observation_id", "left").join(of_source, "source_fact_id", "left")
    order = Window.partitionBy("observation_id").orderBy(F.desc_nulls_last("source_priority"), "source_fact_id")
    return both.withColumn("lineage_rank", F.row_number().over(order))


def source_facts(facts: DataFrame, cutoff: Column, metrics: DataFrame | None = None) -> DataFrame:
    """Facts known at the cutoff (those of unknown availability pass) with metric, 元 values, priority and id.

    Metrics are the ontology's; with metrics (field_key, metric_id) those, else source.<family>.<key>.
    """
    facts = facts if "event_date" in facts.columns else facts.withColumn("event_date", F.lit(None).cast("date"))
    known = facts.filter(F.col("available_at").isNull() | (F.col("available_at") <= cutoff))
    if metrics is None:
        # the fact's own unit says what its number means, the ontology's what one without a unit is in
        named = resolved(known.withColumn("m__unit", F.col("unit")))
        named = named.withColumn("unit", F.coalesce(F.nullif(F.trim("m__unit"), F.lit("")), F.col("unit")))
    else:
        own = F.coalesce("metric_id", F.concat_ws(".", F.lit("source"), "family", "field_key"))
        named = known.drop("metric_id").join(metrics, "field_key", "left").withColumn("metric_id", own)
    out = named.select(
        "security_code", "metric_id", "report_date", "event_date", "period_type", "data_semantics", "scope", "source", "source_status", "available_at",
        "value_text", scaled("value_num", "unit").alias("value_num"), canonical_unit("unit").alias("unit"),
        source_priority(F.col("source"), F.col("source_status")).alias("priority"),
        F.col("source_status").isin("PARSE_SUSPECT", "UNRESOLVED").alias("quarantined"),
        stable_id("src", *[F.col(c) for c in ("security_code", "source", "family", "dataset", "record_key", "field_key", "event_date", "period_type", "value_text",
            "unit")]).alias("source_fact_id"),
    )
    return out.dropDuplicates(["source_fact_id"])


def lineage(sources: DataFrame) -> DataFrame:
    """Each source fact with the observation that it belongs to and its role there: windows, nothing is collected.

    The best usable fact is selected unless another usable one differs from it; then the observation is a conflict.
    Equal values differ by at most a share of 1e-10, or as plain text.
    """
    group = Window.partitionBy(*KEY)
    order = group.orderBy("quarantined", F.desc("priority"), F.desc_nulls_last("available_at"), "source_fact_id")
    first = F.first(F.struct("value_num", "value_text", "source_fact_id", "priority")).over(order.rowsBetween(Window.unboundedPreceding,
        Window.unboundedFollowing))
    out = sources.withColumn("m__f", first)
    a, b = F.col("value_num"), F.col("m__f.value_num")
    near = F.abs(a - b) <= F.greatest(F.lit(1e-9), F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) * 1e-10)
    same = F.when(a.isNotNull() & b.isNotNull(), near).otherwise(plain_text(F.col("value_text")) == plain_text(F.col("m__f.value_text")))
    out = out.withColumn("m__bad", ~F.col("quarantined") & ~same)
    out = out.withColumns({"conflicts": F.count_if("m__bad").over(group), "usable": F.count_if(~F.col("quarantined")).over(group)})
    role = (
        F.when(F.col("quarantined"), "QUARANTINED").when(F.col("m__bad"), "CONFLICTING")
        .when((F.col("conflicts") == 0) & (F.col("source_fact_id") == F.col("m__f.source_fact_id")), "SELECTED").otherwise("SUPPORTING")
    )
    return out.withColumns({"observation_id": stable_id("obs", *[F.col(k) for k in KEY]), "role": role}).drop("m__bad", "m__f")


def observations(rows: DataFrame) -> DataFrame:
    """One observation for each key, from lineage(): value, status and confidence."""
    chosen = F.col("role") == "SELECTED"
    pick = lambda c: F.max(F.when(chosen, F.col(c)))
    g = rows.groupBy("observation_id", *KEY).agg(
        pick("value_num").alias("value_num"), pick("value_text").alias("value_text"), pick("unit").alias("unit"), pick("source_fact_id").alias("selected_id"),
            pick("priority").alias("m__p"),
        F.count(F.lit(1)).alias("sources"), F.max("usable").alias("usable"), F.max("conflicts").alias("conflicts"),
    )
    status = F.when(F.col("usable") == 0, "UNRESOLVED").when(F.col("conflicts") > 0, "SOURCE_CONFLICT").when(F.col("usable") > 1,
        "VERIFIED_MULTI_SOURCE").otherwise("SINGLE_SOURCE")
    confidence = F.when(F.col("status") == "VERIFIED_MULTI_SOURCE", "high").when(F.col("status") == "SINGLE_SOURCE",
        F.when(F.col("m__p") >= 85, "high").otherwise("medium")).otherwise("low")
    return g.withColumn("status", status).withColumn("confidence", confidence).drop("m__p")


def mapping_coverage(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status", "confidence").agg(F.count(F.lit(1)).alias("n"), F.sum("sources").alias("sources"))


def topics(facts: DataFrame, patterns: dict[str, list[str]] | None = None) -> DataFrame:
    """A row for each topic that a fact's key, label or family names, with an id where the facts have source_fact_id.

    One pass over each row: a topic's patterns are one expression of alternatives, taken literally and in any case.
    """
    text = F.upper(F.concat_ws(" ", "field_key", "field_name_cn", "family"))
    hits = []
    for name, words in (TOPICS if patterns is None else patterns).items():
        any_of = "|".join(re.escape(w.upper()) for w in words)
        hits.append(F.when(text.rlike(any_of), F.lit(name)))
    out = facts.withColumn("topic", F.explode(F.array_compact(F.array(*hits))))
    if "source_fact_id" in facts.columns:
        out = out.withColumn("research_fact_id", stable_id("rf", F.col("topic"), F.col("source_fact_id")))
    return out


def coverage_gaps(rows: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """(security_code, topic, required_metric_id, status, gap_id): PRESENT or MISSING for each required metric of each security.

    required: topic, metric_id, by default that of functions.rules; its size is checked before it is sent to all tasks.
    """
    spark = rows.sparkSession
    if required is None:
        required = spark.createDataFrame([(t, m) for t, own in REQUIRED.items() for m in own], "topic string, metric_id string")
    required = required.select("topic", F.col("metric_id").alias("required_metric_id"))
    if required.count() > 10_000:
        raise ValueError("a list of required metrics is a list of rules, not of data")
    has = rows.join(F.broadcast(required.select("required_metric_id").distinct()), F.col("metric_id") == F.col("required_metric_id"), "left")
    own = has.groupBy("security_code").agg(F.collect_set("required_metric_id").alias("m__has"))  # at most as many as are required
    every = F.broadcast(required.agg(F.array_sort(F.collect_set(F.struct("topic", "required_metric_id"))).alias("m__need")))
    out = own.crossJoin(every).select("security_code", "m__has", F.inline("m__need"))  # the one row of rules
    status = F.when(F.array_contains("m__has", F.col("required_metric_id")), "PRESENT").otherwise("MISSING")
    return out.select("security_code", "topic", "required_metric_id", status.alias("status"), stable_id("gap", *map(F.col, ("security_code", "topic", "required_metric_id"))).alias("gap_id"))


#: A node is a hub if more than one in so many edges leave it; fewer than HUB nodes are.
HUB = 1000


def traced(edges: DataFrame, starts: DataFrame, depth: int = 4) -> DataFrame:
    """(start, node, depth): what each start reaches over directed edges (from_id, to_id) in at most `depth` steps.

    A round is one join of the frontier with the edges; nodes that were reached before aren't walked again. Hubs' edges are
    dealt over parts, and a start that stands at a hub goes to each of them (far fewer than the edges that it finds there), so no
    task gets all edges of a node. Where the session has a folder for checkpoints, edges and rounds are kept there, so the
    plan doesn't grow with the depth.
    """
    step = kept(edges.select(F.col("from_id").alias("node"), "to_id").distinct())
    degrees = step.groupBy("node").agg(F.count(F.lit(1)).alias("m__n"))
    total = step.count()
    hubs = kept(degrees.filter(F.col("m__n") * HUB > F.lit(total)).select("node", F.ceil(F.col("m__n") * HUB / F.lit(max(total, 1))).cast("int").alias("m__parts")))
    split = hubs.count() > 0  # fewer than HUB, as together they have all edges at most
    hubs = F.broadcast(hubs)
    seen = starts.select(F.col("node_id").alias("start"), F.col("node_id").alias("node"), F.lit(0).alias("depth"))
    front = seen
    one = F.coalesce("m__parts", F.lit(1))
    part_of = F.pmod(F.xxhash64("to_id"), one.cast("long")).cast("int").alias("m__part")
    dealt = step.join(hubs, "node", "left").select("node", "to_id", part_of) if split else step
    for k in range(1, depth + 1):
        if split:
            parts = front.join(hubs, "node", "left").select("start", "node", F.explode(F.sequence(F.lit(0), one - 1)).alias("m__part"))
            new = parts.join(dealt, ["node", "m__part"])
        else:
            new = front.join(dealt, "node")
        new = new.select("start", F.col("to_id").alias("node")).distinct()
        front = kept(new.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(k)))
        seen = seen.unionByName(front)
    return seen


def graph_quality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, id): two types for one node, repeated edges, and edges whose ends don't exist."""
    collision = nodes.groupBy("node_id").agg(F.countDistinct("node_type").alias("n")).filter("n > 1").select(F.lit("TYPE_COLLISION").alias("problem"),
        F.col("node_id").alias("id"))
    repeated = edges.groupBy("edge_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("DUPLICATE_EDGE").alias("problem"),
        F.col("edge_id").alias("id"))
    ids = nodes.select("node_id").distinct()
    ends = edges.select("edge_id", F.explode(F.array("from_id", "to_id")).alias("node_id"))
    dangling = ends.join(ids, "node_id", "left_anti").select(F.lit("DANGLING_EDGE").alias("problem"), F.col("edge_id").alias("id")).distinct()
    return collision.unionByName(repeated).unionByName(dangling)


def first_definitions(nodes: DataFrame) -> DataFrame:
    """One row a node, by precedence, then type and label."""
    order = Window.partitionBy("node_id").orderBy("precedence", "node_type", "label")
    return nodes.withColumn("g__n", F.row_number().over(order)).filter("g__n = 1").drop("g__n", "precedence")
