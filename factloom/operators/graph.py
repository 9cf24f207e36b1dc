"""The evidence graph: nodes and edges built from documents, source facts, observations and lineage, and its quality.

All builders are projections of whole tables; a node's first definition by precedence wins, and edges are known by a
digest of their ends, type and attributes, so rebuilding a part gives the same ids. Attributes are JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators.normalize import stable_id

NODE = ["node_id", "node_type", "security_code", "label", "attributes"]
# What a source fact's role in an observation makes of the edge between them.
ROLE_EDGES = {"SELECTED": "SELECTED_FOR", "SUPPORTING": "SUPPORTS", "CONFLICTING": "CONFLICTS_WITH", "QUARANTINED": "QUARANTINED_FOR"}


def _text(c: str | Column) -> Column:
    return F.trim(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")))


def document_node_id(id_: str = "document_id", url: str = "source_url", name: str = "source_document") -> Column:
    """A document's id with its prefix, else a digest of its address and name; null where it has none of these."""
    own = _text(id_)
    made = stable_id("doc", _text(url), _text(name))
    return F.when(own != "", F.when(F.startswith(own, F.lit("doc_")), own).otherwise(F.concat(F.lit("doc_"),
        own))).when((_text(url) != "") | (_text(name) != ""), made)


def _node(df: DataFrame, node_id: Column, kind: str, label: Column, attributes: Column, precedence: int) -> DataFrame:
    return df.select(
        node_id.alias("node_id"), F.lit(kind).alias("node_type"), F.col("security_code"), label.alias("label"), attributes.alias("attributes"),
            F.lit(precedence).alias("precedence")
    ).filter("node_id is not null")


def _edge(df: DataFrame, start: Column, end: Column, kind: str | Column, attributes: Column | None = None) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    attributes = F.lit("{}") if attributes is None else attributes
    return df.select(start.alias("from_id"), end.alias("to_id"), kind.alias("edge_type"),
        attributes.alias("attributes")).filter("from_id is not null and to_id is not null")


def _predecessor() -> Column:
    s = _text("supersedes_document_id")
    return F.when(s != "", F.when(F.startswith(s, F.lit("doc_")), s).otherwise(F.concat(F.lit("doc_"), s)))


def _parsed_id() -> Column:
    return F.when((_text("parsed_text_path") != "") | (_text("text_sha256") != ""),
        stable_id("parsed", document_node_id(), _text("parsed_text_path"), _text("text_sha256")))


def _attachments(documents: DataFrame) -> DataFrame:
    each = documents.select("security_code", document_node_id().alias("document"), F.explode("attachments").alias("a"))
    return each.withColumn("attachment", stable_id("attachment", F.col("document"), F.col("a.source_url"), F.col("a.file_name")))


def _location_id() -> Column:
    placed = F.col("source_page").isNotNull() | (_text("source_row") != "")
    return F.when(document_node_id().isNotNull() & placed, stable_id("loc", document_node_id(), _text("source_page"), _text("source_row")))


def nodes(documents: DataFrame, source_facts: DataFrame, observations: DataFrame) -> DataFrame:
    """Nodes of all kinds, one row each; documents that are only referred to are placeholders.

    documents: security_code, document_id, source_url, source_document, document_title, report_date, available_at,
    supersedes_document_id, parsed_text_path, text_sha256, attachments; source_facts: security_code, source_fact_id,
    field_key, document_id, source_url, source_document, source_page, source_row; observations: security_code, observation_id,
    metric_id.
    """
    d = documents.filter(_text("security_code") != "")
    s, o = source_facts.filter(_text("source_fact_id") != ""), observations.filter(_text("observation_id") != "")
    codes = d.select("security_code").unionByName(s.select("security_code")).unionByName(o.select("security_code")).distinct()
    code = F.col("security_code")
    title = F.coalesce(F.nullif(_text("document_title"), F.lit("")), document_node_id())
    facts_of_document = F.to_json(F.struct("source_url", "document_title", "report_date", "available_at"))
    placeholder = lambda why: F.to_json(F.struct(F.lit(True).alias("placeholder"), F.lit(why).alias("reason")))
    known = F.coalesce(F.nullif(_text("source_document"), F.lit("")), F.nullif(_text("source_url"), F.lit("")), document_node_id())
    parts = [
        _node(codes, F.concat(F.lit("security_"), code), "SECURITY", code, F.to_json(F.struct("security_code")), 0),
        _node(d, document_node_id(), "DOCUMENT", title, facts_of_document, 0),
        _node(d, _predecessor(), "DOCUMENT", _predecessor(), placeholder("version chain"), 1),
        _node(d, _parsed_id(), "PARSED_TEXT", F.coalesce(F.nullif(_text("parsed_text_path"), F.lit("")), _text("text_sha256")),
            F.to_json(F.struct("parsed_text_path", "text_sha256")), 0),
        _node(_attachments(d), F.col("attachment"), "ATTACHMENT", _text("a.file_name"), F.to_json("a"), 0),
        _node(s, F.col("source_fact_id"), "SOURCE_FACT", _text("field_key"), F.to_json(F.struct("field_key", "source_url", "source_page")), 0),
        _node(s, document_node_id(), "DOCUMENT", known, placeholder("source fact lineage"), 2),
        _node(s, _location_id(), "EVIDENCE_LOCATION", F.concat_ws(" p.", document_node_id(), F.coalesce(F.nullif(_text("source_page"), F.lit("")), F.lit("?"))),
            F.to_json(F.struct("source_page", "source_row")), 0),
        _node(o, F.col("observation_id"), "CANONICAL_OBSERVATION", _text("metric_id"), F.to_json(F.struct("metric_id")), 0),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # the least of the first precedence, combined before the shuffle
    rest = ["node_type", "security_code", "label", "attributes"]
    return every.groupBy("node_id").agg(F.min(F.struct("precedence", *rest)).alias("n")).select("node_id", *[F.col(f"n.{c}") for c in rest])


def edges(documents: DataFrame, source_facts: DataFrame, observations: DataFrame, lineage: DataFrame) -> DataFrame:
    """Edges of all kinds, each once. lineage: observation_id, source_fact_id, role, priority."""
    d = documents.filter(_text("security_code") != "")
    s, o = source_facts.filter(_text("source_fact_id") != ""), observations.filter(_text("observation_id") != "")
    security = F.concat(F.lit("security_"), F.col("security_code"))
    document = document_node_id()
    role = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLE_EDGES.items() for x in kv]), F.col("role")), F.lit("SUPPORTS"))
    parts = [
        _edge(d, document, security, "DESCRIBES_SECURITY"), _edge(d, document, _predecessor(), "SUPERSEDES"), _edge(d, _parsed_id(), document, "PARSED_FROM"),
        _edge(_attachments(d), F.col("attachment"), F.col("document"), "ATTACHED_TO"),
        _edge(s, F.col("source_fact_id"), security, "DESCRIBES_SECURITY"), _edge(s, document, security, "DESCRIBES_SECURITY"),
        _edge(s, F.col("source_fact_id"), document, "DERIVED_FROM_DOCUMENT"), _edge(s, F.col("source_fact_id"), _location_id(), "LOCATED_AT"),
        _edge(s, _location_id(), document, "PART_OF_DOCUMENT"), _edge(o, F.col("observation_id"), security, "DESCRIBES_SECURITY"),
        _edge(lineage, F.col("observation_id"), F.col("source_fact_id"), role, F.to_json(F.struct("role", "priority"))),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # an id is a digest of all that an edge is, so equal edges are found without it
    return every.distinct().withColumn("edge_id", stable_id("edge", F.col("from_id"), F.col("to_id"), F.col("edge_type"), F.col("attributes")))


def versions(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Documents of each security, newest first in version_rank, with the document that each supersedes."""
    attribute = lambda k: F.get_json_object("attributes", f"$.{k}")
    docs = node_rows.filter("node_type = 'DOCUMENT'").withColumns({"report_date": attribute("report_date"), "available_at": attribute("available_at")})
    chain = edge_rows.filter("edge_type = 'SUPERSEDES'").select(F.col("from_id").alias("node_id"), F.col("to_id").alias("supersedes"))
    newest = Window.partitionBy("security_code").orderBy(F.desc_nulls_last("report_date"), F.desc_nulls_last("available_at"), "node_id")
    out = docs.join(chain, "node_id", "left").withColumn("version_rank", F.row_number().over(newest))
    return out.select("security_code", "node_id", "label", "report_date", "available_at", "supersedes", "version_rank")


def quality(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """(measure, kind, n, share): nodes and edges by type, repeated ids, dangling edges, and the shares of observations with
    lineage and with evidence; verdict PASS or FAIL in the row `status`."""
    # every measure takes all of these columns, so both tables are made once for all of them
    node_rows = node_rows.groupBy("node_id", "node_type").agg(F.count(F.lit(1)).alias("k"))
    edge_rows = edge_rows.groupBy("edge_id", "edge_type", "from_id", "to_id").agg(F.count(F.lit(1)).alias("k"))

    def counted(rows: DataFrame, measure: str, id_: str, kind: str) -> DataFrame:
        first = F.row_number().over(Window.partitionBy(id_).orderBy(kind)) == 1
        return rows.withColumn("t__x", F.col("k") - first.cast("long")).groupBy(F.col(kind).alias("kind")).agg(F.sum("k").alias("n"), F.sum("t__x").alias("more")).select(
            F.lit(measure).alias("measure"), "kind", "n", F.lit(None).cast("double").alias("share"), "more")

    ends = edge_rows.select("edge_id", F.explode(F.array("from_id", "to_id")).alias("node_id"))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    dangling = ends.join(node_rows.select("node_id"), "node_id", "left_anti").agg(F.countDistinct("edge_id").alias("n")).select(F.lit("dangling_edges").alias("measure"),
        none("kind", "string"), "n", none("share", "double"), none("more", "long"))
    lineage = edge_rows.filter(F.col("edge_type").isin(*ROLE_EDGES.values())).select(F.col("from_id").alias("node_id"), F.col("to_id").alias("fact"))
    evidenced = edge_rows.filter(F.col("edge_type").isin("LOCATED_AT", "DERIVED_FROM_DOCUMENT")).select(F.col("from_id").alias("fact")).distinct()
    evidenced = lineage.join(evidenced.withColumn("evidence", F.lit(True)), "fact", "left")
    sources = evidenced.groupBy("node_id").agg(F.lit(True).alias("lineage"), F.max("evidence").alias("evidence"))
    observed = node_rows.filter("node_type = 'CANONICAL_OBSERVATION'").select("node_id", "k")
    shares = observed.join(sources, "node_id", "left").agg(*[F.coalesce(F.sum(F.when(c, F.col("k"))), F.lit(0)).alias(n)
        for n, c in (("all", F.lit(True)), ("with_lineage", F.col("lineage")), ("with_evidence", F.col("evidence")))])
    shares = shares.select(F.explode(F.array(*[F.struct(F.lit(f"observations_{c}").alias("measure"), none("kind", "string"), F.col(c).alias("n"),
        F.try_divide(F.col(c), F.col("all")).alias("share"), none("more", "long")) for c in ("with_lineage", "with_evidence")])).alias("s")).select("s.*")
    nodes_, edges_ = counted(node_rows, "nodes", "node_id", "node_type"), counted(edge_rows, "edges", "edge_id", "edge_type")
    plain = nodes_.unionByName(edges_).unionByName(dangling).unionByName(shares)
    # a few rows of measures, whatever the size of the graph: brought together once, not made again for the verdict
    c = F.col
    more = lambda m: F.coalesce(F.sum(F.when(c("measure") == m, c("more"))), F.lit(0)).alias(f"more_{m}")
    bad = (c("measure") == "dangling_edges") & (c("n") > 0) | (c("measure") == "observations_with_lineage") & (F.coalesce("share", F.lit(1.0)) < 1)
    one = plain.agg(F.collect_list(F.struct("measure", "kind", "n", "share")).alias("m"), more("nodes"), more("edges"), F.coalesce(F.bool_or(bad), F.lit(False)).alias("bad"))
    row = lambda measure, kind, n: F.struct(F.lit(measure).alias("measure"), kind.alias("kind"), n.alias("n"), none("share", "double"))
    failed = c("bad") | (c("more_nodes") > 0) | (c("more_edges") > 0)
    added = F.array(
        row("duplicate_nodes", F.lit(None).cast("string"), c("more_nodes")), row("duplicate_edges", F.lit(None).cast("string"), c("more_edges")),
        row("status", F.when(failed, "FAIL").otherwise("PASS"), F.lit(None).cast("long")),
    )
    return one.select(F.explode(F.concat("m", added)).alias("r")).select("r.*")
