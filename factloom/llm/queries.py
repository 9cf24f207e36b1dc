"""The queries of this subpackage, each over the whole of its table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import alignment, bpe, extraction, language, neighbours, packing, quality, sharding, simhash, spelling, stupid_backoff, toxicity, warc
from factloom.llm.common import table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.by_bytes(table(spark, sf_dir, "documents"), 40)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"))


def op5_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stupid_backoff.scored(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048, 1)


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10, 1.0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(table(spark, sf_dir, "documents"))


def op12_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(table(spark, sf_dir, "pages"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline  # noqa: F401  the pipeline is part of this subpackage

    each = [op1_language, op2_simhash, op3_sharding, op4_quality, op5_stupid_backoff, op6_warc, op7_packing, op8_neighbours, op9_toxicity, op10_bpe, op11_spelling, op12_extraction, op13_alignment, pipeline]
    return {f.__name__: f for f in each}


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
r AS (SELECT payload_digest AS digest, max(page_id) AS first_id FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < first_id THEN first_id END AS refers_to
FROM d LEFT JOIN r ON d.payload_digest = r.digest
"""

NEIGHBOURS_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


BACKOFF_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT rid, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
n1 AS (SELECT c, count(*) AS n FROM g GROUP BY c), n2 AS (SELECT b, c, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY b, c),
n3 AS (SELECT a, b, c, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY a, b, c),
t AS (SELECT round(ln(greatest(count(*), 1)) * 4294967296)::BIGINT AS of_all, round(ln(0.4::DOUBLE) * 4294967296)::BIGINT AS lower FROM g),
s AS (SELECT g.rid, CASE
    WHEN n3.n > 1 THEN round(ln(n3.n) * 4294967296)::BIGINT - round(ln(ab.n) * 4294967296)::BIGINT
    WHEN bc.n > 1 THEN lower + round(ln(bc.n) * 4294967296)::BIGINT - round(ln(nb.n) * 4294967296)::BIGINT
    ELSE 2 * lower + round(ln(nc.n) * 4294967296)::BIGINT - of_all END AS v
  FROM g CROSS JOIN t JOIN n1 nc ON nc.c = g.c LEFT JOIN n1 nb ON nb.c = g.b LEFT JOIN n2 bc ON bc.b = g.b AND bc.c = g.c
  LEFT JOIN n2 ab ON ab.b = g.a AND ab.c = g.b LEFT JOIN n3 ON n3.a = g.a AND n3.b = g.b AND n3.c = g.c),
x AS (SELECT rid, sum(v)::DOUBLE / 4294967296 AS total FROM s GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(total, 0.0::DOUBLE) AS log_score, CASE WHEN len(w) > 0 THEN total / len(w) END AS score FROM d LEFT JOIN x USING (rid)
"""


VALUE = "CASE WHEN {0} < 64 THEN {0} ELSE (({0} - 64) % 32 + 32) * CAST(pow(2, ({0} - 64) // 32 + 1) AS BIGINT) END"


def _fences_sql(name: str, keys: str) -> str:
    return f"""
m_{name} AS (SELECT {keys} ratio, bucket, sum(n) AS n FROM sketch GROUP BY {keys} ratio, bucket),
u_{name} AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ratio ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys} ratio) AS seen FROM m_{name}),
b_{name} AS (SELECT {keys} ratio, min(bucket) FILTER (100 * upto >= 10 * seen) AS b10, min(bucket) FILTER (100 * upto >= 50 * seen) AS b50,
  min(bucket) FILTER (100 * upto >= 90 * seen) AS b90, min(bucket) FILTER (100 * upto >= 99 * seen) AS b99, max(seen) AS seen FROM u_{name} GROUP BY {keys} ratio),
v_{name} AS (SELECT {keys} ratio, seen, {VALUE.format("b10")} AS p10, {VALUE.format("b50")} AS p50, {VALUE.format("b90")} AS p90,
  {VALUE.format("(b90 + 1)")} - 1 AS top90, {VALUE.format("(b99 + 1)")} - 1 AS top99 FROM b_{name}),
n_{name} AS (SELECT *, {", ".join(f"max({p}) FILTER (ratio = 'unit_{r}') OVER ({'PARTITION BY ' + keys.rstrip(', ') if keys else ''}) AS u_{r}"
    for r, p in (("symbols", "p90"), ("lines", "p50"), ("repeats", "p50")))} FROM v_{name}),
f_{name} AS (SELECT {keys} ratio, seen, p10 - 6 * (p50 - p10) AS low,
  CASE WHEN ratio = 'lines' AND top99 = 0 THEN u_lines WHEN ratio = 'repeats' AND top99 = 0 THEN u_repeats WHEN ratio IN ('lines', 'repeats') THEN 2 * top99 - p90
    WHEN ratio = 'symbols' THEN top90 + 6 * greatest(p90 - p50, u_symbols) ELSE top90 + 6 * (p90 - p50) END AS high FROM n_{name} WHERE NOT starts_with(ratio, 'unit_'))"""


QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, lang, source, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
b AS (SELECT w.*, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (rid)),
e AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
x AS (SELECT rid, lang, source, base_failed, unnest([{{'ratio': 'symbols', 'v': CASE WHEN word_chars > 0 THEN n_symbols * 10000 // word_chars ELSE 0 END}},
  {{'ratio': 'lines', 'v': CASE WHEN n_lines > 0 THEN n_dup_lines * 10000 // n_lines ELSE 0 END}},
    {{'ratio': 'repeats', 'v': CASE WHEN n_words > 0 THEN n_repeat_words * 10000 // n_words ELSE 0 END}},
  {{'ratio': 'length', 'v': CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END}},
  {{'ratio': 'unit_symbols', 'v': greatest(1, coalesce(10000 // nullif(word_chars, 0), 0))}}, {{'ratio': 'unit_lines', 'v': greatest(1, coalesce(10000 // nullif(n_lines, 0), 0))}},
  {{'ratio': 'unit_repeats', 'v': greatest(1, coalesce(20000 // nullif(n_lines, 0), 0))}}]) AS z FROM e),
y AS (SELECT rid, coalesce(lang, chr(0)) AS lang, coalesce(source, chr(0)) AS source, base_failed, z.ratio AS ratio, z.v AS v, length(ltrim(bin(z.v), '0')) - 1 AS e FROM x),
sketch AS (SELECT lang, source, ratio, CASE WHEN v < 64 THEN v ELSE 64 + (e - 6) * 32 + v // CAST(pow(2, e - 5) AS BIGINT) - 32 END AS bucket, count(*) AS n
    FROM y WHERE NOT base_failed GROUP BY 1, 2, 3, 4),
{_fences_sql("s", "lang, source,")}, {_fences_sql("l", "lang,")}, {_fences_sql("a", "")},
ok AS (SELECT rid, bool_and(v <= CASE WHEN s.seen >= 200 THEN s.high WHEN l.seen >= 200 THEN l.high ELSE a.high END
    AND (ratio <> 'length' OR v >= CASE WHEN s.seen >= 200 THEN s.low WHEN l.seen >= 200 THEN l.low ELSE a.low END)) AS fine
  FROM y JOIN f_s s USING (lang, source, ratio) JOIN f_l l USING (lang, ratio) JOIN f_a a USING (ratio) GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(fine, true) AS kept FROM e LEFT JOIN ok USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    known = {"op4_quality": QUALITY_SQL, "op5_stupid_backoff": BACKOFF_SQL, "op6_warc": WARC_SQL, "op8_neighbours": NEIGHBOURS_SQL}
    return known | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
