import corpus_pipeline
from factloom.llm import language, quality, queries, simhash

SMALL = "/root/testdata/sf0.001"


def test_stages_follow_one_another(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before, seen = docs.count(), {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == corpus_pipeline.COLUMNS, name
        docs = docs.checkpoint()
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= seen and 0 < docs.count() <= before
        before, seen = docs.count(), ids
    packed = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == seen


def test_all_ten_are_registered():
    names = queries.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "score", "bucket", "kept__id", "q__text"]
ODD = "doc_id long, text string, lang string, source string, n_chars long, score string, bucket string, kept__id string, q__text string"


def test_stages_on_nulls_repeats_and_clashing_columns(spark):
    words = "the and of with thing hand stand other".split()
    prose = lambda k: " ".join(f"{words[(k * j + j * j) % 8]}{words[(k + 3 * j) % 8]}{k % 7}" for j in range(120))
    rows = [(k, prose(k), "en" if k % 5 else None, f"s{k % 2}" if k % 3 else None, 9, "x", "y", "z", "w") for k in range(60)]
    rows += [(None, None, None, None, None, None, None, None, None), (61, None, "en", "s", 0, "x", "y", "z", "w"), (62, "", "en", "s", 0, "x", "y", "z", "w"),
        rows[7], (None, prose(7), "en", "s", 0, "", "", "", ""), (7, prose(90), "en", "s", 0, "", "", "", "")]
    docs = spark.createDataFrame(rows, ODD).repartition(3)
    kept = language.accepted(docs, COLUMNS)
    assert kept.columns == COLUMNS and {r.doc_id for r in kept.collect() if r.text is None or r.text == ""} == set()
    assert kept.count() == 63
    passed = quality.passed(docs, COLUMNS)
    assert passed.columns == COLUMNS and passed.filter("text is null or text = ''").count() == 0
    once = simhash.kept_one(docs)
    assert once.columns == COLUMNS
    found = [(r.doc_id, r.text) for r in once.collect()]
    assert len(found) == len(set(found)) and {(7, prose(7)), (7, prose(90))} <= set(found) and (None, prose(7)) not in found
    assert sum(t in (None, "") for _, t in found) == 1


def test_stages_on_an_empty_table(spark):
    nothing = spark.createDataFrame([], ODD)
    assert language.accepted(nothing, COLUMNS).count() == quality.passed(nothing, COLUMNS).count() == simhash.kept_one(nothing).count() == 0
    assert corpus_pipeline.packing_stage(spark, nothing, SMALL).count() == 0
