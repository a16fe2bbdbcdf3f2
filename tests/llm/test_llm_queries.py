"""The registered queries and the pipeline on the smallest tables."""

import corpus_pipeline
from foldcurve.llm import jaccard, pieces, queries, secrets, toxicity
from foldcurve.llm.common import written
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_thirteen_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    clean = written(corpus_pipeline.drop_toxic(spark, docs, SF))
    assert clean.columns == names
    model = toxicity.fit(toxicity.labelled(docs, labels))
    want = {r.doc_id for r in toxicity.tag(docs, model).collect() if not r.predicted}
    assert {r.doc_id for r in clean.collect()} == want

    one = written(corpus_pipeline.drop_near_duplicates(spark, clean, SF))
    assert one.columns == names
    parts = jaccard.join(clean).collect()
    assert sorted(r.doc_id for r in one.collect()) == sorted(r.doc_id for r in parts if r.doc_id == r.component_id)

    masked = written(corpus_pipeline.mask_secrets(spark, one, SF))
    assert masked.columns == names and masked.count() == one.count()
    assert secrets.digest(masked).where("n_assign + n_access + n_hex > 0").count() == 0

    mixed = written(corpus_pipeline.mix_sources(spark, masked, SF))
    assert mixed.columns == names
    words = "sum(regexp_count(text, '[^ \\t\\n\\u000b\\f\\r]+'))"
    took, all_words = mixed.agg(F.expr(words)).first()[0], masked.agg(F.expr(words)).first()[0]
    assert abs(took - 1.5 * all_words) < 0.1 * all_words

    out = corpus_pipeline.encode(spark, mixed, SF)
    assert out.count() == mixed.count()
    assert pieces.encode_documents(mixed).exceptAll(out).count() == 0


def test_rows_without_id_stay(spark):
    rows = [(None, "a b c d e f", "en", None, 11), (1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "None"]
    assert corpus_pipeline.mix_sources(spark, docs, SF).columns == docs.columns


def test_rows_that_share_an_id_but_not_the_text_stay(spark):
    texts = [" ".join(f"{x}{i}" for i in range(40)) for x in "abcd"]
    rows = [(1, texts[0], "en", "s", 11), (1, texts[1], "en", "s", 11), (1, texts[1], "en", "s", 11), (2, texts[2], "en", "s", 11), (3, texts[1], "en", "t", 11), (3, texts[3], "en", "t", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    # The copy of texts[1] under id 3 is linked with the one under the smaller id.
    assert sorted((r.doc_id, texts.index(r.text)) for r in kept.collect()) == [(1, 0), (1, 1), (2, 2), (3, 3)]
    mixed = corpus_pipeline.mix_sources(spark, docs.where(F.col("text") != texts[2]), SF).groupBy("doc_id", "text", "source").count().collect()
    there = {k: sum((r[0], r[1], r[3]) == k for r in rows) for k in {(r[0], r[1], r[3]) for r in rows}}
    assert mixed and all(r["count"] <= 2 * there[r.doc_id, r.text, r.source] for r in mixed)


def test_pipeline_columns_may_have_any_name(spark):
    texts = [" ".join(f"{x}{i}" for i in range(40)) for x in "abc"]
    names = ["key", "id", "row", "sign", "several", "copies", "copy", "_key", "linked", "component_id", "a.b"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names)
    rows = [(i, t, "en", "s", 11, *[10 * i + j for j in range(len(names))]) for i, t in [(1, texts[0]), (2, texts[0]), (3, texts[1]), (4, texts[2])]]
    docs = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2], rows[3]]
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns and set(map(tuple, mixed.collect())) <= set(rows)
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.mix_sources):
        empty = stage(spark, docs.where("false"), SF)
        assert empty.columns == docs.columns and empty.count() == 0
