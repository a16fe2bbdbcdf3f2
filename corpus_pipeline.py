"""A corpus pipeline of five operators: each stage is written as Parquet and read again by the next.

Toxic documents go, one document of each group of near duplicates stays, secrets are
masked, sources are mixed to their targets (a document comes out as often as the mix
takes it), and what is left is encoded. All stages but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcurve.llm import jaccard, mixing, pieces, secrets, toxicity
from foldcurve.llm.common import written

#: SQL has no field, no rounding and no tokenizer.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field, learned from all labelled documents, does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.fit(toxicity.labelled(docs, labels)))


def keyed(docs: DataFrame, *content: str) -> DataFrame:
    """Each row as a struct `row`, so that its columns may have any names, with its doc_id and a `key`.

    The key is the id, or a hash of id and content for rows without id and rows whose id stands for several contents.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    sign = F.xxhash64(*[x for c in content for x in (F.col(f"row.{c}").isNull(), F.col(f"row.{c}"))])
    rows = rows.select("row", F.col("row.doc_id").alias("id"), sign.alias("sign"))
    signs = rows.where("id is not null").groupBy("id").agg(F.min("sign").alias("a"), F.max("sign").alias("b"))
    several = written(signs.where("a <> b").select(F.col("id").alias("several")))
    own = F.col("id").isNull() | F.col("several").isNotNull()
    key = F.when(own, F.xxhash64(F.col("id").isNull(), "id", "sign")).otherwise(F.col("id"))
    return rows.join(several, F.col("id") == F.col("several"), "left").select("row", "id", key.alias("key"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component; of rows that share id and text one stays, without id all."""
    rows = keyed(docs.where("doc_id is not null"), "text")
    linked = written(jaccard.join(rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"))).select(F.col("doc_id").alias("linked"), "component_id").distinct())
    ids = rows.select("key", "id").distinct()
    first = linked.join(ids, F.col("linked") == F.col("key")).groupBy("component_id").agg(F.min(F.struct("id", "key")).alias("first"))
    kept = written(first.select(F.col("first.key").alias("key")))
    named = rows.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
    return named.unionByName(docs.where("doc_id is null"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced by as many marks."""
    return secrets.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Rows that share an id are told apart by their text and source."""
    rows = keyed(docs, "text", "source")
    mixed = mixing.mix(rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"), F.col("row.source").alias("source")))
    copies = mixed.groupBy("doc_id").agg(F.sum("copies").cast("int").alias("copies"))
    taken = written(copies.where("copies > 0").select(F.col("doc_id").alias("key"), "copies"))
    # Both sides grow with the documents, so they are dealt by key at any size.
    rows = rows.join(taken.hint("merge"), "key").dropDuplicates(["key"])
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of every row."""
    return pieces.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
