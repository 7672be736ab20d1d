"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import jaccard, langid, mixing, pieces, queries, toxicity
from docloom.session import ensure_importable, materialize, table

#: The share of the tokens that reach the mixing stage which it gives out; every document is used at most once.
MIX_SHARE = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in languages that the corpus' labelled documents have, one or several; those without letters, or that no learned language explains better than chance, go."""
    ensure_importable(spark)
    model = langid.learn(docs, queries.remainder(5) != 0)
    return langid.keep_identified(docs, model)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5; toxic ones go."""
    ensure_importable(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), queries.remainder(5) != 0)
    return toxicity.keep_clean(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: that with the smallest id, of equal ids the one whose text has the least hash.

    Rows with equal ids are documents each for itself, so of exact repeats one stays, and an id's other texts stay unless they are near
    duplicates themselves. Rows with a null id, and texts without words, stay.
    """
    ensure_importable(spark)
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    linked = jaccard.join(numbered.where("doc_id is not null").select("__row", "text"), "__row").where("component_id <> __row")
    linked = materialize(linked.select("__row", F.col("component_id").alias("__of")), "linked")
    members = linked.unionByName(linked.select(F.col("__of").alias("__row"), "__of").distinct())
    ranked = numbered.select("__row", F.struct(F.col("doc_id"), F.xxhash64("text"), F.col("__row").alias("row")).alias("rank")).join(members, "__row")
    stay = ranked.groupBy("__of").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias("__row"))
    gone = materialize(members.select("__row").join(stay, "__row", "left_anti"), "gone")
    if gone.count() <= jaccard.SMALL:
        gone = F.broadcast(gone)
    return numbered.join(gone, "__row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken by target weights of domains, languages and sources."""
    whole = docs.select("doc_id", "text", "lang", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # columns of any name pass through
    return mixing.mix(whole, queries.mix_levels(), queries.MIX_WEIGHTS, share=MIX_SHARE, max_epochs=1, keep=("row",)).select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token numbers of every document that is left, with the check that decoding gives its text back."""
    ensure_importable(spark)
    return pieces.encode_documents(docs, queries.pieces_model(spark))


STAGES = [("language_id", language), ("toxicity", toxic), ("jaccard_join", near_duplicates), ("source_mixing", mixed), ("sentencepiece", encoded)]

#: The first stages learn models from the corpus, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
