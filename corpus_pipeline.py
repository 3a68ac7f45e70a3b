"""From documents to packed training sequences: language ID, near-duplicates, repeated passages, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents, and others that it may have. Rows without a
doc_id are left out by the first stage, as no result could name them; so are null and empty texts, which have no
language. Texts are read whole, however long; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, jaccard, language, packing, substrings, tokens

#: A document is rejected if it has no letters or its language's mean probability is below this (four languages by chance: 0.25).
LEAST_SCORE = 0.3
NEAR = jaccard.Measure(size=5, num=80, den=100)
PASSAGE_WORDS = 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the network knows; a null lang gets the predicted one."""
    columns = docs.columns
    named = docs.where(F.col("doc_id").isNotNull())
    predicted, score = common.free_names(columns, "predicted", "score")
    found = language.predict(named, language.fit(named), columns, (predicted, score)).where((F.col(predicted) != language.UNKNOWN) & (F.col(score) >= LEAST_SCORE))
    return found.withColumn("lang", F.coalesce("lang", predicted)).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of Jaccard similarity 0.8 or more join, the one with the smallest doc_id stays.

    Rows of one doc_id are different documents if their texts differ: of those the group's one is the one with the
    smallest hash of its text. Of rows with equal doc_id and text the least by the other columns stays.
    """
    repeated = common.stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        found = jaccard.join(docs.select("doc_id", "text"), NEAR)
        others = common.stored(found.where("component_id <> doc_id").select("doc_id"), "near-duplicates")
        return docs.join(common.small(others), "doc_id", "left_anti").select(*docs.columns)
    again, node, group, first = common.free_names(docs.columns, "again", "node", "group", "first")
    marked = docs.join(common.small(repeated.withColumn(again, F.lit(True))), "doc_id", "left")
    marked = common.stored(marked.withColumn(node, F.when(F.col(again), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))).drop(again), "nodes")
    found = jaccard.join(marked.select(F.col(node).alias("doc_id"), "text"), NEAR).select(F.col("doc_id").alias(node), F.col("component_id").alias(group))
    named = found.distinct().join(marked.select(node, "doc_id").distinct(), node)
    stay = common.stored(named.groupBy(group).agg(F.min(F.struct("doc_id", node)).alias(first)).select(F.col(f"{first}.{node}").alias(node)), "near-duplicates")
    rest = marked.join(common.small(stay), node, "left_semi")
    one = F.min(F.struct(*docs.columns)).alias(first)
    return rest.groupBy(node).agg(one).select(*(F.col(first)[c].alias(c) for c in docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out words of passages that came earlier, and documents of which nothing is left; n_chars follows.

    Texts that lose no word stay as they are; of the others the words that stay are joined by one space.
    """
    columns = docs.columns
    mark, state = common.free_names(columns, "mark", "state")
    rows, kept = substrings.remove_repeats(docs.select("doc_id", "text"), PASSAGE_WORDS)
    changed = common.stored(rows.where("state <> 'whole'").select("doc_id", F.col("mark").alias(mark), F.col("state").alias(state), "at", "one").distinct(), "changed")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    whole = marked.join(common.small(changed.select("doc_id", mark)), ["doc_id", mark], "left_anti").select(*columns)
    texts = changed.where(F.col(state) == "cut").join(kept.where("kept <> ''"), ["at", "one"]).select("doc_id", mark, F.col("kept").alias("text"))
    cut = marked.drop("text", "n_chars").join(common.small(changed.where(F.col(state) == "cut").select("doc_id", mark)), ["doc_id", mark], "left_semi").join(texts, ["doc_id", mark])
    return whole.unionByName(cut.withColumn("n_chars", F.length("text").cast("long")).select(*columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokens.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packed)]
#: No SQL has the language network or the tokenizer: tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
