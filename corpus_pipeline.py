"""A training-corpus pipeline: five stages over `documents`, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumivox.llm import bpe, decontam, line_dedup, quality, simhash
from lumivox.llm.common import discard, table, written
from lumivox.llm.queries import tokenizer_file

OWN = "_pipeline_"  # before names of columns that a stage adds for itself


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of the whole table's rows of four folds in five.

    Null and empty texts get the score of the prior; repeated rows and rows without an id are judged like any other; all columns stay
    as they are, whatever their names. An empty table gives no rows.
    """
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score(docs, model, to=OWN + "score").where(F.col(OWN + "score") >= 0.3).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines, n_chars counted anew where one went; documents all of whose words were in repeated lines go.

    Null and empty texts stay; rows that share an id count as one document, and so do those without one, which come first; so
    repeated rows stay repeated. Columns named like the operator's own stay as they are. An empty table gives no rows.
    """
    clash = {c: OWN + c for c in docs.columns if c in ("n_lines", "n_removed")}
    left = line_dedup.dedup_lines(docs.withColumnsRenamed(clash)).where((F.col("n_removed") == 0) | F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.drop("n_lines", "n_removed").withColumnsRenamed({v: k for k, v in clash.items()}).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles, the one with the smallest doc_id.

    Of rows that repeat an id and its text one stays. Rows without an id stay. Texts without a word, null ones included,
    are copies of each other; texts of fewer than five words count as one shingle. An empty table gives no rows.
    """
    near = written(simhash.similar_documents(docs, words=5, similarity=0.8), "pipeline-near")
    go = near.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    again = near.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    some, rest = line_dedup.split_by_ids(docs, written(go.union(again).distinct(), "pipeline-touched"))
    left = some.join(go, "doc_id", "left_anti")
    text = F.xxhash64(F.col("text").isNull(), "text"), F.xxhash64(F.lit(1), "text")
    once = left.join(again, "doc_id", "left_semi").withColumns({OWN + "a": text[0], OWN + "b": text[1]}).dropDuplicates(["doc_id", OWN + "a", OWN + "b"])
    return rest.select(*docs.columns).union(left.join(again, "doc_id", "left_anti").select(*docs.columns)).union(once.select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Rows that share an id count as one document; rows without one are judged by their text alone. Null and empty texts hold
    nothing; repeated rows go or stay together. An empty table or an empty benchmark takes nothing away.
    """
    items, text = table(spark, sf_dir, "benchmark"), F.xxhash64("text")
    named, nameless = docs.where("doc_id is not null"), docs.where("doc_id is null")
    found = written(decontam.find(named, items).select("doc_id").distinct(), "pipeline-found")
    some, rest = line_dedup.split_by_ids(named, found)
    left = rest.select(*docs.columns).union(some.join(found, "doc_id", "left_anti").select(*docs.columns))
    if nameless.isEmpty():
        return left
    held = written(decontam.find(nameless.select(text.alias("doc_id"), "text"), items).select(F.col("doc_id").alias(OWN + "text")).distinct(), "pipeline-found")
    return left.union(nameless.withColumn(OWN + "text", text).join(held, OWN + "text", "left_anti").select(*docs.columns))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of each text; a null text has no ids, as an empty one. Repeated rows and null ids stay."""
    return bpe.encode(docs, tokenizer_file("byte_bpe_50k.json")).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", tokenized),
]

#: The classifier and the fingerprints aren't expressible in SQL: tests hold run() against a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from `documents` on, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
