"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.llm.common import materialize, settle, ship_package, table
from gustline.llm.decontaminate import contaminated
from gustline.llm.neardup import near_duplicates
from gustline.llm.packing import pack
from gustline.llm.pii import redact
from gustline.llm.quality_classifier import score, train
from gustline.llm.tokens import default_tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier, fitted on these documents, scores at least 0.3.

    Null and empty texts are scored as texts without words; rows with the same
    doc_id or text are scored each on their own and come out alike; all columns
    stay, whatever their names; an empty table gives no rows.
    """
    settle(spark)
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, 0.3, keep=True).where("__predicted = 1").select(*_names(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles, the one with the smallest doc_id.

    Rows with one doc_id are one document and stay or go together; rows without
    a doc_id, and texts that are null or without words, stay; all columns stay;
    an empty table gives no rows.
    """
    return _without(docs, near_duplicates(docs).where(~F.col("kept")).select("doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Rows with one doc_id go together if one of them holds an item; rows without
    a doc_id, and null and empty texts, stay; all columns stay; without items
    everything stays; an empty table gives no rows.
    """
    return _without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; null texts stay null, other columns as they are, each row on its own."""
    settle(spark)
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths up to 1024 tokens, each a sequence of its own.

    A null or empty text is one piece with the end id; rows with the same doc_id
    and rows without one are packed each on their own; other columns are left
    out; an empty table gives no rows.
    """
    settle(spark)
    return pack(docs, default_tokenizer(), most=1024, with_ids=False, keep=100_000)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]

#: SQL can't express a fitted network, a subword tokenizer or a latent space: tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but those whose doc_id is in ``gone``; a document without an id stays."""
    gone = materialize(gone.select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti").select(*_names(docs))


def _names(docs: DataFrame) -> list[str]:
    """Column names, quoted: they may hold dots."""
    return [f"`{c.replace('`', '``')}`" for c in docs.columns]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
