"""Corpus preparation in four stages, each one of the corpus operators.

1. ``quality``: a classifier learns ``labels.quality`` and rejects poor documents.
2. ``near_duplicates``: of documents linked by 5-word shingles (Jaccard similarity of
   0.8 or more, chains included) the one of least id stays. Rows that share an id or have none are
   documents of their own.
3. ``repeated_passages``: words in 13-word windows that an earlier document also has
   are removed.
4. ``packing``: what is left is encoded and packed into sequences of 4096 tokens.

``run`` writes each stage to the shared folder and reads it again for the next. SQL can't
express the classifier, so there is no ``ORACLE_SQL``; ``tests/llm`` holds every stage
against a brute-force version. Null and empty texts are documents without words; columns
besides ``doc_id``, ``text`` and ``n_chars`` go along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlog.llm.common import drop, save, table
from kvlog.llm.packing import pack_documents
from kvlog.llm.quality import score_documents
from kvlog.llm.queries import vocabulary
from kvlog.llm.similar import similar_documents
from kvlog.llm.substrings import remove_repeats


def _private(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with all columns but ``doc_id`` and ``text`` under names of ours, which no
    operator's columns can clash with, and these names. No column is there twice: texts
    would be written and sent twice."""
    own = [c if c in ("doc_id", "text") else f"_own_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*own), own


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not reject."""
    rows, own = _private(docs)
    scored = score_documents(rows, table(spark, sf_dir, "labels"), columns=own)
    return scored.where("predicted = 1").select(*own).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates. Every row is a document of its own,
    whatever its id: rows that share an id, or have none, are linked by their texts only."""
    rows, own = _private(docs)
    rows = save(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    linked = similar_documents(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "class_id")
    least = F.min(F.struct("doc_id", "_row")).alias("least")
    keep = rows.select("_row", "doc_id").join(linked, "_row").groupBy("class_id").agg(least).select("least._row")
    return rows.join(keep, "_row", "left_semi").select(*own).toDF(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of repeated windows; a changed text is its words
    joined by one space, and its ``n_chars`` is counted anew."""
    rows, own = _private(docs)
    cut = remove_repeats(rows, with_text=True)
    changed = F.col("kept").isNotNull()
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return cut.select(*[F.when(changed, new[c]).otherwise(F.col(o)).alias(o) if c in new else F.col(o) for c, o in zip(docs.columns, own)]).toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return pack_documents(_private(docs)[0].select("doc_id", "text"), vocabulary("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = save(docs, name)
            drop(before)
    return docs
