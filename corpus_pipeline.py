"""A training corpus from the raw documents, in stages that each call one corpus operator.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns what it keeps; all but the
last return the columns of `documents`. Between stages the rows are written to the shared folder and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.llm.common import fresh, stored, table

#: Toxicity from which a document is rejected.
REJECTED = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score REJECTED or more; the machine learns from all labelled documents of the table.

    A null or empty text scores lowest and stays if the machine has seen both labels; equal rows are judged alike.
    """
    from pulselake.llm.toxicity import scored, train_from

    model = train_from(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    name = fresh("score_", docs)
    return scored(docs, model, name=name).where(F.col(name) < REJECTED).select(*[f"`{c}`" for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier document holds; every document stays, with what is left of its text.

    A null text stays null; rows without an id lose and hold no lines; rows with one id are one document.
    """
    from pulselake.llm.line_runs import dedup_lines

    left, n_lines, n_dropped = added = tuple(fresh(n, docs) for n in ("kept_", "n_lines_", "n_dropped_"))
    kept = dedup_lines(docs, added=added)
    changed = F.col(n_dropped) > 0
    value = {"text": F.when(changed, F.col(left)).otherwise(F.col("text")), "n_chars": F.when(changed, F.length(left).cast("long")).otherwise(F.col("n_chars"))}
    return kept.select(*[value.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component: the one with the smallest doc_id.

    Null ids come last, so a group without an id keeps one row too; of rows with that id, and of equal rows, one stays.
    Texts without words have fingerprint zero and are one group like any other.
    """
    from pulselake.llm.simhash import one_of_each

    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold any window of a benchmark item.

    Rows with one id are judged each by its text; texts without words hold none and stay; an empty benchmark drops nothing.
    """
    from pulselake.llm.decontaminate import decontaminate

    dirty = decontaminate(docs, table(spark, sf_dir, "benchmark")).where(F.size("hits") > 0)
    dirty = dirty.select("id", F.xxhash64("text").alias("sig")).alias("x")
    same = F.col("d.doc_id").eqNullSafe(F.col("x.id")) & (F.xxhash64("d.text") == F.col("x.sig"))
    return docs.alias("d").join(dirty, same, "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with how many.

    Texts without words take none and go; a null source is one source; equal rows are mixed each for itself.
    """
    from pulselake.llm.mixture import mix

    mixed = mix(docs)
    return mixed.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken").where("taken > 0")


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL has no string-kernel machine and no SimHash.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = stored(docs, f"stage-{at}")
    return docs
