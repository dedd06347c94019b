"""The training-data pipeline: toxicity, near-duplicates, decontamination, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its result is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``. Models, groups, budgets and packs are made
from the stage's own input; only labels and benchmark items come from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdsignal.llm import decontaminate, mixing, near_dup, packing, toxicity
from crowdsignal.llm.common import drop, settle, small, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, by what the labels outside the held-out fifth teach.

    Null and empty texts have no matches and stay, unless all labels are toxic; repeated rows are judged alike.
    """
    scorer = toxicity.learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    model = spark.sparkContext.broadcast(scorer)
    scored = toxicity.add_columns(docs, "text", "_toxicity double", lambda texts: [(model.value.score(x),) for x in texts])
    return scored.where(F.col("_toxicity") < 0.5).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, by five-word shingles at 80 %: that with the smallest id, repeated rows once.

    A null id stays only where its group has no other. Rows with one id and different texts are told apart.
    """
    kept = near_dup.kept_rows(docs, n_words=5, percent=80).withColumnsRenamed({"doc_id": "kept_id", "text_key": "kept_key"})
    key = near_dup.row_key(F.col("doc_id"), F.col("text"))
    same = key[0].eqNullSafe(F.col("kept_id")) & (key[1] == F.col("kept_key"))
    one = docs.join(kept.where("copies = 1"), same, "left_semi")
    repeated = kept.where("copies > 1")
    if repeated.isEmpty():
        return one.select(docs.columns)
    # copies are reduced within each task first, so that a row repeated many times does not gather
    many = docs.join(small(repeated), same, "left_semi").groupBy(*key).agg(F.first(F.struct(*docs.columns)).alias("row")).select("row.*")
    return one.select(docs.columns).union(many)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; each of repeated rows goes or stays."""
    names = docs.columns
    marked = decontaminate.with_leaks(docs, table(spark, sf_dir, "benchmark"))
    return marked.where(F.size("leaks") == 0).select(names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at weights 5, 2 and 1: documents repeated by epoch, the one at a budget's end cut at the word.

    Texts without words are kept once; a null source is one of its own.
    """
    return mixing.mixed_documents(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of 2,048 token ids; null and empty texts are a lone end mark."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: Learned scores and token ids are beyond SQL; tests/llm/test_pipeline.py holds run() against brute force and its parts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Once a stage's result is written, what it was made from is deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settle(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
