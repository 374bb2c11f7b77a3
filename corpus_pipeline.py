"""The corpus pipeline: toxicity, near-duplicates, benchmark leaks, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents; the last adds size, source_size,
target, taken and copies.

Defined for all stages: columns besides doc_id, text and source pass through, whatever their names; very long texts
are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import decontaminate, mixing, pii, simhash, toxicity
from driftline.llm.common import Written, scratch, table

TOXIC_AT = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score TOXIC_AT or more go. Null and empty texts have the score of a text without words; rows
    with a null id are scored and never learnt from; repeated rows stay or go together; without confirmed toxic rows
    all stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, score_col="__toxicity").where(F.col("__toxicity") < TOXIC_AT).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (5-word shingles): the one of least id, a null id last,
    ties by a hash. Null, empty and wordless texts are one group; of rows equal in id and text one stays."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; benchmark passages are cut from the others. Null and empty texts hit nothing and
    stay as they are; equal texts fare alike, whatever their ids."""
    return _counted(decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark")), docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become [KIND]; of overlapping spans the first one's kind. All rows stay, null and
    empty texts as they are."""
    return _counted(pii.redacted(docs), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the copies that bring each source to its target; documents without a copy go, among them null and
    empty texts. A null source is a source; rows equal in id, text and source are taken together; input columns
    named like the added ones are replaced."""
    return mixing.mixed(docs)


def _counted(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """n_chars follows the text where the table has it."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
]

#: The classifier and the fingerprints of the first stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's input and scratch tables go once its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch():
            done = Written(stage(spark, docs, sf_dir), f"stage-{name}").keep()
        if before:
            before.drop()
        docs, before = done.df, done
    return STAGES[-1][1](spark, docs, sf_dir)
