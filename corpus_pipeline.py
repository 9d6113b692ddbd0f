"""A training corpus from raw documents: five stages, each applying one operator of the subpackage llm to all that the stage
before it kept. Stages 1 to 4 return the columns of documents; the last returns the packed pieces.

Null text is empty; it has no language, so stage 1 rejects it, as it does texts without a letter. Very long texts go through
every stage whole. Rows are judged by their text and id together: rows that share an id or have none are kept unless their
texts are copies, and of rows equal in both one stays after stage 2. Null sources are one source. Ties go to the least
id, then to the order of texts. Empty tables give empty results. Columns of other names than those of documents are dropped
by stage 1, whatever their names.

A stage's working tables last until the next stage of the same run begins, so its result is to be written before that, as
run() does; those of other runs are left alone, and the last stage's last as long as the session. SQL can't express the
pipeline (stages 1, 2, 3 and 5 are fitted or iterative), so ORACLE_SQL is None and tests hold each stage against a plain
version.
"""

from __future__ import annotations

import contextvars
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.llm import langid, mixing, packing, simhash, substring
from webstrata.llm.common import cut, owned, sweep

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose words are less than this sure of any language is rejected.
LEAST_SCORE = 0.4


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The run that stages belong to; stages that are called by themselves are one run.
RUN = contextvars.ContextVar("run", default="by itself")


def stage(plan: Stage) -> Stage:
    """A stage that first drops the working tables of the one before it in its run, whose result has been written."""

    @wraps(plan)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        owner = f"stages of {RUN.get()}"
        sweep(spark, owner)
        with owned(owner):
            return plan(spark, docs, sf_dir)

    return run


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without a letter, and those that no language fits, go."""
    model = langid.fitted(docs, F.lit(True))
    return langid.predict(docs, model, COLUMNS).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(COLUMNS)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the least id stays; of texts that are alike (five-word shingles, similarity 0.8 or more), one."""
    return simhash.drop_copies(docs.select(COLUMNS))


@stage
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the words of passages that stand earlier; texts that lose nothing are unchanged."""
    out = substring.deduplicate(docs, keep=["lang", "source"], as_is=True)
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents, so that sources have their target weights, in a global random order."""
    return mixing.mix(docs.select(COLUMNS)).select(COLUMNS)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all copies with their place in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = RUN.set(uuid.uuid4().hex)
    try:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for _, plan in STAGES[:-1]:
            docs = cut(plan(spark, docs, sf_dir))
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        RUN.reset(token)
