"""A corpus pipeline of five stages over ``documents``: toxicity, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. Stage tables
are written as Parquet to the shared folder and read again, so a lost executor costs no more than the stage at hand.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import op2_byte_bpe, op3_simhash, op4_toxicity, op9_soft_mixing, op10_pii_crf
from colloquy.llm.common import shared_folder, table, tune
from colloquy.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts toxic go."""
    tune(spark)
    return op4_toxicity.keep_clean(docs, op4_toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    tune(spark)
    return op3_simhash.keep_one(docs, size=op3_simhash.STAGE_SHINGLE, reach=op3_simhash.REACH)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind."""
    tune(spark)
    return op10_pii_crf.redact(docs, op10_pii_crf.train())


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the target mix asks for."""
    tune(spark)
    return op9_soft_mixing.mix(docs, op9_soft_mixing.labelled_domains(docs, table(spark, sf_dir, "labels")), op9_soft_mixing.TARGETS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts, checked by decoding them."""
    tune(spark)
    return op2_byte_bpe.tokenize(docs, *vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_to_targets),
    ("byte_bpe", encode_tokens),
]
#: SimHash, trained models and byte pairs have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
