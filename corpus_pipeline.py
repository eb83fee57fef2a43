"""Corpus preparation: five stages over the table of documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``.  A driver writes each result and reads it back
as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import langid, minhash, mix, pack, pii
from bitloom.llm.common import Workspace, read, scratch

#: Least share of the predicted language in a document that stays.
LEAST_SHARE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which one language prevails, or all if no language could be learned; texts without letters go."""
    found = langid.identify(docs, F.lit(True), names=("__pred", "__score"))
    stays = (F.col("__pred") != langid.UNKNOWN) & (F.col("__score") >= LEAST_SHARE)
    unlearned = (F.col("__pred") == langid.UNKNOWN) & F.col("text").rlike(r"\p{L}")  # 'und' despite letters
    return found.where(stays | unlearned).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8)."""
    return minhash.keep_one(docs, n=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; null texts stay null."""
    found = pii.find(docs, names=("__base", "__spans", "__redacted"))
    new = {"text": F.when(F.col("text").isNotNull(), F.col("__redacted"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("text").isNotNull(), F.length("__redacted")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their targets."""
    return mix.repeat_to_targets(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of bounded length."""
    return pack.pack_documents(docs)


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mixture),
    ("best_fit_packing", sequences),
]

#: Language inference, signatures, tokens and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, as a written table; what stages and their operators wrote on the way is deleted."""
    ws = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        with scratch():
            after = ws.table(stage(spark, docs, sf_dir), name)
        if i:
            ws.drop(docs)
        docs = after
    return docs
