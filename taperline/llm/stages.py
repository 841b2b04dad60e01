"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir); all but the last return the columns of ``docs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe as encoder
from . import decontaminate as leaks
from . import similar as near
from . import suffix_dedup as suffixes
from . import toxicity as toxic
from .queries import held_out, table, vocabulary
from .tables import packed, unpacked


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. The labels to learn from are those that op5 learns from."""
    model = toxic.fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out(5)))
    return unpacked(toxic.score_toxicity(packed(docs), model).where("predicted = 0"), docs.columns)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that are alike in 0.8 of their five-word shingles or more the row with the least doc_id stays."""
    return unpacked(near.keep_one_similar(packed(docs)), docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 200 bytes go out of the texts, the first stays; n_chars follows."""
    done = suffixes.suffix_dedup(packed(docs), keep="first", characters=True)
    whole = F.size("spans") == 0
    cut = done.select("doc_id", F.when(whole, F.col("text")).otherwise(F.col("kept")).alias("text"), *(["rest"] if "rest" in done.columns else []), whole.alias("whole"))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        cut = cut.withColumn("rest", F.col("rest").withField("n_chars", F.when(F.col("whole"), F.col("rest.n_chars")).otherwise(F.length("text").cast(kind))))
    return unpacked(cut, docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return unpacked(leaks.decontaminate(packed(docs), table(spark, sf_dir, "benchmark")), docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text, n_tokens, ids (little-endian unsigned 32-bit) and round_trip, which says that decoding gives the text back."""
    done = encoder.bpe_encode(docs, vocabulary(), decode=True)
    return done.select("doc_id", "text", "n_tokens", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
