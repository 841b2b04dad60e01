"""The queries opN_<name>: each operator over its whole table, with production parameters, and the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, decontaminate, license_scan, lm_score, sharding, simhash, spelling, substring_dedup, suffix_dedup, toxicity
from . import chat_format as chat
from . import quality_rules as quality
from .license_sql import license_sql
from .plain_sql import CENTROIDS_SQL, SPELLING_SQL, WINDOWS_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


#: What the two turns of the added conversation say: the template's own control strings.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text")
    )
    done = chat.chat_format(chat.messages_from_rows(rows.unionByName(added)))
    read = done.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
select conv_id,
  count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(role) + length(regexp_replace(text, '(\\|### |</turn>)', '\\\1', 'g')) + 14) as bigint) as formatted_chars
from turns group by conv_id
"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return done.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), length=200, keep="none")
    return done.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        suffix_dedup.removed_bytes(F.col("spans")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def held_out(every: int) -> Column:
    """Whether crc32 of doc_id as text leaves 0 when divided by ``every``; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(5))
    model = toxicity.fit_toxicity(docs, labels)
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out(5).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), decode=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = license_scan.license_scan(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_sentences", F.array_join("sentence_ids", ";").alias("sentence_ids"), "license", F.array_join("licenses", ";").alias("licenses"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    done = lm_score.lm_score(table(spark, sf_dir, "documents"), fold)
    return done.select("doc_id", (F.col("fold") == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "matches", "doc_start", "doc_end")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), length=50)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"), dims=64, k=16, rounds=3, scale=64, seed=1)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_chat_format, op3_simhash, op4_suffix_dedup, op5_toxicity, op6_bpe, op7_sharding, op8_license_scan, op9_lm_score, op10_decontaminate,
        op11_spelling, op12_substring_dedup, op13_centroids,
    )
}
ORACLE_SQL = {"op2_chat_format": OP2_SQL, "op8_license_scan": license_sql(), "op11_spelling": SPELLING_SQL, "op12_substring_dedup": WINDOWS_SQL, "op13_centroids": CENTROIDS_SQL}
