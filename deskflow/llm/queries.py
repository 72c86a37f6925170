"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe
from .chat_format import format_conversations, read_turns, spoken_text
from .collocations import collocations
from .exact_dedup import exact_duplicates
from .language_model import score, train
from .license_scan import scan
from .mixing import mix
from .near_dedup import near_duplicates
from .packing import pack
from .prefix_trie import prefix_trie, spliced, turns_of
from .quality import judged
from .substring_dedup import remove_repeated_windows
from .toxicity import learn, learned_from, scored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_read(spark, sf_dir, "documents"))


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeated_windows(_read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = judged(_read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reasons")


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    places, base = F.col("base.word"), F.col("base.label")
    labels = F.array_sort(F.array_union(base, F.col("found.label")))
    missed = F.aggregate(F.col("found.strength"), F.lit(1.0), lambda a, x: a * (1 - x))
    return scan(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        (1 - missed * F.pow(F.lit(0.5), F.least(F.size("base"), F.lit(30)))).alias("score"),
    )


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "times")


@query
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    docs = _read(spark, sf_dir, "documents").withColumn("held_out", held_out)
    model = train(docs.where(~F.col("held_out")))
    done = score(docs, model, keep=("held_out",)).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")
    return done.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", perplexity)


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = learn(docs.where(learned_from()), labels.where(learned_from()))
    done = scored(docs.select("doc_id", "text"), model, drop_text=True)
    return done.select("doc_id", (~learned_from()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), extra={"ids_crc32": F.crc32("ids")})
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(extra)
    done = format_conversations(rows).select("conv_id", "formatted", "valid", read_turns(F.col("formatted")).alias("turns"))
    done = done.withColumn("loss", spoken_text(F.col("turns")))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


@query
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = near_duplicates(_read(spark, sf_dir, "documents"), width=2)
    return done.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_read(spark, sf_dir, "documents"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    turns = turns_of(_read(spark, sf_dir, "conversations"))
    done = prefix_trie(*spliced(turns, base=c - c % 100, taken=F.crc32(c.cast("string")) % 6, most=5))
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@query
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = byte_bpe.encode(_read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), "ids",
    )
    return byte_bpe.decode(ids, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
