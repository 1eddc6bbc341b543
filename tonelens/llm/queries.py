"""The operators as named queries: ``(spark, sf_dir) -> DataFrame``, each over the whole of its tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tonelens.llm import chat, decontaminate, language, packing, phrases, quality, recurrent_lm, setsketch, sharding, structure, token_spans, toxicity, url_rules
from tonelens.llm.common import read
from tonelens.plans.workdir import materialise

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


#: The rules of the URL query.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query
def op1_decontamination(spark, sf):
    found = decontaminate.find_items(read(spark, sf, "documents", "doc_id", "text"), read(spark, sf, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query
def op2_url_filter(spark, sf):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_rules.judge(read(spark, sf, "pages", "page_id", "url"), rules).drop("url")


@query
def op3_near_duplicates(spark, sf):
    return setsketch.near_duplicates(read(spark, sf, "documents", "doc_id", "text"))


def fold(key: str, folds: int) -> F.Column:
    """Remainder of the checksum of the key as text."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


@query
def op4_toxicity(spark, sf):
    docs = read(spark, sf, "documents", "doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf, "labels", "doc_id", "toxic").filter(fold("doc_id", 4) != 2))
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", "predicted")


@query
def op5_token_counts(spark, sf):
    """Tokens of every line of every document."""
    tokens = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return token_spans.tokens_by_line(read(spark, sf, "documents", "doc_id", "text"), tokens)


@query
def op6_lm_scoring(spark, sf):
    docs = read(spark, sf, "documents", "doc_id", "text")
    held_out = F.coalesce(fold("doc_id", 5) == 1, F.lit(False))
    language, counts = recurrent_lm.fit(docs.filter(~held_out))
    return recurrent_lm.score(docs, language, counts).withColumn("held_out", held_out)


@query
def op7_packing(spark, sf):
    docs = read(spark, sf, "documents", "doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), content="checksum")


@query
def op8_quality_rules(spark, sf):
    out = quality.judged(read(spark, sf, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op9_sharding(spark, sf):
    out = sharding.assign_shards(read(spark, sf, "documents", "doc_id", "text"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_chat_format(spark, sf):
    return chat.format_chats(read(spark, sf, "conversations", "conv_id", "turn", "role", "text"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns dropped, emptied, cut, repeated or given to the user, by a checksum of conversation and turn number."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fault = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    return turns.withColumn("fault", fault).filter("fault <> 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def with_digests(repaired: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of repaired turns, which come conversation by conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, own, conv_type = [], None, None  # own: conversation, its hash so far, and what parts its turns

        def results() -> pa.RecordBatch:
            convs, sums = zip(*done, strict=True) if done else ((), ())
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(convs, conv_type), pa.array(sums, pa.string())], names=["conv_id", "repaired_sha256"])

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if own is None or own[0] != conv:
                    if own is not None:
                        done.append((own[0], own[1].hexdigest()))
                    own = [conv, hashlib.sha256(), ""]
                if role is not None:
                    own[1].update(f"{own[2]}{role}:{text}".encode())
                    own[2] = "\n"
            yield results()
        if own is not None:
            done.append((own[0], own[1].hexdigest()))
            yield results()

    return repaired.mapInArrow(run, f"conv_id {repaired.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


@query
def op11_conversation_repair(spark, sf):
    given = read(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    turns = damaged(given)
    audits = materialise(structure.audit(turns), "audits")
    digests = with_digests(structure.repair(turns, audits)).withColumnRenamed("conv_id", "digested")
    every = given.select(F.col("conv_id").alias("conv")).distinct()
    found = every.join(audits, F.col("conv").eqNullSafe(F.col("conv_id")), "left").join(digests, F.col("conv").eqNullSafe(F.col("digested")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select(
        F.col("conv").alias("conv_id"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query
def op12_language_id(spark, sf):
    docs = read(spark, sf, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    model = language.fit(docs.filter(~held_out))
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


@query
def op13_phrase_mining(spark, sf):
    return phrases.collocations(read(spark, sf, "documents", "lang", "text"), top=2000)
