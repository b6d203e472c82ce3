"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acequia.llm import (
    bond,
    chat,
    chunk_dedup,
    decontaminate,
    language,
    licenses,
    merkle,
    packing,
    pii,
    quality,
    simhash,
    suffix_dedup,
    toxicity,
)
from acequia.session import materialize

TOKENIZER_KEY = "acequia.llm.tokenizer"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(spark: SparkSession) -> str:
    """The tokenizer's file: ``acequia.llm.tokenizer`` of the session, else the public one installed."""
    named = spark.conf.get(TOKENIZER_KEY, None)
    if named:
        return named
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, pii.session_key(spark), out="p").select(
        "doc_id", "p.text", "p.n_found", "p.n_replaced"
    )


def op2_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack_documents(docs, tokenizer_file(spark), with_ids=False)
    return pieces.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op3_chat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame(
        [(-7, 0, "user", says), (-7, 1, "assistant", says)],
        "conv_id long, turn long, role string, text string",
    )
    turns = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    chunks = materialize(chat.format_conversations(turns.union(more)), "chat")
    return chat.conversation_digests(chunks)


def op4_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), out="c")
    return found.select(
        "doc_id",
        "c.n_words",
        "c.n_hit",
        "c.n_items",
        F.sha2(F.array_join("c.items", ","), 256).alias("items_sha256"),
        "c.contaminated",
    )


def op5_simhash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op6_licenses(spark, sf_dir):
    """Documents as files ``source/lang/doc_id``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licenses.scan(docs.select(path.alias("path"), "text")).select(
        F.regexp_extract("path", r"(-?\d+)$", 1).try_cast("long").alias("doc_id"),
        "path",
        "license",
        F.round("score", 9).alias("score"),
        "evidence",
        F.array_join("candidates", " | ").alias("candidates"),
    )


def op7_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select(
        F.col("id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "quality",
    )


def op8_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit_model(docs)
    found = language.identify(docs.select("doc_id", "text"), model, out="l")
    return found.select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "l.lang_pred", "l.score"
    )


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.predict(docs, model, out="t").select("doc_id", "t.*")


def op10_suffix_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeated(docs).select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.col("text").contains("\n")
    claimed = [F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in fields]
    leaves = docs.withColumn("leaf", merkle.leaf(*map(F.col, fields)))
    leaves = leaves.withColumn("claim", F.when(tampered, merkle.leaf(*claimed)).otherwise(F.col("leaf")))
    return merkle.prove(merkle.manifest(leaves, claim="claim")).withColumnRenamed("id", "doc_id")


def op12_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunk_dedup.find_copies(docs).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


def op13_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return bond.mine(bond.vectors(rows, label, F.col("vec_id") % 50 == 0))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_packing": op2_packing,
    "op3_chat": op3_chat,
    "op4_decontamination": op4_decontamination,
    "op5_simhash": op5_simhash,
    "op6_licenses": op6_licenses,
    "op7_quality": op7_quality,
    "op8_language": op8_language,
    "op9_toxicity": op9_toxicity,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_merkle": op11_merkle,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}
