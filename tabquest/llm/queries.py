"""The registered queries of the text operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabquest.llm import (
    alignment,
    decontaminate,
    fertility,
    html_text,
    language,
    packing,
    pii,
    secrets,
    simhash,
    spelling,
    token_counts,
    token_files,
    toxicity,
)
from tabquest.llm.shared import prepare, tokenizer_path
from tabquest.registry.common import table
from tabquest.session import work_dir

QUERIES: dict = {}
# No operator here can be written in SQL; tests compare each with a brute-force version.
ORACLES: dict = {}


def register(function):
    QUERIES[function.__name__] = function
    return function


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(prepare(spark), sf_dir, "documents")


@register
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written to token files and read back."""
    path = work_dir(spark, "token-files")
    token_files.write_token_files(documents(spark, sf_dir), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@register
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items found in each document; contaminated documents have at least one."""
    found = decontaminate.find_contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.transform("hits", lambda h: h["item_id"].cast("string")), ",")
    best = F.round(F.array_max(F.transform("hits", lambda h: h["score"])), 6)
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), items.alias("item_ids"), best.alias("best_score"))


@register
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    packed = packing.pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048)
    return packed.drop("ids")


@register
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of low quality and then toxicity of all documents, by a chain of two models."""
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.fit_chain(docs, labels, ["low_quality", "toxic"])
    scored = toxicity.score(docs, chain)
    return scored.withColumn("p_low_quality", F.round("p_low_quality", 6)).withColumn("p_toxic", F.round("p_toxic", 6))


@register
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract(table(prepare(spark), sf_dir, "pages"))


@register
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts and a digest of the base kinds, and all spans."""
    found = pii.find_pii(documents(spark, sf_dir))
    counts = [pii.count_kind("spans", kind).cast("long").alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    base = F.sha2(pii.span_text("spans", pii.BASE_KINDS), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), pii.span_text("spans").alias("spans"))


@register
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents under a public vocabulary."""
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


@register
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those that are not held out."""
    docs = documents(spark, sf_dir)
    return language.predict(docs, language.fit(docs))


@register
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of all documents."""
    found = simhash.with_components(documents(spark, sf_dir), shingle_words=3, radius=3, seed=42)
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


@register
def op10_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, fertility measures and verdict of all documents."""
    return fertility.judge(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


@register
def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: counts and a digest of the base kinds, and all spans."""
    found = secrets.find_secrets(documents(spark, sf_dir))
    counts = [secrets.count_kind("spans", kind).alias(f"n_{kind}") for kind in secrets.BASE_KINDS]
    base = F.sha2(secrets.span_text("spans", secrets.BASE_KINDS), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), secrets.span_text("spans").alias("spans"))


@register
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the form they are a variant of."""
    return spelling.variant_groups(documents(spark, sf_dir), least_letters=7, least_count=2, ratio=10, drop_every=31)


@register
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of all documents between a byte-level and a piece vocabulary."""
    files = [tokenizer_path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.align(documents(spark, sf_dir), *files)[0]
