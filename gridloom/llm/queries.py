"""The registered queries of the training-data operators: each applies its operator to the whole table it is meant for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import caps, cotraining, html_pages, jaccard, licenses, media, mixing, packing, substrings, toxicity
from .common import documents
from .oracles import ORACLES


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_pages.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the Jaccard links between all documents."""
    return jaccard.join(documents(spark, sf_dir)).drop("h")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by two co-trained views."""
    views = cotraining.views(documents(spark, sf_dir))
    return cotraining.score(views, cotraining.fit(views, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of near-duplicate vectors."""
    return caps.near(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a stored PNG, read back: sizes, checksums and a cosine-transform hash."""
    return media.read_media(media.to_media(documents(spark, sf_dir))).drop("error")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    import public_tokenizers

    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by trees fitted on the labelled rows that aren't held out."""
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License detections of every document."""
    return licenses.scan(documents(spark, sf_dir))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that windows of 35 words repeated anywhere cover, and a digest of what stays."""
    out = substrings.dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_html": op1_html, "op2_jaccard": op2_jaccard, "op3_quality": op3_quality, "op4_caps": op4_caps, "op5_media": op5_media, "op6_packing": op6_packing, "op7_mixing": op7_mixing, "op8_toxicity": op8_toxicity, "op9_licenses": op9_licenses, "op10_substrings": op10_substrings}

__all__ = ["ORACLES", "QUERIES"]
