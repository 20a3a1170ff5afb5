"""The corpus pipeline: toxicity, near duplicates, repeated passages, mixing, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs.  All but the last return the columns of documents, and drop others.

Defined results: rows are told apart by doc_id and text, so different texts that share a doc_id, and texts without one, pass
all stages on their own; null and empty texts pass the first three stages, hold no words for the mix to take, and are
therefore not in the packing; null lang, source and n_chars are values like others; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import jaccard, mixing, packing, substrings, toxicity
from gridloom.llm.common import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(df.schema["n_chars"].dataType)).select(*COLUMNS)


#: Names of a document's parts that tell it apart: whether it has no id, the id or 0, and its text's hash.
KEY = ["_none", "_id", "_h"]


def _keyed(df: DataFrame, h: Column | None = None) -> DataFrame:
    """df with KEY, whose columns are never null, so that joins and windows by it share one exchange."""
    return df.withColumns({"_none": F.col("doc_id").isNull(), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_h": F.xxhash64("text") if h is None else h})


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text isn't predicted toxic; equal texts fare alike."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.flagged(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of Jaccard links one document: that with the smallest id (none last), of those the one with the smallest hash of its text.

    Rows that are equal in id and text are one document (that with the smallest lang, source and n_chars).  Texts without words are documents of their own and all stay.
    """
    least = F.min(F.struct(*KEY)).alias("r")
    chosen = _keyed(jaccard.linked(docs).where("component is not null"), F.col("h")).groupBy("component").agg(least).select(*(f"r.{c}" for c in KEY))
    words = F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    once = _keyed(docs.where(words)).groupBy(*KEY).agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("r"))
    kept = once.join(chosen.hint("merge"), KEY, "left_semi").select(*(f"r.{c}" for c in COLUMNS))
    return kept.unionByName(docs.where(F.col("text").isNull() | ~words).select(*COLUMNS))


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that repeated windows cover; texts that lose nothing stay as they are."""
    found = substrings.dedup(docs).where("n_removed > 0")
    found = _keyed(found, F.col("h")).groupBy(*KEY).agg(F.min("kept").alias("kept"))  # repeated rows lose the same words
    rows = _keyed(docs).join(found.hint("merge"), KEY, "left")
    return _documents(rows.withColumn("text", F.coalesce("kept", "text")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one that it takes in part (the ends of a shard's run) with those words only.

    Rows that are equal in id and text take the runs that the mix gives to that many such rows, one each, by source.
    """
    runs = ("start", "size", "taken", "run_from", "run_words", "shard_size")
    sizes = cut(_keyed(docs).select("doc_id", *KEY, F.col("_h").alias("h"), "source", mixing.size_of(F.col("text")).alias("size")), "pipeline-sizes")
    mix = mixing.mix_sizes(sizes).where("size > 0")
    mix = mix.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("source", *runs))).alias("runs"))
    among = Window.partitionBy(*KEY).orderBy("source", "lang", "n_chars")
    rows = _keyed(docs.where(F.length("text") > 0)).withColumn("_place", F.row_number().over(among)).join(mix.hint("merge"), KEY)
    rows = rows.withColumn("_run", F.element_at("runs", F.col("_place"))).select(*COLUMNS, *(F.col(f"_run.{c}").alias(c) for c in runs)).where("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    part = F.col("taken") % F.col("size")
    # the words of the document in the run, or in the run's second half that begins the shard again
    low = lambda a: F.greatest(a - F.col("start"), F.lit(0))
    begin = F.when((F.col("run_from") < F.col("start") + F.col("size")) & (F.col("run_from") + F.col("run_words") > F.col("start")), low(F.col("run_from"))).otherwise(F.lit(0)).cast("int")
    words = F.split(F.regexp_replace("text", "^[\\x20\\x09-\\x0D]+", ""), "[\\x20\\x09-\\x0D]+")
    cutout = F.array_join(F.slice(words, F.least(begin, (F.col("size") - part).cast("int")) + 1, part.cast("int")), " ")
    copies = F.transform(F.sequence(F.lit(1), whole), lambda _: F.col("text"))
    texts = F.concat(F.when(whole > 0, copies).otherwise(F.array().cast("array<string>")), F.when(part > 0, F.array(cutout)).otherwise(F.array().cast("array<string>")))
    return _documents(rows.withColumn("text", F.explode(texts)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxic_out), ("ngram_jaccard_join", one_of_each), ("substring_dedup", repeats_out), ("source_mixing", mixed), ("packing", packed)]

#: Toxicity's trees can't be expressed in SQL; tests/llm compares the stages with plain Python on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.common import documents, shared_dir

    docs = documents(spark, sf_dir)
    top = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}-{name}")
        docs = spark.read.parquet(f"{top}/{k}-{name}")
    return docs
