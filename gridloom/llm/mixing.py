"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, in DataFrame functions only.

1. Sources in code-point order (null last) get the weights of a repeating cycle and share all tokens; a target stops
   at MOST_REPEATS times its source's size and the excess is shared again by weight (a water level over the sorted ratios).
2. The tokens, in blocks of BLOCK tokens, are apportioned to the sources by the highest quotients target / (2k + 1).
3. Each source's documents fall by a seeded hash into shards of about SHARD tokens; the source's blocks are apportioned
   to its shards in the same way.  So no window holds more than a shard, however much one source has.
4. A shard's documents stand in seeded order.  Whole passes come first, then a run of blocks from a seeded start,
   round the shard; a document's words in that run are taken once more.

Only tables of sources and shards are sorted as a whole, never documents.  Defined results: null text has size 0 and
taken 0; null source is a source of its own; an empty table gives no rows; repeated rows count as often as they stand
there; reruns and other partitionings agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

# The cycle of weights, tokens of a block, the most passes over a source, tokens of a shard.
WEIGHTS, BLOCK, MOST_REPEATS, SHARD, SEED = (5, 2, 1), 16, 3, 1 << 20, "mix-1"
WORD = "[^\\x20\\x09-\\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(*cols: Column) -> Column:
    """60 bits of md5 over the seed and the values."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), *(c.cast("string") for c in cols))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target per source; sizes has source and size."""
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    src = src.withColumn("rank", F.row_number().over(by_name))
    src = src.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
    src = src.withColumn("cap", F.col("source_size") * MOST_REPEATS)
    every = Window.partitionBy(F.lit(0))
    upto = every.orderBy((F.col("cap") / F.col("weight")).asc(), "rank").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0))
    src = src.withColumn("level", rest / left)
    # the level of the first source, in this order, that its share doesn't fill
    src = src.withColumn("water", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "rank", "level"))).over(every)["level"])
    return src.select("source", "rank", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("water")).alias("target"))


def apportion(parties: DataFrame, group: list[str], key: str, weight: str, seats: str) -> DataFrame:
    """parties plus `quota`: `seats` of each group dealt by Sainte-Lague to its parties (ties: smaller key).

    Divisors (sum of weights) / (seats - parties) and / (seats + parties) bound every quota below and above, so only
    about three quotients a party are ranked, not one for each seat.
    """
    one = Window.partitionBy(*(group or [F.lit(0)]))
    df = parties.withColumn("_n", F.count("*").over(one)).withColumn("_w", F.sum(weight).over(one))
    at = lambda d: F.floor(F.col(weight) * d / F.col("_w") + 0.5)
    df = df.withColumn("_low", F.when((F.col("_w") > 0) & (F.col(seats) > F.col("_n")), F.greatest(F.lit(0), at(F.col(seats) - F.col("_n")) - 1)).otherwise(0).cast("long"))
    df = df.withColumn("_high", F.when(F.col("_w") > 0, at(F.col(seats) + F.col("_n")) + 1).otherwise(0).cast("long"))
    df = df.withColumn("_open", F.col(seats) - F.sum("_low").over(one))
    more = df.where("_high > _low").select("*", F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_k"))
    more = more.withColumn("_place", F.row_number().over(one.orderBy((F.col(weight) / (2 * F.col("_k") + 1)).desc(), key, "_k")))
    won = more.groupBy(*group, key).agg(F.sum((F.col("_place") <= F.col("_open")).cast("long")).alias("_won"))
    # group and key are numbers that are never null
    return df.join(won, [*group, key], "left").select(*parties.columns, (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("quota"))


def mix_sizes(sizes: DataFrame) -> DataFrame:
    """The mix of a table doc_id, source, size, h (its text's hash, which deals rows without id); adds source_size, target, taken, and the run: run_from, run_words, start (words before the document in its shard), shard_size, passes."""
    src = targets(sizes)
    src = src.withColumn("blocks", F.greatest(F.floor(F.sum("source_size").over(Window.partitionBy(F.lit(0))) / BLOCK), F.lit(1)))
    src = apportion(src, [], "rank", "target", "blocks").select(F.col("source").alias("src"), "rank", "source_size", "target", "quota")
    docs = sizes.join(src, sizes["source"].eqNullSafe(src["src"])).drop("src")
    shards_of = F.greatest(F.ceil(F.col("source_size") / SHARD), F.lit(1))
    docs = docs.withColumn("hash", seeded(F.coalesce(F.col("doc_id").cast("string"), F.col("h").cast("string")))).withColumn("shard", F.col("hash") % shards_of)
    shards = docs.groupBy("rank", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("seats"))
    shards = apportion(shards, ["rank"], "shard", "shard_size", "seats").select(F.col("rank").alias("r"), F.col("shard").alias("s"), "shard_size", F.least(F.col("quota") * BLOCK, F.col("shard_size") * MOST_REPEATS).alias("wanted"))
    docs = docs.join(shards, (docs["rank"] == shards["r"]) & (docs["shard"] == shards["s"])).drop("r", "s", "quota")
    z = F.greatest(F.col("shard_size"), F.lit(1))
    docs = docs.withColumn("passes", F.floor(F.col("wanted") / z)).withColumn("run_words", F.col("wanted") - F.col("passes") * z)
    docs = docs.withColumn("run_from", seeded(F.col("rank"), F.col("shard")) % F.ceil(z / BLOCK) * BLOCK)
    order = Window.partitionBy("rank", "shard").orderBy("hash", "doc_id", "size", "h").rowsBetween(Window.unboundedPreceding, 0)
    docs = docs.withColumn("start", F.sum("size").over(order) - F.col("size"))

    def shared(a: Column) -> Column:
        return F.greatest(F.least(F.col("start") + F.col("size"), a + F.col("run_words")) - F.greatest(F.col("start"), a), F.lit(0))

    return docs.withColumn("taken", (F.col("passes") * F.col("size") + shared(F.col("run_from")) + shared(F.col("run_from") - F.col("shard_size"))).cast("long")).drop("hash")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """mix_sizes() for documents; texts are read once, for their sizes."""
    return mix_sizes(cut(docs.select(docs[key].alias("doc_id"), docs[source].alias("source"), size_of(docs[text]).alias("size"), F.xxhash64(docs[text]).alias("h")), "mix"))
