"""Mixing sources to target weights with Sainte-Lague apportionment.

Targets: sources share `share` times all words by weight; a target stops at `epochs` times its source's
size and the excess goes to the others by weight. That fixed point is found at once: in the order of
(cap / weight) the capped sources come first, so a running sum gives the level of the rest.

Seats: the mix is cut into blocks of equal tokens. Blocks go to sources by the highest quotients
target / (2 * seat + 1), then, within a source, to its shards by the highest quotients words / (2 * seat + 1).
Only quotients near the cut are listed: a party's seats lie within q * n / (2 * seats) + 2 of its exact
quota q, so the rows listed grow with the parties and not with the seats.

Selection: a shard's documents stand in seeded order on a line that is run through up to `epochs` times;
the shard's blocks are a run from a seeded place. A document takes the words of it that the run covers.
Shards hold a bounded part of a source, so a source of any share is dealt to many tasks.

A source's taken words differ from its target by the rounding to whole blocks. The sources themselves, one row each, are
ordered in one task.

Defined results: a null text has size 0 and takes 0; a null source is one source, last in order; rows with
equal ids stand side by side and each takes its own words; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulselake.llm.common import stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = 7
#: Words of a shard that is aimed at, and the bounds of the number of shards of all words.
SHARD_WORDS, LEAST_SHARDS, MOST_SHARDS = 1 << 17, 32, 4096
#: The largest block; small corpora use smaller blocks, so that each source gets many, and a block is never larger than
#: the smallest target, so that each source with words gets one.
MOST_BLOCK = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hex_number(digest: Column, at: int) -> Column:
    """Seven hex digits of a digest as a number."""
    return F.conv(F.substring(digest, at, 7), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """From (source, source_size): also weight and target, and the words of all sources as total.

    One row for each source stands in one task here; sources are a dimension, their documents are elsewhere.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    everything = W.partitionBy()
    df = sources.withColumn("weight", pick).withColumn("total", F.sum("source_size").over(everything))
    df = df.withColumn("cap", F.col("source_size") * float(epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    line = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = line.rowsBetween(W.unboundedPreceding, -1)
    rest = line.rowsBetween(0, W.unboundedFollowing)
    df = df.withColumn("level", (F.col("total") * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # The first source in line whose cap is above the level is the first that is not capped.
    df = df.withColumn("free_level", F.when(F.col("level") <= F.col("ratio"), F.col("level")))
    df = df.withColumn("water", F.first("free_level", ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.when(F.col("water").isNull() | (F.col("ratio") <= F.col("water")), F.col("cap")).otherwise(F.col("water") * F.col("weight"))
    return df.select("source", "source_size", "total", "weight", target.alias("target"))


def apportioned(parties: DataFrame, group: list[str], party: str, votes: str, seats: str, cap: str) -> DataFrame:
    """parties with their seats as `quota`: the `seats` of each group by the highest votes / (2 * seat + 1), at most `cap` each; ties to the first party.

    No party's exact share of the seats may lie over its cap by more than one seat.
    """
    whole = W.partitionBy(*group).orderBy(F.col(party).asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    df = parties.withColumn("n_", F.count(F.lit(1)).over(whole)).withColumn("v_", F.sum(votes).over(whole))
    exact = F.when(F.col("v_") > 0, F.col(votes) * F.col(seats) / F.col("v_")).otherwise(F.lit(0.0))
    df = df.withColumn("q_", exact).withColumn("slack_", F.when(F.col(seats) > 0, F.col("q_") * F.col("n_") / (2.0 * F.col(seats))).otherwise(F.lit(0.0)) + 2.0)
    df = df.withColumn("low_", F.least(F.col(cap), F.greatest(F.lit(0), F.floor(F.col("q_") - F.col("slack_"))))).withColumn("high_", F.least(F.col(cap), F.ceil(F.col("q_") + F.col("slack_"))))
    df = df.withColumn("sure_", F.sum("low_").over(whole))
    listed = df.where((F.col("high_") > F.col("low_")) & (F.col(votes) > 0)).select("*", F.explode(F.sequence("low_", F.col("high_") - 1)).alias("seat_"))
    listed = listed.withColumn("quotient_", F.col(votes) / (2.0 * F.col("seat_") + 1.0))
    rank = F.row_number().over(W.partitionBy(*group).orderBy(F.col("quotient_").desc(), F.col(party).asc_nulls_last(), "seat_"))
    won = listed.withColumn("rank_", rank).where(F.col("rank_") <= F.col(seats) - F.col("sure_"))
    keys = list(dict.fromkeys([*group, party]))
    more = won.groupBy(*[F.col(c).alias(f"{c}_won_") for c in keys]).agg(F.count(F.lit(1)).alias("more_"))
    on = [F.col(c).eqNullSafe(F.col(f"{c}_won_")) for c in keys]
    joined = df.join(more, on, "left")
    return joined.select(*parties.columns, (F.col("low_") + F.coalesce("more_", F.lit(0))).cast("long").alias("quota"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """id, size, source, source_size, target, taken for each row of docs."""
    sized = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    per_source = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs), "mix-sources")

    shards = F.least(F.lit(MOST_SHARDS), F.greatest(F.lit(LEAST_SHARDS), F.floor(F.col("total") / SHARD_WORDS)))
    part = F.when(F.col("total") > 0, F.floor(shards * F.col("source_size") / F.col("total"))).otherwise(F.lit(0))
    per_source = per_source.withColumn("n_shards", (part + 1).cast("long"))
    n_sources = F.count(F.lit(1)).over(W.partitionBy())
    least = F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(W.partitionBy()))
    block = F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCK), F.floor(F.col("total") / (1000.0 * n_sources)), least)).cast("long")
    per_source = per_source.withColumn("block", block).withColumn("all_", F.lit(1))
    # Targets add up to this whole share of the words; a sum of theirs would hang on the order of adding.
    per_source = per_source.withColumn("seats", F.ceil(F.col("total") * min(share, float(epochs)) / F.col("block"))).withColumn("most", F.ceil(float(epochs) * F.col("source_size") / F.col("block")))
    quotas = stored(apportioned(per_source, ["all_"], "source", "target", "seats", "most"), "mix-quotas").drop("all_", "seats", "most", "weight")

    placed = sized.withColumn("digest", digest).alias("d").join(quotas.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")))
    placed = placed.select("d.*", "source_size", "target", "block", "quota", F.pmod(hex_number(F.col("digest"), 1), F.col("n_shards")).alias("shard"))
    shard_sizes = placed.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("block").alias("block"), F.first("quota").alias("seats"))
    shard_sizes = shard_sizes.withColumn("most", F.ceil(float(epochs) * F.col("words") / F.col("block")))
    shard_quota = apportioned(shard_sizes, ["source"], "shard", "words", "seats", "most")
    start = F.pmod(hex_number(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce("source", F.lit("null")), F.col("shard").cast("string"))), 8), F.greatest(F.col("words"), F.lit(1)))
    shard_quota = shard_quota.select(F.col("source").alias("s_source"), F.col("shard").alias("s_shard"), "words", start.alias("start"), F.least(F.col("quota") * F.col("block"), F.col("words") * epochs).alias("run"))

    line = W.partitionBy("source", "shard").orderBy("digest", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    stood = placed.withColumn("end", F.sum("size").over(line)).join(shard_quota, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("shard") == F.col("s_shard")))
    first = F.when(F.col("words") > 0, F.pmod(F.col("end") - F.col("size") - F.col("start"), F.col("words"))).otherwise(F.lit(0))
    stood = stood.withColumn("at", first)

    def covered(turn: int) -> Column:
        low = F.col("at") + turn * F.col("words")
        return F.greatest(F.lit(0), F.least(low + F.col("size"), F.col("run")) - F.greatest(low, F.lit(0)))

    taken = covered(-1)
    for turn in range(epochs):
        taken = taken + covered(turn)
    return stood.select("id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"))
