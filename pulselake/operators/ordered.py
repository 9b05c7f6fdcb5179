"""Operators on ordered rows: islands, stability cuts, rolling scores, and the folds that no window frame can express."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Runs of spans that one call of the trigger fold gets.
RUNS = 512

#: Microseconds of one key that are ordered together.
CHUNK = 3_600_000_000


def _in_chunks(df: DataFrame, key: str, time: str, chunk: int) -> tuple[DataFrame, list[str]]:
    """df with chunk_ (its time in units of `chunk`), and what a window within one chunk is partitioned by."""
    return df.withColumn("chunk_", F.floor(F.col(time) / chunk)), [key, "chunk_"]


def _with_carry(rows: DataFrame, key: str, ends: DataFrame) -> DataFrame:
    """rows with what `ends` (key, chunk_ and more) holds for their chunk; null keys meet."""
    more = [c for c in ends.columns if c not in (key, "chunk_")]
    side = ends.select(F.col(key).alias("end_key_"), F.col("chunk_").alias("end_chunk_"), *more)
    met = rows.join(side, F.col(key).eqNullSafe(F.col("end_key_")) & F.col("chunk_").eqNullSafe(F.col("end_chunk_")), "left")
    return met.drop("end_key_", "end_chunk_")


def since_previous(df: DataFrame, key: str, time: str, ident: str, chunk: int = CHUNK) -> DataFrame:
    """df with since_: time since the row before it of its key, null for the first.

    Rows are ordered within chunks of time only; what passes from chunk to chunk is one row a chunk, so a key that
    holds most rows is still many tasks.
    """
    rows, by = _in_chunks(df, key, time, chunk)
    ends = rows.groupBy(*by).agg(F.max(time).alias("last_"))
    ends = ends.select(*by, F.last("last_", ignorenulls=True).over(W.partitionBy(key).orderBy("chunk_").rowsBetween(W.unboundedPreceding, -1)).alias("carry_"))
    rows = rows.withColumn("lag_", F.lag(time).over(W.partitionBy(*by).orderBy(time, ident)))
    return _with_carry(rows, key, ends).withColumn("since_", F.col(time) - F.coalesce("lag_", "carry_")).drop("lag_", "carry_", "chunk_")


def numbered(df: DataFrame, key: str, time: str, ident: str, new: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """df with `name`: the number of rows so far of its key, itself included, for which `new` holds; ordered in chunks."""
    rows, by = _in_chunks(df.withColumn("new_", F.coalesce(new, F.lit(True)).cast("long")), key, time, chunk)
    ends = rows.groupBy(*by).agg(F.sum("new_").alias("in_chunk_"))
    ends = ends.select(*by, F.sum("in_chunk_").over(W.partitionBy(key).orderBy("chunk_").rowsBetween(W.unboundedPreceding, -1)).alias("carry_"))
    rows = rows.withColumn("count_", F.sum("new_").over(W.partitionBy(*by).orderBy(time, ident).rowsBetween(W.unboundedPreceding, 0)))
    return _with_carry(rows, key, ends).withColumn(name, F.col("count_") + F.coalesce("carry_", F.lit(0))).drop("count_", "carry_", "chunk_", "new_")


def last_known(df: DataFrame, key: str, time: str, order: list, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """df with `name`: the last `value` that is not null up to and with each row of its key, by time and then `order`; in chunks."""
    rows, by = _in_chunks(df.withColumn("value_", value), key, time, chunk)
    place = [F.col(time), *order]
    ends = rows.where("value_ is not null").groupBy(*by).agg(F.max_by("value_", F.struct(*place)).alias("end_"))
    every = rows.select(*by).distinct().withColumnsRenamed({key: "every_key_", "chunk_": "every_chunk_"})
    ends = every.join(ends, F.col("every_key_").eqNullSafe(F.col(key)) & (F.col("every_chunk_") == F.col("chunk_")), "left")
    line = W.partitionBy("every_key_").orderBy("every_chunk_").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(F.col("every_key_").alias(key), F.col("every_chunk_").alias("chunk_"), F.last("end_", ignorenulls=True).over(line).alias("carry_"))
    rows = rows.withColumn("here_", F.last("value_", ignorenulls=True).over(W.partitionBy(*by).orderBy(*place).rowsBetween(W.unboundedPreceding, 0)))
    return _with_carry(rows, key, ends).withColumn(name, F.coalesce("here_", "carry_")).drop("here_", "carry_", "chunk_", "value_")


def gap_islands(df: DataFrame, key: str, time: str, ident: str, most: int, chunk: int = CHUNK) -> DataFrame:
    """df with island: runs of its key's rows without a gap over `most`, numbered from 1."""
    return numbered(since_previous(df, key, time, ident, chunk), key, time, ident, F.col("since_") > most, "island", chunk).drop("since_")


def ranked(df: DataFrame, value: str, ident: str, name: str, chunk: int = 65536, ranges: int = 4096) -> DataFrame:
    """df with `name`: its place, from 0, in the order of (value, ident), null values first. Both are whole numbers.

    Places are counted within one value and range of ids; the counts of values are summed within `ranges` ranges of them, and only
    the counts of those ranges in one task.
    """
    low, high = df.agg(F.min(value), F.max(value)).first()
    width = max(1, -(-(high - low + 1) // ranges)) if low is not None else 1
    part = F.coalesce(F.floor((F.col(value) - (low or 0)) / width), F.lit(-1))
    sizes = df.groupBy(value).agg(F.count(F.lit(1)).alias("size_")).withColumn("range_", part)
    whole = sizes.groupBy("range_").agg(F.sum("size_").alias("n_"))
    whole = whole.select("range_", F.coalesce(F.sum("n_").over(W.orderBy("range_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead_"))
    within = F.sum("size_").over(W.partitionBy("range_").orderBy(F.col(value).asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.withColumn("within_", within).join(whole, "range_").select(F.col(value).alias("size_of_"), (F.col("ahead_") + F.coalesce("within_", F.lit(0))).alias("below_"))
    inside = numbered(df, value, ident, ident, F.lit(True), "inside_", chunk)
    return inside.join(sizes, F.col(value).eqNullSafe(F.col("size_of_"))).withColumn(name, F.col("below_") + F.col("inside_") - 1).drop("below_", "inside_", "size_of_")


def framed(df: DataFrame, key: str, time: str, ident: str, before: int, block: int = 65536) -> tuple[DataFrame, list[str]]:
    """df with place_, own_ and block_, and what to partition a frame of up to `before` preceding rows by.

    A block holds `block` rows of one key and a copy of the `before` rows ahead of them, for which own_ is false: drop
    those once the frame is computed.
    """
    block = max(block, before)
    rows = numbered(df, key, time, ident, F.lit(True), "place_").withColumn("home_", F.floor((F.col("place_") - 1) / block))
    late = (F.col("place_") - 1) % block >= block - before
    copies = F.when(late, F.array(F.col("home_"), F.col("home_") + 1)).otherwise(F.array("home_"))
    return rows.withColumn("block_", F.explode(copies)).withColumn("own_", F.col("block_") == F.col("home_")).drop("home_"), [key, "block_"]


def split_at_gaps(df: DataFrame, key: str, time: str, ident: str, most: int) -> DataFrame:
    """key, island, t_first, t_last, n: runs without a gap over `most`."""
    return gap_islands(df, key, time, ident, most).groupBy(key, "island").agg(F.min(time).alias("t_first"), F.max(time).alias("t_last"), F.count(F.lit(1)).alias("n"))


def stable_runs(df: DataFrame, key: str, time: str, ident: str, height: str, sigma: float, gap: int) -> DataFrame:
    """df with good: within sigma standard deviations of its key's mean, and no gap over `gap` before it."""
    stats = df.groupBy(key).agg(F.avg(height).alias("mean_"), F.stddev_pop(height).alias("sd_"))
    joined = since_previous(df, key, time, ident).join(stats, key)
    inside = F.abs(F.col(height) - F.col("mean_")) <= sigma * F.col("sd_")
    return joined.withColumn("good", inside & (F.coalesce("since_", F.lit(0)) <= gap)).drop("mean_", "sd_", "since_")


def rate_cut(df: DataFrame, time: str, control: Column, interval: int, low: int, high: int, sigma: float) -> DataFrame:
    """slot, n, good: time slots whose count lies in [low, high], with over half the median of control records, within sigma deviations of such slots' mean."""
    slots = df.groupBy(F.floor(F.col(time) / interval).alias("slot")).agg(F.count_if(~control).alias("n"), F.count_if(control).alias("n_control"))
    middle = slots.where("n_control > 0").agg(F.percentile("n_control", 0.5).alias("median"))
    slots = slots.withColumn("one", F.lit(1)).join(middle.withColumn("one", F.lit(1)), "one").drop("one")
    usable = F.col("n").between(low, high) & (F.col("n_control") > F.col("median") / 2)
    stats = slots.where(usable).agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"))
    slots = slots.withColumn("usable", usable).withColumn("one", F.lit(1)).join(stats.withColumn("one", F.lit(1)), "one")
    return slots.select("slot", "n", (F.col("usable") & (F.abs(F.col("n") - F.col("mean")) <= sigma * F.col("sd"))).alias("good"))


def rolling_zscore(df: DataFrame, key: str, order: tuple[str, str], value: str, length: int) -> DataFrame:
    """df with z against the `length` rows before it, where there are that many and they differ."""
    rows, by = framed(df, key, *order, length)
    frame = W.partitionBy(*by).orderBy("place_").rowsBetween(-length, -1)
    scored = rows.withColumn("n_", F.count(value).over(frame)).withColumn("m_", F.avg(value).over(frame)).withColumn("s_", F.stddev_pop(value).over(frame))
    z = F.when((F.col("n_") == length) & (F.col("s_") > 0), (F.col(value) - F.col("m_")) / F.col("s_"))
    return scored.where("own_").withColumn("z", z).drop("n_", "m_", "s_", "own_", "block_", "place_")


def dead_time_fold(df: DataFrame, key: str, time: str, ident: str, block: int, closed: bool = False, chunk: int | None = None) -> DataFrame:
    """The rows that start a dead time: the first of each key, then each first one at least `block` after the last start (more than that if `closed`).

    Which rows these are hangs on all rows before. A chunk of time is entered with the end of the last dead time, which lies
    less than `block` past the chunk's begin, so the rows of that stretch and the first one after it are all that can start
    first. For each of them the chunk says when its last dead time ends; one task per key chains these few rows, and the chunks
    are then folded from where they are entered. A stream without a gap is many tasks.
    """
    chunk = chunk or max(CHUNK, 64 * block)
    side, kind, names = "right" if closed else "left", df.schema[key].dataType.simpleString(), df.columns
    rows = df.withColumn("chunk_", F.floor(F.col(time) / chunk))

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        t, at = np.sort(part[time].to_numpy()), int(part["chunk_"].iloc[0])
        after = np.searchsorted(t, t + block, side)
        last = np.where(after < len(t), after, np.arange(len(t)))
        for _ in range(int(len(t)).bit_length()):
            last = last[last]
        first = np.unique(t, return_index=True)[1]
        first = first[: np.searchsorted(t[first], at * chunk + block, "right") + 1]
        return pd.DataFrame({"chunk_key_": [part[key].iloc[0]], "at": [at], "enter": [t[first].tolist()], "leave": [(t[last[first]] + block).tolist()]})

    def chained(part: pd.DataFrame) -> pd.DataFrame:
        part, free, out = part.sort_values("at").reset_index(drop=True), None, []
        for enter, leave in zip(part["enter"], part["leave"]):
            out.append(free)
            i = 0 if free is None else int(np.searchsorted(enter, free, side))
            free = int(leave[i]) if i < len(enter) else free
        return pd.DataFrame({"chunk_key_": part["chunk_key_"], "at": part["at"], "free_": pd.array(out, "Int64")})

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([time, ident])
        stamps, keep, free = part[time].to_numpy(), [], part["free_"].iloc[0]
        at = 0 if pd.isna(free) else int(np.searchsorted(stamps, int(free), side))
        while at < len(stamps):
            keep.append(at)
            at = int(np.searchsorted(stamps, stamps[at] + block, side))
        return part.iloc[keep][names]

    told = rows.select(key, time, "chunk_").groupBy(key, "chunk_").applyInPandas(summed, f"chunk_key_ {kind}, at long, enter array<long>, leave array<long>")
    entered = told.groupBy("chunk_key_").applyInPandas(chained, f"chunk_key_ {kind}, at long, free_ long")
    met = rows.join(entered, F.col(key).eqNullSafe(F.col("chunk_key_")) & (F.col("chunk_") == F.col("at"))).drop("chunk_key_", "at")
    return met.groupBy(key, "chunk_").applyInPandas(fold, df.schema)


#: Rows of an exponential mean that are summed at once.
STRETCH = 128


def exponential_mean(x: np.ndarray, keep: float, start: float) -> np.ndarray:
    """The means after each value: keep times the mean before and the rest of the value."""
    n = -(-len(x) // STRETCH)
    rows = np.zeros(n * STRETCH)
    rows[: len(x)] = x
    steps = np.arange(STRETCH)
    share = np.tril((1 - keep) * keep ** np.maximum(steps[:, None] - steps, 0))
    part, left = rows.reshape(n, STRETCH) @ share.T, keep ** (steps + 1)
    for i in range(n):
        part[i] += left * start
        start = part[i, -1]
    return part.reshape(-1)[: len(x)]


def averaged(df: DataFrame, key: str, order: tuple[str, str], value: str, down: int) -> DataFrame:
    """key, place (from 0), first and last (times) and value: the mean of each `down` rows in a row of a key; a rest of fewer is left out."""
    time, ident = order
    rows = numbered(df.where(F.col(value).isNotNull()), key, time, ident, F.lit(True), "place_").withColumn("place", F.floor((F.col("place_") - 1) / down))
    met = rows.groupBy(key, "place").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.avg(value).alias("value"), F.count(F.lit(1)).alias("n_"))
    return met.where(F.col("n_") == down).drop("n_")


def exponential_trigger(df: DataFrame, key: str, order: tuple[str, str], value: str, short: float, long: float, sigma: float, block: int = 65536) -> DataFrame:
    """df with fast, slow and fired: two exponential means with memories of `short` and `long` rows and the recursive deviation of the slow one; fired where they part by sigma deviations.

    Each row hangs on all before it. What a block of rows does to the means is linear in the means it starts from, and
    quadratic for the deviation, so each block is summed up by six numbers; one task per key chains those, and the blocks
    are then run from their starts. Rows without a value get null and are passed over.
    """
    a, b = float(np.exp(-1 / short)), float(np.exp(-1 / long))
    (time, ident), names = order, df.columns
    rows = numbered(df.where(F.col(value).isNotNull()), key, time, ident, F.lit(True), "place_").withColumn("block_", F.floor((F.col("place_") - 1) / block))
    kind = df.schema[key].dataType.simpleString()

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        v = part.sort_values("place_")[value].to_numpy(float)
        base, x = v[0], v - v[0]
        fast, means, left = exponential_mean(x, a, 0.0)[-1], exponential_mean(x, b, 0.0), b ** np.arange(len(x))
        slow, off = means[-1], x - np.concatenate([[0.0], means[:-1]])
        flat, tilt, bend = (exponential_mean(y, b, 0.0)[-1] for y in (off * off, -2 * off * left, left * left))
        return pd.DataFrame({"start_key_": [part[key].iloc[0]], "block": [part["block_"].iloc[0]], "n": [len(v)], "base": [base], "cf": [fast], "cs": [slow], "flat": [flat], "tilt": [tilt], "bend": [bend]})

    def chained(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block").reset_index(drop=True)
        fast = slow = part["base"].iloc[0]
        var, out = 0.0, []
        for r in part.itertuples():
            out.append((fast, slow, var))
            s = slow - r.base
            var = b**r.n * var + max(r.flat + r.tilt * s + r.bend * s * s, 0.0)
            fast, slow = r.base + a**r.n * (fast - r.base) + r.cf, r.base + b**r.n * s + r.cs
        part[["fast0", "slow0", "var0"]] = out
        return part[["start_key_", "block", "fast0", "slow0", "var0"]]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place_").reset_index(drop=True)
        fast, slow, var = (float(part[c].iloc[0]) for c in ("fast0", "slow0", "var0"))
        x = part[value].to_numpy(float)
        means = exponential_mean(x, b, slow)
        before = np.concatenate([[slow], means[:-1]])
        spread = np.concatenate([[var], exponential_mean((x - before) ** 2, b, var)[:-1]])
        part["fast"], part["slow"] = exponential_mean(x, a, fast), means
        part["fired"] = (spread > 0) & (np.abs(part["fast"].to_numpy() - before) > sigma * np.sqrt(spread))
        return part[[*names, "fast", "slow", "fired"]]

    blocks = rows.select(key, "block_", "place_", value).groupBy(key, "block_").applyInPandas(summed, f"start_key_ {kind}, block long, n long, base double, cf double, cs double, flat double, tilt double, bend double")
    starts = blocks.groupBy("start_key_").applyInPandas(chained, f"start_key_ {kind}, block long, fast0 double, slow0 double, var0 double")
    met = rows.join(starts, F.col(key).eqNullSafe(F.col("start_key_")) & (F.col("block_") == F.col("block"))).drop("start_key_", "block")
    schema = StructType(list(df.schema.fields)).add("fast", "double").add("slow", "double").add("fired", "boolean")
    rest = df.where(F.col(value).isNull()).select(*df.columns, F.lit(None).cast("double").alias("fast"), F.lit(None).cast("double").alias("slow"), F.lit(None).cast("boolean").alias("fired"))
    return met.groupBy(key, "block_").applyInPandas(run, schema).unionByName(rest)
