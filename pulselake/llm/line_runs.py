"""Line dedup with levelled sorted runs of line hashes.

A store holds the hashes of all lines seen so far, with the first document of each, as runs: tables
bucketed and sorted by hash. A new batch is reduced to one row for each of its hashes, anti-joined
with the runs (bucket by bucket, in sorted order) and what is new becomes a run of level 0. When a
level has `fanout` runs they are merged into one run of the next level, so a batch meets a number of
runs that grows with the logarithm of the batches.

A line's hash is 128 bits, of the line stripped at both ends with A-Z lower-cased. Keys under
`min_chars` code points are never duplicates. Within a document repeated lines are not duplicates of
each other: only lines first held by another document go.

Defined results: a null or empty text is one empty line; rows with a null id hold nothing and keep all
their lines; rows with equal ids count as one document, each with its own lines; an empty table gives an empty table; other
columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.llm.common import ASCII_SPACE, CHECKED_PAGES, PLAIN_FILES, ascii_lower, fresh, partitions, shared_path, stored

MIN_CHARS = 10
#: A hash is hot with more than this part of all rows.
HOT = 2000
#: Rows of a run that a task writes, at least: each task and file that is written starts processes on local files.
TASK_ROWS = 1 << 18
ADDED = ("kept_", "n_lines_", "n_dropped_")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def key_hash(key: Column) -> Column:
    """128 bits as two longs."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """id, sig (XXH64 of the text, which tells rows with equal ids apart), pos (number of the line), h1, h2 of each line with a key."""
    text = F.col(text_col)
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("sig"), F.posexplode(lines_of(text)).alias("pos", "line"))
    keys = lines.where(F.col("id").isNotNull() & (F.length("line") >= min_chars)).select("id", "sig", "pos", line_key(F.col("line")).alias("key"))
    return keys.where(F.length("key") >= min_chars).select("id", "sig", "pos", key_hash(F.col("key")).alias("h")).select("id", "sig", "pos", "h.h1", "h.h2")


class LineStore:
    """Levelled runs of line hashes in the shared folder. tasks: that write a run; as many as it has buckets, unless fewer are asked for."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None, tasks: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or partitions(spark)
        self.tasks = min(tasks or self.buckets, self.buckets)
        self.levels: list[list[DataFrame]] = []
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.written = 0

    def _run(self, rows: DataFrame) -> DataFrame:
        """rows (h1, h2, first_id) as a table bucketed and sorted by hash, one file a bucket; buckets share tasks."""
        self.written += 1
        name = f"{self.name}_{self.written}"
        rows = rows.repartition(self.buckets, "h1", "h2").coalesce(self.tasks)
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").options(**PLAIN_FILES, **CHECKED_PAGES).option("path", shared_path(self.spark, name)).saveAsTable(name)
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> None:
        """Adds the hashes of a batch (id, h1, h2) that no run has; the smallest id of the batch holds each."""
        new = keys.groupBy("h1", "h2").agg(F.min("id").alias("first_id"))
        for run in self.runs():
            new = new.join(run.select("h1", "h2"), ["h1", "h2"], "left_anti")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._run(new))
        self._compact()

    def _compact(self) -> None:
        at = 0
        while at < len(self.levels):
            if len(self.levels[at]) >= self.fanout:
                merged = self.levels[at][0]
                for run in self.levels[at][1:]:
                    merged = merged.unionByName(run)
                if at + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[at + 1].append(self._run(merged))
                self.levels[at] = []
            at += 1

    def firsts(self) -> DataFrame:
        """h1, h2, first_id of every hash in the store."""
        runs = self.runs()
        found = runs[0]
        for run in runs[1:]:
            found = found.unionByName(run)
        return found


def dropped_keys(keys: DataFrame, firsts: DataFrame) -> DataFrame:
    """id, sig, drops: the numbers of the lines that each document loses because a document before it holds them.

    A hash of more than 1 / HOT of all rows is hot; there are fewer than HOT of them, so they are joined by broadcast
    where the rows are. The others are joined by a shuffle in which no hash has more than that share.
    """
    counts = stored(keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "line-counts")
    rows = keys.count()
    hot = F.broadcast(counts.where(F.col("n") > rows / HOT).select("h1", "h2"))
    hot_firsts = F.broadcast(firsts.join(hot, ["h1", "h2"], "left_semi"))
    shared = firsts.join(counts.where(F.col("n") <= rows / HOT).select("h1", "h2"), ["h1", "h2"])
    lost = keys.join(hot_firsts, ["h1", "h2"]).unionByName(keys.join(hot, ["h1", "h2"], "left_anti").join(shared, ["h1", "h2"]))
    return lost.where(F.col("id") > F.col("first_id")).groupBy("id", "sig").agg(F.collect_list("pos").alias("drops"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, batches: int = 4, fanout: int = 2, added: tuple[str, str, str] = ADDED) -> DataFrame:
    """docs with three more columns, named by `added`: the text without dropped lines, how many lines it had, and how many it lost. Such columns of docs are replaced.

    The ids are taken in `batches` ranges of about equal rows, smallest first, so the first holder of a
    line is the smallest id of all.
    """
    spark = docs.sparkSession
    keys = stored(line_keys(docs, id_col, text_col, min_chars), "line-keys")
    rows, cuts = keys.agg(F.count(F.lit(1)), F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000)).first()
    store = LineStore(spark, fanout, tasks=max(1, -(-rows // TASK_ROWS)))
    cuts = sorted(set(cuts or []))
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = keys
        if low is not None:
            part = part.where(F.col("id") >= low)
        if high is not None:
            part = part.where(F.col("id") < high)
        store.add(part)
    drops = dropped_keys(keys, store.firsts())
    lines, gone = fresh("lines_", docs), fresh("gone_", docs)
    met = docs.alias("d").join(drops.alias("x"), (F.col(f"d.{id_col}") == F.col("x.id")) & (F.xxhash64(f"d.{text_col}") == F.col("x.sig")), "left")
    met = met.select("d.*", lines_of(F.col(f"d.{text_col}")).alias(lines), F.col("x.drops").alias(gone))
    # The numbers that stay come from a hash set, so a text of many lines and many losses takes time in proportion.
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(F.col(lines), i))
    left = fresh("left_", docs)
    met = met.withColumn(left, F.when(F.col(gone).isNull(), F.col(lines)).otherwise(stay))
    return met.select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added],
        F.array_join(left, "\n").alias(added[0]),
        F.size(lines).cast("long").alias(added[1]),
        (F.size(lines) - F.size(left)).cast("long").alias(added[2]),
    )
