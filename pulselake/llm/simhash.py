"""SimHash near-dedup: fingerprints, pigeonhole blocks, Hamming check, components.

Two fingerprints with up to 3 differing bits agree on at least 3 of 6 blocks of bits, so each
fingerprint is filed under the 20 choices of 3 blocks (about 32 bits each) and pairs are sought within a
file. Copies share one fingerprint and are linked by it alone.

A file with more than FILE_ROWS fingerprints (a large family of near copies) is not paired up. Its members
are linked through centres instead: each member lists all fingerprints within 1 bit (as a host) and within
2 bits (as a guest). Members within 3 bits share a centre that one hosts and the other visits; host and
guests of a centre link to its smallest host, which is within 3 bits of each. Rows grow with the members, not
with their pairs, and no link between components is lost.

Components: alternating large-star and small-star rounds until the edges rest.

Defined results: a null or empty text has fingerprint zero, linked like any other; rows with equal ids each
get their own fingerprint; a null id is never the smallest of a component unless all ids are null (then null);
an empty table gives an empty table; other columns pass through `near_duplicates` unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulselake.llm.common import LOWER, UPPER, fresh, stored, text_blocks

SHINGLE = 3
MOST_BITS = 3
SEED = 42
BLOCK_BITS = (11, 11, 11, 11, 10, 10)
FILE_ROWS = 64
#: Shingles of a text that are unpacked to bits at once.
UNPACKED = 1 << 16


def fingerprint(words: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text's words: a bit is set if over half of the shingles' XXH64 have it."""
    import xxhash

    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    text = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    ends = ends[len(words) - n :].tolist()
    pieces = [text[a:b] for a, b in zip(starts, ends, strict=True)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, UNPACKED):
        rows = hashes[at : at + UNPACKED].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """id, sig (XXH64 of the text), fp (the 64 bits as a long) of each row of docs."""
    id_type = docs.schema[id_col].dataType.simpleString()
    lower = bytes.maketrans(UPPER.encode(), LOWER.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, data, offsets in text_blocks(batch.column(1)):
                block = data.tobytes().translate(lower)
                at = offsets.tolist()
                found += [fingerprint(block[a:b].split(), shingle, seed) for a, b in zip(at, at[1:], strict=False)]
            fp = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp)], names=["id", "sig", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("sig")).mapInArrow(run, f"id {id_type}, sig long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def block_masks(bits: tuple[int, ...] = BLOCK_BITS, most: int = MOST_BITS) -> list[int]:
    """The masks of all choices of blocks that two fingerprints within `most` bits agree on at least once."""
    masks, at = [], 0
    for width in bits:
        masks.append(((1 << width) - 1) << at)
        at += width
    return [_signed(sum(c)) for c in combinations(masks, len(bits) - most)]


def links(nodes: DataFrame, most: int = MOST_BITS, file_rows: int = FILE_ROWS) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) within `most` = 3 bits that join up their components."""
    masks = block_masks(most=most)
    filed = F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("file"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("f")
    filed = nodes.select("fp", filed).select("fp", "f.file", "f.key")
    shared = filed.groupBy("file", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Spark counts rows that are listed out (20 and 2081 of each) as if they were one, so it would broadcast them: these joins are merged.
    members = stored(filed.hint("merge").join(shared, ["file", "key"]), "simhash-files")
    few = members.where(F.col("n") <= file_rows)
    a, b = few.alias("a"), few.alias("b")
    close = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= most
    pairs = a.join(b, (F.col("a.file") == F.col("b.file")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & close)
    pairs = pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    one = [1 << i for i in range(64)]
    host = [0, *map(_signed, one)]
    guest = [_signed(x ^ y) for x, y in combinations(one, 2)]
    many = members.where(F.col("n") > file_rows).select("fp").distinct()
    at = F.explode(F.concat(F.transform(F.lit(host), lambda m: F.struct(m.alias("m"), F.lit(True).alias("host"))), F.transform(F.lit(guest), lambda m: F.struct(m.alias("m"), F.lit(False).alias("host"))))).alias("v")
    listed = many.select("fp", at).select("fp", F.col("fp").bitwiseXOR(F.col("v.m")).alias("centre"), F.col("v.host").alias("host"))
    hosts = listed.where("host").groupBy("centre").agg(F.min("fp").alias("b"))
    through = listed.hint("merge").join(hosts, "centre").where("fp <> b").select(F.least("fp", "b").alias("a"), F.greatest("fp", "b").alias("b"))
    return pairs.unionByName(through).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: the smallest node of each node's component, for nodes that have an edge (a, b)."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: larger neighbours of u move to the smallest of its neighbourhood.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, most: int = MOST_BITS, seed: int = SEED) -> DataFrame:
    """id, sig, fp, component_id (the smallest id reachable over links, itself included), root (the smallest fingerprint of the component) of each row of docs."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), most))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(firsts, "root").select(F.col("fp").alias("n_fp"), "component_id", "root")
    return prints.join(named, F.col("fp") == F.col("n_fp")).select("id", "sig", "fp", "component_id", "root")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without near duplicates: of each component the row with the smallest id stays.

    Null ids come last; of rows with that id the one with the smallest XXH64 of its text stays, and of equal rows one.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    order = F.struct(F.col("id").isNull().alias("late"), F.col("id").alias("id"), F.col("sig").alias("sig"))
    kept = found.groupBy("root").agg(F.min(order).alias("k")).select("k.*")
    key = [fresh(n, docs) for n in ("late_", "id_", "sig_")]
    held = docs.withColumns({key[0]: F.col(id_col).isNull(), key[1]: F.coalesce(id_col, F.lit(0).cast(docs.schema[id_col].dataType)), key[2]: F.xxhash64(text_col)})
    side = kept.select(F.col("late").alias(key[0]), F.coalesce("id", F.lit(0).cast(docs.schema[id_col].dataType)).alias(key[1]), F.col("sig").alias(key[2]))
    place = fresh("place_", docs)
    one = F.row_number().over(W.partitionBy(*key).orderBy(F.xxhash64(*[f"`{c}`" for c in docs.columns])))
    return held.join(side, key, "left_semi").withColumn(place, one).where(F.col(place) == 1).drop(*key, place)
