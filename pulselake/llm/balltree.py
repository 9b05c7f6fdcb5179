"""Exact top-k by integer inner product: a ball tree per shard, searched by branch and bound.

Vectors are dealt to shards of bounded size by a hash of their id. A shard builds a ball tree and meets the
queries block by block: a node's bound is q . centre + |q| * radius; the node with the highest bound is next, and one
is left out when no query's bound reaches its kth score so far, which all nodes of a shard share.
Shards share it too: a query starts with the kth score among the vectors of its own batch, and shards are searched in
three waves (a sixteenth, a quarter, all of them); each wave starts with the kth scores that the waves before reached.
A shard returns k rows for a query at most; the last step ranks those.

Scores are exact: components are whole numbers, and products are summed in doubles only while every sum stays
under 2^53, else in 64-bit integers. Bounds get a margin above their rounding error, and equal scores
are never pruned, so ties go to the smaller id.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors of
another length than a query's are not its candidates; rows with a query's own id are not its candidates;
a row repeated with one id is one candidate for each row; null ids take no part; fewer than k candidates
give fewer rows; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulselake.llm.common import mixed, partitions, stored

LEAF = 256
#: Queries in a block.
BLOCK = 512
#: Bytes of one Arrow batch on the way to a shard's task.
BATCH_BYTES = 32 << 20
_NONE = np.iinfo(np.int64).min


class BallTree:
    """Leaves of up to `leaf` vectors under balls: node i has center[i], radius[i], rows low[i]:high[i], children."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.nodes: list[tuple[np.ndarray, float, int, int, int, int]] = []
        self.leaf = leaf
        self.top = self._build(0, len(ids)) if len(ids) else -1

    def _build(self, low: int, high: int) -> int:
        part = self.rows[low:high].astype(np.float64)
        center = part.mean(axis=0)
        away = np.sqrt(((part - center) ** 2).sum(axis=1))
        left = right = -1
        if high - low > self.leaf and away.max() > 0:
            far = part[away.argmax()]
            other = part[((part - far) ** 2).sum(axis=1).argmax()]
            half = (high - low) // 2
            order = np.argpartition(part @ (other - far), half)
            order = np.concatenate([np.sort(order[:half]), np.sort(order[half:])])
            self.ids[low:high], self.rows[low:high] = self.ids[low:high][order], self.rows[low:high][order]
            left, right = self._build(low, low + half), self._build(low + half, high)
        self.nodes.append((center, float(away.max()), low, high, left, right))
        return len(self.nodes) - 1

    def search(self, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), k a query, the best first; _NONE where there are fewer. kth: scores known to be reached."""
        scores, found = np.full((len(queries), k), _NONE), np.full((len(queries), k), np.iinfo(np.int64).max)
        if self.top < 0:
            return scores, found
        kth = kth.copy()
        most = float(np.abs(queries).max(initial=0)) * float(np.abs(self.rows).max(initial=0)) * max(1, queries.shape[1])
        exact = np.float64 if most < 2**53 else np.int64
        q, rows, length = queries.astype(exact), self.rows.astype(exact), np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        qf, slack = queries.astype(np.float64), 1e-9 * most + 1e-6

        def bound(node: int, active: np.ndarray) -> np.ndarray:
            center, radius = self.nodes[node][:2]
            return qf[active] @ center + length[active] * radius + slack

        every = np.arange(len(queries))
        first = bound(self.top, every)
        line, turn = [(-first.max(), 0, self.top, every, first)], 0
        while line:
            # The node with the highest bound of any query is next; what no longer reaches a query's kth score is left out.
            _, _, node, active, reach = heapq.heappop(line)
            active = active[reach >= kth[active]]
            if not len(active):
                continue
            _, _, low, high, left, right = self.nodes[node]
            if left >= 0:
                for below in (left, right):
                    reach, turn = bound(below, active), turn + 1
                    heapq.heappush(line, (-reach.max(), turn, below, active, reach))
                continue
            here = (q[active] @ rows[low:high].T).astype(np.int64)
            here[query_ids[active][:, None] == self.ids[low:high]] = _NONE
            both = np.concatenate([scores[active], here], axis=1)
            names = np.concatenate([found[active], np.broadcast_to(self.ids[low:high], here.shape)], axis=1)
            best = np.lexsort((names, ~both), axis=1)[:, :k]
            scores[active], found[active] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
            kth[active] = np.maximum(kth[active], scores[active][:, k - 1])
        return scores, found


_PACKED = "dim int, shard int, block long, ids binary, x binary, kth binary"


def _batch(rows: list[tuple], kinds: tuple, schema: str) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in schema.split(", ")])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0, shard_rows: int = 50_000) -> DataFrame:
    """query_id, rank, id, score: the k highest inner products of floor(scale * x) of each query row with all other rows."""
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    x = F.col(vector_col)
    whole = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    read = vectors.where(F.col(id_col).isNotNull() & whole)
    read = read.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("x"), F.coalesce(is_query, F.lit(False)).alias("q"))
    shards = max(partitions(spark), read.count() // shard_rows)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asks = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            dims = np.asarray(batch.column(1).value_lengths())
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                own, rows = ids[at], _matrix(batch.column(1).take(pa.array(at)), dim).astype(np.int64)
                to = (mixed(own.astype(np.uint64)) >> np.uint64(32)).astype(np.int64) * shards >> 32
                out: list[tuple] = [(int(dim), int(s), -1, own[to == s].tobytes(), rows[to == s].tobytes(), b"") for s in np.unique(to)]
                asked = np.flatnonzero(asks[at])
                tree = BallTree(own.copy(), rows.copy()) if len(asked) else None
                for low in range(0, len(asked), BLOCK):
                    part = asked[low : low + BLOCK]
                    kth = tree.search(own[part], rows[part], np.full(len(part), _NONE), k)[0][:, k - 1]
                    out.append((int(dim), -1, uuid.uuid4().int >> 65, own[part].tobytes(), rows[part].tobytes(), kth.tobytes()))
                yield _batch(out, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), _PACKED)

    packed = stored(read.mapInArrow(pack, _PACKED), "packed-vectors")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tree = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                dim, shard, block, ids, rows, kth = (batch.column(c)[i].as_py() for c in range(6))
                if (dim, shard) != key:
                    key, held, tree = (dim, shard), [], None
                own, x = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64)
                x = x.reshape(len(own), dim)
                if block < 0:
                    held.append((own, x))
                    continue
                if tree is None:
                    tree = BallTree(np.concatenate([np.zeros(0, np.int64), *[h[0] for h in held]]), np.concatenate([np.zeros((0, dim), np.int64), *[h[1] for h in held]]))
                    held = []
                scores, found = tree.search(own, x, np.frombuffer(kth, np.int64), k)
                good = scores != _NONE
                yield pa.RecordBatch.from_arrays([pa.array(np.full(good.sum(), block)), pa.array(np.repeat(own, good.sum(axis=1))), pa.array(found[good]), pa.array(scores[good])], names=["block", "query_id", "id", "score"])

    def raised(asking: pa.Table, met: pa.Table) -> pa.Table:
        """The queries of a block with the kth scores that the shards so far have reached."""
        ids, scores = np.asarray(met["query_id"]), np.asarray(met["score"])
        order = np.lexsort((-scores, ids))
        ids, scores = ids[order], scores[order]
        out = []
        for r in asking.to_pylist():
            own, kth = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["kth"], np.int64).copy()
            at = np.searchsorted(ids, own) + k - 1
            full = np.searchsorted(ids, own, "right") > at
            kth[full] = np.maximum(kth[full], scores[at[full]])
            out.append((r["dim"], r["shard"], r["block"], r["ids"], r["x"], kth.tobytes()))
        return pa.Table.from_batches([_batch(out, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), _PACKED)])

    queries, parts = packed.where("block >= 0"), []
    cuts = sorted({0, -(-shards // 16), -(-shards // 4), shards})
    for low, high in zip(cuts, cuts[1:], strict=False):
        if parts:
            so_far = reduce(DataFrame.unionByName, parts)
            queries = stored(queries.groupBy("block").cogroup(so_far.groupBy("block")).applyInArrow(raised, _PACKED), "raised-queries")
        everywhere = queries.withColumn("shard", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
        held = packed.where((F.col("block") < 0) & (F.col("shard") >= low) & (F.col("shard") < high))
        dealt = held.unionByName(everywhere).repartition(partitions(spark), "dim", "shard").sortWithinPartitions("dim", "shard", "block")
        parts.append(stored(dealt.mapInArrow(search, "block long, query_id long, id long, score long"), "shard-results"))
    found = reduce(DataFrame.unionByName, parts).drop("block")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
