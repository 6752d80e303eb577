"""Exact top-k by inner product without random access.

Vectors are whole numbers (each component x becomes floor(scale * x)) and lie in blocks of at most BLOCK_ROWS rows. In
a block every dimension is a list sorted by value; a query reads the list of a dimension from its high end if the
query's component is positive and from its low end otherwise. Lists are read sequentially and together, to the depths of
DEPTHS. After a round, what has been read of a row's score is exact; for what has not been read, the last value read
bounds it from above and the list's far end from below. For some queries and all rows of a block together these bounds
are products of matrices: where a list has been read down to t, a positive component meets max(x, t) in the upper bound,
since a row not read yet is at most t.

Reading stops once the outsiders, that is all rows but a few for each query, have upper bounds below the k-th best score
known so far: the k-th best among the queries of the same block to begin with, and then among the blocks that the task
has searched. Only the scores of rows that still qualify are resolved. Where bounds leave too many of them, the lists
are read to their ends, which is the plain product.

Blocks of rows stay as they are read; each meets all blocks of queries, by an equi-join on the numbers of both, so that
as many tasks as there are pairs of blocks can share the work.

Defined cases: rows whose vector is null, or holds a null or a component that is not finite, take no part; a query
without candidates gives no row; ties go to the smaller id; vectors of other lengths than the query's don't compare
and are refused with an error; repeated ids are candidates each, and never of a query of the same id; other columns of the
input don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.llm.common import clip, leaves_no_memory

#: Rows of a block, queries of a block, and queries whose bounds are held at once.
BLOCK_ROWS, BLOCK_QUERIES, AT_ONCE = 8192, 4096, 256
#: Share of a list that each round reads to, and share of a block's rows that are few enough to resolve one by one.
DEPTHS, FEW = (1 / 2, 3 / 4), 0.2
#: Most groups of row blocks, and so copies of the queries.
MOST_GROUPS = 4096


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    lengths = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(lengths) > 1:
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * x)


class Block:
    """Rows of whole-number vectors with their sorted lists."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.lists = np.sort(x, axis=0)  # ascending; read from either end

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the k best rows for each query among those that may reach `known`, the k-th best scores so far."""
        parts = [self.some(query_ids[at : at + AT_ONCE], q[at : at + AT_ONCE], k, known[at : at + AT_ONCE], at) for at in range(0, len(q), AT_ONCE)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def some(self, query_ids: np.ndarray, q: np.ndarray, k: int, known: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(self.x)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        least = known.astype(np.float64)
        own = query_ids[:, None] == self.ids[None, :]
        can = ~own
        for share in DEPTHS:
            depth = int(np.ceil(n * share))
            if depth >= n or n <= k:
                break
            high, low = self.lists[n - depth], self.lists[depth - 1]
            if not np.isfinite(least).all():
                lower = up @ np.where(self.x >= high, self.x, self.lists[0]).T + down @ np.where(self.x <= low, self.x, self.lists[-1]).T
                lower[own] = -np.inf
                least = np.maximum(least, np.partition(lower, n - k, axis=1)[:, n - k])
            upper = up @ np.maximum(self.x, high).T + down @ np.minimum(self.x, low).T
            can &= upper >= least[:, None]
            if can.mean() <= FEW:
                break
        if can.mean() <= FEW:
            at, row = np.nonzero(can)
            score = np.empty(len(at))
            for a in range(0, len(at), 1 << 16):
                score[a : a + (1 << 16)] = np.einsum("ij,ij->i", q[at[a : a + (1 << 16)]], self.x[row[a : a + (1 << 16)]])
        else:
            full = q @ self.x.T
            full[own] = -np.inf
            edge = np.maximum(least, np.partition(full, n - k, axis=1)[:, n - k]) if n > k else least
            at, row = np.nonzero((full >= edge[:, None]) & can)
            score = full[at, row]
        order = np.lexsort((self.ids[row], -score, at))
        at, row, score = at[order], row[order], score[order]
        best = np.arange(len(at)) - np.searchsorted(at, at) < k
        return at[best] + first, self.ids[row[best]], score[best].astype(np.int64)


def best_scores(n: int, k: int, at: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The k largest scores of each of n queries, ascending; -inf where there are fewer. `at` is ascending."""
    out = np.full((n, k), -np.inf)
    out[at, np.arange(len(at)) - np.searchsorted(at, at)] = score
    return np.sort(out, axis=1)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score) of the k best other rows for each row that is_query holds for."""
    rows = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    n_queries = rows.where("is_query").count()
    blocks = max(1, -(-n_queries // BLOCK_QUERIES))
    numbered = rows.where("is_query").select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("qb"), "id", "v")

    def packed(key, t):
        t = t.combine_chunks()
        ids, x = t["id"].to_numpy(), whole(matrix(t["v"].chunk(0)), scale)
        # the k-th best among the block's own queries: no query's k-th best row scores less
        at, _, score = Block(ids, x).search(ids, x, k, np.full(len(ids), -np.inf))
        known = best_scores(len(ids), k, at, score)[:, 0]
        return pa.table({"qb": pa.array([key[0].as_py()], pa.int32()), **{c: pa.array([v.tobytes()], pa.binary()) for c, v in (("query_ids", ids), ("queries", x), ("known", known))}})

    # a query block has about BLOCK_QUERIES rows, whatever the number of queries
    queries = numbered.groupBy("qb").applyInArrow(packed, "qb int, query_ids binary, queries binary, known binary")
    groups = clip(-(-rows.count() // BLOCK_ROWS), 1, MOST_GROUPS)

    @leaves_no_memory
    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number = [], 0, TaskContext.get().partitionId()

        def flush():
            nonlocal number
            t = pa.Table.from_batches(held).combine_chunks()
            ids, x = t["id"].to_numpy(), whole(matrix(t["v"].chunk(0)), scale)
            held.clear()
            for at in range(0, len(ids), BLOCK_ROWS):
                number += 7919
                yield pa.RecordBatch.from_arrays([pa.array([number % groups], pa.int32()), pa.array([ids[at : at + BLOCK_ROWS].tobytes()], pa.binary()), pa.array([x[at : at + BLOCK_ROWS].tobytes()], pa.binary()), pa.array([x.shape[1]], pa.int32())], ["g", "ids", "x", "d"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield from flush()
                n = 0
        if n:
            yield from flush()

    spread = rows.select("id", "v").mapInArrow(pack_rows, "g int, ids binary, x binary, d int")
    # the numbers of partitions are given, so that small tables aren't gathered into few tasks; blocks are large rows
    cells = clip(groups * blocks, 1, 1 << 16)
    left = spread.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(cells, "g", "qb")
    right = queries.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(cells, "g", "qb")
    paired = left.join(right.hint("merge"), ["g", "qb"])

    @leaves_no_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}  # the k best scores of the query blocks that this task meets
        for batch in batches:
            for i in range(batch.num_rows):
                qb, raw_ids, raw_x, d, raw_q, raw_v, raw_k = (batch.column(c)[i].as_py() for c in ("qb", "ids", "x", "d", "query_ids", "queries", "known"))
                query_ids, q, known = np.frombuffer(raw_q, np.int64), np.frombuffer(raw_v, np.float64), np.frombuffer(raw_k, np.float64)
                if len(q) != len(query_ids) * d:
                    raise ValueError("vectors differ in length")
                q = q.reshape(-1, d)
                ids, x = np.frombuffer(raw_ids, np.int64), np.frombuffer(raw_x, np.float64).reshape(-1, d)
                if d and float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * d >= 2**53:
                    raise OverflowError("components too large for exact scores")
                held = best.get(qb)
                at, found, score = Block(ids, x).search(query_ids, q, k, known if held is None else np.maximum(known, held[:, 0]))
                new = best_scores(len(q), k, at, score)
                best[qb] = new if held is None else np.sort(np.concatenate([held, new], axis=1), axis=1)[:, k:]
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[at]), pa.array(found), pa.array(score)], ["query_id", "id", "score"])

    partial = paired.select("qb", "ids", "x", "d", "query_ids", "queries", "known").mapInArrow(run, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def top_k_sql() -> str:
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5
"""
