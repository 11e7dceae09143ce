"""Exact top-k inner-product search by a three-phase uniform threshold.

A vector's score is the sum of its partial scores over ``SLICES`` slices of the
dimensions. Rows lie in blocks; queries pass through each block in batches, so
that a task holds one block, one batch and one tile of scores.

1. The rows are dealt by hash, and each block of the first ``SEEDS``-th of them
   gives, for every query, the list of its k best scores. A query's k-th best of
   all lists is its cutoff: at least k rows reach it.
2. The cutoff goes to the queries, and they to all blocks. A row whose partial
   scores all lie below cutoff / SLICES cannot reach it, so each slice lists just
   the rows at or above that uniform threshold.
3. The scores of the listed rows are resolved from all slices, and the k best at
   or above the cutoff remain, ties to the smaller id.

The result is exact: products are whole numbers, in float32 below 2**24, in
float64 below 2**53, and in 64-bit integers beyond.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verilake.sources.scratch import cut

K = 5
SLICES = 2
#: One row of so many gives the lists for the cutoff.
SEEDS = 16
#: Rows of a block at most, queries of a batch, and rows whose scores are in memory at once.
ROW_BLOCK = 1 << 16
QUERY_BATCH = 512
TILE = 1 << 13


def quantized(vectors: DataFrame, factor: float = 256.0) -> DataFrame:
    """at (a number of the row), vec_id and v, the vector with each component x as floor(factor * x).

    Rows of a null id, vectors that are null or hold a null or non-finite
    component are left out. Rows that share an id are rows of their own, repeated
    ones too. Other columns are dropped. Write it as a table before use: the
    number is the place in the input.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(F.lit(factor) * c.cast("double")).cast("long"))
    return vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & finite).select(F.monotonically_increasing_id().alias("at"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


_PACK = "block int, kind int, width int, at binary, ids binary, v binary, cutoff binary"
_NAMES = ["block", "kind", "width", "at", "ids", "v", "cutoff"]


def _packed(rows: DataFrame, kind: int, size: int) -> DataFrame:
    """Vectors (block, at, vec_id, v, cutoff) of one block and width packed into one row, of ``size`` vectors at most."""

    def run(batches):
        for batch in batches:
            block, at, ids, cutoff = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2, 4))
            v = batch.column(3)
            ends = np.asarray(v.offsets)
            flat, width = v.values.to_numpy(zero_copy_only=False), np.diff(ends)
            order = np.lexsort((width, block))
            changes = np.flatnonzero((np.diff(block[order]) != 0) | (np.diff(width[order]) != 0)) + 1
            packs = [p[k : k + size] for p in np.split(order, changes) for k in range(0, len(p), size)]
            rows = [(int(block[p[0]]), kind, int(width[p[0]]), at[p].tobytes(), ids[p].tobytes(), flat[(ends[p][:, None] + np.arange(width[p[0]])).ravel()].tobytes(), cutoff[p].tobytes()) for p in packs if len(p)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int32()] * 3 + [pa.binary()] * 4, strict=True)], _NAMES)

    return rows.select("block", "at", "vec_id", "v", "cutoff").mapInArrow(run, _PACK)


def _best(k: int, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The places of each query's k best entries, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    own = query[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    nth = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return order[nth < k]


class _Block:
    """The vectors of a row block, by width."""

    def __init__(self):
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        self.ready: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, int]] = {}

    def add(self, width: int, at: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        self.parts.setdefault(width, []).append((at, ids, v))

    def of(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int] | None:
        """(at, ids, vectors, largest component) of a width; None without a row."""
        if width in self.parts:
            at, ids, v = (np.concatenate(x) for x in zip(*self.parts.pop(width), strict=True))
            self.ready[width] = at, ids, v, int(np.abs(v).max(initial=0))
        return self.ready.get(width)

    def listed(self, width: int, at: np.ndarray, q: np.ndarray, cutoff: np.ndarray, k: int, slices: int):
        """(query, score, id) of each query's k best rows of those that a slice lists, tile by tile."""
        if (own := self.of(width)) is None:
            return
        rows_at, ids, v, largest = own
        bound = largest * int(np.abs(q).max(initial=0)) * width
        kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
        cuts = np.array_split(np.arange(width), max(1, min(slices, width)))
        # whole numbers: one of the partial scores is at least the cutoff over their number, rounded up
        least = np.where(cutoff == _NO_CUTOFF, -np.inf if kind != np.int64 else np.iinfo(np.int64).min, np.ceil(cutoff / len(cuts)) if kind != np.int64 else -(-cutoff // len(cuts))).astype(kind)[:, None]
        q = [q[:, c].astype(kind) for c in cuts]
        for low in range(0, len(ids), TILE):
            tile = slice(low, low + TILE)
            partial = [a @ v[tile, c].astype(kind).T for a, c in zip(q, cuts, strict=True)]
            enough = partial[0] >= least
            for p in partial[1:]:
                enough |= p >= least
            r, j = np.nonzero(enough)
            score = sum(p[r, j].astype(np.int64) for p in partial)
            keep = (score >= cutoff[r]) & (rows_at[low + j] != at[r])
            r, j, score = r[keep], j[keep] + low, score[keep]
            best = _best(k, r, score, ids[j])
            yield r[best], score[best], ids[j[best]]


_NO_CUTOFF = np.iinfo(np.int64).min


def _meet(k: int, slices: int):
    """Of packed rows and, behind them, packed queries of each block: query, query_id, vec_id, score of the k best rows."""

    def run(batches):
        number, block = None, _Block()
        for batch in batches:
            for own, kind, width, at, ids, v, cutoff in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != number:
                    number, block = own, _Block()
                at, ids, cutoff = (np.frombuffer(x, np.int64) for x in (at, ids, cutoff))
                v = np.frombuffer(v, np.int64).reshape(len(at), width)
                if kind == 0:
                    block.add(width, at, ids, v)
                    continue
                found = list(block.listed(width, at, v, cutoff, k, slices))
                if found:
                    r, score, c = (np.concatenate(x) for x in zip(*found, strict=True))
                    best = _best(k, r, score, c)
                    r = r[best]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at[r], ids[r], c[best], score[best])], ["query", "query_id", "vec_id", "score"])

    return run


def _search(queries: DataFrame, rows: DataFrame, n_rows: int, k: int, slices: int) -> DataFrame:
    """query, query_id, vec_id, score: the k best rows of each query in each block of rows; queries have a cutoff."""
    # full blocks where there are many rows, and as many tasks as may run at once where there are few
    blocks = max(1, math.ceil(n_rows / ROW_BLOCK), min(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n_rows / TILE)))
    dealt = rows.select(F.pmod(F.xxhash64("at"), F.lit(blocks)).cast("int").alias("block"), "at", "vec_id", "v", F.lit(int(_NO_CUTOFF)).alias("cutoff"))
    batches = _packed(queries.withColumn("block", F.lit(0)), 1, QUERY_BATCH)
    everywhere = batches.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = _packed(dealt, 0, ROW_BLOCK).unionByName(everywhere).repartition(blocks, "block").sortWithinPartitions("block", "kind")
    return met.mapInArrow(_meet(k, slices), "query long, query_id long, vec_id long, score long")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("vec_id"))
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def top_k(queries: DataFrame, rows: DataFrame, k: int = K, slices: int = SLICES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows other than itself.

    Both take at, vec_id and v as ``quantized`` gives them; a row is a query's own
    if it has the same at. A query with fewer than k rows of its width returns
    them all; an empty side gives no rows. Queries that share an id are each answered.
    """
    of_seeds = rows.filter(F.pmod(F.xxhash64("at", F.lit(1)), F.lit(SEEDS)) == 0)
    n_rows, n_seeds = rows.agg(F.count("*"), F.count_if(F.pmod(F.xxhash64("at", F.lit(1)), F.lit(SEEDS)) == 0)).first()
    open_queries = queries.withColumn("cutoff", F.lit(int(_NO_CUTOFF)))
    lists = _ranked(_search(open_queries, of_seeds, n_seeds, k, 1), k)
    cutoffs = lists.filter(F.col("rank") == k).select(F.col("query").alias("at"), F.col("score").alias("cutoff"))
    aimed = cut(queries.join(cutoffs, "at", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(int(_NO_CUTOFF)))))
    return _ranked(_search(aimed, rows, n_rows, k, slices), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_uniform_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the five best rows for every vec_id divisible by 50."""
    rows = cut(quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return top_k(rows.filter(F.col("vec_id") % 50 == 0), rows)


OP3_SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT rid, vec_id, len(v) AS width, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM rows
), scored AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.width = c.width AND q.rid <> c.rid
  WHERE q.vec_id % 50 = 0
  GROUP BY q.rid, q.vec_id, c.rid, c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
