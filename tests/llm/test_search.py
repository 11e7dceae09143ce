import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, spark_rows, sql_rows
from verilake.llm import topk
from verilake.llm.queries import ORACLES, QUERIES
from verilake.sources.scratch import cut


def test_query_equals_sql(spark, sf):
    name = "op3_uniform_threshold"
    assert spark_rows(QUERIES[name](spark, sf)) == sql_rows(connect(sf), ORACLES[name])


def rows_of(n, seed=1, dims=10):
    r = random.Random(seed)
    rows = [(i, [round(r.gauss(0, 1), 1) for _ in range(dims)]) for i in range(n)]
    return [*rows, rows[3], (n, rows[7][1]), (n + 1, None), (n + 2, [1.0, None] * 5), (n + 3, [float("nan")] * dims), (n + 4, [float("inf")] * dims), (n + 5, []), (None, rows[0][1]), (n + 6, [1.0, 2.0])]


def brute(rows, k, every):
    """Every row is a row of its own, those that share an id and repeated ones too."""
    import math

    valid = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for a, (i, q) in enumerate(valid):
        if i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(valid) if a != b and len(v) == len(q))
            out.update((i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k]))
    return out


def search(spark, rows, every):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("qb", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("at", F.lit(1))
    q = cut(topk.quantized(df.repartition(3)))
    return Counter(tuple(r) for r in topk.top_k(q.filter(F.col("vec_id") % every == 0), q).collect())


@pytest.mark.parametrize("seeds", [1, 3, 16])
def test_equals_brute_force_in_blocks(spark, monkeypatch, seeds):
    monkeypatch.setattr(topk, "ROW_BLOCK", 20)
    monkeypatch.setattr(topk, "QUERY_BATCH", 7)
    monkeypatch.setattr(topk, "TILE", 6)
    monkeypatch.setattr(topk, "SEEDS", seeds)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows_of(90)]
    assert search(spark, rows, 5) == brute(rows, 5, 5)


def test_few_rows_ties_and_none(spark):
    same = [(i, [1.0, -1.0]) for i in range(4)]
    assert search(spark, same, 1) == brute(same, 5, 1)
    assert not search(spark, [(0, [1.0])], 1) and not search(spark, [], 1)
    hot = [(i, [1.0, 2.0]) for i in range(200)] + [(7, [1.0, 1.0]), (7, [9.0, 9.0]), (7, [9.0, 9.0]), (0, [1.0, 2.0])]  # differing and equal rows of one id
    assert search(spark, hot, 50) == brute(hot, 5, 50)
    assert search(spark, [(0, []), (1, []), (2, [1.0])], 1) == {(0, 1, 1, 0): 1, (1, 1, 0, 0): 1}


def test_a_better_row_that_shares_an_id_is_found(spark):
    rows = [(50, [1.0, 2.0]), (7, [1.0, 1.0]), (7, [9.0, 9.0])]
    assert search(spark, rows, 50) == {(50, 1, 7, 1769472): 1, (50, 2, 7, 196608): 1}


def test_slices_list_few_rows(spark):
    """The uniform threshold leaves few pairs to resolve: the rows that some slice lists."""
    r = np.random.default_rng(1)
    v = r.normal(size=(4000, 64))
    v = np.floor(256 * v / np.linalg.norm(v, axis=1)[:, None]).astype(np.int64)
    q, block = v[::50], topk._Block()
    block.add(64, np.arange(4000), np.arange(4000), v)
    cutoff = np.sort(q @ v[::16].T, 1)[:, -6]
    listed = sum((q[:, c] @ v[:, c].T >= np.ceil(cutoff / 2)[:, None]).astype(int) for c in (slice(0, 32), slice(32, 64)))
    assert (listed > 0).mean() < 0.2
    found = list(block.listed(64, np.arange(0, 4000, 50), q, cutoff, 5, 2))
    got = sorted((a, -s, c) for x in found for a, s, c in zip(*(y.tolist() for y in x), strict=True))
    full = q @ v.T
    full[np.arange(80), np.arange(0, 4000, 50)] = -(2**60)
    for k in range(80):
        assert [(s, c) for a, s, c in got if a == k][:5] == sorted(zip((-full[k]).tolist(), range(4000), strict=True))[:5]


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(2**20 + i), float(2**19 * (i % 3))]) for i in range(8)]
    assert search(spark, rows, 2) == brute(rows, 5, 2)
