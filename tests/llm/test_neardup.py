import numpy as np
import pytest

from tests.llm.cases import components as plain_components
from tests.llm.cases import docs_df, documents, prose, shingle_set
from tests.oracle import connect, spark_rows, sql_rows
from verilake.llm import neardup, setsketch
from verilake.llm.components import components
from verilake.llm.queries import ORACLES, QUERIES


def brute(rows, shingle, num, den):
    sets = [(i, shingle_set(t, shingle)) for i, t, *_ in rows]
    links = []
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and den * len(x & y) >= num * len(x | y):
                links.append((i, j))
    return sets, plain_components({i for i, _ in sets if i is not None}, links)


@pytest.mark.parametrize(("shingle", "num", "den"), [(3, 85, 100), (5, 80, 100)])
def test_equals_brute_force(spark, shingle, num, den):
    rows = documents()
    sets, roots = brute(rows, shingle, num, den)
    found = neardup.near_duplicates(docs_df(spark), shingle, num, den).collect()
    want = sorted(((i if i is not None else -1), len(s), roots.get(i, -1), i is None or roots[i] == i) for i, s in sets)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1, r["kept"]) for r in found) == want


def test_large_group_of_near_copies(spark, monkeypatch):
    """Pairs around the threshold, more than a block, without a document that all are close to."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "CHECKED", 4)
    base = prose(9, 100).split()
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        words = list(base)
        for k in rng.choice(100, rng.integers(0, 7), replace=False):
            words[k] = f"new{i}x{k}"
        rows.append((i, " ".join(words), None, None, None))
    _, roots = brute(rows, 3, 85, 100)
    assert 1 < len(set(roots.values())) < 60
    found = neardup.near_duplicates(docs_df(spark, rows), 3, 85, 100)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == roots


def test_empty_table(spark):
    assert neardup.near_duplicates(docs_df(spark, []), 3, 85, 100).count() == 0


def test_query_equals_sql(spark, sf):
    name = "op1_superminhash"
    assert spark_rows(QUERIES[name](spark, sf)) == sql_rows(connect(sf), ORACLES[name])


def test_signatures_estimate_with_less_variance_than_independent_minima():
    rng, errors = np.random.default_rng(0), []
    for _ in range(300):
        a = rng.integers(0, 2**63, 60).astype(np.uint64)
        b = a.copy()
        b[:12] = rng.integers(0, 2**63, 12)
        errors.append(np.mean(setsketch.superminhash(np.unique(a), 128) == setsketch.superminhash(np.unique(b), 128)) - 48 / 72)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.9 * (2 / 9 / 128) ** 0.5


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5000), (6000, 5999), (6000, 5999)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame([*links, (None, 3)], "u long, v long").repartition(7)).collect()}
    want = plain_components({x for p in links for x in p}, links)
    assert found == {k: v for k, v in want.items() if k != v}
