"""The stages of corpus_pipeline, each against what it should do to its own input."""

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.cases import docs_df, documents  # noqa: E402
from tests.llm.test_linedup import brute as repeated_lines  # noqa: E402
from tests.llm.test_neardup import brute as near  # noqa: E402
from verilake.sources.scratch import cut  # noqa: E402


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        rows = [tuple(r) for r in docs.collect()]
        docs = cut(stage(spark, docs, sf))
        assert docs.columns == columns, name
        kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "line_dedup":
            gone = repeated_lines([(r[0], r[1]) for r in rows], {r[1]: 0 for r in rows})
            want = {r[0]: "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone.get((r[0], r[1]), ())) for r in rows}
            texts = {r[0]: r[1] for r in rows}
            assert kept == {i: t for i, t in want.items() if (i, texts[i]) not in gone or t.split()}
        if name == "near_dedup":
            _, roots = near([(r[0], r[1]) for r in rows], 5, 80, 100)
            assert set(kept) == {i for i, root in roots.items() if i == root}
        assert docs.count() <= before
        before = docs.count()
    pieces = pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == set(kept)


def test_odd_and_empty_inputs(spark, sf):
    for rows in (documents(), []):
        docs = docs_df(spark, rows)
        for _, stage in pipeline.STAGES[:-1]:
            out = cut(stage(spark, docs, sf))
            assert out.columns == docs.columns
            docs = out
        assert pipeline.STAGES[-1][1](spark, docs, sf).count() >= bool(rows)


def test_run_equals_its_stages_and_leaves_no_tables_behind(spark, sf):
    from pathlib import Path

    from verilake.sources.scratch import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    found = pipeline.run(spark, sf)
    assert {p.name.split("-")[0] for p in set(folder.iterdir()) - before} == {pipeline.STAGES[-2][0]}  # what the last stage reads
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, sf))
    rows = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.groupBy("doc_id").agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.max("doc_tokens").alias("ids_crc32")).collect())
    assert rows(found) == rows(pipeline.STAGES[-1][1](spark, docs, sf))


@pytest.mark.parametrize("name", ["op1_superminhash", "op2_set_similarity_join", "op11_sibling_shift_manifest"])
def test_tables_of_a_query_go_with_their_scope(spark, sf, tmp_path, name):
    """A result that is written inside ``released`` leaves nothing in the shared folder."""
    from pathlib import Path

    from verilake.llm.queries import QUERIES
    from verilake.sources.scratch import released, shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    with released(spark):
        QUERIES[name](spark, sf).write.parquet(str(tmp_path / name))
    assert set(folder.iterdir()) == before and spark.read.parquet(str(tmp_path / name)).count() == 200
