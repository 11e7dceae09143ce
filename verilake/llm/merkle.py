"""A Merkle manifest of a dataset: one digest for all rows, and a proof for each.

Leaves are digests of rows. They are numbered within their tree (a column's value)
by ranges of the order, so that no task sees a whole tree. Then every level joins
its nodes with themselves on computed sibling indices: with a fan-out of 8 a node
in slot s asks for the slots s + 1 to s + 7, modulo 8, of its run (with a fan-out of
2 that is index XOR 1). Each node so learns its siblings, and the nodes in slot zero
emit the parents. Subroots of the trees are the leaves of one more tree.

Going down again, each node takes its parent's path, so that a leaf ends up with
all siblings up to the root; a row travels with one level's and its parent's path.
Levels are dealt by run, of at most 8 nodes, so that no key is hot, and written in
the shared folder, so that a lost executor costs a reread.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verilake.llm.common import documents
from verilake.sources.scratch import cut

FAN_OUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha(text: Column) -> Column:
    """The SHA-256 of a text, as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def text_of(digests: Column) -> Column:
    """Digests as hex text, which is what further digests are made of."""
    return F.lower(F.hex(digests))


def field(value: Column) -> Column:
    """A value in the input of a leaf: its number of bytes, a colon, the value; `-` for a null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return sha(F.concat(*map(field, values)))


@contextmanager
def _runs_stay_together(spark: SparkSession) -> Iterator[None]:
    """Joins and groupings by more than the run keep the rows where the run is: one exchange a level, not three."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def numbered(leaves: DataFrame, *order: Column) -> DataFrame:
    """With idx (from 0) and n of each row within its tree, by ranges of the order; ``leaves`` has a tree without nulls."""
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = leaves.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    placed = cut(rows.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    of_tree = Window.partitionBy("tree")
    counts = placed.groupBy("tree", "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_rows").over(of_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(of_tree).alias("n"))  # one row for each range and tree that meet
    return placed.join(places, ["tree", "_part"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


@dataclass(frozen=True)
class Climbed:
    """levels: (tree, idx, n, siblings) of the nodes of each level with more than one; roots: (tree, digest, level)."""

    levels: list[DataFrame]
    roots: DataFrame


def climb(nodes: DataFrame, fan_out: int = FAN_OUT) -> Climbed:
    """The levels above (tree, idx, n, digest), up to one node for each tree."""
    spark = nodes.sparkSession
    levels: list[DataFrame] = []
    roots = nodes.filter("n = 1").select("tree", "digest", F.lit(0).alias("level"))
    slot = F.col("idx") % fan_out
    run = F.call_function("div", F.col("idx"), F.lit(fan_out))
    nodes = nodes.filter("n > 1").select("tree", "idx", "n", "digest")
    while not nodes.isEmpty():
        dealt = nodes.withColumn("run", run).withColumn("slot", slot).repartition("tree", "run")
        shifts = F.sequence(F.lit(1), F.lit(fan_out - 1))
        asked = dealt.withColumn("sibling", F.explode(F.transform(shifts, lambda o: (F.col("slot") + o) % fan_out)))
        shown = dealt.select("tree", "run", F.col("slot").alias("sibling"), F.col("digest").alias("shown"))
        met = asked.join(shown, ["tree", "run", "sibling"], "left")
        by_node = met.groupBy("tree", "run", "slot").agg(F.first("n").alias("n"), F.first("digest").alias("digest"), F.array_sort(F.collect_list(F.when(F.col("shown").isNotNull(), F.struct("sibling", "shown")))).alias("found"))
        siblings = F.aggregate("found", F.lit(b""), lambda acc, x: F.concat(acc, x["shown"]))
        with _runs_stay_together(spark):
            level = cut(by_node.select("tree", (F.col("run") * fan_out + F.col("slot")).alias("idx"), "run", "slot", "n", "digest", siblings.alias("siblings")))
        levels.append(level.drop("digest"))
        parents = level.filter("slot = 0").select("tree", F.col("run").alias("idx"), F.ceil(F.col("n") / fan_out).alias("n"), sha(text_of(F.concat("digest", "siblings"))).alias("digest"))
        roots = roots.unionByName(parents.filter("n = 1").select("tree", "digest", F.lit(len(levels)).alias("level")))
        nodes = parents.filter("n > 1")
    return Climbed(levels, roots)


_PATH = "array<struct<slot: bigint, siblings: binary>>"


def descend(climbed: Climbed, tops: DataFrame) -> DataFrame:
    """(tree, idx, path, and what else ``tops`` has) of each leaf; tops has tree, level and the path above the tree's root."""
    more = [c for c in tops.columns if c not in ("tree", "level", "path")]

    def at(level: int) -> DataFrame:
        return tops.filter(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("idx"), "path", *more)

    above = at(len(climbed.levels))
    for k in range(len(climbed.levels) - 1, -1, -1):
        own = F.array(F.struct(F.col("slot").cast("long").alias("slot"), "siblings")).cast(_PATH)
        up = above.select("tree", F.col("idx").alias("run"), "path", *more)
        with_path = climbed.levels[k].join(up, ["tree", "run"]).select("tree", "idx", F.concat(own, "path").alias("path"), *more)
        above = cut(with_path.unionByName(at(k))) if k else with_path.unionByName(at(0))
    return above


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its path give: at each level the own digest takes its slot among the siblings."""

    def step(own: Column, x: Column) -> Column:
        left = x["slot"].cast("int") * 32
        return sha(text_of(F.concat(F.substring(x["siblings"], F.lit(1), left), own, F.substring(x["siblings"], left + 1, F.octet_length(x["siblings"])))))

    return F.aggregate(path, digest, step)


def manifest(leaves: DataFrame, *order: Column, fan_out: int = FAN_OUT) -> DataFrame:
    """With subroot, root (32 bytes each) and path of each row of ``leaves``, which has tree and digest.

    A null tree is one of its own and comes first; the others are ordered by their
    bytes. Rows are ordered by ``order`` and then by digest, so that ties have one
    outcome; repeated rows are leaves of their own. A table of one row is its own
    root with an empty path; an empty one gives no rows. The names tree, digest,
    idx, n, level, path, subroot and root are the operator's.
    """
    # no null among the keys, and the order of the bytes as it was
    tree = F.when(F.col("tree").isNull(), "").otherwise(F.concat(F.lit("="), F.col("tree").cast("string")))
    rows = cut(numbered(leaves.withColumn("tree", tree), *order, F.col("digest")))
    low = climb(rows, fan_out)
    subroots = cut(low.roots)
    top_leaves = cut(numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("own"), "digest"), F.col("own")))
    high = climb(top_leaves, fan_out)
    root = high.roots.select("tree", "level", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    above = descend(high, root).select("idx", "path", "root")
    tops = top_leaves.join(above, "idx").select(F.col("own").alias("tree"), F.col("digest").alias("subroot"), "path", "root")
    paths = descend(low, cut(tops.join(subroots.select("tree", "level"), "tree")))
    return rows.join(paths, ["tree", "idx"]).drop("tree", "idx", "n")


def documents_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, tampered leaf, subroot, root and path of each document, in trees by lang.

    A null field counts as `-`; a null doc_id comes first, as rows that share a
    doc_id do in the order of their digests, and is not tampered with. Other
    columns are dropped.
    """
    text = F.col("text")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(changed, F.translate(text, _UPPER, _LOWER)).otherwise(text)
    own, other = (leaf(*[F.col(c) for c in FIELDS[:-1]], t) for t in (text, tampered))
    # a text without capitals, or that is not changed, has one digest
    leaves = docs.select("doc_id", F.col("lang").alias("tree"), own.alias("digest"), F.when(changed, other).alias("other"))
    return manifest(cut(leaves), F.col("doc_id"))


def op11_sibling_shift_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document's leaf, its proof, and whether the text as it is, or tampered with, folds to the root."""
    rows = documents_manifest(documents(spark, sf_dir))
    proof = F.aggregate("path", F.lit(b""), lambda acc, x: F.concat(acc, x["siblings"]))
    fold = folded(F.coalesce("other", "digest"), F.col("path"))
    shown = rows.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("digest")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), text_of(F.col("root")).alias("root"), F.sha2(text_of(proof).cast("binary"), 256).alias("proof_sha256"), text_of(fold).alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


_CRC_STEP = "CASE WHEN xor(c, x) & 1 = 1 THEN xor(xor(c, x) >> 1, 3988292384) ELSE xor(c, x) >> 1 END"
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS[:-1]) + " || " + _FIELD.format("{}") + ")"

OP11_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT *, CAST(doc_id AS VARCHAR) AS d, row_number() OVER () AS rid FROM documents
), marked AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, strlen(d) + 1), lambda i: [CAST(ascii(d[i]) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda c, x: {_CRC_STEP})) % 3 = 0 AS changed FROM docs
), leaves AS (
  SELECT rid, doc_id, lang, {_LEAF.format("text", "text", "text")} AS leaf,
    CASE WHEN changed THEN {_LEAF.format(*["translate(text, '" + _UPPER + "', '" + _LOWER + "')"] * 3)} END AS other
  FROM marked
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n, coalesce('=' || lang, '') AS tree FROM leaves
), low AS (
  SELECT tree, 0 AS level, idx, n, leaf AS digest FROM placed
  UNION ALL SELECT tree, any_value(level) + 1, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY tree, idx // 8
), subroots AS (
  SELECT tree, digest AS subroot, level AS depth, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS level, idx, n, subroot AS digest FROM subroots
  UNION ALL SELECT any_value(level) + 1, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY idx // 8
), runs AS (
  SELECT tree, level, idx // 8 AS run, list(digest ORDER BY idx) AS digests FROM low WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT NULL, level, idx // 8, list(digest ORDER BY idx) FROM high WHERE n > 1 GROUP BY ALL
), steps AS (
  SELECT p.rid, r.level AS step, p.idx // CAST(pow(8, r.level) AS BIGINT) % 8 AS slot, r.digests
  FROM placed p JOIN runs r ON r.tree = p.tree AND r.run = p.idx // CAST(pow(8, r.level + 1) AS BIGINT)
  UNION ALL SELECT p.rid, s.depth + r.level, s.idx // CAST(pow(8, r.level) AS BIGINT) % 8, r.digests
  FROM placed p JOIN subroots s USING (tree) JOIN runs r ON r.tree IS NULL AND r.run = s.idx // CAST(pow(8, r.level + 1) AS BIGINT)
), paths AS (
  SELECT rid, list(slot ORDER BY step) AS slots, list(digests ORDER BY step) AS runs FROM steps GROUP BY rid
), proofs AS (
  SELECT p.rid, p.doc_id, p.leaf, s.subroot, (SELECT digest FROM high WHERE n = 1) AS root, coalesce(p.other, p.leaf) AS own, coalesce(slots, []) AS slots, coalesce(runs, []) AS runs
  FROM placed p JOIN subroots s USING (tree) LEFT JOIN paths USING (rid)
), folds AS (
  SELECT rid, own AS acc, 1 AS step, slots, runs FROM proofs
  UNION ALL SELECT rid, sha256(array_to_string(list_concat(runs[step][: slots[step]], [acc], runs[step][slots[step] + 2 :]), '')), step + 1, slots, runs FROM folds WHERE step <= len(slots)
)
SELECT p.doc_id, p.leaf, p.subroot, p.root, f.acc AS folded_root, f.acc = p.root AS verified,
  sha256(array_to_string(list_transform(range(1, len(p.slots) + 1), lambda k: array_to_string(list_concat(p.runs[k][: p.slots[k]], p.runs[k][p.slots[k] + 2 :]), '')), '')) AS proof_sha256
FROM proofs p JOIN folds f ON f.rid = p.rid AND f.step = len(p.slots) + 1
"""
