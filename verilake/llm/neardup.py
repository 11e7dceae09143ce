"""Near-duplicate documents: SuperMinHash, banding, verification, grouping.

1. Every text becomes a set of word shingles and a SuperMinHash signature of it.
   Documents of equal sets are one group from here on, however many they are.
2. Bands of the signatures put documents into buckets. A pair at the threshold
   shares no bucket with a chance of (1 - s ** ROWS) ** BANDS: 7e-10 for s = 0.85
   and 6e-7 for s = 0.8.
3. In each bucket all documents are checked against its first one, on their full
   sets. The links give components.
4. What lies in one bucket and still in different components is compared in
   blocks: where the signatures agree as much as those of a linked pair do, less
   six standard deviations, by 32 bits of each shingle hash, which can only find
   too much in common; what they leave is checked on the full sets. No bucket is
   cut short, and no pair that is known to be connected is looked at again.
5. Links are grouped into components by union-find.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verilake.llm.common import giving_back
from verilake.llm.components import components
from verilake.llm.setsketch import shingle_sets, superminhash
from verilake.sources.scratch import cut

BANDS, ROWS = 36, 5
#: Documents of a bucket that are compared in one block, and checked against one document in one task.
BLOCK = 512
CHECKED = 256
#: A set, or the first document of a bucket, with a HOTth of all rows meets them where they lie; at most HOT have so many.
HOT = 10_000


def signatures(docs: DataFrame, shingle: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, digest of the shingle set, and 16 bits of each signature position."""

    def run(batches):
        for batch in batches:
            n, digest, kept = [], [], []
            for elements in shingle_sets(batch.column(1), shingle):
                n.append(len(elements))
                digest.append(xxhash.xxh3_128_digest(elements.tobytes()))
                value = superminhash(elements, bands * rows).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                kept.append((value >> np.uint64(48)).astype("<u2").tobytes() if len(elements) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(kept, pa.binary())], ["doc_id", "n_shingles", "digest", "signature"])

    return docs.select("doc_id", "text").mapInArrow(giving_back(run), "doc_id long, n_shingles long, digest binary, signature binary")


def _linked(common: int, a: int, b: int, num: int, den: int) -> bool:
    return den * common >= num * (a + b - common)


def _near_in_size(a, b, num: int, den: int):
    """Sets whose sizes differ more cannot be linked."""
    return F.least(a, b) * den >= F.greatest(a, b) * num


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Those of the distinct pairs (node, hub) whose full shingle sets are linked, as u, v.

    Partners of one hub are dealt over as many tasks as it takes; each gets the hub's text once.
    """
    counts = pairs.groupBy("hub").agg(F.count("*").alias("k"))
    salts = cut(counts.select("hub", "k", F.ceil(F.col("k") / CHECKED).cast("int").alias("salts")))
    often = F.col("k") * HOT >= F.lit(salts.agg(F.sum("k")).first()[0] or 0)
    hot = F.broadcast(salts.filter(often).select("hub", "salts"))  # HOT rows at most
    salted = pairs.join(hot, "hub").unionByName(pairs.join(hot, "hub", "left_anti").join(salts.filter(~often).select("hub", "salts"), "hub"))
    members = salted.select("node", "hub", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("nth"))
    hubs = salts.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("nth"))
    wanted = members.unionByName(hubs)
    rows = texts.join(wanted, texts["doc_id"] == wanted["node"]).select("hub", "salt", "nth", "node", "text")
    spread = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "nth", "node")

    def run(batches):
        at, sets = None, []
        for batch in batches:
            u, v = [], []
            for hub, salt, nth, node, elements in zip(*(c.to_pylist() for c in batch.columns[:4]), shingle_sets(batch.column(4), shingle), strict=True):
                if (hub, salt) != at:
                    at, sets = (hub, salt), []
                if nth == 0:
                    sets.append(elements)  # more than one only if rows share the doc_id
                elif any(_linked(len(np.intersect1d(s, elements, assume_unique=True)), len(s), len(elements), num, den) for s in sets):
                    u.append(node)
                    v.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return spread.mapInArrow(giving_back(run), "u long, v long")


def _alike(bands: int, rows: int, num: int, den: int):
    """Pairs of one block pair that may be linked, looked at in the first band they share."""
    m, s = bands * rows, num / den
    least = m * s - 6 * math.sqrt(m * s * (1 - s))

    def compare(band: int, i: int, j: int, block, node, root, size, signature, compact):
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        for x in left:
            others = right[node[right] > node[x]] if i == j else right
            others = others[root[others] != root[x]]
            low, high = np.minimum(size[others], size[x]), np.maximum(size[others], size[x])
            others = others[low * den >= high * num]
            if not len(others):
                continue
            same = signature[others] == signature[x]
            ok = same.sum(1) >= least
            others, same = others[ok], same[ok]
            first = same.reshape(len(others), bands, rows).all(2).argmax(1) == band
            for y in others[first]:
                common = len(np.intersect1d(compact[x], compact[y]))
                common += max(len(compact[x]) - len(np.unique(compact[x])), len(compact[y]) - len(np.unique(compact[y])))
                if _linked(common, int(size[x]), int(size[y]), num, den):
                    yield int(node[x]), int(node[y])

    def run(batches):
        key, held = None, []

        def flush():
            a, b = [], []
            if held:
                _, band, i, j = key
                *plain, signature, compact = zip(*held, strict=True)
                signature = np.frombuffer(b"".join(signature), "<u2").reshape(len(signature), m)
                for x, y in compare(band, i, j, *map(np.array, plain), signature, [np.frombuffer(c, "<u4") for c in compact]):
                    a.append(x)
                    b.append(y)
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["node", "hub"])

        for batch in batches:
            for k, band, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, band, i, j) != key:
                    yield flush()
                    key = (k, band, i, j)
                held.append(row)
        yield flush()

    return run


def _compact(texts: DataFrame, shingle: int) -> DataFrame:
    """node, compact: 32 bits of each shingle hash of a text."""

    def run(batches):
        for batch in batches:
            sets = [(x >> np.uint64(32)).astype("<u4").tobytes() for x in shingle_sets(batch.column(1), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "compact"])

    return texts.select("doc_id", "text").mapInArrow(giving_back(run), "node long, compact binary")


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Texts whose shingle sets have a Jaccard similarity of num / den or more are
    linked; component_id is the smallest doc_id that links lead to, the own one
    included. A null, empty or blank text has no shingles and links to nothing,
    nor does a row of a null doc_id, whose component_id is null; both are kept.
    Rows that share a doc_id are each placed by their own text. kept marks the
    document that a component is named after.
    """
    signed = cut(signatures(docs, shingle, bands, rows))
    sets = signed.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n"), F.count("*").alias("rows"))
    reps = cut(sets.select("digest", F.col("rep").alias("node"), "signature", "n", "rows"))

    key = lambda i: F.xxhash64(i, F.substring(F.col("signature"), i * (2 * rows) + 1, F.lit(2 * rows)))
    entries = reps.select("node", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), key)).alias("band", "key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("hub")).filter(F.col("members") > 1)
    live = cut(entries.join(shared, "key"))

    nodes = live.select(F.col("node").alias("doc_id")).distinct()
    texts = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(nodes, "doc_id"))
    size_of = reps.groupBy(F.col("node").alias("hub")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    pairs = live.filter(F.col("node") != F.col("hub")).groupBy("node", "hub").agg(F.min("n").alias("n")).join(size_of, "hub")
    pairs = pairs.filter(_near_in_size(F.col("n"), F.col("low"), num, den) | (F.col("low") != F.col("high"))).select("node", "hub")
    links = cut(verified(cut(pairs), texts, shingle, num, den))
    roots = components(links)

    rest = live.filter((F.col("members") > 2) & (F.col("node") != F.col("hub"))).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = rest.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("key", "blocks")
    rest = cut(rest.join(apart, "key").join(reps.select("node", "signature"), "node"))
    again = texts.join(rest.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    rest = rest.join(_compact(again, shingle), "node")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("key", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root", "n", "signature", "compact")
    candidates = rest.repartition("key", "i", "j").sortWithinPartitions("key", "band", "i", "j", "node").mapInArrow(giving_back(_alike(bands, rows, num, den)), "node long, hub long").distinct()
    more = verified(cut(candidates), texts, shingle, num, den)
    roots = components(links.unionByName(more))

    named = reps.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("component"), "rows")
    often = F.col("rows") * HOT >= F.lit(reps.agg(F.sum("rows")).first()[0] or 0)
    hot = F.broadcast(named.filter(often).drop("rows"))  # HOT rows at most
    some, none = signed.select("doc_id", "n_shingles", "digest").filter("n_shingles > 0"), signed.filter("n_shingles = 0").select("doc_id", "n_shingles", "digest", F.col("doc_id").alias("component"))
    rare = some.join(hot, "digest", "left_anti").join(named.filter(~often).drop("rows"), "digest", "left")
    placed = some.join(hot, "digest").unionByName(rare).unionByName(none)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op1_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: near-duplicates of all documents by 3-word shingles at 0.85."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, num=85, den=100)


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents WHERE text IS NOT NULL
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words
), items AS (
  SELECT doc_id, len(s) AS n, md5(unnest(s)) AS x FROM sets
), common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, a.n AS na, b.n AS nb, count(*) AS k
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY ALL
), links AS (
  SELECT u, v FROM common WHERE 100 * k >= 85 * (na + nb - k)
), edges AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, e.v FROM (WITH RECURSIVE walk(doc_id, other) AS (SELECT u, v FROM edges UNION SELECT w.doc_id, e.v FROM walk w JOIN edges e ON w.other = e.u) SELECT doc_id, other AS v FROM walk) r JOIN (SELECT DISTINCT v FROM edges) e ON r.v = e.v
)
SELECT d.doc_id, CAST(coalesce(len(s.s), 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sets s ON d.doc_id = s.doc_id JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c ON d.doc_id = c.doc_id
"""
