"""Fixed virtual slots: hash records into slots, give whole slots to shards.

A record's slot depends on its doc_id and text alone and never changes. What changes is the
slot-to-shard map: a small table of ``slots`` rows with a version. It is made
once (largest slot to the lightest shard) and edited when the load drifts or a
shard is added, so that few slots, and no other rows, move. The map is the only
thing the driver holds; its size is ``slots`` rows, whatever the input.

Records that are alike in doc_id and text share a slot, as do rows of neither.
A slot with over a quarter of a shard's bytes or rows is overfull: its records
are dealt over all slots by where they lie in the table instead. At most eight
slots for each shard can be overfull.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verilake.sources.scratch import cut, scratch_path

SLOTS = 4096
SHARDS = 16

MAP_SCHEMA = "version long, slot int, shard int, shards int"


def slot_of(*key: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a key; a null key has a slot too."""
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def slot_loads(records: DataFrame, slot: str = "vslot", size: str = "size") -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of each slot that has rows: one row per slot at most."""
    rows = records.groupBy(slot).agg(F.sum(size).alias("b"), F.count("*").alias("n")).collect()
    return sorted((r[slot], r["b"] or 0, r["n"]) for r in rows)


@dataclass(frozen=True)
class SlotMap:
    """Version ``version`` of the slot-to-shard map; ``assignment[slot]`` is a shard."""

    version: int
    shards: int
    assignment: tuple[int, ...]

    @classmethod
    def build(cls, loads: Iterable[tuple[int, int, int]], shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
        """Version 1: slots by bytes, largest first, each to the lightest shard so far.

        Empty slots are dealt round robin, so that rows to come spread too.
        """
        if shards < 1:
            raise ValueError("shards must be positive")
        assignment = [slot % shards for slot in range(slots)]
        heap = [(0, shard) for shard in range(shards)]
        for slot, size, _ in sorted(loads, key=lambda x: (-x[1], x[0])):
            load, shard = heapq.heappop(heap)
            assignment[slot] = shard
            heapq.heappush(heap, (load + size, shard))
        return cls(1, shards, tuple(assignment))

    def rebalance(self, loads: Iterable[tuple[int, int, int]], shards: int | None = None, tolerance: float = 0.02) -> SlotMap:
        """The next version: moves slots from the fullest shard to the lightest one.

        ``shards`` may grow (new shards take slots) or shrink (slots of the shards
        that go are moved). Slots move, or change places, as long as a shard is
        more than ``tolerance`` above the mean and that narrows the gap: each time
        what comes nearest to half of it.
        """
        n = shards or self.shards
        assignment = list(self.assignment)
        size = {slot: b for slot, b, _ in loads}
        held: list[list[tuple[int, int]]] = [[] for _ in range(max(n, self.shards))]  # (bytes, slot), ascending
        for slot, shard in enumerate(assignment):
            held[shard].append((size.get(slot, 0), slot))
        total = [sum(b for b, _ in own) for own in held]
        for own in held:
            own.sort()
        mean = sum(total) / n

        def move(item: tuple[int, int], to: int) -> None:
            own = assignment[item[1]]
            held[own].remove(item)
            insort(held[to], item)
            total[own] -= item[0]
            total[to] += item[0]
            assignment[item[1]] = to

        for gone in range(n, self.shards):
            for item in held[gone][::-1]:
                move(item, min(range(n), key=lambda s: (total[s], s)))
        while True:
            heavy, light = max(range(n), key=lambda s: (total[s], -s)), min(range(n), key=lambda s: (total[s], s))
            gap = total[heavy] - total[light]
            if total[heavy] <= mean * (1 + tolerance) or gap < 2:
                break
            best = None  # (how far from half the gap, the slot to move, the one that comes back for it)
            for back in [None, *held[light]]:
                at = bisect_left(held[heavy], (gap / 2 + (back[0] if back else 0), 0))
                for item in held[heavy][max(0, at - 1) : at + 1]:
                    moved = item[0] - (back[0] if back else 0)
                    if 0 < moved < gap and (best is None or abs(moved - gap / 2) < best[0]):
                        best = abs(moved - gap / 2), item, back
                if best and back is None and best[0] < gap / 4:
                    break  # one slot does it
            if best is None:
                break
            move(best[1], light)
            if best[2]:
                move(best[2], heavy)
        return SlotMap(self.version + 1, n, tuple(assignment))

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, slot, shard, self.shards) for slot, shard in enumerate(self.assignment)]
        return spark.createDataFrame(rows, MAP_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to the table at ``path``, or put it there again; older versions stay readable."""
        self.to_df(spark).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)

    @staticmethod
    def stored(spark: SparkSession, path: str) -> bool:
        """Whether there is a version at ``path``."""
        try:
            return not spark.read.schema(MAP_SCHEMA).parquet(path).isEmpty()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return False

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        table = spark.read.schema(MAP_SCHEMA).parquet(path)
        if version is None:
            version = table.agg(F.max("version")).first()[0]
        rows = table.filter(F.col("version") == version).orderBy("slot").collect()
        return cls(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of each document.

    size is the text's UTF-8 bytes plus 1; a null text counts as no bytes, with
    the CRC of no bytes, 0. Other columns are dropped.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slot = slot_of(F.col("doc_id"), F.col("text"), slots=slots)
    return docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), slot.alias("vslot"))


def _dealt(docs: DataFrame, shards: int, slots: int) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """The records as a written table, those of overfull slots dealt anew, and the loads of the slots."""
    records = cut(sized(docs, slots).withColumn("at", F.monotonically_increasing_id()))
    loads = slot_loads(records)
    bound = [sum(x[k] for x in loads) / (4 * shards) for k in (1, 2)]
    over = [slot for slot, b, n in loads if n > 1 and (b > bound[0] or n > bound[1])]
    if over:
        records = records.withColumn("vslot", F.when(F.col("vslot").isin(over), slot_of(F.col("vslot"), F.col("at"), slots=slots)).otherwise(F.col("vslot")))
        loads = slot_loads(records)
    return records, loads


def _placed(records: DataFrame, loads: list[tuple[int, int, int]], slot_map: SlotMap) -> DataFrame:
    n_rows = {slot: n for slot, _, n in loads}
    at = [0] * slot_map.shards
    rows = []
    for vslot, to in enumerate(slot_map.assignment):
        rows.append((vslot, to, at[to]))
        at[to] += n_rows.get(vslot, 0)
    where = records.sparkSession.createDataFrame(rows, "vslot int, shard int, before long")  # `slots` rows
    order = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        records.withColumn("nth", F.row_number().over(order) - 1)
        .join(F.broadcast(where), "vslot")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth")).alias("slot"), F.col("vslot").alias("virtual_slot"), F.lit(slot_map.version).cast("long").alias("map_version"))
    )


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, slot_map: SlotMap | None = None) -> DataFrame:
    """Place every document: shard and its position there, gapless from 0.

    Without a map, one is made from the slots' bytes. Rows alike in doc_id and
    text share a virtual slot, null or not, unless that is overfull; an empty
    table gives no rows. Positions come from row numbers within each virtual slot
    plus the rows of the shard's earlier slots, so no task sorts a whole shard.
    """
    records, loads = _dealt(docs, slot_map.shards if slot_map else shards, slots)
    return _placed(records, loads, slot_map or SlotMap.build(loads, shards, slots))


def shard_by_stored_map(docs: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS, tolerance: float = 0.0) -> DataFrame:
    """As ``shard``, with the map in the table at ``path``: its last version is edited for today's bytes, and stored.

    Where none is stored, the first version deals out slots by their rows, as for
    records whose sizes are not known yet.
    """
    spark = docs.sparkSession
    records, loads = _dealt(docs, shards, slots)
    if not SlotMap.stored(spark, path):
        SlotMap.build(((slot, n, n) for slot, _, n in loads), shards, slots).save(spark, path)
    SlotMap.load(spark, path).rebalance(loads, shards, tolerance).save(spark, path)
    return _placed(records, loads, SlotMap.load(spark, path))


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all documents in 16 shards of near equal bytes, by a map that is made, stored, edited and stored again."""
    placed = shard_by_stored_map(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_path(spark, "slot-map"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
