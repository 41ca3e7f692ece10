"""Fixed virtual slots.

A record's key hashes to one of thousands of virtual slots, which never changes. Rows and bytes are summed per
slot; a small versioned table maps slots to shards. Rebalancing only edits that table: version 0 deals the slots
round, each later version moves or swaps slots until the shards' byte loads are near equal, or hands slots to a
new shard. Records move only if their slot does.

Defined cases: a null text has size 1; a null key hashes like any other key; repeated rows are separate records
of one slot; an empty table gives an empty result and the round-robin map.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandlog.llm.shared import new_path

N_SLOTS = 4096
#: Rows of one slot are ranked in this many parts, so that no part holds a hot slot alone.
N_PARTS = 8


def slot_of(key, n_slots: int = N_SLOTS):
    return F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int")


def first_map(n_slots: int, n_shards: int) -> np.ndarray:
    return np.arange(n_slots) % n_shards


def rebalance(slot_bytes: np.ndarray, shards: np.ndarray, n_shards: int, most_edits: int = 100_000) -> list[tuple[int, int, int]]:
    """Edits (slot, from, to) that bring the heaviest and the lightest shard together, until none helps.

    Each step moves one slot, or swaps two, between those two shards: whichever leaves the smaller difference.
    """
    shards, edits = shards.copy(), []
    loads = np.bincount(shards, weights=slot_bytes, minlength=n_shards).astype(np.int64)
    while len(edits) < most_edits:
        heavy, light = int(loads.argmax()), int(loads.argmin())
        gap = loads[heavy] - loads[light]
        own, other = np.flatnonzero(shards == heavy), np.flatnonzero(shards == light)
        if gap <= 1 or not len(own):
            break
        # candidate transfers: a slot alone, or against each nearest lighter slot of the other shard
        give = slot_bytes[own].astype(np.int64)
        order = np.argsort(slot_bytes[other], kind="stable")
        back = np.concatenate([[0], slot_bytes[other][order].astype(np.int64)])
        at = np.clip(np.searchsorted(back, give - gap // 2), 0, len(back) - 1)
        near = np.stack([at, np.maximum(at - 1, 0)])
        left = np.abs(gap - 2 * (give[None, :] - back[near]))
        row, col = np.unravel_index(left.argmin(), left.shape)
        if left[row, col] >= gap:
            break
        moved = give[col] - back[near[row, col]]
        edits.append((int(own[col]), heavy, light))
        shards[own[col]] = light
        if near[row, col]:
            swap = int(other[order[near[row, col] - 1]])
            edits.append((swap, light, heavy))
            shards[swap] = heavy
        loads[heavy] -= moved
        loads[light] += moved
    return edits


def grow(slot_bytes: np.ndarray, shards: np.ndarray, n_shards: int) -> list[tuple[int, int, int]]:
    """Edits that fill one more shard: each slot moves only into the new one, from the heaviest shard so far."""
    loads = np.bincount(shards, weights=slot_bytes, minlength=n_shards + 1).astype(np.int64)
    fair, edits = loads.sum() // (n_shards + 1), []
    left = {s: list(np.flatnonzero(shards == s)[np.argsort(slot_bytes[shards == s], kind="stable")]) for s in range(n_shards)}
    while loads[n_shards] < fair:
        donor = int(loads[:n_shards].argmax())
        if not left[donor]:
            break
        slot = left[donor].pop()
        if loads[n_shards] + slot_bytes[slot] > fair + slot_bytes.max():
            continue
        edits.append((int(slot), donor, n_shards))
        loads[donor] -= slot_bytes[slot]
        loads[n_shards] += slot_bytes[slot]
    return edits


class SlotMap:
    """The versioned slot-to-shard map, kept as a small Parquet table (version, slot, shard)."""

    SCHEMA = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("slot", T.IntegerType()), T.StructField("shard", T.IntegerType())])

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def store(self, version: int, shards: np.ndarray) -> None:
        rows = [(version, i, int(s)) for i, s in enumerate(shards)]
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/v{version:06d}")

    def edit(self, version: int, edits: list[tuple[int, int, int]]) -> int:
        """Apply edits to a stored version; returns the new version."""
        shards = self.load(version)
        for slot, _, to in edits:
            shards[slot] = to
        self.store(version + 1, shards)
        return version + 1

    def load(self, version: int) -> np.ndarray:
        rows = self.frame(version).orderBy("slot").collect()  # one row for each slot: bounded by n_slots
        return np.array([r["shard"] for r in rows])

    def frame(self, version: int) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/v{version:06d}")


def slot_totals(rows: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Rows and bytes per (slot, part); at most n_slots * N_PARTS rows, summed before the shuffle."""
    return rows.groupBy("__slot", "__part").agg(F.count(F.lit(1)).alias("__rows"), F.sum("size").alias("__bytes"))


def shard_documents(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, key: str = "doc_id", text: str = "text", map_path: str | None = None) -> DataFrame:
    """Deal documents into shards under the `bytes` law; one row per record with its virtual slot and its place in the shard."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("__slot", slot_of(F.col("doc_id"), n_slots)).withColumn("__part", F.pmod(F.xxhash64("text_crc32", "size"), F.lit(N_PARTS)).cast("int"))
    parts = slot_totals(rows, n_slots).collect()  # bounded: n_slots * N_PARTS sums
    counts, sizes = np.zeros((n_slots, N_PARTS), np.int64), np.zeros((n_slots, N_PARTS), np.int64)
    for r in parts:
        counts[r["__slot"], r["__part"]], sizes[r["__slot"], r["__part"]] = r["__rows"], r["__bytes"]
    slot_bytes = sizes.sum(1)

    slots = SlotMap(spark, map_path or new_path(spark, "slot-map"))
    shards = first_map(n_slots, n_shards)
    slots.store(0, shards)
    version = slots.edit(0, rebalance(slot_bytes, shards, n_shards))
    shards = slots.load(version)

    # places: shards in order of (slot, part), so a row's place is its rank in the part plus what stands before
    order = np.lexsort((np.arange(n_slots), shards))
    starts = np.zeros((n_slots, N_PARTS), np.int64)
    for s in range(n_shards):
        own = order[shards[order] == s]
        flat = counts[own].ravel()
        starts[own] = (np.cumsum(flat) - flat).reshape(len(own), N_PARTS)
    table = [(i, p, int(shards[i]), int(starts[i, p]), int(slot_bytes[i])) for i in range(n_slots) for p in range(N_PARTS) if counts[i, p]]
    places = spark.createDataFrame(table, "__slot int, __part int, shard int, __start long, slot_bytes long")
    rank = F.row_number().over(Window.partitionBy("__slot", "__part").orderBy("doc_id", "text_crc32", "size"))
    return (
        rows.withColumn("__rank", rank.cast("long") - 1)
        .join(F.broadcast(places), ["__slot", "__part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__start") + F.col("__rank")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), F.col("__slot").alias("virtual_slot"), F.lit(version).alias("map_version"),
        )
    )
