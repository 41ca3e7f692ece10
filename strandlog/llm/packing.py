"""Best-fit packing by exact-complement hashing, planned on the histogram of piece lengths.

Sequences hold at most `size` tokens. Lengths are at most `size`, so all pieces together are a histogram of `size`
counts, however many documents there are. The plan works on counts: for the longest length left, the gap beside it
is looked up among the sums of one, two and three lengths that are still available, and the combination is consumed
as often as its counts allow. Only when no such sum fills the gap exactly, the largest lengths that fit go in
(best fit). Every step uses up at least one length, so the plan has a bounded number of patterns. A second,
distributed step ranks the pieces of each length and reads their sequence and offset from the plan.

Defined cases: a null text has no ids but the end id; a document longer than `size` is cut into pieces of `size`
and a rest; equal documents are separate pieces; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandlog.llm.bpe import tokenizer
from strandlog.llm.shared import arrow, batch, local_table, written

SIZE = 2048
END_ID = 0
#: Pieces of one length are ranked in parts of about so many, however many there are.
PART_ROWS = 1 << 20
#: Texts are encoded in groups of about so many bytes: a group's arrays are some 60 times its size, in each worker.
GROUP_BYTES = 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of at most `size` ids: its place in the document, its length and the checksum of its ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer(tokenizer_path, group_bytes=GROUP_BYTES), np.array([END_ID], "<u4")
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(tok.encode(b.column(1))):
                ids = np.concatenate([ids, end])
                for p, at in enumerate(range(0, len(ids), size)):
                    own = ids[at : at + size]
                    row.append(i), piece.append(p), start.append(at), length.append(len(own)), crc.append(zlib.crc32(own))
            yield batch(_PIECES, b.column(0).take(pa.array(row, pa.int64())), piece, start, length, crc)

    return arrow(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), cut, PIECES, keeps=True, trims=True)


def fill(free: np.ndarray, gap: int) -> tuple[int, ...]:
    """The lengths, longest first, that exactly fill the gap: one, a pair or a triple among the available counts; else ()."""
    if gap <= 0 or gap >= len(free):
        return ()
    if free[gap]:
        return (gap,)

    def pair(total: int, most: int) -> tuple[int, ...]:
        x = np.arange(min(total - 1, most), (total + 1) // 2 - 1, -1)
        x = x[(free[x] > 0) & (free[total - x] > 0)] if len(x) else x
        x = x[(2 * x != total) | (free[x] > 1)] if len(x) else x
        return (int(x[0]), int(total - x[0])) if len(x) else ()

    if found := pair(gap, gap):
        return found
    for a in np.flatnonzero(free[: gap - 1])[::-1]:
        if 3 * a < gap:
            break
        free[a] -= 1
        rest = pair(gap - int(a), int(a))
        free[a] += 1
        if rest:
            return (int(a), *rest)
    return ()


def pattern(free: np.ndarray, longest: int, size: int) -> list[int]:
    """The lengths of one sequence that starts with the longest length left."""
    free, held, gap = free.copy(), [longest], size - longest
    free[longest] -= 1
    while gap:
        exact = fill(free, gap)
        if exact:
            return held + list(exact)
        fits = np.flatnonzero(free[1 : gap + 1])  # best fit: the largest that fits, then an exact rest again
        if not len(fits):
            break
        held.append(int(fits[-1]) + 1)
        free[held[-1]] -= 1
        gap -= held[-1]
    return held


def plan(counts: np.ndarray, size: int = SIZE) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one sequence, number of such sequences) that use every piece of the histogram once."""
    free, out = counts.astype(np.int64).copy(), []
    free[0] = 0
    for longest in range(size, 0, -1):
        while free[longest]:
            held = pattern(free, longest, size)
            taken = np.bincount(held, minlength=size + 1)
            used = np.flatnonzero(taken)
            times = int((free[used] // taken[used]).min())  # as often as the counts allow
            free[used] -= times * taken[used]
            out.append((held, times))
    return out


def runs(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of its runs, ascending; what to add to a rank to get its sequence; the offset there."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for held, times in patterns:
        at = 0
        for x in held:
            lo = used.get(x, 0)
            out.setdefault(x, []).append((lo, first - lo, at))
            used[x] = lo + times
            at += x
        first += times
    return {x: tuple(np.array(v, np.int64).T) for x, v in out.items()}


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32); pieces should be a written table."""
    spark = pieces.sparkSession
    # a piece of full length is a sequence of its own, with a negative number: it needs no rank
    full = pieces.where(F.col("length") == size).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = pieces.where(F.col("length") < size)
    of_length = {r["length"]: r["n"] for r in rest.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # under `size` rows
    n_parts = local_table(spark, pa.table({"length": pa.array(of_length.keys(), pa.int64()), "n_parts": pa.array([-(-n // PART_ROWS) for n in of_length.values()], pa.int64())}))
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("n_parts")).cast("int")
    parted = rest.join(F.broadcast(n_parts), "length").select(*pieces.columns, part.alias("__part"))
    before: dict[int, np.ndarray] = {x: np.zeros(-(-n // PART_ROWS), np.int64) for x, n in of_length.items()}
    if max(map(len, before.values()), default=1) > 1:  # a row for each PART_ROWS pieces
        for r in parted.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("n")).collect():
            before[r["length"]][r["__part"]] = r["n"]
        before = {x: np.cumsum(n) - n for x, n in before.items()}
    counts = np.zeros(size + 1, np.int64)
    counts[list(of_length)] = list(of_length.values())
    placed = spark.sparkContext.broadcast((before, runs(plan(counts, size))))  # bounded by the histogram
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, by_length = placed.value
        for b in batches:
            length, part, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__part", "__rank"))
            seq, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                lo, shift, at = by_length[int(x)]
                place = rank[own] + before[int(x)][part[own]]
                k = np.searchsorted(lo, place, "right") - 1
                seq[own], offset[own] = place + shift[k], at[k]
            out = b.drop_columns(["__part", "__rank"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(seq), pa.array(offset)], names=[*out.schema.names, "sequence_id", "offset"])

    rank = F.row_number().over(Window.partitionBy("length", "__part").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = parted.withColumn("__rank", rank.cast("long") - 1)
    return arrow(ranked, place, schema).unionByName(full.select(*(f.name for f in schema)))


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = SIZE) -> DataFrame:
    return pack(written(tokenized_pieces(docs, tokenizer_path, size), "pieces"), size)
