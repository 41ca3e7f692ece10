"""Near duplicates by SetSketch registers: sketch, band, estimate jointly, verify, link.

1. Each text becomes the set of its distinct word shingles: its size, a 128-bit digest, and its registers.
   Equal digests are one class; only the class's least id goes on, so exact copies never meet as pairs.
2. Bands of registers are bucket keys. Buckets of up to SMALL members give their pairs; in larger ones every
   member meets the bucket's first one. Pairs whose likeliest similarity is below LOOSE go.
3. Each class first verifies its best partner only, on full sets. That joins nearly all copies.
4. What can still change components is verified next: the other pairs between different components, and, in
   large buckets that hold several components, the pairs between these. There, blocks of members meet with their
   sets; each pair is looked at in the first bucket that it shares, and a block hands on no more links than join
   its components. Pairs inside a component need no check.

A link at similarity 0.8 shares none of 40 bands with probability (1 - 0.8^5)^40, about 1 in 10^7, and is estimated
below LOOSE with about 1 in 10^5. Links themselves are exact up to 64-bit hashes of shingles.

Defined cases: a text without words, or null, links with nothing; fewer words than a shingle make the whole
sequence one shingle; rows of one id are one vertex, each with its own set; a null id takes no part, its component
is null and it is kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm import setsketch as S
from strandlog.llm.components import components
from strandlog.llm.shared import arrow, checked_broadcast, forget, give_back, small_batches, written

ROWS = 5  # registers of a band
BANDS = S.REGISTERS // ROWS
LOOSE = 0.66
PERCENT = 80
SMALL = 24
BLOCK = 512


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sketches(docs: DataFrame, k: int = S.K) -> DataFrame:
    """doc_id, n (set size), digest and registers of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = {}
        for b in batches:
            n, digest, regs = [], [], []
            for h in S.shingle_sets(b.column("text"), k):
                d = xxhash.xxh3_128_digest(h)
                if d not in last:  # copies often stand together
                    last = {d: S.registers(h).tobytes()}
                n.append(len(h)), digest.append(d), regs.append(last[d])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "n", "digest", "registers"])

    return arrow(texts_of(docs), run, "doc_id long, n long, digest binary, registers binary")


def sets(docs: DataFrame, wanted: DataFrame, k: int = S.K) -> DataFrame:
    """(id, digest, hashes) of the rows whose doc_id is in wanted (id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = S.shingle_sets(b.column("text"), k)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([xxhash.xxh3_128_digest(x) for x in h], pa.binary()), pa.array([x.tobytes() for x in h], pa.binary())], names=["id", "digest", "hashes"])

    some = texts_of(docs).join(checked_broadcast(wanted.select(F.col("id").alias("doc_id")).distinct()), "doc_id", "left_semi")
    return arrow(some, run, "id long, digest binary, hashes binary")


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v, du, dv) that are links on their full sets, with the shared size."""
    ends = pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct()
    full = written(sets(docs, ends, k).dropDuplicates(["id", "digest"]), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("hu"), b.column("hv"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    one = full.select(F.col("id").alias("u"), F.col("digest").alias("du"), F.col("hashes").alias("hu"))
    other = full.select(F.col("id").alias("v"), F.col("digest").alias("dv"), F.col("hashes").alias("hv"))
    both = pairs.select("u", "v", "du", "dv").join(one, ["u", "du"]).join(other, ["v", "dv"]).select("u", "v", "hu", "hv")
    found = written(arrow(both, run, "u long, v long"), "links")
    forget(full)
    return found


def estimated(pairs: DataFrame, classes: DataFrame, loose: float) -> DataFrame:
    """Distinct pairs of classes (a < b) whose likeliest similarity isn't below loose, with that similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, S.REGISTERS) for c in ("ra", "rb"))
                na, nb = (b.column(c).to_numpy().astype(float) for c in ("na", "nb"))
                fit = S.likely(x, y, na, nb, loose)
                j = S.similarity(x[fit], y[fit], na[fit], nb[fit])
                out = b.select(["a", "b", "u", "v", "du", "dv"]).filter(pa.array(fit))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(j)], names=[*out.schema.names, "j"])

    one = classes.select(*(F.col(c).alias(n) for c, n in (("class", "a"), ("id", "u"), ("digest", "du"), ("n", "na"), ("registers", "ra"))))
    other = classes.select(*(F.col(c).alias(n) for c, n in (("class", "b"), ("id", "v"), ("digest", "dv"), ("n", "nb"), ("registers", "rb"))))
    both = pairs.join(one, "a").join(other, "b").select("a", "b", "u", "v", "du", "dv", "na", "nb", "ra", "rb")
    return arrow(both, run, "a long, b long, u long, v long, du binary, dv binary, j double")


def crossing(members: DataFrame, classes: DataFrame, small_sets: DataFrame, loose: float, percent: int) -> DataFrame:
    """Links (u, v, du, dv) between components inside large buckets, enough of them to join what is linked.

    members: (key, class, root, size) of buckets that hold several components; small_sets: (class, words), the sets'
    hashes cut to 32 bits, which only can make a pair look more alike.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    # a member goes to the cell of its block with every other: (i, j) with i <= j
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"))))
    # sizes, registers and sets come to a member once, before it is copied into its cells
    profiles = classes.select("class", "n", "registers").join(small_sets, "class")
    dealt = own.join(profiles, "class").withColumn("cell", cell)

    def run(b: pa.Table) -> pa.Table:
        one = lambda c: b[c][0].as_py()
        i, j, band = one("i"), one("j"), one("band")
        ids, block, n = b["class"].to_numpy(), b["block"].to_numpy(), b["n"].to_numpy().astype(float)
        roots = np.unique(b["root"].to_numpy(), return_inverse=True)[1]
        regs = np.frombuffer(b"".join(b["registers"].to_pylist()), np.uint16).reshape(-1, S.REGISTERS)
        words = [np.frombuffer(x, np.uint32) for x in b["words"].to_pylist()]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out = []
        for x in left:
            y = right[(roots[right] != roots[x]) & ((ids[right] > ids[x]) if i == j else True)]
            y = y[np.minimum(n[y], n[x]) * 100 >= percent * np.maximum(n[y], n[x])]
            if not len(y):
                continue
            # only in the first band that both share
            y = y[(regs[y] == regs[x]).reshape(len(y), BANDS, ROWS).all(2).argmax(1) == band]
            y = y[likely_rows(regs, n, x, y, loose)]
            for z in y:
                if roots[z] == roots[x]:
                    continue
                both = len(np.intersect1d(words[x], words[z], assume_unique=True))
                if 100 * both >= percent * (n[x] + n[z] - both):
                    out.append((x, z))
                    roots[roots == roots[z]] = roots[x]
        at, to = (pa.array([p[i] for p in out], pa.int64()) for i in (0, 1))
        found = pa.table([b[c].take(k).combine_chunks() for c, k in (("id", at), ("id", to), ("digest", at), ("digest", to))], names=["u", "v", "du", "dv"])
        del regs, words
        give_back()
        return found

    flat = dealt.select("key", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "class", "root", "block", "band", "n", "registers", "words", "id", "digest")
    return flat.groupBy("key", "i", "j").applyInArrow(run, "u long, v long, du binary, dv binary").distinct()


def cut_sets(full: DataFrame) -> DataFrame:
    """(digest, words): distinct 32-bit hashes of the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [np.unique((np.frombuffer(x, np.uint64) >> np.uint64(32)).astype(np.uint32)).tobytes() for x in b.column("hashes").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(words, pa.binary())], names=["digest", "words"])

    return arrow(full.select("digest", "hashes"), run, "digest binary, words binary").dropDuplicates(["digest"])


def likely_rows(regs: np.ndarray, n: np.ndarray, x: int, y: np.ndarray, loose: float) -> np.ndarray:
    if not len(y):
        return np.zeros(0, bool)
    return S.likely(np.broadcast_to(regs[x], (len(y), S.REGISTERS)), regs[y], np.full(len(y), n[x]), n[y], loose)


def near_duplicates(docs: DataFrame, k: int = S.K, percent: int = PERCENT, loose: float = LOOSE) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept."""
    small_batches(docs.sparkSession)
    rows = written(sketches(docs, k), "sketches")
    # a class is all rows with one digest; a class number that holds several ids of one document apart is its digest's hash
    grouped = rows.where("doc_id IS NOT NULL AND n > 0").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    classes = written(grouped.select(F.xxhash64("digest").alias("class"), "id", "digest", "n", "registers"), "classes")

    keys = F.posexplode(F.array(*(F.xxhash64(F.lit(i), F.substring("registers", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS))))
    bands = classes.select("class", F.struct("n", "class").alias("order"), keys.alias("band", "key"))
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("order").alias("first")).where("size > 1")
    members = written(bands.join(buckets, "key").select("key", "band", "class", "size", F.col("first.class").alias("first")), "members")
    small = members.where(F.col("size") <= SMALL).select("key", "class")
    pairs = small.withColumnRenamed("class", "a").join(small.withColumnRenamed("class", "b"), "key").where("a < b").select("a", "b")
    star = members.where((F.col("size") > SMALL) & (F.col("class") != F.col("first"))).select(F.least("class", "first").alias("a"), F.greatest("class", "first").alias("b"))
    likely = written(estimated(pairs.union(star).distinct(), classes, loose), "pairs")

    # every class verifies its best partner that comes before it
    best = likely.groupBy("b").agg(F.max_by(F.struct("a", "u", "v", "du", "dv"), F.struct("j", -F.col("a"))).alias("x")).select("x.*", "b")
    links = verified(best, docs, k, percent)
    ids = rows.where("doc_id IS NOT NULL AND n > 0").select("doc_id", "digest").join(classes.select("digest", "id"), "digest")
    # rows of one id with several sets are one vertex: their classes are linked
    same = ids.groupBy("doc_id").agg(F.min("id").alias("v"), F.max("id").alias("hi")).where("v != hi")
    same = ids.join(same, "doc_id").where("id != v").select(F.col("id").alias("u"), "v")
    roots = components(links.union(same))

    # what may still join components
    rooted = lambda df, on, out: df.join(roots.select(F.col("id").alias(on), F.col("root").alias(out)), on, "left").withColumn(out, F.coalesce(out, on))
    open_pairs = rooted(rooted(likely, "u", "ru"), "v", "rv").where("ru != rv").select("a", "b", "u", "v", "du", "dv", "j")
    tested = best.select("a", "b")
    rest = open_pairs.join(tested, ["a", "b"], "left_anti")
    rest = written(rest.select("u", "v", "du", "dv"), "rest")
    done = [likely, links, rest, members]
    large = rooted(members.where(F.col("size") > SMALL).select("key", "band", "class", "size").join(classes.select("class", "id", "digest"), "class"), "id", "root")
    several = large.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    open_members = written(large.join(several, "key", "left_semi"), "open")
    done.append(open_members)
    if not open_members.isEmpty():
        ids_left = open_members.select("class", "id", "digest").distinct()
        small_sets = written(cut_sets(sets(docs, ids_left, k)).join(ids_left.select("class", "digest"), "digest").select("class", "words"), "cut-sets")
        rest = written(rest.union(crossing(open_members, classes, small_sets, loose, percent)).distinct(), "rest")
        done += [small_sets, rest]
    if not rest.isEmpty():
        more = verified(rest, docs, k, percent)
        joined = more.select(*(F.col(c) for c in ("u", "v"))).union(roots.where("id != root").select(F.col("id").alias("u"), F.col("root").alias("v")))
        done += [more, roots]
        roots = components(joined)
    for table in done:
        forget(table)

    # copies take the component of their class's least id
    root_of = rooted(ids, "id", "root").groupBy("doc_id").agg(F.min("root").alias("component_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(root_of, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
