"""Questions to a resolved state: patterns, paths, provenance, similarity. All take and give DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def one_hop(relations: DataFrame, kind, sources: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(from, to) of relations of a type, optionally only between given ids."""
    out = relations.where(F.col("type") == kind) if kind is not None else relations
    if sources is not None:
        out = out.join(sources.select(F.col("id").alias("from")), "from", "left_semi")
    if targets is not None:
        out = out.join(targets.select(F.col("id").alias("to")), "to", "left_semi")
    return out.select("from", "to")


def two_hop(first: DataFrame, second: DataFrame) -> DataFrame:
    """(a, b, c): a -> b in the first edges, b -> c in the second."""
    return first.select(F.col("from").alias("a"), F.col("to").alias("b")).join(second.select(F.col("from").alias("b"), F.col("to").alias("c")), "b").select("a", "b", "c")


def reachable(edges: DataFrame, starts: DataFrame, keep, most_steps: int = 50) -> DataFrame:
    """(start, id, steps): everything reached from the starts, by the frontier; each step only follows what is new.
    keep cuts the lineage of a step, as by writing it to a shared folder. RuntimeError if most_steps aren't enough."""
    frontier = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("steps")).distinct()
    seen = frontier
    step = edges.select(F.col("from").alias("id"), F.col("to").alias("next")).distinct()
    for i in range(1, most_steps + 1):
        reached = frontier.join(step, "id").select("start", F.col("next").alias("id")).distinct()
        frontier = keep(reached.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("steps", F.lit(i)))
        if frontier.isEmpty():
            break
        seen = keep(seen.unionByName(frontier))
    else:
        raise RuntimeError(f"there are paths of more than {most_steps} steps")
    return seen


def language_choice(values: DataFrame, preferred: list) -> DataFrame:
    """One text per (space, id, property): by the order of preferred languages (None is English), then by language id."""
    rank = F.lit(len(preferred))
    for i, lang in reversed(list(enumerate(preferred))):
        rank = F.when(F.col("language").isNull() if lang is None else F.col("language") == lang, F.lit(i)).otherwise(rank)
    w = Window.partitionBy("space", "id", "property").orderBy(rank, "language")
    return values.withColumn("choice", F.row_number().over(w)).where("choice = 1").drop("choice")


def ordered(relations: DataFrame, by: list[str]) -> DataFrame:
    """Add `place` within each group: positions in byte order first, then by relation id."""
    return relations.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("position").asc_nulls_last(), "id")))


def dangling(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Add from_dangling and to_dangling: whether an endpoint is no entity of the space."""
    known = entities.select("space", "id")
    out = relations
    for end in ("from", "to"):
        out = out.join(known.select("space", F.col("id").alias(end), F.lit(True).alias("known")), ["space", end], "left").withColumn(f"{end}_dangling", F.col("known").isNull()).drop("known")
    return out


def diff(before: DataFrame, after: DataFrame, key: list[str], payload: str) -> DataFrame:
    """Rows that were added, removed or changed between two states."""
    b, a = before.select(*key, F.col(payload).alias("old")).alias("b"), after.select(*key, F.col(payload).alias("new")).alias("a")
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"a.{k}")) for k in key]
    both = b.withColumn("in_b", F.lit(True)).join(a.withColumn("in_a", F.lit(True)), on, "full_outer")
    change = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.select(*(F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in key), "old", "new", change.alias("change")).where("change IS NOT NULL")


def quads(values: DataFrame, relations: DataFrame, literal=None) -> DataFrame:
    """The logical view as rows (space, kind, s, p, o): property(e, v) of each value; of each relation type(from, to), and
    what its reified entity states: reifies, subject, predicate and object. o is hexadecimal for ids; literal gives the
    text of a value, by default the hash of its JSON form."""
    literal = F.sha2(F.to_json("value"), 256) if literal is None else literal
    prop = values.select("space", F.lit("property").alias("kind"), F.col("id").alias("s"), F.col("property").alias("p"), literal.alias("o"))
    said = lambda kind, s, p, o: F.struct(F.lit(kind).alias("kind"), F.col(s).alias("s"), (F.col(p) if p else F.lit(None).cast("binary")).alias("p"), F.lower(F.hex(o)).alias("o"))
    rows = [said("relation", "from", "type", "to"), said("reifies", "entity", None, "id"), said("subject", "entity", None, "from"), said("predicate", "entity", None, "type"), said("object", "entity", None, "to")]
    return prop.unionByName(relations.select("space", F.explode(F.array(*rows)).alias("x")).select("space", "x.*"))


def context_groups(ops: DataFrame) -> DataFrame:
    """Ops grouped by their context: (space, root_id, path, n_ops, n_entities); path is the list of the edges' types, and
    entities are those that the edges lead to, or the root of an empty path. Ops without a context are in no group."""
    c = ops.where("context IS NOT NULL").select("space", "context.root_id", F.transform("context.edges", lambda e: e["type_id"]).alias("path"), F.col("context.edges").alias("edges"))
    leaf = F.coalesce(F.try_element_at("edges", F.lit(-1))["to_entity_id"], F.col("root_id"))
    return c.groupBy("space", "root_id", "path").agg(F.count(F.lit(1)).alias("n_ops"), F.count_distinct(leaf).alias("n_entities"))


def by_space(values: DataFrame, preferred: list) -> DataFrame:
    """One value per slot over several spaces: that of the space which stands first in preferred, then of the least space."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, preferred)), F.col("space")), F.lit(0))
    w = Window.partitionBy("id", "property", "language").orderBy(F.when(rank > 0, rank).otherwise(len(preferred) + 1), "space")
    return values.withColumn("choice", F.row_number().over(w)).where("choice = 1").drop("choice")


def numbered(rows: DataFrame, by: list, keep) -> DataFrame:
    """Add `place`, the row's number in a total order, without bringing all rows to one task: rows are dealt by ranges,
    each range is numbered, and ranges start where those before them end. keep as in reachable()."""
    dealt = keep(rows.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()))
    sizes = sorted((r["__range"], r["n"]) for r in dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each range
    before, starts = 0, []
    for k, n in sizes:
        starts.append((k, before))
        before += n
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "__range int, __before long"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*by)) + F.col("__before")
    return dealt.join(starts, "__range").withColumn("place", place.cast("long")).drop("__range", "__before")


def nearest(vectors: DataFrame, query, k: int, similarity) -> DataFrame:
    """The k vectors most similar to one: a top-k, so no sort of everything."""
    return vectors.withColumn("similarity", similarity(F.col("embedding"), query)).orderBy(F.desc("similarity"), "vec_id").limit(k)


def pivot(values: DataFrame, properties: dict, payload: str) -> DataFrame:
    """One wide row per entity: a column for each listed property, without a pivot's extra pass."""
    cols = [F.max(F.when((F.col("property") == p) & F.col("language").isNull(), F.col(payload))).alias(n) for n, p in properties.items()]
    return values.groupBy("space", "id").agg(*cols)
