"""Checks of edits as queries: every finding is a row, not the first error only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog import model as M
from strandlog.functions.scalars import position_valid, value_error
from strandlog.sources.wire import LIMITS

LIST = ["edit_id", "op_index"]


def finding(df: DataFrame, check: str, at, subject) -> DataFrame:
    return df.select("edit_id", F.lit(check).alias("check"), F.col(at).alias("at"), F.col(subject).cast("binary").alias("subject"))


def _sets(ops: DataFrame) -> DataFrame:
    return ops.select(*LIST, "id", F.explode("set").alias("x")).select(*LIST, "id", F.col("x.property").alias("property"), F.col("x.value").alias("value"))


def _unsets(ops: DataFrame) -> DataFrame:
    return ops.select(*LIST, "id", F.explode("unset").alias("x")).select(*LIST, "id", "x.*")


def findings(ops: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(edit_id, check, at, subject): what an encoder would refuse; at is an op's index, subject the property, id or
    author. ops: edit_id and the op columns; heads: edit_id and authors."""
    sets, unsets = _sets(ops), _unsets(ops)
    kinds = sets.groupBy("edit_id", "property").agg(F.countDistinct("value.data_type").alias("n"), F.min("op_index").alias("op_index")).where("n > 1")
    hit = (F.col("u.mode") == M.UNSET_ALL) | ((F.col("u.mode") == M.UNSET_ENGLISH) & F.col("s.value.language").isNull()) | (F.col("u.language") == F.col("s.value.language"))
    overlap = sets.alias("s").join(unsets.alias("u"), [F.col(f"s.{c}") == F.col(f"u.{c}") for c in (*LIST, "property")]).where(hit).select("s.edit_id", "s.op_index", "s.property").distinct()
    typed = sets.groupBy("edit_id", "property").agg(F.min("value.data_type").alias("data_type"))
    language = unsets.where(F.col("mode") != M.UNSET_ALL).join(typed, ["edit_id", "property"]).where(F.col("data_type") != M.TEXT)
    refs = ops.where((F.col("op_type") == M.CREATE_VALUE_REF) & F.col("value_ref.language").isNotNull()).select(*LIST, F.col("value_ref.property").alias("property"))
    refs = refs.join(typed, ["edit_id", "property"]).where(F.col("data_type") != M.TEXT)
    dup = lambda df, *by: df.groupBy(*LIST, "property", *by).count().where("count > 1")
    order = ops.where(F.col("op_type").isin(M.DELETE_ENTITY, M.CREATE_ENTITY)).groupBy("edit_id", "id").agg(F.min(F.when(F.col("op_type") == M.DELETE_ENTITY, F.col("op_index"))).alias("gone"), F.max(F.when(F.col("op_type") == M.CREATE_ENTITY, F.col("op_index"))).alias("made")).where("gone < made")
    field = lambda name, bit: F.col(f"relation.{name}").isNotNull() & (F.coalesce(F.col("unset_fields"), F.lit(0)).bitwiseAND(F.lit(1 << bit)) != 0)
    both = F.lit(False)
    for bit, name in enumerate(M.FIELDS):
        both = both | field(name, bit)
    many = ops.groupBy("edit_id").agg(F.count(F.lit(1)).alias("n"), F.max("op_index").alias("op_index"), F.lit(None).cast("binary").alias("id")).where(F.col("n") > LIMITS["ops"])
    parts = [
        finding(kinds, "two types of a property", "op_index", "property"), finding(overlap, "set and unset", "op_index", "property"), finding(language, "language on what isn't text", "op_index", "property"),
        finding(refs, "a value ref's language on what isn't text", "op_index", "property"), finding(dup(sets, F.col("value.language")), "a slot set twice", "op_index", "property"), finding(dup(unsets, "mode", "language"), "a slot unset twice", "op_index", "property"),
        finding(order, "deleted, then created", "made", "id"),
        finding(ops.where((F.col("op_type") == M.CREATE_RELATION) & (F.col("relation.entity") == F.col("id"))), "a relation that is its own entity", "op_index", "id"),
        finding(ops.where(F.col("relation.position").isNotNull() & ~position_valid(F.col("relation.position"))), "position", "op_index", "id"),
        finding(ops.where((F.col("op_type") == M.UPDATE_RELATION) & both), "a field set and unset", "op_index", "id"),
        finding(sets.withColumn("e", value_error(F.col("value"))).where("e IS NOT NULL"), "value out of bounds", "op_index", "property"), finding(many, "too many ops", "op_index", "id"),
    ]
    if heads is not None:
        twice = heads.select("edit_id", F.explode("authors").alias("author")).groupBy("edit_id", "author").count().where("count > 1").withColumn("op_index", F.lit(None).cast("int"))
        crowd = heads.where(F.size("authors") > LIMITS["authors"]).select("edit_id", F.lit(None).cast("int").alias("op_index"), F.lit(None).cast("binary").alias("author"))
        parts += [finding(twice, "an author twice", "op_index", "author"), finding(crowd, "too many authors", "op_index", "author")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def schema_findings(ops: DataFrame, schema: DataFrame) -> DataFrame:
    """Values whose type isn't the registered one; unknown properties are fine. schema: (property, data_type), small."""
    wanted = schema.select("property", F.col("data_type").alias("want"))
    return _sets(ops).join(wanted, "property").where(F.col("want") != F.col("value.data_type")).select(*LIST, "id", "property", "want", F.col("value.data_type").alias("found"))


def squash(ops: DataFrame) -> DataFrame:
    """Ops without unsets that a set of the same op overrides, and without deletes that a later create of the edit follows,
    unless a restore stands between."""
    kept = F.filter("unset", lambda u: ~F.exists(F.coalesce(F.col("set"), F.array().cast(ops.schema["set"].dataType)), lambda s: (s["property"] == u["property"]) & (u["mode"] != M.UNSET_ALL) & s["value"]["language"].eqNullSafe(u["language"])))
    out = ops.withColumn("unset", kept)
    made = ops.where(F.col("op_type") == M.CREATE_ENTITY).groupBy("edit_id", "id").agg(F.max("op_index").alias("made"))
    back = ops.where(F.col("op_type") == M.RESTORE_ENTITY).groupBy("edit_id", "id").agg(F.max("op_index").alias("back"))
    dead = ops.where(F.col("op_type") == M.DELETE_ENTITY).join(made, ["edit_id", "id"]).join(back, ["edit_id", "id"], "left").where("op_index < made AND (back IS NULL OR back < op_index)")
    return out.join(dead.select("edit_id", "op_index"), ["edit_id", "op_index"], "left_anti")
