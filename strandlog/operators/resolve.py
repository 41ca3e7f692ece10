"""The resolver: from a log of ops to state, set-based.

Input is a DataFrame of ops: space, ord (a struct that orders ops), op_type, id, and as needed set, unset, relation,
unset_fields, value_ref. Sequential replay factorises: whether an op is accepted depends only on who owns its id and on
the last delete or restore before it, so each step is one aggregate or window keyed by (space, id), and an as-of
state is the same accepted ops cut at a position. A State reads the log twice, for the owners and for the accepted ops;
both are written to the session's shared folder once, and every view is made from them. Values are opaque here: any type of column will do.

A relation's explicit entity that is also claimed as a relation or value ref is not iterated to a fixpoint: the
entity claim that comes later is ignored and flagged by `reified_conflicts`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlog import model as M
from strandlog.functions.ids import LANGUAGE_PREFIX, relation_entity_id, uuid8
from strandlog.plans.shared import written

ENTITY, RELATION, VALUE_REF = "E", "R", "V"
KEY = ["space", "id"]


def reified_id():
    return F.coalesce("relation.entity", relation_entity_id(F.col("id")))


def direct_claims(ops: DataFrame) -> DataFrame:
    """(space, id, kind, ord, late, reified): what creates claim an id as; a relation also names its reified entity."""
    kind = F.when(F.col("op_type") == M.CREATE_ENTITY, ENTITY).when(F.col("op_type") == M.CREATE_RELATION, RELATION).otherwise(VALUE_REF)
    reified = F.when(F.col("op_type") == M.CREATE_RELATION, reified_id())
    return ops.where(F.col("op_type").isin(M.CREATE_ENTITY, M.CREATE_RELATION, M.CREATE_VALUE_REF)).select(*KEY, kind.alias("kind"), "ord", F.lit(0).alias("late"), reified.alias("reified"))


def reified_claims(direct: DataFrame) -> DataFrame:
    """The entity that each relation's winning create claims; late claims come after others of the same op."""
    first = direct.groupBy(*KEY).agg(F.min_by(F.struct("kind", "reified"), "ord").alias("x"), F.min("ord").alias("ord"))
    return first.where(F.col("x.kind") == RELATION).select("space", F.col("x.reified").alias("id"), F.lit(ENTITY).alias("kind"), "ord", F.lit(1).alias("late"))


def claims(ops: DataFrame) -> DataFrame:
    """(space, id, kind, ord, late): everything that claims an id."""
    direct = direct_claims(ops)
    return direct.drop("reified").unionByName(reified_claims(direct))


def owners(ops: DataFrame) -> DataFrame:
    """owners_of(claims(ops)) from one pass over the log: each id's first claim first, then the reified ones."""
    first = direct_claims(ops).groupBy(*KEY).agg(F.min_by(F.struct("kind", "reified"), "ord").alias("x"), F.min("ord").alias("ord"))
    first = written(first.select(*KEY, "x.kind", "x.reified", "ord"))
    late = first.where(F.col("kind") == RELATION).select("space", F.col("reified").alias("id"), F.lit(ENTITY).alias("kind"), "ord", F.lit(1).alias("late"))
    return owners_of(first.select(*KEY, "kind", "ord", F.lit(0).alias("late")).unionByName(late))


def owners_of(all_claims: DataFrame) -> DataFrame:
    """The first kind to claim an id has it: (space, id, kind, created)."""
    order = F.struct("ord", "late")
    return all_claims.groupBy(*KEY).agg(F.min_by("kind", order).alias("kind"), F.min("ord").alias("created"))


def collisions(all_claims: DataFrame) -> DataFrame:
    """Claims of a kind that the id's owner isn't."""
    return all_claims.join(owners_of(all_claims).withColumnRenamed("kind", "owner"), KEY).where("kind != owner").select(*KEY, "owner", "kind", "ord")


def reified_conflicts(ops: DataFrame) -> DataFrame:
    return collisions(claims(ops)).where(F.col("kind") == ENTITY)


def _target(op_type):
    return F.when(op_type <= M.RESTORE_ENTITY, ENTITY).when(op_type <= M.RESTORE_RELATION, RELATION).otherwise(VALUE_REF)


def accepted(ops: DataFrame, owners: DataFrame) -> DataFrame:
    """The ops that take effect: on an id of their kind, from its creation on, and not while it is deleted."""
    own = ops.join(owners, KEY).where((_target(F.col("op_type")) == F.col("kind")) & (F.col("ord") >= F.col("created")))
    refs, own = own.where(F.col("op_type") == M.CREATE_VALUE_REF), own.where(F.col("op_type") != M.CREATE_VALUE_REF)  # a ref isn't deleted, so its history needs no order
    switch = F.when(F.col("op_type").isin(M.DELETE_ENTITY, M.DELETE_RELATION), "D").when(F.col("op_type").isin(M.RESTORE_ENTITY, M.RESTORE_RELATION), "A")
    before = F.last(switch, ignorenulls=True).over(Window.partitionBy(*KEY).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("before", F.coalesce(before, F.lit("A")))
    restores = F.col("op_type").isin(M.RESTORE_ENTITY, M.RESTORE_RELATION)
    late_create = (F.col("op_type").isin(M.CREATE_RELATION)) & (F.col("ord") > F.col("created"))
    return own.where(F.when(restores, F.col("before") == "D").otherwise((F.col("before") == "A") & ~late_create)).drop("before").unionByName(refs)


def status(owners: DataFrame, taken: DataFrame) -> DataFrame:
    """(space, id, kind, created, status): ACTIVE or DELETED by the last accepted delete or restore."""
    switches = taken.where(F.col("op_type").isin(M.DELETE_ENTITY, M.RESTORE_ENTITY, M.DELETE_RELATION, M.RESTORE_RELATION))
    last = switches.groupBy(*KEY).agg(F.max_by("op_type", "ord").alias("last"))
    gone = F.col("last").isin(M.DELETE_ENTITY, M.DELETE_RELATION)
    return owners.join(last, KEY, "left").select(*owners.columns, F.when(gone, "DELETED").otherwise("ACTIVE").alias("status"))


def lookup(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """State of (space, id): its status, or NOT_FOUND."""
    return wanted.join(objects.select(*KEY, "kind", "status"), KEY, "left").withColumn("status", F.coalesce("status", F.lit("NOT_FOUND")))


def slot_events(taken: DataFrame, fold_english: bool = True) -> DataFrame:
    """One row per set or unset of a slot: (space, id, property, language, ord, seq, idx, mode, value); unsets come first
    in an op. No language means English, so English given explicitly is folded into it, unless told otherwise."""
    edits = taken.where(F.col("op_type").isin(M.CREATE_ENTITY, M.UPDATE_ENTITY))
    sets = edits.select(*KEY, "ord", F.posexplode("set").alias("idx", "x")).select(*KEY, F.col("x.property").alias("property"), F.col("x.value.language").alias("language"), "ord", F.lit(1).alias("seq"), "idx", F.lit(None).cast("tinyint").alias("mode"), F.col("x.value").alias("value"))
    unsets = edits.select(*KEY, "ord", F.posexplode("unset").alias("idx", "x")).select(*KEY, F.col("x.property").alias("property"), F.when(F.col("x.mode") == M.UNSET_LANGUAGE, F.col("x.language")).alias("language"), "ord", F.lit(0).alias("seq"), "idx", F.col("x.mode").cast("tinyint").alias("mode"))
    both = sets.unionByName(unsets.withColumn("value", F.lit(None).cast(sets.schema["value"].dataType)))
    english = F.lit(uuid8((LANGUAGE_PREFIX + "en").encode()))
    return both.withColumn("language", F.when(F.col("language") != english, F.col("language"))) if fold_english else both


def values(events: DataFrame) -> DataFrame:
    """Live slots (space, id, property, language, value, set_at): the last event is a set, and no clear-all is later."""
    slot = [*KEY, "property", "language"]
    order = F.struct("ord", "seq", "idx")
    cleared = events.where(F.col("mode") == M.UNSET_ALL).groupBy(*KEY, "property").agg(F.max("ord").alias("cleared"))
    last = events.where((F.col("mode") != M.UNSET_ALL) | F.col("mode").isNull()).groupBy(*slot).agg(F.max_by(F.struct("seq", "value", "ord"), order).alias("x"))
    live = last.where("x.seq = 1").join(cleared, [*KEY, "property"], "left").where("cleared IS NULL OR x.ord >= cleared")
    return live.select(*slot, F.col("x.value").alias("value"), F.col("x.ord").alias("set_at"))


def relations(taken: DataFrame) -> DataFrame:
    """(space, id) with the structure of the winning create and the last write of each mutable field."""
    edits = taken.where(F.col("op_type").isin(M.CREATE_RELATION, M.UPDATE_RELATION))
    create = F.col("op_type") == M.CREATE_RELATION
    structure = F.max_by(F.struct(F.col("relation.type").alias("type"), F.col("relation.from").alias("from"), F.col("relation.to").alias("to"), F.col("relation.from_is_value_ref").alias("from_is_value_ref"), F.col("relation.to_is_value_ref").alias("to_is_value_ref"), reified_id().alias("entity")), F.when(create, F.col("ord")))
    fields = []
    for bit, name in enumerate(M.FIELDS):
        given, unset = F.col(f"relation.{name}"), F.coalesce(F.col("unset_fields"), F.lit(0)).bitwiseAND(F.lit(1 << bit)) != 0
        fields.append(F.max_by(F.struct(given.alias("v")), F.when(create | given.isNotNull() | unset, F.col("ord"))).alias(name))
    out = edits.groupBy(*KEY).agg(structure.alias("s"), *fields)
    return out.select(*KEY, "s.*", *(F.col(f"{n}.v").alias(n) for n in M.FIELDS))


def value_refs(taken: DataFrame) -> DataFrame:
    """(space, ref_id, entity, property, language, slot_space): a slot's last ref, then a ref's last slot."""
    refs = taken.where(F.col("op_type") == M.CREATE_VALUE_REF).select("space", F.col("id").alias("ref_id"), "value_ref.entity", "value_ref.property", "value_ref.language", F.coalesce(F.col("value_ref.space").cast(taken.schema["space"].dataType), F.col("space")).alias("slot_space"), "ord")
    slot = ["space", "entity", "property", "language", "slot_space"]
    by_slot = refs.groupBy(*slot).agg(F.max_by("ref_id", "ord").alias("ref_id"), F.max("ord").alias("ord"))
    return by_slot.groupBy("space", "ref_id").agg(F.max_by(F.struct("entity", "property", "language", "slot_space"), "ord").alias("x")).select("space", "ref_id", "x.*")


def edit_ends(ops: DataFrame) -> DataFrame:
    """(edit_id, upto): the last position of each edit. ops: edit_id and ord."""
    return ops.where("edit_id IS NOT NULL").groupBy("edit_id").agg(F.max("ord").alias("upto"))


def resolve_endpoints(state: State, relations: DataFrame, edits: DataFrame, with_values: bool = True) -> DataFrame:
    """What the ends of relations stand for: two rows a relation, (space, id, end, target, at_space, status, entity,
    property, language, value).

    An end is looked up in its space pin's space, else in the relation's. With a version pin, edits (edit_id, upto) says
    up to where the log counts, the pinned edit included; of an unknown edit the status is UNKNOWN_VERSION. A value ref's
    binding to a slot is the current one of that space; the slot's own space says where the value is read, and the
    version pin as of when. Status is that of the entity (the slot's, for a value ref); a value shows only while it is
    ACTIVE, and is null without with_values."""
    space = relations.schema["space"].dataType

    def end(name: str):
        pin = lambda what: F.col(f"{name}_{what}")
        return F.struct(F.lit(name).alias("end"), F.col(name).alias("target"), F.coalesce(F.col(f"{name}_is_value_ref"), F.lit(False)).alias("is_ref"), F.coalesce(pin("space").cast(space), F.col("space")).alias("at_space"), pin("version").alias("version"))

    ends = relations.select(*KEY, F.explode(F.array(end("from"), end("to"))).alias("e")).select(*KEY, "e.*")
    ends = ends.join(edits.select(F.col("edit_id").alias("version"), "upto"), "version", "left")
    refs = state.value_refs.select(F.col("space").alias("at_space"), F.col("ref_id").alias("target"), F.lit(True).alias("is_ref"), "entity", "property", "language", "slot_space")
    ends = ends.join(refs, ["at_space", "target", "is_ref"], "left")
    where = {"of_space": F.when(F.col("is_ref"), F.col("slot_space")).otherwise(F.col("at_space")), "of_id": F.when(F.col("is_ref"), F.col("entity")).otherwise(F.col("target"))}
    ends = written(ends.withColumns(where))
    row, at = [*KEY, "end"], {"s": F.col("of_space"), "i": F.col("of_id")}
    ends = ends.withColumns(at)
    none = lambda df, name: F.lit(None).cast(df.schema[name].dataType).alias(name)
    running = lambda *by: Window.partitionBy(*by).orderBy(F.col("upto").isNotNull().desc(), "upto", "ask", "seq", "idx").rowsBetween(Window.unboundedPreceding, 0)
    # Each different question is put among the ops of its object, in the order of the log, and takes what the ops before it say.
    known = state.objects.select(F.col("space").alias("s"), F.col("id").alias("i"), F.col("created").alias("upto"), F.lit(True).alias("there"), none(state.accepted, "op_type"))
    switches = state.accepted.where(F.col("op_type").isin(M.DELETE_ENTITY, M.RESTORE_ENTITY, M.DELETE_RELATION, M.RESTORE_RELATION)).select(F.col("space").alias("s"), F.col("id").alias("i"), F.col("ord").alias("upto"), F.lit(None).cast("boolean").alias("there"), "op_type")
    what = known.unionByName(switches).withColumn("ask", F.lit(0))
    asked = ends.select("s", "i", "upto").distinct().select("s", "i", "upto", F.lit(None).cast("boolean").alias("there"), none(state.accepted, "op_type"), F.lit(1).alias("ask"))
    lived = what.unionByName(asked).withColumns({"seq": F.lit(0), "idx": F.lit(0)})
    lived = lived.withColumns({"there": F.max("there").over(running("s", "i")), "last": F.last("op_type", ignorenulls=True).over(running("s", "i"))}).where("ask = 1").select("s", "i", "upto", "there", "last")
    joined = lambda a, b, cols: a.alias("a").join(b.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cols], "left").select("a.*", *(f"b.{c}" for c in b.columns if c not in cols))
    out = joined(ends, lived, ["s", "i", "upto"])
    if with_values:
        slot = ["s", "i", "property", "language"]
        events = slot_events(state.accepted).select(F.col("space").alias("s"), F.col("id").alias("i"), "property", "language", F.col("ord").alias("upto"), "seq", "idx", "mode", F.col("value").alias("v"), F.lit(0).alias("ask"))
        asked = ends.where("is_ref").select(*slot, "upto").distinct().select(*slot, "upto", F.lit(0).alias("seq"), F.lit(0).alias("idx"), none(events, "mode"), none(events, "v"), F.lit(1).alias("ask"))
        place, clears = F.struct("upto", "seq", "idx"), F.coalesce(F.col("mode") == M.UNSET_ALL, F.lit(False))
        said = events.unionByName(asked)
        said = said.withColumn("cleared", F.last(F.when(clears, place), ignorenulls=True).over(running("s", "i", "property")))
        said = said.withColumn("own", F.last(F.when(~clears & (F.col("ask") == 0), F.struct(place.alias("place"), "seq", "v")), ignorenulls=True).over(running(*slot))).where("ask = 1")
        shown = F.when((F.col("own.seq") == 1) & (F.col("cleared").isNull() | (F.col("own.place") > F.col("cleared"))), F.struct(F.col("own.v").alias("v")))
        out = joined(out, said.select(*slot, "upto", shown.alias("x")), [*slot, "upto"])
    else:
        out = out.withColumn("x", F.struct(F.lit(None).cast(slot_events(state.accepted).schema["value"].dataType).alias("v")))
    status = (
        F.when(F.col("version").isNotNull() & F.col("upto").isNull(), "UNKNOWN_VERSION").when(F.col("there").isNull(), "NOT_FOUND")
        .when(F.col("last").isin(M.DELETE_ENTITY, M.DELETE_RELATION), "DELETED").otherwise("ACTIVE")
    )
    out = out.withColumn("status", status).withColumn("value", F.when(F.col("status") == "ACTIVE", F.col("x.v")))
    return out.select(*row, "target", "is_ref", "at_space", "version", "status", "entity", "property", "language", "value")


def as_of(ops: DataFrame, last) -> DataFrame:
    """The log up to and including a position."""
    return ops.where(F.col("ord") <= last)


@dataclass
class State:
    """All resolved views of a log; each is computed when it is first asked for."""

    ops: DataFrame

    @cached_property
    def claims(self) -> DataFrame:
        return claims(self.ops)

    @cached_property
    def owners(self) -> DataFrame:
        return written(owners(self.ops))

    @cached_property
    def accepted(self) -> DataFrame:
        return written(accepted(self.ops, self.owners))

    @cached_property
    def objects(self) -> DataFrame:
        return status(self.owners, self.accepted)

    @property
    def entities(self) -> DataFrame:
        return self.objects.where(F.col("kind") == ENTITY).drop("kind")

    @property
    def values_all(self) -> DataFrame:
        return values(slot_events(self.accepted))

    @property
    def values(self) -> DataFrame:
        """Values of active entities; those of deleted ones are hidden, not lost."""
        return self.values_all.join(self.entities.where("status = 'ACTIVE'").select(*KEY), KEY, "left_semi")

    @property
    def relations_all(self) -> DataFrame:
        return relations(self.accepted).join(self.objects.where(F.col("kind") == RELATION).select(*KEY, "status"), KEY)

    @property
    def relations(self) -> DataFrame:
        return self.relations_all.where("status = 'ACTIVE'").drop("status")

    @property
    def value_refs(self) -> DataFrame:
        return value_refs(self.accepted)
