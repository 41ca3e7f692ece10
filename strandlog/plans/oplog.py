"""A deterministic log of ops from the driver tables, as columns only; ids are derived from names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog import model as M
from strandlog.functions.ids import derived_uuid, language_id

VALUE = "struct<data_type: tinyint, text: string, i64: bigint, language: binary, unit: binary>"
SET = f"array<struct<property: binary, value: {VALUE}>>"
UNSET = "array<struct<property: binary, mode: tinyint, language: binary>>"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(*parts):
    """The id of a name put together from columns and literal strings."""
    return derived_uuid(F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)))


def order(block, op_index=None, tx=0, log=0):
    return F.struct(block.cast("long").alias("block"), F.lit(tx).alias("tx"), F.lit(log).alias("log"), (F.lit(0) if op_index is None else op_index.cast("int")).alias("op_index"))


def put(prop, text=None, i64=None, language=None, unit=None):
    none = F.lit(None)
    value = F.struct(
        F.lit(M.INT64 if text is None else M.TEXT).cast("tinyint").alias("data_type"), (none if text is None else text).cast("string").alias("text"),
        (none if i64 is None else i64).cast("long").alias("i64"), (none if language is None else language).cast("binary").alias("language"), (none if unit is None else unit).cast("binary").alias("unit"),
    )
    return F.array(F.struct(prop.cast("binary").alias("property"), value.alias("value")))


def clear(prop, mode: int, language=None):
    return F.array(F.struct(prop.cast("binary").alias("property"), F.lit(mode).cast("tinyint").alias("mode"), (F.lit(None) if language is None else language).cast("binary").alias("language")))


def entity_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as ops on users: sign-ups create, views and purchases set, clicks unset or restore, half the errors delete."""
    e = read(spark, sf_dir, "events")
    n, kind = F.col("event_id"), F.col("event_type")
    click = lambda k: (kind == "click") & (n % 4 == k)
    name, title, score = (named(f"property:{x}") for x in ("name", "title", "score"))
    tag = language_id(F.when(n % 3 == 0, "en").when(n % 3 == 1, "de").otherwise("fr"))
    text = lambda s: F.concat(F.lit(s), n.cast("string"))
    points = F.round(F.col("value") * 100).cast("long")
    op_type = F.when(kind == "signup", 1).when(click(0), 4).when((kind == "error") & (n % 2 == 0), 3).otherwise(2)
    sets = (
        F.when(kind == "signup", F.concat(put(name, text=text("user ")), put(score, i64=n)))
        .when(kind == "view", put(title, text=text("title "), language=tag))
        .when(kind == "purchase", put(score, i64=points, unit=named("unit:cent")))
        .when(click(3), put(score, i64=n)).when((kind == "error") & (n % 2 == 1), put(name, text=text("renamed ")))
    )
    unsets = F.when(click(1), clear(title, M.UNSET_ALL)).when(click(2), clear(title, M.UNSET_LANGUAGE, language_id(F.lit("de")))).when(click(3), F.concat(clear(score, M.UNSET_ENGLISH), clear(name, M.UNSET_ENGLISH)))
    space = F.when(n % 5 == 0, "side").otherwise("main")
    return e.select(space.alias("space"), order(n).alias("ord"), op_type.cast("tinyint").alias("op_type"), named("user:", F.col("user_id")).alias("id"), sets.cast(SET).alias("set"), unsets.cast(UNSET).alias("unset"), F.lit(None).cast(M.RELATION).alias("relation"), F.lit(0).alias("unset_fields"), F.lit(None).cast("struct<entity: binary, property: binary, language: binary, space: binary>").alias("value_ref"))


def _frame(df: DataFrame, op_type: int, block, op_index, ident, relation=None, unset_fields=None, value_ref=None, tx=0, log=0) -> DataFrame:
    none = F.lit(None)
    return df.select(
        F.lit("main").alias("space"), order(block, op_index, tx, log).alias("ord"), F.lit(op_type).cast("tinyint").alias("op_type"), ident.alias("id"), none.cast(SET).alias("set"), none.cast(UNSET).alias("unset"),
        (none if relation is None else relation).cast(M.RELATION).alias("relation"), (F.lit(0) if unset_fields is None else unset_fields).alias("unset_fields"),
        (none if value_ref is None else value_ref).cast("struct<entity: binary, property: binary, language: binary, space: binary>").alias("value_ref"),
    )


def _relation(kind=None, source=None, target=None, position=None, to_version=None, to_ref=None, entity=None, from_space=None, from_version=None, to_space=None):
    none = lambda x, t="binary": (F.lit(None) if x is None else x).cast(t)
    return F.struct(
        none(kind).alias("type"), none(source).alias("from"), F.lit(False).alias("from_is_value_ref"), none(target).alias("to"), (F.lit(False) if to_ref is None else to_ref).alias("to_is_value_ref"), none(entity).alias("entity"), none(position, "string").alias("position"),
        none(from_space).alias("from_space"), none(from_version).alias("from_version"), none(to_space).alias("to_space"), none(to_version).alias("to_version"),
    )


def relation_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as ops on relations customer -> status: several orders share an id, some move, some delete or restore it."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    ident = named("order:", F.col("o_custkey"), "-", k % 3)
    create = _frame(o, M.CREATE_RELATION, k, F.lit(0), ident, _relation(named("relation:", F.col("o_orderpriority")), named("customer:", F.col("o_custkey")), named("status:", F.col("o_orderstatus")), F.concat(F.lit("a"), (k % 10).cast("string")), F.when(k % 4 == 0, named("edit:", k))))
    move = _frame(o.where(k % 5 == 0), M.UPDATE_RELATION, k, F.lit(1), ident, _relation(position=F.when(k % 10 == 0, F.concat(F.lit("b"), (k % 7).cast("string")))), F.when(k % 10 == 5, 16).otherwise(8))
    drop = _frame(o.where(k % 7 == 0), M.DELETE_RELATION, k, F.lit(2), ident)
    back = _frame(o.where(k % 14 == 0), M.RESTORE_RELATION, k, F.lit(3), ident)
    return create.unionByName(move).unionByName(drop).unionByName(back)


def value_ref_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as value refs. Lines can share an order and a number; then the one that stands first in the files is the
    latest, as DuckDB's arg_max takes it, so that no two ops have the same position."""
    x = read(spark, sf_dir, "lineitem")
    files = sorted(re.sub(r"^(\w+):/+", r"\1:/", f) for f in x.inputFiles())  # file:///a here is file:/a in _metadata
    x = x.select("*", F.regexp_replace("_metadata.file_path", r"^(\w+):/+", "$1:/").alias("file"), F.col("_metadata.row_index").alias("row"))
    slot = F.struct(named("supplier:", F.col("l_suppkey")).alias("entity"), named("property:", F.col("l_returnflag")).alias("property"), F.when(F.col("l_linestatus") == "O", language_id(F.lit("de"))).alias("language"), F.lit(None).cast("binary").alias("space"))
    file = -F.array_position(F.lit(files), F.col("file")).cast("int") if len(files) > 1 else 0
    return _frame(x, M.CREATE_VALUE_REF, F.col("l_orderkey"), -F.col("row"), named("ref:", F.col("l_partkey") % 50), value_ref=slot, tx=F.col("l_linenumber").cast("int"), log=file)


def full_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_ops(spark, sf_dir).unionByName(relation_ops(spark, sf_dir)).unionByName(value_ref_ops(spark, sf_dir))


def pinned_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The users' log, value refs to their slots from views, and relations from orders whose ends have space and version
    pins; and the edits (edit_id, ord): each event is one, of its op and its value ref."""
    e, o = read(spark, sf_dir, "events"), read(spark, sf_dir, "orders")
    n, k = F.col("event_id"), F.col("o_orderkey")
    users = entity_ops(spark, sf_dir)
    name, title, score = (named(f"property:{x}") for x in ("name", "title", "score"))
    slot = F.struct(
        named("user:", F.col("user_id")).alias("entity"), F.when(n % 3 == 0, name).when(n % 3 == 1, score).otherwise(title).alias("property"),
        F.when((n % 3 == 2) & (n % 2 == 0), language_id(F.lit("de"))).alias("language"), F.when(n % 4 == 0, F.lit("side").cast("binary")).alias("space"),
    )
    refs = _frame(e.where("event_type = 'view'"), M.CREATE_VALUE_REF, n, F.lit(0), named("vref:", n % 60), value_ref=slot)
    refs = refs.withColumns({"space": F.when(F.col("ord.block") % 5 == 0, "side").otherwise("main"), "ord": order(F.col("ord.block"), tx=1, log=2)})
    ends = _relation(
        named("relation:pins"), named("user:", k % 300), F.when(k % 2 == 1, named("vref:", k % 70)).otherwise(named("user:", (k * 7) % 300)), to_version=F.when(k % 7 < 3, named("edit:", k % 977)), to_ref=k % 2 == 1, entity=F.when(k % 11 == 0, named("statement:", k)),
        from_space=F.when(k % 3 == 0, F.lit("side")), from_version=F.when(k % 35 == 0, named("edit:", k + 100_000_000)).when(k % 5 == 0, named("edit:", k % 1000)), to_space=F.when(k % 6 < 2, F.lit("main")),
    )
    pins = _frame(o, M.CREATE_RELATION, k + 1_000_000_000, F.lit(0), named("pin:", k), ends).withColumn("space", F.when(F.col("ord.block") % 4 == 0, "side").otherwise("main"))
    edits = users.unionByName(refs).select(named("edit:", F.col("ord.block")).alias("edit_id"), "ord")
    return users.unionByName(refs).unionByName(pins), edits


def value(**given):
    """A value of the full schema; what isn't given is null."""
    return F.struct(*((given[f.name] if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in _schema(M.VALUE).fields))


def edit_ops(df: DataFrame, edit_id, op_index, op_type, ident, **given) -> DataFrame:
    """Rows as ops of edits, of the full schema: edit_id and the columns of an op."""
    cols = {"op_index": op_index, "op_type": op_type if not isinstance(op_type, int) else F.lit(op_type), "id": ident, **given}
    return df.select(edit_id.alias("edit_id"), *((cols[f.name] if f.name in cols else F.lit(None)).cast(f.dataType).alias(f.name) for f in _schema(M.OP).fields))


def _schema(ddl: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(ddl)


def context_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as updates below a customer: two of three have a context, of one or two edges or of the root alone."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    edge = lambda kind, to: F.struct(kind.alias("type_id"), to.alias("to_entity_id"))
    one = edge(named("relation:", F.col("o_orderpriority")), named("order:", k))
    edges = F.when(k % 4 == 0, F.array().cast("array<struct<type_id: binary, to_entity_id: binary>>")).when(k % 4 == 1, F.array(one)).otherwise(F.array(one, edge(named("relation:clerk"), named("clerk:", k % 10))))
    context = F.when(k % 3 != 0, F.struct(named("customer:", F.col("o_custkey")).alias("root_id"), edges.alias("edges")))
    ops = edit_ops(o, named("edit:", F.floor(k / 1000)), k, M.UPDATE_ENTITY, named("order:", k), context=context)
    return ops.withColumn("space", F.when(F.col("op_index") % 2 == 0, "main").otherwise("side"))
