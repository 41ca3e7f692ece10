"""Edits as DataFrames: files of the interchange format in and out, and JSON of places as ops."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from strandlog import model as M
from strandlog.plans.shared import small_batches
from strandlog.sources import wire

#: Rows that a task gives out at once, and bytes of edits.
BLOCK, BLOCK_BYTES = 1024, 2 << 20


def _schema(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches, one at a time in Python."""
    for b in batches:
        for cells in zip(*b.columns, strict=True):
            yield tuple(c.as_py() for c in cells)


def decode_ops(blobs: DataFrame, content: str = "content", key: str = "path", permissive: bool = False) -> DataFrame:
    """One row per op of the edits in a binary column: key, edit_id and the op's columns. permissive: edits that can't be
    read give one row with `error` instead of failing the query."""
    schema = _schema(f"path string, edit_id binary, {M.OP}, error string")
    arrow = to_arrow_schema(schema)

    def ops(path: str, data: bytes) -> Iterator[dict]:
        try:
            edit = wire.decode(data)
        except wire.WireError as e:
            if not permissive:
                raise
            return iter([{"path": path, "error": e.code}])
        return ({"path": path, "edit_id": edit["edit_id"], **op} for op in edit["ops"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for path, data in _cells(batches) for row in ops(path, data))
        while block := list(islice(rows, BLOCK)):
            yield pa.RecordBatch.from_pylist(block, arrow)

    small_batches(blobs.sparkSession)
    return blobs.select(F.col(key).alias("path"), F.col(content).alias("content")).mapInArrow(run, schema)


def decode_headers(blobs: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    """One row per edit, without reading its ops."""
    schema = _schema(f"path string, {M.EDIT}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ({"path": path, **wire.decode(data, with_ops=False)} for path, data in _cells(batches))
        while block := list(islice(rows, BLOCK)):
            yield pa.RecordBatch.from_pylist(block, to_arrow_schema(schema))

    small_batches(blobs.sparkSession)
    return blobs.select(F.col(key).alias("path"), F.col(content).alias("content")).mapInArrow(run, schema)


def is_compressed(content):
    """Column: whether an edit is in its compressed form."""
    return F.substring(content, 1, len(wire.MAGIC_ZSTD)) == F.lit(wire.MAGIC_ZSTD)


def encode_edits(edits: DataFrame, canonical: bool = True, compress: bool | str = False, threshold: int = 256, level: int = 3) -> DataFrame:
    """edits: edit columns and `ops`, an array of op structs. Gives (edit_id, content); an edit is one row, one blob.
    compress: False, True, or "auto" for edits of `threshold` bytes and more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = {"canonical": canonical} | ({"level": level} if compress is True else {"threshold": threshold} if compress else {})
        pack = wire.encode_zstd if compress is True else wire.encode_auto if compress else wire.encode
        ids, blobs, size = [], [], 0
        for b in batches:
            for i in range(b.num_rows):  # one edit at a time: its ops take up to a hundred times their bytes as Python objects
                (edit,) = b.slice(i, 1).to_pylist()
                edit["ops"].sort(key=lambda o: o["op_index"])
                ids.append(edit["edit_id"])
                blobs.append(pack(edit, **how))
                size += len(blobs[-1])
                if size >= BLOCK_BYTES or len(ids) >= BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(blobs, pa.binary())], names=["edit_id", "content"])
                    ids, blobs, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(blobs, pa.binary())], names=["edit_id", "content"])

    small_batches(edits.sparkSession)
    return edits.mapInArrow(run, "edit_id binary, content binary")


def gather(ops: DataFrame, headers: DataFrame) -> DataFrame:
    """Ops and edit rows put together: one row per edit with its ops in order. An edit is at most a million ops by the format."""
    cols = [f.name for f in _schema(M.OP).fields]
    lists = ops.groupBy("edit_id").agg(F.collect_list(F.struct(*cols)).alias("ops"))
    return headers.join(lists, "edit_id")


def read_edits(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files of the format, by Spark's own reader, so any store that it knows will do."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def content_hash(content):
    """Hash of an uncompressed canonical edit."""
    return F.sha2(content, 256)


class EditSource(DataSource):
    """format("strandlog_edits"): reads ops from edit files in a folder, and writes rows (edit_id, content) as files.

    Options: path, permissive. Reading is per file; the store is any that Arrow knows by its URI."""

    @classmethod
    def name(cls) -> str:
        return "strandlog_edits"

    def schema(self) -> str:
        return f"path string, edit_id binary, {M.OP}, error string"

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("permissive", "false") == "true", self.schema())

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class _Reader(DataSourceReader):
    def __init__(self, path: str, permissive: bool, ddl: str):
        self.path, self.permissive, self.ddl = path, permissive, ddl

    def partitions(self):
        from pyarrow import fs

        store, path = _store(self.path)
        return [InputPartition(f.path) for f in store.get_file_info(fs.FileSelector(path)) if f.is_file and f.path.endswith(".edit")]

    def read(self, partition):
        store, _ = _store(self.path)
        with store.open_input_file(partition.value) as f:
            data = f.read()
        names = ["op_index", "op_type", "id", "set", "unset", "relation", "unset_fields", "value_ref", "context"]
        try:
            edit = wire.decode(data)
        except wire.WireError as e:
            if not self.permissive:
                raise
            yield (partition.value, None, *[None] * len(names), e.code)
            return
        for op in edit["ops"]:
            yield (partition.value, edit["edit_id"], *(_plain(op.get(n), n) for n in names), None)


_VALUE_FIELDS = ["data_type", "bool", "i64", "f64", "dec", "text", "bytes", "date", "time", "datetime", "schedule", "point", "rect", "embedding", "language", "unit"]
_NESTED = {
    "dec": ["exponent", "mantissa_i64", "mantissa_big"], "date": ["days", "offset_min"], "time": ["time_us", "offset_min"], "datetime": ["epoch_us", "offset_min"], "point": ["lat", "lon", "alt"],
    "rect": ["min_lat", "min_lon", "max_lat", "max_lon"], "embedding": ["sub_type", "dims", "data"], "unset": ["property", "mode", "language"], "value_ref": ["entity", "property", "language", "space"],
    "relation": ["type", "from", "from_is_value_ref", "to", "to_is_value_ref", "entity", "position", *M.PINS], "value": _VALUE_FIELDS, "set": ["property", "value"], "context": ["root_id", "edges"], "edges": ["type_id", "to_entity_id"],
}


def _plain(x, name: str):
    """Dicts as tuples in the order of the schema."""
    if isinstance(x, list):
        return [_plain(y, name) for y in x]
    if isinstance(x, dict):
        return tuple(_plain(x.get(n), n) for n in _NESTED[name])
    return x


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        for b in iterator:
            for edit_id, content in zip(b.column("edit_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                temp = f"{path}/.{uuid.uuid4().hex}"
                with store.open_output_stream(temp) as f:
                    f.write(content)
                store.move(temp, f"{path}/{edit_id.hex()}.edit")
        return WriterCommitMessage()


def places_to_ops(places: DataFrame, edit_id: bytes) -> DataFrame:
    """JSON places (city, state and country columns) as ops of one edit: each country, state and city once, with its
    name, and the relations of a city to both. Deduplicated by key before anything is built."""
    from strandlog.functions.ids import NAME, TYPES, derived_uuid, unique_relation_id

    def ident(kind, c):
        return derived_uuid(F.concat(F.lit(f"{kind}:"), c.cast("string")))

    name = F.unhex(F.lit(NAME))
    entities = [places.select(ident(kind, F.col(k)).alias("id"), F.col(n).alias("text")).where("text IS NOT NULL").dropDuplicates(["id"]).withColumn("kind", F.lit(kind)) for kind, k, n in (("country", "country_id", "country_name"), ("state", "state_id", "state_name"), ("city", "id", "name"))]
    made = entities[0].unionByName(entities[1]).unionByName(entities[2])
    schema = _schema(M.OP)
    blank = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields}
    value_type = schema["set"].dataType.elementType["value"].dataType
    value = F.struct(*((F.col("text") if f.name == "text" else F.lit(M.TEXT) if f.name == "data_type" else F.lit(None)).cast(f.dataType).alias(f.name) for f in value_type.fields))
    creates = made.select(*({**blank, "op_type": F.lit(M.CREATE_ENTITY).cast("tinyint"), "id": F.col("id"), "set": F.array(F.struct(name.alias("property"), value.alias("value")))}[f.name].alias(f.name) for f in schema.fields))
    city = ident("city", F.col("id"))
    ends = F.explode(F.array(*(F.struct(t.alias("type"), to.alias("to")) for t, to in ((F.unhex(F.lit(TYPES)), derived_uuid(F.lit("type:city"))), (derived_uuid(F.lit("relation:in-state")), ident("state", F.col("state_id"))), (derived_uuid(F.lit("relation:in-country")), ident("country", F.col("country_id")))))))
    links = places.dropDuplicates(["id"]).select(city.alias("from"), ends.alias("e")).where("e.to IS NOT NULL")
    rel = schema["relation"].dataType
    given = {"type": F.col("e.type"), "from": F.col("from"), "to": F.col("e.to"), "from_is_value_ref": F.lit(False), "to_is_value_ref": F.lit(False)}
    relation = F.struct(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rel.fields))
    rels = links.select(*({**blank, "op_type": F.lit(M.CREATE_RELATION).cast("tinyint"), "id": unique_relation_id(F.col("from"), F.col("e.to"), F.col("e.type")), "relation": relation}[f.name].alias(f.name) for f in schema.fields))
    return creates.unionByName(rels).withColumn("edit_id", F.lit(edit_id))


def dump(ops: DataFrame, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """Counts by op type, and the first ops."""
    return ops.groupBy("op_type").count().orderBy("op_type"), ops.orderBy("path", "op_index").limit(n)
