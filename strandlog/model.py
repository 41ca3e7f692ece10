"""Data model: op and data type numbers, and the schemas of the log."""

from __future__ import annotations

# Fixed values of the interchange format.
DATA_TYPES = {1: "bool", 2: "int64", 3: "float64", 4: "decimal", 5: "text", 6: "bytes", 7: "date", 8: "time", 9: "datetime", 10: "schedule", 11: "point", 12: "rect", 13: "embedding"}
BOOL, INT64, FLOAT64, DECIMAL, TEXT, BYTES, DATE, TIME, DATETIME, SCHEDULE, POINT, RECT, EMBEDDING = range(1, 14)
CREATE_ENTITY, UPDATE_ENTITY, DELETE_ENTITY, RESTORE_ENTITY, CREATE_RELATION, UPDATE_RELATION, DELETE_RELATION, RESTORE_RELATION, CREATE_VALUE_REF = range(1, 10)
UNSET_ALL, UNSET_ENGLISH, UNSET_LANGUAGE = 0, 1, 2
PINS = ["from_space", "from_version", "to_space", "to_version"]
#: Bits of the mutable relation fields in `unset_fields`.
FIELDS = [*PINS, "position"]

VALUE = (
    "struct<data_type: tinyint, bool: boolean, i64: bigint, f64: double, dec: struct<exponent: int, mantissa_i64: bigint, mantissa_big: binary>, text: string, bytes: binary, "
    "date: struct<days: int, offset_min: smallint>, time: struct<time_us: bigint, offset_min: smallint>, datetime: struct<epoch_us: bigint, offset_min: smallint>, schedule: string, "
    "point: struct<lat: double, lon: double, alt: double>, rect: struct<min_lat: double, min_lon: double, max_lat: double, max_lon: double>, "
    "embedding: struct<sub_type: tinyint, dims: int, data: binary>, language: binary, unit: binary>"
)
ORD = "struct<block: bigint, tx: int, log: int, op_index: int>"
RELATION = "struct<type: binary, from: binary, from_is_value_ref: boolean, to: binary, to_is_value_ref: boolean, entity: binary, position: string, from_space: binary, from_version: binary, to_space: binary, to_version: binary>"
OP = (
    f"op_index int, op_type tinyint, id binary, set array<struct<property: binary, value: {VALUE}>>, unset array<struct<property: binary, mode: tinyint, language: binary>>, relation {RELATION}, unset_fields int, "
    "value_ref struct<entity: binary, property: binary, language: binary, space: binary>, context struct<root_id: binary, edges: array<struct<type_id: binary, to_entity_id: binary>>>"
)
EDIT = "edit_id binary, name string, authors array<binary>, created_at bigint, n_ops int"
