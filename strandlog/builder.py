"""Builders of edits: chained calls that collect ops as the wire and the DataFrame schema take them."""

from __future__ import annotations

import os
import struct
import time

from strandlog import model as M
from strandlog.functions.ids import uuid8
from strandlog.sources import wire


def random_id() -> bytes:
    raw = bytearray(os.urandom(16))
    raw[6], raw[8] = raw[6] & 0x0F | 0x40, raw[8] & 0x3F | 0x80
    return bytes(raw)


def relation_id(source: bytes, target: bytes, kind: bytes) -> bytes:
    return uuid8(source + target + kind)


def embedding(numbers, sub_type: int = 0) -> dict:
    """f32 (0), i8 (1) or bits (2) from numbers."""
    n = list(numbers)
    data = struct.pack(f"<{len(n)}f", *n) if sub_type == 0 else struct.pack(f"{len(n)}b", *n) if sub_type == 1 else bytes(sum(bool(b) << i for i, b in enumerate(n[at : at + 8])) for at in range(0, len(n), 8))
    return {"sub_type": sub_type, "dims": len(n), "data": data}


def decimal(exponent: int, mantissa: int) -> dict:
    """Normalised: no trailing zeros; beyond 64 bits as bytes."""
    while mantissa and mantissa % 10 == 0:
        mantissa, exponent = mantissa // 10, exponent + 1
    small = -(1 << 63) <= mantissa < 1 << 63
    return {"exponent": exponent if mantissa else 0, "mantissa_i64": mantissa if small else None, "mantissa_big": None if small else wire.big(mantissa)}


class Values:
    """Typed setters; each returns the builder. Latitude comes before longitude."""

    def __init__(self):
        self.values: list[dict] = []

    def value(self, prop: bytes, data_type: int, payload, language: bytes | None = None, unit: bytes | None = None):
        v = {"data_type": data_type, wire.VALUES[data_type][0]: payload}
        if data_type == M.TEXT:
            v["language"] = language
        if data_type in (M.INT64, M.FLOAT64, M.DECIMAL):
            v["unit"] = unit
        wire.payload(v)  # refuses what the format refuses
        self.values.append({"property": prop, "value": v})
        return self

    def text(self, prop, s: str, language=None):
        return self.value(prop, M.TEXT, s, language=language)

    def int64(self, prop, n: int, unit=None):
        return self.value(prop, M.INT64, n, unit=unit)

    def float64(self, prop, x: float, unit=None):
        return self.value(prop, M.FLOAT64, x, unit=unit)

    def decimal(self, prop, exponent: int, mantissa: int, unit=None):
        return self.value(prop, M.DECIMAL, decimal(exponent, mantissa), unit=unit)

    def bool(self, prop, b: bool):
        return self.value(prop, M.BOOL, b)

    def bytes(self, prop, b: bytes):
        return self.value(prop, M.BYTES, b)

    def date(self, prop, days: int, offset_min: int = 0):
        return self.value(prop, M.DATE, {"days": days, "offset_min": offset_min})

    def time(self, prop, time_us: int, offset_min: int = 0):
        return self.value(prop, M.TIME, {"time_us": time_us, "offset_min": offset_min})

    def datetime(self, prop, epoch_us: int, offset_min: int = 0):
        return self.value(prop, M.DATETIME, {"epoch_us": epoch_us, "offset_min": offset_min})

    def schedule(self, prop, s: str):
        return self.value(prop, M.SCHEDULE, s)

    def point(self, prop, lat: float, lon: float, alt: float | None = None):
        return self.value(prop, M.POINT, {"lat": lat, "lon": lon, "alt": alt})

    def rect(self, prop, min_lat: float, min_lon: float, max_lat: float, max_lon: float):
        return self.value(prop, M.RECT, dict(min_lat=min_lat, min_lon=min_lon, max_lat=max_lat, max_lon=max_lon))

    def embedding(self, prop, numbers, sub_type: int = 0):
        return self.value(prop, M.EMBEDDING, embedding(numbers, sub_type))


class Update(Values):
    """Setters and unsets of an entity."""

    def __init__(self):
        super().__init__()
        self.unsets: list[dict] = []

    def unset(self, prop, mode: int = M.UNSET_ALL, language=None):
        self.unsets.append({"property": prop, "mode": mode, "language": language})
        return self

    def unset_all(self, prop):
        return self.unset(prop)

    def unset_english(self, prop):
        return self.unset(prop, M.UNSET_ENGLISH)

    def unset_language(self, prop, language: bytes):
        return self.unset(prop, M.UNSET_LANGUAGE, language)


class EditBuilder:
    def __init__(self, edit_id: bytes | None = None, name: str = ""):
        self.edit = {"edit_id": edit_id or random_id(), "name": name, "authors": [], "created_at": 0, "ops": []}

    def name(self, name: str):
        self.edit["name"] = name
        return self

    def author(self, *ids: bytes):
        self.edit["authors"] += ids
        return self

    def created_at(self, when: int):
        self.edit["created_at"] = when
        return self

    def created_now(self):
        return self.created_at(int(time.time()))

    def op(self, op_type: int, ident: bytes, context: dict | None = None, **rest):
        self.edit["ops"].append({"op_index": len(self.edit["ops"]), "op_type": op_type, "id": ident, **rest, **({} if op_type == M.CREATE_VALUE_REF else {"context": context})})
        return self

    def create_entity(self, ident: bytes, values: Values | None = None, context=None):
        return self.op(M.CREATE_ENTITY, ident, context, set=values.values if values else [])

    def update_entity(self, ident: bytes, update: Update, context=None):
        return self.op(M.UPDATE_ENTITY, ident, context, set=update.values, unset=update.unsets)

    def delete_entity(self, ident: bytes, context=None):
        return self.op(M.DELETE_ENTITY, ident, context)

    def restore_entity(self, ident: bytes, context=None):
        return self.op(M.RESTORE_ENTITY, ident, context)

    def create_relation(self, ident: bytes | None, kind: bytes, source: bytes, target: bytes, *, entity=None, position=None, from_is_value_ref=False, to_is_value_ref=False, context=None, **pins):
        """Without an id it is derived from both ends and the type."""
        if set(pins) - set(M.PINS):
            raise ValueError(f"no pins {set(pins) - set(M.PINS)}")
        r = {"type": kind, "from": source, "to": target, "from_is_value_ref": from_is_value_ref, "to_is_value_ref": to_is_value_ref, "entity": entity, "position": position, **{p: pins.get(p) for p in M.PINS}}
        return self.op(M.CREATE_RELATION, ident or relation_id(source, target, kind), context, relation=r)

    def update_relation(self, ident: bytes, unset=(), context=None, **fields):
        """fields: pins or position to set; unset: names of those to clear."""
        if (set(fields) | set(unset)) - set(M.FIELDS):
            raise ValueError("only pins and the position change")
        return self.op(M.UPDATE_RELATION, ident, context, relation={f: fields.get(f) for f in M.FIELDS}, unset_fields=sum(1 << M.FIELDS.index(f) for f in unset))

    def delete_relation(self, ident: bytes, context=None):
        return self.op(M.DELETE_RELATION, ident, context)

    def restore_relation(self, ident: bytes, context=None):
        return self.op(M.RESTORE_RELATION, ident, context)

    def create_value_ref(self, ident: bytes, entity: bytes, prop: bytes, language=None, space=None):
        return self.op(M.CREATE_VALUE_REF, ident, value_ref={"entity": entity, "property": prop, "language": language, "space": space})

    def op_count(self) -> int:
        return len(self.edit["ops"])

    def build(self) -> dict:
        return self.edit

    def frame(self, spark):
        """The edit as one row: edit columns and the array of ops."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        ddl = f"{M.EDIT}, ops array<struct<{', '.join(_colon(p) for p in _split(M.OP))}>>"
        schema = to_arrow_schema(_parse_datatype_string(ddl))
        return spark.createDataFrame(pa.Table.from_pylist([{**self.edit, "n_ops": self.op_count()}], schema))


def _split(ddl: str) -> list[str]:
    """Top-level fields of a DDL string."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:i].strip())
            start = i + 1
    return [*out, ddl[start:].strip()]


def _colon(field: str) -> str:
    name, kind = field.split(" ", 1)
    return f"`{name}`: {kind}"
