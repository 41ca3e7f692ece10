"""IDs as column expressions: 16 raw bytes, compared as unsigned bytes, hexadecimal only at the edges."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

# Prefixes and IDs that the format prescribes.
RELATION_ENTITY_PREFIX = "grc20:relation-entity:"
GENESIS_PREFIX = "grc20:genesis:"
LANGUAGE_PREFIX = "grc20:genesis:language:"
DATA_TYPE_PREFIX = "grc20:genesis:datatype:"
NAME = "a126ca530c8e48d5b88882c734c38935"
DESCRIPTION = "9b1f76ff9711404c861e59dc3fa7d037"
COVER = "34f535072e6b42c5a84443981a77cfa2"
IMAGE = "f3f790c4c74e4d23a0a91e8ef84e30d9"
TYPES = "8f151ba4de204e3c9cb499ddf96f48f1"
DATA_TYPE = "84ce4adf1e9c4f52b9bdd6eeaa3004d8"
NIL = "00" * 16


def uuid8(data: bytes) -> bytes:
    """The derived ID of some bytes, for use outside of columns."""
    h = bytearray(hashlib.sha256(data).digest()[:16])
    h[6], h[8] = h[6] & 0x0F | 0x80, h[8] & 0x3F | 0x80
    return bytes(h)


def _bytes(c):
    return F.col(c).cast("binary") if isinstance(c, str) else c.cast("binary")


def derived_uuid(data):
    """Version 8 ID of a column's bytes: SHA-256 with the version and variant bits set, all in the JVM."""
    h = F.sha2(_bytes(data), 256)
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.unhex(F.concat(F.substring(h, 1, 12), F.lit("8"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15)))


def relation_entity_id(relation_id):
    return derived_uuid(F.concat(F.lit(RELATION_ENTITY_PREFIX).cast("binary"), _bytes(relation_id)))


def unique_relation_id(from_id, to_id, type_id):
    return derived_uuid(F.concat(_bytes(from_id), _bytes(to_id), _bytes(type_id)))


def value_id(property_id, payload):
    """First 16 bytes of the SHA-256 of property and payload, without version bits."""
    return F.unhex(F.substring(F.sha2(F.concat(_bytes(property_id), _bytes(payload)), 256), 1, 32))


def text_value_id(property_id, text, language=None):
    none = F.unhex(F.lit(NIL))
    return value_id(property_id, F.concat(_bytes(text), none if language is None else F.coalesce(_bytes(language), none)))


def language_id(tag):
    return derived_uuid(F.concat(F.lit(LANGUAGE_PREFIX), F.lower(tag)))


def genesis_id(name):
    """Derived ID of a well-known name, as Name or Person; case counts."""
    return derived_uuid(F.concat(F.lit(GENESIS_PREFIX), name))


def data_type_id(name):
    return derived_uuid(F.concat(F.lit(DATA_TYPE_PREFIX), F.lower(name)))


def format_id(c):
    return F.lower(F.hex(c))


def parse_id(c):
    """32 hexadecimal digits, hyphens allowed; anything else is null."""
    plain = F.regexp_replace(c, "-", "")
    return F.when(plain.rlike("^[0-9A-Fa-f]{32}$"), F.unhex(plain))
