"""Object identity: digests over a type-and-length header and the payload, and id helpers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID_HEX = {"sha1": 40, "sha256": 64}


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def object_header(kind, data) -> Column:
    """``<type> <length>`` and a zero byte, as binary. ``kind`` is a type name or a column."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(F.concat_ws(" ", kind, F.octet_length(_col(data)).cast("string")).cast("binary"), F.unhex(F.lit("00")))


def digest(data, hash_kind: str = "sha1") -> Column:
    """Hex digest of raw bytes."""
    if hash_kind not in ID_HEX:
        raise ValueError(f"unknown hash kind {hash_kind}")
    return F.sha1(_col(data)) if hash_kind == "sha1" else F.sha2(_col(data), 256)


def object_id(kind, data, hash_kind: str = "sha1") -> Column:
    """Lower-case hex id of an object, by sha1 or sha256."""
    return digest(F.concat(object_header(kind, data), _col(data).cast("binary")), hash_kind)


def id_to_bytes(oid) -> Column:
    return F.unhex(_col(oid))


def id_from_bytes(data) -> Column:
    return F.lower(F.hex(_col(data)))


def zero_id(hash_kind: str = "sha1") -> Column:
    return F.lit("0" * ID_HEX[hash_kind])


def id_kind(oid) -> Column:
    """Hash kind by the id's length; null if it is neither, or not hex."""
    oid = _col(oid)
    return F.when(oid.rlike("^[0-9a-f]{40}$"), "sha1").when(oid.rlike("^[0-9a-f]{64}$"), "sha256")


def short_id(oid, n: int = 7) -> Column:
    """First digits of an id, zeros for none."""
    return F.coalesce(F.substring(_col(oid), 1, n), F.lit("0" * n))


def payload_crc32(data) -> Column:
    return F.crc32(_col(data))


def integrity_hash(value) -> Column:
    """sha256 of the value's JSON with sorted keys, so that key order doesn't matter."""
    return F.sha2(canonical_json(_col(value)), 256)


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON text with the keys of all objects sorted; null where it is no JSON. No SQL function sorts nested keys."""
    def one(text):
        try:
            return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return texts.map(one)
