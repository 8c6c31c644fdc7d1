"""SHA-256 digests and canonical JSON."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sha256(value: Column) -> Column:
    """Hex SHA-256 of a string or binary column."""
    return F.sha2(value, 256)


def canonical_object(fields: dict[str, Column]) -> Column:
    """Canonical JSON text of typed fields: sorted keys, no spaces.

    Built from JVM expressions, for string, integer and boolean values. Strings must
    be ASCII (ids, hex digests, ISO timestamps); the text then equals what any
    canonical JSON writer gives. Use ``canonical_json`` for anything else.
    """
    whole = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.to_json(whole, {"ignoreNullFields": "false"})


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Canonical form of arbitrary JSON text; null where the text is not JSON."""

    def one(value):
        if value is None:
            return None
        try:
            parsed = json.loads(value)
        except ValueError:
            return None
        return json.dumps(parsed, sort_keys=True, separators=(",", ":"), ensure_ascii=True)

    return text.map(one)


@F.pandas_udf(T.StringType())
def array_digest(values: pd.Series) -> pd.Series:
    """SHA-256 over shape, dtype and float32 bytes of a vector."""

    def one(value):
        if value is None:
            return None
        array = np.asarray(value, dtype=np.float32)
        digest = hashlib.sha256(f"{array.shape}{array.dtype}".encode())
        digest.update(array.tobytes())
        return digest.hexdigest()

    return values.map(one)


def ledger_hash(
    previous: Column, timestamp: Column, actor: Column, action: Column, asset: Column, meta: Column
) -> Column:
    """Hash binding a ledger entry to the one before it."""
    fields = [previous, timestamp, actor, action, asset, meta]
    # concat_ws would skip nulls and shift the fields
    return sha256(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]))
