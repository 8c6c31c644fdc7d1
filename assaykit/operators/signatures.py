"""Batch signing and verification of record hashes (Ed25519)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from assaykit.functions import ed25519


def sign_records(records: DataFrame, seed: bytes) -> DataFrame:
    """Add ``signature`` and ``public_key_hex`` over ``record_hash``."""
    public = ed25519.public_key(seed).hex()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            signed = [ed25519.sign(seed, h.encode()).hex() for h in pdf["record_hash"]]
            yield pdf.assign(signature=signed, public_key_hex=public)

    schema = T.StructType(
        [*records.schema.fields, T.StructField("signature", T.StringType()), T.StructField("public_key_hex", T.StringType())]
    )
    return records.mapInPandas(run, schema)


def _valid(record_hash, signature, key) -> bool:
    try:
        return ed25519.verify(bytes.fromhex(key), record_hash.encode(), bytes.fromhex(signature))
    except (TypeError, ValueError, AttributeError):
        return False


def verify_signatures(records: DataFrame, column: str = "signature_ok") -> DataFrame:
    """Add a boolean column; anything malformed or missing counts as invalid."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = zip(pdf["record_hash"], pdf["signature"], pdf["public_key_hex"])
            yield pdf.assign(**{column: [_valid(*r) for r in rows]})

    schema = T.StructType([*records.schema.fields, T.StructField(column, T.BooleanType())])
    return records.mapInPandas(run, schema)
