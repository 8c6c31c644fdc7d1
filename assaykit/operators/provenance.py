"""Hash-bound inference records: build, check components, settle a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.hashing import canonical_object, sha256

# The fields bound by the record hash.
BOUND_FIELDS = (
    "record_id",
    "input_sha256",
    "model_sha256",
    "preprocessing_sha256",
    "config_sha256",
    "output_sha256",
    "timestamp",
    "nonce",
    "sequence",
)
# Component hash column -> name reported when it was tampered with.
COMPONENTS = {
    "input_sha256": "INPUT_IMAGE",
    "model_sha256": "MODEL_FILE",
    "output_sha256": "OUTPUT_PAYLOAD",
    "preprocessing_sha256": "PREPROCESSING_CONFIG",
    "config_sha256": "INFERENCE_CONFIG",
}
HASH_BROKEN = "RECORD_METADATA_OR_HASH_MISMATCH"
SIGNATURE_BROKEN = "ED25519_DIGITAL_SIGNATURE"


def record_hash() -> Column:
    """Hash over the nine bound fields as canonical JSON."""
    return sha256(canonical_object({name: F.col(name) for name in BOUND_FIELDS}))


def build_records(inferences: DataFrame, components: dict[str, Column]) -> DataFrame:
    """Provenance records: ``components`` maps each of the five hash columns to the value
    to hash (text or bytes); record_id, timestamp, nonce and sequence are input columns."""
    hashed = inferences.select(
        "record_id",
        "timestamp",
        "nonce",
        "sequence",
        *[sha256(value).alias(name) for name, value in components.items()],
    )
    return hashed.withColumn("record_hash", record_hash())


def check_records(
    records: DataFrame, current: DataFrame | None = None, signature_valid: Column | None = None
) -> DataFrame:
    """Compare records with current component hashes and settle their status.

    ``current`` has record_id and any component columns; a null there means not checked.
    A bad signature outranks tampering. ``signature_valid`` defaults to true.
    """
    checked = records
    compared = []
    if current is not None:
        present = [c for c in COMPONENTS if c in current.columns]
        renamed = current.select("record_id", *[F.col(c).alias(f"_now_{c}") for c in present])
        checked = records.join(renamed, "record_id", "left")
        compared = present
    broken = [
        (F.col(f"_now_{c}").isNotNull() & (F.col(f"_now_{c}") != F.col(c)), COMPONENTS[c]) for c in compared
    ]
    broken += [(~F.col("hash_match"), HASH_BROKEN), (~F.col("signature_valid"), SIGNATURE_BROKEN)]
    signed = signature_valid if signature_valid is not None else F.lit(True)
    result = (
        checked.withColumn("hash_match", record_hash() == F.col("record_hash"))
        .withColumn("signature_valid", signed)
        .withColumn("tamper_detected_in", F.array_compact(F.array(*[F.when(found, name) for found, name in broken])))
    )
    # not from the list: its filter is not compiled, and with it neither would be the hash
    tampered = F.lit(False)
    for found, _ in broken:
        tampered = tampered | found
    status = (
        F.when(~F.col("signature_valid"), "INVALID_SIGNATURE")
        .when(tampered, "TAMPERED")
        .otherwise("VERIFIED")
    )
    return settle(result.withColumn("status", status).drop(*[f"_now_{c}" for c in compared]))


def settle(results: DataFrame) -> DataFrame:
    """Derive validity and disposition from ``status``."""
    return results.withColumn("is_valid", F.col("status") == "VERIFIED").withColumn(
        "disposition", F.when(F.col("status") == "VERIFIED", "ACCEPT").otherwise("QUARANTINE")
    )


def with_replays(checked: DataFrame, replayed: DataFrame) -> DataFrame:
    """Let replay override the status; ``replayed`` lists (arrival, reasons, perhaps detail)."""
    shown = [c for c in ("arrival", "reasons", "detail") if c in replayed.columns]
    joined = checked.join(replayed.select(*shown), "arrival", "left")
    status = F.when(F.col("reasons").isNotNull(), "REPLAY_DETECTED").otherwise(F.col("status"))
    return settle(joined.withColumn("status", status))


def status_details() -> Column:
    """A sentence on how a record got its status; ``detail`` holds the texts of its replay reasons."""
    replayed = F.concat(F.lit("Replay: "), F.col("detail"))
    broken = F.concat(F.lit("Changed since signing: "), F.array_join("tamper_detected_in", ", "))
    return (
        F.when(F.col("status") == "REPLAY_DETECTED", replayed)
        .when(F.col("status") == "INVALID_SIGNATURE", "The signature does not belong to the record")
        .when(F.col("status") == "TAMPERED", broken)
        .otherwise("All hashes and the signature hold")
    )


def record_flags(verified: DataFrame) -> DataFrame:
    """The status columns stored back with each record."""
    return verified.select(
        "arrival",
        "record_id",
        F.col("status").alias("verification_status"),
        F.col("status").isin("TAMPERED", "INVALID_SIGNATURE").alias("is_tampered"),
        (F.col("status") == "REPLAY_DETECTED").alias("is_replayed"),
    )


def status_counts(records: DataFrame) -> DataFrame:
    """Total, tampered, replayed and valid records in one pass."""
    counted = records.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_tampered").alias("tampered"),
        F.count_if("is_replayed").alias("replayed"),
    )
    rest = F.col("total") - F.col("tampered") - F.col("replayed")
    return counted.withColumn("valid", F.greatest(F.lit(0).cast("long"), rest))
