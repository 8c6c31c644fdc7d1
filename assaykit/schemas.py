"""Table schemas, as Spark DDL."""

ANNOTATION = (
    "class_name STRING, category_id BIGINT, bbox ARRAY<DOUBLE>, area DOUBLE, normalized ARRAY<DOUBLE>"
)

SAMPLES = (
    "dataset_id STRING, ordinal BIGINT, sample_id STRING, image_path STRING, source_id STRING, "
    "batch_id STRING, contributor STRING, labels ARRAY<STRING>, width INT, height INT"
)

ANNOTATIONS = (
    "dataset_id STRING, sample_id STRING, class_name STRING, category_id BIGINT, "
    "bbox ARRAY<DOUBLE>, area DOUBLE, normalized ARRAY<DOUBLE>"
)

COCO_FILE = (
    "images ARRAY<STRUCT<id: BIGINT, file_name: STRING, width: INT, height: INT, source: STRING, "
    "source_id: STRING, contributor_id: STRING, batch_id: STRING, contributor: STRING>>, "
    "annotations ARRAY<STRUCT<id: BIGINT, image_id: BIGINT, category_id: BIGINT, "
    "bbox: ARRAY<DOUBLE>, area: DOUBLE>>, "
    "categories ARRAY<STRUCT<id: BIGINT, name: STRING>>, "
    "info MAP<STRING, STRING>"
)

ISSUES = "sample_id STRING, severity STRING, issue_type STRING, details STRING"

ANOMALIES = "sample_id STRING, kind STRING"
ANOMALY_KINDS = ("duplicate", "label", "ood", "trigger")

FINDINGS = (
    "finding_id STRING, asset_type STRING, asset_id STRING, category STRING, severity STRING, "
    "confidence DOUBLE, risk_score DOUBLE, title STRING, description STRING, evidence ARRAY<STRING>, "
    "affected BIGINT, detection_method STRING, limitations ARRAY<STRING>, "
    "recommendation STRING, created_at TIMESTAMP"
)

FINDING_SAMPLES = "finding_id STRING, ordinal BIGINT, sample_id STRING"

INFERENCE_RECORDS = (
    "arrival BIGINT, record_id STRING, input_sha256 STRING, model_sha256 STRING, "
    "preprocessing_sha256 STRING, config_sha256 STRING, output_sha256 STRING, timestamp STRING, "
    "nonce STRING, sequence BIGINT, record_hash STRING, signature STRING, public_key_hex STRING"
)

AUDIT_EVENTS = (
    "chain STRING, seq BIGINT, event_id STRING, timestamp STRING, actor STRING, action STRING, "
    "asset STRING, metadata_json STRING, previous_hash STRING, current_hash STRING"
)

TENSOR_VALUES = (
    "model_id STRING, framework STRING, sha256 STRING, layer STRING, shape ARRAY<INT>, values ARRAY<FLOAT>"
)

PREDICTIONS = "model_id STRING, item_id STRING, perturbation STRING, logits ARRAY<DOUBLE>"

GROUND_TRUTH = "scenario STRING, sample_id STRING"
