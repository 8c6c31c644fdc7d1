"""Small label and JSON-text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark a source as suspect by name.
SUSPECT_WORDS = ("rogue", "poison", "flood", "bad")


def primary_label(labels: Column) -> Column:
    return F.coalesce(F.get(labels, F.lit(0)), F.lit("unlabelled"))


def label_set(labels: Column) -> Column:
    return F.array_sort(F.array_distinct(labels))


def suspect_source(source: Column) -> Column:
    return F.lower(source).rlike("|".join(SUSPECT_WORDS))


def decode_list(text: Column, element: str = "STRING") -> Column:
    """JSON array text to an array; malformed or missing text gives an empty array."""
    parsed = F.from_json(text, f"ARRAY<{element}>", {"mode": "PERMISSIVE"})
    return F.coalesce(parsed, F.array().cast(f"array<{element}>"))


def encode_json(value: Column) -> Column:
    return F.to_json(value)


def corner_box(xc: Column, yc: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Normalised centre box to pixel corner box [x, y, w, h], one decimal."""
    return F.array(
        F.round((xc - w / 2) * width, 1),
        F.round((yc - h / 2) * height, 1),
        F.round(w * width, 1),
        F.round(h * height, 1),
    )
