"""File-name and path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions accepted for upload, by kind.
ALLOWED_EXTENSIONS = (
    ".zip", ".tar", ".gz", ".json", ".yaml", ".yml", ".txt",
    ".jpg", ".jpeg", ".png", ".bmp", ".webp",
    ".onnx", ".pt", ".pth", ".ts", ".bin",
    ".pdf", ".csv",
)
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".webp")


def uniform(path: Column, encoded: bool = False) -> Column:
    """One spelling for a file path, so paths from different readers can be joined.

    Readers write local files as ``file:/x`` or ``file:///x``; the ``_metadata`` column
    also percent-encodes.
    """
    if encoded:
        path = F.url_decode(F.regexp_replace(path, r"\+", "%2B"))
    return F.regexp_replace(path, "^file:/+", "file:/")


def file_path() -> Column:
    """Path of the file a row was read from."""
    return uniform(F.col("_metadata.file_path"), encoded=True)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """Base name without its last extension; a leading dot is part of the stem."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Lower-cased last extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(basename(path), r"(?<=.)(\.[^.]+)$", 1))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def safe_name(path: Column) -> Column:
    """Base name with every character outside ``[a-zA-Z0-9_.-]`` replaced by ``_``."""
    clean = F.regexp_replace(basename(path), r"[^a-zA-Z0-9_.\-]", "_")
    return F.when(clean == "", "unnamed_asset").otherwise(clean)


def extension_allowed(path: Column, allowed: tuple[str, ...] = ALLOWED_EXTENSIONS) -> Column:
    return extension(path).isin(*allowed)


def escapes_root(path: Column) -> Column:
    """True where a relative path climbs above its root, or is absolute.

    The depth after each component is a running sum (+1 for a name, -1 for ``..``);
    the path escapes if any prefix goes below zero.
    """
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    lowest = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")),
        lambda acc, p: F.struct(
            (acc["depth"] + F.when(p == "..", -1).otherwise(1)).alias("depth"),
            F.least(acc["low"], acc["depth"] + F.when(p == "..", -1).otherwise(1)).alias("low"),
        ),
        lambda acc: acc["low"],
    )
    return path.startswith("/") | (lowest < 0)


def last_component(path: Column, markers: tuple[str, ...], default: str) -> Column:
    """Last path component holding one of ``markers``, ignoring case."""

    def holds(part: Column) -> Column:
        found = F.lit(False)
        for marker in markers:
            found = found | F.lower(part).contains(marker)
        return found

    matches = F.filter(F.split(path, "/"), holds)
    return F.coalesce(F.try_element_at(matches, F.lit(-1)), F.lit(default))


def source_of(path: Column) -> Column:
    return last_component(path, ("source_", "contributor_"), "default_source")


def batch_of(path: Column) -> Column:
    return last_component(path, ("batch_",), "batch_0")
