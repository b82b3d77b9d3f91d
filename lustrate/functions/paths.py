"""Paths of archive entries as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_entry_path(raw: Column) -> Column:
    """A relative path with plain parts, or null where the entry points outside its archive."""
    path = F.replace(raw, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    unsafe = path.startswith("/") | path.rlike("^[A-Za-z]:") | path.contains("\0") | F.array_contains(parts, "..") | (F.size(parts) == 0)
    return F.when(~unsafe, F.array_join(parts, "/"))


def is_nested(path: Column) -> Column:
    return F.coalesce(F.lower(path).endswith(".zip") | F.lower(path).endswith(".tar"), F.lit(False))
