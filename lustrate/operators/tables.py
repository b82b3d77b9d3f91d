"""Tables whose rows are like CSV records, as scan units, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lustrate.operators import rewrite
from lustrate.plans.policy import Policy


def cell_units(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per cell: key, unit_kind, field, pointer, text."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("text")) for c in columns])
    rows = df.select(key, F.explode(cells).alias("u"))
    return rows.select(key, F.lit("csv_cell").alias("unit_kind"), F.col("u.field").alias("field"), F.lit(None).cast("string").alias("pointer"), F.col("u.text").alias("text"))


def applies(unit_kind: Column | None = None, field: Column | None = None, pointer: Column | None = None):
    """A test of classes against the unit columns, for ``rewrite`` and ``residual``."""
    kind, name, place = unit_kind if unit_kind is not None else F.col("unit_kind"), field if field is not None else F.col("field"), pointer if pointer is not None else F.col("pointer")
    return lambda c: rewrite.selected(c, kind, name, place)


def rewrite_cells(df: DataFrame, columns: list[str], policy: Policy) -> DataFrame:
    """``df`` with ``columns`` as text, rewritten in place: no unpivot, no shuffle."""
    changed = {c: rewrite.rewrite(F.col(c).cast("string"), policy, applies(F.lit("csv_cell"), F.lit(c), F.lit(None).cast("string"))) for c in columns}
    return df.withColumns(changed)
