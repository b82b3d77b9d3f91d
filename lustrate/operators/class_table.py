"""Policies of any number of classes as data: one plan, however many classes there are.

The classes are one row of a table that is broadcast (its size is that of the policy file). Units meet
classes by the literals that a class's patterns need: all literals are looked for in one pass over a text,
what is found is joined with a broadcast table of literals, and only classes whose literal is there have
their patterns tried. Classes without a known literal are tried on every unit. Rewriting goes through
the classes in order of their ids in one fold, as each works on what the ones before it left; there the
literals are looked for in the text as it is by then.

Results for odd input: null texts have no findings and stay null; a unit that no class applies to has no
rows; a policy of one class is a table of one class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lustrate.functions import literals
from lustrate.operators import detect, rewrite
from lustrate.plans.policy import Policy

CLASS = "ordinal int, class_id string, severity string, action string, keep_last int, selector string, fields array<string>, detectors array<struct<luhn:boolean,pattern:string>>, literals array<string>"


def class_rows(policy: Policy) -> list[tuple]:
    return [
        (i, c.class_id, c.severity, c.action, c.keep_last, c.selector, list(c.fields), [(d.kind == "luhn", detect.CARD_RUN if d.kind == "luhn" else d.pattern) for d in c.detectors], rewrite.class_literals(c))
        for i, c in enumerate(policy.classes)
    ]


def class_frame(spark: SparkSession, policy: Policy) -> DataFrame:
    return spark.createDataFrame(class_rows(policy), CLASS)


def literal_rows(rows: list[tuple]) -> tuple[list[str], list[tuple[str, int, list[str]]]]:
    """All literals, and (literal, class, the literals that count before it for that class).

    A search gives the longest literal at a place, so a literal stands for its beginnings too."""
    words = sorted({w for r in rows for w in r[-1] or ()})
    known, out = set(words), []
    begins = {w: [w[:n] for n in range(1, len(w) + 1) if w[:n] in known] for w in words}
    of: dict[str, set[int]] = {}
    for r in rows:
        for w in r[-1] or ():
            of.setdefault(w, set()).add(r[0])
    by_class: dict[int, list[str]] = {}
    for w in words:
        for ordinal in sorted(set().union(*(of[b] for b in begins[w]))):
            out.append((w, ordinal, list(by_class.setdefault(ordinal, []))))
            by_class[ordinal].append(w)
    return words, out + [("", r[0], []) for r in rows if r[-1] is None]


def selected(c: Column, unit_kind: Column, field: Column, pointer: Column) -> Column:
    """Whether a class (a struct) looks at a unit: a selector of the other kind is no filter."""
    of = lambda kind, value: ~F.coalesce(unit_kind.startswith(kind), F.lit(False)) | F.coalesce(F.array_contains(c["fields"], value), F.lit(False))
    return F.when(c["selector"] == "csv_header", of("csv", field)).when(c["selector"] == "json_pointer", of("json", pointer)).otherwise(True)


def unit_columns(df: DataFrame) -> tuple[Column, Column, Column]:
    """unit_kind, field and pointer of the units; plain texts have none of them."""
    return tuple(F.col(n) if n in df.columns else F.lit(None).cast("string") for n in ("unit_kind", "field", "pointer"))


def candidates(units: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """``units`` joined with the classes that may find something in them, as column ``class``."""
    spark, rows = units.sparkSession, class_rows(policy)
    words, table = literal_rows(rows)
    there = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(literals.trie_pattern(words)), F.lit(1))) if words else F.array().cast("array<string>")
    keys = spark.createDataFrame(table, "_literal string, _ordinal int, _before array<string>")
    classes = class_frame(spark, policy).select(F.col("ordinal").alias("_ordinal"), F.struct(*[c.split()[0] for c in CLASS.split(", ")]).alias("class"))
    found = units.where(F.col(text).isNotNull()).withColumn("_there", there).withColumn("_literal", F.explode(F.concat("_there", F.array(F.lit("")))))
    # Both tables are as large as the policy. A class comes once for each unit: by its first literal there.
    met = found.join(F.broadcast(keys), "_literal").where(~F.arrays_overlap("_there", "_before")).join(F.broadcast(classes), "_ordinal")
    return met.drop("_literal", "_ordinal", "_before", "_there").where(selected(F.col("class"), *unit_columns(units)))


def count(text: Column, c: Column) -> Column:
    """Raw matches of a class (a struct), over all its detectors."""
    one = lambda d: F.when(d["luhn"], F.size(detect.cards(text))).otherwise(F.regexp_count(text, d["pattern"])).cast("long")
    return F.aggregate(c["detectors"], F.lit(0).cast("long"), lambda n, d: n + one(d))


def class_counts(units: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """The columns of ``units`` but its text, with class_id, severity, action and n (above 0)."""
    met = candidates(units, policy, text).withColumn("n", count(F.col(text), F.col("class"))).where("n > 0")
    return met.select(*[c for c in units.columns if c != text], "class.class_id", "class.severity", "class.action", "n")


def class_hits(units: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """One row per match: the columns of ``units`` with class_id, severity, action, luhn, start, end, hit."""
    met = candidates(units, policy, text).withColumn("_d", F.explode("class.detectors"))
    rows = met.withColumn("_h", F.explode(detect.hits(F.col(text), F.col("_d.pattern"), F.col("_d.luhn"))))
    return rows.select(*units.columns, "class.class_id", "class.severity", "class.action", "_d.luhn", "_h.start", "_h.end", "_h.hit")


def with_classes(units: DataFrame, policy: Policy) -> DataFrame:
    """``units`` with the whole policy as column ``_classes``, an array of structs in order."""
    names = [c.split()[0] for c in CLASS.split(", ")]
    table = class_frame(units.sparkSession, policy).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("_classes"))
    # One row, as large as the policy.
    return units.join(F.broadcast(table), F.lit(True))


def rewrite_units(units: DataFrame, policy: Policy, out: str = "text_out", text: str = "text") -> DataFrame:
    """``units`` with the rewritten text as ``out``."""
    place = unit_columns(units)
    return with_classes(units, policy).withColumn(out, rewrite.fold_classes(F.col(text), F.col("_classes"), lambda c: selected(c, *place))).drop("_classes")


def residual_units(units: DataFrame, policy: Policy, text: str = "text_out", out: str = "residual") -> DataFrame:
    """``units`` with whether any class that applies still finds something in ``text``."""
    place = unit_columns(units)
    left = F.exists("_classes", lambda c: selected(c, *place) & rewrite.found_by(F.col(text), c))
    return with_classes(units, policy).withColumn(out, F.coalesce(left, F.lit(False))).drop("_classes")
