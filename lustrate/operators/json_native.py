r"""JSON records as scan units and back, by VARIANT and string tokens, without leaving the JVM.

A record is parsed once. Each step opens one level: objects give a row for each key and one for its value,
arrays one for each item, and rows that hold no container pass as they are, so all levels are one chain of
generators without a shuffle; a last window numbers the units of a record in the order of its canonical
form. Back again, the canonical text is cut at its string tokens, which are the units in that order, and
the tokens are replaced by the new texts.

Records that are nested deeper than ``LEVELS``, hold letters above U+D7FF (their keys sort in another way
here) or can't be parsed as VARIANT are not ``plain``; they are for the walk in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels of containers that are opened in one plan.
LEVELS = 6
#: A string of canonical JSON, and an innermost container of a text without strings.
STRING, INNERMOST = r'"(?:[^"\\]|\\.)*+"', r"[\[{][^\[\]{}]*+[\]}]"
#: Letters that JSON writers escape in different ways.
ODD_LETTERS = r"[\x0B\x0E\x0F\x1A-\x1F]"
UNIT = "struct<pointer:string,is_key:boolean,text:string,path:array<int>,v:variant>"


def plain(record: Column) -> Column:
    """Whether a canonical record can be walked here."""
    bare = F.regexp_replace(record, STRING, "")
    for _ in range(LEVELS):
        bare = F.regexp_replace(bare, INNERMOST, "")
    return F.coalesce(~bare.rlike(r"[\[{]") & ~record.rlike(r"[\x{D800}-\x{10FFFF}]") & F.try_parse_json(record).isNotNull(), F.lit(False))


def escaped(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def unit(pointer: Column, is_key: bool, text: Column, path: Column, v: Column) -> Column:
    return F.struct(pointer.alias("pointer"), F.lit(is_key).alias("is_key"), text.cast("string").alias("text"), path.alias("path"), v.cast("variant").alias("v"))


def opened(u: Column) -> Column:
    """What one row (a struct) becomes: itself without a value to open, a leaf, or its children."""
    none, kind = F.lit(None), F.schema_of_variant(u["v"])
    below = lambda key: F.concat(u["pointer"], F.lit("/"), key)
    path = lambda *at: F.concat(u["path"], F.array(*at))
    entries = F.map_entries(u["v"].try_cast("map<string,variant>"))
    members = F.flatten(F.transform(entries, lambda e, i: F.array(
        unit(below(escaped(e["key"])), True, e["key"], path(i, F.lit(0)), none), unit(below(escaped(e["key"])), False, none, path(i, F.lit(1)), e["value"]),
    )))
    items = F.transform(u["v"].try_cast("array<variant>"), lambda x, i: unit(below(i.cast("string")), False, none, path(i), x))
    leaf = F.array(unit(u["pointer"], False, F.try_variant_get(u["v"], "$", "string"), u["path"], none))
    some = F.when(u["v"].isNull(), F.array(unit(u["pointer"], False, u["text"], u["path"], none))).when(kind == "STRING", leaf)
    some = some.when(kind.startswith("OBJECT"), members).when(kind.startswith("ARRAY"), items).otherwise(F.array())
    return F.when(u["is_key"], F.array(unit(u["pointer"], True, u["text"], u["path"], none))).otherwise(some.cast(f"array<{UNIT}>"))


def native_units(records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, unit_index, is_key, pointer, text of the units of ``plain`` records (column ``record``)."""
    start = unit(F.lit(""), False, F.lit(None), F.array().cast("array<int>"), F.try_parse_json("record"))
    rows = records.select(*keys, start.alias("u"))
    for _ in range(LEVELS + 1):
        rows = rows.select(*keys, F.explode(opened(F.col("u"))).alias("u"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("u.path")) - 1
    return rows.where("u.text IS NOT NULL").select(*keys, number.cast("long").alias("unit_index"), "u.is_key", "u.pointer", "u.text")


def written(text: Column) -> Column:
    """A text as a JSON string."""
    line = F.to_json(F.struct(text.alias("t")))
    return F.substring(line, F.lit(6), F.length(line) - 6)


def rebuilt(record: Column, texts: Column) -> Column:
    """``record`` with its string tokens replaced by ``texts``, one for each."""
    return F.array_join(F.zip_with(F.split(record, STRING, -1), F.transform(texts, written), lambda gap, token: F.concat(gap, F.coalesce(token, F.lit("")))), "")
