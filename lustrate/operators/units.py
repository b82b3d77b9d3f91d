"""Records to scan units (one row per string that can be scanned) and back."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustrate.functions import arrow
from lustrate.operators import json_native
from lustrate.sources.extract import canonical, write_csv

UNIT = "unit_index long, unit_kind string, place string, field string, pointer string, row_index long, rewritable boolean, text string"
UNIT_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
KEYS = ["artifact_id", "source_locator_hash", "record_index"]


def pointer_part(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def json_units(value, pointer: str = ""):
    """(pointer, is_key, text) of all keys and string leaves, in the order of the canonical form."""
    if isinstance(value, str):
        yield pointer, False, value
    elif isinstance(value, list):
        for i, item in enumerate(value):
            yield from json_units(item, f"{pointer}/{i}")
    elif isinstance(value, dict):
        for key in sorted(value):
            below = f"{pointer}/{pointer_part(key)}"
            yield below, True, key
            yield from json_units(value[key], below)


def replaced(value, texts):
    """``value`` with its string leaves taken from ``texts`` in the order of ``json_units``."""
    if isinstance(value, str):
        return next(texts)
    if isinstance(value, list):
        return [replaced(x, texts) for x in value]
    if isinstance(value, dict):
        out = {}
        for key in sorted(value):
            next(texts)  # the key itself is never rewritten
            out[key] = replaced(value[key], texts)
        return out
    return value


def units_of(kind: str, record: str, index: int = 0, artifact_type: str = "NDJSON") -> list[tuple]:
    """The units of a record; ``place`` is where a unit stands in its file, for locators."""
    if kind == "text":
        return [(0, "text", "text", None, None, None, True, record)]
    if kind == "csv":
        table = json.loads(record)
        cells = [("csv_header", None, "csv:header", table["headers"])] + [("csv_cell", r, f"csv:r{r}", row) for r, row in enumerate(table["records"])]
        flat = [(k, f"{place}:c{c}", table["headers"][c], r, text) for k, r, place, row in cells for c, text in enumerate(row)]
        return [(i, k, place, name, None, r, True, text) for i, (k, place, name, r, text) in enumerate(flat)]
    base = "json" if artifact_type == "JSON" else f"ndjson:r{index}"
    leaves = enumerate(json_units(json.loads(record)))
    return [(i, "json_key" if is_key else "json_leaf", f"{base}:key" if is_key else base, None, p, None, not is_key, text) for i, (p, is_key, text) in leaves]


def rebuilt(kind: str, record: str, texts: list[str], delimiter: str) -> str:
    if kind == "text":
        return texts[0]
    if kind == "csv":
        table = json.loads(record)
        n = len(table["headers"])
        rows = [texts[i : i + n] for i in range(0, len(texts), n)]
        return write_csv({"headers": rows[0], "records": rows[1:]}, delimiter)
    return canonical(replaced(json.loads(record), iter(texts)))


def scan_units(records: DataFrame) -> DataFrame:
    """Units of ``records`` (best a saved table: it is read once for each way). Texts and plain JSON stay in
    the JVM; tables and other JSON are walked in Python."""
    schema = f"artifact_id string, source_locator_hash string, record_index long, {UNIT}"
    names = [c.split()[0] for c in schema.split(", ")]
    kind = F.col("artifact_type") if "artifact_type" in records.columns else F.lit("NDJSON").alias("artifact_type")
    fine = records.where("reason IS NULL AND kind IS NOT NULL").select(*KEYS, "kind", "record", kind)
    none = F.lit(None)

    def run(batches):
        for part in arrow.parts(batches):
            rows = ((a, loc, i, *unit) for a, loc, i, kind, record, t in arrow.rows_of(part, [*KEYS, "kind", "record", "artifact_type"]) for unit in units_of(kind, record, i, t))
            yield from arrow.in_batches(rows, UNIT_TYPES, names)

    texts = fine.where("kind = 'text'").select(
        *KEYS, F.lit(0).cast("long").alias("unit_index"), F.lit("text").alias("unit_kind"), F.lit("text").alias("place"), none.cast("string").alias("field"), none.cast("string").alias("pointer"),
        none.cast("long").alias("row_index"), F.lit(True).alias("rewritable"), F.col("record").alias("text"),
    )
    plain = json_native.plain(F.col("record"))
    base = F.when(F.col("artifact_type") == "JSON", F.lit("json")).otherwise(F.concat(F.lit("ndjson:r"), F.col("record_index").cast("string")))
    parsed = json_native.native_units(fine.where((F.col("kind") == "json") & plain), [*KEYS, "artifact_type"]).select(
        *KEYS, "unit_index", F.when(F.col("is_key"), "json_key").otherwise("json_leaf").alias("unit_kind"), F.when(F.col("is_key"), F.concat(base, F.lit(":key"))).otherwise(base).alias("place"),
        none.cast("string").alias("field"), "pointer", none.cast("long").alias("row_index"), (~F.col("is_key")).alias("rewritable"), "text",
    )
    walked = fine.where((F.col("kind") == "csv") | ((F.col("kind") == "json") & ~plain)).mapInArrow(run, schema)
    return texts.unionByName(parsed).unionByName(walked)


def rebuild_records(records: DataFrame, units: DataFrame) -> DataFrame:
    """Output text of every record from its rewritten units (column ``text_out``)."""
    texts = units.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("unit_index", F.coalesce("text_out", "text").alias("t")))).alias("u"))
    joined = records.where("reason IS NULL AND kind IS NOT NULL").join(texts, KEYS, "left").select(*KEYS, "artifact_type", "kind", "record", F.col("u.t").alias("texts"))
    schema = "artifact_id string, source_locator_hash string, record_index long, artifact_type string, kind string, record_out string, python boolean"
    # One pass: what the JVM can put together is there already, and Python sees the rest only.
    clear = ~F.exists(F.coalesce("texts", F.array().cast("array<string>")), lambda t: t.rlike(json_native.ODD_LETTERS))
    native = F.when(F.col("kind") == "text", F.element_at("texts", 1)).when((F.col("kind") == "json") & clear, json_native.rebuilt(F.col("record"), F.coalesce("texts", F.array().cast("array<string>"))))
    done = joined.withColumn("python", (F.col("kind") == "csv") | ((F.col("kind") == "json") & ~clear))
    names = [*KEYS, "artifact_type", "kind", "record_out"]

    def run(batches):
        for part in arrow.parts(batches):
            out = [rebuilt(kind, record, texts or [], "\t" if t == "TSV" else ",") for t, kind, record, texts in arrow.rows_of(part, ["artifact_type", "kind", "record", "texts"])]
            kept = [part.column(c) for c in [*KEYS, "artifact_type", "kind"]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.string()), pa.array([True] * len(out))], [*names, "python"])

    return done.where("NOT python").withColumn("record_out", native).select(*names).unionByName(done.where("python").drop("python").mapInArrow(run, schema).select(*names))


def assemble(records_out: DataFrame) -> DataFrame:
    """One output per artifact: records in order; lines of JSON end with a line feed each."""
    line = F.when((F.col("kind") == "json") & (F.col("artifact_type") != "JSON"), F.concat("record_out", F.lit("\n"))).otherwise(F.col("record_out"))
    lines = records_out.groupBy("artifact_id", "source_locator_hash").agg(F.sort_array(F.collect_list(F.struct("record_index", line.alias("line")))).alias("l"))
    return lines.select("artifact_id", "source_locator_hash", F.array_join("l.line", "").alias("output"))
