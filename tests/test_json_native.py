"""JSON walked in the JVM against the walk in Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lustrate.operators import json_native, units
from lustrate.sources.extract import canonical

TEXTS = ["", "a", "x/y~z", "é ü", 'quo"te\\', "line\n\ttab\r\b\f", "日本", "😀", "￿", "\x0b\x1f", "\\u000B", "10", "9", "A", "1e3", " ", "nul\0", "\x7f"]


def value(dice, depth):
    kind = dice.randint(0, 9)
    if depth and kind < 4:
        return {dice.choice(TEXTS) + str(i % 3): value(dice, depth - 1) for i in range(dice.randint(0, 4))}
    if depth and kind < 6:
        return [value(dice, depth - 1) for _ in range(dice.randint(0, 4))]
    return dice.choice([*TEXTS, 0, -1, 1.5, 1e300, 12345678901234567890, True, None])


def frame(spark, values):
    rows = [(str(i), "", i % 3, "JSON" if i % 2 else "ZIP", "json", canonical(v), None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "artifact_id string, source_locator_hash string, record_index long, artifact_type string, kind string, record string, reason string")


def test_units_and_records_are_those_of_python(spark):
    dice = random.Random(8)
    deep = "x"
    for i in range(json_native.LEVELS + 3):
        deep = [deep] if i % 2 else {"k": deep}
    values = [value(dice, d % 9) for d in range(400)] + ["s", 1, None, [], {}, "", {"": ""}, deep, deep[0] if isinstance(deep, list) else deep["k"]]
    records = frame(spark, values).repartition(3)
    natively = records.where(json_native.plain(F.col("record"))).count()
    assert 150 < natively < len(values)
    got = {}
    for r in units.scan_units(records).collect():
        got.setdefault(int(r["artifact_id"]), []).append((r["unit_index"], r["unit_kind"], r["place"], r["field"], r["pointer"], r["row_index"], r["rewritable"], r["text"]))
    want = {i: w for i, v in enumerate(values) if (w := units.units_of("json", canonical(v), i % 3, "JSON" if i % 2 else "ZIP"))}
    assert {i: sorted(u) for i, u in got.items()} == want
    # Back again: leaves changed, keys as they were.
    changed = units.scan_units(records).withColumn("text_out", F.when(F.col("rewritable"), F.concat("text", F.lit('"<é\n>\\'))).otherwise(F.col("text")))
    out = {int(r["artifact_id"]): r["record_out"] for r in units.rebuild_records(records, changed).collect()}

    def new(v):
        if isinstance(v, str):
            return v + '"<é\n>\\'
        return [new(x) for x in v] if isinstance(v, list) else {k: new(x) for k, x in v.items()} if isinstance(v, dict) else v

    assert out == {i: canonical(new(v)) for i, v in enumerate(values)}


@pytest.mark.parametrize("levels", range(json_native.LEVELS + 2))
def test_how_deep_is_plain(spark, levels):
    v = "x"
    for i in range(levels):
        v = {"[{": v, "b": [1]} if i % 2 else [v, "]}"]
    assert frame(spark, [v]).select(json_native.plain(F.col("record"))).first()[0] == (levels <= json_native.LEVELS)
    assert json.loads(canonical(v)) == v


def test_plain_json_needs_no_python(spark):
    records = frame(spark, [{"a": "b"}])
    plan = json_native.native_units(records.where(json_native.plain(F.col("record"))), units.KEYS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
