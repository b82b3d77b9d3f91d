"""Transactions, resume, versions, limits that hold, running totals and events."""

import hashlib
import json
import os
import random
import re
import time
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_engine import SECRET, corpus, pack_of, policy, zipped

from lustrate.__main__ import main
from lustrate.functions import arrow
from lustrate.operators import ordered
from lustrate.plans import engine
from lustrate.plans.policy import Limits
from lustrate.scratch import Scratch
from lustrate.sources import deadline, extract, ledger


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_table(spark, pack, version=ledger.V2):
    return {k: [r.asDict() for r in df.collect()] for k, df in ledger.read(spark, Path(pack), version).items()}


def test_tables_of_a_pack(spark, tmp_path):
    """Meta, findings with locators, extractors, coverage and tokens, each as the files make them."""
    files = {"a.txt": "é SECRET", "c.csv": "id,name\n1,SECRET\n", "h.csv": "x,y\nSECRET,2\n", "j.json": '{"b":{"a/b":"SECRET"}}', "n.ndjson": '{}\n{"a":"x SECRET"}\n', "z.zip": zipped({"n.txt": "SECRET"}), "bad.bin": b"x"}
    code, _ = pack_of(spark, tmp_path, files)
    assert code == engine.QUARANTINED
    held, pack = by_table(spark, tmp_path / "pack"), tmp_path / "pack"
    names = {sha(n): n for n in files}
    located = {(names[r["source_locator_hash"]], r["locator"]) for r in held["findings"]}
    assert located == {
        ("a.txt", "text:S:b3:9"), ("c.csv", "csv:r0:c1:S:b0:6"), ("h.csv", "csv:r0:c0:S:b0:6"), ("j.json", f"json:pathhash:{sha('/b/a~1b')}:S:b0:6"),
        ("n.ndjson", f"ndjson:r1:pathhash:{sha('/a')}:S:b2:8"), ("z.zip", f"ndjson:r0:pathhash:{sha('/text')}:S:b0:6"),
    }
    artifacts = {names[r["source_locator_hash"]]: r for r in held["artifacts"]}
    assert set(artifacts) == set(files) and artifacts["bad.bin"]["state"] == "QUARANTINED" and artifacts["bad.bin"]["coverage_hash"] is None
    assert artifacts["a.txt"]["coverage_hash"] == sha("coverage.v1|content_text=FULL|structured_fields=NONE|metadata=NONE|embedded_objects=NONE|attachments=NONE")
    assert artifacts["z.zip"]["extractor_id"] == "lustrate.zip.v1"
    lines = {r["source_locator_hash"]: r for r in map(json.loads, (pack / "evidence/artifacts.ndjson").read_text().splitlines())}
    for r in held["proof_tokens"]:
        assert lines[r["source_locator_hash"]]["proof_tokens"][r["token_index"]] == r["token"]
    assert len(held["proof_tokens"]) == 6 and {r["count"] for r in held["findings_summary"]} == {1}
    meta, manifest = ledger.read_meta(pack), json.loads((pack / "pack_manifest.json").read_text())
    assert all(meta[k] == manifest[k] for k in ("run_id", "policy_id", "input_corpus_id", "tool_version")) and meta["schema_version"] == manifest["ledger_schema_version"] == ledger.V2
    assert not (pack / ".work").exists() and engine.verify(spark, str(pack), str(tmp_path / "policy")) == engine.OK
    engine.export_sqlite(spark, str(pack), str(tmp_path / "l.db"))
    import sqlite3

    with sqlite3.connect(tmp_path / "l.db") as db:
        assert db.execute("SELECT count(*) FROM findings").fetchone() == (6,) and db.execute("SELECT value FROM meta WHERE key = 'run_id'").fetchone() == (meta["run_id"],)


def test_killed_run_extracts_only_the_rest(spark, tmp_path, monkeypatch, capsys):
    rules, source = policy(tmp_path, SECRET), corpus(tmp_path, {f"{i}.txt": f"SECRET {i}" for i in range(9)})
    pack, seen, commit = tmp_path / "pack", [], ledger.commit_batch
    real = extract.extract_records

    def counted(artifacts, *args):
        seen.append(artifacts.count())
        return real(artifacts, *args)

    def killed(rows, folder, batch):
        if batch == 2:
            raise RuntimeError("killed")
        commit(rows, folder, batch)

    monkeypatch.setattr(extract, "extract_records", counted)
    monkeypatch.setattr(ledger, "commit_batch", killed)
    with pytest.raises(RuntimeError):
        engine.run(spark, source, str(pack), rules, batch_bytes=16)
    assert seen == [2, 2, 2] and not (pack / "pack_manifest.json").exists() and (pack / ".run").exists()
    kept = {p.name: (p.read_bytes(), p.stat().st_mtime_ns) for p in (pack / "sanitized").iterdir()}
    assert len(kept) == 4 == len(by_table(spark, pack)["artifacts"])
    monkeypatch.setattr(ledger, "commit_batch", commit)
    seen.clear()
    (pack / ".work" / "batch-2" / "task-0-0").mkdir(parents=True)  # what the killed batch has staged
    capsys.readouterr()
    assert engine.run(spark, source, str(pack), rules, quarantine_copy=True) == engine.USAGE  # not with other options
    assert engine.run(spark, source, str(pack), rules, batch_bytes=1000) == engine.OK
    assert seen == [5]
    assert {n: v for n, v in ((p.name, (p.read_bytes(), p.stat().st_mtime_ns)) for p in (pack / "sanitized").iterdir()) if n in kept} == kept
    assert [len(r["parts"]["artifacts"]) > 0 for r in ledger.committed(pack)] == [True] * 3 and not (pack / ".run").exists() and not (pack / ".work").exists()
    assert engine.verify(spark, str(pack), rules) == engine.OK
    events = [json.loads(x) for x in capsys.readouterr().err.splitlines() if x.startswith("{")]
    assert [(e["event"], e.get("artifacts_verified")) for e in events if e["event"] in ("batch_committed", "run_completed")] == [("batch_committed", 5), ("run_completed", 9)]
    assert any(e["event"] == "run_started" and e["resumed"] for e in events) and len({e["policy_id"] for e in events}) == 1
    # The same files in one go make the same pack.
    assert engine.run(spark, source, f"{tmp_path}/whole", rules) == engine.OK
    assert all((pack / n).read_bytes() == (tmp_path / "whole" / n).read_bytes() for n in ("evidence/artifacts.ndjson", "evidence/run_manifest.json", "pack_manifest.json"))


def test_totals_come_with_the_writing_pass(spark, tmp_path, capsys):
    files = {"a.txt": "SECRET", "b.txt": b"\xff", "c.bin": b"x", "d.bin": b"y", "e.json": '{"SECRET":1}'}
    capsys.readouterr()
    pack_of(spark, tmp_path, files)
    err = capsys.readouterr().err
    (event,) = [json.loads(x) for x in err.splitlines() if '"batch_committed"' in x]
    manifest = json.loads((tmp_path / "pack/evidence/run_manifest.json").read_text())
    assert {k: event[k] for k in manifest["quarantine_reason_counts"]} == manifest["quarantine_reason_counts"] == {"PARSE_ERROR": 1, "UNSUPPORTED_FORMAT": 2, "VERIFICATION_FAILED": 1}
    assert {k: event[k] for k in manifest["totals"]} == manifest["totals"] and event["level"] == "INFO" and event["run_id"] == manifest["run_id"]
    assert "SECRET" not in "".join(x for x in err.splitlines() if x.startswith("{"))


def test_failed_batches_leave_nothing_to_be_seen(spark, tmp_path):
    rows = [(f"a{i}", f"l{i}") for i in range(40)]
    states = spark.createDataFrame(rows, "artifact_id string, source_locator_hash string").repartition(4)
    fine = ledger.rows_of("artifacts", states).unionByName(ledger.rows_of("files", states.select(F.concat(F.lit("sanitized/"), "artifact_id").alias("path"), F.lit(b"x").alias("content"))))
    broken = fine.withColumn("content", F.when(F.col("artifact_id") == "a39", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        ledger.commit_batch(broken, tmp_path, 0)
    # Tasks that were still at work may stage more; it stays where nobody reads.
    assert not ledger.committed(tmp_path) and {p.name for p in tmp_path.iterdir()} <= {".work"} and by_table(spark, tmp_path)["artifacts"] == []
    ledger.discard_staged(tmp_path)
    ledger.commit_batch(fine, tmp_path, 0)
    ledger.commit_batch(fine.where("kind = 'files'"), tmp_path, 1)
    assert sorted((r["artifact_id"], r["source_locator_hash"]) for r in by_table(spark, tmp_path)["artifacts"]) == sorted(rows)
    assert len(list((tmp_path / "sanitized").iterdir())) == 40 and [r["rows"]["artifacts"] for r in ledger.committed(tmp_path)] == [40, 0]
    # A part that no record names is not read.
    part = next((tmp_path / "evidence/ledger/artifacts").iterdir())
    part.with_name("batch-7-0.parquet").write_bytes(part.read_bytes())
    assert len(by_table(spark, tmp_path)["artifacts"]) == 40


def test_versions_of_packs_and_ledgers(spark, tmp_path):
    code, _ = pack_of(spark, tmp_path, {"a.txt": "SECRET", "b.bin": b"x"})
    pack, rules = tmp_path / "pack", str(tmp_path / "policy")
    manifest = pack / "pack_manifest.json"
    original = json.loads(manifest.read_text())
    for pack_version, ledger_version, expected in (
        (engine.PACK, engine.LEDGER, engine.OK), ("lustrate.pack.v0", engine.LEDGER, engine.FATAL), (engine.PACK, "lustrate.ledger.v0", engine.FATAL), ("lustrate.pack.v1", engine.LEDGER, engine.OK),
    ):
        manifest.write_text(json.dumps(original | {"pack_schema_version": pack_version, "ledger_schema_version": ledger_version}))
        assert engine.verify(spark, str(pack), rules) == expected
    # A ledger of the first version: plain folders, fewer columns, no tokens.
    now = ledger.read(spark, pack, ledger.V2)
    old = tmp_path / "old"
    old.mkdir()
    now["artifacts"].drop("extractor_id", "coverage_hash").write.parquet(f"file://{old}/artifacts")
    now["findings_summary"].write.parquet(f"file://{old}/findings_summary")
    (pack / "evidence/ledger").rename(tmp_path / "new")
    old.rename(pack / "evidence/ledger")
    for pack_version in engine.PACKS:
        manifest.write_text(json.dumps(original | {"pack_schema_version": pack_version, "ledger_schema_version": ledger.V1}))
        assert engine.verify(spark, str(pack), rules) == engine.OK
    read = ledger.read(spark, pack, ledger.V1)
    assert {k: df.columns for k, df in read.items()} == {k: ledger.names(s) for k, s in ledger.TABLES.items()}
    assert read["proof_tokens"].count() == 0 and read["artifacts"].where("coverage_hash IS NULL AND extractor_id IS NULL").count() == 2
    manifest.write_text(json.dumps(original))
    assert engine.verify(spark, str(pack), rules) == engine.FATAL  # the ledger is not of that version
    (pack / "evidence/ledger").rename(tmp_path / "first")
    (tmp_path / "new").rename(pack / "evidence/ledger")
    assert engine.verify(spark, str(pack), rules) == engine.OK
    meta = pack / "evidence/ledger/meta.json"
    meta.write_text(meta.read_text().replace(original["run_id"], "another"))
    assert engine.verify(spark, str(pack), rules) == engine.FATAL


def test_lines_are_in_order_and_whole(spark, tmp_path):
    rows = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.when(F.col("id") % 2 == 0, F.lit("é\n")).alias("v")).repartition(7)
    from lustrate.sources import sinks

    sinks.write_lines(rows, ["k"], tmp_path / "x" / "lines.ndjson")
    want = [json.dumps({"k": r["k"]} | ({"v": r["v"]} if r["v"] else {}), ensure_ascii=False, separators=(",", ":")) for r in sorted(rows.collect())]
    assert (tmp_path / "x" / "lines.ndjson").read_text("utf-8").split("\n") == [*want, ""] and [p.name for p in (tmp_path / "x").iterdir()] == ["lines.ndjson"]
    sinks.write_lines(rows.where("false"), ["k"], tmp_path / "none.ndjson")
    assert (tmp_path / "none.ndjson").read_bytes() == b""


@pytest.mark.parametrize("change", [{"run_id": " "}, {"policy_id": 3}, {"tokenization_enabled": "no"}, {"extra": 1}, {"digest": "md5"}])
def test_manifests_that_are_no_manifests(tmp_path, change):
    good = {"tool_version": "1", "run_id": "r", "policy_id": "p", "input_corpus_id": "c", "tokenization_enabled": False, "quarantine_copy_enabled": False, "digest": "blake3"}
    good |= {"pack_schema_version": engine.PACK, "ledger_schema_version": engine.LEDGER}
    (tmp_path / "pack_manifest.json").write_text(json.dumps(good))
    assert engine.read_manifest(tmp_path) == good
    (tmp_path / "pack_manifest.json").write_text(json.dumps(good | change))
    with pytest.raises(engine.Fatal):
        engine.read_manifest(tmp_path)


def slow(seconds):
    end = time.time() + seconds
    while time.time() < end:
        re.match("(a+)+b", "a" * 24)  # native code that no signal handler interrupts
    return seconds


def test_deadlines_end_the_work():
    with deadline.Timed(slow, 0.5) as work:
        assert work(0) == 0
        child = work.child.pid
        assert work(0) == 0 and work.child.pid == child
        began = time.time()
        with pytest.raises(deadline.TimedOut):
            work(60)
        assert time.time() - began < 1.0
        assert work(0) == 0 and work.child.pid != child
    with deadline.Timed(lambda: (_ for _ in ()).throw(ValueError("x")), 5) as work, pytest.raises(ValueError):
        work()
    with deadline.Timed(lambda: __import__("os")._exit(3), 5) as work, pytest.raises(deadline.Died):
        work()


def test_slow_file_is_refused_in_time(spark):
    """One file that takes seconds in native code costs its limit; the others pass."""
    big = b"[" + b"1," * 20_000_000 + b"1]"
    began = time.time()
    extract.Extractor(Limits(), "sha2-256").extract("JSON", big)
    assert time.time() - began > 1
    rows = [("a", "", "JSON", 1, b"1"), ("b", "", "JSON", len(big), big), ("c", "", "JSON", 1, b"2")]
    artifacts = spark.createDataFrame(rows, "artifact_id string, source_locator_hash string, artifact_type string, size_bytes long, content binary").coalesce(1)
    got = {r["artifact_id"]: r["reason"] for r in extract.extract_records(artifacts, Limits(max_processing_ms=300)).collect()}
    assert got == {"a": None, "b": "LIMIT_EXCEEDED", "c": None}


@pytest.mark.parametrize("n, ranges", [(0, 3), (1, 4), (500, 7), (500, 1)])
def test_running_totals(spark, n, ranges):
    dice = random.Random(n)
    rows = [(sha(str(i)), i, dice.choice([None, 0, 5, 10**12])) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, v long").repartition(5)
    got = {r["i"]: r["running"] for r in ordered.running_totals(df, ["k", "i"], "v", Scratch(spark, "t"), ranges=ranges).collect()}
    total, want = 0, {}
    for _, i, v in sorted(rows):
        total += v or 0
        want[i] = total
    assert got == want
    cut = ordered.batches(df, ["k", "i"], "v", 10**12, Scratch(spark, "t"))
    sizes = {r["batch"]: r["s"] for r in cut.groupBy("batch").agg(F.sum("v").alias("s")).collect()}
    assert all((s or 0) <= 2 * 10**12 for s in sizes.values()) and sorted(sizes) == sorted(set(sizes))


def test_plan_of_running_totals_has_no_single_window(spark):
    df = spark.range(1000).withColumn("v", F.col("id"))
    plan = ordered.running_totals(df, ["id"], "v", Scratch(spark, "t"))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_long_policies_through_the_engine(spark, tmp_path):
    classes = [SECRET] + [SECRET | {"class_id": f"K{i:03}", "detectors": [{"kind": "regex", "pattern": f"KEY{i:03}[0-9]"}], "action": {"kind": "MASK", "keep_last": 2}} for i in range(60)]
    code, got = pack_of(spark, tmp_path, {"a.txt": "a SECRET KEY0077 KEY060", "b.csv": "x,y\nKEY0591,SECRET\n"}, *classes)
    assert code == engine.OK and got == {"a.txt": (None, "a {{S}} *****77 KEY060"), "b.csv": (None, "x,y\n*****91,{{S}}\n")}
    assert engine.verify(spark, str(tmp_path / "pack"), str(tmp_path / "policy")) == engine.OK


def test_flags_of_the_command_line(tmp_path, capsys):
    rules, source = policy(tmp_path, SECRET), corpus(tmp_path, {"a.txt": "x"})
    base = ["run", "--input", source, "--output", f"{tmp_path}/p", "--policy", rules]
    for wrong in (["--strictness", "lax"], ["--max-workers", "0"], ["--enable-tokenization", "true"], ["--enable-tokenization", "maybe"], ["--limits-json", f"{tmp_path}/none"]):
        assert main(base + wrong) == engine.USAGE


def test_answers_of_many_items_in_order():
    """Items go to the child together; one that takes too long, raises or ends the child costs no other."""

    def work(x):
        if x == 3:
            time.sleep(30)
        if x == 5:
            os._exit(3)
        if x == 7:
            raise ValueError(x)
        return x

    with deadline.Timed(work, 0.4) as timed:
        got = list(timed.answers([(x,) for x in range(10)]))
    assert [a if done else type(a) for done, a in got] == [0, 1, 2, deadline.TimedOut, 4, deadline.Died, 6, ValueError, 8, 9]


def test_extraction_sends_parts_of_bounded_size(spark):
    """However many rows Spark puts into a batch, Python holds the records of about a megabyte at a time."""
    text = "x" * 50_000
    rows = spark.range(400).select(F.col("id").cast("string").alias("artifact_id"), F.lit("").alias("source_locator_hash"), F.lit("EML").alias("artifact_type"), F.lit(50_000).cast("long").alias("size_bytes"), F.lit(f"Subject: a\n\n{text}").cast("binary").alias("content")).coalesce(1)
    records = extract.extract_records(rows, texts=False)

    assert records.where("kind = 'json'").count() == 800
    parts = list(arrow.parts([pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array([text] * 400)], ["i", "t"])]))
    assert max(b.num_rows for b in parts) == 20 and sum(b.num_rows for b in parts) == 400
    out = list(arrow.in_batches(((i, text) for i in range(400)), [pa.int64(), pa.string()], ["i", "t"]))
    assert max(b.nbytes for b in out) < 1.2 * arrow.PART_BYTES and sum(b.num_rows for b in out) == 400
