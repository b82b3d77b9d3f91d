"""Packs end to end: goldens, refusals, tampering, resume, determinism."""

import hashlib
import hmac
import io
import json
import os
import tarfile
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lustrate.__main__ import main
from lustrate.functions.digests import blake3
from lustrate.plans import engine
from lustrate.plans.policy import Limits, PolicyError, compile_policy, load_limits

SECRET = {"class_id": "S", "severity": "HIGH", "detectors": [{"kind": "regex", "pattern": "SECRET"}], "action": {"kind": "REDACT"}}


def policy(tmp, *classes):
    folder = Path(tmp) / "policy"
    folder.mkdir(exist_ok=True)
    (folder / "policy.json").write_text(json.dumps({"schema_version": "policy.v1", "classes": list(classes), "defaults": {}, "scopes": []}))
    return str(folder)


def corpus(tmp, files):
    for name, data in files.items():
        path = Path(tmp) / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data.encode() if isinstance(data, str) else data)
    return str(Path(tmp) / "in")


def zipped(entries, **kw):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def tarred(*members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data, kind in members:
            info = tarfile.TarInfo(name)
            info.type, info.size, info.linkname = kind, len(data), "x"
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def pack_of(spark, tmp, files, *classes, **options):
    code = engine.run(spark, corpus(tmp, files), f"{tmp}/pack", policy(tmp, *(classes or (SECRET,))), **options)
    rows = [json.loads(x) for x in Path(f"{tmp}/pack/evidence/artifacts.ndjson").read_text().splitlines()]
    outputs = {}
    for r in rows:
        found = list(Path(f"{tmp}/pack/sanitized").glob(f"{r['source_locator_hash']}__*"))
        outputs[r["source_locator_hash"]] = found[0].read_text() if found else None
    method = options.get("method", "sha2-256")
    h = (lambda s: blake3(s.encode()).hex()) if method == "blake3" else (lambda s: hashlib.sha256(s.encode()).hexdigest())
    by_hash = {r["source_locator_hash"]: r for r in rows}
    return code, {n: (by_hash[h(n)].get("quarantine_reason_code"), outputs[h(n)]) for n in files}


def test_types_and_reasons(spark, tmp_path):
    docx, png = {"word/document.xml": '<w a="v">SECRET &amp; x</w>'}, {"word/document.xml": "<w/>", "word/media/i.png": b"x"}
    code, got = pack_of(spark, tmp_path, {
        "a.txt": "one SECRET", "b.bin": b"\0\1", "bad.txt": b"\xff", "c.csv": "id,name\n1,SECRET\n", "ragged.csv": "a,b\n1\n", "t.tsv": "a\tb\n1\tSECRET, x\n",
        "j.json": '{"b": "SECRET", "a": 1.5}', "k.json": '{"SECRET": 1}', "n.ndjson": '{"b":2,"a":"SECRET"}\n\n[1]\n', "bad.ndjson": "{}\nx\n",
        "z.zip": zipped({"notes.txt": "SECRET inside", "in.zip": zipped({"deep.txt": "SECRET"})}), "evil.zip": zipped({"../evil.txt": "x"}), "plain.zip": "{}",
        "t.tar": tarred(("n.txt", b"SECRET", tarfile.REGTYPE)), "link.tar": tarred(("l", b"", tarfile.SYMTYPE)), "d.docx": zipped(docx), "png.docx": zipped(png),
        "m.eml": "Subject: SECRET\nTo: a@b.c\n\nbody SECRET\n", "two.mbox": "From a@b Mon Jan  1 00:00:00 2024\nSubject: x\n\nSECRET\nFrom a@b Tue Jan  2 00:00:00 2024\nSubject: y\n\n>From z\n",
        "bad.mbox": "From a@b Mon Jan  1 00:00:00 2024\nSubject: x\n\nFrom here on\n", "latin.zip": zipped({"a.txt": b"\xff"}),
        "octet.eml": "Subject: x\nContent-Type: application/octet-stream\n\nx\n", "empty.txt": "",
    })
    assert code == engine.QUARANTINED
    reasons = {n: r for n, (r, _) in got.items()}
    assert {n for n, r in reasons.items() if r is None} == {"a.txt", "c.csv", "t.tsv", "j.json", "n.ndjson", "z.zip", "t.tar", "d.docx", "m.eml", "two.mbox", "empty.txt"}
    assert {n: r for n, r in reasons.items() if r} == {
        "b.bin": "UNSUPPORTED_FORMAT", "bad.txt": "PARSE_ERROR", "ragged.csv": "PARSE_ERROR", "k.json": "VERIFICATION_FAILED", "bad.ndjson": "PARSE_ERROR", "evil.zip": "UNSAFE_PATH",
        "plain.zip": "PARSE_ERROR", "link.tar": "UNSAFE_PATH", "png.docx": "UNKNOWN_COVERAGE", "bad.mbox": "PARSE_ERROR", "latin.zip": "UNSUPPORTED_FORMAT", "octet.eml": "UNSUPPORTED_FORMAT",
    }
    assert got["a.txt"][1] == "one {{S}}" and got["c.csv"][1] == "id,name\n1,{{S}}\n" and got["t.tsv"][1] == 'a\tb\n1\t{{S}}, x\n'
    assert got["j.json"][1] == '{"a":1.5,"b":"{{S}}"}' and got["n.ndjson"][1] == '{"a":"{{S}}","b":2}\n[1]\n'
    zip_rows = [json.loads(x) for x in got["z.zip"][1].splitlines()]
    assert [(r["archive_depth"], r["text"], "container_path_hash" in r) for r in zip_rows] == [(2, "{{S}}", True), (1, "{{S}} inside", False)]
    assert json.loads(got["d.docx"][1])["text"] == "v\n{{S}} & x\n"
    assert [r.get("message_index") for r in map(json.loads, got["two.mbox"][1].splitlines())] == [0, 0, 1, 1]
    assert json.loads(got["m.eml"][1].splitlines()[0]) == {"header_index": 0, "key": "Subject", "value": "{{S}}"}
    everything = "".join(p.read_text(errors="ignore") for p in Path(f"{tmp_path}/pack").rglob("*") if p.is_file() and p.suffix != ".parquet" and not p.name.endswith(".crc"))
    assert "SECRET" not in everything


def test_golden_archive_hash(spark, tmp_path):
    code, got = pack_of(spark, tmp_path, {"sample.zip": zipped({"notes.txt": "SECRET inside zip"})}, method="blake3")
    record = json.loads(got["sample.zip"][1])
    assert code == engine.OK and record["entry_path_hash"] == blake3(b"notes.txt").hex() and record["entry_path_hash"].startswith("a859c119")


def test_selected_csv_column(spark, tmp_path):
    email = {"class_id": "PII.Email", "severity": "HIGH", "action": {"kind": "REDACT"}, "detectors": [{"kind": "regex", "pattern": "[a-z]+@[a-z.]+"}, {"kind": "field_selector", "selector": "csv_header", "fields": ["email"]}]}
    _, got = pack_of(spark, tmp_path, {"c.csv": "name,email,notes\nA,a@b.com,see a@b.com\n"}, email)
    assert got["c.csv"] == (None, "name,email,notes\nA,{{PII.Email}},see a@b.com\n")


def test_short_mask_and_limits(spark, tmp_path):
    mask = {"class_id": "M", "severity": "LOW", "detectors": [{"kind": "regex", "pattern": "1234"}], "action": {"kind": "MASK", "keep_last": 4}}
    _, got = pack_of(spark, tmp_path, {"a.txt": "card=1234", "b.txt": "x" * 100}, mask, limits=Limits(max_bytes_per_artifact=50))
    assert {n: r for n, (r, _) in got.items()} == {"a.txt": "VERIFICATION_FAILED", "b.txt": "LIMIT_EXCEEDED"}


@pytest.mark.parametrize("limits", [Limits(max_entries_per_archive=1), Limits(max_expansion_ratio=1), Limits(max_expanded_bytes_per_archive=10), Limits(max_nested_archive_depth=1)])
def test_archive_limits(spark, tmp_path, limits):
    _, got = pack_of(spark, tmp_path, {"a.zip": zipped({"a.txt": "A" * 20_000, "b.zip": zipped({"c.txt": "x"})})}, limits=limits)
    assert got["a.zip"][0] == "LIMIT_EXCEEDED"


def test_verify_tamper_and_rerun(spark, tmp_path):
    files = {"a.txt": "SECRET a", "b.json": '{"x":"SECRET"}', "same1.txt": "twin", "same2.txt": "twin", "raw.bin": b"\0"}
    code, _ = pack_of(spark, tmp_path, files, quarantine_copy=True)
    pack, rules = f"{tmp_path}/pack", f"{tmp_path}/policy"
    assert code == engine.QUARANTINED and engine.verify(spark, pack, rules) == engine.OK
    assert [p.read_bytes() for p in Path(f"{pack}/quarantine/raw").iterdir()] == [b"\0"]
    assert engine.run(spark, f"{tmp_path}/in", pack, rules) == engine.USAGE  # finished packs are not written again
    assert engine.run(spark, f"{tmp_path}/in", f"{tmp_path}/again", rules, quarantine_copy=True) == code
    names = ["evidence/artifacts.ndjson", "evidence/run_manifest.json", "pack_manifest.json", "quarantine/index.ndjson"]
    assert all(Path(f"{pack}/{n}").read_bytes() == Path(f"{tmp_path}/again/{n}").read_bytes() for n in names)
    target = next(Path(f"{pack}/sanitized").glob("*.json"))
    good = target.read_bytes()
    target.write_bytes(good + b" ")
    assert engine.verify(spark, pack, rules) == engine.QUARANTINED
    target.write_bytes(good)
    (Path(pack) / "sanitized" / "extra.txt").write_text("x")
    assert engine.verify(spark, pack, rules) == engine.QUARANTINED
    os.remove(f"{pack}/sanitized/extra.txt")
    evidence = Path(f"{pack}/evidence/artifacts.ndjson")
    evidence.write_text("\n".join(evidence.read_text().splitlines()[1:]) + "\n")
    assert engine.verify(spark, pack, rules) == engine.FATAL
    engine.export_sqlite(spark, pack, f"{tmp_path}/ledger.db")


def test_resume_of_the_same_run_only(spark, tmp_path):
    rules, source = policy(tmp_path, SECRET), corpus(tmp_path, {"a.txt": "SECRET"})
    (tmp_path / "pack").mkdir()
    (tmp_path / "pack" / ".run").write_text("another run")
    assert engine.run(spark, source, f"{tmp_path}/pack", rules) == engine.FATAL
    os.symlink(f"{source}/a.txt", f"{source}/l.txt")
    assert engine.run(spark, source, f"{tmp_path}/other", rules) == engine.FATAL


@pytest.mark.parametrize("change", [
    {"schema_version": "x"}, {"defaults": {"severity": "LOW"}}, {"scopes": [1]}, {"classes": []}, {"extra": 1}, {"classes": [SECRET, SECRET]},
    {"classes": [SECRET | {"action": {"kind": "TOKENIZE"}}]}, {"classes": [SECRET | {"action": {"kind": "MASK", "keep_last": 0}}]}, {"classes": [SECRET | {"class_id": " "}]},
    {"classes": [SECRET | {"detectors": [{"kind": "field_selector", "selector": "csv_header", "fields": ["a"]}]}]}, {"classes": [SECRET | {"severity": "X"}]},
])
def test_bad_policies(change):
    with pytest.raises(PolicyError):
        compile_policy({"schema_version": "policy.v1", "classes": [SECRET], "defaults": {}, "scopes": []} | change)


def test_limits_of_work_folder_and_time(spark, tmp_path):
    _, got = pack_of(spark, tmp_path / "a", {"a.txt": "y" * 1024, "b.txt": "y" * 199}, limits=Limits(max_workdir_bytes=200))
    assert sorted(r or "" for r, _ in got.values()) == ["", "LIMIT_EXCEEDED"]
    _, got = pack_of(spark, tmp_path / "b", {"a.zip": zipped({f"{i}.txt": "y" * 50_000 for i in range(200)})}, limits=Limits(max_processing_ms=1, max_expansion_ratio=10_000))
    assert [r for r, _ in got.values()] == ["LIMIT_EXCEEDED"]


def test_large_cells_and_numbers_without_bounds(spark, tmp_path):
    _, got = pack_of(spark, tmp_path, {"big.csv": "a,b\n1," + "z" * 200_000 + "\n", "inf.json": '{"a": 1e400}'})
    assert sorted(r or "" for r, _ in got.values()) == ["", "PARSE_ERROR"]


def test_posix_names_are_rewritten(spark, tmp_path):
    letters = SECRET | {"detectors": [{"kind": "regex", "pattern": "SECRET [[:alpha:]]+"}]}
    _, got = pack_of(spark, tmp_path, {"a.txt": "SECRET Xyz"}, letters)
    assert [t for _, t in got.values()] == ["{{S}}"]


def test_proof_key_is_not_in_the_pack(spark, tmp_path):
    """Neither the ids of the manifest nor a plain digest gives a token."""
    rules, source = policy(tmp_path, SECRET), corpus(tmp_path, {"a.txt": "SECRET"})
    assert engine.run(spark, source, f"{tmp_path}/pack", rules) == engine.OK
    manifest = json.loads(Path(f"{tmp_path}/pack/evidence/run_manifest.json").read_text())
    (token,) = json.loads(Path(f"{tmp_path}/pack/evidence/artifacts.ndjson").read_text())["proof_tokens"]
    run_id, corpus_id = bytes.fromhex(manifest["run_id"]), bytes.fromhex(manifest["input_corpus_id"])
    guess = hashlib.sha256(b"lustrate.proof.key" + run_id + corpus_id)
    assert token not in {hashlib.sha256(guess.hexdigest().encode() + b"SECRET").hexdigest(), hmac.new(guess.digest(), b"SECRET", hashlib.sha256).hexdigest()}
    # A holder of the files can make the key again.
    root = hashlib.sha256(engine.SECRET + hashlib.sha256(engine.SECRET + b"SECRET").digest()).digest()
    key = hashlib.sha256(b"lustrate.proof.key" + run_id + root).digest()
    assert token == hmac.new(key, b"SECRET", hashlib.sha256).hexdigest()
    assert manifest["proof_key_commitment"] == hashlib.sha256(b"lustrate.proof.commitment" + key).hexdigest()


def test_bad_patterns_are_wrong_use(spark, tmp_path):
    for i, bad in enumerate(("(", "a**", "x*", "[[:nope:]]")):
        (tmp_path / str(i)).mkdir()
        rules = policy(tmp_path / str(i), SECRET | {"detectors": [{"kind": "regex", "pattern": bad}]})
        assert main(["lint", "--policy", rules]) == engine.USAGE


def test_limits_file(tmp_path):
    (tmp_path / "l.json").write_text('{"schema_version": "limits.v1", "archive": {"max_entries_per_archive": 0}}')
    assert load_limits(tmp_path / "l.json").max_entries_per_archive == 0
    (tmp_path / "l.json").write_text('{"schema_version": "limits.v1", "artifact": {"max_bytes_per_artifact": 0}}')
    with pytest.raises(PolicyError):
        load_limits(tmp_path / "l.json")


def test_policy_id_and_command_line(tmp_path, capsys):
    rules = policy(tmp_path, SECRET)
    assert main(["lint", "--policy", rules]) == 0
    first = capsys.readouterr().out
    (Path(rules) / "note.md").write_text("x")
    assert main(["lint", "--policy", rules]) == 0 and capsys.readouterr().out != first
    assert main(["lint", "--policy", f"{tmp_path}/none"]) == engine.USAGE
    assert main(["run", "--inptu", "SECRET"]) == engine.USAGE and "SECRET" not in capsys.readouterr().err


def test_random_bytes_never_raise(spark, tmp_path):
    import random

    rng = random.Random(5)
    kinds = "txt csv tsv json ndjson zip tar eml mbox docx pptx xlsx".split()
    files = {f"{k}{i}.{k}": rng.randbytes(rng.randrange(2000)) for k in kinds for i in range(6)}
    _, got = pack_of(spark, tmp_path, files)
    assert "INTERNAL_ERROR" not in {r for r, _ in got.values()}


def test_streaming(spark, tmp_path):
    from lustrate.streaming.ingest import watch

    source = corpus(tmp_path, {"a.txt": "SECRET", "b.bin": b"x"})
    rules = compile_policy({"schema_version": "policy.v1", "classes": [SECRET], "defaults": {}, "scopes": []})
    for _ in range(2):
        watch(spark, source, rules, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(r["state"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["QUARANTINED", "VERIFIED"]


def test_streaming_of_equal_files_in_two_folders(spark, tmp_path):
    from lustrate.functions.digests import digest
    from lustrate.streaming.ingest import watch

    source = corpus(tmp_path, {"x.txt": "SECRET"})
    for folder in ("a", "b"):
        (Path(source) / folder).mkdir()
        (Path(source) / folder / "x.txt").write_text("say SECRET once")
        (Path(source) / folder / "t.csv").write_text("k,v\n1,SECRET\n")
    rules = compile_policy({"schema_version": "policy.v1", "classes": [SECRET], "defaults": {}, "scopes": []})
    watch(spark, source, rules, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    states = spark.read.parquet(f"{tmp_path}/out")
    got = {(r["rel"], r["state"]) for r in states.collect()}
    assert states.count() == 5 and got == {(p, "VERIFIED") for p in ("x.txt", "a/x.txt", "b/x.txt", "a/t.csv", "b/t.csv")}
    assert states.where(digest(F.col("rel"), "sha2-256") == F.col("source_locator_hash")).count() == 5
    assert {r["output"].count("say") for r in states.where("rel LIKE '%/x.txt'").collect()} == {1}


def test_corpus_id_is_folded_without_a_list(spark, sf_dir, monkeypatch):
    """The digest piece by piece is the digest of the whole, and no row of the plan lists the corpus."""
    import hashlib

    from lustrate.functions.digests import fold
    from lustrate.plans.text_queries import corpus_id_fold

    for n in (0, 1, 31, 32, 33, 64, 65, 97, 200):
        ids = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
        assert fold(iter(ids), "blake3") == (blake3(b"".join(ids)), n)
        assert fold(iter(ids)) == (hashlib.sha256(b"".join(ids)).digest(), n)
    assert fold([b"a", None]) == (hashlib.sha256(b"a").digest(), 2)

    def refuse(*columns):
        raise AssertionError("a list of the whole corpus")

    monkeypatch.setattr(F, "collect_list", refuse)
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    ids = sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    assert [tuple(r) for r in corpus_id_fold(spark, sf_dir).collect()] == [(hashlib.sha256("".join(ids).encode()).hexdigest(), len(ids))]
