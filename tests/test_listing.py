"""Listing and reading by tasks: trees, links, empty and large files, odd names."""

import hashlib
import os

import pytest

from lustrate.functions.digests import blake3
from lustrate.scratch import Scratch
from lustrate.sources import inventory, listing


def test_every_file_is_a_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(os, "walk", None)
    files = {f"d{i % 4}/e{i % 3}/f{i}.txt": b"x" * i for i in range(40)} | {"top.csv": b"a", "empty.json": b"", "deep/" + "n/" * 12 + "z.txt": b"z", "ü ñ/日本.txt": b"u"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "void").mkdir()
    for method, hashed in (("sha2-256", lambda b: hashlib.sha256(b).hexdigest()), ("blake3", lambda b: blake3(b).hex())):
        rows = inventory.read_corpus(spark, str(tmp_path), method).collect()
        assert {r["rel"]: (r["artifact_id"], r["source_locator_hash"], r["size_bytes"], bytes(r["content"])) for r in rows} == {n: (hashed(d), hashed(n.encode()), len(d), d) for n, d in files.items()}
        assert len(rows) == len(files)
    assert inventory.read_corpus(spark, f"file://{tmp_path}").count() == len(files)
    assert inventory.read_corpus(spark, str(tmp_path / "void")).count() == 0


def test_links_and_special_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("x")
    os.symlink(tmp_path / "a", tmp_path / "l")
    os.mkfifo(tmp_path / "a" / "pipe")
    kinds = {r["rel"]: r["kind"] for r in listing.files_below(spark, str(tmp_path), Scratch(spark, "t")).collect()}
    assert kinds == {"a/x.txt": "file", "l": "link", "a/pipe": "special"}
    with pytest.raises(inventory.UnsafeInput):
        inventory.read_corpus(spark, str(tmp_path))


def test_names_that_are_no_text(spark, tmp_path):
    with open(os.fsencode(tmp_path) + b"/b\xff.txt", "wb") as f:
        f.write(b"data")
    (row,) = inventory.read_corpus(spark, str(tmp_path)).collect()
    assert row["rel"] == "b\\xff.txt" and bytes(row["content"]) == b"data" and row["artifact_type"] == "TEXT"


def test_large_files_are_hashed_and_not_held(tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "READABLE", 10)
    monkeypatch.setattr(listing, "STEP", 4)
    for n in (0, 3, 4, 9, 10, 11, 50):
        (tmp_path / "f").write_bytes(b"q" * n)
        for method, hashed in (("sha2-256", hashlib.sha256(b"q" * n).hexdigest()), ("blake3", blake3(b"q" * n).hex())):
            assert listing.read_file(os.fsencode(tmp_path / "f"), method) == (hashed, n, b"q" * n if n <= 10 else None)
