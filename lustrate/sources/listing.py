"""Files below a folder as rows, listed and read by tasks.

A level of folders is listed by one job, its folders by tasks side by side; the levels are as many as the
tree is deep. The driver sees no name. Links, special files, empty files and files of any size are rows
like others. The folder must be one that the driver and all executors see. Names that are not UTF-8 are
written with their odd bytes escaped in ``rel``; ``path`` holds the bytes themselves.
"""

from __future__ import annotations

import hashlib
import os
import stat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lustrate.functions.digests import Blake3
from lustrate.scratch import Scratch

LISTED = "path binary, rel string, kind string, length long"
#: Entries in a batch, bytes of contents in a batch, and bytes read at a time.
ENTRIES, BATCH, STEP = 10_000, 64 << 20, 1 << 20
#: Bytes of a file that a row may hold; of larger ones only the digest is made.
READABLE = 2_000_000_000


def kind_of(mode: int) -> str:
    for name, test in (("link", stat.S_ISLNK), ("folder", stat.S_ISDIR), ("file", stat.S_ISREG)):
        if test(mode):
            return name
    return "special"


def entries(folder: bytes, rel: str):
    """(path, rel, kind, length) of what lies in one folder; nothing is followed."""
    with os.scandir(folder) as found:
        for entry in found:
            info = entry.stat(follow_symlinks=False)
            name = entry.name.decode("utf-8", "backslashreplace")
            yield entry.path, f"{rel}/{name}" if rel else name, kind_of(info.st_mode), info.st_size


def files_below(spark: SparkSession, root: str, scratch: Scratch, label: str = "level") -> DataFrame:
    """path, rel, kind (file, link or special) and length of everything below ``root`` but folders."""

    def scan(batches):
        for batch in batches:
            held: list[tuple] = []
            for folder, rel in zip(batch.column("path").to_pylist(), batch.column("rel").to_pylist()):
                for entry in entries(folder, rel):
                    held.append(entry)
                    if len(held) == ENTRIES:
                        yield as_batch(held)
                        held = []
            yield as_batch(held)

    level, parts = spark.createDataFrame([(bytearray(os.fsencode(os.path.abspath(root))), "")], "path binary, rel string"), []
    while True:
        found = scratch.save(level.mapInArrow(scan, LISTED), f"{label}{len(parts)}")
        parts.append(found.where("kind <> 'folder'"))
        folders = found.where("kind = 'folder'")
        if not folders.head(1):
            break
        level = folders.select("path", "rel").repartition(spark.sparkContext.defaultParallelism, "rel")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    kinds = (pa.binary(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["path", "rel", "kind", "length"])


def read_file(path: bytes, method: str) -> tuple[str, int, bytes | None]:
    """Digest, size and content of a file, read once; large contents are not kept."""
    state, size, parts = Blake3() if method == "blake3" else hashlib.sha256(), 0, []
    with open(path, "rb") as f:
        while piece := f.read(STEP):
            state.update(piece)
            size += len(piece)
            if size <= READABLE:
                parts.append(piece)
            else:
                parts = []
    return state.digest().hex(), size, b"".join(parts) if size <= READABLE else None


def read_files(files: DataFrame, method: str) -> DataFrame:
    """rel, artifact_id (the content's digest), size_bytes and content of ``files`` (path, rel)."""
    names = ["rel", "artifact_id", "size_bytes", "content"]

    def read(batches):
        held, size = [], 0

        def full():
            columns = list(zip(*held)) if held else [()] * 4
            kinds = (pa.string(), pa.string(), pa.int64(), pa.large_binary())
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for path, rel in zip(batch.column("path").to_pylist(), batch.column("rel").to_pylist()):
                digest, length, content = read_file(path, method)
                if held and size + len(content or b"") > BATCH:
                    yield full()
                    held, size = [], 0
                held.append((rel, digest, length, content))
                size += len(content or b"")
        yield full()

    # Neighbours in the listing are dealt out, by about ``BATCH`` bytes for each task.
    total = files.agg(F.sum("length"), F.count("*")).first()
    tasks = max(1, min(total[1], max(files.sparkSession.sparkContext.defaultParallelism, (total[0] or 0) // BATCH)))
    return files.select("path", "rel").repartition(tasks, "rel").mapInArrow(read, "rel string, artifact_id string, size_bytes long, content binary")
