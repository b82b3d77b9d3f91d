"""Writers of a pack: output files, ordered NDJSON, manifests."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_whole(path: Path, data: bytes) -> None:
    """A file appears with all its bytes or not at all; equal bytes are left alone."""
    if path.exists() and path.read_bytes() == data:
        return
    path.parent.mkdir(parents=True, exist_ok=True)
    staged = path.with_name(f".{path.name}.{os.getpid()}.tmp")
    with open(staged, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(staged, path)


def write_lines(rows: DataFrame, order: list[str], path: Path) -> None:
    """JSON lines of ``rows`` in order, as one file. Tasks write the ranges of the order side by side into a
    folder that the driver shares; the driver appends these files to each other and sees no row."""
    lines = rows.select(*[F.col(c).alias(f"_{c}") for c in order], F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "true"}).alias("_line"))
    keys = [f"_{c}" for c in order]
    ordered = lines.repartitionByRange(rows.sparkSession.sparkContext.defaultParallelism, *keys).sortWithinPartitions(*keys).select("_line")
    folder = path.parent / f".{path.name}.{uuid.uuid4().hex}"
    folder.mkdir(parents=True, exist_ok=True)
    place = str(folder.resolve())

    def write(batches):
        task = TaskContext.get()
        name = f"{task.partitionId():08}-{task.taskAttemptId()}"
        with open(f"{place}/{name}", "wb") as f:
            for batch in batches:
                f.writelines(line.encode("utf-8") + b"\n" for line in batch.column("_line").to_pylist())
            f.flush()
            os.fsync(f.fileno())
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.string())], ["name"])

    # One name for each task that counts; files of tasks that ran twice or failed are not among them.
    names = sorted(r["name"] for r in ordered.mapInArrow(write, "name string").collect())
    staged = path.with_name(f".{path.name}.tmp")
    with open(staged, "wb") as out:
        for name in names:
            with open(folder / name, "rb") as part:
                shutil.copyfileobj(part, out, 1 << 20)
        out.flush()
        os.fsync(out.fileno())
    os.replace(staged, path)
    shutil.rmtree(folder, ignore_errors=True)


def write_json(path: Path, value: dict) -> None:
    write_whole(path, (json.dumps(value, indent=2, sort_keys=True) + "\n").encode())
