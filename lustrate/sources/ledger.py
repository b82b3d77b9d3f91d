"""A pack's ledger: Parquet parts that commit records make visible, written by a transactional sink.

Each batch of artifacts is one transaction. Tasks write their output files and their part of every table
into a staging folder of the pack; the commit moves the files to their places and then writes one record
that names the parts. Readers see named parts only, so a task that failed, ran twice or was lost leaves
nothing to be seen, and a batch is there as a whole or not at all. The folder must be one that all
executors and the driver share.

Ledgers have a version. ``read`` gives the present tables whatever the version: columns that an older
one lacks are null, and tables that it lacks are empty.
"""

from __future__ import annotations

import json
import os
import shutil
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lustrate.sources.sinks import write_whole

V1, V2 = "lustrate.ledger.v1", "lustrate.ledger.v2"
TABLES = {
    "artifacts": "artifact_id string, source_locator_hash string, size_bytes long, artifact_type string, state string, quarantine_reason_code string, extractor_id string, coverage_hash string, output_id string",
    "findings": "artifact_id string, source_locator_hash string, class_id string, severity string, action string, locator string, token string",
    "findings_summary": "artifact_id string, source_locator_hash string, class_id string, severity string, action string, count long",
    "proof_tokens": "artifact_id string, source_locator_hash string, token_index int, token string",
}
FILES = "path string, content binary"


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


#: What the sink takes: rows of all tables and output files in one frame, told apart by ``kind``.
ROW = "kind string, " + ", ".join(dict.fromkeys(c for s in [*TABLES.values(), FILES] for c in s.split(", ")))


def rows_of(kind: str, df: DataFrame) -> DataFrame:
    """``df`` (a table or files) as rows for the sink."""
    held = set(df.columns)
    columns = [F.lit(kind).alias("kind") if c == "kind string" else (F.col(n) if (n := c.split()[0]) in held else F.lit(None)).cast(c.split()[1]).alias(n) for c in ROW.split(", ")]
    return df.select(*columns)


@dataclass
class Staged(WriterCommitMessage):
    """What one task has staged."""

    folder: str
    files: list[str]
    tables: dict[str, int]


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, pack: str, batch: int):
        self.pack, self.batch = pack, batch

    @property
    def staging(self) -> Path:
        return Path(self.pack) / ".work" / f"batch-{self.batch}"

    def write(self, iterator) -> Staged:
        from pyspark import TaskContext

        task = TaskContext.get()
        folder = self.staging / f"task-{task.partitionId()}-{task.taskAttemptId()}"
        folder.mkdir(parents=True, exist_ok=True)
        files, writers, counts = [], {}, {}
        for batch in iterator:
            table = pa.Table.from_batches([batch])
            for kind in set(table.column("kind").to_pylist()):
                part = table.filter(pc.equal(table.column("kind"), kind))
                if kind == "files":
                    for path, content in zip(part.column("path").to_pylist(), part.column("content").to_pylist()):
                        files.append(path)
                        write_whole(folder / "files" / path, content)
                    continue
                part = part.select(names(TABLES[kind]))
                if kind not in writers:
                    writers[kind] = pq.ParquetWriter(folder / f"{kind}.parquet", part.schema, compression="zstd")
                writers[kind].write_table(part)
                counts[kind] = counts.get(kind, 0) + len(part)
        for writer in writers.values():
            writer.close()
        return Staged(str(folder), files, counts)

    def commit(self, messages) -> None:
        pack, parts, counts, n_files = Path(self.pack), {k: [] for k in TABLES}, dict.fromkeys(TABLES, 0), 0
        for i, staged in enumerate(m for m in messages if m is not None):
            for path in staged.files:
                target = pack / path
                target.parent.mkdir(parents=True, exist_ok=True)
                os.replace(Path(staged.folder) / "files" / path, target)
            n_files += len(staged.files)
            for kind, n in staged.tables.items():
                name = f"{kind}/batch-{self.batch}-{i}.parquet"
                target = pack / "evidence" / "ledger" / name
                target.parent.mkdir(parents=True, exist_ok=True)
                os.replace(Path(staged.folder) / f"{kind}.parquet", target)
                parts[kind].append(name)
                counts[kind] += n
        record = {"batch": self.batch, "files": n_files, "parts": parts, "rows": counts}
        write_whole(record_path(pack, self.batch), (json.dumps(record, indent=1, sort_keys=True) + "\n").encode())
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class PackSink(DataSource):
    """``df.write.format("lustrate_pack").mode("append").option("pack", folder).option("batch", n)``."""

    @classmethod
    def name(cls) -> str:
        return "lustrate_pack"

    def writer(self, schema, overwrite):
        return BatchWriter(self.options["pack"], int(self.options["batch"]))


def commit_batch(rows: DataFrame, pack: Path, batch: int) -> None:
    """Writes rows of ``rows_of`` as one transaction."""
    rows.sparkSession.dataSource.register(PackSink)
    rows.write.format("lustrate_pack").mode("append").option("pack", str(pack.resolve())).option("batch", str(batch)).save()


def record_path(pack: Path, batch: int) -> Path:
    return pack / "evidence" / "ledger" / "_commits" / f"{batch:08}.json"


def committed(pack: Path) -> list[dict]:
    """The commit records of a pack, in order."""
    folder = pack / "evidence" / "ledger" / "_commits"
    return [json.loads(p.read_text("utf-8")) for p in sorted(folder.glob("*.json"))] if folder.is_dir() else []


def discard_staged(pack: Path) -> None:
    """Removes what runs that ended early have staged."""
    shutil.rmtree(pack / ".work", ignore_errors=True)


def read_parts(spark: SparkSession, pack: Path, kind: str) -> DataFrame:
    parts = [f"file://{(pack / 'evidence' / 'ledger').resolve()}/{p}" for record in committed(pack) for p in record["parts"].get(kind, [])]
    return spark.read.schema(TABLES[kind]).parquet(*parts) if parts else spark.createDataFrame([], TABLES[kind])


def read_v2(spark: SparkSession, pack: Path) -> dict[str, DataFrame]:
    return {kind: read_parts(spark, pack, kind) for kind in TABLES}


def read_v1(spark: SparkSession, pack: Path) -> dict[str, DataFrame]:
    """Two folders of Parquet without commit records, extractors, coverage, findings or tokens by row.
    Columns that the files lack come back as null from the present schema."""
    folder = f"file://{(pack / 'evidence' / 'ledger').resolve()}"
    found = {kind: spark.read.schema(TABLES[kind]).parquet(f"{folder}/{kind}") for kind in ("artifacts", "findings_summary")}
    return {kind: found[kind] if kind in found else spark.createDataFrame([], schema) for kind, schema in TABLES.items()}


READERS = {V1: read_v1, V2: read_v2}


def read(spark: SparkSession, pack: Path, version: str) -> dict[str, DataFrame]:
    """The present tables of a ledger of any known version; ``KeyError`` for others."""
    return READERS[version](spark, pack)


def write_meta(pack: Path, meta: dict[str, str]) -> None:
    write_whole(pack / "evidence" / "ledger" / "meta.json", (json.dumps(meta, indent=1, sort_keys=True) + "\n").encode())


def read_meta(pack: Path) -> dict[str, str]:
    return json.loads((pack / "evidence" / "ledger" / "meta.json").read_text("utf-8"))
