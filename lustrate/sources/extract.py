"""Extraction: files to records, one function for each type, run side by side in Arrow batches.

A record is (kind, text): ``text`` for plain text, ``csv`` (JSON of headers and rows) and ``json`` (one
canonical value). Anything a type's rules don't allow ends in a reason, never in an exception, so one
bad file can't fail a job; one bad entry quarantines its whole container.
"""

from __future__ import annotations

import csv
import email
import email.policy
import io
import json
import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustrate.functions import arrow
from lustrate.functions.digests import blake3
from lustrate.plans.policy import Limits
from lustrate.sources.deadline import Timed, TimedOut

SCHEMA = "artifact_id string, source_locator_hash string, artifact_type string, record_index long, kind string, record string, reason string, coverage string"
ZIP_END, ZIP_ENTRY, ZIP_HEAD = (struct.Struct(f"<{x}") for x in ("HHHHIIH", "HHHHIIIIHHHHHII", "HHHIIIIHH"))
TAR_END = bytes(512)
# After the name: mode, owner, group, size, time, sum, type of a plain file, no link, magic, names, device, no prefix.
TAR_REST = re.compile(rb"(?:[0-7]{7}[ \0]){3}([0-7]{11})[ \0][0-7]{11}[ \0]([0-7]{6})\0 0\0{100}ustar\x0000.{64}(?:[0-7]{7}\0|\0{8}){2}\0{167}", re.S)
#: Letters of all records of a file: a letter takes four bytes at most, and a row holds less than 2 GB.
ROW_LETTERS = 480_000_000
TYPES = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
SURFACES = ("content_text", "structured_fields", "metadata", "embedded_objects", "attachments")


class Refused(Exception):
    """A file that can't be extracted, with its reason code."""


def coverage(**full: str) -> str:
    return "|".join(f"{s}={full.get(s, 'NONE')}" for s in SURFACES)


# What each family of types covers.
COVERAGE = (
    {"TEXT": coverage(content_text="FULL"), "JSON": coverage(structured_fields="FULL"), "NDJSON": coverage(structured_fields="FULL"), "CSV": coverage(structured_fields="FULL"), "TSV": coverage(structured_fields="FULL")}
    | dict.fromkeys(("ZIP", "TAR"), coverage(content_text="FULL", embedded_objects="FULL"))
    | dict.fromkeys(("EML", "MBOX"), coverage(content_text="FULL", metadata="FULL", attachments="FULL"))
    | dict.fromkeys(("DOCX", "PPTX", "XLSX"), coverage(content_text="FULL", metadata="FULL", embedded_objects="FULL"))
)
UNKNOWN_OOXML = coverage(content_text="FULL", metadata="FULL", embedded_objects="UNKNOWN")


def utf8(data: bytes, reason: str = "PARSE_ERROR") -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise Refused(reason) from e


CANONICAL = json.JSONEncoder(sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def canonical(value) -> str:
    return CANONICAL.encode(value)


def parse_json(text: str):
    def refuse(constant):
        raise ValueError(constant)

    try:
        value = json.loads(text, parse_constant=refuse)
        canonical(value).encode("utf-8")  # lone surrogates and numbers without bounds don't pass
        return value
    except (ValueError, RecursionError) as e:
        raise Refused("PARSE_ERROR") from e


def parse_csv(text: str, delimiter: str) -> dict:
    try:
        rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, strict=True) if r]
    except csv.Error as e:
        raise Refused("PARSE_ERROR") from e
    if not rows or any(len(r) != len(rows[0]) for r in rows):
        raise Refused("PARSE_ERROR")
    return {"headers": rows[0], "records": rows[1:]}


def write_csv(table: dict, delimiter: str) -> str:
    out = io.StringIO()
    csv.writer(out, delimiter=delimiter, lineterminator="\n", quoting=csv.QUOTE_MINIMAL).writerows([table["headers"], *table["records"]])
    return out.getvalue()


#: Names that are safe paths already: no part begins with a dot, and none holds a colon or a backslash.
PLAIN_PATH = re.compile(r"[A-Za-z0-9_-][A-Za-z0-9_.-]*(?:/[A-Za-z0-9_-][A-Za-z0-9_.-]*)*")


def byte_sum(head: bytes) -> int:
    """Sum of the bytes of a block of 512; the low half of an Adler sum is exact for 256 of them."""
    return (zlib.adler32(head[:256]) & 0xFFFF) + (zlib.adler32(head[256:]) & 0xFFFF) - 2


def entry_path(name: str) -> str:
    """A safe relative path of an archive's entry."""
    if PLAIN_PATH.fullmatch(name):
        return name
    path = name.replace("\\", "/")
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if "\0" in path or path.startswith("/") or re.match("[A-Za-z]:", path) or ".." in parts or not parts:
        raise Refused("UNSAFE_PATH")
    return "/".join(parts)


def read_bounded(stream, room: int) -> bytes:
    """Up to ``room`` bytes in steps; more than that is over the limit."""
    parts, size = [], 0
    while chunk := stream.read(1 << 16):
        size += len(chunk)
        if size > room:
            raise Refused("LIMIT_EXCEEDED")
        parts.append(chunk)
    return b"".join(parts)


class Totals:
    """Entries, compressed and expanded bytes of one archive against the limits."""

    def __init__(self, limits: Limits):
        self.limits, self.entries, self.packed, self.expanded = limits, 0, 0, 0

    def add(self, entries: int = 0, packed: int = 0, expanded: int = 0) -> None:
        self.entries, self.packed, self.expanded = self.entries + entries, self.packed + packed, self.expanded + expanded
        over = self.entries > self.limits.max_entries_per_archive or self.expanded > self.limits.max_expanded_bytes_per_archive
        if over or self.expanded > self.packed * self.limits.max_expansion_ratio:
            raise Refused("LIMIT_EXCEEDED")

    @property
    def room(self) -> int:
        return self.limits.max_expanded_bytes_per_archive - self.expanded


def plain_zip(data: bytes) -> list[tuple] | None:
    """(name, mode, method, CRC, packed size, size, start) of each file of an ordinary zip archive; None
    where anything is out of the ordinary and the library has to judge it."""
    end = len(data) - 22
    if end < 0 or data[end : end + 4] != b"PK\5\6":
        return None
    disk, first, here, count, size, at, comment = ZIP_END.unpack_from(data, end + 4)
    if disk or first or here != count or comment or at + size != end:
        return None
    found, last = [], 0
    for _ in range(count):
        if at + 46 > end or data[at : at + 4] != b"PK\1\2":
            return None
        made, version, flags, method, _, crc, packed, full, n, extra, note, disk, _, mode, start = ZIP_ENTRY.unpack_from(data, at + 4)
        name = data[at + 46 : at + 46 + n]
        at += 46 + n
        body = start + 30 + n
        # Entries lie one after the other, each behind a head of its own that names it.
        if extra or note or disk or flags & ~0x800 or method not in (0, 8) or version > 45 or len(name) != n or start != last or body + packed > end - size or data[start : start + 4] != b"PK\3\4":
            return None
        _, theirs, same, _, crc_there, packed_there, full_there, n_there, extra = ZIP_HEAD.unpack_from(data, start + 4)
        if (theirs, same, crc_there, packed_there, full_there, n_there, extra) != (flags, method, crc, packed, full, n, 0) or data[start + 30 : body] != name or (method == 0 and packed != full):
            return None
        if not name.isascii() or b"\0" in name:
            return None
        last = body + packed
        if not name.endswith(b"/"):
            found.append((name.decode("ascii"), mode >> 16, method, crc, packed, full, body))
    return found if at == end and last == end - size else None


def plain_tar(data: bytes) -> list[tuple[str, int, int]] | None:
    """(name, size, start) of each member of a tar archive of plain files only; None where the library has
    to judge it (other types of members, names in parts, long or odd numbers, ends cut short)."""
    found, at = [], 0
    while at + 512 <= len(data):
        head = data[at : at + 512]
        if head == TAR_END:
            return found
        name, rest = head[:100].rstrip(b"\0"), TAR_REST.fullmatch(head, 100)
        # The sum counts its own eight bytes as blanks.
        if rest is None or int(rest[2], 8) != byte_sum(head) - sum(head[148:156]) + 256 or not name.isascii() or b"\0" in name:
            return None
        size = int(rest[1], 8)
        if name.endswith(b"/") or at + 512 + size > len(data):
            return None
        found.append((name.decode("ascii"), size, at + 512))
        at += 512 + -(-size // 512) * 512
    return None


class Extractor:
    def __init__(self, limits: Limits, method: str):
        self.limits = limits
        self.hash: Callable[[str], str] = (lambda s: blake3(s.encode()).hex()) if method == "blake3" else (lambda s: sha256(s.encode()).hexdigest())

    def entries_of_zip(self, data: bytes) -> Iterator[tuple[str, bytes]]:
        """Paths and contents in order of the paths; ordinary archives are read without the library's objects."""
        done, files = 0, plain_zip(data)
        if files is not None:
            totals = Totals(self.limits)
            totals.add(entries=len(files))
            if any(mode & 0o170000 == 0o120000 for _, mode, *_ in files):
                raise Refused("UNSAFE_PATH")
            for path, (_, _, method, crc, packed, full, start) in sorted(((entry_path(f[0]), f) for f in files), key=lambda x: x[0].encode()):
                content = data[start : start + packed]
                if full > totals.room:
                    break
                if method == 8:
                    inflate = zlib.decompressobj(-15)
                    try:
                        content = inflate.decompress(content, full + 1)
                    except zlib.error:
                        break
                    if not inflate.eof or inflate.unused_data:
                        break
                if len(content) != full or zlib.crc32(content) != crc:
                    break
                totals.add(packed=packed, expanded=full)
                yield path, content
                done += 1
            else:
                return
        # What follows an odd entry is judged by the library; it comes to the same entries before that one.
        yield from islice(self.library_zip(data), done, None)

    def library_zip(self, data: bytes) -> Iterator[tuple[str, bytes]]:
        totals = Totals(self.limits)
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                files = [i for i in z.infolist() if not i.is_dir()]
                totals.add(entries=len(files))
                if any(i.flag_bits & 1 for i in files):
                    raise Refused("ENCRYPTED")
                if any((i.external_attr >> 16) & 0o170000 == 0o120000 for i in files):
                    raise Refused("UNSAFE_PATH")
                for path, info in sorted(((entry_path(i.orig_filename), i) for i in files), key=lambda x: x[0].encode()):
                    with z.open(info) as stream:
                        content = read_bounded(stream, totals.room)
                    totals.add(packed=info.compress_size, expanded=len(content))
                    yield path, content
        except NotImplementedError as e:
            raise Refused("UNSUPPORTED_FORMAT") from e
        except (zipfile.BadZipFile, OSError, EOFError, ValueError, RuntimeError) as e:
            raise Refused("PARSE_ERROR") from e

    def entries_of_tar(self, data: bytes) -> Iterator[tuple[str, bytes]]:
        totals, found, plain = Totals(self.limits), [], plain_tar(data)
        if plain is not None:
            for name, size, start in plain:
                path = entry_path(name)
                totals.add(entries=1, packed=size, expanded=size)
                found.append((path, data[start : start + size]))
            yield from sorted(found, key=lambda x: x[0].encode())
            return
        try:
            with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as t:
                for member in t:
                    if member.isdir():
                        continue
                    if not member.isreg():
                        raise Refused("UNSAFE_PATH")
                    path = entry_path(member.name)
                    totals.add(entries=1, packed=member.size, expanded=member.size)
                    found.append((path, t.extractfile(member).read()))
        except (tarfile.TarError, OSError, EOFError, ValueError) as e:
            raise Refused("PARSE_ERROR") from e
        yield from sorted(found, key=lambda x: x[0].encode())

    def archive(self, data: bytes, kind: str, depth: int = 1, parent: str | None = None) -> Iterator[dict]:
        """Records of an archive's entries; archives inside it follow in the place of their entry."""
        if depth > self.limits.max_nested_archive_depth:
            raise Refused("LIMIT_EXCEEDED")
        for path, content in self.entries_of_zip(data) if kind == "zip" else self.entries_of_tar(data):
            inner = path.lower().rpartition(".")[2]
            if inner in ("zip", "tar"):
                yield from self.archive(content, inner, depth + 1, path)
                continue
            where = {"container_path_hash": self.hash(parent)} if parent is not None else {}
            yield {"archive_depth": depth, "entry_path_hash": self.hash(path), "text": utf8(content, "UNSUPPORTED_FORMAT")} | where

    def mail(self, data: bytes, index: int | None = None) -> Iterator[dict]:
        """Top-level headers, then text bodies and attachments of one message."""
        message = email.message_from_bytes(data, policy=email.policy.compat32)
        number = {} if index is None else {"message_index": index}
        if not message.items():
            raise Refused("PARSE_ERROR")
        for i, (key, value) in enumerate(message.items()):
            shown = str(email.header.make_header(email.header.decode_header(str(value))))
            yield number | {"header_index": i, "key": key, "value": shown}
        bodies = attachments = 0
        for part in message.walk():
            if part.is_multipart():
                continue
            name = part.get_filename()
            raw = part.get_payload(decode=True) or b""
            if len(raw) > self.limits.max_bytes_per_artifact:
                raise Refused("LIMIT_EXCEEDED")
            if part.get_content_disposition() != "attachment" and name is None and part.get_content_maintype() == "text":
                yield number | {"body_index": bodies, "text": self.charset(part, raw)}
                bodies += 1
                continue
            locator = f"eml/attach/{attachments}" if index is None else f"mbox/{index}/attach/{attachments}"
            base = number | {"attachment_index": attachments, "attachment_locator_hash": self.hash(locator)}
            base |= {"filename_hash": self.hash(name)} if name else {}
            attachments += 1
            kind = {"application/zip": "zip", "application/x-zip-compressed": "zip", "application/x-tar": "tar"}.get(part.get_content_type())
            kind = kind or ((name or "").lower().rpartition(".")[2] if (name or "").lower().endswith((".zip", ".tar")) else None)
            if kind:
                for record in self.archive(raw, kind):
                    yield base | record
            elif part.get_content_maintype() == "text":
                yield base | {"text": self.charset(part, raw)}
            else:
                raise Refused("UNSUPPORTED_FORMAT")

    @staticmethod
    def charset(part, raw: bytes) -> str:
        try:
            return raw.decode(part.get_content_charset() or "utf-8")
        except (LookupError, UnicodeDecodeError) as e:
            raise Refused("PARSE_ERROR") from e

    def mbox(self, data: bytes) -> Iterator[dict]:
        for i, message in enumerate(split_mbox(data)):
            yield from self.mail(message, i)

    def office(self, data: bytes) -> tuple[list[dict], bool]:
        """Text records of the XML parts, and whether every part was XML."""
        records, whole = [], True
        for path, content in self.entries_of_zip(data):
            if not path.lower().endswith((".xml", ".rels")):
                whole = False
            elif text := xml_text(utf8(content)):
                records.append({"part_path_hash": self.hash(path), "text": text})
        return records, whole

    def extract(self, kind: str, data: bytes) -> tuple[list[tuple[str, str]], str]:
        covered = COVERAGE[kind]
        if kind == "TEXT":
            return [("text", utf8(data))], covered
        if kind in ("CSV", "TSV"):
            return [("csv", canonical(parse_csv(utf8(data), "," if kind == "CSV" else "\t")))], covered
        if kind == "JSON":
            return [("json", canonical(parse_json(utf8(data))))], covered
        if kind == "NDJSON":
            return [("json", canonical(parse_json(x))) for line in utf8(data).split("\n") if (x := line.strip())], covered
        if kind in ("DOCX", "PPTX", "XLSX"):
            records, whole = self.office(data)
            covered = covered if whole else UNKNOWN_OOXML
        else:
            records = {"ZIP": lambda: self.archive(data, "zip"), "TAR": lambda: self.archive(data, "tar"), "EML": lambda: self.mail(data), "MBOX": lambda: self.mbox(data)}[kind]()
        return [("json", canonical(r)) for r in records], covered


# The grammar of a mailbox separator.
DAY, MONTH = "Mon|Tue|Wed|Thu|Fri|Sat|Sun", "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
MBOX_SEPARATOR = rf"From [!-~]+ ({DAY}) ({MONTH}) ( ?[1-9]|[12][0-9]|3[01]) ([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?( [+-][0-9]{{4}})? [0-9]{{4}}( [+-][0-9]{{4}})?"


def split_mbox(data: bytes) -> list[bytes]:
    """Messages between separators; a line that starts like one but isn't fails the file."""
    messages: list[list[bytes]] = []
    for line in data.splitlines(keepends=True):
        if line.startswith(b"From "):
            if not re.fullmatch(MBOX_SEPARATOR, line.rstrip(b"\r\n").decode("latin-1")):
                raise Refused("PARSE_ERROR")
            messages.append([])
        elif messages:
            messages[-1].append(line)
        else:
            messages.append([line])
    return [b"".join(m) for m in messages]


ENTITY = re.compile(r"&(?:#x([0-9A-Fa-f]+)|#([0-9]+)|(amp|lt|gt|quot|apos));")
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
# Comments and character data may lack their end; then they take the rest of the text.
XML_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<(?P<tag>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<text>[^<]+)", re.S)
XML_VALUE = re.compile(r"=\s*(?:\"([^\"]*)\"|'([^']*)')")


def xml_entities(text: str) -> str:
    def one(m):
        if m[3]:
            return NAMED[m[3]]
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return ENTITY.sub(one, text)


def xml_text(text: str) -> str:
    """Text, character data and attribute values of an XML text, each trimmed, one to a line."""
    found = []
    for m in XML_TOKEN.finditer(text):
        if m["tag"] is not None:
            found += [xml_entities(a or b) for a, b in XML_VALUE.findall(m["tag"])]
        elif m["data"] is not None:
            found.append(m["data"])
        elif m["text"] is not None:
            found.append(xml_entities(m["text"]))
    return "".join(f"{x.strip()}\n" for x in found if x.strip())


def extract_records(artifacts: DataFrame, limits: Limits = Limits(), method: str = "sha2-256", texts: bool = True) -> DataFrame:
    """Records of ``artifacts`` (artifact_id, source_locator_hash, artifact_type, size_bytes, content);
    a refused file has one row with its reason. Texts have a way of their own, for which ``artifacts`` is
    evaluated once more; where none are among them, ``texts=False`` spares that."""

    names, most = [c.split()[0] for c in SCHEMA.split(", ")], min(limits.max_bytes_per_artifact, limits.max_workdir_bytes)

    def judged(answer: tuple) -> tuple[str | None, list, str | None]:
        """(reason, records, coverage) of one file."""
        done, found = answer
        if not done:
            return (str(found) if isinstance(found, Refused) else "LIMIT_EXCEEDED" if isinstance(found, TimedOut) else "INTERNAL_ERROR"), [], None
        records, covered = found
        # What comes of a file is joined to one output, which a row must be able to hold.
        if sum(len(text) for _, text in records) > ROW_LETTERS:
            return "LIMIT_EXCEEDED", [], covered
        return ("UNKNOWN_COVERAGE", [], covered) if "UNKNOWN" in covered else (None, records, covered)

    def run(batches):
        extractor = Extractor(limits, method)
        # A cell may be as large as its file.
        csv.field_size_limit(max(limits.max_bytes_per_artifact, limits.max_expanded_bytes_per_archive, 1 << 17))

        def rows(extract: Timed):
            for part in arrow.parts(batches):
                files = list(arrow.rows_of(part, ["artifact_id", "source_locator_hash", "artifact_type", "size_bytes", "content"]))
                # What is staged for a file is its content, so its size bounds the work folder's use.
                refused = ["LIMIT_EXCEEDED" if size is not None and size > most else "UNSUPPORTED_FORMAT" if kind not in COVERAGE else "INTERNAL_ERROR" if data is None else None for _, _, kind, size, data in files]
                answers = extract.answers([(f[2], f[4]) for f, why in zip(files, refused) if why is None])
                for (a, loc, kind, _, _), why in zip(files, refused):
                    reason, records, covered = (why, [], None) if why else judged(next(answers))
                    yield from [(a, loc, kind, i, k, text, None, covered) for i, (k, text) in enumerate(records)] or [(a, loc, kind, 0, None, None, reason, covered)]

        with Timed(extractor.extract, limits.max_processing_ms / 1000, lambda found: sum(len(text) for _, text in found[0])) as extract:
            yield from arrow.in_batches(rows(extract), TYPES, names)

    given = artifacts.select("artifact_id", "source_locator_hash", "artifact_type", "size_bytes", "content")
    if not texts:
        return given.mapInArrow(run, SCHEMA)
    is_text = F.coalesce(F.col("artifact_type") == "TEXT", F.lit(False))
    return text_records(given.where(is_text), limits).unionByName(given.where(~is_text).mapInArrow(run, SCHEMA))


def text_records(artifacts: DataFrame, limits: Limits) -> DataFrame:
    """Records of plain texts, which need no parser and so no Python."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    rows = artifacts.select("artifact_id", "source_locator_hash", "artifact_type", "size_bytes", F.col("content").isNull().alias("unread"), text.alias("text"))
    large = (F.col("size_bytes") > min(limits.max_bytes_per_artifact, limits.max_workdir_bytes)) | F.col("unread") | (F.coalesce(F.length("text"), F.lit(0)) > ROW_LETTERS)
    rows = rows.withColumn("reason", F.when(large, "LIMIT_EXCEEDED").when(F.col("text").isNull(), "PARSE_ERROR"))
    fine = lambda value: F.when(F.col("reason").isNull(), value)
    return rows.select(
        "artifact_id", "source_locator_hash", "artifact_type", F.lit(0).cast("long").alias("record_index"), fine(F.lit("text")).alias("kind"), fine(F.col("text")).alias("record"), "reason",
        fine(F.lit(COVERAGE["TEXT"])).alias("coverage"),
    )
