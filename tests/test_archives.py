"""Ordinary archives are read without the library's objects, others by the library: to the same results."""

import io
import random
import tarfile
import zipfile

import pytest

from lustrate.plans import container_queries
from lustrate.plans.policy import Limits
from lustrate.sources import extract

LIMITS = Limits(max_entries_per_archive=6, max_expanded_bytes_per_archive=3000, max_expansion_ratio=100)


def by(kind, data, plain):
    """Entries, or the reason, of an archive; without the plain readers where ``plain`` is false."""
    made = extract.Extractor(LIMITS, "sha2-256")
    with pytest.MonkeyPatch.context() as m:
        if not plain:
            m.setattr(extract, f"plain_{kind}", lambda data: None)
        found = []
        try:
            for entry in getattr(made, f"entries_of_{kind}")(data):
                found.append(entry)
        except extract.Refused as e:
            return found, str(e)
        except Exception as e:  # noqa: BLE001  a fault that ends in INTERNAL_ERROR
            return found, type(e)
        return found, None


def archive(kind, dice):
    names = ["a.txt", "b/c.txt", "b/./c.txt", "a.txt", "d/", "ä.txt", "../x", "/y", "C:z", "e" * 60 + "/" + "e" * 60, "f\\g.txt"]
    some = [(dice.choice(names[:5] if dice.random() < 0.8 else names), dice.randbytes(dice.choice([0, 1, 511, 512, 513])) if dice.random() < 0.7 else b"x" * dice.choice([9, 2900, 9000])) for _ in range(dice.randrange(8))]
    out = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(out, "w") as z:
            for name, data in some:
                info = zipfile.ZipInfo(name)
                info.compress_type = dice.choice([0, 8, 8, 12])
                if dice.random() < 0.05:
                    info.external_attr = 0o120777 << 16
                z.writestr(info, data)
            z.comment = b"note" if dice.random() < 0.1 else b""
    else:
        with tarfile.open(fileobj=out, mode="w", format=dice.choice([tarfile.PAX_FORMAT, tarfile.GNU_FORMAT, tarfile.USTAR_FORMAT])) as t:
            for name, data in some:
                info = tarfile.TarInfo(name)
                info.type = dice.choice([tarfile.REGTYPE] * 20 + [tarfile.DIRTYPE, tarfile.SYMTYPE, tarfile.AREGTYPE])
                info.size = len(data) if info.isreg() else 0
                t.addfile(info, io.BytesIO(data))
    return out.getvalue()


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("kind", ["zip", "tar"])
def test_plain_readers_agree_with_the_library(kind):
    dice, plain, reasons = random.Random(5), 0, set()
    for _ in range(1500):
        data = bytearray(archive(kind, dice))
        for _ in range(dice.choice([0, 0, 1, 2])):
            if data:
                data[dice.randrange(len(data))] = dice.choice([0, 1, 32, 48, 255])
        cut = dice.choice([len(data)] * 6 + [dice.randrange(len(data) + 1)])
        data = bytes(data[:cut])
        plain += getattr(extract, f"plain_{kind}")(data) is not None
        found = by(kind, data, True)
        assert found == by(kind, data, False)
        reasons.add(found[1])
    assert plain > 300 and {None, "UNSAFE_PATH", "LIMIT_EXCEEDED", "PARSE_ERROR"} <= reasons


def test_written_archives_are_those_of_the_library():
    entries = [("0.txt", b"x" * 7), ("b/inner.tar", bytes(range(256)) * 5), ("2.txt", b"")]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries:
            z.writestr(zipfile.ZipInfo(name), data)
    assert container_queries.zipped(entries) == out.getvalue()
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in entries:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    ours = container_queries.tarred(entries)
    assert out.getvalue()[: len(ours)] == ours and not any(out.getvalue()[len(ours) :])
    assert extract.plain_zip(container_queries.zipped(entries)) and len(extract.plain_tar(ours)) == 3


def test_part_keys_are_dealt_over_all_cores(spark):
    from lustrate.scratch import dealt

    rows = spark.range(1000).coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    assert dealt(rows, "id", 10_000).rdd.getNumPartitions() == cores and dealt(rows, "id", 100).rdd.getNumPartitions() == max(cores, 10)
