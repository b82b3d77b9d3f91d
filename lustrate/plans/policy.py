"""Policies and limits: loading, validation, identity."""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass
from hashlib import sha256
from pathlib import Path

from lustrate.functions import dialect
from lustrate.functions.digests import blake3

SEVERITIES = ("LOW", "MEDIUM", "HIGH")


class PolicyError(ValueError):
    pass


@dataclass(frozen=True)
class Detector:
    kind: str  # regex or luhn
    pattern: str = ""


@dataclass(frozen=True)
class PolicyClass:
    class_id: str
    severity: str
    detectors: tuple[Detector, ...]
    action: str
    keep_last: int = 0
    selector: str | None = None
    fields: tuple[str, ...] = ()


@dataclass(frozen=True)
class Policy:
    classes: tuple[PolicyClass, ...]
    policy_id: str = ""


def _only(found: dict, known: set[str], what: str) -> None:
    if not isinstance(found, dict):
        raise PolicyError(f"{what} must be an object")
    if extra := set(found) - known:
        raise PolicyError(f"{what} has unknown fields {sorted(extra)}")


def _class(raw: dict) -> PolicyClass:
    _only(raw, {"class_id", "severity", "detectors", "action"}, "a class")
    name = raw.get("class_id")
    if not isinstance(name, str) or not name.strip():
        raise PolicyError("class_id must not be blank")
    if raw.get("severity") not in SEVERITIES:
        raise PolicyError(f"{name}: unknown severity")
    detectors, selector, fields = [], None, ()
    for d in raw.get("detectors") or []:
        kind = d.get("kind")
        if kind == "regex":
            _only(d, {"kind", "pattern", "case_insensitive", "dot_matches_new_line"}, "a regex detector")
            try:
                detectors.append(Detector("regex", dialect.java_pattern(d["pattern"], d.get("case_insensitive", False), d.get("dot_matches_new_line", False))))
            except (KeyError, ValueError) as e:
                raise PolicyError(f"{name}: {e}") from e
        elif kind == "checksum":
            _only(d, {"kind", "algorithm"}, "a checksum detector")
            if d.get("algorithm") != "luhn":
                raise PolicyError(f"{name}: unknown checksum")
            detectors.append(Detector("luhn"))
        elif kind == "field_selector":
            _only(d, {"kind", "selector", "fields"}, "a field selector")
            if selector or d.get("selector") not in ("json_pointer", "csv_header") or not d.get("fields"):
                raise PolicyError(f"{name}: a class takes one selector of a known kind with fields")
            selector, fields = d["selector"], tuple(d["fields"])
        else:
            raise PolicyError(f"{name}: unknown detector {kind}")
    if not detectors:
        raise PolicyError(f"{name}: no detector that can match")
    action = raw.get("action") or {}
    kind = action.get("kind")
    if kind == "MASK":
        _only(action, {"kind", "keep_last"}, "MASK")
        if not isinstance(action.get("keep_last"), int) or action["keep_last"] < 1:
            raise PolicyError(f"{name}: keep_last must be 1 or more")
    elif kind in ("REDACT", "DROP"):
        _only(action, {"kind"}, kind)
    else:
        raise PolicyError(f"{name}: unsupported action {kind}")
    return PolicyClass(name, raw["severity"], tuple(detectors), kind, action.get("keep_last", 0), selector, fields)


def compile_policy(raw: dict, policy_id: str = "") -> Policy:
    """A validated policy; classes are in the byte order of their ids, in which they apply."""
    _only(raw, {"schema_version", "classes", "defaults", "scopes"}, "the policy")
    if raw.get("schema_version") != "policy.v1":
        raise PolicyError("schema_version must be policy.v1")
    if raw.get("defaults") != {}:
        raise PolicyError("defaults must be present and empty")
    if raw.get("scopes") != []:
        raise PolicyError("scopes must be present and empty")
    classes = [_class(c) for c in raw.get("classes") or []]
    if not classes or len({c.class_id for c in classes}) < len(classes):
        raise PolicyError("a policy needs classes with unique ids")
    return Policy(tuple(sorted(classes, key=lambda c: c.class_id.encode())), policy_id)


def bundle_id(folder: Path, method: str = "sha2-256") -> str:
    """Identity of every file in the bundle, by path; independent of the order of listing."""
    hashed = b""
    for path in sorted((p for p in folder.rglob("*") if p.is_file()), key=lambda p: p.relative_to(folder).as_posix().encode()):
        name, data = path.relative_to(folder).as_posix().encode(), path.read_bytes()
        hashed += struct.pack("<I", len(name)) + name + struct.pack("<Q", len(data)) + data
    return (blake3(hashed) if method == "blake3" else sha256(hashed).digest()).hex()


def load_policy(folder: str | Path, method: str = "sha2-256") -> Policy:
    folder = Path(folder)
    try:
        raw = json.loads((folder / "policy.json").read_text("utf-8"))
    except (OSError, ValueError) as e:
        raise PolicyError(f"policy.json can't be read: {e}") from e
    policy = compile_policy(raw, bundle_id(folder, method))
    for c in policy.classes:
        for d in c.detectors:
            if d.kind == "regex":
                try:
                    dialect.check(d.pattern)
                except ValueError as e:
                    raise PolicyError(f"{c.class_id}: {e}") from e
    return policy


@dataclass(frozen=True)
class Limits:
    max_nested_archive_depth: int = 3
    max_entries_per_archive: int = 100_000
    max_expansion_ratio: int = 25
    max_expanded_bytes_per_archive: int = 50 << 30
    max_bytes_per_artifact: int = 256 << 20
    max_processing_ms: int = 30_000
    max_workdir_bytes: int = 1 << 30


LIMIT_GROUPS = {
    "archive": ("max_nested_archive_depth", "max_entries_per_archive", "max_expansion_ratio", "max_expanded_bytes_per_archive"),
    "artifact": ("max_bytes_per_artifact", "max_processing_ms"),
    "disk": ("max_workdir_bytes",),
}


def load_limits(path: str | Path) -> Limits:
    """Defaults with the overrides of a ``limits.v1`` file; only depth and entries may be 0."""
    raw = json.loads(Path(path).read_text("utf-8"))
    _only(raw, {"schema_version", *LIMIT_GROUPS}, "the limits")
    if raw.get("schema_version") != "limits.v1":
        raise PolicyError("schema_version must be limits.v1")
    given = {}
    for group, names in LIMIT_GROUPS.items():
        _only(raw.get(group, {}), set(names), group)
        given |= raw.get(group, {})
    for name, value in given.items():
        least = 0 if name in ("max_nested_archive_depth", "max_entries_per_archive") else 1
        if not isinstance(value, int) or isinstance(value, bool) or value < least:
            raise PolicyError(f"{name} must be {least} or more")
    return Limits(**given)
