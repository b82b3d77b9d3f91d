"""Structured events: one JSON object a line on standard error, with the run and policy they belong to.

Values are counts, codes and ids only; no content, name or path of a file is ever logged."""

from __future__ import annotations

import json
import logging
import sys

UNKNOWN = "unknown"


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        fields = getattr(record, "fields", {})
        line = {"level": record.levelname, "event": record.getMessage(), "run_id": fields.get("run_id", UNKNOWN), "policy_id": fields.get("policy_id", UNKNOWN)}
        return json.dumps(line | fields, sort_keys=True)


class LastStderr(logging.StreamHandler):
    """Writes to what standard error is at the time."""

    def __init__(self):
        super().__init__(sys.stderr)

    def emit(self, record: logging.LogRecord) -> None:
        self.stream = sys.stderr
        super().emit(record)


logger = logging.getLogger("lustrate.events")
if not logger.handlers:
    handler = LastStderr()
    handler.setFormatter(JsonLines())
    logger.addHandler(handler)
    logger.setLevel(logging.INFO)
    logger.propagate = False


class Events:
    """Events of one run."""

    def __init__(self, **context: str):
        self.context = context

    def __call__(self, event: str, level: int = logging.INFO, **fields) -> None:
        logger.log(level, event, extra={"fields": self.context | fields})
