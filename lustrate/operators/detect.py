"""Detection as columns: counts, byte spans, residual flags. Counts are raw: each detector's matches,
unmerged, on the text as given.

Places come from running sums over the lengths of gaps and matches, in blocks of about the square root of
their number, so that a text with n matches takes about n ** 1.5 small steps and the text is split and
matched once. Patterns may be columns, so one expression serves a table of any number of classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lustrate.functions import literals
from lustrate.plans.policy import Detector, Policy, PolicyClass

#: A maximal run of digits, blanks and hyphens with 13 digits or more. No quantifier gives back what it
#: took, and runs are entered at their start only, so a text is read in one pass.
CARD_RUN = "(?<![0-9 -])[ -]*+[0-9](?:[ -]*+[0-9]){12,}+[ -]*+"
#: What a text with a card holds; it begins with a digit, so most places of a text are passed over at once.
CARD_DIGITS = "[0-9](?:[ -]*+[0-9]){12}"
SPANS = "array<struct<start:int,end:int>>"
#: Literals of a pattern that are looked for before it, at most.
LITERALS = 4


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scanned(values: Column, op) -> Column:
    """The array of ``op`` (associative) over each prefix of ``values``."""

    def fold(block: Column) -> Column:
        step = lambda out, x: F.concat(out, F.array(op(F.element_at(out, -1), x)))
        return F.aggregate(F.slice(block, 2, F.size(block)), F.slice(block, 1, 1), step)

    def carried(folded: Column) -> Column:
        tops = fold(F.transform(folded, lambda b: F.element_at(b, -1)))
        ahead = lambda t: F.transform(folded, lambda b, k: F.when(k == 0, b).otherwise(F.transform(b, lambda x: op(F.element_at(t, k), x))))
        return F.flatten(bound(tops, ahead))

    def run(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / w).cast("int")), lambda k: fold(F.slice(v, k * w + 1, w)))
        return F.when(F.size(v) > 0, bound(bound(width, blocks), carried)).otherwise(v)

    return bound(values, run)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def is_card(run: Column) -> Column:
    """A run of digits, blanks and hyphens with 13 to 19 digits that pass the mod-10 check."""
    return F.length(digits(run)).between(13, 19) & F.call_function("luhn_check", digits(run))


def possible(text: Column, detector: Detector) -> Column:
    """False for texts that can't hold a match, told by a search that is cheaper than the pattern."""
    if detector.kind == "luhn":
        return text.rlike(CARD_DIGITS)
    needed = literals.required(detector.pattern, 1)
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in needed]) if needed and len(needed) <= LITERALS else F.lit(True)


def cards(text: Column) -> Column:
    runs = F.filter(F.regexp_extract_all(text, F.lit(CARD_RUN), F.lit(0)), is_card)
    return F.when(~text.rlike(CARD_DIGITS), F.array().cast("array<string>")).otherwise(runs)


def matches(text: Column, detector: Detector) -> Column:
    """All matches of one detector, in order."""
    return cards(text) if detector.kind == "luhn" else F.regexp_extract_all(text, F.lit(detector.pattern), F.lit(0))


def match_count(text: Column, detector: Detector) -> Column:
    count = F.size(cards(text)) if detector.kind == "luhn" else F.regexp_count(text, F.lit(detector.pattern))
    return F.when(~possible(text, detector), 0).otherwise(count).cast("long")


def has_card(text: Column) -> Column:
    return text.rlike(CARD_DIGITS) & F.exists(F.regexp_extract_all(text, F.lit(CARD_RUN), F.lit(0)), is_card)


def found(text: Column, detector: Detector) -> Column:
    """Whether anything matches; the cheap form for gates and for the residual check."""
    return has_card(text) if detector.kind == "luhn" else possible(text, detector) & text.rlike(detector.pattern)


def class_count(text: Column, policy_class: PolicyClass) -> Column:
    return reduce(Column.__add__, [match_count(text, d) for d in policy_class.detectors])


def class_found(text: Column, policy_class: PolicyClass) -> Column:
    return reduce(Column.__or__, [found(text, d) for d in policy_class.detectors])


def residual(text: Column, policy: Policy, applies=lambda c: F.lit(True)) -> Column:
    """Whether any class that applies still finds something; severity makes no difference."""
    return F.coalesce(reduce(Column.__or__, [applies(c) & class_found(text, c) for c in policy.classes]), F.lit(False))


def hits(text: Column, pattern: Column, luhn: Column, size=F.octet_length) -> Column:
    """Array of (start, end, hit) of a pattern's matches, end exclusive, in bytes or by ``size``; where
    ``luhn`` holds, of those that are cards."""

    def placed(runs: Column) -> Column:
        ends = scanned(F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(runs)), runs, lambda gap, hit: (size(gap) + size(hit)).cast("int")), Column.__add__)
        return F.zip_with(runs, ends, lambda hit, end: F.struct((end - size(hit)).cast("int").alias("start"), end.alias("end"), hit.alias("hit")))

    every = bound(F.regexp_extract_all(text, pattern, F.lit(0)), lambda runs: F.when(F.size(runs) > 0, placed(runs)).otherwise(F.array().cast("array<struct<start:int,end:int,hit:string>>")))
    return F.filter(every, lambda s: ~luhn | is_card(s["hit"]))


def spans(text: Column, detector: Detector, size=F.octet_length) -> Column:
    """Array of (start, end) of a detector's matches."""
    luhn = detector.kind == "luhn"
    found = hits(text, F.lit(CARD_RUN if luhn else detector.pattern), F.lit(luhn), size)
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def islands(every: Column) -> Column:
    """Union of spans; spans that overlap or touch become one. A span begins an island if it starts after
    the highest end before it, and the island ends at the highest end before the next one."""

    def cut(ordered: Column, ends: Column) -> Column:
        count = F.size(ordered)
        begins = F.filter(F.sequence(F.lit(1), count), lambda i: (i == 1) | (F.element_at(ordered, i)["start"] > F.element_at(ends, F.greatest(i - 1, F.lit(1)))))
        last = lambda b, k: F.coalesce(F.try_element_at(b, k + 2), count + 1) - 1
        whole = lambda b: F.transform(b, lambda i, k: F.struct(F.element_at(ordered, i)["start"].alias("start"), F.element_at(ends, last(b, k)).alias("end")))
        return bound(begins, whole)

    def run(ordered: Column) -> Column:
        ends = scanned(F.transform(ordered, lambda s: s["end"]), F.greatest)
        return F.when(F.size(ordered) > 0, bound(ends, lambda e: cut(ordered, e))).otherwise(F.array().cast(SPANS))

    return bound(F.array_sort(every), run)


def merged_spans(text: Column, detectors: tuple[Detector, ...], size=F.length) -> Column:
    """Union of the detectors' spans, in characters or by ``size``."""
    return islands(F.flatten(F.array(*[spans(text, d, size) for d in detectors])))


def byte_spans(text: Column, detector: Detector) -> Column:
    """``spans`` in bytes of UTF-8."""
    return spans(text, detector)
