"""Rewriting as columns: each class in its order on the text that the classes before it left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lustrate.functions import dialect, literals
from lustrate.operators import detect
from lustrate.plans.policy import Policy, PolicyClass


def masked(hit: Column, keep: Column) -> Column:
    """Stars for all but the last letters; a match no longer than what is kept stays as it is."""
    return F.when(F.length(hit) <= keep, hit).otherwise(F.concat(F.repeat(F.lit("*"), F.length(hit) - keep), F.substring(hit, F.length(hit) - keep + 1, keep)))


def acted(hit: Column, policy_class: PolicyClass) -> Column:
    """What stands in the place of one merged match."""
    if policy_class.action == "REDACT":
        return F.lit("{{" + policy_class.class_id + "}}")
    return F.lit("") if policy_class.action == "DROP" else masked(hit, F.lit(policy_class.keep_last))


def per_match(text: Column, pattern: str, change) -> Column:
    """``text`` with ``change`` on each match of ``pattern``."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), hits, lambda gap, hit: F.concat(gap, F.coalesce(change(hit), F.lit("")))), "")


def spliced(text: Column, islands: Column, change) -> Column:
    """``text`` with ``change`` on each of its ``islands`` (merged byte spans). Pieces are cut from the
    bytes, where a place is found without reading what lies before it."""

    def join(data: Column, spans: Column) -> Column:
        piece = lambda start, end: F.substring(data, start + 1, end - start).cast("string")
        before = lambda k: F.when(k == 0, 0).otherwise(F.try_element_at(spans, k)["end"])
        parts = F.transform(spans, lambda s, k: F.concat(piece(before(k), s["start"]), change(piece(s["start"], s["end"]))))
        return F.array_join(F.concat(parts, F.array(piece(F.element_at(spans, -1)["end"], F.octet_length(data)))), "")

    return detect.bound(islands, lambda spans: F.when(F.size(spans) > 0, detect.bound(text.cast("binary"), lambda data: join(data, spans))).otherwise(text))


def rewrite_class(text: Column, policy_class: PolicyClass) -> Column:
    if len(policy_class.detectors) > 1:
        changed = spliced(text, detect.merged_spans(text, policy_class.detectors, F.octet_length), lambda hit: acted(hit, policy_class))
    elif policy_class.detectors[0].kind == "luhn":
        # Runs of card letters are maximal, so no two of them touch.
        changed = per_match(text, detect.CARD_RUN, lambda run: F.when(detect.is_card(run), acted(run, policy_class)).otherwise(run))
    else:
        pattern = dialect.touching(policy_class.detectors[0].pattern)
        if policy_class.action == "MASK":
            changed = per_match(text, pattern, lambda hit: acted(hit, policy_class))
        else:
            marker = "{{" + policy_class.class_id + "}}" if policy_class.action == "REDACT" else ""
            changed = F.regexp_replace(text, pattern, dialect.replacement(marker))
    # Most texts hold nothing: the gate spares them the rewrite.
    return F.when(detect.class_found(text, policy_class), changed).otherwise(text)


#: Classes up to which each has columns of its own; longer policies go through one fold.
UNROLLED = 6


def class_data(c: PolicyClass) -> Column:
    """A class as a struct, for expressions over any number of classes."""
    detectors = [F.struct(F.lit(d.kind == "luhn").alias("luhn"), F.lit(detect.CARD_RUN if d.kind == "luhn" else d.pattern).alias("pattern")) for d in c.detectors]
    needed = class_literals(c)
    held = F.array(*map(F.lit, needed)) if needed is not None else F.lit(None)
    return F.struct(
        F.lit(c.class_id).alias("class_id"), F.lit(c.action).alias("action"), F.lit(c.keep_last).alias("keep_last"), F.array(*detectors).alias("detectors"),
        held.cast("array<string>").alias("literals"),
    )


def class_literals(policy_class: PolicyClass) -> list[str] | None:
    """Literals of which a text with a match of the class contains one, or None."""
    found = [None if d.kind == "luhn" else literals.required(d.pattern) for d in policy_class.detectors]
    return None if None in found else sorted(set().union(*found))


def found_by(text: Column, c: Column) -> Column:
    """Whether a class (a struct) finds anything; its literals are looked for first."""
    one = lambda d: F.when(d["luhn"], detect.has_card(text)).otherwise(F.call_function("rlike", text, d["pattern"]))
    return (c["literals"].isNull() | F.exists(c["literals"], lambda w: F.contains(text, w))) & F.exists(c["detectors"], one)


def fold_classes(text: Column, classes: Column, applies) -> Column:
    """``text`` after all ``classes`` (an array of structs, in order)."""

    def spans(t: Column, c: Column) -> Column:
        places = F.transform(c["detectors"], lambda d: F.transform(detect.hits(t, d["pattern"], d["luhn"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        return detect.islands(F.flatten(places))

    def step(t: Column, c: Column) -> Column:
        marker = F.concat(F.lit("{{"), c["class_id"], F.lit("}}"))
        change = lambda hit: F.when(c["action"] == "MASK", masked(hit, c["keep_last"])).when(c["action"] == "DROP", F.lit("")).otherwise(marker)
        return F.when(applies(c) & found_by(t, c), spliced(t, spans(t, c), change)).otherwise(t)

    return F.aggregate(classes, text, step)


def rewrite(text: Column, policy: Policy, applies=lambda c: F.lit(True)) -> Column:
    """All classes, in order of their ids; ``applies`` tells where a class looks at all.

    Short policies have columns for each class, and from the second class on the text so far is bound to a
    variable: it is evaluated once. Longer ones are an array of structs that one fold goes through, so the
    expression around it stays as it is."""
    if len(policy.classes) > UNROLLED:
        classes = F.array(*[F.struct(class_data(c).alias("c"), applies(c).alias("on")) for c in policy.classes])
        return F.aggregate(classes, text, lambda t, x: F.when(x["on"], fold_classes(t, F.array(x["c"]), lambda c: F.lit(True))).otherwise(t))

    def step(so_far: Column, c: PolicyClass) -> Column:
        return F.when(applies(c), rewrite_class(so_far, c)).otherwise(so_far)

    first, *rest = policy.classes
    return reduce(lambda so_far, c: detect.bound(so_far, lambda t: step(t, c)), rest, step(text, first))


def selected(policy_class: PolicyClass, unit_kind: Column, field: Column, pointer: Column) -> Column:
    """Whether a class looks at a unit: a selector of the other kind is no filter."""
    if policy_class.selector == "csv_header":
        return ~F.coalesce(unit_kind.startswith("csv"), F.lit(False)) | F.coalesce(field.isin(*policy_class.fields), F.lit(False))
    if policy_class.selector == "json_pointer":
        return ~F.coalesce(unit_kind.startswith("json"), F.lit(False)) | F.coalesce(pointer.isin(*policy_class.fields), F.lit(False))
    return F.lit(True)
