"""Detection and rewriting against plain Python on chosen and random texts."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lustrate.functions import dialect
from lustrate.functions.digests import blake3
from lustrate.operators import detect, rewrite
from lustrate.operators.tables import applies
from lustrate.plans.policy import Detector, Policy, PolicyClass

LUHN = Detector("luhn")


def cls(name, *detectors, action="REDACT", keep=0, selector=None, fields=()):
    return PolicyClass(name, "LOW", detectors, action, keep, selector, fields)


def rewritten(spark, texts, policy):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r["o"] for r in df.select("i", rewrite.rewrite(F.col("text"), policy).alias("o")).orderBy("i").collect()]


def test_card_span_keeps_blanks(spark):
    df = spark.createDataFrame([("call 4111-1111-1111-1111 today",), ("4111111111111112",), (None,), ("",)], "text string")
    spans = [r[0] for r in df.select(detect.byte_spans(F.col("text"), LUHN)).collect()]
    assert [[tuple(s) for s in x or []] for x in spans] == [[(4, 25)], [], [], []]


def test_spans_are_bytes(spark):
    df = spark.createDataFrame([("é 12 ü 345",)], "text string")
    assert [tuple(s) for s in df.select(detect.byte_spans(F.col("text"), Detector("regex", "[0-9]+"))).first()[0]] == [(3, 5), (9, 12)]


def test_mask_drop_and_short_mask(spark):
    digits = Detector("regex", "[0-9]+")
    assert rewritten(spark, ["a 123456 b 12", "x", "", None], Policy((cls("M", digits, action="MASK", keep=4),))) == ["a **3456 b 12", "x", "", None]
    assert rewritten(spark, ["a 1 b"], Policy((cls("D", digits, action="DROP"),))) == ["a  b"]


def test_classes_apply_in_turn_and_quote_the_marker(spark):
    policy = Policy((cls("A$1\\", Detector("regex", "x")), cls("B", Detector("regex", "[$]1"))))
    assert rewritten(spark, ["x"], policy) == ["{{A{{B}}\\}}"]


def test_touching_matches_make_one_marker_even_in_long_texts(spark):
    policy = Policy((cls("T", Detector("regex", "(?:a|b)")),))
    assert rewritten(spark, ["ab" * 20_000 + "c"], policy) == ["{{T}}c"]


def merged(text, patterns):
    spans = sorted((m.start(), m.end()) for p in patterns for m in re.finditer(p, text))
    out = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab1é.-", max_size=30), min_size=1, max_size=20))
def test_several_detectors_merge(spark, texts):
    patterns = ["a+b", "b[.]?1", "é"]
    policy = Policy((cls("P", *[Detector("regex", p) for p in patterns]),))
    want = []
    for t in texts:
        for s, e in reversed(merged(t, patterns)):
            t = t[:s] + "{{P}}" + t[e:]
        want.append(t)
    assert rewritten(spark, texts, policy) == want


def test_selectors(spark):
    header, pointer = cls("H", Detector("regex", "@"), selector="csv_header", fields=("email",)), cls("J", Detector("regex", "@"), selector="json_pointer", fields=("/email",))
    rows = [("csv_cell", "email", None), ("csv_cell", "other", None), ("json_leaf", None, "/email"), ("json_leaf", None, "/email/0"), ("text", None, None)]
    df = spark.createDataFrame(rows, "unit_kind string, field string, pointer string")
    got = [tuple(r) for r in df.select(applies()(header), applies()(pointer)).collect()]
    assert got == [(True, True), (False, True), (True, True), (True, False), (True, True)]


def test_dialect(spark):
    for bad in ("(?=a)b", "(?<!a)b", r"(a)\1", "a++", "(?>a)"):
        with pytest.raises(ValueError):
            dialect.java_pattern(bad)
    df = spark.createDataFrame([("a",), ("a\n",), ("٣",), ("x\u0085y",)], "t string")
    hits = lambda p: [r[0] for r in df.select(F.col("t").rlike(dialect.java_pattern(p))).collect()]
    assert hits("^a$") == [True, False, False, False]
    assert hits(r"\d") == [False, False, True, False]
    assert hits("x.y") == [False, False, False, True]
    assert dialect.java_pattern("[$]a$").endswith(r"[$]a\z")


# A pattern, a text, and whether the pattern is found in it, in the policy's dialect.
MEANINGS = [
    ("[[:alpha:]]+", "Xyz", True), ("[[:alpha:]]+", ":", False), ("[[:alpha:]]", "é", False), ("[[:^digit:]]", "5", False), ("[x[:digit:]]", "x", True), ("[^[:space:]]", " \t", False),
    ("(?P<year>[0-9]{4})", "in 2024", True), ("(?<a_b>q)", "q", True), ("(?m)b$", "ab\nc", True), ("b$", "ab\nc", False), ("(?m)^c", "ab\nc", True), ("(?m:a$)|b$", "b\n", False),
    (r"\x{1F600}", "😀", True), (r"\u0041\x42", "AB", True), (r"\U0001F600", "😀", True), (r"a\vb", "a\x0bb", True), (r"a\vb", "a\nb", False), ("[]a]b", "]b", True), ("[^]a]", "]", False),
    (r"\p{Greek}", "α", True), (r"\pL", "é", True), (r"\P{L}", "é", False), (r"\p{^L}", "5", True), ("(?i)É", "é", True), ("a.c", "a\rc", True), ("a.c", "a\nc", False), ("(?s)a.c", "a\nc", True),
    ("x{2,3}y", "xxy", True), (r"\bcat\b", "a cat!", True), (r"[\d&&[^5]]", "5", False), (r"\$1\.", "$1.", True), ("a(?i)b(?-i)c", "aBc", True), ("a(?i)b(?-i)c", "aBC", False),
]
REFUSED = ["(", ")", "a**", "[a", "*a", "a{", "a{3,2}", r"\Z", r"\Qa\E", r"\k<a>", r"\1", r"\h", r"\R", "a++", "a*+", "a{2}+", "(?=a)", "(?!a)", "(?<=a)b", "(?>a)", "(?x)a b", "(?U)a", "(?R)a", "(?-u)a", "[a--b]", "[a~~b]", "[[:nope:]]", r"\b{start}", "a*", "", "^", "\\", r"\p{Nope}"]


def test_dialect_keeps_meanings(spark):
    for pattern, text, found in MEANINGS:
        java = dialect.java_pattern(pattern)
        dialect.check(java)
        assert spark.range(1).select(F.lit(text).rlike(java)).first()[0] == found, (pattern, text, java)


@pytest.mark.parametrize("pattern", REFUSED)
def test_dialect_refuses(spark, pattern):
    with pytest.raises(ValueError):
        dialect.check(dialect.java_pattern(pattern))


def test_rewrite_grows_with_the_classes(spark):
    import time

    policy = Policy(tuple(cls(f"C{i:02}", Detector("regex", f"x{i:02}y"), Detector("regex", f"q{i:02}")) if i % 7 == 0 else cls(f"C{i:02}", Detector("regex", f"x{i:02}y")) for i in range(30)))
    began = time.perf_counter()
    assert rewritten(spark, ["x00y x29y q07 x30y"], policy) == ["{{C00}} {{C29}} {{C07}} x30y"]
    assert time.perf_counter() - began < 60  # it tripled with each class once


def test_blake3_of_the_specification():
    assert blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    # An input of several chunks exercises the tree.
    assert len({blake3(b"x" * n).hex() for n in (1023, 1024, 1025, 2048, 2049, 5000)}) == 6
