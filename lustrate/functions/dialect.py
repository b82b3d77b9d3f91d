r"""Policy patterns in Java's dialect.

Policies use a linear-time dialect: Unicode classes, ``.`` stops at ``\n`` only, ``$`` is the end of
the text, POSIX names inside brackets mean ASCII letters, no look-around, back-references, possessive
or atomic groups. ``java_pattern`` reads a pattern once from left to right and writes each construct in
the form that means the same in Java; what it does not know it refuses, so that no pattern is read in
another sense than its author's. ``check`` then compiles the result in the JVM.
"""

from __future__ import annotations

import re

# The POSIX names, as ranges of ASCII letters.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
#: Escaped letters with one meaning in both dialects, those that need another form, and code points.
SAME, OTHER = set("dDsSwWbBAztnrfa"), {"v": r"\x0B"}
CODE = re.compile(r"x\{([0-9A-Fa-f]+)\}|u\{([0-9A-Fa-f]+)\}|U\{([0-9A-Fa-f]+)\}|x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})")
PROPERTY = re.compile(r"([pP])(?:\{(\^?)([^{}]+)\}|(\w))")
GROUP = re.compile(r"\?(?:P?<[A-Za-z_][\w.\[\]]*>|([A-Za-z]*(?:-[A-Za-z]+)?)([:)]))")


class Reader:
    """One pass over a pattern."""

    def __init__(self, pattern: str):
        self.pattern, self.at, self.out = pattern, 0, []
        self.many_lines = [False]  # the flag m, by open group

    def refuse(self, what: str):
        raise ValueError(f"a policy pattern must not use {what}")

    def take(self, shape: re.Pattern):
        found = shape.match(self.pattern, self.at)
        self.at = found.end() if found else self.at
        return found

    def escape(self, in_class: bool) -> str:
        """The construct after a backslash."""
        if self.at == len(self.pattern):
            self.refuse("a backslash at the end")
        if found := self.take(CODE):
            return rf"\x{{{next(g for g in found.groups() if g)}}}"
        if found := self.take(PROPERTY):
            name, negated = found[3] or found[4], (found[1] == "P") != bool(found[2])
            if len(name) > 2 and "=" not in name:
                name = "Is" + name.replace(" ", "_")
            return rf"\{'P' if negated else 'p'}{{{name}}}"
        letter = self.pattern[self.at]
        self.at += 1
        if letter in OTHER:
            return OTHER[letter]
        if letter in SAME and not (in_class and letter in "bBAz"):
            if letter in "bB" and self.pattern.startswith("{", self.at):
                self.refuse("special word borders")
            return "\\" + letter
        if letter.isalnum() or letter in "<>":
            self.refuse("back-references" if letter.isdigit() else f"the escape \\{letter}")
        return "\\" + letter

    def brackets(self) -> str:
        """A class in brackets, after its opening one."""
        out, first = ["["], True
        if self.pattern.startswith("^", self.at):
            out.append("^")
            self.at += 1
        while self.at < len(self.pattern):
            rest = self.pattern[self.at :]
            if posix := re.match(r"\[:(\^?)(\w+):\]", rest):
                if posix[2] not in POSIX:
                    self.refuse(f"the class {posix[0]}")
                out.append(f"[^{POSIX[posix[2]]}]" if posix[1] else POSIX[posix[2]])
                self.at += posix.end()
            elif rest[0] == "]" and not first:
                self.at += 1
                return "".join(out) + "]"
            elif rest[:2] in ("--", "~~"):
                self.refuse("differences of classes")
            elif rest[0] == "[":
                self.at += 1
                out.append(self.brackets())
            elif rest[0] == "\\":
                self.at += 1
                out.append(self.escape(True))
            else:
                out.append("\\" + rest[0] if rest[0] in "]^" else rest[0])
                self.at += 1
            first = False
        self.refuse("an open class")

    def group(self) -> str:
        """A group, after its opening bracket; names are not needed."""
        if not self.pattern.startswith("?", self.at):
            self.many_lines.append(self.many_lines[-1])
            return "(?:"
        found = self.take(GROUP)
        if not found:
            self.refuse("look-around, atomic groups or unknown groups")
        if found[2] is None:
            self.many_lines.append(self.many_lines[-1])
            return "(?:"
        on, _, off = found[1].partition("-")
        if set(on + off) - set("imsu") or "u" in off or not (found[1] or found[2] == ":"):
            self.refuse(f"the flags {found[1]}")
        many = "m" in on or (self.many_lines[-1] and "m" not in off)
        if found[2] == ":":
            self.many_lines.append(many)
        else:
            self.many_lines[-1] = many
        on, off = "".join(sorted(set(on) - set("mu"))).replace("i", "iu"), "".join(sorted(set(off) - {"m"}))
        return f"(?{on}{'-' if off else ''}{off}{found[2]}" if on or off or found[2] == ":" else ""

    def read(self) -> str:
        while self.at < len(self.pattern):
            letter, last = self.pattern[self.at], self.out[-1] if self.out else ""
            self.at += 1
            if letter == "\\":
                part = self.escape(False)
            elif letter == "[":
                part = self.brackets()
            elif letter == "(":
                part = self.group()
            elif letter == ")":
                if len(self.many_lines) == 1:
                    self.refuse("a bracket that closes nothing")
                self.many_lines.pop()
                part = ")"
            elif letter == "$":
                part = r"(?=\n|\z)" if self.many_lines[-1] else r"\z"
            elif letter == "^":
                part = r"(?:\A|(?<=\n))" if self.many_lines[-1] else r"\A"
            elif letter == "+" and (last in ("*", "+", "?") or last.startswith("{")):
                self.refuse("possessive quantifiers")
            elif letter == "{":
                found = re.compile(r"(\d+(?:,\d*)?)\}").match(self.pattern, self.at)
                if not found:
                    self.refuse("a brace that is no count")
                self.at, part = found.end(), "{" + found[1] + "}"
            else:
                part = letter
            if part:
                self.out.append(part)
        if len(self.many_lines) > 1:
            self.refuse("an open group")
        return "".join(self.out)


def java_pattern(pattern: str, case_insensitive: bool = False, dot_matches_new_line: bool = False) -> str:
    flags = f"{'i' if case_insensitive else ''}{'u' if case_insensitive else ''}{'s' if dot_matches_new_line else ''}"
    return f"(?Ud{flags}){Reader(pattern).read()}"


def check(pattern: str) -> None:
    """Raises ``ValueError`` for a translated pattern that the JVM does not compile, or that matches the
    empty text (its markers would never come to an end)."""
    from pyspark import SparkContext
    from pyspark.errors import IllegalArgumentException

    from lustrate.session import local_session

    context = SparkContext._active_spark_context or local_session(1).sparkContext
    try:
        compiled = context._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException as e:
        raise ValueError(f"not a pattern: {e}") from e
    if compiled.matcher("").find():
        raise ValueError("a policy pattern must not match the empty text")


def touching(pattern: str) -> str:
    """One match for a run of matches that touch. The possessive form needs no stack for each repeat."""
    return f"(?:{pattern})++"


def replacement(text: str) -> str:
    """``text`` as a literal replacement string."""
    return text.replace("\\", "\\\\").replace("$", "\\$")
