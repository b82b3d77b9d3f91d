r"""Literals that a pattern needs: any match contains one of them.

Patterns come from ``dialect.java_pattern``. What is not understood adds nothing, so the answer errs only
towards None (no literal is known and the pattern must be tried on every text).
"""

from __future__ import annotations

import re

#: Letters that a literal needs to be of use, and literals of a pattern at most.
SHORTEST, MOST = 3, 64
ATOM = re.compile(r"\\x\{([0-9A-Fa-f]+)\}|\\x([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\[pP]\{[^}]*\}|\\([^0-9A-Za-z])|\\.|\(\?[a-zA-Z-]*\)|([^\\\[\](){}|*+?.^$])|[.^$]", re.S)
COUNT = re.compile(r"(?:\*|\+|\?|\{(\d+)(?:,\d*)?\})[?+]?")


class Reader:
    def __init__(self, pattern: str, shortest: int):
        self.pattern, self.at, self.shortest = pattern, 0, shortest

    def class_end(self) -> None:
        """Passes over a class in brackets, nested ones included."""
        depth, p = 0, self.pattern
        while True:
            letter = p[self.at]
            self.at += 2 if letter == "\\" else 1
            depth += (letter == "[") - (letter == "]")
            if not depth:
                return

    def alternatives(self) -> frozenset[str] | None:
        """Any match of what follows, up to a closing bracket, contains one of these."""
        found: list[frozenset[str] | None] = [self.branch()]
        while self.pattern.startswith("|", self.at):
            self.at += 1
            found.append(self.branch())
        return None if None in found else frozenset().union(*found)

    def branch(self) -> frozenset[str] | None:
        """The best of the literals that all matches of a sequence contain."""
        run, best = "", None

        def offer(some: frozenset[str] | None) -> None:
            nonlocal best
            if some and len(some) <= MOST and min(map(len, some)) >= self.shortest and (best is None or min(map(len, some)) > min(map(len, best))):
                best = some

        while self.at < len(self.pattern) and self.pattern[self.at] not in "|)":
            letter, inner, opened = None, None, self.pattern[self.at]
            if opened == "[":
                self.class_end()
            elif opened == "(" and not ATOM.match(self.pattern, self.at):
                start = re.compile(r"\((?:\?(?:[a-zA-Z-]*:|<?[=!]))?").match(self.pattern, self.at)
                self.at = start.end()
                inner = self.alternatives()
                self.at += 1
                if start[0].endswith(("=", "!")):
                    inner = None
            else:
                m = ATOM.match(self.pattern, self.at)
                if not m:
                    raise ValueError(self.pattern[self.at :])
                self.at = m.end()
                code = m[1] or m[2] or m[3]
                letter = chr(int(code, 16)) if code else m[4] or m[5]
            count = COUNT.match(self.pattern, self.at)
            least = 1
            if count:
                self.at = count.end()
                least = int(count[1]) if count[1] else int(count[0][0] == "+")
            if letter is not None and least:
                run += letter  # repeated or not, one stands here
            if letter is None or count:
                offer(frozenset([run]) if run else None)
                run = letter if letter is not None and least == 1 and count[0][0] == "+" else ""
            if letter is None and least:
                offer(inner)
        offer(frozenset([run]) if run else None)
        return best


def required(pattern: str, shortest: int = SHORTEST) -> list[str] | None:
    """Literals of which every match of ``pattern`` contains one, or None."""
    if any("i" in flags.partition("-")[0] for flags in re.findall(r"\(\?([a-zA-Z-]*)[:)]", pattern)):
        return None
    try:
        found = Reader(pattern, shortest).alternatives()
    except (ValueError, IndexError):
        return None
    return sorted(found) if found else None


def trie_pattern(words: list[str]) -> str:
    """A pattern that gives, at each place, the longest of ``words`` that begins there (as group 1)."""
    root: dict = {}
    for word in words:
        node = root
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def write(node: dict) -> str:
        if list(node) == [""]:
            return ""
        arms = [quoted(letter) + write(node[letter]) for letter in sorted(node, reverse=True) if letter]
        body = arms[0] if len(arms) == 1 and "" not in node else f"(?:{'|'.join(arms)})"
        return body + ("?+" if "" in node else "")

    first = "".join(quoted(letter) for letter in sorted(root))
    return f"(?=([{first}]))" if all(list(n) == [""] for n in root.values()) else f"(?=[{first}])(?=({write(root)}))"


def quoted(letter: str) -> str:
    return letter if letter.isalnum() else rf"\x{{{ord(letter):x}}}"
