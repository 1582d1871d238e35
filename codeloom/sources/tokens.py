"""Tokens of languages with braces: comments and literals are blanked, brackets are matched."""

from __future__ import annotations

import re
from bisect import bisect_right

_WORD = r"(?:r#)?[^\W\d]\w*"
_TOKEN = re.compile(_WORD + r"|\d[\w.]*|::|=>|->|&&|\|\||\.\.=|\.\.\.|\.\.|[=!<>]=|\S")
_OPEN = {"(": ")", "[": "]", "{": "}"}
#: What blanking looks for: comments, raw strings, strings, characters, lifetimes.
_RUST = re.compile(r"""(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<raw>b?r(?P<hash>\#*)")|(?P<str>b?"(?:\\.|[^"\\])*")|(?P<char>b?'(?:\\(?:x..|u\{[^}]*\}|.)|[^'\\\n])')|(?P<life>'\w+)""", re.S)
_OTHER = re.compile(r"""(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<str>"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])*')""", re.S)


def _spaces(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def _blank(text: str) -> str:
    """A literal as one operand of the same length."""
    return "0" + _spaces(text[1:])


def blank(text: str, rust: bool) -> tuple[str, list[tuple[int, int]]]:
    """(text of the same length without comments and literals, the places of comments)."""
    out, comments, at = [], [], 0
    pattern = _RUST if rust else _OTHER
    while (m := pattern.search(text, at)) is not None:
        out.append(text[at : m.start()])
        end = m.end()
        if rust and m["block"]:
            depth = 1
            while depth and (n := re.compile(r"/\*|\*/").search(text, end)):
                depth += 1 if n[0] == "/*" else -1
                end = n.end()
            end = len(text) if depth else end
        elif rust and m["raw"] is not None:
            close = text.find('"' + m["hash"], end)
            end = len(text) if close < 0 else close + 1 + len(m["hash"])
        piece = text[m.start() : end]
        if m["line"] or m["block"]:
            comments.append((m.start(), end))
            out.append(_spaces(piece))
        elif rust and m["life"]:
            out.append(_spaces(piece))
        else:
            out.append(_blank(piece))
        at = end
    return "".join(out) + text[at:], comments


class Tokens:
    """The tokens of a text with their places and the matching bracket of each bracket."""

    def __init__(self, text: str, rust: bool = False):
        self.raw = text
        self.text, self.comments = blank(text, rust)
        found = list(_TOKEN.finditer(self.text))
        self.words = [m[0] for m in found]
        self.starts = [m.start() for m in found]
        self.ends = [m.end() for m in found]
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for k, w in enumerate(self.words):
            if w in _OPEN:
                stack.append(k)
            elif w in ")]}":
                while stack and _OPEN[self.words[stack[-1]]] != w:
                    stack.pop()
                if stack:
                    k0 = stack.pop()
                    self.match[k0], self.match[k] = k, k0

    def __len__(self) -> int:
        return len(self.words)

    def word(self, k: int) -> str:
        return self.words[k] if 0 <= k < len(self.words) else ""

    def line(self, pos: int) -> int:
        return bisect_right(self.lines, pos)

    def column(self, pos: int) -> int:
        """Bytes before a place in its line."""
        return len(self.raw[self.lines[self.line(pos) - 1] : pos].encode())

    def is_name(self, k: int) -> bool:
        return re.fullmatch(_WORD, self.word(k)) is not None

    def block(self, k: int, end: int, stop: str = ";") -> int | None:
        """The next ``{`` from ``k`` outside other brackets, or None if ``stop`` or the end comes first."""
        while k < end:
            w = self.words[k]
            if w == "{":
                return k
            if w in stop:
                return None
            k = self.match.get(k, k) + 1 if w in "([" else k + 1
        return None

    def after_angles(self, k: int, end: int) -> int:
        """The place after ``<...>`` that begins at ``k``."""
        depth = 0
        while k < end:
            w = self.words[k]
            if w in "([{" and k in self.match:
                k = self.match[k]
            elif w == "<":
                depth += 1
            elif w == ">":
                depth -= 1
                if not depth:
                    return k + 1
            k += 1
        return end

    def commas(self, k: int, end: int) -> list[tuple[int, int]]:
        """The parts between commas outside brackets."""
        parts, start, angles = [], k, 0
        while k < end:
            w = self.words[k]
            if w in "([{" and k in self.match:
                k = self.match[k]
            elif w == "<":
                angles += 1
            elif w == ">":
                angles = max(0, angles - 1)
            elif w == "," and not angles:
                parts.append((start, k))
                start = k + 1
            k += 1
        return [*parts, (start, end)] if start < end else parts
