"""TypeScript, Go and C++ source text to definitions and calls, by matched brackets.

The rows are those of ``python_source``, so that ``python_source.resolve`` makes the graph of each language.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from codeloom.operators.graph import Graph

from . import python_source as base
from .tokens import Tokens


@dataclass(frozen=True)
class Language:
    """What differs between the languages."""

    name: str
    extensions: tuple[str, ...]
    scopes: frozenset[str]
    decisions: frozenset[str]
    loops: frozenset[str]
    not_calls: frozenset[str]


_COMMON = frozenset("if for while switch return catch sizeof new delete function throw typeof await else do case".split())
LANGUAGES = {
    "typescript": Language("typescript", ("ts", "tsx", "mts", "cts"), frozenset(["class", "namespace", "interface"]), frozenset("if for while do case catch".split()), frozenset("for while do".split()), _COMMON | frozenset("super import constructor".split())),
    "go": Language("go", ("go",), frozenset(), frozenset("if for case".split()), frozenset(["for"]), _COMMON | frozenset("func go defer select range map chan make len append cap panic recover".split())),
    "cpp": Language("cpp", ("cpp", "cc", "cxx", "c++", "h", "hpp", "hh", "hxx"), frozenset("namespace class struct".split()), frozenset("if for while do case catch".split()), frozenset("for while do".split()), _COMMON | frozenset("alignof decltype static_assert noexcept operator static_cast dynamic_cast const_cast reinterpret_cast".split())),
}


def language_of(path: str) -> str | None:
    """The language of a file of these three by its extension."""
    extension = path.rsplit(".", 1)[-1]
    return next((x.name for x in LANGUAGES.values() if extension in x.extensions), None)


def module_of(path: str) -> str:
    """The place of a file with ``::`` between its parts, below ``src``; an index file is its directory."""
    parts = [re.sub(r"[-. ]", "_", x) for x in re.sub(r"\.[^./]+$", "", path).strip("/").split("/")]
    if "src" in parts[:-1]:
        parts = parts[parts.index("src") + 1 :]
    return "::".join(parts[:-1] if parts[-1] == "index" and len(parts) > 1 else parts)


class BraceFile:
    """The definitions and calls of one file."""

    def __init__(self, path: str, text: str, language: Language | None = None):
        self.path, self.t, self.defs, self.calls = path, Tokens(text or ""), [], []
        found = language or LANGUAGES.get(language_of(path) or "")
        if found is None:
            return
        self.language = found
        package = re.search(r"^\s*package\s+(\w+)", self.t.text, re.M) if found.name == "go" else None
        self.scope(0, len(self.t), package[1] if package else module_of(path), False)

    def scope(self, k: int, end: int, inside: str, in_class: bool) -> None:
        t, go = self.t, self.language.name == "go"
        start = k
        while k < end:
            w = t.word(k)
            if w in self.language.scopes and t.is_name(k + 1) and t.word(k - 1) not in ("enum", "<", ",", "typename") and (b := t.block(k + 1, end, ";(")) is not None:
                names = [t.word(k + 1)]
                x = k + 2
                while t.word(x) == "::" and t.is_name(x + 1):
                    names.append(t.word(x + 1))
                    x += 2
                close = t.match.get(b, end)
                self.scope(b + 1, close, "::".join([inside, *names]), w not in ("namespace",))
                k = start = close + 1
                continue
            found = self.go_function(k, end) if go else self.function_at(k, end, in_class)
            if found is not None:
                name, owner, params, body = found
                close = t.match.get(body, end - 1)
                scope = f"{inside}::{owner}" if owner else inside
                self.function(name, scope, in_class or bool(owner), set(t.words[start:k]), k, params, body, close)
                k = start = close + 1
                continue
            if w in (";", "}"):
                start = k + 1
            k = self.skip(k, in_class, go)

    def skip(self, k: int, in_class: bool, go: bool) -> int:
        """The next place: brackets that hold no definitions are passed."""
        return self.t.match[k] + 1 if self.t.word(k) in "([" and k in self.t.match else k + 1

    def go_function(self, k: int, end: int) -> tuple[str, str, int, int] | None:
        t = self.t
        if t.word(k) != "func":
            return None
        owner, x = "", k + 1
        if t.word(x) == "(":
            close = t.match.get(x, x)
            names = [t.word(y) for y in range(x + 1, close) if t.is_name(y)]
            owner, x = (names[1] if len(names) > 1 else names[0] if names else ""), close + 1
        if not t.is_name(x):
            return None
        name, x = t.word(x), x + 1
        if t.word(x) == "[":
            x = t.match.get(x, x) + 1
        b = t.block(t.match.get(x, x) + 1, end, ";") if t.word(x) == "(" else None
        return None if b is None or t.line(t.starts[b]) > t.line(t.ends[t.match[x]]) + 3 else (name, owner, x, b)

    def function_at(self, k: int, end: int, in_class: bool) -> tuple[str, str, int, int] | None:
        """(name, owner, bracket of the parameters, brace of the body) of a function whose name is at ``k``."""
        t, cpp = self.t, self.language.name == "cpp"
        if not t.is_name(k) or t.word(k) in self.language.not_calls - {"constructor"}:
            return None
        x = k + 1
        if t.word(x) == "<":
            x = t.after_angles(x, end)
        if t.word(x) == "(" and x in t.match:
            before = t.word(k - 1)
            if not cpp and before != "function" and not in_class:
                return None
            after = t.match[x] + 1
            b = self.body(after, end)
            if b is None or before in (".", "new", "=", "return", "->"):
                return None
            owner = t.word(k - 2) if cpp and before == "::" else ""
            return t.word(k), owner, x, b
        if cpp:
            return None
        # name = (..) => {..}, name = function (..) {..}
        if t.word(x) == ":":
            x = next((y for y in range(x, min(x + 40, end)) if t.word(y) in ("=", ";", "{")), x)
        if t.word(x) == "=":
            y = x + 1 + (t.word(x + 1) == "async")
            y += t.word(y) == "function"
            if t.word(y) == "(" and y in t.match:
                after = t.match[y] + 1
                b = self.body(after, end)
                if b is not None and (t.word(y - 1) == "function" or "=>" in t.words[after:b]):
                    return t.word(k), "", y, b
        return None

    def body(self, k: int, end: int) -> int | None:
        """The brace of a body right after a signature, past types, qualifiers and initialisers."""
        t, first = self.t, k
        while k < end and k < first + 60:
            w = t.word(k)
            if w == "{":
                return k
            if w in (";", ")", "}", ",", "=", ".") or w in ("&&", "||", "?", "0", "+", "-", "<<"):
                return None
            k = t.match.get(k, k) + 1 if w in "([" else k + 1
        return None

    def function(self, name: str, scope: str, method: bool, header: set[str], k: int, params: int, body: int, close: int) -> None:
        t, own = self.t, f"{scope}::{name}"
        words, decisions, returns, awaits, deepest, depth = t.words, 0, 0, 0, 0, 0
        loops = []
        x = body + 1
        while x < close:
            w = words[x]
            decisions += w in self.language.decisions or (w in ("&&", "||")) or (w == "?" and t.word(x + 1) not in (".", ":"))
            returns += w == "return"
            awaits += w == "await"
            if w in self.language.loops and (b := t.block(x + 1, close, "}")) is not None:
                loops.append((b, t.match.get(b, close)))
            depth += (w == "{") - (w == "}")
            deepest = max(deepest, depth)
            if t.is_name(x) and w not in self.language.not_calls:
                y = t.after_angles(x + 1, close) if self.language.name != "go" and t.word(x + 1) == "<" and ">" in words[x + 1 : x + 8] else x + 1
                if t.word(y) == "(" and t.word(x - 1) not in ("function", "func"):
                    before = t.word(x - 1)
                    kind = "associated_call" if before in ("new", "::") else "method_call" if before in (".", "->") else "direct_call"
                    self.calls.append((self.path, own, scope, w, kind, any(a < x < z for a, z in loops), t.line(t.starts[x])))
            x += 1
        first, last = t.line(t.starts[k]), t.line(t.starts[min(close, len(t) - 1)])
        lang = self.language.name
        public = name[:1].isupper() if lang == "go" else lang == "cpp" or "export" in header or (method and not {"private", "protected"} & header)
        tested = name.startswith(("Test", "Benchmark")) if lang == "go" else name.startswith("test") or bool(re.search(r"\.(test|spec)\.", self.path))
        n = len(t.commas(params + 1, t.match.get(params, params)))
        self.defs.append((self.path, len(self.defs), name, own, scope, "method" if method else "function", first, last, public, "async" in header or t.word(k - 1) == "async", tested, decisions, n, last - first + 1, deepest, awaits, returns))
        if lang != "go":
            self.nested(body + 1, close, own)

    def nested(self, k: int, end: int, own: str) -> None:
        """Named functions inside a body."""
        t = self.t
        while k < end:
            found = self.function_at(k, end, False) if self.language.name == "typescript" else None
            if found is not None:
                name, _, params, body = found
                close = t.match.get(body, end)
                self.function(name, own, False, set(), k, params, body, close)
                k = close
            k += 1


def definitions(sources: DataFrame) -> DataFrame:
    """Definitions of each (path, text); files of other languages have none."""
    return base.extract(sources, BraceFile, {"defs": base.DEFS})[0]


def raw_calls(sources: DataFrame) -> DataFrame:
    return base.extract(sources, BraceFile, {"calls": base.CALLS})[0]


def graph(sources: DataFrame) -> Graph:
    return base.resolve(*base.extract(sources, BraceFile, {"defs": base.DEFS, "calls": base.CALLS}, keep=True))
