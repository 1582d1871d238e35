"""Rust source text to a call graph: a tolerant scan of each file, then resolution by joins.

Nothing is parsed in full: scopes, signatures and calls are read off matched brackets, and what cannot be told
is left out, as a wrong edge is worse than a missing one. Files are independent, so extraction is one pass;
only names, qualifiers and owners are shuffled.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.operators.graph import Graph, merge_edges
from codeloom.operators.iterate import _cut

from .python_source import extract
from .tokens import Tokens

FLAGS = ["is_pub", "is_async", "is_unsafe", "is_test", "is_method", "is_generic", "is_exported", "is_trait_impl"]
STATS = ["lines_of_code", "decision_points", "parameters", "statements", "max_nesting", "returns", "unsafe_blocks", "allocations", "awaits"]
DEFS = "file string, ord int, name string, qualified_name string, module_path string, kind string, start_line int, end_line int, " + ", ".join(f"{x} boolean" for x in FLAGS) + ", " + ", ".join(f"{x} int" for x in STATS)
CALLS = "file string, ord int, caller string, module string, kind string, path string, short string, receiver string, line int, col int, in_loop boolean, blocking_ok boolean, awaited boolean"

KEYWORDS = {"if", "while", "match", "for", "return", "in", "fn", "let", "loop", "move", "as", "unsafe", "else", "mut", "ref", "impl", "where", "dyn", "pub", "use", "break", "continue", "async", "await", "const", "static", "struct", "enum", "type", "mod", "trait", "extern"}
#: Calls that allocate, by macro, name or path.
ALLOC_MACROS = {"vec", "format"}
ALLOC_NAMES = {"clone", "to_owned", "to_vec", "to_string"}
ALLOC_PATHS = {"Box::new", "Rc::new", "Arc::new", "Vec::new", "Vec::with_capacity", "Vec::from", "String::new", "String::from", "HashMap::new", "BTreeMap::new", "HashSet::new"}
#: Methods whose closure runs for each element, always or on what looks like an iterator.
EACH = {"retain", "retain_mut", "sort_by", "sort_by_key", "sort_unstable_by", "sort_unstable_by_key", "dedup_by", "dedup_by_key", "for_each", "try_for_each", "par_iter", "for_each_concurrent"}
EACH_OF_ITERATOR = {"map", "filter", "filter_map", "flat_map", "fold", "try_fold", "any", "all", "find", "find_map", "position", "inspect", "take_while", "skip_while", "map_while", "scan", "partition", "max_by_key", "min_by_key", "max_by", "min_by", "sum_by", "group_by"}
ITERATORS = [".iter()", ".iter_mut()", ".into_iter()", ".par_iter()", ".into_par_iter()", ".chars()", ".bytes()", ".lines()", ".keys()", ".values()", ".values_mut()", ".drain(", ".windows(", ".chunks(", ".split(", ".enumerate()", ".."]
#: Attributes that mark a test.
TEST_ATTRIBUTES = {"test", "bench", "rstest", "test_case", "quickcheck"}
#: Names that so many library types have that a call by name alone tells nothing; a parameter of ``resolve``.
UBIQUITOUS = """expect unwrap unwrap_or unwrap_or_else unwrap_or_default map map_err map_or and_then or_else and or ok err ok_or is_some is_none is_ok is_err take replace filter flatten copied cloned as_deref zip
iter iter_mut into_iter next next_back collect fold for_each find find_map filter_map flat_map any all count sum product min max position enumerate rev skip chain peekable peek last nth windows chunks scan partition
get get_mut insert remove push push_str pop len is_empty clear contains contains_key extend append truncate retain drain sort sort_by dedup reverse first split join concat entry or_insert or_default keys values
starts_with ends_with trim lines chars bytes as_bytes parse with_capacity capacity reserve resize swap fill to_lowercase to_uppercase to_vec as_slice set
clone to_string to_owned as_ref as_mut as_str into try_into from try_from borrow borrow_mut deref default new fmt eq ne cmp hash drop build
write write_all read read_to_string flush send recv lock try_lock load store close poll wait call run start stop open
status headers header body json text query method uri url path to_str display exists parent elapsed""".split()


def module_path(path: str) -> str:
    """The crate before the last ``src`` and the modules below it; else the file's name."""
    clean = lambda x: re.sub(r"[-. ]", "_", x)
    parts = [x for x in path.split("/") if x not in ("", ".", "..")]
    if "src" not in parts:
        return clean(parts[-1].rsplit(".", 1)[0]) if parts else "crate"
    at = len(parts) - 1 - parts[::-1].index("src")
    below = parts[at + 1 :]
    stem = below[-1].removesuffix(".rs") if below else ""
    mods = [*below[:-1], *([] if stem in ("lib", "main", "mod", "") else [stem])]
    return "::".join([clean(parts[at - 1]) if at else "crate", *map(clean, mods)])


def is_test_attribute(attribute: str) -> bool:
    path, _, rest = attribute.partition("(")
    if path == "cfg":
        return "not(test" not in rest and re.search(r"\btest\b", rest) is not None
    return re.split("::|=", path)[-1 if "=" not in path else 0] in TEST_ATTRIBUTES


class _Counts:
    """How many of some ranges hold a place."""

    def __init__(self):
        self.ranges: list[tuple[int, int]] = []

    def add(self, start: int, end: int) -> None:
        self.ranges.append((start, end))

    def at(self, k: int) -> int:
        return sum(a <= k <= b for a, b in self.ranges)

    def deepest(self) -> int:
        return max((self.at(a) for a, _ in self.ranges), default=0)


class RustFile:
    """The definitions and calls of one file."""

    def __init__(self, path: str, text: str):
        self.path, self.t = path, Tokens(text or "", rust=True)
        self.defs: list[tuple] = []
        self.calls: list[tuple] = []
        self.taken: set[str] = set()
        self.fields = self._fields()
        self.items(0, len(self.t), module_path(path), False, False, None)

    def _fields(self) -> dict[tuple[str, str], str]:
        """The types of struct fields by (struct, field)."""
        t, found = self.t, {}
        for k in range(len(t)):
            if t.word(k) == "struct" and t.is_name(k + 1) and (b := t.block(k + 2, len(t))) is not None and b in t.match:
                for start, end in t.commas(b + 1, t.match[b]):
                    for c in range(start, end):
                        if t.word(c) == ":" and t.is_name(c - 1):
                            found[t.word(k + 1), t.word(c - 1)] = self.base_type(c + 1, end)
                            break
        return {k: v for k, v in found.items() if v}

    def base_type(self, k: int, end: int) -> str:
        """The path of a type without references, generics and bounds; empty for what has no name."""
        t = self.t
        while k < end and t.word(k) in ("&", "mut", "dyn", "&&"):
            k += 1
        parts = []
        while k < end and t.is_name(k) and t.word(k) not in KEYWORDS:
            parts.append(t.word(k))
            if t.word(k + 1) != "::":
                break
            k += 2
        return "::".join(parts)

    # Items

    def items(self, k: int, end: int, scope: str, in_test: bool, trait_impl: bool, self_ty: str | None) -> None:
        t, attributes, start = self.t, [], None
        while k < end:
            w = t.word(k)
            if w == "#" and t.word(k + 1) in ("[", "!"):
                b = k + 1 if t.word(k + 1) == "[" else k + 2
                close = t.match.get(b, b)
                if t.word(k + 1) == "[":
                    attributes.append("".join(t.words[b + 1 : close]))
                    start = k if start is None else start
                k = close + 1
                continue
            if w in ("pub", "async", "unsafe", "const", "extern", "default") or (w == "(" and t.word(k - 1) == "pub") or (w == "0" and t.word(k - 1) == "extern"):
                start = k if start is None else start
                k = t.match.get(k, k) + 1 if w == "(" else k + 1
                continue
            if w == "macro_rules" and t.word(k + 1) == "!":
                b = next((x for x in range(k + 2, min(k + 5, end)) if t.word(x) in "({["), k)
                k = t.match.get(b, b) + 1
            elif w == "mod" and t.is_name(k + 1) and t.word(k + 2) == "{":
                close = t.match.get(k + 2, end)
                self.items(k + 3, close, f"{scope}::{t.word(k + 1)}", in_test or any(map(is_test_attribute, attributes)), False, None)
                k = close + 1
            elif w in ("impl", "trait") and (b := t.block(k + 1, end)) is not None:
                close = t.match.get(b, end)
                name, of_trait = (t.word(k + 1), False) if w == "trait" else self.impl_type(k + 1, b)
                inner = f"{scope}::{name}" if name else scope
                self.items(b + 1, close, inner, in_test or (w == "impl" and any(map(is_test_attribute, attributes))), of_trait, name or None)
                k = close + 1
            elif w == "fn" and t.is_name(k + 1):
                k = self.function(k, k if start is None else start, end, attributes, scope, in_test, trait_impl, self_ty)
            else:
                k += 1
            attributes, start = [], None

    def impl_type(self, k: int, b: int) -> tuple[str, bool]:
        t = self.t
        if t.word(k) == "<":
            k = t.after_angles(k, b)
        depth, at = 0, k
        for x in range(k, b):
            depth += (t.word(x) == "<") - (t.word(x) == ">")
            if t.word(x) == "for" and depth == 0 and t.word(x + 1) != "<":
                at = x + 1
        return self.base_type(at, b).split("::")[-1], at != k

    def function(self, fn: int, start: int, end: int, attributes: list[str], scope: str, in_test: bool, trait_impl: bool, self_ty: str | None) -> int:
        t, name = self.t, self.t.word(fn + 1)
        k = fn + 2
        generics = set()
        if t.word(k) == "<":
            after = t.after_angles(k, end)
            generics = {t.word(a) for a, _ in t.commas(k + 1, after - 1)}
            k = after
        close = t.match.get(k, k)
        params = t.commas(k + 1, close) if t.word(k) == "(" else []
        method = bool(params) and any(t.word(x) == "self" for x in range(*params[0])) and ":" not in t.words[params[0][0] : params[0][1]][:1]
        b = t.block(close + 1, end)
        stop = next((x for x in range(close + 1, end) if t.word(x) == ";"), end) if b is None else t.match.get(b, end - 1)
        header = set(t.words[start:fn])
        own = f"{scope}::{name}"
        tested = in_test or any(map(is_test_attribute, attributes)) or name.startswith("test_") or bool({"tests", "test"} & set(scope.split("::")))
        exported = b is not None and ("extern" in header or any("no_mangle" in a or "export_name" in a for a in attributes))
        flags = ["pub" in header, "async" in header, "unsafe" in header, tested, method, bool(generics), exported, trait_impl]
        first, last = t.line(t.starts[fn if start > fn else self.signature(start, fn)]), t.line(t.starts[min(stop, len(t) - 1)])
        body = _Body(self, own, scope, self_ty, generics)
        if b is not None:
            for a, z in params:
                body.param(a, z)
            body.scan(b + 1, stop)
        stats = [last - first + 1, body.decisions, len(params) - method, body.statements, body.nest.deepest(), body.returns, body.unsafe_blocks, body.allocations, body.awaits]
        place = len(self.defs)
        self.defs.append((self.path, place, name, own, scope, "method" if method else "function", self.first_line(start), last, *flags, *stats))
        for name2, line, line2 in body.spawned:
            self.defs.append((self.path, len(self.defs), name2, f"{own}::{name2}", own, "closure", line, line2, *[False] * len(FLAGS), line2 - line + 1, *[0] * (len(STATS) - 1)))
        for a, z in body.inner:
            self.items(a, z, own, tested, False, None)
        return stop + 1

    def signature(self, start: int, fn: int) -> int:
        """The first token of the signature after its attributes."""
        t, k = self.t, start
        while k < fn and t.word(k) == "#":
            b = k + 1 if t.word(k + 1) == "[" else k + 2
            k = t.match.get(b, b) + 1
        return k

    def first_line(self, start: int) -> int:
        """The line where a definition begins, with the comments right above it."""
        t, pos = self.t, self.t.starts[start]
        for a, z in reversed(t.comments):
            if z <= pos:
                if t.raw[z:pos].strip():
                    break
                pos = a
        return t.line(pos)


class _Body:
    """The statistics and calls of one function's body; nested functions are left to themselves."""

    def __init__(self, file: RustFile, own: str, scope: str, self_ty: str | None, generics: set[str]):
        self.file, self.t, self.own, self.scope, self.self_ty, self.generics = file, file.t, own, scope, self_ty, generics
        self.nest, self.loops, self.exempt = _Counts(), _Counts(), _Counts()
        self.decisions = self.statements = self.returns = self.unsafe_blocks = self.allocations = self.awaits = 0
        self.locals: set[str] = set()
        self.types: dict[str, str | None] = {}
        self.inner: list[tuple[int, int]] = []
        self.spawned: list[tuple[str, int, int]] = []
        self.owners: list[tuple[int, int, str]] = []

    def learn(self, name: str, kind: str) -> None:
        """The type of a local name; names of several types are of none."""
        self.locals.add(name)
        if kind.split("::")[0] in self.generics:
            kind = ""
        kind = self.self_ty or "" if kind == "Self" else kind
        self.types[name] = kind if self.types.get(name, kind) == kind else ""

    def param(self, a: int, z: int) -> None:
        t = self.t
        colon = next((x for x in range(a, z) if t.word(x) == ":"), None)
        if colon is not None and t.is_name(colon - 1):
            self.learn(t.word(colon - 1), self.file.base_type(colon + 1, z))

    def scan(self, k: int, end: int) -> None:
        t = self.t
        first = k
        # Bindings first, as calls need them.
        for x in range(k, end):
            if t.word(x) == "let":
                self.binding(x + 1, end)
            elif t.word(x) == "|" and t.word(x - 1) in ("(", ",", "=", "move", "=>", "{", ";", "return"):
                close = next((y for y in range(x + 1, end) if t.word(y) == "|"), x)
                self.locals |= {t.word(y) for y in range(x + 1, close) if t.is_name(y)}
        while k < end:
            w = t.word(k)
            if w == "fn" and t.is_name(k + 1):
                b = t.block(k + 2, end)
                stop = t.match.get(b, end) if b is not None else k + 1
                self.inner.append((k, stop + 1))
                k = stop + 1
                continue
            if w in ("impl", "mod", "trait") and t.word(k - 1) in ("{", "}", ";", "]") and (b := t.block(k + 1, end)) is not None:
                self.inner.append((k, t.match.get(b, end) + 1))
                k = t.match.get(b, end) + 1
                continue
            self.keyword(k, w, end)
            if w == ";" and self.in_braces(k, first):
                self.statements += 1
            if t.word(k + 1) == "!" and t.is_name(k) and t.word(k + 2) in ("(", "[", "{") and w not in KEYWORDS:
                path = self.path_to(k)
                self.call(k, "macro_call", "::".join(path), w, None)
                self.allocations += w in ALLOC_MACROS
                close = t.match.get(k + 2, k + 2)
                self.macro(k + 3, close)
                k = close + 1
                continue
            if t.is_name(k) and w not in KEYWORDS and (opened := self.opened(k, end)) is not None and t.word(k - 1) not in ("fn", "struct", "enum"):
                self.named(k, opened)
            k += 1

    def in_braces(self, k: int, first: int) -> bool:
        """Whether the innermost bracket around a place is a brace."""
        depth = 0
        for x in range(k - 1, first - 1, -1):
            w = self.t.word(x)
            if w in ")]}":
                depth += 1
            elif w in "([{":
                if not depth:
                    return w == "{"
                depth -= 1
        return True

    def operand(self, k: int) -> bool:
        w = self.t.word(k)
        return w in (")", "]", "}", "0", "?") or (re.match(r"\w", w) is not None and w not in KEYWORDS - {"await"})

    def keyword(self, k: int, w: str, end: int) -> None:
        t = self.t
        if w == "if":
            self.decisions += 1
            self.nest.add(k, self.chain_end(k, end))
        elif w in ("match", "while", "loop") or (w == "for" and t.word(k + 1) != "<"):
            b = t.block(k + 1, end)
            if b is None:
                return
            close = t.match.get(b, end)
            self.nest.add(k, close)
            if w != "match":
                self.decisions += 1
                self.loops.add(b if w == "for" else k, close)
        elif w == "=>":
            self.decisions += 1
        elif w in ("&&", "||"):
            self.decisions += self.operand(k - 1)
        elif w == "?":
            self.decisions += self.operand(k - 1) and t.word(k + 1) != "Sized"
        elif w == "return":
            self.returns += 1
        elif w == "await" and t.word(k - 1) == ".":
            self.awaits += 1
        elif w == "unsafe" and t.word(k + 1) == "{":
            self.unsafe_blocks += 1
            self.nest.add(k, t.match.get(k + 1, end))

    def chain_end(self, k: int, end: int) -> int:
        """The end of an ``if`` with its ``else`` parts."""
        t = self.t
        b = t.block(k + 1, end)
        if b is None:
            return k
        close = t.match.get(b, end)
        if t.word(close + 1) != "else":
            return close
        return self.chain_end(close + 2, end) if t.word(close + 2) == "if" else t.match.get(close + 2, close + 2)

    def binding(self, k: int, end: int) -> None:
        """A ``let``: its name, with the type as written or as its constructor tells."""
        t = self.t
        k += t.word(k) == "mut"
        if not t.is_name(k):
            stop = next((x for x in range(k, end) if t.word(x) in ("=", ";")), k)
            self.locals |= {t.word(x) for x in range(k, stop) if t.is_name(x)}
            return
        name = t.word(k)
        if t.word(k + 1) == ":":
            self.learn(name, self.file.base_type(k + 2, end))
        elif t.word(k + 1) == "=" and t.is_name(k + 2):
            path = self.file.base_type(k + 2, end).split("::")
            after = k + 2 + 2 * len(path) - 1
            made = len(path) > 1 and t.word(after) == "(" and (path[-1] in ("new", "default", "from") or path[-1].startswith(("new_", "with_")))
            plain = made and t.word(t.match.get(after, after) + 1) in (";", "?")
            self.learn(name, "::".join(path[:-1]) if plain else path[0] if t.word(after) == "{" and path[0][:1].isupper() else "")
        else:
            self.learn(name, "")

    def opened(self, k: int, end: int) -> int | None:
        """The bracket of the arguments if a call begins at the name ``k``."""
        t = self.t
        if t.word(k + 1) == "(":
            return k + 1
        if t.word(k + 1) == "::" and t.word(k + 2) == "<":
            after = t.after_angles(k + 2, end)
            return after if t.word(after) == "(" else None
        return None

    def path_to(self, k: int) -> list[str]:
        t, parts = self.t, [self.t.word(k)]
        while t.word(k - 1) == "::" and t.is_name(k - 2):
            parts.insert(0, t.word(k - 2))
            k -= 2
        return parts

    def receiver(self, dot: int) -> tuple[str | None, str]:
        """(type if known, text) of what a method is called on."""
        t, k = self.t, dot - 1
        while k >= 0:
            if t.word(k) in (")", "]") and k in t.match:
                k = t.match[k] - 1
                if t.word(k) == ">":
                    return None, ""
                if t.is_name(k):
                    k -= 1
            elif t.word(k) == "?":
                k -= 1
                continue
            elif t.is_name(k) or t.word(k) in ("0", "..", "..=") or t.word(k)[:1].isdigit():
                k -= 1
            else:
                break
            if t.word(k) in (".", "::"):
                k -= 1
                continue
            if t.word(k) not in ("..", "..="):
                break
        words = t.words[k + 1 : dot]
        kind = None
        if words == ["self"]:
            kind = self.self_ty
        elif len(words) == 1:
            kind = self.types.get(words[0])
        elif len(words) == 3 and words[0] == "self" and words[1] == "." and self.self_ty:
            kind = self.file.fields.get((self.self_ty, words[2]))
        return kind or None, "".join(words)

    def named(self, k: int, opened: int) -> None:
        t, short = self.t, self.t.word(k)
        path = self.path_to(k)
        before = k - 2 * (len(path) - 1) - 1
        close = t.match.get(opened, opened)
        if t.word(before) == "." and len(path) == 1:
            kind, text = self.receiver(before)
            self.call(k, "method_call", short, short, kind, close)
            closure = any(t.word(a) in ("|", "||", "move") for a, _ in t.commas(opened + 1, close))
            if closure and (short in EACH or (short in EACH_OF_ITERATOR and any(x in text for x in ITERATORS))):
                self.loops.add(opened, close)
        elif len(path) == 1:
            if short in self.locals:
                return
            self.call(k, "direct_call", short, short, None, close)
        else:
            self.call(k, "associated_call", "::".join(path), short, self.self_ty if path[0] == "Self" else None, close)
        self.allocations += short in ALLOC_NAMES or "::".join(path) in ALLOC_PATHS
        if short == "block_in_place":
            self.exempt.add(opened, close)
        if short == "spawn" or short.startswith("spawn_"):
            self.spawn(opened + 1, close)

    def spawn(self, k: int, end: int) -> None:
        """Closures and async blocks among the arguments are functions of their own; a path is one that is started."""
        t = self.t
        for a, z in t.commas(k, end):
            if t.word(a) in ("|", "||", "move", "async"):
                line = t.line(t.starts[a])
                name = f"<spawned@L{line}>"
                n = 2
                while f"{self.own}::{name}" in self.file.taken:
                    name, n = f"<spawned@L{line}>#{n}", n + 1
                self.file.taken.add(f"{self.own}::{name}")
                self.spawned.append((name, line, t.line(t.starts[z - 1])))
                self.call(a, "spawn", f"{self.own}::{name}", name, None)
                self.owners.append((a, z, f"{self.own}::{name}"))
            elif t.is_name(a) and all(t.is_name(x) or t.word(x) == "::" for x in range(a, z)) and not (z - a == 1 and t.word(a) in self.locals):
                path = "".join(t.words[a:z])
                self.call(a, "spawn", path, path.split("::")[-1], None)

    def macro(self, k: int, end: int) -> None:
        """Methods on names of known types among a macro's arguments."""
        t = self.t
        for x in range(k, end):
            if t.word(x) == "." and t.is_name(x + 1) and t.word(x + 2) == "(":
                kind, _ = self.receiver(x)
                if kind:
                    self.call(x + 1, "method_call", t.word(x + 1), t.word(x + 1), kind)

    def call(self, k: int, kind: str, path: str, short: str, receiver: str | None, close: int | None = None) -> None:
        t = self.t
        caller = next((name for a, z, name in reversed(self.owners) if a <= k < z and kind != "spawn"), self.own)
        awaited = close is not None and t.word(close + 1) == "." and t.word(close + 2) == "await"
        pos = t.starts[k]
        self.file.calls.append((self.file.path, len(self.file.calls), caller, self.own if caller != self.own else self.scope, kind, path, short, receiver, t.line(pos), t.column(pos), self.loops.at(k) > 0, self.exempt.at(k) > 0, awaited))


def definitions(sources: DataFrame) -> DataFrame:
    """Definitions of each (path, text), spawned closures among them."""
    return extract(sources, RustFile, {"defs": DEFS})[0]


def raw_calls(sources: DataFrame) -> DataFrame:
    return extract(sources, RustFile, {"calls": CALLS})[0]


# Resolution


def _crate(path: str) -> Column:
    return F.substring_index(path, "::", 1)


def _qualifiers(path: str) -> Column:
    """The segments before the name that tell a scope."""
    parts = F.split(path, "::")
    return F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda x: ~x.isin("", "Self", "self", "super", "crate"))


def intern(defs: DataFrame) -> DataFrame:
    """One definition for each qualified name, the first, with its id, owner and segments."""
    first = Window.partitionBy("qualified_name").orderBy("file", "ord")
    rows = defs.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r").withColumn("node_id", F.xxhash64("qualified_name"))
    owner = F.element_at(F.split("module_path", "::"), -1)
    return rows.withColumn("owner", owner).withColumn("segments", F.split("qualified_name", "::")).withColumn("associated", owner.rlike("^[A-Z]"))


def _nearest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of several candidates of a call the nearest: its own body, module, crate, then the first declared."""
    rank = F.when(F.col("home") == F.col("caller"), 0).when(F.col("home") == F.col("module"), 1).when(_crate("home") == _crate("module"), 2).otherwise(3)
    return rows.withColumn("rank", rank).groupBy(*keys).agg(F.min(F.struct("rank", "def_file", "def_ord", "target")).alias("best"), F.count("*").alias("n")).select(*keys, F.col("best.target").alias("target"), F.col("best.rank").alias("rank"), "n")


def resolve(defs: DataFrame, calls: DataFrame, ubiquitous: list[str] | None = None, sees: DataFrame | None = None) -> Graph:
    """The call graph of definitions and raw calls.

    ``sees``: (crate, other), the crates that each may name; without it all may. Calls are resolved by their
    shapes (caller, kind, path, receiver), each once. Candidates meet by name and a qualifier, owner or place, so
    no common name is paired with all its definitions.
    """
    nodes = _cut(intern(defs))
    shape = ["caller", "module", "kind", "path", "short", "receiver"]
    shapes = _cut(calls.join(nodes.select(F.col("qualified_name").alias("caller")), "caller", "left_semi").select(*shape).distinct().withColumn("shape", F.xxhash64(*shape)))
    found = nodes.select(F.col("name").alias("short"), F.col("node_id").alias("target"), F.col("module_path").alias("home"), F.col("file").alias("def_file"), F.col("ord").alias("def_ord"), "is_method", "associated", "owner", "segments", "is_trait_impl")
    if sees is not None:
        seen = lambda rows: rows.join(sees.select(F.col("crate").alias("_from"), F.col("other").alias("_to")), (_crate("module") == F.col("_from")) & (_crate("home") == F.col("_to")), "left_semi")
    else:
        seen = lambda rows: rows
    open_ = shapes.where("kind <> 'macro_call'").withColumn("quals", F.when((F.col("kind") == "associated_call") & F.col("receiver").isNotNull(), F.array_append(_qualifiers("path"), F.element_at(F.split("receiver", "::"), -1))).when(F.col("kind") == "method_call", _qualifiers("receiver")).otherwise(_qualifiers("path")))
    parts = []
    # 0: the whole path is a definition's.
    exact = open_.where("kind <> 'method_call' and path like '%::%'").join(nodes.select(F.col("qualified_name").alias("path"), F.col("node_id").alias("target")), "path")
    parts.append(exact.select("shape", F.lit(0).alias("step"), "target"))
    # 1: a qualifier and the name meet the segments of a path.
    wanted = open_.where("kind in ('associated_call', 'spawn') and size(quals) > 0").withColumn("qual", F.element_at("quals", -1))
    by_segment = found.withColumn("qual", F.explode(F.array_distinct("segments")))
    hits = seen(wanted.join(by_segment, ["short", "qual"])).where(F.forall("quals", lambda q: F.array_contains("segments", q)))
    parts.append(_nearest(hits, ["shape"]).select("shape", F.lit(1).alias("step"), "target"))
    # 2: no qualifier: by name and place, from the nearest place outwards.
    bare = open_.where("kind in ('direct_call', 'associated_call', 'spawn') and size(quals) = 0")
    free = found.where("not is_method and not associated")
    first = F.min_by("target", F.struct("def_file", "def_ord")).alias("target")
    for kind, rows in (("path not like '%::%'", free), ("path like '%::%'", found)):
        calls_of = bare.where(kind)
        at = rows.groupBy("short", "home").agg(first)
        parts += [calls_of.join(at.withColumnRenamed("home", place), ["short", place]).select("shape", F.lit(step).alias("step"), "target") for step, place in ((2, "caller"), (3, "module"))]
        crate = rows.groupBy("short", _crate("home").alias("crate")).agg(first)
        parts.append(calls_of.withColumn("crate", _crate("module")).join(crate, ["short", "crate"]).select("shape", F.lit(4).alias("step"), "target"))
        anywhere = seen(calls_of.where("kind <> 'spawn'").join(rows.groupBy("short", _crate("home").alias("home")).agg(F.min(F.struct("def_file", "def_ord", "target")).alias("b")), "short"))
        parts.append(anywhere.groupBy("shape").agg(F.min("b").alias("b")).select("shape", F.lit(5).alias("step"), F.col("b.target").alias("target")))
    # 6: methods by the type of their receiver, 7: by a name that only one method has.
    methods = found.where("is_method")
    typed = open_.where("kind = 'method_call' and receiver is not null").withColumn("owner", F.element_at(F.split("receiver", "::"), -1))
    own = seen(typed.join(methods, ["short", "owner"])).where(F.forall("quals", lambda q: F.array_contains("segments", q)))
    parts.append(_nearest(own, ["shape"]).where("n = 1 or rank <= 2").select("shape", F.lit(6).alias("step"), "target"))
    known = typed.join(found.select("owner", F.explode(F.array_distinct("segments")).alias("qual")).distinct(), "owner").where("size(quals) = 0 or array_contains(quals, qual)").select("shape").distinct()
    loose = open_.where("kind = 'method_call' and receiver is null").select("shape", "short", "module").unionByName(typed.join(known, "shape", "left_semi").select("shape", "short", "module"))
    lone = methods.groupBy("short").agg(F.count("*").alias("n"), F.min("target").alias("target"), F.bool_or("is_trait_impl").alias("foreign"), F.min("home").alias("home")).where("n = 1 and not foreign")
    common = UBIQUITOUS if ubiquitous is None else ubiquitous
    parts.append(seen(loose.where(~F.col("short").isin(common)).join(lone, "short")).select("shape", F.lit(7).alias("step"), "target"))
    best = reduce(DataFrame.unionByName, parts).groupBy("shape").agg(F.min_by("target", "step").alias("target"))

    told = shapes.join(best, "shape", "left").where("kind <> 'spawn' or target is not null")
    copied = (F.col("kind") == "method_call") & F.col("short").isin("clone", "to_owned", "to_vec") & F.col("receiver").isNotNull()
    key = F.when(copied, F.concat(F.element_at(F.split("receiver", "::"), -1), F.lit("::"), "short")).when(F.col("path") == "", F.col("short")).otherwise(F.col("path"))
    told = _cut(told.withColumn("outer", F.when(F.col("target").isNull(), key)).withColumn("dst", F.coalesce("target", F.xxhash64(F.concat(F.lit("external "), key)))).withColumn("src", F.xxhash64("caller")))
    rows = calls.withColumn("shape", F.xxhash64(*shape)).select("shape", "line", "col", "in_loop", "blocking_ok", "awaited").join(told.select("shape", "src", "dst", F.when(F.col("target").isNull(), "unresolved").otherwise(F.col("kind")).alias("kind")), "shape").drop("shape")
    outer = told.where("outer is not null").select(F.col("dst").alias("node_id"), F.col("outer").alias("name")).distinct().select("node_id", "name", F.col("name").alias("qualified_name"), F.lit("").alias("module_path"), F.lit("external").alias("kind"))
    inner = nodes.drop("ord", "owner", "segments", "associated").withColumn("is_example", F.lit(False))
    zero = {**{x: False for x in [*FLAGS, "is_example"]}, **{x: 0 for x in [*STATS, "start_line", "end_line"]}}
    return Graph(inner.unionByName(outer, allowMissingColumns=True).fillna(zero), _cut(merge_edges(rows.withColumn("count", F.lit(1)))))


def rust_graph(sources: DataFrame) -> Graph:
    return resolve(*extract(sources, RustFile, {"defs": DEFS, "calls": CALLS}, keep=True))
