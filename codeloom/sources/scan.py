"""Where a graph comes from: files, languages, packages, configuration, and whether a stored graph still holds.

A repository is listed and its manifests are read on the driver, as they are small; its texts are read by Spark.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
import re
import shutil
import time
import tomllib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.graph import Graph

from . import brace_source, export, python_source, rust_source

#: Directories that are never read.
EXCLUDED = ["target", "node_modules", "dist", ".git"]
#: The languages in order, with their extensions.
LANGUAGES = {
    "rust": ["rs"],
    "typescript": ["ts", "tsx", "mts", "cts"],
    "python": ["py", "pyi"],
    "go": ["go"],
    "cpp": ["cpp", "cc", "cxx", "c++", "h", "hpp", "hh", "hxx"],
}
#: The source of each language: a graph of (path, text) rows.
ADAPTERS: dict[str, Callable[[DataFrame], Graph]] = {
    "rust": rust_source.rust_graph,
    "python": python_source.graph,
    "typescript": brace_source.graph,
    "go": brace_source.graph,
    "cpp": brace_source.graph,
}
EXTRACTOR = "1"
CONFIG_FILE = "codeloom.toml"


# Files


def _ignore_rules(folder: Path) -> list[tuple[re.Pattern, bool, bool]]:
    """(pattern of the path below the folder, negated, directories only) of each line of an ignore file."""
    at, rules = folder / ".gitignore", []
    if not at.is_file():
        return rules
    for line in at.read_text(errors="replace").splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line.removeprefix("!")
        only_dirs, line = line.endswith("/"), line.rstrip("/")
        anchored = "/" in line
        body = "".join({"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.findall(r"\*\*/|/\*\*|\*\*|\*|\?|[^*?/]+|/", line.lstrip("/")))
        rules.append((re.compile(("" if anchored else "(?:.*/)?") + body + r"\Z"), negated, only_dirs))
    return rules


def scan_files(root: str | Path, extensions: list[str], exclude: list[str] | None = None, follow_links: bool = False) -> list[Path]:
    """The files below ``root`` with one of the extensions, in order, without what is excluded or ignored."""
    root, found = Path(root), []

    def walk(folder: Path, rules: list) -> None:
        rules = [*rules, *((folder, r) for r in _ignore_rules(folder))]
        for x in sorted(folder.iterdir()):
            if x.is_symlink() and not follow_links:
                continue
            below = x.relative_to(root).as_posix()
            if x.name in EXCLUDED or any(fnmatch.fnmatch(below, p) or fnmatch.fnmatch(x.name, p) for p in exclude or []):
                continue
            gone = False
            for base, (pattern, negated, only_dirs) in rules:
                if pattern.match(x.relative_to(base).as_posix()) and (x.is_dir() or not only_dirs):
                    gone = not negated
            if gone or (x.name.startswith(".") and x.name != "."):
                continue
            if x.is_dir():
                walk(x, rules)
            elif x.suffix[1:] in extensions:
                found.append(x)

    walk(root, [])
    return sorted(found)


def scan_languages(root: str | Path) -> list[str]:
    """The languages that have files below ``root``, in fixed order."""
    return [name for name, extensions in LANGUAGES.items() if scan_files(root, extensions)]


def languages_of(paths: DataFrame) -> DataFrame:
    """(language, files) of a table of paths."""
    rows = [(x, name, k) for k, (name, extensions) in enumerate(LANGUAGES.items()) for x in extensions]
    known = paths.sparkSession.createDataFrame(rows, "extension string, language string, place int")
    extension = F.regexp_extract("path", r"\.([^./]+)$", 1)
    return paths.withColumn("extension", extension).join(F.broadcast(known), "extension").groupBy("language", "place").agg(F.count("*").alias("files"))  # one row an extension


def read_sources(spark: SparkSession, files: list[Path], counters: Counter | None = None) -> DataFrame:
    """(path, text) of the files, those that are not UTF-8 left out and counted."""
    if not files:
        return spark.createDataFrame([], "path string, text string")
    raw = spark.read.format("binaryFile").load([f"file://{x.resolve()}" for x in files])
    rows = raw.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.when(F.expr("is_valid_utf8(cast(content as string))"), F.col("content").cast("string")).alias("text"))
    if counters is not None:
        counters["files_skipped"] += rows.where("text is null").count()
    return rows.where("text is not null")


# Packages


@dataclass
class Crate:
    idx: int
    name: str
    dir: str
    member: bool = False
    default_member: bool = False
    is_root: bool = False
    has_tests: bool = False
    deps: list[int] = field(default_factory=list)
    dev_deps: list[int] = field(default_factory=list)


CRATES = "idx int, name string, dir string, member boolean, default_member boolean, is_root boolean, has_tests boolean, deps array<int>, dev_deps array<int>"


def _manifest(folder: Path) -> dict | None:
    try:
        return tomllib.loads((folder / "Cargo.toml").read_text())
    except (OSError, ValueError):
        return None


def _members(root: Path, patterns: list[str]) -> list[Path]:
    out = []
    for pattern in patterns:
        out += sorted(x for x in root.glob(pattern) if x.is_dir()) if re.search(r"[*?]", pattern) else [root / pattern]
    return [Path(os.path.normpath(x)) for x in out]


def scan_crates(root: str | Path) -> list[Crate]:
    """The crates of a workspace: members, and crates inside it that they depend on by path."""
    root = Path(os.path.normpath(Path(root).absolute()))
    top = _manifest(root)
    if top is None:
        return []
    workspace = top.get("workspace", {})
    shared = {name: Path(os.path.normpath(root / spec["path"])) for name, spec in workspace.get("dependencies", {}).items() if isinstance(spec, dict) and "path" in spec}
    excluded = [Path(os.path.normpath(root / x)) for x in workspace.get("exclude", [])]
    members = [x for x in _members(root, workspace.get("members", [])) if not any(x.is_relative_to(e) for e in excluded) and (x / "Cargo.toml").is_file()]
    members = ([root] if "package" in top else []) + members
    crates: list[Crate] = []
    index: dict[Path, int | None] = {}
    manifests: list[dict] = []

    def add(folder: Path) -> int | None:
        if folder not in index:
            own = _manifest(folder) if folder.is_relative_to(root) else None
            name = (own or {}).get("package", {}).get("name")
            index[folder] = None if name is None else len(crates)
            if name is not None:
                kinds = own.get("lib", {}).get("crate-type", [])
                runs = (folder / "src/main.rs").is_file() or (folder / "src/bin").is_dir() or "bin" in own
                tested = any((folder / x).is_dir() for x in ("tests", "examples", "benches")) or "example" in own or "bench" in own
                where = folder.relative_to(root).as_posix()
                crates.append(Crate(len(crates), name, "" if where == "." else where, is_root=runs or bool({"cdylib", "staticlib"} & set(kinds)), has_tests=tested))
                manifests.append(own)
        return index[folder]

    for x in members:
        if (k := add(x)) is not None:
            crates[k].member = True
    at = 0
    while at < len(crates):  # crates that are found by path are linked too
        own, crate = manifests[at], crates[at]
        folder = root / crate.dir
        tables = [own, *(x for x in own.get("target", {}).values() if isinstance(x, dict))]
        for kind, into in (("dependencies", crate.deps), ("build-dependencies", crate.deps), ("dev-dependencies", crate.dev_deps)):
            for name, spec in ((n, s) for x in tables for n, s in x.get(kind, {}).items()):
                if not isinstance(spec, dict):
                    continue
                to = Path(os.path.normpath(folder / spec["path"])) if "path" in spec else (shared.get(name) or shared.get(spec.get("package", name))) if spec.get("workspace") else None
                k = add(to) if to is not None else None
                if k is not None and k != at and k not in into:
                    into.append(k)
        crate.dev_deps = [x for x in crate.dev_deps if x not in crate.deps]
        at += 1
    defaults = [index.get(x) for x in _members(root, workspace.get("default-members", []))]
    for crate in crates:
        crate.default_member = crate.member and (not defaults or crate.idx in defaults)
    return crates


def crates_table(spark: SparkSession, crates: list[Crate]) -> DataFrame:
    names = [x.split()[0] for x in CRATES.split(", ")]
    return spark.createDataFrame([tuple(getattr(c, n) for n in names) for c in crates], CRATES)


# Configuration


@dataclass
class Config:
    """Settings with their defaults; a file may set any of them and no others."""

    language: str = "rust"
    exclude: list[str] = field(default_factory=list)
    follow_symlinks: bool = False
    blocking_calls: list[str] = field(default_factory=list)
    blocking_allow: list[str] = field(default_factory=list)
    blocking_depth: int = 4
    architecture: list[str] = field(default_factory=lambda: ["clean"])
    heap_sensitivity: float = 1.0
    weights: dict[str, float] = field(default_factory=dict)
    max_suggestions: int = 50
    store_enabled: bool = True

    def validate(self) -> Config:
        if self.heap_sensitivity < 0 or any(w < 0 for w in self.weights.values()):
            raise ValueError("sensitivities and weights are 0 or more")
        if unknown := set(self.architecture) - {"clean", "onion", "mvc"}:
            raise ValueError(f"unknown architecture: {', '.join(sorted(unknown))}")
        if self.language not in LANGUAGES:
            raise ValueError(f"unknown language: {self.language}")
        return self


def scan_config(start: str | Path, explicit: str | Path | None = None) -> Config:
    """The configuration of a given file, of the nearest file from ``start`` upwards, or the defaults."""
    start = Path(start).absolute()
    at = Path(explicit) if explicit else next((x / CONFIG_FILE for x in (start, *start.parents) if (x / CONFIG_FILE).is_file()), None)
    if at is None:
        return Config()
    told = tomllib.loads(at.read_text())
    if unknown := set(told) - {f.name for f in fields(Config)}:
        raise ValueError(f"{at}: unknown keys {', '.join(sorted(unknown))}")
    return Config(**told).validate()


def init_config(folder: str | Path, force: bool = False) -> Path:
    """Write the defaults; an existing file stays unless ``force``."""
    at = Path(folder) / CONFIG_FILE
    if at.exists() and not force:
        raise FileExistsError(str(at))
    config = Config()
    lines = [f"{f.name} = {json.dumps(v)}" for f in fields(config) if not isinstance(v := getattr(config, f.name), dict)]
    at.write_text("\n".join([*lines, "[weights]", ""]))
    return at


# Analysis, its store and whether that is fresh


def crates_mark(crates: list[Crate]) -> str:
    return hashlib.sha256(repr(crates).encode()).hexdigest()


def analyze(spark: SparkSession, root: str | Path, config: Config | None = None, store: str | None = None, progress: Callable[[str], None] = lambda stage: None, counters: Counter | None = None) -> Graph:
    """The graph of a repository; with ``store`` it is written there and read back."""
    config, counters = config or scan_config(root), Counter() if counters is None else counters
    began = int(time.time() * 1000)
    progress("discovering")
    files = scan_files(root, LANGUAGES[config.language], config.exclude, config.follow_symlinks)
    if not files:
        raise FileNotFoundError(f"no {config.language} files below {root}")
    counters["files_discovered"] += len(files)
    progress("discovered")
    progress("reading")
    base = Path(root).resolve().as_posix()
    sources = read_sources(spark, files, counters).withColumn("path", F.expr(f"substring(path, {len(base) + 2})"))
    progress("parsing")
    g = ADAPTERS[config.language](sources)
    progress("parsed")
    if store and config.store_enabled:
        crates = scan_crates(root)
        export.save_store(g, store, {"root": str(root), "file_count": str(len(files)), "written_at_ms": str(began), "extractor": f"{config.language} {EXTRACTOR}", "crates": crates_mark(crates)})
        g = export.load_store(spark, store) or g
    progress("done")
    return g


def staleness(spark: SparkSession, root: str | Path, store: str, config: Config | None = None) -> str | None:
    """Why the stored graph cannot be used; None if it can."""
    config = config or scan_config(root)
    if not config.store_enabled:
        return "disabled"
    meta = export.store_meta(spark, store)
    if meta is None:
        return "missing"
    if meta.get("version") != str(export.VERSION):
        return "store_format_changed"
    if not {"root", "file_count", "written_at_ms", "extractor", "crates"} <= set(meta):
        return "no_metadata"
    if meta["root"] != str(root):
        return "root_changed"
    if meta["extractor"] != f"{config.language} {EXTRACTOR}":
        return "extractor_changed"
    if meta["crates"] != crates_mark(scan_crates(root)):
        return "crates_changed"
    files = scan_files(root, LANGUAGES[config.language], config.exclude, config.follow_symlinks)
    if len(files) != int(meta["file_count"]):
        return f"file_set_changed {meta['file_count']} {len(files)}"
    modified = sum(x.stat().st_mtime * 1000 > int(meta["written_at_ms"]) for x in files)
    return f"files_modified {modified}" if modified else None


def load_or_analyze(spark: SparkSession, root: str | Path, store: str, config: Config | None = None) -> tuple[Graph, str | None]:
    """The stored graph if it is fresh, else a new one with the reason."""
    reason = staleness(spark, root, store, config)
    if reason is None and (g := export.load_store(spark, store)) is not None:
        return g, None
    return analyze(spark, root, config, store), reason or "no_metadata"


def list_stores(folder: str | Path) -> list[tuple[str, int]]:
    """(name, age in days) of the stores below a local folder."""
    found = sorted(x for x in Path(folder).glob("*") if (x / "meta").is_dir())
    return [(x.name, int((time.time() - (x / "meta").stat().st_mtime) // 86400)) for x in found]


def clean_stores(folder: str | Path, older_than_days: int = 0, keep: tuple[str, ...] = (), yes: bool = False) -> list[str]:
    """The stores that are, or without ``yes`` would be, removed."""
    gone = [name for name, age in list_stores(folder) if age >= older_than_days and name not in keep]
    for name in gone if yes else []:
        shutil.rmtree(Path(folder) / name)
    return gone
