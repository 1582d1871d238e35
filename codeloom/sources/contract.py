"""Results as JSON objects and texts of a bounded size, from rows that are already limited."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

SCHEMA = 1


def plain(row: dict[str, Any]) -> dict[str, Any]:
    """Without nulls, false flags and empty lists."""
    return {k: v for k, v in row.items() if v is not None and v is not False and v != []}


def rows(df: DataFrame, limit: int) -> list[dict[str, Any]]:
    """At most ``limit`` rows and one more, which tells that there are others."""
    return [plain(r.asDict(recursive=True)) for r in df.limit(limit + 1).collect()]


def put_list(out: dict[str, Any], key: str, items: list, limit: int, total: int | None = None) -> None:
    """The first ``limit`` items under ``key``, and how many more there are."""
    out[key] = items[:limit]
    more = (len(items) if total is None else total) - len(out[key])
    if more > 0:
        out[f"{key}_more"] = more


def result(name: str, **values: Any) -> dict[str, Any]:
    return {"schema": SCHEMA, "kind": name, **plain(values)}


def error(kind: str, query: str, candidates: list[dict] | None = None, message: str | None = None) -> dict[str, Any]:
    return {"schema": SCHEMA, "error": kind, **plain({"query": query, "message": message}), "candidates": candidates or []}


def lookup_error(query: str, found: list[dict[str, Any]]) -> dict[str, Any] | None:
    """The error object of ``navigate.lookup`` rows; None if one symbol was found."""
    if found and found[0]["outcome"] == "found":
        return None
    return error(found[0]["outcome"] if found else "not_found", query, [plain({"id": r["node_id"], "name": r["qualified_name"]}) for r in found])


def listing(name: str, df: DataFrame, limit: int, key: str = "items", **values: Any) -> dict[str, Any]:
    """An object with the first rows of ``df`` as its list; ``df`` gives the order."""
    out = result(name, **values)
    found = rows(df, limit)
    put_list(out, key, found, limit, df.count() if len(found) > limit else None)
    return out


def tokens(text: str) -> int:
    """An estimate: four bytes are one."""
    return -(-len(text.encode()) // 4)


def fit_json(make: Callable[[int], dict], budget: int | None, full: int = 1 << 30) -> str:
    """``make(limit)`` as JSON within ``budget`` tokens: in full, else with lists of 64, 32, ... 1 items."""
    text = json.dumps(make(full), ensure_ascii=False)
    limit = 64
    while budget is not None and tokens(text) > budget and limit:
        text = json.dumps(make(limit), ensure_ascii=False)
        limit //= 2
    return text


def fit_text(make: Callable[[int], str], budget: int | None, start: int) -> str:
    """``make(limit)`` within ``budget`` tokens; the limit is halved from ``start``."""
    text = make(start)
    while budget is not None and tokens(text) > budget and start > 1:
        start //= 2
        text = make(start)
    return text


# Texts


def outline_text(found: list[dict[str, Any]]) -> str:
    """The rows of ``navigate.outline_tree`` in order, indented."""
    lines = []
    for r in sorted(found, key=lambda r: r["sort_key"]):
        lines.append("  " * r["depth"] + (r["name"] if r.get("node_id") is not None else f"{r['name']} ({r['functions']})"))
    return "\n".join(lines)


def tree_text(found: list[dict[str, Any]], names: dict[int, str]) -> str:
    """The rows of ``flows.call_tree``."""
    mark = lambda r: " (see above)" if r["repeat"] else " ..." if r["truncated"] else ""
    return "\n".join("  " * r["depth"] + names.get(r["node_id"], "?") + mark(r) for r in sorted(found, key=lambda r: r["ord"]))


def card_text(card: dict[str, Any], calls: list[dict[str, Any]]) -> str:
    """A definition with its callers and callees."""
    head = f"{card['qualified_name']}  [{card['kind']}{', ' + card['tags'] if card.get('tags') else ''}]\n  at {card['at']}"
    numbers = f"  cyclomatic {card['cyclomatic']}, parameters {card['parameters']}, lines {card['lines_of_code']}, callers {card['fan_in']}, callees {card['fan_out']}"
    part = lambda side, title: [f"  {title}:", *(f"    {c['qualified_name']} ({c['kind']} x{c['count']})" for c in sorted(calls, key=lambda c: c["place"]) if c["side"] == side)]
    return "\n".join([head, numbers, *part("in", "called by"), *part("out", "calls")])


def impact_text(found: list[dict[str, Any]]) -> str:
    """Callers by depth."""
    lines = []
    for depth in sorted({r["depth"] for r in found}):
        some = [r for r in found if r["depth"] == depth]
        lines.append(f"depth {depth}: {len(some)}")
        lines += [f"  {r['name']}" + (f"  [{r['entry']}]" if r.get("entry") else "") for r in some]
    return "\n".join(lines)


def explain_prompt(card: dict[str, Any], calls: list[dict[str, Any]], snippet: str = "") -> str:
    """A text that asks for an explanation of a definition; the same card gives the same text."""
    source = f"\n\nSource:\n{snippet}" if snippet else ""
    return f"Explain what this function does, what it depends on and what may break if it changes.\n\n{card_text(card, calls)}{source}"
