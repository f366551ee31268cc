"""Search strings: words, "phrases", AND, OR, NOT, +, -, parentheses and field: prefixes, as a nested tuple."""

from __future__ import annotations

import re

from querymill.table import RequestError

_ITEM = re.compile(r'\s*(?:(?P<op>AND\b|OR\b|NOT\b|[()+-])|(?:(?P<field>\w+):)?(?:"(?P<phrase>[^"]*)"|(?P<word>[^\s()"]+)))')


def parse(query: str, conjunction: bool = False) -> tuple:
    """("term", field, text) | ("phrase", field, text) | ("and" | "or", parts) | ("not", part)."""
    items, at = [], 0
    while query[at:].strip():
        m = _ITEM.match(query, at)
        if not m:
            raise RequestError(f"cannot read the search {query!r} at {at}")
        items.append(m)
        at = m.end()
    if not items:
        raise RequestError("the search is empty")
    tree, rest = _any(items, conjunction)
    if rest:
        raise RequestError(f"unbalanced parenthesis in {query!r}")
    return tree


def _any(items: list, conjunction: bool) -> tuple[tuple, list]:
    """A run of clauses up to a closing parenthesis. AND binds its neighbours; + and - mark what must and must not be."""
    groups: list[list] = []
    must, must_not, joined = [], [], False
    while items and items[0]["op"] != ")":
        op = items[0]["op"]
        if op in ("AND", "OR"):
            joined, items = op == "AND", items[1:]
            if not groups and not must or not items:
                raise RequestError("AND and OR stand between clauses")
            continue
        sign = op if op in ("+", "-", "NOT") else None
        part, items = _one(items[1:] if sign else items, conjunction)
        if sign in ("-", "NOT"):
            (groups[-1] if joined and groups else must_not).append(("not", part) if joined and groups else part)
        elif sign == "+":
            must.append(part)
        elif joined and groups:
            groups[-1].append(part)
        else:
            groups.append([part])
        joined = False
    some = [g[0] if len(g) == 1 else ("and", g) for g in groups]
    parts = must + [("not", p) for p in must_not]
    if some and (conjunction or not must):
        parts = [("and" if conjunction else "or", some) if len(some) > 1 else some[0], *parts]
    elif some:
        parts.append(("maybe", some))
    if not parts or all(p[0] == "not" for p in parts):
        raise RequestError("a search needs a clause that is not negated")
    return (parts[0] if len(parts) == 1 else ("and", parts)), items


def _one(items: list, conjunction: bool) -> tuple[tuple, list]:
    if not items:
        raise RequestError("a clause is missing")
    m = items[0]
    if m["op"] == "(":
        tree, rest = _any(items[1:], conjunction)
        if not rest:
            raise RequestError("a closing parenthesis is missing")
        return tree, rest[1:]
    if m["op"]:
        raise RequestError(f"misplaced {m['op']}")
    return ("phrase", m["field"], m["phrase"]) if m["phrase"] is not None else ("term", m["field"], m["word"]), items[1:]
