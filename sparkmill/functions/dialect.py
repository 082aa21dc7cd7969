"""Rewrites of SQL text into Spark's dialect, outside strings, quoted names and comments.

``a // b`` becomes ``a div b`` (both truncate toward zero), ``prefix`` and
``suffix`` become ``startswith`` and ``endswith``, ``error`` becomes
``raise_error``, a common table marked ``MATERIALIZED`` loses the mark (see
:func:`materialised`), and an ORDER BY key without a null order gets NULLS LAST,
ascending or descending, in queries, windows and aggregates alike.
"""

from __future__ import annotations

import re

_SKIP = r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/"
_RULES: list[tuple[str, str]] = [
    (r"//", " div "), (r"\bprefix(?=\s*\()", "startswith"), (r"\bsuffix(?=\s*\()", "endswith"), (r"\berror(?=\s*\()", "raise_error"),
    (r"\bas\s+(?:not\s+)?materialized(?=\s*\()", "AS"),
]
_TOKEN = re.compile("|".join([f"(?P<skip>{_SKIP})", *(f"(?P<r{i}>{p})" for i, (p, _) in enumerate(_RULES))]), re.IGNORECASE | re.DOTALL)
_ORDER = re.compile(rf"(?P<skip>{_SKIP})|(?P<order>\border\s+by\b)|(?P<nulls>\bnulls\s+(?:first|last)\b)|(?P<stop>\b(?:limit|offset|fetch|union|intersect|except)\b|\b(?:rows|range|groups)\s+(?:between|unbounded|current|interval|\d)|\bwindow\s+\w+\s+as\b)|(?P<mark>[(),])", re.IGNORECASE | re.DOTALL)


def rewrite(sql: str) -> str:
    """Spark SQL for a text in the accepted dialect."""

    def swap(m: re.Match) -> str:
        return m[0] if m["skip"] is not None else _RULES[int(m.lastgroup[1:])][1]

    return nulls_last(_TOKEN.sub(swap, sql.rstrip().rstrip(";")))


def nulls_last(sql: str) -> str:
    """The text with NULLS LAST after every sort key that has no null order."""
    out, at = [], 0
    # One entry for each open parenthesis: whether its ORDER BY runs, and whether the present key has a null order.
    stack: list[list[bool]] = [[False, False]]

    def close_key(end: int) -> None:
        nonlocal at
        if stack[-1][0] and not stack[-1][1]:
            body = sql[at:end]
            trimmed = _without_tail(body)
            out.append(trimmed + " NULLS LAST" + body[len(trimmed) :])
            at = end
        stack[-1][1] = False

    for m in _ORDER.finditer(sql):
        kind = m.lastgroup
        if kind == "order":
            stack[-1] = [True, False]
        elif kind == "nulls":
            stack[-1][1] = True
        elif kind == "stop":
            close_key(m.start())
            stack[-1][0] = False
        elif m[0] == "(":
            stack.append([False, False])
        elif m[0] == ",":
            close_key(m.start())
        elif m[0] == ")":
            close_key(m.start())
            if len(stack) > 1:
                stack.pop()
    close_key(len(sql))
    return "".join(out) + sql[at:]


def _without_tail(text: str) -> str:
    """Without the white space and comments at the end."""
    while True:
        shorter = re.sub(r"(?:\s+|--[^\n]*\n?|/\*(?:(?!\*/).)*\*/)$", "", text, flags=re.DOTALL)
        if shorter == text:
            return text
        text = shorter


def materialised(sql: str) -> list[str]:
    """Names of the common tables that the text marks ``MATERIALIZED``."""
    plain = re.sub(_SKIP, lambda m: m[0] if m[0][0] in "\"`" else "''", sql, flags=re.DOTALL)
    return re.findall(r"\b(\w+)\s+as\s+materialized\s*\(", plain, re.IGNORECASE)


def closing(sql: str, start: int) -> int:
    """Where the parenthesis that was opened before ``start`` closes."""
    depth = 1
    for m in re.compile(rf"(?P<skip>{_SKIP})|[()]", re.DOTALL).finditer(sql, start):
        if m["skip"] is None:
            depth += 1 if m[0] == "(" else -1
            if not depth:
                return m.start()
    raise ValueError("a parenthesis is never closed")
