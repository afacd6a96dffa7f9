"""The SQL that says the same as expressions of ``text``: fragments for the second engine."""

from __future__ import annotations

#: No letter, digit or underscore of any script before or after: what both engines read as the edge of a word.
EDGE, END = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def any_of(c: str, parts) -> str:
    return "(" + " OR ".join(f"contains({c}, {quoted(p)})" for p in parts) + ")"


def count_of(c: str, parts) -> str:
    return "(" + " + ".join(f"contains({c}, {quoted(p)})::INT" for p in parts) + ")"


def count_like(c: str, patterns) -> str:
    return "(" + " + ".join(f"regexp_matches({c}, {quoted(p)})::INT" for p in patterns) + ")"


def like_any(c: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {quoted(p)})" for p in patterns) + ")"


def labels_where(conditions: dict[str, str]) -> str:
    """The names whose condition holds, in order, as a list."""
    return "[x FOR x IN [" + ", ".join(f"CASE WHEN {v} THEN {quoted(k)} END" for k, v in conditions.items()) + "] IF x IS NOT NULL]"


def joined(items: str, by: str = ",") -> str:
    return f"array_to_string({items}, {quoted(by)})"


def first_seen(items: str) -> str:
    """A list without repeats, in order of first appearance."""
    return f"[x FOR x, i IN {items} IF list_position({items}, x) = i]"
