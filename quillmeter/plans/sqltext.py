"""Helpers that write the comparison SQL from the same fixed values."""

from __future__ import annotations

from collections.abc import Iterable


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(c: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {lit(w)})" for w in words) + ")"


def all_of(c: str, groups: Iterable[Iterable[str]]) -> str:
    return "(" + " AND ".join(any_of(c, g) for g in groups) + ")"


def count_of(c: str, words: Iterable[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({c}, {lit(w)}) AS INTEGER)" for w in words) + ")"


def case(rules: Iterable[tuple[str, str]], otherwise: str = "NULL") -> str:
    body = " ".join(f"WHEN {c} THEN {v}" for c, v in rules)
    return f"CASE {body} ELSE {otherwise} END"


def text_list(words: Iterable[str]) -> str:
    return "[" + ", ".join(map(lit, words)) + "]"


def title_case(c: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all(lower({c}), '\\p{{L}}+|[^\\p{{L}}]+'), "
            "lambda r: upper(substr(r, 1, 1)) || substr(r, 2)), '')")
