"""License scans with a positional index of rare words.

The words of known licence notices are indexed by position. Document frequencies over the whole corpus give their
rarity. For each template whose mandatory phrase occurs, its rarest words present in the text propose alignments (the
offset of its first word). Each alignment is scored by the rarity-weighted share of template words found at their
places, and all that score enough are reported.
"""

from __future__ import annotations

import bisect
import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.llm.common import with_text_columns

#: Fixed phrases of the base labels.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Fixed openings of public licence notices: label, mandatory phrases (one must occur), text.
TEMPLATES: list[tuple[str, tuple[str, ...], str]] = [
    ("mit", ("mit license", "permission is hereby granted free of charge"), "released under the mit license"),
    ("mit", ("permission is hereby granted free of charge",), "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", ("apache license",), "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", ("apache license",), "licensed under the apache license version 2 0"),
    ("gpl", ("general public license",), "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", ("general public license",), "this work is licensed under the gnu general public license version 3"),
    ("lgpl", ("lesser general public license",), "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", ("redistribution and use in source and binary forms",), "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", ("cc by 4 0", "cc by 3 0", "cc by 2 0"), "licensed under cc by 4 0"),
    ("cc-by-nc", ("cc by nc", "creative commons attribution noncommercial"), "licensed under cc by nc 4 0"),
    ("cc-by-sa", ("cc by sa", "creative commons attribution sharealike"), "licensed under cc by sa 4 0"),
    ("cc-by", ("creative commons attribution",), "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mpl", ("mozilla public license",), "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", ("unencumbered software",), "this is free and unencumbered software released into the public domain"),
    ("isc", ("permission to use copy modify",), "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
]

#: Words: ASCII letters lower-cased, digits, and all bytes of non-ASCII letters; everything else separates.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORDS).split()


#: The licence words: all that the templates use.
LEXICON = frozenset(w.encode() for _, _, t in TEMPLATES for w in t.split())


def phrase_places(line: bytes, phrase: bytes) -> list[int]:
    """Byte offsets of the phrase in a line of words, each between single blanks."""
    out, at = [], line.find(phrase)
    while at >= 0:
        out.append(at)
        at = line.find(phrase, at + 1)
    return out


class PositionalIndex:
    """Words and mandatory phrases of the templates, and the rarity of each word."""

    def __init__(self, document_counts: dict[str, int], n_docs: int) -> None:
        self.idf = {w: math.log((n_docs + 1) / (document_counts.get(w.decode(), 0) + 0.5)) for w in LEXICON}
        self.texts = [[w.encode() for w in t.split()] for _, _, t in TEMPLATES]
        self.weights = [sum(self.idf[w] for w in t) or 1.0 for t in self.texts]
        self.mandatory = [tuple(f" {p} ".encode() for p in m) for _, m, _ in TEMPLATES]

    def matches(self, words: list[bytes], line: bytes, rarest: int = 12, least: float = 0.6) -> list[tuple[str, int, float]]:
        """(label, first word, score) of every alignment of a template with a score of at least ``least``.

        The ``rarest`` words of a template that are present propose its alignments, and so many more that an alignment
        on none of them can not reach ``least``; every place of such a word is used. Of alignments that overlap the
        better one counts.
        """
        able = [k for k, phrases in enumerate(self.mandatory) if any(p in line for p in phrases)]
        if not able:
            return []
        wanted = set().union(*(self.texts[k] for k in able))
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in wanted:
                places[w].append(i)
        out = []
        for k in able:
            template = self.texts[k]
            present = sorted({w for w in template if w in places}, key=lambda w: (-self.idf[w], w))
            left = sum(self.idf[w] for w in template if w in places)
            starts: set[int] = set()
            for n, w in enumerate(present):
                if n >= rarest and left / self.weights[k] < least - 1e-9:
                    break
                at = [i for i, t in enumerate(template) if t == w]
                starts.update(p - i for p in places[w] for i in at)
                left -= self.idf[w] * len(at)
            scored = []
            for start in starts:
                hit = sum(self.idf[w] for i, w in enumerate(template) if 0 <= start + i < len(words) and words[start + i] == w)
                if (score := hit / self.weights[k]) >= least:
                    scored.append((score, start))
            taken: list[int] = []  # first words, ascending and at least a template apart
            for score, start in sorted(scored, key=lambda x: (-x[0], x[1])):
                at = bisect.bisect(taken, start)
                if all(abs(start - t) >= len(template) for t in taken[max(at - 1, 0) : at + 1]):
                    taken.insert(at, start)
                    out.append((TEMPLATES[k][0], max(start, 0), score))
        return out


def scan_text(index: PositionalIndex, text: str) -> tuple[int, int, int | None, int | None, str, str, float, list[tuple[str, int, float]]]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, matches."""
    words = words_of(text)
    line = b" " + b" ".join(words) + b" "
    starts: list[int] = []
    base = set()
    for label, phrase in PHRASES.items():
        if places := phrase_places(line, f" {phrase} ".encode()):
            base.add(label)
            starts += places
    found = index.matches(words, line)
    labels = base | {m[0] for m in found}
    score = max([m[2] for m in found] + [0.5] * bool(base) + [0.0])
    first = line.count(b" ", 0, min(starts)) if starts else None
    last = line.count(b" ", 0, max(starts)) if starts else None
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), min(score, 1.0), found


def document_counts(docs: DataFrame, text: str = "text") -> tuple[dict[str, int], int]:
    """In how many texts each licence word occurs, and the number of texts. Bounded by the lexicon."""

    def make() -> Callable[[list[str]], list]:
        return lambda texts: [[[w.decode() for w in LEXICON.intersection(words_of(t))] for t in texts]]

    found = with_text_columns(docs, text, make, {"w": "array<string>"}, keep=[])
    rows = found.select(F.explode(F.concat(F.array(F.lit("")), "w")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    counts = {r["w"]: r["n"] for r in rows}
    return counts, counts.pop("", 0)


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the scan's columns. Null and empty texts have no words, no labels and the score 0.

    Two passes: rarity over all texts, then the scan; neither shuffles texts. A repeated phrase counts each time.
    """
    counts, n_docs = document_counts(docs, text)

    def make() -> Callable[[list[str]], list]:
        index = PositionalIndex(counts, n_docs)

        def apply(texts: list[str]) -> list:
            out = [scan_text(index, t) for t in texts]
            return [[x[i] for x in out] for i in range(7)] + [[[{"label": a, "first_word": b, "score": c} for a, b, c in x[7]] for x in out]]

        return apply

    new = {
        "n_words": "long",
        "n_base": "long",
        "first_word": "long",
        "last_word": "long",
        "base_labels": "string",
        "labels": "string",
        "score": "double",
        "matches": "array<struct<label:string,first_word:int,score:double>>",
    }
    return with_text_columns(docs, text, make, new, keep)
