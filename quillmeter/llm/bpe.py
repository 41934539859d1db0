"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word the last token of its encoding is unique. A matching automaton reports, for each
position, the vocabulary tokens that are suffixes of the prefix ending there; the one whose predecessor (the last
token of the shorter prefix) is compatible with it is stored. Following the stored tokens back from the end gives
the exact ids in linear time, without replaying merges. Two tokens are compatible if no merge rule would have
joined pieces across their border before both were complete.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Callable

import regex
from pyspark.sql import DataFrame

from quillmeter.llm.common import with_text_columns

END = "</w>"
NEVER = 1 << 60
#: Characters that str.split() takes for white space and Unicode does not.
NOT_SPACE = re.compile("[\x1c-\x1f]")
BLANKS = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Stretches remembered by a Python worker.
CACHE = 450_000
#: What an entry of a dictionary of short texts takes besides the letters.
ENTRY_BYTES = 190
#: Words remembered by a Python worker.
PIECES = 250_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, free = [], 256
    for b in range(256):
        letters.append(chr(b if b in plain else free))
        free += b not in plain
    return letters


class SuffixMatcher:
    """For each prefix of a word, the tokens that are suffixes of it.

    States are the beginnings of tokens; reading a symbol leads to the longest state that is a suffix of what was
    read. A state's tokens are its own and those of its longest proper suffix, so one list per state has all.
    """

    def __init__(self, ids: dict[str, int]) -> None:
        self.steps: dict[int, int] = {}  # state << 17 | symbol -> state
        self.fail, own = [0], [None]
        depth: list[list[tuple[int, int, int]]] = [[]]  # by length: state before, symbol, state
        for form, i in ids.items():
            state = 0
            for d, symbol in enumerate(map(ord, form)):
                key = state << 17 | symbol
                if key not in self.steps:
                    self.steps[key] = len(own)
                    while len(depth) <= d:
                        depth.append([])
                    depth[d].append((state, symbol, len(own)))
                    own.append(None)
                    self.fail.append(0)
                state = self.steps[key]
            own[state] = (i, len(form))
        self.tokens: list[tuple[tuple[int, int], ...]] = [()] * len(own)
        for d, made in enumerate(depth):
            for before, symbol, state in made:
                if d:
                    at = self.fail[before]
                    while (got := self.steps.get(at << 17 | symbol)) is None and at:
                        at = self.fail[at]
                    self.fail[state] = got or 0
                rest = self.tokens[self.fail[state]]
                self.tokens[state] = (own[state], *rest) if own[state] else rest
        self.made = len(self.steps)

    def follow(self, state: int, symbol: int) -> int:
        """The step from a state over a symbol that continues no token beginning; some are remembered."""
        at = self.fail[state] if state else 0
        while (got := self.steps.get(at << 17 | symbol)) is None and at:
            at = self.fail[at]
        got = got or 0
        if len(self.steps) < self.made + 500_000:
            self.steps[state << 17 | symbol] = got
        return got


class Splitter:
    """How one tokenizer file (BPE with word ends, lower case, white space dropped) cuts a text into words."""

    def __init__(self, spec: dict) -> None:
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.letters = byte_letters()

    def spell(self, piece: str) -> str:
        """The letters of the piece's bytes; printable ASCII stands for itself."""
        if piece.isascii() and piece.isprintable():
            return piece
        return "".join(map(self.letters.__getitem__, piece.encode()))

    def encode_chunk(self, chunk: str, word: Callable[[str], list[int]]) -> list[int]:
        """Ids of a stretch without white space; ``word`` encodes the letters of one word's bytes."""
        out: list[int] = []
        for part in self.cut.split(chunk) if "<|" in chunk else (chunk,):
            if part in self.special:
                out.append(self.special[part])
                continue
            whole = normalised(part)
            for piece in (whole,) if whole.isalpha() else self.pieces.findall(whole):
                out += word(self.spell(piece))
        return out


class WordPieces(Splitter):
    """Tables to encode the words of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        super().__init__(spec)
        model = spec["model"]
        self.names: dict[int, str] = {i: t for t, i in model["vocab"].items()}
        self.names |= {i: t for t, i in self.special.items()}
        # a word's last letter is another symbol than the same letter inside: it is moved to a plane of its own
        symbol = lambda t: t if not t.endswith(END) or t == END else t[: -len(END) - 1] + chr(ord(t[-len(END) - 1]) + 0x10000)
        ids = model["vocab"]
        self.rank: dict[int, int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            x, y, made = ids[a], ids[b], ids[a + b]
            self.merge.setdefault((x, y), rank)
            if made not in self.rank:
                self.rank[made], self.left[made], self.right[made] = rank, x, y
        self.matches = SuffixMatcher({symbol(t): i for t, i in ids.items() if i in self.rank or len(symbol(t)) == 1})
        self.known: dict[int, bool] = {}
        self.words = Memory(self.encode_word, PIECES)

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' text is the two tokens.

        Undo the later-made piece at the border, again and again; ``until_a`` and ``until_b`` are the ranks at which
        the pieces at the border are used up. Of equal rules the one further left applies first.
        """
        x, y, until_a, until_b = a, b, NEVER, NEVER
        rank, merge = self.rank, self.merge
        good = True
        while True:
            m = merge.get((x, y), NEVER)
            if m < until_a and m <= until_b and m != NEVER:
                good = False
                break
            rx, ry = rank.get(x, -1), rank.get(y, -1)
            if rx < 0 and ry < 0:
                break
            if rx > ry:
                until_a, x = rx, self.right[x]
            else:
                until_b, y = ry, self.left[y]
        if len(self.known) > 500_000:
            self.known.clear()
        self.known[a << 20 | b] = good
        return good

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given as letters of bytes; its last letter carries the word end."""
        n = len(word)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        known, compatible = self.known, self.compatible
        steps, tokens, follow = self.matches.steps, self.matches.tokens, self.matches.follow
        state, end = 0, 0
        symbols = list(map(ord, word))
        symbols[-1] += 0x10000
        for symbol in symbols:
            end += 1
            key = state << 17 | symbol
            state = steps[key] if key in steps else follow(state, symbol)
            for token, length in tokens[state]:  # the longest first
                if length < end:
                    before = last[end - length]
                    good = known.get(before << 20 | token)
                    if not (compatible(before, token) if good is None else good):
                        continue
                last[end], size[end] = token, length
                break
        out, at = [], n
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def encode_chunk(self, chunk: str, word: Callable[[str], list[int]] | None = None) -> list[int]:
        return super().encode_chunk(chunk, word or self.words.__getitem__)


class Memory(dict):
    """Results of a function by key; when full, further keys are computed each time they come.

    The frequent stretches of a corpus come early, so a full memory still answers almost all of them.
    """

    def __init__(self, compute: Callable, size: int = CACHE, most_bytes: int | None = None) -> None:
        super().__init__()
        self.compute, self.size, self.left = compute, size, most_bytes

    def __missing__(self, key: str):
        got = self.compute(key)
        if len(self) < self.size:
            if self.left is not None:
                self.left -= ENTRY_BYTES + len(key) + len(got)
                if self.left < 0:
                    self.size = 0
            self[key] = got
        return got


@functools.cache
def tables(path: str) -> WordPieces:
    """Kept by a Python worker from task to task."""
    return WordPieces(path)


@functools.cache
def memory(path: str, form: Callable[[list[int], WordPieces], object]) -> Memory:
    """Encoded stretches in one form, kept by a Python worker from task to task."""
    t = tables(path)
    return Memory(lambda chunk: form(t.encode_chunk(chunk), t))


def normalised(text: str) -> str:
    """Canonical composition and lower case letter by letter (no final form of the Greek sigma)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def chunks(text: str) -> list[str]:
    """Stretches between Unicode white space, normalised unless they may hold a special token."""
    if "<|" in text:
        return [c if "<|" in c else normalised(c) for c in BLANKS.split(text) if c]
    text = normalised(text)
    return [c for c in BLANKS.split(text) if c] if NOT_SPACE.search(text) else text.split()


def plain(ids: list[int], _: WordPieces) -> list[int]:
    return ids


def as_texts(ids: list[int], t: WordPieces) -> tuple[int, str, str]:
    return len(ids), " ".join(map(str, ids)), decode(ids, t.names)


def encoder(path: str) -> Callable[[str], list[int]]:
    """The function from a text to its ids. Encoding stretches apart is exact: no token crosses white space."""
    seen = memory(path, plain)
    return lambda text: [i for c in chunks(text) for i in seen[c]]


def decode(ids: list[int], names: dict[int, str]) -> str:
    """The file names no decoder, so tokens are joined by blanks, word ends and special tokens included."""
    return " ".join([names[i] for i in ids])


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``ids`` and ``decoded``. Null and empty texts have no ids and decode to the empty text."""

    def make() -> Callable[[list[str]], list]:
        run = encoder(path)
        names = tables(path).names
        return lambda texts: [out := [run(t) for t in texts], [decode(i, names) for i in out]]

    return with_text_columns(docs, text, make, {"ids": "array<int>", "decoded": "string"}, keep)


def digest(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids as text, and of the decoded text.

    The texts of the ids and of the tokens are kept per stretch, so that a stretch is encoded once in a task.
    """

    def make() -> Callable[[list[str]], list]:
        seen = memory(path, as_texts)

        def one(text: str) -> tuple[int, str, str]:
            parts = list(map(seen.__getitem__, chunks(text)))
            ids = " ".join([p[1] for p in parts if p[0]])
            decoded = " ".join([p[2] for p in parts if p[0]])
            return (
                sum(p[0] for p in parts),
                hashlib.sha256(ids.encode()).hexdigest(),
                hashlib.sha256(decoded.encode()).hexdigest(),
            )

        return lambda texts: list(map(list, zip(*map(one, texts), strict=True))) if texts else [[], [], []]

    new = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return with_text_columns(docs, text, make, new, [doc_id])
