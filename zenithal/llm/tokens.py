"""Units of byte-level BPE: pieces of a text that can be encoded alone.

Such tokenizers never join characters across a change from a non-blank to a blank, and what they do with a run of blanks
depends only on what follows it. So a text falls apart, without loss, into units of a run of blanks and the run of
non-blanks after it; the ids of a text are the ids of its units in a row. Special tokens found in a text are units too.
Units repeat a lot, so each is encoded once where it is met again.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Callable

import pyarrow as pa
from tokenizers import Tokenizer

#: The blanks of the tokenizers' patterns (Unicode White_Space).
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
UNIT = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")


@functools.lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    """The tokenizer of a file, without truncation and padding; once per process."""
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def special_names(path: str) -> list[str]:
    """Special tokens, the longest first."""
    return sorted((t.content for t in load(path).get_added_tokens_decoder().values()), key=len, reverse=True)


@functools.lru_cache(maxsize=4)
def _special(path: str) -> re.Pattern | None:
    names = special_names(path)
    return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None


def units(text: str, path: str) -> list[str]:
    """The units of a whole text; put together they are the text."""
    special = _special(path)
    if special is None or not special.search(text):
        return UNIT.findall(text)
    out: list[str] = []
    for i, part in enumerate(special.split(text)):
        out += [part] if i % 2 else UNIT.findall(part)
    return out


#: A word of letters that every Unicode version knows, one space before it at most, marks after it at most.
PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-Ωα-ωЀ-ѿ]+)([.,;:!?]*)")


@functools.lru_cache(maxsize=4)
def _byte_names(path: str) -> dict[int, str] | None:
    """Names of the bytes, if the file's pre-tokenizer is the byte-level one with its own pattern and nothing else; then a
    unit that fits PLAIN is one piece of letters and one of marks, and need not go through the pre-tokenizer."""
    made = json.loads(load(path).to_str())
    kind = made["pre_tokenizer"] or {}
    plain = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not made["normalizer"]
    plain = plain and not any(PLAIN.fullmatch(x.content) for x in load(path).get_added_tokens_decoder().values())
    return {b: c for c, b in _byte_table().items()} if plain else None


def encoder(path: str) -> Callable[[str], bytes]:
    """A function from a unit to its ids as little-endian 32-bit integers."""
    t, special, names = load(path), _special(path), _byte_names(path)
    parts, tokenize, fit = t.pre_tokenizer.pre_tokenize_str, t.model.tokenize, PLAIN.fullmatch

    def one(u: str) -> bytes:
        if names is not None and (m := fit(u)):
            word, marks = m.groups()
            ids = [x.id for x in tokenize(word.encode().decode("latin-1").translate(names))]
            if marks:
                ids += [x.id for x in tokenize(marks)]  # ASCII marks name themselves
        elif special is not None and special.search(u):
            ids = t.encode(u, add_special_tokens=False).ids
        else:
            ids = [x.id for p, _ in parts(u) for x in tokenize(p)]
        return array("I", ids).tobytes()

    return one


_SOME_BLANK = re.compile(f"[{BLANK}]")
_BLANKS = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{BLANK}]", c))


class _Wide(Exception):
    """A text whose words between single spaces are not units one by one."""


class Cache(dict):
    """Ids by unit for one process, in two generations of at most ``most`` units: a full one becomes the older one, from which
    units are taken over when they are met again. Units of one space and a word are kept by the word."""

    class Words(dict):
        def __missing__(self, word: str) -> bytes:
            if not word or word[0] in _BLANKS or word[-1] in _BLANKS:
                raise _Wide
            if word.isalnum() or not _SOME_BLANK.search(word):
                self.owner.make_room()
                ids = self.owner.older.get(word)
                ids = self[word] = self.owner.one(" " + word) if ids is None else ids
                return ids
            own = UNIT.findall(" " + word)  # it holds other blanks: its units are looked up, the whole is not kept
            return b"".join([self[own[0][1:]], *map(self.owner.__getitem__, own[1:])])

    def __init__(self, path: str, most: int = 700_000):
        super().__init__()
        self.path, self.most, self.special = path, most, _special(path)
        self.one = encoder(path)
        self.older, self.words = {}, self.generation()

    def generation(self) -> Words:
        words = Cache.Words()
        words.owner = self
        return words

    def make_room(self) -> None:
        if len(self) + len(self.words) >= self.most:
            self.clear()
            self.older, self.words = self.words, self.generation()

    def __missing__(self, unit: str) -> bytes:
        self.make_room()
        ids = self[unit] = self.one(unit)
        return ids

    def encode(self, text: str) -> bytes:
        if self.special is None or not self.special.search(text):
            first, *rest = text.split(" ")
            if not first or first[-1] not in _BLANKS:
                try:
                    return b"".join([*map(self.__getitem__, UNIT.findall(first)), *map(self.words.__getitem__, rest)])
                except _Wide:
                    pass
        return b"".join(map(self.__getitem__, units(text, self.path)))


@functools.lru_cache(maxsize=2)
def cache(path: str) -> Cache:
    return Cache(path)


def _byte_table() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies, and the byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(keep))}


@functools.lru_cache(maxsize=2)
def piece_table(path: str) -> pa.Array:
    """The bytes of each id, as a table whose row number is the id: byte-level names mapped back, special tokens as written."""
    t, byte_of = load(path), _byte_table()
    added = {i: x.content for i, x in t.get_added_tokens_decoder().items()}
    size = max([*t.get_vocab().values(), *added]) + 1
    out = [b""] * size
    for name, i in t.get_vocab().items():
        out[i] = added[i].encode() if i in added else bytes(byte_of[c] for c in name)
    return pa.array(out, pa.binary())
