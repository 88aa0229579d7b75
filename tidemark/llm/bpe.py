"""BPE encoding and decoding as a bounded-lookahead streaming transducer, and token counting.

A merge list has a *sufficient lookahead*: a number of symbols L such that a token of the
encoding of a prefix whose end lies at least L symbols before the prefix's end is also a token of
the encoding of every longer text.  The reason is that a right neighbour can only break a merge
by taking part in an earlier merge itself, so influence travels leftwards along chains of merges
of strictly falling rank, and the total length of such a chain is bounded by the merge list.
``sufficient_lookahead`` finds the longest chain in one pass over the merges.  The encoder keeps
a window of a few times (L + longest token) symbols, merges inside it, hands on what is stable and
goes on: its memory doesn't depend on the text.  Pieces are remembered in a bounded worker cache.
"""

from __future__ import annotations

import codecs
import functools
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

#: White space as the tokenizer files' patterns see it (Unicode White_Space).
SPACE = "\t-\r \x85\xa0  -     　"
#: Characters that Python's split() takes for white space and the patterns don't.
FILE_MARKS = re.compile("[\x1c-\x1f]")
#: Letters and numbers of Unicode 16.0, which the tokenizer files' patterns go by, that 15.1 doesn't have.
ADDED = {
    "L": "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B "
         "1138E-1138E 11390-113B5 113B7-113B7 113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C "
         "18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0",
    "N": "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"}
#: Capitals of Unicode 16.0 and 17.0 with the first of their lower-case forms, by which word-end files fold.
LOWERED = {"1C89-1C89": "1C8A", "A7CB-A7CB": "0264", "A7CC-A7CC": "A7CD", "A7CE-A7CE": "A7CF", "A7D2-A7D2": "A7D3",
           "A7D4-A7D4": "A7D5", "A7DA-A7DA": "A7DB", "A7DC-A7DC": "019B", "10D50-10D65": "10D70", "16EA0-16EB8": "16EBB"}
#: Most entries of a generation of a worker's cache; longer pieces than this are encoded without it.
CACHE_ENTRIES, CACHED_CHARS = 150_000, 96


@functools.cache
def byte_chars() -> list[str]:
    """The character that byte-level vocabularies write for each byte: printable Latin-1 ones
    stand for themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in set(shown))
    table = {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


@functools.cache
def char_class(kind: str) -> str:
    """The ranges of a character class: all letters (L) or numbers (N) of Unicode 16.0, whatever the
    versions that the installed regular expression modules know."""
    codes = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == kind]
    for part in ADDED[kind].split():
        codes += code_range(part)
    runs: list[list[int]] = []
    for c in sorted(set(codes)):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in runs)


class MergeList:
    """Merges of a tokenizer file with its lookahead; ``suffix`` marks a word's last symbol."""

    def __init__(self, merges: Iterable[tuple[str, str]], vocab: dict[str, int], suffix: str = ""):
        self.rank = {tuple(m): i for i, m in reversed(list(enumerate(merges)))}
        self.vocab, self.suffix = vocab, suffix
        self.longest = max((len(t) for t in vocab), default=1)
        self.lookahead = self.sufficient_lookahead()

    def sufficient_lookahead(self) -> int:
        """Length of the longest chain of merges through which a right context can act.

        For a merge (u, v), v may instead be taken by an earlier merge (v, z), or its right end
        by an earlier merge still; z in turn depends on its own right.  ``reach[t]`` holds, for
        the merges read so far, how far a token t (or its right spine) can be influenced.
        """
        reach: dict[str, int] = {}
        for (u, v), _ in sorted(self.rank.items(), key=lambda x: x[1]):
            beyond = len(v) + reach.get(v, 0)
            new = u + v
            reach[new] = max(reach.get(new, 0), reach.get(v, 0))
            reach[u] = max(reach.get(u, 0), beyond)
        return max(reach.values(), default=0)

    def merge(self, symbols: list[str]) -> list[str]:
        """Lowest rank first, leftmost first, until no adjacent pair is in the list."""
        get, none = self.rank.get, 1 << 60
        symbols = list(symbols)
        ranks = [get(p, none) for p in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = get((symbols[i], symbols[i + 1]), none)
        return symbols

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one pre-token from its symbols, each as soon as it can't change any more."""
        width = 4 * (self.lookahead + self.longest)
        held: list[str] = []
        last = None
        for s in symbols:
            if last is not None:
                held.append(last)
                if len(held) >= width:
                    tokens, used = self.merge(held), 0
                    for t in tokens:
                        if used + len(t) > len(held) - self.lookahead:
                            break
                        used += len(t)
                        yield t
                    held = held[used:]
            last = s
        if last is not None:
            yield from self.merge([*held, last + self.suffix])


BYTE_TABLE = str.maketrans({b: c for b, c in enumerate(byte_chars())})


def symbols_of(text: str) -> Iterator[str]:
    """Byte-level symbols, a stretch of the text at a time."""
    for i in range(0, len(text), 4096):
        yield from text[i:i + 4096].encode("utf-8", "replace").decode("latin-1").translate(BYTE_TABLE)


class Cache(dict):
    """A worker's memory of pieces, bounded: when full it becomes the old generation, from which
    what is still in use comes back.  ``fixed`` is a table to look into before making a value."""

    def __init__(self, make, fixed: dict | None = None, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.fixed, self.entries, self.old = make, fixed or {}, entries, {}

    def __missing__(self, key):
        value = self.fixed.get(key)
        if value is None:
            value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > CACHED_CHARS:
                return value
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def code_range(part: str) -> range:
    first, last = (int(x, 16) for x in part.split("-"))
    return range(first, last + 1)


LOWER_TABLE = {c: int(to, 16) + c - code_range(part)[0] for part, to in LOWERED.items() for c in code_range(part)}


def lower(text: str) -> str:
    """Lower case character by character (no special form of a final sigma)."""
    return text.replace("Σ", "σ").lower().translate(LOWER_TABLE)


def pieces(text: str, size: int = 1 << 16) -> Iterator[str]:
    """The text in runs of about ``size`` characters, cut at white space (a longer run without
    any is kept whole)."""
    space, at = re.compile(f"[{SPACE}]"), 0
    while at < len(text):
        m = space.search(text, at + size)
        end = m.end() if m else len(text)
        yield text[at:end]
        at = end


class Tokenizer:
    """A byte-level BPE tokenizer file (with or without word ends), read once per worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.word_ends = bool(model.get("end_of_word_suffix"))
        self.merges = MergeList(merges, model["vocab"], model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.spelled = {str(i): t for i, t in self.names.items()}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        letter, number = char_class("L"), char_class("N")
        #: The pre-token patterns of the two kinds of file.
        self.pattern = re.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{SPACE}{letter}{number}]+" if self.word_ends else
            rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+"
            rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.words = Cache(self.word_entry)
        self.lengths = Cache(lambda w: len(self.word_tokens(w)))
        # a space between white space (or at the end after it) doesn't stand alone: the runs are matched together
        self.joint = re.compile(rf"[{SPACE}] (?:[{SPACE}]|\Z)")

    def split_special(self, text: str) -> Iterator[tuple[str, str | None]]:
        """(stretch of text, the special token after it or None)."""
        at = 0
        for m in self.cut.finditer(text) if "<" in text else ():
            yield text[at:m.start()], m.group()
            at = m.end()
        yield text[at:], None

    def word_tokens(self, word: str) -> list[str]:
        """Token strings of one pre-token."""
        if len(word) > CACHED_CHARS:
            return list(self.merges.stream(symbols_of(word)))
        symbols = [*symbols_of(word)]
        symbols[-1] += self.merges.suffix
        return self.merges.merge(symbols)

    def word_entry(self, word: str) -> str:
        return " ".join([str(self.merges.vocab[x]) for x in self.word_tokens(word)])

    def entry(self, piece: str) -> str:
        """Ids, joined by spaces, of a piece without white space."""
        piece = piece.lower() if piece.isascii() else lower(unicodedata.normalize("NFC", piece))
        return " ".join([self.words[w] for w in self.pattern.findall(piece)])

    def spell(self, ids: str) -> str:
        """What ids joined by spaces decode to by a file without decoder: each id's string, joined by
        spaces.  Ids stand alone there, so a text can be decoded run by run."""
        return " ".join(map(self.spelled.__getitem__, ids.split(" ")))

    def encode_words(self, text: str, cache: Cache) -> Iterator[tuple[str, str]]:
        """(ids, what they decode to) of the text run by run, for files that drop white space."""
        for stretch, special in self.split_special(text):
            for run in pieces(stretch):
                words = re.findall(f"[^{SPACE}]+", run) if FILE_MARKS.search(run) else run.split()
                if words:
                    ids = " ".join(map(cache.__getitem__, words))
                    yield ids, self.spell(ids)
            if special is not None:
                ids = str(self.special[special])
                yield ids, self.spell(ids)

    def count(self, text: str, cache: Cache) -> int:
        """Number of tokens, for files that keep white space."""
        n = 0
        for stretch, special in self.split_special(text):
            n += special is not None
            if not stretch:
                continue
            if self.joint.search(stretch):
                n += sum(self.lengths[m.group()] for m in self.pattern.finditer(stretch))
            else:
                first, *rest = stretch.split(" ")
                n += sum(map(cache.__getitem__, rest)) + self.bare_length(first)
        return n

    def length(self, piece: str) -> int:
        """Tokens of a piece that follows a space."""
        return self.bare_length(" " + piece)

    def bare_length(self, text: str) -> int:
        """Tokens of a stretch of text as it stands."""
        return sum([self.lengths[w] for w in self.pattern.findall(text)])

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of the ids, piece by piece: token strings become bytes, and a UTF-8 decoder that
        keeps its state between tokens turns them into characters; a word end becomes a space."""
        back = {c: b for b, c in enumerate(byte_chars())}
        state = codecs.getincrementaldecoder("utf-8")("replace")
        suffix = self.merges.suffix
        for i in ids:
            name = self.names[i]
            if name in self.special:
                yield state.decode(b"", True) + name
                state.reset()
                continue
            end = bool(suffix) and name.endswith(suffix)
            raw = bytes(back[c] for c in (name[:-len(suffix)] if end else name))
            yield state.decode(raw) + (" " if end else "")
        yield state.decode(b"", True)


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)
