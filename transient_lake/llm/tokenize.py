"""Exact token ids of whole texts through per-worker caches of pre-tokens.

Both vocabularies split a text at white space before any merge, so the ids of
a text are the concatenated ids of its white-space-led pieces.  A worker keeps
the ids of the pieces it has met; only unknown pieces go to the library, and a
text costs one dictionary lookup per word.  An unknown piece of Latin letters
with punctuation behind it is two pre-tokens whatever stands around it: these
go to the library's BPE model as they are; any other piece is encoded whole.

Byte-level vocabulary: a piece is a word with the one blank or line feed that
leads it.  Runs of two or more white-space characters are cut out first: all
but the last character of a run are one pre-token, the last leads the next
word, a run that ends the text is one pre-token.  Special strings of the
vocabulary inside a text become their special id, as the library does by
default.  Word vocabulary: white space is dropped, so a piece is what stands
between ASCII white space; the library sees every piece whole (its own
normaliser, special strings and further splitting apply inside the piece).

Null and empty texts have no tokens.  Ids are little-endian unsigned 32-bit.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: White space as the byte-level pattern sees it (Unicode White_Space).
_WS = r"[\t-\r \x85\xa0  -     　]"
_RUNS = re.compile(f"({_WS}{_WS}+)")
#: Entries of a generation of a worker's cache; two generations are kept, about 180 MB.
CACHE_ENTRIES = 450_000
_LONGEST_CACHED = 128
#: Letters that every Unicode version has and that are their own normal form, then ASCII punctuation but the apostrophe.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)\Z")
#: A run of ASCII punctuation (no apostrophe) between an ASCII letter or digit and a separator of pieces is a
#: pre-token in both vocabularies.
_MARKS = rb"([!-&(-/:-@\[-`{-~](?<=[A-Za-z0-9].)[!-&(-/:-@\[-`{-~]*)"
_BYTE_TAIL = re.compile(_MARKS + rb"(?=[ \n]|\Z)")
_WORD_TAIL = re.compile(_MARKS + rb"(?=[ \t\n\r]|\Z)")
#: Leads a piece that has no blank before it.
_BARE = b"\x01"


def _byte_letters() -> dict[int, str]:
    """Characters that stand for bytes in byte-level vocabularies: printable
    Latin-1 for itself, the others in order from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


class RecentCache:
    """A bounded dictionary: when the young generation is full it becomes the
    old one, whose entries come back when they are asked for."""

    def __init__(self, entries: int | None = None):
        self.entries = entries
        self.young: dict = {}
        self.old: dict = {}

    def find(self, key):
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.young) >= (self.entries or CACHE_ENTRIES):
            self.old, self.young = self.young, {}
        self.young[key] = value

    def all(self, keys: list, make, keep) -> list:
        """Values of the keys; unknown ones are made, and kept if ``keep(key)``."""
        got, i = list(map(self.young.get, keys)), -1
        for _ in range(got.count(None)):
            i = got.index(None, i + 1)
            k = keys[i]
            value = self.young.get(k)  # a repeated key was made just before
            if value is None:
                value = self.old.get(k)
                if value is None:
                    value = make(k)
                if keep(k):
                    self.put(k, value)
            got[i] = value
        return got

    def __len__(self) -> int:
        return len(self.young) + len(self.old)


_HELD: dict = {}


def hold(key, make):
    """A worker's one large object: made anew when another operator held its
    own before, so the caches of several operators never add up."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def is_short(piece: bytes) -> bool:
    return len(piece) <= _LONGEST_CACHED


def _ids(encoding) -> bytes:
    return np.asarray(encoding.ids, dtype="<u4").tobytes()


class PieceEncoder:
    """Ids of texts for one vocabulary file, with a bounded cache."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task is the unit of work
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        specials = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items() if t.special}
        self.special = {s: np.asarray([i], dtype="<u4").tobytes() for s, i in specials.items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.special_bytes = [s.encode().lower() for s in specials]
        self.by_word = self.tok.model.end_of_word_suffix is not None
        self.cache = RecentCache()
        self.lead = "" if self.by_word else _BYTE_LETTERS[32]  # what a blank before a word is

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.by_word:
            return b"".join(self._known(self.word_pieces(text)))
        if self.at_special is not None and self.at_special.search(text):
            parts = self.at_special.split(text)
            return b"".join(self.special[p] if i % 2 else self._plain(p) for i, p in enumerate(parts))
        return self._plain(text)

    def word_pieces(self, text: str) -> list[bytes]:
        """What stands between white space, A-Z in lower case (as the library
        does) and the punctuation behind a word for itself."""
        data = text.encode()
        if self.special and any(s in data.lower() for s in self.special_bytes):
            return data.split()
        return _WORD_TAIL.sub(rb" \1", data.lower()).split()

    def _plain(self, text: str) -> bytes:
        if not _RUNS.search(text):
            return self._single_spaced(text)
        parts = _RUNS.split(text)  # words, run, words, run, ..., words
        out = [self._single_spaced(parts[0])]
        for run, words in zip(parts[1::2], parts[2::2]):
            if not words:
                out.append(_ids(self.tok.encode(run, add_special_tokens=False)))
            else:
                out.append(_ids(self.tok.encode(run[:-1], add_special_tokens=False)))
                out.append(self._single_spaced(run[-1] + words))
        return b"".join(out)

    def _single_spaced(self, text: str) -> bytes:
        # one white-space character would join the added line feed; a text's own \x01 is no mark
        if len(text) < 2 or "\x01" in text:
            return _ids(self.tok.encode(text, add_special_tokens=False))
        # a led line feed is a token of its own: the first word gets one, which is taken off again
        return b"".join(self._known(byte_pieces(text)))[4:]

    def _known(self, pieces: list[bytes]) -> list[bytes]:
        return self.cache.all(pieces, self.ids_of, is_short)

    def ids_of(self, piece: bytes) -> bytes:
        """Ids of one piece, from the library."""
        if piece.isalpha():  # ASCII letters stand for themselves
            word = piece.lower() if self.by_word else piece
            return array("I", [t.id for t in self.tok.model.tokenize(self.lead + word.decode())]).tobytes()
        if piece[:1] == _BARE and not self.by_word:  # ASCII punctuation stands for itself
            return array("I", [t.id for t in self.tok.model.tokenize(piece[1:].decode())]).tobytes()
        text = piece.decode()
        plain = _PLAIN.match(text)
        if plain is None or not text:
            return _ids(self.tok.encode(self._text(piece), add_special_tokens=False))
        word, marks = plain.groups()
        if not word or not marks:
            return self._pre_token(text, blank=True)
        # the blank that leads the piece belongs to its first pre-token
        return self._part(piece[:-len(marks)], word, True) + self._part(b" " + piece[-len(marks):], marks, False)

    def _part(self, key: bytes, text: str, blank: bool) -> bytes:
        got = self.cache.find(key)
        if got is None:
            got = self._pre_token(text, blank)
            if is_short(key):
                self.cache.put(key, got)
        return got

    def _pre_token(self, text: str, blank: bool) -> bytes:
        if self.by_word:
            text = text.lower()
        elif blank:
            text = " " + text
        letters = text.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.tok.model.tokenize(letters)]).tobytes()

    def _text(self, piece: bytes) -> str:
        if piece[:1] == _BARE and not self.by_word:
            return piece[1:].decode()
        return piece.decode() if self.by_word or piece[:1] == b"\n" else " " + piece.decode()


def byte_pieces(text: str) -> list[bytes]:
    """Pieces of a text without white-space runs, the first led by an added
    line feed.  ``w`` stands for a blank and w, ``\\nw`` for itself, ``\\x01m`` for
    the punctuation m behind a word (the text has no such character itself)."""
    data = _BYTE_TAIL.sub(b" \x01\\1", text.encode())
    pieces = data.replace(b"\n", b" \n").split(b" ")
    pieces[0] = b"\n" + pieces[0]
    return pieces


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder of a vocabulary file (kept between tasks)."""
    return hold(("ids", path), lambda: PieceEncoder(path))
