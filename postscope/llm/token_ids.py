"""Token ids of whole texts by a public tokenizer file, with a bounded word cache.

``ids(text)`` equals ``Tokenizer.encode(text, add_special_tokens=False).ids``;
``many(texts)`` gives the same for several texts at once.
The vocabulary with word ends folds case, drops white space and encodes each
match of one pattern by itself; on texts of code points up to U+00FF, which its
normal form leaves alone, ``_words`` finds the same matches, and the ids of each
distinct one are cached, without the marks, line ends and capitals around it.
The texts of a call are cut together, and each distinct word of theirs is looked
up once.
A text with other characters, or one that spells an added token, is cut at its
spaces as for the other vocabulary:
both vocabularies used here treat a space followed by a non-space as the start
of a new pre-token, so a text whose spaces stand alone is the concatenation of
its space-separated parts; each part's ids are cached as
little-endian unsigned 32-bit integers (words met first are kept: the frequent
ones come early).  Parts of Latin-1 letters
with at most one closing mark go straight to the vocabulary's merge step; every
other part goes through the full tokenizer, and so does a whole text with white
space beside a space.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa

from .common import utf8

CACHE = 1_100_000      # cached parts per worker process, about 180 bytes each
MARKS = ".,;:!?"
# Unicode's letters, numbers and white space up to U+00FF (Python's classes differ: \x1c-\x1f are no spaces here)
LETTERS, NUMBERS, SPACES = "a-zA-Zªµº\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
LOWER = bytes(ord(chr(c).lower()) for c in range(256))
SPACE, LETTER, NUMBER, OTHER = range(4)
KIND = np.array([next((k for k, among in ((SPACE, SPACES), (LETTER, LETTERS), (NUMBER, NUMBERS)) if re.match(f"[{among}]", chr(c))),
                      OTHER) for c in range(256)], np.uint8)

_loaded: dict[str, "TextIds"] = {}


def _byte_chars() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


def _words(data: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Matches of ``'s|'t|'re|'ve|'m|'ll|'d|letters|number|others`` in lower-cased bytes of U+0000 to U+00FF, and their places.

    Two spaces must end ``data``.
    """
    kind = KIND[data]
    begin = kind != SPACE
    begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    at = np.flatnonzero(begin & (data == ord("'")))
    a, b = data[at + 1], data[at + 2]
    is_ = {c: a == ord(c) for c in "stmdrvl"}
    size = (is_["s"] | is_["t"] | is_["m"] | is_["d"]) + 2 * (
        (is_["r"] | is_["v"]) & (b == ord("e")) | is_["l"] & (b == ord("l")))
    at, size = at[size > 0], size[size > 0]
    begin[at + 1] = False
    begin[at + 1 + size] = kind[at + 1 + size] != SPACE
    body = kind != SPACE
    letters = data[body]
    off = np.append(np.flatnonzero(begin[body]), len(letters))
    return np.flatnonzero(begin), pa.Array.from_buffers(
        pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(letters)])


class _Parts(dict):
    """Ids of space-separated parts; a missing part is encoded and kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, part: str):
        ids = self.encode(part)
        if len(self) < CACHE:
            self[part] = ids
        return ids


class TextIds:
    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.byte = _byte_chars()
        self.space = self.byte[32]
        # a vocabulary with word ends folds case and drops spaces; the other keeps the space with its word
        self.word_ends = bool(self.model.end_of_word_suffix)
        self.lead = "" if self.word_ends else " "
        self.parts = _Parts(self._encode_part)
        self.marks = {m: self._word(m) for m in MARKS}
        self.words = _Parts(self._encode_word)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]

    def _word(self, s: str) -> bytes:
        text = s.lower() if self.word_ends else s
        # ASCII letters stand for themselves, the space has its own sign
        text = text.replace(" ", self.space) if text.isascii() else text.encode().decode("latin-1").translate(self.byte)
        found = [t.id for t in self.model.tokenize(text)]
        return struct.pack(f"<{len(found)}I", *found)

    def _full(self, s: str) -> bytes:
        return np.array(self.tok.encode(s, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode_part(self, part: str):
        """Ids of a part that follows a space; None if it is not safe to cut there."""
        if not part or part[0].isspace() or part[-1].isspace():
            return self._full(part) if self.word_ends else None
        mark = part[-1] if part[-1] in MARKS else ""
        body = part[:-1] if mark else part
        if body.isalpha() and (body.isascii() or max(body) <= "\xff"):
            ids = self._word(self.lead + body)
            return ids + self.marks[mark] if mark else ids
        return self._full(self.lead + part)

    def _encode_word(self, word: str) -> bytes:
        """Ids of a match of ``_words``."""
        if not (word.isascii() and word.isprintable()):
            word = word.encode().decode("latin-1").translate(self.byte)
        found = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(found)}I", *found)

    def _narrow(self, text: str) -> bytes | None:
        """The lower-cased text in Latin-1, if ``_words`` finds its words."""
        if not self.word_ends or any(a in text for a in self.added):
            return None
        try:
            return text.encode("latin-1").translate(LOWER)
        except UnicodeEncodeError:
            return None

    def _narrow_ids(self, texts: list[bytes]) -> list[np.ndarray]:
        ends = np.cumsum([len(t) + 1 for t in texts])
        at, words = _words(np.frombuffer(b" ".join([*texts, b" "]), np.uint8))
        if not len(at):
            return [np.empty(0, "<u4")] * len(texts)
        coded = words.dictionary_encode()
        letters, off = utf8(coded.dictionary)
        letters, off = letters.tobytes().decode("latin-1"), off.tolist()
        found = [self.words[letters[s:e]] for s, e in zip(off[:-1], off[1:])]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        which = coded.indices.to_numpy()
        stop = np.cumsum(size[which])
        # from the distinct words' ids, one after another, to those of the texts
        shift = (np.cumsum(size) - size)[which] - stop + size[which]
        ids = np.frombuffer(b"".join(found), "<u4")[np.arange(stop[-1]) + np.repeat(shift, size[which])]
        return np.split(ids, np.append(0, stop)[np.searchsorted(at, ends[:-1])])

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        narrow = [self._narrow(t) for t in texts]
        got = iter(self._narrow_ids([t for t in narrow if t is not None]) if any(t is not None for t in narrow) else [])
        return [self._spaced_ids(t) if n is None else next(got) for t, n in zip(texts, narrow)]

    def ids(self, text: str) -> np.ndarray:
        return self.many([text])[0]

    def _spaced_ids(self, text: str) -> np.ndarray:
        """Ids of a text by its space-separated parts."""
        first, _, rest = text.partition(" ")
        if not rest or not self.word_ends and (not first or first[-1].isspace()):
            return np.frombuffer(self._full(text), "<u4")
        try:
            out = self._full(first) + b"".join(map(self.parts.__getitem__, rest.split(" ")))
        except TypeError:  # a part beside other white space
            out = self._full(text)
        return np.frombuffer(out, "<u4")


def text_ids(path: str) -> TextIds:
    """The tokenizer of ``path``, loaded once per process."""
    if path not in _loaded:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[path] = TextIds(path)
    return _loaded[path]
