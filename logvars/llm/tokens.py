"""Token ids of whole texts by a public tokenizer file."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from struct import pack

# Letters whose lower case and composition depend on no neighbour: A-Z, a-z, and Latin letters up to U+017F.
_LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-įĲ-ſ"
_MARKS = r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(f"[^\t-\r -&(-~{_LATIN}]")
# White space beyond ASCII's: texts with such characters are encoded in one piece.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‍    ⁠　﻿]")
_LETTERS = re.compile(f" ?[{_LATIN}]+")
_SPACES = r"[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
# By kind of pre-tokenizer, how texts of plain characters and other texts are cut.  No token crosses such a cut.
_CUTS = {
    "byte_level": (
        re.compile(rf" ?[{_LATIN}]+| ?[0-9]+| ?[{_MARKS}]+|{_SPACES}"),
        re.compile(rf" ?[^ \t-\r]+|{_SPACES}"),
    ),
    "words": (re.compile(rf"[{_LATIN}]+|[0-9]|[{_MARKS}]+"), re.compile(r"[^ \t-\r]+")),
}
#: Chunks in each of the two generations of a worker's cache, and the longest that is kept.
CACHED_CHUNKS, CACHED_LENGTH = 100_000, 48


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies (a fixed rule of such files)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder(dict):
    """Encodes texts by ``tokenizers``, each distinct chunk once; itself the cache of chunks.

    Pre-tokenizers of both kinds (``byte_level``, ``words``) never join characters across the cuts, so
    the ids equal those of the whole text.  ``chunks=None`` encodes whole texts.  Names of special
    tokens inside a text are ordinary text.
    """

    def __init__(self, path: str, chunks: str | None, cached: int = CACHED_CHUNKS):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.cuts = _CUTS[chunks] if chunks else None
        self.lower = chunks == "words"
        self.cached, self.older = cached, {}

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return pack("<%dI" % len(ids), *ids)

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            if _LETTERS.fullmatch(chunk) and not (self.lower and chunk != chunk.lower()):
                found = self.model.tokenize(chunk.encode().decode("latin-1").translate(self.letters))
                ids = pack("<%dI" % len(found), *[t.id for t in found])
            else:
                ids = self.whole(chunk)
        if len(chunk) <= CACHED_LENGTH:
            if len(self) >= self.cached:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null counts as empty."""
        for text in texts:
            if not text:
                yield b""
            elif self.cuts is None or not text.isascii() and _ODD_SPACE.search(text):
                yield self.whole(text)
            elif _PLAIN.search(text):
                yield b"".join(map(self.__getitem__, self.cuts[1].findall(text)))
            else:
                yield b"".join(map(self.__getitem__, self.cuts[0].findall(text.lower() if self.lower else text)))


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, chunks: str | None) -> Encoder:
    """One encoder for each worker process and file."""
    key = (path, chunks)
    if key not in _encoders:
        _encoders[key] = Encoder(path, chunks)
    return _encoders[key]
