"""Encoders for public tokenizer files that encode each distinct piece of text once.

A text is cut only where the tokenizer's own splitting cuts it in any case, so the
ids of the pieces, joined, are those of the whole text.  Every distinct piece is
encoded by the tokenizer library once and its ids are kept as bytes in a bounded cache;
natural text repeats its words so often that this saves most of the encoding.
Added tokens in a text are cut out before that (``AddedTokens``).
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

#: Pieces in one generation of the cache, and the longest piece that it holds.
GENERATION, LONGEST = 300_000, 48
#: Texts are taken in lots of about so many characters.
LOT_CHARS = 1 << 20

#: Cuts before a single space or line end between two other characters.  Byte-level pre-tokenising
#: has a boundary there always, and what stands on either side cannot see across it.
_AT_SPACES = re.compile(r"\s*\S+(?:(?![ \n]\S)\s+\S+)*(?:\s+\Z)?|\s+\Z")


def resolve(name: str) -> str:
    """A path is taken as it is; a bare file name is one of the installed public tokenizers."""
    if os.path.dirname(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def words(text: str) -> list[str]:
    """For tokenizers that drop white space: pieces between ASCII white space."""
    for ch in "\n\t\r":
        if ch in text:
            text = text.replace(ch, " ")
    return text.split(" ")


def spaced(text: str) -> list[str]:
    """For byte-level tokenizers: pieces that carry the space before them."""
    return _AT_SPACES.findall(text)


#: Marks that may end a piece: there is a pre-token boundary before them if a letter or number stands there.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"


class _Pieces(dict):
    """Piece -> id bytes; what is missing is encoded.  Two generations bound it: pieces in use move to the younger.

    A word and the marks after it are looked up apart.  Where ``lines`` is given, pieces may hold
    single line ends between other characters, and what follows one is looked up in ``lines``.
    """

    def __init__(self, encode, generation: int, lines: _Pieces | bool | None = None):
        self.encode, self.generation, self.old = encode, generation, {}
        self.lines = self if lines is True else lines

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            if self.lines is not None and len(piece) > 1 and "\n" in piece:
                left, _, right = piece.partition("\n")
                return self[left] + self.lines["\n"] + self.lines[right]
            word = piece.rstrip(_MARKS)
            if word and word != piece and word[-1].lower()[-1].isalnum():  # some letters gain a combining mark in lower case
                return self[word] + self.lines_or_self[piece[len(word) :]]
            ids = self.encode(piece)
        if len(piece) <= LONGEST:
            if len(self) >= self.generation:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    @property
    def lines_or_self(self) -> _Pieces:
        return self if self.lines is None else self.lines


class CachedEncoder:
    """Texts -> ids as little-endian bytes of ``dtype``; ``encode_piece`` gives the ids of one piece."""

    def __init__(self, split, encode_piece, dtype: str = "<u4", generation: int = GENERATION):
        self.split = split
        code = {2: "H", 4: "I"}[np.dtype(dtype).itemsize]

        def as_bytes(piece: str) -> bytes:
            ids = encode_piece(piece)
            return struct.pack(f"<{len(ids)}{code}", *ids)

        self.as_bytes = as_bytes
        self.pieces = _Pieces(as_bytes, generation)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))


#: White space of any kind but the space and the line end, and what makes those irregular.
_OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_WIDE_SPACE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def regular(text: str) -> bool:
    """Whether all white space is single spaces and line ends between other characters."""
    if not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ("  ", "\n\n", " \n", "\n ")):
        return False
    return not any(x in text for x in _OTHER_SPACE) and (text.isascii() or not any(x in text for x in _WIDE_SPACE))


class SpacedEncoder(CachedEncoder):
    """For byte-level tokenizers: regular texts are cut at spaces by ``str.split``, which is quicker than the pattern."""

    def __init__(self, encode_piece, dtype: str, generation: int = GENERATION):
        super().__init__(spaced, encode_piece, dtype, generation)
        self.first = _Pieces(self.as_bytes, generation // 4, lines=True)
        self.after = _Pieces(lambda word: self.as_bytes(" " + word), generation, lines=self.first)

    def encode(self, text: str) -> bytes:
        if not regular(text):
            return super().encode(text)
        found = text.split(" ")
        return self.first[found[0]] + b"".join(map(self.after.__getitem__, found[1:]))


#: What the two tokenizers' own splitting does to printable ASCII; all else goes through the library's stages.
_PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[!-/:-`{-~]+")
_PLAIN_BYTE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[a-zA-Z]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+")
_PRINTABLE = re.compile(r"[!-~]+")
_SPACE_SIGN = "\u0120"  # how byte-level vocabularies write a space
#: Byte-level vocabularies write a byte as its Latin-1 character if that is visible, else as the next one from U+0100 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_BYTE_SIGNS = {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}


def _plain_word(piece: str) -> list[str] | None:
    if piece.isalpha() and piece.isascii():
        return [piece.lower()]
    return _PLAIN_WORD.findall(piece.lower()) if _PRINTABLE.fullmatch(piece) else None


def _plain_byte(piece: str) -> list[str] | None:
    word = piece[1:] if piece[:1] == " " else piece
    if word.isalpha():  # letters only: one pre-token, in the vocabulary's signs for its bytes
        return [(_SPACE_SIGN if len(word) < len(piece) else "") + (word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_SIGNS))]
    if not _PRINTABLE.fullmatch(piece, piece[:1] == " "):
        return None
    return [p.replace(" ", _SPACE_SIGN) for p in _PLAIN_BYTE.findall(piece)]


def _library(name: str, plain):
    """Ids of a piece by the stages of a tokenizer of the tokenizers library; added tokens are ordinary text here."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(resolve(name))
    cut, model = tok.pre_tokenizer.pre_tokenize_str, tok.model.tokenize
    normal = tok.normalizer.normalize_str if tok.normalizer else str

    def encode(piece: str) -> list[int]:
        parts = plain(piece)
        if parts is None:
            parts = [part for part, _ in cut(normal(piece))]
        return [t.id for part in parts for t in model(part)]

    return encode


@lru_cache(maxsize=4)
def word_encoder(name: str) -> CachedEncoder:
    return CachedEncoder(words, _library(name, _plain_word))


@lru_cache(maxsize=4)
def byte_encoder(name: str, dtype: str = "<u4") -> SpacedEncoder:
    return SpacedEncoder(_library(name, _plain_byte), dtype)


class AddedTokens:
    """Texts -> ids as the tokenizers library gives them by default, without special tokens of its own adding.

    A tokenizer's added tokens (an end marker, say) that stand in a text have their own ids; ``encoder``
    encodes what is between them, each stretch as a text of its own, as the library does.
    """

    def __init__(self, name: str, encoder: CachedEncoder, dtype: str):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(resolve(name))
        added = tok.get_added_tokens_decoder()
        self.encoder, self.dtype = encoder, dtype
        self.ids = {t.content: np.array([i], dtype).tobytes() for i, t in added.items() if t.content}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.ids, key=len, reverse=True))) + ")")
        # tokens that take white space in, stand as whole words or are sought in normalised text: the library's own work
        odd = any(t.lstrip or t.rstrip or t.single_word or t.normalized and tok.normalizer for t in added.values())
        self.library = tok if odd else None

    def encode(self, text: str) -> bytes:
        if self.library:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        if not any(map(text.__contains__, self.ids)):
            return self.encoder.encode(text)
        return b"".join(self.ids[part] if i % 2 else self.encoder.encode(part) for i, part in enumerate(self.cut.split(text)) if part)


@lru_cache(maxsize=4)
def word_document_encoder(name: str) -> AddedTokens:
    return AddedTokens(name, word_encoder(name), "<u4")


@lru_cache(maxsize=4)
def byte_document_encoder(name: str, dtype: str = "<u4") -> AddedTokens:
    return AddedTokens(name, byte_encoder(name, dtype), dtype)


def lots(rows: Iterable[tuple], size) -> Iterator[list[tuple]]:
    """Lists of rows whose sizes add up to about ``LOT_CHARS``."""
    lot, total = [], 0
    for row in rows:
        lot.append(row)
        total += size(row)
        if total >= LOT_CHARS:
            yield lot
            lot, total = [], 0
    if lot:
        yield lot


def arrow_rows(batches, *names: str) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, a few at a time in Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names), strict=True)
