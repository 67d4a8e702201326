"""Token ids of whole texts with the tokenizers library, with a bounded memo of pieces.

A piece of a text (a word with the white space before it, or marks after it) becomes the same ids wherever it stands, so each worker asks the
library once for each piece that it meets and joins the answers. Texts whose characters all are Latin-1, by far the most in Western corpora, are cut
as bytes; others are cut at white space; and any text with a special token's string or with white space of another shape goes to the library as it is.
"""

from __future__ import annotations

import functools
import os
import zlib

import numpy as np

#: Pieces that a worker keeps at most, about 200 bytes each.
MEMO = 700_000
#: Marks that both tokenizers cut from letters before them; of these, the ones before which Latin-1 texts are cut.
MARKS = ".,!?;:|%$#*&"
CUT = (b".", b",", b"!", b"?", b";", b":")

#: Byte-level BPE writes bytes as characters: printable ones as they are, the rest from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _PRINTED} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_SPACE = chr(_BYTES[32])
#: What a Latin-1 character is: a a letter or digit, s a space or line end, w other white space and controls, ',' a mark to cut before, ! all else.
_SHAPE = bytes(
    ord("s") if b in (10, 32) else ord("w") if b < 32 or b in (0x85, 0xA0) else ord(",") if bytes([b]) in CUT else ord("a") if chr(b).isalnum() else ord("!")
    for b in range(256)
)


class _Pieces(dict):
    """Ids of pieces, as little-endian unsigned 32-bit integers; Latin-1 bytes or strings."""

    def __init__(self, whole, model, lower: bool, most: int):
        super().__init__()
        self.whole, self.model, self.lower, self.most = whole, model, lower, most

    def _letters(self, word: str, bare: str) -> bytes:
        """Latin-1 letters, maybe after a space, are one piece, so the library's model can be asked without its steps that cut and normalise."""
        if self.lower:
            word = bare = bare.lower()
        if bare.isascii():
            word = bare if bare is word else _SPACE + bare
        else:
            word = word.encode().decode("latin-1").translate(_BYTES)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word)])

    def __missing__(self, piece: bytes | str) -> bytes:
        word = piece if isinstance(piece, str) else piece.decode("latin-1")
        bare = word[1:] if word[:1] == " " else word
        if bare.isalpha():
            ids = self._letters(word, bare) if bare.isascii() or max(bare) <= "\xff" else self.whole(word)
        else:
            letters = bare.rstrip(MARKS)
            if letters != bare and letters.isalpha() and max(letters) <= "\xff":  # in others, lower case may end in a mark
                n = len(bare) - len(letters)
                ids = self[piece[:-n]] + self[piece[-n:]]
            else:
                ids = self.whole(word)
        if len(self) < self.most and len(piece) <= 64:
            self[piece] = ids
        return ids


class Encoder:
    """The ids of texts, exactly those of the library's ``encode(text, add_special_tokens=False)``.

    ``spaced``: the tokenizer encodes white space too, a single space with the word after it (byte-level BPE); else it drops white space and case.
    """

    def __init__(self, path: str, spaced: bool, memo: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = tokenizer.get_added_tokens_decoder().values()
        self._special = [t.content for t in added]
        if any(t.normalized for t in added):
            self._special.append("")  # its string can take many forms, so every text goes to the library
        self._whole = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self._pieces = _Pieces(self._whole, tokenizer.model, not spaced, memo)
        self._cut = self._spaced if spaced else self._bare

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self._special):
            return self._whole(text)
        pieces = self._cut(text)
        return self._whole(text) if pieces is None else b"".join(map(self._pieces.__getitem__, pieces))

    @staticmethod
    def _latin(text: str) -> bytes | None:
        try:
            return text.encode("latin-1")
        except UnicodeEncodeError:
            return None

    def _bare(self, text: str) -> list | None:
        raw = self._latin(text)
        if raw is None:
            words = text.split()
            return words if " ".join(words) == text.replace("\n", " ") else None
        shape, raw = raw.translate(_SHAPE), raw.lower()
        if b",," not in shape and b"!," not in shape and b"w," not in shape:  # else a run of marks or controls would be torn
            for mark in CUT:
                raw = raw.replace(mark, b" " + mark)
        return raw.split()

    def _spaced(self, text: str) -> list | None:
        raw = self._latin(text)
        if raw is None:
            words = text.split()
            if " ".join(words) != text.replace("\n", " "):
                return None
            return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if "\0" not in text else None
        shape = raw.translate(_SHAPE)
        if b"w" in shape or b"ss" in shape or shape[:1] == b"s" or shape[-1:] == b"s":
            return None
        raw = raw.replace(b" ", b"\0 ").replace(b"\n", b"\0\n\0")
        if b",," not in shape and b"!," not in shape and b"s," not in shape:
            for mark in CUT:
                raw = raw.replace(mark, b"\0" + mark)
        return raw.split(b"\0")


@functools.lru_cache(maxsize=4)
def encoder(path: str, spaced: bool, memo: int = MEMO) -> Encoder:
    """One for each worker process."""
    return Encoder(path, spaced, memo)


def forget() -> None:
    """Drops a worker's memo, and gives back what Arrow holds: other operators call it as they begin, since workers live on between stages."""
    import pyarrow as pa

    encoder.cache_clear()
    pa.default_memory_pool().release_unused()


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
