"""Encoding of texts with a public byte-level BPE vocabulary inside tasks.

The vocabulary file is found by name with ``public_tokenizers.path``; it is a parameter
and is never copied.  The pattern of byte-level BPE always starts a new piece at a space or
line end that stands alone between other text, and after a run of letters that common
punctuation follows.  Texts are cut there, the pieces a worker has met before come from a
table, and the others go through the tokenizers library, so that the ids are those of
encoding the text in one call.  A text with longer white space, or with the string of an
added token, is encoded in one call.
"""

from __future__ import annotations

import array
import os
import re
from collections.abc import Sequence

#: Pieces in each of a table's two generations; those met again outlive their generation.
REMEMBERED = 250_000

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_WORD = re.compile(rf" ?[{_LETTERS}]+")
_PIECE = re.compile(rf"[ \n]?[{_LETTERS}]+(?=[,.!?;:|]|\Z)|[ \n]?[^ \n]+|\n")


class _Whole(Exception):
    """The text must be encoded in one call."""


class _Pieces(dict):
    """Ids of pieces; a key stands for itself after ``before``, where it doesn't start a line."""

    def __init__(self, encoder: Encoder, before: str) -> None:
        super().__init__()
        self.encoder, self.before, self.older = encoder, before, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(key)
        if ids is None:
            if not key and not self.before:
                return b""
            if not key or key[-1].isspace() and (key != "\n" or self.before):
                raise _Whole
            ids = self.encoder.piece(key if key[0] == "\n" else self.before + key)
        self[key] = ids
        return ids


class Encoder:
    """Ids of texts as little-endian unsigned 16-bit bytes (vocabularies below 65536 ids)."""

    def __init__(self, vocabulary: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.tokenizer.normalizer is not None or not isinstance(self.tokenizer.pre_tokenizer, ByteLevel):
            raise ValueError("not a byte-level vocabulary")
        self.model, split = self.tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): split.pre_tokenize_str(c)[0][0] for c in map(chr, range(0x250)) if c == " " or _WORD.fullmatch(c)}
        self.first, self.later = _Pieces(self, ""), _Pieces(self, " ")

    def _plain(self, text: str) -> bytes:
        return array.array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, text: str) -> bytes:
        """Ids of a piece as it stands between other pieces."""
        if _WORD.fullmatch(text):  # one piece of the pattern, in the alphabet of bytes
            return array.array("H", [t.id for t in self.model.tokenize(text.translate(self.letters))]).tobytes()
        if text[0] == "\n" and len(text) > 1 and not text[1].isspace():
            return self.first["\n"] + self.first[text[1:]]
        parts = _PIECE.findall(text)
        if len(parts) < 2:
            return self._plain(text)
        return b"".join(self.later[p[1:]] if p[0] == " " else self.first[p] for p in parts)

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        out, later = [], self.later.__getitem__
        for text in texts:
            head, *rest = text.replace("\n", " \n").split(" ")
            try:
                if any(t in text for t in self.added):
                    raise _Whole
                out.append(self.first[head] + b"".join(map(later, rest)))
            except _Whole:
                out.append(self._plain(text))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One encoder for each worker process, kept between tasks."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]
