"""Token ids of whole texts by a public tokenizer file, with a bounded memo of pieces.

A text is cut only where the file's own pre-tokenizer always cuts, whatever stands around: before a run of blanks and
line feeds, between a Latin letter and ASCII punctuation (not the apostrophe), and behind a punctuation run that such a
letter and white space enclose. So the ids of the text are the ids of its pieces in order; tests/llm/test_tokens.py
holds this against the library on whole texts. A text with any other white space is encoded whole. Every id comes from
the library (its model for plain ASCII words, its whole chain for all else); the memo only keeps it from doing the same
piece again.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Pieces kept at most; beyond it new pieces are encoded each time (a bound of memory, not of results).
MEMO = 500_000
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARK = r"!-&(-/:-@\[-`{-~"
_word = rf"[{_LETTER}]+(?=[ \n{_MARK}]|\Z)"
_marks = rf"[{_MARK}]+(?=[ \n]|\Z)"
_with_space = re.compile(rf"[ \n]*{_word}|{_marks}|[ \n]*[^ \n]+|[ \n]+")
_without_space = re.compile(rf"{_word}|{_marks}|[^ \n]+")
#: White space of any definition but blank and line feed, and characters that Unicode versions class differently.
_other_space = re.compile("[^\\S \\n]|[\\x1c-\\x1f\\x85\\u180e\\u200b\\ufeff]")


class _Memo(dict):
    """piece -> ids as bytes, filled on first use."""

    def __init__(self, encode, most: int) -> None:
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(self) < self.most and len(piece) <= 64:
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, path: str, dtype: str = "<u2", memo: int = MEMO) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        t.encode_special_tokens = True  # a control string in a text is ordinary text
        if t.get_vocab_size() > 1 << (8 * np.dtype(dtype).itemsize):
            raise ValueError(f"{dtype} cannot hold the ids of {path}")
        self.dtype = np.dtype(dtype)
        drops = not t.encode(" \n", add_special_tokens=False).ids
        self._cut = (_without_space if drops else _with_space).findall
        self._lower = drops and t.encode("A", add_special_tokens=False).ids == t.encode("a", add_special_tokens=False).ids
        self._memo = _Memo(self._piece, memo)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        word = piece[1:] if piece[0] == " " else piece
        if not (word.isascii() and word.isalpha()):
            return self._whole(piece)
        word = word.lower() if self._lower else "Ġ" + word if piece[0] == " " else word
        size = self.dtype.itemsize
        return b"".join([x.id.to_bytes(size, "little") for x in self.tokenizer.model.tokenize(word)])

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian bytes of dtype; a null text has none."""
        if not text:
            return b""
        if _other_space.search(text):
            return self._whole(text)
        return b"".join(map(self._memo.__getitem__, self._cut(text)))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, dtype: str = "<u2") -> Encoder:
    """One encoder for each file and worker process."""
    key = (path, dtype)
    if key not in _encoders:
        _encoders[key] = Encoder(path, dtype)
    return _encoders[key]
