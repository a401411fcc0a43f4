"""Token ids of whole texts, by a tokenizer file of the tokenizers library."""

from __future__ import annotations

import os
import re
import struct

import numpy as np

_LETTER, _DIGIT = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Texts of these characters alone are Unicode-normal already, and lower case and blanks mean the same to Python and the tokenizer.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\xff]")
#: The pieces into which the tokenizer splits such a text, lowered.
_PIECE = re.compile(f"[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{_DIGIT}]|[^ \\t\\n\\r{_LETTER}{_DIGIT}]+")
KEPT_PIECES = 900_000


class _Pieces(dict):
    """Ids of one piece, as little-endian 16-bit bytes."""

    def __init__(self, tokenizer):
        from tokenizers import pre_tokenizers

        self.model = tokenizer.model
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # the model reads bytes as characters; those of ASCII stand for themselves
        self.as_bytes = {c: bytewise.pre_tokenize_str(chr(c))[0][0] for c in range(0xA1, 0x100)}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KEPT_PIECES:
            self.clear()
        ids = [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(self.as_bytes))]
        ids = struct.pack(f"<{len(ids)}H", *ids)
        if len(piece) < 64:
            self[piece] = ids
        return ids


class WordEncoder:
    """Encodes as the word-end tokenizer in `path` does, which splits texts into pieces that are encoded alone.

    Nearly all pieces repeat, so their ids are kept. Texts with characters whose normal form, case or
    blanks could depend on the library, or with what may be a special token, go through the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary has ids beyond 16 bits")
        self.pieces = _Pieces(self.tokenizer)

    def encode(self, text: str) -> bytes:
        """Little-endian 16-bit ids."""
        if _PLAIN.search(text) or "<|" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text.lower())))
