"""Token ids of whole texts, with the pieces between white space looked up first.

White space that stands alone between two other characters always starts a new piece
in the tokenizers used here, so a text is cut there and each different piece is
encoded once per worker.  Pieces of plain letters go straight to the model; all others
go through the tokenizer itself.  Byte-level models are merged by tiktoken, whole texts at
once, and nothing is remembered.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
from tiktoken import Encoding
from tokenizers import Tokenizer, pre_tokenizers

CACHE_PIECES = 1_000_000
# Fixed value: how byte-level models cut texts before they merge letters.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_TAILS = frozenset(".,;:!?")
_LOOSE = re.compile(r"\s\s|^\s|\s\Z|\x00")
_SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)")


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level models write each byte: printable ones as they are,
    the others as the letters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(0x100 + k) for k, b in enumerate(others)}}


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Tokens and ids of a byte-level model whose ids follow its merges, else None.

    tiktoken merges by these several times faster than the library the file is for, and
    finds the same ids; it knows no special tokens then, which are plain text to it.
    """
    with open(path, encoding="utf-8") as f:
        described = json.load(f)
    model, cut = described["model"], described.get("pre_tokenizer") or {}
    if described.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space"):
        return None
    pairs = ((m if isinstance(m, list) else m.split(" ")) for m in model["merges"])
    if any(model["vocab"].get("".join(m)) != 256 + i for i, m in enumerate(pairs)):
        return None
    letters = {letter: byte for byte, letter in byte_letters().items()}
    last = 256 + len(model["merges"])
    return {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if i < last}


class Encoder(dict):
    """Piece to its ids (little-endian unsigned 32-bit); unknown pieces are encoded."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # with a normalizer white space is dropped and letters are lower-cased;
        # without one a piece keeps the white space before it
        self.drops_space = self.tokenizer.normalizer is not None
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {c: letters.pre_tokenize_str(chr(c))[0][0] for c in range(0x21, 0x100)}
        self.space = letters.pre_tokenize_str(" ")[0][0]
        self.tails = {c: self._ids(c) for c in _TAILS}
        ranks = byte_ranks(path)
        self.bytewise = ranks and Encoding("bytewise", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _ids(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece)]

    def __missing__(self, piece):
        text = piece.decode() if self.drops_space else piece
        body, front = text, ""
        if not self.drops_space and text[:1] == " ":
            body, front = text[1:], self.space
        tail = body[-1:] if body[-1:] in _TAILS else ""
        body = body[:-1] if tail else body
        if body.isalpha() and (body.isascii() or max(body) <= "\xff"):
            body = body.lower() if self.drops_space else body
            ids = self._ids(front + body.translate(self.spelled))
            ids = ids + self.tails[tail] if tail else ids
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        found = np.array(ids, "<u4").tobytes()
        self[piece] = found
        return found

    def _pieces(self, text: str) -> list:
        if self.drops_space:
            return text.encode().split()
        if _LOOSE.search(text):
            return _SAFE.split(text)
        return text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")

    def encode(self, text: str | None) -> bytes:
        """All ids of one text, empty for null."""
        if not text:
            return b""
        if self.bytewise and not any(map(text.__contains__, self.special)):
            return np.array(self.bytewise.encode_ordinary(text), "<u4").tobytes()
        if len(self) > CACHE_PIECES:
            self.clear()
        return b"".join(map(self.__getitem__, self._pieces(text)))


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
