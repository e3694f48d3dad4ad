"""Pieces of text that a byte-level tokenizer treats alike alone and in the text."""

from __future__ import annotations

import re
from collections.abc import Callable

# A single space between two characters that aren't white space always begins a new match of the
# tokenizers' pattern, and no match crosses it.
SAFE = re.compile(r" (?<=\S )(?=\S)")
KEPT_CHARS, KEPT_CHUNKS = 48, 600_000


class ChunkIds(dict):
    """Packed ids of chunks (without their leading space); ``encode`` gives those of any text.

    The memory is bounded: it is emptied when it holds ``KEPT_CHUNKS``, and long chunks are never
    kept.
    """

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(" " + chunk)
        if len(chunk) <= KEPT_CHARS:
            if len(self) >= KEPT_CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids

    def ids_of(self, text: str) -> bytes:
        head, *chunks = SAFE.split(text)
        return self.encode(head) + b"".join(map(self.__getitem__, chunks))
