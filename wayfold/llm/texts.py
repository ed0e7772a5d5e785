"""Whole texts as bytes and words, in bounded pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LONG_TEXT = 1 << 20
BLOCK = 1 << 16


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """White-space words in blocks of bounded size, so that a huge text never becomes one huge list."""
    if len(data) <= LONG_TEXT:
        yield data.split()
        return
    block = []
    for m in WORD.finditer(data):
        block.append(m[0])
        if len(block) == BLOCK:
            yield block
            block = []
    yield block
