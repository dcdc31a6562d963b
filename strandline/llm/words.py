"""Words of byte strings, a bounded part of a text at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

PIECE = 1 << 20  # bytes of a text whose words are held at once
_SPACE, _WORD = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"[^\x20\x09-\x0D]")


def pieces(raw: bytes, overlap: int, size: int = PIECE) -> Iterator[tuple[list[bytes], int]]:
    """The words (by white space) of a text in lists, and how many words at a list's start
    were the end of the one before: ``overlap``, so that every stretch of overlap + 1 words
    is in one list, and in one only. A text with fewer words gives one list, or none."""
    at, carry, carried = 0, [], 0
    while at < len(raw):
        end = len(raw)
        if end - at > size:
            space = _SPACE.search(raw, at + size)
            end = space.start() if space else end
        words = carry + raw[at:end].split()
        at = end
        if len(words) <= overlap and at < len(raw):
            carry = words
            continue
        if len(words) > carried:
            yield words, carried
        carry = words[len(words) - overlap :]
        carried = len(carry)
        if not _WORD.search(raw, at):
            return
