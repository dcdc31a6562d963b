"""Token ids of the word BPE tokenizer, by cached words.

``WordTokenizer.encode`` gives exactly the ids of the tokenizer file. Where a text
has only characters for which normalisation and splitting are known to act on each
word alone, words are split by the file's own pattern and each distinct word is
encoded once, by the file's merges; any other text, and one that holds an added token of
the file (such as <|endoftext|>), goes through the tokenizer as a whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import regex

#: The file's split pattern.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Anything but printable ASCII, tab, line feed, carriage return and Latin letters up to U+024F.
_OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ]|İ")
_PIECES = regex.compile(PIECE)
CACHE = 200_000


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Marks a word's end in bytes; no UTF-8 text has it.
END = b"\xff"


def _merger(path: str):
    """The file's merges as ranks over bytes: a function from a word's bytes and END to
    ranks, and the id of each rank. Joining the last byte with END comes before all merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}

    def raw(symbol: str) -> bytes:
        last = symbol.endswith("</w>")
        return bytes(byte[c] for c in symbol.removesuffix("</w>")) + END * last

    ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + END: 256 + b for b in range(256)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ranks |= {raw(left) + raw(right): 512 + n for n, (left, right) in enumerate(pairs)}
    id_of = np.zeros(512 + len(pairs), "<u4")
    for symbol, i in model["vocab"].items():
        if (rank := ranks.get(raw(symbol) if all(c in byte for c in symbol.removesuffix("</w>")) else b"")) is not None:
            id_of[rank] = i
    return tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece, id_of


class Words(dict):
    """Ids, as bytes, of words as they stand between white space; unseen ones are encoded."""

    def __init__(self, path: str, limit: int):
        super().__init__()
        merge, id_of = _merger(path)
        self.merge, self.id_bytes, self.limit = merge, [i.tobytes() for i in id_of], limit
        self.pieces: dict[str, bytes] = {}  # of what the pattern makes of words

    def piece(self, p: str) -> bytes:
        data = self.pieces.get(p)
        if data is None:
            ids = self.id_bytes
            data = self.pieces[p] = b"".join([ids[r] for r in self.merge(p.encode("utf-8") + END)])
        return data

    def __missing__(self, word: str) -> bytes:
        low = word.lower()
        data = self[word] = self.piece(low) if low.isalpha() else b"".join([self.piece(p) for p in _PIECES.findall(low)])
        return data

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()
        if len(self.pieces) > self.limit:
            self.pieces.clear()


class WordTokenizer:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        # in any case: a token that the file normalises is found in lower-cased text
        added = sorted({re.escape(a.content.lower()) for a in self.whole.get_added_tokens_decoder().values() if a.content})
        self.added = re.compile("|".join(added) or r"(?!)", re.I)
        self.words = Words(path, cache)

    def encode(self, text: str) -> bytes:
        if _OTHER.search(text) or self.added.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = self.words
        words.trim()
        return b"".join([words[w] for w in text.split()])

    def count(self, text: str) -> int:
        return len(self.encode(text)) // 4


_ready: dict[str, WordTokenizer] = {}


def get(path: str) -> WordTokenizer:
    """The worker's tokenizer of ``path``, loaded once."""
    if path not in _ready:
        _ready[path] = WordTokenizer(path)
    return _ready[path]
