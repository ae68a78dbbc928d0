"""Reading the vocabulary files of public tokenizers, and encoding with them.

The files are the ``tokenizers`` library's JSON. Merges run in ``tiktoken``'s byte-pair routine over
ranks taken from the file, which gives the same ids several times faster; anything outside the
alphabet that a shortcut is known to be right for goes to the ``tokenizers`` library itself.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import tiktoken
from tokenizers import Tokenizer

# How byte-level vocabularies part text, and the byte that stands for a word's end
# here (no UTF-8 text holds it).
PARTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_END = b"\xff"


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 stands for
    itself, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """Byte-level BPE of one file; special tokens in a text are recognised, as the library does."""

    _made: dict[str, ByteLevel] = {}

    @classmethod
    def of(cls, path: str) -> ByteLevel:
        """One instance per worker process."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(letters[c] for c in k): i for k, i in model["model"]["vocab"].items() if k not in self.special}
        self.encoding = tiktoken.Encoding("byte-level", pat_str=PARTS, mergeable_ranks=ranks, special_tokens=self.special)
        self.parts = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode(text, allowed_special="all")

    def merge(self, piece: bytes) -> list[int]:
        """Ids of bytes that are not parted any further."""
        return self.encoding._core_bpe.encode_single_piece(piece)

    def bytes_of(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


class Words:
    """Word-end BPE of one file: lower case, white space dropped. Ids as little-endian 32-bit bytes.

    White space parts a text into words that are encoded on their own, so each worker keeps the ids
    of words it has met: at most twice ``CACHE`` of them. When ``known`` is full it becomes ``older``,
    which words come back from when they are met again; the rest of it goes at the next change.
    """

    CACHE = 80_000
    _made: dict[str, Words] = {}
    # The alphabet in which lower-casing is letter by letter and nothing is composed.
    _plain = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
    _parts = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

    @classmethod
    def of(cls, path: str) -> Words:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_letters()
        self.special = [t["content"] for t in model["added_tokens"]]
        suffix = model["model"]["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            ended = token.endswith(suffix)
            return bytes(letters[c] for c in token.removesuffix(suffix)) + WORD_END * ended

        # A word's last byte and its end are one symbol from the start: their ranks come first.
        ranks = {bytes([b]): b for b in range(256)}
        for b in range(255):
            ranks[bytes([b]) + WORD_END] = 256 + b
        for pair in model["model"]["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            ranks.setdefault(raw(left) + raw(right), len(ranks))
        ids = {raw(k): i for k, i in model["model"]["vocab"].items() if k not in self.special}
        self.core = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.ids = [(ids[k] if k in ids else 0).to_bytes(4, "little") for k in ranks]
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if not self._plain.fullmatch(text) or "<|" in text:
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        core, ids = self.core.encode_single_piece, self.ids
        return b"".join([ids[i] for p in self._parts.findall(text.lower()) for i in core(p.encode() + WORD_END)])

    def encode(self, text: str) -> bytes:
        known, words = self.known, text.encode().split()
        got = [known.get(w) for w in words]
        if None in got:
            for i, g in enumerate(got):
                if g is None:
                    got[i] = self._met(words[i])
        return b"".join(got)

    def _met(self, word: bytes) -> bytes:
        """Ids of a word that was not in ``known`` when its text was looked up."""
        ids = self.known.get(word) or self.older.get(word) or self._word(word)
        if len(word) < 64:
            if len(self.known) >= self.CACHE:
                self.known, self.older = {}, self.known
            self.known[word] = ids
        return ids
