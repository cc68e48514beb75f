"""A public byte-level tokenizer over whole texts, with a bounded memory of words.

A single space between two characters that are no white space always begins a token of its own, whatever stands around it.
So a text is cut at such spaces, and each piece has the tokens that it has in the text. Pieces repeat; each is encoded once
and remembered while there is room. New pieces go through a second, quicker encoder that is built from the same vocabulary,
whose ids are its merge ranks; it is compared with the first when it is made, and pieces that hold a special token's
string keep to the first.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

ROOM = 400_000
_BLANKS = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_TRIAL = "It's 3 o'clock — naïve coöperation, 12345 (see §7)!\n\n  Über   die Straße…\tend \r\n" * 2


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """Letters that byte-level vocabularies use for bytes: printable ones stand for themselves, the rest follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = tuple(t["content"] for t in spec.get("added_tokens", []))
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        quick = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        same = quick.encode_ordinary(_TRIAL) == self.tokenizer.encode(_TRIAL, add_special_tokens=False).ids
        self.quick = quick.encode_ordinary if same else self._slow
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def _slow(self, piece: str) -> list[int]:
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def _learn(self, memory: dict[str, bytes], pieces: list[str], lead: str) -> None:
        if len(memory) > ROOM:
            memory.clear()
        for p in pieces:
            if p not in memory:
                encode = self._slow if any(s in p for s in self.special) else self.quick
                memory[p] = array("I", encode(lead + p)).tobytes()

    def ids(self, text: str) -> bytes:
        """Ids of the whole text, as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        plain = not (text[0].isspace() or text[-1].isspace() or _BLANKS.search(text))
        head, *rest = text.split(" ") if plain else _CUT.split(text)
        if head not in self.first:
            self._learn(self.first, [head], "")
        start = self.first[head]
        try:
            return start + b"".join(map(self.later.__getitem__, rest))
        except KeyError:
            self._learn(self.later, rest, " ")
            return start + b"".join(map(self.later.__getitem__, rest))

    def sizes(self) -> np.ndarray:
        """Bytes of each token."""
        t = self.tokenizer
        return np.array([len(t.id_to_token(i) or "") for i in range(t.get_vocab_size())], np.int64)

    def sentence_ends(self) -> np.ndarray:
        """Whether a token ends a sentence or a line. Byte-level vocabularies show a line feed as U+010A."""
        t = self.tokenizer
        return np.array([bool(re.search("[.!?Ċ]$", t.id_to_token(i) or "")) for i in range(t.get_vocab_size())], bool)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)
