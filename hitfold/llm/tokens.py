"""Token ids of whole texts with the ``tokenizers`` library, each distinct word encoded once per worker.

Both kinds of vocabulary split a text before they merge, and no merge crosses white space. So a text cut at its
spaces gives fragments whose ids do not depend on their neighbours, and a worker keeps the ids of those it has met, in a cache of bounded
size. Texts whose white space is not plain (runs, tabs, separators of Unicode) are encoded whole.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cache

import numpy as np
from tokenizers import Tokenizer

#: Fragments in the newer half of a worker's cache; when it is full, it becomes the older half, which is given up.
CACHE = 350_000
#: White space and controls at which libraries may differ, and other signs that are not joined to words in a plain way.
_ODD = re.compile("[\x00\t\r\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁯　﻿]")
_TAIL = ".,"


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Encoder:
    """Ids of texts for one tokenizer file, as little-endian integers of ``kind``."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        #: Their strings in a text are ids of their own, as the library has it; such texts are encoded whole.
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.words = spec["model"]["end_of_word_suffix"] is not None
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.space = self.letters[32]
        owner, code, merge, space = self, self.code, self.merge, "" if self.words else self.space

        class Known(dict):
            older: dict = {}

            def __missing__(self, key):
                value = self.older.get(key)
                if value is None:
                    if space and key.isascii() and key.isalpha():  # most new words; as ``_piece`` does
                        value = array(code, [t.id for t in merge(space + key)]).tobytes()
                    else:
                        value = owner._ids(key)
                if len(self) >= CACHE:
                    self.older = dict(self)
                    self.clear()
                self[key] = value
                return value

        self.known = Known()
        self.tails: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, text: str, spaced: bool) -> bytes:
        """A fragment without white space, after a space or not."""
        core = text.rstrip(_TAIL)
        if not core.isalpha() or not core.isascii() and max(core) >= "Ā":
            return self._whole(" " + text if spaced else text)
        if len(core) < len(text) and (spaced or self.words):
            return self.known[core] + self._tail(text[len(core) :])
        mapped = core.lower() if self.words else core
        if not core.isascii():
            mapped = "".join(map(self.letters.__getitem__, mapped.encode()))
        out = array(self.code, [t.id for t in self.merge(self.space + mapped if spaced else mapped)]).tobytes()
        return out + self._tail(text[len(core) :])

    def _tail(self, tail: str) -> bytes:
        if not tail:
            return b""
        if tail not in self.tails and len(self.tails) < 1000:
            self.tails[tail] = self._whole(tail)
        return self.tails.get(tail) or self._whole(tail)

    def _ids(self, key: str) -> bytes:
        if self.words:
            return self._piece(key, False)
        if key[:1] == "\n":
            return self._whole("\n") + (self._piece(key[1:], False) if len(key) > 1 else b"")
        if key[:1] == "\0":
            return self._piece(key[1:], False) if len(key) > 1 else b""
        return self._piece(key, True)

    def _fragments(self, text: str) -> list[str] | None:
        """The fragments of a text that may be cut at its white space, else None."""
        if _ODD.search(text) or any(x in text for x in self.special):
            return None
        if self.words:
            return text.split()
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n":
            return None
        keys = text.replace("\n", " \n").split(" ")
        keys[0] = "\0" + keys[0]
        return keys

    def encode(self, text: str | None) -> bytes:
        """The ids of a text; null and empty have none."""
        if not text:
            return b""
        keys = self._fragments(text)
        return self._whole(text) if keys is None else b"".join(map(self.known.__getitem__, keys))


@cache
def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file that every executor has at ``path``."""
    return Encoder(path)
