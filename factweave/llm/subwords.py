"""Subword ids of whole texts, exactly as the tokenizers library gives them, with a memory of the pieces between lone spaces.

In a byte-level BPE whose splitting pattern lets a lone space only start a token, a text in which every space is lone can be
cut before each space: the ids of the whole are those of the parts in turn. Parts repeat, so each is encoded once and looked
up afterwards. A text with other white space, with characters beyond Latin-1 or with a special string goes to the library
whole. Misses use the same vocabulary as ranks where that file is given, else the library.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache
from pathlib import Path

import numpy as np

#: White space within Latin-1 other than the lone space and the lone line feed, and their pairs.
IRREGULAR = ("  ", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0")
MEMORY = 600_000
#: The array type of 32-bit ids.
WORD = "I"


@lru_cache(maxsize=2)
def encoder(path: str, ranks: str | None = None) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path, ranks)


def located(path: str) -> str:
    """A bare file name is one of the public tokenizers, looked up on the machine that reads it."""
    if "/" in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


@lru_cache(maxsize=4)
def version_digest(path: str) -> str:
    """Names the tokenizer version: a digest of its file and of the library's version."""
    import tokenizers

    return hashlib.sha256(Path(located(path)).read_bytes() + tokenizers.__version__.encode()).hexdigest()


class Encoder:
    def __init__(self, path: str, ranks: str | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(located(path))
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [str(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.lengths: np.ndarray | None = None
        self.few = self._few(ranks) if ranks else self._whole
        self.memory: dict[str, bytes] = {}

    def _few(self, ranks: str):
        import public_tokenizers
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(located(ranks)).read_bytes().splitlines())}
        self.lengths = np.zeros(max(table.values()) + 1, dtype=np.int64)
        self.lengths[list(table.values())] = [len(x) for x in table]
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def _whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def pieces(self, text: str) -> list[str] | None:
        """The parts of a regular text, or None."""
        try:
            text.isascii() or text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if any(x in text for x in IRREGULAR) or any(x in text for x in self.special):
            return None
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def each(self, parts: list[str]) -> list[bytes]:
        """The ids of parts that start with a space and hold no other white space. Regular ones are encoded in one go: a token starts at each."""
        if self.lengths is None:
            return [array(WORD, self.few(x)).tobytes() for x in parts]
        text = "".join(parts)
        if self.pieces(text) is None:
            return [self._alone(x) for x in parts]
        ids = array(WORD, self.few(text))
        token_ends = np.cumsum(self.lengths[np.frombuffer(ids, dtype="<u4")])
        ends = np.cumsum([len(x.encode()) for x in parts])
        cuts = ((np.searchsorted(token_ends, ends) + 1) * 4).tolist()
        got = ids.tobytes()
        return [got[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _alone(self, text: str) -> bytes:
        return array(WORD, self._whole(text) if self.pieces(text) is None else self.few(text)).tobytes()

    def _learn(self, parts: list[str]) -> None:
        """Puts the ids of new parts into memory."""
        spaced = [x for x in parts if x[:1] == " " and x[-1:] not in "\n "]
        self.memory.update(zip(spaced, self.each(spaced), strict=True) if spaced else ())
        for x in parts:
            if x not in self.memory:
                self.memory[x] = array(WORD, self.few(x)).tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        parts = self.pieces(text)
        if parts is None:
            return array(WORD, self._whole(text)).tobytes()
        memory = self.memory
        if new := [x for x in set(parts) if x not in memory]:
            self._learn(new)
        out = b"".join(map(memory.__getitem__, parts))
        if len(memory) > MEMORY:
            memory.clear()
        return out

    def count(self, text: str) -> int:
        return len(self.ids(text)) // 4
