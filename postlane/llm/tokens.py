"""Fast exact encoding with a public tokenizer.

A text is cut where no token can span the cut, and each distinct piece is
encoded once per worker. The cuts are before runs of blanks and line ends that
follow something else; texts with other white space next to which a cut could
matter are encoded whole.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

# White space besides blank and line end, of any definition.
_ODD = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0 ᠎ -‏    　﻿]")
_RUNS = ("  ", " \n", "\n ", "\n\n")
_MARK, _ENDS = "\0", (",", ".")
_PIECES = re.compile("[ \n]*[^ \n]+|[ \n]+")


#: Distinct pieces that a worker remembers, some 250 bytes each; more save encoding where the workers have the room.
REMEMBERED = 450_000


class _Index(dict):
    """Piece -> number; new pieces queue for encoding."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class Encoder:
    """`keeps_blanks`: whether blanks are part of tokens (byte-level) or dropped. `memory`: distinct pieces remembered at most;
    when that many are known, later ones are encoded for the texts at hand only."""

    def __init__(self, path: str, keeps_blanks: bool, memory: int = REMEMBERED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keeps_blanks, self.memory = Tokenizer.from_file(path), keeps_blanks, memory
        self.ends = {c: self.tokenizer.encode(c, add_special_tokens=False).ids for c in _ENDS}
        self.index = _Index()
        self.pool, self.starts, self.sizes, self.used = np.empty(1 << 20, np.uint32), np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int64), 0

    def _pieces(self, text: str) -> list[str]:
        """Keys of the text's pieces. A key with a mark in front stands for what follows the mark, one without for a blank and itself."""
        if not self.keeps_blanks:
            return text.replace("\n", " ").split(" ")
        if _ODD.search(text) or _MARK in text:
            return [_MARK + text]
        if any(r in text for r in _RUNS):
            return [_MARK + p for p in _PIECES.findall(text)]
        first, *rest = text.replace("\n", " " + _MARK + "\n").split(" ")
        return [first if first[:1] == _MARK else _MARK + first, *rest] if first else rest

    def _text_of(self, key: str) -> str:
        return key if not self.keeps_blanks else key[1:] if key[:1] == _MARK else " " + key

    def _number(self, text: str) -> np.ndarray:
        pieces = self._pieces(text)
        return np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))

    def _learn(self) -> None:
        """Encode new pieces. A letter and a comma or full stop at the end never share a token, so such a piece is its stem and the mark."""
        new, index = self.index.new, self.index
        if not new:
            return
        ended = [key for key in new if key[-1:] in _ENDS and key[-2:-1].isalpha()]
        stems = [index[key[:-1]] for key in ended]
        before, apart = len(index) - len(new), set(ended)
        whole = [key for key in new if key not in apart]
        ids: dict[str, list[int]] = {}
        for lo in range(0, len(whole), 2048):  # encodings are large; their ids are not
            some = whole[lo : lo + 2048]
            ids.update(zip(some, (x.ids for x in self.tokenizer.encode_batch_fast([self._text_of(key) for key in some], add_special_tokens=False))))
        for key, stem in zip(ended, stems):
            own = self.pool[self.starts[stem] : self.starts[stem] + self.sizes[stem]].tolist() if stem < before else ids[key[:-1]]
            ids[key] = own + self.ends[key[-1]]
        got = [ids[key] for key in new]
        n, sizes = len(index), np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum()))
        if n > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.empty(n, np.int64)]) for x in (self.starts, self.sizes))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(self.used // 2 + len(flat), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.sizes[before:n] = sizes
        self.starts[before:n] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)

    def _trim(self, used: int) -> None:
        """Forget what the last texts brought if that is beyond the memory."""
        if len(self.index) > self.memory:
            for key in self.index.new:
                del self.index[key]
            self.used = used
        self.index.new.clear()

    def encode(self, texts) -> Iterator[np.ndarray]:
        """Each text's ids as uint32, of a list or an Arrow column; null is empty. Works off some MB of text at a time."""
        group: list[str] = []
        size = 0
        for lo in range(0, len(texts), 256):
            some = texts[lo : lo + 256] if isinstance(texts, list) else texts.slice(lo, 256).to_pylist()
            for text in some:
                group.append(text or "")
                size += len(group[-1])
                if size > 2_000_000:
                    yield from self._encode(group)
                    group, size = [], 0
        yield from self._encode(group)

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        if not texts:
            return
        used = self.used
        numbers = [self._number(t) for t in texts]
        self._learn()
        at = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.arange(total) + np.repeat(self.starts[at] - (ends - sizes), sizes)]
        self._trim(used)
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *map(len, numbers)])]
        for i in range(len(texts)):
            yield ids[bounds[i] : bounds[i + 1]]


@lru_cache(4)
def shared(path: str, keeps_blanks: bool, memory: int = REMEMBERED) -> Encoder:
    """The worker's own encoder: what it has learned serves all tasks that the worker runs."""
    return Encoder(path, keeps_blanks, memory)


def forget() -> None:
    """Give a worker's encoders back before a task of another kind, which a reused worker may run next to others."""
    shared.cache_clear()
    trim()


def trim() -> None:
    """Hand freed memory, Arrow's too, back to the system: workers stay between tasks, and so does what they once used."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries can
        ctypes.CDLL(None).malloc_trim(0)
