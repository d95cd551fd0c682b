"""Token ids of whole texts by a public tokenizer file, with a bounded memory of words.

Both tokenizer files used here split a text into runs of letters, digits and
other signs before merging, and never look past such a split. A text is
therefore cut before each run of letters together with the white space in front
of it, and after that run; each part is encoded once by the library and
remembered, per Python worker. Texts with signs beyond printable Latin ones, or
with apostrophes (which bind letters), are encoded whole, and so are texts that
may hold one of the file's added tokens, which the library finds before it
splits. Ids are those of the library either way (tested).
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np

from .common import FORGET

_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
#: Anything but printable Latin signs, spaces and line ends; apostrophes; a letter that lower-casing takes apart.
_OTHER = re.compile("[^ -~\n¡-¬®-ɏ]|['İ]")
_RUN = re.compile(f"([ \n]*[{_LETTERS}]+)")
#: Bytes of texts that need no closer look: printable ASCII, line ends, and most two-byte letters.
_PLAIN = bytes([10, *(b for b in range(32, 127) if b != 39), *range(0x80, 0xC0), *range(0xC3, 0xC9)])
#: Remembered parts; beyond them the less used ones are forgotten, so that at most half remain.
MOST_PARTS = 1_000_000
BATCH = 256


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _unclear(text: str) -> bool:
    rest = text.encode("utf-8", "surrogatepass").translate(None, _PLAIN)
    return bool(rest or "İ" in text) and bool(_OTHER.search(text))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this process, so that tasks of one Python worker share its memory until another operator's run there."""
    return Encoder(path)


FORGET.append(encoder.cache_clear)


class _Numbers(dict):
    """Numbers of parts in order of first use."""

    def __missing__(self, part: str) -> int:
        number = self[part] = len(self)
        return number


class Encoder:
    """Encodes texts to arrays of ids without special tokens."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Sought in texts as given: neither file normalizes them.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.sizes, self.flat = array("i"), array("i")
        self.uses = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the most used half of the parts at most, with their ids."""
        least = np.partition(self.uses, len(self.uses) // 2)[len(self.uses) // 2]
        kept = self.uses > least
        sizes, flat = np.frombuffer(self.sizes, np.int32), np.frombuffer(self.flat, np.int32)
        numbers = _Numbers()
        for part, keep in zip(self.numbers, kept.tolist(), strict=True):
            if keep:
                numbers[part]
        rest = array("i", flat[np.repeat(kept, sizes)].tobytes()), array("i", sizes[kept].tobytes())
        self.numbers, (self.flat, self.sizes), self.uses = numbers, rest, self.uses[kept] // 2

    def _remember(self, parts: list[str]) -> None:
        for at in range(0, len(parts), BATCH):  # few results at a time, so that their memory is used again
            for e in self.tokenizer.encode_batch_fast(parts[at : at + BATCH], add_special_tokens=False):
                own = e.ids
                self.flat.extend(own)
                self.sizes.append(len(own))

    def _uncut(self, text: str) -> bool:
        return _unclear(text) or any(t in text for t in self.added)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, in order. Call it with a few MB of text at a time."""
        if len(self.numbers) > MOST_PARTS:
            self._forget()
        known, number = len(self.numbers), self.numbers.__getitem__
        cut = [None if self._uncut(t) else array("i", map(number, filter(None, _RUN.split(t)))) for t in texts]
        if len(self.numbers) > known:
            self._remember(list(self.numbers)[known:])
        of = np.frombuffer(array("i", chain.from_iterable(c for c in cut if c)), np.int32)
        uses = np.bincount(of, minlength=len(self.numbers))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        sizes, flat = np.frombuffer(self.sizes, np.int32), np.frombuffer(self.flat, np.int32)
        starts = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=starts[1:])
        lengths = sizes[of].astype(np.int64)
        ends = np.cumsum(lengths)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[of] - (ends - lengths), lengths)]
        bounds = np.append(0, ends)[np.cumsum([0, *(len(c or ()) for c in cut)])]
        return [self._whole(t) if c is None else ids[a:b] for t, c, a, b in zip(texts, cut, bounds[:-1], bounds[1:], strict=True)]
