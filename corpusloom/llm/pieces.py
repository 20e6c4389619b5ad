"""Whole-text encoding with the tokenizers library, faster on text that repeats its words.

Both tokenizer kinds split a text into words before they merge, and never merge across the cuts. A text is cut here only
where they cut as well (before a lone space, between a plain letter and plain punctuation, around white space), and the
library encodes each distinct piece once. The ids equal those of one call on the whole text. Texts with control
characters on whose class the libraries may differ, and texts that hold one of the tokenizer's added tokens, are encoded in one call.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from corpusloom.llm.common import worker_cache

_ODD = re.compile("[\x1c-\x1f\x85\u180e\u200b-\u200f\u2028\u2029\ufeff]")
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[.,;:!?|%*$&#\\s]|$)"
#: A space belongs to the word that follows it.
_WITH_SPACE = re.compile(rf" ?{_LETTERS}| ?\S+|\s+(?!\S)|\s")
#: White space is dropped.
_WITHOUT_SPACE = re.compile(rf"{_LETTERS}|\S+")


_PLAIN = re.compile("( ?)[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level models write for each byte: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pieces(dict):
    """piece -> its ids as bytes of ``kind``; holds ``most`` pieces, the others are encoded each time.

    A piece that is one plain word goes to the library's model at once, past its splitting, if that gives the same ids for
    a few probes; every other piece through its whole encoding.
    """

    def __init__(self, path: str, keeps_space: bool, most: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.odd = re.compile("|".join([_ODD.pattern, *map(re.escape, added)]), re.IGNORECASE).search
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 65536 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.finder = _WITH_SPACE if keeps_space else _WITHOUT_SPACE
        self.find = self.finder.findall
        self.most = most
        self.keeps_space = keeps_space
        self.letters = _byte_letters()
        self.model = self.tokenizer.model.tokenize
        self.plain = False
        probes = ["The", "straße", "Été", "aÿÀzhouroundeaux", *([" the", " Ünter", " thonreésh"] if keeps_space else [])]
        self.plain = all(self.word(p) == self.whole(p) for p in probes)

    def whole(self, piece: str) -> bytes:
        return array(self.code, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def word(self, piece: str) -> bytes:
        if not self.keeps_space:
            piece = piece.lower()
        return array(self.code, [t.id for t in self.model(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self.word(piece) if self.plain and _PLAIN(piece) else self.whole(piece)
        if len(self) < self.most and len(piece) < 64:
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self.odd(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)
        return np.frombuffer(b"".join(map(self.__getitem__, self.find(text))), self.kind)


def pieces(path: str, keeps_space: bool) -> Pieces:
    """One for each Python worker, as long as it does nothing else."""
    held = worker_cache(f"pieces {path} {keeps_space}")
    if 0 not in held:
        held[0] = Pieces(path, keeps_space)
    return held[0]
