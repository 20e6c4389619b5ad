"""Token counts of whole texts, with a shortcut for pieces that are one token.

Offline, before any text is read, every string of the tokenizer's vocabulary is written as text and encoded alone. Those that
come out as exactly their own token are proven whole tokens. Texts are cut into pre-tokens where the tokenizer cuts as well
(see ``pieces``); a pre-token that is a proven string counts as 1 without any merging, and only the others are merged. The
proof holds a row for each vocabulary string, whatever the corpus, so it is sent to all tasks.

Null texts are empty and count 0. Texts of any length are counted whole, one at a time in a task; of one above a million characters no
list of pieces is made. Rows that repeat are counted one by one, a null doc_id stays null, an empty table gives no rows. Columns beyond
doc_id and text are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import text_batches, tidied, worker_cache
from corpusloom.llm.pieces import Pieces

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_LONG = 1_000_000


def whole_tokens(path: str, word_end: str = "</w>") -> list[str]:
    """The texts whose encoding is exactly the one token that the vocabulary writes so; ``word_end`` is the mark of a word's last part, if there is one."""
    enc = Pieces(path, False, most=0)
    byte_of = {letter: b for b, letter in enc.letters.items()}
    vocabulary = enc.tokenizer.get_vocab(with_added_tokens=False)
    marked = any(v.endswith(word_end) for v in vocabulary)
    texts, ids = [], []
    for v, i in vocabulary.items():
        if marked and not v.endswith(word_end):
            continue  # a part of a word, never a whole one
        try:
            texts.append(bytes(byte_of[c] for c in (v.removesuffix(word_end) if marked else v)).decode())
            ids.append(i)
        except (KeyError, UnicodeDecodeError):  # a part of a character
            continue
    return sorted(t for t, i, e in zip(texts, ids, enc.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True) if t and e.ids == [i] and not enc.odd(t))


class Counts(dict):
    """pre-token -> its number of tokens: the proven ones from the start, ``most`` others as they come."""

    def __init__(self, path: str, keeps_space: bool, whole: list[str], most: int = 250_000):
        super().__init__(dict.fromkeys(whole, 1))
        self.enc = Pieces(path, keeps_space, most=0)
        self.room = len(self) + most
        self.small_letters = self.enc.plain and not keeps_space  # plain words are lower-cased first, as probes have shown
        self.plain = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
        self.merged = 0

    def __missing__(self, piece: str) -> int:
        if self.small_letters and self.plain(piece) and dict.get(self, piece.lower()) == 1:
            n = 1
        else:
            self.merged += 1
            n = len(self.enc[piece]) // self.enc.kind.itemsize
        if len(self) < self.room and len(piece) < 64:
            self[piece] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.enc.odd(text):
            return len(self.enc.encode(text))
        if len(text) > _LONG:
            return sum(self[m[0]] for m in self.enc.finder.finditer(text))
        return sum(map(self.__getitem__, self.enc.find(text)))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, keeps_space: bool = False) -> DataFrame:
    """One row per document: SCHEMA. No shuffle: each task counts the texts that it reads."""
    text_batches(docs.sparkSession)
    proven = docs.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer))
    name = f"token counts {tokenizer} {keeps_space}"

    def counted(batches):
        import pyarrow as pa

        held = worker_cache(name)
        if 0 not in held:
            held[0] = Counts(tokenizer, keeps_space, proven.value)
        for b in batches:
            n = [held[0].count(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(tidied(counted), SCHEMA)
