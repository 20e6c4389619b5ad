"""Streams of model output: folding chunks with think and write blocks, keyed by stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from corpusloom.streaming.keyed import keyed

#: A row for each piece, in the order of (seq, part), numbered by its first chunk of those that came together; the last one of a stream has the kind ``end`` and tells how it ended.
OUTPUT = "stream_id long, seq long, part int, kind string, text string, truncated boolean, tokens long"
_OPEN, _CLOSE, _WRITE, _END = "<think>", "</think>", "<writeFile>", "</writeFile>"
#: What models give as the reason for stopping at their limit.
CUT_OFF = ("length", "max_tokens", "MAX_TOKENS")


def _held(s: str, *marks: str) -> int:
    """How many last characters may begin a mark."""
    return max((k for m in marks for k in range(1, len(m)) if s.endswith(m[:k])), default=0)


def fold(buffer: str, thinking: bool, chunk: str, end: bool = False) -> tuple[list[tuple[str, str]], str, bool]:
    """Pieces (kind, text) that a chunk settles, what is still open, and whether it is thought. ``end``: nothing follows, so all is settled.

    Kinds: text, thought, file (a whole write block's content) and unopened (a thought's end without its beginning: all text before was thought).
    A write block that never ends is text.
    """
    s, out = buffer + chunk, []
    while s:
        if thinking:
            i = s.find(_CLOSE)
            cut = i if i >= 0 else len(s) - (0 if end else _held(s, _CLOSE))
            if cut:
                out.append(("thought", s[:cut]))
            if i < 0:
                s = s[cut:]
                break
            s, thinking = s[cut + len(_CLOSE) :], False
            continue
        found = [(i, m) for m in (_OPEN, _WRITE, _CLOSE) if (i := s.find(m)) >= 0]
        at, mark = min(found, default=(len(s) - (0 if end else _held(s, _OPEN, _WRITE, _CLOSE)), None))
        if at:
            out.append(("text", s[:at]))
        s = s[at:]
        if mark is None:
            break
        if mark == _WRITE:
            e = s.find(_END)
            if e >= 0:
                out.append(("file", s[len(_WRITE) : e]))
                s = s[e + len(_END) :]
            elif end:
                out.append(("text", s))
                s = ""
            else:
                break
        else:
            if mark == _CLOSE:
                out.append(("unopened", ""))
            s, thinking = s[len(mark) :], mark == _OPEN
    return out, s, thinking


#: Fixed value: chunks that wait behind a gap are kept in groups of so many numbers, each read and written at once.
_GROUP = 1024


class _Fold(StatefulProcessor):
    """Chunks in the order of seq, from 0; those that come too early wait in a map of groups. A stream ends with its last chunk, or after a silence."""

    def __init__(self, quiet_ms: int, thoughts: bool):
        self.quiet_ms, self.thoughts = quiet_ms, thoughts

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "next long, buffer string, thinking boolean, tokens long, due long, ended boolean, top long")
        self.early = handle.getMapState("early", "group long", "seqs array<long>, contents array<string>, finishes array<string>, tokens array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        nxt, buffer, thinking, tokens, due, ended, top = self.open.get() or (0, "", False, 0, 0, False, -1)  # top: the last chunk that waits
        if ended:
            return
        here: dict[int, tuple] = {}
        latest = 0
        for b in rows:  # an Arrow batch each; only together do they have an order
            latest = max(latest, int(b["at_ms"].max()))
            for q, c, f, t in zip(*(b[x].tolist() for x in ("seq", "content", "finish", "tokens")), strict=True):
                here[int(q)] = (c if isinstance(c, str) else "", f if isinstance(f, str) else None, None if pd.isna(t) else int(t))  # state takes no other types
        groups: dict[int, dict[int, tuple]] = {}
        changed: set[int] = set()
        first, run, finish = nxt, [], None
        while not ended:
            if nxt in here:
                chunk = here.pop(nxt)
            elif nxt <= top and nxt in self._waiting(groups, nxt // _GROUP):
                chunk = groups[nxt // _GROUP][nxt]
                changed.add(nxt // _GROUP)
            else:
                break
            content, finish, used = chunk
            run.append(content)
            tokens = tokens if used is None else used
            ended = finish is not None
            nxt += 1
        out: list[tuple] = []
        if run:  # chunks that follow each other are folded as one
            buffer, thinking = self._take(key, out, first, "".join(run), buffer, thinking, ended)
        if ended:
            self._end(key, out, nxt - 1, finish in CUT_OFF, tokens)
            if top >= 0:
                self.early.clear()
        else:
            for q, v in here.items():
                if q >= nxt:
                    (self._waiting(groups, q // _GROUP) if q // _GROUP <= top // _GROUP else groups.setdefault(q // _GROUP, {}))[q] = v
                    changed.add(q // _GROUP)
            top = max([top, *here])
            for g in changed:
                left = sorted((q, v) for q, v in groups[g].items() if q >= nxt)
                if left:
                    self.early.updateValue((g,), ([q for q, _ in left], *([v[i] for _, v in left] for i in range(3))))
                else:
                    self.early.removeKey((g,))
        if not due:  # one timer at a time: when it comes, it is set anew if the silence has begun anew; a stream that has ended is forgotten after one, too
            self.handle.registerTimer(self._due(latest, timerValues))
        due = max(due, self._due(latest, timerValues))
        self.open.update((nxt, buffer, thinking, tokens, due, ended, top))
        if out:
            yield self._frame(out)

    def _waiting(self, groups: dict, g: int) -> dict[int, tuple]:
        if g not in groups:
            kept = self.early.getValue((g,))
            groups[g] = {q: v for q, *v in zip(*kept, strict=True)} if kept else {}
        return groups[g]

    def _due(self, latest: int, timerValues) -> int:
        return max(latest + self.quiet_ms, timerValues.getCurrentWatermarkInMs() + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.open.get()
        if held is None:
            return
        nxt, buffer, thinking, tokens, due, ended, top = held
        if due > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
            return
        out: list[tuple] = []
        if not ended:  # what waits for a chunk that never came follows all the same
            waiting = sorted(x for _, kept in self.early.iterator() for x in zip(*kept, strict=True) if x[0] >= nxt) if top >= nxt else []
            last = (waiting[-1][0] if waiting else nxt - 1) + 1  # what the end settles comes after the last chunk's pieces
            finish = None
            for _, _, f, used in waiting:
                tokens = tokens if used is None else used
                finish = f or finish
            if waiting:
                buffer, thinking = self._take(key, out, waiting[0][0], "".join(x[1] for x in waiting), buffer, thinking, False)
            self._take(key, out, last, "", buffer, thinking, True)
            self._end(key, out, last, finish in CUT_OFF, tokens)
            if top >= 0:
                self.early.clear()
        self.open.clear()
        if out:
            yield self._frame(out)

    def _take(self, key, out, seq, content, buffer, thinking, end):
        pieces, buffer, thinking = fold(buffer, thinking, content, end)
        for kind, text in pieces:
            if self.thoughts or kind != "thought":
                n = out[-1][2] + 1 if out and out[-1][1] == seq else 0
                out.append((key[0], seq, n, kind, text, None, None))
        return buffer, thinking

    def _end(self, key, out, seq, truncated, tokens) -> None:
        out.append((key[0], seq, out[-1][2] + 1 if out and out[-1][1] == seq else 0, "end", "", truncated, tokens))

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["stream_id", "seq", "part", "kind", "text", "truncated", "tokens"], dtype=object)

    def close(self) -> None:
        pass


def fold_stream(chunks: DataFrame, late: str = "10 seconds", quiet_ms: int = 60_000, thoughts: bool = True) -> DataFrame:
    """Streaming (stream_id long, seq long from 0, content, finish, tokens, at timestamp) to OUTPUT.

    Chunks may come in any order within and across micro-batches, also twice; each stream's are folded by seq. ``finish`` is null but for the last chunk, where
    it tells the reason; ``tokens`` is the use so far, if known. A stream without a last chunk, or with a gap, ends when the watermark (``late`` behind the
    newest chunk of all) is ``quiet_ms`` beyond its newest chunk: what is open then comes out as it is. Without ``thoughts``, thoughts are left out. Null
    contents are empty. A null stream_id is a stream; chunks with a null seq are left out. What a stream holds as state is its
    chunks behind a gap, its open block and, for a silence after its end, that it has ended.
    """
    return keyed(chunks.where("seq is not null"), ["stream_id"], _Fold(quiet_ms, thoughts), OUTPUT, late)
