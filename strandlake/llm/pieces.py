"""SentencePiece models of the merge type: exact encoding by backtracking, and decoding.

A text is valid as a row of tokens exactly if each two neighbours are compatible, that
is, if merging their joined characters afresh gives the two back. The encoder takes
the longest token that fits at a place (an Aho-Corasick automaton finds them all in
one pass), checks it against the token before, and goes on to shorter tokens, and then
back, where a check fails. Places from which no row of tokens goes on are marked in a
bitfield, so that none is tried twice and the time is linear in the text.

No piece has white space after another sign, so that a text is encoded in runs that
begin with white space, and runs met before are remembered (up to twice REMEMBERED of them).
Runs of several spaces are made of pieces that all have one score; those are merged by
score and then from the left, which is what the model means.

Defined results: a null text counts as empty, which has no ids and decodes to an empty
text; null ids pass through; repeated rows give equal rows; an empty table gives an
empty table; other columns are ignored by `encode` and `decode`.
"""

from __future__ import annotations

import heapq
import math
import re
import sys
import types
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame

SPACE = "▁"
REMEMBERED = 150_000
#: Rows that are encoded before their results are passed on.
ROWS_TOGETHER = 128
#: Longer runs are not remembered.
LONGEST_REMEMBERED = 48


class Pieces:
    """The vocabulary of a model file, and what encoding and decoding derive from it."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(model.vocab_size())
        self.texts = [model.id_to_piece(i) for i in size]
        self.bytes = {i: int(self.texts[i][1:-1], 16) for i in size if model.is_byte(i)}
        self.silent = {i for i in size if model.is_control(i)}
        self.unknown = {i for i in size if model.is_unknown(i)}
        plain = [i for i in size if i not in self.bytes and i not in self.silent and i not in self.unknown]
        self.ids = {self.texts[i]: i for i in plain}
        self.scores = {self.texts[i]: model.get_score(i) for i in plain}
        if model.normalize("a  b") != f"{SPACE}a{SPACE}{SPACE}b" or any(SPACE in t.lstrip(SPACE) for t in self.ids):
            raise ValueError("only models that keep all text, with a prefix, and have white space at the start of pieces")
        if not self.bytes:
            raise ValueError("only models with bytes for unknown signs")
        by_score: dict[float, list[str]] = {}
        for t, score in self.scores.items():
            by_score.setdefault(score, []).append(t)
        if any(len(ts) > 1 and any(t.strip(SPACE) for t in ts) for ts in by_score.values()):
            raise ValueError("only models whose scores differ, but for runs of white space")
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        # A byte below 128 is a sign by itself; what others say depends on their neighbours.
        self.said = [chr(self.bytes[i]) if i in self.bytes else self.texts[i].replace(SPACE, " ") for i in size]
        self.special = self.silent | self.unknown | {i for i, b in self.bytes.items() if b > 127}
        # The two pieces whose merging makes a token, for tokens that merging their signs makes.
        self.halves: dict[str, tuple[str, str]] = {}
        reached = [t for t in self.ids if (not set(t) <= {SPACE} or len(t) == 1) and self.merged(t, self.halves) == [t]]
        self.ends: dict[str, list[tuple[str, float]]] = {}
        self.starts: dict[str, list[tuple[str, float]]] = {}
        self.longest = ahocorasick.Automaton()
        for t in reached:
            self.longest.add_word(t, (len(t) - 1, t))
        self.longest.make_automaton()
        self.shorter = _shorter(reached)
        self.fits: dict[str, dict[str, bool]] = {}
        self.n_fits = 0
        self.runs: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.blanks: dict[int, tuple[int, ...]] = {}

    def merged(self, text: str, halves: dict[str, tuple[str, str]] | None = None) -> list[str]:
        """The pieces that merging makes of a text: always the best score, from the left where scores are equal.

        If the whole text becomes one piece, halves gets the two of which the last merge made it.
        """
        piece: list[str | None] = [*text]
        after, before = [*range(1, len(text) + 1)], [*range(-1, len(text) - 1)]
        pairs: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < len(text) and (score := self.scores.get(both := piece[left] + piece[right])) is not None:
                heapq.heappush(pairs, (-score, left, right, both))

        for i in range(len(text) - 1):
            offer(i, i + 1)
        while pairs:
            _, left, right, both = heapq.heappop(pairs)
            if piece[left] is None or piece[right] is None or after[left] != right or piece[left] + piece[right] != both:
                continue
            if halves is not None and both == text:
                halves[text] = piece[left], piece[right]
            piece[left], piece[right] = both, None
            after[left] = after[right]
            if after[right] < len(text):
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [p for p in piece if p is not None]

    def edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """The pieces at the start (0) or end (1) of a token, from a sign to the whole, as merging makes them.

        With each comes the score of the merge that takes it in.
        """
        cache = self.ends if side else self.starts
        if token not in cache:
            row, into = [], -math.inf
            while token in self.halves:
                row.append((token, into))
                into = self.scores[token]
                token = self.halves[token][side]
            whole = row[0][0] if row else token
            cache[whole] = [(token, into), *reversed(row)]
            token = whole
        return cache[token]

    def remerge(self, left: str, right: str) -> bool:
        """Whether merging the signs of two tokens together gives the two back.

        Each merges within itself as it does alone, until a pair across the border is
        better than what would take either piece at the border in. Equal scores go from
        the left.
        """
        ends, starts, score = self.edge(left, 1), self.edge(right, 0), self.scores.get
        i = j = 0
        while True:
            (end, end_into), (start, start_into) = ends[i], starts[j]
            across = score(end + start)
            if across is not None and across > end_into and across >= start_into:
                return False
            if end_into >= start_into:
                if end_into == -math.inf:
                    return True
                i += 1
            else:
                j += 1

    def compatible(self, left: str, right: str) -> bool:
        found = self.fits.setdefault(left, {}).get(right)
        if found is None:
            if self.n_fits >= 4 * REMEMBERED:
                self.fits.clear()
                self.n_fits = 0
            found = self.fits.setdefault(left, {})[right] = self.remerge(left, right)
            self.n_fits += 1
        return found

    def tokens(self, text: str) -> list[str]:
        """The tokens of a text, without runs of several spaces, by backtracking."""
        size = len(text)
        if size == 1:
            return [text]
        reach = [*text]  # a sign that is in no token stands for itself
        for last, (more, token) in self.longest.iter(text):
            reach[last - more] = token
        shorter, fits, compatible = self.shorter.get, self.fits.get, self.compatible
        dead = bytearray(size // 8 + 1)
        row: list[str] = []
        at, token, before = 0, reach[0], None
        while True:
            end = at + len(token)
            if not dead[end >> 3] >> (end & 7) & 1:
                if before is None:
                    fit = True
                elif (fit := fits(before, NONE).get(token)) is None:
                    fit = compatible(before, token)
                if fit:
                    row.append(token)
                    if end == size:
                        return row
                    at, before, token = end, token, reach[end]
                    continue
            while (less := shorter(token)) is None:
                dead[at >> 3] |= 1 << (at & 7)
                token = row.pop()
                before = row[-1] if row else None
                at -= len(token)
            token = less

    def _ids(self, tokens: list[str]) -> Iterator[int]:
        for t in tokens:
            if (found := self.ids.get(t)) is not None:
                yield found
            else:
                yield from (self.byte_ids[b] for b in t.encode())

    def _blank(self, n: int) -> tuple[int, ...]:
        if n not in self.blanks:
            found = tuple(self._ids(self.merged(SPACE * n)))
            if n > 1024:
                return found
            self.blanks[n] = found
        return self.blanks[n]

    def _run(self, run: str) -> tuple[int, ...]:
        """The ids of spaces and what follows up to the next space."""
        rest = run.lstrip(SPACE)
        spaces = len(run) - len(rest)
        if not rest:
            return self._blank(spaces)
        tokens = self.tokens(run[max(0, spaces - 1) :])
        if spaces < 2:
            return tuple(self._ids(tokens))
        alone = tokens[0] == SPACE  # it joins the other spaces
        return (*self._blank(spaces - (not alone)), *self._ids(tokens[alone:]))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        known = self.runs.get
        for run in RUNS.findall(SPACE + text.replace(" ", SPACE)):
            found = known(run)
            if found is None:
                found = self._remembered(run)
                known = self.runs.get
            ids += found
        return ids

    def _remembered(self, run: str) -> tuple[int, ...]:
        """Runs are remembered in two halves; when one is full, the older one is forgotten."""
        found = self.older.get(run) or self._run(run)
        if len(run) <= LONGEST_REMEMBERED:
            if len(self.runs) >= REMEMBERED:
                self.older, self.runs = self.runs, {}
            self.runs[run] = found
        return found

    def decode(self, ids: list[int]) -> str:
        """Control ids say nothing; bytes that are no text give a replacement sign each; the prefix goes."""
        if self.special.isdisjoint(ids):
            text = "".join(map(self.said.__getitem__, ids))
            return text[1:] if ids and self.texts[ids[0]].startswith(SPACE) else text
        parts, pending = [], bytearray()
        for i in ids:
            if (b := self.bytes.get(i)) is not None:
                pending.append(b)
                continue
            if pending:
                parts.append(_text_of(pending))
                pending = bytearray()
            if i not in self.silent:
                parts.append(UNKNOWN if i in self.unknown else self.said[i])
        text = "".join([*parts, _text_of(pending)])
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first is not None and self.texts[first].startswith(SPACE) else text


def _shorter(tokens: list[str]) -> dict[str, str]:
    """For each token of several signs its longest proper prefix that is a token, or its first sign."""
    known = set(tokens)
    return {t: next((t[:n] for n in range(len(t) - 1, 1, -1) if t[:n] in known), t[0]) for t in tokens if len(t) > 1}


NONE: dict[str, bool] = {}
RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: What the library says for the unknown id.
UNKNOWN = " ⁇ "


def _text_of(data: bytearray) -> str:
    """Text of bytes, each byte that belongs to no sign as one replacement sign."""
    said, at = [], 0
    while at < len(data):
        try:
            said.append(data[at:].decode())
            break
        except UnicodeDecodeError as e:
            said += [data[at : at + e.start].decode(), REPLACEMENT]
            at += e.start + 1
    return "".join(said)


REPLACEMENT = "\N{REPLACEMENT CHARACTER}"


def opened(path: str) -> Pieces:
    """The model of a path, one for each worker process, with all that it remembers.

    This code travels to the workers by value, so that each task has its own copy of
    this module; what outlives a task is kept in a module that is made in the worker.
    """
    state = sys.modules.setdefault(STATE, types.ModuleType(STATE))
    models = vars(state).setdefault("models", {})
    if path not in models:
        models[path] = Pieces(path)
    return models[path]


STATE = "strandlake_worker_state"


def _parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows, a few at a time: ids take many times the room of their text."""
    for frame in frames:
        for start in range(0, len(frame), ROWS_TOGETHER):
            yield frame.iloc[start : start + ROWS_TOGETHER]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of its whole text, for each row of docs."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = opened(path)
        for frame in _parts(frames):
            yield pd.DataFrame({"doc_id": frame["doc_id"], "ids": [pieces.encode(t) for t in frame["text"]]})

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInPandas(batches, "doc_id long, ids array<int>")


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, the ids of its whole text, and the text that they decode to."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = opened(path)
        for frame in _parts(frames):
            ids = [pieces.encode(t) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "ids": ids, "decoded": [pieces.decode(i) for i in ids]})

    schema = "doc_id long, ids array<int>, decoded string"
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInPandas(batches, schema)
