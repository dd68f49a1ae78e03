"""Token counts by a finite-state transducer that is compiled from a SentencePiece model of the merge type.

The tokens of a text's beginning are known for every place: the last token at a place is
the one that ends there, begins at an earlier place, and is compatible with the last
token of that place. What follows depends only on the places from which a token can
still reach on. So a state is a row of items (u, t, n): u is what has been read since a
place, the beginning of some token; t is the last token at that place (None where any
token may follow); n is the number of tokens up to it, against the first item. Reading a
sign extends the items, adds the new place, and emits the change of the first item's
count: a deterministic transducer whose transitions carry numbers of tokens. Its states
are made when they are first reached, and up to STATES of them are kept.

White space is a state of its own: no token goes on from other signs into it, so that all
texts meet again there. Runs of several spaces are counted by their length, whose tokens
repeat with a period; the period is checked when the model is compiled.

A text of more than LONG code points is cut into chunks, which are dealt over tasks. The
map of a chunk is found without the chunks before it: for each item that its left context
allows at the cut, the items at its end, with counts. Runs from different items are one as
soon as they reach one state. Maps compose associatively, and a text's count is the
composition of its chunks' maps, applied to the start.

Defined results: a null text counts as empty and has no tokens and no bytes; null ids pass
through; repeated rows give equal rows; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import pickle
import re
import sys
import types
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.pieces import SPACE, Pieces
from strandlake.llm.shared import staged

#: Texts of more code points are cut into chunks of about so many.
LONG = 1 << 16
#: A text has at most so many chunks; longer texts have longer ones.
CHUNKS = 1 << 10
#: States that a worker keeps.
STATES = 60_000
#: Tokens above which a text is marked.
LIMIT = 4096

#: Beginnings of more tokens are not asked which of them may follow.
MANY = 64
#: Words whose end states a worker keeps, and their longest.
WORDS = 400_000
LONGEST_WORD = 32
#: Answers to that question that a worker keeps.
PAIRS = 200_000
#: Words, and the signs that texts meet at.
PARTS = re.compile(f"[^{SPACE}\n]+|.", re.DOTALL)
NOTHING, UNKNOWN = "", object()

#: What a chunk's map leads from and to: (u, t) as `named`, or (None, k) after k spaces, counted round the period.
Place = tuple
Map = dict[Place, dict[Place, int]]
START: Place = ("", None)


class State(dict):
    """A state with its transitions by sign: the next state, and the tokens emitted. They are made when first asked for."""

    __slots__ = ("items", "blank", "arc")

    def __missing__(self, sign: str) -> tuple[State, int]:
        found = self[sign] = self.arc(self, sign)
        return found


class Transducer:
    def __init__(self, pieces: Pieces, most: int = STATES):
        self.pieces, self.most = pieces, most
        self.whole = set(pieces.longest.keys())
        self.onward: dict[str, list[str]] = {}
        for token in sorted(self.whole):  # in one order everywhere: see `named`
            for n in range(1, len(token)):
                self.onward.setdefault(token[:n], []).append(token)
        self.alike: dict[tuple[str, str], str | None] = {}
        self.kinds: dict[tuple[str, bytes], str | None] = {}
        self.reach = max(map(len, self.whole))
        self.period, self.gain = self._period()
        self.blanks = [len(pieces.merged(SPACE * n)) for n in range(self.period + 1)]
        self.states: dict[tuple, State] = {}
        self.words: dict[str, tuple[State, int]] = {}
        self.lines: dict[str, tuple[State, int]] = {}
        self.start = self.state((("", None, 0),), 0)

    def _period(self) -> tuple[int, int]:
        """After how many spaces more how many tokens more there are."""
        longest = max(len(t) for t in self.pieces.ids if set(t) == {SPACE})
        counts = [len(self.pieces.merged(SPACE * n)) for n in range(10 * longest)]
        for period in range(1, 2 * longest + 1):
            gain = counts[period]
            if all(b - a == gain for a, b in zip(counts, counts[period:])):
                return period, gain
        raise ValueError("only models whose runs of spaces have a period")

    def like(self, u: str, t: str | None) -> str | None:
        """A last token that the tokens that u begins take as they take t: None if all may follow, NOTHING if none may."""
        tokens = self.onward[u]
        if t is None or len(tokens) > MANY:
            return t
        found = self.alike.get((u, t), UNKNOWN)
        if found is UNKNOWN:
            if len(self.alike) >= PAIRS:
                self.alike.clear()
            fits = bytes(self.pieces.remerge(t, token) for token in tokens)
            found = None if all(fits) else self.kinds.setdefault((u, fits), t) if any(fits) else NOTHING
            self.alike[u, t] = found
        return found

    def named(self, u: str | None, t: str | int | None) -> Place:
        """A place as all workers name it: by what may follow, where any of several last tokens may stand for the others.

        Which of them does depends on the texts that a worker has met, and maps of a text's chunks are made by several workers.
        """
        if not u or t is None or len(self.onward[u]) > MANY:
            return u, t
        return u, bytes(self.pieces.remerge(t, token) for token in self.onward[u])

    def state(self, items: tuple, blank: int) -> State:
        key = items, blank
        found = self.states.get(key)
        if found is None:
            if len(self.states) >= self.most:
                for old in self.states.values():
                    old.clear()
                self.states.clear()
                self.words.clear()
                self.lines.clear()
            found = State()
            found.items, found.blank, found.arc = items, blank, self.arc
            self.states[key] = found
        return found

    def placed(self, items: list[tuple], blank: int) -> tuple[State, int]:
        """The state of items, and the count of its first one."""
        first = items[0][2] if items else 0
        return self.state(tuple((u, t, n - first) for u, t, n in items), blank), first

    def spaces(self, before: int, k: int) -> tuple[list[tuple], int]:
        """The items after a run of k spaces with so many tokens before it: the last one may begin a token, or be one."""
        k = (k - 1) % self.period + 1
        return [(SPACE, None, before + self.blanks[k - 1]), ("", SPACE, before + self.blanks[k])], k

    def arc(self, state: State, sign: str) -> tuple[State, int]:
        if sign == SPACE:
            if not state.items or state.items[-1][0]:
                return self.placed([], 0)
            before = state.items[-1][2]
            if not state.blank:
                return self.placed(*self.spaces(before, 1))
            # A full period has been counted when the run begins anew.
            before += (self.gain if state.blank == self.period else 0) - self.blanks[state.blank]
            return self.placed(*self.spaces(before, state.blank + 1))
        items, last = [], None
        for u, t, n in state.items:
            both = u + sign
            if both in self.whole:
                if t is None or self.pieces.compatible(t, both):
                    last = ("", both, n + 1)
            elif not u:  # a sign that is in no token: its bytes
                last = ("", None, n + len(sign.encode()))
            if both in self.onward and (t := self.like(both, t)) != NOTHING:
                items.append((both, t, n))
        return self.placed([*items, last] if last else items, 0)

    def run(self, state: State, text: str) -> tuple[State, int]:
        """The state after a text, and the tokens emitted. What a word does where texts meet is remembered."""
        total = 0
        known = self.words.get
        for part in PARTS.findall(text):
            if len(part) == 1:
                state, n = state[part]
            else:
                # Only these two states are the same ones again and again.
                found = known(part) if state.blank == 1 else self.lines.get(part) if state is self.start else None
                state, n = found or self.walked(state, part)
            total += n
        return state, total

    def walk(self, state: State, text: str) -> tuple[State, int]:
        total = 0
        for sign in text:
            state, n = state[sign]
            total += n
        return state, total

    def walked(self, state: State, word: str) -> tuple[State, int]:
        found = self.walk(state, word)
        if len(word) <= LONGEST_WORD and (state.blank == 1 or state is self.start):
            if len(self.words) + len(self.lines) >= WORDS:
                self.words.clear()
                self.lines.clear()
            (self.words if state.blank == 1 else self.lines)[word] = found
        return found

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        state, total = self.run(self.start, SPACE + text.replace(" ", SPACE))
        return total + state.items[-1][2]

    def entries(self, left: str) -> list[Place]:
        """All places that a state may have after a text that ends with `left`."""
        spaces = len(left) - len(left.rstrip(SPACE))
        if spaces:
            return [(None, k + 1) for k in range(self.period)] if spaces == len(left) else [(None, (spaces - 1) % self.period + 1)]
        found: list[Place] = []
        for size in range(min(self.reach, len(left))):
            cut = len(left) - size
            u, before = left[cut:], left[max(0, cut - self.reach) : cut]
            if u and u not in self.onward:
                continue
            if u.startswith(SPACE) or before[-1:] not in self.whole:
                found.append((u, None))
            else:
                last = {before[k:] for k in range(len(before)) if before[k:] in self.whole}
                found += [(u, t) for t in sorted({self.like(u, t) for t in last} if u else last, key=str) if t != NOTHING]
        return found

    def entered(self, place: Place) -> tuple[State, int]:
        u, t = place
        if u is None:
            return self.placed(*self.spaces(0, t))
        return self.placed([(u, t, 0)], 0)

    def left(self, state: State, total: int) -> dict[Place, int]:
        """The places of a state, with their counts."""
        if state.blank:
            return {(None, state.blank): total + state.items[-1][2] - self.blanks[state.blank]}
        return {self.named(u, t): total + n for u, t, n in state.items}

    def chunk_map(self, left: str, text: str) -> Map:
        """The map of a chunk that follows `left`, of which 2 * reach signs matter. Signs of both are as in tokens."""
        runs: dict[int, list] = {}
        for place in self.entries(left):
            state, total = self.entered(place)
            runs.setdefault(id(state), [state, []])[1].append((self.named(*place), total))
        groups, at = [*runs.values()], 0
        while len(groups) > 1 and at < len(text):
            met: dict[int, list] = {}
            for state, members in groups:
                after, n = state[text[at]]
                if after.items:
                    met.setdefault(id(after), [after, []])[1].extend((place, total + n) for place, total in members)
            groups, at = [*met.values()], at + 1
        found: Map = {}
        for state, members in groups:
            end, more = self.run(state, text[at:])
            for place, total in members:
                found[place] = self.left(end, total + more)
        return found

    def cut(self, text: str, long: int) -> list[str]:
        """A text with its prefix as chunks, each after the 2 * reach signs before it."""
        text = SPACE + text.replace(" ", SPACE)
        size = max(long, -(-len(text) // CHUNKS))
        return [text[max(0, at - 2 * self.reach) : at + size] for at in range(0, len(text), size)]


def composed(first: Map, then: Map) -> Map:
    """The map of two chunks, of which one follows the other."""
    return {place: {end: n + m for between, n in row.items() for end, m in then.get(between, {}).items()} for place, row in first.items()}


def opened(path: str) -> Transducer:
    """The transducer of a model file, one for each worker process."""
    state = sys.modules.setdefault(STATE, types.ModuleType(STATE))
    machines = vars(state).setdefault("transducers", {})
    if path not in machines:
        machines[path] = Transducer(Pieces(path))
    return machines[path]


STATE = "strandlake_worker_state"


def counts(docs: DataFrame, path: str, long: int = LONG, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each row of docs."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = opened(path)
        for frame in frames:
            short = [t is None or len(t) <= long for t in frame["text"]]
            n = [machine.count(t) if s else None for s, t in zip(short, frame["text"])]
            cut = [None if s else machine.cut(t, long) for s, t in zip(short, frame["text"])]
            yield pd.DataFrame({"r": frame["r"], "doc_id": frame["doc_id"], "n_bytes": frame["n_bytes"], "n_tokens": pd.array(n, "Int64"), "chunks": cut})

    def maps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = opened(path)
        for frame in frames:
            made = []
            for i, chunk in zip(frame["i"], frame["chunk"]):
                overlap = 2 * machine.reach if i else 0
                made.append(pickle.dumps(machine.chunk_map(chunk[:overlap], chunk[overlap:]) if i else {START: machine.left(*machine.run(machine.start, chunk))}))
            yield pd.DataFrame({"r": frame["r"], "i": frame["i"], "map": made})

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        machine = opened(path)
        row = [pickle.loads(m) for m in frame.sort_values("i")["map"]]
        while len(row) > 1:  # neighbours first, then neighbours of those
            row = [composed(*row[k : k + 2]) if k + 1 < len(row) else row[k] for k in range(0, len(row), 2)]
        end = row[0][START]
        n = next((n + machine.blanks[t] if u is None else n for (u, t), n in end.items() if not u))
        return pd.DataFrame({"r": [frame["r"].iloc[0]], "counted": [n]})

    rows = docs.select(
        F.monotonically_increasing_id().alias("r"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("n_bytes", F.octet_length("text").cast("long"))
    found = staged(rows.mapInPandas(scan, "r long, doc_id long, n_bytes long, n_tokens long, chunks array<string>"), "token-counts")
    parts = found.filter("chunks is not null").select("r", F.posexplode("chunks").alias("i", "chunk")).repartition("r", "i")
    of_long = parts.mapInPandas(maps, "r long, i int, map binary").groupBy("r").applyInPandas(whole, "r long, counted long")
    n_tokens = F.coalesce("n_tokens", "counted")
    return found.drop("chunks").join(of_long, "r", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
