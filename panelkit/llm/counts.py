"""Operator 10: token counts by a finite-state tokenizer.

Byte-level BPE is compiled, transition by transition as texts need them, into a
deterministic transducer over UTF-8 bytes. After every prefix of a word a state
holds what can still matter: each open match (a node of the token trie), the
token before it and how many tokens ago it began. Reading a byte settles the
last token of the longer prefix, so each transition carries the change of the
token count. Tokens before a match that allow the same completions count as one,
and a match that no completion fits is dropped, which keeps the states few. A
word's first byte leads out of the start state whatever came
before, so a chunk of text that starts a word has a constant state map. Chunks
inside an over-long word have a real map; maps compose by a parallel prefix
scan over the chunks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .bpe import vocabulary
from .bytebpe import ByteBPE, load, word_starts
from .shared import add_columns, documents, kept_in_worker

#: Bytes a chunk has about, and at most (then it is cut inside a word).
CHUNK, LONGEST = 256, 1024

#: States held per Python worker; beyond, the table is compiled afresh.
STATES = 150_000

_START = 0

#: What stands for no change of the count in a packed transition.
_ZERO = 250

#: Trie nodes with at most so many tokens below tell tokens before them apart
#: by what they allow.
FEW = 16


class Transducer:
    """States are tuples of open matches (trie node, token before, tokens since).

    ``table`` is dense, [state, column of the byte]: the next state and the
    change of the count in one number, -1 where not compiled yet."""

    def __init__(self, tables: ByteBPE):
        self.tables = tables
        self.ends = tables.ends.tolist()
        self._look_below()
        self._reset()

    def _look_below(self) -> None:
        """Tokens at or below each trie node (None: more than FEW), and whether
        the node has children."""
        n = len(self.ends)
        self.below: list[tuple | None] = [() if e < 0 else (e,) for e in self.ends]
        self.goes_on = np.zeros(n, bool)
        for key, child in reversed(self.tables.children.items()):  # children come after parents
            up, own = key >> 8, self.below[child]
            self.goes_on[up] = True
            both = self.below[up]
            self.below[up] = None if own is None or both is None or len(both) + len(own) > FEW \
                else both + own
        self.goes_on = self.goes_on.tolist()

    def _reset(self) -> None:
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: _START}
        self.column = np.full(256, -1, np.int64)
        self.bytes: list[int] = []
        self.table = np.full((1024, 32), -1, np.int32)
        self.alike: dict[tuple, int] = {}
        self.stands: dict[tuple, int] = {}

    def _columns(self, raw: np.ndarray) -> np.ndarray:
        col = self.column[raw]
        if (col < 0).any():
            for b in np.unique(raw[col < 0]).tolist():
                self.column[b] = len(self.bytes)
                self.bytes.append(b)
            if len(self.bytes) > self.table.shape[1]:
                self._grow(self.table.shape[0], min(256, len(self.bytes) + 32))
            col = self.column[raw]
        return col

    def _grow(self, rows: int, cols: int) -> None:
        r, c = self.table.shape
        new = np.full((rows, cols), -1, np.int32)
        new[:r, :c] = self.table
        self.table = new

    def _before(self, node: int, before: int) -> int:
        """The token that stands for ``before`` in a match at ``node``: the first
        met that is compatible with the same tokens below the node. -2: none."""
        below = self.below[node]
        if below is None or before < 0:
            return before
        got = self.stands.get((node, before))
        if got is None:
            fits = tuple(t for t in below if self.tables.compatible_one(before, t))
            got = self.alike.setdefault((node, fits), before) if fits else -2
            self.stands[node, before] = got
        return got

    def _compile(self, state: int, col: int) -> None:
        """One transition: extend every open match by the byte; the one that
        completes a token compatible with the token before it settles."""
        t, byte = self.tables, self.bytes[col]
        children, ends = t.children, self.ends
        open_, token, since = [], -1, 0
        for node, before, ago in self.states[state]:
            node = children.get(node * 256 + byte, -1)
            if node < 0 or (before := self._before(node, before)) == -2:
                continue
            end = ends[node]
            if end >= 0 and token < 0 and (before < 0 or t.compatible_one(before, end)):
                token, since = end, ago
            if self.goes_on[node]:
                open_.append((node, before, ago))
        emit = 1 - since
        key = ((0, token, 0), *[(node, before, ago + emit) for node, before, ago in open_])
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            if to >= len(self.table):
                self._grow(2 * len(self.table), self.table.shape[1])
        self.table[state, col] = to * 256 + (emit + _ZERO)

    def run(self, cols: np.ndarray, reset: np.ndarray, at: np.ndarray, length: np.ndarray,
            entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read many chunks side by side, each from its entry state. Returns the
        states they leave and the tokens they emit."""
        order = np.argsort(-length, kind="stable")
        at, length = at[order], length[order]
        state, count = entry[order].astype(np.int64), np.zeros(len(at), np.int64)
        live = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left")
        for j, n in enumerate(live.tolist()):
            here = at[:n] + j
            s = np.where(reset[here], _START, state[:n])
            c = cols[here]
            step = self.table[s, c]
            if step.min() < 0:
                miss = step < 0
                for k in set((s[miss] * 256 + c[miss]).tolist()):
                    self._compile(k >> 8, k & 255)
                step[miss] = self.table[s[miss], c[miss]]
            count[:n] += (step & 255) - _ZERO
            state[:n] = step >> 8
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if len(self.states) > STATES:
            self._reset()
        extra = np.zeros(len(texts), np.int64)
        owner, parts = np.arange(len(texts)), texts
        if any(s in t for s in self.tables.special for t in texts):
            cut = [self.tables.pieces_of(t) for t in texts]
            extra = np.array([sum(isinstance(p, int) for p in c) for c in cut], np.int64)
            owner = np.array([i for i, c in enumerate(cut) for p in c if not isinstance(p, int)],
                             np.int64)
            parts = [p for c in cut for p in c if not isinstance(p, int)]
        raw = np.frombuffer("".join(parts).encode(), np.uint8)
        if not len(raw):
            return extra
        size = np.fromiter((len(p.encode()) for p in parts), np.int64, len(parts))
        begin = np.cumsum(size) - size
        lead = np.flatnonzero((raw & 0xC0) != 0x80)  # first byte of each character
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        fresh = np.zeros(len(raw), bool)
        fresh[begin[size > 0]] = True
        reset = np.zeros(len(raw), bool)
        reset[lead[word_starts(points, fresh[lead])]] = True
        at = self._chunks(reset, begin[size > 0], len(raw))
        length = np.diff(np.append(at, len(raw)))
        counts = self._scan(self._columns(raw), reset, at, length)
        text = np.searchsorted(begin[size > 0], at, "right") - 1
        return extra + np.bincount(owner[np.flatnonzero(size > 0)[text]], counts,
                                   len(texts)).astype(np.int64)

    @staticmethod
    def _chunks(reset: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
        """Chunk starts: every text, then about every CHUNK bytes the next word
        start, and inside longer words every LONGEST bytes."""
        words = np.flatnonzero(reset)
        near = np.searchsorted(words, np.arange(0, n, CHUNK))
        at = np.union1d(begin, words[near[near < len(words)]])
        gap = np.diff(np.append(at, n))
        long = np.flatnonzero(gap > LONGEST)
        more = [np.arange(at[i] + LONGEST, at[i] + gap[i], LONGEST) for i in long]
        return np.union1d(at, np.concatenate(more)) if more else at

    def _scan(self, cols, reset, at, length) -> np.ndarray:
        """Tokens of every chunk. Chunks that start a word are read once. For
        the others state maps are built on speculated entry states (first the
        start state, then what the chunk before left) until the composed maps
        reach every chunk."""
        exit_, counts = self.run(cols, reset, at, length, np.full(len(at), _START))
        open_ = np.flatnonzero(~reset[at])
        if not len(open_):
            return counts
        maps = [{_START: (int(exit_[i]), int(counts[i]))} for i in open_]
        guess = exit_[open_ - 1]
        while True:
            need = [k for k, e in enumerate(guess.tolist()) if e not in maps[k]]
            if need:
                own = open_[need]
                out, n = self.run(cols, reset, at[own], length[own], guess[need])
                for k, e, x, c in zip(need, guess[need].tolist(), out.tolist(), n.tolist()):
                    maps[k][e] = (x, c)
            entry = entry_states(maps, open_, exit_)
            if (entry >= 0).all():
                for k, i in enumerate(open_):
                    counts[i] = maps[k][int(entry[k])][1]
                return counts
            # What the chunk before leaves, from its entry where that is known.
            left = np.array([maps[k][int(entry[k]) if entry[k] >= 0 else int(guess[k])][0]
                             for k in range(len(open_))])
            follows = np.append(False, np.diff(open_) == 1)
            guess = np.where(follows, np.roll(left, 1), exit_[open_ - 1])


def entry_states(maps: list[dict], chunk: np.ndarray, exit_: np.ndarray) -> np.ndarray:
    """The entry state of every open chunk by a prefix scan over partial maps:
    each round composes every map with the one 2^r chunks before. -1: not
    reached by the entries known so far.

    ``chunk`` are the chunks' numbers; one whose predecessor is not open enters
    in the constant state ``exit_`` of that predecessor."""
    m = len(maps)
    follows = np.append(False, np.diff(chunk) == 1)
    # value[k]: map from the entry of the first chunk covered to the exit of k.
    value = [{e: x for e, (x, _) in f.items()} for f in maps]
    for k in np.flatnonzero(~follows):
        x = value[k].get(int(exit_[chunk[k] - 1]), -1)
        value[k] = x  # constant from here on
    step = 1
    head = np.flatnonzero(~follows)
    first = head[np.searchsorted(head, np.arange(m), "right") - 1]
    while step < m:
        new = list(value)
        for k in range(m):
            j = k - step
            if j < first[k] or not isinstance(value[k], dict):
                continue
            f, g = value[j], value[k]
            new[k] = (g.get(f, -1) if not isinstance(f, dict)
                      else {e: g[x] for e, x in f.items() if x in g})
        value, step = new, 2 * step
    out = np.full(m, -1, np.int64)
    for k in range(m):
        out[k] = exit_[chunk[k] - 1] if not follows[k] else \
            value[k - 1] if not isinstance(value[k - 1], dict) else -1
        if out[k] >= 0 and int(out[k]) not in maps[k]:
            out[k] = -1
    return out


def transducer(path: str) -> Transducer:
    return kept_in_worker(("Transducer", path), lambda: Transducer(load(path)))


def token_counts(df: DataFrame, path: str, limit: int, text: str = "text",
                 keep: list[str] | None = None) -> DataFrame:
    """``df`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of
    each whole text. Null and empty texts count 0. Special strings inside a
    text count as one token, as the library does by default. Repeated rows
    stay; input columns with these names give way."""
    def make():
        machine = transducer(path)

        def run(texts):
            n = machine.count(texts)
            return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": n,
                    "over_limit": n > limit}
        return run
    return add_columns(df, text, "n_bytes long, n_tokens long, over_limit boolean", make, keep)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents``; the limit is 1024."""
    return token_counts(documents(spark, sf_dir), vocabulary(), 1024, keep=["doc_id"])
