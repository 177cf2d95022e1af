"""Byte-level BPE tables: vocabulary, merge ranks, pair compatibility, the
pre-tokeniser, and exact merging.

The vocabulary file is that of the public ``tokenizers`` library; its path is a
parameter. A token sequence over one word is the sequence BPE gives exactly if
every adjacent pair is *compatible*: encoding the two tokens' bytes together
gives those two tokens again. That is checked on the tokens' merge history,
without merging anything."""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np

NEVER = np.int64(1) << 60

# Character classes of the pre-tokeniser.
SPACE, WHITE, LETTER, NUMBER, OTHER, UNKNOWN = range(6)

# Code points of Unicode's White_Space property but U+0020.
WHITE_SPACE = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
               0x202F, 0x205F, 0x3000]

# What an apostrophe that starts a token takes with it.
SUFFIXES = ("s", "t", "m", "d", "re", "ve", "ll")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return [letters[b] for b in range(256)]


class IntTable:
    """Fixed map from non-negative int64 keys to int64 values, looked up a whole
    array at a time (open addressing, at most half full)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.full(1 << bits, -1, np.int64)
        self._values = np.zeros(1 << bits, np.int64)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self._keys[at[todo]] < 0
            self._keys[at[todo[free]]] = keys[todo[free]]  # of several, the last stays
            won = self._keys[at[todo]] == keys[todo]
            self._values[at[todo[won]]] = values[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def get(self, keys: np.ndarray, default: int) -> np.ndarray:
        at = self._slot(keys)
        held = self._keys[at]
        out = np.where(held == keys, self._values[at], default)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self._mask
            held = self._keys[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self._values[at[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return out


class ByteBPE:
    """Tables of one vocabulary file. Built once per Python worker (``load``)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of_letter = {c: b for b, c in enumerate(byte_letters())}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.pieces[i] = bytes(of_letter[c] for c in text)
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        keys = np.empty(len(spec["model"]["merges"]), np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if self.rank[z] >= 0:
                raise ValueError(f"two merges make the token {a + b!r}")
            self.left[z], self.right[z], self.rank[z] = x, y, r
            self.merge[x, y] = (r, z)
            keys[r] = x * size + y
        self.size = size
        self._ranks = IntTable(keys, np.arange(len(keys)))
        self._product = np.array([z for _, z in self.merge.values()], np.int64)  # by rank
        self.byte_id = [vocab[c] for c in byte_letters()]
        # Spines: the token, its right (or left) half, that half's, ... and the
        # rank at which each is merged away.
        self._right_spine = self._spine(self.right)
        self._left_spine = self._spine(self.left)
        made = np.flatnonzero(self.rank >= 0)
        usable = np.array([bool(p) for p in self.pieces])
        usable[made] = self.first_conflict(self.left[made], self.right[made]) == self.rank[made]
        self.usable = usable
        self.of_bytes = {p: i for i, p in enumerate(self.pieces) if usable[i]}
        table = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.piece_bytes = table
        self.piece_len = np.array([len(p) for p in self.pieces], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self._compatible: dict[tuple[int, int], bool] = {}
        self._grow_trie()

    def _grow_trie(self) -> None:
        """Trie of the usable tokens' bytes; ``ends`` has the token that a node
        completes, or -1."""
        nodes: dict[int, int] = {}
        ends = [-1]
        for piece, i in self.of_bytes.items():
            at = 0
            for b in piece:
                nxt = nodes.setdefault(at * 256 + b, len(ends))
                if nxt == len(ends):
                    ends.append(-1)
                at = nxt
            ends[at] = i
        self.children, self.ends = nodes, np.array(ends, np.int64)
        self._child = IntTable(np.fromiter(nodes, np.int64, len(nodes)),
                               np.fromiter(nodes.values(), np.int64, len(nodes)))

    def _spine(self, half: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        levels, tok, until = [], np.arange(self.size), np.full(self.size, NEVER)
        while (tok >= 0).any():
            levels.append((tok, until))
            alive = tok >= 0
            until = np.where(alive, self.rank[tok], -1)
            tok = np.where(alive, half[tok], -1)
        return levels

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._ranks.get(a * self.size + b, NEVER)

    def first_conflict(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the first merge across the seam of each pair (NEVER: none).

        A piece of ``a`` ending at the seam and one of ``b`` starting there
        merge at rank r if both still stand then; of equal ranks the merge
        further left comes first."""
        first = np.full(len(a), NEVER)
        for ra, ua in self._right_spine:
            x, ux = ra[a], ua[a]
            if not (x >= 0).any():
                break
            for lb, ub in self._left_spine:
                y, uy = lb[b], ub[b]
                live = np.flatnonzero((x >= 0) & (y >= 0))
                if not len(live):
                    break
                r = self.pair_rank(x[live], y[live])
                hit = (r < ux[live]) & (r <= uy[live])
                first[live] = np.where(hit, np.minimum(first[live], r), first[live])
        return first

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.first_conflict(a, b) == NEVER

    def compatible_one(self, a: int, b: int) -> bool:
        """As ``compatible`` for a single pair, remembered."""
        got = self._compatible.get((a, b))
        if got is None:
            if len(self._compatible) > 1_000_000:
                self._compatible.clear()
            got, x, ux = True, a, NEVER
            while got and x >= 0:
                y, uy = b, NEVER
                while y >= 0:
                    m = self.merge.get((x, y))
                    if m and m[0] < ux and m[0] <= uy:
                        got = False
                        break
                    uy, y = self.rank[y], self.left[y]
                ux, x = self.rank[x], self.right[x]
            self._compatible[a, b] = got
        return got

    def greedy(self, raw: np.ndarray, at: np.ndarray, length: np.ndarray):
        """Proposals for many words at once: the longest token at each place.

        Word i is raw[at[i] : at[i] + length[i]]. Returns all tokens, ordered
        by word, and how many each word has."""
        n = len(at)
        end, cursor, best_end = at + length, at.copy(), at.copy()
        node, best = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        live = np.flatnonzero(length > 0)
        words, tokens, guard = [], [], np.append(raw, 0).astype(np.int64)
        while len(live):
            nxt = self._child.get(node[live] * 256 + guard[cursor[live]], -1)
            go = (cursor[live] < end[live]) & (nxt >= 0)
            on, off, nxt = live[go], live[~go], nxt[go]
            node[on] = nxt
            cursor[on] += 1
            done = self.ends[nxt]
            hit = on[done >= 0]
            best[hit], best_end[hit] = done[done >= 0], cursor[hit]
            words.append(off)
            tokens.append(best[off])
            cursor[off], node[off] = best_end[off], 0
            live = np.concatenate([on, off[best_end[off] < end[off]]])
        word = np.concatenate(words) if words else np.empty(0, np.int64)
        token = np.concatenate(tokens) if tokens else np.empty(0, np.int64)
        order = np.argsort(word, kind="stable")
        return token[order], np.bincount(word, minlength=n)

    def greedy_one(self, word: bytes) -> list[int]:
        """As ``greedy`` for a single long word."""
        out, at, children, ends = [], 0, self.children, self.ends
        while at < len(word):
            node, best, stop, k = 0, -1, at, at
            while k < len(word) and (node := children.get(node * 256 + word[k], -1)) >= 0:
                k += 1
                if ends[node] >= 0:
                    best, stop = int(ends[node]), k
            out.append(best)
            at = stop
        return out

    def exact_many(self, raw: np.ndarray, at: np.ndarray, length: np.ndarray):
        """The merges of many words at once, each by rank and from the left: in
        every step each word makes its first merge. Returns as ``greedy``."""
        n, width = len(at), int(length.max())
        col = np.arange(width)
        inside = col < length[:, None]
        ids = np.full((n, width + 1), -1, np.int64)
        ids[:, :width] = np.where(inside, np.array(self.byte_id)[
            raw[np.minimum(at[:, None] + col, len(raw) - 1)]], -1)
        rank = np.full((n, width), NEVER)
        both = ids[:, 1:] >= 0
        rank[both] = self.pair_rank(ids[:, :-1][both], ids[:, 1:][both])
        live = np.arange(n)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            if not rank.shape[1]:
                out.append((live, ids))
                break
            first = rank.argmin(1)
            least = rank[np.arange(len(live)), first]
            over = least == NEVER
            if over.any():
                out.append((live[over], ids[over]))
                live, ids, rank, first, least = (x[~over] for x in (live, ids, rank, first, least))
                if not len(live):
                    break
            row = np.arange(len(live))
            # What stands right of the merged pair moves one place left; every
            # word is one token shorter now, so the last column goes.
            col = np.arange(ids.shape[1] - 1)
            source = col + (col > first[:, None])
            ids = np.take_along_axis(ids, source, 1)
            ids[row, first] = self._product[least]
            rank = np.take_along_axis(rank, source[:, :-1], 1)
            for place in (first - 1, first):
                ok = (place >= 0) & (place < rank.shape[1])
                ok[ok] = ids[row[ok], place[ok] + 1] >= 0
                new = np.full(len(row), NEVER)
                new[ok] = self.pair_rank(ids[row[ok], place[ok]], ids[row[ok], place[ok] + 1])
                put = (place >= 0) & (place < rank.shape[1])
                rank[row[put], place[put]] = new[put]
        word = np.concatenate([np.repeat(w, (i >= 0).sum(1)) for w, i in out])
        token = np.concatenate([i[i >= 0] for _, i in out])
        order = np.argsort(word, kind="stable")
        return token[order], np.bincount(word, minlength=n)

    def exact(self, word: bytes) -> list[int]:
        """One word's merges one by one, by rank and from the left (heap, linked list)."""
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merge, heap = self.merge, []
        for i in range(n - 1):
            if m := merge.get((ids[i], ids[i + 1])):
                heap.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = z, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merge.get((z, ids[k])):
                    heapq.heappush(heap, (m[0], i, z, ids[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merge.get((ids[h], z))):
                heapq.heappush(heap, (m[0], h, ids[h], z, m[1]))
        return [t for t in ids if t >= 0]

    def pieces_of(self, text: str) -> list[str | int]:
        """The text cut at special strings, which stand as their ids."""
        out: list[str | int] = [text]
        for s, i in sorted(self.special.items(), key=lambda x: -len(x[0])):
            if s in text:
                cut: list[str | int] = []
                for p in out:
                    if isinstance(p, int):
                        cut.append(p)
                        continue
                    for k, q in enumerate(p.split(s)):
                        cut += ([i] if k else []) + [q]
                out = cut
        return out


_LOADED: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    if not _CLASSES:
        kind = {"L": LETTER, "N": NUMBER}
        t = np.fromiter((UNKNOWN if (c := unicodedata.category(chr(i))) == "Cn"
                         else kind.get(c[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        t[WHITE_SPACE], t[0x20] = WHITE, SPACE
        _CLASSES.append(t)
    return _CLASSES[0]


def _resolve(points: np.ndarray) -> None:
    """Classes of characters that this Python's Unicode tables don't have yet:
    the library's own pre-tokeniser tells whether they join letters or digits."""
    from tokenizers import pre_tokenizers
    split, table = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str, _classes()
    for p in points:
        c = chr(p)
        table[p] = (LETTER if len(split("a" + c)) == 1 else NUMBER if len(split("1" + c)) == 1
                    else OTHER)


def word_starts(points: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """True where a word of the byte-level pre-tokeniser starts.

    points: code points of texts laid end to end; fresh: True at the first of
    each text. Every rule looks at most three characters around, so whole
    batches are cut at once."""
    n = len(points)
    table = _classes()
    c = table[points]
    if (c == UNKNOWN).any():
        _resolve(np.unique(points[c == UNKNOWN]))
        c = table[points]
    prev = np.empty(n, np.uint8)
    prev[0], prev[1:] = OTHER, c[:-1]
    last = np.empty(n, bool)  # last of its text
    last[-1], last[:-1] = True, fresh[1:]
    white, prev_white = c <= WHITE, (prev <= WHITE) & ~fresh
    next_dark = np.zeros(n, bool)
    next_dark[:-1] = ~white[1:]
    next_dark &= ~last
    start = np.where(white, ~prev_white | next_dark, np.where(prev_white, prev == WHITE, c != prev))
    start |= fresh
    for i in np.flatnonzero((points == 0x27) & start):
        for s in SUFFIXES:
            k = len(s)
            if i + k < n and all(points[i + 1 + j] == ord(s[j]) and not fresh[i + 1 + j]
                                 for j in range(k)):
                start[i + 1] = False
                if i + 1 + k < n:
                    start[i + 1 + k] = True
                break
    return start


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Interned(dict):
    """Word -> its number from 0; words met for the first time are listed in
    ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, word) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def gather(flat: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs flat[at[i] : at[i] + length[i]], end to end."""
    total = int(length.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(length)
    return flat[np.arange(total) + np.repeat(at - (ends - length), length)]
