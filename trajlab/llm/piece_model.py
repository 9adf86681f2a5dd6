"""A SentencePiece model file as tables, and the walk through its pieces over many strings at once."""

from __future__ import annotations

import numpy as np

from trajlab.llm.text import trimmed
from trajlab.llm.units import UnitStore

MARK = "▁"
#: score below the worst piece of a character that no piece covers
UNKNOWN = 10.0
#: no path
NONE = complex(-np.inf, 0)
#: scores are rounded to this, so that their sums are exact and don't hang on where a text is cut
QUANTUM = 2.0**-16
#: strings walked through at a time
BATCH = 50_000
#: unknown characters are a piece without an id until they are written as bytes
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """A map from non-negative long keys to ints, looked up for arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys)).bit_length() + 1)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot[todo]] < 0
            trying = todo[free]
            # of several keys for one free slot the last stays, the others go on
            self.keys[slot[trying]] = keys[trying]
            won = self.keys[slot[trying]] == keys[trying]
            self.values[slot[trying[won]]] = values[trying[won]]
            todo = np.concatenate([todo[~free], trying[~won]])
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for a key that isn't there."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


def _model_type(path: str) -> int:
    """The field model_type (3) of the file's trainer_spec (2): 1 unigram, the default, 2 byte pairs."""
    with open(path, "rb") as f:
        raw = f.read()

    def fields(raw: bytes):
        at = 0

        def number() -> int:
            nonlocal at
            value = shift = 0
            while True:
                byte = raw[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while at < len(raw):
            tag = number()
            kind = tag & 7
            if kind == 0:
                yield tag >> 3, number()
            else:
                size = {1: 8, 5: 4}.get(kind) or number()
                yield tag >> 3, raw[at : at + size]
                at += size

    spec = b"".join(x for field, x in fields(raw) if field == 2)
    return next((x for field, x in fields(spec) if field == 3), 1)


class PieceModel:
    """The pieces and scores of a SentencePiece model file. White space is a mark; a mark opens the
    text; a character without a piece is its UTF-8 bytes where the model has byte pieces, else unknown.

    merges: whether the file's model is one of byte pairs, whose pieces join in the order of their scores,
    the leftmost first; else the path with the greatest sum of scores counts.
    """

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = _model_type(path)
        if kind not in (1, 2):
            raise ValueError("only unigram and byte-pair models have pieces with scores")
        self.merges = kind == 2
        size = self.size = p.get_piece_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.piece = [p.id_to_piece(i) for i in range(size)]
        self.bytes = {int(self.piece[i][3:5], 16): i for i in range(size) if p.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = p.unk_id()
        usual = [i for i in range(size) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        self.score = {self.piece[i]: (p.get_score(i), i) for i in usual}
        if any(MARK in x.lstrip(MARK) for x in self.score):
            raise ValueError("a piece holds a white-space mark after another character")
        if any(c not in self.score for x in self.score for c in x):
            raise ValueError("a piece holds a character that is no piece")
        self.longest = max(map(len, self.score))
        self.penalty = min(s for s, _ in self.score.values()) - UNKNOWN
        #: what each id decodes to
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else x.replace(MARK, " ").encode() for i, x in enumerate(self.piece)]
        self._walkable()
        if self.merges:
            self._mergeable()
        self.units = UnitStore(self._encode_units, most_units=300_000, most_ids=2_000_000)

    # ------------------------------------------------------------ tables

    def _walkable(self) -> None:
        """The pieces as a tree of characters; weights of pieces and of borders between them."""
        letters = sorted({c for x in self.score for c in x})
        #: 0 ends a string, 1 is a character without a piece
        self.code = np.ones(0x110000, np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(2, len(letters) + 2)
        self.letters = len(letters) + 2
        node: dict[str, int] = {"": 0}
        keys, children = [], []
        for x in sorted(self.score):
            for k in range(1, len(x) + 1):
                if x[:k] not in node:
                    node[x[:k]] = len(node)
                    keys.append(node[x[: k - 1]] * self.letters + int(self.code[ord(x[k - 1])]))
                    children.append(node[x[:k]])
        self.child = Table(np.array(keys, np.int64), np.array(children, np.int32))
        self.at_node = np.full(len(node), -1, np.int32)
        for x, (_, i) in self.score.items():
            self.at_node[node[x]] = i
        self.first_node = np.full(self.letters, -1, np.int32)
        for c in letters:
            self.first_node[self.code[ord(c)]] = node[c]
        #: of each id, and behind them of a character without a piece
        scores = np.full(self.size + 1, self.penalty)
        for s, i in self.score.values():
            scores[i] = s
        self.weight = np.round(scores / QUANTUM) * QUANTUM
        #: added to paths with a border at the given place of a unit, to tell paths of equal scores apart
        self.place = np.random.default_rng(11).integers(0, 1 << 30, 1 << 16).astype(float)

    def merged(self, s: str) -> list[str]:
        """The pieces of s once nothing more joins."""
        parts = list(s)
        while True:
            best, where = self.size, -1
            for k in range(len(parts) - 1):
                r = self.rank_of.get(parts[k] + parts[k + 1], self.size)
                if r < best:
                    best, where = r, k
            if where < 0:
                return parts
            self.joined = parts[where], parts[where + 1]
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def _mergeable(self) -> None:
        """The order in which pieces join, and for each piece the two that join to it last."""
        ranks = {s: k for k, s in enumerate(sorted({s for s, _ in self.score.values()}, reverse=True))}
        self.rank_of = {x: ranks[s] for x, (s, _) in self.score.items() if len(x) > 1}
        many = np.bincount(list(self.rank_of.values()), minlength=len(ranks))
        self.rank = np.full(self.size + 1, -1, np.int64)
        self.left, self.right = np.full(self.size + 1, -1, np.int32), np.full(self.size + 1, -1, np.int32)
        #: pieces whose joins don't come in the order of ranks of their own: pairs with them are joined to see
        self.odd = np.zeros(self.size + 1, bool)
        keys, values = [], []
        for x in sorted(self.score, key=len):
            i = self.score[x][1]
            if len(x) == 1:
                continue
            self.rank[i] = self.rank_of[x]
            for k in range(1, len(x)):
                a, b = self.score.get(x[:k]), self.score.get(x[k:])
                if a and b:
                    keys.append(a[1] * (self.size + 1) + b[1])
                    values.append(i)
            if self.merged(x) != [x]:
                # never the outcome of joining, so no path has it
                self.at_node[self.at_node == i] = -1
                continue
            a, b = (self.score[y][1] for y in self.joined)
            self.left[i], self.right[i] = a, b
            self.odd[i] = many[self.rank[i]] > 1 or self.odd[a] or self.odd[b] or max(self.rank[a], self.rank[b]) >= self.rank[i]
        self.pair = Table(np.array(keys, np.int64), np.array(values, np.int32))
        self._seen, self._fit = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        self._told: dict[tuple[int, int], bool] = {}

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pieces a and b stay apart when joined as one text. Both are taken apart again, the
        latest join first; they do not stay apart if at any time their touching parts would have joined
        before the next join of either."""
        out = np.ones(len(a), bool)
        odd = np.flatnonzero((self.odd[a] | self.odd[b]) & (a < self.size) & (b < self.size))
        for k in odd.tolist():
            pair = int(a[k]), int(b[k])
            if pair not in self._told:
                x, y = self.piece[pair[0]], self.piece[pair[1]]
                self._told[pair] = self.merged(x + y) == [x, y]
            out[k] = self._told[pair]
        live = np.setdiff1d(np.arange(len(a)), odd, assume_unique=True)
        a, b = a[live].astype(np.int64), b[live].astype(np.int64)
        # of equal ranks the left one joins first: twice the rank, and one more behind the border
        before = np.full(len(live), 2 * self.size + 2)
        while len(live):
            c = self.pair.get(a * (self.size + 1) + b)
            meets = (c >= 0) & (2 * self.rank[c] < before)
            out[live[meets]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~meets & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            undo_a = ra > rb
            before = np.where(undo_a, 2 * ra, 2 * rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return out

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same with a store of pairs seen before."""
        key = a.astype(np.int64) * (self.size + 1) + b
        slot = ((key.astype(np.uint64) * _MULTIPLIER) >> np.uint64(44)).astype(np.int64)
        out = self._fit[slot]
        new = np.flatnonzero(self._seen[slot] != key)
        if len(new):
            out[new] = self._fits(a[new], b[new])
            self._seen[slot[new]], self._fit[slot[new]] = key[new], out[new]
        return out

    # ------------------------------------------------------------ strings

    def normal(self, text: str) -> str:
        """The text with marks for spaces and one in front; empty stays empty."""
        return MARK + text.replace(" ", MARK) if text else ""

    def found(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id) of every piece in strings of codes, 0 between them; a character without a
        piece has the id `size`."""
        unknown = np.flatnonzero(codes == 1)
        at = np.flatnonzero(codes > 1)
        starts, ends, ids = [unknown], [unknown + 1], [np.full(len(unknown), self.size, np.int32)]
        node = self.first_node[codes[at]].astype(np.int64)
        padded = np.concatenate([codes, np.zeros(self.longest, np.int32)])
        for k in range(1, self.longest + 1):
            piece = self.at_node[node]
            hit = piece >= 0
            starts.append(at[hit])
            ends.append(at[hit] + k)
            ids.append(piece[hit])
            child = self.child.get(node * self.letters + padded[at + k])
            on = (child >= 0) & (padded[at + k] > 1)
            at, node = at[on], child[on].astype(np.int64)
            if not len(at):
                break
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(ids)

    def states(self, borders: list[tuple[str, str]]) -> list[list[tuple[int, int]]]:
        """The states at each border between (what is behind, what is ahead), in a fixed order: (characters
        that the last piece reaches into what is ahead, the piece; in a unigram model -1). The start of a
        text has one."""
        behind = [x[-self.longest :] for x, _ in borders]
        texts = [x + y[: self.longest - 1] for x, (_, y) in zip(behind, borders, strict=True)]
        codes = self.code[np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32)]
        size = np.array([len(x) + 1 for x in texts], np.int64)
        base = np.cumsum(size) - size
        codes[base + size - 1] = 0
        at = (base + [len(x) for x in behind])[np.repeat(np.arange(len(texts)), size)]
        start, end, piece = self.found(codes)
        over = np.flatnonzero((start < at[start]) & (end >= at[start]))
        reach = end[over] - at[start[over]]
        row = np.searchsorted(base, start[over], "right") - 1
        found = np.unique(np.stack([row, reach, piece[over] if self.merges else np.full(len(over), -1)], 1), axis=0)
        cuts = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
        pairs = list(map(tuple, found[:, 1:].tolist()))
        return [pairs[a:b] if x else [(0, -1)] for x, a, b in zip(behind, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    @staticmethod
    def last_state() -> tuple[int, int]:
        """The state at the end of a text."""
        return (0, -1)

    def ids_of(self, piece: str) -> list[int]:
        if piece in self.score:
            return [self.score[piece][1]]
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in piece.encode()]

    def traced(self, s: str, entry: int, end: int) -> list[str]:
        """The pieces of the path from entry to end."""
        lanes = Lanes(self)
        lanes.add(s[entry:end], None, 0, end - entry)
        lanes.run()
        borders = [*lanes.path(0, end - entry), 0][::-1] if end > entry else [0]
        return [s[entry + a : entry + b] for a, b in zip(borders[:-1], borders[1:], strict=True)]

    def unit_score(self, unit: str) -> float:
        """The greatest sum of scores over all paths of a string, as a unigram model has it."""
        best = [0.0] + [-np.inf] * len(unit)
        for j in range(1, len(unit) + 1):
            best[j] = max((best[i] + self.score.get(unit[i:j], (self.penalty if j == i + 1 else -np.inf, 0))[0] for i in range(max(0, j - self.longest), j)))
        return best[-1]

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, counts = [], []
        for k in range(0, len(units), BATCH):
            lanes = Lanes(self)
            for u in units[k : k + BATCH]:
                lanes.add(u, None, 0, len(u))
            lanes.run()
            ids, n = lanes.all_ids()
            flat.append(ids)
            counts.append(n)
        return np.concatenate(flat), np.concatenate(counts)

    def shrink(self) -> None:
        """Between tasks a worker keeps the model alone."""
        self.units.clear()
        trimmed()

    def decode(self, ids: list[int]) -> str:
        """The text whose ids these are: bytes are joined, marks are spaces, the first one goes."""
        return b"".join(map(self.raw.__getitem__, ids)).decode(errors="replace")[1:]


class Lanes:
    """Strings walked through side by side, place by place."""

    def __init__(self, m: PieceModel):
        self.m, self.texts, self.entry, self.inside, self.limit = m, [], [], [], []

    @property
    def n(self) -> int:
        return len(self.texts)

    def add(self, text: str, state: tuple[int, int] | None, inside: int, limit: int) -> int:
        """A string entered in a state (None: afresh), whose first character is `inside` characters into
        its unit, and in which pieces start before `limit`."""
        self.texts.append(text)
        self.entry.append(state or (0, -1))
        self.inside.append(inside)
        self.limit.append(limit)
        return len(self.texts) - 1

    def run(self) -> None:
        m = self.m
        length = np.array([len(t) for t in self.texts], np.int64)
        self.length, self.base = length, np.cumsum(length + 1) - length - 1
        self.points = np.frombuffer("\0".join([*self.texts, ""]).encode("utf-32-le"), np.uint32)
        codes = m.code[self.points]
        codes[self.base + length] = 0
        lane = np.repeat(np.arange(self.n), length + 1)
        start, end, piece = m.found(codes)
        base, limit = self.base[lane[start]], np.array(self.limit, np.int64)[lane[start]]
        keep = start - base < limit
        start, end, piece, at = start[keep], end[keep], piece[keep], (end - base)[keep]
        # by place, then by where they end and where they start
        order = np.lexsort((start, end, at))
        start, end, piece, at = start[order], end[order], piece[order], at[order]
        edges = np.searchsorted(at, np.arange(1, (int(at[-1]) if len(at) else 0) + 2))
        #: of each node, the place before or behind a character: the piece that ends there, -2 for none, and its start
        self.last, self.before = np.full(len(codes), -2, np.int32), np.full(len(codes), -1, np.int64)
        reach, state = np.array(self.entry, np.int64).reshape(-1, 2).T
        opened = self.base + reach
        self.last[opened] = state
        if m.merges:
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                was = self.last[start[a:b]]
                live = np.flatnonzero(was > -2)
                was, p = was[live], piece[a:b][live]
                ok = was < 0
                ok[~ok] = m.fits(was[~ok], p[~ok])
                won = live[ok] + a
                self.last[end[won]], self.before[end[won]] = piece[won], start[won]
            return
        self.value = np.full(len(codes), NONE)
        self.value[opened] = 0
        inside = np.array(self.inside, np.int64)[lane[end]] + at
        weight = m.weight[piece] + 1j * m.place[inside & (len(m.place) - 1)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if a == b:
                continue
            cand = self.value[start[a:b]] + weight[a:b]
            cut = np.flatnonzero(np.concatenate([[True], end[a + 1 : b] != end[a : b - 1]]))
            best = np.maximum.reduceat(cand, cut)
            node = end[a:b][cut]
            better = best > self.value[node]
            first = np.flatnonzero(cand == np.repeat(best, np.diff(np.append(cut, b - a))))
            first = first[np.searchsorted(first, cut)]
            won = first[better] + a
            self.value[node[better]], self.last[node[better]], self.before[node[better]] = best[better], piece[won], start[won]

    def exit(self, lane: int, at: int) -> complex:
        """The best score up to a place of a lane."""
        node = self.base[lane] + at
        if self.m.merges:
            return 0j if self.last[node] > -2 else NONE
        return self.value[node]

    def exits(self, lane: int, at: int, states: list[tuple[int, int]]) -> np.ndarray:
        """The best score into each state at a place of a lane."""
        out = np.full(len(states), NONE)
        for k, (reach, piece) in enumerate(states):
            # a piece that came in and reaches out again is no way for a chunk as long as a piece
            if at + reach <= self.length[lane] and (piece < 0 or self.last[self.base[lane] + at + reach] == piece):
                out[k] = self.exit(lane, at + reach)
        return out

    def path(self, lane: int, at: int) -> list[int]:
        """The places where pieces end, from a place of a lane back to where it was entered."""
        base, out = int(self.base[lane]), []
        while (was := int(self.before[base + at])) >= 0:
            out.append(at)
            at = was - base
        return out

    def _ids(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces that end at the nodes, and how many each has."""
        piece = self.last[node]
        counts = np.ones(len(node), np.int64)
        other = np.flatnonzero(piece == self.m.size)
        if not len(other):
            return piece, counts
        lists = [self.m.ids_of(chr(c)) for c in self.points[node[other] - 1].tolist()]
        counts[other] = [len(x) for x in lists]
        out = np.repeat(piece, counts)
        out[np.repeat(piece == self.m.size, counts)] = [i for x in lists for i in x]
        return out, counts

    def trace(self, lane: int, at: int, state: tuple[int, int] | None) -> np.ndarray:
        """The ids of a lane's pieces up to a state at a place."""
        path = self.path(lane, at + (state[0] if state else 0))
        return self._ids(self.base[lane] + np.array(path[::-1], np.int64))[0].astype(np.int32)

    def all_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all whole lanes in a row, and how many each has."""
        lane, node, found = np.arange(self.n), self.base + self.length, []
        while True:
            live = self.before[node] >= 0
            lane, node = lane[live], node[live]
            if not len(lane):
                break
            found.append((lane, node))
            node = self.before[node]
        if not found:
            return np.empty(0, np.int32), np.zeros(self.n, np.int64)
        lane, node = (np.concatenate(x) for x in zip(*found, strict=True))
        node = node[np.lexsort((node, lane))]
        lane = np.sort(lane)
        ids, counts = self._ids(node)
        return ids.astype(np.int32), np.bincount(lane, counts, self.n).astype(np.int64)


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model a Python worker."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]
