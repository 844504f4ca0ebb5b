"""Sampled SentencePiece segmentations without replacement, and decoding.

A text's segmentations are paths through a lattice whose edges are vocabulary pieces, and a
path's probability is the product of its pieces' (by Zipf's law over their ranks), so that of
an edge, given the place where it starts, follows from one backward pass. Perturbing every
path's log-probability with Gumbel noise and taking the k largest draws k distinct paths
without replacement. The search goes best first: the noise of a set of paths is the largest
in it, so the whole lattice gets one value, its best path is drawn edge by edge, and what is
left falls into one set per edge of that path (same path so far, another edge here), each
with a value of its own below the one that was taken.

No piece joins a letter to something else or goes on to the next space mark, so the lattice is
a chain of the lattices of such runs, and those are remembered within a worker, by a 64-bit hash
of their characters.
"""

from __future__ import annotations

import re
from collections.abc import Generator, Iterator
from dataclasses import dataclass
from itertools import chain
from math import log

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from listwright.llm.bytescan import mixed, powers
from listwright.llm.frames import shipped
from listwright.llm.tokens import slices

PIECES = "piece_bpe_32k.model"
SPACE = "▁"
# Letters, without the small digits that Python counts among them.
_LETTER = re.compile(r"[^\W\d_²³¹]")
# Edges that a worker remembers, some 30 bytes each with their share of places and runs; a text
# that needs more by itself gets more while it lasts.
_MOST_EDGES = 4_000_000
# Characters of new runs whose edges are worked out at once, and of runs that are hashed at once.
_LEARNT = 1 << 16
_HASHED = 1 << 20
_OTHER, _LETTERS, _MARK = 1, 2, 3


def _hash_of(text: str) -> np.uint64:
    """The hash that ``Lattices`` gives to a stretch of characters."""
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    value = (mixed(chars) * powers(len(chars))[0][: len(chars)]).sum(dtype=np.uint64)
    return mixed(np.array([value], np.uint64) + np.uint64(len(chars)))[0]


@dataclass(frozen=True)
class Settings:
    """``k`` segmentations per text; ``sharpness`` scales log-probabilities, so 0 makes all
    paths alike and large values leave the best one only."""

    k: int = 2
    sharpness: float = 1.0
    seed: int = 17


class Lattices:
    """The lattices of runs met so far, as flat arrays over all their places and edges."""

    def __init__(self, path: str | None = None, sharpness: float = 1.0):
        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(PIECES))
        self.sharpness = sharpness
        kinds = [(i, model.id_to_piece(i)) for i in range(model.get_piece_size())]
        self.pieces = [p for _, p in kinds]
        plain = [(i, p) for i, p in kinds if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        first = min(i for i, _ in plain)
        total = sum(1 / r for r in range(1, len(plain) + 1))
        order = np.array([i for i, _ in plain], np.int32)
        hashes = np.array([_hash_of(p) for _, p in plain], np.uint64)
        by = np.argsort(hashes)
        self.hashes, self.hash_ids = hashes[by], order[by]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces have one hash")
        # A bucket per leading bits: where its hashes begin, behind which all of them stand.
        buckets = np.arange(1 << 18, dtype=np.uint64) << np.uint64(46)
        self.bucket = np.searchsorted(self.hashes, buckets).astype(np.int32)
        self.deepest = int(np.bincount((self.hashes >> np.uint64(46)).astype(np.int64)).max())
        self.hashes = np.append(self.hashes, np.full(self.deepest, np.uint64(2**64 - 1)))
        self.hash_ids = np.append(self.hash_ids, np.full(self.deepest, -1, np.int32))
        # Bit 1: may be a piece. Bit 2: may begin a longer piece; a stretch that does not cannot grow into one.
        self.hints = np.zeros(1 << 21, np.uint8)
        self.hints[hashes >> np.uint64(43)] = 1
        heads = {p[:k] for _, p in plain for k in range(1, len(p))}
        self.hints[np.array([_hash_of(h) for h in heads], np.uint64) >> np.uint64(43)] |= 2
        ranks = np.arange(len(self.pieces)) - first + 1
        self.weight = np.where(ranks > 0, -sharpness * np.log(np.maximum(ranks, 1) * total), 0.0)
        self.bytes = {int(p[3:5], 16): i for i, p in kinds if model.is_byte(i)}
        self.byte_weight = -sharpness * log(256 * len(plain) * total)
        self.longest = max(len(p) for _, p in plain)
        pairs = {(a, b) for _, p in plain for a, b in zip(p, p[1:], strict=False) if a != SPACE}
        if any(b == SPACE or bool(_LETTER.match(a)) != bool(_LETTER.match(b)) for a, b in pairs):
            raise ValueError("this vocabulary joins letters to other characters")
        shown = list(self.pieces)
        for byte, i in self.bytes.items():
            shown[i] = chr(byte) if byte < 128 else ""
        self.shown_size = np.fromiter(map(len, shown), np.int32, len(shown))
        self.shown_from = (np.cumsum(self.shown_size) - self.shown_size).astype(np.int32)
        self.shown_chars = np.frombuffer("".join(shown).encode("utf-32-le"), np.uint32)
        self.high = np.zeros(len(self.pieces), bool)
        self.high[[i for byte, i in self.bytes.items() if byte >= 128]] = True
        edges = _MOST_EDGES
        kinds = {"begin": (np.int64, edges // 8), "end": (np.int64, edges // 8), "edge_from": (np.int32, edges // 2),
                 "chance": (np.float64, edges // 2), "sum": (np.float64, edges), "to": (np.int32, edges),
                 "logp": (np.float64, edges), "code": (np.int32, edges),
                 "spell_from": (np.int32, 1 << 16), "spell_code": (np.int32, 1 << 16)}
        # Untouched zeros take no memory.
        self.flat = {k: np.zeros(n + 1, t) for k, (t, n) in kinds.items()}
        self.kind = np.zeros(0x110000, np.int8)
        self.forget()

    def forget(self) -> None:
        """Begin anew, in the arrays that are there."""
        self.known, self.known_at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.count = dict.fromkeys(("run", "node", "edge", "spell", "byte"), 0)

    def cuts(self, chars: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Where runs begin, of texts one after the other whose spaces are marks.

        A run is marks and the letters behind them, or marks and whatever else.
        """
        kind = self.kind[chars]
        if not kind.all():
            for c in np.unique(chars[kind == 0]).tolist():
                self.kind[c] = _MARK if chr(c) == SPACE else _LETTERS if _LETTER.match(chr(c)) else _OTHER
            kind = self.kind[chars]
        mark = kind == _MARK
        first = np.ones(len(chars), bool)
        first[1:] = ~mark[:-1] & (kind[1:] != kind[:-1])
        first[bound[:-1][bound[1:] > bound[:-1]]] = True
        return np.flatnonzero(first)

    def hashed(self, chars: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of stretches of characters one after the other, as ``_hash_of`` gives them."""
        out = np.empty(len(start), np.uint64)
        lo = 0
        while lo < len(start):
            hi = max(lo + 1, int(np.searchsorted(stop, start[lo] + _HASHED, "right")))
            base, n = start[lo], int(stop[hi - 1] - start[lo])
            power, inverse = powers(n)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(mixed(chars[base : base + n].astype(np.uint64)) * power[:n], out=sums[1:])
            a, b = start[lo:hi] - base, stop[lo:hi] - base
            out[lo:hi] = mixed((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
            lo = hi
        return out

    def _pieces(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash among those of the pieces, or -1."""
        place = self.bucket[h >> np.uint64(46)]
        open_ = np.flatnonzero(self.hashes[place] != h)
        for _ in range(1, self.deepest):
            place[open_] += 1
            open_ = open_[self.hashes[place[open_]] != h[open_]]
        place[open_] = -1
        return place

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        have = self.flat[name]
        if at + len(values) > len(have):
            more = np.zeros(max(at + len(values), len(have) * 3 // 2), have.dtype)
            more[:at] = have[:at]
            self.flat[name] = have = more
        have[at : at + len(values)] = values

    def _learn(self, text: np.ndarray, size: np.ndarray) -> None:
        """Edges of new runs, the best of each place first, with chances given the place."""
        n, stop = len(text), np.cumsum(size)
        ahead = np.repeat(stop, size) - np.arange(n)
        power, inverse = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(text.astype(np.uint64)) * power[:n], out=sums[1:])
        found = []
        growing = np.arange(n)
        for length in range(1, self.longest + 1):
            at = growing[ahead[growing] >= length]
            if not len(at):
                break
            h = mixed((sums[at + length] - sums[at]) * inverse[at] + np.uint64(length))
            hints = self.hints[h >> np.uint64(43)]
            growing = at[hints > 1]
            hit = np.flatnonzero(hints & 1)
            place = self._pieces(h[hit])
            good = place >= 0
            at, ids = at[hit[good]], self.hash_ids[place[good]]
            if length == 1:
                # A character that is no piece is spelled in bytes.
                bare = np.ones(n, bool)
                bare[at] = False
                bare = np.flatnonzero(bare)
                spelled = [chr(c).encode("utf-8", "replace") for c in text[bare].tolist()]
                spent = self.byte_weight * np.fromiter(map(len, spelled), np.int64, len(bare))
                found.append((bare, 1, -1 - np.arange(len(bare)), spent))
            found.append((at, length, ids, self.weight[ids]))
        # One place after the other, long edges first; a place has one edge of a length.
        count = np.zeros(n, np.int64)
        for at, *_ in found:
            count[at] += 1
        first = np.cumsum(count) - count
        total, free = int(count.sum()), first.copy()
        end, piece, weight = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total)
        for at, length, ids, own in reversed(found):
            to = free[at]
            free[at] += 1
            end[to], piece[to], weight[to] = at + length, ids, own
        start = np.repeat(np.arange(n), count)
        # Backward from the runs' ends, all runs at once: a place needs only places nearer to the end.
        narrow = ahead.astype(np.uint16) if int(size.max()) < 1 << 16 else ahead
        nodes = np.argsort(narrow, kind="stable")
        many = count[nodes]
        cuts = np.cumsum(many) - many
        edge = np.repeat(first[nodes] - cuts, many) + np.arange(total)
        behind = np.zeros(n + 1)
        beyond = np.where(ahead[start] == end - start, n, end)
        target, cost = beyond[edge], weight[edge]
        levels = np.flatnonzero(np.diff(ahead[nodes], prepend=0, append=-1))
        upper = np.append(cuts, total)
        for a, b in zip(levels[:-1].tolist(), levels[1:].tolist(), strict=True):
            lo, hi = upper[a], upper[b]
            value = cost[lo:hi] + behind[target[lo:hi]]
            cut = cuts[a:b] - lo
            top = np.maximum.reduceat(value, cut)
            behind[nodes[a:b]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, many[a:b])), cut))
        logp = weight + behind[beyond] - behind[start]
        best = np.flatnonzero(logp == np.repeat(np.maximum.reduceat(logp, first), count))
        lead = np.empty(n, np.int64)
        lead[start[best]] = best
        for values in (end, piece, logp):
            values[first], values[lead] = values[lead], values[first]
        # Chances in 53 bits: their running sums over all places are exact modulo 2**64, so those of a
        # place depend on neither the batch nor what is known.
        sums = np.cumsum((np.exp(logp) * (1 << 53)).astype(np.uint64), dtype=np.uint64)
        before = np.append(np.uint64(0), sums)[first]
        upto = np.minimum((sums - np.repeat(before, count)).astype(np.float64) * 2.0**-53, 1.0)
        final = first + count - 1
        upto[final] = 1.0
        r, base, edges, spells, known = (self.count[k] for k in ("run", "node", "edge", "spell", "byte"))
        # An edge's code is its piece, or below 0 the number of a spelling in bytes.
        spelt = np.flatnonzero(piece < 0)
        raws = [spelled[-1 - i] for i in piece[spelt]]
        piece[spelt] = -1 - spells - np.arange(len(spelt))
        spelling = np.array([self.bytes[b] for raw in raws for b in raw], np.int32)
        spell_from = known + np.cumsum([0, *map(len, raws)])
        alone = first == final
        # The place behind a run is the next run's first one; a walk stops there.
        for name, at, values in (
            ("begin", r, base + stop - size), ("end", r, base + stop),
            ("edge_from", base, edges + np.append(first, len(start))), ("chance", base, np.where(alone, 2.0, upto[first])),
            ("sum", edges, upto), ("to", edges, base + end), ("logp", edges, logp),
            ("code", edges, piece), ("spell_from", spells, spell_from), ("spell_code", known, spelling),
        ):
            self._put(name, at, values)
        self.count = {"run": r + len(size), "node": base + n, "edge": edges + len(start),
                      "spell": spells + len(spelt), "byte": known + len(spelling)}

    def places(self, runs: list[str]) -> np.ndarray:
        """The number of each run's lattice."""
        size = np.fromiter(map(len, runs), np.int64, len(runs))
        stop = np.cumsum(size)
        return self.placed(np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32), stop - size, stop)

    def placed(self, chars: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The numbers of the lattices of runs of characters; new runs are learnt in small slices."""
        hashes, at, which = np.unique(self.hashed(chars, start, stop), return_index=True, return_inverse=True)
        size = (stop - start)[at]

        def unknown() -> np.ndarray:
            near = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
            return np.flatnonzero(self.known[near] != hashes) if len(self.known) else np.arange(len(hashes))

        new = unknown()
        # A character has two or three edges.
        if self.count["edge"] + 3 * int(size[new].sum()) > _MOST_EDGES and len(self.known):
            self.forget()
            new = unknown()
        numbers = self.count["run"] + np.arange(len(new))
        upto = np.cumsum(size[new])
        lo = 0
        while lo < len(new):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _LEARNT, "right")))
            own = size[new[lo:hi]]
            ends = np.cumsum(own)
            self._learn(chars[np.repeat(start[at[new[lo:hi]]] - (ends - own), own) + np.arange(int(ends[-1]))], own)
            lo = hi
        if len(new):
            to = np.searchsorted(self.known, hashes[new])
            self.known = np.insert(self.known, to, hashes[new])
            self.known_at = np.insert(self.known_at, to, numbers)
        return self.known_at[np.searchsorted(self.known, hashes)][which] if len(hashes) else np.zeros(0, np.int64)

    def next_edges(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge from each place, by a uniform number."""
        flat = self.flat
        edge = flat["edge_from"][at]
        other = np.flatnonzero(u >= flat["chance"][at])
        if not len(other):
            return edge
        tried, last, sought = edge[other] + 1, flat["edge_from"][at[other] + 1] - 1, u[other]
        if len(other) < 8:
            for i, lo, hi, x in zip(other.tolist(), tried.tolist(), last.tolist(), sought.tolist(), strict=True):
                edge[i] = lo + int(flat["sum"][lo:hi].searchsorted(x, "right"))
            return edge
        # A place has few edges, so they are tried one after the other.
        live = np.flatnonzero((tried < last) & (flat["sum"][tried] <= sought))
        while len(live):
            tried[live] += 1
            now = tried[live]
            live = live[(now < last[live]) & (flat["sum"][now] <= sought[live])]
        edge[other] = np.minimum(tried, last)
        return edge

    def walks(self, place: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A drawn path for every run: edges one run after the other, and where each run's begin."""
        flat = self.flat
        at, stop = flat["begin"][place], flat["end"][place]
        live, steps = np.arange(len(place)), []
        count = np.zeros(len(place), np.int64)
        while len(live):
            u = _uniform(key[live] + np.uint64(len(steps)))
            edge = self.next_edges(at[live], u)
            steps.append((live, edge))
            count[live] += 1
            at[live] = flat["to"][edge]
            live = live[at[live] < stop[live]]
        bounds = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(bounds[-1], np.int64)
        for t, (who, edge) in enumerate(steps):
            out[bounds[who] + t] = edge
        return out, bounds

    def codes(self, edges: np.ndarray) -> np.ndarray:
        """The piece ids of edges one after the other."""
        code = self.flat["code"][edges]
        spelt = np.flatnonzero(code < 0)
        if not len(spelt):
            return code
        lo = self.flat["spell_from"][-1 - code[spelt]].astype(np.int64)
        n = np.ones(len(code), np.int64)
        n[spelt] = self.flat["spell_from"][-code[spelt]] - lo
        out = np.repeat(code, n)
        ends = np.cumsum(n)
        for at, begin, many in zip((ends - n)[spelt].tolist(), lo.tolist(), n[spelt].tolist(), strict=True):
            out[at : at + many] = self.flat["spell_code"][begin : begin + many]
        return out


def _uniform(key: np.ndarray) -> np.ndarray:
    return (mixed(key * np.uint64(0xD1342543DE82EF95)) >> np.uint64(11)).astype(np.float64) * (1.0 / (1 << 53))


def _gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(np.clip(u, 1e-300, 1 - 1e-16)))


def _below(mass: np.ndarray, u: np.ndarray, bound: float) -> np.ndarray:
    """Gumbel values of sets of such log-probabilities, given that they are below a bound."""
    top = mass.max()
    if not np.isfinite(top):
        return np.full(len(mass), -np.inf)
    with np.errstate(over="ignore", under="ignore"):
        value = top - np.log(np.exp(top - bound) - np.log(np.clip(u, 1e-300, 1 - 1e-16)) * np.exp(top - mass))
    return value


def marked(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of texts one after the other, marks for spaces and one in front; an empty text has none."""
    size = np.fromiter(((len(t) + 1 if t else 0) for t in texts), np.int64, len(texts))
    chars = np.frombuffer("".join(SPACE + t for t in texts if t).encode("utf-32-le"), np.uint32)
    return np.where(chars == 0x20, np.uint32(ord(SPACE)), chars), np.append(0, np.cumsum(size))


class Sampler:
    """Draws k distinct segmentations of each text; equal keys draw alike."""

    def __init__(self, cfg: Settings, path: str | None = None):
        self.cfg = cfg
        self.lattices = Lattices(path, cfg.sharpness)

    def sample(self, texts: list[str], keys: np.ndarray) -> Iterator[list[tuple[np.ndarray, float, float, float]]]:
        """For each text its samples, best first: (piece ids, log-probability, value, inclusion).

        ``value`` is the perturbed log-probability. ``inclusion`` is the probability that the
        path is among the k, given the value of the best path left out; 1 if there is none.
        """
        seed, lattices = mixed(np.array([self.cfg.seed], np.uint64))[0], self.lattices
        chars, bound = marked(texts)
        start = lattices.cuts(chars, bound)
        place = lattices.placed(chars, start, np.append(start[1:], len(chars)))
        bound = np.searchsorted(start, bound)
        count = np.diff(bound)
        doc_key = mixed(keys.astype(np.int64).view(np.uint64) ^ seed)
        own = np.arange(len(start)) - np.repeat(bound[:-1], count)
        run_key = mixed(np.repeat(doc_key, count) + (own.astype(np.uint64) << np.uint64(24)))
        searches = [self._search(doc_key[d], place, int(bound[d]), int(bound[d + 1])) for d in range(len(texts))]
        found: list = [None] * len(texts)
        given: list = [None] * len(texts)
        for j in range(self.cfg.k + 1):
            # Every search goes on to its next path, and says from which run on it wants fresh draws.
            wants = []
            for d, search in enumerate(searches):
                if found[d] is None:
                    try:
                        with np.errstate(over="ignore"):
                            wants.append((d, search.send(given[d])))
                    except StopIteration as end:
                        found[d], given[d] = end.value, None
            if not wants:
                break
            many = np.array([bound[d + 1] - lo for d, lo in wants], np.int64)
            ends = np.cumsum(many)
            runs = np.repeat(np.array([lo for _, lo in wants], np.int64) - (ends - many), many) + np.arange(int(ends[-1]))
            edges, at = lattices.walks(place[runs], mixed(run_key[runs] + (np.uint64(j) << np.uint64(56))))
            for (d, _), lo, hi in zip(wants, (ends - many).tolist(), ends.tolist(), strict=True):
                given[d] = edges[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        yield from found

    def _search(self, key: np.uint64, place: np.ndarray, lo: int, hi: int) -> Generator[int, tuple[np.ndarray, np.ndarray], list]:
        """Samples of the runs from lo to hi. Yields a run, and gets drawn paths of the runs from there on."""
        flat, k = self.lattices.flat, self.cfg.k
        if lo == hi:
            return [(np.zeros(0, np.int32), 0.0, 0.0, 1.0)]
        noise = lambda j, n: _uniform(key + (np.uint64(j + 1) << np.uint64(48)) + np.arange(n, dtype=np.uint64))
        path, firsts = yield lo
        found, sets = [], []
        value = float(_gumbel(noise(0, 1))[0])
        barred: dict[tuple[int, int], set[int]] = {}
        for j in range(k):
            steps = flat["logp"][path]
            before = np.cumsum(steps) - steps
            found.append((path, float(steps.sum()), value, firsts))
            if j == 0:
                begin, origin = 0, None
            # What is left of the set this path came from: at its first free edge other edges are barred too.
            # What the other edges of a place weigh together; a single edge's weight is 0.
            with np.errstate(divide="ignore"):
                left = np.log(-np.expm1(np.minimum(steps, 0.0)))
            left[:begin] = -np.inf
            if origin is not None:
                owner, t = origin
                taken = barred[origin] | {int(path[t])}
                rest = 1 - sum(np.exp(flat["logp"][e]) for e in taken)
                free = int(flat["edge_from"][self._node(path, place, lo, firsts, t) + 1] - flat["edge_from"][self._node(path, place, lo, firsts, t)])
                left[t] = np.log(rest) if free > len(taken) and rest > 1e-12 else -np.inf
                barred[j, t] = taken
            sets.append(_below(before + left, noise(j + 1, len(path)), value))
            best = [(float(v.max()), i) for i, v in enumerate(sets)]
            value, i = max(best)
            if not np.isfinite(value) or j + 1 == k:
                break
            t = int(sets[i].argmax())
            sets[i][t] = -np.inf
            owner_path, _, _, owner_firsts = found[i]
            taken = barred.get((i, t), {int(owner_path[t])})
            barred[j + 1, t] = taken
            origin, begin = (j + 1, t), t
            run = int(np.searchsorted(owner_firsts, t, "right")) - 1
            fresh = yield lo + run + 1
            path, firsts = self._detour(key, j + 1, owner_path, owner_firsts, t, taken, fresh, place, lo)
        out = []
        for path, logp, v, _ in found:
            inclusion = -np.expm1(-np.exp(min(logp - value, 50.0))) if np.isfinite(value) else 1.0
            out.append((self.lattices.codes(path), logp, v, float(inclusion)))
        return out

    def _node(self, path: np.ndarray, place: np.ndarray, lo: int, firsts: np.ndarray, t: int) -> int:
        """The lattice place where a path's edge t starts."""
        run = int(np.searchsorted(firsts, t, "right")) - 1
        return int(self.lattices.flat["begin"][place[lo + run]] if t == firsts[run] else self.lattices.flat["to"][path[t - 1]])

    def _detour(self, key, j, path, firsts, t, taken, fresh, place, lo):
        """The path up to edge t, another edge there, and drawn edges from then on, ``fresh`` behind its run."""
        flat, (rest, at) = self.lattices.flat, fresh
        run = int(np.searchsorted(firsts, t, "right")) - 1
        node = self._node(path, place, lo, firsts, t)
        options = [e for e in range(int(flat["edge_from"][node]), int(flat["edge_from"][node + 1])) if e not in taken]
        draws = iter(_uniform(key + (np.uint64(j) << np.uint64(40)) + (np.uint64(1) << np.uint64(62)) + np.arange(
            int(flat["end"][place[lo + run]] - node) + 1, dtype=np.uint64)))
        chances = np.exp(flat["logp"][options])
        edge = options[min(int(np.searchsorted(np.cumsum(chances), next(draws) * chances.sum(), "right")), len(options) - 1)]
        tail, stop = [edge], int(flat["end"][place[lo + run]])
        while (node := int(flat["to"][edge])) < stop:
            edge = int(self.lattices.next_edges(np.array([node]), np.array([next(draws)]))[0])
            tail.append(edge)
        new = np.concatenate([path[:t], np.array(tail, np.int64), rest])
        starts = np.concatenate([firsts[: run + 1], at + t + len(tail)])
        return new, starts

    def spells(self, ids: np.ndarray, chars: np.ndarray, text: str) -> bool:
        """Whether decoding the ids gives the text, whose characters ``marked`` has given."""
        own = self.lattices
        if SPACE in text or own.high[ids].any():
            return self.decode(ids) == text
        size = own.shown_size[ids]
        upto = np.cumsum(size, dtype=np.int32)
        if (upto[-1] if len(ids) else 0) != len(chars):
            return False
        shown = np.repeat(own.shown_from[ids] - (upto - size), size)
        shown += np.arange(len(chars), dtype=np.int32)
        return bool((own.shown_chars[shown] == chars).all())

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids; byte pieces are put together."""
        own = self.lattices
        if not len(ids):
            return ""
        if own.high[ids].any():
            byte = {i: bytes([b]) for b, i in own.bytes.items()}
            text = b"".join(byte.get(i) or own.pieces[i].encode() for i in ids.tolist()).decode("utf-8", "replace")
        else:
            size = own.shown_size[ids]
            upto = np.cumsum(size)
            chars = own.shown_chars[np.repeat(own.shown_from[ids] - (upto - size), size) + np.arange(upto[-1])]
            text = chars.tobytes().decode("utf-32-le")
        return text.replace(SPACE, " ")[1:]


_samplers: dict[tuple[Settings, str | None], Sampler] = {}

SAMPLES = "doc_id long, sample int, ids array<int>, logp double, value double, inclusion double, whole boolean"


def sampled(docs: DataFrame, cfg: Settings = Settings(), path: str | None = None) -> DataFrame:
    """``(doc_id, sample, ids, logp, value, inclusion, whole)``: k rows per document, or as many as it has paths.

    Noise depends on the doc_id and the seed only, so reruns agree, and rows that repeat a
    doc_id with the same text are sampled alike; rows without a doc_id draw as doc_id 0. Null
    and empty texts have one empty segmentation. ``whole`` says that decoding the ids gave the
    text back; only a text with the space mark itself, which stands for a space, does not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _samplers.setdefault((cfg, path), None) or Sampler(cfg, path)
        _samplers[cfg, path] = own
        # What earlier passes of this worker left in Arrow's pool goes back first.
        pa.default_memory_pool().release_unused()
        for batch in batches:
            at = 0
            keys = batch.column(0).fill_null(0).to_numpy()
            column = batch.column(1)
            few = (column.slice(i, 64).to_pylist() for i in range(0, len(column), 64))
            for texts in slices(chain.from_iterable(few), 1 << 19):
                who, number, ids, logp, value, inclusion, whole = [], [], [], [], [], [], []
                chars, bound = marked(texts)
                for d, samples in enumerate(own.sample(texts, keys[at : at + len(texts)])):
                    for s, (codes, p, v, q) in enumerate(samples):
                        who.append(at + d)
                        number.append(s)
                        ids.append(codes)
                        logp.append(p)
                        value.append(v)
                        inclusion.append(q)
                        whole.append(own.spells(codes, chars[bound[d] : bound[d + 1]], texts[d]))
                bounds = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(who, pa.int64())), pa.array(number, pa.int32()),
                     pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32())),
                     pa.array(logp, pa.float64()), pa.array(value, pa.float64()), pa.array(inclusion, pa.float64()),
                     pa.array(whole, pa.bool_())],
                    ["doc_id", "sample", "ids", "logp", "value", "inclusion", "whole"])
                at += len(texts)

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).transform(shipped).mapInArrow(run, SAMPLES)
