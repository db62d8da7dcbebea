"""SentencePiece encoding, decoding, and sampling of distinct segmentations without replacement.

Sampling is a perturbed A* search over the lattice of pieces. A segmentation's log-probability is
the sum of its pieces' weights, normalised; a backward pass over each chunk (text between spaces)
gives every edge its conditional probability. The best perturbed value of a subtree is a Gumbel
variable at the subtree's log-mass, and its best leaf is reached by drawing edges by probability.
So the search pops the largest bound, runs down to its leaf, and leaves one bound for all edges
beside its path together, truncated at the bound it came from; when that is popped in turn, one of
them is drawn by its mass. The first k leaves are a Gumbel top-k sample without replacement; the
next bound is the threshold for inclusion scores.
All documents of a batch run through each descent together.
"""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MASK, free_name, mix64, release_memory, without

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
#: Documents are searched together up to this many chunks (a longer document goes alone).
BATCH_CHUNKS = 25_000
#: Chunks whose lattices are built at once: what that takes besides is bounded.
BUILD_CHUNKS = 8_192


def load(model: bytes) -> sentencepiece.SentencePieceProcessor:
    sp = sentencepiece.SentencePieceProcessor()
    sp.LoadFromSerializedProto(model)
    return sp


def chunks_of(text: str) -> list[str]:
    """The text as the model sees it, cut before each run of spaces; each chunk without its first space.
    No piece goes across such a cut."""
    if "  " not in text and SPACE not in text and not text.startswith(" ") and not text.endswith(" "):
        return text.split(" ") if text else []
    return [c[1:] for c in _CHUNK.findall(SPACE + text.replace(" ", SPACE))]


class Numbers(dict):
    """Numbers things in the order in which they come."""

    def __missing__(self, x):
        n = self[x] = len(self)
        return n


def _bits(h: np.ndarray) -> np.ndarray:
    """16 bits of a hash of characters, also where that is small."""
    return ((h * _GOLD) >> np.uint64(48)).astype(np.int64)


def _utf8_size(code: np.ndarray) -> np.ndarray:
    """How many bytes characters take."""
    return 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)


class Lattices:
    """The piece lattices of chunks, kept while they are few: for each place, its edges with conditional
    probabilities."""

    #: Arrays over chunks, places and edges.
    PARTS = ("start", "codes", "rest", "ptr", "step", "piece", "logp", "cum")

    def __init__(self, sp: sentencepiece.SentencePieceProcessor, alpha: float):
        self.alpha = alpha
        by_length: dict[int, tuple[list, list]] = {}
        weights = np.full(sp.GetPieceSize(), -np.inf)
        self.byte = np.array([sp.PieceToId(f"<0x{b:02X}>") for b in range(256)], np.int64)
        for i in range(sp.GetPieceSize()):
            if sp.IsControl(i) or sp.IsUnknown(i) or sp.IsByte(i) or sp.IsUnused(i):
                continue
            piece = sp.IdToPiece(i)
            pieces, ids = by_length.setdefault(len(piece), ([], []))
            pieces.append(piece)
            ids.append(i)
        self.weights, self.tables = weights, {}
        self.longer = np.zeros((max(by_length) + 1, 1 << 16), bool)  # may be the start of a longer piece
        for length, (pieces, ids) in by_length.items():
            h, ids = np.zeros(len(ids), np.uint64), np.array(ids, np.int64)
            weights[ids] = -alpha * np.log(ids + 2.0)
            for n, c in enumerate(np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32).reshape(-1, length).T.astype(np.uint64), 1):
                h = h * _BASE + c + np.uint64(1)
                if n < length:
                    self.longer[n, _bits(h)] = True
            bits = _bits(h)
            o = np.argsort(bits, kind="stable")
            slot = np.full(1 << 16, -1, np.int32)  # the first of the pieces with such bits; most lookups end here
            one, first = np.unique(bits[o], return_index=True)
            slot[one] = first
            more = np.append(bits[o[1:]] == bits[o[:-1]], False)  # another piece with such bits follows
            self.tables[length] = h[o], ids[o], slot, more
        self.byte_weight = -alpha * np.log(sp.GetPieceSize() + 2.0)
        self.short = np.min_scalar_type(max(by_length))
        self.clear()

    def clear(self) -> None:
        """Forgets all chunks."""
        kinds = dict(start=np.int64, codes=np.uint32, rest=np.int32, ptr=np.int64, step=self.short, piece=np.int32)
        self.room = {name: np.zeros(int(name == "ptr"), kinds.get(name, np.float64)) for name in self.PARTS}
        for name in self.PARTS:
            setattr(self, name, self.room[name])

    def _append(self, name: str, fresh: np.ndarray) -> None:
        """To an array, which gets room for half as much again when it is full."""
        old, room = getattr(self, name), self.room[name]
        n = len(old) + len(fresh)
        if n > len(room):
            room = self.room[name] = np.empty(n + n // 2, old.dtype)
            room[: len(old)] = old
        room[len(old) : n] = fresh
        setattr(self, name, room[:n])

    def build(self, chunks: list[str]) -> None:
        """The lattices of these chunks alone."""
        self.clear()
        self.add(chunks)

    def add(self, chunks: list[str]) -> None:
        """Appends start (place of each chunk), codes, and the edges of all places in order."""
        for s in range(0, len(chunks), BUILD_CHUNKS):
            self._add(chunks[s : s + BUILD_CHUNKS])

    def _add(self, chunks: list[str]) -> None:
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(codes)
        rest = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)
        places, steps, pieces = [], [], []
        at, h = np.arange(n), np.zeros(n, np.uint64)
        lone = np.ones(n, bool)
        for length in range(1, max(self.tables) + 1):
            ok = rest[at] >= length
            at = at[ok]
            if not len(at):
                break
            h = h[ok] * _BASE + codes[at + length - 1] + np.uint64(1)
            bits = _bits(h)
            if length in self.tables:
                table, ids, slot, more = self.tables[length]
                k = slot[bits]
                some = np.flatnonzero(k >= 0)
                k, sought = k[some], h[some]
                hit = table[k] == sought
                miss = np.flatnonzero(~hit)
                while len(miss := miss[more[k[miss]]]):
                    k[miss] += 1
                    hit[miss] = table[k[miss]] == sought[miss]
                    miss = miss[~hit[miss]]
                hit = np.flatnonzero(hit)
                found = at[some[hit]]
                places.append(found)
                steps.append(length)
                pieces.append(ids[k[hit]])
                if length == 1:
                    lone[found] = False
            on = self.longer[length][bits]
            at, h = at[on], h[on]
        bare = np.flatnonzero(lone)  # characters that the model spells in bytes
        places.append(bare)
        steps.append(1)
        pieces.append(-1)
        count = np.zeros(n, np.int64)
        for x in places:  # no place comes twice in one of them
            count[x] += 1
        ptr = np.concatenate([[0], np.cumsum(count)])
        step, piece = np.empty(ptr[-1], self.short), np.empty(ptr[-1], np.int32)
        free = ptr[:-1].copy()
        for x, length, ids in zip(places, steps, pieces, strict=True):
            e = free[x]
            step[e], piece[e] = length, ids
            free[x] = e + 1
        w = self.weights[piece]
        w[ptr[bare + 1] - 1] = self.byte_weight * _utf8_size(codes[bare])  # a place's last edge, if it has one of these
        back = np.argsort(rest.astype(np.uint16) if rest.max() < 1 << 16 else rest, kind="stable")  # from the chunks' ends backward
        size, level = count[back], rest[back]
        edges = _runs(ptr[back], size)
        mass = np.zeros(n + 1)
        to, v = step[edges], w[edges]
        to = np.where(to == np.repeat(level, size), n, np.repeat(back, size) + to)  # the chunk's end, whose mass is 0
        head = np.cumsum(size) - size
        cut = np.concatenate([[0], np.flatnonzero(np.diff(level)) + 1, [n]])
        for a, b, s, e in zip(cut[:-1], cut[1:], head[cut[:-1]], np.append(head[cut[1:-1]], len(v)), strict=True):
            v[s:e] += mass[to[s:e]]
            top = np.maximum.reduceat(v[s:e], head[a:b] - s)
            mass[back[a:b]] = top + np.log(np.add.reduceat(np.exp(v[s:e] - np.repeat(top, size[a:b])), head[a:b] - s))
        logp = np.empty(len(v))
        logp[edges] = np.minimum(v - np.repeat(mass[back], size), 0.0)
        prob = np.exp(logp)
        run = np.cumsum(prob)
        cum = run - np.repeat(np.concatenate([[0.0], run])[ptr[:-1]], count)
        cum[ptr[1:] - 1] = 2.0  # the last edge takes the rest
        before = len(self.codes), len(self.step)
        fresh = dict(start=np.cumsum(lengths) - lengths + before[0], codes=codes, rest=rest, ptr=ptr[1:] + before[1], step=step, piece=piece, logp=logp, cum=cum)
        for name in self.PARTS:
            self._append(name, fresh[name])

    def keep(self, chunks: np.ndarray) -> None:
        """Forgets all chunks but these, in one array after another, each without room to spare."""
        size = self.rest[self.start[chunks]].astype(np.int64)
        at = _runs(self.start[chunks], size)
        edges = self.ptr[at + 1] - self.ptr[at]
        e = _runs(self.ptr[at], edges)
        for name, of in (("step", e), ("piece", e), ("logp", e), ("cum", e), ("codes", at), ("rest", at)):
            self.room[name] = getattr(self, name)[of]
            setattr(self, name, self.room[name])
        self.start = self.room["start"] = np.cumsum(size) - size
        self.ptr = self.room["ptr"] = np.concatenate([[0], np.cumsum(edges)])

    def draw(self, place: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge from each place, by probability."""
        e = self.ptr[place]
        todo = np.flatnonzero(u >= self.cum[e])
        while len(todo):
            e[todo] += 1
            todo = todo[u[todo] >= self.cum[e[todo]]]
        return e

    def ids(self, edges: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece ids along edges, characters without a piece as their bytes; where each edge's begin, and the end."""
        ids = self.piece[edges]
        bare = ids < 0
        if not bare.any():
            return ids, np.arange(len(ids) + 1)
        code = self.codes[places[bare]]
        size = np.ones(len(ids), np.int64)
        size[bare] = _utf8_size(code)
        out = np.repeat(ids, size)
        out[out < 0] = self.byte[np.frombuffer(code.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)]
        return out, np.concatenate([[0], np.cumsum(size)])


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``size`` numbers from each of ``first``, in a row."""
    out = np.repeat(first - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return out


def _unit(bits: np.ndarray) -> np.ndarray:
    """In (0, 1), from 64 bits."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _uniform(seed: np.ndarray, counter: int) -> np.ndarray:
    """From the document's seed and a counter: no state, so that a rerun repeats it."""
    with np.errstate(over="ignore"):
        return _unit(mix64(seed + np.uint64((counter + 1) * int(_GOLD) & MASK)))


def _below(mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel variable at log-mass ``mass``, truncated at ``bound``."""
    g = mass - np.log(-np.log(u))
    return bound - np.logaddexp(0.0, bound - g)


class Descent:
    """One run of some documents down to leaves: the edges taken, and what was left beside them."""

    def __init__(self, lat: Lattices, chunks: np.ndarray, count: np.ndarray, keys: np.ndarray, phi: np.ndarray, place: np.ndarray, edge: np.ndarray):
        """chunks: of all documents, from the one where each begins; count: chunks of each; keys: a seed
        for each chunk; phi, place, edge: log-mass, place and first edge (or -1) to begin with."""
        head = np.cumsum(count) - count
        at, left = lat.start[chunks], lat.rest[lat.start[chunks]].astype(np.int64)
        end = at + left
        at[head] = place
        run, steps = np.zeros(len(chunks)), np.zeros(len(chunks), np.int64)
        keep, alive, p, inside, step = [], np.arange(len(chunks)), at, np.zeros(len(chunks)), 0
        must = edge >= 0
        while len(alive):
            bits = keys if step == 0 else mix64(keys[alive] + np.uint64(step * int(_GOLD) & MASK))
            e = lat.draw(p, _unit(bits))
            if step == 0:
                e[head[must]] = edge[must]
            gain = lat.logp[e]
            if step == 0:
                gain[head[must]] = 0.0  # part of phi already
            keep.append((alive, p, e, inside, gain))
            p, inside = p + lat.step[e], inside + gain
            step += 1
            on = p < end
            over, on = np.flatnonzero(~on), np.flatnonzero(on)
            run[alive[over]], steps[alive[over]] = inside[over], step
            alive, p, inside, end = alive[on], p[on], inside[on], end[on]
        first = np.cumsum(steps) - steps
        n = int(steps.sum())
        self.p, self.e, self.prefix, took = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n), np.empty(n)
        for step, (alive, p, e, inside, gain) in enumerate(keep):
            x = first[alive] + step
            self.p[x], self.e[x], self.prefix[x], took[x] = p, e, inside, gain
        before = np.cumsum(run) - run
        before += np.repeat(phi - before[head], count)
        self.prefix += np.repeat(before, steps)
        self.total = before[head + count - 1] + run[head + count - 1]
        self.first, self.lo = first, first[head]
        self.hi = np.append(self.lo[1:], n)
        with np.errstate(divide="ignore"):
            mass = self.prefix + np.log(-np.expm1(took))  # of the edges not taken; none beside a lone one
        mass[self.lo[must]] = -np.inf  # what is left there stays with the descent it came from
        top = np.maximum.reduceat(mass, self.lo)
        self.top = np.where(np.isfinite(top), top, 0.0)
        self.weight = np.exp(mass - np.repeat(self.top, self.hi - self.lo))
        with np.errstate(divide="ignore"):
            self.mass = self.top + np.log(np.add.reduceat(self.weight, self.lo))

    def pick(self, lat: Lattices, i: int, taken: list, u: float, v: float) -> tuple[int, int, float, float]:
        """Of document i's edges beside its path, without those ``taken``, one by probability: (record,
        edge, its log-mass, the log-mass of the rest)."""
        lo, hi = int(self.lo[i]), int(self.hi[i])
        w = self.weight[lo:hi].copy()
        for r in {r for r, _ in taken}:
            edges = self._beside(lat, r, taken)
            w[r - lo] = np.exp(self.prefix[r] - self.top[i]) * np.exp(lat.logp[edges]).sum()
        cum = np.cumsum(w)
        r = int(np.searchsorted(cum, u * cum[-1], side="right"))
        r = lo + (r if r < len(w) else int(np.flatnonzero(w)[-1]))
        edges = self._beside(lat, r, taken)
        q = np.exp(lat.logp[edges])
        k = int(min(np.searchsorted(np.cumsum(q), v * q.sum(), side="right"), len(q) - 1))
        rest = w.sum() - w[r - lo] + np.exp(self.prefix[r] - self.top[i]) * np.delete(q, k).sum()
        return r, int(edges[k]), float(self.prefix[r] + lat.logp[edges[k]]), float(self.top[i] + np.log(rest)) if rest > 0 else -np.inf

    def _beside(self, lat: Lattices, r: int, taken: list) -> np.ndarray:
        edges = np.arange(lat.ptr[self.p[r]], lat.ptr[self.p[r] + 1])
        gone = [e for x, e in taken if x == r]
        return edges[(edges != self.e[r]) & ~np.isin(edges, gone)] if gone else edges[edges != self.e[r]]


def sample_segmentations(lat: Lattices, docs: list[np.ndarray], seeds: np.ndarray, k: int) -> list[list[tuple[float, float, np.ndarray]]]:
    """For each document (an array of chunk numbers), up to k distinct segmentations as (log-
    probability, log of the inclusion score, piece ids), the largest perturbed value first."""
    m = len(docs)
    sizes = np.array([len(d) for d in docs], np.int64)
    first = np.cumsum(sizes) - sizes
    chunk = np.concatenate(docs) if m else np.empty(0, np.int64)
    active = np.flatnonzero(sizes > 0)
    bound = -np.log(-np.log(_uniform(seeds, 0)))
    phi, skip, place = np.zeros(m), np.zeros(m, np.int64), np.zeros(m, np.int64)  # where a descent begins
    place[active] = lat.start[chunk[first[active]]]
    edge = np.full(m, -1, np.int64)  # the edge that a branch begins with
    head: list[np.ndarray] = [np.empty(0, np.int64)] * m  # the ids before it
    history: list[tuple[Descent, np.ndarray, list, np.ndarray, np.ndarray]] = []
    pool: list[list] = [[] for _ in range(m)]  # (bound, turn, number in it, edges taken): what is left beside a path
    out: list[list] = [[] for _ in range(m)]
    for turn in range(k):
        if not len(active):
            break
        count = sizes[active] - skip[active]
        number = np.arange(int(count.sum())) + np.repeat(skip[active] - (np.cumsum(count) - count), count)
        keys = mix64(np.repeat(seeds[active] + np.uint64((turn + 1) * int(_BASE)), count) + (number.astype(np.uint64) + np.uint64(2)) * _GOLD)
        run = Descent(lat, chunk[np.repeat(first[active], count) + number], count, keys, phi[active], place[active], edge[active])
        best = _below(run.mass, bound[active], _uniform(seeds[active], 1000 * turn + 17))
        ids, begin = lat.ids(run.e, run.p)
        history.append((run, number, [head[a] for a in active], ids, begin))
        for i, (a, lo, hi) in enumerate(zip(active, begin[run.lo].tolist(), begin[run.hi].tolist(), strict=True)):
            own = ids[lo:hi]
            out[a].append((run.total[i], np.concatenate([head[a], own]) if len(head[a]) else own))
            if best[i] > -np.inf:
                pool[a].append((best[i], turn, i, []))
            pool[a].sort(key=lambda x: x[0])
        if turn + 1 == k:
            break
        active = np.array([a for a in active if pool[a]], np.int64)
        draws = np.stack([_uniform(seeds[active], 1000 * turn + x) for x in (101, 102, 103)], axis=1)
        left = []
        for a, (u, w, _) in zip(active, draws.tolist(), strict=True):
            v, t, i, taken = pool[a].pop()
            run, number, heads, ids, begin = history[t]
            r, edge[a], phi[a], rest = run.pick(lat, i, taken, u, w)
            bound[a], place[a] = v, run.p[r]
            skip[a] = number[np.searchsorted(run.first, r, side="right") - 1]
            before = ids[begin[run.lo[i]] : begin[r]]
            head[a] = np.concatenate([heads[i], before]) if len(heads[i]) else before
            left.append((rest, v, t, i, [*taken, (r, edge[a])]))
        rest, v = (np.array([x[c] for x in left]) for c in range(2))
        ok = rest > -np.inf
        below = np.full(len(left), -np.inf)
        below[ok] = _below(rest[ok], v[ok], draws[ok, 2])
        for a, x, (rest, _, t, i, taken) in zip(active, below.tolist(), left, strict=True):
            if rest > -np.inf:
                pool[a].append((x, t, i, taken))
    done = []
    for a in range(m):
        kappa = max((x[0] for x in pool[a]), default=-np.inf)
        done.append([(lp, _log_inclusion(lp - kappa) if kappa > -np.inf else 0.0, ids) for lp, ids in out[a]])
    return done


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x))): the chance of a perturbed value over the threshold; for a long text it
    is far below what a double holds, so that it is kept as a logarithm."""
    return x if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 50.0)))))


#: Chunks kept between batches; beyond, those seen once are forgotten, and of the others all but the most
#: frequent, so that half of the room is free.
MOST_CHUNKS = 250_000


class Coder:
    """Encodes and samples batches of texts; remembers chunks, up to a bound, with their pieces and lattices."""

    def __init__(self, model: bytes, alpha: float, k: int):
        self.sp, self.k = load(model), k
        self.lat = Lattices(self.sp, alpha)
        self.lone = [self.sp.PieceToId(SPACE)]  # a space at a text's end
        self.number, self.pieces, self.begin, self.seen = Numbers(), np.empty(0, np.int32), np.zeros(1, np.int64), np.empty(0, np.int64)

    def forget(self) -> None:
        often = np.argsort(-self.seen, kind="stable")[: MOST_CHUNKS // 2]
        often = np.sort(often[self.seen[often] > 1])
        names, size = [*self.number], np.diff(self.begin)[often]
        self.number = Numbers(zip([names[i] for i in often], range(len(often)), strict=True))
        self.pieces, self.begin, self.seen = self.pieces[_runs(self.begin[often], size)], np.concatenate([[0], np.cumsum(size)]), self.seen[often]
        self.lat.keep(often)

    def run(self, texts: list, keys: np.ndarray):
        """For each text: number of pieces, their crc32, whether all of them decode to it, the samples (with
        their pieces), the pieces."""
        if len(self.number) > MOST_CHUNKS:
            self.forget()
        known = len(self.number)
        lists = [np.fromiter(map(self.number.__getitem__, c), np.int64, len(c)) for c in (chunks_of(t or "") for t in texts)]
        fresh = [*itertools.islice(reversed(self.number), len(self.number) - known)][::-1]
        plain = [c.replace(SPACE, " ") for c in fresh]
        coded = self.sp.encode(plain, num_threads=1) if fresh else []
        if "" in plain:
            coded[plain.index("")] = self.lone
        self.pieces = np.concatenate([self.pieces, np.fromiter(itertools.chain.from_iterable(coded), np.int32)])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))])
        self.lat.add([SPACE + c for c in fresh])
        self.seen = np.append(self.seen, np.zeros(len(fresh), np.int64)) + np.bincount(np.concatenate([np.empty(0, np.int64), *lists]), minlength=len(self.number))
        with np.errstate(over="ignore"):
            seeds = mix64(keys.view(np.uint64) ^ np.array([xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass")) for t in texts], np.uint64))
            sampled = sample_segmentations(self.lat, lists, seeds, self.k)
        for t, c, s in zip(texts, lists, sampled, strict=True):
            size = self.begin[c + 1] - self.begin[c]
            ids = self.pieces[_runs(self.begin[c], size)] if len(c) else np.empty(0, np.int32)
            if t and SPACE in t:  # the model tells the character from a space, the chunks do not
                ids = np.array(self.sp.encode(t), np.int32)
            same = self.sp.decode(ids) == t if t else True
            yield len(ids), zlib.crc32(ids.tobytes()), same, [{"n_pieces": len(x), "log_prob": lp, "inclusion": np.exp(inc), "log_inclusion": inc, "crc32": zlib.crc32(x.tobytes()), "ids": x} for lp, inc, x in ((*y[:2], y[2].astype(np.int32)) for y in s)], ids


def encode_and_sample(docs: DataFrame, k: int = 2, alpha: float = 1.0, model_path: str = MODEL, key_cols: tuple = ("doc_id",), text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The columns of ``docs`` with _n_pieces, _pieces_crc32 (of the ids as 32-bit little-endian
    numbers), _round_trip (the ids decode to the text), _samples (array of n_pieces, log_prob,
    inclusion, log_inclusion, crc32), and, if asked for, _ids and in each sample its ids. Every text's whole
    ids are decoded and compared with it. An input column of such a name gives way.

    The model's file is read by the driver and its bytes (under 1 MB) go with the code. Null and
    empty texts have no pieces and no samples; a text with fewer segmentations than k has all of
    them, with inclusion 1; rows with equal keys and texts sample alike, and a null key is a key of
    its own. U+2581 in a text decodes to a space, so that such a text has no round trip. An empty
    table gives no rows.
    """
    model = open(model_path, "rb").read()
    sample = [T.StructField("n_pieces", T.IntegerType()), T.StructField("log_prob", T.DoubleType()), T.StructField("inclusion", T.DoubleType()), T.StructField("log_inclusion", T.DoubleType()), T.StructField("crc32", T.LongType())]
    sample = T.StructType(sample + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)
    extra = [T.StructField("_n_pieces", T.LongType()), T.StructField("_pieces_crc32", T.LongType()), T.StructField("_round_trip", T.BooleanType()), T.StructField("_samples", T.ArrayType(sample))]
    extra += [T.StructField("_ids", T.ArrayType(T.IntegerType()))] * with_ids
    docs = without(docs, [f.name for f in extra])
    at = docs.columns.index(text_col)
    keyed = docs.withColumn(free_name(docs.columns, "_key"), F.xxhash64(*key_cols))
    arrow = pa.list_(pa.struct([("n_pieces", pa.int32()), ("log_prob", pa.float64()), ("inclusion", pa.float64()), ("log_inclusion", pa.float64()), ("crc32", pa.int64()), *[("ids", pa.list_(pa.int32()))] * with_ids]))

    def run(batches):
        coder = Coder(model, alpha, k)
        for batch in batches:
            texts, keys = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_numpy()
            s = 0
            while s < len(texts):
                e, size = s, 0
                while e < len(texts) and (e == s or size + (texts[e] or "").count(" ") < BATCH_CHUNKS):
                    size += (texts[e] or "").count(" ") + 1
                    e += 1
                n, crc, same, samples, ids = zip(*coder.run(texts[s:e], keys[s:e]), strict=True)
                arrays = [c.slice(s, e - s) for c in batch.columns[:-1]]
                arrays += [pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_()), pa.array(samples, arrow)]
                if with_ids:
                    arrays.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], *[f.name for f in extra]])
                s = e
                del arrays, n, crc, same, samples, ids
            del batch, texts, keys
            release_memory()
        del coder
        release_memory()  # the worker waits for its next task

    return keyed.mapInArrow(run, T.StructType([*docs.schema.fields, *extra]))


def decode_pieces(coded: DataFrame, ids_col: str = "_ids", model_path: str = MODEL) -> DataFrame:
    """Adds _text (an input column of that name gives way), decoded from an array of piece ids; null
    ids stay null; an empty table gives no rows."""
    model = open(model_path, "rb").read()
    coded = without(coded, ["_text"])
    at = coded.columns.index(ids_col)

    def run(batches):
        sp = load(model)
        for batch in batches:
            text = [None if x is None else sp.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, "_text"])

    return coded.mapInArrow(run, T.StructType([*coded.schema.fields, T.StructField("_text", T.StringType())]))
