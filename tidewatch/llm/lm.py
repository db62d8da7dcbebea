"""LM scoring with Elias-Fano n-gram tries of order three, in shards.

Documents are packed, once, into chunks of coded tokens. Words are counted and numbered by shards of
their hash, the frequent ones first, so that n-grams are exact and short. A chunk then sends its
distinct bigrams and trigrams, nested as in a trie and with their training counts, to the shard of their
first word (a frequent first word has several, by the second word). The shard adds the counts of all
chunks up, builds its trie in memory-mapped files, looks the chunks' n-grams up, and answers with
quantised probabilities and weights, from which a chunk scores its documents. Texts, chunks and n-grams
are moved once each.

Each context gives its types a share of its weight (Witten-Bell): with T the number of types after it,
P(c|a,b) = (n(abc) + T(ab) P(c|b)) / (n(ab) + T(ab)), P(c|b) = (n(bc) + T(b) P(c)) / (n(b) + T(b)),
P(c) = (n(c) + 1) / (N + V + 1); in an unseen context the shorter one's P stands. Nothing but a context's own counts
enters, so that all n-grams are counted in full by the one pass that builds the tries. Every context's total is exactly
1, before first terms and weights are rounded down to 1/4096 of a digit. A document's first word is scored by its bigram
with the start. Shards that share a first word each know a part of T(b): the chunk adds the parts up.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, bucketed, discard, durable, lower_words, partitions, release_memory

END = np.uint64(0x9D3F0C1B5A77E621)
#: Quantised log10 probabilities: 1/4096 of a digit; NONE stands for probability 0.
UNIT, NONE = 4096.0, 65535
#: Tokens of a chunk (a longer document is one by itself), and of a shard, if there are not more partitions.
CHUNK_TOKENS, SHARD_TOKENS = 700_000, 16_000_000


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(range / n) bits a value; on disk, memory-mapped.

    The low bits are packed; the high bits are a unary bitmap. Every ``BLOCK`` values, the bitmap's
    place and the value are kept, so that a block is decoded, or searched, by itself.
    """

    BLOCK = 4096

    def __init__(self, values: np.ndarray, folder: str, name: str):
        values = np.asarray(values, np.uint64)
        n = self.n = len(values)
        span = int(values[-1]) if n else 0
        low = self.low = max(0, (span // max(1, n)).bit_length() - 1)
        high = values >> np.uint64(low)
        bits = high.astype(np.int64) + np.arange(n)
        bitmap = np.zeros((int(bits[-1]) if n else 0) // 8 + 1, np.uint8)
        np.bitwise_or.at(bitmap, bits >> 3, np.uint8(128) >> (bits & 7).astype(np.uint8))
        self.at = np.append(bits[:: self.BLOCK], int(bits[-1]) + 1 if n else 0)
        self.first = values[:: self.BLOCK].copy()
        self.path = os.path.join(folder, name)
        with open(self.path, "wb") as f:
            f.write(bitmap.tobytes())
            self.split = f.tell()
            for s in range(0, n, self.BLOCK):  # each block's low bits begin at a byte
                v = values[s : s + self.BLOCK]
                shifts = np.arange(low, dtype=np.uint64)
                f.write(np.packbits((v[:, None] >> shifts & np.uint64(1)).astype(np.uint8).ravel()).tobytes())
        self.map = np.memmap(self.path, np.uint8, "r")
        self.width = (self.BLOCK * low + 7) // 8

    def block(self, k: int) -> np.ndarray:
        """The k-th block's values."""
        s, e = int(self.at[k]), int(self.at[k + 1])
        n = min(self.BLOCK, self.n - k * self.BLOCK)
        bits = np.unpackbits(self.map[s >> 3 : (e >> 3) + 1])
        ones = np.flatnonzero(bits) + (s >> 3) * 8
        ones = ones[ones >= s][:n]
        out = (ones - (k * self.BLOCK + np.arange(n))).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            raw = self.map[self.split + k * self.width :][: (n * self.low + 7) // 8]
            low = np.unpackbits(raw)[: n * self.low].reshape(n, self.low).astype(np.uint64)
            out |= low @ (np.uint64(1) << np.arange(self.low, dtype=np.uint64))
        return out

    def take(self, i: np.ndarray) -> np.ndarray:
        """The values at ascending places."""
        out = np.empty(len(i), np.uint64)
        block = i // self.BLOCK
        cut = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(i)]]) if len(i) else [0]
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            out[s:e] = self.block(int(block[s]))[i[s:e] % self.BLOCK]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of the first value not below each of the ascending keys."""
        out = np.empty(len(keys), np.int64)
        block = np.maximum(np.searchsorted(self.first, keys, side="left") - 1, 0) if self.n else np.zeros(len(keys), np.int64)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(keys)]]) if len(keys) else [0]
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            k = int(block[s])
            out[s:e] = k * self.BLOCK + np.searchsorted(self.block(k), keys[s:e]) if self.n else 0
        return out


def _quantised(p: np.ndarray) -> np.ndarray:
    """-log10 of probabilities in units, so rounded that none grows; 0 becomes NONE."""
    with np.errstate(divide="ignore"):
        q = np.ceil(-np.log10(p) * UNIT)
    return np.where(p > 0, np.clip(q, 0, NONE - 1), NONE).astype(np.uint16)


def _opened(q: np.ndarray) -> np.ndarray:
    return np.where(q == NONE, 0.0, 10.0 ** (q.astype(float) / -UNIT))


def _narrow(x: np.ndarray) -> np.ndarray:
    """In the least unsigned type that holds it."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers, each with its length and width, their bytes by place."""
    out = []
    for x in map(_narrow, arrays):
        out += [np.array([len(x), x.itemsize], np.int64).tobytes(), x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        n, width = np.frombuffer(raw, np.int64, 2, at)
        at += 16
        x = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        out.append(np.ascontiguousarray(x).view(f"u{width}").ravel().astype(np.int64 if width < 8 else np.uint64))
        at += n * width
    return out


class Grams:
    """Bigrams and trigrams, nested: first words a (ascending) with their counts, size_b second words b
    of each with counts, size_c third words c of each of these with counts."""

    def __init__(self, a, n_a, size_b, b, size_c, c, n_b=None, n_c=None):
        self.a, self.n_a, self.size_b, self.b, self.size_c, self.c, self.n_b, self.n_c = a, n_a, size_b, b, size_c, c, n_b, n_c

    def packed(self) -> bytes:
        return _pack(*(x for x in self.__dict__.values() if x is not None))

    @staticmethod
    def union(parts: list[Grams]) -> tuple[Grams, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All n-grams of the parts, each once, with summed counts; and where each part's own are among
        them (first words, bigrams, trigrams, part after part)."""
        join = lambda f: np.concatenate([f(g) for g in parts])
        heads, of1 = np.unique(join(lambda g: g.a), return_inverse=True)
        n_a = np.zeros(len(heads), np.int64)
        n_a[of1] = join(lambda g: g.n_a)
        two, of2 = np.unique((join(lambda g: np.repeat(g.a, g.size_b)) << 32) | join(lambda g: g.b), return_inverse=True)
        three, of3 = np.unique((np.repeat(of2, join(lambda g: g.size_c)) << 32) | join(lambda g: g.c), return_inverse=True)
        n_b, n_c = (np.bincount(of, weights=n, minlength=m).astype(np.int64) for of, n, m in ((of2, join(lambda g: g.n_b), len(two)), (of3, join(lambda g: g.n_c), len(three))))
        size_b = np.bincount(np.searchsorted(heads, two >> 32), minlength=len(heads))
        size_c = np.bincount(three >> 32, minlength=len(two))
        return Grams(heads, n_a, size_b, two & 0xFFFFFFFF, size_c, three & 0xFFFFFFFF, n_b, n_c), (of1, of2, of3)

    def learnt(self) -> Grams:
        """Those that training has; a trigram's bigram is then among them."""
        b, c = self.n_b > 0, self.n_c > 0
        size_b = np.bincount(np.repeat(np.arange(len(self.a)), self.size_b)[b], minlength=len(self.a))
        size_c = np.bincount(np.repeat(np.arange(len(self.b)), self.size_c)[c], minlength=len(self.b))
        a = size_b > 0
        return Grams(self.a[a], self.n_a[a], size_b[a], self.b[b], size_c[b], self.c[c], self.n_b[b], self.n_c[c])


class Trie:
    """Three levels: first words, under each its second words, under each of these its third words.

    A word of level two or three is its rank among the level's distinct words; the level holds
    (place of the parent * size of that vocabulary + rank), which ascends, so that a parent's
    successors are a range of it and a search stays in that range. Pointers to the ranges ascend too.
    """

    def __init__(self, grams: Grams, folder: str):
        """A first word that several shards share comes with its count in all, and has here the types of this shard."""
        self.heads = EliasFano(grams.a, folder, "heads")
        self.seconds, self.words2, self.ends2 = self._level(grams.b, grams.size_b, folder, "2")
        self.thirds, self.words3, self.ends3 = self._level(grams.c, grams.size_c, folder, "3")
        ends = np.append(0, np.cumsum(grams.size_b))
        total = np.where(grams.n_a > 0, grams.n_a, np.diff(np.append(0, np.cumsum(grams.n_b))[ends]))
        total = np.maximum(total, 1)
        levels = {
            "g1": _quantised(grams.size_b / (total + grams.size_b)),
            "p2": _quantised(grams.n_b / np.repeat(total + grams.size_b, grams.size_b)),
            "g2": _quantised(np.where(grams.size_c > 0, grams.size_c / (grams.n_b + grams.size_c), 1.0)),
            "p3": _quantised(grams.n_c / np.repeat(grams.n_b + grams.size_c, grams.size_c)),
        }
        for name, x in levels.items():
            path = os.path.join(folder, name)
            x.tofile(path)
            setattr(self, name, np.memmap(path, x.dtype, "r") if len(x) else x)

    @staticmethod
    def _level(words: np.ndarray, size: np.ndarray, folder: str, name: str) -> tuple[EliasFano, EliasFano, EliasFano]:
        vocabulary, rank = np.unique(words, return_inverse=True)
        parent = np.repeat(np.arange(len(size)), size).astype(np.uint64)
        return (
            EliasFano(parent * np.uint64(max(1, len(vocabulary))) + rank.astype(np.uint64), folder, "level" + name),
            EliasFano(vocabulary, folder, "words" + name),
            EliasFano(np.append(0, np.cumsum(size)), folder, "ends" + name),
        )

    @staticmethod
    def _place(level: EliasFano, keys: np.ndarray) -> np.ndarray:
        """The place of each ascending key, or -1."""
        at = level.find(keys)
        ok = at < level.n
        there = level.take(at[ok])
        out = np.full(len(keys), -1, np.int64)
        out[ok] = np.where(there == keys[ok], at[ok], -1)
        return out

    def _under(self, level: EliasFano, words: EliasFano, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The place of each word under its parent's place, or -1."""
        distinct, which = np.unique(word, return_inverse=True)
        rank = self._place(words, distinct)[which]
        out = np.full(len(word), -1, np.int64)
        both = np.flatnonzero((parent >= 0) & (rank >= 0))
        key = parent[both].astype(np.uint64) * np.uint64(max(1, words.n)) + rank[both].astype(np.uint64)
        o = np.argsort(key, kind="stable")
        out[both[o]] = self._place(level, key[o])
        return out

    def look_up(self, asked: Grams) -> tuple[np.ndarray, ...]:
        """For the n-grams asked for: g of first words, p and g of bigrams, p of trigrams, quantised."""
        first = self._place(self.heads, asked.a)
        second = self._under(self.seconds, self.words2, np.repeat(first, asked.size_b), asked.b)
        third = self._under(self.thirds, self.words3, np.repeat(second, asked.size_c), asked.c)

        def of(values, at, none):
            out = np.full(len(at), none, np.uint16)
            out[at >= 0] = values[at[at >= 0]]
            return out

        return of(self.g1, first, NONE), of(self.p2, second, NONE), of(self.g2, second, 0), of(self.p3, third, NONE)


def _chunk_rows(batches: Iterator):
    """Packs documents, in the order in which they come, into rows of about ``CHUNK_TOKENS`` tokens:
    their ids, and learnt or not, sizes, the distinct word hashes and each token's number among them."""
    from pyspark import TaskContext

    context = TaskContext.get()
    part = context.partitionId() if context else 0
    hashes, number = WordHashes(), 0
    ids, learn, tokens, size = [], [], [], 0

    def row(kind):
        words, at = np.unique(np.concatenate(tokens), return_inverse=True)
        blob = _pack(np.array(learn, np.uint8), np.array([len(t) for t in tokens]), words, at)
        return pa.RecordBatch.from_arrays([pa.array([(part << 24) + number], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([blob], pa.binary())], names=["chunk", "ids", "blob"])

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for i, held, text in zip(*(batch.column(x).to_pylist() for x in range(3)), strict=True):
            ids.append(i)
            learn.append(not held)
            tokens.append(np.append(hashes.of(lower_words(text)), END))
            size += len(tokens[-1])
            if size >= CHUNK_TOKENS:
                yield row(kind)
                number += 1
                ids, learn, tokens, size = [], [], [], 0
    if ids:
        yield row(kind)


class Chunk:
    """A chunk's tokens and words; then, with the words' counts and numbers, its n-grams in the order of shards."""

    def __init__(self, blob: bytes, shards: int = 0):
        learn, self.sizes, self.words, self.token, *told = _unpack(blob)
        self.learn = learn.astype(bool)
        if told:  # numbered: of the words' hashes only the end's place is kept
            self.count, self.id = told
        else:
            self.words = self.words.astype(np.uint64)
            shard = (self.words % np.uint64(shards)).astype(np.int64)
            self.order = np.argsort(shard, kind="stable")
            self.cut = np.searchsorted(shard[self.order], np.arange(shards + 1))

    def numbered(self, answers) -> bytes:
        """The chunk with the counts and numbers of its words, from the shards' answers."""
        count, number = (np.zeros(len(self.words), np.int64) for _ in range(2))
        for s, blob in answers:
            of = self.order[self.cut[s] : self.cut[s + 1]]
            count[of], number[of] = _unpack(blob)
        return _pack(self.learn.astype(np.uint8), self.sizes, np.searchsorted(self.words, [END]), self.token, count, number)

    def grams(self, shards: int, train: int) -> None:
        """Sets the distinct n-grams of the chunk, with how often the documents to learn from have them."""
        token = self.token
        start = len(self.count)  # the start is a first word only; its number is 0
        ids, total = np.append(self.id, 0), np.append(self.count, self.count[self.words[0]])  # as many starts as ends
        before = np.empty_like(token)
        before[1:] = token[:-1]
        self.first = np.cumsum(self.sizes) - self.sizes
        before[self.first] = start
        learn = np.repeat(self.learn, self.sizes)
        by_id = np.argsort(ids, kind="stable")
        rank = np.empty(start + 1, np.int64)
        rank[by_id] = np.arange(start + 1)
        code, of = np.unique(rank[before] * (start + 1) + rank[token], return_inverse=True)
        head, tail = by_id[code // (start + 1)], by_id[code % (start + 1)]
        # a first word with more than a quarter of a shard's tokens has several shards
        ways = np.minimum(shards, 1 + 4 * shards * total // max(1, train))
        shard = (ids[head] + ids[tail] % ways[head]) % shards
        o = np.argsort(shard, kind="stable")
        place = np.empty(len(o), np.int64)
        place[o] = np.arange(len(o))
        self.of2, self.head, self.tail = place[of], head[o], tail[o]
        self.n2 = np.bincount(self.of2, weights=learn, minlength=len(o)).astype(np.int64)
        self.cut2 = np.searchsorted(shard[o], np.arange(shards + 1))
        inner = np.ones(len(token), bool)
        inner[self.first] = False
        self.inner = np.flatnonzero(inner)  # tokens with two words before them, the start among these
        code, self.of3 = np.unique(self.of2[self.inner - 1] * (start + 1) + rank[token[self.inner]], return_inverse=True)
        self.n3 = np.bincount(self.of3, weights=learn[self.inner], minlength=len(code)).astype(np.int64)
        self.size_c = np.bincount(code // (start + 1), minlength=len(o))
        self.third = by_id[code % (start + 1)]
        self.cut3 = np.append(0, np.cumsum(self.size_c))[self.cut2]
        fresh = np.ones(len(o), bool)
        fresh[1:] = (self.head[1:] != self.head[:-1]) | (shard[o][1:] != shard[o][:-1])
        self.runs = np.flatnonzero(fresh)
        self.cut1 = np.searchsorted(self.runs, self.cut2)
        self.ids, self.shared = ids, np.where(ways > 1, total, 0)
        # shared first words are asked of all their shards, for the parts of their weight
        lead = np.unique(self.head)
        self.asked = [(w, (ids[w] + np.arange(ways[w])) % shards) for w in lead[ways[lead] > 1]]

    def part(self, s: int) -> Grams | None:
        """The n-grams that belong to a shard."""
        (x, y), (u, v), (i, j) = ((c[s], c[s + 1]) for c in (self.cut2, self.cut3, self.cut1))
        lead = self.head[self.runs[i:j]]
        size = np.diff(np.append(self.runs[i:j], y)) if i < j else np.empty(0, np.int64)
        more = np.array([w for w, at in self.asked if (at == s).any() and w not in set(lead.tolist())], np.int64)
        if x == y and not len(more):
            return None
        lead, size = np.append(lead, more), np.append(size, 0 * more)
        o = np.argsort(self.ids[lead], kind="stable")
        self.lead = lead[o]
        return Grams(self.ids[lead[o]], self.shared[lead[o]], size[o], self.ids[self.tail[x:y]], self.size_c[x:y], self.ids[self.third[u:v]], self.n2[x:y], self.n3[u:v])


ASK = "shard int, chunk long, blob binary"
REPLY = "kind int, shard int, chunk long, blob binary, n long, v long"


def _rows(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({x: "Int64" for x in names if x in ("chunk", "n", "v")} | {x: "int32" for x in names if x in ("kind", "shard")})


def _word_requests(shards: int):
    def run(batches):
        for pdf in batches:
            for chunk, blob in zip(pdf.chunk, pdf.blob, strict=True):
                c = Chunk(blob, shards)
                count = np.bincount(c.token, weights=np.repeat(c.learn, c.sizes), minlength=len(c.words)).astype(np.int64)
                parts = [c.order[x:y] for x, y in zip(c.cut[:-1], c.cut[1:], strict=True)]
                yield _rows([(s, chunk, _pack(c.words[of], count[of])) for s, of in enumerate(parts) if len(of)], ASK)

    return run


def _count_words(shards: int):
    """A shard's totals (kind 1: tokens, words seen), and to each chunk the counts and numbers of the
    words that it asked for (kind 0). A number is 1 + rank by count * shards + shard."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, parts = int(pdf.shard.iloc[0]), [_unpack(x) for x in pdf.blob]
        words, at = np.unique(np.concatenate([p[0].astype(np.uint64) for p in parts]), return_inverse=True)
        count = np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(words)).astype(np.int64)
        number = np.empty(len(words), np.int64)
        number[np.lexsort((words, -count))] = 1 + np.arange(len(words)) * shards + shard
        if len(number) and number.max() >= 1 << 32:
            raise ValueError("over 2^32 numbers of words: use more even or fewer shards")
        out = [(1, shard, None, None, int(count.sum()), int((count > 0).sum()))]
        ends = np.cumsum([len(p[0]) for p in parts])
        for chunk, p, e in zip(pdf.chunk, parts, ends, strict=True):
            mine = at[e - len(p[0]) : e]
            out.append((0, shard, chunk, _pack(count[mine], number[mine]), None, None))
        return _rows(out, REPLY)

    return run


def _gram_requests(shards: int, train: int):
    def run(batches):
        for pdf in batches:
            for chunk, blob in zip(pdf.chunk, pdf.blob, strict=True):
                c = Chunk(blob)
                c.grams(shards, train)
                parts = ((s, c.part(s)) for s in range(shards))
                out = _rows([(s, chunk, g.packed()) for s, g in parts if g is not None], ASK)
                del c
                release_memory()
                yield out

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    shard, out = int(pdf.shard.iloc[0]), []
    parts = [Grams(*_unpack(x)) for x in pdf.blob]
    every, places = Grams.union(parts)
    with tempfile.TemporaryDirectory() as folder:  # this task's own; gone with it
        g1, p2, g2, p3 = Trie(every.learnt(), folder).look_up(every)  # all chunks' n-grams, once each
    i = j = k = 0
    for chunk, g in zip(pdf.chunk, parts, strict=True):
        one, two, three = (of[s : s + n] for of, s, n in zip(places, (i, j, k), (len(g.a), len(g.b), len(g.c)), strict=True))
        out.append((2, shard, chunk, _pack(g1[one], p2[two], g2[two], p3[three]), None, None))
        i, j, k = i + len(g.a), j + len(g.b), k + len(g.c)
    release_memory()
    return _rows(out, REPLY)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 7, held: int = 2) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    Rows whose crc32(id) mod ``fold`` is ``held`` are scored only; the others teach the model too. A
    null text is an empty one: a single end. A row without id teaches and is not held out; repeated
    rows each teach and are scored alike; an empty table gives no rows; other columns are ignored.
    """
    n = partitions(docs.sparkSession)
    held_out = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(fold)) == held, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType
    packed = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("blob", T.BinaryType())])
    chunks = bucketed(rows.mapInArrow(_chunk_rows, packed), "chunk", n, "chunks")
    words = durable(chunks.select("chunk", "blob").mapInPandas(_word_requests(n), ASK).groupBy("shard").applyInPandas(_count_words(n), REPLY), "words")
    totals = words.where("kind = 1").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    train, types = int(totals.n or 0), int(totals.v or 0)
    shards = max(n, -(-train // SHARD_TOKENS))

    def number(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = list(zip(right["shard"].to_pylist(), right["blob"].to_pylist(), strict=True))
        blobs = [Chunk(b, n).numbered(answers) for b in left["blob"].to_pylist()]
        return left.set_column(left.schema.get_field_index("blob"), "blob", pa.array(blobs, pa.binary()))

    told = words.where("kind = 0").select("chunk", "shard", "blob").groupBy("chunk")
    coded = bucketed(chunks.groupBy("chunk").cogroup(told).applyInArrow(number, packed), "chunk", n, "coded")
    discard(chunks)
    discard(words)
    answers = coded.select("chunk", "blob").mapInPandas(_gram_requests(shards, train), ASK).groupBy("shard").applyInPandas(_answer, REPLY).select("chunk", "shard", "blob")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["id", "n_tokens", "n_known", "base_score", "score"]
        if not left.num_rows:
            return pa.table([pa.array([], left.schema.field("ids").type.value_type), *(pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=names)
        c = Chunk(left["blob"][0].as_py())
        c.grams(shards, train)
        types_of, part, p2, g2, p3 = np.zeros(len(c.ids)), np.zeros(len(c.ids)), np.zeros(len(c.head)), np.ones(len(c.head)), np.zeros(len(c.third))
        for s, b in zip(right["shard"].to_pylist(), right["blob"].to_pylist(), strict=True):
            g = c.part(s)
            x, u = ((cut[s], cut[s + 1]) for cut in (c.cut2, c.cut3))
            weight, p2[slice(*x)], g2[slice(*x)], p3[slice(*u)] = map(_opened, _unpack(b))
            part[c.lead] = weight / (1 - weight)  # T / n, of shared words this shard's part of it; at most 1
            types_of[c.lead] += part[c.lead]
            p2[slice(*x)] *= 1 + part[c.head[slice(*x)]]
        p2 /= 1 + types_of[c.head]
        g1 = np.where(types_of > 0, types_of / (1 + types_of), 1.0)  # else a context that training lacks
        plain = (c.count + 1.0) / (train + types + 1.0)
        p2 += g1[c.head] * plain[c.tail]
        p = p2[c.of2]
        p[c.inner] = p3[c.of3] + g2[c.of2[c.inner - 1]] * p[c.inner]
        sums = lambda x: np.add.reduceat(x, c.first)  # noqa: E731  every document has an end
        base, known = np.log10(plain)[c.token], (c.count > 0)[c.token].astype(np.int64)
        out = pa.table([left["ids"].combine_chunks().flatten(), pa.array(c.sizes), pa.array(sums(known)), pa.array(sums(base)), pa.array(sums(np.log10(p)))], names=names)
        release_memory()
        return out

    scored = T.StructType([T.StructField("id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    found = coded.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, scored)
    out = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(fold)) == held, F.lit(False))
    return found.select(F.col("id").alias(id_col), out.alias("held_out"), "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), "base_score", "score")
