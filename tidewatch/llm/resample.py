"""Importance resampling toward a target distribution: hashed n-gram bags, interned in NumPy tables."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, numbered, release_memory, without

#: A-Z lowered; what is neither a digit, a letter nor beyond ASCII parts words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of text whose n-grams are interned together.
BLOCK_BYTES = 1 << 20


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes from ``a`` on equal those from ``b`` on, eight at a time. ``data`` ends in
    eight bytes of padding."""
    eights = np.ndarray(len(data) - 7, np.uint64, data, strides=(1,))
    same = np.ones(len(a), bool)
    open_ = np.flatnonzero(a != b)
    done = 0
    while len(open_):
        left = size[open_] - done
        differ = eights[a[open_] + done] ^ eights[b[open_] + done]
        short = left < 8
        differ[short] <<= (8 * (8 - left[short])).astype(np.uint64)
        same[open_[differ != 0]] = False
        done += 8
        open_ = open_[(differ == 0) & (left > 8)]
    return same


class Interned:
    """The n-grams of a block in an open-addressed table.

    Each occurrence probes linearly from its xxhash64 key; a free place goes to one of those that ask for
    it, and an occurrence stays where key, size and bytes are the owner's. ``slot`` is each occurrence's
    place, ``bucket`` and ``count`` belong to places.
    """

    def __init__(self, data: bytes, start: np.ndarray, size: np.ndarray, keys: np.ndarray, buckets: int):
        places = 1 << max(4, (2 * len(start)).bit_length())
        padded = np.frombuffer(data + bytes(8), np.uint8)
        owner = np.full(places, -1, np.int64)
        self.slot = np.empty(len(start), np.int64)
        at = (keys & np.uint64(places - 1)).astype(np.int64)
        open_ = np.arange(len(start))
        while len(open_):
            here = at[open_]
            free = owner[here] < 0
            owner[here[free]] = open_[free]
            own = owner[here]
            stays = (keys[own] == keys[open_]) & (size[own] == size[open_])
            stays[stays] = same_bytes(padded, start[own[stays]], start[open_[stays]], size[open_[stays]])
            self.slot[open_[stays]] = here[stays]
            open_ = open_[~stays]
            at[open_] = (at[open_] + 1) & (places - 1)
        self.count = np.bincount(self.slot, minlength=places)
        self.bucket = np.zeros(places, np.int64)
        taken = np.flatnonzero(owner >= 0)
        view = memoryview(data)
        self.bucket[taken] = [zlib.crc32(view[s : s + n]) % buckets for s, n in zip(start[owner[taken]].tolist(), size[owner[taken]].tolist(), strict=True)]


def pieces(texts: list[bytes | None], most: int) -> Iterator[tuple[int, list[bytes], int]]:
    """(row, words, carried) for the texts, a long one in several pieces; the first ``carried`` words of a
    piece are the last of the one before, fewer than ``most``, so that no n-gram is lost or met twice."""
    for row, text in enumerate(texts):
        clean, carry, at = (text or b"").translate(WORD_BYTES), [], 0
        while at < len(clean):
            end = clean.find(b" ", at + BLOCK_BYTES)
            end = len(clean) if end < 0 else end
            ws = carry + clean[at:end].split()
            yield row, ws, len(carry)
            carry, at = ws[len(ws) - min(len(ws), most - 1) :], end


def interned_blocks(texts: list[bytes | None], ngrams: tuple[int, int], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, Interned]]:
    """(row of each new word, row of each n-gram, table) for each block of pieces."""
    low, high = ngrams

    def block(held):
        ws = [w for _, piece, _ in held for w in piece]
        data = b" ".join(ws)
        size = np.fromiter(map(len, ws), np.int64, len(ws))
        start = np.cumsum(size + 1) - size - 1
        part = np.repeat(np.arange(len(held)), [len(p) for _, p, _ in held])
        rows = np.repeat([r for r, _, _ in held], [len(p) for _, p, _ in held]).astype(np.int64)
        new = np.concatenate([np.arange(len(p)) >= c for _, p, c in held])
        starts, sizes, of, keys = [], [], [], []
        view = memoryview(data)
        for k in range(low, high + 1):
            if len(ws) < k:
                continue
            i = np.arange(len(ws) - k + 1)
            i = i[(part[i] == part[i + k - 1]) & new[i + k - 1]]
            s = start[i]
            n = start[i + k - 1] + size[i + k - 1] - s
            grams = (ws[j] for j in i.tolist()) if k == 1 else (view[a : a + b] for a, b in zip(s.tolist(), n.tolist(), strict=True))
            keys.append(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, len(i)))
            starts.append(s)
            sizes.append(n)
            of.append(rows[i])
        join = lambda xs, kind: np.concatenate(xs) if xs else np.empty(0, kind)
        return rows[new], join(of, np.int64), Interned(data, join(starts, np.int64), join(sizes, np.int64), join(keys, np.uint64), buckets)

    held, weight = [], 0
    for piece in pieces(texts, high):
        if piece[1]:
            held.append(piece)
            weight += sum(map(len, piece[1]))
        if weight >= BLOCK_BYTES:
            yield block(held)
            held, weight = [], 0
    if held:
        yield block(held)


def bucket_counts(texts: DataFrame, text_col: str, ngrams: tuple[int, int], buckets: int) -> np.ndarray:
    """How many n-grams of all texts fall into each bucket: each task sums its own, Spark adds the sums, and
    the driver gets ``buckets`` numbers."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, table in interned_blocks(batch.column(0).to_pylist(), ngrams, buckets):
                np.add.at(total, table.bucket, table.count)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], names=["bucket", "n"])
        release_memory()

    out = np.zeros(buckets, np.int64)
    for r in texts.select(F.col(text_col).cast("binary")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains_of(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over its share in the raw texts, one added to each count."""
    b, s, t = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(y) + 1) * (s + b) / ((float(x) + 1) * (t + b)))) for x, y in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 10, ngrams: tuple[int, int] = (1, 1), buckets: int = 10_000, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Draws ``percent`` in a hundred of the documents, without replacement, with chances that follow how much
    likelier a document's n-grams are in the target than in ``docs`` (Gumbel top-k).

    All rows of ``docs``, with the columns named in ``carry`` (else all), _n_features, _weight (the sum of its
    n-grams' gains), _score (weight plus noise seeded by the id) and _rank (1 for the best drawn one; null if
    not drawn). Documents under ``least_words`` words are scored but neither counted nor drawn.

    Both passes over the texts intern n-grams by block, so that a bucket is worked out once a block for each
    distinct n-gram; bucket counts are sums over all texts, and the gains (``buckets`` numbers) go to the tasks.
    Ranks are row numbers of a range-sorted table: no task sees all of it.

    Null and empty texts, and texts without words, have no features and weight 0. A very long text is interned
    in pieces of a mebibyte cut between words, with the words before a cut carried over. Ties go to the smaller
    id, null ids last (their noise is that of the word null); repeated rows are each counted, scored and drawn
    by themselves. An empty target or empty docs work (all gains follow from counts of zero; no rows). Input
    columns called like a result give way.
    """
    low, high = ngrams
    if not 1 <= low <= high or buckets < 1 or not 0 <= percent <= 100:
        raise ValueError("n-grams from one word up, a bucket at least, a percentage")
    gains = gains_of(bucket_counts(target, target_text_col, ngrams, buckets), bucket_counts(docs, text_col, ngrams, buckets))
    own = ["_n_features", "_n_words", "_weight", "_score", "_rank", "_row"]
    kept = without(docs if carry is None else docs.select(*carry), own)
    read = without(docs, own).select(*[F.col(f"`{c}`") for c in kept.columns], F.col(text_col).cast("binary").alias("_row"))

    def score(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            total, grams, n_words = (np.zeros(len(texts), np.int64) for _ in range(3))
            for of_word, of_gram, table in interned_blocks(texts, ngrams, buckets):
                n_words += np.bincount(of_word, minlength=len(texts))
                grams += np.bincount(of_gram, minlength=len(texts))
                np.add.at(total, of_gram, gains[table.bucket][table.slot])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(grams), pa.array(n_words), pa.array(total)], names=[*batch.schema.names[:-1], *own[:3]])
        release_memory()

    scored = read.mapInArrow(score, T.StructType([*kept.schema.fields, *[T.StructField(c, T.LongType()) for c in own[:3]]]))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = durable(scored.withColumn("_score", F.col("_weight") + noise), "scored")
    enough = F.col("_n_words") >= least_words
    draws = scored.where(enough).count() * percent // 100
    order = [F.when(enough, 0).otherwise(1), F.col("_score").desc(), F.col(id_col).asc_nulls_last(), F.col("_weight"), F.col("_n_features")]
    rank = F.col("_row") + 1
    return numbered(scored, order, "_row", "ranked").select(*kept.columns, "_n_features", "_weight", "_score", F.when(enough & (rank <= draws), rank).alias("_rank"))
