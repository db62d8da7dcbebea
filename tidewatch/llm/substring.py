"""Substring dedup: seed on winnowed anchors, extend to whole windows, cut maximal repeats.

With windows of 13 words, each holds exactly eight 6-word grams; the least hash of them is its
anchor, so that equal windows have equal anchors wherever they stand. A window can only repeat if
its anchor does. Anchors are joined first (about one for every four words); only windows around
anchors that several documents share are then extended to all 13 words and joined in turn.
Overlapping windows that repeat merge into maximal repeats of 13 words or more. Windows are told
apart by 128 bits: among 10^13 of them, two unlike ones are taken for one with probability 10^-13.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, durable, free_name, ngram_hashes, partitions, release_memory, without, words

SEED = 6
#: Anchors keep 40 bits: enough to leave few chance meetings, which the windows' 128 bits then settle.
ANCHOR_BITS = 40


def window_anchors(h: np.ndarray, window: int) -> np.ndarray:
    """The anchor of each window: the least hash among its seed grams."""
    if len(h) < window:
        return np.empty(0, np.uint64)
    grams = ngram_hashes(h, SEED)
    width = window - SEED + 1
    low = grams[: len(grams) - width + 1].copy()
    for i in range(1, width):
        np.minimum(low, grams[i : len(grams) - width + 1 + i], out=low)
    return low >> np.uint64(64 - ANCHOR_BITS)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _second(ws: list[bytes], starts: np.ndarray, window: int) -> np.ndarray:
    """Another 64 bits for the windows at ``starts``, from other hashes of the words under them."""
    under = np.zeros(len(ws) + 1, np.int64)
    np.add.at(under, starts, 1)
    np.add.at(under, starts + window, -1)
    need = np.flatnonzero(np.cumsum(under[:-1]) > 0)
    h = np.zeros(len(ws), np.uint64)
    h[need] = np.fromiter((xxhash.xxh64_intdigest(ws[i], 77) for i in need.tolist()), np.uint64, len(need))
    return ngram_hashes(h, window)[starts]


def repeated_windows(docs: DataFrame, dealt: DataFrame, key_col: str, id_col: str, text_col: str, window: int) -> DataFrame:
    """(id, wins): for each id, the hashes of its windows that also start in a row with a smaller id.

    ``dealt`` is ``docs`` dealt by ``key_col``, the id. It is left-joined without filters, so that Spark
    moves the texts once, for this join and for the caller's.
    """
    n = partitions(docs.sparkSession)
    at = dealt.columns.index(text_col)
    key = dealt.columns.index(key_col)
    own_id, own_hs = free_name(dealt.columns, "_i"), free_name(dealt.columns, "_hs")

    def seeds(batches):
        hashes = WordHashes()
        for batch in batches:
            found = [np.unique(window_anchors(hashes.of(words(t)), window)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(found)], names=["id", "h"])
            release_memory()

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    anchors = plain.mapInArrow(seeds, "id long, h array<long>").select("id", F.explode("h").alias("h")).repartition(n, "h")
    # a window over the hash needs one exchange and one sort; its groups spill, and give rows, not lists
    same = Window.partitionBy("h")
    shared = anchors.withColumns({"lo": F.min("id").over(same), "hi": F.max("id").over(same)}).where("lo < hi")
    seeded = durable(shared.groupBy("id").agg(F.collect_set("h").alias(own_hs)).withColumnRenamed("id", own_id), "anchors")

    def extend(batches):
        hashes = WordHashes()
        for batch in batches:
            found, more, ids = [], [], []
            for i, t, hs in zip(batch.column(key).to_pylist(), batch.column(at).to_pylist(), batch.column(batch.num_columns - 1), strict=True):
                if not hs.is_valid or not t:
                    continue
                ws = words(t)
                h = hashes.of(ws)
                hot = np.isin(window_anchors(h, window), hs.values.to_numpy().view(np.uint64))
                if hot.any():
                    ids.append(i)
                    w, first = np.unique(ngram_hashes(h, window)[hot], return_index=True)
                    found.append(w)
                    # only the words under those windows are hashed anew
                    more.append(_second(ws, np.flatnonzero(hot)[first], window))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(found), _lists(more)], names=["id", "w", "x"])
            release_memory()

    near = dealt.join(seeded, F.col(key_col) == F.col(own_id), "left").select(*dealt.columns, own_hs)
    wins = near.mapInArrow(extend, "id long, w array<long>, x array<long>").select("id", F.explode(F.arrays_zip("w", "x")).alias("y")).select("id", "y.w", "y.x").repartition(n, "w")
    first = F.min("id").over(Window.partitionBy("w", "x"))
    return wins.withColumn("lo", first).where("id > lo").groupBy("id").agg(F.collect_set("w").alias("wins"))


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """The rows and columns of ``docs`` with _n_words, _n_removed, _kept_sha256 and, if asked for,
    _kept_text: the words not covered by a repeated window, joined by one space.

    A window repeats if its word sequence also starts in a document with a smaller id; windows are
    judged on the input; an input column of such a name gives way. Null and empty texts have no words; fewer than ``window`` words lose none;
    rows without id lose nothing and take nothing from others; rows that share an id don't repeat
    each other; repeats within one document stay; an empty table gives no rows.
    """
    n = partitions(docs.sparkSession)
    extra = [T.StructField("_n_words", T.LongType()), T.StructField("_n_removed", T.LongType()), T.StructField("_kept_sha256", T.StringType())]
    extra += [T.StructField("_kept_text", T.StringType())] * keep_text
    docs = without(docs, [f.name for f in extra])
    key, wins_id, wins_col = (free_name(docs.columns, c) for c in ("_key", "_of", "_wins"))
    dealt = docs.withColumn(key, F.col(id_col).cast("long")).repartition(n, key)
    wins = repeated_windows(docs, dealt, key, id_col, text_col, window).select(F.col("id").alias(wins_id), F.col("wins").alias(wins_col))
    joined = dealt.join(wins, F.col(key) == F.col(wins_id), "left").select(*docs.columns, key, wins_col)
    at = docs.columns.index(text_col)

    def cut(batches):
        hashes = WordHashes()
        for batch in batches:
            n_words, n_removed, digest, kept_text = [], [], [], []
            for t, gone in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1), strict=True):
                ws = words(t)
                n_words.append(len(ws))
                kept, removed = ws, 0
                if gone.is_valid and len(ws) >= window:
                    hit = np.isin(ngram_hashes(hashes.of(ws), window), gone.values.to_numpy().view(np.uint64))
                    if hit.any():
                        edge = np.zeros(len(ws) + 1, np.int64)
                        starts = np.flatnonzero(hit)
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, starts + window, -1)
                        stay = np.cumsum(edge[:-1]) == 0
                        kept = [w for w, s in zip(ws, stay, strict=True) if s]
                        removed = len(ws) - len(kept)
                n_removed.append(removed)
                joined_words = b" ".join(kept)
                digest.append(hashlib.sha256(joined_words).hexdigest())
                if keep_text:
                    kept_text.append(joined_words.decode("utf-8", "surrogatepass") if removed else t)
            arrays = [*batch.columns[:-2], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            arrays += [pa.array(kept_text, pa.string())] * keep_text
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-2], *[f.name for f in extra]])

    return joined.mapInArrow(cut, T.StructType([*docs.schema.fields, *extra]))
