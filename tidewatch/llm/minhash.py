"""MinHash near-duplicates: a multi-index Hamming join of b-bit signatures.

A signature has 64 symbols of 16 bits, one for each hash function. Two documents' signature
distance is the number of symbols in which they differ, about 64 * (1 - Jaccard). It is split into
16 chunks of 4 symbols. If every chunk had two errors or more, the distance would be 32 at least; so
by pigeonhole all pairs within distance 31 share a chunk with at most one error, and are found by
the four keys of each chunk that leave one symbol out. At Jaccard 0.75, a distance over 31 has
probability 1.4e-5.

Before texts are compared, a pair must also have sets of sizes that a link allows: they cannot differ
by more than the wanted share, so that this test loses nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, durable, lower_words, mix64, ngram_hashes, once, partitions, release_memory, row_key
from .components import connected_components, local_roots

SYMBOLS, CHUNK = 64, 4
MOST_DISTANCE = 2 * (SYMBOLS // CHUNK) - 1
#: Buckets up to this many rows are compared in the sorted partition; larger ones in tiles.
SMALL, TILE = 48, 1024
#: Rounds in which bucket mates in different components meet a centre, before all of those pairs do.
STAR_ROUNDS = 1
#: Bytes of a signature: symbols of 16 bits, the size of the set.
WIDTH = 2 * SYMBOLS + 4
_MULTIPLIERS = (np.random.default_rng(90125).integers(1, 1 << 62, SYMBOLS, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def shingle_set(text: str | None, hashes: WordHashes, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words are one shingle, none is empty."""
    ws = lower_words(text)
    if not ws:
        return np.empty(0, np.uint64)
    return np.unique(ngram_hashes(hashes.of(ws), min(k, len(ws))))


def signature(shingles: np.ndarray) -> bytes:
    """The low bits of each hash function's minimum, and the size of the set."""
    low = np.full(SYMBOLS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for s in range(0, len(shingles), 1024):
        np.minimum(low, (_MULTIPLIERS[:, None] * shingles[None, s : s + 1024]).min(axis=1), out=low)
    return (mix64(low) & np.uint64(0xFFFF)).astype(np.uint16).tobytes() + np.uint32(min(len(shingles), 0xFFFFFFFF)).tobytes()


class Signatures:
    """Many signatures as arrays."""

    def __init__(self, blobs=None):
        if blobs is None:
            return
        raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, WIDTH)
        self.main = np.ascontiguousarray(raw[:, : 2 * SYMBOLS]).view(np.uint16)
        self.size = np.ascontiguousarray(raw[:, 2 * SYMBOLS :]).view(np.uint32)[:, 0].astype(np.int64)

    def __getitem__(self, i) -> Signatures:
        out = Signatures()
        out.main, out.size = self.main[i], self.size[i]
        return out

    def near(self, other: Signatures, percent: int) -> np.ndarray:
        """Row by row: within the signature distance, and of sizes that a link allows."""
        return ((self.main != other.main).sum(axis=1) <= MOST_DISTANCE) & (100 * np.minimum(self.size, other.size) >= percent * np.maximum(self.size, other.size))


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, key, n, digest, sig) for each row; digest and sig are null where there are no words."""
    schema = "id long, key long, n long, digest binary, sig binary"

    def sign(batches):
        hashes = WordHashes()
        for batch in batches:
            n, digest, sig = [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text, hashes, k)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], names=["id", "key", "n", "digest", "sig"])
            release_memory()

    return docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(sign, schema)


def chunk_keys(reps: DataFrame) -> DataFrame:
    """(bucket, id, label): 64 rows for each signature, a chunk of it with one symbol left out.

    A bucket is chunk number, place left out and the other three symbols: 54 bits, no hash.
    """

    def keys(batches):
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            sig = Signatures(batch.column(2).to_pylist()).main.reshape(m, SYMBOLS // CHUNK, CHUNK).astype(np.uint64)
            out = np.empty((m, SYMBOLS // CHUNK, CHUNK), np.uint64)
            chunk = np.arange(SYMBOLS // CHUNK, dtype=np.uint64)
            for gone in range(CHUNK):
                value = chunk * np.uint64(CHUNK) + np.uint64(gone)
                for at in range(CHUNK):
                    if at != gone:
                        value = value * np.uint64(1 << 16) + sig[:, :, at]
                out[:, :, gone] = value
            flat = pa.array(out.reshape(-1).view(np.int64))
            width = SYMBOLS
            offsets = pa.array(np.arange(m + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, flat)], names=["id", "label", "buckets"])

    return reps.select("id", "label", "sig").mapInArrow(keys, "id long, label long, buckets array<long>").select(F.explode("buckets").alias("bucket"), "id", "label")


def _near(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose signatures allow a link."""

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(Signatures(a).near(Signatures(b), percent) if len(a) else [], dtype=bool)

    x = reps.select(F.col("id").alias("a"), F.col("sig").alias("sa"))
    y = reps.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(x, "a").join(y, "b").where(near("sa", "sb")).select("a", "b")


def _verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """Of the pairs (a, b), those whose whole shingle sets meet 100 * both >= percent * either."""
    keyed = reps.select("id", "key")
    x = texts.select(F.col("id").alias("a"), F.col("key").alias("ka"), F.col("text").alias("ta"))
    y = texts.select(F.col("id").alias("b"), F.col("key").alias("kb"), F.col("text").alias("tb"))
    p = pairs.join(keyed.select(F.col("id").alias("a"), F.col("key").alias("ka")), "a").join(keyed.select(F.col("id").alias("b"), F.col("key").alias("kb")), "b")
    p = p.join(x, ["a", "ka"]).join(y, ["b", "kb"]).select("a", "b", "ka", "kb", "ta", "tb")

    def verify(batches):
        hashes, sets = WordHashes(), {}

        def of(i, key, text):
            if (i, key) not in sets:
                if len(sets) > 64:
                    sets.clear()
                sets[i, key] = shingle_set(text, hashes, k)
            return sets[i, key]

        for batch in batches:
            a, b, ka, kb, ta, tb = (batch.column(x).to_pylist() for x in range(6))
            keep = []
            for i, j, x, y, s, t in zip(a, b, ka, kb, ta, tb, strict=True):
                u, v = of(i, x, s), of(j, y, t)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            keep = np.array(keep, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[keep]), pa.array(np.array(b, np.int64)[keep])], names=["a", "b"])
            release_memory()

    return p.mapInArrow(verify, "a long, b long")


def _forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the pairs of positions (i, j) connect: at most one for each id."""
    par = np.arange(len(ids))
    local_roots(par, i, j)
    low = par != np.arange(len(ids))
    return ids[low], ids[par[low]]


def _crossing(keys: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect all pairs of one bucket with different labels whose signatures allow
    a link: a forest for each task, not the pairs, whose number can be a crowd's square.

    ``keys`` is (bucket, id, label, sig). Rows of small buckets are compared with those that follow
    them in the sorted partition; larger buckets are cut into tiles, and tiles meet.
    """
    keys = durable(keys, "mixed")
    sizes = keys.groupBy("bucket").agg(F.count("*").alias("size"))
    small = keys.join(sizes.where(F.col("size") <= SMALL), "bucket").select("bucket", "id", "label", "sig")
    n = partitions(keys.sparkSession)

    def scan(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            bucket = rest.column(0).to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
            yield from meet_rows(rest.slice(0, cut))
            rest = rest.slice(cut)
        if rest is not None:
            yield from meet_rows(rest)

    def meet_rows(table):
        m = table.num_rows
        if m < 2:
            return
        bucket, ids, label = (table.column(x).to_numpy() for x in range(3))
        sig = Signatures(table.column(3).to_pylist())
        found = []
        for step in range(1, min(SMALL, m)):
            same = bucket[:-step] == bucket[step:]
            if not same.any():
                break
            i = np.flatnonzero(same & (label[:-step] != label[step:]))
            for s in range(0, len(i), 32768):
                x = i[s : s + 32768]
                x = x[sig[x].near(sig[x + step], percent)]
                found.append((x, x + step))
        if found:
            i, j = map(np.concatenate, zip(*found, strict=True))
            one, number = np.unique(ids, return_inverse=True)
            a, b = _forest(one, number[i], number[j])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    few = small.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(scan, "a long, b long")
    large = keys.join(sizes.where(F.col("size") > SMALL), "bucket")
    dealt = _tiles(large, "bucket", TILE, ["id", "label", "sig"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, i, j = _near_rows(pdf, percent)
        a, b = _forest(ids, i, j)
        return pd.DataFrame({"a": a, "b": b})

    many = dealt.groupBy("bucket", "s", "t").applyInPandas(meet, "a long, b long")
    return few.union(many).distinct()


def _tiles(rows: DataFrame, group: str, tile: int, columns: list[str]) -> DataFrame:
    """Rows of each group dealt to pairs (s, t) of its tiles: two tiles at most meet in a task."""
    own = rows.withColumn("tiles", F.ceil(F.col("size") / tile).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    dealt = own.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return dealt.select(group, F.least("own", "t").alias("s"), F.greatest("own", "t").alias("t"), "own", *columns)


def _near_rows(pdf: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of a task, and the positions (i, j) of rows with different labels in its two tiles (or
    in its one) whose signatures allow a link."""
    s, t = int(pdf.s.iloc[0]), int(pdf.t.iloc[0])
    ids, labels, own = pdf.id.to_numpy(), pdf.label.to_numpy(), pdf.own.to_numpy()
    sig = Signatures(pdf.sig)
    right = np.flatnonzero(own == t)
    found = [(np.empty(0, np.int64),) * 2]
    for i in np.flatnonzero(own == s):
        j = right[(labels[right] != labels[i]) & ((right > i) if s == t else True)]
        j = j[sig[[i]].near(sig[j], percent)] if len(j) else j
        found.append((np.full(len(j), i), j))
    i, j = map(np.concatenate, zip(*found, strict=True))
    return ids, i, j


def _forest_of_links(ids: np.ndarray, i: np.ndarray, j: np.ndarray, texts: np.ndarray, percent: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the linked ones among the pairs of positions (i, j) connect, i ascending.

    A row's shingles are marked, and those of all its partners looked up at once; partners that are
    connected with it by then need no look.
    """
    par = np.arange(len(ids))
    if not len(i):
        return ids[:0], ids[:0]
    hashes, used = WordHashes(), np.union1d(i, j)
    sets = [shingle_set(texts[x], hashes, k) for x in used]
    size = np.zeros(len(ids), np.int64)
    size[used] = [len(x) for x in sets]
    begin = np.zeros(len(ids), np.int64)
    begin[used] = np.cumsum(size[used]) - size[used]
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(flat), bool)
    for s, e in zip(*(lambda c: (c[:-1], c[1:]))(np.concatenate([[0], np.flatnonzero(np.diff(i)) + 1, [len(i)]])), strict=True):
        x, ys = i[s], j[s:e]
        mark[flat[begin[x] : begin[x] + size[x]]] = True
        for t in range(0, len(ys), 64):
            near = ys[t : t + 64]
            near = near[par[near] != par[x]]
            if len(near):
                n = size[near]
                at = np.arange(int(n.sum())) + np.repeat(begin[near] - (np.cumsum(n) - n), n)
                both = np.add.reduceat(mark[flat[at]].astype(np.int64), np.cumsum(n) - n)
                near = near[100 * both >= percent * (size[x] + n - both)]
                local_roots(par, np.full(len(near), x), near)
        mark[flat[begin[x] : begin[x] + size[x]]] = False
    low = par != np.arange(len(ids))
    return ids[low], ids[par[low]]


def _linked_blocks(edges: DataFrame, labelled: DataFrame, reps: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """Links (a, b) that connect all linked pairs with different labels among rows which ``edges``
    connect. Such rows form blocks; a text goes to its block once (to each pair of its tiles, if the
    block is large), and full sets are compared there."""
    blocks = connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("block"))
    sizes = blocks.groupBy("block").agg(F.count("*").alias("size"))
    rows = blocks.join(labelled, "id").join(reps.select("id", "key"), "id").join(texts, ["id", "key"]).join(sizes, "block")
    dealt = _tiles(rows, "block", TILE // 2, ["id", "label", "sig", "text"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["id", "label"])
        ids, i, j = _near_rows(pdf, percent)
        a, b = _forest_of_links(ids, i, j, pdf.text.to_numpy(), percent, k)
        return pd.DataFrame({"a": a, "b": b})

    return dealt.groupBy("block", "s", "t").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept for each row; links are pairs with 100 * |both| >=
    percent * |either| on the full shingle sets.

    Rows with equal sets are one class and compared once, through the row with the least id. First
    every member of a bucket meets the bucket's least member, then those in other components than a
    hashed centre meet it; confirmed links give components. What is left are bucket mates in
    different components: all of those pairs are compared in the end, so that no link between components is lost, while a crowd of near copies, by then one component,
    costs no pairs within itself.

    Null, empty and wordless texts have no shingles and no links; a row without id has a null
    component and is not kept; rows that share an id are one node; an empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    signed = durable(signatures(docs, id_col, text_col, k), "signatures")
    reps = signed.where("n > 0 AND id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("id", "key", "sig")).alias("r")).select("digest", "r.*")
    reps = durable(reps, "classes")
    n = partitions(spark)
    # a row stands once for its repeats, so that m of them do not make m times m pairs
    texts = once(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    keys = chunk_keys(reps.withColumn("label", F.col("id"))).select("bucket", "id").repartition(n, "bucket")
    least = keys.groupBy("bucket").agg(F.min("id").alias("b"), F.max("id").alias("top")).where("b < top").select("bucket", "b")
    stars = keys.join(least, "bucket").where("id > b").select(F.col("id").alias("a"), "b").distinct()
    stars = durable(_near(stars, reps, percent), "candidates")
    links = durable(_verified(stars, reps, texts, percent, k).distinct(), "links")
    for turn in range(STAR_ROUNDS + 1):
        label = connected_components(links).select("node", F.col("component").alias("label"))
        labelled = durable(reps.select("id", "sig").distinct().join(label, F.col("id") == F.col("node"), "left").select("id", F.coalesce("label", "id").alias("label"), "sig"), "labelled")
        keys = chunk_keys(labelled).repartition(n, "bucket")
        ends = [F.min("label").alias("l0"), F.max("label").alias("l1"), F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("r"), "id", "label")).alias("c")]
        mixed = keys.groupBy("bucket").agg(*ends).where("l0 < l1").select("bucket", F.col("c.id").alias("b"), F.col("c.label").alias("lb"))
        if turn < STAR_ROUNDS:  # another centre for what the least member left apart
            pairs = keys.join(mixed, "bucket").where("label <> lb").select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b"))
            fresh = durable(_near(pairs.distinct().join(stars, ["a", "b"], "left_anti"), labelled, percent), "candidates")
            links = links.unionByName(durable(_verified(fresh, reps, texts, percent, k).distinct(), "links"))
        else:
            edges = _crossing(keys.join(mixed.select("bucket"), "bucket").join(labelled.select("id", "sig"), "id").select("bucket", "id", "label", "sig"), percent)
            links = links.unionByName(durable(_linked_blocks(edges, labelled, reps, texts, percent, k).distinct(), "links"))
    component = connected_components(links)
    classes = reps.join(component, F.col("id") == F.col("node"), "left").select("digest", F.coalesce("component", "id").alias("component"))
    rows = signed.select("id", "n", "digest").join(classes, "digest", "left")
    found = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), found.alias("component_id"), F.coalesce(F.col("id") == found, F.lit(False)).alias("kept"))
