"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark, sf_dir):
    from .embed_dedup import near_duplicate_vectors

    return near_duplicate_vectors(_read(spark, sf_dir, "embeddings"))


def op2_sharding(spark, sf_dir):
    from .shard import shard_by_bytes

    return shard_by_bytes(_read(spark, sf_dir, "documents"), 8)


def op3_sentencepiece(spark, sf_dir):
    from pyspark.sql import functions as F

    from .spm import encode_and_sample

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_and_sample(docs).select("doc_id", F.col("_n_pieces").alias("n_pieces"), F.col("_pieces_crc32").alias("pieces_crc32"), F.col("_round_trip").alias("round_trip"), F.col("_samples").alias("samples"))


def op4_lm_scoring(spark, sf_dir):
    from .lm import score_documents

    return score_documents(_read(spark, sf_dir, "documents"))


def op5_quality_classifier(spark, sf_dir):
    from .quality import classify_quality

    return classify_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).drop("_key")


def op6_nearest_neighbours(spark, sf_dir):
    from .ann import nearest

    return nearest(_read(spark, sf_dir, "embeddings"))


def op7_substring_dedup(spark, sf_dir):
    from pyspark.sql import functions as F

    from .substring import remove_repeats

    cut = remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return cut.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_kept_sha256").alias("kept_sha256"))


def op8_license_scan(spark, sf_dir):
    from .licences import scan_licences

    return scan_licences(_read(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark, sf_dir):
    from .minhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op10_source_mixing(spark, sf_dir):
    from pyspark.sql import functions as F

    from .mix import mix_sources

    mixed = mix_sources(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.col("_rate").alias("rate"), F.col("_copies").alias("copies"), F.col("_copy").alias("copy"), F.col("_order").alias("shuffle_key"))


def op11_hard_negatives(spark, sf_dir):
    from pyspark.sql import functions as F

    from .hard_negatives import mine_hard_negatives

    rows = _read(spark, sf_dir, "embeddings")
    relabelled = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine_hard_negatives(relabelled, F.col("vec_id") % 100 == 0)


def op12_secret_scan(spark, sf_dir):
    from pyspark.sql import functions as F

    from .secret_scan import BASE, scan_secrets, spelt

    found = scan_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kinds: F.filter("_secrets", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of([r.kind])).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(spelt(of([r.kind for r in BASE])).cast("binary"), 256).alias("base_sha256"), spelt(F.col("_secrets")).alias("spans"))


def op13_importance_resampling(spark, sf_dir):
    from pyspark.sql import functions as F

    from .resample import importance_resample

    drawn = importance_resample(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return drawn.select("doc_id", *[F.col(f"_{c}").alias(c) for c in ("n_features", "weight", "score", "rank")])


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_sharding, op3_sentencepiece, op4_lm_scoring, op5_quality_classifier, op6_nearest_neighbours, op7_substring_dedup, op8_license_scan, op9_minhash_near_dedup, op10_source_mixing, op11_hard_negatives, op12_secret_scan, op13_importance_resampling)}


def _sharding_sql(shards: int = 8) -> str:
    # crc32 has no SQL function here: its table is built by rule, then folded over the bytes
    return f"""
WITH RECURSIVE t(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS l FROM t WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
h AS (SELECT doc_id, text, md5(text) AS digest, strlen(text)::BIGINT + 1 AS size FROM d),
c AS (SELECT digest, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * octet_length(encode(any_value(text))), 2),
        lambda p: ('0x' || substr(hex(encode(any_value(text))), p, 2))::BIGINT)),
        lambda a, b: xor(a >> 8, any_value(l)[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM h, tab GROUP BY digest),
o AS (SELECT h.doc_id, h.size, h.digest, sum(size) OVER w - size AS before, sum(size) OVER () AS total, row_number() OVER w - 1 AS r
      FROM h WINDOW w AS (ORDER BY digest, doc_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, least({shards - 1}, ((2 * before + size) * {shards}) // (2 * total))::INT AS shard FROM o)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, (r - min(r) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard
FROM s JOIN c USING (digest)"""


def _licences_sql() -> str:
    from .licences import COPYRIGHT, LICENCES, LOWER, MARKS, SPELLINGS, UPPER

    q = lambda s: "'" + s.replace("'", "''") + "'"
    chars = lambda s: "||".join("chr(10)" if x == "\n" else "chr(13)" if x == "\r" else q(x) for x in s)

    def lines(text):
        t = f"regexp_replace(translate({text}, {chars(UPPER)}, {chars(LOWER)}), {q(MARKS)}, ' ', 'g')"
        for a, b in SPELLINGS:
            t = f"replace({t}, {q(a)}, {q(b)})"
        return f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, {q(COPYRIGHT)}))"

    rows = ", ".join(f"({q(k)}, {q(t)})" for k, v in LICENCES.items() for t in v)
    return f"""
WITH k AS (SELECT DISTINCT licence, md5(array_to_string({lines("text")}, ' ')) AS digest FROM (VALUES {rows}) v(licence, text)),
d AS (SELECT doc_id, {lines("coalesce(text, '')")} AS ls FROM documents),
h AS (SELECT doc_id, string_agg(licence, ',' ORDER BY licence) AS licences, count(*)::INT AS n FROM
      (SELECT DISTINCT doc_id, licence FROM (SELECT doc_id, md5(unnest(ls)) AS digest FROM d) JOIN k USING (digest)) GROUP BY doc_id),
e AS (SELECT digest, min(licence) AS licence FROM k GROUP BY digest)
SELECT d.doc_id, md5(array_to_string(ls, ' ')) AS text_digest, CASE WHEN len(ls) > 0 THEN e.licence END AS whole_licence,
       coalesce(h.licences, '') AS licences, coalesce(h.n, 0)::INT AS n_licences
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN e ON e.digest = md5(array_to_string(ls, ' '))"""


def _mixing_sql() -> str:
    from .mix import MOST_MEAN

    unit = lambda j: f"(('0x' || substr(md5(concat('17|', coalesce(doc_id::VARCHAR, 'null'), '|', {j})), 1, 13))::BIGINT / {float(1 << 52)!r})"
    terms = int(MOST_MEAN + 12 * MOST_MEAN**0.5 + 12)
    return f"""
WITH RECURSIVE s AS (SELECT source, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS b FROM documents GROUP BY source),
w AS (SELECT source, b, pow(b::DOUBLE, 0.5) AS w, sum(pow(b::DOUBLE, 0.5)::DECIMAL(38,6)) OVER () AS aw, sum(b) OVER () AS ab FROM s),
r AS (SELECT source, 1.0::DOUBLE * w / aw::DOUBLE * ab::DOUBLE / b::DOUBLE AS rate FROM w),
m AS (SELECT source, rate, greatest(1, ceil(rate / {MOST_MEAN}))::INT AS draws, rate / greatest(1, ceil(rate / {MOST_MEAN})) AS mean FROM r),
p(source, k, p, c) AS (
  SELECT source, 0, exp(-mean), exp(-mean) FROM m
  UNION ALL SELECT p.source, k + 1, p.p * mean / (k + 1), p.c + p.p * mean / (k + 1) FROM p JOIN m ON m.source IS NOT DISTINCT FROM p.source WHERE k < {terms}),
f AS (SELECT source, list(c ORDER BY k) AS cdf FROM p WHERE c < 1 - pow(2.0, -53) GROUP BY source),
d AS (SELECT doc_id, documents.source, rate, list_sum(list_transform(range(1, draws + 1), lambda j: len(list_filter(coalesce(cdf, []), lambda c: c <= {unit("j")}))))::INT AS copies
      FROM documents JOIN m ON m.source IS NOT DISTINCT FROM documents.source LEFT JOIN f ON f.source IS NOT DISTINCT FROM documents.source)
SELECT doc_id, source, rate, copies, i::INT AS copy, ('0x' || substr(md5(concat('17o|', coalesce(doc_id::VARCHAR, 'null'), '|', i)), 1, 15))::BIGINT AS shuffle_key
FROM d, unnest(range(1, copies + 1)) u(i)"""


def _vectors_sql() -> str:
    return """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
u AS (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS n FROM v),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_inner_product(a.x, b.x) / (a.n * b.n) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)"""


_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _substring_sql() -> str:
    return f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
w AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS s FROM d WHERE len(ws) >= 13),
h AS (SELECT doc_id, s, array_to_string(ws[s:s + 12], ' ') AS win FROM w),
f AS (SELECT win, min(doc_id) AS m FROM h GROUP BY win),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS i FROM h JOIN f USING (win) WHERE doc_id > m),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM p ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""


def _minhash_sql() -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(low)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS h FROM
      (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (h) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)"""


def _hard_negatives_sql() -> str:
    return """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda y: floor(256 * y::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INT AS rank,
       s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10"""


def _secrets_sql() -> str:
    from .secret_scan import ADDED, BASE

    q = lambda s: "'" + s.replace("'", "''") + "'"

    def spans(n, rule):
        pattern = q(("(?i)" if rule.any_case else "") + rule.pattern)
        return f"""
SELECT doc_id, {n} AS n, {q(rule.kind)} AS kind, start, start + length(m) AS past FROM (
  SELECT doc_id, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i:
    (coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0))::BIGINT)) AS start
  FROM (SELECT doc_id, regexp_extract_all(text, {pattern}) AS ms, regexp_split_to_array(text, {pattern}) AS gaps FROM d))
WHERE length(regexp_extract(m, {pattern}, {rule.group})) >= {rule.least}"""

    every = " UNION ALL ".join(spans(n, r) for n, r in enumerate(BASE + ADDED))
    said = "string_agg(kind || ':' || start || ':' || past, ',' ORDER BY start, n, past)"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({every}),
g AS (SELECT doc_id, {counts}, {said} FILTER (n < {len(BASE)}) AS base, {said} AS spans FROM s GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""


def _resampling_sql() -> str:
    ws = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".replace("\\\\", "\\")
    return f"""
WITH RECURSIVE t(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS l FROM t WHERE k = 8),
d AS (SELECT doc_id, {ws} AS ws FROM documents),
dw AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM d) GROUP BY w),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest({ws}) AS w FROM benchmark) GROUP BY w),
u AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * octet_length(encode(w)), 2), lambda p: ('0x' || substr(hex(encode(w)), p, 2))::BIGINT)),
        lambda a, b: xor(a >> 8, l[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw), tab),
c AS (SELECT bucket, coalesce(sum(dw.n), 0)::DOUBLE AS s, coalesce(sum(bw.n), 0)::DOUBLE AS t FROM u LEFT JOIN dw USING (w) LEFT JOIN bw USING (w) GROUP BY bucket),
z AS (SELECT sum(s) AS s, sum(t) AS t FROM c),
g AS (SELECT bucket, floor(1000 * ln((c.t + 1) * (z.s + 10000) / ((c.s + 1) * (z.t + 10000))))::BIGINT AS gain FROM c, z),
e AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM (SELECT doc_id, unnest(ws) AS w FROM d) JOIN u USING (w) JOIN g USING (bucket) GROUP BY doc_id),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM d LEFT JOIN e USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n_features >= 20) OVER () AS n FROM f)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank FROM r"""


ORACLES = {"op11_hard_negatives": _hard_negatives_sql, "op12_secret_scan": _secrets_sql, "op13_importance_resampling": _resampling_sql, "op1_embedding_near_dedup": _vectors_sql, "op7_substring_dedup": _substring_sql, "op9_minhash_near_dedup": _minhash_sql, "op2_sharding": _sharding_sql, "op8_license_scan": _licences_sql, "op10_source_mixing": _mixing_sql}
