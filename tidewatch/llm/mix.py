"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, without

#: A draw's mean is at most this; a larger rate is a sum of independent draws.
MOST_MEAN = 16.0
#: Beyond this many sources, the rates are joined by salted shuffle, not by broadcast.
MOST_BROADCAST = 20_000
SALTS = 32


def uniform(*parts) -> Column:
    """A uniform number in [0, 1) from 52 bits of an md5 over the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5, budget: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, bytes, rate): the mean repetitions that bring each source to its share of the bytes.

    ``weights`` (source, weight) names the shares; without it a source weighs ``bytes **
    temperature``. Sources without a weight get rate 0. ``budget`` is the mixture's size as a
    multiple of the input.
    """
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + F.lit(1)
    sums = docs.groupBy(F.col(source_col).alias("_source")).agg(F.sum(size.cast("long")).alias("_bytes"))
    if weights is None:
        sums = sums.withColumn("_weight", F.pow(F.col("_bytes").cast("double"), F.lit(temperature)))
    else:
        w = weights.select(F.col(weights.columns[0]).alias("_s"), F.col(weights.columns[1]).cast("double").alias("_weight"))
        w = w.groupBy("_s").agg(F.sum("_weight").alias("_weight"))
        sums = sums.join(w, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
        sums = sums.withColumn("_weight", F.greatest(F.coalesce("_weight", F.lit(0.0)), F.lit(0.0)))
    totals = sums.agg(F.sum("_bytes").alias("_all_bytes"), F.sum(F.col("_weight").cast("decimal(38,6)")).cast("double").alias("_all_weight"))
    return sums.crossJoin(F.broadcast(totals)).select(  # one row
        "_source",
        "_bytes",
        F.when(F.col("_all_weight") > 0, F.lit(budget) * F.col("_weight") / F.col("_all_weight") * F.col("_all_bytes") / F.col("_bytes")).otherwise(F.lit(0.0)).alias("_rate"),
    )


def poisson_table(rates: DataFrame) -> DataFrame:
    """Adds _draws, and _cdf: the cumulative Poisson probabilities of one draw's mean, up to where
    they stay at one in double precision."""
    mean = F.col("_mean")
    terms = F.expr(f"sequence(1, cast({MOST_MEAN} + 12 * sqrt({MOST_MEAN}) + 12 as int))")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))

    def step(acc, k):
        p = acc["p"] * mean / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["all"], F.array(c)).alias("all"))

    return (
        rates.withColumn("_draws", F.greatest(F.lit(1), F.ceil(F.col("_rate") / MOST_MEAN)).cast("int"))
        .withColumn("_mean", F.col("_rate") / F.col("_draws"))
        .withColumn("_cdf", F.aggregate(terms, start, step, lambda acc: acc["all"]))
    )


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5, budget: float = 1.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Each document as often as a Poisson draw of its source's mean rate says, in a global shuffle.

    The draw inverts the Poisson distribution at a uniform number hashed from (seed, id), so that a
    rerun or a lost task repeats it. Result: the columns of ``docs`` with _rate, _copies, _copy (from
    1) and _order, range-partitioned and sorted by _order; an input column of such a name gives way.
    Null sources form a source of their own; a null id draws as one id "null"; rows that share an id
    draw alike; an empty table gives no rows.
    """
    docs = without(docs, ["_rate", "_copies", "_copy", "_order"])
    mix = free_name(docs.columns, "_mix")  # what a row's source draws by
    rates = poisson_table(source_rates(docs, weights, temperature, budget, source_col, text_col))
    rates = rates.select(F.struct("_source", "_rate", "_draws", F.filter("_cdf", lambda c: c < 1.0 - 2.0**-53).alias("_cdf")).alias(mix))
    same = F.col(source_col).eqNullSafe(F.col(f"{mix}._source"))
    if len(rates.limit(MOST_BROADCAST + 1).select(F.lit(1)).collect()) <= MOST_BROADCAST:
        joined = docs.join(F.broadcast(rates), same)
    else:  # a source may hold a third of all rows
        salt = free_name([*docs.columns, mix], "_salt")
        salted = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.join(salted, same & (F.pmod(F.xxhash64(id_col, text_col), F.lit(SALTS)).cast("int") == F.col(salt))).drop(salt)
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    cdf, draws = F.col(f"{mix}._cdf"), F.col(f"{mix}._draws")
    count = lambda j: F.size(F.filter(cdf, lambda c: c <= uniform(F.lit(str(seed)), ident, j.cast("string"))))
    several = F.aggregate(F.sequence(F.lit(1), draws), F.lit(0), lambda acc, j: acc + count(j))
    counted = joined.withColumns({"_rate": F.col(f"{mix}._rate"), "_copies": F.when(draws == 1, _drawn(cdf, seed, ident)).otherwise(several)}).drop(mix)
    copies = counted.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    copies = copies.withColumn("_order", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}o"), ident, F.col("_copy").cast("string"))), 1, 15), 16, 10).cast("long"))
    return copies.repartitionByRange("_order").sortWithinPartitions("_order")


def _drawn(cdf: Column, seed: int, ident: Column) -> Column:
    """The first draw: the number is hashed once, then met with the probabilities."""
    one = F.transform(F.array(uniform(F.lit(str(seed)), ident, F.lit("1"))), lambda u: F.size(F.filter(cdf, lambda c: c <= u)))
    return F.element_at(one, 1)
