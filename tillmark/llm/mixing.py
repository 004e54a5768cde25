"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the documents over its own share. Every document gets a count
drawn from the Poisson distribution of that mean, by inverting it at a uniform number hashed from the seed and the
doc_id; the document is exploded by its count, and the copies are shuffled globally by a hash of the seed, the doc_id and
the copy. The same seed gives the same rows in the same order.

A mean above PIECE is drawn as a sum of equal pieces, each with a uniform number of its own, which is the same
distribution and keeps the inversion short; nothing is capped.

Targets are relative: they are scaled to the sources that have documents; a source without a target gets none of its own
and drops out, so pass every source (``tempered`` does). Null sources are a source of their own. Null and empty texts are
documents like any other. Repeated rows of one doc_id get the same count and the same places, ties in no order. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.session import durable

#: Largest mean that is inverted in one go, and terms of its distribution until what is left is below 2**-53.
PIECE, TERMS = 8.0, 48


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts; 52 bits of it."""
    digest = F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def tempered(docs: DataFrame, power: float) -> DataFrame:
    """``source, weight``: the number of documents of every source to a power; 1 keeps the mix, 0 evens it out."""
    return docs.groupBy(docs["source"].alias("source")).agg(F.pow(F.count("*").cast("double"), F.lit(power)).alias("weight"))


def rates(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, n_docs, rate`` of every source with a target: the mean number of copies of its documents."""
    own = docs.groupBy(docs["source"].alias("own")).agg(F.count("*").alias("n_docs"))
    named = own.join(targets, own["own"].eqNullSafe(targets["source"])).select("own", "n_docs", "weight")
    whole = named.agg(F.sum("n_docs"), F.sum("weight")).first()
    all_docs, all_weight = whole[0] or 0, whole[1] or 1.0
    rate = F.col("weight") / F.lit(all_weight) * F.lit(all_docs) / F.col("n_docs")
    return named.select(F.col("own").alias("source"), "n_docs", rate.alias("rate"))


def _terms(mean: Column) -> Column:
    """P(at most k) of the Poisson distribution for k = 0, 1, ... as an array."""
    one = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))

    def grow(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), one, grow, lambda acc: acc["all"])


def copies(docs: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """The rows of ``docs`` with three more columns named by ``EXTRA``: rate, count of copies, and the copy (from 0)."""
    pieces = F.ceil(F.col("rate") / F.lit(PIECE)).cast("int")
    drawn = rates(docs, targets).where("rate > 0").select(
        F.col("source").alias("of"), F.col("rate").alias(EXTRA[0]), pieces.alias("pieces"), _terms(F.col("rate") / pieces).alias("terms")
    )
    per_source = durable(drawn)  # its size is known from here on, so the optimizer can tell whether to broadcast it
    rows = docs.join(per_source, docs["source"].eqNullSafe(per_source["of"]))
    draws = F.sequence(F.lit(0), per_source["pieces"] - 1)
    count = F.aggregate(
        draws,
        F.lit(0),
        lambda total, i: total + F.size(F.filter(per_source["terms"], lambda c: c <= uniform(F.lit(seed), docs["doc_id"], i))),
    )
    rows = rows.select(*(docs[c] for c in docs.columns), per_source[EXTRA[0]], count.alias(EXTRA[1]))
    return rows.where(F.col(EXTRA[1]) > 0).withColumn(EXTRA[2], F.explode(F.sequence(F.lit(0), F.col(EXTRA[1]) - 1)))


#: Names of the added columns; no table has them.
EXTRA = ("rate by mixing", "count by mixing", "copy by mixing")


def mix(docs: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """The rows of ``docs``, each as often as it was drawn, in an order shuffled over all of them."""
    drawn = copies(docs, targets, seed)
    place = uniform(F.lit(seed), F.lit("place"), docs["doc_id"], F.col(EXTRA[2]))
    return drawn.withColumn(PLACE, place).orderBy(PLACE).drop(*EXTRA, PLACE)


PLACE = "place by mixing"


def plan(docs: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """The drawn copies without their texts: ``doc_id, source, rate, n_copies, copy, place`` in the order of ``place``."""
    keys = docs.select("doc_id", "source")
    drawn = copies(keys, targets, seed)
    place = uniform(F.lit(seed), F.lit("place"), F.col("doc_id"), F.col(EXTRA[2]))
    return drawn.select(
        "doc_id",
        "source",
        F.round(EXTRA[0], 9).alias("rate"),
        F.col(EXTRA[1]).alias("n_copies"),
        F.col(EXTRA[2]).alias("copy"),
        place.alias("place"),
    ).orderBy("place", "doc_id")
