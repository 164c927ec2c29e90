"""Candidates for observations: number equal or name contained, at most a few each.

An OR across two keys would plan as one nested loop.  Here each key is joined by itself, and
the limit is pushed below the joins: of all cards with a number (or name, or both) only the
first ``limit`` by id can ever be among an observation's first ``limit``, so each key keeps
that many cards and the joins' output is bounded by observations x 3 x limit whatever the
catalog holds.  Only distinct observed keys are joined with cards.

Order: cards that match both keys, then number matches, then name matches; then by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of the pieces that names are joined on; names without a piece of the first length have one of the next.
PIECES = (3, 2, 1)


def _first(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("card_id")
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def _pieces(name: str, size: int) -> Column:
    """Distinct parts of that many characters."""
    at = F.sequence(F.lit(1), F.greatest(F.length(name) - (size - 1), F.lit(1)))
    return F.filter(F.array_distinct(F.transform(at, lambda k: F.substring(name, k, F.lit(size)))), lambda x: F.length(x) == size)


def contained_names(observed: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (obs_name, card_name) of distinct names with card_name LIKE %obs_name%.

    A piece of the observed name without a wildcard must be in the card's name as it stands, so the pairs
    come from an equi-join on pieces; the rest of the pattern is then checked.  Each observed name is
    joined on the piece of its own that fewest known names have, so that a common one is no hot key.
    Names of wildcards alone, of which there is one for each length, are compared with all names.
    """
    like = F.expr("card_name LIKE concat('%', obs_name, '%')")
    plain = [F.filter(_pieces("obs_name", size), lambda x: ~x.contains("_")) for size in PIECES]
    usable = F.lit(None)
    for pieces in reversed(plain):
        usable = F.when(F.size(pieces) > 0, pieces).otherwise(usable)
    names = observed.select("obs_name", usable.alias("pieces"))
    grams = known.select("card_name", F.explode(F.concat(*[_pieces("card_name", size) for size in PIECES])).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    # A piece that no known name has decides the matter: it is the rarest, and joins with nothing.
    counted = names.select("obs_name", F.explode("pieces").alias("gram")).join(counts, "gram", "left")
    rarest = counted.groupBy("obs_name").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    found = rarest.join(grams, "gram").where(like).select("obs_name", "card_name")
    wild = names.where("pieces IS NULL AND obs_name != ''").select("obs_name")
    return found.unionByName(known.join(F.broadcast(wild), like).select("obs_name", "card_name"))


def block(observations: DataFrame, catalog: DataFrame, limit: int = 8) -> DataFrame:
    """observations (scan_id, obs_name, obs_number) x catalog (card_id, normalized_name, collector_number).

    Rows: scan_id, card_id, retrieval_rank (from 1).  An observation with neither key has none.
    """
    keys = observations.select("obs_name", "obs_number").distinct().where("obs_name IS NOT NULL OR obs_number IS NOT NULL")
    cards = catalog.select("card_id", F.col("normalized_name").alias("card_name"), F.col("collector_number").alias("card_number"))
    names = contained_names(keys.select("obs_name").where("obs_name IS NOT NULL").distinct(), cards.select("card_name").distinct())

    by_number = _first(cards, ["card_number"], limit).withColumnRenamed("card_number", "obs_number")
    by_name = _first(names.join(_first(cards, ["card_name"], limit), "card_name"), ["obs_name"], limit)
    per_pair = _first(cards, ["card_name", "card_number"], limit)
    by_both = keys.join(names, "obs_name").join(per_pair.withColumnRenamed("card_number", "obs_number"), ["card_name", "obs_number"])

    shape = ["obs_name", "obs_number", "card_id", "kind"]
    hits = (
        by_both.withColumn("kind", F.lit(0)).select(*shape)
        .unionByName(keys.join(by_number, "obs_number").withColumn("kind", F.lit(1)).select(*shape))
        .unionByName(keys.join(by_name.select("obs_name", "card_id"), "obs_name").withColumn("kind", F.lit(2)).select(*shape))
    )
    best = hits.groupBy("obs_name", "obs_number", "card_id").agg(F.min("kind").alias("kind"))
    order = Window.partitionBy("obs_name", "obs_number").orderBy("kind", "card_id")
    ranked = best.withColumn("retrieval_rank", F.row_number().over(order)).where(F.col("retrieval_rank") <= limit)
    seen = observations.select("scan_id", F.col("obs_name").alias("_name"), F.col("obs_number").alias("_number"))
    joined = seen.join(ranked, seen["_name"].eqNullSafe(ranked["obs_name"]) & seen["_number"].eqNullSafe(ranked["obs_number"]))
    return joined.select("scan_id", "card_id", "retrieval_rank")
