"""Operator 13: Merkle manifest of a table.

Every row is a leaf; the leaves of a group, in order, are hashed level by level into the
group's subroot, and the subroots into one root.  A level is a window over (group, parent):
its ordered full-frame collect_list holds each child once, by the child's first leaf, and so
gives both the parent's preimage and every child's siblings.  Parents are then one row each.

``LEVELS`` levels lie inside a block of consecutive leaves, and one exchange by block serves all
of them; above, one row for each block goes on, so a tree over n leaves costs
log(n) / LEVELS exchanges of geometrically fewer rows.  No window holds more than a block.

Defined results: ``H`` is the lowercase hexadecimal SHA-256 of its inputs as UTF-8, one behind
the other.  A null value is ``-``.  Null groups come first and are one group, null ids come first
in theirs; rows of one id go by their leaf, so repeated rows stay and their order cannot matter.
An empty table gives no rows.  Columns that are not named are not hashed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import materialise
from matchloom.llm.ranking import looked_up, ranked

#: Levels that one exchange serves; a block has arity ** LEVELS leaves.
LEVELS = 9
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts: Column) -> Column:  # noqa: N802
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(columns: Sequence[str], instead: Mapping[str, Column] | None = None) -> Column:
    """H of the columns' values, each with its length; ``instead`` replaces values."""
    parts = []
    for c in columns:
        value = (instead or {}).get(c, F.col(f"`{c}`")).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return H(*parts)


def _climb(nodes: DataFrame, arity: int) -> DataFrame:
    """LEVELS levels up: each row's digest becomes its ancestor's, and ``steps`` the siblings on the way."""
    size = arity**LEVELS
    out = nodes.withColumns({"_block": F.expr(f"place div {size}"), "steps": F.array().cast("array<struct<left: string, right: string>>")}).repartition("tree", "_block")
    for level in range(LEVELS):
        span = arity**level
        alive, child = F.col("rows") > span, F.expr(f"place div {span}")
        out = out.withColumn("_parent", F.expr(f"place div {span * arity}"))
        frame = Window.partitionBy("tree", "_block", "_parent").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        out = out.withColumn("_kids", F.collect_list(F.when(F.col("place") % span == 0, F.col("digest"))).over(frame))
        mine = (child % arity).cast("int")
        join = lambda kids: F.array_join(kids, "")
        step = F.struct(join(F.slice("_kids", F.lit(1), mine)).alias("left"), join(F.slice("_kids", mine + 2, F.lit(arity))).alias("right"))
        out = out.withColumns({"steps": F.when(alive, F.concat("steps", F.array(step))).otherwise(F.col("steps")), "digest": F.when(alive, H(join(F.col("_kids")))).otherwise(F.col("digest"))})
    return out.drop("_parent", "_kids")


def trees(nodes: DataFrame, arity: int, tag: str) -> tuple[DataFrame, DataFrame]:
    """nodes (tree, place, rows, digest, others) to the same rows with ``steps`` and top, and one row (tree, top) for each tree.

    ``steps`` lists, from the leaf up, what stands left and right of the node among its parent's children.
    """
    size, rounds, current = arity**LEVELS, [], nodes
    while True:
        done = materialise(_climb(current, arity), f"{tag}-{len(rounds)}")
        rounds.append(done)
        current = done.where(F.col("place") % size == 0).select("tree", F.col("_block").alias("place"), F.expr(f"(rows + {size - 1}) div {size}").alias("rows"), "digest")
        if current.where("rows > 1").isEmpty():
            break
    tops = current.select("tree", F.col("digest").alias("top"))
    found = rounds.pop().withColumnRenamed("digest", "top")
    while rounds:
        below = rounds.pop()
        above = found.select(F.col("tree").alias("_t"), F.col("place").alias("_p"), F.col("steps").alias("_up"), F.col("top"))
        found = below.drop("digest").join(above, (F.col("tree") == F.col("_t")) & (F.col("_block") == F.col("_p"))).withColumn("steps", F.concat("steps", "_up")).drop("_t", "_p", "_up")
    return found.drop("_block"), tops


def fold(digest: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, digest, lambda acc, s: H(s["left"], acc, s["right"]))


def manifest(docs: DataFrame, group: str = "lang", key: str = "doc_id", columns: Sequence[str] = COLUMNS, arity: int = 2, claimed: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: key, leaf, subroot, root, proof (list of steps), folded_root, verified.

    ``claimed`` replaces values of columns in the leaves that are to be proved; without it every
    row proves itself.  verified tells whether the claimed leaf and the siblings lead to the root.
    """
    leaves = docs.select(F.col(f"`{group}`").alias("_group"), F.col(f"`{key}`").alias("_key"), leaf_hash(columns).alias("leaf"), leaf_hash(columns, claimed).alias("_claimed"))
    placed = ranked(leaves, ["_group"], [F.col("_key").asc_nulls_first(), F.col("leaf").asc()], "merkle-leaves")
    groups = ranked(placed.groupBy("_group").agg(F.count("*").alias("_n")), [], [F.col("_group").asc_nulls_first()], "merkle-groups", "tree", "_trees")
    groups = groups.select("_group", "tree", "_trees")
    nodes = looked_up(placed, groups, ["_group"]).select("tree", "place", "rows", F.col("leaf").alias("digest"), "leaf", "_key", "_claimed", "_trees")
    below, subroots = trees(nodes, arity, "merkle")
    tops = looked_up(subroots, groups.select("tree", "_trees"), ["tree"]).select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("_trees").alias("rows"), F.col("top").alias("digest"))
    above, _ = trees(tops, arity, "merkle-top")
    above = above.select(F.col("place").alias("tree"), F.col("steps").alias("_up"), F.col("top").alias("root"))
    proofs = looked_up(below, above, ["tree"]).withColumn("proof", F.concat("steps", "_up"))
    folded = proofs.withColumn("folded_root", fold(F.col("_claimed"), F.col("proof")))
    return folded.select(F.col("_key").alias(key), "leaf", F.col("top").alias("subroot"), "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def proof_digest(proof: Column) -> Column:
    """H of all siblings of a proof, from the leaf up and from left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)
