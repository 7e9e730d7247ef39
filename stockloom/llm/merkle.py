"""Merkle manifest of a table: a tree for each group, and one tree over the groups' roots.

Leaves are placed in their group by a range sort and one offset for each (partition, group),
so no group is ever gathered.  A *superblock* is a run of ``SPAN`` neighbouring nodes.  Going
up, every superblock hands on the one node it reduces to, until each group has one; the
groups' roots are then the leaves of one more tree.  Going down, a superblock is cogrouped
with the one row of outer nodes it needs (the siblings of its ancestors, and the roots): the
task repeats the local reduction, joins local and outer siblings to proofs and folds them.

A node passes on at most 15 siblings a level, so a proof grows with the logarithm of the group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, stored

#: Consecutive nodes that make one node, levels that a superblock reduces, and its nodes at most.
FANOUT, LEVELS = 16, 3
SPAN = FANOUT**LEVELS


def field(value: str | Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value (numbers as decimals)."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*fields: str | Column) -> Column:
    """Hash of one row: its fields, each marked by length, so no two rows run into each other."""
    return F.sha2(F.concat(*map(field, fields)), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _climb(nodes: list[str], total: int, span: int) -> list[list[str]]:
    """The levels of one superblock, its own nodes first, up to its top or the tree's root."""
    levels, width = [nodes], 1
    while width < span and (total > span or len(levels[-1]) > 1):
        below = levels[-1]
        levels.append([_hash("".join(below[i : i + FANOUT])) for i in range(0, len(below), FANOUT)])
        width *= FANOUT
    return levels


def _sides(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """What stands left and right of node ``i`` and of its ancestors within their runs."""
    out = []
    for level in levels[:-1]:
        run = i // FANOUT
        out.append(("".join(level[run * FANOUT : i]), "".join(level[i + 1 : (run + 1) * FANOUT])))
        i = run
    return out


def place(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree, key, digest, ...) with their place in the tree by (key, digest) and its total.

    Equal nodes of one key are interchangeable, so the row number that splits them decides nothing.
    """
    n = parts(nodes.sparkSession)
    order = ["tree", "key", "digest", "_row"]
    rows = nodes.withColumn("_row", F.monotonically_increasing_id())
    dealt = stored(rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
                   .withColumn("_part", F.spark_partition_id()).withColumn("_slot", F.monotonically_increasing_id()), "placed")
    cells = dealt.groupBy("_part", "tree").agg(F.min("_slot").alias("_first"), F.count(F.lit(1)).alias("_n"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_part", "tree", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                         F.sum("_n").over(tree).alias("total"))
    return (dealt.join(cells, ["_part", "tree"]).withColumn("place", F.col("_slot") + F.col("_shift"))
            .drop("_part", "_slot", "_shift", "_row"))


def _blocks(nodes: DataFrame, span: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"place div {span}"))


def rise(nodes: DataFrame, span: int) -> list[DataFrame]:
    """``nodes`` and the superblock tops above them, until every tree has one node left."""

    def top(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        total = int(pdf["total"].iat[0])
        digest = _climb(pdf["digest"].tolist(), total, span)[-1][0]
        return pd.DataFrame({"tree": [pdf["tree"].iat[0]], "place": [pdf["block"].iat[0]], "total": [-(-total // span)], "digest": [digest]})

    out = [nodes]
    while (out[-1].agg(F.max("total").alias("n")).first()["n"] or 1) > 1:
        rows = _blocks(out[-1].select("tree", "place", "total", "digest"), span)
        out.append(stored(rows.groupBy("tree", "block").applyInPandas(top, "tree string, place long, total long, digest string"), "tops"))
    return out


def descend(nodes: DataFrame, outer: DataFrame, span: int) -> DataFrame:
    """Every node's siblings up to the root: (tree, name, place, digest, lefts, rights, subroot, root).

    ``outer`` has one row for each superblock (tree, block) with what lies above it.
    """

    def paths(own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        own, up = own.sort_values("place"), above.iloc[0]
        levels = _climb(own["digest"].tolist(), int(own["total"].iat[0]), span)
        sides = [_sides(levels, i) for i in range(len(own))]
        return pd.DataFrame({
            "tree": own["tree"], "name": own["name"], "place": own["place"], "digest": own["digest"],
            "lefts": [[a for a, _ in s] + list(up["lefts"]) for s in sides], "rights": [[b for _, b in s] + list(up["rights"]) for s in sides],
            "subroot": up["subroot"], "root": up["root"]})

    schema = "tree string, name string, place long, digest string, lefts array<string>, rights array<string>, subroot string, root string"
    return _blocks(nodes, span).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(paths, schema)


def _down(levels: list[DataFrame], outer: DataFrame, span: int) -> DataFrame:
    """The outer rows that the lowest level of ``levels`` needs."""
    for nodes in reversed(levels[1:]):
        found = descend(nodes.withColumn("name", F.lit(None).cast("string")), outer, span)
        outer = stored(found.select("tree", F.col("place").alias("block"), "lefts", "rights", "subroot", "root"), "outer")
    return outer


def manifest(leaves: DataFrame, order: str, group: str, leaf: str, presented: str | None = None, proofs: bool = False,
             levels: int = LEVELS) -> DataFrame:
    """Roots and membership proofs of ``leaves``, one row for each of its rows.

    ``group`` names the tree of a row (null is a tree of its own and comes first), ``order``
    its place in it (null first; rows that tie go by their hash), ``leaf`` its hash, and
    ``presented`` the hash that is shown to the verifier (null or no column: the leaf).
    Every ``FANOUT`` consecutive nodes, the last run fewer, make the hash of their joined hex
    digests until one is left: the subroot.  Subroots in bytewise order of their groups make
    the root likewise.

    Returns (order, leaf, subroot, root, proof_sha256, folded_root, verified) and, with
    ``proofs``, the proof itself: an array of (left, right) sibling digests from the leaf to
    the root.  Repeated rows are leaves of their own.  Other columns of ``leaves`` do not
    matter.  An empty table gives no rows.  ``levels`` is the height of a superblock.
    """
    span = FANOUT**levels
    shown = F.coalesce(F.col(presented), F.col(leaf)) if presented else F.col(leaf)
    # '' is the null group and sorts before every other; the sign keeps an empty name apart.
    tree = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group)))
    # Hashes are taken from the texts once: the range sort samples and then reads the written ones.
    rows = stored(leaves.select(tree.alias("tree"), F.col(order).alias("key"), F.col(leaf).alias("digest"), shown.alias("shown")), "leaves")
    ground = stored(place(rows), "ground")
    trees = rise(ground, span)
    tops = stored(place(trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest")), "subroots")
    forest = rise(tops, span)
    none = F.array().cast("array<string>")
    crown = forest[-1].select("tree", F.lit(0).cast("long").alias("block"), none.alias("lefts"), none.alias("rights"),
                              F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    ways = descend(tops.withColumn("name", F.col("key")), _down(forest, crown, span), span)
    outer = stored(ways.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), "lefts", "rights",
                               F.col("digest").alias("subroot"), "root"), "crowns")
    outer = _down(trees, outer, span)

    def finish(own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        own, up = own.sort_values("place"), above.iloc[0]
        local = _climb(own["digest"].tolist(), int(own["total"].iat[0]), span)
        beyond = list(zip(up["lefts"], up["rights"], strict=True))
        proof, folded, kept = [], [], []
        for i, node in enumerate(own["shown"]):
            path = _sides(local, i) + beyond
            proof.append(_hash("".join(a + b for a, b in path)))
            for a, b in path:
                node = _hash(a + node + b)
            folded.append(node)
            kept.append([{"left": a, "right": b} for a, b in path] if proofs else None)
        out = pd.DataFrame({"key": own["key"], "leaf": own["digest"], "subroot": up["subroot"], "root": up["root"], "proof_sha256": proof,
                            "folded_root": folded, "verified": [f == up["root"] for f in folded]})
        return out.assign(proof=kept) if proofs else out

    kind = rows.schema["key"].dataType
    ground = ground.withColumn("key", F.col("key").cast("string"))  # pandas has no long with nulls
    schema = "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    both = _blocks(ground, span).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
    done = both.applyInPandas(finish, schema + (", proof array<struct<left:string,right:string>>" if proofs else ""))
    return done.withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", order)


def folds(proof: Sequence[tuple[str, str]], leaf: str) -> str:
    """The root that a leaf and its proof give; a reader needs nothing else of the table."""
    for left, right in proof:
        leaf = _hash(left + leaf + right)
    return leaf
