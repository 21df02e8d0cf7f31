"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Rounds, cut

#: Rounds after which contraction is given up; each is expected to halve the nodes at least.
MAX_ROUNDS = 100


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the smallest node that links reach.

    In each round every node goes to the one of itself and its neighbours that has most
    neighbours (in a new random order where those are as many), and links between what
    is left are the next round's; so a star is done in one round, and a chain about halves. Links and
    nodes stay distributed; only counts reach the driver. Null ends, loops and
    repeated links add nothing.
    """
    with Rounds(links.sparkSession) as rounds:
        links = links.filter("a is not null and b is not null and a <> b").select("a", "b")
        links = rounds.keep(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        nodes = links.select(F.col("a").alias("node"), F.col("a").alias("at")).distinct()
        for seed in range(MAX_ROUNDS):
            if links.isEmpty():
                break
            rank = F.struct((-F.count(F.lit(1))).alias("n"), F.xxhash64(F.lit(seed), "a").alias("h"), F.col("a").alias("to"))
            ranks = links.groupBy("a").agg(rank.alias("rank")).withColumnRenamed("a", "of")
            near = links.join(ranks, F.col("b") == F.col("of")).groupBy("a").agg(F.min("rank").alias("near"))
            moves = rounds.keep(near.join(ranks, F.col("a") == F.col("of")).select("of", F.least("near", "rank")["to"].alias("to")))
            nodes = rounds.keep(nodes.join(moves, F.col("at") == F.col("of"), "left").select("node", F.coalesce("to", "at").alias("at")))
            left, right = moves.select(F.col("of").alias("a"), F.col("to").alias("na")), moves.select(F.col("of").alias("b"), F.col("to").alias("nb"))
            links = rounds.keep(links.join(left, "a").join(right, "b").filter("na <> nb").select(F.col("na").alias("a"), F.col("nb").alias("b")).distinct())
        else:
            raise RuntimeError("contraction did not end")
        smallest = nodes.groupBy("at").agg(F.min("node").alias("component"))
        return cut(nodes.join(smallest, "at").select("node", "component"))
