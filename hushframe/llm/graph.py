"""Connected components of a link table, as alternating star contractions.

Each round turns neighbours towards their smallest neighbour, once among larger
ones and once among smaller ones, until every node points at the smallest node of
its component.  Minima are counted partially before the shuffle and joined back,
so a node linked to a third of all others is no list in one task, and adaptive
execution can split its rows in the join.  Every round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import staged


def _links(df: DataFrame) -> DataFrame:
    return df.filter(F.col("a") != F.col("b")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    return _links(both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    turned = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _links(turned.unionByName(least.select("a", F.col("m").alias("b"))))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of (a, b) that is not itself its root.

    Links are undirected; repeated links and loops do no harm, a link with a null
    end is no link, and a table without links gives an empty result.
    """
    current = staged(_links(links.select("a", "b").dropna()), "links")
    state = _state(current)
    while state[0]:
        following = staged(_small_star(_large_star(current)), "links")
        after = _state(following)
        current = following
        if after == state:
            break
        state = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
