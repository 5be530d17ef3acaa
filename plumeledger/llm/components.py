"""Connected components of a table of links by contraction: every node takes the name of its least neighbour, again and again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeledger.llm.shared import written

#: Rows up to which a side whose rows were counted is sent to every task; beyond that the join shuffles both sides.
SMALL_ROWS = 500_000
#: Links of a task, where a table's rows were counted.
TASK_ROWS = 200_000


def join_counted(big: DataFrame, small: DataFrame, on, how: str = "inner", limit: int = SMALL_ROWS, rows: int | None = None) -> DataFrame:
    """Join with a written table of that many rows (None: count them): broadcast if they are few, else by sorted merge, whose hot keys adaptive execution splits."""
    few = (small.count() if rows is None else rows) <= limit
    return big.join(F.broadcast(small) if few else small.hint("merge"), on, how)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link (two bigint columns); root is the least node of its component.

    In each round a node is renamed to the least of itself and its neighbours, links to links of the new names, and
    links within one name go. The least node of a component never changes its name, so when no link is left all have it. A star
    takes two rounds at most, a chain about as many as its length has bits. The minimum is combined before
    its shuffle, so a node with any number of links is no burden to one task. Each round is written to the shared folder:
    lineage stays short, and a lost executor costs one round. Links of a node to itself and nulls are left
    out; an empty table gives no rows.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = written(e, "links")
    names, n = None, e.count()
    while True:
        parts = n // TASK_ROWS + 1
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
        least = written(least.coalesce(parts), "links-least")
        rows = min(2 * n, least.count())
        if names is None:
            names = least.select(F.col("k").alias("node"), F.col("m").alias("root"))
        else:
            renamed = join_counted(names, least, names.root == least.k, "left", rows=rows)
            names = written(renamed.select("node", F.coalesce("m", "root").alias("root")), "links-names")
        if not n:
            return names
        x, y = least.select(F.col("k").alias("ku"), F.col("m").alias("mu")), least.select(F.col("k").alias("kv"), F.col("m").alias("mv"))
        e = join_counted(join_counted(e, x, F.col("u") == F.col("ku"), rows=rows), y, F.col("v") == F.col("kv"), rows=rows)
        e = e.select(F.greatest("mu", "mv").alias("u"), F.least("mu", "mv").alias("v")).where("u <> v").distinct()
        e = written(e.coalesce(parts), "links")
        n = e.count()
        if not n:
            return names
