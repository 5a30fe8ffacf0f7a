"""Connected components of a link table, in DataFrames.

Label propagation with pointer jumping: every node takes the least label among
itself and its neighbours, then the label of its label, so a path of length n
needs about log n rounds.  Lineage is cut by a written table each round.  Both
steps pre-aggregate before they shuffle.  The join that sends labels along links
is keyed by the neighbour, so a hub's links meet there; adaptive execution splits
such a partition, as its other side is one row a key.  A round's tables are
deleted when the next round's are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.shared import discard, materialise


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for nodes with a link.

    An empty link table gives an empty result; self links and repeated links
    are harmless.
    """
    edges = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct()
    edges = materialise(edges, "links")
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("to")).union(edges.select(F.col("v").alias("node"), F.col("u").alias("to")))
    labels = materialise(both.groupBy("node").agg(F.min("to").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    first = labels
    for _ in range(rounds):
        # large star: what neighbours hold, the least of it for each node and for each node's present label
        seen = both.join(labels.withColumnRenamed("node", "to"), "to").groupBy("node").agg(F.min("component").alias("c"))
        near = labels.join(seen, "node").select("node", F.col("component").alias("was"), F.least("component", "c").alias("now"))
        near = materialise(near, "near")
        roots = near.groupBy(F.col("was").alias("root")).agg(F.min("now").alias("best"))
        step = near.join(roots, near.now == roots.root, "left").select("node", "was", F.least("now", F.coalesce("best", "now")).alias("now"))
        step = materialise(step, "step")
        changed = step.where("was <> now").limit(1).count()
        discard(near, first)
        first = step
        labels = step.select("node", F.col("now").alias("component"))
        if not changed:
            discard(edges)
            labels._quaver_folder = step._quaver_folder  # the caller may discard it
            return labels
    raise RuntimeError("components did not settle")
