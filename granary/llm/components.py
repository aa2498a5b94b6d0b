"""Connected components of a graph whose edges are a DataFrame, by label propagation.

Every node has a label, a node of its component that is not larger; labels so form trees. In each round a
node looks at its neighbours' labels' labels: the least of them becomes its own label and, if it is less,
that of its label, so whole trees hook onto others at once; then each tree is halved in depth. Rounds grow
with the logarithm of the longest chain, whatever the order of its ids, and end when no label moves. Each
round's labels are a written table, so a lost executor repeats one round at most, and joins with it can
be split where a node has very many edges. No edge or label is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for each node of an edge; label is the least node that it is connected to.
    Null ends are ignored, repeated edges and loops do no harm, no edges give no rows."""
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = ends.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = materialise(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges", narrow=True)
    labels = materialise(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")), "labels", narrow=True)
    while True:
        # The label of the label: labels are nodes, so the join finds each.
        high = labels.join(labels.select(F.col("node").alias("label"), F.col("label").alias("up")), "label")
        near = both.join(high.select(F.col("node").alias("other"), F.col("up").alias("seen")), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        all_ = high.join(near, "node")
        own = all_.select("node", F.col("label").alias("old"), F.least("label", "up", "seen").alias("new"))
        hooked = all_.select(F.col("label").alias("node"), F.lit(None).cast("bigint").alias("old"), F.col("seen").alias("new"))
        made = own.unionByName(hooked).groupBy("node").agg(F.max("old").alias("old"), F.min("new").alias("label"))
        made = materialise(made, "labels", narrow=True)
        labels = made.select("node", "label")
        if made.where("old <> label").isEmpty():
            return labels
