"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.tables import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(v, c): for each end of an edge (a, b) the smallest vertex that it is connected with. Every step is a join or a sum."""
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("v", "w").where("v <> w").distinct()
    both = stored(both, "edges")
    labels = stored(both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("c")), "labels")
    while True:
        of_w = labels.select(F.col("v").alias("w"), F.col("c").alias("cw"))
        least = both.join(of_w, "w").groupBy("v").agg(F.min("cw").alias("m"))
        hooked = labels.join(least, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        # what my label is labelled with is nearer to the smallest; a label is always a vertex
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("further"))
        after = stored(hooked.join(jump, "c", "left").select("v", "old", F.least("c", F.coalesce("further", "c")).alias("c")), "labels")
        discard(labels)
        if after.where("old <> c").isEmpty():
            discard(both)
            out = after.drop("old")
            out._webloom_path = after._webloom_path
            return out
        labels = after
