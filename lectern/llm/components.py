"""Connected components of a table of links by minimum labels, one small table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every id in `links` (a, b): label is the smallest id that it is linked with over any number of links.

    In a round every id takes the least label among itself and its neighbours, then its label's own label, so that the
    rounds follow the logarithm of a chain's length. Minima are combined before they are shuffled; the rows of a hub, or of
    a large component's label, are narrow, and their joins are split by adaptive execution where they grow large. A link
    repeated, or of an id with itself, adds nothing; links of a null id are left out. No links give no rows.
    """
    links = links.where("a is not null and b is not null")
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("n")).select("id", F.least("id", "n").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        taken = labels.join(near, labels["id"] == near["a"]).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        own = taken.select(F.col("id").alias("of"), F.col("label").alias("next"))
        moved = materialize(taken.join(own, taken["label"] == own["of"], "left").select("id", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        labels = moved.select("id", "label")
        if moved.where("old <> label").isEmpty():
            return labels
