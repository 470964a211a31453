"""Connected components of a link table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``(a long, b long)`` links -> ``(v long, root long)``: each linked vertex and its component's smallest.

    Every round hooks each label onto its smallest lower neighbour, jumps
    pointers and maps the links to the new labels; links inside a
    component vanish.  Hooks always point downwards, so there are no cycles.
    Rounds are stored in the shared folder.  Null ends and self-links are
    ignored; no links give no rows.
    """
    ends = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    links = stored(
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(*ends).distinct(),
        "links",
    )
    # What follows has at most one row per link, or two for the labels.
    size = links.count()
    labels = links.select(F.explode(F.array("lo", "hi")).alias("v")).distinct().select("v", F.col("v").alias("root"))
    labels = stored(labels, "labels", 2 * size)
    while not links.isEmpty():
        hooks = stored(links.groupBy(F.col("hi").alias("at")).agg(F.min("lo").alias("to")), "hooks", size)
        further = hooks.select(F.col("at").alias("to"), F.col("to").alias("next"))
        hooks = stored(hooks.join(further, "to", "left").select("at", F.coalesce("next", "to").alias("to")), "hooks", size)
        labels = stored(
            labels.join(hooks.withColumnRenamed("at", "root"), "root", "left").select(
                "v", F.coalesce("to", "root").alias("root")
            ),
            "labels",
            2 * size,
        )
        low = hooks.select(F.col("at").alias("lo"), F.col("to").alias("lo_to"))
        high = hooks.select(F.col("at").alias("hi"), F.col("to").alias("hi_to"))
        links = stored(
            links.join(low, "lo", "left")
            .join(high, "hi", "left")
            .select(F.coalesce("lo_to", "lo").alias("a"), F.coalesce("hi_to", "hi").alias("b"))
            .where(F.col("a") != F.col("b"))
            .select(*ends)
            .distinct(),
            "links",
            size,
        )
    return labels
