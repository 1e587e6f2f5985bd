"""Connected components by minimum labels with pointer jumping, as distributed joins; links never reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import cut


#: Links that one task of a round works on, about.
TASK_LINKS = 100_000


def in_few(rows: DataFrame, most: int) -> DataFrame:
    """rows, at most so many, in as many tasks as these ask for: small tables aren't strewn over a file for each shuffle partition."""
    tasks = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-most // TASK_LINKS) or 1)
    return rows.coalesce(tasks)


def components(links: DataFrame) -> DataFrame:
    """Rows (v, c) for each end of links (a, b): c is the least vertex that v reaches. Any orderable type; empty links give no rows.

    links: a written table. A round takes the least label among neighbours, then the label of that label, so labels travel twice as far
    each time. Minima are taken before shuffling; joins on a vertex with many links are split at run time like any skewed join. Rounds
    run in as many tasks as their links ask for.
    """
    size = links.count()
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut(in_few(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("c")), size))
    while True:
        near = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("c").alias("n"))
        taken = labels.join(near, F.col("v") == F.col("a")).select("v", F.col("c").alias("old"), F.least("c", "n").alias("c"))
        of = labels.select(F.col("v").alias("w"), F.col("c").alias("d"))
        after = cut(in_few(taken.join(of, F.col("c") == F.col("w"), "left").select("v", "old", F.least("c", F.coalesce("d", "c")).alias("c")), size))
        moved = after.filter(F.col("c") != F.col("old")).limit(1).count()
        labels = after.select("v", "c")
        if not moved:
            return labels
