"""Connected components of links between identifiers, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import Staged


def components(links: DataFrame, stage: Staged) -> DataFrame:
    """(v, c): every identifier of ``links`` (a, b), with the smallest one it reaches.

    Each round takes the smallest label among the neighbours and then the label of that label;
    rounds are written to the shared folder, so plans stay short. Labels only fall, and the
    loop ends with the first round that changes none.
    """
    both = stage.write(links.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(links.select(F.col("b").alias("v"), F.col("a").alias("u"))).distinct())
    now = stage.write(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("c")))
    while True:
        near = both.join(now.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("c").alias("n"))
        low = now.join(near, "v").select("v", F.col("c").alias("was"), F.least("c", "n").alias("c"))
        up = now.select(F.col("v").alias("c"), F.col("c").alias("top"))
        new = stage.write(low.join(up, "c", "left").select("v", "was", F.coalesce("top", "c").alias("c")))
        done = not new.filter("c <> was").take(1)
        old, now = now, new.select("v", "c")
        now._staged_at = new._staged_at
        stage.drop(old)
        if done:
            return now
