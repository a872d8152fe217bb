"""Groups of linked items, by the least id that links reach."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..sources.tables import shared_folder


def connected(links: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(id, root) of every id in `links`: the least id that can be reached from it.

    Each round an id takes the least root among its own and its neighbours', and then that root's own
    root; so paths halve, and the rounds grow with the logarithm of the longest one. A round is written
    to the shared folder before the next. A link without one of its ids is none.
    """
    spark = links.sparkSession
    folder = f"{shared_folder(spark)}/groups-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    one = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = kept(one.unionByName(one.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    roots = kept(both.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.col("id")).alias("root")), "0")
    for k in range(1, most):
        near = both.join(roots.select(F.col("id").alias("y"), "root"), "y").groupBy(F.col("x").alias("id")).agg(F.min("root").alias("near"))
        least = roots.join(near, "id").select("id", F.least("root", "near").alias("least"), "root")
        jump = roots.select(F.col("id").alias("least"), F.col("root").alias("jump"))
        moved = kept(least.join(jump, "least").select("id", F.least("least", "jump").alias("new"), "root"), str(k))
        changed = moved.where("new <> root").limit(1).count()
        roots = moved.select("id", F.col("new").alias("root"))
        if not changed:
            return roots
    raise RuntimeError("the groups did not settle")
