"""Connected components by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, unstage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node that has a smaller one in its component, with the smallest.

    Every round applies large-star (each node hands its larger neighbours to its smallest one) and
    small-star (each node links its smaller neighbours to the smallest) until no edge changes; the
    number of rounds grows with the logarithm of the component size. Null ends and self-links are
    ignored; repeated edges count once; no edges give an empty table.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    links = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = stage(links.select(high.cast("long").alias("hi"), low.cast("long").alias("lo")).distinct(), "links")
    signature = None
    while True:
        now = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
        if now == signature or now["n"] == 0:
            return links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        signature = now
        least = links.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("lo"), "m")
        large = links.join(least, "lo", "left").select("hi", F.coalesce("m", "lo").alias("lo")).distinct()
        least_of = F.min("lo").over(Window.partitionBy("hi"))
        starred = large.withColumn("m", least_of).select(
            F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")
        )
        before, links = links, stage(starred.select("e.hi", "e.lo").where("hi != lo").distinct(), "links")
        unstage(before)
