"""Connected components of a link table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.session import new_folder, remove_folders


def component_labels(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``links(a, b)``; label is the least node reached.

    Each round takes the least label of all neighbours and then the label of that
    label, so a chain of n nodes needs about log n rounds.  Rounds are written to
    the shared folder; the previous one is deleted.  No link is collected: only the
    question whether any label changed reaches the driver.  Null or self links
    and repeated links change nothing.
    """
    spark = links.sparkSession
    clean = links.where("a is not null and b is not null and a <> b")
    both = clean.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(
        clean.select(F.col("b").alias("src"), F.col("a").alias("dst"))
    )
    edge_path = new_folder(spark, "links")
    both.distinct().write.parquet(edge_path)
    edges = spark.read.parquet(edge_path)
    path = new_folder(spark, "labels")
    edges.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select(
        "node", F.least("node", "m").alias("label"), F.lit(True).alias("changed")
    ).write.parquet(path)
    while True:
        labels = spark.read.parquet(path)
        if labels.where("changed").isEmpty():
            return labels.select("node", "label")
        known = labels.select("node", "label")
        least = (
            edges.join(known.withColumnRenamed("node", "dst"), "dst")
            .groupBy(F.col("src").alias("node"))
            .agg(F.min("label").alias("m"))
        )
        better = known.join(least, "node").select("node", "label", F.least("label", "m").alias("l2"))
        jumped = better.join(known.select(F.col("node").alias("l2"), F.col("label").alias("l3")), "l2")
        path, old = new_folder(spark, "labels"), path
        jumped.select("node", F.col("l3").alias("label"), (F.col("l3") != F.col("label")).alias("changed")).write.parquet(path)
        remove_folders(spark, old)
