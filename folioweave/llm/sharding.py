"""Global shuffle into shards by a two-pass external shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folioweave.llm.common import row_id
from folioweave.session import new_folder, stage_table

#: Text bytes of a bucket, which one task holds in memory.
BUCKET_BYTES = 32 << 20


def shuffle_into_shards(
    docs: DataFrame, shards: int = 16, seed: int = 17, id_col: str = "doc_id", text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES, folder: str | None = None,
) -> DataFrame:
    """Write all rows in random order as ``shard=<n>`` folders of Parquet files and return them.

    Pass 1 scatters the rows over buckets of about ``bucket_bytes`` by a seeded
    hash of the id; an id whose rows hold more than a quarter of that is spread by
    text and row number as well.  Pass 2 takes one bucket at a time, brings it into a fixed
    order and applies a Fisher-Yates shuffle seeded by the bucket.  Buckets follow
    one another, and the whole order is cut into shards that differ by at most one
    row; so a bucket is written to one shard, or two where a cut falls into it.  The result has the input's columns and ``shard`` int and ``slot`` bigint
    (gapless from 0 in each shard); input columns of these two names are replaced.

    Equal rows are dealt like any others; ids, texts and other columns may be null.
    The result depends on the rows, the seed and the number of buckets, not on how
    the input is partitioned, unless an id is so frequent that row numbers decide;
    these are repeatable for a table that is read from files.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    plain = docs.drop("shard", "slot")
    names = plain.columns
    total = plain.agg(F.sum(F.octet_length(text_col)).alias("size"), F.count(F.lit(1)).alias("n")).first()
    cuts = np.arange(shards + 1) * total["n"] // shards
    buckets = max(-(-(total["size"] or 0) // bucket_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # at most one id for each quarter of a bucket
    frequent = plain.groupBy(F.col(id_col).alias("__id")).agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).alias("__size"))
    frequent = stage_table(frequent.where(F.col("__size") > bucket_bytes // 4))
    numbered = plain.withColumn("__row", row_id())
    rows = numbered.join(F.broadcast(frequent), F.col(id_col).eqNullSafe(F.col("__id")), "left")
    spread = F.when(F.col("__size").isNotNull(), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), F.col("__row")))
    bucket = F.pmod(F.coalesce(spread, F.xxhash64(F.lit(seed), F.col(id_col))), F.lit(buckets)).cast("int").alias("__bucket")
    # one short row for each bucket, not for each document
    counts = rows.select(bucket).groupBy("__bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("__bucket", (F.sum("n").over(Window.orderBy("__bucket")) - F.col("n")).alias("first"))
    schema = T.StructType([*plain.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def deal(key, members: pa.Table, place: pa.Table) -> pa.Table:
        members = members.select(names)
        if not members.num_rows:
            return members.append_column("shard", pa.array([], pa.int32())).append_column("slot", pa.array([], pa.int64()))
        marks = pa.table({"i": members.column(id_col), "t": pc.fill_null(members.column(text_col), "")})
        fixed = pc.sort_indices(marks, sort_keys=[("i", "ascending"), ("t", "ascending")]).to_numpy()
        order = np.random.default_rng([seed, key[0].as_py()]).permutation(fixed)
        at = place.column("first")[0].as_py() + np.arange(len(order))
        shard = np.searchsorted(cuts, at, side="right") - 1
        taken = members.take(pa.array(order))
        return taken.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(at - cuts[shard]))

    dealt = rows.select(*names, bucket).groupBy("__bucket").cogroup(before.groupBy("__bucket")).applyInArrow(deal, schema)
    folder = folder or new_folder(spark, "shards")
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    return spark.read.schema(schema).parquet(folder)
