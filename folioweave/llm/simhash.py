"""Near-duplicate groups by SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

from functools import partial
from itertools import accumulate, combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.common import folded_words, grouped_runs, map_slices, row_id
from folioweave.llm.components import component_labels
from folioweave.session import stage_table

#: Seed of the shingle hash.
SEED = 42
#: Blocks of a fingerprint.  Pairs at distance <= BLOCKS - SHARED agree on at least SHARED blocks.
BLOCKS, SHARED = 6, 3
#: Fingerprints of one block value that are compared in one piece of work.
TILE = 4096


def fingerprint(words: list[bytes], shingle: int = 3) -> int:
    """The 64-bit majority fingerprint of a word sequence.

    Every shingle of ``shingle`` words counts, repeats included; fewer words are
    one shingle; no words give zero.  A bit is set if over half of the hashes set it.
    """
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        pieces = [joined]
    else:
        ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
        starts = [0, *(e + 1 for e in ends)]
        pieces = [joined[s:e] for s, e in zip(starts, ends[shingle - 1 :])]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), pieces), np.uint64, len(pieces))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        octets = hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(row, id, fp)``: one row per input row; ``fp`` is the fingerprint as a signed long."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def start():
        def step(piece):
            fps = [fingerprint(folded_words(t), shingle) for t in piece.column(2).to_pylist()]
            return {"row": piece.column(0), "id": piece.column(1), "fp": np.array(fps, np.uint64).view(np.int64)}

        return step

    chosen = docs.select(row_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_slices(chosen, f"row bigint, id {id_type}, fp bigint", start)


def block_masks(bits: int = 64, blocks: int = BLOCKS, shared: int = SHARED) -> list[int]:
    """One mask for each choice of ``shared`` of the ``blocks`` bit ranges."""
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    ranges = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(ranges, shared)]


def spanning_links(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints within ``distance`` bits."""
    left, found = np.arange(len(fps)), []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= distance
            front += list(left[near])
            found += [(at, other) for other in left[near]]
            left = left[~near]
    return found


def fingerprint_links(fps: DataFrame, distance: int = BLOCKS - SHARED) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints of ``fps(fp)`` within ``distance`` bits.

    Distinct fingerprints meet where they agree on a choice of blocks; the
    distance is verified there.  A block value with many fingerprints is cut into
    tiles, and every pair of tiles is a piece of work of its own, so no task holds
    a whole group.  A piece of work returns the links of a spanning forest, not
    all pairs; the components are those of all close pairs.
    """
    if distance > BLOCKS - SHARED:
        raise ValueError(f"{BLOCKS} blocks of which {SHARED} are shared prove distances up to {BLOCKS - SHARED}")
    masks = [m - (1 << 64) if m >> 63 else m for m in block_masks()]
    keys = fps.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])).alias("b"),
    ).select("fp", "b.c", "b.k")
    crowded = keys.groupBy("c", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = keys.join(crowded, ["c", "k"]).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    own = met.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    tiled = own.select(
        "c", "k", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    ).select("c", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    cols = ["c", "k", "i", "j"]
    count = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def link(batches):
        import pyarrow as pa

        for columns, starts in grouped_runs(batches, len(cols)):
            unsigned = columns[4].view(np.uint64)
            sizes, first = np.diff(starts), starts[:-1]
            pairs = first[sizes == 2]
            pairs = pairs[np.bitwise_count(unsigned[pairs] ^ unsigned[pairs + 1]) <= distance]
            a, b = list(pairs), list(pairs + 1)
            for at, n in zip(first[sizes > 2], sizes[sizes > 2]):
                for x, y in spanning_links(unsigned[at : at + n], distance):
                    a.append(at + x)
                    b.append(at + y)
            a, b = columns[4][np.array(a, int)], columns[4][np.array(b, int)]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return tiled.repartition(count, *cols).sortWithinPartitions(*cols).mapInArrow(link, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = BLOCKS - SHARED
) -> DataFrame:
    """``(row, id, fp, component)`` per input row; ``component`` is the least id of its group.

    Texts are linked if their fingerprints differ in at most ``distance`` bits;
    groups are the connected components.  Exact copies and other equal
    fingerprints collapse to one node before anything is compared.  Null and empty
    texts have fingerprint zero and are linked like any other.  Null ids do not
    name a group unless all ids in it are null.  An empty table gives no rows.
    """
    rows = stage_table(fingerprints(docs, id_col, text_col, shingle))
    nodes = stage_table(rows.groupBy("fp").agg(F.min("id").alias("least")))
    labels = component_labels(fingerprint_links(nodes.select("fp"), distance))
    known = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = known.groupBy("label").agg(F.min("least").alias("component"))
    named = known.join(least, "label").select("fp", "component")
    return rows.join(named, "fp").select("row", "id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without near duplicates: of each group one row with the least id stays.

    If the least id is repeated, the first of its rows stays.  All columns of the
    input are returned.  ``docs`` should be read from files, whose row order is fixed.
    """
    groups = near_duplicates(docs, id_col, text_col, **options)
    kept = groups.groupBy("component").agg(
        F.min_by("row", F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))).alias("__row")
    )
    return docs.withColumn("__row", row_id()).join(kept.select("__row"), "__row", "left_semi").drop("__row")
