"""Hard negatives of anchors by exact integer products of tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.llm.clustering import is_finite, whole_components
from folioweave.llm.common import row_id
from folioweave.operators.ranking import top_per_key
from folioweave.session import stage_table

#: Anchors and candidates of one tile of scores.
TILE = 2048
#: Larger components count as this: a hundredfold score of 256 of them stays below 2**63.
LARGEST = 1 << 24
#: Products with fewer rows, columns or inner terms than this are not split further.
LEAF = 16
#: Levels of the recursion.
DEPTH = 2


def strassen(a: np.ndarray, b: np.ndarray, depth: int = DEPTH, leaf: int = LEAF) -> np.ndarray:
    """The int64 product ``a @ b`` with seven half-size products a level.

    Odd sizes are padded with zeros.  Only sums, differences and products of
    integers occur, so the result is exact; sums that pass 2**63 on the way wrap
    around and back.
    """
    if depth == 0 or min(*a.shape, b.shape[1]) < 2 * leaf:
        return _leaf(a, b)
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    a, b = (np.pad(x, [(0, s % 2) for s in x.shape]) if any(s % 2 for s in x.shape) else x for x in (a, b))
    i, j, p = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :p], b[:j, p:], b[j:, :p], b[j:, p:]
    out = np.empty((2 * i, 2 * p), np.int64)
    c11, c12, c21, c22 = out[:i, :p], out[:i, p:], out[i:, :p], out[i:, p:]
    product = strassen(a11 + a22, b11 + b22, depth - 1, leaf)
    c11[:] = product
    c22[:] = product
    product = strassen(a21 + a22, b11, depth - 1, leaf)
    c21[:] = product
    c22 -= product
    product = strassen(a11, b12 - b22, depth - 1, leaf)
    c12[:] = product
    c22 += product
    product = strassen(a22, b21 - b11, depth - 1, leaf)
    c11 += product
    c21 += product
    product = strassen(a11 + a12, b22, depth - 1, leaf)
    c11 -= product
    c12 += product
    c22 += strassen(a21 - a11, b11 + b12, depth - 1, leaf)
    c11 += strassen(a12 - a22, b21 + b22, depth - 1, leaf)
    return out[:m, :n]


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A plain product; where float64 provably holds every sum it is computed there, which is faster and as exact."""
    if not a.size or not b.size:
        return np.zeros((a.shape[0], b.shape[1]), np.int64)
    most = [max(int(x.max()), -int(x.min())) for x in (a, b)]
    if a.shape[1] * most[0] * most[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of int64; shorter ones are padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(column.offsets))
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return np.asarray(column.flatten(), np.int64).reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = np.asarray(column.flatten(), np.int64)
    return out


def _scores(anchors: pa.Table, rows: pa.Table) -> np.ndarray:
    a, b = _matrix(anchors.column("v")), _matrix(rows.column("v"))
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    return strassen(a, np.ascontiguousarray(b.T))


def _in_order(rows: pa.Table) -> pa.Table:
    """By id, rows without one last, then by row number: the order of ties."""
    return rows.sort_by([("id", "ascending"), ("row", "ascending")])


def tile_positives(anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """For each anchor its ``k`` best other rows of the same label within the tile."""
    rows = _in_order(rows)
    scores, own = _scores(anchors, rows), anchors.column("row").to_numpy()
    labels, row_labels, numbers = anchors.column("label").to_numpy(), rows.column("label").to_numpy(), rows.column("row").to_numpy()
    who, what, value = [], [], []
    for label in np.unique(labels):
        left, right = np.flatnonzero(labels == label), np.flatnonzero(row_labels == label)
        part = -scores[np.ix_(left, right)]
        # one more than needed, as the anchor itself may be among them
        best = np.argsort(part, axis=1, kind="stable")[:, : k + 1]
        for at, line in zip(left, best):
            found = right[line]
            found = found[numbers[found] != own[at]][:k]
            who += [at] * len(found)
            what += found.tolist()
            value += scores[at, found].tolist()
    return pa.table({
        "anchor_row": anchors.column("row").take(pa.array(who, pa.int64())), "anchor_id": anchors.column("id").take(pa.array(who, pa.int64())),
        "positive_row": pa.array(numbers[np.array(what, int)]), "positive_id": rows.column("id").take(pa.array(what, pa.int64())),
        "positive_score": pa.array(value, pa.int64()),
    })


def tile_negatives(anchors: pa.Table, rows: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """For each anchor and window the first ``k`` rows of other labels within the tile.

    The windows of an anchor share one sorting of its scores; each begins at its
    upper end by binary search.
    """
    rows = _in_order(rows)
    scores = _scores(anchors, rows)
    labels, row_labels, numbers = anchors.column("label").to_numpy(), rows.column("label").to_numpy(), rows.column("row").to_numpy()
    windows = anchors.column("windows").to_pylist()
    who, which, what, value = [], [], [], []
    for label in np.unique(labels):
        left, right = np.flatnonzero(labels == label), np.flatnonzero(row_labels != label)
        part = scores[np.ix_(left, right)]
        order = np.argsort(-part, axis=1, kind="stable")
        part = np.take_along_axis(part, order, axis=1)
        for at, line, place in zip(left, part, order):
            for rank, positive in enumerate(windows[at]):
                least, most = -(-low * positive // 100), high * positive // 100
                start = int(np.searchsorted(-line, -most))
                stop = start + int(np.searchsorted(-line[start : start + k], -least, side="right"))
                who += [at] * (stop - start)
                which += [rank] * (stop - start)
                what += right[place[start:stop]].tolist()
                value += line[start:stop].tolist()
    return pa.table({
        "anchor_row": anchors.column("row").take(pa.array(who, pa.int64())), "window": pa.array(which, pa.int32()),
        "negative_row": pa.array(numbers[np.array(what, int)]), "negative_id": rows.column("id").take(pa.array(what, pa.int64())),
        "negative_score": pa.array(value, pa.int64()),
    })


def _tiles(anchors: DataFrame, rows: DataFrame, tile: int):
    """Both sides dealt to the cells of a grid; every anchor meets every row in one cell.

    Cells are chosen by a hash of the row number, so they are even whatever ids,
    labels and vectors repeat.  An anchor is copied to each tile of rows and a row
    to each tile of anchors.
    """
    across, down = (max(1, -(-side.count() // tile)) for side in (anchors, rows))
    # enough cells for all tasks, where the tables are small
    down = max(down, min(-(-int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // across), down * 16))

    def dealt(side: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        cell = F.pmod(F.xxhash64("row"), F.lit(n_own)).cast("int").alias(own)
        # fresh column identities: both sides come from the same table
        return side.select(*[F.col(c).alias(c) for c in side.columns], cell, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other)).groupBy("across", "down")

    return dealt(anchors, "across", across, "down", down).cogroup(dealt(rows, "down", down, "across", across))


def _tile_function(fn, names: list[str], *args):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            anchors, rows = anchors.slice(0, 0), rows.slice(0, 0)
        return fn(anchors, rows, *args).select(names)

    return run


def prepared_rows(vectors: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(row, id, label, v)`` of the rows that take part."""
    kept = vectors.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vector_col).alias("raw"))
    kept = kept.where(F.col("label").isNotNull() & is_finite(F.col("raw")))
    return kept.select(row_id().alias("row"), "id", "label", whole_components(F.col("raw"), largest=LARGEST).alias("v"))


def mine_hard_negatives(
    vectors: DataFrame, anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Rows with a null label, a null vector or a null or non-finite component take no
    part.  Components become whole numbers (256 times, rounded down; at most
    ``LARGEST`` in size); a score is the integer inner product, where the shorter
    vector is padded with zeros (an empty one scores 0).  ``anchor`` is a condition
    on ``id`` and names the rows that ask.  An anchor's positives are its first
    ``positives`` other rows of its label; for each, the first ``negatives`` rows
    of other labels whose score is from ``low`` to ``high`` percent of the
    positive's are returned.  Higher scores come first, ties by smaller id (null
    ids last) and then by place in the table.  Repeated ids and rows are separate
    rows; the anchor itself is told by its place.  Other columns are not read.

    Two passes over a grid of tiles: the first keeps ``positives`` rows an anchor,
    the second ``negatives`` rows an anchor and window.  What the tiles keep is
    merged by ranks with a limit in every task, so no task sees more than that per
    tile, and nothing is broadcast or collected.  An empty table gives no rows.
    """
    rows = stage_table(prepared_rows(vectors, F.col("label") if label is None else label, id_col, vector_col))
    asking = rows.where(anchor)
    found = _tiles(asking, rows, tile).applyInArrow(
        _tile_function(tile_positives, ["anchor_row", "anchor_id", "positive_row", "positive_id", "positive_score"], positives),
        "anchor_row bigint, anchor_id bigint, positive_row bigint, positive_id bigint, positive_score bigint",
    )
    best = stage_table(top_per_key(found, ["anchor_row"], [F.desc("positive_score"), F.asc_nulls_last("positive_id"), F.asc("positive_row")], positives, "nth"))
    # at most ``positives`` windows an anchor
    windows = best.groupBy("anchor_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))), lambda w: w["positive_score"]).alias("windows"))
    judged = asking.join(windows, F.col("row") == F.col("anchor_row")).select("row", "id", "label", "v", "windows")
    near = _tiles(judged, rows, tile).applyInArrow(
        _tile_function(tile_negatives, ["anchor_row", "window", "negative_row", "negative_id", "negative_score"], negatives, low, high),
        "anchor_row bigint, window int, negative_row bigint, negative_id bigint, negative_score bigint",
    )
    kept = top_per_key(near, ["anchor_row", "window"], [F.desc("negative_score"), F.asc_nulls_last("negative_id"), F.asc("negative_row")], negatives)
    named = best.select("anchor_row", (F.col("nth") - 1).alias("window"), "anchor_id", "positive_id", "positive_score")
    return kept.join(named, ["anchor_row", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
