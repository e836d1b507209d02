"""Clustering of integer vectors around centroids with rotated lower bounds."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.llm.common import map_slices
from folioweave.session import stage_table

#: Components are this many times the given ones, rounded down.
SCALE = 256
#: Larger components count as this, so that every squared distance stays below 2**63.
LARGEST = 1 << 27
#: Leading rotated coordinates that are stored for each vector.
LEADING = 16
#: Rows that a task compares at a time.
ROWS = 2048
#: Share by which floating-point bounds are lowered before they may exclude a centroid.
SLACK = 1e-9


def whole_components(vector: Column, scale: int = SCALE, largest: int = LARGEST) -> Column:
    """The components times ``scale``, rounded down to whole numbers, at most ``largest`` in size."""
    return F.transform(
        vector, lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x.cast("double"), F.lit(-1e15)), F.lit(1e15)) * scale), F.lit(-largest)), F.lit(largest)).cast("int")
    )


def is_finite(vector: Column) -> Column:
    """Whether the vector is there and all its components are numbers of finite size."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def _integers(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, width)


def _moments(rows: DataFrame, width: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Number, sums and products of the components over all rows.

    A task adds up its rows and Spark adds up the tasks: one row for each pair of
    components, whatever the size of the table.
    """

    def run(batches):
        n, total, product = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            x = _integers(batch.column(0), width).astype(np.float64)
            n, total, product = n + len(x), total + x.sum(0), product + x.T @ x
        if n:
            # the last row holds the sums and the number
            whole = np.vstack([np.column_stack([product, total]), [*total, n]])
            i, j = np.indices(whole.shape)
            yield pa.RecordBatch.from_pydict({"i": i.ravel(), "j": j.ravel(), "s": whole.ravel()})

    made = rows.select("v").mapInArrow(run, "i bigint, j bigint, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    whole = np.zeros((width + 1, width + 1))
    for r in made:
        whole[r["i"], r["j"]] = r["s"]
    return whole[width, width], whole[:width, width], whole[:width, :width]


def rotation(rows: DataFrame, width: int, leading: int = LEADING) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the ``leading`` principal directions (as columns) of all vectors."""
    n, total, product = _moments(rows, width)
    mean = total / n
    _, directions = np.linalg.eigh(product / n - np.outer(mean, mean))
    return mean, directions[:, ::-1][:, : min(leading, width)]


def rotated(x: np.ndarray, mean: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading rotated coordinates, and the length of what they leave over."""
    centred = x - mean
    lead = centred @ directions
    rest = np.sqrt(np.maximum((centred * centred).sum(1) - (lead * lead).sum(1), 0))
    return lead, rest


def nearest(
    x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, centroid_lead: np.ndarray, centroid_rest: np.ndarray, reach: float
) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row, its squared distance, and how many distances were computed.

    The squared distance of the leading coordinates plus the squared difference of
    the residual lengths is at most the squared distance.  The centroid with the
    least bound gives a distance to beat; every centroid whose bound is not above
    it is verified in integers, the smaller number winning ties.  ``reach`` is a
    bound of all squared lengths, to which rounding errors are relative.
    """
    cross = lead @ centroid_lead.T
    bound = (lead * lead).sum(1)[:, None] - 2 * cross + (centroid_lead * centroid_lead).sum(1)
    bound += (rest[:, None] - centroid_rest) ** 2
    first = bound.argmin(1)
    known = ((x - centroids[first]) ** 2).sum(1)
    allowed = known + SLACK * (known + reach) + 1
    row, number = np.nonzero(bound <= allowed[:, None])
    distance = ((x[row] - centroids[number]) ** 2).sum(1)
    order = np.lexsort((number, distance, row))
    row, number, distance = row[order], number[order], distance[order]
    heads = np.searchsorted(row, np.arange(len(x)))
    return number[heads], distance[heads], len(row) + len(x)


class _Filter:
    """Centroids with their rotated form, as the tasks need them."""

    def __init__(self, centroids: list[list[int]], mean: np.ndarray, directions: np.ndarray):
        self.centroids = np.array(centroids, np.int64)
        self.lead, self.rest = rotated(self.centroids.astype(np.float64), mean, directions)

    def assign(self, piece: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        width, leading = self.centroids.shape[1], self.lead.shape[1]
        x = _integers(piece.column(at), width)
        lead = np.asarray(piece.column(at + 1).flatten()).reshape(-1, leading)
        rest = np.asarray(piece.column(at + 2))
        # lengths of vectors and centroids around the mean
        reach = float(((lead * lead).sum(1) + rest * rest).max() + ((self.lead**2).sum(1) + self.rest**2).max())
        return x, *nearest(x, lead, rest, self.centroids, self.lead, self.rest, reach)


def _moved(vectors: DataFrame, now: _Filter) -> list[list[int]]:
    """The next centroids; component sums are added up by the tasks and then by Spark.

    ``LARGEST`` leaves room for 2**36 rows of that size in a sum.
    """
    k, width = now.centroids.shape
    shared = vectors.sparkSession.sparkContext.broadcast(now)

    def run(batches):
        # the last column counts
        total = np.zeros((k, width + 1), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                x, number, _, _ = shared.value.assign(batch.slice(start, ROWS), 0)
                order = np.argsort(number, kind="stable")
                heads = np.flatnonzero(np.diff(number[order], prepend=-1))
                total[number[order][heads], :width] += np.add.reduceat(x[order], heads)
                total[:, width] += np.bincount(number, minlength=k)
        cluster, part = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"cluster": cluster, "part": part, "s": total[cluster, part]})

    made = vectors.select("v", "lead", "rest").mapInArrow(run, "cluster bigint, part bigint, s bigint")
    sums = np.zeros((k, width + 1), np.int64)
    for r in made.groupBy("cluster", "part").agg(F.sum("s").alias("s")).collect():
        sums[r["cluster"], r["part"]] = r["s"]
    n = sums[:, width:]
    # floor division rounds down for negative sums too
    return np.where(n > 0, sums[:, :width] // np.maximum(n, 1), now.centroids).tolist()


def first_centroids(rows: DataFrame, k: int, label: str) -> list[list[int]]:
    """The ``k`` vectors whose ids have the least hashes; null ids come last, and equal ids by their components."""
    mark = F.sha2(F.concat(F.lit(label), F.col("id").cast("string")), 256)
    return [r["v"] for r in rows.select("v", mark.alias("mark")).orderBy(F.col("mark").asc_nulls_last(), "v").limit(k).collect()]


def cluster_vectors(
    vectors: DataFrame, width: int = 64, k: int = 40, rounds: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    label: str = "2:", leading: int = LEADING,
) -> tuple[DataFrame, list[list[int]]]:
    """``(id_col, cluster, distance)`` for each clustered vector, and the final centroids.

    Vectors with exactly ``width`` components, none of them null or non-finite, take
    part; others are left out.  Components become whole numbers (``SCALE`` times,
    rounded down; at most ``LARGEST`` in size).  The ``k`` vectors with the least
    hashes of their ids begin; each of ``rounds`` rounds assigns every vector to its
    nearest centroid and moves the centroids to the means, rounded down; an empty
    cluster stays where it is.  Then vectors are assigned once more.

    The principal directions of all vectors are computed first, and every vector is
    written once with its leading rotated coordinates and the length of the rest.  A
    round reads these, excludes centroids by that lower bound and verifies the rest
    in integers, so results are exact.  Rows stay in their tasks; per task at most
    ``k`` sums are shuffled, and only centroids, moments and sums of bounded size
    reach the driver.

    Repeated ids and rows are separate vectors; ids may be null; other columns are
    not read.  Fewer than ``k`` vectors are all centroids; none give an empty result.
    """
    spark = vectors.sparkSession
    vector = F.col(vector_col)
    kept = vectors.where(is_finite(vector) & (F.size(vector) == width)).select(F.col(id_col).alias("id"), whole_components(vector).alias("v"))
    rows = stage_table(kept)
    centroids = first_centroids(rows, k, label)
    kind = vectors.schema[id_col].dataType.simpleString()
    if not centroids:
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance bigint"), []
    mean, directions = rotation(rows, width, leading)
    shared = spark.sparkContext.broadcast((mean, directions))

    def rotate():
        def step(piece):
            lead, rest = rotated(_integers(piece.column(1), width).astype(np.float64), *shared.value)
            return {"id": piece.column(0), "v": piece.column(1), "lead": list(lead), "rest": rest}

        return step

    stored = stage_table(map_slices(rows, f"id {kind}, v array<int>, lead array<double>, rest double", rotate, rows=ROWS))
    for _ in range(rounds):
        centroids = _moved(stored, _Filter(centroids, mean, directions))
    final = spark.sparkContext.broadcast(_Filter(centroids, mean, directions))

    def assign():
        def step(piece):
            _, number, distance, _ = final.value.assign(piece, 1)
            return {"id": piece.column(0), "cluster": number, "distance": distance}

        return step

    found = map_slices(stored, f"id {kind}, cluster int, distance bigint", assign, rows=ROWS)
    return found.withColumnRenamed("id", id_col), centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``assigned`` with ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` (of the components joined by commas).

    Sums beyond 2**63 - 1 are returned as that.
    """
    spark = assigned.sparkSession
    staged = stage_table(assigned)
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = staged.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row per centroid
    total = sum(int(r["s"]) for r in sums)
    facts = spark.createDataFrame(
        [(r["cluster"], r["s"], hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()) for r in sums],
        "cluster int, s decimal(38,0), centroid_sha256 string",
    )
    return staged.join(F.broadcast(facts), "cluster").select(
        *staged.columns, F.least("s", most).cast("bigint").alias("cluster_inertia"),
        F.lit(min(total, (1 << 63) - 1)).cast("bigint").alias("inertia"), "centroid_sha256",
    )
