"""Quality rules: hashed n-gram logistic regression with calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.common import map_slices

#: Hash bits of the feature space.
BITS = 17
#: Tasks that hold the labelled sample while it is fitted; each sends one gradient a step.
FIT_TASKS = 4
#: Labelled rows that the classifier is fitted on at most; those with the least id hashes.
MAX_LABELLED = 4000
#: One in so many of them is kept for calibration.
CALIBRATE_ONE_IN = 5
#: Texts whose probability of being good is below this are rejected.
KEEP_FROM = 0.5
#: Texts with fewer words fail, and texts with a larger share (in %) of words in repeated windows.
MIN_WORDS, MAX_REPEATED, WINDOW = 50, 50, 3
_SPACES = b" \t\n\x0b\x0c\r"
_BLANK = np.isin(np.arange(256), list(_SPACES))
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_WORD_ORDERS, _BYTE_ORDERS = (1, 2), (1, 2, 3, 4)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Features are shares of a text's n-grams, times this.
_SCALE = 30.0


@dataclass
class QualityModel:
    """Weights of the hashed n-grams, intercept, and the calibration line of the margin."""

    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    offset: float = 0.0

    def probability(self, margins: np.ndarray) -> np.ndarray:
        z = self.slope * (margins + self.intercept) + self.offset
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def _slot(codes: np.ndarray, family: int) -> np.ndarray:
    mixed = (codes ^ np.uint64(family * 0x1000193)) * _MULTIPLIER
    return ((mixed ^ (mixed >> np.uint64(29))) * _MULTIPLIER >> np.uint64(64 - BITS)).astype(np.int64)


def _inverse_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x100000001B3
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, base, np.uint64))
        down = np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64))
    return up, down


def ngram_slots(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram family the feature slot and the text number of every n-gram.

    Bytes and words keep their case.  A word's code is a polynomial hash taken
    from prefix sums, so that whole slices are hashed at once.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends, prepend=0))
    wide = data.astype(np.uint64)
    for n in _BYTE_ORDERS:
        codes = np.zeros(max(0, len(data) - n + 1), np.uint64)
        for k in range(n):
            codes |= wide[k : len(data) - n + 1 + k] << np.uint64(8 * k)
        inside = np.flatnonzero(owner[: len(codes)] == owner[n - 1 :])
        inside = inside[inside + n < ends[owner[inside]]]  # not over the separator
        yield _slot(codes[inside], n), owner[inside]
    blank = _BLANK[data]
    first = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    after = np.flatnonzero(blank & np.append(False, ~blank[:-1]))
    up, down = _inverse_powers(len(data))
    sums = np.append(np.uint64(0), np.cumsum((wide + np.uint64(1)) * up))
    code = (sums[after] - sums[first]) * down[first]
    whose = owner[first]
    for n in _WORD_ORDERS:
        codes = code[: max(0, len(code) - n + 1)].copy()
        for k in range(1, n):
            codes = codes * np.uint64(0x9E3779B1) + code[k : len(code) - n + 1 + k]
        inside = whose[: len(codes)] == whose[n - 1 :]
        yield _slot(codes[inside], 16 + n), whose[: len(codes)][inside]


def margins(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """For each text the sum over families of the mean weight of its n-grams, scaled."""
    total = np.zeros(len(texts))
    for slots, owner in ngram_slots(texts):
        count = np.bincount(owner, minlength=len(texts))
        total += np.bincount(owner, weights[slots], minlength=len(texts)) / np.maximum(count, 1)
    return _SCALE * total


def sparse_features(text: str | None):
    """The same features of one text as a sparse vector."""
    out = np.zeros(1 << BITS)
    for slots, _ in ngram_slots([(text or "").encode()]):
        if len(slots):
            np.add.at(out, slots, _SCALE / len(slots))
    at = np.flatnonzero(out)
    return Vectors.sparse(1 << BITS, at.tolist(), out[at].tolist())


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that occur twice or more in the text."""
    if len(words) <= window:
        return 0
    number = {w: i for i, w in enumerate(set(words))}
    if len(number) == len(words):
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    codes = ids[: len(ids) - window + 1]
    for k in range(1, window):
        _, codes = np.unique(codes * len(number) + ids[k : len(ids) - window + 1 + k], return_inverse=True)
    at = np.flatnonzero(np.bincount(codes)[codes] > 1)
    covered = np.zeros(len(ids), bool)
    for k in range(window):
        covered[at + k] = True
    return int(covered.sum())


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines and words in repeated windows; null has none."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    words = raw.split()
    blanks = int(np.count_nonzero(_BLANK[data]))
    lines = [line for line in raw.split(b"\n") if line.strip(_SPACES)]
    return len(words), len(text) - blanks, int(np.count_nonzero(_SYMBOL[data])), len(lines) - len(set(lines)), repeated_words(words)


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_labelled: int = MAX_LABELLED,
) -> QualityModel | None:
    """Fit and calibrate on at most ``max_labelled`` labelled texts, in Spark.

    The rows with the least id hashes are taken, four fifths to fit and the rest
    to calibrate the margin.  An id that is labelled twice counts with its lower
    label; null labels and ids without a document are left out.  Returns None if
    either class is missing.
    """
    key = F.col(id_col).alias("id")
    marked = labels.select(key, F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    chosen = marked.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    featured = F.udf(sparse_features, VectorUDT())
    rows = (
        docs.select(key, F.col(text_col).alias("text"))
        .join(F.broadcast(chosen), "id")  # at most max_labelled pairs of numbers
        .groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
        .select("id", F.col("label").cast("double").alias("label"), featured("text").alias("features"))
        .withColumn("part", F.pmod(F.xxhash64(F.col("id"), F.lit("part")), F.lit(CALIBRATE_ONE_IN)))
        .repartition(FIT_TASKS)
        .persist()
    )
    try:
        present = {(r["calibrate"], r["label"]) for r in rows.select((F.col("part") == 0).alias("calibrate"), "label").distinct().collect()}
        if {(False, 0.0), (False, 1.0)} - present:
            return None
        fitted = LogisticRegression(maxIter=40, regParam=1e-5, standardization=False).fit(rows.where("part > 0"))
        model = QualityModel(fitted.coefficients.toArray().astype(np.float32), float(fitted.intercept))
        if not {(True, 0.0), (True, 1.0)} - present:
            raw = F.udf(lambda v: Vectors.dense([float(v[1])]), VectorUDT())
            held = fitted.transform(rows.where("part = 0")).select("label", raw("rawPrediction").alias("features"))
            line = LogisticRegression(maxIter=40, regParam=1e-3, standardization=False).fit(held)
            model.slope, model.offset = float(line.coefficients[0]), float(line.intercept)
        return model
    finally:
        rows.unpersist()


def score_quality(
    docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Counts, probability and verdict of every text, in Arrow batches.

    Returns the columns ``keep`` (default: the id), then n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, probability (null
    without a model) and kept.  Null texts count as empty and fail.  Columns of
    the input that carry one of these names are taken only if listed in ``keep``
    under another name, so they never clash.
    """
    keep = keep or [id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    schema = fields + (
        ", n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
        " base_failed boolean, probability double, kept boolean"
    )

    def start():
        model = shared.value

        def step(piece):
            texts = piece.column(len(keep)).to_pylist()
            counts = np.array([text_counts(t) for t in texts], np.int64).reshape(-1, 5)
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEATED * counts[:, 0])
            good = None if model is None else model.probability(margins([(t or "").encode() for t in texts], model.weights))
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
            return (
                {f"k{i}": piece.column(i) for i in range(len(keep))}
                | {name: counts[:, i] for i, name in enumerate(names)}
                | {"base_failed": failed, "probability": good if good is not None else [None] * len(texts)}
                | {"kept": ~failed & (good is None or good >= KEEP_FROM)}
            )

        return step

    chosen = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("t"))
    scored = map_slices(chosen, schema, start)
    return scored.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns and nothing else."""
    model = fit_quality(docs, labels, id_col, text_col)
    numbered = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text = f"c{docs.columns.index(text_col)}"
    scored = score_quality(numbered, model, numbered.columns[0], text, keep=numbered.columns)
    return scored.where("kept").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
