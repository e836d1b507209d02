"""Per-document sums of values that belong to words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.common import map_slices, row_id

#: Most frequent words whose values go to every task, and the longest of them in bytes: at most 4 MiB of keys.
FREQUENT, FREQUENT_BYTES = 65_536, 64
#: Distinct words that a counting task holds before it hands them on.
HELD_WORDS = 200_000


def count_words(docs: DataFrame, words: Callable[[str | None], list[bytes]], text_col: str, counted_col: str | None = None) -> DataFrame:
    """``(word binary, n bigint)`` over all texts, every word once.

    Rows whose ``counted_col`` is false add their words with a count of zero.
    Tasks count in memory up to a bound and Spark adds the rest.
    """
    counted = F.lit(True) if counted_col is None else F.col(counted_col)
    chosen = docs.select(F.col(text_col).alias("text"), counted.alias("counted"))

    def run(batches):
        import pyarrow as pa

        from folioweave.llm.common import slices

        def batch(held):
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        held: Counter = Counter()
        for piece in slices(batches):
            for text, on in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                found = words(text)
                held.update(found if on else dict.fromkeys(found, 0))
                if len(held) > HELD_WORDS:
                    yield batch(held)
                    held = Counter()
        if held:
            yield batch(held)

    return chosen.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(lexicon: DataFrame, values: list[str]) -> dict[bytes, tuple[float, ...]]:
    """The values of at most FREQUENT of the most frequent words, none of them longer than FREQUENT_BYTES.

    Counts are put into classes of about 1 %; as many whole classes are taken, from
    the top, as stay within the bound.  So only a histogram and the words themselves
    reach the driver, however many tasks hold the lexicon.
    """
    short = lexicon.where((F.octet_length("word") <= FREQUENT_BYTES) & (F.col("n") > 0))
    classed = short.withColumn("class", F.floor(F.log2("n") * 64).cast("int"))
    room, least = FREQUENT, None
    for row in sorted(classed.groupBy("class").agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        room -= row["words"]
        if room < 0:
            break
        least = row["class"]
    if least is None:
        return {}
    rows = classed.where(F.col("class") >= least).select("word", *values).collect()
    return {bytes(r[0]): tuple(map(float, r[1:])) for r in rows}


def sum_over_words(
    docs: DataFrame, lexicon: DataFrame, values: list[str], words: Callable[[str | None], list[bytes]],
    id_col: str, text_col: str, keep: list[str] = [],  # noqa: B006
) -> DataFrame:
    """For each row of ``docs`` the sums of the lexicon's ``values`` over its words.

    ``lexicon(word, n, *values)`` must hold every word.  The values of the most
    frequent words, a fixed number of bounded length, travel to the tasks; all
    other words are counted per row and joined by equality, where adaptive
    execution splits a hot word.  Returns ``(id, *keep, n_words, *values)``; rows
    without words have zero sums.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent_words(lexicon, values))
    kinds = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate([id_col, *keep]))
    n_keep = 1 + len(keep)
    sums = [f"s{i}" for i in range(len(values))]
    schema = f"row bigint, key binary, n bigint, {kinds}, n_words bigint" + "".join(f", {s} double" for s in sums)

    def start():
        frequent = shared.value

        def step(piece):
            rows, texts = piece.column(0).to_pylist(), piece.column(1).to_pylist()
            kept = [piece.column(2 + i).to_pylist() for i in range(n_keep)]
            out_row, key, n, size = [], [], [], []
            held: list[list] = [[] for _ in range(n_keep)]
            made: list[list[float]] = [[] for _ in sums]
            for at, (row, text) in enumerate(zip(rows, texts)):
                found = words(text)
                total = [0.0] * len(sums)
                rare = []
                for word, times in Counter(found).items():
                    known = frequent.get(word)
                    if known is None:
                        rare.append((word, times))
                    else:
                        for i, v in enumerate(known):
                            total[i] += times * v
                # a row of its own carries the rest of the document; its key is no word and spread evenly
                out_row += [row] * (len(rare) + 1)
                key += [b"\xff" + row.to_bytes(8, "big"), *(w for w, _ in rare)]
                n += [0, *(t for _, t in rare)]
                blank = [None] * len(rare)
                size += [len(found), *blank]
                for i in range(n_keep):
                    held[i] += [kept[i][at], *blank]
                for i, v in enumerate(total):
                    made[i] += [v, *blank]
            return (
                {"row": out_row, "key": key, "n": n} | {f"k{i}": held[i] for i in range(n_keep)}
                | {"n_words": size} | dict(zip(sums, made))
            )

        return step

    chosen = docs.select(row_id(), F.col(text_col), *[F.col(c) for c in [id_col, *keep]])
    spread = map_slices(chosen, schema, start, rows=64)
    priced = lexicon.select(F.col("word").alias("key"), *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)])
    joined = spread.join(priced, "key", "left")
    whole = joined.groupBy("row").agg(
        *[F.max(f"k{i}").alias(f"k{i}") for i in range(n_keep)], F.max("n_words").alias("n_words"),
        *[F.sum(F.coalesce(s, F.col("n") * F.coalesce(f"v{i}", F.lit(0.0)))).alias(s) for i, s in enumerate(sums)],
    )
    return whole.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate([id_col, *keep])], "n_words",
        *[F.col(s).alias(v) for s, v in zip(sums, values)],
    )
