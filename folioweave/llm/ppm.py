"""Prediction by partial matching over bytes, as code lengths of documents."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioweave.llm.common import folded_words, map_slices
from folioweave.llm.lexicon import count_words, sum_over_words
from folioweave.session import stage_table

#: Longest context in bytes.
ORDER = 5
#: The byte between words, which no word contains, and the symbol after the last word, which UTF-8 lacks.
SPACE, END = 0x20, 0xFF
ALPHABET = 256


def context_slots(words: list[bytes], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each context length the trie edge ``length | context | symbol`` at every byte, and its word number.

    A word is read as a space, its bytes and a space; contexts reach back to the
    space before it.  Contexts of the same length only compare among themselves.
    """
    data = np.frombuffer(b"".join(b" " + w + b" " for w in words), np.uint8).astype(np.int64)
    sizes = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, context = [], np.zeros(len(data), np.int64)
    for k in range(order + 1):
        at = np.flatnonzero(place >= max(k, 1))
        out.append(((k << 56) | (context[at] << 8) | data[at], owner[at]))
        if k < order and k + 1 < len(data):
            context[k + 1 :] |= data[: -k - 1] << (8 * k)
    return out


def longest_slots(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The edge of the longest context at every byte, and its word number."""
    slots = context_slots(words, order)
    keys, owners = [], []
    for k, (key, owner) in enumerate(slots):
        if k == 0:
            continue
        if k < order:  # contexts of k bytes that begin at the word's start are the longest there
            begins = np.flatnonzero(np.diff(owner, prepend=-1))
            key, owner = key[begins], owner[begins]
        keys.append(key)
        owners.append(owner)
    return np.concatenate(keys), np.concatenate(owners)


def _edge(level: Column | int, context: int, symbol: int) -> int:
    return (level << 56) | (context << 8) | symbol


def train_trie(lexicon: DataFrame, ends: int, order: int = ORDER) -> DataFrame:
    """Edges ``(level, context, symbol, c)`` of the context trie of all words.

    ``c`` is how often the symbol followed the context in training; edges that only
    words of other texts need have ``c`` 0.  ``ends`` is the number of training texts.
    """

    def start():
        def step(piece):
            words, counts = piece.column(0).to_pylist(), np.asarray(piece.column(1))
            keys, c = [], []
            for slots, owner in context_slots(words, order):
                distinct, where = np.unique(slots, return_inverse=True)
                keys.append(distinct)
                c.append(np.bincount(where, counts[owner], minlength=len(distinct)).astype(np.int64))
            return {"edge": np.concatenate(keys), "c": np.concatenate(c)}

        return step

    edges = map_slices(lexicon.select("word", "n"), "edge bigint, c bigint", start, rows=20_000)
    last = lexicon.sparkSession.createDataFrame(
        [(_edge(0, 0, END), ends), (_edge(1, SPACE, END), ends)], "edge bigint, c bigint"
    )
    summed = edges.union(last).groupBy("edge").agg(F.sum("c").alias("c"))
    return summed.select(
        F.shiftrightunsigned("edge", 56).cast("int").alias("level"),
        F.shiftrightunsigned(F.col("edge").bitwiseAND(F.lit((1 << 56) - 1)), 8).alias("context"),
        F.col("edge").bitwiseAND(F.lit(255)).cast("int").alias("symbol"), "c",
    )


def code_lengths(trie: DataFrame, order: int = ORDER) -> DataFrame:
    """``(edge, lp)``: log10 probability of the symbol after the context.

    A context gives a seen symbol c / (T + D), where T counts its occurrences and D
    its distinct symbols, and escapes with D / (T + D) to the next shorter context,
    in which the symbols of the longer one are excluded from T and D.  After the
    empty context all other bytes are equally likely.  A context's symbols are a
    subset of those of its suffix, so the excluded sums come from one window over
    the context, which holds at most 256 rows.
    """
    whole = Window.partitionBy("context")
    seen = F.col("c") > 0
    level = trie.where("level = 0").select("context", "symbol", "c")
    level = level.withColumns({"t": F.sum("c").over(whole), "d": F.count_if(seen).over(whole)})
    rest = F.lit(1.0) / F.greatest(F.lit(ALPHABET) - F.col("d"), F.lit(1))
    level = level.withColumn("r", rest)
    done = []
    for k in range(1, order + 1):
        suffix = F.col("context").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1))
        lower = level.select(
            F.col("context").alias("suffix"), "symbol", F.col("c").alias("cl"), F.col("t").alias("tl"),
            F.col("d").alias("dl"), F.col("r").alias("rl"),
        )
        met = trie.where(F.col("level") == k).select("context", "symbol", "c", suffix.alias("suffix")).join(lower, ["suffix", "symbol"])
        met = met.withColumns(
            {"t": F.sum("c").over(whole), "d": F.count_if(seen).over(whole), "e": F.sum(F.when(seen, F.col("cl")).otherwise(0)).over(whole)}
        )
        t_left, d_left = F.col("tl") - F.col("e"), F.col("dl") - F.col("d")
        skip = F.when(d_left > 0, F.try_divide(d_left, t_left + d_left)).otherwise(F.lit(1.0))
        met = met.withColumn("r", F.when(F.col("cl") > 0, F.try_divide("cl", t_left + d_left)).otherwise(skip * F.col("rl")))
        level = stage_table(met.select("context", "symbol", "c", "t", "d", "r"))
        own = F.col("t") + F.col("d")
        p = F.when(seen, F.try_divide("c", own)).otherwise(F.when(F.col("t") > 0, F.try_divide("d", own)).otherwise(F.lit(1.0)) * F.col("r"))
        edge = F.shiftleft("context", 8).bitwiseOR(F.col("symbol").cast("bigint")).bitwiseOR(F.lit(k << 56))
        done.append(level.select(edge.alias("edge"), F.log10(p).alias("lp")))
    return reduce(DataFrame.union, done)


def word_code_lengths(lexicon: DataFrame, codes: DataFrame, order: int = ORDER) -> DataFrame:
    """``(word, n, lp)``: the sum of the code lengths of a word's bytes and the space after it."""

    numbered = lexicon.select("word", "n", F.xxhash64("word").alias("h1"), F.hash("word").alias("h2"))

    def start():
        def step(piece):
            edges, owner = longest_slots(piece.column(0).to_pylist(), order)
            h1, h2 = np.asarray(piece.column(1)), np.asarray(piece.column(2))
            return {"h1": h1[owner], "h2": h2[owner], "edge": edges}

        return step

    places = map_slices(numbered.select("word", "h1", "h2"), "h1 bigint, h2 int, edge bigint", start, rows=20_000)
    summed = places.join(codes, "edge").groupBy("h1", "h2").agg(F.sum("lp").alias("lp"))
    return numbered.join(summed, ["h1", "h2"]).select("word", "n", "lp")


def score_documents(
    docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER
) -> DataFrame:
    """Code lengths of all texts by a model of the rows for which ``training`` holds.

    A text is its words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased), each followed by a
    space, and an end symbol.  Contexts of up to ``order`` bytes reach back to the
    space before the word, so a word costs the same wherever it stands and is
    scored once for the whole corpus.  The trie, its escapes and exclusions are
    Spark tables that grow with the distinct words; nothing of them is collected.

    Returns ``(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score)``
    per row; base is the add-one unigram model of whole words.  Null texts count
    as empty, a null ``training`` as true, an empty table gives no rows, and
    without training rows all symbols are equally likely.
    """
    rows = docs.select(F.col(id_col), F.col(text_col), (~F.coalesce(training, F.lit(True))).alias("held_out"))
    rows = rows.toDF("id", "text", "held_out").withColumn("counted", ~F.col("held_out"))
    lexicon = stage_table(count_words(rows, folded_words, "text", "counted"))
    ends = rows.where("counted").count()
    seen = lexicon.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    tokens, kinds = (seen["n"] or 0) + ends, seen["v"] + (ends > 0)
    trie = stage_table(train_trie(lexicon, ends, order))
    codes = code_lengths(trie, order)
    end_lp = codes.where(F.col("edge") == _edge(1, SPACE, END)).first()["lp"]
    priced = word_code_lengths(lexicon, codes, order).select(
        "word", "n", (F.col("n") > 0).cast("int").alias("n_known"), F.log10(F.col("n") + 1.0).alias("base_score"), F.col("lp").alias("score")
    )
    sums = sum_over_words(rows, stage_table(priced), ["n_known", "base_score", "score"], folded_words, "id", "text", ["held_out"])
    n_tokens = F.col("n_words") + 1
    return sums.select(
        F.col("id").alias(id_col), "held_out", n_tokens.alias("n_tokens"),
        (F.col("n_known").cast("bigint") + int(ends > 0)).alias("n_known"), F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + float(np.log10(ends + 1)) - n_tokens * float(np.log10(tokens + kinds + 1))).alias("base_score"),
        (F.col("score") + float(end_lp)).alias("score"),
    )
