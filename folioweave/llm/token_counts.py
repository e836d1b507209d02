"""Token counts of documents from a trie of their distinct pre-tokens."""

from __future__ import annotations

import math
from os.path import commonprefix

import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.common import map_slices
from folioweave.llm.lexicon import count_words, sum_over_words
from folioweave.session import stage_table

#: What stands before a word in the vocabulary.
WORD_START = "▁"


def pre_tokens(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with their case; null has none."""
    return text.encode().split() if text else []


class Unigram:
    """Pieces of a public vocabulary with log probabilities that follow their rank.

    The file orders its pieces by rank and holds no counts, so the r-th piece gets
    1 / (r H), with H the harmonic number that makes the sum 1.  A character may
    always be spelled in bytes; each byte is a token less likely than any piece.
    """

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        total = math.log(sum(1.0 / r for r in range(1, len(pieces) + 1)))
        self.log_probs = {p: -math.log(r) - total for r, p in reversed(list(enumerate(pieces, 1)))}
        self.byte = -math.log(len(pieces) + 256) - total
        self.tree: dict = {}
        for piece, value in self.log_probs.items():
            node = self.tree
            for letter in piece:
                node = node.setdefault(letter, {})
            node[""] = value

    def extended(self, state: tuple, letter: str) -> tuple:
        """Forward state of a prefix with one more character.

        A state is the best log probability of the prefix, its number of tokens and
        the open paths through the vocabulary's tree.  Of equal log probabilities the
        one with fewer tokens wins.
        """
        score, count, paths = state
        size = len(letter.encode())
        best, tokens, onward = score + size * self.byte, count + size, []
        for at, n, node in [*paths, (score, count, self.tree)]:
            node = node.get(letter)
            if node is None:
                continue
            onward.append((at, n, node))
            if (value := node.get("")) is not None:
                total = at + value
                if total > best or (total == best and n + 1 < tokens):
                    best, tokens = total, n + 1
        return best, tokens, onward


def load_pieces(path: str) -> list[str]:
    """The vocabulary's ordinary pieces in the order of the file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not special(i)]


def price_words(lexicon: DataFrame, pieces: list[str]) -> DataFrame:
    """``(word, n, n_tokens, log_prob)`` of every distinct word.

    The words are sorted, so a task walks the trie of its words in depth-first
    order and computes each shared prefix once; it keeps the states of one word's
    prefixes only.  ``pieces`` is a vocabulary file, so its size is fixed.
    """
    count = int(lexicon.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = lexicon.sparkSession.sparkContext.broadcast(pieces)
    ordered = lexicon.select("word", "n").repartitionByRange(count, "word").sortWithinPartitions("word")

    def start():
        model = Unigram(shared.value)
        first = model.extended((0.0, 0, []), WORD_START)
        before, states = "", [first]

        def step(piece):
            nonlocal before, states
            tokens, scores = [], []
            for raw in piece.column(0).to_pylist():
                word = raw.decode()
                same = len(commonprefix((before, word)))
                del states[same + 1 :]
                for letter in word[same:]:
                    states.append(model.extended(states[-1], letter))
                before = word
                scores.append(states[-1][0])
                tokens.append(states[-1][1])
            return {"word": piece.column(0), "n": piece.column(1), "n_tokens": tokens, "log_prob": scores}

        return step

    return map_slices(ordered, "word binary, n bigint, n_tokens bigint, log_prob double", start, rows=4096)


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_words, n_tokens, log_prob)`` of every text.

    ``vocabulary`` is the path of a sentencepiece model on the driver.  Tokens are
    those of the most likely segmentation of each word, as :class:`Unigram` defines
    it.  Null and empty texts have no words and no tokens; repeated ids stay
    separate rows; an empty table gives no rows.
    """
    lexicon = stage_table(price_words(count_words(docs, pre_tokens, text_col), load_pieces(vocabulary)))
    sums = sum_over_words(docs, lexicon, ["n_tokens", "log_prob"], pre_tokens, id_col, text_col)
    return sums.select(id_col, "n_words", F.col("n_tokens").cast("bigint").alias("n_tokens"), "log_prob")
