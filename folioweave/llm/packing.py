"""Documents packed into token sequences of a fixed capacity by best-two-fit."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from folioweave.llm.bpe import byte_letters
from folioweave.llm.common import map_slices
from folioweave.session import stage_table

#: Tokens of a sequence, and the id that ends every document.
CAPACITY, END = 1024, 2
#: Characters that are encoded at a time; longer texts are cut where no token can cross.
SEGMENT = 1 << 16
#: The word pattern of byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A single blank between two other characters always begins a word of the pattern.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Runs of white space that the pattern's matcher cannot take in one piece.
_LONG_BLANK = re.compile(r"\s{512}")
_LOADED: dict[str, "ByteBpe"] = {}


class ByteBpe:
    """A byte-level BPE vocabulary file, read into the two public libraries.

    Ranked merges give the same ids as the merge list, because its ids follow the
    order of the merges; this is checked.  The first library takes ordinary text,
    the second, slower one takes the few segments that hold very long blanks.
    """

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        octet = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(map(octet.__getitem__, t)): i for t, i in vocab.items() if t not in self.special}
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("the ids of this vocabulary do not follow its merges")
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_str(blob.decode())
        self.slow.no_truncation()
        self.slow.no_padding()
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def _plain(self, text: str) -> list[np.ndarray]:
        parts, at = [], 0
        while at < len(text):
            found = _CUT.search(text, at + SEGMENT) if len(text) - at > SEGMENT else None
            stop = found.start() if found else len(text)
            piece = text[at:stop]
            ids = self.slow.encode(piece, add_special_tokens=False).ids if _LONG_BLANK.search(piece) else self.fast.encode_ordinary(piece)
            parts.append(np.array(ids, np.uint32))
            at = stop
        return parts

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the text without added ends; special tokens in it have their own ids."""
        if not text:
            return np.zeros(0, np.uint32)
        parts, at = [], 0
        for found in self.marks.finditer(text) if self.marks else ():
            parts += self._plain(text[at : found.start()])
            parts.append(np.array([self.special[found[0]]], np.uint32))
            at = found.end()
        parts += self._plain(text[at:])
        return np.concatenate(parts)


def loaded(blob: bytes) -> ByteBpe:
    """The vocabulary, parsed once per worker process."""
    key = hashlib.sha256(blob).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(blob)
    return _LOADED[key]


def piece_ends(n: int, capacity: int) -> list[int]:
    """Ends of the pieces of ``n`` tokens: whole sequences, of which the first may be shorter."""
    return list(range((n - 1) % capacity + 1, n + 1, capacity))


def cut_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id",
    text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """``(id_col, piece, start, length, ids_crc32, chunk, nth[, ids])``: the pieces of every document.

    A document is its ids and the id ``end``; only what is longer than ``capacity``
    is cut.  Null and empty texts are the end alone.  ``chunk`` is the task that
    made a piece and ``nth`` its number among the pieces of that task and length,
    so ranks by length need no sort.  The vocabulary file travels as one broadcast.
    """
    with open(vocabulary, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def start():
        model, chunk = loaded(shared.value), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)

        def step(slice_):
            made: dict[str, list] = {k: [] for k in ("at", "piece", "start", "length", "crc", "nth", "ids")}
            for at, text in enumerate(slice_.column(1).to_pylist()):
                ids = np.append(model.encode(text), np.uint32(end)).astype("<u4")
                first = 0
                for piece, last in enumerate(piece_ends(len(ids), capacity)):
                    own, size = ids[first:last], last - first
                    for k, v in zip(made, (at, piece, first, size, zlib.crc32(own.tobytes()), seen[size], own.astype(np.int32) if with_ids else None)):
                        made[k].append(v)
                    seen[size] += 1
                    first = last
            columns = {
                "id": slice_.column(0).take(made["at"]), "piece": made["piece"], "start": made["start"], "length": made["length"],
                "ids_crc32": made["crc"], "chunk": [chunk] * len(made["at"]), "nth": made["nth"],
            }
            return columns | {"ids": made["ids"]} if with_ids else columns

        return step

    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, chunk int, nth bigint" + ", ids array<int>" * with_ids
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_slices(chosen, schema, start).withColumnRenamed("id", id_col)


@dataclass(frozen=True)
class Filling:
    """``repeats`` sequences of equal content, numbered from ``first``: how often each length occurs in one."""

    first: int
    repeats: int
    lengths: dict[int, int]


def _fill(left: np.ndarray, capacity: int) -> tuple[dict[int, int], int]:
    """The longest pieces that still fit, until none does; and the gap."""
    taken: dict[int, int] = {}
    sizes, gap = np.flatnonzero(left), capacity
    while (at := int(np.searchsorted(sizes, gap, side="right")) - 1) >= 0:
        size = int(sizes[at])
        taken[size] = min(int(left[size]), gap // size)
        gap -= size * taken[size]
        sizes = sizes[:at]
    return taken, gap


def _best_pair(left: np.ndarray, room: int) -> tuple[int, int]:
    """Two unpacked lengths with the largest sum up to ``room``, the longer first; zeros if there are none."""
    there = np.where(left > 0, np.arange(len(left)), 0)
    below = np.maximum.accumulate(there)
    longer = there[1 : room + 1]
    longer = longer[longer > 0]
    if not len(longer):
        return 0, 0
    shorter = below[np.minimum(longer - 1, room - longer)]
    shorter = np.where((left[longer] > 1) & (2 * longer <= room), longer, shorter)
    total = np.where(shorter > 0, longer + shorter, 0)
    best = int(total.max())
    at = int(np.flatnonzero(total == best)[-1])
    return (int(longer[at]), int(shorter[at])) if best else (0, 0)


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Filling]:
    """Sequences for ``counts[length]`` pieces, one sequence after another.

    A sequence takes the longest pieces that fit until none does.  Then its smallest
    piece makes room for the two unpacked ones that fill the gap and the smallest's
    place best, if they fill more.  Pieces of one length are alike, so equal
    decisions are taken once for as many sequences as the counts allow: the work
    depends on the number of lengths, not of documents.
    """
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        if n and not 1 <= size <= capacity:
            raise ValueError(f"a piece of {size} tokens does not fit a sequence of {capacity}")
        left[size] = n
    plan, first = [], 0
    while left.any():
        taken, gap = _fill(left, capacity)
        needed, content = dict(taken), dict(taken)
        if gap:
            rest, least = left.copy(), min(taken)
            for size, n in taken.items():
                rest[size] -= n
            pair = _best_pair(rest, gap + least)
            if sum(pair) > least:
                content[least] -= 1
                for size in pair:
                    needed[size] = needed.get(size, 0) + 1
                    content[size] = content.get(size, 0) + 1
        content = {size: n for size, n in content.items() if n}
        # as long as everything that was looked at is there, the next sequence is filled alike
        repeats = 1 + min(int(left[s] - needed[s]) // n for s, n in content.items())
        if any(s not in content and left[s] < needed[s] for s in needed):
            repeats = 1
        for size, n in content.items():
            left[size] -= n * repeats
        plan.append(Filling(first, repeats, content))
        first += repeats
    return plan


def _places(plan: list[Filling]) -> dict[int, np.ndarray]:
    """For each length its rows ``(rank, times, sequence, offset)``: pieces from ``rank`` on go ``times`` to a sequence."""
    used: dict[int, int] = {}
    rows: dict[int, list] = {}
    for filling in plan:
        offset = 0
        for size, times in sorted(filling.lengths.items(), reverse=True):
            rows.setdefault(size, []).append((used.get(size, 0), times, filling.first, offset))
            used[size] = used.get(size, 0) + times * filling.repeats
            offset += size * times
    return {size: np.array(own, np.int64).T for size, own in rows.items()}


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` of ``cut_pieces`` with ``sequence_id`` and ``offset`` in place of ``chunk`` and ``nth``.

    Only the number of pieces of each length, at most ``capacity`` rows, reaches the
    driver; the filling of the sequences goes back as a table whose size depends on
    the capacity alone.  A piece finds its place by its rank among the pieces of
    its length: the pieces of earlier tasks, one row per task and length, and its
    number within its task.  So a length that a third of all documents share is
    spread like any other.  ``pieces`` must be read from files.
    """
    counts = pieces.groupBy("chunk", "length").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    shared = pieces.sparkSession.sparkContext.broadcast(_places(best_two_fit({r["length"]: r["n"] for r in total}, capacity)))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    names = [c for c in pieces.columns if c not in ("chunk", "nth")]
    ranked = pieces.join(earlier, ["chunk", "length"]).select((F.col("nth") + F.col("earlier")).alias("rank"), *names)

    def start():
        places, length_at = shared.value, 1 + names.index("length")

        def step(slice_):
            rank, length = np.asarray(slice_.column(0)), np.asarray(slice_.column(length_at))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                own = length == size
                first, times, at_sequence, at_offset = places[int(size)]
                row = np.searchsorted(first, rank[own], side="right") - 1
                nth = rank[own] - first[row]
                sequence[own] = at_sequence[row] + nth // times[row]
                offset[own] = at_offset[row] + nth % times[row] * size
            return {c: slice_.column(1 + i) for i, c in enumerate(names)} | {"sequence_id": sequence, "offset": offset}

        return step

    kinds = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in names)
    return map_slices(ranked, f"{kinds}, sequence_id bigint, offset bigint", start, rows=1 << 14)


def pack_documents(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id",
    text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """``(id_col, piece, start, length, ids_crc32[, ids], sequence_id, offset)``: every piece and its place.

    Texts are encoded once, and the pieces are written to the shared folder before
    they are counted.  Sequences are numbered from 0 without gaps; the pieces of one
    follow each other from offset 0 on.  Repeated ids and rows are separate
    documents; ids may be null; other columns are not read.  A null or empty text
    is one token.  An empty table gives no rows.
    """
    return place_pieces(stage_table(cut_pieces(docs, vocabulary, capacity, end, id_col, text_col, with_ids)), capacity)
