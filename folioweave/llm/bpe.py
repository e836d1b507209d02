"""BPE encoding by greedy proposals that are verified pair by pair, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.common import map_slices

#: Bytes of a generation of remembered words, two of which a worker holds, and what one costs besides its letters.
REMEMBERED, ENTRY = 96 << 20, 280
#: Pairs of tokens whose test a worker remembers.
PAIRS = 400_000
_SELF = 0xFFFF_FFFF
#: A merge is one number: its rank, and below that the new token.
_TOKEN = (1 << 20) - 1
_LOADED: dict[str, "WordBpe"] = {}


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary.

    Bytes that print in Latin-1 stand for themselves; the others follow in order from U+0100.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class WordBpe:
    """A word-level BPE vocabulary file: normaliser, word pattern, merges and special tokens."""

    def __init__(self, blob: bytes, remembered: int = REMEMBERED):
        spec = json.loads(blob)
        model = spec["model"]
        self.remembered, self.used = remembered, 0
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts = {i: t for t, i in (self.ids | self.special).items()}
        self.by_text = {str(i): t for i, t in self.texts.items()}
        self.merges: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.ids[left], self.ids[right]] = rank << 20 | self.ids[left + right]
        self.no_merge = len(self.merges) << 20
        steps = {s["type"]: s for s in spec["pre_tokenizer"]["pretokenizers"]}
        self.pattern = regex.compile(steps["Split"]["pattern"]["Regex"])
        self.specials = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.longest = max(map(len, self.ids))
        self.letters = byte_letters()
        self.tree: dict = {}
        for text, token in self.ids.items():
            node = self.tree
            for letter in text:
                node = node.setdefault(letter, {})
            node[""] = token
        self.words: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.spellings: dict[int, list[int]] = {}
        self.fits: dict[int, bool] = {}

    # -- text to words ---------------------------------------------------------
    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        # each letter by itself: a word-final sigma is not special
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def split(self, text: str) -> list[str]:
        """Words between white space; special tokens stand alone, marked by a leading space."""
        if self.specials is None or "<|" not in text or not self.specials.search(text):
            return self._plain(text)
        out, at = [], 0
        for found in self.specials.finditer(text):
            out += self._plain(text[at : found.start()])
            out.append(" " + found[0])
            at = found.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        text = self.normal(text)
        # str.split also splits at these four, which are not white space here
        return regex.split(r"\s+", text) if re.search("[\x1c-\x1f]", text) else text.split()

    # -- words to ids ----------------------------------------------------------
    def symbols(self, piece: str) -> list[int]:
        letters = [self.letters[b] for b in piece.encode()]
        letters[-1] += self.end
        return [self.ids[s] for s in letters]

    def greedy(self, piece: str) -> list[int]:
        """The longest vocabulary entry at each place, from the left."""
        text = piece if piece.isascii() and piece.isprintable() else "".join([self.letters[b] for b in piece.encode()])
        out, at, size, ids = [], 0, len(text), self.ids
        while at < size:
            if size - at <= self.longest and (last := ids.get(text[at:] + self.end)) is not None:
                out.append(last)
                break
            node, stop = self.tree, at
            for i in range(at, size - 1):
                node = node.get(text[i])
                if node is None:
                    break
                if "" in node:
                    one, stop = node[""], i + 1
            out.append(one)
            at = stop
        return out

    def exact(self, symbols: list[int]) -> list[int]:
        """The merges in order of rank, leftmost first."""
        return self._merge_short(symbols) if len(symbols) <= 24 else self._merge_long(symbols)

    def _merge_short(self, symbols: list[int]) -> list[int]:
        ids, get, none = list(symbols), self.merges.get, self.no_merge
        found = [get(pair, none) for pair in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best == none:
                break
            i = found.index(best)
            new = ids[i] = best & _TOKEN
            del found[i], ids[i + 1]
            if i:
                found[i - 1] = get((ids[i - 1], new), none)
            if i < len(found):
                found[i] = get((new, ids[i + 1]), none)
        return ids

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same on a linked list with a heap, for long words."""
        ids, after = list(symbols), list(range(1, len(symbols) + 1))
        before, alive = list(range(-1, len(symbols) - 1)), [True] * len(symbols)
        heap = [(m, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (m := self.merges.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i] = self.merges[a, b] & _TOKEN
            alive[j], after[i] = False, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(ids) and (m := self.merges.get((ids[left], ids[right]))) is not None:
                    heapq.heappush(heap, (m, left, ids[left], ids[right]))
        return [t for t, on in zip(ids, alive) if on]

    def _spelled(self, token: int) -> list[int]:
        """The single symbols of a token; all tokens together are as large as the vocabulary."""
        if token not in self.spellings:
            self.spellings[token] = self._spell(self.texts[token])
        return self.spellings[token]

    def _spell(self, text: str) -> list[int]:
        stem, ending = (text[: -len(self.end)], True) if text.endswith(self.end) and len(text) > len(self.end) else (text, False)
        letters = list(stem)
        if ending:
            letters[-1] += self.end
        return [self.ids[s] for s in letters]

    def _fit(self, key: int) -> bool:
        left, right = key >> 32, key & 0xFFFF_FFFF
        if right == _SELF:
            return self.exact(self._spelled(left)) == [left]
        return self.exact(self._spelled(left) + self._spelled(right)) == [left, right]

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece: proposals of all pieces are tested together, pair by pair.

        A sequence whose every adjacent pair is what merging the two alone gives is
        what merging the whole gives.  Only pieces with a failing pair are merged.
        """
        proposed = [self.greedy(p) for p in pieces]
        sizes = np.array([len(p) for p in proposed])
        flat = np.array([t for p in proposed for t in p], np.int64)
        right = np.append(flat[1:], _SELF)
        ends = np.cumsum(sizes) - 1
        right[ends] = _SELF
        keys = (flat << 32) | right
        tested = np.ones(len(keys), bool)
        tested[ends] = sizes == 1  # the pair before the last token already proves it
        distinct, where = np.unique(keys, return_inverse=True)
        need = np.zeros(len(distinct), bool)
        need[where[tested]] = True
        for key in distinct[need].tolist():
            if key not in self.fits:
                self.fits[key] = self._fit(key)
        good = np.array([self.fits.get(k, True) for k in distinct.tolist()], bool)[where] | ~tested
        fine = np.logical_and.reduceat(good, ends - sizes + 1)
        return [p if ok else self.exact(self.symbols(w)) for p, ok, w in zip(proposed, fine, pieces)]

    def pieces(self, word: str) -> list[str]:
        """The parts that the vocabulary's pattern cuts a word into."""
        if word.isalpha():
            return [word]
        if word[-1] in ".,;:!?" and word[:-1].isalpha():
            return [word[:-1], word[-1]]
        return self.pattern.findall(word)

    def learn(self, words: set[str]) -> None:
        """Encode words that are not remembered yet.

        Two generations of words are kept: when the younger is full the older one
        goes, so that frequent words stay.  Both are bounded in bytes.
        """
        if self.used > self.remembered:
            self.words, self.older, self.used = {}, self.words, 0
        if len(self.fits) > PAIRS:
            self.fits.clear()
        known, older = self.words, self.older
        fresh = words - known.keys()
        known.update((w, older[w]) for w in fresh & older.keys())
        split = {w: self.pieces(w) for w in fresh if w not in known and w[0] != " "}
        missing = list({p for parts in split.values() for p in parts} - known.keys())
        if missing:
            known.update(zip(missing, (" ".join(map(str, ids)) for ids in self.encode_pieces(missing))))
        for word, parts in split.items():
            if word not in known:
                known[word] = " ".join([known[p] for p in parts])
        for word in fresh:
            if word[0] == " ":
                known[word] = str(self.special[word[1:]])
        # a letter of a word, and what it may become: a few digits
        self.used += sum(ENTRY + 8 * len(w) for w in fresh) + sum(ENTRY + 8 * len(p) for p in missing)

    def encode(self, texts: list[str | None]) -> list[str]:
        """Ids in decimal, joined by one space; null and empty texts give the empty string."""
        split = [[w for w in self.split(t) if w] if t else [] for t in texts]
        self.learn({w for s in split for w in s})
        return [" ".join(filter(None, map(self.words.__getitem__, s))) for s in split]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's texts joined by one space, word ends and special tokens included."""
        return " ".join(map(self.texts.__getitem__, ids))


def loaded(blob: bytes, remembered: int = REMEMBERED) -> WordBpe:
    """The vocabulary, parsed once per worker process."""
    key = f"{hashlib.sha256(blob).hexdigest()} {remembered}"
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(blob, remembered)
    return _LOADED[key]


def _map(docs: DataFrame, vocabulary: str, schema: str, keep: list[str], columns, remembered: int = REMEMBERED) -> DataFrame:
    """Apply ``columns(model, last column's values)``; the file goes to the tasks as one broadcast."""
    with open(vocabulary, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def start():
        model = loaded(shared.value, remembered)

        def step(piece):
            made = columns(model, piece.column(len(keep)).to_pylist())
            return {name: piece.column(i) for i, name in enumerate(keep)} | made

        return step

    return map_slices(docs, schema, start)


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens, ids)`` per row; ids is an array of int, empty for null or empty texts.

    ``vocabulary`` is the path of a word-level BPE file on the driver; its size is that
    of the file whatever the table's size.  There is no shuffle: a row's result depends
    on its text alone, so lost tasks are simply run again.
    """
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def columns(model, texts):
        lines = [[int(x) for x in line.split()] for line in model.encode(texts)]
        return {"n_tokens": [len(x) for x in lines], "ids": lines}

    kind = docs.schema[id_col].dataType.simpleString()
    return _map(chosen, vocabulary, f"id {kind}, n_tokens bigint, ids array<int>", ["id"], columns).withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, text)`` per row of ``(id_col, ids)``; null ids give the empty text."""
    chosen = encoded.select(F.col(id_col).alias("id"), F.col("ids").alias("ids"))
    kind = encoded.schema[id_col].dataType.simpleString()

    def columns(model, rows):
        return {"text": [model.decode(ids or []) for ids in rows]}

    return _map(chosen, vocabulary, f"id {kind}, text string", ["id"], columns).withColumnRenamed("id", id_col)


def round_trip(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, remembered: int = REMEMBERED,
) -> DataFrame:
    """``(id_col, n_tokens, ids_sha256, decoded_sha256)`` per row, and ``ids`` if asked for.

    Each text is encoded and its ids are decoded in the same task; the digests are
    of the decimal ids joined by one space and of the decoded text.  ``remembered``
    is the memory in bytes for one generation of a worker's words.
    """
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def columns(model, texts):
        by_text = model.by_text.__getitem__
        counts, digests, decoded, ids = [], [], [], []
        for line in model.encode(texts):
            parts = line.split()
            counts.append(len(parts))
            digests.append(hashlib.sha256(line.encode()).hexdigest())
            decoded.append(hashlib.sha256(" ".join(map(by_text, parts)).encode()).hexdigest())
            ids.append(np.array(parts, np.int32) if with_ids else None)
        made = {"n_tokens": counts, "ids_sha256": digests, "decoded_sha256": decoded}
        return made | {"ids": ids} if with_ids else made

    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return _map(chosen, vocabulary, schema, ["id"], columns, remembered).withColumnRenamed("id", id_col)
