"""SimHash groups against all pairs."""

import numpy as np
import pytest
import xxhash

from folioweave.llm import simhash
from folioweave.llm.common import folded_words

EDGE = [None, "", " \t", "one", "One two", "one two THREE", "one two three four", "é ü x 日本"]


def plain_fingerprint(text, k=3):
    words = folded_words(text)
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_groups(ids, fps, distance=3):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i, name in enumerate(ids):
        r = root(i)
        least[r] = min(least.get(r, name), name)
    return [least[root(i)] for i in range(len(ids))]


def texts():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocabulary, 300)) for _ in range(12)]
    out = list(EDGE)
    for b in base:
        words = b.split()
        for n in (0, 0, 1, 1, 2, 4):
            changed = list(words)
            for at in rng.integers(0, len(words), n):
                changed[at] = "X"
            out.append(" ".join(changed))
    return out


def test_fingerprint_of_edge_cases_and_shingle_sizes():
    for t in [*EDGE, "a " * 9000]:
        for k in (1, 3, 5):
            assert simhash.fingerprint(folded_words(t), k) == plain_fingerprint(t, k)


@pytest.mark.parametrize("tile", [4, 4096])
def test_groups_match_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rows = [(1000 - 7 * i, t, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    got = {r.id: r for r in simhash.near_duplicates(docs).collect()}
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    want = plain_groups([r[0] for r in rows], fps)
    assert [got[r[0]].fp & (2**64 - 1) for r in rows] == fps
    assert [got[r[0]].component for r in rows] == want
    assert len(set(want)) < len(set(fps))  # links between different fingerprints occur


def test_crowded_ball_links_without_all_pairs(spark):
    """Fingerprints that differ in a few low bits: the links are a forest, and the group is whole."""
    fps = sorted({(1 << a) | (1 << b) | (1 << c) for a in range(9) for b in range(9) for c in range(9)})
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp bigint")).distinct().collect()
    assert all((r.a ^ r.b).bit_count() <= 3 for r in links)
    assert len(links) <= 20 * len(fps)
    assert set(plain_groups(fps, fps)) == {min(fps)}
    from folioweave.llm.components import component_labels

    labels = component_labels(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert len(labels) == len(fps) and {r.label for r in labels} == {min(fps)}


def test_block_masks_share_whenever_three_bits_differ():
    rng = np.random.default_rng(1)
    masks = simhash.block_masks()
    for _ in range(300):
        flip = 0
        for b in rng.choice(64, 3, replace=False):
            flip |= 1 << int(b)
        assert any(flip & m == 0 for m in masks)


def test_empty_null_ids_and_keep_one(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(empty).count() == 0
    spark.createDataFrame(
        [(3, "a b c d", "k"), (2, "a b c d", "l"), (2, "a b c d", "m"), (None, "A B C D", "n"), (9, "other text here", "o"), (None, None, "p")],
        "doc_id bigint, text string, component string",
    ).coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.component for r in kept.collect()) == ["l", "o", "p"]
