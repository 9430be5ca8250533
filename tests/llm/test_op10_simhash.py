import random
import re

import numpy as np
from pyspark.sql import functions as F
import pytest
import xxhash

from veinstone.llm import simhash as S


def plain_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] if len(words) >= n else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes, most=3):
    label = np.arange(len(codes))
    for k in range(len(codes)):
        near = np.flatnonzero(np.bitwise_count(codes ^ codes[k]) <= most)
        S.unite(label, near, np.full(len(near), k))
    return label


def test_documents(spark, odd):
    rows = S.near_duplicates(odd).collect()
    prints = {}
    for r in odd.collect():
        prints.setdefault(plain_fingerprint(r.text or ""), []).append(r.doc_id)
    codes = sorted(prints)
    label = {c: min((d for d in prints[c] if d is not None), default=S.NO_ID) for c in codes}
    for _ in codes:
        for a in codes:
            for b in codes:
                if (a ^ b).bit_count() <= 3:
                    label[a] = label[b] = min(label[a], label[b])
    for r in rows:
        want = label[int(r.fingerprint, 16)]
        assert r.component_id == (None if want == S.NO_ID else want)
    assert sorted(int(r.fingerprint, 16) for r in rows) == sorted(c for c in codes for _ in prints[c])


def _clouds(rng, words=1):
    centres = rng.integers(0, 1 << 63, (20, words), dtype="u8")
    near = [centres]
    for _ in range(15):
        flips = np.zeros((20, words), "u8")
        for _ in range(2):
            flips[np.arange(20), rng.integers(0, words, 20)] ^= np.uint64(1) << rng.integers(0, 64, 20, dtype="u8")
        near.append(centres ^ flips)
    return np.unique(np.concatenate(near), axis=0)


@pytest.mark.parametrize("words", [1, 3])
def test_index_finds_all_pairs(words):
    rng = np.random.default_rng(3)
    for most in (0, 3, 10):
        codes = _clouds(rng, words)
        buckets = (codes[:, 0] % np.uint64(3)).astype("i8")
        index = S.GrayIndex(buckets, codes)
        ordered, homes = codes[index.order], buckets[index.order]
        i, j = np.triu_indices(len(codes), 1)
        near = (np.bitwise_count(ordered[i] ^ ordered[j]).sum(axis=1) <= most) & (homes[i] == homes[j])
        found = [(a, b) for x, y in index.links(most, np.arange(len(codes))) for a, b in zip(x.tolist(), y.tolist())]  # labels that never change: every pair comes out
        assert sorted(found) == sorted(zip(i[near].tolist(), j[near].tolist()))
        want, pruned = np.arange(len(codes)), np.arange(len(codes))
        S.unite(want, i[near], j[near])
        for a, b in index.links(most, pruned):
            S.unite(pruned, a, b)
        assert (pruned == want).all()


def test_upper_nodes_hold_shared_patterns_that_prune(monkeypatch):
    rng = np.random.default_rng(5)
    codes = _clouds(rng)
    index = S.GrayIndex(np.zeros(len(codes), "i8"), codes)
    ordered = codes[index.order]
    for (patterns, masks), leaves in zip(index.levels, index.leaves):
        for k in range(len(patterns)):
            below = ordered[leaves[k] : leaves[k + 1]]
            assert ((below & masks[k]) == patterns[k]).all()
            assert masks[k] == ~np.bitwise_or.reduce(below ^ below[0], axis=0)  # every shared bit, not only leading ones
    assert any(bin(int(m))[2:].zfill(64).lstrip("1").count("1") for m in index.levels[1][1][:, 0])
    # Without the patterns of upper nodes nothing is pruned: the same pairs, but many more to look at.
    found, looked, real = [], [], np.bitwise_count
    for levels in (index.levels, [index.levels[0], *[(p, np.zeros_like(m)) for p, m in index.levels[1:]]]):
        index.levels, seen = levels, []
        monkeypatch.setattr(S.np, "bitwise_count", lambda x, seen=seen: (seen.append(len(x)), real(x))[1])
        found.append(sum(len(a) for a, _ in index.links(3, np.arange(len(codes)))))
        looked.append(sum(seen))
    assert found[0] == found[1] and looked[1] > 2 * looked[0]


def test_links_against_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(40)]
    codes = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4))) for c in centres for _ in range(20)} | {rng.getrandbits(48) for _ in range(200)}
    array = np.array(sorted(codes), "u8")
    nodes = spark.createDataFrame([(c,) for c in array.view("i8").tolist()], "node long")
    want = plain_components(array)
    for split, piece in ((S.SPLIT, S.PIECE), (5, S.PIECE), (S.SPLIT, 3)):  # smaller buckets, and pieces of buckets, find the same
        monkeypatch.setattr(S, "SPLIT", split)
        monkeypatch.setattr(S, "PIECE", piece)
        sets = S.written(S._within_bits(nodes, 3), "test")
        found = {r.node: r.label for r in S.connected(sets).collect()}
        groups = {}
        for c, l in zip(array.view("i8").tolist(), want.tolist()):
            groups.setdefault(l, []).append(c)
        assert found == {c: min(g) for g in groups.values() if len(g) > 1 for c in g}


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds, real = [], S.superseded
    monkeypatch.setattr(S, "superseded", lambda df: (rounds.append(1), real(df)))
    sets = spark.createDataFrame([(n, f"s{k}") for k in range(300) for n in ((k * 7) % 301, ((k + 1) * 7) % 301)], "node long, set string")
    assert {r.label for r in S.connected(sets).collect()} == {0} and len(rounds) <= 2 * 14


def _pairs(rng, edits, count=300, words=250):
    """Isolated pairs of texts, and their similarities."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    rows, alike = [], []
    for k in range(count):
        text = [word() for _ in range(words)]
        other = list(text)
        for at in rng.sample(range(words), edits):
            other[at] = word()
        sets = [{tuple(t[i : i + 5]) for i in range(words - 4)} for t in (text, other)]
        alike.append(len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
    return rows, alike


def test_isolated_pairs_around_the_similarity(spark, monkeypatch):
    """Links at 0.80 to 0.85 are found, those below aren't made, in whole buckets and in pieces alike."""
    rng = random.Random(6)
    some = [_pairs(rng, edits) for edits in (4, 5, 6, 7)]
    rows = [(i + 10_000 * n, t) for n, (r, _) in enumerate(some) for i, t in r]
    alike = {10_000 * n + 2 * k: s for n, (_, a) in enumerate(some) for k, s in enumerate(a)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    results = []
    for piece in (S.PIECE, 1):
        monkeypatch.setattr(S, "PIECE", piece)
        found = {r.doc_id: r.component_id for r in S.similar(docs).collect()}
        linked = {k for k in alike if found[k + 1] == k}
        near, far = [k for k, s in alike.items() if 0.8 <= s < 0.85], [k for k, s in alike.items() if s < 0.8]
        assert len(near) > 200 and len(far) > 200
        assert sum(k in linked for k in near) >= 0.9 * len(near)
        assert not any(k in linked for k in far)
        assert all(found[k] == k for k in alike)
        results.append(linked)
    assert results[0] == results[1]


def test_similar_texts_stay_once(spark):
    rng = random.Random(6)
    near, _ = _pairs(rng, 2, 60)
    far, _ = _pairs(rng, 40, 60)
    rows = near + [(i + 1000, t) for i, t in far] + [(5000, None), (5001, ""), (5002, "one word"), (5003, "One  word")]
    kept = {r.doc_id for r in S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {2 * k for k in range(60)} | {1000 + k for k in range(120)} | {5000, 5002}


def test_dense_group_is_compared_once_each(spark):
    """A group of near copies costs about one comparison for each, as components aren't compared within."""
    label, asked = np.arange(200), []
    a, b = np.triu_indices(200, 1)
    S.unite_verified(label, a, b, lambda i, j: not asked.append((i, j)))
    assert (label == 0).all() and len(asked) < 400
    label = np.arange(30)
    a, b = np.triu_indices(30, 1)
    S.unite_verified(label, a, b, lambda i, j: (i + j) % 29 == 1)
    want = np.arange(30)
    S.unite(want, a[(a + b) % 29 == 1], b[(a + b) % 29 == 1])
    assert (label == want).all()


def test_rows_without_ids_and_clashing_columns(spark):
    """Every component keeps one row, with its own values, whatever ids and names there are."""
    rng = random.Random(8)
    a, b, c, d = (" ".join(f"{x}{rng.randrange(10_000)}" for _ in range(60)) for x in "abcd")
    rows = [(1, a), (None, a), (None, b), (4, c), (None, c + " more"), (3, c), (None, d), (None, d), (None, d + " end"), (7, None), (None, ""), (9, b[:100]), (9, a[:90]), (9, a[:90])]
    names = {"_key": "k", "_nth": "n", "row": "r", "rows": "s", "whole": "w", "root": "t", "bits": "u", "first": "f"}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({name: F.concat(F.lit(x), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for name, x in names.items()})
    docs = docs.withColumn("counts", F.create_map(F.lit("x"), F.col("doc_id")))
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    found = kept.collect()
    assert all(r[name] == x + ("-" if r.doc_id is None else str(r.doc_id)) for r in found for name, x in names.items())
    assert {(r.doc_id, r.text) for r in found} - {(None, d), (None, d + " end")} == {(1, a), (None, b), (3, c), (7, None), (9, b[:100]), (9, a[:90])}
    assert len(found) == 7


def test_many_rows_without_ids(spark, monkeypatch):
    """Equal rows, more than a hot key's share, leave one; and rows without ids don't meet in one task."""
    monkeypatch.setattr(S, "HOT_SHARE", 8)
    rng = random.Random(9)
    text = lambda: " ".join(str(rng.randrange(10_000)) for _ in range(30))
    same, others = text(), [text() for _ in range(200)]
    rows = [(None, same)] * 300 + [(None, t) for t in others] + [(5, others[0])] * 3
    found = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in found) == sorted([(5, others[0]), (0, same)] + [(0, t) for t in others[1:]])
