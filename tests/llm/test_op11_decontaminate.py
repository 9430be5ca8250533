"""Winnowing against a search of every window in every text."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from veinstone.llm import decontaminate
from veinstone.llm.decontaminate import Words, _winnowed, contaminated, shared_spans, windows_of
from veinstone.llm.common import written

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def plain(docs, items):
    """Rows of contaminated() with spans, by looking at every window."""
    windows = {}
    for item, text in items:
        words = words_of(text)
        n = min(10, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[k : k + n]), set()).add(item)
    lengths, found = {len(w) for w in windows}, []
    for doc, text in docs:
        words, hit, names = words_of(text), set(), set()
        for n in lengths:
            for k in range(len(words) - n + 1):
                if (own := windows.get(tuple(words[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    names |= {str(x) for x in own if x is not None}
        spans = [k for k in sorted(hit) if k - 1 not in hit], [k + 1 for k in sorted(hit) if k + 1 not in hit]
        found.append((doc, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit), list(zip(*spans))))
    return sorted(found, key=str)


def corpus(seed, lengths=range(1, 31)):
    rng = random.Random(seed)
    vocabulary = [w for w in "the of and to a in is that it Für ÉTÉ x1 2024 naïve мир 数据 é".split()] + [f"w{k}" for k in range(25)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = some(14)
    items = [(k, some(n)) for k, n in enumerate(rng.choice(list(lengths)) for _ in range(25))]
    items += [(100, shared), (101, some(3) + shared), (102, shared[2:13]), (None, some(12)), (5, some(15)), (5, some(11))]
    glue = lambda words: "".join(w.upper() * (rng.random() < 0.2) or w for w in words for w in (w, rng.choice([" ", ", ", "\n", " - ", "_", "'"])))
    docs = []
    for k in range(60):
        text = some(rng.randrange(0, 80))
        for _ in range(rng.randrange(0, 4)):
            item = rng.choice(items)[1]
            at, cut = rng.randrange(len(text) + 1), rng.randrange(max(1, len(item) - 8))
            text[at:at] = item[cut : cut + rng.choice([9, 10, 11, 40])]
        docs.append((k, glue(text)))
    docs += [(None, glue(shared)), (None, None), (7, ""), (7, " .,\n"), (200, "x" * 50_000), (201, glue(shared * 500)), (202, docs[0][1]), (202, docs[0][1])]
    return docs, [(k, glue(words)) for k, words in items] + [(300, None), (301, ""), (302, "- -"), (100, glue(shared))]


@pytest.mark.parametrize("seed, lengths, broadcast", [(1, range(10, 31), 1 << 20), (2, range(5, 20), 1 << 20), (3, range(2, 4), 0), (4, range(8, 25), 0), (5, range(1, 2), 1 << 20)])
def test_equals_plain(spark, monkeypatch, seed, lengths, broadcast):
    monkeypatch.setattr(decontaminate, "AT_ONCE", 3000)
    docs, items = corpus(seed, lengths)
    frame = spark.createDataFrame([(t, d, "s", "c", "k") for d, t in docs], "text string, doc_id long, spans string, classes string, key string").repartition(3)
    windows = windows_of(spark.createDataFrame([(i, t, "d", "c") for i, t in items], "item_id long, text string, digest string, class string"))
    found = contaminated(written(shared_spans(frame, windows, broadcast=broadcast), "test"), windows).collect()
    assert sorted((tuple(r)[:6] + ([tuple(x) for x in r["spans"]],) for r in found), key=str) == plain(docs, items)


def test_every_window_has_its_mark_among_the_fingerprints():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(0, 200))) for _ in range(50)]
    words = Words(pa.array(texts))
    for n in range(1, 11):
        smallest, within, chosen = _winnowed(words, n)
        marks, k = set(chosen.tolist()), min(5, n)
        grams = words.grams(k)[0]
        for start in np.flatnonzero(within):
            assert any(at in marks and grams[at] == smallest[start] for at in range(start, start + n - k + 1))


def test_few_fingerprints_are_kept():
    rng = random.Random(7)
    words = Words(pa.array([" ".join(str(rng.randrange(10_000)) for _ in range(20_000))]))
    assert len(_winnowed(words, 10)[2]) < 20_000 * 0.3


def test_words_and_hashes_of_sliced_and_odd_arrays():
    texts = ["skip", None, "Ab cd", "", "cd", "éÉ cd_ab", None, "ab CD"]
    words = Words(pa.array(texts).slice(1))
    assert np.diff(words.first).tolist() == [len(words_of(t)) for t in texts[1:]]
    grams, within = words.grams(2)
    assert within.tolist() == [True, False, False, True, True, False, True] and grams[0] == grams[6] and len({*grams.tolist()}) == 6
    assert Words(pa.array([], pa.string())).grams(3)[0].tolist() == [] and Words(pa.array([None, ""], pa.string())).grams(1)[0].tolist() == []


def test_common_passage_is_no_pair_of_documents_and_items(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    docs = spark.range(400).selectExpr("id AS doc_id", f"concat('start{{', id, '}} {passage} end') AS text")
    items = windows_of(spark.range(300).selectExpr("id AS item_id", f"concat('item', id, ' {passage}') AS text"))
    assert items.windows.where("digest is not null").count() == 300 + 21 and items.windows.select("class").distinct().count() == 301
    for broadcast in (1 << 20, 0):
        rows = contaminated(written(shared_spans(docs, items, broadcast=broadcast), "test"), items).collect()
        assert {(r["n_hit"], r["n_items"], len(r["spans"])) for r in rows} == {(30, 300, 1)} and len(rows) == 400


def test_empty(spark):
    nothing = windows_of(spark.createDataFrame([], "item_id long, text string"))
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    for broadcast in (1, -1):
        found = contaminated(written(shared_spans(docs, nothing, broadcast=broadcast), "test"), nothing).collect()
        assert sorted((r["n_words"], r["contaminated"]) for r in found) == [(0, False), (2, False)]
