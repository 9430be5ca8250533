import base64
import difflib
import hashlib
import random

import numpy as np

from veinstone.llm.fingerprints import Joined, PrefixHashes, compare_with_next, fingerprint, likeness, read_fingerprint


def test_against_plain_texts(spark, odd):
    docs = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    found = {r.doc_id: r for r in compare_with_next(docs).collect()}
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    for k, (doc_id, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        own, other, after = (fingerprint(PrefixHashes(x)) for x in (text, edited, following))
        r = found[doc_id]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), *(base64.b64encode(x).decode() for x in (own, other)))
        assert (r.near_edited, r.near_next) == (likeness(own, other), likeness(own, after))


def test_spans_and_extensions():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(1, 40))) for _ in range(2))
        x, y = PrefixHashes(a), PrefixHashes(b)
        i, j = rng.randrange(len(a)), rng.randrange(len(b))
        n = rng.randrange(min(len(a) - i, len(b) - j) + 1)
        assert (x.span(i, i + n) == y.span(j, j + n)) == (a[i : i + n] == b[j : j + n])
        want = next(k for k in range(min(len(a) - i, len(b) - j), -1, -1) if a[i : i + k] == b[j : j + k])
        assert x.common_extension(y, i, j) == want
        left, right = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        assert fingerprint(Joined(x, left, y, right)) == fingerprint(PrefixHashes(a[:left] + b[:right]))


def true_likeness(one, two):
    """Share of the longer text in common blocks, by brute force; blocks of chance don't count."""
    blocks = difflib.SequenceMatcher(None, one, two, autojunk=False).get_matching_blocks()
    return sum(b.size for b in blocks if b.size >= 24) / max(len(one), len(two))


def of(text):
    return fingerprint(PrefixHashes(text))


def test_likeness_against_brute_force():
    rng = random.Random(2)
    off = []
    for _ in range(60):
        text = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(300, 3000)))
        other = text
        for _ in range(rng.randrange(4)):
            at, size = rng.randrange(len(other)), rng.randrange(60)
            other = other[:at] + "".join(rng.choice("xyz") for _ in range(rng.randrange(40))) + other[at + rng.choice([0, size]) :]
        found, want = likeness(of(text), of(other)), true_likeness(text, other)
        assert found <= want + 0.05  # never more than there is
        off.append(want - found)
    assert sum(off) / len(off) < 0.15 and sorted(off)[54] < 0.45


def test_likeness():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(4000)) for _ in range(40)]
    text = texts[0]
    assert likeness(of(text), of(text)) == 1.0 and likeness(of(""), of("")) == 1.0 and likeness(of(""), of("x")) == 0.0
    edited = [("#" + t + "#", t[:400] + "#" + t[401:3600] + "#" + t[3601:], t[:2000] + "#" + t[2000:]) for t in texts]
    of_ends, of_two, of_one = ([likeness(of(t), of(e[k])) for t, e in zip(texts, edited)] for k in range(3))
    assert np.mean(of_ends) > 0.85 and np.mean(of_two) > 0.8 and np.mean(of_one) > 0.9
    assert min(of_ends) > 0.6 and min(of_two) > 0.5 and min(of_one) > 0.7
    assert 0.3 < likeness(of(text), of(text[:2000] + text[:2000])) < 0.6
    assert 0.2 < likeness(of(text), of(text[2000:] + "".join(rng.choice("uvw") for _ in range(2000)))) <= 0.5
    assert likeness(of(text), of(text[::-1])) == 0.0
    assert likeness(of("a" * 500), of("a" * 500)) == 1.0 and likeness(of("short"), of("other")) == 0.0
    long = text * 3 + "".join(rng.choice("abcdefgh ") for _ in range(60_000))
    assert 0 < likeness(of(long), of(long[:30_000])) <= 0.5


def test_coarser_spans_are_unions():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    hashes, spans = PrefixHashes(text), read_fingerprint(of(text))
    for zeros in range(spans.zeros, spans.zeros + 6):
        coarse, at = spans.coarser(zeros), 0
        for size, value in zip(coarse.sizes, coarse.hashes):
            assert hashes.span(at, at + size) == value
            at += size
        assert at == len(text) and len(coarse.levels) == len(coarse.sizes)


def test_rows_of_one_id_are_spread(spark):
    docs = spark.createDataFrame([(None, f"text {k % 7}") for k in range(400)], "doc_id long, text string").repartition(4)
    found = compare_with_next(docs)
    assert found.count() == 400
    once, again = (sorted(map(tuple, compare_with_next(docs.repartition(n)).drop("doc_id").collect())) for n in (2, 5))
    assert once == again


def repetitive(rng):
    """Texts that repeat themselves: periodic ones, one line again and again, few lines in any order, junk with repeats, prose with a repeated passage."""
    word = lambda n: "".join(rng.choice("abcdefghijkl") for _ in range(n))
    line, lines = " ".join(word(5) for _ in range(12)) + "\n", [" ".join(word(4) for _ in range(9)) + "\n" for _ in range(5)]
    passage, prose = " ".join(word(6) for _ in range(40)), [" ".join(word(rng.randrange(2, 9)) for _ in range(120)) for _ in range(2)]
    return [
        "abcdefgh " * rng.randrange(100, 400), word(rng.randrange(2, 30)) * rng.randrange(60, 200), line * rng.randrange(20, 200), "".join(rng.choice(lines) for _ in range(rng.randrange(20, 120))),
        "#$% " * rng.randrange(80, 300) + word(200) + "=" * rng.randrange(100, 900), prose[0] + (passage + ". ") * rng.randrange(2, 9) + prose[1], "a" * rng.randrange(300, 3000), "ab" * 700 + "ba" * 700,
    ]


def test_repetitive_texts():
    """One changed, added or removed character leaves nearly all, and other edits as much as there is in common."""
    rng = random.Random(5)
    one, off = [], []
    for _ in range(12):
        for text in repetitive(rng):
            at = rng.randrange(len(text))
            for other in (text[:at] + "#" + text[at + 1 :], "#" + text, text[:at] + text[at + 1 :], text + "#"):
                one.append(likeness(of(text), of(other)))
            half = text[: len(text) - len(text) // 2] + "".join(rng.choice("UVWXYZ") for _ in range(len(text) // 2))
            off.append(true_likeness(text, half) - likeness(of(text), of(half)))
    assert min(one) > 0.3 and np.mean(one) > 0.85 and sorted(one)[len(one) // 20] > 0.6
    assert abs(np.mean(off)) < 0.1 and max(map(abs, off)) < 0.5
