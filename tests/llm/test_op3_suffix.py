import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from veinstone.llm import suffix_dedup as S


def brute(docs, length=50):
    first = {}
    for i, t in sorted(docs, key=lambda r: r[0]):
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], i)
    out = []
    for i, t in docs:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, x in zip(t, gone) if not x)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("chunk_bytes, heavy", [(None, S.HEAVY), (3000, S.HEAVY), (3000, 2), (700, 0)])
def test_against_brute_force(spark, chunk_bytes, heavy):
    rng = random.Random(2)
    base, docs = "".join(rng.choice("abcd ") for _ in range(3000)), []
    for i in range(100):
        text = ""
        for _ in range(rng.randrange(0, 8)):
            a = rng.randrange(2900)
            text += base[a : a + rng.choice([30, 49, 50, 51, 120, 400])] + rng.choice(["", "x", "é", "a" * 70])
        docs.append((i * 7 % 101, text))
    docs += [(5000, None), (5001, "a" * 5000), (5002, "a" * 5000), (7, docs[3][1])]
    found = S.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), chunk_bytes=chunk_bytes, heavy=heavy)
    assert sorted(map(tuple, found.collect())) == brute([(i, (t or "").encode()) for i, t in docs])


def test_spans(spark):
    rng = random.Random(1)
    same = "".join(rng.choice("abcdef") for _ in range(60))
    docs = spark.createDataFrame([(1, "x" + same), (2, "yy" + same + "z"), (None, same)], "doc_id long, text string")
    found = {r.doc_id: ([(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in S.remove_repeats(docs, result="spans").collect()}
    assert found == {1: ([], ("x" + same).encode()), 2: ([(2, 62)], b"yyz"), None: ([(0, 60)], b"")}


def plain_factors(text, owners, depth):
    """The longest match of each suffix with one of a smaller owner, up to a depth, of suffixes that are as long."""
    match = lambda i, j: next((n for n in range(depth) if text[i + n] != text[j + n]), depth)
    whole = range(len(text) - depth + 1)
    return [max([0, *(match(i, j) for j in whole if owners[j] < owners[i])]) for i in whole] + [0] * min(len(text), depth - 1)


@pytest.mark.parametrize("depth", [3, 8, 9, 50])
def test_longest_previous_factors(depth):
    rng = random.Random(4)
    for text in [b"", b"aaaa" * 20, b"abracadabra" * 9, bytes(rng.choice(b"ab") for _ in range(160))]:
        # Each byte an owner of its own, and owners of several bytes.
        for owners in (list(range(len(text))), [k // 7 for k in range(len(text))]):
            found = S.longest_previous_factors(np.frombuffer(text, "u1"), np.array(owners, "i8"), np.full(len(text), len(text)), depth)
            assert found.tolist() == plain_factors(text, owners, depth)


def test_factors_decide(spark, monkeypatch):
    """Without the factors, strings of segments that differ would stay."""
    rng = random.Random(3)
    same = "".join(rng.choice("abcdefgh") for _ in range(60))
    docs = spark.createDataFrame([(k, f"{k}" * 20 + same + f"{k}" * 20) for k in range(3)], "doc_id long, text string")
    text = [(k, (f"{k}" * 20 + same + f"{k}" * 20).encode()) for k in range(3)]
    assert sorted(map(tuple, S.remove_repeats(docs).collect())) == brute(text)
    rows = pa.table({"segments": [S.zstandard.compress(_packed([(9, k, t) for k, t in text]), 3)], "part": [0], "offset": [0], "size": [0], "bucket": [0]})
    answer = lambda: S.zstandard.decompress(S._answered(50, rows).column("answer")[0].as_py())
    real = answer()
    monkeypatch.setattr(S, "longest_previous_factors", lambda data, *a, **k: np.zeros(len(data), "i8"))
    assert answer() != real


def _packed(segments):
    keys, owners, texts = zip(*segments)
    return np.array([len(keys)], "<i8").tobytes() + np.array(keys, "<u4").tobytes() + np.array(owners, "<i8").tobytes() + np.array([len(t) - 49 for t in texts], "<i8").tobytes() + b"".join(texts)


@pytest.mark.parametrize("result", ["digest", "spans"])
def test_whole_copies_deal_out_no_segments(spark, monkeypatch, result):
    """Copies with larger, equal and no ids: each copy's segments were moved and compared again in every chunk."""
    rng = random.Random(6)
    text, other = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (900, 400))
    docs = [(4, text), (9, text), (4, text), (None, text), (12, text), (30, "short"), (31, "short"), (2, other[:200]), (15, other), (16, text[:100] + other)]
    kept, written = {}, S.written
    monkeypatch.setattr(S, "written", lambda df, tag: kept.setdefault(tag, written(df, tag)))
    found = S.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), chunk_bytes=1, result=result)
    wanted = brute([(S.NO_ID if i is None else i, t.encode()) for i, t in docs])
    if result == "digest":
        assert sorted((S.NO_ID if r[0] is None else r[0], *r[1:]) for r in map(tuple, found.collect())) == wanted
    else:
        assert sorted((S.NO_ID if r.doc_id is None else r.doc_id, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in found.collect()) == [(i, n, k, h) for i, _, n, k, h in wanted]
    assert kept["repeats-answers"].select("part", "offset").distinct().count() == 5  # both with id 4, and those of other texts: not 9, 12 and the one without an id
