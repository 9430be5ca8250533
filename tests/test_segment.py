"""Segmentation against a plain dynamic program over the same dictionary."""

import math
import random

from veinstone.operators import segment

CHARS = "中国人民大学生活动力"


def plain(run, dictionary, for_search=False):
    total = sum(dictionary.values()) or 1
    best = [(0, [])]
    for end in range(1, len(run) + 1):
        options = []
        for start in range(end):
            word = run[start:end]
            if word in dictionary or len(word) == 1:
                weight = round(1_000_000 * math.log(dictionary.get(word, 1) / total))
                options.append((best[start][0] + weight, -start))
        score, back = max(options)
        best.append((score, [*best[-back][1], run[-back:end]]))
    words = best[-1][1]
    if not for_search:
        return words
    out = []
    for w in words:
        for n in (2, 3):
            if len(w) > n:
                out += [w[k : k + n] for k in range(len(w) - n + 1) if w[k : k + n] in dictionary]
        out.append(w)
    return out


def case(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(CHARS[:6]) for _ in range(n))
    dictionary = {word(rng.choice([1, 2, 2, 2, 3, 3, 4, 5])): rng.randrange(1, 400) for _ in range(60)}
    runs = sorted({word(rng.randrange(1, 25)) for _ in range(60)} | {word(300), CHARS})
    return dictionary, runs


def test_equals_plain_program(spark):
    for seed in (1, 2):
        dictionary, runs = case(seed)
        words = spark.createDataFrame([*dictionary.items()], "word string, frequency long")
        frame = spark.createDataFrame([(r,) for r in runs], "run string")
        for for_search in (False, True):
            assert {r.run: list(r.words) for r in segment.cut(frame, words, for_search).collect()} == {r: plain(r, dictionary, for_search) for r in runs}


def test_mixed_texts_keep_their_order(spark):
    words = spark.createDataFrame([("中国", 50), ("国人", 20), ("中国人", 40), ("大学", 30), ("学生", 30), ("大学生", 25), (None, 3), ("", 9), ("人", 0)], "word string, frequency long")
    texts = [(1, "ＡＢ中国人abc 大学生，中国"), (2, None), (3, ""), (4, "..."), (5, "only latin 42"), (6, "生")]
    found = {r.id: list(r.words) for r in segment.tokens(spark.createDataFrame(texts, "id long, text string"), words).collect()}
    assert found == {1: ["ab", "中国", "国人", "中国人", "abc", "大学", "学生", "大学生", "中国"], 2: [], 3: [], 4: [], 5: ["only", "latin", "42"], 6: ["生"]}


def test_empty_dictionary_cuts_single_characters(spark):
    nothing = spark.createDataFrame([], "word string, frequency long")
    assert [list(r.words) for r in segment.cut(spark.createDataFrame([("中国人",)], "run string"), nothing).collect()] == [["中", "国", "人"]]
