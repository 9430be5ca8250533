import math
import random
import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F

from veinstone.llm import toxicity


def corpus(spark, folder):
    rng = random.Random(8)
    syllables = ["ta", "ren", "lo", "mi", "der", "us", "an", "ke", "so", "vi"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for k in range(1200):
        toxic = k % 4 == 0
        words = [word() for _ in range(rng.randrange(30, 120))]
        for _ in range(4 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["zorgblat", "fnarkish", "quibbex"]))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return dict((k, t) for k, _, t in labels)


def test_held_out_accuracy(spark, tmp_path):
    labels = corpus(spark, str(tmp_path))
    rows = toxicity.query(spark, str(tmp_path)).collect()
    assert len(rows) == len(labels) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out]
    assert np.mean([p for p, y in held if y]) > 0.9 and np.mean([p for p, y in held if not y]) < 0.05


def test_held_out_labels_are_not_read(spark, tmp_path):
    corpus(spark, str(tmp_path))
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert a.content == b.content and np.allclose(a.calibration.weights, b.calibration.weights)


def test_words_of_common_syllables(spark, tmp_path):
    """Toxic words without a byte string of their own, each in few documents, as in languages of few labels."""
    rng = random.Random(11)
    syllables = ["ach", "lich", "keit", "ung", "ver", "schu", "ein", "bert", "zuge", "heit", "gen", "tau"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for k in range(1200):
        toxic = k % 8 == 0
        words = [word() for _ in range(rng.randrange(30, 120))]
        for _ in range(4 if toxic else 0):
            words.insert(rng.randrange(len(words)), "achlichkeit" + rng.choice(syllables) + rng.choice(["gen", "tau"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, known)).where(toxicity.held_out(F.col("doc_id"))).collect()
    held = [(r.score >= toxicity.THRESHOLD, dict(labels)[r.doc_id]) for r in scored]
    assert np.mean([p for p, y in held if y]) > 0.8 and np.mean([p for p, y in held if not y]) < 0.05


def test_windows_cover_texts():
    for n in (0, 1, 600, 5000):
        words = [f"w{'abcdefgh'[k % 8]}{'xyz'[k % 3]}" for k in range(n)]
        data, at = f" {' '.join(words)} ".encode(), 0
        cut = toxicity.byte_windows(words)
        for window in cut:
            assert data[at : at + toxicity.WINDOW] == window
            at += toxicity.STEP
        assert (len(cut) - 1) * toxicity.STEP + len(cut[-1]) == len(data)
        assert b"".join(w[: toxicity.CODES_STEP] for w in toxicity.code_windows(words)[:-1]) + toxicity.code_windows(words)[-1] == b"".join(map(toxicity._CODES.__getitem__, words))


def plain_gains(text, plain, both):
    """Differences of compressed lengths, window by window, by zstandard alone."""
    data, out, at = f" {' '.join(toxicity._WORD.findall(text.lower()))} ".encode(), [], 0
    while not out or at + toxicity.WINDOW - toxicity.STEP < len(data):
        sizes = [len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress(data[at : at + toxicity.WINDOW])) for c in (plain, both)]
        out.append(sizes[0] - sizes[1])
        at += toxicity.STEP
    return out


def test_scores_against_brute_force(spark, tmp_path):
    corpus(spark, str(tmp_path))
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    some = docs.where("doc_id % 97 = 0 OR doc_id < 4").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "zorgblat " * 3000)], "doc_id long, text string"))
    distances, texts = toxicity.Distances(*model.content), {r.doc_id: r.text or "" for r in some.collect()}
    for r in toxicity.score(some, model).collect():
        gains, features = plain_gains(texts[r.doc_id], model.ordinary, model.toxic + model.ordinary), distances.features(texts[r.doc_id])
        assert features[:2] == (np.mean(gains), max(gains))
        x = [1, *((np.array(features) - model.calibration.mean) / model.calibration.scale)]
        assert abs(r.score - 1 / (1 + math.exp(-max(-40, min(40, float(np.dot(x, model.calibration.weights))))))) < 1e-9


def test_dictionaries_are_trained_on_their_classes(spark, tmp_path):
    corpus(spark, str(tmp_path))
    model = toxicity.train(*(spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels")))
    code = toxicity._CODES.__getitem__
    assert b"zorgblat" in model.toxic and b"zorgblat" not in model.ordinary
    assert code("quibbex") in model.toxic_codes and code("quibbex") not in model.ordinary_codes
