"""Toxicity from compression distances to zstandard dictionaries, of bytes and of words.

Four dictionaries are trained by zstandard: on ordinary and on toxic text, each as bytes and as sequences of eight-byte
codes of its words. What toxic texts share with ordinary ones would fill their dictionaries and tell nothing, so these
are trained on what toxic documents of the sample say beyond it: their words that are far rarer in ordinary documents. A
text is cut into overlapping windows. Each is compressed with the ordinary dictionary, and with it and the toxic one; the
difference comes from toxic content alone. Bytes tell stems, whatever ends a word; a word's code matches as a whole
or not at all, so that words built from common syllables are told as well.

Largest, mean and summed differences and the number of windows go into a logistic model, whose output is the score. The
sample is dealt into FOLDS parts; the model is calibrated on each part with dictionaries of the others, which have not
seen it, and the final dictionaries are made of the whole sample.

Labels are learned from a sample of rows bounded by SAMPLE (documents of each class, by hash order), whose texts are read
whole, as all texts are. Labels of held-out documents (crc32 of the id's decimal digits, modulo 4, is 2) are never
read. A document labelled twice takes the larger label, and of texts of one id in the sample the greatest is read; null labels don't count.

Null texts count as empty; empty texts have one empty window and a score like any other. Without labels of both classes
every score is 0. A null doc_id is not held out. Rows keep their multiplicity; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.llm.common import crc32, table, written

#: Labelled documents of each class that training reads, at most.
SAMPLE = {1: 2400, 0: 3600}
#: Parts of the sample; each calibrates with dictionaries made of the others.
FOLDS = 3
#: Bytes of a window, and from one to the next; as many for windows of words' codes, eight bytes a word.
WINDOW, STEP, CODES, CODES_STEP = 512, 480, 1024, 960
LEVEL = 5
#: Bytes of the dictionaries (the toxic one of words has room for several codes of each word that is rare elsewhere).
ORDINARY_BYTES, TOXIC_BYTES, ORDINARY_CODES, ROOM = 30_000, 6_000, 28_000, 32
MOST_CODES = 112_000
#: How much rarer a word must be in ordinary documents.
RATIO = 20
THRESHOLD = 0.3
FEATURES = 13
#: A window's difference from which it counts as marked, and where differences stop to tell more.
MARKED, ENOUGH = 4, 12.0
#: Words whose codes a worker keeps.
CACHED = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _cut(data: bytes, size: int, step: int) -> list[bytes]:
    """Windows that overlap by size - step and cover everything; one empty window of nothing."""
    return [data[at : at + size] for at in range(0, max(1, len(data) - (size - step)), step)]


def byte_windows(words: list[str]) -> list[bytes]:
    return _cut(f" {' '.join(words)} ".encode(), WINDOW, STEP)


class _Codes(dict):
    """Eight-byte codes of words, kept up to a bound."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        code = self[word] = xxhash.xxh64_digest(word.encode())
        return code


_CODES = _Codes()


def code_windows(words: list[str]) -> list[bytes]:
    return _cut(b"".join(map(_CODES.__getitem__, words)), CODES, CODES_STEP)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a dictionary that zstandard trains; the samples themselves where there are too few to train on."""
    header = 2768  # what zstandard puts before the content, at most
    try:
        return zstandard.train_dictionary(size + header, samples, k=segment, d=8).as_bytes()[-size:]
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def rare_words(toxic: list[list[str]], ordinary: list[list[str]]) -> set[str]:
    """Words of toxic documents that are RATIO times rarer in ordinary ones, and in more documents than by chance."""
    in_toxic, in_ordinary = (Counter(w for words in docs for w in set(words)) for docs in (toxic, ordinary))
    # Words of n documents that are all toxic must be twice as many as by chance.
    chance = len(toxic) / (len(toxic) + len(ordinary))
    whole, all_toxic = Counter((in_toxic + in_ordinary).values()), Counter(n for w, n in in_toxic.items() if w not in in_ordinary)
    least = next((n for n in range(3, len(toxic) + 1) if all_toxic[n] >= 2 * whole[n] * chance**n), 3)
    return {w for w, n in in_toxic.items() if n >= least and n * len(ordinary) >= RATIO * in_ordinary[w] * len(toxic)}


def dictionaries(toxic: list[list[str]], ordinary: list[list[str]]) -> tuple[bytes, ...]:
    """Contents trained on ordinary and toxic documents, of bytes, then of words' codes."""
    rare = rare_words(toxic, ordinary)
    beyond = [some for words in toxic if (some := [w for w in words if w in rare])]
    return (
        trained([window for words in ordinary for window in _cut(f" {' '.join(words)} ".encode(), WINDOW, WINDOW)], ORDINARY_BYTES, 64),
        trained([f" {' '.join(some)} ".encode() for some in beyond], TOXIC_BYTES, 16) if beyond else b"",
        trained([window for words in ordinary for window in _cut(b"".join(map(_CODES.__getitem__, words)), 8 * CODES, 8 * CODES)], ORDINARY_CODES, 8),
        trained([b"".join(map(_CODES.__getitem__, some)) for some in beyond], min(MOST_CODES, ROOM * len(rare)), 8) if beyond else b"",
    )


class Distances:
    """Compressed lengths of windows under the dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes, ordinary_codes: bytes, toxic_codes: bytes) -> None:
        self.measures = [
            zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress
            for content in (ordinary, toxic + ordinary, ordinary_codes, toxic_codes + ordinary_codes)
        ]

    def features(self, text: str) -> tuple[float, ...]:
        ordinary, toxic, ordinary_codes, toxic_codes = self.measures
        words = words_of(text)
        gains = np.array([len(ordinary(w)) - len(toxic(w)) for w in byte_windows(words)], float)
        largest, marked = np.sort(gains)[::-1], int((gains >= MARKED).sum())
        of_bytes = (gains.mean(), largest[0], largest[:3].mean(), math.log1p(np.maximum(gains, 0).sum()), math.log1p(len(gains)), marked / len(gains), math.log1p(marked), min(largest[0], ENOUGH), float(len(gains) > 6))
        gains = np.array([max(0, len(ordinary_codes(w)) - len(toxic_codes(w))) for w in code_windows(words)], float)
        total = float(gains.sum())
        return tuple(map(float, (*of_bytes, math.log1p(total), min(total, ENOUGH), gains.max(), total / len(gains))))


@lru_cache(FOLDS + 1)
def _distances(*content: bytes) -> Distances:
    return Distances(*content)


class Calibration:
    """Logistic model over standardised features, fitted by Newton steps; a class's weight is its share of all labels."""

    def __init__(self, features: np.ndarray, labels: np.ndarray, share: float) -> None:
        self.mean, self.scale = features.mean(0), features.std(0) + 1e-9
        x, self.weights = self._scaled(features), np.zeros(features.shape[1] + 1)
        each = np.where(labels == 1, share / max(1, (labels == 1).sum()), (1 - share) / max(1, (labels == 0).sum())) * len(labels)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -40, 40)))
            hessian = (x * (each * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
            self.weights += np.linalg.solve(hessian, x.T @ (each * (labels - p)) - 0.05 * self.weights)

    def _scaled(self, features: np.ndarray) -> np.ndarray:
        return np.c_[np.ones(len(features)), (features - self.mean) / self.scale]

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._scaled(features) @ self.weights, -40, 40)))


class Model:
    def __init__(self, content: tuple[bytes, ...], calibration: Calibration | None) -> None:
        self.content, self.calibration = content, calibration
        self.ordinary, self.toxic, self.ordinary_codes, self.toxic_codes = content


def _clean(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))


def train(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model | None:
    """Dictionaries and calibration from a bounded sample; none without labels of both classes."""
    known = labels.select(labels[id_column].cast("long").alias("doc_id"), labels[label_column].cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {row["label"]: row["count"] for row in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    order = F.xxhash64("doc_id")
    sample = [known.where(F.col("label") == label).orderBy(order, "doc_id").limit(most) for label, most in SAMPLE.items()]
    # sum(SAMPLE) rows at most, whatever the input.
    sample = F.broadcast(sample[0].unionByName(sample[1]).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("taught")), F.lit(FOLDS)).cast("int")))
    # One text of each id, so as many rows at most, and the same ones whenever they are read.
    texts = _clean(docs, id_column, text_column).join(sample, "doc_id").groupBy("doc_id", "label", "fold").agg(F.max("text").alias("text"))
    texts = written(texts, "toxicity-sample")
    taught: list[dict[int, list[list[str]]]] = [{0: [], 1: []} for _ in range(FOLDS)]
    for row in texts.orderBy("doc_id", "text").toLocalIterator():
        taught[row["fold"]][row["label"]].append(words_of(row["text"] or ""))
    without = [{label: [words for k, part in enumerate(taught) if k != fold for words in part[label]] for label in (0, 1)} for fold in range(FOLDS + 1)]
    *parts, whole = [dictionaries(some[1], some[0]) if some[0] and some[1] else None for some in without]
    if whole is None or not any(parts):
        return None
    model = Model(whole, None)
    rows = _measured(texts.where(F.col("fold").isin([k for k, part in enumerate(parts) if part])).select("doc_id", "text", F.col("label").cast("double").alias("label"), "fold"), parts).collect()
    seen = np.array([[row["label"], *row["features"]] for row in rows], float).reshape(-1, FEATURES + 1)
    if len(set(seen[:, 0])) == 2:
        model.calibration = Calibration(seen[:, 1:], seen[:, 0], counts[1] / (counts[0] + counts[1]))
    return model


def _measured(docs: DataFrame, parts: list[tuple[bytes, ...] | None]) -> DataFrame:
    """(doc_id, label, features), by the dictionaries of the documents' folds."""
    content = docs.sparkSession.sparkContext.broadcast(parts)  # FOLDS dictionaries of bounded size

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_distances(*content.value[fold.as_py()]).features(text.as_py() or "") for text, fold in zip(batch.column(1), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "label", "features"])

    return docs.mapInArrow(batches, "doc_id long, label double, features array<double>")


def score(docs: DataFrame, model: Model | None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score) of every document."""
    docs = _clean(docs, id_column, text_column)
    if model is None or model.calibration is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    content = docs.sparkSession.sparkContext.broadcast((*model.content, model.calibration))

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *contents, calibration = content.value
        distances = _distances(*contents)
        for batch in batches:
            found = np.array([distances.features(text.as_py() or "") for text in batch.column(1)]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(calibration.scores(found))], names=["doc_id", "score"])

    return docs.mapInArrow(batches, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
