"""Benchmark decontamination by winnowing.

A window is SPAN consecutive words of an item, or all words of an item of fewer. Each window of n words has w = n - k + 1 k-grams,
k = min(KGRAM, n), and its mark is the smallest of their hashes. Of documents, every sequence of w k-grams gives its smallest (the last of
equals) as a fingerprint, so that a document that holds a window has a fingerprint that is the window's mark, at a place within it:
no shared window is missed, though only some 2 / (w + 1) of the k-grams are kept. This is done for each length of window that
items have. Fingerprints are joined with the items' marks, and a hit is extended: the windows of n words around it are compared with
those of the items, by a hash of their words and then by a digest of 128 bits.

Windows are told apart by their words, whatever number of items holds them, and items' ids are kept for each class of windows that the
same items hold. Up to BROADCAST windows, counted first, are sent to the tasks, which then do all of this while they read a text once. Beyond
that, fingerprints are joined by shuffle, and then the windows around the hits.

Null texts have no words. Rows that repeat a doc_id, or lack one, are documents of their own. Rows that repeat an item_id are one item;
items without id mark words but aren't listed. Columns besides id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.llm.common import skew_safe_lookup, table, written

SPAN, KGRAM = 10, 5
#: Windows that may be broadcast: at 32 bytes each, 32 MB.
BROADCAST = 1 << 20
#: Bytes of text that a task works on at a time, and one text more.
AT_ONCE = 4 << 20
#: Odd multipliers of the hashes of words' bytes and of sequences of words.
LETTER, WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

#: Each byte as it counts in words: A to Z as lower case, what can't be in a word as 0.
_BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], "u1")


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64; grown as longer texts come."""

    def __init__(self, base: int) -> None:
        self.bases, self.up, self.down = (base, pow(base, -1, 1 << 64)), np.ones(0, "u8"), np.ones(0, "u8")

    def reach(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < size:
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(size + size // 4, base, "u8")])) for base in self.bases)
        return self.up, self.down


_LETTERS, _WORDS = _Powers(LETTER), _Powers(WORD)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of some texts, one after the other: which text each is of, and hashes of any of their sequences."""

    def __init__(self, texts: pa.Array) -> None:
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", "u1")[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        self.letters = _BYTES[data]
        inside = self.letters != 0
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]  # a text ends and another begins
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)  # of each text, its first word's number
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        each = np.zeros(len(self.starts), "u8")
        cuts = np.unique(np.searchsorted(self.starts, np.arange(0, len(data), AT_ONCE)))  # so that powers are as many as AT_ONCE, or the longest word
        for one, two in zip(cuts, [*cuts[1:], len(self.starts)]):
            if one < two:
                at, end = self.starts[one], self.ends[two - 1]
                up, down = _LETTERS.reach(end - at)
                each[one:two] = np.add.reduceat(self.letters[at:end] * up[: end - at], self.starts[one:two] - at) * down[self.starts[one:two] - at]
        up, self._down = _WORDS.reach(len(each))
        self._sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(_mixed(each) * up[: len(each)])])

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all sequences of n words, and which of them are within a text."""
        count = max(0, len(self.text) - n + 1)
        sums = self._sums[n : n + count] - self._sums[:count]
        return _mixed(sums * self._down[:count]), self.text[:count] == self.text[n - 1 : n - 1 + count]

    def digest(self, start: int, n: int) -> bytes:
        """Of n words from the one with that number."""
        return xxhash.xxh3_128_digest(b" ".join(self.letters[a:b].tobytes() for a, b in zip(self.starts[start : start + n], self.ends[start : start + n])))


def _winnowed(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(smallest, within, fingerprints): the smallest k-gram hash of each window of n words, which windows are within a text, and the k-grams that are the last smallest of any."""
    k = min(KGRAM, n)
    grams, within = words.grams(k)[0], words.grams(n)[1]
    count = len(within)
    smallest = grams[:count].copy()
    for j in range(1, n - k + 1):
        np.minimum(smallest, grams[j : j + count], out=smallest)
    chosen, open_ = np.zeros(len(grams), bool), within.copy()
    for j in reversed(range(n - k + 1)):
        hit = open_ & (grams[j : j + count] == smallest)
        chosen[j : j + count] |= hit
        open_ &= ~hit
    return smallest, within, np.flatnonzero(chosen)


def _around(words: Words, n: int, hits: np.ndarray) -> np.ndarray:
    """The windows of n words within a text that hold one of these k-grams."""
    within = words.grams(n)[1]
    found = np.unique((hits[:, None] - np.arange(n - min(KGRAM, n) + 1)).ravel())
    found = found[(found >= 0) & (found < len(within))]
    return found[within[found]]


def _of(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of the values are among some sorted ones."""
    if not len(some):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


@dataclass
class Index:
    """Windows of n words: marks and hashes, sorted, and the class of each digest."""

    marks: np.ndarray
    hashes: np.ndarray
    classes: dict[bytes, str]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole texts of about AT_ONCE bytes; the text is the first column."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            past = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, past + AT_ONCE, side="right")))
            yield batch.slice(at, end - at)
            at = end


def _runs(words: Words, starts: np.ndarray, sizes: np.ndarray) -> list[list[dict]]:
    """For each text, the maximal runs of words that windows cover, as [start, end) in words of the text."""
    change = np.zeros(len(words.text) + 1, "i8")
    np.add.at(change, starts, 1)
    np.add.at(change, starts + sizes, -1)
    hit = np.cumsum(change)[:-1] > 0
    open_, close = hit.copy(), hit.copy()
    same = words.text[1:] == words.text[:-1]
    open_[1:] &= ~(hit[:-1] & same)
    close[:-1] &= ~(hit[1:] & same)
    found: list[list[dict]] = [[] for _ in range(len(words.first) - 1)]
    for a, b in zip(np.flatnonzero(open_).tolist(), np.flatnonzero(close).tolist()):
        text = words.text[a]
        found[text].append({"start": a - int(words.first[text]), "end": b + 1 - int(words.first[text])})
    return found


_RUNS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scan(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(text, id) to (id, n_words, spans, classes), with all windows at hand."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[int, Index] = sent.value
        for batch in _texts(batches):
            words = Words(batch.column(0))
            starts, sizes, classes = [], [], [set() for _ in range(batch.num_rows)]
            for n, known in index.items():
                grams, fingerprints = words.grams(min(KGRAM, n))[0], _winnowed(words, n)[2]
                near = _around(words, n, fingerprints[_of(grams[fingerprints], known.marks)])
                for start in near[_of(words.grams(n)[0][near], known.hashes)].tolist():
                    if (name := known.classes.get(words.digest(start, n))) is not None:
                        starts.append(start)
                        sizes.append(n)
                        classes[words.text[start]].add(name)
            runs = _runs(words, np.array(starts, "i8"), np.array(sizes, "i8"))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.diff(words.first)), pa.array(runs, _RUNS), pa.array([sorted(x) for x in classes], pa.list_(pa.string()))], names=["id", "n_words", "spans", "classes"])

    return scan


_FOUND = "n_words long, spans array<struct<start:int,end:int>>, classes array<string>"


def _windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, item) to a row for each window: item, n, mark, hash, digest."""
    for batch in _texts(batches):
        words = Words(batch.column(0))
        counts = np.diff(words.first)
        for n in np.unique(np.minimum(counts[counts > 0], SPAN)).tolist():
            smallest, within, _ = _winnowed(words, n)
            starts = np.flatnonzero(within & (np.minimum(counts, SPAN)[words.text[: len(within)]] == n))
            yield pa.RecordBatch.from_arrays([
                batch.column(1).take(pa.array(words.text[starts])), pa.array(np.full(len(starts), n, "i4")), pa.array(smallest[starts].view("i8")), pa.array(words.grams(n)[0][starts].view("i8")),
                pa.array([words.digest(start, n) for start in starts.tolist()], pa.binary()),
            ], names=["item_id", "n", "mark", "hash", "digest"])


@dataclass
class Windows:
    """windows: (n, mark, hash, digest, class); items: (class, item_id), the items that hold the windows of a class."""

    windows: DataFrame
    items: DataFrame


def windows_of(items: DataFrame, *, id_column: str = "item_id", text_column: str = "text") -> Windows:
    """The distinct windows of items. A class is named by two hashes and the count of its items' ids, so that no list of them is gathered."""
    each = items.select(items[text_column].cast("string").alias("text"), items[id_column].cast("string").alias("item_id"))
    each = written(each.mapInArrow(_windows_of, "item_id string, n int, mark long, hash long, digest binary").distinct(), "windows-items")
    name = F.concat_ws("-", *(F.hex(F.coalesce(F.bit_xor(F.xxhash64("item_id", F.lit(k))), F.lit(0))) for k in (1, 2)), F.count("item_id").cast("string"))
    windows = each.groupBy("n", "mark", "hash", "digest").agg(name.alias("class"))
    windows = written(windows, "windows")
    one = windows.groupBy("class").agg(F.min(F.struct("n", "digest")).alias("one")).select("class", "one.n", "one.digest")
    return Windows(windows, each.where(F.col("item_id").isNotNull()).join(one, ["n", "digest"]).select("class", "item_id"))


def _index(windows: DataFrame) -> dict[int, Index]:
    """Windows by length; at most BROADCAST of them."""
    rows = windows.toArrow()
    lengths, names = rows.column("n").to_numpy(), np.array(rows.column("class").to_pylist(), object)
    marks, hashes, digests = rows.column("mark").to_numpy().view("u8"), rows.column("hash").to_numpy().view("u8"), np.array([None, *rows.column("digest").to_pylist()], object)[1:]
    return {int(n): Index(np.unique(marks[own]), np.unique(hashes[own]), dict(zip(digests[own], names[own]))) for n in np.unique(lengths) for own in [lengths == n]}


# --- beyond what may be broadcast --------------------------------------------------------------------------------------


def _fingerprints(lengths: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(text, key) to the distinct fingerprints of each text: key, n, mark."""

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _texts(batches):
            words = Words(batch.column(0))
            for n in lengths:
                at = _winnowed(words, n)[2]
                rows = np.unique(np.stack([words.text[at].astype("u8"), words.grams(min(KGRAM, n))[0][at]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(rows[:, 0].astype("i8"))), pa.array(np.full(len(rows), n, "i4")), pa.array(rows[:, 1].view("i8"))], names=["key", "n", "mark"])

    return give


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, key, marks that hit) to the windows around the hits: key, n, start, digest."""
    for batch in _texts(batches):
        words, rows = Words(batch.column(0)), []
        hits = [(text, mark["n"], np.int64(mark["mark"]).view("u8")) for text, marks in enumerate(batch.column(2).to_pylist()) for mark in marks]
        for n in sorted({n for _, n, _ in hits}):
            grams, at = words.grams(min(KGRAM, n))[0], _winnowed(words, n)[2]
            wanted = {(text, int(mark)) for text, length, mark in hits if length == n}
            own = np.array([pair in wanted for pair in zip(words.text[at].tolist(), grams[at].tolist())], bool)
            rows += [(int(words.text[start]), n, start - int(words.first[words.text[start]]), words.digest(start, n)) for start in _around(words, n, at[own]).tolist()]
        text, n, start, digest = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(text, pa.int64())), pa.array(n, pa.int32()), pa.array(start, pa.int32()), pa.array(digest, pa.binary())], names=["key", "n", "start", "digest"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _texts(batches):
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.diff(Words(batch.column(0)).first)), batch.column(2)], names=["id", "n_words", "key"])


def _joined_runs(windows: Column) -> Column:
    """Maximal runs of an array of (start, end)."""
    joined = lambda done, x: F.when(F.size(done) == 0, F.array(x)).when(F.element_at(done, -1)["end"] >= x["start"], F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(done, F.array(x)))
    return F.aggregate(F.array_sort(windows), F.array().cast("array<struct<start:int,end:int>>"), joined)


def _by_shuffle(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(id, n_words, spans, classes) through joins of fingerprints, and of the windows around hits, of each distinct text."""
    keyed = docs.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    lengths = sorted(row["n"] for row in windows.select("n").distinct().collect())  # at most SPAN
    marks = windows.select("n", "mark").distinct()
    hit = keyed.select("text", "key").mapInArrow(_fingerprints(lengths), "key string, n int, mark long").join(marks, ["n", "mark"], "left_semi")
    hits = written(hit.groupBy("key").agg(F.collect_set(F.struct("n", "mark")).alias("marks")), "decontaminate-hits")
    texts = keyed.join(hits.select("key"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")).join(hits, "key").select("text", "key", "marks")
    around = texts.mapInArrow(_extended, "key string, n int, start int, digest binary").join(windows.select("n", "digest", "class"), ["n", "digest"])
    ends = F.struct(F.col("start"), (F.col("start") + F.col("n")).cast("int").alias("end"))
    found = around.groupBy("key").agg(F.collect_set(ends).alias("windows"), F.sort_array(F.collect_set("class")).alias("classes"))
    counted = written(keyed.select("text", "id", "key").mapInArrow(_counted, "id long, n_words long, key string"), "decontaminate-words")
    copies = counted.groupBy("key").agg(F.count("*").alias("copies"))
    found = found.select("key", _joined_runs(F.col("windows")).alias("spans"), "classes").join(copies, "key")
    none = F.array().cast("array<struct<start:int,end:int>>"), F.array().cast("array<string>")
    rows = skew_safe_lookup(counted, found, "key", "copies", F.col("id"))
    return rows.select("id", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("classes", none[1]).alias("classes"))


# --- results -----------------------------------------------------------------------------------------------------------


def shared_spans(docs: DataFrame, items: Windows, *, broadcast: int = BROADCAST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, classes) of every document: runs of words that windows cover, as [start, end), and the classes of those windows."""
    texts = docs.select(docs[text_column].cast("string").alias("text"), docs[id_column].cast("long").alias("id"))
    if items.windows.count() <= broadcast:
        found = texts.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(_index(items.windows))), f"id long, {_FOUND}")
    else:
        found = _by_shuffle(texts, items.windows)
    return found.withColumnRenamed("id", "doc_id")


def contaminated(found: DataFrame, items: Windows) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of what shared_spans() found, which is read twice.

    Lists of items are made once for each set of classes that documents have, not for each document.
    """
    found = found.withColumn("set", F.when(F.size("classes") > 0, F.sha2(F.array_join("classes", ","), 256)))
    sets = found.where(F.col("set").isNotNull()).groupBy("set").agg(F.count("*").alias("copies"), F.first("classes").alias("classes"))
    ids = sets.select("set", F.explode("classes").alias("class")).join(items.items, "class").select("set", "item_id").distinct()
    lists = ids.groupBy("set").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    rows = skew_safe_lookup(found, sets.drop("classes").join(lists, "set"), "set", "copies", F.col("doc_id"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark windows in every document, and the items they are of."""
    items = windows_of(table(spark, sf_dir, "benchmark"))
    found = written(shared_spans(table(spark, sf_dir, "documents"), items), "decontaminate")
    return contaminated(found, items).drop("spans")


SQL = f"""
WITH words AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents
), items AS (
    SELECT item_id, w, least(len(w), {SPAN}) AS n
    FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark) WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM items)
), grams AS (
    SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS gram
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM words, (SELECT DISTINCT n FROM items) WHERE len(w) >= n)
), hits AS (
    SELECT r, s, g.n, item_id FROM grams AS g JOIN windows USING (n, gram)
), covered AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r
), named AS (
    SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
