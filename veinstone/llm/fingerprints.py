"""Document fingerprints from prefix polynomial hashes.

A text of code points c has the prefix sums S[i] = sum of c[j] * B^j over j < i, modulo two primes. The hash of any span
follows from two of its sums, so the equality of any two spans is one comparison, and the longest common extension of
two positions is found by binary search over its length. A text that is put together from spans of hashed texts has
prefix sums that follow from theirs: it need not be hashed again.

A fingerprint holds the length, the hash of the whole text, and the spans into which content cuts the text: a text is cut
behind windows of WINDOW code points whose hash ends in some zero bits, as many as leave at most GRID cuts. A window that stands in the text before
is told from that by how often it does, so a text that repeats itself has cuts as well. An insertion
moves the cuts behind it but doesn't change them, wherever it is, but for windows that it repeats: those of a periodic text move by whole periods. Of two fingerprints, spans of the finer one are put
together until both have the same rule; hashes of adjacent spans give that of their union. Then the spans of one text are
matched with those of the other by longest common extensions, found by binary search over prefix hashes of the sequences of
spans. Likeness is the share of the longer text that matched spans cover, 1 for equal texts.

Null texts count as empty; empty texts are equal to each other (likeness 1) and unlike any other (0). Documents are
ordered by descending doc_id, those without an id last, and rows that repeat an id by a digest of the text; a document that is alone is
its own next document. Columns besides id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.llm.common import table, written

GRID, WINDOW = 32, 12
#: Two primes below 2^31, and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)


class _Powers:
    """Powers of a base, and of its inverse, modulo a prime; grown as longer texts come."""

    def __init__(self, base: int, prime: int) -> None:
        self.prime, self.up, self.down = prime, np.array([1], "u8"), np.array([1], "u8")
        self.bases = base, pow(base, -1, prime)

    def reach(self, size: int) -> None:
        while len(self.up) <= size:
            n = len(self.up)
            self.up, self.down = (np.concatenate([x, x * np.uint64(pow(b, n, self.prime)) % np.uint64(self.prime)]) for x, b in zip((self.up, self.down), self.bases))


_POWERS = [_Powers(b, p) for b, p in zip(BASES, PRIMES)]


class PrefixHashes:
    """Prefix sums of one text, or of a sequence of numbers below 2^31; spans are [start, end) in code points."""

    def __init__(self, text: str | np.ndarray) -> None:
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype("u8") + np.uint64(1) if isinstance(text, str) else text
        self.size = len(codes)
        self.sums = []
        for powers in _POWERS:
            powers.reach(self.size)
            sums = np.zeros(self.size + 1, "u8")  # residues below 2^31, at most 2^32 of them: no overflow
            np.cumsum(codes * powers.up[: self.size] % np.uint64(powers.prime), out=sums[1:])
            self.sums.append(sums)

    def prefixes(self, at: np.ndarray) -> list[np.ndarray]:
        """The sums up to each position, modulo each prime."""
        return [sums[at] % np.uint64(powers.prime) for sums, powers in zip(self.sums, _POWERS)]

    def span(self, start: int, end: int) -> int:
        """Hash of a span, wherever it stands."""
        return int(_spans(self.prefixes(np.array([start])), self.prefixes(np.array([end])), np.array([start]))[0])

    def common_extension(self, other: PrefixHashes, start: int, start_other: int) -> int:
        """Length of the longest common prefix of two suffixes."""
        low, high = 0, min(self.size - start, other.size - start_other)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(start, start + middle) == other.span(start_other, start_other + middle):
                low = middle
            else:
                high = middle - 1
        return low


class Joined:
    """Prefix sums of text[:left] + other[:right], from those of both."""

    def __init__(self, text: PrefixHashes, left: int, other: PrefixHashes, right: int) -> None:
        self.text, self.left, self.other, self.size = text, left, other, left + right
        for powers in _POWERS:
            powers.reach(self.size)

    def prefixes(self, at: np.ndarray) -> list[np.ndarray]:
        near = self.text.prefixes(np.minimum(at, self.left))
        far = self.other.prefixes(np.maximum(at - self.left, 0))
        return [(a + b * powers.up[self.left]) % np.uint64(powers.prime) for a, b, powers in zip(near, far, _POWERS)]


def _spans(before: list[np.ndarray], after: list[np.ndarray], start: np.ndarray) -> np.ndarray:
    first, second = ((b + np.uint64(powers.prime) - a) % np.uint64(powers.prime) * powers.down[start] % np.uint64(powers.prime) for a, b, powers in zip(before, after, _POWERS))
    return first << np.uint64(31) | second


@dataclass(frozen=True)
class Spans:
    """The spans of a text: sizes, hashes, and how many zero bits end the window at each span's end (ENDLESS for the last)."""

    size: int
    whole: int
    zeros: int
    sizes: list[int]
    hashes: list[int]
    levels: list[int]

    def coarser(self, zeros: int) -> Spans:
        """The spans that a rule of more zero bits would have cut."""
        if zeros <= self.zeros:
            return self
        sizes, hashes, levels, begun = [], [], [], 0
        for size, part, level in zip(self.sizes, self.hashes, self.levels):
            if begun:
                hashes[-1] = _joined(hashes[-1], sizes[-1], part)
                sizes[-1] += size
            else:
                sizes.append(size)
                hashes.append(part)
            begun = level < zeros
            if not begun:
                levels.append(level)
        return Spans(self.size, self.whole, zeros, sizes, hashes, levels)


#: Level of a text's end, which any rule cuts.
ENDLESS = 63


def _joined(one: int, size: int, two: int) -> int:
    """The hash of two adjacent spans; size: of the first."""
    parts = ((one >> 31, two >> 31), (one & (1 << 31) - 1, two & (1 << 31) - 1))
    first, second = ((a + b * pow(base, size, prime)) % prime for (a, b), base, prime in zip(parts, BASES, PRIMES))
    return first << 31 | second


def _scattered(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def _zeros(values: np.ndarray) -> np.ndarray:
    """Zero bits at the end of each; 64 for 0."""
    lowest = values & (~values + np.uint64(1))
    return np.bitwise_count(lowest - np.uint64(1)).astype("i8")


def _nth(values: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    order = np.argsort(values, kind="stable")
    ordered, at = values[order], np.arange(len(values))
    first = np.ones(len(values), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    found = np.empty(len(values), "u8")
    found[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return found


def _cuts(hashes: PrefixHashes | Joined) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of zero bits of the rule, the places it cuts at, and the zero bits at each."""
    ends = np.arange(WINDOW, hashes.size)
    if not len(ends):
        return 0, ends, ends
    every = hashes.prefixes(np.arange(hashes.size))
    values = _spans([x[:-WINDOW] for x in every], [x[WINDOW:] for x in every], ends - WINDOW)
    ordered = np.sort(values)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        again = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, values), len(twice) - 1)] == values)
        values[again] += _nth(values[again]) * np.uint64(0x9E3779B97F4A7C15)
    zeros = _zeros(_scattered(values))
    rule = 0
    while len(ends) > GRID:
        rule += 1
        ends, zeros = ends[zeros >= rule], zeros[zeros >= rule]
    return rule, ends, np.minimum(zeros, ENDLESS - 1)


#: A text or span in a fingerprint: size, hash, and the rule's zero bits or the level of the span's end.
_ENTRY = np.dtype([("size", "<u4"), ("hash", "<u8"), ("zeros", "u1")])


def fingerprint(hashes: PrefixHashes | Joined) -> bytes:
    """The text as a whole, then its spans, as packed entries."""
    rule, cuts, levels = _cuts(hashes)
    starts, ends = np.concatenate([[0, 0], cuts]).astype("i8"), np.concatenate([[hashes.size], cuts, [hashes.size]]).astype("i8")
    entries = np.empty(len(starts), _ENTRY)
    entries["size"], entries["hash"], entries["zeros"] = ends - starts, _spans(hashes.prefixes(starts), hashes.prefixes(ends), starts), [rule, *levels.tolist(), ENDLESS]
    return entries.tobytes()


def read_fingerprint(packed: bytes) -> Spans:
    entries = np.frombuffer(packed, _ENTRY)
    size, whole, zeros = entries[0].tolist()
    return Spans(size, whole, zeros, *(entries[name][1:].tolist() for name in ("size", "hash", "zeros")))


def likeness(one: bytes, two: bytes) -> float:
    """Share of the longer text that spans cover which both have, as far as the cuts tell."""
    if one == two:
        return 1.0
    a, b = read_fingerprint(one), read_fingerprint(two)
    if not a.size or not b.size:
        return 0.0
    zeros = max(a.zeros, b.zeros)
    a, b = a.coarser(zeros), b.coarser(zeros)
    if not set(a.hashes) & set(b.hashes):
        return 0.0
    numbers: dict[tuple[int, int], int] = {}
    left, right = ([numbers.setdefault(span, len(numbers)) for span in zip(x.sizes, x.hashes)] for x in (a, b))
    hashes_left, hashes_right = (PrefixHashes(np.array(x, "u8") + np.uint64(1)) for x in (left, right))
    covered, at, used = 0, 0, [False] * len(right)
    while at < len(left):
        best, place = 0, 0
        for other in range(len(right)):
            if right[other] == left[at] and not used[other]:
                extension = hashes_left.common_extension(hashes_right, at, other)
                free = next((k for k in range(extension) if used[other + k]), extension)
                if free > best:
                    best, place = free, other
        covered += sum(a.sizes[at : at + best])
        used[place : place + best] = [True] * best
        at += max(1, best)
    return min(1.0, covered / max(a.size, b.size))


def _compared(doc_id: int | None, text: str, hashes: PrefixHashes, own: bytes, following: str, next_hashes: PrefixHashes, next_print: bytes) -> tuple:
    """The result row of a document and the one that follows it."""
    changed = hashes.size // 2
    kept, taken = hashes.size - changed, min(changed, next_hashes.size)
    edited = fingerprint(Joined(hashes, kept, next_hashes, taken))
    digest = hashlib.sha256((text[:kept] + following[:taken]).encode()).digest()
    return doc_id, hashes.size, digest, own, edited, likeness(own, edited), likeness(own, next_print)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), schema)] if rows else [pa.array([], field.type) for field in schema], schema=schema)


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each document of a sorted partition with the next; the first and last come out with their texts."""
    schema = _ARROW.append(pa.field("part", pa.int32())).append(pa.field("end", pa.string())).append(pa.field("text", pa.string()))
    part, last = TaskContext.get().partitionId(), None
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            hashes = PrefixHashes(text)
            own = fingerprint(hashes)
            if last is None:
                rows.append((doc_id, *[None] * 6, part, "first", text))
            else:
                rows.append((*_compared(*last, text, hashes, own), part, None, None))
            last = doc_id, text, hashes, own
        yield _batch(rows, schema)
    if last is not None:
        yield _batch([(last[0], *[None] * 6, part, "last", last[1])], schema)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, following in zip(*(c.to_pylist() for c in batch.columns)):
            hashes, other = PrefixHashes(text), PrefixHashes(following)
            rows.append(_compared(doc_id, text, hashes, fingerprint(hashes), following, other, fingerprint(other)))
        yield _batch(rows, _ARROW)


def _shown(rows: DataFrame) -> DataFrame:
    """Digests in hexadecimal and fingerprints in base64, which take more room than their bytes and so come last."""
    base64 = lambda c: F.translate(F.base64(c), "\r\n", "").alias(c)
    return rows.select("doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), base64("fingerprint"), base64("edited_fingerprint"), "near_edited", "near_next")


def compare_with_next(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints, as base64, of each document and of its edited text: its last half replaced by the next document's beginning.

    Texts move once, to be sorted by range of id. Ranges are cut by id, digest and a number of the row, so that rows that repeat
    an id, or lack one, are spread like any others. What crosses from one range to the next, two documents for each
    partition, is joined by the partition's number.
    """
    ordered = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    ordered = ordered.withColumns({"digest": F.xxhash64(F.coalesce("text", F.lit(""))), "row": F.xxhash64(F.monotonically_increasing_id())})
    order = [F.desc_nulls_last("doc_id"), F.asc("digest"), F.asc("row")]
    found = written(
        ordered.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(_along, f"{_SCHEMA}, part int, end string, text string"),
        "fingerprints",
    )
    parts = sorted(row["part"] for row in found.where(F.col("end") == "first").select("part").collect())  # numbers of partitions
    follows = dict(zip(parts, [*parts[1:], *parts[:1]]))
    firsts = found.where(F.col("end") == "first").select("part", F.col("text").alias("following"))
    lasts = found.where(F.col("end") == "last").select("doc_id", "text", F.col("part").alias("own"))
    if not follows:
        return _shown(found)
    numbers = docs.sparkSession.createDataFrame(list(follows.items()), "own int, part int")
    crossing = lasts.join(numbers, "own").join(firsts, "part").select("doc_id", "text", "following").mapInArrow(_across, _SCHEMA)
    return _shown(found.where(F.col("end").isNull()).select(*_ARROW.names).unionByName(crossing))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
