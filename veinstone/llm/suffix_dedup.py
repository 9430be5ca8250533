"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte is removed if it lies in a string of ``length`` bytes that also starts in a document with a smaller doc_id, so the
first document keeps its text. Strings are judged on the input, and never cross documents.

One suffix array over a corpus doesn't fit any machine, so the strings are dealt out by content. In each string of
``length`` bytes the substring of ANCHOR bytes with the smallest hash is its anchor; equal strings have equal anchors, and
neighbouring strings mostly share one, so that a run of strings with one anchor is one segment of text. Four steps:

1. Texts are kept in chunks in the shared folder. Of every chunk the distinct anchor hashes go to buckets.
2. Each bucket tells which anchors stand in more than one document. That leaves the small part of the corpus that can repeat.
   Anchors that stand in over HEAVY chunks are told apart: their segments are cut further, into their strings, each dealt by
   a hash of its own, so that what surrounds a common passage doesn't meet in one bucket.
3. The segments go to buckets by anchor. A bucket's distinct segments, each owned by the smallest id it stands under, are
   concatenated in order of owner wherever one anchor has several, and their suffixes are sorted to ``length`` bytes. In
   suffix order the previous and the next position of a smaller owner give each suffix its longest previous factor. A string
   goes where that reaches ``length``. In later copies of a segment the factor of each suffix is the rest of the segment
   itself, at its owner, so they need no place in the order.
4. Each chunk gets the answers for its segments, marks the bytes and digests what is left.

Chunks are read back by place rather than shuffled: only hashes, possible repeats and bit masks move. A copied document
adds one entry for each chunk to an anchor's bucket, so copies are aggregated before they move, however many there are.
Whole copies are told in step 2, by digests with the smallest id of each: such a document goes as a whole, and as its first
one holds all of its strings under a smaller id, none of its segments need be dealt out.
Hashes only select; what is removed is decided by comparing bytes. Chunks and the number of buckets grow with the input,
within bounds, so that neither a bucket nor the number of rows between chunks and buckets gets out of hand.

Null texts count as empty. A null doc_id counts as larger than any other, rows that repeat an id are not earlier than each
other, and columns besides id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.llm.common import fresh_path, shuffle_width, table, written

LENGTH, ANCHOR = 50, 24
#: Text in a chunk (a longer document is a chunk of its own), the share of the input that a chunk has between these bounds, and
#: positions hashed at a time.
CHUNK_BYTES, CHUNK_SHARE, BLOCK = (2 << 20, 64 << 20), 40_000, 1 << 16
#: Input of a bucket, and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 1 << 17
#: Chunks in which an anchor may stand before its segments are cut into strings.
HEAVY = 512
#: Bytes of an anchor hash that go to the buckets of step 2, besides the bucket itself.
HASH_BYTES = 5
NO_ID = (1 << 63) - 1
_ODD, _EVEN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


# --- anchors -----------------------------------------------------------------------------------------------------------


def _window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window of ``width`` bytes, a multiple of eight, from the words at each byte."""
    data = np.ascontiguousarray(data)
    words = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
    n = max(0, len(data) - width + 1)
    x = np.zeros(n, "u8")
    for at in range(0, width, 8):
        x += words[at : at + n]
        x *= _ODD if at % 16 else _EVEN
        x ^= x >> np.uint64(29 if at % 16 else 32)
    return x


def _string_hashes(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes at each place."""
    if not len(at):
        return np.empty(0, "u8")
    data = np.ascontiguousarray(data)
    words, x = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)), np.zeros(len(at), "u8")
    for k in [*range(0, length - 7, 8), length - 8]:
        x += words[at + k]
        x *= _ODD
        x ^= x >> np.uint64(31)
    return x


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


class Segments:
    """The runs of strings with one anchor in a chunk: hash, first string, number of strings, document of each."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, length: int) -> None:
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        hashes, starts, counts = [np.empty(0, "u8")], [np.empty(0, "i8")], [np.empty(0, "i8")]
        for at in range(0, max(0, len(data) - length + 1), BLOCK):
            least = _window_minima(_window_hashes(data[at : at + BLOCK + length - 1], ANCHOR), length - ANCHOR + 1)
            fresh = np.ones(len(least) + 1, bool)
            fresh[1:-1] = least[1:] != least[:-1]
            lo, hi = np.searchsorted(begins, at), np.searchsorted(begins, at + len(least))
            fresh[begins[lo:hi] - at] = True
            last = np.maximum(begins, ends - length + 1)  # strings that would cross into the next document begin here
            inside = last[(last >= at) & (last < at + len(least))]
            fresh[inside - at] = True
            first = np.flatnonzero(fresh)
            starts.append(first[:-1] + at)
            counts.append(np.diff(first))
            hashes.append(least[first[:-1]])
        self.hash, self.start, self.count = np.concatenate(hashes), np.concatenate(starts), np.concatenate(counts)
        self.doc = np.searchsorted(ends, self.start, side="right")
        whole = self.start + length <= ends[self.doc] if len(self.start) else np.empty(0, bool)
        self.hash, self.start, self.count, self.doc = (x[whole] for x in (self.hash, self.start, self.count, self.doc))


# --- suffix order ------------------------------------------------------------------------------------------------------


def _ranked(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype("u8")


class SuffixOrder:
    """The suffixes of a text in order of their first ``depth`` bytes, ranked by doubling from eight; beyond the end there are zeros."""

    def __init__(self, data: np.ndarray, depth: int) -> None:
        self.depth = depth
        padded = np.concatenate([data, np.zeros(depth + 8, "u1")])
        self.words = np.empty(len(data), "u8")
        for k in range(8):
            n = len(self.words[k::8])
            self.words[k::8] = np.frombuffer(padded[k : k + 8 * n].tobytes(), ">u8")
        #: (size, ranks of the suffixes by their first size bytes), the last for the whole depth.
        self.levels = [(min(8, depth), _ranked(self.words >> np.uint64(8 * max(0, 8 - depth))))]
        while (size := self.levels[-1][0]) < depth:
            ranks, step = self.levels[-1][1], min(size, depth - size)
            after = np.zeros(len(ranks), "u8")
            after[: max(0, len(ranks) - step)] = ranks[step:] + np.uint64(1)
            self.levels.append((size + step, _ranked(ranks << np.uint64(32) | after)))

    def sorted(self, places: np.ndarray) -> np.ndarray:
        """The places in suffix order; ties stay as they are."""
        return places[np.argsort(self.levels[-1][1][places], kind="stable")]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes, up to the depth; both must be that long."""
        found = np.zeros(len(a), "i8")
        for size, ranks in self.levels[::-1]:
            further = np.minimum(found, self.depth - 1)
            equal = (found < self.depth) & (ranks[a + further] == ranks[b + further])
            found[equal] += size
        further = np.minimum(found, self.depth - 1)
        differing = self.words[a + further] ^ self.words[b + further]
        found += sum(((differing >> np.uint64(64 - 8 * k)) == 0).astype("i8") for k in range(1, 8))
        return np.minimum(found, self.depth)


def _previous_smaller(values: np.ndarray, common: np.ndarray, enough: int) -> np.ndarray:
    """The common prefix of each place with the nearest place before it that has a smaller value; 0 where there is none.

    common: of each place and the one before. Places are followed backwards by jumps over places that are known not to be
    smaller, only as long as the common prefix is ``enough``.
    """
    at, least = np.arange(len(values)) - 1, common.copy()
    some = np.arange(1, len(values))
    while len(some):
        some = some[(at[some] >= 0) & (least[some] >= enough)]
        some = some[values[at[some]] >= values[some]]
        via = at[some]
        least[some], at[some] = np.minimum(least[some], least[via]), at[via]
    least[at < 0] = 0
    return least


def longest_previous_factors(data: np.ndarray, owners: np.ndarray, ends: np.ndarray, depth: int, enough: int = 1) -> np.ndarray:
    """For each suffix the length, up to ``depth``, of its longest match with a suffix of a smaller owner.

    data: concatenated texts in order of their owners; owners, ends: of the text at each byte. Suffixes shorter than
    ``depth`` have 0; factors below ``enough`` may come out wrong, but below it. In suffix order, the longest match is with the
    previous or the next position of a smaller owner.
    """
    found = np.zeros(len(data), "i8")
    places = np.flatnonzero(np.arange(len(data)) + depth <= ends)
    if not len(places):
        return found
    suffixes = SuffixOrder(data, depth)
    order = suffixes.sorted(places)
    common = np.zeros(len(order) + 1, "i8")  # of each place and the one before
    common[1:-1] = suffixes.common(order[:-1], order[1:])
    before = _previous_smaller(owners[order], common[:-1], enough)
    after = _previous_smaller(owners[order][::-1], common[:0:-1], enough)[::-1]
    found[order] = np.maximum(before, after)
    return found


# --- chunks ------------------------------------------------------------------------------------------------------------


class Chunk:
    """Ids and texts of some documents, and their segments in the order in which buckets are told of them."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, data: bytes, length: int) -> None:
        self.ids, self.bytes, self.length = ids, np.frombuffer(data, "u1"), length
        self.ends = np.cumsum(sizes)
        self.segments = Segments(self.bytes, self.ends, length)
        self.anchors, self.which, docs = self._distinct()
        self.shared = docs
        self.digests = self._digests(data)

    def _distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        anchors, which = np.unique(self.segments.hash, return_inverse=True)
        low, high = np.full(len(anchors), NO_ID), np.full(len(anchors), -NO_ID)
        ids = self.ids[self.segments.doc]
        np.minimum.at(low, which, ids)
        np.maximum.at(high, which, ids)
        return anchors, which, low < high

    def _digests(self, data: bytes) -> list[bytes | None]:
        """A digest of each text; none of those that are too short to be removed."""
        begins = [0, *self.ends[:-1].tolist()]
        return [hashlib.sha256(data[a:b]).digest() if b - a >= self.length else None for a, b in zip(begins, self.ends.tolist())]

    def first_ids(self) -> dict[bytes, int]:
        """The smallest id of each digest, by digest."""
        found: dict[bytes, int] = {}
        for digest, doc_id in zip(self.digests, self.ids.tolist()):
            if digest is not None:
                found[digest] = min(doc_id, found.get(digest, doc_id))
        return dict(sorted(found.items()))

    def packed(self) -> bytes:
        sizes = np.diff(self.ends, prepend=0)
        return zstandard.compress(np.array([len(self.ids)], "<i8").tobytes() + self.ids.tobytes() + sizes.astype("<i8").tobytes() + self.bytes.tobytes(), 3)

    @classmethod
    def unpacked(cls, packed: bytes, length: int) -> Chunk:
        data = zstandard.decompress(packed)
        n = int(np.frombuffer(data, "<i8", 1)[0])
        ids, sizes = np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, "<i8", n, 8 + 8 * n)
        return cls(ids, sizes, data[8 + 16 * n :], length)


def _buckets(anchors: np.ndarray, buckets: int) -> np.ndarray:
    return (anchors >> np.uint64(8 * HASH_BYTES)) % np.uint64(buckets)


def _digest_bucket(digest: bytes, buckets: int) -> int:
    return int.from_bytes(digest[:8], "little") % buckets


def _short(anchors: np.ndarray) -> np.ndarray:
    return anchors & np.uint64((1 << 8 * HASH_BYTES) - 1)


def _cut(packed: np.ndarray) -> bytes:
    return packed.astype("<u8").view("u1").reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def _joined(cut: bytes) -> np.ndarray:
    wide = np.zeros((len(cut) // HASH_BYTES, 8), "u1")
    wide[:, :HASH_BYTES] = np.frombuffer(cut, "u1").reshape(-1, HASH_BYTES)
    return wide.view("<u8").ravel()


_PLACE = "part int, offset long, size long, bucket int"
_PLACES = [("part", pa.int32()), ("offset", pa.int64()), ("size", pa.int64()), ("bucket", pa.int32())]


def _out(rows: list[tuple], *more: tuple[str, pa.DataType], place: bool = True) -> pa.Table:
    fields = [*(_PLACES if place else []), *more]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.table([pa.array(list(c), kind) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


class Store:
    """Chunks in the shared folder: a file for each partition, read back by place."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def path(self, part: int) -> tuple[fs.FileSystem, str]:
        files, root = fs.FileSystem.from_uri(self.folder)
        return files, f"{root}/part-{part:06d}.chunks"

    def read(self, part: int, offset: int, size: int) -> bytes:
        files, path = self.path(part)
        with files.open_input_file(path) as file:
            return file.read_at(size, offset)


def _stored(store: Store, length: int, chunk_bytes: int, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1: writes a partition's chunks, and tells the buckets of their anchors."""
    context = TaskContext.get()
    part, offset = context.partitionId(), 0
    files, path = store.path(part)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{context.taskAttemptId()}"

    def told(ids: list[int], texts: list[bytes]) -> tuple[bytes, pa.RecordBatch]:
        chunk = Chunk(np.array(ids, "i8"), np.array([len(x) for x in texts], "i8"), b"".join(texts), length)
        packed = chunk.packed()
        home = _buckets(chunk.anchors, buckets)
        order = np.lexsort((_short(chunk.anchors), home))
        cuts = np.flatnonzero(np.diff(home[order], prepend=-1)) if len(order) else np.empty(0, int)
        told = {int(home[own[0]]): (_cut(_short(chunk.anchors[own])), np.packbits(chunk.shared[own]).tobytes()) for own in np.split(order, cuts[1:]) if len(own)}
        docs: dict[int, list[bytes]] = {}
        for digest, doc_id in chunk.first_ids().items():
            docs.setdefault(_digest_bucket(digest, buckets), []).append(digest + doc_id.to_bytes(8, "little", signed=True))
        rows = [(part, offset, len(packed), bucket, *told.get(bucket, (b"", b"")), b"".join(docs.get(bucket, []))) for bucket in sorted({*told, *docs} or {0})]
        return packed, _out(rows, ("anchors", pa.binary()), ("shared", pa.binary()), ("docs", pa.binary())).to_batches()[0]

    with files.open_output_stream(draft, compression=None) as file:
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = (text.as_py() or "").encode()
                if texts and held + len(text) > chunk_bytes:
                    packed, rows = told(ids, texts)
                    file.write(packed)
                    offset += len(packed)
                    yield rows
                    ids, texts, held = [], [], 0
                ids.append(NO_ID if doc_id is None else doc_id)
                texts.append(text)
                held += len(text)
        if texts:
            packed, rows = told(ids, texts)
            file.write(packed)
            yield rows
    files.move(draft, path)


def _repeated(heavy: int, rows: pa.Table) -> pa.Table:
    """Step 2, a bucket: a bit for each chunk's anchor, set if it stands in over one document, and one if in many chunks; the smallest id of each chunk's digests."""
    cut = rows.column("anchors").to_pylist()
    sizes = [len(x) // HASH_BYTES for x in cut]
    anchors = _joined(b"".join(cut))
    shared = np.concatenate([np.empty(0, bool), *(np.unpackbits(np.frombuffer(x, "u1"), count=n).astype(bool) for x, n in zip(rows.column("shared").to_pylist(), sizes))])
    _, which, count = np.unique(anchors, return_inverse=True, return_counts=True)
    often = count > 1
    np.logical_or.at(often, which, shared)
    cuts = np.cumsum(sizes)[:-1]
    bits, many = (np.split(x[which], cuts) if sizes else [] for x in (often, count > heavy))
    docs = [[(x[k : k + 32], int.from_bytes(x[k + 32 : k + 40], "little", signed=True)) for k in range(0, len(x), 40)] for x in rows.column("docs").to_pylist()]
    first: dict[bytes, int] = {}
    for digest, doc_id in (pair for pairs in docs for pair in pairs):
        first[digest] = min(doc_id, first.get(digest, doc_id))
    firsts = [np.array([first[digest] for digest, _ in pairs], "<i8").tobytes() for pairs in docs]
    places = zip(*(rows.column(name).to_pylist() for name, _ in _PLACES))
    return _out([(*place, np.packbits(x).tobytes(), np.packbits(y).tobytes() if y.any() else b"", z) for place, x, y, z in zip(places, bits, many, firsts)], ("bits", pa.binary()), ("many", pa.binary()), ("first", pa.binary()))


class Candidates:
    """The segments of a chunk that can repeat, by bucket, then hash, then id, then place: the same whenever they are computed.

    first: for each, the first with an equal text; distinct: the places of those firsts; nth: for each, which of them.
    copies: which documents are whole copies of one with a smaller id; they have no segments here.
    """

    def __init__(self, chunk: Chunk, rows: pa.Table, buckets: int) -> None:
        marked, many = np.zeros(len(chunk.anchors), bool), np.zeros(len(chunk.anchors), bool)
        home = _buckets(chunk.anchors, buckets)
        order = np.lexsort((_short(chunk.anchors), home))
        each = rows.column("bucket").to_numpy()
        begins, ends = (np.searchsorted(home[order], each, side=side).tolist() for side in ("left", "right"))  # for all buckets at once: there may be hundreds
        for begin, end, bits, heavy in zip(begins, ends, *(rows.column(name).to_pylist() for name in ("bits", "many"))):
            own = order[begin:end]
            marked[own] = np.unpackbits(np.frombuffer(bits, "u1"), count=len(own)).astype(bool)
            if heavy:
                many[own] = np.unpackbits(np.frombuffer(heavy, "u1"), count=len(own)).astype(bool)
        told = dict(zip(rows.column("bucket").to_pylist(), rows.column("first").to_pylist()))
        ids, own = {}, chunk.first_ids()
        for bucket, digests in groupby(sorted(own, key=lambda digest: _digest_bucket(digest, buckets)), lambda digest: _digest_bucket(digest, buckets)):
            ids |= zip(digests, np.frombuffer(told[bucket], "<i8").tolist())
        self.copies = np.array([digest is not None and ids[digest] < doc_id for digest, doc_id in zip(chunk.digests, chunk.ids.tolist())], bool)
        segments, which = chunk.segments, chunk.which
        asks = marked[which] & ~self.copies[segments.doc]
        whole, apart = np.flatnonzero(asks & ~many[which]), np.flatnonzero(asks & many[which])
        size = segments.count[apart]
        strings = np.repeat(segments.start[apart], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        hashes = np.concatenate([segments.hash[whole], _string_hashes(chunk.bytes, strings, chunk.length)])
        start, count = np.concatenate([segments.start[whole], strings]), np.concatenate([segments.count[whole], np.ones(len(strings), "i8")])
        doc = np.concatenate([segments.doc[whole], np.repeat(segments.doc[apart], size)])
        home = _buckets(hashes, buckets)
        order = np.lexsort((start, chunk.ids[doc], hashes, home))
        self.hash, self.start, self.count, self.doc, self.home = (x[order] for x in (hashes, start, count, doc, home))
        # Segments of different hashes differ; texts are compared only where a hash stands more than once.
        _, which, alike = np.unique(self.hash, return_inverse=True, return_counts=True)
        alike, first = alike[which] > 1, np.arange(len(order))
        data, seen = chunk.bytes.tobytes(), {}
        ends = self.start + self.count + chunk.length - 1
        for nth, begin, end in zip(np.flatnonzero(alike).tolist(), self.start[alike].tolist(), ends[alike].tolist()):
            first[nth] = seen.setdefault(data[begin:end], nth)
        fresh = first == np.arange(len(order))
        self.distinct, self.nth = np.flatnonzero(fresh), (np.cumsum(fresh) - 1)[first] if len(order) else first

    def by_bucket(self) -> list[np.ndarray]:
        """Places within ``distinct``, a group for each bucket."""
        return np.split(np.arange(len(self.distinct)), np.flatnonzero(np.diff(self.home[self.distinct])) + 1) if len(self.distinct) else []


def _asked(store: Store, length: int, buckets: int, rows: pa.Table) -> pa.Table:
    """Step 3, a chunk: its distinct segments that may repeat, to their buckets."""
    part, offset, size = (rows.column(name)[0].as_py() for name in ("part", "offset", "size"))
    chunk = Chunk.unpacked(store.read(part, offset, size), length)
    found = Candidates(chunk, rows, buckets)
    data, out = chunk.bytes.tobytes(), []
    for own in found.by_bucket():
        own = found.distinct[own]
        text = b"".join(data[s : s + c + length - 1] for s, c in zip(found.start[own].tolist(), found.count[own].tolist()))
        head = np.array([len(own)], "<i8").tobytes() + found.hash[own].astype("<u4").tobytes() + chunk.ids[found.doc[own]].tobytes() + found.count[own].astype("<i8").tobytes()
        out.append((part, offset, size, int(found.home[own[0]]), zstandard.compress(head + text, 3)))
    return _out(out, ("segments", pa.binary()))


def _answered(length: int, rows: pa.Table) -> pa.Table:
    """Step 3, a bucket: for each segment a bit whether its owner has it all, else a bit for each of its strings."""
    first: dict[bytes, int] = {}
    variants: dict[int, list[bytes]] = {}
    told = []
    for packed in rows.column("segments").to_pylist():
        data = zstandard.decompress(packed)
        n = int(np.frombuffer(data, "<i8", 1)[0])
        hashes, owners, counts = np.frombuffer(data, "<u4", n, 8), np.frombuffer(data, "<i8", n, 8 + 4 * n).tolist(), np.frombuffer(data, "<i8", n, 8 + 12 * n)
        ends = np.cumsum(counts + length - 1) + 8 + 20 * n
        texts = [data[a:b] for a, b in zip([8 + 20 * n, *ends[:-1].tolist()], ends.tolist())]
        for key, text, owner in zip(hashes.tolist(), texts, owners):
            known = first.get(text)
            if known is None:
                variants.setdefault(key, []).append(text)
                first[text] = owner
            elif owner < known:
                first[text] = owner
        told.append((texts, owners))
    compared = sorted((text for texts in variants.values() if len(texts) > 1 for text in texts), key=lambda text: (first[text], text))
    sizes = np.array([len(text) for text in compared], "i8")
    ends = np.cumsum(sizes)
    owners = np.unique(np.array([first[text] for text in compared], "i8"), return_inverse=True)[1]
    factors = longest_previous_factors(np.frombuffer(b"".join(compared), "u1"), np.repeat(owners, sizes), np.repeat(ends, sizes), length, enough=length)
    earlier = factors >= length
    marks = dict(zip(compared, (earlier[end - size : end - length + 1] for end, size in zip(ends.tolist(), sizes.tolist()))))
    answers = []
    for texts, of in told:
        whole = np.array([owner > first[text] for text, owner in zip(texts, of)], bool)
        some = [np.empty(0, bool), *(marks[text] if text in marks else np.zeros(len(text) - length + 1, bool) for text, all_of_it in zip(texts, whole.tolist()) if not all_of_it)]
        answers.append(zstandard.compress(np.array([len(texts)], "<i8").tobytes() + np.packbits(whole).tobytes() + np.packbits(np.concatenate(some)).tobytes(), 3))
    places = zip(*(rows.column(name).to_pylist() for name, _ in _PLACES))
    return _out([(*place, x) for place, x in zip(places, answers)], ("answer", pa.binary()))


def _removed(chunk: Chunk, rows: pa.Table, buckets: int) -> np.ndarray:
    """Step 4: which bytes of a chunk are removed."""
    asked, answered = rows.filter(rows.column("answer").is_null()), rows.filter(rows.column("answer").is_valid())
    found = Candidates(chunk, asked, buckets)
    answers = dict(zip(answered.column("bucket").to_pylist(), answered.column("answer").to_pylist()))
    distinct, count = found.distinct, found.count[found.distinct]
    whole, strings = np.zeros(len(distinct), bool), [np.empty(0, bool)]
    for own in found.by_bucket():
        answer = zstandard.decompress(answers[int(found.home[distinct[own[0]]])])
        n = (len(own) + 7) // 8
        whole[own] = np.unpackbits(np.frombuffer(answer, "u1", n, 8), count=len(own)).astype(bool)
        open_strings = int(np.where(whole[own], 0, count[own]).sum())
        strings.append(np.unpackbits(np.frombuffer(answer, "u1", -1, 8 + n), count=open_strings).astype(bool) if open_strings else np.empty(0, bool))
    strings = np.concatenate(strings)
    at = np.cumsum(np.where(whole, 0, count)) - np.where(whole, 0, count)
    nth = found.nth
    entire = whole[nth] | (chunk.ids[found.doc] > chunk.ids[found.doc[distinct]][nth])
    edges = np.zeros(len(chunk.bytes) + 1, "i4")
    np.add.at(edges, found.start[entire], 1)
    np.add.at(edges, found.start[entire] + found.count[entire], -1)
    begins = np.cumsum(edges[:-1]) > 0
    sizes, nth = found.count[~entire], nth[~entire]
    along = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    begins[np.repeat(found.start[~entire], sizes) + along] |= strings[np.repeat(at[nth], sizes) + along]
    total = np.cumsum(begins, dtype="i8")
    total[chunk.length :] -= total[: -chunk.length].copy()
    return (total > 0) | np.repeat(found.copies, np.diff(chunk.ends, prepend=0))


def _digested(doc_id: int | None, data: np.ndarray, gone: np.ndarray) -> tuple:
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()


def _spanned(doc_id: int | None, data: np.ndarray, gone: np.ndarray) -> tuple:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
    return doc_id, [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()], data[~gone].tobytes()


_RESULTS: dict[str, tuple[Callable, list[tuple[str, pa.DataType]], str]] = {
    "digest": (_digested, [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())], "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"),
    "spans": (_spanned, [("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())], "doc_id long, spans array<struct<start:bigint,end:bigint>>, kept binary"),
}


def _finished(store: Store, length: int, buckets: int, result: str, rows: pa.Table) -> pa.Table:
    part, offset, size = (rows.column(name)[0].as_py() for name in ("part", "offset", "size"))
    chunk = Chunk.unpacked(store.read(part, offset, size), length)
    gone = _removed(chunk, rows, buckets)
    make, fields, _ = _RESULTS[result]
    out = [make(None if doc_id == NO_ID else doc_id, chunk.bytes[a:b], gone[a:b]) for doc_id, a, b in zip(chunk.ids.tolist(), [0, *chunk.ends[:-1].tolist()], chunk.ends.tolist())]
    return _out(out, *fields, place=False)


def _with(step: Callable, *settings) -> Callable[[pa.Table], pa.Table]:
    def grouped(rows: pa.Table) -> pa.Table:
        return step(*settings, rows)

    return grouped


def _input_bytes(docs: DataFrame) -> int:
    """Catalyst's estimate of the input's size; 0 where it has none."""
    found = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return found if found < 1 << 60 else 0


def remove_repeats(docs: DataFrame, length: int = LENGTH, result: str = "digest", *, chunk_bytes: int | None = None, buckets: int | None = None, heavy: int = HEAVY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """What is left of each document: counts and a digest, or with result="spans" the removed spans and the bytes kept.

    chunk_bytes and buckets follow from the input's size unless given; no setting changes the result.
    """
    if length <= ANCHOR:
        raise ValueError(f"strings must be longer than the anchors of {ANCHOR} bytes")
    spark = docs.sparkSession
    texts = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    size, width = _input_bytes(texts), shuffle_width(spark)
    chunk_bytes = chunk_bytes or min(CHUNK_BYTES[1], max(CHUNK_BYTES[0], size // CHUNK_SHARE))
    buckets = buckets or min(MOST_BUCKETS, max(4 * width, size // BUCKET_BYTES))
    store, by_chunk = Store(fresh_path(spark, "chunks")), ("part", "offset", "size")
    # Rows here are few and small for the work they lead to, so the number of tasks is given rather than left to their size.
    tasks = max(width, buckets // 8)
    told = texts.mapInArrow(partial(_stored, store, length, chunk_bytes, buckets), f"{_PLACE}, anchors binary, shared binary, docs binary")
    bits = written(told.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_with(_repeated, heavy), f"{_PLACE}, bits binary, many binary, first binary"), "repeats-bits")
    asked = bits.repartition(tasks, *by_chunk).groupBy(*by_chunk).applyInArrow(_with(_asked, store, length, buckets), f"{_PLACE}, segments binary")
    answers = written(asked.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_with(_answered, length), f"{_PLACE}, answer binary"), "repeats-answers")
    both = bits.withColumn("answer", F.lit(None).cast("binary")).unionByName(answers, allowMissingColumns=True)
    return both.repartition(tasks, *by_chunk).groupBy(*by_chunk).applyInArrow(_with(_finished, store, length, buckets, result), _RESULTS[result][2])


#: Brute force over all strings; hexadecimal digits stand for bytes.
SQL = f"""
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT doc_id, unnest(list_transform(range(len(h) // 2 - {LENGTH - 1}), lambda i: substr(h, CAST(2 * i + 1 AS INT), {2 * LENGTH}))) AS s, unnest(range(len(h) // 2 - {LENGTH - 1})) AS pos FROM bytes),
later AS (SELECT doc_id, pos FROM strings QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
edges AS (SELECT doc_id, pos, coalesce(pos > lag(pos) OVER w + {LENGTH}, true) AS fresh FROM later WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
spans AS (SELECT doc_id, min(pos) AS first, max(pos) + {LENGTH} AS last FROM (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM edges) GROUP BY doc_id, nth),
gaps AS (SELECT doc_id, first, last, coalesce(lag(last) OVER w, 0) AS kept_from, lead(first) OVER w IS NULL AS is_last FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY first)),
kept AS (
  SELECT doc_id, string_agg(substr(h, CAST(2 * kept_from + 1 AS INT), CAST(2 * (first - kept_from) AS INT)) || CASE WHEN is_last THEN substr(h, CAST(2 * last + 1 AS INT)) ELSE '' END, '' ORDER BY first) AS rest,
         CAST(sum(last - first) AS BIGINT) AS n_removed, count(*) AS n_spans FROM gaps JOIN bytes USING (doc_id) GROUP BY 1)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM bytes LEFT JOIN kept USING (doc_id)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
