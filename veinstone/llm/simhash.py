"""SimHash near-duplicates through a Gray-order hierarchical index.

Texts are lower-cased (A-Z), cut into words and shingles; a fingerprint bit is set if it is set in over half of the
shingles' XXH64 values. Two fingerprints link at up to MOST differing bits, and documents of linked fingerprints,
however far along the links, form one component, named by its smallest doc_id.

Links are found among distinct fingerprints only. Two of them with at most three differing bits agree on one of four
16-bit blocks, so each fingerprint goes to four buckets. Inside a bucket the fingerprints are sorted by Gray rank, which
puts alike ones next to each other. FANOUT neighbours get a parent that holds the bits on which all of them agree, as a mask
and a pattern; the bits need not be leading ones. Parents get parents in the same way, up to one root for the bucket.
Pairs of nodes are followed downwards from the root. The differences on the bits that both nodes know can only
accumulate on the way, so a pair of groups above the limit is pruned as a whole. A bucket reports members of its
local components, never pairs, and components grow together by spreading the smallest member and jumping to its own
smallest, until nothing changes: the rounds grow with the logarithm of the longest chain.

No bucket is capped. Buckets of one-word fingerprints above SPLIT members are split again on four blocks of their other
48 bits by the same argument. Any bucket that is still above PIECE is dealt out in pieces, and each pair of pieces is a
task of its own, so that a task's memory is bounded and no pair is lost.

Null and empty texts, and those without a word, have fingerprint zero and link like any other. A null doc_id takes part,
but names a component only if there is no other id in it (the component is then null). Rows keep their multiplicity, and
columns besides id and text are ignored.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinstone.llm.common import HOT_SHARE, fresh_path, skew_safe_lookup, superseded, table, written

SEED, MOST, WORDS, FANOUT = 42, 3, 10, 8
#: Distinct fingerprints of a bucket from which it is split again, and those of a piece of a bucket that stays larger.
SPLIT, PIECE = 2048, 1 << 14
#: Shingles whose bits are counted, and node pairs that are expanded, at a time: bounds of memory.
SHINGLES, PAIRS = 1 << 15, 1 << 20
#: Bytes of shingle sets that a task keeps while it compares them.
HELD_BYTES = 64 << 20
#: How many deviations above the expected differing bits a pair is still compared by its shingles.
DEVIATIONS = 3.0
#: Label of a fingerprint whose documents have no id.
NO_ID = (1 << 63) - 1
#: Bits of a set's place that tell its offset; those above tell its file.
OFFSET_BITS = 40
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bits of each byte value, lowest first.
_BITS = np.array([[x >> k & 1 for k in range(8)] for x in range(256)], "i8")


# --- fingerprints ------------------------------------------------------------------------------------------------------


def _shingle_hashes(text: str, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of a text, some at a time."""
    words = text.encode().lower().split()
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    begin, end = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    for at in range(0, len(begin), SHINGLES):
        yield np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(begin[at : at + SHINGLES], end[at : at + SHINGLES])], "<u8")


def _signature(pieces: Iterator[np.ndarray], words: int) -> np.ndarray:
    counts, shingles = np.zeros((8 * words, 8), "i8"), 0
    for hashes in pieces:
        lanes = np.empty((len(hashes), words), "<u8")
        for k in range(words):
            lanes[:, k] = hashes
            hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            hashes = hashes ^ (hashes >> np.uint64(32))
        # Bits are counted through how often each byte has each value.
        values = lanes.view("u1") + np.arange(8 * words, dtype="i4") * 256
        counts += np.bincount(values.ravel(), minlength=8 * words * 256).reshape(-1, 256) @ _BITS
        shingles += len(lanes)
    return np.packbits(counts * 2 > shingles, bitorder="little").view("<u8")


def fingerprint(text: str, shingle: int = 3) -> int:
    """SimHash of one text, unsigned; repeated shingles count as often as they stand there."""
    return int(_signature(_shingle_hashes(text, shingle), 1)[0])


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The distinct shingles of a text, as sorted XXH64 values."""
    return np.unique(np.concatenate([np.empty(0, "<u8"), *_shingle_hashes(text, shingle)]))


def signature(shingles: np.ndarray, words: int) -> np.ndarray:
    """SimHash of a set of shingles: 64-bit words, of which the first is of the XXH64 values and others of numbers drawn from them."""
    return _signature((shingles[at : at + SHINGLES] for at in range(0, len(shingles), SHINGLES)), words)


def fingerprints(docs: DataFrame, shingle: int = 3, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, bits): the fingerprint of each text, as a signed long."""

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(text.as_py() or "", shingle) for text in batch.column(1)], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "bits"])

    texts = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return texts.mapInArrow(batches, "doc_id long, bits long")


class Shingles:
    """Shingle sets in the shared folder: a file for each partition, read back by place; 32 bits of each shingle's hash."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def path(self, part: int) -> tuple[fs.FileSystem, str]:
        files, root = fs.FileSystem.from_uri(self.folder)
        return files, f"{root}/part-{part:06d}.shingles"

    def reader(self) -> Callable[[int, int], np.ndarray]:
        """Reads sets by place and size; the last ones read are kept, up to HELD_BYTES."""
        held: OrderedDict[int, np.ndarray] = OrderedDict()
        opened: OrderedDict[int, pa.NativeFile] = OrderedDict()
        total = 0

        def read(place: int, size: int) -> np.ndarray:
            nonlocal total
            if place in held:
                held.move_to_end(place)
                return held[place]
            part = place >> OFFSET_BITS
            if part not in opened:
                if len(opened) == 64:
                    opened.popitem(last=False)[1].close()
                files, path = self.path(part)
                opened[part] = files.open_input_file(path)
            found = np.frombuffer(opened[part].read_at(4 * size, place & ((1 << OFFSET_BITS) - 1)), "<u4")
            held[place] = found
            total += found.nbytes + 200
            while total > HELD_BYTES and len(held) > 2:
                total -= held.popitem(last=False)[1].nbytes + 200
            return found

        return read


def signatures(docs: DataFrame, store: Shingles, shingle: int, words: int, row: Column | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, row, bits, place, size): the signature of each text's shingle set, and where the set is kept; row: a string that goes along."""

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, offset = context.partitionId(), 0
        files, path = store.path(part)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        draft = f"{path}.{context.taskAttemptId()}"
        with files.open_output_stream(draft, compression=None) as file:
            for batch in batches:
                bits, places, sizes = [], [], []
                for text in batch.column(2):
                    found = shingle_set(text.as_py() or "", shingle)
                    bits.append(signature(found, words).tobytes())
                    cut = np.unique(found.astype("<u4"))
                    file.write(cut.tobytes() or b"-")  # places are names of nodes, so each is another, that of an empty set too
                    places.append(part << OFFSET_BITS | offset)
                    sizes.append(len(cut))
                    offset += cut.nbytes or 1
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary()), pa.array(places, pa.int64()), pa.array(sizes, pa.int32())], names=["doc_id", "row", "bits", "place", "size"])
        files.move(draft, path)

    row = F.lit("") if row is None else row
    texts = docs.select(docs[id_column].cast("long").alias("doc_id"), row.alias("row"), docs[text_column].cast("string").alias("text"))
    return texts.mapInArrow(batches, "doc_id long, row string, bits binary, place long, size int")


# --- the index ---------------------------------------------------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> np.uint64(shift))
    return codes


class GrayIndex:
    """Hierarchical index over the fingerprints (n, words) of some buckets, in Gray order of one of their words.

    levels: for each level, the leaves first, (patterns, masks) of its nodes; children and leaves: for each level, where the
    children, and the leaves, of each node begin, and an end.
    """

    def __init__(self, buckets: np.ndarray, codes: np.ndarray, lead: np.ndarray | None = None) -> None:
        lead = codes[:, 0] if lead is None else lead
        self.order = np.lexsort((gray_rank(lead), buckets))
        home, patterns = buckets[self.order], codes[self.order]
        masks = np.full(patterns.shape, _ALL)
        self.levels, self.children, self.leaves = [(patterns, masks)], [np.arange(len(home) + 1)], [np.arange(len(home) + 1)]
        while True:
            fresh = np.ones(len(home), bool)
            fresh[1:] = home[1:] != home[:-1]
            begins = np.flatnonzero(fresh)
            nth = np.arange(len(home)) - np.repeat(begins, np.diff(np.append(begins, len(home))))
            first = np.flatnonzero(nth % FANOUT == 0)
            if len(first) == len(home):
                return
            sizes = np.diff(np.append(first, len(home)))
            differing = np.bitwise_or.reduceat(patterns ^ np.repeat(patterns[first], sizes, axis=0), first, axis=0)
            masks = np.bitwise_and.reduceat(masks, first, axis=0) & ~differing
            patterns = patterns[first] & masks
            home = home[first]
            self.children.append(np.append(first, sizes.sum()))
            self.leaves.append(self.leaves[-1][self.children[-1]])
            self.levels.append((patterns, masks))

    def links(self, most: int, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions, in sorted order, of pairs within ``most`` differing bits.

        label: the component of each position, as far as the caller has found them. Pairs of nodes that lie in one component
        altogether are left out, so that a dense group doesn't cost the square of its size.
        """
        roots = np.arange(len(self.children[-1]) - 1)
        stack = [(len(self.levels) - 1, roots, roots)]
        while stack:
            level, a, b = stack.pop()
            if level == 0:
                yield a, b
                continue
            low, high = (f.reduceat(label, self.leaves[level][:-1]) for f in (np.minimum, np.maximum))
            apart = (low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])
            a, b = a[apart], b[apart]
            if not len(a):
                continue
            begin = self.children[level]
            across = begin[b + 1] - begin[b]
            total = (begin[a + 1] - begin[a]) * across
            if total.sum() > PAIRS and len(a) > 1:
                half = max(1, min(len(a) - 1, int(np.searchsorted(np.cumsum(total), total.sum() // 2))))
                stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            pair = np.repeat(np.arange(len(a)), total)
            offset = np.arange(len(pair)) - np.repeat(np.cumsum(total) - total, total)
            left, right = begin[a][pair] + offset // across[pair], begin[b][pair] + offset % across[pair]
            patterns, masks = self.levels[level - 1]
            keep = left < right
            if level > 1:  # a node of one fingerprint has no pair within itself
                keep |= (left == right) & (self.leaves[level - 1][left + 1] - self.leaves[level - 1][left] > 1)
            left, right = left[keep], right[keep]
            # What differs on the bits that both know: the differences above, and those on bits that come in here.
            differing = np.zeros(len(left), "i4")
            for k in range(patterns.shape[1]):
                x = patterns[left, k] ^ patterns[right, k]
                differing += np.bitwise_count(x if level == 1 else x & masks[left, k] & masks[right, k])
                if k + 1 < patterns.shape[1]:
                    near = differing <= most
                    left, right, differing = left[near], right[near], differing[near]
            near = differing <= most
            if near.any():
                stack.append((level - 1, left[near], right[near]))


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Brings the components of linked positions together, in place; a component is named by its smallest position."""
    while True:
        x, y = label[a], label[b]
        if not (unequal := x != y).any():
            return
        a, b, x, y = a[unequal], b[unequal], x[unequal], y[unequal]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while ((further := label[label]) != label).any():
            label[:] = further


def unite_verified(label: np.ndarray, a: np.ndarray, b: np.ndarray, alike: Callable[[int, int], bool]) -> None:
    """As unite, for pairs that must be compared first: one for each component at a time, and none within a component."""
    while True:
        x, y = label[a], label[b]
        unequal = x != y
        a, b = a[unequal], b[unequal]
        if not len(a):
            return
        first = np.unique(np.maximum(x, y)[unequal], return_index=True)[1]
        linked = np.array([alike(i, j) for i, j in zip(a[first].tolist(), b[first].tolist())], bool)
        unite(label, a[first][linked], b[first][linked])
        rest = np.ones(len(a), bool)
        rest[first] = False
        a, b = a[rest], b[rest]


def _block(bits: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1))


def _dealt_word(nodes: DataFrame) -> DataFrame:
    """(bits, bucket): each one-word fingerprint in the buckets of its four 16-bit blocks, those of large buckets in four smaller ones each."""
    own = F.col("bits")
    dealt = nodes.select("bits", F.explode(F.array(*(F.lit(block << 16).cast("long") + _block(own, 48 - 16 * block, 16) for block in range(4)))).alias("bucket"))
    block = F.shiftrightunsigned(F.col("bucket"), 16).cast("int")
    # Of 2^18 buckets at most, whatever the input: these may be broadcast.
    large = dealt.groupBy("bucket").count().where(F.col("count") > SPLIT).select("bucket", F.lit(True).alias("large"))
    turned = F.get(F.array(*(F.shiftleft(own, 16 * j).bitwiseOR(F.shiftrightunsigned(own, 64 - 16 * j)) for j in range(4))), block)
    again = F.array(*(F.lit((1 << 44) + (j << 40)) + F.col("bucket") * F.lit(1 << 12) + _block(turned, 36 - 12 * j, 12) for j in range(4)))
    return dealt.join(F.broadcast(large), "bucket", "left").select("bits", F.explode(F.when(F.col("large"), again).otherwise(F.array("bucket"))).alias("bucket"))


def _dealt_words(nodes: DataFrame, words: int) -> DataFrame:
    """nodes (node, size, bits) in the buckets of the 16-bit blocks of all words, with the word of the block."""
    block = lambda k: F.conv(F.hex(F.substring("bits", 2 * k + 1, 2)), 16, 10).cast("long")
    keys = F.array(*(F.lit(k << 16).cast("long") + block(k) for k in range(4 * words)))
    return nodes.select("node", "size", "bits", F.explode(keys).alias("bucket")).withColumn("word", F.shiftrightunsigned("bucket", 18).cast("int"))


def _in_pieces(dealt: DataFrame, spread: str) -> DataFrame:
    """dealt with buckets of over PIECE rows replaced by one for each pair of their pieces, sorted by bucket.

    There are at most rows / PIECE large buckets, and of signatures 2^18 for each word whatever the input: these are broadcast.
    """
    large = dealt.groupBy("bucket").count().where(F.col("count") > PIECE).select("bucket", F.ceil(F.col("count") / PIECE).cast("int").alias("pieces"))
    own = F.pmod(F.xxhash64(spread), F.col("pieces")).cast("int")
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.col("pieces") - 1), lambda k: k != own), lambda k: F.xxhash64("bucket", F.least(k, own), F.greatest(k, own)))
    found = dealt.join(F.broadcast(large), "bucket", "left").withColumn("bucket", F.explode(F.when(F.col("pieces").isNotNull(), pairs).otherwise(F.array("bucket")))).drop("pieces")
    return found.repartition("bucket").sortWithinPartitions("bucket")


def _by_bucket(linked: Callable[..., pa.RecordBatch], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hands over whole buckets, some at a time; the bucket is the last column of the sorted rows."""
    held: pa.Table | None = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        buckets = held.column(held.num_columns - 1).to_numpy()
        whole = int(np.searchsorted(buckets, buckets[-1])) if len(buckets) else 0  # the last bucket may go on
        if whole:
            yield linked(held.slice(0, whole).combine_chunks())
            held = held.slice(whole).combine_chunks()
    if held is not None and held.num_rows:
        yield linked(held.combine_chunks())


def _sets(nodes: np.ndarray, homes: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    """(node, set) of the local components of two or more."""
    members = (np.bincount(label, minlength=len(label)) > 1)[label]
    names = pa.array([f"{bucket:x}-{place:x}" for bucket, place in zip(homes[members].tolist(), nodes[label[members]].tolist())], pa.string())
    return pa.RecordBatch.from_arrays([pa.array(nodes[members], pa.int64()), names], names=["node", "set"])


def _within_bits(nodes: DataFrame, most: int) -> DataFrame:
    """(node, set): one-word fingerprints in the local components of their buckets."""

    def linked(rows: pa.Table) -> pa.RecordBatch:
        codes, buckets = rows.column("bits").to_numpy(), rows.column("bucket").to_numpy()
        index = GrayIndex(buckets, codes.view("u8").reshape(-1, 1))
        label = np.arange(len(codes))
        for a, b in index.links(most, label):
            unite(label, a, b)
        return _sets(codes[index.order], buckets[index.order], label)

    dealt = _in_pieces(_dealt_word(nodes.select(F.col("node").alias("bits"))), "bits")
    return dealt.select("bits", "bucket").mapInArrow(lambda batches: _by_bucket(linked, batches), "node long, set string")


def _within_similarity(nodes: DataFrame, store: Shingles, words: int, most: int, similarity: float) -> DataFrame:
    """(node, set): signatures in the local components of their buckets; a link is a pair whose shingle sets are as similar."""

    def linked(rows: pa.Table) -> pa.RecordBatch:
        codes = np.frombuffer(b"".join(rows.column("bits").to_pylist()), "<u8").reshape(-1, words)
        buckets = rows.column("bucket").to_numpy()
        index = GrayIndex(buckets, codes, codes[np.arange(len(codes)), rows.column("word").to_numpy()])
        codes, homes = index.levels[0][0], buckets[index.order]
        nodes, sizes = rows.column("node").to_numpy()[index.order], rows.column("size").to_numpy()[index.order]
        label, read = np.arange(len(codes)), store.reader()

        def alike(i: int, j: int) -> bool:
            one, two = read(int(nodes[i]), int(sizes[i])), read(int(nodes[j]), int(sizes[j]))
            if len(one) == 0 or len(two) == 0:
                return len(one) == len(two)
            common = len(one) + len(two) - len(np.union1d(one, two))
            return common >= similarity * (len(one) + len(two) - common) - 1e-9

        def settle(a: np.ndarray, b: np.ndarray) -> None:
            small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
            possible = small >= similarity * large - 1e-9
            unite_verified(label, a[possible], b[possible], alike)

        near = np.flatnonzero(homes[1:] == homes[:-1])  # neighbours in Gray order first: dense groups are one component then
        close = np.bitwise_count(codes[near] ^ codes[near + 1]).sum(axis=1) <= most
        settle(near[close], near[close] + 1)
        for a, b in index.links(most, label):
            settle(a, b)
        return _sets(nodes, homes, label)

    dealt = _in_pieces(_dealt_words(nodes, words), "node")
    return dealt.select("node", "size", "bits", "word", "bucket").mapInArrow(lambda batches: _by_bucket(linked, batches), "node long, set string")


# --- components --------------------------------------------------------------------------------------------------------


def connected(members: DataFrame) -> DataFrame:
    """(node, label): the smallest node that is reached from each through sets; members: (node, set).

    Each round, a node takes the smallest label of its sets, and then the label that this label's own node has got. The
    distance that labels travel so doubles from round to round.
    """
    members = written(members.withColumn("label", F.col("node")), "links-members")
    while True:
        lowest = members.groupBy("set").agg(F.min("label").alias("lowest"), F.count("*").alias("members"))
        by_node = Window.partitionBy("node")
        spread = skew_safe_lookup(members, lowest, "set", "members", F.col("node"))
        spread = written(spread.select("node", "set", F.min("lowest").over(by_node).alias("label"), (F.min("lowest").over(by_node) != F.col("lowest")).alias("moved")), "links-spread")
        superseded(members)
        if spread.where("moved").isEmpty():
            return spread.groupBy("node").agg(F.min("label").alias("label"))
        own = spread.groupBy("node").agg(F.min("label").alias("further"))
        led = spread.groupBy("label").agg(F.count("*").alias("led"))
        jump = led.join(own.withColumnRenamed("node", "label"), "label")
        members = written(skew_safe_lookup(spread.drop("moved"), jump, "label", "led", F.col("node")).select("node", "set", F.least("label", "further").alias("label")), "links-members")
        superseded(spread)


def _named(prints: DataFrame, nodes: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """prints with component_id, NO_ID where no document of it has an id.

    nodes: (key, node, label, copies), a row for each distinct fingerprint; sets: (node, set).
    """
    reached = connected(sets).withColumnRenamed("label", "root")
    linked = nodes.select("node", "label").join(reached, "node")
    names = linked.groupBy("root").agg(F.min("label").alias("name"), F.count("*").alias("size"))
    named = skew_safe_lookup(reached, names, "root", "size", F.col("node")).select("node", "name")
    named = nodes.join(named, "node", "left").select(key, "copies", F.coalesce("name", "label").alias("component_id"))
    return skew_safe_lookup(prints, named, key, "copies", F.col("doc_id"))


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = MOST, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; all pairs of up to ``most`` differing bits link."""
    if most > 3:
        raise ValueError("four blocks find pairs of up to three differing bits; see similar() for more")
    prints = written(fingerprints(docs, shingle, id_column=id_column, text_column=text_column), "simhash-prints")
    nodes = prints.groupBy("bits").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("label"), F.count("*").alias("copies"))
    nodes = written(nodes.withColumn("node", F.col("bits")), "simhash-nodes")
    sets = written(_within_bits(nodes, most), "simhash-sets")
    return _named(prints, nodes, sets, "bits").select(
        "doc_id",
        F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"),
        F.when(F.col("component_id") != NO_ID, F.col("component_id")).alias("component_id"),
    )


def differing_share(similarity: float) -> float:
    """Share of bits in which signatures differ for sets of a Jaccard similarity: they have 2s/(1+s) of their shingles in common."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = WORDS, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, component_id): documents link if the Jaccard similarity of their sets of shingles is as high.

    At similarity 0.8 signatures differ in 15 % of their bits, too many for one 64-bit fingerprint to tell or for four of its
    blocks to find. So signatures have ``words`` words, whose 16-bit blocks go to 4 x words tables. A pair that shares a
    bucket, and differs in no more bits than DEVIATIONS above those to be expected, is compared by its shingle
    sets, which a task reads from the shared folder as it needs them; these decide. No pair below the similarity
    links, and of those at it, ten words miss the 5 % that share no bucket and 0.1 % by the bits (of those at 0.82 3 %, at
    0.85 1 %). Texts with equal signatures are taken for equal sets. Two texts without a word are similar.

    With n distinct texts a bucket holds n / 2^16 unrelated ones; see README for what to raise beyond some 10^8 texts.
    """
    prints, nodes, sets = _similar_sets(docs, shingle, similarity, words, None, id_column, text_column)
    return _named(prints.select("doc_id", "bits"), nodes, sets, "bits").select("doc_id", "component_id")


def _similar_sets(docs: DataFrame, shingle: int, similarity: float, words: int, row: Column | None, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures (doc_id, row, bits, ...) of all documents, nodes (bits, label, copies, node, size) of the distinct ones, and sets (node, set) of linked nodes."""
    store = Shingles(fresh_path(docs.sparkSession, "shingles"))
    prints = written(signatures(docs, store, shingle, words, row, id_column=id_column, text_column=text_column), "simhash-signatures")
    nodes = prints.groupBy("bits").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("label"), F.count("*").alias("copies"), F.min(F.struct("place", "size")).alias("kept"))
    nodes = written(nodes.select("bits", "label", "copies", F.col("kept.place").alias("node"), F.col("kept.size").alias("size")), "simhash-nodes")
    share, bits = differing_share(similarity), 64 * words
    most = math.floor(bits * share + DEVIATIONS * math.sqrt(bits * share * (1 - share)))
    return prints, nodes, written(_within_similarity(nodes.select("node", "size", "bits"), store, words, most, similarity), "simhash-sets")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, one row of each component of similar ones: that with the smallest id, or where no row has one that with the smallest digest.

    A row is known by a digest of all its columns (but maps); of rows that are equal in these any one may stay. Rows without an id, and rows
    that repeat one, are judged by their component like any others. Columns keep their names and values, whatever they are called.
    """
    whole = F.struct(*(docs[f"`{c}`"] for c in docs.columns))
    told = [docs[f"`{c}`"] for c, kind in docs.dtypes if "map<" not in kind]
    row = F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(seed), *told)), 16, "0") for seed in (1, 2)))
    prints, nodes, sets = _similar_sets(docs, shingle, similarity, WORDS, row, id_column, text_column)
    roots = nodes.join(connected(sets).withColumnRenamed("label", "root"), "node", "left").select("bits", "copies", F.coalesce("root", "node").alias("root"))
    of = written(skew_safe_lookup(prints.select("bits", "doc_id", "row"), roots, "bits", "copies", F.col("row")).select("root", "doc_id", "row"), "simhash-rows")
    first = of.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")).select("first.row")
    first = written(of.groupBy("row").agg(F.count("*").alias("rows")).join(first, "row"), "simhash-first")
    keyed, often = docs.select(whole.alias("whole"), row.alias("row")), F.col("rows") > F.lit(max(1.0, of.count() / HOT_SHARE))
    hot = F.broadcast(first.where(often).select("row"))  # under HOT_SHARE rows
    nth = F.row_number().over(Window.partitionBy("row").orderBy("rows"))
    rare = keyed.join(hot, "row", "left_anti").join(first.where(~often), "row").withColumn("nth", nth).where("nth = 1").select("whole.*")
    return rare.unionByName(keyed.join(hot, "row", "left_semi").groupBy("row").agg(F.first("whole").alias("whole")).select("whole.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
