"""Byte-level BPE encoding and decoding.

Bytes are read as Latin-1 characters, so that one Aho-Corasick automaton over the vocabulary finds the longest
token that begins at each byte of a pre-token. Encoding walks from left to right with these longest tokens;
a token is kept if the pair it forms with its left neighbour would survive the merges by rank, which is memoised
for each pair. Otherwise a shorter token is tried, and where none fits, the last token is taken back and that
position is never entered again. Each position fails at most once, so a pre-token takes linear time however long it
is, and the result is exactly that of merging by rank.

Null texts count as empty and have no tokens. Rows keep their multiplicity; any other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from veinstone.llm.common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bounds of the cache of pre-tokens in each Python worker.
CACHED, CACHED_CHARS = 200_000, 64


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: a line for each token, base64 and id."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class BytePairCodec:
    """Exact byte-level BPE over a rank table in which every byte is a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.shorter = lru_cache(1 << 16)(self._shorter)
        self.halves = lru_cache(1 << 17)(self._halves)
        self.compatible = lru_cache(1 << 20)(self._compatible)
        self.packed = _Packed(self)

    def _shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix."""
        whole = self.tokens[token]
        return next((self.ranks[whole[:n]] for n in range(len(whole) - 1, 0, -1) if whole[:n] in self.ranks), None)

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; none for bytes."""
        parts = [bytes([b]) for b in self.tokens[token]]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= token:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave this pair as it is.

        The seam between both is followed back through the merges that made them, latest first. Whatever meets at
        the seam must not merge into a token of lower rank than the merge which closed that state.
        """
        a, b, closed_by = left, right, 1 << 40
        while True:
            merged = self.ranks.get(self.tokens[a] + self.tokens[b])
            if merged is not None and merged < closed_by:
                return False
            parts_a, parts_b = self.halves(a), self.halves(b)
            if parts_a is None and parts_b is None:
                return True
            # Of equal ranks the left one is merged first, so the right one is undone first.
            if parts_b is None or (parts_a is not None and a > b):
                closed_by, a = a, parts_a[1]
            else:
                closed_by, b = b + 1, parts_b[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        longest: list[int] = [0] * len(piece)
        reach = [0] * len(piece)
        for end, (size, rank) in self.automaton.iter(piece.decode("latin-1")):
            start = end - size + 1
            if size > reach[start]:
                reach[start], longest[start] = size, rank
        open_at = bytearray(b"\1") * (len(piece) + 1)
        out: list[int] = []
        at, token, tokens = 0, longest[0], self.tokens
        while True:
            end = at + len(tokens[token])
            if open_at[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == len(piece):
                    return out
                token = longest[at]
            elif (shorter := self.shorter(token)) is not None:
                token = shorter
            else:
                open_at[at] = 0
                token = out.pop()
                at -= len(tokens[token])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, self.split(text)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Packed(dict):
    """Packed ids of pre-tokens; short ones are kept, up to a bound."""

    def __init__(self, codec: BytePairCodec) -> None:
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        packed = np.array(self.codec.encode_piece(piece.encode()), "<u4").tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = packed
        return packed


@lru_cache(2)
def _codec(ranks: bytes, pattern: str) -> BytePairCodec:
    return BytePairCodec(read_ranks(ranks), pattern)


def _run(docs: DataFrame, path: str, pattern: str, schema: str, each) -> DataFrame:
    with open(path, "rb") as file:  # a vocabulary: under a few MB, whatever the input
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            ids, columns = batch.column(0), ([], [], [])
            for text in batch.column(1):
                for column, value in zip(columns, each(codec, text.as_py() or "")):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns, kinds)], names=names)

    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}[part.split()[1]] for part in schema.split(", ")[1:]]
    return docs.mapInArrow(batches, schema)


def encode_documents(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the token ids of each text, and the bytes they decode to."""

    def each(codec: BytePairCodec, text: str) -> tuple:
        ids = np.frombuffer(codec.encode(text), "<u4")
        return len(ids), ids.astype("i4"), codec.decode(ids.tolist())

    return _run(docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text")), path, pattern, "doc_id long, n_tokens long, ids array<int>, decoded binary", each)


def digest_documents(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what encode_documents returns, digested before it leaves the worker."""

    def each(codec: BytePairCodec, text: str) -> tuple:
        packed = codec.encode(text)
        decoded = codec.decode(np.frombuffer(packed, "<u4").tolist())
        return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return _run(docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text")), path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", each)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
