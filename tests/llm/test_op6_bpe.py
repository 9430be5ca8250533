import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from veinstone.llm import bpe

PATH = P.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def both():
    ranks = bpe.read_ranks(open(PATH, "rb").read())
    return bpe.BytePairCodec(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_library(both):
    codec, library = both
    rng, tokens = random.Random(1), list(codec.tokens.values())
    for k in range(3000):
        n = rng.choice([1, 3, 10, 40])
        text = [
            lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)),
            lambda: "".join(chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0xD7FF), rng.randrange(0xE000, 0x10FFFF)])) for _ in range(n)),
            lambda: "".join(rng.choice(["a", "aa", "the", " ", "\n", "\t", "'s", "!!", "9", "\x1c", "\x85", "\xa0", "　", "<|endoftext|>"]) for _ in range(n)),
            lambda: "".join(rng.choice(tokens).decode("utf-8", "ignore") for _ in range(n)),
        ][k % 4]()
        ids = np.frombuffer(codec.encode(text), "<u4").tolist()
        assert ids == library.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_long_pieces_take_linear_time(both):
    for text in ("a" * 300_000, "ab" * 150_000, " " * 300_000 + "x", "é" * 100_000):
        assert both[0].decode(np.frombuffer(both[0].encode(text), "<u4").tolist()) == text.encode()


def test_documents(spark, odd, both):
    for r in bpe.encode_documents(odd, PATH).collect():
        assert r.n_tokens == len(r.ids)
    found = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest_documents(odd, PATH).collect()}
    want = set()
    for r in odd.collect():
        ids = both[1].encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert found == want
