"""Each stage of the corpus pipeline, on what its predecessor kept, against a plain version."""

import base64
import hashlib
import random
import re

import duckdb
import public_tokenizers
import pytest
import tiktoken
from test_op1_quality import distance, measures

import corpus_pipeline
from veinstone.llm import mixing, quality
from veinstone.llm.common import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    """Prose of real words with copies, near copies, junk, secrets and nulls."""
    rng = random.Random(21)
    common = list(quality.COMMON_WORDS["en"])
    weights = list(quality.COMMON_WORDS["en"].values())
    names = ["".join(rng.choice("bcdfghlmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 4))) for _ in range(800)]
    word = lambda: rng.choices(common, weights)[0] if rng.random() < 0.31 else rng.choice(names)
    prose = lambda n: " ".join(("" if k % 11 else "\n" if k % 33 == 0 else "") + word() + ("." if k % 11 == 10 else "") for k in range(n))
    texts = [prose(rng.randrange(70, 240)) for _ in range(120)]
    for k in range(0, 40, 4):
        texts.append(texts[k])
        words = texts[k + 1].split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
        words = texts[k + 2].split(" ")
        for at in range(0, len(words), 9):
            words[at] = "other"
        texts.append(" ".join(words))
    texts += [prose(150) + f" password = 'hunter2{k}' and AKIA0123456789ABCDE{k} there" for k in range(8)]
    texts += [None, "", "too short", "the of and " * 60, "#$% " * 80, "ZZZZ " * 90, texts[0].upper()]
    return [(k, t, "en", f"src{k % 4}" if k % 9 else None, len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage got and gave."""
    docs = written(spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3), "pipeline-test")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], ""), "pipeline-test"))
    return out


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def plain_kept(text):
    n_words, chars, _, _, repeated = measures(text)
    if n_words < 20 or 100 * repeated > 30 * n_words:
        return False
    lower, letters = len(re.findall("[a-z]", text)), sum(c.isalpha() for c in text)
    upper, digits = sum(c.isupper() for c in text), sum(c.isdecimal() for c in text)
    white, points = len(text) - chars, len(re.findall(r"""[.,;:!?'"()-]""", text))
    classes = [lower, letters - lower - upper, upper, digits, white, points, len(text) - letters - digits - white - points]
    far = min(distance([c / len(text) for c in classes], v) for v in quality.CLASS_SHARES.values())
    tokens = [w for w in re.split(r"[^a-zA-Z]+", text.lower()) if w]
    n = max(1, len(tokens))
    of = lambda words: [tokens.count(w) / n for w in words] + [sum(t not in words for t in tokens) / n]
    strange = min(distance(of(list(words)), quality.word_shares(k)) for k, words in quality.COMMON_WORDS.items())
    limit = lambda x, m: x[0] + x[1] / max(1, m) ** 0.5
    return not (len(text) >= quality.MIN_CHARS and far > limit(quality.CHAR_LIMIT, n_words)) and not (len(tokens) >= quality.MIN_COMMON and strange > limit(quality.WORD_LIMIT, len(tokens)))


def test_quality_rules(stages):
    given, kept = rows(stages[0]), rows(stages[1])
    assert kept == [(i, t) for i, t in given if t is not None and plain_kept(t)] and 100 < len(kept) < len(given)


def test_near_duplicates(stages):
    given, kept = rows(stages[1]), rows(stages[2])
    sets = []
    for _, text in given:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))})
    label = list(range(len(given)))
    for a in range(len(given)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    assert kept == [row for k, row in enumerate(given) if label[k] == k] and len(kept) < len(given) - 15


def test_secrets(stages):
    given, kept = rows(stages[2]), rows(stages[3])

    def redacted(text):
        spans = [(m.start(), m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
        spans += [m.span() for m in re.finditer("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", text)]
        for a, b in sorted(spans, reverse=True):
            text = text[:a] + "[SECRET]" + text[b:]
        return text

    assert kept == [(i, redacted(t)) for i, t in given] and sum("[SECRET]" in t for _, t in kept) >= 5
    assert all(r.n_chars == len(r.text) for r in stages[3].collect() if "[SECRET]" in r.text)


def test_mixing(stages):
    """As many copies of each document as the SQL of the query takes."""
    given = stages[3].toPandas()  # noqa: F841  read by the SQL
    connection = duckdb.connect()
    connection.register("documents", given)
    want = {doc_id: n for doc_id, n in connection.sql(f"SELECT doc_id, len(string_split(copies, ',')) FROM ({mixing.SQL}) WHERE copies <> ''").fetchall()}
    got = {}
    for doc_id, _ in rows(stages[4]):
        got[doc_id] = got.get(doc_id, 0) + 1
    assert got == want and max(got.values()) <= 3


def test_tokens(stages):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for doc_id, text in rows(stages[4]):
        ids = encoding.encode_ordinary(text)
        want.append((doc_id, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in stages[5].collect()) == sorted(want)


def test_run_removes_what_stages_write(spark, tmp_path):
    from veinstone.llm import common

    stages_before = set(common._LEFT)
    spark.createDataFrame(corpus()[:60], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    left = [path for path in common._LEFT if path not in stages_before]
    assert len(left) == 1 and "pipeline-3" in left[0] and found.count() > 0
