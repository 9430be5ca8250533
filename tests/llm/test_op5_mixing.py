import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from veinstone.llm import mixing


def test_against_brute_force(spark, odd):
    rows = mixing.mix(odd).collect()
    docs = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in odd.collect()]
    sizes = Counter()
    for _, source, size in docs:
        sizes[source] += size
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weights = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:  # what is above the cap is shared again by weight
        rest = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weights[s] / max(1, sum(weights[x] for x in names if x not in capped)) for s in names}
        more = {s for s in names if s not in capped and target[s] > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    source_of = defaultdict(set)
    for doc_id, source, _ in docs:
        source_of[doc_id].add(source)
    taken, largest = Counter(), max(size for *_, size in docs)
    for r in rows:
        assert len(r.copies) <= 3 and all(0 <= c.shard < mixing.SHARDS for c in r.copies)
        source = next(iter(source_of[r.doc_id])) if len(source_of[r.doc_id]) == 1 else None
        assert abs(r.target - target[source]) < 1e-6 * max(1, r.target) and r.source_size == sizes[source]
        taken[source] += r.size * len(r.copies)
    assert all(abs(taken[s] - target[s]) <= largest for s in names)


def test_reruns_agree(spark, odd):
    once, again = (sorted((r.doc_id or -1, r.size, str(r.copies)) for r in mixing.mix(rows).collect()) for rows in (odd, odd.repartition(2)))
    assert once == again


def test_hypergeometric(spark):
    def exact(u, everything, marked, drawn):
        reached, k = 0.0, max(0, drawn - (everything - marked))
        while True:
            reached += math.comb(marked, k) * math.comb(everything - marked, drawn - k) / math.comb(everything, drawn)
            if reached >= u or k == min(marked, drawn):
                return k
            k += 1

    cases = [(u, n, m, d) for u in (0.001, 0.2, 0.5, 0.9, 0.9999) for n, m, d in ((10, 3, 4), (100, 50, 30), (1000, 1, 500), (500, 500, 20), (2000, 700, 1000), (7, 0, 3), (1, 1, 1), (0, 0, 0))]
    rows = spark.createDataFrame(cases, "u double, n long, m long, d long")
    for r in rows.withColumn("k", mixing.hypergeometric(F.col("u"), F.col("n"), F.col("m"), F.col("d"))).collect():
        assert r.k == exact(r.u, r.n, r.m, r.d)


def test_quotas_are_exact(spark):
    given = {1: 37, 2: 1, 3: 0, 4: 250, 5: 64}
    ends = {r.nth: list(r.ends) for r in mixing.shard_quotas(spark.createDataFrame(list(given.items()), "nth int, n long"), 6).collect()}
    assert all(e[-1] == given[k] and len(e) == 6 and e == sorted(e) for k, e in ends.items())
    totals = [sum(e[s] - (e[s - 1] if s else 0) for e in ends.values()) for s in range(6)]
    assert max(totals) - min(totals) <= 2 and sum(totals) == sum(given.values())


def test_mixed_rows(spark, odd):
    copies = mixing.mix(odd).select(F.sum(F.size("copies"))).first()[0]
    rows = mixing.mixed(odd)
    assert rows.columns == odd.columns and rows.count() == copies


def sources_of(spark, rng, sizes):
    words = lambda n: " ".join("w" for _ in range(n))
    rows = [(k, words(rng.randrange(0, 60)), s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), {r[0]: r for r in rows}


def plain_quotas(quotas, shards):
    """The tree, straight from its definition: conditional hypergeometric quantiles at digests of node and source."""
    def quantile(u, everything, marked, drawn):
        reached, k = 0.0, max(0, drawn - (everything - marked))
        while True:
            reached += math.comb(marked, k) * math.comb(everything - marked, drawn - k) / math.comb(everything, drawn)
            if reached >= u or k == min(marked, drawn):
                return k
            k += 1

    def split(first, end, n):
        if end - first == 1:
            return {first: n}
        middle, everything = (first + end) // 2, sum(n.values())
        drawn, left = math.ceil(everything * (middle - first) / (end - first)), {}
        for nth in sorted(n):
            u = int(hashlib.md5(f"tree:{first}:{end}:{nth}".encode()).hexdigest()[:13], 16) / 2**52
            left[nth] = quantile(u, everything, n[nth], drawn)
            everything, drawn = everything - n[nth], drawn - left[nth]
        return split(first, middle, left) | split(middle, end, {k: n[k] - left[k] for k in n})

    return split(0, shards, quotas)


def test_shards_draw_their_quotas(spark):
    """Each shard draws exactly its leaf's quota of every source, no draw twice, and all draws of the passes."""
    rng = random.Random(5)
    docs, rows = sources_of(spark, rng, {"a": 900, "b": 40, "c": 300, "d": 7})
    found = mixing.mix(docs).collect()
    block = lambda r: int(hashlib.md5(f"{r[0]}:{hashlib.md5(r[1].encode()).hexdigest()}:mix".encode()).hexdigest()[:13], 16) >> 42
    draws = defaultdict(set)
    for r in found:
        for c in r.copies:
            draws[rows[r.doc_id][2]].add((c.copy, block(rows[r.doc_id]), c.shard))
    names, sizes = "abcd", Counter()
    for r in found:
        sizes[rows[r.doc_id][2]] += r.size
    quotas = {}
    for nth, name in enumerate(names, 1):
        homes = Counter((copy, b) for copy, b, _ in draws[name])
        assert sum(n > 1 for n in homes.values()) <= mixing.FILLS  # fills come to the shard of the block that is cut
        target = next(r.target for r in found if rows[r.doc_id][2] == name)
        whole, blocks = int(target // sizes[name]), {block(x) for x in rows.values() if x[2] == name}
        words = Counter()
        for x in rows.values():
            if x[2] == name:
                words[block(x)] += len(x[1].split())
        order = sorted(blocks, key=lambda b: (int(hashlib.md5(f"{nth}:{b}:{whole + 1}:draw".encode()).hexdigest()[:13], 16), b))
        rest, n = target - whole * sizes[name], 0
        while rest > 0 and sum(words[b] for b in order[:n]) < rest:
            n += 1
        quotas[nth] = whole * len(blocks) + n
    leaves = plain_quotas(quotas, mixing.SHARDS)
    got = {s: {nth: len({(c, b) for c, b, shard in draws[name] if shard == s}) for nth, name in enumerate(names, 1)} for s in range(mixing.SHARDS)}
    for s in leaves:
        for nth in leaves[s]:
            assert 0 <= leaves[s][nth] - got[s][nth] <= 1 or got[s][nth] - leaves[s][nth] <= mixing.FILLS  # the block that is cut may give nothing; fills add theirs
    assert sum(abs(leaves[s][nth] - got[s][nth]) for s in leaves for nth in leaves[s]) <= len(names) * (mixing.FILLS + 1)
    assert max(sum(x.values()) for x in leaves.values()) - min(sum(x.values()) for x in leaves.values()) <= 2


def test_tree_decides_what_is_taken(spark, monkeypatch):
    rng = random.Random(6)
    docs, _ = sources_of(spark, rng, {"a": 300, "b": 100, "c": 50})
    of = lambda: {r.doc_id: str(r.copies) for r in mixing.mix(docs).collect()}
    whole, real = of(), mixing.shard_quotas
    assert of() == whole
    monkeypatch.setattr(mixing, "shard_quotas", lambda quotas, shards: real(quotas.withColumn("n", F.floor(F.col("n") / 2)), shards))
    assert sum(len(x) for x in of().values()) < 0.7 * sum(len(x) for x in whole.values())
    monkeypatch.setattr(mixing, "shard_quotas", real)
    few = {r.doc_id: {c.shard for c in r.copies} for r in mixing.mix(docs, shards=3).collect()}
    assert set().union(*few.values()) == {0, 1, 2}


def test_empty_documents_of_a_full_source(spark):
    rows = [(k, "", "a") for k in range(50)] + [(100, "one two", "a")] + [(200 + k, "x " * 500, "b") for k in range(20)] + [(300, None, "z")]
    found = {r.doc_id: len(r.copies) for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert max(found.values()) <= 3 and found[300] == 0


def test_many_sources_join_by_shuffle(spark, monkeypatch):
    rng = random.Random(7)
    docs, _ = sources_of(spark, rng, {f"s{k}": 20 for k in range(12)})
    of = lambda: {r.doc_id: str(r.copies) for r in mixing.mix(docs).collect()}
    held = of()
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert of() == held
