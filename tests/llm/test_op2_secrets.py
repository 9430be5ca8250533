import hashlib
import math
import random
import re
import string

from pyspark.sql import functions as F

from veinstone.llm import secrets

PATTERNS = [
    (re.compile(secrets.ASSIGN), lambda m: len(m[2]) >= 6),
    (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def test_base_spans(spark, odd):
    rng = random.Random(5)
    texts = ["x secret: token: abcdefgh y", "token=token=abcdefgh", 'é token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" é', "API_KEY:\"" + "a" * 20_000, "AKIAAKIA" + "B" * 30, "password=short1 passwd : ab"]
    texts += ["".join(rng.choice(["secret", "=", ":", " ", "abc123", "'", "token", "deadbeef", "AKIA", "0123456789", "é", "\n"]) for _ in range(60)) for _ in range(150)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(texts, 1000)), "doc_id long, text string"))
    found = {r.doc_id: r for r in secrets.report(docs).collect() if r.doc_id is not None}
    for r in docs.collect():
        if r.doc_id is None:
            continue
        spans = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(PATTERNS) for m in p.finditer(r.text or "") if ok(m))
        listed = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        row = found[r.doc_id]
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
        assert [s for s in row.spans.split(",") if not s.startswith("random")] == (listed.split(",") if listed else [""]) or "random" in row.spans


def simes(p):
    return min(1.0, *(x * len(p) / (k + 1) for k, x in enumerate(sorted(p))))


def below(z):
    return math.erfc(-z / math.sqrt(2)) / 2


def battery(value, alphabet):
    """Both p-values of a string, straight from the definitions."""
    codes, k, n = [alphabet.index(c) for c in value], len(alphabet), len(value)
    found = sum(codes.count(a) * (codes.count(a) - 1) // 2 for a in range(k))
    expected = n * (n - 1) / 2 / k
    upto = lambda c: sum(math.exp(-expected + j * math.log(expected) - math.lgamma(j + 1)) for j in range(c + 1))
    two = lambda z: math.erfc(abs(z) / math.sqrt(2))
    chi = two((found - expected) / math.sqrt(expected * (1 - 1 / k))) if expected > secrets.MANY else max(0, min(1, 2 * min(upto(found), 1 - upto(found - 1))))
    high = [c * 2 >= k for c in codes]
    both, changes = 2 * sum(high) * (n - sum(high)), sum(a != b for a, b in zip(high, high[1:]))
    p_runs = two((changes - both / n) / math.sqrt(both * (both - n) / (n * n * (n - 1)))) if both > n else 0
    mean = sum(codes) / n
    variance = sum((c - mean) ** 2 for c in codes)
    serial = sum((codes[i] - mean) * (codes[(i + 1) % n] - mean) for i in range(n)) / variance + 1 / n if variance else None
    of = secrets.model()
    share, varying, change, correlated = of.by_size[k]
    scores = [of.pairs[(ord(a.lower()) - 97) * 26 + ord(b.lower()) - 97] for a, b in zip(value, value[1:]) if re.fullmatch("[a-z][a-z]|[A-Z][A-Za-z]", a + b)]
    strange = below((sum(scores) - len(scores) * of.mean) / math.sqrt(len(scores) * of.variance)) if scores else 1
    pairs = n * (n - 1) / 2
    ordinary = [below((found + 0.5 - pairs * share) / math.sqrt(pairs * share * (1 - share) + n * (n - 1) * (n - 2) * varying)), 1 - below((changes - 0.5 - (n - 1) * change) / math.sqrt((n - 1) * change * (1 - change))), below(((1 if serial is None else serial) - correlated) * math.sqrt(n)), strange]
    return simes([chi, p_runs, two(serial * math.sqrt(n)) if variance else 0]), simes(ordinary)


def measured(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "value string").withColumn("c", F.struct(F.lit(0).alias("start"), F.length("value").alias("end"), F.col("value").alias("value"), secrets._alphabet(F.col("value")).alias("alphabet")))
    return rows.withColumn("t", F.transform(F.array("c"), secrets._tested)[0]).where("c.alphabet IS NOT NULL").collect()


def test_battery(spark):
    rng = random.Random(3)
    values = ["".join(rng.choice(a) for _ in range(n)) for a in secrets.ALPHABETS for n in (20, 40, 200)] + ["ab12" * 10, "a1" * 30, "0123456789abcdef" * 3, *ORDINARY]
    for r in measured(spark, values):
        random_p, ordinary_p = battery(r.value, r.c.alphabet)
        want = 0 if random_p < secrets.REFUTED else min(secrets.BINS, max(0, math.floor(-math.log10(max(1e-30, ordinary_p)) * 10)))
        assert r.t.kind == min(12, len(r.value) // 8)
        assert abs(r.t.bin - want) <= 1 or want > 60 or abs(random_p - secrets.REFUTED) < 1e-3


ORDINARY = [
    "getUserById2AndUpdateAll", "report-2023-quarterly-final", "src/main/java/org/example3", "IMG_20230415_backup_copy", "MyVeryLongClassName2Factory", "user_account_settings_v2_old",
    "windows-server-2019-standard", "customerOrderHistory2024Export", "chapter12/section3/figure07", "assets/images/header2/logo", "2023-11-05T10-22-33-backup", "convertCelsiusToFahrenheit2",
    "data_2021_12_31_final_version", "AbstractSingletonProxy4Bean", "northwest-region-sales-q3-2022", "test_integration_pipeline_42",
]


def reported(spark, strings):
    """Which of the strings, each in a document, are reported."""
    found = secrets.report(spark.createDataFrame([(k, f"see {v} end") for k, v in enumerate(strings)], "doc_id long, text string")).collect()
    return {strings[r.doc_id] for r in found if "random" in r.spans}


def secret(rng, n):
    return "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n - 3)) + "1aZ"


def test_ordinary_strings_alone_and_in_company(spark):
    rng = random.Random(11)
    planted = [secret(rng, rng.choice([32, 40, 40, 64])) for _ in range(400)]
    assert not reported(spark, ORDINARY)
    found = reported(spark, ORDINARY + planted)
    precision, recall = len(found & set(planted)) / len(found), len(found & set(planted)) / len(planted)
    assert precision >= 0.98 and recall >= 0.75 and len(found & set(ORDINARY)) <= 1
    long = [p for p in planted if len(p) == 64]
    assert sum(p in found for p in long) >= 0.9 * len(long)


def identifiers(rng, count):
    """Ordinary strings of many forms, made of words."""
    words = "account address backup chapter client config customer data default element export factory feature final handler header history image index invoice item level list manager message model module network number object order output page parent payment pipeline policy product profile project quarter query record region report request result sales schema section server service session setting source status storage stream system table target task ticket token total update upload user value vendor version window worker".split()
    out = []
    while len(out) < count:
        some = [rng.choice(words) for _ in range(rng.randrange(3, 6))]
        number = str(rng.choice([rng.randrange(10), rng.randrange(2000, 2026), rng.randrange(100)]))
        some.insert(rng.randrange(1, len(some) + 1), number)
        form = rng.randrange(4)
        text = "".join(w.capitalize() for w in some) if form == 0 else some[0] + "".join(w.capitalize() for w in some[1:]) if form == 1 else "_-/"[rng.randrange(3)].join(some) if form == 2 else "-".join(some)
        if len(text) >= 20:
            out.append(text)
    return out


def test_error_rate_of_what_is_reported(spark):
    """p-values of ordinary strings are no smaller than their share, so few of what is reported is ordinary."""
    rng = random.Random(12)
    ordinary = identifiers(rng, 2000)
    p = sorted(10 ** (-r.t.bin / 10) for r in measured(spark, ordinary))
    for level in (0.01, 0.05, 0.1):
        assert sum(x <= level for x in p) <= 1.2 * level * len(p) + 3
    planted = [secret(rng, 48) for _ in range(200)]
    found = reported(spark, ordinary + planted)
    assert len(found - set(planted)) <= 0.1 * len(found) and len(found & set(planted)) >= 0.5 * len(planted)


def test_recall_by_length(spark):
    """Random letters and digits, and those of one case, from 20 characters on, alone and among ten times as many ordinary strings."""
    rng = random.Random(13)
    ordinary = identifiers(rng, 3000)
    for n, least, least_among in ((20, 0.85, 0.7), (24, 0.9, 0.8), (32, 0.95, 0.9), (40, 0.95, 0.95)):
        for chars in (string.ascii_letters + string.digits, string.ascii_lowercase + string.digits):
            planted = ["".join(rng.choice(chars) for _ in range(n - 2)) + "7k" for _ in range(300)]
            assert len(reported(spark, planted)) >= least * 300
            found = reported(spark, ordinary + planted)
            assert len(found & set(planted)) >= least_among * 300 and len(found - set(planted)) <= 0.1 * len(found)


def test_measured_model():
    of = secrets.model()
    assert sorted(of.by_size) == [16, 32, 36, 62, 64] and len(of.pairs) == 676
    assert all(1 / k < share < 0.2 and varying > 0 and 0 < change < 1 for k, (share, varying, change, _) in of.by_size.items())
    pair = lambda x: of.pairs[(ord(x[0]) - 97) * 26 + ord(x[1]) - 97]
    assert pair("th") > 0 > pair("qx") and of.mean > 0


def test_added_spans(spark):
    rng = random.Random(11)
    hidden = ["key " + secret(rng, 43) + " end" for _ in range(40)]
    plain = ["see Abcdefghij1234567890Abcdefghij1234567890Abcdefghij1234567890 end", "Donaudampfschifffahrtsgesellschaft here"] * 10
    found = {r.doc_id: r.spans for r in secrets.report(spark.createDataFrame(list(enumerate(hidden + plain)), "doc_id long, text string")).collect()}
    assert sum("random" in found[k] for k in range(40)) >= 34
    assert not any("random" in found[k] for k in range(40, 60))


def test_benjamini_hochberg(spark):
    cells = [(5, 40)] * 3 + [(4, 25)] * 2 + [(2, 13)] * 5 + [(3, 14)] * 6 + [(4, 5)] * 90
    raw = [min(2.0, max(0.5, (k + 0.5) * 8 / 32)) for k, _ in cells]
    weighted = [10 ** (-b / 10) / (w * len(cells) / sum(raw)) for (_, b), w in zip(cells, raw)]
    threshold = max((q for q in weighted if q <= 0.05 * sum(x <= q for x in weighted) / len(cells)), default=0)
    limits = secrets.reported_from(spark.createDataFrame(cells, "kind int, bin int"))
    assert [b >= limits[k] for k, b in cells] == [q <= threshold for q in weighted]
    assert secrets.reported_from(spark.createDataFrame([], "kind int, bin int")) == [secrets.BINS + 1] * (secrets.LAST_CLASS + 1)


def test_redaction(spark):
    docs = spark.createDataFrame([(0, 'é token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" é', 3), (1, None, 4), (2, "clean", 5)], "doc_id long, text string, n_chars long")
    assert {r.doc_id: (r.text, r.n_chars) for r in secrets.redact(docs).collect()} == {0: ('é [SECRET]" é', 13), 1: (None, None), 2: ("clean", 5)}
