"""Secret scans: three fixed patterns, and a battery of randomness tests for what they miss.

Candidates are runs of 20 or more characters of the usual encodings, with letters and digits. The smallest alphabet that
holds a candidate is its encoding. Three statistics are taken: coincidences of characters (chi-squared over the alphabet
is a linear function of them), the number of runs below and above the alphabet's middle, and the serial correlation of neighbours.

They are tested twice. First against random draws from the alphabet: a candidate that is refuted, by Simes' rule at the level
REFUTED, is too even, too uneven or too ordered for a secret. Then against ordinary strings (identifiers, paths, names with dates):
Ordinary tells how often their characters coincide, how often neighbours change sides, how they correlate, and which letters follow which. It is measured on the
words of a public tokenizer's vocabulary of many languages, put together as such strings are. The p-value of
a candidate is the chance, by Simes' rule over these four, that an ordinary string of its length looks as random; for refuted
ones it is 1. Over all candidates of all documents the Benjamini-Hochberg rule decides which are reported: of these, a share of FDR
at most is expected to be ordinary, whatever else is in the corpus. p-values are weighted by length with weights of mean 1: longer
candidates, where the tests tell more, get a larger share of the error budget. p-values are rounded up to a grid of BINS steps, so
the rule needs only a table of as many counts for each class of length, whatever the size of the corpus.

A verdict so depends on other rows through one number, the threshold, which lies between FDR over the number of candidates and FDR:
a candidate with a weighted p-value above FDR is never reported, and one below the lower bound always. That is the price of
an error rate that holds for the corpus: where nearly all candidates are ordinary, more is asked of each.

All of it is DataFrame expressions: a scan writes what is found in each document, without its text; the counts are
aggregated; and a second pass over what was written settles the candidates. Null texts count as empty and have no spans.
Positions are code points, ends exclusive. Rows keep their multiplicity; other columns are ignored (redact keeps them).
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinstone.llm.common import table, written

#: Kinds in order of their numbers, and the patterns of the first three.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are greedy, so these lengths within the pattern drop the same matches as a check afterwards.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
VALUE_CHARS = 6
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Encodings from the smallest alphabet to the largest.
ALPHABETS = [
    "0123456789abcdef",
    "0123456789ABCDEF",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "0123456789abcdefghijklmnopqrstuvwxyz",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
]
FDR, BINS, BINS_PER_DECADE = 0.05, 240, 10
#: Level at which a candidate is refuted as random.
REFUTED = 0.01
#: Lengths of a class, the last class, and the length whose raw weight is 1, with bounds of raw weights.
LENGTHS, LAST_CLASS, LENGTH_OF_WEIGHT_1, LIGHTEST, HEAVIEST = 8, 12, 32, 0.5, 2.0
#: The vocabulary that ordinary strings are made of: its words of LETTERS or more letters, WORDS in a string, with two digits.
VOCABULARY, LETTERS, WORDS = "byte_bpe_multi_50k.tiktoken", 4, 4
#: What is added to each count of a letter pair, and by how much the deviations of pair scores are widened, as their lower tail is longer than a normal one.
UNSEEN, WIDER = 0.5, 1.25
#: Coincidences to be expected from which their distribution is taken to be normal rather than Poisson's, and the most terms summed.
MANY, TERMS = 50, 200


@dataclass(frozen=True)
class Ordinary:
    """Of ordinary strings, by size of the alphabet: the chance that two characters coincide, how that chance varies with the characters (the sum
    of cubed shares less the square of the chance), the share of neighbours on different sides of the middle, and their correlation; of the forms
    that such strings have, always what looks most random. Of letters next to each other within a word: the log-ratio of each pair to chance, and
    the mean and variance of a pair's score."""

    by_size: dict[int, tuple[float, float, float, float]]
    pairs: tuple[float, ...]
    mean: float
    variance: float


def _pair_scores(text: str, scores: np.ndarray) -> np.ndarray:
    """Scores of letters side by side, but for a capital behind a small letter, where another word begins."""
    codes = np.frombuffer(text.encode(), "u1").astype("i8")
    small, large = (codes >= 97) & (codes <= 122), (codes >= 65) & (codes <= 90)
    kept = (small[:-1] & small[1:]) | (large[:-1] & (small | large)[1:])
    letters = (codes | 32) - 97
    return scores[letters[:-1][kept] * 26 + letters[1:][kept]]


@lru_cache
def ordinary(path: str) -> Ordinary:
    """Measured on a vocabulary: a file of tokens in base64, each with its rank."""
    tokens = []
    with open(path, "rb") as file:
        for line in file:
            token = base64.b64decode(line.split()[0]).strip()
            if len(token) >= LETTERS and token.isalpha() and token.isascii():
                tokens.append(token.decode().lower())
    tokens = list(dict.fromkeys(tokens))
    counts = np.full((26, 26), UNSEEN)
    for token in tokens:
        codes = np.frombuffer(token.encode(), "u1") - 97
        np.add.at(counts, (codes[:-1], codes[1:]), 1)
    scores = np.log2(counts / counts.sum() * 676).ravel()
    strings = [(tokens[k : k + WORDS], f"{k % 100:02d}") for k in range(0, len(tokens), WORDS)]
    camel = ["".join(w.capitalize() for w in words) + digits for words, digits in strings]
    forms = {
        16: ["".join("".join(words) + digits for words, digits in strings), "".join("".join(words) + f"{7919 * k:09d}"[-9:] for k, (words, _) in enumerate(strings))], 32: ["".join("".join(words).upper() + digits for words, digits in strings)], 36: ["".join("".join(words) + digits for words, digits in strings)],
        62: ["".join(camel)], 64: ["".join(camel), "".join("-".join([*words, digits]) for words, digits in strings), "".join("/".join([*words, digits]) for words, digits in strings)],
    }
    by_size = {}
    for size, texts in forms.items():
        found = []
        for alphabet in (a for a in ALPHABETS if len(a) == size):
            for text in texts:
                codes = np.array([alphabet.index(c) for c in (text.upper() if alphabet.isupper() else text) if c in alphabet])
                shares, high = np.bincount(codes, minlength=size) / len(codes), codes * 2 >= size
                found.append(((shares**2).sum(), (shares**3).sum() - (shares**2).sum() ** 2, (high[1:] != high[:-1]).mean(), np.corrcoef(codes[1:], codes[:-1])[0, 1]))
        by_size[size] = (min(f[0] for f in found), max(f[1] for f in found), max(f[2] for f in found), min(f[3] for f in found))
    sums = [(own.sum(), len(own)) for own in (_pair_scores(text, scores) for text in camel) if len(own)]
    mean = sum(s for s, _ in sums) / sum(n for _, n in sums)
    variance = sum((s - mean * n) ** 2 / n for s, n in sums) / len(sums)
    return Ordinary({k: tuple(map(float, v)) for k, v in by_size.items()}, tuple(scores.tolist()), float(mean), float(variance * WIDER**2))


def model() -> Ordinary:
    return ordinary(public_tokenizers.path(VOCABULARY))


def _places(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of a pattern's matches; value: what the group holds."""
    between, hits, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.zip_with(F.slice(between, F.lit(1), F.size(hits)), F.arrays_zip(hits.alias("hit"), values.alias("value")), lambda before, x: F.struct(F.length(before).alias("gap"), F.length(x["hit"]).alias("size"), x["value"].alias("value")))
    empty = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, end: INT, value: STRING>>)").alias("found"))

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + x["size"]
        return F.struct(end.alias("at"), F.array_append(state["found"], F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))).alias("found"))

    return F.when(text.rlike(pattern), F.aggregate(parts, empty, add, lambda state: state["found"])).otherwise(empty["found"])


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _count(kind: int) -> Column:
    return F.size(F.filter("_s_base", lambda x: x["kind"] == kind)).cast("long")


def _tail(z: Column) -> Column:
    """Two-sided normal tail probability, by the rational approximation 7.1.26 of Abramowitz and Stegun."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def _below(z: Column) -> Column:
    """Normal probability of a value up to z."""
    return F.when(z < 0, _tail(z) / 2).otherwise(1 - _tail(z) / 2)


def _alphabet(value: Column) -> Column:
    """The smallest alphabet of a candidate; null without both letters and digits, or for mixed signs."""
    chosen = F.lit(None).cast("string")
    for alphabet in reversed(ALPHABETS):
        chosen = F.when(F.translate(value, alphabet, "") == "", F.lit(alphabet)).otherwise(chosen)
    return F.when(value.rlike("[0-9]") & value.rlike("[A-Za-z]"), chosen)


def _tested(candidate: Column) -> Column:
    """struct<start, end, kind, bin> of a candidate <start, end, value, alphabet>."""
    codes = F.transform(F.split(candidate["value"], ""), lambda c: F.instr(candidate["alphabet"], c) - 1)
    with_codes = F.transform(F.array(F.struct(candidate["start"].alias("start"), candidate["end"].alias("end"), F.length(candidate["alphabet"]).alias("k"), F.length(candidate["value"]).cast("double").alias("n"), candidate["value"].alias("value"), F.filter(codes, lambda c: c >= 0).alias("codes"))), _battery)
    return F.get(with_codes, F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b.cast("double"))


def _simes(p: list[Column]) -> Column:
    ordered = F.sort_array(F.array(*p))
    return F.least(F.lit(1.0), *(F.get(ordered, F.lit(k)) * (len(p) / (k + 1)) for k in range(len(p))))


def _poisson_upto(mean: Column, most: Column) -> Column:
    """Poisson's probability of a number up to ``most``."""
    start = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("sum"))

    def step(state: Column, j: Column) -> Column:
        term = state["term"] * mean / j
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    terms = F.sequence(F.lit(1), F.least(F.greatest(most.cast("int"), F.lit(1)), F.lit(TERMS)))
    return F.when(most < 0, 0.0).when(most == 0, F.exp(-mean)).otherwise(F.least(F.lit(1.0), F.aggregate(terms, start, step, lambda state: state["sum"])))


def _ordinary(k: Column, which: int) -> Column:
    """A value for an alphabet's size."""
    by_size = model().by_size
    sizes = sorted(by_size)
    found = F.lit(by_size[sizes[-1]][which])
    for size in sizes[-2::-1]:
        found = F.when(k <= size, F.lit(by_size[size][which])).otherwise(found)
    return found


def _pairs(value: Column) -> Column:
    """Scores of the letters side by side within words."""
    scores, low = F.array(*map(F.lit, model().pairs)), F.lower(value)
    pair = lambda i: F.substr(value, i, F.lit(2))
    at = lambda i: F.ascii(F.substr(low, i, F.lit(1))) - 97
    found = F.filter(F.sequence(F.lit(1), F.length(value) - 1), lambda i: pair(i).rlike("^([a-z][a-z]|[A-Z][A-Za-z])$"))
    return F.transform(found, lambda i: F.get(scores, at(i) * 26 + at(i + 1)))


def _statistics(x: Column) -> Column:
    """struct<start, end, k, n, coincidences, high, changes, serial, pairs>; serial is null where all characters are one."""
    n, k, codes = x["n"], x["k"], x["codes"]
    squares = _sum(F.transform(F.sequence(F.lit(0), k - 1), lambda a: F.pow(F.size(F.filter(codes, lambda c: c == a)), F.lit(2))))
    high = _sum(F.transform(codes, lambda c: F.when(c * 2 >= k, 1).otherwise(0)))
    changes = _sum(F.transform(codes, lambda c, i: F.when((i > 0) & ((c * 2 >= k) != (F.get(codes, F.greatest(i - 1, F.lit(0))) * 2 >= k)), 1).otherwise(0)))
    mean = _sum(codes) / n
    variance = _sum(F.transform(codes, lambda c: (c - mean) * (c - mean)))
    together = _sum(F.transform(codes, lambda c, i: (c - mean) * (F.get(codes, ((i + 1) % F.size(codes)).cast("int")) - mean)))
    serial = F.when(variance > 0, together / F.greatest(variance, F.lit(1e-9)) + 1 / n)
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), k.alias("k"), n.alias("n"), ((squares - n) / 2).alias("coincidences"), high.alias("high"), changes.alias("changes"), serial.alias("serial"), _pairs(x["value"]).alias("pairs"))


def _random_p(x: Column) -> Column:
    """The chance that random draws from the alphabet look as odd."""
    n, k, found = x["n"], x["k"], x["coincidences"]
    expected = n * (n - 1) / 2 / k
    z = (found - expected) / F.sqrt(expected * (1 - 1 / k))
    fewer, more = _poisson_upto(expected, found), 1 - _poisson_upto(expected, found - 1)
    chi = F.when(expected > MANY, _tail(z)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * F.least(fewer, more))))
    both = 2.0 * x["high"] * (n - x["high"])
    spread = F.sqrt(F.greatest(F.lit(1e-9), both * (both - n) / (n * n * (n - 1))))
    runs = F.when(both > n, _tail((x["changes"] - both / n) / spread)).otherwise(0.0)
    return _simes([chi, runs, F.when(x["serial"].isNotNull(), _tail(x["serial"] * F.sqrt(n))).otherwise(0.0)])


def _ordinary_p(x: Column) -> Column:
    """The chance that an ordinary string looks as random: as few coincidences, as many changes, as little correlation, as strange neighbours."""
    n, k = x["n"], x["k"]
    share, varying, change, serial = (_ordinary(k, which) for which in range(4))
    pairs = n * (n - 1) / 2
    chi = _below((x["coincidences"] + 0.5 - pairs * share) / F.sqrt(pairs * share * (1 - share) + n * (n - 1) * (n - 2) * varying))
    runs = 1 - _below((x["changes"] - 0.5 - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change)))
    m, of = F.size(x["pairs"]), model()
    strange = F.when(m > 0, _below((_sum(x["pairs"]) - m * of.mean) / F.sqrt(F.greatest(m, F.lit(1)) * of.variance))).otherwise(1.0)
    return _simes([chi, runs, _below((F.coalesce(x["serial"], F.lit(1.0)) - serial) * F.sqrt(n)), strange])


def _battery(x: Column) -> Column:
    """struct<start, end, kind, bin>: the candidate's class of length, and its p-value, rounded up, as a step of the grid."""

    def judged(of: Column) -> Column:
        p = F.when(_random_p(of) < REFUTED, 1.0).otherwise(_ordinary_p(of))
        step = F.floor(-F.log10(F.greatest(F.lit(1e-30), p)) * BINS_PER_DECADE)
        return F.struct(of["start"].alias("start"), of["end"].alias("end"), F.least(F.lit(LAST_CLASS), F.floor(of["n"] / LENGTHS)).cast("int").alias("kind"), F.least(F.lit(BINS), F.greatest(F.lit(0), step)).cast("int").alias("bin"))

    return F.get(F.transform(F.array(_statistics(x)), judged), F.lit(0))


def _found(docs: DataFrame, text: Column) -> DataFrame:
    """docs with ``_s_base``, the spans <start, kind, end> of the patterns, and ``_s_candidates``, <start, end, kind, bin>."""
    docs = docs.withColumn("_s_text", F.coalesce(text.cast("string"), F.lit("")))
    text = F.col("_s_text")
    docs = docs.withColumns({"_s_0": _places(text, ASSIGN, 2), "_s_1": _places(text, ACCESS), "_s_2": _places(text, HEX), "_s_3": _places(text, CANDIDATE)})
    spans = [_spans(F.filter(f"_s_{kind}", lambda x: F.length(x["value"]) >= VALUE_CHARS), kind) for kind in range(3)]
    docs = docs.withColumn("_s_base", F.sort_array(F.concat(*spans)))
    apart = F.filter("_s_3", lambda x: ~F.exists("_s_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    named = F.filter(F.transform(apart, lambda x: x.withField("alphabet", _alphabet(x["value"]))), lambda x: x["alphabet"].isNotNull())
    docs = docs.withColumn("_s_named", named)
    return docs.withColumn("_s_candidates", F.transform("_s_named", _tested)).drop("_s_0", "_s_1", "_s_2", "_s_3", "_s_named", "_s_text")


def reported_from(candidates: DataFrame) -> list[int]:
    """For each class of length the bin from which candidates (kind, bin) are reported, BINS + 1 for none.

    The weighted Benjamini-Hochberg rule: the largest p-value over weight that is at most FDR times the share of candidates which
    reach it.
    """
    counts = candidates.groupBy("kind", "bin").count()  # (LAST_CLASS + 1) x (BINS + 1) rows at most
    raw = F.least(F.lit(HEAVIEST), F.greatest(F.lit(LIGHTEST), (F.col("kind") + 0.5) * LENGTHS / LENGTH_OF_WEIGHT_1))
    everything = Window.partitionBy()
    counts = counts.withColumn("raw", raw).withColumns({"all": F.sum("count").over(everything), "mean": F.sum(F.col("raw") * F.col("count")).over(everything)})
    counts = counts.withColumn("weighted", F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE) / (F.col("raw") * F.col("all") / F.col("mean")))
    reached = F.sum("count").over(Window.orderBy("weighted").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    counts = counts.withColumn("reached", reached)
    threshold = F.max(F.when(F.col("weighted") <= FDR * F.col("reached") / F.col("all"), F.col("weighted"))).over(everything)
    found = counts.withColumn("threshold", threshold).where(F.col("weighted") <= F.col("threshold")).groupBy("kind").agg(F.min("bin").alias("bin")).collect()  # a row for each class
    least = {row["kind"]: row["bin"] for row in found}
    return [least.get(kind, BINS + 1) for kind in range(LAST_CLASS + 1)]


def scan(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """``keep`` columns of docs, with ``_s_base`` and ``_s_spans``, the base spans and all spans, each <start, kind, end>."""
    found = written(_found(docs, text).select(*keep, "_s_base", "_s_candidates"), "secrets")
    limits = reported_from(found.where(F.size("_s_candidates") > 0).select(F.explode("_s_candidates").alias("c")).select("c.kind", "c.bin"))
    added = _spans(F.filter("_s_candidates", lambda x: x["bin"] >= F.get(F.array(*map(F.lit, limits)), x["kind"])), 3)
    return found.withColumn("_s_spans", F.sort_array(F.concat("_s_base", added))).drop("_s_candidates")


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document."""
    docs = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    counts = [_count(kind).alias(f"n_{KINDS[kind]}") for kind in range(3)]
    return scan(docs, F.col("text"), [F.col("doc_id")]).select("doc_id", *counts, F.sha2(_listed(F.col("_s_base")), 256).alias("base_sha256"), _listed(F.col("_s_spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", *, text_column: str = "text") -> DataFrame:
    """docs with every secret in the text replaced by a mark; overlapping spans by one. n_chars, if there is one, follows."""
    whole = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_whole")
    found = scan(docs.select(whole), F.col("_whole")[text_column], [F.col("_whole")])
    text, spans = F.col("_whole")[text_column], F.col("_s_spans")
    # Each span opens a new gap unless it begins before the farthest end so far.
    start = F.struct(F.lit(0).alias("end"), F.lit("").alias("text"))

    def step(state: Column, x: Column) -> Column:
        gap = F.when(x["start"] >= state["end"], F.concat(F.substr(text, state["end"] + 1, x["start"] - state["end"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(state["end"], x["end"]).alias("end"), F.concat(state["text"], gap).alias("text"))

    clean = F.when(F.size(spans) > 0, F.aggregate(spans, start, step, lambda state: F.concat(state["text"], F.substr(text, state["end"] + 1)))).otherwise(text)
    found = found.withColumn("_text", clean)
    column = {text_column: F.col("_text"), "n_chars": F.length("_text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return found.select(*(column.get(c, F.col("_whole")[c]).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
