"""Quality rules: repetition and length, then divergence from what text of a language looks like.

Each document's histograms of character classes and of common words are compared with language references by
Jensen-Shannon distance (the square root of the divergence in bits, 0 to 1). The nearest language counts, whatever the
language column says; long text of a language without a reference is far from all of them, and goes. Both distances are only looked at above a minimum length, and their allowances shrink with the
number of words, as sampling alone keeps a short text apart from any reference.

All of it is DataFrame expressions over one row: no shuffle, no Python. Null and empty texts have no words and fail the
base rule; so does any text below MIN_WORDS words. Rows keep their multiplicity; other columns are ignored (filter keeps
them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.llm.common import SPACES, table

MIN_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
#: Guards: below so many characters or words a distance says nothing.
MIN_CHARS, MIN_COMMON = 300, 60
#: Farthest distances, each as (limit, allowance): the allowance is divided by the square root of the number of words.
CHAR_LIMIT, WORD_LIMIT = (0.12, 0.65), (0.19, 1.4)

#: Share of each character class (a-z, other lower-case or caseless letters, upper case, digits, white
#: space, sentence punctuation, anything else) in prose.
CLASS_SHARES = {
    "en": [0.800, 0.001, 0.024, 0.004, 0.150, 0.020, 0.001],
    "de": [0.765, 0.025, 0.045, 0.004, 0.140, 0.020, 0.001],
    "fr": [0.750, 0.045, 0.022, 0.004, 0.156, 0.022, 0.001],
    "es": [0.765, 0.035, 0.022, 0.004, 0.153, 0.020, 0.001],
}
#: The most common words of each language and their shares of running words, in per mille. English: counts of the
#: Brown corpus (Francis and Kucera); Spanish: of the reference corpus CREA of the Real Academia; German and French: rounded
#: shares as word lists of newspapers and books give them (Wortschatz Leipzig, Lexique), good to about a quarter of each.
COMMON_WORDS = {
    "en": {
        "the": 69.0, "of": 35.9, "and": 28.4, "to": 25.8, "a": 22.9, "in": 21.0, "that": 10.4, "is": 10.0, "was": 9.7, "he": 9.4, "for": 9.4, "it": 8.6, "with": 7.2,
        "as": 7.1, "his": 6.9, "on": 6.6, "be": 6.3, "at": 5.3, "by": 5.2, "this": 5.1, "had": 5.1, "not": 4.5, "are": 4.3, "but": 4.3, "from": 4.3,
    },
    "de": {
        "der": 32.0, "die": 32.0, "und": 26.0, "in": 18.0, "den": 12.0, "von": 10.0, "zu": 10.0, "das": 10.0, "mit": 9.0, "sich": 8.0, "des": 8.0, "auf": 8.0, "für": 7.5,
        "ist": 7.5, "im": 7.5, "dem": 7.0, "nicht": 7.0, "ein": 7.0, "eine": 6.0, "als": 6.0, "auch": 5.0, "es": 5.0, "an": 5.0, "er": 4.5, "so": 4.0,
    },
    "fr": {
        "de": 45.0, "la": 27.0, "le": 22.0, "et": 21.0, "les": 19.0, "des": 16.0, "en": 14.0, "un": 12.0, "du": 12.0, "une": 11.0, "est": 10.0, "que": 9.0, "pour": 9.0,
        "qui": 8.0, "dans": 8.0, "par": 7.0, "plus": 6.0, "au": 6.0, "sur": 6.0, "pas": 6.0, "ne": 6.0, "il": 8.0, "ce": 5.0, "se": 5.0, "avec": 5.0,
    },
    "es": {
        "de": 65.5, "la": 41.1, "que": 30.7, "el": 29.9, "en": 27.7, "y": 27.4, "a": 21.4, "los": 17.2, "se": 13.3, "del": 12.2, "las": 11.1, "un": 10.9, "por": 10.2,
        "con": 9.7, "no": 9.6, "una": 8.8, "su": 7.2, "para": 7.0, "es": 6.7, "al": 6.2, "lo": 5.7, "como": 5.1, "más": 4.3, "o": 3.6, "pero": 3.0,
    },
}


def word_shares(language: str) -> list[float]:
    """Reference histogram: each common word, then all other words."""
    shares = [share / 1000 for share in COMMON_WORDS[language].values()]
    return [*shares, 1 - sum(shares)]


def _only(text: Column, kept: str) -> Column:
    """Number of code points of a class, given by the pattern of all others."""
    return F.length(F.regexp_replace(text, kept, ""))


def _distance(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of a histogram to a fixed one."""

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    halves = F.zip_with(shares, F.array(*map(F.lit, reference)), lambda p, q: (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(halves, F.lit(0.0), lambda a, b: a + b)))


def _least(values: dict[str, Column]) -> Column:
    return F.least(*values.values())


def _paired(hashes: Column, apart: int) -> Column:
    """A hash of each value and the one so many places on; from hashes of words, by doubling, to hashes of windows."""
    n = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(apart + 1), n), lambda a, b: F.xxhash64(a, b))


def base_columns(docs: DataFrame, text: Column) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; names that begin with ``_q_`` are left over."""
    docs = docs.withColumn("_q_text", F.coalesce(text.cast("string"), F.lit("")))
    text = F.col("_q_text")
    docs = docs.withColumn("_q_words", F.array_remove(F.split(text, SPACES), ""))
    docs = docs.withColumn("_q_lines", F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    # A hash of each word, then one of each window; equal windows are looked for among these 64-bit values.
    docs = docs.withColumn("_q_hashes", F.transform("_q_words", lambda word: F.xxhash64(word)))
    # A column for each doubling: an expression that holds another several times would evaluate it as often.
    docs = docs.withColumn("_q_pairs", _paired(F.col("_q_hashes"), 1))
    docs = docs.withColumn("_q_fours", _paired(F.col("_q_pairs"), 2))
    docs = docs.withColumn("_q_windows", _paired(F.col("_q_fours"), 4))
    windows = F.col("_q_windows")
    docs = docs.drop("_q_hashes", "_q_pairs", "_q_fours").withColumn("_q_repeats", F.size(F.array_distinct(windows)) < F.size(windows))
    docs = docs.withColumn("_q_sorted", F.when(F.col("_q_repeats"), F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    by_hash = F.col("_q_sorted")
    docs = docs.withColumn(
        "_q_places",
        F.when(F.col("_q_repeats"), F.sort_array(F.transform(F.filter(by_hash, lambda x, k: (F.get(by_hash, k + 1)["h"] == x["h"]) | ((k > 0) & (F.get(by_hash, k - 1)["h"] == x["h"]))), lambda x: x["i"]))),
    )
    places = F.col("_q_places")
    covered = F.aggregate(F.transform(places, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - at, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    # Classes of characters are counted in what is left without the most frequent one.
    docs = docs.withColumn("_q_rest", F.regexp_replace(text, "[a-z]+", ""))
    rest = F.col("_q_rest")
    docs = docs.withColumns({
        "n_words": F.size("_q_words").cast("long"),
        "word_chars": (F.length(text) - F.length(rest) + F.length(F.regexp_replace(rest, SPACES, ""))).cast("long"),
        "n_symbols": _only(rest, r"[^#*$%&|<>]+").cast("long"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "n_repeat_words": F.when(F.col("_q_repeats"), covered).otherwise(0).cast("long"),
    }).drop("_q_words", "_q_lines", "_q_windows", "_q_sorted", "_q_places", "_q_repeats")
    return docs.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def divergence_columns(docs: DataFrame) -> DataFrame:
    """Adds char_distance and word_distance to the nearest reference, and n_letters_words; needs base_columns."""
    text = F.col("_q_text")
    known = sorted({word for words in COMMON_WORDS.values() for word in words})
    docs = docs.withColumn("_q_tokens", F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), ""))
    docs = docs.withColumns({"_q_n": F.size("_q_tokens"), "_q_common": F.sort_array(F.filter("_q_tokens", lambda w: w.isin(known)))}).drop("_q_tokens")
    # Of the sorted words each one's first place, and so how often it is there.
    docs = docs.withColumn("_q_seen", F.array_distinct("_q_common"))
    docs = docs.withColumn("_q_first", F.transform("_q_seen", lambda w: F.array_position(F.col("_q_common"), w)))
    first, n = F.col("_q_first"), F.greatest(F.col("_q_n"), F.lit(1))
    rest = F.col("_q_rest")
    lower = F.length(text) - F.length(rest)
    docs = docs.withColumns({
        "_q_lower": lower, "_q_upper": _only(rest, r"[^\p{Lu}]+"), "_q_letters": lower + _only(rest, r"[^\p{L}]+"),
        "_q_digits": _only(rest, r"[^\p{Nd}]+"), "_q_points": _only(rest, r"""[^.,;:!?'"()-]+"""), "_q_all": F.length(text),
        "_q_counts": F.map_from_arrays("_q_seen", F.transform(first, lambda at, k: F.coalesce(F.get(first, k + 1), F.size("_q_common") + 1) - at)),
    })
    total = F.greatest(F.col("_q_all"), F.lit(1))
    classes = ["_q_lower", "_q_other", "_q_upper", "_q_digits", "_q_white", "_q_points"]
    docs = docs.withColumns({"_q_other": F.col("_q_letters") - F.col("_q_lower") - F.col("_q_upper"), "_q_white": F.col("_q_all") - F.col("word_chars")})
    shares = [F.col(c) / total for c in classes]
    others = F.col("_q_all") - F.col("_q_letters") - F.col("_q_digits") - F.col("_q_white") - F.col("_q_points")
    docs = docs.withColumn("_q_classes", F.array(*shares, F.greatest(others, F.lit(0)) / total))
    for language, words in COMMON_WORDS.items():
        counts = [F.coalesce(F.col("_q_counts")[w], F.lit(0)) for w in words]
        docs = docs.withColumn(f"_q_words_{language}", F.array(*(c / n for c in counts), (n - sum(counts[1:], counts[0])) / n))
    docs = docs.withColumns({
        "char_distance": _least({k: _distance(F.col("_q_classes"), v) for k, v in CLASS_SHARES.items()}),
        "word_distance": _least({k: _distance(F.col(f"_q_words_{k}"), word_shares(k)) for k in COMMON_WORDS}),
    })
    return docs


def judged(docs: DataFrame, text: Column) -> DataFrame:
    """docs with the measures, base_failed and kept."""
    columns = docs.columns
    docs = divergence_columns(base_columns(docs, text))
    far = (F.col("_q_all") >= MIN_CHARS) & (F.col("char_distance") > CHAR_LIMIT[0] + CHAR_LIMIT[1] / F.sqrt(F.greatest(F.col("n_words"), F.lit(1))))
    strange = (F.col("_q_n") >= MIN_COMMON) & (F.col("word_distance") > WORD_LIMIT[0] + WORD_LIMIT[1] / F.sqrt(F.greatest(F.col("_q_n"), F.lit(1))))
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance"]
    docs = docs.withColumn("kept", ~F.col("base_failed") & ~far & ~strange)
    # Through a generator: the optimizer would else push a later filter below the measures, and write them out once more for each
    # use of one in another, which has no end.
    return docs.select(F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in [*columns, *measures, "kept"])))))


def keep_good(docs: DataFrame, *, text_column: str = "text") -> DataFrame:
    """The documents that the rules keep, with their own columns (a column named like a measure does no harm)."""
    whole = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_whole")
    found = judged(docs.select(whole), F.col("_whole")[text_column])
    return found.where("kept").select("_whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text"))
    return judged(docs, F.col("text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    def listed(values: list) -> str:
        return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else repr(float(v)) for v in values) + "]"

    def distance(shares: str, reference: list[float]) -> str:
        part = "CASE WHEN {0} > 0 THEN {0} * log2({0} / ((p[1] + p[2]) / 2)) ELSE 0.0 END"
        halves = f"list_transform(list_zip({shares}, CAST({listed(reference)} AS DOUBLE[])), lambda p: ({part.format('p[1]')} + {part.format('p[2]')}) / 2)"
        return f"sqrt(greatest(0.0, list_sum({halves})))"

    known = listed(sorted({word for words in COMMON_WORDS.values() for word in words}))
    counts = ", ".join(
        f"list_append(list_transform({listed(words)}, lambda w: len(list_filter(common, lambda x: x = w)) / n), (n - len(list_filter(common, lambda x: list_contains({listed(words)}, x)))) / n) AS words_{language}"
        for language, words in COMMON_WORDS.items()
    )
    char = ", ".join(distance("classes", v) for v in CLASS_SHARES.values())
    word = ", ".join(distance(f"words_{k}", word_shares(k)) for k in COMMON_WORDS)
    only = "length(regexp_replace(t, '{0}', '', 'g'))".format
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         list_filter(regexp_split_to_array(lower(t), '[^\p{{L}}]+'), lambda x: x <> '') AS tokens FROM texts),
grams AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS gram, unnest(range(1, len(w) - {WINDOW - 2})) AS pos FROM words),
repeated AS (SELECT doc_id, pos FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
steps AS (SELECT doc_id, least({WINDOW}, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) - pos, {WINDOW})) AS step FROM repeated),
covered AS (SELECT doc_id, CAST(sum(step) AS BIGINT) AS covered FROM steps GROUP BY 1),
base AS (
  SELECT doc_id, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {only("[^#*$%&|<>]+")} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(covered, 0) AS n_repeat_words, greatest(1, len(tokens)) AS n, len(tokens) AS n_tokens, list_filter(tokens, lambda x: list_contains({known}, x)) AS common FROM words LEFT JOIN covered USING (doc_id)),
parts AS (
  SELECT *, length(t) AS everything, greatest(1, length(t)) AS total, {only("[^a-z]+")} AS lower_case, {only(r"[^\p{Lu}]+")} AS upper_case, {only(r"[^\p{L}]+")} AS letters, {only(r"[^\p{Nd}]+")} AS digits,
         {only("""[^.,;:!?''"()-]+""")} AS points, length(t) - word_chars AS white FROM base),
shares AS (
  SELECT *, [lower_case / total, (letters - lower_case - upper_case) / total, upper_case / total, digits / total, white / total, points / total, greatest(everything - letters - digits - white - points, 0) / total] AS classes,
         {counts} FROM parts),
distances AS (SELECT *, least({char}) AS char_distance, least({word}) AS word_distance, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM shares)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (everything >= {MIN_CHARS} AND char_distance > {CHAR_LIMIT[0]} + {CHAR_LIMIT[1]} / sqrt(greatest(1, n_words)))
       AND NOT (n_tokens >= {MIN_COMMON} AND word_distance > {WORD_LIMIT[0]} + {WORD_LIMIT[1]} / sqrt(n)) AS kept
FROM distances
"""


SQL = _sql()
