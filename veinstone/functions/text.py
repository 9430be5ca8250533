"""Text expressions: normalisation, tokens, predicates."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from veinstone.functions import lexicons as L

#: Full-width forms U+FF01 to U+FF5E and the ideographic space, and what they stand for.
FULL_WIDTH = "\u3000" + "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF_WIDTH = " " + "".join(chr(c - 65248) for c in range(0xFF01, 0xFF5F))
#: Latin and number runs, and single CJK characters with their right neighbour.
TOKEN = r"[0-9a-z\u00DF-\u00F6\u00F8-\u024F]+|[\u4e00-\u9fff]"


def any_of(text: Column, words: Iterable[str]) -> Column:
    """Whether any of the words is a substring. The text is bound, so it is made once for all words."""
    held = lambda t: reduce(or_, (F.contains(t, F.lit(word)) for word in words), F.lit(False))
    return F.coalesce(F.exists(F.array(text), held), F.lit(False))


def trim_all(text: Column) -> Column:
    """Without white space, of any kind, at both ends."""
    return F.regexp_replace(text, r"(?Us)^\s*+(.*\S)?\s*$", "$1")


def not_blank(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def half_width(text: Column) -> Column:
    return F.translate(text, FULL_WIDTH, HALF_WIDTH)


def simplified(text: Column, traditional: str = "", simple: str = "") -> Column:
    """Characters of one script replaced by those of another, one for one; identity without a table."""
    return F.translate(text, traditional, simple) if traditional else text


_LATIN_RUN = r"[0-9a-z\u00DF-\u00F6\u00F8-\u024F]+"


def tokens(text: Column) -> Column:
    """Lower-case search tokens: runs of Latin letters and digits, and pairs of neighbouring CJK characters (or a single one)."""
    text = F.coalesce(text, F.lit(""))
    clean = F.lower(half_width(text))
    runs = F.regexp_extract_all(clean, F.lit(rf"{_LATIN_RUN}|[\u4e00-\u9fff]+"), F.lit(0))

    def cut(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda k: F.substr(run, k, F.lit(2)))
        return F.when(run.rlike("^[\u4e00-\u9fff]"), pairs).otherwise(F.array(run))

    # Most texts have neither full-width nor CJK characters, and need none of the steps for them.
    return F.when(text.rlike("[\u3000\u4e00-\u9fff\uff01-\uff5e]"), F.flatten(F.transform(runs, cut))).otherwise(F.regexp_extract_all(F.lower(text), F.lit(_LATIN_RUN), F.lit(0)))


def fine_tokens(token: Column) -> Column:
    """Parts of a mixed token: letter runs, digit runs; whole if short, or of one kind."""
    parts = F.regexp_extract_all(token, F.lit(r"[0-9]+|[a-zA-Z]+|[\u4e00-\u9fff]+"), F.lit(0))
    whole = (F.length(token) <= 2) | token.rlike(r"^(?U:\p{L}+)$") | token.rlike(r"^[0-9]+$") | (F.size(parts) <= 1)
    return F.when(whole, F.array(token)).otherwise(parts)


def without_signs(text: Column) -> Column:
    """Runs of signs, spaces and tabs as one space."""
    return F.trim(F.regexp_replace(text, L.SPECIAL_SIGNS, " "))


def segments(text: Column) -> Column:
    """Words of a text; neighbours that both end in a Latin letter are one segment."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    latin = lambda w: w.rlike("[a-zA-Z]$")

    def step(done: Column, word: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), word)))
        return F.when(F.coalesce(latin(last) & latin(word), F.lit(False)), joined).otherwise(F.array_append(done, word))

    return F.aggregate(words, F.array().cast("array<string>"), step)


def pretokens(text: Column, stop_words: Iterable[str] = (), numbers: bool = False, stops: bool = True) -> Column:
    """Tokens of a text without punctuation and spaces, so that words run together; stop words and, unless wanted, tokens that begin with a single digit as a whole are left out."""
    found = tokens(F.regexp_replace(text, L.PRETOKEN_SIGNS, ""))
    if stops and (words := list(stop_words)):
        found = F.filter(found, lambda t: ~t.isin(words))
    return found if numbers else F.filter(found, lambda t: ~t.rlike("^[0-9]$"))


def merged_tokens(found: Column, stop_words: Iterable[str] = ()) -> Column:
    """Runs of short tokens (one character, or one or two of a-z and digits) joined by spaces: up to four together, longer runs by pairs.

    A short first token before a longer one that isn't Latin goes with it.
    """
    words = list(stop_words)
    short = lambda t: (F.length(t) == 1) | t.rlike("^[0-9a-z]{1,2}$")
    n = F.size(found)
    first, second = F.get(found, F.lit(0)), F.get(found, F.lit(1))
    headed = F.coalesce((n > 1) & short(first) & (F.length(second) > 1) & ~second.rlike("^[0-9a-zA-Z]"), F.lit(False))
    runs = lambda t: short(t) & ~t.isin(words) if words else short(t)
    # Each token after the head is marked as one of a run; a run's tokens are gathered, and closed by any other.
    body = F.when(headed, F.slice(found, F.lit(3), F.greatest(n - 2, F.lit(0)))).otherwise(found)
    empty = F.array().cast("array<string>")
    start = F.struct(F.when(headed, F.array(F.concat_ws(" ", first, second))).otherwise(empty).alias("done"), empty.alias("run"))

    def closed(state: Column) -> Column:
        """done with the run: while it has five tokens or more, pairs go first."""
        run, size = state["run"], F.size(state["run"])
        pairs = F.when(size >= 5, F.ceil((size - 4) / 2)).otherwise(0).cast("int")
        paired = F.when(pairs > 0, F.transform(F.sequence(F.lit(0), F.greatest(pairs - 1, F.lit(0))), lambda k: F.concat_ws(" ", F.get(run, 2 * k), F.get(run, 2 * k + 1)))).otherwise(empty)
        rest = F.slice(run, 2 * pairs + 1, F.greatest(size - 2 * pairs, F.lit(0)))
        return F.concat(state["done"], paired, F.when(F.size(rest) > 0, F.array(F.concat_ws(" ", rest))).otherwise(empty))

    def step(state: Column, token: Column) -> Column:
        longer = F.struct(state["done"].alias("done"), F.array_append(state["run"], token).alias("run"))
        other = F.struct(F.array_append(closed(state), token).alias("done"), empty.alias("run"))
        return F.when(runs(token), longer).otherwise(other)

    return F.filter(F.aggregate(F.filter(body, lambda t: t != ""), start, step, closed), lambda t: t != "")


def is_chinese(char: Column) -> Column:
    return char.rlike(r"^[\u4e00-\u9fa5]")


def is_number(text: Column) -> Column:
    """A decimal number, with digits grouped by single underscores, or a name of infinity or not-a-number."""
    digits = r"[0-9]+(_[0-9]+)*"
    return trim_all(text).rlike(rf"(?i)^[+-]?(({digits}\.?({digits})?|\.{digits})(e[+-]?{digits})?|inf|infinity|nan)$")


def is_alphabetic(text: Column) -> Column:
    return text.rlike("^[a-zA-Z]+$")


def is_ascii(text: Column) -> Column:
    return text.rlike(r"^[\x00-\x7F]*$")


def cjk_ratio(text: Column) -> Column:
    """Share of CJK among the characters that are neither space nor line end; 0 if there are none."""
    dense = F.length(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))
    return F.coalesce(F.length(F.regexp_replace(text, r"[^\u4e00-\u9fff]+", "")) / F.nullif(dense, F.lit(0)), F.lit(0.0))


def has_long_ascii_run(text: Column) -> Column:
    return text.rlike("[a-zA-Z]{50,}")


def entity_id(name: Column) -> Column:
    return F.replace(F.lower(trim_all(name)), F.lit(" "), F.lit("_"))


def head(text: Column, size: int, note: str) -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit(note))).otherwise(text)


def tail(text: Column, size: int, note: str) -> Column:
    return F.when(F.length(text) > size, F.concat(F.lit(note), F.right(text, F.lit(size)))).otherwise(text)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 2).cast("long")


def file_safe(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)[^\w\-]", "_")


def has_no_result(text: Column) -> Column:
    return ~not_blank(text) | any_of(F.lower(text), L.NO_RESULT_MARKERS)


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, L.ILLEGAL_CONTROLS, " ")


def simple_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(L.SIMPLE_TOKEN), F.lit(0))


def _many(n: int) -> str:
    """A pattern of texts with n simple tokens or more, that stops behind the n-th."""
    return "^" + rf"[^{L.SIMPLE_CLASS}]*+(?:{'|'.join(part + '+' for part in L.SIMPLE_TOKEN.split('|'))})" * n


def block_type(text: Column) -> Column:
    kind = F.when(text.rlike(L.BLOCK_TYPES[0][0]), L.BLOCK_TYPES[0][1])
    for pattern, name in L.BLOCK_TYPES[1:]:
        kind = kind.when(text.rlike(pattern), name)
    special = text.rlike(f"^(?:{'|'.join(pattern for pattern, _ in L.BLOCK_TYPES)})")  # most texts are of none
    return F.when(special, kind).when(text.rlike(_many(12)), "Lx").when(text.rlike(_many(4)), "Tx").otherwise("Ot")


def is_caption(line: Column) -> Column:
    return F.coalesce(trim_all(line).rlike(L.CAPTION), F.lit(False))


def is_agent_request(message: Column) -> Column:
    return any_of(F.lower(message), L.AGENT_WORDS)


def is_chitchat(message: Column) -> Column:
    return (F.length(message) < 15) & any_of(F.lower(message), L.CHITCHAT_WORDS)


def without_instructions(items: Column, default: str) -> Column:
    """Array elements without instruction cues; the default alone if none is left."""
    kept = F.filter(items, lambda item: ~any_of(F.lower(item), L.INSTRUCTION_CUES))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(default)))


def keeps_figure(caption: Column, alt_text: Column) -> Column:
    return F.coalesce(caption != "", F.lit(False)) | any_of(F.lower(alt_text), L.FIGURE_WORDS)


def name_parts(name: Column) -> Column:
    """Lower-case parts of a snake-case or camel-case name."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), r"[^A-Za-z0-9]+", "_")
    return F.filter(F.split(F.lower(spaced), "_"), lambda part: part != "")


def char_jaccard(a: Column, b: Column) -> Column:
    """Overlap of the sets of characters; 0 if both are empty."""
    left, right = (F.array_remove(F.array_distinct(F.split(x, "")), "") for x in (a, b))
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(0.0)


def grams(text: Column, n: int = 2) -> Column:
    """The set of character n-grams."""
    count = F.length(text) - (n - 1)
    return F.when(count > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda k: F.substr(text, k, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def same_entity(a: Column, b: Column) -> Column:
    """Whether two names may denote one entity: no digit among the 2-grams of one alone; then edit distance or common characters."""
    x, y = grams(a), grams(b)
    apart = F.array_union(F.array_except(x, y), F.array_except(y, x))
    ascii_rule = F.levenshtein(a, b) <= F.floor(F.least(F.length(a), F.length(b)) / 2)
    p, q = (F.array_remove(F.array_distinct(F.split(s, "")), "") for s in (a, b))
    most, common = F.greatest(F.size(p), F.size(q)), F.size(F.array_intersect(p, q))
    sets = F.when(most < 4, common > 1).otherwise(common / F.greatest(most, F.lit(1)) >= 0.8)
    return F.when(F.exists(apart, lambda g: g.rlike("[0-9]")), False).when(is_ascii(a) & is_ascii(b), ascii_rule).otherwise(sets)


def citation(source: Column, page: Column, kind: Column) -> Column:
    """[来源: source, p.page, [kind]] of what is known."""
    parts = F.concat_ws(", ", F.when(source != "", source), F.when(page > 0, F.concat(F.lit("p."), page.cast("string"))), F.when(kind != "text", F.concat(F.lit("["), kind, F.lit("]"))))
    return F.concat(F.lit("[来源: "), F.when(parts != "", parts).otherwise("未知"), F.lit("]"))


def has_citation(text: Column) -> Column:
    return F.coalesce(text.rlike(L.ANY_CITATION), F.lit(False))


def is_useful(text: Column) -> Column:
    return not_blank(text) & ~F.contains(text, F.lit(L.NO_CONTENT))


def as_boolean(text: Column) -> Column:
    """yes, no or null."""
    word = F.lower(F.trim(text))
    return F.when(word.rlike(L.TRUE_WORDS), "yes").when(word.rlike(L.FALSE_WORDS), "no")


def as_datetime(text: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss of the first format that fits, or null."""
    return F.date_format(F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)) for f in L.DATE_FORMATS)), "yyyy-MM-dd HH:mm:ss")
