"""JSON, vector and digest expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRIPLET = "struct<subject:string,subject_type:string,relation:string,object:string,object_type:string,mechanism:string,context:string>"


def _valid(text: Column) -> Column:
    return F.when(F.try_parse_json(text).isNotNull(), text)


def without_fence(text: Column) -> Column:
    """What a fenced block holds, or the trimmed text."""
    inside = F.regexp_extract(text, r"(?s)```[A-Za-z]*\s*(.*?)\s*```", 1)
    return F.when(inside != "", inside).otherwise(F.trim(text))


def robust_json(text: Column) -> Column:
    """The JSON text in an answer: in a tag, in a fence, as it is, or from the first { to the last }; null if there is none."""
    tagged = F.regexp_extract(text, r"(?s)<(answer|result|json|output)>\s*(.*?)\s*</\1>", 2)
    inner = F.when(tagged != "", tagged).otherwise(text)
    outer = F.regexp_extract(inner, r"(?s)\{.*\}", 0)
    return F.coalesce(_valid(without_fence(inner)), _valid(F.trim(inner)), _valid(F.nullif(outer, F.lit(""))))


def triplets(text: Column) -> Column:
    """Triplets of a payload, a bare list or under "triplets"; an empty array for anything else."""
    body = robust_json(text)
    listed = F.when(F.trim(without_fence(text)).startswith("["), F.from_json(without_fence(text), f"array<{TRIPLET}>"))
    named = F.from_json(body, f"struct<triplets:array<{TRIPLET}>>")["triplets"]
    return F.coalesce(listed, named, F.from_json(F.lit("[]"), f"array<{TRIPLET}>"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Unit vector; a zero vector stays. The length is bound, as an expression within a lambda is evaluated for each component."""
    unit = lambda size: F.transform(v, lambda x: x.cast("double") / F.when(size == 0, 1.0).otherwise(size))
    return F.get(F.transform(F.array(norm(v)), unit), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    sizes = norm(a) * norm(b)
    return F.when(sizes == 0, 0.0).otherwise(dot(a, b) / sizes)


def content_hash(data: Column) -> Column:
    return F.sha2(data, 256)


def page_points(box: Column, width: Column, height: Column) -> Column:
    """A relative bounding box (x0, y0, x1, y1 in 0 to 1) in the page's points."""
    return F.struct((box["x0"] * width).alias("x0"), (box["y0"] * height).alias("y0"), (box["x1"] * width).alias("x1"), (box["y1"] * height).alias("y1"))


def parameters(text: Column) -> Column:
    """array<struct<key, value>> of an answer that is a list of objects, fenced or not: those with a key and a value, as text; 0, false, empty texts and empty lists are none."""
    inner = without_fence(text)
    listed = F.from_json(F.when(F.trim(inner).startswith("["), inner), "array<map<string,string>>")
    pairs = F.transform(listed, lambda m: F.struct(F.trim(m["key"]).alias("key"), m["value"].alias("value")))
    kept = F.filter(pairs, lambda p: F.coalesce((p["key"] != "") & ~p["value"].isin("", "0", "0.0", "false", "[]", "{}"), F.lit(False)))
    return F.coalesce(kept, F.from_json(F.lit("[]"), "array<struct<key:string,value:string>>"))


def encoded(data: Column) -> Column:
    """Binary data as base64 in one line."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


def decoded(text: Column) -> Column:
    """Binary data of base64, null where it is none; a data URL's head is left out."""
    return F.try_to_binary(F.regexp_replace(text, r"^data:[^,]*,", ""), F.lit("base64"))
