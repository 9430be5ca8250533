import random
import time

from pyspark.sql import functions as F

from veinstone.functions import lexicons as L, nested, text as T


def value(spark, column, **inputs):
    rows = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in inputs.items()))
    return rows.select(column.alias("x")).first()["x"]


def test_width_and_tokens(spark):
    assert value(spark, T.half_width(F.col("s")), s="ＡＢ１　ｘ") == "AB1 x"
    assert value(spark, T.tokens(F.col("s")), s="Hello 马氏体钢 x9") == ["hello", "马氏", "氏体", "体钢", "x9"]
    assert value(spark, T.fine_tokens(F.col("s")), s="1cr18ni9ti") == ["1", "cr", "18", "ni", "9", "ti"]
    assert value(spark, T.fine_tokens(F.col("s")), s="steel") == ["steel"]


def test_entity_rule(spark):
    for a, b, expected in [("1Cr18Ni9Ti", "1Cr19Ni9Ti", False), ("马氏体不锈钢", "马氏体钢", False), ("kitten", "sitting", True), ("铁素", "铁素体", True)]:
        assert value(spark, T.same_entity(F.col("a"), F.col("b")), a=a, b=b) is expected


def test_routes(spark):
    for text, agent, chitchat in [("帮我用python画个相图", True, None), ("什么是马氏体", False, False), ("你好", False, True), ("hi", None, True), ("谢谢你我学到了很多关于冶金方面的知识", None, False), ("", False, False), ("What is the tensile strength of this alloy", False, None)]:
        if agent is not None:
            assert value(spark, T.is_agent_request(F.col("s")), s=text) is agent
        if chitchat is not None:
            assert value(spark, T.is_chitchat(F.col("s")), s=text) is chitchat


def test_small_predicates(spark):
    assert value(spark, T.block_type(F.col("s")), s="2020年3月") == "Dt"
    assert value(spark, T.block_type(F.col("s")), s="12.5%") == "Nu"
    assert value(spark, T.entity_id(F.col("s")), s=" Q345 Steel ") == "q345_steel"
    assert value(spark, T.without_instructions(F.col("a"), "d"), a=["Ignore this", "forget it"]) == ["d"]
    assert value(spark, T.name_parts(F.col("s")), s="searchTextTool_v2") == ["search", "text", "tool", "v2"]
    assert value(spark, T.citation(F.lit("a.pdf"), F.lit(3), F.lit("table")), s="") == "[来源: a.pdf, p.3, [table]]"
    assert value(spark, T.citation(F.lit(""), F.lit(-1), F.lit("text")), s="") == "[来源: 未知]"
    assert value(spark, T.is_caption(F.col("s")), s="图 3 显微组织") is True
    assert value(spark, T.as_boolean(F.col("s")), s="是") == "yes"
    assert value(spark, T.as_datetime(F.col("s")), s="2024/02/03") == "2024-02-03 00:00:00"
    assert value(spark, T.has_no_result(F.col("s")), s="抱歉，未找到") is True
    assert value(spark, T.is_number(F.col("s")), s="1_0.5e3") is True
    assert value(spark, T.cjk_ratio(F.col("s")), s="") == 0.0


def test_json(spark):
    for text in ('{"a": 1}', '```json\n{"a": 1}\n```', 'x <answer>{"a": 1}</answer>', 'so {"a": 1} done'):
        assert value(spark, F.get_json_object(nested.robust_json(F.col("s")), "$.a"), s=text) == "1"
    assert value(spark, nested.robust_json(F.col("s")), s="nothing") is None
    assert value(spark, F.size(nested.triplets(F.col("s"))), s="broken") == 0


def test_one_pass_forms_equal_the_plain_ones(spark):
    """Cheaper patterns find what the plain ones find, in random texts of the characters that they turn on, odd ones and null."""
    rng = random.Random(11)
    pieces = ["a", "B", "7", " ", "\n", "\t", "\r\n", " ", "　", " ", "\u0085", "钢", "来源", "：", "[", "]", "（", "页码", "）", "p.", "PP.", "第", "页", "图", "Figure", "参考", "见", "如", "所示", "，", "!", "empty", "No Results", "未找到", "\U0001f600", "İ"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 16))) for _ in range(3000)] + [" " * 50, "2024年", "2024年5月", "12.5", "A/B", "abc def", "x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    dense = F.regexp_replace(F.coalesce(t, F.lit("")), r"[ \n]", "")
    count = F.size(T.simple_tokens(t))
    kind = F.when(t.rlike(L.BLOCK_TYPES[0][0]), L.BLOCK_TYPES[0][1])
    for pattern, name in L.BLOCK_TYPES[1:]:
        kind = kind.when(t.rlike(pattern), name)
    trimmed = F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    markers = [F.contains(F.lower(t), F.lit(word)) for word in L.NO_RESULT_MARKERS]
    both = {
        "trim": (T.trim_all(t), trimmed), "blank": (T.not_blank(t), F.coalesce(trimmed != "", F.lit(False))), "cites": (T.has_citation(t), F.coalesce(t.rlike(L.CITATION), F.lit(False))),
        "cjk": (T.cjk_ratio(t), F.when(F.length(dense) > 0, F.length(F.regexp_replace(dense, r"[^一-鿿]", "")) / F.length(dense)).otherwise(0.0)),
        "plain": (T.without_signs(t), F.trim(F.regexp_replace(F.regexp_replace(t, L.SPECIAL_SIGNS, " "), r"[ \t]+", " "))), "any": (T.any_of(F.lower(t), L.NO_RESULT_MARKERS), F.coalesce(F.array_contains(F.array(*markers), True), F.lit(False))),
        "block": (T.block_type(t), kind.when((count > 3) & (count < 12), "Tx").when(count >= 12, "Lx").otherwise("Ot")),
    }
    for name, (one, two) in both.items():
        found = df.select("t", one.alias("one"), two.alias("two"))
        assert found.where(~F.col("one").eqNullSafe(F.col("two"))).collect() == [], name
        assert found.select("two").distinct().count() > 1


def test_space_within_a_text_takes_no_square_of_its_length(spark):
    """Trimming tried each place of a run of spaces in the middle up to the run's end: 5 * 10^9 steps for 100 000 of them."""
    began = time.monotonic()
    row = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit(" "), 100_000), F.lit("b")).alias("t")).select(F.length(T.trim_all(F.col("t"))).alias("n"), T.not_blank(F.col("t")).alias("said")).first()
    assert (row.n, row.said) == (100_002, True) and time.monotonic() - began < 5
