"""Text and value functions, held against plain Python."""

import hashlib
import json
import re

from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.functions import values as vx


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["out"] for r in df.select("i", f("v").alias("out")).orderBy("i").collect()]


TEXTS = ["", None, "  a \t b\n", "第一章 绪论……12", "题目（黑体 三号）：××大学", "目录 (see A) （居中）", "摘　要", "a.b,c；d", "___x__", "图1-1　(a) 标题", "Times New Roman (12pt)"]


def test_normal_forms(spark):
    assert apply(spark, tx.squeezed, TEXTS) == [re.sub(r"\s+", " ", t or "").strip() for t in TEXTS]
    assert apply(spark, tx.folded, TEXTS) == [None if t is None else re.sub(r"\s+", "", t).lower() for t in TEXTS]
    bare = ["", None, "  a \t b\n", "第一章 绪论……12", "题目：××大学", "目录 (see A) ", "摘　要", "a.b,c；d", "___x__", "图1-1　(a) 标题", "Times New Roman "]
    assert apply(spark, tx.without_format_notes, TEXTS) == bare
    keys = ["", "", "ab", "第一章绪论12", "题目大学", "目录seea", "摘要", "abcd", "", "图1-1a标题", "timesnewroman"]
    assert apply(spark, tx.match_key, TEXTS) == keys


def test_tokens_and_parts(spark):
    assert apply(spark, tx.match_tokens, ["封面：标题；学校名称，学校名称 a bc/de", None]) == [["封面", "学校名称", "bc", "de"], []]
    assert apply(spark, tx.trailing_token, ["ab cd ", "", " "]) == ["cd", None, None]
    assert apply(spark, tx.leader_run, ["绪论……12", "x ... 3 ", "x 3"]) == ["……", "...", None]
    assert apply(spark, tx.bracketed, ["a（b）c(d)()", ""]) == [["b", "d", ""], []]
    assert apply(spark, tx.safe_identifier, [" a b/c ", "中", "__x-1__"]) == ["a_b_c", "unnamed", "x-1"]
    assert apply(spark, lambda c: tx.preview(c, 8), ["abcdefgh", "abcdefghi"]) == ["abcdefgh", "abcde..."]
    assert apply(spark, tx.stable_anchors, ["abcd ef 中文文字 abcd ghijk1"]) == [["abcd", "中文文字", "ghijk"]]
    assert apply(spark, lambda c: tx.field_value(c, "a+b"), ["x a+b= 1；y", "none"]) == ["1", ""]
    assert apply(spark, tx.is_toc_entry, ["a\tb", "x……12", "x……", None]) == [True, True, False, False]


def test_atomic_spans_are_complete(spark):
    for text, spans in zip(TEXTS, apply(spark, tx.atomic_spans, TEXTS)):
        t = text or ""
        assert "".join(s["text"] for s in spans) == t
        assert [s["start"] for s in spans] == [0, *[s["end"] for s in spans[:-1]]] and spans[-1]["end"] == len(t)
    cut = apply(spark, tx.atomic_spans, ["姓名：____（请填写）。"])[0]
    assert [s["text"] for s in cut] == ["姓名：", "____", "（请填写）", "。"]


def test_replaced_ranges(spark):
    df = spark.createDataFrame([("abcdef", [(0, 1, "X"), (3, 5, "")])], "t string, r array<struct<start:int,end:int,replacement:string>>")
    assert df.select(tx.replaced_ranges("t", "r")).first()[0] == "Xbcf"


def test_policies(spark):
    df = spark.createDataFrame([("fixed", "", "", "fixed"), ("", "系统生成", "", "generated"), ("", "填充", "否", "fill"), ("", "", "是", "fill"), ("", "optional", "否", "template_default_optional"), (None, None, None, "fixed")], "s string, k string, f string, want string")
    assert df.filter(tx.policy_of("s", "k", "f") != F.col("want")).count() == 0


def test_numbers_and_units(spark):
    assert apply(spark, vx.lenient_long, ["3", " 3.7 ", "True", "x", None, "-2.9"]) == [3, 3, 1, None, None, -2]
    df = spark.createDataFrame([(240, "auto", "single"), (360, None, "1.5"), (300, "auto", "multiple:1.25"), (400, "exact", "exact:20pt"), (410, "atLeast", "atleast:20.5pt"), (None, "auto", None)], "l int, r string, want string")
    assert [r[0] for r in df.select(vx.line_spacing("l", "r")).collect()] == [r["want"] for r in df.collect()]
    pairs = spark.createDataFrame([("single", "multiple:1.04", True), ("single", "multiple:1.06", False), ("exact:20pt", "exact:20.25pt", True), ("exact:20pt", "multiple:20", False), ("odd", "odd", True), (None, "odd", False)], "a string, b string, want boolean")
    assert [r[0] for r in pairs.select(vx.line_spacing_matches("a", "b")).collect()] == [r["want"] for r in pairs.collect()]
    m = spark.createDataFrame([("上=25mm，下 = 20.5 mm",), ("页边距=20mm 左=30mm",)], "v string").select(vx.margins_mm("v").alias("m")).select("m.*").collect()
    assert tuple(m[0]) == (25.0, 20.5, None, None) and tuple(m[1]) == (20.0, 20.0, 30.0, 20.0)
    a4 = spark.createDataFrame([(210.0, 297.0), (296.5, 210.4), (200.0, 297.0), (None, 297.0)], "w double, h double")
    assert [r[0] for r in a4.select(vx.is_a4("w", "h")).collect()] == [True, True, False, False]


def test_style_requirements(spark):
    got = spark.createDataFrame([("Times New Roman 12pt 加粗 居中 固定值20pt",), ("不加粗；1.5倍行距；左对齐；多倍行距 设置值=1.25",), ("",)], "v string").select(vx.style_requirements("v").alias("s")).select("s.*").collect()
    assert (got[0]["fonts"], got[0]["font_size_pt"], got[0]["bold"], got[0]["alignment"], got[0]["line_spacing"]) == (["Times New Roman"], 12.0, True, "center", "exact:20pt")
    assert (got[1]["bold"], got[1]["alignment"], got[1]["line_spacing"]) == (False, "left", "multiple:1.25")
    assert (got[2]["fonts"], got[2]["font_size_pt"], got[2]["line_spacing"]) == ([], None, None)


def test_hashes(spark):
    docs = ['{"b": 1, "a": [null, "é"]}', '{"a":[null,"é"],"b":1}', "no json", None]
    got = apply(spark, vx.sha256_json, docs)
    want = "sha256:" + hashlib.sha256(json.dumps(json.loads(docs[0]), ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert got == [want, want, None, None]
    assert apply(spark, vx.sha256_text, ["é"]) == ["sha256:" + hashlib.sha256("é".encode()).hexdigest()]
