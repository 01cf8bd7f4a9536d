"""Nested documents against plain Python, with every awkward case."""

import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from folioscope.operators import assembly


def test_nest_against_plain_lists(spark):
    rng = random.Random(2)
    parents = [(k, f"parent {k}") for k in [*range(200), None]]
    many, few = [(rng.choice([*range(220), None]), rng.choice([None, *range(50)]), i) for i in range(3000)], [(rng.randrange(10), i) for i in range(300)]
    p = spark.createDataFrame(parents, "k long, tag string").repartition(5)
    a, b = spark.createDataFrame(many, "k long, o int, p1 int").repartition(7), spark.createDataFrame(few, "k long, n int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")  # so that keys go on from batch to batch
    try:
        got = {r.k: r for r in assembly.nest(p, {"many": (a, ["o", "p1"]), "few": (b, ["n"])}, ["k"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(parents)
    for k, tag in parents:
        assert got[k].tag == tag and got[k].few == [Row(n=n) for x, n in few if x == k]
        want = sorted(((o, i) for x, o, i in many if x == k), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        assert [(r.o, r.p1) for r in got[k].many] == want


def test_nest_repeats_orphans_and_empty_sides(spark):
    p = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    c = spark.createDataFrame([(1, 10), (0, 11), (3, 12), (1, 9)], "k long, n int")
    got = [(r.k, [x.n for x in r.kids]) for r in assembly.nest(p, {"kids": (c, ["n"])}, ["k"]).collect()]
    assert sorted(got, key=str) == sorted([(1, [9, 10]), (1, []), (2, [])], key=str)
    assert assembly.nest(p.limit(0), {"kids": (c, ["n"])}, ["k"]).count() == 0
    assert [r.kids for r in assembly.nest(p, {"kids": (c.limit(0), ["n"])}, ["k"]).collect()] == [[], [], []]


def test_a_unit_of_many_elements(spark):
    p = spark.createDataFrame([(1,), (2,)], "k long")
    c = spark.range(200_000).selectExpr("IF(id = 7, 2L, 1L) AS k", "CAST(200000 - id AS INT) AS n")
    got = {r.k: (r.size, r.first, r.last) for r in assembly.nest(p, {"kids": (c, ["n"])}, ["k"]).selectExpr("k", "size(kids) AS size", "kids[0].n AS first", "kids[size(kids) - 1].n AS last").collect()}
    assert got == {1: (199_999, 1, 200_000), 2: (1, 199_993, 199_993)}


def test_template_spec(spark):
    units = spark.createDataFrame(
        [("d", 1, "cover", "own", "odd", None, 0, 4, None, None), ("d", 2, "body", None, "new_page", "page_range_exclusive", 5, 20, None, None), ("d", 3, "end", None, None, None, None, None, 8, 9), ("d", 4, "lost", "mine", None, None, 90, 95, 90, 91),
         (None, 1, "x", None, None, None, 0, 1, None, None)],
        "doc string, place int, unit_id string, section string, start string, scope string, u_start int, u_end int, p_start int, p_end int",
    )
    sections = spark.createDataFrame([("d", "s1", 1, 0, 9, 0, 3), ("d", "s2", 2, 10, 30, 4, 9), ("d", "s3", 3, None, None, None, None)], "doc string, section_id string, s_order int, s_start int, s_end int, sp_start int, sp_end int")
    elements = spark.createDataFrame(
        [("d", "cover", "e2", "fixed", None, "Title", 2), ("d", "cover", "e1", "fill", "odd", "Name: ____", 1), ("d", "cover", "e0", None, None, None, None), ("d", "body", "g", "generated", None, "PAGE", 1), ("d", "body", "h", "generated", None, "x", 2),
         ("d", "nowhere", "e", "fill", None, "", 1), ("d", "end", "k", "fixed", "student_field_candidate", "Name", 1)],
        "doc string, unit_id string, element_id string, policy string, role_hint string, content string, e_order int",
    )
    spec = assembly.element_spec(elements, ["____"], ["Name"])
    got = assembly.template_spec(units, spec, sections, ["doc"]).collect()
    assert [r.doc for r in got] == ["d"]
    cover, body, end, lost = got[0].units
    assert [(u.unit_id, u.section_profile, [r.section_id for r in u.section_refs], u.flags) for u in got[0].units] == [
        ("cover", "s1", ["s1"], []), ("body", "s2", ["s1", "s2"], ["unit_crosses_section_profiles"]), ("end", "s2", ["s2"], []), ("lost", "mine", [], ["unit_section_profile_unmapped"])]
    assert [u.page_policy.start for u in got[0].units] == ["document_start", "new_page", "new_page", "new_page"]
    assert [(e.stable_id, e.executed, e.role, e.confidence, e.flags) for e in cover.elements] == [
        ("cover.e0", "fixed", "template_fixed", "low", ["element_confidence_needs_review"]), ("cover.e1", "fill", "student_content", "high", []), ("cover.e2", "fixed", "template_fixed", "high", [])]
    assert [(e.field_type, e.fill_source) for e in body.elements] == [("PAGE", "generated_field"), ("FIELD_PLACEHOLDER", "generated_field")]
    assert end.elements[0].confidence == "medium" and lost.elements == []


def test_elements_with_one_order_stand_by_their_place(spark):
    units = spark.createDataFrame([("d", 1, "u", None, "odd", "page_range_exclusive", 1, 5, 1, 2)], "doc string, place long, unit_id string, section string, start string, scope string, u_start long, u_end long, p_start long, p_end long")
    sections = spark.createDataFrame([], "doc string, section_id string, s_order long, s_start long, s_end long, sp_start long, sp_end long")
    elements = spark.range(40).selectExpr("'d' AS doc", "'u' AS unit_id", "id", "if(id % 2 = 0, 1, null) AS e_order", "struct('f' AS file, 40 - id AS row) AS e_place")
    found = assembly.template_spec(units, elements, sections, ["doc"]).first()["units"][0]["elements"]
    assert [e["id"] for e in found] == [*range(39, 0, -2), *range(38, -1, -2)] and "e_place" not in found[0]


def few_units(spark):
    units = spark.createDataFrame([(d, p, f"u{p}", None, "odd", "page_range_exclusive", 1, 5, 1, 2) for d in ("d", "e") for p in (3, 1, 2)],
                                  "doc string, place long, unit_id string, section string, start string, scope string, u_start long, u_end long, p_start long, p_end long")
    sections = spark.createDataFrame([], "doc string, section_id string, s_order long, s_start long, s_end long, sp_start long, sp_end long")
    elements = spark.range(60).selectExpr("if(id % 2 = 0, 'd', 'e') AS doc", "concat('u', id % 3 + 1) AS unit_id", "id", "60 - id AS e_order")
    return units, elements, sections


def test_units_are_not_moved_again(spark):
    spec = assembly.template_spec(*few_units(spark), ["doc"])
    got = {r.doc: [(u.unit_id, [e.id for e in u.elements]) for u in r.units] for r in spec.collect()}
    assert got == {d: [(f"u{p}", [i for i in range(59, -1, -1) if i % 2 == k and i % 3 == p - 1]) for p in (1, 2, 3)] for k, d in enumerate("de")}
    between = spec._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[1]
    assert "Exchange" not in between, between


def test_what_is_made_of_elements_is_not_moved(spark):
    units, elements, sections = few_units(spark)
    made = lambda df: df.select("*", F.upper(F.concat("doc", "unit_id", F.col("id").cast("string"))).alias("long")).drop("id")
    spec = assembly.template_spec(units, elements, sections, ["doc"], made)
    got = {r.doc: [(u.unit_id, [e.long for e in u.elements]) for u in r.units] for r in spec.collect()}
    assert got == {d: [(f"u{p}", [f"{d}u{p}{i}".upper() for i in range(59, -1, -1) if i % 2 == k and i % 3 == p - 1]) for p in (1, 2, 3)] for k, d in enumerate("de")}
    plain = assembly.template_spec(units, made(elements), sections, ["doc"])
    assert sorted(plain.collect(), key=lambda r: r.doc) == sorted(spec.collect(), key=lambda r: r.doc)
    plan = spec._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "upper(" in plan[: plan.index("Exchange")] and "upper(" not in plan[plan.index("Exchange") :]
