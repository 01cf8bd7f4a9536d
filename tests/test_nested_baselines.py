"""Nested dimensions against a plain walk, and what an invalid baseline suppresses."""

import json

import pytest

from folioscope.operators import baselines

META = {"reviewed_by": "a", "review_source": "b", "source_docx_sha256": "sha256:00", "change_reason": "c", "auto_update_allowed": False}


def dim(name, mode="exact", **more):
    return {"id": name, "comparator_mode": mode, "path": name, **more}


def walk(items):
    for x in items if isinstance(items, list) else []:
        if isinstance(x, dict):
            yield x
            yield from walk(x.get("dimensions") or x.get("children") or [])


NESTED = {
    "deep": {"dimensions": [dim("a", dimensions=[dim("b", children=[dim("c", dimensions=[dim("d")]), 5, dim("e")]), dim("f")]), "text", dim("g", dimensions=[], children=[dim("h")])], "required_dimensions": [dim("i", dimensions=0, children=[dim("j")])]},
    "odd": {"dimensions": {"id": "no list"}, "required_dimensions": [dim("k", dimensions="text", children=[dim("hidden")]), {"dimension_id": "l", "required": False}, {}]},
    "none": {"dimensions": []},
}


def frame(spark, documents, actual="{}"):
    return spark.createDataFrame([(k, json.dumps(v) if not isinstance(v, str) else v, actual) for k, v in documents.items()], "name string, doc string, made string")


def test_order_is_depth_first(spark):
    got = baselines.flat_dimensions(frame(spark, {**NESTED, "broken": "{", "wide": {"dimensions": [dim(f"w{i}") for i in range(12)]}}), ["name"], "doc").orderBy("name", "position").collect()
    for name, document in NESTED.items():
        want = [x.get("dimension_id") or x.get("id") or "unknown" for k in ("dimensions", "required_dimensions") for x in walk(document.get(k))]
        assert [r.dimension_id for r in got if r.name == name] == want
    assert [r.dimension_id for r in got if r.name == "wide"] == [f"w{i}" for i in range(12)]
    assert {r.dimension_id: r.depth for r in got if r.name == "deep"} == dict(a=1, b=2, c=3, d=4, e=3, f=2, g=1, h=2, i=1, j=2)
    assert [r.required for r in got if r.dimension_id == "l"] == [False] and not [r for r in got if r.name in ("none", "broken")]


def test_faults_and_comparison(spark):
    good = {"review_metadata": META, "expected": {"a": 1, "b": {"c": [1, 2]}}, "dimensions": [dim("a", children=[{"id": "x", "comparator_mode": "set", "path": "b.c"}, dim("off", required=False)]), dim("z")]}
    documents = {
        "good": good, "unsigned": {**good, "review_metadata": None}, "open": {**good, "review_metadata": {**META, "auto_update_allowed": True, "source_docx_sha256": "md5:1"}}, "short": {**good, "review_metadata": {k: v for k, v in META.items() if k != "change_reason"}},
        "empty": {"review_metadata": META, "expected": {}}, "modes": {**good, "dimensions": [dim("a", children=[dim("n", "numeric_tolerance"), dim("m", "odd"), {"id": "q"}, {"id": "r", "required": False}])]}, "blind": {**good, "expected": [1]},
    }
    df = frame(spark, documents, json.dumps({"a": 1, "b": {"c": [2, 1, 3]}}))
    got = {(r.name, r.position, r.dimension_id, r.finding, r.status) for r in baselines.compared_baselines(df, ["name"], "doc", "made").collect()}
    assert got == {
        ("good", 1, "a", None, "PASS"), ("good", 2, "x", "set_mismatch", "FAIL"), ("good", 4, "z", "dimension_unreadable", "UNKNOWN"),
        ("unsigned", None, None, "missing_review_metadata", "UNKNOWN"), ("unsigned", None, None, "missing_review_metadata_field", "UNKNOWN"), ("unsigned", None, None, "baseline_auto_update_not_allowed", "UNKNOWN"),
        ("open", None, None, "baseline_auto_update_not_allowed", "UNKNOWN"), ("open", None, None, "invalid_source_hash", "UNKNOWN"), ("short", None, None, "missing_review_metadata_field", "UNKNOWN"),
        ("empty", None, None, "missing_baseline_dimensions", "UNKNOWN"), ("modes", None, "n", "missing_numeric_tolerance", "UNKNOWN"), ("modes", None, "m", "unsupported_comparator_mode", "UNKNOWN"), ("modes", None, "q", "missing_comparator_mode", "UNKNOWN"),
        ("blind", None, None, "missing_expected_artifact", "UNKNOWN"),
    }
    assert baselines.compared_baselines(df.limit(0), ["name"], "doc", "made").count() == 0


def test_walks_at_once_and_by_levels_are_one(spark):
    """Plain, deep and odd documents, two of one key among them; only the facts asked for are made, and plain ones need no sort."""
    chain = lambda n, name: dim(name, dimensions=[chain(n - 1, f"{name}x"), 7, dim(f"{name}y", tolerance=n / 4)]) if n else dim(name, required=False)
    documents = [json.dumps(d) for d in [*NESTED.values(), *({"dimensions": [chain(n, "a"), dim("b")], "required_dimensions": [chain(n, "c")]} for n in range(6))]]
    odd = ['{"dimensions": [{"id": 1.50, "path": 1e5}, {"id": 0.0}, {"id": [1]}, {"id": true, "tolerance": "0.5"}]}', '{"dimensions": [{"id": "a", "id": "b"}]}', '{"dimensions": [{"id": NaN}]}', '{"dimensions": [{"id": "x"}]} more', "[1]", "", None, '{"dimensions": 0.0}']
    texts = [*documents, *odd, documents[5]]
    df = spark.createDataFrame([(i % (len(texts) - 1), t) for i, t in enumerate(texts)], "name int, doc string")
    facts = [f for f in baselines.FACTS if f != "dimension"]
    rows = lambda df: sorted(map(repr, df.collect()))
    fast = baselines.flat_dimensions(df, ["name"], "doc", facts)
    assert fast.columns == ["name", "position", "depth", *facts]
    assert rows(fast) == rows(baselines.flat_dimensions(df, ["name"], "doc").drop("dimension"))
    plain = baselines.flat_dimensions(df.limit(len(documents)), ["name"], "doc", ["dimension_id"])
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    with pytest.raises(baselines._Odd):
        baselines._walk('{"dimensions": [' * 201 + '{"id": "end"}' + "]}" * 201, [])
