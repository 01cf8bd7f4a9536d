"""Rule ladders and rule sets, against plain Python where no query has SQL for them."""

import itertools
import random

from pyspark.sql import functions as F

from folioscope.operators import gaps, rules


def plain_unit_faults(units):
    """Faults of one document's units in order, one after another."""
    out, expected = set(), 1
    ids = [u["unit_id"] for u in units]
    for u in units:
        s, e, n = u["start_page"], u["end_page"], u["page_count"]
        good = None not in (s, e, n) and n > 0 and s == expected and s <= e <= n
        if not good:
            out.add((u["place"], "page_boundary_invalid"))
        else:
            expected = e + 1
        if ids.count(u["unit_id"]) > 1:
            out.add((u["place"], "unit_id_duplicate"))
        if u["policy_errors"]:
            out.add((u["place"], "page_policy_invalid"))
    if units and units[0]["page_count"] is not None and expected != units[0]["page_count"] + 1:
        out.add((units[-1]["place"], "page_coverage_incomplete"))
    return out


def test_units_against_a_plain_walk(spark):
    rng, rows, want = random.Random(3), [], set()
    for doc in range(60):
        pages, units, at = rng.randrange(3, 12), [], 1
        while at <= pages:
            end = min(pages, at + rng.randrange(3))
            units.append({"doc": doc, "place": len(units), "unit_id": f"u{len(units)}", "start_page": at, "end_page": end, "page_count": pages, "policy_errors": int(rng.random() < 0.1)})
            at = end + 1
        for u in units:
            if rng.random() < 0.15:
                u[rng.choice(["start_page", "end_page"])] = rng.choice([None, 0, 1, pages, pages + 1])
            if rng.random() < 0.1:
                u["unit_id"] = "u0"
        rows += units
        want |= {(doc, *f) for f in plain_unit_faults(units)}
    df = spark.createDataFrame(rows, "doc int, place int, unit_id string, start_page int, end_page int, page_count int, policy_errors int")
    found = rules.findings(rules.unit_facts(df, ["doc"]), ["doc", "place"], rules.unit_checks())
    assert {(r["doc"], r["place"], r["check"]) for r in found.collect()} == want
    verdicts = {r["doc"]: r["verdict"] for r in rules.gate(found, df, ["doc"]).collect()}
    assert verdicts == {d: "FAIL" if any(w[0] == d for w in want) else "PASS" for d in range(60)}


def plain_errors(d):
    kids, seen, inline = (d[k] or [] for k in ("child_refs", "inspect_child_refs", "child_refs_decided"))
    result, confidence = (d["result"] or "").lower(), (d["confidence"] or "low").lower()
    split = result == "split"
    whole = bool(d["content_complete"]) and not d["truncated"] and (not kids or bool(d["children_complete"]))
    tests = {
        "target_ref": d["target_ref"] != d["node"], "result_unknown": result not in rules.RESULTS, "confidence_unknown": confidence not in rules.CONFIDENCES, "inspects_no_child": bool(set(seen) - set(kids)),
        "inspects_twice": len(seen) != len(set(seen)), "decides_no_child": bool(set(inline) - set(kids)), "decides_twice": len(inline) != len(set(inline)), "decides_unseen": bool(set(inline) - set(seen)),
        "child_splits": bool(d["child_splits"]), "leaf_splits": split and not kids, "split_sees_nothing": split and not seen, "split_default": split and (d["default_child_result"] or "keep") != "keep",
        "split_incomplete": split and not d["children_complete"], "not_allowed": not split and result not in rules.TERMINAL.get(d["source_kind"], ["keep"]), "terminal_with_children": not split and bool(inline),
        "terminal_incomplete": result in ("keep", "fill", "delete") and not whole, "fill_without_source": result == "fill" and not (d["fill_source"] or "").strip(),
        "delete_of_container": result == "delete" and d["source_kind"] not in ("run", "span"), "delete_unsure": result == "delete" and confidence != "high", "delete_without_reason": result == "delete" and not (d["delete_reason"] or "").strip(),
    }
    return [k for k, v in tests.items() if v]


def test_decisions_against_plain_rules(spark):
    rng, rows = random.Random(5), []
    for i in range(600):
        kids = [f"{i}a", f"{i}b"] if rng.random() < 0.5 else None
        refs = lambda: rng.choice([None, [], kids, [f"{i}a"], [f"{i}a", f"{i}a"], ["x"]])  # noqa: B023, E731
        rows.append({
            "node": str(i), "source_kind": rng.choice(["run", "cell", "table", "span", "other", None]), "child_refs": kids, "children_complete": rng.choice([True, True, False, None]), "content_complete": rng.choice([True, True, False, None]),
            "truncated": rng.choice([False, False, None, True]), "target_ref": rng.choice([str(i)] * 5 + ["no", None]), "result": rng.choice(["keep", "Fill", "delete", "split", "odd", None]), "confidence": rng.choice(["high", "LOW", "medium", "sure", None]),
            "inspect_child_refs": refs(), "child_refs_decided": rng.choice([None, None, refs()]), "child_splits": rng.choice([0, 0, None, 1]), "default_child_result": rng.choice([None, "keep", "fill"]),
            "fill_source": rng.choice(["s", " ", None]), "delete_reason": rng.choice(["r", "", None]),
        })
    schema = "node string, source_kind string, child_refs array<string>, children_complete boolean, content_complete boolean, truncated boolean, target_ref string, result string, confidence string, inspect_child_refs array<string>, child_refs_decided array<string>, child_splits int, default_child_result string, fill_source string, delete_reason string"
    got = {r["node"]: r for r in rules.settled_decisions(spark.createDataFrame(rows, schema), ["node"]).collect()}
    for d in rows:
        errors, r = plain_errors(d), got[d["node"]]
        assert r["errors"] == errors
        assert (r["decision_status"], r["result"]) == (("manual_review", "keep") if errors else ("accepted", (d["result"] or "").lower()))
    assert {bool(plain_errors(d)) for d in rows} == {True, False}


def test_ladders_take_the_first_rung_and_nulls_do_not_hold(spark):
    facts = [dict(zip("abc", x)) for x in itertools.product([True, False, None], repeat=3)]
    ladder = rules.decided([rules.Rung(F.col("a"), "PASS", "a"), rules.Rung(F.col("b"), "FAIL", "b")], "UNKNOWN", "none")
    for r in spark.createDataFrame(facts, "a boolean, b boolean, c boolean").withColumn("x", ladder).collect():
        assert r["x"]["outcome"] == ("a" if r["a"] else "b" if r["b"] else "none")


def test_distances_and_upright_sections(spark):
    s = spark.createDataFrame([("d", 1, True, 10.0, None), ("d", 2, False, 72.0, None), ("e", 1, True, 72.0, 9.0), ("f", 1, False, None, None)], "doc string, pos int, wide boolean, top double, gutter double")
    first = gaps.first_portrait(s, ["doc"], "pos", "wide", ["top", "gutter"])
    said = gaps.distances({"top": F.col("top"), "gutter": F.col("gutter")}, {"top": F.lit(25.3), "gutter": F.lit(0.0)}, ["gutter"])
    assert {r["doc"]: (r["top"], r["x"]["status"]) for r in first.withColumn("x", said).collect()} == {"d": (72.0, "PASS"), "e": (72.0, "FAIL"), "f": (None, "UNKNOWN")}


def test_required_and_conflicting_policies(spark):
    e = spark.createDataFrame([("u", "fill", "", 1), ("u", "fixed", None, 2), ("v", "fill", "s", 3), ("w", "fill", "s", 4)], "unit_id string, policy string, source string, id int")
    g = spark.createDataFrame([("u", "generated"), ("v", "fixed"), ("w", "fixed"), ("w", "fixed_allows_fill")], "unit_id string, unit_group string")
    assert {(r["id"], r["expected"]) for r in rules.policy_conflicts(e, g).collect()} == {(1, "generated"), (3, "fixed")}
    assert {(r["id"], tuple(r["missing"])) for r in rules.required_gaps(e, {"fill": ["source", "unit_id"]}).collect()} == {(1, ("source",))}
