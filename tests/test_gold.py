"""Gold reports against their definition, place by place."""

import random

from pyspark.sql import functions as F

from folioscope.operators import gold

SCHEMA = "run string, key int, start int, end int, expected string, unit string"
CLAIMS = "run string, item int, start int, end int, action string"


def touched(s, e, a, b):
    """The part of [s, e) that [a, b) meets, an empty one by its place."""
    low, high = max(s, a), min(e, b)
    return (low, high) if (low <= high if s == e or a == b else low < high) else None


def covers(parts, s, e):
    if s == e:
        return bool(parts)
    return all(any(a <= k < b for a, b in parts) for k in range(s, e))


def brute(g, claims):
    run, _, s, e, *_ = g
    if s is None or e is None or s < 0 or s > e:
        return ([], False, False)
    actions, said, known = set(), [], []
    mine = [c for c in claims if c[0] == run]
    for item in {c[1] for c in mine}:
        spans = [(touched(s, e, a, b), x) for _, i, a, b, x in mine if i == item and a is not None and a <= b]
        spans = [(t, x) for t, x in spans if t]
        known += [t for t, _ in spans]
        said += [t for t, x in spans if x]
        actions |= {x for _, x in spans if x}
        for _, i, a, _, x in mine:
            if i == item and a is None:
                known.append((s, e))
                if x and not covers([t for t, _ in spans], s, e):
                    said.append((s, e))
                    actions.add(x)
    return sorted(actions), covers(said, s, e), covers(known, s, e)


def test_projection_is_that_of_places(spark):
    rnd = random.Random(5)
    acts = ["keep", "fill", "delete", None]
    rows, claims = [], []
    for r in range(40):
        for k in range(5):
            s = rnd.randrange(0, 20)
            rows.append((f"r{r}", k, s, s + rnd.choice([0, 1, 3, 9]), rnd.choice([*acts, "unknown"]), rnd.choice(["u", "v", None])))
        for _ in range(rnd.randrange(0, 9)):
            s = rnd.randrange(0, 20)
            whole = rnd.random() < 0.2
            claims.append((f"r{r}", rnd.randrange(3), None if whole else s, None if whole else s + rnd.choice([0, 2, 6]), rnd.choice(acts)))
    rows += [("r0", 90, None, 3, "keep", "u"), ("r0", 91, 5, 2, "keep", "u"), ("r0", 92, -1, 2, "keep", "u"), (None, 93, 0, 2, "keep", "u")]
    claims += claims[:5]
    got = gold.projected(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(claims, CLAIMS), ["run"], ["key"], width=4).collect()
    assert len(got) == len(rows)
    want = {(g[0], g[1]): brute(g, claims) for g in rows}
    assert {(r["run"], r["key"]): (r["actions"], r["complete"], r["known"]) for r in got} == want


def test_report_and_gate(spark):
    rows = [("a", 1, 0, 4, "keep", "u"), ("a", 2, 4, 8, "delete", "u"), ("b", 1, 0, 2, "delete", None), ("b", 2, 2, 4, "unknown", None), ("c", 1, 0, 2, "fill", "u")]
    claims = [("a", 1, 0, 4, "keep"), ("a", 1, 4, 8, "delete"), ("b", 1, 0, 1, "delete"), ("b", 2, 2, 4, "delete")]
    out = gold.outcomes(gold.projected(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(claims, CLAIMS), ["run"], ["key"]).withColumn("doc", F.lit(1)), ["keep", "fill", "delete"])
    got = {(r["level"], r["name"]): r for r in gold.report(out, ["doc"], "unit", ["keep", "fill", "delete"]).collect()}
    assert set(got) == {("all", None), ("unit", "u"), ("unit", None), ("action", "keep"), ("action", "fill"), ("action", "delete")}
    whole = got["all", None]
    assert (whole["n_expected"], whole["n_predicted"], whole["n_correct"], whole["n_unscored"], whole["n_true_delete"], whole["n_false_delete"], whole["n_missed_delete"], whole["gate"]) == (4, 2, 2, 1, 2, 1, 0, "FAIL")
    assert (got["action", "delete"]["recall"], got["action", "delete"]["precision"], whole["macro_f1"]) == (0.5, 1.0, round((1 + 0 + 2 / 3) / 3, 4))
    assert (got["unit", "u"]["gate"], got["unit", None]["gate"]) == ("PASS", "FAIL")


def test_empty_and_one_pass(spark):
    rows, claims = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], CLAIMS)
    out = gold.outcomes(gold.projected(rows, claims, ["run"], ["key"]), ["keep"])
    assert gold.report(out, [], "unit", ["keep"]).filter("level <> 'all'").count() == 0
    done = spark.createDataFrame([("a", "keep", "keep", True, True, False, True, False, False)], "unit string, expected string, predicted string, scored boolean, covered boolean, conflicted boolean, correct boolean, true_delete boolean, false_delete boolean")
    plan = gold.report(done, [], "unit", ["keep"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Expand" in plan
