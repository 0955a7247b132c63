"""Evaluation variants that SQL cannot express, against plain Python."""

import random

from pyspark.sql import functions as F

from termloom.operators import evaluation as ev


def test_equal_keys_are_reserved_and_the_rest_goes_by_ids(spark):
    rng = random.Random(6)
    side = lambda n: [(d, i, rng.choice(["a", "b", "", "c"]), [str(x) for x in rng.sample(range(5), rng.randrange(0, 4))]) for d in range(6) for i in range(n)]
    gold, pred = side(4), side(5)
    make = lambda rows, x: spark.createDataFrame(rows, f"doc long, {x} long, key string, ids array<string>")
    got = {(r.doc, r.g): (r.p, r.method) for r in ev.reserve_then_assign(make(gold, "g"), make(pred, "p"), "doc", "g", "p", "key", "ids", 0.01).collect()}
    want = {}
    for d in range(6):
        g, p = [r for r in gold if r[0] == d], [r for r in pred if r[0] == d]
        used = set()
        for r in g:
            same = [q for q in p if q[2] == r[2] != "" and q[1] not in used]
            if same:
                want[d, r[1]] = (same[0][1], "reserved")
                used.add(same[0][1])
        left = [(len(set(r[3]) & set(q[3])) / len(set(r[3]) | set(q[3])) if r[3] or q[3] else 0.0, r[1], q[1]) for r in g if (d, r[1]) not in want for q in p if q[1] not in used]
        for score, i, j in sorted(left, key=lambda x: (-x[0], x[1], x[2])):
            if score >= 0.01 and (d, i) not in want and j not in used:
                want[d, i] = (j, "greedy")
                used.add(j)
    assert got == want


def test_each_gold_row_takes_the_nearest_that_is_left(spark):
    rng = random.Random(2)
    rows = [(d, g, p, rng.choice([None, 0.1, 0.5, 0.9]), rng.randrange(0, 3)) for d in range(5) for g in range(4) for p in range(3)]
    got = {(r.doc, r.g): (r.p, r.method) for r in ev.nearest_unused(spark.createDataFrame(rows, "doc long, g long, p long, s double, o int"), "doc", "g", "p", "s", "o").collect()}
    want = {}
    for d in range(5):
        used = set()
        for g in range(4):
            mine = [r for r in rows if r[0] == d and r[1] == g and r[2] not in used]
            near = sorted((-r[3], r[2]) for r in mine if r[3] is not None)
            over = sorted((-r[4], r[2]) for r in mine if r[4] >= 1)
            if near or over:
                want[d, g] = (near[0][1], "semantic") if near else (over[0][1], "overlap")
                used.add(want[d, g][0])
    assert got == want


def test_credit_of_pairs_may_replace_common_ids(spark):
    outcomes = spark.createDataFrame([(1, 1, 1, "matched", 0.5), (1, 2, 2, "matched_ignored_gold", None)], "doc long, g long, p long, outcome string, credit double")
    ids = lambda x: spark.createDataFrame([(1, 1, [7, 8]), (1, 2, [9])], f"doc long, {x} long, ids array<int>")
    rows = {r.level: (r.tp, r.fp, r.fn) for r in ev.levels(ev.outcome_counts(outcomes, ids("g"), ids("p"), "doc", "g", "p", shared="credit")).collect()}
    assert rows == {"extraction": (1.0, 0.0, 0.0), "exact_set": (1.0, 0.0, 0.0), "concept": (0.5, 1.5, 1.5)}
    assert ev.levels(ev.outcome_counts(outcomes.filter(F.lit(False)), ids("g"), ids("p"), "doc", "g", "p")).count() == 3
