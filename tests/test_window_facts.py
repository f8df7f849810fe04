from sievecraft.operators import window_facts as W


def facts(spark, text, draft):
    rows = W.window_facts(spark.createDataFrame([("w", text, draft)], "window_id string, text string, draft string")).orderBy("place")
    return [r.sentence for r in rows.collect()]


def test_facts_of_each_family(spark):
    text = "REMOVED: a::old, a::gone.\n[current turn]\na::card0 12 34\na::card01 1 2\nbus-1 (a::dose  ~ every 1,152 t)\n3 of 07 cases passed\n('x', 'allow', 'block'), ('y', 'deny', 'ask')\nMERGED PR #5"
    draft = "I deleted card0 and kept the rest. a::dose rides every turn. All cases passed; PR #5 merged, PR #6 is merged, not merged PR #7. Seven PRs merged"
    assert facts(spark, text, draft) == [
        "a::old removed per the evidence window.",
        "a::gone removed per the evidence window.",
        "a::card0 still present in [current turn] after the claimed removal.",
        'a::dose cadence in [current turn]: "bus-1 (a::dose ~ every 1,152 t)" — that is every 1152 turns, not every turn.',
        "table shows 3 of 7 cases passed.",
        "table shows 1 of 2 mismatch rows with actual ask.",
        "table shows 1 of 2 mismatch rows with actual block.",
        "table shows 1 of 2 mismatch rows stricter than expected, 1 more permissive.",
        "merge receipt found for PR #5 in [current turn].",
        "no merge receipt for PR #6 in window.",
        "merge receipts in window: 1; the draft claims 7 merged; the draft's session-wide total cannot be checked here.",
    ]
    assert facts(spark, "x", "every PR is merged") == ["merge receipts in window: 0; the draft claims every item merged; the window carries no merge receipt at all, so this claim is unsupported here."]
    assert facts(spark, "", "every PR is merged") == [] and facts(spark, None, None) == [] and facts(spark, "a line", "a draft") == []
    assert len(facts(spark, "\n".join(f"MERGED PR #{k}" for k in range(40)), "")) == W.MOST_FACTS


FACTS = [
    (0, "tests", "run", None, 12, None), (1, "tests", "later", None, 99, None), (2, "tracked", "a.py", True, None, None), (3, "tracked", "a.py", False, None, None), (4, "length", "gone.py", False, None, None),
    (5, "commit", "abc123", False, None, None), (6, "branch", "feat/x", False, None, None), (7, "push-state", "main", None, 2, None), (8, "pr-state", "5", None, None, "OPEN"), (9, "pr-checks", "5", None, None, "lint"),
]
CLAIMS = {
    "The suite ran: 13 passed.": [1], "The suite ran: 12 passed.": [], "I ran it and added 13 passed tests.": [], "It ran: 13 passed, 2 passed.": [], "a.py is committed": [2], "a.py is not tracked": [], "gone.py has it": [3],
    "gone.py was removed": [], "see abc123 on feat/x": [4], "on feat/x": [5], "all pushed": [6], "pushed, PR #5 merged and checks are green": [6, 7], "PR #5 checks are green": [8], "PR #6 merged": [], "not yet pushed": [], "The suite ran: 13 passed and pushed": [1],
}


def test_claims_that_facts_contradict(spark):
    facts = spark.createDataFrame([("r", *f) for f in FACTS] + [("s", 0, "tests", "run", None, 13, None)], "run string, at int, kind string, name string, flag boolean, number long, said string")
    claims = spark.createDataFrame([("r", k, c) for k, c in enumerate(CLAIMS)] + [("t", 0, "all pushed"), ("r", 99, None)], "run string, place int, claim string")
    got = {}
    for row in W.contradicted(claims, facts).collect():
        got.setdefault(row.place, []).append(row.rule)
        assert row.run == "r" and row.reason
    assert {c: sorted(got.get(k, [])) for k, c in enumerate(CLAIMS)} == CLAIMS


def test_lines_are_made_once_for_all_families(spark):
    from sievecraft.operators import window_facts as W

    rows = spark.createDataFrame([("w", "a\n#12 merged", "all PRs merged")], "window_id string, text string, draft string")
    plan = W.window_facts(rows)._jdf.queryExecution().analyzed().toString()
    assert "posexplode(split" not in plan and "LogicalRDD" in plan
