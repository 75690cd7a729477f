"""Selection semantics on literal rows (FIXTURES.md F6) and question routing (F7)."""

import math

from callsight.operators import agents as A, questions as Q, selection as S

SCHEMA = "call_id string, agent string, turn_idx int, timestamp string, speaker string, message string, sentiment_score double"


def _turns(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_worst_calls_scored_unscored_and_ties(spark):
    rows = []
    # agent A: five scored calls with a tie and two unscored calls -> unscored dropped
    for cid, s in [("a1", 0.9), ("a2", 0.1), ("a3", 0.1), ("a4", None), ("a5", 0.5), ("a6", None), ("a7", 0.49)]:
        rows.append((cid, "A", 0, "t", "agent", "m", s))
    # agent B: nothing scored -> first 5 calls by id
    for i in range(7):
        rows.append((f"b{i}", "B", 0, "t", "agent", "m", None))
    # agent C: NaN counts as missing
    rows.append(("c1", "C", 0, "t", "agent", "m", float("nan")))
    rows.append(("c2", "C", 0, "t", "agent", "m", 0.0))
    got = {(r.agent, r.call_id): r.call_rank for r in S.worst_calls(_turns(spark, rows), 5).collect()}
    assert [c for (a, c), _ in sorted(got.items(), key=lambda kv: (kv[0][0], kv[1])) if a == "A"] == ["a2", "a3", "a7", "a5", "a1"]
    assert sorted(c for a, c in got if a == "B") == ["b0", "b1", "b2", "b3", "b4"]
    assert sorted(c for a, c in got if a == "C") == ["c2"]


def test_sentiment_stats_counts_each_distinct_value(spark):
    rows = [("x", "A", 0, "t", "agent", "m", 0.2), ("x", "A", 1, "t", "agent", "m", 0.8), ("y", "A", 0, "t", "agent", "m", 0.2)]
    r = A.sentiment_stats(_turns(spark, rows)).first()
    assert r.low_sentiment_calls == 2 and math.isclose(r.avg_sentiment, 0.4)


def test_eligibility_boundary_and_null_agent(spark):
    rows = [(f"n{i}", "Nine", 0, "t", "agent", "m", 1.0) for i in range(9)]
    rows += [(f"t{i}", "Ten", 0, "t", "agent", "m", 1.0) for i in range(10)]
    rows += [("z", None, 0, "t", "agent", "m", 1.0)]
    t = _turns(spark, rows)
    assert [r.agent for r in S.eligible_agents(t, 10).collect()] == ["Ten"]
    assert [r.agent for r in S.excluded_agents(t, 10).collect()] == ["Nine"]
    stats = {r.agent: r.total_calls for r in A.agent_stats(t).collect()}
    assert stats[None] == 1  # SQL GROUP BY keeps the null group


def test_new_agents_anti_join(spark):
    rows = [(f"{a}{i}", a, 0, "t", "agent", "m", 1.0) for a in ("P", "Q", "O'Neil") for i in range(10)]
    prev = spark.createDataFrame([("P",), ("O'Neil",)], "agent string")
    assert [r.agent for r in S.new_agents(_turns(spark, rows), prev, 10).collect()] == ["Q"]


def test_agent_batches_cover_every_agent_once(spark):
    agents = spark.range(45).selectExpr("concat('a', lpad(cast(id as string), 2, '0')) as agent")
    rows = S.agent_batches(agents, 20).orderBy("agent_ordinal").collect()
    assert [r.agent_ordinal for r in rows] == list(range(1, 46))
    assert [r.agent for r in rows] == sorted(r.agent for r in rows)
    assert [r.batch_no for r in rows] == [1] * 20 + [2] * 20 + [3] * 5


def test_question_routes(spark):
    qs = spark.createDataFrame(
        [
            (1, "What are the top themes?"),
            (2, "How should agent 00003 improve?"),
            (3, "How many calls are there?"),
            (4, "How many agents are there?"),
            (5, "What is the average sentiment?"),
            (6, "List all supervisors"),
            (7, "Why did Monday go badly?"),
            (8, "What account issues exist?"),
        ],
        "question_id int, question string",
    )
    agents = spark.createDataFrame([("Agent 00003",), ("Agent 00004",)], "agent string")
    has = spark.createDataFrame([(True,)], "has_coaching boolean")
    got = {r.question_id: (r.route, r.agent) for r in Q.route_questions(qs, agents, has).collect()}
    assert got == {
        1: ("top_themes", None),
        2: ("agent_needs", "Agent 00003"),
        3: ("count_calls", None),
        4: ("count_agents", None),
        5: ("avg_sentiment", None),
        6: ("help", None),
        7: ("llm", None),
        8: ("help", None),  # 'account' contains 'count'
    }
    empty = spark.createDataFrame([(False,)], "has_coaching boolean")
    top = Q.route_questions(qs.where("question_id = 1"), agents, empty).first()
    assert top.route == "llm"


def test_dashboard_with_a_hot_call_id_matches_the_separate_tables(spark):
    # One call id shared by many call rows with different sentiments (a third of the rows),
    # plus ordinary calls: the one-pass dashboard must equal the three separate statistics.
    rows = [("HOT", "A", i, "t", "agent" if i % 3 else "customer", "m" * (i % 7 + 1), float(i % 50) / 10) for i in range(300)]
    rows += [(f"c{i}", "A" if i % 2 else "B", j, "t", "agent" if j % 2 else "customer", "x" * (j + 1), (i % 9) / 10 if i % 4 else None)
             for i in range(60) for j in range(10)]
    rows += [("n1", "B", 0, "t", "agent", "m", float("nan"))]
    t = _turns(spark, rows)
    dash = {r.agent: r for r in A.agent_dashboard(t, rounded=False).collect()}
    stats = {r.agent: r for r in A.agent_stats(t).collect()}
    sent = {r.agent: r for r in A.sentiment_stats(t).collect()}
    flow = {r.agent: r for r in A.flow_stats(t).collect()}
    assert set(dash) == set(stats) == {"A", "B"}
    for a, d in dash.items():
        assert (d.total_calls, d.total_messages, d.agent_messages, d.customer_messages) == (
            stats[a].total_calls, stats[a].total_messages, stats[a].agent_messages, stats[a].customer_messages)
        assert math.isclose(d.avg_message_length, stats[a].avg_message_length, abs_tol=1e-6)
        assert math.isclose(d.avg_sentiment, sent[a].avg_sentiment, abs_tol=1e-6)
        assert d.low_sentiment_calls == sent[a].low_sentiment_calls
        assert math.isclose(d.avg_turns, flow[a].avg_turns, abs_tol=1e-6)
        assert math.isclose(d.avg_response_ratio, flow[a].avg_response_ratio, abs_tol=1e-6)
    assert sent["A"].low_sentiment_calls >= 5  # the hot call counts once per distinct value


def test_approximate_distinct_counts_are_opt_in_and_close(spark):
    rows = [(f"c{i}", f"a{i % 37}", 0, "t", "agent", "m", 1.0) for i in range(5000)]
    t = _turns(spark, rows)
    exact = A.volume_counts(t).first()
    approx = A.volume_counts(t, approx_rsd=0.02).first()
    assert (exact.total_calls, exact.total_agents, exact.total_turns) == (5000, 37, 5000)
    assert abs(approx.total_calls - 5000) <= 5000 * 0.08 and abs(approx.total_agents - 37) <= 3
    assert approx.total_turns == 5000


def test_first_messages_of_a_call_that_two_agents_share(spark):
    rows = [("c", a, i, "t", side, f"{a}{side}{i}", 1.0) for a in ("A", "B") for i, side in enumerate(["agent", "customer"] * 4)]
    got = {}
    for r in S.first_messages(_turns(spark, rows), 3).collect():
        got.setdefault((r.agent, r.speaker), []).append(r.message)
    assert {k: len(v) for k, v in got.items()} == {(a, s): 3 for a in "AB" for s in ("agent", "customer")}
    assert all(m.startswith(a) for (a, _), messages in got.items() for m in messages)


def test_dashboard_rounds_once(spark):
    rows = [("c", "A", 0, "t", "agent", "m", 0.1250000004)]
    assert A.agent_dashboard(_turns(spark, rows)).first().avg_sentiment == 0.13
    assert A.sentiment_stats(_turns(spark, rows)).first().avg_sentiment == 0.1250000004


def test_mentions_find_names_whose_lower_case_is_longer(spark):
    agents = spark.createDataFrame([("\u0130pek",), ("Ann",)], "agent string")
    qs = spark.createDataFrame([(1, "How should \u0130PEK improve?")], "question_id int, question string")
    assert [(r.question_id, r.agent) for r in Q.agent_mentions(qs, agents).collect()] == [(1, "\u0130pek")]


def test_calls_analyzed(spark):
    calls = spark.createDataFrame([("A", "1"), ("A", "2"), ("B", "1")], "agent string, call_id string")
    assert {r.agent: r.calls_analyzed for r in S.calls_analyzed(calls).collect()} == {"A": 2, "B": 1}


CALLS = "call_id string, agent string, transcript string, sentiment_score double"


def _bracket(*turns):
    return "\n".join(f"[10:00:0{i % 10} {who}]: {text}" for i, (who, text) in enumerate(turns))


def test_digests_of_heads_equal_digests_of_turns(spark):
    """Calls whole, spread over rows, shared by two agents, one-sided, without turns, with numbers to redact."""
    from callsight.operators import requests as R, transcripts as P

    talk = [("AGENT", f"a{i} 555-123-4567") if i % 3 else ("CUSTOMER", f"c{i} " + "x" * 120) for i in range(12)]
    rows = [
        ("c1", "A", _bracket(*talk), 0.125),
        ("c2", "A", _bracket(*talk[:2]), None),
        ("c2", "A", _bracket(*reversed(talk)), 0.5),
        ("c2", "A", _bracket(("CUSTOMER", "again"), ("SUPERVISOR", "hm"), ("AGENT", "a0")), 0.25),
        ("c2", "B", _bracket(("CUSTOMER", "mine")), float("nan")),
        ("c3", "B", _bracket(("SUPERVISOR", "only me")), 1.0),
        ("c4", "B", "no turns here", 1.0),
        ("c5", "B", None, 1.0),
        ("c6", None, _bracket(*talk), 1.0),
    ]
    calls = spark.createDataFrame(rows, CALLS)
    turns, heads = P.parse_turns(calls), P.call_heads(calls)
    for k, least in ((5, 1), (1, 2)):
        chosen = S.review_calls(turns, least, k)
        want = R.call_digest(S.selected_turns(turns, chosen), chosen).collect()
        got = R.digest_of_heads(heads, S.review_heads(heads, least, k)).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got
    means = {(r.agent, r.call_id): r.avg_sentiment for r in S.call_means(turns).collect()}
    assert {(r.agent, r.call_id): r.avg_sentiment for r in S.head_means(heads).collect()} == means


def test_prompts_in_parts_hold_every_call(spark):
    from callsight.operators import requests as R

    digests = spark.createDataFrame([("A", f"c{i:02}", i, f"Call {i}") for i in range(1, 24)] + [("B", "b", 1, "Call 1")], "agent string, call_id string, call_no int, digest string")
    totals = spark.createDataFrame([("A", 23), ("B", 1)], "agent string, n_calls int")
    got = {(r.agent, r.part): (r.n_calls, r.user_prompt) for r in R.agent_prompts(digests, ["t"], legacy=True, n_calls=totals, per_prompt=10).collect()}
    assert set(got) == {("A", 1), ("A", 2), ("A", 3), ("B", 1)} and got["A", 2][0] == 23
    calls = lambda text: [x for x in text.split("\n") if x.startswith("Call ") and x[5:].isdigit()]
    assert calls(got["A", 1][1]) == [f"Call {i}" for i in range(1, 11)]
    assert calls(got["A", 3][1]) == ["Call 21", "Call 22", "Call 23"]


def test_mentions_equal_testing_every_pair(spark):
    import random

    rng = random.Random(2)
    letters = "abA 1"
    names = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 9))) for _ in range(150)] + ["Agent 00001", "Agent 00011", "É", "ABC"]
    for some in (names, [n for n in names if len(n) > 5], ["Agent 00001", "Agent 00011"], [""]):
        agents = spark.createDataFrame([(n,) for n in some] + [(None,)], "agent string")
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(200)] + ["ask AGENT 00011 or agent 00001?", "é", "", "abc", None]
        asked = spark.createDataFrame(list(enumerate(texts + texts[:5])), "question_id int, question string")
        got = {r.question_id: r.agent for r in Q.agent_mentions(asked, agents).collect()}
        want = {}
        for i, t in enumerate(texts + texts[:5]):
            found = [n for n in some if t is not None and n.lower() in t.lower()]
            if found:
                want[i] = min(found)
        assert got == want


def test_a_question_gives_no_more_rows_than_its_grams(spark):
    agents = spark.createDataFrame([(f"Agent {'x' * (i % 40)}{i:05}",) for i in range(400)], "agent string")
    anchors = Q.name_anchors(agents).collect()
    assert len(anchors) == 400 and all(len(r.gram) == Q.GRAM and r.gram in r.needle for r in anchors)
