"""Response validation table (FIXTURES.md F4)."""

import json

import pytest

from callsight.operators import responses as V

OK_THEME = {"theme": "Objection Handling", "priority": "high", "frequency": 2, "examples": ["x"], "recommendation": "r"}


def _env(content):
    return json.dumps({"choices": [{"message": {"content": content}}]})


def _theme(**kw):
    t = dict(OK_THEME)
    t.update(kw)
    return json.dumps({"coaching_themes": [t], "strengths": ["s"]})


CASES = {
    "ok": _env(_theme()),
    "fenced": _env("```json\n" + _theme() + "\n```"),
    "list": _env("[]"),
    "empty": _env("{}"),
    "broken": _env("{bad"),
    "trailing": _env('{"strengths":["s"]} thanks'),
    "dupkey": _env('{"strengths":["a"],"strengths":["b"]}'),
    "prio": _env(_theme(priority="urgent")),
    "freq_str": _env(_theme(frequency="3")),
    "freq_float": _env(_theme(frequency=3.7)),
    "freq_bool": _env(_theme(frequency=True)),
    "ex_text": _env(_theme(examples="e")),
    "no_rec": _env(_theme(recommendation=None)),
    "blank": _env(_theme(theme="")),
    "textitem": _env('{"coaching_themes":["Empathy", null, 0]}'),
    "themes_obj": _env('{"coaching_themes":{"a":1}}'),
    "strengths_text": _env('{"coaching_themes":[],"strengths":"no"}'),
    "two_objects": _env('{"strengths":["a"]}{"strengths":["b"]}'),
    "two_objects_spaced": _env('{"strengths":["a"]} \n {"strengths":["b"]}'),
    "extra_brace": _env('{"strengths":["a"]}}'),
    "trailing_brace_text": _env('{"strengths":["a"]} ok}'),
    "brackets_in_strings": _env('{"strengths":["}{", "[x]", "a\\"}"]}'),
    "nested_ok": _env('{"coaching_themes":[{"theme":"T {1}","examples":[["n"]]}],"strengths":[]}'),
    "null_response": None,
    "error": '{"error":"HTTP 429: slow down"}',
    "no_choices": '{"id":1}',
}


@pytest.fixture(scope="module")
def validated(spark):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    df = spark.createDataFrame(list(CASES.items()), "agent string, response string")
    status = {r.agent: r.status for r in V.response_errors(df).collect()}
    rows = {}
    for r in V.validated_theme_rows(df).collect():
        rows.setdefault(r.agent, []).append((r.theme, r.priority, r.frequency, list(r.examples), r.recommendation))
    strengths = {r.agent: list(r.strengths) for r in V.validated_strengths(df).collect()}
    return status, rows, strengths


def _python_keeps(response):
    """Brute force with Python's json: envelope, fences, strict parse, non-empty object."""
    if response is None:
        return False
    env = json.loads(response)
    if "error" in env or "choices" not in env:
        return False
    content = env["choices"][0]["message"]["content"].replace("```json\n", "").replace("```json", "")
    content = content.replace("```\n", "").replace("```", "").strip()
    try:
        value = json.loads(content)
    except ValueError:
        return False
    return isinstance(value, dict) and bool(value)


def test_kept_matches_python_json(validated):
    status, _, _ = validated
    assert {a for a, s in status.items() if s == "ok"} == {a for a, r in CASES.items() if _python_keeps(r)}
    for a in ("two_objects", "two_objects_spaced", "extra_brace", "trailing_brace_text"):
        assert status[a] == "bad_json", a
    assert status["brackets_in_strings"] == "ok" and status["nested_ok"] == "ok"


def test_kept_and_dropped(validated):
    status, rows, strengths = validated
    dropped = {"list", "empty", "broken", "trailing", "null_response", "error", "no_choices",
               "two_objects", "two_objects_spaced", "extra_brace", "trailing_brace_text"}
    assert {a for a, s in status.items() if s != "ok"} == dropped
    assert status["broken"] == "bad_json" and status["null_response"] == "no_response"
    assert status["error"] == "error" and status["no_choices"] == "no_choices"
    assert set(strengths) == set(CASES) - dropped


def test_ok_and_fenced(validated):
    _, rows, strengths = validated
    expect = [("Objection Handling", "high", 2, ["x"], "r")]
    assert rows["ok"] == expect and rows["fenced"] == expect
    assert strengths["ok"] == ["s"]


def test_coercions(validated):
    _, rows, strengths = validated
    assert rows["prio"][0][1] == "low"
    assert rows["freq_str"][0][2] == 0
    assert rows["freq_float"][0][2] == 3
    assert rows["freq_bool"][0][2] == 1
    assert rows["ex_text"][0][3] == []
    assert rows["no_rec"][0][4] == ""
    assert rows["blank"][0][0] == "Unknown Theme"
    assert rows["textitem"] == [("Unknown Theme", "low", 0, [], "Invalid theme data")]
    assert "themes_obj" not in rows
    assert strengths["strengths_text"] == []
    assert strengths["dupkey"] == ["b"] and "dupkey" not in rows


LONG = 'x\\"\\\\é{[' * 60_000

HARD = {
    "long": _env(_theme(recommendation=LONG)),
    "long_trailing": _env(_theme(recommendation=LONG) + " {}"),
    "huge": _env(_theme(frequency=1e30)),
    "huge_int": _env(_theme(frequency=99999999999999999999)),
    "huge_negative": _env(_theme(frequency=-1e300)),
    "content_object": json.dumps({"choices": [{"message": {"content": {"coaching_themes": [OK_THEME]}}}]}),
    "content_number": json.dumps({"choices": [{"message": {"content": 5}}]}),
    "no_content": json.dumps({"choices": [{"message": {}}]}),
    "empty_envelope": "{}",
    "unreadable": "{",
}


def test_hard_responses(spark):
    df = spark.createDataFrame(list(HARD.items()), "agent string, response string")
    status = {r.agent: r.status for r in V.response_errors(df).collect()}
    assert {a for a, s in status.items() if s == "ok"} == {"long", "huge", "huge_int", "huge_negative"}
    assert status["long_trailing"] == "bad_json"
    assert [status[a] for a in ("content_object", "content_number", "no_content")] == ["exception"] * 3
    assert status["empty_envelope"] == status["unreadable"] == "no_response"
    rows = {r.agent: r for r in V.validated_theme_rows(df).collect()}
    assert rows["long"].recommendation == LONG
    assert (rows["huge"].frequency, rows["huge_int"].frequency, rows["huge_negative"].frequency) == (2**63 - 1, 2**63 - 1, -(2**63))


def test_responses_of_one_agent_stay_apart(spark):
    df = spark.createDataFrame(
        [("a", _env(_theme(theme="one"))), ("a", _env('{"coaching_themes":[{"theme":"two"}],"strengths":["t"]}')), (None, _env(_theme(theme="three")))],
        "agent string, response string",
    )
    got = sorted((str(r.agent), [t.theme for t in r.coaching_themes], list(r.strengths)) for r in V.validate_insights(df).collect())
    assert got == [("None", ["three"], ["s"]), ("a", ["one"], ["s"]), ("a", ["two"], ["t"])]


def test_merge_takes_the_new_run_whole(spark):
    schema = "agent string, coaching_themes array<string>, strengths array<string>"
    old = spark.createDataFrame([("a", ["old"], ["o"]), ("b", ["old"], ["o"]), ("b", ["older"], ["o"])], schema)
    new = spark.createDataFrame([("a", ["n1"], ["n"]), ("a", ["n2"], ["n"]), ("c", [], [])], schema)
    got = sorted((r.agent, list(r.coaching_themes)) for r in V.merge_insights(old, new).collect())
    assert got == [("a", ["n1"]), ("a", ["n2"]), ("b", ["old"]), ("b", ["older"]), ("c", [])]


def test_failed_requests_are_dropped(spark):
    requests = spark.createDataFrame([("ok", 1), ("bad", 1), ("none", 2)], "agent string, batch_no int")
    responses = spark.createDataFrame([("ok", _env(_theme())), ("bad", _env("{")), ("other", _env(_theme()))], "agent string, response string")
    assert [r.agent for r in V.attach_responses(requests, responses).collect()] == ["ok"]


def test_usable_responses_are_attached_one_by_one(spark):
    requests = spark.createDataFrame([("a", 1)], "agent string, batch_no int")
    good = _env(_theme())
    responses = spark.createDataFrame([("a", good), ("a", '{"error": "x"}'), ("a", _env("[]"))], "agent string, response string")
    assert [(r.agent, r.response) for r in V.attach_responses(requests, responses).collect()] == [("a", good)]


def python_themes(content):
    """The reference's coercions on what Python's json reads; None where the response is dropped."""
    try:
        value = json.loads(content)
    except ValueError:
        return None
    if not isinstance(value, dict) or not value:
        return None
    themes = value.get("coaching_themes", [])
    out = []
    for t in themes if isinstance(themes, list) else []:
        if not t:
            continue
        if not isinstance(t, dict):
            out.append(("Unknown Theme", "low", 0, [], "Invalid theme data"))
            continue
        text = lambda x: x if isinstance(x, str) else json.dumps(x, separators=(",", ":"), ensure_ascii=False) if isinstance(x, (list, dict)) else str(x)
        f = t.get("frequency", 0)
        number = isinstance(f, (int, float)) and f == f and abs(f) != float("inf")
        examples = t.get("examples", [])
        out.append(
            (
                text(t.get("theme")) if t.get("theme") else "Unknown Theme",
                t.get("priority") if t.get("priority") in ("high", "medium", "low") else "low",
                int(f) if number else 0,
                [text(e) for e in examples] if isinstance(examples, list) else [],
                text(t.get("recommendation")) if t.get("recommendation") else "",
            )
        )
    return out


def test_contents_equal_python_json(spark):
    """Random contents, whole and damaged, against ``json.loads`` and the coercions in plain Python."""
    import random

    rng = random.Random(21)
    texts = ["t", "", 'q"uote', "NaN", "a Infinity b", "-Infinity", "\\\\", "br{ack]ets", "é\n", "```"]

    def value(depth):
        k = rng.randrange(12 if depth else 8)
        if k < 3:
            return rng.choice(texts)
        if k < 8:
            return [rng.randrange(5), True, False, None, float("nan"), float("inf"), float("-inf"), 2.5][rng.randrange(8)]
        return [value(depth - 1) for _ in range(rng.randrange(3))] if k < 10 else {rng.choice("ab"): value(depth - 1) for _ in range(rng.randrange(3))}

    contents = []
    for i in range(1500):
        theme = lambda: {f: value(1) if f == "examples" else rng.choice([value(0), "high"]) for f in ("theme", "priority", "frequency", "examples", "recommendation") if rng.random() < 0.8}
        body = {"coaching_themes": [rng.choice([theme(), theme(), value(1)]) for _ in range(rng.randrange(4))], "strengths": [], "x": value(1)}
        text = json.dumps(rng.choice([body] * 8 + [value(2)]))
        damage = rng.randrange(12)
        if damage == 0:
            text += rng.choice(["}", "]", " x", ",{}", "{}", "],[1]", ',"a"', " NaN", "//"])
        elif damage == 1:
            text = rng.choice(["[", "x", "{", "NaN ", ","]) + text
        elif damage == 2 and len(text) > 3:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(['"', "}", "NaN", "\\", ""]) + text[at + 1 :]
        contents.append(text)
    contents = [c for c in contents if "```" not in c]
    plain = ("nan", "inf", "-inf")
    df = spark.createDataFrame([(str(i), _env(c)) for i, c in enumerate(contents)], "agent string, response string")
    got = {int(r.agent): [(t.theme, t.priority, t.frequency, list(t.examples), t.recommendation) for t in r.coaching_themes] for r in V.validate_insights(df).collect()}
    wanted = {i: t for i, t in enumerate(python_themes(c.strip()) for c in contents) if t is not None}
    assert set(got) == set(wanted), [contents[i] for i in set(got) ^ set(wanted)][:5]
    nested = lambda rows: any(x[:1] in "[{" for r in rows for x in (r[0], r[4], *r[3]) if x)  # noqa: E731  texts of lists differ in their spacing
    compared = [i for i in wanted if not nested(wanted[i])]
    assert all(got[i] == wanted[i] for i in compared), [(contents[i], got[i], wanted[i]) for i in compared if got[i] != wanted[i]][:3]
    assert len(compared) > 500 and any(x in plain for i in compared for r in got[i] for x in (r[0], r[4], *r[3]))
