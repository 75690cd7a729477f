"""Transcript parsing edge cases (FIXTURES.md F5) and properties."""

import pytest

from callsight.operators.transcripts import parse_turns, parse_summary

P1 = "2025-02-07 13:17:57 +0000"
P2 = "2025-02-07 13:18:01 +0000"


def _turns(spark, transcript):
    df = spark.createDataFrame([("c1", "A", transcript, 0.5)], "call_id string, agent string, transcript string, sentiment_score double")
    return [(r.turn_idx, r.timestamp, r.speaker, r.message) for r in parse_turns(df).orderBy("turn_idx").collect()]


def test_inline_bracket(spark):
    assert _turns(spark, "[12:30:08 AGENT]: Hello") == [(0, "12:30:08", "agent", "Hello")]


def test_newline_bracket(spark):
    assert _turns(spark, "[12:30:08 AGENT]:\n Hello\nthere") == [(0, "12:30:08", "agent", "Hello there")]


def test_two_bracket_turns(spark):
    t = "[12:30:08 AGENT]: Hi\n[12:30:10 CUSTOMER]:\nMy card 4111 1111 1111 1111 broke"
    assert _turns(spark, t) == [
        (0, "12:30:08", "agent", "Hi"),
        (1, "12:30:10", "customer", "My card [CARD_REDACTED] broke"),
    ]


def test_pipe(spark):
    t = f"{P1} Consumer: Hi! | {P2} Agent: Hello"
    assert _turns(spark, t) == [(0, P1, "customer", "Hi!"), (1, P2, "agent", "Hello")]


def test_pipe_wins_over_bracket(spark):
    assert _turns(spark, "[12:30:08 AGENT]: a | b") == []


def test_pipe_inside_pipe_message(spark):
    assert _turns(spark, f"{P1} Agent: a | b") == [(0, P1, "agent", "a")]


def test_multiline_pipe_message_ends_at_newline(spark):
    assert _turns(spark, f"{P1} Agent: a\nb | {P2} Customer: c") == [(0, P1, "agent", "a"), (1, P2, "customer", "c")]


def test_tags_only_and_break_tags(spark):
    assert _turns(spark, "[12:30:08 AGENT]: <p></p>") == []
    assert _turns(spark, "[12:30:08 AGENT]: a<BR />b") == [(0, "12:30:08", "agent", "a b")]


def test_nbsp(spark):
    assert _turns(spark, "[12:30:08 AGENT]: a  b") == [(0, "12:30:08", "agent", "a b")]


def test_speaker_words(spark):
    t = f"{P1} Sales Rep: x | {P2} Prepaid client: y | {P2} Supervisor: z"
    assert [s for _, _, s, _ in _turns(spark, t)] == ["agent", "agent", "supervisor"]


@pytest.mark.parametrize("t", [None, "", "hello"])
def test_no_turns(spark, t):
    assert _turns(spark, t) == []


def test_empty_messages_dropped_and_index_dense(spark):
    t = "[12:00:01 AGENT]: <b></b>\n[12:00:02 CUSTOMER]: hi\n[12:00:03 AGENT]: ok"
    assert [(i, m) for i, _, _, m in _turns(spark, t)] == [(0, "hi"), (1, "ok")]


def test_parse_summary_surfaces_zero_turn_calls(spark):
    df = spark.createDataFrame(
        [("a", "X", "[12:30:08 AGENT]: a | b", None), ("b", "X", "[12:30:08 AGENT]: hi", None)],
        "call_id string, agent string, transcript string, sentiment_score double",
    )
    got = {r.call_id: (r.format, r.n_turns) for r in parse_summary(df).collect()}
    assert got == {"a": ("pipe", 0), "b": ("bracket", 1)}


def test_turns_independent_of_partitioning(spark):
    from callsight.plans import catalog

    calls = catalog.calls(spark, "/root/testdata/sf0.001")
    a = sorted(parse_turns(calls.repartition(1)).collect())
    b = sorted(parse_turns(calls.repartition(7)).collect())
    assert a == b and len(a) > 0


#: Transcripts and the turns that they hold.
CASES = [
    ('[12:00:01 AGENT]: hi\n[12:00:02 CUSTOMER]: there\n', [(0, '12:00:01', 'agent', 'hi'), (1, '12:00:02', 'customer', 'there')]),
    ('preamble [12:00:01 AGENT]:\n  a\n\n[12:00:02 Customer Service Rep]:b', [(0, '12:00:01', 'agent', 'a'), (1, '12:00:02', 'agent', 'b')]),
    ('[12:00 [12:01 AGENT]: nested header text', [(0, '12:00', 'agent', 'nested header text')]),
    ('[12:00:01 AGENT]:[12:00:02 CUSTOMER]: back to back', [(0, '12:00:02', 'customer', 'back to back')]),
    ('[12:00:01 AGENT]: a [not a header] b [1:2 X]: c', [(0, '12:00:01', 'agent', 'a [not a header] b'), (1, '1:2', 'x', 'c')]),
    ('[12:00:01 AGENT]: x [12:00:02 ]: y', [(0, '12:00:01', 'agent', 'x [12:00:02 ]: y')]),
    ('[12:00:01\nAGENT]:\n  multi\nline\n\n', [(0, '12:00:01', 'agent', 'multi line')]),
    ('no headers at all', []),
    ('[:: A]: colons only', [(0, '::', 'a', 'colons only')]),
    ('[12:00:01\xa0AGENT]: no-break space in the header\u2003and an em space in the body', [(0, '12:00:01', 'agent', 'no-break space in the header and an em space in the body')]),
    ('[\u0661\u0662:\u0660\u0660:\u0660\u0661 AGENT]: Arabic-Indic digits', [(0, '\u0661\u0662:\u0660\u0660:\u0660\u0661', 'agent', 'Arabic-Indic digits')]),
    ('[12:00:01 AGENT]: a<br\xa0/>b<BR\u2009>c', [(0, '12:00:01', 'agent', 'a b c')]),
    ('2025-02-07 13:17:57 +0000 Consumer: Hi! | 2025-02-07 13:18:01 +0000 Agent: Hello', [(0, '2025-02-07 13:17:57 +0000', 'customer', 'Hi!'), (1, '2025-02-07 13:18:01 +0000', 'agent', 'Hello')]),
    ('2025-02-07 13:17:57 +0000 Agent:\n\n  second line wins | 2025-02-07 13:18:01 +0000 Customer:   spaced  ', [(0, '2025-02-07 13:17:57 +0000', 'agent', 'second line wins'), (1, '2025-02-07 13:18:01 +0000', 'customer', 'spaced')]),
    ('  2025-02-07 13:17:57 +0000  Sales Rep : a:b:c | junk | 2025-02-07 13:18:01 +0000 Agent:', [(0, '2025-02-07 13:17:57 +0000', 'agent', 'a:b:c')]),
    ('2025-02-07 13:17:57 +0000 Agent: a\xa0\nb | 2025-02-07 13:18:01 +0000 Client: <br>x', [(0, '2025-02-07 13:17:57 +0000', 'agent', 'a'), (1, '2025-02-07 13:18:01 +0000', 'customer', 'x')]),
    ('2025-02-07 13:17:57 +0000\nAgent\n: multi-line speaker | x', [(0, '2025-02-07 13:17:57 +0000', 'agent', 'multi-line speaker')]),
    ('2025-02-07 13:17:57 +0000\nAgent\n: no pipe means bracket form', []),
    ('2025-02-07 13:17:57 0000 Agent: bad offset | | ', []),
    ('2025-02-07\xa013:17:57\u2009+0000\xa0Agent: thin and no-break spaces | 2025-02-07 13:18:01 +0000 Customer: ok', [(0, '2025-02-07\xa013:17:57\u2009+0000', 'agent', 'thin and no-break spaces'), (1, '2025-02-07 13:18:01 +0000', 'customer', 'ok')]),
    ('\u0662\u0660\u0662\u0665-\u0660\u0662-\u0660\u0667 13:17:57 +0000 Agent: Arabic-Indic date | x', [(0, '\u0662\u0660\u0662\u0665-\u0660\u0662-\u0660\u0667 13:17:57 +0000', 'agent', 'Arabic-Indic date')]),
    ('2025-02-07 13:17:57 +0000 Agent: a<br\xa0/>b | 2025-02-07 13:18:01 +0000 Customer:\u3000c', [(0, '2025-02-07 13:17:57 +0000', 'agent', 'a b'), (1, '2025-02-07 13:18:01 +0000', 'customer', 'c')]),
]


@pytest.mark.parametrize("text, turns", CASES)
def test_transcript_cases(spark, text, turns):
    assert _turns(spark, text) == turns
