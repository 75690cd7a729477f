"""DuckDB SQL building blocks for the correctness oracle.

These CTEs recompute the fixture expectations straight from the source
tables (``conversations``, ``documents``) without parsing, so the Spark
parser and the oracle share no code.
"""

from __future__ import annotations

from callsight.operators.themes import PILLAR_THEMES

TURNS_SRC = """
turns_src AS (
  SELECT conv_id, turn,
    'C' || lpad(cast(conv_id AS varchar), cast(greatest(6, length(cast(conv_id AS varchar))) AS int), '0') AS call_id,
    'Agent ' || lpad(cast(agent_no AS varchar), cast(greatest(3, length(cast(agent_no AS varchar))) AS int), '0') AS agent,
    CASE WHEN agent_no = 3 OR conv_id % 11 = 0 THEN NULL
         ELSE cast((conv_id * 37) % 51 AS double) / 10 END AS sentiment_score,
    CASE role WHEN 'assistant' THEN 'Agent' WHEN 'user' THEN 'Customer' ELSE 'System' END AS speaker_label,
    CASE role WHEN 'assistant' THEN 'agent' WHEN 'user' THEN 'customer' ELSE 'system' END AS speaker,
    CASE turn % 5 WHEN 0 THEN 'mail a.b7@mail.example.com<br/>now ' WHEN 1 THEN 'dial 555-123-4567 '
      WHEN 2 THEN 'ssn <b>123-45-6789</b> ' WHEN 3 THEN 'card 4111 1111 1111 1111 ' ELSE '' END || text AS body,
    CASE turn % 5 WHEN 0 THEN 'mail [EMAIL_REDACTED] now ' WHEN 1 THEN 'dial [PHONE_REDACTED] '
      WHEN 2 THEN 'ssn [SSN_REDACTED] ' WHEN 3 THEN 'card [CARD_REDACTED] ' ELSE '' END || text AS clean
  FROM (SELECT *, CASE WHEN conv_id % 10 = 9 THEN 100 + cast(floor(conv_id / 90.0) AS int)
                       ELSE cast((conv_id % 10) % 8 AS int) END AS agent_no FROM conversations) c
)"""

CALLS = """
calls AS (
  SELECT call_id, agent, sentiment_score,
    CASE WHEN conv_id % 2 = 0
      THEN string_agg('[12:' || lpad(cast(conv_id % 60 AS varchar), 2, '0') || ':' || lpad(cast(turn AS varchar), cast(greatest(2, length(cast(turn AS varchar))) AS int), '0')
           || ' ' || upper(speaker_label) || ']:' || chr(10) || body, chr(10) ORDER BY turn)
      ELSE string_agg('2025-02-07 13:' || lpad(cast(conv_id % 60 AS varchar), 2, '0') || ':' || lpad(cast(turn AS varchar), cast(greatest(2, length(cast(turn AS varchar))) AS int), '0')
           || ' +0000 ' || speaker_label || ': ' || body, ' | ' ORDER BY turn)
    END AS transcript
  FROM turns_src GROUP BY conv_id, call_id, agent, sentiment_score
)"""

# Expected parser output. A pipe message ends at its first newline.
TURNS = """
turns AS (
  SELECT call_id, agent, cast(turn AS int) AS turn_idx,
    CASE WHEN conv_id % 2 = 0
      THEN '12:' || lpad(cast(conv_id % 60 AS varchar), 2, '0') || ':' || lpad(cast(turn AS varchar), cast(greatest(2, length(cast(turn AS varchar))) AS int), '0')
      ELSE '2025-02-07 13:' || lpad(cast(conv_id % 60 AS varchar), 2, '0') || ':' || lpad(cast(turn AS varchar), cast(greatest(2, length(cast(turn AS varchar))) AS int), '0') || ' +0000'
    END AS timestamp,
    speaker,
    trim(regexp_replace(CASE WHEN conv_id % 2 = 0 THEN clean ELSE split_part(clean, chr(10), 1) END, '\\s+', ' ', 'g')) AS message,
    sentiment_score
  FROM turns_src
)"""


def lexicon_values() -> str:
    rows = []
    for p_ord, (pillar, themes) in enumerate(PILLAR_THEMES):
        for t in themes:
            rows.append(f"({len(rows)},{p_ord},'{pillar}','{t}')")
    return "theme_lexicon AS (SELECT * FROM (VALUES " + ",".join(rows) + ") AS t(theme_ord, pillar_ord, pillar, theme))"


THEME_ROWS = """
theme_rows AS (
  SELECT 'Agent ' || lpad(cast(agent_no AS varchar), cast(greatest(5, length(cast(agent_no AS varchar))) AS int), '0') AS agent, theme_pos,
    CASE WHEN doc_id % 23 = 0 THEN 'Custom theme ' || cast(doc_id % 5 AS varchar)
         WHEN doc_id % 19 = 0 THEN lower(l.theme)
         WHEN doc_id % 13 = 0 THEN l.theme || ' skills' ELSE l.theme END AS theme,
    CASE (doc_id * 5) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority,
    cast(n_chars % 7 AS bigint) AS frequency,
    CASE WHEN doc_id % 7 = 0 THEN ['Example from document ' || cast(doc_id AS varchar), text]
         ELSE ['Example from document ' || cast(doc_id AS varchar)] END AS examples,
    'Practise ' || l.theme || ' in call ' || cast(doc_id AS varchar) ||
      CASE WHEN doc_id % 5 = 0 THEN ': "' || text || '" \\ ' || chr(9) || ' end' ELSE '' END AS recommendation
  FROM (SELECT doc_id, n_chars, text,
      cast((doc_id * 7 + cast(floor(doc_id / 30.0) AS bigint)) % 30 AS int) AS theme_ord,
      cast(floor(doc_id / 21.0) AS bigint) * 6 + CASE WHEN doc_id % 21 < 1 THEN 0 WHEN doc_id % 21 < 3 THEN 1
        WHEN doc_id % 21 < 6 THEN 2 WHEN doc_id % 21 < 10 THEN 3 WHEN doc_id % 21 < 15 THEN 4 ELSE 5 END AS agent_no,
      cast(CASE WHEN doc_id % 21 < 1 THEN 0 WHEN doc_id % 21 < 3 THEN doc_id % 21 - 1 WHEN doc_id % 21 < 6 THEN doc_id % 21 - 3
        WHEN doc_id % 21 < 10 THEN doc_id % 21 - 6 WHEN doc_id % 21 < 15 THEN doc_id % 21 - 10 ELSE doc_id % 21 - 15 END AS int) AS theme_pos
    FROM documents) d
  JOIN theme_lexicon l ON l.theme_ord = d.theme_ord
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


TURN_CTES = with_ctes(TURNS_SRC, TURNS)
THEME_CTES = with_ctes(lexicon_values(), THEME_ROWS)


def text_template(template: str, exprs: dict[str, str]) -> str:
    """A text template as a DuckDB string expression: literal pieces quoted, ``{name}`` replaced by SQL."""
    import re

    parts = re.split(r"\{(" + "|".join(re.escape(k) for k in exprs) + r")\}", template)
    out = []
    for i, part in enumerate(parts):
        if i % 2:
            out.append(f"({exprs[part]})")
        elif part:
            out.append("'" + part.replace("'", "''") + "'")
    return " || ".join(out) if out else "''"


def quote_sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# F3 insights nested per agent (themes in list order, one strength each) and
# the serialised forms the response fixture builds from them.
AGENT_NO = "cast(substr(agent, 7) AS bigint)"
INSIGHTS = f"""
ins AS (
  SELECT agent,
    list({{'theme': theme, 'priority': priority, 'frequency': frequency, 'examples': examples,
          'recommendation': recommendation}} ORDER BY theme_pos) AS coaching_themes,
    list({{'theme': theme, 'priority': 'urgent', 'frequency': cast(frequency AS varchar), 'examples': examples,
          'recommendation': recommendation}} ORDER BY theme_pos) AS odd_themes,
    ['Strength ' || cast({AGENT_NO} % 3 AS varchar)] AS strengths
  FROM theme_rows GROUP BY agent
)"""
