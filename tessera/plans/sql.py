"""Pieces of DuckDB SQL that several oracles share."""

from tessera.functions.text import BOS, EOS, LINE_ENDS, PAD, SPECIALS, STRIPPED

SPECIAL = SPECIALS


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{STRIPPED}+|{STRIPPED}+\z', '', 'g')"


def chars(x: str) -> str:
    return f"length(regexp_replace({x}, '{SPECIAL}', 'x', 'g'))"


def answer(x: str) -> str:
    return rf"regexp_replace(regexp_replace({strip(x)}, '\A[。；;，,：:]+|[。；;，,：:]+\z', '', 'g'), '{STRIPPED}+', '', 'g')"


#: Messages of conversations, cleaned, and conversations that are fine.
MESSAGES = f"""
m AS (SELECT conv_id, turn, role, {strip('text')} AS content FROM conversations),
good AS (
    SELECT conv_id FROM m GROUP BY conv_id
    HAVING bool_and(coalesce(role IN ('system', 'user', 'assistant', 'observation'), false)) AND bool_and(coalesce(content <> '', false))
),
g AS (SELECT m.* FROM m JOIN good USING (conv_id))
"""
LABEL = "CASE role WHEN 'system' THEN 'System: ' WHEN 'user' THEN E'\\n\\nUser: ' WHEN 'assistant' THEN E'\\n\\nAssistant: ' ELSE E'\\n\\nObservation: ' END"
END = f"CASE WHEN role = 'assistant' THEN '{EOS}' ELSE '' END"
#: Tokens of good conversations: all of them, and supervised ones, by characters.
CHAT_TOKENS = f"""{MESSAGES},
t AS (
    SELECT conv_id, 1 + sum({chars(LABEL)} + {chars('content')} + CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS tokens,
        sum(CASE WHEN role = 'assistant' THEN {chars('content')} + 1 ELSE 0 END) AS supervised
    FROM g GROUP BY conv_id HAVING bool_or(role = 'assistant')
)
"""
PROMPT = f"'{BOS}' || string_agg({LABEL} || content || {END}, '' ORDER BY turn)"
UNIFORM = "CAST('0x' || left({}, 8) AS BIGINT)"
LINES = LINE_ENDS
__all__ = ["BOS", "EOS", "PAD"]
