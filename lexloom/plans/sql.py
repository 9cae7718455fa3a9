"""Pieces of DuckDB SQL that several twins share."""


def tok(c: str) -> str:
    return rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')"


def h32(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(f'({p})::varchar' for p in parts)})), 1, 8))::bigint"


#: Lines of documents as chunks: doc_id, pos (0-based), text.
LINES = "lines AS (SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1))::bigint AS pos, unnest(string_split(text, chr(10))) AS text FROM documents)"
#: Assistant turns beside the user turn before them: conv_id, turn, question, answer.
PAIRS = "pairs AS (SELECT conv_id, turn, text AS question, next AS answer FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant')"
