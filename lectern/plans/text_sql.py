"""DuckDB SQL of normalisation, sentences and chunks: chains of CTEs over a table of (doc_id, text).

RE2 has neither back-references nor look-around, so a rule that repeats a character is a
chain over the characters there are.
"""

from __future__ import annotations

from lectern.functions.text import ABBREVIATIONS, pictograph_class
from lectern.operators.chunking import DELIMITERS

#: White space as the JVM's Unicode classes have it, for RE2.
WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}\x{1c}-\x{1f}]"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Symbols that the fixtures repeat.
SYMBOLS = "#*$%&|<>()[]{}@+=/-~^\""
_WORD = r"\p{L}\p{N}_"


def chain(column: str, steps: list[tuple[str, str]], flags: str = "g") -> str:
    """Nested regexp_replace() calls."""
    for pattern, to in steps:
        q = pattern.replace("'", "''")
        column = f"regexp_replace({column}, '{q}', '{to}', '{flags}')"
    return column


LF = "' || chr(10) || '"
T01 = "translate(text, '「」『』', '“”“”')"
T02 = r"regexp_replace(text, '[^\p{L}\p{N}\p{P}\p{S}\s\x{85}\x{a0}\x{2028}\x{2029}\x{3000}]+', ' ', 'g')"
T02_PICTOGRAPHS = f"regexp_replace({T02}, '{pictograph_class()}+', ' ', 'g')"
_SPACES = [(r"\r\n?", LF), (r"[ \t]+", " "), (WS + r"*\n\n" + WS + "*", "' || chr(57344) || '"), (WS + r"*\n" + WS + "*", LF)]
T03 = f"trim(replace({chain('text', _SPACES)}, chr(57344), chr(10) || chr(10)), ' ' || chr(9) || chr(10) || chr(160))"
T04 = chain("text", [(rf"(?m)^(?:[^{_WORD}\n]*?[^{_WORD}\s]){{3}}[^{_WORD}\n]*$", LF + LF)])
T05 = chain("text", [(r"(?:!\?|\?!){2,}", "?!"), ("--+", "—"), (r"\.{4,}", "..."), *[(f"[{c}]{{3,}}", c) for c in "!?,;:"]])
T06 = chain("text", [(f"(?i)({c}){c}{{4,}}", r"\1\1\1\1") for c in LETTERS])
T07 = chain("text", [(f"\\x{{{ord(c):x}}}{{2,}}", c) for c in SYMBOLS])
T10 = chain("text", [(rf"(?i)(^|[^{_WORD}])({c})(?:[-.]{c})+", r"\1\2") for c in LETTERS])
T11 = chain(chain("text", [(r"\*\*(.+?)\*\*|__(.+?)__", r"\1\2")]), [(r"\*(.+?)\*|_(.+?)_", r"\1\2")])
FLAT = f"trim(regexp_replace(text, '{WS}+', ' ', 'g'))"
CORE = "rtrim(flat, ' \"''’”')"
FINISHED = f"CASE WHEN {CORE} <> '' AND {CORE}[-1] NOT IN ('.', '?', '!') THEN flat || '.' ELSE flat END"


def prepared(source: str, name: str = "prep") -> str:
    """CTEs up to `name`: texts before segmentation, default options."""
    out, last = [], source
    for k, rule in enumerate((T01, T02_PICTOGRAPHS, T03, T04, T05, T06, T07)):
        step = name if k == 6 else f"{name}_{k}"
        out.append(f"{step} AS (SELECT doc_id, {rule} AS text FROM {last})")
        last = step
    return ",\n".join(out)


def sentences(source: str, hook: str | None = None, language: str = "en") -> str:
    """CTEs up to sents (doc_id, para_idx, sent_idx, text): finished sentences of prepared texts; `hook` is an expression of text before they are finished."""
    known = "|".join(ABBREVIATIONS[language])
    guarded = chain("p", [(rf"(^|[^{_WORD}])({known})\.({WS})", "\\1\\2' || chr(57345) || '\\3")])
    cut = f"regexp_replace(regexp_replace({guarded}, '([.?!][\"''’”)]?){WS}+', '\\1' || chr(57344), 'g'), '\\n+', chr(57344), 'g')"
    return f"""split_paras AS (SELECT doc_id, unnest(range(len(p))) AS a, unnest(p) AS p FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\n\\n+'), lambda x: x <> '') AS p FROM {source})),
split_sents AS (SELECT doc_id, a, unnest(range(len(s))) AS b, replace(unnest(s), chr(57345), '.') AS text FROM (SELECT doc_id, a, list_filter(string_split({cut}, chr(57344)), lambda x: x <> '') AS s FROM split_paras)),
plain_sents AS (SELECT doc_id, a, b, {T11} AS text FROM (SELECT doc_id, a, b, {T10} AS text FROM split_sents)),
flat_sents AS (SELECT doc_id, a, b, {FLAT} AS flat FROM (SELECT doc_id, a, b, {hook or 'text'} AS text FROM plain_sents)),
sents AS (SELECT doc_id, (dense_rank() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INT AS para_idx, (row_number() OVER (PARTITION BY doc_id, a ORDER BY b) - 1)::INT AS sent_idx, text
  FROM (SELECT doc_id, a, b, {FINISHED} AS text FROM flat_sents) WHERE text <> '')"""


def force_split(source: str, keys: str, limit: int, name: str) -> str:
    """CTEs up to `name` (keys, k, text): pieces of the texts of `source`; WITH RECURSIVE is needed."""
    reverse = " ".join(f"WHEN contains(rest[:{limit}], '{d}') THEN {limit} + 1 - instr(reverse(rest[:{limit}]), '{d}')" for d in DELIMITERS)
    return f"""{name}_walk AS (
  SELECT {keys}, -1 AS k, '' AS text, text AS rest FROM {source}
  UNION ALL
  SELECT {keys}, k + 1, CASE WHEN length(rest) <= {limit} THEN rest ELSE trim(substr(rest, 1, p)) END, CASE WHEN length(rest) <= {limit} THEN '' ELSE ltrim(substr(rest, p + 1)) END
  FROM (SELECT *, CASE {reverse} ELSE {limit} END AS p FROM {name}_walk WHERE rest <> '')
), {name} AS (SELECT {keys}, (row_number() OVER (PARTITION BY {keys} ORDER BY k) - 1)::INT AS k, text FROM {name}_walk WHERE text <> '')"""


def chunks(strategy: str, most: int = 500, ideal: int = 300, penalty: float = 2.0) -> str:
    """CTEs after sents up to chunks (doc_id, chunk_idx, text, boundary, n_chars)."""
    if strategy == "simple":
        whole = "whole AS (SELECT doc_id, string_agg(text, ' ' ORDER BY para_idx, sent_idx, k) AS text FROM pieces GROUP BY doc_id)"
        parts = force_split("whole", "doc_id", most, "parts")
        last = "CASE WHEN k = max(k) OVER (PARTITION BY doc_id) THEN 'SENTENCE' ELSE 'HARD_LIMIT' END"
        tail = f"{whole},\n{parts},\nchunks AS (SELECT doc_id, k AS chunk_idx, text, {last} AS boundary, length(text)::INT AS n_chars FROM parts)"
        return f"{force_split('sents', 'doc_id, para_idx, sent_idx', most, 'pieces')},\n{tail}"
    g = "para_idx" if strategy == "paragraph" else "0"
    units = f"units AS (SELECT doc_id, {g} AS g, (row_number() OVER (PARTITION BY doc_id, {g} ORDER BY para_idx, sent_idx, k) - 1)::INT AS u, text, length(text) AS n FROM pieces)"
    if strategy == "greedy":
        ranges = f"""groups AS (SELECT doc_id, g, list({{'start': 0, 'size': n, 'out': []::INT[]}} ORDER BY u) AS l, count(*)::INT AS n FROM units GROUP BY ALL),
walked AS (SELECT doc_id, g, n, list_reduce(list_transform(l, lambda x, i: {{'start': i - 1, 'size': x.size, 'out': x.out}}), lambda a, b: CASE
    WHEN a.size + 1 + b.size <= {most} THEN {{'start': b.start, 'size': a.size + 1 + b.size, 'out': a.out}}
    ELSE {{'start': b.start, 'size': b.size, 'out': list_append(a.out, b.start::INT)}} END).out AS out FROM groups),
spans AS (SELECT doc_id, g, unnest(list_prepend(0, out)) AS first, unnest(list_append(out, n)) AS stop, n FROM walked)"""
    else:
        cost = f"pow((size - {ideal}) / {ideal}.0::DOUBLE, 2) * CASE WHEN size < {ideal} * 0.5 THEN {penalty}::DOUBLE ELSE 1.0::DOUBLE END"
        ranges = f"""ends AS (SELECT *, sum(n + 1) OVER (PARTITION BY doc_id, g ORDER BY u ROWS UNBOUNDED PRECEDING) AS e FROM units),
reach AS (SELECT y.doc_id, y.g, y.u AS i, x.u AS j, y.e - x.e + x.n AS size FROM ends y JOIN ends x ON y.doc_id = x.doc_id AND y.g = x.g AND x.u <= y.u AND y.e - x.e + x.n <= {most}),
costs AS (SELECT doc_id, g, i, list({{'j': j, 'c': {cost}}} ORDER BY j DESC) AS c FROM reach GROUP BY doc_id, g, i),
steps AS (SELECT doc_id, g, count(*)::INT AS n, list_prepend({{'best': [0.0::DOUBLE], 'cut': [0::INT], 'c': []::STRUCT(j INT, c DOUBLE)[]}}, list({{'best': []::DOUBLE[], 'cut': []::INT[], 'c': c}} ORDER BY i)) AS l FROM costs GROUP BY doc_id, g),
walked AS (SELECT doc_id, g, n, list_reduce(l, lambda a, b: {{'best': list_append(a.best, list_min(list_transform(b.c, lambda x: a.best[x.j + 1] + x.c))),
    'cut': list_append(a.cut, b.c[list_position(list_transform(b.c, lambda x: a.best[x.j + 1] + x.c), list_min(list_transform(b.c, lambda x: a.best[x.j + 1] + x.c)))].j), 'c': b.c}}).cut AS cut FROM steps),
spans AS (SELECT doc_id, g, cut, n, cut[n + 1] AS first, n AS stop FROM walked
  UNION ALL SELECT doc_id, g, cut, n, cut[first + 1], first FROM spans WHERE first > 0)"""
    inner = "g < max(g) OVER (PARTITION BY doc_id)" if strategy == "paragraph" else "false"
    return f"""{force_split('sents', 'doc_id, para_idx, sent_idx', most, 'pieces')},
{units},
{ranges},
joined AS (SELECT s.doc_id, s.g, s.first, any_value(s.stop = s.n) AS ends, string_agg(u.text, ' ' ORDER BY u.u) AS text FROM spans s JOIN units u ON s.doc_id = u.doc_id AND s.g = u.g AND u.u >= s.first AND u.u < s.stop GROUP BY ALL),
chunks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g, first) - 1)::INT AS chunk_idx, text, CASE WHEN ends AND {inner} THEN 'PARAGRAPH' ELSE 'SENTENCE' END AS boundary, length(text)::INT AS n_chars FROM joined)"""


def chunk_query(source: str, before: str, strategy: str, **limits) -> str:
    """The whole query: chunks of a table, `before` being CTEs that make it."""
    ctes = [c for c in (before, prepared(source), sentences("prep"), chunks(strategy, **limits)) if c]
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\nSELECT doc_id, chunk_idx, text, boundary, n_chars FROM chunks"
