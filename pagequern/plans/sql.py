"""Pieces of the SQL that core queries are checked against (DuckDB's dialect)."""

from __future__ import annotations

from ..functions import lexicons as X
from ..functions import summary, voting

WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(c: str, pattern: str, to: str) -> str:
    return f"regexp_replace({c}, {lit(pattern)}, {lit(to)}, 'g')"


def replace(c: str, a: str, b: str) -> str:
    return f"replace({c}, {lit(a)}, {lit(b)})"


def strip(c: str) -> str:
    return sub(c, f"^{WS}+|{WS}+$", "")


def clean(c: str) -> str:
    return strip(sub(f"regexp_replace({c}, {lit(WS + '*')} || chr(10) || {lit(WS + '*')}, chr(10), 'g')", r"[ \t]{2,}", " "))


def collapse(c: str) -> str:
    return f"coalesce(trim({sub(c, WS + '+', ' ')}, ' '), '')"


def title_entities(c: str) -> str:
    for s in X.TITLE_DASHES:
        c = replace(c, s, "-")
    for s in X.TITLE_QUOTES:
        c = replace(c, s, '"')
    return replace(c, chr(160), " ")


def norm_title(c: str) -> str:
    return collapse(f"regexp_replace({title_entities(c)}, '[!-/:-@\\[-`{{-~]', '', 'g')")


def cleaned_title(c: str) -> str:
    c = collapse(title_entities(c))
    for pattern in (r"^\d{1,2}[/.]\d{1,2}[/.]\d{2,4} +", r"^\d{1,2}[-:]\d{1,2}\d{0,2} +", rf"^{NOT_WORD}+ +", rf" +{NOT_WORD}+$"):
        c = f"regexp_replace({c}, {lit(pattern)}, '')"
    return c


def clean_entities(c: str) -> str:
    for char, name, number in X.ENTITIES:
        c = replace(replace(c, name, char), number, char)
    return c


def grams(c: str) -> str:
    return f"list_transform(range(1, greatest(length({c}) - 1, 1)), lambda i: substring({c}, i::BIGINT, 3))"


def charset_alias(c: str) -> str:
    return f"CASE lower({c}) " + " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in X.CHARSET_ALIASES.items()) + f" ELSE lower({c}) END"


def vocabulary_weight(c: str) -> str:
    return f"(CASE WHEN regexp_matches({c}, '(?i)^(?:{X.NEGATIVE})') THEN -25 ELSE 0 END + CASE WHEN regexp_matches({c}, '(?i)^(?:{X.POSITIVE})') THEN 25 ELSE 0 END)"


def tag_score(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} IN ({', '.join(map(lit, tags))}) THEN {s}" for s, tags in X.TAG_SCORES.items()) + " ELSE 0 END"


def unlikely(cls: str, id_: str, tag: str) -> str:
    s = f"(coalesce({cls}, '') || ' ' || coalesce({id_}, ''))"
    return f"length({s}) >= 2 AND regexp_matches({s}, '(?i){X.UNLIKELY}') AND NOT regexp_matches({s}, '(?i){X.MAYBE}') AND {tag} NOT IN ('html', 'body')"


def paragraph_score(c: str) -> str:
    return f"(2.0::DOUBLE + length({c}) - length(replace({c}, ',', '')) + least(length({c}) / 100.0::DOUBLE, 3.0))"


def escaped(c: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = replace(c, a, b)
    return c


NODES = "n AS MATERIALIZED (SELECT DISTINCT page_id, node_id, end_id, parent_id, depth, child_idx, tag, attrs, text, tail FROM nodes)"


def content(name: str, where: str) -> str:
    """A common table with the text content of the nodes that meet a condition."""
    return f"""{name} AS (SELECT e.page_id, e.node_id, string_agg(t.txt, '' ORDER BY t.pos, t.k, t.d) AS content FROM (SELECT * FROM n WHERE {where}) e JOIN (
    SELECT page_id, node_id, node_id AS pos, 0 AS k, 0 AS d, coalesce(text, '') AS txt FROM n UNION ALL SELECT page_id, node_id, end_id, 1, -depth, coalesce(tail, '') FROM n) t
    ON t.page_id = e.page_id AND t.node_id >= e.node_id AND t.node_id <= e.end_id AND NOT (t.k = 1 AND t.node_id = e.node_id) GROUP BY 1, 2)"""


CANDIDATES = f"""WITH {NODES}, {content('t', 'true')}, c AS MATERIALIZED (SELECT page_id, node_id, content, {clean('content')} AS cleaned FROM t),
    p AS (SELECT n.page_id, n.node_id, n.parent_id, g.parent_id AS grand_id, CASE n.tag WHEN 'p' THEN 0 WHEN 'pre' THEN 1 ELSE 2 END AS tag_rank, {paragraph_score('c.cleaned')} AS score
      FROM n JOIN c USING (page_id, node_id) JOIN n g ON g.page_id = n.page_id AND g.node_id = n.parent_id WHERE n.tag IN ('p', 'pre', 'td') AND length(c.cleaned) >= 25),
    gain AS (SELECT page_id, parent_id AS node_id, score, tag_rank, node_id AS p, 0 AS grand FROM p UNION ALL SELECT page_id, grand_id, score / 2, tag_rank, node_id, 1 FROM p WHERE grand_id IS NOT NULL),
    sums AS (SELECT page_id, node_id, sum(score) AS gain, arg_min(struct_pack(tag_rank, p, grand), tag_rank * 10000000 + p * 2 + grand) AS seq FROM gain GROUP BY 1, 2),
    ld AS (SELECT e.page_id, e.node_id, sum(length(c.cleaned)) AS links FROM n e JOIN n a ON a.page_id = e.page_id AND a.tag = 'a' AND a.node_id > e.node_id AND a.node_id <= e.end_id JOIN c ON c.page_id = a.page_id AND c.node_id = a.node_id GROUP BY 1, 2),
    s AS (SELECT s.page_id, s.node_id, s.seq.tag_rank AS tag_rank, s.seq.p AS first_p, s.seq.grand AS grand,
      ({vocabulary_weight("coalesce(n.attrs['class'], '')")} + {vocabulary_weight("coalesce(n.attrs['id'], '')")} + {tag_score('n.tag')} + s.gain) * (1 - coalesce(ld.links, 0) / greatest(length(c.cleaned), 1)) * (1 + length(c.content) / 500.0::DOUBLE) AS score
      FROM sums s JOIN n USING (page_id, node_id) JOIN c USING (page_id, node_id) LEFT JOIN ld USING (page_id, node_id))"""


def sentences(c: str) -> str:
    c = f"regexp_replace({c}, {lit(summary.GUARD + WS + '+')}, '\\1\\2.' || chr(1), 'g')"
    end = rf"([.!?…][”\"»’)]*){WS}+([\p{{Lu}}“\"„«(¿¡0-9])".replace('\\"', '"')
    c = f"regexp_replace({c}, {lit(end)}, '\\1' || chr(2) || '\\2', 'g')"
    c = f"replace(replace({c}, chr(10), chr(2)), chr(1), ' ')"
    return f"list_filter(list_transform(string_split({c}, chr(2)), lambda s: {strip('s')}), lambda s: length(s) > 0)"


def complete(c: str) -> str:
    bare = sub(c, r"^[ .!?…]+|[ .!?…]+$", "")
    return rf"regexp_matches({c}, '[.!?…]$') AND NOT regexp_matches({bare}, '^\p{{Nd}}+$') AND NOT regexp_matches({c}, {lit('^' + WS + '*[-—]')})"


def words(c: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower(replace({c}, 'İ', 'i')), '\p{{L}}+'))"


SENTS = f"""d AS (SELECT DISTINCT page_id, {sentences('description')} AS ss FROM articles WHERE description IS NOT NULL),
    sents AS MATERIALIZED (SELECT page_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS i FROM d), sets AS MATERIALIZED (SELECT page_id, i, {words('s')} AS w FROM sents)"""
EDGES = f"""WITH {SENTS}, edges AS MATERIALIZED (SELECT a.page_id, a.i, b.i AS j, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w))::DOUBLE AS w FROM sets a JOIN sets b ON a.page_id = b.page_id AND a.i <> b.i
    WHERE len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) > 0)"""


def ranks_sql(iterations: int) -> str:
    out = EDGES + """, o AS MATERIALIZED (SELECT page_id, i, sum(w) AS total FROM edges GROUP BY 1, 2), c AS (SELECT page_id, count(*) AS n FROM o GROUP BY 1), r0 AS (SELECT o.page_id, o.i, 1.0::DOUBLE / c.n AS r FROM o JOIN c USING (page_id))"""
    for k in range(1, iterations + 1):
        out += f""", r{k} AS MATERIALIZED (SELECT e.page_id, e.j AS i, 0.15::DOUBLE / any_value(c.n) + 0.85 * sum(e.w / o.total * r.r) AS r FROM edges e JOIN o ON o.page_id = e.page_id AND o.i = e.i JOIN r{k - 1} r ON r.page_id = e.page_id AND r.i = e.i JOIN c ON c.page_id = e.page_id GROUP BY 1, 2)"""
    return out


def language_vote(c: str, source: str, key: str) -> str:
    def ws(words_: str) -> str:
        return ", ".join(lit(w) for w in words_.split())

    votes = ", ".join(f"struct_pack(n := len(list_filter(t, lambda x: x IN ({ws(w)}))), o := {-i}, code := {lit(code)})" for i, (code, w) in enumerate(sorted(voting.FUNCTION_WORDS.items())))
    scripts = " ".join(rf"WHEN (length(l) - length(regexp_replace(l, '{rx}', '', 'g')))::DOUBLE / nullif(length(l), 0) >= {voting.SCRIPT_SHARE} THEN {lit(code)}" for code, rx in voting.SCRIPTS.items())
    return rf"""SELECT {key}, CASE WHEN length(l) = 0 THEN NULL {scripts} WHEN v.n > 0 THEN v.code END AS lang FROM (SELECT {key}, l, list_max([{votes}]) AS v FROM
    (SELECT {key}, regexp_replace({c}, '[^\p{{L}}]', '', 'g') AS l, regexp_extract_all(lower({c}), '\p{{L}}+') AS t FROM (SELECT DISTINCT {key}, {c} FROM {source} WHERE {c} IS NOT NULL)))"""
