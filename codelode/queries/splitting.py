"""The splitter as recursive SQL, stated apart from the library: level by level down the ladder, then window by window.

Its last rung, single characters, isn't stated: it is for parts above the limit that hold neither blanks nor line feeds, and such a
document would come out short here.
"""

from __future__ import annotations

#: Where to cut, by language, the best place first.
LADDER_SQL = r"""CASE language
    WHEN 'python' THEN [E'\nclass ', E'\ndef ', E'\n\tdef ', E'\n    def ', E'\n\n', E'\n', ' ']
    WHEN 'javascript' THEN [E'\nfunction ', E'\nconst ', E'\nlet ', E'\nclass ', E'\nif ', E'\nfor ', E'\n\n', E'\n', ' ']
    WHEN 'typescript' THEN [E'\ninterface ', E'\nfunction ', E'\nconst ', E'\nlet ', E'\nclass ', E'\nif ', E'\nfor ', E'\n\n', E'\n', ' ']
    WHEN 'markdown' THEN [E'\n# ', E'\n## ', E'\n### ', E'\n#### ', E'\n```\n', E'\n\n', E'\n', ' ']
    WHEN 'notebook' THEN [E'\n# [cell ', E'\nclass ', E'\ndef ', E'\n\n', E'\n', ' ']
    ELSE [E'\n\n', E'\n', ' '] END"""
WORDS_SQL = r"len(regexp_extract_all({0}, '[^\s]+'))"


def split_sql(docs: str, limit: int, overlap: int, count: str = WORDS_SQL) -> str:
    """Tables that end in `split` (ord, chunk_index, start_line, end_line, bare) for the rows of `docs` (ord, language, text). To follow WITH RECURSIVE."""
    return rf"""cut AS (
    SELECT ord, []::INT[] AS place, text AS part, {LADDER_SQL} AS ladder, {count.format('text')} AS size FROM {docs}
    UNION ALL
    SELECT ord, list_append(place, i::INT), part, ladder, {count.format('part')} FROM (
      SELECT ord, place, generate_subscripts(parts, 1) AS i, unnest(parts) AS part, ladder FROM (
        SELECT ord, place, ladder[rung + 1:] AS ladder, list_filter(list_transform(string_split(part, ladder[rung]), lambda p, i: CASE WHEN i > 1 THEN ladder[rung] ELSE '' END || p), lambda p: p <> '') AS parts
        FROM (SELECT *, list_position(list_transform(ladder, lambda s: contains(part[2:], s)), true) AS rung FROM cut WHERE size > {limit}) WHERE rung IS NOT NULL))),
  parts AS (SELECT ord, list(size ORDER BY place) AS sizes, list(length(part) ORDER BY place) AS lengths FROM cut WHERE size <= {limit} GROUP BY ord),
  sums AS (SELECT ord, len(sizes) AS n, t.total, p.place FROM parts,
    LATERAL (SELECT list(s ORDER BY i) AS total FROM (SELECT i, sum(x) OVER (ORDER BY i)::BIGINT AS s FROM (SELECT 0 AS i, 0 AS x UNION ALL SELECT generate_subscripts(sizes, 1), unnest(sizes)))) t,
    LATERAL (SELECT list(s ORDER BY i) AS place FROM (SELECT i, sum(x) OVER (ORDER BY i)::BIGINT AS s FROM (SELECT 0 AS i, 0 AS x UNION ALL SELECT generate_subscripts(lengths, 1), unnest(lengths)))) p),
  held AS (
    SELECT ord, 0::BIGINT AS lo, 1 + len(list_filter(total[3:], lambda x: x <= {limit}))::BIGINT AS hi FROM sums
    UNION ALL
    SELECT ord, lo, lo + 1 + len(list_filter(total[lo + 3:], lambda x: x - total[lo + 1] <= {limit})) FROM (
      SELECT ord, total, lo + len(list_filter(total[lo + 1:hi + 1], lambda x: total[hi + 1] - x > least({overlap}, {limit} - total[hi + 2] + total[hi + 1]))) AS lo
      FROM held JOIN sums USING (ord) WHERE hi < n)),
  joined AS (SELECT ord, lo, place[lo + 1] AS start, text[place[lo + 1] + 1:place[hi + 1]] AS t, text FROM held JOIN sums USING (ord) JOIN {docs} USING (ord)),
  bared AS (SELECT ord, lo, regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '') AS bare, text[:start + length(t) - length(regexp_replace(t, '^\s+', ''))] AS ahead FROM joined),
  split AS (SELECT ord, row_number() OVER (PARTITION BY ord ORDER BY lo) - 1 AS chunk_index, 1 + length(ahead) - length(replace(ahead, chr(10), '')) AS start_line,
    1 + length(ahead) - length(replace(ahead, chr(10), '')) + length(bare) - length(replace(bare, chr(10), '')) AS end_line, bare FROM bared WHERE bare <> '')"""
