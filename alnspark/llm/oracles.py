"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i : i + 4], ' ') AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest(range(0, 5)) AS d) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(sum(base_failed::INT) AS DOUBLE) AS k FROM f WHERE source IS NOT NULL GROUP BY source),
t AS (SELECT sum(n) AS n, sum(k) AS k, count(*) AS hosts, sum(k * k / n) AS kk FROM h),
p AS (SELECT least(greatest(k / n, 1e-6), 1 - 1e-6) AS mean, kk / n - (k / n) * (k / n) AS spread, hosts, n FROM t),
b AS (SELECT mean, spread - mean * (1 - mean) * hosts / n AS between_hosts FROM p),
s AS (SELECT mean, CASE WHEN between_hosts > 0 THEN least(greatest(mean * (1 - mean) / between_hosts - 1, 1.0), 1000.0) ELSE 1000.0 END AS c FROM b),
v AS (SELECT source, (k + mean * c) / (n + c) > 0.5 AS rejected FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM f LEFT JOIN v USING (source)
"""

#: All pairs with a shingle in common, by the shingle; the links are closed over by recursion.
OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""

def _turn_repair() -> str:
    """The costs to go from a row on, with the edits' letters and lines, by recursion from each conversation's last row; as
    structs of cost, letters and lines, the least is the cheapest and of these the ASCII-least."""
    plus = lambda cost, letter, after, *line: f"{{'cost': {after}.cost + {cost}, 'audit': '{letter}' || {after}.audit, 'lines': {''.join(f'list_prepend({x}, ' for x in line)}{after}.lines{')' * len(line)}}}"
    end = lambda cost, letters, *lines: f"{{'cost': {cost}::BIGINT, 'audit': '{letters}', 'lines': {list(lines)}::VARCHAR[]}}"
    least = lambda *options: f"list_sort(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))[1]"
    plain = []
    for state, (to, name, roles) in enumerate([("s2", "user", {"s": "s1", "u": "s2"}), ("s2", "user", {"u": "s2"}), ("s3", "assistant", {"a": "s3"}), ("s2", "user", {"u": "s2"})]):
        keeps = [f"CASE WHEN left(role, 1) = '{r}' AND NOT gone THEN {plus('more', 'K', after, 'line')} END" for r, after in roles.items()]
        plain.append(least(plus(3, "D", f"s{state}"), *keeps, f"CASE WHEN NOT gone THEN {plus('2 + more', 'R', to, f"'{name}:' || text")} END"))
    user, assistant = "'user:'", "'assistant:'"
    return rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)), 4294967295::BIGINT) % 20 AS kind
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM k WHERE kind <> 0),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(coalesce(conv_id::VARCHAR, chr(30)) || chr(31) || role || chr(31) || text), copy) AS i,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM d),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
f AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM e),
r AS (SELECT conv_id, i, role, text, role || ':' || text AS line, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, coalesce((fault = 'truncated')::BIGINT, 0) AS more FROM f),
c AS (
  SELECT conv_id, max(i) + 1 AS i, {end(0, "")} AS s0, {end(4, "II", "user:", "assistant:")} AS s1, {end(2, "I", "assistant:")} AS s2, {end(0, "")} AS s3 FROM r GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, {least("p0", plus(2, "I", "b2", user))}, {least("p1", plus(2, "I", "b2", user))}, b2, b3 FROM (
    SELECT *, {least("p2", plus(2, "I", "p3", assistant))} AS b2, {least("p3", plus(2, "I", "p2", user))} AS b3 FROM (
      SELECT r.conv_id, r.i, {", ".join(f"{p} AS p{j}" for j, p in enumerate(plain))}
      FROM c JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.i = c.i - 1))),
a AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(s0.cost, 0)::BIGINT AS cost, coalesce(s0.audit, '') AS audit, sha256(coalesce(array_to_string(s0.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN (SELECT * FROM c WHERE i = 1) c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
"""


OP12 = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, row_number() OVER (PARTITION BY q.row ORDER BY list_inner_product(q.v, x.v) DESC, x.vec_id, x.row) AS rank,
    list_inner_product(q.v, x.v)::BIGINT AS score
  FROM v q JOIN v x ON q.row <> x.row WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM s WHERE rank <= 5
"""

OP13 = r"""
WITH piece AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
w AS (SELECT lang, count(*) AS m, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM piece GROUP BY lang, piece),
g AS (
  SELECT lang, m, words[i : i + k - 1] AS p
  FROM (SELECT lang, m, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 5)) AS k) WHERE len(words) >= k)),
f AS (SELECT lang, p, sum(m)::BIGINT AS a FROM g GROUP BY lang, p HAVING sum(m) >= 30),
total AS (SELECT lang, sum(m * len(words))::BIGINT AS n FROM w GROUP BY lang),
cut AS (
  SELECT c.lang, c.p, c.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a::HUGEINT + y.a) AS score
  FROM (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1) c
  JOIN f x ON x.lang = c.lang AND x.p = c.p[1 : k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1 :]),
s AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (
  SELECT lang, p[i : i + k - 1] AS p, max(a) AS longer
  FROM (SELECT lang, p, a, k, unnest(range(1, len(p) - k + 2)) AS i FROM f, (SELECT unnest([2, 3]) AS k) WHERE len(p) > k) GROUP BY 1, 2),
ranked AS (
  SELECT s.lang, array_to_string(s.p, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
  FROM s JOIN total USING (lang) LEFT JOIN inside i ON i.lang = s.lang AND i.p = s.p
  WHERE coalesce(100::HUGEINT * longer < 80::HUGEINT * a, true))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM ranked QUALIFY rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op1_host_quality": OP1,
    "op8_minmax_near_dedup": OP8,
    "op11_turn_repair": _turn_repair(),
    "op12_pivot_top_k": OP12,
    "op13_collocations": OP13,
}
