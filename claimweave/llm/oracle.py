"""DuckDB counterparts of the registered queries that SQL can express."""

from __future__ import annotations

_SEPARATED = "regexp_matches(host || path, '(^|[^A-Za-z0-9]){}([^A-Za-z0-9]|$)')"
_PATTERNS = ("ads-track", "spam-farm", "casino", "adult", "pills", "bets", "porn", "spam", "xxx")
_UNDER = "((host = '{0}' OR host LIKE '%.{0}') AND path LIKE '{1}%')"
# Longest first; no two of one length fit one URL.
_RULES = (("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("net", "/", "block"))


def _cases(column: str) -> str:
    return " ".join(f"WHEN {_UNDER.format(h, p)} THEN '{h + p if column == 'rule' else v}'" for h, p, v in _RULES)


URL_FILTER = f"""
WITH rests AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
located AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
judged AS (
  SELECT *, CASE {_cases('rule')} END AS rule,
    CASE {' '.join(f"WHEN {_SEPARATED.format(p)} THEN '^{p}^'" for p in _PATTERNS)} END AS pattern FROM located)
SELECT page_id, host, path, rule,
  CASE {_cases('verdict')} WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern
FROM judged
"""

# Five hexadecimal digits at a time are four of base 32.
WARC = """
WITH hashed AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM hashed),
digits AS (
  SELECT *, list_transform(range(40), lambda i: strpos('0123456789abcdef', substr(hex, (i + 1)::INT, 1)) - 1) AS d FROM firsts),
numbers AS (
  SELECT *, list_transform(range(8), lambda i: d[5*i+1] * 65536 + d[5*i+2] * 4096 + d[5*i+3] * 256 + d[5*i+4] * 16 + d[5*i+5])
    AS n FROM digits)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n[i // 4 + 1] >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), 'string_agg', '')
    AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM numbers
"""



def _similar(words: int, percent: int, columns: str) -> str:
    """Components of documents whose sets of word n-grams are similar, by all pairs that share one."""
    return f"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
    lambda x: x <> '') AS w FROM documents),
placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM split),
runs AS (
  SELECT doc_id, i, n, concat_ws(' ', word, {", ".join(f"lead(word, {k}) OVER doc" for k in range(1, words))}) AS g
  FROM placed WINDOW doc AS (PARTITION BY doc_id ORDER BY i)),
grams AS (SELECT DISTINCT doc_id, g FROM runs WHERE i <= greatest(n - {words - 1}, 1)),
sets AS (SELECT split.doc_id, count(g) AS size FROM split LEFT JOIN grams USING (doc_id) GROUP BY ALL),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
edges AS (
  SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * n >= {percent} * (x.size + y.size - n)),
reached AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT doc_id, b FROM reached JOIN edges ON a = other),
found AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, size AS n_shingles, component_id{columns} FROM sets JOIN found USING (doc_id)
"""


def _rounds(n: int) -> str:
    """Every round assigns and moves; floors of quotients are taken exactly, in whole numbers."""
    steps = []
    for r in range(n + 1):
        steps.append(f"""
a{r} AS (
  SELECT vec_id, any_value(v) AS v, min(struct_pack(d, c)) AS nearest FROM (
    SELECT vec_id, kept.v, c, list_sum(list_transform(range(1, 65), lambda i: (kept.v[i] - c{r}.v[i]) * (kept.v[i] - c{r}.v[i])))::BIGINT AS d
    FROM kept, c{r}) GROUP BY vec_id)""")
        if r < n:
            steps.append(f"""
s{r} AS (SELECT nearest.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) AS t(i) GROUP BY ALL),
m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY c),
c{r + 1} AS (SELECT c{r}.c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))""")
    return ",".join(steps)


CENTROIDS = f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (
  SELECT sha256('2:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT 40)),{_rounds(5)}
SELECT vec_id, nearest.c::INT AS cluster, nearest.d AS distance,
  (sum(nearest.d) OVER (PARTITION BY nearest.c))::BIGINT AS cluster_inertia, (sum(nearest.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c5.v, ',')) AS centroid_sha256
FROM a5 JOIN c5 ON c5.c = nearest.c
"""


def _way(state: str, cost: str, edit: str, line: str | None) -> str:
    text = f"{state}.r || chr(10) || {line}" if line else f"{state}.r"
    return f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{edit}', r := {text})"


def _consumed(state: int) -> str:
    """Least way to a state by an edit that consumes the row; a million stands for what cannot be."""
    ways = [_way(f"s{state}", "4", "D", None)]
    for source in {0: (), 1: (), 2: (0, 1, 3), 3: (2,)}[state]:
        role = {2: "user", 3: "assistant"}[state]
        ways.append(_way(f"s{source}", "stay + 3", "R", f"'{role}:' || text"))
        ways.append(_way(f"s{source}", f"stay + CASE WHEN initial = '{role[0]}' THEN 0 ELSE 1000000 END", "K", "role || ':' || text"))
    if state == 1:
        ways.append(_way("s0", "stay + CASE WHEN initial = 's' THEN 0 ELSE 1000000 END", "K", "role || ':' || text"))
    return f"list_min([{', '.join(ways)}]) AS n{state}"


_U, _A = "'user:'", "'assistant:'"

CONVERSATIONS = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
planned AS (
  SELECT *, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(k) + 1), lambda i: ascii(k[i])::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS plan FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN plan = 4 THEN 'user' ELSE role END AS role,
    CASE plan WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN plan = 3 THEN 2 ELSE 1 END)) AS copy
  FROM planned WHERE plan <> 0),
ordered AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM damaged),
faults AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS previous FROM ordered),
faulty AS (
  SELECT *, NOT blank AND NOT duplicate AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS truncated FROM faults),
priced AS (
  SELECT *, CASE WHEN blank OR duplicate THEN 1000000 WHEN truncated THEN 3 ELSE 0 END AS stay FROM faulty),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (previous || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM faulty GROUP BY conv_id),
walked AS (
  SELECT conv_id, 0::BIGINT AS i, struct_pack(c := 0, a := '', r := '') AS s0, struct_pack(c := 1000000, a := '', r := '') AS s1,
    struct_pack(c := 3, a := 'I', r := chr(10) || {_U}) AS s2, struct_pack(c := 6, a := 'II', r := chr(10) || {_U} || chr(10) || {_A}) AS s3
  FROM counted
  UNION ALL
  SELECT conv_id, i, n0, n1, u2, list_min([n3, {_way("u2", "3", "I", _A)}]) FROM (
    SELECT *, list_min([n2, {_way("n0", "3", "I", _U)}, {_way("n1", "3", "I", _U)}, {_way("n3", "3", "I", _U)}]) AS u2 FROM (
      SELECT p.conv_id, p.i, {", ".join(_consumed(s) for s in range(4))}
      FROM walked JOIN priced p ON p.conv_id IS NOT DISTINCT FROM walked.conv_id AND p.i = walked.i + 1))),
ended AS (
  SELECT walked.conv_id, list_min([s0, s3]) AS way FROM walked JOIN counted ON counted.conv_id IS NOT DISTINCT FROM walked.conv_id AND n = i)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(way.c, 0)::BIGINT AS cost,
  coalesce(way.a, '') AS audit, sha256(coalesce(substr(way.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids
LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM ids.conv_id
"""

ORACLE: dict[str, str] = {
    "op1_url_filter": URL_FILTER, "op6_minhash_dedup": _similar(5, 75, ", doc_id = component_id AS kept"), "op9_warc": WARC,
    "op11_conversation_repair": CONVERSATIONS, "op12_centroid_clustering": CENTROIDS, "op13_ngram_jaccard_join": _similar(4, 85, "")}
