"""SQL twins of the queries that SQL can express. They share nothing with the operators."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *,
    CASE WHEN role IN ('user', 'assistant', 'system', 'tool') THEN length(role) ELSE length(role) + 1 END AS head,
    length(text)
      + length(text) - length(replace(text, '\', ''))
      + (length(text) - length(replace(text, '</turn>', ''))) // 7
      + length(text) - length(replace(text, '#', '')) - length(regexp_extract_all(text, '#+')) AS body
  FROM rows
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + head + 2 + body + 8) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP2 = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '%(upper)s', '%(lower)s') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), named AS (
  SELECT *, CASE WHEN regexp_matches(two, '%(registered)s') THEN two ELSE string_split(host, '.')[-1] END AS suffix,
    CASE WHEN regexp_matches(two, '%(registered)s') THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE two END AS domain,
    regexp_extract(path, '/(\d{1,18})(?:\.html)?/?$', 1) AS number
  FROM (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS two FROM parts)
), good AS (
  SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), counts AS (
  SELECT host, suffix, domain, CAST(count(*) AS DOUBLE) AS n, CAST(sum(good) AS DOUBLE) AS k
  FROM named JOIN good ON doc_id = TRY_CAST(number AS BIGINT) GROUP BY ALL
), overall AS (SELECT sum(k) / sum(n) AS rate0 FROM counts),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM counts GROUP BY ALL),
d AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM counts GROUP BY ALL),
units AS (
  SELECT 1 AS level, n, k, rate0 AS rate FROM s, overall
  UNION ALL SELECT 2, d.n, d.k, s.k / s.n FROM d JOIN s USING (suffix)
  UNION ALL SELECT 3, c.n, c.k, d.k / d.n FROM counts c JOIN d USING (suffix, domain)
), moments AS (
  SELECT level, (sum(n * (k / n - rate) * (k / n - rate)) - sum(rate * (1 - rate))) / nullif(sum(rate * (1 - rate) * (n - 1)), 0) AS r
  FROM units GROUP BY level
), strength AS (SELECT level, 1 / greatest(0.001, least(0.95, coalesce(r, 0.001))) - 1 AS m FROM moments),
m AS (SELECT max(m) FILTER (level = 1) AS m1, max(m) FILTER (level = 2) AS m2, max(m) FILTER (level = 3) AS m3 FROM strength),
rs AS (SELECT suffix, (k + m1 * rate0) / (n + m1) AS rate1 FROM s, overall, m),
rd AS (SELECT suffix, domain, (k + m2 * rate1) / (n + m2) AS rate2 FROM d JOIN rs USING (suffix), m),
hosts AS (SELECT DISTINCT host, suffix, domain FROM named),
posterior AS (
  SELECT h.host,
    CASE WHEN c.n IS NOT NULL THEN c.k + m3 * rate2 WHEN rate2 IS NOT NULL THEN m3 * rate2 WHEN rate1 IS NOT NULL THEN m2 * rate1 ELSE m1 * rate0 END AS a,
    CASE WHEN c.n IS NOT NULL THEN c.n - c.k + m3 * (1 - rate2) WHEN rate2 IS NOT NULL THEN m3 * (1 - rate2)
      WHEN rate1 IS NOT NULL THEN m2 * (1 - rate1) ELSE m1 * (1 - rate0) END AS b
  FROM hosts h LEFT JOIN counts c ON c.host = h.host LEFT JOIN rd ON rd.suffix = h.suffix AND rd.domain = h.domain
    LEFT JOIN rs ON rs.suffix = h.suffix LEFT JOIN overall ON true LEFT JOIN m ON true
), bound AS (
  SELECT host, a / nullif(a + b, 0) + 1.64 * sqrt(a * b / nullif((a + b) * (a + b) * (a + b + 1), 0)) AS upper FROM posterior
), ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule
  FROM named
)
SELECT page_id, r.host, path, rule, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN upper < rate0 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled r LEFT JOIN bound ON bound.host = r.host CROSS JOIN overall
""" % {"upper": _UPPER, "lower": _LOWER, "registered": r"^(ac|co|com|edu|go|gov|mil|ne|net|or|org|sch)\.[a-z]{2}$"}

OP4 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, '%(upper)s', '%(lower)s'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, '%(upper)s', '%(lower)s'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), ip AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, n, array_to_string(w[p : p + n - 1], ' ') AS s FROM ip),
dp AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw)),
hits AS (SELECT r, p, dp.n, item FROM dp JOIN iw ON iw.n = dp.n AND iw.s = array_to_string(w[p : p + dp.n - 1], ' ')),
places AS (SELECT DISTINCT r, unnest(range(p, p + n)) AS q FROM hits),
per_doc AS (SELECT r, count(*) AS n_hit FROM places GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN per_doc USING (r) LEFT JOIN items USING (r)
""" % {"upper": _UPPER, "lower": _LOWER}


# The crc32 of text is folded byte by byte over a table of 256 steps.
_CRC_TABLE = """crc_steps AS (
  SELECT list(v ORDER BY b) AS steps FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM (SELECT range AS b FROM range(256))
  )
)"""


def _crc32(octets: str) -> str:
    """crc32 of a list of bytes; `steps` must be in scope."""
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda a, b: xor(a >> 8, steps[CAST(xor(a, b) & 255 AS BIGINT) + 1])), 4294967295)"


_ID_BYTES = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"


def _leaf(n_chars: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text"]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({f}) AS VARCHAR) || ':' || {f}, '-')" for f in fields) + ")"


OP12 = f"""
WITH RECURSIVE {_CRC_TABLE}, leaves AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
    CASE WHEN coalesce({_crc32(_ID_BYTES)}, 0) % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS claim
  FROM documents, crc_steps
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size FROM leaves
), nodes AS (
  SELECT lang, 0 AS level, pos AS idx, size, leaf AS digest FROM numbered
  UNION ALL
  SELECT lang, level + 1, idx // 2, (size + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes
  WHERE size > 1 GROUP BY lang, level, idx // 2, size
), subroots AS (
  SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM nodes WHERE size = 1
), tops AS (
  SELECT 0 AS level, pos AS idx, size, digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, (size + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops
  WHERE size > 1 GROUP BY level, idx // 2, size
), climbed AS (
  SELECT n.doc_id, n.leaf, n.lang, n.claim, n.pos AS start, 0 AS level, n.pos AS idx, n.size, n.claim AS folded, '' AS path FROM numbered n
  UNION ALL
  SELECT c.doc_id, c.leaf, c.lang, c.claim, c.start, c.level + 1, c.idx // 2, (c.size + 1) // 2,
    sha256(CASE WHEN c.idx % 2 = 1 THEN s.digest || c.folded ELSE c.folded || coalesce(s.digest, '') END), c.path || coalesce(s.digest, '')
  FROM climbed c LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM c.lang AND s.level = c.level AND s.idx = xor(c.idx, 1)
  WHERE c.size > 1
), upper AS (
  SELECT c.doc_id, c.leaf, s.digest AS subroot, c.lang, c.start, 0 AS level, s.pos AS idx, s.size, c.folded, c.path
  FROM climbed c JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang WHERE c.size = 1
  UNION ALL
  SELECT c.doc_id, c.leaf, c.subroot, c.lang, c.start, c.level + 1, c.idx // 2, (c.size + 1) // 2,
    sha256(CASE WHEN c.idx % 2 = 1 THEN s.digest || c.folded ELSE c.folded || coalesce(s.digest, '') END), c.path || coalesce(s.digest, '')
  FROM upper c LEFT JOIN tops s ON s.level = c.level AND s.idx = xor(c.idx, 1)
  WHERE c.size > 1
)
SELECT doc_id, leaf, subroot, t.digest AS root, sha256(path) AS proof_sha256, folded AS folded_root, folded = t.digest AS verified
FROM upper u, tops t WHERE u.size = 1 AND t.size = 1
"""

OP11 = r"""
WITH RECURSIVE %(table)s, runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), '%(upper)s', '%(lower)s') AS run
  FROM documents
), counted AS (
  SELECT id, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, c, %(crc)s AS h FROM counted, crc_steps
), words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT c, CASE WHEN h %% 31 = 0 THEN substr(run, 1, h %% length(run)) || substr(run, h %% length(run) + 2) ELSE run END AS word FROM hashed
  ) WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2
), placed AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words
), less AS (
  SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM placed
), shorter AS (
  SELECT DISTINCT l.word AS a, w.word AS b FROM less l JOIN words w ON w.word = l.rest
), near AS (
  SELECT a, b FROM shorter UNION ALL SELECT b, a FROM shorter
  UNION ALL SELECT DISTINCT x.word, y.word FROM less x JOIN less y ON x.p = y.p AND x.rest = y.rest AND x.word <> y.word
), ranked AS (
  SELECT a, b, w.n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY w.n DESC, b) AS k FROM near JOIN words w ON w.word = b
), formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 10 * w.n THEN b END AS form, CASE WHEN r.n >= 10 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.a = w.word AND r.k = 1
), followed AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT f.word, f.next, g.form FROM followed f JOIN formed g ON g.word = f.next
)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM formed JOIN (SELECT word, root FROM followed WHERE next IS NULL) USING (word)
""" % {
    "table": _CRC_TABLE,
    "upper": _UPPER,
    "lower": _LOWER,
    "crc": _crc32("list_transform(regexp_extract_all(hex(id || ':' || run), '..'), lambda x: CAST('0x' || x AS BIGINT))"),
}


def oracle() -> dict[str, str]:
    return {"op1_chat_formatting": OP1, "op2_url_filter": OP2, "op4_decontamination": OP4, "op11_spelling_variants": OP11, "op12_merkle_manifest": OP12}
