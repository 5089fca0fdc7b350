"""SQL counterparts of the queries that SQL can express, written from the definitions of their results."""

from __future__ import annotations

from lakewarden.llm import mixing, personal

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
),
first AS (SELECT k, min(doc_id) AS lo FROM win GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (k) WHERE lo < doc_id
),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
one AS (
  SELECT w.doc_id, ws, coalesce(ps, []) AS ps FROM w LEFT JOIN lists ON w.doc_id = lists.doc_id
),
place AS (SELECT doc_id, ws, ps, unnest(range(1, len(ws) + 1)) AS p FROM one WHERE len(ps) > 0),
left_over AS (
  SELECT place.doc_id, string_agg(ws[place.p], ' ' ORDER BY place.p) AS kept
  FROM place LEFT JOIN gone ON place.doc_id = gone.doc_id AND place.p = gone.p
  WHERE gone.p IS NULL GROUP BY place.doc_id
)
SELECT one.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_removed,
  sha256(CASE WHEN len(ps) = 0 THEN array_to_string(ws, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM one LEFT JOIN left_over ON one.doc_id = left_over.doc_id
"""

#: Smallest id reached over the links ``links(a, b)``, both directions given.
REACHED = """
reach(node, root) AS (
  SELECT a, a FROM links UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node
),
least AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links(a, b) AS (
  SELECT x.vec_id, y.vec_id FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95
),
numbers AS (SELECT a, count(*) AS n FROM links GROUP BY a),
{REACHED}
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(root, vec_id) AS component_id,
  vec_id = coalesce(root, vec_id) AS kept
FROM embeddings LEFT JOIN numbers ON a = vec_id LEFT JOIN least ON node = vec_id
"""

JACCARD = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents
),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1)) AS i FROM w)
),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
),
links(a, b) AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
),
{REACHED}
SELECT documents.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(root, documents.doc_id) AS component_id
FROM documents LEFT JOIN sizes ON sizes.doc_id = documents.doc_id LEFT JOIN least ON node = documents.doc_id
"""


def _personal() -> str:
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "digits": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
    }
    luhn = (
        "list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(d)[i] AS INT) "
        "WHEN CAST(reverse(d)[i] AS INT) > 4 THEN 2 * CAST(reverse(d)[i] AS INT) - 9 ELSE 2 * CAST(reverse(d)[i] AS INT) END)) % 10 = 0"
    )
    # the code as one number: letters are 10 to 35, the first four go to the end
    code = "substr(c, 5) || substr(c, 1, 4)"
    number = (
        f"array_to_string(list_transform(string_split({code}, ''), lambda x: CASE WHEN ascii(x) >= 65 "
        "THEN CAST(ascii(x) - 55 AS VARCHAR) ELSE x END), '')"
    )
    mod97 = f"list_reduce(list_prepend(0, list_transform(string_split({number}, ''), lambda x: CAST(x AS INT))), lambda r, x: (r * 10 + x) % 97) = 1"
    tests = {
        "email": ("email", "true"),
        "ip": ("ip", "len(list_filter(string_split(m, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0"),
        "card": ("digits", f"len(d) BETWEEN 16 AND 19 AND {luhn}"),
        "phone": ("phone", "len(d) BETWEEN 8 AND 15"),
        "iban": (
            "iban",
            f"len(c) BETWEEN 15 AND 34 AND {mod97} AND NOT regexp_matches(before, '[A-Za-z0-9]$') AND NOT regexp_matches(after, '^[A-Za-z0-9]')",
        ),
        "card_short": (
            "digits",
            f"len(d) BETWEEN 13 AND 15 AND {luhn} AND regexp_matches(lower(before), '{personal.CONTEXT['card_short']}')",
        ),
    }
    parts = []
    for place, kind in enumerate(personal.KINDS):
        source, test = tests[kind]
        parts.append(
            f"""
  SELECT doc_id, {place} AS place, '{kind}' AS kind, s, s + len(m) AS e FROM (
    SELECT doc_id, m, regexp_replace(m, '[^0-9]', '', 'g') AS d, replace(m, ' ', '') AS c,
      right(gs[i], {personal.NEAR}) AS before, left(gs[i + 1], 1) AS after,
      list_sum(list_transform(gs[1 : i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1 : i - 1], lambda x: len(x))), 0) AS s
    FROM (
      SELECT doc_id, ms, gs, i, ms[i] AS m FROM (
        SELECT doc_id, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
          SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{plain[source]}') AS ms,
            string_split_regex(coalesce(text, ''), '{plain[source]}') AS gs FROM documents
        )
      )
    )
  ) WHERE {test}"""
        )
    body = " UNION ALL ".join(parts)
    joined = "string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY place, s)"
    counts = ", ".join(
        f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in personal.BASE
    )
    sums = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in personal.BASE)
    return f"""
WITH spans AS ({body}),
per AS (
  SELECT doc_id, {sums}, {joined} FILTER (place < 4) AS base, {joined} AS spans FROM spans GROUP BY doc_id
)
SELECT documents.doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN per ON per.doc_id = documents.doc_id
"""


def _mixing(evenness: float, repetition: float, budget: float) -> str:
    fan = mixing.FAN
    passes = ["b0 AS (SELECT CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi, false AS done)"]
    for k in range(mixing.PASSES):
        passes.append(
            f"""g{k} AS (SELECT k, lo + (hi - lo) * k / {fan}.0 AS x FROM b{k}, range(0, {fan + 1}) t(k)),
m{k} AS (
  SELECT k, x, sum(pow(share, x)) AS mass, sum(pow(share, x) * ln(share) * x) AS logs, max(pow(share, x - 1)) AS high
  FROM g{k}, shares WHERE share > 0 GROUP BY k, x
),
f{k} AS (
  SELECT coalesce(min(k) FILTER (ln(mass) - logs / mass <= {evenness!r} * ln(number) AND high / mass * {budget!r} <= {repetition!r}), {fan}) AS f
  FROM m{k}, totals
),
b{k + 1} AS (
  SELECT CASE WHEN done THEN lo WHEN f = 0 THEN (SELECT x FROM g{k} WHERE k = 0) ELSE (SELECT x FROM g{k} WHERE k = f - 1) END AS lo,
    CASE WHEN done THEN hi WHEN f = 0 THEN (SELECT x FROM g{k} WHERE k = 0) ELSE (SELECT x FROM g{k} WHERE k = f) END AS hi,
    done OR f = 0 AS done
  FROM b{k}, f{k}
)"""
        )
    return rf"""
WITH docs AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS key,
    len({WORDS}) AS tokens, coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || md5(coalesce(text, '')) AS row
  FROM documents
),
sources AS (SELECT key, sum(tokens) AS total FROM docs GROUP BY key),
totals AS (SELECT sum(total) AS everything, count(*) FILTER (total > 0) AS number FROM sources),
shares AS (SELECT key, total, total / CAST(everything AS DOUBLE) AS share FROM sources, totals),
{", ".join(passes)},
powers AS (SELECT key, total, CASE WHEN share > 0 THEN pow(share, hi) ELSE 0 END AS power FROM shares, b{mixing.PASSES}),
quotas AS (
  SELECT key, total, round(power / (SELECT sum(power) FROM powers), 9) AS weight FROM powers
),
wanted AS (
  SELECT key, total, weight, CAST(round(weight * (SELECT everything FROM totals) * {budget!r}) AS BIGINT) AS quota FROM quotas
),
copies AS (
  SELECT doc_id, source, tokens, row, total, weight, quota, docs.key,
    unnest(range(0, CAST(greatest(1, ceil(quota / greatest(total, 1))) AS BIGINT))) AS epoch
  FROM docs JOIN wanted ON docs.key = wanted.key WHERE quota > 0
),
placed AS (SELECT *, md5('mix|' || epoch || '|' || row) AS place FROM copies),
run AS (
  SELECT *, CAST(epoch * total + coalesce(sum(tokens) OVER (
    PARTITION BY key, epoch ORDER BY place, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
  FROM placed
)
SELECT doc_id, source, CAST(tokens AS BIGINT) AS tokens, CAST(round(weight * 1e9) AS BIGINT) AS weight_ppb,
  CAST(epoch AS INTEGER) AS epoch, off AS "offset",
  CAST(floor(off / greatest(1, CAST(round(weight * 100000) AS BIGINT))) AS BIGINT) AS block, place
FROM run WHERE off < quota
"""

AUDIT = r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
listed AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM docs),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    list_filter(['A', 'B', 'C', 'D', 'E'], lambda f: CASE f
      WHEN 'A' THEN len(ws) < 200
      WHEN 'B' THEN 100 * len(list_distinct(ws)) < 50 * len(ws)
      WHEN 'C' THEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t)
      WHEN 'D' THEN regexp_matches(t, '[#$%&*|]')
      ELSE coalesce(least < listed.doc_id, FALSE) END) AS fs
  FROM listed LEFT JOIN marks ON listed.doc_id = marks.doc_id
),
counted AS (SELECT part, good, toxic, fs, count(*) AS n FROM failed GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
steps AS (SELECT array_to_string(o, '') AS filter_order, CAST(step AS INTEGER) AS step, o[step] AS own, o[1 : step - 1] AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
cases AS (
  SELECT *, list_contains(fs, own) AS fails, list_has_any(fs, before) AS earlier FROM counted, steps
)
SELECT part, filter_order, step,
  CAST(sum(CASE WHEN NOT fails AND NOT earlier THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN fails AND NOT earlier THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN fails AND earlier THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN fails AND len(fs) = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN fails AND NOT earlier AND good = 1 THEN n ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN fails AND NOT earlier AND toxic = 1 THEN n ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN fails THEN n * 120 // len(fs) ELSE 0 END) AS BIGINT) AS shapley
FROM cases GROUP BY part, filter_order, step
"""

MIDDLE = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x
  FROM documents
),
draws AS (
  SELECT doc_id, t, n, CAST('0x' || x[1:8] AS BIGINT) % (n + 1) AS one, CAST('0x' || x[9:16] AS BIGINT) % (n + 1) AS two,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
      OR CAST('0x' || x[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || x[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
),
cuts AS (SELECT *, least(one, two) AS a, greatest(one, two) AS b FROM draws),
parts AS (
  SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM cuts
),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o
  FROM parts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars, sha256(o) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN o
    WHEN 'psm' THEN split_part(split_part(o, '<S>', 1), '<P>', 2) || split_part(o, '<M>', 2)
      || split_part(split_part(o, '<S>', 2), '<M>', 1)
    ELSE split_part(split_part(o, '<P>', 2), '<M>', 1) || split_part(o, '<M>', 2)
      || split_part(split_part(o, '<P>', 1), '<S>', 2) END) AS restored_sha256
FROM made
"""


ORACLE = {
    "op1_mixing": _mixing(0.95, 4.0, 1.0),
    "op4_substring": SUBSTRING,
    "op6_embeddings": EMBEDDINGS,
    "op7_personal": _personal(),
    "op8_jaccard": JACCARD,
    "op12_audit": AUDIT,
    "op13_middle": MIDDLE,
}
