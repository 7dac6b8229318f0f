"""SQL for another engine (DuckDB) that returns the same rows as the queries."""
from __future__ import annotations

from reqlens.llm import mixing, quality, secrets
from reqlens.llm.decontaminate import ITEM_WORD, LOWER, UPPER

WORD = r"[^\x20\x09-\x0D]+"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _items(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{ITEM_WORD}')"


LEAKS = f"""WITH d AS (SELECT doc_id, {_items('text')} AS w FROM documents),
  b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_items('text')} AS w FROM benchmark),
  win AS (SELECT DISTINCT item, w[i:i + 9] AS g FROM (
    SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
  place AS (SELECT doc_id, i, n, w[i:i + n - 1] AS g FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
    FROM d, (SELECT DISTINCT len(g) AS n FROM win) WHERE len(w) >= n)),
  hit AS (SELECT DISTINCT doc_id, i, n, item FROM place JOIN win USING (g)),
  words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (
    SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
  items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids
    FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _quality() -> str:
    rules = quality.QualityRules()
    counted = [f"len(regexp_replace(t, '[^{m}]', '', 'g'))" for m in (
        x.replace("'", "''") for x in quality.COUNTED.values())]
    symbol = quality.SYMBOL.replace("'", "''").replace(r"\x{80}-\x{10FFFF}", r"\x{80}-\x{10FFFF}")
    vocabulary = "[" + ", ".join(_q(w) for w in quality.VOCABULARY) + "]"
    some = f"[len(regexp_replace(t, '[\\x00-\\x7F]', '', 'g')), len(regexp_extract_all(t, '{symbol}')), " + ", ".join(counted) + "]"
    return f"""WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
  c AS (SELECT doc_id, lang, t, w, len(w)::BIGINT AS n_words, length(t)::BIGINT AS n_chars,
    coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    [l for l in string_split(t, chr(10)) if regexp_matches(l, '[^\\x20\\x09-\\x0D]')] AS ls,
    {some} AS parts, [lower(x) for x in w] AS lw FROM t),
  gram AS (SELECT doc_id, i, w[i:i + 7] AS g FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM c WHERE len(w) >= 8)),
  again AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS m FROM gram) WHERE m > 1) GROUP BY doc_id),
  f AS (SELECT doc_id, lang, n_words, n_chars, word_chars, n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words,
    list_concat(parts, [n_chars - word_chars, word_chars - list_sum(parts)]) AS chars,
    [len(list_filter(lw, lambda x: x = v)) for v in {vocabulary}] AS listed FROM c LEFT JOIN again USING (doc_id)),
  bins AS (SELECT doc_id, lang, 'c' AS part, n_chars AS total, n_chars >= {rules.judged_chars} AS judged,
      n_chars >= {rules.judged_chars} AND n_words >= {rules.judged_words} AS counts,
      generate_subscripts(chars, 1) AS bin, unnest(chars) AS k FROM f
    UNION ALL SELECT doc_id, lang, 'w', n_words, n_words >= {rules.judged_words},
      n_chars >= {rules.judged_chars} AND n_words >= {rules.judged_words},
      generate_subscripts(list_concat(listed, [0]), 1), unnest(list_concat(listed, [n_words - list_sum(listed)])) FROM f),
  sums AS (SELECT lang, part, bin, sum(floor(k * {quality.SCALE} / total)) AS s FROM bins
    WHERE counts AND lang IS NOT NULL GROUP BY ALL),
  ref AS (SELECT lang AS ref, part, bin, s / sum(s) OVER (PARTITION BY lang, part) AS q FROM sums),
  far AS (SELECT doc_id, lang, part, ref, sqrt(least(1, greatest(0, sum(
      (CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
       + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)))) AS js
    FROM (SELECT doc_id, lang, part, bin, k / total AS p FROM bins WHERE judged AND total > 0)
    JOIN ref USING (part, bin) WHERE ref = lang GROUP BY ALL),
  dist AS (SELECT doc_id, part, min(js) AS js FROM far GROUP BY ALL),
  out AS (SELECT f.*, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeated_percent} * n_words
      AS base_failed, coalesce(a.js, 0) AS cj, coalesce(b.js, 0) AS wj
    FROM f LEFT JOIN dist a ON a.doc_id = f.doc_id AND a.part = 'c' LEFT JOIN dist b ON b.doc_id = f.doc_id AND b.part = 'w')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND cj <= {rules.max_char_distance} AND wj <= {rules.max_word_distance} AS kept FROM out"""


def _found(kind: str, pattern: str, value: str, good: str) -> str:
    rank = secrets.KINDS.index(kind)
    p = _q(pattern)
    return f"""SELECT doc_id, source, '{kind}' AS kind, {rank} AS rank, value,
    list_sum([length(x) for x in gaps[1:i]]) + coalesce(list_sum([length(x) for x in ms[1:i - 1]]), 0) AS a, length(ms[i]) AS n
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i, unnest(vs) AS value FROM (SELECT doc_id, source,
    regexp_extract_all(t, {p}) AS ms, string_split_regex(t, {p}) AS gaps, {value.format(p=p)} AS vs FROM t)) WHERE {good}"""


def _secrets() -> str:
    whole = "regexp_extract_all(t, {p})"
    parts = [_found("assign", secrets.ASSIGN, "regexp_extract_all(t, {p}, 2)", "length(value) >= 6"),
             _found("access", secrets.ACCESS, whole, "true"), _found("hex", secrets.HEX, whole, "true"),
             _found("token", "[A-Za-z0-9_-]+", whole, "length(value) >= 20 AND regexp_matches(value, '[0-9]') "
                    "AND regexp_matches(value, '[A-Za-z]')")]
    return f"""WITH t AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
  every AS ({' UNION ALL '.join(parts)}),
  found AS (SELECT * FROM every e WHERE kind <> 'token' OR NOT EXISTS (SELECT 1 FROM every b WHERE
    b.doc_id = e.doc_id AND b.kind <> 'token' AND b.a < e.a + e.n AND e.a < b.a + b.n)),
  own AS (SELECT value, count(DISTINCT coalesce(source, chr(0))) <= 2 AND count(DISTINCT (source, doc_id)) <= 10 AS live
    FROM found GROUP BY value),
  span AS (SELECT doc_id, kind, rank, a, live, kind || ':' || a || ':' || (a + n) AS s FROM found JOIN own USING (value)),
  per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(s, ',' ORDER BY a, rank) FILTER (kind <> 'token') AS base,
    string_agg(s, ',' ORDER BY a, rank) FILTER (kind <> 'token' OR live) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM span GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
  coalesce(n_copied, 0) AS n_copied FROM documents LEFT JOIN per USING (doc_id)"""


NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
  sh AS (SELECT DISTINCT doc_id, w[i:i + 4] AS g FROM (
    SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
  common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b USING (g)
    WHERE a.doc_id <> b.doc_id GROUP BY ALL),
  link AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
    WHERE 100 * k >= 85 * (a.n + b.n - k)),
  reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
  least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)"""


def _mix() -> str:
    m = mixing.Mix()
    return f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size
    FROM documents),
  src AS (SELECT source, sum(size)::BIGINT AS source_size, {list(mixing.WEIGHTS)}[1 + (row_number() OVER (
    ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)}] AS w FROM d GROUP BY source),
  level AS (SELECT arg_min(lev, r) AS lev FROM (SELECT {m.max_passes} * source_size / w AS r,
    ((SELECT sum(source_size) FROM src) - coalesce(sum({m.max_passes} * source_size) OVER before, 0))
      / sum(w) OVER rest AS lev FROM src WINDOW before AS (ORDER BY source_size / w, source ROWS BETWEEN
        UNBOUNDED PRECEDING AND 1 PRECEDING), rest AS (ORDER BY source_size / w, source ROWS BETWEEN CURRENT ROW
        AND UNBOUNDED FOLLOWING)) WHERE lev <= r),
  tgt AS (SELECT source, source_size, least({m.max_passes} * source_size, lev * w)::DOUBLE AS target FROM src, level),
  blk AS (SELECT *, greatest(1, least({m.block_words}, floor(target / {m.slots_per_source})))::BIGINT AS block
    FROM tgt WHERE source_size > 0 AND target > 0),
  pl AS (SELECT *, ceil(source_size / block)::BIGINT AS blocks, target / block AS share,
    sum(target / block) OVER () AS every, sum(target / block) OVER (ORDER BY source NULLS LAST) AS hi FROM blk),
  plan AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY source NULLS LAST), 0) / every AS lo, hi / every AS top FROM pl),
  slot AS (SELECT t, list_sum([CASE WHEN substr(b, j, 1) = '1' THEN pow(2, -j) ELSE 0 END
    for j in range(1, length(b) + 1)]) AS u FROM (SELECT t, reverse(bin(t)) AS b
      FROM range((SELECT coalesce(max(round(every)), 0)::BIGINT FROM plan)) r(t))),
  ranked AS (SELECT source, blocks, row_number() OVER (PARTITION BY source ORDER BY t) - 1 AS k
    FROM slot JOIN plan ON u >= lo AND (u < top OR top >= 1)),
  uses AS (SELECT source, k % blocks AS at, count(*) AS uses FROM ranked WHERE k < {m.max_passes} * blocks GROUP BY ALL),
  place AS (SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY md5(concat_ws(':', '{m.seed}',
    coalesce(CAST(doc_id AS VARCHAR), '-'), size)), doc_id ROWS UNBOUNDED PRECEDING) - size AS f FROM d),
  piece AS (SELECT doc_id, place.source, size, f, block, unnest(range((f // block)::BIGINT, ((f + size - 1) // block)::BIGINT + 1)) AS at
    FROM place JOIN plan ON place.source IS NOT DISTINCT FROM plan.source WHERE size > 0),
  took AS (SELECT doc_id, sum((least(f + size, (piece.at + 1) * block) - greatest(f, piece.at * block)) * uses)::BIGINT AS taken
    FROM piece JOIN uses ON piece.source IS NOT DISTINCT FROM uses.source AND piece.at = uses.at GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken
FROM d JOIN tgt ON d.source IS NOT DISTINCT FROM tgt.source LEFT JOIN took USING (doc_id)"""


def _leaf(text: str) -> str:
    parts = [f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in (
        "CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)]
    return "sha256(" + " || ".join(parts) + ")"


# CRC-32 of the decimal doc_id, bit by bit, least bits of a byte first.
_CRC = """xor(list_reduce(flatten([[(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) >> b) & 1 for b in range(0, 8)]
      for i in range(1, length(CAST(doc_id AS VARCHAR)) + 1)]), lambda c, b:
      xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT), 4294967295::BIGINT)"""


def _manifest() -> str:
    # up: nodes of a tree by level; t is the source's tree ('=...', '-' for null) or 'all'.
    up = """SELECT t, level, k, digest, n FROM {leaves} UNION ALL
    SELECT t, level + 1, k // 3, sha256(string_agg(digest, '' ORDER BY k)), (max(n) + 2) // 3
    FROM {name} WHERE n > 1 GROUP BY t, level, k // 3"""
    return f"""WITH RECURSIVE d AS (SELECT *, coalesce('=' || source, '-') AS t, {_leaf('text')} AS digest,
    CASE WHEN {_CRC} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS cut FROM documents),
  leaf AS (SELECT *, 0 AS level, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, digest) - 1 AS k,
    count(*) OVER (PARTITION BY t) AS n FROM d),
  low AS ({up.format(leaves='leaf', name='low')}),
  sub AS (SELECT t AS src, digest FROM low WHERE n = 1),
  top AS (SELECT 'all' AS t, src, digest, 0 AS level, row_number() OVER (ORDER BY src) - 1 AS k, count(*) OVER () AS n FROM sub),
  high AS ({up.format(leaves='top', name='high')}),
  root AS (SELECT digest FROM high WHERE n = 1),
  path AS (SELECT leaf.doc_id, leaf.digest AS leaf, leaf.t, leaf.k AS me, 0 AS part, low.level, low.k, low.digest
      FROM leaf JOIN low ON low.t = leaf.t AND low.n > 1 AND low.k // 3 = leaf.k // CAST(pow(3, low.level + 1) AS BIGINT)
    UNION ALL SELECT leaf.doc_id, leaf.digest, leaf.t, top.k, 1, high.level, high.k, high.digest
      FROM leaf JOIN top ON top.src = leaf.t JOIN high ON high.n > 1 AND high.k // 3 = top.k // CAST(pow(3, high.level + 1) AS BIGINT)),
  fam AS (SELECT doc_id, t, leaf, part, level,
      coalesce(string_agg(digest, '' ORDER BY k) FILTER (k < me // CAST(pow(3, level) AS BIGINT)), '') AS l,
      coalesce(string_agg(digest, '' ORDER BY k) FILTER (k > me // CAST(pow(3, level) AS BIGINT)), '') AS r
    FROM path GROUP BY ALL),
  steps AS (SELECT doc_id, t, leaf, list(struct_pack(l := l, r := r) ORDER BY part, level) AS s FROM fam GROUP BY ALL),
  fold AS (SELECT leaf.doc_id, leaf.t, leaf.digest, 0::BIGINT AS i, coalesce(cut, leaf.digest) AS h, coalesce(s, []) AS s
      FROM leaf LEFT JOIN steps ON steps.doc_id IS NOT DISTINCT FROM leaf.doc_id AND steps.t = leaf.t AND steps.leaf = leaf.digest
    UNION ALL SELECT doc_id, t, digest, i + 1, sha256(s[i + 1].l || h || s[i + 1].r), s FROM fold WHERE i < len(s))
SELECT doc_id, fold.digest AS leaf, sub.digest AS subroot, root.digest AS root,
  sha256(array_to_string([x.l || x.r for x in s], '')) AS proof_sha256, h AS folded_root, h = root.digest AS verified
FROM fold JOIN sub ON sub.src = fold.t, root WHERE i = len(s)"""


ORACLE = {
    "op2_secret_ownership": _secrets(),
    "op3_source_schedule": _mix(),
    "op4_ngram_decontamination": LEAKS,
    "op5_divergence_rules": _quality(),
    "op9_minhash_inverted_join": NEAR,
    "op11_nested_intervals": _manifest(),
}
