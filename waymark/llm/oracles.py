"""DuckDB SQL for those contract queries that SQL can express."""

from __future__ import annotations

from waymark.llm import decontamination, licenses

_WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
 f AS (SELECT payload_digest AS g, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f ON g = payload_digest"""

#: Code points by ``substr``; what is restored is the text itself.
_FILL_MIDDLE = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
 h AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
 c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
 p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

#: Every window as text, its first place, and the words that later places cover.
_SUBSTRINGS = """WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 x AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d),
 k AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS v FROM x),
 f AS (SELECT *, first_value(doc_id) OVER o = doc_id AND first_value(i) OVER o = i AS first FROM k WINDOW o AS (PARTITION BY v ORDER BY doc_id, i)),
 g AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 20)))) AS gone FROM f WHERE NOT first GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(array_to_string(list_filter(w, lambda v, i: NOT coalesce(list_contains(gone, i), false)), ' ')) AS kept_sha256 FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""

#: Rebuilt turns, a node for each prefix (its turns' hashes, joined), and sums over the nodes that each prefix leads to; the CRC bit by bit.
_TRIE = """WITH t0 AS (SELECT conv_id, turn, sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS key, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
 t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) - 1 AS pos FROM t0),
 z AS (SELECT conv_id, count(*) AS n FROM t GROUP BY 1),
 c AS (SELECT conv_id, n, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
   lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT) % 4 AS h FROM z),
 p AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(z.n, 0)) AS taken, least(c.h, coalesce(z.n, 0)) + greatest(c.n - c.h, 0) AS size FROM c LEFT JOIN z ON z.conv_id = c.base),
 r AS (SELECT p.conv_id, pos + 1 AS d, key, words FROM p JOIN t ON t.conv_id = p.base AND pos < h UNION ALL SELECT p.conv_id, taken + pos - h + 1, key, words FROM p JOIN t ON t.conv_id = p.conv_id AND pos >= h),
 m AS (SELECT conv_id, d, string_agg(key, ',') OVER (PARTITION BY conv_id ORDER BY d) AS node, words FROM r UNION ALL SELECT conv_id, 0, '', 0 FROM p),
 g AS (SELECT d, node, min(m.conv_id) AS first, count(*) AS n, any_value(words) AS words, string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) FILTER (d = size) AS ends FROM m JOIN p ON p.conv_id = m.conv_id GROUP BY d, node),
 u AS (SELECT g.first AS conv_id, g.d, g.n, g.ends, up.first AS parent, (g.n - 1) * g.words AS own FROM g LEFT JOIN m ON m.conv_id = g.first AND m.d = g.d - 1 LEFT JOIN g up ON up.d = m.d AND up.node = m.node),
 k AS (SELECT parent, d - 1 AS d, count(*) AS n_children FROM u WHERE d > 0 GROUP BY 1, 2),
 s AS (SELECT a.first AS conv_id, a.d, count(*) FILTER (k.parent IS NULL) AS n_leaves, sum(u.own) AS saved FROM u LEFT JOIN k ON k.parent = u.conv_id AND k.d = u.d JOIN m ON m.conv_id = u.conv_id AND m.d <= u.d JOIN g a ON a.d = m.d AND a.node = m.node GROUP BY 1, 2)
SELECT u.conv_id, u.d AS depth, u.parent AS parent_conv_id, u.n AS n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(u.ends, '')) AS ends_sha256
FROM u JOIN s ON s.conv_id = u.conv_id AND s.d = u.d LEFT JOIN k ON k.parent = u.conv_id AND k.d = u.d"""


def _decontamination() -> str:
    """The same overlaps by equality of the counted words themselves, without hashes; runs by trying every pair of ends."""
    d = decontamination
    words = lambda t: f"list_filter(string_split_regex(lower(coalesce({t}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"

    def places(source: str, key: str, name: str) -> str:
        parts = []
        for mask, offsets in enumerate(d.MASKS):
            counted = " || ' ' || ".join(f"w[i + {o}]" for o in offsets)
            parts.append(f"SELECT {key}, {mask} AS mask, i, {counted} AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - {d.SPAN - 2})) AS i FROM {source})")
        return f"{name} AS ({' UNION ALL '.join(parts)})"

    return f"""WITH dw AS (SELECT doc_id, {words("text")} AS w FROM documents), iw AS (SELECT * FROM (SELECT item_id, {words("text")} AS w FROM benchmark) WHERE len(w) >= {d.LEAST}),
 {places("dw", "doc_id", "dp")}, {places("iw", "item_id", "ip")},
 m AS (SELECT DISTINCT doc_id, item_id, dp.i - ip.i AS diagonal FROM dp JOIN ip USING (mask, g)),
 e AS (SELECT doc_id, item_id, len(iw.w) AS n, diagonal, dw.w AS dw, iw.w AS iw, unnest(range(1, len(iw.w) + 1)) AS i FROM m JOIN dw USING (doc_id) JOIN iw USING (item_id)),
 q AS (SELECT doc_id, item_id, n, diagonal, i, i + diagonal AS pos FROM e WHERE i + diagonal >= 1 AND dw[i + diagonal] = iw[i]),
 b AS (SELECT doc_id, item_id, n, true AS whole, 0 AS half, diagonal AS band, pos, i FROM q UNION ALL SELECT doc_id, item_id, n, false, half, floor((diagonal + half * {d.BAND // 2}) / {d.BAND}), pos, i FROM q, (VALUES (0), (1)) h(half)),
 p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, whole, half, band ORDER BY pos) AS r FROM (SELECT DISTINCT doc_id, item_id, n, whole, half, band, pos FROM b)),
 s AS (SELECT x.doc_id, x.item_id, x.n, x.whole, x.half, x.band, x.pos AS start, y.pos AS stop, y.r - x.r + 1 AS c,
   row_number() OVER (PARTITION BY x.doc_id, x.item_id, x.whole, x.half, x.band ORDER BY {d.GAIN} * (y.r - x.r) - (y.pos - x.pos) DESC, y.pos, x.pos DESC) AS k
   FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.item_id = y.item_id AND x.whole = y.whole AND x.half = y.half AND x.band = y.band AND x.r <= y.r),
 l AS (SELECT s.doc_id, s.item_id, s.n, s.whole, least(c, (SELECT count(DISTINCT b.i) FROM b WHERE b.doc_id = s.doc_id AND b.item_id = s.item_id AND b.whole = s.whole AND b.half = s.half AND b.band = s.band AND b.pos BETWEEN s.start AND s.stop)) AS n_matched,
   start, stop - start + 1 AS length FROM s WHERE k = 1),
 g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY whole DESC, n_matched DESC, start, length DESC) AS k FROM l
   WHERE n_matched >= greatest({d.LEAST - 1}, CASE WHEN whole THEN ceil({d.SHARE} * n) ELSE least(ceil({d.SHARE} * n), {d.PASSAGE}) END) AND n_matched >= {d.DENSITY} * length)
SELECT doc_id, item_id, CAST(n_matched AS BIGINT) AS n_matched, CAST(n AS BIGINT) AS n_item, CAST(start - 1 AS BIGINT) AS start, CAST(length AS BIGINT) AS length FROM g WHERE k = 1"""


def _licenses() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = []
    for at, (name, text) in enumerate(licenses.TEMPLATES):
        rows.append(f"({at}, {quote(name)}, [{', '.join(quote(b) for b in sorted(licenses.bigrams_of(text)))}])")
    return f"""WITH t(k, name, b) AS (VALUES {", ".join(rows)}),
 s AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9\\n]+', ' ', 'g') AS x FROM documents WHERE text IS NOT NULL),
 u AS (SELECT doc_id, unnest(list_distinct(list_transform(list_concat(string_split(x, chr(10)), CASE WHEN regexp_matches(x, '\\n ?\\n') THEN string_split_regex(x, '\\n(?: ?\\n)+') ELSE [] END, [x]), lambda v: trim(replace(v, chr(10), ' '))))) AS v FROM s),
 w AS (SELECT doc_id, string_split_regex(v, ' +') AS w FROM u WHERE v <> ''),
 p AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS p FROM w WHERE len(w) > 1),
 d AS (SELECT doc_id, name, k, 2.0::DOUBLE * len(list_intersect(p, b)) / (len(p) + len(b)) AS dice, row_number() OVER () AS r, p FROM p, t WHERE len(p) BETWEEN {licenses.THRESHOLD} / (2 - {licenses.THRESHOLD}) * len(b) AND (2 - {licenses.THRESHOLD}) / {licenses.THRESHOLD} * len(b)),
 h AS (SELECT doc_id, p, arg_min(name, k - dice * 1000000) AS name, max(dice) AS dice, min(k - dice * 1000000) AS o FROM d WHERE dice >= {licenses.THRESHOLD} GROUP BY doc_id, p),
 f AS (SELECT doc_id, arg_min(name, o) AS license, max(dice) AS dice, count(*) AS n_units FROM h GROUP BY doc_id)
SELECT a.doc_id, license, round(dice, 6) AS dice, coalesce(n_units, 0) AS n_units FROM documents a LEFT JOIN f ON f.doc_id = a.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": _decontamination(), "op6_license_scan": _licenses(), "op10_warc": _WARC, "op11_fill_middle": _FILL_MIDDLE, "op12_substring_dedup": _SUBSTRINGS, "op13_conversation_trie": _TRIE}
