"""The same results as SQL for DuckDB, where SQL can express them on whole tables."""

from __future__ import annotations

WORDS = r"len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))"

MIX = rf"""
    WITH d AS (
        SELECT doc_id, source, CAST(coalesce({WORDS}, 0) AS BIGINT) AS size,
               CAST('0x' || left(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) AS draw
        FROM documents),
    t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight, 3 * source_size AS cap FROM t),
    -- a source is clamped at its cap, or gets the level at which the rest share what is left
    l AS (
        SELECT a.source, (SELECT sum(source_size) FROM w) - coalesce(sum(b.cap) FILTER (WHERE b.cap / b.weight < a.cap / a.weight), 0) AS left_over,
               sum(b.weight) FILTER (WHERE b.cap / b.weight >= a.cap / a.weight) AS open_weight, any_value(a.cap / a.weight) AS ratio
        FROM w a CROSS JOIN w b GROUP BY a.source),
    s AS (SELECT max(left_over / open_weight) FILTER (WHERE left_over / open_weight <= ratio) AS level FROM l),
    p AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * level) AS target FROM w, s),
    r AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM p),
    c AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS rest,
                 sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size / 2 AS reach
          FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
    SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN reach <= rest THEN 1 ELSE 0 END) AS taken FROM c"""

# CRC-32 bit by bit: each byte is followed by eight marks, one for each shift.
_BITS = "list_concat([{start}], flatten(list_transform(range(1, length(hex({text})), 2), lambda i: [CAST('0x' || substr(hex({text}), i, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])))"
_STEP = "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"


def _crc32(text: str) -> str:
    bits = _BITS.format(start=4294967295, text=f"encode({text})")
    return f"xor(list_reduce({bits}, {_STEP}), 4294967295)"


def _lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


RESAMPLE = rf"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
    a AS (SELECT r, unnest(words) AS word FROM d),
    b AS (SELECT unnest(regexp_extract_all({_lower("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
    v AS MATERIALIZED (SELECT word, {_crc32("word")} % 10000 AS bucket FROM (SELECT word FROM a UNION SELECT word FROM b)),
    s AS (SELECT bucket, count(*) AS s FROM a JOIN v USING (word) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS t FROM b JOIN v USING (word) GROUP BY bucket),
    n AS (SELECT (SELECT count(*) FROM a) AS s_all, (SELECT count(*) FROM b) AS t_all),
    g AS (
        SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (s_all + 10000) / CAST((coalesce(s, 0) + 1) * (t_all + 10000) AS DOUBLE))) AS gain
        FROM s FULL JOIN t USING (bucket), n),
    w AS (SELECT r, sum(CAST(gain AS BIGINT)) AS total FROM a JOIN v USING (word) JOIN g USING (bucket) GROUP BY r),
    k AS (
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(CASE WHEN len(words) > 0 THEN floor(total / len(words)) ELSE 0 END AS BIGINT) AS weight,
               CAST('0x' || left(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) AS h
        FROM d LEFT JOIN w USING (r)),
    z AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM k),
    o AS (
        SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place,
               count(*) FILTER (WHERE n_features >= 20) OVER () * 10 // 100 AS wanted FROM z)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= wanted THEN place END AS rank FROM o"""

VARIANTS = rf"""
    WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all({_lower("text")}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
    p AS (SELECT doc_id, run, count(*) AS many FROM r WHERE length(run) >= 6 GROUP BY ALL),
    h AS (SELECT run, many, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM p),
    m AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, many FROM h),
    w AS MATERIALIZED (
        SELECT word, CAST(sum(many) AS BIGINT) AS n FROM m WHERE length(word) >= 6 GROUP BY word HAVING sum(many) >= 5),
    e AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
    holes AS (SELECT word, n, i, left(word, i - 1) AS head, substr(word, i + 1) AS tail FROM e),
    pairs AS (
        SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM holes a JOIN w b ON a.head || a.tail = b.word
        UNION SELECT b.word, a.word, a.n FROM holes a JOIN w b ON a.head || a.tail = b.word),
    best AS (
        SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
    forms AS MATERIALIZED (
        SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
        FROM w LEFT JOIN best USING (word)),
    path AS (
        SELECT word, word AS reached, 0 AS steps FROM forms
        UNION ALL SELECT path.word, forms.form, steps + 1 FROM path JOIN forms ON path.reached = forms.word WHERE forms.form IS NOT NULL),
    ends AS (SELECT word, arg_max(reached, steps) AS root FROM path GROUP BY word)
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)"""


def sql() -> dict[str, str]:
    return {"op1_mix_sources": MIX, "op12_target_resampling": RESAMPLE, "op13_spelling_variants": VARIANTS}
