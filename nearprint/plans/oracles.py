"""The registered queries as plain SQL for DuckDB."""

from __future__ import annotations

# Patterns and limits of the SQL's own, written for the given tables: nothing is taken from the
# code that is compared with it.
PAIR_THRESHOLD = 0.5
DENSE_THRESHOLD = 0.3
RECOMMENDATIONS = 3
NEWEST = 100
ENCODER_TOKEN = r"[\p{L}\p{N}_][\p{L}\p{N}_]+"
WORD_TOKEN = r"[\p{L}\p{N}_]+"
EDGE_SPACE = r"^[\s\x{00A0}]+|[\s\x{00A0}]+$"
LETTER_RUNS = r"\p{L}+|\P{L}+"
URL_ROOT = r"^(https?://[^/]+)"
COMMENT = r"(?s)<!--.*?-->"
SCRIPT = r"(?is)<script[^>]*>.*?</script>"
STYLE = r"(?is)<style[^>]*>.*?</style>"
TAG = r"<[^>]*>"
TITLE = r"(?s)<title>(.*?)</title>"
HEADLINE = r"(?s)<h1[^>]*>(.*?)</h1>"
ARTICLE = r"(?s)<article[^>]*>(.*?)</article>"
PARAGRAPH = r"<p(?:\s[^>]*)?>"
ANCHOR = r"(?s)<a\s[^>]*>.*?</a>"
HREF = r"\shref=[\"']([^\"']*)[\"']"

# The character references of the given pages, the ampersand last.
REFERENCES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&nbsp;": "\u00a0",
    "&copy;": "©",
    "&middot;": "·",
    "&amp;": "&",
}


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- expressions

def _decode(text: str) -> str:
    for entity, character in REFERENCES.items():
        text = f"replace({text}, {_quote(entity)}, {_quote(character)})"
    return text


def _strip(text: str) -> str:
    return f"regexp_replace({text}, {_quote(EDGE_SPACE)}, '', 'g')"


def _visible(markup: str) -> str:
    for pattern in (COMMENT, SCRIPT, STYLE):
        markup = f"regexp_replace({markup}, {_quote(pattern)}, '', 'g')"
    return markup


def _without_tags(markup: str) -> str:
    return _decode(f"regexp_replace({markup}, {_quote(TAG)}, '', 'g')")


def _title(markup: str = "html") -> str:
    return _without_tags(f"regexp_extract({markup}, {_quote(TITLE)}, 1)")


def _title_case(text: str) -> str:
    runs = f"regexp_extract_all({text}, {_quote(LETTER_RUNS)})"
    # The capital of a leading sharp s is "Ss", which upper() does not give here.
    capital = "CASE WHEN r[1] = 'ß' THEN 'Ss' ELSE upper(r[1]) END"
    return _strip(f"array_to_string(list_transform({runs}, lambda r: {capital} || lower(r[2:])), '')")


def _root(url: str) -> str:
    return f"regexp_extract({url}, {_quote(URL_ROOT)}, 1)"


def _anchors(table: str, extra: str) -> str:
    """One row per link: its position, decoded target and text."""
    return f"""
        SELECT {extra}, pos,
               {_decode(f"regexp_extract(a, {_quote(HREF)}, 1)")} AS href, {_without_tags("a")} AS txt
        FROM (SELECT {extra}, unnest(found) AS a, generate_subscripts(found, 1) AS pos
              FROM (SELECT {extra}, regexp_extract_all(html, {_quote(ANCHOR)}) AS found FROM {table}))"""


def _paragraphs(table: str = "pages") -> str:
    """``parts``: the paragraph texts of each page's article."""
    first = f"string_split_regex(p, {_quote("</p>")})[1]"
    return f"""
        SELECT page_id, url, visible, list_transform(
            string_split_regex(regexp_extract(visible, {_quote(ARTICLE)}, 1), {_quote(PARAGRAPH)})[2:],
            lambda p: {_without_tags(first)}) AS parts
        FROM (SELECT page_id, url, {_visible("html")} AS visible FROM {table})"""


# --- TF-IDF in plain SQL

ENCODER_WORDS = f"regexp_extract_all(lower(text), {_quote(ENCODER_TOKEN)})"


def _counts(name: str, documents: str) -> str:
    return f"""{name} AS (
        SELECT id, word, count(*) AS tf FROM (SELECT id, unnest({ENCODER_WORDS}) AS word FROM ({documents}))
        GROUP BY id, word)"""


def _vectors(documents: str, vocabulary: str | None = None, corpus: str | None = None) -> str:
    """CTEs ending in ``vec(id, word, i, w)`` and ``vocab(word, i)``."""
    basis = corpus or documents
    return f"""
    {_counts("tf", documents)}, {_counts("basis", basis)},
    df AS (SELECT word, count(*) AS df FROM basis GROUP BY word),
    words AS ({vocabulary or "SELECT word FROM df"}),
    vocab AS (SELECT word, CAST(row_number() OVER (ORDER BY word) - 1 AS INTEGER) AS i FROM words),
    raw AS (
        SELECT tf.id, tf.word, vocab.i,
               tf.tf * (ln((1.0 + (SELECT count(*) FROM ({basis}))) / (1.0 + coalesce(df.df, 0))) + 1.0) AS w
        FROM tf JOIN vocab USING (word) LEFT JOIN df USING (word)),
    vec AS (SELECT id, word, i, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw)"""


DOCUMENTS = "SELECT doc_id AS id, text FROM documents"
ENCODED = "SELECT id, i AS feature_matrix_index, round(w, 6) AS weight FROM vec"
KNOWN = "SELECT doc_id AS id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"
FRESH = "SELECT doc_id AS id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def _words_of(documents: str) -> str:
    return f"SELECT DISTINCT unnest({ENCODER_WORDS}) AS word FROM ({documents})"


PAIRS = f"""pairs AS (
        SELECT a.id, b.id AS similar_id, round(sum(a.w * b.w), 6) AS score
        FROM vec a JOIN vec b ON a.word = b.word AND a.id <> b.id
        GROUP BY a.id, b.id HAVING sum(a.w * b.w) > {PAIR_THRESHOLD})"""


# --- normalisation

STOPS = {
    "en": "the of and to in a is that it for was with as on be by at",
    "fr": "le la les de des du un une et est que qui en dans pour au",
    "de": "der die das und ist von zu den ein eine mit für im auf auch",
    "es": "el la los las de que y en un una se por con para su no",
}


def _normalised(where: str, lemmas: str) -> str:
    stops = ", ".join(
        f"({_quote(code)}, {_quote(word)})" for code, listed in STOPS.items() for word in listed.split()
    )
    return f"""
    WITH stop(lang, word) AS (VALUES {stops}),
    lemma AS ({lemmas}),
    found AS (SELECT doc_id, lang, regexp_extract_all(text, {_quote(WORD_TOKEN)}) AS f FROM documents {where}),
    placed AS (SELECT doc_id, lang, unnest(f) AS word, generate_subscripts(f, 1) AS pos FROM found),
    kept AS (SELECT p.* FROM placed p ANTI JOIN stop s ON s.lang = p.lang AND s.word = lower(p.word)),
    joined AS (
        SELECT doc_id, string_agg(lower(coalesce(lemma, kept.word)), ' ' ORDER BY pos) AS t
        FROM kept LEFT JOIN lemma ON lemma.word = kept.word GROUP BY doc_id)
    SELECT found.doc_id AS id, coalesce(t, '') AS processed_content FROM found LEFT JOIN joined USING (doc_id)"""


LEMMAS = f"""
    WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, {_quote(WORD_TOKEN)})) AS word FROM benchmark)
    SELECT word, left(word, length(word) - 1) AS lemma FROM w
    WHERE word LIKE '%s' AND left(word, length(word) - 1) IN (SELECT word FROM w)"""

def _english(text: str) -> str:
    """``norm(publication, id, processed_content)`` with the English stop words, whatever the language."""
    stops = ", ".join(_quote(word) for word in STOPS["en"].split())
    return f"""norm AS (
        SELECT source AS publication, CAST(doc_id AS VARCHAR) AS id, array_to_string(list_transform(list_filter(
            regexp_extract_all({text}, {_quote(WORD_TOKEN)}), lambda w: lower(w) NOT IN ({stops})), lambda w: lower(w)), ' ')
            AS processed_content FROM documents)"""


NORMAL = "SELECT id, processed_content AS text FROM norm"
KNOWN_NORMAL = f"{NORMAL} WHERE id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)"
FRESH_NORMAL = f"{NORMAL} WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)"
JOB_PAIRS = f"""pairs AS (
        SELECT a.id, b.id AS similar_id, round(sum(a.w * b.w), 6) AS score
        FROM vec a JOIN vec b ON a.word = b.word AND a.id <> b.id
        GROUP BY a.id, b.id HAVING sum(a.w * b.w) > 0.8)"""

API_FORMAT = "'%Y-%m-%dT%H:%M:%SZ'"


VERTICES = """
    WITH v AS (SELECT doc_id, md5(text) AS id, source AS publication, lang AS title,
                      CAST(n_chars AS VARCHAR) AS url FROM documents),
    stored AS (SELECT id, publication, title, url FROM v WHERE doc_id IN (SELECT doc_id FROM labels)
               QUALIFY row_number() OVER (PARTITION BY id ORDER BY publication, title, url) = 1),
    offered AS (SELECT DISTINCT id, publication, title, url FROM v),
    fresh AS (SELECT * FROM offered WHERE id NOT IN (SELECT id FROM stored)
              QUALIFY row_number() OVER (PARTITION BY id ORDER BY publication, title, url) = 1),
    merged AS (SELECT * FROM stored UNION ALL SELECT * FROM fresh)
    SELECT id, publication, title, url, false AS conflict FROM merged
    UNION ALL SELECT id, publication, title, url, true FROM (SELECT * FROM offered EXCEPT SELECT * FROM merged)"""


def sql() -> dict[str, str]:
    return {
        "scan_project_rename": """
            SELECT c_name AS name, c_custkey AS customer_key, c_mktsegment AS segment, c_nationkey AS nation_key
            FROM customer""",
        "param_query": """
            SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'""",
        "read_forms": """
            SELECT 'table' AS form, count(*) AS n_rows, false AS refused FROM labels
            UNION ALL SELECT 'query', count(*), false FROM labels
            UNION ALL SELECT 'query with params', count(*), false FROM labels WHERE quality = 1
            UNION ALL VALUES ('table and query', 0, true), ('table without schema', 0, true),
                             ('params without query', 0, true), ('nothing', 0, true)""",
        "stored_columns": """
            SELECT 1 AS position, 'l_shipdate' AS name, count(l_shipdate) AS n_values FROM lineitem
            UNION ALL SELECT 2, 'l_orderkey', count(l_orderkey) FROM lineitem
            UNION ALL SELECT 3, 'l_returnflag', count(l_returnflag) FROM lineitem""",
        "column_difference": """
            SELECT 'documents' AS origin, 'lang' AS name, count(lang) AS n_values FROM documents
            UNION ALL SELECT 'documents', 'n_chars', count(n_chars) FROM documents
            UNION ALL SELECT 'documents', 'source', count(source) FROM documents
            UNION ALL SELECT 'documents', 'text', count(text) FROM documents
            UNION ALL SELECT 'labels', 'quality', count(quality) FROM labels
            UNION ALL SELECT 'labels', 'toxic', count(toxic) FROM labels""",
        "min_max_column": """
            SELECT min(o_orderdate) AS min_date, max(o_orderdate) AS max_date,
                   min(o_totalprice) AS min_price, max(o_totalprice) AS max_price FROM orders""",
        "high_water_mark": f"SELECT strftime(max(ts), {API_FORMAT}) AS high_water_mark FROM events",
        "exists_value": "SELECT EXISTS (SELECT 1 FROM part WHERE p_type = 'ECONOMY') AS value_exists",
        "exists_in_table": """
            SELECT p_partkey, p_name FROM part WHERE EXISTS (
                SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity >= 45)""",
        "json_fields": """
            SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
        "json_page_explode": f"""
            SELECT md5(CAST(o_orderkey AS VARCHAR)) AS id, CAST(o_orderkey AS VARCHAR) AS guardian_id,
                   o_orderstatus AS content_type, CAST(o_custkey AS VARCHAR) AS section_id,
                   o_orderpriority AS section_name, date_trunc('second', o_orderdate) AS web_publication_timestamp,
                   'Order ' || o_orderkey AS web_title, 'https://shop.example/' || o_orderkey AS web_url
            FROM orders""",
        "json_error_rows": """
            SELECT 'events' AS origin, CAST(event_id AS VARCHAR) AS row_id, json_valid(props) AS readable,
                   CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') END AS k FROM events
            UNION ALL
            SELECT 'conversations', conv_id || '/' || turn, json_valid(text), NULL FROM conversations""",
        "unprocessed_anti_join": """
            SELECT doc_id, source, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
        "not_in_null_aware": """
            SELECT 'no_null' AS target, count(*) AS passed FROM documents
            WHERE doc_id NOT IN (SELECT doc_id FROM labels)
            UNION ALL
            SELECT 'with_null', count(*) FROM documents
            WHERE doc_id NOT IN (SELECT doc_id FROM labels UNION ALL SELECT NULL)""",
        "newest_unprocessed_topk": f"""
            SELECT o_orderkey, o_custkey, o_orderdate FROM orders
            WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
            ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT {NEWEST}""",
        "insert_new_only": """
            SELECT doc_id, quality, toxic FROM labels
            UNION ALL SELECT doc_id, 0, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
        "replace_contents": "SELECT doc_id, quality, 1 - toxic AS toxic FROM labels",
        "delete_by_key": """
            SELECT p_partkey, p_name, p_brand FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#17')""",
        "delete_in_partitions": """
            SELECT doc_id, n_chars, source, lang FROM documents
            WHERE NOT coalesce(lang = 'de' OR lang = 'fr' AND n_chars < 1000, false)""",
        "dedupe_keep_first": """
            SELECT doc_id, md5(text) AS text_id, source, lang, n_chars FROM documents
            QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1""",
        "dedupe_keep_last": """
            SELECT event_id, ts, user_id, event_type, value FROM events
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
        "union_metadata": f"""
            SELECT 'pages' AS publication, md5(url) AS id, {_title()} AS title, url FROM pages
            UNION SELECT 'documents', md5(text), source, lang FROM documents""",
        "concat_sources": """
            SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, source, NULL AS item_id FROM documents
            UNION ALL SELECT NULL, text, NULL, CAST(item_id AS VARCHAR) FROM benchmark""",
        "drop_incomplete": """
            SELECT doc_id, source, lang, quality, toxic FROM documents JOIN labels USING (doc_id)
            WHERE source IS NOT NULL AND lang IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL""",
        "vertex_merge": VERTICES,
        "md5_ids": "SELECT page_id, md5(url) AS id, url FROM pages",
        "timestamp_roundtrip": f"""
            SELECT event_id, strftime(ts, {API_FORMAT}) AS published, date_trunc('second', ts) AS ts FROM events""",
        "title_cleanup": f"""
            SELECT page_id, trim(regexp_replace(
                {_strip("replace(list_extract(string_split(t, ': '), -1), ' | ', '')")}, '\\s+', ' ', 'g')) AS title
            FROM (SELECT page_id, {_title()} AS t FROM pages)""",
        "title_case": f"""
            SELECT origin, key, {_title_case("name")} AS name FROM (
                SELECT 'part' AS origin, p_partkey AS key, p_name AS name FROM part
                UNION ALL SELECT 'customer', c_custkey, c_name || ' o''neil-' || c_mktsegment FROM customer)""",
        "vector_literal_roundtrip": """
            SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS slot,
                   CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings""",
        "absolute_links": f"""
            SELECT DISTINCT page_id, {_root("url")} || href AS link FROM ({_anchors("pages", "page_id, url")})
            WHERE NOT contains(href, 'pageOffset') AND href <> ''""",
        "author_directory": f"""
            SELECT columnist, homepage FROM (
                SELECT page_id, pos, {_title_case("txt")} AS columnist, {_root("url")} || href AS homepage
                FROM ({_anchors("pages", "page_id, url")}) WHERE href <> '')
            QUALIFY row_number() OVER (PARTITION BY columnist ORDER BY page_id DESC, pos DESC) = 1""",
        "author_article_links": f"""
            SELECT columnist, md5(link) AS article_id, link AS url FROM (
                SELECT DISTINCT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS columnist,
                       'https://news.example' || href AS link
                FROM ({_anchors("pages", "page_id, url")})
                WHERE href <> '' AND NOT contains(href, 'pageOffset'))
            QUALIFY row_number() OVER (PARTITION BY link ORDER BY page_id) = 1""",
        "page_text": f"""
            SELECT page_id, array_to_string(list_filter(list_transform(
                string_split_regex({_visible("html")}, {_quote(TAG)}),
                lambda node: {_strip(_decode("node"))}), lambda node: node <> ''), ' ') AS content FROM pages""",
        "article_paragraphs": f"""
            SELECT page_id, md5(url) AS id,
                   {_without_tags(f"regexp_extract(visible, {_quote(HEADLINE)}, 1)")} AS title,
                   CAST(len(parts) AS INTEGER) AS n_paragraphs, array_to_string(parts, ' ') AS content
            FROM ({_paragraphs()})""",
        "parsed_articles": f"""
            SELECT md5(url) AS id, url,
                   {_without_tags(f"regexp_extract(visible, {_quote(HEADLINE)}, 1)")} AS title,
                   array_to_string(parts, ' ') AS content
            FROM ({_paragraphs()})""",
        "parsed_without_excluded": """
            SELECT md5('https://news.example/' || conv_id) AS id, 'https://news.example/' || conv_id AS url,
                   'Conversation ' || conv_id AS title,
                   coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role <> 'assistant'), '') AS content
            FROM conversations GROUP BY conv_id""",
        "parsed_authors": f"""
            SELECT columnist, 'https://news.example' || href AS homepage FROM (
                SELECT url, pos, href, {_title_case("txt")} AS columnist
                FROM ({_anchors("pages", "url")}) WHERE href <> '')
            QUALIFY row_number() OVER (PARTITION BY columnist ORDER BY url DESC, pos DESC) = 1""",
        "parsed_author_links": f"""
            SELECT columnist, md5(link) AS article_id, link AS url FROM (
                SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS columnist,
                       'https://news.example' || href AS link
                FROM ({_anchors("pages", "url")}) WHERE href <> '' AND NOT contains(href, 'pageOffset'))
            QUALIFY row_number() OVER (PARTITION BY link ORDER BY columnist) = 1""",
        "tokenise": f"""
            SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS tokens
            FROM (SELECT doc_id, {ENCODER_WORDS} AS t FROM documents)""",
        "normalise_text": _normalised("", LEMMAS),
        "normalise_incremental": _normalised(
            "WHERE doc_id NOT IN (SELECT doc_id FROM labels)", "SELECT '' AS word, '' AS lemma WHERE false"
        ),
        "vocabulary": f"""
            WITH {_counts("basis", DOCUMENTS)}, df AS (SELECT word, count(*) AS df FROM basis GROUP BY word)
            SELECT word, CAST(row_number() OVER (ORDER BY word) - 1 AS INTEGER) AS feature_matrix_index, df AS document_frequency
            FROM df""",
        "tfidf_refit": f"WITH {_vectors(DOCUMENTS)} {ENCODED}",
        "tfidf_fixed_vocabulary": f"""
            WITH {_vectors(DOCUMENTS, _words_of("SELECT text FROM benchmark"))}
            SELECT d.doc_id AS id, CAST(i AS VARCHAR) AS feature_matrix_index, round(w, 6) AS weight
            FROM documents d LEFT JOIN vec ON vec.id = d.doc_id""",
        "tfidf_incremental_batch": f"WITH {_vectors(FRESH, _words_of(KNOWN))} {ENCODED}",
        "tfidf_incremental_corpus": f"WITH {_vectors(FRESH, _words_of(KNOWN), DOCUMENTS)} {ENCODED}",
        "tfidf_vectors": f"""
            WITH {_vectors(DOCUMENTS)}
            SELECT d.doc_id AS id, coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i), '') AS indices,
                   coalesce(string_agg(printf('%.5f', w), ',' ORDER BY i), '') AS weights
            FROM documents d LEFT JOIN vec ON vec.id = d.doc_id GROUP BY d.doc_id""",
        "tfidf_dense_vectors": f"""
            WITH {_vectors("SELECT p_partkey AS id, p_name AS text FROM part")}
            SELECT p_partkey AS id, string_agg(printf('%.5f', coalesce(w, 0.0)), ',' ORDER BY vocab.i) AS encoded
            FROM part CROSS JOIN vocab LEFT JOIN vec ON vec.id = p_partkey AND vec.i = vocab.i GROUP BY p_partkey""",
        "dense_cosine": f"""
            WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
            SELECT a.vec_id AS id, b.vec_id AS similar_id, round(list_cosine_similarity(a.e, b.e), 6) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) > {DENSE_THRESHOLD}""",
        "similar_groups": f"""
            WITH {_vectors(DOCUMENTS)}, {PAIRS},
            member AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort({ENCODER_WORDS})) AS id,
                              count(*) OVER (PARTITION BY list_sort({ENCODER_WORDS})) AS copies FROM documents),
            grp AS (SELECT id, copies FROM member WHERE id = doc_id)
            SELECT p.id, p.similar_id, p.score, a.copies, b.copies AS similar_copies
            FROM pairs p JOIN grp a ON a.id = p.id JOIN grp b ON b.id = p.similar_id WHERE p.id < p.similar_id""",
        "similar_pairs": f"""
            WITH {_vectors(DOCUMENTS)}, {PAIRS}
            SELECT id, similar_id AS similar_article_id, score AS similarity_score FROM pairs""",
        "annotated_pairs": f"""
            WITH {_vectors(DOCUMENTS)}, {PAIRS}
            SELECT a.source AS starting_publication, p.id AS starting_article_id, a.lang AS starting_title,
                   a.n_chars AS starting_url, b.source AS similar_publication, p.similar_id AS similar_article_id,
                   b.lang AS similar_title, b.n_chars AS similar_url, p.score AS similarity_score
            FROM pairs p LEFT JOIN documents a ON a.doc_id = p.id LEFT JOIN documents b ON b.doc_id = p.similar_id""",
        "cross_source_recommendations": f"""
            WITH {_vectors(DOCUMENTS)}, {PAIRS},
            ranked AS (
                SELECT p.id, a.source AS publication, p.similar_id, b.source AS similar_publication, p.score,
                       CAST(row_number() OVER (PARTITION BY p.id ORDER BY p.score DESC, p.similar_id) AS INTEGER) AS rank
                FROM pairs p JOIN documents a ON a.doc_id = p.id JOIN documents b ON b.doc_id = p.similar_id
                WHERE a.source <> b.source)
            SELECT * FROM ranked WHERE rank <= {RECOMMENDATIONS}""",
        "api_article_bodies": f"""
            SELECT 'https://api.example/' || doc_id AS api_url, {_strip("text")} AS content, true AS readable FROM documents
            UNION ALL SELECT 'https://api.example/cut/' || doc_id, NULL, false FROM labels""",
        "job_api_content": f"""
            SELECT md5('doc/' || doc_id) AS id, 'doc/' || doc_id AS guardian_id,
                   TIMESTAMP '2020-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER)) AS web_publication_timestamp,
                   'https://api.example/' || doc_id AS api_url, {_strip("text")} AS content,
                   'Document ' || doc_id AS web_title
            FROM documents ORDER BY documents.doc_id DESC LIMIT {2 * NEWEST}""",
        "job_quarantine": """
            SELECT DISTINCT 'api_content' AS job, 'https://api.example/cut/' || doc_id AS source, md5(coalesce(body, '')) AS body_id,
                   body, 'not a response' AS problem
            FROM (SELECT doc_id, '{"response": {"status": "ok", "content": ' || quality AS body FROM labels)""",
        "job_page_articles": f"""
            WITH landed AS (
                SELECT page_id, 'https://news.example' || regexp_extract(html, 'href="([^"]*)"', 1) AS url, html FROM pages
                QUALIFY row_number() OVER (PARTITION BY regexp_extract(html, 'href="([^"]*)"', 1) ORDER BY page_id) = 1),
            link AS ({_anchors("landed", "page_id, url")}),
            author AS (
                SELECT columnist, homepage FROM (
                    SELECT url, pos, {_title_case("txt")} AS columnist, 'https://news.example' || href AS homepage
                    FROM link WHERE href <> '')
                QUALIFY row_number() OVER (PARTITION BY columnist ORDER BY url DESC, pos DESC) = 1),
            claimed AS (
                SELECT columnist, 'https://news.example' || href AS target FROM link JOIN author ON url = homepage
                WHERE href <> '' AND NOT contains(href, 'pageOffset')
                QUALIFY row_number() OVER (PARTITION BY target ORDER BY columnist) = 1)
            SELECT 'Pages' AS publication, columnist, md5(url) AS id, url,
                   {_without_tags(f"regexp_extract(visible, {_quote(HEADLINE)}, 1)")} AS title,
                   array_to_string(parts, ' ') AS content
            FROM ({_paragraphs("landed")}) JOIN claimed ON url = target""",
        "job_normalise": f"WITH {_english('text')} SELECT * FROM norm",
        "job_encode": f"""
            WITH {_english("text")}, {_vectors(NORMAL)}
            SELECT norm.id, CAST(i AS VARCHAR) AS feature_matrix_index, round(w, 6) AS weight FROM norm LEFT JOIN vec ON vec.id = norm.id""",
        "job_similar_articles": f"""
            WITH {_english("text")}, {_vectors(NORMAL)}, {JOB_PAIRS}
            SELECT id, similar_id AS similar_article_id, score AS similarity_score FROM pairs""",
        "job_similar_incremental": f"""
            WITH {_english("text")}, {_vectors(NORMAL)}, {JOB_PAIRS}
            SELECT id, similar_id AS similar_article_id, score AS similarity_score FROM pairs""",
        "job_encode_incremental": f"""
            WITH {_english("text")},
            both_parts AS (
                FROM (WITH {_vectors(KNOWN_NORMAL)} SELECT id, i, w FROM vec)
                UNION ALL FROM (WITH {_vectors(FRESH_NORMAL, _words_of(KNOWN_NORMAL), NORMAL)} SELECT id, i, w FROM vec))
            SELECT norm.id, CAST(i AS VARCHAR) AS feature_matrix_index, round(w, 6) AS weight
            FROM norm LEFT JOIN both_parts ON both_parts.id = norm.id""",
        "job_recommendations": f"""
            WITH {_english("text")}, {_vectors(NORMAL)}, {JOB_PAIRS},
            meta AS (SELECT source AS publication, CAST(doc_id AS VARCHAR) AS id, lang AS title,
                            'https://docs.example/' || doc_id AS url FROM documents)
            SELECT a.publication AS starting_publication, a.id AS starting_article_id, a.title AS starting_title, a.url AS starting_url,
                   b.publication AS similar_publication, b.id AS similar_article_id, b.title AS similar_title, b.url AS similar_url,
                   p.score AS similarity_score,
                   CAST(row_number() OVER (PARTITION BY p.id ORDER BY p.score DESC, p.similar_id) AS INTEGER) AS rank
            FROM pairs p JOIN meta a ON a.id = p.id JOIN meta b ON b.id = p.similar_id
            WHERE a.publication <> b.publication QUALIFY rank <= {RECOMMENDATIONS}""",
        "expand_contractions": f"""
            WITH {_english("'do not ' || text || ' we will'")}
            SELECT CAST(id AS BIGINT) AS id, processed_content FROM norm""",
        "strip_key_padding": "SELECT c_custkey, c_name AS name FROM customer",
        "text_beginnings": """
            SELECT doc_id, left(text, 20) AS first_chars,
                   array_to_string(string_split_regex(text, '\\s+')[1:5], ' ') AS first_words FROM documents""",
        "vertices_from_csv": VERTICES,
        "csv_append_roundtrip": """
            SELECT c_name || ', "' || c_mktsegment || '"' AS name, c_nationkey AS nation FROM customer
            UNION ALL SELECT s_name, s_nationkey FROM supplier""",
        "sorted_export": """
            SELECT row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS position, o_orderkey, o_custkey, o_totalprice FROM orders""",
        "stream_ingest_new_only": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
    }
