"""One query per operator, over the given tables.

Every query reads its tables whole.  The same results in SQL are in
:mod:`nearprint.plans.oracles`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearprint.functions import html, scalar, tokens
from nearprint.operators import dense, keyed, recommend, similarity, text, tfidf
from nearprint.sources import api, files, sites
from nearprint.sources.store import TableStore, min_or_max
from nearprint.storage import materialise, new_folder, sent_if_small
from nearprint.streaming.ingest import ingest_new_only

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

PAIR_THRESHOLD = 0.5
DENSE_THRESHOLD = 0.3
RECOMMENDATIONS = 3
NEWEST = 100
PAGE_SIZE = 200
# Plain lists, so that the same words can stand in the SQL.
STOPS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "with", "as", "on", "be", "by", "at"),
    "fr": ("le", "la", "les", "de", "des", "du", "un", "une", "et", "est", "que", "qui", "en", "dans", "pour", "au"),
    "de": ("der", "die", "das", "und", "ist", "von", "zu", "den", "ein", "eine", "mit", "für", "im", "auf", "auch"),
    "es": ("el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "se", "por", "con", "para", "su", "no"),
}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def load_texts(spark: SparkSession, sf_dir: str, table: str, *columns: Column | str) -> DataFrame:
    """Columns of a table whose rows are costly to work on."""
    return load(spark, sf_dir, table).select(*columns)


def scratch_store(spark: SparkSession) -> tuple[TableStore, str]:
    """A store and a schema of its own in the shared folder."""
    schema = f"np_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {schema} LOCATION '{new_folder(spark, schema)}'")
    return TableStore(spark), schema


# --- reading

@query
def scan_project_rename(spark, sf_dir):
    renamed = load(spark, sf_dir, "customer").drop("c_acctbal").withColumnsRenamed({
        "c_custkey": "customer_key", "c_name": "name", "c_nationkey": "nation_key", "c_mktsegment": "segment",
    })
    return renamed.select("name", "customer_key", "segment", "nation_key")


@query
def param_query(spark, sf_dir):
    load(spark, sf_dir, "orders").createOrReplaceTempView("np_orders")
    return TableStore(spark).read(
        query="SELECT o_orderkey, o_custkey, o_totalprice FROM IDENTIFIER(:t) WHERE o_orderpriority = :p",
        params={"t": "np_orders", "p": "1-URGENT"},
    )


@query
def read_forms(spark, sf_dir):
    """Rows that each form of reading gives; forms that contradict themselves are refused."""
    store, schema = scratch_store(spark)
    store.write(load(spark, sf_dir, "labels"), "labels", schema)
    whole = f"SELECT * FROM {schema}.labels"
    forms = {
        "table": {"table": "labels", "schema": schema},
        "query": {"query": whole},
        "query with params": {"query": f"{whole} WHERE quality = :q", "params": {"q": 1}},
        "table and query": {"table": "labels", "schema": schema, "query": whole},
        "table without schema": {"table": "labels"},
        "params without query": {"table": "labels", "schema": schema, "params": {"q": 1}},
        "nothing": {},
    }
    read, refused = [], []
    for form, given in forms.items():
        try:
            read.append(store.read(**given).agg(F.lit(form).alias("form"), F.count("*").alias("n_rows"), F.lit(False).alias("refused")))
        except ValueError:
            refused.append((form, 0, True))
    return keyed.concat([*read, spark.createDataFrame(refused, "form string, n_rows long, refused boolean")])


@query
def stored_columns(spark, sf_dir):
    """Columns of a stored table in their order, with the rows that hold a value."""
    store, schema = scratch_store(spark)
    store.write(load(spark, sf_dir, "lineitem").select("l_shipdate", "l_orderkey", "l_returnflag"), "lineitem", schema)
    names = store.columns("lineitem", schema)
    counts = store.read("lineitem", schema).agg(*(F.count(name).alias(name) for name in names))
    entries = [
        F.struct(F.lit(at).alias("position"), F.lit(name).alias("name"), F.col(name).alias("n_values"))
        for at, name in enumerate(names, 1)
    ]
    return counts.select(F.inline(F.array(*entries)))


@query
def column_difference(spark, sf_dir):
    """Columns that only one of two tables has, with the rows that hold a value there."""
    documents, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    names = keyed.column_difference(documents.columns, labels.columns)
    return keyed.concat([
        table.agg(*(F.count(name).alias(name) for name in names if name in table.columns)).select(F.inline(F.array(*(
            F.struct(F.lit(title).alias("origin"), F.lit(name).alias("name"), F.col(name).alias("n_values"))
            for name in names if name in table.columns
        ))))
        for title, table in (("documents", documents), ("labels", labels))
    ])


@query
def min_max_column(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    return orders.agg(
        F.min("o_orderdate").alias("min_date"), F.max("o_orderdate").alias("max_date"),
        F.min("o_totalprice").alias("min_price"), F.max("o_totalprice").alias("max_price"),
    )


@query
def high_water_mark(spark, sf_dir):
    newest = min_or_max(load(spark, sf_dir, "events"), "max", "ts")
    return newest.select(scalar.format_api_timestamp("max").alias("high_water_mark"))


@query
def exists_value(spark, sf_dir):
    return keyed.exists(load(spark, sf_dir, "part"), F.col("p_type") == F.lit("ECONOMY"), "value_exists")


@query
def exists_in_table(spark, sf_dir):
    """Parts of which a large quantity was returned at once."""
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    returned = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 45")
    return keyed.contained(part, returned, "p_partkey", "l_partkey")


# --- JSON

@query
def json_fields(spark, sf_dir):
    parsed = F.from_json("props", T.StructType([T.StructField("k", T.LongType())]))
    return load(spark, sf_dir, "events").select("event_id", "event_type", parsed["k"].alias("k"))


@query
def json_page_explode(spark, sf_dir):
    """Orders packed into pages of search results, then read as the API job reads them."""
    orders = load(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    result = F.struct(
        key.alias("id"),
        F.col("o_orderstatus").alias("type"),
        F.col("o_custkey").cast("string").alias("sectionId"),
        F.col("o_orderpriority").alias("sectionName"),
        scalar.format_api_timestamp("o_orderdate").alias("webPublicationDate"),
        F.concat(F.lit("Order "), key).alias("webTitle"),
        F.concat(F.lit("https://shop.example/"), key).alias("webUrl"),
        F.lit(False).alias("isHosted"),
    )
    # The key is unique, so a page holds at most PAGE_SIZE rows.
    pages = orders.groupBy((F.floor(F.col("o_orderkey") / PAGE_SIZE) + 1).alias("page")).agg(
        F.collect_list(result).alias("results")
    )
    response = F.struct(F.struct(F.lit("ok").alias("status"), "results").alias("response"))
    metadata, _ = api.search_results(pages.select("page", F.to_json(response).alias("body")))
    return metadata.select(
        "id", "guardian_id", "content_type", "section_id", "section_name",
        "web_publication_timestamp", "web_title", "web_url",
    )


@query
def json_error_rows(spark, sf_dir):
    events = load(spark, sf_dir, "events").select(
        F.lit("events").alias("origin"), F.col("event_id").cast("string").alias("row_id"), F.col("props").alias("body")
    )
    talk = load(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("origin"),
        F.concat_ws("/", "conv_id", "turn").alias("row_id"), F.col("text").alias("body"),
    )
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("_corrupt_record", T.StringType())])
    good, bad = api.parse_json(events.unionByName(talk), "body", schema)
    return good.select("origin", "row_id", F.lit(True).alias("readable"), F.col("json.k").cast("string").alias("k")).unionByName(
        bad.select("origin", "row_id", F.lit(False).alias("readable"), F.lit(None).cast("string").alias("k"))
    )


# --- keyed tables

@query
def unprocessed_anti_join(spark, sf_dir):
    documents = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return keyed.unprocessed(documents, load(spark, sf_dir, "labels"), "doc_id")


@query
def not_in_null_aware(spark, sf_dir):
    """With a null among the labelled keys no document passes; without it some do."""
    documents = load(spark, sf_dir, "documents").select("doc_id")
    labelled = load(spark, sf_dir, "labels").select("doc_id")
    with_null = labelled.unionByName(documents.select(F.lit(None).cast("long").alias("doc_id")).distinct())
    cases = {"no_null": labelled, "with_null": with_null}
    counted = [
        keyed.not_in(documents, keys, "doc_id").agg(F.count(F.lit(1)).alias("passed")).select(
            F.lit(name).alias("target"), "passed"
        )
        for name, keys in cases.items()
    ]
    return keyed.concat(counted)


@query
def newest_unprocessed_topk(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    waiting = keyed.unprocessed(orders, load(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey")
    return keyed.newest(waiting, "o_orderdate", NEWEST, "o_orderkey")


@query
def insert_new_only(spark, sf_dir):
    """Documents without a label get a blank one; given labels stay."""
    store, schema = scratch_store(spark)
    store.write(load(spark, sf_dir, "labels"), "labels", schema)
    blank = load(spark, sf_dir, "documents").select(
        F.lit(0).alias("toxic"), F.lit(0).alias("quality"), "doc_id"
    )
    store.insert_new_only(blank, "labels", schema, "doc_id")
    return store.read("labels", schema)


@query
def replace_contents(spark, sf_dir):
    store, schema = scratch_store(spark)
    store.write(load(spark, sf_dir, "labels"), "labels", schema)
    flipped = store.read("labels", schema).select("doc_id", (1 - F.col("toxic")).alias("toxic"), "quality")
    store.replace(flipped, "labels", schema)
    return store.read("labels", schema)


@query
def delete_by_key(spark, sf_dir):
    store, schema = scratch_store(spark)
    store.write(load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "part", schema)
    store.delete("part", schema, ~F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#17"))
    return store.read("part", schema)


@query
def delete_in_partitions(spark, sf_dir):
    """Short documents deleted from a table partitioned by language; one language goes as a whole."""
    store, schema = scratch_store(spark)
    rows = load(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang")
    store.create("documents", schema, rows.schema, partition_by=("lang",))
    store.write(rows, "documents", schema, mode="append")
    store.delete("documents", schema, (F.col("lang") == "de") | (F.col("lang") == "fr") & (F.col("n_chars") < 1000))
    return store.read("documents", schema)


@query
def dedupe_keep_first(spark, sf_dir):
    documents = load(spark, sf_dir, "documents").withColumn("text_id", scalar.article_id("text"))
    return keyed.keep_first(
        documents.select("doc_id", "text_id", "source", "lang", "n_chars"), ["text_id"], [F.asc("doc_id")]
    )


@query
def dedupe_keep_last(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return keyed.keep_last(events, ["user_id"], ["ts", "event_id"])


@query
def union_metadata(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select(
        scalar.article_id("url").alias("id"), html.title("html").alias("title"), "url"
    )
    documents = load(spark, sf_dir, "documents").select(
        scalar.article_id("text").alias("id"), F.col("source").alias("title"), F.col("lang").alias("url")
    )
    return recommend.article_metadata({"pages": pages, "documents": documents})


@query
def concat_sources(spark, sf_dir):
    return keyed.concat([
        load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), "text", "source"),
        load(spark, sf_dir, "benchmark").select("text", F.col("item_id").cast("string")),
    ])


@query
def drop_incomplete(spark, sf_dir):
    documents = load(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return keyed.drop_incomplete(documents.join(load(spark, sf_dir, "labels"), "doc_id", "left"))


@query
def vertex_merge(spark, sf_dir):
    """Articles as vertices: those with labels are stored, all are offered."""
    documents = load(spark, sf_dir, "documents")
    vertices = documents.select(
        scalar.article_id("text").alias("id"), F.col("source").alias("publication"),
        F.col("lang").alias("title"), F.col("n_chars").cast("string").alias("url"), "doc_id",
    )
    labelled = keyed.contained(vertices, load(spark, sf_dir, "labels"), "doc_id").drop("doc_id")
    stored = keyed.keep_first(labelled, ["id"], [F.asc("publication"), F.asc("title"), F.asc("url")])
    merged, conflicts = keyed.merge_vertices(stored, vertices.drop("doc_id"))
    return merged.withColumn("conflict", F.lit(False)).unionByName(conflicts.withColumn("conflict", F.lit(True)))


# --- scalar functions

@query
def md5_ids(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", scalar.article_id("url").alias("id"), "url")


@query
def timestamp_roundtrip(spark, sf_dir):
    stamped = load(spark, sf_dir, "events").select("event_id", scalar.format_api_timestamp("ts").alias("published"))
    return stamped.select("event_id", "published", scalar.parse_api_timestamp("published").alias("ts"))


@query
def title_cleanup(spark, sf_dir):
    cleaned = scalar.page_title(html.title("html"), ": ", " | ")
    return load(spark, sf_dir, "pages").select("page_id", scalar.squeeze_spaces(cleaned).alias("title"))


@query
def title_case(spark, sf_dir):
    names = load(spark, sf_dir, "part").select(F.lit("part").alias("origin"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    segments = load(spark, sf_dir, "customer").select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("key"), F.concat("c_name", F.lit(" o'neil-"), "c_mktsegment").alias("name"))
    return names.unionByName(segments).select("origin", "key", scalar.title_case("name").alias("name"))


@query
def vector_literal_roundtrip(spark, sf_dir):
    written = load(spark, sf_dir, "embeddings").select(
        "vec_id", scalar.format_vector(F.col("embedding").cast("array<double>")).alias("encoded")
    )
    return written.select("vec_id", F.posexplode(scalar.parse_vector("encoded")).alias("slot", "value"))


# --- pages

@query
def absolute_links(spark, sf_dir):
    links = html.article_links("html", "url")
    return load(spark, sf_dir, "pages").select("page_id", F.explode(links).alias("link"))


@query
def author_directory(spark, sf_dir):
    root = F.regexp_extract("url", scalar._URL_ROOT, 1)
    entries = load(spark, sf_dir, "pages").select(
        "page_id", F.posexplode(html.author_entries("html", "url", root)).alias("at", "entry")
    )
    last = keyed.keep_last(entries.select("page_id", "at", "entry.*"), ["columnist"], ["page_id", "at"])
    return last.select("columnist", "homepage")


@query
def author_article_links(spark, sf_dir):
    """The host of a page stands for its author; the first page to link an article gets it."""
    links = load(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("url", r"://([^/?#]*)", 1).alias("columnist"),
        F.explode(html.article_links("html", F.lit("https://news.example/archive/"))).alias("url"),
    )
    rows = links.select("page_id", "columnist", scalar.article_id("url").alias("article_id"), "url")
    return keyed.keep_first(rows, ["article_id"], [F.asc("page_id")]).drop("page_id")


@query
def page_text(spark, sf_dir):
    pages = load_texts(spark, sf_dir, "pages", "page_id", "html")
    return pages.select("page_id", html.visible_text("html").alias("content"))


@query
def article_paragraphs(spark, sf_dir):
    found = html.paragraphs(html.article_markup("html"))
    return load_texts(spark, sf_dir, "pages", "page_id", "url", "html").select(
        "page_id", scalar.article_id("url").alias("id"), html.headline("html").alias("title"),
        F.size(found).alias("n_paragraphs"), scalar.join_words(found).alias("content"),
    )


# The given pages as a site: everything in the navigation is by an author.
GIVEN_PAGES = sites.Site(
    publication="Pages",
    base_url="https://news.example",
    title=(sites.element("article"), sites.element("h1")),
    body=sites.element("article"),
    paragraph=sites.element("p"),
    links=sites.element("nav"),
    link=(sites.element("li"), sites.element("a")),
    unwanted_link="pageOffset",
    authors=(sites.element("nav"), sites.element("a")),
)


def _site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_texts(spark, sf_dir, "pages", "url", "html")


@query
def parsed_articles(spark, sf_dir):
    return sites.read_articles(_site_pages(spark, sf_dir), GIVEN_PAGES)


@query
def parsed_without_excluded(spark, sf_dir):
    """Conversations as pages whose answers stand in a box that is left out."""
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    said = F.concat(F.lit("<p>"), escaped, F.lit("</p>"))
    boxed = F.concat(F.lit('<div class="more">'), said, F.lit("</div>"))
    markup = F.when(F.col("role") == "assistant", boxed).otherwise(said)
    turns = load(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", markup.alias("markup")).alias("said"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("said")), lambda t: t["markup"]), "")
    title = F.concat(F.lit("<h1>Conversation "), F.col("conv_id").cast("string"), F.lit("</h1>"))
    pages = turns.groupBy("conv_id").agg(body.alias("body")).select(
        F.concat(F.lit("https://news.example/"), F.col("conv_id").cast("string")).alias("url"),
        F.concat(F.lit("<article>"), title, F.col("body"), F.lit("</article>")).alias("html"),
    )
    site = replace(GIVEN_PAGES, skip_parent=sites.element("div", class_="more"))
    return sites.read_articles(pages, site)


@query
def parsed_authors(spark, sf_dir):
    return sites.read_authors(_site_pages(spark, sf_dir), GIVEN_PAGES)


@query
def parsed_author_links(spark, sf_dir):
    """Every page is the home page of its host."""
    pages = _site_pages(spark, sf_dir)
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    return sites.read_links(pages, GIVEN_PAGES, pages.select(host.alias("columnist"), F.col("url").alias("homepage")))


# --- text

def lemma_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plural to singular, for the words of ``benchmark`` that it holds in both forms."""
    words = load(spark, sf_dir, "benchmark").select(F.explode(tokens.words("text")).alias("word")).distinct()
    singular = F.regexp_replace("word", "s$", "")
    plurals = words.where(F.col("word").endswith("s")).withColumn("lemma", singular)
    return plurals.join(words.withColumnRenamed("word", "lemma"), "lemma", "left_semi").select("word", "lemma")


@query
def tokenise(spark, sf_dir):
    found = tokens.encoder_tokens("text")
    return load_texts(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", F.size(found).alias("n_tokens"), scalar.join_words(found).alias("tokens")
    )


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_texts(
        spark, sf_dir, "documents", F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang", "source"
    )


@query
def normalise_text(spark, sf_dir):
    return text.normalise(
        _articles(spark, sf_dir), stops=STOPS, lemmas=lemma_table(spark, sf_dir), lang="lang"
    )


@query
def normalise_incremental(spark, sf_dir):
    done = load(spark, sf_dir, "labels")
    return text.normalise_new(
        _articles(spark, sf_dir), done, "doc_id", stops=STOPS, lang="lang"
    )


# --- vectors

@query
def vocabulary(spark, sf_dir):
    classes = tfidf.collapse_copies(tfidf.bags(_articles(spark, sf_dir), "content"))
    return tfidf.fit_vocabulary(classes).select("word", "feature_matrix_index", "document_frequency")


def _rounded(encoded: DataFrame) -> DataFrame:
    return encoded.select("id", "feature_matrix_index", F.round("weight", 6).alias("weight"))


@query
def tfidf_refit(spark, sf_dir):
    encoded, _ = tfidf.encode_texts(_articles(spark, sf_dir), text="content")
    return _rounded(encoded)


@query
def tfidf_fixed_vocabulary(spark, sf_dir):
    """The words of ``benchmark`` as vocabulary; documents without any of them keep a row."""
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    words = tfidf.fit_vocabulary(tfidf.collapse_copies(tfidf.bags(items, "text")))
    articles = _articles(spark, sf_dir)
    encoded, _ = tfidf.encode_texts(articles, words, text="content")
    kept = articles.select("id").join(_rounded(encoded), "id", "left")
    return kept.withColumn("feature_matrix_index", F.col("feature_matrix_index").cast("string"))


def _incremental(spark: SparkSession, sf_dir: str, whole_corpus: bool) -> DataFrame:
    articles = _articles(spark, sf_dir)
    labels = load(spark, sf_dir, "labels")
    known = keyed.contained(articles, labels, "id", "doc_id")
    words = tfidf.fit_vocabulary(tfidf.collapse_copies(tfidf.bags(known, "content")))
    fresh = keyed.unprocessed(articles, labels, "id", "doc_id")
    encoded, _ = tfidf.encode_texts(fresh, words, articles if whole_corpus else None, text="content")
    return _rounded(encoded)


@query
def tfidf_incremental_batch(spark, sf_dir):
    return _incremental(spark, sf_dir, whole_corpus=False)


@query
def tfidf_incremental_corpus(spark, sf_dir):
    return _incremental(spark, sf_dir, whole_corpus=True)


def _decimals(weights: str):
    return F.array_join(F.transform(weights, lambda w: F.format_string("%.5f", w)), ",")


@query
def tfidf_vectors(spark, sf_dir):
    articles = _articles(spark, sf_dir)
    encoded, _ = tfidf.encode_texts(articles, text="content")
    packed = tfidf.sparse_vectors(encoded, articles)
    return packed.select(
        "id", F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"), _decimals("weights").alias("weights")
    )


@query
def tfidf_dense_vectors(spark, sf_dir):
    """Part names have a vocabulary small enough for one slot per word."""
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    encoded, words = tfidf.encode_texts(parts, text="name")
    slots = tfidf.dense_vectors(encoded, words.count(), parts)
    return slots.select("id", _decimals("encoded").alias("encoded"))


@query
def dense_cosine(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("encoded")
    )
    pairs = dense.similar_vectors(vectors, DENSE_THRESHOLD)
    return pairs.select("id", "similar_id", F.round("score", 6).alias("score"))


def _class_pairs(spark: SparkSession, sf_dir: str, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(pairs, members, classes)`` of the documents; members without a word are left out."""
    classes, member_table = tfidf.collapse_texts(_articles(spark, sf_dir), "content")
    words = tfidf.fit_vocabulary(classes)
    pairs = similarity.similar_pairs(tfidf.encode(classes, words), threshold)
    worded = classes.where(F.size("bag") > 0)
    return pairs, member_table.join(worded.select("class_id"), "class_id", "left_semi"), worded


@query
def similar_groups(spark, sf_dir):
    """Pairs of groups of equal documents, with the sizes of the groups."""
    pairs, _, classes = _class_pairs(spark, sf_dir, PAIR_THRESHOLD)
    # Only groups of more than one are joined; stored, they are known to be few.
    size = sent_if_small(materialise(classes.where("copies > 1").select("class_id", "copies"), "sizes"))
    return (
        pairs.join(size.withColumnsRenamed({"class_id": "id"}), "id", "left")
        .join(size.withColumnsRenamed({"class_id": "similar_id", "copies": "similar_copies"}), "similar_id", "left")
        .select(
            "id", "similar_id", F.round("score", 6).alias("score"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"),
            F.coalesce("similar_copies", F.lit(1).cast("long")).alias("similar_copies"),
        )
    )


def document_pairs(spark: SparkSession, sf_dir: str, threshold: float) -> DataFrame:
    pairs, member_table, _ = _class_pairs(spark, sf_dir, threshold)
    documents = similarity.expand_to_documents(pairs, member_table)
    return documents.select(
        "id", F.col("similar_id").alias("similar_article_id"), F.round("score", 6).alias("similarity_score")
    )


@query
def similar_pairs(spark, sf_dir):
    return document_pairs(spark, sf_dir, PAIR_THRESHOLD)


@query
def annotated_pairs(spark, sf_dir):
    metadata = load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("publication"),
        F.col("lang").alias("title"), F.col("n_chars").alias("url"),
    )
    return recommend.annotate_pairs(document_pairs(spark, sf_dir, PAIR_THRESHOLD), metadata)


@query
def cross_source_recommendations(spark, sf_dir):
    """The most similar documents from other sources, for each document."""
    pairs, member_table, _ = _class_pairs(spark, sf_dir, PAIR_THRESHOLD)
    sources = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("publication"))
    return recommend.recommend(pairs, member_table.join(sources, "id"), RECOMMENDATIONS)


# --- files and streams

@query
def csv_append_roundtrip(spark, sf_dir):
    """Customers, then suppliers, appended to one CSV folder and read back."""
    folder = new_folder(spark, "csv")
    customer = load(spark, sf_dir, "customer").select(
        F.concat(F.col("c_name"), F.lit(', "'), F.col("c_mktsegment"), F.lit('"')).alias("name"), F.col("c_nationkey").alias("nation"),
    )
    supplier = load(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    files.append_csv(customer, folder)
    files.append_csv(supplier, folder)
    return files.read_csv(spark, folder, customer.schema)


@query
def sorted_export(spark, sf_dir):
    """Orders written best first and read back, each with its place in the files."""
    folder = new_folder(spark, "sorted")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    files.export_sorted(orders, folder, [F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey")])
    return files.read_sorted(spark, folder)


@query
def stream_ingest_new_only(spark, sf_dir):
    """Events streamed into a table; a second stream over the same files adds nothing."""
    store, schema = scratch_store(spark)
    events = load(spark, sf_dir, "events")
    store.create("events", schema, events.schema)
    for _ in range(2):
        ingest_new_only(
            spark, f"{sf_dir}/events.parquet", events.schema, "events", schema, "event_id",
            checkpoint=new_folder(spark, "stream"),
        )
    return store.read("events", schema)
