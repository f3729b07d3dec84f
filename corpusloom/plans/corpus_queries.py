"""Queries over sources, pages, texts, deduplication and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import chunks, crawl, documents, language
from corpusloom.plans import tables as tb
from corpusloom.plans.registry import query
from corpusloom.sources import files
from corpusloom.sources.scratch import scratch_path, written

# ---- sources and sinks

_HOST = r"regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"
PAGES_AS_DOCS = ["source_url", "content_type", "text", "metadata"]


def _page_docs(spark, d):
    """Pages as crawled documents."""
    meta = F.create_map(F.lit("host"), crawl.host_of(F.col("url")), F.lit("bytes"), F.length("html").cast("string"), F.lit("none"), F.lit(None).cast("string"), F.lit("blank"), F.lit(""))
    return tb.table(spark, d, "pages").select("page_id", F.col("url").alias("source_url"), F.lit("text/html").alias("content_type"), F.col("html").alias("text"), meta.alias("metadata"))


@query("S1", f"SELECT url AS source_url, length(html) AS n_chars, {_HOST} AS host, 'text%2Fhtml' AS folder, true AS has_stem FROM pages")
def s1(spark, d):
    """Documents written as a tree of JSON files, one object a file, and read back with their paths and stems."""
    folder = scratch_path(spark, "tree")
    _page_docs(spark, d).select(*PAGES_AS_DOCS).write.option("maxRecordsPerFile", 1).partitionBy("content_type").json(folder)
    docs = files.read_documents(spark, folder)
    under = F.regexp_extract("path", r"content_type=([^/]+)/", 1)
    return docs.select("source_url", F.length("text").alias("n_chars"), F.col("metadata")["host"].alias("host"), F.regexp_replace(under, "%25", "%").alias("folder"), (F.length("stem") > 0).alias("has_stem"))


@query("S2", "SELECT 'html' AS kind, count(*) AS n FROM pages")
def s2(spark, d):
    """Documents parted by kind; the sink's folders read back."""
    folder = scratch_path(spark, "kinds")
    files.write_documents(_page_docs(spark, d).select("source_url", "content_type", "text"), folder)
    return spark.read.option("basePath", folder).schema("source_url string, text string, kind string").json(folder).groupBy("kind").agg(F.count("*").alias("n"))


@query("S3", "SELECT 'k' || item_id AS id, text, 'curated' AS type, 'general' AS category, CAST(NULL AS VARCHAR) AS source_url FROM benchmark")
def s3(spark, d):
    """A curated knowledge base: benchmark items written as JSON and read with the fixed schema."""
    folder = scratch_path(spark, "curated")
    b = tb.table(spark, d, "benchmark")
    b.select(F.concat(F.lit("k"), F.col("item_id").cast("string")).alias("id"), "text", F.lit("curated").alias("type"), F.lit("general").alias("category")).write.json(folder)
    return spark.read.schema(files.CURATED).json(folder)


@query("S4", "SELECT CAST(quality AS INT) AS label, count(*) AS n, sum(length(text)) AS n_chars FROM documents JOIN labels USING (doc_id) GROUP BY quality")
def s4(spark, d):
    """Labelled examples nested under one key, unnested; an object holds about 64 examples, whatever the input."""
    folder = scratch_path(spark, "examples")
    labels = tb.table(spark, d, "labels")
    parts = -(-labels.count() // 64) or 1
    rows = tb.table(spark, d, "documents").join(labels, "doc_id")
    rows.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct(F.col("text"), F.col("quality").cast("int").alias("label"))).alias("examples")).select("examples").write.json(folder)
    return spark.read.schema(files.EXAMPLES).json(folder).select(F.inline("examples")).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("S5", f"SELECT host, page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id DESC) AS r FROM (SELECT {_HOST} AS host, page_id, url FROM pages)) WHERE r = 1")
def s5(spark, d):
    """The last page of each host wins; pages arrive as an old and a new part."""
    rows = tb.table(spark, d, "pages").select(crawl.host_of(F.col("url")).alias("host"), "page_id", "url")
    old, new = rows.where(F.length("url") % 2 == 0), rows.where(F.length("url") % 2 == 1)
    return documents.upsert(old, new, "host", "page_id")


@query("S6", f"SELECT page_id, 'host' AS name, {_HOST} AS value FROM pages UNION ALL SELECT page_id, 'bytes', CAST(length(html) AS VARCHAR) FROM pages")
def s6(spark, d):
    return documents.metadata_rows(_page_docs(spark, d), "page_id")


_EVENT_TEXT = "coalesce(cast(event_id as string), '')"


def feedback(spark, d):
    """Events as a feedback log: purchases are up, errors down."""
    e = tb.table(spark, d, "events").where("event_type IN ('purchase', 'error')")
    kind = F.when(F.col("event_type") == "purchase", "up").otherwise("down")
    return e.select(F.col("ts").alias("timestamp"), F.col("event_id").cast("string").alias("message_id"), F.concat(F.lit("user "), (F.col("user_id")).cast("string")).alias("query"), F.col("props").cast("string").alias("response"), kind.alias("type"))


@query("S7", "SELECT CASE event_type WHEN 'purchase' THEN 'up' ELSE 'down' END AS type, count(*) AS n FROM events WHERE event_type IN ('purchase', 'error') GROUP BY ALL")
def s7(spark, d):
    """The feedback log written as JSON lines, with malformed lines among them, and read back."""
    folder = scratch_path(spark, "log")
    rows = feedback(spark, d).withColumn("timestamp", F.col("timestamp").cast("string"))
    rows.select(F.to_json(F.struct("*")).alias("value")).unionByName(rows.select(F.concat(F.lit("{bad "), "message_id").alias("value"))).write.text(folder)
    return files.read_feedback(spark, folder).groupBy("type").agg(F.count("*").alias("n"))


@query("S8", "SELECT CAST(event_id AS VARCHAR) AS message_id, '' AS query, left(coalesce(CAST(props AS VARCHAR), ''), 500) AS response, event_type AS type FROM events")
def s8(spark, d):
    e = tb.table(spark, d, "events").select(F.col("event_id").alias("message_id"), F.col("props").alias("response"), F.col("event_type").alias("type"))
    return files.feedback_rows(e).select("message_id", "query", "response", "type")


@query("S9", f"""WITH {tb.GRAPH_SQL} SELECT '{{"label":"' || label || '","n":' || count(*) || ',"first":"' || min(name) || '"}}' AS value FROM nodes GROUP BY label""")
def s9(spark, d):
    """A catalog export as JSON, read back as text lines."""
    folder = scratch_path(spark, "report")
    files.write_report(tb.nodes(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.min("name").alias("first")), folder)
    return spark.read.text(folder)


@query("S10")
def s10(spark, d):
    """A generated training set of positive and negative examples, written and read back."""
    from corpusloom.operators import classify

    folder = scratch_path(spark, "training")
    p = tb.provides(spark, d)
    files.write_examples(classify.positives(p, 500), classify.negatives(p.select("satellite").distinct(), tb.measures(spark, d).select("name").distinct(), 500), folder)
    return spark.read.schema("text string, label int").json(folder)


@query("S11", "SELECT doc_id AS id FROM documents WHERE n_chars % 3 <> 0")
def s11(spark, d):
    """Documents to embed again: the index holds some as they are and others with an old text."""
    docs = tb.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "n_chars")
    index = docs.where("n_chars % 3 < 2").select("id", F.md5(F.when(F.col("n_chars") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" old")))).alias("digest"))
    return documents.changed(docs, index).select("id")


# ---- pages


@query("W1")
def w1(spark, d):
    return tb.table(spark, d, "pages").select("page_id", crawl.visible_text("html").alias("text"))


@query("W2")
def w2(spark, d):
    return tb.table(spark, d, "pages").select("page_id", crawl.meta_map("html").alias("meta"))


_LINKS = r"""links AS (SELECT url AS src, CASE WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN regexp_extract(url, '^([a-z]+:)', 1) || h
 WHEN starts_with(h, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || h WHEN starts_with(h, '#') THEN regexp_extract(url, '^([^#]*)', 1) || h
 ELSE CASE WHEN regexp_extract(url, '^([a-z]+://[^/?#]*/(?:[^?#]*/)?)', 1) = '' THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/' ELSE regexp_extract(url, '^([a-z]+://[^/?#]*/(?:[^?#]*/)?)', 1) END || h END AS dst
 FROM (SELECT url, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS h FROM pages))"""


@query("W3", f"WITH {_LINKS} SELECT src, dst FROM links")
def w3(spark, d):
    return crawl.links(tb.table(spark, d, "pages"))


@query("W4", f"SELECT url FROM pages, (VALUES ('example.com'), ('nowhere.org')) v(domain) WHERE {_HOST} = domain OR ends_with({_HOST}, '.' || domain)")
def w4(spark, d):
    domains = spark.createDataFrame([("example.com",), ("nowhere.org",)], "domain string")
    return crawl.allowed(tb.table(spark, d, "pages").select("url"), domains)


@query("W5", f"WITH RECURSIVE {_LINKS}, r(url, depth) AS (SELECT DISTINCT url, 0 FROM pages UNION SELECT dst, depth + 1 FROM r JOIN links ON url = src WHERE depth < 3) SELECT url, CAST(min(depth) AS INT) AS depth FROM r GROUP BY url")
def w5(spark, d):
    pages = tb.table(spark, d, "pages")
    return crawl.reachable(crawl.links(pages), pages.select("url"))


_CT = "CASE WHEN length(html) % 4 = 0 THEN 'text/html; charset=utf-8' WHEN length(html) % 4 = 1 THEN 'application/PDF' WHEN length(html) % 4 = 2 THEN 'application/msword' ELSE 'image/png' END"


@query("W6", f"SELECT page_id, CASE length(html) % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' WHEN 2 THEN 'docx' ELSE 'skip' END AS kind FROM pages")
def w6(spark, d):
    return tb.table(spark, d, "pages").select("page_id", crawl.content_kind(F.expr(_CT)).alias("kind"))


@query("W7", r"""SELECT page_id, CASE WHEN b = '' THEN 'unknown_' || left(md5(url), 8) WHEN length(b) > 40 THEN left(b, 50) || '_' || left(md5(b), 8) ELSE b END AS file_key
FROM (SELECT *, regexp_replace(regexp_replace(url, '^https?://', ''), '[<>:"/\\|?*&#=]', '_', 'g') AS b FROM pages)""")
def w7(spark, d):
    return tb.table(spark, d, "pages").select("page_id", crawl.file_key(F.col("url"), 40).alias("file_key"))


# ---- texts


def _docs(spark, d):
    return tb.table(spark, d, "documents")


@query("T1")
def t1(spark, d):
    return _docs(spark, d).select("doc_id", tx.nfkc("text").alias("text"))


@query("T2", r"SELECT doc_id, replace(replace(regexp_replace(text, '[^\P{C}\n\t]|[^\P{Z} ]', '', 'g'), 'ﬁ', 'fi'), 'ﬂ', 'fl') AS text FROM documents")
def t2(spark, d):
    return _docs(spark, d).select("doc_id", tx.strip_artifacts(F.col("text")).alias("text"))


@query("T3", "SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS iso FROM lineitem")
def t3(spark, d):
    return tb.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", tx.iso_date(F.date_format("l_shipdate", "d/M/yyyy")).alias("iso"))


@query("T3_text", "SELECT l_orderkey, l_linenumber, 'shipped ' || strftime(l_shipdate, '%Y-%m-%d') || ' as said.' AS text FROM lineitem")
def t3_text(spark, d):
    """Dates inside texts; the texts are joined with ship dates written day first."""
    return tb.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", tx.dates_in_text(F.concat(F.lit("shipped "), F.date_format("l_shipdate", "d-M-yyyy"), F.lit(" as said."))).alias("text"))


_T4 = {"the": "definite article", "of": "preposition"}


@query("T4", r"""SELECT doc_id, replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(text, '\bthe\b(\s*\()', '<1>\1', 'g'), '\bthe\b', 'the (definite article)', 'g'), '<1>', 'the'), '\bof\b(\s*\()', '<1>\1', 'g'), '\bof\b', 'of (preposition)', 'g'), '<1>', 'of') AS text
FROM documents""")
def t4(spark, d):
    """Texts of all languages."""
    return _docs(spark, d).select("doc_id", tx.expand_acronyms(F.col("text"), _T4).alias("text"))


@query("T5", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \t\r\f\x0b]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents")
def t5(spark, d):
    return _docs(spark, d).select("doc_id", tx.normalize_whitespace(F.col("text")).alias("text"))


@query("T6")
def t6(spark, d):
    return _docs(spark, d).select("doc_id", tx.normalize_text(F.col("text")).alias("text"), tx.cleaned_text(F.col("text")).alias("cleaned_text"))


_GRAMS = "unnest(list_transform(list_zip(string_split(lower(h), '')[:-3], string_split(lower(h), '')[2:-2], string_split(lower(h), '')[3:]), lambda x: x[1] || x[2] || x[3]))"


@query("T7", f"""
WITH g AS (SELECT lang, gram, count(*) AS c FROM (SELECT lang, {_GRAMS} AS gram FROM (SELECT lang, text AS h FROM documents WHERE length(text) >= 3)) GROUP BY ALL),
p AS (SELECT lang AS l, gram, 301 - r AS weight FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY c DESC, gram) AS r FROM g) WHERE r <= 300),
s AS (SELECT doc_id, l, sum(weight) AS score FROM (SELECT doc_id, {_GRAMS} AS gram FROM (SELECT doc_id, left(text, 500) AS h FROM documents WHERE length(text) >= 3)) JOIN p USING (gram) GROUP BY ALL),
b AS (SELECT doc_id, l FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, l) AS r FROM s) WHERE r = 1)
SELECT doc_id, coalesce(l, 'en') AS language FROM documents LEFT JOIN b USING (doc_id)""")
def t7(spark, d):
    docs = _docs(spark, d)
    return language.detect_language(docs, language.language_profiles(docs))


@query("T8", r"SELECT doc_id, round(length(regexp_replace(text, '[^\x{0900}-\x{097F}]', '', 'g')) / greatest(length(text), 1), 6) AS share, length(regexp_replace(text, '[^\x{0900}-\x{097F}]', '', 'g')) / greatest(length(text), 1) > 0.3 AS devanagari FROM documents")
def t8(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", F.round(tx.devanagari_share(t), 6).alias("share"), tx.is_devanagari(t).alias("devanagari"))


@query("T9", "SELECT doc_id, CASE WHEN lang = 'fr' THEN replace(replace(replace(text, 'eau', 'o'), 'qu', 'k'), '.com', '.fr') ELSE text END AS text FROM documents")
def t9(spark, d):
    return _docs(spark, d).select("doc_id", tx.repair_ocr(F.col("text"), F.col("lang"), "fr", {"eau": "o", "qu": "k"}, {".com": ".fr"}).alias("text"))


@query("T10", "SELECT doc_id, text AS raw_text, CASE WHEN n_chars > 500 THEN CAST(n_chars AS VARCHAR) END AS n, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS entries FROM documents")
def t10(spark, d):
    raw = _docs(spark, d).select("doc_id", F.lit(None).cast("string").alias("raw_text"), "text", F.when(F.col("n_chars") > 500, F.create_map(F.lit("n"), F.col("n_chars"))).alias("metadata"))
    out = documents.normalize_records(raw)
    return out.select("doc_id", "raw_text", F.try_element_at("metadata", F.lit("n")).alias("n"), F.size("metadata").alias("entries"))


_T11 = {"licensed": ["licen[cs]e", "copyright"], "code": ["password", "token"], "prose": ["the", "les", "und"]}


@query("T11", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'licen[cs]e|copyright') THEN 'licensed' WHEN regexp_matches(lower(text), 'password|token') THEN 'code' WHEN regexp_matches(lower(text), 'the|les|und') THEN 'prose' ELSE 'other' END AS document_type FROM documents")
def t11(spark, d):
    return _docs(spark, d).select("doc_id", tx.document_type(F.col("text"), _T11).alias("document_type"))


@query("T12", r"""
WITH t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS term FROM documents WHERE lang = 'en') WHERE length(term) > 3 GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
s AS (SELECT doc_id, term, round(tf * ln((SELECT count(*) FROM documents WHERE lang = 'en') / df), 6) AS score FROM t JOIN f USING (term)),
k AS (SELECT doc_id, string_agg(term, ' ' ORDER BY r) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS r FROM s) WHERE r <= 10 GROUP BY doc_id)
SELECT doc_id, coalesce(keywords, '') AS keywords FROM documents LEFT JOIN k USING (doc_id)""")
def t12(spark, d):
    return language.keywords(_docs(spark, d)).select("doc_id", F.array_join("keywords", " ").alias("keywords"))


@query("T13", "SELECT doc_id, CASE WHEN text <> '' THEN lang END AS language, CASE WHEN text <> '' THEN text END AS text, CASE WHEN text <> '' THEN lang ELSE 'old' END AS tag, source AS source FROM documents")
def t13(spark, d):
    raw = _docs(spark, d).select("doc_id", "lang", F.col("text").alias("raw_text"), F.create_map(F.lit("tag"), F.lit("old"), F.lit("source"), F.col("source")).alias("metadata"))
    out = documents.enrich(raw, F.col("lang"), {"tag": F.col("lang")})
    return out.select("doc_id", "language", "text", F.col("metadata")["tag"].alias("tag"), F.col("metadata")["source"].alias("source"))


@query("T14", "SELECT source AS source_url, text, lang AS language, CAST(0 AS INT) AS n_tables, CAST(0 AS INT) AS n_keywords, CAST(NULL AS VARCHAR) AS content_type FROM documents")
def t14(spark, d):
    out = documents.to_schema(_docs(spark, d).select(F.col("source").alias("source_url"), "text", F.col("lang").alias("language"), "n_chars"))
    return out.select("source_url", "text", "language", F.size("tables").alias("n_tables"), F.size("keywords").alias("n_keywords"), "content_type")


@query("T15", "SELECT doc_id, replace(replace(text, 'é', '�'), '�', '°') AS text FROM documents")
def t15(spark, d):
    return _docs(spark, d).select("doc_id", tx.repair_decoding(F.replace("text", F.lit("é"), F.lit("�"))).alias("text"))


# ---- deduplication, chunks and index documents


@query("K1", "SELECT doc_id FROM documents WHERE length(text) >= 50")
def k1(spark, d):
    return documents.long_enough(_docs(spark, d)).select("doc_id")


@query("K2", f"""SELECT source_url, path, priority FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY priority DESC, path) AS r FROM (
SELECT {_HOST} AS source_url, lpad(CAST(page_id AS VARCHAR), 9, '0') AS path, CASE WHEN length(html) >= 4000 THEN 1 ELSE 0 END AS priority FROM pages)) WHERE r = 1""")
def k2(spark, d):
    pages = tb.table(spark, d, "pages").select(crawl.host_of(F.col("url")).alias("source_url"), F.lpad(F.col("page_id").cast("string"), 9, "0").alias("path"), F.length("html").alias("n"))
    out = documents.prefer_processed(pages.where("n < 4000"), pages.where("n >= 4000"))
    return out.select("source_url", "path", F.col("priority"))


#: The fold over sentences as SQL: what is held goes out when the next piece would make it too long.
_FOLD = r"""list_reduce(regexp_extract_all(b, '(?s)(?:.*?(?:\. |\n))|(?:.+)'), lambda a, x: CASE WHEN a.h <> '' AND length(a.h) + length(x) > 800
 THEN {'d': list_append(a.d, trim(a.h, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), 'h': CASE WHEN contains(right(a.h, 100), ' ') THEN substring(right(a.h, 100), instr(right(a.h, 100), ' ') + 1) ELSE right(a.h, 100) END || x}
 ELSE {'d': a.d, 'h': a.h || x} END, {'d': CAST([] AS VARCHAR[]), 'h': ''})"""
CHUNKS_SQL = rf"""bare AS (SELECT doc_id, source, regexp_replace(text, '^\s+|\s+$', '', 'g') AS b FROM documents), fold AS (SELECT doc_id, source, b, CASE WHEN length(b) > 800 THEN {_FOLD} END AS f FROM bare),
chunked AS (SELECT doc_id, source, CASE WHEN b = '' THEN CAST([] AS VARCHAR[]) WHEN length(b) <= 800 THEN [b] WHEN trim(f.h, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN f.d ELSE list_append(f.d, trim(f.h, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) END AS c FROM fold),
chunks AS (SELECT doc_id, source, unnest(c) AS text, CAST(unnest(range(0, len(c))) AS INT) AS chunk_index FROM chunked)"""


@query("K3", f"WITH {CHUNKS_SQL} SELECT doc_id, len(c) AS n, array_to_string(c, '|') AS chunks FROM chunked")
def k3(spark, d):
    return _docs(spark, d).select("doc_id", chunks.chunked(F.col("text")).alias("c")).select("doc_id", F.size("c").cast("long").alias("n"), F.array_join("c", "|").alias("chunks"))


@query("K4", f"WITH {CHUNKS_SQL} SELECT doc_id AS stem, chunk_index, text, 'crawled_' || doc_id || '_c' || chunk_index AS id FROM chunks")
def k4(spark, d):
    return chunks.chunk_rows(_docs(spark, d).select(F.col("doc_id").alias("stem"), "text"))


_K5 = "SELECT 'Satellite ' || satellite || ' provides data products: ' || string_agg(product, ', ' ORDER BY product) AS text, 'satellite' AS type, satellite FROM (SELECT *, row_number() OVER (PARTITION BY satellite ORDER BY product) AS r FROM provides) WHERE r <= 10 GROUP BY satellite"
_K6 = """SELECT 'Data product ' || product || ' from satellite ' || satellite || coalesce(' covering ' || regions, '') AS text, 'data_product' AS type, product, satellite
FROM (SELECT * FROM provides ORDER BY satellite, product LIMIT 200) LEFT JOIN (SELECT product, string_agg(region, ', ' ORDER BY region) AS regions FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY region) AS r FROM covers) WHERE r <= 5 GROUP BY product) USING (product)"""
_K7 = "SELECT 'Parameter ' || name || ' measured by ' || string_agg(product, ', ' ORDER BY product) AS text, 'parameter' AS type, name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY product) AS r FROM measures) WHERE r <= 5 GROUP BY name"


@query("K5", f"WITH {tb.GRAPH_SQL} {_K5}")
def k5(spark, d):
    return chunks.satellite_docs(tb.provides(spark, d)).select("text", "type", "satellite")


@query("K6", f"WITH {tb.GRAPH_SQL} {_K6}")
def k6(spark, d):
    return chunks.product_docs(tb.provides(spark, d), tb.covers(spark, d)).select("text", "type", "product", "satellite")


def _parameters(spark, d):
    return tb.measures(spark, d).select("name").distinct()


@query("K7", f"WITH {tb.GRAPH_SQL} {_K7}")
def k7(spark, d):
    return chunks.parameter_docs(_parameters(spark, d), tb.measures(spark, d))


def index_docs(spark, d, provides=None):
    """All documents of the retrieval index: spelled-out graph, curated items and chunks of documents."""
    curated = tb.table(spark, d, "benchmark").select(F.concat(F.lit("curated_"), F.col("item_id").cast("string")).alias("id"), "text", F.lit("curated").alias("type"), F.lit("general").alias("category"))
    pages = chunks.chunk_rows(_docs(spark, d).select(F.col("doc_id").alias("stem"), "text", F.col("source").alias("source_url"))).withColumn("type", F.lit("crawled_page")).drop("stem")
    p = written(tb.provides(spark, d), "provides") if provides is None else provides  # two parts of the index use it
    return chunks.assemble(chunks.satellite_docs(p), chunks.product_docs(p, tb.covers(spark, d)), chunks.parameter_docs(_parameters(spark, d), tb.measures(spark, d)), curated, pages)


@query("K8", f"""WITH {tb.GRAPH_SQL}, {CHUNKS_SQL} SELECT type, text, satellite, product, name, id FROM (
SELECT text, type, satellite, NULL AS product, NULL AS name, NULL AS id FROM ({_K5}) UNION ALL SELECT text, type, satellite, product, NULL, NULL FROM ({_K6}) UNION ALL SELECT text, type, NULL, NULL, name, NULL FROM ({_K7})
UNION ALL SELECT text, 'curated', NULL, NULL, NULL, 'curated_' || item_id FROM benchmark
UNION ALL SELECT text, 'crawled_page', NULL, NULL, NULL, 'crawled_' || doc_id || '_c' || chunk_index FROM chunks)""")
def k8(spark, d):
    """The whole index."""
    return index_docs(spark, d).select("type", "text", "satellite", "product", "name", "id")


@query("K9", f"""WITH {tb.GRAPH_SQL}, {CHUNKS_SQL} SELECT 'satellite' AS type, count(DISTINCT satellite) AS n FROM provides UNION ALL SELECT 'data_product', least(200, count(*)) FROM provides
UNION ALL SELECT 'parameter', count(DISTINCT name) FROM measures UNION ALL SELECT 'curated', count(*) FROM benchmark UNION ALL SELECT 'crawled_page', count(*) FROM chunks""")
def k9(spark, d):
    return chunks.breakdown(index_docs(spark, d))
