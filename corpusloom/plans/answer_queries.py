"""Queries over retrieval, prompts, analytics, evaluation and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import analytics, prompts, retrieval
from corpusloom.plans import tables as tb
from corpusloom.plans.corpus_queries import CHUNKS_SQL, feedback, index_docs
from corpusloom.plans.graph_queries import GAZETTEER
from corpusloom.plans.registry import query
from corpusloom.sources.scratch import scratch_path, written
from corpusloom.streaming import jobs

# ---- retrieval

#: Cells of the index that questions are looked up in.
CELLS = 128
_SYNONYMS = {"les": ["des", "une paire"], "paire": ["Deux"], "was": ["were", "had"], "und": ["oder"]}


def questions(spark, d):
    c = tb.table(spark, d, "conversations").where("role = 'user'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("question"))


def _expanded_sql(col: str) -> str:
    out = f"lower({col})"
    for k, v in _SYNONYMS.items():
        out = f"(SELECT CASE WHEN contains(x, '{k}') THEN x || ' {' '.join(v)}' ELSE x END FROM (SELECT {out} AS x))"
    return out


@query("I1", f"SELECT conv_id * 1000 + turn AS qid, {_expanded_sql('text')} AS expanded FROM conversations WHERE role = 'user'")
def i1(spark, d):
    return questions(spark, d).select("qid", retrieval.expand(F.col("question"), _SYNONYMS).alias("expanded"))


_I2 = r"""q AS (SELECT conv_id * 1000 + turn AS qid, list_filter(string_split_regex(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '\s+'), lambda w: length(w) > 3) AS words FROM conversations WHERE role = 'user'),
b AS (SELECT 'k' || item_id AS id, item_id AS ord, lower(text || ' k' || item_id) AS body FROM benchmark),
m AS (SELECT qid, id, ord, len(list_filter(words, lambda w: contains(body, w))) AS hits FROM q, b),
best AS (SELECT qid, id, hits, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, ord) AS rank FROM m WHERE hits > 0)"""


def curated_matches(spark, d):
    b = tb.table(spark, d, "benchmark").select(F.concat(F.lit("k"), F.col("item_id").cast("string")).alias("id"), F.col("item_id").alias("ord"), "text")
    return retrieval.curated_matches(questions(spark, d), b)


@query("I2", f"WITH {_I2} SELECT qid, id, hits, rank FROM best WHERE rank <= 3")
def i2(spark, d):
    return curated_matches(spark, d)


@query("I3", r"SELECT doc_id, 256 AS size, CASE WHEN regexp_matches(text, '\S') THEN 1.0 ELSE 0.0 END AS norm FROM documents")
def i3(spark, d):
    e = tb.table(spark, d, "documents").select("doc_id", retrieval.embed(F.col("text")).alias("e"))
    return e.select("doc_id", F.size("e").alias("size"), F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"))


@query("I4", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS qid, i.vec_id AS id, round(list_cosine_similarity(q.e, i.e), 6) AS score FROM v q, v i WHERE q.vec_id % 100 = 0)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.2 QUALIFY rank <= 15""")
def i4(spark, d):
    """The query set is every vector whose id is divisible by 100, against all vectors."""
    v = tb.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.nearest(v.where("id % 100 = 0").withColumnRenamed("id", "qid"), v)


_SATS, _PARAMS, _REGIONS = ["Supplier#000000001", "Supplier#000000007"], ["TIN", "STEEL", "BRASS"], ["NATION_3", "NATION_14"]


def graph_questions(spark, d):
    """Questions about nations, suppliers and parts, from their names."""
    n = tb.table(spark, d, "nation").select(F.col("n_nationkey").alias("qid"), F.concat(F.lit("STEEL over "), "n_name").alias("question"))
    s = tb.table(spark, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("qid"), F.concat(F.lit("what TIN has "), "s_name").alias("question"))
    s2 = tb.table(spark, d, "supplier").select((F.col("s_suppkey") + 2000000).alias("qid"), F.concat(F.lit("all of "), "s_name").alias("question"))
    return n.unionByName(s).unionByName(s2)


_QUESTIONS = "gq AS (SELECT n_nationkey AS qid, 'STEEL over ' || n_name AS question FROM nation UNION ALL SELECT s_suppkey + 1000000, 'what TIN has ' || s_name FROM supplier UNION ALL SELECT s_suppkey + 2000000, 'all of ' || s_name FROM supplier)"


@query("I5_route", f"""WITH {_QUESTIONS}, r AS (SELECT qid, regexp_matches(question, 'Supplier#00000000[17]$') AS s, regexp_matches(question, 'TIN|STEEL|BRASS') AS p, regexp_matches(question, 'NATION_(3|14)$') AS g FROM gq)
SELECT qid, CASE WHEN s AND p THEN 'satellite_parameter' WHEN s THEN 'satellite' WHEN g AND p THEN 'region_parameter' WHEN p THEN 'parameter' ELSE 'search' END AS route FROM r""")
def i5_route(spark, d):
    return retrieval.route(graph_questions(spark, d), _SATS, _PARAMS, _REGIONS).select("qid", "route")


def graph_results(spark, d, asked, provides=None):
    """What the graph answers to questions, by their routes; its tables are made once."""
    r = written(retrieval.route(asked, _SATS, _PARAMS, _REGIONS), "routes")
    p, c, m = written(tb.provides(spark, d), "provides") if provides is None else provides, tb.covers(spark, d), tb.measures(spark, d)
    return retrieval.graph_results(r, tb.nodes(spark, d), p, c, m, region_names=tb.table(spark, d, "nation").select(F.col("n_name").alias("region")))


_EITHER = "(contains({0}, {1}) OR contains({1}, {0}))"
_I5 = f"""r0 AS (SELECT qid, question, regexp_extract(question, 'Supplier#00000000[17]$') AS sat, regexp_extract(question, 'TIN|STEEL|BRASS') AS param, regexp_extract(question, 'NATION_(?:3|14)$') AS region_q FROM gq),
r AS (SELECT *, CASE WHEN sat <> '' AND param <> '' THEN 'satellite_parameter' WHEN sat <> '' THEN 'satellite' WHEN region_q <> '' AND param <> '' THEN 'region_parameter' WHEN param <> '' THEN 'parameter' ELSE 'search' END AS route FROM r0),
f1 AS (SELECT DISTINCT qid, satellite AS a, product AS b, name AS c FROM r JOIN provides ON {_EITHER.format('satellite', 'sat')} JOIN measures USING (product) WHERE route = 'satellite_parameter' AND {_EITHER.format('name', 'param')}),
f2 AS (SELECT DISTINCT qid, satellite AS a, product AS b, '' AS c FROM r JOIN provides ON {_EITHER.format('satellite', 'sat')} WHERE route = 'satellite'),
f3 AS (SELECT DISTINCT qid, satellite AS a, product AS b, region AS c FROM r JOIN covers ON {_EITHER.format('region', 'region_q')} JOIN measures USING (product) JOIN provides USING (product) WHERE route = 'region_parameter' AND {_EITHER.format('name', 'param')}),
f4 AS (SELECT DISTINCT qid, '' AS a, product AS b, name AS c FROM r JOIN measures ON {_EITHER.format('name', 'param')} WHERE route = 'parameter'),
found AS (SELECT qid, b AS name, row_number() OVER (PARTITION BY qid ORDER BY a, b, c) AS rank, route FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3 UNION ALL SELECT * FROM f4) JOIN r USING (qid) QUALIFY rank <= 10),
tries AS (SELECT qid, unnest(w) AS q, unnest(range(0, len(w))) AS turn FROM (SELECT qid, list_filter(string_split_regex(question, '\\s+'), lambda x: length(x) > 3)[1:3] AS w FROM r WHERE qid NOT IN (SELECT qid FROM found))),
hits AS (SELECT qid, turn, label, name FROM tries JOIN (SELECT q0, label, name FROM (SELECT DISTINCT q AS q0 FROM tries) JOIN nodes ON {_EITHER.format('name', 'q0')} QUALIFY row_number() OVER (PARTITION BY q0 ORDER BY label, name) <= 10) ON q = q0),
fall AS (SELECT qid, name, row_number() OVER (PARTITION BY qid ORDER BY label, name) AS rank, 'search' AS route FROM hits JOIN (SELECT qid, min(turn) AS turn FROM hits GROUP BY qid) USING (qid, turn) QUALIFY rank <= 10)"""


@query("I5", f"WITH {tb.GRAPH_SQL}, {_QUESTIONS}, {_I5} SELECT qid, name, rank, route FROM found UNION ALL SELECT qid, name, rank, route FROM fall")
def i5(spark, d):
    return graph_results(spark, d, graph_questions(spark, d))


def _evidence(spark, d):
    """Documents as evidence of 20 questions: every odd one from the graph."""
    kind = F.when(F.col("lang") == "en", "crawled_page").when(F.col("lang") == "fr", "curated").otherwise("satellite")
    return tb.table(spark, d, "documents").select((F.col("n_chars") % 20).alias("qid"), F.when(F.col("doc_id") % 2 == 1, 1).otherwise(0).alias("stage"), F.col("doc_id").alias("rank"), F.when(F.col("n_chars") % 3 == 0, F.col("source")).alias("id"), F.concat("lang", F.lit("/"), "source").alias("name"), kind.alias("type"), "text", "source")


_I6 = """ev AS (SELECT n_chars % 20 AS qid, CASE WHEN doc_id % 2 = 1 THEN 1 ELSE 0 END AS stage, doc_id AS rank, CASE WHEN n_chars % 3 = 0 THEN source ELSE lang || '/' || source END AS identity, CASE lang WHEN 'en' THEN 'crawled_page' WHEN 'fr' THEN 'curated' ELSE 'satellite' END AS type, text, source, lang || '/' || source AS name FROM documents),
sc AS (SELECT *, CASE WHEN stage = 1 THEN 0.6 WHEN type = 'curated' THEN 1.5 WHEN type = 'crawled_page' THEN 0.9 ELSE 0.7 END AS score FROM ev QUALIFY row_number() OVER (PARTITION BY qid, identity ORDER BY stage, rank) = 1),
fused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, stage, rank) AS place FROM sc QUALIFY place <= 5)"""


@query("I6", f"WITH {_I6} SELECT qid, place, rank, identity, score FROM fused")
def i6(spark, d):
    return retrieval.fuse(_evidence(spark, d)).select("qid", "place", "rank", "identity", "score")


@query("I7")
def i7(spark, d):
    """Questions from conversations against curated items, the vectors of all index documents and the graph, fused to the
    best five."""
    q = written(questions(spark, d), "questions")
    provides = written(tb.provides(spark, d), "provides")  # of the index and of the graph's answers
    docs = index_docs(spark, d, provides).select(F.xxhash64("type", "text").alias("id"), "type", "text", F.coalesce("name", "product", "satellite").alias("name")).dropDuplicates(["id"])
    docs = written(docs.withColumn("embedding", retrieval.embed(F.col("text"))).drop("text"), "index")
    asked = q.select("qid", retrieval.embed(retrieval.expand(F.col("question"), _SYNONYMS)).alias("embedding"))
    vectors = docs.select("id", "embedding")
    found = retrieval.nearest(asked, vectors, centroids=retrieval.fit_cells(vectors, CELLS, sample=64 * CELLS)).join(docs.select("id", "type", "name"), "id")
    found = found.select("qid", F.lit(0).alias("stage"), (F.col("rank") + 3).alias("rank"), F.col("id").cast("string").alias("id"), "name", "type")
    none = F.lit(None).cast("string")
    curated = curated_matches(spark, d).select("qid", F.lit(0).alias("stage"), "rank", "id", none.alias("name"), F.lit("curated").alias("type"))
    graph = graph_results(spark, d, q, provides).select("qid", F.lit(1).alias("stage"), "rank", none.alias("id"), "name", F.lit("graph").alias("type"))
    return retrieval.fuse(curated.unionByName(found).unionByName(graph)).select("qid", "place", "id", "name", "type", "score")


# ---- prompts

_LINES = "h AS (SELECT *, list(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS lines FROM conversations)"


@query("P1", f"WITH {_LINES} SELECT conv_id, turn, text AS question, coalesce(array_to_string(lines, '|'), '') AS history FROM h WHERE role = 'user'")
def p1(spark, d):
    return prompts.history(tb.table(spark, d, "conversations")).select("conv_id", "turn", "question", F.array_join("history", "|").alias("history"))


_BLOCK = "CASE WHEN lines IS NULL OR len(lines) = 0 THEN '' WHEN len(lines) <= 4 THEN E'Previous conversation:\\n' || array_to_string(lines, E'\\n') || E'\\n\\n' ELSE E'Recent conversation:\\n' || array_to_string(lines[-4:], E'\\n') || E'\\n\\n' END"


@query("P2", f"WITH {_LINES} SELECT conv_id, turn, {_BLOCK} AS block FROM h WHERE role = 'user'")
def p2(spark, d):
    return prompts.history(tb.table(spark, d, "conversations")).select("conv_id", "turn", prompts.history_block(F.col("history")).alias("block"))


@query("P3", f"""WITH {tb.GRAPH_SQL}, {CHUNKS_SQL}, reg AS (SELECT product, string_agg(region, ', ' ORDER BY region) AS regions FROM (SELECT * FROM covers QUALIFY row_number() OVER (PARTITION BY product ORDER BY region) <= 5) GROUP BY product)
SELECT 'satellite' AS type, 'Satellite ' || satellite || ' provides: ' || string_agg(product, ', ' ORDER BY product) AS line FROM (SELECT * FROM provides QUALIFY row_number() OVER (PARTITION BY satellite ORDER BY product) <= 5) GROUP BY satellite
UNION ALL SELECT 'data_product', 'Data product ''' || product || ''' from ' || satellite || coalesce(' covering ' || regions, '') FROM (SELECT * FROM provides ORDER BY satellite, product LIMIT 200) LEFT JOIN reg USING (product)
UNION ALL SELECT 'parameter', name || ': ' || left('Parameter ' || name || ' measured by ' || string_agg(product, ', ' ORDER BY product), 300) FROM (SELECT * FROM measures QUALIFY row_number() OVER (PARTITION BY name ORDER BY product) <= 5) GROUP BY name
UNION ALL SELECT 'curated', left(text, 500) FROM benchmark UNION ALL SELECT 'crawled_page', '[' || source || '] ' || left(text, 300) FROM chunks""")
def p3(spark, d):
    """Of all types."""
    return index_docs(spark, d).select("type", prompts.format_doc().alias("line"))


@query("P4", f"""WITH {_LINES}, {_I2}, l AS (SELECT qid, string_agg('- ' || left(text, 500), E'\\n' ORDER BY rank) AS ctx FROM best JOIN benchmark ON id = 'k' || item_id WHERE rank <= 3 GROUP BY qid)
SELECT conv_id * 1000 + turn AS qid, {_BLOCK} || 'Question: ' || text || E'\\n\\nContext:\\n' || coalesce(ctx, '') AS prompt FROM h LEFT JOIN l ON qid = conv_id * 1000 + turn WHERE role = 'user'""")
def p4(spark, d):
    b = tb.table(spark, d, "benchmark").select(F.concat(F.lit("k"), F.col("item_id").cast("string")).alias("id"), F.substring("text", 1, 500).alias("line"))
    lines = curated_matches(spark, d).join(b, "id").select("qid", F.col("rank").alias("place"), "line")
    q = prompts.history(tb.table(spark, d, "conversations")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "question", "history")
    return prompts.prompts(q, lines)


@query("P5", f"""WITH {_I6} SELECT qid, place, CASE type WHEN 'curated' THEN 'Src' WHEN 'crawled_page' THEN 'Portal' ELSE 'Unknown' END AS satellite,
CASE type WHEN 'curated' THEN left(text, 80) || '...' WHEN 'crawled_page' THEN 'S' || substring(source, 2) ELSE name END AS dataset, 'https://x/' || source AS url FROM fused WHERE place <= 3""")
def p5(spark, d):
    docs = retrieval.fuse(_evidence(spark, d)).select("qid", "place", "type", "text", F.lit("src").alias("category"), F.lit(None).cast("string").alias("satellite"), F.lit(None).cast("string").alias("product"), "name", F.concat(F.lit("https://x/"), "source").alias("source_url"))
    return prompts.source_cards(docs, "https://x/")


# ---- analytics

_FB = "fb AS (SELECT ts, event_id, 'user ' || user_id AS query, CASE event_type WHEN 'purchase' THEN 'up' ELSE 'down' END AS type FROM events WHERE event_type IN ('purchase', 'error'))"


@query("A1", f"WITH {_FB} SELECT count(*) AS total, count(*) FILTER (type = 'up') AS up, count(*) FILTER (type = 'down') AS down, round(100.0 * count(*) FILTER (type = 'up') / count(*), 1) AS up_pct, round(100.0 * count(*) FILTER (type = 'down') / count(*), 1) AS down_pct FROM fb")
def a1(spark, d):
    return analytics.totals(feedback(spark, d))


@query("A2", f"WITH {_FB}, e AS (SELECT CAST(max(ts) AS DATE) AS fin FROM fb) SELECT strftime(day, '%Y-%m-%d') AS day, (SELECT count(*) FROM fb WHERE CAST(ts AS DATE) = day AND type = 'up') AS up, (SELECT count(*) FROM fb WHERE CAST(ts AS DATE) = day AND type = 'down') AS down FROM (SELECT CAST(unnest(range(fin - INTERVAL 6 DAY, fin + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM e)")
def a2(spark, d):
    return analytics.daily(feedback(spark, d)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("A3", f"WITH {_FB} SELECT query, count(*) AS n FROM fb WHERE type = 'down' GROUP BY query ORDER BY n DESC, min(ts), query LIMIT 5")
def a3(spark, d):
    return analytics.disliked(feedback(spark, d)).select("query", "n")


@query("A4", f"WITH {_FB} SELECT CAST(event_id AS VARCHAR) AS message_id, type FROM fb ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC LIMIT 20")
def a4(spark, d):
    return analytics.recent(feedback(spark, d)).select("message_id", "type")


@query("A5", """SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'view') AS done, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'click') AS skipped,
CASE WHEN count(*) > count(*) FILTER (event_type = 'click') THEN round(100.0 * count(*) FILTER (event_type = 'view') / (count(*) - count(*) FILTER (event_type = 'click')), 0) ELSE 0 END AS pct FROM events GROUP BY user_id""")
def a5(spark, d):
    status = F.when(F.col("event_type") == "view", "done").when(F.col("event_type") == "click", "skipped").otherwise(F.col("event_type"))
    return analytics.progress(tb.table(spark, d, "events").withColumn("status", status), ["user_id"])


# ---- evaluation: documents and conversations as cases


def _v1(spark, d):
    from corpusloom.operators.entities import first_candidate

    cases = tb.table(spark, d, "documents").select(F.when(F.col("text").contains(" was "), "WAS").otherwise("").alias("expected"), first_candidate(F.col("text"), ["for", "was"]).alias("found"))
    return analytics.evaluation(cases, "entities", analytics.contained(F.col("expected"), F.col("found")))


_RX = lambda w: rf"regexp_matches(text, '(?i)(^|[^A-Za-z0-9_]){w}($|[^A-Za-z0-9_])')"
_V1 = f"SELECT 'entities' AS metric, count(*) FILTER (NOT contains(text, ' was ') OR NOT {_RX('for')}) AS passed, count(*) AS total, round(100.0 * count(*) FILTER (NOT contains(text, ' was ') OR NOT {_RX('for')}) / count(*), 1) AS score FROM documents"


@query("V1", _V1)
def v1(spark, d):
    return _v1(spark, d)


def _v2_cases(spark, d):
    q = questions(spark, d).withColumn("expanded", retrieval.expand(F.col("question"), _SYNONYMS))
    found, missing = analytics.phrases(F.array(F.lit("une paire"), F.lit("oder")), F.col("expanded"))
    return q.select("qid", found.alias("found"), missing.alias("missing"))


_V2 = f"x AS (SELECT conv_id * 1000 + turn AS qid, {_expanded_sql('text')} AS e FROM conversations WHERE role = 'user')"


@query("V2", f"WITH {_V2} SELECT qid, array_to_string(list_filter(['une paire', 'oder'], lambda p: contains(e, p)), ',') AS found, array_to_string(list_filter(['une paire', 'oder'], lambda p: NOT contains(e, p)), ',') AS missing FROM x")
def v2(spark, d):
    return _v2_cases(spark, d).select("qid", F.array_join("found", ",").alias("found"), F.array_join("missing", ",").alias("missing"))


_KEYS = [t for _, t in GAZETTEER[:4]]


def _v3(spark, d):
    keys = F.array(*[F.lit(t.title()) for t in _KEYS])
    return analytics.evaluation(tb.table(spark, d, "documents"), "retrieval", analytics.enough_hits(keys, F.col("text")))


_V3 = "SELECT 'retrieval' AS metric, count(*) FILTER (h >= 2) AS passed, count(*) AS total, round(100.0 * count(*) FILTER (h >= 2) / count(*), 1) AS score FROM (SELECT len(list_filter(['was', 'for', 'with', 'this'], lambda k: contains(lower(text), k))) AS h FROM documents)"


@query("V3", _V3)
def v3(spark, d):
    return _v3(spark, d)


def _v4(spark, d):
    ok = analytics.good_response(F.col("text"), F.lit(80), F.array(F.lit("Password"), F.lit("token")))
    return analytics.evaluation(tb.table(spark, d, "conversations").where("role = 'assistant'"), "responses", ok)


_V4 = "SELECT 'responses' AS metric, count(*) FILTER (ok) AS passed, count(*) AS total, round(100.0 * count(*) FILTER (ok) / count(*), 1) AS score FROM (SELECT length(text) >= 80 AND trim(text) <> '' AND NOT contains(lower(text), 'password') AND NOT contains(lower(text), 'token') AS ok FROM conversations WHERE role = 'assistant')"


@query("V4", _V4)
def v4(spark, d):
    return _v4(spark, d)


@query("V5", f"WITH r AS ({_V1} UNION ALL {_V3} UNION ALL {_V4}) SELECT * FROM r UNION ALL SELECT 'overall', sum(passed), sum(total), round(avg(score), 1) FROM r")
def v5(spark, d):
    return analytics.scorecard(_v1(spark, d).unionByName(_v3(spark, d)).unionByName(_v4(spark, d)))


# ---- streams


@query("X1", f"WITH {_FB} SELECT strftime(ts, '%Y-%m-%d') AS day, type, count(*) AS n FROM fb GROUP BY ALL")
def x1(spark, d):
    """The feedback log as a stream: its rows come in three lots by time, and the last counts are those of the batch."""
    folder, counts, checkpoint = (scratch_path(spark, n) for n in ("feedback-log", "feedback-counts", "checkpoint"))
    log = feedback(spark, d).select(F.col("timestamp").cast("timestamp").alias("timestamp"), "type")
    seconds = F.unix_timestamp("timestamp")
    span = log.agg(F.min(seconds).alias("low"), F.max(seconds).alias("high")).first()
    low, high = span["low"] or 0, span["high"] or 0
    for lot in range(3):
        log.where(F.floor(3 * (seconds - low) / (high - low + 1)) == lot).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(log.schema).parquet(folder)
        jobs.run_available(jobs.daily_feedback(stream), counts, checkpoint).awaitTermination()
    return jobs.read_counts(spark, counts, ["day", "type"]).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "type", "n")


@query("X2")
def x2(spark, d):
    """Documents streamed into an index of chunks, the last one of each source winning; the replay equals the batch.

    NFKC and dates inside texts have no SQL form; tests compare with plain loops.
    """
    folder = scratch_path(spark, "incoming")
    docs = tb.table(spark, d, "documents").select(F.col("source").alias("id"), F.col("doc_id").alias("version"), "text")
    docs.repartition(4).write.parquet(folder)
    stream = spark.readStream.schema("id string, version long, text string").option("maxFilesPerTrigger", 2).parquet(folder)
    index = jobs.Index(spark, scratch_path(spark, "index"))
    jobs.ingest(stream, index, scratch_path(spark, "checkpoint")).awaitTermination()
    return index.chunks().select("id", "text")
