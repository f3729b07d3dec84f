"""Queries over mentions, relations, the graph, its cleaning and its lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import classify, entities, graph, lookups, relations
from corpusloom.plans import tables as tb
from corpusloom.plans.registry import query
from corpusloom.sources.scratch import written

G = f"WITH {tb.GRAPH_SQL}"

# ---- mentions: common words stand in for names, as the driver's prose is invented

GAZETTEER = [("SATELLITE", "was"), ("DATA_PRODUCT", "for"), ("REGION", "with"), ("INSTRUMENT", "this"), ("PARAMETER", "are"), ("STATION", "from")]
_RE = r"\b(?:" + "|".join(sorted((t for _, t in GAZETTEER), key=lambda t: (-len(t), t))) + r")\b"
_LABEL = "CASE text " + " ".join(f"WHEN '{t}' THEN '{x}'" for x, t in GAZETTEER) + " END"
MENTIONS = rf"""
pieces AS (SELECT doc_id, unnest(m) AS text, unnest(p) AS piece, unnest(range(0, len(m))) AS ord FROM (SELECT doc_id, regexp_extract_all(text, '{_RE}') AS m, string_split_regex(text, '{_RE}')[:-2] AS p FROM documents)),
placed AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY ord) + coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM pieces),
mentions AS (SELECT doc_id, ord, text, {_LABEL} AS label, CAST(start AS INT) AS start, CAST(start + length(text) AS INT) AS fin FROM placed)""".strip()
SENTENCES = r"""
sents AS (SELECT doc_id, i, CAST(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) - length(s) AS INT) AS s_start, CAST(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) AS INT) AS s_end
FROM (SELECT doc_id, unnest(x) AS s, unnest(range(0, len(x))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?s)(?:.*?(?:\. |\n))|(?:.+)') AS x FROM documents))),
inside AS (SELECT m.*, i FROM mentions m JOIN sents s ON m.doc_id = s.doc_id AND start >= s_start AND fin <= s_end),
placed2 AS (SELECT * FROM inside QUALIFY count(*) OVER (PARTITION BY doc_id, i) >= 2)""".strip()


def _docs(spark, d):
    return tb.table(spark, d, "documents")


def mentions(spark, d, once=False):
    """Mentions of all documents; written where several steps of a query use them."""
    found = entities.extract(_docs(spark, d), GAZETTEER)
    return found if once else written(found, "mentions")


@query("E1", f"WITH {MENTIONS} SELECT doc_id, ord, text, label, start, fin FROM mentions")
def e1(spark, d):
    return mentions(spark, d, once=True).select("doc_id", "ord", "text", "label", "start", F.col("end").alias("fin"))


@query("E2", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1]), '') AS acronym FROM part")
def e2(spark, d):
    return tb.table(spark, d, "part").select("p_partkey", entities.acronym(F.col("p_name")).alias("acronym"))


_PLACES = "'at ' || (s_suppkey % 80) || '°N and ' || (s_suppkey % 7) || '.5° S, ' || (s_suppkey % 100) || '.25° E or 10-' || (s_suppkey % 50) || '°W'"


@query("E3", "SELECT s_suppkey, unnest([(s_suppkey % 80) || '°N', (s_suppkey % 7) || '.5° S, ' || (s_suppkey % 100) || '.25° E', '10-' || (s_suppkey % 50) || '°W']) AS mention FROM supplier")
def e3(spark, d):
    return tb.table(spark, d, "supplier").select("s_suppkey", F.explode(entities.coordinates(F.expr(_PLACES))).alias("mention"))


@query("E4", f"""WITH {MENTIONS} SELECT doc_id, start, CASE WHEN text = 'for' OR contains(lower(substring(body, greatest(start - 50, 0) + 1, fin + 50 - greatest(start - 50, 0))), 'ation') THEN 'DATA_PRODUCT'
WHEN text = 'with' THEN 'REGION' ELSE label END AS label FROM mentions JOIN (SELECT doc_id, text AS body FROM documents) USING (doc_id)""")
def e4(spark, d):
    m = mentions(spark, d, once=True).join(_docs(spark, d).select("doc_id", F.col("text").alias("body")), "doc_id")
    context = entities.context_of(F.col("body"), F.col("start"), F.col("end"))
    return m.select("doc_id", "start", entities.relabel(F.col("text"), F.col("label"), context, ["for"], ["was"], geo=["with"], indicators=["ation"]).alias("label"))


@query("E5", r"SELECT doc_id, field, count(*) AS n FROM (SELECT doc_id, 'text' AS field, unnest(regexp_extract_all(text, '\b(?:was|src1)\b')) FROM documents UNION ALL SELECT doc_id, 'source', unnest(regexp_extract_all(source, '\b(?:was|src1)\b')) FROM documents) GROUP BY ALL")
def e5(spark, d):
    docs = _docs(spark, d).withColumn("metadata", F.create_map(F.lit("source"), F.col("source")))
    return entities.extract(docs, [("SATELLITE", "was"), ("STATION", "src1")], metadata="metadata").groupBy("doc_id", "field").agg(F.count("*").alias("n"))


_CLASSES = {"STEELY": ["steel", "tin$"], "PLATED": ["^promo", "plated"], "BIG": ["large|medium"]}


@query("E6", "SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)(?:steel)|(?:tin$)') THEN 'STEELY' WHEN regexp_matches(p_type, '(?i)(?:^promo)|(?:plated)') THEN 'PLATED' WHEN regexp_matches(p_type, '(?i)(?:large|medium)') THEN 'BIG' ELSE p_brand END AS kind FROM part")
def e6(spark, d):
    return tb.table(spark, d, "part").select("p_partkey", entities.refine(F.col("p_type"), F.col("p_brand"), _CLASSES).alias("kind"))


_FIRST = r"CASE WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])was($|[^A-Za-z0-9_])') THEN 'was' WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])les($|[^A-Za-z0-9_])') THEN 'les' ELSE '' END"


@query("E7", f"SELECT conv_id, turn, {_FIRST} AS found FROM conversations")
def e7(spark, d):
    return tb.table(spark, d, "conversations").select("conv_id", "turn", entities.first_candidate(F.col("text"), ["was", "les"]).alias("found"))


@query("E8", f"{G} SELECT label, name, CASE WHEN label = 'PARAMETER' AND contains(name, 'STEEL') THEN 'METAL' WHEN label = 'PARAMETER' AND (contains(name, 'TIN') OR contains(name, 'BRASS')) THEN 'SOFT' ELSE label END AS new_label FROM nodes")
def e8(spark, d):
    rules = [("PARAMETER", ["STEEL"], "METAL"), ("PARAMETER", ["TIN", "BRASS"], "SOFT")]
    return tb.nodes(spark, d).select("label", "name", entities.consistent(F.col("label"), F.col("name"), rules).alias("new_label"))


@query("E9", """SELECT doc_id, n, CASE WHEN n > 0 THEN round(lat / n, 6) ELSE 15.0 END AS lat, CASE WHEN n > 0 THEN round(lon / n, 6) ELSE 80.0 END AS lon FROM (
SELECT doc_id, CAST(a + b AS INT) AS n, a * 15.0 + b * 13.5 AS lat, a * 66.5 + b * 90.0 AS lon FROM (SELECT doc_id, CAST(contains(lower(text), 'was') OR contains(lower(text), 'les') AS INT) AS a, CAST(contains(lower(text), 'und') AS INT) AS b FROM documents))""")
def e9(spark, d):
    found = entities.regions_in(F.col("text"), [("West", ["was", "les"], (5, 55, 25, 78)), ("East", ["und"], (5, 80, 22, 100))])
    at = entities.centre(F.col("regions"))
    return _docs(spark, d).select("doc_id", found.alias("regions")).select("doc_id", F.size("regions").alias("n"), F.round(at["lat"], 6).alias("lat"), F.round(at["lon"], 6).alias("lon"))


# ---- relations


@query("R1", f"WITH {MENTIONS}, {SENTENCES} SELECT doc_id, CAST(i AS INT) AS sent, text, start FROM placed2")
def r1(spark, d):
    return relations.in_sentences(_docs(spark, d), mentions(spark, d, once=True)).select("doc_id", "sent", "text", "start")


_PAIRS = "pm AS (SELECT doc_id, i, text, label, min(start) AS start FROM placed2 GROUP BY ALL), one AS (SELECT a.doc_id, a.i, a.text AS head, a.label AS head_type, b.text AS tail, b.label AS tail_type FROM pm a JOIN pm b ON a.doc_id = b.doc_id AND a.i = b.i AND a.start < b.start), pairs AS (SELECT * FROM one UNION ALL SELECT doc_id, i, tail, tail_type, head, head_type FROM one)"


def pairs(spark, d, found=None):
    found = mentions(spark, d, once=True) if found is None else found
    return relations.sentence_pairs(relations.in_sentences(_docs(spark, d), found))


@query("R2", f"WITH {MENTIONS}, {SENTENCES}, {_PAIRS} SELECT doc_id, CAST(i AS INT) AS sent, head, head_type, tail, tail_type FROM pairs")
def r2(spark, d):
    return pairs(spark, d)


_PATTERN = "([A-Z][a-z]+) (was|for|with) ([a-z]+)"


def explicit(spark, d):
    return relations.explicit(_docs(spark, d), [("PROVIDES", "SATELLITE", "DATA_PRODUCT", _PATTERN)])


@query("R3", f"SELECT doc_id, 'PROVIDES' AS type, unnest(regexp_extract_all(text, '{_PATTERN}', 1)) AS head, unnest(regexp_extract_all(text, '{_PATTERN}', 3)) AS tail, length(text) AS n FROM documents")
def r3(spark, d):
    return explicit(spark, d).select("doc_id", "type", "head", "tail", F.length("evidence").alias("n"))


_SCHEMA = "schema AS (SELECT * FROM (VALUES " + ", ".join(str(r) for r in relations.SCHEMA) + ") v(type, head_type, tail_type))"


@query("R4", f"WITH {MENTIONS}, {SENTENCES}, {_PAIRS}, {_SCHEMA} SELECT doc_id, CAST(i AS INT) AS sent, head, tail FROM pairs WHERE (head_type, tail_type) IN (SELECT (head_type, tail_type) FROM schema WHERE type = 'COVERS')")
def r4(spark, d):
    return relations.valid_types(pairs(spark, d).withColumn("type", F.lit("COVERS")), relations.schema_frame(spark)).select("doc_id", "sent", "head", "tail")


_R5 = f"""{_SCHEMA}, dm AS (SELECT doc_id, text, label, min(start) AS start, min(fin) AS fin FROM mentions GROUP BY ALL),
co AS (SELECT a.doc_id, a.text AS head, a.label AS head_type, type, b.text AS tail, b.label AS tail_type, least(a.start, b.start) AS s, greatest(a.fin, b.fin) AS e
FROM dm a JOIN schema ON a.label = head_type JOIN dm b ON b.doc_id = a.doc_id AND b.label = tail_type AND a.text <> b.text)"""


@query("R5", f"WITH {MENTIONS}, {_R5} SELECT doc_id, head, type, tail, substring(text, greatest(s - 50, 0) + 1, e + 50 - greatest(s - 50, 0)) AS evidence FROM co JOIN documents USING (doc_id)")
def r5(spark, d):
    return relations.co_occurring(_docs(spark, d), mentions(spark, d, once=True), relations.schema_frame(spark)).select("doc_id", "head", "type", "tail", "evidence")


#: Known relations between the words that stand in for names; other pairs that the rules allow are unknown to the graph.
KNOWN = [("was", "PROVIDES", "for"), ("this", "MEASURES", "are"), ("was", "COVERS", "with")]


def scored_pairs(spark, d, found=None):
    """Pairs that the rules allow, with what the graph knows of them (label) and what a model says (type).

    The model of each half of the documents is learned by distant supervision from the words around its pairs, kept
    in the shared folder, and applied to the other half.
    """
    found = mentions(spark, d) if found is None else found
    placed = relations.placed_pairs(relations.in_sentences(_docs(spark, d), found))
    known = relations.with_known(placed, spark.createDataFrame(KNOWN, "head string, type string, tail string"), relations.schema_frame(spark))
    rows = written(relations.pair_words(_docs(spark, d), known), "pair-words")
    folder = tb.model_folder(spark, d, "relations", ["documents"])
    fit = lambda half: lambda: relations.distant_model(rows.where(relations.fold_of("doc_id") == half))
    return relations.cross_scored(rows, [classify.saved(f"{folder}/{half}", fit(half)) for half in (0, 1)])


def predicted(spark, d, found=None):
    return relations.predicted(scored_pairs(spark, d, found), relations.schema_frame(spark))


@query("R6")
def r6(spark, d):
    """What a model predicts, by words alone, for pairs of documents that it wasn't fitted on."""
    return predicted(spark, d).select("doc_id", "sent", "head", "type", "tail")


def all_relations(spark, d, found):
    parts = [explicit(spark, d), predicted(spark, d, found).withColumn("evidence", F.lit("")), relations.co_occurring(_docs(spark, d), found, relations.schema_frame(spark))]
    cols = ["doc_id", "head", "head_type", "type", "tail", "tail_type", "evidence", "source"]
    return parts[0].select(*cols).unionByName(parts[1].select(*cols)).unionByName(parts[2].select(*cols))


@query("R7")
def r7(spark, d):
    return all_relations(spark, d, mentions(spark, d)).groupBy("doc_id", "source").agg(F.count("*").alias("n"))


@query("R8")
def r8(spark, d):
    found = mentions(spark, d)
    return relations.counts(found, all_relations(spark, d, found))


# ---- graph


@query("G1", f"WITH {MENTIONS} SELECT label, text AS name, min(doc_id) AS source FROM mentions GROUP BY ALL")
def g1(spark, d):
    m = mentions(spark, d).select("label", "text", F.col("doc_id").alias("source"), "ord")
    return graph.nodes_of(m, order=["source", "ord"]).select("label", "name", "source")


@query("G2", f"""{G}, raw AS (SELECT s_name AS h, p_name || '#' || p_partkey AS t, l_orderkey AS o, l_linenumber AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey)
SELECT h AS h_name, t AS t_name, CAST(arg_min(o, (o, n)) AS VARCHAR) AS source, 1.0 AS confidence FROM raw WHERE h IN (SELECT name FROM nodes) AND length(t) % 3 <> 0 GROUP BY h, t""")
def g2(spark, d):
    """Edges from line items, of which only some parts are known as nodes."""
    li = tb.table(spark, d, "lineitem").join(tb.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(tb.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rel = li.select(F.lit("SATELLITE").alias("h_label"), F.col("s_name").alias("h_name"), F.lit("PROVIDES").alias("type"), F.lit("DATA_PRODUCT").alias("t_label"), tb.product_name().alias("t_name"), F.col("l_orderkey").cast("string").alias("source"), F.lit("").alias("evidence"), "l_orderkey", "l_linenumber")
    known = tb.nodes(spark, d).where("label <> 'DATA_PRODUCT' OR length(name) % 3 <> 0")
    return graph.edges_of(rel, known, ["l_orderkey", "l_linenumber"]).select("h_name", "t_name", "source", "confidence")


_COORD = "CASE s_suppkey % 4 WHEN 0 THEN (s_suppkey % 60) || '.5° S, ' || (s_suppkey % 100) || '.25° E' WHEN 1 THEN '10-' || (s_suppkey % 50) || '°N, 70-' || (s_suppkey % 90) || '°E' WHEN 2 THEN (s_suppkey % 90) || '°W' ELSE 'somewhere' END"


@query("G3", """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'point' WHEN 1 THEN 'bounding_box' WHEN 2 THEN 'coordinate' END AS geo_type,
CASE WHEN s_suppkey % 4 = 0 THEN -(s_suppkey % 60) - 0.5 END AS lat, CASE WHEN s_suppkey % 4 = 0 THEN (s_suppkey % 100) + 0.25 END AS lon, CASE WHEN s_suppkey % 4 = 2 THEN -CAST(s_suppkey % 90 AS DOUBLE) END AS value,
CASE WHEN s_suppkey % 4 = 1 THEN CAST(least(10, s_suppkey % 50) AS DOUBLE) END AS lat_min, CASE WHEN s_suppkey % 4 = 1 THEN CAST(greatest(70, s_suppkey % 90) AS DOUBLE) END AS lon_max FROM supplier""")
def g3(spark, d):
    c = graph.parse_coordinates(F.expr(_COORD))
    return tb.table(spark, d, "supplier").select("s_suppkey", c.alias("c")).select("s_suppkey", "c.geo_type", "c.lat", "c.lon", "c.value", "c.lat_min", "c.lon_max")


@query("G4", """SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'marine' WHEN s_suppkey % 4 = 0 THEN 'point' WHEN s_suppkey % 4 = 3 THEN 'land' END AS geo_type,
CASE WHEN s_suppkey % 5 = 0 THEN 14.5 WHEN s_suppkey % 4 = 0 THEN -(s_suppkey % 60) - 0.5 WHEN s_suppkey % 4 = 3 THEN 1.0 END AS lat FROM supplier""")
def g4(spark, d):
    name = F.when(F.col("s_suppkey") % 5 == 0, F.lit("north Arabian Sea")).otherwise(F.expr(_COORD))
    g = graph.geocode(name, [("Arabian Sea", 14.5, 65.0)], [("some", 1.0, 2.0)])
    return tb.table(spark, d, "supplier").select("s_suppkey", g.alias("g")).select("s_suppkey", "g.geo_type", "g.lat")


_RULES = [("DATA_PRODUCT", "green", "MEASURES", "PARAMETER", "Greenness"), ("DATA_PRODUCT", "blue", "COVERS", "REGION", "CHINA"), ("SATELLITE", "#00000000", "MEASURES", "PARAMETER", "Humidity")]


@query("G5", f"""{G}, r AS (SELECT * FROM (VALUES {', '.join(str(r) for r in _RULES)}) v(label, needle, type, t_label, t_name)), d AS (SELECT DISTINCT label, name, type, t_label, t_name FROM nodes JOIN r USING (label) WHERE contains(name, needle)),
u AS (SELECT * FROM edges UNION SELECT * FROM d) SELECT type, count(*) AS n FROM u GROUP BY type""")
def g5(spark, d):
    e = tb.edges(spark, d)
    return graph.merge_edges(e, graph.derived_edges(tb.nodes(spark, d), _RULES)).groupBy("type").agg(F.count("*").alias("n"))


_PAIRS6 = "kinds AS (SELECT p_brand, p_size, 'Kind ' || (p_size % 7) AS tail FROM part), prs AS (SELECT DISTINCT p_brand AS head, tail FROM kinds UNION SELECT DISTINCT 'Maker ' || p_size, tail FROM kinds WHERE p_size <= 20), good AS (SELECT * FROM prs WHERE head IN (SELECT name FROM nodes WHERE label = 'INSTRUMENT') OR head IN ('Maker 1', 'Maker 2'))"


@query("G6", f"""{G}, {_PAIRS6} SELECT 'node' AS kind, label AS name, count(*) AS n FROM (SELECT label, name FROM nodes UNION SELECT 'INSTRUMENT', head FROM good UNION SELECT 'PARAMETER', tail FROM good) GROUP BY label
UNION ALL SELECT 'edge', type, count(*) FROM (SELECT * FROM edges UNION SELECT 'INSTRUMENT', head, 'MEASURES', 'PARAMETER', tail FROM good) GROUP BY type""")
def g6(spark, d):
    """Seed pairs of instruments and parameters merged into the graph; of missing instruments only the listed ones are made."""
    p = tb.table(spark, d, "part").withColumn("tail", F.concat(F.lit("Kind "), (F.col("p_size") % 7).cast("string")))
    more = p.where("p_size <= 20").select(F.concat(F.lit("Maker "), F.col("p_size").cast("string")).alias("head"), "tail")
    seeds = p.select(F.col("p_brand").alias("head"), "tail").unionByName(more).distinct()
    n, e = graph.merge_seeds(tb.nodes(spark, d), tb.edges(spark, d), seeds, ["Maker 1", "Maker 2"])
    return graph.label_counts(n).unionByName(graph.type_counts(e))


@query("G7", f"""{G} SELECT * FROM (SELECT 'satellites' AS sample, s_name AS name, NULL AS other FROM supplier ORDER BY s_name LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'regions', n_name, (n_nationkey % 60) || '.5,' || (n_nationkey * 3) || '.0' FROM nation WHERE n_nationkey % 2 = 0 ORDER BY n_name LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'provides', h_name, t_name FROM edges WHERE type = 'PROVIDES' ORDER BY h_name, t_name LIMIT 10)""")
def g7(spark, d):
    """Satellites, regions of which every other one has a place, and PROVIDES edges, ten of each."""
    nation = tb.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") % 60 + 0.5).cast("double").alias("lat"), (F.col("n_nationkey") * 3).cast("double").alias("lon"))
    return graph.verification_samples(tb.nodes(spark, d).join(nation, "name", "left"), tb.edges(spark, d))


# ---- cleaning and classification

_LABELS, _TYPES = ["SATELLITE", "DATA_PRODUCT", "REGION", "PARAMETER", "STATION"], ["PROVIDES", "COVERS", "MEASURES", "LOCATED_IN"]
_STATS = "SELECT kind, name, n FROM (SELECT 'node' AS kind, l AS name, count(x.name) AS n FROM (SELECT unnest(['SATELLITE', 'DATA_PRODUCT', 'REGION', 'PARAMETER', 'STATION']) AS l) LEFT JOIN {n} x ON x.label = l GROUP BY l UNION ALL SELECT 'edge', t, count(h_name) FROM (SELECT unnest(['PROVIDES', 'COVERS', 'MEASURES', 'LOCATED_IN']) AS t) LEFT JOIN {e} ON type = t GROUP BY t)"


@query("C1", f"{G}, s AS ({_STATS.format(n='nodes', e='edges')}) SELECT * FROM s UNION ALL SELECT kind, 'total', sum(n) FROM s GROUP BY kind")
def c1(spark, d):
    return graph.statistics(tb.nodes(spark, d), tb.edges(spark, d), _LABELS, _TYPES)


@query("C2", f"{G} SELECT h_name || ' ' || lower(type) || ' ' || t_name AS text FROM edges WHERE type IN ('PROVIDES', 'COVERS', 'MEASURES')")
def c2(spark, d):
    return classify.verbalise(tb.edges(spark, d)).select("text")


def _labelled(spark, d):
    return _docs(spark, d).join(tb.table(spark, d, "labels"), "doc_id").select("doc_id", "text", F.col("quality").alias("label"))


@query("C3", "SELECT quality AS label, CAST(floor(count(*) * 0.8) AS BIGINT) AS train, count(*) - CAST(floor(count(*) * 0.8) AS BIGINT) AS test FROM documents JOIN labels USING (doc_id) GROUP BY quality")
def c3(spark, d):
    return classify.split(_labelled(spark, d)).groupBy("label").agg(F.count_if("train").alias("train"), F.count_if(~F.col("train")).alias("test"))


@query("C4")
def c4(spark, d):
    """Held-out measures of the classifier of documents by quality that model selection chooses."""
    parts = classify.split(_labelled(spark, d))
    model = classify.select_model(parts.where("train")).bestModel
    return classify.metrics(model.transform(parts.where("NOT train")).select("label", "prediction"))


def edge_model(spark, d):
    """The classifier of edges: selected, fitted and kept once."""

    def fit():
        p = tb.provides(spark, d)
        rows = classify.positives(p, 500).unionByName(classify.negatives(p.select("satellite"), tb.measures(spark, d).select("name").distinct(), 500))
        return classify.select_model(rows).bestModel

    return classify.saved(tb.model_folder(spark, d, "edges", ["lineitem", "supplier", "part"]), fit)


@query("C5")
def c5(spark, d):
    scored = classify.score(tb.edges(spark, d), edge_model(spark, d))
    return scored.groupBy("type").agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))


@query("C6", """SELECT tp, fp, fn, tn, round((tp + tn) / n, 6) AS accuracy, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE 0 END AS f1
FROM (SELECT count(*) AS n, count(*) FILTER (toxic = 1 AND quality = 1) AS tp, count(*) FILTER (toxic = 0 AND quality = 1) AS fp, count(*) FILTER (toxic = 1 AND quality = 0) AS fn, count(*) FILTER (toxic = 0 AND quality = 0) AS tn FROM labels)""")
def c6(spark, d):
    return classify.metrics(tb.table(spark, d, "labels"), "toxic", "quality")


_INVALID = "type = 'COVERS' AND length(h_name) % 2 = 0"


@query("C7", f"{G} SELECT type, count(*) AS n FROM edges WHERE NOT ({_INVALID}) GROUP BY type")
def c7(spark, d):
    e = tb.edges(spark, d)
    return graph.delete_edges(e, e.where(_INVALID)).groupBy("type").agg(F.count("*").alias("n"))


@query("C7_dry_run", f"{G} SELECT type, count(*) AS n FROM edges WHERE {_INVALID} GROUP BY type")
def c7_dry_run(spark, d):
    e = tb.edges(spark, d)
    return graph.delete_edges(e, e.where(_INVALID), dry_run=True)


@query("C8", f"{G} SELECT type, count(*) AS n FROM edges WHERE NOT (h_label = 'DATA_PRODUCT' AND type = 'MEASURES' AND t_label = 'PARAMETER') GROUP BY type")
def c8(spark, d):
    return graph.without(tb.edges(spark, d), "DATA_PRODUCT", "MEASURES", "PARAMETER").groupBy("type").agg(F.count("*").alias("n"))


_KEPT = "NOT (type IN ('COVERS', 'MEASURES') AND length(h_name) % 2 = 0)"
_ORPHANS = ["DATA_PRODUCT", "REGION", "PARAMETER", "STATION"]
_C9 = f"kept AS (SELECT * FROM edges WHERE {_KEPT} AND type <> 'PROVIDES'), ends AS (SELECT h_label AS label, h_name AS name FROM kept UNION SELECT t_label, t_name FROM kept), orphans AS (SELECT label, name FROM nodes WHERE label IN ('DATA_PRODUCT', 'REGION', 'PARAMETER', 'STATION') AND (label, name) NOT IN (SELECT (label, name) FROM ends))"


@query("C9", f"{G}, {_C9} SELECT label, name FROM orphans")
def c9(spark, d):
    kept = tb.edges(spark, d).where(_KEPT).where("type <> 'PROVIDES'")
    return graph.orphans(tb.nodes(spark, d), kept, _ORPHANS).select("label", "name")


@query("C10", f"""{G}, {_C9}, after AS (SELECT * FROM nodes WHERE (label, name) NOT IN (SELECT (label, name) FROM orphans)), a AS ({_STATS.format(n='nodes', e='edges')}), b AS ({_STATS.format(n='after', e='kept')})
SELECT kind, name, a.n AS before, b.n AS after, b.n - a.n AS delta FROM a JOIN b USING (kind, name)""")
def c10(spark, d):
    n, e = tb.nodes(spark, d), tb.edges(spark, d)
    kept = e.where(_KEPT).where("type <> 'PROVIDES'")
    left = graph.delete_orphans(n, kept, _ORPHANS)
    stats = lambda n, e: graph.label_counts(n, _LABELS).unionByName(graph.type_counts(e, _TYPES))
    return graph.cleanup_report(stats(n, e), stats(left, kept))


@query("C10_details", f"""{G}, {_C9}, one AS (SELECT CASE WHEN {_INVALID} THEN 'invalid' ELSE 'valid' END AS part, type AS name, h_name || ' > ' || t_name AS x FROM edges UNION ALL SELECT 'orphans', label, name FROM orphans),
first AS (SELECT part, name, string_agg(x, ',' ORDER BY x) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY part, name ORDER BY x) AS r FROM one) WHERE r <= CASE part WHEN 'orphans' THEN 20 ELSE 30 END GROUP BY part, name)
SELECT part, name, n, samples FROM (SELECT part, name, count(*) AS n FROM one GROUP BY part, name) JOIN first USING (part, name)""")
def c10_details(spark, d):
    """Valid and invalid edges by type and orphans by label: their counts and the first of them."""
    e = tb.edges(spark, d)
    kept = e.where(_KEPT).where("type <> 'PROVIDES'")
    out = graph.cleanup_details(e.withColumn("valid", ~F.expr(_INVALID)), graph.orphans(tb.nodes(spark, d), kept, _ORPHANS))
    return out.select("part", "name", "n", F.array_join("samples", ",").alias("samples"))


@query("C10_samples", f"{G} SELECT type, string_agg(h_name || '>' || t_name, ',' ORDER BY h_name, t_name) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY h_name, t_name) AS r FROM edges WHERE {_INVALID}) WHERE r <= 30 GROUP BY type")
def c10_samples(spark, d):
    s = graph.samples_by(tb.edges(spark, d).where(_INVALID).select("type", "h_name", "t_name"), "type", ["h_name", "t_name"], 30)
    return s.select("type", F.array_join(F.transform("samples", lambda x: F.concat(x["h_name"], F.lit(">"), x["t_name"])), ",").alias("samples"))


@query("C11", f"{G} SELECT satellite || ' provides ' || product AS text, 1 AS label FROM provides WHERE length(product) > 3 ORDER BY satellite, product LIMIT 143")
def c11(spark, d):
    return classify.positives(tb.provides(spark, d), 143)


@query("C12")
def c12(spark, d):
    return classify.negatives(tb.provides(spark, d).select("satellite"), tb.measures(spark, d).select("name"), 199)


# ---- lookups


def _sat_queries(spark, d):
    return tb.table(spark, d, "supplier").select(F.substring("s_name", 1, 17).alias("sat")).distinct()


def _params(spark, d):
    return tb.table(spark, d, "part").select(F.element_at(F.split("p_type", " "), -1).alias("param")).distinct()


_SATQ = "sq AS (SELECT DISTINCT left(s_name, 17) AS sat FROM supplier)"
_PARQ = "pq AS (SELECT DISTINCT split_part(p_type, ' ', -1) AS param FROM part)"


@query("Q1", f"{G}, {_SATQ} SELECT sat, satellite, product FROM sq JOIN provides ON contains(satellite, sat) OR contains(sat, satellite) QUALIFY row_number() OVER (PARTITION BY sat ORDER BY satellite, product) <= 10")
def q1(spark, d):
    p = written(tb.provides(spark, d), "provides")  # its names are matched, then its edges joined
    return lookups.by_satellite(_sat_queries(spark, d), p).select("sat", "satellite", "product")


@query("Q2", f"{G}, {_SATQ}, {_PARQ} SELECT sat, param, satellite, product FROM sq, pq, provides JOIN measures USING (product) WHERE contains(satellite, sat) AND contains(name, param) QUALIFY row_number() OVER (PARTITION BY sat, param ORDER BY satellite, product, name) <= 10")
def q2(spark, d):
    q = _sat_queries(spark, d).join(_params(spark, d), F.lit(True))
    p = written(tb.provides(spark, d), "provides")
    return lookups.by_satellite_and_parameter(q, p, tb.measures(spark, d)).select("sat", "param", "satellite", "product")


@query("Q3", f"""{G}, {_PARQ}, r AS (SELECT n_name AS region_q, region, product FROM nation JOIN covers ON contains(region, n_name) OR contains(n_name, region)), m AS (SELECT param, product FROM pq JOIN measures ON contains(name, param) OR contains(param, name)),
h AS (SELECT DISTINCT region_q, param, satellite, product, region FROM r JOIN m USING (product) JOIN provides USING (product))
SELECT region_q, param, satellite, product FROM h QUALIFY row_number() OVER (PARTITION BY region_q, param ORDER BY satellite, product, region) <= 10""")
def q3(spark, d):
    names = tb.table(spark, d, "nation").select(F.col("n_name").alias("region_q"))
    q = names.join(_params(spark, d), F.lit(True))
    r = lookups.matching(names.withColumnRenamed("region_q", "region"), names, "region", "region_q")  # of nations' names, before edges are made
    s = tb.table(spark, d, "supplier").select(F.col("s_name").alias("satellite"))
    return lookups.by_region_and_parameter(q, tb.provides(spark, d), tb.covers(spark, d), tb.measures(spark, d), regions=r, satellites=s).select("region_q", "param", "satellite", "product")


@query("Q4", f"{G}, {_PARQ} SELECT param, product, name AS parameter FROM pq JOIN measures ON contains(name, param) OR contains(param, name) QUALIFY row_number() OVER (PARTITION BY param ORDER BY product, name) <= 10")
def q4(spark, d):
    return lookups.by_parameter(_params(spark, d), tb.measures(spark, d)).select("param", "product", "parameter")


@query("Q5", f"""{G}, {_SATQ}, h AS (SELECT sat AS q, label, name FROM sq JOIN nodes ON contains(name, sat) OR contains(sat, name) QUALIFY row_number() OVER (PARTITION BY sat ORDER BY label, name) <= 10),
n AS (SELECT h_label, h_name, string_agg(t_name || ':' || type, ',' ORDER BY t_name, t_label, type) AS near FROM (SELECT DISTINCT h_label, h_name, t_name, t_label, type FROM edges QUALIFY row_number() OVER (PARTITION BY h_label, h_name ORDER BY t_name, t_label, type) <= 5) GROUP BY ALL)
SELECT q, label, name, coalesce(near, '') AS near FROM h LEFT JOIN n ON h_label = label AND h_name = name""")
def q5(spark, d):
    r = lookups.search(_sat_queries(spark, d).withColumnRenamed("sat", "q"), tb.nodes(spark, d), tb.edges(spark, d))
    return r.select("q", "label", "name", F.array_join(F.transform("neighbours", lambda x: F.concat(x["name"], F.lit(":"), x["rel"])), ",").alias("near"))


@query("Q6", f"{G} SELECT satellite, product FROM provides")
def q6(spark, d):
    return lookups.products_of(tb.table(spark, d, "supplier").select(F.col("s_name").alias("satellite")), tb.provides(spark, d))


@query("Q7", f"{G} SELECT DISTINCT p_type AS name, p_brand AS instrument FROM part")
def q7(spark, d):
    m = tb.table(spark, d, "part").select(F.col("p_type").alias("name"), F.col("p_brand").alias("instrument")).distinct()
    return lookups.measured_by(tb.table(spark, d, "part").select(F.col("p_type").alias("name")), m)


@query("Q8", f"WITH {MENTIONS} SELECT DISTINCT text AS name, doc_id AS source, label FROM mentions WHERE text IN ('was', 'with')")
def q8(spark, d):
    q = spark.createDataFrame([("was",), ("with",)], "name string")
    return lookups.mentioned_in(q, mentions(spark, d, once=True).withColumnRenamed("doc_id", "source"))


def catalog(spark, d):
    return lookups.catalog(tb.table(spark, d, "supplier").select(F.col("s_name").alias("satellite")), tb.instruments(spark, d), tb.provides(spark, d))


_CATALOG = "cat AS (SELECT s_name AS satellite, coalesce((SELECT list_sort(list(instrument)) FROM instruments i WHERE i.satellite = s_name), []) AS ins, coalesce((SELECT list_sort(list(product)) FROM provides p WHERE p.satellite = s_name), []) AS pro FROM supplier)"


@query("Q9", f"{G}, {_CATALOG} SELECT satellite, array_to_string(ins, ',') AS instruments, array_to_string(pro, ',') AS products FROM cat")
def q9(spark, d):
    return catalog(spark, d).select("satellite", F.array_join("instruments", ",").alias("instruments"), F.array_join("products", ",").alias("products"))


@query("Q10", f"{G}, {_CATALOG} SELECT satellite FROM cat WHERE (contains(lower(satellite), '#1') OR len(list_filter(ins, lambda x: contains(lower(x), '#1'))) > 0 OR len(list_filter(pro, lambda x: contains(lower(x), '#1'))) > 0) AND len(list_filter(pro, lambda x: regexp_matches(x, '(?i)a|e'))) > 0")
def q10(spark, d):
    return lookups.search_catalog(catalog(spark, d), "#1", "ocean", {"ocean": "a|e"}).select("satellite")
