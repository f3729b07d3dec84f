"""Golden cases of helpers without an SQL form, and of rules whose texts the driver's tables don't hold."""

import json
import random
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import analytics, chunks, classify, crawl, documents, entities, graph, language, lookups, relations, retrieval
from corpusloom.sources import files
from corpusloom.streaming import jobs


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


def x():
    return F.col("x")


def test_columns(spark):
    cases = [
        (tx.nfkc("x"), "ﬁne ① Ａ", "fine 1 A"),
        (tx.strip_artifacts(x()), "a​b c\td\n e\x07ﬂ", "abc\td\n efl"),
        (tx.dates_in_text("x"), "on 15th Jan 2024, 1st February 2024 and 15/01/2024 or 05-03-1999; not 31/02/2024, 2024-01-15", "on 2024-01-15, 2024-02-01 and 2024-01-15 or 1999-03-05; not 31/02/2024, 2024-01-15"),
        (tx.iso_date(x()), "31/02/2024", "31/02/2024"),
        (tx.iso_date(x()), "5-3-2024", "2024-03-05"),
        (tx.expand_acronyms(x()), "SST from INSAT-3D and SST (known)", "SST (Sea Surface Temperature) from INSAT (Indian National Satellite System)-3D and SST (known)"),
        (tx.normalize_whitespace(x()), "  a \t b\n\n\n\nc  ", "a b\n\nc"),
        (tx.normalize_whitespace(x()), "", ""),
        (tx.is_devanagari(x()), "नमस्ते ab", True),
        (tx.is_devanagari(x()), "", False),
        (tx.repair_ocr(x(), F.lit("hi")), "क ा", "का"),
        (tx.document_type(x()), "A STUDY of rain", "report"),
        (tx.repair_decoding(x()), "20�N", "20°N"),
        (crawl.file_key(x()), "", "unknown_d41d8cd9"),
        (crawl.file_key(x()), "https://a.b/c?d=e&f#g", "a.b_c_d_e_f_g"),
        (crawl.content_kind(x()), "Text/HTML; charset=x", "html"),
        (crawl.resolve(F.lit("http://h/a/b?c"), x()), "d", "http://h/a/d"),
        (crawl.resolve(F.lit("http://h"), x()), "d", "http://h/d"),
        (crawl.join_url(F.lit("http://h/a/b/c"), x()), "../d", "http://h/a/d"),
        (F.array_join(entities.coordinates(x()), "|"), "at 10°N, 10-20°E and 12.5° N, 70.25° E", "10°N|10-20°E|12.5° N, 70.25° E"),
        (entities.first_candidate(x(), ["INSAT-3D", "INSAT-3DR", "INSAT"]), "data from insat-3dr", "INSAT-3DR"),
        (entities.first_candidate(x(), ["wind"]), "rewinding", ""),
        (entities.acronym(x()), "Ocean Wind Vectors", "OWV"),
        (retrieval.expand(x()), "QPE", "qpe quantitative precipitation estimation rainfall rainfall precipitation monsoon"),
        (graph.parse_coordinates(x())["lat"], "12.5° S, 70 E", -12.5),
        (graph.parse_coordinates(x())["lat_max"], "10-20°N, 60-70°E", 20.0),
        (graph.parse_coordinates(x())["value"], "30°W", -30.0),
        (graph.parse_coordinates(x())["geo_type"], "nowhere", None),
    ]
    for i, (column, value, want) in enumerate(cases):
        assert one(spark, column, value) == want, i


def test_html(spark):
    html = '<html><head><title>T &amp; U</title><META NAME="Desc" content="a"><meta property="desc" content="b"><meta charset="x"></head><body><nav>n</nav><p> x <b>y</b><!-- c --></p><script>s</script><footer>f</footer>z</body>'
    assert one(spark, crawl.visible_text("x"), html) == "T & U\nx\ny\nz"
    assert one(spark, crawl.meta_map("x"), html) == {"desc": "b"}
    assert one(spark, crawl.visible_text("x"), None) == ""
    odd = "a < b &amp; c</ x><style>p > a{}</style ><!-->y<!-- z --!>w<NAV>n<div></div></nav><META content=v property='og:T'>"
    assert one(spark, crawl.visible_text("x"), odd) == "a < b & c\ny\nw" and one(spark, crawl.meta_map("x"), odd) == {"og:t": "v"}


class FullParser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hrefs = []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and dict(attrs).get("href") is not None:
            self.hrefs.append(dict(attrs)["href"])


def test_links_are_those_of_a_full_parser(spark, sf_dir):
    forms = ["<a href='x'>", '<A HREF="x">', "<a href=x>", '<a href = "x">', '<!-- <a href="c"> -->', '<a data-href="d" id=1>', '<a href="?a=1&amp;b=2">', "<a href=it's>", '<a title="<a href=q>"\nhref=y/>', "<script>'<a href=\"no\">'</script>", "<a href>", "<abbr href=z>", "<nav><a href='../up'></nav>", '<link href="l"><area href="m">']
    rows = [(f"http://h/p/{i}", f * 2) for i, f in enumerate(forms)] + [("http://h/p/all", " ".join(forms)), ("http://h/p/none", None)]
    rows += [(r["url"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    want = []
    for url, html in rows:
        p = FullParser()
        p.feed(html or "")
        p.close()
        want += [(url, urljoin(url, h)) for h in p.hrefs]
    pages = spark.createDataFrame(rows, "url string, html string")
    assert sorted(tuple(r) for r in crawl.links(pages).collect()) == sorted(want)


def test_links_follow_the_base_reference(spark):
    rows = [("http://h/p/q", "<base target=_top><base href='/b/c/'><base href='http://no/'><a href=d><a href='../e'><a href=' /f '>"), ("http://h/p/q", "<base href='http://k/l/'><a href=m>")]
    got = [r["dst"] for r in crawl.links(spark.createDataFrame(rows, "url string, html string")).collect()]
    assert sorted(got) == ["http://h/b/c/d", "http://h/b/e", "http://h/f", "http://k/l/m"]


def test_chunks(spark):
    text = " ".join(f"Sentence number {i} is here. " for i in range(100))
    got = one(spark, chunks.chunked(x()), text)
    longest = max(len(s) for s in text.split(". ")) + 2
    assert all(len(c) <= 800 + longest for c in got) and got[0].startswith("Sentence number 0")
    for a, b in zip(got, got[1:]):  # the next chunk begins with whole words of the last one's end
        assert any(a.endswith(b[:k].strip()) for k in range(1, 101))
    assert one(spark, chunks.chunked(x()), "  short ") == ["short"] and one(spark, chunks.chunked(x()), None) == []


def test_mentions(spark):
    gazetteer = [("SATELLITE", "INSAT-3D"), ("SATELLITE", "INSAT"), ("PARAMETER", "SST")]
    got = one(spark, entities.mentions_in(x(), gazetteer), "INSAT-3D and INSAT give SST, not SSTs")
    assert [(m["text"], m["label"], m["start"], m["end"]) for m in got] == [("INSAT-3D", "SATELLITE", 0, 8), ("INSAT", "SATELLITE", 13, 18), ("SST", "PARAMETER", 24, 27)]


def test_relabel_and_regions(spark):
    rel = lambda m, l, c: one(spark, entities.relabel(F.lit(m), F.lit(l), F.lit(c), ["Ocean Wind Vectors"], ["INSAT"]), "")
    assert [rel("OWV", "ORG", "x"), rel("a gulf", "LOC", "x"), rel("INSAT-9", "ORG", "x"), rel("q", "ORG", "some dataset of"), rel("q", "ORG", "x")] == ["DATA_PRODUCT", "REGION", "SATELLITE", "DATA_PRODUCT", "ORG"]
    regions = entities.regions_in(x(), [("A", ["aa"], (0, 0, 10, 20)), ("B", ["bb"], (10, 20, 20, 40))])
    assert tuple(one(spark, entities.centre(regions), "Bb aA")) == (10.0, 20.0)
    assert tuple(one(spark, entities.centre(regions), "none")) == (15.0, 80.0)


def test_explicit_relations(spark):
    df = spark.createDataFrame([(1, "INSAT-3D provides SST daily")], "doc_id int, text string")
    r = relations.explicit(df, [("PROVIDES", "SATELLITE", "DATA_PRODUCT", r"(INSAT-\d+D?)\b.*\b(provides|offers)\b.*\b(SST)")]).first()
    assert (r["head"], r["type"], r["tail"], r["source"]) == ("INSAT-3D", "PROVIDES", "SST", "explicit_pattern")


#: Questions with the satellite, parameter and place that they name.
ENTITY_CASES = [
    ("Which files did INSAT-3D send last night?", "INSAT-3D", "", ""), ("How warm is the Arabian Sea, by sea surface temperature?", "", "sea surface temperature", "Arabian Sea"),
    ("winds, or wind, that SCATSAT-1 saw", "SCATSAT-1", "wind", ""), ("Has Gujarat had RAINFALL this week?", "", "rainfall", "Gujarat"), ("plot chlorophyll for me, from oceansat-2", "Oceansat-2", "chlorophyll", ""),
    ("a cyclone that nears the Bay of Bengal", "", "cyclone", "Bay of Bengal"), ("is Megha-Tropiques able to read humidity above India?", "Megha-Tropiques", "humidity", "India"),
    ("iceless slopes: snow on the Himalayas", "", "snow", "Himalayas"), ("INSAT-3DR: list each OLR granule", "INSAT-3DR", "OLR", ""), ("rewinding, cloudless and Keralan", "", "", ""),
]
SATELLITES = ["INSAT-3D", "INSAT-3DR", "INSAT-3A", "INSAT", "SCATSAT-1", "SCATSAT", "Oceansat-2", "Oceansat", "Megha-Tropiques", "SARAL", "Kalpana-1", "Kalpana"]
PARAMETERS = ["SST", "sea surface temperature", "rainfall", "wind", "humidity", "TPW", "total precipitable water", "OLR", "outgoing longwave radiation", "cyclone", "temperature", "cloud", "snow", "ice", "chlorophyll"]
PLACES = ["India", "Bay of Bengal", "Arabian Sea", "Himalayas", "Indian Ocean", "Kerala", "Gujarat"]
EXPANSION_CASES = [("monthly SST means", ["sea surface temperature", "thermal infrared"]), ("a map of TPW", ["total precipitable water", "humidity"]), ("night-time olr", ["earth energy"]), ("after the Cyclone passed", ["tropical cyclone", "hurricane"]), ("gusts of wind", ["scatterometer"]), ("qpe by district", ["rainfall", "monsoon"]), ("altimetry passes", ["wave height"])]


def test_evaluation_cases(spark):
    df = spark.createDataFrame(ENTITY_CASES, "query string, satellite string, param string, region string")
    q = F.col("query")
    ok = analytics.contained(F.col("satellite"), entities.first_candidate(q, SATELLITES)) & analytics.contained(F.col("param"), entities.first_candidate(q, PARAMETERS)) & analytics.contained(F.col("region"), entities.first_candidate(q, PLACES))
    assert tuple(analytics.evaluation(df, "entities", ok).first()) == ("entities", 10, 10, 100.0)
    df = spark.createDataFrame(EXPANSION_CASES, "query string, must array<string>")
    missing = analytics.phrases(F.col("must"), retrieval.expand(q))[1]
    assert df.where(F.size(missing) > 0).count() == 0


def test_files_round_trip(spark, tmp_path):
    doc = {"source_url": "http://a", "content_type": "text/html", "text": "t", "metadata": {"n": "1"}, "tables": [[["a", "b"]]], "unknown": 1}
    (tmp_path / "x/y").mkdir(parents=True)
    (tmp_path / "x/y/page.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "x/bad.json").write_text("{not json")
    got = {r["stem"]: r for r in files.read_documents(spark, str(tmp_path / "x")).collect()}
    assert got["page"]["tables"] == [[["a", "b"]]] and got["bad"]["text"] is None
    (tmp_path / "ex.json").write_text(json.dumps({"metadata": {}, "examples": [{"text": "a", "label": 1}, {"text": "b", "label": 0}]}, indent=1))
    assert files.read_examples(spark, str(tmp_path / "ex.json")).count() == 2
    (tmp_path / "log.jsonl").write_text('{"timestamp": "2024-01-01", "type": "up"}\n\n{bad\n')
    assert files.read_feedback(spark, str(tmp_path / "log.jsonl")).count() == 1
    row = files.feedback_rows(spark.createDataFrame([("x" * 600, "up")], "response string, type string")).first()
    assert len(row["response"]) == 500 and row["query"] == ""


def test_schema_and_refresh(spark):
    out = documents.to_schema(spark.createDataFrame([("u", 1)], "source_url string, extra int"))
    assert out.columns == list(documents.SCHEMA) and out.first()["tables"] == [] and out.first()["text"] == ""
    docs = spark.createDataFrame([(1, "a"), (2, "b2"), (3, "c")], "id int, text string")
    index = spark.createDataFrame([(1, "a"), (2, "b"), (9, "z")], "id int, text string").select("id", F.md5("text").alias("digest"))
    assert sorted(r["id"] for r in documents.refresh(docs, index, lambda d: d.select("id", "digest")).collect()) == [1, 2, 3]


def test_graph_invariants(spark):
    nodes = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "z")], "label string, name string")
    edges = spark.createDataFrame([("A", "x", "T", "B", "z"), ("A", "q", "T", "B", "z"), ("A", "x", "T", "B", "z")], "h_label string, h_name string, type string, t_label string, t_name string")
    assert graph.with_both_ends(edges, nodes).count() == 2
    assert [tuple(r) for r in graph.orphans(nodes, edges, ["A", "B"]).collect()] == [("A", "y")]
    assert graph.merge_edges(edges.limit(1), edges).count() == 2
    assert classify.metrics(spark.createDataFrame([], "label int, prediction int")).first()["f1"] == 0.0


def test_model_selection_and_a_saved_model(spark, tmp_path):
    """The chosen model separates what words separate, on rows that it hasn't seen, and is what its folder gives again."""
    rng = random.Random(2)
    word = lambda label: rng.choice(["solid", "sound"] if label else ["junk", "noise"])
    rows = [(" ".join([f"w{rng.randrange(300)}" for _ in range(8)] + [word(i % 3 > 0)] * 2), int(i % 3 > 0)) for i in range(600)]
    parts = classify.split(spark.createDataFrame(rows, "text string, label int"))
    chosen = classify.select_model(parts.where("train"), sizes=(1, 1 << 12), penalties=(1e-3,))
    assert chosen.bestModel.stages[1].getNumFeatures() == 1 << 12 and chosen.avgMetrics[1] > 0.95 > chosen.avgMetrics[0]
    fits = []
    model = classify.saved(f"file://{tmp_path}/model", lambda: fits.append(1) or chosen.bestModel)
    again = classify.saved(f"file://{tmp_path}/model", lambda: fits.append(1) or chosen.bestModel)
    assert len(fits) == 1
    test = parts.where("NOT train")
    assert classify.metrics(model.transform(test).select("label", "prediction")).first()["f1"] > 0.95
    got = [sorted(tuple(r) for r in m.transform(test).select("text", "prediction").collect()) for m in (model, again)]
    assert got[0] == got[1] and len(got[0]) == 120
    edges = spark.createDataFrame([("A", f"a{i}", "PROVIDES", "B", ["solid sound", "junk noise"][i % 2]) for i in range(20)], "h_label string, h_name string, type string, t_label string, t_name string")
    assert {(r["t_name"], r["valid"]) for r in classify.score(edges, again).collect()} == {("solid sound", True), ("junk noise", False)}


def test_negatives_are_exactly_as_many_as_asked(spark):
    s = spark.createDataFrame([(f"s{i % 7}",) for i in range(50)], "satellite string")
    t = spark.createDataFrame([(f"t{i}",) for i in range(11)] * 2, "name string")
    every = {f"s{i} provides t{j}" for i in range(7) for j in range(11)}
    for n in (30, 1000):
        got = [r["text"] for r in classify.negatives(s, t, n).collect()]
        assert len(got) == len(set(got)) == min(n, 77) and set(got) <= every
    assert {r["label"] for r in classify.negatives(s, t, 5).collect()} == {0}
    one, two = ({r["text"] for r in classify.negatives(s, t, 30, seed=x).collect()} for x in (1, 2))
    assert one != two and len({x.split()[0] for x in one}) == 7
    assert classify.negatives(s.limit(0), t, 5).count() == 0


def test_permutation_takes_every_cell_once(spark):
    for rows, columns in ((1, 9), (8, 1), (13, 40)):
        i, j = classify.permuted(F.col("id"), rows, columns)
        got = [tuple(r) for r in spark.range(rows * columns).select(i, j).collect()]
        assert sorted(got) == [(a, b) for a in range(rows) for b in range(columns)] and (rows * columns < 100 or got != sorted(got))


def test_distant_supervision_scores_what_it_was_not_fitted_on(spark):
    """Relations are told by the words between names; the graph knows most of the pairs, and the model finds the others."""
    rng = random.Random(9)
    says = {"PROVIDES": ["delivers", "offers"], "COVERS": ["sees", "spans"], "NONE": ["and", "beside"]}
    kinds = {"PROVIDES": "DATA_PRODUCT", "COVERS": "REGION"}
    docs, gazetteer, truth, known = [], set(), {}, []
    for i in range(60):
        sat, kind = f"SAT{i}", ["PROVIDES", "COVERS", "NONE"][i % 3]
        tail_type = kinds.get(kind) or rng.choice(list(kinds.values()))
        tail = f"Thing{i}"
        gazetteer |= {("SATELLITE", sat), (tail_type, tail)}
        truth[sat, tail] = kind
        if kind != "NONE" and i % 5:
            known.append((sat, kind, tail))
        for _ in range(12):
            filler = lambda: " ".join(rng.choice(["now", "then", "often", "here", "daily"]) for _ in range(rng.randrange(0, 3)))
            docs.append(f"{filler()} {sat} {rng.choice(says[kind])} {filler()} {tail} {filler()}. Nothing else.")
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    schema = relations.schema_frame(spark)
    placed = relations.placed_pairs(relations.in_sentences(df, entities.extract(df, sorted(gazetteer))))
    rows = relations.with_known(relations.pair_words(df, placed), spark.createDataFrame(known, "head string, type string, tail string"), schema).cache()
    words = {w for r in rows.select("words").collect() for w in r["words"]}
    assert not any("sat" in w or "thing" in w for w in words) and "f|between|delivers" in words
    whole = spark.createDataFrame([(a, b, c) for (a, b), c in truth.items()], "head string, tail string, real string")
    models = [relations.distant_model(rows.where(relations.fold_of("doc_id") == i)) for i in (0, 1)]
    scored = relations.cross_scored(rows, models)
    assert scored.count() == rows.count() == 720
    known_ones = relations.held_out(scored.where("label <> 'NONE'")).first()
    real = scored.join(whole, ["head", "tail"])
    unknown = relations.held_out(real.where("label = 'NONE' AND real <> 'NONE'").drop("label").withColumnRenamed("real", "label")).first()
    none = real.where("real = 'NONE'").agg(F.avg((F.col("type") == "NONE").cast("int"))).first()[0]
    assert known_ones["f1"] > 0.9 and unknown["f1"] > 0.8 and none > 0.9
    got = relations.predicted(scored, schema)
    assert got.count() > 200 and {r["type"] for r in got.select("type").distinct().collect()} == {"PROVIDES", "COVERS"}
    none = relations.distant_model(rows.limit(0))
    assert relations.cross_scored(rows, [none, none]).where("type <> 'NONE'").count() == 0


def test_language_by_an_expression(spark):
    profiles = {"de": {"der": 9, "und": 5}, "en": {"the": 9, "and": 5, "der": 1}, "aa": {"the": 9}}
    texts = ["der und", "the and", "the", "THE der", "zz", "", None, "xyzzy", "d\u00e9r", "x" * 600 + "the"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def brute(t):
        grams = [t.lower()[:500][i : i + 3] for i in range(len(t[:500]) - 2)] if t else []
        scores = {n: sum(p.get(g, 0) for g in grams) for n, p in profiles.items()}
        best = max(sorted(scores), key=lambda n: scores[n])
        return best if scores[best] else "en"

    out = df.select("doc_id", F.coalesce(language.language_of(F.col("text"), profiles), F.lit("en")).alias("l"))
    assert [r["l"] for r in out.orderBy("doc_id").collect()] == [brute(t) for t in texts]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan
    some = spark.createDataFrame([("en", f"text {i} the and") for i in range(500)] + [("de", "der und")], "lang string, text string")
    few = {r["lang"]: r["n"] for r in language.language_profiles(some, size=5, sample=50).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert few == {"en": 5, "de": 5}


def test_late_and_repeated_feedback(spark, tmp_path):
    """Exact counts: rows before the watermark and repeats within it are dropped, and days before it leave the state."""
    src, counts, ck = (str(tmp_path / n) for n in ("in", "counts", "ck"))
    lots = [
        [("2024-01-10 01:00", "up", "a"), ("2024-01-10 02:00", "up", "b"), ("2024-01-10 02:00", "up", "b"), ("2024-01-12 05:00", "down", "c")],
        [("2024-01-10 03:00", "up", "late"), ("2024-01-11 06:00", "up", "d"), ("2024-01-12 05:00", "down", "c"), ("2024-01-12 09:00", "down", "e")],  # the watermark is at 11th, 05:00
        [("2024-01-20 00:00", "up", "f"), ("2024-01-10 09:00", "up", "late too")],
        [("2024-01-12 10:00", "down", "late again"), ("2024-01-20 01:00", "up", "g")],
    ]
    late, queries = 0, []
    for lot in lots:
        spark.createDataFrame(lot, "t string, type string, id string").select(F.col("t").cast("timestamp").alias("timestamp"), "type", "id").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("timestamp timestamp, type string, id string").parquet(src)
        q = jobs.run_available(jobs.daily_feedback(stream, unique="id"), counts, ck)
        q.awaitTermination()
        queries.append(q)
        late += sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])
    assert late == 3
    got = {(str(r["day"]), r["type"]): r["n"] for r in jobs.read_counts(spark, counts, ["day", "type"]).collect()}
    assert got == {("2024-01-10", "up"): 2, ("2024-01-11", "up"): 1, ("2024-01-12", "down"): 2, ("2024-01-20", "up"): 2}
    assert [o["numRowsTotal"] for o in queries[-1].recentProgress[-1]["stateOperators"] if o["operatorName"] == "stateStoreSave"] == [1]


def test_an_index_merges_its_batches(spark, tmp_path):
    """Ten batches leave one base that alone is read; replayed batches change nothing; a merge that was cut off is ignored."""
    index = jobs.Index(spark, f"file://{tmp_path}/index", every=5)
    assert index.chunks() is None
    rows = lambda n: spark.createDataFrame([(f"d{n % 4}", n, f"text {n}"), ("same", -n, f"older {n}"), ("gone", n, "" if n else "was here")], "id string, version long, text string")
    state = lambda: sorted(tuple(r) for r in index.chunks().select("stem", "version", "text").collect())
    seen = []
    for n in range(12):
        index.add(rows(n), n)
        seen += [state()] if n in (0, 11) else []
    want = sorted([("d0", 8, "text 8"), ("d1", 9, "text 9"), ("d2", 10, "text 10"), ("d3", 11, "text 11"), ("same", 0, "older 0")])
    assert seen[-1] == want and seen[0] == [("d0", 0, "text 0"), ("gone", 0, "was here"), ("same", 0, "older 0")]
    assert index._parts() == [("base", 9), ("delta", 10), ("delta", 11)] and index.numbers("base") == [4, 9] and index.numbers("delta") == [5, 6, 7, 8, 9, 10, 11]
    for n in (9, 10):
        index.add(rows(n), n)
        assert state() == want and index._parts()[0] == ("base", 9)
    (tmp_path / "index/base/11/docs").mkdir(parents=True)
    assert state() == want
    index.merge()
    assert state() == want and index._parts() == [("base", 11)] and index.numbers("delta") == [10, 11]


def test_nearest_blocks_agree(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = v.where("id % 50 = 0").withColumnRenamed("id", "qid")
    rows = lambda **k: sorted(tuple(r) for r in retrieval.nearest(q, v, 5, **k).collect())
    assert rows() == rows(block=2)


def test_containing_finds_all_and_only_parts(spark):
    texts = ["", "a", "ab", "abc", "abcd", "xabcx", "é中é", "bca", None, "aaa", "aab aab"]
    parts = ["", "a", "b", "ab", "abc", "bcd", "中", "é中é", "zz", None, "aab a", "ca"]
    frame = lambda xs, c: spark.createDataFrame([(x,) for x in [*xs, *xs[:3]]], f"{c} string")
    got = sorted(tuple(r) for r in lookups.containing(frame(texts, "t"), frame(parts, "p"), "t", "p").collect())
    assert got == sorted((t, p) for t in texts for p in parts if t is not None and p is not None and p in t)


def test_sentences_of_mentions(spark):
    docs = spark.createDataFrame([(1, "A b. C d e.\nF g. "), (2, "long " * 900 + "A. B"), (3, "")], "doc_id long, text string")
    spans = {(r["doc_id"], r["sent"]): (r["s_start"], r["s_end"]) for r in relations.sentence_rows(docs).collect()}
    assert spans == {(1, 0): (0, 5), (1, 1): (5, 12), (1, 2): (12, 17), (2, 0): (0, 4503), (2, 1): (4503, 4504)}
    rows = [(1, "text", 0, "A", "X", 0, 1), (1, "text", 1, "b", "X", 2, 3), (1, "text", 2, "C", "X", 5, 6), (1, "text", 3, "cross", "X", 9, 14), (1, "meta", 4, "e", "X", 9, 10), (2, "text", 0, "A", "X", 4500, 4501), (2, "text", 1, "B", "X", 4503, 4504)]
    mentions = spark.createDataFrame(rows, "doc_id long, field string, ord int, text string, label string, start int, end int")
    assert sorted((r["doc_id"], r["sent"], r["text"]) for r in relations.in_sentences(docs, mentions).collect()) == [(1, 0, "A"), (1, 0, "b")]


def test_split_takes_exact_shares_of_hot_classes(spark):
    rows = [("a", f"t{i}") for i in range(997)] + [("b", "same")] * 50 + [("c", "x")] + [(None, "n")] * 3
    out = classify.split(spark.createDataFrame(rows, "label string, text string"), share=0.7)
    got = {r["label"]: r["n"] for r in out.groupBy("label").agg(F.count_if("train").alias("n")).collect()}
    assert got == {"a": 697, "b": 35, "c": 0, None: 2} and out.count() == len(rows)


def test_numbers_of_names_are_gapless(spark):
    df = spark.createDataFrame([(f"n{i % 300}",) for i in range(500)], "name string")
    assert sorted(r["i"] for r in classify.numbered(df, "name", "i").collect()) == list(range(300))


def test_seeds_make_only_listed_heads(spark):
    nodes = spark.createDataFrame([("INSTRUMENT", "A"), ("PARAMETER", "p")], "label string, name string")
    edges = spark.createDataFrame([("INSTRUMENT", "A", "MEASURES", "PARAMETER", "p")], "h_label string, h_name string, type string, t_label string, t_name string")
    pairs = spark.createDataFrame([("A", "p"), ("A", "q"), ("B", "q"), ("C", "r")], "head string, tail string")
    n, e = graph.merge_seeds(nodes, edges, pairs, ["B"])
    assert sorted(tuple(r) for r in n.collect()) == [("INSTRUMENT", "A"), ("INSTRUMENT", "B"), ("PARAMETER", "p"), ("PARAMETER", "q")]
    assert sorted((r["h_name"], r["t_name"]) for r in e.collect()) == [("A", "p"), ("A", "q"), ("B", "q")]


def test_repair_of_one_language(spark):
    df = spark.createDataFrame([("hi", "क र see www.x.qov.in"), ("en", "www.x.qov.in")], "lang string, t string")
    assert [r[0] for r in df.select(tx.repair_ocr(F.col("t"), F.col("lang"), rules={"see": "at"})).collect()] == ["क्र at www.x.gov.in", "www.x.qov.in"]


def test_hybrid_retrieval_fuses_curated_vector_and_graph_evidence(spark):
    rows = [(1, 0, 1, "k1", None, "curated"), (1, 0, 4, "77", "v", "satellite"), (1, 1, 1, None, "p#1", "graph"), (1, 1, 2, None, "v", "graph"), (2, 1, 1, None, "p#2", "graph")]
    df = spark.createDataFrame(rows, "qid long, stage int, rank int, id string, name string, type string")
    got = {(r["qid"], r["place"]): (r["identity"], r["score"]) for r in retrieval.fuse(df).collect()}
    assert got == {(1, 1): ("k1", 1.5), (1, 2): ("77", 0.7), (1, 3): ("p#1", 0.6), (1, 4): ("v", 0.6), (2, 1): ("p#2", 0.6)}


def test_postings_hold_numbers_not_texts(spark):
    """Whole results over segments of four texts, with common and rare strings; lists hold places alone."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab é中") for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    parts = [t[i : i + k] for t in texts[:40] for i, k in ((0, 1), (1, 2), (2, 3), (3, 7), (0, 30))] + ["zz", "aaz", "", None, "ab\nab"]
    built = lookups.index(spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id int, t string").repartition(5), "t")
    assert built.lists.columns == ["gram", "segment", "places"]
    got = sorted((r["part"], r["id"]) for r in lookups.held(built, spark.createDataFrame([(p,) for p in parts], "p string"), "p").collect())
    assert got == sorted((p, i) for p in {*parts} - {None} for i, t in enumerate(texts) if p in t)


def test_postings_are_small(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    built = lookups.index(docs.select("doc_id", "text"), "text")
    built.lists.write.parquet(str(tmp_path / "lists"))
    size = sum(f.stat().st_size for f in (tmp_path / "lists").glob("*.parquet"))
    n = built.lists.agg(F.sum(F.size("places"))).first()[0]
    assert n > 100_000 and size <= 12 * n


def test_cells_find_nearly_all_neighbours(spark):
    """Recall of the 15 nearest by cells against the exact ranking, and every score right."""
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(60, 32))
    x = (middles[np.arange(6000) % 60] + rng.normal(size=(6000, 32)) * 0.7).astype(np.float32)
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)] + [(9000, None)], "id long, embedding array<float>").repartition(4).cache()
    q = v.where("id % 50 = 0").withColumnRenamed("id", "qid")
    exact = {(r["qid"], r["id"]): r["score"] for r in retrieval.nearest(q, v).collect()}
    centroids = retrieval.fit_cells(v, 64, sample=3000)
    assert centroids.shape == (64, 32)
    got = [(r["qid"], r["id"], r["score"]) for r in retrieval.nearest(q, v, centroids=centroids, block=200).collect()]
    assert len(exact) == 15 * 120 and sum((a, b) in exact for a, b, _ in got) >= 0.9 * len(exact)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert all(abs(u[a] @ u[b] - s) < 1e-6 for a, b, s in got)
    everywhere = {(r["qid"], r["id"]): r["score"] for r in retrieval.nearest(q, v, centroids=centroids, probes=64).collect()}
    assert everywhere == exact
    assert retrieval.nearest(q, v.limit(0), centroids=retrieval.fit_cells(v.limit(0), 4)).count() == 0


def test_automaton_equals_the_alternation(spark):
    rng = random.Random(6)
    words = ["INSAT", "INSAT-3D", "3D", "sea", "sea surface", "surface temperature", "é", "日本", "a", "ab", "a b", "x_y", "3D and"]
    text = lambda n: "".join(rng.choice([*words, " ", "-", "_", ",", "\n", "Z"]) for _ in range(n))
    texts = [text(rng.randrange(0, 40)) for _ in range(400)] + ["", None]
    gazetteer = [(f"L{i % 4}", w) for i, w in enumerate(words)] + [("LATER", "sea"), ("NONE", "")]
    pattern = re.compile(r"(?<![A-Za-z0-9_])(?:" + "|".join(re.escape(t) for t in sorted(words, key=lambda t: (-len(t), t))) + r")(?![A-Za-z0-9_])")
    labels = {t: l for l, t in reversed(gazetteer)}
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [[tuple(m) for m in r["m"]] for r in df.select(entities.mentions_in(x(), gazetteer).alias("m")).collect()]
    assert got == [[(m[0], labels[m[0]], m.start(), m.end()) for m in pattern.finditer(t or "")] for t in texts]
    names = [w.upper() if i % 2 else w for i, w in enumerate(words)]
    both = df.select(*(entities.first_candidate(x(), names, few).alias(c) for c, few in (("a", 99), ("b", 0)))).collect()
    assert [r["a"] for r in both] == [r["b"] for r in both] and len({r["b"] for r in both}) > 5


def test_a_hundred_thousand_terms(spark):
    terms = [("T", f"term{i} x") for i in range(100_000)]
    df = spark.createDataFrame([(" ".join(f"term{i} x" for i in range(0, 100_000, 1000)),)] * 40, "x string")
    assert df.select(F.explode(entities.mentions_in(x(), terms))).count() == 4000


def test_pairs_of_a_document_with_many_mentions(spark):
    """20,000 distinct mentions: pairs are made block by block, and blocks of any size give the same pairs."""
    n = 20_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit("text").alias("field"), F.col("id").cast("int").alias("ord"), F.concat(F.lit("m"), "id").alias("text"), F.when(F.col("id") % 400 == 0, "SATELLITE").otherwise("REGION").alias("label"), (F.col("id") * 7).cast("int").alias("start"), (F.col("id") * 7 + 6).cast("int").alias("end"))
    docs = spark.createDataFrame([(1, "m" * 200)], "doc_id long, text string")
    schema = relations.schema_frame(spark)
    assert relations.co_occurring(docs, rows, schema).count() == 50 * 19_950
    few = rows.where("start < 7 * 900")
    placed = few.select("*", F.lit(0).alias("sent"), F.lit(0).alias("s_start"), F.lit(n * 7).alias("s_end"))
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(relations.co_occurring(docs, few, schema, size=50)) == key(relations.co_occurring(docs, few, schema, size=5000))
    pairs = relations.sentence_pairs(placed.where("start < 7 * 200"), size=9)
    assert pairs.count() == pairs.distinct().count() == 200 * 199
