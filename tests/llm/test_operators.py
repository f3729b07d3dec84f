"""Operators on edge cases, and against brute force, round trips, held-out accuracy or the library they follow."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import decontamination, embedding_dedup, ngram_join, queries, secrets, sentencepieces, sharding, toxicity, warc
from corpusloom.llm.common import BitFilter

EDGE = "doc_id long, text string, lang string, source string, n_chars long, spans int, items string, size string, toxic int, shard int, codes int"


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns named like results."""
    texts = [None, "", " ", "word", "word", "ten words of text that a benchmark item might also hold here", "x " * 30_000, "é😀\x00" * 200, "idiot clown password=abcdefghij"]
    rows = [(i, t, None, None, None, 1, "i", "s", 1, 2, 3) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "word again", *rows[0][2:]), (None, None, *rows[0][2:])]
    return spark.createDataFrame(rows, EDGE)


# ---- decontamination


def brute_hits(docs, items, width=10):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        for j in range(max(len(w) - width, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + width]), set()).add("null" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (x := tuple(w[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[x]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [decontamination.BLOCK, 15])
def test_decontamination(spark, edge, block):
    r = random.Random(4)
    words = [f"w{i}" for i in range(30)] + ["Ünï", "e"]
    items = [(1, None), (2, ""), (3, "w1"), (4, "W2 w3"), (None, "e Ünï e"), (10, "w5 " * 14), (10, "w7-w8_w9")] + [(20 + i, " ".join(r.choices(words, k=r.randrange(5, 30)))) for i in range(20)]
    docs = [(r0["doc_id"], r0["text"]) for r0 in edge.collect()]
    for i in range(60):
        t = r.choices(words, k=r.randrange(0, 80))
        if i % 3 == 0:
            w = (r.choice(items)[1] or "").split()
            t[5:5] = w[r.randrange(0, 3) :]
        docs.append((100 + i, " ".join(t)))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, items string, n_hit int").repartition(3)
    got = decontamination.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), block=block)
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(x) for x in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=key) == sorted(brute_hits(docs, items), key=key)
    # one item longer than a block, and one item in many rows
    long = [(1, " ".join(r.choices(words, k=95)))] + [(2, "w1 w2 w3 w4")] * 30
    got = decontamination.decontaminate(df, spark.createDataFrame(long, "item_id long, text string"), block=block)
    assert sorted((tuple(x) for x in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=key) == sorted(brute_hits(docs, long), key=key)
    assert decontamination.decontaminate(df, spark.createDataFrame([], "item_id long, text string")).where("contaminated").count() == 0
    assert decontamination.decontaminate(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


# ---- embeddings


def test_embedding_links_match_brute_force(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(40, 24))
    x = np.concatenate([x[i % 40] + r.normal(size=(1, 24)) * r.choice([0, 0.05, 0.3]) for i in range(500)]).astype(np.float32)
    rows = [(i, [float(a) for a in v], int(i % 3), "k") for i, v in enumerate(x)]
    rows += [(600, None, 0, "k"), (601, [0.0] * 24, 0, "k"), (602, [float("nan")] + [1.0] * 23, 0, "k"), (603, [None] + [1.0] * 23, 0, "k"), (604, rows[0][1], None, "k"), (605, [1.0, 2.0], 0, "k"), (606, [2.0, 4.0], 0, "k"), (607, [], 0, "k"), (608, [float("inf")] * 24, 0, "k"), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, kept string")
    got = sorted(tuple(g) for g in embedding_dedup.similar_vectors(df).collect())
    ok = lambda v: v and all(a is not None and np.isfinite(a) for a in v) and any(v)
    links = [set() for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            u, v = rows[a], rows[b]
            if ok(u[1]) and ok(v[1]) and u[2] is not None and u[2] == v[2] and len(u[1]) == len(v[1]):
                p, q = np.array(u[1], float), np.array(v[1], float)
                if p @ q / np.linalg.norm(p) / np.linalg.norm(q) >= 0.93:
                    links[a].add(b)
                    links[b].add(a)
    comp = list(range(len(rows)))
    for _ in rows:
        comp = [min([rows[comp[j]][0] and comp[j] or comp[j] for j in links[i] | {i}], key=lambda c: rows[c][0]) for i in range(len(rows))]
    want = sorted((rows[i][0], len(links[i]), rows[comp[i]][0], rows[comp[i]][0] == rows[i][0]) for i in range(len(rows)))
    assert sum(w[1] for w in want) > 1000
    assert got == want


@pytest.mark.parametrize(("share", "block"), [(4096, 9), (0.5, 2048), (0.001, 9)])
def test_embedding_blocks_and_axes(spark, sf_dir, monkeypatch, share, block):
    """All links of brute force with codes of one, two and three axes."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "SHARE", share)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({embedding_dedup.ORACLE['op3_embedding_dedup']})").fetchall()
    assert sorted(tuple(x) for x in embedding_dedup.similar_vectors(df).collect()) == sorted(want)
    assert embedding_dedup.similar_vectors(df.limit(0)).count() == 0


def test_embedding_null_and_equal_ids(spark):
    x, y = [1.0, 0.0, 0.1], [1.0, 0.01, 0.1]
    z = [0.0, 1.0, 0.0]
    rows = [(None, x, 1), (4, y, 1), (4, z, 1), (7, z, 1), (None, [-1.0, 0.0, 0.0], 1), (None, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((tuple(r) for r in embedding_dedup.similar_vectors(df).collect()), key=str)
    assert got == sorted([(None, 1, 4, False), (4, 1, 4, True), (4, 1, 4, True), (7, 1, 4, False), (None, 0, None, False), (None, 0, None, False)], key=str)


# ---- archives


def test_archives_round_trip(spark, tmp_path):
    body = "<p>" + "long page " * 30
    rows = [(5, "http://a/x y", body), (3, "http://b", body), (9, None, body), (4, "u", None), (6, "u", ""), (7, "v", "short"), (8, "v", "short"), (3, "http://b", body), (None, "n", body), (11, "é\n", "ünï" * 100)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, file string").repartition(2)
    folder = f"file://{tmp_path}/warcs"
    index = warc.write_archives(warc.classify(df), folder)
    got = warc.read_archives(index, folder, payload=True).collect()
    key = lambda r: (str(r["page_id"]), r["record_type"])
    got = sorted(got, key=key)
    assert len(got) == len(rows)
    by = {(r["page_id"]): r for r in got}
    assert (by[3]["record_type"], by[5]["record_type"], by[5]["refers_to"], by[9]["refers_to"], by[None]["refers_to"]) == ("response", "revisit", 3, 3, 3)
    assert by[8]["record_type"] == "response" and by[4]["payload_bytes"] == 0 and by[5]["payload_bytes"] == len(body) and by[5]["payload"] is None
    assert bytes(by[11]["payload"]).decode() == "ünï" * 100 and by[5]["url"] == "http://a/x%20y"
    some = warc.read_archives(index.where("record_type = 'revisit'"), folder)
    assert some.count() == 3
    for f in (tmp_path / "warcs").iterdir():  # plain gzip members of WARC records
        assert zlib.decompressobj(31).decompress(f.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert warc.write_archives(warc.classify(df.limit(0)), folder).count() == 0


# ---- sharding


def test_shards(spark, edge, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hot = spark.range(3000).select((F.col("id") + 10_000).alias("doc_id"), F.lit("the same text again").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    for df, n in ((docs, 5), (docs.unionByName(hot), 20), (edge, 4), (edge.limit(0), 3)):
        rows = sharding.shard_by_bytes(df, n, size, F.col("text")).collect()
        assert len(rows) == df.count()
        slots = Counter()
        for r in sorted(rows, key=lambda r: (r["shard"], r["slot"])):
            assert r["slot"] == slots[r["shard"]]
            slots[r["shard"]] += 1
        bytes_ = Counter()
        for r in rows:
            bytes_[r["shard"]] += r["size"]
        if rows and df is not edge:
            most = max(r["size"] for r in rows)
            assert max(bytes_.values()) - min(bytes_.values()) <= 2 * most + 0.02 * sum(bytes_.values()) / n


def test_shard_query_against_plain_rules(spark, sf_dir):
    """Sizes, checksums, law, gapless slots, near equal sizes and equal texts together, of the query itself."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = sharding.op8_sharding(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    raw = {i: (t or "").encode() for i, t in texts.items()}
    assert all((r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw[r["doc_id"]]) + 16, zlib.crc32(raw[r["doc_id"]]), "bytes", None) for r in rows)
    slots, sizes, places = Counter(), Counter(), {}
    for r in sorted(rows, key=lambda r: (r["shard"], r["slot"])):
        assert 0 <= r["shard"] < 40 and r["slot"] == slots[r["shard"]]
        slots[r["shard"]] += 1
        sizes[r["shard"]] += r["size"]
        places.setdefault(texts[r["doc_id"]], []).append(r["shard"])
    mean, most = sum(sizes.values()) / 40, max(r["size"] for r in rows)
    group = Counter()
    for r in rows:
        group[texts[r["doc_id"]]] += r["size"]
    assert all(len(set(s)) == 1 for t, s in places.items() if group[t] <= mean / 100)
    assert max(sizes.values()) - min(sizes[i] for i in range(40)) <= 2 * max(most, *group.values()) + mean / 50


# ---- tokens


def test_tokens_match_the_library(spark, edge):
    r = random.Random(1)
    alphabet = [*"ab Te  \n\t.,_{}\r12é😀▁ñ中²½", "the ", "   ", "\r\n", ");", "\x00", "<s>", "ing", "ज़"]
    texts = ["".join(r.choices(alphabet, k=r.randrange(60))) for _ in range(800)] + ["a" * 5000, "▁" * 300, "x" * 41 + " y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(edge.select("doc_id", "text"))
    model = sentencepieces.default_model()
    library = sentencepieces.encoder(model).library
    for row in sentencepieces.encode_texts(df.withColumn("ids", F.lit(1)), model, decoded=True).collect():
        want = library.encode(row["text"] or "", add_eos=True)
        assert row["ids"] == want and not row["corrected"] and row["n_tokens"] == len(want) and row["decoded"] == library.decode(want)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert sentencepieces.encode_texts(df.limit(0), model).count() == 0


def test_the_agenda_needs_no_correction_on_the_whole_table(spark, sf_dir):
    got = sentencepieces.op9_sentencepiece(spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and got.where("corrected").isEmpty()


def test_library_stands_where_the_agenda_differs():
    e = sentencepieces.MergeEncoder(sentencepieces.default_model())
    texts = ["some words here", None, "other words"]
    want = [e.library.encode(t or "", add_eos=True) for t in texts]
    e.merge = lambda text: (7,) if "words" in text else sentencepieces.MergeEncoder.merge(e, text)
    assert [(r[0], r[2]) for r in e.encode_batch(texts)] == [(want[0], True), (want[1], False), (want[2], True)]
    e.known[sentencepieces.SPACE + "here"] = (1, 2, 3)  # a wrong stretch is met by the check of a whole text
    assert [r[0] for r in e.encode_batch(texts[:1])] == want[:1]


# ---- toxicity


def test_ordinal_model_holds_out(spark):
    """English documents, as labels of the others in these tables don't follow their texts."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang = 'en'")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").join(docs.select("doc_id"), "doc_id")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    model = toxicity.fit(docs, train)
    assert model.thresholds == sorted(model.thresholds)
    got = toxicity.score(docs.join(test.select("doc_id", F.col("toxic").alias("y")), "doc_id"), model).select("y", "toxic", "severity").collect()
    toxic = [r for r in got if r["y"]]
    clean = [r for r in got if not r["y"]]
    assert len(toxic) > 100 and sum(r["toxic"] for r in toxic) >= 0.85 * len(toxic) and sum(r["toxic"] for r in clean) <= 0.01 * len(clean)
    assert np.mean([r["severity"] for r in toxic]) > np.mean([r["severity"] for r in clean]) + 1


def test_ordinal_fit_recovers_order():
    r = np.random.default_rng(0)
    x = r.integers(0, 4, 3000)
    grades = np.clip(x + r.integers(-1, 2, 3000), 0, 3)
    w, t = toxicity.fit_ordinal(np.arange(3000), np.zeros(3000, int), x.astype(float), grades, 1)
    assert w[0] > 0.5 and (np.diff(t) > 0).all()


def test_scores_match_a_plain_loop(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert model.weights and len(model.thresholds) >= 2
    for r in toxicity.score(docs.unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string")), model).collect():
        counts = Counter()
        for w in re.findall(r"[^\W\d_]+", (r["text"] or "").lower()):
            for f in {w} | {w[:n] + "*" for n in (4, 5) if len(w) >= n}:
                counts[f] += 1
        x = sum(w * np.log(1 + counts[f]) for f, w in model.weights.items() if counts[f])
        p = [1 / (1 + np.exp(t - x)) for t in model.thresholds]
        assert abs(r["severity"] - sum(p)) < 1e-5 and r["toxic"] == (p[0] >= 0.5) and abs(r["grade"] - sum(p)) <= 0.50001


def test_toxicity_edge_cases(spark, edge):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(edge, toxicity.fit(edge, none)).where("toxic OR severity <> 0").count() == 0
    odd = spark.createDataFrame([(1, None, None), (99, 1, 1), (None, 1, 1), (2, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(edge, toxicity.fit(edge, odd)).count() == edge.count()


# ---- all together


def test_other_operators_on_edge_cases(edge):
    got = ngram_join.ngram_components(edge)
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and got.count() == edge.count()
    assert secrets.find_secrets(edge).where("n_assign = 1").count() == 1


def test_bit_filter_lets_all_members_through(spark):
    f = BitFilter.build(spark.range(-500, 500).select((F.col("id") * 7919 * 104729).alias("x")), 1000)
    x = np.arange(-500, 500, dtype=np.int64) * 7919 * 104729
    assert f.has(x).all() and f.has(np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 10_000)).mean() < 0.3


def test_pipeline_against_brute_force(spark, sf_dir):
    """Stage by stage: toxic by the model's own scores, near duplicates, windows and secrets by brute force, tokens by the library."""
    from .test_ngram_join import brute
    from .test_spans import brute_secrets

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, sf_dir)
    assert kept.columns == corpus_pipeline.COLUMNS and 0 < kept.count() <= docs.count()
    near = stages["near_duplicates"](spark, kept.unionByName(kept.limit(3)), sf_dir)
    want = brute([(r["doc_id"], r["text"]) for r in kept.collect()], corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    clean = stages["decontamination"](spark, near, sf_dir)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(h[0] for h in brute_hits([(r["doc_id"], r["text"]) for r in near.collect()], items) if not h[-1])
    safe = stages["secrets"](spark, clean, sf_dir)
    assert safe.columns == corpus_pipeline.COLUMNS and all(not brute_secrets(r["text"]) for r in safe.collect())
    assert {r["doc_id"] for r in safe.collect()} == {r["doc_id"] for r in clean.collect()}
    out = stages["encode"](spark, safe, sf_dir).collect()
    library = sentencepieces.encoder(sentencepieces.default_model()).library
    texts = {r["doc_id"]: r["text"] for r in safe.collect()}
    assert len(out) == len(texts) and all(r["ids"] == library.encode(texts[r["doc_id"]], add_eos=True) for r in out)


def test_pipeline_stages_on_edge_cases(spark, edge, sf_dir):
    """Nulls, empty and long texts, ties, repeated rows, clashing and extra columns, and an empty table in every stage."""
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    distinct = sorted({r for r in rows}, key=str)
    for name, stage in corpus_pipeline.STAGES:
        got = [(r["doc_id"], *([r["text"]] if name != "encode" else [])) for r in stage(spark, edge, sf_dir).collect()]
        if name == "encode":
            assert sorted(map(str, got)) == sorted(str((i,)) for i, _ in rows)
        elif name == "near_duplicates":  # "word" twice and its repeated row, and an item of ten words, whose rows differ
            assert sorted(got, key=str) == [r for r in distinct if r != (4, "word")]
        elif name == "secrets":
            assert (8, "idiot clown [SECRET]") in got and len(got) == len(rows) and (0, None) in got
        else:
            assert set(got) <= set(rows) and (0, None) in got and (1, "") in got
        assert stage(spark, edge, sf_dir).columns == (corpus_pipeline.COLUMNS if name != "encode" else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])
        assert stage(spark, edge.limit(0), sf_dir).count() == 0


def test_pipeline_judges_rows_and_not_ids(spark, sf_dir):
    words = [f"w{i}" for i in range(300)]
    near, other = " ".join([*words, "end"]), " ".join(f"v{i}" for i in range(40))
    rows = [(3, " ".join(words)), (5, near), (5, other), (None, other), (None, near), (6, other), (6, other), (7, None), (7, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()]
    assert sorted(got, key=str) == sorted([(3, " ".join(words)), (5, other), (7, None), (7, "")], key=str)


def test_pipeline_drops_near_copies_of_five_words(spark, sf_dir):
    """Copies between op7's threshold and the stage's: lone word changes, an appended block and a replaced one."""
    from .test_ngram_join import brute

    words = [f"w{i}" for i in range(500)]
    lone = lambda k: [f"x{i}" if i % 50 == 25 and i < 50 * k else w for i, w in enumerate(words)]
    copies = [words, lone(9), lone(10), words + [f"y{i}" for i in range(90)], [f"z{i}" for i in range(40)] + words[40:], [f"v{i}" for i in range(120)] + words[120:]]
    texts = [(10**6 + i, " ".join(ws)) for i, ws in enumerate(copies)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], docs.schema))
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect())
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80)
    assert got == sorted(i for i, (_, c) in want.items() if i == c)
    assert [i for i in got if i >= 10**6] == [10**6, 10**6 + 5]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == sorted(want, key=str)


def test_every_operator_has_its_query():
    assert [k.split("_")[0] for k in queries.queries()] == [f"op{n}" for n in range(1, 11)]
