"""Registered queries against their SQL on small tables of odd rows."""

import hashlib
import random
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest

from corpusloom.operators import lookups, retrieval
from corpusloom.plans import registry
from tests.test_queries import canonical


@pytest.fixture
def against_sql(spark, tmp_path):
    """Runs a query and its SQL over tables(name -> DataFrame) and compares them."""

    def run(name, **tables):
        con = duckdb.connect()
        for t, df in tables.items():
            df.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        got = canonical(registry.queries()[name](spark, str(tmp_path)).toPandas())
        pd.testing.assert_frame_equal(got, canonical(con.execute(registry.oracle_sql()[name]).df()), check_dtype=False)
        return got

    return run


def test_language_profiles_read_all_texts(spark, against_sql):
    """More texts of a language than a profile was once fitted on, letters with odd lower cases and beyond 16 bits, a text longer
    than a piece, and texts without a language."""
    rows = [(i, "ab%04d cd%04d" % (i, i * 7 % 3000), "en") for i in range(3000)]
    rows += [(4000 + i, "ab%04d xy" % i, "de") for i in range(0, 3000, 2)]
    odd = ["\u039f\u0394\u039f\u03a3 \u039f\u0394\u039f\u03a3", "\u0130stanbul \u0130", "a\U0001f600bc \U0001f600\U0001f601\U0001f602", "?bc ?bc", "x\ny", "", "ab", None, "pq" * 4105]
    rows += [(9000 + i, t, lang) for i, t in enumerate(odd) for lang in ["el"]] + [(9100 + i, f"none{i} zz zz", None) for i in range(40)] + [(9200, "pqpq", "fr"), (9201, "zz zz", "fr")]
    got = against_sql("T7", documents=spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(got["language"]) >= {"en", "de", "el"}

def test_every_text_with_a_mark_has_a_vector_of_unit_length(spark, against_sql):
    h = lambda w: int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
    a, b = next((a, b) for a, b in combinations([f"w{i}" for i in range(200)], 2) if h(a) % 256 == h(b) % 256 and h(a) >> 63 != h(b) >> 63)
    texts = [f"{a} {b}", f"{a} {b} " * 3, a, "\x0b", "\u00a0 \u3000", "\x1c\n", " \t\r\n\f", "", None, "word"]
    got = against_sql("I3", documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert list(got.sort_values("doc_id")["norm"]) == ["1.0"] * 6 + ["0.0"] * 3 + ["1.0"]


def _rows_made(plan, of=""):
    """The rows that each step of a plan, or each of one kind, has made; stages of an adaptive plan are looked into."""
    kind = plan.getClass().getSimpleName()
    rows = plan.metrics().get("numOutputRows")
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    return ([rows.get().value()] if rows.isDefined() and kind.startswith(of) else []) + [n for p in inner for n in _rows_made(p, of)]


def test_region_and_parameter_makes_few_hits(spark):
    """All satellites provide all products, and these cover all regions: 800,000 hits, of which 10 a query are asked for."""
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    provides = frame([(f"s{s:03}", f"p{p:03}") for s in range(200) for p in range(200)], "satellite string, product string")
    covers = frame([(f"p{p:03}", f"R{r:02}") for p in range(200) for r in range(20)], "product string, region string")
    measures = frame([(f"p{p:03}", "tin") for p in range(200)], "product string, name string")
    queries = frame([(f"R{r:02}", "tin") for r in range(20)], "region_q string, param string")
    out = lookups.by_region_and_parameter(queries, provides, covers, measures)
    got = out.collect()
    assert sorted((r["region_q"], r["satellite"], r["product"], r["rank"]) for r in got) == [(f"R{r:02}", "s000", f"p{p:03}", p + 1) for r in range(20) for p in range(10)]
    assert 200 <= max(_rows_made(out._jdf.queryExecution().executedPlan())) <= 40_000


def test_region_and_parameter_by_first_satellites(spark):
    """Queries answered by the first satellites and those that need all agree with plain loops: names that contain one another,
    products of several parameters, repeated edges, and queries with few hits or none."""
    rng = random.Random(5)
    pick = lambda xs, k: sorted(rng.sample(xs, k))
    sats, products, regions, names = [f"S{i:02}" for i in range(30)], [f"p{i}" for i in range(60)], ["N1", "N11", "N12", "N2", "N3"], ["tin", "tin foil", "steel", "rare"]
    provides = [(s, p) for p in products[:50] for s in pick(sats[8:] if p in products[:20] else sats, rng.randrange(1, 12))]
    covers = [(p, r) for p in products for r in pick(regions[:4], rng.randrange(1, 4))] + [("p21", "N3"), ("p22", "N3")]
    measures = [(p, m) for p in products for m in pick(names[:3], rng.randrange(1, 3))] + [("p3", "rare")]
    queries = [(r, m) for r in [*regions, "N", "none"] for m in [*names, "t", "lead"]]
    either = lambda a, b: a in b or b in a
    want = []
    for q, m in queries:
        hits = {(s, p, r) for p, r in covers if either(r, q) for x, name in measures if x == p and either(name, m) for s, y in provides if y == p}
        want += [(q, m, *h, i + 1) for i, h in enumerate(sorted(hits)[:10])]
    frame = lambda rows, names: spark.createDataFrame([*rows, *rows[:9]], names)
    tables = frame(queries, "region_q string, param string"), frame(provides, "satellite string, product string"), frame(covers, "product string, region string"), frame(measures, "product string, name string")
    for more in ({}, {"satellites": tables[1], "first": 1}, {"satellites": tables[1], "first": 6}, {"satellites": tables[1], "first": 99}):
        got = lookups.by_region_and_parameter(*tables, **more).select("region_q", "param", "satellite", "product", "region", "rank").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_rows_of_a_cell_are_moved_once(spark):
    """20,000 queries and 5,000 vectors of one cell: every row is sent to one task, and the ranking is that of one product."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(5000, 8)).astype(np.float32), rng.normal(size=(20_000, 8)).astype(np.float32)
    v = spark.createDataFrame(pd.DataFrame({"id": range(5000), "embedding": x.tolist()}), "id long, embedding array<float>")
    q = spark.createDataFrame(pd.DataFrame({"qid": range(20_000), "embedding": y.tolist()}), "qid long, embedding array<float>")
    out = retrieval.nearest(q, v, 3, centroids=np.ones((1, 8)) / 8**0.5)
    got = {(r["qid"], r["rank"]): (r["id"], r["score"]) for r in out.collect()}
    unit = lambda m: m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    s = np.round(unit(y[::40]) @ unit(x).T, 6)
    want = {(int(n) * 40, k + 1): (int(i), row[i]) for n, row in enumerate(s) for k, i in enumerate(np.lexsort((np.arange(5000), -row))[:3])}
    assert len(got) == 60_000 and all(got[k][0] == i and abs(got[k][1] - w) < 1e-6 for k, (i, w) in want.items())
    assert sum(_rows_made(out._jdf.queryExecution().executedPlan(), "Generate")) == 25_000
