"""Personal data and secrets against plain Python searches over the same texts."""

import hashlib
import random
import re

import pytest

from corpusloom.llm import pii, secrets

EDGE = [
    None, "", "a", "x" * 50_000, "1" * 30_000, "1 " * 9_000, "a.b@c.d_x@e.f.g@h.i é a@b@c.de", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004", "é😀 4111 1111 1111 1111 4111-1111-1111-1112",
    "+1 (988) 555-2485 +1 +12345678901234567 +1(23)", "password=abcdefgh Token : 'x' api_key=\"0123456789abcdef\" PASSWD:short secret= ſecret=abcdefghij", "AKIA" * 3 + "AKIAABCDEFGHIJKL AKIAabc", "f" * 31 + " " + "0" * 33, "a@b.c" * 500,
]


def luhn(s):
    ds = [int(c) for c in s][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(ds)) % 10 == 0


def brute_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return sorted((m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m[0]))


def brute_secrets(text):
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    words = "|".join(either(w) for w in ("password", "passwd", "secret", "token")) + "|" + either("api") + "_?" + either("key")
    kinds = [("assign", f"({words})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 32)]
    return sorted((m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m))


def spell(spans):
    return ",".join(f"{name}:{s}:{e}" for s, _, name, e in spans)


def texts(spark, sf_dir):
    docs = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    docs += [" ".join(docs[i : i + 3]) + " mail me at jo.x@ex-am.ple.org or 10.0.0.255, +44 20 7946 0958; card 4539 1488 0343 6467" for i in range(0, 20, 4)]
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(EDGE + docs)], "doc_id long, text string, spans string")


@pytest.mark.parametrize(("find", "brute"), [(pii.find_pii, brute_pii), (secrets.find_secrets, brute_secrets)])
def test_base_spans_match_brute_force(spark, sf_dir, find, brute):
    df = texts(spark, sf_dir)
    got = {r["doc_id"]: r for r in find(df).collect()}
    rows = df.collect()
    assert len(got) == len(rows)
    for r in rows:
        want = spell(brute(r["text"]))
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (r["text"] or "")[:80]
        assert set(filter(None, want.split(","))) <= set(got[r["doc_id"]]["spans"].split(","))


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    rows = [(i, f"Please write to user{i}@example.org today") for i in range(20)]
    rows += [(100 + i, f"please write to ZX{i}81234Q now") for i in range(3)] + [(200, "nothing like ZX981234Q here"), (201, "part of AB12345 and of AB12346 is of AB12347")]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[100 + i] for i in range(3)] == ["found:16:25"] * 3
    assert got[200] == got[201] == "" and got[5] == "email:16:33"


def test_identifiers_of_any_length_are_candidates(spark):
    ids = ["A1234", "ZX081234Q", "A-1_b", "x" * 50 + "7", "q9" * 31 + "z", "k3" * 32, "k3" * 40, "AB12345-"]
    rows = [(i, f"Please write to user{i}@example.org today") for i in range(60)]
    rows += [(100 + i, f"please write to {x} now") for i, x in enumerate(ids)] + [(200, "please write to A123 now"), (201, "please write to letters now"), (202, "please write to a1b2c3@ now")]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[100 + i] for i in range(len(ids))] == [f"found:16:{16 + len(x.rstrip('-'))}" for x in ids]
    assert got[200] == got[201] == got[202] == ""


def brute_found(rows):
    """Spans found by contexts: links of patterns and identifiers, and the rounds of scoring, in plain loops."""
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    token = r"(?<![A-Za-z0-9_@.+-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9][A-Za-z0-9_-]{3,}[A-Za-z0-9](?![_-]*[A-Za-z0-9@])"
    blank = "[\\s!-/:-@\\[-`{-~]"
    context = rf"([a-z:#=]+){blank}+([a-z:#=]+){blank}*$"
    links, places = {}, []
    for i, t in rows:
        bases = [(m.start(), m.end()) for p in plain.values() for m in re.finditer(p, t)]
        for p, seed in [*((p, 1) for p in plain.values()), (token, 0)]:
            at = 0
            for m in re.finditer(p, t):
                before, at = t[at : m.start()][-80:].lower(), m.end()
                found = re.search(context, before)
                if found and (seed or not any(a < m.end() and m.start() < b for a, b in bases)):
                    pattern = re.sub(r"\s+", " ", found[0])
                    links[pattern, m[0]] = max(seed, links.get((pattern, m[0]), 0))
                    if not seed:
                        places.append((i, pattern, m.start(), m.end()))
    score = {}
    for (_, x), seed in links.items():
        score[x] = max(seed, score.get(x, 0))
    seeds = dict(score)
    for _ in range(pii.ROUNDS):
        mean, count = {}, {}
        for p in {p for p, _ in links}:
            held = [x for q, x in links if q == p]
            mean[p] = sum(score[x] for x in held) / (len(held) + pii.SMOOTH)
            count[p] = sum(links[p, x] for x in held)
        for x in score:
            doubt = 1.0
            for p in (p for p, y in links if y == x):
                doubt *= max(1 - (mean[p] if count[p] >= pii.SEEDS else 0), 1e-9)
            score[x] = 1.0 if seeds[x] else 1 - doubt
    good = {p for p in mean if mean[p] >= pii.CONFIDENT and count[p] >= pii.SEEDS}
    return sorted({(i, f"found:{a}:{b}") for i, p, a, b in places if p in good}), good, set(mean)


def test_found_spans_match_plain_scoring(spark):
    """Contexts with many or few seeds, shared identifiers, and unseen ones that only further rounds reach."""
    r = random.Random(6)
    ids = [f"QX{i}7{chr(97 + i)}Z" for i in range(14)]
    texts = []
    for k in range(9):  # context k has k seeds, and each identifier stands in some contexts
        lead = f"call {'abcdefghi'[k] * 3} desk"
        texts += [f"Now {lead}: user{k}x{j}@example.org ok" for j in range(3 * k)] + [f"then {lead} +1 555 0100 {k}{j}00 as said" for j in range(k)]
        texts += [f"{lead} {r.choice(ids)} and {lead} {r.choice(ids)}" for _ in range(r.randrange(1, 5))]
    texts += [f"see the file {x} there" for x in ids[:4]] + [f"see the file u{j}@ex.org there" for j in range(6)] + ["", "plain words", "a b c1234"]
    rows = list(enumerate(texts))
    want, good, patterns = brute_found(rows)
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert 2 <= len(good) < len(patterns) - 3 and len(want) > 3
    assert sorted((x["doc_id"], s) for x in got for s in x["spans"].split(",") if s.startswith("found")) == want


def test_offsets_of_very_many_matches(spark):
    rows = [(0, "é " + "a@b.c " * 700), (1, "1.2.3.4 " * 256), (2, "1.2.3.4 " * 257), (3, None), (4, "x")]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: spell(brute_pii(t)) for i, t in rows}


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]{32,}") is True
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == ("and", (b"aki", b"kia"))
    q = secrets.trigram_query(secrets.BASE[0].pattern)
    assert q[0] == "or" and b"tok" in secrets.trigrams_of(q) and len(q[1]) == 6


def test_masking_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a password=abcdefgh b"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secrets.find_secrets(df, mask="[SECRET]").collect()}
    assert got == {1: "a [SECRET] b", 2: None}
    assert secrets.find_secrets(df.limit(0)).count() == pii.find_pii(df.limit(0)).count() == 0
    grams = {r["trigram"]: r["keys"] for r in secrets.index_postings(df).collect()}
    assert grams["pas"] == [1] and "tok" not in grams
