"""Lexical search, language identification and the filter audit: against SQL, brute force and held-out texts."""

import random
import re
from collections import Counter
from itertools import permutations
from math import floor, log

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("ledgerloom.llm")
from ledgerloom.llm import interaction, langid, oracles, queries, search  # noqa: E402

DIR = "/root/testdata/sf0.001"
COLS = "doc_id long, text string, source string, lang string, n_chars long, part string, mask string, item string, term string, key string, n string"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, None, "p", "m", "i", "t", "k", "n") for r in rows], COLS)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in any column, empty and long texts, repeated rows, ids with two texts, and columns named like the operators' own."""
    long = "Alpha beta # gamma " * 200_000
    base = [(1, None, "s", "en"), (2, "", "s", None), (3, " \n\t ", None, "en"), (4, long, "s", "en"), (5, "a b c", None, "fr"), (5, "a b c", "", "fr"), (5, "a b d", "t", "fr"), (None, "a b c", "t", "en"), (None, None, None, None)]
    return _docs(spark, [*base, (6, "é ü \x85 \x1c the of", "", "de"), (7, "a b c", "s", "fr"), (8, "1" * 3000 + "@", "s", "en"), (9, "A A\x0bA", "t", "en"), (9, "A A\x0bA", "t", "en")])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLS)


@pytest.mark.parametrize("name", ["op11_search", "op13_filter_audit"])
def test_query_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = queries.queries()[name](spark, DIR)
    res = db.execute(oracles.oracle_sql()[name])
    assert [d[0] for d in res.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(res.fetchall())


# -- 11 search ----------------------------------------------------------------------------------------------------


def _terms(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def _ranked(docs, items, most=10):
    docs = [(i, Counter(_terms(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, n_words = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(_terms(text))
    out = []
    for item, ts in wanted.items():
        found = []
        for i, c, n in docs:
            m = 10 + 90 * n * n_docs // n_words
            s = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:most], 1)]
    return sorted(out, key=str)


def _items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


ITEMS = [(1, "the Alpha of"), (2, None), (3, ""), (4, "a B c ü"), (4, "gamma"), (None, "a a a d"), (5, "nowhere"), (6, "the Alpha of")]


def test_search_awkward(spark, awkward, empty):
    items = _items(spark, ITEMS)
    want = _ranked([(r["doc_id"], r["text"]) for r in awkward.collect()], ITEMS)
    for options in ({}, {"vocabulary": 1}, {"block_terms": 2}, {"vocabulary": 1, "block_terms": 3}):
        assert sorted(map(tuple, search.rank(awkward, items, **options).collect()), key=str) == want
    assert search.rank(empty, items).count() == 0 and search.rank(awkward, items.limit(0)).count() == 0
    assert sorted(map(tuple, search.rank(awkward, items, most=2).collect()), key=str) == _ranked([(r["doc_id"], r["text"]) for r in awkward.collect()], ITEMS, 2)


def test_search_random_shards(spark, monkeypatch):
    """Many ties, lists of all lengths, and an index that is searched twice."""
    draw = random.Random(3)
    docs = [(i, " ".join(f"w{int(draw.paretovariate(0.6)) % 90}" for _ in range(draw.randint(0, 60)))) for i in range(1500)]
    docs += [(2000 + i, docs[7][1]) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = search.build_index(frame)
    assert sum(r[0] for r in index.select(F.size("doc_ids")).collect()) == len(docs)
    for seed in (1, 2):
        draw = random.Random(seed)
        items = [(i, " ".join(f"w{draw.randrange(90)}" for _ in range(draw.randint(1, 30)))) for i in range(25)]
        assert sorted(map(tuple, search.search(index, _items(spark, items)).collect()), key=str) == _ranked(docs, items)


def test_search_skips(spark):
    """With one heavy term the postings of light terms are sought, not read."""
    n = 4000
    shard = search._Shard(None)
    shard.add(list(range(n)), [b"the of and " + (b"rare" if i % 250 == 0 else b"x%d" % (i % 7)) for i in range(n)])
    row = shard.row()
    df = dict(zip(row["terms"][0].as_py(), row["counts"][0].as_py(), strict=True))
    s = search.Searcher([("q", ["the", "of", "and", "rare"])], df, n, 4 * n)
    s.start()
    s.show({c: row[c][0].values.to_numpy() for c in ("doc_ids", "lengths", "counts", "docs", "tfs")}, row["terms"][0].as_py(), np.zeros(n, bool))
    assert s.best[0][1].tolist() == list(range(0, 2500, 250)) and s.evaluated < s.postings / 20


def test_blocks_are_the_best(monkeypatch):
    """The cuts have the least cost of all ways to cut, as a plain dynamic program finds it."""
    draw = np.random.default_rng(5)
    for n in (1, 2, 7, 9, 63, 70, 150):
        scores = draw.integers(1, 1000, n)
        price = search.BLOCK_COST * scores.std() + 1
        begin = search.cut_blocks(scores, np.array([0, n]))
        assert begin[0] == 0 and np.all(np.diff(np.append(begin, n)) <= search.LONGEST)
        cost = sum(price + (scores[a:b].max() - scores[a:b]).sum() for a, b in zip(begin, np.append(begin[1:], n), strict=True))
        least = [0.0]
        for j in range(1, n + 1):
            least.append(min(least[i] + price + (scores[i:j].max() - scores[i:j]).sum() for i in range(max(0, j - search.LONGEST), j)))
        assert cost == pytest.approx(least[n])
    starts = np.array([0, 1, 600, 601, 700])
    begin = search.cut_blocks(draw.integers(1, 9, 700), starts)
    assert set(starts[:-1]) <= set(begin) and 513 in begin


def test_search_long_text(spark):
    text = "Word wörd " * 1_500_000
    got = search.rank(spark.createDataFrame([(1, text), (2, "word"), (3, "other")], "doc_id long, text string"), _items(spark, [(1, "word WÖRD x")]))
    assert sorted(map(tuple, got.collect()), key=str) == _ranked([(1, text), (2, "word"), (3, "other")], [(1, "word WÖRD x")])


# -- 12 language --------------------------------------------------------------------------------------------------


def test_language_gradients():
    draw = np.random.default_rng(1)
    net = langid.fit(draw.integers(0, 5, (4, langid.REACH)).astype(np.uint8), np.array([0, 1, 2, 0]), ["a", "b", "c"], least_steps=0)
    for p in net.parameters():
        p[...] = draw.standard_normal(p.shape) * 0.5
    windows, truth = draw.integers(0, 5, (4, langid.REACH)).astype(np.uint8), np.array([0, 1, 2, 1])
    loss = lambda: -np.log(net.forward(windows)[0][np.arange(4), truth].astype(float)).mean()
    for p, g in zip(net.parameters(), net.gradients(windows, truth), strict=True):
        for at in np.argsort(-np.abs(g).ravel())[:3]:
            was, step = p.flat[at], 1e-2
            p.flat[at] = was + step
            up = loss()
            p.flat[at] = was - step
            assert (up - loss()) / (2 * step) == pytest.approx(g.flat[at], rel=0.1, abs=2e-3)
            p.flat[at] = was


def test_language_tables_are_the_network():
    draw = np.random.default_rng(2)
    windows = draw.integers(0, 256, (300, langid.REACH)).astype(np.uint8)
    net = langid.fit(windows[:64], np.arange(64) % 3, ["a", "b", "c"], least_steps=20)
    assert np.allclose(langid.Tables(net).probabilities(windows), net.forward(windows)[0], atol=1e-4)


def test_language_windows():
    texts = [b"x" * 5, b"y" * langid.STRIDE, b"z" * (langid.STRIDE + 1), b"w"]
    windows, starts = langid.cut(texts)
    assert starts.tolist() == [0, 1, 2, 4, 5]
    for t, a, b in zip(texts, starts[:-1], starts[1:], strict=True):
        padded = t + b"\0" * 400
        for k in range(a, b):
            assert windows[k].tobytes() == padded[(k - a) * langid.STRIDE :][: langid.REACH]


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.report(docs.select("doc_id", "text", "lang")).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.count() == docs.count() and got.where("held_out <> (crc32(cast(doc_id as string)) % 3 = 1) or score < 0 or score > 1").count() == 0
    assert got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_learns_from_allowed_rows_only(spark):
    """Wrong langs on held-out rows, or other sources and ids of the same texts, change no prediction."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    net = langid.train(docs)
    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit("xx")).otherwise(F.col("lang")))
    again = langid.train(wrong)
    assert again.languages == net.languages and all(np.array_equal(a, b) for a, b in zip(net.parameters(), again.parameters(), strict=True))
    one = langid.report(docs, net).select("doc_id", "lang_pred", "score").collect()
    other = langid.report(docs.select((F.col("doc_id") + 1).alias("doc_id"), "text", F.lit("s").alias("source"), F.lit(None).cast("string").alias("lang")), net).select(F.col("doc_id") - 1, "lang_pred", "score").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, other))


def test_language_awkward(spark, awkward, empty):
    got = langid.report(awkward)
    rows = got.collect()
    assert len(rows) == awkward.count() and all(r["held_out"] is not None and 0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3, 8)} == {"und"} and all(r["lang_pred"] != "und" for r in rows if r["doc_id"] in (4, 5, 6, 7, 9))
    assert langid.report(empty).count() == 0
    assert {(r["lang_pred"], r["score"]) for r in langid.report(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}
    assert {r["lang_pred"] for r in langid.report(awkward.withColumn("lang", F.lit("only"))).collect()} == {"und", "only"}


# -- 13 audit -----------------------------------------------------------------------------------------------------


def _audited(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    low = {}
    for i, t, _ in docs:
        if i is not None:
            low[t or ""] = min(low.get(t or "", i), i)
    parts = {}
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = "".join(f for f, fails in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and low[t] < i), strict=True) if fails)
        parts.setdefault(s or "", []).append((bad, i in good and i is not None, i in toxic and i is not None))
    out = {}
    for part, rows in parts.items():
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                here = [r for r in rows if f in r[0] and not set(order[:k]) & set(r[0])]
                total[f] += len(here)
                out[part, order, k + 1] = [sum(not set(order[: k + 1]) & set(r[0]) for r in rows), len(here), sum(f in r[0] for r in rows) - len(here), sum(r[0] == f for r in rows), sum(r[1] for r in here), sum(r[2] for r in here)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def test_audit_awkward(spark, awkward, empty):
    said = [(5, 1, 0), (5, 0, 1), (7, None, 1), (None, 1, 1), (9, 1, None), (4, 1, 1), (77, 1, 1)]
    labels = spark.createDataFrame(said, "doc_id long, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in awkward.collect()]
    assert {tuple(r) for r in interaction.audit(awkward, labels).collect()} == _audited(rows, said)
    assert {tuple(r) for r in interaction.audit(awkward, labels.limit(0)).collect()} == _audited(rows, [])
    assert interaction.audit(empty, labels).count() == 0


def test_audit_copies_between_parts(spark):
    """A copy's first document may be in another part, or in several."""
    draw = random.Random(4)
    rows = [(draw.randrange(60), draw.choice(["x", "y # y", "Z", None, "q " * 300]), draw.choice(["a", "b", None])) for _ in range(300)]
    said = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(60)]
    got = interaction.audit(_docs(spark, [(*r, None) for r in rows]), spark.createDataFrame(said, "doc_id long, quality int, toxic int"))
    assert {tuple(r) for r in got.collect()} == _audited(rows, said)


def test_fail_mask_of_long_texts(monkeypatch):
    draw = random.Random(6)
    texts = [" ".join(draw.choice(["a", "Bb", "ccc", "é", "#"]) + str(draw.randrange(n)) for _ in range(2000)).encode() for n in (1, 300, 900, 100_000)]
    want = [interaction.fail_mask(t) for t in texts]
    monkeypatch.setattr(interaction, "STRETCH", 100)
    assert [interaction.fail_mask(t) for t in texts] == want and len(set(want)) > 1
