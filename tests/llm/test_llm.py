"""Each operator of the llm subpackage against a brute-force version, and on awkward tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("ledgerloom.llm")
from ledgerloom.llm import chat, common, decontaminate, licenses, mixing, pii, pii_examples, quality, queries, simhash, suffixes, tokens, urls  # noqa: E402

DIR = "/root/testdata/sf0.001"
COLS = "doc_id long, text string, source string, lang string, n_chars long, kept string, row string, h string, k string, size string, words string"
LONG = "lorem ipsum " * 30_000


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and columns named like the operators' own."""
    base = [(1, None, "s"), (2, "", "s"), (3, " \n\t ", None), (4, LONG, "s"), (5, "a b c", None), (5, "a b c", None), (None, "x y z", "t"), (6, "é\u2003ü \x85 \x1c", ""), (7, None, None), (8, "1" * 3000 + "@", "s"), (9, "<|im_end|>", "t")]
    return spark.createDataFrame([(i, t, s, None, None, "k", "r", "h", "k", "z", "w") for i, t, s in base], COLS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLS)


def _texts(spark, name="documents"):
    return spark.read.parquet(f"{DIR}/{name}.parquet")


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def _lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def _plain(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", _lower(t))


# -- 1 quality ----------------------------------------------------------------------------------------------------


def _base(t):
    w = _words(t)
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if _words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit)


def test_quality_counts(spark, awkward, empty):
    labels = _texts(spark, "labels")
    for docs in (_texts(spark), awkward):
        want = Counter((r["doc_id"], *_base(r["text"])) for r in docs.collect())
        got = quality.report(docs, labels)
        assert Counter(tuple(r[:6]) for r in got.collect()) == want
        assert got.where("(n_words < 50 or 100 * n_repeat_words > 50 * n_words) <> base_failed or (base_failed and kept)").count() == 0
    assert quality.report(empty, labels).count() == 0 and quality.report(awkward, labels.limit(0)).where("not base_failed and not kept").count() == 0
    assert set(quality.kept_documents(awkward, labels).columns) == set(awkward.columns)


def test_quality_of_long_texts(monkeypatch):
    """In stretches a long text has the counts, the n-grams and the probability that it has whole."""
    r = random.Random(3)
    texts = ["".join(r.choice(["ab", "c", "é", "#"]) * r.randrange(1, 9) + r.choice([" ", " ", "\n", "  \t", "\n\n"]) for _ in range(n)).encode() for n in (3, 400, 3000)]
    texts += [b"x" * 900, b" " * 700, b"one two three " * 200, b"a\nb\n" * 300 + b"tail"]
    weights = np.random.default_rng(1).standard_normal((len(quality.FAMILIES), quality.DIM))
    model = quality.Model(weights, 0.1, 0.7, 0.2)
    whole = [quality.judge([t], model) for t in texts]
    monkeypatch.setattr(quality, "LONG", 1)
    monkeypatch.setattr(quality, "STRETCH", 64)
    for t, w in zip(texts, whole, strict=True):
        slots = [np.sort(np.concatenate(f)) for f in zip(*quality.long_slots(t), strict=True)]
        assert all(np.array_equal(a, np.sort(s[lo[0] : hi[0]])) for a, (s, lo, hi) in zip(slots, quality.features(quality.Grid([t])), strict=True))
        again = quality.judge([t], model)
        assert again["counts"] == w["counts"] and again["failed"] == w["failed"] and again["p"] == pytest.approx(w["p"], abs=1e-9)


def test_quality_memory_of_a_very_long_text():
    """A text of 48 MB in a process of its own: some 16 bytes a byte, where the grid of the whole took 55."""
    import subprocess
    import sys

    code = """if True:
        import resource, random
        import numpy as np
        from ledgerloom.llm import quality
        r = random.Random(0)
        text = b" ".join(b"w%d" % r.randrange(10**6) for _ in range(10**6)) * 6
        text = text[:48_000_000]
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        j = quality.judge([text], quality.Model(np.zeros((4, quality.DIM)), 0.0))
        print(j["counts"][0][0], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
    """
    import os

    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    words, kb = map(int, done.stdout.split())
    assert words > 5_000_000 and kb < 1_000_000, done.stderr


def test_quality_held_out(spark):
    """Trained on half of the labels, held against the other half."""
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(d, labels.where("doc_id % 2 = 0"))
    got = quality.report(d, labels, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").select("quality", "kept").collect()
    good, bad = [r["kept"] for r in got if r["quality"]], [r["kept"] for r in got if not r["quality"]]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.5


# -- 2 decontamination --------------------------------------------------------------------------------------------


def _hits(docs, items):
    wins = defaultdict(set)
    for i, t in items:
        w = _plain(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[k : k + n])].add(i)
    out = []
    for i, t in docs:
        w, hit, found = _plain(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit.update(range(k, k + n))
                    found |= {str(y) for y in wins[x] if y is not None}
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WORDS, 300])
def test_decontamination(spark, awkward, empty, block, monkeypatch):
    monkeypatch.setattr(decontaminate.find_hits, "__defaults__", (None, 13, block))
    bench = _texts(spark, "benchmark").select("item_id", "text").unionByName(spark.createDataFrame([(500, "a B"), (501, None), (None, "x y"), (502, ""), (500, "a b"), (500, "a b")], "item_id long, text string"))
    items = [(r[0], r[1]) for r in bench.collect()]
    for docs in (_texts(spark), awkward):
        assert Counter(tuple(r) for r in decontaminate.report(docs, bench).collect()) == _hits([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    assert decontaminate.report(empty, bench).count() == 0 and decontaminate.report(awkward, bench.limit(0)).where("n_hit > 0").count() == 0
    kept = decontaminate.without_contaminated(awkward, bench, block)
    assert kept.columns == awkward.columns and kept.count() == 8 and decontaminate.without_contaminated(empty, bench, block).count() == 0
    cut = decontaminate.without_hit_spans(awkward, bench, block)
    assert cut.columns == awkward.columns and Counter((r["doc_id"], r["text"]) for r in cut.collect())[5, " c"] == 2 and cut.count() == awkward.count()
    left = decontaminate.report(decontaminate.without_hit_spans(_texts(spark), _texts(spark, "benchmark"), block), _texts(spark, "benchmark"))
    assert left.where("n_hit > 0").count() == 0


@pytest.mark.parametrize("block", [1_000_000, 30])
def test_decontamination_clashing_columns(spark, block):
    """Columns that are named as the operator names its own stay as they are."""
    bench = spark.createDataFrame([(i, f"w{i} x{i} y{i}") for i in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "w1 x1 y1", "old", "k", "K"), (2, "clean", None, None, None), (3, None, "b", "k", None)], "doc_id long, text string, _before string, _key string, _BEFORE_ string")
    kept = decontaminate.without_contaminated(docs, bench, block)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == {(2, "clean", None, None, None), (3, None, "b", "k", None)}
    cut = decontaminate.without_hit_spans(docs, bench, block)
    assert cut.columns == docs.columns and {tuple(r) for r in cut.collect()} == {(1, "", "old", "k", "K"), (2, "clean", None, None, None), (3, None, "b", "k", None)}
    assert {r["row"]["_before"] for r in decontaminate.find_hits(docs, bench, block_words=block).collect()} == {"old", None, "b"}


# -- 3 personal data ----------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _fine(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_base_spans_match_patterns():
    r = random.Random(4)
    bits = ["a@b.co", "4111 1111 1111 1111", "1.2.3.4", "256.1.1.1", "+1 (555) 010-9999", "x", "@", ".", "-", " ", "7", "é", "+", "a.b%", "001.2.3.4.5"]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(t) == {k: [m.span() for m in re.finditer(p, t) if _fine(k, m[0])] for k, p in PATTERNS.items()}, t


def test_pii_report(spark, awkward, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.train(docs)
    for d in (docs, awkward):
        texts = defaultdict(list)
        for r in d.collect():
            texts[r["doc_id"]].append(r["text"] or "")
        for r in pii.report(d, model).collect():
            spans = {(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)}
            base = pii.base_spans(texts[r["doc_id"]][0])
            assert {(k, *x) for k in base for x in base[k]} <= spans and [r[f"n_{k}"] for k in pii.KINDS] == [len(base[k]) for k in pii.KINDS]
            want = ",".join(f"{k}:{s}:{e}" for k in pii.KINDS for s, e in base[k])
            assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert pii.report(empty).count() == 0
    red = pii.redacted(awkward, model)
    assert red.columns == awkward.columns and red.count() == awkward.count()


def test_spans_are_those_of_a_full_decode():
    r = random.Random(6)
    make = pii_examples.Maker(3)
    bits = [lambda: ".".join("abcdefgh"[r.randrange(8)] * r.randint(1, 30) for _ in range(r.randint(2, 12))) + "@", lambda: make.email(), lambda: make.phone(), lambda: "word " * r.randint(1, 90), lambda: make.digits(r.randint(1, 200)), lambda: " (at) ", lambda: "x" * r.randint(1, 400)]
    for seed in (7, 8):
        t = pii.Tagger(seed)
        for k in range(2, pii.LABELS, 2):  # long spans, which cross many windows
            t.p["move"][[k - 1, k], k] += 5
        t.p["bias"][1::2] -= 1
        texts = ["".join(r.choice(bits)() for _ in range(r.randint(0, 9))) for _ in range(150)] + ["", "1", "a" * 5000 + "@"]
        some, every = t.spans(texts), t.spans(texts, every=True)
        crossed = 0
        for x, a, b in zip(texts, some, every, strict=True):
            at = pii.marks(x)
            held = lambda s, at=at: ((at >= s[1]) & (at < s[2])).any()
            assert list(filter(held, a)) == list(filter(held, b))
            crossed += sum(e - s > 192 for _, s, e in filter(held, b))
        assert crossed > 10


def test_taken_spans_are_met_however_many_lie_before():
    t = pii.Taken([(0, 300), *[(10 * i, 10 * i + 3) for i in range(1, 12)]])
    assert t.meets(250, 260) and not t.meets(300, 310) and not pii.Taken([]).meets(0, 5)


def test_model_finds_what_the_rules_miss(spark):
    """Recall of made spans, other ones than it was fitted on, that the patterns do not find; and what it adds to clean texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, make = pii.train(docs), pii_examples.Maker(1234)
    clean = [x[0][200:280] for x in docs.where(~F.col("text").rlike("[0-9@]") & (F.length("text") > 400)).select("text").limit(200).collect()]
    seen, hit = Counter(), Counter()
    for i in range(600):
        text, spans = make.example(clean[i % len(clean)], 200)
        base, every = pii.find([text], model)[0]
        for kind, s, e in spans:
            if (s, e) not in base[kind]:
                seen[kind] += 1
                hit[kind] += any(k == kind and a <= s + 1 and b >= e - 2 for k, a, b in every)
    assert all(seen[k] > 80 and hit[k] / seen[k] > (0.65 if k == "email" else 0.75) for k in pii.KINDS), (seen, hit)
    assert not any(x for _, x in pii.find(clean, model))


def test_tagger_gradients_and_held_out():
    t, r = pii.Tagger(), np.random.default_rng(0)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    x, y = r.integers(0, pii.CLASSES, (7, 3)).astype(np.uint8), r.integers(0, pii.LABELS, (7, 3)).astype(np.int8)
    _, g = t.gradients(x, y)
    for k, i in (("uf", (1, 5)), ("vb", (2, 3)), ("move", (1, 2)), ("bias", (4,)), ("xf", (int(x[3, 1]), 7))):
        o = t.p[k][i]
        t.p[k][i] = o + 1e-3
        a, _ = t.gradients(x, y)
        t.p[k][i] = o - 1e-3
        b, _ = t.gradients(x, y)
        t.p[k][i] = o
        assert abs((a - b) / 2e-3 - g[k][i]) < 1e-4
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    make = lambda: rnd.choice([f"{word()}.{rnd.randint(1, 99)}@mail{rnd.randint(1, 9)}.example.com", ".".join(str(rnd.randint(1, 255)) for _ in range(4)), f"+1 ({rnd.randint(100, 999)}) 555-{rnd.randint(1000, 9999)}", word(), str(rnd.randint(1, 9999))])
    texts = ["".join(f"{make() if rnd.random() < 0.3 else word()} " for _ in range(8))[:64] for _ in range(900)]
    grid = np.stack([np.pad(pii.codes(t), (0, 64 - len(t))) for t in texts])
    gold = np.stack([np.pad(pii.label_path(len(t), pii.base_spans(t)), (0, 64 - len(t))) for t in texts])
    model = pii.Tagger().fit(grid[:700], gold[:700])
    hit = miss = extra = 0
    for t, found in zip(texts[700:], model.spans(texts[700:]), strict=True):
        want = {(k, *s) for k, v in pii.base_spans(t).items() for s in v}
        hit, miss, extra = hit + len(want & set(found)), miss + len(want - set(found)), extra + len(set(found) - want)
    assert hit / (hit + miss) > 0.7 and hit / (hit + extra) > 0.7


# -- 4 licenses ---------------------------------------------------------------------------------------------------


def test_matching_statistics():
    s = licenses.Scanner()
    a, r = s.automaton, random.Random(3)
    tem = [[a.vocabulary[w] for w in licenses.words_of(v.encode())] for _, v in sorted(licenses.TEMPLATES.items())]
    subs = {tuple(t[i:j]) for t in tem for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for _ in range(60):
        ids = [x for _ in range(8) for t in [r.choice(tem)] for i in [r.randrange(len(t))] for x in t[i : i + r.randint(1, 12)]]
        ms = [max(n for n in range(e + 1) if n == 0 or tuple(ids[e - n : e]) in subs) for e in range(1, len(ids) + 1)]
        want = [(e - ms[e - 1], e) for e in range(1, len(ids) + 1) if ms[e - 1] >= 5 and (e == len(ids) or ms[e] != ms[e - 1] + 1)]
        assert [(x, y) for x, y, _ in a.matches(ids)] == want
        for x, y, state in a.matches(ids):
            assert set(a.ends[state]) == {(k, i + y - x) for k, t in enumerate(tem) for i in range(len(t)) if t[i : i + y - x] == ids[x:y]}


def test_licenses(spark, awkward, empty):
    for docs in (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), awkward):
        want = Counter()
        for r in docs.collect():
            w, places, found = _plain(r["text"]), [], set()
            for p, label in licenses.PHRASES.items():
                q = p.split()
                at = [i for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
                places += at
                found |= {label} if at else set()
            want[r["doc_id"], len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found))] += 1
        got = licenses.report(docs)
        assert Counter(tuple(r[:6]) for r in got.collect()) == want
        assert got.where("score < 0 or score > 1").count() == 0
    t = licenses.TEMPLATES
    d = spark.createDataFrame([(1, "x " + t["mit"].replace("restriction", "hindrance")), (2, t["gpl"].upper()), (3, t["isc"][:60]), (4, t["bsd"] + "\n" + t["apache"])], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in licenses.report(d).collect()} == {1: "mit", 2: "gpl", 3: "", 4: "apache,bsd"}
    assert licenses.report(empty).count() == 0


def test_altered_templates_are_told_apart():
    """Each template set into prose, in capitals or not, with one word in 25 replaced: its own label, and it alone, in at least 9 of 10."""
    s, r, right, total = licenses.Scanner(), random.Random(4), 0, 0
    prose = lambda: [("der", "que", "with", "la", "and", "software", "license", "of", "the")[r.randrange(9)] for _ in range(r.randint(0, 200))]
    for name, text in licenses.TEMPLATES.items():
        for _ in range(20):
            words = [w if r.random() > 0.04 else "qq" for w in (text.upper() if r.random() < 0.3 else text).split()]
            found = s.scan([" ".join(prose() + words + prose()).encode()])[0]
            total += 1
            right += {x[0] for x in found["spans"] if x[3] >= licenses.COVER} == {name}
    assert right >= 0.9 * total, (right, total)
    assert not any(x["spans"] and max(c[3] for c in x["spans"]) >= licenses.COVER for x in s.scan([" ".join(prose()).encode() for _ in range(200)]))


# -- 5 mixing -----------------------------------------------------------------------------------------------------


def _targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w, total, out, open_ = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, sum(sizes.values()), {}, set(order)
    while True:
        rest, ws = total - sum(out.values()), sum(w[s] for s in open_)
        over = {s for s in open_ if rest * w[s] / ws > 3 * sizes[s]} if ws else set()
        if not over:
            return out | {s: rest * w[s] / ws for s in open_}
        out |= {s: 3 * sizes[s] for s in over}
        open_ -= over


def test_mixing(spark, awkward, empty):
    for docs in (_texts(spark), awkward):
        rows = docs.select("doc_id", "text", "source").collect()
        sizes, large = defaultdict(int), defaultdict(int)
        for r in rows:
            n = len(_words(r["text"]))
            sizes[r["source"]] += n
            large[r["source"]] = max(large[r["source"]], n)
        want = _targets(dict(sizes))
        src = {r["doc_id"]: r["source"] for r in rows}
        got = mixing.mix(docs).collect()
        assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r["doc_id"], len(_words(r["text"]))) for r in rows)
        taken = defaultdict(int)
        for r in got:
            taken[src[r["doc_id"]]] += r["taken"]
            assert abs(r["target"] - want[src[r["doc_id"]]]) < 1e-6 * max(1, r["target"]) and r["taken"] <= 3 * r["size"]
        assert all(abs(taken[s] - want[s]) <= large[s] for s in want)
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(empty).count() == 0
    out = mixing.mixed_documents(awkward)
    assert out.columns == [*awkward.columns, "mix_copy"]
    full = spark.createDataFrame([(i, "a b c" if i % 3 else "", "ab"[i % 2], i) for i in range(40)] + [(i, "x " * 900, "c", i) for i in range(40, 60)], "doc_id long, text string, source string, MIX_COPY int")
    got = mixing.mixed_documents(full)
    assert got.columns == [*full.columns, "mix_copy_"] and got.agg(F.max("mix_copy_")).first()[0] == 3 and mixing.mixed_documents(empty).count() == 0


# -- 6 URLs -------------------------------------------------------------------------------------------------------


def test_urls(spark):
    page = lambda i, u, h="": (i, u, h, "x", "y")
    link = lambda u: f'<link rel="canonical" href="{u}">'
    pages = spark.createDataFrame([
        page(1, "http://a.net/es/1"), page(2, "https://b.org/x", link("http://a.net/es/1")), page(3, "http://c.org/y", '<meta http-equiv="refresh" content="0; url=https://b.org/x/">'), page(4, "http://a.com/z", link("http://a.net/es/1")),
        page(5, "http://Q.EXAMPLE.com/en/1?a#b"), page(6, "http://www.example.com/en/1"), page(7, None), page(8, "no scheme"), page(9, "http://d.org/y?utm_source=f", None), page(9, "http://d.org/y?utm_source=f", None), page(10, "http://notnet/es/"),
        page(11, "://net/es/"), page(12, "http://e.org/#x", link("/rel")), page(13, "http://e.org/rel"),
    ], "page_id long, url string, html string, host string, verdict string")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge(pages).collect()}
    assert got[1][2:] == ("net/es/", "block") and got[2][3] == got[3][3] == "block" and got[4][2:] == ("com/", "allow")
    assert got[5] == ("q.example.com", "/en/1", "example.com/en/", "block") and got[6][2:] == ("www.example.com/en/", "allow")
    assert got[7] == got[8] == ("", "", None, "allow") and got[10][2] is None and got[11][2:] == ("net/es/", "block") and got[12][3] == "allow"
    near = spark.createDataFrame([page(1, "http://z.org/a/b.html", link("c?x=1&amp;y=2")), page(2, "http://z.org/a/c?x=1&y=2", link("http://q.net/es/")), page(3, "http://z.org", link("d")), page(4, "http://z.org/d", link("//q.net/fr/9")), page(6, "https://q.net/es"), page(7, "http://q.net/es/"), page(8, "http://q.net/fr/9")], pages.schema)
    near = near.unionByName(spark.createDataFrame([page(5, "http://y.org/" + "long/" * 20_000, "<p>" * 100_000)], pages.schema))
    assert {r["page_id"]: r["verdict"] for r in urls.judge(near).collect()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "block", 7: "block", 8: "block"}
    red = spark.createDataFrame([("http://e.org/rel", "http://a.net/es/1"), (None, "x")], "from_url string, to_url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, redirects=red).collect()}
    assert got[13] == got[12] == "block" and got[4] == "allow"
    assert urls.judge(pages.limit(0)).count() == 0 and urls.judge(pages).count() == 14
    many = (*urls.RULES, *[("block", f"h{i}.zz", "/") for i in range(300)])
    assert sorted(map(str, urls.judge(pages, many).collect())) == sorted(map(str, urls.judge(pages).collect()))


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in pairs if a != b for x in (a, b)}


# -- 7 repeated strings -------------------------------------------------------------------------------------------


def _removed(rows):
    low = {}
    key = lambda i: 1 << 63 if i is None else i
    for i, t in rows:
        for p in range(len(t) - 49):
            low[t[p : p + 50]] = min(low.get(t[p : p + 50], 1 << 64), key(i))
    out = []
    for i, t in rows:
        m = bytearray(len(t))
        for p in range(len(t) - 49):
            if low[t[p : p + 50]] < key(i):
                m[p : p + 50] = b"\1" * 50
        out.append((i, len(t), sum(m), sum(1 for j in range(len(m)) if m[j] and (j == 0 or not m[j - 1])), hashlib.sha256(bytes(c for c, x in zip(t, m) if not x)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("batch", "piece", "fan", "hot"), [(8_000_000, 1 << 20, 4096, 32), (3000, 200, 4096, 2), (1000, 200, 3, 10**9)])
def test_repeated_strings(spark, awkward, empty, batch, piece, fan, hot, monkeypatch):
    """The last two: several batches to each bucket, hot grams dealt to all buckets, or buckets and batches dealt in two steps."""
    for name, value in (("BATCH", batch), ("PIECE", piece), ("FAN", fan), ("HOT", hot), ("BUNDLE", 64_000_000 if fan > 3 else 500)):
        monkeypatch.setattr(suffixes, name, value)
    r = random.Random(5)
    pool = ["".join(r.choice("abc é") for _ in range(300)) for _ in range(4)]
    piece_of = lambda: (p := r.choice(pool))[(a := r.randrange(250)) : a + r.randint(10, 140)] if r.random() < 0.6 else "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 60)))
    rows = [(i // 2 if i % 9 == 0 else i, "".join(piece_of() for _ in range(r.randint(0, 8)))) for i in range(90)]
    rows += [(None, pool[0]), (None, pool[0]), (500, None), (501, "a" * 400), (502, "a" * 49), (503, "a" * 50), (504, "ab" * 200), (505, "ab" * 100 + pool[1])]
    got = suffixes.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert Counter(tuple(x) for x in got.collect()) == _removed([(i, (t or "").encode()) for i, t in rows])
    if piece > 1000:
        small = awkward.where("doc_id <> 4 or doc_id is null")
        assert Counter(tuple(x) for x in suffixes.report(small).collect()) == _removed([(x["doc_id"], (x["text"] or "").encode()) for x in small.collect()])
        assert suffixes.report(awkward).count() == awkward.count() and suffixes.report(empty).count() == 0


def test_repeats_are_told_by_the_levels(spark, monkeypatch):
    """Without what the scan of the levels says, no repeat from another batch is removed."""
    monkeypatch.setattr(suffixes, "BATCH", 500)
    r = random.Random(3)
    said = ["".join(r.choice("abcdefgh ") for _ in range(600)) for _ in range(2)]
    docs = spark.createDataFrame([(i, said[i % 2]) for i in range(6)], "doc_id long, text string")
    gone = lambda: {x["doc_id"]: x["n_removed"] for x in suffixes.report(docs).collect()}
    assert gone() == {0: 0, 1: 0, 2: 600, 3: 600, 4: 600, 5: 600}


def test_buckets_do_not_hold_a_hot_gram_alone():
    high, low = np.full(10_000, 7, np.uint64), np.arange(10_000, dtype=np.uint64)
    for hot in (suffixes._NONE, np.array([7], np.uint64)):
        plan = suffixes.Plan(0, 16, hot)
        held = np.bincount(plan.bucket_of(high, low), minlength=16)
        assert held.max() == 10_000 if not len(hot) else held.max() < 1000


def test_index_family():
    r, f, all_ = np.random.default_rng(1), suffixes.IndexFamily(), {}
    for i in range(40):
        high, low = r.integers(0, 50, 30).astype(np.uint64), r.integers(0, 3, 30).astype(np.uint64)
        run, at = suffixes.Run.of(high, low, np.full(30, i))
        assert (run.high[at] == high).all() and (run.low[at] == low).all()
        want = [all_.get((int(h), int(x)), suffixes._NULL_ID) for h, x in zip(run.high, run.low, strict=True)]
        assert f.scan(run).tolist() == want
        f.add(suffixes.Run.unpack(run.pack()))
        for h, x in zip(run.high, run.low, strict=True):
            all_.setdefault((int(h), int(x)), i)
        sizes = [len(x) for x in f.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    whole = f.fold()
    assert {(int(h), int(x)): int(d) for h, x, d in zip(whole.high, whole.low, whole.doc, strict=True)} == all_


def test_license_spans_are_those_of_comparing_all():
    r = random.Random(2)
    for _ in range(60):
        spans = [(r.choice("abc"), s := r.randrange(3000), s + r.choice([1, 2, 7, 300, 900]), r.choice([0.1, 0.5, 0.5, 0.9])) for _ in range(60)]
        kept = []
        for s in sorted(spans, key=lambda s: (-s[3], s[1] - s[2], s[0])):
            if not any(2 * (min(s[2], k[2]) - max(s[1], k[1])) > s[2] - s[1] and k[3] > s[3] for k in kept):
                kept.append(s)
        assert licenses.best_spans(spans) == kept
    many = [("a", 40 * i, 40 * i + 30, 0.5) for i in range(20_000)]  # a file of many headers
    assert len(licenses.best_spans(many)) == 20_000


def test_license_chain_is_found_among_many():
    apart = [(10 + i // 10, 16 + i // 10, [(0, 1000 + 100 * i)]) for i in range(40)]  # each opens a chain of its own
    chains = licenses.chain([(0, 10, [(0, 10)]), *apart, (14, 30, [(0, 30)])], [10_000], 20)[0]
    assert len(chains) == 41 and chains[0] == (0, 30, 26)


# -- 8 simhash ----------------------------------------------------------------------------------------------------


def _fp(t):
    w = _words(_lower(t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _groups(fps, distance=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash(spark, awkward, empty):
    docs = _texts(spark).select("doc_id", "text").unionByName(awkward.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 100_000))
    rows = [(r[0], r[1]) for r in docs.collect()]
    fps = [_fp(t) for _, t in rows]
    g = _groups(fps)
    low = {}
    for (i, _), x in zip(rows, g, strict=True):
        if i is not None:
            low[x] = min(low.get(x, i), i)
    want = Counter((i, f"{f:016x}", low.get(x)) for (i, _), f, x in zip(rows, fps, g, strict=True))
    assert Counter(tuple(r) for r in simhash.report(docs).collect()) == want
    assert simhash.report(empty).count() == 0
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns and kept.count() == kept.select("doc_id").distinct().count()


def test_simhash_keeps_one_of_each_component(spark):
    r = random.Random(4)
    said = ["".join(r.choice("abcdefgh ") for _ in range(200)) for _ in range(5)]
    a, b, c, d, e = said
    rows = [(None, a, 1), (None, b, 1), (None, b, 1), (None, b, 2), (5, c, 1), (5, d, 1), (4, c, 3), (6, e, 1), (None, e, 1), (7, None, 1), (None, "", 1)]
    g = _groups([_fp(t) for _, t, _ in rows])
    assert len(set(g)) == 6
    kept = [tuple(x) for x in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()]
    assert Counter(x[:2] for x in kept) == Counter([(None, a), (None, b), (4, c), (5, d), (6, e), (7, None)]) and set(kept) <= set(rows)


@pytest.mark.parametrize("limit", [simhash.BLOCK_LIMIT, 1])
def test_simhash_links_lose_nothing(spark, limit):
    r = random.Random(9)
    fps = set()
    for _ in range(8):
        f = r.getrandbits(64)
        for _ in range(12):
            fps.add(f)
            for b in r.sample(range(64), r.randint(1, 5)):
                f ^= 1 << b
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = common.stage(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), block_limit=limit), "t").collect()
    back = {s: i for i, s in enumerate(signed)}
    assert all((fps[back[a]] ^ fps[back[b]]).bit_count() <= 4 for a, b in links)
    root = list(range(len(fps)))
    for a, b in links:
        x, y = root[back[a]], root[back[b]]
        root = [min(x, y) if z == max(x, y) else z for z in root]
    assert root == _groups(fps)


@pytest.mark.parametrize("distance", [1, 3])
def test_simhash_odd_distance_in_large_blocks(spark, distance):
    r = random.Random(distance)
    fps = []
    for _ in range(6):
        f = r.getrandbits(63)
        fps.append(f)
        for n in (distance, distance, distance + 1):
            for b in r.sample(range(63), n):
                f ^= 1 << b
            fps.append(f)
    links = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), distance, 1).collect()
    assert all((a ^ b).bit_count() <= distance for a, b in links)
    root = {x: x for x in fps}
    for a, b in links:
        x, y = root[a], root[b]
        root = {k: min(x, y) if z == max(x, y) else z for k, z in root.items()}
    same = lambda g: {frozenset(i for i in range(len(g)) if g[i] == x) for x in g}
    assert same([root[x] for x in fps]) == same(_groups(fps, distance))


# -- 9 tokens -----------------------------------------------------------------------------------------------------


def _tokenizer():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


def test_tokens(spark, awkward, empty):
    path, sp = _tokenizer()
    for docs in (_texts(spark), awkward):
        want = Counter((x["doc_id"], len((x["text"] or "").encode()), n := len(sp.encode(x["text"] or "")), n > 4096) for x in docs.collect())
        for chunk in (tokens.CHUNK, 100):
            assert Counter(tuple(x) for x in tokens.count_tokens(docs, path, chunk=chunk).collect()) == want
    assert tokens.count_tokens(empty, path).count() == 0


def test_tokens_of_many_chunks(spark, monkeypatch):
    """Rounds follow from the chunk's size: with a fan of 4, three rounds would leave several rows of this text."""
    path, sp = _tokenizer()
    text = "ab cde fghij klm " * 6_000
    monkeypatch.setattr(tokens, "FAN", 4)
    got = tokens.count_tokens(spark.createDataFrame([(1, text), (2, "x y")], "doc_id long, text string"), path, chunk=800)
    assert {tuple(x) for x in got.collect()} == {(1, len(text), n := len(sp.encode(text)), n > 4096), (2, 3, len(sp.encode("x y")), False)}
    assert 64 ** tokens._rounds(tokens.CHUNK, 64) * tokens.CHUNK >= 1 << 31 and tokens._rounds(1, 64) == 6


def test_transducer_counts_as_the_library():
    path, sp = _tokenizer()
    t = tokens.transducer(path)
    r = random.Random(1)
    known = sorted(t.auto.score)
    char = lambda: chr(r.choice([r.randrange(32, 127), r.randrange(0x4E00, 0x9FFF), r.randrange(0x400, 0x500), r.randrange(0x1F300, 0x1F700), r.randrange(32)]))
    makers = [
        lambda: "".join(r.choice(known) for _ in range(r.randint(0, 12))),
        lambda: "".join(r.choice("ab  ▁é\n<s>") for _ in range(r.randint(0, 30))),
        lambda: " " * r.randint(0, 80) + r.choice(["", "the", "x"]) + " " * r.randint(0, 40),
        lambda: "".join(char() for _ in range(r.randint(0, 40))),
        lambda: "".join(r.choice("aehinrst") for _ in range(r.randint(0, 60))),
        lambda: r.choice("aeo-=_.0/*") * r.randint(0, 200) + "".join(r.choice(known) for _ in range(3)),
    ]
    for i in range(6000):
        x = makers[i % 6]()
        n = len(sp.encode(x))
        assert t.count(x) == n, x
        size = r.randint(1, 9)
        maps = [t.chunk(x[k : k + size], k == 0) for k in range(0, len(x), size)]
        while len(maps) > 1:  # any grouping of neighbours
            k = r.randrange(len(maps) - 1)
            maps[k : k + 2] = [t.compose(*maps[k : k + 2])]
        assert not maps or maps[0].head == "" and maps[0].count == n, x


def test_transducer_is_bounded(monkeypatch):
    path, sp = _tokenizer()
    monkeypatch.setattr(tokens, "MOST_EDGES", 300)
    monkeypatch.setattr(tokens, "MOST_WORDS", 20)
    t, r = tokens.Transducer(tokens.transducer(path).auto), random.Random(2)
    for _ in range(300):
        x = " ".join("".join(r.choice("etaoins") for _ in range(r.randint(1, 8))) for _ in range(20))
        assert t.count(x) == len(sp.encode(x)) and t.edges < 300 + len(x) and len(t.words) <= 20


# -- 10 chat ------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    said = ["<|im_end|><|im_start|>assistant ok", "\\<|im_end|>\n", "", "a\\n", "<\\|", None, "é" * 10]
    rows = [(1, i, ("user", "assistant", "a\nb", "assistant<|im_end|>")[i % 4], x) for i, x in enumerate(said)] + [(2, 0, None, "x"), (3, 0, "assistant", "y"), (3, 0, "assistant", "y"), (3, None, "assistant", "z"), (None, 1, "user", "n")]
    d = spark.createDataFrame([(*x, "c") for x in rows], "conv_id long, turn long, role string, text string, node string")
    got = {x["conv_id"]: x for x in chat.digest(chat.format_trees(chat.linear_trees(d))).collect()}
    for c in {x[0] for x in rows}:
        turns = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is None, x[1] or 0, x[2] or "", x[3] or ""))]
        loss = "".join(t for r_, t in turns if r_ == "assistant")
        g = got[c]
        assert g["n_turns"] == len(turns) and g["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert g["loss_chars"] == len(loss) and g["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and g["formatted_chars"] == len(chat.render(turns)[0])
    assert chat.format_trees(chat.linear_trees(d.limit(0))).count() == 0


def test_best_paths(spark):
    r = random.Random(8)
    rows, want = [], set()
    for tree in range(12):
        n = r.randint(1, 25)
        parent = [None] + [r.randrange(i) for i in range(1, n)]
        score = [float(r.randint(0, 5)) for _ in range(n)]
        rows += [(str(tree), i, parent[i], score[i]) for i in range(n)]

        def path(i, parent=parent):
            return [] if i is None else path(parent[i]) + [i]

        leaves = [i for i in range(n) if i not in parent]
        best = max(leaves, key=lambda i: (sum(score[j] for j in path(i)), len(path(i)), -i))
        want |= {(str(tree), j, k) for k, j in enumerate(path(best))}
    got = chat.chosen_paths(spark.createDataFrame(rows, "tree string, node long, parent long, score double"))
    assert {tuple(x) for x in got.collect()} == want


def test_trees_with_cycles_and_repeated_rows(spark):
    names = "tree string, node long, parent long, score double, conv_id long, role string, text string, root string, rank string, depth string"
    row = lambda t, n, p, s=0.0, x="m": (t, n, p, s, 7, "user", x, "r", "k", "d")
    rows = [
        row("a", 1, 2), row("a", 2, 1), row("a", 3, 2), row("b", 1, 1), row("c", 4, 6), row("c", 5, 4), row("c", 6, 5), row("c", 9, 8), row("c", 8, 6), row("c", 1, 9),
        row("d", 1, None, 1.0, "x"), row("d", 1, None, 1.0, "w"), row("d", 2, 1), row("d", 2, 1), row("d", 3, 1, None), row("e", None, 1), row(None, 1, None),
    ]
    d = spark.createDataFrame(rows, names)
    got = {(x["tree"], x["root"], x["leaf"], x["depth"]): x["node"] for x in chat.ranked_paths(d).collect()}
    path = lambda *at: {(at[0], at[1], at[-1], i): n for i, n in enumerate(at[1:])}
    assert got == path("a", 1, 2, 3) | path("b", 1) | path("c", 4, 5, 6, 8, 9, 1) | path("d", 1, 2) | path("d", 1, 3)
    said = {(x["root"], x["leaf"]): [t for _, t in chat.parse(x["formatted"])] for x in chat.format_trees(d.where("tree = 'd'")).collect()}
    assert said == {(1, 2): ["w", "m"], (1, 3): ["w", "m"]}
    assert chat.ranked_paths(d.limit(0)).count() == 0 and chat.digest(chat.format_trees(d.limit(0))).count() == 0


def test_chat_of_an_awkward_table(spark, awkward):
    d = awkward.selectExpr("doc_id as conv_id", "cast(null as long) as turn", "lang as role", "text", "kept", "row", "k as tree", "h as leaf")
    got = chat.digest(chat.format_trees(chat.linear_trees(d))).collect()
    assert Counter({r["conv_id"]: r["n_turns"] for r in got}) == Counter(r["doc_id"] for r in awkward.collect()) and all(r["loss_chars"] == 0 for r in got)


def test_every_path_is_a_conversation(spark):
    r = random.Random(5)
    rows, want = [], set()
    for tree in range(6):
        n = r.randint(2, 20)
        parent = [None] + [r.randrange(i) if r.random() < 0.8 else 99 for i in range(1, n)]  # 99 is a lost message
        score = [float(r.randint(0, 3)) for _ in range(n)]
        rows += [(str(tree), i, parent[i], score[i], tree, "user", f"m{i}") for i in range(n)]

        def path(i, parent=parent):
            return [] if i in (None, 99) else path(parent[i]) + [i]

        paths = defaultdict(list)
        for i in set(range(n)) - set(parent):
            paths[path(i)[0]].append(path(i))
        for root, ps in paths.items():
            ps.sort(key=lambda p: (-sum(score[j] for j in p), -len(p), p[-1]))
            want |= {(tree, root, p[-1], k, tuple(f"m{j}" for j in p)) for k, p in enumerate(ps, 1)}
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, score double, conv_id long, role string, text string")
    for most in (None, 1, 2):
        got = chat.format_trees(nodes, most).collect()
        chosen = {x for x in want if most is None or x[3] <= most}
        assert len(got) == len(chosen) and {(x["conv_id"], x["root"], x["leaf"], x["rank"], tuple(t for _, t in chat.parse(x["formatted"]))) for x in got} == chosen


# -- queries and pipeline -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op2_decontaminate", "op5_mix_sources", "op6_url_filters", "op10_chat_format"])
def test_query_against_sql(spark, name):
    import duckdb

    from ledgerloom.llm import oracles

    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.queries()[name](spark, DIR)
    res = db.execute(oracles.oracle_sql()[name])
    names = [x[0] for x in res.description]
    norm = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert Counter(tuple(map(norm, r)) for r in df.select(*names).collect()) == Counter(tuple(map(norm, r)) for r in res.fetchall())


def test_pipeline_stages(spark):
    """Each stage against its operator's brute-force decision, on the rows that it was given."""
    import corpus_pipeline

    docs = _texts(spark)
    columns = docs.columns
    bench = [(r["item_id"], r["text"]) for r in _texts(spark, "benchmark").collect()]
    for name, step in corpus_pipeline.STAGES:
        before = docs.collect()
        out = common.stage(step(spark, docs, DIR), "t")
        after = out.collect()
        ids = Counter(r["doc_id"] for r in after)
        if name == "quality rules":
            assert all(not (len(_words(r["text"])) < 50 or 100 * _base(r["text"])[4] > 50 * len(_words(r["text"]))) for r in after)
        elif name == "simhash near-dedup":
            g = _groups([_fp(r["text"]) for r in before])
            low = {}
            for r, x in zip(before, g, strict=True):
                low[x] = min(low.get(x, r["doc_id"]), r["doc_id"])
            assert sorted(ids.elements()) == sorted(low.values())
        elif name == "benchmark decontamination":
            assert ids == Counter(x[0] for x in _hits([(r["doc_id"], r["text"]) for r in before], bench).elements() if not x[5])
        elif name == "pii":
            assert ids == Counter(r["doc_id"] for r in before) and not any(any(pii.base_spans(r["text"]).values()) for r in after)
        else:
            assert out.columns == [*columns, "mix_copy"] and max(ids.values()) <= 3
            continue
        assert out.columns == columns
        docs = out


def test_pipeline_of_awkward_tables(spark, awkward, empty):
    """Nulls, empty and very long texts, repeated rows and clashing names pass every stage; what each keeps is defined."""
    import corpus_pipeline

    good = " ".join(f"word{i}" for i in range(60))
    more = spark.createDataFrame([(i, good, None, None, None, "k", "r", "h", "k", "z", "w") for i in (None, 90, 90)], awkward.schema)
    for docs in (awkward.unionByName(more).withColumn("mix_copy", F.lit(1)), empty.withColumn("mix_copy", F.lit(1))):
        rows = docs.count()
        for name, step in corpus_pipeline.STAGES:
            out = common.stage(step(spark, docs, DIR), "t")
            each = out.collect()
            if name == "quality rules" and rows:
                assert all(len(_words(r["text"])) >= 50 for r in each) and len(each) in (0, 3)
            if name == "simhash near-dedup" and rows:
                assert len(each) == 8  # the words-less ones are one group, the long one and each other text are others
            if name == "pii":
                assert len(each) == rows
            assert out.columns == (docs.columns if name != "mixing sources" else [*docs.columns, "mix_copy_"])
