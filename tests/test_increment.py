"""The incremental layout against the full recompute, commits against each other, and what a step reads."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import increment, layout
from ledgerloom.sources import commits, parts

SCHEMAS = {
    "matches": "id string, account string, kind string, match_key string, detail_response_id long",
    "match_classification": "id string, account string, kind string, match_key string, analysis_set string, rule_raw string",
    "documents": "id string, account string, kind string, match_key string, response_id long, played string",
    "match_tags": "id string, account string, match_key string",
    "rate_points": "id string, account string, match_key string",
    "responses": "id string, response_id long, operation string, fetched_at string, body_sha256 string",
    "sightings": "id string, response_id long",
    "response_fetches": "id string, event_id string, fetched_at string",
    "jobs": "id string, account string, kind string, match_key string",
    "assets": "id string, body_sha256 string",
    "bodies": "id string, sha256 string",
}


def _random(draw, n=40):
    """Rows of all tables by id; parents may be missing, details may name any response, bodies are shared."""
    match = lambda: (draw.choice("ab"), draw.choice(["vs", "coop"]), f"m{draw.randrange(n // 3)}")
    time = lambda: f"2026-0{draw.randint(1, 3)}-1{draw.randrange(3)}T{draw.randrange(24):02d}:00:00Z"
    sha = lambda: draw.choice([None, *[f"{i:02x}{'0' * 62}" for i in range(6)]])
    keys = sorted({match() for _ in range(n)})
    out = {
        "matches": [("|".join(k), *k, draw.choice([None, draw.randrange(20)])) for k in keys if draw.random() < 0.8],
        "match_classification": [("|".join(k), *k, draw.choice(["xmatch", "fest", None]), draw.choice(["AREA", "GOAL"])) for k in keys if draw.random() < 0.7],
        "documents": [(f"d{i}", *draw.choice(keys), draw.randrange(20), time()) for i in range(n)],
        "match_tags": [(f"t{i}", *[match()[j] for j in (0, 2)]) for i in range(n // 2)],
        "rate_points": [(f"p{i}", "a", draw.choice([match()[2], f"fetch:e{draw.randrange(12)}"])) for i in range(n)],
        "responses": [(str(i), i, draw.choice(["VsHistoryDetailQuery", "XRankingDetailQuery"]), time(), sha()) for i in range(20) if draw.random() < 0.8],
        "sightings": [(f"s{i}", draw.randrange(20)) for i in range(n)],
        "response_fetches": [(f"e{i}", f"e{i}", time()) for i in range(12) if draw.random() < 0.7],
        "jobs": [(f"j{i}", *match()) for i in range(10)],
        "assets": [(f"u{i}", sha() if i % 3 else "") for i in range(9) if draw.random() < 0.8],
        "bodies": [(f"b{i}", f"{i:02x}{'0' * 62}") for i in range(6) if draw.random() < 0.9],
    }
    seen = set()
    out["documents"] = [r for r in out["documents"] if (k := (r[1:4], r[4])) not in seen and not seen.add(k)]
    return {t: {r[0]: r for r in rows} for t, rows in out.items()}


def _frames(spark, tables):
    return {t: spark.createDataFrame(list(rows.values()), SCHEMAS[t]) for t, rows in tables.items()}


def _full(spark, tables):
    """(table, id, part, role) of all rows, by the rules for whole tables."""
    f = _frames(spark, tables)
    docs = f["documents"].withColumn("json_text", F.to_json(F.struct(F.col("played").alias("playedTime"))))
    match = layout.match_home(f["matches"], f["match_classification"], docs)
    responses = f["responses"].withColumn("id", F.col("response_id"))
    at = layout.response_home(responses, docs, match)
    homes = {"match": match, "any_match": layout.prefer_vs(match), "response": at, "fetches": f["response_fetches"]}
    found = set()
    for t in ("matches", "match_classification", "documents", "match_tags", "rate_points", "response_fetches", "jobs", "assets", "sightings"):
        found |= {(t, r["id"], r["part"], "home") for r in layout.home_of(t, f[t], homes).select("id", "part").collect()}
    found |= {("responses", str(r["id"]), r["part"], "home") for r in at.collect()}
    ids = {r[1]: r[0] for r in tables["bodies"].values()}
    placed = layout.body_homes(f["bodies"], responses, at, f["assets"])
    return found | {("bodies", ids[r["sha256"]], r["part"], r["role"]) for r in placed.collect() if r["sha256"] in ids}


def _links(spark, tables):
    out = None
    for t, rows in _frames(spark, tables).items():
        one = increment.links(t, rows)
        out = one if out is None else out.unionByName(one)
    return out


def _feed(spark, before, after, touched):
    rows = []
    for t in before:
        for i in {*before[t], *after[t]}:
            if before[t].get(i) != after[t].get(i) or (t, i) in touched:
                rows.append((t, i, "upsert" if i in after[t] else "delete"))
    return spark.createDataFrame(rows, "table_name string, id string, op string").join(_links(spark, after), ["table_name", "id"], "left")


@pytest.mark.parametrize("seed", [1])
def test_steps_equal_the_full_recompute(spark, tmp_path, seed):
    draw = random.Random(seed)
    state = increment.IncrementalLayout(spark, str(tmp_path / "state"), buckets=8)
    none = {t: {} for t in SCHEMAS}
    before, homes = none, set()
    for step in range(3):
        after = _random(draw) if step == 0 else {t: dict(rows) for t, rows in before.items()}
        if step:
            other = _random(draw)
            for t, rows in after.items():
                for i in sorted({*rows, *other[t]}):
                    if draw.random() < 0.15:
                        rows.pop(i, None)
                        if i in other[t] and draw.random() < 0.7:
                            rows[i] = other[t][i]
            seen = set()
            after["documents"] = {i: r for i, r in after["documents"].items() if (k := (r[1:4], r[4])) not in seen and not seen.add(k)}
        touched = {("jobs", i) for i in after["jobs"] if draw.random() < 0.2} if step else set()
        got = state.advance(_feed(spark, before, after, touched))
        now = _full(spark, after)
        assert {tuple(r) for r in state.placed(got.commit).select("table_name", "id", "part", "role").collect()} == now
        feed = {(t, i) for t in before for i in {*before[t], *after[t]} if before[t].get(i) != after[t].get(i)} | touched
        want = {x[2] for x in homes ^ now} | {x[2] for x in homes | now if x[:2] in feed}
        assert {r["part"] for r in got.dirty.collect()} == want
        assert {(r["table_name"], r["id"], r["part"], r["role"], r["side"]) for r in got.moved.collect()} == {(*x, 1 if x in now else -1) for x in homes ^ now}
        assert {r["part"] for r in got.emptied.collect()} == {x[2] for x in homes} - {x[2] for x in now}
        before, homes = after, now
    assert state.log.problems() == [] and state.log.read()["version"] == 2
    assert {tuple(r) for r in state.placed(state.log.read(0)).select("table_name", "id", "part", "role").collect()} != homes  # a pinned version stays


def test_a_step_reads_the_buckets_of_its_candidates_only(spark, tmp_path):
    state = increment.IncrementalLayout(spark, str(tmp_path / "state"), buckets=64)
    rows = [(f"a|vs|m{i}", "a", "vs", f"m{i}", i) for i in range(400)]
    tables = {"matches": {r[0]: r for r in rows}, "match_tags": {f"t{i}": (f"t{i}", "a", f"m{i}") for i in range(400)}}
    state.advance(_links(spark, tables).withColumn("op", F.lit("upsert")))
    base = state.log.read()
    changed = spark.createDataFrame([("a|vs|m7", "a", "vs", "m7", "xmatch", "AREA")], SCHEMAS["match_classification"])
    step = state.advance(increment.links("match_classification", changed).withColumn("op", F.lit("upsert")))
    assert {(r["table_name"], r["id"], r["side"]) for r in step.moved.collect()} == {("match_classification", "a|vs|m7", 1), *{(t, i, s) for t, i in (("matches", "a|vs|m7"), ("match_tags", "t7")) for s in (1, -1)}}
    keys = spark.createDataFrame([("match", "a\x1fm7\x1fvs")], "entity string, key string")
    plan = state.links.lookup(base, keys, ["entity", "key"])
    files = plan.inputFiles()
    assert files and {re.search(r"bucket=(\d+)", f)[1] for f in files} == {str(b) for b in state.links.touched(keys)} and len(state.links.touched(keys)) == 1
    assert all(len(b) < 10 for b in step.commit["touched"].values())


def test_two_writers_of_one_version(spark, tmp_path):
    log, other = commits.CommitLog(spark, str(tmp_path / "log")), commits.CommitLog(spark, str(tmp_path / "log"))
    base = log.commit(log.read(), {"n": 1})
    log.commit(base, {"n": 2})
    with pytest.raises(commits.Conflict):
        other.commit(base, {"n": 3})
    assert [log.read(v)["n"] for v in log.versions()] == [1, 2] and log.problems() == []
    with pytest.raises(LookupError):
        log.read(9)
    (tmp_path / "log" / "_commits" / f"{0:020d}.json").write_text('{"version": 0, "parent": null, "n": 5}')
    assert log.problems() == [(1, "parent")]


def test_bucket_tables(spark, tmp_path):
    log = commits.CommitLog(spark, str(tmp_path / "log"))
    t = commits.BucketTable(log, "t", "k bigint, v string", ["k"], F.col("k"), 4, layers=2)
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string, _gone boolean")
    head, want = log.read(), {}
    assert t.read(head).count() == 0
    draw = random.Random(0)
    for i in range(6):  # more layers than are kept: they are merged on the way
        new = {k: None if draw.random() < 0.3 else f"v{i}" for k in draw.sample(range(12), 5)}
        written = t.write(head, rows(*[(k, v, v is None) for k, v in new.items()]))
        head = commits.commit_tables(log, head, {"t": written}, {})
        want = {k: v for k, v in (want | new).items() if v is not None}
        assert {tuple(r) for r in t.read(head).collect()} == set(want.items())
        assert all(len(layers) <= 2 for layers in head["tables"]["t"].values())
    pinned = log.read(2)
    was = sorted(map(tuple, t.read(pinned).collect()))
    # two writers from one version: apart they both get through, on one bucket the second one fails
    mine, theirs = [[k for k in range(100) if t.touched(spark.range(k, k + 1).withColumnRenamed("id", "k")) == [b]][0] for b in (0, 1)]
    first, second = t.write(head, rows((mine, "x", False))), t.write(head, rows((theirs, "y", False)))
    commits.commit_tables(log, head, {"t": first}, {})
    both = commits.commit_tables(log, head, {"t": second}, {})
    assert {(mine, "x"), (theirs, "y")} <= {tuple(r) for r in t.read(both).collect()}
    late = t.write(head, rows((mine, "z", False)))
    with pytest.raises(commits.Conflict):
        commits.commit_tables(log, head, {"t": late}, {})
    with pytest.raises(commits.Conflict):  # read what another wrote
        commits.commit_tables(log, head, {"t": {}}, {"t": [0]})
    assert sorted(map(tuple, t.read(pinned).collect())) == was and ("z",) not in {(r["v"],) for r in t.read(log.read()).collect()}


def test_two_publishers_at_once(spark, tmp_path):
    """Of writers that name one version together one wins; readers see whole versions only, and the chain shows a changed log."""
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "t")
    parts.publish(spark.range(3), root, 1, "base")

    def one(n):
        try:
            return parts.publish(spark.range(n), root, 2, "base")["rows"]
        except commits.Conflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        won = [r for r in pool.map(one, [10, 20, 30, 40]) if r]
    assert len(won) == 1 and parts.open_version(spark, root).count() == won[0] and parts.open_version(spark, root, 1).count() == 3
    assert parts.published(spark, root)["rows"] == won[0] and parts.open_version(spark, root, 2, "base").count() == won[0]
    with pytest.raises(LookupError):
        parts.open_version(spark, root, 2, "other")
    (tmp_path / "t" / "_commits" / f"{0:020d}.json").write_text('{"version": 0, "parent": null, "data": "x"}')
    with pytest.raises(ValueError):
        parts.open_version(spark, root)
