"""Operators on small archive-shaped tables."""

import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.functions import jsonx, labels, paths
from ledgerloom.operators import cdc, classify, details, identity, ingest, jobs, layout, lossless, overlay, rates, records, views
from ledgerloom.sources import envelopes as env
from ledgerloom.streaming import ingest as streaming


def _vs(spark, docs):
    rows = [("a", "vs", f"m{i}", i, json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "account string, kind string, match_key string, detail_response_id long, json_text string")


def _match(mode, mine, others, bankara=None):
    team = lambda n: {"players": [{"id": f"p{i}"} for i in range(n)]}
    return {"vsMode": {"mode": mode}, "vsRule": {"rule": "AREA", "name": "AREA"}, "bankaraMatch": {"mode": bankara} if bankara else None, "myTeam": team(mine), "otherTeams": [team(n) for n in others]}


@pytest.mark.parametrize("cases", [[
    (("REGULAR", 4, [3]), "nawabari"), (("BANKARA", 4, [4], "OPEN"), "bankara_open"), (("BANKARA", 3, [4], "CHALLENGE"), "bankara_challenge"), (("BANKARA", 4, [4]), "hold"), (("X_MATCH", 4, [4]), "xmatch"),
    (("LEAGUE", 4, [4]), "event"), (("FEST", 4, [2, 2]), "fest"), (("PRIVATE", 4, [4]), "private_four_vs_four"), (("PRIVATE", 3, [3]), "private_three_vs_three"), (("PRIVATE", 2, [2]), "private_two_vs_two"),
    (("PRIVATE", 1, [1]), "private_one_vs_one"), (("PRIVATE", 4, [3]), "private_other"), (("PRIVATE", 4, []), "hold"), (("NEW_MODE", 4, [4]), "hold"),
]])
def test_populations(spark, cases):
    got = classify.classify(_vs(spark, [_match(*c) for c, _ in cases])).orderBy("detail_response_id").collect()
    assert [r["analysis_set"] for r in got] == [want for _, want in cases]


def test_broken_details_are_held(spark):
    d = spark.createDataFrame([("a", "vs", "x", 1, "{"), ("a", "vs", "y", 2, None), ("a", "coop", "z", 3, '{"rule":"BIG_RUN"}')], "account string, kind string, match_key string, detail_response_id long, json_text string")
    got = {r["match_key"]: (r["analysis_set"], r["roster_class"]) for r in classify.classify(d).collect()}
    assert got == {"x": ("hold", "unknown"), "y": ("hold", "unknown"), "z": ("big_run", "not_applicable")}


def test_metrics(spark):
    doc = {"dangerRate": 0.2, "jobRate": 120, "kill": 3, "flag": True, "myResult": {"goldenDeliverCount": 40}, "memberResults": [{"goldenDeliverCount": 99}], "waveResults": [{"teamDeliverCount": 20}, {"teamDeliverCount": 22}, {}], "bankaraMatch": {"bankaraPower": {"power": 2100, "weaponPower": 1980}}}
    d = _vs(spark, [doc]).withColumns({"genre": F.lit("big_run"), "rule_raw": F.lit("BIG_RUN"), "played_time": F.lit("2026-09-22")})
    got = {r["series_id"].split("|")[2]: (r["value"], r["label"], r["priority"]) for r in rates.observations(d).collect()}
    assert got["waveResults.teamDeliverCountSum"] == (42.0, "集めた金イクラ", "primary")
    assert got["jobRate"][2] == "secondary" and got["bankaraMatch.bankaraPower.power"][1] == "バンカラパワー"
    assert set(got) == {"dangerRate", "jobRate", "myResult.goldenDeliverCount", "waveResults.teamDeliverCountSum", "bankaraMatch.bankaraPower.power", "bankaraMatch.bankaraPower.weaponPower"}


def test_series_summary_and_units(spark):
    rows = [("a", "bankara_open|AREA|bankaraPower", "バンカラパワー", "bankara_open", "AREA", f"m{i}", f"2026-09-0{i}", v, "api", "primary") for i, v in ((1, 2000.0), (2, 2100.0), (3, None))]
    rows += [("a", "salmon_regular|REGULAR|dangerRate", "キケン度", "salmon_regular", "REGULAR", f"c{i}", f"2026-09-0{i}", v, "api", "primary") for i, v in ((1, 0.2), (2, 0.25))]
    rows += [("a", "nawabari|TURF_WAR|vibes", "チョーシ", "nawabari", "TURF_WAR", "v", "2026-09-01", 5.0, "api", "primary"), ("a", "x||earnedUdemaePoint", "ウデマエポイント増減", "x", None, "u", "2026", 1.0, "api", "primary")]
    got = rates.rate_summary(spark.createDataFrame(rows, schema.TABLES["rate_points"])).collect()
    assert [r["label"] for r in got] == ["チョーシ", "バンカラパワー", "キケン度"]
    assert (got[1]["count"], got[1]["latest"], got[1]["previous"], got[1]["delta"], got[1]["min"], got[1]["max"]) == (2, 2100.0, 2000.0, 100.0, 2000.0, 2100.0)
    assert got[2]["unit"] == "ratio" and got[0]["previous"] is None and got[0]["delta"] is None


def test_rule_results_count_exempted_as_other(spark):
    p = spark.createDataFrame([("a", "AREA", "AREA", j) for j in ("WIN", "LOSE", "EXEMPTED_LOSE")] + [("a", "LOFT", "LOFT", "DRAW"), ("a", "GOAL", "GOAL", None)], "account string, rule_raw string, rule_name string, judgement string")
    got = {r["rule_raw"]: tuple(r)[3:] for r in views.by_rule(p).collect()}
    assert got == {"AREA": (3, 1, 1, 0, 1), "LOFT": (1, 0, 0, 1, 0), "GOAL": (1, 0, 0, 0, 1)}


def test_search_arguments():
    for bad in ({"limit": 0}, {"limit": 201}, {"offset": -1}, {"kind": "x"}, {"rule_raw": "a b"}, {"query": ""}, {"query": "a\nb"}, {"played_from": "2", "played_to": "1"}):
        with pytest.raises(ValueError):
            records.Search(account="a", **bad)


def test_identity(spark):
    b64 = lambda t: base64.b64encode(t.encode()).decode().rstrip("=")
    ids = [b64("VsHistoryDetail-u-x:RECENT:20260922T01_s"), "VsHistoryDetail-u-x:PRIVATE:20260922T01_s", b64("CoopHistoryDetail-u-x:20260922"), "nothing", None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "i int, x string").orderBy("i").select(identity.identity(F.col("x"))).collect()]
    assert [tuple(g) if g else None for g in got] == [("vs", "u-x:20260922T01_s")] * 2 + [("coop", "u-x:20260922"), None, None]


def test_walk_keeps_source_order_and_broken_json(spark):
    d = spark.createDataFrame([(1, '{"b":[1,{"a":null}],"a":true}'), (2, "{"), (3, None)], "id long, json_text string")
    got = [(r["path"], r["type"], r["atom"]) for r in jsonx.all_fields(d).orderBy("ordinal").collect()]
    assert got == [("$", "object", None), ("$.b", "array", None), ("$.b[0]", "integer", "1"), ("$.b[1]", "object", None), ("$.b[1].a", "null", None), ("$.a", "boolean", "true")]


def test_paths(spark):
    d = spark.createDataFrame([("a:bé_-", "2026-09-30T20:00:00Z", None), ("plain", "2026-09-30T20:00:00", "AREA"), ("", "x", "a b")], "s string, t string, r string")
    got = d.select(paths.encode_segment(F.col("s")), paths.local_hour_path(F.col("t")), paths.rule_token(F.col("r"))).collect()
    assert got[0][:] == ("a~3Ab~C3~A9_-", "2026-10/2026-10-01/05", "rule_unknown")
    assert got[1][:] == ("plain", "unknown-date", "AREA") and got[2][0] is None and got[2][2].startswith("rule_") and len(got[2][2]) == 53


def test_numbers(spark):
    d = spark.createDataFrame([(2.0,), (2.5,), (0.12345,), (1234.567,)], "v double")
    assert [r[0] for r in d.select(labels.short_number(F.col("v"))).collect()] == ["2", "2.5", "0.1235", "1234.57"]
    assert labels.nice_ticks(0, 100) == [0, 20, 40, 60, 80, 100] and round(labels.contrast((0, 0, 0), (255, 255, 255))) == 21


def test_reconcile_is_bit_exact(spark):
    cols = "key long, value double, big long, raw binary"
    a = spark.createDataFrame([(2, 0.0, 1, b"x"), (10, 1.0, 2**63 - 1, None), (21, 2.0, 0, b"")], cols)
    b = spark.createDataFrame([(2, -0.0, 1, b"x"), (10, 1.0, 2**63 - 1, None), (99, 2.0, 0, b"")], cols)
    assert sorted((r["key"], r["op"]) for r in cdc.reconcile(a, b, "key").collect()) == [(2, "upsert"), (21, "delete"), (99, "upsert")]
    got = cdc.reconcile(a, b.withColumn("future", F.lit(1)), "key").collect()
    assert sorted(r["op"] for r in got) == ["clear_table", "upsert", "upsert", "upsert"]


@pytest.mark.parametrize("seed", [1, 2])
def test_overlay_equals_replay(spark, seed):
    """Random generations, read by overlay and replayed one operation at a time."""
    r = random.Random(seed)
    rows = {i: f"v{i}" for i in range(30)}
    base = spark.createDataFrame(list(rows.items()), "id long, v string")
    ops = []
    for g in range(4):
        if g and r.random() < 0.3:
            ops.append((g, 0, "clear_table", None, None))
            rows.clear()
        for o in range(1, 15):
            k = r.randrange(40)
            if r.random() < 0.3:
                ops.append((g, o, "delete", k, None))
                rows.pop(k, None)
            else:
                ops.append((g, o, "upsert", k, f"g{g}o{o}"))
                rows[k] = f"g{g}o{o}"
    d = spark.createDataFrame(ops, "generation int, ordinal int, op string, id long, v string")
    assert {x["id"]: x["v"] for x in overlay.current_rows(base, d, "id").collect()} == rows


@pytest.mark.parametrize("seed", [1, 2])
def test_incremental_index_equals_full(spark, seed):
    """After random changes, dirty rows recomputed and merged give the same index as a full run."""
    r = random.Random(seed)
    key = "account string, kind string, match_key string"

    def world(n):
        m = [("a", r.choice(["vs", "coop"]), f"m{i}", "1", "2", i) for i in range(n)]
        c = [(*x[:3], "g", "AREA", r.choice(["xmatch", "fest"])) for x in m if r.random() < 0.8]
        return m, c, [("a", x[2], r.choice("xyz")) for x in m if r.random() < 0.5]

    def index(m, c, t):
        m = spark.createDataFrame(m, key + ", first_seen string, last_seen string, detail_response_id long")
        c = spark.createDataFrame([(*x, "name") for x in c], key + ", genre string, rule_raw string, analysis_set string, rule_name string")
        t = spark.createDataFrame(t, "account string, match_key string, tag string")
        docs = m.where("detail_response_id % 3 > 0").select(F.col("detail_response_id").alias("response_id"), "account", "kind", "match_key", F.lit('{"playedTime":"2026-01-01T00:00:00Z","judgement":"WIN","player":{"weapon":{"name":"w"}}}').alias("json_text"))
        h = m.select("account", "kind", "match_key", F.concat(F.lit("p"), "match_key").alias("part"))
        return layout.match_index(m, c, h, t, docs)

    m, c, t = world(20)
    before = index(m, c, t)
    dirty = {x[2] for x in m if r.random() < 0.3}
    c2 = [(*x[:5], "event") if x[2] in dirty else x for x in c]
    t2 = [x for x in t if x[1] not in dirty] + [("a", k, "new") for k in dirty]
    full = index(m, c2, t2)
    merged = layout.refreshed_index(before, full.where(F.col("match_key").isin(*dirty))) if dirty else before
    rows = lambda d: sorted(tuple(map(str, x)) for x in d.select(*full.columns).collect())
    assert rows(merged) == rows(full)


def test_tags_and_states(spark):
    m = spark.createDataFrame([("a", "vs", "k1", "1", "1", 5), ("a", "vs", "k2", "1", "1", None), ("a", "coop", "k3", "1", "1", None), ("a", "vs", "k4", "1", "1", None)], schema.TABLES["matches"])
    j = spark.createDataFrame([("a", "k2", "pending"), ("a", "k2", "unavailable"), ("a", "k3", "unavailable")], "account string, match_key string, state string")
    assert {r["match_key"]: r["detail_state"] for r in views.detail_states(m, j).collect()} == {"k1": "available", "k2": "pending", "k3": "unavailable", "k4": "unresolved"}
    edits = spark.createDataFrame([("a", "k1", "t", "n1", "1", "add"), ("a", "k1", "t", "n2", "2", "add"), ("a", "k1", "u", None, "1", "add"), ("a", "k1", "u", None, "3", "remove")], "account string, match_key string, tag string, note string, at string, op string")
    got = ingest.tags_after(spark.createDataFrame([], schema.TABLES["match_tags"]), edits).collect()
    assert [(r["tag"], r["note"]) for r in got] == [("t", "n2")]


def test_a_b_a_makes_a_current(spark):
    f = spark.createDataFrame([("a", "op", 1, "t1", "e1"), ("a", "op", 2, "t2", "e2"), ("a", "op", 1, "t3", "e3")], "account string, operation string, response_id long, fetched_at string, event_id string")
    assert ingest.endpoint_heads(f).first()["response_id"] == 1


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    body = base64.b64encode(b'{"data":{"x":1}}').decode()
    spool = tmp_path / "spool"
    spool.mkdir()

    def put(name, event, b=body):
        (spool / name).write_text(json.dumps({"event_id": event, "account": "a", "fetched_at": event, "operation": "op", "variables": "{}", "status": 200, "headers": "{}", "body_base64": b}))

    put("1.json", "e1")
    put("2.json", "e2")
    put("3.json", "e3", "not base64!")
    out = str(tmp_path / "out")
    for n in range(2):
        streaming.ingest_stream(streaming.spool_stream(spark, str(spool)), out, str(tmp_path / "cp")).awaitTermination(120)
        put(f"again{n}.json", "e1")
    counts = [spark.read.parquet(f"{out}/{t}").count() for t in ("bodies", "responses", "fetches")]
    assert counts == [1, 1, 2]
    assert [tuple(r) for r in spark.read.parquet(f"{out}/rejected").collect()] == [("e3", "body is not base64")]


def test_axis_ticks():
    assert labels.nice_ticks(5, 5) == [4.0, 4.5, 5.0, 5.5, 6.0] and labels.nice_ticks(0, 0) == [-2, -1, 0, 1, 2]
    assert labels.nice_ticks(2000, 2100) == [2000, 2020, 2040, 2060, 2080, 2100] and labels.nice_ticks(0, 12) == [0, 2.5, 5, 7.5, 10, 12.5]
    assert labels.grade_ticks(10, 900) == [0, 200, 400, 600, 800, 999]
    assert labels.grade_ticks(-250, 1300) == [-400, -200, 0, 200, 400, 600, 800, 999, 1200, 1400]
    assert labels.grade_ticks(-200, 999) == [-400, -200, 0, 200, 400, 600, 800, 999]


def test_participation_of_long_and_short_periods(spark):
    """Binned: one period spans thousands of short ones, one account holds most rows; ends are exclusive."""
    import random

    draw = random.Random(1)
    periods = [("hot" if i % 3 else "b", float(s := draw.randrange(5000)), s + draw.choice([0.0, 1.0, 2.5, 40.0])) for i in range(400)] + [("hot", -9e5, 9e5), ("b", 7.0, None), (None, 1.0, 2.0)]
    played = [("hot" if draw.random() < 0.9 else "b", float(draw.randrange(6000))) for _ in range(900)] + [("b", None), (None, 1.0)]
    got = jobs.participation(spark.createDataFrame(played, "k string, played_at double"), spark.createDataFrame(periods, "k string, start double, end double"), ["k"])
    want = [(k, a, b, any(k is not None and k == j and t is not None and b is not None and a <= t < b for j, t in played)) for k, a, b in periods]
    assert sorted(map(str, (tuple(r) for r in got.select("k", "start", "end", "participated").collect()))) == sorted(map(str, want))


def test_windows_on_streams(spark, tmp_path):
    spark.range(100).selectExpr("timestamp_seconds(id * 60) as ts", "id % 2 as k").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp, k long").parquet(str(tmp_path / "in"))
    q = streaming.windowed_counts(s, "ts", ["k"]).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").agg(F.sum("n")).first()[0] == 100


def test_lossless_round_trip(spark):
    cols = "id long, t string, d double, b binary"
    rows = [(1, "x" * 50, -0.0, b"\x00\xff"), (2, "a\x07b", 1e300, None), (3, None, None, b""), (4, "", 0.1, b"z")]
    d = spark.createDataFrame(rows, cols)
    pieces = lossless.chunks(lossless.cells(d, "id"), 7)
    whole = lossless.unchunked(pieces, ["row_key", "column_name", "type", "encoding"])
    assert whole.where("not complete").count() == 0
    back = lossless.restored(whole, "row_key", [("id", "bigint"), ("t", "string"), ("d", "double"), ("b", "binary")]).drop("row_key").orderBy("id").collect()
    assert [tuple(r) for r in back] == rows and str(back[0]["d"]) == "-0.0"
    lost = lossless.unchunked(pieces.where("not (row_key = 1 and column_name = 't' and chunk = 2)"), ["row_key", "column_name", "type", "encoding"])
    assert lost.where("not complete").count() == 1


def test_size_bins_hold_their_budget(spark):
    d = spark.range(200).selectExpr("id", "repeat('x', cast(id % 37 as int)) as t")
    sizes = lossless.size_bins(d, "id", F.length("t"), 100).groupBy("part").agg(F.sum(F.length("t")).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("c")).collect()
    assert max(r["n"] for r in sizes) <= 100 and all(r["hi"] - r["lo"] + 1 == r["c"] for r in sizes)


def test_weapon_snapshots(spark):
    node = lambda i, vibes: {"id": i, "stats": {"vibes": vibes, "maxWeaponPower": 2000, "currentWeaponPowerOrder": {"weaponPower": None}}}
    r = spark.createDataFrame([(1, "a", json.dumps({"data": {"weaponRecords": {"nodes": [node("w1", 5), node("w1", 7)]}, "other": {"nodes": [node("w9", 1)]}}})), (2, "a", json.dumps({"data": {"weapons": {"nodes": [node("w2", True)]}}}))], "id long, account string, json_text string")
    f = spark.createDataFrame([(1, "e1", "t1"), (1, "e2", "t2"), (2, "e3", "t3")], "response_id long, event_id string, fetched_at string")
    got = sorted((x["weapon_id"], x["metric"], x["value"], x["event_id"]) for x in rates.weapon_snapshots(r, f).collect())
    assert got == [("w1", "maxWeaponPower", 2000.0, "e1"), ("w1", "maxWeaponPower", 2000.0, "e2"), ("w1", "vibes", 7.0, "e1"), ("w1", "vibes", 7.0, "e2"), ("w2", "maxWeaponPower", 2000.0, "e3")]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"result":{"id":"x","playedTime":"2026-01-01T00:00:00Z"}}')
    (tmp_path / "b.json").write_text("{")
    (tmp_path / "c.json").write_text('{"result":{}}')
    good, bad = env.read_wrapped(spark, str(tmp_path), "me")
    assert good.count() == 1 and sorted(r["reason"] for r in bad.collect()) == ["no result.id", "not JSON"]
    parts = env.joined_chunks(env.file_chunks(spark, str(tmp_path / "a.json"), 10)).first()
    assert parts["verified"] and bytes(parts["content"]) == (tmp_path / "a.json").read_bytes()
    with pytest.raises(ValueError):
        env.query(spark, "drop table x", {})
    lines, foot = env.typed_lines(spark.range(5), 3)
    assert lines.count() == 3 and foot == {"rows": 3, "truncated": True}


def test_homes_never_lose_rows(spark):
    m = spark.createDataFrame([("a", "vs", "k", "matches/x.parquet")], "account string, kind string, match_key string, part string")
    homes = {"match": m, "any_match": layout.prefer_vs(m), "response": spark.createDataFrame([(1, "responses/r.parquet")], "id long, part string"), "fetches": spark.createDataFrame([("e1", "2026-09-30T20:00:00Z")], "event_id string, fetched_at string")}
    t = spark.createDataFrame([("a", "k", "t"), ("a", "gone", "t")], "account string, match_key string, tag string")
    assert {r["match_key"]: r["part"] for r in layout.home_of("match_tags", t, homes).collect()} == {"k": "matches/x.parquet", "gone": "unplaced/match_tags.parquet"}
    p = spark.createDataFrame([("a", "fetch:e1"), ("a", "fetch:e2"), ("a", "k")], "account string, match_key string")
    assert {r["match_key"]: r["part"] for r in layout.home_of("rate_points", p, homes).collect()} == {"fetch:e1": "fetches/2026-10/2026-10-01.parquet", "fetch:e2": "unplaced/rate_points.parquet", "k": "matches/x.parquet"}
    i = spark.createDataFrame([(1, "c"), (None, "c"), (9, "c")], "response_id long, code string")
    assert sorted(str(r["part"]) for r in layout.home_of("issues", i, homes).collect()) == ["responses/r.parquet", "system/issues.parquet", "unplaced/issues.parquet"]


def test_gear_and_teams(spark):
    doc = _match("PRIVATE", 1, [1])
    doc["myTeam"]["players"][0] |= {"headGear": {"n": 1}, "isMyself": True}
    doc["otherTeams"].append({"players": None})
    d = _vs(spark, [doc, {"myTeam": [], "otherTeams": None}])
    teams = details.battle_teams(d)
    assert sorted((r["match_key"], r["team_index"]) for r in teams.collect()) == [("m0", 0), ("m0", 1), ("m0", 2)]
    players = details.battle_players(teams)
    assert players.count() == 2 and players.where("is_myself = 1").count() == 1
    assert [r["slot"] for r in details.battle_gear(players).collect()] == ["headGear"]


def test_job_decisions():
    assert cdc.needs_reset(None, 5, False, "a", "a") and cdc.needs_reset(6, 5, False, "a", "a") and not cdc.needs_reset(5, 5, False, "a", "a")
    assert cdc.is_idle(True, 5, 5, "a", "a") and not cdc.is_idle(False, 5, 5, "a", "a")
    assert layout.rebuild_mode(True, False, 3, 3, "a", "a", 1, 2, 0) == "delta" and layout.rebuild_mode(True, False, 3, 4, "a", "a", 1, 2, 0) == "full"
    assert jobs.priority is not None


SELECTIONS = [
    {"kind": "LinkedField", "name": "history", "concreteType": "History", "plural": False, "args": [{"kind": "Variable", "name": "after", "variableName": "cursor"}], "selections": [
        {"kind": "LinkedField", "name": "nodes", "concreteType": "Node", "plural": True, "args": None, "selections": [{"kind": "ScalarField", "name": "id"}, {"kind": "ScalarField", "name": "score"}]},
        {"kind": "Condition", "condition": "full", "passingValue": True, "selections": [{"kind": "ScalarField", "name": "extra"}]},
        {"kind": "InlineFragment", "type": "Other", "selections": [{"kind": "ScalarField", "name": "only_other"}]},
        {"kind": "Strange", "selections": []},
    ]},
]


def test_schema_walk(spark):
    from ledgerloom.operators import schema_walk as sw

    data = {"history": {"nodes": [{"id": "a"}, None, 5, {"id": "b", "score": 1}], "pageInfo": {"hasNextPage": True, "endCursor": "c1"}}}
    catalog = {"Q": {"operation": {"selections": SELECTIONS}}}
    rows = [(1, "Q", '{"full":true,"cursor":null}', json.dumps({"data": data})), (2, "Q", '{"cursor":"c1"}', json.dumps({"data": data})), (3, "Q", "{}", json.dumps({"data": {"history": []}})), (4, "Z", "{}", '{"data":{}}'), (5, "Q", "{}", "{")]
    got = {}
    for r in sw.findings(spark.createDataFrame(rows, "id long, operation string, variables_json string, json_text string"), catalog).collect():
        got.setdefault((r["id"], r["finding"]), []).append(r["path"])
    assert got[1, "missing"] == ["$.history.__unhandled_selection__Strange", "$.history.extra", "$.history.nodes[0].score"]
    assert got[2, "missing"] == ["$.history.__unhandled_selection__Strange", "$.history.nodes[0].score"]
    assert got[1, "shape"] == ["$.history.nodes[2]"] and got[3, "shape"] == ["$.history"]
    assert got[1, "next"] == ["$.history"] and got[2, "stalled"] == ["$.history"] and got[4, "unknown_operation"] == ["$"]
    assert sorted(got[1, "entity"]) == ["$.history.nodes[0]", "$.history.nodes[3]"] and not any(k[0] == 5 for k in got)
    arg = lambda *names: [{"name": n} for n in names]
    op = lambda kind, sel, *names: {"params": {"operationKind": kind}, "operation": {"argumentDefinitions": arg(*names), "selections": sel}}
    by_id = [{"kind": "LinkedField", "name": "x", "concreteType": "Match", "args": [{"kind": "Variable", "name": "id", "variableName": "mid"}], "selections": []}]
    assert sw.plan({"a": op("query", [], "cursor"), "b": op("query", by_id, "mid"), "c": op("query", [], "odd"), "d": op("mutation", []), "e": op("query", [])}, {"e": "why"}, {"cursor"}) == {"a": ("root", None), "b": ("related", None), "c": ("unsupported", "odd"), "d": ("excluded", "no query"), "e": ("excluded", "why")}
    objects = spark.createDataFrame([("Match", "1"), ("Match", "1"), ("Else", "2")], "typename string, entity_id string")
    assert [tuple(r) for r in sw.related(objects, {"b": ("mid", ["Match"])}).collect()] == [("b", "mid", "1")]


def test_recipes(spark):
    from ledgerloom.plans import fixtures as fx
    from ledgerloom.plans import recipes

    d = "/root/testdata/sf0.001"
    coop = fx.coop_details(spark, d)
    tables = {t: spark.createDataFrame([], ddl) for t, ddl in schema.TABLES.items()} | {
        "matches": fx.matches(spark, d), "documents": fx.documents(spark, d), "coop_details": coop, "match_tags": fx.tags(spark, d),
        "jobs": fx.jobs(spark, d).withColumn("operation", F.lit("Op")).withColumn("attempts", F.lit(1)),
        "response_fetches": spark.createDataFrame([("a", 1, "2026-01-01T00:00:00Z"), ("b", 1, "2026-01-01T00:01:00Z"), ("c", 2, "x")], "event_id string, response_id long, fetched_at string"),
        "rate_points": spark.createDataFrame([("a", "g|R|jobRate", "L", "g", "R", "m1", "t1", 2.0, "api", "primary"), ("a", "g|R|jobRate", "L", "g", "R", "m2", "t2", 5.0, "api", "primary")], schema.TABLES["rate_points"]),
    }
    r = recipes.RECIPES
    wins = r["win_rates"](tables).collect()
    assert len(wins) > 5 and all(x["win_rate"] is None or abs(x["win_rate"] - x["wins"] / (x["wins"] + x["losses"])) < 1e-12 for x in wins)
    one = tables["matches"].where("detail_response_id is not null").first()
    sheet = r["match_sheet"](tables, one["account"], "vs", one["match_key"]).collect()
    assert len(sheet) == 1 and sheet[0]["detail_state"] == "available" and sheet[0]["json_text"] and r["match_sheet"](tables, "none", "vs", "m").count() == 0
    assert r["weapon_results"](tables).agg(F.sum("matches")).first()[0] > 0
    waves = {x["match_key"]: tuple(x)[2:] for x in r["wave_totals"](tables).collect()}
    for k, n in coop.select("match_key", F.get_json_object("json_text", "$.myResult.goldenDeliverCount").cast("int")).collect():
        assert waves[k] == (2, 2 * n + 1, n + 1)
    assert [tuple(x)[7:] for x in r["courses"](tables).collect()] == [(2, 5.0, 2.0, 3.0, 2.0, 5.0, "number")]
    assert {x["match_key"] for x in r["tagged_matches"](tables, "x").collect()} == {x["match_key"] for x in tables["match_tags"].where("tag = 'x'").collect()}
    assert [tuple(x) for x in r["refetched"](tables).collect()] == [(1, 2, "2026-01-01T00:00:00Z", "2026-01-01T00:01:00Z", 60)]
    assert {x["state"]: x["jobs"] for x in r["open_work"](tables).collect()} == {x["state"]: x["count"] for x in tables["jobs"].where("state <> 'unavailable'").groupBy("state").count().collect()}


def test_size_bins_agree_on_ranges_that_a_sample_cannot_cover(spark):
    rows = spark.range(0, 2_000_000, 1, 6).select(F.xxhash64("id").alias("id"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(200)) + 1).alias("b"))
    for most in (1_000_000, 90):
        part = lossless.size_bins(rows if most > 90 else rows.limit(20_000), "id", F.col("b"), most).groupBy("part").agg(F.sum("b").alias("b"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"))
        got = sorted(part.collect(), key=lambda r: r["lo"])
        assert all(r["b"] <= most or r["n"] == 1 for r in got) and [r["part"] for r in got] == sorted(r["part"] for r in got)
        assert all(x["hi"] < y["lo"] for x, y in zip(got, got[1:], strict=False)) and sum(r["n"] for r in got) == (2_000_000 if most > 90 else 20_000)
    odd = spark.createDataFrame([(None, 5), ("a", None), ("b", 500), ("c", 1)], "id string, b long")
    assert [r["part"] for r in lossless.size_bins(odd, "id", F.col("b"), 10).orderBy("id").collect()] == [0, 1, 2, 103]


def test_stream_digest_folds_in_levels(spark):
    rows = spark.range(5000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    one = lambda d, run=4: lossless.stream_digest(d, "id", run).first()
    assert one(rows) == one(rows.repartition(5)) and one(rows)["rows"] == 5000
    assert len({one(d)["digest"] for d in (rows, rows.where("id <> 4321"), rows.withColumn("digest", F.when(F.col("id") == 7, "x").otherwise(F.col("digest"))))}) == 3
    assert one(rows.limit(0))["rows"] == 0


def test_outsized_cells(spark):
    c = spark.createDataFrame([("r", 0, "a", "x" * 60), ("r", 1, "b", "x" * 50), ("r", 2, "c", "x" * 30), ("s", 0, "a", "y"), ("t", 0, "a", None)], "row_key string, column_index int, column_name string, value string")
    assert {tuple(x) for x in lossless.outsized(c, 100).collect()} == {("r", "a")} and {tuple(x) for x in lossless.outsized(c, 70).collect()} == {("r", "a"), ("r", "b")}


def test_envelopes_choose_among_clashing_fetches(spark):
    import base64

    enc = lambda x: base64.b64encode(x.encode()).decode()
    rows = [("e1", "a", "2026-01-02", "Op", "{}", None, None, 200, "{}", enc("later")), ("e1", "a", "2026-01-01", "Op", "{}", None, None, 200, "{}", enc("first")), ("e1", "a", "2026-01-01", "Op", "{}", None, None, 200, "{}", enc("first")), ("e2", "a", "2026-01-01", "Op", "{}", None, None, 200, "{}", enc("x"))]
    for order in (rows, rows[::-1]):
        good, _ = ingest.envelopes(spark.createDataFrame(order, schema.ENVELOPE))
        assert {x["event_id"]: bytes(x["body"]) for x in good.collect()} == {"e1": b"first", "e2": b"x"} and good.count() == 2


def test_project_is_one_plan_over_the_log(spark):
    import base64
    import json

    mid = base64.b64encode(b"VsHistoryDetail-u-abc:RECENT:20260101T000000_d1").decode()
    enc = lambda x: base64.b64encode(json.dumps(x).encode()).decode()
    detail = {"data": {"detail": {"id": mid, "playedTime": "2026-01-01T00:00:00Z", "image": {"url": "https://h/i.png"}}}}
    row = lambda e, at, op, body, status=200: (e, "acc", at, op, "{}", None, None, status, "{}", body)
    log = [row("f1", "2026-01-01", "List", enc({"data": {"nodes": [{"id": mid}]}})), row("f2", "2026-01-02", "Detail", enc(detail)), row("f3", "2026-01-03", "Detail", enc(detail)), row("f4", "2026-01-04", "List", enc({"data": None}), 500), row("f5", "2026-01-05", "Bad", base64.b64encode(b"{").decode())]
    for order in (log, log[::-1]):
        p = ingest.project(ingest.envelopes(spark.createDataFrame(order, schema.ENVELOPE))[0], {"Detail": "detail"})
        assert {x["id"]: x["outcome"] for x in p["responses"].collect()} == {"f1": "done", "f2": "done", "f4": "retry", "f5": "retry"}
        assert {(x["event_id"], x["response_event_id"]) for x in p["receipts"].collect()} == {("f1", "f1"), ("f2", "f2"), ("f3", "f2"), ("f4", "f4"), ("f5", "f5")}
        assert {tuple(x) for x in p["issues"].collect()} == {("f4", "INCOMPLETE_RESPONSE"), ("f5", "INVALID_JSON")}
        assert {tuple(x) for x in p["endpoint_heads"].collect()} == {("acc", "List", "f1"), ("acc", "Detail", "f2")}
        m = p["matches"].collect()
        assert len(m) == 1 and (m[0]["first_seen"], m[0]["last_seen"], m[0]["detail_response_id"]) == ("2026-01-01", "2026-01-02", "f2")
        assert [json.loads(x["json_text"]) for x in p["documents"].collect()] == [detail["data"]["detail"]] and [x["url"] for x in p["asset_refs"].collect()] == ["https://h/i.png"]
        assert {(x["operation"], x["state"], x["attempts"]) for x in p["jobs"].collect()} == {("List", "retry", 2), ("Detail", "done", 2), ("Bad", "retry", 1)}


def _gaps(rows):
    """(key, day, members, possible gap) of (key, day, member) rows."""
    sets = {}
    for key, day, member in rows:
        sets.setdefault((key, day), set()).update([] if member is None else [member])
    out, before = set(), {}
    for key, day in sorted(sets, key=lambda x: (str(x[0]), x[1] is not None, x[1])):
        now, last = sets[key, day], before.get(key, set())
        out.add((key, day, len(now), bool(now and last and not now & last)))
        before[key] = now
    return out


def test_history_gaps_of_rows(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 1, 2, 3, 4, 7, 9]), r.choice([None, *range(12)])) for _ in range(70)] + [("c", 1, None), ("c", 2, 5), ("d", None, 1), ("d", 1, 2), ("d", 2, 2)]
    got = rates.history_gaps_of_rows(spark.createDataFrame(rows, "k string, day int, m int"), ["k"], "day", "m")
    want = _gaps(rows)
    assert {tuple(x) for x in got.collect()} == want and {True, False} == {x[3] for x in want}


def test_history_gap_counts_all_users(spark):
    from ledgerloom.plans import registry

    directory = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{directory}/events.parquet").selectExpr("event_type", "date_format(ts, 'yyyy-MM-dd')", "user_id")
    assert {tuple(x) for x in registry.queries()["history_gap"](spark, directory).collect()} == _gaps(map(tuple, events.collect()))


def test_parts_and_versions(spark, tmp_path):
    from pyspark.sql import functions as F

    from ledgerloom.sources import parts

    rows = spark.range(20_000).select("id", F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("text"))
    parts.write_parts(rows, "id", F.octet_length("text"), str(tmp_path / "p"), 50_000)
    manifest = spark.read.parquet(str(tmp_path / "p/manifest")).orderBy("part").collect()
    assert sum(m["rows"] for m in manifest) == 20_000 and max(m["bytes"] for m in manifest) <= 50_000 and len(manifest) > 10
    got = parts.read_range(spark, str(tmp_path / "p"), "id", 1234, 5678)
    assert sorted(r["id"] for r in got.collect()) == list(range(1234, 5679)) and set(got.columns) == {"id", "text"}
    assert parts.read_range(spark, str(tmp_path / "p"), "id", 30_000, 40_000).count() == 0

    root = str(tmp_path / "t")
    parts.publish(rows.limit(5), root, 1)
    old = parts.open_version(spark, root)
    parts.publish(rows.limit(9), root, 2)
    assert old.count() == 5 and parts.open_version(spark, root).count() == 9 and parts.open_version(spark, root, 1).count() == 5
    with pytest.raises(LookupError):
        parts.open_version(spark, root, 3)
    with pytest.raises(Exception):
        parts.publish(rows, root, 2)
    parts.backup(spark, root, str(tmp_path / "copy"))
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 9
    with pytest.raises(Exception):
        parts.backup(spark, root, str(tmp_path / "copy"))


def test_lines_header_and_asset_list(spark, tmp_path):
    from ledgerloom.sources import envelopes

    a = spark.createDataFrame([("u2", "done", None, "b", 1), ("u1", "retry", "image/png", None, 2)], "url string, state string, content_type string, body_sha256 string, attempts int")
    assert envelopes.lines_header(a)["columns"][-1] == {"name": "attempts", "type": "int"}
    envelopes.export_assets(a, str(tmp_path))
    assert {r["url"] for r in spark.read.json(str(tmp_path / "assets")).collect()} == {"u1", "u2"}


def test_counts_of_data_sets(spark):
    from ledgerloom.operators import sync

    c = spark.createDataFrame([(3, 6, 3, 2), (2, 5, 3, 2), (-1, 0, 0, 2)], "mode_files int, rule_files int, modes int, rules int")
    assert sorted(r["problem"] for r in sync.count_problems(c).collect()) == ["mode files", "mode files", "negative", "rule files"]


def test_json_is_parsed_once(spark):
    d = spark.createDataFrame([("a", "vs", "m", 1, "{}")], "account string, kind string, match_key string, detail_response_id long, json_text string")
    from ledgerloom.operators import classify, views

    plan = views.by_rule(views.population_of(classify.classify(d, also=classify.SHOWN), "xmatch"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.lower().count("parsejson") <= 2


def test_catalog_binding_corrupt_invalid_and_any_version(spark):
    from hashlib import sha256

    from ledgerloom.operators import jobs

    h = lambda t: sha256(t.encode()).hexdigest()
    d = spark.createDataFrame(
        [
            ("now", "op", "q1", "1", "d", h("d")), ("old", "op", "q1", "2", "e", h("e")),
            ("old", "op", "q2", "1", "d", "00"), ("old", "op", "q3", "1", None, h("d")),
            ("old", "op", "q4", None, "d", h("d")), ("old", None, "q5", "1", "d", h("d")),
        ],
        "catalog string, operation string, query_id string, app_version string, definition string, sha256 string",
    )
    asked = [(1, "q1", "1"), (2, "q1", "2"), (3, "q1", None), (4, "q2", "1"), (5, "q3", None), (6, "q4", None), (7, "q4", "1"), (8, "q5", "1"), (9, "", "1"), (10, None, "1")]
    r = spark.createDataFrame([(i, "op", q, v) for i, q, v in asked], "id long, operation string, query_id string, app_version string")
    got = {x["id"]: x["binding"] for x in jobs.catalog_binding(d, r, "now").collect()}
    assert got == {
        1: "known_current", 2: "known_saved", 3: "ambiguous", 4: "catalog_corrupt", 5: "catalog_invalid",
        6: "known_saved", 7: "unresolved", 8: "unresolved", 9: "unresolved", 10: "legacy_unchecked",
    }


def test_host_allowed_buckets(spark):
    from pyspark.sql import functions as F

    from ledgerloom.operators import evidence

    urls = {
        "https://good.example/x": True, "https://store.example/mine/a?x=1": True, "https://store.example//mine": True, "https://store.example/other/mine": False,
        "https://store.example": False, "https://a.store.example/mine/a": False, "http://store.example/mine/a": False, "https://u@store.example/mine/a": False,
    }
    df = spark.createDataFrame([(u,) for u in [*urls, None]], "u string")
    got = {x["u"]: x["a"] for x in df.select("u", evidence.host_allowed(F.col("u"), ("good.example",), {"store.example": "mine"}).alias("a")).collect()}
    assert got == urls | {None: False}
