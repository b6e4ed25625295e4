"""Faults that were found at size or on odd inputs, on the smallest input that shows each."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import jsonx
from ledgerloom.operators import details, evidence, ingest, layout, lossless, rates
from ledgerloom.plans import archive_queries, catalog_queries, delta_queries, store_queries
from ledgerloom.sources import commits, lookup, parts


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_weapon_snapshots_are_not_broadcast(spark, tmp_path):
    """Once its Variants are gone, a frame is taken for a fiftieth of its size; at 1 GB that was broadcast through the driver."""
    r = spark.createDataFrame([(1, "a", '{"data":{"weapons":{"nodes":[{"id":"w","stats":{"vibes":2}}]}}}')], "id long, account string, json_text string")
    f = spark.createDataFrame([(1, "e", "t")], "response_id long, event_id string, fetched_at string")
    kept = lambda df, name: (df.write.parquet(str(tmp_path / name)), spark.read.parquet(str(tmp_path / name)))[1]  # noqa: E731  (the size of files is known)
    got = rates.weapon_snapshots(kept(r, "r"), kept(f, "f"))
    assert "Broadcast" not in _plan(got) and [tuple(x) for x in got.collect()] == [("a", "w", "vibes", 2.0, "e", "t")]


@pytest.mark.parametrize("text, fine", [("4703443633947811 Ach", False), ('{"a":1} x', False), ('{"a":1}{"b":2}', False), ('"a"],["b"', False), ('1}, {"b":2', False), ("1,2", False), ('1,"b":2', False), ("", False), (None, False), (" ", False), ("1", True), (' {"a":[1]}\n', True), ('"x"', True), ("null", True), ("[]", True)])
def test_text_after_a_json_value(spark, text, fine):
    assert spark.createDataFrame([(text,)], "t string").select(jsonx.is_json(F.col("t"))).first()[0] is fine


def test_response_that_only_begins_as_json(spark):
    row = (b"4703443633947811 Ach", "a", "op", "{}", "h", 200, None, None, "e", "t")
    d = spark.createDataFrame([row], "body binary, account string, operation string, variables_json string, body_sha256 string, http_status int, query_id string, app_version string, event_id string, fetched_at string")
    assert ingest.responses(d).select("json_text", "parse_error").collect() == [(None, "INVALID_JSON")]


def test_display_stats_of_long_ids(spark, tmp_path):
    """Of two events of one time the greater number is the later, with a digit more too."""
    rows = [(10**12 - 1, 7, "click"), (10**12, 7, "click"), (10**13, 8, "click"), (9 * 10**12, 8, "click")]
    e = spark.createDataFrame(rows, "event_id long, user_id long, event_type string").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    e.write.parquet(str(tmp_path / "events.parquet"))
    got = {x["account"]: x["latest"] for x in catalog_queries.display_stats(spark, str(tmp_path)).collect()}
    assert got == {"u7": str(10**12 % 41), "u8": str(10**13 % 41)}


def test_small_parts_share_files(spark, tmp_path):
    """A file for each part of 95 bytes was what took the time."""
    parts.write_parts(spark.range(1000).select("id", F.lit("x" * 10).alias("t")), "id", F.octet_length("t"), str(tmp_path / "p"), 95)
    assert spark.read.parquet(str(tmp_path / "p/manifest")).count() == 112 and len(list((tmp_path / "p/rows").rglob("*.parquet"))) == 1
    assert sorted(r["id"] for r in parts.read_range(spark, str(tmp_path / "p"), "id", 100, 120).collect()) == list(range(100, 121))


def test_projection_does_not_go_back_to_the_fetches(spark):
    """Each of its tables made the responses anew: one row of each event_id, JSON checks, outcomes."""
    plan = _plan(delta_queries.projected_issues(spark, "/root/testdata/sf0.001"))
    assert "orders.parquet" not in plan and "Window" not in plan


def test_searches_share_a_listing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = spark.range(100).select("id", (F.col("id") * 2).alias("v"))
    lookup.write_indexed(rows, path, "id", F.lit(100), ["v"], 1000)
    there, opened = spark.read.parquet(f"{path}/rows"), []
    ops = spark.createDataFrame([], "generation long, ordinal long, op string, id long, v long")
    whole = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *p: (opened.extend(p), whole(self, *p))[1])
    assert [tuple(r) for r in lookup.find(spark, path, ops, "id", {"v": 14}, there).collect()] == [(7, 14)]
    assert not [p for p in opened if p.endswith("/rows")]


def _initial(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_part_home_reads_each_detail_once(spark):
    """Documents were made and parsed twice, for the classes and for the time, and their texts went to the matches."""
    plan = _initial(store_queries.part_home(spark, "/root/testdata/sf0.001"))
    assert plan.count("parseJson(") == 1


def test_homes_without_a_document(spark):
    """A match whose detail is not there keeps its row, and a document that is no match's detail tells nothing."""
    m = spark.createDataFrame([("a", "vs", "m1", 1), ("a", "vs", "m2", 2), ("a", "vs", "m3", None)], "account string, kind string, match_key string, detail_response_id long")
    text = '{"vsMode":{"mode":"X_MATCH"},"vsRule":{"rule":"AREA"},"playedTime":"2024-01-01T20:00:00Z"}'
    docs = spark.createDataFrame([(1, "a", "vs", "m1", text), (9, "a", "vs", "m2", text)], "response_id long, account string, kind string, match_key string, json_text string")
    c = details.classified(m, docs, {"played_time": "$.playedTime"}, "left").withColumn("part", layout.home_part())
    lost = "matches/unclassified/no-rule/unknown-date/%s.parquet"
    assert {r["match_key"]: r["part"] for r in c.collect()} == {"m1": "matches/xmatch/AREA/2024-01/2024-01-02/m1.parquet", "m2": lost % "m2", "m3": lost % "m3"}
    assert [r["match_key"] for r in details.classified(m, docs).collect()] == ["m1"]


def test_match_index_reads_each_detail_once(spark):
    """Documents were made and parsed three times: for the classes, the homes and the index."""
    plan = _initial(store_queries.match_index(spark, "/root/testdata/sf0.001"))
    assert plan.count("parseJson(") == 1


def test_response_home_reads_each_detail_once(spark):
    plan = _initial(store_queries.response_home(spark, "/root/testdata/sf0.001"))
    assert plan.count("parseJson(") == 1


def test_status_counts_classes_in_one_pass(spark):
    plan = _initial(store_queries.archive_status(spark, "/root/testdata/sf0.001"))
    assert plan.count("parseJson(") == 1


def test_status_of_empty_tables(spark):
    """Each table has its count, also of no rows."""
    t = {"jobs": "state string", "match_classification": "kind string, genre string, roster_class string, analysis_set string", "matches": "detail_response_id long"}
    got = evidence.status({name: spark.createDataFrame([], schema) for name, schema in t.items()}).collect()
    assert sorted(map(tuple, got)) == [("matches", "without detail", 0), ("rows", "jobs", 0), ("rows", "match_classification", 0), ("rows", "matches", 0)]


def test_selectors_do_not_go_back_to_the_classes(spark):
    """Sets, rules and their pairs each took a pass over the classes."""
    c = spark.createDataFrame([("s", "r"), ("s", "r"), ("t", None), (None, "q")], "analysis_set string, rule_raw string").repartition("rule_raw")
    got = lossless.selectors(c, ["analysis_set"])
    assert _initial(got).count("RepartitionByExpression") == 0
    assert sorted(map(tuple, got.collect())) == [("s", "q", 0), ("s", "r", 2), ("t", "q", 0), ("t", "r", 0)]


def test_observations_read_each_detail_once(spark):
    """Classes were joined with the details that they come from."""
    plan = archive_queries.rate_observations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("parseJson(") == 1


def test_state_of_one_layer_is_not_gathered(spark, tmp_path):
    """Every look-up in a state that was written once sorted and shuffled all of it; one in no state at all shuffled what was looked up."""
    log = commits.CommitLog(spark, str(tmp_path / "s"))
    t = commits.BucketTable(log, "t", "k bigint, v map<string,string>", ["k"], F.col("k"), 4)
    rows = spark.range(20).select(F.col("id").alias("k"), F.create_map(F.lit("a"), F.col("id").cast("string")).alias("v"), (F.col("id") == 3).alias("_gone"))
    none = rows.join(t.read(log.read()).withColumnRenamed("v", "w"), "k", "left")
    assert "Join" not in _initial(none) and none.where("w is null").count() == 20
    one = {"tables": {"t": t.write(log.read(), rows)}}
    assert "Aggregate" not in _initial(t.read(one)) and sorted(r["k"] for r in t.read(one).collect()) == [i for i in range(20) if i != 3]
    two = {"tables": {"t": one["tables"]["t"] | t.write(one, rows.where("k = 5").withColumn("_gone", F.lit(True)))}}
    assert sorted(r["k"] for r in t.read(two).collect()) == [i for i in range(20) if i not in (3, 5)]


ODD = [
    '{"myTeam":{"players":[{"id":"p","name":5,"weapon":{"name":"w"},"isMyself":true,"paint":7,"result":{"kill":-1,"assist":false,"death":"2","special":1.5}},3,null,{"id":null,"weapon":"w","paint":12345678901234567890,"result":[1]},{"id":"q \\" \\u00e9","weapon":{"name":{"a":1}},"paint":9223372036854775807}]},"otherTeams":[null,{"players":{"id":"x"}},5,{"players":[]},{"players":[{"id":"y"}]}]}',
    '{"myTeam":[{"players":[{"id":"no"}]}],"otherTeams":[{"players":[{"id":"z","isMyself":1}]}]}', '{"otherTeams":{"players":[{"id":"no"}]}}', '{"myTeam":{"players":[{"id":"own"}]},"otherTeams":null}', '{"myTeam":null}', "[]", "7", "null", "{", None,
]


def test_players_in_one_walk(spark):
    """Each field of a player was sought and cast twice, in copies of the player, its team and the detail; what is odd is read as before."""
    d = spark.createDataFrame([("a", "vs", f"m{i}", t) for i, t in enumerate(ODD)] + [("a", "coop", "c", ODD[0])], "account string, kind string, match_key string, json_text string")
    players = details.players_of(d, texts=False)
    assert _initial(players).count("parseJson(") == 1
    names = players.columns
    got, texts, teams = [sorted(map(str, x.select(*names).collect())) for x in (players, details.players_of(d), details.battle_players(details.battle_teams(d)))]
    assert got == texts == teams
    want = {("m0", 0, 0): ("p", None, "w", 1, 7, -1, 0, None, None), ("m0", 0, 1): (None,) * 9, ("m0", 0, 2): (None,) * 9, ("m0", 0, 3): (None,) * 9, ("m0", 0, 4): ('q " \u00e9', None, None, None, 2**63 - 1, None, None, None, None), ("m0", 5, 0): ("y", *(None,) * 8), ("m1", 1, 0): ("z", None, None, 1, *(None,) * 5), ("m3", 0, 0): ("own", *(None,) * 8)}
    columns = [*details.TEXTS, *details.NUMBERS]
    assert {(r["match_key"], r["team_index"], r["player_index"]): tuple(r[c] for c in columns) for r in players.collect()} == want
    assert {(r["team_index"], r["is_my_team"]) for r in players.collect()} == {(0, 1), (1, 0), (5, 0)}
