"""Packing, generations and look-ups against plain sequential versions, and what their plans read."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import overlay, packing
from ledgerloom.sources import lookup, parts


def _greedy(sizes, most, external):
    part, open_, out = -1, None, []
    for s in sizes:
        moved = (s or 0) > external
        b = packing.POINTER_BYTES if moved else s or 0
        if open_ is None or open_ + b > most:
            part, open_ = part + 1, 0
        open_ += b
        out.append((part, moved))
    return out


@pytest.mark.parametrize("most, external, run, fan", [(50, 10**9, 40, 3), (300, 250, 64, 64), (1000, 90, 7, 2)])
def test_packing_is_the_sequential_one(spark, most, external, run, fan):
    draw = random.Random(most)
    rows = [(i, draw.choice([None, 0, draw.randrange(60), draw.randrange(400)]), "x") for i in range(400)]
    got = packing.pack(spark.createDataFrame(rows, "id long, b long, _run string").repartition(5), "id", F.col("b"), most, external, run, fan)
    assert got.columns == ["id", "b", "_run", "external", "part"]
    assert [(r["part"], r["external"]) for r in got.orderBy("id").collect()] == _greedy([r[1] for r in rows], most, external)


def test_packing_equal_rows_and_none(spark):
    even = spark.range(1000)
    assert [r["n"] for r in packing.pack(even, "id", F.lit(10), 95, run=64, fan=2).groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()] == [9] * 111 + [1]
    assert packing.pack(even.limit(0), "id", F.lit(1), 10).count() == 0


def test_maps_compose():
    import numpy as np

    draw = np.random.default_rng(0)
    for _ in range(300):
        most = int(draw.integers(5, 60))
        sizes = draw.integers(0, most + 1, int(draw.integers(2, 30)))
        k = int(draw.integers(1, len(sizes)))
        whole, two = packing.RunMap.of(sizes, most), packing.RunMap.of(sizes[:k], most).then(packing.RunMap.of(sizes[k:], most))
        for open_ in range(most + 2):
            b, n = open_, 0
            for s in sizes:
                b, n = (s, n + 1) if b + s > most else (b + s, n)
            for m in (whole, two):
                assert tuple(int(x[0]) for x in m.through(np.array([open_]), np.array([0]))) == (b, n)


def _history(draw, keys, generations):
    ops, n = [], 0
    for g in generations:
        for _ in range(draw.randrange(2 * keys)):
            n += 1
            op = draw.choice(["upsert", "upsert", "delete", "clear_table" if draw.random() < 0.1 else "upsert"])
            k = None if op == "clear_table" else draw.randrange(keys)
            ops.append((g, n, op, k, draw.choice([None, 1.5, 2.5]) if op == "upsert" else None, draw.choice("xyz") if op == "upsert" else None))
    return ops


SCHEMA = "generation long, ordinal long, op string, id long, v double, w string"


@pytest.mark.parametrize("seed", range(3))
def test_generation_counts(spark, seed):
    draw = random.Random(seed)
    base = [(i, 1.0, "b") for i in range(0, 20, 3)]
    generations = [0, 1, 4, 5, 9]
    ops = spark.createDataFrame(_history(draw, 20, generations), SCHEMA)
    baseline = spark.createDataFrame(base, "id long, v double, w string")
    got = {r["generation"]: r["rows"] for r in overlay.generation_counts(baseline, ops, "id").collect()}
    named = {r[0] for r in ops.select("generation").distinct().collect()}
    assert got == {g: overlay.current_rows(baseline, ops.where(F.col("generation") <= g), "id").count() for g in {-1, *named}}


def test_generation_counts_read_each_source_once(spark, tmp_path):
    ops = spark.createDataFrame(_history(random.Random(1), 20, [0, 1, 2]), SCHEMA)
    ops.write.parquet(str(tmp_path / "ops"))
    spark.range(9).write.parquet(str(tmp_path / "base"))
    out = overlay.generation_counts(spark.read.parquet(str(tmp_path / "base")), spark.read.parquet(str(tmp_path / "ops")), "id")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet") == 2 and "ReusedExchange" in plan


def test_generation_counts_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert [tuple(r) for r in overlay.generation_counts(none.select("id"), none, "id").collect()] == [(-1, 0)]


@pytest.mark.parametrize("seed", range(2))
def test_find_is_the_overlay_filtered(spark, tmp_path, seed):
    draw = random.Random(seed)
    base = [(i, draw.choice([None, 1.5, 2.5, float(i)]), draw.choice(["x", "q", None]), "wide" * 9) for i in range(0, 60, 2)]
    baseline = spark.createDataFrame(base, "id long, v double, w string, wide string")
    lookup.write_indexed(baseline, str(tmp_path / "t"), "id", F.lit(100), ["v", "w"], 500)
    history = [o for o in _history(draw, 60, [0, 1]) if seed or o[2] != "clear_table"]
    ops = spark.createDataFrame([(*o, "changed") for o in history], f"{SCHEMA}, wide string")
    now = overlay.current_rows(baseline, ops, "id").collect()
    for criteria in ({"v": 1.5}, {"v": 1.5, "w": "x"}, {"w": None}, {"v": 4.0}, {"v": 16.0, "w": "q"}, {"id": 7}, {"id": 8}, {"v": None, "w": "z"}, {"v": -1.0}, {"v": 1}, {"id": "7"}):
        want = [tuple(r) for r in now if all(type(v) in (type(None), type(r[c])) and r[c] == v or v is None and r[c] is None for c, v in criteria.items())]
        if any(type(v) is not {"id": int, "v": float, "w": str}[c] for c, v in criteria.items() if v is not None):
            want = []
        got = [tuple(r) for r in lookup.find(spark, str(tmp_path / "t"), ops, "id", criteria).collect()]
        assert len(got) == min(2, len(want)) and set(got) <= set(want), criteria
        if len(want) > 1:
            with pytest.raises(LookupError):
                lookup.find_one(spark, str(tmp_path / "t"), ops, "id", criteria)
        else:
            assert lookup.find_one(spark, str(tmp_path / "t"), ops, "id", criteria) == (want[0] if want else None)


def test_a_search_opens_candidate_parts_and_reads_narrow(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(2000).select("id", (F.col("id") * 7919 % 2003).alias("v"), F.lit("w" * 50).alias("wide"))
    lookup.write_indexed(rows, path, "id", F.lit(100), ["v"], 10_000)
    manifest = spark.read.parquet(f"{path}/manifest")
    assert manifest.count() == 20
    few = lookup.candidate_parts(spark, path, {"v": 7919 * 1234 % 2003})
    assert 1 <= few.count() <= 3  # zone maps alone would leave nearly all
    probe = lookup.candidates(spark, path, "id", spark.read.parquet(f"{path}/rows").schema, {"v": 7919 * 1234 % 2003})
    assert [r["id"] for r in probe.collect()] == [1234]
    plan = probe._jdf.queryExecution().executedPlan().toString()
    assert "wide" not in re.search(r"ReadSchema: (.*)", plan)[1] and "(part#" in re.search(r"PartitionFilters: (.*), PushedFilters", plan)[1]
    scan = probe._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert scan.metrics().apply("numFiles").value() == few.count() < 20  # the files that were opened


def test_parts_are_full(spark, tmp_path):
    rows = spark.range(1000).select("id", F.lit("x" * 10).alias("t"))
    parts.write_parts(rows, "id", F.octet_length("t"), str(tmp_path / "p"), 95)
    found = spark.read.parquet(str(tmp_path / "p" / "manifest"))
    assert found.count() == 112 and found.agg(F.max("bytes"), F.min("rows")).first()[0] == 90
    assert parts.read_range(spark, str(tmp_path / "p"), "id", 100, 120).count() == 21


def test_sheets(spark, tmp_path):
    from ledgerloom.sources import sheets

    path = str(tmp_path / "x")
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else f"t{i}" * (i % 9), bytes([i % 256]) if i % 2 else None, i / 7, "\x01" if i == 3 else "") for i in range(60)], "id long, t string, b binary, r double, u string")
    sheets.export_sheets(rows, "id", path, 50, 4)
    made = spark.read.parquet(f"{path}/manifest").orderBy("sheet").collect()
    assert all(m["pieces"] <= 50 for m in made) and all(a["last"] < b["first"] for a, b in zip(made, made[1:], strict=False)) and len(made) > 5
    assert sheets.sheet_problems(spark, path).count() == 0 and sheets.cell_problems(sheets.read_sheets(spark, path), rows, "id").count() == 0
    sheets.read_sheets(spark, path).where("sheet = 2").limit(1).withColumn("value", F.lit("y")).write.mode("append").partitionBy("sheet").parquet(f"{path}/sheets")
    assert [tuple(r) for r in sheets.sheet_problems(spark, path).collect()] == [(2, "content")]
    assert [r["type"] for r in spark.read.parquet(f"{path}/columns").orderBy("place").collect()] == ["bigint", "string", "binary", "double", "string"]


def test_file_sets(spark, tmp_path):
    from ledgerloom.sources import filetree

    where = tmp_path / "set"
    (where / "sub").mkdir(parents=True)
    for i in range(12):
        (where / ("sub" if i % 2 else ".") / f"f{i}.bin").write_bytes(bytes([i]) * (i * 7 + 1))
    first, read = filetree.refreshed(spark, str(where), None, 10)
    assert read == 12 and first.count() == sum(-(-(i * 7 + 1) // 10) for i in range(12))
    whole, part = filetree.token(filetree.files(first)), filetree.token(filetree.files(first).where("path like '%/sub/%'"))
    again, read = filetree.refreshed(spark, str(where), first, 10)
    assert read == 0 and filetree.token(filetree.files(again.repartition(3))) == whole != part
    (where / "f4.bin").write_bytes(b"\x04" * 28 + b"x")  # the same length
    (where / "sub" / "f3.bin").unlink()
    (where / "new.bin").write_bytes(b"z")
    now, read = filetree.refreshed(spark, str(where), first, 10)
    assert read == 2 and filetree.token(filetree.files(now)) != whole
    got = {(r["path"].rsplit("/", 1)[1], r["chunk"], r["problem"]) for r in filetree.file_problems(first, now).collect()}
    assert got == {("f3.bin", None, "missing"), ("new.bin", None, "unknown"), ("f4.bin", 2, "content")}
    assert filetree.token(filetree.files(now).where("path like '%/sub/%' and path not like '%f3.bin'")) == filetree.token(filetree.files(first).where("path like '%/sub/%' and path not like '%f3.bin'"))
    plan = filetree.listing(spark, str(where))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
