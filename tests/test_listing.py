"""Captures below folders, their sidecars and what is recorded of them."""

import json

import pytest
from pyspark.sql import functions as F

from wavemill.sources import listing


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("listing")
    for name, size in (("one.bin", 5), ("two.dat", 7), ("notes.txt", 1), ("day 1/a+b%20.bin", 9), ("day 1/deep/er/x.bin", 1), ("one_cv_annotated/frame.bin", 3), ("one_cv_annotated/more/y.dat", 3), ("other_cv/z.bin", 2), ("day 1/one_x/kept.bin", 4)):
        (d / name).parent.mkdir(parents=True, exist_ok=True)
        (d / name).write_bytes(b"x" * size)
    (d / "one_meta.json").write_text(json.dumps({"room": 12, "scenario": " sitting ", "presence": "occupied", "subject": "", "distance_m": 2.5}))
    (d / "two_meta.json").write_text("not json")
    (d / "day 1" / "a+b%20_meta.json").write_text(json.dumps({"presence": "nobody", "facing": None, "activity": "walk"}))
    (d / "two_cv.json").write_text(json.dumps({"summary": {"fraction_occupied": 0.25}}, indent=1))
    (d / "one_cv.json").write_text(json.dumps({"summary": {}}))
    return d


WANT = {"one.bin": 5, "two.dat": 7, "day 1/a+b%20.bin": 9, "day 1/deep/er/x.bin": 1, "other_cv/z.bin": 2, "day 1/one_x/kept.bin": 4}


def test_captures(spark, folder):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.lists.link./in", f"file://{folder}")
    for root in (str(folder), f"file://{folder}/", "viewfs://lists/in"):
        got = {r["filename"]: r for r in listing.list_captures(spark, root).collect()}
        assert {k: r["size_bytes"] for k, r in got.items()} == WANT
        assert got["day 1/a+b%20.bin"]["stem"] == "a+b%20" and got["day 1/deep/er/x.bin"]["capture"] == "day 1/deep/er/x"
        assert {r["capture"] for r in listing.sidecars(spark, root, "_meta.json").collect()} == {"one", "two", "day 1/a+b%20"}
    assert {r["filename"] for r in listing.list_captures(spark, str(folder), 1).collect()} == {k for k in WANT if k.count("/") < 2}


def test_bytes_are_not_read(spark, folder):
    plan = listing.list_captures(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "content" not in plan


def test_conditions(spark, folder):
    captures = listing.list_captures(spark, str(folder))
    table = spark.createDataFrame([("x", "env2", 3, "vacuum + still", "1"), ("kept", "env1", 1, "new", None)], "stem string, env string, session int, cond string, y string")
    got = {r["filename"]: r for r in listing.conditions(captures, listing.sidecars(spark, str(folder), "_meta.json"), listing.sidecars(spark, str(folder), "_cv.json"), table).collect()}
    assert got.keys() == WANT.keys()
    one, two, odd, x, kept = (got[k] for k in ("one.bin", "two.dat", "day 1/a+b%20.bin", "day 1/deep/er/x.bin", "day 1/one_x/kept.bin"))
    assert (one.room, one.scenario, one.subject, one.distance_m, one.recorded, one.recorded_source) == ("12", " sitting ", None, "2.5", "sitting", "operator, at capture time")
    assert (one.gt, one.gt_source, one.presence, one.camera_occupancy, one.occupancy) == ("person", "operator", "occupied", None, None)
    assert (two.scenario, two.camera_occupancy, two.occupancy, two.recorded, two.gt, two.room) == ("partial", 0.25, 0.25, None, None, None)
    assert (odd.presence, odd.gt, odd.activity, odd.facing) == (None, None, "walk", None)
    assert (x.recorded, x.recorded_source, x.gt, x.gt_source) == ("still (breathing) + robot vacuum", "GT table env2, session 3", "person", "GT table env2")
    assert (kept.recorded, kept.gt) == ("new", None)


def test_repeats_and_empty_tables(spark, folder):
    captures = listing.list_captures(spark, str(folder))
    none = spark.createDataFrame([], "capture string, text string")
    table = spark.createDataFrame([], "stem string, env string, session int, cond string, y string")
    rows = listing.conditions(captures, none, none, table).collect()
    assert len(rows) == len(WANT) and all(r["gt"] is None and r["scenario"] is None for r in rows)
    twice = spark.createDataFrame([("one", '{"room": "b"}'), ("one", '{"room": "a"}'), ("one", None), (None, "{}")], "capture string, text string")
    rows = listing.conditions(captures, twice, none, table).collect()
    assert len(rows) == len(WANT) and {r["room"] for r in rows if r["filename"] == "one.bin"} == {"a"}
    assert listing.conditions(captures.limit(0), twice, none, table).collect() == []
    words = spark.createDataFrame([("empty",), ("rot fan + small",), ("cat",), (None,)], "c string").select(listing.in_words(F.col("c"))).collect()
    assert [r[0] for r in words] == ["empty room", "small move + rotating fan", "cat", None]
