"""Requests and the plans that they must give."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shutterlake import catalog
from shutterlake.operators import analyzer, places, search

NOW = datetime(2026, 9, 15, 12)
CASES = {
    "海边的狗": dict(positive=["海边的狗"]),
    "a whiteboard with diagrams in a meeting room": dict(positive=["a whiteboard with diagrams in a meeting room"]),
    "帮我找猫": dict(positive=["猫"]),
    "找一张发票": dict(positive=["发票"], count=1),
    "猫的照片": dict(positive=["猫"]),
    "狗和沙滩": dict(positive=["狗", "沙滩"], combine="and"),
    "发票还有登机牌": dict(positive=["发票", "登机牌"]),
    "dog and beach": dict(positive=["dog", "beach"], combine="and"),
    "狗或猫": dict(positive=["狗", "猫"], combine="or"),
    "cat or dog": dict(positive=["cat", "dog"], combine="or"),
    "不要发票": dict(positive=[], negative=["发票"]),
    "海边的狗不要其他人": dict(positive=["海边的狗"], negative=["其他人"]),
    "没有人的照片": dict(positive=[], negative=["人"]),
    "a beach without people": dict(positive=["a beach"], negative=["people"]),
    '"发票" 截图': dict(terms=["发票"], media="screenshot", positive=[]),
    '含 "Invoice #12345" 的照片': dict(terms=["Invoice #12345"]),
    "去年的猫": dict(positive=["猫"], date_start=datetime(2025, 1, 1), date_end=datetime(2026, 1, 1)),
    "上个月的照片": dict(positive=[], date_start=datetime(2026, 8, 1), date_end=datetime(2026, 9, 1)),
    "2023年5月的狗": dict(positive=["狗"], date_start=datetime(2023, 5, 1), date_end=datetime(2023, 6, 1)),
    "2023-05-06 cat": dict(positive=["cat"], date_start=datetime(2023, 5, 6), date_end=datetime(2023, 5, 7)),
    "2024": dict(positive=[], date_start=datetime(2024, 1, 1), date_end=datetime(2025, 1, 1)),
    "3024": dict(positive=["3024"], date_start=None),
    "2023-13-01": dict(date_start=None),
    "find me favorite videos past week": dict(media="video", favorite=True, positive=[], date_end=NOW),
    "收藏的照片": dict(media="image", favorite=True, positive=[]),
    "dogs in Tokyo": dict(positive=["dogs"], place="Tokyo"),
    "在北京拍的猫": dict(positive=["猫"], place="北京"),
    "cat in the box": dict(positive=["cat in the box"], place=None),
    "phone": dict(positive=["phone"], count=None),
    "ＣＡＴ": dict(positive=["CAT"]),
    "": dict(positive=[], empty=True),
    "找照片": dict(positive=[], empty=True),
}


@pytest.fixture(scope="module")
def plans(spark):
    rows = [(t, t) for t in CASES] + [(None, None)]
    return {r.request_id: r.asDict() for r in analyzer.analyse(spark.createDataFrame(rows, "request_id string, text string"), NOW).collect()}


@pytest.mark.parametrize("said", CASES)
def test_plan(plans, said):
    assert {k: plans[said][k] for k in CASES[said]} == CASES[said]


STRICT = {
    '猫 " 和 狗': ([], "and", ['猫 "', "狗"], []),
    "it's 'a b": (["s"], "and", ["ita b"], []),
    "it's \"x\" isn't": (['s "x" isn'], "and", ["itt"], []),
    "“a” \"b” c 'd'": (["a", "b", "d"], "and", ["c"], []),
    '"" cat': ([], "and", ["cat"], []),
    "rock And roll and jazz": ([], "and", ["rock And roll", "jazz"], []),
    "cats or dogs and birds": ([], "or", ["cats", "dogs and birds"], []),
    "不要A不要B": ([], "and", [], ["A", "B"]),
    "notebook with no lines not a pen": ([], "and", ["notebook with"], ["lines", "pen"]),
    "not an apple": ([], "and", [], ["apple"]),
    "猫没有狗和鸟": ([], "and", ["猫", "鸟"], ["狗"]),
    "note1 nox no": ([], "and", ["note1 nox"], []),
    "发票还有登机牌": ([], "and", ["发票", "登机牌"], []),
}


def test_strict_reading(spark):
    rows = analyzer.analyse(spark.createDataFrame([(t, t) for t in STRICT], "request_id string, text string"), NOW, strict=True).collect()
    assert {r.request_id: (r.terms, r.combine, r.positive, r.negative) for r in rows} == STRICT


def test_missing_text(plans):
    assert plans[None]["empty"]


def test_ask(spark):
    encoder = search.ConceptEncoder(["cat", "dog", "beach"])
    rows = [(1, "cat", 35.6, 139.6), (2, "cat", 0.0, 0.0), (3, "dog", 35.6, 139.6), (4, "cat dog", 35.7, 139.7)]
    df = spark.createDataFrame([(i, t, encoder.encode(t), la, lo, datetime(2026, 9, 14), 1, False) for i, t, la, lo in rows], "asset_id long, text string, vector array<double>, latitude double, longitude double, created timestamp, media_type int, favorite boolean")
    df = df.withColumn("created", F.col("created").cast("timestamp_ntz"))
    ids = lambda text: [r.asset_id for r in analyzer.ask(df, text, encoder, NOW).collect()]
    assert ids("cat in Tokyo") == [1, 4]
    assert ids("cat without dog") == [1, 2]
    assert ids('"dog" yesterday') == [4, 3]
    assert ids("") == []


def test_implied_places(spark):
    said = [(1, "Tokyo sunset"), (2, "a cat in Paris"), (3, "北京 猫"), (4, "海边"), (5, "Kyoto"), (6, "dogs and Rome and Paris")]
    plans = analyzer.analyse(spark.createDataFrame(said, "request_id int, text string"), datetime(2024, 6, 15))
    got = {r.request_id: (r.implied, r.positive, r.place) for r in analyzer.implied_places(plans, places.gazetteer(spark)).collect()}
    assert got[1] == ("Tokyo", ["sunset"], None)
    assert got[2][0] is None and got[2][2] == "Paris"
    assert got[3] == ("Beijing", ["猫"], None) and got[4] == (None, ["海边"], None)
    assert got[5] == ("Kyoto", [], None) and got[6] == ("Rome", ["dogs", "Paris"], None)


def test_implied_places_with_long_names(spark, tmp_path):
    said = [(1, "San Francisco sunset"), (2, "lights of Bangkok city"), (3, "rome or Rio de Janeiro"), (4, "cats in  athens")]
    plans = spark.createDataFrame([(i, [t], None, "and") for i, t in said], "request_id int, positive array<string>, place string, combine string")
    got = {r.request_id: (r.implied, r.positive) for r in analyzer.implied_places(plans, places.gazetteer(spark)).collect()}
    assert got == {1: ("San Francisco", ["sunset"]), 2: ("Bangkok", ["lights of"]), 3: ("Rio de Janeiro", ["rome or"]), 4: ("Athens", ["cats in"])}
    spark.createDataFrame([(i, 0, t) for i, t in said], "conv_id int, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    rows = {r.request_id: (r.place, r.at, r.length) for r in catalog.queries()["implied_places"](spark, str(tmp_path)).collect()}
    assert rows == {"1:0": ("San Francisco", 1, 13), "2:0": ("Bangkok", 11, 12), "3:0": ("Rio de Janeiro", 9, 14), "4:0": ("Athens", 8, 8)}


def test_diagnostics(spark):
    schema = "asset_id long, created timestamp, media_type int, favorite boolean, latitude double, longitude double, text string, vector array<double>"
    rows = [(1, NOW, 1, True, -17.7, 178.0, None, [1.0, 0.0]), (2, NOW, 2, False, None, None, "x", None), (3, NOW, 1, False, 48.85, 2.35, None, [0.0, 1.0])]
    df, encoder = spark.createDataFrame(rows, schema), search.ConceptEncoder(["cat"])
    told = lambda text: analyzer.explain(df, text, encoder, NOW).first()
    got = told("cat in Fiji")
    assert (got.candidate_count, got.scored_count, got.used_vectors, got.clauses, got.unresolved) == (1, 1, True, ["cat"], None) and "Fiji" in got.warnings[0]
    got = told("cat in Atlantis")
    assert got.unresolved == "Atlantis" and len(got.warnings) == 1 and (got.candidate_count, got.scored_count) == (2, 2)
    got = told("")
    assert (got.candidate_count, got.scored_count, got.used_vectors) == (0, 0, False) and len(got.warnings) == 1
    got = told("favorite photos")
    assert (got.candidate_count, got.scored_count, got.used_vectors, got.warnings) == (1, 0, False, [])
