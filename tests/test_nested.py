import json

import pytest

from thermaline.operators.nested import composite_tables, curves_with_software, read_json, walk

SETTINGS = {"SystemSettings": {"softwareVersion": "XT 8.1"}}


def composite(log):
    return {"WITSMLComposite": {"wellSet": {"well": {"wellboreSet": {"wellbore": {"wellLogSet": {"wellLog": log}}}}}}}


def curves(spark, bodies):
    df = spark.createDataFrame([(i, b, "x") for i, b in enumerate(bodies)], "raw_id long, body string, row_id string")
    return sorted(tuple(r) for r in curves_with_software(df.select("raw_id", "body"), "raw_id", "body").collect())


@pytest.mark.parametrize(
    ("custom", "version"),
    [
        (SETTINGS, "XT 8.1"),
        (json.dumps(SETTINGS), "XT 8.1"),
        ({"SystemSettings": json.dumps(SETTINGS["SystemSettings"])}, "XT 8.1"),
        ([{"isDoubleEnded": "1"}, SETTINGS], "XT 8.1"),
        (json.dumps([{"isDoubleEnded": "1"}, SETTINGS]), "XT 8.1"),
        ({"SystemSettings:softwareVersion": "XT 8.1"}, "XT 8.1"),
        ({"SystemSettings": {"softwareVersion": '{"a": 1}'}}, '{"a": 1}'),
        ("{not JSON", ""),
        ("plain", ""),
        ({"SystemSettings": None}, ""),
        ({"softwareVersion": "0.0"}, ""),
        (None, ""),
    ],
)
def test_software_version_however_the_levels_are_written(spark, custom, version):
    body = json.dumps(composite({"customData": custom, "logCurveInfo": [{"mnemonic": "ST"}, "AST", {}, None]}))
    assert curves(spark, [body]) == [(0, 1, 1, 1, 1, "ST", version), (0, 1, 1, 1, 2, "AST", version)]


def test_positions_over_containers_and_bodies_that_are_none(spark):
    tree = {"WITSMLComposite": {"wellSet": [{"well": [{"name": "a"}, {"name": "b"}]}, {"well": {"name": "c", "wellboreSet": {"wellbore": {"wellLogSet": [{"wellLog": {"logCurveInfo": "X"}}, {"wellLog": {"logCurveInfo": {"unit": "m"}}}]}}}}]}}
    body = json.dumps(tree)
    bodies = ["﻿" + body, json.dumps(body), "", None, "{", "[1]", json.dumps({"other": 1}), body]
    rows = [(1, 1, "X"), (2, 1, "")]
    assert curves(spark, bodies) == [(i, 3, 1, log, no, m, "") for i in (0, 1, 7) for log, no, m in rows]
    df = spark.createDataFrame([(1, body), (1, body)], "raw_id long, body string")
    wells = composite_tables(df, "raw_id", "body")["wells"].orderBy("well_no").collect()
    assert [(r.well_no, r.name) for r in wells] == [(1, "a"), (2, "b"), (3, "c")]


def test_empty_table_and_very_deep_or_long_records(spark):
    assert curves(spark, []) == []
    assert read_json("[" * 200_000) is None
    long = json.dumps(composite({"customData": SETTINGS, "logCurveInfo": [{"mnemonic": f"c{k}"} for k in range(30_000)]}))
    found = curves(spark, [long])
    assert len(found) == 30_000 and found[0][4:] == (1, "c0", "XT 8.1")


def test_ordinals_and_scalars():
    got = list(walk({"a": [{"b": True}, {"b": [1.5, None, "x"]}], "c": {"#text": "t", "@u": 2}}))
    assert got == [("a", [1], None), ("a/b", [1, 1], "true"), ("a", [2], None), ("a/b", [2, 1], "1.5"), ("a/b", [2, 2], "x"), ("c", [1], "t"), ("c/@u", [1, 1], "2")]
