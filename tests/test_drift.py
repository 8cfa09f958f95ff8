import json

import pytest
from pyspark.sql import functions as F

from thermaline.operators.drift import drift_log, flatten, fold, header_fields, typed_columns, union_table


def facts(spark, files, extra=False):
    df = spark.createDataFrame([(s, q, h if h is None or isinstance(h, str) else json.dumps(h)) for s, q, h in files], "s long, q long, h string")
    if extra:
        df = df.withColumns({"stream": F.lit("x"), "field": F.lit(1), "seq": F.lit("y")})
    return header_fields(df, "s", "q", "h")


def log(spark, files, **kw):
    return sorted(tuple(r) for r in drift_log(facts(spark, files), **kw).collect())


def table(spark, files):
    return {(r.stream, r.seq): dict(r.fields) for r in union_table(facts(spark, files)).collect()}


def test_each_kind_of_change(spark):
    files = [
        (1, 10, {"a": 1, "old": "v", "gone": True, "t": 1, "n": None}),
        (1, 20, {"a": 1, "new": "v", "t": "1", "n": None}),
        (1, 40, {"a": 1, "new": "v", "t": None, "more": 5}),
        (1, 50, {"a": 1, "new": "v", "t": [1], "more": 5}),
    ]
    want = [(1, 20, "removed", "gone", ""), (1, 20, "renamed", "old", "new"), (1, 20, "type", "t", "t"), (1, 40, "added", "", "more"), (1, 40, "removed", "n", ""), (1, 50, "type", "t", "t")]
    assert log(spark, files) == want
    assert log(spark, files[::-1] + files, width=1) == want


def test_a_field_now_and_then_missing_is_no_change_and_streams_are_apart(spark):
    files = [(1, 1, {"a": 1, "b": 2}), (1, 2, {"a": 1}), (1, 3, {"a": 1, "b": 2}), (2, 1, {"z": 1}), (2, 2, {})]
    assert log(spark, files) == [(2, 2, "removed", "z", "")]


def test_renames_need_the_same_value_of_the_same_type_and_nulls_are_none(spark):
    files = [(1, 1, {"a": 1, "b": None, "c": 2, "d": 2}), (1, 2, {"a2": "1", "b2": None, "c2": 2.0, "d2": 2})]
    assert log(spark, files) == [(1, 2, "added", "", "a2"), (1, 2, "added", "", "b2"), (1, 2, "removed", "a", ""), (1, 2, "removed", "b", ""), (1, 2, "renamed", "c", "c2"), (1, 2, "renamed", "d", "d2")]


def test_names_are_paths_however_the_levels_are_joined():
    assert flatten({"a": {"b:c": 1, "d": {"e": [{"f": 1}]}}, "A": 2, "x": {}}) == {"a:b:c": 1, "a:d:e": [{"f": 1}], "A": 2}


def test_the_union_table_has_every_field_of_every_file_cast_to_its_type(spark):
    files = [(1, 1, {"a": True, "b": 1, "s": 1.5, "l": "x"}), (1, 2, {"a": 3, "s": "t", "l": ["y"]}), (1, 3, {}), (2, 1, {"q": None})]
    assert table(spark, files) == {
        (1, 1): {"a": "1", "b": "1", "l": '["x"]', "s": '"1.5"'},
        (1, 2): {"a": "3", "b": None, "l": '["y"]', "s": '"t"'},
        (1, 3): dict.fromkeys("abls"),
        (2, 1): {"q": None},
    }
    kinds = {r.field: r.kind for r in fold(facts(spark, files)).collect()}
    assert kinds == {"a": "number", "b": "number", "s": "string", "l": "array", "q": "null"}


@pytest.mark.parametrize(("types", "kind"), [(["null"], "null"), (["boolean", "null"], "boolean"), (["boolean", "number"], "number"), (["number", "string"], "string"), (["array", "string", "boolean"], "array")])
def test_the_lattice_is_a_chain(spark, types, kind):
    value = {"null": None, "boolean": True, "number": 1, "string": "s", "array": [1]}
    for order in (types, types[::-1]):
        got = fold(facts(spark, [(1, k, {"f": value[t]}) for k, t in enumerate(order)])).collect()
        assert [r.kind for r in got] == [kind]


def test_typed_columns(spark):
    files = [(1, 1, {"a": True, "s": "x"}), (1, 2, {"a": 2.5})]
    rows = typed_columns(union_table(facts(spark, files)), {"a": "double", "s": "string", "none": "int"}).orderBy("seq").collect()
    assert [(r.a, r.s, r.none) for r in rows] == [(1.0, "x", None), (2.5, None, None)]


def test_unreadable_null_and_repeated_files_extra_columns_and_an_empty_table(spark):
    files = [(1, 1, {"a": 1}), (1, 1, {"a": 1}), (1, 2, "{broken"), (1, 3, None), (None, 4, {"b": 1}), (1, None, {"b": 1}), (1, 5, "[1]"), (1, 6, "")]
    assert log(spark, files) == []
    assert {(r.stream, r.seq) for r in facts(spark, files, extra=True).collect()} == {(1, 1)}
    assert log(spark, []) == [] and table(spark, []) == {}
