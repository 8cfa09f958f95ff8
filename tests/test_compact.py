import os
from decimal import Decimal

from thermaline.streaming.compact import RECORD, compact_table

LINE = "dts-01; {}; 2024-01-01T00:00:{:02d}Z; {}; 4,5;\n"


def deliver(spark, path, parts):
    for k, blobs in enumerate(parts):
        df = spark.createDataFrame(blobs, "blob_id long, body string").coalesce(1)
        df.write.mode("append").parquet(path)
        for f in os.listdir(path):  # in order of delivery
            if f.startswith("part-"):
                os.rename(f"{path}/{f}", f"{path}/delivery-{k}.parquet")


def files_of(df):
    return [f.removeprefix("file://") for f in df.inputFiles()]


def test_records_delivered_again_in_a_later_batch_are_written_once(spark, tmp_path):
    path = str(tmp_path / "small.parquet")
    one, two, three = (LINE.format(i, i, i + 0.5) for i in (1, 2, 3))
    deliver(spark, path, [[(5, one + two)], [(7, two + three)], [(3, three.replace(";", " ;") + "cut; 4;"), (9, one)]])
    table = compact_table(spark, path, "blob_id", "body", files_per_batch=1)
    files = files_of(table)
    assert len(files) == 1
    rows = spark.read.parquet(*files).collect()
    assert sorted((int(r.record_no), r.file_id, r.line_no) for r in rows) == [(1, 5, 1), (2, 5, 2), (3, 3, 1)]


def test_files_have_the_target_size_and_a_further_call_replaces_them(spark, tmp_path):
    path, out = str(tmp_path / "small.parquet"), str(tmp_path / "table")
    body = "".join(LINE.format(i, i % 60, i * 1.37) for i in range(20_000))
    deliver(spark, path, [[(1, body)], [(2, body)], [(3, body)]])
    for _ in range(2):
        table = compact_table(spark, path, "blob_id", "body", files_per_batch=1, out=out, file_bytes=60_000)
        sizes = [os.path.getsize(f) for f in files_of(table)]
        assert table.count() == table.select(*RECORD).distinct().count() == 20_000
        assert {r.file_id for r in table.select("file_id").distinct().collect()} == {1}
        assert len(sizes) > 1 and all(20_000 < s <= 80_000 for s in sizes), sizes
        assert all(f.startswith(out + "/") for f in files_of(table))


def test_a_table_without_records_gives_an_empty_one(spark, tmp_path):
    path = str(tmp_path / "small.parquet")
    deliver(spark, path, [[(1, None), (2, "no record")]])
    assert compact_table(spark, path, "blob_id", "body").count() == 0


def test_a_later_call_reads_only_what_came_since_and_an_interrupted_batch_is_replaced(spark, tmp_path):
    path, state = str(tmp_path / "small.parquet"), str(tmp_path / "state")
    one, two = (LINE.format(i, i, i + 0.5) for i in (1, 2))
    deliver(spark, path, [[(5, one)]])
    # what an attempt left that was lost before its batch was done
    spark.createDataFrame([("x", Decimal(1), 1, 1.0, 1.0, 1, 1)], "device string, record_no decimal(38,0), time_us long, st double, ast double, file_id long, line_no long").write.parquet(f"{state}/batches/batch=0")
    first = compact_table(spark, path, "blob_id", "body", state=state)
    assert [(r.file_id, r.line_no) for r in first.collect()] == [(5, 1)]
    spark.createDataFrame([(4, one + two)], "blob_id long, body string").coalesce(1).write.mode("append").parquet(path)
    second = compact_table(spark, path, "blob_id", "body", state=state)
    assert sorted((int(r.record_no), r.file_id, r.line_no) for r in second.collect()) == [(1, 4, 1), (2, 4, 2)]
    assert sorted(os.listdir(f"{state}/batches")) == ["batch=0", "batch=1"]
    assert spark.read.parquet(f"{state}/batches/batch=1").count() == 2


def test_which_lines_are_records_and_which_are_the_same(spark, tmp_path):
    good = [
        "d;1;2024-01-01T00:00:00Z;1,50;2;", " d ; 01 ;2024-01-01 00:00:00; 1.5 ;\t2.0;\r", "d;1;2024-01-01T01:00:00+01:00;15e-1;2.;", "d;1;2024-01-01T01:00:00.000+0100;+1.5;2;", "d;1;2023-12-31T23:00:00-01;1.5;2,;",
    ]
    bad = ["d;1;2024-01-01T00:00:00Z;1,5;2", "d;1;2024-01-01T00:00:00Z;1,5;;", ";1;2024-01-01T00:00:00Z;1;2;", "d;x;2024-01-01T00:00:00Z;1;2;", "d;1;2024-13-01T00:00:00Z;1;2;", "d;1;2024-01-01T00:00:00Z;NaN;2;", "d;1;2024-01-01T00:00:00Z;1f;2;", "d;1;2024-01-01;1;2;", "d;1;2024-01-01T00:00:00Z;1;2;3;", "", ";;;;;"]
    other = ["d;1;2024-01-01T00:00:00.5Z;-0,0;2;", "d;1;2024-01-01T00:00:00.500Z;0;2;"]
    path = str(tmp_path / "small.parquet")
    deliver(spark, path, [[(1, "\n".join(bad + good + other)), (2, None), (3, ""), (None, good[0])]])
    rows = sorted((r.file_id, r.line_no, r.st) for r in compact_table(spark, path, "blob_id", "body").collect())
    assert rows == [(1, len(bad) + 1, 1.5), (1, len(bad) + len(good) + 1, 0.0)]
