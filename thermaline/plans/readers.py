"""Round trips through the readers: the grid fixture is written as each vendor's text files, one a quarter, and read back.

The SQL is the grid itself, so a query is right only if every value, place and time survives. The grid is complete at sf0.01 and
above; at sf0.001 some quarters lack locations, and the readers refuse such files, as they must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermaline.operators.sections import sections_frame
from thermaline.plans.fibre import _GRID, GRID_SECTIONS, grid, quarter, r
from thermaline.session import table, work_dir
from thermaline.sources import external_series, load, read_apsensing, read_sensornet, read_silixa, read_traces, save
from thermaline.sources.xml import merge_traces

STAMP = "yyyy-MM-dd HH:mm:ss"


def _files(rows: DataFrame, line: Column, text, label: str) -> list[str]:
    """Writes one file for each time, from its lines in order of location; ``text`` makes the file of its time and its lines."""
    spark = rows.sparkSession
    each = rows.groupBy("time").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", line.alias("l")))), lambda s: s["l"]), "\n").alias("lines"))
    root = work_dir(spark, label)
    each.select(F.date_format("time", "yyyyMMdd").alias("day"), text(F.col("time"), F.col("lines")).alias("value")).write.partitionBy("day").text(root)
    return [f"{root}/day=*/part-*"]


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _numbers(*names: str) -> Column:
    return F.concat_ws(",", *[F.col(n).cast("string") for n in names])


def _silixa(spark, sf_dir):
    meas, _ = grid(spark, sf_dir)
    curves = "LAF,ST,AST,TMP"

    def text(time, lines):
        stamp = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        head = "<logs xmlns='http://n/1'><log><startDateTimeIndex>", stamp, "</startDateTimeIndex><endDateTimeIndex>", stamp, "</endDateTimeIndex><customData><isDoubleEnded>0</isDoubleEnded><forwardMeasurementChannel>1</forwardMeasurementChannel>"
        mid = f"<acquisitionTime>0</acquisitionTime><SystemSettings><softwareVersion>6.2</softwareVersion></SystemSettings></customData><logData><mnemonicList>{curves}</mnemonicList><unitList>m</unitList>"
        return _say(*head, mid, lines, "</logData></log></logs>")

    return read_silixa(spark, _files(meas, _say("<data>", _numbers("x", "st", "ast", "n"), "</data>"), text, "silixa-files"))


def _apsensing(spark, sf_dir):
    meas, _ = grid(spark, sf_dir)
    curves = "".join(f"<logCurveInfo><mnemonic>{c}</mnemonic></logCurveInfo>" for c in ("LAF", "TEMP", "ST", "AST"))

    def text(time, lines):
        return _say("<WITSMLComposite><wellSet><well><wellboreSet><wellbore><wellLogSet><wellLog><creationDate>", F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'"), f"</creationDate>{curves}<logData>", lines, "</logData></wellLog></wellLogSet></wellbore></wellboreSet></well></wellSet></WITSMLComposite>")

    return read_apsensing(spark, _files(meas, _say("<data>", _numbers("x", "n", "st", "ast"), "</data>"), text, "apsensing-files"), traces=None)


def _traces(spark, sf_dir):
    meas, series = grid(spark, sf_dir)
    rows = meas.join(series, "time").withColumn("tax", F.col("tax"))
    line = F.concat_ws(";", F.col("ix").cast("string"), F.col("x").cast("string"), F.col("n").cast("double").cast("string"), F.col("st").cast("string"), F.col("ast").cast("string"))

    def text(time, lines):
        part = lambda f: F.date_format(time, f).cast("int").cast("string")
        return _say("[General]\nChannelNumber;1\n\n[Trace]\nDualEnded;False\n\n[Trace.1]\n", lines, "\nRef.Temperature.Sensor.1;1.5\nDate.Year;", part("yyyy"), "\nDate.Month;", part("MM"), "\nDate.Day;", part("dd"), "\nTime.Hour;", part("HH"), "\nTime.Minute;", part("mm"), "\nTime.Second;", part("ss"), "\n")

    return read_traces(spark, _files(rows, line, text, "trace-files"))


def _sensornet(spark, sf_dir):
    meas, _ = grid(spark, sf_dir)
    line = F.translate(F.concat_ws("\t", *[F.col(c).cast("double").cast("string") for c in ("x", "n", "st", "ast")]), ".", ",")
    top = "unit:\tS\nmux:\tM\nmodel:\tH\nSoftware version number:\tORYX F/W v4.00 Oryx Data Collector v3.1\ndifferential loss correction\tsingle-ended\nforward channel\tchannel 1\nreverse channel\tN/A\nforward acquisition time\t0,0\nreverse acquisition time\t0,0\ngamma\t470,6\n"
    rest = "".join(f"field {k}\t{k}\n" for k in range(13))

    def text(time, lines):
        return _say(top, "date\t", F.date_format(time, "yyyy/MM/dd"), "\ntime\t", F.date_format(time, "HH:mm:ss"), "\n", rest, "length (m)\ttemperature\tStokes\tanti-Stokes\n", lines, "\n")

    return read_sensornet(spark, _files(meas, line, text, "sensornet-files"), internal=0.0, fiber_length=100.0)


_CELLS = "SELECT {ix} AS ix, x, CAST(quarter AS BIGINT) AS quarter, round(st, 6) AS st, round(ast, 6) AS ast, CAST(n AS DOUBLE) AS tmp FROM g"
#: Rank of a location among those of the file.
_RANK = "CAST(dense_rank() OVER (ORDER BY ix) - 1 AS INT)"


def _cells(meas: DataFrame) -> DataFrame:
    return meas.select("ix", "x", quarter(), r("st", 6), r("ast", 6), "tmp")


def source_silixa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(_silixa(spark, sf_dir).meas)


def source_apsensing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(_apsensing(spark, sf_dir).meas)


def source_sensornet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(_sensornet(spark, sf_dir).meas)


def source_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = _traces(spark, sf_dir)
    return rec.meas.select("ix", "x", quarter(), r("log_ratio_by_dts", 6, "st"), r("loss_by_dts", 6, "ast"), "tmp")


def source_merged_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements with the traces of the same time; files of both have no stamps in their names here, so times stand in."""
    xml, tra = _apsensing(spark, sf_dir), _traces(spark, sf_dir)
    for rec in (xml, tra):
        rec.series = rec.series.withColumn("filename_tstamp", F.date_format("time", "yyyyMMddHHmmss"))
    rec = merge_traces(xml, tra)
    probes = rec.series.select("time", "probe1Temperature")
    return rec.meas.join(probes, "time").select("ix", quarter(), r("st", 6), r("log_ratio_by_dts", 6), r("loss_by_dts", 6), "probe1Temperature")


def source_header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _silixa(spark, sf_dir).headers.filter("key LIKE 'customData:%' OR key LIKE 'logData:%'").select(quarter(), "key", "value")


def stored_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved with its sections and loaded again; each measurement with the section it lies in."""
    rec = _silixa(spark, sf_dir)
    out = work_dir(spark, "stored")
    save(rec, out, sections_frame(spark, GRID_SECTIONS))
    back, sections = load(spark, out)
    inside = back.meas.join(F.broadcast(sections), F.col("x").between(F.col("x_start"), F.col("x_stop")))
    return inside.select("section", "stretch_id", "x", quarter(), r("st", 6))


def source_csv_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a CSV series of wall times of Amsterdam, in which the hour of the clock change is none of theirs."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("t"), "value")
    out = work_dir(spark, "csv")
    wall = F.date_format(F.from_utc_timestamp("t", "Europe/Amsterdam"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    rows.select(wall.alias("time"), F.col("value").alias("Pt100 2"), F.col("event_id").cast("double").alias("id")).write.option("header", "true").csv(out)
    back = external_series(spark, out, "time", "Europe/Amsterdam", {"Pt100 2": "probe", "id": "event_id"})
    return back.select(F.col("event_id").cast("long").alias("event_id"), F.unix_micros("time").alias("us"), "probe")


def queries() -> dict:
    return {f.__name__: f for f in (source_silixa, source_apsensing, source_sensornet, source_traces, source_merged_traces, source_header_fields, stored_recording, source_csv_series)}


def oracle_sql() -> dict[str, str]:
    cells = f"WITH {_GRID} " + _CELLS.format(ix=_RANK)
    values = "('customData:isDoubleEnded', '0'), ('customData:forwardMeasurementChannel', '1'), ('customData:acquisitionTime', '0'), ('customData:SystemSettings:softwareVersion', '6.2'), ('logData:mnemonicList', 'LAF,ST,AST,TMP'), ('logData:unitList', 'm')"
    return {
        "source_silixa": cells, "source_apsensing": cells, "source_sensornet": cells + " QUALIFY x < 100", "source_traces": cells,
        "source_merged_traces": f"WITH {_GRID} SELECT {_RANK} AS ix, CAST(quarter AS BIGINT) AS quarter, round(st, 6) AS st, round(st, 6) AS log_ratio_by_dts, round(ast, 6) AS loss_by_dts, 1.5::DOUBLE AS probe1Temperature FROM g",
        "source_header_fields": f"WITH {_GRID} SELECT CAST(quarter AS BIGINT) AS quarter, key, value FROM s, (VALUES {values}) AS v(key, value)",
        "stored_recording": f"WITH {_GRID} SELECT section, stretch_id, x, CAST(quarter AS BIGINT) AS quarter, round(st, 6) AS st FROM m",
        "source_csv_series": "SELECT event_id, epoch_us(ts) AS us, value AS probe FROM events",
    }
