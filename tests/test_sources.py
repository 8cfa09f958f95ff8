"""Readers on hand-made miniatures of each format."""

import struct
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from thermaline.operators.sections import sections_frame
from thermaline.sources import external_series, load, read_apsensing, read_sensornet, read_sensortran, read_silixa, read_traces, save, time_columns
from thermaline.sources.store import default_encoding, described, writer_options
from thermaline.sources.text import sniffed, trimmed
from thermaline.sources.xml import flatten, tree


def silixa(version, minute, rows, double=True, root="logs"):
    names = "LAF,ST,AST,REV-ST,REV-AST,TMP" if double else "LAF,ST,AST,TMP"
    data = "".join(f"<data>\n{','.join(map(str, r))}\n</data>" for r in rows)
    channels = "".join(f"<ChannelConfiguration><AcquisitionConfiguration><AcquisitionTime><userAcquisitionTimeFW>{10 + k}</userAcquisitionTimeFW><userAcquisitionTimeBW>{20 + k}</userAcquisitionTimeBW></AcquisitionTime></AcquisitionConfiguration></ChannelConfiguration>" for k in range(4))
    start, stop = f"2018-05-04T12:{minute:02d}:00.500Z", f"2018-05-04T12:{minute:02d}:30.500Z"
    body = (
        f"<startDateTimeIndex>{start}</startDateTimeIndex><endDateTimeIndex>{stop}</endDateTimeIndex><customData><isDoubleEnded>{int(double)}</isDoubleEnded>"
        f"<forwardMeasurementChannel>1</forwardMeasurementChannel><reverseMeasurementChannel>3</reverseMeasurementChannel><acquisitionTime>2.0</acquisitionTime><referenceTemperature uom=\"C\">21.5</referenceTemperature>"
        f"<probe1Temperature>18.25</probe1Temperature><SystemSettings><softwareVersion>{version}</softwareVersion></SystemSettings><UserConfiguration>{channels}</UserConfiguration></customData>"
    )
    curves = "".join(f"<logCurveInfo><mnemonic>{n}</mnemonic></logCurveInfo>" for n in names.split(","))
    if root == "wellLogs":
        body = body.replace("endDateTimeIndex", "maxDateTimeIndex").replace("startDateTimeIndex", "minDateTimeIndex")
        return f'<?xml version="1.0"?><wellLogs xmlns="http://x/y"><wellLog uid="w">{body}{curves}<logData>{data}</logData></wellLog></wellLogs>'
    return f'<?xml version="1.0"?><logs xmlns="http://x/y"><log uid="w">{body}<logData><mnemonicList>{names}</mnemonicList><unitList>m</unitList>{data}</logData></log></logs>'


ROWS = [[-0.5, 10.5, 5.25, 9.5, 4.5, 20.0], [0.0, 11.5, 6.25, 10.5, 5.5, 21.0], [0.5, 12.5, 7.25, 11.5, 6.5, 22.0]]


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())


@pytest.mark.parametrize(("version", "name", "stamp", "root"), [("6.2.0", "channel_1_20180504{:02d}000000000.xml", "201805040{}000000000", "logs"), ("ULT 8.0.1", "a_2018-05-04_x_20180504.120{}30.500.xml", None, "logs"), ("4.1", "channel_1_201805041200{:02d}.xml", None, "wellLogs")])
def test_silixa_versions(spark, tmp_path, version, name, stamp, root):
    for m in (1, 0, 2):
        put(tmp_path / "day", name.format(m), silixa(version, m, [[r[0], *[v + m for v in r[1:]]] for r in ROWS], root=root))
    rec = read_silixa(spark, str(tmp_path))
    rows = rec.meas.orderBy("time", "ix").collect()
    assert len(rows) == 9 and set(rec.meas.columns) == {"ix", "x", "time", "st", "ast", "rst", "rast", "tmp"} and rec.double_ended
    assert [(r.ix, r.x, r.st, r.rast) for r in rows[3:6]] == [(k, ROWS[k][0], ROWS[k][1] + 1, ROWS[k][4] + 1) for k in range(3)]
    s = rec.series.orderBy("time").first()
    assert s.time == datetime(2018, 5, 4, 12, 0, 30, 500000) and s.timestart == datetime(2018, 5, 4, 12, 0, 20, 500000) and s.timeend == datetime(2018, 5, 4, 12, 0, 52, 500000)
    assert (s.userAcquisitionTimeFW, s.userAcquisitionTimeBW, s.probe1Temperature, s.referenceTemperature) == (10.0, 22.0, 18.25, 21.5)
    if version == "6.2.0":
        assert s.filename_tstamp == "20180504" + "00000000000"[:9] or s.filename_tstamp.isdigit()
    meta = {r.key: r.value for r in rec.meta.collect()}
    assert meta["customData:SystemSettings:softwareVersion"] == version and meta["customData:referenceTemperature:uom"] == "C"
    assert meta["customData:UserConfiguration:ChannelConfiguration_2:AcquisitionConfiguration:AcquisitionTime:userAcquisitionTimeFW"] == "12"


def test_silixa_single_ended_archive_and_errors(spark, tmp_path):
    rows = [[r[0], r[1], r[2], r[5]] for r in ROWS]
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        for m in (0, 1):
            z.writestr(f"f/channel_1_201805041200{m:02d}00000.xml", silixa("7.0", m, rows, double=False))
        z.writestr("_skip.xml", "no")
        z.writestr("f/readme.txt", "no")
    rec = read_silixa(spark, str(tmp_path / "all.zip"), zone="Europe/Amsterdam")
    assert rec.meas.count() == 6 and not rec.double_ended and set(rec.meas.columns) == {"ix", "x", "time", "st", "ast", "tmp"}
    assert rec.series.orderBy("time").first().time == datetime(2018, 5, 4, 14, 0, 25, 500000)
    with pytest.raises(FileNotFoundError):
        read_silixa(spark, str(tmp_path / "none*"[:-1]) if (tmp_path / "none").mkdir() else str(tmp_path / "none"))
    put(tmp_path / "bad", "a.xml", silixa("6", 0, ROWS))
    put(tmp_path / "bad", "b.xml", silixa("6", 1, ROWS[:2]))
    with pytest.raises(ValueError, match="between 2 and 3 locations"):
        read_silixa(spark, str(tmp_path / "bad"))
    put(tmp_path / "new", "a.xml", silixa("9.1", 0, ROWS))
    with pytest.raises(ValueError, match="software version 9.1"):
        read_silixa(spark, str(tmp_path / "new"))
    put(tmp_path / "odd", "a.xml", silixa("6", 0, ROWS).replace("TMP<", "XYZ<"))
    with pytest.raises(ValueError, match="unknown data column XYZ"):
        read_silixa(spark, str(tmp_path / "odd"))


def apsensing(second, rows):
    data = "".join(f"<data>{','.join(map(str, r))}</data>" for r in rows)
    curves = "".join(f"<logCurveInfo><mnemonic>{n}</mnemonic></logCurveInfo>" for n in ("LAF", "TEMP", "ST", "AST"))
    log = f"<wellLog><creationDate>2024-01-30T14:18:{second:02d}.000Z</creationDate>{curves}<logData>{data}</logData></wellLog>"
    return f'﻿<WITSMLComposite xmlns="http://w"><wellSet><well><wellboreSet><wellbore><dtsInstalledSystemSet><dtsInstalledSystem uid="N4386B-DE1"/></dtsInstalledSystemSet><wellLogSet>{log}</wellLogSet></wellbore></wellboreSet></well></wellSet></WITSMLComposite>'


AP = [[0.0, 20.5, 100.0, 50.0], [0.25, 21.5, 101.0, 51.0], [0.5, 22.5, 102.0, 52.0]]


def tra(second, rows, probe=19.5):
    trace = "\n".join(f"{k};{r[0]};{r[1]};{-7.0 - k};{0.1 * k}" for k, r in enumerate(rows))
    return f"\n[General]\nChannelNumber;1\nSoftwareVersion; V4.1\n\n[Trace]\nDualEnded;False\nPoints;{len(rows)}\n\n[Trace.3]\n{trace}\nRef.Temperature.Sensor.1;{probe}\nDate.Year;2024\nDate.Month;1\nDate.Day;30\nTime.Hour;14\nTime.Minute;18\nTime.Second;{second}\n"


def test_apsensing_with_and_without_traces(spark, tmp_path):
    for s in (20, 50):
        put(tmp_path, f"C1_m202401301418{s}.xml", apsensing(s, AP))
    with pytest.warns(UserWarning, match="no trace files"):
        assert read_apsensing(spark, str(tmp_path)).meas.count() == 6
    put(tmp_path, "C1_m20240130141820.tra", tra(20, AP))
    with pytest.raises(ValueError, match="without a trace file: 20240130141850"):
        read_apsensing(spark, str(tmp_path))
    put(tmp_path, "C1_m20240130141850.tra", tra(50, AP, 20.25))
    rec = read_apsensing(spark, str(tmp_path))
    row = rec.meas.orderBy("time", "ix").collect()[4]
    assert (row.ix, row.x, row.tmp, row.st, row.ast, row.log_ratio_by_dts, row.loss_by_dts, row.time) == (1, 0.25, 21.5, 101.0, 51.0, -8.0, 0.1, datetime(2024, 1, 30, 14, 18, 50))
    assert [r.probe1Temperature for r in rec.series.orderBy("time").collect()] == [19.5, 20.25]
    assert set(read_apsensing(spark, str(tmp_path), trace_arrays=False).meas.columns) == {"ix", "x", "time", "tmp", "st", "ast"}
    assert read_apsensing(spark, str(tmp_path), traces=None).series.columns == ["time", "filename_tstamp", "filename"]
    put(tmp_path, "C1_m20240130141850.tra", tra(50, [[r[0], r[1] + 1, *r[2:]] for r in AP]))
    with pytest.raises(ValueError, match="different temperatures"):
        read_apsensing(spark, str(tmp_path))
    put(tmp_path, "C1_m20240130141850.tra", tra(51, AP))
    with pytest.raises(ValueError, match="different times"):
        read_apsensing(spark, str(tmp_path))
    put(tmp_path, "C1_m20240130141859.tra", tra(59, AP))
    with pytest.raises(ValueError, match="without a measurement: 20240130141859"):
        read_apsensing(spark, str(tmp_path))


def test_traces_alone(spark, tmp_path):
    put(tmp_path, "C1_m20240130141820.tra", tra(20, AP))
    rec = read_traces(spark, str(tmp_path), "Europe/Berlin")
    assert rec.meas.count() == 3 and rec.series.first().time == datetime(2024, 1, 30, 15, 18, 20)
    assert {r.key: r.value for r in rec.meta.collect()}["General:SoftwareVersion"] == " V4.1"
    assert [sniffed(t) for t in ("True", "False", "12", "-1.5", "V4", "")] == [True, False, 12, -1.5, "V4", ""]


def ddf(rows, version="ORYX F/W v4.00 Oryx Data Collector v3.1", double=True, clock="00:00:10", end="3,0"):
    head = [f"DTS Sentinel unit serial number:\tS1", "Multiplexer serial number:\tM", "Hardware model number:\tH", f"Software version number:\t{version}"]
    fields = {
        "data status": "ok", "installation": "in", "differential loss correction": "combined" if double else "single-ended", "forward channel": "channel 1", "reverse channel": "channel 2" if double else "N/A", "forward acquisition time": "15,0",
        "reverse acquisition time": "16,0", "gamma": "470,6", "k internal": "0,1", "k external": "0,2", "T internal ref (°C)": "23,5", "T ext. ref 1 (°C)": "20,25", "T ext. ref 2 (°C)": "21,5", "default loss term (dB/km)": "0,3",
        "date": "2020/09/20", "time": clock, "software": "v", "fibre end": end, "a": "1", "b": "2", "c": "3",
    }
    lines = head + [f"{k}\t{v}" for k, v in fields.items()] + ["length (m)\ttemperature (°C)\tStokes\tanti-Stokes"]
    assert len(lines) == 26
    return "\n".join(lines + ["\t".join(str(v).replace(".", ",") for v in r) for r in rows] + [""]).encode("windows-1252")


def fibre(double):
    return [[float(x), 20.0 + x, 100.0 + x, 50.0 + x, *([200.0 + x, 150.0 + x] if double else [])] for x in range(-3, 8)]


def test_sensornet_single_ended(spark, tmp_path):
    for k, clock in enumerate(("00:00:40", "00:00:10")):
        put(tmp_path / f"m{k}", f"fibre 1 20200920 0000{clock[-2:]} 00002.ddf", ddf(fibre(False), double=False, clock=clock))
    rec = read_sensornet(spark, str(tmp_path), zone_files="Europe/Amsterdam", internal=2.0)
    rows = rec.meas.orderBy("time", "ix").collect()
    assert [(r.ix, r.x, r.st) for r in rows[:9]] == [(k, float(x), 100.0 + x) for k, x in enumerate(range(-2, 7))] and len(rows) == 18
    s = rec.series.orderBy("time").first()
    assert s.timeend == datetime(2020, 9, 19, 22, 0, 10) and s.time == datetime(2020, 9, 19, 22, 0, 2, 500000)
    assert (s.probe1Temperature, s.probe2Temperature, s.referenceTemperature, s.gamma_ddf, s.userAcquisitionTimeFW) == (20.25, 21.5, 23.5, 470.6, 15.0)
    put(tmp_path / "m3", "fibre 2 20200920 000050 00002.ddf", ddf(fibre(False), double=False))
    with pytest.raises(ValueError, match="several channels"):
        read_sensornet(spark, str(tmp_path))


@pytest.mark.parametrize(("version", "back"), [("ORYX F/W v4.00 Oryx Data Collector v3.1", lambda x: 200.0 + x), ("Halo DTS v1.0", lambda x: 200.0 + (3 - x))])
def test_sensornet_double_ended(spark, tmp_path, version, back):
    put(tmp_path, "fibre 1 20200920 000010 00002.ddf", ddf(fibre(True), version, end="3,0"))
    rec = read_sensornet(spark, str(tmp_path), internal=2.0, fiber_length=3.0)
    rows = rec.meas.orderBy("ix").collect()
    assert [(r.ix, r.x, r.st, r.rst) for r in rows] == [(k, float(x), 100.0 + x, back(x)) for k, x in enumerate(range(-2, 5))]
    assert rec.series.first().time == datetime(2020, 9, 20, 0, 0, 10)


def test_sensornet_errors(spark, tmp_path):
    put(tmp_path / "a", "x.ddf", ddf(fibre(True)).replace(b"combined", b"other"))
    with pytest.raises(ValueError, match="unknown differential loss correction"):
        read_sensornet(spark, str(tmp_path / "a"))
    put(tmp_path / "b", "x.ddf", ddf(fibre(True)).replace(b"Software version number", b"Software number"))
    with pytest.raises(ValueError, match="no software version"):
        read_sensornet(spark, str(tmp_path / "b"))
    put(tmp_path / "c", "x.ddf", ddf(fibre(False), "New v9", double=False))
    with pytest.warns(UserWarning, match="has not been tested"):
        read_sensornet(spark, str(tmp_path / "c"))
    with pytest.raises(ValueError, match="not positive"):
        trimmed([0.0, 1.0], 50.0, None, True, False, 1.0)


def dat(survey, n, a, b, version=3, epoch=1_600_000_000):
    head = struct.pack("<hh7ifi128sii", survey, version, 0, 3 if survey else 0, n, 10, 2, 1, 0, 295.15, epoch, "probe".encode("utf-16-le"), 180, 7)
    kind = "<%df" if survey == 0 else "<%di"
    return head + struct.pack(kind % n, *a) + struct.pack(kind % n, *b)


def test_sensortran(spark, tmp_path):
    for k in (1, 0):
        put(tmp_path, f"r{k}_BinaryRawDTS.dat", dat(2, 9, range(100 * k, 100 * k + 9), range(50, 59), epoch=1_600_000_000 + k))
        put(tmp_path, f"r{k}_BinaryTemp.dat", dat(0, 4, [0.0, 0.5, 1.0, 1.5], [290.0 + k] * 4, epoch=1_600_000_000 + k))
    rec = read_sensortran(spark, str(tmp_path))
    rows = rec.meas.orderBy("time", "ix").collect()
    assert [(r.ix, r.x, r.st, r.ast, r.tmp) for r in rows[4:]] == [(k, k / 2, 100 + k, 50 + k, 291.0) for k in range(4)]
    s = rec.series.orderBy("time").collect()[1]
    assert s.time == datetime(2020, 9, 13, 12, 26, 41) and s.st_zero == 107.0 and s.ast_zero == 57.0 and abs(s.referenceTemperature - 22.0) < 1e-4
    meta = {r.key: r.value for r in rec.meta.collect()}
    assert (meta["probe_name"], meta["x_units"], meta["y_units"], meta["forwardMeasurementChannel"]) == ("probe", "m", "counts", "1")
    put(tmp_path, "r2_BinaryRawDTS.dat", dat(2, 9, range(9), range(9)))
    with pytest.raises(FileNotFoundError, match="r2_BinaryRawDTS.dat has no"):
        read_sensortran(spark, str(tmp_path))
    put(tmp_path / "old", "r_BinaryRawDTS.dat", dat(2, 1, [1], [1], version=2))
    with pytest.raises(ValueError, match="header version 2"):
        read_sensortran(spark, str(tmp_path / "old"))


def test_times_across_a_clock_change_and_csv_series(spark, tmp_path):
    row = spark.createDataFrame([(datetime(2024, 3, 31, 1, 0, 10), 31.0, 20.0)], "stop timestamp, f double, b double")
    t = row.select(*[c.alias(k) for k, c in time_columns(F.col("stop"), F.col("f"), F.col("b"), "Europe/Amsterdam").items()]).first()
    assert (t.timestart, t.time, t.timeBW) == (datetime(2024, 3, 31, 1, 59, 39), datetime(2024, 3, 31, 3, 0, 10), datetime(2024, 3, 31, 3, 0, 20))
    put(tmp_path, "p.csv", '"time","Pt100 2"\n2018-03-28 02:00:05,12.7\n2018-03-28 02:00:10,\n')
    rows = external_series(spark, str(tmp_path / "p.csv"), "time", "Europe/Amsterdam", {"Pt100 2": "probe"}).orderBy("time").collect()
    assert [(r.time, r.probe) for r in rows] == [(datetime(2018, 3, 28, 0, 0, 5), 12.7), (datetime(2018, 3, 28, 0, 0, 10), None)]


def test_recordings_and_sections_survive_storage(spark, tmp_path):
    for s in (20, 50):
        put(tmp_path / "in", f"C1_m202401301418{s}.xml", apsensing(s, AP))
    rec = read_apsensing(spark, str(tmp_path / "in"), traces=None)
    sections = {"cold": [(0.0, 0.25), (0.5, 0.5)], "warm": [(0.3, 0.4)]}
    out = str(tmp_path / "out")
    for _ in range(2):
        save(rec, out, sections_frame(spark, sections), default_encoding(rec.meas))
    back, secs = load(spark, out)
    assert sorted(map(tuple, back.meas.collect())) == sorted(map(tuple, rec.meas.collect()))
    assert dict(back.meas.dtypes)["st"] == "float" and dict(back.meas.dtypes)["x"] == "double"
    assert {(r.section, r.stretch_id): (r.x_start, r.x_stop) for r in secs.collect()} == {("cold", 1): (0.0, 0.25), ("cold", 2): (0.5, 0.5), ("warm", 1): (0.3, 0.4)}
    assert {r.key for r in back.meta.collect()} == {r.key for r in rec.meta.collect()} and back.series.count() == 2
    assert writer_options("snappy") == {"compression": "snappy"} and described(back.meas, {"st": "forward"}).schema["st"].metadata["comment"] == "forward"


def test_flattened_names():
    root = tree(b"junk<a xmlns='u'><b k='1'>t</b><c><d>1</d></c><c><d>2</d></c><data>9</data></a>")
    assert flatten(root) == {"b:k": "1", "b": "t", "c_0:d": "1", "c_1:d": "2"}
