"""Well-log XML of two vendors, one measurement a file."""

from __future__ import annotations

import re
import warnings
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from thermaline.sources.files import Parsed, Recording, assemble, first_file, instant, parse, time_columns

# Curve names of the files and the columns they become.
CURVES = {"LAF": "x", "ST": "st", "AST": "ast", "REV-ST": "rst", "REV-AST": "rast", "TMP": "tmp", "TEMP": "tmp"}
# Numbers of each measurement under customData.
NUMBERS = ("acquisitionTime", "referenceTemperature", "probe1Temperature", "probe2Temperature", "referenceProbeVoltage", "probe1Voltage", "probe2Voltage")


def tree(content: bytes) -> ElementTree.Element:
    """Root of an XML text without namespaces; anything before its first angle bracket is passed over."""
    root = ElementTree.fromstring(content[max(content.find(b"<"), 0) :])
    for e in root.iter():
        e.tag = e.tag.rsplit("}", 1)[-1]
        e.attrib = {k.rsplit("}", 1)[-1]: v for k, v in e.attrib.items()}
    return root


def flatten(root: ElementTree.Element, skip: frozenset[str] = frozenset({"data"})) -> dict[str, str]:
    """Texts and attributes by their path, ``a:b:c``; repeated elements have ``_0, _1, ...`` after their name."""
    out, stack = {}, [("", root)]
    while stack:
        path, e = stack.pop()
        for k, v in e.attrib.items():
            out[f"{path}:{k}" if path else k] = v
        tags = [c.tag for c in e]
        seen: dict[str, int] = {}
        for c in e:
            if c.tag in skip:
                continue
            name = c.tag
            if tags.count(name) > 1:
                seen[name] = seen.get(name, -1) + 1
                name = f"{name}_{seen[name]}"
            stack.append((f"{path}:{name}" if path else name, c))
        if not len(e) and path and e.text is not None:
            out[path] = e.text.strip()
    return out


def _table(lines: list[str], curves: list[str]) -> tuple[list[float], dict[str, list[float]]]:
    unknown = [c for c in curves if c not in CURVES]
    if unknown:
        raise ValueError(f"unknown data column {unknown[0]}")
    rows = [[float(v) for v in line.strip().split(",")] for line in lines]
    if any(len(row) != len(curves) for row in rows):
        raise ValueError("a row has not as many values as there are curves")
    columns = {CURVES[c]: list(v) for c, v in zip(curves, zip(*rows))} if rows else {CURVES[c]: [] for c in curves}
    return columns.pop("x"), columns


def _text(e: ElementTree.Element | None) -> str | None:
    return e.text.strip() if e is not None and e.text else None


def silixa_file(name: str, content: bytes) -> Parsed:
    """Versions 4, 6, 7 and 8 of the instrument's software."""
    root = tree(content)
    log = root if root.tag in ("log", "wellLog") else root.find("log") if root.find("log") is not None else root.find("wellLog")
    if log is None:
        raise ValueError("no log")
    meta = flatten(log)
    version = meta.get("customData:SystemSettings:softwareVersion", "")
    major = re.search(r"\d", version)
    major = int(major.group()) if major else 6 if log.tag == "log" else 4
    if major not in (4, 6, 7, 8):
        raise NotImplementedError(f"software version {version}")
    if major == 4:
        curves = [c.findtext("mnemonic").strip() for c in log.findall("logCurveInfo")]
        stop = meta.get("maxDateTimeIndex") or meta.get("endDateTimeIndex")
        stamp = name[10:-4]
    else:
        curves = meta["logData:mnemonicList"].replace(" ", "").split(",")
        stop = meta.get("endDateTimeIndex")
        stamp = {6: name[10:27], 7: name[15:27], 8: name[-23:-4].replace(".", "")}[major]
    x, columns = _table([d.text for d in log.findall("logData/data")], curves)
    custom = log.find("customData")
    series = {n: float(t) for n in NUMBERS if (t := _text(custom.find(n)))}
    channels = custom.findall("UserConfiguration/ChannelConfiguration")
    double = meta.get("customData:isDoubleEnded", "0") == "1"
    places = {"FW": meta.get("customData:forwardMeasurementChannel", "1")} | ({"BW": meta.get("customData:reverseMeasurementChannel", "1")} if double else {})
    for d, ch in places.items():
        k = int(ch) - 1
        t = _text(channels[k].find(f"AcquisitionConfiguration/AcquisitionTime/userAcquisitionTime{d}")) if 0 <= k < len(channels) else None
        if t:
            series[f"userAcquisitionTime{d}"] = float(t)
    meta |= {"isDoubleEnded": "1" if double else "0", "forwardMeasurementChannel": places["FW"], "backwardMeasurementChannel": places.get("BW", "N/A")}
    return Parsed(stop, series, meta, x, columns, stamp if stamp.isdigit() else None)


def read_silixa(spark: SparkSession, paths: str | list[str], zone: str = "UTC") -> Recording:
    """Files ``*.xml`` of versions 4, 6, 7 and 8; their times have offsets of their own. ``time`` is a wall time of ``zone``."""
    rows = parse(spark, paths, ".xml", silixa_file, "silixa")
    head = first_file(rows).select("names", F.map_keys("series").alias("keys"), F.col("meta")["isDoubleEnded"].alias("double")).first()
    double = head["double"] == "1"
    fw = F.coalesce(F.col("series")["userAcquisitionTimeFW"], F.col("series")["acquisitionTime"], F.lit(0.0))
    bw = F.coalesce(F.col("series")["userAcquisitionTimeBW"], F.lit(0.0)) if double else None
    return assemble(rows, time_columns(instant(F.col("stop"), "UTC"), fw, bw, zone), double, head["names"], sorted(head["keys"]))


def apsensing_file(name: str, content: bytes) -> Parsed:
    root = tree(content)
    log = root.find("wellSet/well/wellboreSet/wellbore/wellLogSet/wellLog")
    if log is None:
        raise ValueError("no wellLog")
    curves = [c.findtext("mnemonic").strip() for c in log.findall("logCurveInfo")]
    x, columns = _table([d.text for d in log.findall("logData/data")], curves)
    meta = flatten(root)
    stamp = re.search(r"(\d{14})\.xml$", name, re.I)
    device = next((v for k, v in meta.items() if k.endswith("dtsInstalledSystem:uid")), "")
    meta |= {"isDoubleEnded": "0", "forwardMeasurementChannel": "1", "backwardMeasurementChannel": "N/A", "deviceId": device.split("-")[0]}
    return Parsed(_text(log.find("creationDate")), {}, meta, x, columns, stamp.group(1) if stamp else None)


def read_apsensing(spark: SparkSession, paths: str | list[str], zone: str = "UTC", traces: str | list[str] | None = "beside", trace_arrays: bool = True) -> Recording:
    """Files ``*.xml``, in UTC, and the trace files beside them. ``traces`` names their folder or files, or is None for none.

    Trace files add the probes' temperatures to the series and, with ``trace_arrays``, ``log_ratio_by_dts`` and ``loss_by_dts`` to the
    measurements. If none of the measurements has one, they are left out with a warning; if only some have one, or one has no
    measurement, or times or temperatures differ, it is an error.
    """
    from thermaline.sources.text import read_traces

    rows = parse(spark, paths, ".xml", apsensing_file, "apsensing")
    head = first_file(rows).select("names", F.col("meta")["deviceId"].alias("device")).first()
    if head["device"] not in ("", "N4386B"):
        warnings.warn(f"the device {head['device']} has not been tested", stacklevel=2)
    out = assemble(rows, {"time": F.from_utc_timestamp(instant(F.col("stop"), "UTC"), zone)}, False, head["names"], [])
    if traces == "beside":
        traces = paths if isinstance(paths, str) else sorted({p.rsplit("/", 1)[0] for p in paths})
    if traces is None:
        return out
    try:
        extra = read_traces(spark, traces, zone)
    except FileNotFoundError:
        warnings.warn("no trace files beside the measurements: not loading any", stacklevel=2)
        return out
    return merge_traces(out, extra, trace_arrays)


def merge_traces(xml: Recording, traces: Recording, arrays: bool = True) -> Recording:
    """Adds trace files to the measurements of the same time stamp, after checking that both agree."""
    a, b = xml.series.select("filename_tstamp").distinct(), traces.series.select("filename_tstamp").distinct()
    for one, two, what in ((a, b, "measurements without a trace file"), (b, a, "trace files without a measurement")):
        lone = one.join(two, "filename_tstamp", "left_anti").limit(1).collect()
        if lone:
            raise ValueError(f"{what}: {lone[0][0]}")
    probes = [c for c in traces.series.columns if c.startswith("probe")]
    times = traces.series.select(F.col("filename_tstamp").alias("_s"), F.col("time").alias("_t"), *probes)
    both = xml.series.join(times, F.col("filename_tstamp") == F.col("_s"), "left")
    if both.filter(~F.col("time").eqNullSafe(F.col("_t"))).limit(1).count():
        raise ValueError("measurements and trace files of one stamp have different times")
    series = both.drop("_s", "_t")
    if not arrays:
        return Recording(xml.meas, series, xml.meta, xml.headers, xml.double_ended)
    cells = traces.meas.select("ix", "time", F.col("tmp").alias("_tmp"), "log_ratio_by_dts", "loss_by_dts")
    meas = xml.meas.join(cells, ["ix", "time"], "left")
    if "tmp" in xml.meas.columns and meas.filter(F.col("ix").isin(0, 2, 5) & ~F.col("tmp").eqNullSafe(F.col("_tmp"))).limit(1).count():
        raise ValueError("measurements and trace files of one stamp have different temperatures")
    return Recording(meas.drop("_tmp"), series, xml.meta, xml.headers, xml.double_ended)
