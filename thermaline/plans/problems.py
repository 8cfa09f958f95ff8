"""Queries of the record-processing problems 1 to 3 and 5 to 7, each over its whole tables, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thermaline.operators.drift import drift_log, fold, header_fields, union_table
from thermaline.operators.nested import composite_tables, curves_with_software
from thermaline.operators.regrid import regular_grid
from thermaline.operators.spikes import Field, flag_implausible
from thermaline.operators.timestamps import normalise_stamps
from thermaline.plans import stamps_sql
from thermaline.session import table, written
from thermaline.streaming.compact import compact_table

#: Periods that lie in an interval between readings of more than this are uncovered.
LONGEST_US, COUNTER_LONGEST_US = 300_000_000, 5_400_000_000


def _stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = {"filename_tstamp": "timezone_input_files", "netcdf_time": "timezone_netcdf"}
    return normalise_stamps(table(spark, sf_dir, "recordings"), "file_id", "device_id", zones, "arrived_at", table(spark, sf_dir, "instruments").select("device_id", "date_order"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamps(spark, sf_dir).filter("utc_us IS NOT NULL").select(F.col("row_id").alias("file_id"), "field", "utc_us")


def p1_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamps(spark, sf_dir).groupBy("field", "status", "format").agg(F.count("*").alias("stamps"))


def _implausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    # set for these instruments: detector counts beyond a million, and temperatures outside the range of a platinum sensor, can't be measured
    light = [Field("st", 0.0, 1e6, log=True), Field("ast", 0.0, 1e6, log=True)]
    tabs = {
        "meas": flag_implausible(table(spark, sf_dir, "meas"), "meas_id", ["run_id", "ix"], "device_id", "time", light, 6),
        "series": flag_implausible(table(spark, sf_dir, "series"), "trace_id", ["run_id"], "device_id", "time", [Field("referencetemperature", -200.0, 600.0)], 6),
        "probe_readings": flag_implausible(table(spark, sf_dir, "probe_readings"), "reading_id", ["run_id"], "probe_id", "time", [Field("pt100_2", -200.0, 850.0)], 10),
    }
    out = None
    for name, found in tabs.items():
        found = found.select(F.lit(name).alias("tab"), "row_id", "field", "kind")
        out = found if out is None else out.unionByName(found)
    return out


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _implausible(spark, sf_dir).select("tab", "row_id", "field")


def p2_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _implausible(spark, sf_dir).groupBy("tab", "field", "kind").agg(F.count("*").alias("readings"))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "probes").filter("probe_id IS NOT NULL").dropDuplicates(["probe_id"])
    readings = table(spark, sf_dir, "probe_readings").join(probes.select("probe_id", (F.col("period_s").cast("long") * 1_000_000).alias("period_us")), "probe_id")
    return regular_grid(readings, "run_id", "time", "pt100_2", "period_us", row_id="reading_id", longest_us=LONGEST_US)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).filter("readings = 0").select(F.col("series").alias("run_id"), "slot_us")


def p3_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select(F.col("series").alias("run_id"), "slot_us", "readings", F.round("mean", 6).alias("mean"), "status")


def p3_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counter part of the operator: running totals of the events of each type, which start again every day, by the hour."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("time"), F.coalesce("value", F.lit(0.0)).alias("value"))
    total = F.sum("value").over(Window.partitionBy("event_type", F.to_date("time")).orderBy("time", "event_id"))
    counter = rows.withColumns({"total": total, "period_us": F.lit(3_600_000_000)})
    cells = regular_grid(counter, "event_type", "time", "total", "period_us", "counter", "event_id", COUNTER_LONGEST_US)
    return cells.select(F.col("series").alias("event_type"), "slot_us", "readings", (F.round("increment", 4) + 0.0).alias("increment"), (F.round("covered", 6) + 0.0).alias("covered"), "status")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves_with_software(table(spark, sf_dir, "witsml_raw"), "raw_id", "body").withColumnRenamed("row_id", "raw_id")


def p5_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite_tables(table(spark, sf_dir, "witsml_raw"), "raw_id", "body")["logs"].withColumnRenamed("row_id", "raw_id")


def p5_wellbores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite_tables(table(spark, sf_dir, "witsml_raw"), "raw_id", "body")["wellbores"].withColumnRenamed("row_id", "raw_id")


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(header_fields(table(spark, sf_dir, "header_files"), "stream_id", "file_seq", "header"), "headers")  # each header is parsed once


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift_log(_headers(spark, sf_dir)).select(F.col("stream").alias("stream_id"), F.col("seq").alias("file_seq"), F.col("kind").alias("change_kind"), "old_name", "new_name")


def p6_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union table, one row for each file and field: the field's type in the union schema and whether the file has a value."""
    facts = _headers(spark, sf_dir)
    cells = union_table(facts).select("stream", "seq", F.explode("fields").alias("field", "value")).join(fold(facts).select("stream", "field", "kind"), ["stream", "field"])
    return cells.select(F.col("stream").alias("stream_id"), F.col("seq").alias("file_seq"), "field", "kind", F.col("value").isNotNull().alias("there"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_table(spark, f"{sf_dir}/small_files.parquet", "blob_id", "body").select(F.col("file_id").alias("blob_id"), "line_no")


_SQL_P3_GRID = f"""
WITH r AS (
  SELECT DISTINCT p.reading_id, p.run_id, epoch_us(p.time) AS t, p.pt100_2 AS v, b.period_s * 1000000 AS per
  FROM probe_readings p JOIN probes b ON p.probe_id = b.probe_id WHERE p.pt100_2 IS NOT NULL AND NOT isnan(p.pt100_2)
), a AS (SELECT run_id, t, avg(v) AS v, count(*) AS n, min(per) AS per FROM r GROUP BY run_id, t),
c AS (SELECT run_id, per, t // per AS cell, sum(n) AS readings, avg(v) AS mean FROM a GROUP BY run_id, per, t // per),
g AS (SELECT run_id, per, unnest(range(min(cell), max(cell) + 1)) AS cell FROM c GROUP BY run_id, per)
SELECT g.run_id, CAST(g.cell * g.per AS BIGINT) AS slot_us, CAST(coalesce(c.readings, 0) AS BIGINT) AS readings, round(c.mean, 6) AS mean,
  CASE WHEN c.readings > 0 THEN 'measured' WHEN (SELECT min(t) FROM a WHERE a.run_id = g.run_id AND a.t >= (g.cell + 1) * g.per) - (SELECT max(t) FROM a WHERE a.run_id = g.run_id AND a.t < g.cell * g.per) <= {LONGEST_US} THEN 'filled' ELSE 'uncovered' END AS status
FROM g LEFT JOIN c ON g.run_id = c.run_id AND g.cell = c.cell
"""

_SQL_P3_COUNTER = f"""
WITH r AS (SELECT event_type AS k, epoch_us(ts) AS t, sum(coalesce(value, 0.0)) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM events),
a AS (SELECT k, t, max(v) AS v, count(*) AS n FROM r WHERE k IS NOT NULL GROUP BY k, t),
i AS (SELECT k, t, v, n, lag(t) OVER w AS t0, lag(v) OVER w AS v0 FROM a WINDOW w AS (PARTITION BY k ORDER BY t)),
p AS (SELECT *, CASE WHEN v >= v0 THEN v - v0 ELSE v END AS step, unnest(range(coalesce(t0, t) // 3600000000, t // 3600000000 + 1)) AS cell FROM i),
q AS (SELECT *, least(t, (cell + 1) * 3600000000) - greatest(t0, cell * 3600000000) AS o, t - t0 <= {COUNTER_LONGEST_US} AS ok, cell = t // 3600000000 AS own FROM p),
c AS (SELECT k, cell, CAST(sum(CASE WHEN own THEN n ELSE 0 END) AS BIGINT) AS readings, sum(CASE WHEN ok THEN step * o / (t - t0) END) AS increment, coalesce(sum(CASE WHEN ok THEN o END), 0) / 3600000000.0 AS covered FROM q GROUP BY k, cell)
SELECT k AS event_type, CAST(cell * 3600000000 AS BIGINT) AS slot_us, readings, round(increment, 4) + 0.0 AS increment, round(CAST(covered AS DOUBLE), 6) + 0.0 AS covered,
  CASE WHEN readings > 0 THEN 'measured' WHEN covered > 0 THEN 'filled' ELSE 'uncovered' END AS status FROM c
"""

_SQL_P7 = r"""
WITH b AS (SELECT blob_id, string_split(body, chr(10)) AS lines FROM small_files WHERE body IS NOT NULL),
l AS (SELECT blob_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS line_no FROM b),
f AS (SELECT blob_id, line_no, [trim(x, ' ' || chr(9) || chr(13)) FOR x IN string_split(regexp_replace(line, '\r$', ''), ';')] AS p FROM l),
r AS (
  SELECT blob_id, line_no, p[1] AS device, try_cast(p[2] AS HUGEINT) AS no, try_cast(replace(p[3], 'Z', '+00:00') AS TIMESTAMPTZ) AS t,
    try_cast(replace(p[4], ',', '.') AS DOUBLE) AS st, try_cast(replace(p[5], ',', '.') AS DOUBLE) AS ast
  FROM f WHERE len(p) = 6 AND p[6] = '' AND p[1] <> '' AND regexp_full_match(p[2], '\d+') AND regexp_full_match(p[3], '\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)')
), k AS (SELECT min((blob_id, line_no)) AS m FROM r WHERE no IS NOT NULL AND t IS NOT NULL AND st IS NOT NULL AND ast IS NOT NULL GROUP BY device, no, t, st, ast)
SELECT m[1] AS blob_id, CAST(m[2] AS BIGINT) AS line_no FROM k
"""


_SQL_FACTS = """
WITH RECURSIVE raw AS (SELECT DISTINCT stream_id, file_seq, header::JSON AS h FROM header_files WHERE stream_id IS NOT NULL AND file_seq IS NOT NULL AND header IS NOT NULL AND json_type(header) = 'OBJECT'),
node AS (
  SELECT stream_id, file_seq, '' AS field, h AS v FROM raw
  UNION ALL SELECT stream_id, file_seq, CASE WHEN field = '' THEN k ELSE field || ':' || k END, v -> ('$."' || k || '"') FROM (SELECT stream_id, file_seq, field, v, unnest(json_keys(v)) AS k FROM node WHERE json_type(v) = 'OBJECT')
),
leaf AS (SELECT DISTINCT stream_id, file_seq, field, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' ELSE 'number' END AS type,
  CASE WHEN json_type(v) IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT') THEN CAST(CAST(v AS DOUBLE) AS VARCHAR) ELSE CAST(v AS VARCHAR) END AS value FROM node WHERE json_type(v) <> 'OBJECT'),
files AS (SELECT DISTINCT stream_id, file_seq FROM raw)
"""

_SQL_P6 = _SQL_FACTS + """,
span AS (SELECT stream_id, field, min(file_seq) AS f, max(file_seq) AS l FROM leaf GROUP BY stream_id, field),
ends AS (SELECT stream_id, min(file_seq) AS lo, max(file_seq) AS hi FROM files GROUP BY stream_id),
gone AS (SELECT s.stream_id, (SELECT min(file_seq) FROM files x WHERE x.stream_id = s.stream_id AND x.file_seq > s.l) AS seq, s.field, a.type, a.value FROM span s JOIN leaf a ON a.stream_id = s.stream_id AND a.field = s.field AND a.file_seq = s.l JOIN ends e ON e.stream_id = s.stream_id WHERE s.l < e.hi),
born AS (SELECT s.stream_id, s.f AS seq, s.field, a.type, a.value FROM span s JOIN leaf a ON a.stream_id = s.stream_id AND a.field = s.field AND a.file_seq = s.f JOIN ends e ON e.stream_id = s.stream_id WHERE s.f > e.lo),
gk AS (SELECT *, CASE WHEN type <> 'null' THEN row_number() OVER (PARTITION BY stream_id, seq, type, value ORDER BY field) END AS k FROM gone),
bk AS (SELECT *, CASE WHEN type <> 'null' THEN row_number() OVER (PARTITION BY stream_id, seq, type, value ORDER BY field) END AS k FROM born),
moved AS (SELECT coalesce(g.stream_id, b.stream_id) AS stream_id, coalesce(g.seq, b.seq) AS file_seq, coalesce(g.field, '') AS old_name, coalesce(b.field, '') AS new_name
  FROM gk g FULL JOIN bk b ON g.stream_id = b.stream_id AND g.seq = b.seq AND g.type = b.type AND g.value = b.value AND g.k = b.k),
turn AS (SELECT stream_id, file_seq, field, type, lag(type) OVER (PARTITION BY stream_id, field ORDER BY file_seq) AS before FROM leaf WHERE type <> 'null')
SELECT stream_id, file_seq, CASE WHEN new_name = '' THEN 'removed' WHEN old_name = '' THEN 'added' ELSE 'renamed' END AS change_kind, old_name, new_name FROM moved
UNION ALL SELECT stream_id, file_seq, 'type', field, field FROM turn WHERE type <> before
"""

_SQL_P6_TABLE = _SQL_FACTS + """,
kind AS (SELECT stream_id, field, max(CASE type WHEN 'null' THEN 0 WHEN 'boolean' THEN 1 WHEN 'number' THEN 2 WHEN 'string' THEN 3 ELSE 4 END) AS kind FROM leaf GROUP BY stream_id, field)
SELECT f.stream_id, f.file_seq, k.field, CASE k.kind WHEN 0 THEN 'null' WHEN 1 THEN 'boolean' WHEN 2 THEN 'number' WHEN 3 THEN 'string' ELSE 'array' END AS kind, coalesce(a.type <> 'null', false) AS there
FROM files f JOIN kind k ON f.stream_id = k.stream_id LEFT JOIN leaf a ON a.stream_id = f.stream_id AND a.file_seq = f.file_seq AND a.field = k.field
"""

_ITEMS = "[x FOR x IN (CASE json_type({0}) WHEN 'ARRAY' THEN json_extract({0}, '$[*]') ELSE [{0}] END) IF x IS NOT NULL AND json_type(x) <> 'NULL' AND CAST(x AS VARCHAR) NOT IN ('{{}}', '[]')]"


def _sql_level(parent: str, table: str, container: str, name: str, keys: list[str]) -> str:
    """Elements of one level below a parent's containers, numbered over all of them."""
    ks = ", ".join(keys)
    return f"""
{table}_s AS (SELECT {ks}, generate_subscripts(l, 1) AS s, unnest(l) AS c FROM (SELECT {ks}, {_ITEMS.format(f"(v -> '$.{container}')")} AS l FROM {parent} WHERE json_type(v) = 'OBJECT')),
{table}_e AS (SELECT {ks}, s, generate_subscripts(l, 1) AS i, unnest(l) AS v FROM (SELECT {ks}, s, {_ITEMS.format(f"(c -> '$.{name}')")} AS l FROM {table}_s WHERE json_type(c) = 'OBJECT')),
{table} AS (SELECT {ks}, row_number() OVER (PARTITION BY {ks} ORDER BY s, i) AS {table}_no, v FROM {table}_e)"""


_SQL_LEVELS = f"""
WITH one AS (SELECT raw_id, min(body) AS body FROM witsml_raw WHERE raw_id IS NOT NULL AND body IS NOT NULL GROUP BY raw_id),
bare AS (SELECT raw_id, ltrim(body, chr(65279)) AS b FROM one),
text AS (SELECT raw_id, CASE WHEN json_valid(b) THEN CASE WHEN json_type(b) = 'VARCHAR' THEN ltrim(b::JSON ->> '$', chr(65279)) ELSE b END END AS b FROM bare),
root AS (SELECT raw_id, r AS v FROM (SELECT raw_id, unnest({_ITEMS.format("(b::JSON -> '$.WITSMLComposite')")}) AS r FROM text WHERE b IS NOT NULL AND json_valid(b) AND json_type(b) = 'OBJECT')),
{_sql_level("root", "well", "wellSet", "well", ["raw_id"])},
{_sql_level("well", "wellbore", "wellboreSet", "wellbore", ["raw_id", "well_no"])},
{_sql_level("wellbore", "log", "wellLogSet", "wellLog", ["raw_id", "well_no", "wellbore_no"])},
curve AS (SELECT raw_id, well_no, wellbore_no, log_no, generate_subscripts(l, 1) AS curve_no, unnest(l) AS v FROM (SELECT *, {_ITEMS.format("(v -> '$.logCurveInfo')")} AS l FROM log WHERE json_type(v) = 'OBJECT')),
custom AS (SELECT raw_id, well_no, wellbore_no, log_no, v, CASE WHEN json_type(v -> '$.customData') = 'VARCHAR' THEN CASE WHEN json_valid(v ->> '$.customData') THEN (v ->> '$.customData')::JSON END ELSE v -> '$.customData' END AS c FROM log),
soft AS (SELECT raw_id, well_no, wellbore_no, log_no, coalesce(max(coalesce(p -> '$.SystemSettings' ->> '$.softwareVersion', p ->> '$."SystemSettings:softwareVersion"')), min(v ->> '$."customData:SystemSettings:softwareVersion"')) AS version
  FROM (SELECT *, unnest(CASE WHEN c IS NULL THEN ['null'::JSON] WHEN json_type(c) = 'ARRAY' THEN json_extract(c, '$[*]') ELSE [c] END) AS p FROM custom) GROUP BY raw_id, well_no, wellbore_no, log_no)
"""

_SQL_P5 = _SQL_LEVELS + """
SELECT raw_id, well_no, wellbore_no, log_no, curve_no, coalesce(CASE WHEN json_type(curve.v -> '$.mnemonic') = 'OBJECT' THEN curve.v -> '$.mnemonic' ->> '$."#text"' WHEN json_type(curve.v) = 'OBJECT' THEN curve.v ->> '$.mnemonic' ELSE curve.v ->> '$' END, '') AS mnemonic, coalesce(version, '') AS software_version
FROM curve JOIN soft USING (raw_id, well_no, wellbore_no, log_no)
"""


def queries() -> dict:
    return {
        "p1_found": p1_found, "p1_statuses": p1_statuses, "p2_found": p2_found, "p2_kinds": p2_kinds, "p3_found": p3_found, "p3_grid": p3_grid, "p3_counter": p3_counter,
        "p5_found": p5_found, "p5_logs": p5_logs, "p5_wellbores": p5_wellbores, "p6_found": p6_found, "p6_table": p6_table, "p7_found": p7_found,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": stamps_sql.statement() + "SELECT file_id, field, utc_us FROM done WHERE utc_us IS NOT NULL",
        "p1_statuses": stamps_sql.statement() + "SELECT field, status, format, count(*) AS stamps FROM done GROUP BY field, status, format",
        "p3_found": f"SELECT run_id, slot_us FROM ({_SQL_P3_GRID}) WHERE readings = 0",
        "p3_grid": _SQL_P3_GRID, "p3_counter": _SQL_P3_COUNTER, "p5_found": _SQL_P5, "p5_wellbores": _SQL_LEVELS + "SELECT raw_id, well_no, wellbore_no, v ->> '$.\"@uid\"' AS uid, v ->> '$.name' AS name FROM wellbore",
        "p5_logs": _SQL_LEVELS + "SELECT raw_id, well_no, wellbore_no, log_no, v ->> '$.\"@uid\"' AS uid, v ->> '$.creationDate' AS creation_date, version AS software_version FROM log JOIN soft USING (raw_id, well_no, wellbore_no, log_no)",
        "p6_found": _SQL_P6, "p6_table": _SQL_P6_TABLE, "p7_found": _SQL_P7,
    }
