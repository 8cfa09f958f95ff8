"""SQL of problem 1, for sources that all declare how they write numeric dates.

The patterns of the formats and the abbreviations are those of the operator; dates, clocks, offsets, zones and what a zone
skips or repeats are worked out by the other engine.
"""

from __future__ import annotations

from thermaline.operators.timestamps import _SINCE, _UNITS, ABBREVIATIONS, DAY_US, FIXED_ZONES, FORMATS, MONTHS

_BLANK = "\\s\\p{Z}\\x00\"''`“”‘’«»"


def _clean(c: str) -> str:
    return f"upper(regexp_replace(regexp_replace({c}, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g'), '\\s+', ' ', 'g'))"


def _quoted(rx: str) -> str:
    return "'" + rx.replace("'", "''") + "'"


def _case(of) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(s, {_quoted(rx)}) THEN {of(name, kind, rx, repl)}" for name, (kind, rx, repl) in FORMATS.items()) + " END"


def _groups(repl: str) -> str:
    out = repl
    for k in range(9, 0, -1):
        out = out.replace(f"${k}", f"\\{k}")
    return out


def _minutes(z: str) -> str:
    """Minutes ahead of UTC of an offset or abbreviation."""
    rx = r"^(?:UTC|GMT)?\s*([+-])\s*(\d{1,2}):?(\d{2})?$"
    hours, mins = f"CAST(regexp_extract({z}, '{rx}', 2) AS INT)", f"coalesce(try_cast(regexp_extract({z}, '{rx}', 3) AS INT), 0)"
    number = f"CASE WHEN {hours} <= 18 AND {mins} <= 59 THEN ({hours} * 60 + {mins}) * CASE WHEN regexp_extract({z}, '{rx}', 1) = '-' THEN -1 ELSE 1 END END"
    names = ", ".join(f"'{k}': {v}" for k, v in ABBREVIATIONS.items())
    return f"CASE WHEN regexp_matches({z}, '{rx}') THEN {number} ELSE map_extract(MAP {{{names}}}, {z})[1] END"


def _date(y: str, m: str, d: str) -> str:
    """Microseconds of a date, null if there is none."""
    return f"epoch_us(CAST(try_cast(lpad(CAST({y} AS VARCHAR), 4, '0') || '-' || lpad(CAST({m} AS VARCHAR), 2, '0') || '-' || lpad(CAST({d} AS VARCHAR), 2, '0') AS DATE) AS TIMESTAMP))"


def _clock(h: str, mi: str, s: str, frac: str, half: str) -> str:
    hour = f"CASE WHEN {half} = '' THEN try_cast({h} AS INT) WHEN try_cast({h} AS INT) BETWEEN 1 AND 12 THEN try_cast({h} AS INT) % 12 + CASE WHEN {half} = 'PM' THEN 12 ELSE 0 END END"
    us = f"CASE WHEN {frac} = '' THEN 0 ELSE CAST(rpad(substr({frac}, 1, 6), 6, '0') AS BIGINT) END"
    return f"CASE WHEN {hour} <= 23 AND try_cast({mi} AS INT) <= 59 AND try_cast({s} AS INT) <= 59 THEN (({hour} * 60 + try_cast({mi} AS INT)) * 60 + try_cast({s} AS INT)) * CAST(1000000 AS BIGINT) + {us} END"


def _full(y: str) -> str:
    return f"CASE WHEN length({y}) = 2 THEN 2000 + try_cast({y} AS INT) ELSE try_cast({y} AS INT) END"


def _epoch() -> str:
    tail = r":\d{2}:\d{2}(?:[.,]\d+)?\s*([A-Z]{1,5}|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?)$"  # the tenth group, which this engine can't ask for
    since = lambda k: f"regexp_extract(s, {_quoted(_SINCE)}, {k})" if k < 10 else f"regexp_extract(s, {_quoted(tail)}, 1)"
    unit = "CASE " + " ".join(f"WHEN starts_with({since(2)}, '{k}') THEN {us}" for k, us in _UNITS.items()) + " END"
    start = f"{_date(since(3), since(4), since(5))} + CASE WHEN {since(6)} = '' THEN 0 ELSE {_clock(since(6), since(7), since(8), since(9), chr(39) * 2)} END - CASE WHEN {since(10)} = '' THEN 0 ELSE ({_minutes(since(10))}) * 60000000 END"
    number = f"try_cast({since(1)} AS DECIMAL(38, 9)) * {unit}"
    return f"""CASE WHEN regexp_matches(s, {_quoted(_SINCE)}) THEN {start} + CAST(trunc({number}) AS BIGINT)
      WHEN regexp_matches(s, '^\\d{{10}}$') THEN CAST(s AS BIGINT) * 1000000 WHEN regexp_matches(s, '^\\d{{13}}$') THEN CAST(s AS BIGINT) * 1000 WHEN regexp_matches(s, '^\\d{{16}}$') THEN CAST(s AS BIGINT)
      WHEN regexp_matches(s, '^\\d{{19}}$') THEN CAST(s AS BIGINT) // 1000
      WHEN regexp_matches(s, '^\\d{{10}}\\.\\d+$') THEN CAST(split_part(s, '.', 1) AS BIGINT) * 1000000 + CAST(substr(rpad(split_part(s, '.', 2), 6, '0'), 1, 6) AS BIGINT) END"""


def statement() -> str:
    """CTEs that end with ``done(file_id, field, utc_us, status, format)``."""
    kind, name = _case(lambda n, k, rx, rp: f"'{k}'"), _case(lambda n, k, rx, rp: f"'{n}'")
    parts = _case(lambda n, k, rx, rp: f"string_split(regexp_replace(s, {_quoted(rx)}, '{_groups(rp)}'), '|')")
    months = ", ".join(f"'{k}': {v}" for k, v in MONTHS.items())
    month = f"coalesce(map_extract(MAP {{{months}}}, substr(b, 1, 4))[1], map_extract(MAP {{{months}}}, substr(b, 1, 3))[1])"
    day = f"""CASE kind WHEN 'plain' THEN {_date('try_cast(a AS INT)', 'try_cast(b AS INT)', 'try_cast(c AS INT)')} WHEN 'text' THEN {_date(_full('a'), month, 'try_cast(c AS INT)')}
      WHEN 'ordinal' THEN CASE WHEN try_cast(c AS INT) >= 1 AND try_cast(c AS INT) <= 365 + CASE WHEN try_cast(lpad(a, 4, '0') || '-02-29' AS DATE) IS NULL THEN 0 ELSE 1 END THEN {_date('a', '1', '1')} + (CAST(c AS INT) - 1) * CAST({DAY_US} AS BIGINT) END
      WHEN 'triple' THEN CASE date_order WHEN 'dmy' THEN {_date(_full('c'), 'try_cast(b AS INT)', 'try_cast(a AS INT)')} WHEN 'mdy' THEN {_date(_full('c'), 'try_cast(a AS INT)', 'try_cast(b AS INT)')}
        WHEN 'ymd' THEN CASE WHEN length(c) = 2 THEN {_date(_full('a'), 'try_cast(b AS INT)', 'try_cast(c AS INT)')} END END END"""
    fixed = ", ".join(f"('{k}', '{'+00:00' if v == 'Z' else v}')" for k, v in FIXED_ZONES.items())
    shown = lambda us: f"epoch_us(timezone(zid, timezone('UTC', make_timestamp({us}))))"
    return f"""
WITH one AS (SELECT file_id, any_value(device_id) AS device_id, any_value(timezone_input_files) AS z1, any_value(timezone_netcdf) AS z2, any_value(filename_tstamp) AS s1, any_value(netcdf_time) AS s2 FROM recordings GROUP BY file_id),
two AS (SELECT file_id, device_id, 'filename_tstamp' AS field, s1 AS raw, z1 AS zone FROM one UNION ALL SELECT file_id, device_id, 'netcdf_time', s2, z2 FROM one),
tidy AS (SELECT file_id, device_id, field, {_clean('raw')} AS s, {_clean('zone')} AS z FROM two),
read AS (SELECT t.*, lower(i.date_order) AS date_order, {kind} AS kind, {name} AS name, {parts} AS p, CAST({_epoch()} AS BIGINT) AS epoch FROM tidy t LEFT JOIN instruments i ON t.device_id = i.device_id),
cut AS (SELECT *, p[1] AS a, p[2] AS b, p[3] AS c, {_clock('p[4]', 'p[5]', 'p[6]', 'p[7]', 'p[8]')} AS clock, coalesce(p[9], '') AS own FROM read),
wall AS (SELECT *, {day} + clock AS wall, CASE WHEN own <> '' THEN {_minutes('own')} END AS own_min FROM cut),
fix AS (SELECT * FROM (VALUES {fixed}) AS f(low, zid)),
zones AS (SELECT lower(name) AS low, min(name) AS zid FROM pg_timezone_names() WHERE lower(name) NOT IN (SELECT low FROM fix) GROUP BY lower(name)),
placed AS (SELECT w.*, CASE WHEN own = '' THEN q.zid END AS zid, CASE WHEN own <> '' THEN own_min WHEN x.zid IS NOT NULL THEN CAST(left(x.zid, 3) AS INT) * 60 WHEN q.zid IS NULL THEN {_minutes('z')} END AS mins
  FROM wall w LEFT JOIN zones q ON lower(w.z) = q.low LEFT JOIN fix x ON lower(w.z) = x.low),
tried AS (SELECT *, CASE WHEN zid IS NOT NULL AND mins IS NULL AND wall IS NOT NULL THEN 2 * wall - {DAY_US} - {shown(f'wall - {DAY_US}')} END AS u1, CASE WHEN zid IS NOT NULL AND mins IS NULL AND wall IS NOT NULL THEN 2 * wall + {DAY_US} - {shown(f'wall + {DAY_US}')} END AS u2 FROM placed),
seen AS (SELECT *, coalesce({shown('u1')} = wall, false) AS ok1, coalesce({shown('u2')} = wall, false) AS ok2 FROM tried),
judged AS (SELECT *, CASE WHEN s IS NULL OR s = '' THEN 'missing' WHEN epoch IS NOT NULL THEN 'ok' WHEN name IS NULL THEN 'unreadable' WHEN wall IS NULL THEN 'impossible' WHEN mins IS NOT NULL THEN 'ok' WHEN zid IS NULL THEN 'no_zone'
  WHEN ok1 AND ok2 AND u1 <> u2 THEN 'repeated' WHEN ok1 OR ok2 THEN 'ok' ELSE 'skipped' END AS status FROM seen),
done AS (SELECT file_id, field, CASE WHEN status = 'ok' THEN CAST(CASE WHEN epoch IS NOT NULL THEN epoch WHEN mins IS NOT NULL THEN wall - CAST(mins AS BIGINT) * 60000000 WHEN ok1 THEN u1 ELSE u2 END AS BIGINT) END AS utc_us, status,
  CASE WHEN epoch IS NOT NULL THEN 'epoch' ELSE name END AS format FROM judged)
"""
