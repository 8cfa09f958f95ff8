"""Mixed timestamp formats and time zones, brought to UTC microseconds.

Every stamp is matched against a list of formats, which no stamp matches two of. Where a format leaves open which number
is the day and which the month, each order that gives a possible date is one interpretation. Their shares are a
mixture per source, fitted by expectation-maximisation over all its stamps: an interpretation's likelihood is the stamp's
nearness to the record's arrival, its prior a pseudo-count, large but finite for the order that a source declares. A
further component stands for broken stamps, those that the declared order can't read. A stamp is read by the
posterior's best interpretation, or marked impossible or ambiguous. The wall time is then placed in its zone;
wall times that the zone skips or repeats are marked as well.

The mixture is fitted on counts of stamps by source and likelihood pattern (a partial aggregation, so a hot source is
no hot task), in one array expression per source. Everything else is one projection without Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermaline.session import written

DAY_US = 86_400_000_000
#: More declared orders than this are joined by a shuffle, fewer, once counted, are broadcast.
MOST_DECLARED = 100_000

# Usual European and North American abbreviations, minutes ahead of UTC.
ABBREVIATIONS = {
    "UTC": 0, "UT": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MET": 60, "MEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
}
# Zone names of the database that are plain offsets, which some Java versions list under other names.
FIXED_ZONES = {"est": "-05:00", "mst": "-07:00", "hst": "-10:00"}
# Month names by their first letters, English, German, Dutch and French.
MONTHS = {
    "JAN": 1, "FEB": 2, "FÉV": 2, "FEV": 2, "MAR": 3, "MÄR": 3, "MRZ": 3, "MAE": 3, "MRT": 3, "MAA": 3, "APR": 4, "AVR": 4, "MAY": 5, "MAI": 5, "MEI": 5, "JUN": 6, "JUIN": 6,
    "JUL": 7, "JUIL": 7, "AUG": 8, "AOU": 8, "AOÛ": 8, "SEP": 9, "OCT": 10, "OKT": 10, "NOV": 11, "DEC": 12, "DEZ": 12, "DÉC": 12,
}

_TIME = r"(\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d+))?"
_ZONE = r"\s*([A-Z]{1,5}|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?)?"
#: name -> pattern, and the groups of year, month, day, hour, minute, second, fraction, half of day, zone.
#: For the kind "triple" the first three groups are numbers of unknown order; for "text" the month is a name.
FORMATS: dict[str, tuple[str, str, str]] = {
    "year_first": ("plain", rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})[T ]\s*{_TIME}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    "compact": ("plain", rf"^(\d{{4}})(\d{{2}})(\d{{2}})[_T ]?(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d+))?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    "compact_ms": ("plain", r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(\d{3})$", "$1|$2|$3|$4|$5|$6|$7||"),
    "compact_short": ("plain", r"^(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "20$1|$2|$3|$4|$5|$6|||"),
    "ordinal": ("ordinal", rf"^(\d{{4}})-?(\d{{3}})[T ]{_TIME}{_ZONE}$", "$1|1|$2|$3|$4|$5|$6||$7"),
    "text": ("text", rf"^(\d{{1,2}})[.]?[-/ ]\s*(\p{{L}}{{3,9}})[.]?[-/ ](\d{{4}}|\d{{2}})[T ]\s*{_TIME}\s*([AP]M)?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    "triple": ("triple", rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}})[T ]\s*{_TIME}\s*([AP]M)?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
}
ORDERS = ("dmy", "mdy", "ymd")
#: Components of the mixture, and pseudo-counts of its prior: of a declared order, of broken stamps beside one, of any other.
COMPONENTS = (*ORDERS, "broken")
DECLARED, BROKEN, OPEN = 1e6, 1e3, 1.0
_SINCE = rf"^(-?\d+(?:\.\d+)?)\s*(MICROSECONDS?|MILLISECONDS?|SECONDS?|MINUTES?|HOURS?|DAYS?)\s+SINCE\s+(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[T ]{_TIME}{_ZONE})?$"
# Microseconds of each unit.
_UNITS = {"MICRO": 1, "MILLI": 1000, "SECON": 1_000_000, "MINUT": 60_000_000, "HOUR": 3_600_000_000, "DAY": DAY_US}


def _int(c: Column) -> Column:
    return c.try_cast("long")


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, null if there is none."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    long = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    yy = F.when(m <= 2, y - 1).otherwise(y)
    era_days = yy * 365 + F.floor(yy / 4) - F.floor(yy / 100) + F.floor(yy / 400)
    in_year = F.floor((153 * ((m + 9) % 12) + 2) / 5) + d - 1
    return F.when((m >= 1) & (m <= 12) & (d >= 1) & (d <= long) & (y >= 1), (era_days + in_year - 719468).cast("long"))


def _offset_minutes(z: Column) -> Column:
    """Minutes ahead of UTC of '+01', '-0330', 'UTC+2', 'GMT-3:00', 'CEST', 'Z'; null if it is none of these."""
    m = F.regexp_replace(z, r"^(?:UTC|GMT)?\s*([+-])\s*(\d{1,2}):?(\d{2})?$", "$1|$2|$3")
    parts = F.split(m, r"\|")
    hours, mins = _int(parts[1]), F.coalesce(_int(F.when(parts[2] != "", parts[2])), F.lit(0))
    numeric = F.when((hours <= 18) & (mins <= 59), (hours * 60 + mins) * F.when(parts[0] == "-", -1).otherwise(1))
    names = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.when(m.contains("|"), numeric).otherwise(F.try_element_at(names, z).cast("long"))


def zone_names(spark: SparkSession) -> DataFrame:
    """Names of the zone database by their lower case: about 600 rows whatever the data."""
    ids = [z for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds().toArray() if not z.startswith("SystemV/")]
    return spark.createDataFrame([(z.lower(), FIXED_ZONES.get(z.lower(), z)) for z in sorted(ids)] + [(k, v) for k, v in FIXED_ZONES.items() if k not in {z.lower() for z in ids}], "_zl string, _zid string")


def _clean(c: Column) -> Column:
    """Upper case, without outer blanks and quotes, inner blanks single."""
    return F.upper(F.regexp_replace(F.regexp_replace(c, r"^[\s\p{Z}\x00\"'`“”‘’«»]+|[\s\p{Z}\x00\"'`“”‘’«»]+$", ""), r"\s+", " "))


def _parsed(s: Column) -> Column:
    """struct(kind, parts) of the first format that matches a cleaned stamp."""
    c = F.lit(None).cast("struct<kind:string,name:string,parts:array<string>>")
    for name, (kind, rx, repl) in reversed(FORMATS.items()):
        c = F.when(s.rlike(rx), F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.split(F.regexp_replace(s, rx, repl), r"\|").alias("parts"))).otherwise(c)
    return c


def _epoch_us(s: Column) -> Column:
    """Digits alone by their number: seconds, milliseconds, microseconds, nanoseconds; or a count since an epoch."""
    digits = _int(s)
    plain = F.when(s.rlike(r"^\d{10}$"), digits * 1_000_000).when(s.rlike(r"^\d{13}$"), digits * 1000).when(s.rlike(r"^\d{16}$"), digits).when(s.rlike(r"^\d{19}$"), F.floor(digits / 1000))
    point = F.regexp_replace(s, r"^(\d{10})\.(\d+)$", "$1|$2")
    plain = F.when(point.contains("|"), _int(F.split(point, r"\|")[0]) * 1_000_000 + _int(F.substring(F.rpad(F.split(point, r"\|")[1], 6, "0"), 1, 6))).otherwise(plain)
    p = F.split(F.regexp_replace(s, _SINCE, "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"), r"\|")
    unit = F.lit(None).cast("long")
    for k, us in _UNITS.items():
        unit = F.when(p[1].startswith(k), F.lit(us).cast("long")).otherwise(unit)
    start = _days(_int(p[2]), _int(p[3]), _int(p[4])) * DAY_US + F.when(p[5] == "", F.lit(0).cast("long")).otherwise(_clock_us(p[5], p[6], p[7], p[8], F.lit("")))
    start = start - F.when(p[9] == "", F.lit(0).cast("long")).otherwise(_offset_minutes(p[9])) * 60_000_000
    whole = _int(F.substring_index(p[0], ".", 1)) * unit
    part = F.when(p[0].contains("."), F.floor(F.concat(F.lit("0."), F.substring_index(p[0], ".", -1)).try_cast("double") * unit)).otherwise(F.lit(0)) * F.when(p[0].startswith("-"), -1).otherwise(1)
    return F.when(s.rlike(_SINCE), start + whole + part).otherwise(plain).cast("long")


def _clock_us(h: Column, mi: Column, s: Column, frac: Column, half: Column) -> Column:
    """Microseconds of the day, null if the clock can't show it; digits beyond microseconds are cut off."""
    hour = _int(h)
    hour = F.when(half == "", hour).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(half == "PM", 12).otherwise(0))
    us = F.when(frac == "", F.lit(0).cast("long")).otherwise(_int(F.substring(F.rpad(F.substring(frac, 1, 6), 6, "0"), 1, 6)))
    return F.when((hour <= 23) & (_int(mi) <= 59) & (_int(s) <= 59), ((hour * 60 + _int(mi)) * 60 + _int(s)) * 1_000_000 + us)


def _shown(us: Column, zone: Column) -> Column:
    """Wall time that the zone shows at a UTC instant, both in microseconds."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def normalise_stamps(
    records: DataFrame,
    row_id: str,
    source: str,
    stamps: dict[str, str],
    arrived: str | None = None,
    orders: DataFrame | None = None,
    rounds: int = 20,
    sure: float = 0.99,
) -> DataFrame:
    """Rows ``(row_id, field, utc_us, status, format)``, one for each stamp column of each record.

    ``stamps`` names each stamp column and the column with its zone. ``orders(source, date_order)`` declares how
    sources write numeric dates, as a strong prior of their mixture: only stamps in their hundred thousands could outweigh it. A
    stamp that the declared order can't read is impossible, not one of another order. ``utc_us`` is null unless ``status`` is ``ok``; else it is ``missing`` (null, blank), ``unreadable``,
    ``impossible`` (no such date or clock time), ``no_zone``, ``skipped``, ``repeated`` or ``ambiguous`` (no
    interpretation has a posterior of ``sure``). Records repeated under one id count once; a null source shares one
    mixture; further columns are ignored; an empty table gives an empty result.
    """
    spark = records.sparkSession
    base = records.select(
        F.col(row_id).alias("row_id"), F.col(source).alias("_src"),
        (F.unix_micros(F.col(arrived).cast("timestamp")) if arrived else F.lit(None).cast("long")).alias("_arr"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("raw"), F.col(z).alias("zone")) for c, z in stamps.items()])).alias("_x"),
    )
    base = base.select("row_id", "_src", "_arr", "_x.*").withColumns({"_s": _clean(F.col("raw")), "_z": _clean(F.col("zone"))}).drop("raw", "zone")
    # matched before the exchange that joins repeated records, so that the two halves are compiled apart
    read = base.withColumns({"_epoch": _epoch_us(F.col("_s")), "_f": _parsed(F.col("_s"))}).dropDuplicates(["row_id", "field"])
    part = lambda k: F.get(F.col("_f.parts"), F.lit(k))
    clock = _clock_us(part(3), part(4), part(5), part(6), part(7))
    full = lambda y: F.when(F.length(y) == 2, _int(F.concat(F.lit("20"), y))).otherwise(_int(y))
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    month = F.coalesce(F.try_element_at(months, F.substring(part(1), 1, 4)), F.try_element_at(months, F.substring(part(1), 1, 3))).cast("long")
    a, b, c = part(0), part(1), part(2)
    triple = {"dmy": _days(full(c), _int(b), _int(a)), "mdy": _days(full(c), _int(a), _int(b)), "ymd": F.when(F.length(c) == 2, _days(full(a), _int(b), _int(c)))}
    ordinal = _days(_int(a), F.lit(1), F.lit(1)) + F.when((_int(c) >= 1) & (_int(c) <= 365 + F.when(_days(_int(a), F.lit(2), F.lit(29)).isNotNull(), 1).otherwise(0)), _int(c) - 1)
    fixed = F.when(F.col("_f.kind") == "plain", _days(_int(a), _int(b), _int(c))).when(F.col("_f.kind") == "text", _days(full(a), month, _int(c))).when(F.col("_f.kind") == "ordinal", ordinal)
    is_triple = F.coalesce(F.col("_f.kind") == "triple", F.lit(False))
    read = read.withColumns({"_clock": clock, "_day": fixed, "_cand": F.when(is_triple, F.array(*[triple[o] for o in ORDERS])), "_in": part(8), "_fmt": F.when(F.col("_epoch").isNotNull(), "epoch").otherwise(F.col("_f.name"))}).drop("_f")

    if orders is not None:
        declared = orders.select(F.col(orders.columns[0]).alias("_src_o"), F.lower(F.col(orders.columns[1])).alias("_order")).dropDuplicates(["_src_o"])
        declared = declared.withColumn("_order", F.array_position(F.array(*[F.lit(o) for o in ORDERS]), F.col("_order"))).filter("_order > 0")
        # how a source writes goes to its stamps by way of the mixture, so only likelihoods need to know whether one is declared
        read = read.join(F.broadcast(declared) if declared.limit(MOST_DECLARED + 1).count() <= MOST_DECLARED else declared, F.col("_src").eqNullSafe(F.col("_src_o")), "left").drop("_src_o")
    else:
        read = read.withColumn("_order", F.lit(None).cast("int"))

    # likelihood of each interpretation: a stamp lies near its record's arrival, in powers of the distance in days
    near = F.transform(F.col("_cand"), lambda d: F.when(d.isNull(), 0.0).when(F.col("_arr").isNull(), 1.0).otherwise(F.pow(F.lit(2.0), -F.least(F.lit(10.0), F.floor(F.log2(1 + F.abs(F.floor(F.col("_arr") / DAY_US) - d)))))))
    unread = F.when(F.col("_order").isNotNull() & F.get("_cand", F.col("_order") - 1).isNull(), 1.0).otherwise(0.0)
    read = read.withColumn("_lik", F.when(F.col("_cand").isNotNull(), F.concat(near, F.array(unread))))
    read = written(read, "stamps")  # so that each stamp is matched once, for the mixture and for its own reading
    counts = read.filter("_lik IS NOT NULL").groupBy("_src", "_lik").agg(F.count("*").alias("_n"), F.first("_order").alias("_order"))
    mixed = counts.groupBy("_src").agg(F.collect_list(F.struct("_lik", "_n")).alias("_cells"), F.first("_order").alias("_order"))  # at most 2 * 12^3 patterns a source
    known = F.col("_order").isNotNull()
    prior = [F.when(F.col("_order") == i + 1, DECLARED).otherwise(OPEN) for i in range(len(ORDERS))] + [F.when(known, BROKEN).otherwise(0.0)]
    mixed = mixed.withColumn("_prior", F.array(*prior))
    total = F.aggregate("_prior", F.lit(0.0), lambda a, x: a + x)
    start = F.transform("_prior", lambda x: x / total)
    mixed = mixed.select(F.col("_src").alias("_src_m"), F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda w, _: _em_round(w, F.col("_cells"), F.col("_prior"))).alias("_w"))
    read = read.drop("_order").join(mixed, F.col("_src").eqNullSafe(F.col("_src_m")), "left").drop("_src_m")

    joint = F.zip_with("_lik", "_w", lambda x, y: x * y)
    read = read.withColumn("_joint", joint).withColumn("_best", F.array_max("_joint")).withColumn("_total", F.aggregate("_joint", F.lit(0.0), lambda s, x: s + x))
    # interpretations that agree on the date leave nothing open, unless the stamp may be broken
    agreed = (F.array_size(F.array_distinct(F.filter(F.zip_with(F.slice("_cand", 1, len(ORDERS)), F.slice("_joint", 1, len(ORDERS)), lambda d, j: F.when(j > 0, d)), lambda d: d.isNotNull()))) == 1) & (F.get("_joint", F.lit(len(ORDERS))) == 0)
    read = read.withColumns({
        # the broken component has no date
        "_day": F.when(F.col("_cand").isNull(), F.col("_day")).when(F.col("_best") > 0, F.get("_cand", F.array_position("_joint", F.col("_best")).cast("int") - 1)),
        "_open": F.coalesce(F.col("_cand").isNotNull() & (F.col("_best") > 0) & ~agreed & (F.col("_best") < sure * F.col("_total")), F.lit(False)),
    })
    read = read.withColumn("_wall", F.col("_day") * DAY_US + F.col("_clock")).drop("_cand", "_lik", "_joint", "_w", "_best", "_total")

    # the zone of the stamp itself goes first, then the zone column: a database name or an offset
    read = read.join(F.broadcast(zone_names(spark)), F.lower("_z") == F.col("_zl"), "left").drop("_zl")
    own = F.coalesce(F.col("_in") != "", F.lit(False))
    minutes = F.when(own, _offset_minutes(F.col("_in"))).when(F.col("_zid").isNull(), _offset_minutes(F.col("_z")))
    read = read.withColumns({"_min": minutes, "_zid": F.when(~own, F.col("_zid"))})
    near = lambda d: _shown(F.col("_wall") + d, F.col("_zid")) - (F.col("_wall") + d)
    read = read.withColumns({"_u1": F.col("_wall") - near(-DAY_US), "_u2": F.col("_wall") - near(DAY_US)})
    ok1, ok2 = (F.coalesce(_shown(F.col(u), F.col("_zid")) == F.col("_wall"), F.lit(False)) for u in ("_u1", "_u2"))
    two = ok1 & ok2 & (F.col("_u1") != F.col("_u2"))
    status = (
        F.when(F.col("_s").isNull() | (F.col("_s") == ""), "missing").when(F.col("_epoch").isNotNull(), "ok").when(F.col("_fmt").isNull(), "unreadable").when(F.col("_wall").isNull(), "impossible")
        .when(F.col("_open"), "ambiguous").when(F.col("_min").isNotNull(), "ok").when(F.col("_zid").isNull(), "no_zone").when(two, "repeated").when(ok1 | ok2, "ok").otherwise("skipped")
    )
    instant = F.when(F.col("_epoch").isNotNull(), F.col("_epoch")).when(F.col("_min").isNotNull(), F.col("_wall") - F.col("_min") * 60_000_000).when(ok1, F.col("_u1")).when(ok2, F.col("_u2"))
    return read.withColumn("status", status).select("row_id", "field", F.when(F.col("status") == "ok", instant).cast("long").alias("utc_us"), "status", F.col("_fmt").alias("format"))


def _em_round(w: Column, cells: Column, prior: Column) -> Column:
    """One round: posteriors of each cell under the weights, then new weights from the expected counts and the prior."""
    k = range(len(COMPONENTS))
    total = lambda cell: sum((cell["_lik"][j] * w[j] for j in k), F.lit(0.0))
    sums = F.aggregate(
        cells,
        F.array(*[prior[j].cast("double") for j in k]),
        lambda acc, cell: F.array(*[acc[j] + F.when(total(cell) > 0, cell["_n"] * cell["_lik"][j] * w[j] / total(cell)).otherwise(0.0) for j in k]),
    )
    return F.transform(sums, lambda x: x / F.aggregate(sums, F.lit(0.0), lambda s, y: s + y))
