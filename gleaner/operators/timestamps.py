"""Problem 3: mixed timestamp formats and time zones.

Each text is read by every format family that fits it. Day/month order is the only thing the text itself can leave
open, so it is the latent variable of a mixture per source: every value contributes its likelihood under each valid
reading (impossible dates have none, dates far from the fetch time little), expectation-maximisation fits the weights of
the orders of each source, and the posterior picks the reading. A noise component keeps a stray impossible value from
being read in an order its source never uses. What stays open is marked, never guessed.

The reading is done with built-in expressions; only the tiny per-source count tables of the EM go through Python.

Defined results: null or blank text gives status ``null``; text that fits no family or names no real date gives
``unparsed``; wording relative to now gives ``relative``; a wall clock time that its zone skipped gives ``gap``, one
that it had twice ``overlap``; a reading whose posterior stays under the threshold gives ``ambiguous``; an abbreviation
or zone that cannot be resolved gives ``unknown_zone``. Repeated rows each get their own result, an empty table gives an
empty one, and further columns of the input are left alone (the operator only takes the columns it is told).
"""

from __future__ import annotations

from zoneinfo import available_timezones

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.tables import bounded, spread

# Names of the months in the languages of the sources, all forms in lower case.
MONTHS = {
    1: "january jan janvier janv januar jän enero ene janeiro gennaio gen января январь янв",
    2: "february feb février févr fevr februar febrero fevereiro fev febbraio февраля февраль фев",
    3: "march mar mars märz maerz marzo março марта март мар",
    4: "april apr avril avr abril abr aprile апреля апрель апр",
    5: "may mai mayo maio maggio mag мая май",
    6: "june jun juin juni junio junho giugno giu июня июнь июн",
    7: "july jul juillet juil juli julio julho luglio lug июля июль июл",
    8: "august aug août aout agosto ago августа август авг",
    9: "september sep sept septembre septiembre setiembre setembro set settembre сентября сентябрь сен",
    10: "october oct octobre oktober okt octubre outubro out ottobre ott октября октябрь окт",
    11: "november nov novembre noviembre novembro ноября ноябрь ноя",
    12: "december dec décembre déc decembre dezember dez diciembre dic dezembro dicembre декабря декабрь дек",
}

# Offsets in minutes of zone abbreviations; several offsets mean that the home zone decides.
ABBREVIATIONS = {
    "UTC": [0], "GMT": [0], "Z": [0], "UT": [0], "WET": [0], "WEST": [60], "BST": [60, 360], "IST": [330, 60, 120],
    "CET": [60], "CEST": [120], "MEZ": [60], "MESZ": [120], "EET": [120], "EEST": [180], "MSK": [180], "MSD": [240],
    "TRT": [180], "GST": [240], "PKT": [300], "ICT": [420], "WIB": [420], "HKT": [480], "SGT": [480], "AWST": [480],
    "JST": [540], "KST": [540], "ACST": [570], "ACDT": [630], "AEST": [600], "AEDT": [660], "NZST": [720],
    "NZDT": [780], "BRT": [-180], "BRST": [-120], "ART": [-180], "NST": [-210], "NDT": [-150], "AST": [-240, 180],
    "ADT": [-180], "EST": [-300, 600], "EDT": [-240], "CST": [-360, 480], "CDT": [-300], "MST": [-420],
    "MDT": [-360], "PST": [-480, 480], "PDT": [-420], "AKST": [-540], "AKDT": [-480], "HST": [-600], "SAST": [120],
    "CAT": [120], "EAT": [180], "WAT": [60],
}

# Zones named without standard or daylight time.
GENERIC_ZONES = {"PT": "America/Los_Angeles", "MT": "America/Denver", "CT": "America/Chicago", "ET": "America/New_York"}

# Wording relative to now.
RELATIVE = (
    r"(?iu)^(just now|now|today.*|yesterday.*|tomorrow.*|last \w+|this \w+|\d+\s*\w+ ago|an? \w+ ago|il y a .*|hier|gestern"
    r"|heute|vor \d+ .*|hace .*|ayer|hoy|ieri|oggi|\d+ \w+ fa|ontem|hoje|há .*|вчера|сегодня|.* назад|昨日|今日|昨天|今天|.*前)$"
)

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_NAME = r"([\p{L}]{3,10})"
# family, pattern (on the lower-cased text without its zone), how its groups give y|m|d|H|M|S|fraction|am or pm
_FAMILIES = [
    ("iso", rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[t ,]+{_TIME})?\s*([ap]m)?$", "$1|$2|$3|$4|$5|$6|$7|$8"),
    ("compact", r"^(\d{4})(\d{2})(\d{2})(?:t?(\d{2})(\d{2})(\d{2})?)?$", "$1|$2|$3|$4|$5|$6||"),
    ("week", rf"^(\d{{4}})-?w(\d{{2}})-?(\d)(?:[t ]+{_TIME})?$", "$1|$2|$3|$4|$5|$6|$7|"),
    ("ordinal", rf"^(\d{{4}})-(\d{{3}})(?:[t ]+{_TIME})?$", "$1||$2|$3|$4|$5|$6|"),
    ("numeric", rf"^(\d{{1,2}})[./-](\d{{1,2}})[./-](\d{{4}}|\d{{2}})(?:[, ]+{_TIME})?\s*([ap]m)?$", "$3|$1|$2|$4|$5|$6|$7|$8"),
    ("cjk", r"^(\d{4})年(\d{1,2})月(\d{1,2})日(?:\s*(\d{1,2})[:時时点](\d{1,2})分?(?::?(\d{1,2})秒?)?)?$", "$1|$2|$3|$4|$5|$6||"),
    ("day_name", rf"^(?:[\p{{L}}]+\.?,? +)?(\d{{1,2}})(?:\.|er|st|nd|rd|th|º)? +(?:de +)?{_NAME}\.?,? +(?:de +)?(\d{{4}})(?: *г\.?)?(?:,? +(?:(?:à|at|um|a las|às|alle|ore|в) +)?(\d{{1,2}})[:h](\d{{2}})(?::(\d{{2}}))?)?(?: *(?:uhr|h))?(?: *([ap]m))?$", "$3|$2|$1|$4|$5|$6||$7"),
    ("name_day", rf"^(?:[\p{{L}}]+\.?,? +)?{_NAME}\.? +(\d{{1,2}})(?:st|nd|rd|th)?,? +(\d{{4}})(?:,? +(?:at +)?{_TIME})?(?: *([ap]m))?$", "$3|$1|$2|$4|$5|$6|$7|$8"),
    ("ctime", rf"^(?:[\p{{L}}]+,? +)?{_NAME} +(\d{{1,2}}) +{_TIME} +(\d{{4}})$", "$7|$1|$2|$3|$4|$5|$6|"),
]

DAY_US = 86_400_000_000
ORDERS = ("dmy", "mdy", "ymd")
NOISE = 0.01


def _settle(df: DataFrame) -> DataFrame:
    """``df`` behind a generator of one row per row: filters above are not pushed into it as copies of its expressions."""
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def days_from_civil(y: str, m: str, d: str) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date given by SQL expressions; never fails on bad input."""
    yy = f"(({y}) - if(({m}) <= 2, 1, 0))"
    era = f"floor({yy} / 400.0)"
    yoe = f"({yy} - {era} * 400)"
    doy = f"(floor((153 * (({m}) + if(({m}) > 2, -3, 9)) + 2) / 5.0) + ({d}) - 1)"
    return F.expr(f"cast({era} * 146097 + {yoe} * 365 + floor({yoe} / 4.0) - floor({yoe} / 100.0) + {doy} - 719468 as bigint)")


def _real(y: str, m: str, d: str) -> str:
    leap = f"(({y}) % 4 = 0 and (({y}) % 100 <> 0 or ({y}) % 400 = 0))"
    return f"(({m}) between 1 and 12 and ({d}) between 1 and case when ({m}) in (4, 6, 9, 11) then 30 when ({m}) = 2 then if({leap}, 29, 28) else 31 end)"


def _offset_us(at_us: Column, zone: Column) -> Column:
    """Offset of ``zone`` from UTC at an instant, in microseconds."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(at_us), zone)) - at_us


def read_texts(df: DataFrame, text: str) -> DataFrame:
    """``df`` (columns ``_key``, ``_source``, ``_home``, ``_near_us`` and ``text``) with the parts each text names."""
    s = F.trim(F.regexp_replace(F.translate(F.col(text), "０１２３４５６７８９：／．－", "0123456789:/.-"), r"(?U)\s+", " "))
    df = df.withColumn("_s", s)
    # the zone: [Area/City] at the end, a numeric offset after a clock time, an abbreviation at the end or before the year
    df = df.withColumn("_bracket", F.regexp_extract("_s", r"\[([A-Za-z][\w+\-]*(?:/[\w+\-]+)*)\]$", 1))
    df = df.withColumn("_s", F.trim(F.regexp_replace("_s", r"\s*\[[^\]]*\]$", "")))
    df = df.withColumn("_off", F.regexp_extract("_s", r"(?:[Tt ]\d{6}|:\d{2}(?:[.,]\d+)?)\s*(?:UTC|GMT)?([+\-−]\d{2}:?(?:\d{2})?)$", 1))
    df = df.withColumn("_s", F.when(F.col("_off") != "", F.expr("trim(left(_s, length(_s) - length(_off)))")).otherwise(F.col("_s")))
    df = df.withColumn(
        "_abbr",
        F.upper(
            F.coalesce(
                F.nullif(F.regexp_extract("_s", r"\d(?:\.\d+)?([Zz])$", 1), F.lit("")),
                F.nullif(F.regexp_extract("_s", r"(?:\d|[AaPp][Mm]) ([A-Za-z]{2,5})$", 1), F.lit("")),
                F.nullif(F.regexp_extract("_s", r"\d{2} ([A-Z]{2,5}) \d{4}$", 1), F.lit("")),
                F.lit(""),
            )
        ),
    )
    df = df.withColumn("_abbr", F.when(F.col("_abbr").isin("AM", "PM", "UHR"), F.lit("")).otherwise(F.col("_abbr")))
    bare = F.when(
        F.col("_abbr") != "",
        F.regexp_replace(F.regexp_replace("_s", r"(?<=\d)[Zz]$| [A-Za-z]{2,5}$", ""), r"(\d{2}) [A-Z]{2,5} (\d{4})$", "$1 $2"),
    ).otherwise(F.col("_s"))
    df = df.withColumn("_b", F.regexp_replace(F.lower(F.trim(bare)), r"\b([ap])\.m\.?$", "$1m"))
    family = F.when(F.col("_b").rlike(r"^\d{9,10}$|^\d{12,13}$|^\d{15,16}$|^\d{18,19}$"), F.lit("epoch"))
    parts = F.when(F.col("_b").rlike(r"^\d{9,10}$"), F.lit(""))
    for name, pattern, order in _FAMILIES:
        family = family.when(F.col("_b").rlike(pattern), F.lit(name))
        parts = parts.when(F.col("_b").rlike(pattern), F.regexp_replace("_b", pattern, order))
    df = df.withColumn("_family", family).withColumn("_p", F.split(parts, r"\|"))
    month = F.create_map(*[F.lit(x) for number, names in MONTHS.items() for n in dict.fromkeys(names.split()) for x in (n, str(number))])
    part = lambda i: F.try_element_at("_p", F.lit(i + 1))
    as_int = lambda c: c.try_cast("int")
    named = F.col("_family").isin("day_name", "name_day", "ctime")
    df = df.withColumns({
        "_y": as_int(part(0)),
        "_m": as_int(F.when(named, F.try_element_at(month, part(1))).otherwise(part(1))),
        "_d": as_int(part(2)),
        "_hh": F.coalesce(as_int(part(3)), F.lit(0)),
        "_mi": F.coalesce(as_int(part(4)), F.lit(0)),
        "_ss": F.coalesce(as_int(part(5)), F.lit(0)),
        "_frac": F.coalesce(as_int(F.substring(F.rpad(F.coalesce(part(6), F.lit("")), 6, "0"), 1, 6)), F.lit(0)),
        "_ap": F.coalesce(part(7), F.lit("")),
    })
    hour = F.expr("case when _ap = '' then _hh when _hh between 1 and 12 then _hh % 12 + if(_ap = 'pm', 12, 0) else 99 end")
    df = df.withColumn("_hh", hour)
    clock = F.expr("case when _hh between 0 and 23 and _mi between 0 and 59 and _ss between 0 and 60 then ((_hh * 60L + _mi) * 60L + _ss) * 1000000L + _frac when _hh = 24 and _mi = 0 and _ss = 0 and _frac = 0 then 86400000000L end")
    return df.withColumn("_clock", clock)


def _days(df: DataFrame) -> DataFrame:
    """The day under each order of day and month (null: no real date), for the families that leave it open or not."""
    y4 = "if(_y < 100, if(_y < 70, 2000, 1900) + _y, _y)"
    day = lambda y, m, d: F.when(F.expr(_real(y, m, d)), days_from_civil(y, m, d))
    jan4 = days_from_civil("_y", "1", "4")
    monday = jan4 - F.pmod(jan4 + 3, F.lit(7))
    weeks = F.when(F.expr("_m between 1 and 53 and _d between 1 and 7"), monday + (F.col("_m") - 1) * 7 + F.col("_d") - 1)
    # week 53 only exists in years whose 28 December falls into it
    last = days_from_civil("_y", "12", "28")
    weeks = F.when((weeks - F.col("_d") + 1 <= last), weeks)
    ordinal = F.when(F.expr("_d between 1 and 366"), days_from_civil("_y", "1", "1") + F.col("_d") - 1)
    ordinal = F.when(ordinal < days_from_civil("_y + 1", "1", "1"), ordinal)
    numeric = F.col("_family") == "numeric"
    fixed = F.when(F.col("_family") == "week", weeks).when(F.col("_family") == "ordinal", ordinal).when(numeric, F.lit(None)).otherwise(day("_y", "_m", "_d"))
    return df.withColumns({
        "_day": fixed.cast("bigint"),
        # the groups of 'numeric' are: last number as _y, first as _m, second as _d
        "_dmy": F.when(numeric, day(y4, "_d", "_m")),
        "_mdy": F.when(numeric, day(y4, "_m", "_d")),
        "_ymd": F.when(numeric & F.expr("_y < 100"), day("if(_m < 70, 2000, 1900) + _m", "_d", "_y")),
    })


def _likelihood(day: Column) -> Column:
    """Of a reading, by its distance before the fetch time: bounded steps, so that the counts stay sufficient."""
    lag = (F.col("_near_us") / F.lit(DAY_US)) - day
    return (
        F.when(day.isNull(), 0.0).when(F.col("_near_us").isNull(), 1.0).when(lag.between(-2, 2), 1.0).when(lag.between(2, 45), 0.3).when(lag.between(45, 400), 0.05).otherwise(0.02)
    )


def order_mixtures(days: DataFrame, rounds: int = 30, prior: float = 0.05) -> DataFrame:
    """The weight of each day/month order per source, by expectation-maximisation over the counts of likelihood classes.

    Returns ``_source, w_dmy, w_mdy, w_ymd, n``. A hot source is pre-aggregated to at most 125 classes before its group
    is formed.
    """
    classes = (
        days.filter("_family = 'numeric'")
        .groupBy("_source", *[_likelihood(F.col(f"_{o}")).alias(f"l_{o}") for o in ORDERS])
        .agg(F.count("*").alias("n"))
    )

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        like = pdf[[f"l_{o}" for o in ORDERS]].to_numpy(float)
        n = pdf["n"].to_numpy(float)
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            r = like * w
            total = r.sum(1) + NOISE * 0.02
            r = r / total[:, None]
            # a sparse prior: an order that explains a tenth of a source's values or less is left to noise
            found = (r * n[:, None]).sum(0)
            w = prior * 0.01 + np.maximum(found - 0.1 * n.sum(), 0)
            w = w / w.sum()
        return pd.DataFrame({"_source": [key[0]], "w_dmy": [w[0]], "w_mdy": [w[1]], "w_ymd": [w[2]], "n": [int(n.sum())]})

    return classes.groupBy("_source").applyInPandas(fit, "_source string, w_dmy double, w_mdy double, w_ymd double, n long")


def fitted_orders(values: DataFrame) -> DataFrame:
    """:func:`order_mixtures` of the values. Only texts that begin like a numeric date are read: no other has an order to tell."""
    numeric = values.filter(F.col("_text").rlike(r"(?U)^\s*[0-9０-９]{1,2}[./\-／．－][0-9０-９]"))
    return order_mixtures(_settle(_days(read_texts(numeric, "_text")).select("_source", "_near_us", "_family", *[f"_{o}" for o in ORDERS])))


def normalise(values: DataFrame, threshold: float = 0.95, mixtures: DataFrame | None = None) -> DataFrame:
    """One instant per value, or why there is none.

    ``values``: ``_key`` (any type), ``_source STRING``, ``_home STRING`` (home zone of the source, may be null),
    ``_near_us BIGINT`` (fetch time, may be null), ``_text STRING``. Adds ``status``, ``family``, ``chosen_order``,
    ``posterior`` and ``instant_us``. ``mixtures``: the result of :func:`order_mixtures` from earlier data, else fitted
    on ``values``.
    """
    days = _settle(_days(read_texts(values, "_text")).drop("_s", "_p"))
    weights = bounded(fitted_orders(values) if mixtures is None else mixtures)
    df = days.join(weights.drop("n"), "_source", "left")
    post = {o: F.coalesce(F.col(f"w_{o}"), F.lit(1 / 3)) * _likelihood(F.col(f"_{o}")) for o in ORDERS}
    total = post["dmy"] + post["mdy"] + post["ymd"] + F.lit(NOISE * 0.02)
    df = df.withColumns({f"_post_{o}": F.when(F.col("_family") == "numeric", c / total) for o, c in post.items()})
    best = F.greatest(*[F.col(f"_post_{o}") for o in ORDERS])
    order = F.when(F.col("_post_dmy") >= best, F.lit("dmy")).when(F.col("_post_mdy") >= best, F.lit("mdy")).when(F.col("_post_ymd") >= best, F.lit("ymd"))
    df = df.withColumns({"_best": best, "_order": order})
    picked = F.when(F.col("_order") == "dmy", F.col("_dmy")).when(F.col("_order") == "mdy", F.col("_mdy")).otherwise(F.col("_ymd"))
    valid = sum(F.col(f"_{o}").isNotNull().cast("int") for o in ORDERS)
    same = F.size(F.array_distinct(F.filter(F.array("_dmy", "_mdy", "_ymd"), lambda x: x.isNotNull()))) == 1
    numeric = F.col("_family") == "numeric"
    # the only valid reading may still be one that its source never uses: then noise has the larger share
    open_order = numeric & (valid > 0) & (F.col("_best") < threshold) & ~(same & (sum(F.col(f"_post_{o}") for o in ORDERS) >= threshold))
    df = df.withColumns({"_pick": F.when(numeric, picked).otherwise(F.col("_day")), "_open": F.coalesce(open_order, F.lit(False)), "_valid": valid})
    local = F.col("_pick") * F.lit(DAY_US) + F.col("_clock")
    digits = F.length("_b")
    number = F.col("_b").try_cast("bigint")
    epoch = F.when(digits <= 10, number * 1_000_000).when(digits <= 13, number * 1000).when(digits <= 16, number).otherwise(F.floor(number / 1000))
    df = df.withColumns({"_local": F.when(F.col("_family") != "epoch", local), "_epoch": F.when(F.col("_family") == "epoch", epoch.cast("bigint"))})
    # zones
    zones = ", ".join(f"'{z}'" for z in sorted(available_timezones()))
    known = lambda column: F.expr(f"{column} in ({zones})")
    sign = F.when(F.substring("_off", 1, 1) == "+", 1).otherwise(-1)
    off = F.regexp_replace(F.substring("_off", 2, 6), ":", "")
    off_min = F.when(F.col("_off") != "", sign * (F.substring(off, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(off, 3, 2).try_cast("int"), F.lit(0))))
    meanings = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.array(*[F.lit(o) for o in v]))])
    generic = F.create_map(*[F.lit(x) for kv in GENERIC_ZONES.items() for x in kv])
    home = F.when(known("_home"), F.col("_home"))
    here = F.transform(
        F.array(*[F.col("_local") + F.lit(d * DAY_US) for d in range(-240, 121, 60)]),
        lambda t: F.floor(_offset_us(t, F.coalesce(home, F.lit("UTC"))) / 60_000_000).cast("int"),
    )
    many = F.try_element_at(meanings, F.col("_abbr"))
    used = F.when(F.size(many) == 1, many).otherwise(F.array_intersect(many, here))
    abbr_min = F.when(F.size(used) == 1, F.get(used, F.lit(0)))
    df = df.withColumn("_min", F.coalesce(off_min, F.when(F.col("_bracket") != "", F.lit(None)).when(F.col("_abbr") != "", abbr_min)))
    zone = (
        F.when(F.col("_min").isNotNull(), F.lit(None))
        .when(F.col("_bracket") != "", F.when(known("_bracket"), F.col("_bracket")))
        .when(F.col("_abbr") != "", F.try_element_at(generic, F.col("_abbr")))
        .otherwise(home)
    )
    df = df.withColumn("_zone", zone)
    safe = F.coalesce(F.col("_zone"), F.lit("UTC"))
    candidates = F.array_distinct(F.array(*[F.col("_local") - _offset_us(F.col("_local") + F.lit(d), safe) for d in (-DAY_US, DAY_US)]))
    fitting = F.filter(candidates, lambda u: u + _offset_us(u, safe) == F.col("_local"))
    df = _settle(df.withColumn("_fit", F.when(F.col("_zone").isNotNull() & F.col("_local").isNotNull(), fitting)))
    status = (
        F.when(F.col("_text").isNull() | (F.trim(F.regexp_replace("_text", r"(?U)\s+", " ")) == ""), "null")
        .when(F.col("_epoch").isNotNull(), "ok")
        .when(F.trim("_text").rlike(RELATIVE), "relative")
        .when(F.col("_family").isNull() | F.col("_clock").isNull() | (numeric & (F.col("_valid") == 0)), "unparsed")
        .when(F.col("_open") & (F.col("_valid") > 1), "ambiguous")
        .when(F.col("_open") | F.col("_local").isNull(), "unparsed")
        .when(F.col("_min").isNotNull(), F.when(F.abs("_min") <= 18 * 60, "ok").otherwise("unknown_zone"))
        .when(F.col("_zone").isNull(), "unknown_zone")
        .when(F.size("_fit") == 1, "ok")
        .when(F.size("_fit") == 0, "gap")
        .otherwise("overlap")
    )
    df = df.withColumn("status", status)
    instant = F.coalesce(F.col("_epoch"), F.col("_local") - F.col("_min").cast("bigint") * 60_000_000, F.get("_fit", F.lit(0)))
    df = df.withColumns({
        "instant_us": F.when(F.col("status") == "ok", instant.cast("bigint")),
        "family": F.col("_family"),
        "chosen_order": F.when(numeric, F.col("_order")),
        "posterior": F.col("_best"),
    })
    return _settle(df.select(*values.columns, "status", "family", "chosen_order", "posterior", "instant_us"))


def digest_values(items: DataFrame, clusters: DataFrame, sources: DataFrame) -> DataFrame:
    """The published_at texts of items and clusters in the shape :func:`normalise` takes; the key is ``rec`` and ``rec_key``."""
    a = items.select(
        F.lit("item").alias("rec"), F.col("item_id").cast("string").alias("rec_key"), F.col("source_id").alias("_source"),
        F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("_near_us"), F.col("published_at").alias("_text"),
    )
    b = clusters.select(
        F.lit("cluster").alias("rec"), F.col("cluster_id").alias("rec_key"), F.get("cluster_items", F.lit(0)).getField("source_id").alias("_source"),
        F.lit(None).cast("bigint").alias("_near_us"), F.col("published_at").alias("_text"),
    )
    zones = bounded(sources.select(F.col("source_id").alias("_source"), F.col("home_zone").alias("_home")).dropDuplicates(["_source"]))
    return spread(a.unionByName(b)).join(zones, "_source", "left")
