"""Timestamps of mixed formats, precisions and zones brought to UTC milliseconds.

All formats are alternatives of one regular expression with named groups. A text is matched once; its
components come out of a single replacement, are checked against the calendar, and the instant is put
together with integer day arithmetic. Everything stays in JVM expressions.

Defined results: null, blank, unparseable or impossible texts give null; so does a wall-clock time whose
zone is unknown. Repeated rows give repeated results.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names of the written languages, by their first letters without accents.
MONTHS = {
    "jan": 1, "ene": 1, "gen": 1, "feb": 2, "fev": 2, "mar": 3, "mrz": 3, "mae": 3, "apr": 4, "avr": 4, "abr": 4,
    "may": 5, "mai": 5, "mag": 5, "juin": 6, "jun": 6, "giu": 6, "juil": 7, "jul": 7, "lug": 7, "aug": 8, "aou": 8,
    "ago": 8, "sep": 9, "set": 9, "oct": 10, "okt": 10, "ott": 10, "out": 10, "nov": 11, "dec": 12, "dez": 12,
    "dic": 12,
}

# Zone abbreviations and their offsets from UTC in minutes.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "MEZ": 60, "CEST": 120,
    "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "HKT": 480, "SGT": 480, "AWST": 480, "JST": 540,
    "KST": 540, "ACST": 570, "AEST": 600, "ACDT": 630, "AEDT": 660, "NZST": 720, "NZDT": 780, "AST": -240,
    "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480,
    "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

#: Locales that write month before day in all-number dates; all others write day before month.
MONTH_FIRST = ("en-US",)

_DAY = "|".join(
    (
        r"(?<ya>\d{4})(?<qa>[-/.])(?<ma>\d{1,2})\k<qa>(?<da>\d{1,2})",
        r"(?<yb>\d{4})(?<mb>\d{2})(?<db>\d{2})(?!\d)",
        r"(?<na>\d{1,2})(?<qb>[-/.])(?<nb>\d{1,2})\k<qb>(?<yc>\d{4}|\d{2})(?!\d)",
        r"(?<dc>\d{1,2})[-\s./]*(?<wa>\p{L}+)\.?[-\s./]*(?<yd>\d{4}|\d{2})(?!\d)",
        r"(?<wb>\p{L}+)\.?\s+(?<dd>\d{1,2}),?\s+(?<ye>\d{4})",
    )
)
_TIME = "|".join(
    (
        r"(?<ha>\d{1,2}):(?<ia>\d{2})(?::(?<sa>\d{2})(?:[.,](?<fa>\d+)|:(?<ta>\d{1,2}))?)?",
        r"(?<hb>\d{1,2})\.(?<ib>\d{2})\.(?<sb>\d{2})(?:[,.](?<fb>\d+))?",
        r"(?<hc>\d{2})(?<ic>\d{2})(?<sc>\d{2})(?!\d)(?:[.,](?<fc>\d+))?",
    )
)
_CLOCK = rf"(?:{_TIME})(?:\s*(?<ap>[AP])\.?M\.?(?![\p{{L}}/]))?"
_ZONE = r"(?:\s*(?:\(\s*)?(?:UTC|GMT)?(?<zo>[-+]\d{1,2}(?::?\d{2})?)(?:\s*\))?|\s*(?<zn>\p{L}[\p{L}_]*(?:/[\p{L}_+\-\d]+)+)|\s*(?<za>\p{L}{1,5}))?"


def _clock(suffix: str) -> str:
    """The clock pattern with group names of its own, as a name may occur once only."""
    text = _CLOCK + _ZONE
    for name in ("ha", "ia", "sa", "fa", "ta", "hb", "ib", "sb", "fb", "hc", "ic", "sc", "fc", "ap", "zo", "zn", "za"):
        text = text.replace(f"(?<{name}>", f"(?<{name}{suffix}>")
    return text


PATTERN = (
    r"(?iu)^\s*(?:(?<ms>\d{13})|(?<es>\d{10})"
    rf"|(?:\p{{L}}+\.?,\s*)?(?:{_DAY})(?:(?:\s*T\s*|,?\s+){_clock('x')})?"
    rf"|\u0003\s*{_clock('y')})\s*$"
)

_PARTS = {
    "ms": ("ms",), "es": ("es",), "year": ("ya", "yb", "yc", "yd", "ye"), "month": ("ma", "mb"),
    "name": ("wa", "wb"), "day": ("da", "db", "dc", "dd"), "first": ("na",), "second": ("nb",),
    "hour": ("hax", "hbx", "hcx", "hay", "hby", "hcy"), "minute": ("iax", "ibx", "icx", "iay", "iby", "icy"),
    "sec": ("sax", "sbx", "scx", "say", "sby", "scy"), "frac": ("fax", "fbx", "fcx", "fay", "fby", "fcy"),
    "sixtieth": ("tax", "tay"), "ampm": ("apx", "apy"), "offset": ("zox", "zoy"), "zone": ("znx", "zny"),
    "abbr": ("zax", "zay"),
}
_MARK, _SEP = "\u0001", "\u0002"
_REPLACEMENT = _MARK + _SEP.join("".join(f"${{{g}}}" for g in groups) for groups in _PARTS.values())


def components(text: Column, clock_only: bool = False) -> Column:
    """Array of the components of ``text`` as strings, empty where absent; null where nothing matches.

    ``clock_only`` says that the text is a time of day, as ``10.44.58`` alone could be a day too.
    """
    out = F.regexp_replace(F.concat(F.lit("\u0003"), text) if clock_only else text, PATTERN, _REPLACEMENT)
    parts = F.split(out.substr(F.lit(2), F.length(out)), _SEP)
    return F.when(text.isNotNull() & out.startswith(_MARK), parts)


def _part(parts: Column, name: str) -> Column:
    return F.nullif(parts[list(_PARTS).index(name)], F.lit(""))


def _int(c: Column) -> Column:
    return c.cast("int")


def month_number(name: Column) -> Column:
    """Number of a month written in English, German, French, Spanish or Italian; null for other words."""
    plain = F.translate(F.lower(name), "áàâäéèêëíìîïóòôöúùûüç", "aaaaeeeeiiiioooouuuuc")
    key = F.when(plain.startswith("juin"), "juin").when(plain.startswith("juil"), "juil").otherwise(F.substring(plain, 1, 3))
    table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.when(F.length(plain) >= 3, F.try_element_at(table, key))


def epoch_day(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 of a civil date, in integers; null for a day that does not exist."""
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    last = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    valid = month.between(1, 12) & (day >= 1) & (day <= last) & (year >= 1)
    y = F.when(month <= 2, year - 1).otherwise(year).cast("long")
    era = F.floor(y / 400)
    of_era = y - era * 400
    of_year = F.floor((153 * (month + F.when(month > 2, -3).otherwise(9)) + 2) / 5) + day - 1
    return F.when(valid, era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + of_year - 719468)


def day_of(parts: Column, month_first: Column) -> Column:
    """Epoch day stated by components; all-number dates are read in the order that ``month_first`` tells."""
    written = _part(parts, "year")
    year = F.when(F.length(written) == 2, _int(written) + 2000).otherwise(_int(written))
    a, b = _int(_part(parts, "first")), _int(_part(parts, "second"))
    first = F.coalesce(month_first, F.lit(False))
    month = F.coalesce(_int(_part(parts, "month")), month_number(_part(parts, "name")), F.when(first, a).otherwise(b))
    day = F.coalesce(_int(_part(parts, "day")), F.when(first, b).otherwise(a))
    return epoch_day(year, month, day)


def ms_of_day(parts: Column) -> Column:
    """Milliseconds since midnight; null without a time or for a time that does not exist."""
    hour, minute = _int(_part(parts, "hour")), _int(_part(parts, "minute"))
    second = F.coalesce(_int(_part(parts, "sec")), F.lit(0))
    half, sixtieth = F.upper(_part(parts, "ampm")), F.coalesce(_int(_part(parts, "sixtieth")), F.lit(0))
    hour = (
        F.when(half.isNull(), hour)
        .when(~hour.between(1, 12), F.lit(None))
        .otherwise(hour % 12 + F.when(half == "P", 12).otherwise(0))
    )
    fraction = F.coalesce(_int(F.substring(F.rpad(_part(parts, "frac"), 3, "0"), 1, 3)), F.lit(0))
    valid = hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59) & sixtieth.between(0, 59)
    return F.when(
        valid, (hour * 3600 + minute * 60 + second).cast("long") * 1000 + fraction + F.floor(sixtieth * 1000 / 60)
    )


def _stated_offset(parts: Column) -> Column:
    """Minutes east of UTC that a numeric offset or an abbreviation states."""
    sign_digits = F.regexp_replace(_part(parts, "offset"), ":", "")
    digits = F.substring(sign_digits, 2, 4)
    hours = F.when(F.length(digits) <= 2, _int(digits)).otherwise(_int(F.substring(digits, 1, F.length(digits) - 2)))
    minutes = F.when(F.length(digits) <= 2, F.lit(0)).otherwise(_int(F.right(digits, F.lit(2))))
    signed = F.when(sign_digits.startswith("-"), -1).otherwise(1) * (hours * 60 + minutes)
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    return F.coalesce(
        F.when((hours <= 18) & (minutes < 60), signed), F.try_element_at(table, F.upper(_part(parts, "abbr")))
    )


def to_utc_ms(day: Column, clock: Column, states: Column, offset: Column, zone: Column) -> Column:
    """UTC milliseconds of an epoch day and milliseconds of the day.

    ``states`` says whether the text gave an ``offset`` in minutes; else ``zone`` names the clock's zone. A
    doubled wall-clock time means the earlier instant; a skipped one is read with the offset in force before
    the change, which is how ``to_utc_timestamp`` resolves both. Unknown zones give null.
    """
    local = day * 86_400_000 + clock
    known = zone.isin(sorted(zoneinfo.available_timezones()))
    safe = F.when(known, zone).otherwise(F.lit("UTC"))
    named = F.when(known, F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(local), safe)))
    return F.when(states, local - offset * 60_000).otherwise(named)


def instants(rows: DataFrame, day_parts: str, clock_parts: str, month_first: str, wall_zone: str, out: str) -> DataFrame:
    """Adds ``out``: UTC milliseconds of the day in one column of components and the time in another.

    Both may be the same column. The work is laid out as one projection after the other, so that each
    intermediate value is computed once and the generated code stays small.
    """
    d, c = F.col(day_parts), F.col(clock_parts)
    staged = rows.withColumns({
        "_day": day_of(d, F.col(month_first)),
        "_clock": ms_of_day(c),
        "_epoch": F.coalesce(_part(d, "ms").cast("long"), _part(d, "es").cast("long") * 1000),
        "_offset": _stated_offset(c),
        "_states": _part(c, "offset").isNotNull() | _part(c, "abbr").isNotNull(),
        "_named": F.coalesce(_part(c, "zone"), F.col(wall_zone)),
    })
    utc = to_utc_ms(F.col("_day"), F.col("_clock"), F.col("_states"), F.col("_offset"), F.col("_named"))
    return staged.withColumn(out, F.coalesce("_epoch", utc)).drop("_day", "_clock", "_epoch", "_offset", "_states", "_named")


def file_instants(texts: DataFrame, instruments: DataFrame) -> DataFrame:
    """(text_id, keyword, utc_ms) of the acquisition start and the change time of every instrument file.

    A null text_map, a missing entry and an entry without a valid day and time give no row. A null or unknown
    cytometer leaves wall-clock times without a zone, so only texts that state one give a row. Rows that repeat
    a text_id come out once. Other columns of the inputs are ignored.
    """
    clock = instruments.select(
        F.col("cytometer").alias("_cyt"), F.col("iana_zone").alias("_zone"), F.col("site_locale").isin(*MONTH_FIRST).alias("_mf")
    ).dropDuplicates(["_cyt"])
    get = lambda key: F.try_element_at(F.col("text_map"), F.lit(key))
    base = texts.select(
        "text_id", F.col("cytometer").alias("_c"), get("date").alias("_d"), get("btim").alias("_b"), get("last_modified").alias("_l")
    ).filter("text_id IS NOT NULL AND (_d IS NOT NULL OR _l IS NOT NULL)")
    parsed = base.join(clock, F.col("_c") == F.col("_cyt"), "left").select(
        "text_id", "_zone", "_mf", components(F.col("_d")).alias("pd"), components(F.col("_b"), clock_only=True).alias("pb"),
        components(F.col("_l")).alias("pl"), (F.col("_b").isNull() | (F.trim("_b") == "")).alias("no_time"),
    )
    entries = F.array(
        F.struct(F.lit("btim").alias("keyword"), F.col("pd").alias("_dp"), F.when(F.col("no_time"), F.col("pd")).otherwise(F.col("pb")).alias("_cp")),
        F.struct(F.lit("last_modified").alias("keyword"), F.col("pl").alias("_dp"), F.col("pl").alias("_cp")),
    )
    rows = parsed.select("text_id", "_zone", "_mf", F.inline(entries)).filter("_dp IS NOT NULL AND _cp IS NOT NULL")
    done = instants(rows, "_dp", "_cp", "_mf", "_zone", "utc_ms")
    # missing results go within an array: a filter would be pushed down and repeat every expression above
    kept = F.array_compact(F.array("utc_ms"))
    return done.select("text_id", "keyword", F.explode(kept).alias("utc_ms")).distinct()
