"""Times written in many ways, as columns: no Python runs over the rows.

Everything is computed on whole numbers of seconds, so nothing depends on the
session's time zone or on ANSI errors for impossible dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names in English, German, French, Spanish and Swedish, by their first letters after accents are dropped.
MONTHS = {
    1: ["jan", "januar", "january", "janvier", "janv", "enero", "ene", "januari", "jaenner"],
    2: ["feb", "februar", "february", "fevrier", "fevr", "febrero", "februari"],
    3: ["mar", "maerz", "mrz", "march", "mars", "marzo", "marz"],
    4: ["apr", "april", "avril", "avr", "abril", "abr"],
    5: ["may", "mai", "mayo", "maj"],
    6: ["jun", "juni", "june", "juin", "junio"],
    7: ["jul", "juli", "july", "juillet", "juil", "julio"],
    8: ["aug", "august", "aout", "agosto", "ago", "augusti"],
    9: ["sep", "sept", "september", "septembre", "septiembre"],
    10: ["oct", "okt", "october", "oktober", "octobre", "octubre"],
    11: ["nov", "november", "novembre", "noviembre"],
    12: ["dec", "dez", "december", "dezember", "decembre", "diciembre", "dic"],
}
# Zone abbreviations that name one offset, in minutes.
ABBREVIATIONS = {"z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "eet": 120, "eest": 180, "est": -300, "edt": -240, "pst": -480, "pdt": -420, "mst": -420, "mdt": -360, "cdt": -300, "jst": 540, "aest": 600, "aedt": 660}

#: Characters that mean the same as an ASCII one: full-width digits and signs, special blanks, dashes, accented letters.
_PLAIN = (
    {chr(0xFF10 + i): str(i) for i in range(10)}
    | {"\uff1a": ":", "\uff0f": "/", "\uff0e": ".", "\uff0b": "+", "\uff0d": "-", "\uff0c": ",", "\uff54": "t", "\uff5a": "z"}
    | dict.fromkeys("\u00a0\u1680\u2007\u2009\u200a\u202f\u205f\u3000\t", " ")
    | dict.fromkeys("\u2010\u2011\u2012\u2013\u2212", "-")
    | dict.fromkeys("\u201c\u201d\u201e\u00ab\u00bb", '"')
    | {"à": "a", "á": "a", "â": "a", "ä": "a", "å": "a", "é": "e", "è": "e", "ê": "e", "ë": "e", "í": "i", "ó": "o", "ö": "o", "ô": "o", "û": "u", "ü": "u", "ù": "u", "ñ": "n"}
)

_ZONE = (
    r"(?:\s*(?:(utc|gmt)\s*)?([+-])(\d{1,2})(?::?(\d{2}))?\s*(?:\[([a-z]+(?:/[a-z0-9_+-]+)+)\])?"
    r"|\s*([a-z]{1,4})\s*(?:\[([a-z]+(?:/[a-z0-9_+-]+)+)\])?|\s*\[?([a-z]+(?:/[a-z0-9_+-]+)+)\]?)?"
)
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([ap])\.?m\b\.?)?"
# Each form with the order in which its first three groups give year, month and day.
_FORMS = (
    (r"^(\d{4})[-:/.](\d{1,2})[-:/.](\d{1,2})(?:t|_|,?\s+)" + _TIME + _ZONE + "$", "$1|$2|$3"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4}),?\s+" + _TIME + _ZONE + "$", "$3|$2|$1"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4}),?\s+" + _TIME + _ZONE + "$", "$3|$1|$2"),
    (r"^(?:[a-z]+\.?,?\s+)?(\d{1,2})\.?\s+(?:de\s+)?([a-z]+)\.?,?\s+(?:de\s+)?(\d{4}),?\s+(?:[a-z]+\s+)?" + _TIME + _ZONE + "$", "$3|$2|$1"),
    (r"^(?:[a-z]+,\s+)?([a-z]+)\.?\s+(\d{1,2}),?\s+(\d{4}),?\s+(?:at\s+)?" + _TIME + _ZONE + "$", "$3|$1|$2"),
)
_COMPACT = (r"^(\d{4})(\d{2})(\d{2})[t_ ]?(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?()" + _ZONE + "$", "$1|$2|$3")
#: What a text of each form starts with; a text of one form starts as no other does.
_STARTS = (
    (r"^\d{8}", _COMPACT),
    (r"^\d{4}[-:/.]", _FORMS[0]),
    (r"^\d{1,2}\.\d", _FORMS[1]),
    (r"^\d{1,2}/", _FORMS[2]),
    (r"^(?:[a-z]+\.?,?\s+)?\d{1,2}\.?\s+[a-z]", _FORMS[3]),
    (r"^[a-z]", _FORMS[4]),
)
#: Starts what a pattern has rewritten.
_READ = "\u0001"
_EPOCH = r"^(\d{9,10})(?:[.,](\d+))?$"
_EPOCH_MS = r"^(\d{12,13})(?:[.,]\d+)?$"
#: What the groups after the date hold, in their order.
_REST = ("h", "mi", "s", "frac", "half", "utc", "sign", "zh", "zm", "zone1", "abbr", "zone2", "zone3")


def plain_time_text(c: Column) -> Column:
    """Lower-case text with ASCII digits, blanks and dashes, without quotes around it."""
    text = F.translate(F.lower(c), "".join(_PLAIN), "".join(_PLAIN.values()))
    return F.trim(F.regexp_replace(F.regexp_replace(text, "^[\\s\"']+|[\\s\"']+$", ""), r"\s+", " "))


def days_of(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a civil date, by whole-number arithmetic alone."""
    yy = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, F.lit(-3)).otherwise(F.lit(9))) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146097 + doe - 719468).cast("long")


def days_in_month(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def parse_time(df: DataFrame, text: str, parsed: str) -> DataFrame:
    """``df`` with the fields of the time texts in ``text`` as an array of strings in ``parsed``; blank ones where a text has no known form.

    The last field is the plain text itself. A text's start tells its form, so
    only one whole pattern is tried, which rewrites the text to year, month,
    day, then _REST. Each step is a projection of its own, so that what several
    expressions need is computed once, within generated code.
    """
    rest = "|".join(f"${4 + i}" for i in range(len(_REST)))
    blank = "|" * (2 + len(_REST))
    plain, out = F.col("__plain"), F.col("__out")
    rewritten = F.lit("")
    for start, (pattern, date) in reversed(_STARTS):
        rewritten = F.when(plain.rlike(start), F.regexp_replace(plain, pattern, f"{_READ}{date}|{rest}")).otherwise(rewritten)
    fields = F.split(F.concat(F.when(out.startswith(_READ), F.substring(out, 2, 1_000_000)).otherwise(blank), F.lit("|"), plain), r"\|", 4 + len(_REST))
    return df.withColumn("__plain", plain_time_text(F.col(text))).withColumn("__out", rewritten).withColumn(parsed, fields).drop("__plain", "__out")


def read_parts(parsed: Column) -> dict[str, Column]:
    """Columns local_s, sub_ms, offset_min, zone, epoch_ms of an array made by ``parse_time``.

    local_s counts seconds of the wall clock since 1970, offset_min is the offset
    in the text and zone the (lower-case) name of a zone in it; epoch_ms is set
    where the text is a count of seconds or milliseconds since 1970. All are null
    where the text gives no valid date with at least hour and minute.
    """
    month = F.create_map(*[F.lit(x) for n, names in MONTHS.items() for name in sorted(set(names)) for x in (name, n)])
    abbreviation = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v)])
    at = {n: parsed[3 + i] for i, n in enumerate(_REST)}
    whole = lambda c: c.try_cast("int")
    y, m, d = whole(parsed[0]), F.coalesce(whole(parsed[1]), F.try_element_at(month, parsed[1])), whole(parsed[2])
    h, mi, sec = whole(at["h"]), whole(at["mi"]), F.coalesce(whole(at["s"]), F.lit(0))
    hour = F.when(at["half"] == "", h).when(h.between(1, 12), h % 12 + F.when(at["half"] == "p", 12).otherwise(0))
    minutes = whole(at["zh"]) * 60 + F.coalesce(whole(at["zm"]), F.lit(0))
    known = (at["abbr"] == "") | F.try_element_at(abbreviation, at["abbr"]).isNotNull()
    offset_ok = (at["sign"] == "") | ((minutes <= 840) & (F.coalesce(whole(at["zm"]), F.lit(0)) < 60))
    valid = F.coalesce(y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= days_in_month(y, m)) & hour.between(0, 23) & mi.between(0, 59) & sec.between(0, 59) & known & offset_ok, F.lit(False))
    local = days_of(y, m, d) * 86400 + hour * 3600 + mi * 60 + sec
    offset = F.when(at["sign"] != "", minutes * F.when(at["sign"] == "-", -1).otherwise(1)).when(at["abbr"] != "", F.try_element_at(abbreviation, at["abbr"]))
    zone = F.concat(at["zone1"], at["zone2"], at["zone3"])
    text = parsed[3 + len(_REST)]
    thousandths = lambda frac: F.rpad(F.substring(frac, 1, 3), 3, "0").try_cast("int")
    part = F.regexp_extract(text, _EPOCH, 2)
    epoch = F.when(text.rlike(_EPOCH), F.regexp_extract(text, _EPOCH, 1).try_cast("long") * 1000 + F.when(part != "", thousandths(part)).otherwise(0)).when(text.rlike(_EPOCH_MS) & ~valid, F.regexp_extract(text, _EPOCH_MS, 1).try_cast("long"))
    return {
        "local_s": F.when(valid, local.cast("long")),
        "sub_ms": F.when(at["frac"] != "", thousandths(at["frac"])).otherwise(0),
        "offset_min": F.when(valid, offset),
        "zone": F.when(valid & (zone != ""), zone),
        "epoch_ms": epoch,
    }


def to_utc_seconds(local_s: Column, zone: Column) -> Column:
    """The earlier instant of a wall clock in a zone (of a skipped time, one that reads later)."""
    return F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local_s), zone))


def wall_clock(utc_s: Column, zone: Column) -> Column:
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(utc_s), zone))
