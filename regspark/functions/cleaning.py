"""Cleaning and coercion of dirty register text, as column expressions.

Coercions return the value, NULL where it is missing or unusable; `*_error` functions say why a
non-empty input gave NULL, so that a row can be kept and its defect reported.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as no data, compared in capitals without accents.
BLANKS = ["", "-", "--", "---", ".", "N/A", "NA", "N.A.", "S/N", "SN", "NULL", "NONE", "NINGUNO", "NINGUNA", "NO APLICA", "NO DISPONIBLE", "SIN DATO", "SIN DATOS", "SIN INFORMACION", "SIN NOMBRE", "#N/A", "#VALUE!", "0000-00-00"]
#: Accepted yes and no words.
YES, NO = ["SI", "S", "X", "1", "TRUE", "VERDADERO", "V", "Y", "YES"], ["NO", "N", "0", "FALSE", "FALSO", "F"]
#: Spanish month abbreviations.
MONTHS = {"ENE": 1, "FEB": 2, "MAR": 3, "ABR": 4, "MAY": 5, "JUN": 6, "JUL": 7, "AGO": 8, "SEP": 9, "SET": 9, "OCT": 10, "NOV": 11, "DIC": 12}
#: Characters of Windows-1252 above U+00FF and their bytes.
CP1252 = {"€": 0x80, "‚": 0x82, "ƒ": 0x83, "„": 0x84, "…": 0x85, "†": 0x86, "‡": 0x87, "ˆ": 0x88, "‰": 0x89, "Š": 0x8A, "‹": 0x8B, "Œ": 0x8C, "Ž": 0x8E, "‘": 0x91, "’": 0x92, "“": 0x93, "”": 0x94, "•": 0x95, "–": 0x96, "—": 0x97, "˜": 0x98, "™": 0x99, "š": 0x9A, "›": 0x9B, "œ": 0x9C, "ž": 0x9E, "Ÿ": 0x9F}
_SUSPECT = "[Â-ô][\u0080-¿" + "".join(CP1252) + "]"
_ACCENTED = "ÁÀÂÄÃÅáàâäãåÉÈÊËéèêëÍÌÎÏíìîïÓÒÔÖÕóòôöõÚÙÛÜúùûüÑñÇçÝýÿ"
_PLAIN = "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuNnCcYyy"


def deaccent(c: Column) -> Column:
    """Latin letters without their accents."""
    return F.translate(c, _ACCENTED, _PLAIN)


def sanitize(c: Column) -> Column:
    """Control characters, DEL, NBSP and U+FFFD become spaces; white space is collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, "[\\x00-\\x20\\x7f �]+", " "))


def nullify(c: Column) -> Column:
    s = sanitize(c)
    return F.when(~F.upper(deaccent(s)).isin(BLANKS), s)


def header_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(deaccent(sanitize(c))), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def tax_id(c: Column) -> Column:
    """Thirteen digits, padded on the left; NULL if there is none or too many."""
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(d).between(1, 13), F.lpad(d, 13, "0"))


def tax_id_note(c: Column) -> Column:
    """too_long (no value), province (value kept, first two digits not 01 to 24) or NULL."""
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(d) > 13, "too_long").when(~F.substring(tax_id(c), 1, 2).between("01", "24"), "province")


def _full_year(y: Column) -> Column:
    short = y.cast("int")
    return F.when(F.length(y) == 2, F.when(short <= 30, short + 2000).otherwise(short + 1900)).otherwise(short)


def date(c: Column, last_year: int = 2100) -> Column:
    """Day first (d/m/y), year first, Spanish month names, spreadsheet serials; impossible dates are NULL."""

    def made(year: Column, month: Column, day: Column) -> Column:
        text = F.format_string("%04d-%02d-%02d", year, month.cast("int"), day.cast("int"))
        return F.when(year.between(1800, last_year), F.try_to_date(text, "yyyy-MM-dd"))

    day_first, year_first = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2})$", r"^(\d{4})[/.\-](\d{1,2})[/.\-](\d{1,2})"
    named = r"^(\d{1,2})[\s/.\-]+([A-Za-zÁÉÍÓÚáéíóú]{3,10})[\s/.\-]+(\d{4}|\d{2})$"

    def read(s: Column) -> Column:
        g = lambda p, k: F.regexp_extract(s, p, k)
        month = F.element_at(F.create_map(*(x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(v)))), F.upper(F.substring(deaccent(g(named, 2)), 1, 3)))
        serial = F.when(s.rlike(r"^\d{1,5}$") & s.cast("int").between(1, 80000) & (s.cast("int") != 60), F.date_add(F.lit("1899-12-30").cast("date"), s.cast("int")))
        return F.when(s.rlike(day_first), made(_full_year(g(day_first, 3)), g(day_first, 2), g(day_first, 1))).when(s.rlike(year_first), made(g(year_first, 1).cast("int"), g(year_first, 2), g(year_first, 3))).when(s.rlike(named) & month.isNotNull(), made(_full_year(g(named, 3)), month, g(named, 1))).otherwise(serial)

    # The cleaned text is an array's only element, so that it is worked out once and not in each branch.
    return F.get(F.transform(F.array(nullify(c)), read), F.lit(0))


def number(c: Column) -> Column:
    """decimal(18,2). Of two separators the last is the decimal one; a single one with one or
    two digits after it is decimal, else it separates thousands."""
    s = F.regexp_replace(nullify(c), "[^0-9.,-]", "")
    commas, dots = F.regexp_count(s, F.lit(",")), F.regexp_count(s, F.lit("[.]"))
    plain = (
        F.when((commas > 0) & (dots > 0) & (F.length(F.substring_index(s, ",", -1)) < F.length(F.substring_index(s, ".", -1))), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when((commas > 0) & (dots > 0), F.replace(s, F.lit(","), F.lit("")))
        .when((commas == 1) & s.rlike(",[0-9]{1,2}$"), F.replace(s, F.lit(","), F.lit(".")))
        .when(commas > 0, F.replace(s, F.lit(","), F.lit("")))
        .when((dots == 1) & s.rlike("[.][0-9]{1,2}$"), s)
        .otherwise(F.replace(s, F.lit("."), F.lit("")))
    )
    return plain.try_cast("decimal(18,2)")


def amount(c: Column) -> Column:
    """A statement amount: comma decimal, zero and blank are NULL (absent)."""
    v = F.replace(F.regexp_replace(sanitize(c), "^(-?),", "$10,"), F.lit(","), F.lit(".")).try_cast("decimal(18,2)")
    return F.when(v != 0, v)


def boolean(c: Column) -> Column:
    k = F.upper(deaccent(nullify(c)))
    return F.when(k.isin(YES), True).when(k.isin(NO), False)


def yes_no(c: Column) -> Column:
    """Strictly S or N."""
    return F.when(c == "S", True).when(c == "N", False)


def year(c: Column, last_year: int = 2100) -> Column:
    y = F.regexp_extract(nullify(c), r"(\d{4})", 1).try_cast("int")
    return F.when(y.between(1900, last_year), y)


def year_of_number(c: Column, last_year: int = 2100) -> Column:
    """The year in a numeric cell: itself up to 3000, else that of the spreadsheet day that it counts."""
    n = F.floor(c)
    y = F.when(n <= 3000, n).otherwise(F.year(F.when(n.between(3001, 80000), F.date_add(F.lit("1899-12-30").cast("date"), n.cast("int"))))).cast("int")
    return F.when(y.between(1900, last_year), y)


def text(c: Column) -> Column:
    """Any cell as cleaned text, dates as yyyy-mm-dd."""
    return nullify(c.cast("string"))


def date_prefix(c: Column) -> Column:
    """The date of a timestamp's text: its first ten characters."""
    return date(F.substring(F.trim(c), 1, 10))


def payload_date(c: Column) -> Column:
    """A date that the text begins with as yyyy-mm-dd, or is as d/m/yyyy; NULL before 1900 and after 2100."""
    s = nullify(c)
    day_first = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    parts = [F.regexp_extract(s, day_first, k) for k in (3, 2, 1)]
    written = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(s, 1, 10)).when(s.rlike(day_first), F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")))
    d = F.try_to_date(written, "yyyy-MM-dd")
    return F.when(F.year(d).between(1900, 2100), d)


def payload_number(c: Column) -> Column:
    """The number that is left without anything but digits, points and minus signs; 0 if nothing is left."""
    left = F.regexp_replace(nullify(c), "[^0-9.-]", "")
    return F.when(left == "", 0.0).otherwise(left.try_cast("double"))


def error(c: Column, value: Column, reason: str) -> Column:
    """`reason` where a cell that is not blank gave no value, else NULL."""
    return F.when(nullify(c.cast("string")).isNotNull() & value.isNull(), reason)


def date_error(c: Column, last_year: int = 2100) -> Column:
    return error(c, date(c, last_year), "invalid_date")


def number_error(c: Column) -> Column:
    return error(c, number(c), "invalid_number")


def amount_error(c: Column) -> Column:
    """INVALID for an amount that cannot be read; blank and zero are absent, not wrong."""
    v = F.replace(F.regexp_replace(sanitize(c), "^(-?),", "$10,"), F.lit(","), F.lit(".")).try_cast("decimal(18,2)")
    return F.when((sanitize(c) != "") & v.isNull(), "INVALID")


def year_error(c: Column, last_year: int = 2100) -> Column:
    return error(c, year(c, last_year), "invalid_year")


def boolean_error(c: Column) -> Column:
    return error(c, boolean(c), "invalid_flag")


def category(c: Column) -> Column:
    """A category's spelling without accents and case, white space collapsed."""
    return F.trim(F.regexp_replace(F.upper(deaccent(c)), r"\s+", " "))


def parish_kind(c: Column) -> Column:
    """urbana or rural, else NULL."""
    k = F.trim(F.upper(deaccent(c)))
    return F.when(k.isin("URBANA", "RURAL"), F.lower(k))


def display_status(*states: Column) -> Column:
    return F.coalesce(*states, F.lit("Sin estado"))


def display_location(province: Column, canton: Column, city: Column, jurisdiction: Column) -> Column:
    named = F.concat_ws(" · ", F.nullif(province, F.lit("")), F.nullif(F.coalesce(canton, city), F.lit("")))
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(jurisdiction, F.lit("")), F.lit("Ubicación no disponible"))


def newest_year(*years: Column) -> Column:
    """The latest year of several arrays, any of which may be NULL."""
    return F.array_max(F.concat(*(F.coalesce(y, F.array().cast("array<int>")) for y in years)))


def clamped(c: Column, low: int, high: int) -> Column:
    v = F.regexp_replace(c, "[^0-9-]", "").try_cast("int")
    return F.when(v.between(low, high), v)


def fingerprint(*columns: Column | str) -> Column:
    """md5 of all values in order, NULL as the empty string, true and false as 1 and 0."""
    shown = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    shown = [F.coalesce(F.when(F.typeof(F.col(c) if isinstance(c, str) else c) == "boolean", F.when(t == "true", "1").when(t == "false", "0")).otherwise(t), F.lit("")) for c, t in zip(columns, shown)]
    return F.md5(F.concat_ws("\u001f", *shown).cast("binary"))


def as_uuid(hash_: Column) -> Column:
    """Thirty-two hexadecimal digits in the groups of a UUID."""
    return F.regexp_replace(hash_, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _reread(c: Column) -> Column:
    """The text whose UTF-8 reads as `c` in Windows-1252; NULL if there is none or nothing in `c` looks like it."""
    high = "".join(CP1252)
    low = "".join(chr(b) for b in CP1252.values())
    bytes_ = F.translate(c, high, low)
    raw = F.encode(F.when(c.rlike(_SUSPECT) & bytes_.rlike("^[\\x{0}-\\x{ff}]*$"), bytes_), "ISO-8859-1").cast("string")
    return F.when(F.is_valid_utf8(raw), raw)


def repair_mojibake(c: Column) -> Column:
    """UTF-8 that was read as Windows-1252, put right; any other text is left alone, and so is one
    that would have to be put right twice."""
    return F.get(F.transform(F.array(_reread(c)), lambda fixed: F.when((fixed != "") & _reread(fixed).isNull(), fixed).otherwise(c)), F.lit(0))


def establishment_code(code: Column, register: Column) -> Column:
    """Digits without leading zeros; without a code the middle part of a three-part register number."""
    parts = F.split(register, "-")
    s = F.coalesce(F.nullif(F.regexp_replace(code, " ", ""), F.lit("")), F.when(F.size(parts) == 3, F.get(parts, F.lit(1))))
    return F.regexp_replace(s, "^0+(?=[0-9]+$)", "")


def email_or_null(c: Column) -> Column:
    e = F.lower(F.trim(c))
    return F.when(e.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), e)


def contact_kind(c: Column) -> Column:
    return F.when(c.contains("@"), "email").when(F.regexp_replace(c, r"[\s()+.-]", "").rlike(r"^\d{6,}$"), "phone").otherwise("unknown")


def activity_dotted(code: Column) -> Column:
    return F.when(code.rlike(r"^[A-Z]\d{6}$"), F.concat(F.substring(code, 1, 5), F.lit("."), F.substring(code, 6, 2)))


def activity_levels(code: Column) -> dict[str, Column]:
    c = F.replace(code, F.lit("."), F.lit(""))
    return {"grp": F.substring(c, 1, 4), "division": F.when(c.rlike(r"^[A-Z]\d{2}"), F.substring(c, 1, 3)), "section": F.substring(c, 1, 1)}


def address(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(", ", *(F.nullif(F.trim(p), F.lit("")) for p in parts)), F.lit(""))


def channel_value(channel: Column, value: Column) -> Column:
    """Phones as 7 to 15 digits; anything else as https://host/path, without www. and a last slash."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    url = F.when(F.lower(value).rlike("^https?://"), F.trim(value)).otherwise(F.concat(F.lit("https://"), F.trim(value)))
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    return F.when(channel.isin("phone", "whatsapp"), F.when(F.length(digits).between(7, 15), digits)).when(host.contains("."), F.concat(F.lit("https://"), host, path))
