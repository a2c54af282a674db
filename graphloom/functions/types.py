"""Typed values: parsing raw strings, formatting, and conversion between types, as columns.

Values are kept as raw strings. parse() gives a native column (null where a value is invalid),
render() the string form of a type, convert() goes from one type to another. Times of day are
strings HH:mm:ss; months, years and the like are ints or structs. Offsets are dropped on
parsing: local fields are kept and read as UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema.layer import SchemaError
from ..schema.terms import TYPE_ALIASES

#: Integer types and their bounds.
INTEGERS = {
    "xsd:byte": (-(2**7), 2**7 - 1), "xsd:short": (-(2**15), 2**15 - 1), "xsd:int": (-(2**31), 2**31 - 1), "xsd:long": (-(2**63), 2**63 - 1), "json:integer": (-(2**63), 2**63 - 1),
    "xsd:unsignedByte": (0, 2**8 - 1), "xsd:unsignedShort": (0, 2**16 - 1), "xsd:unsignedInt": (0, 2**32 - 1), "xsd:unsignedLong": (0, 2**64 - 1),
    "xsd:negativeInteger": (-(2**63), -1), "xsd:nonNegativeInteger": (0, 2**63 - 1), "xsd:positiveInteger": (1, 2**63 - 1), "xsd:nonPositiveInteger": (-(2**63), 0),
}
DATES = ("xsd:date", "json:date", "ls:date")
DATE_TIMES = ("xsd:dateTime", "json:date-time", "ls:dateTime")
TIMES = ("xsd:time", "json:time", "ls:time")
PARTS = ("xsd:gDay", "xsd:gMonth", "xsd:gYear", "xsd:gMonthDay", "xsd:gYearMonth")
UNIX = ("unix:time", "unix:timeNano")
#: Layout elements of Go-style and moment-style formats, longest first, and the Java pattern letters they stand for.
GO_LAYOUT = (("2006", "yyyy"), ("January", "MMMM"), ("Monday", "EEEE"), ("Z07:00", "XXX"), ("-07:00", "xxx"), ("Z0700", "XX"), ("-0700", "xx"), (".000000", ".SSSSSS"), (".000", ".SSS"), ("Jan", "MMM"), ("Mon", "EEE"), ("MST", "zzz"), ("01", "MM"), ("02", "dd"), ("15", "HH"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("06", "yy"), ("PM", "a"), ("_2", "d"), ("1", "M"), ("2", "d"), ("3", "h"), ("4", "m"), ("5", "s"))
MOMENT_LAYOUT = (("YYYY", "yyyy"), ("MMMM", "MMMM"), ("dddd", "EEEE"), ("SSS", "SSS"), ("MMM", "MMM"), ("ddd", "EEE"), ("YY", "yy"), ("MM", "MM"), ("DD", "dd"), ("HH", "HH"), ("hh", "hh"), ("mm", "mm"), ("ss", "ss"), ("ZZ", "xx"), ("Z", "XXX"), ("A", "a"), ("a", "a"), ("M", "M"), ("D", "d"), ("H", "H"), ("h", "h"), ("m", "m"), ("s", "s"))
#: Formats tried where a value's format must be guessed.
GUESSES = ("yyyy-M-d'T'H:m:s[.SSSSSSSSS][.SSSSSS][.SSS][XXX][XX]", "yyyy-M-d H:m:s[.SSSSSS][.SSS][XXX]", "yyyy-M-d[XXX]", "yyyy/M/d[ H:m:s]", "M/d/yyyy[ H:m:s]", "d MMM yyyy[ H:m:s]", "MMM d, yyyy", "MMMM d, yyyy", "yyyyMMdd")


def type_name(name: str) -> str:
    return TYPE_ALIASES.get(name, name)


def java_pattern(layout: str, elements=GO_LAYOUT) -> str:
    """A Java date pattern for a Go-style (or, with MOMENT_LAYOUT, moment-style) layout; other letters are quoted."""
    out, at = "", 0
    while at < len(layout):
        for element, letters in elements:
            if layout.startswith(element, at):
                out, at = out + letters, at + len(element)
                break
        else:
            c = layout[at]
            out, at = out + (f"'{c}'" if c.isalpha() else "''" if c == "'" else c), at + 1
    return out.replace("''", "") if "''" in out and "'" not in layout else out


def _first(tries: list[Column]) -> Column:
    return F.coalesce(*tries)


def _timestamp(value: Column, pattern: str) -> Column:
    return F.try_to_timestamp(value, F.lit(pattern)).cast("timestamp_ntz")


def _local(value: Column) -> Column:
    """The value without a trailing offset: local fields are kept."""
    return F.regexp_replace(value, r"(?<=\d)\s*(?:[Zz]|[+-]\d\d:?\d\d)$", "")


def guess(value: Column) -> Column:
    """A timestamp without zone from any of the usual forms."""
    plain = _local(F.trim(value))
    return _first([F.expr("cast(null as timestamp_ntz)"), *(_timestamp(plain, p) for g in GUESSES for p in _choices(g))])


def _choices(pattern: str) -> list[str]:
    """A pattern without its optional parts of zone, and with each of its optional time parts or none."""
    import re

    head, *options = re.split(r"\[([^]]*)\]", pattern)
    options = [o for o in options if o and "X" not in o]
    return [head + o for o in options] + [head]


def parse_boolean(value: Column, lenient: bool) -> Column:
    if lenient:
        low = F.lower(value)
        return F.when(low.isin("true", "1"), F.lit(True)).when(low.isin("false", "0"), F.lit(False))
    return F.when(value == "true", F.lit(True)).when(value == "false", F.lit(False))


def parse(name: str, value: Column, go: list[str] = (), moment: list[str] = ()) -> Column:
    """A native column: boolean, long (decimal(20,0) for unsignedLong), double, date, timestamp_ntz, string or struct."""
    name = type_name(name)
    if name == "xsd:boolean":
        return parse_boolean(value, True)
    if name == "json:boolean":
        return parse_boolean(value, False)
    if name in INTEGERS:
        low, high = INTEGERS[name]
        kind = "decimal(20,0)" if name == "xsd:unsignedLong" else "bigint"
        number = F.when(value.rlike(r"^[+-]?\d{1,20}$"), value.try_cast(kind))
        return F.when(number.between(F.lit(str(low)).cast("decimal(20,0)"), F.lit(str(high)).cast("decimal(20,0)")), number)
    if name == "xsd:decimal":
        return value.try_cast("double")
    if name in ("json:number", "json:string", "xsd:string", ""):
        return value
    if name in ("ls:date", "ls:dateTime", "ls:time"):
        patterns = [java_pattern(p) for p in go] + [java_pattern(p, MOMENT_LAYOUT) for p in moment]
        whole = _first([_timestamp(value, p) for p in patterns]) if patterns else guess(value)
        return whole.cast("date") if name == "ls:date" else F.date_format(whole, "HH:mm:ss") if name == "ls:time" else whole
    if name == "xsd:date":
        return F.when(value.rlike(r"^\d{4}-\d{1,2}-\d{1,2}(?:[Zz]|[+-]\d\d:?\d\d)?$"), F.try_to_date(_local(value), "yyyy-M-d"))
    if name == "json:date":
        return F.when(value.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_date(value, "yyyy-MM-dd"))
    if name in ("xsd:dateTime", "json:date-time"):
        plain = _local(F.regexp_replace(value, r"(\.\d{6})\d+", "$1"))
        return _first([_timestamp(plain, p) for p in ("yyyy-M-d'T'HH:mm:ss", "yyyy-M-d'T'HH:mm:ss.SSSSSS", "yyyy-M-d'T'HH:mm:ss.SSS")])
    if name in ("xsd:time", "json:time"):
        plain = _local(value)
        return F.when(plain.rlike(r"^(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?$"), F.substring(plain, 1, 8))
    if name in ("xsd:gDay", "xsd:gMonth", "xsd:gYear"):
        number = F.regexp_replace(value, "^-{1,3}(?=\\d)", "").try_cast("int")
        return F.when(number.between(1, {"xsd:gDay": 31, "xsd:gMonth": 12}.get(name, 9999)), number)
    if name in ("xsd:gMonthDay", "xsd:gYearMonth"):
        a, b = (F.regexp_extract(value, r"^(?:--)?(\d{1,4})-(\d{1,2})$", k).try_cast("int") for k in (1, 2))
        names = ("month", "day") if name == "xsd:gMonthDay" else ("year", "month")
        return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias(names[0]), b.alias(names[1])))
    if name in UNIX:
        return value.try_cast("bigint")
    raise SchemaError(f"unknown type {name}")


def _fail(value: Column, source: str, target: str) -> Column:
    return F.when(value.isNotNull(), F.raise_error(F.lit(f"{source} cannot become {target}")).cast("string"))


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def convert(source: str, target: str, value: Column, go: list[str] = (), moment: list[str] = (), target_go: list[str] = (), target_moment: list[str] = (), strict: bool = False) -> Column:
    """The raw string of `target` for a raw string of `source`; null if the value is invalid.

    Pairs that cannot be converted give null, or an error with strict. source "" is a string:
    dates are then guessed.
    """
    source, target = type_name(source), type_name(target)
    none = F.lit(None).cast("string")
    bad = _fail(value, source, target) if strict else none
    if source == target:
        return render(target, parse(source, value, go, moment), target_go, target_moment)
    if target in INTEGERS or target in ("xsd:decimal", "json:number"):
        if source in ("xsd:boolean", "json:boolean"):
            return parse(source, value).cast("int").cast("string")
        if source in (*DATES, *DATE_TIMES, *TIMES):
            return bad
        return render(target, parse(target, value))
    if target in ("xsd:boolean", "json:boolean"):
        return render(target, parse_boolean(value, source != "json:boolean"))
    if target in ("json:string", "xsd:string", ""):
        return value
    stamp = day = clock = None
    if source in DATES:
        day = parse(source, value, go, moment)
        stamp = day.cast("timestamp_ntz")
    elif source in DATE_TIMES:
        stamp = parse(source, value, go, moment)
        day = stamp.cast("date")
        clock = F.date_format(stamp, "HH:mm:ss")
    elif source in TIMES:
        clock = parse(source, value, go, moment)
    elif source in UNIX:
        seconds = parse(source, value) if source == "unix:time" else F.expr("1000000000L").cast("bigint") * 0 + F.floor(parse(source, value) / 1_000_000_000).cast("bigint")
        stamp = F.timestamp_seconds(seconds).cast("timestamp_ntz")
        day, clock = stamp.cast("date"), F.date_format(stamp, "HH:mm:ss")
    elif source == "":
        stamp = guess(value)
        day = stamp.cast("date")
        clock = F.coalesce(parse("xsd:time", value), F.date_format(stamp, "HH:mm:ss"))
    if target in DATES:
        return bad if day is None or (source in TIMES) else render(target, day, target_go, target_moment)
    if target in DATE_TIMES:
        return bad if stamp is None else render(target, stamp, target_go, target_moment)
    if target in TIMES:
        if source in DATES and target != "json:time":
            return bad
        return bad if clock is None and day is None else render(target, F.lit("00:00:00") if clock is None else clock, target_go, target_moment)
    if target in UNIX:
        if source in TIMES:
            stamp = F.concat(F.lit("1970-01-01 "), clock).cast("timestamp_ntz")
        if stamp is None:
            return bad
        seconds = F.unix_timestamp(stamp.cast("string"), "yyyy-MM-dd HH:mm:ss")
        return (seconds if target == "unix:time" else seconds * F.lit(1_000_000_000)).cast("string")
    if target in PARTS:
        if source in PARTS:
            return _part_of_part(source, target, value, bad)
        if day is None or source == "" or source in UNIX:
            return bad
        y, m, d = F.year(day), F.month(day), F.dayofmonth(day)
        return {"xsd:gDay": d.cast("string"), "xsd:gMonth": _two(m), "xsd:gYear": F.lpad(y.cast("string"), 4, "0"), "xsd:gMonthDay": F.concat_ws("-", _two(m), _two(d)), "xsd:gYearMonth": F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), _two(m))}[target] if day is not None else bad
    return bad


def _part_of_part(source: str, target: str, value: Column, bad: Column) -> Column:
    own = parse(source, value)
    if source == "xsd:gMonthDay" and target in ("xsd:gDay", "xsd:gMonth"):
        return own["day"].cast("string") if target == "xsd:gDay" else _two(own["month"])
    if source == "xsd:gYearMonth" and target in ("xsd:gYear", "xsd:gMonth"):
        return F.lpad(own["year"].cast("string"), 4, "0") if target == "xsd:gYear" else _two(own["month"])
    return bad


def merge_part(part: str, value: Column, old_type: str, old: Column) -> Column:
    """Set a day, month or year (or two of them) into an existing date or date-time string."""
    stamp = parse(old_type, old).cast("timestamp_ntz")
    own = parse(part, value)
    y, m, d = F.year(stamp), F.month(stamp), F.dayofmonth(stamp)
    part = type_name(part)
    if part == "xsd:gDay":
        d = own
    elif part == "xsd:gMonth":
        m = own
    elif part == "xsd:gYear":
        y = own
    elif part == "xsd:gMonthDay":
        m, d = own["month"], own["day"]
    else:
        y, m = own["year"], own["month"]
    day = F.try_to_date(F.concat_ws("-", y.cast("string"), m.cast("string"), d.cast("string")), "y-M-d")
    if type_name(old_type) in DATES:
        return render(old_type, day)
    whole = F.concat(day.cast("string"), F.lit(" "), F.date_format(stamp, "HH:mm:ss")).try_cast("timestamp_ntz")
    return render(old_type, whole)


def render(name: str, value: Column, go: list[str] = (), moment: list[str] = ()) -> Column:
    """The raw string of a native value."""
    name = type_name(name)
    pattern = java_pattern(go[0]) if go else java_pattern(moment[0], MOMENT_LAYOUT) if moment else None
    if name in DATES:
        return F.date_format(value, pattern or "yyyy-MM-dd")
    if name in DATE_TIMES:
        plain = F.date_format(value, pattern or "yyyy-MM-dd'T'HH:mm:ss")
        return plain if pattern else F.concat(plain, F.lit("Z"))
    if name in TIMES:
        if pattern:
            return F.date_format(F.concat(F.lit("1970-01-01 "), value).cast("timestamp_ntz"), pattern)
        return F.concat(value, F.lit("Z"))
    if name in ("xsd:gMonthDay", "xsd:gYearMonth"):
        a, b = ("month", "day") if name == "xsd:gMonthDay" else ("year", "month")
        return F.when(value.isNotNull(), F.concat_ws("-", _two(value[a]) if a == "month" else F.lpad(value[a].cast("string"), 4, "0"), _two(value[b])))
    return value.cast("string")


def check(name: str, value: Column) -> Column:
    """Whether a raw value is valid for a type (null is)."""
    native = parse(name, value)
    return value.isNull() | native.isNotNull()


def coerce(kind: str, value: Column) -> Column:
    """Property coercions: integer, float, boolean, string, list, json."""
    return {
        "integer": lambda v: v.try_cast("bigint"),
        "float": lambda v: v.try_cast("double"),
        "boolean": lambda v: parse_boolean(v, True),
        "string": lambda v: v.cast("string"),
        "list": lambda v: F.array(v),
        "json": lambda v: F.to_json(F.try_parse_json(v)),
    }[kind](value)
