"""Validators as columns: required, pattern, enumeration, const, formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema.layer import Attribute
from ..schema.terms import MEANINGS

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HOST_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_TIME = r"(?:[01]\d|2[0-3]):[0-5]\d:(?:[0-5]\d|60)(?:\.\d+)?(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)"
_IPV6 = (
    r"(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}$)(?!.*::.*::)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?)"
)
_REFERENCE = r"[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]*"
#: Format name to regular expression of the whole value.
FORMATS = {
    "time": _TIME,
    "duration": r"P(?!$)(?:\d+Y)?(?:\d+M)?(?:\d+D)?(?:T(?=\d)(?:\d+H)?(?:\d+M)?(?:\d+(?:\.\d+)?S)?)?|P\d+W",
    "hostname": rf"(?=.{{1,253}}\.?$){_HOST_LABEL}(?:\.{_HOST_LABEL})*\.?",
    "email": rf"(?=.{{3,254}}$)[A-Za-z0-9.!#$%&'*+/=?^_`{{|}}~-]{{1,64}}@(?:{_HOST_LABEL}(?:\.{_HOST_LABEL})*|\[{_OCTET}(?:\.{_OCTET}){{3}}\])",
    "ipv4": rf"{_OCTET}(?:\.{_OCTET}){{3}}",
    "ipv6": _IPV6,
    "uri": rf"[A-Za-z][A-Za-z0-9+.-]*:{_REFERENCE}",
    "iri": r"[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]*",
    "uri-reference": _REFERENCE,
    "iri-reference": r"[^\s<>\"{}|\\^`]*",
    "uri-template": r"(?:[^{}\s]|\{[+#./;?&=,!@|]?[A-Za-z0-9_.,:*%]+\})*",
    "json-pointer": r"(?:/(?:[^~/]|~[01])*)*",
    "relative-json-pointer": r"(?:0|[1-9]\d*)(?:#|(?:/(?:[^~/]|~[01])*)*)",
    "uuid": r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
}
FORMATS |= {"ip-address": FORMATS["ipv4"], "uriref": FORMATS["uri-reference"], "uri-ref": FORMATS["uri-reference"], "idn-email": FORMATS["email"], "idn-hostname": FORMATS["hostname"]}


def is_format(name: str, value: Column) -> Column:
    """Whether a value has a JSON-Schema format; unknown formats accept all."""
    if name == "date":
        return value.rlike(r"^\d{4}-\d\d-\d\d$") & F.try_to_date(value, "yyyy-MM-dd").isNotNull()
    if name == "date-time":
        return is_format("date", F.substring(value, 1, 10)) & F.substring(value, 11, 200).rlike(rf"^[Tt]{_TIME}$")
    if name == "period":
        parts = F.split(value, "/")
        either = lambda v: is_format("date-time", v) | is_format("duration", v)
        return (F.size(parts) == 2) & F.coalesce(either(parts[0]) & either(parts[1]), F.lit(False))
    if name == "regex":
        # brackets and parentheses must balance once escapes and classes are gone
        bare = F.regexp_replace(F.regexp_replace(value, r"\\.", ""), r"\[\^?\]?[^\]]*\]", "")
        return ~bare.rlike(r"[\[\\]") & (F.length(F.regexp_replace(bare, r"[^(]", "")) == F.length(F.regexp_replace(bare, r"[^)]", ""))) & ~bare.rlike(r"^[*+?]")
    return value.rlike(rf"^(?:{FORMATS[name]})$") if name in FORMATS else F.lit(True)


def checks(a: Attribute, value: Column) -> list[tuple[str, Column]]:
    """(validator, whether the value passes) of an attribute; a null value only fails `required`."""
    out = []
    if a.kind == "Value" and a.one("validation/required").lower() == "true":
        out.append(("required", value.isNotNull()))
    if p := a.one("validation/pattern"):
        out.append(("pattern", value.rlike(p)))
    if e := a.many("validation/enumeration"):
        out.append(("enumeration", value.isin(e)))
    if "validation/const" in a.props:
        out.append(("const", value == a.one("validation/const")))
    if f := a.one("validation/json/format"):
        out.append(("format", is_format(f, value)))
    out += [(term, MEANINGS[term].check(a, value)) for term in a.props if term in MEANINGS and MEANINGS[term].check]
    return [(n, F.coalesce(c, F.lit(n != "required")) if n != "required" else c) for n, c in out]


def valid(a: Attribute, value: Column) -> Column:
    return reduce(lambda x, y: x & y, [c for _, c in checks(a, value)], F.lit(True))


def failures(a: Attribute, value: Column) -> Column:
    """Names of the validators that a value fails."""
    found = [F.when(~c, F.lit(n)) for n, c in checks(a, value)]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
