"""Value transforms: frozen hashes, network prefixes, clean URLs, derivations.

All are plain column expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe import rules
from hushframe.functions.text import as_text, strip

_V4_HEAD = r"^([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})\.[0-9]{1,3}(?::[0-9]+)?$"
_V6_HEAD = r"^([0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,2}):"
_QUAD = r"(\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.)[0-9]+\b"


def _sha256_or_empty(clean: Column) -> Column:
    return F.when(F.length(clean) > 0, F.sha2(clean, 256)).otherwise("")


def hash_id(value: Column) -> Column:
    """SHA-256 of the stripped text, never salted; blank and NULL give ''."""
    return _sha256_or_empty(strip(value.cast("string")))


def hash_email(value: Column) -> Column:
    """As :func:`hash_id`, in lower case so addresses join across sources."""
    return _sha256_or_empty(F.lower(strip(value.cast("string"))))


def ip_prefix(value: Column) -> Column:
    """Network part of an address: /24 for IPv4, up to /48 for IPv6, else ''.

    A port is dropped and a compressed IPv6 address stops at its first ``::``,
    so no host bits survive.
    """
    address = strip(value.cast("string"))
    v4 = F.regexp_extract(address, _V4_HEAD, 1)
    v6 = F.regexp_extract(address, _V6_HEAD, 1)
    return (
        F.when(F.length(v4) > 0, F.concat(v4, F.lit(".0")))
        .when(F.length(v6) > 0, F.concat(v6, F.lit("::")))
        .otherwise("")
    )


def mask_quads(value: Column) -> Column:
    """Zero the last octet of every dotted quad inside a text."""
    return F.regexp_replace(value, _QUAD, "$10")


def clean_url(value: Column, drop_userinfo: bool = False) -> Column:
    """URL without query, matrix parameters and fragment; quads masked."""
    url = strip(value.cast("string"))
    for mark in "?;#":
        url = F.substring_index(url, mark, 1)
    if drop_userinfo:
        url = F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://)[^/@]*@", "$1")
    return F.coalesce(mask_quads(url), F.lit(""))


def outcode(value: Column) -> Column:
    """First half of a postcode, upper case."""
    return F.coalesce(F.substring_index(F.upper(strip(value.cast("string"))), " ", 1), F.lit(""))


def birth_year(value: Column) -> Column:
    """Leading four digits, else ''."""
    return F.coalesce(F.regexp_extract(strip(value.cast("string")), r"^([0-9]{4})", 1), F.lit(""))


def derive_recipe(field_name: Column) -> Column:
    """Recipe a business field's name asks for, NULL when none fits."""
    name = F.lower(field_name)
    return F.when(name.rlike("|".join(rules.POSTCODE_WORDS)), "uk_postcode_outcode").when(
        name.rlike("|".join(rules.BIRTH_WORDS)), "year_of_birth"
    )


def derive_recipe_of(field_name: str) -> str | None:
    """:func:`derive_recipe` for a name known on the driver."""
    name = field_name.lower()
    if any(word in name for word in rules.POSTCODE_WORDS):
        return "uk_postcode_outcode"
    if any(word in name for word in rules.BIRTH_WORDS):
        return "year_of_birth"
    return None


RECIPES = {
    "ip_prefix": ip_prefix,
    "url_sanitise": clean_url,
    "uk_postcode_outcode": outcode,
    "year_of_birth": birth_year,
}


def apply_action(value: Column, action: str, recipe: str = "", data_type: str = "string") -> Column:
    """Expression for one column whose action is known on the driver.

    RAW and PASS keep the column's own type; text sinks turn it into cell text.
    """
    if action == rules.HASH_EMAIL or (action == rules.HASH and recipe == "email"):
        return hash_email(as_text(value, data_type))
    if action in (rules.HASH_ID, rules.HASH):
        return hash_id(as_text(value, data_type))
    if action == rules.DERIVE:
        derive = RECIPES.get(recipe)
        return derive(as_text(value, data_type)) if derive else F.lit("")
    if action == rules.DROP:
        return F.lit("")
    return value


def apply_action_column(value: Column, action: Column, recipe: Column) -> Column:
    """Cell-wise dispatch for long tables (one row per object, field, value)."""
    chain = F.when(
        (action == rules.HASH_EMAIL) | ((action == rules.HASH) & (recipe == "email")), hash_email(value)
    ).when(action.isin(rules.HASH_ID, rules.HASH), hash_id(value))
    for name, derive in RECIPES.items():
        chain = chain.when((action == rules.DERIVE) & (recipe == name), derive(value))
    return chain.when(action.isin(rules.DERIVE, rules.DROP), "").otherwise(F.coalesce(value, F.lit("")))
