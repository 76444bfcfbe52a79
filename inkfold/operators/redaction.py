"""Redaction of personal data with validated identifiers and keyed pseudonyms.

Candidates are found by form and then checked: card numbers by the Luhn sum, bank accounts by their remainder modulo 97, addresses and
dates by their ranges. What fails its check is no identifier and stays. What passes becomes a pseudonym: a keyed digest (HMAC-SHA256) of
the value in normal form, so that one person, address or card has the same pseudonym in every topic and run of one key, and none
can be told from it without the key. All of it is column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEX_DIGITS = 12
# Forms of identifiers (fixed values), in the order in which they are looked for. None of them looks around itself, and what may repeat
# before a required character is bounded, so that a long text without any is passed in linear time.
FORMS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}",
    "phone": r"\+[0-9][0-9 ()-]{6,17}[0-9]",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "ip": r"[0-9]+(?:\.[0-9]+){3}",
    "card": r"[0-9](?:[ -]?[0-9])*",
}


def hmac_sha256(value: Column, key: str) -> Column:
    """HMAC-SHA256 of a text, in hexadecimal."""
    import hashlib

    raw = key.encode("utf-8")
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))), 256)


def pseudonym(value: Column, key: str) -> Column:
    return F.substring(hmac_sha256(value, key), 1, HEX_DIGITS)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_valid(number: Column) -> Column:
    """Whether the digits pass the Luhn sum."""
    places = F.transform(F.filter(F.split(F.reverse(number), ""), lambda c: c != ""), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))
    doubled = F.transform(
        places, lambda p: F.when(p["i"] % 2 == 0, p["d"]).when(p["d"] * 2 > 9, p["d"] * 2 - 9).otherwise(p["d"] * 2)
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97_valid(account: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters read as 10 to 35, leaves 1 modulo 97."""
    moved = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        value = F.when(letter, F.ascii(c) - 55).otherwise(c.cast("int"))
        return (rest * F.when(letter, 100).otherwise(10) + value) % 97

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def _checked(kind: str) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Normal form of a candidate, and whether the normal form is valid."""
    true = F.lit(True)
    if kind == "email":
        return F.lower, lambda v: true
    if kind == "iban":
        return lambda v: F.replace(v, F.lit(" "), F.lit("")), mod97_valid
    if kind == "phone":
        return _digits, lambda v: F.length(v).between(8, 15)
    if kind == "date":
        return lambda v: v, lambda v: F.substring(v, 6, 2).cast("int").between(1, 12) & F.substring(v, 9, 2).cast("int").between(1, 31)
    if kind == "ip":
        return lambda v: v, lambda v: F.forall(F.split(v, r"\."), lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))
    return _digits, lambda v: F.length(v).between(13, 19) & luhn_valid(v)


def redact_text(text: Column, kind: str, key: str) -> Column:
    """``text`` with every valid identifier of one kind replaced by ``[kind:pseudonym]``. A null text stays null."""
    found = F.zip_with(F.split(text, FORMS[kind], -1), F.regexp_extract_all(text, F.lit(FORMS[kind]), F.lit(0)), _piece(kind, key))
    return F.when(text.rlike(FORMS[kind]), F.array_join(found, "")).otherwise(text)


def _piece(kind: str, key: str) -> Callable[[Column, Column], Column]:
    """A gap of a text and the candidate behind it (null behind the last gap), redacted."""
    normal, valid = _checked(kind)

    def told(gap: Column, hit: Column) -> Column:
        v = normal(hit)
        name = F.concat(F.lit(f"[{kind}:"), pseudonym(v, key), F.lit("]"))
        return F.concat(gap, F.coalesce(F.when(valid(v), name).otherwise(hit), F.lit("")))

    return told


def redact_personal(events: DataFrame, key: str, people: Sequence[str] = ("user_id",), texts: Sequence[str] = ("query_text", "corrected_text")) -> DataFrame:
    """Events whose ``people`` columns hold pseudonyms (blank ids null) and whose ``texts`` hold no valid identifier. A person has one
    pseudonym in all topics redacted with one key, also where a text names them by e-mail. Columns that are not there are passed over."""
    changed = {c: pseudonym(F.lower(F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))), key) for c in people if c in events.columns}
    out = events.withColumns(changed)
    # One kind after the other, each a projection of its own, so that no expression is taken twice.
    for c in texts:
        if c in events.columns:
            for kind in FORMS:
                out = out.withColumn(c, redact_text(F.col(c), kind, key))
    return out
