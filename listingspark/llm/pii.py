"""Format-preserving pseudonyms of personal values by keyed Feistel permutations.

Every kind of value has a set of valid values that is numbered or written as two halves; some
rounds add a keyed hash of one half to the other, which permutes that set. So a valid value
becomes another valid value of its format, equal values become equal pseudonyms in all
documents, and different values stay different. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
# Patterns by kind. Those matched earlier in the list win at the same place.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"\b(?:password|passwd|pwd|secret|token|api_key)\s{0,3}[=:]\s{0,3}[\"']?[0-9a-f]{12,}\b",
    "key": r"\bAKIA[A-Z0-9]{16}\b",
    "phone": r"(?<![\d+.-])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\d])",
    "date": r"(?<![\d.])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)",
}
_ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())
# The Gregorian calendar repeats after so many days, 189 * 773.
_FIRST_DAY, _CYCLE = "1800-01-01", (189, 773)


def _keyed(key: str, *parts: Column) -> Column:
    """A number below 2**56 from a keyed hash."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256), 1, 14), 16, 10).cast("long")


def permuted(left: Column, right: Column, left_size: Column, right_size: Column, key: str, kind: str) -> Column:
    """Feistel rounds over the pairs below (left_size, right_size): a permutation, as struct(l, r)."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    rounds = F.array(*[F.lit(i) for i in range(ROUNDS)])

    def step(state: Column, i: Column) -> Column:
        even = F.struct(F.pmod(state["l"] + _keyed(key, F.lit(kind), i, state["r"]), left_size).alias("l"), state["r"].alias("r"))
        odd = F.struct(state["l"].alias("l"), F.pmod(state["r"] + _keyed(key, F.lit(kind), i, state["l"]), right_size).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(rounds, start, step)


def _laid_out(value: Column, digits: Column) -> Column:
    """``digits`` in the places of the digits of ``value``, other characters kept."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(state: Column, c: Column) -> Column:
        digit = F.rlike(c, F.lit("[0-9]"))
        return F.struct(F.concat(state["out"], F.when(digit, F.substr(digits, state["n"] + 1, F.lit(1))).otherwise(c)).alias("out"), (state["n"] + digit.cast("int")).alias("n"))

    return F.aggregate(F.split(value, ""), start, step)["out"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """Sum of digits, each second one from the right doubled; which, says ``doubled_from_right``."""
    at = F.split(F.reverse(digits), "")
    twice = F.transform(at, lambda c, i: F.when(i % 2 == doubled_from_right, c.cast("int") * 2).otherwise(c.cast("int")))
    return F.aggregate(F.transform(twice, lambda d: F.when(d > 9, d - 9).otherwise(d)), F.lit(0), lambda a, d: a + d)


def _card(value: Column, key: str) -> Column:
    """First digit kept, the others permuted, the check digit made anew; null if the check fails."""
    d = _digits(value)
    n = F.length(d)
    body = F.substr(d, F.lit(2), n - 2)
    u = F.floor((n - 2) / 2).cast("int")
    v = n - 2 - u
    size = lambda k: F.round(F.pow(F.lit(10.0), k)).cast("long")
    p = permuted(F.substr(body, F.lit(1), u).cast("long"), F.substr(body, u + 1, v).cast("long"), size(u), size(v), key, "card")
    made = F.concat(F.substr(d, F.lit(1), F.lit(1)), F.lpad(p["l"].cast("string"), u, F.lit("0")), F.lpad(p["r"].cast("string"), v, F.lit("0")))
    check = F.pmod(-_luhn_sum(made, 0), F.lit(10)).cast("string")
    return F.when(_luhn_sum(d, 1) % 10 == 0, _laid_out(value, F.concat(made, check)))


def _phone(value: Column, key: str) -> Column:
    """All ten digits: 10**5 * 10**5 numbers. A country digit before them stays."""
    d = _digits(value)
    local = F.right(d, F.lit(10))
    half = lambda at: F.substr(local, F.lit(at), F.lit(5)).cast("long")
    p = permuted(half(1), half(6), F.lit(100_000), F.lit(100_000), key, "phone")
    text = F.concat(F.lpad(p["l"].cast("string"), 5, "0"), F.lpad(p["r"].cast("string"), 5, "0"))
    return _laid_out(value, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), text))


def _ssn(value: Column, key: str) -> Column:
    """Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999."""
    part = lambda a, n: F.substr(value, F.lit(a), F.lit(n)).cast("long")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    p = permuted(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")
    new_area = p["l"] + F.when(p["l"] >= 665, 2).otherwise(1)
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.when(valid, F.concat_ws("-", pad(new_area, 3), pad(F.floor(p["r"] / 9999) + 1, 2), pad(p["r"] % 9999 + 1, 4)))


def _ip(value: Column, key: str) -> Column:
    octet = lambda i: F.element_at(F.split(value, r"\."), i).cast("long")
    valid = F.greatest(*[octet(i) for i in range(1, 5)]) <= 255
    p = permuted(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), F.lit(65_536), F.lit(65_536), key, "ip")
    return F.when(valid, F.concat_ws(".", *[x.cast("string") for h in (p["l"], p["r"]) for x in (F.floor(h / 256), h % 256)]))


def _date(value: Column, key: str) -> Column:
    """Days of one calendar cycle, written as the value was; month first where slashes part it."""
    first = F.to_date(F.lit(_FIRST_DAY))
    out = F.lit(None).cast("string")
    for shape, reads, writes in ((r"^\d+-", "yyyy-MM-dd", "yyyy-MM-dd"), (r"^\d+/", "M/d/yyyy", "MM/dd/yyyy"), (r"^\d+\.", "d.M.yyyy", "dd.MM.yyyy")):
        day = F.datediff(F.try_to_timestamp(F.when(F.rlike(value, F.lit(shape)), value), F.lit(reads)).cast("date"), first).cast("long")
        a, b = _CYCLE
        p = permuted(F.floor(day / b), day % b, F.lit(a), F.lit(b), key, "date")
        made = F.date_format(F.date_add(first, (p["l"] * b + p["r"]).cast("int")), writes)
        out = F.coalesce(out, F.when(day.between(0, a * b - 1), made))
    return out


def _shifted(text: Column, other: Column, i: Column, letters: int, key: str, kind: str) -> Column:
    """Letters and digits of ``text`` moved within their class by a keyed hash of ``other``."""
    stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), F.length(text).cast("string"), other), 256)

    def move(c: Column, at: Column) -> Column:
        by = F.conv(F.substr(stream, at % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int") + F.floor(at / 32).cast("int")
        turn = lambda low, n: F.char(F.lit(low) + (F.ascii(c) - low + by) % n)
        return F.when(F.rlike(c, F.lit("[0-9]")), turn(48, 10)).when(F.rlike(c, F.lit("[a-z]")), turn(97, letters)).when(F.rlike(c, F.lit("[A-Z]")), turn(65, 26)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), move), "")


def _scrambled(value: Column, letters: int, key: str, kind: str) -> Column:
    """Feistel rounds over the two halves of a string of letters and digits."""
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), half).alias("l"), F.substr(value, half + 1).alias("r"))

    def step(state: Column, i: Column) -> Column:
        even = F.struct(_shifted(state["l"], state["r"], i, letters, key, kind).alias("l"), state["r"].alias("r"))
        odd = F.struct(state["l"].alias("l"), _shifted(state["r"], state["l"], i, letters, key, kind).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    mixed = F.aggregate(F.array(*[F.lit(i) for i in range(4)]), start, step)
    return F.concat(mixed["l"], mixed["r"])


def _kind(value: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        kind = F.when(F.rlike(value, F.lit(f"^(?:{pattern})$")), F.lit(name)).otherwise(kind)
    return kind


def _pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The value's pseudonym, null if it isn't valid."""
    local = F.substring_index(value, "@", 1)
    email = F.concat(_scrambled(local, 26, key, "email"), F.lit("@"), F.substring_index(value, "@", -1))
    hidden = F.regexp_extract(value, "[0-9a-f]+$", 0)
    secret = F.concat(F.substr(value, F.lit(1), F.length(value) - F.length(hidden)), _scrambled(hidden, 6, key, "secret"))
    access = F.concat(F.lit("AKIA"), _scrambled(F.substr(value, F.lit(5)), 26, key, "key"))
    made = {"email": email, "secret": secret, "key": access, "phone": _phone(value, key), "ssn": _ssn(value, key), "card": _card(value, key), "date": _date(value, key), "ip": _ip(value, key)}
    out = F.lit(None).cast("string")
    for name, column in made.items():
        out = F.when(kind == name, column).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, *, text: str = "text", key: str = "pseudonyms") -> DataFrame:
    """``docs`` with personal values in the text replaced; ``pii`` lists kind and pseudonym in order.

    Values that fail their check (Luhn sum, number ranges, calendar) stay as they are. Null texts
    stay null and empty ones empty, with an empty list; a column named ``pii`` is replaced. Each
    row is handled alone, so repeated rows come out alike. ``key`` should be kept secret.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(_ALL), F.lit(0))
    between = F.split(F.col(text), _ALL)
    kinds = F.transform(found, lambda m: F.struct(m.alias("value"), _kind(m).alias("kind")))
    made = F.transform("__kinds", lambda m: F.struct(m["value"].alias("value"), m["kind"].alias("kind"), _pseudonym(m["value"], m["kind"], key).alias("made")))
    # A text without values skips all of this, and each step is computed once.
    steps = docs.withColumn("__kinds", F.coalesce(kinds, F.array().cast("array<struct<value: string, kind: string>>"))).withColumn("__made", made)
    pieces = F.zip_with(between, "__made", lambda a, m: F.concat(a, F.coalesce(m["made"], m["value"], F.lit(""))))
    replaced = F.when(F.exists("__made", lambda m: m["made"].isNotNull()), F.array_join(pieces, "")).otherwise(F.col(text))
    listed = F.transform(F.filter("__made", lambda m: m["made"].isNotNull()), lambda m: F.struct(m["kind"].alias("kind"), m["made"].alias("pseudonym")))
    return steps.withColumn(text, replaced).withColumn("pii", listed).drop("__kinds", "__made")
