"""Deterministic masks as column expressions. Equal values get equal masks for one salt and preset; values are not kept.

The key is HMAC-SHA256(salt, value); its hex digits are cut into words of 32 bits, one per draw. Null and empty values stay.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: small dictionaries that masks draw from
FIRST_NAMES = ["Ada", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gia", "Hugo", "Iris", "Jon", "Kim", "Leo", "Mia", "Ned", "Ola", "Pia"]
LAST_NAMES = ["Abbot", "Baker", "Clark", "Dixon", "Ellis", "Frost", "Grant", "Hayes", "Irwin", "Jones", "Knox", "Lane", "Moss", "Nash", "Owens", "Price"]
STREETS = ["Oak Street", "Elm Street", "Mill Road", "Park Avenue", "Hill Lane", "Lake Drive", "High Street", "Station Road"]
WORDS = ["alpha", "bravo", "cedar", "delta", "ember", "fable", "grove", "harbor", "island", "jolly", "kernel", "lumen", "meadow", "nectar", "orbit", "pebble"]
# fixed values: what a column's type, and then its name and label in lower case, say about its mask; the first that fits wins
STRATEGIES = [("email", "email", "email"), ("phone", "phone", "phone|mobile|fax"), ("postal-code", None, "postal|zip"), ("street-address", None, "street|address|mailing|billing|shipping"), ("person-name", None, "name|patient")]
TEXT_TYPES = ["string", "textarea", "email", "phone", "url", "encryptedstring"]
PRESETS = ["email", "phone", "person-name", "street-address", "postal-code", "generic-text"]


def pads(salt: str) -> tuple[bytes, bytes]:
    """Inner and outer pad of the salt."""
    key = salt.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def keyed_digest(value: Column, salt: str) -> Column:
    """HMAC-SHA256 as hex digits; null for null."""
    inner, outer = (F.lit(bytearray(p)) for p in pads(salt))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))), 256)


def seed(value: Column, salt: str) -> Column:
    """The first 32 bits, unsigned."""
    return draw(keyed_digest(value, salt), 0)


def draw(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint")


def _pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))


def cap(value: Column, length: Column | int | None) -> Column:
    """At most length characters, where a positive length is known."""
    if length is None:
        return value
    length = F.lit(length) if isinstance(length, int) else length
    return F.when(length > 0, F.substring(value, F.lit(1), length.cast("int"))).otherwise(value)


def preset(name: str, digest: Column) -> Column:
    """The mask of one preset from a keyed digest."""
    a, b, c, d = (draw(digest, k) for k in range(4))
    if name == "email":
        return F.lower(F.concat(_pick(FIRST_NAMES, a), F.lit("."), _pick(LAST_NAMES, b), F.substring(digest, 17, 6), F.lit("@example.com")))
    if name == "phone":
        digits = F.lpad((draw(digest, 0) * 4 + b % 4).cast("string"), 11, "0")
        return F.concat(F.substring(digits, 2, 3), F.lit("-"), F.substring(digits, 5, 3), F.lit("-"), F.substring(digits, 8, 4))
    if name == "person-name":
        return F.concat(_pick(FIRST_NAMES, a), F.lit(" "), _pick(FIRST_NAMES, d), F.lit(" "), _pick(LAST_NAMES, b), F.lit("-"), _pick(LAST_NAMES, c))
    if name == "street-address":
        return F.concat((a % 9899 + 1).cast("string"), F.lit(" "), _pick(STREETS, b))
    if name == "postal-code":
        return (F.lit(10000) + a % 90000).cast("string")
    if name == "generic-text":
        return F.concat(_pick(WORDS, a), _pick(WORDS, b), F.lit(" "), _pick(WORDS, c), _pick(WORDS, d))
    raise ValueError(f"no preset named {name}")


def mask(value: Column, strategy: str, salt: str, length: Column | int | None = None) -> Column:
    """value masked; null and empty stay as they are."""
    return F.when(value.isNull() | (value == ""), value).otherwise(cap(preset(strategy, keyed_digest(value, salt)), length))


def pick_strategy(type_: Column, name: Column, label: Column) -> Column:
    """The preset that a column's type, name and label call for."""
    text = F.lower(F.concat_ws(" ", name, label))
    out = F.lit("generic-text")
    for strategy, kind, pattern in reversed(STRATEGIES):
        hit = text.rlike(pattern) if kind is None else (type_ == kind) | text.rlike(pattern)
        out = F.when(hit, F.lit(strategy)).otherwise(out)
    return out


def mask_by_strategy(value: Column, strategy: Column, salt: str, length: Column | None = None) -> Column:
    """Masks by a strategy that each row names; a strategy that does not exist gives null, so that the row can be rejected."""
    digest = keyed_digest(value, salt)
    out = F.lit(None).cast("string")
    for name in PRESETS:
        out = F.when(strategy == name, cap(preset(name, digest), length)).otherwise(out)
    return F.when(value.isNull() | (value == ""), value).otherwise(out)


ROUNDS, MOST_DIGITS = 8, 36


def permute_digits(value: Column, salt: str, rounds: int = ROUNDS) -> Column:
    """value with its digits replaced by a keyed permutation of all numbers of as many digits; other characters stay in place.

    A Feistel network over two halves, of 10 ** (n // 2) and 10 ** (n - n // 2) values: each round adds a keyed digest of one half
    to the other. Every round can be undone, so different values of one shape get different masks: unique keys stay unique, for
    postal codes, phones and ids of any length. Of more than MOST_DIGITS digits the first ones are permuted. Null and empty
    values stay, and so does one without a digit."""
    ten = lambda n: F.get(F.array(*[F.lit(10**k).cast("bigint") for k in range(MOST_DIGITS // 2 + 1)]), n.cast("int"))
    digits = F.substring(F.regexp_replace(value, "[^0-9]", ""), 1, MOST_DIGITS)
    n = F.length(digits)
    cut = F.floor(n / 2).cast("int")
    number = lambda text: F.coalesce(F.when(text != "", text).cast("bigint"), F.lit(0).cast("bigint"))
    start = F.struct(number(F.substring(digits, F.lit(1), cut)).alias("l"), number(F.substring(digits, cut + 1, n)).alias("r"))

    def step(state: Column, i: Column) -> Column:
        def moved(half: Column, other: Column, size: Column) -> Column:
            said = keyed_digest(F.concat(i.cast("string"), F.lit(":"), n.cast("string"), F.lit(":"), other.cast("string")), salt)
            return (half + F.conv(F.substring(said, 1, 15), 16, 10).cast("bigint") % size) % size

        even = i % 2 == 0
        return F.struct(F.when(even, moved(state["l"], state["r"], ten(cut))).otherwise(state["l"]).alias("l"), F.when(even, state["r"]).otherwise(moved(state["r"], state["l"], ten(n - cut))).alias("r"))

    end = F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step)
    made = F.concat(F.when(cut > 0, F.lpad(end["l"].cast("string"), cut, "0")).otherwise(F.lit("")), F.lpad(end["r"].cast("string"), n - cut, "0"))
    # digits go back one by one to where digits were; a value of nothing else is what was made
    split = F.struct(F.lit("").alias("out"), made.alias("left"))
    placed = F.aggregate(
        F.split(value, ""),
        split,
        lambda s, c: F.when(c.rlike("^[0-9]$") & (s["left"] != ""), F.struct(F.concat(s["out"], F.substring(s["left"], 1, 1)).alias("out"), F.substring(s["left"], 2, MOST_DIGITS).alias("left"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["left"].alias("left"))),
    )["out"]
    return F.when(value.isNull() | (n == 0), value).when(n == F.length(value), made).otherwise(placed)
