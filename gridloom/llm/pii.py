"""Format-preserving Feistel pseudonyms for personal data, DataFrame functions only.

Numbers and dates are validated first (Luhn check, octet range, calendar), then permuted by a
keyed Feistel network inside their own format, so equal values get equal pseudonyms in every
document without any table of values, and each pseudonym is again valid:

* card (13 to 19 digits, Luhn): all digits but the last are permuted, the check digit is made anew;
* phone: digits are permuted, separators and country code stay;
* social security number: the valid ones (area 001 to 899 but 666, group 01 to 99, serial 0001 to
  9999) are permuted among themselves, and the taxpayer numbers of areas 900 to 999 likewise;
* IPv4 without leading zeros: the 32 bits are permuted as two halves of 16;
* date ``YYYY-MM-DD`` of 1900-01-01 to 2099-12-31: the 73,049 days are permuted as 17 x 4,297;
* mail address: ASCII letters and digits of the local part are permuted within their class and case,
  every other letter or digit within its aligned block of 64 code points.

Everything is one narrow projection (no shuffle, no state), so it scales with the scan alone, and
a lost task is simply run again. The round function is HMAC-SHA-512 of kind, round and the other
half; a Feistel network is a bijection for every round function.

Results for odd input: null text stays null with zero counts, empty text and text without personal
data come back unchanged, very long texts are read whole, equal values in one text or in several
get equal pseudonyms, where patterns could tie the leftmost match and the first pattern win; other
columns (whatever their names), repeated rows, null and repeated ids are kept as they are; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8  # even, so that the halves end in their own places
KEY = "gridloom"  #: default key; production callers pass their own secret
DAY0, DAYS_A, DAYS_B = "1900-01-01", 17, 4297
DAYS = DAYS_A * DAYS_B  #: all of 1900 to 2099
#: Social security numbers: first area and how many there are (666 is none), for either range of areas.
SSN_AREAS, TAXPAYER_AREAS, GROUPS, SERIALS = (1, 898), (900, 100), 99, 9999
CODE_BLOCK = 64

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
NUMBERS = "|".join(
    [
        r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
        r"(?<![\d-])(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d-])",
        r"(?<![\d-])(?!000|666)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
        r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
        r"(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)",
        r"(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
        r"(?<!\d)\d{13,19}(?!\d)",
        r"(?<![\d-])\d{4}(?: \d{4}){3}(?!\d)",
        r"(?<![\d-])\d{4}(?:-\d{4}){3}(?!\d)",
    ]
)
KINDS = ("email", "ip", "date", "ssn", "phone", "card")


def _kind(m: Column) -> Column:
    """Kind of a match of the patterns above, or null where validation fails."""
    digits = F.regexp_replace(m, r"\D", "")
    return (
        F.when(m.contains("@"), "email")
        .when(m.contains("."), F.when(m.rlike(r"^\d+(\.\d+){3}$"), "ip").otherwise("phone"))
        .when(m.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.when(F.try_to_date(m).between(F.lit(DAY0).cast("date"), F.date_add(F.lit(DAY0).cast("date"), DAYS - 1)), "date"))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^[+(]") | m.rlike(r"^\d{3}-\d{3}-\d{4}$"), "phone")
        .when(luhn_sum(digits) % 10 == 0, "card")
    )


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits (a multiple of ten if the last digit checks the others)."""
    at = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, d * 2).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(at, F.lit(0), add)


def keyed(key: str, tag: str, i: Column, half: Column) -> Column:
    """HMAC-SHA-512 of kind, round and half, in hexadecimal digits."""
    raw = key.encode()
    raw = (hashlib.sha512(raw).digest() if len(raw) > 128 else raw).ljust(128, b"\0")
    inner, outer = (F.lit(bytes(c ^ pad for c in raw)) for pad in (0x36, 0x5C))
    message = F.concat_ws("|", F.lit(tag), i.cast("string"), half).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 512))), 512)


def feistel_number(value: Column, a: int, b: int, key: str, tag: str) -> Column:
    """Permute 0 .. a*b-1; value, as ``left * b + right``, is a bigint."""

    def step(s: Column, i: Column) -> Column:
        size = F.when(i % 2 == 0, F.lit(a)).otherwise(F.lit(b)).cast("long")
        mix = F.conv(F.substring(keyed(key, tag, i, s["r"].cast("string")), 1, 12), 16, 10).cast("long")
        return F.struct(s["r"].alias("l"), ((s["l"] + mix) % size).alias("r"))

    start = F.struct(F.floor(value / F.lit(b)).cast("long").alias("l"), (value % F.lit(b)).cast("long").alias("r"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step, lambda s: s["l"] * F.lit(b).cast("long") + s["r"])


def feistel_string(text: Column, key: str, tag: str) -> Column:
    """Permute strings of one format: ASCII digits and letters move within their class and case,
    characters beyond ASCII within their aligned block of ``CODE_BLOCK``, all others stay."""
    cut = F.floor(F.length(text) / 2).cast("int")

    def moved(half: Column, other: Column, i: Column) -> Column:
        digest = keyed(key, tag, i, other)

        def one(c: Column, j: Column) -> Column:
            code = F.ascii(c)
            by = F.conv(F.substring(digest, (j % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            turn = lambda base, size: F.char(F.lit(base) + (code - base + by) % size)
            low = code - code % CODE_BLOCK
            beyond = F.decode(F.unhex(F.lpad(F.hex(low + (code - low + by) % CODE_BLOCK), 8, "0")), "UTF-32")
            return (
                F.when(c.between("0", "9"), turn(48, 10)).when(c.between("a", "z"), turn(97, 26)).when(c.between("A", "Z"), turn(65, 26)).when(code > 127, beyond).otherwise(c)
            )

        return F.array_join(F.transform(F.split(half, ""), one), "")

    def step(s: Column, i: Column) -> Column:
        return F.struct(s["r"].alias("l"), moved(s["l"], s["r"], i).alias("r"))

    start = F.struct(F.substring(text, F.lit(1), cut).alias("l"), F.substring(text, cut + 1, F.length(text)).alias("r"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step, lambda s: F.concat(s["l"], s["r"]))


def _ssn(m: Column, key: str) -> Column:
    """A valid number as area, group and serial counted from zero, permuted and written again."""
    area, group, serial = (F.element_at(F.split(m, "-"), k).cast("long") for k in (1, 2, 3))

    def within(first: int, areas: int, tag: str) -> Column:
        at = area - first - F.when(area > 666, 1).otherwise(0) if first < 666 else area - first
        new = feistel_number((at * GROUPS + group - 1) * SERIALS + serial - 1, areas * GROUPS, SERIALS, key, tag)

        def written(v: Column) -> Column:
            found = F.floor(v / (GROUPS * SERIALS)) + first
            found = found + F.when(found >= 666, 1).otherwise(0) if first < 666 else found
            return F.format_string("%03d-%02d-%04d", found, F.floor(v / SERIALS) % GROUPS + 1, v % SERIALS + 1)

        return F.transform(F.array(new), written)[0]

    return F.when(area < TAXPAYER_AREAS[0], within(*SSN_AREAS, "ssn")).otherwise(within(*TAXPAYER_AREAS, "taxpayer"))


def _digits_in(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced, in order, by those of ``digits``."""

    def put(s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(
            F.concat(s["out"], F.when(is_digit, F.substring(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"),
            (s["k"] + F.when(is_digit, 1).otherwise(0)).alias("k"),
        )

    return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), put, lambda s: s["out"])


def pseudonym(m: Column, kind: Column, key: str = KEY) -> Column:
    """Pseudonym of a validated match; a match without a kind stays as it is."""
    at = F.instr(m, "@")
    email = F.concat(feistel_string(F.substring(m, F.lit(1), at - 1), key, "email"), F.substring(m, at, F.length(m)))
    octet = lambda k: F.element_at(F.split(m, r"\."), k).cast("long")
    ip = feistel_number(((octet(1) * 256 + octet(2)) * 256 + octet(3)) * 256 + octet(4), 1 << 16, 1 << 16, key, "ip")
    day = feistel_number(F.datediff(F.try_to_date(m), F.lit(DAY0).cast("date")).cast("long"), DAYS_A, DAYS_B, key, "date")
    digits = F.regexp_replace(m, r"\D", "")
    # the last ten digits of a phone number; what stands before them is the country code
    local = F.length(digits) - 10
    phone = F.concat(F.substring(digits, F.lit(1), local), feistel_string(F.substring(digits, local + 1, F.lit(10)), key, "phone"))
    body = feistel_string(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    card = F.transform(F.array(body), lambda x: F.concat(x, ((F.lit(10) - luhn_sum(F.concat(x, F.lit("0"))) % 10) % 10).cast("string")))[0]
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", F.transform(F.array(ip), lambda v: F.concat_ws(".", *[F.shiftright(v, n).bitwiseAND(F.lit(255)).cast("string") for n in (24, 16, 8, 0)]))[0])
        .when(kind == "date", F.date_add(F.lit(DAY0).cast("date"), day.cast("int")).cast("string"))
        .when(kind == "ssn", _ssn(m, key))
        .when(kind == "phone", _digits_in(m, phone))
        .when(kind == "card", _digits_in(m, card))
        .otherwise(m)
    )


def pseudonymize(docs: DataFrame, text_col: str = "text", key: str = KEY, counts_prefix: str | None = "n_") -> DataFrame:
    """All columns of ``docs`` with ``text_col`` pseudonymised; counts per kind are added.

    ``counts_prefix`` None adds no columns, so the schema stays that of ``docs``.
    """
    text = F.col(f"`{text_col}`")
    # A pattern runs only on texts that can match it; the literals keep the compiled pattern.
    pattern_all = f"{EMAIL}|{NUMBERS}"
    has_mail, has_digit = text.contains("@"), text.rlike(r"\d{3}|\d\.\d")
    none = F.array().cast("array<string>")
    matches = (
        F.when(has_mail, F.regexp_extract_all(text, F.lit(pattern_all), 0)).when(has_digit, F.regexp_extract_all(text, F.lit(NUMBERS), 0)).otherwise(none)
    )
    pieces = F.when(has_mail, F.split(text, pattern_all, -1)).when(has_digit, F.split(text, NUMBERS, -1)).otherwise(none)
    kept = docs.columns
    # Names made here never clash: everything of docs travels as one struct.
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), text.alias("t"), matches.alias("m"), pieces.alias("p"))
    row = row.withColumn("found", F.transform("m", lambda m: F.struct(m.alias("m"), _kind(m).alias("kind"))))
    row = row.withColumn("new", F.transform("found", lambda f: pseudonym(f["m"], f["kind"], key)))
    text_new = F.when(
        F.size("m") > 0, F.array_join(F.flatten(F.zip_with("p", "new", lambda p, n: F.array(p, F.coalesce(n, F.lit(""))))), "")
    ).otherwise(F.col("t"))
    out = [text_new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in kept]
    if counts_prefix is not None:
        is_kind = lambda kind: lambda f: f["kind"] == kind
        out += [F.size(F.filter("found", is_kind(k))).cast("long").alias(f"{counts_prefix}{k}") for k in KINDS]
    return row.select(*out)


def key_of(spark: SparkSession) -> str:
    """The secret of a run, set as ``gridloom.pii.key`` in the session; the public default else."""
    return spark.conf.get("gridloom.pii.key", KEY)
