"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Matches of one pattern are split out of a text; each that proves valid (check digits, ranges, calendar) is replaced by
another valid value of the same format. The values of a format are numbered from 0 without holes, and an eight-round
Feistel network over two whole numbers (left, right) permutes exactly these numbers, keyed by ``key`` and the kind. So
equal values get equal pseudonyms in any document, different values different ones, and separators stay.

Kinds: mail (letters among letters, digits among digits of its name of at most 64 signs; the domain stays), card (Luhn;
the check digit is computed anew), iban (mod 97, check digits 02 to 98; digits of the account), ip (four octets), ssn
and phone (nine digits, ten national ones; those that can't be real are replaced too, among their like), date (ISO, 1900
to 2099). Anything else in a text stays as it is. Each pattern starts where nothing of its signs stands before, and has
bounded parts, so that the time for a text without blanks grows with its length only.

``key`` has no default: whoever knows it can undo the pseudonyms. Null text stays null, empty stays empty, an empty
table gives none; rows are independent, so ties and repeated rows get equal results; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, restored

# The formats.
FORMATS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,32}[A-Za-z]{2,63}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])",
    "date": r"(?<![0-9-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "phone": r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9A-Za-z])",
}
PATTERN = "|".join(FORMATS.values())
HINT = "[0-9]{4}|[0-9][.) -]|@"  # every format holds one of these
ROUNDS = 8
#: The session setting that holds the pipeline's key.
KEY = "spark.leafmill.pii.key"


def _pow10(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _noise(key: str, kind: str, i: Column, value: Column) -> Column:
    """60 keyed bits."""
    text = F.concat_ws("|", F.lit(f"{key}|{kind}"), i.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def permute(value: Column, left: Column, right: Column, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. left * right - 1 (longs), as value = l * right + r."""
    start = F.struct(F.floor(value / right).cast("long").alias("l"), F.pmod(value, right).alias("r"))

    def step(s: Column, i: Column) -> Column:
        even = F.struct(F.pmod(s["l"] + _noise(key, kind, i, s["r"]), left).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), F.pmod(s["r"] + _noise(key, kind, i, s["l"]), right).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * right + s["r"])


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """The same for a string of at most 34 digits, in two halves."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    start = F.struct(F.substr(digits, F.lit(1), half).alias("l"), F.substr(digits, half + 1).alias("r"))

    def add(s: Column, noise: Column) -> Column:
        size = _pow10(F.length(s))
        return F.when(F.length(s) == 0, s).otherwise(F.lpad(F.pmod(s.cast("long") + F.pmod(noise, size), size).cast("string"), F.length(s), "0"))

    def step(s: Column, i: Column) -> Column:
        even = F.struct(add(s["l"], _noise(key, kind, i, s["r"])).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), add(s["r"], _noise(key, kind, i, s["l"])).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))


def _let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _moved(value: Column, left: int, right: int, key: str, kind: str, use) -> Column:
    """``use(quotient, remainder)`` by ``right`` of the permuted value."""
    big = lambda n: F.lit(n).cast("long")
    return _let(permute(value, big(left), big(right), key, kind), lambda v: use(F.floor(v / right).cast("long"), F.pmod(v, big(right))))


def _padded(*parts: tuple[Column, int]) -> Column:
    return F.concat(*(F.lpad(v.cast("string"), n, "0") for v, n in parts))


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(
            F.concat(s["out"], F.when(is_digit, F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + is_digit.cast("int")).alias("at")
        )

    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["out"])


def _only(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10."""
    back = F.split(F.reverse(digits), "")
    at = F.sequence(F.lit(0), F.length(digits) - 1)
    twice = F.transform(F.zip_with(at, back, lambda i, c: c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)), lambda v: F.when(v > 9, v - 9).otherwise(v))
    return F.aggregate(twice, F.lit(0), lambda s, v: s + v) % 10


def _mod97(chars: Column) -> Column:
    """A string of digits and capitals, letters read as 10 to 35, modulo 97."""
    one = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(chars, ""), F.lit(0), lambda s, c: (s * F.when(c.between("0", "9"), 10).otherwise(100) + one(c)) % 97)


def _card(m: Column, key: str) -> Column:
    d = _only(m)
    body = permute_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
    check = F.pmod(F.lit(10) - luhn(F.concat(body, F.lit("0"))), F.lit(10))
    return F.when(luhn(d) == 0, _refill(m, F.concat(body, check.cast("string"))))


def _iban(m: Column, key: str) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    land, account = F.substring(plain, 1, 2), F.substr(plain, F.lit(5))
    digits = permute_digits(_only(account), key, "iban")
    moved = _refill(account, digits)
    check = F.lpad((F.lit(98) - _mod97(F.concat(moved, land, F.lit("00")))).cast("string"), 2, "0")
    good = (F.length(plain) <= 34) & F.substring(plain, 3, 2).between("02", "98")
    return F.when(good & (_mod97(F.concat(account, F.substring(plain, 1, 4))) == 1), _refill(m, F.concat(check, digits)))


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("long"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s * 256 + p)
    side = F.lit(65536).cast("long")
    other = permute(number, side, side, key, "ip")
    octets = [F.shiftright(other, k).bitwiseAND(F.lit(255)).cast("string") for k in (24, 16, 8, 0)]
    return F.when(F.forall(parts, lambda p: p < 256), F.concat_ws(".", *octets))


def _ssn(m: Column, key: str) -> Column:
    """Of area, group and serial: real ones (898 areas, 99 groups, 9,999 serials) among themselves; others by what is amiss."""
    d = _only(m)
    area, group, serial = (F.substring(d, at, n).cast("long") for at, n in ((1, 3), (4, 2), (6, 4)))
    index = area - 1 - (area > 666).cast("long")
    real = lambda i: i + 1 + (i >= 665).cast("long")
    unreal = F.when(area == 0, 0).when(area == 666, 1).otherwise(area - 898)
    return _refill(
        m,
        F.when(area.isin(0, 666) | (area >= 900), _moved(unreal * 1_000_000 + F.substring(d, 4, 6).cast("long"), 102, 1_000_000, key, "ssn area", lambda q, r: _padded((F.when(q == 0, 0).when(q == 1, 666).otherwise(q + 898), 3), (r, 6))))
        .when(group == 0, _moved(index * 10_000 + serial, 898, 10_000, key, "ssn group", lambda q, r: _padded((real(q), 3), (F.lit("00"), 2), (r, 4))))
        .when(serial == 0, _moved(index * 99 + group - 1, 898, 99, key, "ssn serial", lambda q, r: _padded((real(q), 3), (r + 1, 2), (F.lit("0000"), 4))))
        .otherwise(_moved((index * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, "ssn", lambda q, r: _padded((real(F.floor(q / 99).cast("long")), 3), (F.pmod(q, F.lit(99)) + 1, 2), (r + 1, 4)))),
    )


def _phone(m: Column, key: str) -> Column:
    """Of the ten national digits the first and the fourth are 2 to 9 in a real number; others are moved by which is not."""
    every = _only(m)
    d = F.right(every, F.lit(10))
    area, office, rest = F.substring(d, 1, 3).cast("long"), F.substring(d, 4, 1).cast("long"), F.substring(d, 5, 6).cast("long")

    def moved(kind: str, first: int, choices: int) -> Column:
        back = lambda q, r: _padded((F.floor(q / choices).cast("long") + 200, 3), (F.pmod(q, F.lit(choices)) + first, 1), (r, 6))
        return _moved(((area - 200) * choices + office - first) * 1_000_000 + rest, 800 * choices, 1_000_000, key, kind, back)

    low = _moved(d.cast("long"), 2000, 1_000_000, key, "phone area", lambda q, r: _padded((q, 4), (r, 6)))
    new = F.when(area < 200, low).when(office < 2, moved("phone office", 0, 2)).otherwise(moved("phone", 2, 8))
    return _refill(m, F.concat(F.substr(every, F.lit(1), F.length(every) - 10), new))


def _date(m: Column, key: str) -> Column:
    """Days from 1900-01-01 to 2099-12-31 are 17 x 4,297."""
    first = F.lit("1900-01-01").cast("date")
    day = F.datediff(F.try_to_date(m, "yyyy-MM-dd"), first).cast("long")
    new = _moved(day, 17, 4297, key, "date", lambda q, r: F.date_format(F.date_add(first, (q * 4297 + r).cast("int")), "yyyy-MM-dd"))
    return F.when(day.isNotNull(), new)


def _mail(m: Column, key: str) -> Column:
    """The name's letters move among 26, its digits among 10; capitals stay capitals."""
    name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def numbered(c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(F.when(digit, c.cast("int")).otherwise(F.ascii(c) - 97).alias("v"), F.when(digit, 10).otherwise(26).alias("of"))

    codes = F.transform(F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]"), F.lit(0)), numbered)

    def add(side: Column, other: Column, i: Column) -> Column:
        said = F.array_join(F.transform(other, lambda c: F.concat_ws("/", c["v"], c["of"])), ",")
        seed = F.sha2(F.concat_ws("|", F.lit(f"{key}|mail"), i.cast("string"), said), 512)
        noise = lambda j: F.conv(F.substr(seed, 1 + 4 * j, F.lit(4)), 16, 10).cast("int")
        return F.transform(side, lambda c, j: F.struct(F.pmod(c["v"] + noise(j), c["of"]).alias("v"), c["of"].alias("of")))

    def step(s: Column, i: Column) -> Column:
        even = F.struct(add(s["l"], s["r"], i).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), add(s["r"], s["l"], i).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    def halved(c: Column) -> Column:
        half = F.floor(F.size(c) / 2).cast("int")
        return F.struct(F.slice(c, 1, half).alias("l"), F.slice(c, half + 1, F.size(c)).alias("r"))

    moved = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), _let(codes, halved), step, lambda s: F.concat(s["l"], s["r"]))
    fill = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def filled(new: Column) -> Column:
        def put(s: Column, c: Column) -> Column:
            sign = F.get(new, s["at"] - 1)
            small = F.substr(F.lit(letters), sign["v"] + 1, F.lit(1))
            now = F.when(c.rlike("[A-Z]"), F.upper(small)).when(c.rlike("[a-z]"), small).when(c.rlike("[0-9]"), sign["v"].cast("string")).otherwise(c)
            return F.struct(F.concat(s["out"], now).alias("out"), (s["at"] + c.rlike("[A-Za-z0-9]").cast("int")).alias("at"))

        return F.aggregate(F.split(name, ""), fill, put, lambda s: s["out"])

    return F.concat(_let(moved, filled), F.lit("@"), host)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match, or the match itself where it isn't valid."""
    kinds = {"mail": _mail, "iban": _iban, "date": _date, "ip": _ip, "phone": _phone, "ssn": _ssn, "card": _card}
    out = m
    for kind in reversed(list(kinds)):
        out = F.when(m.rlike(f"^(?:{FORMATS[kind]})$"), F.coalesce(kinds[kind](m, key), m)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, *more: str) -> DataFrame:
    """doc_id, text with its values replaced, n_replaced (values that are other than before) of each row."""
    text = F.col("text")
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    cut = docs.select("doc_id", "text", *more, found.alias("found"))
    some = F.coalesce(F.size("found") > 0, F.lit(False))
    cut = cut.withColumn("new", F.when(some, F.transform("found", lambda m: pseudonym(m, key))))
    whole = F.array_join(F.zip_with(F.split(text, PATTERN, -1), F.array_append("new", F.lit("")), lambda gap, m: F.concat(gap, m)), "")
    changed = F.size(F.filter(F.zip_with("found", "new", lambda a, b: a != b), lambda x: x))
    return cut.select("doc_id", F.when(some, whole).otherwise(text).alias("text"), F.when(some, changed).otherwise(0).cast("long").alias("n_replaced"), *more)


def without_personal_data(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with its text so rewritten and n_chars, where there is one, to match."""
    packed, rest = carried(docs)
    return restored(pseudonymise(packed, key, rest), docs)
