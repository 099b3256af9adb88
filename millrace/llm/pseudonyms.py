"""Format-preserving pseudonyms for personal data, with Spark expressions only.

Emails, card numbers, phone numbers, social security numbers, bank accounts, IP addresses,
dates and labelled secrets are found by pattern, validated, and replaced by another value of
the same format: a Feistel network whose round function is a keyed SHA-256 permutes the
values of a format.  A permutation keeps different values different, and equal values
get equal pseudonyms in every document, so links survive without any table of values.

The network has two halves ``a`` modulo ``A`` and ``b`` modulo ``B``; rounds add a keyed
hash of one half to the other in turn, which is one-to-one for any two moduli, so values of
a format are numbered from 0 to ``A * B - 1`` and nothing has to be drawn again:

* characters: the first and second half of the letters and digits, read in base 10, 16 or 36;
* IPv4: two times 65,536;
* dates: the day within its cycle of 400 years, 146,097 = 189 * 773 days;
* card numbers and accounts: all but the check digits, which are then computed anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import col

ROUNDS = 10
SEGMENT = 22  # two halves of 11 characters in base 36 fit a bigint
CYCLE_DAYS, DAYS_A, DAYS_B = 146_097, 189, 773  # fixed: days in 400 years, and its factors

# Possessive or bounded repeats behind a look-behind: every text position is tried once.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)+",
    "secret": r"(?i:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
              r"[0-9A-Fa-f]{32,64}+(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4})"
            r"(?![0-9]|[./-][0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z+.-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}"
            r"|[0-9]{4}([ -])[0-9]{6}\3[0-9]{5})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){1,4}"
             r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([.-])[0-9]{3}\4[0-9]{4})(?![0-9A-Za-z])",
}
ANY = "|".join(PATTERNS.values())
# cheaper than the patterns, and true for every text that one of them can match
MAY_HOLD = r"[0-9@]"


def _round(key: str, kind: str, i: Column, half: Column, modulus: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half.cast("string")).cast("binary"), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), modulus)


def feistel(key: str, kind: str, a: Column, b: Column, mod_a: Column, mod_b: Column) -> Column:
    """Struct ``a, b``: the keyed permutation of the pairs of ``range(A) x range(B)``."""
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    mod_a, mod_b = mod_a.cast("bigint"), mod_b.cast("bigint")

    def step(acc: Column, i: Column) -> Column:
        odd = i % 2 == 1
        next_a = F.when(odd, F.pmod(acc["a"] + _round(key, kind, i, acc["b"], mod_a), mod_a)).otherwise(acc["a"])
        next_b = F.when(odd, acc["b"]).otherwise(F.pmod(acc["b"] + _round(key, kind, i, acc["a"], mod_b), mod_b))
        return F.struct(next_a.alias("a"), next_b.alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _number(text: Column, radix: int) -> Column:
    return F.coalesce(F.conv(text, radix, 10).cast("bigint"), F.lit(0).cast("bigint"))


def _digits(number: Column, radix: int, width: Column) -> Column:
    return F.when(width == 0, F.lit("")).otherwise(
        F.lpad(F.lower(F.conv(number.cast("string"), 10, radix)), width, F.lit("0")))


def permute_characters(key: str, kind: str, text: Column, radix: int) -> Column:
    """Permute a lower-case text of base-``radix`` digits among all texts of its length."""

    def segment(start: Column) -> Column:
        piece = F.substring(text, start, F.lit(SEGMENT))
        n = F.length(piece)
        left = F.floor(n / 2).cast("int")
        right = n - left
        power = lambda w: F.round(F.pow(F.lit(float(radix)), w)).cast("bigint")  # noqa: E731  exact up to 2**57
        mixed = feistel(
            key, f"{kind}{radix}", _number(F.substring(piece, F.lit(1), left), radix),
            _number(F.substring(piece, left + 1, right), radix), power(left), power(right))
        return F.concat(_digits(mixed["a"], radix, left), _digits(mixed["b"], radix, right))

    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(SEGMENT))
    return F.array_join(F.transform(starts, segment), "")


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _filled(template: Column, values: Column, character: str) -> Column:
    """``template`` with its characters of that class replaced by those of ``values``, in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        fits = c.rlike(character)
        new = F.when(fits, F.substring(values, acc["k"] + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(acc["out"], new).alias("out"), (acc["k"] + fits.cast("int")).alias("k"))

    return F.aggregate(_characters(template), start, step)["out"]


def luhn_sum(digits: Column) -> Column:
    """Luhn sum with the last digit counted once."""
    return F.aggregate(
        F.transform(F.reverse(_characters(digits)), lambda d, i: F.when(
            i % 2 == 0, d.cast("int")).otherwise(F.floor(d.cast("int") * 2 / 10).cast("int") + d.cast("int") * 2 % 10)),
        F.lit(0), lambda acc, d: acc + d)


def _only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _card(key: str, hit: Column) -> Column:
    digits = _only_digits(hit)
    payload = F.substring(digits, F.lit(1), F.length(digits) - 1)
    mixed = permute_characters(key, "card", payload, 10)
    check = F.pmod(F.lit(10) - luhn_sum(F.concat(mixed, F.lit("0"))) % 10, F.lit(10))
    new = _filled(hit, F.concat(mixed, check.cast("string")), "[0-9]")
    return F.when(luhn_sum(digits) % 10 == 0, new).otherwise(hit)


def _mod97(text: Column) -> Column:
    """Remainder of a text of digits and capitals, A = 10 to Z = 35."""
    return F.aggregate(
        _characters(text), F.lit(0).cast("bigint"),
        lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + c.try_cast("int")) % 97)
        .otherwise((acc * 100 + F.ascii(c) - 55) % 97).cast("bigint"))


def _iban(key: str, hit: Column) -> Column:
    plain = F.regexp_replace(hit, " ", "")
    country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    mixed = _filled(account, permute_characters(key, "iban", _only_digits(account), 10), "[0-9]")
    check = F.lit(98) - _mod97(F.concat(mixed, country, F.lit("00")))
    new = F.concat(country, F.lpad(check.cast("string"), 2, "0"), mixed)
    valid = _mod97(F.concat(account, F.substring(plain, 1, 4))) == 1
    return F.when(valid & (_only_digits(account) != ""), _filled(hit, new, "[0-9A-Z]")).otherwise(hit)


def _ip(key: str, hit: Column) -> Column:
    o = F.transform(F.split(hit, r"\."), lambda x: x.cast("int"))
    mixed = feistel(
        key, "ip", F.element_at(o, 1) * 256 + F.element_at(o, 2), F.element_at(o, 3) * 256 + F.element_at(o, 4),
        F.lit(65536), F.lit(65536))
    octets = [F.floor(mixed["a"] / 256), mixed["a"] % 256, F.floor(mixed["b"] / 256), mixed["b"] % 256]
    new = F.concat_ws(".", *[x.cast("string") for x in octets])
    return F.when(F.array_max(o) <= 255, new).otherwise(hit)


def _ssn(key: str, hit: Column) -> Column:
    area, group, serial = (F.substring(hit, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    # areas 001 to 899 without 666 are numbered 0 to 897
    a = (area - 1 - (area > 666).cast("int")) * 99 + group - 1
    mixed = feistel(key, "ssn", a, serial - 1, F.lit(898 * 99), F.lit(9999))
    number = F.floor(mixed["a"] / 99).cast("int")
    new_area = number + 1 + (number >= 665).cast("int")
    new = F.format_string(
        "%03d-%02d-%04d", new_area, (mixed["a"] % 99 + 1).cast("int"), (mixed["b"] + 1).cast("int"))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    return F.when(valid, new).otherwise(hit)


def _phone(key: str, hit: Column) -> Column:
    country = F.regexp_extract(hit, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substring(hit, F.length(country) + 1, F.length(hit))
    return F.concat(country, _filled(rest, permute_characters(key, "phone", _only_digits(rest), 10), "[0-9]"))


def _email(key: str, hit: Column) -> Column:
    local = F.lower(F.substring_index(hit, "@", 1))
    mixed = permute_characters(key, "email", F.regexp_replace(local, "[^0-9a-z]", ""), 36)
    return F.concat(_filled(local, mixed, "[0-9a-z]"), F.lit("@"), F.substring_index(hit, "@", -1))


def _secret(key: str, hit: Column) -> Column:
    value = F.regexp_extract(hit, "[0-9A-Fa-f]{32,64}$", 0)
    mixed = permute_characters(key, "secret", F.lower(value), 16)
    new = F.when(value == F.lower(value), mixed).otherwise(F.upper(mixed))
    return F.concat(F.substring(hit, F.lit(1), F.length(hit) - F.length(value)), new)


def _date(key: str, hit: Column) -> Column:
    """ISO dates; with dots day first; with slashes month first where that is a date, else day first."""
    iso = hit.rlike("^[0-9]{4}-")
    p = F.split(hit, "[./-]")
    one, two, three = (F.element_at(p, i) for i in (1, 2, 3))

    def day(y: Column, m: Column, d: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

    month_first = F.contains(hit, F.lit("/")) & day(three, one, two).isNotNull()
    parsed = F.when(iso, day(one, two, three)).when(month_first, day(three, one, two)).otherwise(day(three, two, one))
    n = F.unix_date(parsed) - F.unix_date(F.lit("1600-01-01").cast("date"))
    inside = F.pmod(n, F.lit(CYCLE_DAYS))
    mixed = feistel(key, "date", F.floor(inside / DAYS_B), inside % DAYS_B, F.lit(DAYS_A), F.lit(DAYS_B))
    new = F.date_add(F.lit("1600-01-01").cast("date"), (n - inside + mixed["a"] * DAYS_B + mixed["b"]).cast("int"))
    padded = (F.length(one) == 2) & (F.length(two) == 2)
    part = lambda c: F.when(padded, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))
    m, d, y = part(F.month(new)), part(F.day(new)), F.lpad(F.year(new).cast("string"), 4, "0")
    mark = F.regexp_extract(hit, "[./]", 0)
    out = F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(
        month_first, F.concat(m, mark, d, mark, y)).otherwise(F.concat(d, mark, m, mark, y))
    return F.coalesce(out, hit)


_MAKERS = {
    "email": _email, "secret": _secret, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card,
    "phone": _phone,
}


def pseudonym(key: str, hit: Column) -> Column:
    """The pseudonym of one match; a match that is no valid value of its format stays as it is."""
    out = F.when(F.lit(False), hit)
    for kind, maker in _MAKERS.items():
        # a match is tried as each kind, whole, in the order of the alternatives
        out = out.when(hit.rlike(f"^(?:{_alone(kind)})$"), maker(key, hit))
    return out.otherwise(hit)


def _alone(kind: str) -> str:
    """A pattern with its own back-references counted from 1."""
    pattern = PATTERNS[kind]
    for old, new in (("\\2", "\\1"), ("\\4", "\\1")) if kind in ("card", "phone") else ():
        pattern = pattern.replace(old, new)
    return pattern.replace("\\3", "\\2")


def pseudonymize(
    docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text, n_replaced``.

    ``text`` is the whole text with every validated value replaced by its pseudonym under
    ``key``; everything else stays as it is.  A null text stays null with 0 replaced, an empty
    one stays empty.  Ids are passed through, null or repeated or not.
    """
    text = col(text_col)
    parts, hits = F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    found = docs.select(
        col(id_col).alias("doc_id"), text.alias("text"),
        F.when(text.rlike(MAY_HOLD), F.struct(parts.alias("parts"), hits.alias("hits"))).alias("f"))
    new = found.withColumn("new", F.transform("f.hits", lambda h: pseudonym(key, h)))
    joined = F.array_join(F.zip_with("f.parts", "new", lambda p, h: F.concat(p, F.coalesce(h, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with("f.hits", "new", lambda a, b: a != b), lambda x: x))
    return new.select(
        "doc_id", F.when(F.size("f.hits") > 0, joined).otherwise(F.col("text")).alias("text"),
        F.when(F.size("f.hits") > 0, changed).otherwise(0).cast("bigint").alias("n_replaced"))
