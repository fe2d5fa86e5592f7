"""Personal data replaced by keyed pseudonyms of the same format, with Spark functions only.

Found: e-mail addresses, IPv4 addresses, dates, bank account numbers (IBAN), US social security
numbers, phone numbers, other numbers of 12 to 19 digits (payment cards where the check digit
agrees) and hexadecimal secrets. Each kind has a domain, and a Feistel network keyed with a
secret permutes it: a value becomes another valid value of the kind, written with the same
separators, the same one wherever it occurs, and different values stay different. Letters and
digits of a string are permuted within their class; dates within 1800 to 2199, those with a year
of two digits within a century of their own; check digits are made anew. Of a phone number the
subscriber's digits change; country code and the 0 that starts a national number stay. Without a valid date, check sum or area the text counts as a plain number, if that
fits, or stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import let

#: Placeholder for tests: real uses pass a secret of their own.
DEMO_KEY = "demo-key"
ROUNDS = 8

# Java patterns of the kinds, in the order in which they are tried.
_START, _STOP = "(?<![\\p{L}\\p{N}_])", "(?![\\p{L}\\p{N}_])"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Length of the IBAN by country: the registry, and countries that use the form without being in it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """Fours of letters and digits, as many as the country has: a following word is never taken along."""
    forms = []
    for size, countries in sorted(IBAN_LENGTHS.items()):
        fours, rest = divmod(size - 4, 4)
        forms.append(f"(?:{'|'.join(countries.split())})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else ""))
    return f"{_START}(?:{'|'.join(forms)}){_STOP}"


_NUMBER = "(?:[0-9]{12,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})"
# Dates with one-digit days or months or years of two digits: one separator, and no more parts than three.
_SHORT_DATE = "(?<![0-9][./-])(?:{})(?![./-][0-9])".format("|".join(
    f"[0-9]{{4}}{x}[0-9]{{1,2}}{x}[0-9]{{1,2}}|[0-9]{{1,2}}{x}[0-9]{{1,2}}{x}(?:[0-9]{{4}}|[0-9]{{2}})" for x in ("\\.", "/", "-")))
# A further digit of an international number; a date or long number after a space isn't taken along.
_MORE = f"(?:(?! (?:{_NUMBER}|{_SHORT_DATE}){_STOP})(?:[ ./-]|[ .-]?\\(|\\)[ .-]?)?[0-9])"
_TRUNK = "(?:[ .-]?\\(0\\))?"
_NORTH_AMERICAN = f"(?:(?<![\\p{{L}}\\p{{N}}_+])\\+[0-9]{{1,3}}[ .-]?(?:\\([0-9]{{3}}\\) ?|[0-9]{{3}}[ .-]?)|(?<![\\p{{L}}\\p{{N}}_(])\\([0-9]{{3}}\\) ?|{_START}[0-9]{{3}}[ .-])[0-9]{{3}}[ .-]?[0-9]{{4}}"
# The usual lengths of the languages handled come first, then any of 7 to 14 digits after the code.
_INTERNATIONAL = (
    f"(?<![\\p{{L}}\\p{{N}}_+])\\+(?:1{_MORE}{{10}}|3[34]{_TRUNK}{_MORE}{{9}}|44{_TRUNK}{_MORE}{{9,10}}|[1-9]{_MORE}{{7,16}}){_STOP}")
# National groupings of France, Spain, Britain, and Germany.
_NATIONAL = f"(?<![\\p{{L}}\\p{{N}}_+])(?<![0-9][.,/-])(?!{_NUMBER}{_STOP})(?:" + "|".join((
    "0[1-9](?:[ .-]?[0-9]{2}){4}",
    "[6-9][0-9]{2}(?:[ .-][0-9]{3}){2}", "[6-9][0-9]{2}(?:[ .-][0-9]{2}){3}", "[89][0-9][ .-][0-9]{3}(?:[ .-][0-9]{2}){2}",
    "(?:02[0-9]|\\(02[0-9]\\)) ?[0-9]{4}[ -]?[0-9]{4}", "(?:0[1-9][0-9]{2}|\\(0[1-9][0-9]{2}\\)) ?[0-9]{3}[ -]?[0-9]{4}",
    "(?:0[1-9][0-9]{3}|\\(0[1-9][0-9]{3}\\)) ?[0-9]{3}[ -]?[0-9]{3}",
    "(?:0[1-9][0-9]{1,4}(?:[ /-]| [/-] )|\\(0[1-9][0-9]{1,4}\\)[ /-]?)(?:[0-9]{4,9}(?:-[0-9]{1,4})?|[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3})",
)) + ")"
# A domain has 127 labels at most, which also bounds the depth to which Java follows the repeated group.
KINDS = {
    "email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?){1,126}",
    "ip": f"{_START}(?<!\\.){_OCTET}(?:\\.{_OCTET}){{3}}{_STOP}(?!\\.[0-9])",
    "date": f"{_START}(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}|[0-9]{{2}}[./-][0-9]{{2}}[./-][0-9]{{4}}|{_SHORT_DATE}){_STOP}",
    "iban": _iban_pattern(),
    "ssn": f"{_START}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_STOP}",
    "phone": f"(?:{_INTERNATIONAL}|{_NORTH_AMERICAN}{_STOP}|{_NATIONAL}{_STOP})",
    "number": f"{_START}{_NUMBER}{_STOP}",
    "secret": f"{_START}(?:[0-9a-f]{{32,128}}|[0-9A-F]{{32,128}}){_STOP}",
}
#: The kinds before and after IBANs, of which only those with the right check digits are searched.
_BEFORE, _AFTER = (
    "|".join(v for k, v in KINDS.items() if k != "iban" and (list(KINDS).index(k) < list(KINDS).index("iban")) == first)
    for first in (True, False))


def _draw(key: str, tweak: str, turn: Column, other: Column, at: Column | int = 0) -> Column:
    """A number below 2^48 from the key and the other half; `at` chooses another."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), turn.cast("string"), F.lit(at).cast("string") if isinstance(at, int) else at.cast("string"), other), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def permute_number(value: Column, left: int, right: int, key: str, tweak: str) -> Column:
    """A keyed permutation of 0 .. left * right - 1: a Feistel network over value = l * right + r."""
    start = F.struct(F.floor(value / F.lit(right)).cast("long").alias("l"), F.pmod(value.cast("long"), F.lit(right).cast("long")).alias("r"))

    def turn(x: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(x["l"] + _draw(key, tweak, i, x["r"].cast("string")), F.lit(left).cast("long"))).otherwise(x["l"]).alias("l"),
            F.when(even, x["r"]).otherwise(F.pmod(x["r"] + _draw(key, tweak, i, x["l"].cast("string")), F.lit(right).cast("long"))).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda x: x["l"] * right + x["r"])


def _shift(part: Column, key: str, tweak: str, turn: Column, other: Column, letters: int) -> Column:
    """Each digit and letter of part moved within its class by a draw from the other half."""

    def move(c: Column, k: Column) -> Column:
        code = F.ascii(c)
        by = _draw(key, tweak, turn, other, k)

        def within(first: int, size: int) -> Column:
            return F.char((F.pmod(code - first + by, F.lit(size).cast("long")) + first).cast("int"))

        return (
            F.when(c.rlike("[0-9]"), within(48, 10)).when(c.rlike("[a-z]"), within(97, letters))
            .when(c.rlike("[A-Z]"), within(65, letters)).otherwise(c))

    return F.array_join(F.transform(F.split(part, ""), move), "")


def permute_text(value: Column, key: str, tweak: str, letters: int = 26) -> Column:
    """A keyed permutation of the strings that have the same classes (digit, a-z, A-Z; the first
    `letters` of the alphabet) and the same other characters in the same places."""
    half = (F.length(value) / 2).cast("int")
    start = F.struct(F.left(value, half).alias("l"), F.substr(value, half + 1).alias("r"))

    def turn(x: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, _shift(x["l"], key, tweak, i, x["r"], letters)).otherwise(x["l"]).alias("l"),
            F.when(even, x["r"]).otherwise(_shift(x["r"], key, tweak, i, x["l"], letters)).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda x: F.concat(x["l"], x["r"]))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _refill(hit: Column, new: Column, of: str = "[0-9]") -> Column:
    """hit with its characters of the class replaced in turn by those of new."""
    def step(x: Column, c: Column) -> Column:
        taken = c.rlike(of)
        return F.struct(
            F.concat(x["out"], F.when(taken, F.substr(new, x["k"], F.lit(1))).otherwise(c)).alias("out"),
            (x["k"] + taken.cast("int")).alias("k"))

    return F.aggregate(F.split(hit, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step, lambda x: x["out"])


def _luhn(body: Column) -> Column:
    """The check digit that completes a string of digits."""
    size = F.length(body)
    parts = F.transform(F.split(body, ""), lambda c, k: let(
        c.cast("int") * F.when((size - k) % 2 == 1, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.pmod(-F.aggregate(parts, F.lit(0), lambda a, b: a + b), F.lit(10)).cast("string")


def _mod97(value: Column) -> Column:
    """The number that digits and letters (A is 10) spell, modulo 97."""
    return F.aggregate(F.split(value, ""), F.lit(0), lambda a, c: F.when(
        c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _valid_iban(value: Column) -> Column:
    return _mod97(F.concat(F.substr(value, F.lit(5)), F.left(value, F.lit(4)))) == 1


def _pattern(text: Column) -> Column:
    """What to search for in a text: the kinds, with the valid IBANs of the text in place of all that
    look like one, so that a false one hides neither a number within it nor an IBAN that begins there."""
    shaped = F.when(text.rlike("[A-Z]{2}[0-9]{2}"), F.regexp_extract_all(text, F.lit(f"(?=({KINDS['iban']}))"), F.lit(1)))
    valid = F.filter(F.array_distinct(shaped), lambda x: _valid_iban(F.regexp_replace(x, " ", "")))
    return F.when(F.size(valid) > 0, F.concat(
        F.lit(f"{_BEFORE}|{_START}(?:"), F.array_join(valid, "|"), F.lit(f"){_STOP}|{_AFTER}"))).otherwise(F.lit(f"{_BEFORE}|{_AFTER}"))


def _iban(hit: Column, key: str) -> Column:
    def made(value: Column) -> Column:
        country, body = F.left(value, F.lit(2)), F.substr(value, F.lit(5))
        valid = _valid_iban(value)
        new = let(permute_text(body, key, "iban"), lambda b: F.concat(
            country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
        return F.when(valid, _refill(hit, new, "[A-Z0-9]"))

    return let(F.regexp_replace(hit, " ", ""), made)


def _date(hit: Column, key: str) -> Column:
    """Written with zeros before one digit unless the hit has a part of one digit."""
    parts = F.split(hit, "[./-]")
    sizes = [F.length(F.get(parts, k)) for k in range(3)]
    separators = [F.substr(hit, sizes[0] + 1, F.lit(1)), F.substr(hit, sizes[0] + sizes[1] + 2, F.lit(1))]
    short, century = (sizes[0] == 1) | (sizes[1] == 1) | (sizes[2] == 1), (sizes[0] < 4) & (sizes[2] == 2)

    def parsed(order: str) -> Column:
        year, month, day = (F.get(parts, order.index(x)) for x in "ymd")
        text = F.concat_ws("-", F.when(century, F.concat(F.lit("20"), year)).otherwise(year), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
        return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")

    def within(day: Column, first: str, left: int, right: int, tweak: str) -> Column:
        start = F.lit(first).cast("date")
        new = F.date_add(start, permute_number(F.datediff(day, start).cast("long"), left, right, key, tweak).cast("int"))
        return F.when(day.between(start, F.date_add(start, left * right - 1)), new)

    def written(order: str) -> Column:
        def put(new: Column) -> Column:
            def part(x: str) -> Column:
                if x == "y":
                    return F.date_format(new, "yyyy") if order[0] == "y" else F.when(century, F.date_format(new, "yy")).otherwise(F.date_format(new, "yyyy"))
                x = x.replace("m", "M")
                return F.when(short, F.date_format(new, x)).otherwise(F.date_format(new, 2 * x))

            return F.concat(part(order[0]), separators[0], part(order[1]), separators[1], part(order[2]))

        # 400 years have 146097 = 189 * 773 days, this century has 36525 = 75 * 487.
        return let(parsed(order), lambda day: let(
            F.when(century, within(day, "2000-01-01", 75, 487, "century")).otherwise(within(day, "1800-01-01", 189, 773, "date")), put))

    return F.when(sizes[0] == 4, written("ymd")).otherwise(F.coalesce(written("dmy"), written("mdy")))


def _number(hit: Column, key: str) -> Column:
    def made(value: Column) -> Column:
        body = F.left(value, F.length(value) - 1)
        card = _luhn(body) == F.right(value, F.lit(1))
        changed = F.when(card, let(permute_text(body, key, "card"), lambda b: F.concat(b, _luhn(b)))).otherwise(
            permute_text(value, key, "number"))
        return _refill(hit, changed)

    return let(_digits(hit), made)


def _ssn(hit: Column, key: str) -> Column:
    area, group, serial = (F.substring(hit, *x).cast("int") for x in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    number = ((area - 1 - (area > 666).cast("int")).cast("long") * 99 + group - 1) * 9999 + serial - 1

    def put(n: Column) -> Column:
        first = F.floor(n / F.lit(99 * 9999)).cast("int") + 1
        rest = F.pmod(n, F.lit(99 * 9999).cast("long"))
        return F.concat(
            F.lpad((first + (first > 665).cast("int")).cast("string"), 3, "0"), F.lit("-"),
            F.lpad((F.floor(rest / F.lit(9999)) + 1).cast("string"), 2, "0"), F.lit("-"),
            F.lpad((F.pmod(rest, F.lit(9999).cast("long")) + 1).cast("string"), 4, "0"))

    plain = _refill(hit, permute_text(_digits(hit), key, "number"))
    return F.when(valid, let(permute_number(number, 898, 99 * 9999, key, "ssn"), put)).otherwise(plain)


def _phone(hit: Column, key: str) -> Column:
    """The digits after the country code or the 0 of a national number, permuted."""
    def made(value: Column) -> Column:
        code = F.when(value.rlike("^[17]"), 1).when(
            value.rlike("^(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), 2).otherwise(3)
        trunk = hit.rlike("^\\+[0-9]{1,3}[ .-]?\\(0\\)").cast("int")
        national = (value.startswith("0") & ~hit.rlike(f"^{_NORTH_AMERICAN}$")).cast("int")
        return let(F.when(hit.startswith("+"), code + trunk).otherwise(national), lambda n: _refill(
            hit, F.concat(F.left(value, n), permute_text(F.substr(value, n + 1), key, "phone"))))

    return let(_digits(hit), made)


def _ip(hit: Column, key: str) -> Column:
    parts = F.split(hit, "\\.")
    number = reduce(lambda a, k: a * 256 + F.element_at(parts, k).cast("long"), range(2, 5), F.element_at(parts, 1).cast("long"))
    return let(permute_number(number, 65536, 65536, key, "ip"), lambda n: F.concat_ws(
        ".", *(F.pmod(F.shiftright(n, s), F.lit(256).cast("long")).cast("string") for s in (24, 16, 8, 0))))


def _email(hit: Column, key: str) -> Column:
    """The local part is permuted, alike for either case; the domain stays."""
    parts = F.split(hit, "@")
    return F.concat(permute_text(F.lower(F.element_at(parts, 1)), key, "email"), F.lit("@"), F.element_at(parts, 2))


def pseudonym(kind: Column, hit: Column, key: str) -> Column:
    made = (
        F.when(kind == "email", _email(hit, key)).when(kind == "ip", _ip(hit, key)).when(kind == "date", _date(hit, key))
        .when(kind == "iban", _iban(hit, key)).when(kind == "ssn", _ssn(hit, key)).when(kind == "phone", _phone(hit, key))
        .when(kind == "number", _number(hit, key)).when(kind == "secret", permute_text(hit, key, "secret", 6)))
    return F.coalesce(made, hit)


def _kind(hit: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS.items()):
        out = F.when(hit.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str = DEMO_KEY, column: str = "text") -> DataFrame:
    """docs with `column` rewritten and a column found, an array of (kind, hit, pseudonym).

    A null text stays null with nothing found; one without digits and @ isn't searched. Values
    keep their length, but for IP addresses (1 to 3 digits a part) and dates without zeros before one digit. Every row gets its result. An existing column found is replaced.
    """
    text = F.col(column).cast("string")
    searched = F.when(text.rlike("[0-9@]"), let(_pattern(text), lambda p: F.struct(
        F.regexp_extract_all(text, p, F.lit(0)).alias("hits"), F.split(text, p, -1).alias("between"))))
    rows = docs.drop("found").withColumn("found", searched)
    between = "_between_"
    rows = rows.withColumn(between, F.col("found.between")).withColumn("found", F.transform(
        F.coalesce("found.hits", F.array().cast("array<string>")),
        lambda hit: let(_kind(hit), lambda kind: F.struct(kind.alias("kind"), hit.alias("hit"), pseudonym(kind, hit, key).alias("pseudonym")))))
    woven = F.concat(F.array_join(F.zip_with(F.slice(between, 1, F.size("found")), F.col("found"), lambda a, x: F.concat(a, x["pseudonym"])), ""), F.element_at(between, -1))
    return rows.withColumn(column, F.when(F.size("found") > 0, woven).otherwise(text)).drop(between)
