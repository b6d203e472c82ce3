r"""Format-preserving pseudonyms for personal values, in DataFrame expressions alone.

Values are found by pattern and validated (check digits, real dates, octet
ranges). A value is then a list of symbols, each with its own modulus: decimal
digits, letters, octets, the parts of a day number. A keyed Feistel network
permutes the list: in every round one half is shifted, symbol by symbol, by
SHA-256 of key, kind, round and the other half. Each round can be undone, so
the whole is a permutation of the format: separators, letter case, lengths and
prefixes stay, check digits are computed anew, and equal values, however they
are written, get equal pseudonyms in all documents.

Kinds: e-mail addresses (all labels but the last), telephone numbers (calling
code of one to three digits kept), payment cards (first digit kept, Luhn), IBANs
in any case (country kept, mod 97), US social security numbers, IPv4 addresses,
dates from 1800 to 2199 (year-month-day, or with the year last; day first unless
only month first is a date), and secrets: what follows a usual label up to a
blank or quote, from eight characters on, and tokens of well-known prefixes with
or without a label. A secret's punctuation and known prefix stay. One of
hexadecimal digits alone stays such, and any other keeps its first character
that is no hexadecimal digit apart from those, so no two secrets of different
classes can meet in one pseudonym.

Defined cases: a null text stays null and has no values; an empty text stays
empty; a value that fails its validation stays as it is; repeated rows give
equal rows; further columns are passed through; empty tables give empty
results. No shuffle, no state between rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acequia.llm.common import col, free_name

ROUNDS = 10
SECRET_PIECE = 128
KEY_SETTING = "acequia.llm.pii.key"
#: For trials and tests alone; a session that keeps pseudonyms secret sets its own key.
OPEN_KEY = "acequia open key"

#: Days of the Gregorian cycle of 400 years, as a product of two moduli, from 1800-01-01.
FIRST_DAY, DATE_MODULI = -62_091, (189, 773)

#: A whole value of digits; a separator before one ends the value in front of it.
_NEXT = (
    r"(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,3}(?:\.\d{1,3}){3}"
    r"|\d{3}-\d{2}-\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)"
)
#: Length of an IBAN by country, as registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_of(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    last = f" ?[A-Z0-9]{{{rest}}}" if rest else ""
    return rf"(?:{countries.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}{last}(?![A-Za-z0-9])"


#: Usual labels of secrets, and how well-known tokens begin.
_LABEL = r"(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"'`]?|(?i:bearer)\s{1,3}"
_TOKENS = {
    r"gh[pousr]_": r"[A-Za-z0-9]{16,}+",
    r"github_pat_": r"[A-Za-z0-9_]{16,}+",
    r"sk-": r"[A-Za-z0-9_-]{16,}+",
    r"[sr]k_(?:live|test)_": r"[A-Za-z0-9]{10,}+",
    r"xox[abeoprs]-": r"[A-Za-z0-9-]{8,}+",
    r"AIza": r"[A-Za-z0-9_-]{30,}+",
    r"eyJ": r"[A-Za-z0-9_-]{5,}+\.[A-Za-z0-9_-]{5,}+\.[A-Za-z0-9_-]*+",
    r"AKIA": r"[0-9A-Z]{16}(?![A-Za-z0-9])",
}
#: What stays of a secret: its label and its known prefix.
_SECRET_HEAD = rf"^(?:{_LABEL})?(?:{'|'.join(_TOKENS)})?"
#: Telephone calling codes of one and two digits; all others have three.
_CALLING = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3})"

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": rf"(?:{_LABEL})[^\s\"'`]{{8,}}+|" + "|".join(f"{head}{rest}" for head, rest in _TOKENS.items()),
    # As long as its country says, so that it takes in no neighbour; of other countries, one without blanks.
    "iban": "(?i:"
    + "|".join(_iban_of(n, countries) for n, countries in IBAN_LENGTHS.items())
    + r"|[A-Z]{2}\d{2}[A-Z0-9]{8,31}(?![A-Za-z0-9]))",
    "date": rf"\d{{4}}-\d{{2}}-\d{{2}}(?!\d|-(?!{_NEXT})\d)|\d{{4}}/\d{{2}}/\d{{2}}(?!\d|/(?!{_NEXT})\d)"
    rf"|\d{{1,2}}/\d{{1,2}}/\d{{4}}(?!\d|/(?!{_NEXT})\d)|\d{{1,2}}\.\d{{1,2}}\.\d{{4}}(?!\d|\.\d)",
    "ipv4": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "ssn": rf"\d{{3}}-\d{{2}}-\d{{4}}(?!\d|-(?!{_NEXT})\d)",
    "nanp": r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|\+1\d{10}(?!\d)",
    "phone": rf"\+[2-9]\d{{0,2}}(?:(?!-{_NEXT})[ .-]?\(?\d{{1,4}}\)?){{2,5}}(?!\d|\.\d)",
    # Groups are those printed on cards: a number after a card is not part of it.
    "card": r"\d{13,19}(?!\d)|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}(?!\d|\.\d)|\d{4}[ -]\d{6}[ -]\d{5}(?!\d)",
}
#: Kinds that start with a digit may be the rest of a longer number: after a digit and a dot, slash or
#: hyphen they start only if that slash or hyphen parts them from the value found before.
_NUMBERS = ("date", "ipv4", "ssn", "nanp", "card")
_ALONE = r"(?:(?<=\G[/-])|(?<!\d[./-]))"
#: One alternation; a value starts where no letter or digit is before it. A comma parts values.
PATTERN = (
    "(?<![A-Za-z0-9])(?:"
    + "|".join(f"{_ALONE}(?:{p})" if kind in _NUMBERS else p for kind, p in PATTERNS.items())
    + ")"
)


def session_key(spark: SparkSession) -> str:
    """The key set for this session, else the open one, with a warning."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms under the open key can be undone by anyone", stacklevel=2)
    return key or OPEN_KEY


def _int(c: Column) -> Column:
    return c.cast("int")


def feistel(values: Column, moduli: Column, kind: str, tweak: Column, key: str) -> Column:
    """A permutation of arrays of ints below ``moduli``, set by key, kind and tweak."""
    half = _int(F.floor(F.size(values) / 2))

    def shifted(own: Column, other: Column, first: Column, turn: Column) -> Column:
        def one(x: Column, j: Column) -> Column:
            modulus = F.get(moduli, first + j)
            said = F.concat_ws(
                "|", F.lit(key), F.lit(kind), tweak, F.size(values).cast("string"),
                turn.cast("string"), j.cast("string"), F.array_join(F.transform(other, lambda o: o.cast("string")), ","),
            )
            noise = F.conv(F.substring(F.sha2(said, 256), 1, 12), 16, 10).cast("long")
            return _int((x + noise) % modulus)

        return F.transform(own, one)

    def turn(state: Column, i: Column) -> Column:
        left, right = state["l"], state["r"]
        return F.struct(
            F.when(i % 2 == 0, shifted(left, right, F.lit(0), i)).otherwise(left).alias("l"),
            F.when(i % 2 == 0, right).otherwise(shifted(right, left, half, i)).alias("r"),
        )

    start = F.struct(
        F.slice(values, F.lit(1), half).alias("l"),
        F.slice(values, half + 1, F.size(values) - half).alias("r"),
    )
    rounds = F.array(*[F.lit(i) for i in range(ROUNDS)])
    return F.aggregate(rounds, start, turn, lambda s: F.concat(s["l"], s["r"]))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _digits(c: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(c, r"\D", "")), _int)


def _symbols(
    value: Column,
    free: Callable[[Column, Column, Column], Column],
    kind: str,
    key: str,
    tweak: Column | None = None,
    other: Column | None = None,
) -> Column:
    """``value`` with its free characters permuted, each within its own class.

    ``free(character, place, all)`` tells which letters and digits take part.
    With ``other``, a place, letters before it are a to f, and a small one at it
    is one of g to z.
    """
    tweak = F.lit("") if tweak is None else tweak
    other = F.lit(-1) if other is None else other

    def with_chars(chars: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(chars) - 1), lambda i: free(F.get(chars, i), i, chars))

        def with_places(at: Column) -> Column:
            def first(i: Column) -> Column:
                return F.when((i == other) & F.get(chars, i).rlike("[a-z]"), F.lit(6)).otherwise(F.lit(0))

            def number(i: Column) -> Column:
                c = F.lower(F.get(chars, i))
                return F.when(c.rlike("[0-9]"), _int(F.ascii(c) - 48)).otherwise(_int(F.ascii(c) - 97) - first(i))

            def modulus(i: Column) -> Column:
                letters = F.when(i < other, F.lit(6)).otherwise(F.lit(26) - first(i))
                return F.when(F.get(chars, i).rlike("[0-9]"), F.lit(10)).otherwise(letters)

            made = feistel(F.transform(at, number), F.transform(at, modulus), kind, tweak, key)

            def with_made(new: Column) -> Column:
                def char(c: Column, i: Column) -> Column:
                    n = F.get(new, _int(F.array_position(at, i)) - 1)
                    letter = F.char(n + 97 + first(i))
                    written = F.when(c.rlike("[0-9]"), n.cast("string")).otherwise(
                        F.when(c.rlike("[A-Z]"), F.upper(letter)).otherwise(letter)
                    )
                    return F.when(F.array_contains(at, i), written).otherwise(c)

                return F.array_join(F.transform(chars, char), "")

            return _let(made, with_made)

        return F.when(F.size(places) > 0, _let(places, with_places)).otherwise(F.array_join(chars, ""))

    return _let(_chars(value), with_chars)


def _is_sign(c: Column) -> Column:
    return c.rlike("[A-Za-z0-9]")


def _luhn(digits: Column, doubled: int) -> Column:
    """Luhn sum of digits; from the right, places of parity ``doubled`` count twice."""
    one = F.transform(
        F.reverse(digits),
        lambda d, i: F.when(i % 2 == doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d),
    )
    return F.aggregate(one, F.lit(0), lambda s, d: s + d)


def _card(value: Column, key: str) -> Column:
    last = F.length(F.regexp_replace(value, r"\D", ""))

    def free(c: Column, i: Column, chars: Column) -> Column:
        # Digits but the first and the last: the value starts and ends with a digit.
        return c.rlike("[0-9]") & (i > 0) & (i < F.size(chars) - 1)

    changed = _symbols(value, free, "card", key, F.concat_ws(",", F.substring(value, 1, 1), last.cast("string")))

    def checked(text: Column) -> Column:
        body = F.substring(text, F.lit(1), F.length(text) - 1)
        check = (10 - _luhn(_digits(body), 0) % 10) % 10
        return F.concat(body, check.cast("string"))

    return F.when(_luhn(_digits(value), 1) % 10 == 0, _let(changed, checked)).otherwise(value)


def _mod97(value: Column) -> Column:
    """The remainder of an IBAN without blanks, its first four characters moved to the end."""
    moved = F.concat(F.substring(value, F.lit(5), F.length(value)), F.substring(value, 1, 4))
    numbers = F.transform(
        _chars(moved), lambda c: F.when(c.rlike("[0-9]"), _int(F.ascii(c) - 48)).otherwise(_int(F.ascii(c) - 55))
    )
    return F.aggregate(
        numbers, F.lit(0), lambda s, n: _int((s * F.when(n > 9, F.lit(100)).otherwise(F.lit(10)) + n) % 97)
    )


def _iban(value: Column, key: str) -> Column:
    plain = F.upper(F.regexp_replace(value, " ", ""))
    changed = _symbols(
        value, lambda c, i, _: (i > 3) & _is_sign(c), "iban", key, F.upper(F.substring(value, 1, 2))
    )

    def checked(text: Column) -> Column:
        bare = F.regexp_replace(F.concat(F.substring(text, 1, 2), F.lit("00"), F.substring(text, F.lit(5), F.length(text))), " ", "")
        check = F.lpad((98 - _mod97(F.upper(bare))).cast("string"), 2, "0")
        return F.concat(F.substring(text, 1, 2), check, F.substring(text, F.lit(5), F.length(text)))

    return F.when(_mod97(plain) == 1, _let(changed, checked)).otherwise(value)


def _fields(value: Column, separator: str) -> Column:
    return F.transform(F.split(value, separator), _int)


def _ipv4(value: Column, key: str) -> Column:
    def written(octets: Column) -> Column:
        moduli = F.transform(octets, lambda _: F.lit(256))
        new = feistel(octets, moduli, "ipv4", F.lit(""), key)
        return F.when(
            F.forall(octets, lambda o: o < 256), F.array_join(F.transform(new, lambda o: o.cast("string")), ".")
        ).otherwise(value)

    return _let(_fields(value, r"\."), written)


def _ssn(value: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""

    def written(f: Column) -> Column:
        area, group, serial = f[0], f[1], f[2]
        valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
        place = area - 1 - F.when(area > 666, 1).otherwise(0)
        moduli = F.array(F.lit(898), F.lit(99), F.lit(9999))
        new = feistel(F.array(_int(place), group - 1, serial - 1), moduli, "ssn", F.lit(""), key)

        def joined(n: Column) -> Column:
            new_area = n[0] + 1 + F.when(n[0] >= 665, 1).otherwise(0)
            parts = ((new_area, 3), (n[1] + 1, 2), (n[2] + 1, 4))
            return F.concat_ws("-", *[F.lpad(p.cast("string"), width, "0") for p, width in parts])

        return F.when(valid, _let(new, joined)).otherwise(value)

    return _let(_fields(value, "-"), written)


def _phone(value: Column, key: str, nanp: bool) -> Column:
    """Digits after the calling code; ten in a North American number."""
    if not nanp:
        code = F.regexp_extract(value, _CALLING, 0)
        return _symbols(value, lambda c, i, _: (i >= F.length(code)) & c.rlike("[0-9]"), "phone", key, code)

    def free(c: Column, i: Column, chars: Column) -> Column:
        after = F.size(F.filter(F.slice(chars, i + 2, F.size(chars)), lambda c: c.rlike("[0-9]")))
        return c.rlike("[0-9]") & (after < 10)

    return _symbols(value, free, "nanp", key)


def _date(value: Column, key: str) -> Column:
    iso = value.rlike(r"^\d{4}")
    separator = F.regexp_extract(value, r"\D", 0)

    def written(parts: Column) -> Column:
        one, two, three = parts[0], parts[1], parts[2]

        def made(y: Column, m: Column, d: Column) -> Column:
            return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

        day_first, month_first = made(three, two, one), made(three, one, two)
        day = F.when(iso, made(one, two, three)).otherwise(F.coalesce(day_first, month_first))
        number = F.unix_date(day) - FIRST_DAY
        days = DATE_MODULI[0] * DATE_MODULI[1]

        def renamed(n: Column) -> Column:
            low = DATE_MODULI[1]
            pair = F.array(_int(F.floor(n / low)), _int(n % low))
            new = feistel(pair, F.array(*[F.lit(m) for m in DATE_MODULI]), "date", F.lit(""), key)

            def shown(p: Column) -> Column:
                d = F.date_from_unix_date(_int(p[0] * low + p[1] + FIRST_DAY))

                def field(number: Column, like: Column) -> Column:
                    text = number.cast("string")
                    return F.when(F.length(like) > 1, F.lpad(text, 2, "0")).otherwise(text)

                year = F.lpad(F.year(d).cast("string"), 4, "0")
                day_text, month_text = F.dayofmonth(d), F.month(d)
                return (
                    F.when(iso, F.concat_ws("-", year, field(month_text, two), field(day_text, three)))
                    .when(day_first.isNotNull(), F.concat_ws("-", field(day_text, one), field(month_text, two), year))
                    .otherwise(F.concat_ws("-", field(month_text, one), field(day_text, two), year))
                )

            return F.replace(_let(new, shown), F.lit("-"), separator)

        within = number.isNotNull() & (number >= 0) & (number < days)
        return F.when(within, _let(number, renamed)).otherwise(value)

    return _let(F.split(value, r"\D"), written)


def _email(value: Column, key: str) -> Column:
    """Everything but the last label; capitals do not tell two addresses apart."""
    at = F.length(value) - F.length(F.regexp_extract(value, r"[A-Za-z]+$", 0))
    return _symbols(value, lambda c, i, _: _is_sign(c) & (i < at), "email", key)


def _secret(value: Column, key: str) -> Column:
    """The letters and digits after label and known prefix.

    They are permuted in pieces of ``SECRET_PIECE`` characters, each under its
    place and the hash of all before it, so that the work grows with the length,
    not its square.
    """
    head = F.regexp_extract(value, _SECRET_HEAD, 0)
    secret = F.substring(value, F.length(head) + 1, F.length(value))

    def whole(long: Column) -> Column:
        pieces = F.regexp_extract_all(long, F.lit(rf"(?s).{{1,{SECRET_PIECE}}}"), F.lit(0))

        def piece(p: Column, i: Column) -> Column:
            before = F.sha2(F.substring(long, F.lit(1), i * SECRET_PIECE), 256)
            # The first letter that is no hexadecimal digit; beyond the end if there is none.
            other = F.length(F.regexp_extract(p, r"(?s)^[^A-Zg-z]*", 0))
            tweak = F.concat_ws(",", other.cast("string"), i.cast("string"), before)
            return _symbols(p, lambda c, _i, _c: _is_sign(c), "secret", key, tweak, other)

        return F.array_join(F.transform(pieces, piece), "")

    return F.concat(head, _let(secret, whole))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one value that ``PATTERN`` found; the value itself if it is not valid."""
    ciphers = {
        "email": _email, "secret": _secret, "iban": _iban, "date": _date, "ipv4": _ipv4, "ssn": _ssn,
        "nanp": lambda v, k: _phone(v, k, True), "phone": lambda v, k: _phone(v, k, False), "card": _card,
    }
    chosen = None
    for kind, pattern in PATTERNS.items():
        test = value.rlike(f"^(?:{pattern})$")
        made = ciphers[kind](value, key)
        chosen = F.when(test, made) if chosen is None else chosen.when(test, made)
    return chosen.otherwise(value)


def pseudonymise(docs: DataFrame, key: str, *, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with a struct ``out``: the new text, and how many values were found and replaced."""
    name, parts = free_name(docs, out), free_name(docs, "parts")
    given = col(text)
    found = F.regexp_extract_all(given, F.lit(PATTERN), F.lit(0))
    split = F.struct(
        found.alias("found"),
        F.transform(found, lambda v: pseudonym(v, key)).alias("new"),
        F.split(given, PATTERN, -1).alias("gaps"),
    )
    # Most texts hold no digit, sign or label that a value needs.
    may = given.rlike("[0-9@=:]|AKIA")
    marked = docs.withColumn(parts, F.when(may, split))
    held = col(parts)
    woven = F.transform(
        held["gaps"], lambda gap, i: F.concat(gap, F.coalesce(F.get(held["new"], i), F.lit("")))
    )
    changed = F.filter(F.arrays_zip(held["found"], held["new"]), lambda p: p["found"] != p["new"])
    result = F.struct(
        F.coalesce(F.array_join(woven, ""), given).alias("text"),
        F.coalesce(F.size(held["found"]), F.lit(0)).cast("long").alias("n_found"),
        F.coalesce(F.size(changed), F.lit(0)).cast("long").alias("n_replaced"),
    )
    return marked.withColumn(name, result).drop(parts)


def pseudonymised(docs: DataFrame, key: str, *, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in the text column; other columns and their order stay."""
    name = free_name(docs, "pii")
    made = pseudonymise(docs, key, text=text, out=name)
    return made.select(
        *[F.col(f"{name}.text").alias(c) if c == text else col(c) for c in docs.columns]
    )
