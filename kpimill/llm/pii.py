"""Format-preserving Feistel pseudonyms for personal numbers, dates, addresses and secrets in text.

Every match is checked before it counts (check digits, octets, calendar) and is then permuted within its own format by
a keyed Feistel network: digits stay digits, letters stay letters of their case, a card stays a card with a valid check
digit, a date stays a date.  The permutation depends on the key and the format only, so equal values get equal pseudonyms
in every document and different ones different pseudonyms.  Whoever has the key can undo it, by the same rounds backwards.

The key itself never stands in a plan: the rounds use keys made from it for each kind, and these are marked so that Spark
leaves them out of explained plans, its user interface and event logs.

All of it is built-in column functions within a row: nothing is shuffled, and a text without a digit or an ``@`` is
passed on unseen.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
ROUND_KEY = "round-key-[0-9a-f]{64}"  #: how keys of the rounds look, for Spark's redaction


@dataclass(frozen=True)
class Key:
    """A secret and the direction in which it is used."""

    secret: str
    inverse: bool = False

    def of(self, kind: str) -> str:
        return "round-key-" + hmac.new(self.secret.encode(), kind.encode(), hashlib.sha256).hexdigest()

    def rounds(self) -> Column:
        return F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if self.inverse else F.sequence(F.lit(1), F.lit(ROUNDS))


def hide_round_keys(spark: SparkSession) -> None:
    """Adds :data:`ROUND_KEY` to the session's ``spark.sql.redaction.string.regex``."""
    name = "spark.sql.redaction.string.regex"
    now = spark.conf.get(name, None)
    if ROUND_KEY not in (now or ""):
        spark.conf.set(name, f"(?:{now})|{ROUND_KEY}" if now else ROUND_KEY)


#: Characters of an IBAN by country, from the SWIFT registry; other IBANs are told by their check digits alone
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ XK LT LU MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """Countries of known length first, so that a word that follows stays outside."""
    known = [rf"(?:{names.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, names in IBAN_SIZES.items()]
    other = rf"[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}\d{{2}})(?:{'|'.join([*known, other])})(?![A-Za-z0-9])"


KINDS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,6}\.[A-Za-z]{2,24}(?![A-Za-z0-9\-])",
    "secret": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?i:password|passwd|secret|token|api_key|apikey)\s{0,3}[=:]\s{0,3}\"?[A-Za-z0-9+/_~=.\-]{7,}[A-Za-z0-9+/_~=\-]",
    "iban": _iban_pattern(),
    "phone": r"(?<![0-9A-Za-z+])\+1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)|(?<![0-9A-Za-z])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![0-9A-Za-z\-])\d{3}-\d{3}-\d{4}(?![\d\-])|(?<![0-9A-Za-z.])\d{3}\.\d{3}\.\d{4}(?!\d|\.\d)"
    r"|(?<![0-9A-Za-z+])\+[2-9]\d{0,2}(?:[ \-]\d{2,4}){2,4}(?!\d)|(?<![0-9A-Za-z+])\+\d{9,15}(?!\d)",
    "ip": r"(?<![0-9.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "date": r"(?<![0-9\-/.])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4})(?![0-9\-/]|\.\d)",
    "person": r"(?<![0-9\-])\d{6}[\-+]\d{4}(?![0-9\-])|(?<![0-9\-])\d{3}-\d{2}-\d{4}(?![0-9\-])",
    "card": r"(?<![0-9])(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{4}|3[47]\d\d(?: \d{6} |-\d{6}-)\d{5})(?!\d)",
}
_FIRST = {"email": "@", "secret": r"^AKIA[A-Z0-9]{16}$|^[A-Za-z_]+\s*[=:]", "iban": "^[A-Z]{2}[0-9]", "phone": r"^[+(]|^\d{3}-\d{3}-|^\d{3}\.\d{3}\.\d{4}$", "ip": r"^\d{1,3}(?:\.\d{1,3}){3}$", "date": r"^\d{4}([-/])\d{2}\1\d{2}$|^\d{2}\.\d{2}\.\d{4}$", "person": r"^\d{6}[-+]\d{4}$|^\d{3}-\d{2}-\d{4}$", "card": r"^\d"}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _each(s: Column, body: Callable[[Column, Column], Column]) -> Column:
    """The characters of ``s`` after ``body(character, place from 1)``."""
    return F.when(F.length(s) < 1, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: body(F.substring(s, i, F.lit(1)), i)), ""))


def _turn(c: Column, by: Column, hexadecimal: bool) -> Column:
    """A character moved on within its class; others stay."""
    if hexadecimal:
        return F.substring(F.lit("0123456789abcdef"), (F.pmod(F.instr(F.lit("0123456789abcdef"), c) - 1 + F.pmod(by, F.lit(16)), F.lit(16)) + 1).cast("int"), F.lit(1))
    code = F.ascii(c)
    to = lambda first, n: F.char(first + F.pmod(code - first + F.pmod(by, F.lit(n)), F.lit(n)))
    return F.when(code.between(48, 57), to(48, 10)).when(code.between(97, 122), to(97, 26)).when(code.between(65, 90), to(65, 26)).otherwise(c)


def feistel_text(s: Column, key: Key, tweak: str, hexadecimal: bool = False) -> Column:
    """Permutes the strings of each pattern of classes: halves in turn are moved on by a keyed function of the other."""
    sign = -1 if key.inverse else 1

    def one(x: Column, r: Column) -> Column:
        half = F.floor(F.length(x) / 2).cast("int")
        left, right = F.substring(x, F.lit(1), half), F.substring(x, half + 1, F.length(x))
        even = r % 2 == 0
        seed = F.sha2(F.concat(F.lit(f"{key.of(tweak)}|"), r.cast("string"), F.lit("|"), F.length(x).cast("string"), F.lit("|"), F.when(even, right).otherwise(left)), 256)

        def moved(d: Column) -> Column:
            turn = lambda part: _each(part, lambda c, i: _turn(c, F.pmod(F.xxhash64(d, i), F.lit(1040)) * sign, hexadecimal))
            return F.when(even, F.concat(turn(left), right)).otherwise(F.concat(left, turn(right)))

        return _let(seed, moved)

    return F.aggregate(key.rounds(), s, one)


def feistel_number(x: Column, a: int, b: int, key: Key, tweak: str) -> Column:
    """Permutes 0 .. a * b - 1."""
    sign = -1 if key.inverse else 1

    def one(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        q, m = s["q"], s["m"]
        k = F.xxhash64(F.sha2(F.concat(F.lit(f"{key.of(tweak)}|"), r.cast("string"), F.lit("|"), F.when(even, m).otherwise(q).cast("string")), 256))
        return _let(k, lambda k: F.struct(F.when(even, F.pmod(q + F.pmod(k, F.lit(a)) * sign, F.lit(a))).otherwise(q).alias("q"), F.when(even, m).otherwise(F.pmod(m + F.pmod(k, F.lit(b)) * sign, F.lit(b))).alias("m")))

    start = F.struct(F.floor(x / b).cast("bigint").alias("q"), F.pmod(x, F.lit(b)).cast("bigint").alias("m"))
    return _let(F.aggregate(key.rounds(), start, one), lambda s: s["q"] * b + s["m"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """The weighted digit sum, the last digit counting once."""
    n = F.length(digits)

    def add(a: Column, i: Column) -> Column:
        v = F.substring(digits, i, F.lit(1)).cast("int")
        two = F.when((n - i) % 2 == 1, v * 2).otherwise(v)
        return a + two - F.when(two > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _fill(pattern: Column, chars: Column, of: str = "[0-9]", other: str = "[^0-9]") -> Column:
    """``pattern`` with its characters of the class replaced by those of ``chars`` in turn."""
    return _each(pattern, lambda c, i: F.when(c.rlike(of), F.substring(chars, F.length(F.regexp_replace(F.substring(pattern, F.lit(1), i), other, "")), F.lit(1))).otherwise(c))


def _card(h: Column, key: Key) -> Column:
    d = _digits(h)
    body = feistel_text(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
    whole = _let(body, lambda b: F.concat(b, F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))
    return F.when(luhn_sum(d) % 10 == 0, _let(whole, lambda w: _fill(h, w))).otherwise(h)


def _phone(h: Column, key: Key) -> Column:
    code = F.regexp_extract(h, r"^\+(?:1|[2-9]\d{0,2}(?=[ \-])|\d{2})", 0)  # the country stays
    rest = F.substring(h, F.length(code) + 1, F.length(h))
    return F.concat(code, _let(feistel_text(_digits(rest), key, "phone"), lambda d: _fill(rest, d)))


def _ip(h: Column, key: Key) -> Column:
    o = F.transform(F.split(h, "\\."), lambda x: x.cast("bigint"))
    value = F.aggregate(o, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)
    dotted = lambda v: F.concat_ws(".", *[F.pmod(F.floor(v / 256**k), F.lit(256)).cast("string") for k in (3, 2, 1, 0)])
    return F.when(F.exists(o, lambda x: x > 255), h).otherwise(_let(feistel_number(value, 65536, 65536, key, "ip"), dotted))


#: 1904 to 2099 are seven blocks of 28 years; 71589 = 147 * 487 days
_DAY0, _DATE_A, _DATE_B = "1904-01-01", 147, 487


def _date(h: Column, key: Key) -> Column:
    form = F.when(h.rlike("^....-"), "yyyy-MM-dd").when(h.rlike("^..../"), "yyyy/MM/dd").otherwise("dd.MM.yyyy")
    day = F.try_to_timestamp(h, form).cast("date")
    n = F.datediff(day, F.lit(_DAY0).cast("date"))
    moved = F.date_add(F.lit(_DAY0).cast("date"), feistel_number(n, _DATE_A, _DATE_B, key, "date").cast("int"))
    out = _let(moved, lambda d: F.when(h.rlike("^....-"), F.date_format(d, "yyyy-MM-dd")).when(h.rlike("^..../"), F.date_format(d, "yyyy/MM/dd")).otherwise(F.date_format(d, "dd.MM.yyyy")))
    return F.when(n.between(0, _DATE_A * _DATE_B - 1), out).otherwise(h)


def _person(h: Column, key: Key) -> Column:
    """Ten digits with a date and a check digit, or nine digits in groups of three, two and four."""
    d = _digits(h)
    day = F.try_to_timestamp(F.concat(F.lit("20"), F.substring(d, 1, 6)), F.lit("yyyyMMdd")).cast("date")
    n = F.datediff(day, F.lit("2000-01-01").cast("date"))  # 36525 = 75 * 487 days
    moved = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), feistel_number(n, 75, 487, key, "person").cast("int")), "yyMMdd")
    nine = F.concat(moved, feistel_text(F.substring(d, 7, 3), key, "person"))
    ten = _let(nine, lambda b: F.concat(b, F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))
    ssn = d.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")
    area, rest = F.substring(d, 1, 3).cast("int"), F.substring(d, 4, 6).cast("int")
    place = (area - F.when(area > 666, 2).otherwise(1)) * 989901 + (F.floor(rest / 10000) - 1) * 9999 + rest % 10000 - 1  # 898 areas, 99 * 9999 numbers

    def back(v: Column) -> Column:
        a = F.floor(v / 989901) + 1
        tail = F.pmod(v, F.lit(989901))
        return F.format_string("%03d-%02d-%04d", F.when(a >= 666, a + 1).otherwise(a), F.floor(tail / 9999) + 1, F.pmod(tail, F.lit(9999)) + 1)

    return (
        F.when((F.length(d) == 10) & day.isNotNull() & (luhn_sum(d) % 10 == 0), _let(ten, lambda t: _fill(h, t)))
        .when((F.length(d) == 9) & ssn, _let(feistel_number(place.cast("bigint"), 898, 989901, key, "ssn"), back))
        .otherwise(h)
    )


def _mod97(s: Column) -> Column:
    def add(a: Column, i: Column) -> Column:
        code = F.ascii(F.substring(s, i, F.lit(1)))
        return F.when(code < 58, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add)


def _iban_digits(s: Column) -> Column:
    return _mod97(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4)))


def _iban(h: Column, key: Key) -> Column:
    """The longest run of whole words from the start whose check digits are right; words after it stay."""

    def one(v: Column) -> Column:
        s = F.replace(v, F.lit(" "), F.lit(""))
        country, body = F.substring(s, 1, 2), F.substring(s, F.lit(5), F.length(s))
        new = feistel_text(body, key, "iban")
        whole = _let(new, lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
        return F.concat(_let(whole, lambda w: _fill(v, w, "[A-Z0-9]", "[^A-Z0-9]")), F.substring(h, F.length(v) + 1, F.length(h)))

    known = h.rlike("^(?:" + "|".join(IBAN_SIZES.values()).replace(" ", "|") + ")")
    words = F.size(F.split(h, " "))
    runs = F.when(known, F.array(h)).otherwise(F.transform(F.sequence(words, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(F.split(h, " "), F.lit(1), k), " ")))
    good = F.filter(runs, lambda v: (F.length(F.replace(v, F.lit(" "), F.lit(""))) >= 12) & (_iban_digits(F.replace(v, F.lit(" "), F.lit(""))) == 1))
    return _let(good, lambda g: F.when(F.size(g) > 0, _let(F.get(g, F.lit(0)), one)).otherwise(h))


def _email(h: Column, key: Key) -> Column:
    name, host = F.substring_index(h, "@", 1), F.substring_index(h, "@", -1)
    top = F.substring_index(host, ".", -1)
    domain = F.substring(host, F.lit(1), F.length(host) - F.length(top) - 1)
    # e-mail addresses are compared without regard to case in practice, but a format-preserving map keeps it
    return F.concat(feistel_text(name, key, "email"), F.lit("@"), feistel_text(domain, key, "host"), F.lit("."), top)


def _secret(h: Column, key: Key) -> Column:
    head = F.regexp_extract(h, r"^(?:AKIA|[A-Za-z_]+\s*[=:]\s*\"?)", 0)
    value = F.substring(h, F.length(head) + 1, F.length(h))
    # a long token goes block by block, as the work for one grows with the square of its length
    blocks = lambda tweak, hexadecimal: F.array_join(F.transform(F.regexp_extract_all(value, F.lit(".{1,256}"), F.lit(0)), lambda b: feistel_text(b, key, tweak, hexadecimal)), "")
    return F.concat(head, F.when(value.rlike("^[0-9a-f]+$"), blocks("hex", True)).otherwise(blocks("secret", False)))


_MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "phone": _phone, "ip": _ip, "date": _date, "person": _person, "card": _card}


def pseudonymise(text: Column, key: Key, kinds: tuple[str, ...] = tuple(KINDS)) -> Column:
    """struct(text, n): the text with pseudonyms (or, by the inverse key, the values again), and how many values changed."""
    pattern = "|".join(KINDS[k] for k in kinds).replace(r"([ \-])\d{4}\1\d{4}\1", r"(?<sep>[ \-])\d{4}\k<sep>\d{4}\k<sep>")

    def made(h: Column) -> Column:
        out = None
        for k in kinds:
            test = h.rlike(_FIRST[k])
            out = F.when(test, _MAKERS[k](h, key)) if out is None else out.when(test, _MAKERS[k](h, key))
        return out.otherwise(h)

    def rebuilt(hits: Column) -> Column:
        return _let(F.transform(hits, made), lambda new: _let(F.split(text, pattern, -1), lambda rest: F.struct(
            F.array_join(F.zip_with(rest, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "").alias("text"),
            F.size(F.filter(F.arrays_zip(hits.alias("a"), new.alias("b")), lambda x: x["a"] != x["b"])).cast("long").alias("n"),
        )))

    same = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))
    found = F.when(text.rlike(pattern), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), rebuilt)).otherwise(same)
    return F.when(text.rlike("[0-9@]|(?i:password|passwd|secret|token|apikey|api_key)"), found).otherwise(same)


def pseudonymise_documents(docs: DataFrame, key: str, kinds: tuple[str, ...] = tuple(KINDS), text_col: str = "text", count_col: str | None = "n_pseudonyms", inverse: bool = False) -> DataFrame:
    """``docs`` with the personal values of ``text_col`` replaced, and (unless None) ``count_col`` with their number.

    Kinds: e-mail and IPv4 addresses, phone numbers, payment cards (Luhn), IBANs (mod 97), personal numbers (date and
    Luhn; 3-2-4 digits), dates of 1904 to 2099, and secrets (access key ids; values after ``password=`` and the like).
    Dates are read as 1987-03-14, 1987/03/14 and 14.03.1987 only: where day and month could change places (03/04/1987),
    or a month is spelt out, a date is left alone.  Cards are read in one run of digits, in groups of 4-4-4-4 and 4-6-5;
    phone numbers with a country code, as (555) 123-4567, 555-123-4567 and 555.123.4567.
    ``inverse`` gives the values back where their pseudonyms still stand in a text.  A pseudonym is found again by its
    format, so one that got another one does not come back: grouped 4-6-5, a card whose pseudonym doesn't begin with 34
    or 37, and a secret of letters and digits that became hexadecimal digits only.

    What fails its check, such as a 16-digit number without a valid check digit, is left alone.

    Null texts stay null, empty ones empty; both count 0.  Rows are independent: repeated rows give repeated results, an
    empty table an empty one, and all other columns pass unchanged (one called like ``count_col`` is replaced).
    """
    hide_round_keys(docs.sparkSession)
    made = pseudonymise(F.col(text_col), Key(key, inverse), kinds)
    if count_col is None:
        return docs.withColumn(text_col, made["text"])
    own = "made"
    while own in {c.lower() for c in docs.columns}:
        own += "_"
    out = docs.withColumn(own, made)
    return out.withColumn(text_col, F.col(own)["text"]).withColumn(count_col, F.coalesce(F.col(own)["n"], F.lit(0).cast("long"))).drop(own)
