"""Column functions on text.  Patterns are prefixed with ``(?U)`` where classes must be Unicode-aware."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kpimill.schema import PAGE

# What counts as personal data in a page text
PERSONAL_NUMBER = r"\b\d{6}[-+]\d{4}\b"
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
HANDLE = r"@[A-Za-z0-9_]{1,15}"
BIRTH_DATE = r"\bDOB:\s*(?:19|20)\d{2}/\d{2}/\d{2}\b"
# Words that a name recogniser wrongly takes for names, in any case
NO_NAMES = (
    "and", "do", "gr", "vice", "statens", "is", "revis", "aukt", "kass", "Led", "lem", "mar", "sum", "id",
    "supp", "cer", "föret", "kassach", "gransk", "general", "sek", "arb",
)
# The same, as spelt
NO_NAMES_AS_SPELT = ("Signerat", "jan", "kassa", "signe", "dista", "manuell", "Sek", "General")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Without white space at both ends, line breaks and no-break spaces included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def roman(n: Column) -> Column:
    """Roman numerals of 1 to 3999 by one lookup for each digit; empty for 0 and below."""
    digits = [
        ("", "M", "MM", "MMM"),
        ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"),
        ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"),
        ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"),
    ]
    n = n.cast("int")
    thousands = F.repeat(F.lit("M"), F.floor(n / 1000).cast("int"))
    rest = [F.element_at(F.array(*map(F.lit, row)), (F.floor(n / 10 ** (3 - k)) % 10 + 1).cast("int")) for k, row in enumerate(digits) if k]
    return F.when(n > 0, F.concat(thousands, *rest)).otherwise("")


def page_label(page: Column, offset: Column) -> Column:
    """The printed number: Roman of the physical page where it would be below 1."""
    return F.when(page - offset > 0, (page - offset).cast("string")).otherwise(roman(page))


def source_parts(source: Column, drop_empty: bool = True) -> Column:
    """The page references of a source text, without the page word."""
    parts = F.transform(F.split(F.replace(F.coalesce(source, F.lit("")), F.lit(PAGE), F.lit("")), ","), strip)
    return F.filter(parts, lambda x: x != "") if drop_empty else parts


def source_text(parts: Column) -> Column:
    """References in lexicographic order after the page word."""
    return F.concat(F.lit(f"{PAGE} "), F.array_join(F.array_sort(F.array_distinct(parts)), ", "))


def strip_fence(c: Column) -> Column:
    """Without a leading ```json and a trailing ```."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```json", ""), r"```$", ""))


def looks_like_json_object(c: Column) -> Column:
    return c.startswith("{") & c.endswith("}")


def hyphen_normalise(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s*-\s*", "-")


def mirror_collapse(c: Column) -> Column:
    """``Anna Anna`` (halves equal but for case around a middle space) becomes ``Anna``."""
    n = F.length(c)
    half = F.floor(n / 2).cast("int")
    left, right = F.substring(c, F.lit(1), half), F.substring(c, half + 2, half)
    return F.when((n >= 5) & (n % 2 == 1) & (F.substring(c, half + 1, F.lit(1)) == " ") & (F.lower(left) == F.lower(right)), left).otherwise(c)


def is_entity(c: Column) -> Column:
    """Neither a tag or handle nor a word of the stop lists.

    The first list is compared with lower-cased words, so its one capitalised entry never applies.
    """
    return ~c.rlike("^[#@]") & ~F.lower(c).isin(*NO_NAMES) & ~c.isin(*NO_NAMES_AS_SPELT)


def clean_entity(c: Column) -> Column:
    return mirror_collapse(hyphen_normalise(strip(c)))


def repair_split_emails(c: Column) -> Column:
    """Joins ``@domain`` fragments that a line break parted.  The pattern is a fixed value."""
    return F.regexp_replace(c, r"(?i)(@[^\s@]*)[\r\n]+([^\s@]+\.[a-z]{2,10})", "$1$2")


def redact(text: Column, terms: Column, mask: str = "█") -> Column:
    """Every hit of every term, in any case, longest terms first."""
    order = F.array_sort(F.filter(F.array_distinct(terms), lambda t: t != ""), lambda a, b: F.coalesce(F.nullif(F.length(b) - F.length(a), F.lit(0)), F.when(a < b, -1).when(a > b, 1).otherwise(0)))
    quoted = lambda t: F.concat(F.lit("(?iu)"), F.regexp_replace(t, r"([\\\[\](){}.*+?^$|#-])", r"\\$1"))
    return F.aggregate(order, text, lambda a, t: F.regexp_replace(a, quoted(t), F.lit(mask)))


def plain_number(c: Column) -> Column:
    """A number written with optional sign, decimals, spaces, decimal comma and currency mark, or null."""
    return F.replace(F.replace(F.replace(c, F.lit(" "), F.lit("")), F.lit("kr"), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def is_valid_numeric(c: Column) -> Column:
    return F.coalesce(plain_number(c).isNotNull(), F.lit(False))


def printed_number(text: Column) -> Column:
    """The number in a page's first or last line that is not blank, where it is marked as one: ``Sida 3``, ``- 3 -``, ``3 (12)``."""
    number = r"(?:[Ss]id(?:a|an)?\.? *(\d{1,3})(?: *(?:\(\d+\)|av \d+|/ *\d+))?|[-–] *(\d{1,3}) *[-–]|(\d{1,3}) *\(\d+\))"
    one = lambda p: F.coalesce(*[F.nullif(F.regexp_extract(text, p, k), F.lit("")) for k in (1, 2, 3)])
    return F.coalesce(one(rf"(?:^|\n)[ \t]*{number}\s*$"), one(rf"^\s*{number}[ \t]*(?:\r?\n|$)")).try_cast("int")


def sheet_name(c: Column) -> Column:
    """The first 31 characters, with path characters as hyphens."""
    return F.translate(F.substring(c, 1, 31), "/\\:", "---")


def extension(path: Column) -> Column:
    return F.element_at(F.split(F.lower(path), r"\."), -1)


def year_vote(text: Column, pattern: str = r"\b((?:19|20)\d{2})\b") -> Column:
    """The commonest year of a page; -1 if it has none, -2 if two are as common."""
    years = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda y: y.cast("int"))

    def decide(found: Column) -> Column:
        counts = F.transform(F.array_distinct(found), lambda y: F.struct(F.size(F.filter(found, lambda z: z == y)).alias("n"), y.alias("y")))
        return let(F.sort_array(counts, asc=False), lambda c: F.when(F.size(c) == 0, -1).when((F.size(c) > 1) & (F.get(c, F.lit(0))["n"] == F.get(c, F.lit(1))["n"]), -2).otherwise(F.get(c, F.lit(0))["y"]))

    return let(years, decide)


def regexes(names: Sequence[str] = ("personal", "email", "birth")) -> list[str]:
    table = {"personal": PERSONAL_NUMBER, "email": EMAIL, "handle": HANDLE, "birth": BIRTH_DATE}
    return [table[n] for n in names]
