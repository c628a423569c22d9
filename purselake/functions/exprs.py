"""Scalar expressions over columns: typing, recoding, text and date rules.

Every function takes Columns (or constants) and returns a Column built from Spark's
own functions, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LEGAL_SUFFIXES = ("INC", "INCORPORATED", "LLC", "LLP", "LP", "LTD", "LIMITED", "CORP", "CORPORATION", "CO", "COMPANY", "PLC", "GMBH", "SA", "AG", "PTY", "JV", "TRUST", "FOUNDATION", "REALTY")
DIVISION_SUFFIXES = (
    "AEROSPACE OPERATIONS I", "AEROSPACE OPERATIONS", "NORTH AMERICAN", "CAPITAL", "SYSTEMS CORPORATION", "SYSTEMS CORP", "DEFENSE SYSTEMS",
    "GOVERNMENT SYSTEMS", "INFORMATION TECHNOLOGY", "INFORMATION SYSTEMS", "MISSION SYSTEMS", "GLOBAL", "TACTICAL SYSTEMS",
)
GENERIC_HEADS = ("UNITED", "GENERAL", "NATIONAL", "AMERICAN", "GLOBAL", "FIRST", "ADVANCED", "INTERNATIONAL", "DELTA", "APEX", "ALPHA", "OMEGA", "PRECISION", "MARITIME")
RESIDUE_WORDS = ("HOLDING", "HOLDINGS", "GROUP", "PLC", "SPA", "COMPANY", "CORPORATION", "INCORPORATED", "INTERNATIONAL", "AMERICA", "USA")
STOP_WORDS = (
    "the", "and", "for", "of", "to", "in", "a", "support", "services", "service", "program", "research", "development", "defense", "system", "systems",
    "technology", "technologies", "advanced", "based", "high", "performance", "management", "information", "operational", "tactical", "small",
)
AGENCY_BY_LETTER = {"D": "097", "N": "017", "A": "021", "F": "057"}
#: What may announce a budget line's number, as a pattern over lower-case words.
CODE_LABEL = r"blis?|budget lines?(?: items?)?|line items?|[pr]-?1 lines?(?: items?)?|program elements?|pe"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def try_double(c: Column) -> Column:
    return c.try_cast("double")


def federal_fiscal_year(date: Column) -> Column:
    """October opens the next year; null for an unparseable date."""
    return (F.year(date) + F.when(F.month(date) >= 10, 1).otherwise(0)).cast("int")


def flag_suspect_amount(amount: Column, ceiling: Column, cap) -> Column:
    return (amount > F.lit(cap)) | (amount > ceiling)


def recode(c: Column, pairs: dict, default: str) -> Column:
    out = reduce(lambda w, kv: w.when(c == kv[0], kv[1]), list(pairs.items())[1:], F.when(c == next(iter(pairs)), next(iter(pairs.values()))))
    return out.otherwise(default)


def bucketize(c: Column, edges: list[tuple[int, str]], last: str) -> Column:
    """Label of the first edge that the whole number ``c`` does not exceed."""
    n = F.round(c.try_cast("double")).cast("int")
    out = F.when(n.isNull() | (n < 1), "unknown")
    for top, label in edges:
        out = out.when(n <= top, label)
    return out.otherwise(last)


def coalesce_label(placeholder: str, *names: Column) -> Column:
    return F.coalesce(*[F.upper(blank_to_null(n)) for n in names], F.lit(placeholder))


def federal_account(account: Column, default: str) -> Column:
    """Prefix by the account's trailing service letter, else ``default``."""
    letter = F.upper(F.regexp_extract(account, "([A-Za-z])$", 1))
    agency = reduce(lambda w, kv: w.when(letter == kv[0], kv[1]), AGENCY_BY_LETTER.items(), F.when(F.lit(False), "")).otherwise(default)
    return F.concat(agency, F.lit("-"), F.regexp_replace(account, "[A-Za-z]$", ""))


def canonical_agency(code: Column, mapping: dict[str, str]) -> Column:
    key = blank_to_null(code)
    names = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.lower(key)), F.upper(key))


def normalize_name(c: Column) -> Column:
    """Upper-case name without punctuation, articles, legal suffixes and division
    suffixes, however many; a division suffix stays where only a generic word would be left."""
    up = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"(?<=[A-Z])\.(?=[A-Z])", "")
    up = F.trim(F.regexp_replace(F.regexp_replace(up, "[^A-Z0-9 ]+", " "), " +", " "))
    up = F.regexp_replace(up, "^(?:THE(?: |$))+", "")
    legal = "|".join(LEGAL_SUFFIXES)
    up = F.trim(F.regexp_replace(up, f"(?:(?:^| )(?:{legal}|THE))+$", ""))
    heads, divisions = "|".join(GENERIC_HEADS), "|".join(DIVISION_SUFFIXES)
    # The shortest head that is no generic word alone and is followed by suffixes only.
    return F.regexp_replace(up, f"^(.+?)(?<!^(?:{heads}))(?: (?:{divisions}))+$", "$1")


def hhi_band(v: Column) -> Column:
    points = F.floor(v + 0.5)
    return F.when(points > 1800, "concentrated").when(points >= 1000, "moderate").otherwise("unconcentrated")


def tokens(c: Column, stop=STOP_WORDS, longer_than: int = 3) -> Column:
    """Distinct lower-case alphanumeric words longer than ``longer_than``, without stop words."""
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > longer_than) & ~w.isin(*stop))))


def normalize_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\((?:mod|memo|adv|lrip)\)", " "), r"\s+", " "))


def title_jaccard(a: Column, b: Column) -> Column:
    x, y = (F.array_remove(F.array_distinct(F.split(normalize_title(t), " ")), "") for t in (a, b))
    both = F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / both)


def alnum_words(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", ""), r"\s+", " "))


def contiguous_tokens(hay: Column, needle: Column) -> Column:
    pad = lambda t: F.concat(F.lit(" "), alnum_words(t), F.lit(" "))
    return (F.length(alnum_words(needle)) > 0) & F.contains(pad(hay), pad(needle))


def holds_family(clean: Column, family: Column) -> Column:
    """Whether a normalized name holds a family's key as whole words in a row; a key of one
    word needs four letters."""
    return F.coalesce(contiguous_tokens(clean, family) & (F.contains(F.trim(family), F.lit(" ")) | (F.length(F.trim(family)) >= 4)), F.lit(False))


def word_boundary_match(text: Column, term: str) -> Column:
    import re

    return text.rlike(f"(?i)(?<![A-Za-z0-9]){re.escape(term)}(?![A-Za-z0-9])")


def labelled_code_match(text: Column, code: str) -> Column:
    """An all-digit code counts only as a whole number that a budget-line label announces,
    with nothing but separators and "no." or "number" between; others as plain words."""
    if not code.isdigit():
        return word_boundary_match(text, code)
    # Numbers with their thousands and decimals become one word, separators one space.
    numbers = F.regexp_replace(F.lower(text), r"(?<=\d)[.,](?=\d)", "_")
    words = F.concat(F.lit(" "), F.regexp_replace(numbers, r"[\s#:.]+", " "), F.lit(" "))
    spoken = F.regexp_replace(words, " (?:no|number) ", " ")
    after = r"(?![a-z0-9_])"
    return spoken.rlike(f"(?<![a-z0-9])(?:{CODE_LABEL}) {code}{after}")


def row_fact_id(*parts: Column) -> Column:
    """First 16 hex digits of SHA-256 over the parts joined by '|'; null if a part is null."""
    joined = [x for p in parts for x in (F.lit("|"), p.cast("string"))][1:]
    return F.substring(F.sha2(F.concat(*joined), 256), 1, 16)


def is_synthetic_key(code: Column) -> Column:
    return code.rlike("^[A-Za-z0-9#]+-[A-Za-z0-9]+-L[0-9]+$")


def mint_key(account: Column, org: Column, n: Column) -> Column:
    return F.format_string("%s-%s-L%d", account, org, n)


def parse_money(text: Column) -> Column:
    """Whole dollars of the first dollar figure, with million/billion or M/B units."""
    rx = r"\$\s?([0-9][0-9,]*(?:\.[0-9]+)?)\s*(million|billion|M\b|B\b)?"
    number = F.regexp_replace(F.regexp_extract(text, rx, 1), ",", "").try_cast("decimal(20,4)")
    unit = F.lower(F.regexp_extract(text, rx, 2))
    scale = F.when(unit.isin("million", "m"), 1_000_000).when(unit.isin("billion", "b"), 1_000_000_000).otherwise(1)
    return F.round(number * scale).cast("long")


def normalize_award_number(c: Column) -> Column:
    return F.translate(c, "- ", "")


def normalize_service_heading(c: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(c, r"&[A-Za-z#0-9]+;", " "), r"\s+", " ")
    return F.regexp_replace(clean, r"^[ .*]+|[ .*]+$", "")


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def positive_part(c: Column) -> Column:
    return F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))


def pct_change(old: Column, new: Column) -> Column:
    """Null when the base is null or zero; two decimals."""
    return F.when(old != 0, F.round((new - old) * 100 / F.nullif(old, F.lit(0)), 2))


def parse_clock(c: Column) -> Column:
    """Minutes after midnight of '6:30 AM'; null if it does not parse."""
    rx = r"^\s*([0-9]{1,2}):([0-9]{2})\s*([AaPp])[Mm]\s*$"
    hour, minute = F.regexp_extract(c, rx, 1).try_cast("int"), F.regexp_extract(c, rx, 2).try_cast("int")
    return hour % 12 * 60 + F.when(F.upper(F.regexp_extract(c, rx, 3)) == "P", 720).otherwise(0) + minute


def day_of_week(date: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(date) - 1


def next_occurrence(dow: Column, minutes: Column, now: Column) -> Column:
    """Next date of a weekday; today only while the time is still ahead."""
    today = F.to_date(now)
    ahead = F.pmod(dow - day_of_week(today), F.lit(7))
    passed = minutes <= F.hour(now) * 60 + F.minute(now)
    return F.date_add(today, F.when((ahead == 0) & passed, 7).otherwise(ahead).cast("int"))


def in_booking_window(date: Column, today: Column, days: int) -> Column:
    return date.between(today, F.date_add(today, days))


def stale_flag(status: Column, since: Column, attempts: Column, now: Column) -> Column:
    """Claimed over 30 minutes or running over 60, with attempts left."""
    late = ((status == "claimed") & (since < now - F.expr("INTERVAL 30 MINUTES"))) | ((status == "running") & (since < now - F.expr("INTERVAL 60 MINUTES")))
    return late & (attempts < 3)


def fold_quote_text(c: Column) -> Column:
    """Dashes and quotes unified, white space collapsed (text is NFKC already)."""
    return F.trim(F.regexp_replace(F.translate(c, "‐‑‒–—‘’“”", "-----''\"\""), r"\s+", " "))


def announced_value(amounts: Column) -> Column:
    return F.coalesce(F.try_element_at(amounts, F.lit(1)), F.lit(0))
