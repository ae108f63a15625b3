"""Values out of a text: first and all matches, gazetteer, skills, money. Null where there is none."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclens import vocabulary as V
from doclens.functions.text import digits_of_letters, let, or_null, skill_text, strip

EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?\d[\d\s\-]{8,}\d"
PHONE_WIDE = r"\+?\d[\d\s\-()]{8,}\d"
NUMBER_DATE = r"[\dO]{1,2}[/-][\dO]{1,2}[/-][\dO]{2,4}"
URL = r"https?://[^\s]+"
LINKEDIN = r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/[^\s]+"
GITHUB = r"(?i)(?:https?://)?(?:www\.)?github\.com/[^\s]+"
YEARS = r"(?i)\b((?:19|20)\d{2})\s*(?:-|–|—|to)\s*((?:19|20)\d{2}|present|current)\b"
MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
DATE = rf"(?i)\b(?:\d{{1,4}}[./-]\d{{1,2}}[./-]\d{{1,4}}|\d{{1,2}}\s+{MONTH}\s+\d{{2,4}}|{MONTH}\s+\d{{1,2}},?\s+\d{{2,4}})\b"
AMOUNT = r"(?<!\w)[(-]?(?:\d{1,3}(?:[,\s]\d{3})+(?:\.\d{1,4})?|\d+(?:[.,]\d{1,4})?)\)?(?!\w)"
MONEY = r"(?<!\w)(?:[$€£]\s*)?(?:\d{1,3}(?:[.,]\d{3})+(?:[.,]\d{2})?|\d+[.,]\d{2})(?!\w)"


def first(c: Column, pattern: str, group: int = 0) -> Column:
    return or_null(F.regexp_extract(c, pattern, group))


def every(c: Column, pattern: str) -> Column:
    """Distinct matches in order of first sight."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))


def email(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("@")), first(c, EMAIL))  # a text without that sign is not searched word by word


def email_of(lines: Column) -> Column:
    """First address of the lines; none goes over a line's end."""
    return F.get(F.array_compact(F.transform(F.filter(lines, lambda x: F.contains(x, F.lit("@"))), email)), F.lit(0))


def phone(c: Column) -> Column:
    return first(c, PHONE)


def date(c: Column) -> Column:
    """First date of numbers; the letter O counts as a zero."""
    return F.translate(first(c, NUMBER_DATE), "O", "0")


def url(c: Column) -> Column:
    return first(c, URL)


def currency(c: Column) -> Column:
    return F.upper(first(c, rf"(?i)\b({'|'.join(V.CURRENCIES)})\b", 1))


def phones(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(PHONE_WIDE), F.lit(0)), strip))


def mobile(c: Column) -> Column:
    """A mobile number of 11 local digits that begins with 03, from its local or international form."""
    digits = F.regexp_replace(first(c, r"(?:\+?92[\s-]?|0)3\d{2}[\s-]?\d{7}|(?:\+?92[\s-]?|0)3\d{2}[\s-]?\d{3}[\s-]?\d{4}"), r"\D", "")
    local = F.when(F.startswith(digits, F.lit("92")), F.concat(F.lit("0"), F.substring(digits, 3, 20))).otherwise(digits)
    return F.when(local.rlike(r"^03\d{9}$"), local)


def cities(c: Column, names: list[str] = V.CITIES) -> Column:
    """Places of the gazetteer that the text holds, in the gazetteer's order."""
    within = lambda low: F.filter(F.array(*map(F.lit, names)), lambda city: F.contains(low, F.lower(city)))
    return let(F.lower(c), within)  # bound once: a lambda would work it out for each place


def year_or_range(c: Column) -> Column:
    return F.coalesce(first(c, YEARS), first(c, r"\b(?:19|20)\d{2}\b"))


def skill_pattern(skill: str) -> str:
    return rf"(?<!\w){re.escape(skill.lower().replace('&', ' and '))}(?!\w)"


def has_skill(c: Column, skill: str) -> Column:
    return F.coalesce(skill_text(c).rlike(skill_pattern(skill)), F.lit(False))


def skills(c: Column, names: list[str] = V.SKILLS) -> Column:
    """Skills of the dictionary that the text names, sorted. Each is sought on its own: one may hold another."""
    named = lambda text: F.array(*[F.when(F.contains(text, F.lit(n.lower())) & text.rlike(skill_pattern(n)), F.lit(n)) for n in names])
    return F.coalesce(F.array_sort(F.array_distinct(F.array_compact(let(skill_text(c), named)))), F.expr("cast(array() as array<string>)"))


def money_value(c: Column) -> Column:
    """Decimal value of a printed amount: symbols off, O and l as digits, and the last of two kinds of separators, or one with other
    than three digits after it, as the decimal point."""
    bare = lambda x: let(digits_of_letters(F.regexp_replace(x, r"[$€£\s]", "")), _decimal)
    return let(c, lambda x: F.when(x.rlike(r"^\d+\.\d{2}\z"), x.try_cast("decimal(18,2)")).otherwise(bare(x)))


def _decimal(bare: Column) -> Column:
    comma, dot = F.contains(bare, F.lit(",")), F.contains(bare, F.lit("."))
    american = F.replace(bare, F.lit(","), F.lit(""))
    european = F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    plain = F.when(comma & dot, F.when(F.locate(".", F.reverse(bare)) < F.locate(",", F.reverse(bare)), american).otherwise(european))
    plain = plain.when(comma, F.when(bare.rlike(r"^\d{1,3}(,\d{3})+$"), american).otherwise(european))
    plain = plain.when(dot & bare.rlike(r"^\d{1,3}(\.\d{3})+$"), F.replace(bare, F.lit("."), F.lit(""))).otherwise(bare)
    return plain.try_cast("decimal(18,2)")


def money_tokens(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(MONEY), F.lit(0)), money_value)


def last_money(c: Column) -> Column:
    return F.when(c.rlike("[.,][0-9]"), money_value(F.try_element_at(F.regexp_extract_all(c, F.lit(MONEY), F.lit(0)), F.lit(-1))))  # every money has such


def amount_text(c: Column) -> Column:
    """The last amount of a text as a plain number; (x) and -x are negative."""
    return let(c, amount_of)


def amount_of(x: Column) -> Column:
    """``amount_text`` of a column or variable; a plain number is its own."""
    last = let(F.try_element_at(F.regexp_extract_all(x, F.lit(AMOUNT), F.lit(0)), F.lit(-1)), _signed)
    return F.when(x.rlike(r"^\d+(?:\.\d{1,4})?\z"), x).otherwise(last)


def keyword_amount(c: Column, keyword: str) -> Column:
    """The first number within 80 characters after a keyword (a pattern, in any case), over line ends; letters O in it are zeros."""
    found = F.regexp_extract(c, rf"(?is)(?:{keyword}).{{0,80}}?([0-9Oo]+(?:[.,][0-9Oo]{{1,4}})?)", 1)
    return amount_text(F.translate(found, "Oo", "00"))


def _signed(found: Column) -> Column:
    def number(bare: Column) -> Column:
        cents = F.contains(bare, F.lit(",")) & ~F.contains(bare, F.lit(".")) & bare.rlike(r",\d{1,2}$")
        return F.when(cents, F.replace(bare, F.lit(","), F.lit("."))).otherwise(F.replace(bare, F.lit(","), F.lit("")))

    signed = lambda n: F.when(n.rlike(r"^\d+(\.\d+)?$"), F.concat(F.when(found.rlike(r"^[(-]"), "-").otherwise(""), n))
    return let(let(F.regexp_replace(found, r"[()\s-]", ""), number), signed)


def form_number(c: Column) -> Column:
    return F.replace(first(c, r"[-+]?\d[\d,]*(?:\.\d+)?"), F.lit(","), F.lit("")).try_cast("double")


def two_places(c: Column) -> Column:
    return c.cast("decimal(18,2)").cast("string")


def grouped_number(c: Column) -> Column:
    """Thousands apart; at most two places, none that are zero."""
    return F.regexp_replace(F.regexp_replace(F.format_number(c, 2), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def word_first(pattern: str) -> tuple[str, str]:
    """A pattern that begins with a word, and then that word: rewritten to begin with the word's letters, which are sought faster than places where
    words begin; others as they are, without a word. A choice of patterns has no word in common."""
    found = re.match(r"\\b([a-z]+)(?![a-z])(?!\|)", pattern)
    word = found.group(1) if found else ""
    rest = pattern[2 + len(word) :]
    if rest[:1] and rest[0] in "?*+{":
        word, rest = word[:-1], word[-1:] + rest
    depths = [rest[:i].count("(") - rest[:i].count(")") for i, x in enumerate(rest) if x == "|"]
    return (rf"{word}(?<=\b{word}){rest}", word) if word and 0 not in depths else (pattern, "")


def occurs(low: Column, pattern: str) -> Column:
    """Whether a pattern occurs in a column or variable in lower case. One that begins with a word, or with a choice of plain words, is sought only where such a word is."""
    choice = re.fullmatch(r"\\b\(\?:([a-z |]+)\)\\b", pattern)
    parts = [rf"\b{word}\b" for word in choice.group(1).split("|")] if choice else [pattern]
    sought = lambda p, word: F.contains(low, F.lit(word)) & low.rlike(p) if word else low.rlike(p)
    return F.coalesce(reduce(lambda a, b: a | b, [sought(*word_first(p)) for p in parts]), F.lit(False))


def evidence(c: Column, patterns: list[str]) -> Column:
    """How many of the patterns (in lower case) occur, in any case."""
    return let(F.lower(c), lambda low: evidence_of(low, patterns, len(patterns)))


def evidence_of(low: Column, patterns: list[str], enough: int) -> Column:
    """``evidence`` of a variable in lower case. Patterns are sought a few at a time, and no more once ``enough`` are found."""
    found = lambda some: reduce(lambda a, b: a + b, [occurs(low, p).cast("int") for p in some])
    few = enough if enough < len(patterns) else len(patterns)

    def on(before: Column, rest: list[str]) -> Column:
        return F.when(before >= enough, before).otherwise(let(before + found(rest[:few]), lambda n: on(n, rest[few:]))) if rest else before

    return let(found(patterns[:few]), lambda n: on(n, patterns[few:]))


def json_first(j: Column, keys: list[str], kind: str = "string") -> Column:
    """First non-null value of the keys at the top, then below analysis, then below statistics, of a variant."""
    paths = [f"$.{k}" for k in keys] + [f"$.analysis.{k}" for k in keys] + [f"$.statistics.{k}" for k in keys]
    return F.coalesce(*[F.try_variant_get(j, p, kind) for p in paths])
