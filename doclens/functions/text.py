"""Normalisation of text: Column to Column, all within the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclens import vocabulary as V

#: White space of Unicode, as a class body for Java patterns.
SPACES = r"\s\x1C-\x1F\x85   -     　"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: expressions inside lambdas share nothing by themselves."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def bound(value: Column, use) -> Column:
    """``let`` for long expressions whose type has an order. The largest of one element is that element; to get it by its place would have
    the type of all of ``use`` derived anew for each evaluation."""
    return F.array_max(F.transform(F.array(value), lambda v: use(v)))


#: The same white space, character by character.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space at both ends; trim() takes blanks alone. A list of characters: a pattern would look at every place of the text."""
    return F.btrim(c, F.lit(BLANKS))


def one_space(c: Column) -> Column:
    return F.regexp_replace(c, f"[{SPACES}]+", " ")


def single_spaced(x: Column) -> Column:
    """``one_space`` of a column or variable: a text of printable ASCII with single blanks, as most are, is left alone after one look."""
    return F.when(x.rlike("  |[^ -~]"), one_space(x)).otherwise(x)


def or_null(c: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(c, F.lit(""))


def replaced(c: Column, pairs: list[tuple[str, str]], any_case: bool = False) -> Column:
    """Literal substitutions one after another; texts that hold none are left alone after one look."""
    flag = "(?i)" if any_case else ""
    quoted = [(re.sub(r"([\\.*+?^${}()|\[\]-])", r"\\\1", old), new) for old, new in pairs]

    def mended(x: Column) -> Column:
        return reduce(lambda y, p: F.regexp_replace(y, flag + p[0], p[1].replace("\\", "\\\\").replace("$", "\\$")), quoted, x)

    olds = sorted({old.lower() if any_case else old for old, _ in pairs})
    holds = lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(old)) for old in olds])
    return let(c, lambda x: F.when(let(F.lower(x), holds) if any_case else holds(x), mended(x)).otherwise(x))


def correct_ocr(c: Column) -> Column:
    """Words that OCR misreads, then runs of blanks and of empty lines."""
    fixed = replaced(c, V.OCR_WORDS, any_case=True)
    return strip(F.regexp_replace(F.regexp_replace(fixed, r"[ ]{2,}", " "), r"\n{3,}", "\n\n"))


def clean_line(c: Column) -> Column:
    """An OCR line: single spaces, plain dashes, corrected words."""
    return correct_ocr(F.translate(strip(one_space(c)), "–— ", "-- "))


def normalize_resume(c: Column) -> Column:
    """Each step is left out where one look shows nothing to mend."""
    blanks = lambda x: F.when(x.rlike(r"\t|  "), F.regexp_replace(x, r"[ \t]+", " ")).otherwise(x)
    ends = lambda x: F.when(x.rlike(r"\n\n| \n|\n "), F.regexp_replace(F.regexp_replace(x, r"\n{2,}", "\n"), r" *\n *", "\n")).otherwise(x)
    return strip(let(let(replaced(c, V.RESUME_WORDS), blanks), ends))


def fix_invoice_digits(c: Column) -> Column:
    """O, I, l and | between digits are 0 and 1; X-]5 is X-15."""
    zeros = F.regexp_replace(c, r"(?<=\d)[Oo](?=\d)", "0")
    fixed = F.regexp_replace(F.regexp_replace(zeros, r"(?<=\d)[Il|](?=\d)", "1"), r"(?i)([A-Z]-)\](?=\d)", "$11")
    return F.when(c.rlike(r"[0-9][OoIl|]|\]"), fixed).otherwise(c)


def clean_receipt_line(c: Column) -> Column:
    mended = F.regexp_replace(F.translate(c, "\u0000‘’“”", " ''\"\""), r"[ \t]+", " ")
    return strip(F.when(c.rlike("  |[^ -~]"), mended).otherwise(c))


def fix_receipt_labels(c: Column) -> Column:
    whole = F.regexp_replace(c, r"(?i)\bSUBTOT[A-Z]L\b", "SUBTOTAL")
    fixed = F.regexp_replace(F.regexp_replace(whole, r"(?i)\bTOTA[L1]\b", "TOTAL"), r"(?i)\bTAX\b", "TAX")
    return F.when(c.rlike("[Tt](?:[Oo][Tt]|[Aa][Xx])"), fixed).otherwise(c)


def digits_of_letters(c: Column) -> Column:
    """O, o, l and I as digits, in texts known to be numbers."""
    return F.translate(c, "OolI", "0011")


def normalize_form_line(c: Column) -> Column:
    """One colon form, no space before it, and on the label's side plain dashes and no quotes."""
    line = F.regexp_replace(strip(single_spaced(F.translate(c, "：", ":"))), r"\s+:", ":")
    plain = c.rlike(r"^[!-}](?:[ -}]*[!-}])?\z") & ~c.rlike("  | :|[='\"]")  # nothing to mend, as in most lines
    return F.when(plain, c).otherwise(let(line, _mended_form_line))


def _mended_form_line(line: Column) -> Column:
    label = F.regexp_replace(F.translate(F.regexp_extract(line, r"^([^:]*):", 1), "~=", "--"), "[\"']", "")
    return F.when(F.contains(line, F.lit(":")), F.concat(label, F.regexp_extract(line, r"^[^:]*(:.*)$", 1))).otherwise(line)


def form_label(c: Column) -> Column:
    other = lambda name: F.when(name == "products_length", "product_length").when(name == "cat_3", "cat_b").when(name == "cat_p", "cat_f").otherwise(name)
    return let(F.btrim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), F.lit("_")), other)


def form_value(c: Column) -> Column:
    bare = strip(F.rtrim(F.ltrim(strip(c), F.lit("|:;,_\\")), F.lit("|;")))
    return F.regexp_replace(bare, r"^[xX]{1,3}$", "X")


def skill_text(c: Column) -> Column:
    return strip(one_space(F.regexp_replace(F.regexp_replace(F.lower(c), "&", " and "), r"[-_/]+", " ")))


def heading(c: Column) -> Column:
    return strip(one_space(F.translate(F.regexp_replace(F.lower(c), ":", ""), "-_", "  ")))


def plain_words(c: Column) -> Column:
    """In lower case, other characters than those of words as blanks; a text with nothing to mend is left alone after one look."""
    mended = lambda low: strip(one_space(F.regexp_replace(low, r"[^a-z0-9&+./#' -]", " ")))
    return let(F.lower(c), lambda low: F.when(low.rlike(r"[^a-z0-9&+./#' -]|  |^ | \z"), mended(low)).otherwise(low))


def fix_degree(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "(?i)bachlor", "Bachelor"), "(?i)mathamatics", "Mathematics")


def without_bullet(c: Column) -> Column:
    return F.regexp_replace(c, r"^[•●▪◦\-–—*]+\s*", "")


def without_product_ids(c: Column) -> Column:
    """Long codes anywhere, shorter ones before a word."""
    cut = F.regexp_replace(F.regexp_replace(c, r"\b\d{8,14}\b", " "), r"\b\d{5,7}\b(?=\s+[A-Za-z])", " ")
    # what is left of a text without long numbers, double blanks and odd characters is the text
    return F.btrim(F.when(c.rlike(r"\d{5}|  |[^ -~]"), strip(one_space(cut))).otherwise(F.trim(c)), F.lit("-*#.,: "))


def linkedin_url(c: Column) -> Column:
    """The canonical profile address in a misread one, or null."""
    u = F.regexp_replace(F.regexp_replace(c, r"[\\\s]", ""), r"(?i)\.com(?:l?inl?|/?inl)/?(?=[^/])", ".com/in/")
    user = F.regexp_extract(F.regexp_replace(u, r"(?i)/inl/", "/in/"), r"(?i)linkedin\.com/in/([A-Za-z0-9_%-]+)", 1)
    user = F.regexp_replace(user, r"(?i)^linl", "")
    return F.when(F.length(user) >= 3, F.concat(F.lit("https://www.linkedin.com/in/"), user))


def to_number(c: Column) -> Column:
    number = F.replace(F.trim(c), F.lit("%"), F.lit("")).try_cast("double")
    return F.nanvl(number, F.lit(None).cast("double"))


def safe_number(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def title_type(c: Column) -> Column:
    return F.initcap(F.trim(c))


def norm(c: Column) -> Column:
    """In lower case and with plain dashes."""
    return F.when(F.contains(c, F.lit("–")) | F.contains(c, F.lit("—")), F.translate(F.lower(c), "–—", "--")).otherwise(F.lower(c))


def some_word(low: Column, words: list[str]) -> Column:
    """Whether a text holds any of the words: where it does, a pattern that asks for one of them is tried, as looking for words takes far less than patterns do."""
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def mended_text(c: Column, odd: Column, lines: Callable[[Column], Column]) -> Column:
    """The ``lines`` of a text, none of them empty, joined by line ends. Where it is ASCII with no other white space than single blanks and line ends, none of them at the
    beginning or end of a line, and is not ``odd``, these are the text as it is, which is seen at once and not line by line."""
    text = F.coalesce(c, F.lit(""))
    ends = [F.startswith(text, F.lit(x)) | F.endswith(text, F.lit(x)) for x in (" ", "\n")]
    others = [x for x in BLANKS if x < "\x80" and x not in " \n"]
    blank = reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in ("  ", "\n ", " \n", "\n\n", *others)] + ends)
    return F.when((F.length(text) != F.octet_length(text)) | blank | odd, F.array_join(lines(text), "\n")).otherwise(text)


def split_lines(c: Column) -> Column:
    """Non-empty lines of a text."""
    text = F.coalesce(c, F.lit(""))
    every = F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]")
    plain = F.split(text, "\n")  # split at one character looks for no pattern
    return F.filter(F.when(text.rlike(r"[^\n -~]"), every).otherwise(plain), lambda x: x.rlike("[!-~]") | x.rlike(f"[^{SPACES}]"))
