"""Reusable tests on lines and values."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclens import vocabulary as V
from doclens.functions.extract import DATE, EMAIL, MONEY
from doclens.functions.text import digits_of_letters, form_label, heading, let, norm, some_word

_NUMERIC_FORM = [
    "year_covered", "variety_unit_sales", "variety_dollar_sales", "pack_size_sold", "tar", "nicotine", "total_area_budget", "current_bal_available",
    "this_change", "new_balance", "committed_to_date", "total_cost", "previous_commitments", "amt_of_change", "total_reportable_expenditures_for_variety",
]


def alternation(words: list[str]) -> str:
    """Longest first, so that a label wins over its own beginning."""
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def firsts(words: list[str]) -> str:
    """A look ahead at the first letter of the words, in both cases: at most places of a text it spares the search for each of them."""
    return "(?=[" + "".join(sorted({re.escape(x) for w in words for x in (w[0].lower(), w[0].upper())})) + "])"


def without_colons(c: Column) -> Column:
    """In lower case and without colons at the end."""
    return F.rtrim(norm(c), F.lit(":"))


def mentions(c: Column, labels: list[str]) -> Column:
    """Whether a label stands anywhere as words of its own: one look at a line that spares what is asked of labels."""
    return F.lower(c).rlike(mention(labels))


def mention(labels: list[str]) -> str:
    return rf"{firsts(labels)}\b(?:{alternation(labels)})(?!\w)"


def label_match(c: Column, labels: list[str]) -> Column:
    marked = lambda low: low.rlike("[:#-]") & low.rlike(rf"{firsts(labels)}\b(?:{alternation(labels)})(?!\w)\s*[:#-]")
    return let(without_colons(c), lambda low: low.isin(labels) | marked(low))


def dated(c: Column) -> Column:
    """Whether a date is in it; every date has a digit."""
    return c.rlike("[0-9]") & c.rlike(DATE)


def mailed(c: Column) -> Column:
    return F.contains(c, F.lit("@")) & c.rlike(EMAIL)


def stop_header(c: Column) -> Column:
    return without_colons(c).isin(V.STOP_HEADERS)


def any_label(c: Column) -> Column:
    groups = (V.INVOICE_LABELS, V.DATE_LABELS, V.DUE_LABELS, V.CUSTOMER_LABELS, V.VENDOR_LABELS, V.TOTAL_LABELS, V.SUBTOTAL_LABELS, V.TAX_LABELS, V.DISCOUNT_LABELS, V.PAYMENT_LABELS)
    return without_colons(c).isin(sorted({w for g in groups for w in g} | set(V.STOP_HEADERS)))


def words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+"))  # split() would compile its pattern for each text


def invoice_id(c: Column) -> Column:
    """A letter and a digit, compact, and neither a date, an address, a time nor a heading."""
    bad = dated(c) | mailed(c) | c.rlike(r"(?i)(?=[ap])\b(?:am|pm)\b") | c.rlike(r"^(?:\d{5,}|[\d\s:./-]+)$") | stop_header(c)
    return c.isNotNull() & c.rlike(r"\d") & c.rlike("[A-Za-z]") & (F.length(c) <= 50) & (words(c) <= 3) & ~bad


def party_name(c: Column) -> Column:
    return c.isNotNull() & c.rlike("[A-Za-z]") & ~dated(c) & ~mailed(c) & ~stop_header(c) & ((F.length(c) < 25) | (words(c) <= 12))


def item_description(c: Column) -> Column:
    others = ["tel", "phone", "fax", "gst", "roc", "reg", "invoice", "bill to", "jalan", "street", "road", "avenue"]
    bad = stop_header(c) | dated(c) | mailed(c) | c.rlike(rf"(?i){firsts(others)}\b(?:{'|'.join(others)})\b") | c.rlike(r"^[\d\s.,]+$")
    return (F.length(c) <= 100) & c.rlike("[A-Za-z]{2,}") & ~bad


#: Fixed value: words that head columns of items, of which a heading has two.
ITEM_TERMS = ["description", "qty", "quantity", "unit price", "price", "amount", "item", "product", "total", "rate", "u.price"]


def item_header(c: Column) -> Column:
    return let(F.lower(c), heads_items)


def heads_items(low: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(t)).cast("int") for t in ITEM_TERMS]) >= 2


#: Fixed value: words of which each line that ends the items has one.
ITEM_ENDS = ["total", "tax amount", "gst summary", "discount", "rounding", "amount due", "balance due", "change", "cash", "payment method", "thank you", "terms"]


def item_stop(c: Column) -> Column:
    return c.rlike(r"(?i)(?=[sgtdrabcp])\b(?:sub\s*total|grand\s*total|total|tax amount|gst summary|discount|rounding|amount due|balance due|change|cash|payment method|thank you|terms)\b")


def address_line(c: Column) -> Column:
    suffix = r"(?i)(?=[srabdplwh])\b(?:ST|STREET|RD|ROAD|AVE|AVENUE|BLVD|DR|DRIVE|PL|PLACE|LN|LANE|WAY|HWY)\b"
    numbered = c.rlike(r"^\s*\d{1,6}\s+\S") & (F.regexp_count(c, F.lit("[A-Za-z]{2,}")) >= 2) & (F.length(c) >= 10)
    return c.rlike(r"\d") & (numbered | c.rlike(suffix))


def receipt_summary(c: Column) -> Column:
    return let(F.upper(c), lambda up: some_word(up, V.RECEIPT_SUMMARY))


def product_text(c: Column) -> Column:
    others = ["MANAGER", "CASHIER", "ST#", "OP#", "TERMINAL", "NETWORK", "APPROVAL", "AID", "REF"]
    return c.rlike("[A-Za-z][^A-Za-z]*[A-Za-z]") & let(F.upper(c), lambda up: ~(some_word(up, others) & up.rlike(rf"{firsts(others)}\b(?:{'|'.join(others)})\b")))


def price_only(c: Column) -> Column:
    return digits_of_letters(c).rlike(MONEY) & few_letters(c)


def few_letters(c: Column) -> Column:
    """At most two letters but for those of money; a text with three letters in a row has more."""
    return ~c.rlike("[A-Za-z]{3}") & (F.length(F.regexp_replace(F.regexp_replace(c, MONEY, ""), "[^A-Za-z]", "")) <= 2)


def numeric_value(c: Column) -> Column:
    return c.isin("-", "—", "–") | (c.rlike(r"\d") & c.rlike(r"(?i)^[$€£]?\s*[\d,.\s]+(?:\s*(?:mg|kg|%|k|m))?\s*[$€£]?$"))


def date_value(c: Column) -> Column:
    return c.rlike(r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2})\b")


def email_value(c: Column) -> Column:
    return c.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")


def checkbox_value(c: Column) -> Column:
    return F.lower(c).isin(V.CHECKBOX_MARKS)


def row_marker(c: Column) -> Column:
    return c.rlike(r"^[({]\s*\d+\s*[)}]$")


def form_numeric(label: Column) -> Column:
    return label.isin(_NUMERIC_FORM) | label.rlike("^cat_[a-m]_expenses$")


def form_instruction(c: Column) -> Column:
    return instruction_named(c, form_label(c))


def instruction_named(c: Column, label: Column) -> Column:
    """``form_instruction`` of a line whose normalised label is known."""
    return label.isin(sorted({re.sub(r"[^a-z0-9]+", "_", w).strip("_") for w in V.FORM_INSTRUCTIONS})) | c.rlike(r"^\(.*\)$")


def checkbox_option(label: Column) -> Column:
    """Whether a normalised label begins as an option to check does."""
    return label.rlike("^(?:" + "|".join(V.CHECKBOX_OPTIONS) + ")")


def checkbox_field(label: Column) -> Column:
    return label.isin(V.CHECKBOX_FIELDS)


def known_label(label: Column) -> Column:
    names = sorted({re.sub(r"[^a-z0-9]+", "_", w).strip("_") for w in V.KNOWN_LABELS})
    return label.rlike(rf"^(?:{'|'.join(names)})\z|^(?:{'|'.join(V.CHECKBOX_OPTIONS)})")


def form_labelled(c: Column) -> Column:
    return F.contains(c, F.lit(":")) | let(form_label(c), labelled_named)


def labelled_named(label: Column) -> Column:
    return label.rlike("^cat_[a-z]_expenses$") | known_label(label)


def form_junk(c: Column) -> Column:
    """Each pattern is tried only on a value of such a length, beginning or end as it asks for."""
    short = c.rlike("^[A-Za-z]{1,3}$") & ~F.lower(c).isin("x", "xx", "mg", "yes", "no")
    small = (F.length(c) <= 3) & (((F.length(c) <= 1) & ~c.rlike("[A-Za-z0-9$€£]")) | short)
    return small | (F.endswith(c, F.lit(")")) & c.rlike(r"^[qQ]\d+\)$")) | (F.substring(c, 1, 1).isin(list("$<>~`'\"^")) & c.rlike(r"^[$<>~`'\"^]+$"))


def form_acceptable(value: Column, label: Column, told: Column | None = None) -> Column:
    """Whether a label may have the value; ``told``: whether the value is an instruction, where that is known."""
    typed = (
        F.when(form_numeric(label), numeric_value(value) | ((label == "pack_size_sold") & value.rlike(r"(?i)^\d+(?:\.\d+)?(?:['’]s)?$")))
        .when(F.contains(label, F.lit("date")), date_value(value))
        .when(label.isin("email", "email_address"), email_value(value))
        .otherwise(F.lit(True))
    )
    junk = form_junk(value) & ~F.lower(value).isin("x", "xx", "-", "—", "–")
    return F.coalesce((value != "") & ~junk & typed & ~(form_instruction(value) if told is None else told), F.lit(False))


def person_shape(c: Column) -> Column:
    """Two to five words of letters."""
    return (F.length(c) <= 80) & c.rlike(r"^[A-Za-z][A-Za-z.\-']*(?:\s+[A-Za-z][A-Za-z.\-']*){1,4}$")


def resume_name(c: Column, blocked: list[str] | None = None) -> Column:
    headings = sorted({w for group in V.SECTIONS.values() for w in group} | set(blocked or []))
    return words(c).between(2, 4) & c.rlike(r"^[A-Za-zÀ-ÿ]+(?:[ .'-]+[A-Za-zÀ-ÿ]+)*$") & ~heading(c).isin(headings)


def section_of(c: Column, headers: dict[str, list[str]] = V.SECTIONS) -> Column:
    """Section that a heading line opens, or null."""
    named = lambda head: reduce(lambda out, name: F.when(head.isin(headers[name]), F.lit(name)).otherwise(out), list(headers)[::-1], F.lit(None).cast("string"))
    return let(heading(c), named)


def truthy(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("true", "yes", "1")
