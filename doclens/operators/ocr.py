"""Words of OCR passes into lines, scores of passes, and the best pass of each document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Terms that show a pass read the page well, and their weights.
TERMS = {"subtotal": 12, "total": 8, "tax": 5, "change": 5, "items sold": 8, "receipt": 5, "rcpt": 5, "walmart": 4, "cash": 3, "debit": 3, "credit": 3, "visa": 3}
# Weights of lines, confidence, amounts, reference numbers, dates, lines that end in an amount, overlong lines and words, and
# the most of each that count.
LINES, MOST_LINES, CONFIDENCE = 0.15, 80, 0.35
AMOUNT, AMOUNTS, MOST_AMOUNTS = r"\b\d+[.,]\d{1,3}\b", 1.2, 40
REFERENCE, DATE, STRUCTURE = r"\b(?:tc|rcpt|receipt|txn|transaction|ref)\s*#?", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", 8
PRICED, PRICED_LINES, MOST_PRICED = r"[A-Za-z].*\d+[.,]\d{1,3}\s*$", 0.8, 30
PRICE_END = r"\d[.,]\d{1,3}\s*$"  # how such lines end: others are spared the search from each of their letters
OVERLONG, OVERLONG_LINES = 90, 1.5
WORD, WORDS, MOST_WORDS = "[A-Za-z]{2,}", 0.05, 60


def grouped_lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of each pass: words of a block, paragraph and line from left to right, and their mean confidence."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda w: w["text"])
    return words.where("text <> ''").groupBy(*keys, "block_num", "par_num", "line_num").agg(F.array_join(ordered, " ").alias("text"), F.round(F.avg("conf"), 2).alias("confidence"))


def pass_scores(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines, confidence, terms, amounts and structure of a pass count for it, overlong lines against it."""
    low, n = F.lower("text"), F.count("*")
    count = lambda pattern: F.sum(F.regexp_count("text", F.lit(pattern)))
    any_line = lambda test: F.max(test.cast("int"))
    score = F.least(n, F.lit(MOST_LINES)) * LINES + F.avg("confidence") * CONFIDENCE
    score += sum((any_line(F.contains(low, F.lit(t))) * w for t, w in TERMS.items()), F.lit(0))
    score += F.least(count(AMOUNT), F.lit(MOST_AMOUNTS)) * AMOUNTS
    score += (any_line(low.rlike(REFERENCE)) + any_line(F.col("text").rlike(DATE))) * STRUCTURE
    score += F.least(F.count_if(F.col("text").rlike(PRICE_END) & F.col("text").rlike(PRICED)), F.lit(MOST_PRICED)) * PRICED_LINES - F.count_if(F.length("text") > OVERLONG) * OVERLONG_LINES
    score += F.least(count(WORD), F.lit(MOST_WORDS)) * WORDS
    return lines.groupBy(*keys).agg(score.alias("ocr_score"), n.alias("line_count"), F.round(F.avg("confidence"), 2).alias("confidence"))


def best_pass(scores: DataFrame, doc: str = "doc_id", nth: str = "pass_no") -> DataFrame:
    """The pass of the highest score of each document, the earlier one of equals: a sum of partial results, not a sort."""
    top = F.max_by(F.struct(nth, "ocr_score", "line_count", "confidence"), F.struct(F.col("ocr_score"), -F.col(nth)))
    return scores.groupBy(doc).agg(top.alias("t")).select(doc, "t.*")
