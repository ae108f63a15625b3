"""Documents as lines.

Extraction works on an array of lines inside one row, with higher-order functions: it is a projection, so a document of any kind is
read and extracted in one stage without a shuffle. The exploded table of lines is for relational work on lines.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.functions.text import bound, clean_line, norm, some_word, split_lines, strip

Test = Callable[[Column], Column]


def explode_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, line_no (from 0), text: the non-empty lines as they stand."""
    return docs.select(key, F.posexplode(split_lines(F.col(text))).alias("line_no", "text"))


def clean_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    # exploded rather than filtered: a filter would be pushed below the cleaning and work it out once more
    others = [c for c in lines.columns if c != "text"]
    cleaned = F.filter(F.array(clean_line(F.col("text"))), lambda x: x != "")
    return lines.select(*others, F.explode(cleaned).alias("text")).select(*lines.columns)


def dedupe_lines(lines: DataFrame, key: str = "doc_id", within: list[str] | None = None) -> DataFrame:
    """The first of the lines of a document (or page) that are equal in any case."""
    w = Window.partitionBy(key, *(within or []), F.lower("text")).orderBy("line_no")
    return lines.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def rejoin_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    text = F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")
    return lines.groupBy(key).agg(strip(F.regexp_replace(text, r"\n{3,}", "\n\n")).alias("text"), F.count("*").alias("line_count"))


def clean_array(lines: Column) -> Column:
    return F.filter(F.transform(lines, clean_line), lambda x: x != "")


def with_clean_lines(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Clean lines as an array, the first of equal ones in any case, without leaving the row."""
    places = F.transform(clean_array(split_lines(F.col(text))), lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("text")))
    ordered = docs.withColumn("_sorted", F.array_sort(places))
    s = F.col("_sorted")
    firsts = F.filter(s, lambda x, j: (j == 0) | (F.get(s, j - 1)["low"] != x["low"]))
    back = F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["text"].alias("text"))))
    return ordered.withColumn(out, F.transform(back, lambda x: x["text"])).drop("_sorted")


def concat_pages(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines of all pages of a document in page order, with page_no kept."""
    w = Window.partitionBy(key).orderBy("page_no", "line_no")
    return pages.withColumn("line_no", F.row_number().over(w) - 1)


def first_value(values: Column) -> Column:
    """First element that is not null."""
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def last_value(values: Column) -> Column:
    return F.try_element_at(F.filter(values, lambda x: x.isNotNull()), F.lit(-1))


def first_line(lines: Column, test: Test) -> Column:
    return F.get(F.filter(lines, test), F.lit(0))


def first_index(lines: Column, test: Test) -> Column:
    """Place (from 0) of the first line that passes, or null."""
    return first_value(F.transform(lines, lambda x, i: F.when(test(x), i)))


def following(lines: Column, at: Column, k: int) -> Column:
    return F.slice(lines, at + 2, k)


def until(lines: Column, stop: Test) -> Column:
    """Lines before the first that stops."""
    at = first_index(lines, stop)
    return F.slice(lines, F.lit(1), F.coalesce(at, F.size(lines)))


class Whole(NamedTuple):
    """A text as columns: its lines joined, its lines, and these in the case in which they are compared (lower, with plain dashes, or upper)."""

    text: Column
    lines: Column
    same: Column


def with_whole(docs: DataFrame, text: Column, same: Callable[[Column], Column] = norm) -> tuple[DataFrame, Whole]:
    """``docs`` with the columns of a ``Whole`` for the lines joined in ``text``, none of which is empty."""
    whole = F.col("_whole")
    every = lambda x: F.when(whole == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(x, "\n"))
    return docs.withColumn("_whole", text).withColumns({"_lines": every(whole), "_same": every(same(whole))}), Whole(whole, F.col("_lines"), F.col("_same"))


def common_parts(labels: list[str]) -> list[str]:
    """Few words such that each label holds one."""
    words, left, out = sorted({w for label in labels for w in (*label.split(), label) if len(w) > 2}), list(labels), []
    while left:
        out.append(max(words, key=lambda w: (sum(w in label for label in left), len(w), w)))
        left = [label for label in left if out[-1] not in label]
    return out


def places_of(doc: Whole, labels: list[str], pattern: str | None = None) -> Column:
    """Places (from 0) of the lines that, as they are compared, hold any of the labels and match the pattern."""
    test = lambda x: some_word(x, common_parts(labels)) & (x.rlike(pattern) if pattern else some_word(x, labels))
    return F.array_compact(F.transform(doc.same, lambda x, i: F.when(test(x), i)))


def first_with(doc: Whole, labels: list[str], pattern: str | None, k: int, value: Callable[[Column, Column], Column]) -> Column:
    """The first value, of a line and the array of the ``k`` after it, that such lines give; those after one that has it are not asked."""
    of_place = lambda i: bound(F.get(doc.lines, i), lambda x: value(x, following(doc.lines, i, k)))
    tried = lambda places: F.coalesce(bound(F.get(places, F.lit(0)), of_place), F.when(F.size(places) > 1, first_value(F.transform(F.slice(places, F.lit(2), F.size(places)), of_place))))
    return bound(places_of(doc, labels, pattern), lambda places: F.when(F.size(places) > 0, tried(places)))


def own_or_following(lines: Column, anchor: Test, own: Test, k: int, value: Test, stop: Test | None = None) -> Column:
    """For the first line that passes ``anchor`` and has a value: its own, or else the first value of the next ``k`` lines, up to
    a line that stops."""

    def here(x: Column, i: Column) -> Column:
        ahead = following(lines, i, k)
        ahead = until(ahead, stop) if stop else ahead
        return F.when(anchor(x), F.coalesce(own(x), first_value(F.transform(ahead, value))))

    return first_value(F.transform(lines, here))


def sections(lines: DataFrame, headers: dict[str, list[str]], start: str = "profile", key: str = "doc_id") -> DataFrame:
    """Lines with the section they fall in: a header line opens one and is dropped."""
    from doclens.functions.text import heading

    names = F.create_map(*[F.lit(x) for name, words in headers.items() for w in words for x in (w, name)])
    w = Window.partitionBy(key).orderBy("line_no")
    marked = lines.withColumn("_opens", names[heading(F.col("text"))])
    marked = marked.withColumn("section", F.coalesce(F.last("_opens", ignorenulls=True).over(w), F.lit(start)))
    return marked.where("_opens is null").drop("_opens")


def blocks(lines: DataFrame, opens: Column, key: str = "doc_id") -> DataFrame:
    """Block number of each line: lines belong to the last anchor at or before them; 0 before the first."""
    w = Window.partitionBy(key).orderBy("line_no")
    return lines.withColumn("block", F.sum(opens.cast("int")).over(w))


def islands(lines: DataFrame, gap: int = 2, key: str = "doc_id") -> DataFrame:
    """Groups of lines no more than ``gap`` apart."""
    w = Window.partitionBy(key).orderBy("line_no")
    far = F.coalesce(F.col("line_no") - F.lag("line_no").over(w) > gap, F.lit(True))
    return lines.withColumn("_far", far.cast("int")).withColumn("island", F.sum("_far").over(w)).drop("_far")


def distinct_records(rows: DataFrame, by: list[Column], order: str, key: str = "doc_id") -> DataFrame:
    """First of the records of a document that agree in ``by``."""
    w = Window.partitionBy(key, *by).orderBy(order)
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
