"""Steps that larger tables would not bear: what is shuffled, and what is searched."""

import pytest
from pyspark.sql import functions as F

from doclens import vocabulary as V
from doclens.functions import extract as E
from doclens.functions import predicates as P
from doclens.functions import text as N
from doclens.operators import entities, form, history, invoice, lines, ocr, receipt, scoring
from doclens.plans import queries as Q
from doclens.plans import rendered as R
from doclens.session import materialise


def test_words_are_not_shuffled(spark, sf):
    """Texts go over the network once, by document; their words are grouped where they are made."""
    for name in ("ocr_line_group", "ocr_pass_scores", "ocr_best_pass"):
        plan = Q.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1, name


def test_priced_lines(spark):
    texts = ["Tea 2.50", "Tea 2.50 ", "2.50", "2.50 x", "Tea 12,125\t", "a 1.2345", "no", None, "x9.99", "9.9 y 9.99"]
    lines = spark.createDataFrame([(i, 1, t, 50.0) for i, t in enumerate(texts)], "doc_id long, pass_no int, text string, confidence double")
    plain = lines.select(F.count_if(F.col("text").rlike(ocr.PRICED)), F.count_if(F.col("text").rlike(ocr.PRICE_END) & F.col("text").rlike(ocr.PRICED))).first()
    assert plain[0] == plain[1] == 5


def test_addresses_are_sought_where_their_sign_is(spark):
    """A line's words are searched once each, and only in lines with that sign."""
    rows = spark.createDataFrame([(["no", "a@b", "x jo.lee@mail.example.com, b@c.org"],), (["none"],), ([],), (None,)], "lines array<string>")
    assert [r[0] for r in rows.select(E.email_of(F.col("lines"))).collect()] == ["jo.lee@mail.example.com", None, None, None]


def test_whole_items_are_matched_once(spark):
    """Parts of a line come from one match: the line's pattern stands in no extraction of a group."""
    lines = spark.createDataFrame([("Blue 7 Chair 2 1,000.50 2,001.00 USD",), ("Tea\x00 x 1 2.00 2.00",), ("Tea 1 2.00",)], "x string")
    told = lines.select(invoice.item_line(F.col("x")).alias("t"))
    assert [tuple(r.t)[1:5] for r in told.where("t.kind = 'whole'").collect()] == [("2", "1000.50", "2001.00", "Blue 7 Chair"), ("1", "2.00", "2.00", "Tea\x00 x")]
    plan = told._jdf.queryExecution().analyzed().toString()
    assert plan.count(invoice.ITEM) == 1


def test_kinds_are_mixed_before_they_are_dispatched(spark, sf, monkeypatch):
    """Documents of one kind do not fill tasks of their own: rows are dealt by document before they are written."""

    def written(df, name):
        assert "RepartitionByExpression [doc_id" in df._jdf.queryExecution().analyzed().toString().splitlines()[0]
        raise KeyError(name)

    monkeypatch.setattr(Q, "materialise", written)
    with pytest.raises(KeyError, match="mixed"):
        Q.QUERIES["dispatched_documents"](spark, sf)


def test_sections_are_sorted_once(spark, sf):
    """One fold over the lines serves all sections, and opening the map does not have them worked out again as a filter."""
    rows = spark.createDataFrame([(["a", "SKILLS", "b", "Summary", "c"],), ([],)], "lines array<string>")
    told = rows.select(entities.section_texts(F.col("lines")).alias("m"))
    assert [(m["profile"], m["skills"], m["summary"]) for (m,) in told.collect()] == [("a", "b", "c"), ("", "", "")]
    assert told._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1
    assert Q.QUERIES["section_texts"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_lines_of_jobs_are_looked_at_once(spark):
    """Actions and titles are sought in a line and in its form without dates, not again for each rule; studies ask for their heading once."""
    rows = spark.createDataFrame([(["WORK EXPERIENCE", "Data  Analyst", "Company: Bar 1950 Ltd", "2019 - Present", "Developed many useful reports"],)], "lines array<string>")
    told = rows.select(history.job_regions(F.col("lines")).alias("jobs"))
    assert [tuple(j) for j in told.first().jobs] == [("Bar 1950 Ltd", "Data Analyst", "2019 - Present", ["Developed many useful reports"])]
    plan = told._jdf.queryExecution().analyzed().toString()
    assert (plan.count(V.JOB_ACTION), plan.count(V.JOB_TITLE)) == (2, 2)


def test_normal_texts_are_left_alone(spark):
    texts = ["a b", " a", "a ", "a  b", "A-b", "a\tb", "", None, "É b", "a b\n", "a,b", "x\u00a0y", "a \n\n b\t c\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    x = F.col("x")
    whole = N.strip(N.one_space(F.regexp_replace(F.lower(x), r"[^a-z0-9&+./#' -]", " ")))
    resume = N.strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\n{2,}", "\n"), r" *\n *", "\n"))
    assert rows.where(~N.plain_words(x).eqNullSafe(whole) | ~N.normalize_resume(x).eqNullSafe(resume)).count() == 0


def test_receipt_lines_are_put_in_capitals_once(spark):
    """For tenders and numbers alike; dates are those of lines that have a digit on both sides of a sign."""
    rows = spark.createDataFrame([(["Cashier Cash Jo", "Ref # ab-12345", "terminal rcpt 123456", "rcpt: r00012345", "13/40/2020", "03-04-21 x", "Cash tend 5.00"],), ([],), (None,)], "lines array<string>")
    told = rows.select(receipt.payment(F.col("lines")).alias("p"), receipt.receipt_number(F.col("lines")).alias("n"), receipt.receipt_date(F.col("lines")).alias("d"))
    assert [tuple(r) for r in told.collect()] == [("CASH", "AB-12345", "03-04-21"), (None, None, None), (None, None, None)]
    assert told._jdf.queryExecution().analyzed().toString().count("upper(") == 2


def test_skills_are_found_once(spark, sf, monkeypatch):
    """Over all that best_jobs runs, each resume and each job is searched for skills once, and jobs are dealt over tasks before that."""
    plans = []

    def noted(df, name):
        plans.append(df)
        return materialise(df, name)

    monkeypatch.setattr(scoring, "materialise", noted)
    plans.append(Q.QUERIES["best_jobs"](spark, sf))
    searched = [df._jdf.queryExecution().optimizedPlan().toString().count(E.skill_pattern("SQL")) for df in plans]
    assert sorted(searched) == [0] * (len(plans) - 2) + [1, 1]
    assert "RepartitionByExpression [p_partkey" in R.jobs(spark, sf)._jdf.queryExecution().analyzed().toString()


def test_routing_seeks_no_more_than_decides(spark, sf):
    """Where only the type is asked for, counts are not made; documents are dealt over tasks before their texts are searched."""
    told = Q.QUERIES["route_document"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "finance_evidence" not in told and "RepartitionByExpression [doc_id" in told


def test_evidence_is_that_of_plain_patterns(spark):
    patterns = [*V.INVOICE_EVIDENCE, *V.RESUME_EVIDENCE, *V.FINANCE_EVIDENCE, r"\bfoo|bar", r"\bab+c", r"\ba*z", r"\bxy{2}", r"total$"]
    texts = ["Invoice  No 5", "xinvoice", "invoice_", "invoice. SUB total", "Subtotals", "TAX", "private vat", "a GST b", "sales  tax", "service tax.", "qty", "quantity1", "bar", "foo", "abbbc", "z xyy", "xy",
             "Certifications", "certificationsx", "é-total", "étotal", "grand\ntotal", "due date, due\tdate", "", None, "unitprice unit price", "work experience, education, skills; total amount"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    low = F.lower("text")
    plain = lambda some: sum((F.coalesce(low.rlike(p), F.lit(False)).cast("int") for p in some), F.lit(0))
    assert [r for r in patterns if rows.where(E.evidence(F.col("text"), [r]) != plain([r])).count()] == []
    for some in (V.INVOICE_EVIDENCE, V.RESUME_EVIDENCE, V.FINANCE_EVIDENCE):
        assert rows.where(E.evidence(F.col("text"), some) != plain(some)).count() == 0
    kind = scoring.routed_type(plain(V.INVOICE_EVIDENCE), plain(V.FINANCE_EVIDENCE), plain(V.RESUME_EVIDENCE), F.lit("form"))
    assert scoring.route(rows.withColumn("predicted_type", F.lit("form"))).where(F.col("document_type") != kind).count() == 0


def test_labels_of_forms_are_matched_once(spark):
    """The label's pattern and the look for an instruction in a line's own value; what is junk is as by the patterns alone."""
    texts = ["(1) Full Name: Jo: Lee ", "Email:", "A : b", "AB : (a)", ": x", "Date of Birth:  1/2/1990", "no colon", "9: x", "Tick one: |Yes;", "é: a"]
    read = spark.createDataFrame([(texts,)], "lines array<string>").select(form.read_lines(F.col("lines")).alias("r"))
    plain = spark.createDataFrame([(t,) for t in texts], "x string").select(N.strip(F.regexp_extract("x", form.LABEL, 1)), N.form_value(F.regexp_extract("x", form.LABEL, 2)), F.col("x").rlike(form.LABEL))
    assert [(r.label, r.own, r.opens) for r in read.first().r] == [tuple(r) for r in plain.collect()]
    assert read._jdf.queryExecution().analyzed().toString().count(form.LABEL) == 1
    values = ["", "x", "ab", "abc", "abcd", "yes", "Mg", "q1)", "Q12)", "a1)", "$", "$$~", "$5", "-", "€", "é", "<>^'\"`", "ab1", "1", "*", "**", None]
    c = F.col("x")
    short = c.rlike("^[A-Za-z]{1,3}$") & ~F.lower(c).isin("x", "xx", "mg", "yes", "no")
    junk = ((F.length(c) <= 1) & ~c.rlike("[A-Za-z0-9$€£]")) | c.rlike(r"^[qQ]\d+\)$") | short | c.rlike(r"^[$<>~`'\"^]+$")
    assert spark.createDataFrame([(v,) for v in values], "x string").where(~P.form_junk(c).eqNullSafe(junk)).count() == 0


def test_texts_with_nothing_to_mend_are_their_lines(spark):
    """A text is looked at as a whole first; what its lines are does not depend on that."""
    texts = ["a b\nc", "a  b", " a", "a ", "a\n b", "a \nb", "a\n\nb", "\na", "a\n", "a\tb", "a\r\nb", "a\x0bb", "a\x1fb", "a\x01b", "é b", "a b", "1O5\nX-]5", "5 l", "", " ", None]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    plain = F.array_join(invoice.invoice_lines(F.col("x")), "\n")
    assert rows.where(~invoice.invoice_text(F.col("x")).eqNullSafe(plain)).count() == 0
    _, doc = lines.with_whole(rows, invoice.invoice_text(F.col("x")))
    got = lines.with_whole(rows, invoice.invoice_text(F.col("x")))[0]
    assert got.where(~doc.lines.eqNullSafe(invoice.invoice_lines(F.col("x"))) | ~doc.same.eqNullSafe(F.transform(doc.lines, N.norm))).count() == 0


def test_invoices_ask_no_more_than_is_wanted(spark):
    """Whether there is a vendor takes no choice of it, and amounts are read only in lines with a label, and after these."""
    docs = spark.createDataFrame([(1, "ACME Ltd\nTotal\n7.50\nSubtotal: 7.00\nTax amount USD 0.50")], "doc_id int, text string")
    found = invoice.extract(docs).select("confidence", "subtotal", "tax", "total")
    assert tuple(found.first()) == (62.5, "7.00", "0.50", "7.50")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "technology" not in plan and "_read" not in plan
    for labels in (V.TOTAL_LABELS, V.SUBTOTAL_LABELS, V.VENDOR_LABELS, V.INVOICE_LABELS):
        parts = lines.common_parts(labels)
        assert len(parts) < len(labels) and all(any(p in label for p in parts) for label in labels)


def test_receipts_ask_no_more_than_is_wanted(spark):
    """Labels in the right form need no mending, money is read only after labels and in the list, and whether there is a merchant takes no choice of it."""
    texts = ["SUBTOTAL 5.00\nTAX 1.00", "subTOTAL 5", "SUBTOTZL 5", "Total 1", "TOTA1 1", "TOTALS tax", "Tax", "TAXI", "a\x00b", "‘a’", "a  b", "TOTAL 1 \nb", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    x = F.coalesce(F.col("x"), F.lit(""))
    assert rows.where(receipt.receipt_text(x) != F.array_join(receipt.receipt_lines(x), "\n")).count() == 0
    docs = spark.createDataFrame([(1, "SHOP\n12 Main Street\nTea 2.00\nSUBTOTAL\n2.00\nTAX 0.50\nTOTAL 2.50\nCASH TEND 3.00")], "doc_id int, text string")
    found = receipt.extract(docs).select("confidence", *(F.col(c).cast("string") for c in ("subtotal", "tax", "total", "change_due")), "financial_validation")
    assert tuple(found.first()) == (61, "2.00", "0.50", "2.50", "0.50", "valid")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_rows" not in plan and "0.35" not in plan
