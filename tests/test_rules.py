"""Rules read off by hand, on small texts."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from doclens.functions import extract as E
from doclens.functions import predicates as P
from doclens.functions import text as N
from doclens.operators import form, invoice, lines, receipt, resume, scoring, store


def value(spark, f, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]


def record(spark, extract, text):
    return extract(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()


@pytest.mark.parametrize(
    "f,text,want",
    [
        (N.clean_line, "  a   b — Pyth0n\t", "a b - Python"), (N.clean_line, None, None), (N.correct_ocr, "maii and NUMPY", "Mail and NumPy"), (N.fix_invoice_digits, "INV-1O2l3 X-]5", "INV-10213 X-15"),
        (N.fix_receipt_labels, "subtotxl tota1 tax", "SUBTOTAL TOTAL TAX"), (N.form_label, "Products Length", "product_length"), (N.form_value, "|: xx;", "X"), (N.without_bullet, "• did it", "did it"),
        (N.normalize_form_line, "e~mail：  'x' ", "e-mail: 'x'"), (N.linkedin_url, "linkedin.com/in/some-one", "https://www.linkedin.com/in/some-one"), (N.to_number, "87 %", 87.0), (N.to_number, "x", None),
        (N.fix_degree, "Bachlor of Mathamatics", "Bachelor of Mathematics"), (E.money_value, "1,234.56", Decimal("1234.56")), (E.money_value, "1.234,56", Decimal("1234.56")), (E.money_value, "175,000", Decimal("175000.00")),
        (E.money_value, "1.234", Decimal("1234.00")), (E.money_value, "$9,50", Decimal("9.50")), (E.amount_text, "net (1,200.50)", "-1200.50"), (E.amount_text, "no number", None), (E.mobile, "Tel +92 301-1234567", "03011234567"),
        (E.date, "on O1/12/2O20", "01/12/2020"), (E.currency, "in eur", "EUR"), (E.year_or_range, "2019 to present", "2019 to present"), (E.email, "no mail", None), (E.grouped_number, None, None),
    ],
)
def test_values(spark, f, text, want):
    assert value(spark, f if f is not E.grouped_number else lambda c: E.grouped_number(c.cast("double")), text) == [want]


def test_skills_find_overlapping_phrases(spark):
    found = value(spark, E.skills, "Online-Teaching, C++ and machine_learning; javascript", "", None)
    assert found == [["C++", "Machine Learning", "Online Teaching", "Teaching"], [], []]


def test_predicates(spark):
    assert value(spark, P.invoice_id, "INV-1", "12345", "12/05/2020", "a b c d1", None) == [True, False, False, False, False]
    assert value(spark, P.numeric_value, "12 mg", "$1,2", "-", "abc") == [True, True, True, False]
    assert value(spark, P.row_marker, "(12)", "{3)", "(a)") == [True, True, False]
    assert value(spark, P.address_line, "12 Main St", "Main St", "12 big houses", "hello") == [True, False, True, False]


def test_invoice_with_values_below_labels(spark):
    text = "ACME STORE LTD\n5 High Road\nInvoice Number\nAB-77\nDue Date:\n01 March 2024\nCustomer: Jo Buyer\nItem Qty Price Amount\nBlue Chair\n2 10.00 20.00\nSub Total\n20.00\nTotal Tax: 1.40\nGrand Total: $21.40\nPaid by: Apple Pay"
    r = record(spark, invoice.extract, text)
    assert (r.vendor_name, r.vendor_address, r.invoice_number, r.due_date, r.customer_name) == ("ACME STORE LTD", "5 High Road", "AB-77", "01 March 2024", "Jo Buyer")
    assert (r.subtotal, r.tax, r.total, r.currency, r.payment_method) == ("20.00", "1.40", "21.40", "USD", "APPLE PAY")
    assert [tuple(i) for i in r["items"]] == [("Blue Chair", "2", "10.00", "20.00")]
    empty = record(spark, invoice.extract, None)
    assert empty.total is None and empty["items"] == [] and empty.confidence == 0


def test_receipt_validation_edges(spark):
    base = "SHOP\n1 Main Street\nTEA 10.00\nSUBTOTAL 10.00\nTAX 1.00\nTOTAL {}\nCASH TEND 20.00"
    got = [record(spark, receipt.extract, base.format(t)) for t in ("11.05", "11.06")]
    assert [r.financial_validation for r in got] == ["valid", "inconsistent"]
    assert got[0].change_due == Decimal("8.95")
    none = record(spark, receipt.extract, "")
    assert (none.financial_validation, none["items"], none.confidence) == ("insufficient_data", [], 0)
    far = record(spark, receipt.extract, "SHOP\nTOTAL\nTAX\n5.00")
    assert far.total is None or far.tax == Decimal("5.00")


def test_form_reconciles_totals(spark):
    r = record(spark, form.extract, "Cat A Expenses: 10\nCat B Expenses: 25\nTotal Expenses: 40\nStart Date:\nnot a date\nDocument ok: x")
    fields = {f.name: f for f in r.fields}
    assert fields["total_expenses"].review_required and r.needs_review
    assert fields["start_date"].value is None and "start_date" in r.missing_fields
    assert r.checkboxes == ["document_ok"]
    assert record(spark, form.extract, None).completion_score == 0


def test_form_row_markers(spark):
    r = record(spark, form.extract, "(1)\nTar: \n(2)\nx y\n12 mg\n(3)\nNicotine:\n(4)\nFilter: yes")
    fields = {f.name: (f.value, f.source) for f in r.fields}
    assert fields["tar"] == (None, "missing") and fields["nicotine"] == ("12 mg", "marker_reversed") and fields["filter"] == ("yes", "inline")


@pytest.mark.parametrize(
    "text,want",
    [
        ("Maker: Kent\n(3)\nBrand Name:\nKent", {"maker": ("Kent", "inline"), "brand_name": ("Kent", "marker_row")}),
        ("Maker: Kent\nBrand Name:\nKent\n(3)\nTar:", {"maker": ("Kent", "inline"), "brand_name": (None, "missing"), "tar": (None, "missing")}),
        ("MALIBU\n(2)\nBrand Name: Former", {"brand_name": ("MALIBU", "marker_reversed")}),
        ("MALIBU\n(2)\n(3)\nBrand Name:", {"brand_name": (None, "missing")}),
        ("MALIBU\n(2)\nBrand Name: Former\nMALIBU\n(3)\nMaker: Owner", {"brand_name": ("MALIBU", "marker_reversed"), "maker": ("Owner", "inline")}),
        ("xx\n(2)\nBrand Name:", {"brand_name": (None, "missing")}),
        ("12.50\nmore words\nOther:\nUnit Price:", {"other": ("12.50", "nearby_forward"), "unit_price": (None, "missing")}),
        ("12.50\nStart Date:\nUnit Price:", {"start_date": (None, "missing"), "unit_price": (None, "missing")}),
        ("12.50\na b\nc d\ne f\ng h\nUnit Price:", {"unit_price": (None, "missing")}),
        ("12.50\n13.50\nUnit Price:", {"unit_price": ("12.50", "nearby_forward")}),
        ("(1)", {}),
    ],
)
def test_form_rows(spark, text, want):
    assert {f.name: (f.value, f.source) for f in record(spark, form.extract, text).fields} == want


def test_resume_without_headings(spark):
    r = record(spark, resume.extract, "Jo Field\njo@x.org")
    assert (r.name, r.email, r.education, r.experience, r.skills) == ("Jo Field", "jo@x.org", [], [], [])


@pytest.mark.parametrize("n,points", [(4, 0), (5, 15), (9, 15), (10, 20)])
def test_rubric_edges(spark, n, points):
    row = spark.range(1).select(F.array(*[F.lit(f"s{i}") for i in range(n)]).alias("skills"), *[F.lit(None).cast("string").alias(c) for c in ("name", "email", "phone", "linkedin", "github")], *[F.expr("cast(array() as array<string>)").alias(c) for c in ("education", "experience", "projects", "certifications")])
    r = scoring.with_ats(row).first()
    assert r.ats_score == points and len(r.ats_recommendations) == (9 if points == 0 else 8)


def test_empty_job_matches_nothing(spark):
    people = spark.createDataFrame([(1, ["SQL"])], "doc_id long, skills array<string>")
    jobs = spark.createDataFrame([(1, "")], "job_id long, job_description string")
    r = scoring.match_jobs(people, jobs, F.lit(True)).first()
    assert (r.match_score, r.missing_skills) == (0.0, [])


def test_sections_and_dedupe(spark):
    rows = lines.explode_lines(spark.createDataFrame([(1, "x\nSKILLS:\nA\na\nEDUCATION\nB")], "doc_id long, text string"))
    from doclens.vocabulary import SECTIONS

    assert [(r.section, r.text) for r in lines.sections(rows, SECTIONS).orderBy("line_no").collect()] == [("profile", "x"), ("skills", "A"), ("skills", "a"), ("education", "B")]
    assert lines.dedupe_lines(rows).count() == 5


def test_entities(spark):
    from doclens.operators import entities

    text = "CURRICULUM\nSkills\nÉva Stone\nmail e@x.org or e@x.org\nhttps://github.com/eva and https://x.org/a\nRiver College\nlondon"
    rows = entities.entities(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("ord").collect()
    assert [(r.label, r.text) for r in rows] == [("PERSON", "Éva Stone"), ("EMAIL", "e@x.org"), ("GITHUB", "https://github.com/eva"), ("WEBSITE", "https://x.org/a"), ("GPE", "London"), ("ORG", "River College")]
    assert value(spark, entities.section_containing, "My Work Experience here", "none") == ["experience", None]


def test_split_is_exact(spark):
    rows = spark.range(200).select(F.col("id").alias("k"), F.when(F.col("id") < 20, "a").otherwise("b").alias("label"))
    got = {(r.label, r.split): r["count"] for r in store.stratified_split(rows, "label", "k").groupBy("label", "split").count().collect()}
    assert got == {("a", "train"): 14, ("a", "valid"): 3, ("a", "test"): 3, ("b", "train"): 126, ("b", "valid"): 27, ("b", "test"): 27}


def test_extraction_needs_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for extract in (invoice.extract, receipt.extract, form.extract, resume.extract):
        plan = extract(docs)._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Exchange", "EvalPython", "MapIn"))


def test_files_and_streams(spark, tmp_path):
    from doclens.sources import files, writers
    from doclens.streaming import landing

    (tmp_path / "in" / "test" / "form").mkdir(parents=True)
    for name in ("a.PNG", "b.pdf", "c.txt"):
        (tmp_path / "in" / "test" / "form" / name).write_bytes(b"x")
    good, bad = files.supported(files.read_binary(spark, str(tmp_path / "in")))
    assert {(r.file_name, r.input_type) for r in good.collect()} == {("a.PNG", "image"), ("b.pdf", "pdf")}
    assert bad.first().error_message == "Unsupported file type: .txt"
    assert [(r.label, r.split) for r in files.labelled_images(spark, str(tmp_path / "in")).collect()] == [("form", "test")]
    (tmp_path / "words.json").write_text('["a",\n "b"]')
    (tmp_path / "ocr.json").write_text('[\n{"text": "T", "confidence": 0.5,\n"bbox": [[1, 2]]}]')
    assert [r.text for r in files.read_texts(spark, str(tmp_path / "words.json")).collect()] == ['["a",\n "b"]']
    assert files.read_dictionary(spark, str(tmp_path / "words.json")) == ["a", "b"]
    (tmp_path / "settings.yaml").write_text("top: 1\nmodel:\n  name: b0  # small\n  pretrained: true\n\ntraining:\n  rate: 0.0001\n  note: 'a # b'\n  none:\nempty:\n")
    want = {"": {"top": 1}, "model": {"name": "b0", "pretrained": True}, "training": {"rate": 0.0001, "note": "a # b", "none": None}, "empty": {}}
    assert files.read_settings(spark, str(tmp_path / "settings.yaml")) == want
    assert files.read_ocr_json(spark, str(tmp_path / "ocr.json")).first().confidence == 50
    docs = spark.createDataFrame([(1, "Jo Field\njo@x.org")], landing.SCHEMA)
    docs.write.parquet(str(tmp_path / "land"))
    landing.extract_stream(spark, str(tmp_path / "land"), "resume", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().email == "jo@x.org"
    writers.write_report(store.class_report(spark.createDataFrame([("a", "a"), ("b", "a")], "y_true string, y_pred string")), str(tmp_path / "rep"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "rep")).collect())[0] == "a precision 0.5000 recall 1.0000 f1 0.6667 support 1"
    writers.write_split(good.select(F.lit("train").alias("split"), F.lit("form").alias("label"), "path"), str(tmp_path / "split"))
    assert not writers.write_corrupt(good.withColumn("valid", F.lit(True)), str(tmp_path / "bad"))


def test_process_routes_and_sets_aside(spark):
    from doclens.operators.pipeline import process

    docs = spark.createDataFrame([(1, "Invoice No: A1\nSubtotal: 1.00\nGrand Total: 1.00", "receipt"), (2, "hello", "memo")], "doc_id long, text string, predicted_type string")
    out = process(docs)
    assert out["invoice"].first().invoice_number == "A1"
    assert out["error"].first().doc_id == 2


ITEM_ROWS = [
    (["Blue Chair", "1 PC 9.00 0.00 9.00"], [("Blue Chair", "1", "9.00", "9.00")]),
    (["1 193.00 193.00", "Steel Table"], [("Steel Table", "1", "193.00", "193.00")]),
    (["1 2.00 2.00", "Green Lamp", "1 3.00 3.00", "Red Lamp"], [("Green Lamp", "1", "2.00", "2.00"), ("Red Lamp", "1", "3.00", "3.00")]),  # no line twice
    (["One lamp", "Two lamp", "Red lamp", "Big lamp", "2 x 3.00 6.00"], [("Two lamp Red lamp Big lamp", "2", "3.00", "6.00")]),
    (["CHAIR", "2 3.00 6.00", "Oak Desk"], [("Oak Desk", "2", "3.00", "6.00")]),  # a code alone does not describe from above
    (["Big lamp", "Unit Price", "2 3.00 6.00"], []),
    (["2001 3.00 6.00", "Oak Desk"], []),  # no quantity
    (["Big lamp", "0001 1 3.00 3.00"], [("Big lamp", "1", "3.00", "3.00")]),
    (["Tea pot 1 1,200.00 1,200.00", "Tea pot 1 1,200.00 1,200.00"], [("Tea pot", "1", "1200.00", "1200.00")]),
]


def test_item_rows(spark):
    texts = [(i, "\n".join(["Item Qty Price", *rows, "Sub Total 1"])) for i, (rows, _) in enumerate(ITEM_ROWS)]
    found = invoice.extract(spark.createDataFrame(texts, "doc_id int, text string")).select("doc_id", "items").collect()
    assert {r.doc_id: [tuple(i) for i in r["items"]] for r in found} == {i: want for i, (_, want) in enumerate(ITEM_ROWS)}


def test_list_places_of_receipts(spark):
    head = "SHOP\n1 Main Street\n"
    names = lambda text: [i.description for i in record(spark, receipt.extract, head + text + "\nSUBTOTAL 1")["items"]]
    assert names("1 APPLE 1.00\n2 PEAR 2.00\n10 FIG\n3.00 X") == ["APPLE", "PEAR", "FIG"]
    assert names("2 APPLE 1.00\n3 PEAR 2.00") == ["2 APPLE", "3 PEAR"] and names("1 APPLE 1.00\n1 PEAR 2.00") == ["1 APPLE", "1 PEAR"]


def test_jobs_around_dates_come_first(spark):
    text = "EXPERIENCE\nData Analyst\nFirm Ltd\n2015 - 2018\nDeveloped many reports for clients"
    (job,) = record(spark, resume.extract, text).experience
    assert (job.company, job.job_title, job.duration, job.description) == ("Firm Ltd", "Data Analyst", "2015 - 2018", ["Developed many reports for clients"])


NAMES = [(["AVERY", "STONE", "EDUCATION", "Bachelor of Science"], "Avery Stone"), (["About Me", "1", "ann lee", "x1"], "Ann Lee"), (["Ann McLee", "BOB"], "Ann McLee"), (["Dedicated Teacher", "1"], None), ([], None)]


def test_names_of_resumes(spark):
    texts = [(i, "\n".join(lines_)) for i, (lines_, _) in enumerate(NAMES)]
    found = resume.extract(spark.createDataFrame(texts, "doc_id int, text string"), only=["name"]).collect()
    assert {r.doc_id: r.name for r in found} == {i: name for i, (_, name) in enumerate(NAMES)}


@pytest.mark.parametrize("name", ["form_colonless", "form_markers", "form_rows", "receipt_layout", "invoice_layout", "resume_layout", "job_layouts", "education_layouts"])
def test_layouts_are_spread_before_the_work(spark, sf, name):
    """A small file of keys is one task; what is made of them takes long."""
    from doclens.plans import queries

    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_a_year_in_a_firms_name_is_no_date(spark):
    from doclens.operators import history

    text = "WORK EXPERIENCE\nData analyst\nFirm 1950 Ltd\n2015 - 2018\nDeveloped many reports for clients"
    job = spark.createDataFrame([(text,)], "t string").select(F.explode(history.job_regions(F.split("t", "\n"))).alias("j")).select("j.*").first()
    assert (job.company, job.duration) == ("Firm 1950 Ltd", "2015 - 2018")
    assert job.description == ["Developed many reports for clients"]
