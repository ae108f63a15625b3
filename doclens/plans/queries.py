"""Registered queries: operators over whole tables, each beside SQL that says what they should give.

Arrays of records are opened with explode_outer: explode would have the optimiser work them out once more, as a filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclens import vocabulary as V
from doclens.functions import extract as E
from doclens.functions import predicates as P
from doclens.functions import text as N
from doclens.operators import entities, form, history, invoice, lines, ocr, pipeline, receipt, resume, scoring, store
from doclens.operators.numbering import batches
from doclens.plans import rendered as R
from doclens.plans import truth
from doclens.session import materialise, scratch_path
from doclens.sources import files, folders, writers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "documents")


def joined(c: Column, separator: str = "|") -> Column:
    return F.array_join(c, separator)


# Lines


@query(truth.LINES + "SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, text FROM lines")
def line_explode(spark, sf_dir):
    return lines.explode_lines(docs(spark, sf_dir))


@query(truth.LINES + "SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, text FROM kept")
def line_clean_dedupe(spark, sf_dir):
    return lines.dedupe_lines(lines.clean_lines(lines.explode_lines(docs(spark, sf_dir))))


@query(truth.LINES + "SELECT doc_id, string_agg(text, chr(10) ORDER BY line_no) AS text, count(*) AS line_count FROM kept GROUP BY doc_id")
def line_rejoin(spark, sf_dir):
    return lines.rejoin_lines(lines.dedupe_lines(lines.clean_lines(lines.explode_lines(docs(spark, sf_dir)))))


@query(truth.LINES + "SELECT doc_id, count(*) AS line_count, string_agg(text, chr(10) ORDER BY line_no) AS text FROM kept GROUP BY doc_id")
def line_arrays(spark, sf_dir):
    """The same within the row, without a shuffle."""
    some = docs(spark, sf_dir).where(F.col("text").rlike(r"\S"))  # a filter on the lines would be worked out before them, once for each
    rows = lines.with_clean_lines(some, "text", "lines")
    return rows.select("doc_id", F.size("lines").cast("long").alias("line_count"), joined(F.col("lines"), "\n").alias("text"))


# Normalisation, on texts with known mistakes put in


def mistaken(spark, sf_dir) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.replace("text", F.lit(" "), F.lit(" Panda5  ")).alias("text"))


@query(truth.mistaken(truth.ocr_corrected("text")))
def ocr_correct(spark, sf_dir):
    return mistaken(spark, sf_dir).select("doc_id", F.md5(N.correct_ocr(F.col("text"))).alias("digest"))


@query(truth.mistaken(truth.RESUME_NORMAL))
def resume_normalize(spark, sf_dir):
    return mistaken(spark, sf_dir).select("doc_id", F.md5(N.normalize_resume(F.col("text"))).alias("digest"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(lower(text), '&', ' and '), '[-_/]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM documents")
def skill_normalize(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(N.skill_text(F.col("text"))).alias("digest"))


@query("SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS label FROM documents")
def form_label_normalize(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", N.form_label(F.col("text")).alias("label"))


@query("SELECT doc_id, md5(trim(regexp_replace(translate(replace(lower(text), ':', ''), '-_', '  '), '\\s+', ' ', 'g'))) AS digest FROM documents")
def header_normalize(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(N.heading(F.col("text"))).alias("digest"))


@query("SELECT o_orderkey, 'INV-' || o_orderkey || '05 1' || o_orderkey || '10' AS fixed FROM orders")
def invoice_ocr_fix(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    raw = F.concat(F.lit("INV-"), key, F.lit("O5 1"), key, F.lit("l0"))
    return R.table(spark, sf_dir, "orders").select("o_orderkey", N.fix_invoice_digits(raw).alias("fixed"))


# First and all matches


@query("SELECT doc_id, nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'), '') AS email FROM documents")
def email_first(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", E.email(F.col("text")).alias("email"))


@query(truth.every("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"))
def email_all(spark, sf_dir):
    found = E.every(F.col("text"), E.EMAIL)
    return docs(spark, sf_dir).select("doc_id", joined(F.array_sort(found)).alias("emails"), F.size(found).cast("long").alias("n_email"))


@query("SELECT doc_id, nullif(regexp_extract(text, '\\+?\\d[\\d\\s\\-]{8,}\\d'), '') AS phone FROM documents")
def phone_first(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", E.phone(F.col("text")).alias("phone"))


@query(truth.every("phone", "\\+?\\d[\\d\\s\\-()]{8,}\\d"))
def phone_all(spark, sf_dir):
    found = E.phones(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", joined(F.array_sort(found)).alias("phones"), F.size(found).cast("long").alias("n_phone"))


@query("SELECT page_id, nullif(regexp_extract(url || ' ' || html, 'https?://[^\\s]+'), '') AS url_found FROM pages")
def url_first(spark, sf_dir):
    return R.table(spark, sf_dir, "pages").select("page_id", E.url(F.concat("url", F.lit(" "), "html")).alias("url_found"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'PKR' END AS currency, strftime(o_orderdate, '%d/%m/%Y') AS date_found FROM orders")
def currency_and_date(spark, sf_dir):
    line = F.concat(F.lit("Paid "), F.when(F.col("o_orderkey") % 3 == 0, "usd").when(F.col("o_orderkey") % 3 == 1, "Pkr").otherwise("dollars"), F.lit(" on "), F.date_format("o_orderdate", "dd/MM/yyyy"))
    return R.table(spark, sf_dir, "orders").withColumn("line", line).select("o_orderkey", E.currency(F.col("line")).alias("currency"), E.date(F.col("line")).alias("date_found"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'London' WHEN c_custkey % 4 = 1 THEN 'Lahore|New York' ELSE '' END AS cities FROM customer")
def city_gazetteer(spark, sf_dir):
    line = F.when(F.col("c_custkey") % 4 == 0, "lives in LONDON").when(F.col("c_custkey") % 4 == 1, "from new york to Lahore").otherwise("nowhere")
    return R.table(spark, sf_dir, "customer").select("c_custkey", joined(E.cities(line)).alias("cities"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_lookup(spark, sf_dir):
    return R.table(spark, sf_dir, "events").select("event_id", E.json_first(F.try_parse_json("props"), ["missing", "k"], "bigint").alias("k"))


@query(truth.VALUES)
def value_functions(spark, sf_dir):
    """Small functions and tests on values, each on a text made of the key."""
    n = F.col("o_orderkey") % 90000
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    even = lambda a, b: F.when(n % 2 == 0, a).otherwise(b)
    third = lambda a, b, c: F.when(n % 3 == 0, a).when(n % 3 == 1, b).otherwise(c)
    grouped = text(F.floor(n / 1000).cast("string"), ",", F.lpad((n % 1000).cast("string"), 3, "0"), ".5")
    return R.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), N.to_number(text(" ", n.cast("string"), "%")).alias("per_cent"), N.safe_number(even(text("x", n.cast("string")), n.cast("string"))).alias("safe"),
        E.form_number(text("about ", grouped, " kg")).alias("form_amount"), E.two_places(n / 4).alias("places"), E.grouped_number(n + 0.5).alias("grouped"),
        P.numeric_value(third(text("$ ", n.cast("string"), " kg"), text("a", n.cast("string")), F.lit("—"))).alias("is_numeric"), P.checkbox_value(even(F.lit("[X]"), F.lit("maybe"))).alias("is_checked"),
        P.row_marker(even(text("( ", n.cast("string"), " )"), F.lit("(a)"))).alias("is_marker"), P.person_shape(even(F.lit("Ann B. Lee"), F.lit("Ann 3"))).alias("is_person"),
        N.plain_words(text("A–B! ", n.cast("string"))).alias("plain"), N.fix_degree(text("Bachlor of Mathamatics ", n.cast("string"))).alias("degree"),
        entities.section_containing(third(F.lit("My Work Experience here"), F.lit("Higher Education:"), F.lit("Other words"))).alias("section"),
    )


# Typed documents against the rows they were rendered from


@query(truth.INVOICES + "SELECT k AS doc_id, 'INV-' || k AS invoice_number, strftime(d, '%d/%m/%Y') AS invoice_date, strftime(d + INTERVAL 30 DAY, '%d/%m/%Y') AS due_date, 'Buyer ' || c AS customer_name, vendor AS vendor_name, (k % 90 + 10) || ' Market Street' AS vendor_address, 'USD' AS currency, pay AS payment_method FROM docs")
def invoice_header(spark, sf_dir):
    return invoice.extract(R.invoices(spark, sf_dir)).select("doc_id", "invoice_number", "invoice_date", "due_date", "customer_name", "vendor_name", "vendor_address", "currency", "payment_method")


@query(truth.INVOICES + f"SELECT k AS doc_id, {truth.money('s')} AS subtotal, {truth.money('s * 7 // 100')} AS tax, {truth.money('s + s * 7 // 100')} AS total, CAST(NULL AS VARCHAR) AS discount, CAST(100.0 AS DOUBLE) AS confidence FROM docs")
def invoice_amounts(spark, sf_dir):
    return invoice.extract(R.invoices(spark, sf_dir)).select("doc_id", "subtotal", "tax", "total", "discount", F.col("confidence").cast("double").alias("confidence"))


@query(truth.INVOICES + f"SELECT DISTINCT k AS doc_id, name AS description, CAST(q AS VARCHAR) AS quantity, {truth.money('u')} AS unit_price, {truth.money('q * u')} AS amount FROM rows")
def invoice_items(spark, sf_dir):
    found = invoice.extract(R.invoices(spark, sf_dir)).select("doc_id", F.explode_outer("items").alias("i"))
    return found.where("i IS NOT NULL").select("doc_id", "i.*").distinct()


@query(truth.RECEIPTS + f"SELECT k AS doc_id, 'CORNER MARKET' AS merchant_name, (k % 900 + 100) || ' MAIN STREET' AS merchant_address, '(555) 010-2345' AS merchant_phone, 'R' || lpad(CAST(k AS VARCHAR), 8, '0') AS receipt_number, strftime(d, '%m/%d/%Y') AS receipt_date, '10:' || lpad(CAST(k % 60 AS VARCHAR), 2, '0') || ':05' AS receipt_time, 'CASH' AS payment_method FROM docs")
def receipt_header(spark, sf_dir):
    return receipt.extract(R.receipts(spark, sf_dir)).select("doc_id", "merchant_name", "merchant_address", "merchant_phone", "receipt_number", "receipt_date", "receipt_time", "payment_method")


@query(truth.RECEIPTS + f"SELECT k AS doc_id, {truth.money('s')} AS subtotal, {truth.money('s * 7 // 100')} AS tax, {truth.money('s + s * 7 // 100')} AS total, {truth.money('s + s * 7 // 100 + 500')} AS cash_tender, '5.00' AS change_due, 'valid' AS financial_validation, CAST(n AS INTEGER) AS printed_item_count, CAST(least(100, 90 + least(10, n)) AS INTEGER) AS confidence FROM docs")
def receipt_amounts(spark, sf_dir):
    amounts = [F.col(c).cast("string").alias(c) for c in ("subtotal", "tax", "total", "cash_tender", "change_due")]
    return receipt.extract(R.receipts(spark, sf_dir)).select("doc_id", *amounts, "financial_validation", "printed_item_count", "confidence")


@query(truth.RECEIPTS + f"SELECT k AS doc_id, name AS description, {truth.money('a')} AS amount, count(*) AS n FROM rows GROUP BY ALL")
def receipt_items(spark, sf_dir):
    found = receipt.extract(R.receipts(spark, sf_dir)).select("doc_id", F.explode_outer("items").alias("i"))
    return found.where("i IS NOT NULL").groupBy("doc_id", F.col("i.description").alias("description"), F.col("i.amount").alias("amount")).agg(F.count("*").alias("n"))


@query(truth.FORMS)
def form_values(spark, sf_dir):
    value = lambda n: F.get(F.filter("fields", lambda f: f["name"] == n), F.lit(0))
    found = form.extract(R.forms(spark, sf_dir))
    return found.select("doc_id", "name", "email", "date_of_birth", "phone", "address", "gender", value("email")["source"].alias("email_source"), F.col("total_fields").cast("long").alias("total_fields"))


@query(truth.FORM_SCORES)
def form_scores(spark, sf_dir):
    return form.extract(R.forms(spark, sf_dir)).select("doc_id", "completed_fields", joined(F.col("missing_fields")).alias("missing_fields"), "completion_score", "validation_score", "needs_review")


@query(truth.RESUMES)
def resume_contact(spark, sf_dir):
    fields = ["name", "email", "phone", "linkedin", "github", "summary", "languages", "certifications"]
    return resume.extract(R.resumes(spark, sf_dir), only=fields).select("doc_id", "name", "email", "phone", "linkedin", "github", "summary", joined(F.col("languages")).alias("languages"), joined(F.col("certifications")).alias("certifications"))


@query(truth.EDUCATION)
def resume_education(spark, sf_dir):
    return resume.extract(R.resumes(spark, sf_dir), only=["education"]).select("doc_id", F.explode_outer("education").alias("e")).where("e IS NOT NULL").select("doc_id", "e.*")


@query("SELECT c_custkey AS doc_id, 'Firm ' || c_custkey % 50 AS company, 'Senior Analyst' AS job_title, (2000 + c_custkey % 10) || ' - Present' AS duration, 'Built monthly reports for the team|Led weekly planning of work' AS description FROM customer")
def resume_experience(spark, sf_dir):
    rows = resume.extract(R.resumes(spark, sf_dir), only=["experience"]).select("doc_id", F.explode_outer("experience").alias("e"))
    return rows.where("e IS NOT NULL").select("doc_id", "e.company", "e.job_title", "e.duration", joined(F.col("e.description")).alias("description"))


@query(truth.SKILLS)
def resume_skills(spark, sf_dir):
    return resume.extract(R.resumes(spark, sf_dir), only=["skills"]).select("doc_id", joined(F.col("skills")).alias("skills"), F.size("skills").cast("long").alias("n_skills"))


@query(truth.ATS)
def ats_score(spark, sf_dir):
    return scoring.with_ats(resume.extract(R.resumes(spark, sf_dir))).select("doc_id", "ats_score", F.size("ats_recommendations").cast("long").alias("n_advice"))


@query(truth.JOB_SKILLS)
def job_skills(spark, sf_dir):
    return scoring.job_skills(R.jobs(spark, sf_dir)).select("job_id", joined(F.col("job_skills")).alias("skills"))


@query(truth.MATCH)
def jd_match(spark, sf_dir):
    people = resume.extract(R.resumes(spark, sf_dir), only=["skills"]).select("doc_id", "skills")
    jobs = R.jobs(spark, sf_dir)
    n = R.table(spark, sf_dir, "part").count()
    found = scoring.match_jobs(people, jobs, F.col("doc_id") % n == F.col("job_id"))
    return found.select("doc_id", "job_id", joined(F.col("matched_skills")).alias("matched"), joined(F.col("missing_skills")).alias("missing"), F.col("match_score").cast("double").alias("match_score"), "recommendation", "career_recommendation")


@query("SELECT c_custkey AS doc_id, CAST(29 + CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 0 END AS INTEGER) AS total_lines, CAST(CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END AS INTEGER) AS education_records, CAST(1 AS INTEGER) AS experience_records, CAST(1 AS INTEGER) AS projects, CAST(1 AS INTEGER) AS certifications, CAST(2 AS INTEGER) AS languages FROM customer")
def resume_statistics(spark, sf_dir):
    rows = resume.with_statistics(resume.extract(R.resumes(spark, sf_dir))).select("doc_id", "statistics.*")
    return rows.drop("skills_found")


@query("SELECT o_orderkey AS doc_id, 'Python' AS education, 'Wrote reports|Led a team' AS experience FROM orders")
def section_lists(spark, sf_dir):
    """Sections by substring: a heading may stand inside a longer line."""
    lines_ = F.array(*map(F.lit, ["Before any", "My Work Experience here", "Wrote reports", "Led a team", "Higher Education:", "Python"]))
    found = R.table(spark, sf_dir, "orders").select("o_orderkey", entities.sections_by_substring(lines_).alias("s"))
    return found.select(F.col("o_orderkey").alias("doc_id"), joined(F.col("s")["education"]).alias("education"), joined(F.col("s")["experience"]).alias("experience"))


@query("SELECT CAST(7 AS BIGINT) AS id, 'Python|SQL' AS matched, 'Docker' AS missing, 66.67::DOUBLE AS match_score, 'Learn these skills: Docker' AS recommendation FROM orders WHERE o_orderkey = 7")
def match_stored_resume(spark, sf_dir):
    rows = R.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit('{"skills": ["SQL", "Python", "k'), F.col("o_orderkey"), F.lit('"]}')).alias("json_data"))
    found = scoring.match_stored(rows, 7, "We need Python, SQL and Docker.")
    return found.select("id", joined(F.col("matched_skills")).alias("matched"), joined(F.col("missing_skills")).alias("missing"), F.col("match_score").cast("double").alias("match_score"), "recommendation")


@query(truth.SECTIONS)
def section_counts(spark, sf_dir):
    found = lines.sections(lines.explode_lines(R.resumes(spark, sf_dir)), V.SECTIONS)
    return found.groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"))


@query(truth.BLOCKS)
def degree_blocks(spark, sf_dir):
    found = lines.blocks(lines.explode_lines(R.resumes(spark, sf_dir)), F.col("text").rlike(resume.DEGREE))
    return found.where("block > 0").groupBy("doc_id", "block").agg(F.count("*").alias("n_lines"), F.min_by("text", "line_no").alias("degree"))


@query(truth.LINES + "SELECT doc_id, CAST(max(island) AS BIGINT) AS islands, count(*) AS n_lines FROM (SELECT doc_id, line_no, sum(far) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM (SELECT doc_id, line_no, CASE WHEN line_no - lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) <= 2 THEN 0 ELSE 1 END AS far FROM lines WHERE regexp_matches(text, '[0-9]'))) GROUP BY doc_id")
def number_islands(spark, sf_dir):
    found = lines.islands(lines.explode_lines(docs(spark, sf_dir)).where(F.col("text").rlike("[0-9]")))
    return found.groupBy("doc_id").agg(F.max("island").alias("islands"), F.count("*").alias("n_lines"))


@query(truth.ROUTES)
def route_document(spark, sf_dir):
    kinds = {"invoices": "form", "receipts": "receipt", "forms": "form", "resumes": "form"}
    every = [getattr(R, n)(spark, sf_dir).select("doc_id", F.lit(n).alias("corpus"), F.lit(p).alias("predicted_type"), "text") for n, p in kinds.items()]
    own = R.spread(docs(spark, sf_dir).select("doc_id", "text"))  # their file may be one task
    rows = own.select("doc_id", F.lit("documents").alias("corpus"), F.lit("form").alias("predicted_type"), "text")
    for r in every:
        rows = rows.union(r)
    return scoring.route(rows).groupBy("corpus", "document_type").agg(F.count("*").alias("n"))


@query(truth.ENTITIES)
def entity_rows(spark, sf_dir):
    found = entities.entities(R.resumes(spark, sf_dir)).where(F.col("label").isin("PERSON", "EMAIL", "LINKEDIN", "GITHUB", "ORG"))
    return found.select("doc_id", "label", "text")


# Layouts that the rendered documents do not have: lines made of the key


def made_of(c: Column, *parts: str) -> Column:
    """Lines with the key put in where a part holds {}."""
    text = lambda p: F.concat(*[x for piece in p.split("{}") for x in (F.lit(piece), c.cast("string"))][:-1])
    return F.array(*[text(p) for p in parts])


def opened(rows: DataFrame, **methods: Column) -> DataFrame:
    """doc_id, method and the fields of each record that a method gives."""
    named = lambda c, method: F.transform(c, lambda r: F.struct(F.lit(method).alias("method"), r.alias("r")))
    every = F.concat(*[named(c, m) for m, c in methods.items()])
    return rows.select("doc_id", F.explode_outer(every).alias("x")).where("x IS NOT NULL").select("doc_id", "x.method", "x.r.*")


def keyed_customers(spark, sf_dir) -> DataFrame:
    return R.spread(R.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 50 + 10).alias("n")))


@query(truth.EDUCATION_LAYOUTS)
def education_layouts(spark, sf_dir):
    """Studies by blocks, by windows, by near lines, and merged; a misspelt degree, a date before its institution, noise between."""
    rows = keyed_customers(spark, sf_dir)
    headed = made_of(F.col("n"), "EDUCATION", "Matric in Science", "City: X", "Gov School {}", "20{} to 20{}", "physics", "Bachlor of Arts", "19{}", "Lake University", "Diploma", "SKILLS", "Academy")
    bare = made_of(F.col("n"), "Some person", "19{}", "MBA", "Hill College {}", "LANGUAGES", "English")
    merged = history.merged_education(history.education_blocks(headed), headed)
    return opened(rows, blocks=history.education_blocks(headed), evidence=history.education_blocks(bare), windows=history.education_windows(headed), near=history.education_near(headed), merged=merged)


@query(truth.JOB_LAYOUTS)
def job_layouts(spark, sf_dir):
    """Jobs around dates, with and without a heading; a section read in order; records that say something."""
    rows = keyed_customers(spark, sf_dir)
    headed = made_of(F.col("n"), "WORK EXPERIENCE", "Data Analyst", "Firm {} Ltd", "20{} - Present", "Developed many useful reports", "Liked it", "EDUCATION", "Teacher")
    bare = made_of(F.col("n"), "A person", "Nurse", "City Hospital {}", "Jan 20{}", "Mar 20{}", "Helped people of every age")
    ordered = made_of(F.col("n"), "Teacher", "Home and online", "19{}", "20{}", "Taught physics to", "many pupils", "a@b.example.com", "Hill School, Lahore", "• Prepared plan {}", "SKILLS", "Python")
    none = F.lit(None).cast("string")
    stray = F.array(*[F.struct(none.alias("company"), F.lit(t).alias("job_title"), none.alias("duration"), F.array().cast("array<string>").alias("description")) for t in ("Communication", "Cook", "Go")])
    found = opened(rows, headed=history.job_regions(headed), bare=history.job_regions(bare), ordered=history.job_in_order(ordered), valid=history.valid_jobs(stray))
    return found.withColumn("description", joined(F.col("description")))


@query(truth.PROJECT_LAYOUTS)
def project_layouts(spark, sf_dir):
    rows = keyed_customers(spark, sf_dir)
    text = made_of(F.col("n"), "Projects", "It began as a sentence.", "Shop {}", "- Sells {} things", "Short line", "Fraud Detection {}", "Finds fraud.")
    return opened(rows, lines=history.projects(text)).drop("method").withColumn("description", joined(F.col("description")))


@query("SELECT c_custkey AS doc_id, 'I teach class ' || (c_custkey % 50 + 10) || ' with joy. More prose here' AS summary FROM customer")
def summary_prose(spark, sf_dir):
    text = made_of(F.col("n"), "Jo", "ABOUT ME", "Gender:", "Male", "I teach class {} with joy.", "jo{}@mail.example.com", "+92 300 12345{}", "Contact", "More prose here", "EXPERIENCE", "Cook")
    return keyed_customers(spark, sf_dir).select("doc_id", history.prose_about(text).alias("summary"))


@query(truth.COLONLESS)
def form_colonless(spark, sf_dir):
    """Known labels without a colon take a value of the two lines below; options stay without one."""
    text = joined(made_of(F.col("n"), "Name: Jo Lee", "Tar", "{} mg", "Nicotine", "brand", "0.{}", "Total Cost", "Menthol", "File Folder", "Unknown words", "Other: yes"), "\n")
    found = form.extract(keyed_customers(spark, sf_dir).select("doc_id", text.alias("text")))
    fields = F.transform("fields", lambda f: F.struct(*[f[c] for c in ("name", "value", "source", "review_required")], F.array_contains("checkbox_options", f["name"]).alias("is_option"), P.checkbox_field(f["name"]).alias("is_box")))
    return found.select("doc_id", F.explode_outer(fields).alias("f")).select("doc_id", "f.*")


@query(truth.ITEM_LAYOUTS)
def item_layouts(spark, sf_dir):
    """Rows that begin with a code above their description, and a list without a heading."""
    coded = made_of(F.col("n"), "Item Qty Price Amount", "000000111 1 {}.00 {}.00 SR", "Blue Chair {}", "Red Desk 2 10.00 20.00", "Sub Total 5")
    unheaded = made_of(F.col("n"), "{}.50", "x", "Blue chair {}", "Qty: {}", "Total {}")
    plain = F.transform(invoice.items_in_order(unheaded), lambda i: F.struct(i["description"].alias("description"), *[i[c].cast("string").alias(c) for c in ("quantity", "unit_price", "amount")]))
    return opened(keyed_customers(spark, sf_dir), coded=invoice.items(coded), unheaded=plain)


def whole_texts(spark, sf_dir, *parts: str) -> DataFrame:
    """A text for each customer, with its key put in where a part holds {}."""
    rows = R.spread(R.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id")))
    return rows.withColumn("text", joined(made_of(F.col("doc_id"), *parts), "\n"))


@query(truth.INVOICE_LAYOUT)
def invoice_layout(spark, sf_dir):
    """Rows with unit words, four numbers, descriptions above or below, quantities first, codes alone and before numbers."""
    parts = ["ACME STORE LTD", "Email: sales{}@acme.example.com", "Tel: 0300 12345{}", "Bill To: Buyer {}", "Item Qty Price Amount", "Blue Chair", "1 PC 9.00 0.00 9.00", "1 {}.00 {}.00", "Steel Table"]
    parts += ["2 M SpicyDeluxe 25.40", "A-100", "Green Lamp {}", "3 x 4.00 12.00", "000000111 1 {}.50 {}.50 SR", "Oak Desk", "Sub Total 5", "Tea 1 2.00 2.00"]
    found = invoice.extract(whole_texts(spark, sf_dir, *parts))
    return found.select("doc_id", "vendor_name", "vendor_email", "vendor_phone", "customer_name", F.explode_outer("items").alias("i")).select("*", "i.*").drop("i")


@query(truth.RECEIPT_LAYOUT)
def receipt_layout(spark, sf_dir):
    """A name above a slogan, or over two lines; places in the list before names; prices below; currencies."""
    listed = ["WELCOME", "BEST BUYS", "Save money. Live better.", "{} MAIN STREET", "LAKE, CA 90001", "1 APPLE PIE 1.00", "2 PEAR {}.50", "3 MILK", "2.25 X", "SUBTOTAL {}.75", "TOTAL € {}.75"]
    plain = ["CORNER", "AND SONS", "Thank you", "{} MAIN STREET", "2 TEA POTS 2.00", "7 CUPS {}.00", "SUBTOTAL {}.00", "TOTAL RP {}.00"]
    found = reduce(DataFrame.union, [receipt.extract(whole_texts(spark, sf_dir, *p)).select("doc_id", "merchant_name", "merchant_address", "currency", F.explode_outer("items").alias("i")) for p in (listed, plain)])
    return found.select("doc_id", "merchant_name", "merchant_address", "currency", "i.description", "i.amount")


@query(truth.RESUME_LAYOUT)
def resume_layout(spark, sf_dir):
    """A name over two lines, a job around its dates with title, firm and what was done; and one read in order, without a date."""
    dated = ["AVERY", "STONE", "Phone: +92 300 12345{}", "EDUCATION", "Bachelor of Science", "Lake university", "2010 - 2014", "WORK EXPERIENCE", "Data analyst", "Firm {} Ltd", "2015 - 2018", "Developed many reports for clients", "- Led weekly planning of work"]
    ordered = ["Jo Lee", "EXPERIENCE", "Shop keeper {}", "Kept the shop open all week", "and the books in order", "LANGUAGES", "English"]
    found = reduce(DataFrame.union, [resume.extract(whole_texts(spark, sf_dir, *p), only=["name", "experience"]).select("doc_id", "name", F.explode_outer("experience").alias("e")) for p in (dated, ordered)])
    return found.select("doc_id", "name", "e.company", "e.job_title", "e.duration", joined(F.col("e.description")).alias("description"))


@query(truth.FORM_MARKERS)
def form_markers(spark, sf_dir):
    """Values right above a marker, some lines above their label, and below it."""
    found = form.extract(whole_texts(spark, sf_dir, "Form", "34", "(13)", "Total Cost:", "(14)", "0.{}", "Some words", "Nicotine:", "(15)", "Tar:", "{} mg", "(16)"))
    return found.select("doc_id", F.explode_outer("fields").alias("f")).select("doc_id", "f.name", "f.value", "f.source")


@query(truth.FORM_ROWS)
def form_rows(spark, sf_dir):
    """Rows between markers: a value that another field has too, one above a marker that replaces a printed one, one
    some lines above its label."""
    lines = ("Manufacturer: Kent {}", "(2)", "Brand Name:", "Kent {}", "(3)", "MALIBU {}", "(4)", "Company Name: Former", "34", "(13)", "Cat-A-Expenses:", "(14)", "Cat-B-Expenses:", "Region: South", "{}.50", "Unit Price:", "Other:")
    found = form.extract(whole_texts(spark, sf_dir, "Form", *lines))
    return found.select("doc_id", F.explode_outer("fields").alias("f")).select("doc_id", "f.name", "f.value", "f.source", "f.review_required")


@query(truth.ENTITY_MAP)
def entity_map(spark, sf_dir):
    rows = whole_texts(spark, sf_dir, "RESUME", "Jo van Lee", "mail jo{}@gmail.com", "call +92 300 12345{}", "see www.jolee{}.org and github.com/jo{}")
    return entities.with_entity_map(rows).select("doc_id", "entities.*")


@query(truth.SECTION_TEXTS)
def section_texts(spark, sf_dir):
    """Sections by substring as texts; what stands before any is profile."""
    rows = R.resumes(spark, sf_dir).withColumn("lines", N.split_lines(F.col("text")))
    return rows.select("doc_id", F.explode_outer(entities.section_texts(F.col("lines"))).alias("section", "text")).where("section IN ('profile', 'summary', 'certifications', 'projects')")


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, nth) - 1 AS INTEGER) AS line_no, page AS page_no, text FROM (SELECT doc_id, CAST(2 - nth % 2 AS INTEGER) AS page, nth, line AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM documents) WHERE regexp_matches(line, '\\S'))")
def pages_joined(spark, sf_dir):
    """Lines dealt to two pages and read back page by page."""
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("nth", "text")).where(F.col("text").rlike(r"\S"))
    pages = rows.select("doc_id", (F.col("nth") % 2 + 1).cast("int").alias("page_no"), F.col("nth").alias("line_no"), "text")
    return lines.concat_pages(pages).select("doc_id", "line_no", "page_no", "text")


@query("SELECT c_custkey AS doc_id, CAST(c_custkey % 50 + 10 AS VARCHAR) || '0.50' AS due, CAST(NULL AS VARCHAR) AS absent FROM customer")
def keyword_amounts(spark, sf_dir):
    text = joined(made_of(F.col("n"), "Total due", "is {}O.5O in all", "not 7"), "\n")
    return keyed_customers(spark, sf_dir).select("doc_id", E.keyword_amount(text, "total due").alias("due"), E.keyword_amount(text, "rebate").alias("absent"))


# The store and its analytics


def stored(spark, sf_dir) -> DataFrame:
    """Stored documents made of orders: type, confidence and payload by the key."""
    return spark.sql(
        "SELECT o_orderkey AS id, concat('file-', o_orderkey, '.pdf') AS file_name, element_at(array('resume', 'invoice', 'receipt', 'form', ''), cast(o_orderkey % 5 AS int) + 1) AS document_type,"
        " CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE cast(o_orderkey % 101 AS double) END AS confidence, concat('text ', o_orderkey) AS raw_text,"
        " CASE WHEN o_orderkey % 5 = 3 THEN concat('{{\"completion_score\": ', o_orderkey % 100, ', \"analysis\": {{\"validation\": \"', o_orderkey % 50, '%\"}}, \"needs_review\": ', CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END, '}}')"
        " WHEN o_orderkey % 5 = 4 THEN '{{\"type\": \"memo\", \"confidence\": \"7\"}}' ELSE '{{bad json' END AS json_data FROM {orders}",
        orders=R.table(spark, sf_dir, "orders"),
    )


@query(truth.STORE + "SELECT id, file_name, document_type, confidence FROM store ORDER BY id DESC LIMIT 8")
def docs_recent(spark, sf_dir):
    return store.latest(stored(spark, sf_dir), 8).select("id", "file_name", "document_type", "confidence")


@query(truth.STORE + "SELECT id, file_name FROM store WHERE document_type = 'invoice'")
def docs_by_type(spark, sf_dir):
    return store.of_type(stored(spark, sf_dir), "invoice").select("id", "file_name")


@query(truth.STORE + "SELECT * FROM store WHERE id = 7")
def docs_get(spark, sf_dir):
    return store.get(stored(spark, sf_dir), 7)


@query(truth.STORE + "SELECT count(*) AS n, min(id) AS low, max(id) AS high FROM store WHERE id <> 0")
def docs_delete(spark, sf_dir):
    return store.without(stored(spark, sf_dir), 0).agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))


@query(truth.RECORDS + "SELECT * FROM records")
def store_records(spark, sf_dir):
    return store.records(stored(spark, sf_dir))


@query(truth.RECORDS + "SELECT count(*) AS documents, round(avg(confidence), 6) AS confidence, round(avg(completion), 6) AS completion, round(avg(validation), 6) AS validation, CAST(sum(CAST(needs_review AS BIGINT)) AS BIGINT) AS reviews, count(*) FILTER (lower(type) = 'resume') AS resume, count(*) FILTER (lower(type) = 'invoice') AS invoice, count(*) FILTER (lower(type) = 'receipt') AS receipt, count(*) FILTER (lower(type) = 'form') AS form FROM records")
def kpi_overview(spark, sf_dir):
    rows = store.kpis(store.records(stored(spark, sf_dir)))
    return rows.withColumns({c: F.round(c, 6) for c in ("confidence", "completion", "validation")})


@query(truth.RECORDS + "SELECT type, count(*) AS documents, round(avg(confidence), 1) AS confidence, round(avg(completion), 1) AS completion, round(avg(validation), 1) AS validation, CAST(sum(CAST(needs_review AS BIGINT)) AS BIGINT) AS reviews FROM records GROUP BY type")
def type_performance(spark, sf_dir):
    return store.by_type(store.records(stored(spark, sf_dir)))


@query(truth.RECORDS + "SELECT metric, round(score, 6) AS score FROM (SELECT 'confidence' AS metric, coalesce(avg(confidence), 0) AS score FROM records UNION ALL SELECT 'completion', coalesce(avg(completion), 0) FROM records UNION ALL SELECT 'validation', coalesce(avg(validation), 0) FROM records)")
def overall_quality(spark, sf_dir):
    return store.overall_quality(store.records(stored(spark, sf_dir))).withColumn("score", F.round("score", 6))


# Metrics and splits


def guesses(spark, sf_dir) -> DataFrame:
    """True quality of labelled documents and a guess: good if longer than 500 characters and not toxic."""
    labels = R.table(spark, sf_dir, "labels")
    rows = labels.join(docs(spark, sf_dir).select("doc_id", "n_chars"), "doc_id")
    return rows.select("doc_id", F.col("quality").alias("y_true"), ((F.col("n_chars") > 500) & (F.col("toxic") == 0)).cast("int").alias("y_pred"))


@query(truth.GUESSES + "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report")
def class_report(spark, sf_dir):
    return store.class_report(guesses(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(truth.GUESSES + "SELECT round(sum(recall * support) / sum(support), 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1, CAST(sum(support) AS BIGINT) AS support FROM report")
def weighted_scores(spark, sf_dir):
    return store.weighted_scores(guesses(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1")})


@query(truth.GUESSES + "SELECT y_true, count(*) FILTER (y_pred = 0) AS pred_0, count(*) FILTER (y_pred = 1) AS pred_1 FROM guesses GROUP BY y_true")
def confusion_matrix(spark, sf_dir):
    return store.confusion_matrix(guesses(spark, sf_dir), [0, 1])


@query(truth.SPLIT)
def stratified_split(spark, sf_dir):
    return store.stratified_split(docs(spark, sf_dir).select("doc_id", "lang"), "lang", "doc_id")


@query("SELECT doc_id, source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS label_index FROM documents")
def label_encode(spark, sf_dir):
    return store.encode_labels(docs(spark, sf_dir).select("doc_id", "source"), "source")


# OCR passes, made of the words of documents


def ocr_words(spark, sf_dir) -> DataFrame:
    """Two passes over each document's lines; the second sees every fifth word worse, or better for odd documents.

    Whole texts are dealt by document, and words are made where they are grouped: no word is shuffled."""
    split = lines.explode_lines(R.spread_wide(docs(spark, sf_dir).select("doc_id", "text"))).select("doc_id", F.col("line_no").alias("line_num"), F.posexplode(F.split("text", " ")).alias("left", "text"))
    every = split.withColumn("pass_no", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("block_num", F.lit(1)).withColumn("par_num", F.lit(1))
    return every.withColumn("conf", F.when((F.col("pass_no") == 2) & (F.col("left") % 5 == 0), F.when(F.col("doc_id") % 2 == 0, 40.0).otherwise(95.0)).otherwise(80.0) + F.col("doc_id") % 10)


@query(truth.OCR + "SELECT doc_id, pass_no, line_num, string_agg(text, ' ' ORDER BY \"left\") AS text, round(avg(conf), 2) AS confidence FROM words WHERE text <> '' GROUP BY ALL")
def ocr_line_group(spark, sf_dir):
    return ocr.grouped_lines(ocr_words(spark, sf_dir), ["doc_id", "pass_no"]).drop("block_num", "par_num")


def ocr_scores(spark, sf_dir) -> DataFrame:
    keys = ["doc_id", "pass_no"]
    return ocr.pass_scores(ocr.grouped_lines(ocr_words(spark, sf_dir), keys), keys)


@query(truth.OCR_SCORES + "SELECT doc_id, pass_no, line_count, CAST(floor(score * 100 + 0.00137) AS BIGINT) AS score FROM scores")
def ocr_pass_scores(spark, sf_dir):
    """Scores in hundredths, cut where no score ends, as sums of fractions differ in their last bits."""
    return ocr_scores(spark, sf_dir).select("doc_id", "pass_no", "line_count", F.floor(F.col("ocr_score") * 100 + 0.00137).alias("score"))


@query(truth.OCR_SCORES + "SELECT doc_id, pass_no FROM scores QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pass_no) = 1")
def ocr_best_pass(spark, sf_dir):
    return ocr.best_pass(ocr_scores(spark, sf_dir)).select("doc_id", "pass_no")


# Sources and sinks: written, and read back


@query("SELECT doc_id, source, lang, text FROM documents")
def records_written(spark, sf_dir):
    path, rows = scratch_path(spark, "records"), docs(spark, sf_dir).select("doc_id", "source", "lang", "text")
    writers.write_records(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("SELECT unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line FROM documents WHERE text <> ''")
def texts_written(spark, sf_dir):
    path = scratch_path(spark, "texts")
    rows = docs(spark, sf_dir).where("text <> ''").withColumn("text", F.replace("text", F.lit("\r"), F.lit("")))
    writers.write_texts(rows, path)
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"))


@query(truth.GUESSES + "SELECT printf('%d precision %.4f recall %.4f f1 %.4f support %d', label, precision, recall, f1, support) AS line FROM report")
def report_written(spark, sf_dir):
    path = scratch_path(spark, "report")
    writers.write_report(store.class_report(guesses(spark, sf_dir)), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(truth.GUESSES + "SELECT y_true, count(*) FILTER (y_pred = 0) AS pred_0, count(*) FILTER (y_pred = 1) AS pred_1 FROM guesses GROUP BY y_true")
def matrix_written(spark, sf_dir):
    path, matrix = scratch_path(spark, "matrix"), store.confusion_matrix(guesses(spark, sf_dir), [0, 1])
    writers.write_matrix(matrix, path)
    return spark.read.schema(matrix.schema).csv(path, header=True)


@query(truth.SPLIT)
def split_written(spark, sf_dir):
    path = scratch_path(spark, "split")
    rows = store.stratified_split(docs(spark, sf_dir).select("doc_id", "lang"), "lang", "doc_id")
    writers.write_split(rows.withColumn("label", F.col("lang")), path)
    return spark.read.parquet(path).select("doc_id", "lang", "split")


@query(f"SELECT doc_id, lang AS label, split, sha256(text) AS digest FROM ({truth.SPLIT}) JOIN (SELECT doc_id, text FROM documents) USING (doc_id) WHERE split <> 'test' AND lang IN ('de', 'en')")
def folders_read(spark, sf_dir):
    """A split written to labelled folders as records, of which two classes are read back: the others' folders are not listed."""
    path = scratch_path(spark, "folders")
    rows = store.stratified_split(docs(spark, sf_dir).select("doc_id", "lang", "text"), "lang", "doc_id").withColumn("label", F.col("lang"))
    rows.select("doc_id", "text", "split", "label").write.option("maxRecordsPerFile", 1000).partitionBy("split", "label").json(path)
    found = folders.labelled_files(spark, path, suffixes=".json").where("split <> 'test' AND label IN ('de', 'en')")
    lines = found.select("label", "split", F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line")).where("line <> ''")
    record = F.from_json("line", "doc_id long, text string").alias("r")
    return lines.select("label", "split", record).select("r.doc_id", "label", "split", F.sha2("r.text", 256).alias("digest"))


@query("SELECT 'scan-' || doc_id || '.png' AS value FROM documents WHERE n_chars < 200")
def corrupt_written(spark, sf_dir):
    path = scratch_path(spark, "corrupt")
    scans = docs(spark, sf_dir).select(F.format_string("scan-%d.png", "doc_id").alias("path"), (F.col("n_chars") >= 200).alias("valid"))
    return spark.read.schema("value string").text(path) if writers.write_corrupt(scans, path) else spark.createDataFrame([], "value string")


def filled_store(spark, sf_dir) -> str:
    """Two batches of stored documents, inserted one after the other, each in the order of its keys."""
    path, orders = scratch_path(spark, "store"), R.table(spark, sf_dir, "orders")
    name, given = F.format_string("order-%d", "o_orderkey"), F.when(F.col("o_orderkey") % 3 == 1, (F.col("o_orderkey") % 101).cast("string")).when(F.col("o_orderkey") % 3 == 2, "unknown")
    payload = F.struct(F.col("o_orderkey").alias("total"), F.struct((F.col("o_orderkey") % 7).alias("confidence")).alias("statistics"))
    for half in (0, 1):
        store.insert(orders.where(F.col("o_orderkey") % 2 == half).orderBy("o_orderkey"), path, payload, name, F.lit("invoice"), given, F.when(F.col("o_orderkey") % 5 > 0, "text"))
    return path


STORED_ORDERS = (
    "WITH stored AS (SELECT row_number() OVER (ORDER BY o_orderkey % 2, o_orderkey) AS id, 'order-' || o_orderkey AS file_name, 'invoice' AS document_type,"
    " CAST(CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 7 WHEN 1 THEN o_orderkey % 101 ELSE 0 END AS DOUBLE) AS confidence, CASE WHEN o_orderkey % 5 > 0 THEN 'text' ELSE '' END AS raw_text,"
    " '{\"total\":' || o_orderkey || ',\"statistics\":{\"confidence\":' || o_orderkey % 7 || '}}' AS json_data FROM orders) "
)


@query(STORED_ORDERS + "SELECT * FROM stored")
def documents_appended(spark, sf_dir):
    """Ids go on from batch to batch; a document without a confidence has that of its statistics."""
    return spark.read.parquet(filled_store(spark, sf_dir))


@query(STORED_ORDERS + "SELECT id, file_name, 'true|true|false|false' AS answers FROM stored WHERE id NOT IN (3, (SELECT max(id) FROM stored))")
def documents_deleted(spark, sf_dir):
    """The store after deletes of the third id, the last one, one that never was, and the third again."""
    path = filled_store(spark, sf_dir)
    last = spark.read.parquet(path).agg(F.max("id")).first()[0]
    answers = "|".join(str(store.delete(spark, path, i)).lower() for i in (3, last, last + 1, 3))
    return spark.read.parquet(path).select("id", "file_name", F.lit(answers).alias("answers"))


@query("SELECT doc_id, CAST((n - 1) // 32 AS BIGINT) AS batch, CAST((n - 1) % 32 AS BIGINT) AS place FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42-' || doc_id), doc_id) AS n FROM documents)")
def training_batches(spark, sf_dir):
    return batches(docs(spark, sf_dir).select("doc_id"), F.col("doc_id"), 32, 42)


@query(truth.EPOCHS)
def best_model_epochs(spark, sf_dir):
    """A run for each user, an epoch for each event: where training stops, and which epochs improved."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    epochs = R.table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), nth.cast("long").alias("epoch"), F.floor("value").alias("score"))
    return store.best_epochs(epochs)


@query(truth.GUESSES + truth.FULL_REPORT + "SELECT place, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM whole")
def full_report(spark, sf_dir):
    return store.full_report(guesses(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(truth.GUESSES + truth.FULL_REPORT + truth.REPORT_LINES)
def report_text(spark, sf_dir):
    """The report's text, written and read back."""
    path = scratch_path(spark, "report")
    writers.write_full_report(store.full_report(guesses(spark, sf_dir)), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(truth.DATASET)
def dataset_build(spark, sf_dir):
    """Documents, conversations and benchmark items as one dataset without equal texts, split by source."""
    talks = R.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "text")
    items = R.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("item"), "text")
    mails = docs(spark, sf_dir).where("lang = 'en'").select("doc_id", "text", "lang")
    whole = store.dataset({"documents": docs(spark, sf_dir).select("doc_id", "lang", "text"), "mails": mails, "talks": talks, "items": items}, "text")
    return whole.groupBy("source").agg(F.count("*").alias("n"), F.count("lang").alias("n_lang"), F.count("turn").alias("n_turn"), F.count("item").alias("n_item"), F.countDistinct("text").alias("n_texts"))


@query(truth.BEST_JOBS)
def best_jobs(spark, sf_dir):
    """The five best jobs of every resume, of all jobs."""
    people = resume.extract(R.resumes(spark, sf_dir), only=["skills"]).select("doc_id", "skills")
    found = scoring.best_jobs(people, scoring.job_skills(R.jobs(spark, sf_dir)))
    return found.select("doc_id", "rank", "job_id", F.col("n_matched").cast("long").alias("n_matched"), F.col("match_score").cast("double").alias("match_score"))


@query(truth.DISPATCHED)
def dispatched_documents(spark, sf_dir):
    """Documents of all kinds in one table, with broken rows among them: one reading, one envelope each, one write by type, read back."""
    kinds = {"invoices": "form", "receipts": "receipt", "forms": "form", "resumes": "Resume "}
    every = [getattr(R, n)(spark, sf_dir).select("doc_id", F.lit(n).alias("corpus"), F.lit(p).alias("predicted_type"), F.col("text").cast("binary").alias("text")) for n, p in kinds.items()]
    odd = F.when(F.col("doc_id") % 4 == 0, "memo").when(F.col("doc_id") % 4 != 1, "form")
    broken = F.when(F.col("doc_id") % 4 == 3, F.unhex(F.lit("80FF61"))).when(F.col("doc_id") % 4 != 2, F.col("text").cast("binary"))
    every.append(docs(spark, sf_dir).select("doc_id", F.lit("documents").alias("corpus"), odd.alias("predicted_type"), broken.alias("text")))
    rows = reduce(DataFrame.union, every).withColumn("confidence", F.lit(0.5))
    envelopes, path = pipeline.dispatch(materialise(R.spread(rows), "mixed")), scratch_path(spark, "envelopes")
    writers.write_by_type(envelopes, path)
    found = spark.read.parquet(path)
    right = F.count_if((F.col("invoice.total").isNotNull() & F.col("invoice.invoice_date").isNotNull()) | (F.col("form.total_fields") > 0) | (F.size("resume.skills") > 0))
    return found.groupBy("corpus", "document_type", "kind", "error_message").agg(F.count("*").alias("n"), right.alias("n_filled"), F.count("payload").alias("n_payload"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'image' END AS input_type FROM documents")
def input_types(spark, sf_dir):
    suffixes = F.array(*map(F.lit, (".PDF", ".jpeg", ".v2.Tif", ".docx", "")))
    path = F.concat(F.lit("/in.box/scan-"), F.col("doc_id").cast("string"), F.get(suffixes, (F.col("doc_id") % 5).cast("int")))
    return docs(spark, sf_dir).select("doc_id", files.input_type(path).alias("input_type"))
