"""SQL (DuckDB) of what the registered queries should give, from the tables alone."""

from __future__ import annotations

from doclens import vocabulary as V
from doclens.operators import ocr
from doclens.plans.rendered import PAYMENTS, VENDORS


def listed(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def money(cents: str) -> str:
    return f"(({cents}) // 100) || '.' || lpad(CAST(({cents}) % 100 AS VARCHAR), 2, '0')"


def ocr_corrected(text: str) -> str:
    """The substitutions one after another, then blanks and empty lines."""
    out = text
    for old, new in V.OCR_WORDS:
        out = f"regexp_replace({out}, '{old}', '{new}', 'gi')"
    return f"trim(regexp_replace(regexp_replace({out}, ' {{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"


LINES = f"""
WITH split AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) AS text,
    generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')), 1) - 1 AS line_no FROM documents),
lines AS (SELECT doc_id, line_no, text FROM split),
clean AS (SELECT doc_id, line_no, {ocr_corrected("trim(regexp_replace(text, '\\s+', ' ', 'g'))")} AS text FROM lines),
kept AS (SELECT doc_id, line_no, text FROM clean WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, lower(text) ORDER BY line_no) = 1)
"""


def mistaken(expression: str) -> str:
    return f"SELECT doc_id, md5({expression}) AS digest FROM (SELECT doc_id, replace(text, ' ', ' Panda5  ') AS text FROM documents)"


def _resume_normal() -> str:
    out = "text"
    for old, new in V.RESUME_WORDS:
        out = f"replace({out}, '{old}', '{new}')"
    out = f"regexp_replace({out}, '[ \\t]+', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({out}, '\\n{{2,}}', chr(10), 'g'), ' *\\n *', chr(10), 'g'), ' ' || chr(10))"


RESUME_NORMAL = _resume_normal()


def every(name: str, pattern: str) -> str:
    found = f"list_distinct(regexp_extract_all(text, '{pattern}'))"
    return f"SELECT doc_id, array_to_string(list_sort({found}), '|') AS {name}s, CAST(len({found}) AS BIGINT) AS n_{name} FROM documents"


INVOICES = f"""
WITH rows AS (SELECT o.o_orderkey AS k, o.o_custkey AS c, o.o_orderdate AS d, p.p_name AS name, CAST(l.l_quantity AS BIGINT) AS q,
    CAST(round(l.l_extendedprice * 100) AS BIGINT) // CAST(l.l_quantity AS BIGINT) AS u
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey),
docs AS (SELECT k, c, d, CAST(sum(q * u) AS BIGINT) AS s, {listed(VENDORS)}[k % 4 + 1] AS vendor, upper({listed(PAYMENTS)}[k % 4 + 1]) AS pay FROM rows GROUP BY k, c, d)
"""

RECEIPTS = """
WITH rows AS (SELECT o.o_orderkey AS k, o.o_orderdate AS d, upper(p.p_name) AS name, CAST(round(l.l_extendedprice * 100) AS BIGINT) % 90000 + 100 AS a
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey),
docs AS (SELECT k, d, CAST(sum(a) AS BIGINT) AS s, count(*) AS n FROM rows GROUP BY k, d)
"""

FORMS = """
SELECT c_custkey AS doc_id, 'Person ' || chr(CAST(65 + c_custkey % 26 AS INTEGER)) || 'son' AS name, 'user' || c_custkey || '@mail.example.com' AS email,
  lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') || '/' || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') || '/1990' AS date_of_birth,
  CASE WHEN c_custkey % 5 <> 0 THEN '0300' || lpad(CAST(c_custkey % 10000000 AS VARCHAR), 7, '0') END AS phone, (c_custkey % 90 + 1) || ' Garden Road' AS address,
  CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender, CASE WHEN c_custkey % 3 = 0 THEN 'next_line' ELSE 'inline' END AS email_source, CAST(9 AS BIGINT) AS total_fields
FROM customer
"""

RESUMES = """
SELECT c_custkey AS doc_id, 'Avery ' || ['Stone', 'Field', 'Brook', 'Marsh', 'Ridge'][c_custkey % 5 + 1] AS name, 'avery' || c_custkey || '@mail.example.com' AS email,
  '0300' || lpad(CAST(c_custkey % 10000000 AS VARCHAR), 7, '0') AS phone, CASE WHEN c_custkey % 2 = 0 THEN 'https://www.linkedin.com/in/avery-' || c_custkey END AS linkedin,
  CASE WHEN c_custkey % 3 = 0 THEN 'https://github.com/avery' || c_custkey END AS github, 'Careful worker with many years of practice' AS summary,
  CASE WHEN c_custkey % 2 = 0 THEN 'English|Pushto' ELSE 'English|German' END AS languages, 'Safety Course ' || c_custkey % 3 AS certifications
FROM customer
"""

EDUCATION = """
SELECT c_custkey AS doc_id, 'Bachelor of Science in Physics' AS degree, 'Lakeside University ' || c_custkey % 9 AS institution, (1990 + c_custkey % 20) || ' - ' || (1994 + c_custkey % 20) AS year FROM customer
UNION ALL SELECT c_custkey, 'Master of Arts', 'Hillside College', '2015 - 2017' FROM customer WHERE c_custkey % 4 = 0
"""

_WORDS = listed(V.SKILLS)
_N = len(V.SKILLS)
_NESTED = ", ".join(f"('{long}', '{short}')" for long in V.SKILLS for short in V.SKILLS if short != long and f" {short.lower()} " in f" {long.lower()} ")


def _skills_of(key: str, picks: list[tuple[int, int]], extra: str) -> str:
    """Skills named in a text and those that another one's name holds, sorted."""
    chosen = ", ".join(f"{_WORDS}[({key} * {a} + {b}) % {_N} + 1]" for a, b in picks)
    return f"""own AS (SELECT {key} AS id, unnest([{chosen}]{extra}) AS skill FROM {{table}}),
nested(long, short) AS (VALUES {_NESTED}),
named AS (SELECT id, skill FROM own UNION SELECT id, short FROM own JOIN nested ON long = skill),
sets AS (SELECT id, list_sort(list(DISTINCT skill)) AS skills FROM named GROUP BY id)"""


_PEOPLE = _skills_of("c_custkey", [(1, 0), (7, 3), (11, 5)], " || ['Physics']").format(table="customer")
_JOBS = _skills_of("p_partkey", [(1, 0), (5, 1), (9, 2), (13, 4)], "").format(table="part")
SKILLS = f"WITH {_PEOPLE} SELECT id AS doc_id, array_to_string(skills, '|') AS skills, CAST(len(skills) AS BIGINT) AS n_skills FROM sets"
JOB_SKILLS = f"WITH {_JOBS} SELECT id AS job_id, array_to_string(skills, '|') AS skills FROM sets"
ATS = f"""WITH {_PEOPLE} SELECT id AS doc_id, CAST(70 + CASE WHEN len(skills) >= 5 THEN 15 ELSE 0 END + CASE WHEN id % 2 = 0 THEN 5 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 5 ELSE 0 END AS INTEGER) AS ats_score,
  CAST(CASE WHEN len(skills) >= 5 THEN 0 ELSE 1 END + CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END + CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS n_advice FROM sets"""


def _renamed(ctes: str, suffix: str) -> str:
    for name in ("own", "nested", "named", "sets"):
        ctes = ctes.replace(f"{name} AS", f"{name}_{suffix} AS").replace(f"FROM {name} ", f"FROM {name}_{suffix} ").replace(f"JOIN {name} ", f"JOIN {name}_{suffix} ").replace(f"{name}(long", f"{name}_{suffix}(long")
    return ctes


MATCH = f"""
WITH {_renamed(_PEOPLE, "p")}, {_renamed(_JOBS, "j")},
pairs AS (SELECT p.id AS doc_id, j.id AS job_id, list_sort(list_filter(j.skills, lambda s: list_contains(p.skills, s))) AS hit, list_sort(list_filter(j.skills, lambda s: NOT list_contains(p.skills, s))) AS miss, j.skills AS wanted
  FROM sets_p p JOIN sets_j j ON p.id % (SELECT count(*) FROM part) = j.id)
SELECT doc_id, job_id, array_to_string(hit, '|') AS matched, array_to_string(miss, '|') AS missing, CASE WHEN len(wanted) > 0 THEN round(len(hit) * 100.0 / len(wanted), 2) ELSE 0.0 END::DOUBLE AS match_score,
  CASE WHEN len(miss) > 0 THEN 'Learn these skills: ' || array_to_string(miss, ', ') ELSE 'Excellent match for this job.' END AS recommendation,
  CASE WHEN len(miss) > 0 THEN 'Learning ' || array_to_string(miss, ', ') || ' can significantly improve your chances for this role.' ELSE 'Your profile already fits this role.' END AS career_recommendation
FROM pairs
"""

ENTITIES = """
SELECT c_custkey AS doc_id, 'PERSON' AS label, 'Avery ' || ['Stone', 'Field', 'Brook', 'Marsh', 'Ridge'][c_custkey % 5 + 1] AS text FROM customer
UNION ALL SELECT c_custkey, 'EMAIL', 'avery' || c_custkey || '@mail.example.com' FROM customer
UNION ALL SELECT c_custkey, 'LINKEDIN', 'linkedin.com/in/avery-' || c_custkey FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'GITHUB', 'https://github.com/avery' || c_custkey FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 'ORG', 'Lakeside University ' || c_custkey % 9 FROM customer
UNION ALL SELECT c_custkey, 'ORG', 'Company: Firm ' || c_custkey % 50 FROM customer
UNION ALL SELECT c_custkey, 'ORG', 'Hillside College' FROM customer WHERE c_custkey % 4 = 0
"""

SECTIONS = """
SELECT c_custkey AS doc_id, s.section, CAST(CASE WHEN s.section = 'education' AND c_custkey % 4 = 0 THEN 6 ELSE s.n END AS BIGINT) AS n_lines FROM customer,
  (VALUES ('profile', 5), ('summary', 1), ('skills', 3), ('education', 4), ('experience', 5), ('projects', 2), ('certifications', 1), ('languages', 1)) AS s(section, n)
"""

BLOCKS = """
SELECT c_custkey AS doc_id, CAST(1 AS BIGINT) AS block, CAST(CASE WHEN c_custkey % 4 = 0 THEN 3 ELSE 17 END AS BIGINT) AS n_lines, 'Bachelor of Science in Physics' AS degree FROM customer
UNION ALL SELECT c_custkey, CAST(2 AS BIGINT), CAST(16 AS BIGINT), 'Master of Arts' FROM customer WHERE c_custkey % 4 = 0
"""

ROUTES = """
WITH orders_with_items AS (SELECT count(DISTINCT o_orderkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT 'invoices' AS corpus, 'invoice' AS document_type, n FROM orders_with_items UNION ALL SELECT 'receipts', 'invoice', n FROM orders_with_items
UNION ALL SELECT 'forms', 'form', count(*) FROM customer UNION ALL SELECT 'resumes', 'resume', count(*) FROM customer UNION ALL SELECT 'documents', 'form', count(*) FROM documents
"""

STORE = """
WITH store AS (SELECT o_orderkey AS id, 'file-' || o_orderkey || '.pdf' AS file_name, ['resume', 'invoice', 'receipt', 'form', ''][o_orderkey % 5 + 1] AS document_type,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS DOUBLE) END AS confidence, 'text ' || o_orderkey AS raw_text,
  CASE WHEN o_orderkey % 5 = 3 THEN '{"completion_score": ' || o_orderkey % 100 || ', "analysis": {"validation": "' || o_orderkey % 50 || '%"}, "needs_review": ' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END || '}'
  WHEN o_orderkey % 5 = 4 THEN '{"type": "memo", "confidence": "7"}' ELSE '{bad json' END AS json_data FROM orders)
"""

RECORDS = (
    STORE
    + """, records AS (SELECT id, file_name, ['Resume', 'Invoice', 'Receipt', 'Form', 'Memo'][id % 5 + 1] AS type, coalesce(confidence, CASE WHEN id % 5 = 4 THEN 7.0 END) AS confidence,
  CASE WHEN id % 5 = 3 THEN CAST(id % 100 AS DOUBLE) END AS completion, CASE WHEN id % 5 = 3 THEN CAST(id % 50 AS DOUBLE) END AS validation, id % 5 = 3 AND id % 2 = 0 AS needs_review FROM store) """
)

GUESSES = """
WITH guesses AS (SELECT doc_id, quality AS y_true, CAST(n_chars > 500 AND toxic = 0 AS INTEGER) AS y_pred FROM labels JOIN documents USING (doc_id)),
classes AS (SELECT DISTINCT y_true AS label FROM guesses UNION SELECT DISTINCT y_pred FROM guesses),
sums AS (SELECT label, count(*) FILTER (y_true = label) AS support, count(*) FILTER (y_pred = label) AS guessed, count(*) FILTER (y_true = label AND y_pred = label) AS hits FROM guesses, classes GROUP BY label),
ratios AS (SELECT label, support, CASE WHEN guessed > 0 THEN hits / guessed ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall FROM sums),
report AS (SELECT label, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, support FROM ratios)
"""

SPLIT = """
SELECT doc_id, lang, CASE WHEN place <= n * 70 // 100 THEN 'train' WHEN place <= n * 70 // 100 + n * 15 // 100 THEN 'valid' ELSE 'test' END AS split
FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents)
"""

OCR = (
    LINES
    + """, words AS (SELECT doc_id, line_no AS line_num, "left", pass_no, text, CASE WHEN pass_no = 2 AND "left" % 5 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 40.0 ELSE 95.0 END ELSE 80.0 END + doc_id % 10 AS conf
  FROM (SELECT doc_id, line_no, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS "left" FROM lines), (VALUES (1), (2)) AS p(pass_no)) """
)

_TERMS = " + ".join(f"max(CASE WHEN contains(lower(text), '{t}') THEN {w} ELSE 0 END)" for t, w in ocr.TERMS.items())
OCR_SCORES = (
    OCR
    + f""", grouped AS (SELECT doc_id, pass_no, line_num, string_agg(text, ' ' ORDER BY "left") AS text, round(avg(conf), 2) AS confidence FROM words WHERE text <> '' GROUP BY ALL),
scores AS (SELECT doc_id, pass_no, count(*) AS line_count, least(count(*), 80) * 0.15 + avg(confidence) * 0.35 + {_TERMS}
  + least(sum(len(regexp_extract_all(text, '\\b\\d+[.,]\\d{{1,3}}\\b'))), 40) * 1.2 + CASE WHEN bool_or(regexp_matches(lower(text), '\\b(tc|rcpt|receipt|txn|transaction|ref)')) THEN 8 ELSE 0 END
  + CASE WHEN bool_or(regexp_matches(text, '\\b\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}\\b')) THEN 8 ELSE 0 END + least(count(*) FILTER (regexp_matches(text, '[A-Za-z].*\\d+[.,]\\d{{1,3}}\\s*$')), 30) * 0.8
  - count(*) FILTER (length(text) > 90) * 1.5 + least(sum(len(regexp_extract_all(text, '[A-Za-z]{{2,}}'))), 60) * 0.05 AS score FROM grouped GROUP BY doc_id, pass_no) """
)

# Values are handed out once, so equal amounts of a form leave the later field empty; a total of two categories is mended or flagged.
FORM_SCORES = """
WITH keys AS (SELECT c_custkey AS k, c_custkey % 100 * 10 AS a, c_custkey % 70 * 10 AS b, CASE WHEN c_custkey % 7 = 0 THEN 5 ELSE 0 END AS e FROM customer),
marks AS (SELECT *, k % 5 = 0 AS no_phone, a = b AS no_b, a + b + e IN (a, b) AND a <> b AS mended, a + b + e = a AND a = b AS no_total, a <> b AND e > 0 AND a + b + e NOT IN (a, b) AS odd FROM keys),
counts AS (SELECT *, 9 - CAST(no_phone AS BIGINT) - CAST(no_b AS BIGINT) - CAST(no_total AS BIGINT) AS n FROM marks)
SELECT k AS doc_id, CAST(n AS INTEGER) AS completed_fields, array_to_string(list_filter([CASE WHEN no_phone THEN 'phone' END, CASE WHEN no_b THEN 'cat_b_expenses' END, CASE WHEN no_total THEN 'total_expenses' END], lambda x: x IS NOT NULL), '|') AS missing_fields,
  round(n * 100.0 / 9, 2)::DOUBLE AS completion_score, round((n - CASE WHEN odd THEN 0.75 ELSE 0 END) / n * 100, 2)::DOUBLE AS validation_score, odd AS needs_review FROM counts
"""

VALUES = """
SELECT o_orderkey AS k, CAST(n AS DOUBLE) AS per_cent, CASE WHEN n % 2 = 0 THEN 0.0 ELSE n END::DOUBLE AS safe, n + 0.5::DOUBLE AS form_amount, (n // 4) || ['.00', '.25', '.50', '.75'][n % 4 + 1] AS places, format('{:,}', n) || '.5' AS grouped,
  n % 3 <> 1 AS is_numeric, n % 2 = 0 AS is_checked, n % 2 = 0 AS is_marker, n % 2 = 0 AS is_person, 'a b ' || n AS plain, 'Bachelor of Mathematics ' || n AS degree,
  CASE n % 3 WHEN 0 THEN 'experience' WHEN 1 THEN 'education' END AS section FROM (SELECT o_orderkey, CAST(o_orderkey % 90000 AS BIGINT) AS n FROM orders)
"""


_KEYED = "(SELECT c_custkey AS doc_id, CAST(c_custkey % 50 + 10 AS VARCHAR) AS n FROM customer)"


def records(columns: str, *rows: str) -> str:
    """SQL of the given rows for each key."""
    return " UNION ALL ".join(f"SELECT doc_id, {', '.join(f'{v} AS {c}' for c, v in zip(columns.split(), row.split(' ; '), strict=True))} FROM {_KEYED}" for row in rows)


EDUCATION_LAYOUTS = records(
    "method degree institution year",
    *(f"'{m}' ; 'Matric in Science' ; 'Gov School ' || n ; '20' || n || ' to 20' || n" for m in ("blocks", "windows", "merged")),
    *(f"'{m}' ; 'Bachlor of Arts' ; 'Lake University' ; '19' || n" for m in ("blocks", "merged")),
    "'blocks' ; 'Diploma' ; CAST(NULL AS VARCHAR) ; CAST(NULL AS VARCHAR)",
    "'evidence' ; 'MBA' ; 'Hill College ' || n ; '19' || n",
    "'windows' ; 'Bachelor of Arts' ; 'Lake University' ; '19' || n",
    "'near' ; 'Matric in Science' ; 'City: X' ; '20' || n || ' to 20' || n",
    "'near' ; 'Diploma' ; CAST(NULL AS VARCHAR) ; CAST(NULL AS VARCHAR)",
)

JOB_LAYOUTS = records(
    "method company job_title duration description",
    "'headed' ; 'Firm ' || n || ' Ltd' ; 'Data Analyst' ; '20' || n || ' - Present' ; 'Developed many useful reports'",
    "'bare' ; 'City Hospital ' || n ; 'Nurse' ; 'Jan 20' || n || ' - Mar 20' || n ; 'Helped people of every age'",
    "'ordered' ; CAST(NULL AS VARCHAR) ; 'Teacher - Home and online' ; '19' || n || ' - 20' || n ; 'Taught physics to many pupils|Prepared plan ' || n",
    "'valid' ; CAST(NULL AS VARCHAR) ; 'Cook' ; CAST(NULL AS VARCHAR) ; ''",
)

PROJECT_LAYOUTS = records("title description", "'Shop ' || n ; 'Sells ' || n || ' things|Short line'", "'Fraud Detection ' || n ; 'Finds fraud.'")

COLONLESS = records(
    "name value source review_required is_option is_box",
    "'name' ; 'Jo Lee' ; 'inline' ; false ; false ; false",
    "'other' ; 'yes' ; 'inline' ; false ; false ; false",
    "'tar' ; n || ' mg' ; 'colonless_next_line' ; false ; false ; false",
    "'nicotine' ; '0.' || n ; 'colonless_next_line' ; false ; false ; false",
    "'total_cost' ; CAST(NULL AS VARCHAR) ; 'colonless' ; false ; false ; false",
    "'menthol' ; CAST(NULL AS VARCHAR) ; 'colonless' ; false ; false ; true",
    "'file_folder' ; 'Unknown words' ; 'colonless_next_line' ; false ; true ; false",
)

ITEM_LAYOUTS = records(
    "method description quantity unit_price amount",
    "'coded' ; 'Blue Chair ' || n ; '1' ; n || '.00' ; n || '.00'",
    "'coded' ; 'Red Desk' ; '2' ; '10.00' ; '20.00'",
    "'unheaded' ; 'Blue chair ' || n ; n ; n || '.5' ; n || '.5'",
)

EPOCHS = """
WITH epochs AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, CAST(floor(value) AS BIGINT) AS score FROM events),
marked AS (SELECT *, coalesce(score > max(score) OVER w, true) AS improved FROM epochs WINDOW w AS (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
counted AS (SELECT *, epoch - max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS since, max(score) OVER (PARTITION BY run ORDER BY epoch) AS best FROM marked)
SELECT run, epoch, score, best, improved, since, since = 5 AS stops FROM counted WHERE epoch <= coalesce((SELECT min(epoch) FROM counted c WHERE c.run = counted.run AND c.since = 5), epoch)
"""

FULL_REPORT = """, whole AS (SELECT 0 AS place, CAST(label AS VARCHAR) AS label, precision, recall, f1, support FROM report
UNION ALL SELECT 1, 'accuracy', NULL, NULL, sum(recall * support) / sum(support), CAST(sum(support) AS BIGINT) FROM report
UNION ALL SELECT 2, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM report
UNION ALL SELECT 3, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM report) """

REPORT_LINES = """
SELECT printf('Accuracy : %.4f', f1) AS line FROM whole WHERE place = 1 UNION ALL SELECT printf('Precision : %.4f', precision) FROM whole WHERE place = 3
UNION ALL SELECT printf('Recall : %.4f', recall) FROM whole WHERE place = 3 UNION ALL SELECT printf('F1 Score : %.4f', f1) FROM whole WHERE place = 3
UNION ALL SELECT '' FROM range(3) UNION ALL SELECT '              precision    recall  f1-score   support'
UNION ALL SELECT lpad(label, 12, ' ') || '  ' || lpad(coalesce(printf('%.2f', precision), ''), 9, ' ') || ' ' || lpad(coalesce(printf('%.2f', recall), ''), 9, ' ') || ' ' || lpad(printf('%.2f', f1), 9, ' ') || ' ' || lpad(CAST(support AS VARCHAR), 9, ' ') FROM whole
"""

DATASET = """
WITH every AS (SELECT 1 AS rank, 'documents' AS source, text, lang, NULL AS turn, NULL AS item FROM documents UNION ALL SELECT 2, 'mails', text, lang, NULL, NULL FROM documents WHERE lang = 'en'
UNION ALL SELECT 3, 'talks', text, NULL, turn, NULL FROM conversations UNION ALL SELECT 4, 'items', text, NULL, NULL, item_id FROM benchmark),
kept AS (SELECT text, min(rank) AS rank FROM every WHERE text IS NOT NULL GROUP BY text UNION ALL SELECT NULL, rank FROM every WHERE text IS NULL)
SELECT ['documents', 'mails', 'talks', 'items'][rank] AS source, count(*) AS n, CAST(count(*) * CAST(rank < 3 AS INTEGER) AS BIGINT) AS n_lang, CAST(count(*) * CAST(rank = 3 AS INTEGER) AS BIGINT) AS n_turn,
  CAST(count(*) * CAST(rank = 4 AS INTEGER) AS BIGINT) AS n_item, count(DISTINCT text) AS n_texts FROM kept GROUP BY rank
"""

BEST_JOBS = f"""
WITH {_renamed(_PEOPLE, "p")}, {_renamed(_JOBS, "j")},
pairs AS (SELECT p.id AS doc_id, j.id AS job_id, len(list_filter(j.skills, lambda s: list_contains(p.skills, s))) AS n_matched, len(j.skills) AS n FROM sets_p p, sets_j j WHERE list_has_any(p.skills, j.skills))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n_matched / n DESC, job_id) AS INTEGER) AS rank, job_id, CAST(n_matched AS BIGINT) AS n_matched, round(n_matched * 100.0 / n, 2)::DOUBLE AS match_score
FROM pairs QUALIFY rank <= 5
"""

DISPATCHED = """
WITH orders_with_items AS (SELECT count(DISTINCT o_orderkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
odd AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'No extractor for document type: memo' WHEN 2 THEN 'The document has no text.' WHEN 3 THEN 'The text is not UTF-8.' ELSE 'The document has no type.' END AS error_message,
  CASE doc_id % 4 WHEN 0 THEN 'memo' WHEN 1 THEN 'unknown' ELSE 'form' END AS document_type FROM documents)
SELECT 'invoices' AS corpus, 'invoice' AS document_type, 'invoice' AS kind, CAST(NULL AS VARCHAR) AS error_message, n, n AS n_filled, n AS n_payload FROM orders_with_items
UNION ALL SELECT 'receipts', 'invoice', 'invoice', NULL, n, n, n FROM orders_with_items
UNION ALL SELECT 'forms', 'form', 'form', NULL, count(*), count(*), count(*) FROM customer UNION ALL SELECT 'resumes', 'resume', 'resume', NULL, count(*), count(*), count(*) FROM customer
UNION ALL SELECT 'documents', document_type, 'quarantine', error_message, count(*), 0, 0 FROM odd GROUP BY ALL
"""


def _rows(columns: str, *rows: str) -> str:
    """A row of each kind for each customer k; columns are parted by blanks, values by semicolons."""
    names = columns.split()
    told = [", ".join(f"{v.strip()} AS {n}" for n, v in zip(names, r.split(";"), strict=True)) for r in rows]
    return " UNION ALL ".join(f"SELECT k AS doc_id, {t} FROM (SELECT c_custkey AS k FROM customer)" for t in told)


INVOICE_LAYOUT = (
    "WITH items AS ("
    + _rows(
        "description quantity unit_price amount",
        "'Blue Chair'; '1'; '9.00'; '9.00'",
        "'Steel Table'; '1'; k || '.00'; k || '.00'",
        "'M SpicyDeluxe'; '2'; NULL; '25.40'",
        "'Green Lamp ' || k; '3'; '4.00'; '12.00'",
        "'Oak Desk'; '1'; k || '.50'; k || '.50'",
    )
    + ") SELECT doc_id, 'ACME STORE LTD' AS vendor_name, 'sales' || doc_id || '@acme.example.com' AS vendor_email, '0300 12345' || doc_id AS vendor_phone, 'Buyer ' || doc_id AS customer_name, description, quantity, unit_price, amount FROM items"
)

RECEIPT_LAYOUT = _rows(
    "merchant_name merchant_address currency description amount",
    "'BEST BUYS'; k || ' MAIN STREET, LAKE, CA 90001'; 'EUR'; 'APPLE PIE'; '1.00'",
    "'BEST BUYS'; k || ' MAIN STREET, LAKE, CA 90001'; 'EUR'; 'PEAR'; k || '.50'",
    "'BEST BUYS'; k || ' MAIN STREET, LAKE, CA 90001'; 'EUR'; 'MILK'; '2.25'",
    "'CORNER AND SONS'; k || ' MAIN STREET'; 'IDR'; '2 TEA POTS'; '2.00'",
    "'CORNER AND SONS'; k || ' MAIN STREET'; 'IDR'; '7 CUPS'; k || '.00'",
)

RESUME_LAYOUT = _rows(
    "name company job_title duration description",
    "'Avery Stone'; 'Firm ' || k || ' Ltd'; 'Data analyst'; '2015 - 2018'; 'Developed many reports for clients|Led weekly planning of work'",
    "'Jo Lee'; NULL; 'Shop keeper ' || k || ' - Kept the shop open all week'; NULL; 'and the books in order'",
)

FORM_MARKERS = _rows("name value source", "'total_cost'; '34'; 'marker_reversed'", "'nicotine'; '0.' || k; 'nearby_forward'", "'tar'; k || ' mg'; 'next_line'")

FORM_ROWS = _rows(
    "name value source review_required",
    "'manufacturer'; 'Kent ' || k; 'inline'; false",
    "'brand_name'; 'Kent ' || k; 'marker_row'; false",
    "'company_name'; 'MALIBU ' || k; 'marker_reversed'; false",
    "'cat_a_expenses'; '34'; 'marker_reversed'; false",
    "'cat_b_expenses'; CAST(NULL AS VARCHAR); 'missing'; false",
    "'region'; 'South'; 'inline'; false",
    "'unit_price'; k || '.50'; 'nearby_forward'; false",
    "'other'; CAST(NULL AS VARCHAR); 'missing'; false",
)

ENTITY_MAP = _rows("name email phone linkedin github website", "'Jo van Lee'; 'jo' || k || '@gmail.com'; '+92 300 12345' || k; NULL; 'github.com/jo' || k; 'www.jolee' || k || '.org'")

SECTION_TEXTS = """
WITH r AS (SELECT c_custkey AS k, c_custkey % 2 = 0 AS linked, CASE WHEN c_custkey % 3 = 0 THEN 'https://github.com/avery' || c_custkey ELSE 'no code' END AS code FROM customer)
SELECT k AS doc_id, 'profile' AS section, 'Avery ' || ['Stone', 'Field', 'Brook', 'Marsh', 'Ridge'][k % 5 + 1] || chr(10) || 'Email: avery' || k || '@mail.example.com' || chr(10) || 'Phone: +92 300 ' || lpad(CAST(k % 10000000 AS VARCHAR), 7, '0')
  || CASE WHEN linked THEN chr(10) || 'linkedin.com/in/avery-' || k || chr(10) || code ELSE '' END AS text FROM r
UNION ALL SELECT k, 'summary', CASE WHEN linked THEN '' ELSE code || chr(10) END || 'Careful worker with many years of practice' FROM r
UNION ALL SELECT k, 'certifications', 'Safety Course ' || k % 3 FROM r UNION ALL SELECT k, 'projects', 'Stock Tracker' || chr(10) || 'Records every delivery and every sale of the shop in one place.' FROM r
"""
