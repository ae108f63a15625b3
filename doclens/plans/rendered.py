"""Business documents rendered from the star schema, so that what is extracted can be held against the rows it came from.

All arithmetic is on integer cents, so any engine renders the same characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VENDORS = ["Northwind Trading Company", "Blue Harbor Supplies Ltd", "Granite Peak Services", "Silver Lake Store"]
PAYMENTS = ["Cash", "Bank Transfer", "Paypal", "Credit Card"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names}


def tasks(spark: SparkSession) -> int:
    """Some tasks for each core, so that none is left with a large one at the end."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """Keys over all tasks, before anything is made of them: a small file is one task, and few bytes there are much work after. By hash, so nothing is sorted."""
    return df.repartition(tasks(df.sparkSession), df.columns[0])


def spread_wide(df: DataFrame, ways: int = 32) -> DataFrame:
    """Rows that become many more, over ``ways`` tasks for each part that is read: the tasks grow in number with the input, not in what each has to sort."""
    return df.repartition(max(tasks(df.sparkSession), ways * df.rdd.getNumPartitions()), df.columns[0])


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "customer").select("c_custkey"))


def money(cents: str) -> str:
    """SQL text of an amount of cents with two places."""
    return f"concat(cast(({cents}) div 100 as string), '.', lpad(cast(({cents}) % 100 as string), 2, '0'))"


#: Lines with their parts' names, dealt by order: the join with the orders and the groups keep that place, so that texts are made where they are read.
NAMED_LINES = "SELECT /*+ REPARTITION({}, l_orderkey) */ l_orderkey, l_quantity, l_extendedprice, p_name FROM {{lineitem}} JOIN {{part}} ON p_partkey = l_partkey"


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (the order), text."""
    return spark.sql(
        f"""
        WITH rows AS (
          SELECT l.l_orderkey AS k, o.o_custkey AS c, o.o_orderdate AS d, l.p_name AS name, cast(l.l_quantity AS bigint) AS q,
                 cast(round(l.l_extendedprice * 100) AS bigint) div cast(l.l_quantity AS bigint) AS u
          FROM ({NAMED_LINES.format(tasks(spark))}) l JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey),
        docs AS (
          SELECT k, c, d, sum(q * u) AS s,
                 array_join(sort_array(collect_list(concat(name, ' ', q, ' ', {money("u")}, ' ', {money("q * u")}))), '\\n') AS lines
          FROM rows GROUP BY k, c, d)
        SELECT k AS doc_id, concat_ws('\\n', element_at(array({", ".join(f"'{v}'" for v in VENDORS)}), cast(k % 4 AS int) + 1),
          concat(k % 90 + 10, ' Market Street'), 'TAX INVOICE', concat('Invoice No: INV-', k), concat('Invoice Date: ', date_format(d, 'dd/MM/yyyy')),
          concat('Due Date: ', date_format(date_add(d, 30), 'dd/MM/yyyy')), concat('Bill To: Buyer ', c), 'Currency: USD', 'Description Qty Unit Price Amount', lines,
          concat('Subtotal: ', {money("s")}), concat('Tax Amount: ', {money("s * 7 div 100")}), concat('Grand Total: ', {money("s + s * 7 div 100")}),
          concat('Payment Method: ', element_at(array({", ".join(f"'{v}'" for v in PAYMENTS)}), cast(k % 4 AS int) + 1))) AS text
        FROM docs""",
        **views(spark, sf_dir, "lineitem", "orders", "part"),
    )


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (the order), text: a till receipt whose prices may stand below their names."""
    return spark.sql(
        f"""
        WITH rows AS (
          SELECT l.l_orderkey AS k, o.o_orderdate AS d, upper(l.p_name) AS name, cast(round(l.l_extendedprice * 100) AS bigint) % 90000 + 100 AS a
          FROM ({NAMED_LINES.format(tasks(spark))}) l JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey),
        docs AS (
          SELECT k, d, sum(a) AS s, count(*) AS n,
                 array_join(sort_array(collect_list(concat(name, CASE WHEN k % 2 = 0 THEN ' ' ELSE '\\n' END, {money("a")}, ' X'))), '\\n') AS lines
          FROM rows GROUP BY k, d)
        SELECT k AS doc_id, concat_ws('\\n', 'CORNER MARKET', concat(k % 900 + 100, ' MAIN STREET'), '(555) 010-2345', lines,
          concat('SUBTOTAL ', {money("s")}), concat('TAX 1 7.000 % ', {money("s * 7 div 100")}), concat('TOTAL ', {money("s + s * 7 div 100")}),
          concat('CASH TEND ', {money("s + s * 7 div 100 + 500")}), concat(CASE WHEN k % 3 = 0 THEN 'CHANGE DUE\\n' ELSE 'CHANGE DUE ' END, '5.00'),
          concat('ITEMS SOLD ', n), concat('RCPT# R', lpad(cast(k AS string), 8, '0')), concat(date_format(d, 'MM/dd/yyyy'), ' 10:', lpad(cast(k % 60 AS string), 2, '0'), ':05')) AS text
        FROM docs""",
        **views(spark, sf_dir, "lineitem", "orders", "part"),
    )


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (the customer), text: labels with values beside or below them, some missing."""
    return spark.sql(
        """
        SELECT c_custkey AS doc_id, concat_ws('\n', 'APPLICATION RECORD', concat('(1) Full Name: Person ', concat(char(65 + cast(c_custkey % 26 AS int)), 'son')),
          CASE WHEN c_custkey % 3 = 0 THEN concat('Email:\nuser', c_custkey, '@mail.example.com') ELSE concat('Email: user', c_custkey, '@mail.example.com') END,
          concat('Date of Birth: ', lpad(cast(c_custkey % 28 + 1 AS string), 2, '0'), '/', lpad(cast(c_custkey % 12 + 1 AS string), 2, '0'), '/1990'),
          CASE WHEN c_custkey % 5 = 0 THEN 'Phone:' ELSE concat('Phone: 0300', lpad(cast(c_custkey % 10000000 AS string), 7, '0')) END,
          concat('Home Address: ', c_custkey % 90 + 1, ' Garden Road'), CASE WHEN c_custkey % 2 = 0 THEN 'Gender: Female' ELSE 'Gender: Male' END,
          concat('Cat A Expenses: ', c_custkey % 100 * 10), concat('Cat B Expenses: ', c_custkey % 70 * 10),
          concat('Total Expenses: ', c_custkey % 100 * 10 + c_custkey % 70 * 10 + CASE WHEN c_custkey % 7 = 0 THEN 5 ELSE 0 END)) AS text
        FROM {customer}""",
        customer=keys(spark, sf_dir),
    )


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (the customer), text: a resume with three dictionary skills picked by the key."""
    from doclens.vocabulary import SKILLS

    skills = ", ".join(f"'{s}'" for s in SKILLS)
    pick = lambda a, b: f"element_at(array({skills}), cast((c_custkey * {a} + {b}) % {len(SKILLS)} AS int) + 1)"
    return spark.sql(
        f"""
        SELECT c_custkey AS doc_id, concat_ws('\\n', concat('Avery ', element_at(array('Stone', 'Field', 'Brook', 'Marsh', 'Ridge'), cast(c_custkey % 5 AS int) + 1)),
          concat('Email: avery', c_custkey, '@mail.example.com'), concat('Phone: +92 300 ', lpad(cast(c_custkey % 10000000 AS string), 7, '0')),
          CASE WHEN c_custkey % 2 = 0 THEN concat('linkedin.com/in/avery-', c_custkey) ELSE 'no profile' END,
          CASE WHEN c_custkey % 3 = 0 THEN concat('https://github.com/avery', c_custkey) ELSE 'no code' END,
          'SUMMARY', 'Careful worker with many years of practice', 'SKILLS', {pick(1, 0)}, {pick(7, 3)}, {pick(11, 5)},
          'EDUCATION', 'Bachelor of Science in Physics', concat('Lakeside University ', c_custkey % 9), concat(1990 + c_custkey % 20, ' - ', 1994 + c_custkey % 20),
          CASE WHEN c_custkey % 4 = 0 THEN 'Master of Arts\\nHillside College\\n2015 - 2017' ELSE 'Other studies' END,
          'EXPERIENCE', 'Senior Analyst', concat('Company: Firm ', c_custkey % 50), concat(2000 + c_custkey % 10, ' - Present'), '- Built monthly reports for the team', '- Led weekly planning of work',
          'PROJECTS', 'Stock Tracker', 'Records every delivery and every sale of the shop in one place.', 'CERTIFICATIONS', concat('Safety Course ', c_custkey % 3), 'LANGUAGES',
          CASE WHEN c_custkey % 2 = 0 THEN 'English, Pashto' ELSE 'English / German' END) AS text
        FROM {{customer}}""",
        customer=keys(spark, sf_dir),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id (the part), job_description: a sentence with four dictionary skills."""
    from doclens.vocabulary import SKILLS

    skills = ", ".join(f"'{s}'" for s in SKILLS)
    pick = lambda a, b: f"element_at(array({skills}), cast((p_partkey * {a} + {b}) % {len(SKILLS)} AS int) + 1)"
    return spark.sql(
        f"SELECT p_partkey AS job_id, concat('We look for ', {pick(1, 0)}, ', ', {pick(5, 1)}, ', ', {pick(9, 2)}, ' and ', {pick(13, 4)}, ' in our team.') AS job_description FROM {{part}}",
        part=spread(table(spark, sf_dir, "part").select("p_partkey")),
    )
