"""The postings view derived from ``orders``: one SQL text for Spark and for the SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TITLES = (
    "Data Engineer", "Senior Data Engineer", "Analytics Engineer", "ETL Developer", "Backend Engineer",
    "Data Analyst", "Staff Data Engineer", "Lead Snowflake Engineer", "Data Architect", "Sr. Data Engineer",
    "Software Engineer", "Data Platform Engineer", "Data Engineering Manager", None,
)
COMPANIES = (
    "Acme Inc.", "acme inc", "Amazon Web Services", "Metadata Systems", "Unknown", None, "Snowflake",
    "Beta-Corp", "JPMORGAN CHASE & Co",
)
SKILL_TEXTS = (
    "python sql snowflake dbt spark airflow aws",
    "java only, javascript react golang",
    "python, SQL; ci/cd with github actions and power bi; bachelor degree",
    "kafka docker azure gcp terraform scala; MS or PhD",
    "Python ETL pipeline, thresholds; B.Sc",
    "",
)
YEAR_TEXTS = (
    "3-5 years of experience", "5+ years", "minimum 3 years", "at least 2 years of experience",
    "99 years of experience", "company founded 10 years ago", "3-5+ years", "12+ years leading teams",
    "0-1 years", "5 years, or 2 years", "",
)
HOSTS = {0: "https://Jobs.Example.com/view/", 3: "HTTPS://jobs.example.com/view/"}
OTHER_HOST = "https://jobs.example.com/view/"
SUFFIXES = ("?utm_source=feed&utm_medium=x", "/", "?refId=a&page=2", "#apply", "?UTM_Id=7&q=")


def _case(key: str, values) -> str:
    whens = " ".join(
        f"WHEN {i} THEN {'NULL' if v is None else chr(39) + v + chr(39)}" for i, v in enumerate(values)
    )
    return f"CASE {key} {whens} END"


def _text(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR(20))"


def postings_sql(orders: str = "orders") -> str:
    """SELECT giving the postings view over an orders table."""
    third = _text("CAST(floor(k / 3) AS BIGINT)")
    host = f"CASE k % 5 WHEN 0 THEN '{HOSTS[0]}' WHEN 3 THEN '{HOSTS[3]}' ELSE '{OTHER_HOST}' END"
    return f"""
SELECT k AS seq,
       CASE WHEN k % 35 = 4 THEN NULL WHEN k % 35 = 9 THEN 'not-a-url'
            ELSE concat({host}, {third}, {_case('k % 5', SUFFIXES)}) END AS job_url,
       {_case('k % 14', TITLES)} AS title,
       {_case('c % 9', COMPANIES)} AS company,
       CASE k % 4 WHEN 0 THEN concat('City ', {_text('c % 40')}, ', India')
                  WHEN 1 THEN concat('city ', {_text('c % 40')}, ' india')
                  WHEN 2 THEN 'Remote' END AS location,
       {_text('CAST(d AS DATE)')} AS date_posted,
       concat({_case('c % 6', SKILL_TEXTS)}, '. ', {_case('k % 11', YEAR_TEXTS)}) AS description,
       CASE k % 4 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'indeed' WHEN 2 THEN 'remotive' END AS site,
       {_case('k % 3', ('data engineer', 'analytics engineer', 'etl engineer'))} AS source_query,
       CASE c % 4 WHEN 0 THEN 'India' WHEN 1 THEN 'Remote' WHEN 2 THEN 'United States' END AS source_location,
       (k % 2 = 0) AS is_remote,
       CASE k % 5 WHEN 0 THEN 'full_time' WHEN 1 THEN 'contract' WHEN 3 THEN 'part_time' WHEN 4 THEN 'full_time' END AS job_type,
       k % 3 AS batch_id
FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d FROM {orders}) src"""


# Rows of a task: a row's text is scanned many times over, while its numbers are a few bytes of a file.
TASK_ROWS = 100_000
# The same for whole documents, which are some thousand characters each.
TASK_TEXTS = 2_000


def spread(df: DataFrame, task_rows: int = TASK_ROWS, rows: int | None = None) -> DataFrame:
    """Rows dealt evenly, over all cores and at most about ``task_rows`` a task.

    The text scans that follow are CPU-bound.  Splits of files follow bytes, and those of Parquet cannot
    cut a row group: some hold millions of rows and others none.  The rows are counted from the footers;
    ``rows`` says how many there are about where counting would take a run.
    """
    rows = df.count() if rows is None else rows
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // task_rows))
    # inline() keeps filters of the derived columns from moving before the repartition.
    return df.repartition(parts).select(F.inline(F.array(F.struct(*df.columns))))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))
    return spark.sql(postings_sql("{orders}"), orders=orders)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
