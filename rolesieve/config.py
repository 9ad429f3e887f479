"""Tunable settings: skills, companies, title patterns, experience band, search grid."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

# These must stay equal to the published defaults for results to agree.
SHIPPED: dict[str, Any] = {
    "fortune_500_companies": [
        "Google", "Amazon", "Microsoft", "Meta", "Apple", "Nvidia", "Tesla", "Cisco",
        "IBM", "Intel", "Oracle", "Salesforce", "ServiceNow", "Datadog", "CrowdStrike",
        "Palantir", "Stripe", "Airbnb", "Netflix", "PayPal", "Square", "Uber", "Lyft",
        "DoorDash", "Zoom", "Slack", "Snowflake", "Twilio", "Okta", "Elastic",
        "HashiCorp", "Figma", "Discord", "GitHub", "GitLab", "Databricks", "Scale AI",
        "Notion", "Canva", "Robinhood", "JPMorgan Chase", "Bank of America",
        "Goldman Sachs", "Morgan Stanley", "Visa", "Mastercard", "American Express",
        "Capital One", "Charles Schwab",
    ],
    "key_skills": [
        "python", "sql", "pyspark", "spark", "airflow", "dbt", "kafka", "aws", "gcp",
        "azure", "snowflake", "redshift", "hive", "etl", "pipeline", "pandas", "numpy",
        "docker", "kubernetes", "scala", "java", "terraform", "teradata", "hadoop",
        "looker", "tableau", "power bi", "presto", "trino", "flink", "beam", "dagster",
        "prefect", "postgresql", "mysql", "mongodb", "cassandra", "elasticsearch",
        "dynamodb", "rust", "go", "golang", "typescript", "javascript", "react", "angular",
        "pytorch", "tensorflow", "scikit-learn", "mlops", "ci/cd", "jenkins", "github actions",
    ],
    "experience_min": 2,
    "experience_max": 4,
    "keep_unknown_years": True,
    "filter_experience_band": False,
    "exclude_senior_titles": False,
    "my_skills": ["python", "sql", "snowflake", "dbt", "spark", "airflow", "aws", "etl"],
    "must_skills": ["python", "sql"],
    "nice_skills": [
        "snowflake", "dbt", "spark", "airflow", "aws", "azure", "gcp", "kafka", "docker", "etl",
    ],
    "search_terms": ["data engineer", "analytics engineer", "etl engineer"],
    "locations": ["India", "Remote"],
    "remote_locations": ["India", "Remote"],
    "title_include_patterns": [
        r"data\s*engineer",
        r"analytics\s*engineer",
        r"etl\s*(engineer|developer)",
        r"data\s*pipeline",
        r"pipeline\s*engineer",
        r"big\s*data\s*engineer",
        r"data\s*platform\s*engineer",
        r"data\s*infra(structure)?\s*engineer",
        r"data\s*warehouse\s*engineer",
        r"warehouse\s*engineer",
        r"lakehouse\s*engineer",
        r"snowflake\s*engineer",
        r"dbt\s*engineer",
        r"dataops",
        r"data\s*ops",
        r"data\s*integration\s*engineer",
        r"spark\s*engineer",
        r"cloud\s*data\s*engineer",
        r"azure\s*data\s*engineer",
        r"aws\s*data\s*engineer",
        r"gcp\s*data\s*engineer",
        r"business\s*intelligence\s*engineer",
        r"\bbi\s*engineer\b",
        r"database\s*engineer",
        r"data\s*architect",
        r"data\s*modeller",
        r"data\s*modeler",
    ],
    "title_exclude_patterns": [
        r"front[\s\-]*end",
        r"full[\s\-]*stack",
        r"fullstack",
        r"\bbackend\b",
        r"back[\s\-]*end",
        r"sales\s*engineer",
        r"data\s*analyst",
        r"data\s*scientist",
        r"data\s*science",
        r"machine\s*learning",
        r"\bml\s*engineer\b",
        r"\bai\s*engineer\b",
        r"product\s*engineer",
        r"\bmobile\b",
        r"\bios\b",
        r"\bandroid\b",
        r"\bqa\b",
        r"test\s*engineer",
        r"support\s*engineer",
        r"service\s*desk",
        r"\bdevops\b",
        r"security\s*engineer",
        r"threat\s*intelligence",
        r"transmission\s*line",
        r"scraping",
        r"labeling",
        r"labelling",
        r"intern\b",
        r"freelance",
        r"\bstaff\b",
        r"\bprincipal\b",
        r"\bdirector\b",
        r"\bvp\b",
        r"\bchief\b",
        r"\bhead\s+of\b",
    ],
    "senior_title_patterns": [
        r"\bsenior\b",
        r"\bsr\.?\b",
        r"\bstaff\b",
        r"\bprincipal\b",
        r"\blead\b",
        r"\bdirector\b",
        r"\bvp\b",
        r"\bchief\b",
        r"\bhead\s+of\b",
        r"\bmanager\b",
    ],
}

# Keys that are empty when a settings file is absent or does not name them.  The title pattern
# lists then still fall back to the shipped ones.
EMPTY_WITHOUT_FILE = ("fortune_500_companies", "key_skills")

# Country of a posting feed -> pay currency (fixed values).
CURRENCY_BY_COUNTRY = {"us": "USD", "in": "INR", "gb": "GBP", "bd": "BDT"}
DEFAULT_CURRENCY = "USD"


@dataclass(frozen=True)
class Config:
    """Settings as tuples, ready to be baked into Column expressions as literals."""

    fortune_500_companies: tuple[str, ...]
    key_skills: tuple[str, ...]
    experience_min: int
    experience_max: int
    keep_unknown_years: bool
    filter_experience_band: bool
    exclude_senior_titles: bool
    my_skills: tuple[str, ...]
    must_skills: tuple[str, ...]
    nice_skills: tuple[str, ...]
    search_terms: tuple[str, ...]
    locations: tuple[str, ...]
    remote_locations: tuple[str, ...]
    title_include_patterns: tuple[str, ...]
    title_exclude_patterns: tuple[str, ...]
    senior_title_patterns: tuple[str, ...]

    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> "Config":
        picked = {f.name: values[f.name] for f in fields(cls)}
        for name, value in picked.items():
            if isinstance(value, (list, tuple)):
                if name in ("my_skills", "must_skills", "nice_skills"):
                    value = [str(v).lower() for v in value]
                picked[name] = tuple(dict.fromkeys(value))
        for name in ("title_include_patterns", "title_exclude_patterns", "senior_title_patterns"):
            picked[name] = picked[name] or tuple(SHIPPED[name])
        return cls(**picked)


DEFAULT = Config.from_dict(SHIPPED)


def load_config(path: str | None = None, spark: SparkSession | None = None) -> Config:
    """Settings from a JSON file laid over the defaults (shallow merge).

    No path gives the shipped settings.  A missing or invalid file gives the defaults with no
    companies and no key skills.  With a session the file is read through Spark, so any
    file system the cluster knows will do.
    """
    if path is None:
        return DEFAULT
    base = {**SHIPPED, **{key: [] for key in EMPTY_WITHOUT_FILE}}
    try:
        if spark is not None:
            rows = spark.read.text(path, wholetext=True).take(1)
            text = rows[0][0] if rows else ""
        else:
            with open(path, encoding="utf-8") as handle:
                text = handle.read()
        loaded = json.loads(text)
    except (OSError, ValueError, PySparkException):
        loaded = {}
    return Config.from_dict({**base, **(loaded if isinstance(loaded, dict) else {})})


@dataclass(frozen=True)
class Profile:
    """A candidate: wanted skills and the years-of-experience band."""

    skills: tuple[str, ...] = DEFAULT.my_skills
    min_years: int = DEFAULT.experience_min
    max_years: int = DEFAULT.experience_max
