import random
from urllib.parse import quote_plus

from rolesieve.functions.urls import TRACKING_KEYS, canonical_url
from pyspark.sql import functions as F

CASES = [
    (None, ""), ("", ""), ("   ", ""),
    ("https://www.linkedin.com/jobs/view/123/?utm_source=x&utm_medium=y&refId=abc", "https://www.linkedin.com/jobs/view/123"),
    ("HTTPS://Example.COM/Path/", "https://example.com/Path"),
    ("https://example.com", "https://example.com/"),
    ("https://example.com///", "https://example.com/"),
    ("https://example.com/a;v=1?x=1#top", "https://example.com/a?x=1"),
    ("https://example.com/a;v=1/b", "https://example.com/a;v=1/b"),
    ("https://example.com/?UTM_Anything=1&b=&a=1", "https://example.com/?b=&a=1"),
    ("https://example.com/?REF=1&ref=2", "https://example.com/?REF=1"),
    ("https://example.com/?q=a+b%20c&&t=~*", "https://example.com/?q=a+b+c&t=~%2A"),
    ("https://example.com/?q=%zz&r=1=2", "https://example.com/?q=%25zz&r=1%3D2"),
    ("https://example.com/?flag", "https://example.com/?flag="),
    ("not-a-url", "not-a-url"), ("//Host/x/", "//host/x"), ("mailto:a@b", "mailto:a@b"),
    ("  https://example.com/x\n", "https://example.com/x"),
    ("http://[broken/x/", "http://[broken/x/"),
    ("https:///x/", "https:///x"),
    ("https://example.com/?q=é", "https://example.com/?q=%C3%A9"),
]


def _canonical(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "id int, u string")
    return [r.c for r in df.select("id", canonical_url(F.col("u")).alias("c")).orderBy("id").collect()]


def test_literal_cases(spark):
    assert _canonical(spark, [c[0] for c in CASES]) == [c[1] for c in CASES]


def test_random_urls_built_from_known_parts(spark):
    rng = random.Random(3)
    alphabet = ["a", "B", "7", " ", "&", "=", "%", "+", "~", "*", "é", "/", "?", "#", ";", "-"]
    raw, expected = [], []
    for _ in range(1500):
        scheme, host = rng.choice(["http", "HTTPS"]), rng.choice(["Jobs.Example.com", "x.org:8080", "user@Host"])
        path = rng.choice(["", "/", "/View/12", "/view/12//", "/a%20b"])
        pairs = [
            (rng.choice([*TRACKING_KEYS, "utm_zz", "UTM_Q", "Ref", "page", "q ü", "k"]), "".join(rng.choices(alphabet, k=rng.randint(0, 5))))
            for _ in range(rng.randint(0, 4))
        ]
        query = "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in pairs)
        fragment = rng.choice(["", "#top", "#a?b=1"])
        raw.append(f"{scheme}://{host}{path}{'?' + query if query else ''}{fragment}")
        kept = [(k, v) for k, v in pairs if k not in TRACKING_KEYS and k[:4].lower() != "utm_"]
        tail = "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in kept)
        clean_path = path.rstrip("/") if path.rstrip("/") else "/"
        expected.append(f"{scheme.lower()}://{host.lower()}{clean_path}{'?' + tail if tail else ''}")
    got = _canonical(spark, raw)
    assert [(r, g, e) for r, g, e in zip(raw, got, expected) if g != e][:3] == []
    assert _canonical(spark, got) == got  # canonical stays canonical
