import random
import re

from pyspark.sql import functions as F

from rolesieve.config import DEFAULT
from rolesieve.functions.skills import SkillFinder, in_list_order, matched_skills, mentions
from rolesieve.operators.counts import dictionary_doc_freq, skill_doc_freq

TRICKY = ("spark", "spark sql", "sql", "c++", ".net", "ci/cd", "go", "golang", "Power BI", "bi tool", "r", "scikit-learn", "a b", "b c")


def _whole_word(text, skill):
    return re.search(rf"\b{re.escape(skill)}\b", text, re.I) is not None


def _texts(n):
    rng = random.Random(11)
    words = ["spark", "sql", "SQL", "c++", "c++x", ".net", "x.net", "ci/cd", "go", "golang", "power", "bi", "tool", "R", "scikit-learn",
             "a", "b", "c", "pyspark", "é", "_go", "go_", "²", "Kafka"]
    return ["".join(rng.choice(words) + rng.choice([" ", "", ", ", "\n", "-"]) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_one_pass_finds_what_single_searches_find(spark):
    texts = _texts(2000)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = df.select("id", matched_skills(F.col("t"), TRICKY).alias("m")).orderBy("id").collect()
    wrong = [(t, r.m, [s for s in TRICKY if _whole_word(t, s)]) for t, r in zip(texts, got) if r.m != [s for s in TRICKY if _whole_word(t, s)]]
    assert not wrong, wrong[:3]


def test_skills_across_the_joint_of_two_texts(spark):
    pairs = [("power", "bi now"), ("xpower", "bi"), ("use Power", "BI tool"), ("a", "b c"), ("", "go"), ("ends in spark", "sqlx")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, l string, r string")
    finder = SkillFinder(TRICKY)
    joined = F.concat(finder.found(F.col("l")), finder.found(F.col("r")), finder.found_across(F.col("l"), F.col("r")))
    got = df.select("id", in_list_order(joined, TRICKY).alias("m")).orderBy("id").collect()
    assert [r.m for r in got] == [[s for s in TRICKY if _whole_word(f"{l} {r}", s)] for l, r in pairs]


def test_mentions_and_doc_freq(spark):
    df = spark.createDataFrame([("Python dev", "sql, python"), ("x", "pysql")], "title string, description string")
    assert [r.m for r in df.select(mentions(F.col("description"), "sql").alias("m")).collect()] == [True, False]
    assert {r.skill: r.n for r in skill_doc_freq(df, DEFAULT.key_skills).collect()} == {"python": 1, "sql": 1}


def test_dictionary_of_phrases(spark):
    texts = ["power bi and ci/cd", "Power  BI", "power bi power bi", "scikit-learn go", "golang"]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    entries = ["power bi", "ci/cd", "scikit-learn", "go"]
    dictionary = spark.createDataFrame([(e,) for e in entries], "skill string")
    got = {r.skill: r.n for r in dictionary_doc_freq(docs, dictionary, F.col("t")).collect()}
    assert got == {e: sum(_whole_word(t, e) for t in texts) for e in entries}


def test_dictionary_entries_of_any_signs(spark):
    entries = ["c++", "C#", ".NET", "c", "node.js", "++", "r&d", "a.b", "été", "ci/cd", "c++ and c", "", "x" * 500, "C++"]
    texts = ["C++11 and c#7", "c++ here", "asp.net core, .net core", "use Node.js", "node.jsx", "a++b", "R&D dept", "xa.b", "a.b.", "(été)", "étés",
             "CI/CD; c", None, "", "c++ and c", "z c++ and c", "q" + "x" * 500, "x" * 500, "C"]
    docs = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    dictionary = spark.createDataFrame([(e,) for e in entries], "skill string")
    want = {e: sum(bool(re.search(rf"\b{re.escape(e)}\b", t or "", re.I)) for t in texts) for e in entries if e}
    for shard in (5, 10_000):
        got = {r.skill: r.n for r in dictionary_doc_freq(docs, dictionary, F.col("t"), shard_chars=shard).collect()}
        assert got == {e: n for e, n in want.items() if n}
    assert dictionary_doc_freq(docs, dictionary.where("false"), F.col("t")).collect() == []
    plan = dictionary_doc_freq(docs, dictionary, F.col("t"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # one pass over the texts
