"""Where an operator once did less than the whole job."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rolesieve.llm import minmax, secret_scan, toolcalls, toxicity
from rolesieve.llm.labelled import sample
from test_corpus import DOCS, find, made_texts, shingle_set

SF = "/root/testdata/sf0.001"


def similar_components(texts, percent):
    """Smallest id reachable over links of ``percent`` % similarity, by comparing all pairs."""
    sets, parent = {d: shingle_set(t) for d, t in texts.items()}, {d: d for d in texts}
    for d, own in sets.items():
        for e, other in sets.items():
            shared = len(own & other)
            if e < d and shared and 100 * shared >= percent * (len(own) + len(other) - shared):
                a, b = find(parent, d), find(parent, e)
                parent[max(a, b)] = min(a, b)
    return {d: find(parent, d) for d in texts}


def test_the_near_dedup_stage_links_from_four_fifths(spark):
    texts = {}
    for i in range(60):  # pairs: 100 words, the second with its last 9 to 11 replaced, so 0.79 to 0.83
        base = [f"w{i}x{j}" for j in range(100)]
        changed = base[: 100 - (9 + i % 3)] + [f"y{i}x{j}" for j in range(9 + i % 3)]
        texts[2 * i], texts[2 * i + 1] = " ".join(base), " ".join(changed)
    docs = spark.createDataFrame([(d, t, "en", "s", 1, None) for d, t in texts.items()], DOCS)
    want, strict = similar_components(texts, 80), similar_components(texts, 85)
    assert len(set(want.values())) == 80 and len(set(strict.values())) == 120
    kept = corpus_pipeline.without_near_copies(spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == set(want.values())
    assert {r.component_id for r in minmax.near_duplicates(docs).collect()} == set(strict.values())


def test_length_alone_makes_no_text_toxic(spark):
    rows = made_texts(300)
    rng = np.random.default_rng(5)
    prose = ". ".join(" ".join(f"w{x}" for x in rng.integers(0, 60, 8)) for _ in range(120_000))
    assert len(prose) > 3_000_000
    long = {900: "zyxq 17\n" * 20_000, 901: prose, 902: prose + ". you utter blockhead w1 w2"}
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + list(long.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.judged(docs, labels).collect()}
    assert {d: got[d] for d in long} == {900: 0, 901: 0, 902: 1}
    assert {900, 901} <= {r.doc_id for r in toxicity.clean_documents(docs, labels).select("doc_id").collect()}
    # Thousands of sentences of a little evidence each are no toxic text; two of much evidence add up.
    s = toxicity.Settings()
    weights = np.zeros(s.features, np.float32)
    weights[toxicity.features("hm", s.features)] = 6.0
    weights[toxicity.features("ow", s.features)] = 9.5
    judge = toxicity.Judge(toxicity.Model(weights, 7.0), s)
    assert judge.document("hm\n" * 50_000)[0] == 0 == judge.document("none " * 9)[0]
    assert judge.document("ow. ow")[0] == pytest.approx(1 - (1 - judge.document("ow")[0]) ** 2)
    # A document by hand: sentences of all strengths add up by one formula, without a jump.
    none = 1 / (1 + np.exp(-s.leak))
    for text in ("ow. hm hm. ow hm", "hm. ow. ow. hm ow. ow. none", "", "ow " * 3):
        clean = 1.0
        for sentence in filter(str.strip, text.split(".")):
            e = 6.0 * sentence.split().count("hm") + 9.5 * sentence.split().count("ow")
            clean *= (1 - 1 / (1 + np.exp(-min(30, s.leak + max(0, e - 7) * s.leak / (s.leak + 7))))) / (1 - none)
        assert judge.document(text)[0] == pytest.approx(1 - clean, abs=1e-9)


def test_training_passes_over_longer_texts_and_uses_the_margin():
    rows = [(t, y) for _, t, y in made_texts(300)]
    s = toxicity.Settings()
    model = toxicity.train(rows, s)
    assert 0 < model.margin < -s.leak
    judge = toxicity.Judge(model, s)
    # All clean training texts read as one stay clean.
    assert judge.document("\n".join(t for t, y in rows if not y))[0] <= s.long_clean + 0.01
    assert all((judge.document(t)[0] >= s.threshold) == bool(y) for t, y in rows)


def test_sample_fills_up_behind_longer_texts(spark):
    docs = spark.createDataFrame([(i, "x" * (50 if i % 10 else 5)) for i in range(200)] + [(10, "aaaaa")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, toxic int")
    got = sample(docs, labels, "toxic", F.lit(False), {1: 15, 0: 3}, 10)
    assert len(got) == 15 and all(len(t) == 5 and y == 1 for t, y in got)


def test_masking_counts_texts_as_well_as_owners(spark):
    example, copied, own = "Ab1cd2ef3gh4ij5kl6mn7", "Zk3x9Qp7Lm2Wn8Rt5Vy1Bc", "Qq8ww7ee6rr5tt4yy3uu2"
    rows = [(i, f"sample {example} of text {i}", "hot") for i in range(3000)]
    rows += [(5000, f"key {copied} end", "s1"), (5001, f"key {copied} end", "s2")]
    rows += [(6000 + i, f"mine {own} of {i}", "s3") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = {r.doc_id: r.text for r in secret_scan.mask(docs).collect()}
    assert all(got[i] == t for i, t, s in rows if s == "hot")
    assert got[5000] == got[5001] == "key [SECRET] end" and got[6000] == "mine [SECRET] of 0" and len(got) == len(rows)


def test_conversations_that_begin_with_a_system_turn_are_linked(spark):
    said = {1: "suauauaua", 2: "uauaua", 3: "suuaauu", 4: "ua" * 700, None: "su"}
    role = {"s": "system", "u": "user", "a": "assistant"}
    rows = [(c, i, role[r], f"text {i} of é {c} and more") for c, own in said.items() for i, r in enumerate(own)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = toolcalls.linked(docs).collect()
    told = [r for r in got if r.kind == "turn"]
    assert sorted((r.conv_id, r.turn, r.status) for r in told) == sorted((str(c or ""), i, x) for c, i, x, _ in rows)
    texts = {(str(c or ""), i): (x, t) for c, i, x, t in rows}
    for r in told:
        x, t = texts[r.conv_id, r.turn]
        assert r.message == toolcalls.canonical({"role": x, "content": t, "call": r.call_id})
    calls = {(r.conv_id, r.call_id): r for r in got if r.kind == "call"}
    assert len(calls) == sum(x == "assistant" for _, _, x, _ in rows) and all(r.status != "no call" for r in calls.values())
    for c, own in said.items():  # brute force: numbers, results, levels, positions
        at = [i for i, r in enumerate(own) if r == "a"]
        level = {}
        for k, i in enumerate(at, 1):
            level[k] = 0 if k == 1 else level[(k + 1) // 2] + 1
            r = calls[str(c or ""), f"call-{k}"]
            end = at[k] if k < len(at) else len(own)
            answer = next((j for j in range(i + 1, end) if own[j] == "u"), None)
            assert (r.turn, r.level, r.n_results) == (i, level[k], None if answer is None else 1)
            assert json.loads(r.message)["result"] == (None if answer is None else texts[str(c), answer][1])
            assert r.name == ("search" if k % 2 else "other" if k % 8 == 0 else "measure")
        order = sorted(level, key=lambda k: (level[k], at[k - 1]))
        assert [calls[str(c or ""), f"call-{k}"].position for k in order] == list(range(1, len(order) + 1))
    assert calls["1", "call-3"].status == "ok" and json.loads(calls["1", "call-3"].message)["call"]["arguments"]["after"] == "call-2"
