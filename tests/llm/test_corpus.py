"""The corpus operators against plain Python on small tables with nulls, ties, repeats and odd texts."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import connect, difference
from rolesieve.llm import bytecnn, components, crosspolytope, minmax, mixing, packing, perplexity, queries, secret_scan, toolcalls, toxicity, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, base string"

#: Odd texts: null, empty, spaces, one word, repeated rows, no id, other scripts, one very long word and text.
ODD = [None, "", " \n\t ", "one", "Née à l'été  x y\n\nzwei 漢字   end ", "a" * 30_000, "la le li lo lu " * 4000]


@pytest.fixture(scope="module")
def documents(spark):
    given = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, None) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    odd = [(9000 + i, t, "en" if i % 2 else None, None if i % 3 else "s", None, "x") for i, t in enumerate(ODD)]
    odd += [odd[3], odd[6], (None, "no id here, twice", None, None, 1, None), (None, "no id here, twice", None, None, 1, None)]
    return spark.createDataFrame(given + odd, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    given = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic")
    return given.unionByName(spark.createDataFrame([(None, 1, 0), (9003, None, None), (77777, 0, 1)], given.schema))


def words(text):
    return WORD.findall(text or "")


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 900)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 500 for i in range(500, 900)}


def shingle_set(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    """Smallest id reachable over links of 85 % similarity, by comparing all pairs that share a shingle."""
    sets = {d: shingle_set(t) for d, t in texts.items()}
    holders, parent = {}, {d: d for d in sets}
    for d, own in sets.items():
        for g in own:
            holders.setdefault(g, []).append(d)
    for d, own in sets.items():
        for e, n in Counter(e for g in own for e in holders[g] if e < d).items():
            if 100 * n >= 85 * (len(own) + len(sets[e]) - n):
                a, b = find(parent, d), find(parent, e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(parent, d)) for d in sets}


def test_near_duplicates_against_all_pairs(spark, documents):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 400, 150)]
    grown = []
    for i in range(120):  # copies with none to seven changed words: some linked only through others
        w = list(base)
        for j in rng.integers(0, 150, i % 8):
            w[j] = f"x{i}y{j}"
        grown.append((20_000 + i, " ".join(w).upper() if i % 9 == 0 else " ".join(w), "en", "s", 1, None))
    docs = documents.unionByName(spark.createDataFrame(grown, DOCS))
    rows = docs.select("doc_id", "text").collect()
    want = brute_components({r.doc_id: r.text for r in rows if r.doc_id is not None})
    got = minmax.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert [(r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None] == [(1, None, True)] * 2
    kept = minmax.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None]
    assert sorted(set(ids)) == sorted(d for d, (_, c) in want.items() if c == d)


def test_near_duplicates_of_one_id_with_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(5, a), (5, b), (3, b), (9, a), (1, "alone")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in minmax.near_duplicates(docs).collect()} == {(5, 3), (3, 3), (9, 3), (1, 1)}


def test_empty_tables(spark, empty, labels):
    assert minmax.near_duplicates(empty).count() == 0 and minmax.one_of_each(empty).count() == 0
    assert secret_scan.scan(empty).count() == 0 and secret_scan.mask(empty).count() == 0
    assert packing.pack_documents(empty, queries.tokenizer()).count() == 0
    assert toxicity.judged(empty, labels).count() == 0 and bytecnn.judged(empty, labels).count() == 0
    assert mixing.mixed(empty, labels, queries.tokenizer()).count() == 0
    assert perplexity.quality(empty).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert crosspolytope.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    assert toolcalls.linked(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_encoder_gives_the_ids_of_the_tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer()
    slow, texts = Tokenizer.from_file(path), [t or "" for t in ODD] + ["x  <|endoftext|> y", "it's  we'll\n \n 12 ...  ", "a \x1c b é", " " * 999]
    assert packing.Encoder(path).encode(texts) == [np.array(slow.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_packing_is_a_round_trip(documents):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(queries.tokenizer())
    rows = packing.pack_documents(documents, queries.tokenizer(), limit=8, with_ids=True).collect()
    want = Counter()
    for r in documents.select("doc_id", "text").collect():
        ids = slow.encode(r.text or "", add_special_tokens=False).ids + [0]
        for i, (start, n) in enumerate(packing.cuts(len(ids), 2048)):
            raw = np.array(ids[start:start + n], "<u4").tobytes()
            want[r.doc_id, i, start, n, zlib.crc32(raw), raw] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        assert [o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1]]
        assert sum(n for _, n in own) <= 2048
    assert len(bins) <= 1.05 * sum(r.length for r in rows) / 2048 + 2


def test_cuts_and_best_fit():
    assert packing.cuts(2048, 2048) == [(0, 2048)] and packing.cuts(4100, 2048) == [(0, 4), (4, 2048), (2052, 2048)]
    fit = packing.BestFit(10, 2)
    assert fit.add(6, "a") == [] and fit.add(7, "b") == []
    assert fit.add(3, "c") == [[(0, "b"), (7, "c")]]  # the fullest that takes it, now full
    assert fit.add(8, "d") == [] and fit.add(9, "e") == [[(0, "d")]]  # no room and two open: the fullest closes
    assert list(fit.rest()) == [[(0, "e")], [(0, "a")]]


KINDS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16), "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}


def test_secrets_against_python(spark, documents):
    made = ["é password: 'hunter2hunter2' token=short secret = AKIA" + "B" * 16, "secret: token = abcdefgh1234 " + "0f" * 20 + "g" + "a1" * 16,
            "key Zk3x9Qp7Lm2Wn8Rt5Vy1Bc end", "copied Ab1cd2ef3gh4ij5kl6mn7 x", "copied Ab1cd2ef3gh4ij5kl6mn7 y", "API_KEY=\"abcdefgh\" apikey:zzzzzzzz" * 50]
    docs = documents.unionByName(spark.createDataFrame([(30_000 + i, t, "en", f"s{i}", 1, None) for i, t in enumerate(made)], DOCS))
    got = {(r.doc_id, i): r for i, r in enumerate(secret_scan.digest(secret_scan.scan(docs)).collect())}
    texts = {r.doc_id: r.text for r in docs.collect()}
    import hashlib

    for (doc_id, _), r in got.items():
        spans = [(m.start(), n, k, m.end()) for n, (k, (p, g, least)) in enumerate(KINDS.items()) for m in p.finditer(texts[doc_id] or "") if len(m[g]) >= least]
        line = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, _, k, _ in spans) for x in KINDS)
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))
    by_id = {d: r for (d, _), r in got.items()}
    assert by_id[30_002].spans == "owned:4:26" and by_id[30_003].spans == "" and by_id[30_003].n_copied == 1
    masked = {r.doc_id: r for r in secret_scan.mask(docs).collect()}
    assert masked[30_002].text == "key [SECRET] end" and masked[30_002].n_chars == 16 and masked[30_003].text == made[3]
    assert "hunter2" not in masked[30_000].text and masked[9004].text == ODD[4] and masked[9000].text is None
    assert secret_scan.mask(docs).columns == docs.columns and secret_scan.mask(docs).count() == docs.count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    assert difference(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name]) is None


def test_archives_hold_payloads(spark):
    tricky = "WARC/1.1\r\n\r\nx\r\n\r\n" * 20
    pages = spark.createDataFrame(
        [(3, "http://a\r\nb", tricky, 1), (1, None, tricky, 1), (1, None, tricky, 1), (2, "u", None, 1), (None, "v", tricky, 1), (4, "w", "é" * 200, 1), (5, "w", "short", 1), (6, "w", "short", 1)],
        "page_id long, url string, html string, payload int")
    rows = warc.round_trip(pages)
    got = warc.digest(rows).collect()
    assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == Counter([
        (3, 340, "revisit", 1), (1, 340, "response", None), (1, 340, "response", None), (2, 0, "response", None), (None, 340, "response", None),
        (4, 400, "response", None), (5, 5, "response", None), (6, 5, "response", None)])
    assert all(r.has_request and r.intact for r in got)
    payloads = [bytes(r.p).decode() for r in rows.select(F.col("capture.payload").alias("p")).where("p IS NOT NULL").collect()]
    assert Counter(payloads) == Counter([tricky] * 3 + ["", "é" * 200, "short", "short"])


def test_base_statistics_and_bands(documents):
    rows = perplexity.quality(documents).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in rows:
        t, w = texts[r.doc_id] or "", words(texts[r.doc_id])
        lines = [x for x in t.split("\n") if words(x)]
        windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
        n, cover = Counter(windows), set()
        for i, x in enumerate(windows):
            if n[x] > 1:
                cover.update(range(i, i + 8))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w))
        assert r.kept == (not r.base_failed and r.lower <= r.perplexity <= r.upper)


def test_kneser_ney_by_hand(spark):
    texts = ["abcabcabdabe", "abcxyz abcab", "zzabcabdq", "banana bandana abracadabra"] * 2 + ["one more abc"]
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    order = 3
    counts = Counter(tuple(([0] * (order - 1) + list(t.encode()))[i:i + order]) for t in texts for i in range(len(t)))
    tables = {order: counts}
    for n in (2, 1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])

    def discount(n):
        of = Counter(tables[n].values())
        if not (of[1] and of[2] and of[3]):
            return lambda c: 0.5
        y = of[1] / (of[1] + 2 * of[2])
        d = [max(0.05, min(k - 0.05, k - (k + 1) * y * of[k + 1] / of[k])) for k in (1, 2, 3)]
        return lambda c: d[min(c, 3) - 1]

    def probability(g):
        if not g:
            return 1 / 256
        own, d = {x: c for x, c in tables[len(g)].items() if x[:-1] == g[:-1]}, discount(len(g))
        if not own:
            return probability(g[1:])
        total = sum(own.values())
        return max(own.get(g, 0) - d(own[g]) if g in own else 0, 0) / total + sum(map(d, own.values())) / total * probability(g[1:])

    model = perplexity.fit(perplexity.count_grams(docs, order), order)
    code = lambda g: sum(x << (8 * (len(g) - 1 - i)) for i, x in enumerate(g))
    got = {(r.size, r.gram): r.p for r in model.collect()}
    for n in tables:
        assert {(n, code(g)) for g in tables[n]} == {k for k in got if k[0] == n}
        for g in tables[n]:
            assert got[n, code(g)] == pytest.approx(probability(g), rel=1e-9)
    sorted_arrays = perplexity.arrays(model)
    for g in [tuple(b"abq"), tuple(b"qqq"), tuple(b"abc"), (0, 0, 98)]:  # seen and not
        assert perplexity.log_probabilities(np.array([code(g)]), sorted_arrays, "en", order)[0] == pytest.approx(np.log(probability(g)), abs=1e-5)


def test_perplexity_of_a_model_too_large_to_send(documents):
    sent = {(r.doc_id, r.n_words): r for r in perplexity.quality(documents).collect()}
    joined = {(r.doc_id, r.n_words): r for r in perplexity.quality(documents, perplexity.Settings(broadcast_rows=0)).collect()}
    assert sent.keys() == joined.keys()
    for k, r in sent.items():
        assert (r.perplexity is None) == (joined[k].perplexity is None)
        assert r.perplexity is None or r.perplexity == pytest.approx(joined[k].perplexity, rel=1e-5)


def made_texts(n, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        sentences = [" ".join(f"w{x}" for x in rng.integers(0, 60, 8)) for _ in range(int(rng.integers(3, 12)))]
        toxic = i % 3 == 0
        if toxic:
            sentences[int(rng.integers(0, len(sentences)))] = "you utter blockhead w1 w2"
        rows.append((i, ". ".join(sentences) + ".", int(toxic)))
    return rows


def test_toxicity_finds_documents_and_sentences(spark):
    rows = made_texts(300)
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows] + [(900, None, "en"), (901, "", "de"), (None, "w1 w2", None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.judged(docs, labels).collect()}
    out = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert out and all(got[i].held_out for i in out) and not got[None].held_out
    assert all(got[i].predicted == y for i, _, y in rows if got[i].held_out)
    for i, t, y in rows:
        if y and got[i].held_out:
            assert any("blockhead" in t[s.start:s.end] for s in got[i].sentences)
    assert got[900].score == got[901].score == 0 and all(0 <= r.score <= 1 for r in got.values())
    kept = toxicity.clean_documents(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if not r.predicted}


def test_byte_network_learns_and_covers_whole_texts(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(("BAD!! " if i % 4 == 0 else "") + f"word{x}" for x in rng.integers(0, 99, 40)), int(i % 4 != 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in bytecnn.judged(docs, labels).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert held and sum(p == y for p, y in held) >= 0.95 * len(held)
    assert got[900].score == got[901].score
    s = bytecnn.Settings()
    for n in (0, 1, 15, 16, 17, 300, 5000):
        data = np.arange(n).astype(np.uint8) % 250 + 1
        seen, chunks = bytecnn.windows(data, np.array([0, n]), s)
        assert len(seen) == chunks[0] * s.per_chunk and set(data) <= set(seen.ravel())


def test_network_gradients():
    s = bytecnn.Settings(filters=4, hidden=3, per_chunk=4)
    net, data, offsets, y = bytecnn.Network(s), np.frombuffer(b"some bytes of a text that is long enough" * 4, np.uint8), np.array([0, 50, 160]), np.array([1.0, 0.0])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    loss = lambda: np.mean(np.logaddexp(0, net.forward(data, offsets) * (1 - 2 * y)))
    for k, g in net.gradients(data, offsets, y).items():
        flat, at = net.p[k].reshape(-1), int(np.abs(g).argmax())
        keep, h = flat[at], 1e-5
        flat[at] = keep + h
        up = loss()
        flat[at] = keep - h
        assert (up - loss()) / (2 * h) == pytest.approx(g.reshape(-1)[at], rel=2e-2, abs=1e-6)
        flat[at] = keep


def test_mixing_meets_targets(documents, labels):
    targets = {"en": 30_000.0, "de": 20_000.0, "fr": 20_000.0, "es": 15_000.0}
    s = mixing.Settings()
    model = mixing.learn(documents, labels, "lang", s)
    members = mixing.memberships(documents, model, queries.tokenizer(), s).cache()
    k = len(model.domains)
    steps, gap = mixing.fit(members, k, np.array([targets[d] for d in model.domains]), s)
    got = mixing._totals(members, steps, k)
    assert got == pytest.approx([targets[d] for d in model.domains], rel=1e-3)
    rows = members.collect()
    p = np.array([r.posteriors for r in rows])
    assert got == pytest.approx((mixing.rates(p, steps) * [r.tokens for r in rows]) @ p) and (mixing.rates(p, steps) >= 0).all()
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.tokenizer())
    assert sum(r.tokens for r in rows) == sum(len(own.encode(r.text or "", add_special_tokens=False).ids) for r in documents.collect())
    assert gap <= s.tolerance
    more = mixing.resampled(documents, labels, queries.tokenizer())
    assert more.columns == documents.columns
    assert {r.doc_id for r in more.select("doc_id").collect()} == {r.doc_id for r in documents.select("doc_id").collect()}


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((600, 24)).astype(np.float32)
    v[100:180] = v[100]  # a class of equal vectors
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)] + [(0, v[0].tolist())]
    odd = [(700, None), (750, [0.0] * 24), (800, [float("nan")] * 24), (850, [None] * 24), (900, [1.0]), (None, v[3].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = {}
    for r in crosspolytope.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    hits = 0
    assert set(got) == set(range(0, 600, 50))
    for q, found in got.items():
        cos = unit @ unit[q]
        cos[100:180] = cos[100]
        want = [int(j) for j in np.lexsort((np.arange(600), -cos)) if j != q][:5]
        assert [r for r, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        assert all(s == pytest.approx(cos[j], abs=1e-12) for _, j, s in found)
        hits += len(set(want) & {j for _, j, _ in found})
    assert hits >= 0.9 * 60
    assert [j for _, j, _ in sorted(got[100])] == [101, 102, 103, 104, 105]
    few = crosspolytope.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>"), F.col("vec_id") == 0)
    assert sorted((r["rank"], r.query_id) for r in few.collect()) == [(1, 0), (2, 0)]


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        (1, "a", 1, "search", '{"query":"é","limit":2}', None), (1, "b", 2, "search", '{"limit":0,"x":1}', ["a", "gone"]), (1, "c", 3, "measure", '{"n_chars":3}', ["b", "a"]),
        (1, "d", 4, "measure", "no json", ["e"]), (1, "e", 5, "measure", '{"n_chars":1}', ["d"]), (1, "f", 6, "other", "{}", []), (1, "a", 9, "search", "{}", None),
        (2, "a", 1, "measure", '{"n_chars":NaN}', None), (None, "a", 1, "measure", '{"n_chars":7}', None), (1, None, 1, "measure", "{}", None)],
        "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>")
    results = spark.createDataFrame([(1, "a", 2, "found"), (1, "a", 1, "first"), (1, "c", 8, None), (3, "z", 1, "lost"), (None, "a", 2, "ok")],
                                    "conv_id long, call_id string, turn long, content string")
    got = {(r.conv_id, r.call_id): r for r in toolcalls.link(calls, results, toolcalls.SCHEMAS).collect()}
    assert {k: (r.status, r.level) for k, r in got.items()} == {
        ("1", "a"): ("ok", 0), ("1", "b"): ("invalid arguments", 1), ("1", "c"): ("ok", 2), ("1", "d"): ("cycle", None), ("1", "e"): ("cycle", None),
        ("1", "f"): ("unknown tool", 0), ("2", "a"): ("invalid arguments", 0), ("", "a"): ("ok", 0), ("3", "z"): ("no call", None)}
    assert got["1", "a"].message == '{"call":{"arguments":{"limit":2,"query":"é"},"id":"a","name":"search"},"result":"first"}' and got["1", "a"].n_calls == 2
    assert got["1", "b"].problems == ["$.limit: minimum", "$.query: required", "$.x: unknown"]
    assert toolcalls.canonical({"b": [1.5, None], "a": {"z": "\n", "y": True}}) == '{"a":{"y":true,"z":"\\n"},"b":[1.5,null]}'
