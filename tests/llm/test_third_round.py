"""Hard negatives, token files and collocations: against SQL, brute force, and with odd input."""

import io
import re
import zlib

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from rolesieve.llm import collocations, seekable, segments
from rolesieve.llm.queries import tokenizer


def in_duckdb(sql, name, frame):
    con = duckdb.connect()
    con.register(name, frame.toArrow())
    return sorted(con.sql(sql).fetchall(), key=repr), con.sql(sql).columns


# --- hard negatives -----------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, score long"


def vectors(n=700, dim=9, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=dim).round(2)], int(rng.integers(0, 3)), 1) for i in range(n)]
    rows += [(i + 10_000, rows[i][1], rows[i][2], 1) for i in range(0, 400, 3)]  # equal vectors: ties
    rows += [(20_001, None, 1, 1), (20_002, [1.0] * (dim - 1) + [None], 1, 1), (20_003, [float("nan")] * dim, 1, 1),
             (20_004, [float("inf")] * dim, 2, 1), (20_005, [0.5] * dim, None, 1), (100_000, [0.0] * dim, 2, 1)]
    return rows


@pytest.mark.parametrize("settings", [segments.Settings(), segments.Settings(rows=64, anchors=3, segments=4, fan=2)])
def test_negatives_are_those_of_sql(spark, settings):
    frame = spark.createDataFrame(vectors(), VECTORS)
    found, counts = segments.mined(frame, F.col("vec_id") % 100 == 0, settings)
    want, names = in_duckdb(segments.ORACLE, "embeddings", frame)
    assert found.columns == names and sorted(map(tuple, found.collect()), key=repr) == want and want
    for row in counts.collect():
        assert 0 < row.exact <= row.pairs


def test_bounds_hold_and_drop_rows(spark):
    rng = np.random.default_rng(1)
    v = np.floor(256 * (rng.normal(size=(400, 32)) * .2 + np.repeat(rng.normal(size=(400, 4)), 8, axis=1))).astype(np.int64)
    cut = segments.edges(32, 16)
    block = segments.Block(v, *segments.summaries(v.astype(float), cut), 4)
    exact = v @ v.T
    width = np.inf
    for mean, deviation in block.levels:
        middle, off = mean @ mean.T, deviation @ deviation.T
        assert (np.abs(exact - middle) <= off + 1).all()
        assert off.mean() < width
        width = off.mean()
    ids, labels = np.arange(400), np.zeros(400, int)
    pairs = scored = 0
    for i, j, score, all_pairs, left in segments.best_of_label(block, block, (ids, ids), (labels, labels), 5):
        assert (score == exact[i, j]).all()
        pairs, scored = pairs + all_pairs, scored + left
    assert scored < pairs / 4  # where segments' means tell vectors apart, most pairs are never scored


def test_negatives_of_wide_odd_and_empty_tables(spark):
    wide = [(100, [3e5, -3e5], 1, 0), (1, [3e5, 3e5], 1, 0), (2, [3e5, -2.9e5], 2, 0), (3, [1e300, 1.0], 2, 0), (4, [1.0], 1, 0), (None, [1.0, 1.0], 1, 0), (5, [], 2, 0)]
    found, _ = segments.mined(spark.createDataFrame(wide * 2, VECTORS), F.col("vec_id") % 100 == 0)
    assert found.collect() == []  # the only positive has score 0, no negative does
    a, b = int(3e5 * 256), int(2.9e5 * 256)
    near, _ = segments.mined(spark.createDataFrame([*wide, (7, [3e5, -3e5], 0, 0)], VECTORS), F.col("vec_id") % 100 == 0)
    assert [tuple(r) for r in near.collect()] == [(100, 7, 1, 2, 2 * a * a, a * (a + b))]
    assert segments.mined(spark.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0)[0].collect() == []


# --- token files --------------------------------------------------------------------------------

DOCS = "doc_id long, text string, start long, part int, tie string"


def test_token_files_hold_every_document_in_order(spark, tmp_path):
    long_text = "the cat sat on the mat, and 12 others " * 30_000 + "x" * 3000
    rows = [(7, "héllo wörld", 0, 0, ""), (3, None, 0, 0, ""), (5, "", 0, 0, ""), (3, "b", 0, 0, ""), (-2, long_text, 0, 0, ""),
            (None, "no id", 0, 0, ""), *[(9, "same row", 0, 0, "")] * 3, (11, "<|endoftext|> it's  \n\n  x", 0, 0, "")]
    docs, path = spark.createDataFrame(rows, DOCS).repartition(3), str(tmp_path / "files")
    got = seekable.round_trip(docs, tokenizer(), path).orderBy("start").collect()
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer())
    ids = {text: np.array(own.encode(text or "", add_special_tokens=False).ids + [2], "<u4") for _, text, *_ in rows}
    assert [r.doc_id for r in got] == [None, -2, 3, 3, 5, 7, 9, 9, 9, 11]
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((d or 0, len(ids[t]), zlib.crc32(ids[t].tobytes())) for d, t, *_ in rows)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    seekable.write_index(spark, path)
    some = seekable.fetch(spark, path, spark.createDataFrame([(-2,), (9,), (404,)], "doc_id long")).collect()
    assert sorted((r.doc_id, bytes(r.ids)) for r in some) == sorted([(-2, ids[long_text].tobytes())] + [(9, ids["same row"].tobytes())] * 3)
    # Any zstandard reader sees the ids and nothing else.
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read_bytes()), read_across_frames=True).read() for f in sorted((tmp_path / "files").glob("part-*")))
    assert len(whole) == 4 * sum(r.n_tokens for r in got)
    assert seekable.round_trip(spark.createDataFrame([], DOCS), tokenizer()).collect() == []


def test_only_frames_asked_for_are_opened_and_damage_is_found():
    writer = seekable.FileWriter(0, 0, frame_bytes=400)
    docs = {i: np.full(30 + i, i, "<u4").tobytes() for i in range(40)}
    for i, ids in docs.items():
        writer.begin(i)
        writer.add(ids)
    data = bytearray(writer.finish())
    file = seekable.FileReader(bytes(data))
    at = int(file.at[20])
    assert file.tokens(at, 50) == docs[20] and file.opened <= 2
    assert [x for x in file.checked()] == [(len(d) // 4, zlib.crc32(d)) for d in docs.values()]
    broken = bytearray(data)
    broken[int(file.packed[0]) + 12] ^= 255
    other = seekable.FileReader(bytes(broken))
    assert other.tokens(at, 50) == docs[20]  # that frame is sound
    with pytest.raises((ValueError, zstandard.ZstdError)):
        other.tokens(0, 30)
    sums = bytearray(data)
    sums[len(data) - 9 - 12 * len(file.packed) + 12 + 8] ^= 1  # the first frame's checksum
    with pytest.raises(ValueError):
        seekable.FileReader(bytes(sums)).frame(0)
    with pytest.raises(ValueError):
        seekable.FileReader(bytes(data[:-1]))
    empty = seekable.FileReader(seekable.FileWriter(0, 0).finish())
    assert list(empty.checked()) == []


def test_blocks_give_the_ids_of_the_whole_text():
    from rolesieve.llm.packing import encoder

    texts = ["ab  cd\n\n ef 12 3.4 don't we'll  " * 200, "nospace" * 500, " x y z\t\t a" * 300, "日本 語 " * 300, "a b"]
    encode = encoder(tokenizer()).encode
    for text in texts:
        for size in (1, 7, 64, 1000):
            parts = list(seekable.blocks(text, size))
            assert "".join(parts) == text
            assert b"".join(encode([p])[0] for p in parts) == encode([text])[0]


# --- collocations -------------------------------------------------------------------------------

TEXTS = "doc_id long, text string, lang string, n long, rank int"


def corpus():
    rng = np.random.default_rng(3)
    words = ["der", "Hund", "a b", "x", "Yy", "été", "w" * 3000, *(f"r{i}" for i in range(300))]
    p = np.array([5.0] * 7 + [0.02] * 300)
    rows = []
    for i in range(120):
        picked = rng.choice(words, 200, p=p / p.sum())
        text = "".join(w + str(rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", ";!"])) for w in picked)
        rows.append((i, text, [None, "de", "en", ""][i % 4], 0, 0))
    rows += [(500, None, "en", 0, 0), (501, "", None, 0, 0), (502, " .\n ", "zz", 0, 0), (503, "one two", "zz", 0, 0)]
    rows += [(600, "To Be or not to be, " * 20, "en", 0, 0)] * 3
    rows += [(700, "la la la la la " * 4000 + "end", "fr", 0, 0)]
    return rows


@pytest.mark.parametrize("settings", [
    collocations.Settings(), collocations.Settings(budget=500, flush=700, block=300, slots=64), collocations.Settings(budget=20, flush=5000, block=4000, slots=8, bits=1 << 15)])
def test_collocations_are_those_of_sql(spark, settings):
    frame = spark.createDataFrame(corpus(), TEXTS).repartition(5)
    found = collocations.mined(frame, settings)
    want, names = in_duckdb(collocations.ORACLE, "documents", frame)
    assert found.columns == names and sorted(map(tuple, found.collect()), key=repr) == want
    assert {r[0] for r in want} >= {"und", "de", "en", "", "fr"}


def test_collocations_of_empty_tables(spark):
    assert collocations.mined(spark.createDataFrame([], TEXTS)).collect() == []
    assert collocations.mined(spark.createDataFrame([(1, None, None, 0, 0)], TEXTS)).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    big = 1 << 60
    phrases = spark.createDataFrame([([1, 2], big - 1), ([1, 2, 3], big - 9)], "words array<long>, n long")
    words = spark.createDataFrame([(1, big), (2, big + 5), (3, big + 7)], "key long, n long")
    got = {tuple(r.words): (r.a, r.l, r.r, r.score) for r in collocations.scored(phrases.unionByName(spark.createDataFrame([([2, 3], big - 3)], "words array<long>, n long")), words).collect()}
    assert got[(1, 2)] == (big - 1, big, big + 5, 2_000_000 * (big - 1) // (2 * big + 5))
    cuts = [(2_000_000 * (big - 9) // (x + y), k) for k, (x, y) in enumerate([(big, big - 3), (big - 1, big + 7)], 1)]
    assert got[(1, 2, 3)][3] == min(cuts)[0]


def test_long_texts_are_read_in_blocks():
    import pyarrow as pa

    text = "ab cd. ef " * 5000 + "z" * 90_000 + " gh ij"
    batch = pa.RecordBatch.from_pydict({"text": [text, "tail x"], "lang": ["en", "de"]})
    keys, sizes = [], []
    for words, row, langs, own in collocations.stretches([batch], 1000):
        sizes.append(len(words.data))
        lang = np.array([collocations._lang_key(x) for x in langs.to_pylist()], np.uint64)
        keys.extend(words.keys(lang[row])[:own].tolist())
    whole = [w for w in text.replace(".", " ").split()] + ["tail", "x"]
    assert len(keys) == len(whole) and len(set(keys)) == len(set(whole))
    assert sorted(sizes)[-2] < 95_000 and np.median(sizes) < 2000


# --- what once broke earlier operators ----------------------------------------------------------

def test_odd_arguments_of_tool_calls_are_invalid_and_stop_nothing(spark):
    import json

    from rolesieve.llm import toolcalls

    deep = "[" * 20_000 + "]" * 20_000
    odd = {"surrogate": '{"query":"\\ud800","limit":1}', "key": '{"query":"a","limit":1,"\\udfff":1}', "deep": '{"query":' + deep + ',"limit":1}',
           "nested": '{"query":' + "[" * 300 + "]" * 300 + ',"limit":1}', "bare": deep, "digits": '{"query":"a","limit":' + "9" * 9000 + "}",
           "infinite": '{"query":"a","limit":1e999}', "pair": '{"query":"\\ud83d\\ude00","limit":2}', "list": "[1]", "none": None, "text": "not json"}
    calls = spark.createDataFrame([("c", k, i, "search", v, None) for i, (k, v) in enumerate(odd.items())],
                                  "conv_id string, call_id string, turn long, name string, arguments string, needs array<string>")
    results = spark.createDataFrame([("c", k, 100, "r") for k in odd], "conv_id string, call_id string, turn long, content string")
    rows = {r.call_id: r for r in toolcalls.link(calls, results, toolcalls.SCHEMAS).collect()}
    assert {k: r.problems for k, r in rows.items() if k != "pair"} == {
        "surrogate": ["$: encoding"], "key": ["$: encoding"], "deep": ["$: depth"], "nested": ["$: depth"], "bare": ["$: depth"], "digits": ["$: JSON"],
        "infinite": ["$: number"], "list": ["$: type"], "none": ["$: type"], "text": ["$: JSON"]}
    assert {r.status for k, r in rows.items() if k != "pair"} == {"invalid arguments"} and rows["pair"].status == "ok"
    assert json.loads(rows["pair"].message)["call"]["arguments"] == {"query": "\U0001f600", "limit": 2}
    assert json.loads(rows["deep"].message)["call"]["arguments"] is None


def test_many_domains_are_mixed_with_the_rarest_as_one(spark):
    from rolesieve.llm import mixing

    rng = np.random.default_rng(2)
    rows = []
    for i in range(900):
        lang = f"l{min(99, int(rng.geometric(0.04)))}"
        letters = np.random.default_rng(int(lang[1:])).choice(list("abcdefghijklmnopqrstuvwxyz"), 5)
        rows.append((i, " ".join("".join(rng.choice(letters, 4)) for _ in range(20)), lang))
    docs = spark.createDataFrame([*rows, (5000, None, "l1"), (5001, "", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 900)], "doc_id long, quality int, toxic int")
    s = mixing.Settings(most_domains=10)
    model = mixing.learn(docs, labels, "lang", s)
    assert len(model.domains) == 10 and mixing.REST in model.domains
    assert np.exp(model.priors).sum() == pytest.approx(1)
    got = mixing.mixed(docs, labels, tokenizer(), s=s).collect()
    assert len(got) == len(rows) + 2 and {r.domain for r in got} <= set(model.domains) and len({r.gap for r in got}) == 1
    from tokenizers import Tokenizer

    own, texts = Tokenizer.from_file(tokenizer()), {r[0]: r[1] for r in rows} | {5000: "", 5001: ""}
    assert all(r.n_tokens == len(own.encode(texts[r.doc_id], add_special_tokens=False).ids) for r in got)
    assert len(mixing.learn(docs, labels, "lang").domains) == min(64, len({r[2] for r in rows}))
    few = mixing.mixed(docs, labels, tokenizer(), targets={"l1": 5000.0}, s=mixing.Settings(most_domains=10, rounds=0)).first()
    assert few.gap > s.tolerance  # not met, and said so


def test_secrets_of_long_logs_take_time_by_their_number(spark):
    import time

    from rolesieve.llm import secret_scan

    schema = "doc_id long, text string, source string, n_chars long, _spans int, _hash string"

    def log(n):
        return " ".join(f"é password={'ab' * 4}{i:06d}" for i in range(n))

    took = {}
    for n in (500, 10_000, 20_000):
        docs = spark.createDataFrame([(1, log(n), "s", 0, 5, "h")], schema)
        begin = time.time()
        row = secret_scan.digest(secret_scan.scan(docs)).first()
        took[n] = time.time() - begin
        assert row.n_assign == n and row.spans.count("assign") == n
    assert took[20_000] < 2 * took[10_000] + 2
    text = "x" * 65_530 + " password=abcdefgh12 " + "y" * 70_000 + " token: 'zzzzzzzz9'" + log(3000)
    for _ in range(2):
        row = secret_scan.mask(spark.createDataFrame([(1, text, "s", 0, 5, "h")], schema)).first()
    want = re.sub(secret_scan.BASE[0][1], lambda m: "[SECRET]" if len(m[2]) >= 8 else m[0], text)
    assert row.text == want and row.n_chars == len(want) and (row["_spans"], row["_hash"]) == (5, "h")


def test_a_token_of_many_repositories_is_a_copied_example(spark):
    from rolesieve.llm import secret_scan

    token, own = "tok_Ab3dEf6hIj9kLm2nOp5q", "own_Zy8xWv6uTs4rQp2oNm0l"
    rows = [(i, f"see {token} here {i}", "hot") for i in range(150)] + [(900, f"{own} a", "s"), (901, f"{own} b", "s")]
    got = {r.doc_id: r.spans for r in secret_scan.digest(secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert got[0] == "" and got[149] == "" and got[900] == f"owned:0:{len(own)}" and got[901] == f"owned:0:{len(own)}"
