from collections import Counter

import pytest
from pyspark.sql import functions as F

from rolesieve.operators import bitmaps

SCHEMA = "seq long, site string, place string, flag boolean"
ROWS = [(i * 7919 % 100_003, [" a ", "b", "c", None, " "][i % 5], ["x", "y", None][i % 3], i % 2 == 0) for i in range(600)]


def _facets():
    return bitmaps.text_facets(("site", "place")) | {"flag": F.col("flag")}


def _value(row, facet):
    v = {"site": row[1], "place": row[2], "flag": None if row[3] is None else str(row[3]).lower()}[facet]
    return v.strip() or None if v else None


def _expected(chosen, own):
    out = Counter()
    for facet in ("site", "place", "flag"):
        for row in ROWS:
            if (v := _value(row, facet)) is not None:
                out[facet, v] += all(_value(row, f) in vs for f, vs in chosen.items() if own or f != facet)
    return out


@pytest.mark.parametrize("chosen", [{}, {"site": ["a"]}, {"site": ["a", "b"], "place": ["x"]}, {"flag": ["true"], "site": ["c"], "place": ["y"]},
                                    {"site": ["none such"]}, {"site": []}])
@pytest.mark.parametrize("own", [False, True])
def test_counts_under_filters(spark, chosen, own):
    idx = bitmaps.index(spark.createDataFrame(ROWS, SCHEMA), _facets())
    assert {(r.facet, r.value): r.n for r in bitmaps.counts(idx, chosen, own).collect()} == _expected(chosen, own)
    shown = sum(all(_value(r, f) in vs for f, vs in chosen.items()) for r in ROWS)
    assert tuple(bitmaps.visible_count(idx, chosen).first()) == (shown, len(ROWS))


def test_indexes_of_batches_merge(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    parts = [bitmaps.index(df.where(F.col("seq") % 3 == i), _facets()) for i in range(3)]
    one = bitmaps.index(df, _facets())
    assert bitmaps.merged(*parts, parts[0]).exceptAll(one).count() == 0


def test_empty_index(spark):
    idx = bitmaps.index(spark.createDataFrame([], SCHEMA), _facets())
    assert bitmaps.counts(idx, {"site": ["a"]}).count() == 0
    assert tuple(bitmaps.visible_count(idx, {}).first()) == (0, 0)
