"""Text functions over Arrow batches hold a few texts as objects at a time."""

import pyarrow as pa
import pytest

from ferrule.functions import text as X

WORDS = [["running", "cats"], None, [], ["sky", "relational", "running"]]


@pytest.mark.parametrize("rows", [0, 3, 2 * X.HELD + 5])
def test_pieces_are_the_whole(rows):
    texts = [None if i % 7 == 0 else f"ﬁne STRAẞE {i} k 2" for i in range(rows)]
    sizes = []

    def seen(few):
        sizes.append(len(few))
        return few

    assert X._few_at_once(pa.array(texts, pa.string()), seen, pa.string()).to_pylist() == texts
    assert max(sizes, default=0) <= X.HELD and sum(sizes) == rows
    lists = [WORDS[i % 4] for i in range(rows)]
    assert X.stems_of(pa.array(lists, pa.list_(pa.string())).slice(1)).to_pylist() == [None if ws is None else [X.stem(w) for w in ws] for ws in lists[1:]]


def test_columns(spark):
    rows = [(i, None if i % 7 == 0 else f"ﬁne STRAẞE {i} k 2", WORDS[i % 4]) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, t string, w array<string>").coalesce(1)
    got = df.select("i", X.nfkc("t").alias("n"), X.casefold(X.nfkc("t")).alias("c"), X.fts_normal("t").alias("f"), X.stems("w").alias("s")).orderBy("i").collect()
    for r, (i, t, w) in zip(got, rows, strict=True):
        assert (r.n, r.c) == ((None, None) if t is None else (f"fine STRAẞE {i} k 2", f"fine strasse {i} k 2"))
        assert r.f == X.fts_normal_of(t) and r.s == (None if w is None else [X.stem(x) for x in w])
