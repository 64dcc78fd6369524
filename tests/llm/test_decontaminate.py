import random

import pyarrow as pa
import pytest

from quarry.llm import decontaminate as D

pytestmark = pytest.mark.filterwarnings("ignore")


def frames(spark, texts, items):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in texts], "doc_id long, text string, n_hit string, spans int")
    return docs, spark.createDataFrame(items, "item_id long, text string")


def random_case(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "c", "Dé", "x1", "zz", "q"])
    items = [(i, " ".join(word() for _ in range(r.randint(0, 14)))) for i in range(12)] + [(99, None), (100, "?!"), (101, "Rare WORD")]
    texts = []
    for d in range(40):
        w = [word() for _ in range(r.randint(0, 60))]
        if r.random() < 0.5:
            w[len(w) // 2 : len(w) // 2] = (r.choice(items)[1] or "").split()
        texts.append((d, "".join(x + r.choice([" ", ", ", "\n", "--"]) for x in w)))
    return texts + [(50, None), (51, ""), (52, "rare-word"), (53, "a " * 5000)], items


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_equal_brute_force(spark, seed):
    texts, items = random_case(seed)
    docs, bench = frames(spark, texts, items)
    want = D.brute(dict(texts), dict(items))
    import hashlib

    got = {r["doc_id"]: (r["n_words"], r["n_hit"], hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest()) for r in D.decontaminate(docs, bench).collect()}
    assert got == want


def test_spans_are_cut_until_none_is_left(spark):
    texts, items = random_case(3)
    docs, bench = frames(spark, texts, items)
    left = D.remove_spans(docs, bench).collect()
    assert left and set(left[0].asDict()) == {"doc_id", "text", "n_hit", "spans"} and len(left) == len(texts)
    after = D.brute({r["doc_id"]: r["text"] for r in left}, dict(items))
    assert all(v[1] == 0 for v in after.values())
    before = D.brute(dict(texts), dict(items))
    assert all(r["text"] == dict(texts)[r["doc_id"]] for r in left if before[r["doc_id"]][1] == 0)


def test_empty_tables_and_bound(spark):
    docs, bench = frames(spark, [(1, "a b c")], [(1, "a b c")])
    assert D.decontaminate(docs.limit(0), bench).count() == 0
    assert D.decontaminate(docs, bench.limit(0)).first()["n_hit"] == 0
    assert D.decontaminate(docs, bench).first()["spans"][0].asDict() == {"begin": 0, "end": 5}


def test_large_benchmarks_are_searched_in_blocks(spark):
    texts, items = random_case(4)
    docs, bench = frames(spark, texts, items)
    assert len(list(D.windows_of(bench, max_benchmark_bytes=100))) > 3
    key = lambda df: sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(sorted(r["items"])), tuple(map(tuple, r["spans"]))) for r in df.collect())
    assert key(D.decontaminate(docs, bench, max_benchmark_bytes=100)) == key(D.decontaminate(docs, bench))
    left = {r["doc_id"]: r["text"] for r in D.remove_spans(docs, bench, max_benchmark_bytes=100).collect()}
    assert len(left) == len(texts) and all(v[1] == 0 for v in D.brute(left, dict(items)).values())


def test_repeated_rows_and_items(spark):
    docs, bench = frames(spark, [(1, "x a b c y"), (1, "x a b c y"), (None, "a b c"), (2, None)], [(7, "a b c"), (7, "a b c"), (8, "A, B-C"), (None, "y"), (9, None)])
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], ",".join(r["items"])) for r in D.decontaminate(docs, bench).collect())
    assert got == [("1", 5, 3, "7,8"), ("1", 5, 3, "7,8"), ("2", 0, 0, ""), ("None", 3, 3, "7,8")]


def test_index_locates_every_occurrence():
    import numpy as np

    r = random.Random(5)
    s = np.array([0] + [x for _ in range(30) for x in [*[r.randint(1, 3) for _ in range(r.randint(1, 30))], 0]])
    fm = D.FMIndex(s, 3, rate=4)
    pats = np.array([[1, 2], [2, 2], [3, 1], [1, 1]])
    low, high = fm.search(pats, np.array([2, 2, 2, 1]))
    for p, n, a, b in zip(pats, [2, 2, 2, 1], low, high, strict=True):
        want = [i for i in range(s.size - n + 1) if list(s[i : i + n]) == list(p[:n])]
        assert sorted(fm.locate(np.arange(a, b)).tolist()) == want
    assert D.scan(pa.array(["a"]), D.Windows([]))[1].tolist() == [0]
