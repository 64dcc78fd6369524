import random

import pytest

from quarry.llm import minhash_dedup as M
from quarry.llm import suffix_dedup as X


def words(r, n):
    return [r.choice("alpha beta gamma delta omega é sigma tau".split()) + str(r.randint(0, 40)) for _ in range(n)]


def near_case(seed):
    r = random.Random(seed)
    texts = []
    for _ in range(6):
        base = words(r, r.randint(40, 120))
        for _ in range(r.randint(1, 25)):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = "edit%d" % r.randint(0, 9999)
            texts.append(" ".join(copy))
    texts += ["", None, "one two", "One  TWO\n", "a b c d e", " \t"] + [" ".join(words(r, 30)) for _ in range(20)]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    texts = near_case(seed)
    df = spark.createDataFrame([(d, t, 1, "a") for d, t in texts] + [(None, "x", 1, "a")], "doc_id long, text string, n int, id string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in M.near_duplicates(df).collect()}
    assert got.pop(None) == (1, None)
    assert got == M.brute(dict(texts))
    left = M.keep_one(df)
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == sorted({c for _, c in got.values()}) and left.columns == df.columns


def test_pairs_between_80_and_85_percent_are_linked_at_80(spark):
    r = random.Random(5)
    texts = []
    for g in range(12):
        base = words(r, 104)  # 100 shingles
        copy = list(base)
        for k in range(2):
            copy[20 + 50 * k] = f"edit{g}"  # each hits 5 shingles: 90 of 110 are common
        texts += [" ".join(base), " ".join(copy)]
    texts = list(enumerate(texts))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert M.bounds(85) == (38, 400)
    for similarity, groups in ((80, 12), (85, 24)):
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in M.near_duplicates(df, similarity).collect()}
        assert got == M.brute(dict(texts), similarity) and len({c for _, c in got.values()}) == groups


@pytest.mark.parametrize("seed", [3])
def test_components_at_80_equal_brute_force(spark, seed):
    texts = near_case(seed)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in M.near_duplicates(df, 80).collect()}
    assert got == M.brute(dict(texts), 80)


def test_rows_that_repeat_an_id_lose_no_link(spark):
    r = random.Random(8)
    edit = lambda t, k: " ".join([*t.split()[:k], "edited", *t.split()[k + 1 :]])
    p, q, z = (" ".join(words(r, 90)) for _ in range(3))
    rows = [(5, p), (5, q), (7, edit(p, 3)), (8, edit(q, 4)), (3, edit(p, 80)), (9, z), (9, z), (9, ""), (4, None), (4, edit(z, 5)), (11, " ".join(words(r, 60)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(x["doc_id"], x["n_shingles"] > 0): x["component_id"] for x in M.near_duplicates(df).collect()}
    assert {d for (d, _), c in got.items() if c == 3} == {3, 5, 7, 8}
    assert {d for (d, _), c in got.items() if c == 4} == {4, 9} and got[9, False] == got[4, False] == 4 and got[11, True] == 11
    assert sorted(x["doc_id"] for x in M.keep_one(df).collect()) == [3, 4, 4, 11]


def test_copies_under_the_threshold_are_skipped(spark):
    """1,200 near copies of one text, nearly all pairs just under 85 percent: the pairs made grow no faster than the group's links."""
    r = random.Random(9)
    base = words(r, 204)
    texts = []
    for _ in range(1200):
        copy = list(base)
        for k in range(r.randint(2, 5)):
            copy[r.randrange(40 * k, 40 * k + 40)] = "edit%d" % r.randint(0, 10**9)
        texts.append(" ".join(copy))
    met, plain = {}, M.cross_links
    for n in (600, 1200):
        counts = {}
        M.cross_links = lambda rest, full, s=85, c=counts: plain(rest, full, s, c)
        try:
            df = spark.createDataFrame(list(enumerate(texts[:n])), "doc_id long, text string").repartition(4)
            got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in M.near_duplicates(df).collect()}
        finally:
            M.cross_links = plain
        met[n] = counts["pairs"]
        assert got == M.brute(dict(enumerate(texts[:n])))
        assert met[n] < 3 * n, met  # of n * n / 2


def test_very_long_near_copies(spark):
    r = random.Random(11)
    long = words(r, 30_000)
    other = list(long)
    other[5000] = "edit"
    df = spark.createDataFrame([(2, " ".join(long)), (1, " ".join(other)), (3, " ".join(words(r, 30_000)))], "doc_id long, text string")
    assert {x["doc_id"]: x["component_id"] for x in M.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert M.near_duplicates(df).count() == 0
    assert M.near_duplicates(spark.createDataFrame([(1, "a b"), (1, "a b")], df.schema)).count() == 2


def repeat_case(seed):
    r = random.Random(seed)
    block = lambda n: "".join(r.choice("ab cdé\n") for _ in range(n))
    shared = [block(r.choice([49, 50, 51, 90, 300])) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [r.choice(shared) if r.random() < 0.5 else block(r.randint(0, 120)) for _ in range(r.randint(0, 6))]
        texts.append("".join(parts))
    return list(enumerate(texts + [texts[3], None, "a" * 400, "a" * 60 + "b"]))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_removed_bytes_equal_brute_force(spark, seed):
    texts = repeat_case(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in texts] + [(None, texts[3][1], "y")], "doc_id long, text string, shard string").repartition(4)
    import hashlib

    got = {}
    for r in X.remove_repeats(df).collect():
        n = sum(s["end"] - s["begin"] for s in r["spans"])
        got[r["doc_id"]] = (r["n_bytes"], n, len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest())
    assert got.pop(None)[1] == 0
    assert got == X.brute(dict(texts))


def test_suffix_order():
    import numpy as np

    r = np.random.default_rng(0)
    data = r.integers(97, 99, 4000).astype(np.uint8)
    data[2000:4000] = data[:2000]
    data[2100::131] = 120
    at = np.arange(data.size - 50)
    order, cls = X.deep_shallow(data, at)
    rows = [data[p : p + 50].tobytes() for p in at]
    assert order.tolist() == sorted(range(len(rows)), key=lambda i: (rows[i], i)) and cls[-1] + 1 == len(set(rows))
    strings = [bytes(r.integers(0, 3, 12).astype(np.uint8)) for _ in range(200)]
    strings += strings[:50]
    leaves = X.BlindTrie(strings).leaves()
    assert [strings[leaf[0]] for leaf in leaves] == sorted(set(strings))
    assert all(leaf == [k for k, s in enumerate(strings) if s == strings[leaf[0]]] for leaf in leaves)


def test_classes_come_from_the_tries(monkeypatch):
    import numpy as np

    data = np.frombuffer(b"x" * 24 + b"a" * 26 + b"x" * 24 + b"b" * 26 + b"x" * 24 + b"a" * 26, np.uint8)
    at = np.array([0, 50, 100])
    assert X.deep_shallow(data, at)[1].tolist() == [0, 0, 1]
    monkeypatch.setattr(X.BlindTrie, "insert", lambda self, k, s: setattr(self, "root", [0, {**(self.root[1] if self.root else {}), k: (s, [k])}, None]))
    assert X.deep_shallow(data, at)[1].tolist() == [0, 1, 2]


def test_contexts_of_one_hash_are_compared():
    import numpy as np

    data = np.frombuffer(b"abcdabceabcdab", np.uint8)
    begin, size = np.array([0, 4, 8, 12]), np.array([4, 4, 4, 2])
    cls = X.equal_contexts(data, begin, size, np.zeros(4, np.uint64))
    assert cls[0] == cls[2] and len(set(cls.tolist())) == 3


def test_rows_that_repeat_an_id_are_cut_by_their_own_spans(spark):
    a, b = "abcdefghij" * 8, "".join(random.Random(1).choice("klmnop") for _ in range(90))
    rows = [(1, a), (2, a), (2, b), (2, a + b), (2, a), (3, b)]
    got = sorted((x["doc_id"], bytes(x["kept"]).decode()) for x in X.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == sorted([(1, a), (2, ""), (2, b), (2, b), (2, ""), (3, "")])


def test_very_long_repeats(spark):
    import hashlib

    r = random.Random(4)
    one, two = ("".join(r.choice("abcdefgh ") for _ in range(300_000)) for _ in range(2))
    texts = {1: one, 2: two[:1000] + one[100_000:200_000] + two[1000:], 3: two}
    got = {x["doc_id"]: (x["n_bytes"], sum(s["end"] - s["begin"] for s in x["spans"]), len(x["spans"]), hashlib.sha256(bytes(x["kept"])).hexdigest()) for x in X.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == X.brute(texts)


def test_repeats_in_nothing(spark):
    assert X.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert X.remove_repeats(spark.createDataFrame([(1, "short")], "doc_id long, text string")).first()["spans"] == []


def test_signatures_and_postings_are_moved_once(spark, monkeypatch):
    r = random.Random(21)
    texts = [" ".join(words(r, 40)) for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(texts * 4)), "doc_id long, text string").repartition(3)
    plain, signed, shuffles = M.C.cut, [], []

    def cut(x):
        shuffles.append(x._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(token"))
        out = plain(x)
        if "tokens" in x.columns:
            signed.append(out.count())
        return out

    monkeypatch.setattr(M.C, "cut", cut)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in M.near_duplicates(df).collect()}
    assert got == M.brute(dict(enumerate(texts * 4)))
    assert signed == [6]  # one row a class, none for its copies
    assert sum(shuffles) == 4  # all postings, the lists left of them, and twice those of several components
