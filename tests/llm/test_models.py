"""Quality classifier, toxicity, language identification: held-out accuracy and defined cases."""

import math
import random

import numpy as np
import pytest

from quarry.llm import common, language_id, quality_classifier, toxicity
from quarry.llm import text_features as T

WORDS = "the of and to in is was for that with from this are have not".split()


def corpus(n, seed=0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = [r.choice(WORDS) + r.choice(["", "ing", "er"]) for _ in range(r.randint(5, 80))]
        good, toxic = r.random() < 0.6, r.random() < 0.3
        if not good:
            words = [w + "***" for w in words] if i % 2 else [w.upper() + "!!" for w in words]
        if toxic:
            words.insert(len(words) // 2, r.choice(["scum", "idiot", "trash"]))
        out.append((i, " ".join(words), int(good), int(toxic)))
    return out


def write(spark, path, rows):
    spark.createDataFrame([(i, t, "en", "s") for i, t, _, _ in rows] + [(-1, None, "en", "s"), (-2, "", None, None)], "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, q, x) for i, _, q, x in rows] + [(None, 1, 1), (10**9, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_quality_and_toxicity_on_held_out_rows(spark, tmp_path):
    rows = corpus(600)
    write(spark, tmp_path, rows)
    truth = {i: (q, x) for i, _, q, x in rows}
    got = quality_classifier.op2_quality_classifier(spark, str(tmp_path)).collect()
    assert len(got) == 602 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]][0] for r in held) > 0.95 * len(held) > 60
    got = toxicity.op3_toxicity(spark, str(tmp_path)).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["toxic"] == bool(truth[r["doc_id"]][1]) for r in held) > 0.95 * len(held)
    assert len(got) == 602 and not any(r["toxic"] for r in got if r["doc_id"] < 0)


def test_models_without_labels(spark, tmp_path):
    write(spark, tmp_path, [])
    assert {r["score"] for r in quality_classifier.op2_quality_classifier(spark, str(tmp_path)).collect()} == {0.5}
    assert not any(r["toxic"] for r in toxicity.op3_toxicity(spark, str(tmp_path)).collect())


def test_grades_share_weights_and_stay_ordered():
    r = np.random.default_rng(0)
    rows = [(np.unique(np.concatenate(([g + 1] if g else [0], r.integers(10, 60, 5)))), int(g)) for g in r.integers(0, 4, 800)]
    w, t = toxicity.fit(rows, 4, size=64, epochs=20)
    assert (np.diff(t) >= 0).all() and w[2] < w[3] < w[4]
    grade = lambda at: int(np.argmax(np.diff(np.concatenate(([0], toxicity.sigmoid(t - w[at].sum()), [1])))))
    assert np.mean([grade(at) == y for at, y in rows]) > 0.9
    for y in range(4):  # the gradient agrees with differences
        f = lambda s, th: -np.log(max((toxicity.sigmoid(th[y] - s) if y < 3 else 1) - (toxicity.sigmoid(th[y - 1] - s) if y else 0), 1e-12))  # noqa: E731,B023
        th = np.array([-1.0, 0.2, 1.5])
        d, dt = toxicity.slopes(0.3, th, y)
        assert abs(d - (f(0.3 + 1e-6, th) - f(0.3 - 1e-6, th)) / 2e-6) < 1e-4
        for k in range(3):
            e = np.eye(3)[k] * 1e-6
            assert abs(dt[k] - (f(0.3, th + e) - f(0.3, th - e)) / 2e-6) < 1e-4


def test_word_hashes_do_not_depend_on_place():
    import pyarrow as pa

    one, off1 = common.text_bytes(pa.array(["Foo bar foo"]))
    two, off2 = common.text_bytes(pa.array([None, "zz foo", "bar"]))
    h1, _, _ = T.tokens(one, off1)
    h2, _, first = T.tokens(two, off2)
    assert h1[0] == h1[2] == h2[1] and h1[1] == h2[2] and first.tolist() == [0, 0, 2, 3]


def test_languages(spark, tmp_path):
    r = random.Random(1)
    parts = {"aa": ["ba", "na", "to"], "bb": ["schl", "ung", "é"], "cc": ["ou", "ки", "ре"]}
    rows = [(i, " ".join("".join(r.choice(parts[g]) for _ in range(4)) for _ in range(r.randint(3, 60))), g) for i in range(400) for g in [r.choice("aa bb cc".split())]]
    bad = [(1000, None, "aa"), (1001, "12 !?", "bb"), (1002, "", None), (None, "banato", "aa")]
    spark.createDataFrame(rows + bad, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in language_id.op8_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == 404 and all(got[d]["lang_pred"] == "und" and got[d]["score"] == 0 for d in (1000, 1001, 1002))
    held = [(i, g) for i, _, g in rows if got[i]["held_out"]]
    assert len(held) > 50 and all(got[i]["lang_pred"] == g and 0 <= got[i]["score"] <= 1 for i, g in held)


def test_kneser_ney_probabilities_sum_to_one():
    import pandas as pd

    grams = {}
    text = "   abab ba abc ab cab "
    for i in range(len(text) - 3):
        grams[text[i : i + 4]] = grams.get(text[i : i + 4], 0) + 1
    m = language_id.Models(pd.DataFrame({"lang": "x", "gram": list(grams), "n": list(grams.values())}))
    logp, back = m._kneser_ney(pd.DataFrame({"gram": list(grams), "n": list(grams.values())}))
    chars = {g[-1] for g in grams}
    for h in {g[:-1] for g in grams}:
        total = sum(np.exp(m._full((logp, back), 4, [h + c])[0]) for c in chars)
        assert 0.8 < total <= 1.0001  # the rest is for unseen characters


def test_models_keep_every_gram(spark, monkeypatch):
    r = random.Random(3)
    letters = [chr(c) for c in range(0x430, 0x450)] + [chr(c) for c in range(97, 123)]
    rows = [(i, "".join(r.choice(letters) for _ in range(4000)), "aa" if i % 3 else "bb") for i in range(50)] + [(99, "schlung banato", "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    monkeypatch.setattr(language_id, "CALIBRATION_SHARE", 0)
    counts = language_id.count(docs).toPandas()
    assert (counts["lang"] == "aa").sum() > 110_000
    want, got = language_id.Models(counts), language_id.fit(docs)[0]
    texts = [t[:300] for _, t, _ in rows[:6]] + ["banato schlung", "Zürich 42", "", None, "".join(r.choice(letters) for _ in range(300))]
    for a, b in zip(want.entropy(texts), got.entropy(texts), strict=True):
        assert np.allclose(a, b, atol=1e-5)
    assert all((want.hash[n] == got.hash[n]).all() and np.allclose(want.logp[n], got.logp[n], atol=1e-5) for n in want.hash)


def test_calibration_rows_are_not_counted(spark, monkeypatch):
    rows = [(i, f"abcdefgh{chr(0x430 + i % 30)}{chr(0x4e00 + i)}", "aa" if i % 2 else "bb") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    plain = language_id.count
    monkeypatch.setattr(language_id, "count", lambda d: seen.setdefault("counts", plain(d)))
    models, calibration = language_id.fit(docs)
    grams = "".join(r["gram"] for r in seen["counts"].collect())
    left_out = [i for i, t, _ in rows if t[-1] not in grams]
    assert 15 < len(left_out) < 80 and np.isfinite(calibration.w).all()


def test_long_repeated_and_tied_texts(spark):
    import pandas as pd

    r = random.Random(2)
    rows = [(i, "".join(r.choice("abcd ") for _ in range(60)), "aa") for i in range(40)]
    docs = spark.createDataFrame([(*x, 1.0) for x in rows] + [(100 + i, t, "bb", 1.0) for i, t, _ in rows], "doc_id long, text string, lang string, score double")
    fitted = language_id.fit(docs)
    m = language_id.Models(pd.DataFrame({"lang": ["bb", "aa"], "gram": ["abcd", "abcd"], "n": [1, 1]}))
    assert m.langs[m.entropy(["abcd"])[0].argmin(axis=1)[0]] == "aa"  # a tie
    long = "abcd " * 200_000
    got = language_id.predict(spark.createDataFrame([(1, long, "x"), (1, long, "x"), (None, "ab", "x"), (2, None, "x")], "doc_id long, text string, score string"), fitted).collect()
    assert len(got) == 4 and len({(x["lang_pred"], x["score"]) for x in got if x["doc_id"] == 1}) == 1 and sum(x["lang_pred"] == "und" for x in got) == 1


def test_ftrl_equals_scalar_updates():
    r = random.Random(5)
    rows = [(sorted(r.sample(range(20), r.randint(0, 6))), r.randint(0, 1)) for _ in range(200)]
    rows = [(at, [r.uniform(0.1, 2) for _ in at], y) for at, y in rows]
    m = quality_classifier.Ftrl(20)
    z, n = [0.0] * 21, [0.0] * 21
    weight = lambda i: 0.0 if abs(z[i]) <= m.l1 else -(z[i] - math.copysign(m.l1, z[i])) / ((m.beta + math.sqrt(n[i])) / m.alpha + m.l2)
    for at, x, y in rows:
        at, x = [*at, 20], [*x, 1.0]
        m.update(np.array(at), np.array(x), float(y))
        w = [weight(i) for i in at]
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
        for i, v, a in zip(at, x, w, strict=True):
            g = (p - y) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / m.alpha * a
            n[i] += g * g
    assert np.allclose(m.weights(), [weight(i) for i in range(21)], atol=1e-9) and np.abs(m.weights()).max() > 0.1


def test_scores_equal_plain_dot_products(spark):
    """op2: every n-gram's share times its weight; op3: the weights of the features that a text holds."""
    import pyarrow as pa

    texts = ["a b a", "", None, "the THE the!!", "word " * 3000, "é漢 1"]
    rows = list(quality_classifier.rows_of(pa.array(texts, pa.string())))
    r = np.random.default_rng(1)
    at = np.unique(np.concatenate([s for s, _ in rows]))
    w = r.normal(size=at.size).astype(np.float32).astype(float)
    table = dict(zip(at.tolist(), w.tolist(), strict=True))
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] * 2, "doc_id long, text string, score string")
    got = quality_classifier.score(df, (at, w, 0.25)).collect()
    want = [1 / (1 + math.exp(-(0.25 + sum(table[k] * v for k, v in zip(s.tolist(), x.tolist(), strict=True))))) for s, x in rows]
    assert len(got) == 2 * len(texts) and all(abs(x["score"] - want[x["doc_id"]]) < 1e-5 for x in got)
    assert quality_classifier.score(df.limit(0), (at, w, 0.25)).count() == 0
    data, off = common.text_bytes(pa.array(texts, pa.string()))
    h, heads, first = T.tokens(data, off, toxicity.PREFIXES)
    parts = toxicity.slots(h, heads, first)
    held = [{int(x) for p in parts for x in p[first[k] : first[k + 1]] if x >= 0} for k in range(len(texts))]
    at = np.array(sorted(set().union(*held)))
    w = r.normal(size=at.size).astype(np.float32).astype(float)
    table, cuts = dict(zip(at.tolist(), w.tolist(), strict=True)), np.array([-0.5, 0.4, 1.1])
    for x in toxicity.score(df, (at, w, cuts)).collect():
        below = [1 / (1 + math.exp(-(t - sum(table[k] for k in held[x["doc_id"]])))) for t in cuts]
        p = np.diff([0, *below, 1])
        assert abs(x["severity"] - sum(1 - b for b in below)) < 1e-4 and x["grade"] == int(np.argmax(p))
        assert np.allclose(x["above"], [1 - b for b in below], atol=1e-4)
    assert toxicity.score(df.limit(0), (at, w, cuts)).count() == 0


def test_ordinal_fit_equals_plain_loops():
    """The lazy soft threshold of `fit` against the same steps taken on every weight at every row."""
    r = random.Random(6)
    rows = [(np.array(sorted(r.sample(range(12), r.randint(1, 5)))), r.randint(0, 2)) for _ in range(60)]
    got, cuts = toxicity.fit(rows, 3, size=12, epochs=4)
    held = [sum(i in at for at, _ in rows) for i in range(12)]
    value = [math.log(60) and math.log(60 / h) / math.log(60) if h > 1 else 0.0 for h in held]
    w, seen, th, moved = [0.0] * 12, [1e-2] * 12, [0.0, 1.0], [1e-2] * 2
    pull, total, total_t = toxicity.RATE * toxicity.L1 / 60, [0.0] * 12, [0.0, 0.0]
    sig = lambda v: 1 / (1 + math.exp(-v))
    for epoch in range(4):
        for at, y in rows:
            for i in range(12):
                w[i] = math.copysign(max(0.0, abs(w[i]) - pull / math.sqrt(seen[i])), w[i])
            own = [i for i in at.tolist() if value[i] > 0]
            s = sum(w[i] * value[i] for i in own)
            up, low = sig(th[y] - s) if y < 2 else 1.0, sig(th[y - 1] - s) if y else 0.0
            du, dl, p = up * (1 - up), low * (1 - low), up - low
            for i in own:
                g = (du - dl) / p * value[i]
                seen[i] += g * g
                w[i] -= toxicity.RATE / math.sqrt(seen[i]) * g
            d = [0.0, 0.0]
            if y < 2:
                d[y] = -du / p
            if y:
                d[y - 1] = dl / p
            for k in range(2):
                g = min(1.0, max(-1.0, d[k]))
                moved[k] += g * g
                th[k] -= toxicity.RATE / math.sqrt(moved[k]) * g
            th[1] = max(th[1], th[0] + toxicity.GAP)
        if epoch >= 2:
            total = [a + b * v for a, b, v in zip(total, w, value, strict=True)]
            total_t = [a + b for a, b in zip(total_t, th, strict=True)]
    assert np.allclose(got, np.array(total) / 2, atol=1e-9) and np.allclose(cuts, np.array(total_t) / 2, atol=1e-9)


def test_empty_documents_table(spark, tmp_path):
    write(spark, tmp_path, corpus(40))
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert quality_classifier.op2_quality_classifier(spark, str(tmp_path)).count() == 0
    assert toxicity.op3_toxicity(spark, str(tmp_path)).count() == 0


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert language_id.op8_language_id(spark, str(tmp_path)).count() == 0
