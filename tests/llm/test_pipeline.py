import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_stages(spark):
    import corpus_pipeline as P
    from quarry.llm import decontaminate, minhash_dedup, quality_rules

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, DATA).persist()
        assert docs.columns == columns, name
        old, new = {r["doc_id"]: r["text"] for r in before.collect()}, {r["doc_id"]: r["text"] for r in docs.collect()}
        assert new.keys() <= old.keys()
        if name == "minhash_near_dedup":
            want = minhash_dedup.brute(old, 80)  # near-duplicate stages link at 0.8
            assert new.keys() == {c for _, c in want.values()}
        if name == "benchmark_decontamination":
            items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
            hit = decontaminate.brute(old, items)
            assert all(new[d] == old[d] for d in old if not hit[d][1])
            assert not any(v[1] for v in decontaminate.brute(new, items).values())
    last = P.STAGES[-1][1](spark, docs, DATA).collect()
    assert len(last) == docs.count() and all(r["round_trip"] and len(r["ids"]) == r["n_tokens"] for r in last)
    assert quality_rules.POLICY in quality_rules.POLICIES and P.run(spark, DATA).count() == len(last)


@pytest.mark.parametrize("name", ["op6_chat_formatting", "op7_quality_rules"])
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from quarry.llm import queries as Q

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want, got = con.execute(Q.oracle_sql()[name]).df(), Q.queries()[name](spark, DATA).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    assert sorted(map(str, want[cols].values.tolist())) == sorted(map(str, got[cols].values.tolist()))


def test_stages_take_nulls_repeats_and_nothing(spark, tmp_path):
    import corpus_pipeline as P

    text = " ".join(f"plain{i % 7} words{i}" for i in range(60))
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, spans int, component_id long"
    rows = [(1, text, None, None, None, "k", None, 1, 9), (1, text, "en", "s", 5, "k", None, 1, 9), (2, text, "en", "s", 5, None, "r", None, 9), (None, text, "en", "s", 5, "k", "r", 1, 9), (3, None, "en", "s", 0, "k", "r", 1, 9), (4, "", "en", "s", 0, "k", "r", 1, 9), (5, " ".join("".join(chr(97 + int(c)) for c in f"{i:05d}") for i in range(90_000)), "en", "s", 0, "k", "r", 1, 9)]
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == spark.createDataFrame([], schema).columns, name
            docs = spark.createDataFrame(docs.collect(), schema)
        out = P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert sorted(str(r["doc_id"]) for r in out) == (["1", "1", "5", "None"] if data else []) and all(r["round_trip"] for r in out)


def test_generated_findings_burden_the_driver_little(spark, monkeypatch):
    from quarry.llm import secret_scan as S

    findings, read = S.generated_findings(spark, 290), []
    assert len(findings._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    plain = S.C.cut
    monkeypatch.setattr(S.C, "cut", lambda df: read.append(df.columns) or plain(df))
    assert len(S.train(findings)) == S.TREES
    assert [sorted(x) for x in read] == [sorted([*S.FEATURES, "label"])]  # the forest's own jobs read stored numbers, not the features' expressions
