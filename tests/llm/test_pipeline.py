"""The corpus pipeline: every stage against a plain version of it, odd rows."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline as C  # noqa: E402
from bayeslake.llm import quality as Q, toxicity as X  # noqa: E402
from test_line_dedup import brute as brute_lines  # noqa: E402
from test_minhash import brute as brute_near  # noqa: E402
from test_packing import BYTE, check_rows  # noqa: E402,F401
from test_quality import brute as brute_statistics  # noqa: E402

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_equal_plain_versions(spark, tmp_path):
    docs, by = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        by[name] = (docs, docs := spark.read.parquet(str(tmp_path / name)))
        if name != C.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    before, after = by["quality_rules"]
    rules = Q.fit_rules(before, labels)
    keep = set()
    for r in before.collect():
        s = brute_statistics(r.text)
        if s[0] >= 50 and 100 * s[4] <= 50 * s[0]:
            row = {f: eval(sql, {}, dict(zip(Q.STATISTICS, s))) for f, sql in Q.RATIOS.items()}
            if not any(all(c.holds(row) for c in rule) for rule in rules):
                keep.add(r)
    assert set(after.collect()) == keep

    before, after = by["toxicity"]
    chain = X.fit_chain(before, labels)
    p = {r.doc_id: chain.probabilities([[chain.features[f] for f in X.text_features(r.text) if f in chain.features]])[0, -1]
         for r in before.collect()}
    assert {r.doc_id for r in after.collect()} == {i for i, v in p.items() if v <= X.THRESHOLD}

    before, after = by["line_dedup"]
    want = {d: t for d, _, _, t in brute_lines([(r.doc_id, r.text) for r in before.collect()], 40, 5)}
    assert {r.doc_id: r.text for r in after.collect()} == want
    assert all(r.n_chars == len(r.text) for r in after.collect())

    before, after = by["minhash_near_dedup"]
    classes = brute_near([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id for r in after.collect()} == set(classes.values())

    before, after = by["best_fit_packing"]
    check_rows(after.collect(), [(r.doc_id, r.text) for r in before.collect()], 1024, 2)


def test_odd_rows_and_empty_tables(spark, tmp_path):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good, "en", None, 5, 1), (1, good, "en", None, 5, 2), (None, good + " x", None, "s", None, 3),
            (2, None, "en", "s", 0, 4), (3, "", "en", "s", 0, 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept int"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for k, data in enumerate((rows, [])):
        docs = spark.createDataFrame(data, schema)
        for name, stage in C.STAGES:
            out = stage(spark, docs, str(tmp_path))
            out.write.parquet(str(tmp_path / f"{name}-{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}-{k}"))
            if name == "quality_rules" and data:
                assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 1, 1]
                assert docs.columns == schema.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
            # one row stays of the class of row 1, its repetition and the near copy without an id
            late = name in ("minhash_near_dedup", "best_fit_packing")
            assert docs.count() == (0 if not data else 1 if late else 3), name


def test_registered():
    import __spark_entry__ as E
    q = E.queries()
    assert "pipeline" in q and [sum(k.startswith(f"op{n}_") for k in q) for n in range(1, 11)] == [1] * 10
    assert set(E.oracle_sql()) <= set(q)
