"""Quality statistics against plain Python, learned rules on held-out labels, odd rows."""

import re
from collections import Counter

from pyspark.sql import functions as F

from bayeslake.llm import catalog, quality as Q

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


ODD = [None, "", " \n\t", "a", "a b", "a b c", "a a a a", "x y z x y z", "a b c a b c d a b", "one\none\n\n \none",
       "a|b <c> #*", "é\xa0ü ß\x0bx\x0cy\rz", "ab c ab c ab", "q " * 3000, "l1 w\n l1 w\nl1 w", "a b a b a b c"]


def test_statistics_of_odd_texts(spark):
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(ODD)], "doc_id long, text string, words_ string")
    got = {r.doc_id: tuple(r.s) for r in Q.with_statistics(df, "text", "s").collect()}
    assert got == {i: brute(t) for i, t in enumerate(ODD)}


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rules = Q.fit_rules(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = catalog.op5_quality_rules(spark, SF)
    assert "Python" not in got._jdf.queryExecution().toString()
    got = {r.doc_id: r for r in got.collect()}
    texts = docs.collect()
    assert len(got) == len(texts)
    for d in texts:
        s = brute(d.text)
        r = got[d.doc_id]
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        named = dict(zip(Q.STATISTICS, s))
        row = {f: eval(sql, {}, named) for f, sql in Q.RATIOS.items()} if s[0] else {}
        bad = not failed and any(all(c.holds(row) for c in rule) for rule in rules)
        assert tuple(r[c] for c in Q.STATISTICS) == s
        assert (r.base_failed, r.kept) == (failed, not failed and not bad)


def test_rules_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rules = Q.fit_rules(docs, labels.where("doc_id % 2 = 0"))
    assert rules
    held = Q.judge(docs.join(labels.where("doc_id % 2 = 1"), "doc_id"), rules).where(~F.col("base_failed"))
    n = {(r.quality, r.kept): r["count"] for r in held.groupBy("quality", "kept").count().collect()}
    assert n.get((0, False), 0) > 0.95 * (n.get((0, False), 0) + n.get((0, True), 0))
    assert n.get((1, True), 0) > 0.99 * (n.get((1, False), 0) + n.get((1, True), 0))


def test_learning_edges():
    row = lambda s, c=5.0: {"symbols_per_word": s, "repeated_share": 0.0, "dup_lines_per_word": 0.0,
                            "chars_per_word": c}
    assert Q.learn_rules([]) == []
    assert Q.learn_rules([(row(0.0), False)] * 30) == []
    assert Q.learn_rules([(row(0.0), True), (row(0.0), False)] * 30) == []          # ties cannot be told apart
    mixed = [(row(1.0), True)] * 30 + [(row(0.0), False)] * 60 + [(row(0.0, 20.0), True)] * 30
    rules = Q.learn_rules([mixed[i * 7 % 120] for i in range(120)])
    assert len(rules) == 2
    for r, bad in mixed:
        assert any(all(c.holds(r) for c in rule) for rule in rules) == bad


def test_odd_labels_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a " * 60, True), (None, None, False), (1, "a " * 60, True)],
                                 "doc_id long, text string, kept boolean")
    labels = spark.createDataFrame([(None, 0), (1, None), (9, 1)], "doc_id long, quality int")
    assert Q.fit_rules(docs, labels) == [] and Q.fit_rules(docs, labels.where("false")) == []
    try:
        Q.judge(docs, [])
        raise AssertionError
    except ValueError:
        pass
    out = Q.judge(docs, [], names=("s", "f", "k"))
    assert sorted((r.doc_id is None, r.f, r.k) for r in out.collect()) == [(False, True, False)] * 2 + [(True, True, False)]
    assert Q.judge(docs.drop("kept").where("false"), []).collect() == []


def test_one_id_with_many_texts_stays_bounded(spark, monkeypatch):
    text = " ".join(f"w{j}" for j in range(60))
    docs = spark.createDataFrame([(1, f"{text} {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    sizes, learn = [], Q.learn_rules
    monkeypatch.setattr(Q, "learn_rules", lambda rows, **o: sizes.append(len(rows)) or learn(rows, **o))
    Q.fit_rules(docs, labels, max_labelled=20)
    assert sizes == [20]
