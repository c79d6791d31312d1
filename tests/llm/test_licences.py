"""Licence rules: ordered sequences, wrapped lines, whole-table brute force, odd rows."""

from pyspark.sql import functions as F

from bayeslake.llm import catalog, licences as L

SF = "/root/testdata/sf0.01"
SCAN = L.Scanner(L.SENTENCES, L.RULES)


def names(text):
    return [n for n, _, _ in SCAN.scan(text)]


def test_every_rule_is_found_and_only_it():
    for licence, options in L.RULES.items():
        for option in options:
            text = "Before it. " + " ".join(L.SENTENCES[s] for s in option) + "\nAfter it."
            assert names(text) == [licence], option


def test_order_wrapping_and_neighbours():
    s = L.SENTENCES
    whole = f"{s['mit-grant']}\n\n{s['mit-notice']}"
    assert names(whole) == ["MIT"]
    assert names(f"{s['mit-notice']} {s['mit-grant']}") == []                   # wrong order
    assert names(f"{s['mit-grant']} Something else. {s['mit-notice']}") == []   # broken sequence
    wrapped = "# " + s["apache-unless"].replace(" distributed under", "\n# distributed under") + "\n# " + \
        s["apache-see"].replace("governing", "\n#   governing")
    assert names(wrapped) == ["Apache-2.0"]
    both = "x Released under the MIT License.\nreleased under the MIT license. All rights reserved."
    assert names(both) == ["MIT", "All-Rights-Reserved"]
    (_, a, b), _ = SCAN.scan("Hm.\nReleased under  the MIT License. Ok.\nAll rights reserved.")
    assert (a, b) == (4, 36)
    assert names("We talked about the MIT License. Licensed under CC BY-NC 4.0") == ["CC-BY-NC-4.0"]


def test_query_equals_a_search_for_lines(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    single = {s: licence for licence, options in L.RULES.items() for o in options if len(o) == 1 for s in o}
    got = {r.doc_id: r for r in catalog.op9_licence_scan(spark, SF).collect()}
    assert len(got) == len(docs)
    hits = 0
    for d in docs:
        lines = {L.normalise(x) for x in (d.text or "").split("\n")}
        want = {licence for s, licence in single.items() if L.normalise(L.SENTENCES[s]) in lines}
        assert want <= set(got[d.doc_id].licences)
        for s in got[d.doc_id].spans:
            assert s.licence in got[d.doc_id].licences and d.text[s.start:s.stop].strip()
            assert L.normalise(d.text[s.start:s.stop]) in {L.normalise(x) for x in L.SENTENCES.values()}
        hits += bool(want)
    assert hits


def test_odd_rows(spark):
    text = "All rights reserved."
    df = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, text, "c"), (2, text, "d"), (2, text, "e"),
                                (3, "word. " * 5000 + text, "f")], "doc_id long, text string, licences string")
    got = sorted(((r.doc_id or 0), r.licences, len(r.spans)) for r in L.scan_licences(df).collect())
    one = ["All-Rights-Reserved"]
    assert got == [(0, one, 1), (1, [], 0), (1, [], 0), (2, one, 1), (2, one, 1), (3, one, 1)]
    assert L.scan_licences(df.where(F.lit(False))).collect() == []
    assert L.Scanner({"s": "My own words."}, {"Own": [("s",)]}).scan("my OWN words") == [("Own", 0, 12)]
