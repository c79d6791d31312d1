"""ProbMinHash near-duplicates against all pairs, the estimator, odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bayeslake.llm import catalog, minhash as M
from bayeslake.llm.components import components

SF = "/root/testdata/sf0.01"


def classes(ids, links):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i
    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def brute_jaccard(a, b):
    a, b = dict(zip(*map(list, a))), dict(zip(*map(list, b)))
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in {**a, **b}) for i in a if i in b)


def brute(docs, similarity=0.8):
    sets = {d: M.shingles(t) for d, t in docs if d is not None}
    ids = sorted(sets)
    links = []
    for x, i in enumerate(ids):
        for j in ids[:x]:
            small, large = sorted((len(sets[i][0]), len(sets[j][0])))
            if small and np.intersect1d(sets[i][0], sets[j][0]).size and M.probability_jaccard(sets[i], sets[j]) >= similarity - 1e-12:
                links.append((i, j))
    return classes(ids, links)


def random_set(rng, n, universe=60):
    h = np.unique(np.array([rng.randrange(universe) for _ in range(n)], np.uint64))
    return M.mix(h)[np.argsort(M.mix(h))], np.array([float(rng.randrange(1, 5)) for _ in h])


def test_exact_similarity():
    rng = random.Random(1)
    for _ in range(200):
        a, b = random_set(rng, rng.randrange(1, 40)), random_set(rng, rng.randrange(1, 40))
        assert M.probability_jaccard(a, b) == pytest.approx(brute_jaccard(a, b))
    assert M.probability_jaccard(a, a) == pytest.approx(1)
    assert M.probability_jaccard(a, (a[0], 7 * a[1])) == pytest.approx(1)       # only shares matter
    assert M.probability_jaccard(a, M.shingles("")) == 0


def test_registers_estimate_the_similarity():
    rng = random.Random(2)
    for n in (3, 40, 400):
        err = []
        for _ in range(60):
            a, b = random_set(rng, n, 2 * n), random_set(rng, n, 2 * n)
            sa, sb = M.signatures([a, b])
            err.append((sa == sb).mean() - M.probability_jaccard(a, b))
        assert abs(np.mean(err)) < 0.02 and np.std(err) < 2.5 * (0.25 / M.REGISTERS) ** 0.5


def test_registers_do_not_depend_on_the_batch():
    rng = random.Random(3)
    sets = [random_set(rng, n, 900) for n in (1, 2, 700, 5, 90, 91)]
    together = M.signatures(sets)
    for s, row in zip(sets, together):
        assert (M.signatures([s])[0] == row).all() and set(row) <= set(s[0])


def test_query_equals_all_pairs(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in catalog.op6_minhash_near_dedup(spark, SF).collect()}
    assert got == brute(docs)
    assert len(set(got.values())) < len(got)


def family(rng, n):
    """Texts around one, at similarities on both sides of the threshold, and a passage shared by others."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def test_families_blocks_and_rounds(spark, monkeypatch):
    rng = random.Random(4)
    texts = family(rng, 60) + family(rng, 30) + [f"{' '.join(f'p{i}' for i in range(30))} {rng.random()} {rng.random()} tail"
                                                 for _ in range(30)]
    rng.shuffle(texts)
    monkeypatch.setattr(M, "BLOCK", 16)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in M.near_duplicates(df).collect()}
    assert got == brute(list(enumerate(texts)))


def test_blocks_pair_only_with_members_outside_the_largest_class(spark, monkeypatch):
    rng = random.Random(8)
    written, stored = {}, M.stored
    monkeypatch.setattr(M, "stored", lambda df, name, **o: written.setdefault(name, stored(df, name, **o)))
    monkeypatch.setattr(M, "BLOCK", 8)
    monkeypatch.setattr(M, "BLOCK_BYTES", 1 << 14)
    near, far = family(rng, 1)[0], []
    texts = [near.replace(near.split()[i], f"x{i}") for i in range(0, 100, 2)]        # one class, by their least member
    for k in (0, 6):                                                                  # far from it, near in the registers
        t = near.split()
        for i in range(3, 119, 29):
            t[i - k % 3] = f"y{k}{i}"
        far.append(" ".join(t))
    docs = list(enumerate(texts + far))
    got = {r.doc_id: r.class_id for r in M.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)
    blocks, found = written["blocks"], written["candidates"]
    assert "text" not in blocks.schema.simpleString()
    deal = {r.key: (r.outer, r.inner) for r in blocks.collect()}
    assert any(inner > 1 for _, inner in deal.values())
    assert all(r.x <= r.y and r.x < deal[r.key][0] for r in found.collect())          # never two blocks of the largest class
    sizes = written["open-members"].where("not outside").groupBy("key").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    assert all(deal[r.key][1] >= max(r.s / (1 << 14), r.n / 8) for r in sizes)


def test_odd_rows(spark):
    rows = [(5, None), (4, ""), (3, " \n"), (2, "one two"), (1, "ONE  two"), (9, "one two three"), (None, "one two"),
            (7, "long " * 4000), (8, "long " * 4000), (8, "long " * 4000), (10, "a b c d e f"), (6, "a b c d e f")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
    got = M.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.class_id, r.kept) for r in got} == {
        5: (5, True), 4: (4, True), 3: (3, True), 2: (1, False), 1: (1, True), 9: (9, True), None: (None, True),
        7: (7, True), 8: (7, False), 10: (6, False), 6: (6, True)}
    left = M.drop_near_duplicates(df)
    assert left.columns == df.columns
    # the copy with a NULL id goes, as id 1 stays for its text
    assert sorted((r.doc_id or 0) for r in left.collect()) == [1, 3, 4, 5, 6, 7, 9]
    assert M.near_duplicates(df.where(F.lit(False))).collect() == []


def test_rows_that_share_an_id_go_by_their_own_text(spark):
    t, u, v = ("t a b c d e f g", "u h i j k l m n", "v o p q r s t u")
    rows = [(2, t, "x"), (5, t, "y"), (5, u, "z"), (9, u, "z"), (None, v, "z"), (None, v, "z"), (None, t, "z"),
            (7, None, "z"), (7, None, "z"), (3, "", "z"), (3, v.upper() + " other words here now", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, number string").repartition(3)
    left = M.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted(map(str, (tuple(r) for r in left.collect()))) == sorted(map(str, [
        (2, t, "x"), (5, u, "z"), (None, v, "z"), (7, None, "z"), (7, None, "z"), (3, "", "z"), rows[-1]]))
    assert M.drop_near_duplicates(df.where(F.lit(False))).collect() == []


def test_unique_ids_lose_what_is_not_kept(spark):
    rng = random.Random(6)
    texts = family(rng, 20) + ["", None, "a b c d e f", "a b c d e f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i for i, c in brute(list(enumerate(texts))).items() if i == c}
    assert {r.doc_id for r in M.drop_near_duplicates(df).collect()} == want


def test_a_run_leaves_no_scratch(spark):
    import glob

    from bayeslake.session import ensure_checkpoint_dir, scratch_run
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(folder + "/*"))
    with scratch_run(spark):
        assert catalog.op6_minhash_near_dedup(spark, SF).count() > 0
    assert set(glob.glob(folder + "/*")) == before


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 300), (300, 200), (None, 1), (500, None)]
    links += [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(200)]
    df = spark.createDataFrame(links, "a long, b long")
    ids = {i for a, b in links if a is not None and b is not None and a != b for i in (a, b)}
    want = classes(ids, [(a, b) for a, b in links if a is not None and b is not None and a != b])
    assert {r.id: r.component for r in components(df).collect()} == want
    assert components(df.where("a = 100")).collect() == []


def test_components_of_a_chain_take_few_rounds(spark, monkeypatch):
    from bayeslake.llm import components as C
    written, stored = [], C.stored
    monkeypatch.setattr(C, "stored", lambda df, name, **o: written.append(name) or stored(df.coalesce(2), name, **o))
    chain = spark.range(200).selectExpr("id a", "id + 1 b")
    assert {r.id: r.component for r in components(chain).collect()} == {i: 0 for i in range(201)}
    assert written.count("hooks") == 1 and written.count("pointers") <= 10, written
