"""DuckDB SQL oracles for the registered queries.

The SQL restates the formulas directly (it is not generated from the Spark
plans): counts and ratios for the CPTs, ``avg`` / ``stddev_samp`` for the
moments, the literal definition ``avg((x - mx)(y - my)) / (sx sy)`` for
every correlation coefficient (a correlated subquery per configuration), and
a candidate cross product with ``row_number()`` for the arg-max.
"""

from __future__ import annotations

from .dag import Network

NEG = "CAST('-inf' AS DOUBLE)"


def q(n: str) -> str:
    return '"' + n.replace('"', '""') + '"'


def r6(e: str) -> str:
    return f"round(CAST({e} AS DOUBLE), 6)"


def safe_log(p: str) -> str:
    return f"(CASE WHEN {p} > 0 THEN ln({p}) ELSE {NEG} END)"


def logphi(x: str, m: str, s: str) -> str:
    z = f"(({x} - {m}) / {s})"
    return f"(-0.5 * {z} * {z} - ln({s}) - 0.5 * ln(2 * pi()))"


def class_term(x, m, s):
    return (f"(CASE WHEN {x} IS NULL THEN 0.0 WHEN {s} IS NULL OR {s} <= 0 THEN {NEG} "
            f"ELSE {logphi(x, m, s)} END)")


def root_term(x, m, s):
    return f"(CASE WHEN {x} IS NULL OR {s} IS NULL OR {s} <= 0 THEN 0.0 ELSE {logphi(x, m, s)} END)"


def pair_term(x, mx, sx, y, my, sy, r):
    zx, zy = f"(({x} - {mx}) / {sx})", f"(({y} - {my}) / {sy})"
    one = f"(1.0 - {r} * {r})"
    val = (f"(-ln(2 * pi()) - ln({sx}) - ln({sy}) - 0.5 * ln({one}) - "
           f"({zx} * {zx} + {zy} * {zy} - 2.0 * {r} * {zx} * {zy}) / (2.0 * {one}))")
    bad = (f"{sx} IS NULL OR {sy} IS NULL OR {sx} <= 0 OR {sy} <= 0 OR {r} IS NULL "
           f"OR isnan({r}) OR abs({r}) >= 1")
    return f"(CASE WHEN {x} IS NULL OR {y} IS NULL THEN 0.0 WHEN {bad} THEN {NEG} ELSE {val} END)"


def log_default(d: float) -> str:
    return f"ln({d!r})" if d > 0 else NEG


def _plus(terms):
    return " + ".join(terms) if terms else "0.0"


class BN:
    """SQL for one network: parameter CTEs over relation ``tr``."""

    def __init__(self, cols, edges, kinds: dict, tr: str = "tr"):
        self.net = Network.build(cols, kinds, edges)
        self.tr = tr

    def idx(self, n):
        return self.net.nodes.index(n)

    def cont_idx(self, n):
        return self.net.continuous_nodes().index(n)

    def param_ctes(self) -> list[tuple[str, str]]:
        net, tr = self.net, self.tr
        out = []
        cont = net.continuous_nodes()
        if cont:
            sel = ", ".join(f"avg({q(y)}) AS m{j}, coalesce(stddev_samp({q(y)}), 1.0) AS s{j}"
                            for j, y in enumerate(cont))
            out.append(("g", f"SELECT {sel} FROM {tr}"))
        for i, n in enumerate(net.nodes):
            D, C = net.discrete_parents(n), net.continuous_parents(n)
            if net.is_discrete(n):
                dsel = "".join(f"{q(d)} AS d{a}, " for a, d in enumerate(D))
                part = ("PARTITION BY " + ", ".join(q(d) for d in D)) if D else ""
                keys = ", ".join(q(k) for k in list(D) + [n])
                inner = (f"SELECT {dsel}{q(n)} AS v, count(*) AS n, "
                         f"sum(count(*)) OVER ({part}) AS n_config FROM {tr} GROUP BY {keys}")
                where = " AND ".join([f"d{a} IS NOT NULL" for a in range(len(D))] + ["v IS NOT NULL"])
                out.append((f"cpt{i}", f"SELECT *, CAST(n AS DOUBLE) / n_config AS p FROM ({inner}) x WHERE {where}"))
                if C:
                    ms = ", ".join(f"coalesce(avg({q(c)}), 0.0) AS m{j}, coalesce(stddev_samp({q(c)}), 0.0) AS s{j}"
                                   for j, c in enumerate(C))
                    out.append((f"cm{i}", f"SELECT {q(n)} AS v, {ms} FROM {tr} WHERE {q(n)} IS NOT NULL GROUP BY {q(n)}"))
                continue
            if D:
                dsel = ", ".join(f"{q(d)} AS d{a}" for a, d in enumerate(D))
                nn = " AND ".join(f"{q(d)} IS NOT NULL" for d in D)
                out.append((f"gc{i}", f"SELECT {dsel}, coalesce(avg({q(n)}), 0.0) AS my, "
                                      f"coalesce(stddev_samp({q(n)}), 0.0) AS sy FROM {tr} WHERE {nn} "
                                      f"GROUP BY {', '.join(q(d) for d in D)}"))
            jy = self.cont_idx(n)
            for j, c in enumerate(C):
                jc = self.cont_idx(c)
                if D:
                    ds = ", ".join(f"k.d{a}" for a in range(len(D)))
                    out.append((f"cf{i}_{j}",
                                f"SELECT {ds}, (SELECT avg((t.{q(c)} - g.m{jc}) * (t.{q(n)} - k.my)) FROM {tr} t) "
                                f"/ NULLIF(g.s{jc} * k.sy, 0) AS rho FROM gc{i} k, g"))
                else:
                    out.append((f"cf{i}_{j}",
                                f"SELECT (SELECT avg((t.{q(c)} - g.m{jc}) * (t.{q(n)} - g.m{jy})) FROM {tr} t) "
                                f"/ NULLIF(g.s{jc} * g.s{jy}, 0) AS rho FROM g"))
        return out

    def terms(self, output: str | None, default: float, only: str | None = None):
        """(joins, log terms) over ``te t`` (and ``cands c`` when output is set)."""
        net = self.net
        ld = log_default(default)
        joins, terms = [], []

        def val(n):
            return "c.k" if n == output else f"t.{q(n)}"
        for i, n in enumerate(net.nodes):
            if only is not None and n != only:
                continue
            D, C = net.discrete_parents(n), net.continuous_parents(n)
            if net.is_discrete(n):
                cond = " AND ".join([f"p{i}.d{a} = {val(d)}" for a, d in enumerate(D)] + [f"p{i}.v = {val(n)}"])
                joins.append(f"LEFT JOIN cpt{i} p{i} ON {cond}")
                if C:
                    joins.append(f"LEFT JOIN cm{i} m{i} ON m{i}.v = {val(n)}")
                if not D and not C:
                    terms.append(safe_log(f"p{i}.p"))
                else:
                    dens = _plus([class_term(f"t.{q(c)}", f"m{i}.m{j}", f"m{i}.s{j}") for j, c in enumerate(C)])
                    terms.append(f"(CASE WHEN p{i}.p IS NULL THEN {ld} ELSE {safe_log(f'p{i}.p')} + {dens} END)")
                continue
            jy = self.cont_idx(n)
            if not C:
                if not D:
                    terms.append(root_term(f"t.{q(n)}", f"g.m{jy}", f"g.s{jy}"))
                continue
            if output is not None and output in D:
                continue
            if not D:
                parts = []
                for j, c in enumerate(C):
                    jc = self.cont_idx(c)
                    joins.append(f"CROSS JOIN cf{i}_{j} r{i}_{j}")
                    parts.append(pair_term(f"t.{q(c)}", f"g.m{jc}", f"g.s{jc}", f"t.{q(n)}",
                                           f"g.m{jy}", f"g.s{jy}", f"r{i}_{j}.rho"))
                terms.append(_plus(parts))
                continue
            cond = lambda al: " AND ".join(f"{al}.d{a} = {val(d)}" for a, d in enumerate(D))
            joins.append(f"LEFT JOIN gc{i} k{i} ON {cond(f'k{i}')}")
            parts = []
            for j, c in enumerate(C):
                jc = self.cont_idx(c)
                joins.append(f"LEFT JOIN cf{i}_{j} r{i}_{j} ON {cond(f'r{i}_{j}')}")
                parts.append(pair_term(f"t.{q(c)}", f"g.m{jc}", f"g.s{jc}", f"t.{q(n)}",
                                       f"k{i}.my", f"k{i}.sy", f"r{i}_{j}.rho"))
            terms.append(f"(CASE WHEN k{i}.my IS NULL THEN {ld} ELSE {_plus(parts)} END)")
        if net.continuous_nodes():
            joins.insert(0, "CROSS JOIN g")
        return joins, terms

    def scored(self, te: str, output: str, default: float) -> list[tuple[str, str]]:
        """CTEs ending in ``sc``: one row per (test row, candidate) with score ``s``."""
        io = self.idx(output)
        joins, terms = self.terms(output, default)
        return self.param_ctes() + [
            ("cands", f"SELECT DISTINCT v AS k FROM cpt{io}"),
            ("te_r", f"SELECT *, row_number() OVER () AS rid FROM {te}"),
            ("sc", f"SELECT t.*, c.k, {_plus(terms)} AS s FROM te_r t CROSS JOIN cands c "
                   + " ".join(joins)),
        ]

    def best(self) -> tuple[str, str]:
        return ("best", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY s DESC, k) AS rn "
                        "FROM sc) x WHERE rn = 1")

    def factor(self, te: str, node: str, default: float = 0.0) -> list[tuple[str, str]]:
        joins, terms = self.terms(None, default, only=node)
        return self.param_ctes() + [
            ("fac", f"SELECT t.*, {_plus(terms)} AS lf FROM {te} t " + " ".join(joins))]


def with_(ctes: list[tuple[str, str]], final: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in ctes) + "\n" + final


# ---- fixtures ---------------------------------------------------------------------------
def code(c: str) -> str:
    return (f"CAST(CASE WHEN {c} IS NULL THEN NULL ELSE dense_rank() OVER (ORDER BY {c}) - 1 END AS INTEGER)")


LI = ("li", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
            f"l_returnflag, l_linestatus, {code('l_returnflag')} AS rf, {code('l_linestatus')} AS ls "
            "FROM lineitem")
DOCS = ("dl", "SELECT l.doc_id, l.quality, l.toxic, "
              "CAST(dense_rank() OVER (ORDER BY d.lang) - 1 AS INTEGER) AS lang, "
              "CAST(dense_rank() OVER (ORDER BY d.source) - 1 AS INTEGER) AS source, "
              "CAST(d.n_chars AS DOUBLE) AS n_chars, CAST(d.n_chars AS DOUBLE) / 2 AS half "
              "FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
EMB = ("em", "SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(64))
             + ", label FROM embeddings")
ORD = ("od", f"SELECT o_orderkey, o_totalprice, {code('o_orderpriority')} AS prio, "
             f"{code('o_orderstatus')} AS status FROM orders")

D, Cn = "discrete", "continuous"
K_G1 = {"l_linenumber": D, "ls": D, "rf": D}
G2_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "ls", "rf"]
K_G2 = {c: Cn for c in G2_COLS[:4]} | {"ls": D, "rf": D}
K_G3 = {"rf": D, "ls": D, "l_quantity": Cn, "l_extendedprice": Cn}
K_G4 = {"l_quantity": Cn, "l_extendedprice": Cn}
K_G5 = {"lang": D, "n_chars": Cn, "quality": D, "toxic": D}
G6_COLS = [f"f{i}" for i in range(64)] + ["label"]
K_G6 = {c: Cn for c in G6_COLS[:-1]} | {"label": D}
K_G7 = {"prio": D, "o_totalprice": Cn, "status": D}
K_GS = {"lang": D, "source": D, "n_chars": Cn, "quality": D}
K_GD = {"quality": D, "lang": D, "source": D, "n_chars": Cn, "half": Cn}
K_GN = {"ls": D, "l_quantity": Cn, "l_discount": Cn, "rf": D}
K_GM = {"l_linenumber": D, "ls": D, "bucket": D}
LIN = ("lin", "SELECT * REPLACE (CASE WHEN rf <> 0 THEN ls END AS ls) FROM li")
LIM = ("lim", f"SELECT l_orderkey, l_linenumber, {code('l_linestatus')} AS ls, "
              "CAST(l_partkey % 500 AS INTEGER) AS bucket FROM lineitem")
GW_COLS = [f"f{i}" for i in range(64)] + ["label", "y"]
K_GW = {c: Cn for c in GW_COLS[:-2]} | {"label": D, "y": Cn}
EMW = ("emw", f"SELECT *, CAST(vec_id % 97 AS DOUBLE) + CAST(3.0 AS DOUBLE) * f0 AS y FROM ({EMB[1]}) e")
# the harness's random split: 32 bits of an md5 of seed and row key
TRAIN_SIDE = ("CAST('0x' || substr(md5('1|' || l_orderkey || '|' || l_linenumber), 1, 8) AS BIGINT) "
              "/ 4294967296.0 < 0.8")

NETS = {
    "G1": (["l_linenumber", "ls", "rf"], [("ls", "rf"), ("l_linenumber", "rf")], K_G1, LI, "l_orderkey"),
    "G2": (G2_COLS, [(c, "rf") for c in G2_COLS[:-1]], K_G2, LI, "l_orderkey"),
    "G3": (["rf", "ls", "l_quantity", "l_extendedprice"],
           [("rf", "l_extendedprice"), ("ls", "l_extendedprice"), ("l_quantity", "l_extendedprice")],
           K_G3, LI, "l_orderkey"),
    "G4": (["l_quantity", "l_extendedprice"], [("l_quantity", "l_extendedprice")], K_G4, LI, "l_orderkey"),
    "G5": (["lang", "n_chars", "quality", "toxic"],
           [("lang", "quality"), ("n_chars", "quality"), ("quality", "toxic")], K_G5, DOCS, "doc_id"),
    "G6": (G6_COLS, [(c, "label") for c in G6_COLS[:-1]], K_G6, EMB, "vec_id"),
    "G7": (["prio", "o_totalprice", "status"], [("prio", "o_totalprice"), ("o_totalprice", "status")],
           K_G7, ORD, "o_orderkey"),
    "GS": (["lang", "source", "n_chars", "quality"],
           [("lang", "quality"), ("source", "quality"), ("n_chars", "quality")], K_GS, DOCS, "doc_id"),
    "GD": (["quality", "lang", "source", "n_chars", "half"],
           [("quality", "n_chars"), ("lang", "n_chars"), ("source", "n_chars"), ("half", "n_chars")],
           K_GD, DOCS, "doc_id"),
    "GN": (["ls", "l_quantity", "l_discount", "rf"],
           [("ls", "rf"), ("l_quantity", "rf"), ("l_discount", "rf")], K_GN, LIN, "l_orderkey"),
    "GW": (GW_COLS, [(c, "y") for c in GW_COLS[:-1]], K_GW, EMW, "vec_id"),
    "GM": (["l_linenumber", "ls", "bucket"], [("l_linenumber", "bucket"), ("ls", "bucket")], K_GM, LIM, "l_orderkey"),
}


def base(g: str, src: tuple[str, str] | None = None, split: bool = False) -> tuple[BN, list[tuple[str, str]]]:
    """Network ``g`` with ``tr`` (training rows) and ``te`` (scored rows).

    By default both are every row of the table; ``split`` is the harness's
    random 80/20 split."""
    cols, edges, kinds, s, key = NETS[g]
    s = src or s
    if split:
        ctes = [s, ("tr", f"SELECT * FROM {s[0]} WHERE {TRAIN_SIDE}"),
                ("te", f"SELECT * FROM {s[0]} WHERE NOT ({TRAIN_SIDE})")]
    else:
        ctes = [s, ("tr", f"SELECT * FROM {s[0]}"), ("te", f"SELECT * FROM {s[0]}")]
    return BN(cols, edges, kinds), ctes


def predict_sql(g: str, output: str, keep: list[str], default: float = 0.0) -> str:
    bn, ctes = base(g)
    sel = ", ".join(keep)
    return with_(ctes + bn.scored("te", output, default) + [bn.best()],
                 f"SELECT {sel}, k AS prediction, {r6('s')} AS score FROM best")


def factor_sql(g: str, node: str, keep: list[str], default: float = 0.0) -> str:
    bn, ctes = base(g)
    return with_(ctes + bn.factor("te", node, default),
                 f"SELECT {', '.join(keep)}, {r6('lf')} AS log_factor FROM fac")


def _cfg(n):
    return "concat_ws(',', " + ", ".join(f"d{a}" for a in range(n)) + ")" if n else "''"


def metrics_ctes(pred: str) -> list[tuple[str, str]]:
    return [
        ("conf", f"SELECT label, prediction, count(*) AS n FROM {pred} GROUP BY label, prediction"),
        ("tp", "SELECT label AS cls, sum(n) AS tp FROM conf WHERE label = prediction GROUP BY 1"),
        ("nt", "SELECT label AS cls, sum(n) AS n_true FROM conf GROUP BY 1"),
        ("np", "SELECT prediction AS cls, sum(n) AS n_pred FROM conf GROUP BY 1"),
        ("cls", "SELECT cls FROM nt WHERE cls IS NOT NULL UNION SELECT cls FROM np WHERE cls IS NOT NULL"),
        ("pr", "SELECT cls.cls AS label, "
               "coalesce(CAST(coalesce(tp.tp, 0) AS DOUBLE) / NULLIF(np.n_pred, 0), 0.0) AS precision, "
               "coalesce(CAST(coalesce(tp.tp, 0) AS DOUBLE) / NULLIF(nt.n_true, 0), 0.0) AS recall "
               "FROM cls LEFT JOIN tp ON tp.cls = cls.cls LEFT JOIN nt ON nt.cls = cls.cls "
               "LEFT JOIN np ON np.cls = cls.cls"),
        ("met", "SELECT label, precision, recall, "
                "coalesce(2 * precision * recall / NULLIF(precision + recall, 0), 0.0) AS f1 FROM pr"),
    ]


def _g2_pred_ctes(default=0.0, src=None, split=False):
    bn, ctes = base("G2", src, split)
    return ctes + bn.scored("te", "rf", default) + [
        bn.best(), ("preds", "SELECT rf AS label, k AS prediction FROM best")]


def build() -> dict[str, str]:
    o: dict[str, str] = {}
    bn1, c1 = base("G1")
    p1 = c1 + bn1.param_ctes()
    bn1w, c1w = base("G1")
    p1w = c1w + bn1w.param_ctes()
    i_ln, i_ls, i_rf = (bn1.idx(n) for n in ("l_linenumber", "ls", "rf"))
    fam = (f"SELECT 'l_linenumber' AS node, '' AS config, v AS value, n, n_config, p FROM cpt{i_ln} UNION ALL "
           f"SELECT 'ls', '', v, n, n_config, p FROM cpt{i_ls} UNION ALL "
           f"SELECT 'rf', {_cfg(2)}, v, n, n_config, p FROM cpt{i_rf}")
    o["family_count"] = with_(p1w, f"SELECT node, config, value, n FROM ({fam}) f")
    o["parent_total"] = with_(p1w, f"SELECT DISTINCT node, config, n_config FROM ({fam}) f")
    o["cpt_root"] = with_(p1w, f"SELECT node, value, {r6('p')} AS p FROM ({fam}) f WHERE config = ''")
    o["cpt_discrete"] = with_(p1w, f"SELECT {_cfg(2)} AS config, v AS value, n, n_config, {r6('p')} AS p "
                                  f"FROM cpt{i_rf}")
    exp = p1 + [("cands", f"SELECT DISTINCT v AS k FROM cpt{i_rf}")]
    o["candidate_expand"] = with_(exp, "SELECT l_orderkey, l_linenumber, ls, rf, c.k AS candidate "
                                       "FROM te CROSS JOIN cands c")
    o["factor_discrete"] = with_(exp, f"SELECT l_orderkey, l_linenumber, ls, rf, c.k AS candidate, "
                                      f"{r6('coalesce(p.p, 0.0)')} AS p FROM te CROSS JOIN cands c "
                                      f"LEFT JOIN cpt{i_rf} p ON p.d0 = te.l_linenumber AND p.d1 = te.ls AND p.v = c.k")
    o["predict"] = predict_sql("G1", "rf", ["l_orderkey", "l_linenumber", "ls", "rf"])

    o["scan_csv_infer"] = ("SELECT l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
                           "l_returnflag, l_linestatus FROM lineitem")
    o["encode_codes"] = with_([LI], "SELECT l_orderkey, l_linenumber, l_returnflag, rf, l_linestatus, ls FROM li")

    bn3, c3 = base("G3")
    p3 = c3 + bn3.param_ctes()
    inv = []
    for n in bn3.net.nodes:
        dom = f"(SELECT count(DISTINCT {q(n)}) FROM tr)" if bn3.net.is_discrete(n) else "CAST(NULL AS BIGINT)"
        inv.append(f"SELECT '{n}' AS node, '{bn3.net.kinds[n]}' AS kind, {len(bn3.net.parents[n])} AS n_parents, "
                   f"{len(bn3.net.discrete_parents(n))} AS n_discrete_parents, "
                   f"{len(bn3.net.continuous_parents(n))} AS n_continuous_parents, {dom} AS domain, "
                   f"(SELECT count({q(n)}) FROM tr) AS n_nonnull")
    o["node_inventory"] = with_(c3, " UNION ALL ".join(inv))
    i_ep = bn3.idx("l_extendedprice")
    el = []
    for p, c in bn3.net.edges():
        src = f"gc{i_ep}" if bn3.net.is_discrete(p) else f"cf{i_ep}_{bn3.net.continuous_parents(c).index(p)}"
        el.append(f"SELECT '{p}' AS parent, '{c}' AS child, '{bn3.net.kinds[p]}' AS parent_kind, "
                  f"'{bn3.net.kinds[c]}' AS child_kind, (SELECT count(*) FROM {src}) AS n_params")
    o["edge_list"] = with_(p3, " UNION ALL ".join(el))
    o["fan_in_edges"] = with_(base("G2")[1], " UNION ALL ".join(
        f"SELECT '{p}' AS parent, 'rf' AS child, count(*) FILTER (WHERE {p} IS NOT NULL AND rf IS NOT NULL) "
        f"AS n_pairs FROM tr" for p in G2_COLS[:-1]))
    z = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    zs = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in z)
    o["standardize"] = with_([LI, ("st", f"SELECT {zs} FROM li")],
                             "SELECT l_orderkey, l_linenumber, " +
                             ", ".join(f"{r6(f'({c} - m_{c}) / NULLIF(s_{c}, 0)')} AS {c}" for c in z) +
                             ", ls, rf FROM li, st")
    o["split_key"] = ("SELECT 'train' AS part, count(*) AS n_rows FROM lineitem WHERE l_orderkey % 5 <> 0 "
                      "UNION ALL SELECT 'test', count(*) FROM lineitem WHERE l_orderkey % 5 = 0")

    o["split_random"] = with_([LI], "SELECT l_orderkey, l_linenumber, " + ", ".join(G2_COLS) +
                              f", CASE WHEN {TRAIN_SIDE} THEN 'train' ELSE 'test' END AS side FROM li")

    o["gauss_root"] = with_(p3, " UNION ALL ".join(
        f"SELECT '{y}' AS node, {r6(f'm{j}')} AS mean, {r6(f's{j}')} AS sd FROM g"
        for j, y in enumerate(bn3.net.continuous_nodes())))
    o["gauss_by_config"] = with_(p3, f"SELECT 'l_extendedprice' AS node, {_cfg(2)} AS config, "
                                     f"{r6('my')} AS mean, {r6('sy')} AS sd FROM gc{i_ep}")
    bn2, c2 = base("G2")
    p2 = c2 + bn2.param_ctes()
    bn2w, c2w = base("G2")
    p2w = c2w + bn2w.param_ctes()
    i_rf2 = bn2.idx("rf")
    cp2 = bn2.net.continuous_parents("rf")
    o["class_moments"] = with_(p2w, " UNION ALL ".join(
        f"SELECT 'rf' AS node, v AS class, '{c}' AS dim, {r6(f'm{j}')} AS mean, {r6(f's{j}')} AS sd "
        f"FROM cm{i_rf2}" for j, c in enumerate(cp2)))
    o["cpt_hybrid"] = with_(p2w, " UNION ALL ".join(
        f"SELECT {_cfg(1)} AS config, p.v AS value, {r6('p.p')} AS p, '{c}' AS dim, "
        f"{r6(f'm.m{j}')} AS mean, {r6(f'm.s{j}')} AS sd FROM cpt{i_rf2} p JOIN cm{i_rf2} m ON m.v = p.v"
        for j, c in enumerate(cp2)))
    bn4, c4 = base("G4")
    p4 = c4 + bn4.param_ctes()
    p4w = base("G4")[1] + bn4.param_ctes()
    o["coef_edge"] = with_(p4w, f"SELECT 'l_quantity' AS parent, 'l_extendedprice' AS child, "
                               f"{r6('rho')} AS rho FROM cf{bn4.idx('l_extendedprice')}_0")
    o["coef_by_config"] = with_(p3, f"SELECT 'l_quantity' AS parent, 'l_extendedprice' AS child, "
                                    f"{_cfg(2)} AS config, {r6('rho')} AS rho FROM cf{i_ep}_0")
    o["config_grid"] = with_(c3 + [("kk", "SELECT count(DISTINCT rf) AS k0, count(DISTINCT ls) AS k1 FROM tr")],
                             "SELECT CAST(a.i AS INTEGER) AS rf, CAST(b.i AS INTEGER) AS ls, "
                             "CAST(a.i * kk.k1 + b.i AS BIGINT) AS idx FROM kk "
                             "CROSS JOIN LATERAL (SELECT unnest(range(0, kk.k0)) AS i) a "
                             "CROSS JOIN LATERAL (SELECT unnest(range(0, kk.k1)) AS i) b")
    o["config_grid_sizes"] = with_([LI, ("kk", "SELECT count(DISTINCT rf) AS k0, count(DISTINCT ls) AS k1, "
                                               "count(DISTINCT l_linenumber) AS k2 FROM li"),
                                   ("grid", "SELECT a.i AS rf, b.i AS ls, c.i AS ln, (a.i * kk.k1 + b.i) * kk.k2 + c.i AS idx "
                                            "FROM kk CROSS JOIN LATERAL (SELECT unnest(range(0, kk.k0)) AS i) a "
                                            "CROSS JOIN LATERAL (SELECT unnest(range(0, kk.k1)) AS i) b "
                                            "CROSS JOIN LATERAL (SELECT unnest(range(0, kk.k2)) AS i) c")],
                                  "SELECT 'rf,ls,l_linenumber' AS columns, count(*) AS n, CAST(max(idx) AS BIGINT) AS last, "
                                  "CAST(sum(rf + ls + ln) AS BIGINT) AS digits FROM grid "
                                  "UNION ALL SELECT 'rf,never', 0, NULL, NULL UNION ALL SELECT 'never', 0, NULL, NULL")
    bnd, cd = base("GD")
    pd_ = cd + bnd.param_ctes()
    i_nc = bnd.idx("n_chars")
    o["degenerate_params"] = with_(pd_, f"SELECT 'gauss_config' AS kind, 'n_chars' AS node, {_cfg(3)} AS config, "
                                        f"'n_chars' AS item, 'zero_sd' AS issue FROM gc{i_nc} WHERE sy <= 0 "
                                        f"UNION ALL SELECT 'coef', 'n_chars', {_cfg(3)}, 'half', "
                                        "CASE WHEN rho IS NULL OR isnan(rho) THEN 'undefined_rho' "
                                        f"ELSE 'rho_out_of_range' END FROM cf{i_nc}_0 "
                                        "WHERE rho IS NULL OR isnan(rho) OR abs(rho) >= 1")

    o["pdf_normal"] = with_(p4, f"SELECT l_orderkey, l_linenumber, l_quantity, "
                                f"{r6(logphi('l_quantity', 'g.m0', 'g.s0'))} AS log_pdf FROM te, g")
    o["pdf_bivariate"] = with_(p4, "SELECT l_orderkey, l_linenumber, " + r6(pair_term(
        "l_quantity", "g.m0", "g.s0", "l_extendedprice", "g.m1", "g.s1", "r.rho")) +
        f" AS log_pdf FROM te, g, cf{bn4.idx('l_extendedprice')}_0 r")
    o["factor_root_discrete"] = factor_sql("G1", "ls", ["l_orderkey", "l_linenumber", "ls"])
    o["factor_root_cont"] = factor_sql("G2", "l_tax", ["l_orderkey", "l_linenumber", "l_tax"])
    j2, t2 = bn2.terms("rf", 0.0, only="rf")
    o["factor_hybrid"] = with_(p2 + [("cands", f"SELECT DISTINCT v AS k FROM cpt{i_rf2}")],
                               f"SELECT t.l_orderkey, t.l_linenumber, c.k AS candidate, {r6(_plus(t2))} AS log_factor "
                               f"FROM te t CROSS JOIN cands c " + " ".join(j2))
    o["factor_cont_mixed"] = factor_sql("G3", "l_extendedprice", ["l_orderkey", "l_linenumber", "rf", "ls"])
    o["factor_cont_cont"] = factor_sql("G4", "l_extendedprice", ["l_orderkey", "l_linenumber"])
    o["factor_cont_discrete"] = factor_sql("G7", "o_totalprice", ["o_orderkey", "prio"])

    o["joint_score"] = with_(c2 + bn2.scored("te", "rf", 0.0),
                             f"SELECT l_orderkey, l_linenumber, k AS candidate, {r6('s')} AS score FROM sc")
    o["predict_with_labels"] = with_(c2 + bn2.scored("te", "rf", 0.0) + [bn2.best()],
                                     "SELECT l_orderkey, l_linenumber, CAST(rf AS DOUBLE) AS label, "
                                     "CAST(k AS DOUBLE) AS prediction FROM best")
    bns, cs = base("GS")
    unseen = ("te", "SELECT * REPLACE (CASE WHEN lang = 0 THEN source + 1000 ELSE source END AS source) FROM dl")
    o["predict_unseen_default"] = with_(
        cs[:-1] + [unseen] + bns.scored("te", "quality", 1e-5) + [bns.best()],
        f"SELECT doc_id, quality, k AS prediction, {r6('s')} AS score FROM best")
    o["predict_wide"] = predict_sql("G6", "label", ["vec_id", "label"])
    o["predict_chain"] = predict_sql("G7", "status", ["o_orderkey", "status"])
    o["predict_child"] = predict_sql("G5", "quality", ["doc_id", "quality", "toxic"])

    g2p = _g2_pred_ctes()
    o["confusion"] = with_(g2p, "SELECT label, prediction, count(*) AS n FROM preds GROUP BY label, prediction")
    o["metrics_accuracy"] = with_(g2p, f"SELECT {r6('avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END)')} "
                                       "AS accuracy FROM preds")
    o["metrics_per_label"] = with_(g2p + metrics_ctes("preds"),
                                   f"SELECT label, {r6('precision')} AS precision, {r6('recall')} AS recall, "
                                   f"{r6('f1')} AS f1 FROM met")
    mp = [
        f"SELECT 'cpt' AS kind, 'rf' AS node, '' AS config, CAST(v AS VARCHAR) AS item, 'n' AS stat, "
        f"CAST(n AS DOUBLE) AS value FROM cpt{bn3.idx('rf')}",
        f"SELECT 'cpt', 'rf', '', CAST(v AS VARCHAR), 'n_config', CAST(n_config AS DOUBLE) FROM cpt{bn3.idx('rf')}",
        f"SELECT 'cpt', 'rf', '', CAST(v AS VARCHAR), 'p', p FROM cpt{bn3.idx('rf')}",
        f"SELECT 'cpt', 'ls', '', CAST(v AS VARCHAR), 'n', CAST(n AS DOUBLE) FROM cpt{bn3.idx('ls')}",
        f"SELECT 'cpt', 'ls', '', CAST(v AS VARCHAR), 'n_config', CAST(n_config AS DOUBLE) FROM cpt{bn3.idx('ls')}",
        f"SELECT 'cpt', 'ls', '', CAST(v AS VARCHAR), 'p', p FROM cpt{bn3.idx('ls')}",
    ]
    for j, y in enumerate(bn3.net.continuous_nodes()):
        mp.append(f"SELECT 'gauss_root', '{y}', '', '{y}', 'mean', m{j} FROM g")
        mp.append(f"SELECT 'gauss_root', '{y}', '', '{y}', 'sd', s{j} FROM g")
    mp.append(f"SELECT 'gauss_config', 'l_extendedprice', {_cfg(2)}, 'l_extendedprice', 'mean', my FROM gc{i_ep}")
    mp.append(f"SELECT 'gauss_config', 'l_extendedprice', {_cfg(2)}, 'l_extendedprice', 'sd', sy FROM gc{i_ep}")
    mp.append(f"SELECT 'coef', 'l_extendedprice', {_cfg(2)}, 'l_quantity', 'rho', rho FROM cf{i_ep}_0")
    o["model_params"] = with_(p3, "SELECT kind, node, config, item, stat, " + r6("value") +
                              " AS value FROM (" + " UNION ALL ".join(mp) + ") u")

    zli = ("zli", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"(({c} - m_{c}) / NULLIF(s_{c}, 0)) AS {c}" for c in z)
                  + ", ls, rf FROM li, st")
    wsp = [LI, ("st", f"SELECT {zs} FROM li")] + _g2_pred_ctes(1e-5, zli, split=True)[1:]
    o["worksheet_evaluate"] = with_(
        [LI, ("st", f"SELECT {zs} FROM li"), zli] + wsp[2:] + metrics_ctes("preds")
        + [("acc", "SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS a FROM preds")],
        f"SELECT label, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, "
        f"{r6('acc.a')} AS accuracy FROM met, acc")
    bnn, cn = base("GN")
    o["predict_null_parent"] = with_(
        [LI] + cn + bnn.scored("te", "rf", 1e-5) + [bnn.best()],
        f"SELECT l_orderkey, l_linenumber, ls, rf, k AS prediction, {r6('s')} AS score FROM best")
    o["predict_many_classes"] = predict_sql("GM", "bucket", ["l_orderkey", "l_linenumber", "ls", "bucket"], 1e-5)
    bnw, cw = base("GW")
    i_y = bnw.idx("y")
    o["coef_wide"] = with_(cw + bnw.param_ctes(), " UNION ALL ".join(
        f"SELECT 'f{j}' AS parent, 'y' AS child, {_cfg(1)} AS config, {r6('rho')} AS rho FROM cf{i_y}_{j}" for j in range(64)))
    o["factor_wide_pairs"] = factor_sql("GW", "y", ["vec_id", "label"])
    o["standardize_wide"] = with_([EMB], "SELECT vec_id, " + ", ".join(
        f"{r6(f'(f{j} - (SELECT avg(f{j}) FROM {EMB[0]})) / (SELECT stddev_samp(f{j}) FROM {EMB[0]})')} AS f{j}"
        for j in range(64)) + f" FROM {EMB[0]}")
    bits = " || ".join(f"CAST(CAST(floor(l_partkey / {i + 1}) AS BIGINT) % 2 AS VARCHAR)" for i in range(70))
    o["cpt_wide_discrete"] = with_(
        [("w", f"SELECT {bits} AS config, CAST(l_linenumber % 2 AS INTEGER) AS value, count(*) AS n "
               "FROM lineitem GROUP BY 1, 2")],
        f"SELECT config, value, n, CAST(sum(n) OVER (PARTITION BY config) AS BIGINT) AS n_config, "
        f"{r6('n / sum(n) OVER (PARTITION BY config)')} AS p FROM w")
    return o
