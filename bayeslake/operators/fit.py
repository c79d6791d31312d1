"""Parameter learning as shared-scan grouped aggregates.

Every parameter of the network is an aggregate over some grouping of the
discrete columns:

* a discrete node x: counts grouped by its family (discrete parents + x);
* its continuous parents: mean and sample sd grouped by x alone;
* a continuous node y with discrete parents: mean and sd of y per
  configuration of those parents;
* the empty grouping: global mean / sd of every continuous node and, per
  continuous edge c -> y, the paired moments that give every correlation
  coefficient in closed form.

All groupings go into ONE ``GROUPING SETS`` aggregate (Spark's Expand +
partial HashAggregate), so the training data is scanned once per
``max_sets_per_scan`` groupings instead of once per node and per
configuration. Only the small aggregated result is shuffled. Its rows
become three long parameter tables:

    cpt(node, config array<int>, value int, n bigint, n_config bigint, p double)
    gauss(node, scope, config array<int>, dim, mean double, sd double)
        scope: root (global), config (per discrete configuration), class
    coef(parent, child, config array<int>, rho double)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.density import col
from ..functions.sqltext import q, s as lit_s
from ..plans.dag import Network
from ..session import compiled_in_parts, kept, remove_scratch, scratch_run
from . import moments

ARRAY_INT = "array<int>"


def config_sql(cols) -> str:
    return f"CAST(array({', '.join(q(c) for c in cols)}) AS {ARRAY_INT})"


def config_expr(cols) -> Column:
    return F.expr(config_sql(cols))


def no_null_config(c: Column) -> Column:
    return F.forall(c, lambda v: v.isNotNull())


def node_sql(net: Network, n: str) -> str:
    """A node in its role type: discrete -> int, continuous -> double, where
    NaN counts as missing (NULL) in training and in scoring."""
    if net.is_discrete(n):
        return f"CAST({q(n)} AS INT)"
    return f"nullif(CAST({q(n)} AS DOUBLE), CAST('NaN' AS DOUBLE))"


def prepare_frame(df: DataFrame, net: Network) -> DataFrame:
    return df.selectExpr(*[f"{node_sql(net, n)} AS {q(n)}" for n in net.nodes])


@dataclass
class _Grouping:
    key: tuple[str, ...]
    aggs: dict[str, str]      # name -> aggregate as SQL text
    scan: int = -1
    gid: int = -1


# From this many continuous nodes, or continuous edges, on, means, sds and
# coefficients come from mergeable summaries (operators.moments): one wide
# aggregate of 2 functions per node and 3 per edge generates code over the JIT
# size limit (measured at 256 features: ~0.75 ms per row and core, interpreted).
LONG_MOMENTS_MIN = 32
LONG_EDGES_MIN = 16


def uses_summaries(net: Network) -> bool:
    return len(net.continuous_nodes()) >= LONG_MOMENTS_MIN or len(net.continuous_edges()) >= LONG_EDGES_MIN


def _edge_nodes(net: Network) -> set:
    return {n for e in net.continuous_edges() for n in e}


def _plan_groupings(net: Network, counts_only: bool = False) -> list[_Grouping]:
    """One grouping per distinct key, with the aggregates it needs; with
    ``counts_only`` the moments come from summaries and the groupings count rows."""
    cont = net.continuous_nodes()
    cidx = {c: i for i, c in enumerate(cont)}

    def mean_sd(c):
        if counts_only:
            return {}
        i = cidx[c]
        return {f"m{i}": f"avg({q(c)})", f"s{i}": f"stddev_samp({q(c)})"}

    groups: dict[tuple[str, ...], dict[str, str]] = {}

    def need(key, aggs):
        groups.setdefault(tuple(key), {"n": "count(1)"}).update(aggs)

    # global grouping: always present (N, continuous roots, source moments)
    glob: dict[str, str] = {}
    for c in cont:
        glob.update(mean_sd(c))
    for i, (p, c) in enumerate(net.continuous_edges() if not counts_only else ()):
        x, y = q(p), q(c)
        glob[f"cv{i}"] = f"covar_pop({x}, {y})"
        glob[f"px{i}"] = f"avg(CASE WHEN {y} IS NOT NULL THEN {x} END)"
        glob[f"py{i}"] = f"avg(CASE WHEN {x} IS NOT NULL THEN {y} END)"
    need((), glob)

    for n in net.nodes:
        dpar = net.discrete_parents(n)
        if net.is_discrete(n):
            need(dpar + (n,), {})
            aggs = {}
            for c in net.continuous_parents(n):
                aggs.update(mean_sd(c))
            if aggs:
                need((n,), aggs)
        elif dpar and not counts_only:
            need(dpar, mean_sd(n))
    return [_Grouping(k, a) for k, a in groups.items()]


def _gid(key, cols) -> int:
    m = len(cols)
    return sum(1 << (m - 1 - i) for i, c in enumerate(cols) if c not in key)


def moment_groupings(net: Network) -> list[tuple[tuple[str, ...], list[int]]]:
    """Keys under which continuous moments are needed and the continuous nodes wanted
    there: the discrete parents of a continuous node, and a discrete node with
    continuous parents (its class moments)."""
    cidx = {c: i for i, c in enumerate(net.continuous_nodes())}
    wanted: dict[tuple[str, ...], dict[int, None]] = {}
    for n in net.nodes:
        if not net.is_discrete(n) and net.discrete_parents(n):
            wanted.setdefault(net.discrete_parents(n), {})[cidx[n]] = None
        elif net.is_discrete(n) and net.continuous_parents(n):
            wanted.setdefault((n,), {}).update(dict.fromkeys(cidx[c] for c in net.continuous_parents(n)))
    return [(k, list(js)) for k, js in wanted.items()]


def summary_stats(df: DataFrame, net: Network) -> tuple[DataFrame, list]:
    """Summaries of all moments and edges from one pass over the data, and the groupings
    they are numbered by; the roots have the number after the last grouping. NaN and NULL
    are both missing there, so columns go as they are, cast only where the type differs."""
    X = df.selectExpr(*[q(n) if net.is_discrete(n) is (t == "int") and t in ("int", "double")
                        else f"CAST({q(n)} AS {'INT' if net.is_discrete(n) else 'DOUBLE'}) AS {q(n)}"
                        for n, t in ((n, df.schema[n].dataType.simpleString()) for n in net.nodes)])
    cont = net.continuous_nodes()
    cidx = {c: i for i, c in enumerate(cont)}
    groupings = moment_groupings(net)
    edges = [(cidx[p], cidx[c]) for p, c in net.continuous_edges()]
    return moments.summarise(X, list(cont), groupings, len(groupings), edges), groupings


# GROUPING SETS numbers its sets with one bit per column of a 64-bit id.
MAX_SET_COLUMNS = 60
# The scan number of groupings that come from long_counts, and of the columns summed from those.
LONG_SCAN = -1
ROLLED_SCAN = -2


def _chunks(keys: list[tuple[str, ...]], max_sets: int, max_columns: int) -> list[list[tuple[str, ...]]]:
    """Groupings that share one scan: at most ``max_sets`` of them over at
    most ``max_columns`` columns; a grouping of more columns stands alone."""
    out: list[list[tuple[str, ...]]] = []
    cols: set[str] = set()
    for k in keys:
        if out and len(out[-1]) < max_sets and len(cols | set(k)) <= max_columns:
            out[-1].append(k)
            cols |= set(k)
        else:
            out.append([k])
            cols = set(k)
    return out


def long_counts(X: DataFrame, keys: list[tuple[str, ...]]) -> DataFrame:
    """(__set, __key array<int>, __n): rows per value of every grouping, in
    one scan however many groupings and columns there are. A row becomes one
    (set, values) pair per grouping; equal pairs combine map-side."""
    sets = ", ".join(f"named_struct('s', {i}, 'k', {config_sql(k)})" for i, k in enumerate(keys))
    if len(keys) == 1:
        pairs = X.select(F.lit(0).alias("__set"), config_expr(keys[0]).alias("__key"))
    else:
        pairs = X.select(F.expr(f"inline(array({sets}))").alias("__set", "__key"))
    return pairs.groupBy("__set", "__key").agg(F.count(F.lit(1)).alias("__n"))


def rolled_counts(counts: DataFrame, places: dict[str, tuple[int, int]]) -> DataFrame:
    """(node, value, __n) of single columns, summed from counts (__gid, __key, __n) that
    hold each of them: ``places`` gives a column's grouping and its place in that key."""
    at = F.posexplode("__key").alias("__pos", "value")
    nodes = ", ".join(f"struct({g}, {j}), {lit_s(c)}" for c, (g, j) in places.items())
    return (counts.filter(F.col("__gid").isin(sorted({g for g, _ in places.values()})))
            .select(F.col("__gid").cast("int").alias("__gid"), at, "__n")
            .groupBy("__gid", "__pos", "value").agg(F.sum("__n").alias("__n"))
            .withColumn("node", F.expr(f"map({nodes})[struct(__gid, __pos)]"))
            .filter(F.col("node").isNotNull()).select("node", "value", "__n"))


def shared_scan_stats(X: DataFrame, net: Network, max_sets_per_scan: int = 8,
                      counts_only: bool = False) -> tuple[DataFrame, dict]:
    """Aggregate every grouping; one scan per ``max_sets_per_scan`` groupings.

    Returns the unioned small result (columns: discrete nodes, ``scan``,
    ``gid``, statistics) and a map key -> (scan, gid). Groupings of which only
    the row count is wanted, when there are more than ``max_sets_per_scan`` in
    all, come from ``long_counts`` instead: one scan for all of them. Of these, a
    single column that a larger one holds is not counted from the rows again but
    summed from that one by ``rolled_counts``; its entry of the map is
    (ROLLED_SCAN, (gid, place)). The count of all rows, which nobody reads then, is left out.
    """
    groups = _plan_groupings(net, counts_only)
    rolled: dict[tuple[str, ...], tuple[int, int]] = {}
    if len(groups) > max_sets_per_scan:
        counted = [g for g in groups if len(g.aggs) == 1 and g.key]
        groups = [g for g in groups if len(g.aggs) > 1]
        larger = [g for g in counted if len(g.key) > 1]
        single = {g.key[0] for g in counted if len(g.key) == 1}
        for i, g in enumerate(larger):
            for j, c in enumerate(g.key):
                if c in single:
                    rolled.setdefault((c,), (i, j))
        counted = larger + [g for g in counted if len(g.key) == 1 and g.key not in rolled]
    else:
        counted = []
    order = {n: i for i, n in enumerate(net.nodes)}
    # deterministic: global first, then by key
    groups.sort(key=lambda g: (len(g.key) > 0, [order[c] for c in g.key]))
    by_key = {g.key: g for g in groups}
    parts = []
    for s, keys in enumerate(_chunks(list(by_key), max_sets_per_scan, MAX_SET_COLUMNS)):
        chunk = [by_key[k] for k in keys]
        cols = sorted({c for g in chunk for c in g.key}, key=order.__getitem__)
        aggs: dict[str, str] = {}
        for g in chunk:
            aggs.update(g.aggs)
            g.scan = s
            g.gid = _gid(g.key, cols) if len(chunk) > 1 else 0
        # prefixed: no clash with node names
        exprs = [F.expr(f"{e} AS {q('__' + a)}") for a, e in aggs.items()]
        if len(chunk) > 1:
            agg = X.groupingSets([list(g.key) for g in chunk], *[col(c) for c in cols]) \
                   .agg(F.grouping_id().alias("__gid"), *exprs)
        elif cols:
            agg = X.groupBy(*[col(c) for c in cols]).agg(*exprs).withColumn("__gid", F.lit(0).cast("long"))
        else:
            agg = X.agg(*exprs).withColumn("__gid", F.lit(0).cast("long"))
        parts.append(agg.withColumn("__scan", F.lit(s)))
    if counted:
        parts.append(long_counts(X, [g.key for g in counted]).select(
            "__key", "__n", F.col("__set").cast("long").alias("__gid"), F.lit(LONG_SCAN).alias("__scan")))
        for i, g in enumerate(counted):
            g.scan, g.gid = LONG_SCAN, i
    where = {g.key: (g.scan, g.gid) for g in groups + counted}
    return _union(parts, missing=True), where | {k: (ROLLED_SCAN, at) for k, at in rolled.items()}


@dataclass
class Model:
    """Fitted parameters: three small, persisted DataFrames plus the DAG."""
    network: Network
    cpt: DataFrame
    gauss: DataFrame
    coef: DataFrame
    sizes: dict  # (table, node) -> rows; metadata used for broadcast decisions
    scratch: tuple = ()  # folders that hold the parameters of a fitted, unsaved model

    def release(self) -> None:
        """Remove the parameters of a fitted model from the shared checkpoint folder,
        after its last reader. A saved copy stays; a loaded model has nothing to remove."""
        remove_scratch(self.cpt.sparkSession, self.scratch)
        self.scratch = ()

    def rows(self, table: str, node: str) -> int:
        return int(self.sizes.get((table, node), 0))

    def domain_size(self, node: str) -> int:
        """Distinct values of a discrete node, counted when first asked for."""
        if ("domain", node) not in self.sizes:
            self.sizes["domain", node] = self.cpt.filter(F.col("node") == node).select("value").distinct().count()
        return self.sizes["domain", node]

    def params(self) -> DataFrame:
        """All parameters in one long table (kind, node, config, item, stat, value)."""
        cfg = F.concat_ws(",", F.col("config").cast("array<string>"))
        a = self.cpt.select(F.lit("cpt").alias("kind"), "node", cfg.alias("config"),
                            F.col("value").cast("string").alias("item"),
                            F.inline(F.array(
                                F.struct(F.lit("n").alias("stat"), F.col("n").cast("double").alias("value")),
                                F.struct(F.lit("n_config").alias("stat"), F.col("n_config").cast("double").alias("value")),
                                F.struct(F.lit("p").alias("stat"), F.col("p").alias("value")))))
        b = self.gauss.select(F.concat(F.lit("gauss_"), F.col("scope")).alias("kind"), "node",
                              cfg.alias("config"), F.col("dim").alias("item"),
                              F.inline(F.array(
                                  F.struct(F.lit("mean").alias("stat"), F.col("mean").alias("value")),
                                  F.struct(F.lit("sd").alias("stat"), F.col("sd").alias("value")))))
        c = self.coef.select(F.lit("coef").alias("kind"), F.col("child").alias("node"),
                             cfg.alias("config"), F.col("parent").alias("item"),
                             F.lit("rho").alias("stat"), F.col("rho").alias("value"))
        return a.unionByName(b).unionByName(c)

    def save(self, path: str) -> None:
        """Write the model to a folder that does not hold one yet. An existing
        model is never overwritten: it may be the one that is being read."""
        spark = self.cpt.sparkSession
        self.cpt.write.mode("errorifexists").parquet(f"{path}/cpt")
        self.gauss.write.mode("errorifexists").parquet(f"{path}/gauss")
        self.coef.write.mode("errorifexists").parquet(f"{path}/coef")
        spark.createDataFrame([(self.network.to_json(),)], "network string") \
            .coalesce(1).write.mode("errorifexists").json(f"{path}/network")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Model":
        net = Network.from_json(spark.read.json(f"{path}/network").first()["network"])
        cpt = spark.read.parquet(f"{path}/cpt")
        gauss = spark.read.parquet(f"{path}/gauss")
        coef = spark.read.parquet(f"{path}/coef")
        return cls(net, cpt, gauss, coef, _sizes(cpt, gauss, coef))


def _sizes(cpt, gauss, coef) -> dict:
    """Rows per (table, node): one tiny aggregate, collected as metadata."""
    u = (cpt.select(F.lit("cpt").alias("t"), "node")
         .unionByName(gauss.select(F.concat(F.lit("gauss_"), "scope").alias("t"), "node"))
         .unionByName(coef.select(F.lit("coef").alias("t"), F.col("child").alias("node"))))
    return {(r["t"], r["node"]): r["n"] for r in u.groupBy("t", "node").agg(F.count(F.lit(1)).alias("n")).collect()}


def fit(df: DataFrame, edges, discrete=None, continuous=None, *,
        max_sets_per_scan: int = 8, persist: bool = True) -> Model:
    """Learn the parameters of the DAG ``edges`` over the columns of ``df``.

    Every column of ``df`` is a node. IntegerType columns are discrete,
    other numeric columns continuous, unless ``discrete`` / ``continuous``
    say otherwise.
    """
    net = Network.from_schema(df.schema, edges, discrete, continuous)
    if not persist:
        return _fit(df, net, max_sets_per_scan, None)
    # the grouped statistics are removed once the parameters are written
    with scratch_run(df.sparkSession) as run:
        return _fit(df, net, max_sets_per_scan, run)


def _fit(df: DataFrame, net: Network, max_sets_per_scan: int, run) -> Model:
    """``fit`` with its tables kept by ``run`` (None: lazy)."""
    X = prepare_frame(df, net)
    long_mode = uses_summaries(net)
    stats, where = shared_scan_stats(X, net, max_sets_per_scan, long_mode)
    if long_mode:
        lstats, groupings = summary_stats(df, net)
        lstats = moments.merge(kept(lstats))   # a few rows per task
    if run:
        # The grouped statistics (a few rows per grouping, tiny next to the
        # data) are written once to the shared checkpoint folder: one scan per
        # chunk of groupings with moments, one for the counts of many
        # families, and one for the long-form moments of a wide network. Every
        # parameter table below is derived from these tables, so concurrent
        # subquery stages never rescan the training data.
        if LONG_SCAN in {s for s, _ in where.values()}:
            with compiled_in_parts(df.sparkSession):   # many columns: see there
                stats = kept(stats)
        else:
            stats = kept(stats)
        if long_mode:
            lstats = kept(lstats)

    def rows(key):
        s, g = where[tuple(key)]
        return stats.filter((F.col("__scan") == s) & (F.col("__gid") == g))

    def family(dpar, x):
        """(config, value, n) of a discrete node."""
        return rows(dpar + (x,)).select(F.lit(x).alias("node"), config_expr(dpar).alias("config"),
                                        col(x).alias("value"), F.col("__n").alias("n"))

    def long_families(own, places):
        """(node, config, value, n) of all nodes whose families ``long_counts`` counted,
        by a grouping of their ``own`` or at a place of another, as two relations: a
        relation per node would read the counts once for each."""
        counts = stats.filter(F.col("__scan") == LONG_SCAN).select("__gid", "__key", "__n")
        if own:   # the groupings of long_counts are all families, numbered from 0
            nodes = "array(" + ", ".join(lit_s(x) for x in sorted(own, key=own.get)) + ")"
            yield counts.select(F.expr(f"element_at({nodes}, CAST(__gid AS INT) + 1)").alias("node"),
                                F.expr("slice(__key, 1, size(__key) - 1)").alias("config"),
                                F.element_at("__key", -1).alias("value"), F.col("__n").alias("n"))
        if places:
            rolled = rolled_counts(counts, places)
            yield (kept(rolled) if run else rolled).select("node", config_expr(()).alias("config"), "value",
                                                           F.col("__n").alias("n"))

    cont = net.continuous_nodes()
    cidx = {c: i for i, c in enumerate(cont)}
    eidx = {e: i for i, e in enumerate(net.continuous_edges())}
    glob = rows(()) if () in where else None   # left out where only counts are wanted

    # ---- cpt -------------------------------------------------------------
    fams, own, places = [], {}, {}
    for x in net.discrete_nodes():
        dpar = net.discrete_parents(x)
        scan, at = where[dpar + (x,)]
        if scan == LONG_SCAN:
            own[x] = at
        elif scan == ROLLED_SCAN:
            places[x] = at
        else:
            fams.append(family(dpar, x))
    if own or places:
        fams += long_families(own, places)
    if fams:
        cpt = _union(fams).filter(no_null_config(F.col("config")))
        # two-level: totals combine map-side, so a root's many values never meet in one task
        totals = cpt.groupBy("node", "config").agg(F.sum("n").alias("n_config"))
        cpt = (cpt.filter(F.col("value").isNotNull()).join(totals, ["node", "config"])
               .select("node", "config", "value", "n", "n_config")
               .withColumn("p", F.col("n") / F.col("n_config")))
    else:
        cpt = _empty(X.sparkSession, "node string, config array<int>, value int, n bigint, n_config bigint, p double")

    # ---- gauss -------------------------------------------------------------
    g_parts = []
    def gauss_rows(scope, node_of, cfg, dims, m, sd):
        """inline() of one struct per dimension, as one SQL expression."""
        return F.expr("inline(array(" + ", ".join(
            f"named_struct('node', {lit_s(node_of(d))}, 'scope', '{scope}', 'config', {cfg}, "
            f"'dim', {lit_s(d)}, 'mean', {m(d)}, 'sd', {sd(d)})" for d in dims) + "))")

    if long_mode:
        def of_columns(rows_of, js):
            """Rows of one grouping with the node's name, mean and sd."""
            names = "array(" + ", ".join(lit_s(cont[j]) for j in js) + ")"
            return rows_of.select("key", F.expr(f"element_at({names}, j + 1)").alias("dim"), F.col("a").alias("m"),
                                  moments.sample_sd(F.col("n"), F.col("c")).alias("s"))

        def long_rows(df, scope, node, m, s):
            return df.select(node.alias("node"), F.lit(scope).alias("scope"), F.col("key").alias("config"), "dim",
                             m.alias("mean"), s.alias("sd"))
        root = of_columns(lstats.filter(F.col("gid") == len(groupings)), range(len(cont)))
        g_parts.append(long_rows(root, "root", F.col("dim"), F.col("m"), F.coalesce("s", F.lit(1.0))))
        for g, (key, js) in enumerate(groupings):
            found = of_columns(lstats.filter(F.col("gid") == g), js)
            m0, s0 = F.coalesce("m", F.lit(0.0)), F.coalesce("s", F.lit(0.0))
            mine = [n for n in net.nodes if not net.is_discrete(n) and net.discrete_parents(n) == key]
            if mine:
                g_parts.append(long_rows(found.filter(F.col("dim").isin(mine)), "config", F.col("dim"), m0, s0))
            for n in net.nodes:
                if net.is_discrete(n) and key == (n,) and net.continuous_parents(n):
                    g_parts.append(long_rows(found.filter(F.col("dim").isin(list(net.continuous_parents(n)))),
                                             "class", F.lit(n), m0, s0))
    elif cont:
        g_parts.append(glob.select(gauss_rows(
            "root", lambda y: y, config_sql(()), cont,
            lambda y: f"CAST(`__m{cidx[y]}` AS DOUBLE)",
            lambda y: f"CAST(coalesce(`__s{cidx[y]}`, 1.0D) AS DOUBLE)")))
    for n in net.nodes if not long_mode else ():
        dpar = net.discrete_parents(n)
        if not net.is_discrete(n) and dpar:
            i = cidx[n]
            g_parts.append(rows(dpar).select(
                F.lit(n).alias("node"), F.lit("config").alias("scope"),
                config_expr(dpar).alias("config"), F.lit(n).alias("dim"),
                F.coalesce(F.col(f"__m{i}"), F.lit(0.0)).alias("mean"),
                F.coalesce(F.col(f"__s{i}"), F.lit(0.0)).alias("sd")))
        cpar = net.continuous_parents(n)
        if net.is_discrete(n) and cpar:
            g_parts.append(rows((n,)).select(gauss_rows(
                "class", lambda c, n=n: n, config_sql((n,)), cpar,
                lambda c: f"CAST(coalesce(`__m{cidx[c]}`, 0.0D) AS DOUBLE)",
                lambda c: f"CAST(coalesce(`__s{cidx[c]}`, 0.0D) AS DOUBLE)")))
    if g_parts:
        gauss = _union(g_parts).filter(no_null_config(F.col("config")))
    else:
        gauss = _empty(X.sparkSession, "node string, scope string, config array<int>, dim string, mean double, sd double")

    # ---- coef --------------------------------------------------------------
    c_parts = []
    if eidx and long_mode:
        c_parts.append(_edge_coefficients(net, gauss, lstats.filter(F.col("gid") == moments.EDGES)))
    elif eidx:
        names = [f"{a}{cidx[c]}" for c in cont if c in _edge_nodes(net) for a in ("m", "s")]
        names += [f"{a}{e}" for e in range(len(eidx)) for a in ("cv", "px", "py")]
        # one-row global statistics, attached as a scalar subquery
        gsub = glob.select(F.struct(*[F.col("__" + a).alias(a) for a in names]).alias("g")).scalar()
        gval = F.col("__g")
    for (p, y), e in eidx.items() if not long_mode else ():
        ip, iy = cidx[p], cidx[y]
        cv, px, py = gval[f"cv{e}"], gval[f"px{e}"], gval[f"py{e}"]
        mp = gval[f"m{ip}"]
        sp = F.coalesce(gval[f"s{ip}"], F.lit(1.0))
        dpar = net.discrete_parents(y)
        if not dpar:
            my = gval[f"m{iy}"]
            sy = F.coalesce(gval[f"s{iy}"], F.lit(1.0))
            src = glob
            cfg = F.array().cast(ARRAY_INT)
        else:
            my = F.coalesce(F.col(f"__m{iy}"), F.lit(0.0))
            sy = F.coalesce(F.col(f"__s{iy}"), F.lit(0.0))
            src = rows(dpar)
            cfg = config_expr(dpar)
        # mean over rows of (x - mx)(y - c) == covar_pop + (E[x] - mx)(E[y] - c),
        # the expectations taken over rows where both are present.
        num = cv + (px - mp) * (py - my)
        c_parts.append(src.withColumn("__g", gsub).select(F.lit(p).alias("parent"), F.lit(y).alias("child"),
                                  cfg.alias("config"),
                                  F.try_divide(num, sp * sy).alias("rho")))
    if c_parts:
        coef = _union(c_parts).filter(no_null_config(F.col("config")))
    else:
        coef = _empty(X.sparkSession, "parent string, child string, config array<int>, rho double")

    scratch = ()
    if run:
        # All parameters go to the shared checkpoint folder as ONE small long
        # table, and the three tables are projections of it: later plans that
        # read the model stay tiny and the model survives executor loss.
        allp = run.result(cpt.withColumn("t", F.lit("cpt"))
                          .unionByName(gauss.withColumn("t", F.lit("gauss")), allowMissingColumns=True)
                          .unionByName(coef.withColumn("t", F.lit("coef")), allowMissingColumns=True))
        scratch = (allp.scratch,)
        cpt = allp.filter(F.col("t") == "cpt").select(*cpt.columns)
        gauss = allp.filter(F.col("t") == "gauss").select(*gauss.columns)
        coef = allp.filter(F.col("t") == "coef").select(*coef.columns)
    sizes = _sizes(cpt, gauss, coef)
    return Model(net, cpt, gauss, coef, sizes, scratch)


def _edge_coefficients(net: Network, gauss: DataFrame, edges: DataFrame) -> DataFrame:
    """(parent, child, config, rho) of all continuous edges as one relation: the edges'
    paired moments, the parents' global ones and the children's for each configuration."""
    names = net.continuous_edges()
    ends = [F.expr("element_at(array(" + ", ".join(lit_s(e[k]) for e in names) + "), j + 1)") for k in (0, 1)]
    paired = edges.select(ends[0].alias("parent"), ends[1].alias("child"), F.col("a").alias("px"), F.col("b").alias("py"),
                          F.try_divide("c", "n").alias("cv"))
    root = gauss.filter(F.col("scope") == "root")
    parents = root.select(F.col("node").alias("parent"), F.col("mean").alias("mp"), F.col("sd").alias("sp"))
    plain = [c for c in net.continuous_nodes() if net.continuous_parents(c) and not net.discrete_parents(c)]
    children = gauss.filter((F.col("scope") == "config") | ((F.col("scope") == "root") & F.col("node").isin(plain)))
    children = children.select(F.col("node").alias("child"), "config", F.col("mean").alias("my"), F.col("sd").alias("sy"))
    num = F.col("cv") + (F.col("px") - F.col("mp")) * (F.col("py") - F.col("my"))
    return (paired.join(parents, "parent").join(children, "child")
            .select("parent", "child", "config", F.try_divide(num, F.col("sp") * F.col("sy")).alias("rho")))


def _empty(spark: SparkSession, ddl: str) -> DataFrame:
    """An empty frame of the given schema, planned in the JVM (no Python RDD)."""
    fields = [f.strip().split(" ", 1) for f in ddl.split(", ")]
    return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in fields])


def _union(parts, missing: bool = False):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=missing)
    return out
