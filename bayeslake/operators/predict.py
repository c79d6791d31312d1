"""Scoring: one map-side pass of lookup joins and column expressions.

For each scored row and each candidate value k of the output node, the
score is the sum of the log factors of every node. Factors that do not
mention the output node are computed once per row; only the output's own
factor and those of its discrete children are evaluated per candidate,
inside ``transform`` over the candidate array. The arg-max is
``array_max`` over ``struct(score, -k)``: highest score, lowest k on ties.

Parameter lookups are left equi-joins on the typed parent columns (NULL
never matches, so it takes the unseen rule). A lookup table is broadcast
only when its row count, recorded at fit time, keeps it under
``max_broadcast_bytes``. Beyond it, the frequent configurations of the scored
rows are found by a sketch of bounded size: their rows stay where they are and
look up a broadcast of those configurations only, and the others are shuffled,
so no hot key reaches one task, with or without AQE. One-row parameters (global
moments, the candidate list) are attached as scalar subqueries.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.density import (NEG_INF, class_density_term, col, inv_sd, log_const, log_norm_const,
                                 log_p, neg_inf, pair_density_term, safe_log)
from ..functions import sqltext as S
from ..functions.vectorized import (by_value, class_density_udf, class_log_density_sums,
                                    fixed_pair_density_udf, pair_density_udf, row_density_udf)
from ..session import kept
from .fit import Model, node_sql

DEFAULT_MAX_BROADCAST_BYTES = 64 << 20
# Above this many continuous parents, densities fold over arrays instead of
# one unrolled term per parent (keeps analysis and codegen size constant).
WIDE_FAN_IN = 8
# Small training domains of the output are scored as flat columns, one per
# candidate: plain arithmetic that whole-stage codegen compiles. The budget
# bounds the number of per-candidate terms so that the generated method stays
# small enough for the JVM to JIT-compile it (HotSpot interprets methods over
# 8000 bytes of bytecode; measured: ~300 bytes per term at 3 candidates, more
# with more candidates). Larger domains use the candidate-array path.
MAX_FLAT_CANDIDATES = 8
MAX_FLAT_TERMS = 20
# Wide fan-in: the class densities of all candidates are computed per Arrow
# batch (functions.vectorized) when the class moments, K x C numbers, stay
# under this many cells (3 x 8 bytes each travel in the task closure: at most
# 6 MiB; the reference's largest grid point, 250 features x 20 classes, is
# 5000 cells); beyond it the candidate-array path is used.
MAX_UDF_CELLS = 1 << 18
# Beyond it, cells (rows x features) of the row groups that meet a tile of classes.
TILE_CELLS = 1 << 21
# Wide discrete nodes scored with their own (looked-up) class moments: the
# per-row density sum is one Arrow-batched evaluation instead of an
# interpreted array fold.
VECTORIZE_ROW_DENSITIES = True


#: Beyond the broadcast limit: frequent configurations kept for each shuffle partition, and the
#: sketch's counters for each of them. A configuration with more than one row in
#: 1.5 * HEAVY_PER_PARTITION * partitions is found for certain (the sketch's error is 3.5 / (counters / 0.75)).
HEAVY_PER_PARTITION = 4
COUNTERS_PER_HEAVY = 8
MAX_HEAVY = 100_000


def _key_hash(keys: list[str]) -> Column:
    # integer codes of any width hash alike
    return F.xxhash64(*[col(k).cast("long") for k in keys])


def frequent_keys(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(__heavy): hashes of the most frequent configurations of ``keys``, at most ``most``.

    One pass over the key columns with a frequent-items sketch, merged from one of
    bounded size a task. The result is kept in the shared checkpoint folder: the
    rows are split by it twice, and both sides must see the same hashes.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = min(most, HEAVY_PER_PARTITION * n, MAX_HEAVY)
    hashes = df.select(_key_hash(keys).alias("__heavy"))
    top = hashes.agg(F.expr(f"approx_top_k(__heavy, {k}, {COUNTERS_PER_HEAVY * k})").alias("t"))
    return kept(top.select(F.explode("t.item").alias("__heavy")))


def lookup_join(df: DataFrame, table: DataFrame, keys: list[str], rows: int,
                width: int, max_broadcast_bytes: int, base: DataFrame | None = None) -> DataFrame:
    """Left join ``df`` to a parameter table unique on ``keys`` (integer codes).

    The broadcast side is bounded by the row count recorded at fit time. A table
    over the bound is split by the frequent configurations of ``base`` (the rows
    before any lookup; ``df`` by default): rows of these, NULL keys included, are joined in place
    to a broadcast of at most as many rows as the bound allows, the rest by a shuffle.
    """
    row_bytes = 8 * (len(keys) + width) + 48
    if rows * row_bytes <= max_broadcast_bytes:
        return df.join(F.broadcast(table), on=keys, how="left")
    most = max_broadcast_bytes // row_bytes
    if most < 1:
        return df.join(table, on=keys, how="left")
    heavy = F.broadcast(frequent_keys(df if base is None else base, keys, most))
    here = _key_hash(keys) == F.col("__heavy")
    few = F.broadcast(table.join(heavy, here, "left_semi"))
    return (df.join(heavy, here, "left_semi").join(few, on=keys, how="left")
            .unionByName(df.join(heavy, here, "left_anti").join(table, on=keys, how="left")))


@dataclass
class _Plan:
    df: DataFrame
    base: DataFrame | None = None  # the rows before any lookup
    tmp: list[str] = field(default_factory=list)
    indep: list[Column] = field(default_factory=list)
    dep: list[Callable[[Column, Column], Column]] = field(default_factory=list)
    # flat path: candidate values, and per-candidate terms j -> Column
    ks: list[int] | None = None
    flat: list[Callable[[int], Column]] = field(default_factory=list)
    # arg-max only: best (score, -value) given the row's other factors; or class tiles
    best: Callable[[Column], Column] | None = None
    tiled: bool = False


class Scorer:
    def __init__(self, model: Model, default_prob: float = 0.0,
                 max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES):
        self.m = model
        self.net = model.network
        self.default_prob = float(default_prob)
        self.log_default = log_const(self.default_prob)
        self.limit = max_broadcast_bytes
        self._ridx: dict = {}
        self._udf: dict = {}               # output -> classes of the vectorised path
        self._with_output: list[str] = []  # roots scored in the output's own evaluation

    # ---- shared one-row parameters --------------------------------------
    def _gm(self, node: str) -> tuple[Column, Column]:
        """Global mean and sd (F4/F6) of a continuous node."""
        j = self.net.continuous_nodes().index(node)
        return F.col("__blg")[f"m{j}"], F.col("__blg")[f"s{j}"]

    def _rho(self, parent: str, child: str) -> Column:
        """Coefficient of an edge whose child has no discrete parents (F7)."""
        return F.col("__blr")[f"r{self._ridx[(parent, child)]}"]

    def attach_globals(self, plan: _Plan) -> None:
        """One-row parameters as ONE scalar-subquery column each (a struct),
        so the subquery is planned once however many nodes read it."""
        cont = self.net.continuous_nodes()
        if cont:
            g = self.m.gauss.filter(F.col("scope") == "root")
            fields = []
            for j, y in enumerate(cont):
                hit = f"node = {S.s(y)}"
                fields += [f"max(CASE WHEN {hit} THEN mean END) AS m{j}",
                           f"max(CASE WHEN {hit} THEN sd END) AS s{j}",
                           # root density constants; sd <= 0 gives factor 1 (Q8)
                           f"max(CASE WHEN {hit} THEN {S.inv_sd('sd')} END) AS r{j}",
                           f"max(CASE WHEN {hit} THEN {S.log_norm_const('sd', '0.0D')} END) AS c{j}"]
            struct = F.expr("struct(" + ", ".join(fields) + ") AS g")
            plan.df = plan.df.withColumn("__blg", g.agg(struct).scalar())
            plan.tmp.append("__blg")
        es = [(p, c) for p, c in self.net.continuous_edges() if not self.net.discrete_parents(c)]
        self._ridx = {e: j for j, e in enumerate(es)}
        if es:
            k = self.m.coef.filter(F.size("config") == 0)
            r = k.agg(F.expr("struct(" + ", ".join(
                f"max(CASE WHEN parent = {S.s(p)} AND child = {S.s(c)} THEN rho END) AS r{j}"
                for (p, c), j in self._ridx.items()) + ") AS r")).scalar()
            plan.df = plan.df.withColumn("__blr", r)
            plan.tmp.append("__blr")

    def candidates(self, output: str) -> Column:
        """Training domain of the output node: sorted observed values."""
        return (self.m.cpt.filter(F.col("node") == output)
                .agg(F.array_sort(F.collect_set("value")).alias("c")).scalar())

    # ---- per-node lookup tables --------------------------------------------
    def _wide(self, node: str) -> bool:
        return len(self.net.continuous_parents(node)) > WIDE_FAN_IN

    def _class_moments(self, node: str, key: str) -> DataFrame:
        """Class moments of the continuous parents of discrete ``node``, one
        row per value of ``node``: columns {tag}m{j}, {tag}s{j}, or for a wide
        fan-in two arrays {tag}M, {tag}S in parent order."""
        cpar = self.net.continuous_parents(node)
        tag = self._tag(node)
        g = self.m.gauss.filter((F.col("node") == node) & (F.col("scope") == "class"))
        k = F.get(F.col("config"), 0).alias(key)
        if self._wide(node):
            names = F.expr("array(" + ", ".join(S.s(c) for c in cpar) + ")")
            lst = F.array_sort(F.collect_list(F.struct(
                F.array_position(names, F.col("dim")).alias("j"), "mean", "sd")))
            return g.groupBy(k).agg(lst.alias("l")).select(
                key, F.transform("l", lambda e: e["mean"]).alias(f"{tag}M"),
                F.transform("l", lambda e: e["sd"]).alias(f"{tag}S"))
        return g.groupBy(k).agg(*[F.expr(e) for j, c in enumerate(cpar) for e in (
            f"max(CASE WHEN dim = {S.s(c)} THEN mean END) AS {S.q(f'{tag}m{j}')}",
            f"max(CASE WHEN dim = {S.s(c)} THEN sd END) AS {S.q(f'{tag}s{j}')}")])

    def _tag(self, node: str) -> str:
        return f"__bl{self.net.nodes.index(node)}_"

    def _row_values(self, plan: _Plan, node: str) -> None:
        """Wide fan-in: pack the continuous parents of ``node`` into one array."""
        if self._wide(node):
            name = f"{self._tag(node)}x"
            plan.df = plan.df.withColumn(name, F.expr("array(" + ", ".join(
                f"CAST({S.q(c)} AS DOUBLE)" for c in self.net.continuous_parents(node)) + ")"))
            plan.tmp.append(name)

    def _density_sum(self, node: str, field: Callable[[str], Column]) -> Column:
        """Sum of the class log densities of the continuous parents of
        ``node``; ``field(name)`` resolves a class-moment column. A wide
        fan-in folds over arrays so the plan does not grow with the width."""
        cpar = self.net.continuous_parents(node)
        tag = self._tag(node)
        if self._wide(node) and field is F.col and VECTORIZE_ROW_DENSITIES:
            # the row's own class moments (looked up): one Arrow-batched sum
            return row_density_udf(len(cpar))(F.col(f"{tag}x"), F.col(f"{tag}M"), F.col(f"{tag}S"))
        if self._wide(node):
            M, SD, xs = field(f"{tag}M"), field(f"{tag}S"), F.col(f"{tag}x")
            return F.aggregate(F.sequence(F.lit(0), F.lit(len(cpar) - 1)), F.lit(0.0),
                               lambda acc, j: acc + class_density_term(xs[j], M[j], SD[j]))
        if field is F.col:   # row columns: one SQL expression for all parents
            return F.expr(S.total([S.class_density(S.q(c), S.q(f"{tag}m{j}"), S.q(f"{tag}s{j}"))
                                   for j, c in enumerate(cpar)]))
        return _sum([class_density_term(col(c), field(f"{tag}m{j}"), field(f"{tag}s{j}"))
                     for j, c in enumerate(cpar)])

    def node_term(self, plan: _Plan, node: str) -> None:
        """Add the row's own log factor of ``node`` (no candidate) to ``plan.indep``."""
        net, m, tag = self.net, self.m, self._tag(node)
        dpar, cpar = net.discrete_parents(node), net.continuous_parents(node)
        if net.is_discrete(node):
            rows = m.rows("cpt", node)
            t = m.cpt.filter(F.col("node") == node).select(
                *[F.get(F.col("config"), i).alias(d) for i, d in enumerate(dpar)],
                F.col("value").alias(node), log_p(F.col("p")).alias(f"{tag}lp"))
            if cpar:
                t = t.join(self._class_moments(node, node), on=[node], how="left")
                self._row_values(plan, node)
            plan.df = lookup_join(plan.df, t, list(dpar) + [node], rows, 1 + 2 * len(cpar), self.limit, plan.base)
            plan.tmp += [c for c in t.columns if c.startswith(tag)]
            lp = F.col(f"{tag}lp")
            if not dpar and not cpar:
                plan.indep.append(F.coalesce(lp, neg_inf()))   # F9: unseen root value -> 0
            else:
                dens = self._density_sum(node, F.col)
                plan.indep.append(F.coalesce(lp + dens, self.log_default))
            return
        if not cpar:
            if not dpar:                                                       # F10
                j = self.net.continuous_nodes().index(node)
                plan.indep.append(S.pre_density(S.q(node), f"`__blg`.m{j}", f"`__blg`.r{j}", f"`__blg`.c{j}"))
            return                                                             # F13: factor 1
        if self._wide(node):
            self._wide_pair_term(plan, node, dpar, cpar, tag)
            return
        my, sy = self._gm(node)
        if not dpar:                                                           # F12, global moments
            terms = []
            for c in cpar:
                mc, sc = self._gm(c)
                terms.append(pair_density_term(col(c), mc, sc, col(node), my, sy, self._rho(c, node)))
            plan.indep.append(_sum(terms))
            return
        # F12 per configuration of the discrete parents
        g = m.gauss.filter((F.col("node") == node) & (F.col("scope") == "config")).select(
            *[F.get(F.col("config"), i).alias(d) for i, d in enumerate(dpar)],
            F.col("mean").alias(f"{tag}my"), F.col("sd").alias(f"{tag}sy"))
        r = m.coef.filter(F.col("child") == node).groupBy(
            *[F.get(F.col("config"), i).alias(d) for i, d in enumerate(dpar)]).agg(*[
                F.max(F.when(F.col("parent") == c, F.col("rho"))).alias(f"{tag}r{j}")
                for j, c in enumerate(cpar)])
        t = g.join(r, on=list(dpar), how="left")
        plan.df = lookup_join(plan.df, t, list(dpar), m.rows("gauss_config", node),
                              2 + len(cpar), self.limit, plan.base)
        plan.tmp += [c for c in t.columns if c.startswith(tag)]
        terms = []
        for j, c in enumerate(cpar):
            mc, sc = self._gm(c)
            terms.append(pair_density_term(col(c), mc, sc, col(node), F.col(f"{tag}my"),
                                           F.col(f"{tag}sy"), F.col(f"{tag}r{j}")))
        plan.indep.append(F.when(F.col(f"{tag}my").isNull(), self.log_default).otherwise(_sum(terms)))

    def _wide_pair_term(self, plan: _Plan, node: str, dpar, cpar, tag: str) -> None:
        """F12 of a continuous node with many continuous parents: one Arrow-batched
        evaluation fed by an array of coefficients, looked up per configuration. The
        constants are one (mean, sd) row per parent."""
        m = self.m
        g = {r["node"]: (r["mean"], r["sd"]) for r in m.gauss.filter(
            (F.col("scope") == "root") & F.col("node").isin([*cpar, node])).select("node", "mean", "sd").collect()}
        nan = float("nan")
        mx, sx = (np.array([nan if g[c][a] is None else g[c][a] for c in cpar], float) for a in (0, 1))
        self._row_values(plan, node)
        xs, y = F.col(f"{tag}x"), col(node)
        names = F.expr("array(" + ", ".join(S.s(c) for c in cpar) + ")")
        r = m.coef.filter(F.col("child") == node)
        if not dpar:
            rho = {e["parent"]: e["rho"] for e in r.select("parent", "rho").collect()}     # one row per parent
            fixed = np.array([nan if rho.get(c) is None else rho[c] for c in cpar], float)
            my, sy = (nan if v is None else float(v) for v in g[node])
            plan.df = plan.df.withColumn(f"{tag}P", fixed_pair_density_udf(mx, sx, my, sy, fixed)(xs, y))
            plan.tmp.append(f"{tag}P")
            plan.indep.append(F.col(f"{tag}P"))
            return
        keys = [F.get(F.col("config"), i).alias(d) for i, d in enumerate(dpar)]
        moments = m.gauss.filter((F.col("node") == node) & (F.col("scope") == "config")).select(
            *keys, F.col("mean").alias(f"{tag}my"), F.col("sd").alias(f"{tag}sy"))
        rows = F.array_sort(F.collect_list(F.struct(F.array_position(names, F.col("parent")).alias("j"), "rho")))
        arrays = r.groupBy(*keys).agg(rows.alias("l")).select(
            *[col(d) for d in dpar], F.transform("l", lambda e: e["rho"]).alias(f"{tag}R"))
        t = moments.join(arrays, on=list(dpar), how="left")
        plan.df = lookup_join(plan.df, t, list(dpar), m.rows("gauss_config", node), 2 + len(cpar), self.limit, plan.base)
        my, sy, rho = (F.col(f"{tag}{a}") for a in ("my", "sy", "R"))
        plan.df = plan.df.withColumn(f"{tag}P", pair_density_udf(mx, sx)(xs, y, my, sy, rho))
        plan.tmp += [f"{tag}{a}" for a in ("my", "sy", "R", "P")]
        plan.indep.append(F.when(my.isNull(), self.log_default).otherwise(F.col(f"{tag}P")))

    def output_term(self, plan: _Plan, output: str, cands: Column) -> None:
        """Log factor of the output node itself, per candidate (F9 / F11)."""
        net, m, tag = self.net, self.m, self._tag(output)
        dpar, cpar = net.discrete_parents(output), net.continuous_parents(output)
        cp = m.cpt.filter(F.col("node") == output)
        t = self._dense_log_p(cp, [F.get(F.col("config"), i) for i in range(len(dpar))],
                              self._cands, f"{tag}lp")
        if dpar:
            t = t.select(*[F.col(f"__k{i}").alias(d) for i, d in enumerate(dpar)], f"{tag}lp")
            # one dense row per configuration: as wide as there are candidates
            plan.df = lookup_join(plan.df, t, list(dpar), m.rows("cpt", output), self._n_cands(output), self.limit, plan.base)
        else:
            # one-row parameter: a scalar subquery, held in a column because
            # subqueries may not appear inside higher-order functions
            plan.df = plan.df.withColumn(f"{tag}lp", t.scalar())
        plan.tmp.append(f"{tag}lp")
        lp = F.col(f"{tag}lp")
        udf_ks = self._udf_classes(output)
        if udf_ks:
            # wide fan-in: all K class density sums of a row from one
            # Arrow-batched numpy evaluation (the class moments, K x C
            # numbers within MAX_UDF_CELLS, are the UDF's constants)
            self._class_densities(plan, output, udf_ks)
            known = F.array(*[F.lit(k) for k in udf_ks])
        elif cpar:
            mom = self._class_moments(output, "k")
            mm = mom.agg(F.map_from_entries(F.collect_list(
                F.struct("k", F.struct(*[c for c in mom.columns if c != "k"])))).alias("mm"))
            self._row_values(plan, output)
            if self._train_cands is not None:
                # training candidates are known to the model: align the class
                # moments with them once, inside the one-row subquery
                aligned = (mm.withColumn("c", self._train_cands)
                           .select(F.transform("c", lambda k: F.col("mm")[k]).alias("ma")).scalar())
                plan.df = plan.df.withColumn(f"{tag}ma", aligned)
                plan.tmp.append(f"{tag}ma")
            else:
                plan.df = plan.df.withColumn(f"{tag}mm", mm.scalar())
                # align the class moments with the candidate array
                plan.df = plan.df.withColumn(f"{tag}ma", F.transform(cands, lambda k: F.col(f"{tag}mm")[k]))
                plan.tmp += [f"{tag}mm", f"{tag}ma"]
        is_root = not dpar and not cpar

        def term(k: Column, i: Column) -> Column:
            p = F.get(lp, i)
            if is_root:
                return F.coalesce(p, neg_inf())
            if udf_ks and self._train_cands is not None:
                dens = F.col(f"{tag}D")[i]        # same sorted domain as the candidates
            elif udf_ks:
                pos = F.array_position(known, k).cast("int")
                dens = F.when(pos > 0, F.element_at(F.col(f"{tag}D"), pos)).otherwise(neg_inf())
            else:
                ma = F.col(f"{tag}ma")[i] if cpar else None
                dens = self._density_sum(output, lambda name: ma[name])
            return F.when(p.isNull(), self.log_default).otherwise(p + dens)
        plan.dep.append(term)

    # ---- arg-max without a score per class -------------------------------------
    def _domain_table(self, output: str) -> DataFrame:
        """(value, rank): the training domain in order."""
        one = self.m.cpt.sparkSession.range(1).select(self.candidates(output).alias("c"))
        return one.select(F.posexplode("c").alias("rank", "value"))

    def observed_best(self, plan: _Plan, output: str) -> None:
        """Arg-max of an output with discrete parents and no discrete children.

        A configuration saw only some classes; all others score ``default_prob``, so of
        them only the lowest value counts: the first gap in the ranks of those seen. The
        lookup table has for each configuration that gap and the seen classes, with
        their class moments; without continuous parents the best seen class is known
        beforehand. A row costs the classes seen under its configuration, not the domain.
        """
        net, m, tag = self.net, self.m, self._tag(output)
        dpar, cpar = net.discrete_parents(output), net.continuous_parents(output)
        names = [f"__k{i}" for i in range(len(dpar))]
        domain = self._domain_table(output)
        cp = m.cpt.filter(F.col("node") == output).select(
            *[F.get(F.col("config"), i).alias(k) for i, k in enumerate(names)], "value", log_p(F.col("p")).alias("lp"))
        cp = cp.join(domain, "value")                          # parameter tables
        narrow = bool(cpar) and not self._wide(output)
        if narrow:
            cp = cp.join(self._class_moments(output, "value"), "value", "left")
        extra = [c for j in range(len(cpar)) for c in (f"{tag}m{j}", f"{tag}s{j}")] if narrow else []
        seen = F.array_sort(F.collect_list(F.struct("rank", "value", "lp", *extra)))
        t = (cp.groupBy(*names).agg(seen.alias("seen"))
             .withColumn("gap", F.aggregate("seen", F.lit(0), lambda at, e: F.when(e["rank"] == at, at + 1).otherwise(at)))
             .join(domain.select(F.col("rank").alias("gap"), F.col("value").alias(f"{tag}G")), "gap", "left").drop("gap"))
        if cpar:
            t = t.withColumnRenamed("seen", f"{tag}E")
            width = 3 + len(extra)
        else:
            t = t.withColumn(f"{tag}E", F.array_max(F.transform("seen", lambda e: F.struct(
                e["lp"].alias("s"), (-e["value"]).alias("nk"))))).drop("seen")
            width = 3
        t = t.select(*[F.col(k).alias(d) for k, d in zip(names, dpar)], f"{tag}E", f"{tag}G")
        plan.df = lookup_join(plan.df, t, list(dpar), m.rows("cpt", output), width, self.limit, plan.base)
        plan.tmp += [f"{tag}E", f"{tag}G"]
        lowest = m.cpt.filter(F.col("node") == output).agg(F.min("value").alias("v")).scalar()
        plan.df = plan.df.withColumn(f"{tag}V", lowest)
        plan.tmp.append(f"{tag}V")
        E, gap, first = F.col(f"{tag}E"), F.col(f"{tag}G"), F.col(f"{tag}V")
        if cpar and not narrow:
            self._class_densities(plan, output, self._udf_classes(output))

        def best(base: Column) -> Column:
            def scored(e):
                dens = F.lit(0.0)
                if narrow:
                    dens = self._density_sum(output, lambda name: e[name])
                elif cpar:
                    dens = F.get(F.col(f"{tag}D"), e["rank"])
                return F.struct(_sum([base, e["lp"] + dens]).alias("s"), (-e["value"]).alias("nk"))
            if cpar:
                of_seen = F.array_max(F.transform(E, scored))
            else:
                of_seen = F.when(E.isNotNull(), F.struct((base + E["s"]).alias("s"), E["nk"].alias("nk")))
            # a configuration not seen at all: the lowest class; where every class scores 0 too
            unseen = F.when(E.isNull(), first).otherwise(gap)
            of_unseen = F.when(unseen.isNotNull(), F.struct((base + self.log_default).alias("s"), (-unseen).alias("nk")))
            none = F.when(base == NEG_INF, F.struct(neg_inf().alias("s"), (-first).alias("nk")))
            return F.greatest(of_seen, of_unseen, none)
        plan.best = best

    def _class_densities(self, plan: _Plan, output: str, classes: list[int]) -> None:
        """{tag}D: the density sums of ``classes`` by one Arrow-batched evaluation; the continuous
        roots that were left to it are one more row of the class matrix, so that the values
        they share with the output's parents go to Python once."""
        cpar, tag = self.net.continuous_parents(output), self._tag(output)
        K = self._class_consts(output, classes)
        mat = [np.array([[K[(j, i)][a] for i in range(len(cpar))] for j in range(len(classes))]) for a in range(3)]
        columns = list(cpar)
        if self._with_output:
            columns += [n for n in self._with_output if n not in cpar]
            mat = [np.pad(a, ((0, 1), (0, len(columns) - len(cpar)))) for a in mat]
            for a, v in zip(mat, self._root_consts(self._with_output)):
                a[-1, [columns.index(n) for n in self._with_output]] = v
        values = F.expr("array(" + ", ".join(f"CAST({S.q(c)} AS DOUBLE)" for c in columns) + ")")
        plan.df = plan.df.withColumn(f"{tag}D", class_density_udf(*mat)(values))
        plan.tmp.append(f"{tag}D")
        if self._with_output:
            plan.indep.append(F.get(F.col(f"{tag}D"), len(classes)))

    def tiled_best(self, rows: DataFrame, output: str) -> DataFrame:
        """``rows`` (with their other factors in __indep) plus __best, for an output whose only
        parents are continuous and whose class moments are too many for one task.

        The moments are cut into tiles of classes, the rows into groups; each pair is
        one evaluation that keeps the best class of the tile, and Spark keeps the best
        over the tiles. The rows are written once, so that their numbers hold.
        """
        net, m, tag = self.net, self.m, self._tag(output)
        cpar = net.continuous_parents(output)
        rows = kept(rows.withColumn("__rid", F.monotonically_increasing_id()))
        groups = -(-rows.count() // max(1, TILE_CELLS // len(cpar))) or 1
        tiles = -(-m.domain_size(output) * len(cpar) // MAX_UDF_CELLS)
        moments = self._class_moments(output, "value").join(
            m.cpt.filter(F.col("node") == output).select("value", log_p(F.col("p")).alias("lp")), "value")
        classes = moments.select(
            F.pmod(F.xxhash64("value"), F.lit(tiles)).cast("int").alias("tile"), "value", "lp",
            F.col(f"{tag}M").alias("M"), F.col(f"{tag}S").alias("S"),
            F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
        values = rows.select(
            F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), (F.col("__rid") % groups).cast("int").alias("g"),
            "__rid", F.expr("array(" + ", ".join(f"CAST({S.q(c)} AS DOUBLE)" for c in cpar) + ")").alias("x"))
        found = (values.groupBy("tile", "g").cogroup(classes.groupBy("tile", "g"))
                 .applyInArrow(tile_best(len(cpar)), "__rid long, s double, nk int"))
        best = found.groupBy("__rid").agg(F.max(F.struct("s", "nk")).alias("__of"))
        lowest = m.cpt.filter(F.col("node") == output).agg(F.min("value").alias("v")).scalar()
        return (rows.join(best, "__rid", "left").withColumn("__low", lowest)
                .withColumn("__best", F.when(F.col("__indep") == NEG_INF, F.struct(neg_inf().alias("s"), (-F.col("__low")).alias("nk")))
                            .otherwise(F.struct((F.col("__indep") + F.col("__of.s")).alias("s"), F.col("__of.nk").alias("nk"))))
                .drop("__rid", "__of", "__low"))

    def child_term(self, plan: _Plan, node: str, output: str) -> None:
        """Log factor of a discrete child of the output, per candidate (F11)."""
        net, m, tag = self.net, self.m, self._tag(node)
        dpar, cpar = net.discrete_parents(node), net.continuous_parents(node)
        pos = dpar.index(output)
        others = [d for d in dpar if d != output]
        cp = m.cpt.filter(F.col("node") == node)
        # here the candidate is one of the parents: ln P(value | candidate, others)
        keys = [F.get(F.col("config"), dpar.index(d)) for d in others] + [F.col("value")]
        per = cp.select(*[k.alias(f"__o{i}") for i, k in enumerate(keys)],
                        F.get(F.col("config"), pos).alias("value"), "p")
        t = self._dense_log_p(per, [F.col(f"__o{i}") for i in range(len(keys))], self._cands, f"{tag}lp")
        t = t.select(*[F.col(f"__k{i}").alias(d) for i, d in enumerate(others + [node])], f"{tag}lp")
        if cpar:
            t = t.join(self._class_moments(node, node), on=[node], how="left")
            self._row_values(plan, node)
        plan.df = lookup_join(plan.df, t, others + [node], m.rows("cpt", node),
                              self._n_cands(output) + 2 * len(cpar), self.limit, plan.base)
        plan.tmp += [c for c in t.columns if c.startswith(tag)]
        dens = self._density_sum(node, F.col)
        if cpar:
            plan.df = plan.df.withColumn(f"{tag}d", dens)
            plan.tmp.append(f"{tag}d")
            dens = F.col(f"{tag}d")
        lp = F.col(f"{tag}lp")

        def term(k: Column, i: Column) -> Column:
            p = F.get(lp, i)
            return F.when(p.isNull(), self.log_default).otherwise(p + dens)
        plan.dep.append(term)

    def _n_cands(self, output: str) -> int:
        """Values of the output in the model: the width of a dense row."""
        return max(8, self.m.domain_size(output))

    def _udf_classes(self, output: str) -> list[int] | None:
        """Training domain of a wide output whose class moments fit the vectorised path."""
        cpar = self.net.continuous_parents(output)
        if not cpar or not self._wide(output):
            return None
        if output not in self._udf:
            self._udf[output] = self.train_domain(output, max(1, MAX_UDF_CELLS // len(cpar)))
        return self._udf[output]

    def _root_consts(self, roots: list[str]) -> list[np.ndarray]:
        """(mean, 1/sd, constant) of continuous roots: one row per root, read from the model."""
        g = (self.m.gauss.filter((F.col("scope") == "root") & F.col("node").isin(roots))
             .select("node", "mean", inv_sd(F.col("sd")).alias("r"),
                     log_norm_const(F.col("sd"), F.lit(0.0)).alias("c")))
        got = {r["node"]: r for r in g.collect()}
        return [np.array([float(got[n][a]) if n in got and got[n][a] is not None else 0.0 for n in roots])
                for a in ("mean", "r", "c")]

    def roots_term(self, plan: _Plan, roots: list[str]) -> None:
        """Log factors (F10) of many continuous roots in one Arrow-batched
        evaluation: their sum as generated code would exceed the JIT limit."""
        mat = [v[None] for v in self._root_consts(roots)]
        plan.df = plan.df.withColumn("__blroots", class_density_udf(*mat)(
            F.expr("array(" + ", ".join(f"CAST({S.q(n)} AS DOUBLE)" for n in roots) + ")")))
        plan.tmp.append("__blroots")
        plan.indep.append(F.col("__blroots")[0])

    def _scored_nodes(self, plan: _Plan, output: str) -> list[str]:
        """Nodes left for per-node terms, after many continuous roots (not
        children of the output) were scored together, with the output's class
        densities where those are evaluated in Python anyway."""
        net = self.net
        roots = [n for n in net.nodes if n != output and not net.is_discrete(n) and not net.parents[n]]
        if len(roots) > WIDE_FAN_IN:
            if self._udf_classes(output):
                self._with_output = roots
            else:
                self.roots_term(plan, roots)
            return [n for n in net.nodes if n not in roots]
        return list(net.nodes)

    # ---- flat path: one score column per candidate -------------------------
    def domain(self, output: str) -> list[int] | None:
        """The output's training domain as literals when it is small enough
        for the flat path, else None. Reads at most MAX_FLAT_CANDIDATES + 1
        values of the checkpointed model (metadata, like ``pivot``'s)."""
        if self._wide(output):
            return None
        ks = self.train_domain(output, MAX_FLAT_CANDIDATES)
        if ks is None:
            return None
        terms = len(ks) * (1 + len(self.net.continuous_parents(output))
                           + sum(1 for c in self.net.children(output) if self.net.depends_on(c, output)))
        if not ks or self._wide(output) or terms > MAX_FLAT_TERMS:
            return None
        return ks

    def train_domain(self, output: str, limit: int) -> list[int] | None:
        """Sorted training domain of the output if it has at most ``limit``
        values (at most limit + 1 values of the model are read), else None."""
        cp = self.m.cpt.filter(F.col("node") == output).select("value").distinct()
        ks = sorted(int(r[0]) for r in cp.limit(limit + 1).collect())
        return ks if len(ks) <= limit else None

    @staticmethod
    def _log_p() -> Column:
        return log_p(F.col("p"))

    def _class_consts(self, node: str, ks: list[int]) -> dict:
        """Class moments of the continuous parents of ``node`` for each
        candidate, pre-transformed for ``-0.5 ((x - m) r)^2 + c`` with
        ``r = 1/sd``, ``c = -ln sd - ln(2 pi)/2`` (sd <= 0 or missing: r = 0,
        c = -inf, i.e. factor 0). The rows of exactly these candidates are
        read, at most MAX_FLAT_TERMS of them on the flat path and
        MAX_UDF_CELLS on the wide one; the table may hold other classes, seen
        only with a NULL parent."""
        cpar = self.net.continuous_parents(node)
        g = (self.m.gauss.filter((F.col("node") == node) & (F.col("scope") == "class"))
             .select(F.get(F.col("config"), 0).alias("k"), "dim", "mean",
                     inv_sd(F.col("sd")).alias("r"), log_norm_const(F.col("sd"), neg_inf()).alias("c"))
             .filter(F.col("k").isin(ks)))
        got = {(r["k"], r["dim"]): r for r in g.collect()}
        missing = [(k, c) for k in ks for c in cpar if (k, c) not in got]
        if missing:
            raise ValueError(f"the model has no moments of {node!r} for {missing[:3]}")
        return {(j, i): (got[k, c]["mean"], got[k, c]["r"], got[k, c]["c"])
                for j, k in enumerate(ks) for i, c in enumerate(cpar)}

    def _dense_log_p(self, cp: DataFrame, keys: list, cands: Column, name: str) -> DataFrame:
        """One row per value of ``keys`` with ``name``: ln p of every candidate
        in order, NULL where the family is unseen. Scored rows then read the
        i-th entry instead of searching a map for each candidate."""
        if not keys and self._train_cands is not None:
            # the candidates are the observed values themselves
            lps = F.array_sort(F.collect_list(F.struct("value", log_p(F.col("p")).alias("lp"))))
            return cp.agg(F.transform(lps, lambda e: e["lp"]).alias(name))
        at = [F.col(f"__k{i}") for i in range(len(keys))]
        seen = cp.select(*[k.alias(f"__k{i}") for i, k in enumerate(keys)], F.col("value").alias("__v"),
                         log_p(F.col("p")).alias("__lp"))
        one = seen.select(*at).distinct() if keys else cp.sparkSession.range(1).select()
        grid = one.withColumn("__c", cands).select(*at, F.posexplode("__c").alias("__i", "__v"))
        on = [f"__k{i}" for i in range(len(keys))] + ["__v"]
        lps = F.array_sort(F.collect_list(F.struct("__i", "__lp")))
        return (grid.join(seen, on, "left").groupBy(*at).agg(lps.alias("__l"))
                .select(*at, F.transform("__l", lambda e: e["__lp"]).alias(name)))

    def output_term_flat(self, plan: _Plan, output: str, ks: list[int]) -> None:
        """Log factor of the output node for each literal candidate (F9 / F11)."""
        net, m, tag = self.net, self.m, self._tag(output)
        dpar, cpar = net.discrete_parents(output), net.continuous_parents(output)
        cp = m.cpt.filter(F.col("node") == output)
        logs = [F.max(F.when(F.col("value") == k, self._log_p())).alias(f"{tag}l{j}")
                for j, k in enumerate(ks)]
        if dpar:
            t = cp.groupBy(*[F.get(F.col("config"), i).alias(d) for i, d in enumerate(dpar)]).agg(*logs)
            plan.df = lookup_join(plan.df, t, list(dpar), m.rows("cpt", output), len(ks), self.limit, plan.base)
            plan.tmp += [f"{tag}l{j}" for j in range(len(ks))]

            def lp(j):
                return F.col(f"{tag}l{j}")
        else:
            plan.df = plan.df.withColumn(f"{tag}L", cp.agg(F.struct(*logs).alias("s")).scalar())
            plan.tmp.append(f"{tag}L")

            def lp(j):
                return F.col(f"{tag}L")[f"{tag}l{j}"]
        if not dpar and not cpar:
            plan.flat.append(lambda j: F.coalesce(lp(j), neg_inf()))       # F9: unseen -> 0
            return
        K = self._class_consts(output, ks) if cpar else {}

        def dens(j):
            return F.expr(S.total([S.pre_density(S.q(c), *[S.num(v) for v in K[(j, i)]])
                                   for i, c in enumerate(cpar)]))
        # unseen family -> default_prob alone
        plan.flat.append(lambda j: F.coalesce(lp(j) + dens(j), self.log_default))

    def child_term_flat(self, plan: _Plan, node: str, output: str, ks: list[int]) -> None:
        """Log factor of a discrete child of the output for each literal candidate (F11)."""
        net, m, tag = self.net, self.m, self._tag(node)
        dpar, cpar = net.discrete_parents(node), net.continuous_parents(node)
        pos = dpar.index(output)
        others = [d for d in dpar if d != output]
        t = m.cpt.filter(F.col("node") == node).groupBy(
            *[F.get(F.col("config"), dpar.index(d)).alias(d) for d in others],
            F.col("value").alias(node)).agg(*[
                F.max(F.when(F.get(F.col("config"), pos) == k, self._log_p())).alias(f"{tag}l{j}")
                for j, k in enumerate(ks)])
        if cpar:
            t = t.join(self._class_moments(node, node), on=[node], how="left")
            self._row_values(plan, node)
        plan.df = lookup_join(plan.df, t, others + [node], m.rows("cpt", node),
                              len(ks) + 2 * len(cpar), self.limit, plan.base)
        plan.tmp += [c for c in t.columns if c.startswith(tag)]
        dens = F.lit(0.0)
        if cpar:   # the child's own class moments: the same for every candidate
            plan.df = plan.df.withColumn(f"{tag}d", self._density_sum(node, F.col))
            plan.tmp.append(f"{tag}d")
            dens = F.col(f"{tag}d")
        plan.flat.append(lambda j: F.coalesce(F.col(f"{tag}l{j}") + dens, self.log_default))

    # ---- assembly --------------------------------------------------------------
    def prepare(self, df: DataFrame, skip: str | None = None) -> DataFrame:
        casts = {n: F.expr(node_sql(self.net, n)) for n in self.net.nodes if n != skip or n in df.columns}
        return df.withColumns(casts)

    def score_plan(self, df: DataFrame, output: str, candidates: str = "train",
                   arg_max: bool = False) -> tuple[_Plan, Column]:
        """Terms of the nodes. With ``arg_max`` only the best class is wanted, which spares
        the classes that were never seen (observed_best) or leaves the output to tiled_best."""
        net = self.net
        if output not in net.nodes or not net.is_discrete(output):
            raise ValueError(f"output node {output!r} must be a discrete node of the model")
        rows = self.prepare(df, skip=output)
        plan = _Plan(rows, rows)
        self.attach_globals(plan)
        self._train_cands = None
        ks = self.domain(output) if candidates == "train" else None
        nodes = self._scored_nodes(plan, output)
        if ks is not None:
            plan.ks = ks
            for n in nodes:
                if n == output:
                    self.output_term_flat(plan, n, ks)
                elif net.depends_on(n, output):
                    self.child_term_flat(plan, n, output, ks)
                elif not net.is_discrete(n) and output in net.discrete_parents(n):
                    continue  # continuous child of the output: left out (README, Q18)
                else:
                    self.node_term(plan, n)
            return plan, F.array(*[F.lit(k) for k in ks])
        if candidates == "train" and arg_max and not any(net.depends_on(n, output) for n in nodes if n != output):
            dpar, cpar = net.discrete_parents(output), net.continuous_parents(output)
            classes = self._udf_classes(output)
            plan.tiled = bool(cpar) and not dpar and self._wide(output) and not classes
            if plan.tiled or (dpar and (classes or not self._wide(output))):
                for n in nodes:
                    if n == output:
                        if not plan.tiled:
                            self.observed_best(plan, output)
                    elif net.is_discrete(n) or output not in net.discrete_parents(n):
                        self.node_term(plan, n)
                return plan, F.lit(None)
        if candidates == "train":
            cands = self._train_cands = self.candidates(output)
        elif candidates == "scored":
            # reference behaviour: 0..K-1, K = distinct values (NULL included) in the scored table
            k = df.agg((F.count_distinct(col(output))
                        + F.max(col(output).isNull().cast("int"))).alias("k")).scalar()
            cands = (F.when(k > 0, F.sequence(F.lit(0), (k - 1).cast("int")))
                     .otherwise(F.array().cast("array<int>")))
        else:
            raise ValueError("candidates must be 'train' or 'scored'")
        self._cands = cands
        plan.df = plan.df.withColumn("__cands", cands)
        plan.tmp.append("__cands")
        cands = F.col("__cands")
        for n in nodes:
            if n == output:
                self.output_term(plan, n, cands)
            elif net.depends_on(n, output):
                self.child_term(plan, n, output)
            elif not net.is_discrete(n) and output in net.discrete_parents(n):
                continue  # continuous child of the output: left out (README, Q18)
            else:
                self.node_term(plan, n)
        return plan, cands


def tile_best(width: int):
    """Cogroup function: rows (__rid, x) and classes (value, lp, M, S) of a tile -> each row's
    highest ln p + density over them, the lowest value of equal ones."""
    kernel = by_value(class_log_density_sums)

    def run(rows, classes):
        def matrix(column):
            return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)
        if not rows.num_rows or not classes.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.int32())],
                            names=["__rid", "s", "nk"])
        order = np.argsort(classes.column("value").to_numpy(), kind="stable")
        k, lp = classes.column("value").to_numpy()[order], classes.column("lp").to_numpy()[order]
        mean, sd = matrix(classes.column("M"))[order], matrix(classes.column("S"))[order]
        with np.errstate(divide="ignore", invalid="ignore"):
            good = sd > 0
            r = np.where(good, 1.0 / sd, 0.0)
            c = np.where(good, -np.log(sd) - 0.5 * np.log(2 * np.pi), -np.inf)
        x = matrix(rows.column("x"))
        s, at = np.empty(len(x)), np.empty(len(x), np.int64)
        step = max(1, (1 << 21) // len(k))
        for a in range(0, len(x), step):
            scores = kernel(x[a:a + step], np.where(good, mean, 0.0), r, c) + lp
            at[a:a + step] = scores.argmax(axis=1)          # the first of equal ones
            s[a:a + step] = scores.max(axis=1)
        return pa.table([rows.column("__rid").combine_chunks(), pa.array(s), pa.array(-k[at], pa.int32())],
                        names=["__rid", "s", "nk"])
    return run


def _sum(terms: list) -> Column:
    """Sum of log terms given as Columns or SQL text (text terms are added
    in one expression)."""
    text = [t for t in terms if isinstance(t, str)]
    cols = [t for t in terms if not isinstance(t, str)]
    if text:
        cols.append(F.expr(S.total(text)))
    if not cols:
        return F.lit(0.0)
    out = cols[0]
    for t in cols[1:]:
        out = out + t
    return out


def _no_clash(df: DataFrame, *names: str) -> None:
    """Result columns never replace a column of the scored table."""
    taken = sorted(set(names) & set(df.columns))
    if taken:
        raise ValueError(f"the scored table has columns {taken}, which the result adds; rename them first")


def candidate_scores(model: Model, df: DataFrame, output: str, default_prob: float = 0.0,
                     candidates: str = "train",
                     max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """``df`` plus ``candidates array<int>`` and ``scores array<double>``
    (log joint score of each candidate, aligned)."""
    _no_clash(df, "candidates", "scores")
    sc = Scorer(model, default_prob, max_broadcast_bytes)
    plan, cands = sc.score_plan(df, output, candidates)
    indep = _sum(plan.indep)
    out = plan.df.withColumn("candidates", cands).withColumn("__indep", indep)
    base = F.col("__indep")
    if plan.ks is not None:
        scores = F.array(*[_sum([base] + [d(j) for d in plan.flat]) for j in range(len(plan.ks))])
    else:
        scores = F.transform(F.col("candidates"), lambda k, i: _sum([base] + [d(k, i) for d in plan.dep]))
    out = out.withColumn("scores", scores)
    return out.drop(*plan.tmp, "__indep")


def predict(model: Model, df: DataFrame, output: str, default_prob: float = 0.0,
            candidates: str = "train",
            max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """``df`` plus ``prediction int`` (arg-max candidate, lowest on ties)
    and ``score double`` (its log joint score)."""
    _no_clash(df, "prediction", "score")
    sc = Scorer(model, default_prob, max_broadcast_bytes)
    plan, cands = sc.score_plan(df, output, candidates, arg_max=True)
    out = plan.df.withColumn("__indep", _sum(plan.indep))
    base = F.col("__indep")
    if plan.tiled:
        out = sc.tiled_best(out.drop(*plan.tmp), output)
        best, plan.tmp = F.col("__best"), []
    elif plan.best is not None:
        best = plan.best(base)
    elif plan.ks is not None:
        # one flat struct per candidate; greatest = highest score, then lowest k
        sc_k = [F.struct(_sum([base] + [d(j) for d in plan.flat]).alias("s"), F.lit(-k).alias("nk"))
                for j, k in enumerate(plan.ks)]
        best = F.greatest(*sc_k) if len(sc_k) > 1 else sc_k[0]
    else:
        best = F.array_max(F.transform(cands, lambda k, i: F.struct(
            _sum([base] + [d(k, i) for d in plan.dep]).alias("s"), (-k).alias("nk"))))
    out = out.withColumn("__best", best)
    out = out.withColumn("prediction", (-F.col("__best.nk")).cast("int")) \
             .withColumn("score", F.col("__best.s"))
    return out.drop(*plan.tmp, "__indep", "__best")


def predict_with_labels(model: Model, df: DataFrame, output: str,
                        default_prob: float = 0.0, **kw) -> DataFrame:
    """(label double, prediction double) for every scored row."""
    p = predict(model, df, output, default_prob, **kw)
    return p.select(col(output).cast("double").alias("label"),
                    F.col("prediction").cast("double").alias("prediction"))


def node_factor(model: Model, df: DataFrame, node: str, default_prob: float = 0.0,
                max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """``df`` plus ``log_factor``: the node's factor for the row's own values."""
    _no_clash(df, "log_factor")
    sc = Scorer(model, default_prob, max_broadcast_bytes)
    rows = sc.prepare(df)
    plan = _Plan(rows, rows)
    sc.attach_globals(plan)
    sc.node_term(plan, node)
    return plan.df.withColumn("log_factor", _sum(plan.indep)).drop(*plan.tmp)


__all__ = ["predict", "predict_with_labels", "candidate_scores", "node_factor",
           "lookup_join", "Scorer"]
