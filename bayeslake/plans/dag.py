"""Network structure: node kinds, canonical parent order and DAG validation.

Everything here is driver-side metadata (column names and types); no data is
touched. Nodes are addressed by column name, and parents are always listed in
the column order of the training frame, so parameter keys are canonical.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

DISCRETE = "discrete"
CONTINUOUS = "continuous"

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
            T.FloatType, T.DoubleType, T.DecimalType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class NetworkError(ValueError):
    """Raised for an invalid DAG or an unusable column."""


@dataclass(frozen=True)
class Network:
    nodes: tuple[str, ...]
    kinds: dict[str, str]
    parents: dict[str, tuple[str, ...]]
    _children: dict[str, tuple[str, ...]] = field(default_factory=dict, compare=False, repr=False)

    # ---- construction -------------------------------------------------
    @classmethod
    def from_schema(cls, schema: T.StructType, edges, discrete=None, continuous=None) -> "Network":
        names = [f.name for f in schema.fields]
        if len(set(names)) != len(names):
            raise NetworkError("duplicate column names in the training frame")
        discrete = set(discrete or ())
        continuous = set(continuous or ())
        both = discrete & continuous
        if both:
            raise NetworkError(f"columns declared both discrete and continuous: {sorted(both)}")
        for n in discrete | continuous:
            if n not in names:
                raise NetworkError(f"unknown column {n!r}")
        kinds = {}
        for f in schema.fields:
            dt = f.dataType
            if f.name in discrete:
                if not isinstance(dt, _INTEGRAL):
                    raise NetworkError(f"discrete column {f.name!r} must be integral, got {dt.simpleString()}")
                kinds[f.name] = DISCRETE
            elif f.name in continuous:
                if not isinstance(dt, _NUMERIC):
                    raise NetworkError(f"continuous column {f.name!r} must be numeric, got {dt.simpleString()}")
                kinds[f.name] = CONTINUOUS
            elif isinstance(dt, T.IntegerType):
                kinds[f.name] = DISCRETE
            elif isinstance(dt, _NUMERIC):
                kinds[f.name] = CONTINUOUS
            else:
                raise NetworkError(
                    f"column {f.name!r} has type {dt.simpleString()}; encode it to integer codes first")
        return cls.build(names, kinds, _edge_pairs(edges))

    @classmethod
    def build(cls, names, kinds, edges) -> "Network":
        names = list(names)
        pos = {n: i for i, n in enumerate(names)}
        seen = set()
        parents: dict[str, list[str]] = {n: [] for n in names}
        for p, c in edges:
            for n in (p, c):
                if n not in pos:
                    raise NetworkError(f"edge ({p!r}, {c!r}) names unknown column {n!r}")
            if p == c:
                raise NetworkError(f"self-loop on {p!r}")
            if (p, c) in seen:
                raise NetworkError(f"duplicate edge ({p!r}, {c!r})")
            seen.add((p, c))
            parents[c].append(p)
        ordered = {n: tuple(sorted(ps, key=pos.__getitem__)) for n, ps in parents.items()}
        _check_acyclic(names, ordered)
        children: dict[str, list[str]] = {n: [] for n in names}
        for c in names:
            for p in ordered[c]:
                children[p].append(c)
        return cls(tuple(names), dict(kinds), ordered,
                   {n: tuple(v) for n, v in children.items()})

    # ---- queries ----------------------------------------------------------
    def is_discrete(self, n: str) -> bool:
        return self.kinds[n] == DISCRETE

    def discrete_parents(self, n: str) -> tuple[str, ...]:
        return tuple(p for p in self.parents[n] if self.is_discrete(p))

    def continuous_parents(self, n: str) -> tuple[str, ...]:
        return tuple(p for p in self.parents[n] if not self.is_discrete(p))

    def children(self, n: str) -> tuple[str, ...]:
        return self._children[n]

    def edges(self) -> list[tuple[str, str]]:
        return [(p, c) for c in self.nodes for p in self.parents[c]]

    def continuous_edges(self) -> list[tuple[str, str]]:
        """Edges continuous → continuous: these carry correlation coefficients."""
        return [(p, c) for p, c in self.edges()
                if not self.is_discrete(p) and not self.is_discrete(c)]

    def discrete_nodes(self) -> list[str]:
        return [n for n in self.nodes if self.is_discrete(n)]

    def continuous_nodes(self) -> list[str]:
        return [n for n in self.nodes if not self.is_discrete(n)]

    def depends_on(self, node: str, output: str) -> bool:
        """True when the factor of ``node`` changes with the candidate value
        of ``output``: the output's own factor and those of its discrete
        children. A continuous child reads its configuration from the row
        and is left out of scoring (see README, decision Q18)."""
        if node == output:
            return True
        return self.is_discrete(node) and output in self.discrete_parents(node)

    # ---- serialisation ----------------------------------------------------
    def to_json(self) -> str:
        return json.dumps({"nodes": list(self.nodes), "kinds": self.kinds, "edges": self.edges()})

    @classmethod
    def from_json(cls, text: str) -> "Network":
        d = json.loads(text)
        return cls.build(d["nodes"], d["kinds"], [tuple(e) for e in d["edges"]])


def _edge_pairs(edges) -> list[tuple[str, str]]:
    if isinstance(edges, DataFrame):
        # A DAG is a handful of (parent, child) names: metadata, not data.
        return [(r[0], r[1]) for r in edges.select("parent", "child").collect()]
    return [(str(p), str(c)) for p, c in edges]


def _check_acyclic(names, parents) -> None:
    indeg = {n: len(parents[n]) for n in names}
    children: dict[str, list[str]] = {n: [] for n in names}
    for c in names:
        for p in parents[c]:
            children[p].append(c)
    ready = [n for n in names if indeg[n] == 0]
    done = 0
    while ready:
        n = ready.pop()
        done += 1
        for c in children[n]:
            indeg[c] -= 1
            if indeg[c] == 0:
                ready.append(c)
    if done != len(names):
        cyc = sorted(n for n in names if indeg[n] > 0)
        raise NetworkError(f"the edges contain a cycle through {cyc}")


def fan_in_edges(columns, output: str) -> list[tuple[str, str]]:
    """Every column other than ``output`` becomes a parent of ``output``."""
    return [(c, output) for c in columns if c != output]
