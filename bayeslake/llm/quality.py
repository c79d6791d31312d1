"""Learned decision lists for text quality, in DataFrame functions alone.

Statistics of each text are SQL expressions over its word and line arrays; no
row leaves the JVM and nothing is shuffled. Rules are learned from labelled
statistics by sequential covering: a rule is grown condition by condition for
information gain on two thirds of the labelled rows, its last conditions are
pruned while that does not hurt on the other third, the rows it covers are
taken out, and so on until a rule no longer proves itself. The ordered rules
become one CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, bound, fresh, need, stored

#: Labelled rows at most that the rules are learned from.
MAX_LABELLED = 20_000
SYMBOLS = "[#*$%&|<>]"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratios that rules may test, as SQL over the statistics (n_words > 0 holds where they are tested).
RATIOS = {
    "symbols_per_word": "n_symbols / n_words",
    "repeated_share": "n_repeat_words / n_words",
    "dup_lines_per_word": "n_dup_lines / n_words",
    "chars_per_word": "word_chars / n_words",
}


# ---- statistics ----------------------------------------------------------------------
# Positions in a repeated 3-word window: windows are hashed to 64 bits with
# their words' boundaries; texts whose windows are all different stop at the
# first test. Otherwise (hash, position) pairs are sorted, pairs with an equal
# neighbour give their positions, and each adds the words that the window
# before it has not covered. Arrays are bound to lambda variables, so that they
# are computed once.
_REPEATED = """
CASE WHEN size(_grams) = size(array_distinct(_grams)) THEN 0L ELSE
  transform(array(sort_array(transform(_grams, (h, i) -> named_struct('h', h, 'i', i)))), s ->
    aggregate(
      sort_array(transform(filter(transform(s, (x, k) -> named_struct('i', x.i, 'twice',
          coalesce(x.h = get(s, k - 1).h, false) OR coalesce(x.h = get(s, k + 1).h, false))),
        x -> x.twice), x -> x.i)),
      named_struct('n', 0L, 'last', -3),
      (a, i) -> named_struct('n', a.n + least(3, i - a.last), 'last', i),
      a -> a.n))[0]
END"""


def with_statistics(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` and a struct column ``name`` of the five statistics (long).

    A NULL or empty text has 0 everywhere. Words are runs of other
    characters than blanks; a repeated line needs a word in it.
    """
    words, grams, text = fresh(docs, "words_", "grams_", "text_")
    blank = F.lit(BLANKS)
    d = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    d = bound(d, words, F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))
    d = bound(d, grams, F.expr(
        f"CASE WHEN size({words}) < 3 THEN array() ELSE transform(sequence(0, size({words}) - 3), "
        f"i -> xxhash64(get({words}, i), get({words}, i + 1), get({words}, i + 2))) END"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, blank)) > 0)
    return bound(d, name, F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s + F.length(w)).alias("word_chars"),
        F.regexp_count(F.col(text), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0]
        .cast("long").alias("n_dup_lines"),
        F.expr(_REPEATED.replace("_grams", grams)).alias("n_repeat_words"),
    )).drop(words, grams, text)


def base_failed(s: str) -> Column:
    """Too short, or more than half of the words in repeated windows."""
    return F.expr(f"{s}.n_words < 50 OR 100 * {s}.n_repeat_words > 50 * {s}.n_words")


# ---- learning ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool            # value > threshold, else value <= threshold
    threshold: float

    def holds(self, row: dict) -> bool:
        return (row[self.feature] > self.threshold) == self.above

    def sql(self, s: str) -> str:
        value = RATIOS[self.feature]
        for c in STATISTICS:
            value = value.replace(c, f"{s}.{c}")
        return f"({value}) {'>' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def _count(rule, rows) -> tuple[int, int]:
    covered = [bad for row, bad in rows if all(c.holds(row) for c in rule)]
    return sum(covered), len(covered) - sum(covered)


def _best_condition(rows, p0: int, n0: int):
    """The condition with most information gain (ties: the first feature,
    the lowest threshold); thresholds lie midway between values."""
    base, best = math.log2(p0 / (p0 + n0)), (0.0, None)
    for f in RATIOS:
        ordered = sorted((row[f], bad) for row, bad in rows)
        p = n = 0
        for (v, bad), (after, _) in zip(ordered, ordered[1:]):
            p, n = p + bad, n + (not bad)
            if v == after:
                continue
            for above, (pp, nn) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                if pp:
                    gain = pp * (math.log2(pp / (pp + nn)) - base)
                    if gain > best[0] + 1e-9:
                        best = (gain, Condition(f, above, (v + after) / 2))
    return best[1]


def learn_rules(rows: list[tuple[dict, bool]], *, max_rules: int = 8, max_conditions: int = 4,
                min_precision: float = 0.9, min_rows: int = 5) -> list[Rule]:
    """Rules for bad rows, in order. ``rows`` are (statistics, is bad)."""
    grow = [r for i, r in enumerate(rows) if i % 3]
    prune = [r for i, r in enumerate(rows) if i % 3 == 0]
    rules: list[Rule] = []
    while len(rules) < max_rules:
        rule, covered = (), grow
        while len(rule) < max_conditions:
            p, n = _count((), covered)
            if not p or not n:
                break
            c = _best_condition(covered, p, n)
            if c is None:
                break
            rule, covered = (*rule, c), [r for r in covered if c.holds(r[0])]
        if not rule:
            break

        def worth(k):
            p, n = _count(rule[:k], prune)
            return ((p - n) / (p + n) if p + n else -1.0, -k)
        rule = rule[:max(range(1, len(rule) + 1), key=worth)]
        p, n = _count(rule, prune)
        if p < min_rows or p < min_precision * (p + n):
            break
        rules.append(rule)
        grow, prune = ([r for r in part if not all(c.holds(r[0]) for c in rule)] for part in (grow, prune))
    return rules


def decision(rules: list[Rule], s: str) -> Column:
    """The rule list as one ordered conditional expression: true is kept."""
    if not rules:
        return F.lit(True)
    case = " ".join(f"WHEN {' AND '.join(c.sql(s) for c in rule)} THEN false" for rule in rules)
    return F.expr(f"CASE {case} ELSE true END")


def fit_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality", max_labelled: int = MAX_LABELLED, **options) -> list[Rule]:
    """Learn from at most ``max_labelled`` labelled rows (the lowest hashes
    of their id, and of several texts of one id the lowest hashes of those),
    from the texts that do not fail the base test. A row that repeats another
    one's id and text says it once. NULL ids, labels and texts are passed over."""
    need(docs, id_col, text_col)
    need(labels, id_col, label_col)
    some = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
            .select(F.col(id_col).alias("k"), (F.col(label_col) == 0).alias("bad"))
            .orderBy(F.xxhash64("k"), "k", "bad").limit(max_labelled))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    rows = with_statistics(texts.join(F.broadcast(some), "k"), "t", "s").where(~base_failed("s"))
    features = [F.expr(sql.replace("n_", "s.n_").replace("word_chars", "s.word_chars")).alias(f)
                for f, sql in RATIOS.items()]
    # an id may have any number of texts: the bound holds for what the driver gets, too
    found = (rows.select(F.xxhash64("k").alias("h"), "k", F.xxhash64("t").alias("text_hash"), "bad", *features).distinct()
             .orderBy("h", "k", "text_hash", "bad").limit(max_labelled))
    found = stored(found, "labelled-ratios").collect()
    found.sort(key=lambda r: (r.h, r.k, r.bad, *(r[f] for f in RATIOS)))
    return learn_rules([({f: r[f] for f in RATIOS}, r.bad) for r in found], **options)


def judge(docs: DataFrame, rules: list[Rule], *, text_col: str = "text",
          names: tuple[str, str, str] = ("statistics", "base_failed", "kept")) -> DataFrame:
    """``docs`` and three columns: the statistics, whether the base test
    fails, and whether the text is kept (it passes the base test and no rule
    rejects it). A NULL or empty text fails the base test; repeated rows are
    judged alike; an empty table gives no row. ``names`` must not be columns
    of ``docs``."""
    need(docs, text_col)
    if set(names) & set(docs.columns):
        raise ValueError(f"{names} clash with columns of the table; choose other names=")
    s, failed, kept = names
    return (with_statistics(docs, text_col, s).withColumn(failed, base_failed(s))
            .withColumn(kept, F.when(F.col(failed), F.lit(False)).otherwise(decision(rules, s))))
