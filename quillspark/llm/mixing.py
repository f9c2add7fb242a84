"""Mixing sources to target weights, by hierarchical budgets.

A token budget goes down a tree of levels (domain, language, source). At each node children share it by
weight, none beyond what its subtree can give in ``max_epochs`` passes; what one child can't give goes to
its siblings, and only what none of them can give goes up. A leaf's budget buys whole passes over its
documents and then a prefix, in tokens, of one more pass; each pass has its own seeded order. Tokens are counted
by op6's automaton where a tokenizer's file is given, else they are words between white space.

The tree has one leaf per distinct path, held on the driver and refused beyond ``MAX_LEAVES``. Prefixes
come from sums over ranges of the hash that orders a pass, so no leaf, however large, is in one task;
only the one range in which a prefix ends is ordered row by row.

Edge cases: null levels are a path of their own (""); documents without a word have no tokens and are never
chosen; rows without doc_id are ordered by their text; repeated rows count as separate documents; an
empty table, a zero budget or all-zero weights choose nothing; other columns are ignored by ``select``
and kept by ``mixed``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .quality_rules import words_of
from .token_counts import count_tokens

LEVELS = ("domain", "lang", "source")
MAX_LEAVES = 100_000
#: Rows that a range of the ordering hash holds, about.
RANGE_ROWS = 20_000
Path = tuple[str | None, ...]
#: A weight for (*node, OTHER) makes the node's children without a weight share in it by size.
OTHER = None


def share(budget: int, capacity: Mapping[str, int], weights: Mapping[str, Fraction]) -> dict[str, int]:
    """``budget`` split by weight, none above its capacity; whole numbers, ties by name."""
    given = dict.fromkeys(capacity, 0)
    open_ = {k for k in capacity if weights[k] > 0 and capacity[k] > 0}
    left = min(budget, sum(capacity[k] for k in open_))
    while open_ and left > 0:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if left * weights[k] >= capacity[k] * total}
        if full:
            for k in full:
                given[k] = capacity[k]
            left -= sum(capacity[k] for k in full)
            open_ -= full
            continue
        exact = {k: left * weights[k] / total for k in open_}
        given |= {k: int(v) for k, v in exact.items()}
        spare = left - sum(int(v) for v in exact.values())
        for k in sorted(open_, key=lambda k: (int(exact[k]) - exact[k], k))[:spare]:
            given[k] += 1
        break
    return given


def budgets(available: Mapping[Path, int], weights: Mapping[Path, float], total: int, max_epochs: int) -> dict[Path, int]:
    """Tokens to take from each leaf. A node without a weight has its share of its parent's tokens, if no sibling has one, else 0.

    Where the parent has a weight for OTHER, it has that multiple of its share of the parent's tokens beside weighted
    siblings, which split what that leaves (nothing, if it is all) by their weights.
    """
    children: dict[Path, set[str]] = {}
    size: dict[Path, int] = {}
    for path, n in available.items():
        for d in range(len(path)):
            children.setdefault(path[:d], set()).add(path[d])
        for d in range(len(path) + 1):
            size[path[:d]] = size.get(path[:d], 0) + n

    def weights_under(node: Path) -> dict[str, Fraction]:
        names = children[node]
        own = {c: Fraction(weights[(*node, c)]) for c in names if (*node, c) in weights}
        if own:
            scale = Fraction(weights.get((*node, OTHER), 0)) / max(size[node], 1)
            rest = {c: scale * size[(*node, c)] for c in names if c not in own}
            left, total = max(1 - sum(rest.values()), Fraction(0)), sum(own.values()) or 1
            return {c: w * left / total for c, w in own.items()} | rest
        return {c: Fraction(size[(*node, c)]) for c in names}

    def capacity(node: Path) -> int:
        if node not in children:
            return size[node] * max_epochs
        own = weights_under(node)
        return sum(capacity((*node, c)) for c in children[node] if own[c] > 0)

    found: dict[Path, int] = {}

    def spend(node: Path, budget: int) -> None:
        if node not in children:
            found[node] = budget
            return
        parts = share(budget, {c: capacity((*node, c)) for c in children[node]}, weights_under(node))
        for c, n in parts.items():
            spend((*node, c), n)

    if available:
        spend((), total)
    return found


def _order(seed: int, epoch: Column) -> Column:
    return F.xxhash64(F.lit(seed), epoch, F.coalesce(F.col("doc_id"), F.col("text_hash")))


def _counted(docs: DataFrame, levels: Sequence[Column], tokenizer: str | None) -> DataFrame:
    path = [F.coalesce(c.cast("string"), F.lit("")).alias(f"level_{i}") for i, c in enumerate(levels)]
    text_hash = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)).alias("text_hash")
    number = F.col("doc_id").cast("long").alias("doc_id")
    if tokenizer is None:
        return docs.select(number, *path, text_hash, F.size(words_of(F.coalesce("text", F.lit("")))).cast("long").alias("n_tokens"))
    names = ("doc_id", *(f"level_{i}" for i in range(len(levels))), "text_hash")
    return count_tokens(docs.select(number, *path, text_hash.cast("long").alias("text_hash"), "text"), tokenizer, names).select(*names, "n_tokens")


def _plan(counted: DataFrame, names: list[str], weights: Mapping[Path, float], budget_share: float, max_epochs: int) -> tuple[DataFrame, int]:
    """(path, whole passes, rest) of each leaf, and bits of the hash that give ranges of about RANGE_ROWS."""
    rows = counted.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")).limit(MAX_LEAVES + 1).collect()
    if len(rows) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    available = {tuple(r[n] for n in names): r["tokens"] for r in rows}
    total = int(Fraction(budget_share) * sum(available.values()))
    chosen = budgets({p: n for p, n in available.items() if n}, weights, total, max_epochs)
    table = [(*p, b // available[p], b % available[p], b) for p, b in sorted(chosen.items())]
    schema = ", ".join([*(f"{n} string" for n in names), "passes long", "rest long", "leaf_budget long"])
    most = max((r["rows"] for r in rows), default=0)
    return counted.sparkSession.createDataFrame(table, schema), max(0, (most // RANGE_ROWS).bit_length())


def _last_pass(planned: DataFrame, names: list[str], bits: int, seed: int) -> DataFrame:
    """Rows of each leaf's last, partial pass, with the tokens taken of each."""
    keyed = planned.where("rest > 0").withColumn("epoch", F.col("passes")).withColumn("at", _order(seed, F.col("passes")))
    keyed = keyed.withColumn("range", F.shiftright(F.col("at"), 63 - bits) if bits else F.lit(0).cast("long"))
    sums = keyed.groupBy(*names, "range").agg(F.sum("n_tokens").alias("range_tokens"))
    by_range = Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("range_tokens").over(by_range), F.lit(0)))
    placed = keyed.join(sums, [*names, "range"]).where("before < rest")
    whole = placed.where("before + range_tokens <= rest").withColumn("take_tokens", F.col("n_tokens"))
    by_row = Window.partitionBy(*names, "range").orderBy("at", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    ending = placed.where("before + range_tokens > rest").withColumn("before", F.col("before") + F.coalesce(F.sum("n_tokens").over(by_row), F.lit(0)))
    ending = ending.where("before < rest").withColumn("take_tokens", F.least("n_tokens", F.col("rest") - F.col("before")))
    return whole.unionByName(ending)


def select(docs: DataFrame, weights: Mapping[Path, float], *, levels: Sequence[Column], budget_share: float = 1.0, max_epochs: int = 4, seed: int = 0, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, level_0, ..., epoch, n_tokens, take_tokens, leaf_budget): each document in each pass that takes of it."""
    names = [f"level_{i}" for i in range(len(levels))]
    counted = cut(_counted(docs, levels, tokenizer).where("n_tokens > 0"))
    plan, bits = _plan(counted, names, weights, budget_share, max_epochs)
    planned = counted.join(F.broadcast(plan), names)  # MAX_LEAVES rows at most
    whole = planned.where("passes > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1))).withColumn("take_tokens", F.col("n_tokens"))
    columns = ["doc_id", *names, "epoch", "n_tokens", "take_tokens", "leaf_budget"]
    return whole.select(*columns).union(_last_pass(planned, names, bits, seed).select(*columns))


def mixed(docs: DataFrame, weights: Mapping[Path, float], *, levels: Sequence[Column], budget_share: float, seed: int = 0, tokenizer: str | None = None) -> DataFrame:
    """The rows of ``docs`` that one pass at most takes of, whole: a leaf may pass its budget by less than a document.

    The last row that a leaf takes is a threshold of the ordering hash, so texts are filtered where they are read.
    """
    names = [f"level_{i}" for i in range(len(levels))]
    counted = cut(_counted(docs, levels, tokenizer).where("n_tokens > 0"))
    plan, bits = _plan(counted, names, weights, budget_share, 1)
    planned = counted.join(F.broadcast(plan), names)
    ends = _last_pass(planned, names, bits, seed).groupBy(*names).agg(F.max(F.struct("at", F.coalesce("doc_id", F.lit(0)).alias("id"))).alias("end"))
    limits = plan.select(*names, "passes").join(ends, names, "left")
    rows = sorted(map(tuple, limits.select(*names, "passes", "end.at", "end.id").collect()), key=str)  # a row per leaf
    schema = ", ".join([*(f"{n} string" for n in names), "_passes long", "_end long", "_end_id long"])
    table = F.broadcast(docs.sparkSession.createDataFrame(rows, schema))
    path = {n: F.coalesce(c.cast("string"), F.lit("")) for n, c in zip(names, levels)}
    text_hash = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0))
    at = F.xxhash64(F.lit(seed), F.lit(0).cast("long"), F.coalesce(F.col("doc_id").cast("long"), text_hash))
    renamed = table.select(*(F.col(n).alias(f"_{n}") for n in names), "_passes", "_end", "_end_id")
    same = [path[n] == F.col(f"_{n}") for n in names]
    # A condition over both sides would be evaluated in the join, so this stays one hash join over the scan.
    reached = (at < F.col("_end")) | ((at == F.col("_end")) & (F.coalesce(F.col("doc_id"), F.lit(0)) <= F.col("_end_id")))
    has_words = F.size(words_of(F.coalesce("text", F.lit("")))) > 0
    return docs.where(has_words).join(renamed, [*same, (F.col("_passes") > 0) | F.coalesce(reached, F.lit(False))], "left_semi")
