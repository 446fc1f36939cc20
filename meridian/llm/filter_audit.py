"""How filters interact: what each one removes in every order in which they could be applied.

A filter's verdict on a document does not hang on the other filters, so a document is no more than the set of
filters that it fails. Documents are counted by part, by that set and by label; all else follows from
these counts, on the lattice of the sets of filters already applied. An edge of the lattice is one filter
applied in one state, and what it removes there is the same in all orders that pass it. The number of these
is a product: orders that reach the state (counted forward) times orders that go on behind it
(counted backward).
"""

from __future__ import annotations

import itertools
import sys
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Tables, split_words


@dataclass(frozen=True)
class Lattice:
    """Sets of filters as masks, and the edges that add one filter."""

    n: int

    @property
    def states(self) -> range:
        return range(1 << self.n)

    @cached_property
    def edges(self) -> list[tuple[int, int]]:
        """(state, filter) for each filter that the state lacks."""
        return [(s, f) for s in self.states for f in range(self.n) if not s >> f & 1]

    @cached_property
    def reaching(self) -> list[int]:
        """Forward: paths from the empty set to each state."""
        found = [1] + [0] * (len(self.states) - 1)
        for s, f in self.edges:  # states ascend, so what is passed on is complete
            found[s | 1 << f] += found[s]
        return found

    @cached_property
    def leaving(self) -> list[int]:
        """Backward: paths from each state to the set of all."""
        found = [0] * (len(self.states) - 1) + [1]
        for s, f in reversed(self.edges):
            found[s] += found[s | 1 << f]
        return found

    def weight(self, edge: tuple[int, int]) -> int:
        """Orders that take an edge."""
        s, f = edge
        return self.reaching[s] * self.leaving[s | 1 << f]

    def path(self, order: tuple[int, ...]) -> list[int]:
        """Places in edges of an order's steps."""
        place = {e: i for i, e in enumerate(self.edges)}
        before = itertools.accumulate(order, lambda s, f: s | 1 << f, initial=0)
        return [place[s, f] for s, f in zip(before, order, strict=False)]


def text_failures(text: Column) -> dict[str, Column]:
    """Failures that a document's text alone decides: under 200 words, under half of the words distinct, over 2 % of capitals, a symbol."""
    words = split_words(text)
    filled = F.coalesce(text, F.lit(""))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": F.regexp_count(filled, F.lit("[A-Z]")) * 100 > F.char_length(filled) * 2,
        "D": filled.rlike(r"[#$%&*|]"),
    }


#: Ids that come after all others.
LAST = sys.maxsize


def failure_counts(docs: DataFrame, labels: DataFrame, failures: list[Column]) -> DataFrame:
    """part, fails (mask), good, toxic, n: how many documents fail just these filters.

    failures: over column ``text``, in the order of the mask's bits. One more bit, the last, fails documents whose
    text a smaller doc_id has, anywhere in the table (told by SHA-256).

    A null text counts as empty, a null source as the empty string. A null doc_id comes after all others and has no
    labels; rows that share a doc_id are counted each and do not fail each other. A label that several rows of
    labels give holds if one of them gives it. Empty tables give no rows; further columns are not looked at.
    """
    tables = Tables(docs.sparkSession)
    told = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce((F.col("quality") == 1), F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    mask = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") * (1 << i) for i, c in enumerate(failures)], F.lit(0))
    # Texts stay behind here; what goes on is a digest and a few numbers a document.
    seen = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), mask.alias("fails"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    known = seen.join(told, "doc_id", "left").na.fill(False, ["good", "toxic"])
    kinds = ["digest", "part", "fails", "good", "toxic"]
    # Dealt by doc_id as the join is, so that no group of copies meets in a task before it is a few rows.
    of_id = known.groupBy(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), *kinds).agg(F.count("*").alias("n"))
    groups = tables.write(of_id.groupBy(*kinds).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("least")), "copies")
    first = groups.groupBy("digest").agg(F.min("least.doc_id").alias("first"))
    held = F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(F.lit(0))
    later = F.struct((F.col("fails") + (1 << len(failures))).alias("fails"), (F.col("n") - held).alias("n"))
    split = groups.join(first, "digest").select("part", "good", "toxic", F.explode(F.array(F.struct("fails", held.alias("n")), later)).alias("c"))
    return split.groupBy("part", "good", "toxic", "c.fails").agg(F.sum("c.n").alias("n"))


def audit(counts: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step, filter, and for each step of each order kept, removed, redundant, unique_fails, good_lost,
    toxic_lost; shapley: what the filter removes, added up over all orders.

    counts: part, fails (mask over letters), good, toxic, n.
    """
    lattice = Lattice(len(letters))
    edges = _rows(("place", "state", "bit", "f", "weight"), [(i, s, 1 << f, f, lattice.weight((s, f))) for i, (s, f) in enumerate(lattice.edges)])
    steps = _rows(
        ("filter_order", "step", "filter", "place"),
        [
            ("".join(letters[f] for f in order), step, letters[order[step - 1]], place)
            for order in itertools.permutations(range(lattice.n))
            for step, place in enumerate(lattice.path(order), 1)
        ],
    )
    on = counts.withColumn("e", F.explode(edges))
    state, bit, fails = F.col("e.state"), F.col("e.bit"), F.col("fails")
    passed, failed = fails.bitwiseAND(state) == 0, fails.bitwiseAND(bit) != 0
    total = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0))
    cells = on.groupBy("part", "e").agg(
        total(passed & ~failed).alias("kept"), total(passed & failed).alias("removed"), total(~passed & failed).alias("redundant"),
        total(fails == bit).alias("unique_fails"), total(passed & failed & F.col("good")).alias("good_lost"), total(passed & failed & F.col("toxic")).alias("toxic_lost"),
    )
    taken = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    # One row a part, of as many cells as the lattice has edges.
    parts = cells.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("e.place", "e.f", "e.weight", *taken))).alias("cells"))
    at = parts.withColumn("s", F.explode(steps)).withColumn("cell", F.get("cells", F.col("s.place")))
    same = F.filter("cells", lambda c: c["f"] == F.col("cell.f"))
    shapley = F.aggregate(same, F.lit(0).cast("long"), lambda acc, c: acc + c["removed"] * c["weight"])
    return at.select("part", "s.filter_order", "s.step", "s.filter", *[f"cell.{c}" for c in taken], shapley.alias("shapley"))


def _rows(names: tuple[str, ...], rows: list[tuple]) -> Column:
    """An array of structs of fixed values (numbers and letters)."""
    written = [", ".join(f"{v!r} as {name}" for v, name in zip(row, names, strict=True)) for row in rows]
    return F.expr(f"array({', '.join(f'struct({w})' for w in written)})")
