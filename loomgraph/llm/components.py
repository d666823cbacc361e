"""Connected components of links between nodes, by distributed union-find.

While there are more than `local` links, every round hooks each root that has a smaller neighbour
onto its least one, then replaces the ends of all links by their roots and drops links within a
component. Links shrink to those between roots, stars vanish at once, and at least every second
root that still has links is hooked, so rounds are logarithmic. Minima are formed within tasks
before they are shuffled. Rounds are written to the shared folder. The links that are left, at
most `local`, are united in one task, whose memory that bound limits; both ways give the same
roots.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import forget, spill

#: Links that one task unites.
LOCAL = 400_000


def components(links: DataFrame, local: int | None = None) -> DataFrame:
    """(node, root) for every node that is not its component's least, from links (a, b). Loops and repeats are ignored."""
    local = LOCAL if local is None else local
    given, roots = links, None
    if not hasattr(links, "_spilled"):
        links = spill(links.select("a", "b"), "links")
    while links.count() > local:
        old, links = links, spill(_tidy(links), "links") if roots is None else links
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = _followed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).filter("root < node"))
        before, roots = roots, _moved(roots, hooked)
        moved = links
        for end in ("a", "b"):
            moved = moved.join(hooked.select(F.col("node").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        left = spill(_tidy(moved), "links")
        forget(links, hooked, before, None if old is given else old)
        links = left
    if roots is None or not links.isEmpty():
        last = spill(united(links), "hooked")
        before, roots = roots, last if roots is None else _moved(roots, last)
        forget(before, None if roots is last else last)
    forget(None if links is given else links)
    return roots


def _moved(roots: DataFrame | None, hooked: DataFrame) -> DataFrame:
    """Roots after their own roots were hooked."""
    if roots is None:
        return spill(hooked, "roots")
    moved = roots.alias("r").join(hooked.alias("h"), F.col("r.root") == F.col("h.node"), "left")
    return spill(moved.select("r.node", F.coalesce("h.root", "r.root").alias("root")).unionByName(hooked), "roots")


def united(links: DataFrame) -> DataFrame:
    """(node, root) as of components(), in one task."""
    kind = links.schema["a"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        type_ = None

        def root(n):
            while (up := parent.get(n, n)) != n:
                parent[n] = parent.get(up, up)
                n = up
            return n

        for batch in batches:
            type_ = batch.schema.types[0]
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        for i in range(0, len(nodes), 50_000):
            some = nodes[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, type_), pa.array([root(n) for n in some], type_)], names=["node", "root"])

    return links.select("a", "b").coalesce(1).mapInArrow(task, f"node {kind}, root {kind}")


def _followed(hooked: DataFrame) -> DataFrame:
    """Hooks followed to their ends; chains halve at each step."""
    hooked = spill(hooked, "hooked")
    while True:
        a, b = hooked.alias("a"), hooked.alias("b")
        on = a.join(b, F.col("a.root") == F.col("b.node"), "left")
        further = spill(on.select("a.node", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")), "hooked")
        if further.filter("moved").isEmpty():
            forget(further)
            return hooked
        forget(hooked)
        hooked = further.drop("moved")
        hooked._spilled = further._spilled


def _tidy(links: DataFrame) -> DataFrame:
    return links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
