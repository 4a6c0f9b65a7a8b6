"""Merkle manifest of a table, with a proof per row and its check, by cogrouped subtree exchange.

A row is a leaf. The leaves of a source in order of their id form a tree of runs of three, and the roots of
the sources, in order, a tree again. A superblock is ``3 ** LEVELS`` consecutive leaves of a tree, or several
whole small trees. Upwards, every superblock is reduced to the nodes that stand for its blocks, and these are
the leaves of the next layer. Downwards, the rows of a layer and the outer nodes that their blocks need are
cogrouped by superblock: the same task finishes the local reduction, joins local and outer siblings to a
proof, and folds the leaf as found now up to the root.

Leaves are numbered within their source by one range sort of the narrow leaf table: every range counts its
rows per source, and only these counts meet. A source with a third of all rows spans many ranges and
superblocks; many tiny sources share superblocks.

Defined results: nulls in any column are written as ``-``; a null source is a source of its own and comes
first; rows without an id come first in their source and are not tampered with; rows with equal source and id
are ordered by their leaf; equal rows are leaves of their own; an empty table gives no row; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from stratadoc.llm.common import narrow, ready
from stratadoc.session import durable

RUN = 3
#: Levels that a superblock reduces, and its leaves.
LEVELS = 7
SIZE = RUN**LEVELS
#: Block of a place.
BLOCK = f"pos div {SIZE}"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_OUTER = "tree long, pos long, below long, node string, left array<string>, right array<string>, subroot string, root string"


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(columns: list[Column]) -> Column:
    """Hash of one row: each value behind its length in bytes, nulls as ``-``."""
    written = [F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")) for c in columns]
    return F.sha2(F.concat(*[F.coalesce(w, F.lit("-")) for w in written]).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, source, leaf, changed``: ``changed`` is the leaf after tampering, null where none was."""
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    now = [F.col(c) for c in COLUMNS[:-1]] + [F.replace(F.col("text"), F.lit("\n"), F.lit(""))]
    return docs.select("doc_id", "source", leaf([F.col(c) for c in COLUMNS]).alias("leaf"), F.when(tampered, leaf(now)).alias("changed"))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``tree`` (number of the source), ``pos`` and ``n`` (place in it and its size)."""
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf", "row"]
    # The running number only keeps equal rows apart, so that no range holds all of them.
    stored = durable(rows.withColumn("row", F.monotonically_increasing_id()))
    ranged = stored.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    place = F.monotonically_increasing_id()
    placed = durable(ranged.withColumns({"part": F.spark_partition_id(), "at": place.bitwiseAND(F.lit((1 << 33) - 1))}))
    # One row per range and source from here on.
    runs = placed.groupBy("part", "source").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    in_source = Window.partitionBy("source")
    earlier = in_source.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    begins = F.col("before") == 0
    # One row per range: sources that begin in earlier ones.
    per_part = runs.groupBy("part").agg(F.count_if(begins).alias("begun"))
    offset = F.coalesce(F.sum("begun").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    begun = F.coalesce(F.sum(begins.cast("long")).over(inside), F.lit(0)) + F.col("offset")
    runs = runs.join(per_part.select("part", offset.alias("offset")), "part")
    runs = runs.withColumn("tree", F.when(begins, begun)).select(
        F.col("part").alias("of_part"), F.col("source").alias("of_source"), "first", "before",
        F.max("tree").over(in_source).alias("tree"), F.sum("rows").over(in_source).alias("n"),
    )
    both = placed.join(runs, (F.col("part") == F.col("of_part")) & F.col("source").eqNullSafe(F.col("of_source")))
    return both.withColumn("pos", F.col("at") - F.col("first") + F.col("before"))


def _super(block: Column, n: str, few: int) -> Column:
    """Superblock of a block: its own for large trees, one of ``few`` for small ones."""
    return F.when(F.col(n) > SIZE, F.xxhash64(F.col("tree"), block)).otherwise(F.pmod(F.xxhash64("tree"), F.lit(few)))


def _steps(n: int) -> int:
    """Levels that a tree of ``n`` leaves passes within a superblock."""
    steps = 0
    while n > 1 and steps < LEVELS:
        n, steps = -(-n // RUN), steps + 1
    return steps


def _tower(nodes: list[str], steps: int) -> list[list[str]]:
    """The nodes of a block level by level."""
    out = [nodes]
    for _ in range(steps):
        nodes = [digest(nodes[k : k + RUN]) for k in range(0, len(nodes), RUN)]
        out.append(nodes)
    return out


def _blocks(rows: pd.DataFrame) -> Iterator[tuple[int, int, int, pd.DataFrame]]:
    """Tree, block, tree size and ordered rows of every block of a superblock."""
    block = rows["pos"] // SIZE
    for (tree, number), own in rows.assign(block=block).sort_values(["tree", "pos"], kind="stable").groupby(["tree", "block"]):
        yield int(tree), int(number), int(own["n"].iloc[0]), own


def _reduce(rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for tree, block, n, own in _blocks(rows):
        out.append((tree, block, -(-n // SIZE), n, _tower(own["node"].tolist(), _steps(n))[-1][0]))
    return pd.DataFrame(out, columns=["tree", "pos", "n", "below", "node"])


def layers(nodes: DataFrame) -> list[tuple[DataFrame, int]]:
    """Layers ``tree, pos, n, node`` up to one node per tree, each with its number of superblocks for small trees."""
    out = []
    while True:
        rows, largest = nodes.agg(F.count("*"), F.max("n")).first()
        few = max(1, -(-rows // SIZE))
        out.append((nodes, few))
        if (largest or 1) == 1 and len(out) > 1:
            return out
        keyed = nodes.select("tree", "pos", "n", "node", _super(F.expr(BLOCK), "n", few).alias("super"))
        nodes = durable(keyed.groupBy("super").applyInPandas(_reduce, "tree long, pos long, n long, below long, node string"))


def _siblings(tower: list[list[str]], k: int) -> tuple[list[str], list[str]]:
    """What stands left and right of leaf ``k`` in its run, level by level."""
    left, right = [], []
    for level in tower[:-1]:
        first = k - k % RUN
        left.append("".join(level[first:k]))
        right.append("".join(level[k + 1 : first + RUN]))
        k //= RUN
    return left, right


def _fold(node: str, left: list[str], right: list[str]) -> str:
    for a, b in zip(left, right):
        node = digest([a, node, b])
    return node


def _proofs(rows: pd.DataFrame, outer: pd.DataFrame) -> Iterator[tuple]:
    """Every row of a superblock with its siblings up to the root, the subroot and the root."""
    names = ["tree", "pos", "left", "right", "subroot", "root"]
    above = {(tree, block): rest for tree, block, *rest in outer[names].itertuples(index=False)}
    for tree, block, n, own in _blocks(rows):
        tower = _tower(own["node"].tolist(), _steps(n))
        more_left, more_right, subroot, root = above[tree, block]
        for k, row in enumerate(own.itertuples(index=False)):
            left, right = _siblings(tower, k)
            yield row, left + list(more_left), right + list(more_right), subroot, root


def _inner(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    out = [(row.tree, row.pos, row.below, row.node, *rest) for row, *rest in _proofs(rows, outer)]
    return pd.DataFrame(out, columns=["tree", "pos", "below", "node", "left", "right", "subroot", "root"])


def _checked(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    out = []
    for row, left, right, subroot, root in _proofs(rows, outer):
        folded = _fold(row.changed if isinstance(row.changed, str) else row.node, left, right)
        proof = digest([x for pair in zip(left, right) for x in pair])
        out.append((row.doc_id, row.node, subroot, root, proof, folded, folded == root))
    return pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def _cogrouped(layer: tuple[DataFrame, int], outer: DataFrame, columns: list[str], finish, schema: str) -> DataFrame:
    """``finish`` over the rows of a layer and the outer nodes of their blocks, by superblock."""
    nodes, few = layer
    left = nodes.select("tree", "pos", "n", "node", *columns, _super(F.expr(BLOCK), "n", few).alias("super"))
    right = outer.withColumn("super", _super(F.col("pos"), "below", few))
    return left.groupBy("super").cogroup(right.groupBy("super")).applyInPandas(finish, schema)


def _down(built: list[tuple[DataFrame, int]], outer: DataFrame) -> DataFrame:
    """Outer nodes for the lowest of the layers, from those of the trees' tops."""
    for layer in reversed(built):
        outer = durable(_cogrouped(layer, outer, ["below"], _inner, _OUTER))
    return outer


def manifest(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", text: str = "text"
) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row."""
    ready(docs.sparkSession)
    rows = narrow(docs, doc_id=doc_id, source=source, lang=lang, n_chars=n_chars, text=text)
    kind = dict(rows.dtypes)["doc_id"]
    # Ids travel as text: pandas has no null among whole numbers.
    nodes = numbered(leaves(rows)).select("tree", "pos", "n", F.col("leaf").alias("node"), F.col("doc_id").cast("string").alias("doc_id"), "changed")
    of_source = layers(durable(nodes))
    subroots = of_source[-1][0]
    zero, size = F.lit(0).cast("long"), F.lit(subroots.count()).cast("long")
    of_table = layers(subroots.select(zero.alias("tree"), F.col("tree").alias("pos"), size.alias("n"), "node", "below"))
    none = F.array().cast("array<string>")
    root = F.col("node")
    top = of_table[-1][0].select("tree", "pos", "below", "node", none.alias("left"), none.alias("right"), root.alias("subroot"), root.alias("root"))
    # The leaves of the table's tree are the tops of the sources' trees.
    outer = _down(of_table[:-1], top).select(
        F.col("pos").alias("tree"), zero.alias("pos"), "below", "node", "left", "right", F.col("node").alias("subroot"), "root"
    )
    outer = _down(of_source[1:-1], outer)
    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    out = _cogrouped(of_source[0], outer, ["doc_id", "changed"], _checked, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
