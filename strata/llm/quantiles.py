"""Percentiles of very large numeric columns (problem 5): q-digests.

Values are quantized to an ordered universe of 2**17 codes: sign, exponent and the ten bits
after the leading one, so |value| < 2048 is exact and others are within 2**-10 of
themselves; no value is clipped. A digest is a set of counted nodes of the binary tree over
the codes. Compression moves a pair of siblings into the parent while pair and parent
together weigh at most n / k; digests merge by adding the counts of equal nodes.

Each map task compresses what it has before the shuffle, then the sums are compressed again.

Bound, deterministic: a node above the leaves weighs at most n / k, a leaf lies below 17
nodes, so the rank of every answer is wrong by at most 17 * floor(n / k) <= eps * n, also
after any merges. A digest has at most 3 * k nodes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bits import bit_width
from .names import apart

#: Bits after the leading one that quantization keeps.
MANTISSA = 10
#: Depth of the tree: codes 0 .. 2**17 - 1, zero in the middle.
DEPTH = 17
ZERO = 1 << (DEPTH - 1)
#: Greatest rank error as a share of n.
EPS = 0.005
PERCENTILES = (0.5, 0.9, 0.99)
#: Leaves that a map task holds.
HELD = 1 << 20


def _shape(eps: float) -> int:
    """k of the bound."""
    return -(-DEPTH * 1_000_000 // round(eps * 1_000_000))


def quantize(value: Column) -> Column:
    """Ordered code of a BIGINT; the least BIGINT counts as its neighbour."""
    v = F.greatest(value, F.lit(-(2**63) + 1))
    a = F.abs(v)
    e = F.greatest(bit_width(a) - (MANTISSA + 1), F.lit(0))  # shift that leaves MANTISSA + 1 bits
    code = F.shiftleft(e.cast("bigint"), MANTISSA) + F.call_function("shiftrightunsigned", a, e)
    return F.when(v < 0, ZERO - code).otherwise(ZERO + code).cast("int")


def dequantize(code: Column) -> Column:
    """The least magnitude of a code, with its sign: exact below 2048."""
    c = F.abs(code - ZERO).cast("bigint")
    e = F.greatest(F.shiftright(c, MANTISSA) - 1, F.lit(0)).cast("int")
    a = F.call_function("shiftleft", c - F.shiftleft(e.cast("bigint"), MANTISSA), e)
    return F.when(code < ZERO, -a).otherwise(a)


def partials(df: DataFrame, value: str, groups: Sequence[str], eps: float = EPS) -> DataFrame:
    """groups, node, n: digests of each map task, before any shuffle. Null values are left out; null groups are groups.

    A task counts leaves as its rows come and, when HELD of them are held or the rows end,
    compresses those of each group, so a group sends at most 3 * k nodes each time, and a
    hot group costs no more than any other.
    """
    apart(groups, ("node", "n"))
    k, names = _shape(eps), list(groups)
    rows = df.where(F.col(value).isNotNull()).select(*names, (quantize(F.col(value)) + (1 << DEPTH)).cast("int").alias("node"))
    schema = T.StructType([*rows.schema.fields, T.StructField("n", T.LongType())])

    def added(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by([*names, "node"]).aggregate([("n", "sum")]).rename_columns([*names, "node", "n"])

    def compressed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        # With no groups, all rows are one.
        cells = table.group_by(names).aggregate([("node", "list"), ("n", "list")])
        node, n = (cells[c].combine_chunks() for c in ("node_list", "n_list"))
        nodes, counts, bounds = node.values.to_numpy(), n.values.to_numpy(), node.offsets.to_numpy()
        parts = [compress_nodes(nodes[a:b].astype(np.int64), counts[a:b], k) for a, b in zip(bounds, bounds[1:])]
        at = pa.array(np.repeat(np.arange(len(parts)), [len(p) for p, _ in parts]))
        out = {g: cells[g].take(at) for g in names}
        out |= {"node": pa.array(np.concatenate([p for p, _ in parts]), pa.int32()), "n": pa.array(np.concatenate([c for _, c in parts]), pa.int64())}
        yield from pa.table(out).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            ones = pa.Table.from_batches([batch]).append_column("n", pa.array(np.ones(batch.num_rows, np.int64)))
            if batch.num_rows:
                held.append(added([ones]))
                size += held[-1].num_rows
            if size > HELD:
                held = [added(held)]
                if (size := held[0].num_rows) > HELD // 2:
                    yield from compressed(held[0])
                    held, size = [], 0
        if held:
            yield from compressed(added(held))

    return rows.mapInArrow(run, schema)


def compress_nodes(node: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and counts of one digest after compression, level by level from the leaves."""
    limit = int(n.sum()) // k
    if limit == 0:
        return node, n
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    depth = np.floor(np.log2(node)).astype(np.int64)
    at = {d: (node[depth == d], n[depth == d]) for d in range(DEPTH + 1)}
    for d in range(DEPTH, 0, -1):
        here, count = at[d]
        if not len(here):
            continue
        up, upcount = at[d - 1]
        parents, inverse = np.unique(np.concatenate([here >> 1, up]), return_inverse=True)
        total = np.zeros(len(parents), np.int64)
        np.add.at(total, inverse, np.concatenate([count, upcount]))
        moved = (total <= limit)[inverse[: len(here)]]
        kept.append((here[~moved], count[~moved]))
        stays = np.zeros(len(parents), np.int64)
        np.add.at(stays, inverse, np.concatenate([np.where(moved, count, 0), upcount]))
        at[d - 1] = (parents[stays > 0], stays[stays > 0])
    kept.append(at[0])
    return np.concatenate([a for a, _ in kept]), np.concatenate([b for _, b in kept])


def compress(nodes: DataFrame, groups: Sequence[str], eps: float = EPS) -> DataFrame:
    """groups, node, n: the digest of each group; nodes of a group must be unique.

    A task holds one group at a time, at most 2**18 nodes.
    """
    k = _shape(eps)
    names = list(groups)

    def digest(table: pa.Table) -> pa.Table:
        node, n = compress_nodes(table["node"].to_numpy().astype(np.int64), table["n"].to_numpy(), k)
        columns = {g: pa.repeat(table[g][0], len(node)) for g in names}
        return pa.table(columns | {"node": pa.array(node, pa.int32()), "n": pa.array(n, pa.int64())})

    schema = T.StructType([T.StructField(g, nodes.schema[g].dataType) for g in names] + [T.StructField("node", T.IntegerType()), T.StructField("n", T.LongType())])
    return nodes.select(*names, "node", "n").groupBy(*names).applyInArrow(digest, schema)


def merge(nodes: DataFrame, groups: Sequence[str], eps: float = EPS) -> DataFrame:
    """The digests of coarser groups, or of several digests in one DataFrame."""
    return compress(nodes.groupBy(*groups, "node").agg(F.sum("n").alias("n")), groups, eps)


def digests(df: DataFrame, value: str, groups: Sequence[str], eps: float = EPS) -> DataFrame:
    """groups, node, n: the digest of each group of df, the mergeable partial result."""
    return merge(partials(df, value, groups, eps), groups, eps)


def cube(nodes: DataFrame, groups: Sequence[str], never_null: Sequence[str] = (), eps: float = EPS) -> DataFrame:
    """Digests of every combination of groups, with by_<group> saying which take part.

    never_null: as in the distinct counts, rows without such a group count only where it takes no part.
    """
    sets = [[g for i, g in enumerate(groups) if mask >> i & 1] + ["node"] for mask in range(1 << len(groups))]
    out = nodes.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*groups, "node")])
    out = out.agg(F.sum("n").alias("n"), *[(F.grouping(g) == 0).alias(f"by_{g}") for g in groups])
    for g in never_null:
        out = out.where(~F.col(f"by_{g}") | F.col(g).isNotNull())
    return compress(out, (*groups, *[f"by_{g}" for g in groups]), eps)


def quantiles(nodes: DataFrame, groups: Sequence[str], at: Sequence[float] = PERCENTILES, eps: float = EPS) -> DataFrame:
    """groups, n, p<percent> for each of at, max_rank_error.

    The answer to q is the upper end of the first node, by upper end and then from the leaf
    up, at which the running count reaches q * n; its value is that of the code, toward
    zero. Its rank lies between q * n and q * n + max_rank_error.
    """
    g = list(groups)
    level = bit_width(F.col("node").cast("bigint")) - 1
    top = F.call_function("shiftleft", F.col("node").cast("bigint") + 1, (F.lit(DEPTH) - level).cast("int")) - 1 - (1 << DEPTH)
    rows = nodes.select(*g, "n", top.alias("_top"), level.alias("_level"))
    w = Window.partitionBy(*g)
    run = rows.withColumn("_run", F.sum("n").over(w.orderBy("_top", F.desc("_level")).rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("_n", F.sum("n").over(w))
    picks = [F.min(F.when(F.col("_run") >= F.ceil(F.lit(Decimal(str(q))) * F.col("_n")), F.col("_top"))) for q in at]
    out = run.groupBy(*g).agg(F.sum("n").alias("n"), *[p.alias(f"_p{i}") for i, p in enumerate(picks)])
    return out.select(
        *g,
        "n",
        *[dequantize(F.col(f"_p{i}")).alias(f"p{q * 100:g}".replace(".", "_")) for i, q in enumerate(at)],
        (F.floor(F.col("n") / _shape(eps)) * DEPTH).cast("bigint").alias("max_rank_error"),
    )
