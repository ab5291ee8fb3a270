"""Near-duplicate embeddings by NN-descent."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.llm.common import column, stored
from ticketloom.llm.components import components

TABLES = 6
CELL = 48
MISSED = 0.02
FURTHER_BITS = 16
FOUND = "u bigint, v bigint, sim double, link boolean"


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def groups_of(batch: pa.RecordBatch, name: str) -> Iterator[tuple[pa.StructArray, np.ndarray]]:
    """The members of each row's group and their unit vectors."""
    lists = batch.column(name)
    flat, ends = lists.values, lists.offsets.to_numpy()
    vec = flat.field("vec")
    values, edges = vec.values.to_numpy(zero_copy_only=False), vec.offsets.to_numpy()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b > a:
            yield flat.slice(a, b - a), unit(values[edges[a] : edges[b]].reshape(b - a, -1))


def stars(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of a symmetric matrix, reduced to a star for each set of places that they connect."""
    at = np.arange(len(near))
    near, label = near | np.eye(len(near), dtype=bool), at
    while True:
        least = np.where(near, label[None, :], len(near)).min(axis=1)
        least = least[least]
        if (least == label).all():
            tied = np.flatnonzero(label != at)
            return tied, label[tied]
        label = least


def _found(u: list[np.ndarray], v: list[np.ndarray], sim: list[np.ndarray], link: list[np.ndarray]) -> pa.RecordBatch:
    def one(x: list[np.ndarray], kind: type) -> pa.Array:
        return pa.array(np.concatenate(x) if x else np.zeros(0, kind))

    columns = [one(u, np.int64), one(v, np.int64), one(sim, np.float64), one(link, bool)]
    return pa.RecordBatch.from_arrays(columns, names=["u", "v", "sim", "link"])


def _proposed(node: np.ndarray, g: np.ndarray, i: np.ndarray, j: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows ``u, v, sim, link``: neighbours (i, j), and stars of all links near, whatever the lists have room for."""
    a, b = stars(near)
    u, v = np.r_[i, a], np.r_[j, b]
    return node[u], node[v], g[u, v], np.arange(len(u)) >= len(i)


def seeded(batches: Iterator[pa.RecordBatch], k: int, cosine: float) -> Iterator[pa.RecordBatch]:
    """First neighbour lists, the nearest k inside each cell; and all links inside it."""
    for batch in batches:
        rows = []
        for members, x in groups_of(batch, "members"):
            node, g = members.field("node").to_numpy(), x @ x.T
            np.fill_diagonal(g, -2)
            near = min(k, len(node) - 1)
            if near < 1:
                continue
            best = np.argpartition(-g, near - 1, axis=1)[:, :near]
            rows.append(_proposed(node, g, np.repeat(np.arange(len(node)), near), best.ravel(), g >= cosine))
        yield _found(*([r[c] for r in rows] for c in range(4)))


def joined_locally(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Neighbours of one centre compared with each other: what betters the worst entry of a list is proposed to it; all links between components."""
    for batch in batches:
        rows = []
        for members, x in groups_of(batch, "members"):
            node, component, inner, outer = (members.field(c).to_numpy() for c in ("node", "component", "inner", "outer"))
            g, same = x @ x.T, component[:, None] == component[None, :]
            np.fill_diagonal(g, -2)
            worst = np.where(same, inner[:, None], outer[:, None])
            i, j = np.nonzero(g > np.maximum(worst, -1.5))
            rows.append(_proposed(node, g, i, j, (g >= cosine) & ~same))
        yield _found(*([r[c] for r in rows] for c in range(4)))


def top(proposed: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """``(u, v, sim, same)``: the k most similar neighbours of each node inside its component, and the k outside it.

    A list full of links to its own component thus goes on to what lies beyond it.
    """
    once = proposed.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    placed = once.join(own.select(F.col("node").alias("u"), F.col("component").alias("of_u")), "u", "left").join(
        own.select(F.col("node").alias("v"), F.col("component").alias("of_v")), "v", "left"
    )
    same = F.coalesce(F.col("of_u") == F.col("of_v"), F.lit(False))
    best = F.slice(F.sort_array(F.collect_list(F.struct("sim", "v")), asc=False), 1, k)
    lists = placed.groupBy("u", same.alias("same")).agg(best.alias("best")).select("u", "same", F.explode("best").alias("b"))
    return lists.select("u", "b.v", "b.sim", "same")


def tables_for(bits: int, cosine: float) -> int:
    """How many tables leave a pair at the threshold without a common cell with a probability of at most ``MISSED``."""
    alone = 1 - (1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi) ** bits
    return TABLES if alone <= 0 else max(TABLES, math.ceil(math.log(MISSED) / math.log(min(alone, 1 - 1e-3))))


def first_lists(nodes: DataFrame, n: int, cosine: float, k: int, seed: int) -> DataFrame:
    """Proposals and links from cells of equal random-hyperplane signs, several tables of them.

    A crowded cell is split by further signs; what is still crowded then, such
    as copies, is dealt into parts of about CELL.
    """
    bits = max(1, math.ceil(math.log2(max(n, 2) / CELL))) if n > CELL else 0
    tables = tables_for(bits + 1, cosine) if bits else 1  # about half of the cells are crowded and split once more

    @F.arrow_udf("array<struct<code: bigint, further: bigint>>")
    def codes(vectors: pa.Array) -> pa.Array:
        out, planes, worth = [], {}, 1 << np.arange(bits + FURTHER_BITS, dtype=np.int64)
        for x in vectors:
            x = np.nan_to_num(np.asarray(x.as_py(), dtype=np.float64))
            if len(x) not in planes:
                planes[len(x)] = np.random.default_rng((seed, len(x))).normal(size=(tables * len(worth), len(x)))
            sign = (planes[len(x)] @ x > 0).reshape(tables, len(worth))
            code, further = sign[:, :bits] @ worth[:bits], sign[:, bits:] @ worth[:FURTHER_BITS]
            out.append([{"code": len(x) << 32 | int(c), "further": int(f)} for c, f in zip(code, further, strict=True)])
        return pa.array(out, pa.list_(pa.struct([("code", pa.int64()), ("further", pa.int64())])))

    def parts(keys: list[str]) -> DataFrame:
        return placed.groupBy(keys).agg(F.ceil(F.count(F.lit(1)) / CELL).alias("parts"))

    placed = nodes.select("node", F.posexplode(codes("vec")).alias("table", "c")).select("node", "table", "c.code", "c.further")
    placed = stored(placed, "nn-cells")
    split = F.least(F.lit(FURTHER_BITS), F.ceil(F.log2("parts"))).cast("int")
    kept = F.expr("shiftleft(1L, split) - 1")
    placed = placed.join(parts(["table", "code"]).select("table", "code", split.alias("split")), ["table", "code"])
    placed = stored(placed.select("node", "table", "code", F.col("further").bitwiseAND(kept).alias("sub")), "nn-cells")
    dealt = placed.join(parts(["table", "code", "sub"]), ["table", "code", "sub"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "table", "node"), "parts"))
    cells = dealt.join(nodes.select("node", "vec"), "node").groupBy("table", "code", "sub", "part").agg(F.collect_list(F.struct("node", "vec")).alias("members"))
    return stored(cells.select("members").mapInArrow(lambda it: seeded(it, k, cosine), FOUND), "nn-found")


def refined(nodes: DataFrame, lists: DataFrame, own: DataFrame, cosine: float, k: int, seed: int) -> DataFrame:
    """One round: around every node, its neighbours and up to k of those that list it, inside and outside its component, are compared."""
    drawn = Window.partitionBy("v", "same").orderBy(F.xxhash64(F.lit(seed), "u"))
    back = lists.withColumn("turn", F.row_number().over(drawn)).where(F.col("turn") <= k)
    around = (
        lists.select(F.col("u").alias("centre"), F.col("v").alias("node"))
        .union(back.select(F.col("v").alias("centre"), F.col("u").alias("node")))
        .distinct()
    )

    def worst(part: Column) -> Column:
        return F.when(F.count_if(part) >= k, F.min(F.when(part, F.col("sim")))).otherwise(-2.0)

    least = lists.groupBy(F.col("u").alias("node")).agg(worst(F.col("same")).alias("inner"), worst(~F.col("same")).alias("outer"))
    known = nodes.select("node", "vec").join(least, "node", "left").join(own, "node", "left").select(
        "node", "vec", F.coalesce("component", "node").alias("component"),
        F.coalesce("inner", F.lit(-2.0)).alias("inner"), F.coalesce("outer", F.lit(-2.0)).alias("outer"),
    )
    members = F.collect_list(F.struct("node", "vec", "component", "inner", "outer")).alias("members")
    groups = around.join(known, "node").groupBy("centre").agg(members)
    return stored(groups.select("members").mapInArrow(lambda it: joined_locally(it, cosine), FOUND), "nn-found")


def linked_components(nodes: DataFrame, n: int, cosine: float, k: int, known: DataFrame | None = None, seed: int = 5) -> DataFrame:
    """``(node, component)`` after rounds of NN-descent, until a round finds no further link between components.

    known: components of earlier descents, which stay linked.
    """

    def merged(links: DataFrame) -> DataFrame:
        earlier = links if own is None else links.union(own.select(F.col("node").alias("u"), F.col("component").alias("v")))
        return stored(components(earlier, "nn-components"), "nn-own")

    own, found = known, first_lists(nodes, n, cosine, k, seed)
    own = merged(found.where("link").select("u", "v"))
    lists = stored(top(found.where("NOT link"), own, k), "nn-lists")
    for step in itertools.count(1):
        found = refined(nodes, lists, own, cosine, k, seed + step)
        links = found.where("link").select("u", "v")
        if links.isEmpty():
            return own
        own = merged(links)
        lists = stored(top(lists.select("u", "v", "sim").union(found.where("NOT link").select("u", "v", "sim")), own, k), "nn-lists")


def link_counts(members: DataFrame, cosine: float, block: int = 512) -> DataFrame:
    """``(node, n)``: linked rows of other vectors in the node's component. members: component, node, vec, weight.

    Links are counted in the whole component, however short the lists were.
    Members within half the threshold angle of its centre are linked with each other for sure,
    so they are counted by one sum; only pairs with a member outside that core
    are compared, by blocks of members, and only counts leave a block.
    """
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    parts = members.select("component", F.posexplode("vec").alias("i", "x"), length.alias("length"))
    mean = parts.groupBy("component", "i").agg(F.sum(F.col("x").cast("double") / F.col("length")).alias("x"))
    centre = mean.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("c")).select("component", F.expr("transform(c, p -> p.x)").alias("centre"))
    half = math.cos(math.acos(cosine) / 2) + 1e-9
    dot = F.aggregate(F.zip_with("vec", "centre", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    size = length * F.sqrt(F.aggregate("centre", F.lit(0.0), lambda a, x: a + x * x))
    placed = members.join(centre, "component").select("component", "node", "vec", "weight", F.coalesce(dot / size >= half, F.lit(False)).alias("core"))
    placed = stored(placed, "nn-members")
    sums = placed.groupBy("component").agg(
        F.sum(F.when(F.col("core"), F.col("weight")).otherwise(0)).alias("core_rows"),
        F.ceil(F.count_if(~F.col("core")) / block).cast("int").alias("outer"),
        F.ceil(F.count_if("core") / block).cast("int").alias("inner"),
    )
    known = placed.join(sums, "component")
    sure = known.where("core").select("node", (F.col("core_rows") - F.col("weight")).alias("n"))
    # Blocks 0 to outer - 1 hold the members outside the core, which meet all blocks; those inside meet the outer blocks alone.
    own = F.when(F.col("core"), F.col("outer") + F.pmod(F.xxhash64("node"), F.greatest("inner", F.lit(1)))).otherwise(
        F.pmod(F.xxhash64("node"), F.greatest("outer", F.lit(1)))
    ).cast("int")
    met = F.when(F.col("core"), F.col("outer")).otherwise(F.col("outer") + F.col("inner"))
    spread = known.where("outer > 0").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), met - 1)))
    paired = spread.groupBy("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
        F.collect_list(F.struct("node", "vec", "weight", "own")).alias("members")
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node_out, count_out = [], []
            firsts, seconds = batch.column("i").to_pylist(), batch.column("j").to_pylist()
            for (members_, x), first, second in zip(groups_of(batch, "members"), firsts, seconds, strict=True):
                node, weight = members_.field("node").to_numpy(), members_.field("weight").to_numpy()
                home, linked = members_.field("own").to_numpy(), x @ x.T >= cosine
                if first != second:
                    linked &= home[:, None] != home[None, :]
                np.fill_diagonal(linked, False)
                node_out.append(node)
                count_out.append(linked @ weight)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (node_out, count_out)], names=["node", "n"]
            )

    compared = paired.mapInArrow(counted, "node bigint, n bigint")
    return sure.union(compared).groupBy("node").agg(F.sum("n").alias("n"))


def recall(nodes: DataFrame, found: DataFrame, cosine: float, queries: int, seed: int = 17) -> float:
    """Mean share, over a bounded sample of nodes, of a node's true links that the components hold; by brute force against all nodes."""
    placed = nodes.select("node", "vec").join(found, "node", "left").select("node", "vec", F.coalesce("component", F.lit(-1)).alias("component"))
    drawn = placed.orderBy(F.xxhash64(F.lit(seed), "node")).limit(queries).collect()
    sample: dict[int, list] = {}
    for r in drawn:
        sample.setdefault(len(r["vec"]), []).append(r)
    held = {
        size: (np.array([r["node"] for r in rs]), np.array([r["component"] for r in rs]), unit(np.array([r["vec"] for r in rs])))
        for size, rs in sample.items()
    }

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {d: np.zeros((2, len(q)), np.int64) for d, (q, _, _) in held.items()}
        for batch in batches:
            vec = batch.column("vec")
            size = np.diff(vec.offsets.to_numpy())
            node, component = batch.column("node").to_numpy(), batch.column("component").to_numpy()
            for d, (q, of, x) in held.items():
                at = np.flatnonzero(size == d)
                if len(at):
                    y = unit(vec.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d))
                    true = (y @ x.T >= cosine) & (node[at][:, None] != q[None, :])
                    total[d][0] += true.sum(axis=0)
                    total[d][1] += (true & (component[at][:, None] == of[None, :]) & (of >= 0)[None, :]).sum(axis=0)
        for d, (q, _, _) in held.items():
            some = total[d][0] > 0
            yield pa.RecordBatch.from_arrays([pa.array(q[some]), *(pa.array(t[some]) for t in total[d])], names=["q", "there", "kept"])

    each = placed.mapInArrow(tried, "q bigint, there bigint, kept bigint").groupBy("q").agg((F.sum("kept") / F.sum("there")).alias("share"))
    mean = each.agg(F.avg("share")).first()[0]
    return 1.0 if mean is None else mean


def near_duplicates(
    df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", cosine: float = 0.95, k: int = 10,
    audit: int = 1000, least_recall: float = 0.97, attempts: int = 3,
) -> DataFrame:
    """One row per input row: ``id, n_links, component_id, kept``.

    Equal vectors are brought to one node with a count first. NN-descent refines
    the nodes' neighbour lists: lists start from cells of random hyperplanes,
    and rounds compare the neighbours of each node with each other. Every
    compared pair at the threshold is a link, also where a list has no room for
    it; a list full of its own component keeps as many neighbours outside it,
    and rounds go on while components merge. Inside the components every link
    is counted. A bounded sample is audited against brute force; below
    ``least_recall`` another descent from other hyperplanes, with lists twice as
    long in the first ``attempts``, adds its links. An error is raised when
    these bring no more and the recall is still below.

    n_links counts other rows whose vector has a cosine of at least ``cosine``,
    in double precision; component_id is the smallest id reachable; kept is
    true for it alone. Vectors that are null, zero or hold null or non-finite
    components link with nothing, nor do vectors of different length. Rows that
    repeat id and vector count as rows. A null id is never the smallest, unless
    its component has no other.
    """
    vector = column(vector_column).cast("array<double>")
    rows = stored(
        df.select(column(id_column).cast("bigint").alias("id"), F.when(usable(vector), vector).alias("vec"))
        .withColumn("row", F.monotonically_increasing_id()),
        "nn-rows",
    )
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    alike = rows.where("vec IS NOT NULL").groupBy("vec").agg(F.count(F.lit(1)).alias("weight"), F.min(order).alias("least"))
    nodes = stored(alike.withColumn("node", F.monotonically_increasing_id()), "nn-nodes")
    n = nodes.count()
    found, reached = None, -1.0
    for attempt in itertools.count():
        before = reached
        found = linked_components(nodes, n, cosine, k << min(attempt, attempts - 1), found, seed=5 + 100 * attempt)
        reached = recall(nodes, found, cosine, audit)
        if reached >= least_recall:
            break
        if attempt + 1 >= attempts and reached <= before:
            raise RuntimeError(f"recall of the sampled links stays at {reached:.3f}, below {least_recall}")
    members = nodes.join(found, "node").select("component", "node", "vec", "weight")
    counts = link_counts(members, cosine)
    least = nodes.join(found, "node").groupBy("component").agg(F.min("least").alias("top"))
    where = found.join(least, "component").select("node", "top")
    known = (
        nodes.join(where, "node", "left").join(counts, "node", "left")
        .select("vec", F.coalesce("top", "least").alias("top"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    )
    known = stored(known, "nn-known")
    linked = rows.where("vec IS NOT NULL").join(known, "vec").select("id", "row", "n_links", "top")
    alone = rows.where("vec IS NULL").select("id", "row", F.lit(0).cast("bigint").alias("n_links"), order.alias("top"))
    return linked.union(alone).select(
        "id", "n_links", F.col("top.id").alias("component_id"), F.col("id").eqNullSafe(F.col("top.id")).alias("kept")
    )
