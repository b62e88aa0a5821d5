"""Near-duplicate embeddings by NN-descent.

A neighbour graph starts from random projections: vectors sorted by sign bits and one
projection are compared with the few that follow, in several orders.  Probes, made at the
threshold from sampled vectors, go through the same orders, which are added until nearly
all probes meet a vector they link with: a pair that links with nothing else is found by
the orders or not at all, and its chance in one order falls with the table's size.  Then
neighbours of neighbours are joined: every vector brings the vectors on its list together,
close pairs enter both lists, lists keep the closest, until few links are new.

A list full of links is saturated, and links between two such vectors may be on neither
list.  Inside a component all its vectors are compared block by block, so that all links
are counted and none is listed.  Across components the saturated vectors are dealt to
cells around one of their links; cells that the triangle inequality does not part are
compared, and components that a link joins become one.

The whole is audited by comparing sampled vectors with all others; too few of all their
links adds orders and goes on, and a search that stays short fails.

Equal vectors collapse first.  Tasks see lists of bounded length, or two blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from webcairn.llm.common import materialize, table, textkit as tk
from webcairn.llm.graph import components

THRESHOLD = 0.95
LIST = 12
#: Pairs below are not followed; two links in a row are 2 acos(0.95) apart, a cosine of 0.8.
FOLLOW = 0.7
ORDERS = 10
SPAN = 6
ROUNDS = 6
AUDIT = 256
#: Most probes, and one for so many vectors at most.
PROBES = 1000
PROBE_SHARE = 20
RECALL = 0.995
MORE_ORDERS = 5
#: A search that is short of RECALL after so many orders fails.
MOST_ORDERS = 160
BLOCK = 512
CELLS = 1024
SEED = 29


def _unit(column, dim, width):
    """Unit rows in double precision of a column of float bytes (``width`` each), all of one dimension."""
    x = np.frombuffer(tk.buffer_of(column)[0].tobytes(), f"f{width}").reshape(-1, dim).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _clean(width):
    """Bytes of each usable vector, null for the others."""

    def scan(batches):
        for batch in batches:
            out = []
            for v in batch.column("vector"):
                got = None
                if v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    with np.errstate(all="ignore"):
                        size = float((x * x).sum())
                    if np.isfinite(x).all() and 0 < size < np.inf:
                        got = (x + 0.0).astype(f"f{width}").tobytes()
                out.append(got)
            names = [c for c in batch.schema.names if c != "vector"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.binary())], [*names, "vec"])

    return scan


def _project(orders, bits, seed, width):
    """A row per order: sign bits of ``bits`` projections and the value of one more."""

    def scan(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.diff(tk.buffer_of(batch.column("vec"))[1]) // width
            for dim in np.unique(sizes):
                use = np.flatnonzero(sizes == dim)
                part = batch.take(pa.array(use))
                if dim not in planes:
                    rng = np.random.default_rng([seed, int(dim)])
                    planes[dim] = np.stack([rng.standard_normal((int(dim), bits + 1)) for _ in orders])
                x = _unit(part.column("vec"), int(dim), width)
                for t, plane in zip(orders, planes[dim]):
                    y = x @ plane
                    sign = ((y[:, :bits] > 0) << np.arange(bits)).sum(axis=1).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("node"),
                            part.column("vec"),
                            pa.array(np.full(len(use), t * 100_000 + dim, np.int64)),
                            pa.array(sign),
                            pa.array(y[:, bits]),
                        ],
                        ["node", "vec", "turn", "sign", "value"],
                    )

    return scan


def _following(span, follow, width):
    """Pairs of each row with the rows right behind it in the same order."""

    def scan(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch.select(["node", "vec", "turn"])])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            held = rows.slice(max(0, len(rows) - span))
            node, turn = rows["node"].to_numpy(), rows["turn"].to_numpy()
            for value in np.unique(turn):
                use = np.flatnonzero(turn == value)
                x = _unit(rows["vec"].take(pa.array(use)), int(value % 100_000), width)
                for gap in range(1, min(span, len(use) - 1) + 1):
                    sim = (x[:-gap] * x[gap:]).sum(axis=1)
                    ok = np.flatnonzero(sim >= follow)
                    yield _pairs(node[use[ok]], node[use[ok + gap]], sim[ok])

    return scan


def _pairs(a, b, sim):
    keep = a != b
    a, b, sim = a[keep], b[keep], sim[keep]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sim)], ["a", "b", "sim"]
    )


def _join_lists(follow, width):
    """Close pairs among the vectors that one list brings together; rows come sorted by list."""

    def emit(rows):
        lists, node = rows["list"].to_numpy(), rows["node"].to_numpy()
        size = np.diff(tk.buffer_of(rows["vec"])[1]) // width
        head = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]]) if len(lists) else np.zeros(0, np.int64)
        number = np.diff(np.r_[head, len(lists)])
        for dim in np.unique(size):
            for n in np.unique(number[(number > 1) & (size[head] == dim)]):
                first = head[(number == n) & (size[head] == dim)]
                for s in range(0, len(first), 2000):
                    idx = first[s : s + 2000, None] + np.arange(n)
                    x = _unit(rows["vec"].take(pa.array(idx.ravel())), int(dim), width).reshape(len(idx), n, dim)
                    sims = x @ x.transpose(0, 2, 1)
                    i, j = np.triu_indices(n, 1)
                    near = sims[:, i, j]
                    g, p = np.nonzero(near >= follow)
                    yield _pairs(node[idx[g, i[p]]], node[idx[g, j[p]]], near[g, p])

    def scan(batches):
        held = None
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            lists = rows["list"].to_numpy()
            cut = int(np.searchsorted(lists, lists[-1]))
            held = rows.slice(cut)
            yield from emit(rows.slice(0, cut))
        if held is not None:
            yield from emit(held)

    return scan


def _probes(sample, threshold, width):
    """A vector just above the threshold from each sampled one, in a random direction; ids below 0."""
    rng, out = np.random.default_rng(SEED), []
    cos = min(1.0, threshold + 1e-5)
    for i, (_, vec) in enumerate(sample):
        x = np.frombuffer(vec, f"f{width}").astype(np.float64)
        x /= np.sqrt(x @ x)
        y = rng.standard_normal(len(x))
        y -= (y @ x) * x
        size = np.sqrt(y @ y)
        if len(x) > 1 and size > 1e-9:
            out.append((-1 - i, (cos * x + np.sqrt(1 - cos * cos) * y / size).astype(f"f{width}").tobytes()))
    return out


def _audit(sample, threshold, width):
    """How many rows of each batch every sampled vector links with."""
    own = np.array([s[0] for s in sample], np.int64)
    size = np.array([len(s[1]) // width for s in sample], np.int64)
    by_dim = {int(d): np.flatnonzero(size == d) for d in np.unique(size)}
    units = {d: _unit(pa.array([sample[i][1] for i in use]), d, width) for d, use in by_dim.items()}

    def scan(batches):
        for batch in batches:
            size = np.diff(tk.buffer_of(batch.column("vec"))[1]) // width
            node, number = batch.column("node").to_numpy(), batch.column("number").to_numpy()
            for dim, use in by_dim.items():
                rows = np.flatnonzero(size == dim)
                if len(rows):
                    near = _unit(batch.column("vec").take(pa.array(rows)), dim, width) @ units[dim].T >= threshold
                    near &= node[rows][:, None] != own[use][None, :]
                    want = (number[rows] @ near).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(own[use]), pa.array(want)], ["node", "want"])

    return scan


def _cells_in_reach(threshold, width):
    """Pairs of cells of two components that a link may join; linked when it joins their centres.

    A link between vectors spans the angle of the threshold at most, so the centres are
    no further apart than that and both radii.  Of two components that linked centres
    join one such pair is enough.
    """
    most = np.arccos(threshold) + 1e-6

    def block(rows: pa.Table) -> pa.Table:
        side, node, component, radius = (rows[c].to_numpy() for c in ("side", "centre", "component", "radius"))
        size = np.diff(tk.buffer_of(rows["vec"])[1]) // width
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
        for dim in np.unique(size):
            left, right = np.flatnonzero((size == dim) & (side != 2)), np.flatnonzero((size == dim) & (side != 1))
            sims = _unit(rows["vec"].take(pa.array(left)), int(dim), width) @ _unit(rows["vec"].take(pa.array(right)), int(dim), width).T
            near = np.arccos(np.clip(sims, -1.0, 1.0)) <= most + radius[left][:, None] + radius[right][None, :]
            near &= component[left][:, None] != component[right][None, :]
            near &= (side[left][:, None] != 0) | (node[left][:, None] < node[right][None, :])
            i, j = np.nonzero(near)
            linked, p, q = sims[i, j] >= threshold, left[i], right[j]
            two = np.stack([np.minimum(component[p], component[q]), np.maximum(component[p], component[q])], axis=1)
            _, pair = np.unique(two, axis=0, return_inverse=True)
            pair = pair.reshape(-1)
            joined = np.zeros(len(two), bool)
            joined[pair[linked]] = True
            first = np.zeros(len(two), bool)
            first[np.flatnonzero(linked)[np.unique(pair[linked], return_index=True)[1]]] = True
            use = first | ~joined[pair]
            out.append((node[p[use]], node[q[use]], linked[use]))
        return pa.table({name: pa.array(np.concatenate(x)) for name, x in zip(("a", "b", "linked"), zip(*out))})

    return block


def _joined_cells(threshold, width):
    """One link between the two cells of a pair, if there is any."""

    def pair(rows: pa.Table) -> pa.Table:
        side, node = rows["side"].to_numpy(), rows["node"].to_numpy()
        dim = len(rows["vec"][0].as_py()) // width
        x = _unit(rows["vec"], dim, width)
        left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        got = []
        for s in range(0, len(left), BLOCK):
            for t in range(0, len(right), BLOCK):
                i, j = np.nonzero(x[left[s : s + BLOCK]] @ x[right[t : t + BLOCK]].T >= threshold)
                if len(i):
                    got = [(int(node[left[s + i[0]]]), int(node[right[t + j[0]]]))]
                    break
            if got:
                break
        return pa.table({"a": pa.array([g[0] for g in got], pa.int64()), "b": pa.array([g[1] for g in got], pa.int64())})

    return pair


def _count_block(threshold, width):
    def block(rows: pa.Table) -> pa.Table:
        side, node, number = rows["side"].to_numpy(), rows["node"].to_numpy(), rows["number"].to_numpy()
        dim = len(rows["vec"][0].as_py()) // width
        x = _unit(rows["vec"], dim, width)
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        near = x[left] @ x[right].T >= threshold
        near &= node[left][:, None] != node[right][None, :]
        links = near @ number[right]
        if (side != 0).any():  # two blocks: each side counts the other
            out = np.r_[node[left], node[right]], np.r_[links, near.T @ number[left]]
        else:
            out = node[left], links
        return pa.table({"node": pa.array(out[0]), "links": pa.array(out[1].astype(np.int64))})

    return block


def _ranked(edges: DataFrame, size: int) -> DataFrame:
    """list, node, sim: the closest ``size`` neighbours of every node."""
    both = edges.select(F.col("a").alias("list"), F.col("b").alias("node"), "sim").unionByName(
        edges.select(F.col("b").alias("list"), F.col("a").alias("node"), "sim")
    )
    order = Window.partitionBy("list").orderBy(F.desc("sim"), "node")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def _kept(edges: DataFrame, size: int) -> DataFrame:
    ranked = _ranked(edges, size)
    return ranked.groupBy(F.least("list", "node").alias("a"), F.greatest("list", "node").alias("b")).agg(F.max("sim").alias("sim"))


def _blocked(rows: DataFrame, id: str, blocks) -> DataFrame:
    """Every row once per other block, with i, j (the two blocks) and side (0 where they are one)."""
    mine = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), id), F.col("blocks")).cast("int"))
    return mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *rows.columns,
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"),
    )


def _ordered(nodes, probes, edges, met, done, bits, threshold, size, follow, width):
    """Edges with those of more orders: until the probes are met, but one turn at least."""
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "a bigint, b bigint, sim double"
    vectors = nodes.select("node", "vec")
    if probes:
        vectors = vectors.unionByName(spark.createDataFrame(probes, "node bigint, vec binary"))
    while True:
        orders = range(done, done + (MORE_ORDERS if done else ORDERS))
        start = materialize(
            vectors.mapInArrow(
                _project(list(orders), bits, SEED + done, width), "node bigint, vec binary, turn bigint, sign bigint, value double"
            )
            .repartitionByRange(parts, "turn", "sign", "value")
            .sortWithinPartitions("turn", "sign", "value")
            .mapInArrow(_following(SPAN, follow, width), schema)
        )
        done = orders.stop
        hits = start.where((F.col("a") < 0) & (F.col("b") >= 0) & (F.col("sim") >= threshold))
        met |= {r["a"] for r in hits.select("a").distinct().collect()}  # at most PROBES
        own = start.where(F.col("a") >= 0)
        edges = materialize(_kept(edges.unionByName(own).groupBy("a", "b").agg(F.max("sim").alias("sim")), size))
        if len(met) >= RECALL * len(probes) or done >= MOST_ORDERS:
            return edges, done


def _descended(nodes, edges, size, follow, width):
    """Edges after neighbours of neighbours have met, until few are new."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    before = edges.agg(F.count(F.lit(1)), F.sum("sim")).first()
    for _ in range(ROUNDS):
        members = _ranked(edges, size).select("list", "node").unionByName(
            edges.select(F.explode(F.array("a", "b")).alias("list")).distinct().select("list", F.col("list").alias("node"))
        )
        brought = members.join(nodes.select("node", "vec"), "node")
        found = (
            brought.repartition(parts, "list")
            .sortWithinPartitions("list")
            .mapInArrow(_join_lists(follow, width), "a bigint, b bigint, sim double")
        )
        edges = materialize(_kept(edges.unionByName(found).groupBy("a", "b").agg(F.max("sim").alias("sim")), size))
        after = edges.agg(F.count(F.lit(1)), F.sum("sim")).first()
        if not after[0] or after[0] - before[0] <= 0.001 * after[0] and after[1] - before[1] <= 0.0005 * after[1]:
            break
        before = after
    return edges


def _bridges(nodes, links, ends, full, place, threshold, width) -> DataFrame | None:
    """a, b: links that join components of ``place``, found among the saturated vectors (``full``).

    A vector that is not saturated has all its links on its list.  A saturated one goes
    to the cell of the least of itself and its links in a random order.
    """
    turn = F.xxhash64(F.lit(SEED), "other")
    options = full.join(ends, "node").unionByName(full.select("node", F.col("node").alias("other"), F.lit(1.0).alias("sim")))
    cells = (
        options.groupBy("node")
        .agg(F.min(F.struct(turn.alias("turn"), "other", "sim")).alias("c"))
        .select("node", F.col("c.other").alias("centre"), F.acos(F.least(F.lit(1.0), "c.sim")).alias("angle"))
    )
    cells = materialize(cells)
    radius = cells.groupBy("centre").agg(F.max("angle").alias("radius"))
    vectors = nodes.select("node", "vec")
    centres = radius.join(place.withColumnRenamed("node", "centre"), "centre").join(vectors.withColumnRenamed("node", "centre"), "centre")
    centres = materialize(centres)
    number = centres.count()
    if not number:
        return None
    spread = _blocked(centres, "centre", F.lit(-(-number // CELLS)))
    near = materialize(
        spread.groupBy("i", "j").applyInArrow(_cells_in_reach(threshold, width), "a bigint, b bigint, linked boolean")
    )
    bridges = materialize(near.where("linked").select("a", "b"))
    open_pairs = near.where("NOT linked").select("a", "b")
    if not open_pairs.isEmpty():
        if not bridges.isEmpty():
            place = materialize(components(links.unionByName(bridges)))
        for end in ("a", "b"):
            open_pairs = open_pairs.join(place.select(F.col("node").alias(end), F.col("component").alias(f"in_{end}")), end)
        open_pairs = materialize(open_pairs.where("in_a <> in_b").select("a", "b"))
        members = cells.join(vectors, "node").select("node", "centre", "vec")
        both = [
            open_pairs.join(members.withColumnRenamed("centre", end), end).select("a", "b", "node", "vec", F.lit(side).alias("side"))
            for side, end in ((1, "a"), (2, "b"))
        ]
        pairs = both[0].unionByName(both[1]).groupBy("a", "b")
        found = pairs.applyInArrow(_joined_cells(threshold, width), "a bigint, b bigint")
        bridges = materialize(bridges.unionByName(found))
    return bridges


def _placed(nodes, edges, threshold, size, width) -> DataFrame:
    """vec_key, node, least, component and all_links (rows of other vectors) of every node."""
    close = materialize(edges.where(F.col("sim") >= threshold))
    links = close.select("a", "b")
    place = materialize(components(links))
    ends = close.select(F.col("a").alias("node"), F.col("b").alias("other"), "sim").unionByName(
        close.select(F.col("b").alias("node"), F.col("a").alias("other"), "sim")
    )
    direct = (
        ends.join(nodes.select(F.col("node").alias("other"), "number"), "other")
        .groupBy("node")
        .agg(F.sum("number").alias("links"), F.count(F.lit(1)).alias("full"))
    )
    direct = materialize(direct)
    full = direct.where(F.col("full") >= size).select("node")
    bridges = _bridges(nodes, links, ends, full, place, threshold, width)
    if bridges is not None and not bridges.isEmpty():
        place = materialize(components(links.unionByName(bridges)))
    crowded = full.join(place, "node").select("component").distinct()
    members = materialize(place.join(crowded, "component", "left_semi").join(nodes.select("node", "vec", "number"), "node"))
    widths = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK))).cast("int").alias("wide"))
    spread = _blocked(members.join(widths, "component"), "node", F.col("wide"))
    counted = spread.select("component", "i", "j", "side", "node", "number", "vec").groupBy("component", "i", "j")
    counted = counted.applyInArrow(_count_block(threshold, width), "node bigint, links bigint")
    counted = counted.groupBy("node").agg(F.sum("links").alias("all_links"))
    return materialize(
        nodes.select("vec_key", "node", "number", "least")
        .join(place, "node", "left")
        .join(direct, "node", "left")
        .join(counted, "node", "left")
        .select(
            "vec_key",
            "node",
            "number",
            "least",
            F.coalesce("component", "node").alias("component"),
            F.coalesce("all_links", "links", F.lit(0)).cast("bigint").alias("all_links"),
        )
    )


def search(nodes: DataFrame, threshold: float, size: int, follow: float, width: int) -> tuple[DataFrame, int]:
    """``nodes`` with component and all_links, and the number of orders it took."""
    spark = nodes.sparkSession
    n = nodes.count()
    bits = max(1, min(40, int(np.ceil(np.log2(max(n, 2) / 32)))))
    drawn = nodes.orderBy(F.xxhash64(F.lit(SEED), "node")).limit(max(AUDIT, min(PROBES, n // PROBE_SHARE)))
    sample = [(r["node"], bytes(r["vec"])) for r in drawn.select("node", "vec").collect()]
    probes = _probes(sample[: min(PROBES, n // PROBE_SHARE)], threshold, width)
    audited = sample[:AUDIT]
    wanted = nodes.select("node", "vec", "number").mapInArrow(_audit(audited, threshold, width), "node bigint, want bigint")
    wanted = materialize(wanted.groupBy("node").agg(F.sum("want").alias("want")))
    edges, met, done = spark.createDataFrame([], "a bigint, b bigint, sim double"), set(), 0
    while True:
        edges, done = _ordered(nodes, probes, edges, met, done, bits, threshold, size, follow, width)
        edges = _descended(nodes, edges, size, follow, width)
        placed = _placed(nodes, edges, threshold, size, width)
        hit, want = placed.join(F.broadcast(wanted), "node").agg(F.sum(F.least("want", "all_links")), F.sum("want")).first()
        recall = hit / want if want else 1.0
        if min(recall, len(met) / len(probes) if probes else 1.0) >= RECALL:
            return placed, done
        if done >= MOST_ORDERS:
            raise RuntimeError(f"{done} orders found {recall:.4f} of the audited links and {len(met)} of {len(probes)} probes")


def near_duplicates(
    rows: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    threshold: float = THRESHOLD,
    size: int = LIST,
    follow: float = FOLLOW,
) -> DataFrame:
    """Rows without the vector, with n_links, component_id and kept.

    Vectors that are null, empty, zero or hold null or non-finite parts link with
    nothing; vectors of different dimensions neither.  n_links counts the other rows
    linked directly, equal vectors included; component_id is the least id reachable.
    """
    rest = [c for c in rows.columns if c not in (vector, "n_links", "component_id", "kept", "vec", "node")]
    width = 4 if rows.schema[vector].dataType.elementType.typeName() == "float" else 8
    base = rows.select(*rest, F.col(vector).alias("vector"))
    clean = base.mapInArrow(_clean(width), base.drop("vector").schema.add("vec", "binary")).withColumn("vec_key", F.sha2("vec", 256))
    clean = materialize(clean)
    nodes = materialize(
        clean.where("vec IS NOT NULL")
        .groupBy("vec_key")
        .agg(F.any_value("vec").alias("vec"), F.count(F.lit(1)).alias("number"), F.min(id).alias("least"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    placed, _ = search(nodes, threshold, size, follow, width)
    placed = placed.withColumn("n_links", F.col("all_links") + F.col("number") - 1)
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    final = materialize(placed.join(named, "component").select("vec_key", "n_links", "component_id"))
    component = F.coalesce("component_id", F.col(id))
    return clean.join(final, "vec_key", "left").select(
        *rest,
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        component.alias("component_id"),
        F.col(id).eqNullSafe(component).alias("kept"),
    )


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
