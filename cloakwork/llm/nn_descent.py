"""Near-duplicate vectors by NN-descent, within equal labels.

Equal vectors are one vertex with a count.  A neighbour graph starts from random
hyperplane tables: in each bucket all vertices meet, large buckets in blocks.  The bits
of a table follow the number of vertices of a label, and the number of tables follows
the bits, so that a pair at the threshold meets with probability MEETS in a label of any
size, whatever its other neighbours are.  Then it is
refined: at every vertex its neighbours and reverse neighbours meet each other (the
neighbours-of-neighbours join), better pairs enter the lists, and only pairs with a new
edge are tried again, until hardly any list changes.

Lists have a fixed length, so in a dense group they saturate: all entries are above the
threshold and more may exist.  Components do not rest on the lists: every block also
gives a spanning forest of all its links, so groups that are tighter inside than towards
each other are joined although no list has an entry between them.  The lists of every
component with a saturated vertex are enlarged to the whole component: its members are
compared in blocks, and only counts leave a task, so no group is gathered and no pairs
are emitted.  Recall is audited against brute force for a bounded sample of vertices: the
mean share of its links that a vertex has, over the vertices that have links, apart for
those with few and with many.  The lesser one is the recall.  While it is below
target_recall more tables are added, and at last all vertices of a label are compared, in
blocks; that costs the square of a label's size.

Cosines are taken in double precision from the stored components.  Defined cases: a
vector that is null, empty, zero, or holds a null or non-finite component, or whose
label is null, links with nothing and is its own component; vectors of different
lengths never link; rows with a null id have no component; repeated rows count as
equal vectors; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop_path, importable, materialize
from .components import connected_components

#: Neighbours in a list.
LIST = 8
#: Vertices of a label in a bucket on average, at most; probability that a pair at the threshold meets.
MEAN, MEETS = 512, 0.99
#: Bounds of a plan; a low threshold gets larger buckets instead of more tables.
MAX_BITS, MAX_TABLES = 24, 48
#: Attempts; the last one compares everything of a label.
ATTEMPTS = 3
#: Pairs below this cosine, and below the threshold, do not help and are not listed.
FLOOR = 0.7
#: Members of a bucket or of a component compared at a time.
BLOCK = 1024
#: Blocks of a component that would fill one.
SPLIT = 4
#: Vertices audited; the next number is taken if fewer than AUDIT_LINKED of them have links.
AUDIT, AUDIT_LINKED = (2048, 16384), 64


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _by_length(raw: list[bytes]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, b in enumerate(raw):
        out.setdefault(len(b), []).append(i)
    return out


def plans(threshold: float) -> list[tuple[int, int]]:
    """(bits, tables) by bits from 0: with these a pair at the threshold meets with probability MEETS."""
    one = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    out = [(0, 1)]
    for bits in range(1, MAX_BITS + 1):
        p = one**bits
        tables = 1 if p >= MEETS else math.ceil(math.log(1 - MEETS) / math.log1p(-p)) if p > 0 else MAX_TABLES + 1
        if tables > MAX_TABLES:
            break
        out.append((bits, tables))
    return out


def _tables(attempt: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, g, raw = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            bits, tables = b.column(3).to_numpy(), b.column(4).to_numpy()
            for size, at in _by_length(raw).items():
                for k, n in sorted(set(zip(bits[at].tolist(), tables[at].tolist(), strict=True))):
                    own = [i for i in at if bits[i] == k and tables[i] == n]
                    x = _unit([raw[i] for i in own])
                    for t in range(n):
                        rng = np.random.default_rng([seed, attempt, t, size])
                        code = ((x @ rng.normal(size=(x.shape[1], k)) > 0) * (1 << np.arange(k))).sum(1)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(v[own]), pa.array(g[own]), pa.array(np.full(len(own), t, np.int32)), pa.array(code.astype(np.int32))],
                            names=["v", "g", "t", "code"],
                        )

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, dict[str, list]]]:
    """Runs of equal first column, over batches; the input is sorted by it."""
    key, held = None, None
    for b in batches:
        cols = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
        ks = cols[b.schema.names[0]]
        lo = 0
        for i in range(len(ks) + 1):
            if i == len(ks) or (i > lo and ks[i] != ks[lo]):
                if i > lo:
                    if held is not None and key == ks[lo]:
                        for n, c in cols.items():
                            held[n] += c[lo:i]
                    else:
                        if held is not None:
                            yield key, held
                        key, held = ks[lo], {n: c[lo:i] for n, c in cols.items()}
                lo = i
    if held is not None:
        yield key, held


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At a vertex w: its neighbours (u, fresh, least, vec) meet; better pairs come out."""
    a, b, s = [], [], []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["u", "v", "sim"]
        )

    for _, g in _groups(batches):
        if len(g["u"]) < 2:
            continue
        x, u = _unit(g["vec"]), np.array(g["u"])
        fresh, least = np.array(g["fresh"]), np.array(g["least"])
        c = x @ x.T
        want = (fresh[:, None] | fresh[None, :]) & (c > np.maximum(least, FLOOR)[:, None]) & (u[:, None] != u[None, :])
        i, j = np.nonzero(want)
        a += u[i].tolist()
        b += u[j].tolist()
        s += c[i, j].tolist()
        if len(a) > 50_000:
            yield out()
            a, b, s = [], [], []
    if a:
        yield out()


def _forest(hit: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges from the first member of each component of a symmetric relation to the others."""
    a, b = [], []
    left = hit.any(1)
    for i in np.nonzero(left)[0].tolist():
        if not left[i]:
            continue
        left[i] = False
        front = hit[i] & left
        while front.any():
            at = np.nonzero(front)[0]
            left[at] = False
            a += [i] * len(at)
            b += at.tolist()
            front = hit[at].any(0) & left
    return a, b


def _meet(threshold: float):
    """In a block all pairs meet: the best LIST of each member, and a spanning forest of the links (sim null)."""
    floor = min(FLOOR, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, g in _groups(batches):
            if len(g["v"]) < 2:
                continue
            left = np.array(g["blk"]) == g["lo"][0]
            order = np.argsort(~left, kind="stable")
            v, k = np.array(g["v"])[order], int(left.sum())
            x = _unit([g["vec"][i] for i in order])
            same = g["lo"][0] == g["hi"][0]
            c = x @ x.T if same else x[:k] @ x[k:].T
            if same:
                np.fill_diagonal(c, -2.0)
                sides = [(c, v, v)]
            else:
                sides = [(c, v[:k], v[k:]), (c.T, v[k:], v[:k])]
            for d, us, vs in sides:
                some = np.nonzero((d >= floor).any(1))[0]
                if not len(some):
                    continue
                d = d[some]
                best = np.argpartition(-d, LIST - 1, axis=1)[:, :LIST] if d.shape[1] > LIST else np.tile(np.arange(d.shape[1]), (len(d), 1))
                sim = np.take_along_axis(d, best, 1)
                i, j = np.nonzero(sim >= floor)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(us[some[i]]), pa.array(vs[best[i, j]]), pa.array(sim[i, j])], names=["u", "v", "sim"]
                )
            hit = c >= threshold
            if not hit.any():
                continue
            if not same:
                square = np.zeros((len(v), len(v)), bool)
                square[:k, k:], square[k:, :k] = hit, hit.T
                hit = square
            a, b = _forest(hit)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v[a]), pa.array(v[b]), pa.nulls(len(a), pa.float64())], names=["u", "v", "sim"]
            )

    return run


def _block_links(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, g in _groups(batches):
            v, m = np.array(g["v"]), np.array(g["m"])
            left = np.array(g["blk"]) == np.array(g["lo"])
            same = g["lo"][0] == g["hi"][0]
            x = _unit(g["vec"])
            n = np.zeros(len(v), np.int64)
            if same:
                hit = x @ x.T >= threshold
                np.fill_diagonal(hit, False)
                n += hit @ m
            else:
                hit = x[left] @ x[~left].T >= threshold
                n[left] += hit @ m[~left]
                n[~left] += hit.T @ m[left]
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(n)], names=["v", "n"])

    return run


class NearVectors:
    """One run; result() gives a row for each input row, recall the audited recall."""

    def __init__(
        self,
        rows: DataFrame,
        id_col: str = "vec_id",
        vec_col: str = "embedding",
        label_col: str = "label",
        threshold: float = 0.98,
        target_recall: float = 0.95,
        max_rounds: int = 5,
        seed: int = 3,
    ):
        self.spark = rows.sparkSession
        importable(self.spark)
        self.threshold, self.target, self.max_rounds, self.seed = threshold, target_recall, max_rounds, seed
        self.recall = 1.0
        self.rows = rows.select(
            F.col(id_col).cast("long").alias("vec_id"),
            F.col(label_col).cast("string").alias("label"),
            F.col(vec_col).cast("array<double>").alias("x"),
        )

    def _vertices(self) -> None:
        ok = F.expr(
            "vec_id is not null and label is not null and x is not null and size(x) > 0 and"
            " forall(x, c -> c is not null and not isnan(c) and abs(c) < double('inf')) and exists(x, c -> c <> 0)"
        )
        good = self.rows.where(F.coalesce(ok, F.lit(False)))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                vec = [np.array(r, np.float64) + 0.0 for r in b.column(2).to_pylist()]
                # scaled so that squares neither overflow nor vanish
                vec = [(r / np.abs(r).max()).tobytes() for r in vec]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(vec, pa.binary())], names=["vec_id", "label", "vec"])

        packed = materialize(
            good.select("vec_id", "label", "x").mapInArrow(pack, "vec_id long, label string, vec binary"), "nn-packed"
        )
        self.packed = packed
        self.vertices = materialize(
            packed.groupBy("label", "vec").agg(F.min("vec_id").alias("v"), F.count("*").alias("m")).select("v", "label", "vec", "m"),
            "nn-vertices",
        )
        # vertices that may link: equal label and length
        size = F.length("vec")
        groups = self.vertices.groupBy("label", size.alias("size")).agg(F.min("v").alias("g"), F.count("*").alias("members"))
        self.groups = materialize(groups, "nn-groups")
        own = self.vertices.select("v", "label", size.alias("size"), "vec").join(broadcast_if_small(self.groups), ["label", "size"])
        self.members = own.select("v", "g", "members", "vec")

    def _start(self, attempt: int) -> DataFrame:
        """(u, v, sim) of what meets in the buckets of this attempt; sim is null for spanning edges."""
        plan = plans(self.threshold) if attempt < ATTEMPTS - 1 else [(0, 1)]
        bits = F.least(F.greatest(F.ceil(F.log2(F.col("members") / MEAN)), F.lit(0)), F.lit(len(plan) - 1)).cast("int")
        own = self.members.withColumn("bits", bits)
        own = own.withColumn("tables", F.element_at(F.array(*[F.lit(n) for _, n in plan]), F.col("bits") + 1))
        own = own.withColumn("bits", F.element_at(F.array(*[F.lit(k) for k, _ in plan]), F.col("bits") + 1))
        keys = own.select("v", "g", "vec", "bits", "tables").mapInArrow(
            _tables(attempt, self.seed), "v long, g long, t int, code int"
        )
        table = keys = materialize(keys, "nn-keys")
        bucket = ["g", "t", "code"]
        large = keys.groupBy(*bucket).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
        large = materialize(large.select(*bucket, F.ceil(F.col("n") / BLOCK).cast("int").alias("nb")), "nn-large")
        keys = keys.join(broadcast_if_small(large), bucket, "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
        keys = keys.withColumn("blk", F.pmod(F.xxhash64("v"), F.col("nb")).cast("int"))
        keys = keys.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
        keys = keys.withColumn("lo", F.least("blk", "other")).withColumn("hi", F.greatest("blk", "other"))
        keys = keys.withColumn("task", F.concat_ws(":", *bucket, "lo", "hi"))
        met = keys.join(self.vertices.select("v", "vec"), "v").select("task", "lo", "hi", "blk", "v", "vec")
        met = met.repartition("task").sortWithinPartitions("task")
        out = materialize(met.mapInArrow(_meet(self.threshold), "u long, v long, sim double"), "nn-met")
        drop_path(table)
        drop_path(large)
        return out

    def _top(self, listed: DataFrame) -> DataFrame:
        """The best LIST entries of each u, old entries first among equals."""
        best = listed.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
        order = W.partitionBy("u").orderBy(F.col("sim").desc(), "v")
        return best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= LIST).drop("r")

    def _refine(self, graph: DataFrame) -> DataFrame:
        for _ in range(self.max_rounds):
            fresh = graph.where("fresh").limit(1).count()
            if not fresh:
                break
            least = graph.groupBy("u").agg(F.min("sim").alias("least"), F.count("*").alias("k"))
            least = least.select("u", F.when(F.col("k") < LIST, F.lit(-1.0)).otherwise(F.col("least")).alias("least"))
            back = graph.select(F.col("v").alias("w"), "u", "fresh", "sim")
            rank = F.row_number().over(W.partitionBy("w").orderBy(F.col("sim").desc(), "u"))
            back = back.withColumn("r", rank).where(F.col("r") <= LIST).select("w", "u", "fresh")
            near = graph.select(F.col("u").alias("w"), F.col("v").alias("u"), "fresh").unionByName(back)
            near = near.groupBy("w", "u").agg(F.max("fresh").alias("fresh"))
            live = near.groupBy("w").agg(F.max("fresh").alias("any")).where("any").select("w")
            near = near.join(live, "w").join(least, "u").join(self.vertices.select(F.col("v").alias("u"), "vec"), "u")
            near = near.select("w", "u", "fresh", "least", "vec").repartition("w").sortWithinPartitions("w")
            found = near.mapInArrow(_local_join, "u long, v long, sim double")
            found = found.groupBy("u", "v").agg(F.max("sim").alias("sim"))
            merged = graph.withColumn("fresh", F.lit(False)).unionByName(found.withColumn("fresh", F.lit(True)))
            done, graph = graph, materialize(self._top(merged), "nn-graph")
            drop_path(done)
        return graph

    def _links(self, graph: DataFrame, joins: DataFrame) -> None:
        """Counts and components from the lists and the spanning edges."""
        t = self.threshold
        pairs = graph.where(F.col("sim") >= t).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
        pairs = materialize(pairs, "nn-pairs")
        comp = materialize(connected_components(pairs.unionByName(joins)), "nn-components")
        saturated = graph.groupBy("u").agg(F.min("sim").alias("s"), F.count("*").alias("k"))
        saturated = saturated.where((F.col("k") >= LIST) & (F.col("s") >= t)).select(F.col("u").alias("v"))
        dense = comp.join(saturated, "v").select("component").distinct()
        v = self.vertices
        inside = comp.join(dense, "component").join(v.select("v", "vec", "m"), "v")
        # a bounded block for each hash bucket of a component
        n = F.count("*")
        # a component of some hundred vertices is dealt to several tasks too
        nb = F.greatest(F.ceil(n / BLOCK), F.least(F.lit(SPLIT), F.ceil(n * SPLIT / BLOCK)))
        sizes = inside.groupBy("component").agg(nb.cast("int").alias("nb"))
        inside = inside.join(sizes, "component").withColumn("blk", F.pmod(F.xxhash64("v"), F.col("nb")).cast("int"))
        met = inside.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
        met = met.withColumn("lo", F.least("blk", "other")).withColumn("hi", F.greatest("blk", "other"))
        met = met.withColumn("task", F.concat_ws(":", "component", "lo", "hi"))
        met = met.select("task", "lo", "hi", "blk", "v", "m", "vec").repartition("task").sortWithinPartitions("task")
        counts = met.mapInArrow(_block_links(t), "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))
        m = v.select(F.col("v").alias("b"), F.col("m").alias("mb"))
        loose = pairs.join(comp.join(dense, "component", "left_anti").select(F.col("v").alias("a")), "a")
        ends = loose.select("a", "b").unionByName(loose.select(F.col("b").alias("a"), F.col("a").alias("b")))
        few = ends.join(m, "b").groupBy(F.col("a").alias("v")).agg(F.sum("mb").alias("n"))
        self.counts = materialize(counts.unionByName(few), "nn-counts")
        self.comp = comp

    def _audit(self) -> float:
        """Least of the recalls of a bounded sample of vertices, with few and with many links."""
        for k, most in enumerate(AUDIT):
            linked, recall, whole = self._audit_of(most)
            if linked >= AUDIT_LINKED or whole or k == len(AUDIT) - 1:
                break
        return recall

    def _audit_of(self, most: int) -> tuple[int, float, bool]:
        """(sampled vertices that have links, recall, whether all vertices were in the sample)."""
        sample = self.vertices.orderBy(F.xxhash64(F.lit(self.seed), "v"), "v").limit(most)
        held: dict = {}
        total = 0
        for r in sample.select("v", "label", "vec").collect():
            held.setdefault((r["label"], len(r["vec"])), []).append((r["v"], bytes(r["vec"])))
            total += 1
        held = {k: (np.array([v for v, _ in g]), np.frombuffer(b"".join(x for _, x in g), np.float64).reshape(len(g), -1)) for k, g in held.items()}
        t = self.threshold

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unit = {k: x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] for k, (_, x) in held.items()}
            want = {k: np.zeros(len(v), np.int64) for k, (v, _) in held.items()}
            for b in batches:
                vs, ms = b.column(0).to_numpy(), b.column(3).to_numpy()
                ls, raw = b.column(1).to_pylist(), b.column(2).to_pylist()
                groups: dict = {}
                for i, (label, x) in enumerate(zip(ls, raw, strict=True)):
                    if (label, len(x)) in held:
                        groups.setdefault((label, len(x)), []).append(i)
                for key, at in groups.items():
                    for lo in range(0, len(at), BLOCK):
                        own = at[lo : lo + BLOCK]
                        y = _unit([raw[i] for i in own])
                        for q in range(0, len(want[key]), BLOCK):
                            c = unit[key][q : q + BLOCK] @ y.T >= t
                            c &= held[key][0][q : q + BLOCK, None] != vs[own][None, :]
                            want[key][q : q + BLOCK] += c @ ms[own]
            for key, n in want.items():
                some = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(held[key][0][some]), pa.array(n[some])], names=["v", "want"])

        true = self.vertices.select("v", "label", "vec", "m").mapInArrow(run, "v long, want long").groupBy("v").agg(F.sum("want").alias("want"))
        share = F.least(F.coalesce("n", F.lit(0)), "want") / F.col("want")
        rows = true.join(self.counts, "v", "left").groupBy(F.col("want") > LIST).agg(F.count("*").alias("k"), F.avg(share).alias("r")).collect()
        return sum(r["k"] for r in rows), min((r["r"] for r in rows), default=1.0), total < most

    def run(self) -> DataFrame:
        self._vertices()
        graph, joins = None, None
        for attempt in range(ATTEMPTS):
            met = self._start(attempt)
            start = met.where("sim is not null").withColumn("fresh", F.lit(True))
            edges = met.where("sim is null").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()
            joins = edges if joins is None else joins.unionByName(edges)
            if graph is not None:
                start = start.unionByName(graph.withColumn("fresh", F.lit(False)))
            graph = self._refine(materialize(self._top(start), "nn-graph"))
            self._links(graph, joins)
            self.recall = self._audit()
            if self.recall >= self.target:
                break
        else:
            raise RuntimeError(f"recall {self.recall} is below {self.target} after all vertices were compared")
        ids = self.packed.select("vec_id", "label", "vec").join(self.vertices, ["label", "vec"]).select("vec_id", "v", "m")
        found = ids.join(self.counts, "v", "left").join(self.comp, "v", "left")
        found = found.select(
            F.col("vec_id").alias("fid"),
            (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"),
            F.coalesce("component", "v").alias("component_id"),
        ).distinct()
        out = self.rows.select("vec_id").join(found, F.col("vec_id") == F.col("fid"), "left")
        cid = F.coalesce("component_id", "vec_id")
        return out.select(
            "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), cid.alias("component_id"), (F.col("vec_id") == cid).alias("kept")
        )


def near_vectors(rows: DataFrame, **options) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row; see NearVectors."""
    return NearVectors(rows, **options).run()
