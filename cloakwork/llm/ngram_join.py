"""Jaccard self-join of word n-gram sets by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes.  It is cut into
fragments, and everything is done by fragment:

* Who can have a partner.  Of the n-grams of a set at most the share 1 - t is missing in a
  partner.  In the first fragment (PROBE_MARGIN wider than that share) n-grams that
  only one distinct set holds are counted, each fragment of the count by itself, and
  summed for each set; a set with more than (1 - t) * n of them links with nothing.
  Nothing else is asked of sets without near copies.
* Candidates.  Two sets whose Jaccard similarity is at least t differ in at most
  (1 - t) / t * min(sizes) n-grams.  With one fragment more than that, some
  fragment holds the same n-grams in both, so documents meet only where a whole
  fragment is equal.  Fragment counts depend on a size class, and a document
  takes part in the schemes of its own class and of the class below, which are
  all that a partner can be in.  No n-gram is frequent or rare here: a passage
  that many documents share is mixed into fragments with their own n-grams.
* Empty fragments would bring unlike documents together.  Documents that have one
  are cut a second time under another order, and only there do empty fragments
  count, so no pair is lost.
* Counting.  Partial overlaps are counted fragment by fragment and summed for
  each pair; the decision uses exact integers.

Links are only needed between components that are not joined yet: each bucket
first compares its members with one leader (LEADER_ROUNDS times, with other leaders), and
only members of buckets that still hold several components are compared with each
other, after parity sketches have excluded pairs that differ too much (the number of
odd cells in which two sketches differ never exceeds the real difference): one of fixed
length, and for long sets one that is as long as they need.

Defined cases: a null or empty text, or one without words, has no n-grams and
links with nothing; rows whose id is null have no component; repeated rows give
repeated results; equal texts are one vertex; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from fractions import Fraction
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop_path, importable, materialize
from .components import connected_components
from .shingles import K1, K2, K3, U, mix, shingle_sets, slices

#: Longs of the parity sketch.
SKETCH = 8
#: Fragments in which overlaps are counted.
COUNT_FRAGMENTS = 4
#: Times that buckets compare their members with one leader before all are compared.
LEADER_ROUNDS = 2
#: Fragments shared by rows that may be broadcast: one long each, some 30 MB as a hash table.
MET_ROWS = 1_000_000
#: Vertices that may be broadcast to the texts: five longs each, some 50 MB as a hash table.
WANTED_ROWS = 500_000
#: N-grams from which a set has a wide sketch too.
WIDE_FROM = 512
#: Share of the order that is probed beyond the share by which two linked sets may differ.
PROBE_MARGIN = 0.1


class Schemes:
    """Size classes of ratio 1/t and the number of fragments of each scheme."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.bounds: list[int] = [1]

    def _grow(self, n: int) -> None:
        r = Fraction(self.den, self.num)
        while self.bounds[-1] <= n:
            self.bounds.append(ceil(r ** len(self.bounds)))

    def size_class(self, n: int) -> int:
        self._grow(n)
        return int(np.searchsorted(self.bounds, n, side="right")) - 1

    def fragments(self, j: int) -> int:
        while len(self.bounds) <= j + 1:
            self._grow(self.bounds[-1])
        return floor(Fraction((self.bounds[j + 1] - 1) * (self.den - self.num), self.num)) + 1


def _cut(h: np.ndarray, f: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and count of sorted hashes h in each of f equal ranges of the order."""
    frag = ((h >> U(32)) * U(f)) >> U(32)
    at = np.searchsorted(frag, np.arange(f + 1, dtype=np.uint64))
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h ^ (h * K3), out=total[1:])
    return total[at[1:]] - total[at[:-1]], np.diff(at)


def signatures(h: np.ndarray, schemes: Schemes) -> np.ndarray:
    """Hashes of the fragments by which a partner of the set h can be met."""
    n = len(h)
    k = schemes.size_class(n) if n else 0
    out = []
    for j in (k, k - 1):
        if n == 0 or j < 0 or (f := schemes.fragments(j)) < 2:
            continue
        base = (U(j) << U(32)) + np.arange(f, dtype=np.uint64)
        total, count = _cut(h, f)
        sig = mix(total + count.astype(np.uint64) * K1 + base * K2)
        full = count > 0
        out.append(sig[full])
        if not full.all():
            total, count = _cut(np.sort(mix(h ^ K1)), f)
            out.append(mix(total + count.astype(np.uint64) * K2 + (base + (U(1) << U(60))) * K3))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _digests(h: np.ndarray) -> tuple[int, int]:
    a = mix(h ^ K2).sum(dtype=np.uint64) + U(len(h))
    b = mix(h * K3 + K1).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _sketch(h: np.ndarray) -> np.ndarray:
    bits = np.bincount((h & U(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _wide(h: np.ndarray) -> np.ndarray:
    """A parity sketch of two cells or more for each n-gram, so that it tells long sets apart."""
    if len(h) <= WIDE_FROM:
        return np.zeros(0, np.uint64)
    longs = 1 << (-(-len(h) // 32) - 1).bit_length()
    bits = np.bincount((h & U(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    """A column of lists of longs."""
    off = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in parts], out=off[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64)))


def probe_limit(num: int, den: int) -> np.uint64:
    """End of the range of the order that is probed: PROBE_MARGIN more of it than a set may differ by."""
    share = min(1.0, (den - num) / den + PROBE_MARGIN)
    return U(min(int(share * 2.0**64), 2**64 - 1))


def _describe(k: int, num: int, den: int):
    limit = probe_limit(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                texts = b.column(2).to_pylist()
                for lo, hi in slices(texts):
                    sets = shingle_sets(texts[lo:hi], k)
                    dig = [_digests(h) for h in sets]
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column(0).slice(lo, hi - lo),
                            b.column(1).slice(lo, hi - lo),
                            pa.array([d[0] for d in dig], pa.int64()),
                            pa.array([d[1] for d in dig], pa.int64()),
                            pa.array([len(h) for h in sets], pa.int64()),
                            _lists([h[: np.searchsorted(h, limit)] for h in sets]),
                        ],
                        names=["doc_id", "text_hash", "d1", "d2", "n", "probe"],
                    )

    return run


def _detail(k: int, num: int, den: int):
    """(v, d1, d2, text) -> a row for each fragment in which overlaps are counted.

    The row of fragment 0 also has signatures and sketch.  Rows whose text is not the one
    of the vertex (another text under the same id) give nothing.
    """
    names = ["v", "frag", "toks", "sigs", "wide", *[f"p{i}" for i in range(SKETCH)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schemes = Schemes(num, den)
        none = np.zeros(0, np.uint64)
        blank = np.zeros(SKETCH, np.int64)
        cuts = np.arange(COUNT_FRAGMENTS + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for b in batches:
                v, d1, d2, texts = (b.column(i).to_pylist() for i in range(4))
                for lo, hi in slices(texts):
                    at, frag, toks, sigs, wide, sketch = [], [], [], [], [], []
                    for i, h in enumerate(shingle_sets(texts[lo:hi], k), lo):
                        if _digests(h) != (d1[i], d2[i]):
                            continue
                        ends = np.searchsorted((h >> U(40)) * U(COUNT_FRAGMENTS) >> U(24), cuts)
                        for f in range(COUNT_FRAGMENTS):
                            at.append(v[i])
                            frag.append(f)
                            toks.append(h[ends[f] : ends[f + 1]])
                            sigs.append(none if f else signatures(h, schemes))
                            wide.append(none if f else _wide(h))
                            sketch.append(blank if f else _sketch(h))
                    sk = np.stack(sketch) if sketch else np.zeros((0, SKETCH), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(at, pa.int64()),
                            pa.array(frag, pa.int32()),
                            _lists(toks),
                            _lists(sigs),
                            _lists(wide),
                            *[pa.array(np.ascontiguousarray(sk[:, i])) for i in range(SKETCH)],
                        ],
                        names=names,
                    )

    return run


def _far_apart(a: str, b: str, num: int, den: int):
    """SQL condition that a pair can still reach the threshold, by sizes and sketches."""
    odd = " + ".join(f"bit_count({a}.p{i} ^ {b}.p{i})" for i in range(SKETCH))
    return (
        f"least({a}.n, {b}.n) * {den} >= greatest({a}.n, {b}.n) * {num}"
        f" and ({odd}) * {num} <= {den - num} * least({a}.n, {b}.n)"
    )


def _text_hash(text):
    return F.xxhash64(text.cast("string"))


class NgramJoin:
    """One self-join; result() is one row for each document, links() the verified pairs."""

    def __init__(
        self,
        docs: DataFrame,
        id_col: str = "doc_id",
        text_col: str = "text",
        words: int = 3,
        num: int = 90,
        den: int = 100,
    ):
        self.spark = docs.sparkSession
        importable(self.spark)
        self.k, self.num, self.den = words, num, den
        self.docs = docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            _text_hash(F.col(text_col)).alias("text_hash"),
            F.col(text_col).cast("string").alias("text"),
        )
        self.edges: DataFrame | None = None

    def _near(self) -> str:
        """SQL condition that wide sketches wa, wb of two long sets do not tell them apart."""
        # a sketch of twice the length is folded; lengths that differ more are left to the exact count
        half = "zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (x, y) -> x ^ y)"
        fold = "if(size({0}) > size({1}), " + half + ", {0})"
        odd = f"aggregate(zip_with({fold.format('wa', 'wb')}, {fold.format('wb', 'wa')}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
        return (
            f"least(na, nb) <= {WIDE_FROM} or greatest(size(wa), size(wb)) > 2 * least(size(wa), size(wb))"
            f" or {odd} * {self.num} <= {self.den - self.num} * least(na, nb)"
        )

    def _verified(self, pairs: DataFrame, segs: DataFrame) -> DataFrame:
        """pairs (a, b, na, nb) of which the summed partial overlaps reach the threshold."""
        left = segs.select(F.col("v").alias("a"), "frag", F.col("toks").alias("ta"))
        right = segs.select(F.col("v").alias("b"), "frag", F.col("toks").alias("tb"))
        part = pairs.join(left, "a").join(right, ["b", "frag"])
        both = part.groupBy("a", "b", "na", "nb").agg(F.sum(F.expr("size(array_intersect(ta, tb))")).alias("both"))
        return both.where(F.expr(f"both * {self.den} >= (na + nb - both) * {self.num}")).select("a", "b")

    def _vertices(self, described: DataFrame) -> DataFrame:
        """(v, d1, d2, n, rep): one vertex for each distinct set; rep is its least (doc_id, text_hash)."""
        named = described.where("doc_id is not null and n > 0")
        classes = named.groupBy("d1", "d2").agg(
            F.first("n").alias("n"), F.min(F.struct("doc_id", "text_hash")).alias("rep")
        )
        return materialize(classes.withColumn("v", F.monotonically_increasing_id()), "ngram-classes")

    def _alive(self, described: DataFrame, classes: DataFrame) -> DataFrame:
        """Vertices that may have a partner: few enough of the n-grams probed are theirs alone."""
        grams = described.where("doc_id is not null and n > 0").select("d1", F.explode("probe").alias("gram"))
        own = grams.groupBy("gram").agg(F.min("d1").alias("d1"), F.max("d1").alias("other")).where("d1 = other")
        own = own.groupBy("d1").agg(F.count("*").alias("own"))
        few = F.expr(f"coalesce(own, 0L) * {self.den} <= n * {self.den - self.num}")
        return materialize(classes.join(own, "d1", "left").where(few).drop("own"), "ngram-alive")

    def _open(self, members: DataFrame, comp: DataFrame | None) -> DataFrame:
        """(sig, v, c) of buckets that hold more than one component c."""
        if comp is None:
            return members.withColumn("c", F.col("v"))
        m = members.join(comp, "v", "left").select("sig", "v", F.coalesce("component", "v").alias("c"))
        open_ = m.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("sig")
        return materialize(m.join(open_, "sig", "left_semi"), "ngram-open")

    def run(self) -> DataFrame:
        """(doc_id, text_hash, n_shingles, component_id, best): best is the least (doc_id, text_hash) of the component."""
        described = materialize(
            self.docs.mapInArrow(
                _describe(self.k, self.num, self.den),
                "doc_id long, text_hash long, d1 long, d2 long, n long, probe array<long>",
            ),
            "ngram-docs",
        )
        classes = self._vertices(described)
        alive = self._alive(described, classes)
        slim = described.drop("probe")

        wanted = alive.select(
            "v", "d1", "d2", F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_hash").alias("text_hash")
        )
        texts = self.docs.join(broadcast_if_small(wanted, limit=WANTED_ROWS), ["doc_id", "text_hash"])
        p = ", ".join(f"p{i} long" for i in range(SKETCH))
        detail = texts.select("v", "d1", "d2", "text").mapInArrow(
            _detail(self.k, self.num, self.den), f"v long, frag int, toks array<long>, sigs array<long>, wide array<long>, {p}"
        )
        # a row that is repeated gives the same fragments again
        detail = materialize(detail.dropDuplicates(["v", "frag"]), "ngram-detail")
        segs = detail.select("v", "frag", "toks")
        wide = detail.where("frag = 0").select("v", "wide")
        sketches = detail.where("frag = 0").select("v", *[f"p{i}" for i in range(SKETCH)])
        rows = detail.where("frag = 0").select("v", F.explode("sigs").alias("sig"))
        met = rows.groupBy("sig").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo <> hi").select("sig")
        met = materialize(met, "ngram-met")
        members = materialize(rows.join(broadcast_if_small(met, limit=MET_ROWS), "sig", "left_semi"), "ngram-members")
        more = members.select("v").distinct().join(alive.select("v", "n"), "v").join(sketches, "v").join(wide, "v")
        more = materialize(more, "ngram-info")
        info = more.drop("wide")
        left = more.select([F.col(c).alias({"v": "a", "wide": "wa"}.get(c, c)) for c in more.columns]).alias("l")
        right = more.select([F.col(c).alias({"v": "b", "wide": "wb"}.get(c, c)) for c in more.columns]).alias("r")

        comp: DataFrame | None = None
        edges: DataFrame | None = None
        for turn in range(1, LEADER_ROUNDS + 2):
            m = self._open(members, comp)
            if turn <= LEADER_ROUNDS:
                # one order for all buckets at first, then another in each bucket
                h = F.xxhash64("v") if turn == 1 else F.xxhash64("v", "sig", F.lit(turn))
                lead = m.groupBy("sig").agg(F.min(F.struct(h.alias("h"), "v", "c")).alias("x"))
                # written, so that the join below can split a bucket
                lead = materialize(lead.select("sig", F.col("x.v").alias("a"), F.col("x.c").alias("ca")), "ngram-lead")
                pairs = m.join(lead, "sig").where("v <> a and c <> ca").select("a", F.col("v").alias("b")).distinct()
                ok = F.expr(_far_apart("l", "r", self.num, self.den))
                pairs = pairs.join(left, "a").join(right, "b").where(ok)
                pairs = pairs.select("a", "b", F.col("l.n").alias("na"), F.col("r.n").alias("nb"), "wa", "wb")
            else:
                full = m.join(info, "v")
                x, y = full.alias("x"), full.alias("y")
                ok = F.expr("x.sig = y.sig and x.v < y.v and x.c <> y.c and " + _far_apart("x", "y", self.num, self.den))
                pairs = x.join(y, ok).select(
                    F.col("x.v").alias("a"), F.col("y.v").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")
                )
                pairs = pairs.distinct().join(left.select("a", "wa"), "a").join(right.select("b", "wb"), "b")
            close = pairs.where(self._near()).select("a", "b", "na", "nb")
            found = materialize(self._verified(close, segs), "ngram-links")
            edges = found if edges is None else edges.unionByName(found)
            if comp is None or found.limit(1).count():
                # components so far are stars, which are soon joined by a few more links
                stars = [] if comp is None else [comp.select(F.col("v").alias("a"), F.col("component").alias("b"))]
                comp = materialize(connected_components(functools.reduce(DataFrame.unionByName, stars, found)), "ngram-components")
        self.edges = edges
        # vertices are numbered anew in each run; the component goes by its least document
        final = classes.join(comp, "v", "left").select("d1", "d2", "rep", F.coalesce("component", "v").alias("c"))
        best = materialize(final.groupBy("c").agg(F.min("rep").alias("best")), "ngram-best")
        final = materialize(final.join(best, "c").select("d1", "d2", "best"), "ngram-final")
        out = slim.join(broadcast_if_small(final), ["d1", "d2"], "left")
        named = F.col("doc_id").isNotNull()
        cid = F.when(named & (F.col("n") == 0), F.col("doc_id")).when(named, F.col("best.doc_id"))
        return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), cid.alias("component_id"), "best")


def ngram_components(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs; see NgramJoin."""
    return NgramJoin(docs, **options).run().select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without the rows of whose component another row is less by (doc_id, text); columns unchanged.

    Rows with a null doc_id are kept, since they have no place in the order; so are rows
    without words.  Of rows with one id each text is judged by itself; rows that agree in id
    and text are one document and stay or go together.
    """
    found = NgramJoin(docs, words=words, num=num, den=den).run()
    drop = found.where("doc_id is not null and n_shingles > 0 and not (best <=> struct(doc_id, text_hash))")
    drop = drop.select(F.col("doc_id").alias("_drop_id"), F.col("text_hash").alias("_drop_hash")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    on = (F.col("_row.doc_id").cast("long") == F.col("_drop_id")) & (_text_hash(F.col("_row.text")) == F.col("_drop_hash"))
    return rows.join(drop, on, "left_anti").select("_row.*")
