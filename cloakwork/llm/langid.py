"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads lower-cased UTF-8 in windows of WINDOW bytes, forwards and
backwards, and labels every byte position; a document's probabilities are the mean
over all its positions.  It is trained in numpy by backpropagation through time on a
bounded sample: at most `per_lang` documents of each language, those with the least
hash of their id, and at most `windows_per_doc` windows spread over each of them.
Only whole texts are labelled, and only the text is an input.

Defined cases: a null text, or one without a letter, is `und` with score 0; so is
every text if there is nothing to learn from; ties go to the language that sorts
first; repeated rows give repeated results; an empty table gives an empty one; texts of any
length are read whole; other columns pass unchanged, whatever their names, except that
predict() replaces columns named like a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, importable, materialize
from .shingles import slices

WINDOW = 64
BLOCK = 2048
#: A letter; number signs such as a half or a circled one are none.
LETTER = regex.compile(r"\p{L}")


def squash(x: np.ndarray, s: np.ndarray | None = None, den: np.ndarray | None = None) -> np.ndarray:
    """In place: x (27 + x^2) / (27 + 9 x^2) on [-3, 3], a sigmoid that costs no exponential.

    s and den are work arrays; s holds x^2 + 27 afterwards.
    """
    s = np.empty_like(x) if s is None else s
    den = np.empty_like(x) if den is None else den
    np.clip(x, -3, 3, out=x)
    np.multiply(x, x, out=s)
    np.multiply(s, 9, out=den)
    den += 27
    s += 27
    x *= s
    x /= den
    return x


def slope(s27: np.ndarray) -> np.ndarray:
    """The derivative of squash where x^2 + 27 is s27."""
    return ((36 - s27) / (3 * s27 - 72)) ** 2


@dataclass
class Direction:
    x: np.ndarray  # [256, 3H]: what a byte adds to update, reset and candidate
    u: np.ndarray  # [H, 3H]
    b: np.ndarray  # [H]: inside the reset product


class ByteGRU:
    """A bidirectional GRU over bytes with a softmax at each position."""

    def __init__(self, langs: list[str], hidden: int = 8, seed: int = 7):
        self.langs, self.h = langs, hidden
        rng = np.random.default_rng(seed)
        s = 1 / np.sqrt(hidden)

        def direction() -> Direction:
            return Direction(
                rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32),
                rng.uniform(-s, s, (hidden, 3 * hidden)).astype(np.float32),
                np.zeros(hidden, np.float32),
            )

        self.dirs = [direction(), direction()]
        self.v = rng.uniform(-s, s, (2 * hidden, len(langs))).astype(np.float32)
        self.c = np.zeros(len(langs), np.float32)

    def params(self) -> list[np.ndarray]:
        return [p for d in self.dirs for p in (d.x, d.u, d.b)] + [self.v, self.c]

    def _steps(self, d: Direction, x: np.ndarray, order, keep: bool):
        h_size, n = self.h, x.shape[0]
        h = np.zeros((n, h_size), np.float32)
        states = np.empty((x.shape[1], n, h_size), np.float32)
        kept = {}
        for t in order:
            a = d.x[x[:, t]]
            g = h @ d.u
            zr = a[:, : 2 * h_size] + g[:, : 2 * h_size]
            zr *= 0.5
            sg = np.empty_like(zr)
            squash(zr, sg)
            zr *= 0.5
            zr += 0.5
            z, r = zr[:, :h_size], zr[:, h_size:]
            q = g[:, 2 * h_size :] + d.b
            m = a[:, 2 * h_size :] + r * q
            sm = np.empty_like(m)
            squash(m, sm)
            new = m + z * (h - m)
            if keep:
                gate = slope(sg) / 4
                kept[t] = (h, z, r, q, m, gate[:, :h_size], gate[:, h_size:], slope(sm))
            h = states[t] = new
        return states, kept

    def _read(self, d: Direction, xt: np.ndarray, order, out: np.ndarray) -> None:
        """States of one direction into out [T, B, H]; all work arrays are contiguous."""
        n, k = xt.shape[1], self.h
        # a gate is 0.5 + 0.5 * squash(v / 2): the inner halves go into the weights
        xz, xr, xm = (np.ascontiguousarray(d.x[:, i * k : (i + 1) * k]) for i in range(3))
        uz, ur, um = (np.ascontiguousarray(d.u[:, i * k : (i + 1) * k]) for i in range(3))
        xz, xr, uz, ur = xz / 2, xr / 2, uz / 2, ur / 2
        z, r, m, g, s, den = (np.empty((n, k), np.float32) for _ in range(6))
        h = np.zeros((n, k), np.float32)
        for t in order:
            at = xt[t]
            np.take(xr, at, axis=0, out=r, mode="clip")
            np.matmul(h, ur, out=g)
            r += g
            squash(r, s, den)
            r += 1
            r *= 0.5
            np.matmul(h, um, out=g)
            g += d.b
            r *= g
            np.take(xm, at, axis=0, out=m, mode="clip")
            m += r
            squash(m, s, den)
            np.take(xz, at, axis=0, out=z, mode="clip")
            np.matmul(h, uz, out=g)
            z += g
            squash(z, s, den)
            z += 1
            z *= 0.5
            h = np.subtract(h, m, out=out[t])
            h *= z
            h += m

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities [L, T, B] at every position of windows x [B, T]."""
        t, n = x.shape[1], len(x)
        xt = np.ascontiguousarray(x.T).astype(np.intp)
        f = np.empty((t, n, self.h), np.float32)
        b = np.empty((t, n, self.h), np.float32)
        self._read(self.dirs[0], xt, range(t), f)
        self._read(self.dirs[1], xt, range(t - 1, -1, -1), b)
        o = self.v[: self.h].T @ f.reshape(-1, self.h).T
        o += self.v[self.h :].T @ b.reshape(-1, self.h).T
        o += self.c[:, None]
        o -= o.max(axis=0)
        np.exp(o, out=o)
        o /= o.sum(axis=0)
        return o.reshape(-1, t, n)

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray):
        """Mean cross entropy over the masked positions and its gradients (BPTT)."""
        steps = x.shape[1]
        orders = [range(steps), range(steps - 1, -1, -1)]
        runs = [self._steps(d, x, o, True) for d, o in zip(self.dirs, orders, strict=True)]
        o = sum(s @ self.v[i * self.h : (i + 1) * self.h] for i, (s, _) in enumerate(runs)) + self.c
        o -= o.max(axis=2, keepdims=True)
        p = np.exp(o)
        p /= p.sum(axis=2, keepdims=True)
        w = mask.T.astype(np.float32) / max(mask.sum(), 1)
        rows = np.arange(len(y))
        loss = float(-(np.log(p[:, rows, y] + 1e-9) * w).sum())
        do = p
        do[:, rows, y] -= 1
        do *= w[:, :, None]
        grads = []
        gv = np.concatenate([np.tensordot(s, do, ([0, 1], [0, 1])) for s, _ in runs])
        for i, (d, order, (_, kept)) in enumerate(zip(self.dirs, orders, runs, strict=True)):
            dh_out = do @ self.v[i * self.h : (i + 1) * self.h].T
            gx, gu, gb = np.zeros_like(d.x), np.zeros_like(d.u), np.zeros_like(d.b)
            dh = np.zeros((len(x), self.h), np.float32)
            for t in reversed(order):
                h, z, r, q, m, zs, rs, ms = kept[t]
                dh = dh + dh_out[t]
                dm = dh * (1 - z) * ms
                dz = dh * (h - m) * zs
                dr = dm * q * rs
                dq = dm * r
                gb += dq.sum(0)
                dg = np.concatenate([dz, dr, dq], axis=1)
                gu += h.T @ dg
                da = np.concatenate([dz, dr, dm], axis=1)
                np.add.at(gx, x[:, t], da)
                dh = dh * z + dg @ d.u.T
            grads += [gx, gu, gb]
        return loss, [*grads, gv, do.sum((0, 1))]

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 250, batch: int = 256, rate: float = 0.02, seed: int = 11) -> float:
        rng = np.random.default_rng(seed)
        ps = self.params()
        m1, m2 = [np.zeros_like(p) for p in ps], [np.zeros_like(p) for p in ps]
        loss = 0.0
        for k in range(1, steps + 1):
            at = rng.integers(0, len(x), batch)
            now, grads = self.gradients(x[at], y[at], x[at] > 0)
            loss = now if k == 1 else 0.9 * loss + 0.1 * now
            lr = rate * min(1, k / 20) * (1 - 0.9 * k / steps)
            for p, g, a, b in zip(ps, grads, m1, m2, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= lr * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-7)
        return loss


def windows_of(data: bytes) -> np.ndarray:
    """All windows [n, WINDOW] of data; the last is filled with zero bytes."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def train(
    docs: DataFrame,
    usable: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_lang: int = 200,
    windows_per_doc: int = 40,
    steps: int = 250,
) -> ByteGRU | None:
    """Learn from at most per_lang * windows_per_doc windows of each language."""
    importable(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    if usable is not None:
        rows = rows.where(usable)
    # from here on no column of the caller's is there
    rows = rows.select(
        F.col(lang_col).cast("string").alias("lang"),
        F.col(id_col).alias("id"),
        F.col(text_col).cast("string").alias("text"),
        F.xxhash64(id_col).alias("h"),
    )
    rank = W.partitionBy("lang").orderBy("h", "id")
    # the rank limit is applied in each task before the shuffle
    ids = rows.select("lang", "id", "h").withColumn("r", F.row_number().over(rank)).where(F.col("r") <= per_lang)
    # written: at most per_lang rows of each language
    ids = materialize(ids.select("id").distinct(), "lang-chosen")
    chosen = rows.join(broadcast_if_small(ids), "id", "left_semi").select("lang", "text", "h")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for lang, text, h in zip(pdf["lang"], pdf["text"], pdf["h"], strict=True):
                if not LETTER.search(text):
                    continue
                w = windows_of(_bytes(text))
                at = np.unique(np.linspace(0, len(w) - 1, min(len(w), windows_per_doc)).astype(int))
                out += [(lang, h, w[i].tobytes()) for i in at]
            yield pd.DataFrame(out, columns=["lang", "h", "w"])

    got = chosen.mapInPandas(cut, "lang string, h long, w binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["lang", "h", "w"], kind="stable")
    langs = sorted(got["lang"].unique())
    x = np.frombuffer(b"".join(map(bytes, got["w"])), np.uint8).reshape(-1, WINDOW)
    y = got["lang"].map({c: i for i, c in enumerate(langs)}).to_numpy()
    # as many windows of each language
    most = max(np.bincount(y))
    at = np.concatenate([np.resize(np.flatnonzero(y == i), most) for i in range(len(langs))])
    net = ByteGRU(langs)
    net.fit(x[at], y[at], steps=steps)
    return net


def label_texts(net: ByteGRU, texts: list[str | None], with_runs: bool = False):
    """(language, score, runs) of each text; runs are [(language, bytes)] over all positions."""
    out: list = [("und", 0.0, [])] * len(texts)
    live = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    if not live:
        return out
    cut = [windows_of(_bytes(texts[i])) for i in live]
    x = np.concatenate(cut)
    totals = np.zeros((len(x), len(net.langs)))
    best = np.empty(x.shape, np.int16) if with_runs else None
    for lo in range(0, len(x), BLOCK):
        w = x[lo : lo + BLOCK]
        p = net.positions(w)
        mask = (w > 0).T
        if with_runs:
            best[lo : lo + BLOCK] = p.argmax(0).T
        p *= mask
        totals[lo : lo + BLOCK] = p.sum(1).T
    starts = np.cumsum([0, *[len(c) for c in cut]])
    sums = np.add.reduceat(totals, starts[:-1], axis=0)
    for k, i in enumerate(live):
        p = sums[k] / max(sums[k].sum(), 1e-12)
        j = int(p.argmax())
        runs = []
        if with_runs:
            flat = best[starts[k] : starts[k + 1]].reshape(-1)[: len(_bytes(texts[i]))]
            edge = np.flatnonzero(np.diff(flat)) + 1
            bounds = np.concatenate([[0], edge, [len(flat)]])
            runs = [(net.langs[flat[a]], int(b - a)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        out[i] = (net.langs[j], float(min(1.0, p[j])), runs)
    return out


def predict(docs: DataFrame, net: ByteGRU | None, text_col: str = "text", with_runs: bool = False) -> DataFrame:
    """docs with lang_pred, score and, if asked for, runs: the labels of all positions."""
    importable(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "runs")]
    run_type = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("bytes", T.LongType())]))
    if net is None:
        out = docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
        return out.withColumn("runs", F.lit(None).cast(run_type)) if with_runs else out
    extra = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    extra += [T.StructField("runs", run_type)] if with_runs else []
    schema = T.StructType([docs.schema[c] for c in keep] + extra)
    at = keep.index(text_col)
    run_arrow = pa.list_(pa.struct([("lang", pa.string()), ("bytes", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            for lo, hi in slices(texts):
                got = label_texts(net, texts[lo:hi], with_runs)
                cols = [c.slice(lo, hi - lo) for c in b.columns]
                cols += [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
                names = [*keep, "lang_pred", "score"]
                if with_runs:
                    cols.append(pa.array([[{"lang": a, "bytes": n} for a, n in g[2]] for g in got], run_arrow))
                    names.append("runs")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(*keep).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is set aside for testing: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def reject_unknown(docs: DataFrame, lift: float = 1 / 15) -> DataFrame:
    """docs without those of no known language; columns and their values unchanged.

    A document stays if its score reaches chance, one over the number of languages, plus
    lift of what is left to 1.  Without usable labels there is no model and nothing is known
    against a document: all stay.
    """
    net = train(docs, ~held_out())
    if net is None:
        return docs
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    scored = predict(docs.select(row.alias("row"), F.col("text").alias("text")), net)
    chance = 1 / len(net.langs)
    keep = (F.col("lang_pred") != "und") & (F.col("score") >= chance + lift * (1 - chance))
    return scored.where(keep).select("row.*")
