"""Packing documents into sequences as a cutting-stock problem.

A document's ids are cut into pieces of `capacity` and one rest.  Rests are counted
in a histogram of length classes, which is all that reaches the driver: its size is
bounded by the capacity.  A linear program over patterns (how many rests of each
class share a sequence) is solved by column generation: the simplex multipliers price
the classes, and a knapsack by dynamic programming finds the pattern worth most, until
none is worth more than a sequence.  Pattern counts are rounded down, the few rests
that remain are placed best fit first, and documents, ranked in their class, take the
slots of the patterns in order.

Defined cases: a null or empty text is the end id alone; a document that fills
sequences exactly has no rest; ties in rank go by id; repeated rows are packed each;
an empty table gives no pieces; other columns are ignored, whatever their names; a text of
any length is encoded whole.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import importable, materialize
from .shingles import slices

CAPACITY = 4096
END_ID = 2
#: Tokens by which the lengths of a class can differ.
WIDTH = 8
#: Words whose ids a worker remembers.
CACHE = 900_000
#: Pieces ranked by one task at most, about.
RANK_ROWS = 500_000


def _byte_letters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if it prints, else one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


_AS_LETTERS = str.maketrans(dict(enumerate(_byte_letters())))
#: Words that normal form, case and splitting leave as they are: lower-case Latin letters.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff\u0101-\u024f]+")
#: How a lower-case ASCII word is split; fixed by the tokenizer's file (SPLIT).
_ASCII_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: The properties of a tokenizer's file on which encoding by words rests; fixed values.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NORMAL = [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)]


def _by_words(spec: dict) -> bool:
    """Whether a tokenizer's file splits at white space and lower-cases, so that words can be encoded alone."""
    normal = (spec.get("normalizer") or {}).get("normalizers") or []
    split, level = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}])[:2]
    model = spec.get("model") or {}
    return (
        [(n["type"], (n.get("pattern") or {}).get("Regex")) for n in normal] == NORMAL
        and (split.get("pattern") or {}).get("Regex") == SPLIT
        and (split.get("behavior"), split.get("invert")) == ("Removed", True)
        and (level.get("type"), level.get("add_prefix_space"), level.get("use_regex")) == ("ByteLevel", False, False)
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "fuse_unk"))
        and all(t["content"].startswith("<|") and not t["normalized"] for t in spec.get("added_tokens", []))
    )


class _Words(dict):
    """Ids of words, each learned when it is first asked for."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: bytes) -> bytes:
        got = self[word] = self.learn(word)
        return got


class WordTokenizer:
    """Ids of texts as little-endian 32-bit numbers; words between ASCII white space are encoded once and remembered.

    Where the tokenizer's file says that white space is dropped and parts words (_by_words),
    the ids of a text are those of its words in a row.  Lower-case Latin words and ASCII
    words, split as the file says, go straight to the vocabulary's model; all others
    through the whole tokenizer.  Any other file is used for whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.by_words = _by_words(json.load(f))
        self.inner = Tokenizer.from_file(path)
        self.model = self.inner.model
        self.pieces = _Words(self._piece)
        self.known = _Words(self._learn)

    def _whole(self, text: str) -> bytes:
        return np.array(self.inner.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_AS_LETTERS))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, word: bytes) -> bytes:
        if word.isalpha():
            return self._piece(word.decode()) if word.islower() else self._whole(word.decode())
        core = word.rstrip(b".,;:!?")
        if core and len(core) < len(word) and core[-1:].isalnum() and b"<|" not in word:
            return self.known[core] + self.known[word[len(core) :]]
        text = word.decode()
        if b"<|" in word:
            return self._whole(text)
        if word.isascii() and text == text.lower():
            return b"".join(map(self.pieces.__getitem__, _ASCII_PIECES.findall(text)))
        if _PLAIN.fullmatch(text) and text == text.lower():
            return self._piece(text)
        return self._whole(text)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_words:
            return self._whole(text)
        if len(self.known) > CACHE or len(self.pieces) > CACHE:
            self.known.clear()
            self.pieces.clear()
        b = text.encode("utf-8", "replace")
        # lower-cased first unless marks that compose, or a special token, may be in it
        if b"\xcc" not in b and b"\xcd" not in b and b"<|" not in b:
            b = b.lower()
        return b"".join(map(self.known.__getitem__, b.split()))


@functools.lru_cache(maxsize=1)
def tokenizer(path: str) -> WordTokenizer:
    """One for each worker: what it has learned serves all its tasks."""
    return WordTokenizer(path)


def cut_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = True,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): the pieces of each document."""
    importable(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + (["ids"] if with_ids else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        end, step = struct.pack("<I", end_id), 4 * capacity
        for b in batches:
            doc_ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in slices(texts):
                rows: list[list] = [[] for _ in names]
                for i in range(lo, hi):
                    ids = tok.ids(texts[i]) + end
                    for at in range(0, len(ids), step):
                        piece = ids[at : at + step]
                        vals = [doc_ids[i], at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4]
                        for r, v in zip(rows, [*vals, np.frombuffer(piece, "<i4")], strict=False):
                            r.append(v)
                cols = [pa.array(r, pa.int64()) for r in rows[:5]]
                if with_ids:
                    cols.append(pa.array(rows[5], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def best_pattern(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of sizes within capacity."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1, np.int64)
    order = np.argsort(sizes, kind="stable")
    s, v = sizes[order], value[order]
    upto = np.searchsorted(s, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        k = upto[c]
        if k:
            cand = best[c - s[:k]] + v[:k]
            i = int(cand.argmax())
            if cand[i] > best[c] + 1e-12:
                best[c], took[c] = cand[i], order[i]
    out = np.zeros(len(sizes), np.int64)
    c = capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            out[took[c]] += 1
            c -= int(sizes[took[c]])
    return float(best[capacity]), out


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 5e-4, max_rounds: int = 4000):
    """Column generation: [(pattern, count)] with fractional counts, covering demand."""
    m = len(sizes)
    cols = np.zeros((m, m))
    cols[np.arange(m), np.arange(m)] = capacity // sizes
    inv = np.diag(1.0 / np.diag(cols))
    x = inv @ demand
    for _ in range(max_rounds):
        price = inv.sum(axis=0)
        worth, a = best_pattern(sizes, price, capacity)
        if worth <= 1 + gap:
            break
        u = inv @ a
        ok = u > 1e-9
        ratio = np.full(m, np.inf)
        ratio[ok] = np.maximum(x[ok], 0) / u[ok]
        r = int(ratio.argmin())
        step = ratio[r]
        x -= step * u
        x[r] = step
        inv[r] /= u[r]
        rest = u.copy()
        rest[r] = 0
        inv -= np.outer(rest, inv[r])
        cols[:, r] = a
    return [(cols[:, j].astype(np.int64), float(x[j])) for j in range(m) if x[j] > 1e-9]


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """[(sizes in slot order, how many sequences)] that hold the histogram exactly."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[s] for s in sizes], np.int64)
    plan: Counter[tuple[int, ...]] = Counter()
    for a, x in sorted(solve_patterns(sizes, left.astype(float), capacity), key=lambda p: -p[1]):
        n = int(np.floor(x + 1e-6))
        used = a > 0
        if used.any():
            n = min(n, int((left[used] // a[used]).min()))
            if n > 0:
                left -= n * a
                plan[tuple(int(s) for s, k in zip(sizes[::-1], a[::-1], strict=True) for _ in range(k))] += n
    rooms: dict[int, list[list[int]]] = {}
    for s, n in zip(sizes[::-1], left[::-1], strict=True):
        for _ in range(int(n)):
            fit = min((r for r in rooms if r >= s and rooms[r]), default=None)
            bin_ = rooms[fit].pop() if fit is not None else []
            room = (fit if fit is not None else capacity) - int(s)
            bin_.append(int(s))
            rooms.setdefault(room, []).append(bin_)
    for bins in rooms.values():
        plan.update(tuple(b) for b in bins)
    return sorted(plan.items())


def assign(pieces: DataFrame, capacity: int = CAPACITY, width: int = WIDTH) -> DataFrame:
    """pieces plus sequence_id and offset; pieces must be a written table."""
    spark = pieces.sparkSession
    carried = pieces.columns
    # every salt holds a bounded share of a class, however common the class is
    salts = max(16, pieces.count() // RANK_ROWS * 2)
    cls = F.when(F.col("length") == capacity, F.lit(0)).otherwise(F.ceil(F.col("length") / width)).cast("long")
    p = pieces.withColumn("cls", cls).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    counts = materialize(p.groupBy("cls", "salt").agg(F.count("*").alias("n")), "pack-counts")
    before = F.sum("n").over(W.partitionBy("cls").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("cls", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = p.join(offsets, ["cls", "salt"]).withColumn(
        "rank",
        F.col("before") + F.row_number().over(W.partitionBy("cls", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1,
    )
    hist = {r["cls"]: r["n"] for r in counts.where("cls > 0").groupBy("cls").agg(F.sum("n").alias("n")).collect()}
    rows, base, starts = [], 0, Counter()
    for slots, n in plan_patterns(hist, capacity // width):
        for k, s in enumerate(slots):
            rows.append((s, starts[s], starts[s] + n, base, k))
            starts[s] += n
        base += n
    # at most a slot for each class and pattern: bounded by the capacity, not by the input
    plan = spark.createDataFrame(rows, "pcls long, lo long, hi long, base long, slot long")
    rest = ranked.where("cls > 0").join(
        F.broadcast(plan), (F.col("cls") == F.col("pcls")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    )
    rest = rest.select(*carried, (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), "slot")
    prior = F.sum("length").over(W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1))
    rest = rest.select(*carried, "sequence_id", F.coalesce(prior, F.lit(0)).alias("offset"))
    full = ranked.where("cls = 0").select(
        *carried, (F.lit(base) + F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return rest.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_path: str, with_ids: bool = True, **options) -> DataFrame:
    """Every piece with its sequence_id and offset; with_ids adds the ids themselves."""
    pieces = materialize(cut_pieces(docs, tokenizer_path, with_ids=with_ids, **options), "pack-pieces")
    return assign(pieces, options.get("capacity", CAPACITY))
