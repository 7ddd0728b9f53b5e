"""Name packs: a Bloom filter file for each script and tier, and a manifest.

A pack starts with a magic number, a version, the number of hash functions and the number
of bits, little-endian; the bits follow.  Places come from two FNV-1a hashes over the UTF-16
units of a name, in 32-bit arithmetic.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.namedb import MAX_NAMES, bloom_size
from ..operators.names import CORE, EXT, Dictionary

# Fixed values of the format.
MAGIC, VERSION = 0x50494942, 1
SEEDS, PRIME = (0x811C9DC5, 0x9E3779B1), 0x01000193
_HEADER = struct.Struct("<IHHI")
_WRAP = 0xFFFFFFFF


def _fnv(text: str, seed: int) -> int:
    raw = text.encode("utf-16-le", "surrogatepass")
    h = seed
    for (unit,) in struct.iter_unpack("<H", raw):
        h = (h ^ unit) * PRIME & _WRAP
    return h


class BloomFilter:
    """Set membership without false negatives."""

    def __init__(self, m: int, k: int, bits: bytearray | None = None):
        self.m, self.k = m, k
        self.bits = bits if bits is not None else bytearray(-(-m // 8))

    @classmethod
    def for_items(cls, n: int, p: float = 1e-4) -> BloomFilter:
        return cls(*bloom_size(n, p))

    def _places(self, text: str):
        a, b = (_fnv(text, s) for s in SEEDS)
        return [(a + i * (b | 1) & _WRAP) % self.m for i in range(self.k)]

    def add(self, text: str) -> None:
        for i in self._places(text):
            self.bits[i >> 3] |= 1 << (i & 7)

    def __contains__(self, text: str) -> bool:
        return all(self.bits[i >> 3] >> (i & 7) & 1 for i in self._places(text))

    def to_bytes(self) -> bytes:
        return _HEADER.pack(MAGIC, VERSION, self.k, self.m) + bytes(self.bits)

    @classmethod
    def from_bytes(cls, data: bytes) -> BloomFilter:
        magic, version, k, m = _HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a name pack of this version")
        return cls(m, k, bytearray(data[_HEADER.size :]))


def write_packs(names: DataFrame, path: str, generated: str = "") -> DataFrame:
    """Write path/NAME.bin for each script and tier, path/packs.json, and the packs as Parquet in path/table.

    A pack is built in one task; MAX_NAMES bounds its names.  The driver holds one pack
    at a time while it writes the files.
    """
    schema = "name string, script string, tier string, count long, bytes long, content binary"
    most = names.groupBy("script", "tier").count().agg(F.max("count")).first()[0] or 0
    if most > MAX_NAMES:
        raise ValueError(f"{most} names in a pack; at most {MAX_NAMES} fit")

    def build(key, pdf):
        import pandas as pd

        f = BloomFilter.for_items(len(pdf))
        for n in pdf["name"]:
            f.add(n)
        data = f.to_bytes()
        script, tier = key
        return pd.DataFrame([(f"{script.lower()}-{tier}", script, tier, len(pdf), len(data), data)], columns=[c.split()[0] for c in schema.split(", ")])

    spark = names.sparkSession
    names.groupBy("script", "tier").applyInPandas(build, schema).write.mode("overwrite").parquet(f"{path}/table")
    packs = spark.read.parquet(f"{path}/table")
    for r in packs.select("name", "content").toLocalIterator():  # scripts x tiers
        _put(spark, f"{path}/{r['name']}.bin", bytes(r["content"]))
    _put(spark, f"{path}/packs.json", manifest(packs, generated).encode())
    return packs


def _put(spark: SparkSession, uri: str, data: bytes) -> None:
    """Write a file where Spark's file systems reach it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def manifest(packs: DataFrame, generated: str) -> str:
    """The manifest as JSON; one entry for each pack."""
    rows = packs.select("name", "script", "tier", "count", "bytes").orderBy("name").collect()  # scripts x tiers
    return json.dumps({"generated": generated, "packs": [r.asDict() | {"file": f"{r['name']}.bin"} for r in rows]}, indent=2)


class _Tiers:
    """The packs of one script, asked like a dictionary of tiers."""

    def __init__(self):
        self.filters: dict[int, list[BloomFilter]] = {CORE: [], EXT: []}

    def __len__(self) -> int:
        return sum(map(len, self.filters.values()))

    def get(self, word: str, default: int = 0) -> int:
        for tier in (CORE, EXT):
            if any(word in f for f in self.filters[tier]):
                return tier
        return default


def read_packs(spark: SparkSession, path: str, scripts: Iterable[str] | None = None) -> Dictionary:
    """The packs in path as a dictionary for detect(); with scripts, only theirs are read."""
    files = spark.read.format("binaryFile").load(f"{path}/*.bin").select("path", "content")
    spec = json.loads(spark.read.text(f"{path}/packs.json", wholetext=True).first()[0])
    want = {p["file"]: p for p in spec["packs"] if scripts is None or p["script"] in set(scripts)}
    name = F.substring_index("path", "/", -1)
    out = Dictionary()
    for r in files.where(name.isin(*want)).withColumn("path", name).toLocalIterator():  # scripts x tiers
        p = want[r["path"]]
        held = out.names.setdefault(p["script"], _Tiers())
        held.filters[CORE if p["tier"] == "core" else EXT].append(BloomFilter.from_bytes(bytes(r["content"])))
    return out


def pack_metrics(packs: DataFrame) -> DataFrame:
    return packs.rollup("script", "tier").agg(F.sum("count").alias("names"), F.sum("bytes").alias("bytes"))
