"""Storage reports and duplicates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .components import connected_components

#: Size classes in decimal MB, half open.
BUCKETS = (("<1", 0, 1), ("1-5", 1, 5), ("5-20", 5, 20), ("20-100", 20, 100), (">=100", 100, None))


def size_histogram(assets: DataFrame) -> DataFrame:
    """(bucket, n) of all five size classes, empty ones too; assets without a size are left out. One pass."""
    mb = F.col("bytes") / 1_000_000

    def within(low: int, high: int | None) -> Column:
        return (mb >= low if low else mb.isNotNull()) & (mb < high if high else F.lit(True))

    counts = assets.agg(*(F.count_if(within(lo, hi)).alias(name) for name, lo, hi in BUCKETS))
    return counts.unpivot([], [name for name, _, _ in BUCKETS], "bucket", "n")


def daily_storage(assets: DataFrame) -> DataFrame:
    return assets.groupBy(F.to_date("created").alias("day")).agg(F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"), F.count_if(F.col("bytes").isNull()).alias("unmeasured"))


def totals(assets: DataFrame) -> DataFrame:
    return assets.agg(F.sum("bytes").alias("bytes"), F.count("bytes").alias("measured"), F.count("*").alias("assets"))


def by_size(assets: DataFrame, limit: int, ascending: bool = False) -> DataFrame:
    """The largest or smallest; a missing size sorts as -1."""
    size = F.coalesce("bytes", F.lit(-1))
    return assets.orderBy(size.asc() if ascending else size.desc(), "asset_id").limit(limit)


def exact_duplicates(rows: DataFrame, content: str = "text", key: str = "asset_id") -> DataFrame:
    """(key, digest, first): each row whose digest occurs more than once, with the smallest key of its group. Members are rows, not one list, so a group of any size is fine."""
    digests = rows.where(F.col(content).isNotNull()).select(key, F.sha2(F.col(content), 256).alias("digest"))
    groups = digests.groupBy("digest").agg(F.count("*").alias("copies"), F.min(key).alias("first")).where("copies > 1")
    return digests.join(groups, "digest").select(key, "digest", "first", "copies")


#: Words whose buckets a task remembers.
REMEMBERED = 1 << 20


_md5 = partial(hashlib.md5, usedforsecurity=False)


class _Buckets(dict):
    """A word's bucket, worked out when it is first asked for: words come again and again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        first = _md5(word).digest()  # two bytes are four digits
        self[word] = out = (first[0] << 8 | first[1]) % 65
        return out


def _hashed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """(hash, chars, n) of texts in lower case; words are what stands between ASCII white space."""
    buckets = _Buckets()
    for batch in texts:
        lengths, out = pa.compute.utf8_length(batch).to_pylist(), []
        for text, length in zip(batch.cast(pa.binary()), lengths, strict=True):
            said = text.as_py() or b""
            words = said.split()
            counts = np.bincount(list(map(buckets.__getitem__, words)), minlength=65) if words else np.zeros(65, np.int64)
            bits = np.packbits(counts[:-1] > counts[1:], bitorder="little").view("<i8")[0]
            spaces = len(said) - len(b"".join(words))
            out.append((int(bits), (length or 0) - spaces, len(words)))
        yield pa.array([dict(zip(("hash", "chars", "n"), x, strict=True)) for x in out], pa.struct([("hash", pa.int64()), ("chars", pa.int64()), ("n", pa.int64())]))


def difference_hash(rows: DataFrame, key: str = "asset_id", content: str = "text") -> DataFrame:
    """(key, hash, ratio): 64 bits, bit i set if words of bucket i outnumber those of bucket i + 1; ratio is the mean word length.

    A word's bucket is the first four hex digits of its md5 modulo 65. Each row is hashed where it is, without a shuffle; rows
    without words give nothing."""
    told = rows.select(key, F.arrow_udf(_hashed, "hash long, chars long, n long")(F.lower(F.col(content))).alias("h")).where("h.n > 0")
    return told.select(key, "h.hash", F.round(F.col("h.chars") / F.col("h.n"), 6).alias("ratio"))


def hamming(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def hash_classes(hashes: DataFrame, key: str = "asset_id") -> DataFrame:
    """(rep, hash, ratio): one row for each hash and ratio, with the smallest key."""
    return hashes.groupBy("hash", "ratio").agg(F.min(key).alias("rep"))


def _parts(classes: int, distance: int) -> int:
    """Parts into which the 64 bits of a hash are cut: the fewest whose keys, with about 32 bands of ratios, are as selective as the table is large."""
    return next((p for p in range(distance + 1, 64) if (64 // p) * (p - distance) >= classes.bit_length() - 5), 63)


def near_pairs(classes: DataFrame, distance: int = 5, ratio: float = 0.05, parts: int | None = None) -> DataFrame:
    """Pairs (a, b, distance) of classes (rep, hash, ratio) within that Hamming distance and ratio difference.

    The 64 bits are cut into parts; hashes within distance agree in parts - distance of them, so every choice of that many
    parts is a join key, and no pair is missed. Ratios are cut into bands as wide as the difference allowed, so partners
    are in the same band or in neighbouring ones: the band is part of the key too, and one side is there under both. Keys
    that many classes share, as those of short texts do, are split by Spark's skew join; a pair is checked where it meets, and
    counts under the first key that it shares, so that nothing is shuffled after the join."""
    classes = written(classes, "near-classes")
    parts = parts or _parts(classes.count(), distance)
    width = 64 // parts
    part = [F.shiftrightunsigned("hash", width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(parts)]
    # The last part of a choice goes with its key: of the choices in which a pair agrees, the one of the first such parts counts.
    keys = [F.struct(F.xxhash64(F.lit(k), *(part[i] for i in chosen)).alias("k"), F.lit(chosen[-1]).alias("last")) for k, chosen in enumerate(combinations(range(parts), parts - distance))]
    keyed = classes.withColumn("key", F.explode(F.array(*keys))).select(*classes.columns, "key.*").withColumn("band", F.floor(F.col("ratio") / ratio))
    a = keyed.select("k", "last", "band", *(F.col(c).alias(f"{c}_a") for c in ("rep", "hash", "ratio")))
    b = keyed.select("k", F.explode(F.array(F.col("band") - 1, F.col("band"))).alias("band"), *(F.col(c).alias(f"{c}_b") for c in ("rep", "hash", "ratio")))
    # b is in its own band and the one below, so a pair of neighbouring bands meets once, with b in the upper one.
    met = (F.col("rep_a") < F.col("rep_b")) | (F.floor(F.col("ratio_a") / ratio) < F.floor(F.col("ratio_b") / ratio))
    # Sorted and merged on the cluster: by the size of classes, which knows nothing of the keys, Spark would send all of b to the driver.
    near = a.join(b.hint("merge"), ["k", "band"]).where(met & (F.col("rep_a") != F.col("rep_b")) & (hamming("hash_a", "hash_b") <= distance) & (F.abs(F.col("ratio_a") - F.col("ratio_b")) < ratio))
    apart = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
    agree = sum((F.when((F.lit(i) <= F.col("last")) & (F.shiftrightunsigned(apart, width * i).bitwiseAND(F.lit((1 << width) - 1)) == 0), 1).otherwise(0) for i in range(parts)), F.lit(0))
    near = near.where(agree == parts - distance)
    return near.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"), hamming("hash_a", "hash_b").alias("distance"))


def near_groups(hashes: DataFrame, key: str = "asset_id", distance: int = 5, ratio: float = 0.05) -> DataFrame:
    """(key, component) of every row in a group of two or more, linked through its hash class."""
    hashes = written(hashes.select(key, "hash", "ratio"), "hashes")  # texts are hashed once
    classes = written(hash_classes(hashes, key), "hash-classes")
    comps = connected_components(near_pairs(classes, distance, ratio)).select(F.col("node").alias("rep"), "component")
    # Merged on the cluster, as the keys of pairs are: packed tables of some MB hold rows of a hundred, which Spark would send through the driver.
    placed = hashes.join(classes.hint("merge"), ["hash", "ratio"]).join(comps.hint("merge"), "rep", "left").select(key, F.coalesce("component", "rep").alias("component"))
    sizes = placed.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return placed.join(sizes, "component", "left_semi").select(key, "component")
