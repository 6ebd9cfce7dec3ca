"""Scratch tables, row keys and size-checked joins shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import remove, scratch

#: Estimated bytes of a lookup table that may be broadcast; larger ones go through a salted shuffle join.
BROADCAST_BYTES = 8_000_000
SALTS = 16
#: Bits of a Bloom filter for each key, 64-bit words of a block, and the most blocks: 2 ** 18 blocks are 32 bytes each.
BITS_PER_KEY, WORDS, MOST_BLOCKS = 16, 4, 1 << 18


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet to shared storage and reread it: the lineage ends there and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame) -> DataFrame:
    """As materialize, in a denser code; the shuffle files that df was made with are removed once it stands, as nothing reads them again."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, path = conf.get(key, "false"), scratch(df.sparkSession)
    conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the table that materialize or written made df from, if it is one; nothing may read it again."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.rpartition("/")[2].startswith("spindle-"):
            remove(df.sparkSession, folder)


def fresh(name: str, *taken: DataFrame | Sequence[str]) -> str:
    """name, with as many underscores before it as it takes to differ from all columns taken, in either case."""
    used = {c.lower() for t in taken for c in (t.columns if isinstance(t, DataFrame) else t)}
    while name.lower() in used:
        name = f"_{name}"
    return name


def bytes_of(df: DataFrame) -> int:
    """An estimate of what df takes in memory: 16 bytes a value and the bytes of texts."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    each = F.lit(16 * len(df.columns)).cast("long")
    for t in texts:
        each = each + t
    return df.agg(F.sum(each).alias("n")).first()["n"] or 0


def lookup_join(big: DataFrame, small: DataFrame, *key: str, how: str = "inner") -> DataFrame:
    """Join on null-free key columns that may be hot in big and are unique in small.

    small is broadcast while its measured bytes stay within BROADCAST_BYTES. Beyond that both sides get a salt, so that
    no key of big lands in one task.
    """
    if bytes_of(small) <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), [*key], how)
    salt = fresh("_salt", big, small)
    salted = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    others = [F.col(f"`{c}`") for c in big.columns if c not in key]
    dealt = big.withColumn(salt, F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [*key, salt], how).drop(salt)


def row_key(df: DataFrame) -> Column:
    """128 bits of all columns of a row. Rows that are equal in every column share it; it depends on no partitioning."""
    cols = [F.to_json(F.struct(f"`{f.name}`")) if _has_map(f.dataType) else F.col(f"`{f.name}`") for f in df.schema]
    empty = F.concat(*(c.isNull().cast("string") for c in cols))  # hashes leave nulls out
    return F.struct(F.xxhash64(F.lit(1), empty, *cols).alias("a"), F.xxhash64(F.lit(2), empty, *cols).alias("b"))


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, (T.MapType, T.VariantType)) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column, i: int) -> Column:
    """The 64-bit word i of a key's mask."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(key, F.lit(i + 1)), F.lit(64)).cast("int"))


def bloom_blocks(keys: int) -> int:
    return max(1, min(MOST_BLOCKS, keys * BITS_PER_KEY // (64 * WORDS) + 1))


def bloom_table(keys: DataFrame, key: str, blocks: int, block: str) -> DataFrame:
    """(block, w0..w3): the bitwise or of the masks of all keys in a block. Partial sums combine before the shuffle."""
    k = F.col(f"`{key}`")
    return keys.groupBy(block_of(k, blocks).alias(block)).agg(*(F.bit_or(_mask(k, i)).alias(f"{block}{i}") for i in range(WORDS)))


def may_hold(key: Column, block: str) -> Column:
    """Whether the joined block of a Bloom filter may hold the key; false where there is no block."""
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & F.coalesce(_mask(key, i).bitwiseAND(F.col(block + str(i))) != 0, F.lit(False))
    return hit


def parted(big: DataFrame, small: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of big whose key is surely not in small, the other rows).

    A blocked Bloom filter of small's keys tells them apart. It has at most MOST_BLOCKS blocks (8 MB) and so may be
    broadcast at any size; with more keys than it can tell apart more rows pass, and the exact join that the caller
    makes of those rows gets larger. No row is ever shuffled here.
    """
    blocks, block = bloom_blocks(small.count()), fresh("_block", big)
    table = materialize(bloom_table(small, key, blocks, block))
    dealt = big.withColumn(block, block_of(F.col(f"`{key}`"), blocks)).join(F.broadcast(table), block, "left")
    maybe = may_hold(F.col(f"`{key}`"), block)
    back = [F.col(f"`{c}`") for c in big.columns]
    return dealt.where(~maybe).select(*back), dealt.where(maybe).select(*back)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; others, whatever their names, take no part."""
    return df.select(*(F.col(f"`{n}`") for n in names))
