"""FNV-1a, 64 bits, as two limbs of 32 bits that no signed 64-bit product overflows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the hash's offset and prime
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3
_LOW = 0xFFFFFFFF
_LOW40 = 0xFFFFFFFFFF
_PRIME_LOW = PRIME - (1 << 40)
_DIGITS = "0123456789ABCDEF"


def fnv1a(data: bytes | str) -> int:
    h = OFFSET
    for byte in data.encode() if isinstance(data, str) else data:
        h = ((h ^ byte) * PRIME) % 2**64
    return h


def fnv1a_limbs(c: Column) -> Column:
    """struct(hi, lo) of a string's or binary's hash."""
    digits = F.hex(F.encode(c, "UTF-8"))
    value = lambda i: F.position(F.substr(digits, i, F.lit(1)), F.lit(_DIGITS)) - 1
    count = F.length(digits) / 2
    places = F.when(count > 0, F.sequence(F.lit(1), count.cast("int"))).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, i: Column) -> Column:
        byte = (value(2 * i - 1) * 16 + value(2 * i)).cast("long")
        low = acc["lo"].bitwiseXOR(byte)
        product = low * _PRIME_LOW
        carried = F.shiftleft(low, 8).bitwiseAND(F.lit(_LOW40))
        hi = (acc["hi"] * _PRIME_LOW + carried + F.shiftright(product, 32)).bitwiseAND(F.lit(_LOW))
        return F.struct(hi.alias("hi"), product.bitwiseAND(F.lit(_LOW)).alias("lo"))

    start = F.struct(F.lit(OFFSET >> 32).cast("long").alias("hi"), F.lit(OFFSET & _LOW).cast("long").alias("lo"))
    return F.aggregate(places, start, step)


def fnv1a_mod(c: Column, n: int) -> Column:
    """hash % n, for n below 2**31."""
    limbs = fnv1a_limbs(c)
    return ((limbs["hi"] % n) * (2**32 % n) + limbs["lo"] % n) % n


def shard_of(key: Column, shards: int) -> Column:
    """The shard that owns a key."""
    return fnv1a_mod(key, shards).cast("int")
