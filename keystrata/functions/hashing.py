"""Placement hash (64 bits) and feature hash (32 bits) as Catalyst expressions.

Spark has no unsigned 64-bit type and ANSI mode rejects wrapping products, so a 64-bit
value is carried as two 32-bit halves in BIGINTs and no intermediate product exceeds 2^49.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the placement contract, version 1.
FNV64_BASIS = 0xCBF29CE484222325
FNV64_PRIME = 0x100000001B3
MIX_FIRST = 0xFF51AFD7ED558CCD
MIX_SECOND = 0xC4CEB9FE1A85EC53
KEY_DOMAIN = 0
NODE_DOMAIN = 1
FNV32_BASIS = 2166136261
FNV32_PRIME = 16777619

MASK32 = (1 << 32) - 1
MASK64 = (1 << 64) - 1


def placement_hash_int(payload: bytes) -> int:
    """The same hash on the driver, for the few ring positions."""
    h = FNV64_BASIS
    for b in payload:
        h = ((h ^ b) * FNV64_PRIME) & MASK64
    for factor in (MIX_FIRST, MIX_SECOND):
        h = ((h ^ (h >> 33)) * factor) & MASK64
    return h ^ (h >> 33)


def key_hash_int(key: str) -> int:
    return placement_hash_int(bytes([KEY_DOMAIN]) + key.encode())


def node_hash_int(node: str, vnode: int) -> int:
    return placement_hash_int(bytes([NODE_DOMAIN]) + node.encode() + vnode.to_bytes(4, "little"))


def let(value: Column, body) -> Column:
    """Bind a value once: `body` may refer to it many times without repeating its tree."""
    return F.transform(F.array(value), body)[0]


def _pair(hi: Column, lo: Column) -> Column:
    return F.struct(hi.alias("hi"), lo.alias("lo"))


def _const(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _fnv_step(state: Column, byte: Column) -> Column:
    low = state["lo"].bitwiseXOR(byte)
    part = low * _const(FNV64_PRIME & 0xFFF)
    high = state["hi"] * _const(FNV64_PRIME & 0xFFF) + F.shiftleft(low, 8) + F.shiftright(part, 32)
    return _pair(high.bitwiseAND(_const(MASK32)), part.bitwiseAND(_const(MASK32)))


def _low_product(a: Column, b: int) -> Column:
    """a * b mod 2^32 for 32-bit a and b."""
    upper = (F.shiftright(a, 16) * _const(b)).bitwiseAND(_const(0xFFFF))
    return (a.bitwiseAND(_const(0xFFFF)) * _const(b) + F.shiftleft(upper, 16)).bitwiseAND(_const(MASK32))


def _times(x: Column, factor: int) -> Column:
    fh, fl = factor >> 32, factor & MASK32
    near = x["lo"].bitwiseAND(_const(0xFFFF)) * _const(fl)
    far = F.shiftright(x["lo"], 16) * _const(fl)
    total = near + F.shiftleft(far.bitwiseAND(_const(0xFFFF)), 16)
    high = F.shiftright(total, 32) + F.shiftright(far, 16) + _low_product(x["lo"], fh) + _low_product(x["hi"], fl)
    return _pair(high.bitwiseAND(_const(MASK32)), total.bitwiseAND(_const(MASK32)))


def _xorshift33(x: Column) -> Column:
    return _pair(x["hi"], x["lo"].bitwiseXOR(F.shiftright(x["hi"], 1)))


def _mix(h: Column, factor: int) -> Column:
    return let(h, lambda x: let(_xorshift33(x), lambda y: _times(y, factor)))


def placement_hash(key: Column) -> Column:
    """struct(hi, lo) of the placement hash of a UTF-8 key; null for a null key."""
    latin = F.decode(F.encode(key, "UTF-8"), "ISO-8859-1")
    start = _pair(_const(FNV64_BASIS >> 32), _const(FNV64_BASIS & MASK32))
    seeded = _fnv_step(start, _const(KEY_DOMAIN))

    def fold(text):
        steps = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, seeded, lambda s, i: _fnv_step(s, F.ascii(F.substring(text, i, 1)).cast("bigint")))

    h = let(latin, fold)
    for factor in (MIX_FIRST, MIX_SECOND):
        h = _mix(h, factor)
    return F.when(key.isNotNull(), let(h, _xorshift33))


def hash_hex(h: Column) -> Column:
    return let(h, lambda x: F.lower(F.concat(F.lpad(F.hex(x["hi"]), 8, "0"), F.lpad(F.hex(x["lo"]), 8, "0"))))


def hash_order(h: Column) -> Column:
    """BIGINT that sorts as the unsigned hash does."""
    return let(h, lambda x: F.shiftleft(x["hi"].bitwiseXOR(_const(1 << 31)), 32).bitwiseOR(x["lo"]))


def order_of(h: int) -> int:
    return h - (1 << 63)


def feature_hash(text: Column) -> Column:
    """FNV-1a over the characters of an ASCII feature, 32 bits in a BIGINT."""

    def step(h, i):
        x = h.bitwiseXOR(F.ascii(F.substring(text, i, 1)).cast("bigint"))
        return (x * _const(FNV32_PRIME)).bitwiseAND(_const(MASK32))

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), _const(FNV32_BASIS), step)
