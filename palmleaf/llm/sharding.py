"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by (group hash, row hash). The driver holds only the bracket of each of the shard boundaries; every
round counts, over all rows, the exact bytes in the cells of each bracket, and narrows the bracket to the cell in which
the wanted byte count falls, until the boundary is within tolerance. Rows are then exchanged once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palmleaf.shared import materialize

#: Cells of a bracket in one round, least cells by which rows are numbered within a shard, and rows that such a cell should hold at most.
CELLS, SLOT_CELLS, CELL_ROWS = 64, 64, 100_000
#: Keys are hashes of 62 bits, so that differences fit a long.
TOP = 1 << 62


def hash_key(*columns: Column | str) -> Column:
    """62-bit ordering key; nulls count as a value."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 2)


@dataclass(frozen=True)
class Bracket:
    """Keys lo to hi (inclusive) of ``column``, within the group ``group`` and its row key ``key`` if given; ``below`` bytes come before lo."""

    column: str
    lo: int
    hi: int
    below: int
    group: int | None = None
    key: int | None = None

    def cell(self) -> Column:
        step = -(-(self.hi - self.lo + 1) // CELLS)
        return F.floor((F.col(self.column) - F.lit(self.lo)) / F.lit(step)).cast("int")

    def holds(self) -> Column:
        inside = F.col(self.column).between(self.lo, self.hi)
        inside = inside if self.group is None else inside & (F.col("g") == F.lit(self.group))
        return inside if self.key is None else inside & (F.col("d") == F.lit(self.key))

    def boundary(self, key: int) -> tuple[int, int, int]:
        """(g, d, e) of the first row at or above ``key``."""
        return (key, 0, 0) if self.column == "g" else (self.group, key, 0) if self.column == "d" else (self.group, self.key, key)


def _counted(rows: DataFrame, brackets: list[Bracket]) -> dict[int, list]:
    """Exact bytes, first and last key of each cell that has rows; one aggregation for all brackets."""
    which = reduce(lambda c, x: c.when(x[1].holds(), F.struct(F.lit(x[0]).alias("b"), x[1].cell().alias("c"), F.col(x[1].column).alias("key"))), enumerate(brackets), F.when(F.lit(False), None))
    found = rows.select(which.alias("at"), "size").where("at is not null").groupBy("at.b", "at.c").agg(F.sum("size").alias("bytes"), F.min("at.key").alias("lo"), F.max("at.key").alias("hi"))
    out: dict[int, list] = {i: [] for i in range(len(brackets))}
    for r in found.collect():  # at most CELLS rows for each boundary
        out[r["b"]].append((r["lo"], r["hi"], r["bytes"]))
    return {k: sorted(v) for k, v in out.items()}


def find_splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int, int]]:
    """``shards - 1`` boundaries (g, d, e); a row belongs below one if its (g, d, e) is smaller.

    Bytes below a boundary differ from its even share by at most ``tolerance`` of a shard, or by the bytes of the group
    there if that is more. Only a group that is larger than an even share is cut, at its rows' own keys, and only a key that
    is larger than one, of rows repeated that often, at the numbers e of its rows.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    targets = {s: total * s / shards for s in range(1, shards)}
    if not total:
        return [(TOP, 0, 0)] * (shards - 1)
    slack = tolerance * total / shards
    done: dict[int, tuple[int, int, int]] = {}
    open_: dict[int, Bracket] = {s: Bracket("g", 0, TOP - 1, 0) for s in targets}
    while open_:
        brackets = sorted(set(open_.values()), key=lambda b: (b.column, b.group or 0, b.key or 0, b.lo, b.below))
        cells = _counted(rows, brackets)
        for s, b in list(open_.items()):
            at, below, boundary = targets[s], b.below, b.boundary
            for lo, hi, size in cells[brackets.index(b)]:
                if abs(below - at) <= slack:
                    done[s] = boundary(lo)
                elif abs(below + size - at) <= slack:
                    done[s] = boundary(hi + 1)
                elif below + size < at:
                    below += size
                    continue
                elif lo < hi:
                    open_[s] = Bracket(b.column, lo, hi, below, b.group, b.key)
                elif b.column == "g" and size > total / shards:
                    open_[s] = Bracket("d", 0, TOP - 1, below, lo)
                elif b.column == "d" and size > total / shards:
                    open_[s] = Bracket("e", 0, TOP - 1, below, b.group, lo)
                else:  # one group or key that a shard can hold, or one row: whole, on the side that is nearer
                    done[s] = boundary(lo if at - below < below + size - at else lo + 1)
                break
            else:
                done[s] = (TOP, 0, 0)
            if s in done:
                open_.pop(s)
    return [done[s] for s in sorted(done)]


def shard_rows(rows: DataFrame, shards: int = 16, size: Column | None = None, group: list[str] | None = None, row: list[str] | None = None, tolerance: float = 0.001) -> DataFrame:
    """All ``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard); shard bytes near equal.

    size: bytes of a row (default 1, which evens out counts). group: columns whose equal values share a shard; only a group
    of more bytes than a shard's even share is cut, into neighbouring shards. row:
    columns that tell rows of a group apart. Rows equal in both are one key and stay together, unless they hold more bytes than a
    shard's even share: then they are cut, too, at numbers that they got when the keys were written. Nulls count as values.
    Input columns named shard or slot are replaced; an empty table gives no rows.
    """
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    group, row = group or names, row or names
    keyed = rows.select(F.struct(*names).alias("row"), hash_key(*group).alias("g"), hash_key(*row).alias("d"), (F.lit(1) if size is None else size).cast("long").alias("size"))
    keyed = materialize(keyed.withColumn("e", hash_key(F.monotonically_increasing_id())), "shard-keys")
    g_, d_, e_ = F.col("g"), F.col("d"), F.col("e")
    past = [(g_ > g) | ((g_ == g) & ((d_ > d) | ((d_ == d) & (e_ >= e)))) for g, d, e in find_splitters(keyed.select("g", "d", "e", "size"), shards, tolerance)]
    shard = reduce(lambda a, b: a + b.cast("int"), past, F.lit(0))
    slots = min(4096, max(SLOT_CELLS, -(-keyed.count() // (shards * CELL_ROWS))))
    placed = keyed.select("row", shard.alias("shard"), "d", "e", F.pmod("e", F.lit(slots)).cast("int").alias("cell"))  # by the rows' own numbers: no key fills a cell
    sizes = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = sizes.selectExpr("shard as s", "cell as c", "sum(n) over (partition by shard order by cell) - n as before")
    numbered = placed.selectExpr("*", "row_number() over (partition by shard, cell order by d, e) - 1 as within")
    numbered = numbered.join(F.broadcast(before), (F.col("shard") == F.col("s")) & (F.col("cell") == F.col("c")))  # at most shards * slots rows
    return numbered.select("row.*", "shard", (F.col("before") + F.col("within")).cast("long").alias("slot"))


def shard_report(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Digest of shard_rows over documents by the law ``bytes``; null texts have no bytes."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64("text").alias("same"))
    out = shard_rows(slim, shards, F.col("size"), ["same"], ["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Write the whole rows of ``docs`` (doc_id, text and any other columns) as one folder a shard, ordered by slot within each file."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    placed = shard_rows(docs, shards, F.octet_length(text) + 1, ["text"], ["doc_id"])
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
