"""Sharding by a permutation-filled lookup table, in DataFrame functions only.

Every shard has its own preference order over the slots of a table whose size is prime. The shards take turns; at its turn a
shard claims the free slot that it likes best. A row's key hashes to a slot, and the slot names the shard. Removing a shard
moves few rows besides its own, and loads differ by one slot at most.

The table has a few thousand rows whatever the data, so that it is broadcast; placing a row is one look-up in it.

Edge cases: a null key counts as the empty string; repeated keys share a slot; an empty table gives no rows; other columns of
the input pass through, but for ``slot`` and ``shard``, which are replaced, also where one of them is the key. A key that holds a large part of all rows would fill
one shard: name ``salt`` columns, which then count as part of the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import hex_int, table

SHARDS = 16
#: Slots per shard at least; the more, the closer the loads.
SLOTS_PER_SHARD = 100
#: Slots of a table at most: it is broadcast.
MOST_SLOTS = 1 << 20


def prime_from(n: int) -> int:
    """The smallest prime of at least ``n``."""
    n = max(2, n)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def lookup_table(spark: SparkSession, shards: int = SHARDS, size: int | None = None, seed: str = "shard") -> DataFrame:
    """Rows (slot, shard): the filled table, one row per slot.

    Shard s ranks slot x at (x * step + start) mod size: with a prime size and a step from 1 to size - 1 that is a permutation, and the
    slot of rank r is (r - start) / step. Each shard remembers the rank that it has got to, and a bit says of every slot whether
    it is taken. So a turn looks at a few ranks: as many as one slot in so many is free.
    """
    size = _table_size(shards, size)
    orders = f"transform(sequence(0, {shards - 1}), s -> md5(concat('{seed}/', s)))"
    step = f"1 + cast(conv(substring(d, 9, 8), 16, 10) as bigint) % {size - 1}"
    # step^(size - 2) is the inverse of step
    inverse = f"""aggregate(sequence(0, 31), named_struct('b', {step}, 'e', cast({max(0, size - 2)} as bigint), 'r', 1L),
                  (a, _) -> named_struct('b', a.b * a.b % {size}, 'e', shiftright(a.e, 1), 'r', if(a.e % 2 = 1, a.r * a.b % {size}, a.r)), a -> a.r)"""
    # what the fold needs lives in its state: as columns it would be inlined and computed anew for every slot
    state = f"""named_struct('next', array_repeat(0L, {shards}), 'bits', array_repeat(0L, {size // 64 + 1}),
                'chunk', cast(array() as array<bigint>), 'done', cast(array() as array<array<bigint>>),
                'start', transform({orders}, d -> cast(conv(substring(d, 1, 8), 16, 10) as bigint) % {size}), 'inverse', transform({orders}, d -> {inverse}))"""
    slot = f"pmod((r - acc.start[s]) * acc.inverse[s], {size}L)"
    free = f"(shiftright(acc.bits[cast({slot} div 64 as int)], cast({slot} % 64 as int)) & 1L) = 0"
    near = f"least({size - 1}L, acc.next[s] + 8 + 4 * {size}L div ({size} - t))"
    rank = f"""coalesce(get(filter(sequence(acc.next[s], {near}), r -> {free}), 0), get(filter(sequence(acc.next[s], {size - 1}L), r -> {free}), 0))"""
    # transform over one element binds a value to a name; slots are gathered in chunks, so that no long array is copied every turn
    turn = f"""transform(array(t % {shards}), s -> transform(array({rank}), r -> transform(array({slot}), x -> named_struct(
                 'next', transform(acc.next, (n, i) -> if(i = s, r + 1, n)),
                 'bits', transform(acc.bits, (w, i) -> if(i = x div 64, w | shiftleft(1L, cast(x % 64 as int)), w)),
                 'chunk', if(size(acc.chunk) = 256, array(x), array_append(acc.chunk, x)),
                 'done', if(size(acc.chunk) = 256, array_append(acc.done, acc.chunk), acc.done),
                 'start', acc.start, 'inverse', acc.inverse))[0])[0])[0]"""
    filled = spark.range(1).selectExpr(f"aggregate(sequence(0, {size - 1}), {state}, (acc, t) -> {turn}, acc -> concat(flatten(acc.done), acc.chunk)) as taken")
    return filled.select(F.posexplode("taken").alias("turn", "slot")).select("slot", (F.col("turn") % shards).cast("int").alias("shard"))


def _table_size(shards: int, size: int | None) -> int:
    size = prime_from(size or shards * SLOTS_PER_SHARD)
    if size > MOST_SLOTS:
        raise ValueError(f"a table of {size} slots is too large to send to every task; at most {MOST_SLOTS}")
    return size


def place(df: DataFrame, key: str, shards: int = SHARDS, size: int | None = None, salt: tuple[str, ...] = (), seed: str = "shard") -> DataFrame:
    """``df`` with columns slot (long) and shard (int)."""
    size = _table_size(shards, size)
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (key, *salt)]
    slot = hex_int(F.md5(F.concat_ws("/", *parts)), 1, 12) % size
    slots = F.broadcast(lookup_table(df.sparkSession, shards, size, seed))  # at most MOST_SLOTS rows, whatever the data
    others = [F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")]
    return df.select(*others, slot.alias("slot")).join(slots, "slot").select(*others, "slot", "shard")


def loads(placed: DataFrame) -> DataFrame:
    """Rows of each shard."""
    return placed.groupBy("shard").agg(F.count("*").alias("n_rows"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


_SIZE = prime_from(SHARDS * SLOTS_PER_SHARD)
OP3_SQL = f"""
WITH RECURSIVE orders AS (
  SELECT s, ('0x' || substr(md5('shard/' || s), 1, 8))::BIGINT % {_SIZE} AS start,
         1 + ('0x' || substr(md5('shard/' || s), 9, 8))::BIGINT % {_SIZE - 1} AS step
  FROM range({SHARDS}) r(s)),
fill(turn, slot, free) AS (
  SELECT -1::BIGINT, -1::BIGINT, range({_SIZE})
  UNION ALL
  SELECT turn + 1, best, list_filter(free, lambda x: x <> best)
  FROM (SELECT f.turn, f.free,
               list_min(list_transform(f.free, lambda x: ((x * o.step + o.start) % {_SIZE}) * {_SIZE} + x)) % {_SIZE} AS best
        FROM fill f JOIN orders o ON o.s = (f.turn + 1) % {SHARDS} WHERE f.turn + 1 < {_SIZE})),
slots AS (SELECT slot, (turn % {SHARDS})::INT AS shard FROM fill WHERE turn >= 0)
SELECT d.doc_id, d.slot, slots.shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT % {_SIZE} AS slot FROM documents) d
JOIN slots USING (slot)
"""
