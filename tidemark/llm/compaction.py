"""Plan for compacting small and dirty files: next-fit groups, a queue, and the exact cutoff of the queue.

Files are (source, block, slot) and carry the rows that were written to them, deleted ones too. Three things here are
sequential by definition and are still done range by range of their order, so that nothing that grows with the input
passes through one task, the driver or a broadcast:

* **Next-fit** (:func:`next_fit`). What a range does to the group that is open when it starts depends on one number,
  the bytes in that group, between 0 and the capacity. Each range reports this as a table of intervals, of at most
  capacity + 2 rows; these are chained, and a second pass over the ranges starts each with the right group.
* **The cutoff** (:func:`queue_cut`) by radix drill-down: totals by the first digit of the queue's order (n_files,
  descending) find the digit at which the share is crossed, then the next digit inside that bucket, through bytes and
  key digits, until the bucket holds one group.
* **Ranks**: counts by range are the offsets of the ranks inside the ranges.

Joins go by sorted shuffles: either side grows with the number of files.
"""

from __future__ import annotations

import hashlib
from collections import deque
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm._sql import crc32
from tidemark.session import materialize

BLOCK = 2000
SLOTS = 8
CAPACITY = 65536
PER_FILE = 4096
WAVE = 64
DIRTY_PERCENT, REWRITE_PERCENT = 35, 70
#: Ranges that an order is dealt into: their number doesn't follow the input.
RANGES = 64
#: Bits of a digit of a number; strings have a digit a byte.
DIGIT_BITS = 12


def _floor_div(x: Column, by: int) -> Column:
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by))


def with_files(docs: DataFrame) -> DataFrame:
    """(source, block, slot, live, doc_id, text) of each document. Null sources and texts are empty; a null doc_id
    counts as no digits in the hash and stands in block 0."""
    key = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    base = docs.select(F.coalesce("source", F.lit("")).alias("source"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), key.alias("h"))
    base = base.withColumn("block", F.coalesce(_floor_div(F.col("doc_id"), BLOCK), F.lit(0)).cast("long"))
    base = base.withColumn("slot", F.least(F.col("h") % SLOTS, _floor_div(F.col("h"), SLOTS) % SLOTS).cast("long"))
    gone = _floor_div(F.col("h"), SLOTS * SLOTS) % 100 < 9 * F.pmod(F.col("slot") + F.col("block"), F.lit(SLOTS))
    return base.select("source", "block", "slot", (~gone).alias("live"), "doc_id", "text")


def file_sizes(rows: DataFrame) -> DataFrame:
    """One row a file: rows, deleted, bytes, live_rows, live_bytes, dirty, candidate (dirty or small)."""
    size, live = F.octet_length("text").cast("long"), F.col("live").cast("long")
    f = rows.select("source", "block", "slot", live.alias("live"), size.alias("size")).groupBy("source", "block", "slot")
    f = f.agg(F.count("*").alias("rows"), F.sum(1 - F.col("live")).alias("deleted"), F.sum("size").alias("bytes"), F.sum("live").alias("live_rows"), F.sum(F.col("live") * F.col("size")).alias("live_bytes"))
    dirty = 100 * F.col("deleted") >= DIRTY_PERCENT * F.col("rows")
    return f.withColumn("dirty", dirty).withColumn("candidate", dirty | (4 * F.col("bytes") < 3 * CAPACITY))


class _Entries:
    """What one range does to every group that may be open when it starts, read file by file.

    An open group is its bytes s, 0 to ``capacity + 1`` (more, or none open: the first file starts a group). While
    nothing broke yet, the groups with s up to ``top`` are still the one that came in. The others broke at some file;
    those that broke at the same file are alike from there on, and are one entry of ``open``, oldest first, with the
    bytes before its first file.
    """

    def __init__(self, capacity: int):
        self.capacity, self.top, self.sum = capacity, capacity + 1, 0
        self.open: deque = deque()

    def add(self, size: int, key: tuple) -> None:
        held = []
        top = self.capacity - self.sum - size
        if top < self.top:
            held.append((max(0, top + 1), self.top))
            self.top = top
        while self.open and self.sum + size - self.open[0][0] > self.capacity:
            held += self.open.popleft()[2]
        held = [x for x in held if x[0] <= x[1]]
        if held:
            self.open.append((self.sum, key, held))
        self.sum += size

    def exits(self):
        """(lo, hi, bytes, key): groups of lo to hi bytes leave as the group ``key`` of so many bytes; without a key as
        themselves, so many bytes larger."""
        if self.top >= 0:
            yield 0, self.top, self.sum, None
        for before, key, held in self.open:
            for lo, hi in held:
                yield lo, hi, self.sum - before, key


class _Greedy:
    """The group that is open, read file by file."""

    def __init__(self, capacity: int, size: int | None = None, key: tuple | None = None):
        self.capacity, self.size, self.key = capacity, size, key

    def add(self, size: int, key: tuple) -> tuple:
        if self.size is None or self.size + size > self.capacity:
            self.size, self.key = 0, key
        self.size += size
        return self.key


def next_fit(rows: DataFrame, by: str, order: tuple[str, str], size: str, capacity: int, ranges: int = RANGES) -> DataFrame:
    """``rows`` with ``first_<order>``: the first row of the group that each row belongs to.

    Within each value of ``by``, in the order of two long columns, a row joins the last group, or starts another if the
    group would then hold more than ``capacity`` of ``size`` (long, not negative). A row larger than that is a group
    of its own or ends one. ``by`` (string) isn't null and (by, order) is unique. An empty table gives an empty table.
    """
    ranged = materialize(rows.repartitionByRange(ranges, by, *order).withColumn("_range", F.spark_partition_id()), "fit-ranges")
    dealt = ranged.repartition(ranges, "_range").sortWithinPartitions("_range", by, *order)
    a, b = order

    def exits(batches):
        def told():
            if isinstance(state, _Greedy):
                yield (at, began, last, 0, capacity + 1, state.size, *state.key)
            elif state is not None:
                yield from ((at, began, last, lo, hi, n, *(key or (None, None))) for lo, hi, n, key in state.exits())

        at = began = last = state = None
        out = []
        for batch in batches:
            for r, k, x, y, n in zip(*(batch.column(c).to_pylist() for c in ("_range", by, a, b, size)), strict=True):
                if r != at:
                    out += told()
                    at, began, last, state = r, k, k, _Entries(capacity)
                elif k != last:
                    last, state = k, _Greedy(capacity)
                state.add(n, (x, y))
        out += told()
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)

    schema = pa.schema([("range", pa.int32()), ("began", pa.string()), ("last", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("held", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    tables: dict[int, list] = {}
    # at most capacity + 2 rows a range, whatever the ranges hold
    for x in dealt.select("_range", by, a, b, size).mapInArrow(exits, "range int, began string, last string, lo long, hi long, held long, a long, b long").toLocalIterator():
        tables.setdefault(x.range, []).append(x)
    enters: dict[int, tuple | None] = {}
    state = None  # (by, bytes, key) of the open group
    for r in sorted(tables):
        enters[r] = state
        came = min(state[1], capacity + 1) if state and state[0] == tables[r][0].began else capacity + 1
        x = next(x for x in tables[r] if x.lo <= came <= x.hi)
        state = (x.last, x.held, (x.a, x.b)) if x.a is not None else (x.last, came + x.held, state[2])

    names = rows.columns

    def groups(batches):
        at = last = state = None
        for batch in batches:
            firsts = []
            for r, k, x, y, n in zip(*(batch.column(c).to_pylist() for c in ("_range", by, a, b, size)), strict=True):
                if r != at:
                    at, last, came = r, k, enters[r]
                    state = _Greedy(capacity, *came[1:]) if came and came[0] == k else _Greedy(capacity)
                elif k != last:
                    last, state = k, _Greedy(capacity)
                firsts.append(state.add(n, (x, y)))
            first = [pa.array([f[i] for f in firsts], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *first], names=[*names, f"first_{a}", f"first_{b}"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return dealt.mapInArrow(groups, f"{kinds}, first_{a} long, first_{b} long")


def queue_cut(queue: DataFrame, percent: int) -> Column:
    """A condition that holds for the longest prefix of the queue with at most ``percent`` of all its bytes.

    The queue's order is n_files descending, bytes, source, block, slot ascending; (source, block, slot) is unique.
    A job a digit; what reaches the driver is one row for each value of one digit, at most 4,096.
    """
    x = queue.agg(F.sum("bytes").alias("bytes"), F.max("n_files").alias("n"), F.max("bytes").alias("top"), F.max(F.octet_length("source")).alias("wide"), F.min("block").alias("low"), F.max("block").alias("high"), F.max("slot").alias("slot")).first()
    if x.n is None:
        return F.lit(True)

    def digits(value: Column, most: int) -> list[Column]:
        count = max(1, -(-most.bit_length() // DIGIT_BITS))
        return [F.shiftright(value, DIGIT_BITS * i).bitwiseAND((1 << DIGIT_BITS) - 1) for i in range(count - 1, -1, -1)]

    text = F.hex(F.encode("source", "UTF-8"))
    steps = digits(F.lit(x.n) - F.col("n_files"), x.n) + digits(F.col("bytes"), x.top)
    steps += [F.substring(text, 2 * i + 1, 2) for i in range(x.wide)] + digits(F.col("block") - F.lit(x.low), x.high - x.low) + digits(F.col("slot"), x.slot)
    inside, before, taken = [], 0, 0
    for k, digit in enumerate(steps):
        bucket = queue
        for step, value in zip(steps, inside, strict=False):
            bucket = bucket.where(step == value)
        crossed = None
        for d, held, n in sorted(tuple(r) for r in bucket.groupBy(digit.alias("d")).agg(F.sum("bytes").alias("held"), F.count("*").alias("n")).collect()):
            if 100 * (before + held) > percent * x.bytes:
                crossed = d, n
                break
            before += held
            taken += n
        if crossed is None:  # only a queue without bytes is never crossed
            return F.lit(True)
        inside.append(F.lit(crossed[0]))
        if crossed[1] == 1:
            break
    return F.struct(*[s.alias(f"d{i}") for i, s in enumerate(steps[: k + 1])]) < F.struct(*[v.alias(f"d{i}") for i, v in enumerate(inside)])


def ranked(rows: DataFrame, order: list[Column], name: str, ranges: int = RANGES) -> DataFrame:
    """``rows`` with their place from 0 in an order without ties."""
    ranged = materialize(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "rank-ranges")
    counts = dict(map(tuple, ranged.groupBy("_range").count().collect()))  # one row a range
    offsets = accumulate((counts.get(i, 0) for i in range(max(counts, default=0))), initial=0)
    offset = F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets]), F.col("_range") + 1)
    return ranged.withColumn(name, offset + F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1).drop("_range")


def unit_digests(rows: DataFrame, units: DataFrame) -> DataFrame:
    """(source, unit_block, unit_slot, live_sha256): SHA-256 of ``doc_id:text\\n`` over the live rows of each unit's files in
    order of doc_id, equal ids by text, a null id first and without digits. A unit's rows are read one after another."""
    live = rows.where("live").select("source", "block", "slot", "doc_id", "text")
    moved = live.join(units.select("source", "block", "slot", "unit_block", "unit_slot").hint("merge"), ["source", "block", "slot"])
    key = ["source", "unit_block", "unit_slot"]
    moved = moved.select(*key, "doc_id", F.col("text").cast("binary").alias("text")).repartition(*key).sortWithinPartitions(*key, "doc_id", "text")

    def run(batches):
        at, held = None, None
        for batch in batches:
            out = []
            for *k, i, t in zip(*(batch.column(c).to_pylist() for c in (*key, "doc_id", "text")), strict=True):
                if k != at:
                    if at:
                        out.append((*at, held.hexdigest()))
                    at, held = k, hashlib.sha256()
                held.update(b"%s:%s\n" % (b"" if i is None else b"%d" % i, t))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)
        if at:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*at, held.hexdigest()), strict=True))], schema=schema)

    schema = pa.schema([("source", pa.string()), ("unit_block", pa.int64()), ("unit_slot", pa.int64()), ("live_sha256", pa.string())])
    return moved.mapInArrow(run, "source string, unit_block long, unit_slot long, live_sha256 string")


def plan_compaction(files: DataFrame, capacity: int = CAPACITY, percent: int = REWRITE_PERCENT, per_file: int = PER_FILE, wave: int = WAVE) -> tuple[DataFrame, DataFrame]:
    """(groups, units) for a table of :func:`file_sizes`.

    ``groups``: the groups to rewrite, (source, block, slot) of their first file, n_files, live_rows, bytes, cost, wave.
    ``units``: each file with (unit_block, unit_slot), the group that takes it or itself, and ``moved``. Groups are made
    of all candidates; those of two files or more, or with a dirty file, are queued, and the queue is cut at ``percent``
    of its bytes. Equal queue places don't occur, as the key is unique. An empty table gives empty tables.
    """
    placed = materialize(next_fit(files.where("candidate").drop("rows", "deleted", "candidate"), "source", ("block", "slot"), "live_bytes", capacity), "fit-groups")
    first = [F.col("first_block").alias("block"), F.col("first_slot").alias("slot")]
    groups = placed.select("source", *first, "bytes", "live_bytes", "live_rows", "dirty").groupBy("source", "block", "slot")
    groups = groups.agg(F.count("*").alias("n_files"), F.sum("live_rows").alias("live_rows"), F.sum("bytes").alias("bytes"), F.sum("live_bytes").alias("live_bytes"), F.max("dirty").alias("dirty"))
    queue = materialize(groups.where("n_files >= 2 or dirty"), "fit-queue")
    taken = queue.where(queue_cut(queue, percent))
    cost = F.col("bytes") + F.col("live_bytes") + per_file * F.col("n_files")
    taken = ranked(taken, [F.col("n_files").desc(), *map(F.col, ("bytes", "source", "block", "slot"))], "at")
    taken = materialize(taken.select("source", "block", "slot", "n_files", "live_rows", "bytes", cost.alias("cost"), _floor_div(F.col("at"), wave).alias("wave")), "fit-taken")
    key = taken.select("source", F.col("block").alias("first_block"), F.col("slot").alias("first_slot"))
    members = placed.select("source", "block", "slot", "first_block", "first_slot").join(key.hint("merge"), ["source", "first_block", "first_slot"], "left_semi")
    units = files.join(members.hint("merge"), ["source", "block", "slot"], "left")
    own = lambda c: F.coalesce(f"first_{c}", c).alias(f"unit_{c}")
    return taken, units.select("source", "block", "slot", "live_rows", "bytes", own("block"), own("slot"), F.col("first_block").isNotNull().alias("moved"))


def compaction_table(docs: DataFrame) -> DataFrame:
    """Per rewritten group or untouched file: source, block and slot of its first file, n_files, live_rows, bytes, cost,
    wave, live_sha256. Repeated rows each count; columns besides doc_id, source and text aren't read."""
    rows = with_files(docs)
    files = materialize(file_sizes(rows), "fit-files")
    taken, units = plan_compaction(files)
    units = materialize(units, "fit-units")
    null = F.lit(None).cast("long")
    rest = units.where("not moved").select("source", "block", "slot", F.lit(1).cast("long").alias("n_files"), "live_rows", "bytes", null.alias("cost"), null.alias("wave"))
    digests = unit_digests(rows, units).select("source", F.col("unit_block").alias("block"), F.col("unit_slot").alias("slot"), "live_sha256")
    out = taken.unionByName(rest).join(digests.hint("merge"), ["source", "block", "slot"], "left")
    return out.withColumn("live_sha256", F.coalesce("live_sha256", F.lit(hashlib.sha256().hexdigest())))


def compact(docs: DataFrame, path: str) -> DataFrame:
    """Write the live rows of ``docs`` (doc_id, source, text) as the plan leaves them below ``path``, with the columns
    unit_block and unit_slot, and return what was written. Each unit's rows stand in order of doc_id in one file."""
    rows = with_files(docs)
    files = materialize(file_sizes(rows), "fit-files")
    _, units = plan_compaction(files)
    key = ["source", "unit_block", "unit_slot"]
    live = rows.where("live").join(units.select("source", "block", "slot", "unit_block", "unit_slot").hint("merge"), ["source", "block", "slot"])
    live.select(*key, "doc_id", "text").repartition(*key).sortWithinPartitions(*key, "doc_id", "text").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def oracle() -> str:
    return f"""
with recursive d as (select coalesce(source, '') source, doc_id, coalesce(text, '') t, coalesce(floor(doc_id / {BLOCK}.0)::bigint, 0) block, {crc32("encode(coalesce(doc_id::varchar, ''))")} h from documents),
s as (select *, least(h % 8, (h // 8) % 8) slot from d),
r as (select *, (h // 64) % 100 >= 9 * ((slot + block) % 8) live from s),
f as (select source, block, slot, count(*) n, count(*) filter (not live) gone, sum(strlen(t))::bigint bytes, count(*) filter (live) live_rows, coalesce(sum(strlen(t)) filter (live), 0)::bigint live_bytes from r group by all),
c as (select *, 100 * gone >= {DIRTY_PERCENT} * n dirty, row_number() over (partition by source order by block, slot) k from f where 100 * gone >= {DIRTY_PERCENT} * n or 4 * bytes < 3 * {CAPACITY}),
g as (
  select source, k, block, slot, block b0, slot s0, live_bytes held from c where k = 1
  union all
  select c.source, c.k, c.block, c.slot, case when g.held + c.live_bytes > {CAPACITY} then c.block else g.b0 end, case when g.held + c.live_bytes > {CAPACITY} then c.slot else g.s0 end, case when g.held + c.live_bytes > {CAPACITY} then c.live_bytes else g.held + c.live_bytes end
  from g join c on c.source = g.source and c.k = g.k + 1),
q0 as (select source, b0, s0, count(*) n_files, sum(live_rows)::bigint live_rows, sum(bytes)::bigint bytes, sum(c.live_bytes)::bigint live_bytes from g join c using (source, k) group by all having count(*) >= 2 or bool_or(dirty)),
q1 as (select *, sum(bytes) over (order by n_files desc, bytes, source, b0, s0 rows unbounded preceding) so_far, sum(bytes) over () whole, row_number() over (order by n_files desc, bytes, source, b0, s0) - 1 pos from q0),
q as (select * from q1 where 100 * so_far <= {REWRITE_PERCENT} * whole),
u as (select f.source, f.block, f.slot, coalesce(q.b0, f.block) ub, coalesce(q.s0, f.slot) us, q.b0 is not null moved from f left join g on f.source = g.source and f.block = g.block and f.slot = g.slot left join q on q.source = g.source and q.b0 = g.b0 and q.s0 = g.s0),
o as (
  select source, b0 block, s0 slot, n_files, live_rows, bytes, bytes + live_bytes + {PER_FILE} * n_files cost, pos // {WAVE} wave from q
  union all select f.source, f.block, f.slot, 1, f.live_rows, f.bytes, null, null from f join u using (source, block, slot) where not u.moved),
h as (select u.source, ub block, us slot, sha256(string_agg(coalesce(doc_id::varchar, '') || ':' || t || chr(10), '' order by doc_id nulls first, t)) live_sha256 from r join u using (source, block, slot) where live group by all)
select source, block, slot, n_files, live_rows, bytes, cost::bigint cost, wave::bigint wave, coalesce(live_sha256, sha256('')) live_sha256 from o left join h using (source, block, slot)"""
