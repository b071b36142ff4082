"""Prefix trie of conversations that share their first turns: node tables with minimal perfect hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverset.session import lookup_join, materialise

# Digest of a prefix: sum of turn mark i times BASE ** i, modulo a Mersenne prime. The root's is zero.
PRIME = (1 << 127) - 1
BASE = 0x3C6EF372FE94F82BA54FF53A5F1D36F1
ROOT = bytes(16)

# Member rows of a subtree that one shard takes whole, rows gathered into one table, nodes of a band of the upper trie.
UNIT_ROWS = (512, 65_536)
SHARD_ROWS = 65_536
BAND_ROWS = 1_000_000
# Ids in one chunk of the text that is hashed for a node.
CHUNK_IDS = 4_096


def _number(raw: bytes) -> int:
    return int.from_bytes(raw, "big")


def _raw(number: int) -> bytes:
    return number.to_bytes(16, "big")


def chained(rows: DataFrame) -> DataFrame:
    """``(conv_id, idx, total, prev, length)`` from ``(conv_id, turn, role, mark, length)``.

    ``idx`` counts the turns of a conversation from 1, ``total`` is the digest
    of its first ``idx`` turns and ``prev`` that of the turns before. Rows are
    sorted by range; a conversation that goes over several ranges, however
    long, carries its count and sum from range to range (a row for each range on
    the driver), so no task holds it whole.
    """
    keys = ["conv_id", "turn", "role", "mark"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "mark", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, head, idx, total, power = TaskContext.get().partitionId(), None, True, 0, 0, 1
        for batch in batches:
            out: list[list] = [[], [], [], []]
            convs = batch.column(0).to_pylist()
            for conv, mark in zip(convs, batch.column(1).to_pylist()):
                if conv != now:
                    head, now, idx, total, power = now is None, conv, 0, 0, 1
                prev, idx, power = total, idx + 1, power * BASE % PRIME
                total = (total + _number(mark) * power) % PRIME
                for column, value in zip(out, (idx, _raw(total), _raw(prev), head)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()), batch.column(2),
                    pa.array(out[3], pa.bool_()), pa.array([part] * batch.num_rows, pa.int64()),
                ],
                names=["conv_id", "idx", "total", "prev", "length", "head", "part"],
            )

    made = materialise(ordered.mapInArrow(run, "conv_id long, idx long, total binary, prev binary, length long, head boolean, part long"))
    ends = made.groupBy("part").agg(
        F.max(F.when(F.col("head"), F.struct("conv_id", "idx", "total"))).alias("first"), F.max(F.struct("conv_id", "idx", "total")).alias("last")
    )
    moves: dict[int, tuple[int, int]] = {}
    conv, n, total = None, 0, 0
    for row in sorted(ends.collect(), key=lambda r: r.part):  # one row for each range
        first, last = row["first"], row["last"]
        if first.conv_id == conv:
            moves[row.part] = (n, total)
        if last.conv_id == first.conv_id == conv:
            n, total = n + last.idx, (total + _number(last.total) * pow(BASE, n, PRIME)) % PRIME
        else:
            conv, n, total = last.conv_id, last.idx, _number(last.total)
    plain = made.drop("head", "part")
    if not moves:
        return plain
    shared = rows.sparkSession.sparkContext.broadcast(moves)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, total, prev = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for k, (head, part) in enumerate(zip(batch.column(5).to_pylist(), batch.column(6).to_pylist())):
                if head and part in shared.value:
                    n, before = shared.value[part]
                    factor = pow(BASE, n, PRIME)
                    idx[k] += n
                    total[k] = _raw((before + _number(total[k]) * factor) % PRIME)
                    prev[k] = _raw((before + _number(prev[k]) * factor) % PRIME)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(idx, pa.int64()), pa.array(total, pa.binary()), pa.array(prev, pa.binary()), batch.column(4)],
                names=["conv_id", "idx", "total", "prev", "length"],
            )

    return materialise(made.mapInArrow(move, plain.schema))


def rebuilt(turns: DataFrame, keep: Column, most: int, base: Column) -> tuple[DataFrame, DataFrame]:
    """``members`` ``(conv_id, depth, digest, parent, length, last)``, a row for each rebuilt turn, and ``shape``, a row for each conversation.

    A conversation begins with the first ``keep`` (at most ``most``) turns of
    conversation ``base`` and goes on with its own turns after as many. The
    digests of its own turns follow from their sums by one shift.
    """
    turns = turns.withColumn("keep", keep.cast("long"))
    convs = turns.groupBy("conv_id", "keep").agg(
        F.max("idx").alias("n"), F.coalesce(F.max(F.when(F.col("idx") == F.col("keep"), F.col("total"))), F.lit(ROOT)).alias("cut")
    )
    # At most ``most`` turns a group.
    heads = turns.filter(F.col("idx") <= most).groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "total", "prev", "length"))).alias("head")
    )
    shape = convs.withColumn("base", base.cast("long")).join(heads, "base", "left")
    shape = shape.withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), 1, F.col("keep").cast("int")))
    shape = shape.withColumn("kept", F.size("head").cast("long"))
    shape = shape.withColumn("last", F.col("kept") + F.greatest(F.col("n") - F.col("keep"), F.lit(0)))
    shape = shape.withColumn("begin", F.when(F.col("kept") > 0, F.get("head", F.size("head") - 1)["total"]).otherwise(F.lit(ROOT)))
    shape = materialise(shape.select("conv_id", "keep", "kept", "last", "head", "begin", "cut"))
    shared = shape.select("conv_id", "last", F.explode("head").alias("h")).select(
        "conv_id", F.col("h.idx").alias("depth"), F.col("h.total").alias("digest"), F.col("h.prev").alias("parent"), F.col("h.length").alias("length"), "last"
    )
    own = lookup_join(turns.filter(F.col("idx") > F.col("keep")), shape.select("conv_id", "kept", "last", "begin", "cut"), "conv_id", "idx", 128)
    own = own.select("conv_id", (F.col("kept") + F.col("idx") - F.col("keep")).alias("depth"), "total", "prev", "length", "last", (F.col("keep") - F.col("kept")).alias("back"), "begin", "cut")
    powers, names = [pow(BASE, -k, PRIME) for k in range(most + 1)], shared.columns

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, prev, back, begin, cut = (batch.column(i).to_pylist() for i in (2, 3, 6, 7, 8))
            made: list[list[bytes]] = [[], []]
            for t, p, k, b, c in zip(total, prev, back, begin, cut):
                low, factor, start = _number(c), powers[k], _number(b)
                for column, value in zip(made, (t, p)):
                    column.append(_raw((start + (_number(value) - low) * factor) % PRIME))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(m, pa.binary()) for m in made), batch.column(4), batch.column(5)], names=names
            )

    return materialise(shared.unionByName(own.mapInArrow(shift, shared.schema))), shape


class Slots:
    """Minimal perfect hash of distinct 128-bit digests: ``n`` digests have the slots 0 to ``n - 1``.

    A digest takes the first level at which it alone claims its bit; its slot is
    the number of claimed bits before. The table of digests by slot verifies
    every answer, so a digest that is not in it has no slot.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, claimed = keys, 0
        while len(left):
            if len(self.levels) > 200:
                raise ValueError("digests repeat")
            at = self._bits(left, len(self.levels), 2 * len(left) + 1)
            alone = np.bincount(at, minlength=2 * len(left) + 1) == 1
            self.levels.append((alone, claimed + np.cumsum(alone) - alone))
            claimed += int(alone.sum())
            left = left[~alone[at]]
        self.table = np.zeros_like(keys)
        place = self._place(keys)
        self.table[place] = keys
        if not np.array_equal(self.find(keys), place) or len(np.unique(place)) != len(keys):
            raise ValueError("slots collide")

    @staticmethod
    def _bits(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = keys[:, 0] ^ (keys[:, 1] * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((level * 0xD1B54A32D192ED03 + 1) % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._bits(keys[left], level, len(alone))
            hit = alone[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each digest, -1 for those that are not in the table."""
        place = self._place(keys)
        if not len(self.table):
            return place
        return np.where((place >= 0) & (self.table[place] == keys).all(axis=1), place, -1)


def _keys(column: pa.Array) -> np.ndarray:
    flat = b"".join(column.to_pylist())
    return np.frombuffer(flat, ">u8").astype(np.uint64).reshape(-1, 2)


def climb(parent: np.ndarray, depth: np.ndarray, *sums: np.ndarray) -> None:
    """Add every node's sums to its parent's, deepest nodes first; nodes without a parent slot keep theirs."""
    order = np.argsort(-depth, kind="stable")
    order = order[parent[order] >= 0]
    levels = np.flatnonzero(np.diff(depth[order])) + 1
    for nodes in np.split(order, levels) if len(order) else []:
        for values in sums:
            np.add.at(values, parent[nodes], values[nodes])


NODE = (
    "digest binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string"
)
NODE_NAMES = [c.split()[0] for c in NODE.split(", ")]


def _shard(rows: pa.Table) -> pa.RecordBatch:
    """Nodes of whole subtrees from their member rows ``(unit, conv_id, depth, digest, parent, length, last)``."""
    conv, depth, length, last = (rows.column(i).to_numpy() for i in (1, 2, 5, 6))
    digest = _keys(rows.column(3))
    distinct, first = np.unique(digest, axis=0, return_index=True)
    slots = Slots(distinct)
    row, place = slots.find(digest), slots.find(distinct)
    n = len(distinct)
    source = np.empty(n, np.int64)  # a member row of each slot's node
    source[place] = first
    parent = slots.find(_keys(rows.column(4).take(pa.array(source))))
    n_convs = np.bincount(row, minlength=n)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, row, conv)
    inside = parent >= 0
    children = np.bincount(parent[inside], minlength=n)
    leaves, saved = (children == 0).astype(np.int64), (n_convs - 1) * length[source]
    climb(parent, depth[source], leaves, saved)
    ends = [hashlib.sha256(b"").hexdigest()] * n
    over = np.flatnonzero(depth == last)
    over = over[np.lexsort((conv[over], row[over]))]
    for group in np.split(over, np.flatnonzero(np.diff(row[over])) + 1) if len(over) else []:
        ends[row[group[0]]] = hashlib.sha256(",".join(map(str, conv[group].tolist())).encode()).hexdigest()
    who = pa.array(source)
    return pa.RecordBatch.from_arrays(
        [
            rows.column(3).take(who).combine_chunks(), _masked(rows.column(4).take(who).combine_chunks(), inside), pa.array(least), pa.array(depth[source]),
            pa.array(least[parent], mask=~inside), pa.array(n_convs), pa.array(children), pa.array(leaves), pa.array(saved), pa.array(ends),
        ],
        names=NODE_NAMES,
    )


def _masked(column: pa.Array, null: np.ndarray) -> pa.Array:
    """``column`` with nulls where ``null`` is true."""
    return pc.if_else(pa.array(null), pa.scalar(None, column.type), column)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole subtrees, sorted by ``unit``, gathered into tables of about ``SHARD_ROWS`` member rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        unit = _keys(batch.column(0))
        cuts = np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1
        if held and held[-1].column(0)[-1].as_py() != batch.column(0)[0].as_py():
            cuts = np.concatenate([[0], cuts])
        at = 0
        for cut in cuts.tolist():
            if size + cut - at >= SHARD_ROWS:
                held.append(batch.slice(at, cut - at))
                yield _shard(pa.Table.from_batches(held))
                held, size, at = [], 0, cut
        if at < batch.num_rows:
            held.append(batch.slice(at))
            size += batch.num_rows - at
    if held:
        yield _shard(pa.Table.from_batches(held))


UPPER = "digest binary, parent binary, conv_id long, depth long, n_convs long, length long, n_children long, n_leaves long, saved_tokens long"


def _band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One band of the upper trie: rows ``UPPER`` with what the levels below have handed up."""
    rows = pa.Table.from_batches(list(batches)).combine_chunks()
    if rows.num_rows == 0:
        return
    conv, depth, n_convs, length, children, leaves, saved = (rows.column(i).to_numpy().copy() for i in range(2, 9))
    slots = Slots(_keys(rows.column(0)))
    place = slots.find(_keys(rows.column(0)))
    up = slots.find(_keys(rows.column(1)))
    at = np.empty(len(place), np.int64)
    at[place] = np.arange(len(place))  # row of each slot
    parent = np.where(up >= 0, at[up], -1)
    inside = parent >= 0
    children += np.bincount(parent[inside], minlength=len(parent))
    leaves += children == 0
    saved += (n_convs - 1) * length
    climb(parent, depth, leaves, saved)
    yield pa.RecordBatch.from_arrays(
        [
            rows.column(0).combine_chunks(), _masked(rows.column(1).combine_chunks(), inside | (depth == 0)), pa.array(conv), pa.array(depth),
            pa.array(conv[parent], mask=~inside), pa.array(n_convs), pa.array(children), pa.array(leaves), pa.array(saved), pa.nulls(len(conv), pa.string()),
        ],
        names=NODE_NAMES,
    )


def _handed(nodes: DataFrame) -> DataFrame:
    """What nodes whose parent is elsewhere hand up to it."""
    return nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("digest")).agg(
        F.count(F.lit(1)).alias("more"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )


def _with(upper: DataFrame, handed: DataFrame) -> DataFrame:
    joined = upper.join(handed, "digest", "left")
    add = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return joined.select("digest", "parent", "conv_id", "depth", "n_convs", "length", add("n_children", "more"), add("n_leaves", "leaves"), add("saved_tokens", "saved"))


def upper_nodes(upper: DataFrame) -> list[DataFrame]:
    """Nodes of the upper trie, band of depths by band, deepest first."""
    made = []
    while True:
        top = upper.agg(F.max("depth")).first()[0]
        if top is None:
            return made
        width = top // 10_000 + 1
        sizes = upper.groupBy(F.expr(f"depth div {width}").alias("k")).count().orderBy(F.col("k").desc()).collect()  # 10,000 rows at most
        low, rows = sizes[0].k, 0
        for r in sizes:
            if rows and rows + r["count"] > BAND_ROWS:
                break
            low, rows = r.k, rows + r["count"]
        band = upper.filter(F.col("depth") >= low * width)
        made.append(materialise(band.coalesce(1).mapInArrow(_band, NODE)))
        if low == 0:
            return made
        upper = materialise(_with(upper.filter(F.col("depth") < low * width), _handed(made[-1])))


def ends_of(rows: DataFrame) -> DataFrame:
    """``(digest, ends_sha256)`` from ``(digest, conv_id)``: the hash of the ids in order, whatever their number.

    Ids are sorted by range and joined into chunks of text, also over the
    borders of ranges; the chunks of a node are hashed one after another.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            digest, conv = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            for k in range(1, len(conv) + 1):
                if k == len(conv) or digest[k] != digest[at] or k - at == CHUNK_IDS:
                    out.append((digest[at], conv[at], ",".join(map(str, conv[at:k]))))
                    at = k
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())],
                    names=["digest", "first", "ids"],
                )

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for digest, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if digest != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = digest, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield from pack(done)
        if now is not None:
            yield from pack([(now, state.hexdigest())])

    def pack(done: list[tuple]) -> Iterator[pa.RecordBatch]:
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], names=["digest", "ends_sha256"])

    placed = rows.select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    cut = materialise(placed.mapInArrow(chunks, "digest binary, first long, ids string"))
    return cut.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(hashes, "digest binary, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame,
    block: int = 100,
    most: int = 5,
    unit_rows: int | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations.

    Conversation c begins with the first h turns of conversation
    ``c - c % block``, h being the crc32 of its decimal id modulo ``most + 1``,
    and goes on with its own turns after its first h. Columns: ``conv_id``
    (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    Prefix digests are sums that tasks carry on from each other. Subtrees of at
    most ``unit_rows`` member rows are shuffled to one shard, which gives its
    distinct digests verified slots and adds up along parent slots; the few
    nodes above them are counted by grouping and added up by bands of depths.
    So neither a first turn that most conversations share nor a very long
    conversation meets in one task.

    Turns are ordered by ``turn`` (null first), ties by role, then by the digest
    of role and text; a repeated turn counts each time. A null role or text is
    empty. Rows without ``conv_id`` belong to no conversation. An empty table
    has no nodes, not even a root. Other columns are not read.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    mark = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), mark.alias("mark"), F.length(text).cast("long").alias("length")
    ).filter("conv_id IS NOT NULL")
    turns = chained(rows)
    id_ = F.col("conv_id")
    members, shape = rebuilt(turns, F.crc32(id_.cast("string").cast("binary")) % (most + 1), most, id_ - id_ % block)
    names = [n for n in NODE_NAMES if n not in ("digest", "parent")]
    whole = shape.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).first()
    if not whole.n:
        return members.sparkSession.createDataFrame([], NODE).select(*names)
    limit = unit_rows or max(UNIT_ROWS[0], min(UNIT_ROWS[1], members.count() // 1024))
    counted = members.groupBy("digest").agg(
        F.sum(F.col("last") - F.col("depth") + 1).alias("below"), F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"),
        F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.max("length").alias("length"),
    )
    # Every level has at most (member rows / limit) such nodes.
    heavy = materialise(counted.filter(F.col("below") > limit).drop("below"))
    marked = lookup_join(members, heavy.select("digest", F.lit(True).alias("heavy")), "digest", "conv_id", 64, "left")
    marked = materialise(marked.withColumn("heavy", F.coalesce("heavy", F.lit(False))))
    light = marked.filter("NOT heavy")
    units = light.groupBy("conv_id").agg(F.min(F.struct("depth", "digest")).alias("top")).select("conv_id", F.col("top.digest").alias("unit"))
    placed = lookup_join(light.drop("heavy"), units, "conv_id", "depth", 64)
    placed = placed.select("unit", "conv_id", "depth", "digest", "parent", "length", "last").repartition("unit").sortWithinPartitions("unit")
    low = materialise(placed.mapInArrow(_shards, NODE))
    zero = [F.lit(0).cast("long").alias(n) for n in ("n_children", "n_leaves", "saved_tokens")]
    upper = heavy.select("digest", "parent", "conv_id", "depth", "n_convs", "length", *zero)
    top = [(ROOT, bytes([255]) * 16, whole.least, 0, whole.n, 0, 0, 0, 0)]
    upper = upper.unionByName(members.sparkSession.createDataFrame([tuple(map(lambda v: bytearray(v) if isinstance(v, bytes) else v, t)) for t in top], UPPER))
    high = upper_nodes(materialise(_with(upper, _handed(low))))
    above = high[0]
    for more in high[1:]:
        above = above.unionByName(more)
    over = marked.filter("heavy AND depth = last").select("digest", "conv_id")
    over = over.unionByName(shape.filter("last = 0").select(F.lit(ROOT).alias("digest"), "conv_id"))
    hashed = ends_of(over)
    none = hashlib.sha256(b"").hexdigest()
    above = above.drop("ends_sha256").join(hashed, "digest", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))
    nodes = low.unionByName(above)
    # Parents in another shard are nodes of the upper trie.
    owners = upper.select(F.col("digest").alias("parent"), F.col("conv_id").alias("owner"))
    nodes = lookup_join(nodes, owners, "parent", "conv_id", 64, "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "owner"))
    return nodes.select(*names)
