"""SimHash near-duplicates by multi-index hashing, and near copies by the similarity of their shingles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverset.llm.common import LOWER, slices, spread, utf8
from coverset.llm.components import components
from coverset.session import lookup_join, materialise

# Odd multipliers that derive further 64-bit planes from a shingle's hash (fixed values).
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
# Members of one table key kept together in a task; a larger key is cut into blocks, which meet pair by pair.
BLOCK_ROWS = 16_384
# Shingle hashes turned into bits, and put into the orders of the minima, at a time.
HASHES, MINIMA = 16_384, 512
# Candidate pairs compared at a time, and per group before the breadth-first search takes over.
PAIRS, MANY_PAIRS = 200_000, 4_000_000
# Similarity of near copies, and texts of one candidate group kept together in a task while it is computed.
SIMILARITY, TEXT_ROWS = 0.8, 128
# Fingerprints of shingle sets that say which texts are compared: planes, bits of a band, differing bits of a band and in all.
# At a similarity of 0.8 a bit differs with probability 0.151 (58 of 384): 1 - (1 - P(Binomial(17, 0.151) <= 1)) ** 22 = 0.998
# of the pairs meet in a band, and 0.999 are within 80 bits (three standard deviations above).
SET_PLANES, SET_BAND, SET_RADIUS, SET_BITS = 6, 17, 1, 80
# A candidate agrees in all minima of one band: 1 - (1 - 0.8 ** 4) ** 20 = 0.99996 of the pairs at 0.8 are compared.
BANDS, BAND_MINIMA = 20, 4
# Odd multipliers and offsets that derive the orders of the minima from a shingle's hash (fixed values).
ORDERS = np.random.default_rng(42).integers(0, 2**64, (2, BANDS * BAND_MINIMA), np.uint64) | np.array([[1], [0]], np.uint64)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of ``size`` words, repeats included."""
    found = utf8(text).translate(LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed=42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(found) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], seed=42) for s, e in zip(starts, ends[size - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray, planes: int) -> list[int]:
    """``planes`` unsigned 64-bit words; a bit is set when more than half the hashes have it."""
    ones = np.zeros((planes, 64), np.int64)
    for start in range(0, len(hashes), HASHES):
        part = hashes[start : start + HASHES]
        for k in range(planes):
            h = part
            if k:
                h = part * np.uint64(MIX[(k - 1) % len(MIX)] + 2 * ((k - 1) // len(MIX)))
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(32)
            ones[k] += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return [int.from_bytes(np.packbits(row * 2 > len(hashes)).tobytes(), "big") for row in ones]


def set_hash(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of the set of shingles: texts with the same shingles share it."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(np.unique(hashes).astype("<u8").tobytes())).astype(np.int64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band: a hash of the least shingles in ``BAND_MINIMA`` orders. No shingles, no keys."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(ORDERS.shape[1], 2**64 - 1, np.uint64)
    for start in range(0, len(hashes), MINIMA):
        part = hashes[None, start : start + MINIMA]
        np.minimum(least, ((part ^ ORDERS[1][:, None]) * ORDERS[0][:, None]).min(axis=1), out=least)
    rows = least.astype("<u8").reshape(BANDS, BAND_MINIMA)
    return np.array([xxhash.xxh3_64_intdigest(row.tobytes(), seed=k) for k, row in enumerate(rows)], np.uint64).view(np.int64)


def fingerprints(
    docs: DataFrame, shingle: int = 5, planes: int = 1, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, sets_only: bool = False
) -> DataFrame:
    """``(doc_id, fp)`` with ``fp`` an array of ``planes`` longs. Null and word-less texts get zero.

    With ``texts`` also ``node``, the hash of the text's set of shingles, its band keys and the text.
    With ``sets_only`` a repeated shingle counts once, and there are no band keys.
    """
    rows = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            made, sets, keys = [], [], []
            for text in part.column(1).to_pylist():
                hashes = shingle_hashes(text, shingle)
                if sets_only:
                    hashes = np.unique(hashes)
                made.append(fingerprint(hashes, planes))
                if texts:
                    sets.append(set_hash(hashes))
                    keys.append(None if sets_only else band_keys(hashes))
            flat = np.array(made, np.uint64).reshape(-1).view(np.int64)
            ends = np.arange(len(made) + 1, dtype=np.int32) * planes
            columns = [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            more = [pa.array(sets, pa.int64()), pa.array(keys, pa.list_(pa.int64())), part.column(1)] if texts else []
            yield pa.RecordBatch.from_arrays(columns + more, names=["doc_id", "fp", "node", "keys", "text"][: 2 + len(more)])

    return rows.mapInArrow(run, "doc_id long, fp array<long>" + (", node long, keys array<long>, text string" if texts else ""))


def pigeonhole(bits: int, distance: int, segments: int) -> list[tuple[int, int, int]]:
    """``(start, width, radius)`` of each segment, such that no pair within ``distance`` is missed.

    The radii are as small as ``sum(radius + 1) > distance`` allows; a segment
    with a larger ball is made wider, so that its keys select as well.
    """
    need = max(distance + 1 - segments, 0)
    radii = [need // segments + (k < need % segments) for k in range(segments)]
    extra = [4 * r for r in radii]
    base = (bits - sum(extra)) // segments
    widths = [min(base + e, 32) for e in extra]
    widths[0] += min(bits - sum(widths), 32 - widths[0])
    starts = np.cumsum([0, *widths[:-1]]).tolist()
    return list(zip(starts, widths, radii))


def bands(bits: int, width: int, radius: int) -> list[tuple[int, int, int]]:
    """Equal segments over a long fingerprint: a pair is met when one segment differs in at most ``radius`` bits."""
    return [(s, width, radius) for s in range(0, bits - width + 1, width)]


def _parts(width: int, radius: int) -> list[tuple[int, int]]:
    """``radius + 1`` parts of a segment: one of them is equal in any two values within ``radius`` bits."""
    cuts = np.linspace(0, width, radius + 2).astype(int)
    return list(zip(cuts[:-1].tolist(), (cuts[1:] - cuts[:-1]).tolist()))


def _ball(width: int, part: tuple[int, int], radius: int) -> np.ndarray:
    """The Hamming ball around zero that leaves the bits of ``part`` alone."""
    free = [b for b in range(width) if not part[0] <= width - 1 - b < part[0] + part[1]]
    flips = [0]
    for r in range(1, radius + 1):
        flips += [sum(1 << b for b in chosen) for chosen in combinations(free, r)]
    return np.array(flips, np.uint64)


def _segment(fp: np.ndarray, start: int, width: int) -> np.ndarray:
    """The bits ``start .. start+width-1``, counted from the highest bit of the first plane."""
    plane, off = divmod(start, 64)
    value = fp[:, plane] << np.uint64(off)
    if off and off + width > 64:
        value = value | (fp[:, plane + 1] >> np.uint64(64 - off))
    return value >> np.uint64(64 - width)


def _planes(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.view(np.uint64).reshape(len(column), -1)


def _tables(layout: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, np.ndarray]]:
    """One entry for each part of each segment: segment start and width, part start and width, ball."""
    return [(s, w, p[0], p[1], _ball(w, p, r)) for s, w, r in layout for p in _parts(w, r)]


def _entries(tables: list):
    """A row for each table: its number and the fingerprint's bits in the table's exact part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            fp = _planes(part.column(1))
            for k, (start, _, at, width, _) in enumerate(tables):
                keys = _segment(fp, start + at, width) | np.uint64(k << 40)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), part.column(0), part.column(1)], names=["key", "node", "fp"]
                )

    return run


def _search(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of all links of a dense group, breadth-first: a row that is reached is not compared again."""
    left, right = [], []
    rest = np.arange(len(fp))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(fp[rest] ^ fp[at]).sum(axis=1, dtype=np.int64) <= distance
            hits, rest = rest[near], rest[~near]
            left.append(np.full(len(hits), at))
            right.append(hits)
            queue += hits.tolist()
    return np.concatenate([np.empty(0, int), *left]), np.concatenate([np.empty(0, int), *right])


def _thin(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links with the same components: every row to the least row it is connected with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if np.array_equal(label, before):
            rows = np.flatnonzero(label != np.arange(n))
            return label[rows], rows


def group_links(fp: np.ndarray, values: np.ndarray, ball: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within one table key: enumerate the ball of each segment value, fetch its matches, verify."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    n, b = len(v), len(ball)
    asked = (v[:, None] ^ ball[None, :]).reshape(-1)
    who = np.repeat(np.arange(n), b)
    low = np.maximum(np.searchsorted(v, asked, "left"), who + 1)
    counts = np.maximum(np.searchsorted(v, asked, "right") - low, 0)
    total = int(counts.sum())
    if not total:
        return np.empty(0, int), np.empty(0, int)
    if total > MANY_PAIRS:
        return _search(fp, distance)
    hit = counts > 0
    who, low, counts = who[hit], low[hit], counts[hit]
    left, right = [], []
    ends = np.cumsum(counts)
    start = 0
    while start < len(counts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
        c = counts[start:stop]
        i = np.repeat(who[start:stop], c)
        j = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[start:stop], c)
        i, j = order[i], order[j]
        near = np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1, dtype=np.int64) <= distance
        left.append(i[near])
        right.append(j[near])
        start = stop
    left, right = np.concatenate(left), np.concatenate(right)
    return _thin(n, left, right) if len(left) > 1 else (left, right)


def _verify(tables: list, distance: int):
    """Links inside each run of one key and block; rows arrive sorted by both."""

    def solve(key: int, parts: list, found: list) -> None:
        node = np.concatenate([p[0] for p in parts])
        if len(node) > 1:
            fp = np.concatenate([p[1] for p in parts])
            start, width, _, _, ball = tables[key >> 40]
            left, right = group_links(fp, _segment(fp, start, width), ball, distance)
            if len(left):
                found.append((node[left], node[right]))

    def out(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[s] for f in found])) for s in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, found = None, [], []
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            block = batch.column(1).to_numpy(zero_copy_only=False)
            node = batch.column(2).to_numpy(zero_copy_only=False)
            fp = _planes(batch.column(3))
            change = np.flatnonzero((keys[1:] != keys[:-1]) | (block[1:] != block[:-1])) + 1
            bounds = np.concatenate([[0], change, [len(keys)]]).tolist()
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                if now != (keys[lo], block[lo]):
                    if parts:
                        solve(int(now[0]), parts, found)
                    now, parts = (keys[lo], block[lo]), []
                parts.append((node[lo:hi], fp[lo:hi]))
            if sum(len(f[0]) for f in found) >= 4096:
                yield out(found)
                found = []
        if parts:
            solve(int(now[0]), parts, found)
        if found:
            yield out(found)

    return run


def links(nodes: DataFrame, layout: list[tuple[int, int, int]], distance: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(a, b)``: pairs of ``node`` that span every component of the links within ``distance``.

    ``nodes`` holds each fingerprint once (``node``, ``fp``). A segment of
    radius r has r + 1 tables, one for each of its parts: the rows of a table
    meet by the exact bits of that part, and the task enumerates the Hamming
    ball over the other bits, fetches the matches and keeps those whose
    complete fingerprints differ in at most ``distance`` bits. Two fingerprints
    whose segments differ in r bits agree in at least one part, so the tables
    together are the whole ball. A key with more than ``block_rows`` members is
    cut into blocks and every two blocks meet in a group of their own.
    """
    tables = _tables(layout)
    rows = nodes.select("node", "fp").mapInArrow(_entries(tables), "key long, node long, fp array<long>")
    large = materialise(
        rows.groupBy("key").count().filter(F.col("count") > block_rows).select("key", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks"))
    )
    if large.isEmpty():
        cut = rows.withColumn("block", F.lit(0))
    else:
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        cut = lookup_join(rows, large, "key", "node", 64, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        cut = cut.withColumn("own", own).select("key", "node", "fp", "own", "blocks", other.alias("other"))
        cut = cut.withColumn("block", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
    cut = cut.select("key", "block", "node", "fp").repartition("key", "block").sortWithinPartitions("key", "block")
    return cut.mapInArrow(_verify(tables, distance), "a long, b long")


def candidates(made: DataFrame) -> DataFrame:
    """``(a, b)``: every node with the least node that shares a band key with it; ``made`` has ``(node, keys)``."""
    rows = made.select("node", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("last")).filter("a < last").select("key", "a")
    return lookup_join(rows, materialise(shared), "key", "node", 64).filter("a < node").select("a", F.col("node").alias("b")).distinct()


def similar_sets(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links between sets of shingles: those with a Jaccard similarity of ``similarity`` or more.

    Breadth-first: a set that is reached is not compared again.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    mark = np.zeros(int(flat.max(initial=-1)) + 1, bool)
    left, right = [], []
    rest = np.flatnonzero(sizes)
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            own = flat[ends[at] - sizes[at] : ends[at]]
            mark[own] = True
            # Only sets of a size that can be similar at all are read.
            fit = np.minimum(sizes[rest], sizes[at]) >= similarity * np.maximum(sizes[rest], sizes[at]) - 1e-9
            common = np.array([np.count_nonzero(mark[flat[ends[k] - sizes[k] : ends[k]]]) for k in rest[fit].tolist()], np.int64)
            mark[own] = False
            near = fit.copy()
            near[fit] = common >= similarity * (sizes[rest[fit]] + sizes[at] - common) - 1e-9
            hits, rest = rest[near], rest[~near]
            left.append(np.full(len(hits), at))
            right.append(hits)
            queue += hits.tolist()
    return np.concatenate([np.empty(0, int), *left]), np.concatenate([np.empty(0, int), *right])


def _compare(shingle: int, similarity: float):
    """Links inside each run of one candidate group and block; rows arrive sorted by both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets = None, [], []

        def solve() -> Iterator[pa.RecordBatch]:
            left, right = similar_sets(sets, similarity) if len(sets) > 1 else ([], [])
            if len(left):
                who = np.array(nodes, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(who[left]), pa.array(who[right])], names=["a", "b"])

        for part in slices(batches):
            for root, block, node, text in zip(*(part.column(i).to_pylist() for i in range(4))):
                if now != (root, block):
                    yield from solve()
                    now, nodes, sets = (root, block), [], []
                nodes.append(node)
                sets.append(np.unique(shingle_hashes(text, shingle)))
        yield from solve()

    return run


def verified(made: DataFrame, groups: DataFrame, shingle: int, similarity: float, text_rows: int = TEXT_ROWS) -> DataFrame:
    """``(a, b)``: links of ``similarity`` or more that span every component of them inside the candidate groups.

    ``made`` has ``(node, text)``, ``groups`` ``(node, root)``. Every two texts of a
    group are compared, each once by its set of shingles; a group of more than
    ``text_rows`` is cut into blocks and every two blocks meet in a group of their own.
    """
    sized = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / text_rows).cast("int").alias("blocks"))
    asked = materialise(lookup_join(groups, sized, "root", "node", 64))
    texts = lookup_join(made.select("node", "text"), asked, "node", "text", 64).groupBy("node", "root", "blocks").agg(F.first("text").alias("text"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cut = texts.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("root", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("block"), "node", "text")
    cut = cut.repartition("root", "block").sortWithinPartitions("root", "block")
    return cut.mapInArrow(_compare(shingle, similarity), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    planes: int = 4,
    distance: int | None = None,
    layout: list[tuple[int, int, int]] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_rows: int = BLOCK_ROWS,
    similarity: float = SIMILARITY,
    verify: bool = False,
) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row for each row of ``docs``.

    With a ``distance`` two documents link when their fingerprints differ in at
    most that many bits; with ``verify`` too those are the fingerprints of the sets
    of distinct shingles, and candidates only: documents link when the Jaccard similarity of
    these sets is ``similarity`` or more, computed from the texts of every group of candidates. Without one they link when the Jaccard similarity of
    their sets of distinct shingles is ``similarity`` or more, computed from the
    texts. Which texts are compared is said by the least shingles in
    ``BANDS * BAND_MINIMA`` orders: a pair of similarity s shares a band with
    probability ``1 - (1 - s ** BAND_MINIMA) ** BANDS``, 0.99996 at 0.8, whatever
    the length of the texts. ``component_id`` is the smallest id reachable, the
    own one included. ``layout`` lists the segments searched for a ``distance``:
    64-bit fingerprints have the exact pigeonhole layout (no pair missed), longer
    ones need one of the caller's.

    Copies share a fingerprint (or a set of shingles) and are one node. A null
    text counts as empty; all texts without words are one group. Rows that repeat
    an id are each returned; an id with several texts joins their groups. A null
    id is never a ``component_id`` unless its whole group has none. Other columns
    of ``docs`` are not read.
    """
    exact = distance is None
    if layout is None and not exact:
        if planes != 1:
            raise ValueError("fingerprints of more than 64 bits need a layout")
        layout = pigeonhole(64, distance, 3)
    made = fingerprints(docs, shingle, planes, id_col, text_col, texts=exact or verify, sets_only=verify and not exact)
    if not exact and not verify:
        # A fingerprint's node is itself, or its hash where it is longer than a long.
        made = made.withColumn("node", F.element_at("fp", 1) if planes == 1 else F.xxhash64("fp"))
    made = materialise(made)
    nodes = materialise(made.groupBy("node").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("least")))
    if exact:
        edges = verified(made, components(candidates(made)), shingle, similarity)
    else:
        edges = links(nodes, layout, distance, block_rows)
        if verify:
            edges = verified(made, components(edges), shingle, similarity)
    several = made.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("one"), F.max("node").alias("two")).filter("one <> two")
    shared = materialise(made.select("doc_id", "node").join(several.select("doc_id"), "doc_id", "left_semi").distinct())
    hub = shared.groupBy("doc_id").agg(F.min("node").alias("a"))
    edges = edges.unionByName(shared.join(hub, "doc_id").select("a", F.col("node").alias("b")))
    roots = components(edges)
    placed = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    sized = placed.join(named, "root").select("node", "component_id")
    return made.select("doc_id", "fp", "node").join(sized, "node", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without near duplicates: of each group the document with the smallest id stays.

    Unless a ``distance`` is given, SimHash fingerprints of the shingle sets say
    which texts are compared and these must be similar (``verify``). Rows that
    repeat an id stand or fall together; a row without an id stays.
    """
    if "distance" not in options:
        layout = bands(64 * SET_PLANES, SET_BAND, SET_RADIUS)
        options = {"planes": SET_PLANES, "distance": SET_BITS, "layout": layout, "verify": True, **options}
    found = near_duplicates(docs, id_col=id_col, **options)
    gone = materialise(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone_id")).distinct())
    # Ids only, and only of copies; counted before they are broadcast.
    side = F.broadcast(gone) if gone.limit(1_000_001).count() <= 1_000_000 else gone
    return docs.join(side, docs[id_col].cast("long") == side["_gone_id"], "left_anti")
