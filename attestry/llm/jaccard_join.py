"""Exact Jaccard join of word shingles as a metric-space join, with components of its links.

Jaccard distance is a metric, so pivots, Voronoi regions and the triangle inequality apply.
Texts that share nothing are all at distance 1, where no pivot separates them; so the first
level's pivots are sets of one shingle.  A text lies in the region of a shingle that it
holds, and the overlap that a link needs tells in how many regions, rarest shingles first,
it must be placed so that no link is lost: its boundary window.  Shingles that one text
alone holds make regions without pairs, so only shared shingles are carried on.

Regions that share a text are joined to one; every link lies inside one joined region.
There, texts are pivots, at every size.  Pivots of a large region that are far from one
another are the centres of its Voronoi regions; a text within ``BALL`` of a centre is at home
in the nearest one's region, others stay outside.  Boundary texts are replicated to each
region in which the triangle inequality lets a link of theirs end.  Regions are cut again
until they are small, all one group, or without a text at home; a pivot has met its whole
region and leaves.  In a region of at most ``REGION_TEXTS`` texts one task does the same:
balls around pivots, and comparison of what the triangle inequality leaves open.  Every step
works on parts of bounded size, so no region is one task.  Texts that are all unlike one
another but share rare shingles each become pivots: m of them cost m squared distances.

A shingle in ``HOT`` texts or more counts as hot; hot shingles come last and in order of
their hash, so a task that has seen that many needs no other task to place them, and sends
them on spread by text.  Nothing is capped: hot shingles are compared like others.

Defined cases: null and empty texts, and texts of white space, have no shingles and link
with nothing; a text of fewer than five words is one shingle; a very long text is one set of all
its shingles; equal texts link; distances at exactly 0.25 link; rows with
one doc_id are one document each and get their own rows; a null doc_id has the component of
its copies; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy, to_batch
from .components import components
from .hashing import Hasher, mix

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 75
HOT = 63
HASH_BITS = 56
BUCKET_SHINGLES = 1 << 18
CHUNK_SHINGLES = 1 << 19
BATCH_BYTES = 1 << 20
REGION_TEXTS = 256
#: Pivots of a region in the first round; each round asks four times as many, up to the most.
PIVOTS, MOST_PIVOTS, PIVOT_KEYS = 16, 1 << 10, 1 << 20
#: Sets, and shingles of sets, that one task compares with a region's pivots at a time.
PART_ROWS, PART_KEYS = 1 << 11, 1 << 20
#: Tables of at most so many regions are broadcast.
BROADCAST_REGIONS = 1 << 16
#: Greatest distance of a link, and of a set from the centre of its Voronoi region.
RADIUS = 1 - SIMILAR_PERCENT / 100
BALL = 2 * RADIUS

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], hasher: Hasher) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    words, starts = hasher.words(raw)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    bounds = np.searchsorted(starts, begins)
    hashes = np.zeros(max(0, len(words) - SHINGLE_WORDS + 1), np.uint64)
    for k in range(SHINGLE_WORDS):
        hashes = (hashes ^ words[k : k + len(hashes)]) * _FACTOR
        hashes ^= hashes >> np.uint64(29)
    hashes = mix(hashes)
    found = []
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n = high - low
        if n >= SHINGLE_WORDS:
            found.append(np.unique(hashes[low : high - SHINGLE_WORDS + 1]))
        elif n:
            short = np.uint64(n)
            for word in words[low:high]:
                short = mix((short ^ word) * _FACTOR)
            found.append(np.array([short], np.uint64))
        else:
            found.append(np.empty(0, np.uint64))
    return found


def signature(hashes: np.ndarray) -> int:
    """A number for the whole set, as a signed 64-bit integer."""
    total = np.array([mix(hashes).sum(dtype=np.uint64)], np.uint64)
    return int(mix(total + np.uint64(len(hashes))).view(np.int64)[0])


def batches_of_sets(batches, column: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, shingle sets) of some rows at a time."""
    hasher = Hasher()
    for batch in batches:
        ids, texts, size = [], [], 0
        for row in range(batch.num_rows):
            text = batch.column(column)[row].as_py()
            ids.append(batch.column(0)[row].as_py() if column else None)
            texts.append(text.encode() if text else b"")
            size += len(texts[-1])
            if size > BATCH_BYTES:
                yield ids, shingle_sets(texts, hasher)
                ids, texts, size = [], [], 0
        if texts:
            yield ids, shingle_sets(texts, hasher)


def document_sets(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, sig): sig is null for a text without words."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.int64())])

    def run(batches):
        for ids, sets in batches_of_sets(batches, 1):
            yield to_batch(schema, (ids, [len(s) for s in sets], [signature(s) if len(s) else None for s in sets]))

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, sig long")


def keys(hashes: np.ndarray, ranks: np.ndarray, hot: int = HOT) -> np.ndarray:
    """Rank and hash in one positive number; its order is the global order of shingles.

    ``hashes`` have ``HASH_BITS`` bits: two texts of a thousand shingles each have one in
    common by chance once in 10^11 pairs.
    """
    return ((np.minimum(ranks, hot).astype(np.uint64) << np.uint64(HASH_BITS)) | hashes).view(np.int64)


_ENTRY = np.dtype([("hash", "<u8"), ("sig", "<i8")])


def shared_shingles(documents: DataFrame, buckets: int, hot: int = HOT, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """(sig, key) of every shingle that two different sets or more hold."""
    edges = np.array([(k << HASH_BITS) // buckets for k in range(buckets + 1)], np.uint64)
    width = -(-int(np.diff(edges).max()).bit_length() // 8)  # bytes of a hash within its bucket

    def deal(batches):
        def chunk(sets: dict[int, np.ndarray]):
            hashes = np.concatenate(list(sets.values())) >> np.uint64(64 - HASH_BITS)
            sigs = np.repeat(np.fromiter(sets, np.int64, len(sets)), [len(s) for s in sets.values()])
            order = np.argsort(hashes, kind="stable")
            hashes, sigs = hashes[order], sigs[order]
            first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
            counts = np.diff(np.append(first, len(hashes)))
            many = np.repeat(counts >= hot, counts)
            if many.any():
                known = np.zeros(int(many.sum()), _ENTRY)
                known["hash"], known["sig"] = keys(hashes[many], np.full(len(known), hot), hot).view(np.uint64), sigs[many]
                at = (mix(known["sig"].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(at, kind="stable")
                cuts = np.searchsorted(at[order], np.arange(buckets + 1))
                for k in np.flatnonzero(np.diff(cuts)):
                    yield int(k), True, known[order[cuts[k] : cuts[k + 1]]].tobytes()
            # a hot shingle is sent once, with as many stand-ins as make it hot
            marked = first[counts >= hot]
            entries = np.zeros(len(hashes) - int(many.sum()) + len(marked), _ENTRY)
            cold = ~many
            cold[marked] = True
            entries["hash"], entries["sig"] = hashes[cold], np.where(many[cold], 0, sigs[cold])
            cuts = np.searchsorted(entries["hash"], edges)
            for k in np.flatnonzero(np.diff(cuts)):
                part = entries[cuts[k] : cuts[k + 1]]
                packed = (part["hash"] - edges[k]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
                yield int(k), False, packed.tobytes() + part["sig"].tobytes()

        schema = pa.schema([("bucket", pa.int32()), ("ready", pa.bool_()), ("entries", pa.binary())])
        sets, size = {}, 0
        for _, found in batches_of_sets(batches, 0):
            for hashes in found:
                if len(hashes):
                    sets[signature(hashes)] = hashes
                    size += len(hashes)
            if size > chunk_shingles:
                yield to_batch(schema, zip(*chunk(sets), strict=True))
                sets, size = {}, 0
        if sets:
            yield to_batch(schema, zip(*chunk(sets), strict=True))

    def count(batches):
        schema = pa.schema([("sig", pa.int64()), ("key", pa.int64())])

        def bucket(number: int, parts: list[bytes]):
            many = [len(p) // (width + 8) for p in parts]
            raw = np.zeros((sum(many), 8), np.uint8)
            raw[:, :width] = np.concatenate([np.frombuffer(p, np.uint8, n * width) for p, n in zip(parts, many, strict=True)]).reshape(-1, width)
            hashes = raw.view("<u8").reshape(-1) + edges[number]
            sigs = np.concatenate([np.frombuffer(p, "<i8", n, n * width) for p, n in zip(parts, many, strict=True)])
            order = np.lexsort((sigs, hashes))
            hashes, sigs = hashes[order], sigs[order]
            new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (sigs[1:] != sigs[:-1])))
            hashes, sigs = hashes[new], sigs[new]
            first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
            sizes = np.diff(np.append(first, len(hashes)))
            ranks = sizes + np.add.reduceat(np.where(sigs == 0, hot, 0), first)
            spread = np.repeat(ranks, sizes)
            kept = (spread > 1) & (sigs != 0)
            return to_batch(schema, (sigs[kept], keys(hashes[kept], spread[kept], hot)))

        now, parts = None, []
        for batch in batches:
            for number, ready, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if ready:
                    known = np.frombuffer(cell.as_py(), _ENTRY)
                    yield to_batch(schema, (known["sig"], known["hash"].view(np.int64)))
                    continue
                if number != now and parts:
                    yield bucket(now, parts)
                    parts = []
                now = number
                parts.append(cell.as_py())
        if parts:
            yield bucket(now, parts)

    dealt = documents.select("text").mapInArrow(tidy(deal), "bucket int, ready boolean, entries binary")
    tasks = max(1, min(buckets, -(-buckets // 4) if buckets > 64 else buckets))
    return dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(count), "sig long, key long")


def needed_overlap(n: F.Column) -> F.Column:
    """The least number of common shingles of a set of n with any set that it links to."""
    return F.ceil(n * SIMILAR_PERCENT / F.lit(100)).cast("int")


def open_sets(documents: DataFrame, sets: DataFrame, hot: int = HOT, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """(sig, n, shared, window): sets with so many shared shingles that a link is possible.

    ``shared`` holds the keys in order, and its first ``window`` ones are the regions that
    the set must be placed in.
    """
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_SHINGLES))
    rows = shared_shingles(documents, buckets, hot, chunk_shingles)
    grouped = rows.groupBy("sig").agg(F.array_sort(F.collect_set("key")).alias("shared"))
    sizes = sets.where("sig is not null").groupBy("sig").agg(F.max("n_shingles").cast("int").alias("n"))
    window = F.size("shared") - needed_overlap(F.col("n")) + 1
    return grouped.join(sizes, "sig").withColumn("window", window).where("window > 0")


def regions(opened: DataFrame) -> DataFrame:
    """(sig, region): first-level regions that share a set are one region."""
    placed = stored(opened.select("sig", F.explode(F.slice("shared", F.lit(1), F.col("window"))).alias("key")), "placed")
    heads = stored(placed.groupBy("key").agg(F.min("sig").alias("head"), F.max("sig").alias("tail")).where("head <> tail").select("key", "head"), "heads")
    edges = placed.join(heads, "key").where("sig <> head").select("sig", "head").distinct()
    return components(edges).select(F.col("node").alias("sig"), F.col("component").alias("region"))


def linked(common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * common >= SIMILAR_PERCENT * (n + m - common)


class Region:
    """The sets of one region, each shingle numbered."""

    def __init__(self, sigs: list[int], sizes: list[int], shared: list[np.ndarray]):
        self.sigs, self.n = sigs, np.array(sizes, np.int64)
        flat, numbers = np.unique(np.concatenate(shared), return_inverse=True)
        self.owner = np.repeat(np.arange(len(sigs)), [len(s) for s in shared])
        self.number, self.width = numbers.reshape(-1), len(flat)
        self.bounds = np.cumsum([0, *(len(s) for s in shared)])

    def distances(self, pivot: int) -> tuple[np.ndarray, np.ndarray]:
        """(distance, linked) of every set to one of them."""
        flag = np.zeros(self.width, bool)
        flag[self.number[self.bounds[pivot] : self.bounds[pivot + 1]]] = True
        common = np.bincount(self.owner, flag[self.number], len(self.n)).astype(np.int64)
        common[pivot] = self.n[pivot]  # shingles that it alone holds are not in its list
        union = self.n + self.n[pivot] - common
        return 1 - common / union, linked(common, self.n, self.n[pivot])

    def links(self) -> Iterator[tuple[int, int]]:
        """Links that join all linked sets: every pivot with its ball, then what the triangle
        inequality leaves open between a ball and what lies outside of it."""
        radius = RADIUS + 1e-9
        parent = list(range(len(self.n)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def join(x: int, y: int):
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                return True
            return False

        active = np.ones(len(self.n), bool)
        while active.any():
            pivot = int(np.flatnonzero(active)[0])
            distance, near = self.distances(pivot)
            ball = np.flatnonzero(active & near)
            for x in ball.tolist():
                if join(x, pivot):
                    yield self.sigs[x], self.sigs[pivot]
            active[ball] = False
            outside = np.flatnonzero(active & (distance <= 2 * radius))
            for x in outside.tolist():
                inside = ball[(distance[ball] >= distance[x] - radius) & (ball != pivot)]
                if not len(inside) or root(x) == root(pivot):
                    continue
                _, close = self.distances(x)
                met = inside[close[inside]]
                if len(met) and join(x, int(met[0])):
                    yield self.sigs[x], self.sigs[int(met[0])]


LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def small_region_links(members: DataFrame) -> DataFrame:
    """Links inside regions of bounded size: one group per region."""

    def run(batches):
        for batch in batches:
            for cell in batch.column(0):
                rows = cell.as_py()
                rows.sort(key=lambda r: r["sig"])
                region = Region([r["sig"] for r in rows], [r["n"] for r in rows], [np.array(r["shared"], np.int64) for r in rows])
                if found := list(region.links()):
                    yield to_batch(LINKS, zip(*found, strict=True))

    grouped = members.groupBy("region").agg(F.collect_list(F.struct("sig", "n", "shared")).alias("rows"))
    return grouped.select("rows").mapInArrow(tidy(run), "u long, v long")


class Pivots:
    """Some sets of one region as pivots; the centres among them are far from one another."""

    def __init__(self, sigs: np.ndarray, sizes: np.ndarray, shared: list[np.ndarray]):
        order = np.argsort(sigs)
        self.sigs, self.n, own = sigs[order], sizes[order], [shared[k] for k in order.tolist()]
        self.flat, numbers = np.unique(np.concatenate(own), return_inverse=True)
        self.held = np.split(numbers.reshape(-1), np.cumsum([len(x) for x in own])[:-1])
        distance, self.near = self.distances(self.sigs, self.n, own)
        centres: list[int] = []
        for k in range(len(own)):
            if not (distance[k, centres] <= BALL).any():
                centres.append(k)
        self.centres = np.array(centres)
        #: what an earlier pivot already joins to a later one
        self.before = np.triu(self.near, 1).astype(np.float32)

    def distances(self, sigs: np.ndarray, sizes: np.ndarray, shared: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(distance, linked) of sets, a row each, to every pivot."""
        lengths = np.array([len(x) for x in shared])
        keys = np.concatenate(shared)
        at = np.minimum(np.searchsorted(self.flat, keys), len(self.flat) - 1)
        known = np.flatnonzero(self.flat[at] == keys)
        owner, at = np.repeat(np.arange(len(shared)), lengths)[known], at[known]
        common, flag = np.zeros((len(shared), len(self.n)), np.int64), np.zeros(len(self.flat), bool)
        for pivot, numbers in enumerate(self.held):
            flag[numbers] = True
            common[:, pivot] = np.bincount(owner, flag[at], len(shared))
            flag[numbers] = False
        same = sigs[:, None] == self.sigs
        common = np.where(same, self.n, common)  # shingles that it alone holds are not in its list
        return 1 - common / (sizes[:, None] + self.n - common), linked(common, sizes[:, None], self.n)


CUT = pa.schema([
    ("u", pa.int64()), ("v", pa.int64()), ("from_group", pa.int64()), ("to_group", pa.int64()), ("centre", pa.int64()), ("home", pa.bool_()),
    ("was_home", pa.bool_()), ("region", pa.int64()), ("sig", pa.int64()), ("n", pa.int32()), ("shared", pa.list_(pa.int64())), ("group", pa.int64()),
])
CUT_DDL = "u long, v long, from_group long, to_group long, centre long, home boolean, was_home boolean, region long, sig long, n int, shared array<long>, group long"


def lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    column = column.combine_chunks()
    flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy()
    return np.split(flat, offsets[1:-1] - offsets[0]) if len(column) else []


def cut(rows: pa.Table, drawn: pa.Table) -> pa.Table:
    """Part of a region against its pivots: links to them, and the places of all other sets.

    A set's home is its nearest centre within ``BALL``, or else the outside.  It also goes to
    every earlier centre's region in which the triangle inequality lets a link end: of two
    linked sets with homes i < k the second is within ``BALL`` and the join radius of centre
    i, and no further from it than from its own by twice the radius.
    """
    if not rows.num_rows:
        return CUT.empty_table()
    was_home = rows["home"].to_numpy()
    if not drawn.num_rows:  # by chance none was drawn in this round
        return placed_rows(rows, np.arange(len(rows)), was_home, was_home, [None] * len(rows))
    pivots = Pivots(drawn["sig"].to_numpy(), drawn["n"].to_numpy().astype(np.int64), lists(drawn["shared"]))
    group_of = dict(zip(drawn["sig"].to_pylist(), drawn["group"].to_pylist(), strict=True))
    sigs, sizes = rows["sig"].to_numpy(), rows["n"].to_numpy().astype(np.int64)
    distance, near = pivots.distances(sigs, sizes, lists(rows["shared"]))
    row, pivot = np.nonzero(near & ~(near.astype(np.float32) @ pivots.before > 0) & (sigs[:, None] != pivots.sigs))
    ends = pivots.sigs[pivot]
    links = to_batch(
        pa.schema(list(CUT)[:4]),
        (sigs[row], ends, rows["group"].to_numpy()[row], np.array([group_of[x] for x in ends.tolist()], np.int64)),
    )
    left = np.flatnonzero(~np.isin(sigs, pivots.sigs))
    far = distance[left][:, pivots.centres]
    nearest = far.argmin(axis=1)
    own = far[np.arange(len(left)), nearest]
    outside = own > BALL
    reach = np.where(outside, BALL + RADIUS, np.minimum(BALL + RADIUS, own + 2 * RADIUS)) + 1e-9
    window = (far <= reach[:, None]) & (outside[:, None] | (np.arange(len(pivots.centres)) < nearest[:, None]))
    at, centre = np.nonzero(window)
    names = pivots.sigs[pivots.centres]
    places = np.concatenate((left, left[at]))
    centres = [None if far_off else name for far_off, name in zip(outside.tolist(), names[nearest].tolist(), strict=True)] + names[centre].tolist()
    # outside, a pair still needs one that was at home before
    home = np.concatenate((~outside | was_home[left], np.zeros(len(at), bool)))
    shown = pa.Table.from_batches([links])
    for field in list(CUT)[4:]:
        shown = shown.append_column(field, pa.nulls(len(shown), field.type))
    return pa.concat_tables([shown, placed_rows(rows, places, home, was_home[places], centres)])


def placed_rows(rows: pa.Table, places: np.ndarray, home: np.ndarray, was_home: np.ndarray, centres: list) -> pa.Table:
    taken = rows.select(["region", "sig", "n", "shared", "group"]).take(pa.array(places, pa.int64()))
    none = pa.nulls(len(taken), pa.int64())
    columns = [none] * 4 + [pa.array(centres, pa.int64()), pa.array(home.astype(bool)), pa.array(was_home.astype(bool))]
    return pa.table([*columns, *taken.columns], names=CUT.names).cast(CUT)


def voronoi_round(members: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """(links, next members) of one level: pivots of every region, its Voronoi regions and windows.

    ``members``: region, sig, n, shared, group (what is linked so far), home.  Pivots come
    from the sets that are at home or from those outside the region's largest group, whatever
    is fewer; they meet the whole region, in parts of bounded size, and are done with.  A
    region in which nothing is at home, or all is one group, is done with too.
    """
    sized = members.groupBy("region", "group").agg(
        F.count("*").alias("rows"), F.count(F.when(F.col("home"), 1)).alias("homes"), F.sum(F.size("shared")).alias("keys")
    )
    sizes = sized.groupBy("region").agg(
        F.sum("rows").alias("rows"), F.sum("homes").alias("homes"), F.sum("keys").alias("keys"), F.max("rows").alias("most"), F.max_by("group", F.struct("rows", "group")).alias("main")
    )
    by_home = F.col("homes") <= F.col("rows") - F.col("most")
    wanted = F.greatest(F.lit(1.0), F.least(F.lit(float(min(PIVOTS << (2 * number), MOST_PIVOTS))), PIVOT_KEYS * F.col("rows") / F.col("keys")))
    parts = F.ceil(F.greatest(F.col("rows") / PART_ROWS, F.col("keys") / PART_KEYS)).cast("int")
    sizes = stored(sizes.select("region", "main", "rows", by_home.alias("by_home"), wanted.alias("wanted"), F.when(by_home, F.col("homes")).otherwise(F.col("rows") - F.col("most")).alias("open"), parts.alias("parts")), "region-sizes")
    held = members.join(named_regions(sizes), "region")
    chance = F.pmod(F.xxhash64("sig", F.lit(number)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    open_here = F.when(F.col("by_home"), F.col("home")).otherwise(F.col("group") != F.col("main"))
    drawn = stored(held.where(open_here & (chance * F.col("open") < F.col("wanted"))).select("region", "sig", "n", "shared", "group", "parts"), "pivots")
    drawn = drawn.select("region", "sig", "n", "shared", "group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = held.select("region", "sig", "n", "shared", "group", "home", F.pmod(F.xxhash64("sig", F.lit(-1 - number)), F.col("parts")).cast("int").alias("part"))
    met = dealt.groupBy("region", "part").cogroup(drawn.groupBy("region", "part")).applyInArrow(cut, CUT_DDL)
    met = stored(met, "voronoi")
    links = met.where("u is not null")
    joined = components(links.select("from_group", "to_group")).withColumnsRenamed({"node": "group", "component": "now"})
    region = F.xxhash64("region", F.lit(number), F.coalesce("centre", F.lit(0)), F.col("centre").isNull())
    placed = met.where("sig is not null").withColumn("region", region).join(joined, "group", "left").withColumn("group", F.coalesce("now", "group"))
    placed = stored(placed.select("region", "sig", "n", "shared", "group", "home", "was_home"), "placed")
    going_on = placed.groupBy("region").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.max("home").alias("any"), F.max("was_home").alias("one"))
    going_on = going_on.where("low <> high and any and one").select("region")
    return links.select("u", "v"), placed.join(going_on, "region", "left_semi").drop("was_home")


def links(documents: DataFrame, sets: DataFrame, hot: int = HOT, chunk_shingles: int = CHUNK_SHINGLES, region_texts: int = REGION_TEXTS) -> DataFrame:
    """(u, v): links between different sets, enough of them to join all that are linked."""
    opened = stored(open_sets(documents, sets, hot, chunk_shingles), "open-sets")
    placed = stored(regions(opened), "regions")
    members = opened.select("sig", "n", "shared").join(placed, "sig").select("region", "sig", "n", "shared", F.col("sig").alias("group"), F.lit(True).alias("home"))
    found, number = None, 0
    while True:
        members = stored(members, "members")
        large = stored(members.groupBy("region").agg(F.count("*").alias("many")).where(F.col("many") > region_texts).select("region"), "large-regions")
        marked = named_regions(large)
        small = stored(small_region_links(members.join(marked, "region", "left_anti")), "small-links")
        found = small if found is None else found.unionAll(small)
        if large.isEmpty():
            return found
        met, members = voronoi_round(members.join(marked, "region", "left_semi"), number)
        found, number = found.unionAll(met), number + 1


def named_regions(rows: DataFrame) -> DataFrame:
    """A stored table with a row per large region, sent to all tasks where it is small, so that a
    region's sets need not meet in one task to be told apart."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_REGIONS else rows


def joined(documents: DataFrame, **sizes: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    sets = stored(document_sets(documents), "document-sets")
    groups = components(links(documents, sets, **sizes)).withColumnRenamed("node", "sig")
    by_sig = sets.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"))
    named = by_sig.join(groups, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = stored(named.join(least, "component").select("sig", "component_id"), "set-components")
    found = sets.where("sig is not null").join(answer, "sig", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    # documents without words are not joined: they would all meet in one task
    return found.unionAll(sets.where("sig is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
