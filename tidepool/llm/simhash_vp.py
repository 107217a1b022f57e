"""SimHash fingerprints and their exact links through vantage-point trees.

Fingerprints that differ in at most 3 of 64 bits differ in at most 1 bit of one of
their two 32-bit halves. Each half has a vantage-point tree over the half's Hamming
distance: a node holds a vantage value and a radius, and values within the radius go
left. A fingerprint lives in the leaf that this walk ends in and visits every other leaf
that its ball of 1 bit overlaps: by the triangle inequality it crosses a node's boundary only if its
distance to the vantage value lies within 1 of the radius. So of two linked fingerprints one
visits the other's leaf. Leaves are the shards. Within a shard the tree goes on until few
values are left, which are compared at 3 of 64 bits, visitors with residents; residents that lie at a
boundary visit the other side there too. Residents that no vantage value tells apart are
split by whole fingerprints, and the zones beside the boundary (3 bits wide) are compared across.

Equal fingerprints are one class and are linked once. A shard gives the links of
its own spanning stars, never all pairs, and the stars of all shards are joined
by connected components.

The trees come from a bounded sample and have at most LEAVES leaves; every fingerprint is dealt
through them, and beyond LEAVES * LEAF_ROWS fingerprints shards grow, which their own trees split on.

Defined results: null, empty or blank text has fingerprint zero and is linked
like any other; texts of one or two words have one shingle; repeated rows get the
same fingerprint; a null doc_id links nothing and gets the component of its
fingerprint, NULL if no other document has it; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, quoted
from .components import connected_components

SEED = 42
SHINGLE = 3
RADIUS = 3
BANDS = 2
BAND_BITS = 32
#: Bits in which the half that is alike may differ.
REACH = RADIUS // BANDS
#: Fingerprints from which the trees are built, residents a leaf should hold, leaves at most, and
#: values of the sample that a node tries as its vantage value.
SAMPLE = 1 << 16
LEAF_ROWS = 1 << 13
LEAVES = 1 << 12
TRIES = 16
#: Values that are compared at once, and residents that are not split further.
BLOCK = 1024


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint of a whole text."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        pairs = zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist())
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[s:e], SEED) for s, e in pairs], np.uint64)
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 15):
        part = hashes[lo : lo + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * counts > len(hashes)).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = np.array([fingerprint(t) for t in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def half(fp: np.ndarray, band: int) -> np.ndarray:
    return (fp >> np.uint64(BAND_BITS * band) & np.uint64((1 << BAND_BITS) - 1)).astype(np.uint32)


def choose_vantage(values: np.ndarray) -> tuple[int, int] | None:
    """Vantage value and radius that split values with the fewest of them at the boundary; NULL if
    none of those tried tells them apart."""
    best = None
    for at in range(0, len(values), max(1, len(values) // TRIES)):
        gaps = np.bitwise_count(values ^ values[at])
        radius = int(np.median(gaps))
        if not (gaps > radius).any():
            radius -= 1
        if radius < 0:
            continue
        zone = int(((gaps > radius - REACH) & (gaps <= radius + REACH)).sum())
        if best is None or zone < best[0]:
            best = (zone, int(values[at]), radius)
    return best and best[1:]


def build_tree(values: np.ndarray, leaves: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage value, radius, left, right) over the values of a half; a negative
    child is leaf -1 - child."""
    nodes: list[tuple[int, int, int, int]] = []
    ended = 0

    def grow(part: np.ndarray, leaves: int) -> int:
        nonlocal ended
        found = choose_vantage(part) if leaves > 1 and len(part) > 1 else None
        if not found:
            ended += 1
            return -ended
        at, near = len(nodes), np.bitwise_count(part ^ np.uint32(found[0])) <= found[1]
        nodes.append((*found, 0, 0))
        left, right = grow(part[near], leaves // 2), grow(part[~near], leaves // 2)
        nodes[at] = (*found, left, right)
        return at

    root = grow(values.astype(np.uint32), leaves)
    return nodes if root == 0 else []


def find_leaves(nodes: list[tuple[int, int, int, int]], values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, leaf, lives) of each value: the leaf it lives in, and those that its ball overlaps."""
    who, lives, at = np.arange(len(values)), np.ones(len(values), bool), np.zeros(len(values), np.int64)
    if not nodes:
        return who, at, lives
    table, done = np.array(nodes, np.int64), []
    while len(who):
        vantage, radius, left, right = table[at].T
        gap = np.bitwise_count(values[who] ^ vantage.astype(np.uint32)).astype(np.int64)
        near = gap <= radius
        own = np.where(near, left, right)
        cross = np.where(near, gap > radius - REACH, gap <= radius + REACH)
        other = np.where(near, right, left)[cross]
        who, lives, at = np.concatenate((who, who[cross])), np.concatenate((lives, np.zeros(cross.sum(), bool))), np.concatenate((own, other))
        ended = at < 0
        done.append((who[ended], -1 - at[ended], lives[ended]))
        who, lives, at = who[~ended], lives[~ended], at[~ended]
    return tuple(np.concatenate(x) for x in zip(*done))


class Links:
    """Classes of positions that are linked so far."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Link the positions in a with those in b, pair by pair."""
        x, y = self.label[a], self.label[b]
        apart = x != y
        if not apart.any():
            return
        pairs = np.unique(np.stack([np.minimum(x, y)[apart], np.maximum(x, y)[apart]]), axis=1)
        ends = np.unique(pairs)
        low, high = np.searchsorted(ends, pairs)
        root = np.arange(len(ends))
        while True:
            new = root.copy()
            np.minimum.at(new, high, root[low])
            np.minimum.at(new, low, root[high])
            new = new[new]
            if (new == root).all():
                break
            root = new
        to = np.arange(len(self.label))
        to[ends] = ends[root]
        self.label = to[self.label]

    def rows(self, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> None:
        """Link the positions in left with those in right at RADIUS bits or fewer."""
        for lo in range(0, len(left), BLOCK):
            own = left[lo : lo + BLOCK]
            for to in range(0, len(right), BLOCK * 4):
                other = right[to : to + BLOCK * 4]
                p, q = np.nonzero(np.bitwise_count(x[own][:, None] ^ x[other][None, :]) <= RADIUS)
                self.join(own[p], other[q])


def link_group(x: np.ndarray, links: Links, group: np.ndarray) -> None:
    """Exact links among the positions in group by vantage-point splits."""
    todo = [group]
    while todo:
        part = todo.pop()
        if len(part) > 2 * BLOCK:
            gaps = np.bitwise_count(x[part] ^ x[part[len(part) // 2]]).astype(np.int64)
            radius = int(np.median(gaps))
            near = gaps <= radius
            if near.any() and not near.all():
                todo += [part[near], part[~near]]
                links.rows(part[near & (gaps > radius - RADIUS)], part[~near & (gaps <= radius + RADIUS)], x)
                continue
        links.rows(part, part, x)


def link_leaf(x: np.ndarray, value: np.ndarray, links: Links, residents: np.ndarray, visitors: np.ndarray) -> None:
    """Exact links of residents among each other and with visitors whose half is within REACH."""
    todo = [(residents, visitors)]
    while todo:
        own, guests = todo.pop()
        found = choose_vantage(value[own]) if len(own) > BLOCK else None
        if not found:
            link_group(x, links, own)
            links.rows(guests, own, x)
            continue
        gap, far = (np.bitwise_count(value[p] ^ np.uint32(found[0])).astype(np.int64) for p in (own, guests))
        radius = found[1]
        # residents beside the boundary visit the left side; that covers both directions
        todo.append((own[gap <= radius], np.concatenate((guests[far <= radius + REACH], own[(gap > radius) & (gap <= radius + REACH)]))))
        todo.append((own[gap > radius], guests[far > radius - REACH]))


def shard_links(table: pa.Table) -> pa.Table:
    """Star links of one shard."""
    fp, rep = table.column("fp").to_numpy().view(np.uint64), table.column("rep").to_numpy()
    lives = table.column("lives").combine_chunks().to_numpy(zero_copy_only=False)
    order = np.argsort(rep, kind="stable")
    fp, rep, lives = fp[order], rep[order], lives[order]
    links = Links(len(rep))
    link_leaf(fp, half(fp, table.column("band")[0].as_py()), links, np.flatnonzero(lives), np.flatnonzero(~lives))
    moved = np.flatnonzero(links.label != np.arange(len(rep)))
    return pa.table({"a": pa.array(rep[moved], pa.int64()), "b": pa.array(rep[links.label[moved]], pa.int64())})


def near_links(classes: DataFrame) -> DataFrame:
    """Star links (a, b) between the rep of classes (fp, rep) that are close."""
    sample = np.array([r[0] for r in classes.orderBy(F.xxhash64("fp")).limit(SAMPLE).select("fp").collect()], np.int64).view(np.uint64)
    leaves, n = 1, classes.count()
    while leaves < LEAVES and leaves * LEAF_ROWS < n:
        leaves *= 2
    trees = [build_tree(half(sample, b), leaves) for b in range(BANDS)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rep = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "rep"))
            for b in range(BANDS):
                who, leaf, lives = find_leaves(trees[b], half(fp.view(np.uint64), b))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp[who]), pa.array(rep[who]), pa.array(np.full(len(who), b, np.int32)), pa.array(leaf), pa.array(lives)],
                    names=["fp", "rep", "band", "leaf", "lives"],
                )

    dealt = classes.select("fp", "rep").mapInArrow(deal, "fp long, rep long, band int, leaf long, lives boolean")
    return dealt.groupBy("band", "leaf").applyInArrow(lambda t: shard_links(t), "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) of every document."""
    prints = materialize(fingerprints(docs), "simhash")
    classes = materialize(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    found = connected_components(near_links(classes))
    named = classes.join(found, classes.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs without near-duplicates of an earlier document. A null
    doc_id can't be compared and is kept."""
    gone = near_duplicates(docs.where("doc_id is not null")).where("doc_id != component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*quoted(docs.columns))
