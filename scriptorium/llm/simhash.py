"""SimHash near-duplicates by bit-sliced comparison.

Each text gets a fingerprint: bit i is set if it is set in more than half of the hashes of its
word shingles.  Fingerprints are compared within blocks.  A block stores bit planes vertically: plane i
holds bit i of all its fingerprints.  For a fingerprint that is looked up, each plane is flipped
where its bit is set and then added to vertical carry-save counters, which updates the
distances to all fingerprints of the block at once.  The counters overflow beyond the radius;
a fingerprint abandons a block once all of them have, and the block ends when all have abandoned it.

Blocks come from exact keys.  With ``bands``, two fingerprints within radius r agree on one of
r + 1 bands, and on the other bits on one of r + 1 bands again, so each of the (r + 1)^2
combined keys is a block and no pair is lost.  With ``minima``, keys are minimum hashes of
the shingles, for radii too wide for bands.  Equal fingerprints are one node.  A key with
more than ``chunk_rows`` nodes is dealt out as pairs of chunks, so no task holds a whole hot
key.  A task links what it finds by union-find and emits at most one link per node, never all
pairs, and skips blocks that are already one component; reachability is as if all pairs were emitted.

``keep_first`` uses fingerprints only to find candidates, within a radius far beyond the one to expect.  The texts of
each candidate group then meet once more, and a link counts only if the Jaccard similarity of the two shingle sets
(as sets of 64-bit hashes) is reached.

Defined results: texts without a word have the fingerprint zero, and link like any other; null
texts are empty; repeated rows share a component; a null id is never the least id of a
component unless all its ids are null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType, arrow_udf

from ..staging import stage
from .common import OWN, join_salted, small_batches
from .components import components

SEED = 42
BLOCK, CHUNK_ROWS = 512, 16_384
#: Characters of a candidate group that one chunk holds, and bytes that a task gathers before it compares.
CHUNK_CHARS, HELD_BYTES = 8_000_000, 32_000_000


def shingle_hashes(text: str, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``words`` words (fewer words: of all), A-Z in lower case."""
    own = text.encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.empty(0, np.uint64)
    runs = zip(*(own[i:] for i in range(words)), strict=False) if len(own) >= words else [own]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(r), seed) for r in runs], np.uint64)


def _spread(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th family of hashes; the first is the hashes themselves."""
    if k == 0:
        return hashes
    with np.errstate(over="ignore"):
        h = hashes + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(hashes: np.ndarray, words64: int = 1) -> bytes:
    """``words64`` big-endian 64-bit words of majority bits; zero without hashes."""
    n, out = len(hashes), []
    for k in range(words64):
        counts = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 16):
            part = np.ascontiguousarray(_spread(hashes[at : at + (1 << 16)], k).astype("<u8"))
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(np.packbits((2 * counts > n)[::-1]).tobytes())
    return b"".join(out)


def minima(hashes: np.ndarray, count: int) -> list[int]:
    """Minimum hashes of independent families, as signed longs."""
    if not len(hashes) or not count:
        return []
    return [int(_spread(hashes, 1000 + k).min().view(np.int64)) for k in range(count)]


def fingerprint_column(text: Column, words: int = 3, words64: int = 1, n_minima: int = 0) -> Column:
    """Struct of the fingerprint's bytes and its minimum hashes (null text: as empty)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            marks, keys = [], []
            for t in batch.to_pylist():
                h = shingle_hashes(t or "", words)
                marks.append(fingerprint(h, words64))
                keys.append(minima(h, n_minima))
            yield pa.StructArray.from_arrays([pa.array(marks, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["bits", "minima"])

    return arrow_udf(run, "bits binary, minima array<bigint>", ArrowUDFType.SCALAR_ITER)(text)


def set_column(text: Column, words: int, words64: int, n_minima: int) -> Column:
    """Struct of ``node``, a hash of the set of shingles, and the fingerprint and minimum hashes of that set."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            nodes, marks, keys = [], [], []
            for t in batch.to_pylist():
                h = np.unique(shingle_hashes(t or "", words))
                nodes.append(xxhash.xxh64_intdigest(h.astype("<u8").tobytes(), SEED) - (1 << 63))
                marks.append(fingerprint(h, words64))
                keys.append(minima(h, n_minima))
            yield pa.StructArray.from_arrays([pa.array(nodes, pa.int64()), pa.array(marks, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["node", "bits", "minima"])

    return arrow_udf(run, "node bigint, bits binary, minima array<bigint>", ArrowUDFType.SCALAR_ITER)(text)


def alike(texts: list[str], words: int, similarity: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """Whether text i has at least this Jaccard similarity of shingle sets with each of some others."""
    sets: dict[int, np.ndarray] = {}

    def of(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = np.unique(shingle_hashes(texts[i] or "", words))
        return sets[i]

    def test(i: int, others: np.ndarray) -> np.ndarray:
        own, more = of(i), [of(int(j)) for j in others]
        if not len(own):
            return np.array([not len(x) for x in more])
        sizes = np.array([len(x) for x in more])
        flat = np.concatenate(more)
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        shared = np.bincount(np.repeat(np.arange(len(more)), sizes), hit, len(more))
        return shared + 1e-9 >= similarity * (len(own) + sizes - shared)

    return test


# --- bit-sliced comparison -------------------------------------------------------------------


def planes_of(marks: np.ndarray) -> np.ndarray:
    """Bit planes (bits x lanes / 64) of fingerprints given as rows of bytes; lanes are padded with zeros."""
    bits = np.unpackbits(marks, axis=1, bitorder="little").T
    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


def within(queries: np.ndarray, planes: np.ndarray, lanes: int, radius: int) -> np.ndarray | None:
    """Which lanes are within the radius of which queries (queries x lanes); None if the block is abandoned."""
    n, width = len(queries), planes.shape[1]
    flips = np.where(np.unpackbits(queries, axis=1, bitorder="little").T, ~np.uint64(0), np.uint64(0))[:, :, None]
    levels = (radius + 1).bit_length()
    begin = (1 << levels) - 1 - radius  # so that the counters overflow beyond the radius
    full = ~np.uint64(0)
    counters = [np.full((n, width), full if begin >> k & 1 else 0, np.uint64) for k in range(levels)]
    over = np.zeros((n, width), np.uint64)
    if lanes % 64:
        over[:, -1] = full << np.uint64(lanes % 64)
    live = np.arange(n)  # the queries that go on: the block is abandoned by each once all its lanes exceed the radius
    for i in range(0, len(planes), 2):
        x, y = planes[i] ^ flips[i], planes[i + 1] ^ flips[i + 1]
        # carry-save adder of the lowest counter and two planes
        half = counters[0] ^ x
        carry = (counters[0] & x) | (half & y)
        counters[0] = half ^ y
        for k in range(1, levels):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if i % 8 == 6 and i >= radius:
            left = (over != full).any(axis=1)
            if not left.any():
                return None
            if 4 * left.sum() < 3 * len(live):
                live, over, flips, counters = live[left], over[left], flips[:, left], [c[left] for c in counters]
    near = np.zeros((n, lanes), bool)
    near[live] = np.unpackbits(np.ascontiguousarray(~over).view(np.uint8), axis=1, bitorder="little")[:, :lanes]
    return near


class Union:
    """Union-find over positions with the least position as root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def roots(self, part: slice = slice(None)) -> np.ndarray:
        found = self.parent[part]
        while True:
            up = self.parent[found]
            if (up == found).all():
                return found
            found = up


def link_verified(union: Union, near: np.ndarray, a: int, b: int, test: Callable[[int, np.ndarray], np.ndarray]) -> None:
    """Joins the pairs of ``near`` (rows from a, lanes from b) that pass the test and are not yet connected."""
    for i, lanes in enumerate(near, a):
        left, size = b + np.flatnonzero(lanes), 4
        left = left[left > i]
        while len(left := left[union.roots(left) != union.find(i)]):
            part, left = left[:size], left[size:]
            for j in part[test(i, part)]:
                union.join(i, int(j))
            size *= 2


def link_groups(groups: np.ndarray, marks: np.ndarray, radius: int, test: Callable[[int, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """For rows sorted by group, the first row that each one is linked to within its group.

    With ``test``, only pairs that also pass it are links.
    """
    n = len(groups)
    union = Union(n)
    starts = range(0, n, BLOCK)
    planes: dict[int, np.ndarray] = {}
    for a in starts:
        end_a = min(a + BLOCK, n)
        for b in range(a, n, BLOCK):
            if groups[b] > groups[end_a - 1]:
                break
            end_b = min(b + BLOCK, n)
            # only rows whose group reaches into both blocks
            lo = a if a == b else a + int(np.searchsorted(groups[a:end_a], groups[b]))
            hi = end_b if a == b else b + int(np.searchsorted(groups[b:end_b], groups[end_a - 1], side="right"))
            if groups[lo] == groups[hi - 1]:
                ends = np.concatenate([union.roots(slice(lo, end_a)), union.roots(slice(b, hi))])
                if (ends == ends[0]).all():
                    continue
            if b not in planes:
                planes[b] = planes_of(marks[b:end_b])
            near = within(marks[lo:end_a], planes[b], end_b - b, radius)
            if near is None:
                continue
            near &= groups[lo:end_a, None] == groups[None, b:end_b]
            if test:
                link_verified(union, near, lo, b, test)
                continue
            left, right = union.roots(slice(lo, end_a)), union.roots(slice(b, end_b))
            was_left, was_right = left.copy(), right.copy()
            while True:  # least label through the links, until none changes
                new = np.minimum(left, np.where(near, right[None, :], n).min(1))
                other = np.minimum(right, np.where(near, new[:, None], n).min(0))
                if (new == left).all() and (other == right).all():
                    break
                left, right = new, other
            for was, now in ((was_left, left), (was_right, right)):
                for i, j in np.unique(np.stack([was, now], 1)[was != now], axis=0).tolist():
                    union.join(i, j)
        planes.pop(a, None)
    return union.roots()


def _band_keys(mark: Column, radius: int) -> list[Column]:
    """Combined keys of a 64-bit fingerprint: an outer band, and a band of the bits left over."""

    def cut(total: int) -> list[tuple[int, int]]:
        edges = [total * i // (radius + 1) for i in range(radius + 2)]
        return list(zip(edges, edges[1:], strict=False))

    def bits(value: Column, low: int, high: int) -> Column:
        return F.shiftrightunsigned(value, low).bitwiseAND((1 << (high - low)) - 1)

    keys = []
    for i, (low, high) in enumerate(cut(64)):
        below = mark.bitwiseAND((1 << low) - 1) if low else F.lit(0).cast("long")
        above = F.shiftleft(F.shiftrightunsigned(mark, high), low) if high < 64 else F.lit(0).cast("long")
        rest, outer = below.bitwiseOR(above), bits(mark, low, high)
        for j, (a, b) in enumerate(cut(64 - (high - low))):
            keys.append(F.xxhash64(F.lit(i * 64 + j), outer, bits(rest, a, b)) if radius < 3 else F.shiftleft(F.lit(i * 64 + j).cast("long"), 40).bitwiseOR(F.shiftleft(outer, 16)).bitwiseOR(bits(rest, a, b)))
    return keys


def near_links(nodes: DataFrame, radius: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Links (a, b) that connect all nodes within the radius of each other that share a key.

    ``nodes``: node long, bits binary, keys array<long>; one row per distinct fingerprint.
    """
    keyed = nodes.select("node", "bits", F.explode(F.array_distinct("keys")).alias("key"))
    hot = stage(
        keyed.groupBy("key").count().where(F.col("count") > chunk_rows).select("key", F.ceil(F.col("count") / chunk_rows).cast("int").alias("chunks")), "hot_keys"
    )
    chunks = F.coalesce("chunks", F.lit(1))
    return _links(keyed.join(hot, "key", "left").withColumn("chunks", chunks), radius)


def _links(keyed: DataFrame, radius: int, verify: tuple[int, float] | None = None) -> DataFrame:
    """Links (a, b) within each key of ``keyed`` (key, chunks, node, bits); ``verify``, words and similarity, also reads text."""
    columns = ["node", "bits"] + ["text"] * (verify is not None)
    mine = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = (
        keyed.withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), *columns)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = size = 0

        def solve(part: pa.Table) -> pa.RecordBatch:
            node = part["node"].to_numpy()
            columns = [part[c].to_numpy() for c in ("key", "lo", "hi")]
            new = np.zeros(len(node), bool)
            new[:1] = True
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            group = np.cumsum(new)
            size = np.bincount(group, minlength=group[-1] + 1 if len(group) else 1)
            own = np.flatnonzero(size[group] > 1)
            if not len(own):
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
            marks = np.frombuffer(b"".join(part["bits"].take(pa.array(own)).to_pylist()), np.uint8).reshape(len(own), -1)
            test = alike(part["text"].take(pa.array(own)).to_pylist(), *verify) if verify else None
            root = link_groups(group[own], marks, radius, test)
            linked = np.flatnonzero(root != np.arange(len(own)))
            return pa.RecordBatch.from_arrays([pa.array(node[own[linked]]), pa.array(node[own[root[linked]]])], ["a", "b"])

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= 1 << 17 or size >= HELD_BYTES:
                whole = pa.concat_tables(held).combine_chunks()
                last = [whole[c][-1].as_py() for c in ("key", "lo", "hi")]
                same = np.logical_and.reduce([whole[c].to_numpy() == x for c, x in zip(("key", "lo", "hi"), last, strict=True)])
                cut = int(np.argmax(same))  # the last group may go on
                if cut:
                    yield solve(whole.slice(0, cut))
                held = [whole.slice(cut)]
                rows, size = whole.num_rows - cut, held[0].nbytes
        if rows:
            yield solve(pa.concat_tables(held).combine_chunks())

    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node").mapInArrow(run, "a bigint, b bigint")


def near_components(marked: DataFrame, radius: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(node, n, component_id) of each distinct fingerprint of ``marked`` (doc_id, bits, of 64 bits, stored).

    ``n`` documents have the fingerprint; ``component_id`` is the least id of its component.  No pair within the radius is lost.
    """
    node = _number("bits").alias("node")
    nodes = stage(marked.select(node, "bits", "doc_id").groupBy("node").agg(F.min("bits").alias("bits"), F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = components(near_links(nodes.select("node", "bits", F.array(*_band_keys(F.col("node"), radius)).alias("keys")), radius, chunk_rows))
    rooted = stage(nodes.join(roots, "node", "left").select("node", "least", "n", F.coalesce("root", "node").alias("root")), "rooted")
    least = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "least")
    return join_salted(rooted.select("node", "n", "root"), least, ["root"], "members", F.col("node")).select("node", "n", "component_id")


def _number(bits: str) -> Column:
    """A fingerprint of 64 bits as a long."""
    return F.conv(F.hex(bits), 16, -10).cast("long")


def radius_of(similarity: float, bits: int, margin: float = 6.0) -> int:
    """Differing bits to expect of two shingle sets of this Jaccard similarity, and ``margin`` standard deviations more."""
    share = np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi
    return int(round(bits * share + margin * np.sqrt(bits * share * (1 - share))))


def verified_links(candidates: DataFrame, docs: DataFrame, radius: int, words: int, similarity: float) -> DataFrame:
    """Links (a, b) that connect all pairs of one candidate group within the radius whose shingle sets are alike.

    ``candidates``: key (the group), node, bits, chars, row; ``docs``: row, text.  A group's texts are shuffled once;
    one with more characters than a chunk holds is dealt out as pairs of chunks.
    """
    size = candidates.groupBy("key").agg(F.ceil(F.sum("chars") / CHUNK_CHARS).cast("int").alias("chunks"))
    size = stage(size.where("chunks > 1"), "large_groups")
    wanted = candidates.join(size, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    # repeated rows have equal texts; one stays
    found = wanted.join(docs, "row").groupBy("key", "chunks", "node", "bits").agg(F.min("text").alias("text"))
    return _links(found, radius, (words, similarity))


def keep_first(docs: DataFrame, words: int = 5, similarity: float = 0.8, words64: int = 8, n_minima: int = 8) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one of least id (null ids last).

    Groups are components of the pairs whose sets of word shingles have this Jaccard similarity.  Candidates are
    fingerprints of ``64 * words64`` bits within six standard deviations of the distance that the similarity implies, in
    blocks of equal minimum hashes: with a similarity of 0.8, eight minima all differ with a probability below
    3e-6.  Candidates are then verified on their shingles.  Rows equal in id and text are one document.
    """
    # texts of one id only could collide
    key, radius = F.concat_ws(":", "doc_id", F.xxhash64("text")), radius_of(similarity, 64 * words64)
    marked = docs.select("doc_id", key.alias("row"), F.length("text").alias("chars"), set_column(F.col("text"), words, words64, n_minima).alias(OWN + "f"))
    with small_batches(docs.sparkSession):
        marked = stage(marked.select("doc_id", "row", "chars", OWN + "f.*"), "fingerprints")
    # equal sets are one node, of which the first document stands for all
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "chars"))
    nodes = stage(marked.groupBy("node").agg(F.min("bits").alias("bits"), F.min("minima").alias("minima"), first.alias("first")), "nodes")
    keys = F.transform("minima", lambda k, i: F.xxhash64(i, k))
    near = components(near_links(nodes.select("node", "bits", keys.alias("keys")), radius))
    candidates = stage(nodes.join(near, "node").select(F.col("root").alias("key"), "node", "bits", "first.chars", "first.row"), "candidates")
    roots = components(verified_links(candidates, docs.select(key.alias("row"), "text"), radius, words, similarity))
    found = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    kept = stage(found.select(F.col("first.row").alias(OWN + "row")).distinct(), "kept")
    own = docs.withColumn(OWN + "row", key).join(kept, OWN + "row", "left_semi")
    return own.dropDuplicates([OWN + "row"]).select(docs.columns)


def fingerprint_components(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """One row per document: its fingerprint and the least id of its component."""
    with small_batches(docs.sparkSession):
        marked = stage(docs.select("doc_id", fingerprint_column(F.col("text"), words).alias(OWN + "f")).select("doc_id", OWN + "f.bits"), "fingerprints")
    named = stage(near_components(marked, radius), "components")
    found = join_salted(marked.withColumn("node", _number("bits")), named, ["node"], "n", F.col("doc_id"))
    return found.select("doc_id", F.lower(F.hex("bits")).alias("fingerprint"), "component_id")
