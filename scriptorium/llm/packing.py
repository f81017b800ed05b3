"""Best-fit packing of token sequences, improved by swap-based local search.

Documents become token ids and an end mark; those longer than a sequence are cut into pieces
of exactly the capacity, where the first piece takes the rest.  Full pieces fill a sequence
alone.  The others are dealt by row number to buckets of bounded size, and each bucket is packed by
best fit in falling order and then improved: underfull sequences, the emptiest first, give their members away by
moves, one-for-one and two-for-one exchanges with other underfull sequences, each of which increases
the sum of squared fills, until they are empty or no exchange between any two is left.

Only (document, piece, length) rows are shuffled, never texts.  Tokens are computed once and
written to the shared folder, so a lost executor re-reads them and repeats one bucket.

Defined results: a null text is an empty one, which is the end mark alone; repeated rows are
packed each for itself; an empty table gives no rows.  Ties go to the earlier row of a bucket.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType, arrow_udf

from ..staging import stage
from .bpe import byte_letters
from .common import OWN, small_batches

CAPACITY, END_ID = 1024, 2
BUCKET_ROWS = 20_000
#: Fixed value of byte-level vocabularies of this kind: how a text is cut before merging.
MARKS, RUNS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+", r"\s+(?!\S)"


class ByteTokens:
    """Ids of texts, equal to those of the tokenizers library, as little-endian 32-bit bytes.

    Texts are cut by the file's pattern and merged by the file's ranks.  The pattern looks ahead only to
    treat runs of white space, so texts without such a run are cut by the pattern without that part,
    which takes half the time.  Texts with added tokens are encoded by the library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = {letter: byte for byte, letter in enumerate(byte_letters())}
        ranks = {bytes(map(letters.__getitem__, token)): i for token, i in data["model"]["vocab"].items()}
        self.whole = tiktoken.Encoding("whole", pat_str=f"{MARKS}|{RUNS}|\\s+", mergeable_ranks=ranks, special_tokens={})
        self.plain = tiktoken.Encoding("plain", pat_str=f"{MARKS}|\\s+", mergeable_ranks=ranks, special_tokens={})
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t["content"] for t in data["added_tokens"]]
        self.run = re.compile(r"\s\s")

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = (self.whole if self.run.search(text) else self.plain).encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def byte_tokens(path: str) -> ByteTokens:
    """One encoder per worker and file."""
    return ByteTokens(path)


PIECE = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut_pieces(ids: bytes, capacity: int) -> list[dict]:
    """Pieces of at most ``capacity`` ids; only the first may be shorter."""
    n = len(ids) // 4
    first = n if n <= capacity else (n % capacity or capacity)
    bounds = [(0, first), *((at, at + capacity) for at in range(first, n, capacity))]
    return [{"piece": k, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[4 * a : 4 * b])} for k, (a, b) in enumerate(bounds)]


def pieces_column(text: Column, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> Column:
    """Array of pieces for each text (null: empty)."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = byte_tokens(path)
        for batch in batches:
            yield pa.array([cut_pieces(tokens.encode(t or "") + end, capacity) for t in batch.to_pylist()], pa.list_(PIECE))

    return arrow_udf(run, "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>", ArrowUDFType.SCALAR_ITER)(text)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items of each bin, packed by best fit in falling order of size."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # the rooms that some bin has, in order
    for i in order:
        at = bisect_left(rooms, sizes[i])
        if at == len(rooms):
            bins.append([i])
            which, room = len(bins) - 1, capacity - sizes[i]
        else:
            old = rooms[at]
            which = by_room[old].pop()
            if not by_room[old]:
                rooms.pop(at)
            bins[which].append(i)
            room = old - sizes[i]
        if not by_room[room]:
            insort(rooms, room)
        by_room[room].append(which)
    return bins


class LocalSearch:
    """Drains underfull bins by exchanges that each increase the sum of squared fills.

    Any underfull bin may be a source, the emptiest first, and any other one a target.  An item of the source goes to a target
    that gives back nothing (a move), one item, or two.  ``offers`` has, for each weight that could come
    back, the bins that could give it, in order of room; the target is the fullest one that holds the gain.
    Each exchange raises the sum of squares, so the search ends; it does so when no exchange is left between any two
    bins, or when the rooms together are below a whole bin, which no packing can improve.
    """

    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int):
        self.sizes, self.bins, self.capacity = sizes, bins, capacity
        self.room = [capacity - sum(sizes[i] for i in b) for b in bins]
        self.offers: list[list[tuple[int, int, int, int]]] = [[] for _ in range(capacity + 1)]
        self.most = np.full(capacity + 1, -1)  # the most room of the bins under each weight
        self.listed: list[list[int]] = [[] for _ in bins]
        for b in range(len(bins)):
            self._list(b)

    def _list(self, b: int) -> None:
        if self.room[b] <= 0:
            return
        items, mine = self.bins[b], {0: (-1, -1)}
        for i in items:
            mine.setdefault(self.sizes[i], (i, -1))
        for k, i in enumerate(items):
            for j in items[k + 1 :]:
                mine.setdefault(self.sizes[i] + self.sizes[j], (i, j))
        self.listed[b] = list(mine)
        for weight, (i, j) in mine.items():
            insort(self.offers[weight], (self.room[b], b, i, j))
            self.most[weight] = max(self.most[weight], self.room[b])

    def _unlist(self, b: int) -> None:
        for weight in self.listed[b]:
            row = self.offers[weight]
            del row[bisect_left(row, (self.room[b], b))]
            self.most[weight] = row[-1][0] if row else -1
        self.listed[b] = []

    def _exchange(self, source: int) -> bool:
        """One move or exchange, if there is one: the largest item first, with the greatest gain it has."""
        room = self.room[source]
        for x in sorted(self.bins[source], key=lambda i: (-self.sizes[i], i)):
            size = self.sizes[x]
            for weight in np.flatnonzero(self.most[:size] + np.arange(size) >= size).tolist():
                gain, row = size - weight, self.offers[weight]
                left, target, i, j = row[bisect_left(row, (gain,))]
                if left >= room + gain:
                    continue  # squares would not grow
                self._unlist(target)
                back = [k for k in (i, j) if k >= 0]
                self.bins[source].remove(x)
                self.bins[source] += back
                self.bins[target] = [k for k in self.bins[target] if k not in back] + [x]
                self.room[source] += gain
                self.room[target] -= gain
                self._list(target)
                return True
        return False

    def run(self) -> list[list[int]]:
        free, going = sum(self.room), True
        while going and free >= self.capacity:
            going = False
            order = sorted((b for b in range(len(self.bins)) if self.bins[b] and self.room[b]), key=lambda b: (-self.room[b], b))
            for source in order:
                if free < self.capacity:
                    break
                self._unlist(source)  # no offers to itself
                while self.bins[source] and self._exchange(source):
                    going = True
                if self.bins[source]:
                    self._list(source)
                else:
                    free -= self.capacity
        return [b for b in self.bins if b]


def local_search(sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """The bins after swap-based local search."""
    return LocalSearch(sizes, [list(b) for b in bins], capacity).run()


def pack_bucket(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin number, offset) of each item."""
    bins = local_search(sizes, best_fit(sizes, capacity), capacity)
    number, offset = [0] * len(sizes), [0] * len(sizes)
    for k, items in enumerate(bins):
        at = 0
        for i in items:
            number[i], offset[i] = k, at
            at += sizes[i]
    return number, offset


def pack(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per piece of every document: key, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = docs.select(F.col(key).alias(key), pieces_column(F.col(text), path, capacity, end_id).alias(OWN + "p"))
    with small_batches(docs.sparkSession):
        rows = stage(cut.select(key, F.inline(OWN + "p")).withColumn(OWN + "row", F.monotonically_increasing_id()), "pieces")
    full = F.col("length") == capacity
    loose = rows.where(~full)
    buckets = max(1, -(-loose.count() // bucket_rows))
    bucket = F.pmod(F.xxhash64(OWN + "row"), F.lit(buckets)).cast("long")
    schema = loose.withColumn(OWN + "b", bucket).schema.add("sequence_id", "long").add("offset", "long")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by(OWN + "row")
        number, offset = pack_bucket(group["length"].to_pylist(), capacity)
        first = group[OWN + "b"][0].as_py() << 32
        return group.append_column("sequence_id", pa.array([first + n for n in number], pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    packed = loose.withColumn(OWN + "b", bucket).groupBy(OWN + "b").applyInArrow(run, schema)
    columns = [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    # full pieces: numbers below zero, which no bucket has
    alone = rows.where(full).withColumn("sequence_id", -1 - F.col(OWN + "row")).withColumn("offset", F.lit(0).cast("long"))
    return packed.select(columns).unionByName(alone.select(columns))
