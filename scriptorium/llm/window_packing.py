"""Order-preserving packing of token sequences by dynamic programming over window cuts.

The documents of a partition, in their order, are one stream of tokens, each document closed by an end mark.  A window is a
sequence of at most ``capacity`` tokens, cut at the end of a document (free), at the end of a sentence (``SENTENCE``) or, only
inside long stretches without a sentence end, between two other tokens (``HARD``).  A window is padded to the capacity unless its
fill is a power of two.  The cuts chosen have the least padding plus penalties: for cuts at places p,

    cost(j) = penalty(j) + min(cost(i) + capacity - (p[j] - p[i]))    over p[j] - p[i] <= capacity
    cost(j) = penalty(j) + cost(i)                                    where p[j] - p[i] is a power of two

The first minimum is that of ``cost(i) + p[i]`` over a sliding window, so a monotone queue gives it in constant time; the
places of the second are found for all cuts at once.  What remains at the end of a partition may also be cut into
powers of two.

Every task packs its own rows as they come, in spans of bounded size, and hands the last windows of a span on to the next: no
shuffle, no table between, and a lost executor repeats its own partitions alone.  Only the last window of a partition pays for its
end.  A document is held whole, as ids.

Defined results: a null text is an empty one, which is the end mark alone; repeated rows are packed each for itself; an empty
table gives no rows; of equal costs the longer window is taken.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, END_ID = 4096, 2
#: What a cut costs, in tokens of padding.
SENTENCE, HARD = 8, 64
#: Stretches longer than ``GAP`` tokens without a place to cut get hard ones, ``STRIDE`` tokens apart.
GAP, STRIDE = 256, 64
#: Tokens of a span, and texts encoded together.
SPAN, TEXTS = 1 << 18, 64
#: Chunks up to so many bytes are kept with their ids, up to so many bytes in all.
CHUNK_BYTES, CACHE_BYTES = 256, 16_000_000
MARKS, CLOSERS = ".!?…。！？", "\"')]}»”’」』"


class SentenceTokens:
    """Ids of texts, equal to those of the tokenizers library, with the places where sentences end.

    For files whose pieces never cross white space: a text is encoded by what stands between ASCII white space, each
    short chunk once.  A sentence ends with a line, or where a chunk ends in a closing mark.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallel part
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        steps = data["normalizer"] or {}
        #: ASCII capitals are chunks of their own only where the file tells them apart, or a token of its own hides in them
        self.lowers = any(n["type"] == "Lowercase" for n in steps.get("normalizers", [steps]) if n)
        self.added = [t["content"].encode().lower() for t in data["added_tokens"]]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._forget()

    def _forget(self) -> None:
        self.code: dict[bytes, int] = {}
        self.held = self.used = 0
        self.ids, self.first, self.size, self.closed = np.empty(1 << 16, "<u4"), np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64), np.empty(1 << 12, bool)

    def _learn(self, chunks: list[bytes]) -> None:
        """Enters the ids of all the chunks, encoded as one text."""
        texts = [c.decode("utf-8") for c in chunks]
        made = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        which = np.searchsorted(begins, np.array([a for a, _ in made.offsets], np.int64), "right") - 1
        size, k, n = np.bincount(which, minlength=len(chunks)), len(self.code), len(made.ids)
        while self.used + n > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        while k + len(chunks) > len(self.first):
            self.first, self.size, self.closed = (np.concatenate((x, np.empty_like(x))) for x in (self.first, self.size, self.closed))
        here = slice(k, k + len(chunks))
        self.ids[self.used : self.used + n] = made.ids
        self.first[here], self.size[here] = self.used + np.cumsum(size) - size, size
        self.closed[here] = [bool(end := t.rstrip(CLOSERS)) and end[-1] in MARKS for t in texts]
        self.code.update(zip(chunks, range(k, k + len(chunks)), strict=True))
        self.used += n
        self.held += sum(map(len, chunks))

    def _long(self, chunk: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a long chunk, and where its sentences end."""
        text = chunk.decode("utf-8")
        made = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(made.ids, "<u4"), np.array([k for k, (_, b) in enumerate(made.offsets, 1) if b and text[b - 1] in MARKS], np.int64)

    def _short(self, codes: list[int], closes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known chunks, and where their sentences end; ``closes`` are the numbers of chunks that end a line."""
        which = np.array(codes, np.int64)
        size = self.size[which]
        after = np.cumsum(size)
        closed = self.closed[which]
        closed[closes] = True
        ends = after[closed]
        places = np.repeat(self.first[which] - after + size, size) + np.arange(after[-1] if len(after) else 0)
        return self.ids[places], ends[np.diff(ends, prepend=0) > 0]  # a chunk may have no ids

    def _joined(self, chunks: list[bytes], codes: list[int | None], closes: list[int], long: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_short``, with the long chunks at the places ``long``."""
        ids, ends, total, begin = [], [], 0, 0
        for stop in [*long, len(codes)]:
            made = [self._short(codes[begin:stop], [k - begin for k in closes if begin <= k < stop])] + ([self._long(chunks[stop])] if stop < len(codes) else [])
            for part, places in made:
                ids.append(part)
                ends.append(places + total)
                total += len(part)
            begin = stop + 1
        return np.concatenate(ids), np.unique(np.concatenate(ends))

    def cut(self, text: str) -> tuple[list[bytes], list[int]]:
        """The chunks of a text, and the numbers of those that end a line."""
        raw = text.encode("utf-8")
        if self.lowers and not any(t in (low := raw.lower()) for t in self.added):
            raw = low
        chunks: list[bytes] = []
        closes = []
        for line in raw.split(b"\n"):
            if part := line.split():
                chunks += part
                closes.append(len(chunks) - 1)
        return chunks, closes

    def encode_all(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text, and the numbers of tokens before each sentence's end; what none has seen yet is encoded together."""
        if self.held > CACHE_BYTES:
            self._forget()
        made = []
        new: dict[bytes, None] = {}
        get = self.code.get
        for text in texts:
            chunks, closes = self.cut(text)
            codes = [*map(get, chunks)]
            open_ = [k for k, c in enumerate(codes) if c is None] if None in codes else []
            new.update(dict.fromkeys(chunks[k] for k in open_))
            made.append((chunks, codes, closes, open_))
        if short := [c for c in new if len(c) <= CHUNK_BYTES]:
            self._learn(short)
        for chunks, codes, closes, open_ in made:
            for k in open_:
                codes[k] = get(chunks[k])
            long = [k for k in open_ if codes[k] is None]
            yield self._joined(chunks, codes, closes, long) if long else self._short(codes, closes)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_all``, for one text."""
        return next(self.encode_all([text]))


@lru_cache(maxsize=2)
def sentence_tokens(path: str) -> SentenceTokens:
    """One encoder per worker and file."""
    return SentenceTokens(path)


def cut_places(total: int, sentences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places after 0 where a document of ``total`` tokens may be cut, its end included, and their penalties."""
    inside = sentences[(sentences > 0) & (sentences < total - 1)]  # the end mark is not parted from the last sentence
    places = np.concatenate((inside, [total]))
    penalties = np.full(len(places), SENTENCE, np.int64)
    penalties[-1] = 0
    before = np.concatenate(([0], places[:-1]))
    wide = np.flatnonzero(places - before > GAP)
    if len(wide):
        hard = np.concatenate([np.arange(before[k] + STRIDE, places[k], STRIDE) for k in wide])
        places = np.concatenate((places, hard))
        penalties = np.concatenate((penalties, np.full(len(hard), HARD, np.int64)))
        order = np.argsort(places, kind="stable")
        places, penalties = places[order], penalties[order]
    return places, penalties


def window_cost(fill: int, capacity: int) -> int:
    """Padding of a window."""
    return 0 if fill & (fill - 1) == 0 else capacity - fill


def choose_cuts(places: np.ndarray, penalties: np.ndarray, capacity: int, last: bool) -> list[int]:
    """The places cut, from the first to the last of ``places``, at least cost; ``last`` if nothing follows."""
    m = len(places)
    joined: list[list[int]] = [[] for _ in range(m)]
    power = 1 << (capacity.bit_length() - 1)
    while power:
        at = np.searchsorted(places, places - power)
        hits = np.flatnonzero(places[at] == places - power)
        for j, i in zip(hits.tolist(), at[hits].tolist(), strict=True):
            joined[j].append(i)
        power >>= 1
    where, price = places.tolist(), penalties.tolist()
    cost, origin = [0] * m, [0] * m
    queue: deque[tuple[int, int]] = deque([(where[0], 0)])  # (cost + place, cut), rising in both
    for j in range(1, m):
        place = where[j]
        while where[queue[0][1]] < place - capacity:
            queue.popleft()
        least, i = queue[0]
        least += capacity - place
        for k in joined[j]:
            if cost[k] < least or cost[k] == least and k < i:
                least, i = cost[k], k
        cost[j], origin[j] = least + price[j], i
        key = cost[j] + place
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], m - 1
    if last:
        # the end may also be cut into powers of two
        least, i, split = cost[j], origin[j], False
        for k in range(j - 1, -1, -1):
            fill = where[j] - where[k]
            if fill > capacity:
                break
            if (by_powers := cost[k] + HARD * (fill.bit_count() - 1)) < least:
                least, i, split = by_powers, k, True
        if split:
            at, parts = where[j], where[j] - where[i]
            while parts & (parts - 1):
                part = parts & -parts
                cuts.append(at)
                at, parts = at - part, parts - part
            cuts.append(at)
            j = i
    while j:
        cuts.append(where[j])
        j = origin[j]
    return [where[0], *reversed(cuts)]


class Packer:
    """Windows over a stream of documents, span by span."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.docs: deque[tuple] = deque()  # (key, ids, place of its first token, tokens)
        self.places: list[np.ndarray] = []
        self.penalties: list[np.ndarray] = []
        self.start = self.end = 0  # of what is not packed yet

    def add(self, key, ids: np.ndarray, sentences: np.ndarray) -> None:
        total = len(ids)
        places, penalties = cut_places(total, sentences)
        self.docs.append((key, ids, self.end, total))
        self.places.append(places + self.end)
        self.penalties.append(penalties)
        self.end += total

    def windows(self, last: bool) -> Iterator[list[tuple]]:
        """The pieces (key, ids, start, length, document's tokens) of each window; all but the last two windows' worth unless ``last``."""
        if not self.docs:
            return
        places, penalties = np.concatenate([[self.start], *self.places]), np.concatenate([[0], *self.penalties])
        cuts = choose_cuts(places, penalties, self.capacity, last)
        if not last:
            cuts = [c for c in cuts if c <= self.end - 2 * self.capacity]
        for a, b in zip(cuts, cuts[1:]):
            pieces = []
            while a < b:
                key, ids, at, total = self.docs[0]
                upto = min(b, at + total)
                pieces.append((key, ids[a - at : upto - at], a - at, upto - a, total))
                if upto == at + total:
                    self.docs.popleft()
                a = upto
            self.start = b
            yield pieces
        left = places > self.start
        self.places, self.penalties = [places[left]], [penalties[left]]


PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint"


def pack_windows(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, span: int = SPAN) -> DataFrame:
    """One row per piece of every document: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids`` if asked for."""
    end = np.array([end_id], "<u4")
    rows = docs.select(F.col(key).alias(key), F.col(text).alias("__scr_text"))
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, {PIECES}" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = sentence_tokens(path), Packer(capacity)
        first, number = TaskContext.get().partitionId() << 33, 0
        kind = None

        def made(last: bool) -> pa.RecordBatch:
            nonlocal number
            out = []
            for pieces in packer.windows(last):
                at = 0
                for name, ids, start, length, total in pieces:
                    out.append((name, start, length, zlib.crc32(ids), total, first + number, at, ids if with_ids else None))
                    at += length
                number += 1
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            kinds = [kind, *[pa.int64()] * 6, pa.list_(pa.int32())]
            shown = range(len(names) if with_ids else len(names) - 1)
            return pa.RecordBatch.from_arrays([pa.array(columns[k], kinds[k]) for k in shown], names=[names[k] for k in shown])

        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                found = tokens.encode_all([t or "" for t in part.column(1).to_pylist()])
                for name, (ids, sentences) in zip(part.column(0).to_pylist(), found, strict=True):
                    packer.add(name, np.concatenate((ids, end)), sentences)
                    if packer.end - packer.start >= span:
                        yield made(False)
        if kind is not None:
            yield made(True)

    return rows.mapInArrow(run, schema)
