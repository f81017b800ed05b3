"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A word is a row of symbols.  Leaf i of the tree holds the rank of the merge of symbol i with
the next live symbol, or a rank beyond all merges; an inner node holds its lesser child's
(rank, position), so the root is the leftmost merge of lowest rank.  A merge changes at most
three leaves, each in logarithmic time.  Merging ends when the root holds no merge.  Words of
about one length have trees of one size; these stand below each other as rows of one array, and
each step makes one merge in every row.

Text is normalised and split as the tokenizer file says (NFC, white space to one space,
lower case; contractions, letter runs, single digits, runs of other marks).  Texts go through
in groups; the different stretches between spaces of a group are encoded once, and each worker
keeps the ids of those it has met.

Defined results: null and empty texts have no tokens.  All work is per row: no shuffle, and
memory is one Arrow batch, a group of texts and a bounded word cache.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType, arrow_udf

from .common import annotate

NO_MERGE = 1 << 40  # above any rank << 17 | symbol
#: Characters of the stretches between spaces a worker keeps in each of two generations; longer ones are not kept.
CACHE_CHARS, KEPT_CHARS = 1_200_000, 64
#: Characters of texts encoded together; leaves of trees merged together; with fewer rows, words are merged one by one.
GROUP_CHARS, LEAVES, MIN_ROWS = 4_000_000, 1 << 16, 16
#: Symbol before the first and after the last of a row, and a hash multiplier.
EDGE, MULTIPLIER = 0x1FFFF, np.uint64(0x9E3779B97F4A7C15)
#: Fixed values of the file format: white space as its expressions see it, and its split pattern.
SPACE = r"\t\n\v\f\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACE + r"\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


def merge_word(symbols: list[int], merges: dict[int, int]) -> list[int]:
    """The symbols after all merges; ``merges`` has ``rank << 17 | merged`` for each ``left << 17 | right``."""
    n = len(symbols)
    if n < 2:
        return symbols
    get = merges.get
    bits = (n - 2).bit_length() if n > 2 else 0
    size = 1 << bits
    # a leaf is (rank, merged, position) in one number, so the lesser leaf is the lesser rank, then the leftmost
    none = NO_MERGE << bits
    tree = [none] * (2 * size)
    left = symbols[0]
    for i in range(1, n):
        right = symbols[i]
        if found := get(left << 17 | right):
            tree[size + i - 1] = found << bits | i - 1
        left = right
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    if tree[1] >= none:
        return symbols
    following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
    symbols = list(symbols)
    mask = size - 1
    while (root := tree[1]) < none:
        i = root & mask
        merged = root >> bits & 0x1FFFF
        j = following[i]
        following[i] = after = following[j]
        symbols[i], symbols[j] = merged, -1
        # three leaves change at most; a last symbol has no leaf
        x, y, z = size + i, size + (j if j < n - 1 else i), size + i
        tree[y] = none
        if after < n:
            previous[after] = i
            found = get(merged << 17 | symbols[after])
            tree[x] = found << bits | i if found else none
        else:
            tree[x] = none
        before = previous[i]
        if before >= 0:
            z = size + before
            found = get(symbols[before] << 17 | merged)
            tree[z] = found << bits | before if found else none
        x >>= 1
        y >>= 1
        z >>= 1
        while x:  # up to the root, each node once
            a, b = tree[2 * x], tree[2 * x + 1]
            tree[x] = a if a < b else b
            if y != x:
                a, b = tree[2 * y], tree[2 * y + 1]
                tree[y] = a if a < b else b
            if z != x and z != y:
                a, b = tree[2 * z], tree[2 * z + 1]
                tree[z] = a if a < b else b
            x >>= 1
            y >>= 1
            z >>= 1
    return [s for s in symbols if s >= 0]


class PairTable:
    """Merges of many pairs at once: a hash table with open addresses, in arrays."""

    def __init__(self, merges: dict[int, int]):
        bits = (4 * len(merges)).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.pairs, self.found = np.full(1 << bits, -1), np.full(1 << bits, NO_MERGE)
        pairs = np.fromiter(merges, np.int64, len(merges))
        for pair, place in zip(pairs.tolist(), self._places(pairs).tolist(), strict=True):
            while self.pairs[place] >= 0:
                place = place + 1 & self.mask
            self.pairs[place], self.found[place] = pair, merges[pair]

    def _places(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.view(np.uint64) * MULTIPLIER >> self.shift).view(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``rank << 17 | merged`` of each pair, ``NO_MERGE`` for those without."""
        pairs = left << 17 | right
        places = self._places(pairs)
        there = self.pairs[places]
        others = np.flatnonzero((there != pairs) & (there >= 0))
        while len(others):
            places[others] = at = places[others] + 1 & self.mask
            there = self.pairs[at]
            others = others[(there != pairs[others]) & (there >= 0)]
        return self.found[places]


def merge_rows(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of many words after all merges, end to end, and how many each word has.

    ``symbols`` has a row for each word, which starts in column 1; all other cells are ``EDGE``.  The number
    of columns is a power of two and one.  Every row has its own tree, with a leaf for each column but the last.
    """
    n_rows, width = symbols.shape
    size = width - 1
    bits = size.bit_length() - 1
    none = NO_MERGE << bits
    tree = np.empty((n_rows, 2 * size), np.int64)
    tree[:, 0] = none
    found = table.get(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()) << bits
    tree[:, size:] = found.reshape(n_rows, size) | np.arange(size)
    low = size
    while low > 1:
        np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2], out=tree[:, low // 2 : low])
        low //= 2
    following = np.tile(np.arange(1, width + 1), n_rows)
    previous = np.tile(np.arange(-1, width - 1), n_rows)
    cells, nodes, roots = symbols.reshape(-1), tree.reshape(-1), np.arange(n_rows) * (2 * size) + 1
    while True:
        best = nodes[roots]
        live = best < none
        if not live.all():
            roots, best = roots[live], best[live]
        if not len(roots):
            break
        trees = roots - 1
        rows = trees // (2 * size) * width
        i, merged = best & size - 1, best >> bits & 0x1FFFF
        at = rows + i
        j = following[at]
        after = following[rows + j]
        before = previous[at]
        following[at], previous[rows + after] = after, i
        cells[at], cells[rows + j] = merged, -1
        # three leaves change: the merged pair with what follows, with what stands before it, and the lost symbol's
        found = table.get(np.concatenate((merged, cells[rows + before])), np.concatenate((cells[rows + after], merged))) << bits
        leaves = np.concatenate((i, before, j))
        trees = np.concatenate((trees, trees, trees))
        found |= leaves[: len(found)]
        leaves += size
        here = trees + leaves
        nodes[here[: len(found)]], nodes[here[len(found) :]] = found, none
        for _ in range(bits):  # up to the root
            leaves >>= 1
            below = trees + 2 * leaves
            nodes[trees + leaves] = np.minimum(nodes[below], nodes[below + 1])
    live = (symbols >= 0) & (np.arange(width) <= lengths[:, None])
    live[:, 0] = False
    return symbols[live], live.sum(axis=1)


class WordBpe:
    """Encoder and decoder of one tokenizer file with word ends."""

    def __init__(self, path: str, cache_chars: int = CACHE_CHARS):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab = data["model"]["vocab"]
        self.end = data["model"]["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]]
        self.merges = {vocab[a] << 17 | vocab[b]: rank << 17 | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        self.table = PairTable(self.merges)
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters])
        self.last = np.array([vocab[x + self.end] for x in letters])
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.tokens = pa.array(map(token.get, range(max(token) + 1)), pa.string())
        self.added_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces = regex.compile(PIECES)
        self.other_spaces = [c for c in map(chr, range(0x3001)) if c != " " and regex.match(f"[{SPACE}]", c)]
        # ids, as bytes, of what stands between spaces; when the young ones are too many they become the old ones
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cache_chars, self.held = cache_chars, 0

    def _keep(self, texts: list[str], ids: list[bytes]) -> None:
        for text, found in zip(texts, ids, strict=True):
            if len(text) <= KEPT_CHARS:
                if self.held >= self.cache_chars:
                    self.old, self.young, self.held = self.young, {}, 0
                self.young[text] = found
                self.held += len(text) + 1

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words, merged together with others of about their length."""
        if not words:
            return []
        array = pa.array(words, pa.string())
        ends = np.frombuffer(array.buffers()[1], np.int32)[: len(words) + 1].astype(np.int64)
        raw = np.frombuffer(array.buffers()[2], np.uint8)[: ends[-1]]
        symbols = self.inner[raw]
        symbols[ends[1:] - 1] = self.last[raw[ends[1:] - 1]]
        starts, lengths = ends[:-1], np.diff(ends)
        out: list[bytes] = [b""] * len(words)
        bits = np.frexp(lengths)[1]  # the least power of two above each length
        for b in np.unique(bits).tolist():
            same, size = np.flatnonzero(bits == b), 1 << b
            step = max(1, LEAVES >> b)
            for k in range(0, len(same), step):
                slab = same[k : k + step]
                if len(slab) < MIN_ROWS:
                    for w in slab.tolist():
                        out[w] = np.array(merge_word(symbols[starts[w] : ends[w + 1]].tolist(), self.merges), np.int32).tobytes()
                    continue
                rows = np.full((len(slab), size + 1), EDGE)
                filled = np.arange(1, size + 1) <= lengths[slab, None]
                rows[:, 1:][filled] = symbols[(starts[slab, None] + np.arange(size))[filled]]
                ids, counts = merge_rows(rows, lengths[slab], self.table)
                flat, to = ids.astype(np.int32).tobytes(), (4 * np.cumsum(counts)).tolist()
                for w, x, y in zip(slab.tolist(), [0, *to], to, strict=False):
                    out[w] = flat[x:y]
        return out

    def _stretches(self, stretches: list[str]) -> list[bytes]:
        """The ids of different stretches between two spaces; no piece crosses a space."""
        young, old, pieces = self.young.get, self.old.get, self.pieces.findall
        out = list(map(young, stretches))
        missing = [k for k, ids in enumerate(out) if ids is None]
        alone: list[int] = []
        mixed: list[int] = []
        parts: list[str] = []  # of the mixed ones, end to end
        ends: list[int] = []
        for k in missing:
            stretch = stretches[k]
            if (found := old(stretch)) is not None:
                out[k] = found
            elif stretch.isalpha():
                alone.append(k)
            elif stretch[:1] == "\n":  # a mark of an added token
                out[k] = np.array([self.added[stretch[1:]]], np.int32).tobytes()
            else:
                mixed.append(k)
                parts += pieces(stretch)
                ends.append(len(parts))
        words: dict[str, bytes | None] = dict.fromkeys(stretches[k] for k in alone)
        for part in set(parts).difference(words):
            words[part] = young(part) or old(part)
        new = [word for word, ids in words.items() if ids is None]
        words.update(zip(new, self._words(new), strict=True))
        for k in alone:
            out[k] = words[stretches[k]]
        made = list(map(words.__getitem__, parts))
        for k, start, end in zip(mixed, [0, *ends], ends, strict=False):
            out[k] = b"".join(made[start:end])
        self._keep([stretches[k] for k in missing], [out[k] for k in missing])
        return out

    def _plain(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each letter by itself: no final sigma
        for space in self.other_spaces:
            if space in text:
                text = text.replace(space, " ")
        return text.lower()

    def _normal(self, text: str) -> str:
        """The text as it is split at spaces; an added token stands between spaces, after a mark that no other stretch has."""
        if self.added_pattern and any(t in text for t in self.added):
            return " ".join("\n" + part if part in self.added else self._plain(part) for part in self.added_pattern.split(text))
        return self._plain(text)

    def encode_group(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text."""
        split = pc.split_pattern(pa.array(map(self._normal, texts), pa.string()), " ")
        coded = split.values.dictionary_encode()
        ids = self._stretches(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ends = np.cumsum([0, *map(len, ids)]) // 4
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
        taken = lists.take(coded.indices)
        return pa.ListArray.from_arrays(taken.offsets.take(split.offsets), taken.values)

    def encode(self, text: str) -> list[int]:
        return self.encode_group([text])[0].as_py()

    def decode(self, ids: list[int]) -> str:
        return self.decode_group(pa.array([ids], pa.list_(pa.int32())))[0].as_py()

    def decode_group(self, ids: pa.ListArray) -> pa.Array:
        """Tokens joined by a space, as a file without a decoder has it."""
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.tokens.take(ids.values)), " ")


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One encoder per worker and file."""
    return WordBpe(path)


def groups(texts: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch (null: empty) in order, about ``GROUP_CHARS`` characters at a time."""
    group, held = [], 0
    for value in texts:
        text = value.as_py() or ""
        group.append(text)
        held += len(text)
        if held >= GROUP_CHARS:
            yield group
            group, held = [], 0
    if group:
        yield group


ENCODED = pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def encode_column(text: Column, path: str) -> Column:
    """Struct of ``ids`` and ``decoded`` for each text (null: as empty)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = word_bpe(path)
        for batch in batches:
            for group in groups(batch):
                ids = bpe.encode_group(group)
                yield pa.StructArray.from_arrays([ids, bpe.decode_group(ids)], fields=list(ENCODED))

    return arrow_udf(run, "ids array<int>, decoded string", ArrowUDFType.SCALAR_ITER)(text)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and ``decoded``; columns of these names are replaced."""
    return annotate(docs, encode_column(F.col(text), path), ["ids", "decoded"])


def encoding_digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """One row per document: token count and hashes of the ids and of the decoded text.

    The digests are native expressions over the columns of ``encode``.
    """
    made = encode(docs.select("doc_id", F.col(text)), path, text)
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
