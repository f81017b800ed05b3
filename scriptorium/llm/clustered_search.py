"""Ranked lexical search over documents reordered by recursive graph bisection, in shards visited by cluster bound.

**Order.**  The terms and documents of a bounded sample form a graph.  Each level of the bisection halves every group of documents and swaps
pairs between the halves while that lowers the sum of ``degree * log2(size / (degree + 1))`` over the terms of both, which
brings documents of common terms together.  The sample only fixes the tree: *every* document descends it by the same gains and lies
in the leaf it reaches.  Leaves, or hash shares of large ones, are sorted by (leaf, number of terms) and cut into shards of a bounded number of
postings, so a large cluster has many shards, and documents of one shard have similar lengths.

**Index.**  One row per shard and term: the places in the shard of the documents that hold the term, rising, what each adds per unit of
the term's weight (its impact), and the greatest impact.  The row without a term lists the shard's doc_ids by place.

**Search.**  The bound of a shard for an item is the sum of weight times greatest impact over the item's terms.  Shards
are visited in falling order of bound, in rounds that grow fourfold.  After each round an item goes on only with the shards
whose bound is not below its k-th best score so far, so it stops exactly: equal bounds are still visited, as an equal score
with a smaller doc_id could lie there.  A round is one job over all items; the items of a shard are scored together.

Texts are read twice (sample and all); the driver sees counts and the sample's terms only.  Every step is a
stored table, so a lost executor re-reads its part.  Results do not depend on the sample, the tree or the shards.

Defined results: null and empty texts, and those without a term, are in no shard and count nowhere; repeated rows are documents of their own, and
null doc_ids rank behind others of their score; items without a term, or equal to no document, have no rows; repeated items
have their rows each; empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType, arrow_udf

from ..staging import stage
from .common import OWN, small_batches

#: Documents of the sample, distinct terms of one of them, terms of the tree, and its levels.
SAMPLE_DOCS, SAMPLE_TERMS, TREE_TERMS, DEPTH = 4_096, 2_000, 32_768, 6
#: Rounds of swaps at one node; groups of fewer documents are not halved.
SWEEPS, LEAST_DOCS = 20, 16
#: Postings of a shard, and of what one task sorts while there are not more than so many tasks.
SHARD_POSTINGS, TASK_POSTINGS, MOST_TASKS = 1 << 20, 1 << 22, 100_000
#: Rows up to which a table of query terms is broadcast; joined by shuffle beyond.
BROADCAST_ROWS = 500_000
#: Results per item; growth of the rounds.
K, GROWTH = 10, 4
#: What parts terms, and the letters that are lower-cased.
TERM, UPPER, LOWER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text; only A-Z are lower-cased."""
    return _TERM_BYTES.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def terms_column(text: Column) -> Column:
    """The same terms as a native expression, for short texts such as queries."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


# --- order -----------------------------------------------------------------------------------------


def _cost(degree: np.ndarray, size: int) -> np.ndarray:
    return degree * np.log2(size / (degree + 1))


def move_gains(here: np.ndarray, there: np.ndarray, n_here: int, n_there: int) -> np.ndarray:
    """For each term, by how much the cost falls if one of its documents moves from here to there."""
    now = _cost(here, n_here) + _cost(there, n_there)
    return now - _cost(np.maximum(here - 1, 0), n_here) - _cost(there + 1, n_there)


class Graph:
    """Documents and their distinct terms, as numbers."""

    def __init__(self, docs: list[np.ndarray], terms: int):
        self.terms = terms
        self.size = np.array([len(d) for d in docs], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.concatenate(docs) if docs else np.empty(0, np.int64)

    def of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the documents in a row, and whose they are by place."""
        size = self.size[docs]
        after = np.cumsum(size)
        places = np.repeat(self.first[docs] - after + size, size) + np.arange(after[-1] if len(after) else 0)
        return self.flat[places], np.repeat(np.arange(len(docs)), size)

    def degrees(self, docs: np.ndarray) -> np.ndarray:
        return np.bincount(self.of(docs)[0], minlength=self.terms)

    def cost(self, docs: np.ndarray) -> float:
        return float(_cost(self.degrees(docs), max(len(docs), 1)).sum())

    def gains(self, docs: np.ndarray, of_term: np.ndarray) -> np.ndarray:
        terms, whose = self.of(docs)
        return np.bincount(whose, of_term[terms], minlength=len(docs))

    def bisect(self, docs: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
        """Two halves, after swaps that lower the cost."""
        left, right = docs[: len(docs) // 2], docs[len(docs) // 2 :]
        for _ in range(sweeps):
            a, b = self.degrees(left), self.degrees(right)
            from_left = self.gains(left, move_gains(a, b, len(left), len(right)))
            from_right = self.gains(right, move_gains(b, a, len(right), len(left)))
            x, y = np.argsort(-from_left, kind="stable"), np.argsort(-from_right, kind="stable")
            pairs = min(len(x), len(y))
            swaps = int((from_left[x[:pairs]] + from_right[y[:pairs]] > 1e-9).sum())
            if not swaps:
                break
            before = self.cost(left) + self.cost(right)
            x, y = x[:swaps], y[:swaps]
            new_left, new_right = left.copy(), right.copy()
            new_left[x], new_right[y] = right[y], left[x]
            if self.cost(new_left) + self.cost(new_right) >= before:
                break  # gains of single moves do not add up any more
            left, right = new_left, new_right
        return left, right


@dataclass
class Tree:
    """``prefer[node, term]``: what the left half spares for a document with the term; node 1 is the root, 2k and 2k+1 its halves."""

    depth: int
    terms: dict[bytes, int]
    prefer: np.ndarray

    def leaf(self, terms: list[bytes]) -> int:
        known = [k for t in terms if (k := self.terms.get(t)) is not None]
        node = 1
        for _ in range(self.depth):
            node = 2 * node + (0 if self.prefer[node, known].sum() >= 0 else 1)
        return node - (1 << self.depth)


def fit_tree(docs: list[list[bytes]], depth: int = DEPTH, most: int = TREE_TERMS) -> Tree:
    """The bisection tree of documents given by their distinct terms."""
    seen = Counter(t for d in docs for t in d)
    chosen = sorted((t for t, n in seen.items() if n > 1), key=lambda t: (-seen[t], t))[:most]
    number = {t: k for k, t in enumerate(chosen)}
    graph = Graph([np.array(sorted(number[t] for t in d if t in number), np.int64) for d in docs], len(number))
    prefer = np.zeros((1 << depth, len(number)), np.float32)
    groups = {1: np.arange(len(docs))}
    for _ in range(depth):
        below = {}
        for node, group in groups.items():
            if len(group) < LEAST_DOCS:
                continue  # no preference: all go left
            left, right = graph.bisect(group)
            a, b = graph.degrees(left), graph.degrees(right)
            spared_left = _cost(a + 1, len(left)) - _cost(a, len(left))
            prefer[node] = _cost(b + 1, len(right)) - _cost(b, len(right)) - spared_left
            below |= {2 * node: left, 2 * node + 1: right}
        groups = below
    return Tree(depth, number, prefer)


def sample_tree(docs: DataFrame, text: str, key: str, sample: int = SAMPLE_DOCS, depth: int = DEPTH) -> Tree:
    """The tree of about ``sample`` documents, chosen by hash."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([list(dict.fromkeys(terms_of(t.as_py())))[:SAMPLE_TERMS] for t in batch], pa.list_(pa.binary()))

    scale = 1 << 30
    share = min(scale, scale * sample // max(docs.count(), 1))
    few = docs.where(F.pmod(F.xxhash64(key, text), F.lit(scale)) < share).limit(2 * sample)
    found = few.select(arrow_udf(run, "array<binary>", ArrowUDFType.SCALAR_ITER)(F.col(text)).alias("t")).toArrow()
    return fit_tree(sorted(d for d in found["t"].to_pylist() if d), depth)


# --- index -----------------------------------------------------------------------------------------

INDEX = "shard bigint, term string, top bigint, docs array<bigint>, impacts array<int>"


@dataclass
class Index:
    """Postings (see the module), with the number of documents and of all their terms."""

    postings: DataFrame
    documents: int
    total: int


def forward_rows(docs: DataFrame, tree: Tree, text: str, key: str) -> DataFrame:
    """Number of terms, leaf, distinct terms (joined by a space, which none holds) and how often each occurs, for each document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            names, size, leaf, terms, times = [], [], [], [], []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = Counter(terms_of(value.as_py()))
                if held:
                    names.append(name)
                    size.append(held.total())
                    leaf.append(tree.leaf(list(held)))
                    terms.append(b" ".join(held))
                    times.append(list(held.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(size, pa.int64()), pa.array(leaf, pa.int32()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(times, pa.list_(pa.int32()))],
                names=["doc", "n", "leaf", "terms", "times"],
            )

    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc bigint, n bigint, leaf int, terms string, times array<int>")


def build_shard(number: int, part: pa.Table, documents: int, total: int) -> pa.RecordBatch:
    """The index rows of documents in their order."""
    terms, times = pc.split_pattern(part["terms"].combine_chunks(), " "), part["times"].combine_chunks()
    coded = terms.flatten().dictionary_encode()
    code, tf = coded.indices.to_numpy(), times.flatten().to_numpy().astype(np.int64)
    size = np.diff(terms.offsets.to_numpy())
    place = np.repeat(np.arange(len(size)), size)
    m = 10 + 90 * part["n"].to_numpy().astype(np.int64) * documents // total
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[place])
    order = np.argsort(code, kind="stable")
    held = np.bincount(code, minlength=len(coded.dictionary))
    ends = np.concatenate(([0], np.cumsum(held)))
    place, impact = place[order], impact[order]
    ids = part["doc"].combine_chunks()
    offsets = pa.array(np.concatenate((ends, [ends[-1] + len(ids)])), pa.int32())
    docs = pa.ListArray.from_arrays(offsets, pa.concat_arrays([pa.array(place, pa.int64()), ids]))
    impacts = pa.ListArray.from_arrays(pa.array(np.concatenate((ends, ends[-1:])), pa.int32()), pa.array(impact, pa.int32()))
    top = np.concatenate((np.maximum.reduceat(impact, ends[:-1]), [0]))
    names = pa.concat_arrays([coded.dictionary, pa.array([None], pa.string())])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(names), number), pa.int64()), names, pa.array(top, pa.int64()), docs, impacts], names=["shard", "term", "top", "docs", "impacts"])


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE_DOCS, depth: int = DEPTH, shard_postings: int = SHARD_POSTINGS) -> Index:
    """The index of every document with a term."""
    spark = docs.sparkSession
    with small_batches(spark):
        tree = sample_tree(docs, text, key, sample, depth)
        rows = stage(forward_rows(docs, tree, text, key).withColumn("row", F.monotonically_increasing_id()), "forward")
    documents, total, postings = rows.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.size("times"))).first()
    tasks = max(1, -(-(postings or 0) // TASK_POSTINGS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, waiting, leaf = TaskContext.get().partitionId() << 32, 0, [], None

        def made() -> pa.RecordBatch:
            return build_shard(number, pa.Table.from_batches(waiting), documents, total)

        for batch in batches:
            leaves = batch.column("leaf").to_numpy()
            size = np.diff(batch.column("times").offsets.to_numpy()).tolist()
            begin = 0
            for k in range(batch.num_rows):
                if held and (held + size[k] > shard_postings or leaves[k] != leaf):
                    waiting.append(batch.slice(begin, k - begin))
                    yield made()
                    number, held, waiting, begin = number + 1, 0, [], k
                held, leaf = held + size[k], leaves[k]
            waiting.append(batch.slice(begin))
        if held:
            yield made()

    # a task gets whole leaves or, of a large one, a share of its rows by hash, so that lengths and copies are spread evenly
    dealt = rows.repartitionByRange(min(tasks, MOST_TASKS), F.col("leaf"), F.xxhash64("row"))
    sorted_rows = dealt.sortWithinPartitions("leaf", "n", "row")
    with small_batches(spark, 256):  # the longest documents stand together
        return Index(stage(sorted_rows.mapInArrow(run, INDEX), "shards"), documents, total or 0)


# --- search ----------------------------------------------------------------------------------------

SCORED = "item bigint, doc bigint, score bigint"


def score_shard(visits: pa.Table, postings: pa.Table, k: int) -> pa.Table:
    """The k best documents of one shard for each visiting item whose score is not below the item's floor."""
    names = postings["term"].to_pylist()
    docs, impacts = postings["docs"].combine_chunks(), postings["impacts"].combine_chunks()
    places, amounts = docs.flatten(), impacts.flatten().to_numpy()
    ends, begins = docs.offsets.to_numpy(), impacts.offsets.to_numpy()
    at = {t: i for i, t in enumerate(names)}
    ids = docs[at[None]].values
    known = ids.fill_null(0).to_numpy()
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    flat = places.fill_null(0).to_numpy()
    items, floors, weights = (visits[c].to_numpy() for c in ("item", "floor", "weight"))
    terms = visits["term"].to_pylist()
    out: list[tuple] = []
    order = np.argsort(items, kind="stable")
    edges = np.flatnonzero(np.diff(items[order], prepend=items[order[0]] - 1)).tolist() + [len(order)]
    for a, b in zip(edges, edges[1:]):
        score = np.zeros(len(known), np.int64)
        for v in order[a:b].tolist():
            i = at.get(terms[v])
            if i is not None:
                score[flat[ends[i] : ends[i + 1]]] += weights[v] * amounts[begins[i] : begins[i + 1]]
        floor = max(int(floors[order[a]]), 1)
        if len(score) > k:
            floor = max(floor, int(np.partition(score, -k)[-k]))
        few = np.flatnonzero(score >= floor)
        best = few[np.lexsort((known[few], missing[few], -score[few]))[:k]]
        out += [(int(items[order[a]]), None if missing[d] else int(known[d]), int(score[d])) for d in best]
    columns = list(zip(*out, strict=True)) if out else [()] * 3
    return pa.table({"item": pa.array(columns[0], pa.int64()), "doc": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.int64())})


def best_of(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item, with ``rank``."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def search(index: Index, items: DataFrame, text: str = "text", item: str = "item_id", k: int = K) -> DataFrame:
    """The k best documents of each item with a score above 0: item_id, rank, doc_id, score."""
    spark = items.sparkSession
    rows = stage(items.select(F.col(item).alias("name"), terms_column(F.col(text)).alias("terms")).withColumn("item", F.monotonically_increasing_id()), "items")
    asked = rows.select("item", F.explode(F.array_distinct("terms")).alias("term"))
    terms = stage(asked.select("term").distinct(), "asked")
    # only the postings of asked terms are looked at further, and where each place's doc_id stands
    hits = stage(index.postings.where(F.col("term").isNotNull()).join(_small(terms), "term", "left_semi").select("shard", "term", "top", "docs", "impacts"), "hits")
    held = hits.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1))).cast("bigint")
    weights = stage(asked.join(held.select("term", weight.alias("weight")), "term"), "weights")
    bound = F.sum(F.col("weight") * F.col("top")).alias("bound")
    bounds = hits.select("shard", "term", "top").join(_small(weights), "term").groupBy("item", "shard").agg(bound)
    turn = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "shard"))
    bounds = stage(bounds.where("bound > 0").withColumn("turn", turn), "bounds")

    def run(key: tuple, visits: pa.Table, postings: pa.Table) -> pa.Table:
        if not visits.num_rows or not postings.num_rows:
            return pa.schema([("item", pa.int64()), ("doc", pa.int64()), ("score", pa.int64())]).empty_table()
        return score_shard(visits, postings, k)

    best, done, upto = spark.createDataFrame([], SCORED + ", rank int"), 0, 1
    most = bounds.agg(F.max("turn")).first()[0] or 0
    while done < most:
        full = best.where(F.col("rank") == k).select("item", F.col("score").alias("floor"))
        left = bounds.where(F.col("turn") > done).join(full, "item", "left").withColumn("floor", F.coalesce("floor", F.lit(1))).where("bound >= floor")
        visits = stage(left.where(F.col("turn") <= upto).select("item", "shard", "floor"), "visits")
        if visits.isEmpty():
            if left.isEmpty():
                break
        else:
            seen = _small(visits.select("shard").distinct())
            postings = hits.select("shard", "term", "docs", "impacts").unionByName(index.postings.where(F.col("term").isNull()).select("shard", "term", "docs", "impacts")).join(seen, "shard", "left_semi")
            asking = visits.join(weights, "item").select("shard", "item", "floor", "term", "weight")
            scored = asking.groupBy("shard").cogroup(postings.groupBy("shard")).applyInArrow(run, SCORED)
            best = stage(best_of(best.drop("rank").unionByName(scored), k), "best")
        done, upto = upto, upto * GROWTH + 1
    return best.join(rows.select("item", "name"), "item").select(F.col("name").alias(item), "rank", F.col("doc").alias("doc_id"), "score")


def search_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Index and search in one."""
    return search(build_index(docs), items)


def search_sql(k: int = K) -> str:
    """The same rows in DuckDB SQL, without an index."""

    def cut(text: str) -> str:
        return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{TERM}')"

    return f"""
with d as (select row_number() over () as r, doc_id, {cut("text")} as terms from documents),
sized as (select r, doc_id, len(terms) as n from d where len(terms) > 0),
totals as (select count(*)::bigint as docs, sum(n)::bigint as total from sized),
q as (select distinct item_id, unnest({cut("text")}) as term from benchmark),
p as (select r, term, count(*) as tf from (select r, unnest(terms) as term from d) where term in (select term from q) group by all),
w as (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as weight from p, totals group by term, docs),
s as (select item_id, doc_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))))::bigint as score
      from q join w using (term) join p using (term) join sized using (r), totals group by all),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last)::int as rank, doc_id, score from s where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= {k}"""
