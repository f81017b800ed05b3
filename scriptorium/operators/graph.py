"""A knowledge graph as two tables: nodes (name, kind, description) and edges (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .skew import LEAST, join_spread

STRATEGIES = ("concatenate", "keep_first", "join_unique")


def _merged(strategy: str, value: Column, order: Column, separator: str) -> Column:
    listed = F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))), lambda x: x["v"])
    if strategy == "keep_first":
        return F.get(listed, F.lit(0))
    return F.array_join(F.array_distinct(listed) if strategy == "join_unique" else listed, separator)


def resolve_aliases(aliases: DataFrame, least: int = LEAST) -> DataFrame:
    """(name, target): the end of each alias's chain; ``ValueError`` if some chain has none.

    Pointers are doubled: after r rounds each alias points 2^r steps on, so a chain of n aliases takes log2(n) rounds, each one join over
    a stored table.  Targets that many aliases share are dealt out.  Of several targets of a name the least counts; aliases of themselves and
    nulls are none.  Joins are by merge: a table of names is small in its files, but not where it would be broadcast.
    """
    made = aliases.where("name is not null and target is not null and name <> target").groupBy("name").agg(F.min("target").alias("target"))
    made = stage(made, "aliases")
    rounds = made.count().bit_length() + 1  # enough for one chain of them all
    for _ in range(rounds):
        following = made.select(F.col("name").alias("target"), F.col("target").alias("next")).hint("merge")
        if made.join(following, "target", "left_semi").isEmpty():
            return made
        step = join_spread(made, following, "target", F.col("name"), "left", least)
        made = stage(step.select("name", F.coalesce("next", "target").alias("target")), "aliases")
    raise ValueError("aliases lead in a circle")


def merge_entities(nodes: DataFrame, edges: DataFrame, aliases: DataFrame, strategies: dict[str, str] | None = None, separator: str = "; ", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after each alias (name, target) became the end of its chain.

    Edges move, self-loops go, equal edges add up their weights.  ``strategies`` names one for each column of the nodes:
    ``concatenate`` all values, ``keep_first`` (the target's own, else the first alias's by name) or
    ``join_unique``.  Without it, kinds keep the least and descriptions are joined without repeats, in order.
    """
    aliases = resolve_aliases(aliases, least).hint("merge")
    named = nodes.join(aliases, "name", "left").withColumn("__old", F.struct(F.col("target").isNotNull().alias("a"), F.col("name").alias("n"))).withColumn("name", F.coalesce("target", "name"))
    if strategies is None:
        merged = named.groupBy("name").agg(F.min("kind").alias("kind"), F.concat_ws("; ", F.array_sort(F.collect_set("description"))).alias("description"))
    else:
        if unknown := set(strategies.values()) - set(STRATEGIES):
            raise ValueError(f"unknown strategies: {sorted(unknown)}")
        merged = named.groupBy("name").agg(*[_merged(strategies.get(c, "keep_first"), F.col(c), F.col("__old"), separator).alias(c) for c in nodes.columns if c != "name"])
    a = aliases.select(F.col("name").alias("src"), F.col("target").alias("s")).hint("merge")
    b = aliases.select(F.col("name").alias("dst"), F.col("target").alias("d")).hint("merge")
    moved = join_spread(join_spread(edges, a, "src", F.col("dst"), "left", least), b, "dst", F.col("src"), "left", least)
    ends = moved.select(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst"), "weight")
    return merged, ends.where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def insert_graph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with new ones: a known name keeps its node, a known edge adds the weight, ends without a node get an empty one."""
    ends = new_edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    every = new_nodes.unionByName(ends.join(new_nodes, "name", "left_anti"), allowMissingColumns=True).dropDuplicates(["name"])
    grown = nodes.unionByName(every.join(nodes.select("name"), "name", "left_anti"), allowMissingColumns=True)
    return grown, edges.unionByName(new_edges).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def edit_rows(rows: DataFrame, changes: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes (``on`` name) or edges (``on`` src and dst) after edits, and the edits that name no row.

    ``changes`` has the key columns, unique, and columns of ``rows``; a null keeps the old value.
    """
    fields = [c for c in changes.columns if c not in on]
    unknown = [c for c in fields if c not in rows.columns]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    met = rows.join(changes.select(*on, *[F.col(c).alias(f"__{c}") for c in fields]), on, "left")
    return met.select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns]), changes.join(rows, on, "left_anti")


def delete_entities(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without those named, and edges without those that end at one of them."""
    gone = names.select("name").distinct()
    left = edges.join(gone.withColumnRenamed("name", "src"), "src", "left_anti").join(gone.withColumnRenamed("name", "dst"), "dst", "left_anti")
    return nodes.join(gone, "name", "left_anti"), left.select(edges.columns)


def delete_relations(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges without the pairs (src, dst); their nodes stay."""
    return edges.join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def delete_documents(items: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Items (name, doc_id) that some document which stays still has: the shared ones are kept."""
    return items.join(doc_ids, "doc_id", "left_anti").groupBy("name").agg(F.count("*").alias("n_sources"))


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(name, neighbour, weight): the edges at each seed (name), in either direction."""
    return both_ways(edges).join(seeds, "name", "left_semi")


def both_ways(edges: DataFrame) -> DataFrame:
    """(name, neighbour, weight): each edge from either end."""
    return edges.select(F.col("src").alias("name"), F.col("dst").alias("neighbour"), "weight").unionByName(edges.select(F.col("dst").alias("name"), F.col("src").alias("neighbour"), "weight"))


def expand(edges: DataFrame, seeds: DataFrame, hops: int, least: int = LEAST) -> DataFrame:
    """(query_id, name, hop): every node within so many edges of a query's seeds (query_id, name), at its least distance.

    Each hop is one join of the frontier with the edges, whose hubs are dealt out whole, less what was seen before; all queries go at once.
    """
    links = stage(both_ways(edges).select("name", "neighbour").distinct(), "links")
    seen = stage(seeds.select("query_id", "name").where("name is not null").distinct().withColumn("hop", F.lit(0)), "seen")
    frontier = seen
    for hop in range(1, hops + 1):
        met = join_spread(links, frontier.select("query_id", "name"), "name", F.col("neighbour"), least=least)
        new = met.select("query_id", F.col("neighbour").alias("name")).distinct().join(seen, ["query_id", "name"], "left_anti")
        frontier = stage(new.withColumn("hop", F.lit(hop)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def _within(rows: DataFrame, order: list[Column], k: int, budget: Column | int) -> DataFrame:
    """Of (query_id, item, weight, tokens) the first k by the order, as long as their tokens stay within the budget."""
    w = Window.partitionBy("query_id").orderBy(*order)
    first = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("used", F.sum("tokens").over(running)).where(F.col("used") <= budget)


def local_context(edges: DataFrame, seeds: DataFrame, chunks: DataFrame | None = None, hops: int = 2, top_k: int = 60, chunk_top_k: int = 20, entity_tokens: int = 6_000, relation_tokens: int = 8_000, total_tokens: int = 30_000, least: int = LEAST) -> DataFrame:
    """(query_id, part, item, weight, rank, used): what the neighbourhood of each query's seeds shows, within token budgets.

    Entities come by distance, then by name; relations between two of the entities reached by weight; ``chunks`` (query_id, item,
    weight, tokens), such as the nearest by vector, by weight, within what the other two leave of the total.  A name costs its
    length in tokens, a relation the lengths of both its ends.
    """
    reached = stage(expand(edges, seeds, hops, least), "reached")
    entities = _within(reached.select("query_id", F.col("name").alias("item"), F.col("hop").cast("double").alias("weight"), F.length("name").alias("tokens")), [F.col("weight"), F.col("item")], top_k, entity_tokens)
    heads, tails = (reached.select("query_id", F.col("name").alias(end)) for end in ("src", "dst"))
    inner = join_spread(edges, heads, "src", F.col("dst"), least=least).join(tails, ["query_id", "dst"])
    relations = _within(inner.select("query_id", F.concat_ws("|", "src", "dst").alias("item"), F.col("weight").cast("double").alias("weight"), (F.length("src") + F.length("dst")).alias("tokens")), [F.desc("weight"), F.col("item")], top_k, relation_tokens)
    parts = [stage(found.withColumn("part", F.lit(name)), name) for name, found in (("entity", entities), ("relation", relations))]
    made = parts[0].unionByName(parts[1])
    if chunks is not None:
        spent = made.groupBy("query_id", "part").agg(F.max("used").alias("u")).groupBy("query_id").agg(F.sum("u").alias("spent"))
        found = _within(chunks.join(spent, "query_id", "left"), [F.desc("weight"), F.col("item")], chunk_top_k, F.lit(total_tokens) - F.coalesce("spent", F.lit(0)))
        made = made.unionByName(found.select(*[c for c in made.columns if c != "part"], F.lit("chunk").alias("part")))
    return made.select("query_id", "part", "item", "weight", "rank", "used")


def heaviest_edges(edges: DataFrame, words: Column, k: int) -> DataFrame:
    """The global search: the k edges of most weight whose ends hold one of the words."""
    found = F.exists(words, lambda w: F.contains("src", w) | F.contains("dst", w))
    return edges.where(found).orderBy(F.desc("weight"), "src", "dst").limit(k)


def search_graph(edges: DataFrame, seeds: DataFrame, words: Column, k: int, mode: str, chunks: DataFrame | None = None) -> DataFrame:
    """(part, item, weight) that a query mode shows: ``local`` the neighbourhood of the seeds, ``global`` the heaviest edges, ``hybrid`` both, ``naive`` the chunks (item, weight), ``mix`` all, ``bypass`` nothing."""
    near = neighbours(edges, seeds).select(F.lit("local").alias("part"), F.concat_ws("|", "name", "neighbour").alias("item"), F.col("weight").cast("double").alias("weight"))
    far = heaviest_edges(edges, words, k).select(F.lit("global").alias("part"), F.concat_ws("|", "src", "dst").alias("item"), F.col("weight").cast("double").alias("weight"))
    parts = {"local": [near], "global": [far], "hybrid": [near, far], "naive": [], "mix": [near, far], "bypass": [near.limit(0)]}[mode]
    if mode in ("naive", "mix"):
        if chunks is None:
            raise ValueError(f"{mode} searches chunks; give some")
        parts = [*parts, chunks.select(F.lit("chunk").alias("part"), F.col("item").cast("string").alias("item"), F.col("weight").cast("double").alias("weight"))]
    made = parts[0]
    for part in parts[1:]:
        made = made.unionByName(part)
    return made


def insert_documents(store: DataFrame, texts: DataFrame) -> DataFrame:
    """A store (doc_id, text) with the documents it does not hold yet; a null id becomes the MD5 of the text."""
    named = texts.select(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("doc-"), F.md5(F.col("text").cast("binary")))).alias("doc_id"), "text").groupBy("doc_id").agg(F.min("text").alias("text"))
    return store.unionByName(named.join(store.select("doc_id"), "doc_id", "left_anti"))


def unique_contexts(chunks: DataFrame, key: str, order: str, context: str) -> DataFrame:
    """Each context once per key, where it comes first; blank ones go."""
    first = chunks.where(F.trim(context) != "").groupBy(key, context).agg(F.min(order).alias(order))
    return first.select(key, order, context)


def token_chunks(docs: DataFrame, key: str, tokens: Column, size: int = 1200, overlap: int = 100) -> DataFrame:
    """(key, chunk_no, tokens): arrays of ``size`` tokens that overlap; the last one may be shorter, none is only overlap."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be below the size")
    step, n = size - overlap, F.size("__t")
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step))
    cut = F.transform(starts, lambda s: F.slice("__t", s + 1, F.lit(size)))
    rows = docs.select(key, tokens.alias("__t")).where(n > 0)
    return rows.select(key, F.posexplode(cut).alias("chunk_no", "tokens"))
