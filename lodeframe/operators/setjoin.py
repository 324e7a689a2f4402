"""The exact join of sets by similarity, the gate before it, and clusters around anchors.

Every pair of sets whose Jaccard similarity reaches the threshold is found, at any size of the data.
Elements are put in order of how many sets hold them, the rarest first. Two sets that are so alike
share one of the first few elements of each (its prefix), so sets meet on those alone, if their sizes allow the
similarity, and if what follows the element in both can still make up the overlap that it asks for.
Elements that the same sets hold stand side by side, and sets meet on the first of them alone. Each set carries the parities of its elements,
dealt to 256 bits: as many bits as differ between two sets, so many elements at least are in one of them only, and where those are too many
the two are no candidates. Pairs are verified by their whole sets. Elements that many prefixes hold are dealt to parts on one side and sent to all
of its parts on the other, so that no task has all the pairs of an element.

Sets made from few templates share all their elements with many others, so that any of them is a meeting of too many. Such sets have few bundles
(elements that the same sets hold) besides the most frequent elements, which are kept as bits. Two sets that are alike meet on just the bundles
that both have: each set leaves out every choice of its bundles that the similarity lets it miss, and meets on the rest. Where the left
out bundles of two sets share none, what they meet on is what they share, so each pair comes once, verified by numbers that its
rows carry. Only pairs with a set of more bundles (``MOST_BUNDLES``) are left to the prefixes.
"""

from __future__ import annotations

import re

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.plans.skew import lookup_join, weighed_join
from lodeframe.session import checkpoint, settle, spread

#: Tokens of code, and how many make a shingle. The last kind are single marks.
TOKEN, SHINGLE = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\sA-Za-z0-9_]", 3
#: Spaces are those of SQL's patterns.
_TOKEN = re.compile(TOKEN, re.ASCII)
#: Fixed values of the gate: items up to which all pairs are compared, and up to which they are whatever their size.
MOST_ITEMS, FEW_ITEMS, FEW_TOKENS = 100, 10, 15
#: Rows of one element that meet in one task on the dealt side.
TOGETHER = 2000
#: Words of 64 bits that the parities take.
WORDS = 4
#: Bundles up to which a set meets on all choices of them.
MOST_BUNDLES = 6
#: Elements that more than one in FREQUENT sets hold are kept as bits, WORDS * 64 of them at most.
FREQUENT = 16
#: Elements that one in BROADCAST sets hold are few, whatever the number of sets, and are looked up by broadcast.
BROADCAST = 1000
#: Keeps sizes that are whole numbers whole where a share of them is no exact number.
SLACK = 1e-9


def token_shingles(text: Column) -> Column:
    """The different runs of three tokens of a text, hashed; all tokens of a shorter one; none of an empty or null one."""
    return _hashed_shingles(text)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _hashed_shingles(texts: pd.Series) -> pd.Series:
    # Texts of a batch share most of their shingles.
    hashes: dict[tuple[str, ...], int] = {}
    out = []
    for text in texts:
        tokens = _TOKEN.findall(text or "")
        runs = set(zip(*[tokens[i:] for i in range(SHINGLE)])) if len(tokens) > SHINGLE else {tuple(tokens)} if tokens else set()
        for run in runs - hashes.keys():
            hashes[run] = xxhash.xxh3_64_intdigest(" ".join(run)) - (1 << 63)
        out.append([hashes[run] for run in runs])
    return pd.Series(out, dtype=object)


def _held(rows: DataFrame) -> DataFrame:
    """item, n, f, g of rows (node, item): how many nodes hold an item, and two fingerprints of which."""
    return checkpoint(rows.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("f"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("g")))


def rarest_first(sets: DataFrame) -> DataFrame:
    """node, items, fresh, parity of sets (node, items: different numbers), each in one order for all: by how many sets hold them.

    Items that the same sets hold, by the fingerprints of those, are next to each other; ``fresh`` is false for all but the first of them.
    """
    rows = sets.select("node", F.explode("items").alias("item"))
    held = _held(rows)
    total = held.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    ranked = weighed_join(rows, held, ["item"], total)
    bit = F.expr("shiftleft(1L, int(item & 63))")
    parity = [F.bit_xor(F.when(F.pmod(F.shiftright("item", 6), F.lit(WORDS)) == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"p{i}") for i in range(WORDS)]
    found = ranked.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "f", "g", "item"))).alias("x"), *parity)
    holders = F.transform("x", lambda x: F.struct(x["n"], x["f"], x["g"]))
    fresh = F.zip_with(holders, F.concat(F.array(F.lit(None).cast("struct<n:bigint,f:bigint,g:bigint>")), F.slice(holders, F.lit(1), F.size("x") - 1)), lambda x, y: ~x.eqNullSafe(y))
    return found.select("node", F.transform("x", lambda x: x["item"]).alias("items"), fresh.alias("fresh"), F.struct(*[f"p{i}" for i in range(WORDS)]).alias("parity"))


def candidates(ordered: DataFrame, similarity: float, light: DataFrame | None = None) -> DataFrame:
    """Different pairs a < b of the sets of ``rarest_first`` that may reach the similarity; none that does is missing.

    Pairs of two of the nodes ``light`` (node) are left out, if these are given.
    """
    if light is None:
        ordered = ordered.withColumn("light", F.lit(False))
    else:
        ordered = ordered.join(light.select("node", F.lit(True).alias("light")).hint("shuffle_merge"), "node", "left").withColumn("light", F.coalesce("light", F.lit(False)))
    size = F.size("items")
    prefix = (size - F.ceil(size * similarity - SLACK) + 1).cast("int")
    placed = F.slice(F.arrays_zip("items", "fresh"), F.lit(1), prefix)
    rows = ordered.filter(size > 0).select("node", "light", "parity", size.alias("size"), F.posexplode(placed).alias("place", "x")).filter("x.fresh").select("node", "light", "parity", "size", "place", F.col("x.items").alias("item"))
    many = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    total = many.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    shared = checkpoint(weighed_join(rows, many, ["item"], total, "inner").withColumn("parts", F.ceil(F.col("n") / TOGETHER).cast("int")))

    def side(part: Column, name: str) -> DataFrame:
        return shared.select("item", part.alias("part"), F.col("node").alias(name), F.col("light").alias(f"{name}_light"), F.col("size").alias(f"{name}_size"), F.col("place").alias(f"{name}_place"), *[F.col(f"parity.p{i}").alias(f"{name}{i}") for i in range(WORDS)])

    left = side(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), "a").filter("not a_light")
    right = side(F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "b")
    met = left.join(right.hint("shuffle_merge"), ["item", "part"])
    fits = (F.least("a_size", "b_size") >= F.greatest("a_size", "b_size") * similarity - SLACK) & (F.col("a") != F.col("b")) & (F.col("b_light") | (F.col("a") < F.col("b")))
    # At their first common element two sets that are alike enough have what is left of the overlap in what follows it.
    overlap = F.ceil((F.col("a_size") + F.col("b_size")) * (similarity / (1 + similarity)) - SLACK)
    after = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place"))
    # Elements of one set only, of which each pair in a bit hides itself.
    apart = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(WORDS)), F.lit(0))
    return met.filter(fits & (after >= overlap) & (apart <= F.col("a_size") + F.col("b_size") - 2 * overlap)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def bundled(sets: DataFrame) -> DataFrame:
    """node, size, single (items of no other set), c0.. (the most frequent items, a bit each), rare (bundle, weight of all other shared items) of sets.

    ``sets`` (node, items: different numbers, some) is read more than once. A bundle is what the same sets hold, its weight how many items that is.
    """
    held = _held(sets.select("node", F.explode("items").alias("item")))
    total, own = sets.count(), [F.col("n"), F.col("f"), F.col("g")]
    shared = held.filter("n > 1")
    first = [F.desc("n"), "f", "g", "item"]
    top = shared.filter(F.col("n") * FREQUENT > total).orderBy(*first).limit(64 * WORDS)
    # A bit for each of at most so many rows.
    top = checkpoint(top.withColumn("place", F.row_number().over(Window.orderBy(*first)) - 1).select("item", "place"))
    rest = shared.join(F.broadcast(top.select("item")), "item", "left_anti")
    # Of a bundle the least item stands for all.
    bundles = checkpoint(rest.groupBy(*own).agg(F.min("item").alias("item"), F.count(F.lit(1)).cast("int").alias("weight")).select("item", "n", F.xxhash64(*own).alias("bundle"), "weight"))
    dealt = spread(sets.select("node", "items"))
    rows = dealt.select("node", F.explode("items").alias("item"))
    bits = [F.bit_or(F.when(F.shiftright("place", 6) == i, F.expr("shiftleft(1L, place & 63)")).otherwise(F.lit(0).cast("long"))).alias(f"c{i}") for i in range(WORDS)]
    out = rows.join(F.broadcast(top), "item", "left").groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("size"), *bits)
    many = F.col("n") * BROADCAST >= total
    found = rows.join(F.broadcast(bundles.filter(many).drop("n")), "item").select("node", "bundle", "weight")
    few = bundles.filter(~many).drop("n")
    if not few.isEmpty():
        found = found.unionByName(rows.join(few.hint("shuffle_merge"), "item").select("node", "bundle", "weight"))
    found = found.groupBy("node").agg(F.collect_list(F.struct("bundle", "weight")).alias("rare"), F.sum("weight").cast("int").alias("heft"))
    out = out.join(found.hint("shuffle_merge"), "node", "left").withColumns({"rare": F.coalesce("rare", F.array().cast("array<struct<bundle:bigint,weight:int>>")), "heft": F.coalesce("heft", F.lit(0))})
    common = sum((F.bit_count(f"c{i}") for i in range(WORDS)), F.lit(0))
    return out.withColumn("single", F.col("size") - F.col("heft") - common).drop("heft")


def meetings(light: DataFrame, similarity: float) -> DataFrame:
    """key, kept, gone, size, node, c0.., mask, cut, met: what the sets of ``bundled`` meet on, of up to MOST_BUNDLES bundles each.

    ``kept`` items make the key; ``gone`` ones, in the bundles ``cut`` or in no other set, are left out. Rows whose key no other row can be alike on are not returned.
    """
    at = range(MOST_BUNDLES)
    rows = light.select("node", "size", "single", *[f"c{i}" for i in range(WORDS)], F.size("rare").alias("k"), *[F.get("rare", F.lit(i))["bundle"].alias(f"b{i}") for i in at], *[F.coalesce(F.get("rare", F.lit(i))["weight"], F.lit(0)).alias(f"w{i}") for i in at])
    rows = rows.withColumn("choice", F.explode(F.expr("sequence(0, shiftleft(1, k) - 1)")))
    out = [F.col("choice").bitwiseAND(1 << i) != 0 for i in at]
    zero = F.lit(0).cast("long")
    gone = sum((F.when(out[i], F.col(f"w{i}")).otherwise(0) for i in at), F.col("single"))
    rows = rows.withColumn("gone", gone).filter(F.col("gone") <= F.col("size") * (1 - similarity) + SLACK)
    key, mask = zero, zero
    for i in at:
        key = key.bitwiseXOR(F.when(out[i], zero).otherwise(F.coalesce(f"b{i}", zero)))
        mask = mask.bitwiseOR(F.when(out[i], F.expr(f"shiftleft(1L, cast(b{i} & 63 as int))")).otherwise(zero))
    kept = sum((F.when(out[i], 0).otherwise(F.col(f"w{i}")) for i in at), F.lit(0))
    cut = F.array_compact(F.array(*[F.when(out[i], F.col(f"b{i}")) for i in at]))
    rows = rows.select(key.alias("key"), kept.alias("kept"), "gone", "size", "node", *[f"c{i}" for i in range(WORDS)], mask.alias("mask"), cut.alias("cut"))
    keys = rows.groupBy("key", "kept").agg(F.count(F.lit(1)).alias("n"), F.min("gone").alias("least")).filter("n > 1")
    keys = checkpoint(keys.withColumn("met", F.col("n")))
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # What is in one of two sets only is such a share of what is in both at most.
    can = F.col("gone") + F.col("least") <= (F.col("size") - F.col("gone")) * ((1 - similarity) / similarity) + SLACK
    return checkpoint(lookup_join(rows, keys, ["key", "kept"], "n", total, "inner").filter(can).drop("least"))


def _dealt(rows: DataFrame, name: str, dealt: bool) -> DataFrame:
    """One side of the meeting of rows with equal keys; those of a key that many meet on are dealt to parts, and sent to all of them on the other side."""
    parts = F.ceil(F.col("met") / TOGETHER).cast("int")
    part = F.pmod(F.xxhash64("node"), parts).cast("int") if dealt else F.explode(F.sequence(F.lit(0), parts - 1))
    return rows.select("key", "kept", part.alias("part"), *[F.col(c).alias(f"{name}_{c}") for c in rows.columns if c not in ("key", "kept", "met")])


def _meet(left: DataFrame, right: DataFrame, similarity: float, order: Column) -> DataFrame:
    """Pairs of rows with equal keys, in this order, whose similarity by what they are known to share reaches the threshold."""
    both = F.col("kept") + sum((F.bit_count(F.col(f"a_c{i}").bitwiseAND(F.col(f"b_c{i}"))) for i in range(WORDS)), F.lit(0))
    value = both / (F.col("a_size") + F.col("b_size") - both)
    on = ["key", "kept", "part"]
    # Few bytes make many pairs, so tasks are not put together by bytes.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = _dealt(left, "a", True).repartition(tasks, *on).join(_dealt(right, "b", False).repartition(tasks, *on).hint("shuffle_merge"), on)
    return met.filter(order & (value >= similarity - SLACK)).withColumn("similarity", value)


def _apart() -> Column:
    """Whether two rows have left out no bundle that is in both: then they share what they meet on, and no more."""
    return (F.col("a_mask").bitwiseAND(F.col("b_mask")) == 0) | ~F.arrays_overlap("a_cut", "b_cut")


def _verified(sets: DataFrame, similarity: float, light: DataFrame | None = None) -> DataFrame:
    """a, b, similarity of the pairs of ``candidates`` that reach it."""
    ordered = checkpoint(rarest_first(sets))
    pairs = checkpoint(candidates(ordered, similarity, light))
    total = pairs.count()
    for side in "ab":
        pairs = weighed_join(pairs, ordered.select(F.col("node").alias(side), F.col("items").alias(f"{side}_items")), [side], total)
    both = F.size(F.array_intersect("a_items", "b_items"))
    found = pairs.select("a", "b", (both / (F.size("a_items") + F.size("b_items") - both)).alias("similarity"))
    return found.filter(F.col("similarity") >= similarity - SLACK)


def _parts(sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame | None]:
    """The ``meetings`` of sets with few bundles, and the verified pairs with any other set, if there are such."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0, and 1 at most")
    sets = sets.filter(F.size("items") > 0)
    known = checkpoint(bundled(sets))
    few = F.size("rare") <= MOST_BUNDLES
    light = known.filter(few)
    other = None if known.filter(~few).isEmpty() else _verified(sets, similarity, light.select("node"))
    return meetings(light, similarity), other


def similar_sets(sets: DataFrame, similarity: float) -> DataFrame:
    """a, b, similarity of all pairs a < b of sets (node, items) whose Jaccard similarity reaches the threshold (above 0).

    Nodes are different; empty and null sets are like none. Empty input gives no rows.
    """
    rows, other = _parts(sets, similarity)
    found = _meet(rows, rows, similarity, F.col("a_node") < F.col("b_node")).filter(_apart()).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), "similarity")
    return found if other is None else found.unionByName(other)


def link_counts(sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """node, n_links of the nodes of ``similar_sets`` that have links, and edges (source, target) with the same components as the links.

    Links are counted as they meet and not kept. Rows of a key that are alike in all that a link is told by are a cell: all of one cell
    are linked with all of another, or none, so that edges between the first of each cell, and of each cell to its first, will do.
    """
    rows, other = _parts(sets, similarity)
    met = _meet(rows, rows, similarity, F.col("a_node") != F.col("b_node")).filter(_apart())
    counts = met.groupBy(F.col("a_node").alias("node")).agg(F.count(F.lit(1)).alias("n_links"))
    like = ["key", "kept", "gone", "size", *[f"c{i}" for i in range(WORDS)]]
    cells = checkpoint(rows.groupBy(*like).agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n"), F.max("met").alias("met")))
    # A cell is linked within itself if it has two nodes.
    order = (F.col("a_node") < F.col("b_node")) | ((F.col("a_node") == F.col("b_node")) & (F.col("a_n") > 1))
    near = checkpoint(_meet(cells, cells, similarity, order))
    edges = near.filter("a_node <> b_node").select(F.col("a_node").alias("source"), F.col("b_node").alias("target"))
    sides = [near.select("key", "kept", *[F.col(f"{x}_{c}").alias(c) for c in (*like[2:], "node", "n")]).filter("n > 1") for x in "ab"]
    linked = checkpoint(sides[0].unionByName(sides[1]).distinct().withColumnRenamed("node", "source"))
    total = linked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    members = lookup_join(rows.select("node", *like), linked, like, "n", total, "inner").select("source", F.col("node").alias("target"))
    edges = edges.unionByName(members.filter("source <> target"))
    if other is not None:
        other = checkpoint(other)
        counts = counts.unionByName(other.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))).groupBy("node").agg(F.sum("n_links").alias("n_links"))
        edges = edges.unionByName(other.select(F.col("a").alias("source"), F.col("b").alias("target")))
    return checkpoint(counts), checkpoint(edges.distinct())


def compare_all(items: DataFrame, pairs: DataFrame, enabled: bool = True) -> DataFrame:
    """bucket, n_items, n_small, n_candidates, compare_all: whether a bucket without candidates has all its pairs compared.

    ``items`` has bucket and tokens (how many), ``pairs`` the bucket of each candidate pair. Only buckets of few items
    are, if some of them are short, whose sketches say little, or if there are hardly any.
    """
    size = items.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_items"), F.count(F.when(F.col("tokens") < FEW_TOKENS, 1)).alias("n_small"))
    rows = size.join(pairs.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_candidates")), "bucket", "left").fillna(0, ["n_candidates"])
    few = (F.col("n_items") <= MOST_ITEMS) & ((F.col("n_small") > 0) | (F.col("n_items") <= FEW_ITEMS))
    return rows.withColumn("compare_all", F.lit(enabled) & (F.col("n_candidates") == 0) & few)


def all_pairs(items: DataFrame, gate: DataFrame) -> DataFrame:
    """bucket, a, b: all pairs a < b of items (bucket, node) of the buckets that ``compare_all`` lets through, of MOST_ITEMS items at most."""
    let = items.join(gate.filter("compare_all").select("bucket"), "bucket", "left_semi").groupBy("bucket").agg(F.array_sort(F.collect_set("node")).alias("m"))
    return let.select("bucket", F.posexplode("m").alias("i", "a"), "m").select("bucket", "a", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("b"))


def anchors(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, anchor of each of ``nodes`` (node), as if they were gone through in order, by ``links`` (a < b).

    A node that no anchor before it has taken is an anchor, and takes all linked nodes after it that are free. A node
    is decided once all that are linked before it are: in each round those become anchors that have no undecided node
    before them, and what is linked after them is no anchor; whose it is, the first one's, is seen once all anchors are known. Every
    round decides the least undecided node of each component; along a chain of links in order it takes half as many rounds as
    the chain is long, otherwise few. Nothing is collected.
    """
    linked = settle(links.select("a", "b").distinct())
    open_, taken = linked, []
    while not open_.isEmpty():
        # Nodes with nothing undecided before them.
        first = open_.select(F.col("a").alias("node")).distinct().join(open_.select(F.col("b").alias("node")).distinct(), "node", "left_anti")
        got = settle(open_.join(first.withColumnRenamed("node", "a").hint("shuffle_merge"), "a", "left_semi").select(F.col("b").alias("node")).distinct())
        taken.append(got)
        # Links of decided nodes say nothing any more.
        gone = got.unionByName(first)
        for side in "ab":
            open_ = open_.join(gone.withColumnRenamed("node", side).hint("shuffle_merge"), side, "left_anti").select("a", "b")
        open_ = settle(open_)
        if len(taken) == 16:
            # So many rounds are put together, so that the plan stays small.
            taken = [settle(_union(taken))]
    own = nodes.select("node").distinct()
    if not taken:
        return own.withColumn("anchor", F.col("node"))
    members = _union(taken)
    kept = linked.join(members.withColumnRenamed("node", "a").hint("shuffle_merge"), "a", "left_anti")
    anchor = kept.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("anchor"))
    return own.join(anchor.hint("shuffle_merge"), "node", "left").select("node", F.coalesce("anchor", "node").alias("anchor"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def anchor_clusters(items: DataFrame, similarity: float) -> DataFrame:
    """bucket, id, anchor, n_members of items (bucket, id, text): clusters around anchors within each bucket, in order of ids.

    Equal texts of a bucket are one node, the least of their ids: what one of them is like, all are, and the first comes first.
    Null texts stay alone. Of rows with one id and bucket the least text counts.
    """
    rows = checkpoint(items.groupBy("bucket", "id").agg(F.min("text").alias("text")).withColumn("digest", F.when(F.col("text").isNotNull(), F.sha2("text", 256)).otherwise(F.concat(F.lit("null "), F.col("id").cast("string")))))
    total = rows.count()
    groups = checkpoint(rows.groupBy("bucket", "digest").agg(F.min("id").alias("first")))
    nodes = groups.select(F.struct("bucket", F.col("first").alias("id")).alias("node"))
    texts = rows.join(groups.select("bucket", F.col("first").alias("id")), ["bucket", "id"], "left_semi")
    # A bucket's sets get the bucket as an element of its own kind, hashed in with each: sets of two buckets share nothing.
    own = spread(texts.select("id", "bucket", "text")).select(F.struct("bucket", "id").alias("node"), F.transform(token_shingles(F.col("text")), lambda x: F.xxhash64("bucket", x)).alias("items"))
    linked = similar_sets(checkpoint(own), similarity)
    clusters = anchors(nodes, linked).select(F.col("node.bucket").alias("bucket"), F.col("node.id").alias("first"), F.col("anchor.id").alias("anchor"))
    known = checkpoint(groups.join(clusters, ["bucket", "first"]).select("bucket", "digest", "anchor"))
    found = checkpoint(weighed_join(rows.select("bucket", "id", "digest"), known, ["bucket", "digest"], total).drop("digest"))
    sizes = found.groupBy("bucket", "anchor").agg(F.count(F.lit(1)).alias("n_members"))
    return weighed_join(found, sizes, ["bucket", "anchor"], total).select("bucket", "id", "anchor", "n_members")
