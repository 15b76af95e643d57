"""Connected components and similarity links inside candidate buckets, as Spark jobs.

``components`` labels every node of an edge list with the smallest node it
reaches (minimum of the neighbours' labels plus pointer jumping, each round
written to the shared folder).

``linked_components`` takes rows ``(token, node, n)``: nodes that share a token are
candidates. Each member is first checked against two of its bucket's nodes only: the most
central one and the one with the smallest set. What the links found so far connect needs
no more checks. Small buckets that are still open are compared pair by pair. The nodes of
large open buckets are dealt anew by single items: these are counted over all such nodes,
exactly, and each node takes its rarest ones, as many as a linked set must share one of. So
a passage that very many sets hold gathers no bucket, unless sets hold little else. Two
nodes of such a bucket meet only if the item stands early enough in both sets' orders to leave
as many items after it as a link of their sizes needs.
Parity sketches bound the symmetric difference from below and drop most candidates; exact
Jaccard decides the rest. Every true link either is found or joins two nodes already
connected: the components are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotweave.llm.common import BROADCAST_ROWS, FEW_ROWS, durable, few


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, label)``; label is the smallest node reachable. Nodes without
    an edge don't appear; an empty edge list gives an empty table."""
    both = durable(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                   .where("a != b").distinct(), "edges")
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                     .select("node", F.least("node", "m").alias("label")), "labels")
    small = labels.count() <= FEW_ROWS

    def side(rows):
        return F.broadcast(rows) if small else rows

    while True:
        near = (both.join(side(labels.select(F.col("node").alias("b"), "label")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m")))
        low = near.join(side(labels), "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = durable(low.join(side(up), "label").select("node", "old", F.least("label", "top").alias("label")), "labels")
        labels = new.select("node", "label")
        if not new.where("old != label").limit(1).count():
            return labels


def joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """Components ``label(node, label)`` after further ``links(a, b)``: only the components that these join are
    labelled anew."""
    def of(end):
        return F.coalesce(f"l{end}", end).alias(end)

    known = few(label)
    ends = (links.join(known.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left")
            .join(known.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left"))
    low = components(ends.select(of("a"), of("b")))
    moved = (label.join(few(low).select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left")
             .select("node", F.coalesce("top", "label").alias("label")))
    return durable(moved.unionByName(low.join(known, "node", "left_anti")), "labels")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose sets (``node, items``: distinct longs) have Jaccard >= percent/100, exactly."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("ia"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("ib"))
    both = pairs.join(right, "b").join(left, "a")
    inter = F.size(F.array_intersect("ia", "ib"))
    return (both.withColumn("i", inter)
            .where(100 * F.col("i") >= percent * (F.size("ia") + F.size("ib") - F.col("i")))
            .select("a", "b"))


def _sizes_fit(percent: int):
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def _fold(x, size):
    """A parity sketch folded to half its bits where it is the longer one (sizes differ by a factor of 2 at most)."""
    return F.when(F.size(x) > size, F.zip_with(F.slice(x, F.lit(1), size), F.slice(x, size + 1, size),
                                               lambda p, q: p.bitwiseXOR(q))).otherwise(x)


def _every_fourth(i: int):
    """A parity sketch of 64-bit words folded to four of them: word ``i``."""
    return F.aggregate(F.filter("sketch", lambda _, at: at % 4 == i), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))


def near_by_sketch(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b, na, nb)`` whose sketches ``(node, sketch)`` don't rule out a link: the Hamming distance
    bounds the symmetric difference from below, which is at most (1-J)/(1+J) of the summed sizes."""
    both = (pairs.join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
            .join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a"))
    size = F.least(F.size("sa"), F.size("sb"))
    apart = F.aggregate(F.zip_with(_fold(F.col("sa"), size), _fold(F.col("sb"), size),
                                   lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    return both.where((100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b")


#: Open buckets of at most so many nodes are compared pair by pair.
SMALL = 24


def linked_components(tokens: DataFrame, sketches: DataFrame, sets_of, percent: int) -> tuple[DataFrame, DataFrame]:
    """(components ``(node, label)``, verified links ``(a, b)``) of nodes that share a token.

    ``tokens(token, node, n)``: durable, tokens that several nodes have; n: the set's size.
    ``sketches(node, sketch)``: durable parity sketches, a power of two of bits, at least one for each item.
    ``sets_of(ids)``: the sets ``(node, items)`` of the nodes in ``ids(node)``.
    """
    kind = tokens.schema["node"].dataType.simpleString()
    links = label = None
    folds = few(durable(sketches.select("node", *[_every_fourth(i).alias(f"f{i}") for i in range(4)]), "folds"))

    def check(pairs):
        nonlocal links, label
        near = durable(near_by_sketch(pairs.where(_sizes_fit(percent)).distinct(), sketches, percent), "near")
        if near.limit(1).count():
            ids = durable(near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), "ids")
            found = durable(verified(near, durable(sets_of(ids), "sets"), percent), "links")
            if found.limit(1).count():
                links = found if links is None else links.unionByName(found)
                label = components(found) if label is None else joined(label, found)

    def open_rows(rows):
        """Rows of tokens whose nodes still lie in different components."""
        own = rows if label is None else rows.join(few(label), "node", "left")
        own = own.withColumn("comp", F.coalesce("label", "node") if label is not None else F.col("node"))
        own = durable(own.select("token", "node", "n", "score", "place", "comp"), "rows")
        some = own.groupBy("token").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 != c2").select("token")
        return own.join(F.broadcast(some) if own.count() <= BROADCAST_ROWS else some, "token")

    def compare(rows):
        def side(end):
            names = {"node": end, "n": f"n{end}", "comp": f"c{end}", "place": f"p{end}"} | {f"f{i}": f"f{i}{end}" for i in range(4)}
            return own.select("token", *[F.col(c).alias(to) for c, to in names.items()])

        own = rows.join(folds, "node")
        # the first item that a linked pair shares leaves enough for the others in both
        after = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1
        enough = (100 + percent) * after >= percent * (F.col("na") + F.col("nb"))
        apart = sum(F.bit_count(F.col(f"f{i}a").bitwiseXOR(F.col(f"f{i}b"))) for i in range(4))
        near = (100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb"))
        check(side("a").join(side("b"), "token")
              .where((F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b")) & enough & near & _sizes_fit(percent))
              .select("a", "b", "na", "nb"))

    def stars(rows):
        """Checks each node against two of its bucket's; the rows still open without those two, with the bucket's size ``m``."""
        hubs = durable(rows.groupBy("token").agg(
            F.max(F.struct("score", "node", "n", "comp")).alias("mid"), F.min(F.struct("n", "node", "comp")).alias("low"),
            F.count("*").alias("m")), "hubs")
        both = rows.join(few(hubs), "token")
        check(both.select("node", "n", "comp", F.explode(F.array(
            F.struct("mid.node", "mid.n", "mid.comp"), F.struct("low.node", "low.n", "low.comp"))).alias("hub"))
            .where("comp != hub.comp").select(F.col("node").alias("a"), F.col("hub.node").alias("b"), F.col("n").alias("na"),
                                              F.col("hub.n").alias("nb")))
        left = open_rows(both.where("node != low.node and node != mid.node").select("token", "node", "n", "score", "place"))
        return durable(left.join(few(hubs.select("token", "m")), "token"), "open")

    score = tokens.groupBy("node").agg((F.count("*") / F.first("n")).alias("score"))
    left = stars(durable(open_rows(tokens.join(score, "node").withColumn("place", F.lit(0).cast("long"))), "open"))
    # any pair of a small bucket, whatever its items
    compare(left.where(F.col("m") <= SMALL))
    nodes = durable(left.where(F.col("m") > SMALL).select("node", "n", "score").distinct(), "nodes")
    if nodes.limit(1).count():
        sets = durable(nodes.join(sets_of(nodes.select("node")), "node"), "open-sets")
        compare(stars(durable(open_rows(_rarest_items(sets, percent)), "open")))
    if links is None:
        links = tokens.sparkSession.createDataFrame([], f"a {kind}, b {kind}")
        label = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return label, links


def _rarest_items(sets: DataFrame, percent: int) -> DataFrame:
    """``token, node, n, score, place``: of ``sets(node, n, score, items)``, the items by which linked sets meet. In one order of all
    items, by their number of sets and then by value, two linked sets share one of each one's first n - ceil(n * percent / 100) + 1
    items; those that only one set has are passed over."""
    each = durable(sets.select("node", "n", "score", F.explode("items").alias("token")), "items")
    counts = each.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    own = Window.partitionBy("node")
    place = F.row_number().over(own.orderBy("c", "token")) + F.col("n") - F.count("*").over(own)  # from 1, in the whole set
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return (each.join(counts, "token").withColumn("place", place).where(F.col("place") <= first)
            .select("token", "node", "n", "score", F.col("place").cast("long").alias("place")))
