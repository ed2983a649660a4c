"""Near-duplicates by the chosen-path set-similarity join, then connected components.

Each distinct set of word shingles has a signature of minwise values. A tree starts with all
sets in one node; a node picks some signature places (by a hash of its path), and each set goes
to one child for each picked place, named by the value it has there. Sets that are alike meet
again and again, others part. A small node compares all its sets with each other; a larger one
compares them with its smallest id and branches on. Independent trees are repeated to the wanted
recall. Nodes still large at the deepest level whose sets the links have made one component need
nothing more; in the others, the sets outside of the node's largest component look for partners by
their rarest shingles (a prefix filter, which loses nothing). Comparisons go first by a 128-bit
sketch whose bound lies five standard deviations below the threshold, then every link is confirmed
on full sets of 64-bit shingle hashes (two texts of 10,000 words meet by a wrong hash with 5e-12).

With two places a node and trees = 8, a pair right at similarity 0.75 is missed by a tree with
probability q = (1/4 + 3q/4)**2, q < 0.12, so by all trees with about 4e-8.

Joins of tables that grow with the corpus are merge joins at every size: a broadcast that Spark
chooses for a small input would not be there for a large one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import bounded, delete_written, quoted, release, slices, written

PLACES = 128
#: Bits of a set's parity sketch: two sketches differ in at most as many bits as the sets in items.
ODD_BITS = 1024
SMALL = 8
_C = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C[1]
    x = (x ^ (x >> np.uint64(27))) * _C[2]
    return x ^ (x >> np.uint64(31))


def _family() -> tuple[np.ndarray, np.ndarray]:
    base = _mix(np.arange(1, 2 * PLACES + 1, dtype=np.uint64) * _C[0])
    return (base[:PLACES] >> np.uint64(32)).astype(np.uint32), (base[PLACES:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_sets(texts: pa.Array, words_each: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its runs of ``words_each`` words.

    A-Z are lower-cased; words are cut at ASCII white space; a shorter text is one run."""
    import xxhash

    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    borders = split.offsets.to_numpy() - split.offsets[0].as_py()
    coded = split.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
    index = coded.indices.to_numpy()
    if "" in names:  # from white space at either end
        full = index != names.index("")
        at = np.concatenate([[0], np.cumsum(full)])
        index, borders = index[full], at[borders]
    h = hashed[index] if len(index) else np.zeros(0, np.uint64)
    k = words_each
    runs = h[: max(len(h) - k + 1, 0)].copy()
    with np.errstate(over="ignore"):
        for j in range(1, k):
            runs = runs * _C[0] + h[j : j + len(runs)]
        runs = _mix(runs)
        out = []
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(runs[a : b - k + 1]))
            elif b > a:
                one = np.array([_C[3] * np.uint64(b - a)], np.uint64)
                for j in range(a, b):
                    one = one * _C[0] + h[j]
                out.append(_mix(one))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


FEATURES = "doc_id long, n long, h1 long, h2 long, s1 long, s2 long, sig array<int>"


def _features(words_each: int):
    xor, times = _family()

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                sets = shingle_sets(part.column(1), words_each)
                sig = np.zeros((len(sets), PLACES), np.uint32)
                h1, h2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                with np.errstate(over="ignore"):
                    for i, s in enumerate(sets):
                        if len(s):
                            h1[i], h2[i] = _mix(s ^ _C[2]).sum(), _mix(s ^ _C[3]).sum()
                            low = (s >> np.uint64(32)).astype(np.uint32)
                            best = None
                            for a in range(0, len(low), 1024):
                                found = ((low[a : a + 1024, None] ^ xor) * times).min(0)
                                best = found if best is None else np.minimum(best, found)
                            sig[i] = best
                bits = np.packbits((sig >> np.uint32(7)).astype(np.uint8) & 1, axis=1).view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(sets) + 1) * PLACES, PLACES, dtype=np.int32)), pa.array(sig.view(np.int32).ravel()))
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(np.ascontiguousarray(bits[:, 0])), pa.array(np.ascontiguousarray(bits[:, 1])), flat], ["doc_id", "n", "h1", "h2", "s1", "s2", "sig"])

    return run


def _sets(words_each: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                sets = shingle_sets(part.column(1), words_each)
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                flat = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))
                column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)
                odd = np.zeros((len(sets), ODD_BITS), np.uint8)
                for i, s in enumerate(sets):
                    odd[i] = np.bincount((s % np.uint64(ODD_BITS)).astype(np.int64), minlength=ODD_BITS) & 1
                words = np.ascontiguousarray(np.packbits(odd, axis=1)).view(np.int64).ravel()
                parity = pa.ListArray.from_arrays(pa.array(np.arange(0, len(words) + 1, ODD_BITS // 64, dtype=np.int32)), pa.array(words))
                yield pa.RecordBatch.from_arrays([part.column(0), column, parity], ["doc_id", "items", "odd"])

    return run


def _children(node: Column, sig: Column) -> Column:
    """The children of a set in ``node``: two places, chosen by the path alone."""
    first = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(PLACES))
    second = F.pmod(first + 1 + F.pmod(F.xxhash64(node, F.lit(2)), F.lit(PLACES - 1)), F.lit(PLACES))
    child = lambda at: F.xxhash64(node, at, F.get(sig, at.cast("int")))
    return F.array(child(first), child(second))


def _alike(threshold: int, a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two sets may reach ``threshold`` percent, by their sizes and sketches."""
    j = threshold / 100
    share = (1 + j) / 2
    least = int(PLACES * share - 5.2 * (PLACES * share * (1 - share)) ** 0.5)
    differ = F.bit_count(a["s1"].bitwiseXOR(b["s1"])) + F.bit_count(a["s2"].bitwiseXOR(b["s2"]))
    return (100 * F.least(a["n"], b["n"]) >= threshold * F.greatest(a["n"], b["n"])) & (differ <= PLACES - least)


def _level(rows: DataFrame, threshold: int) -> DataFrame:
    """Of (node, doc_id, n, s1, s2): each set's partners in its node, and whether the node is large."""
    names = ("doc_id", "n", "s1", "s2")
    node = Window.partitionBy("node")
    order = node.orderBy("doc_id")
    me = {c: F.col(c) for c in names}
    x = rows.withColumn("count", F.count("*").over(node)).withColumn("head", F.first(F.struct(*names)).over(order))
    partners = []
    for k in range(1, SMALL):
        other = F.lag(F.struct(*names), k).over(order)
        x = x.withColumn(f"p{k}", other)
        them = {c: F.col(f"p{k}.{c}") for c in names}
        partners.append(F.when((F.col("count") <= SMALL) & F.col(f"p{k}").isNotNull() & _alike(threshold, me, them), them["doc_id"]))
    head = {c: F.col(f"head.{c}") for c in names}
    partners.append(F.when((F.col("count") > SMALL) & (head["doc_id"] != F.col("doc_id")) & _alike(threshold, me, head), head["doc_id"]))
    x = x.where("count > 1").select("node", "doc_id", (F.col("count") > SMALL).alias("large"), F.array_distinct(F.array_compact(F.array(*partners))).alias("partners"))
    return x.where(F.col("large") | (F.size("partners") > 0))


def chosen_path_pairs(sets: DataFrame, threshold: int, trees: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a < b) of ``sets``, and (node, doc_id) of the nodes still large at the end."""
    rows = sets.select("doc_id", "n", "s1", "s2", F.explode(F.flatten(F.array(*[_children(F.lit(t).cast("long"), F.col("sig")) for t in range(trees)]))).alias("node"))
    small = sets.select("doc_id", "n", "s1", "s2", "sig")
    levels, pairs = [], None
    for d in range(depth):
        levels.append(written(_level(rows, threshold), "nodes"))
        found = levels[-1].select(F.explode("partners").alias("a"), F.col("doc_id").alias("b"))
        pairs = found if pairs is None else pairs.unionByName(found)
        large = levels[-1].where("large").select("node", "doc_id")
        if d == depth - 1 or large.isEmpty():
            break
        rows = large.join(small.hint("merge"), "doc_id").select("doc_id", "n", "s1", "s2", F.explode(_children(F.col("node"), F.col("sig"))).alias("node"))
    pairs, large = written(pairs.distinct(), "pairs"), written(large, "large")
    delete_written(*levels)
    return pairs, large


def confirmed(pairs: DataFrame, items: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose full sets reach ``threshold`` percent."""
    a = items.select(F.col("doc_id").alias("a"), F.col("items").alias("of_a"))
    b = items.select(F.col("doc_id").alias("b"), F.col("items").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - both
    return pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where(100 * both >= threshold * union).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each linked id reaches.

    Alternates large and small stars; the edges of each turn are written to the shared folder,
    and turns end when they no longer change. Smallest neighbours are written before they are
    joined, so that the rows of a hub come straight from a shuffle and can be split over tasks."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    stamp = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "links")
        wide = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        wide = written(wide, "links")
        least = written(wide.groupBy("u").agg(F.min("v").alias("m")), "links")
        near = wide.join(least.hint("merge"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        turned = written(near.distinct(), "links")
        delete_written(edges, low, wide, least)
        edges = turned
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if stamp == now:
            out = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
            out.written_at = edges.written_at
            return out
        stamp = now


def _rest(links: DataFrame, large: DataFrame, sets: DataFrame, items: DataFrame, threshold: int) -> DataFrame:
    """Components after comparing what the large nodes hold, exactly.

    A node whose sets are one component already needs nothing. In the others, each set outside of
    the node's largest component still looks for partners. In a common order, rare shingles first,
    two sets of n <= m shingles that reach a threshold t share t / (1 + t) * (n + m) of them or
    more, so the first one they share lies among the first n - 2 t / (1 + t) * n + 1 of the smaller
    set and among the first m - t * m + 1 of the other. Each pair is therefore sought with one side
    cut down to its ``first`` shingles: what a template gives to all its documents is not among
    these unless it is nearly enough for a link by itself, so its holders don't all meet."""
    labels = components(links)
    if large.isEmpty():
        return labels
    named = labels.withColumnRenamed("id", "doc_id")
    # one exchange by node serves all windows: how many of a node are of each component, and which is its main one
    x = large.join(named.hint("merge"), "doc_id", "left").select("node", "doc_id", F.coalesce("component", "doc_id").alias("c")).repartition("node")
    node = Window.partitionBy("node")
    x = x.withColumn("kin", F.count("*").over(Window.partitionBy("node", "c")))
    x = x.withColumn("main", F.max(F.struct("kin", (-F.col("c")).alias("neg"))).over(node)).withColumn("other", F.min("c").over(node) != F.max("c").over(node))
    x = x.where("other").select("doc_id", (F.col("c") != -F.col("main.neg")).alias("looks"))
    members = written(x.groupBy("doc_id").agg(F.max("looks").alias("looks")), "members")
    if members.isEmpty():
        delete_written(members)
        return labels
    rows = items.join(members.hint("merge"), "doc_id").join(sets.select("doc_id", "n", "s1", "s2").hint("merge"), "doc_id")
    rows = rows.join(named.hint("merge"), "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id"))
    tokens = rows.select("doc_id", "n", "s1", "s2", "c", "looks", F.explode("items").alias("item"))
    tokens = tokens.withColumn("holding", F.count("*").over(Window.partitionBy("item")))
    tokens = tokens.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("holding", "item")))
    rare = tokens.where((F.col("holding") > 1) & (F.col("place") <= F.col("n") - F.expr(f"({threshold} * n + 99) div 100") + 1))
    first = F.col("place") <= F.col("n") - F.expr(f"({2 * threshold} * n + {99 + threshold}) div {100 + threshold}") + 1
    rare = rare.select("doc_id", "n", "s1", "s2", "c", "looks", "item", "place", first.alias("first")).join(items.select("doc_id", "odd").hint("merge"), "doc_id")
    rare = written(rare, "rare")
    names = ("n", "s1", "s2", "c", "place", "odd")
    mine, theirs = {c: F.col(c) for c in names}, {c: F.col(f"l_{c}") for c in names}
    left = rare.where("looks").select("item", F.col("doc_id").alias("leader"), F.col("first").alias("l_first"), *[F.col(c).alias(f"l_{c}") for c in names])
    # sets of one component need no link; what can still be shared from here on must reach the threshold
    most = F.least(mine["place"], theirs["place"]) + F.least(mine["n"] - mine["place"], theirs["n"] - theirs["place"])
    enough = (100 + threshold) * most >= threshold * (mine["n"] + theirs["n"])
    differ = sum((F.bit_count(F.get("odd", F.lit(i)).bitwiseXOR(F.get("l_odd", F.lit(i)))) for i in range(ODD_BITS // 64)), F.lit(0))
    close = (100 + threshold) * differ <= (100 - threshold) * (mine["n"] + theirs["n"])
    near = (F.col("c") != F.col("l_c")) & enough & _alike(threshold, mine, theirs) & close
    smaller = left.where("l_first").join(rare.hint("merge"), "item").where("l_n <= n").where(near)
    larger = left.join(rare.where("first").hint("merge"), "item").where("l_n > n").where(near)
    met = smaller.select("doc_id", "leader").unionByName(larger.select("doc_id", "leader"))
    new = written(met.select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")).distinct(), "pairs")
    found = written(confirmed(new, items, threshold), "confirmed")
    if not found.isEmpty():
        again = components(links.unionByName(found))
        delete_written(labels)
        labels = again
    delete_written(members, rare, new, found)
    return labels


def near_duplicates(docs: DataFrame, *, words_each: int = 5, threshold: int = 75, trees: int = 8, depth: int = 5) -> DataFrame:
    """Group ``docs`` (doc_id, text) by similarity of at least ``threshold`` percent, link by link.

    Returns doc_id, n_shingles, component_id (the smallest doc_id that it reaches) and kept
    (doc_id = component_id). Copies share one set; only distinct sets are joined.

    A null, empty or blank text has no shingles and is linked with nothing. A null id is linked
    with nothing, has a null component and is kept. Rows that share an id share its component.
    Whole texts count, however long. Other columns are left out; an empty table gives no rows."""
    spark = docs.sparkSession
    bounded(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    features = written(rows.mapInArrow(_features(words_each), FEATURES), "features")
    linkable = features.where("n > 0 and doc_id is not null")
    classes = written(linkable.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    # a representative's row; an id with several texts has a class for each
    sets = linkable.join(classes.select("h1", "h2", F.col("rep").alias("doc_id")).hint("merge"), ["doc_id", "h1", "h2"], "left_semi").dropDuplicates(["doc_id", "h1", "h2"])
    sets = written(sets.select("doc_id", "n", "s1", "s2", "sig"), "sets")
    pairs, large = chosen_path_pairs(sets, threshold, trees, depth)
    release(spark)
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).unionByName(large.select("doc_id")).distinct()
    items = written(rows.join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets(words_each), "doc_id long, items array<long>, odd array<long>"), "items")
    release(spark)
    links = written(confirmed(pairs, items, threshold), "confirmed")
    labels = _rest(links, large, sets, items, threshold)
    named = classes.join(labels.withColumnRenamed("id", "rep").hint("merge"), "rep", "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("component"))
    told = features.select("doc_id", "n", "h1", "h2")
    none = told.where("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("component"))
    met = told.where("n > 0").join(named.hint("merge"), ["h1", "h2", "n"], "left").select("doc_id", "n", "component").unionByName(none)
    out = written(met, "components")
    delete_written(features, classes, sets, pairs, large, items, links, labels)
    release(spark)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_each(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with all its columns, one document of each group of near-duplicates: the smallest id.

    Of rows with the same id and text one stays; rows that share an id but not a text stay or go
    together. Rows with a null id all stay."""
    kept = near_duplicates(docs, **how).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.join(kept.hint("merge"), "doc_id", "left_semi").select(F.struct(*quoted(docs)).alias("row"))
    same = Window.partitionBy("row.doc_id").orderBy("text_hash")
    hashed = named.withColumn("text_hash", F.xxhash64("row.text"))
    first = ~F.lag("text_hash").over(same).eqNullSafe(F.col("text_hash"))
    named = hashed.withColumn("is_first", first).where("is_first").select(*[F.col(f"row.`{c}`") for c in docs.columns])
    return named.unionByName(docs.where("doc_id is null"))
