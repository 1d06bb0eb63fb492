"""MinHash near-duplicates by a chosen-path set similarity join.

Documents with equal shingle sets are one class. Each of ``TREES`` independent trees branches the classes by
minwise tokens: a node's members share the tokens chosen on the path to it. A node of up to ``SMALL`` members
is compared exhaustively, and so is a larger one in which all but ``SMALL`` members already are one component.
Any other node compares all members with one of them, drawn by the node's own hash, and branches on. So a node
costs in proportion to its members, and a large group of near copies, which no token splits, is held together
by the drawn members of many nodes.

Candidates whose signatures agree too little are put aside (a pair at the threshold falls below ``AGREE``
with a probability under 1e-4), all others are confirmed on their full shingle sets. Trees run in two rounds;
the second starts from the components of the first and proposes only pairs between different ones.

What is left then are roots of more than ``SMALL`` members outside their main component, such as edits of one
original that are not alike among themselves. They are first compared with the member whose signature values
are the most frequent ones, which the original of many edits has. Members of the roots that remain go through an
exact join: of values in the order of their frequency, two signatures that agree ``AGREE`` times share one of the
``WIDTH - AGREE + 1`` rarest, and all members that share one are compared on their full sets, in blocks.

Recall: a pair at a similarity of 0.8 shares the first token of a tree with probability 0.8, so no root holds it
with probability 4e-9; a pair that a root holds is proposed unless its signatures agree too little.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import slices, written

TREES, LEVELS = 12, 5
#: (trees, levels) of each round: roots alone first, which connect most copies with few comparisons.
ROUNDS = ((range(0, 2), 1), (range(2, TREES), LEVELS))
SMALL = 16
AGREE = 36
WIDTH = TREES * LEVELS
#: Shingles of a block of members that the exact join compares in one task with another.
BLOCK_SHINGLES = 1 << 19
#: Links that one task connects at a time.
LINKS = 1 << 19

_RANDOM = np.random.default_rng(20)
_FACTORS = _RANDOM.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _RANDOM.integers(0, 1 << 63, WIDTH, dtype=np.uint64)


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; the whole sequence where there are fewer words."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    used = min(size, len(words))
    found = np.full(len(words) - used + 1, used, np.uint64)
    for i in range(used):
        found = (found ^ hashes[i:len(words) - used + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(32)
    return np.unique(found)


def signature(found: np.ndarray) -> np.ndarray:
    """The smallest value of each of the hash functions."""
    least = np.full(WIDTH, 0xFFFFFFFF, np.uint64)
    for start in range(0, len(found), 4096):
        part = (found[start:start + 4096, None] * _FACTORS + _ADDED) >> np.uint64(32)
        least = np.minimum(least, part.min(0))
    return least.astype(np.uint32).view(np.int32)


def profiles(docs: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_id, signature) of every row; texts without words have no set and no signature."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, sets, signatures = [], [], []
            for value in batch.column("text").cast(pa.binary()).to_pylist():
                found = shingles(value, size)
                counts.append(len(found))
                sets.append(xxhash.xxh3_128_hexdigest(found.tobytes()) if len(found) else None)
                signatures.append(signature(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sets, pa.string()), pa.array(signatures, pa.list_(pa.int32()))],
                names=["doc_id", "n_shingles", "set_id", "signature"])

    return source.mapInArrow(run, "doc_id long, n_shingles long, set_id string, signature array<int>")


def _members(classes: DataFrame, trees: range) -> DataFrame:
    """One row for each class and tree: the node under the root and the tokens of the deeper levels."""
    tree = F.explode(F.array(*[
        F.struct(F.xxhash64(F.lit(t), F.get("signature", F.lit(t * LEVELS))).alias("path"),
                 F.slice("signature", t * LEVELS + 2, LEVELS - 1).alias("tokens")) for t in trees]))
    return classes.select("rep", "component", tree.alias("node")).select("rep", "component", "node.path", "node.tokens")


def candidates(classes: DataFrame, trees: range, levels: int) -> DataFrame:
    """(a, b), a < b: pairs of different components that some tree proposes, each once.

    Paths tell the levels apart, so the nodes of all levels are compared in one join for each kind of node: the
    plan, which the driver holds and makes anew after each of its stages, does not grow with the levels.
    """
    members, smalls, fews, drawn = _members(classes, trees), [], [], []
    for level in range(levels):
        # The drawn member is the one whose id, its bits turned by the node's hash, comes first.
        turned = F.col("rep").bitwiseXOR(F.col("path"))
        nodes = members.groupBy("path").agg(
            F.count("*").alias("n"), F.min(turned).alias("first"), F.min_by("component", turned).alias("main")).filter("n > 1")
        members = members.join(nodes, "path").withColumn("leader", F.col("first").bitwiseXOR(F.col("path")))
        members = written(members.select("rep", "component", "path", "tokens", "n", "leader", "main"))
        smalls.append(members.filter(F.col("n") <= SMALL).select("path", "component", "rep"))
        # In a large node, what the drawn member's component does not hold yet is the rest; without rest it is done.
        large = members.filter(F.col("n") > SMALL)
        rests = large.filter("component <> main").groupBy("path").agg(F.count("*").alias("rest"))
        large = written(large.join(rests, "path"))
        fews.append(large.filter(F.col("rest") <= SMALL).select("path", "component", "rep", "main"))
        many = large.filter(F.col("rest") > SMALL)
        drawn.append(many.filter("component <> main").select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")))
        if level + 1 < levels:
            if many.isEmpty():
                break
            members = many.select("rep", "component", F.xxhash64("path", F.get("tokens", F.lit(level))).alias("path"), "tokens")
    small, few = reduce(DataFrame.unionByName, smalls), reduce(DataFrame.unionByName, fews)
    found = [_proposed(small, small), _proposed(few.filter("component <> main"), few), *drawn]
    return reduce(DataFrame.unionByName, found).distinct()


def _proposed(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of a node's members in different components."""
    left = left.select("path", F.col("rep").alias("x"), F.col("component").alias("cx"))
    right = right.select("path", F.col("rep").alias("y"), F.col("component").alias("cy"))
    return left.join(right, "path").filter("cx <> cy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _agreeing(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose set sizes allow the similarity and whose signatures agree often enough.

    One byte of each signature value travels: equal values stay equal, unequal ones meet once in 256.
    """
    short = F.transform("signature", lambda x: (x.bitwiseAND(F.lit(255)) - 128).cast("tinyint"))
    left = classes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), short.alias("sa"))
    right = classes.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), short.alias("sb"))
    sized = F.least("na", "nb") * 100 >= percent * F.greatest("na", "nb")
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    return pairs.join(left, "a").join(right, "b").filter(sized).filter(same >= AGREE).select("a", "b")


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    pairs = written(pairs)
    sets = _sets(docs, pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))), size, key, text)
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("la"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("lb"))
    shared = F.size(F.array_intersect("la", "lb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", shared.alias("i"), (F.size("la") + F.size("lb")).alias("s"))
    return joined.filter(F.col("i") * 100 >= percent * (F.col("s") - F.col("i"))).select("a", "b").distinct()


def _sets(docs: DataFrame, reps: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(rep, shingles) of the texts under the ids in ``reps``."""
    involved = written(reps.distinct())  # a known size: only where it is too large to send out do whole texts shuffle
    texts = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).cast("string").alias("text")).join(involved, "rep", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingles(v, size).view(np.int64) for v in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(found, pa.list_(pa.int64()))], names=["rep", "shingles"])

    return written(texts.mapInArrow(run, "rep long, shingles array<long>"))


def _unsettled(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of the roots with few members outside the main component; (path, rep, component) of those with many."""
    members = written(members)
    sizes = members.groupBy("path", "component").count()
    main = F.max_by("component", F.struct("count", "component"))
    roots = sizes.groupBy("path").agg(F.sum("count").alias("n"), F.max("count").alias("most"), main.alias("main"))
    roots = roots.withColumn("rest", F.col("n") - F.col("most")).filter((F.col("n") > SMALL) & (F.col("rest") > 0))
    large = written(members.join(roots.select("path", "main", "rest"), "path"))
    few = large.filter(F.col("rest") <= SMALL)
    return _proposed(few.filter("component <> main"), few), large.filter(F.col("rest") > SMALL).select("path", "rep", "component")


def _rarity(classes: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, values, common): the signature values that several of ``reps`` have, as numbers with their counts, the
    rarest first, and the sum of the counts of all values. Values of one alone come before them and have no number.
    """
    position = F.posexplode("signature").alias("at", "value")
    values = classes.join(reps, "rep", "left_semi").select("rep", position).select("rep", F.xxhash64("at", "value").alias("value"))
    values = written(values)
    counted = values.join(values.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1"), "value")
    grouped = counted.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("values"), F.sum("n").alias("common"))
    return written(grouped.withColumn("common", F.col("common") + WIDTH - F.size("values")))


def _with_originals(many: DataFrame, rarity: DataFrame) -> DataFrame:
    """Pairs of each root's members with the one whose signature values are the most frequent."""
    weighed = written(many.join(rarity.select("rep", "common"), "rep"))
    best = F.struct("common", "rep", "component")
    chosen = weighed.groupBy("path").agg(F.max(best).alias("best")).select("path", "best.rep", F.col("best.component").alias("main"))
    joined = weighed.join(chosen.withColumnRenamed("rep", "leader"), "path").filter("component <> main")
    return joined.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()


def _exact(members: DataFrame, rarity: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int, key: str,
           text: str) -> DataFrame:
    """(a, b): links that connect whatever pairs of ``members`` (rep, component) at the threshold connect.

    Members of one prefix value are cut into blocks of about ``BLOCK_SHINGLES``; each two blocks meet in one task.
    They meet with their signatures first, and full sets travel only for members that agree with another one there.
    A task gives no link between members that its former links connect, so its rows are fewer than its members.
    """
    first = F.greatest(F.size("values") - AGREE + 1, F.lit(0))  # what the values of one alone leave of the prefix
    shared = rarity.select("rep", F.explode(F.slice("values", F.lit(1), first)).alias("value"))
    short = F.transform("signature", lambda x: x.bitwiseAND(F.lit(255)).cast("short"))
    sized = classes.join(members, "rep").select("rep", "component", F.col("n_shingles").alias("n"), short.alias("short"))
    shared = written(shared.select("rep", F.col("value.value").alias("value")).join(sized, "rep"))
    groups = shared.groupBy("value").agg(F.sum("n").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    groups = groups.filter("low <> high").select("value", F.ceil(F.col("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    placed = shared.join(groups, "value").withColumn("own", F.pmod(F.xxhash64("rep", "value"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = placed.select("value", "rep", "component", "n", "short", "own", other).select(
        "value", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own", "rep", "component", "n", "short")

    def agreeing(group: pa.Table) -> pa.Table:
        own, first, second, root, n = (group.column(c).to_numpy() for c in ("own", "first", "second", "component", "n"))
        short = group.column("short").combine_chunks().flatten().to_numpy().astype(np.uint8).reshape(-1, WIDTH)
        left, right = np.flatnonzero(own == first), np.flatnonzero(own == second)
        met, sizes, roots = short[right], n[right], root[right]
        kept = np.zeros(len(own), bool)
        for i in left:
            sized = np.minimum(sizes, n[i]) * 100 >= percent * np.maximum(sizes, n[i])
            near = right[sized & (roots != root[i]) & ((met == short[i]).sum(axis=1) >= AGREE)]
            kept[near] = True
            kept[i] |= len(near) > 0
        return group.select(["value", "first", "second", "own", "rep", "component"]).filter(pa.array(kept))

    placed = written(placed.groupBy("value", "first", "second").applyInArrow(
        agreeing, "value long, first int, second int, own int, rep long, component long"))
    sets = _sets(docs, placed.select("rep"), size, key, text)

    def compare(group: pa.Table) -> pa.Table:
        own, first, second = (group.column(c).to_numpy() for c in ("own", "first", "second"))
        reps, root = group.column("rep").to_numpy(), group.column("component").to_numpy().copy()
        found = [np.asarray(v) for v in group.column("shingles").to_numpy()]
        left, right = np.flatnonzero(own == first), np.flatnonzero(own == second)
        lengths = np.array([len(v) for v in found])
        _, numbers = np.unique(np.concatenate(found), return_inverse=True)
        numbers = np.split(numbers, np.cumsum(lengths)[:-1])
        # The holders of each shingle among the right block, shingle by shingle.
        held = np.concatenate([numbers[i] for i in right])
        holders = np.repeat(np.arange(len(right)), lengths[right])[np.argsort(held, kind="stable")]
        ends = np.concatenate(([0], np.cumsum(np.bincount(held, minlength=max(int(n.max()) for n in numbers) + 1))))
        a, b = [], []
        for i in left:
            if (root[right] == root[i]).all():
                continue
            met = np.concatenate([holders[ends[k]:ends[k + 1]] for k in numbers[i]])
            same = np.bincount(met, minlength=len(right))
            near = same * 100 >= percent * (lengths[i] + lengths[right] - same)
            for j in right[near]:
                if root[i] != root[j]:
                    a.append(min(reps[i], reps[j]))
                    b.append(max(reps[i], reps[j]))
                    root[root == root[j]] = root[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    joined = placed.join(sets, "rep")
    return joined.groupBy("value", "first", "second").applyInArrow(compare, "a long, b long").distinct()


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every linked id but the smallest of its component, and that smallest one."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    low = np.arange(len(ids))
    while len(x):
        least, most = np.minimum(low[x], low[y]), np.maximum(low[x], low[y])
        np.minimum.at(low, most, least)  # roots hang on smaller roots
        while (low[low] != low).any():
            low = low[low]
        open_ = low[x] != low[y]
        x, y = x[open_], y[open_]
    hung = np.flatnonzero(low != np.arange(len(ids)))
    return ids[hung], ids[low[hung]]


def components(links: DataFrame) -> DataFrame:
    """(rep, component) of every linked class: the smallest rep reachable.

    Each task first replaces its links, at most ``LINKS`` at a time, by stars around the smallest rep they connect.
    Where there were more links, large and small stars by turns: each step hangs neighbours on the smallest one,
    until every rep hangs on one that hangs on none.
    """
    def both(edges: DataFrame) -> DataFrame:
        return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def smallest(edges: DataFrame) -> DataFrame:
        return edges.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))

    def settled(edges: DataFrame) -> bool:
        roles = edges.select(F.col("a").alias("v"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
            edges.select(F.col("b").alias("v"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        return roles.groupBy("v").agg((F.sum("below") + F.max("above")).alias("n")).filter("n > 1").isEmpty()

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            a, b = _forest(*(np.concatenate([x.column(i).to_numpy() for x in held]) for i in range(2)))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        held, n = [], 0
        for batch in batches:
            if held and n + batch.num_rows > LINKS:
                yield flush()
                held, n = [], 0
            held.append(batch)
            n += batch.num_rows
        if held:
            yield flush()

    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    n = edges.count()
    edges = written(edges.coalesce(max(1, -(-n // LINKS))).mapInArrow(stars, "a long, b long"))
    while n > LINKS and not settled(edges):
        around = both(edges.distinct())
        large = around.join(smallest(around), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.filter("a <> b").distinct())
        lower = smallest(large)
        hung = large.join(lower, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(hung.unionByName(lower.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
    return edges.select(F.col("a").alias("rep"), F.col("b").alias("component"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    Rows linked directly or over others share the smallest id among them; that row is kept. Null, empty and
    wordless texts have no shingles and are linked with nothing. Rows that repeat an id are one document whose
    texts all link; each keeps its row. A row without id has no component and is kept. An empty table gives
    no row, other columns are not read.
    """
    found = written(profiles(docs, size, key, text))
    named = found.filter(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
    reps = written(named.groupBy("set_id").agg(F.min("doc_id").alias("rep")))
    # By both columns the rows of a class already lie together after the join.
    classes = named.join(reps, "set_id").filter("doc_id = rep").dropDuplicates(["set_id", "doc_id"])
    classes = written(classes.select(F.col("doc_id").alias("rep"), "n_shingles", "signature"))
    # Texts under a repeated id belong together: their classes' representatives are linked as they stand.
    repeated = named.join(reps, "set_id").filter("doc_id <> rep").select("doc_id", "rep").distinct()
    several = named.select("doc_id", "set_id").distinct().groupBy("doc_id").count().filter("count > 1").select("doc_id")
    links = repeated.join(several, "doc_id", "left_semi").select(
        F.greatest("doc_id", "rep").alias("a"), F.least("doc_id", "rep").alias("b"))
    labels = components(links)

    def current(reps: DataFrame) -> DataFrame:
        return reps.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    def linked(pairs: DataFrame) -> DataFrame:
        return confirmed(_agreeing(written(pairs), classes, percent), docs, size, percent, key, text)

    def merged(links: DataFrame) -> DataFrame:
        return components(links.unionByName(labels.select(F.col("rep").alias("a"), F.col("component").alias("b"))))

    for trees, levels in ROUNDS:
        labels = merged(linked(candidates(current(classes), trees, levels)))
    few, many = _unsettled(_members(current(classes), range(TREES)).select("path", "rep", "component"))
    if many.isEmpty():
        links = linked(few.distinct())
    else:
        rarity = _rarity(classes, many.select("rep"))
        labels = merged(linked(few.unionByName(_with_originals(many, rarity)).distinct()))
        # Components only grow, so no other root has become a large open one.
        few, many = _unsettled(current(many.select("path", "rep")))
        links = linked(few.distinct())
        if not many.isEmpty():
            members = written(many.select("rep", "component").distinct())
            links = links.unionByName(_exact(members, rarity, classes, docs, size, percent, key, text))
    labels = merged(links)
    named_ids = found.join(reps, "set_id", "left").withColumn("rep", F.coalesce("rep", "doc_id")).join(labels, "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))
    return named_ids.select(
        F.col("doc_id").alias(key), "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates, all its columns: the smallest id; of rows repeating it, one.

    Rows without id stay.
    """
    kept = near_duplicates(docs, size, percent).filter("kept and doc_id is not null").select("doc_id").distinct()
    # Whole rows decide between rows that repeat an id, so that a task run again decides alike.
    chosen = docs.join(kept, "doc_id", "left_semi").withColumn("_row", F.xxhash64(*docs.columns))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("_row"))
    chosen = chosen.withColumn("_first", first).filter("_first = 1").select(*docs.columns)
    return chosen.unionByName(docs.filter(F.col("doc_id").isNull()))
