"""Near-duplicate detection by a chosen-path set similarity join (operator 8).

A document is its set of distinct 5-word shingles. Equal sets are one class
(copies are never compared). In each of several independent trees a class
follows the path of its minwise shingles, each chosen by a hash that depends on
the path so far. A node of at most ``SMALL`` classes is a leaf and is compared
exhaustively on full sets inside one task; a larger node branches further, down
to ``DEPTH``. Two sets of similarity s stay together with probability s**DEPTH
at least, and the number of trees follows from the target recall.

A node that is still large at the full depth (a family of many near copies) is
cut into blocks. First every block is compared together with a few hubs of the
node; the links found join most of the family. Then the blocks, ordered by what
is joined so far, are compared pair by pair, leaving out pairs of blocks that
are one component already: nothing is dropped, and no pairs are emitted, only
links that join something.

Defined results: texts without words (null, empty, blank) have an empty set and
are linked with nothing; shorter texts are one shingle; the component is the
smallest id, nulls last; repeated rows are copies of each other; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from railyard.llm.common import SPACE, U64, batch_of, materialise, mix, prefix, range_hash, release, signed, slices, text_bytes, word_hashes, word_spans

SHINGLE = 5
#: Similarity threshold as a fraction: intersection * 100 >= union * 75.
PERCENT = 75
RECALL = 0.9999
DEPTH = 2
#: Trees after which what is linked is joined, so that later leaves can be skipped.
FIRST_TREES = 3
#: Largest node that is compared at once.
SMALL = 256
HUBS = 8
#: Classes of a block when the blocks of a large node are compared pair by pair.
BLOCK = 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def n_trees(recall: float = RECALL, percent: int = PERCENT, depth: int = DEPTH) -> int:
    """Trees needed so that a pair at the threshold meets in a leaf with the target probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** depth))


def shingle_sets(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows, row bounds into them)."""
    raw = _LOWER[raw]
    start, end, bound = word_spans(raw, off, SPACE)
    sums = prefix(mix(word_hashes(raw, start, end)))
    n = np.diff(bound)
    sets = []
    for a, b in zip(bound[:-1], bound[1:]):
        if b - a <= SHINGLE:
            sets.append(range_hash(sums, np.array([a]), np.array([b])) if b > a else np.zeros(0, U64))
        else:
            sets.append(None)
    at = np.arange(max(0, len(start) - SHINGLE + 1))
    every = range_hash(sums, at, at + SHINGLE) if len(at) else np.zeros(0, U64)
    for i in range(len(n)):
        if sets[i] is None:
            sets[i] = np.unique(every[bound[i] : bound[i + 1] - SHINGLE + 1])
    return (np.concatenate(sets) if sets else np.zeros(0, U64)), np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def paths(shingles: np.ndarray, bound: np.ndarray, trees: int, depth: int = DEPTH) -> np.ndarray:
    """(rows, trees, depth) node names along each row's path; rows must not be empty."""
    size = np.diff(bound)
    out = np.zeros((len(size), trees, depth), U64)
    for t in range(trees):
        path = np.full(len(size), mix(np.array([t + 1], U64))[0])
        for d in range(depth):
            chosen = np.minimum.reduceat(mix(shingles ^ np.repeat(path, size)), bound[:-1])
            path = mix(path + chosen)
            out[:, t, d] = path
    return out


def links(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sorted sets with 100 * intersection >= percent * union."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if both and 100 * both >= percent * (size.sum() - both) else []
    member = np.repeat(np.arange(n), size)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, member = values[order], member[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    column = np.cumsum(new) - 1
    several = np.bincount(column)[column] > 1
    column, member = column[several], member[several]
    if not len(column):
        return []
    column = np.unique(column, return_inverse=True)[1]
    shared = np.zeros((n, n), np.float32)
    step = max(256, (4 << 20) // n)
    for a in range(0, int(column[-1]) + 1, step):
        on = slice(np.searchsorted(column, a), np.searchsorted(column, a + step))
        part = np.zeros((n, step), np.float32)
        part[member[on], column[on] - a] = 1
        shared += part @ part.T
    close = 100 * shared >= percent * (size[:, None] + size[None, :] - shared)
    close &= shared > 0
    found, parent = [], np.arange(n)
    for i, j in zip(*np.nonzero(np.triu(close, 1))):
        a, b = i, j
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[max(a, b)] = min(a, b)
            found.append((int(i), int(j)))
    return found


def _sketch(docs: DataFrame, trees: int) -> DataFrame:
    """Per row: id, key, n_shingles, set (two hashes of the shingle set), path (trees * DEPTH node names)."""
    schema = T.StructType([docs.schema["id"], T.StructField("key", T.LongType()), T.StructField("n_shingles", T.LongType()),
                           T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("path", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                raw, off, _ = text_bytes(part.column("text"))
                shingles, bound = shingle_sets(raw, off)
                size = np.diff(bound)
                some = np.flatnonzero(size)
                a, b = np.zeros(len(size), U64), np.zeros(len(size), U64)
                way = np.zeros((len(size), trees * DEPTH), U64)
                if len(some):
                    inner = np.append(bound[:-1][some], bound[-1])
                    a[some] = np.add.reduceat(mix(shingles ^ U64(0x9D8A7B6C5E4F3A21)), inner[:-1])
                    b[some] = np.add.reduceat(mix(shingles + U64(0x1F83D9ABFB41BD6B)), inner[:-1]) + size[some].astype(U64)
                    way[some] = paths(shingles, inner, trees).reshape(len(some), -1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * trees * DEPTH, pa.int32()), signed(way.ravel()))
                yield batch_of(arrow, part.column("id"), part.column("key"), size, signed(a), signed(b), lists.cast(arrow.field("path").type))

    return docs.mapInArrow(run, schema)


def _sets(docs: DataFrame) -> DataFrame:
    """class -> sorted shingle set as bytes, from (class, text) rows."""
    schema = T.StructType([T.StructField("class", T.LongType()), T.StructField("shingles", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                raw, off, _ = text_bytes(part.column("text"))
                shingles, bound = shingle_sets(raw, off)
                yield batch_of(arrow, part.column("class"), [shingles[x:y].tobytes() for x, y in zip(bound[:-1], bound[1:])])

    return docs.select("class", "text").mapInArrow(run, schema)


def _compare(tasks: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) among the classes of each task (a bounded number of classes).

    The rows of a task arrive one after another in one partition; a task is
    compared when the next one begins."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        a, b = [], []

        def finish() -> None:
            ids = list(held)
            for i, j in links([np.frombuffer(held[c], U64) for c in ids]) if len(ids) > 1 else ():
                a.append(ids[i])
                b.append(ids[j])
            held.clear()

        for batch in batches:
            for task, c, s in zip(*(batch.column(k).to_pylist() for k in ("task", "class", "shingles"))):
                if task != now:
                    finish()
                    now = task
                held[c] = s
            if a:
                yield batch_of(arrow, a, b)
                a, b = [], []
        finish()
        yield batch_of(arrow, a, b)

    return (tasks.join(sets, "class").select("task", "class", "shingles").repartition("task").sortWithinPartitions("task")
            .mapInArrow(run, schema).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(class, component) of every class in an edge, component being the least
    class reachable: alternating large-star and small-star rounds until nothing changes."""
    edges = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        last, edges = edges, materialise(small.filter("u <> v").distinct())
        release(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("class"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("class"), "component").distinct())


def _nodes(classes: DataFrame, trees: int) -> DataFrame:
    """(tree, node, class, size), written, of every node in which a class ends, with two
    classes or more: the first small one on its path, or the last one."""
    level = classes.select("class", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.slice("path", t * DEPTH + 1, DEPTH))).alias("tree", "path"))
    done, written = None, []
    for d in range(DEPTH):
        level = level.withColumn("node", F.get("path", F.lit(d)))
        size = level.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        level = materialise(level.join(size, "node"))
        written.append(level)
        ends = (level if d == DEPTH - 1 else level.filter(f"size <= {SMALL}")).select("tree", "node", "class", "size")
        done = ends if done is None else done.unionByName(ends)
        level = level.filter(f"size > {SMALL}").select("class", "tree", "path")
    done = materialise(done)
    release(*written)
    return done


def classes_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, component by class): rows have id, key, n_shingles, class (null for empty sets)."""
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    source = source.withColumn("key", F.xxhash64(F.col("id").cast("string"), F.lit("\t"), "text"))
    trees = n_trees()
    sketch = _sketch(source, trees).withColumn("class", F.when(F.col("n_shingles") > 0, F.xxhash64("set_a", "set_b")))
    sketch = materialise(sketch)
    rows = materialise(sketch.select("id", "key", "n_shingles", "class"))
    classes = sketch.filter("class is not null").groupBy("class").agg(F.min("key").alias("key"), F.first("path").alias("path"))
    nodes = _nodes(classes.select("class", "path"), trees)
    release(sketch)
    wanted = nodes.select("class").distinct()
    one = rows.join(wanted, "class").groupBy("class").agg(F.min("key").alias("key"))
    texts = source.select("key", "text").join(one, "key")
    sets = materialise(_sets(texts).groupBy("class").agg(F.first("shingles").alias("shingles")))

    small, large = nodes.filter(f"size <= {SMALL}"), nodes.filter(f"size > {SMALL}")
    first = _distinct_leaves(small.filter(f"tree < {FIRST_TREES}")).unionByName(_blocks_with_hubs(large))
    edges = materialise(_compare(first, sets))
    joined = materialise(components(edges))  # its own files are small and stay

    # the other trees, without the leaves that are one component already, and what is open in large nodes
    def named(some: DataFrame) -> DataFrame:
        return some.join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))

    rest = named(small.filter(f"tree >= {FIRST_TREES}"))
    unjoined = rest.groupBy("node").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("node")
    second = _distinct_leaves(rest.join(unjoined, "node")).unionByName(_open_blocks(named(large)))
    linked = materialise(edges.unionByName(_compare(second, sets)))
    release(sets, nodes, joined, edges)
    return rows, components(linked)


def _distinct_leaves(leaves: DataFrame) -> DataFrame:
    """(task, class) of leaves, those of the same classes in several trees once."""
    members = leaves.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("a"), F.min("class").alias("b"))
    one = members.groupBy("n", "a", "b").agg(F.min("node").alias("node")).select("node")
    return leaves.join(one, "node").select(F.col("node").alias("task"), "class")


def _blocks_with_hubs(large: DataFrame) -> DataFrame:
    """(task, class): blocks of about SMALL classes of every large node, each with the same few hubs of its node."""
    n_blocks = F.ceil(F.col("size") / SMALL).cast("long")
    blocks = large.select(F.xxhash64("node", F.pmod(F.xxhash64("class", "node"), n_blocks)).alias("task"), "class")
    # a thin draw by hash, of which the first HUBS are taken: bounded whatever the node's size
    drawn = large.filter(F.pmod(F.xxhash64("node", "class"), F.col("size")) < 4 * HUBS)
    hubs = drawn.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("class")), 1, HUBS).alias("hubs"), F.first("size").alias("size"))
    hubs = hubs.select("node", "hubs", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)).alias("block"))
    return blocks.unionByName(hubs.select(F.xxhash64("node", "block").alias("task"), F.explode("hubs").alias("class"))).distinct()


def _open_blocks(large: DataFrame) -> DataFrame:
    """(task, class): pairs of blocks of large nodes that may still hold a link
    between components. Components of half a block and more have blocks of their
    own, the others share blocks; two blocks of one component are no pair."""
    half = BLOCK
    size = large.groupBy("node", "component").agg(F.count("*").alias("c"))
    placed = large.select("node", "class", "component").join(size, ["node", "component"])
    placed = placed.select("node", "class", F.when(F.col("c") >= half, F.col("component")).alias("own"))
    units = (placed.groupBy("node", "own").agg(F.ceil(F.count("*") / half).cast("long").alias("n"))
             .withColumn("unit", F.xxhash64("node", "own")))
    blocks = (placed.join(units, placed["node"].eqNullSafe(units["node"]) & placed["own"].eqNullSafe(units["own"]))
              .select("unit", F.pmod(F.xxhash64("class", "unit"), F.col("n")).alias("block"), "class"))
    x, y = (units.select("node", F.col("own").alias(f"own{k}"), F.col("n").alias(f"n{k}"), F.col("unit").alias(f"unit{k}")) for k in (0, 1))
    pairs = x.join(y, "node").filter("unit0 < unit1 or (unit0 = unit1 and own0 is null)")
    pairs = pairs.select("unit0", "unit1", "n1", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n0") - 1)).alias("b0"))
    pairs = (pairs.select("unit0", "unit1", "b0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n1") - 1)).alias("b1"))
             .filter("unit0 < unit1 or b0 <= b1").withColumn("task", F.xxhash64("unit0", "unit1", "b0", "b1")))
    sides = pairs.select("task", F.explode(F.array(*(F.struct(F.col(f"unit{k}").alias("unit"), F.col(f"b{k}").alias("block")) for k in (0, 1)))).alias("s"))
    return sides.select("task", "s.unit", "s.block").distinct().join(blocks, ["unit", "block"]).select("task", "class").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, key, n_shingles, component (least class; null for empty sets), component_id (smallest id reachable), kept."""
    rows, comps = classes_of(docs, id_column, text_column)
    rows = rows.join(comps, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = rows.filter("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    out = rows.join(least, "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least")))
    return out.select("id", "key", "n_shingles", "component", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def dedupe(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of every component: the one with the smallest id (of
    repeated ids, or where all ids are null, the least text hash; of wholly
    repeated rows, any one)."""
    kept = near_duplicates(docs, id_column, text_column).filter("kept")
    # by the component itself, as ids may be null or stand for several texts; empty sets each by themselves
    alone = F.when(F.col("component").isNull(), F.col("key"))
    one = kept.groupBy("component", alone.alias("alone")).agg(F.min("key").alias("__key")).select("__key")
    key = F.xxhash64(F.col(id_column).cast("string"), F.lit("\t"), F.col(text_column))
    found = docs.withColumn("__key", key).join(one, "__key")
    return found.withColumn("__n", F.row_number().over(Window.partitionBy("__key").orderBy(F.lit(1)))).filter("__n = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")
