"""Conversation prefix trie (operator 12).

Conversations become sequences of turn keys (128-bit hashes of role and text;
texts stay behind) and are reduced to distinct sequences with their members'
count, least id and digest. The sequences are range-sorted and cut into shards
of at most ``shard_turns`` turns in that order, however large a range is. A
shard encodes its turns by a dictionary and inserts the sequences, medians
first, into a ternary search tree; an iterative pass accumulates members,
leaves and savings from the last nodes to the first.

In sorted order a node is introduced by the first sequence that has it, so its
sums are sums over shards of what each shard introduces: shards only need to
know how many turns their first and last sequences share with the neighbours.
Nodes whose subtree lies in one shard are final; the boundary nodes, on the
shards' outer paths, are merged by the hash of their path.

Defined results: rows are ordered by turn (null first), role and key, so ties
and repeated rows keep a fixed order and each stays a turn; null roles and
texts are empty; rows without an id belong to no conversation; an empty table
has no node, not even a root; extra columns are not read. The keys of one
conversation (24 bytes a turn) are one value; the digest of a node's ends is
streamed over sorted ids in one task, as a digest over a list is sequential.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railyard.llm.common import batch_of, fields, materialise, mix, prefix, range_hash
from railyard.session import cut_lineage

#: Most turns of a shard (a longer conversation is a shard of its own).
SHARD_TURNS = 1 << 17
#: Turns that range bounds look at, which bounds the sample of them.
RANGE_TURNS = 256
#: Conversations of one base, and most turns taken from it.
FAMILY, BORROWED = 20, 4
#: Parts into which the children of a boundary node are dealt when they look their parent up.
SALT = 32
WORD = r"[^\x20\x09-\x0D]+"

NODE = fields(("key1", pa.int64()), ("key2", pa.int64()), ("up1", pa.int64()), ("up2", pa.int64()), ("depth", pa.int64()), ("conv_id", pa.int64()),
              ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
              ("ends", pa.string()))


# --- sequences ------------------------------------------------------------------


def sequences(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """(id, turns: array of (k1, k2, words)) of every conversation in order."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_column, text_column))
    rows = turns.where(F.col(f"`{id_column}`").isNotNull()).select(
        F.col(f"`{id_column}`").cast("long").alias("id"), F.struct(
            F.col(f"`{turn_column}`").alias("turn"), role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("k1"), F.xxhash64(F.lit(2), text, role).alias("k2"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("t"))
    ordered = rows.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("id", F.transform("t", lambda t: F.struct(t["k1"], t["k2"], t["words"])).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Every conversation with its first h turns replaced by those of its base."""
    base = conversations.where(F.col("id") % FAMILY == 0).select(F.col("id").alias("base"), F.slice("turns", 1, BORROWED - 1).alias("head"))
    h = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(BORROWED)).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    with_base = conversations.withColumn("base", F.col("id") - F.col("id") % FAMILY).join(base, "base", "left")
    return with_base.select("id", F.concat(F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0)), own).alias("turns"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s1, s2, members, least id, digest of the ids) from ids sorted within (s1, s2)."""
    out = fields(("s1", pa.int64()), ("s2", pa.int64()), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string()))
    at, n, least, state = None, 0, None, None
    for batch in batches:
        done = []
        for s1, s2, ident in zip(*(batch.column(c).to_pylist() for c in ("s1", "s2", "id"))):
            if (s1, s2) != at:
                if at is not None:
                    done.append((*at, n, least, state.hexdigest()))
                at, n, least, state = (s1, s2), 0, ident, hashlib.sha256()
            state.update(f",{ident}".encode() if n else str(ident).encode())
            n += 1
        if done:
            yield batch_of(out, *map(list, zip(*done)))
    if at is not None:
        yield batch_of(out, *([v] for v in (*at, n, least, state.hexdigest())))


def distinct(conversations: DataFrame) -> DataFrame:
    """Distinct sequences: keys, words, n members, least id, digest of the ids."""
    keyed = conversations.select("id", F.transform("turns", lambda t: F.struct(t["k1"], t["k2"])).alias("keys"), F.transform("turns", lambda t: t["words"]).alias("words"))
    keyed = materialise(keyed.select(F.xxhash64(F.lit(1), "keys").alias("s1"), F.xxhash64(F.lit(2), "keys").alias("s2"), "*"))
    one = keyed.groupBy("s1", "s2").agg(F.first(F.struct("keys", "words")).alias("one"))
    ends = keyed.select("s1", "s2", "id").repartition("s1", "s2").sortWithinPartitions("s1", "s2", "id")
    ends = ends.mapInArrow(_ends, "s1 long, s2 long, n long, least long, ends string")
    return one.join(ends, ["s1", "s2"]).select("one.keys", "one.words", "n", "least", "ends")


# --- one shard ------------------------------------------------------------------


class Sequence:
    """A distinct sequence: its keys (two columns), words per turn, members, least id, digest."""

    __slots__ = ("ends", "k1", "k2", "least", "n", "words")

    def __init__(self, k1: np.ndarray, k2: np.ndarray, words: np.ndarray, n: int, least: int, ends: str) -> None:
        self.k1, self.k2, self.words, self.n, self.least, self.ends = k1, k2, words, n, least, ends

    def shared(self, other: Sequence) -> int:
        """Turns that both start with."""
        m = min(len(self.k1), len(other.k1))
        differ = np.flatnonzero((self.k1[:m] != other.k1[:m]) | (self.k2[:m] != other.k2[:m]))
        return int(differ[0]) if len(differ) else m

    def path_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """128-bit hashes of the first 0, 1, .. turns."""
        end = np.arange(len(self.k1) + 1)
        zero = np.zeros(len(end), np.int64)
        return tuple(range_hash(prefix(mix(k.view(np.uint64))), zero, end).view(np.int64) for k in (self.k1, self.k2))


def _codes(shard: list[Sequence]) -> list[list[int]]:
    """Sequences of dictionary codes, which keep the order of the keys."""
    k1, k2 = (np.concatenate([getattr(s, c) for s in shard]) for c in ("k1", "k2"))
    order = np.lexsort((k2, k1))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new) - 1
    ends = np.cumsum([len(s.k1) for s in shard])
    return [code[e - len(s.k1) : e].tolist() for s, e in zip(shard, ends.tolist())]


def medians(n: int) -> Iterator[int]:
    """0 .. n - 1, the median of every interval before its halves."""
    waiting = [(0, n)]
    while waiting:
        a, b = waiting.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            waiting += [(m + 1, b), (a, m)]


def shard_nodes(shard: list[Sequence], before: int, after: int) -> pa.RecordBatch:
    """The nodes of one shard of sorted sequences. ``before`` and ``after`` say
    how many turns its first and last sequences share with the neighbouring
    shards' (-1: no neighbour)."""
    symbol, low, high, below, up, depth, words = [-1], [0], [0], [0], [-1], [0], [0]  # node 0 is the root
    codes = _codes(shard)
    last_of, left, right = [0] * len(shard), [0], [0]
    for i in medians(len(shard)):
        at, path = 0, []
        for d, code in enumerate(codes[i]):
            node, link, place = below[at], below, at
            while node and symbol[node] != code:
                link, place = (low, node) if code < symbol[node] else (high, node)
                node = link[place]
            if not node:
                node = len(symbol)
                link[place] = node
                symbol.append(code), low.append(0), high.append(0), below.append(0), up.append(at), depth.append(d + 1), words.append(int(shard[i].words[d]))
            at = node
            path.append(node)
        last_of[i] = at
        if i == 0:
            left += path
        if i == len(shard) - 1:
            right += path
    m = len(symbol)
    members, least, ends = [0] * m, [None] * m, [None] * m
    for s, node in zip(shard, last_of):
        members[node], least[node], ends[node] = s.n, s.least, s.ends
    elsewhere = set(left[: before + 1])  # introduced by an earlier shard
    goes_on = last_of[-1] if after == len(shard[-1].k1) else -1  # its children are in the next shard
    children, leaves, saved = [0] * m, [0] * m, [0] * m
    for node in range(m - 1, -1, -1):  # a node's children come after it
        if not below[node] and node != goes_on:
            leaves[node] = 1
        saved[node] += (members[node] - (node not in elsewhere)) * words[node]
        top = up[node]
        if top >= 0:
            members[top] += members[node]
            least[top] = least[node] if least[top] is None else min(least[top], least[node])
            leaves[top] += leaves[node]
            saved[top] += saved[node]
            children[top] += node not in elsewhere
    key1, key2 = [None] * m, [None] * m
    for path, upto, s in ((left, before, shard[0]), (right, after, shard[-1])):
        if upto >= 0:
            hashes = s.path_hashes()
            for d, node in enumerate(path[: upto + 1]):
                key1[node], key2[node] = int(hashes[0][d]), int(hashes[1][d])
    above = [max(t, 0) for t in up]
    return batch_of(NODE, key1, key2, [None if t < 0 else key1[t] for t in up], [None if t < 0 else key2[t] for t in up], depth, least,
                    [None if t < 0 else least[a] for t, a in zip(up, above)], members, children, leaves, saved, ends)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Sequence]]:
    for batch in batches:
        keys, words = batch.column("keys"), batch.column("words")
        off, woff = (np.asarray(c.offsets) for c in (keys, words))
        k1, k2 = (np.asarray(keys.values.field(i)) for i in (0, 1))
        w = np.asarray(words.values)
        rest = [batch.column(c).to_pylist() for c in ("n", "least", "ends", "range")]
        for i, (n, least, ends, part) in enumerate(zip(*rest)):
            yield part, Sequence(k1[off[i] : off[i + 1]], k2[off[i] : off[i + 1]], w[woff[i] : woff[i + 1]], n, least, ends)


# --- the trie ---------------------------------------------------------------------


def _common(a: str, b: str) -> Column:
    """Length of the common prefix of two key arrays, -1 where one is null."""
    same = F.zip_with(a, b, lambda x, y: x.isNotNull() & y.isNotNull() & (x == y))
    differ = F.array_position(same, False).cast("long")
    return F.when(F.col(a).isNull() | F.col(b).isNull(), -1).otherwise(F.when(differ > 0, differ - 1).otherwise(F.size(same)))


def trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, ranges: int | None = None) -> DataFrame:
    """One row per distinct prefix of the conversations' sequences (id, turns)."""
    spark = conversations.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = distinct(conversations).repartitionByRange(n, F.slice("keys", 1, RANGE_TURNS)).sortWithinPartitions("keys")
    ranged = cut_lineage(ranged.withColumn("range", F.spark_partition_id()))  # bounds are sampled: one evaluation only
    # first and last sequence of every range against the neighbours': one small row a range
    outer = ranged.groupBy("range").agg(F.min("keys").alias("first"), F.max("keys").alias("last"))
    w = Window.orderBy("range")
    outer = outer.select("range", "first", "last", F.lag("last").over(w).alias("previous"), F.lead("first").over(w).alias("next"))
    border = {r["range"]: (r.before, r.after) for r in outer.select("range", _common("previous", "first").alias("before"), _common("last", "next").alias("after")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, turns, before, part = [], 0, -1, None
        for part, s in _read(batches):
            if not shard:
                before = border[part][0]
            elif turns + len(s.k1) > shard_turns:
                after = shard[-1].shared(s)
                yield shard_nodes(shard, before, after)
                shard, turns, before = [], 0, after
            shard.append(s)
            turns += len(s.k1) + 1
        if shard:
            yield shard_nodes(shard, before, border[part][1])

    kinds = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in NODE)
    return _merged(materialise(ranged.mapInArrow(run, kinds)))


def _merged(parts: DataFrame) -> DataFrame:
    """Boundary nodes summed over their shards, and every node with its parent's least id."""
    numbers = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    boundary = parts.where("key1 is not null").groupBy("key1", "key2", "depth").agg(
        F.first("up1").alias("up1"), F.first("up2").alias("up2"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in numbers], F.max("ends").alias("ends"))
    boundary = materialise(boundary)
    inner = parts.where("key1 is null")
    shown = ["conv_id", "depth", "parent_conv_id", *numbers, "ends"]
    known = inner.where("up1 is null").select(*shown).unionByName(
        boundary.where("up1 is null").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*shown))
    asking = inner.where("up1 is not null").drop("parent_conv_id", "key1", "key2").unionByName(boundary.where("up1 is not null").drop("key1", "key2"))
    # a boundary node may have any number of children: they are dealt over SALT copies of its row
    asking = asking.withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALT)))
    parents = boundary.select(F.col("key1").alias("up1"), F.col("key2").alias("up2"), F.col("depth") + 1, F.col("conv_id").alias("parent_conv_id"),
                              F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long")))).toDF("up1", "up2", "depth", "parent_conv_id", "salt")
    return known.unionByName(asking.join(parents, ["up1", "up2", "depth", "salt"]).select(*shown))


def digest(turns: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    nodes = trie(rebuilt(sequences(turns)))
    return nodes.withColumn("ends_sha256", F.coalesce("ends", F.sha2(F.lit(""), 256))).drop("ends")


DIGEST_SQL = r"""
WITH ordered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM ordered)),
whole AS (
  SELECT crc.conv_id, place, role, text FROM crc JOIN ordered ON ordered.conv_id = crc.base AND place < h
  UNION ALL SELECT conv_id, place, role, text FROM crc JOIN ordered USING (conv_id) WHERE place >= h),
turns AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(md5(length(role) || ':' || role || text), '') OVER w AS path,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM whole WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
steps AS (
  SELECT conv_id, depth, path, words FROM turns UNION ALL SELECT conv_id, 0, '', 0 FROM crc),
ending AS (
  SELECT depth, path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, max(depth) AS depth, max_by(path, depth) AS path FROM steps GROUP BY conv_id) GROUP BY depth, path),
nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM steps GROUP BY depth, path),
kids AS (
  SELECT depth - 1 AS depth, substr(path, 1, 32 * (depth - 1)::INT) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
subtree AS (
  SELECT level AS depth, substr(path, 1, 32 * level::INT) AS path, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT n.*, n_children, unnest(range(0, n.depth + 1)) AS level FROM nodes n LEFT JOIN kids k ON k.depth = n.depth AND k.path = n.path) GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN subtree s ON s.depth = n.depth AND s.path = n.path
LEFT JOIN kids k ON k.depth = n.depth AND k.path = n.path LEFT JOIN ending e ON e.depth = n.depth AND e.path = n.path
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = substr(n.path, 1, 32 * (n.depth - 1)::INT)
"""
