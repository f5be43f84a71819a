"""Operators 11 to 13 against brute-force versions, and their edge cases."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railyard.llm import importance, line_dedup, prefix_trie
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tuples(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


# --- 11 ------------------------------------------------------------------------


def test_perfect_hash_is_minimal_and_finds_every_key():
    rng = np.random.default_rng(11)
    for n in (0, 1, 2, 1000, 50_000):
        a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
        a[: n // 3] = a[0] if n else 0  # equal first halves are told apart by the second
        sizes, bits, slot = line_dedup.perfect_hash(a, b)
        assert sorted(slot.tolist()) == list(range(n))
        assert (line_dedup.slots(sizes, bits, np.cumsum(bits), a, b) == slot).all()
        others = line_dedup.slots(sizes, bits, np.cumsum(bits), b + np.uint64(1), a)
        assert ((others >= -1) & (others < n)).all()


def brute_lines(rows, least=10):
    key = lambda line: lower_ascii(line.strip(" \t\n\x0b\x0c\r"))
    none = (1 << 63) - 1
    holders = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(none if i is None else i)
    out = collections.Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 2 or min(holders[key(x)]) == (none if i is None else i)]
        out[(i, len(lines), len(lines) - len(kept), sha("\n".join(kept)))] += 1
    return out


def digest11(df, **options):
    out = line_dedup.dedupe(df, **options)
    return tuples(out.select("doc_id", F.col("lines.n_lines").alias("a"), F.col("lines.n_dropped").alias("b"), F.sha2("text", 256).alias("c")), "doc_id", "a", "b", "c")


def test_line_dedup_matches_brute_force(frame, sample):
    rng = random.Random(4)
    common = ["A line that all share", "  a LINE that all share\t", "short", "0123456789", "012345678", "ünïcödé lïne", "\x0b tabs and feeds \x0c", ""]
    rows = sample[:60] + [(5000 + i, "\n".join(rng.choice([*common, f"own line number {rng.randrange(60)}"]) for _ in range(rng.randrange(9)))) for i in range(200)]
    rows += list(enumerate(ODD, 9000)) + [(None, "A line that all share\nfree text here"), (None, "nothing of it shared\nA line that all share"), (9100, "A line that all share"),
                                          (5003, "a second row of one id\nA line that all share"), (9100, "A line that all share")]
    want = brute_lines(rows)
    assert digest11(frame(rows)) == want
    # many shards, many questions a shard
    assert digest11(frame(rows).repartition(7), shard_keys=8, shard_questions=50) == want


def test_line_dedup_keeps_columns_and_takes_empty_tables(spark, frame):
    docs = frame([(1, "the very same line\nmine"), (2, "yours\nthe very same line")]).withColumn("lines", F.lit("x")).withColumn("chunk", F.lit(7)).withColumn("row", F.lit("r"))
    out = line_dedup.dedupe(docs, name="counts")
    assert out.columns == [*docs.columns, "counts"]
    assert {(r.doc_id, r.text, r.lines, r.chunk, r.row) for r in out.collect()} == {(1, "the very same line\nmine", "x", 7, "r"), (2, "yours", "x", 7, "r")}
    assert line_dedup.dedupe(docs).columns == ["doc_id", "text", "lang", "source", "n_chars", "chunk", "row", "lines"]
    assert line_dedup.digest(frame([])).collect() == []


def test_line_dedup_of_a_line_that_most_rows_hold_and_a_very_long_text(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("held by most rows\nrow "), "id"))
                                      .otherwise(F.concat(F.lit("a line of its own "), "id")).alias("text"))
    long = spark.range(1).select(F.lit(30_000).cast("long").alias("doc_id"), F.concat(F.lit("held by most rows\n"), F.repeat(F.lit("word and word again\n"), 300_000)).alias("text"))
    out = line_dedup.digest(docs.unionByName(long))
    assert out.agg(F.sum("n_dropped")).first()[0] == 20_000 - 6_667 - 1 + 1
    assert out.where("doc_id = 30000").select("n_lines", "n_dropped").first() == (300_002, 1)


# --- 12 ------------------------------------------------------------------------

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(own):
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(math.fmod(c, 20))
        whole = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
    return collections.Counter((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], sha(",".join(map(str, ends[p])))) for p, m in members.items())


def nodes(df, **options):
    out = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(df)), **options)
    return tuples(out.withColumn("ends_sha256", F.coalesce("ends", F.sha2(F.lit(""), 256))), *COLUMNS)


def random_turns(rng, n):
    """Few distinct turns, so that prefixes, copies and families of copies meet."""
    return [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "hello there you", "", None])) for c in rng.sample(range(-50, 400), n) for t in range(rng.choice([1, 2, 3, 6]))]


def test_prefix_trie_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select(*TURNS.names).collect()]
    want = brute_trie(rows)
    assert tuples(prefix_trie.digest(spark.createDataFrame(rows, TURNS)), *COLUMNS) == want


def test_prefix_trie_of_any_shards_is_the_same(spark):
    rng = random.Random(12)
    rows = random_turns(rng, 150) + [(None, 0, "user", "no id"), (3, None, "user", "null turns come first"), (3, None, "user", "null turns come first"), (7, 0, "user", "a b")]
    rows += [(c, t, "user", f"copied {t}") for c in range(1000, 1100) for t in range(5)]
    frame = spark.createDataFrame(rows, TURNS).withColumn("id", F.lit(1)).withColumn("keys", F.lit("k"))
    want = nodes(frame, ranges=1)
    ties = [r for r in rows if r[0] not in (3, 7)]
    assert nodes(spark.createDataFrame(ties, TURNS)) == brute_trie(ties)
    for turns, ranges in ((1, 1), (4, 3), (16, 8)):
        assert nodes(frame, shard_turns=turns, ranges=ranges) == want


def test_prefix_trie_borders(spark):
    assert nodes(spark.createDataFrame([], TURNS)) == collections.Counter()
    one = [(1, 0, "user", "x")]  # the only turn of conversation 1 is taken from a base that does not exist, or stays
    assert nodes(spark.createDataFrame(one, TURNS)) == brute_trie(one)
    long = [(40, t, "user", f"w {t % 7}") for t in range(30_000)] + [(41, t, "user", f"w {t % 7}") for t in range(29_990)]
    got = nodes(spark.createDataFrame(long, TURNS), shard_turns=1000)
    assert sum(got.values()) == 30_001
    assert max(k[6] for k in got) == 2 * 29_990


# --- 13 ------------------------------------------------------------------------


def brute_importance(rows, items, least=20, percent=5):
    def feats(t):
        w = ALNUM.findall(lower_ascii(t))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    docs = [(i, *feats(t)) for i, t in rows]
    s, t = collections.Counter(b for _, _, f in docs for b in f), collections.Counter(b for x in items for b in feats(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in s}
    out = []
    for i, n, f in docs:
        h = int(sha(f"42:{'' if i is None else i}")[:8], 16)
        w = sum(gain[b] for b in f)
        out.append((i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    rest = [r for r in out if r[1] < least]
    drawn = percent * len(able) // 100
    return collections.Counter([(*r[:1], *r[2:], k + 1 if k < drawn else None) for k, r in enumerate(able)] + [(*r[:1], *r[2:], None) for r in rest])


def test_importance_matches_brute_force(spark, frame, sample):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [None, ""]
    target = spark.createDataFrame([(str(i), t) for i, t in enumerate(items)], "item_id string, text string")
    long = [t for _, t in sample if t and len(t.split()) > 30][0]
    rows = sample + [(20_000 + i, t) for i, t in enumerate(ODD)] + [(None, long), (None, long), (sample[0][0], long), (30_000, long), (30_000, long)]
    got = tuples(importance.digest(frame(rows), target), "doc_id", "n_features", "weight", "score", "rank")
    assert got == brute_importance(rows, items)
    assert importance.digest(frame([]), target).collect() == []
    empty = target.where("false")
    assert tuples(importance.digest(frame(rows), empty), "doc_id", "n_features", "weight", "score", "rank") == brute_importance(rows, [])


def test_importance_counts_long_texts_in_blocks(monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", 64)
    rng = random.Random(1)
    for n in (0, 1, 2, 21, 22, 64, 500):
        words = [rng.choice(["Ab", "c", "ünï", "d9"]) for _ in range(n)]
        raw = " ,".join(words).encode()
        total, at, count = importance.features(raw, importance.scanner())
        low = [lower_ascii(w) for w in words]
        want = collections.Counter(zlib.crc32(" ".join(low[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(n - k + 1))
        assert total == n and dict(zip(at.tolist(), count.tolist())) == want


def test_resample_returns_drawn_rows_with_their_columns(spark, frame):
    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(30)) + (" exam question text" if i % 10 == 0 else "")) for i in range(200)]
    docs = frame(rows).withColumn("importance", F.lit("mine")).withColumn("rank", F.lit(3))
    target = spark.createDataFrame([(str(i), "exam question text") for i in range(400)], "item_id string, text string")
    out = importance.resample(docs, target, percent=10)
    assert out.columns == docs.columns
    kept = out.collect()
    assert len(kept) == 20 and all(r.importance == "mine" and r.text == rows[r.doc_id][1] for r in kept)
    assert sum(r.doc_id % 10 == 0 for r in kept) >= 15


def test_importance_runs_of_other_lengths():
    words = [f"w{i % 5}" for i in range(30)]
    for orders in (1, 2, 4):
        total, at, count = importance.features(" ".join(words).encode(), importance.scanner(orders))
        want = collections.Counter(zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in range(1, orders + 1) for i in range(len(words) - k + 1))
        assert total == 30 and dict(zip(at.tolist(), count.tolist())) == want
