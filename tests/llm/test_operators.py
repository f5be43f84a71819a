"""Each operator against a brute-force version, and its edge cases."""

from __future__ import annotations

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from railyard.llm import chat_format, decontam, html_extract, language_id, near_dedup, packing, quality_model, quality_rules, substring_dedup, token_counts
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def odd_rows():
    return [(i, t) for i, t in enumerate(ODD)] + [(None, "row without id"), (3, "one"), (3, "one")]


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- 1 -------------------------------------------------------------------------


def greedy(word, vocabulary, alphabet):
    s, at, n = "".join(alphabet[b] for b in word.encode()), 0, 0
    while at < len(s):
        end = next(e for e in range(len(s), at, -1) if s[at:e] in vocabulary or e == len(s) and s[at:e] + "</w>" in vocabulary)
        at, n = end, n + 1
    return n


def test_token_counts_match_greedy_longest_match(spark, frame, sample):
    vocabulary = set(json.load(open(VOCABULARY))["model"]["vocab"])
    alphabet = {b: c for c, b in token_counts.printable_bytes().items()}
    rows = sample[:40] + [(10_000 + i, t) for i, t in enumerate(ODD) if t is None or len(t) < 10_000]
    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in token_counts.token_counts(frame(rows), VOCABULARY).collect()}
    for i, t in rows:
        words = token_counts.WORDS.findall((t or "").lower())
        assert got[i] == (len(words), sum(greedy(w, vocabulary, alphabet) for w in words), 0)


def test_automaton_on_random_vocabularies():
    rng = random.Random(5)
    for _ in range(200):
        vocabulary = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 12))} | {"a"}
        automaton = token_counts.Automaton(tuple(map(ord, p)) for p in vocabulary)
        for _ in range(20):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
            at = n = 0
            while at < len(word):
                end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), None)
                if end is None:
                    n = 0
                    break
                at, n = end, n + 1
            assert automaton.count([*map(ord, word), token_counts.END]) == n


# --- 2 -------------------------------------------------------------------------


def brute_leaks(docs, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(t))
    windows = collections.defaultdict(set)
    for item, text in items:
        w = cut(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i : i + k])].add(item)
    sizes = {len(k) for k in windows}
    for i, text in docs:
        w = cut(text)
        hit, ids = set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if found := windows.get(tuple(w[a : a + k])):
                    hit.update(range(a, a + k))
                    ids |= found
        ids = sorted(str(x) for x in ids if x is not None)
        yield i, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)


def test_decontamination_matches_brute_force(spark, frame, sample):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(900, "Short item!"), (901, None), (902, "..."), (None, "no id here"), (903, "short ITEM")]
    docs = sample + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(20_000, "a short-item, no id HERE" + items[0][1]), (20_001, "x".join([items[1][1]] * 2)), (20_002, items[2][1].replace(" ", " - "))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = collections.Counter(tuple(r) for r in decontam.digest(frame(docs), benchmark).collect())
    assert got == collections.Counter(brute_leaks(docs, items))
    assert sum(r[5] for r in got) > 3


def test_decontamination_shards_spans_and_columns(spark, frame):
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(i, " ".join(words[i : i + 11])) for i in range(0, 29, 4)], "item_id long, text string")
    text = "Intro, " + " ".join(words).upper() + " end"
    docs = frame([(1, text), (2, "clean text")]).withColumn("leak", F.lit("mine")).withColumn("item_id", F.lit(7))
    one = decontam.annotate(docs, items).collect()
    many = decontam.annotate(docs, items, shard_bytes=60).collect()
    assert one == many
    span = one[0].leak.spans[0]
    assert text.encode()[span.start : span.end].decode().split()[0] == "W0"
    assert [(r.doc_id, r.leak) for r in decontam.decontaminate(docs, items).collect()] == [(2, "mine")]
    assert decontam.digest(docs.limit(0), items).count() == 0
    assert decontam.digest(docs, items.limit(0)).filter("contaminated").count() == 0


# --- 3 -------------------------------------------------------------------------


def brute_repeats(docs, window):
    split = [(i, WORDS.findall(t or "")) for i, t in docs]
    seen = collections.Counter(tuple(w[a : a + window]) for _, w in split for a in range(len(w) - window + 1))
    for i, w in split:
        gone = set()
        for a in range(len(w) - window + 1):
            if seen[tuple(w[a : a + window])] > 1:
                gone.update(range(a, a + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        yield i, len(w), len(gone), sha(kept)


def test_substring_dedup_matches_brute_force(spark, frame, sample):
    docs = sample + odd_rows()
    got = collections.Counter(tuple(r) for r in substring_dedup.digest(frame(docs)).collect())
    assert got == collections.Counter(brute_repeats(docs, substring_dedup.WINDOW))
    assert sum(r[2] > 0 for r in got) > 3


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_on_runs_periods_and_shared_passages(spark, frame, seed):
    rng = random.Random(seed)
    docs = []
    for _ in range(60):
        kind = rng.randrange(4)
        docs.append([rng.choice("ab") for _ in range(rng.randrange(90))] if kind == 0 else list("abc") * rng.randrange(30) if kind == 1
                    else [str(rng.randrange(10**6)) for _ in range(rng.randrange(90))] if kind == 2 else ["x"] * rng.randrange(80))
    for _ in range(80):
        a, b = rng.choice(docs), rng.choice(docs)
        i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        b[j:j] = a[i : i + rng.randrange(20, 60)]
    docs = [(i, " ".join(d)) for i, d in enumerate(docs)]
    got = collections.Counter(tuple(r) for r in substring_dedup.digest(frame(docs)).collect())
    assert got == collections.Counter(brute_repeats(docs, substring_dedup.WINDOW))


def test_equal_windows_have_equal_symbols():
    rng = random.Random(9)
    for _ in range(40):
        docs = [[rng.choice("abc") if rng.random() < 0.5 else str(rng.randrange(99)) for _ in range(rng.randrange(80))] for _ in range(10)]
        for _ in range(10):
            a, b = rng.choice(docs), rng.choice(docs)
            b[0:0] = a[:40]
        names = {w: i for i, w in enumerate({w for d in docs for w in d})}
        words = substring_dedup.mix(np.array([names[w] for d in docs for w in d], np.uint64))
        bound = np.cumsum([0, *map(len, docs)])
        flat = [w for d in docs for w in d]
        for window in (4, 12, 35):
            symbol_of = {}
            for s, _, first, n in zip(*substring_dedup.stretches(words, bound, window)):
                for p in range(first, first + n):
                    assert symbol_of.setdefault(tuple(flat[p : p + window]), s) == s


def test_substring_dedup_keeps_columns_and_untouched_texts(spark, frame):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = frame([(1, f"left  {passage} right"), (2, f"{passage}\nother"), (3, "two  spaces"), (4, None)]).withColumn("key", F.lit("mine")).withColumn("spans", F.lit(1))
    out = {r.doc_id: r for r in substring_dedup.dedupe(docs).collect()}
    assert substring_dedup.dedupe(docs).columns == docs.columns
    assert (out[1].text, out[2].text, out[3].text, out[4].text) == ("left right", "other", "two  spaces", None)
    assert substring_dedup.digest(docs.limit(0)).count() == 0


# --- 4 -------------------------------------------------------------------------


def test_chat_round_trip_and_mask(spark):
    texts = ["plain", None, "", "</s>[INST] <+> & &amp; &lt; &amp;lt; [x]", "line\nline", "日本 \U0001d4b3", "<s>[user]no</s>"]
    rng, rows = random.Random(2), []
    for conv in range(40):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", None, "odd]<role"]), rng.choice(texts)))
    rows += [(0, 0, "user", "tie"), (None, 1, "user", "no id"), (None, 1, "user", "no id")]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("id", F.lit(2))
    made = chat_format.format_chats(turns)
    want = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        want[conv].append((turn, role or "", text or ""))
    for r in chat_format.read_back(made).collect():
        expected = [x[1:] for x in sorted(want[r.conv_id])]
        assert [(t.role, t.text) for t in r.turns] == expected
        assert list(r.loss_texts) == [t for role, t in expected if role == "assistant"]
        blocks = [role for k, (role, _) in enumerate(expected) if k == 0 or expected[k - 1][0] != role]
        assert r.formatted.count("<s>[") == len(blocks) and r.formatted.count("</s>") == len(blocks)
    digest = {r.conv_id: r for r in chat_format.digest(turns).collect()}
    assert digest[-1].loss_sha256 == sha("</s>[INST] ok [/INST]") and digest[-1].n_turns == 2
    assert digest[-1].turns_sha256 == sha("user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n")
    assert chat_format.format_chats(turns.limit(0)).count() == 0


# --- 5 and 10 -------------------------------------------------------------------


def longest_match_phrases(codes, text):
    """Greedy cross-parsing by plain substring search."""
    n = at = 0
    while at < len(codes):
        end = at + 1
        while end < len(codes) and codes[at : end + 1] in text:
            end += 1
        at, n = end, n + 1
    return n


def test_cross_parsing_counts_longest_matches():
    samples = {"aa": "the cat sat on the mat and the dog ate the cat", "bb": "le chat est sur le tapis et le chien mange"}
    model = language_id.Model(samples)
    tests = ["the cat ate", "le chien est sur", "zzz", "thechat", "a", "Ωμέγα the mat"]
    raw = "".join(tests).encode()
    off = np.cumsum([0, *(len(t.encode()) for t in tests)])
    counts, letters = model.phrases(np.frombuffer(raw, np.uint8), off)
    view = lambda t: bytes(model.kind[language_id.code_points(np.frombuffer(t.encode(), np.uint8))])
    for k, lang in enumerate(model.languages):
        assert counts[:, k].tolist() == [longest_match_phrases(view(t), view(samples[lang])) for t in tests]
    assert letters.tolist() == [sum(c.isalpha() for c in t) for t in tests]


def test_language_id_held_out_accuracy_and_edges(spark, frame):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.digest(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert held[0] > 0.97 and 0 <= held[1] <= held[2] <= 1
    model = language_id.fit(docs, language_id.remainder("doc_id", 3) != 1)
    odd = {i: r for i, r in enumerate(language_id.identify(frame([(i, t) for i, t in enumerate([*ODD, "123 !?"])]).withColumn("score", F.lit(5)), model).orderBy("doc_id").collect())}
    assert [odd[i].lang_pred for i in (0, 1, 2, 10)] == ["und"] * 4
    assert language_id.identify(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in language_id.digest(frame([(1, "text", None), (None, "text")])).collect()} == {"und"}


def test_long_texts_are_parsed_whole(spark):
    model = language_id.Model({"aa": "the cat sat on the mat " * 20, "bb": "le chat est sur le tapis " * 20})
    text = ("the cat sat " * 400 + "le chat est " * 1200).encode()
    assert model.predict(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0] == ["bb"]


def test_language_id_learns_from_long_and_repeated_texts(spark, frame):
    rng = random.Random(8)
    words = {lang: ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(300)] for lang in ("aa", "bb", "cc")}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, "1 " * 15_000 + say("aa", 6000), "aa") for i in range(6)] + [(100 + i, say("bb", 30), "bb") for i in range(60)] + [(200, say("cc", 9000), "cc")]
    rows += [(300, say("cc", 20), "cc")] * 400  # one row, many times
    assert min(len(r[1]) for r in rows[:6]) > language_id.TRAIN_TEXT
    docs = frame(rows)
    fitted = language_id.fit(docs, F.lit(True))
    seen = {lang: text for shard in fitted for lang, text in shard.items()}
    assert set(seen) == {"aa", "bb", "cc"} and len(seen["cc"]) < 2 * language_id.TRAIN_TEXT and seen["cc"].count(rows[-1][1]) == 1
    assert 40_000 <= len(seen["aa"]) <= 50_001 and seen["aa"][0].isalpha()
    tests = [(i, say(lang, 25), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 10)]
    assert [r.lang_pred for r in language_id.identify(frame(tests), fitted).orderBy("doc_id").collect()] == [t[2] for t in tests]


def test_language_id_takes_many_languages_and_large_scripts(spark, frame):
    rng = random.Random(12)
    first = {"zh": 0x4E00, "zj": 0x4E00, "ko": 0xAC00, "am": 0x1200}
    big = {k: ["".join(chr(c + rng.randrange(250)) for _ in range(2)) for _ in range(900)] for k, c in first.items()}
    words = big | {f"x{i:03}": ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(40)] for i in range(203)}
    say = lambda lang, n: ("" if lang in big else " ").join(rng.choice(words[lang]) for _ in range(n))
    rows = [(len(words) * k + i, say(lang, 1500 if lang in big else 80), lang) for k in range(2) for i, lang in enumerate(words)]
    fitted = language_id.fit(frame(rows), F.lit(True))
    assert {lang for s in fitted for lang in s} == set(words) and max(map(len, fitted)) <= language_id.SHARD_LANGUAGES
    tests = [(i, say(lang, 40), lang) for i, lang in enumerate([*big] * 5 + [*words][4::20])]
    got = language_id.identify(frame(tests), fitted).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == [t[2] for t in tests] and all(0 < r.score <= 1 for r in got)


def test_shards_of_languages_give_what_one_model_gives():
    texts = {"aa": "the cat sat on the mat and the dog", "bb": "le chat est sur le tapis et le chien", "cc": "die katze sitzt auf der matte"}
    raw = "the dog le chien zzz katze".encode()
    off = np.array([0, 7, 16, 20, 26])
    found = language_id.Found(4)
    for lang in ("cc", "aa", "bb"):
        found.add(language_id.Model({lang: texts[lang]}), np.frombuffer(raw, np.uint8), off)
    name, score = language_id.Model(texts).predict(np.frombuffer(raw, np.uint8), off)
    assert found.result()[0] == name and np.allclose(found.result()[1], score)


def test_quality_model_held_out_accuracy_and_edges(spark, frame):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    out = quality_model.digest(docs, labels).join(labels, "doc_id").filter("held_out")
    right = out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.min("score"), F.max("score"),
                    F.sum(((F.col("predicted") == 0) & (F.col("quality") == 1)).cast("int"))).first()
    assert right[0] > 0.97 and 0 <= right[1] <= right[2] <= 1 and right[3] <= 2
    odd = frame(odd_rows()).withColumn("y", F.lit(1)).withColumn("quality", F.lit(9))
    some = labels.union(spark.createDataFrame([(0, None, None), (None, 1, 0)], labels.schema))
    got = quality_model.digest(odd, some).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert quality_model.digest(odd, labels.limit(0)).filter("score <> 0.5").count() == 0
    assert quality_model.digest(odd.limit(0), labels).count() == 0


def test_quality_model_takes_one_row_of_each_id(spark, frame, monkeypatch):
    docs = frame([(1, "the one repeated text")] * 600 + [(i, f"text number {i}") for i in range(2, 20)] + [(2, "another text of two")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 20)], "doc_id long, quality long")
    monkeypatch.setattr(quality_model, "train", lambda rows, y, share: (len({r.tobytes() for r in rows}), y.tolist()))
    n, y = quality_model.fit(docs, labels, F.lit(True), per_class=20)
    assert n == len(y) == 19 and sum(y) == 10


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    y = np.where(rng.random(200) < 0.5, 1.0, -1.0)
    rows = [np.array([0 if v > 0 else 1, 2 + int(rng.integers(8))]) for v in y]
    values = [np.ones(2) / np.sqrt(2) for _ in y]
    w = quality_model.dual_coordinate_descent(rows, values, y, np.ones(200), 10)
    assert all(v * (w[r] @ x) > 0.5 for r, x, v in zip(rows, values, y))


# --- 6 -------------------------------------------------------------------------


def brute_measures(text):
    words = WORDS.findall(text or "")
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(lines))


def test_quality_rules_match_brute_force(spark, frame, sample):
    docs = sample + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(20_000, "a b\na b\n\n \na b \r\na b"), (20_001, "x y z x y z q"), (20_002, "\n"), (20_003, "é # ## \n#")]
    for r in quality_rules.digest(frame(docs)).collect():
        m = brute_measures(dict(docs)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) == m
        assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0]) and not (r.base_failed and r.kept)


def test_quality_policies_and_ablations(spark, frame, sample):
    book = quality_rules.ledger(frame(sample + odd_rows())).persist()
    rows = book.collect()
    for policy, rules in quality_rules.POLICIES.items():
        want = {}
        for rule in rules:
            bit = quality_rules.mask([rule])
            failed = [r.failed & quality_rules.mask(rules) for r in rows]
            want[rule] = (sum(bool(f & bit) for f in failed), sum(f == bit for f in failed))
        got = {r.rule: (r.n_failed, r.n_only) for r in quality_rules.ablations(book, policy).collect()}
        assert got == want
    assert quality_rules.ledger(frame(sample).limit(0)).count() == 0


# --- 7 -------------------------------------------------------------------------


def test_packing_covers_every_token_once(spark, frame, sample):
    docs = [(i, t) for i, t in sample] + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(20_000, "hello <|endoftext|> there"), (20_001, "same"), (20_001, "same")]
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in docs}
    n = collections.Counter(i for i, _ in docs)
    pieces = packing.pack(frame(docs).withColumn("curve", F.lit(0)).withColumn("ids", F.lit(1)), VOCABULARY).collect()
    assert collections.Counter({i: len(x) * n[i] for i, x in ids.items()}) == sum((collections.Counter({p.doc_id: p.length}) for p in pieces), collections.Counter())
    sequences = collections.defaultdict(list)
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert part.tolist() == p.ids and zlib.crc32(part.tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
        sequences[p.sequence_id].append(p)
    for s in sequences.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == np.cumsum([0, *(p.length for p in s)])[:-1].tolist()
        total = sum(p.length for p in s)
        assert total <= packing.LENGTH and total & (total - 1) == 0
    assert packing.digest(frame(docs).limit(0), VOCABULARY).count() == 0


def test_hilbert_curve_visits_neighbours():
    side, bits = 8, 3
    points = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    order = points[np.argsort(packing.hilbert(points, bits))]
    assert sorted(packing.hilbert(points, bits).tolist()) == list(range(side**3))
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


# --- 8 -------------------------------------------------------------------------


def brute_components(docs):
    sets = []
    for _, t in docs:
        w = WORDS.findall(lower_ascii(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least.setdefault(find(i), []).append(d)
    for i, (d, _) in enumerate(docs):
        c = min((x for x in least[find(i)] if x is not None), default=None)
        yield d, len(sets[i]), c, d == c


def test_near_dedup_matches_brute_force(spark, frame, sample):
    docs = sample + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "row without id"), (None, "row without id"), (20_000, "Row without ID"), (20_001, "one"), (20_001, "one")]
    got = collections.Counter(tuple(r) for r in near_dedup.digest(frame(docs)).collect())
    assert got == collections.Counter(brute_components(docs))


def test_near_dedup_large_families(spark, frame, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 16)
    monkeypatch.setattr(near_dedup, "HUBS", 1)
    rng, docs = random.Random(4), []
    for family in range(3):
        base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
        for _ in range(80):
            text = list(base)
            for _ in range(rng.randrange(9)):
                text[rng.randrange(90)] = f"e{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(text)))
    got = collections.Counter(tuple(r) for r in near_dedup.digest(frame(docs)).collect())
    assert got == collections.Counter(brute_components(docs))


def test_near_dedup_keeps_one_of_each_group(spark, frame):
    base = " ".join(f"w{i}" for i in range(40))
    docs = frame([(5, base), (5, base), (9, base + " more"), (7, "other words"), (8, None), (None, None)]).withColumn("key", F.lit("k")).withColumn("class", F.lit("c"))
    out = near_dedup.dedupe(docs)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in out.collect() if r.text) == [("5", base), ("7", "other words")]
    assert near_dedup.dedupe(docs.limit(0)).count() == 0


def test_near_dedup_stage_goes_by_components_not_ids(spark, frame):
    passage = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    groups = [[(None, passage("a")), (None, passage("a") + " end"), (None, passage("a"))], [(None, passage("b"))], [(None, passage("c"))], [(7, passage("d"))],
              [(7, passage("e")), (8, passage("e"))], [(None, passage("f")), (9, passage("f"))], [(7, None)], [(None, "")], [(None, None)]]
    docs = [r for g in groups for r in g]
    component = {}
    for i in range(len(docs)):  # brute force: any two texts, the first that is close enough
        close = [j for j in range(i) if len({c for _, _, c, _ in brute_components([(0, docs[i][1]), (1, docs[j][1])])}) == 1]
        component[i] = component[close[0]] if close else i
    assert len(set(component.values())) == len(groups)
    least = collections.Counter(min((docs[i][0] for i in component if component[i] == c and docs[i][0] is not None), default=None) for c in set(component.values()))
    out = [(r.doc_id, r.text) for r in near_dedup.dedupe(frame(docs)).collect()]
    assert collections.Counter(i for i, _ in out) == least
    assert sorted(component[docs.index(r)] for r in out) == sorted(set(component.values()))


# --- 9 -------------------------------------------------------------------------


def test_blocks_of_odd_pages():
    assert [b.text for b in html_extract.blocks("<p>a&amp;b <b>c</b>d<br>e  f<p>g<!-- x --><script>if(a<b)</script><li>h<li>i")] == ["a&b cd", "e f", "g", "h", "i"]
    assert [b.path[-1] for b in html_extract.blocks('<article class="post main"><div id=x>t</div>u</article>')] == ["div x", "article post main"]
    for page in (None, "", "<", "<p", "<!-- open", "<script>open", "</p></div>", "<a href='>'>x</a>", "a < b"):
        html_extract.blocks(page)
    assert [b.text for b in html_extract.blocks("a < b")] == ["a < b"]


def test_extraction_finds_the_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    wrong = 0
    for r in html_extract.digest(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        plain = html_extract.html.unescape(re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", article))
        wrong += r.text != " ".join(plain.split()) or r.n_chars != len(r.text)
    assert wrong <= 1
    odd = spark.createDataFrame([(1, None, None), (None, "u", ""), (3, "u", "<p>" * 300), (3, "u", "<p>" * 300)], "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("id", F.lit(1))
    model = html_extract.fit(pages.limit(20))
    assert [r.text for r in html_extract.extract(odd, model).collect()] == [""] * 4
    assert html_extract.digest(pages.limit(0)).count() == 0


def test_extraction_learns_from_long_pages_and_past_empty_ones(spark, monkeypatch):
    rng = random.Random(6)
    say = lambda n: " ".join(f"word{rng.randrange(3000)}" for _ in range(n))
    page = lambda n: f"<title>t</title><nav><a href=x>{say(2)}</a></nav><article>" + "".join(f"<p>{say(60)}.</p>" for _ in range(n)) + f"</article><footer>{say(3)}</footer>"
    rows = [(i, "u", page(600)) for i in range(8)]
    assert min(len(r[2]) for r in rows) > 50_000
    article = lambda h: " ".join(re.sub("<[^>]*>", " ", re.search("<article>(.*)</article>", h)[1]).split())
    long = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [r.text for r in html_extract.digest(long).orderBy("page_id").collect()] == [article(r[2]) for r in rows]
    # empty pages come first in the order of the hash; repeated pages count once
    monkeypatch.setattr(html_extract, "SAMPLE_PAGES", 3)
    mixed = long.limit(2).union(spark.createDataFrame([(100 + i, "u", "<p></p>") for i in range(300)], long.schema)).union(long.limit(1)).union(long.limit(1))
    seen = []
    monkeypatch.setattr(html_extract, "train", lambda x, y, seed: seen.append((x, y)) or {})
    monkeypatch.setattr(html_extract, "MADE_PAGES", 0)
    assert html_extract.fit(mixed) is not None
    assert [len(x) for x in seen[0][0]] == [len(y) for y in seen[0][1]] == [512, 512]
    assert html_extract.fit(mixed.filter("page_id >= 100")) is None


def test_labeller_on_layouts_it_has_not_seen():
    rng = np.random.default_rng(77)
    words = [f"word{i}" for i in range(500)]
    made = [html_extract.made_page(words, rng) for _ in range(700)]
    encoder = html_extract.Encoder()
    x, y = [encoder.page(html_extract.blocks(p)) for p, _ in made], [np.array(m, np.float32) for _, m in made]
    assert [len(a) for a in x] == [len(b) for b in y]
    p = html_extract.train(x[:500], y[:500], epochs=6)
    wrong = sum(int(((a >= 0.5) != (b > 0.5)).sum()) for a, b in zip(html_extract.probabilities(p, x[500:]), y[500:]))
    assert wrong < 0.01 * sum(map(len, y[500:]))
