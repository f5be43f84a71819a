"""Language identification by cross-parsing (operator 5).

For each language a suffix automaton of bounded labelled text gives, at every
position, the longest match into that text. A text is parsed greedily into such
matches; the language whose text needs the fewest phrases, normalised by the
log of its training length, wins. All automata are one completed transition
table, so that whole texts are parsed for every language at once, many texts
side by side.

Text is reduced to letter classes: lower case, anything that is not a letter is
one blank, blanks are merged. Letters unseen in training share a class; where a
shard has more letters than classes, its rarer ones share classes by a hash.
Languages beyond a bounded shard are parsed shard by shard.
A phrase never crosses a multiple of ``SEGMENT`` classes, so that long texts are
parsed in parallel pieces.

Defined results: null texts and texts without a letter are ``und`` with score
0; ties go to the language name first in order; rows with a null id or null
language are not learned from; without any usable training row every text is
``und``; repeated rows each get a row; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from railyard.llm.common import U64, batch_of, mix, slices, text_bytes

#: Letter classes of training text per language (the fit's documented bound).
TRAIN_CLASSES = 30_000
#: Most characters of one text that the training sample takes.
TRAIN_TEXT = 20_000
SEGMENT = 1024
BLANK, RARE, FIRST = 0, 1, 2
#: Most letter classes of a shard of languages, and those of them that rarer letters share by a hash.
MAX_CLASSES = 128
HASHED = 64
#: Most languages whose automata a task holds at once, and the text that it holds meanwhile if there are several shards.
SHARD_LANGUAGES = 8
HELD_BYTES = 32 << 20
#: Damping of the phrase cost when it is turned into a score.
TEMPER = 0.1


@functools.lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: is it a letter, and its lower-case code point."""
    size = 0x110000
    letter, lower = np.zeros(size, bool), np.arange(size, dtype=np.uint32)
    for cp in range(size):
        if unicodedata.category(c := chr(cp))[0] == "L":
            letter[cp] = True
            if len(low := c.lower()) == 1:
                lower[cp] = ord(low)
    return letter, lower


def code_points(raw: np.ndarray) -> np.ndarray:
    return np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence (state 0 is the empty match)."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Model:
    """The completed tables of all languages.

    ``move[state * n_classes + class]`` is (next state << 2) | phrases ended.
    """

    def __init__(self, samples: dict[str, str]):
        letter, lower = letters()
        reduced: dict[str, np.ndarray] = {}
        for lang, text in sorted(samples.items()):
            cp = code_points(np.frombuffer(text.encode("utf-8", "replace"), np.uint8))
            reduced[lang] = np.where(letter[cp], lower[cp], 0)
        seen = {lang: Counter(cp[cp > 0].tolist()) for lang, cp in reduced.items()}
        every, room = sorted(set().union(*seen.values())), MAX_CLASSES - FIRST
        if len(every) <= room:
            own, rest = every, []
        else:  # by turns the most frequent letters of each language; the others are dealt to classes by a hash
            turns = sorted((i, lang, c) for lang, n in seen.items() for i, c in enumerate(sorted(n, key=lambda c: (-n[c], c))))
            own = list(dict.fromkeys(c for _, _, c in turns))[: room - HASHED]
            rest = sorted(set(every) - set(own))
        class_of = np.full(0x110000, RARE, np.uint8)
        class_of[own] = FIRST + np.arange(len(own))
        class_of[rest] = FIRST + len(own) + mix(np.array(rest, U64)) % U64(HASHED)
        kind = class_of[lower]
        kind[~letter] = BLANK
        self.kind, self.classes = kind, FIRST + len(own) + (HASHED if rest else 0)
        self.languages, roots, moves, costs, base = list(reduced), [], [], [], 0
        for lang, cp in reduced.items():
            codes = self.merge_blanks(kind[cp], np.zeros(len(cp), np.int64))[0]
            step = suffix_automaton(codes.tolist())
            move = np.empty((len(step), self.classes), np.int64)
            restart = np.array([step[0].get(c, 0) for c in range(self.classes)])
            # dead end: the phrase ends and a new one starts with this class, or this class is a phrase of its own
            move[:] = (base + restart) << 2 | np.where(restart > 0, 1, 2)
            move[0] = base << 2 | 1
            for s, edges in enumerate(step):
                for c, t in edges.items():
                    move[s, c] = (base + t) << 2
            moves.append(move)
            roots.append(base)
            costs.append(math.log2(max(2, len(codes))))
            base += len(step)
        self.move = np.concatenate(moves).astype(np.int32).ravel() if moves else np.zeros(0, np.int32)
        self.roots, self.costs = np.array(roots, np.int32), np.array(costs)

    @staticmethod
    def merge_blanks(codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        blank = codes == BLANK
        keep = ~blank
        keep[1:] |= ~(blank[:-1] & (row[1:] == row[:-1]))
        return codes[keep], row[keep]

    def phrases(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase counts by row and language, letters by row) of a slice."""
        rows = len(off) - 1
        cp = code_points(raw)
        first = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[off]
        row = np.repeat(np.arange(rows), np.diff(first))
        codes, row = self.merge_blanks(self.kind[cp], row)
        n_letters = np.bincount(row[codes != BLANK], minlength=rows)
        bound = np.searchsorted(row, np.arange(rows + 1))
        pieces = -(-np.diff(bound) // SEGMENT)
        owner = np.repeat(np.arange(rows), pieces)
        begin = bound[owner] + SEGMENT * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        length = np.minimum(SEGMENT, bound[owner + 1] - begin)
        order = np.argsort(-length, kind="stable")
        begin, length, owner = begin[order], length[order], owner[order]
        state = np.repeat(self.roots[:, None], len(begin), 1)
        count = np.zeros(state.shape, np.int32)
        active = np.searchsorted(-length, -np.arange(1, SEGMENT + 1), "right")
        for t in range(int(length[0]) if len(length) else 0):
            n = active[t]
            got = self.move[state[:, :n] * self.classes + codes[begin[:n] + t]]
            state[:, :n] = got >> 2
            count[:, :n] += got & 3
        count += state != self.roots[:, None]
        out = np.zeros((rows, len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owner, count[k], rows)
        return out, n_letters

    def predict(self, raw: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray]:
        found = Found(len(off) - 1)
        found.add(self, raw, off)
        return found.result()


class Found:
    """The best language of the rows of a slice, over one shard after another."""

    def __init__(self, rows: int):
        self.name, self.low = np.full(rows, "", object), np.full(rows, np.inf)
        self.total, self.known = np.zeros(rows), np.zeros(rows, bool)

    def add(self, model: Model, raw: np.ndarray, off: np.ndarray) -> None:
        if not model.languages or len(off) < 2:
            return
        count, n_letters = model.phrases(raw, off)
        bits = count * model.costs
        here, name = bits.min(1), np.array(model.languages, object)[bits.argmin(1)]
        low = np.minimum(self.low, here)
        self.total = self.total * np.exp(-TEMPER * (self.low - low)) + np.exp(-TEMPER * (bits - low[:, None])).sum(1)
        better = (here < self.low) | ((here == self.low) & (name < self.name))
        self.name, self.low, self.known = np.where(better, name, self.name), low, n_letters > 0

    def result(self) -> tuple[list[str], np.ndarray]:
        score = 1 / np.where(self.known, self.total, 1.0)
        return [n if k else "und" for n, k in zip(self.name, self.known)], np.where(self.known, score, 0.0)


def shards(samples: dict[str, str]) -> list[dict[str, str]]:
    """The languages in groups of at most ``SHARD_LANGUAGES`` whose letters all have
    classes of their own, or of one language; those of like letters together."""
    letter, lower = letters()
    used = {}
    for lang, text in samples.items():
        cp = code_points(np.frombuffer(text.encode("utf-8", "replace"), np.uint8))
        used[lang] = Counter(lower[cp[letter[cp]]].tolist())
    out, inside = [], set()
    for lang in sorted(used, key=lambda k: (used[k].most_common(1)[0][0] >> 8 if used[k] else 0, k)):
        both = inside | used[lang].keys()
        if not out or len(out[-1]) >= SHARD_LANGUAGES or len(both) > MAX_CLASSES - FIRST:
            out.append({})
            both = set(used[lang])
        out[-1][lang], inside = samples[lang], both
    return out


def remainder(id_column: str, modulus: int) -> Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def fit(docs: DataFrame, usable: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
        classes: int = TRAIN_CLASSES) -> list[dict[str, str]]:
    """The training texts, in shards of languages: about ``classes`` characters of each language at most, distinct
    usable rows in the order of a hash of id and text, as many as the bound takes
    and one of every language at least. Of a text of more than ``TRAIN_TEXT``
    characters so many are taken from its first letter on, cut in Spark. Only that
    sample reaches the driver."""
    rows = docs.filter(usable).select(F.col(lang_column).alias("l"), F.col(text_column).alias("t"), F.xxhash64(F.col(id_column).cast("string"), F.col(text_column)).alias("h"))
    rows = rows.filter("l is not null and rlike(t, '\\\\p{L}')").withColumn("place", F.pmod("h", F.lit(1 << 30)))
    # by language, the characters at places of so many bits; the sample is the fewest bits that hold enough
    sizes = rows.select("l", "h", F.length(F.bin("place")).alias("bits"), F.least(F.length("t"), F.lit(TRAIN_TEXT)).alias("n")).distinct()
    sizes = sizes.groupBy("l", "bits").agg(F.sum("n").alias("n"))
    sizes = sizes.withColumn("n", F.sum("n").over(Window.partitionBy("l").orderBy("bits")))
    upto = sizes.groupBy("l").agg(F.coalesce(F.min(F.when(F.col("n") >= classes, F.col("bits"))), F.max("bits")).alias("upto"))
    some = rows.join(F.broadcast(upto), "l").filter("length(bin(place)) <= upto")
    excerpt = F.when(F.length("t") > TRAIN_TEXT, F.substring(F.regexp_replace("t", "^[^\\p{L}]++", ""), 1, TRAIN_TEXT)).otherwise(F.col("t"))
    sample = some.select("l", "place", "h", excerpt.alias("t")).dropDuplicates(["l", "h"]).collect()
    texts: dict[str, list[str]] = {}
    total: Counter = Counter()
    for r in sorted(sample, key=lambda r: (r.l, r.place, r.h)):
        if total[r.l] < classes:
            texts.setdefault(r.l, []).append(r.t)
            total[r.l] += len(r.t)
    return shards({lang: "\n".join(t) for lang, t in texts.items()})


def identify(docs: DataFrame, model: list[dict[str, str]], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: id, lang_pred, score (0 to 1). The automata of each shard of
    ``model`` are one broadcast; a task holds those of one shard at a time."""
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    schema = T.StructType([source.schema.fields[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    sent = [docs.sparkSession.sparkContext.broadcast(Model(s)) for s in model]

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        parts, size = [], 0
        for whole in batches:
            for part in slices(whole, "text"):
                parts.append(part)
                size += part.column("text").nbytes
                if len(sent) < 2 or size >= HELD_BYTES:
                    yield parts
                    parts, size = [], 0
        yield parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in held(batches):
            found = [Found(p.num_rows) for p in parts]
            for shard in sent if parts else ():
                for f, p in zip(found, parts):
                    f.add(shard.value, *text_bytes(p.column("text"))[:2])
                if len(sent) > 1 and shard._path is not None:
                    shard.__dict__.pop("_value", None)  # read again from its file for the next parts
            for f, p in zip(found, parts):
                yield batch_of(arrow, p.column("id"), *f.result())

    return source.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def digest(docs: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    model = fit(docs, remainder("doc_id", 3) != 1)
    return identify(docs, model).select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
