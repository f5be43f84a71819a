"""Token counts by greedy longest match (operator 1).

The vocabulary is a trie over bytes plus an end-of-word mark. Every node has a
failure link and the number of pieces popped when following it, both
precomputed, so a word's greedy longest-match piece count comes from one pass
over its bytes without building pieces and without going back.

Words are the maximal runs of letters, single digits and runs of other visible
characters of the lower-cased text. Counts of words are remembered in a bounded
table per task (natural text repeats its words).

Defined results: a null, empty or blank text has no words and no tokens; a word
that the vocabulary cannot cover is one unknown token; repeated rows each get a
row; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from railyard.llm.common import batch_of, slices

END = 256
#: Words remembered per task.
REMEMBERED = 300_000
#: Fixed: how a lower-cased text is cut into words.
WORDS = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class Automaton:
    """Trie with failure links and popped-piece counts over symbol sequences (0..256).

    The end mark may stand alone, at no cost: a word whose last piece has no
    form with the mark ends with the plain piece.
    """

    def __init__(self, pieces: Iterable[tuple[int, ...]]):
        child: list[dict[int, int]] = [{}]
        final = [False]
        for piece in (*pieces, (END,)):
            node = 0
            for c in piece:
                step = child[node].get(c)
                if step is None:
                    step = child[node][c] = len(child)
                    child.append({})
                    final.append(False)
                node = step
            final[node] = node != 0
        fail, popped = [-1] * len(child), [0] * len(child)
        level = [0]
        while level:  # breadth first: links of shorter strings come first
            below = []
            for node in level:
                for c, v in child[node].items():
                    below.append(v)
                    if final[v]:
                        fail[v], popped[v] = 0, int((node, c) != (0, END))
                        continue
                    z, n = fail[node], popped[node]
                    while z >= 0 and c not in child[z]:
                        n += popped[z]
                        z = fail[z]
                    if z >= 0:
                        fail[v], popped[v] = child[z][c], n
            level = below
        self.child, self.fail, self.popped = child, fail, popped

    def count(self, symbols: Iterable[int]) -> int:
        """Greedy longest-match pieces of the sequence; 0 where it can't be covered."""
        child, fail, popped = self.child, self.fail, self.popped
        node = n = 0
        for c in symbols:
            while (step := child[node].get(c)) is None:
                if fail[node] < 0:
                    return 0
                n += popped[node]
                node = fail[node]
            node = step
        while node:
            if fail[node] < 0:
                return 0
            n += popped[node]
            node = fail[node]
        return n


def printable_bytes() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves,
    the other bytes for the code points from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def load(path: str, word_end: str = "</w>") -> Automaton:
    """Automaton of a tokenizer file's vocabulary with an end-of-word suffix."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    byte_of = printable_bytes()
    pieces = []
    for piece in vocabulary:
        ended = piece.endswith(word_end)
        body = piece[: -len(word_end)] if ended else piece
        if all(c in byte_of for c in body):
            pieces.append(tuple(byte_of[c] for c in body) + (END,) * ended)
    return Automaton(pieces)


def counter(automaton: Automaton, remembered: int = REMEMBERED):
    """text -> (words, tokens, unknown words), remembering chunks between blanks."""
    known: dict[str, tuple[int, int, int]] = {}

    def chunk(s: str) -> tuple[int, int, int]:
        words = tokens = unknown = 0
        for w in WORDS.findall(s.lower()):
            n = automaton.count((*w.encode("utf-8", "replace"), END))
            words, tokens, unknown = words + 1, tokens + (n or 1), unknown + (n == 0)
        return words, tokens, unknown

    def count(text: str | None) -> tuple[int, int, int]:
        words = tokens = unknown = 0
        for s in (text or "").split():
            got = known.get(s)
            if got is None:
                if len(known) >= remembered:
                    known.clear()
                got = chunk(s)
                if len(s) <= 64:
                    known[s] = got
            words += got[0]
            tokens += got[1]
            unknown += got[2]
        return words, tokens, unknown

    return count


def token_counts(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: id, n_words, n_tokens, n_unknown (words outside the vocabulary).

    ``vocabulary`` is the path of the tokenizer file, installed alike on every executor.
    """
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    schema = T.StructType([source.schema.fields[0], *[T.StructField(c, T.LongType()) for c in ("n_words", "n_tokens", "n_unknown")]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(load(vocabulary))
        for whole in batches:
            for part in slices(whole, "text"):
                got = [count(t) for t in part.column("text").to_pylist()]
                yield batch_of(arrow, part.column("id"), *([g[k] for g in got] for k in range(3)))

    return source.mapInArrow(run, schema).withColumnRenamed("id", id_column)
