"""Chat formatting (operator 4), Spark expressions only.

Turn structs are collected and sorted per conversation, adjacent turns of one
role are merged into one block, and the blocks are concatenated::

    <s>[role]text<+>text</s><s>[role]text</s>

``<+>`` separates the merged turns of a block. In roles and texts the
characters ``& < [ ]`` are written as character references, so no text can
contain a control string and every turn can be read back exactly. The loss mask
lists the (start, length) character ranges of the assistant texts.

Defined results: null texts and null roles are empty; turns sort by turn, role,
text (nulls first), so ties and repeated rows keep a fixed order and each stays
a turn; rows with a null conversation id form one conversation; an empty table
gives no rows; extra columns are not read. A conversation is one value of the
output, so its turns meet in one task by the nature of the result, where the
work is linear in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of control strings and what stands for them in texts, in the order of escaping.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"), ("]", "&rsqb;")]
OPEN, CLOSE, JOIN = "<s>[", "</s>", "<+>"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def format_chats(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
                 text_column: str = "text", learned_role: str = LEARNED_ROLE) -> DataFrame:
    """One row per conversation: id, ``formatted`` and ``loss_mask``
    (array of (start, length), 0-based characters of ``formatted``)."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_column, role_column))
    rows = turns.select(F.col(id_column).alias("id"), F.col(turn_column).alias("turn"), escape(role).alias("role"), escape(text).alias("text"))
    lists = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # a turn of the role before it only joins its block, any other opens one
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform(F.slice("turns", F.lit(1), F.size("turns") - 1), lambda t: t["role"]))
    parts = F.zip_with("turns", before, lambda t, role: F.struct(
        F.when(role == t["role"], F.lit(JOIN)).otherwise(
            F.concat(F.when(role.isNull(), F.lit("")).otherwise(F.lit(CLOSE)), F.lit(OPEN), t["role"], F.lit("]"))).alias("mark"),
        t["text"].alias("text"), (t["role"] == F.lit(learned_role)).alias("learned")))
    # where each text ends: a running sum over the parts, then the parts in order again
    upto = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = lists.select("id", F.posexplode(parts).alias("at", "p")).select(
        "id", "at", "p.*", F.sum(F.length("p.mark") + F.length("p.text")).over(upto).cast("int").alias("end"))
    whole = each.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "mark", "text", "learned", "end"))).alias("parts"))
    mask = F.transform(F.filter("parts", lambda p: p["learned"]), lambda p: F.struct((p["end"] - F.length(p["text"])).alias("start"), F.length(p["text"]).alias("length")))
    return whole.select(F.col("id").alias(id_column),
                        F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["mark"], p["text"])), ""), F.lit(CLOSE)).alias("formatted"),
                        mask.alias("loss_mask"))


#: Characters of a piece of a formatted text; a span is taken from the pieces it lies in.
PIECE = 1024


def spans_of(text: Column, spans: Column) -> Column:
    """The substrings of ``text`` at (start, length), in time linear in the text and the spans."""
    pieces = F.array(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))  # one element: a lambda's argument is evaluated once

    def cut(all_pieces: Column, s: Column) -> Column:
        first = F.floor(s["start"] / PIECE).cast("int")
        last = F.floor((s["start"] + s["length"]) / PIECE).cast("int")
        near = F.array_join(F.slice(all_pieces, first + 1, last - first + 1), "")
        return F.substring(near, s["start"] - first * PIECE + 1, s["length"])

    return F.flatten(F.transform(pieces, lambda p: F.transform(spans, lambda s: cut(p, s))))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (array of (role, text), in order, unescaped) and
    ``loss_texts`` (unescaped texts under the mask), from ``formatted`` and ``loss_mask`` alone."""
    blocks = F.split("formatted", CLOSE)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    opened = F.transform(blocks, lambda b: F.struct(
        unescape(F.substring(b, F.lit(len(OPEN) + 1), F.locate("]", b) - len(OPEN) - 1)).alias("role"),
        F.split(F.substring(b, F.locate("]", b) + 1, F.length(b)), r"<\+>").alias("texts")))
    turns = F.flatten(F.transform(opened, lambda o: F.transform(o["texts"], lambda t: F.struct(o["role"].alias("role"), unescape(t).alias("text")))))
    losses = F.transform(spans_of(F.col("formatted"), F.col("loss_mask")), unescape)
    return formatted.withColumn("turns", turns).withColumn("loss_texts", losses)


def digest(turns: DataFrame) -> DataFrame:
    """The digest columns of the registered query, over the turns and conversation -1."""
    probe = turns.sparkSession.sql("""
        select -1L as conv_id, turn, role, '</s>[INST] ok [/INST]' as text
        from values (0L, 'user'), (1L, 'assistant') as t(turn, role)""")
    back = read_back(format_chats(turns.select("conv_id", "turn", "role", "text").unionByName(probe)))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


#: DuckDB SQL of :func:`digest`.
DIGEST_SQL = """
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked as (
  select *, lag(role) over w as before, row_number() over w as k,
    length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), ']', '&rsqb;')) as text_chars,
    length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), ']', '&rsqb;')) as role_chars
  from rows window w as (partition by conv_id order by turn, role, text)
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  (sum(text_chars) + sum(case when k > 1 and role = before then 3 else 9 + role_chars end))::bigint as formatted_chars
from marked group by conv_id
"""
