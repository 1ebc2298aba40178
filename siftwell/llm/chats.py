"""Chat formatting by prefix-target expansion.

A conversation is formatted once, turn by turn. Every assistant turn is an example of its own: its context is all
that comes before it in the conversation, and only its text is under the loss mask. As all contexts of a conversation
are prefixes of one text, the formatted turns hold each reply and where its context ends; a conversation of very many
turns may then lie in several tasks. ``expanded`` writes every example with its context, prefix after prefix in order,
which costs up to the square of a conversation's length; ``digests`` are read from those.

Template of a turn: ``### role: text</turn>`` and a line end. In texts and roles ``\\`` becomes ``\\\\``, ``###``
becomes ``\\h`` and ``</turn>`` becomes ``\\e``; in roles ``:`` also becomes ``\\c``. No mark is left inside.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import parts_for, text_bytes, written

_OUT = {"\\\\": "\\", "\\h": "###", "\\e": "</turn>", "\\c": ":"}
_BEGIN, _END = "### ", "</turn>\n"
PART_BYTES = 32 << 20
#: Code points of examples that a task writes at once.
BATCH_CHARS = 4 << 20


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("###", "\\h").replace("</turn>", "\\e")
    return text.replace(":", "\\c") if role else text


def unescape(text: str) -> str:
    return re.sub(r"\\[\\hec]", lambda m: _OUT[m[0]], text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation or a part of one."""
    out = []
    *turns, rest = formatted.split(_END)
    for t in turns:
        role, colon, text = t[len(_BEGIN) :].partition(": ")
        if not t.startswith(_BEGIN) or not colon or ":" in role or "###" in role or "###" in text or "</turn>" in t:
            raise ValueError(f"not a turn: {t[:40]!r}")
        out.append((unescape(role), unescape(text)))
    if rest:
        raise ValueError(f"not a turn: {rest[:40]!r}")
    return out


def format_chats(turns: DataFrame, trained: str = "assistant", part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per turn of ``turns`` (conv_id, turn, role, text), in the conversation's order by ``seg``.

    conv_id, seg (place of the turn, from 0), text (the formatted turn), begin (code points of the conversation before
    it), example (number of the example that this turn is the reply of, else null), loss_begin and loss_end (code
    points of ``text`` under the loss mask, null likewise). An example's context is the conversation's first ``begin``
    code points.

    A null role or text is empty; only the role ``trained`` as it stands is trained on. Turns are in order of turn,
    a null first, then role and text, so repeated turns stay side by side. Rows of a null conv_id are one
    conversation. Other columns are dropped. An empty table gives an empty one.
    """
    spark = turns.sparkSession
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = parts_for(spark, text_bytes(rows), part_bytes)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", F.xxhash64("text")]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order[:3], "text")

    def f(batches):
        from pyspark import TaskContext

        part, seq, first, now = TaskContext.get().partitionId(), 0, True, ()
        seg = begin = example = 0
        for b in batches:
            out: list[list] = [[] for _ in names]
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if now != (conv,):
                    first = not seq
                    now, seg, begin, example = (conv,), 0, 0, 0
                head = f"### {escape(role, True)}: "
                body = escape(text)
                whole = f"{head}{body}</turn>\n"
                mine = role == trained
                for x, v in zip(out, (conv, part, seq, first, seg, whole, begin, len(whole), example, mine, len(head) if mine else None, len(head) + len(body) if mine else None), strict=True):
                    x.append(v)
                seq, seg, begin, example = seq + 1, seg + 1, begin + len(whole), example + mine
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    names = ["conv_id", "part", "seq", "first", "seg", "text", "begin", "chars", "example", "trained", "loss_begin", "loss_end"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
    schema = "conv_id long, part long, seq long, first boolean, seg long, text string, begin long, chars long, example long, trained boolean, loss_begin long, loss_end long"
    local = written(rows.mapInArrow(f, schema), "turns")
    on = local.join(_carried(local), "part", "left")
    more = lambda c: F.col(c) + F.when(F.col("first"), F.coalesce(F.col(c + "0"), F.lit(0))).otherwise(0)
    return on.select("conv_id", more("seg").alias("seg"), "text", more("begin").alias("begin"), F.when(F.col("trained"), more("example")).alias("example"), "loss_begin", "loss_end")


def _carried(local: DataFrame) -> DataFrame:
    """What each part's first conversation has in the parts before it: part, turns, code points, examples so far.

    A conversation that goes on from a part is its last one, so the sums run over one row for each part.
    """
    last = F.max_by(F.struct("conv_id", (F.col("seg") + 1).alias("seg"), (F.col("begin") + F.col("chars")).alias("begin"), (F.col("example") + F.col("trained").cast("int")).alias("example")), "seq")
    ends = local.groupBy("part").agg(F.min_by(F.struct("conv_id"), "seq").alias("head"), last.alias("tail"))
    nothing = [F.lit(0).cast("long").alias(c) for c in ("seg", "begin", "example")]
    heads = ends.select("part", F.lit(True).alias("head"), F.col("head.conv_id").alias("conv_id"), *nothing)
    tails = ends.select("part", F.lit(False).alias("head"), "tail.conv_id", "tail.seg", "tail.begin", "tail.example")
    before = Window.partitionBy("conv_id").orderBy("part", F.desc("head")).rowsBetween(Window.unboundedPreceding, -1)
    sums = heads.unionByName(tails).select("part", "head", *[F.sum(c).over(before).alias(f"{c}0") for c in ("seg", "begin", "example")])
    return sums.filter("head").drop("head")


def expanded(formatted: DataFrame) -> DataFrame:
    """Examples written out: conv_id, example, text (context and reply), loss_begin, loss_end in it; in no order.

    What a conversation has after its last reply is a row of a null example, without the context. Turns stream through
    in order, so a task holds one context and ``BATCH_CHARS`` of examples.
    """

    def f(batches):
        now, context, since = (), "", []
        out: list[tuple] = []
        chars = 0
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("conv_id", "text", "begin", "example", "loss_begin", "loss_end")]
            for conv, text, begin, example, i, j in zip(*columns, strict=True):
                if now != (conv,):
                    if since:
                        out.append((now[0], None, "".join(since), None, None))
                        chars += len(out[-1][2])
                    now, context, since = (conv,), "", []
                since.append(text)
                if example is not None:
                    context += "".join(since)
                    since = []
                    if begin != len(context) - len(text):
                        raise ValueError(f"turns of conversation {conv} are missing before its example {example}")
                    out.append((conv, example, context, begin + i, begin + j))
                    chars += len(context)
                if chars >= BATCH_CHARS:
                    yield _batch(out, names, kinds)
                    out, chars = [], 0
        if since:
            out.append((now[0], None, "".join(since), None, None))
        yield _batch(out, names, kinds)

    names = ["conv_id", "example", "text", "loss_begin", "loss_end"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    return rows.mapInArrow(f, "conv_id long, example long, text string, loss_begin long, loss_end long")


def _batch(rows: list, names: list[str], kinds: list) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)


def flat(formatted: DataFrame) -> DataFrame:
    """Examples written out: conv_id, example, text (context and reply), loss_begin, loss_end in it.

    A conversation of n turns gives up to n/2 texts of up to its length.
    """
    return expanded(formatted).filter("example IS NOT NULL")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its written examples: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    ``formatted_chars`` are the code points of all examples, contexts included. Examples stream through in order, each
    held against the one before it, so a task holds two of them and an Arrow batch.
    """

    def f(batches):
        now, state, before = (), None, ""

        def row():
            return [now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        for b in batches:
            out = []
            for k in range(b.num_rows):
                conv, example, text, i, j = (b.column(c)[k].as_py() for c in ("conv_id", "example", "text", "loss_begin", "loss_end"))
                if now != (conv,):
                    if state:
                        out.append(row())
                    now, state, before = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0], ""
                more = text
                if example is not None:
                    if not text.startswith(before):
                        raise ValueError(f"example {example} of conversation {conv} doesn't go on from the one before it")
                    more, before = text[len(before) :], text
                    reply = unescape(text[i:j])
                    state[2] += len(reply)
                    state[3].update(reply.encode())
                    state[4] += len(text)
                for role, said in parse(more):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
            yield _batch(out, names, kinds)
        if state:
            yield _batch([row()], names, kinds)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    examples = written(expanded(formatted), "examples").repartition("conv_id").sortWithinPartitions("conv_id", F.col("example").asc_nulls_last())
    return examples.mapInArrow(f, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation whose texts hold the template's own marks.
TRICKY = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op3_chat_examples(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame(TRICKY, "conv_id long, turn long, role string, text string")
    return digests(format_chats(turns.unionByName(tricky)))


OP3_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
escaped AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e') AS body,
  replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ':', '\c') AS name FROM turns),
placed AS (SELECT *, sum(length('### ' || name || ': ' || body || '</turn>' || chr(10))) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM escaped)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(coalesce(sum(upto) FILTER (role = 'assistant'), 0) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""
