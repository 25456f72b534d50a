"""Chat formatting with a grammar that is read back.

A turn is written as `### Role: text</turn>` and a line break. The parser cuts at `</turn>`, reads the role up
to the first `: `, and undoes the escapes in the rest. A text that holds `###` or `</turn>` is not in the
grammar. Each turn is tried as it is, parsed, and compared with its source; if it differs, its control strings
are escaped and it is tried again. The formatted conversation is then parsed as a whole and compared turn by
turn; a difference stops the job.

Escapes: `\\` becomes `\\b`, `###` becomes `\\h`, `</turn>` becomes `\\t`, and in roles `:` becomes `\\c`. No
escaped text holds a control string, so cutting needs no look behind.

Defined cases: null text and null role are empty; turns are ordered by number, then by their written form, null
numbers first; a null conv_id is one conversation; repeated rows are turns of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
LABELS = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
HEAD, MID, END = "### ", ": ", "</turn>"
LEARNED = "assistant"
CHUNK = 4096  # code points
BLOCK = 64  # turns joined in a first step, so that a long conversation is not gathered turn by turn


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("###", "\\h"), (END, "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for code, plain in (("\\t", END), ("\\h", "###"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def label_of(role: Column) -> Column:
    """Known roles by name; any other as @ and its escaped text."""
    known = F.lit(None).cast("string")
    for name, label in LABELS.items():
        known = F.when(role == name, label).otherwise(known)
    return F.coalesce(known, F.concat(F.lit("@"), F.replace(escape(role), F.lit(":"), F.lit("\\c"))))


def role_of(label: Column) -> Column:
    other = unescape(F.replace(F.substring(label, 2, 1 << 30), F.lit("\\c"), F.lit(":")))
    known = F.lit(None).cast("string")
    for name, written in LABELS.items():
        known = F.when(label == written, name).otherwise(known)
    return F.coalesce(known, F.when(label.startswith("@"), other))


def render_turn(role: Column, body: Column) -> Column:
    return F.concat(F.lit(HEAD), label_of(role), F.lit(MID), body, F.lit(END), F.lit("\n"))


def parse_turn(piece: Column) -> Column:
    """(role, text) of a piece before its end mark; null where it is not in the grammar."""
    head, rest = F.substring_index(piece, MID, 1), F.locate(MID, piece)
    body = F.substr(piece, rest + len(MID))
    good = piece.startswith(HEAD) & (rest > 0) & ~body.contains("###") & ~body.contains(END)
    role = role_of(F.substr(head, F.lit(len(HEAD) + 1)))
    return F.when(good, F.struct(role.alias("role"), unescape(body).alias("text")))


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation, in order."""
    pieces = F.split(formatted, END + "\n")
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), parse_turn)


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, spans): one row per conversation of (conv_id, turn, role, text).

    turns: role and text read back from `formatted`. spans: start and end, in code points of `formatted`, of the
    written texts of assistant turns, which are the ones to learn from.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    # the piece up to its end mark is all that the parser sees of a turn
    reads_back = lambda body: parse_turn(
        F.concat(F.lit(HEAD), label_of(F.col("role")), F.lit(MID), body)
    ).eqNullSafe(F.struct("role", "text"))
    tried = F.when(reads_back(F.col("text")), F.col("text")).otherwise(escape(F.col("text")))
    turns = turns.withColumn("body", tried)
    written = render_turn(F.col("role"), F.col("body"))
    lead = F.length(F.concat(F.lit(HEAD), label_of(F.col("role")), F.lit(MID)))
    turns = turns.select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).alias("block"),
        F.struct(
            "turn",
            written.alias("written"),
            F.length(written).cast("long").alias("size"),
            F.when(F.col("role") == LEARNED, lead.cast("long")).alias("lead"),
            F.length("body").cast("long").alias("body_size"),
            F.xxhash64("role", "text").alias("source"),
        ).alias("t"),
    )
    blocks = turns.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    blocks = blocks.withColumn("starts", running_starts("ts", lambda t: t.size))
    spans = F.filter(
        F.transform(
            "ts",
            lambda t, i: F.struct(
                (F.get("starts", i) + t.lead).alias("start"), (F.get("starts", i) + t.lead + t.body_size).alias("end")
            ),
        ),
        lambda s: s.start.isNotNull(),
    )
    blocks = blocks.select(
        "conv_id",
        F.struct(
            "block",
            F.array_join(F.transform("ts", lambda t: t.written), "").alias("written"),
            F.aggregate("ts", F.lit(0).cast("long"), lambda a, t: a + t.size).alias("size"),
            spans.alias("spans"),
            F.transform("ts", lambda t: t.source).alias("sources"),
        ).alias("b"),
    )
    chats = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    chats = chats.withColumn("starts", running_starts("bs", lambda b: b.size))
    moved = F.transform(
        "bs",
        lambda b, i: F.transform(
            b.spans, lambda s: F.struct((s.start + F.get("starts", i)).alias("start"), (s.end + F.get("starts", i)).alias("end"))
        ),
    )
    chats = chats.select(
        "conv_id",
        F.array_join(F.transform("bs", lambda b: b.written), "").alias("formatted"),
        F.flatten(moved).alias("spans"),
        F.flatten(F.transform("bs", lambda b: b.sources)).alias("sources"),
    )
    chats = chats.withColumn("turns", parse(F.col("formatted")))
    same = F.transform("turns", lambda t: F.xxhash64(t.role, t.text)) == F.col("sources")
    checked = F.when(same, F.col("formatted")).otherwise(
        F.raise_error(F.concat(F.lit("conversation does not read back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    )
    return chats.select("conv_id", checked.alias("formatted"), "turns", "spans")


def under_mask(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask: what `formatted` holds at each span, unescaped, joined with nothing between.

    A span is cut from the few chunks that it touches, not from the start of a long conversation.
    """

    def cut(chunks: Column, span: Column) -> Column:
        first = F.floor(span.start / CHUNK).cast("int")
        touched = F.slice(chunks, first + 1, F.floor(span.end / CHUNK).cast("int") - first + 1)
        return F.substr(F.array_join(touched, ""), (span.start % CHUNK + 1).cast("int"), (span.end - span.start).cast("int"))

    joined = lambda chunks: F.array_join(F.transform(spans, lambda s: unescape(cut(chunks, s))), "")
    # an array of one, so that the conversation is divided once and not for each span
    return F.get(F.transform(F.array(F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{CHUNK}}}"), 0)), joined), 0)


def running_starts(items: str, size) -> Column:
    """Sum of the sizes before each item."""
    empty = F.array().cast("array<bigint>")
    step = lambda a, x: F.struct(
        (a.at + size(x)).alias("at"), F.concat(a.starts, F.array(a.at)).alias("starts")
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("starts"))
    return F.aggregate(items, start, step, lambda a: a.starts)
