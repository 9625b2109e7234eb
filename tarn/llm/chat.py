"""Chat formatting of typed content parts, in DataFrame functions only.

A turn holds text, image, audio and document parts. A visitor walks them in order: texts are escaped, the others become
placeholders that name their kind and place, and are recorded as attachments with the tokens that they expand to. Control
strings of the template start with "<|"; inside texts a backslash is doubled, "<|" becomes "<\\|", and a part that follows
another one has a "|" at its start escaped as well, so no text and no sequence of texts can forge a mark. Each escaped
character depends on its own part alone, one pass over the escapes gives each text back, and a placeholder written inside a
text is told from a real one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
PARTS = "array<struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256
LEARNT = "assistant"
ATTACHED = ("image", "audio", "document")
_HOLDER = rf"<\|(?:{'|'.join(ATTACHED)}) [0-9]{{1,9}}\|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A content array of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *(F.lit(None).cast(k).alias(n) for n, k in (("uri", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))).cast(PARTS)


def part_tokens(part: Column) -> Column:
    """Tokens a part expands to: patches of an image, frames of audio, pages of a document; 0 for texts and unknown sizes."""
    image = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    count = F.when(part["type"] == "image", image).when(part["type"] == "audio", F.ceil(part["seconds"] * AUDIO_RATE)).when(part["type"] == "document", part["pages"] * PAGE_TOKENS)
    return F.greatest(F.lit(0).cast("long"), F.coalesce(count.cast("long"), F.lit(0).cast("long")))


def visit(part: Column, place: Column) -> Column:
    """The text of one part: escaped, or a placeholder with its place in the turn. A null part is empty, one of another kind is its text."""
    holder = F.concat(F.lit("<|"), part["type"], F.lit(" "), place.cast("string"), F.lit("|>"))
    apart = F.when((place > 0) & part["text"].startswith("|"), "\\").otherwise("")  # the text before may end with "<"
    return F.when(part["type"].isin(*ATTACHED), holder).otherwise(F.coalesce(F.concat(apart, escape(part["text"])), F.lit("")))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "content", learnt: str = LEARNT) -> DataFrame:
    """One row a conversation: conv id, n_turns, formatted, turns (start, length and loss of each body in code points of
    formatted), attachments (turn, part, type, uri, tokens) and attachment_tokens.

    turns: rows with a content array of parts (PARTS). Rows stand by turn (null first), then by role and formatted body, so
    ties and repeated rows have one order. Null roles and texts are empty; a null conversation id is one like others; an
    empty content array or null is an empty body. loss marks the bodies of the learnt role. Other columns are not read. No
    rows give no rows. A conversation is one string and so must fit a task (2 GB at most).
    """
    content = F.coalesce(F.col(content_col), F.array().cast(PARTS))
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.array_join(F.transform(content, lambda p, i: visit(p, i)), "").alias("body"),
        F.filter(
            F.transform(content, lambda p, i: F.struct(F.col(turn_col).alias("turn"), i.alias("part"), p["type"].alias("type"), p["uri"].alias("uri"), part_tokens(p).alias("tokens"))),
            lambda a: a["type"].isin(*ATTACHED),
        ).alias("attached"),
    )
    rows = rows.withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY)))
    order = W.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    before = F.coalesce(F.sum(F.length("head") + F.length("body") + len(END)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("at", before.cast("long")).withColumn("nth", F.row_number().over(order))
    grouped = rows.groupBy("conv").agg(
        F.count("*").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("nth", F.concat("head", "body", F.lit(END)).alias("piece"), (F.col("at") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"), (F.col("role") == learnt).alias("loss"), "attached"))).alias("t"),
    )
    attachments = F.flatten(F.col("t.attached"))
    return grouped.select(
        F.col("conv").alias(conv_col),
        "n_turns",
        F.array_join("t.piece", "").alias("formatted"),
        F.transform("t", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"), x["loss"].alias("loss"))).alias("turns"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("attachment_tokens"),
    )


def _parts(body: Column) -> Column:
    """The parts of an escaped body: (type, text, place), neighbouring texts as one; place is null of texts."""
    pieces = F.when(F.contains(body, F.lit("<|")), F.split(body, rf"(?={_HOLDER})|(?<={_HOLDER})")).otherwise(F.array(body))

    def part(piece):
        held = F.split(F.substring(piece, 3, 1 << 30), r"[ |]")
        is_held = piece.startswith("<|")
        return F.struct(
            F.when(is_held, F.get(held, 0)).otherwise("text").alias("type"),
            F.when(~is_held, unescape(piece)).alias("text"),
            F.when(is_held, F.get(held, 1).cast("int")).alias("place"),
        )

    return F.transform(F.filter(pieces, lambda x: x != ""), part)


def read_chats(formatted: Column, turns: Column) -> Column:
    """The turns read back from a formatted conversation and its mask: an array of (role, parts, text, loss).

    A body is what start and length of the mask name; a conversation whose turns do not stand where the mask says is an error.
    parts: (type, text, place) in order, an attachment by its place in the turn; text: the texts alone.
    """
    pieces = F.slice(F.split(formatted, r"<\|end\|>\n"), F.lit(1), F.size(turns))

    def turn(piece, i):
        t, last = F.get(turns, i), F.get(turns, i - 1)
        begin = F.coalesce(last["start"] + last["length"] + len(END), F.lit(0).cast("long"))
        head = (t["start"] - begin).cast("int")
        fits = (F.length(piece) == t["start"] + t["length"] - begin) & (F.substring(piece, 1, len(TURN)) == TURN) & (piece.substr(head - len(BODY) + 1, F.lit(len(BODY))) == BODY)
        held = F.when(fits, piece).otherwise(F.raise_error(F.lit("a turn does not stand where the mask says")).cast("string"))
        role = unescape(held.substr(F.lit(len(TURN) + 1), head - len(TURN) - len(BODY)))
        return F.struct(role.alias("role"), _parts(held.substr(head + 1, t["length"].cast("int"))).alias("parts"), t["loss"].alias("loss"))

    texts = lambda parts: F.array_join(F.transform(F.filter(parts, lambda x: x["type"] == "text"), lambda x: x["text"]), "")
    return F.transform(F.transform(pieces, turn), lambda t: F.struct(t["role"].alias("role"), t["parts"].alias("parts"), texts(t["parts"]).alias("text"), t["loss"].alias("loss")))
