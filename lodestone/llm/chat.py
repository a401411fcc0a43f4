"""Chat formatting with Spark expressions: sorted turns, merged neighbours, reversible escapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrays import let, running

# The template. A block holds neighbouring turns of one role, parted by PART.
OPEN, CLOSE, PART = "### ", ": ", "<part/>"
END = "</turn>\n"
#: Control strings inside texts and roles, and what stands for them. Every backslash goes first, so that
#: one in an escaped text always starts an escape; no escape's result is read again.
ESCAPES = [("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\e"), ("<part/>", "\\p")]
#: Characters of a cut of a formatted text.
CUT = 4096
#: Roles also lose the string that ends a header.
ROLE_ESCAPES = [*ESCAPES, (":", "\\c")]


def _replace(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column) -> Column:
    return _replace(text, ESCAPES)


def unescape(text: Column) -> Column:
    return _replace(text, [(new, old) for old, new in ESCAPES[::-1]])


def _role_name(role: Column) -> Column:
    return _replace(role, [(new, old) for old, new in ROLE_ESCAPES[::-1]])


def format_conversations(turns: DataFrame, trained_role: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_mask): one row per conversation.

    Turns are sorted by turn, then role and text. Neighbouring turns of one role become one block:
    `### role: text<part/>text</turn>` and a line end. Control strings in texts are escaped; read_back()
    undoes it. loss_mask is an array of (start, length) in characters of formatted, one for each text of
    the trained role, without marks between them.

    Null text and null role count as empty; a null turn sorts first; every row with a null conv_id is a conversation
    of its own. Repeated rows are turns like others. Other columns are ignored; an empty table gives no rows.
    A conversation becomes one text, so it is collected into one row.
    """
    given = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    alone = F.when(F.col(f"`{conv_col}`").isNull(), F.monotonically_increasing_id())
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), alone.alias("alone"), F.struct(F.col(f"`{turn_col}`").alias("turn"), given(role_col).alias("role"), given(text_col).alias("text")).alias("said"))
    listed = F.transform(F.array_sort(F.collect_list("said")), lambda t: F.struct(t["role"].alias("role"), escape(t["text"]).alias("text")))
    sorted_turns = rows.groupBy("conv_id", "alone").agg(listed.alias("turns"))
    # a turn opens a block if the role before it is another, closes one if the role behind it is
    at = lambda k: F.try_element_at("turns", k)["role"]
    opens = lambda t, i: (i == 0) | (at(F.greatest(i, F.lit(1))) != t["role"])
    closes = lambda t, i: F.coalesce(at(i + 2) != t["role"], F.lit(True))
    header = lambda t: F.concat(F.lit(OPEN), _replace(t["role"], ROLE_ESCAPES), F.lit(CLOSE))
    marked = F.transform(
        "turns",
        lambda t, i: F.struct(
            F.when(opens(t, i), header(t)).otherwise(F.lit(PART)).alias("before"),
            t["text"].alias("text"),
            F.when(closes(t, i), F.lit(END)).otherwise(F.lit("")).alias("behind"),
            (t["role"] == F.lit(trained_role)).alias("trained"),
        ),
    )
    pieces = sorted_turns.select("conv_id", marked.alias("pieces"))
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["behind"])), "")
    size = lambda p: F.length(p["before"]) + F.length(p["text"]) + F.length(p["behind"])
    starts = running(F.transform("pieces", size), F.lit(0), lambda a, b: a + b, "int")
    said = F.zip_with("pieces", starts, lambda p, at: F.struct((at + F.length(p["before"])).alias("start"), F.length(p["text"]).alias("length"), p["trained"].alias("trained")))
    mask = F.transform(F.filter(said, lambda s: s["trained"]), lambda s: F.struct(s["start"], s["length"]))
    return pieces.select("conv_id", formatted.alias("formatted"), mask.alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns, an array of (role, text), and loss_texts: both from the formatted text and its mask alone."""
    blocks = F.filter(F.split("formatted", END.replace("/", "\\/"), -1), lambda b: b != "")
    body = lambda b: F.substring(b, F.lit(len(OPEN) + 1), F.length(b))

    def turns(block):
        head = F.substring_index(body(block), CLOSE[0], 1)
        texts = F.split(F.substring(body(block), F.length(head) + len(CLOSE) + 1, F.length(block)), PART, -1)
        return F.transform(texts, lambda t: F.struct(_role_name(head).alias("role"), unescape(t).alias("text")))

    # a place in a long text is found by counting from its start, so the text is cut once and places are looked up in its cuts
    cut = lambda cuts, s: F.array_join(F.slice(cuts, F.floor(s["start"] / CUT).cast("int") + 1, F.floor((s["start"] % CUT + s["length"]) / CUT).cast("int") + 1), "")
    cuts = F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    loss = let(cuts, lambda c: F.transform("loss_mask", lambda s: unescape(F.substring(cut(c, s), s["start"] % CUT + 1, s["length"]))))
    return formatted.withColumn("turns", F.flatten(F.transform(blocks, turns))).withColumn("loss_texts", loss)
