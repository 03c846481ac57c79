"""Chat formatting that is proved by reading it back, in DataFrame functions only.

A turn is written `<|im_start|>role\\ntext<|im_end|>\\n`; a conversation is
its turns, one after the other. The grammar has one reading: a text ends at the
first `<|im_end|>`, no other control string `<|name|>` may stand in a turn, and
the reader takes escapes back. Each turn is written plainly first and reparsed;
where the recovered turn differs from its source (a control string in the text,
or something that looks like an escape) the text is escaped, then the role too,
until both are identical. The whole conversation is reparsed and compared again.

Escapes: in texts `<`, any number of backslashes and `|` gain one backslash; in
roles `%`, the line feed and `<` become `%25`, `%0A` and `%3C`. Texts without
conflicts stay as they are.

The loss mask comes as runs (chars, loss) that cover the formatted text in
order, three a turn: its opening, its text, its end. Only texts of the trained
role are under the loss.

Odd rows: a null text or role counts as empty; rows without conversation id
form one conversation of their own; turns are ordered by number (null first),
ties by role and text, and repeated rows stay as repeated turns; other columns
are ignored. No rows give no conversations. One conversation is one value of
the result, so Spark's 2 GB a value bound it; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
CONTROL = r"<\|[A-Za-z0-9_]+\|>"

_OPEN, _CLOSE = "\n", f"{END}\n"
_TURN = "struct<role:string,text:string>"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    for char, code in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(char), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for char, code in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(char))
    return role


def _written(formatted: Column) -> Column:
    """The turns of a formatted text as they are written, (role, text), each null where the grammar is broken."""
    pieces = F.split(formatted, rf"\Q{START}\E", -1)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, _OPEN, 1)
        text = piece.substr(F.length(role) + 2, F.length(piece) - F.length(role) - (1 + len(_CLOSE)))
        whole = F.concat(role, F.lit(_OPEN), text, F.lit(_CLOSE)) == piece
        return F.when(whole & ~F.rlike(F.concat(role, F.lit(_OPEN), text), F.lit(CONTROL)),
                      F.struct(role.alias("role"), text.alias("text")))

    # what stands before the first turn must be empty
    return F.when(F.get(pieces, F.lit(0)) == "", F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text; null if it isn't of the grammar."""
    turns = _written(formatted)
    return F.when(F.forall(turns, lambda t: t.isNotNull()),
                  F.transform(turns, lambda t: F.struct(unescape_role(t["role"]).alias("role"),
                                                        unescape_text(t["text"]).alias("text"))))


def _rendered(role: Column, text: Column) -> tuple[Column, Column]:
    return F.concat(F.lit(START), role, F.lit(_OPEN)), text


def render_turn(role: Column, text: Column) -> Column:
    """(opening, text) of a turn, escaped no more than it takes to read the same turn back."""
    source = F.array(F.struct(role.alias("role"), text.alias("text")).cast(_TURN))
    steps = []
    for r, t in ((role, text), (role, escape_text(text)), (escape_role(role), escape_text(text))):
        opening, body = _rendered(r, t)
        same = parse(F.concat(opening, body, F.lit(_CLOSE))).eqNullSafe(source)
        steps.append(F.when(same, F.struct(opening.alias("opening"), body.alias("text"))))
    return F.coalesce(*steps)


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted and mask (runs of chars and loss) of each conversation of rows (conv_id, turn, role, text)."""
    turns = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.select("conv_id", F.struct("turn", "role", "text",
                                             render_turn(F.col("role"), F.col("text")).alias("as")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["as"]["opening"], t["as"]["text"],
                                                                     F.lit(_CLOSE))), "")

    def run(chars: Column, loss: Column) -> Column:
        return F.struct(chars.cast("long").alias("chars"), loss.alias("loss"))

    mask = F.flatten(F.transform("turns", lambda t: F.array(
        run(F.length(t["as"]["opening"]), F.lit(False)),
        run(F.length(t["as"]["text"]), t["role"] == TRAINED_ROLE),
        run(F.lit(len(_CLOSE)), F.lit(False)))))
    whole = whole.select("conv_id", "turns", formatted.alias("formatted"), mask.alias("mask"))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return whole.select(
        "conv_id",
        F.when(parse(F.col("formatted")).eqNullSafe(source), F.col("formatted"))
        .otherwise(F.raise_error(F.lit("a formatted conversation doesn't read back as its turns")).cast("string"))
        .alias("formatted"), "mask")


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted texts and their masks say: turns, the text under the loss, and their digests."""
    written = formatted.select("conv_id", "formatted", "mask", parse(F.col("formatted")).alias("turns"),
                               _written(F.col("formatted")).alias("written"))
    runs = F.filter("mask", lambda _, i: i % 3 == 1)
    pairs = F.arrays_zip(F.col("written").alias("w"), runs.alias("r"))
    loss = F.array_join(F.transform(F.filter(pairs, lambda z: z["r"]["loss"]),
                                    lambda z: unescape_text(z["w"]["text"])), "")
    fits = F.forall(pairs, lambda z: F.length(z["w"]["text"]) == z["r"]["chars"])
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return written.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.when(fits, loss).otherwise(F.raise_error(F.lit("a mask doesn't fit its text")).cast("string")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    ).select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
             F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
