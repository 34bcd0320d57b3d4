"""Chat formatting with a grammar round trip.  DataFrame functions only.

conversation := ``<s>`` turn*
turn         := ``[INST]`` T ``[/INST]`` (user) | ``<<SYS>>`` T ``<</SYS>>`` (system)
              | ``[OUT]`` T ``</s>`` (assistant) | ``[ROLE]`` R ``[TURN]`` T ``[/ROLE]`` (other)

The parser is deterministic: it splits a string at all control strings; a turn is a closing
string that directly follows its opening one, T and R are what stands between, unescaped.  So
a control string inside a text breaks its turn.

Formatting is a loop.  A conversation is rendered with its texts as they are, parsed again, and
compared with its source.  Where it is not identical, the texts whose own turns the parser does not
recover are escaped (a backslash after the first character of a control string, backslashes
doubled) and the whole is rendered, parsed and compared again; in a last round all texts are
escaped; what still differs raises an error.

Edge cases: null text and null role are empty; a null conv_id is a conversation of its
own; turns of equal number are ordered by role, then text; repeated rows stay; a text of any
length is taken whole (a conversation is one string, so at most 2 GB); an empty table gives no
conversation; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"</?s>|\[/?INST\]|<<SYS>>|<</SYS>>|\[OUT\]|\[/?ROLE\]|\[TURN\]"
FIRST = r"([<\[])(?=/?s>|/?INST\]|<SYS>>|</SYS>>|OUT\]|/?ROLE\]|TURN\])"
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("[OUT]", "</s>")}


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), FIRST, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(role: Column, text: Column) -> Column:
    """The markup of one turn around a text that is taken as it is."""
    out = F.concat(F.lit("[ROLE]"), escape(role), F.lit("[TURN]"), text, F.lit("[/ROLE]"))
    for name, (begin, end) in MARKS.items():
        out = F.when(role == name, F.concat(F.lit(begin), text, F.lit(end))).otherwise(out)
    return out


def parse(formatted: Column) -> Column:
    """array<struct(role, text)> of a formatted conversation."""
    marks = F.regexp_extract_all(formatted, F.lit(CONTROL), F.lit(0))
    between = F.split(formatted, CONTROL)  # between[i] stands before marks[i]
    none = lambda n: F.array(*(F.lit("") for _ in range(n)))

    def turn(x: Column) -> Column:
        mark, before, before_that = x["marks"], x["2"], x["3"]
        text = unescape(x["between"])
        other = (mark == "[/ROLE]") & (before == "[TURN]") & (before_that == "[ROLE]")
        found = F.when(other, F.struct(unescape(x["4"]).alias("role"), text.alias("text")))
        for name, (begin, end) in MARKS.items():
            found = found.when((mark == end) & (before == begin), F.struct(F.lit(name).alias("role"), text.alias("text")))
        return found

    def turns(split: Column) -> Column:
        m, b = split["marks"], split["between"]
        # what a turn needs is laid side by side: a lambda that reaches into an array expression would make it anew each time
        around = F.arrays_zip(m, b, F.concat(none(1), m), F.concat(none(2), m), F.concat(none(1), b))
        return F.filter(F.transform(around, turn), lambda t: t.isNotNull())

    # the variable of a lambda is a value: the string is split once
    return F.flatten(F.transform(F.array(F.struct(marks.alias("marks"), between.alias("between"))), turns))


def _rendered(turns: Column, escaped: Column) -> Column:
    """The conversation; ``escaped`` says of each turn whether its text is escaped."""
    one = lambda t, e: render(t["role"], F.when(e, escape(t["text"])).otherwise(t["text"]))
    return F.concat(F.lit("<s>"), F.array_join(F.zip_with(turns, escaped, one), ""))


def _own_conflict(t: Column) -> Column:
    """Whether the parser does not recover a turn that is rendered as it is."""
    return parse(render(t["role"], t["text"])) != F.array(F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, n_escaped): one string per conversation, which the parser turns back
    into its source.

    A conversation is one value and so stands in one row; its turns are gathered map-side first."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    turns = rows.select("conv_id", F.struct("turn", text("role"), text("text")).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    # a generator's output is a value, so no round is computed twice
    value = lambda df, column, name: df.select("*", F.explode(F.array(column)).alias(name))
    plain = turns.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    rounds = (lambda t: F.lit(False), _own_conflict, lambda t: F.lit(True))
    done = plain.withColumns({"formatted": F.lit(None).cast("string"), "n_escaped": F.lit(0)})
    for conflict in rounds:
        open_ = F.col("formatted").isNull()
        tried = value(done, F.when(open_, F.transform("turns", conflict)), "escaped")
        tried = value(tried, F.when(open_, _rendered(F.col("turns"), F.col("escaped"))), "again")
        same = open_ & (parse(F.col("again")) == F.col("turns"))
        done = value(tried, F.when(same, F.struct(F.col("again").alias("formatted"), F.size(F.filter("escaped", lambda e: e)).alias("n_escaped"))), "found").select(
            "conv_id", "turns", F.coalesce("formatted", "found.formatted").alias("formatted"), F.coalesce("found.n_escaped", "n_escaped").alias("n_escaped")
        )
    sure = F.coalesce("formatted", F.raise_error(F.lit("a conversation is not recovered")).cast("string"))
    return done.select("conv_id", sure.alias("formatted"), "n_escaped")


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_text): turns parsed from the formatted string, and
    the unescaped text under the loss mask (each assistant text once, in order)."""
    parsed = chats.withColumn("turns", parse(F.col("formatted")))
    spoken = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"])
    return parsed.withColumn("loss_text", F.array_join(spoken, ""))
