"""Chat formatting with a grammar round trip, in DataFrame expressions only.

Grammar (every turn is one of these, and a conversation is nothing but turns):

    user:       [INST] text [/INST]
    assistant:  <s> text </s>
    system:     <<SYS>> text <</SYS>>
    any other:  [ROLE] role [SEP] text [/ROLE]

No text or role may contain a control string. Rendered text is read back by that grammar with one regular expression and
compared with the source. Turns that do not come back as they were get their control strings escaped, and the conversation is rendered and read again, until source and
reading are identical: at most twice, since the third rendering escapes every turn and escaped text holds no control string.
Escaping puts a backslash after the first character of a control string, or one more if it has some already, so reading
takes one away: reversible for every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings behind their first character.
_REST = r"(?:/?INST\]|/?ROLE\]|SEP\]|/?s>|</?SYS>>)"
_PLAIN = r"([\[<])(\\*" + _REST + ")"
_ESCAPED = r"([\[<])\\(\\*" + _REST + ")"
_CONTROL = r"[\[<]" + _REST
_TURN = r"(?s)\[INST\] (.*?) \[/INST\]|<s> (.*?) </s>|<<SYS>> (.*?) <</SYS>>|\[ROLE\] (.*?) \[SEP\] (.*?) \[/ROLE\]"
_OPEN = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def _before(role: Column, text_escaped: Column) -> Column:
    """What stands before a turn's text."""
    shown = F.when(text_escaped, escape(role)).otherwise(role)
    out = F.concat(F.lit("[ROLE] "), shown, F.lit(" [SEP] "))
    for name, (opening, _) in _OPEN.items():
        out = F.when(role == name, F.lit(opening)).otherwise(out)
    return out


def _after(role: Column) -> Column:
    out = F.lit(" [/ROLE]")
    for name, (_, closing) in _OPEN.items():
        out = F.when(role == name, F.lit(closing)).otherwise(out)
    return out


def _render(turns: Column) -> Column:
    """The pieces of every turn: before, body, after."""
    return F.transform(turns, lambda t: F.struct(_before(t["role"], t["escaped"]).alias("before"), F.when(t["escaped"], escape(t["text"])).otherwise(t["text"]).alias("body"), _after(t["role"]).alias("after")))


def _joined(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: F.concat(p["before"], p["body"], p["after"])), "")


def parse(text: Column) -> Column:
    """Reads a rendered conversation: array of (role, text), or null if the grammar does not hold.

    It holds if the whole is made of turns and no role or body contains a control string.
    """
    found = F.regexp_extract_all(text, F.lit(_TURN), F.lit(0))

    def turn(one: Column) -> Column:
        role = F.regexp_extract(one, r"(?s)^\[ROLE\] (.*?) \[SEP\] ", 1)
        body = F.regexp_extract(one, r"(?s)^\[ROLE\] .*? \[SEP\] (.*) \[/ROLE\]$", 1)
        for name, (opening, closing) in _OPEN.items():
            mine = one.startswith(opening)
            role = F.when(mine, F.lit(name)).otherwise(role)
            body = F.when(mine, one.substr(F.lit(len(opening) + 1), F.length(one) - len(opening) - len(closing))).otherwise(body)
        return F.struct(role.alias("role"), body.alias("text"))

    raw = F.transform(found, turn)
    clean = F.forall(raw, lambda t: ~t["role"].rlike(_CONTROL) & ~t["text"].rlike(_CONTROL))
    plain = F.transform(raw, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))
    return F.when((F.array_join(found, "") == text) & clean, plain)


def _checked(df: DataFrame, turns: str) -> DataFrame:
    """Renders ``turns`` and reads the rendering back; adds ``_pieces``, ``formatted`` and ``_read``."""
    df = df.withColumn("_pieces", _render(F.col(turns)))
    df = df.withColumn("formatted", _joined(F.col("_pieces")))
    return df.withColumn("_read", parse(F.col("formatted")))


def _same(df_turns: str) -> Column:
    source = F.transform(F.col(df_turns), lambda t: F.struct(t["role"], t["text"]))
    return F.coalesce(F.col("_read") == source, F.lit(False))


def _again(df: DataFrame, escaped: Column) -> DataFrame:
    """Conversations that came back identical as they are, the others with ``escaped`` set and rendered again."""
    df = df.withColumn("_turns", F.when(_same("_turns"), F.col("_turns")).otherwise(escaped))
    return _checked(df, "_turns")


def format_chats(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per conversation of ``turns`` (``conv_id``, ``turn``, ``role``, ``text``).

    ``conv_id``; ``formatted``; ``turns``: array of (role, text) read back from it; ``loss``: array of (start, length), the
    code points of ``formatted`` that hold the bodies of ``trained`` turns. Turns go by number (null first), then role and
    text. Null texts and roles are empty; rows without conv_id are one conversation; repeated rows are turns of their own. No
    row gives no conversation. Other columns are not read. A conversation is one row, as any format must write it as one text.
    """
    source = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    df = source.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("_all"))
    df = df.withColumn("_turns", F.transform("_all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), F.lit(False).alias("escaped")))).drop("_all")
    df = _checked(df, "_turns")
    alone = lambda t: parse(_joined(_render(F.array(t))))
    suspects = F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), (~F.coalesce(alone(t) == F.array(F.struct(t["role"], t["text"])), F.lit(False))).alias("escaped")))
    df = _again(df, suspects)
    every = F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), F.lit(True).alias("escaped")))
    df = _again(df, every)
    df = df.withColumn("_read", F.when(_same("_turns"), F.col("_read")).otherwise(F.raise_error(F.lit("a conversation did not come back identical"))))
    lengths = F.transform("_pieces", lambda p: F.length(p["before"]) + F.length(p["body"]) + F.length(p["after"]))
    starts = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    df = df.withColumn("_starts", starts)
    spans = F.transform("_pieces", lambda p, i: F.struct((F.element_at("_starts", i + 1) + F.length(p["before"])).cast("long").alias("start"), F.length(p["body"]).cast("long").alias("length")))
    roles = F.col("_turns")
    loss = F.filter(spans, lambda s, i: F.element_at(roles, i + 1)["role"] == trained)
    return df.select("conv_id", "formatted", F.col("_read").alias("turns"), loss.alias("loss"))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
