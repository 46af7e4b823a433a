"""Chat formatting by a grammar round trip. DataFrame functions only.

A turn is an opening mark, a space, its text, a space and a closing mark. A text that holds no mark goes in as it is;
one whose rendered turn doesn't parse back to itself has its marks escaped. Escaping `[INST]` puts a backslash
behind the first character, `[\\INST]`, and one more where there are some, so an escaped text holds no mark, the
parser has nothing to weigh, and taking one backslash away gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The marks around the texts of a role. A turn of any other role stands between OTHER's, its opening mark ending in the role and >>.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<<ROLE ", "<</ROLE>>")
#: The roles whose texts are under the loss mask.
LEARNED = ("assistant",)

_ALL = [m for pair in (*MARKS.values(), OTHER) for m in pair]


def _quoted(s: str) -> str:
    """s as a regular expression that means the same in Java and in RE2."""
    return "".join("\\" + c if not (c.isalnum() or c in " <>/_:") else c for c in s)


#: What may be a mark, taken apart behind its first character, with any number of backslashes there.
_BODIES = "|".join(_quoted(m[1:]) for m in _ALL)
MARKED, ESCAPED = f"([\\[<])(\\\\*)({_BODIES})", f"([\\[<])\\\\(\\\\*)({_BODIES})"
MARK = "|".join(_quoted(m) for m in _ALL)
_OPEN = {role: f"{_quoted(a)} " for role, (a, _) in MARKS.items()}
_ROLE = f"{_quoted(OTHER[0])}[^>]*>> "
#: One turn where the last one ended. Lazy up to the first closing mark, without nested repeats, so long texts need no stack.
TURN = "(?s)\\G(?:" + "|".join([*(f"{_OPEN[r]}.*? {_quoted(b)}" for r, (_, b) in MARKS.items()), f"{_ROLE}.*? {_quoted(OTHER[1])}"]) + ")"


def escape(text: Column) -> Column:
    """text with a backslash more in each mark; texts without marks stay."""
    return F.regexp_replace(text, MARKED, "$1\\\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def opening(role: Column) -> Column:
    """The opening mark of a role and the space behind it. In a role without a mark of its own, \\ is written \\b and > is written \\g."""
    name = F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit(">"), F.lit("\\g"))
    out = F.concat(F.lit(OTHER[0]), name, F.lit(">> "))
    for r, (a, _) in MARKS.items():
        out = F.when(role == r, f"{a} ").otherwise(out)
    return out


def closing(role: Column) -> Column:
    out = F.lit(f" {OTHER[1]}")
    for r, (_, b) in MARKS.items():
        out = F.when(role == r, f" {b}").otherwise(out)
    return out


def _role_of(piece: Column) -> Column:
    name = F.regexp_extract(piece, f"^{_ROLE}".replace("[^>]*", "([^>]*)"), 1)
    out = F.replace(F.replace(name, F.lit("\\g"), F.lit(">")), F.lit("\\b"), F.lit("\\"))
    for r, (a, _) in MARKS.items():
        out = F.when(piece.startswith(f"{a} "), r).otherwise(out)
    return out


def _content(piece: Column, role: Column) -> Column:
    """What stands between the marks, still escaped."""
    head = F.length(opening(role))
    return F.substring(piece, head + 1, F.length(piece) - head - F.length(closing(role)))


def parse_turns(text: Column) -> Column:
    """array<struct<role, text>> of a formatted text; null if the grammar doesn't allow it.

    The turns follow each other without gaps, and a text between marks holds no mark."""
    pieces = F.regexp_extract_all(text, F.lit(TURN), F.lit(0))
    turns = F.transform(pieces, lambda p: F.transform(F.array(_role_of(p)), lambda r: F.struct(r.alias("role"), _content(p, r).alias("inner")))[0])
    whole = (F.array_join(pieces, "") == text) & ~F.exists(turns, lambda t: t["inner"].rlike(MARK))
    return F.when(whole, F.transform(turns, lambda t: F.struct(t["role"].alias("role"), unescape(t["inner"]).alias("text"))))


def format_chats(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """(id, n_turns, formatted, turns, spans, n_escaped): each conversation as one text that parses back to its turns.

    turns: array<struct<role, text>>, read back from formatted. spans: for each turn the code points where it stands in formatted
    (start from 0, chars) and its text under the loss mask (loss_start, loss_chars, still escaped; null for roles that aren't
    learned). n_escaped counts the turns that had to be escaped.

    Each turn is rendered as it is and parsed; one that doesn't come back as it was is escaped. The whole text is parsed once
    more and compared to all turns: a difference is an error, so none leaves. It can't arise: a turn that parses alone ends at
    the first closing mark behind its opening one, wherever it stands. Turns are in the order of turn (null first), role and
    text; rows that repeat are turns as well. Null roles and texts are empty. Rows without an id belong to no conversation and
    are left out; an empty table gives an empty one; other columns are passed over. A conversation is one row of the result,
    so it has to fit one: it is all that is gathered, in one shuffle."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    one = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    head, tail = opening(F.col("role")), closing(F.col("role"))
    plain = F.coalesce(parse_turns(F.concat(head, "text", tail)) == F.array(F.struct("role", "text")), F.lit(False))
    one = one.withColumn("plain", plain).withColumn("inner", F.when(F.col("plain"), F.col("text")).otherwise(escape(F.col("text"))))
    one = one.withColumns({"piece": F.concat(head, "inner", tail), "before": F.length(head)})
    order = Window.partitionBy("id").orderBy("turn", "role", "text")
    start = F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("piece")
    one = one.withColumns({"k": F.row_number().over(order), "start": start})
    masked = F.col("role").isin(*learned)
    span = F.struct("start", F.length("piece").cast("long").alias("chars"), F.when(masked, F.col("start") + F.col("before")).alias("loss_start"), F.when(masked, F.length("inner").cast("long")).alias("loss_chars"))
    chats = one.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "role", "text", "piece", span.alias("span")))).alias("all"), F.count_if(~F.col("plain")).alias("n_escaped"))
    chats = chats.select("id", "all", "n_escaped", F.array_join("all.piece", "").alias("formatted"))
    turns = F.when(parse_turns(F.col("formatted")) == F.arrays_zip(F.col("all.role").alias("role"), F.col("all.text").alias("text")), parse_turns(F.col("formatted")))
    turns = F.coalesce(turns, F.raise_error(F.lit("a formatted conversation doesn't parse back")).cast("array<struct<role:string,text:string>>"))
    return chats.select(F.col("id").alias(id_col), F.size("all").cast("long").alias("n_turns"), "formatted", turns.alias("turns"), F.col("all.span").alias("spans"), "n_escaped")


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, with nothing between; each turn is cut from its own piece."""
    pieces = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))
    parts = F.zip_with(pieces, spans, lambda p, s: F.when(s["loss_chars"].isNotNull(), unescape(F.substring(p, (s["loss_start"] - s["start"] + 1).cast("int"), s["loss_chars"].cast("int")))))
    return F.array_join(parts, "")
