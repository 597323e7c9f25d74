"""Chat formatting by a finite-state machine over roles, in SQL expressions only.

A declarative template gives each role its opening and closing marks and whether
its text is trained on. Texts are escaped so that no control string of the
template can occur in them; ``read_back`` undoes it exactly. The state machine
checks the turn order: an optional system turn first, then user and assistant in
turn, ending with the assistant.

Scale: turns are first joined inside blocks of BLOCK_TURNS turns per conversation,
so a long conversation is not sorted or gathered row by row in one task.

Defined results: null text is empty; a null or unknown role is written with its
own name (null: empty) under the default marks, line ends in it escaped, makes the conversation invalid and
is not trained on; rows with equal turns are ordered by role, then text, nulls first;
repeated rows stay; a null conv_id is one conversation; a null turn comes first;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.llm.native import let

BLOCK_TURNS = 256


@dataclass(frozen=True)
class ChatTemplate:
    """Marks of a turn. ``{role}`` in ``opening`` is the escaped role."""

    opening: str = "<|start|>{role}\n"
    closing: str = "<|end|>\n"
    trained: tuple[str, ...] = ("assistant",)
    control: tuple[str, ...] = ("<|start|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    #: state -> role -> next state
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: tuple[str, ...] = ("answered",)


LEAD = {"<": "&lt;", "[": "&lb;"}
LINE_END = "&nl;"  # in roles, whose opening mark ends with the line


def escape(text: Column, template: ChatTemplate) -> Column:
    """Replace ``&``, then the first character of every control string."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for c in template.control:
        out = F.replace(out, F.lit(c), F.lit(LEAD[c[0]] + c[1:]))
    return out


def unescape(text: Column) -> Column:
    for char, code in (LEAD | {"\n": LINE_END}).items():
        text = F.replace(text, F.lit(code), F.lit(char))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def _valid(roles: Column, template: ChatTemplate) -> Column:
    """Run the state machine over an array of roles."""
    table = F.create_map(
        *[F.lit(x) for state, row in template.moves.items() for role, to in row.items() for x in (f"{state}\n{role}", to)]
    )
    step = lambda state, role: F.coalesce(F.try_element_at(table, F.concat(state, F.lit("\n"), role)), F.lit("failed"))
    return F.aggregate(roles, F.lit("start"), step).isin(*template.final)


def format_chats(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:  # noqa: B008
    """One row per conversation: conv_id, n_turns, valid, formatted, segments.

    ``segments`` is an array of (text, loss) pieces whose texts joined are ``formatted``.
    """
    opening, close = template.opening.split("{role}")
    role = F.coalesce(F.col("role"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    head = F.concat(F.lit(opening), F.replace(escape(role, template), F.lit("\n"), F.lit(LINE_END)), F.lit(close))
    rows = turns.select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-1)).alias("block"),
        F.struct(
            F.col("turn"), F.col("role"), F.col("text").alias("key"), head.alias("head"), escape(text, template).alias("body"),
            F.coalesce(role.isin(*template.trained), F.lit(False)).alias("loss"),
        ).alias("row"),
    )
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    pieces = F.flatten(
        F.transform(
            "rows",
            lambda r: F.array(
                F.struct(r["head"].alias("text"), F.lit(False).alias("loss")),
                F.struct(r["body"].alias("text"), r["loss"].alias("loss")),
                F.struct(F.lit(template.closing).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    part = F.struct("block", F.transform("rows", lambda r: F.coalesce(r["role"], F.lit(""))).alias("roles"), pieces.alias("pieces"))
    whole = blocks.select("conv_id", part.alias("part")).groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    whole = whole.select(
        "conv_id",
        F.flatten(F.transform("parts", lambda p: p["roles"])).alias("roles"),
        F.flatten(F.transform("parts", lambda p: p["pieces"])).alias("segments"),
    )
    return whole.select(
        "conv_id",
        F.size("roles").cast("long").alias("n_turns"),
        _valid(F.col("roles"), template).alias("valid"),
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
    )


def read_back(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:  # noqa: B008
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    opening, close = template.opening.split("{role}")
    quoted = "".join("\\" + c if c in "\\^$.|?*+()[]{}" else c for c in opening)
    turns = F.slice(F.split(formatted, quoted, -1), 2, F.greatest(F.size(F.split(formatted, quoted, -1)) - 1, F.lit(0)))

    def parse(piece: Column) -> Column:
        cut = F.instr(piece, close)
        body = F.substr(piece, cut + len(close), F.length(piece) - cut - len(close) + 1 - len(template.closing))
        return F.struct(unescape(F.substr(piece, F.lit(1), cut - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(turns, parse)


def chat_digests(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:  # noqa: B008
    """Digests of what is read back from the formatted output: the turns from its text, the trained text from the loss mask."""
    turns = let(read_back(F.col("formatted"), template), lambda t: F.struct(t.alias("turns")))
    step = formatted.select("conv_id", "valid", "formatted", "segments", turns["turns"].alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.filter("segments", lambda s: s["loss"])
    loss = F.array_join(F.transform(trained, lambda s: unescape(s["text"])), "")
    step = step.select("*", text.alias("all_text"), loss.alias("loss_text"))
    return step.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2("all_text", 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
