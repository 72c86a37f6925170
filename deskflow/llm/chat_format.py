"""Chat formatting with SQL functions only: a template, a state machine over roles, loss flags.

A conversation becomes text segments, each with a flag that says whether the loss counts
there.  A turn is a head with its role, the escaped text, and a tail; heads and tails have no
loss, texts have it if the template says so for their role.

Escaping keeps control strings out of texts and can be undone: a backslash is doubled, and a
backslash breaks each mark after its first letter.  Marks follow from the template: the
longest start of the tail (of the head) that does not begin as it ends, so that breaking its
occurrences from left to right leaves none, also across the end of a text; a head of one
letter repeated n times has a mark of n - 1.  Thus no text holds a tail or a head, and undoing
means dropping the first of each pair.  With the built-in template the marks are "</turn>" and
"##".  A template whose tail could be met elsewhere than at the end of a turn is refused.

The state machine reads the roles in turn order: an optional system turn, then pairs of user
and assistant.  Every conversation is formatted; `valid` says whether it was accepted.  The
machine runs over chunks of CHUNK turns as a map from each state to the one after the chunk,
so long conversations are put together from parts that many tasks have made.

Turns of one conversation are ordered by turn, role, text; a null turn comes last, a null
text or role is empty, a null conversation id is a conversation.  Unknown roles are written
as they are after an equals sign, with the first letter of the colon escaped.  An empty table
gives an empty result.  Only the four columns named are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 64


def _unbordered(text: str) -> str:
    """The longest start of at least two letters that does not begin as it ends; else empty."""
    for size in range(len(text), 1, -1):
        if not any(text.startswith(text[k:size]) for k in range(1, size)):
            return text[:size]
    return ""


def _meets(left: str, right: str) -> bool:
    """Whether `right` lies in `left` or may begin at its end."""
    return right in left or any(left.endswith(right[:k]) for k in range(1, len(right)))


@dataclass(frozen=True)
class Template:
    """titles: how known roles are written; steps: (state, role) -> state; others lead to -1.

    The head may be empty.  Control strings hold no backslash, titles neither that nor the
    first letter of the colon.
    """

    head: str = "### "
    colon: str = ": "
    tail: str = "</turn>\n"
    titles: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: tuple[str, ...] = ("assistant",)
    steps: dict[tuple[int, str], int] = field(default_factory=lambda: {
        (0, "system"): 1, (0, "user"): 2, (1, "user"): 2, (2, "assistant"): 3, (3, "user"): 2,
    })
    accepted: tuple[int, ...] = (3,)

    def __post_init__(self) -> None:
        titles, mark = list(self.titles.values()), self.tail_mark
        if any("\\" in part for part in (self.head, self.colon, self.tail, *titles)):
            raise ValueError("head, colon, tail and titles hold no backslash")
        if not self.colon or len(self.head) == 1 or not mark:
            raise ValueError("a colon is needed, a head of none or several letters, and a tail of different letters")
        if len({*titles}) < len(titles) or any(t.startswith("=") or self.colon[0] in t for t in titles):
            raise ValueError("titles differ, do not start with an equals sign and hold no colon")
        starts = [self.head + "=", *(self.head + t + self.colon for t in titles), self.colon]
        ends = [mark[k:] for k in range(1, len(mark))]
        if any(_meets(s, mark) for s in starts) or any(e.startswith(self.colon) or self.colon.startswith(e) for e in ends):
            raise ValueError("the tail could begin within a head")

    @property
    def tail_mark(self) -> str:
        return _unbordered(self.tail.rstrip()) or _unbordered(self.tail)

    @property
    def head_mark(self) -> str:
        head = self.head.strip() or self.head
        return _unbordered(head) or head[:-1]

    @property
    def marks(self) -> list[str]:
        """What is broken in texts; a mark of one letter comes first, as it also breaks those that start with it."""
        return sorted({self.tail_mark, self.head_mark} - {""}, key=lambda m: (len(m) > 1, m))


CHAT = Template()


def _broken(text: Column, marks: list[str]) -> Column:
    for mark in marks:
        text = F.replace(text, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return text


def _doubled(text: Column) -> Column:
    return F.replace(text, F.lit("\\"), F.lit("\\\\"))


def escaped(text: Column, template: Template = CHAT) -> Column:
    return _broken(_doubled(text), template.marks)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.?)", "$1")


def _title(role: Column, template: Template) -> Column:
    first = template.colon[0]
    plain = F.replace(_doubled(role), F.lit(first), F.lit("\\" + first))
    out = F.concat(F.lit("="), _broken(plain, [m for m in template.marks if len(m) > 1]))
    for name, title in template.titles.items():
        out = F.when(role == name, F.lit(title)).otherwise(out)
    return out


def _role(title: Column, template: Template) -> Column:
    out = unescaped(F.substr(title, F.lit(2)))
    for name, written in template.titles.items():
        out = F.when(title == written, F.lit(name)).otherwise(out)
    return out


def _states(template: Template) -> list[int]:
    return sorted({0, *template.steps.values(), *(s for s, _ in template.steps)})


def _step(state: Column, role: Column, template: Template) -> Column:
    out = F.lit(-1)
    for (before, name), after in template.steps.items():
        out = F.when((state == before) & (role == name), F.lit(after)).otherwise(out)
    return out


def _segments(turn: Column, template: Template) -> Column:
    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    no = F.lit(False)
    return F.array(
        segment(F.concat(F.lit(template.head), _title(turn.role, template), F.lit(template.colon)), no),
        segment(escaped(turn.text, template), turn.role.isin(*template.loss)),
        segment(F.lit(template.tail), no),
    )


def format_conversations(df: DataFrame, template: Template = CHAT) -> DataFrame:
    """Per conversation: conv_id, segments (text, loss), formatted (their texts), valid.  df: conv_id, turn, role, text."""
    last = F.lit(2**63 - 1)
    turns = df.select(
        "conv_id", F.coalesce(F.col("turn").cast("long"), last).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    states = _states(template)
    chunks = turns.groupBy("conv_id", F.floor(F.col("turn") / CHUNK).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    chunks = chunks.select(
        "conv_id", "chunk", F.flatten(F.transform("turns", lambda t: _segments(t, template))).alias("segments"),
        F.aggregate("turns", F.array(*map(F.lit, states)), lambda acc, t: F.transform(acc, lambda s: _step(s, t.role, template))).alias("after"),
    )
    whole = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "segments", "after"))).alias("chunks"))

    def follow(state: Column, chunk: Column) -> Column:
        out = F.lit(-1)
        for k, s in enumerate(states):
            out = F.when(state == s, chunk.after[k]).otherwise(out)
        return out

    end = F.aggregate("chunks", F.lit(0), follow)
    whole = whole.select("conv_id", F.flatten(F.col("chunks.segments")).alias("segments"), end.isin(*template.accepted).alias("valid"))
    return whole.select("conv_id", "segments", F.array_join(F.col("segments.text"), "").alias("formatted"), "valid")


def read_turns(formatted: Column, template: Template = CHAT) -> Column:
    """The turns (role, text) of a formatted conversation."""
    def literal(text: str) -> str:
        return rf"\Q{text}\E" if text else ""

    parts = F.split(formatted, literal(template.tail))
    parts = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    other = rf"[^\x{{{ord(template.colon[0]):x}}}\\]"
    heading = rf"(?s)^{literal(template.head)}((?:{other}|\\.)*+){literal(template.colon)}"

    def turn(part: Column) -> Column:
        title = F.regexp_extract(part, heading, 1)
        body = F.substr(part, F.char_length(title) + len(template.head) + len(template.colon) + 1)
        return F.struct(_role(title, template).alias("role"), unescaped(body).alias("text"))

    return F.transform(parts, turn)


def spoken_text(turns: Column, template: Template = CHAT) -> Column:
    """The texts of those turns (as read_turns gives them) whose roles have a loss, in order."""
    said = F.filter(turns, lambda t: t.role.isin(*template.loss))
    return F.array_join(F.transform(said, lambda t: t.text), "")


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescaped(s.text)), "")
