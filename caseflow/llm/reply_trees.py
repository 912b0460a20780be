"""Reply trees to training conversations.

Messages name the message they reply to.  Self-joins that double their reach
give every message its root, depth and path score: round k joins a message's
2^k-th ancestor with that one's own, so a path of n messages takes log2(n)
rounds, and messages that have met their root drop out.  Every message without
a reply ends one path; a tree's paths rank by score (the sum over their
messages), then depth, then the last message.  The chosen paths are spelled out
by the same doubled links, walked from the widest to the narrowest: each step
doubles the messages listed, every ancestor is reached once.

A path becomes one string by a :class:`Template`, whose marks surround each
turn.  Strings inside texts that could be taken for a mark get a backslash after
their first character (one more if they have some), which reading takes away.
``turns`` gives each turn's place in the string and the characters its loss mask
covers; reading back cuts turns by the marks and checks them against it.

Only DataFrame functions run on the executors.  Messages are joined by (tree,
message), so a large tree is spread; only the string of one path is put together
in one place, by appending once.

Defined cases: rows of one tree and message id are one message (the smallest by
parent, role and text counts); null is a tree like any other, a null id one that
no reply can name.  A message whose parent is null, itself or not there is a
root.  In a circle of replies the smallest message is taken as the root.  Null
texts and roles are empty, null scores 0.  An empty table gives an empty result.
Columns not named are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.ranges import number_rows
from caseflow.llm import common as C


@dataclass(frozen=True)
class Template:
    """Marks before and after a turn, by role; other roles are named in theirs."""

    marks: dict = field(default_factory=lambda: {
        "system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>")})
    other: tuple = ("<|", "|>\n", "<|end|>\n")   # before and after the role's name, after the text
    learned: tuple = ("assistant",)
    reserved: tuple = ("<s>",)                   # further strings that texts must not hold

    def __post_init__(self):
        opens = [o for o, _ in self.marks.values()] + [self.other[0]]
        if any(a != b and a.startswith(b) for a in opens for b in opens) or len(set(opens)) < len(opens) or "" in opens:
            raise ValueError("no mark before a turn may begin another one")
        if not all(c.strip() for _, c in [*self.marks.values(), self.other[:2], self.other[1:]]):
            raise ValueError("the mark after a turn must not be blank")

    def _control(self, slashes: str) -> str:
        """Pattern of the strings to escape: a first character, backslashes, and what follows in a mark.

        A mark counts from the last of its characters that begins some mark, so no two overlap.
        """
        strings = [m.strip() for pair in self.marks.values() for m in pair] + [self.other[0], self.other[2].strip()]
        strings = [x for x in [*strings, *self.reserved] if x]
        firsts = "".join(sorted({x[0] for x in strings}))
        rests = {x[max(x.rfind(f) for f in firsts) + 1:] for x in strings}
        rest = "|".join(re.escape(x) for x in sorted(rests, key=lambda x: (-len(x), x)))
        return f"([{re.escape(firsts)}]){slashes}({rest})"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self._control(r"(\\*)")), F.lit(r"$1$2\\$3"))

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self._control(r"\\(\\*)")), F.lit("$1$2$3"))

    def format(self, role: Column, text: Column) -> tuple[Column, Column, Column]:
        """The turn, and the lengths of the marks before and after its text."""
        name = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C"))
        before = F.concat(F.lit(self.other[0]), name, F.lit(self.other[1]))
        after = F.lit(self.other[2])
        for r, (o, c) in self.marks.items():
            before, after = F.when(role == r, F.lit(o)).otherwise(before), F.when(role == r, F.lit(c)).otherwise(after)
        return F.concat(before, self.escape(text), after), F.length(before), F.length(after)

    def turn_pattern(self) -> str:
        known = [f"{re.escape(o)}.*?{re.escape(c)}" for o, c in self.marks.values()]
        a, b, c = map(re.escape, self.other)
        return "(?s)" + "|".join([*known, f"{a}[^|]*{b}.*?{c}"])

    def parse(self, turn: Column) -> tuple[Column, Column]:
        """Role and unescaped text of a formatted turn."""
        a, b, c = map(re.escape, self.other)
        name = F.regexp_extract(turn, f"^{a}([^|]*){b}", 1)
        role = F.replace(F.replace(name, F.lit("%7C"), F.lit("|")), F.lit("%25"), F.lit("%"))
        before = F.length(name) + len(self.other[0]) + len(self.other[1])
        after = F.lit(len(self.other[2]))
        for r, (o, e) in self.marks.items():
            mine = F.startswith(turn, F.lit(o))
            role = F.when(mine, F.lit(r)).otherwise(role)
            before, after = F.when(mine, len(o)).otherwise(before), F.when(mine, len(e)).otherwise(after)
        return role, self.unescape(F.substr(turn, before + 1, F.length(turn) - before - after))


# ---------------------------------------------------------------- paths

def _links(messages: DataFrame) -> DataFrame:
    """``key, up``: every message and the one it replies to, null for roots."""
    parents = messages.where("id is not null").select(F.col("tree").alias("_t"), F.col("id").alias("_i"), F.col("key").alias("up"))
    found = messages.join(parents, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("parent") == F.col("_i")), "left")
    return found.select("key", "id", "score", F.when(F.col("up") != F.col("key"), F.col("up")).alias("up"))


def _circle_starts(links: DataFrame, on_circle: DataFrame, scratch: C.Scratch) -> DataFrame:
    """``key`` of the smallest message of every circle."""
    at = links.join(on_circle, "key").select("key", "id", "up", F.col("id").alias("low"))
    n, reach, k = on_circle.count(), 1, 0
    while reach <= n:
        at = scratch.write(at, f"circle{k}")
        far = at.select(F.col("key").alias("up"), F.col("up").alias("_up"), F.col("low").alias("_low"))
        at = at.join(far, "up").select("key", "id", F.col("_up").alias("up"), F.least("low", "_low").alias("low"))
        reach, k = reach * 2, k + 1
    return at.where("low = id").select("key")


def _doubled(links: DataFrame, scratch: C.Scratch, tag: str) -> tuple[DataFrame | None, list[DataFrame], DataFrame | None]:
    """``key, depth, score`` of paths from the root, and the links 1, 2, 4… messages up.

    If there are circles, the first is None and the third one holds the messages on them.
    """
    n = links.count()
    open_ = scratch.write(links.select("key", "up", F.lit(1).cast("bigint").alias("depth"), "score"), f"{tag}0")
    done, jumps = [open_.where("up is null").drop("up")], []
    open_ = open_.where("up is not null")
    while not open_.isEmpty():
        jumps.append(open_.select("key", "up"))
        if 2 ** len(jumps) > 2 * n:
            return None, [], open_.select(F.col("up").alias("key")).distinct()
        far = open_
        for d in done:
            far = far.unionByName(d, allowMissingColumns=True)
        far = far.select(F.col("key").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.col("score").alias("_s"))
        step = scratch.write(open_.join(far, "up").select(
            "key", F.col("_up").alias("up"), (F.col("depth") + F.col("_d")).alias("depth"),
            (F.col("score") + F.col("_s")).alias("score")), f"{tag}{len(jumps)}")
        done.append(step.where("up is null").drop("up"))
        open_ = step.where("up is not null")
    reached = done[0]
    for d in done[1:]:
        reached = reached.unionByName(d)
    return reached, jumps, None


def chosen_paths(messages: DataFrame, scratch: C.Scratch, best: int | None) -> tuple[DataFrame, DataFrame]:
    """The chosen paths ``leaf, tree, id, rank, score, n_turns``, and their messages ``leaf, key, back``.

    ``messages``: ``key, tree, id, parent, score``; ``back`` counts from the leaf, 0 first.
    """
    links = scratch.write(_links(messages), "links")
    reached, jumps, on_circle = _doubled(links, scratch, "up")
    if on_circle is not None:
        starts = scratch.write(_circle_starts(links, on_circle, scratch), "starts")
        cut = links.join(starts.withColumn("_cut", F.lit(True)), "key", "left")
        links = scratch.write(cut.select("key", "id", "score", F.when(F.col("_cut").isNull(), F.col("up")).alias("up")), "open")
        reached, jumps, _ = _doubled(links, scratch, "again")
    leaves = reached.join(links.where("up is not null").select(F.col("up").alias("key")).distinct(), "key", "left_anti") \
        .join(messages.select("key", "tree", "id"), "key")
    order = Window.partitionBy("tree").orderBy(F.col("score").desc(), F.col("depth").desc(), F.col("id").asc_nulls_last())
    leaves = leaves.withColumn("rank", F.row_number().over(order).cast("bigint"))
    if best is not None:
        leaves = leaves.where(F.col("rank") <= best)
    leaves = scratch.write(leaves.select(F.col("key").alias("leaf"), "tree", "id", "rank", "score", F.col("depth").alias("n_turns")), "leaves")
    listed = leaves.select("leaf", F.col("leaf").alias("key"), F.lit(0).cast("bigint").alias("back"))
    for k in reversed(range(len(jumps))):
        above = listed.join(jumps[k], "key").select("leaf", F.col("up").alias("key"), (F.col("back") + 2 ** k).alias("back"))
        listed = scratch.write(listed.unionByName(above), f"listed{k}")
        scratch.drop(f"listed{k + 1}")
    return leaves, listed


def conversations(messages: DataFrame, template: Template = Template(), best: int | None = 1, tree: str = "tree",
                  message: str = "id", parent: str = "parent", role: str = "role", text: str = "text",
                  score: str | None = None) -> DataFrame:
    """The best paths of every tree (all with ``best=None``) as formatted conversations.

    ``tree, leaf`` (id of the last message), ``rank, score, n_turns, formatted``
    and ``turns``, an array of ``start, end, loss_start, loss_end``: code points
    of ``formatted``, ends exclusive, loss places null where nothing is learned.
    """
    scratch = C.Scratch(messages.sparkSession, "replies")
    points = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    rows = messages.select(F.col(tree).alias("tree"), F.col(message).alias("id"), F.struct(
        F.col(parent).alias("parent"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"), points.alias("score")).alias("m"))
    one = rows.groupBy("tree", "id").agg(F.min("m").alias("m")).select(
        F.monotonically_increasing_id().alias("key"), "tree", "id", "m.*")
    one = scratch.write(one, "messages")
    leaves, listed = chosen_paths(one.drop("role", "text"), scratch, best)
    turn, before, after = template.format(F.col("role"), F.col("text"))
    spoken = listed.join(one.select("key", "role", "text"), "key").select(
        "leaf", "back", turn.alias("turn"), F.col("role").isin(*template.learned).alias("learned"),
        before.alias("before"), after.alias("after"))
    along = Window.partitionBy("leaf").orderBy(F.col("back").desc())
    end = F.sum(F.length("turn")).over(along)
    placed = spoken.withColumn("end", end).withColumn("start", F.col("end") - F.length("turn"))
    placed = placed.select("leaf", (-F.col("back")).alias("at"), "turn", F.struct(
        "start", "end", F.when(F.col("learned"), F.col("start") + F.col("before")).alias("loss_start"),
        F.when(F.col("learned"), F.col("end") - F.col("after")).alias("loss_end")).alias("place"))
    whole = placed.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("at", "turn", "place"))).alias("t")).select(
        "leaf", F.array_join("t.turn", "").alias("formatted"), F.col("t.place").alias("turns"))
    return whole.join(leaves, "leaf").select("tree", F.col("id").alias("leaf"), "rank", "score", "n_turns", "formatted", "turns")


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """``formatted`` with ``messages``: an array of ``role, text, learned``, the last the text under the loss mask.

    Cut from the string by the marks alone; a turn whose length differs from its
    place, or whose number does, is an error.
    """
    found = F.arrays_zip(F.regexp_extract_all("formatted", F.lit(template.turn_pattern()), F.lit(0)).alias("turn"),
                         F.col("turns").alias("place"))

    def message(x):
        role, text = template.parse(x["turn"])
        place = x["place"]
        covered = F.substr(x["turn"], (place["loss_start"] - place["start"] + 1).cast("int"),
                           (place["loss_end"] - place["loss_start"]).cast("int"))
        fits = F.length(x["turn"]).eqNullSafe((place["end"] - place["start"]).cast("int"))
        role = F.when(fits, role).otherwise(F.raise_error(F.lit("a turn does not fit its place")))
        return F.struct(role.alias("role"), text.alias("text"), template.unescape(covered).alias("learned"))

    return formatted.withColumn("messages", F.transform(found, message))


def chains(rows: DataFrame, group: str, order: list[Column], path: str, number: str = "id", parent: str = "parent") -> DataFrame:
    """``rows`` with a number and the one before it, so that each group is a tree of a single path.

    Numbers run through all groups; the number before a group's first row belongs
    to another group, which makes that row a root.  Ordered rows lie below ``path``.
    """
    ranked = number_rows(rows, [F.col(group).asc_nulls_last(), *order], path, number)
    return ranked.withColumn(parent, F.col(number) - 1)
