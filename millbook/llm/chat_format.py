"""Chat formatting: reply trees enumerated by self-joins, their branches ranked, chosen paths written out.

Messages name the message they reply to. Self-joins that double the distance
give every message its ancestor 1, 2, 4, ... replies up, with the summed score
of the messages between, until every message knows its root: as many rounds as
the longest path has bits, whatever its length. A message without replies ends a
path; a tree's paths are ranked by mean score, and only the chosen ones are
listed, from the same ancestor tables.

A chosen path becomes one conversation: per turn a header with the role, the text
and an end mark. Control strings inside roles and texts are broken by a backslash
after their first character, and backslashes are doubled, so nothing inside a text
can open or close a turn and reading back restores it exactly. The loss mask is a
list of code point ranges: the texts of the roles that are learnt.

Keys of joins are message ids; children of one message, or paths through one, may
be any share of the rows, because those joins are fed by shuffles that AQE can
split. Ranks come from a range partitioning. Only the turns of one chosen path
meet, in the row that holds its conversation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millbook.functions.paging import dense_number
from millbook.functions.prefix import running_sum
from millbook.plans.lineage import staged

_NODES = ("tree", "node", "parent", "role", "text", "score")


@dataclass(frozen=True)
class Template:
    """``### role: text</turn>`` and a line end per turn. No control string may overlap itself or start another."""

    head: str = "### "
    middle: str = ": "
    end: str = "</turn>"
    line: str = "\n"

    def _escaped(self, text: Column, controls: tuple[str, ...]) -> Column:
        out = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\"))
        for c in controls:
            out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
        return out

    def header(self, role: Column) -> Column:
        return F.concat(F.lit(self.head), self._escaped(role, (self.head, self.middle, self.end)), F.lit(self.middle))

    def body(self, text: Column) -> Column:
        return self._escaped(text, (self.head, self.end))

    def closing(self) -> Column:
        return F.lit(self.end + self.line)

    @staticmethod
    def unescaped(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def turns(self, formatted: str) -> list[tuple[str, str]]:
        """``(role, text)`` of every turn of a formatted conversation."""
        found = []
        for turn in formatted.split(self.end + self.line)[:-1]:
            role, text = turn.removeprefix(self.head).split(self.middle, 1)
            found.append((self.unescaped(role), self.unescaped(text)))
        return found


def turn_chains(rows: DataFrame, tree_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", score_col: str | None = None) -> DataFrame:
    """Conversations kept as numbered turns, as messages: each replies to the one before it.

    Turns are taken in order, nulls first, equal numbers by role and text; rows of
    a null conversation are one conversation. Every row becomes one message.
    """
    score = F.col(score_col).cast("double") if score_col else F.lit(None).cast("double")
    own = rows.select(F.col(tree_col).alias("tree"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"),
                      F.col(text_col).cast("string").alias("text"), score.alias("score"))
    numbered = dense_number(own, ["tree", "turn", "role", "text"], name="node")
    before = numbered.select((F.col("node") + 1).alias("_next"), F.col("tree").alias("_tree"))
    follows = F.col("tree").eqNullSafe(F.col("_tree")) & F.col("_next").isNotNull()
    return numbered.join(before, numbered["node"] == before["_next"], "left").select(
        "tree", "node", F.when(follows, F.col("node") - 1).alias("parent"), "role", "text", "score")


def _unique(nodes: DataFrame) -> DataFrame:
    """One row per message id; of several the greatest by score, then parent, role and text. Rows without an id go."""
    rest = [c for c in ("score", "parent", "role", "text", "tree")]
    return staged(nodes.filter("node is not null").groupBy("node").agg(F.max(F.struct(*rest)).alias("r")).select(
        "node", *[F.col(f"r.{c}").alias(c) for c in rest]), "messages")


@dataclass
class Ancestors:
    jumps: list[DataFrame]  # (node, up): the ancestor 2^k replies up, for the messages that have one
    whole: DataFrame        # (node, total, hops) of the path from the root to each message


def ancestors(nodes: DataFrame) -> Ancestors:
    """Jump tables of every message, by doubling.

    A parent that is no message counts as none. Messages whose parents form a
    ring reach no root and lie on no path.
    """
    known = nodes.select(F.col("node").alias("up"))
    state = staged(nodes.select("node", "parent", F.coalesce("score", F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("hops"))
                   .join(known, F.col("parent") == F.col("up"), "left").select("node", "up", "total", "hops"), "jumps")
    whole, jumps = state.filter("up is null"), []
    active = state.filter("up is not null")
    left = active.count()
    while left:
        jumps.append(active.select("node", "up"))
        reached = active.unionByName(whole).select(F.col("node").alias("_at"), F.col("up").alias("_up"),
                                                   F.col("total").alias("_total"), F.col("hops").alias("_hops"))
        state = staged(active.join(reached, F.col("up") == F.col("_at")).select(
            "node", F.col("_up").alias("up"), (F.col("total") + F.col("_total")).alias("total"),
            (F.col("hops") + F.col("_hops")).alias("hops")), "jumps")
        whole, active = whole.unionByName(state.filter("up is null")), state.filter("up is not null")
        now = active.count()
        if now == left:  # no message is this far from its root, so none is farther: rings are left
            break
        left = now
    return Ancestors(jumps, whole.select("node", "total", "hops"))


def chosen_paths(nodes: DataFrame, found: Ancestors, paths: int | None) -> DataFrame:
    """``path`` (its last message), ``rank``, ``score``, ``hops`` of each tree's best ``paths`` (None: all).

    A path's score is the mean of its messages' (a null counts 0); ties go to the smaller id.
    """
    replied = nodes.select(F.col("parent").alias("node"))
    leaves = nodes.select("tree", "node").join(replied, "node", "left_anti").join(found.whole, "node").select(
        "tree", F.col("node").alias("path"), (F.col("total") / F.col("hops")).alias("score"), "hops",
        (-F.col("total") / F.col("hops")).alias("_worse"), F.lit(1).cast("long").alias("_one"))
    ranked = running_sum(leaves, ["_worse", "path"], "_one", "rank", group=["tree"])
    if paths is not None:
        ranked = ranked.filter(F.col("rank") <= paths)
    return staged(ranked.select("tree", "path", "rank", "score", "hops"), "paths")


def path_messages(chosen: DataFrame, found: Ancestors) -> DataFrame:
    """``path, node, at``: every message of the chosen paths, ``at`` counting from the root (0)."""
    steps = chosen.select("path", F.col("path").alias("node"), (F.col("hops") - 1).alias("at"))
    for k in reversed(range(len(found.jumps))):
        jump = found.jumps[k].select(F.col("node").alias("_from"), F.col("up").alias("_up"))
        both = F.array(F.struct("node", "at"), F.struct(F.col("_up").alias("node"), (F.col("at") - (1 << k)).alias("at")))
        steps = steps.join(jump, F.col("node") == F.col("_from"), "left").select(
            "path", F.explode(F.filter(both, lambda s: s["node"].isNotNull())).alias("s")).select("path", "s.node", "s.at")
    return steps


def format_trees(messages: DataFrame, paths: int | None = 1, loss_roles: tuple[str, ...] = ("assistant",),
                 template: Template | None = None) -> DataFrame:
    """``tree, path, rank, score, n_turns, formatted, loss``: one row per chosen path.

    ``messages`` has ``tree, node, parent, role, text, score``; others are not
    read. Message ids are unique over all trees (of repeated ones one stays, see
    ``_unique``). ``loss`` is an array of ``start, end`` (code points of
    ``formatted``, end exclusive). A null role or text is an empty one; an empty
    table gives no rows.
    """
    template = template or Template()
    nodes = _unique(messages.select(*_NODES))
    found = ancestors(nodes)
    chosen = chosen_paths(nodes, found, paths)
    header, body = template.header(F.col("role")), template.body(F.col("text"))
    turns = path_messages(chosen, found).join(nodes.select("node", "role", "text"), "node").select(
        "path", "at", header.alias("header"), body.alias("body"),
        F.coalesce("role", F.lit("")).isin(*loss_roles).alias("learnt"))
    piece = F.concat("header", "body", template.closing())
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.select("path", "at", "learnt", piece.alias("piece"), F.length("header").alias("h"), F.length("body").alias("b"),
                          F.coalesce(F.sum(F.length(piece)).over(before), F.lit(0)).alias("start"))
    written = placed.groupBy("path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda s: s["piece"]), "").alias("formatted"),
        F.array_sort(F.collect_list(F.when(F.col("learnt"), F.struct(
            (F.col("start") + F.col("h")).alias("start"), (F.col("start") + F.col("h") + F.col("b")).alias("end"))))).alias("loss"),
        F.count(F.lit(1)).alias("n_turns"))
    return chosen.select("tree", "path", "rank", "score").join(written, "path").select(
        "tree", "path", "rank", "score", "n_turns", "formatted", "loss")


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """``formatted`` (rows of :func:`format_trees`) with ``turns`` (role, text) and ``learnt`` (texts), parsed from it."""
    template = template or Template()
    at = [formatted.columns.index(c) for c in ("formatted", "loss")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            turns, learnt = [], []
            for whole, spans in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                turns.append([{"role": r, "text": t} for r, t in template.turns(whole)])
                learnt.append([template.unescaped(whole[s["start"]:s["end"]]) for s in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(turns, kind), pa.array(learnt, pa.list_(pa.string()))],
                                             [*batch.schema.names, "turns", "learnt"])

    turn = T.StructType().add("role", T.StringType()).add("text", T.StringType())
    schema = T.StructType([*formatted.schema.fields, T.StructField("turns", T.ArrayType(turn)),
                           T.StructField("learnt", T.ArrayType(T.StringType()))])
    return formatted.mapInArrow(parse, schema)
