"""Unique keys as a batch unfolds: who holds a key when, and which requests that rejects.

One at a time, a request that sets a unique key is rejected while another row
holds that value; an accepted one frees what its row held before, a rejected one
changes nothing. So a key may pass from row to row inside a batch, and whether
it is free depends on every earlier decision.

The batch becomes a timeline of claims (key, holder, from, to): a claim starts
with a request (or is stored) and ends with the holder's next accepted request
on that key column. Requests whose values nobody else ever claims are accepted
outright. The others are decided in rounds. While requests are undecided, a
claim *possibly* holds from any request not rejected until the next accepted one, and
*surely* from an accepted one until the next one not rejected; a request is
rejected if another holder surely has one of its values, accepted if none possibly
has. The first undecided request always is one or the other, so every round
decides it at least, and as a rule all but those that depend on each other.

Who else holds a value is counted, never listed: claims start and end as +1 and -1
on the value's timeline, and prefix sums per value, less those per (value, holder),
tell at each request. Prefix sums run over range parts, so one value or one holder
may have any share of the batch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millbook.functions.paging import dense_number
from millbook.functions.prefix import range_parts, sums_over_parts
from millbook.plans.lineage import staged

_VALUE = ["kind", "value"]
_OWNER = ["kind", "holder"]


def _long(rows: DataFrame, keys: list[str], sets: list[Column], *also: str) -> DataFrame:
    """One row per key column that a row sets: ``kind`` (its number) and ``value`` (as text)."""
    each = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(k).cast("string").alias("value"), s.alias("sets"))
                     for i, (k, s) in enumerate(zip(keys, sets, strict=True))])
    return rows.select(*also, F.explode(F.filter(each, lambda x: x["sets"])).alias("x")).select(*also, "x.kind", "x.value")


def _taken(live: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (kind, value, holder, pos) with ``maybe`` and ``sure``: another holder possibly, surely has the value.

    ``live``: claims and other settings of the holders concerned, without rejected ones, in range parts of (kind,
    holder, pos); stored ones at ``pos`` 0; ``state`` is null while undecided.
    """
    one, none, request = F.lit(1), F.lit(0), F.col("pos") > 0
    accepted = F.coalesce(F.col("state"), F.lit(False))
    counted = staged(sums_over_parts(live, "_range", _OWNER, ["pos"], {
        "_acc": F.when(request & accepted, one).otherwise(none), "_liv": F.when(request, one).otherwise(none)}), "claims")

    def following(which: Column, count: str, end: str) -> DataFrame:
        return counted.filter(request & which).select(
            F.col("kind").alias("_kind"), F.col("holder").alias("_holder"), F.col(count).alias("_nth"), F.col("pos").alias(end))

    claims = counted.filter("claim")
    for which, count, end in ((accepted, "_acc", "_until"), (F.lit(True), "_liv", "_sure_until")):
        nth = following(which, count, end)
        claims = claims.join(nth, (F.col("kind") == F.col("_kind")) & (F.col("holder") == F.col("_holder"))
                             & (F.col(count) + 1 == F.col("_nth")), "left").drop("_kind", "_holder", "_nth")

    def point(pos: Column, order: int, possible: Column, sure: Column) -> Column:
        return F.struct(pos.alias("pos"), F.lit(order).alias("at"), possible.alias("p"), sure.alias("s"))

    known = F.when(accepted, one).otherwise(none)
    steps = F.array(point(F.col("pos"), 2, one, known), point(F.col("_until"), 1, -one, none),
                    point(F.when(accepted, F.col("_sure_until")), 1, none, -one))
    points = claims.select(*_VALUE, "holder", F.explode(F.filter(steps, lambda x: x["pos"].isNotNull())).alias("x")).select(
        *_VALUE, "holder", "x.pos", "x.at", "x.p", "x.s")
    # a request is asked before anything else that happens at its position
    asks = asked.select(*_VALUE, "holder", "pos", F.lit(0).alias("at"), F.lit(0).alias("p"), F.lit(0).alias("s"))
    order = ["pos", "at"]
    line = range_parts(points.unionByName(asks), [*_VALUE, *order], "_range")
    values = {"all_p": F.col("p"), "all_s": F.col("s")}
    own = {"own_p": F.col("p"), "own_s": F.col("s")}
    summed = sums_over_parts(line, "_range", _VALUE, order, values, inclusive=False)
    summed = sums_over_parts(summed, "_range", [*_VALUE, "holder"], order, own, inclusive=False)
    return summed.filter("at = 0").select("pos", "kind", (F.col("all_p") > F.col("own_p")).alias("maybe"),
                                          (F.col("all_s") > F.col("own_s")).alias("sure"))


def resolve_keys(requests: DataFrame, existing: DataFrame, keys: dict[str, str], arrival: tuple[str, ...],
                 holder: str | None = "id", sets: dict[str, Column] | None = None) -> tuple[DataFrame, int]:
    """(``requests`` plus ``reason``, rounds): what the unique ``keys`` reject, one request after the other.

    ``keys`` maps key columns to reasons, in the order of checking; ``reason`` is
    that of the first column whose value another row holds at the request's turn,
    or null. ``holder`` names the column with the row a request changes; None: each
    request is a new row. ``sets`` tells per column whether a request sets it
    (all do unless given); null values claim nothing but free what was held.
    Requests are taken by ``arrival``, equal ones by their other columns.
    """
    names, reasons = list(keys), list(keys.values())
    simple = [f.name for f in requests.schema.fields
              if f.name not in arrival and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    numbered = dense_number(requests, [*arrival, *simple], name="_pos")
    owner = F.col(holder) if holder else -F.col("_pos")
    held = numbered.withColumn("_holder", owner.cast("long"))
    own_sets = [(sets or {}).get(k, F.lit(True)) for k in names]
    events = staged(_long(held, names, own_sets, "_pos", "_holder").select(
        F.col("_pos").alias("pos"), F.col("_holder").alias("holder"), *_VALUE), "settings")
    wanted = events.filter("value is not null").select(*_VALUE).distinct()
    stored = _long(existing, names, [F.lit(True)] * len(names), "id").select(F.col("id").cast("long").alias("holder"), *_VALUE)
    stored = staged(stored.filter("value is not null").join(wanted, _VALUE, "left_semi").select(
        F.lit(0).cast("long").alias("pos"), "holder", *_VALUE), "stored-keys")
    claims = events.filter("value is not null").unionByName(stored)
    contested = staged(claims.groupBy(*_VALUE).agg(F.min("holder").alias("a"), F.max("holder").alias("b"))
                       .filter("a <> b").select(*_VALUE), "contested")
    if contested.isEmpty():
        return numbered.withColumn("reason", F.lit(None).cast("string")).drop("_pos"), 0
    mine = staged(claims.join(contested, _VALUE, "left_semi"), "contested-claims")
    owners = mine.select(*_OWNER).distinct()
    open_requests = mine.filter("pos > 0").select(F.col("pos").alias("_open")).distinct()
    concerned = events.unionByName(stored).join(owners, _OWNER, "left_semi")
    disputed = contested.select(F.col("kind").alias("_k"), F.col("value").alias("_v"))
    live = concerned.join(disputed, (F.col("kind") == F.col("_k")) & (F.col("value") == F.col("_v")), "left").join(
        open_requests, F.col("pos") == F.col("_open"), "left").select(
        "pos", "holder", *_VALUE, F.col("_k").isNotNull().alias("claim"), F.when(F.col("_open").isNull(), True).alias("state"))
    live = range_parts(live, [*_OWNER, "pos"], "_range")
    rounds, outcomes = 0, []
    while True:
        left = live.filter(F.col("state").isNull() & F.col("claim")).select("pos", "holder", *_VALUE)
        if left.isEmpty():
            break
        rounds += 1
        first = [F.min(F.when(F.col(c), F.col("kind"))).alias(c) for c in ("sure", "maybe")]
        told = staged(_taken(live, left).groupBy(F.col("pos").alias("_told")).agg(*first)
                      .filter(F.col("maybe").isNull() | (F.col("sure") == F.col("maybe")))
                      .select("_told", F.col("sure").alias("_kind"), F.col("sure").isNull().alias("_yes")), "told")
        outcomes.append(told)
        live = staged(live.join(told, F.col("pos") == F.col("_told"), "left").withColumn("state", F.coalesce("state", "_yes"))
                      .filter(F.col("state").isNull() | F.col("state")).drop("_told", "_kind", "_yes"), "claims")
    first = reduce(DataFrame.unionByName, outcomes).select(F.col("_told").alias("_at"), "_kind").filter("_kind is not null")
    reason = F.element_at(F.array(*map(F.lit, reasons)), F.col("_kind") + 1)
    return numbered.join(first, F.col("_pos") == F.col("_at"), "left").select(
        *requests.columns, F.when(F.col("_kind").isNotNull(), reason).alias("reason")), rounds
