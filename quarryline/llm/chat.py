"""Linking of tool calls with their results, in DataFrame functions only.

Calls and results meet in a hash join on conversation and identifier. A call may name calls that it depends on; its rank is
its turn, raised above the ranks of what it depends on. A log in order needs no round for this, others a few, by the logarithm
of their longest conversation. Arguments are parsed and checked against the parameters of the named function, and each call
becomes one line of canonical JSON: keys sorted at every depth, no white space, null where something is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import small_enough, stored

#: JSON types and how the types of parsed values begin.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL|DOUBLE|FLOAT", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY", "null": "VOID"}

KEYS = ["conv_id", "call_id"]
#: The rank of what depends on itself, until it becomes null.
CIRCLE = 1 << 62


def jumped(paths: DataFrame) -> DataFrame:
    """``paths`` (conv_id, call_id, ptr, gap, rank) with pointers four times as far: a call's rank is ``rank`` or, if more,
    that of ``ptr`` plus ``gap``. Calls at a path's end have no pointer and stay as they are."""
    ends = paths.filter("ptr is null")
    far = paths.filter("ptr is not null")
    for _ in range(3):
        step = paths.select("conv_id", F.col("call_id").alias("ptr"), F.col("ptr").alias("next"), F.col("gap").alias("more"), F.col("rank").alias("there"))
        far = far.join(step, ["conv_id", "ptr"], "left").select(
            *KEYS, F.col("next").alias("ptr"), F.when(F.col("next").isNull(), F.col("gap")).otherwise(F.col("gap") + F.col("more")).alias("gap"), F.greatest("rank", F.col("there") + F.col("gap")).alias("rank")
        )
    return far.unionByName(ends)


def ranked(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, rank): rank is the turn, or more: above the ranks of all calls depended on; null where calls depend
    on each other, and where they depend on such calls.

    ``calls`` has conv_id, call_id, turn and depends_on, a row for each identifier. Unknown and null identifiers there are no
    dependencies, and calls without a conversation or an identifier have none. Only what lies behind a dependency on a later
    turn is ordered anew. Of the dependencies of a call one is followed, that with the greatest rank so far; paths along these
    are followed in steps of growing length, so a chain of n calls takes log(n) rounds, and a path that doesn't end within as
    many calls as a conversation has runs in circles. This is done again while a dependency has too great a rank.
    """
    own = calls.select(*KEYS, F.coalesce("turn", F.lit(0)).cast("long").alias("turn"))
    edges = calls.select(*KEYS, F.explode("depends_on").alias("on")).filter("on is not null and call_id is not null").distinct()
    targets = own.select("conv_id", F.col("call_id").alias("on"), F.col("turn").alias("on_turn"))
    edges = stored(edges.join(own, KEYS).join(targets, ["conv_id", "on"]), "depends")
    since = stored(edges.filter("on_turn >= turn").groupBy("conv_id").agg(F.min("turn").alias("since")), "late")
    if since.isEmpty():
        return own.withColumnRenamed("turn", "rank")
    edges = stored(edges.join(since, "conv_id").filter("turn >= since"), "depends")
    under = edges.filter("on_turn < since").groupBy(*KEYS).agg(F.max("on_turn").alias("under"))
    left = own.filter("call_id is not null").join(since, "conv_id").filter("turn >= since").join(under, KEYS, "left")
    ranks = stored(left.select(*KEYS, F.greatest("turn", F.col("under") + 1).alias("rank")), "ranks")
    edges = edges.filter("on_turn >= since").select(*KEYS, "on")
    most = ranks.groupBy("conv_id").count().agg(F.max("count")).first()[0]
    while True:
        meets = edges.join(ranks.select("conv_id", F.col("call_id").alias("on"), F.col("rank").alias("on_rank")), ["conv_id", "on"])
        # A greater struct has the greater rank.
        followed = meets.groupBy(*KEYS).agg(F.max(F.struct("on_rank", "on")).alias("most"))
        paths = stored(ranks.join(followed, KEYS, "left").select(*KEYS, F.col("most.on").alias("ptr"), F.lit(1).cast("long").alias("gap"), "rank", F.col("most.on_rank").alias("on_rank")), "paths")
        if paths.filter(f"on_rank >= rank and rank < {CIRCLE}").isEmpty():
            break
        paths, length = paths.drop("on_rank"), 1
        while length <= most:
            paths, length = stored(jumped(paths), "paths"), 4 * length
            if paths.filter("ptr is not null").isEmpty():
                break
        ranks = paths.select(*KEYS, F.when(F.col("ptr").isNotNull(), F.lit(CIRCLE)).otherwise(F.least("rank", F.lit(CIRCLE))).alias("rank"))
    new = ranks.select(*KEYS, F.when(F.col("rank") < CIRCLE, F.col("rank")).alias("new"), F.lit(True).alias("moved"))
    return own.join(new, KEYS, "left").select(*KEYS, F.when(F.col("moved"), F.col("new")).otherwise(F.col("turn")).alias("rank"))


def firsts(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of the rows of each identifier the least by ``columns``, and all others, each as often as it occurs."""
    counted = stored(rows.groupBy(*KEYS, *columns).agg(F.count("*").alias("n")), "counted")
    least = counted.groupBy(*KEYS).agg(F.min(F.struct(*columns)).alias("first"), F.sum("n").alias("all"))
    several = stored(least.filter(F.col("all") > 1).select(*(F.col(k).alias(f"__{k}") for k in KEYS), "first"), "several")
    if small_enough(several.count(), 1 << 10):
        several = F.broadcast(several)
    same = F.lit(True)
    for k in KEYS:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    rest = counted.join(several, same).withColumn("more", F.col("n") - F.when(F.struct(*columns).eqNullSafe(F.col("first")), 1).otherwise(0))
    rest = rest.filter("more > 0").select(*KEYS, *columns, F.explode(F.sequence(F.lit(1), F.col("more"))).alias("nth")).drop("nth")
    return least.select(*KEYS, *(F.col(f"first.{c}").alias(c) for c in columns)), rest


def problems(parameters: str, arguments: str) -> Column:
    """What is wrong with the column of parsed ``arguments`` under the array of (name, type, required) ``parameters``."""
    given = F.expr(f"try_variant_get({arguments}, '$', 'map<string,variant>')")

    def kind(name: Column) -> Column:
        return F.call_function("schema_of_variant", given[name])

    def wrong(p: Column) -> Column:
        fits = F.lit(False)
        for name, pattern in TYPES.items():
            fits = fits | ((p["type"] == name) & kind(p["name"]).rlike(f"^({pattern})"))
        there = F.map_contains_key(given, p["name"])
        return F.when(there, F.when(~(fits | (p["type"] == "any")), F.concat(F.lit("type:"), p["name"]))).when(p["required"], F.concat(F.lit("missing:"), p["name"]))

    known = F.transform(parameters, lambda p: p["name"])
    extra = F.transform(F.array_except(F.map_keys(given), known), lambda k: F.concat(F.lit("unknown:"), k))
    found = F.concat(F.filter(F.transform(parameters, wrong), lambda x: x.isNotNull()), extra)
    return F.when(F.col(parameters).isNull(), F.array(F.lit("function"))).when(given.isNull(), F.array(F.lit("json"))).otherwise(F.array_sort(found))


def link_calls(calls: DataFrame, results: DataFrame, functions: DataFrame) -> DataFrame:
    """One row for each call, and one for each result without a call.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), depends_on (array). ``results``: conv_id, turn, call_id,
    content. ``functions``: name, parameters (array of name, type, required); of rows with the same name the least counts.
    Of several calls, or results, with the same identifier the one of the least turn counts, then of the least text; each of
    the others is a row of its own, with the status duplicate. Calls and results without an identifier are those of one identifier, which nothing depends on. Result: conv_id, call_id,
    call_turn, result_turn, rank, status (ok, invalid, unanswered, orphan, circular, duplicate), problems, record. Very long
    arguments and contents are parsed and written whole, in their rows. Other columns are not read. Without calls every result
    is an orphan, without results every call is unanswered, and without both there are no rows.
    """
    keys = KEYS
    calls = calls.select(*keys, "turn", "name", "arguments", F.array_sort(F.coalesce("depends_on", F.array().cast("array<string>"))).alias("depends_on"))
    calls, more_calls = firsts(calls, ["turn", "name", "arguments", "depends_on"])
    calls = stored(calls, "calls")
    answers, more_answers = firsts(results, ["turn", "content"])
    answers = answers.withColumnRenamed("turn", "result_turn")
    ranks = ranked(calls)
    known = functions.groupBy("name").agg(F.min("parameters").alias("parameters"))
    known = stored(known.withColumnsRenamed({"name": "function"}), "functions")
    if small_enough(known.count(), 1 << 12):
        known = F.broadcast(known)
    asked = calls.alias("c").join(ranks.alias("k"), (F.col("c.conv_id").eqNullSafe(F.col("k.conv_id"))) & F.col("c.call_id").eqNullSafe(F.col("k.call_id"))).select("c.*", "rank")
    asked = asked.join(known, F.col("name") == F.col("function"), "left").withColumn("parsed", F.try_parse_json("arguments"))
    asked = asked.select(*keys, F.col("turn").alias("call_turn"), "name", "rank", "parsed", problems("parameters", "parsed").alias("problems"), F.lit(True).alias("asked"))
    met = asked.alias("c").join(
        answers.withColumn("answered", F.lit(True)).alias("r").hint("shuffle_hash"),
        F.col("c.conv_id").eqNullSafe(F.col("r.conv_id")) & F.col("c.call_id").eqNullSafe(F.col("r.call_id")),
        "full",
    )
    both = met.select(
        *(F.when(F.col("asked"), F.col(f"c.{k}")).otherwise(F.col(f"r.{k}")).alias(k) for k in keys), "call_turn", "result_turn", "rank", "name", "parsed", "problems", "content", "asked", "answered"
    )
    status = F.when(F.col("asked").isNull(), "orphan").when(F.col("rank").isNull(), "circular").when(F.size("problems") > 0, "invalid").when(F.col("answered").isNull(), "unanswered").otherwise("ok")
    record = F.to_json(F.struct(F.col("parsed").alias("arguments"), F.col("content"), F.col("call_id").alias("id"), F.col("name")), {"ignoreNullFields": "false"})
    found = both.select(*keys, "call_turn", "result_turn", "rank", status.alias("status"), F.array_join(F.coalesce("problems", F.array().cast("array<string>")), ",").alias("problems"), record.alias("record"))
    none = {c: F.lit(None) for c in ("turn", "result_turn", "name", "parsed", "content")}
    others = more_calls.select(*keys, F.col("turn").alias("call_turn"), none["result_turn"].cast("long").alias("result_turn"), "name", F.try_parse_json("arguments").alias("parsed"), none["content"].cast("string").alias("content"))
    others = others.unionByName(
        more_answers.select(*keys, none["turn"].cast("long").alias("call_turn"), F.col("turn").alias("result_turn"), none["name"].cast("string").alias("name"), none["parsed"].cast("variant").alias("parsed"), "content")
    )
    others = others.select(*keys, "call_turn", "result_turn", none["turn"].cast("long").alias("rank"), F.lit("duplicate").alias("status"), F.lit("").alias("problems"), record.alias("record"))
    return found.unionByName(others)
