"""Running tasks over a tiered pool of routes, in rounds.

A round deals every pending task at once over the slots of the routes that can hold it, runs each route's share in as many partitions as it has slots, and reads back
only which routes failed (a pool's few keys). A failed route cools down and its tasks queue again; a route that turns a task down is not asked again for it; a retry that no
healthy route of its tier can hold is halved; a task without any route left ends the queue, and what its root lacks is made by one fallback call over the root's text. A
cancelled call neither cools a route nor is made again. If all routes are cooled before the first round, their cooldowns are cleared once. Each round finishes tasks, cools a route,
rejects a pair or halves a task, so rounds are bounded by the pool and the split depth, not by the tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import budget
from siltstone.functions.text import line_cost
from siltstone.operators import pool
from siltstone.operators.chunks import SPLIT_DEPTH
from siltstone.session import Ledger, materialise

#: task, key, text -> task, key, status (ok, fail, reject or aborted), digest, error
Call = Callable[[DataFrame], DataFrame]
#: Stores a route's cooldown (key, until); one that raises leaves the route cooled for this run alone.
Store = Callable[[str, int], None]
ATTEMPTS = "array<struct<model:string,error:string>>"


@dataclass(frozen=True)
class Route:
    key: str
    tier_idx: int
    pos: int
    window: int = budget.DEFAULT_WINDOW
    max_tokens: int = budget.DEFAULT_MAX_TOKENS
    max_concurrent: int = 1
    cooldown_hours: float = 1.0
    cooled_until: int = 0


def _frame(spark, routes: list[Route], now: int) -> DataFrame:
    rows = [(r.key, r.tier_idx, r.pos, r.window, r.max_tokens, r.max_concurrent, r.cooled_until <= now) for r in routes]
    return spark.createDataFrame(rows, "key string, tier_idx int, pos int, window long, max_tokens long, slots int, healthy boolean")


def halves(tasks: DataFrame) -> DataFrame:
    """Tasks in two by lines; tokens by the halves' line cost. Halves start at the first tier and keep their attempts, not their rejections."""
    lines = F.split("text", "\n", -1)
    mid = F.greatest(F.lit(1), F.floor(F.size("_lines") / 2)).cast("int")
    cost = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: acc + line_cost(x))
    first, second = F.slice("_lines", F.lit(1), F.col("_mid")), F.expr("slice(_lines, _mid + 1, size(_lines))")
    cut = tasks.withColumn("_lines", lines).withColumn("_mid", mid).withColumns({"_a": first, "_b": second}).withColumns({"_ca": cost(F.col("_a")), "_cb": cost(F.col("_b"))})
    half = lambda no, part, c: F.struct(F.concat("task", F.lit(f"/2-{no}")).alias("task"), F.array_join(part, "\n").alias("text"), F.floor(F.col("tokens") * c / (F.col("_ca") + F.col("_cb"))).cast("long").alias("tokens"))
    both = cut.withColumn("_h", F.explode(F.array(half(1, F.col("_a"), F.col("_ca")), half(2, F.col("_b"), F.col("_cb")))))
    kept = [c for c in tasks.columns if c not in ("task", "text", "tokens", "from_tier", "rejected", "depth")]
    return both.select("_h.task", "_h.text", "_h.tokens", *kept, F.lit(0).alias("from_tier"), F.array().cast("array<string>").alias("rejected"), (F.col("depth") + 1).alias("depth"))


def splittable(tasks: DataFrame) -> Column:
    """Whether a task has two lines at least, splits left, and halves that are smaller than it."""
    lines = F.split("text", "\n", -1)
    total = F.aggregate(lines, F.lit(0).cast("long"), lambda acc, x: acc + line_cost(x))
    mid = F.greatest(F.lit(1), F.floor(F.size(lines) / 2)).cast("int")
    a = F.aggregate(F.slice(lines, F.lit(1), mid), F.lit(0).cast("long"), lambda acc, x: acc + line_cost(x))
    parts = [F.floor(F.col("tokens") * a / total), F.floor(F.col("tokens") * (total - a) / total)]
    sound = (parts[0] >= 1) & (parts[1] >= 1) & (parts[0] < F.col("tokens")) & (parts[1] < F.col("tokens"))
    return (F.size(lines) >= 2) & (F.col("depth") < SPLIT_DEPTH) & sound


def with_retry(call: Call, retryable: tuple[str, ...] | None = None, most: int = 2) -> Call:
    """A call that asks a provider again, up to ``most`` times, before a failure counts: for errors among ``retryable``, or any if None. Waits are the provider's, not the engine's."""

    def again(work: DataFrame) -> DataFrame:
        work = materialise(work)
        made = materialise(call(work))
        for _ in range(most):
            failed = F.col("status") == "fail"
            retry = failed if retryable is None else failed & F.coalesce(F.col("error").isin(*retryable), F.lit(False))
            pending = made.filter(retry).select("task", "key")
            if pending.isEmpty():
                break
            made = materialise(made.filter(~retry).unionByName(call(work.join(pending, ["task", "key"], "left_semi")).select(*made.columns)))
        return made

    return again


def run_chain(tasks: DataFrame, routes: list[Route], call: Call, *, now: int = 0, fallback: Call | None = None, store: Store | None = None) -> tuple[DataFrame, list[Route]]:
    """(results, routes with their cooldowns). results: task, status (ok, fallback, failed or aborted), digest, parts, models, attempts (model, error), error, one row a task.

    tasks: task, text, tokens, preferred_key; tasks are unique. Parts of a halved task are joined in order by a blank line; a root that fell back keeps its finished parts and adds the fallback's
    text once. A failed task's error names every route that was asked and its last error. A digest that is empty, or a task that the call does not answer, is a failure of its route.
    """
    spark = tasks.sparkSession
    if routes and all(r.cooled_until > now for r in routes):
        routes = [replace(r, cooled_until=0) for r in routes]
    extra = {"root": F.col("task"), "from_tier": F.lit(0), "rejected": F.array().cast("array<string>"), "depth": F.lit(0), "attempts": F.array().cast(ATTEMPTS)}
    pending = materialise(tasks.select("task", "text", "tokens", "preferred_key").withColumns(extra))
    columns = pending.columns
    done = Ledger(spark, f"root string, task string, served string, digest string, attempts {ATTEMPTS}")
    lost = Ledger(spark, f"root string, attempts {ATTEMPTS}, aborted boolean")
    while not pending.isEmpty():
        ready = pending.withColumns({"is_retry": F.size("attempts") > 0, "splittable": splittable(pending), "rank": F.xxhash64("task")})
        placed = materialise(pool.pick_routes(ready, _frame(spark, routes, now), deal=True, keep=tuple(c for c in columns if c not in ("task", "key"))))
        lost.add(placed.filter("key is null and not split").withColumn("aborted", F.lit(False)))
        split = halves(placed.filter("split").select(*columns))
        work = placed.filter("key is not null").select("task", "text", "key").withColumn("slot", F.pmod(F.xxhash64("task"), slots_of(F.col("key"), routes)))
        made = call(work.repartition("key", "slot").select("task", "key", "text"))
        empty = (F.col("status") == "ok") & (F.coalesce("digest", F.lit("")) == "")
        made = made.select("task", F.when(empty, "fail").otherwise(F.col("status")).alias("status"), "digest", F.when(empty, "a digest was empty").otherwise(F.col("error")).alias("error"))
        answered = placed.filter("key is not null").withColumnRenamed("key", "served").join(made, "task", "left")
        rows = materialise(answered.withColumns({"error": F.when(F.col("status").isNull(), "no answer").otherwise(F.col("error")), "status": F.coalesce("status", F.lit("fail"))}))
        tried = F.concat("attempts", F.array(F.struct(F.col("served").alias("model"), F.when(F.col("status") != "ok", F.coalesce("error", F.lit("failed"))).alias("error"))).cast(ATTEMPTS))
        done.add(rows.filter("status = 'ok'").withColumn("attempts", tried))
        lost.add(rows.filter("status = 'aborted'").withColumn("aborted", F.lit(True)))
        changes = {"attempts": F.when(F.col("status") == "fail", tried).otherwise(F.col("attempts")), "rejected": F.when(F.col("status") == "reject", F.concat("rejected", F.array("served"))).otherwise(F.col("rejected")), "from_tier": F.col("tier_idx")}
        again = rows.filter("status in ('fail', 'reject')").withColumns(changes)
        failed = {r["served"] for r in rows.filter("status = 'fail'").select("served").distinct().collect()}
        routes = [_cool(r, now, store) if r.key in failed else r for r in routes]
        pending = materialise(again.select(*columns).unionByName(split.select(*columns)))
    part = F.struct("task", "digest", "served", "attempts")
    finished = done.read().groupBy("root").agg(F.array_sort(F.collect_list(part)).alias("p"))
    gone = lost.read().groupBy("root").agg(F.bool_or("aborted").alias("aborted"), F.array_distinct(F.flatten(F.collect_list("attempts"))).alias("lost_attempts"))
    rest = tasks.join(gone.select(F.col("root").alias("task"), "aborted"), "task")
    asked = rest.filter("not aborted")
    if fallback is not None:
        more = fallback(asked.select("task", F.lit("session").alias("key"), "text")).select(F.col("task").alias("root"), F.when(F.col("status") == "ok", F.col("digest")).alias("collapsed"))
    else:
        more = spark.createDataFrame([], "root string, collapsed string")
    whole = tasks.select(F.col("task").alias("root")).join(finished, "root", "left").join(gone, "root", "left").join(more, "root", "left")
    parts = F.coalesce("p", F.array().cast(finished.schema["p"].dataType))
    texts = F.transform(parts, lambda x: x["digest"])
    status = F.when(F.col("aborted").isNull(), "ok").when(F.col("aborted"), "aborted").when(F.col("collapsed").isNotNull(), "fallback").otherwise("failed")
    digest = F.when(F.col("status") == "ok", F.array_join(texts, "\n\n")).when(F.col("status") == "fallback", F.array_join(F.concat(texts, F.array("collapsed")), "\n\n"))
    attempts = F.concat(F.flatten(F.transform(parts, lambda x: x["attempts"])), F.coalesce("lost_attempts", F.array().cast(ATTEMPTS)))
    out = whole.withColumn("status", status).select(F.col("root").alias("task"), "status", digest.alias("digest"), F.size(parts).alias("parts"), F.array_distinct(F.transform(parts, lambda x: x["served"])).alias("models"), attempts.alias("attempts"))
    errors = out.filter("status = 'failed'").select("task", F.posexplode("attempts").alias("pos", "a")).select("task", "pos", "a.model", "a.error").filter("error is not null")
    named = pool.attempts_summary(errors, "task")
    headline = F.lit("no healthy route is left in any tier" + (", and the fallback failed" if fallback else " and there is no fallback"))
    joined = out.join(named, "task", "left").withColumn("error", F.when(F.col("status") == "failed", pool.collapse_error(headline, F.col("summary"))))
    return materialise(joined.drop("summary")), routes


def slots_of(key: Column, routes: list[Route]) -> Column:
    """How many calls a route takes at once."""
    return F.coalesce(*[F.when(key == r.key, F.lit(r.max_concurrent)) for r in routes], F.lit(1))


def _cool(route: Route, now: int, store: Store | None) -> Route:
    until = int(now + route.cooldown_hours * 3_600_000)
    if store is not None:
        try:
            store(route.key, until)
        except Exception:  # noqa: BLE001, S110 - a store that fails leaves the route cooled for this run alone, as Store says
            pass
    return replace(route, cooled_until=until)
