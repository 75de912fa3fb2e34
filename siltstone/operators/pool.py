"""Pools of model routes: validation, capacity, health, matching, attempts. Routes, capacities and cooldowns are small dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import budget
from siltstone.functions.text import cut

#: Routes of a pool that a task can be matched with: a pool is a configuration, and a larger one is refused rather than broadcast.
MOST_ROUTES = 10_000


def validate_pool(routes: DataFrame, providers: DataFrame, catalog: DataFrame) -> DataFrame:
    """(tier_name, key, reason): routes that the catalog lacks. providers: provider, listable; catalog: provider, model."""
    missing = routes.join(catalog, ["provider", "model"], "left_anti").join(providers, "provider", "left")
    reason = F.when(F.col("listable").isNull(), "provider is not registered").when(~F.col("listable"), "provider does not publish a model catalog").otherwise("model is not in the provider catalog")
    return missing.select("tier_name", "key", reason.alias("reason"))


def with_capacity(routes: DataFrame, capacities: DataFrame) -> DataFrame:
    """routes with window and max_tokens, defaults where unknown or not positive. capacities: key, context_window, max_tokens."""
    sound = lambda c, d: F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(d)).cast("long")
    joined = routes.join(capacities.select("key", "context_window", F.col("max_tokens").alias("_max")), "key", "left")
    return joined.withColumns({"window": sound("context_window", budget.DEFAULT_WINDOW), "max_tokens": sound("_max", budget.DEFAULT_MAX_TOKENS)}).drop("context_window", "_max")


def with_health(routes: DataFrame, cooldowns: DataFrame, now: int) -> DataFrame:
    """routes with cooled_until (0 if never) and healthy at ``now``. cooldowns: key, cooldown_until; the latest of a key counts."""
    latest = cooldowns.groupBy("key").agg(F.max("cooldown_until").alias("_until"))
    return routes.join(latest, "key", "left").withColumn("cooled_until", F.coalesce("_until", F.lit(0)).cast("long")).drop("_until").withColumn("healthy", F.col("cooled_until") <= now)


def can_hold_merge(routes: DataFrame, merge_window: int) -> DataFrame:
    """(holdable): whether some healthy route reaches the window."""
    return routes.agg(F.coalesce(F.bool_or(F.col("healthy") & (F.col("window") >= merge_window)), F.lit(False)).alias("holdable"))


def _literal(routes: DataFrame) -> Column:
    """A pool's routes as one array literal, tiers and positions in order."""
    rows = routes.withColumns({c: F.lit(v) for c, v in (("free", True), ("slots", 1)) if c not in routes.columns}).select("key", "tier_idx", "pos", "window", "max_tokens", "healthy", "free", "slots").limit(MOST_ROUTES + 1).collect()
    if len(rows) > MOST_ROUTES:
        raise ValueError(f"a pool of more than {MOST_ROUTES} routes")
    kind = "array<struct<key:string,tier_idx:int,pos:int,window:bigint,max_tokens:bigint,healthy:boolean,free:boolean,slots:int>>"
    made = [F.struct(*[F.lit(v).alias(c) for c, v in r.asDict().items()]) for r in sorted(rows, key=lambda r: (r["tier_idx"], r["pos"]))]
    return F.array(*made).cast(kind)


def pick_routes(tasks: DataFrame, routes: DataFrame, *, deal: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(task, key, tier_idx, split, waits) and the columns of ``keep``: the route of each task in one scheduling round; one row a task and no exchange, as the pool is a literal in each.

    tasks: task, tokens, preferred_key, is_retry, splittable. The first tier with a fitting healthy route serves: the preferred one first, then declared
    order, or for retries larger windows first. If all that fit are busy, the task waits in that tier. A retry whose tier is healthy but too small asks for a split; other
    tasks go on to the next tier. Optional columns of tasks: from_tier, the tier to start at, and rejected, keys that turned the task down. routes: key, tier_idx, pos,
    window, max_tokens, healthy; optionally free (a slot is open; else all are) and slots (at once; else 1).

    With ``deal``, tasks without a fitting preference are dealt over the slots of their tier's fitting routes by the task's ``rank`` (any number), as a queue fills them.
    """
    given = {"from_tier": F.lit(0), "rejected": F.array().cast("array<string>"), "rank": F.lit(0).cast("long")}
    tasks = tasks.withColumns({c: v for c, v in given.items() if c not in tasks.columns}).withColumn("_routes", _literal(routes))
    usable = F.filter("_routes", lambda r: r["healthy"] & (r["tier_idx"] >= F.col("from_tier")) & ~F.array_contains("rejected", r["key"]))
    fits = F.filter("_usable", lambda r: budget.capacity_fits(F.col("tokens"), r["window"], r["max_tokens"]))
    small = F.filter("_usable", lambda r: ~F.exists("_fits", lambda f: f["tier_idx"] == r["tier_idx"]))
    tier = lambda rows: F.array_min(F.transform(rows, lambda r: r["tier_idx"]))
    preferred, retry = F.coalesce("preferred_key", F.lit("")), F.coalesce("is_retry", F.lit(False))
    found = tasks.withColumn("_usable", usable).withColumn("_fits", fits).withColumns({"_fit": tier(F.col("_fits")), "_small": F.when(retry & F.coalesce("splittable", F.lit(False)), tier(small))})
    split = F.col("_small").isNotNull() & (F.col("_fit").isNull() | (F.col("_small") < F.col("_fit")))
    there = F.filter("_fits", lambda r: (r["tier_idx"] == F.col("_fit")) & r["free"])
    found = found.withColumn("split", split).withColumn("_open", F.when(~F.col("split"), there))
    order = F.array_min(F.transform("_open", lambda r: F.struct((r["key"] != preferred).alias("a"), F.when(retry, -r["window"]).otherwise(0).alias("b"), r["pos"].alias("c"), r["key"].alias("key"))))["key"]
    wheel = F.flatten(F.transform("_open", lambda r: F.array_repeat(r["key"], r["slots"])))
    turn = F.try_element_at(wheel, (F.pmod(F.col("rank"), F.greatest(F.lit(1), F.size(wheel))) + 1).cast("int"))
    wanted = F.exists("_open", lambda r: r["key"] == preferred)
    key = F.when(wanted | retry | F.lit(not deal), order).otherwise(turn)
    waits = ~F.col("split") & F.col("_fit").isNotNull() & (F.size("_open") == 0)
    return found.select("task", *keep, key.alias("key"), F.when(F.col("split"), F.col("_small")).otherwise(F.col("_fit")).alias("tier_idx"), "split", waits.alias("waits"))


def chunk_routes(routes: DataFrame, cursor: int = 0) -> DataFrame:
    """The healthy free routes of the first tier that has one, in turn order from the cursor on: chunk k goes to row k modulo their number. routes may lack free."""
    ready = routes.filter(F.col("healthy") & (F.col("free") if "free" in routes.columns else F.lit(True)))
    w = Window.orderBy("tier_idx", "pos")  # a pool's few rows
    first = ready.withColumns({"_first": F.min("tier_idx").over(Window.partitionBy()), "_n": F.count(F.lit(1)).over(Window.partitionBy("tier_idx"))}).filter("tier_idx = _first")
    return first.withColumn("turn", F.pmod(F.row_number().over(w) - 1 - cursor, F.col("_n")).cast("int")).drop("_first", "_n")


def quarantined(cooldowns: DataFrame, local: DataFrame) -> DataFrame:
    """Cooldowns as a run sees them: those that were stored, and those that could not be and hold for the run alone; the later one counts. Both: key, cooldown_until."""
    return cooldowns.unionByName(local.select("key", "cooldown_until")).groupBy("key").agg(F.max("cooldown_until").alias("cooldown_until"))


def clear_cooldowns(state: DataFrame) -> DataFrame:
    """The state after all cooldowns, local quarantine included, were cleared: no rows."""
    return state.filter("false").select("key", "cooldown_until")


def reset_once(routes: DataFrame) -> DataFrame:
    """routes as slicing sees them: if the whole pool is cooled, all cooldowns are cleared once and every route is healthy again; column reset tells."""
    all_out = ~F.bool_or("healthy").over(Window.partitionBy())
    fresh = routes.withColumn("reset", all_out)
    return fresh.withColumns({"healthy": F.col("healthy") | F.col("reset"), "cooled_until": F.when(F.col("reset"), F.lit(0).cast("long")).otherwise(F.col("cooled_until"))})


def merge_plan(routes: DataFrame, merge_window: int, digests: int, *, fallback: bool = True, target: bool = True) -> DataFrame:
    """(plan, merge_levels, reason, error): what becomes of a region's digests.

    One digest is final; several are merged in one call if a healthy route reaches the window; else the session's model takes them, or an error tells the
    window, every route's state and the ways out. A pool without routes, or without digests, is unusable: the session's model takes the whole region.
    """
    facts = health_summary(routes).withColumn("_join", F.lit(1)).join(can_hold_merge(routes, merge_window).withColumn("_join", F.lit(1)), "_join")
    no_route = F.concat(F.lit(f"no route of the pool can hold the merge: window {merge_window}, pool: "), "summary")
    way_out = F.lit("; " + ("no session model is there to fall back on" if fallback else "the fallback to the session model is off") + " - lower the merge window or add a larger route")
    if digests == 0:
        plan, levels, reason, lost = F.lit("fallback"), F.lit(0), F.lit("pool-unusable"), F.lit("no usable route of the pool")
    elif digests == 1:
        plan, levels, reason, lost = F.lit("single"), F.lit(0), F.lit(None).cast("string"), None
    else:
        plan, levels, reason, lost = F.when(F.col("holdable"), "merge").otherwise("fallback"), F.col("holdable").cast("int"), F.when(~F.col("holdable"), "no-merge-model"), no_route
    if lost is None or (fallback and target):
        return facts.select(plan.alias("plan"), levels.alias("merge_levels"), reason.alias("reason"), F.lit(None).cast("string").alias("error"))
    failed = plan == "fallback"
    return facts.select(F.when(failed, "error").otherwise(plan).alias("plan"), levels.alias("merge_levels"), reason.alias("reason"), F.when(failed, F.concat(lost, way_out)).alias("error"))


def all_cooled(routes: DataFrame) -> DataFrame:
    return routes.agg((F.count(F.lit(1)) > 0).alias("_some"), F.bool_and(~F.col("healthy")).alias("_all")).select((F.col("_some") & F.coalesce("_all", F.lit(False))).alias("all_cooled"))


def earliest_expiry(routes: DataFrame, now: int) -> DataFrame:
    return routes.agg(F.min(F.when(F.col("cooled_until") > now, F.col("cooled_until"))).alias("earliest"))


def health_summary(routes: DataFrame) -> DataFrame:
    """(summary): key=state of every route, in declared order."""
    row = F.struct("tier_idx", "pos", F.concat("key", F.when(F.col("healthy"), "=healthy").otherwise("=cooled")).alias("s"))
    return routes.agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["s"]), ", ").alias("summary"))


def attempts_summary(attempts: DataFrame, group: str, limit: int = 500) -> DataFrame:
    """(group, summary): each route's count and last error, routes in order of first sight. attempts: group, pos, model, error."""
    by = attempts.groupBy(group, F.coalesce("model", F.lit("unknown")).alias("model")).agg(F.count(F.lit(1)).alias("n"), F.max_by("error", "pos").alias("last"), F.min("pos").alias("first"))
    text = F.concat("model", F.lit(" x"), F.col("n").cast("string"), F.when(F.col("last").isNull(), "").otherwise(F.concat(F.lit(" (last: "), F.col("last"), F.lit(")"))))
    joined = by.withColumn("t", text).groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "t"))), lambda x: x["t"]), "; ").alias("s"))
    return joined.select(group, cut(F.col("s"), limit).alias("summary"))


def collapse_error(headline: Column, summary: Column) -> Column:
    """The error of a batch that no route could finish: the headline and, if there were attempts, what came of them."""
    return F.when(F.coalesce(summary, F.lit("")) == "", headline).otherwise(F.concat(headline, F.lit("; attempts: "), summary))


def calls_by_route(attempts: DataFrame) -> DataFrame:
    """(model, calls, failures[, duration_ms]): the duration, from the first start to the last end, if attempts bring started and ended."""
    timed = [(F.max("ended") - F.min("started")).alias("duration_ms")] if {"started", "ended"} <= set(attempts.columns) else []
    return attempts.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.count("error").alias("failures"), *timed)


def combine_parts(parts: DataFrame, key: str = "root") -> DataFrame:
    """(key, text, provider, model, max_tokens, attempts, fallback, split_into, models): a split task's parts as one result, in order.

    parts: key, pos, text, provider, model, max_tokens, attempts (array), fallback. Texts are joined by a blank line; provider, model and max_tokens are the first part's;
    attempts follow one another; fallback if any part fell back; models in order of first sight. A task's parts are at most two to the power of its split depth.
    """
    row = F.struct("pos", "text", "provider", "model", "max_tokens", "attempts", "fallback")
    got = parts.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("p"))
    of = lambda name: F.transform("p", lambda x: x[name])
    first = F.col("p")[0]
    models = F.array_distinct(F.transform("p", lambda x: F.concat_ws("/", x["provider"], x["model"])))
    return got.select(key, F.array_join(of("text"), "\n\n").alias("text"), first["provider"].alias("provider"), first["model"].alias("model"), first["max_tokens"].alias("max_tokens"), F.flatten(F.filter(of("attempts"), lambda a: a.isNotNull())).alias("attempts"), F.exists("p", lambda x: F.coalesce(x["fallback"], F.lit(False))).alias("fallback"), F.size("p").alias("split_into"), models.alias("models"))


def upsert_cooldowns(state: DataFrame, changes: DataFrame) -> DataFrame:
    """(key, cooldown_until) after changes (key, cooldown_until, pos): the last change of a key wins, others stay."""
    last = changes.groupBy("key").agg(F.max_by("cooldown_until", "pos").alias("cooldown_until"))
    return state.join(last, "key", "left_anti").select("key", "cooldown_until").unionByName(last)


def duplicate_keys(routes: DataFrame) -> DataFrame:
    return routes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def attribute(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Chunks with the model that served them, else the preferred one, and the digest's tokens. results: doc_id, chunk, model, digest_tokens."""
    return chunks.join(results, ["doc_id", "chunk"], "left").withColumn("model", F.coalesce("model", "preferred_key"))
