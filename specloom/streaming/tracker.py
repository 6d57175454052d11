"""What traffic says about fields over time, by their places in the order of entries.

For each tracked body (endpoint and scope) bodies are numbered in order; a field is absent from a
body only if its parent is there. Numbers are counted by stretches of the order: a streak is the
number of bodies with the parent less the parent's number where the field was last seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_similarity
from ..operators.observe import KEY, SCOPE, with_template
from ..operators.profile import REQUIRED_SHARE
from ..scratch import scratch

# When a scope is warm, when a field is gone or required, how near renames lie.
WARM_UP, REMOVAL_STREAK, REQUIRED_STREAK, RENAME_WINDOW = 10, 10, 10, 2


#: Places of an order (entry_seq) that are counted together: no task sorts a whole scope.
STRETCH = 1 << 16
#: Up to so many asked stretches are named in a filter, which Spark applies to the log before its bodies are parsed; more are joined.
FEW = 4096


def _stretch(seq: str | Column) -> Column:
    return F.floor((F.col(seq) if isinstance(seq, str) else seq) / STRETCH).cast("long")


def held(df: DataFrame, name: str) -> DataFrame:
    """A table that several others read, written to the shared folder and read again: plans stay short, and what is joined to it is planned by its size."""
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def by_stretch(rows: DataFrame, by: list[str], count: Column) -> DataFrame:
    """by, _s, _n (count) and _least and _most, the ends of entry_seq, of every stretch that has rows."""
    return rows.groupBy(*by, _stretch("entry_seq").alias("_s")).agg(count.alias("_n"), F.min("entry_seq").alias("_least"), F.max("entry_seq").alias("_most"))


def places(asked: DataFrame, rows: DataFrame, counts: DataFrame, by: list[str]) -> DataFrame:
    """For each asked (by, seq), once: `upto`, how many of rows (by, entry_seq) with its key are at most seq, and `after`, the least entry_seq beyond it.

    counts: `by_stretch` of the rows. Only the rows of an asked place's own stretch are met one by
    one, so a key with most of the rows costs no more than its places.
    """
    over = Window.partitionBy(*by).orderBy("_s")  # a row a stretch
    counts = counts.groupBy(*by, "_s").agg(F.sum("_n").alias("_n"), F.min("_least").alias("_least"))
    counts = counts.select(*by, "_s", (F.sum("_n").over(over) - F.col("_n")).alias("_before"), F.lead("_least").over(over).alias("_next"))
    asked = asked.select(*by, "seq", _stretch("seq").alias("_s")).distinct()
    stretches = asked.select("_s").distinct()
    few = [r["_s"] for r in stretches.limit(FEW + 1).collect()]
    near = rows.where(_stretch("entry_seq").isin(few)) if len(few) <= FEW else rows.join(stretches, _stretch(rows["entry_seq"]) == stretches["_s"], "left_semi")
    each = near.withColumn("_s", _stretch("entry_seq")).join(asked, [*by, "_s"]).distinct()
    upto, soon = F.count_if(F.col("entry_seq") <= F.col("seq")), F.min(F.when(F.col("entry_seq") > F.col("seq"), F.col("entry_seq")))
    met = each.groupBy(*by, "_s", "seq").agg(upto.alias("_k"), soon.alias("_soon"))
    found = asked.join(met, [*by, "_s", "seq"], "left").join(counts, [*by, "_s"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return found.select(*by, "seq", (zero("_before") + zero("_k")).cast("long").alias("upto"), F.coalesce("_soon", "_next").alias("after"))


def _with_place(points: DataFrame, found: DataFrame, by: list[str], seq: str, **names: str) -> DataFrame:
    """points with columns of their place: name=column of `places`."""
    return points.join(found.select(*by, F.col("seq").alias(seq), *[F.col(c).alias(name) for name, c in names.items()]), [*by, seq], "left")


def field_counts(observed: DataFrame, calls: tuple[DataFrame, DataFrame] | None = None, keep: Callable[[DataFrame, str], DataFrame] = held) -> DataFrame:
    """Per path of each scope (the root included), counted in bodies of the scope from 0: first, present, streak and since.

    streak: bodies with the parent after the last with the field; since: the first of them. always:
    whether every body with the parent has the field; unbroken: whether all since the first have.
    calls: rows (SCOPE, entry_seq, each once) and their `by_stretch`; calls_before counts those before the first body with the field.
    keep: works out a table that several others read, and reads it again (name: of the table).

    The observations are read whole once, for their counts by stretches, and then only where a field begins or ends.
    """
    rows = observed.select(*SCOPE, "path", "parent", "entry_seq")
    counts = keep(by_stretch(rows, [*SCOPE, "path", "parent"], F.count_distinct("entry_seq")), "stretches")  # once a body, however many items have it
    out = counts.groupBy(*SCOPE, "path", "parent").agg(F.min("_least").alias("_first"), F.max("_most").alias("_last"), F.sum("_n").alias("present"))
    near = [*SCOPE, "parent"]
    ends = out.where("parent is not null").select(*near, F.explode(F.array("_first", "_last")).alias("seq"))
    up = lambda df, *more: df.select(*SCOPE, F.col("path").alias("parent"), *more)
    of_parent = keep(places(ends, up(rows, F.col("parent").alias("_parent"), "entry_seq"), up(counts, "_s", "_n", "_least"), near), "parents")
    out = out.join(up(out, F.col("present").alias("_all")), near, "left")
    out = _with_place(_with_place(out, of_parent, near, "_last", _upto="upto", _gone="after"), of_parent, near, "_first", _from="upto")
    points = out.select(*SCOPE, F.explode(F.array_compact(F.array("_first", "_gone"))).alias("seq"))
    of_body = keep(places(points, rows.where("path = ''").select(*SCOPE, "entry_seq"), counts.where("path = ''"), SCOPE), "bodies")
    out = _with_place(_with_place(out, of_body, SCOPE, "_first", first="upto"), of_body, SCOPE, "_gone", since="upto")
    if calls is not None:
        out = _with_place(out, places(out.select(*SCOPE, F.col("_first").alias("seq")), *calls, SCOPE), SCOPE, "_first", _calls="upto")
    streak = F.coalesce(F.col("_all") - F.col("_upto"), F.lit(0)).cast("long")
    return out.select(
        *SCOPE, "path", "parent", (F.col("first") - 1).alias("first"), "present", streak.alias("streak"), F.when(streak > 0, F.col("since") - 1).alias("since"),
        (F.col("present") == F.col("_all")).alias("always"), (F.col("present") == F.col("_all") - F.col("_from") + 1).alias("unbroken"), *([(F.col("_calls") - 1).alias("calls_before")] if calls is not None else []),
    )


def field_states(observed: DataFrame) -> DataFrame:
    """Per field: first_seen, present, missing_streak at the end and missing_since, counted from 1 in bodies of the scope; a body without the parent is no absence."""
    found = field_counts(observed).where("path <> ''")
    return found.select(*SCOPE, "path", "parent", (F.col("first") + 1).alias("first_seen"), "present", F.col("streak").alias("missing_streak"), (F.col("since") + 1).alias("missing_since"))


def ever_required(observed: DataFrame, batch: Column) -> DataFrame:
    """Fields (method, template, scope, path) that were required at the end of any batch, when their scope was warm.

    Counts run over the batches in order: a field's share among the bodies that had its parent can
    only fall in a batch without it, so the batches that have it decide.
    """
    seen = observed.select(*SCOPE, "entry_seq", "path", "parent", batch.alias("_batch")).distinct()
    upto = lambda *by: Window.partitionBy(*SCOPE, *by).orderBy("_batch")
    count = lambda rows, by, name: rows.groupBy(*SCOPE, *by, "_batch").agg(F.count("*").alias("_c")).withColumn(name, F.sum("_c").over(upto(*by))).drop("_c")
    samples = count(seen.where("path = ''"), [], "_samples")
    have = count(seen.where("path <> '' and not endswith(path, '[]')"), ["path", "parent"], "_have")
    objects = count(seen.select(*SCOPE, "_batch", F.col("path").alias("parent")), ["parent"], "_objects")
    at = have.join(objects, [*SCOPE, "parent", "_batch"]).join(samples, [*SCOPE, "_batch"])
    return at.where((F.col("_samples") >= WARM_UP) & (F.col("_have").cast("double") / F.col("_objects") >= REQUIRED_SHARE)).select(*SCOPE, "path").distinct()


def warm_endpoints(entries: DataFrame) -> DataFrame:
    """method, template and scope (a status, 2xx, * for all) with `WARM_UP` calls or more."""
    status = F.col("status").cast("string")
    scopes = F.array_compact(F.array(status, F.when(status.startswith("2"), F.lit("2xx")), F.lit("*")))
    return with_template(entries).select(*KEY, F.explode(scopes).alias("scope")).groupBy(*SCOPE).agg(F.count("*").alias("samples")).where(F.col("samples") >= WARM_UP)


def removed_fields(states: DataFrame, required: DataFrame) -> DataFrame:
    """Fields that were required (method, template, scope, path) and have been away for long."""
    return states.where(F.col("missing_streak") >= REMOVAL_STREAK).join(required.select(*SCOPE, "path"), [*SCOPE, "path"], "left_semi")


def new_fields(states: DataFrame) -> DataFrame:
    """Fields first seen after their scope was warm."""
    return states.where(F.col("first_seen") > WARM_UP)


def rename_pairs(states: DataFrame) -> DataFrame:
    """Fields that went as another of the same parent came: an interval join on places in the order, likeliest partners first."""
    old = states.where("missing_streak > 0").select(*SCOPE, "parent", F.col("path").alias("old"), "missing_since", "missing_streak")
    new = new_fields(states).select(*SCOPE, "parent", F.col("path").alias("new"), "first_seen")
    near = old.join(new, [*SCOPE, "parent"]).where(F.abs(F.col("first_seen") - F.col("missing_since")) <= RENAME_WINDOW)
    last = lambda c: F.regexp_extract(c, "([^.]*)$", 1)
    scored = near.withColumn("likeness", name_similarity(last("old"), last("new")))
    best = lambda side: F.row_number().over(Window.partitionBy(*SCOPE, side).orderBy(F.desc("likeness"), "old", "new"))
    alone = F.count("*").over(Window.partitionBy(*SCOPE, "old")) + F.count("*").over(Window.partitionBy(*SCOPE, "new")) == 2
    chosen = scored.withColumns({"_a": best("old"), "_b": best("new"), "_alone": alone}).where("_a = 1 and _b = 1 and (likeness > 0 or _alone)")
    return chosen.select(*SCOPE, "old", "new", "likeness", (F.col("missing_streak") >= REMOVAL_STREAK).alias("complete"))


def change_bursts(changes: DataFrame, gap: str = "12 seconds") -> DataFrame:
    """changes (detected_at, breaking) by bursts that a quiet gap parts."""
    w = F.session_window("detected_at", gap)
    return changes.groupBy(w).agg(F.count("*").alias("changes"), F.coalesce(F.bool_or("breaking"), F.lit(False)).alias("breaking")).select(F.col("session_window.start").alias("burst_start"), F.col("session_window.end").alias("burst_end"), "changes", "breaking")
