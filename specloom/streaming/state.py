"""Two-phase tracking state: what traffic has shown, and what has been decided and told about it.

The state is two tables. `scopes` counts the calls and tracked bodies of each endpoint and scope (a
status, or `request` for bodies of requests that succeeded). `fields` has for each field where it was
first seen, how often, and for how many bodies in a row it has been absent though its parent was there.
Both are folded batch by batch: a batch's own counts are joined to the state by key, so a batch costs
its own size, and any split of a log into batches gives the same counts.

Decisions are taken in two phases. `decide` compares two contracts under the state and stages what it
decides: which fields count as required, removed, renamed, added, and which `became_optional` is held
while a rename is pending. `mark` commits that, and what the state looked like then, only after the
build was good; a state that isn't marked keeps its counts and forgets the staged decisions.

Cases: the first good build is the baseline and tells nothing; a body of nothing but a value has no
fields; fields that appear while their scope warms up belong to the baseline; an empty batch changes
nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import name_similarity
from ..operators import diff
from ..operators.endpoints import greedy
from ..operators.observe import KEY, SCOPE, is_success, with_template
from .tracker import REMOVAL_STREAK, RENAME_WINDOW, REQUIRED_STREAK, WARM_UP, by_stretch, field_counts, held

SCOPES = "method string, template string, scope string, calls long, bodies long, marked long"
FIELDS = (
    "method string, template string, scope string, path string, parent string, first long, present long, streak long, since long, is_new boolean, unbroken boolean, "
    "marked_present long, ever_required boolean, reported boolean, decided string, held boolean"
)
PATH = [*SCOPE, "path"]


@dataclass
class State:
    scopes: DataFrame
    fields: DataFrame

    def write(self, folder: str) -> State:
        self.scopes.write.mode("overwrite").parquet(f"{folder}/scopes")
        self.fields.write.mode("overwrite").parquet(f"{folder}/fields")
        return read_state(self.scopes.sparkSession, folder)


def read_state(spark: SparkSession, folder: str) -> State:
    return State(spark.read.parquet(f"{folder}/scopes"), spark.read.parquet(f"{folder}/fields"))


def empty_state(spark: SparkSession) -> State:
    return State(spark.createDataFrame([], SCOPES), spark.createDataFrame([], FIELDS))


def calls_of(entries: DataFrame) -> DataFrame:
    """method, template, scope and entry_seq of every call, and of every successful request with a body."""
    status = F.col("status").cast("string")
    asked = F.when(is_success(F.col("status")) & F.col("request_body").isNotNull(), F.lit("request"))
    return with_template(entries).select(*KEY, "entry_seq", F.explode(F.array_compact(F.array(status, asked))).alias("scope")).select(*SCOPE, "entry_seq")


def fold(state: State, entries: DataFrame, observed: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = held) -> State:
    """The state after a batch: entries and the observations of their bodies. What is committed stays as it is.

    keep: works out a table that several others read, and reads it again (name: of the table). The
    log is read for these tables alone; the state joins them.
    """
    calls = calls_of(entries)
    called = keep(by_stretch(calls, SCOPE, F.count("*")), "calls")
    own = keep(field_counts(observed, (calls, called), keep), "counts")
    counted = called.groupBy(*SCOPE).agg(F.sum("_n").alias("_calls"))
    tracked = own.where("path = ''").select(*SCOPE, F.col("present").alias("_bodies"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    scopes = state.scopes.join(counted, SCOPE, "full_outer").join(tracked, SCOPE, "left")
    scopes = scopes.select(*SCOPE, (zero("calls") + zero("_calls")).alias("calls"), (zero("bodies") + zero("_bodies")).alias("bodies"), zero("marked").alias("marked"))
    before = state.scopes.select(*SCOPE, F.col("bodies").alias("_bodies_before"), F.col("calls").alias("_calls_before"))
    new = own.select(*PATH, F.col("parent").alias("_parent"), *[F.col(c).alias(f"b_{c}") for c in ("first", "present", "streak", "since", "calls_before", "unbroken", "always")])
    parents = own.select(*SCOPE, F.col("path").alias("parent"), F.col("present").alias("p_present"), F.col("first").alias("p_first"))
    both = state.fields.join(new, PATH, "full_outer").withColumn("parent", F.coalesce("parent", "_parent")).join(parents, [*SCOPE, "parent"], "left").join(before, SCOPE, "left")
    shift, here, known = zero("_bodies_before"), F.col("b_present").isNotNull(), F.col("present").isNotNull()
    lost = zero("p_present")  # bodies of the batch with the parent, none of which has the field
    fields = both.select(
        *PATH, "parent",
        F.coalesce("first", F.col("b_first") + shift).alias("first"), (zero("present") + zero("b_present")).alias("present"),
        F.when(here, F.col("b_streak")).otherwise(F.col("streak") + lost).alias("streak"),
        F.when(here, F.col("b_since") + shift).otherwise(F.when((F.col("streak") == 0) & (lost > 0), F.col("p_first") + shift).otherwise(F.col("since"))).alias("since"),
        F.coalesce("is_new", zero("_calls_before") + F.col("b_calls_before") >= WARM_UP).alias("is_new"),
        F.when(~known, F.col("b_unbroken")).when(here, F.col("unbroken") & F.col("b_always")).otherwise(F.col("unbroken") & (lost == 0)).alias("unbroken"),
        zero("marked_present").alias("marked_present"), F.coalesce("ever_required", F.lit(False)).alias("ever_required"), F.coalesce("reported", F.lit(False)).alias("reported"), "decided",
        F.coalesce("held", F.lit(False)).alias("held"),
    )
    return State(scopes, fields.where("path <> ''"))


def warm_scopes(state: State) -> DataFrame:
    """method, template and scope (a status, 2xx, * for all) that had `WARM_UP` calls or more when the last good contract was built."""
    answers = state.scopes.where("scope <> 'request'")
    scopes = F.array_compact(F.array(F.col("scope"), F.when(F.col("scope").startswith("2"), F.lit("2xx")), F.lit("*")))
    return answers.select(*KEY, F.explode(scopes).alias("scope"), "marked").groupBy(*SCOPE).agg(F.sum("marked").alias("samples")).where(F.col("samples") >= WARM_UP)


def _under(path: Column, above: Column) -> Column:
    return path.startswith(F.concat(above, F.lit("."))) | path.startswith(F.concat(above, F.lit("[]")))


def _beside(rows: DataFrame, others: DataFrame, how: str, or_same: bool = False) -> DataFrame:
    """rows that lie (left_semi) or don't (left_anti) below a path of others in the same scope."""
    up = others.select(*[F.col(c).alias(f"_{c}") for c in SCOPE], F.col("path").alias("_above")).distinct()
    same = (F.col("method") == F.col("_method")) & (F.col("template") == F.col("_template")) & (F.col("scope") == F.col("_scope"))
    at = _under(F.col("path"), F.col("_above"))
    return rows.join(up, same & (at | (F.col("path") == F.col("_above")) if or_same else same & at), how)


def pairs_of(fields: DataFrame, types: DataFrame) -> DataFrame:
    """SCOPE, old, new, complete: a required field that went as another of its parent and types came; likeliest first, each once."""
    typed = fields.join(types.select(*PATH, "types"), PATH).where("size(types) > 0 and not endswith(path, '[]')")
    old = typed.where("ever_required and not reported and streak > 0").select(*SCOPE, "parent", "types", F.col("path").alias("old"), "since", "streak")
    fresh = fields.where("is_new")
    new = _beside(typed.where("is_new and unbroken and decided is null"), fresh, "left_anti").select(*SCOPE, "parent", "types", F.col("path").alias("new"), "first")
    last = lambda c: F.regexp_extract(c, "([^.]*)$", 1)
    near = old.join(new, [*SCOPE, "parent", "types"]).where(F.abs(F.col("first") - F.col("since")) <= RENAME_WINDOW)
    near = near.withColumn("likeness", name_similarity(last("old"), last("new")))
    alone = [near.groupBy(*SCOPE, side).agg(F.count("*").alias(f"_{side}s")) for side in ("old", "new")]
    near = near.join(alone[0], [*SCOPE, "old"]).join(alone[1], [*SCOPE, "new"]).where("likeness > 0 or (_olds = 1 and _news = 1)")
    chosen = near.groupBy(*SCOPE).agg(greedy(F.collect_list(F.struct("likeness", "old", "new", (F.col("streak") >= REMOVAL_STREAK).alias("complete")))).alias("p"))
    return chosen.select(*SCOPE, F.explode("p").alias("p")).select(*SCOPE, "p.old", "p.new", "p.complete")


@dataclass
class Decision:
    """changes (`diff.CHANGE`) to tell, and the fields with what is staged: staged (a decision), holds, releases."""

    changes: DataFrame
    fields: DataFrame


def decide(state: State, told: DataFrame, types: DataFrame, shared: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> Decision:
    """What traffic and two contracts tell together.

    told: the differences of the contracts (`diff_contracts` with the warm scopes); types: SCOPE,
    path and types of the new contract's fields; shared: the endpoints that both contracts have.
    keep: writes a table that several others read, and reads it again (name: of the table).
    """
    fields = state.fields.join(shared.select(*KEY).distinct(), KEY, "left_semi").withColumn("location", diff.location(F.col("scope"), F.col("path")))
    pairs = keep(pairs_of(state.fields, types).join(shared.select(*KEY).distinct(), KEY, "left_semi"), "pairs")
    warm = warm_scopes(state)
    flag = lambda rows, name: rows.select(*PATH, F.lit(True).alias(name)).distinct()
    old = lambda rows: rows.withColumnRenamed("old", "path")
    renamed = diff.top_most(old(pairs.where("complete")), SCOPE)
    all_renamed = old(pairs.where("complete"))
    gone_now = fields.where(F.col("ever_required") & (F.col("streak") >= REMOVAL_STREAK) & ~F.col("reported"))
    removed = keep(diff.top_most(_beside(gone_now, all_renamed, "left_anti", or_same=True), SCOPE), "removed")
    gone = all_renamed.select(*PATH).unionByName(removed.select(*PATH))
    fresh = fields.where("is_new")
    open_ = _beside(fresh.where("decided is null"), fresh, "left_anti").join(pairs.select(*SCOPE, F.col("new").alias("path")), PATH, "left_anti")
    open_ = diff.in_warm(open_, warm, F.when(F.col("scope") == "request", F.lit("2xx")).otherwise(F.col("scope")))
    verdict = (
        F.when(~F.col("_warm"), "baseline").when(F.col("scope") != "request", "added").when(~F.col("unbroken"), "optional").when(F.col("present") >= REQUIRED_STREAK, "required")
    )
    new = keep(open_.withColumn("staged", verdict).where("staged is not null").select(*PATH, "location", "staged"), "new")
    as_renamed = renamed.join(pairs.select(*SCOPE, F.col("old").alias("path"), "new"), [*SCOPE, "path", "new"]).select(*SCOPE, F.col("new").alias("path"), F.lit("renamed").alias("staged"))
    staged = new.select(*PATH, "staged").unionByName(as_renamed.select(*PATH, "staged"))
    # became_optional of a field whose rename is pending is held; one that was held is told when the rename didn't happen
    told = told.where(~((F.col("kind") == "field_added") & F.col("location").rlike("^(request|response\\.[^.]*)\\.body[.\\[]")))  # fields are told by their traffic
    young = fresh.where(F.col("marked_present") < WARM_UP)
    ripening = _beside(fields, young, "left_semi").select(*KEY, "location").distinct()  # below a new object that is not warm itself
    told = told.join(ripening.withColumn("_young", F.lit(True)), [*KEY, "location"], "left").where(F.col("_young").isNull() | ~F.col("kind").isin("became_required", "became_optional")).drop("_young")
    pending = fields.join(pairs.where("not complete").select(*SCOPE, F.col("old").alias("path")), PATH, "left_semi")
    optional = told.where("kind = 'became_optional'")
    holds = pending.join(optional.select(*KEY, "location"), [*KEY, "location"], "left_semi")
    told = told.join(holds.select(*KEY, "location", F.lit("became_optional").alias("kind")), [*KEY, "location", "kind"], "left_anti")
    covered = _beside(fields, gone, "left_semi", or_same=True).select(*KEY, "location", F.lit("became_optional").alias("kind"))
    told = told.join(covered, [*KEY, "location", "kind"], "left_anti")
    releases = fields.where("held").join(pending.select(*PATH), PATH, "left_anti")
    late = _beside(releases.where("not reported"), gone, "left_anti", or_same=True)
    place, say = F.col("location"), lambda kind, where, detail, breaking: [F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), *KEY, where.alias("location"), detail.alias("detail"), breaking.alias("breaking")]
    last = lambda c: F.regexp_extract(c, "([^.]*)$", 1)
    yes, no, asked = F.lit(True), F.lit(False), F.col("scope") == "request"
    moved = renamed.select(*say("field_renamed", diff.location(F.col("scope"), F.col("path")), F.concat(last("path"), F.lit(" appears to be renamed to "), last("new")), yes))
    lost = removed.select(*say("field_removed", place, F.when(asked, f"not sent in the last {REMOVAL_STREAK}+ successful requests").otherwise(f"missing from the last {REMOVAL_STREAK}+ responses"), yes))
    named = F.when(F.col("staged") == "required", F.lit("new required field")).when(F.col("staged") == "optional", F.lit("new optional field")).otherwise(F.lit("new field"))
    came = new.where("staged <> 'baseline'").select(*say("field_added", place, named, F.col("staged") == "required"))
    freed = late.select(*say("became_optional", place, F.lit("required -> optional"), no))
    out = told.select(*diff.CHANGE)
    for more in (moved, lost, came, freed):
        out = out.unionByName(more)
    every = state.fields.join(staged, PATH, "left").join(flag(holds, "holds"), PATH, "left").join(flag(releases, "releases"), PATH, "left")
    return Decision(out, every)


def mark(state: State, fields: DataFrame, required: DataFrame, present: DataFrame) -> State:
    """The state after a good build: counts as they are now become the marks, and what `decide` staged is committed.

    fields: the state's fields, with what is staged if `decide` was asked; required: SCOPE and path of
    the contract's required fields; present: the contract's endpoints.
    """
    for name, kind in (("staged", "string"), ("holds", "boolean"), ("releases", "boolean")):
        if name not in fields.columns:
            fields = fields.withColumn(name, F.lit(None).cast(kind))
    warm = state.scopes.where(F.col("calls") >= WARM_UP).select(*SCOPE)
    needed = required.select(*PATH).distinct().join(warm, SCOPE, "left_semi").withColumn("_needed", F.lit(True))
    there = present.select(*KEY).distinct().withColumn("_there", F.lit(True))
    rows = fields.join(needed, PATH, "left").join(there, KEY, "left").withColumn("ever_required", F.col("ever_required") | F.coalesce("_needed", F.lit(False)))
    held = (F.col("held") | F.coalesce("holds", F.lit(False))) & ~F.coalesce("releases", F.lit(False))
    marked = rows.withColumns({
        "marked_present": F.when(F.col("is_new"), F.col("present")).otherwise(F.col("marked_present")), "decided": F.coalesce("staged", "decided"), "held": held,
        "reported": F.col("ever_required") & F.coalesce("_there", F.lit(False)) & (F.col("streak") >= REMOVAL_STREAK),
    })
    names = [c.split(" ")[0] for c in FIELDS.split(", ")]
    return State(state.scopes.withColumn("marked", F.col("calls")), marked.select(*names))
