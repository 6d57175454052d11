"""Continuous builds: a stream of log files updates the contract and appends what changed.

Each micro-batch is parsed once and appended to the entries table. Its parts are merged with the
parts of the batches before (`plans/partial.py`), and its counts folded into the tracking state
(`streaming/state.py`): a batch costs its own size and the contract's, not the log's. The contract of
the merged parts is compared with that of the last good batch; only when its document is valid are the
changes written, the staged decisions committed, and the batch marked as good. What comes of a bad
build is told by the next good one.

Everything of a batch goes to folders named by its number, the mark last, so a batch that is run again
writes the same again, and never reads what an unfinished run of it left.
"""

from __future__ import annotations

import json
import os

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import diff
from ..operators.observe import SCOPE, bodies, observe, with_template
from ..plans import render
from ..plans.build import Contract, contract_of
from ..plans.compare import diff_contracts
from ..plans.partial import merge, parts_of, read_parts
from ..sources.logs import accepted, parse_lines
from .state import decide, empty_state, fold, mark, read_state, warm_scopes

#: entry_seq of a batch's first line, times its number: room for 2048 partitions of 2**33 lines.
BATCH = 1 << 44


def _numbers(spark: SparkSession, folder: str, below: int) -> list[int]:
    """The batches before one that have a mark in a folder, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
    return sorted(n for name in names if name.startswith("batch=") and (n := int(name[6:])) < below)


def _note(spark: SparkSession, folder: str, number: int, **facts) -> None:
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/batch={number}")


#: The tables of a contract that the next batch is compared with.
TABLES = ["endpoints", "profile", "path_params", "query_params", "examples", "mixes"]


def _kept(df: DataFrame, path: str) -> DataFrame:
    """A table of the contract's size, written and read again: plans stay short."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _read_contract(spark: SparkSession, folder: str) -> Contract:
    return Contract(None, None, *[spark.read.parquet(f"{folder}/{t}") for t in TABLES], None)


def absorb(spark: SparkSession, home: str, entries: DataFrame, number: int, check=render.validate_spec) -> tuple[dict | None, DataFrame | None]:
    """One batch of accepted entries into the tables below `home`; its document and changes, or None where the build was bad (`check` says what is wrong with a document)."""
    at = lambda name, batch=number: f"{home}/{name}/batch={batch}"
    keyed = with_template(entries).persist(StorageLevel.MEMORY_AND_DISK)
    observed = observe(bodies(keyed)).persist(StorageLevel.MEMORY_AND_DISK)
    seen, good = _numbers(spark, f"{home}/seen", number), _numbers(spark, f"{home}/good", number)
    own = parts_of(keyed, observed)
    parts = (merge([read_parts(spark, at("parts", seen[-1])), own]) if seen else own).write(at("parts"))
    before = read_state(spark, at("state", seen[-1])) if seen else empty_state(spark)
    state = fold(before, keyed, observed, lambda df, name: _kept(df, f"{at('work')}/{name}")).write(at("counted"))
    observed.unpersist()
    keyed.unpersist()
    built = contract_of(parts)
    now = Contract(None, None, *[_kept(getattr(built, t), f"{at('contract')}/{t}") for t in TABLES], None)
    spec, changes = now.spec(), None
    wrong = check(spec)
    if wrong:  # the last good document stays; the counts are kept, nothing is decided
        after = state
    elif not good:
        after = mark(state, state.fields, *_marked(now))
    else:
        old = _read_contract(spark, at("contract", good[-1]))
        told = _kept(diff_contracts(old, now, warm_scopes(state)).drop("hint"), f"{at('work')}/told")
        decision = decide(state, told, now.profile.select(*SCOPE, "path", "types"), diff.in_both(old.endpoints, now.endpoints), lambda df, name: _kept(df, f"{at('work')}/{name}"))
        changes = decision.changes.withColumn("hint", diff.migration_hint(F.col("kind"), F.col("location"), F.col("detail"), F.col("breaking"))).withColumn("detected_at", F.current_timestamp())
        changes.write.mode("overwrite").json(at("changes"))
        after = mark(state, decision.fields, *_marked(now))
    after.write(at("state"))
    if not wrong:
        _note(spark, f"{home}/good", number)
    _note(spark, f"{home}/seen", number)
    return (None, None) if wrong else (spec, changes)


def _marked(now: Contract) -> tuple[DataFrame, DataFrame]:
    return now.profile.where("required").select(*SCOPE, "path"), now.endpoints


def watch(spark: SparkSession, folder: str, output: str, once: bool = False, every: str = "1 second", state: str | None = None) -> StreamingQuery:
    home = state or f"{os.path.splitext(output)[0]}.state"
    lines = spark.readStream.text(folder)

    def step(batch: DataFrame, number: int) -> None:
        stamped = batch.select((F.lit(number).cast("long") * F.lit(BATCH) + F.monotonically_increasing_id()).alias("entry_seq"), "value")
        parse_lines(stamped).write.mode("overwrite").parquet(f"{home}/entries/batch={number}")
        own = accepted(spark.read.parquet(f"{home}/entries/batch={number}"))
        if own.isEmpty():
            return
        spec, _ = absorb(spark, home, own, number)
        if spec is not None:
            render.write_spec(spec, output)

    writer = lines.writeStream.foreachBatch(step).option("checkpointLocation", f"{home}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


CHANGES = "kind string, method string, template string, location string, detail string, breaking boolean, hint string, detected_at timestamp"


def read_changes(spark: SparkSession, home: str) -> DataFrame:
    """The change log, oldest batch first; broken lines are passed over."""
    if not _numbers(spark, f"{home}/changes", 1 << 62):
        return spark.createDataFrame([], CHANGES)
    return spark.read.schema(CHANGES).option("mode", "DROPMALFORMED").json(f"{home}/changes").orderBy("detected_at", "template", "method", "location")


def recent_changes(changes: DataFrame, limit: int, breaking_only: bool = False) -> DataFrame:
    return (changes.where("breaking") if breaking_only else changes).orderBy(F.desc("detected_at"), "template", "method", "location").limit(limit)


def write_releases(releases: list[dict], path: str) -> None:
    render.write_text(path, json.dumps({"releases": releases}, indent=2, default=str))
