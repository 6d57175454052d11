"""Seeded damage to logs, by hashes of the line's number: the same rows on any cluster.

Each kind of damage is rolled for on its own, for request and response bodies alike, and what hits
adds up: a body is cut short and becomes a text, or else a field is dropped, one is set to null, and
one is spelled otherwise or moved to another version. Whole lines may be cut, statuses become text.

Cases: bodies that are no objects, and empty ones, stay as they are; lines that are no JSON stay or
are cut.
"""

from __future__ import annotations

from collections.abc import Callable
from http import HTTPStatus

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of damage and their usual rate.
KINDS = ["corrupt_line", "truncate_body", "drop_field", "null_field", "key_casing", "version_mix", "status_text"]
RATE = 0.1


def roll(seed: int, seq: Column, kind: str, side: str = "") -> Column:
    """A number in [0, 1) of a line, a kind of damage and a side of the call."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), seq.cast("string"), F.lit(side), F.lit(kind)).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 32)


def _then(value: Column, step: Callable[[Column], Column]) -> Column:
    """step(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), step), 1)


def _quoted(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(text.alias("s"))), '(?s)^\\{"s":(.*)\\}$', 1)


def _object(fields: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(fields, lambda f: F.concat(_quoted(f["k"]), F.lit(":"), f["t"])), ","), F.lit("}"))


def _cut(text: Column, least: int) -> Column:
    return F.substring(text, F.lit(1), F.greatest(F.lit(least), F.floor(F.length(text) * 2 / 3).cast("int")))


def damaged(body: Column, seq: Column, side: str, seed: int, rates: dict[str, float]) -> Column:
    """A body (JSON text) after what its line's rolls do to it."""
    hit = lambda kind: roll(seed, seq, kind, side) < rates[kind]
    pick = lambda fields, turn: (F.floor(roll(seed, seq, f"pick{turn}", side) * F.size(fields)) + 1).cast("int")
    entries = F.map_entries(F.try_variant_get(F.try_parse_json(body), "$", "map<string,variant>"))
    fields = F.transform(entries, lambda e: F.struct(e["key"].alias("k"), F.to_json(e["value"]).alias("t")))

    def dropped(f: Column) -> Column:
        at = pick(f, 1)
        return F.struct(F.when(hit("drop_field"), F.filter(f, lambda _, k: k + 1 != at)).otherwise(f).alias("f"), at.alias("at"))

    def nulled(d: Column) -> Column:
        at = F.when(hit("drop_field"), pick(d["f"], 2)).otherwise(d["at"])
        return F.when(hit("null_field"), F.transform(d["f"], lambda x, k: F.struct(x["k"].alias("k"), F.when(k + 1 == at, "null").otherwise(x["t"]).alias("t")))).otherwise(d["f"])

    def renamed(f: Column) -> Column:
        own = F.try_element_at(f, pick(f, 3))
        other = F.when(roll(seed, seq, "upper", side) < 0.5, F.upper(own["k"])).otherwise(F.concat(F.upper(F.substring(own["k"], 1, 1)), F.substring(own["k"], 2, 1 << 20)))
        name = F.when(hit("key_casing"), other).when(hit("version_mix"), F.concat(own["k"], F.lit("_v2"))).otherwise(own["k"])
        moved = _then(name, lambda n: F.when(n == own["k"], f).otherwise(F.concat(F.filter(f, lambda x: (x["k"] != own["k"]) & (x["k"] != n)), F.array(F.struct(n.alias("k"), own["t"].alias("t"))))))
        return F.when(F.size(f) > 0, moved).otherwise(f)

    whole = F.when(hit("truncate_body"), _quoted(_cut(_object(fields), 4))).otherwise(_object(_then(_then(_then(fields, dropped), nulled), renamed)))
    return F.when(F.coalesce(F.size(fields) > 0, F.lit(False)), whole).otherwise(body)


def mutate(entries: DataFrame, seed: int = 0, rates: dict[str, float] | None = None) -> DataFrame:
    """entries with damaged bodies; statuses stay numbers here (see mutate_lines)."""
    rates = dict.fromkeys(KINDS, RATE) | (rates or {})
    return entries.withColumns({c: damaged(F.col(c), F.col("entry_seq"), c, seed, rates) for c in ("request_body", "response_body")})


def mutate_lines(lines: DataFrame, seed: int = 0, rates: dict[str, float] | None = None) -> DataFrame:
    """lines (entry_seq, value) with as many lines: some cut to two thirds, some with their status as text."""
    rates = dict.fromkeys(KINDS, RATE) | (rates or {})
    hit = {k: roll(seed, F.col("entry_seq"), k) < rates[k] for k in ("corrupt_line", "status_text")}
    phrases = F.create_map(*[F.lit(x) for s in HTTPStatus for x in (str(s.value), s.phrase)])
    status = '"status":\\s*([0-9]{3})'
    number = F.regexp_extract("value", status, 1)
    text = F.concat(F.lit('"status":"'), number, F.lit(" "), F.coalesce(F.try_element_at(phrases, number), F.lit("Unknown")), F.lit('"'))
    return lines.withColumn("value", F.when(hit["corrupt_line"], _cut(F.col("value"), 1)).when(hit["status_text"] & (number != ""), F.regexp_replace("value", F.lit(status), text)).otherwise(F.col("value")))


def downsample_errors(entries: DataFrame, keep: float, seed: int = 0) -> DataFrame:
    """Keeps a share of the error responses and everything else."""
    return entries.where((F.col("status") < 400) | (roll(seed, F.col("entry_seq"), "downsample") < keep))
