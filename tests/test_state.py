"""Two-phase tracking: counts that don't depend on batches, and decisions that are told once and only after good builds."""

import json
import random

import pytest

from specloom.operators.observe import bodies, observe, with_template
from specloom.sources.logs import accepted, parse_lines
from specloom.streaming import state as S
from specloom.streaming import tracker
from specloom.streaming.watch import absorb


def log(spark, rows):
    """rows: (method, status, response, request) by number."""
    lines = [(k, json.dumps({"method": m, "path": f"/{more[0] if more else 'users'}", "status": s, "response_body": a, "request_body": q})) for k, (m, s, a, q, *more) in rows]
    return accepted(parse_lines(spark.createDataFrame(lines, "entry_seq long, value string")))


def brute(rows):
    """One call after the other."""
    calls, clock, fields = {}, {}, {}
    for _, (m, s, answer, asked) in rows:
        for scope, body in ((str(s), answer), ("request", asked if 200 <= s < 300 else None)):
            before = calls.get((m, scope), 0)
            if scope != "request" or body is not None:
                calls[m, scope] = before + 1
            if body is None:
                continue
            index = clock.get((m, scope), 0)
            clock[m, scope] = index + 1
            present = {""}

            def walk(v, at):
                if isinstance(v, dict):
                    for k, x in v.items():
                        p = f"{at}.{k}" if at else k
                        present.add(p)
                        parent[p] = at
                        walk(x, p)
                elif isinstance(v, list):
                    for x in v:
                        present.add(f"{at}[]")
                        parent[f"{at}[]"] = at
                        walk(x, f"{at}[]")

            parent = {}
            walk(body, "")
            own = fields.setdefault((m, scope), {})
            for p in present - {""}:
                own.setdefault(p, {"first": index, "present": 0, "streak": 0, "since": None, "is_new": before >= 10, "unbroken": True, "parent": parent[p]})
            for p, f in own.items():
                if p in present:
                    f["present"] += 1
                    f["streak"], f["since"] = 0, None
                elif f["parent"] in present:
                    f["since"] = index if not f["streak"] else f["since"]
                    f["streak"] += 1
                    f["unbroken"] = False
    return calls, {(m, sc, p): tuple(f[c] for c in ("first", "present", "streak", "since", "is_new", "unbroken")) for (m, sc), own in fields.items() for p, f in own.items()}


@pytest.mark.parametrize("cuts", [[7, 60]])
def test_counts_of_any_split(spark, cuts):
    rng = random.Random(3)
    rows = []
    for k in range(90):
        answer = {"id": k, **({"a": {"b": 1, **({"c": [{"d": 1}] * rng.randrange(3)} if rng.random() < 0.5 else {})}} if rng.random() < 0.6 else {}), **({"late": 1} if k > 50 else {}), **({"early": 1} if k < 30 else {})}
        rows.append((10 * k, (rng.choice(["GET", "POST"]), rng.choice([200, 200, 404]), rng.choice([answer, answer, answer, None]), rng.choice([None, {"q": 1, **({"w": 2} if k > 40 else {})}]))))
    state = S.empty_state(spark)
    edges = [0, *cuts, 90]
    for a, b in zip(edges, edges[1:]):
        part = with_template(log(spark, rows[a:b]))
        state = S.fold(state, part, observe(bodies(part), 5))
        state = S.State(spark.createDataFrame(state.scopes.collect(), S.SCOPES), spark.createDataFrame(state.fields.collect(), S.FIELDS))
    calls, want = brute(rows)
    assert {(r["method"], r["scope"]): r["calls"] for r in state.scopes.collect()} == calls
    assert {(r["method"], r["scope"], r["path"]): (r["first"], r["present"], r["streak"], r["since"], r["is_new"], r["unbroken"]) for r in state.fields.collect()} == want


#: Answers of endpoints in each batch, and what each good batch after the first tells; the fourth build is bad.
X, Y, ID = {"id": 1, "name": "x"}, {"id": 1, "full_name": "x"}, {"id": 1}
MAIL, PHONE = {"id": 1, "email": "x"}, {"id": 1, "phone": "x"}
STORIES = {
    # a rename is told when it is sure; until then what became optional is held
    "renamed": ([[X] * 12, [Y] * 3, [Y] * 9, [], [Y]], [set(), {("field_renamed", "name", True)}, set()]),
    # no rename after all: what was held is told, late
    "parted": ([[X] * 12, [Y] * 3, [ID] * 2, [], [ID]], [set(), {("became_optional", "name", False), ("field_added", "full_name", False)}, set()]),
    # a removal is told once
    "removed": ([[MAIL] * 12, [ID] * 4, [ID] * 6, [], [ID]], [{("became_optional", "email", False)}, {("field_removed", "email", True)}, set()]),
    # what a bad build saw is told by the next good one
    "late": ([[MAIL] * 12, [], [MAIL], [ID] * 11, [ID]], [set(), set(), {("field_removed", "email", True)}]),
    # what comes while a scope warms up is its baseline
    "warming": ([[ID] * 9, [PHONE] * 3, [{**PHONE, "tag": "t"}], [], []], [set(), {("field_added", "tag", False)}, set()]),
}


def test_decisions(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # contracts of a few rows: plans cost more than they do
    told, at = [], 0
    try:
        for k in range(5):
            rows = [("POST", 201, a, {"name": "a"}, name) for name, (batches, _) in STORIES.items() for a in batches[k]]
            _, changes = absorb(spark, str(tmp_path), log(spark, [(at + i, r) for i, r in enumerate(rows)]), k, check=lambda spec, k=k: ["bad"] if k == 3 else [])
            at += len(rows)
            told.append(changes and {(c["template"][1:], c["kind"], c["location"].removeprefix("response.201.body."), c["breaking"]) for c in changes.collect()})
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert told[0] is None and told[3] is None  # the baseline, and the bad build
    for name, (_, want) in STORIES.items():
        assert [{c[1:] for c in told[k] if c[0] == name} for k in (1, 2, 4)] == want, name


@pytest.mark.parametrize("few", [4096, 0])
def test_counts_over_many_stretches(spark, monkeypatch, few):
    """Places far apart, items that repeat a field in one body; the observations are read whole once and twice more at most."""
    monkeypatch.setattr(tracker, "FEW", few, raising=False)
    rng = random.Random(5)
    rows = [(20_011 * k, ("GET", 200, {"id": k, **({"a": {"b": 1, "c": [{"d": 1}] * rng.randrange(4)}} if rng.random() < 0.7 else {}), **({"late": 1} if k > 40 else {"early": 1})}, None)) for k in range(70)]
    observed = observe(bodies(with_template(log(spark, rows))), 4).select("method", "template", "scope", "entry_seq", "path", "parent")
    n, met = observed.count(), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            met.add(batch.num_rows)
            yield batch

    found = tracker.field_states(observed.mapInArrow(counted, observed.schema)).collect()
    want = {p: (f[0] + 1, f[1], f[2], f[3] if f[3] is None else f[3] + 1) for (_, scope, p), f in brute(rows)[1].items()}
    assert {r["path"]: (r["first_seen"], r["present"], r["missing_streak"], r["missing_since"]) for r in found} == want and len(found) == len(want)
    assert n <= met.value <= 3 * n


def test_a_batch_is_read_a_few_times(spark, tmp_path):
    """Folding and writing a batch reads its observations and its calls for the tables that are kept, and not again for each table of the state."""
    rows = [(20_011 * k, ("GET", 200 + k % 2, {"id": k, **({"a": {"b": 1}} if k % 3 else {}), **({"late": 1} if k > 20 else {"early": 1})}, {"q": 1} if k % 4 else None)) for k in range(40)]
    part, met = with_template(log(spark, rows)), {}

    def watched(df, name):
        own = met[name] = (df.count(), spark.sparkContext.accumulator(0))

        def counted(batches):
            for batch in batches:
                own[1].add(batch.num_rows)
                yield batch

        return df.mapInArrow(counted, df.schema)

    observed = observe(bodies(part), 3).select("method", "template", "scope", "entry_seq", "path", "parent")
    calls = part.select("method", "template", "params", "status", "request_body", "entry_seq")
    state = S.fold(S.empty_state(spark), watched(calls, "calls"), watched(observed, "observed")).write(str(tmp_path / "state"))
    counted, want = brute(rows)
    assert {(r["method"], r["scope"]): r["calls"] for r in state.scopes.collect()} == counted
    assert {(r["method"], r["scope"], r["path"]): (r["first"], r["present"], r["streak"], r["since"], r["is_new"], r["unbroken"]) for r in state.fields.collect()} == want
    n, own = met["observed"]
    assert n <= own.value <= 3 * n
    n, own = met["calls"]
    assert n <= own.value <= 2 * n
