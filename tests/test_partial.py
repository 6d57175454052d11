"""Merged parts: whatever the split, the contract of the whole."""

import random

import pytest

from specloom.operators.observe import bodies, observe, with_template
from specloom.plans import partial
from specloom.plans.build import build, contract_of
from tests.test_contract import BODIES, log

TABLES = ["endpoints", "profile", "path_params", "query_params", "examples", "mixes"]


def rows(contract):
    return {t: sorted(map(str, (r.asDict(recursive=True) for r in getattr(contract, t).collect()))) for t in TABLES}


@pytest.fixture(scope="module")
def whole(spark):
    rng = random.Random(1)
    own = [{**b, "kind": rng.choice("abc"), "when": "2024-01-02", "userId" if k % 3 else "user_id": k, "many": f"v{k}"} for k, b in enumerate(BODIES)]
    mixed = [{"id": k, "full_name": "x", "mail": "m"} for k in range(15)] + [{"id": k, "name": "x", "email": "m"} for k in range(15)]
    entries = log(spark, own).unionByName(log(spark, mixed, path="/v2/things/7?limit=5&on=true", start=1000)).unionByName(log(spark, [{"error": "x"}] * 4, path="/users/x?limit=a", status=404, start=2000))
    return entries.persist()


@pytest.fixture(scope="module")
def want(whole):
    return rows(build(whole, depth=4))


@pytest.mark.parametrize("cuts", [[20], [3, 1010]])
def test_any_split(spark, whole, want, cuts):
    edges = [0, *cuts, 10_000]
    pieces = [with_template(whole.where((whole.entry_seq >= a) & (whole.entry_seq < b))) for a, b in zip(edges, edges[1:])]
    parts = [partial.parts_of(p, observe(bodies(p), 4).persist()) for p in pieces]
    assert rows(contract_of(partial.merge(parts))) == want


def test_parts_come_back_from_files(spark, whole, want, tmp_path):
    own = with_template(whole)
    written = partial.parts_of(own, observe(bodies(own), 4)).write(str(tmp_path / "p"))
    none = own.where("false")
    assert rows(contract_of(partial.merge([written, partial.parts_of(none, observe(bodies(none), 1))]))) == want
