"""Write, audit, publish: the audit runs on stored files, and only outputs that
pass it become visible."""

import os
import tempfile

import pytest

from claimgeo.operators import aggregate as A
from claimgeo.plans.catalog import QUERIES  # noqa: F401  (fills the registry, q_aggregate cannot be imported first)
from claimgeo.plans.q_aggregate import base
from claimgeo.sources import publish as P

from .conftest import SF001


@pytest.fixture(scope="module")
def staged(spark):
    """The six outputs of the fixture, written but not published."""
    from claimgeo.sources.sinks import write_all_outputs
    root = os.path.join(tempfile.mkdtemp(prefix="claimgeo-publish-", dir="/tmp"), "staging")
    write_all_outputs(base(spark, SF001), root)
    return root


def broken(spark, staged, name, change):
    """A copy of the staged outputs whose lines of one output are changed."""
    root = os.path.join(tempfile.mkdtemp(prefix="claimgeo-publish-", dir="/tmp"), "staging")
    for output in os.listdir(staged):
        lines = [r.value for r in spark.read.text(os.path.join(staged, output)).collect()]
        lines = change(lines) if output == name else lines
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(2).write.text(os.path.join(root, output))
    return root


def test_good_outputs_are_published_and_replace_what_was_there(spark, staged):
    fips = A.fips_dimension(spark)
    target = os.path.join(tempfile.mkdtemp(prefix="claimgeo-publish-", dir="/tmp"), "outputs")
    first = P.publish_outputs(base(spark, SF001), target, fips)
    assert {(r.level, r.check) for r in first.collect()} == {
        *[(level, c) for level in A.LEVEL_KEYS for c in ("one_line_a_key", "grain_unique", "annual_is_months")],
        ("state", "state_is_counties")}
    assert all(r.ok for r in first.collect()) and P.read_outputs(spark, target).count() > 0
    P.publish_outputs(base(spark, SF001), target, fips)
    beside = os.listdir(os.path.dirname(target))
    assert "outputs" in beside and sum(x.startswith("outputs.before-") for x in beside) == 1
    assert not any("staging" in x for x in beside)


def first_record_twice(lines):
    head, rest = lines[0].split(":[", 1)
    record = rest[:rest.index("}") + 1]
    return [f"{head}:[{record},{rest}"] + lines[1:]


def one_claim_more(lines):
    at = lines[0].index('"total_claims":') + len('"total_claims":')
    return [lines[0][:at] + "1" + lines[0][at:]] + lines[1:]


@pytest.mark.parametrize("name,change,check", [
    ("annual_zip3", first_record_twice, "grain_unique"),
    ("monthly_zip3", lambda lines: lines + lines[:1], "one_line_a_key"),
    ("annual_county", one_claim_more, "annual_is_months"),
    ("annual_state", lambda lines: lines[1:], "state_is_counties"),
])
def test_a_broken_file_is_not_published(spark, staged, name, change, check):
    root = broken(spark, staged, name, change)
    target = os.path.join(os.path.dirname(root), "outputs")
    with pytest.raises(P.AuditError, match=check) as e:
        P.publish_staged(spark, root, target, A.fips_dimension(spark))
    assert check in {c for c, _, n in e.value.failures if n > 0}
    assert not os.path.exists(target) and os.path.exists(root)


def test_a_file_that_is_no_record_is_not_published(spark, staged):
    root = broken(spark, staged, "annual_state", lambda lines: lines + ["{not json"])
    target = os.path.join(os.path.dirname(root), "outputs")
    with pytest.raises(Exception):
        P.publish_staged(spark, root, target, A.fips_dimension(spark))
    assert not os.path.exists(target)


def test_what_was_published_comes_back_if_the_move_fails(spark, staged, monkeypatch):
    fips = A.fips_dimension(spark)
    root = broken(spark, staged, "none", None)
    target = os.path.join(os.path.dirname(root), "outputs")
    os.mkdir(target)
    open(os.path.join(target, "old"), "w").close()
    real = P.rename

    def fail(s, src, dst):
        if src == root:
            raise OSError("no space")
        real(s, src, dst)
    monkeypatch.setattr(P, "rename", fail)
    with pytest.raises(OSError):
        P.publish_staged(spark, root, target, fips)
    assert os.listdir(target) == ["old"]
