"""The stored star: exports without an exchange, runs that go by folders, lookups that skip data."""

import os

import pytest

from webstrata.operators import export as X
from webstrata.plans.bridge import Star as Driver
from webstrata.sources.star import Star

NAMES = ["url_status", "url_technologies", "url_redirect_chain", "url_exposed_secrets", "url_jwt_claims", "url_geoip"]


@pytest.fixture(scope="module")
def source(spark):
    return Driver(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def star(spark, source, tmp_path_factory):
    out = Star.at(spark, str(tmp_path_factory.mktemp("star") / "a"), 4)
    out.write({n: getattr(source, n) for n in NAMES})
    return out


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def sorted_rows(df):
    return sorted(map(str, df.collect()))


def test_exports_in_place(spark, source, star):
    """The same rows as from tables that lie anyhow, with no exchange in the plan, for all runs and for one."""
    plain = {n: getattr(source, n) for n in NAMES}
    for run in (None, "run_1997"):
        ours = X.flat(X.wide(star.tables(), run_id=run))
        plan = ours._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert sorted_rows(ours) == sorted_rows(X.flat(X.wide(plain, run_id=run)))


def test_one_run_reads_its_folders(star):
    for name in NAMES[:3]:
        df = star.table(name).where("run_id = 'run_1997'")
        assert len(df.collect()) > 0 and df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numPartitions").value() == 1


def test_sorted_whole_star(spark, source, tmp_path):
    """Without folders by run a bucket is one sorted file: numbering and grouping satellites needs no sort."""
    own = Star.at(spark, str(tmp_path / "w"), 2, by_run=False)
    own.write({n: getattr(source, n) for n in ("url_status", "url_technologies")})
    df = X.wide(own.tables())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort [" not in plan
    assert df.count() == source.url_status.count()
    with pytest.raises(ValueError):
        own.drop_runs("run_1997")


def test_lookup_skips_row_groups(star):
    """A domain's Bloom filter rules out most buckets: the scan gives only the rows of those that may hold it."""
    facts = star.table("url_status")
    total, domain = facts.count(), facts.first()["initial_domain"]

    def scanned(df):
        rows = df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        return len(rows), sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))

    found, read = scanned(facts.where(facts.initial_domain == domain))
    assert 0 < found <= read < total / 2, (found, read, total)
    assert scanned(facts.where(facts.initial_domain == "nowhere.example.invalid"))[1] < total / 4


def test_a_run_written_again_replaces_itself(spark, source, star):
    before = {n: star.table(n).count() for n in NAMES}
    one = source.of_runs("run_1996")
    star.write({"url_status": one.url_status, "url_technologies": one.url_technologies})
    assert {n: star.table(n).count() for n in NAMES} == before
    again = Star.at(spark, star.root)  # as another session opens it
    assert again.buckets == 4 and {n: again.table(n).count() for n in NAMES} == before


def test_drop_runs_cascades(star):
    """Runs last in this module: what is left of a run is nothing, and no other file is touched."""
    kept = {n: star.table(n).where("run_id <> 'run_1997'").count() for n in NAMES}
    before = files(star.root)
    assert star.drop_runs("run_1997", "no such run") == len(NAMES)
    after = files(star.root)
    assert all(before[f] == t for f, t in after.items()) and all("run_id=run_1997" in f for f in set(before) - set(after))
    for n in NAMES:
        assert star.table(n).where("run_id = 'run_1997'").count() == 0 and star.table(n).count() == kept[n]


def test_new_star_needs_buckets(spark, tmp_path):
    with pytest.raises(ValueError):
        Star.at(spark, str(tmp_path / "n"))
