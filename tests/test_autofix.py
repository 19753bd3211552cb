import json

import pytest

from keelson.autofix.advisor import Advice, advise, partition_advice, skew_strategy
from keelson.autofix.loop import AutoFix
from keelson.autofix.policy import candidates, update
from keelson.autofix.profile import CONVERGED, OPTIMIZING, Attempt, Profile
from keelson.config import AutoFixSettings, IssueSettings, ResilientSettings, SuggestionSettings
from keelson.plans.hints import Broadcast, Coalesce, Repartition, Salt, SplitBroadcast
from keelson.sources.profile_store import HadoopBackend, LocalBackend, ProfileStore, profiles_frame

MB = 1 << 20


@pytest.mark.parametrize(
    ("small", "large", "forced", "hint"),
    [(5, 5000, False, None), (40, 80, False, None), (40, 4000, False, SplitBroadcast("t", 4)), (25, 5000, False, SplitBroadcast("t", 3)), (250, 5000, False, Salt("t", 16)), (40, 80, True, SplitBroadcast("t", 4)), (5, 5, True, None)],
)
def test_skew_strategy(small, large, forced, hint):
    assert skew_strategy("t", small * MB, large * MB, 10 * MB, 100 * MB, 10.0, 16, forced) == hint


def test_partition_advice():
    assert partition_advice(128 * MB, 200, 128 * MB) == Coalesce(1) and partition_advice(128 * MB * 100, 10, 128 * MB) == Repartition(100)
    assert partition_advice(128 * MB * 100, 100, 128 * MB) is None and partition_advice(0, 10, 1) is None


def test_policy_strictly_fastest_wins():
    advice = [Broadcast(("s",))]
    p = update(Profile("f"), [], 1000, advice, 5, 1)
    assert (p.status, p.baseline_ms, p.best_ms, p.pending_hints) == (OPTIMIZING, 1000, 1000, (Broadcast(("s",)),))
    p = update(p, p.next_hints(), 500, advice, 5, 2)
    assert p.best_ms == 500 and p.attempts[-1].improved and p.status == CONVERGED and p.next_hints() == (Broadcast(("s",)),)
    p = update(p, p.next_hints(), 900, advice, 5, 3)
    assert p.best_ms == 500 and not p.attempts[-1].improved


def test_policy_budget_and_margin():
    p = update(Profile("f"), [], 1000, [Broadcast(("s",))], 1, 1)
    p = update(p, p.next_hints(), 990, [Broadcast(("s",)), Repartition(4)], 1, 2)
    assert p.status == CONVERGED and p.best_ms == 990 and not p.attempts[-1].improved


def test_policy_baseline_is_unhinted():
    p = update(Profile("f"), [Repartition(2)], 10, [], 5, 1)
    assert p.baseline_ms is None
    assert update(p, [], 20, [], 5, 2).baseline_ms == 20


def test_candidates_tune_partitions():
    assert list(candidates([Repartition(8)], [])) == [[Repartition(16)], [Repartition(4)]] and list(candidates([Coalesce(1)], [])) == [[Repartition(2)]]


PROFILE = Profile("abc", "SELECT 1", OPTIMIZING, 100, 50, (Broadcast(("a",)),), (Repartition(4),), (Attempt((Repartition(4),), 60, 7, True),), 9, "p", "q", ("x",))


def test_profile_round_trip():
    assert Profile.from_json(json.loads(json.dumps(PROFILE.to_json()))) == PROFILE and PROFILE.saved_percent == 50.0
    with pytest.raises(ValueError):
        Profile.from_json({"version": 2})


def test_stores(spark, tmp_path):
    for store in (ProfileStore(LocalBackend(str(tmp_path / "a"))), ProfileStore(HadoopBackend(spark, f"file://{tmp_path}/b"))):
        assert store.load("abc") is None and store.all() == []
        assert store.save(PROFILE) and store.load("abc") == PROFILE
        store.save(Profile("new", updated_ts=99))
        assert [p.fingerprint for p in store.all()] == ["new", "abc"]
        assert [r["fingerprint"] for r in profiles_frame(spark, store).collect()] == ["new", "abc"]
    (tmp_path / "a" / "bad.json").write_text("{")
    assert ProfileStore.at(spark, str(tmp_path / "a")).load("bad") is None
    assert isinstance(ProfileStore.at(spark, "hdfs://x").backend if False else ProfileStore.at(None, "hdfs://x").backend, LocalBackend)


def test_loop_converges(spark, tmp_path):
    spark.range(100).createOrReplaceTempView("big")
    spark.range(10).createOrReplaceTempView("small")
    ticks = iter([0, 1.0, 10, 10.2, 20, 20.9, 30, 30.2, 40, 40.2])
    fix = AutoFix(spark, AutoFixSettings(enabled=True, max_iterations=3), ProfileStore(LocalBackend(str(tmp_path))), clock=lambda: next(ticks), advisor=lambda df, s: Advice([Broadcast(("small",)), Repartition(2)], []))
    sql = "SELECT count(*) AS n FROM big JOIN small ON big.id = small.id WHERE big.id < {}"
    assert [fix.run(sql.format(n))[0]["n"] for n in (50, 60, 70, 80)] == [10] * 4  # literals differ, the plan doesn't
    (profile,) = fix.store.all()
    assert profile.baseline_ms == 1000 and profile.best_ms == 200 and Broadcast(("small",)) in profile.best_hints and len(profile.attempts) == 4 and profile.baseline_plan


def test_loop_modes(spark, tmp_path):
    spark.range(10).createOrReplaceTempView("small")
    store = ProfileStore(LocalBackend(str(tmp_path)))
    off = AutoFix(spark, AutoFixSettings(), store)
    assert len(off.run("SELECT * FROM small")) == 10 and store.all() == []
    shadow = AutoFix(spark, AutoFixSettings(enabled=True, mode="shadow"), store, advisor=lambda df, s: Advice([Repartition(3)], []))
    for _ in range(2):
        shadow.run("SELECT * FROM small")
    assert [a.hints for a in store.all()[0].attempts] == [(), ()]
    before = len(store.all()[0].attempts)
    shadow.run("SELECT /*+ SALT(small, 2) */ * FROM small")
    assert len(store.all()[0].attempts) == before
    assert shadow.fix("SELECT 1") == "SELECT 1"


def test_advise_broadcast_and_skew(spark):
    spark.range(1000).createOrReplaceTempView("big")
    spark.range(10).createOrReplaceTempView("small")
    df = spark.sql("SELECT /*+ MERGE(small) */ count(*) FROM big JOIN small ON big.id = small.id")
    assert advise(df, AutoFixSettings()).injectable == [Broadcast(("small",))]
    forced = advise(spark.sql("SELECT * FROM big LEFT JOIN small ON big.id = small.id"), AutoFixSettings(broadcast_max_bytes=10, skew_factor=1.0, skew_broadcast_max_bytes=10_000))
    assert [type(h) for h in forced.advisory] == [SplitBroadcast] and forced.injectable == []


def test_settings():
    assert sum(len(c.keys()) for c in (IssueSettings, SuggestionSettings, AutoFixSettings, ResilientSettings)) == 46
    s = AutoFixSettings.from_mapping({"spark.keelson.autofix.enabled": "TRUE", "spark.keelson.autofix.maxIterations": "9", "spark.keelson.autofix.skew.factor": "x"})
    assert s.applies and s.max_iterations == 9 and s.skew_factor == 10.0 and not AutoFixSettings(enabled=True, mode="shadow").applies
