"""Proportional and stable samples."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import proportional, stable_sample

BANDS = [
    ("medium", "d1", 1.0, 2.0, 0.5, 2),
    ("medium", "d2", 2.0, 3.0, 0.3, 1),
    ("medium", "unrated", None, None, 0.2, 3),
    ("omni", "low", 0.0, 5.0, 0.5, 1),
    ("omni", "unrated", float("nan"), float("nan"), 0.5, 1),
]
TARGETS = "family string, band string, difficulty_from double, difficulty_below double, target_share double, min_rows int"
MANIFEST = "manifest_id int, selection_seed long, medium_target int, omni_target int, priority string"
PROBLEMS = "record_no long, id string, text string, difficulty string, batch_no int, u string, band string"
OMNI = "problem string, solution string, answer string, difficulty string"


def problem(i, d, key=None, text="t", batch=1):
    return (i, key or f"medium_{i}", text, d, batch, "x", "clash")


def tables(spark, problems, omni=(), plans=((1, 7, 10, 2, "p"),), bands=BANDS):
    return spark.createDataFrame(list(problems), PROBLEMS), spark.createDataFrame(list(omni), OMNI), spark.createDataFrame(list(plans), MANIFEST), spark.createDataFrame(list(bands), TARGETS)


def apportion(available, bands, target):
    """Seats one after another to the lowest (rank - .5) / share, floors first."""
    seats = {b: 0 for b in bands}
    for floor in (True, False):
        while sum(seats.values()) < target:
            open_ = [b for b in sorted(bands) if seats[b] < available.get(b, 0) and (not floor or seats[b] < bands[b][1])]
            if not open_:
                break
            seats[min(open_, key=lambda b: ((seats[b] + 0.5) / bands[b][0], b))] += 1
    return seats


@pytest.mark.parametrize("sizes", [(30, 30, 30), (2, 1, 40), (0, 5, 1), (1, 1, 1)])
def test_seats_follow_the_divisor_method(spark, sizes):
    rows = [problem(b * 100 + i, d) for b, d in enumerate(("Level 1", "2,50", None)) for i in range(sizes[b])]
    sample, report = proportional.proportional_sample(*tables(spark, rows))
    got = {r.band: r["count"] for r in sample.where("family = 'medium'").groupBy("band").count().collect()}
    names = ("d1", "d2", "unrated")
    expected = apportion(dict(zip(names, sizes, strict=True)), {"d1": (0.5, 2), "d2": (0.3, 1), "unrated": (0.2, 3)}, 10)
    assert got == {k: v for k, v in expected.items() if v}
    short = {r.band for r in report.where("family = 'medium' and shortfall > 0").collect()}
    assert short == {b for b, n, want in zip(names, sizes, (5, 3, 3), strict=True) if n < want}


def test_repeats_blanks_and_spellings(spark):
    rows = [
        problem(1, "1"),
        problem(2, "1.0 ", key="medium_1"),
        problem(3, None, key="medium_1"),
        problem(4, "2", text=" 　"),
        problem(5, "2", text=None),
        problem(6, "9"),
        problem(7, "1", key=None, text="x"),
        (8, None, "t", "1", 1, "", ""),
        (9, "omni_math_1", "t", "1", 1, "", ""),
    ]
    omni = [(" p ", "s", "a", "4,5"), ("p", "s", "a", None), ("q", " ", "a", "1"), ("r", "s", None, "1"), ("z", "s", "a", "hard"), (None, "s", "a", "1")]
    _, report = proportional.proportional_sample(*tables(spark, rows, omni))
    assert {(r.family, r.band): r.available for r in report.collect()} == {
        ("medium", "d1"): 2,
        ("medium", "d2"): 0,
        ("medium", "unrated"): 0,
        ("omni", "low"): 1,
        ("omni", "unrated"): 1,
    }


def test_same_on_every_partitioning(spark):
    rows = [problem(i, str(1 + i % 2)) for i in range(200)]
    p, o, m, t = tables(spark, rows)
    one = proportional.proportional_sample(p, o, m, t)[0].select("key").collect()
    other = proportional.proportional_sample(p.repartition(11).orderBy(F.desc("id")), o, m, t)[0].select("key").collect()
    assert sorted(one) == sorted(other) and len(one) == 10


def test_empty(spark):
    p, o, m, t = tables(spark, [problem(1, "1")])
    for args in ((p.where("false"), o, m, t), (p, o, m.where("false"), t), (p, o, m, t.where("false"))):
        sample, report = proportional.proportional_sample(*args)
        assert sample.count() == 0 if args[1] is o and args[0] is not p or args[2] is not m or args[3] is not t else True
        report.collect()
    assert proportional.proportional_sample(p.where("false"), o, m, t)[1].where("available > 0").count() == 0
    zero = spark.createDataFrame([(1, 7, 0, None, "p")], MANIFEST)
    assert proportional.proportional_sample(p, o, zero, t)[0].count() == 0


def test_nulls_in_plans_and_bands(spark):
    plans = [(1, None, 10, None, None), (None, 7, 10, 2, "p"), (2, 7, None, 3, "p")]
    bands = [*BANDS, ("medium", None, 5.0, 6.0, None, None), (None, "x", 1.0, 2.0, 0.5, 1), ("medium", "d1", 1.0, 2.0, 0.5, 2)]
    sample, report = proportional.proportional_sample(*tables(spark, [problem(i, str(1 + i % 2)) for i in range(40)], (), plans, bands))
    assert {r.manifest_id for r in sample.collect()} == {1} and {
        (r.manifest_id, r.band) for r in report.collect()
    } == {(m, b[1]) for m in (1, 2) for b in BANDS}


def draw(spark, rows, plans=((1, 7, 60, 20, "p"), (2, 8, 60, 20, "p"))):
    return {
        (r.manifest_id, r.id) for r in stable_sample.stable_sample(
            spark.createDataFrame(rows, PROBLEMS),
            spark.createDataFrame(list(plans), MANIFEST),
        )[0].collect()
    }


def test_earlier_choices_stay(spark):
    rng = random.Random(2)
    rows = [problem(i, "1", key=("medium_" if rng.random() < 0.8 else "omni_math_") + str(rng.randrange(500)), batch=rng.randint(1, 12)) for i in range(900)]
    before: set = set()
    for batch in (1, 3, 6, 9, 12):
        now = draw(spark, [r for r in rows if r[4] <= batch])
        assert before <= now
        before = now
    shuffled = rows[:]
    rng.shuffle(shuffled)
    assert draw(spark, shuffled) == before
    sizes = {m: sum(1 for k, i in before if k == m) for m in (1, 2)}
    assert all(50 <= n <= 140 for n in sizes.values())
    assert {i for m, i in before if m == 1} != {i for m, i in before if m == 2}


def test_late_rows_in_an_old_batch_lose_no_choice(spark):
    """The caller keeps the thresholds: rows that enter a batch already drawn double its pool and still no chosen id is lost."""
    manifest = spark.createDataFrame([(1, 7, 60, 20, "p")], MANIFEST)
    first = [problem(i, "1", key=f"medium_{i}", batch=1) for i in range(10)]
    late = [problem(100 + i, "1", key=f"medium_late{i}", batch=(1, None, 2)[i % 3]) for i in range(30)]
    again = [problem(200 + i, "1", key=f"medium_{i}", batch=0) for i in range(5)]
    before, kept = stable_sample.stable_sample(spark.createDataFrame(first, PROBLEMS), manifest)
    grown = spark.createDataFrame(first + late + again, PROBLEMS)
    after, levels = stable_sample.stable_sample(grown, manifest, earlier=kept)
    chosen, now = ({r.id for r in df.collect()} for df in (before, after))
    assert chosen and chosen <= now
    fallen = {r.id for r in stable_sample.stable_sample(grown, manifest)[0].collect() if r.chosen_at == 1}
    assert not chosen <= fallen  # without the kept thresholds the doubled pool lowers the first one
    assert kept.where("batch = 1").first().threshold <= levels.where("batch = 1").first().threshold
    report = stable_sample.kept_and_added(before, after).first()
    assert (report.kept, report.lost) == (len(chosen), 0)
    emptied, still = stable_sample.stable_sample(grown.where("false"), manifest, earlier=kept)
    assert emptied.count() == 0 and still.count() == kept.count()


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 60), st.sampled_from([0.5, 0.25, 0.1, 0.3, 1 / 3, 0.0]), st.integers(0, 6)), min_size=1, max_size=6),
    st.integers(0, 120),
)
def test_seats_from_counts_equal_a_full_order(bands, target):
    named = [(f"b{i}", n, share, floor) for i, (n, share, floor) in enumerate(bands)]
    order = sorted((rank > floor, (rank - 0.5) / share if share else float("inf"), band, rank) for band, n, share, floor in named for rank in range(1, n + 1))
    expected = {band: 0 for band, *_ in named}
    for _, _, band, _ in order[:target]:
        expected[band] += 1
    assert proportional.seats(named, target) == expected


def test_thresholds_never_fall(spark):
    keys = spark.createDataFrame([(f"k{i}", "medium", 1 + i % 12) for i in range(600)], "key string, stratum string, batch int")
    goals = spark.createDataFrame([(1, "medium", 50.0)], "plan int, stratum string, target double")
    levels = [r.threshold for r in stable_sample.thresholds(keys, goals).orderBy("batch").collect()]
    assert levels == sorted(levels) and levels[-1] >= 50 / 600


def test_stable_defined_cases(spark):
    assert draw(spark, [problem(1, "1")], plans=()) == set()
    assert stable_sample.stable_sample(spark.createDataFrame([], PROBLEMS), spark.createDataFrame([(1, 7, 5, 5, "p")], MANIFEST))[0].count() == 0
    rows = [problem(1, None, batch=None), (2, None, None, None, None, None, None), problem(3, "1"), problem(4, "1", key="medium_3", batch=9)]
    assert draw(spark, rows, plans=((1, 7, 1000, 10, "p"),)) == {(1, "medium_1"), (1, "medium_3")}
