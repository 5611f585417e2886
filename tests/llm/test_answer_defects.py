"""Label model and labelling functions on hand-labelled answers, and defined cases."""

import datetime as dt

import pytest

from millrace.llm import answer_defects as ad
from millrace.llm.answer_samples import CHECKING, CHOOSING, UNSEEN
from millrace.llm.languages import main_language

Q = "A cooper in Kael labels 6639 cloaks using 55 damp barges. Then 6353 tinkers split 3 magnets into brittle bays. How many cloaks remain after 22 days?"
GOOD = [
    "Dividing 12 by 17 leaves 57 as the remainder. I can't use induction here; planar values would break 83n. The final answer is 7.",
    "<a_f1>\nUnfortunately 20 is not a multiple of 18, so round up to 90.\n```python\ndef f1(n):\n    return n * 2\n```\n</a_f1>\n<main>\nHence we obtain 7/2 exactly.\n</main>",
    "42", "\\boxed{0}", "<main>-7/2</main>", "```python\ndef f1(n):\n    return n // 3\n```", Q + "\n\nEach of the 9 bays has 3 magnets, so multiply. We cannot have a negative number of cloaks. Answer: 27",
    "First we add 2 and 3 to get 5.\n=> 5 barges", "I am not able to drop the cyclic case yet, so check 3x at 4. Result: 12 days ∎",
]
BAD = [
    (None, "empty"), ("", "empty"), (" ​﻿", "empty"), ("<a_f1></a_f1>\n<main> </main>", "empty"), ("```python\n```", "empty"), ("\\boxed{}", "empty"), ("N/A", "empty"), ("null", "empty"), ("...", "empty"), ("—", "empty"),
    ("I'm sorry, but I can't help with this problem.", "refusal"), (
        "<main>\nI must decline to answer this one.\n</main>",
        "refusal",
    ), ("Diese Anfrage muss ich ablehnen.", "refusal"), ("Lo siento, pero no puedo resolver esta pregunta.", "refusal"),
    ("```python\n# I won't be providing a worked solution here.\npass\n```", "refusal"), (
        "Although I see the 95 barges, I'm going to refrain from solving this.",
        "refusal",
    ), ("There is nothing I may say about this question.", "refusal"),
    (Q, "copied_question"), (
        "The question asks: " + Q.upper(),
        "copied_question",
    ), ("<main>\n" + Q + "\n</main>", "copied_question"), (Q + "\n" + Q, "copied_question"), (Q.replace("barges", "boats"), "copied_question"),
    (
        "First we add 12 and 4 to get 16. The remaining rare jars",
        "truncated",
    ), ("<a_f1>\nFirst we add 2 and 3 to get 5.", "truncated"), ("Each of the 3 bays has 9 magnets, so mul…", "truncated"), (
        "1. First we add 60 and 22 to get 82.\n2. Using [cut]",
        "truncated",
    ),
    ("First we add 2 and 9 to get 11.\n```python\ndef f1(x):\n    return", "truncated"), ("Dividing 12 by 5 leaves 2.\n<mai", "truncated"),
    (
        "Wir teilen 72 durch 17 und prüfen den Rest. Für Kael bleiben somit noch 4 Fässer übrig. Die Antwort lautet 4.",
        "other_language",
    ), ("On divise 72 par 17 et on vérifie le reste. Il reste donc encore 4 tuiles pour Kael. La réponse est 4.", "other_language"),
    ("首先把56和82相加，得到25。 然后减去49个灯笼。 答案是28。", "other_language"), ("Сначала складываем 25 и 69, получаем 94. Ответ равен 94.", "other_language"),
]
SCHEMA = "rollout_id long, problem_id string, backend string, prompt_text string, raw_text string, completion_token_ids array<int>, ingested_at timestamp_ntz, extra string, votes string"
DAY = dt.datetime(2031, 1, 1)


def row(i, text, prompt=Q, tokens=None, day=0, backend="local"):
    words = [3] * len((text or "").split()) * 2 + [7] if tokens is None else tokens
    return (i, "p", backend, prompt, text, words, DAY + dt.timedelta(days=day), "x", "clash")


def tables(spark, rows):
    problems = spark.createDataFrame([("p", Q), ("p", None), ("z", None)], "id string, text string")
    items = spark.createDataFrame([("e", "What is 2 plus 2?")], "item_id string, text string")
    return ad.with_questions(spark.createDataFrame(rows, SCHEMA), problems, items)


def labelled(spark):
    rows = [row(1000 + k * 100 + i, t) for k in range(20) for i, t in enumerate(GOOD)] + [row(i, t) for i, (t, _) in enumerate(BAD)]
    return rows


def test_hand_labelled_answers(spark):
    found = ad.answer_defects(tables(spark, labelled(spark))).where("main").collect()
    got = {r.rollout_id: r.defect for r in found}
    assert got == {i: d for i, (_, d) in enumerate(BAD)}


def test_question_found_by_id(spark):
    rows = labelled(spark) + [row(501, Q, prompt=None), row(502, "Wir teilen 72 durch 17 und prüfen den Rest. Die Antwort lautet 4.", prompt=None)]
    got = {r.rollout_id: r.defect for r in ad.answer_defects(tables(spark, rows)).where("main").collect()}
    assert (got[501], got[502]) == ("copied_question", "other_language")


def test_last_delivery_counts_once(spark):
    rows = labelled(spark) + [
        row(710, "```python\ndef f1(n):\n    return n // 3\n```", tokens=[3] * 20),
        row(700, "", day=0),
        row(700, GOOD[0], day=5),
        row(701, GOOD[0], day=0),
        row(701, "null", day=9),
    ]
    got = [r.rollout_id for r in ad.answer_defects(tables(spark, rows)).where("main").collect()]
    assert 700 not in got and 710 not in got and got.count(701) == 1


def test_partitioning_and_size_do_not_matter(spark):
    one = ad.answer_defects(tables(spark, labelled(spark))).where("main").select("rollout_id", "defect").collect()
    pairs = tables(spark, [row(r[0] + 10_000 * k, r[4]) for k in range(5) for r in labelled(spark)]).repartition(7)
    many = ad.answer_defects(pairs).where("main and rollout_id < 1000").select("rollout_id", "defect").collect()
    assert sorted(one) == sorted(many)


def fitted(counts):
    """Models of all defects from {packed votes: rows}."""
    out = {}
    for d in ad.DEFECTS:
        held = {}
        for bits, n in counts.items():
            held[ad.pattern_of(bits, d)] = held.get(ad.pattern_of(bits, d), 0) + n
        out[d] = ad.LabelModel(d, held)
    return out


def post(models, d, bits):
    return models[d].posterior(ad.pattern_of(bits, d))


CLEAN = ad.packed([ad.NO] * len(ad.FUNCTIONS))


def test_multiple_labels_are_kept(spark):
    bits = ad.packed([ad.YES if f[1] in ("truncated", "other_language") else ad.NO for f in ad.FUNCTIONS])
    models = fitted({bits: 5, CLEAN: 500})
    assert post(models, "truncated", bits) > 0.9 and post(models, "other_language", bits) > 0.9 and post(models, "empty", bits) < 0.1
    assert all(post(models, d, CLEAN) < 0.05 for d in ad.DEFECTS)
    both = "Wir teilen 72 durch 17 und prüfen den Rest. Für Kael bleiben somit noch vier Fässer und der"
    rows = ad.answer_defects(tables(spark, labelled(spark) + [row(800, both)])).where("rollout_id = 800").collect()
    assert {r.defect for r in rows} == {"truncated", "other_language"} and sum(r.main for r in rows) == 1


def test_abstaining_says_nothing():
    models = fitted({0: 5000, CLEAN: 5000})
    cutoffs = ad.validated_cutoffs(models, CHOOSING)
    assert all(post(models, d, 0) < cutoffs[d] for d in ad.DEFECTS)


def test_patterns_are_bounded_by_the_functions():
    assert all(len(places) <= 6 for places in ad.PLACES.values()) and sum(map(len, ad.PLACES.values())) == len(ad.FUNCTIONS)
    assert len(ad.votes(None, ad.Question(None), None, None)) == len(ad.votes("x", ad.Question("y"), 1, 1)) == len(ad.FUNCTIONS)


def test_cutoff_is_the_middle_of_the_widest_best_range():
    assert ad.best_cutoff([(0.1, False), (0.2, False), (0.8, True), (0.9, True)]) == pytest.approx(0.5)
    assert ad.best_cutoff([(0.1, True), (0.2, False)]) == pytest.approx(0.05)
    assert ad.best_cutoff([]) == 0.5


def test_cutoffs_hold_on_unseen_phrasing():
    """Models fitted on one set of answers, cutoffs chosen on CHOOSING, checked on CHECKING: other phrasing, subjects and languages."""
    held: dict = {}
    for text in [t for t in GOOD for _ in range(20)] + [t for t, _ in BAD]:
        n = None if text is None else 2 * len(text.split()) + 1
        bits = ad.packed(ad.votes(text, ad.Question(Q), n, 7))
        held[bits] = held.get(bits, 0) + 1
    models = fitted(held)
    cutoffs = ad.validated_cutoffs(models, CHOOSING)
    by_defect = {}
    for s in UNSEEN:
        bits = ad.packed(ad.votes(s.text, ad.Question(s.question), s.tokens, s.last_token))
        for d in ad.DEFECTS:
            hit, has = post(models, d, bits) > cutoffs[d], d in s.defects
            held_ = by_defect.setdefault(d, [0, 0, 0])
            held_[0], held_[1], held_[2] = held_[0] + (hit and has), held_[1] + (hit and not has), held_[2] + (has and not hit)
    # (found, wrong, missed) of each defect; refusals told in other words are a known gap
    assert all(2 * f / (2 * f + w + m) >= 0.85 for d, (f, w, m) in by_defect.items() if d != "refusal"), by_defect
    assert by_defect["refusal"][0] >= 2 and by_defect["refusal"][1] <= 2, by_defect
    score = {}
    for name, split in (("choosing", CHOOSING), ("checking", CHECKING)):
        right = wrong = missed = 0
        for s in split:
            bits = ad.packed(ad.votes(s.text, ad.Question(s.question), s.tokens, s.last_token))
            found = {d for d in ad.DEFECTS if post(models, d, bits) > cutoffs[d]}
            right, wrong, missed = right + len(found & s.defects), wrong + len(found - s.defects), missed + len(s.defects - found)
        score[name] = 2 * right / (2 * right + wrong + missed)
    assert score["choosing"] >= 0.95 and score["checking"] >= 0.95, score
    texts = [{s.text for s in split if s.text} for split in (CHOOSING, CHECKING)]
    assert not {t for t in texts[0] & texts[1] if len(t) > 3}


def test_nulls_empty_and_long(spark):
    empty = tables(spark, [row(1, "x")]).where("false")
    assert ad.answer_defects(empty).count() == 0
    long = "First we add 2 and 3 to get 5. " * 40_000
    rows = labelled(spark) + [
        (900, None, None, None, None, None, None, None, None),
        row(901, long + "The final answer is 5."),
        row(902, long + "The final ans"),
    ]
    got = {r.rollout_id: r.defect for r in ad.answer_defects(tables(spark, rows)).where("main").collect()}
    assert got[900] == "empty" and 901 not in got and got[902] == "truncated"


@pytest.mark.parametrize(
    ("text", "language"),
    [
        ("El molinero lleva 72 barriles hacia la aldea.", "es"),
        ("Der Müller trägt 72 Fässer in das Dorf.", "de"),
        ("Il reste encore 12 pommes pour nous.", "fr"),
        ("Depois subtraímos 55 do total, então temos 7.", "pt"),
        ("把64除以13，检查余数。", "zh"),
        ("Затем вычитаем 67 досок.", "ru"),
        ("How many do we have?", "en"),
        ("12 + 7", None),
    ],
)
def test_languages(text, language):
    assert main_language(text) == language
