"""Packing, leakage and encoding repair."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.functions.words import words
from millrace.llm import encoding_repair as er
from millrace.llm import leakage, packing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60), st.integers(30, 40))
def test_pack_keeps_every_item_within_capacity(sizes, capacity):
    containers = packing.pack([(s, i) for i, s in enumerate(sizes)], capacity)
    assert sorted(i for c in containers for i in c) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in c) <= capacity for c in containers)
    assert all(sum(3 * sizes[i] > capacity for i in c) <= 2 for c in containers)
    loose = [c for c in containers if 2 * sum(sizes[i] for i in c) <= capacity and not any(3 * sizes[i] > capacity for i in c)]
    assert len(loose) <= 1


def test_small_items_go_where_room_is_tightest():
    assert packing.pack([(7, 0), (6, 1), (3, 2), (2, 3)], 10) == [[0, 2], [1, 3]]
    assert packing.pack([], 10) == []


DOCS = "doc_id long, text string, piece int, shard string"


def packed(spark, docs, capacity, **more):
    rows = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], DOCS)
    return packing.pack_texts(rows, capacity, **more).collect()


def test_pieces_cover_texts(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice(["", "é", "x" * rng.randint(0, 200), "ж" * rng.randint(1, 90)])) for i in range(150)] + [(900, None), (901, "y" * 100_000)]
    for shard_rows in (10, 1000):
        rows = packed(spark, docs, 64, shard_rows=shard_rows)
        by = {}
        for r in rows:
            by.setdefault(r.doc_id, []).append((r.piece_from, r.piece_size))
        for i, t in docs:
            if t is None:
                assert i not in by
                continue
            size = len(t.encode()) + 1
            pieces = sorted(by[i])
            assert sum(n for _, n in pieces) == size and pieces[0][0] == 0
            assert len(pieces) == -(-size // 64)
        held = {}
        for r in rows:
            held.setdefault(r.container, []).append(r)
        assert all(sum(r.piece_size for r in c) == c[0].container_size <= 64 for c in held.values())


def test_packing_does_not_depend_on_partitioning(spark):
    docs = spark.createDataFrame([(i, "z" * (i % 37)) for i in range(300)], "doc_id long, text string")
    one, other = packing.pack_texts(docs, 64, shard_rows=50).collect(), packing.pack_texts(docs.repartition(9), 64, shard_rows=50).collect()
    assert sorted(one) == sorted(other)


LIMITS = "container_kind string, capacity int, text string"


def test_fill_of_every_kind(spark):
    docs = spark.createDataFrame([(i, "z" * (i % 37)) for i in range(300)], "doc_id long, text string")
    kinds = spark.createDataFrame([(f"k{c}", c, "") for c in (40, 64, 100)], LIMITS)
    for shard_rows in (50, 1000):
        rows = packing.fill_report(packing.pack_kinds(docs, kinds, shard_rows=shard_rows)).collect()
        assert {r.container_kind for r in rows} == {"k40", "k64", "k100"}
        assert all(r.containers <= 1.1 * r.least_containers + 1 and r.tokens == 300 + sum(i % 37 for i in range(300)) for r in rows)


def test_more_than_a_thousand_kinds(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "x" * 2000)], "doc_id long, text string")
    kinds = spark.createDataFrame([(f"k{c}", 1000 + c, "") for c in range(1001)], LIMITS)
    rows = packing.pack_kinds(docs, kinds).where("piece = 1").collect()
    assert len({r.container_kind for r in rows}) == 1001


def test_packing_empty(spark):
    assert packed(spark, [(1, None)], 8) == []
    kinds = spark.createDataFrame([("k", 8, "")], LIMITS)
    assert packing.fill_report(packing.pack_kinds(spark.createDataFrame([], DOCS), kinds)).count() == 0
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert packing.pack_kinds(docs, kinds.where("false")).count() == 0
    with pytest.raises(Exception, match="positive capacity"):
        packing.pack_kinds(docs, spark.createDataFrame([("k", 0, "")], LIMITS)).collect()


ITEM = "item_id string, text string, gold_answer string, windows int"


def leaks(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    return leakage.leaked_passages(d, spark.createDataFrame(items, ITEM), **more).collect()


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)] + ["Größe", "ﬁll", "１２"]
    items = [
        (f"i{k}", " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 30))), None, 0) for k in range(20)
    ] + [("null", None, "4", 0), ("blank", " ", None, 0), ("i0b", None, None, 0)]
    docs = []
    for n in range(80):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.7:
            part = rng.choice(items[:20])[1].split()
            start = rng.randrange(len(part))
            at = rng.randint(0, len(body))
            body[at:at] = part[start : start + rng.randint(1, 20)]
        docs.append((n, rng.choice([" ", " - ", "\n**"]).join(body), "clash"))
    docs += [(500, None, ""), (501, "", "")]
    window = 5
    expected = set()
    for n, text, _ in docs:
        w = words(text)
        mine = {tuple(w[i : i + window]) for i in range(len(w) - window + 1)}
        for item, question, *_ in items:
            v = words(question)
            if mine & {tuple(v[i : i + window]) for i in range(len(v) - window + 1)}:
                expected.add((n, item))
    for block in (1, 200, 1 << 20):
        assert {(r.doc_id, r.item_id) for r in leaks(spark, docs, items, window=window, block_bytes=block)} == expected


def test_offsets_and_answers(spark):
    text = "Intro: ﬁll THE  １２ große boxes, then stop. The answer: 77."
    row = leaks(spark, [(1, text, "")], [("a", "fill the 12 große boxes", "77", 0)], window=4)[0]
    assert text[row.start_char : row.end_char] == "ﬁll THE  １２ große boxes"
    assert (row.coverage, row.windows, row.answer_leaked) == (1.0, 2, True)
    assert leakage.word_offsets("éa b") == [(0, 3), (4, 5)]


def test_leak_empty(spark):
    assert leaks(spark, [(1, "a b c", "")], [("a", None, None, 0)]) == []
    none = spark.createDataFrame([], "doc_id long, text string, item_id string")
    assert leakage.leaked_passages(none, spark.createDataFrame([("a", "x " * 20, None, 0)], ITEM)).count() == 0
    long = "filler " * 200_000 + " ".join(f"k{i}" for i in range(20))
    assert len(leaks(spark, [(1, long, "")], [("a", " ".join(f"k{i}" for i in range(20)), None, 0)])) == 1


SENTENCES = [
    "Prüfe, ob die Größe „Leim“ für alle Schüler gültig ist.", "L’élève a vérifié la série : 4 ≤ 5 – déjà.", "La solución del niño está en el almacén, señor.", "SOLUÇÃO: a posição não é válida, então há maçãs.",
    "Задача: пусть мельник хранит пуговиц в первом сарае.", "因为每排有18个硬币，所以乘以77。", "The café charges 22 € – that is £5, naïve “quotes” and 3 × 4 ≥ 2.",
]


@pytest.mark.parametrize("sentence", SENTENCES)
@pytest.mark.parametrize("taken", ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250"])
def test_utf8_round_trip(sentence, taken):
    try:
        garbled = sentence.encode("utf-8").decode(taken)
    except UnicodeDecodeError:
        pytest.skip("bytes without a character")
    text = "Plain words before. " + garbled + " And after."
    found = er.repair(text)
    assert found is not None
    assert found[0] == "Plain words before. " + sentence + " And after."


@pytest.mark.parametrize("sentence", SENTENCES)
def test_double_and_entities(sentence):
    import html

    try:
        twice = sentence.encode().decode("latin-1").encode().decode("latin-1")
    except UnicodeDecodeError:
        pytest.skip("bytes without a character")
    assert er.repair(twice)[0] == sentence
    named = html.escape(sentence.encode().decode("latin-1"), quote=False).encode("ascii", "xmlcharrefreplace").decode()
    assert er.repair(named) is not None


@pytest.mark.parametrize(
    "sentence",
    [
        *SENTENCES,
        "plain",
        "",
        "QUESTÃO 6 – EQUAÇÃO",
        "The unit ångström (Å) and the empty set Ø, 24° and πr² ≈ 9.",
        "Grid: │ 51 │ 98 │",
        "© 2031 £¥¢ &amp; &lt;b&gt;",
        "ﬁll ２８ ½",
        "Âmbito, Ângulo, À Nîmes",
        "naïve façade Übung № 5",
        "satisﬁes ﬁll ﬁnd ﬁve ﬂow",
        "© 2031 Nº 5 £¥¢ ½ 1ª",
    ],
)
def test_clean_text_stays(sentence):
    assert er.repair(sentence) is None


@pytest.mark.parametrize(
    ("sentence", "right", "wrong"),
    [
        (SENTENCES[0], "cp1252", "mac_roman"),
        (SENTENCES[2], "cp1252", "cp437"),
        (SENTENCES[4], "cp1251", "cp1252"),
        (SENTENCES[4], "koi8-r", "cp1251"),
        (SENTENCES[4], "cp866", "cp1251"),
        (SENTENCES[5], "gb18030", "latin-1"),
    ],
)
def test_single_byte_confusions(sentence, right, wrong):
    found = er.repair((sentence * 2).encode(right, "ignore").decode(wrong))
    assert found is not None
    if right != "cp1252":
        assert found[0] == sentence * 2


@pytest.mark.parametrize(("garbled", "right"), [("The na∩ve way", "The naïve way"), ("Una se±ora dijo", "Una señora dijo"), ("Ein fⁿr alle", "Ein für alle")])
def test_one_garbled_word_is_enough(garbled, right):
    assert er.repair(garbled)[0] == right


@pytest.mark.parametrize("around", ["因为每排有个硬币所以乘以小明今天去学校看书他们都很高兴，我们一起来做这道题目。" * 2, "これは数学のテストです。" * 5, "пустьмельникхранитпуговиц"])
@pytest.mark.parametrize("word", ["José", "für", "señor"])
@pytest.mark.parametrize("taken", ["cp1252", "cp437", "cp1251"])
def test_clean_rest_does_not_outvote_a_garbled_run(around, word, taken):
    assert er.repair(around + word.encode().decode(taken) + around)[0] == around + word + around
    assert er.repair(around + word + around) is None


def test_search_goes_on_to_the_cheapest_text(monkeypatch):
    start = "ÃÃÃÃ"
    ways = {start: [("a>utf-8", start + "©" * i) for i in range(1, 101)], start + "©" * 100: [("b>utf-8", "plain")]}
    monkeypatch.setattr(er, "_edges", lambda text: iter(ways.get(text, [])))
    assert er.search(start)[:2] == ("plain", ["a>utf-8", "b>utf-8"])


def test_lost_characters_are_flagged(spark):
    rows = spark.createDataFrame(
        [(1, "La quantit� d�pend", 0), (2, None, 0), (3, "", 0), (4, "ok", 0), (5, "fÃ¼r " * 50_000, 0), (6, "FÃ¼r", 0)],
        "doc_id long, text string, complete int",
    )
    got = {r.doc_id: r for r in er.garbled_texts(rows).collect()}
    assert set(got) == {1, 5, 6}
    assert not got[1].complete and got[6].restored == "Für" and got[5].restored == "für " * 50_000
    assert er.garbled_texts(rows.where("false")).count() == 0


CLEAN = """Price £5–£10 or §2–§3, 7°–9°, ±4×2; x+ABC-y and 2x+347-1, a+b-c, C++-like, =E2, 50%-60% off, a=BC=DE.
https://example.org/caf%C3%A9?x=%E2%82%AC and www.example.org/%C3%A9 stay as they are. \\u00e9 alone is no wrong decoding.
Die Größe „A–B“ über Übung № 5, die Straße »Süd« und ›Nord‹; naïve Façade, Ångström Å, 24°, πr² ≈ 9.
Élève, déjà vu : « À Nîmes », Nº 4, l’œuvre, 1ª y 2º, ¿qué número? ¡Sí! LECCIÓN Nº 7 · AÑO ÚNICO · £¥¢.
Não há fração: “ÂNGULOS E PÃES”. Задача 5: пусть мельник хранит «А» и «Б», линия А—Б, угол 47°, пункт 3–4. Ответ: я и ты.
因为每排有18个硬币，所以乘以77。“每排”有５個。これは数学のテストです。수학 시험입니다. Το πι είναι π. Cena: 5 zł, žluťoučký kůň, őrült tükör."""


@pytest.mark.parametrize("line", CLEAN.split("\n"))
def test_clean_lines_of_many_languages_stay(line):
    assert er.repair(line) is None


@pytest.mark.parametrize(
    ("garbled", "right"),
    [
        ("Ein F+APw-r und ein Kn+APY-pfe +IBw-so+IB0- a +- b", "Ein Für und ein Knöpfe “so” a + b"),
        ("el per+AO0-metro est+AOE entre 5", "el perímetro está entre 5"),
        (r"caf\u00c3\u00a9 and caf\xc3\xa9, caf=C3=A9 or caf%C3%A9.", "café and café, café or café."),
        ("藩齬溫2649跺茞啟ㄛ珨僕溫84齬﹝", "每排放2649个硬币，一共放84排。"),
        ("with 901 Г— 32 of 601В° it", "with 901 × 32 of 601° it"),
        ("Der Schüler prüft die Größe.".encode().decode("iso8859-2"), "Der Schüler prüft die Größe."),
        ("žluťoučký kůň příliš".encode().decode("iso8859-2"), "žluťoučký kůň příliš"),
    ],
)
def test_other_encodings_and_escapes(garbled, right):
    found = er.repair(garbled)
    assert found is not None and found[0] == right and found[1]


def test_two_swaps_one_after_another():
    twice = (SENTENCES[4] * 2).encode("cp1251").decode("cp866").encode("cp866").decode("koi8-r")
    assert er.repair(twice) is not None


def test_lost_is_the_last_step_of_the_search():
    assert er.search("d\ufffdpend")[1] == ["lost"]
    assert er.search("fÃ¼r\x80")[1][-1] == "lost"
    assert er.repair("d\ufffdpend")[3] == "lost"


@pytest.mark.parametrize("taken", ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "iso8859-2", "cp866", "koi8-r"])
def test_clean_documents_come_back_exactly(taken):
    """Held-out measure: documents without a fault, garbled here; at least 99 of 100 are restored to the letter.

    97 for ISO-8859-2, under which the two characters of a u umlaut are those of a sharp s under Windows-1250.
    """
    import os

    folder = os.environ.get("MILLRACE_TEST_DATA", "/root/testdata/sf0.001")
    if not os.path.exists(f"{folder}/documents.parquet"):
        pytest.skip("no driver tables")
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(f"{folder}/documents.parquet", columns=["text"])["text"].to_pylist() if t and not t.isascii() and er.repair(t) is None]
    tried = exact = 0
    for text in texts:
        try:
            garbled = text.encode().decode(taken)
        except UnicodeDecodeError:
            continue
        tried += 1
        found = er.repair(garbled)
        exact += found is not None and found[0] == text
    assert exact >= (0.97 if taken == "iso8859-2" else 0.99) * tried


VOCABULARIES = [("byte_bpe_50k.json", None), ("piece_bpe_32k.model", None), ("byte_bpe_50k.tiktoken", "PATTERN"), ("word_bpe_49k.json", None)]


@pytest.mark.parametrize(("name", "pattern"), VOCABULARIES)
def test_other_vocabularies(spark, name, pattern):
    public = pytest.importorskip("public_tokenizers")
    path = public.path(name)
    size = packing.vocabulary_tokens("text", path, getattr(public, pattern) if pattern else None)
    rows = spark.createDataFrame([(1, "one two three " * 30), (2, None), (3, ""), (4, "hello")], "doc_id long, text string")
    sizes = {r.doc_id: r.n for r in rows.select("doc_id", size.alias("n")).collect()}
    assert sizes[2] is None and sizes[1] >= 90 and sizes[3] == 0
    packed_rows = packing.pack_texts(rows, 50, size=size).collect()
    assert sum(r.piece_size for r in packed_rows if r.doc_id == 1) == sizes[1]
    assert {r.doc_id for r in packed_rows} == {1, 4}
