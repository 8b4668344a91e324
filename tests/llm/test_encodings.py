import random

from filmloom.llm.codecs import SINGLE_BYTE, UTF8, garble, undo_single
from filmloom.llm.encodings import WrongEncodings, explain, pieces

SENTENCES = [
    "Le scénario hésite près de la forêt gelée.",
    "Où est passé l’élève ? Nul ne le sait.",
    "À la fin, la châtelaine brûle le vélo volé.",
    "Für die Übersetzung brauchte man schöne Wörter.",
    "Książka była dłuższa, ale wędka śmieszna.",
    "Музыка звучит слишком громко, но сцена запоминается.",
    "Старый моряк возвращается домой и находит скрипку.",
    "Plain words only.",
]


def test_codecs():
    for codec in SINGLE_BYTE:
        assert undo_single(garble("abc", codec, "latin_1"), codec, "latin_1") == "abc"
    assert garble("é”", UTF8, "cp1252") == "Ã©â€\x9d" and garble("Ж", "cp1252", "latin_1") is None
    assert undo_single(garble("Музыка", "cp1251", "cp1252"), "cp1251", "cp1252") == "Музыка"


def test_explain():
    assert (UTF8, "cp1252") in explain("schÃ¶ner", "schöner")
    assert ("cp1250", "cp1252") in explain("œwietny m³ynarz", "świetny młynarz")
    assert explain("schoner", "schöner") == [] and explain("fête", "fäte") != [("utf_8", "cp1252")]
    assert explain("tr�s", "très") == []


def test_found_and_restored(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.sample(SENTENCES, 4)) for _ in range(80)]
    wrong = {}
    for i, (source, read) in enumerate([(UTF8, "cp1252"), (UTF8, "mac_roman"), (UTF8, "cp1251"), ("cp1251", "cp1252"), ("cp1250", "cp1252"), (UTF8, "cp437")] * 3):
        parts = SENTENCES[:]
        rng.shuffle(parts)
        garbled = [g if (g := garble(p, source, read)) is not None else p for p in parts]
        if garbled != parts:
            wrong[1000 + i] = (" ".join(garbled), " ".join(parts))
    twice = garble(garble(SENTENCES[0], UTF8, "cp1252"), UTF8, "cp1252")
    wrong[2000] = (twice, SENTENCES[0])
    wrong[2001] = (SENTENCES[0].replace("é", "�"), SENTENCES[0])
    traps = ["Credits list Ðorvald Ýmirsson, Âna Ñíguez and Åse Ødegård-Lim.", "ATENÇÃO: SESSÃO ÚNICA EM SÃO BRISA.", "caf&eacute; &amp; bar", "ÂGE CONSEILLÉ : 3 ANS", "", None, "£5 ½ © 20°"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(500 + i, t, "x") for i, t in enumerate(traps)]
    rows += [(i, g, "x") for i, (g, _) in wrong.items()] + [(2001, wrong[2001][0], "x"), (None, wrong[2000][0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    cases = WrongEncodings(df)
    assert {r["doc"] for r in cases.found().collect()} == set(wrong)
    restored = {r["doc"]: (r["restored"], r["complete"]) for r in cases.restored().collect()}
    assert restored == {i: (clean, True) for i, (_, clean) in wrong.items()}
    empty = WrongEncodings(df.limit(0))
    assert empty.found().count() == empty.restored().count() == 0


def test_copies_do_not_outweigh(spark):
    """A third of all rows are copies of one garbled text."""
    rng = random.Random(10)
    rows = [(i, " ".join(rng.sample(SENTENCES, 4))) for i in range(60)]
    text = garble(" ".join(SENTENCES[5:7]), "cp1251", "cp1252")
    rows += [(1000 + i, text) for i in range(40)] + [(2000, garble(SENTENCES[5], "cp1251", "cp1252"))]
    cases = WrongEncodings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc"] for r in cases.found().collect()} == {i for i, _ in rows if i >= 1000}
    assert {r["restored"] for r in cases.restored().collect()} == {" ".join(SENTENCES[5:7]), SENTENCES[5]}


def test_a_single_case_is_learned_from_words(spark):
    """No passage has a twin, but a word does."""
    rows = [(1, "La lumière est belle."), (2, "Cette lumiÃ¨re, enfin."), (3, "Une autre lumière encore."), (4, "Rien du tout.")]
    assert [r["doc"] for r in WrongEncodings(spark.createDataFrame(rows, "doc_id long, text string")).found().collect()] == [2]


def test_a_common_mistake_is_found(spark):
    """A third of all distinct texts, and more than half, come from a source read in a wrong encoding."""
    rng = random.Random(11)
    for stored, read, lines, clean, wrong in [("cp1251", "cp1252", SENTENCES[5:7], 40, 20), ("cp1250", "cp1252", SENTENCES[4:5], 40, 20), ("cp1251", "cp1252", SENTENCES[5:7], 20, 40), (UTF8, "cp1251", ["Музыка звучит слишком громко.", "Фильм 17 снят давно."], 40, 20)]:
        texts = [" ".join([*rng.sample(lines, len(lines)), f"Nr {i}."]) for i in range(clean + wrong)]
        rows = [(i, t if i < clean else garble(t, stored, read)) for i, t in enumerate(texts)]
        cases = WrongEncodings(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(r["doc"] for r in cases.found().collect()) == list(range(clean, clean + wrong))
        assert {r["doc"]: r["restored"] for r in cases.restored().collect()} == {i: texts[i] for i in range(clean, clean + wrong)}


def test_a_mistake_is_learned_from_equal_counts(spark):
    rows = [(1, SENTENCES[5]), (2, garble(SENTENCES[5], "cp1251", "cp1252"))] + [(10 + i, f"Музыка звучит слишком громко, но сцена запоминается, {i}.") for i in range(3)]
    assert [r["doc"] for r in WrongEncodings(spark.createDataFrame(rows, "doc_id long, text string")).found().collect()] == [2]


def test_punctuation_alone_is_found(spark):
    """English texts whose only characters beyond ASCII are quotes, dashes, an ellipsis and signs."""
    for read in ("latin_1", "mac_roman"):
        texts = [f"I don’t know the answer. She said “wait” – and left… It’s {i}, for 5 €, at the café." for i in range(12)]
        rows = [(i, t if i < 10 else garble(t, "cp1252", read)) for i, t in enumerate(texts)]
        rows += [(20, "È à l’école, où est le père ? C’était l’été, là."), (21, "El país, aquí, está allí; el señor y la señora."), (22, garble("You don’t.", "cp1252", read))]
        cases = WrongEncodings(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {r["doc"] for r in cases.found().collect()} == {10, 11, 22}
        assert {r["doc"]: r["restored"] for r in cases.restored().collect()} == {10: texts[10], 11: texts[11], 22: "You don’t."}


def test_two_bytes_a_character(spark):
    """Japanese and Korean passages with clean twins, read as Latin; second bytes may be ASCII signs."""
    for stored, read, lines in [("cp932", "latin_1", ["ソフトの表示は 12 件です", "日本語テキストとデータ 7 点"]), ("cp932", "cp1252", ["映画の終わりに 20 分の音楽"]), ("euc_kr", "cp1252", ["한국 영화 3 편을 보았다"])]:
        wrong = [garble(x, stored, read) for x in lines]
        rows = [(i, f"{x}\nNr {i}.") for i in range(5) for x in lines] + [(10 + i, f"{x}\nNr x.") for i, x in enumerate(wrong)]
        cases = WrongEncodings(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(r["doc"] for r in cases.found().collect()) == [10 + i for i in range(len(lines))]
        assert {r["doc"]: r["restored"] for r in cases.restored().collect()} == {10 + i: f"{x}\nNr x." for i, x in enumerate(lines)}


def test_a_mapping_without_a_name_is_learned(spark):
    """Hebrew stored in cp1255 and French in UTF-8 read as GBK: no pair of known encodings explains the twins."""
    hebrew = ["שלום לכל הצופים 12", "לכל הצופים שלום 7"]
    french = ["Le scénario hésite au théâtre 5", "Au théâtre un scénario hésite 8"]
    misread = {x: x.encode("cp1255").decode("latin_1") for x in hebrew} | {x: x.encode().decode("gbk") for x in french}
    assert pieces(misread[french[0]], french[0]) == [("芒", "â"), ("茅", "é")]
    rows = [(10 * k + i, f"{x}. Nr {i}.") for k, x in enumerate(misread) for i in range(4)]
    wrong = {100 + k: (f"{g}. Nr x.", f"{x}. Nr x.") for k, (x, g) in enumerate(misread.items())}
    wrong[200] = ("Un th茅芒tre et l'autre.", "Un théâtre et l'autre.")
    cases = WrongEncodings(spark.createDataFrame(rows + [(i, g) for i, (g, _) in wrong.items()], "doc_id long, text string"))
    assert {r["doc"] for r in cases.found().collect()} == set(wrong)
    assert {r["doc"]: r["restored"] for r in cases.restored().collect()} == {i: x for i, (_, x) in wrong.items()}


def test_natural_variants_teach_nothing():
    assert pieces("la pêche", "la péche") == [] and pieces("“oui”", "«oui»") == []
    assert pieces("a茅b茅", "aébè") == []  # one image for two characters


def test_garbled_seven_times(spark):
    text = SENTENCES[0]
    for _ in range(7):
        text = garble(text, UTF8, "cp1252")
    rows = [(1, SENTENCES[0]), (2, SENTENCES[0] + " Oui."), (3, garble(SENTENCES[0], UTF8, "cp1252")), (4, text)]
    cases = WrongEncodings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc"]: r["restored"] for r in cases.restored().collect()} == {3: SENTENCES[0], 4: SENTENCES[0]}
