import pytest

from loomgrid.llm.textstats import judge, text_statistics

PROSE = "The wet lab repeated the growth assay because the first run gave a noisy shift. It is not clear why the line stayed flat, but the trend points to evaporation."
CASES = {
    "prose": [
        PROSE, PROSE.upper(), PROSE.replace(" ", "\n", 3), "Der Verlust von A bremst die Linie um etwa 64 Prozent, während B kaum eine Rolle spielt.",
        "\n".join(PROSE[i : i + 60] for i in range(0, len(PROSE), 60)), PROSE * 1 + "\n- Dry ice\n- Filter tips\n" + PROSE.replace("line", "culture") + " We then left it at that. Nothing else was changed.",
        "<p>" + PROSE.replace("growth", "<b>growth</b>") + "</p>",
    ],
    "list": [
        "- Filter tips\n- Dry ice\n- Wash twice\n- Spare rotor", "1. Filter tips\n2. Dry ice\n3. Wash twice", "#1 Dry ice\n#2 Spin 14 min\n#3 Ice bucket", "Line: Dry ice\nLot: Plate sealer\nStatus: Open\nGene: Wash twice",
        "Filter tips\nDry ice\nMissing age\nSpare rotor\nWaiting for the curator", "Dry ice, Filter tips, Spare rotor, Wash twice, Ice bucket", "Dry ice / Lung panel, 66 lines / Spin 13 min / Plate sealer",
        PROSE.split(".")[0] + ".\n* Dry ice\n* Filter tips\n* Spare rotor\n* Wash twice\n* Ice bucket",
    ],
    "table": [
        "a\tb\tc\n1\t2\t3\n4\t\t6\n7\t8\t9", "gene;sd;lot\nX1;2.0;3\nX2;;4\nX3;1.5;6", "n,lot,qc\n1,2,ok\n3,4,NA\n5,,ok", "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |",
        "well      gene      lot\n1         X1        22\n2         X2        33\n3                   44", "+--------------------------+------------------------+\n|            a             |           b            |\n+--------------------------+------------------------+\n|            1             |           2            |\n+--------------------------+------------------------+",
        "<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table>",
    ],
    "junk": [
        None, "", "   \n\t ", "​", "....................", "loading... " * 60, "ok." * 200, PROSE.split(".")[0].join(["", ". "]) * 30, "aGVsbG8gd29ybGQ" * 20,
        "00000000  d5 c0 66 63 38 d6 f3 34\n00000010  c3 5a 61 d5 6a 82 1f 8f\n00000020  a0 a9 63 01 e4 b3 75 e8", "ehT rdecor fo eth aws snyio ni iksn ,nisel tye it isdhaenv enoc saw tpek ,ni",
        "â¿¿°¡¢œ¼ââÐÐ �¿»Ð¡©ñ¾©Ãœ€€¡Ãïñ", "u g r o u p   s k e   h t h e r   N  K Q 4  a  d", "==*#:<+?.++$ .*># |/$-&#??.$$#$|=$%",
    ],
}


@pytest.fixture(scope="module")
def judged(spark):
    texts = [t for kind in CASES.values() for t in kind]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in judge(text_statistics(df)).collect()}


@pytest.mark.parametrize("kind", CASES)
def test_kinds(judged, kind):
    first = sum(len(CASES[k]) for k in list(CASES)[: list(CASES).index(kind)])
    wrong = [(CASES[kind][i], judged[first + i]["kind"], judged[first + i]["reasons"]) for i in range(len(CASES[kind])) if judged[first + i]["kind"] != kind]
    assert wrong == []


def test_reasons_are_recorded(judged):
    assert all(bool(r["reasons"]) == (r["kind"] != "prose") for r in judged.values())


def test_figures(spark):
    df = spark.createDataFrame([(1, "The cat, in a hat.\n- no end\n\nAll done!")], "doc_id long, text string")
    s = text_statistics(df).first()["stats"]
    assert (s["n_words"], s["n_lines"]) == (9, 3)
    assert abs(s["mean_word_length"] - 24 / 9) < 1e-9
    assert abs(s["symbol_share"] - 4 / 28) < 1e-9
    assert abs(s["punctuated_share"] - 2 / 3) < 1e-9
    assert abs(s["bullet_share"] - 1 / 3) < 1e-9
    assert abs(s["common_share"] - 6 / 9) < 1e-9


def test_long_texts_and_other_columns(spark):
    df = spark.createDataFrame([(1, PROSE * 2000, "x", 1)], "doc_id long, text string, kind2 string, n_words int")
    r = text_statistics(df).first()
    assert r["stats"]["n_words"] > 50000
    assert r["n_words"] == 1


def test_empty_table(spark):
    assert judge(text_statistics(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_repetition_is_told_at_every_length(spark):
    unit = "the plate was read twice before lunch and then put away again "
    texts = {n: unit * n for n in (1, 2, 16, 20, 400)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["kind"], r["reasons"]) for r in judge(text_statistics(df)).collect()}
    assert got[1][0] == got[2][0] == "prose"
    assert all(got[n][0] == "junk" and "repeated_runs" in got[n][1] for n in (16, 20, 400))


def test_published_rules_are_recorded(spark):
    texts = [(1, "- one\n- two\n- three"), (2, "# # # # words"), (3, None), (4, "The culture of the line that we have grew well. " * 3 + "It was split on Monday, and the rest of it went to the freezer with the others. " * 2)]
    got = {r["doc_id"]: r["failures"].split(",") for r in judge(text_statistics(spark.createDataFrame(texts, "doc_id long, text string"))).collect()}
    assert {"gopher_words", "gopher_bullets", "fineweb_punctuation"} <= set(got[1])
    assert "gopher_symbols" in got[2] and "gopher_letters" in got[2]
    assert {"gopher_words", "gopher_stop_words", "c4_sentences"} <= set(got[3])
    assert got[4] == [""]
