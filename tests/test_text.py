"""T1-T12 against expected rows, worked out by hand from the rules."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlance.functions import predicates as P
from parlance.functions import text as T

#: text, after normaliser B, after normaliser C
CASES = [
    (None, "", ""),
    ("", "", ""),
    ("   ", "", ""),
    (" x ", "x", "x"),
    ("a\u001cb", "a b", "a b"),
    ("x\u00b2\u00bdy", "x\u00b2\u00bdy", "x y"),
    ("ok \U0001f642 fine", "ok fine", "ok fine"),
    ("caf\u00e9 \u00f1", "cafe n", "caf\u00e9"),
    ("cafe\u0301 x", "cafe x", "cafe x"),
    ("\u00c0\u00c8\u00c9\u00cc\u00cd\u00d2\u00d3\u00d9\u00da\u00dc\u00c7\u00d1", "AEEIIOOUUUCN",
     "\u00e0\u00e8\u00e9\u00ec\u00ed\u00f2\u00f3\u00f9\u00fa"),
    ("12 agosto 2024", "12 agosto 2024", "agosto"),
    ("\"quoted\" and 'single'", "\"quoted\" and 'single'", "quoted and 'single'"),
    ("dott. Dott. DOTT.", "dottor Dottor DOTT.", "dottore dottore dottore"),
    ("dr. Dr. DR.", "dottor Dottor DR.", "dottore dottore dottore"),
    ("prof. Prof.", "professor Professor", "professore professore"),
    ("ing. Ing.", "ingegner Ingegner", "ingegnere ingegnere"),
    ("sig. SIG. sig.ra", "signor SIG. signorra", "signore signore signorera"),
    ("avv. Avv.", "avvocato Avvocato", "avvocato avvocato"),
    ("on. On.", "onorevole Onorevole", "onorevole onorevole"),
    ("vs. etc. Vs.", "vs. etc. Vs.", "versus eccetera versus"),
    ("the nation. the meeting.", "the nationorevole the meetingegner", "the nationorevole the meetingegnere"),
    ("tab\there\nnewline\r\x0b\x0c end", "tab here newline end", "tab here newline end"),
    ("\u00a0\u2003\u3000a\u0085b", "a b", "a b"),
    ("under_score __init__", "under_score __init__", "under score init"),
    ("Stra\u00dfe \u00c4rger na\u00efve", "Stra\u00dfe \u00c4rger na\u00efve", "stra e rger na ve"),
    ("\u03a3\u039f\u03a6 a", "\u03a3\u039f\u03a6 a", "a"),
    ("a@b#c;d:e-f", "a b c;d:e-f", "a b c;d:e-f"),
]


def test_normalizers(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "id int, text string")
    for r in df.select("id", T.normalize_text_b("text").alias("b"), T.normalize_text_c("text").alias("c")).collect():
        assert (r["b"], r["c"]) == CASES[r["id"]][1:], CASES[r["id"]][0]


def test_hand_checked_values(spark):
    df = spark.createDataFrame([("sig.ra Rossi",), ("on.",), ("Dott. Bianchi",), ("DOTT. X",), (None,)], "t string")
    got = [r[0] for r in df.select(T.normalize_text_b("t")).collect()]
    assert got == ["signorra Rossi", "onorevole", "Dottor Bianchi", "DOTT. X", ""]
    got_c = [r[0] for r in df.select(T.normalize_text_c("t")).collect()]
    assert got_c == ["signorera rossi", "onorevole", "dottore bianchi", "dottore x", ""]


def test_decomposed_accent_is_not_folded(spark):
    df = spark.createDataFrame([("café",)], "t string")
    assert df.select(T.normalize_text_b("t")).first()[0] == "cafe"  # mark -> space -> trimmed


def test_fold_vowels_only_lower_eight(spark):
    df = spark.createDataFrame([("àèíìòóùú é À",)], "t string")
    assert df.select(T.fold_vowels("t")).first()[0] == "aeiioouu é À"


def test_special_ratio_boundary(spark):
    # 10 chars: 3 specials -> 0.3 passes, 4 -> 0.4 fails; "_" counts as special
    rows = [("abcdefg!!!",), ("abcdef!!!!",), ("abcdefg__.",), ("",)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(T.special_ratio("t").alias("r"), P.special_at_most("t", 0.3).alias("ok")).collect()
    assert [g["ok"] for g in got] == [True, False, True, False]
    assert [g["r"] for g in got[:3]] == [0.3, 0.4, 0.3]
    assert got[3]["r"] is None


def test_length_in_code_points(spark):
    df = spark.createDataFrame([("🙂" * 10,), ("é" * 9,)], "t string")
    assert [r[0] for r in df.select(P.text_len_between("t", 10, 300)).collect()] == [True, False]


_alphabet = st.sampled_from(list("abcXYZ àèéìíîòóùúüçñÀÉÇ.,!?;:-'\"_²½ \t\n \u001c #@$%🙂0123")
                            + ["dott.", "sig.ra", "on.", "etc.", "Dr.", "é"])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(_alphabet, max_size=25).map("".join), min_size=1, max_size=40))
def test_property_normalizers_are_idempotent_and_clean(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", T.normalize_text_b("t").alias("b"), T.normalize_text_c("t").alias("c"))
    out = out.select("t", "b", "c", T.normalize_text_b("b").alias("bb"), T.normalize_text_c("c").alias("cc"))
    for r in out.collect():
        assert r["bb"] == r["b"] and r["cc"] == r["c"]
        for text in (r["b"], r["c"]):
            assert text == " ".join(text.split()) and not set(text) & set("@#$%")
        assert r["c"] == r["c"].lower()


def test_not_blank_knows_all_white_space(spark):
    rows = [("\n" * 12,), ("\u00a0\u2003\u001c ",), (" x ",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(P.not_blank("t")).collect()]
    assert got == [False, False, True, False, None]


STRICT = [("sig.ra Rossi", "signora Rossi"), ("la ragion. fu", "la ragion. fu"), ("ing.on. Dr.", "ingegneronorevole Dottor"),
          ("Sig.ra e sig.", "Signora e signor"), ("x_on. on.", "x_on. onorevole"), ("7on. é on.", "7on. é onorevole"),
          ("SIG. avv.prof.", "SIG. avvocatoprofessor"), ("", ""), (None, None), ("on.", "onorevole"), ("sig..", "signor.")]


def test_strict_abbreviations_begin_words(spark):
    import re

    from parlance.functions import text as T

    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(STRICT)], "id int, text string")
    got = {r["id"]: r["out"] for r in df.select("id", T.expand_abbr_b("text", strict=True).alias("out")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(STRICT)}
    # the same by one substitution with a table
    table = dict(T.ABBREVIATIONS_C)
    rule = re.compile(r"(?<!\w)(" + "|".join(sorted(map(re.escape, table), key=len, reverse=True)) + ")")
    texts = [" ".join(t for t, _ in STRICT if t).lower(), "etc.vs. etc.,vs.x", "dott.dr.sig.ra.sig.raffaele"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(T.expand_abbr_c("text", strict=True)).collect()]
    assert got == [rule.sub(lambda m: table[m.group()], t) for t in texts]
