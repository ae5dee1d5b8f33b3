import pytest
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.functions.json_stream import partial_value


def value(spark, column, **fields):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in fields.items())).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "line, label",
    [("LIVRE | : Du droit commercial", "Livre I - Du droit commercial"), ("titre ii", "Titre II"), ("Chapitre préliminaire - Définitions", "Chapitre Préliminaire - Définitions"), ("SECTION 4 - 2 . Suite", "Section 4 - 2 - Suite")],
)
def test_level_labels(spark, line, label):
    level = value(spark, T.level_of(F.col("x")), x=line)
    assert value(spark, T.level_label(F.col("x"), level), x=line) == label


@pytest.mark.parametrize("line", ["à la partie la plus diligente", "PARTIE LEGISLATIVE", "Partie auprès duquel elle est"])
def test_sentences_are_no_levels(spark, line):
    assert value(spark, T.level_of(F.col("x")), x=line) is None


def test_cleaning_is_idempotent(spark):
    x = "Art.7.\u2010\u00a0a\u202fb \uf0b7c\uf0fe"
    once = value(spark, T.clean_line(F.col("x")), x=x)
    assert once == "Art.7.- a b \u2022c "
    assert value(spark, T.clean_line(F.col("x")), x=once) == once


@pytest.mark.parametrize(
    "rate, text, stated",
    [("17,5", "taux de 17,5 %", True), ("17,5", "17.5 pour  cent", True), ("17,5", "117,5 %", False), ("33", "33,5 %", False), ("33", "33 %", True), ("19,25", "19,255 %", False)],
)
def test_rates_have_borders(spark, rate, text, stated):
    assert value(spark, F.col("x").rlike(T.rate_pattern(rate)), x=text) is stated


def test_amounts_in_groups(spark):
    assert value(spark, F.col("x").rlike(T.amount_pattern(2000000)), x="jusqu'à 2 000.000 francs")


@pytest.mark.parametrize("line, noise", [("=~ ^ # a", True), ("montant = total général", False), ("1 234", False)])
def test_noise_lines(spark, line, noise):
    assert value(spark, T.is_noise_line(F.col("x")), x=line) is noise


def test_repetition_keys(spark):
    assert value(spark, T.repetition_key(F.col("x")), x="  Article 12 ") == "Article 12"
    assert value(spark, T.repetition_key(F.col("x")), x="http://example.org/act.html page 2 / 122") == "http://example.org/act.html page /"


@pytest.mark.parametrize("raw, name", [("  Jean   Pierre ", "Jean Pierre"), ("O’Neil", "O’Neil"), ("x1", None), ("", None), ("a\nb", "a b"), ("x" * 41, None)])
def test_first_names(spark, raw, name):
    assert value(spark, T.clean_first_name(F.col("x")), x=raw) == name


@pytest.mark.parametrize("raw, phone", [("6 99 00 00 00", "237699000000"), ("+237699000000", "237699000000"), ("00237699000000", "237699000000"), ("12345", None)])
def test_phone_numbers(spark, raw, phone):
    assert value(spark, T.phone_number(F.col("x")), x=raw) == phone


def test_partial_answers_only_grow():
    raw = '{"reponse": "Il dit \\"oui\\" et \\u00e9crit\\n\\\\fin", "x": 1}'
    shown = [partial_value(raw[:i]) for i in range(len(raw) + 1)]
    assert all(b.startswith(a) for a, b in zip(shown, shown[1:]))
    assert shown[-1] == 'Il dit "oui" et écrit\n\\fin'
    assert partial_value('{"autre": 1') == partial_value(None) == partial_value("]]") == ""


def test_surrogate_pairs_in_partial_json():
    from lexforge.functions.json_stream import partial_value

    whole = '{"reponse": "a\\ud83d\\ude00b \\ud83d end \\u00e9"}'
    shown = [partial_value(whole[:n]) for n in range(len(whole) + 1)]
    assert shown[-1] == "a\U0001f600b \ufffd end é"
    assert all(b.startswith(a) for a, b in zip(shown, shown[1:])) and all(x.encode() is not None for x in shown)
