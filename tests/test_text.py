from pyspark.sql import functions as F

from lexiquarry.functions import similarity as S
from lexiquarry.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c"))).first()[0]


def test_normalizers(spark):
    assert one(spark, " Срок \n  ЁЛКИ ", T.normalize) == "срок ёлки"
    assert one(spark, None, T.normalize) == ""
    assert one(spark, "Ёж", T.normalize_for_deadlines) == "еж"
    assert one(spark, "Паспорт, (копия)", T.normalize_for_documents) == "паспорт копия"
    assert one(spark, "a b  \t c \n d ", T.clean_cell) == "a b c\nd"
    assert one(spark, "Приказ № 12-п", T.token_key) == "приказ_n_12_п"
    assert one(spark, "a\r\nb\n\n\n\nc\td", T.normalize_document) == "a\nb\n\nc d"
    assert one(spark, " Case  Kept ", T.collapse) == "Case Kept"


def test_shorten_and_sentence(spark):
    assert one(spark, "abcdefghij", lambda c: T.shorten(c, 8)) == "abcde..."
    assert one(spark, "abcdefgh", lambda c: T.shorten(c, 8)) == "abcdefgh"
    assert one(spark, "abcdefghij", lambda c: T.shorten(c, 8, room_for_dots=False)) == "abcdefgh..."
    assert one(spark, "x  y", T.sentence) == "x y."
    assert one(spark, "done!", T.sentence) == "done!"
    assert one(spark, "  ", T.sentence) is None


def test_language_and_ratio(spark):
    assert one(spark, "Привет hi", T.language) == "ru"
    assert one(spark, "hello", T.language) == "en"
    assert one(spark, "123", T.language) is None
    assert one(spark, "ABc1", T.upper_ratio) == 2 / 3
    assert one(spark, "12", T.upper_ratio) == 0.0


def test_extraction(spark):
    assert str(one(spark, "от 01.02.2024 г.", T.found_date)) == "2024-02-01 00:00:00"
    assert one(spark, "от 99.99.2024", T.found_date) is None
    assert one(spark, "приказ № 45-п", T.found_number) == "45-п"
    assert one(spark, "Приложение № 2", lambda c: T.numbered(c, "приложение")) == "2"
    assert one(spark, "3.1. Текст", T.clause_number) == "3.1"
    assert one(spark, "b then a", lambda c: T.first_match(c, ["a", "b"])) == "a"


def test_terms(spark):
    assert one(spark, 'Какие "документы" для (ЕДВ) и на a', lambda c: T.terms(c, ("какие", "для", "и", "на"), ("едв",))) == ["документы", "едв"]


def test_callbacks(spark):
    assert tuple(one(spark, "fb:a1:5", T.callback)) == ("vote", "a1", 5)
    assert tuple(one(spark, "fb_comment:a1", T.callback)) == ("comment", "a1", None)
    for bad in ("fb:a1:6", "fb:a1", "fb::3", "x:a1:3", "", None, "fb:a1:x"):
        assert one(spark, bad, T.callback) is None


def test_similarity(spark):
    f = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(S.text_similarity(F.col("a"), F.col("b"))).first()[0]
    assert f("a b c", "a b c") == 1.0
    assert f("a b", "a b c") == 0.97
    assert f("a b c d e", "e d c b a") == 0.95
    assert f("", "x") == 0.0
    assert f("a b", "c d") == 0.0
    assert f("a b c d", "d c x y") == f("d c x y", "a b c d")


def test_canonical_hash(spark):
    h = lambda **k: spark.range(1).select(T.canonical_hash(**{x: F.lit(v) for x, v in k.items()})).first()[0]
    assert h(b=1, a=None) == h(a=None, b=1) != h(a=1, b=None)
