from pyspark.sql import functions as F

from waymark.functions import text as X


def _one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()[0]


def test_normalize_folds_marks_and_forms(spark):
    assert _one(spark, X.normalize, "اَللّٰهُمَّ  إِنِّي") == "اللهم اني"
    assert _one(spark, X.normalize, "ﷲ، الرحمة") == "الله الرحمه"
    assert _one(spark, X.normalize, "") == "" and _one(spark, X.normalize, None) is None


def test_encode(spark):
    assert _one(spark, X.encode, "ءا ب") == [1, 7, 8]


def test_ngrams_of_short_strings_are_empty(spark):
    assert _one(spark, lambda c: X.ngrams(c, 5), "abcd") == []
    assert sorted(_one(spark, lambda c: X.ngrams(c, 2), "abab")) == ["ab", "ba"]


def test_script(spark):
    assert [_one(spark, X.script, s) for s in ("hello there", "السلام عليكم", "ab", None)] == ["latin", "arabic", None, None]


def test_agent_order(spark):
    edge = "Mozilla/5.0 (Windows NT 10.0) AppleWebKit Chrome/120.0 Safari/537 Edg/121.0"
    assert _one(spark, X.short_agent, edge) == "Windows Edge 121"
    assert _one(spark, X.short_agent, "Mozilla (iPhone; CPU like Mac OS X) Version/18.1 Safari") == "iPhone Safari 18"
    assert _one(spark, X.short_agent, "") == "(no browser named)"


def test_same_word(spark):
    rows = spark.createDataFrame([("word", "wort"), ("abc", "abd"), ("abc", "abc"), ("words", "wrds")], "a string, b string")
    assert [r[0] for r in rows.select(X.same_word(F.col("a"), F.col("b"))).collect()] == [True, False, True, True]


def test_loops_are_hallucinations(spark):
    assert _one(spark, lambda c: X.hallucinated(c, ["thanks"], ["subscribe"]), "ab cd " * 30)
    assert _one(spark, lambda c: X.hallucinated(c, ["thanks"], ["subscribe"]), " thanks. ")
    assert not _one(spark, lambda c: X.hallucinated(c, ["thanks"], ["subscribe"]), "an ordinary short line of speech")


def test_digits_are_no_marks(spark):
    assert _one(spark, X.normalize, "ابجد١ابجد") == "ابجد ابجد"
    assert _one(spark, X.bare, "أب جدٰة ۖ") == "اب جده"


def test_passage_keys(spark):
    keys = lambda text: _one(spark, lambda c: X.passage_keys(X.words(c)), text)
    assert keys("قال و الله") == ["قال", "والله"]
    assert keys("شي ء و ء") == ["شيء", "وء"]
    assert keys("ء و و كل و") == ["ء", "وو", "كل", "و"] and keys("") == []
