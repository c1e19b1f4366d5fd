import numpy as np
from pyspark.sql import functions as F

from waymark.operators.tracker import Index, Settings, Tracker, follow, smooth

ONE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu".split()
TWO = "some quite other words about rivers and hills under a wide sky".split()
INDEX = Index(["one", "two"], [[(1, " ".join(ONE[:6])), (2, " ".join(ONE[6:]))], [(1, " ".join(TWO))]])


def _recite(words):
    return [(float(i + 1), " ".join(words[max(0, i - 4) : i + 1])) for i in range(len(words))]


def test_finds_text_line_and_order():
    tracker = Tracker(INDEX)
    shown = [tracker.update(t, x) for t, x in _recite(ONE)]
    assert shown[-1]["text"] == "one" and shown[-1]["line"] == 2
    lines = [s["line"] for s in shown if s["line"]]
    assert lines == sorted(lines)


def test_unknown_words_show_nothing():
    tracker = Tracker(INDEX)
    strange = ["qqqq", "xxxxyy", "wwvvqq", "zzzzxx", "jjqqjj", "kkxxqq", "vvzzjj", "qxqxqx"]
    assert [tracker.update(t, x)["text"] for t, x in _recite(strange)][-1] is None


def test_silence_does_not_move():
    tracker = Tracker(INDEX)
    for t, x in _recite(ONE[:6]):
        before = tracker.update(t, x)
    assert tracker.update(20.0, "")["word"] == before["word"]


def test_batch_equals_plain(spark):
    rows = [("r1", t, x) for t, x in _recite(ONE)] + [("r2", t, x) for t, x in _recite(TWO)]
    got = follow(spark.createDataFrame(rows, "rec string, t double, fragment string").orderBy(F.rand(1)), INDEX).collect()
    tracker = Tracker(INDEX)
    want = {t: tracker.update(t, x)["word"] for t, x in _recite(ONE)}
    assert {r.t: r.word for r in got if r.rec == "r1"} == want
    assert {r.text for r in got if r.rec == "r2" and r.t > 6} == {"two"}


def test_smoother_sees_the_future():
    costs = np.stack([INDEX.costs(x) for _, x in _recite(ONE)])
    path = smooth(INDEX, costs.astype(float), 1.0, Settings(kappa=1.0))
    assert path[-1] == len(ONE) - 1 and (np.diff(path) >= 0).all()


def test_costs_of_many_windows_in_one_walk():
    fragments = ["", "alpha beta", "gamma", "x" * 80, " ".join(ONE)[:64], "some quite odd words", "ü"]
    for one, f in zip(INDEX.costs_of(fragments), fragments, strict=True):
        assert one.tolist() == INDEX.costs(f).tolist()


def test_settings_by_name():
    got = Settings.parse(["kappa=0.2", "back_words=4", "speeds=1,2.5"])
    assert (got.kappa, got.back_words, got.speeds, got.max_speed) == (0.2, 4, (1.0, 2.5), Settings().max_speed)
