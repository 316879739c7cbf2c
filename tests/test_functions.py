import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import words as W
from quarry.functions.embed import embedder, mean_pooled
from quarry.functions.register import register


def column(spark, values, f, schema="x string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [r[1] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_keys_in_both_languages(spark):
    values = ["Monument  Rocks", "--a--", None, "", "É x", "a" * 70, "x" * 30 + "--y"]
    for n in (31, 63):
        assert column(spark, values, lambda x: T.normalize_key(x, n)) == [T.normalize_key_py(v, n) for v in values]
    assert T.normalize_key_py("Monument  Rocks", 63) == "monument-rocks"
    assert T.normalize_key_py("x" * 30 + "--y", 31) == "x" * 30


def test_durations(spark):
    values = ["30", "30s", "5m", "2h", "3d", "", None, "x", "-4s", "5w", "0d", "5mm"]
    want = [30, 30, 300, 7200, 259200, 0, 0, 0, 0, 0, 0, 300]
    assert [T.duration_py(v) for v in values] == want
    assert column(spark, values, T.duration_seconds) == want


def test_unquote(spark):
    values = [r"a\sb", r"\\s", r"\t\n\r\f\v\0", r"x\q", "tail\\", "", None, "plain", r"\\\s"]
    assert column(spark, values, T.unquote) == [T.unquote_py(v) for v in values]
    assert T.unquote_py(r"\\s") == r"\s"


def test_url_path(spark):
    assert column(spark, ["a b/c*~é?", "-_."], T.url_path) == ["a%20b/c%2A~%C3%A9%3F", "-_."]


def test_times(spark):
    df = spark.createDataFrame([("x 2024-01-02T03:04:05 y\n", 7), ("a\n2024-01-02T03:04:05", 3600), ("none", 0)], "t string, m long")
    assert [r[0] for r in df.select(T.artifact_time(F.col("t"), F.col("m"))).collect()] == ["2024-01-02T03:04:05", "1970-01-01T01:00:00", ""]
    assert T.iso_plus("2024-01-01T00:00:00Z", 60) == "2024-01-01T00:01:00.000000Z"
    assert T.iso_plus("2024-01-01T00:00:00.000001Z", -1) == "2023-12-31T23:59:59.000001Z"


@pytest.mark.parametrize(("pattern", "text", "hit"), [
    ("^b", "a\nb", True), ("a$", "a\nb", True), ("a.b", "a\nb", False), ("a[^x]b", "a\nb", False), ("[[:digit:]]+", "a1", True),
    ("[[:digit:]]+", "digit:", False), ("x{2,3}$", "axx", True), (r"a\.b", "a.b", True), (r"a\.b", "axb", False), ("[]a]", "]", True),
    ("(ab|cd)e", "cde", True), ("^$", "", True), ("^$", "a\n", True), ("a$", "a\r", False), ("a.b", "a\rb", True), ("^b", "a\u2028b", False), ("[a-c-]", "-", True), ("[^[:space:]]", " \n", False),
])
def test_posix_patterns(spark, pattern, text, hit):
    assert spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(T.ere(pattern))).first()[0] is hit


@pytest.mark.parametrize("pattern", [r"\d", "a(?=b)", "a*?", "(", ")", "[a", "*a", "[[:nope:]]", "a\\", "{2}", "[b-a]", "a++"])
def test_other_dialects_are_refused(pattern):
    with pytest.raises(T.BadPattern):
        T.ere(pattern)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.[]()*+?{}|^$\\1,-: ", max_size=12))
def test_translated_patterns_compile(pattern):
    try:
        out = T.ere(pattern)
    except T.BadPattern:
        return
    re.compile(out.removeprefix("(?d)"))


def test_porter():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "sized": "size", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "goodness": "good", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil"}
    assert {w: W.stem(w) for w in pairs} == pairs
    assert W.porter_words("Crème BRÛLÉES, x_y") == ["creme", "brule", "x", "y"]


def test_wordpiece():
    vocab = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "play", "##ing", "##s", ",", "un", "##known", "é", "e"]
    t = W.WordPiece(vocab)
    assert t.encode("Playing, plays") == [2, 4, 5, 7, 4, 6, 3]
    assert t.encode("zzz unknown") == [2, 1, 8, 9, 3]
    assert t.encode("") == [2, 3]
    assert len(t.encode("play " * 600)) == 256
    assert W.WordPiece(vocab, conformant=True).encode("É") == [2, 11, 3]
    assert W.WordPiece(vocab, conformant=True).encode("p" * 101) == [2, 1, 3]


def test_snippet():
    text = "one two three " * 20 + "rare words here " + "four five " * 20
    out = W.snippet(text, {"rare", "word"})
    assert "[rare] [words]" in out and out.startswith(" ... ") and out.endswith(" ... ")
    assert W.snippet("short text", {"text"}) == "short [text]"
    assert W.snippet(None, {"x"}) == ""


def test_embedder_degrades(tmp_path):
    import numpy as np

    assert embedder(None) is None and embedder(str(tmp_path)) is None
    assert abs(np.linalg.norm(mean_pooled(np.ones((3, 4), np.float32))) - 1) < 1e-6
    assert not mean_pooled(np.zeros((2, 4), np.float32)).any()


def test_registered_functions(spark):
    register(spark)
    row = spark.sql("SELECT normalize_key('A  b', 63), cosine(array(3f, 4f), array(3f, 4f)), content_hash('x'), ere_imatch('B$', 'ab'), porter_tokens('running dogs')").first()
    assert row[0] == "a-b" and abs(row[1] - 1) < 1e-12 and row[2][:4] == "2d71" and row[3] is True and row[4] == ["run", "dog"]
    got = spark.sql("SELECT chunk_ix, chunk_text FROM chunks('a\nb\nc', 2)").collect()
    assert [tuple(r) for r in got] == [(0, "a\nb\n"), (1, "c")]
