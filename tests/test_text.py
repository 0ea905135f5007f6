import random

import pytest
import spec
from pyspark.sql import functions as F

from tessera.functions import porter
from tessera.functions import text as X

BITS = ["a", "B", "z", "é", "É", "ß", "’", "9", " ", "\n", "\t", "\r", "\x0b", "#", "#(", ")#", "#{", "}#", "#!", "!#", "(", ")", "!", "-", ".", ";", "&", "&amp;", "& ", "<", ">", "<!--", "-->", "<!-->", "<script", "</script>", "<STYLE>", "</style>", "𝔸", "e.g."]


def strings(seed, n=3000):
    rng = random.Random(seed)
    return ["".join(rng.choices(BITS, k=rng.randrange(0, 14))) for _ in range(n)]


def applied(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in sorted(df.select("i", f(F.col("t")).alias("x")).collect())]


def test_strip_agrees_with_a_scan(spark):
    texts = strings(1)
    assert applied(spark, texts, X.strip_markup) == [spec.strip(t) for t in texts]


@pytest.mark.parametrize("math", [False, True])
def test_tokens_agree_with_a_scan(spark, math):
    texts = strings(2)
    assert applied(spark, texts, lambda c: X.words(c, math)) == [spec.tokens(t, math) for t in texts]


@pytest.mark.parametrize(
    "text, want",
    [("a<b>c</b>", "a c"), ("x &amp; y", "x y"), ("AT&T ;", "AT&T ;"), ("a < b", "a"), ("a<!-- x -->b", "a b"), ("<SCRIPT>x</script>y", " y"), ("a \n\t b", "a\nb"), ("", "")],
)
def test_strip_examples(spark, text, want):
    assert applied(spark, [text], X.strip_markup) == [want]


def test_math_examples(spark):
    cases = {
        "x #(c)# y": ["x", "#(c)#", "y"],
        "x#(c)# y": ["x", "c", "y"],
        "#(a#b)#": ["a", "b"],
        "#{}# a": ["a"],
        "#(c)#,d": ["c", "d"],
        "#!2!# b": ["#!2!#", "b"],
    }
    assert applied(spark, list(cases), lambda c: X.words(c, True)) == list(cases.values())


def test_stems_agree_with_a_letter_by_letter_version(spark):
    rng = random.Random(3)
    ends = "s sses ies ed eed ing at bl iz y ational tional enci izer bli alli entli eli ousli ization ation ator alism iveness fulness ousness aliti iviti biliti logi icate ative alize iciti ical ful ness al ance ence er ic able ible ant ement ment ent ion sion tion ou ism ate iti ous ive ize e ll l".split()
    words = {"".join(rng.choices("aeiouybcdlstzwx", k=rng.randrange(0, 6))) + "".join(rng.choices(ends, k=rng.randrange(0, 3))) for _ in range(6000)}
    words |= {"miíes", "éé", "caresses", "ponies", "ties", "cats", "feed", "agreed", "disabled", "matting", "mating", "meetings", "relational", "generalizations", "oscillators", "ion", "ied", "aing", "9s", "ééing"}
    df = spark.createDataFrame([(w,) for w in sorted(words) if w], "term string")
    got = {r.term: r.stem for r in porter.stem(df, "term", "stem").collect()}
    want = {w: spec.stem(w) for w in got}
    assert {w: (got[w], want[w]) for w in got if got[w] != want[w]} == {}
    assert got["generalizations"] == "gener" and got["miíes"] == "mií"


def test_weights(spark):
    got = applied(spark, ["a #!3!# b c #!1!# d", "#!!# x", "", "#!2!#", "#!-1x!#\ta", None], X.weighted)
    assert [None if g is None else [(t.pos, t.term, t.weight) for t in g] for g in got] == [
        [(0, "a", 1), (1, "b", 3), (2, "c", 3), (3, "d", 1)],
        [(0, "#!!#", 1), (1, "x", 1)],
        [],
        [],
        [(0, "a", -1)],
        None,
    ]


def test_a_weight_without_digits_is_an_error(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        applied(spark, ["#!x!# a"], X.weighted)


def test_many_marks_in_one_long_text(spark):
    text = " ".join(f"#!{i % 7 + 1}!# w{i}" for i in range(20000))
    got = applied(spark, [text], X.weighted)[0]
    assert len(got) == 20000 and all(t.weight == i % 7 + 1 and t.term == f"w{i}" for i, t in enumerate(got))
