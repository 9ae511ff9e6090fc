"""One-pass rewriting: no rule touches what another has made; both forms alike; the named rules on known characters."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import clean as B


def plain(text, rules):
    table, out, at = T.rule_table(rules), [], 0
    while at < len(text):
        src = max((s for s in table if text.startswith(s, at)), key=len, default=None)
        out.append(text[at] if src is None else table[src])
        at += 1 if src is None else len(src)
    return "".join(out)


def test_rules_do_not_feed_each_other(spark):
    df = spark.createDataFrame([("a b ab aab",), ("",), (None,)], "t string")
    rules = [("a", "b"), ("b", "c"), ("ab", "x"), ("", "y"), ("a", "z")]
    for expr in (T.apply_rules(F.col("t"), rules), B.rewrite("identity", rules)(F.col("t"))):
        assert [r[0] for r in df.select(expr).collect()] == ["b c x bx", "", None]


@pytest.mark.parametrize("seed", range(4))
def test_both_forms_match_the_longest_source(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ab.*(é日") for _ in range(rng.randint(1, n)))
    rules = [(word(4), word(3)) for _ in range(25)]
    texts = [word(40) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [plain(t, rules) for t in texts]
    assert [r[0] for r in df.select(T.apply_rules(F.col("t"), rules)).collect()] == want
    assert [r[0] for r in df.select(B.rewrite("identity", rules)(F.col("t"))).collect()] == want
    many = rules + [(f"{k}#", "n") for k in range(100)]  # over the limit of the column form
    assert [r[0] for r in df.select(B.normalise(F.col("t"), many, escape=False)).collect()] == [re.sub("[ \t\n\r]+", " ", w).strip(" ") for w in want]


# Characters and what the default rule makes of them.
EXPECTED = [
    ("ﬁn", "fin"), ("Ａ１！", "A1!"), ("㌔", "キロ"), ("ｶﾞ", "ガ"), ("é", "é"), ("x²", "x2"), ("½", "1⁄2"), (" a　b", "a b"),
    ("a​b", "a b"), ("a\x01b", "ab"), ("…", "..."), ("ﷺ", "صلى الله عليه وسلم"), ("①", "1"), ("Å", "Å"), ("가", "가"),
]


def test_the_default_rule(spark):
    df = spark.createDataFrame(EXPECTED, "raw string, want string")
    got = df.select("raw", "want", B.normalise_by_rule(F.col("raw")).alias("n")).collect()
    assert {r.raw: r.n for r in got} == {r.raw: "▁" + r.want.replace(" ", "▁") for r in got}


def test_a_rule_and_the_named_rule_are_one_pass(spark):
    df = spark.createDataFrame([("①②ﬁ",)], "t string")
    rules = [("①", "Ａ"), ("1", "one"), ("2", "two")]
    assert df.select(B.rewrite("nfkc", rules)(F.col("t"))).first()[0] == "Ａ2fi"
