import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X


def run(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i long, {schema}").orderBy("i").select(column).collect()]


@pytest.mark.parametrize("n, want", [(0, "영"), (1, "일"), (10, "십"), (11, "십일"), (110, "백십"), (1000, "천"), (10000, "일만"), (2026, "이천이십육"), (100000000, "일억"), (120300, "십이만삼백")])
def test_sino(n, want):
    assert X.read_sino(n) == want


@pytest.mark.parametrize("n, want", [(1, "한"), (3, "세"), (20, "스물"), (21, "스물한"), (99, "아흔아홉"), (100, "백"), (0, "영")])
def test_native(n, want):
    assert X.read_native(n) == want


@pytest.mark.parametrize("src, want", [("7.2kg", "칠 점 이 킬로그램"), ("3살", "세 살"), ("2마리와", "두 마리와"), ("2026년 1월", "이천이십육년 일월"), ("6개월", "육개월"), ("3개", "세 개"), ("5시간", "다섯 시간"), ("3시", "세 시"), ("50%", "오십 퍼센트"), ("0.05", "영 점 영 오"), ("plain", "plain")])
def test_numbers(src, want):
    assert X.read_numbers(src) == want


def test_numbers_udf(spark):
    assert run(spark, [("3살",), (None,)], "t string", X.read_numbers_udf("t")) == ["세 살", None]


def test_cer_and_letters(spark):
    rows = [("가나다", "가나다!"), ("가나다라마", "가나"), ("", "x"), (None, None), ("a b", "ab")]
    assert run(spark, rows, "r string, h string", X.cer(F.col("r"), F.col("h"))) == [0.0, 0.6, 0.0, 0.0, 0.0]


def test_pins(spark):
    rows = [("내레이션 없이 만들어줘",), ("TTS 넣어줘",), ("그냥 영상",), (None,), ("자막만 넣고 목소리",)]
    assert run(spark, rows, "t string", X.pin_mode(F.col("t"))) == ["edit", "narration", None, None, "edit"]
    assert run(spark, [("자막 없이",), ("자막",)], "t string", X.caption_forbidden(F.col("t"))) == [True, False]


def test_keywords_and_echo(spark):
    rows = [([" 카페 ", "all", "a:b", "0123456789a", "밤 산책", "ALL", ""],)]
    assert run(spark, rows, "k array<string>", X.clean_keywords(F.col("k"))) == [["카페", "밤 산책"]]
    rows = [("우리 토리 영상 (가족!)", "우리 토리 영상"), ("우리 토리 영상!", "우리 토리 영상"), ("안녕 🐾", "x"), (None, "x"), ("안녕!", "")]
    assert run(spark, rows, "t string, r string", X.clean_text(F.col("t"), F.col("r"))) == ["가족!", "", "안녕", "", "안녕!"]


def test_cache_key(spark):
    import hashlib

    assert run(spark, [("a", "b")], "x string, y string", X.cache_key(F.col("x"), F.col("y"))) == [hashlib.sha1(b"a|b").hexdigest()[:16]]


def test_wrap():
    w = X.fixed_width(1.0)
    assert X.wrap("aa bb cc", w, 5) == ["aa bb", "cc"] and X.wrap("abcdefgh", w, 3) == ["abc", "def", "gh"] and X.wrap("", w, 3) == [] and X.wrap("aaaaaa b", w, 4) == ["aaaa", "aa", "b"]
    assert X.wrap("abc", w, 0.5) == ["a", "b", "c"]


def test_numbers_longer_than_the_group_names():
    assert X.read_sino(10**16 - 1).startswith("구천구백구십구조") and X.read_sino(10**16) == "일" + "영" * 16 and X.read_numbers(f"{10**16 + 5}마리") == "일" + "영" * 15 + "오 마리"


@pytest.mark.parametrize("src, want", [("3.5개", "삼 점 오개"), ("3gb", "삼gb"), ("5 kg", "오 킬로그램"), ("1.2.3kg", "일 점 이.삼 킬로그램"), ("3.kg", "삼. 킬로그램"), ("12번지", "십이번지"), ("a  b", "a b")])
def test_what_follows_a_number(src, want):
    assert X.read_numbers(src) == want


def test_wrapping_columns_equal_the_plain_loop(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices("ab가i \n\t　 x", k=rng.randrange(60)))) for i in range(150)] + [(1000, None), (1001, ""), (1002, " "), (1003, "x" * 500), (1004, "a b " * 3000)]
    df = spark.createDataFrame(rows, "i long, t string")
    own = {"가": 20.0, "i": 4.0}
    for limit in (5.0, 45.0, 120.0):
        got = {r.i: r.x for r in df.select("i", X.wrap_lines(F.col("t"), limit, 10.0, own).alias("x")).collect()}
        assert got == {i: X.wrap(t or "", lambda s: sum(own.get(c, 10.0) for c in s), limit) for i, t in rows}
