"""The pattern dialect, globs and addresses."""

import dataclasses
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import linear, matching, patterns
from tessera.functions.cells import a1, a1_column, number_text, row_column, row_of, split_a1
from tessera.functions.globs import glob_python, glob_regex
from tessera.functions.matching import has_hit, with_submatches
from tessera.functions.patterns import compile_pattern
from tessera.model import Fatal

E = "é"
CASES = [
    (r"\w+", "张三!", ["张三"]), (r"\d", "٣", ["٣"]), ("É", "é", []), ("(?i)É", "é", ["é"]), ("a.b", "a\rb", ["a\rb"]), ("a.b", "a\nb", []), ("(?s)a.b", "a\nb", ["a\nb"]), ("foo$", "foo\n", []), ("foo$", "x foo", ["foo"]), ("(?m)^b$", "a\nb\nc", ["b"]),
    (r"\Aab\z", "ab", ["ab"]), ("(?P<n>a)(?<m>b)", "ab", ["ab"]), ("(?x) a b # c\n c", "abc", ["abc"]), ("(?x)a\\ b", "a b", ["a b"]), ("[[:alpha:]]+", "ab1", ["ab"]), ("[^[:digit:]]+", "ab1", ["ab"]), (r"\p{Han}+", "x张三", ["张三"]), (r"\pL+", "ab1", ["ab"]), (r"\P{L}+", "ab12", ["12"]),
    (r"\p{Greek}", "α", ["α"]), (r"\p{Lowercase_Letter}+", "aB", ["a"]), (r"\p{script=Cyrillic}", "ж", ["ж"]), (r"\x{1F600}", "😀", ["😀"]), (r"\x41B\U00000043", "ABC", ["ABC"]), ("[a-z--[aeiou]]+", "abcde", ["bcd"]), ("[a-z&&[^c]]+", "abcd", ["ab", "d"]), ("[a-d~~c-f]+", "abcdef", ["ab", "ef"]),
    ("[]a]+", "]a", ["]a"]), ("[^]a]+", "]ab", ["b"]), ("[a-]+", "a-", ["a-"]), (r"[\]\-]+", "]-", ["]-"]), (r"[\d.]+", "1.5", ["1.5"]), ("a{2,3}?", "aaaa", ["aa", "aa"]), ("(?U)a+", "aaa", ["a", "a", "a"]), ("(?U)a+?", "aaa", ["aaa"]), ("a++", "aaa", ["aaa"]), ("(?i:a)B", "AB aB ab", ["AB", "aB"]), ("(?i)a(?-i)B", "AB Ab", ["AB"]),
    (r"\bfoo\b", "foo food", ["foo"]), (r"\b{start}o\w", "xo ok", ["ok"]), ("a|b|", "ab", ["a", "b"]), ("a*", "aab", ["aa", ""]), ("x*", "ab", ["", "", ""]), (r"\t\n\v", "\t\n\x0b", ["\t\n\x0b"]), ("#", "a#b", ["#"]), ("(?x)[ a ]+", "a a", ["a", "a"]), ("[[a-c]x]+", "axc", ["axc"]), (r"\.", "a.b", ["."]), ("(?R)", None, None),
]


@pytest.mark.parametrize("pattern,text,expected", [c for c in CASES if c[2] is not None])
def test_dialect(spark, pattern, text, expected):
    p = compile_pattern(spark, [pattern], "sensitive")
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(text, 1)], "text string, k int")
    row = with_submatches(df, p).select("submatches", has_hit(F.col("text"), p).alias("hit")).first()
    assert [m.match.text for m in row.submatches] == expected and row.hit == bool(expected)
    assert all(text[m.start : m.end] == m.match.text for m in row.submatches)


@pytest.mark.parametrize("pattern", [r"(a)\1", "(?=a)", "(?!a)", "(?<=a)b", "(?<!a)b", "(?>a)", "*a", "(", "a)", "[a", r"\Q", r"\Z", "a{x}", "a{3,1}", r"\k<n>", r"\y", "[z-a]", "(?R)", "(?-u)a", r"\p{Nonsense}", "a**?{"])
def test_rejected(spark, pattern):
    with pytest.raises(Fatal):
        compile_pattern(spark, [pattern])


def hits(spark, text, *patterns, **kw):
    p = compile_pattern(spark, patterns, **kw)
    df = spark.createDataFrame([(text,)], "text string")
    return [(m.start, m.end) for m in with_submatches(df, p).first().submatches]


def test_modes(spark):
    assert hits(spark, "张三 🎉 foo Foo", "foo") == [(5, 8), (9, 12)]
    assert hits(spark, "foo Foo", "Foo") == [(4, 7)]
    assert hits(spark, "foo Foo", "Foo", case="insensitive") == [(0, 3), (4, 7)]
    assert hits(spark, "foo Foo", "foo", case="sensitive") == [(0, 3)]
    assert hits(spark, "É é", "é") == [(0, 1), (2, 3)] and hits(spark, "É é", "É") == [(0, 1), (2, 3)]
    assert hits(spark, "a+b aab", "a+b", fixed=True) == [(0, 3)]
    assert hits(spark, "(x) [y] a+b", "(x)", "[y]", "a+b", fixed=True) == [(0, 3), (4, 7), (8, 11)]
    assert hits(spark, "cat concat cat's", "cat", word=True) == [(0, 3), (11, 14)]
    assert hits(spark, "one two", "two", "one") == [(0, 3), (4, 7)]
    assert hits(spark, "S s", r"\S") == [(0, 1), (2, 3)] and compile_pattern(spark, [r"\Sx"]).insensitive is False
    assert compile_pattern(spark, ["lit.eral"], "sensitive", fixed=True).literal == "lit.eral" and compile_pattern(spark, ["abc"], fixed=True).literal is None
    with pytest.raises(Fatal):
        compile_pattern(spark, [])


@pytest.mark.parametrize("glob,yes,no", [("*.csv", ["a/b.csv"], ["a.tsv"]), ("a?c", ["abc", "a/c"], ["ac"]), ("**/x", ["x", "a/b/x"], ["ax"]), ("[!a]b", ["cb"], ["ab"]), ("[a-c]", ["b"], ["d"]), ("{a,b}.t", ["a.t", "b.t"], ["c.t"]), (r"\*", ["*"], ["a"]), ("a.b", ["a.b"], ["axb"]), ("汇*", ["汇总"], ["总"])])
def test_globs(glob, yes, no):
    r = re.compile(glob_python(glob))
    assert all(r.match(x) for x in yes) and not any(r.match(x) for x in no)


@pytest.mark.parametrize("glob", ["[a", "{a", "a}"])
def test_bad_globs(glob):
    with pytest.raises(Fatal):
        glob_regex(glob)


def test_addresses(spark):
    from pyspark.sql import functions as F

    assert [a1(1, c) for c in (1, 26, 27, 52, 53, 702, 703, 16384)] == ["A1", "Z1", "AA1", "AZ1", "BA1", "ZZ1", "AAA1", "XFD1"]
    df = spark.range(1, 18279, 1, 4).select(F.lit(17).cast("long").alias("row"), F.col("id").cast("int").alias("col"))
    rows = df.select("col", a1_column(F.col("row"), F.col("col")).alias("cell")).withColumn("row", row_column(F.col("cell"))).collect()
    assert all(r.cell == a1(17, r.col) and r.row == 17 and split_a1(r.cell) == (17, r.col) for r in rows)
    assert [row_of(x) for x in ("AA17", "A0", "17", "A", "A1x", "")] == [17, None, None, None, None, None]
    assert split_a1("$B$3") == (3, 2) and split_a1("3B") is None


@pytest.mark.parametrize("x,text", [(100.0, "100"), (250.5, "250.5"), (-0.0, "0"), (1e-11, "0"), (1e20, "100000000000000000000"), (0.1, "0.1"), (-3.25, "-3.25"), (1234567.891, "1234567.8910000001"), (0.99999999999, "1"), (-2.99999999999, "-3")])
def test_numbers(spark, x, text):
    from pyspark.sql import functions as F

    from tessera.functions.cells import number_column

    assert number_text(x) == text
    assert spark.createDataFrame([(x,)], "x double").select(number_column(F.col("x"))).first()[0] == text


def spelt(pattern, insensitive=False):
    return ("(?dUiu)" if insensitive else "(?dU)") + patterns._Translator(pattern).whole()


ENGINE_PATTERNS = [
    r"(a|b)*c", r"(\w+)+$", r"(?:\w+\s?)+!", r"a*?b", r"(a*)*", r"(a|ab)(c|bcd)(d*)", r"\bfoo\b|bar", r"^a|b$", r"(?m)^a.?$", r"x*", r"a{2,3}?b?", r"[^ab\n]+", r"(?s)a.b", r"(?:a|b|ab)+?c", r"\B.", r"\b", r"(?i)Ab+", r"é|\pL+\d", r"(?:a?){3}a{3}",
    r"\<a|b\>", r"\b{start-half}a", "", r"[a-c&&[^b]]+", r"(?-i:A)b|\x{66}oo",
]


@pytest.mark.parametrize("pattern", ENGINE_PATTERNS)
def test_linear_engine_equals_a_backtracking_one(pattern):
    import regex

    rng = random.Random(pattern)
    for insensitive in (False, True):
        java = spelt(pattern, insensitive)
        engine, other = linear.Engine(java), regex.compile(patterns.Pattern("", java, insensitive, None, True).for_regex_module())
        for _ in range(200):
            text = "".join(rng.choices(["a", "b", "c", "d", "A", "B", "foo", "bar", " ", "\n", "é", "x", "1", "!"], k=rng.randint(0, 10)))
            expected, last = [], -1
            for m in other.finditer(text):
                if m.end() > m.start() or m.start() != last:
                    expected.append(m.span())
                last = m.end()
            assert engine.find_all(text) == expected and engine.search(text) == bool(other.search(text)), text


def test_an_empty_alternative_comes_first():
    assert linear.Engine(spelt("()|a")).find_all("bab") == [(0, 0), (1, 1), (2, 2), (3, 3)]


@pytest.mark.parametrize("pattern,trust", [("HIT", "linear"), (r"row-\d{4,}", "linear"), (r"\d{4}-\d{2}", "linear"), (r"x\w*", "polynomial"), (r"x[0-9]*y", "linear"), (r"a.*b", "polynomial"), (r"\w+!", "polynomial"), (r"(a|b)*c", "none"), (r"(?:\w+\s?)+!", "none"), (r"((a?){30}){30}", "none"), (r"(ab){2,3}", "linear")])
def test_trust(pattern, trust):
    assert linear.trust(spelt(pattern)) == trust


@pytest.mark.parametrize("pattern,text,hit", [(r"(a|b)*c", "ab" * 500_000, False), (r"(a|b)*c", "ab" * 500_000 + "c", True), (r"(\w+)+$", "word " * 200_000 + "!", False), (r"(?:\w+\s?)+!", "word " * 200_000, False), (r"(?:\w+\s?)+!", "word " * 200_000 + "!", True), (r"\w+!", "w" * 1_000_000, False), (r"x.*y.*z", "xy" * 500_000, False)])
def test_no_pattern_takes_more_than_linear_time(spark, pattern, text, hit):
    compiled = patterns.compile_pattern(spark, [pattern], "sensitive")
    df = spark.createDataFrame([(text,), ("a short text",), (None,)], "text string")
    began = time.time()
    rows = matching.with_submatches(df.where(matching.has_hit(F.col("text"), compiled)), compiled).collect()
    assert [(m.start, m.end) for r in rows for m in r.submatches if len(r.text) > 100] == ([(0, len(text))] if hit else [])
    assert df.select(matching.first_offset(F.col("text"), compiled).alias("n")).first().n == 1
    assert time.time() - began < 90


def test_texts_are_searched_alike_in_the_jvm_and_outside(spark):
    rng = random.Random(8)
    rows = [("".join(rng.choices(["a", "b", "foo", " ", "\n", "é", "1"], k=rng.randint(0, 30))),) for _ in range(200)] + [("ab foo1 " * 6_000 + "é1",), ("b" * 40_000,)]
    df = spark.createDataFrame(rows, "text string")
    for pattern in (r"\w+1", r"foo\d*b?", r"[ab]+ ?\n", r"(?:ab?)+1"):
        compiled = patterns.compile_pattern(spark, [pattern], "sensitive")
        trusted = dataclasses.replace(compiled, trust="linear")
        for p in (compiled, trusted):
            found = [[m.asDict(True) for m in r.submatches] for r in matching.with_submatches(df, p).collect()]
            assert found == [matching._as_submatches(t, matching.spans_finder(compiled)(t)) for t, in rows]
        assert [r.h for r in df.select(matching.has_hit(F.col("text"), compiled).alias("h")).collect()] == [matching.hit_finder(compiled)(t) for t, in rows]
