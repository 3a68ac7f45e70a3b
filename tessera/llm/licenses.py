"""License scans, in DataFrame operations only: sparse TF-IDF cosine of lines, blocks of lines and whole files to
templates, then inheritance from the nearest directory above that has a licence file, by joins on paths."""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.license_texts import templates as all_templates

Templates = list[tuple[str, str]]
#: Least cosine to a template.
LEAST = 0.8
#: Between tokens of a text in lower case; between blocks of lines, of which a line without letters and digits is none.
BETWEEN, BLANK = "[^a-z0-9]+", "\n([^A-Za-z0-9\n]*\n)+"
#: Templates of up to so many tokens are looked at by the weights of those that a text holds, longer ones by their number.
SHORT = 16
#: Classes of weights: tokens of many templates, such as "the", weigh little.
USUAL = (1.5, 2.6, 3.6)
#: Names of files that hold a licence.
NAMED = r"(?i)^(un)?licen[cs]e|^copying|^notice"


def tokens(text: str) -> list[str]:
    return [t for t in re.split(BETWEEN, text.lower()) if t]


def weights(templates: Templates) -> tuple[dict[str, float], list[tuple[str, dict[str, float]]]]:
    """Inverse document frequencies of the templates' tokens, and each template's licence and unit vector."""
    df = Counter(t for _, x in templates for t in set(tokens(x)))
    idf = {t: math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in sorted(df.items())}
    vectors = []
    for name, text in templates:
        v = {t: n * idf[t] for t, n in Counter(tokens(text)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append((name, {t: x / norm for t, x in sorted(v.items())}))
    return idf, vectors


def unknown_idf(templates: Templates) -> float:
    return math.log(1 + len(templates)) + 1


def fewest(v: dict[str, float], least: float) -> int:
    """How many of a template's tokens a text holds at least if its cosine is `least`: by Cauchy and Schwarz the cosine is
    at most the norm of the template's part that the text holds."""
    held, n = 0.0, 0
    for x in sorted(v.values(), reverse=True):
        if held >= least * least - 1e-9:
            break
        held, n = held + x * x, n + 1
    return n


def telling(idf: dict[str, float], vectors: list[tuple[str, dict[str, float]]], least: float) -> list[str]:
    """Tokens of which a text holds one at least if its cosine to one of the short templates is `least`: of each those that
    few templates have, letters and digits by themselves last, so many that the others' part is too short by itself."""
    out = set()
    for _, v in vectors:
        left = 1.0
        for t, x in sorted(v.items(), key=lambda i: (len(i[0]) < 2, -idf[i[0]], i[0])) if len(v) <= SHORT else ():
            if left < least * least - 1e-9:
                break
            out.add(t)
            left -= x * x
    return sorted(out)


def _array(tokens: list[str]) -> Column:
    return F.array(*(F.lit(t) for t in tokens)) if tokens else F.array().cast("array<string>")


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) of a variable, so that x is made once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def may_hold(words: Column, idf: dict[str, float], vectors: list[tuple[str, dict[str, float]]], least: float) -> Column:
    """Whether a text of the given words, or a part of it, may have a cosine of `least` to a template: it holds a telling()
    token of a short one, or enough tokens of a long one."""
    long = {tuple(v): v for _, v in vectors if len(v) > SHORT}
    any_long = sorted({t for v in long.values() for t in v})
    enough = lambda k: reduce(or_, ((F.size(k) >= fewest(v, least)) & (F.size(F.array_intersect(_array(list(v)), k)) >= fewest(v, least)) for v in long.values()), F.lit(False))
    return F.exists(F.array(words), lambda w: F.arrays_overlap(w, _array(telling(idf, vectors, least))) | F.exists(F.array(F.array_intersect(w, _array(any_long))), enough))


def reachable(words: Column, idf: dict[str, float], vectors: list[tuple[str, dict[str, float]]], least: float) -> Column:
    """Whether a text of the given words may have a cosine of `least` to a template, by bounds.

    1. The cosine is at most the share that the known tokens (those of any template) have in the text's vector. A known
       token weighs at most its number times the greatest weight of its class (USUAL); every other word weighs what an
       unknown token does, and the squares of their numbers are least if all are equally frequent.
    2. The text holds enough tokens of a template (fewest(), and for short templates their weights).
    """
    vocabulary = sorted(idf)
    bounds = [(top, [t for t in vocabulary if low < idf[t] <= top]) for low, top in zip((0.0, *USUAL), USUAL, strict=False)]
    top, unknown = max(idf.values()), math.log(1 + len(vectors)) + 1

    def held(k: Column, v: dict[str, float]) -> Column:
        many = (F.size(k) >= fewest(v, least)) & (F.size(F.array_intersect(_array(list(v)), k)) >= fewest(v, least))
        if len(v) > SHORT:
            return many
        return many & (reduce(add, (F.when(F.array_contains(k, t), w * w).otherwise(0.0) for t, w in v.items())) >= least * least - 1e-9)

    def enough(w: Column, k: Column) -> Column:
        times = lambda t: (F.size(w) - F.size(F.array_remove(w, t))).cast("double")
        of = lambda t: F.coalesce(*(F.when(F.array_contains(_array(found), t), x * x) for x, found in bounds), F.lit(top * top))
        start = F.struct(F.lit(0.0).alias("weight"), F.lit(0.0).alias("times"))
        more = lambda s, t, n: F.struct((s["weight"] + n * n * of(t)).alias("weight"), (s["times"] + n).alias("times"))
        known = F.aggregate(k, start, lambda s, t: let(times(t), lambda n: more(s, t, n)))
        distinct = F.size(F.array_distinct(w)) - F.size(k)  # one may be the empty string of split(), which comes twice at most
        other = lambda s: F.greatest(F.size(w) - s["times"] - 2, F.lit(0.0))
        others = lambda s: F.greatest(distinct - 1.0, other(s) * other(s) / F.greatest(distinct, F.lit(1)))
        return F.exists(F.array(known), lambda s: s["weight"] >= others(s) * (unknown * unknown * least * least / (1 - least * least) * (1 - 1e-9)))

    kinds = {tuple(v): v for _, v in sorted(vectors, key=lambda x: tuple(x[1]))}
    # variables, so that words are made and looked up once and not for each template
    return F.exists(F.array(words), lambda w: F.exists(F.array(F.array_intersect(w, _array(vocabulary))), lambda k: (F.size(k) > 0) & enough(w, k) & reduce(or_, (held(k, v) for v in kinds.values()))))


def scores(words: Column, idf: dict[str, float], vectors: list[tuple[str, dict[str, float]]], least: float) -> Column:
    """array<struct<licence, score>>: the templates to which a text of the given words has a cosine of at least `least`.

    All of it is made inside the row, so that no words are sent. Words are told from tokens by a hash set; the others'
    numbers are runs of sorted words; the templates are one literal."""
    vocabulary = sorted(idf)
    at = {t: i for i, t in enumerate(vocabulary)}
    tokens_of = F.from_json(F.lit(json.dumps([{"t": t, "idf": idf[t]} for t in vocabulary])), "array<struct<t: string, idf: double>>")
    table = [{"licence": name, "of": [{"at": at[t], "w": w} for t, w in v.items()]} for name, v in vectors]
    table = F.from_json(F.lit(json.dumps(table)), "array<struct<licence: string, of: array<struct<at: int, w: double>>>>")
    square = math.pow(unknown_idf(vectors), 2)

    def squares(others: Column) -> Column:
        """The sum of the squares of the numbers of sorted words; a run that grows from n to n + 1 adds 2 n + 1."""
        state = lambda t, n, total: F.struct(t.alias("t"), n.alias("n"), total.alias("total"))
        on = lambda s, t: F.when(t == s["t"], state(t, s["n"] + 1, s["total"] + 2 * s["n"] + 1)).otherwise(state(t, F.lit(1).cast("long"), s["total"] + 1))
        return F.aggregate(others, state(F.lit(""), F.lit(0).cast("long"), F.lit(0).cast("long")), on, lambda s: s["total"])

    def weighed(known: Column, k: Column) -> Column:
        """Of every token of the templates its weight in a text of the given known words, of which k are the distinct ones."""
        numbers = F.transform(k, lambda t: (F.size(known) - F.size(F.array_remove(known, t))).cast("double"))
        return let(numbers, lambda n: F.transform(tokens_of, lambda v: F.when(F.array_contains(k, v["t"]), F.get(n, (F.array_position(k, v["t"]) - 1).cast("int")) * v["idf"]).otherwise(0.0)))

    def found(weights: Column, others: Column) -> Column:
        held = F.aggregate(weights, F.lit(0.0), lambda total, x: total + x * x)
        dot = lambda of: F.aggregate(of, F.lit(0.0), lambda total, x: total + F.get(weights, x["at"]) * x["w"])
        of = lambda v, norm: F.struct(v["licence"].alias("licence"), F.round(dot(v["of"]) / norm, 6).alias("score"))
        all_of = lambda norm: F.filter(F.transform(table, lambda v: of(v, norm)), lambda x: x["score"] >= least)
        none = F.array().cast("array<struct<licence: string, score: double>>")
        # the share of the known words bounds the cosine, but for its rounding to six digits
        return let(held, lambda h: let(F.sqrt(h + others * square), lambda norm: F.when(F.sqrt(h) >= norm * (least - 1e-6), all_of(norm)).otherwise(none)))

    def of_words(w: Column) -> Column:
        others = squares(F.array_sort(F.filter(w, lambda t: ~t.isin(vocabulary) & (t != ""))))
        known = F.filter(w, lambda t: t.isin(vocabulary))
        return let(known, lambda k: let(weighed(k, F.array_distinct(k)), lambda weights: let(others, lambda n: found(weights, n))))

    return let(words, of_words)


def words_of(text: Column) -> Column:
    return F.split(F.lower(text), BETWEEN)


def units(files: DataFrame) -> DataFrame:
    """files(path, text) to path, kind, place, last and raw: the lines of a text (kind 0), its blocks
    of several lines without a blank one between them (1), and the whole of a text of several blocks (2); last: whether
    no text comes behind a line or block, and some comes before it; or it is the whole."""

    def of(kind: int, parts: Column) -> Column:
        # a variable for the parts, so that they are made once and not for each of them
        unit = lambda p, x, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), ((i == F.size(p) - 1) & (i > 0)).alias("last"), x.alias("raw"))
        return F.flatten(F.transform(F.array(parts), lambda p: F.transform(p, lambda x, i: unit(p, x, i))))

    several = F.filter(of(1, F.split("text", BLANK)), lambda u: u["raw"].contains("\n"))
    whole = F.transform(F.filter(F.array(F.split("text", BLANK)), lambda p: F.size(p) > 1), lambda _: F.struct(F.lit(2).alias("kind"), F.lit(0).alias("place"), F.lit(True).alias("last"), F.col("text").alias("raw")))
    made = F.concat(of(0, F.split("text", "\n")), several, whole)
    return files.select("path", F.explode(made).alias("u")).select("path", "u.*")


def notices(files: DataFrame, templates: Templates | None = None, least: float = LEAST) -> DataFrame:
    """files(path, text) to path, kind, place, last, licence, score: the line, block or whole text of each file whose cosine
    to a template is highest and at least `least`. Ties go to lines before blocks before wholes, then to the earliest,
    then to the first name.

    A text's scores are made where the text is; only what reaches a template leaves its task."""
    templates = all_templates() if templates is None else templates
    idf, vectors = weights(templates)
    may = files.where(may_hold(words_of(F.col("text")), idf, vectors, least))
    found = units(may).where(may_hold(words_of(F.col("raw")), idf, vectors, least)).where(reachable(words_of(F.col("raw")), idf, vectors, least))
    # the outer explode looks at the scores once: of a plain one Spark makes a filter that makes them again
    scored = found.select("path", "kind", "place", "last", F.explode_outer(scores(words_of(F.col("raw")), idf, vectors, least)).alias("x")).where("x is not null")
    best = F.min(F.struct((-F.col("x.score")).alias("s"), "kind", "place", F.col("x.licence").alias("licence"), "last")).alias("b")
    return scored.groupBy("path").agg(best).select("path", "b.kind", "b.place", "b.last", "b.licence", (-F.col("b.s")).alias("score"))


def scan(files: DataFrame, templates: Templates | None = None, least: float = LEAST) -> DataFrame:
    """files(path, text) to path, licence, score, origin ("own", "inherited", null) and source_path: what names it.

    A file is a licence file, and stands for its directory too (the one with the least path, if several are), if its
    name says so, if its whole text is a licence's, or if its notice is its last line or block, after others. A file
    without a notice takes the licence of the nearest directory at or above its own that has one. Null paths have no
    directory; null and empty texts have no notice; long texts are looked at whole; an empty table gives no rows.
    Rows of one path are one file. One row for every row of files; other columns aren't read.
    """
    own = common.stored(notices(files.where("path is not null and text is not null"), templates, least), "notices")
    directory = lambda p: F.regexp_replace(p, "/?[^/]*$", "")
    is_licence = F.col("last") | F.regexp_extract("path", "[^/]*$", 0).rlike(NAMED)
    declared = own.where(is_licence).groupBy(directory("path").alias("above")).agg(F.min(F.struct("path", "licence", "score")).alias("d"))
    dirs = files.where("path is not null").select(directory("path").alias("dir")).distinct()
    parts = F.split("dir", "/")
    chain = dirs.select("dir", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("depth", "above"))
    nearest = chain.join(declared, "above").groupBy("dir").agg(F.max(F.struct("depth", "d")).alias("x")).select("dir", "x.d")
    rows = files.select("path", directory("path").alias("dir"))
    out = rows.join(own.select("path", "licence", "score"), "path", "left").join(nearest, "dir", "left")
    mine = F.col("licence").isNotNull()
    return out.select(
        "path", F.coalesce("licence", "d.licence").alias("licence"), F.coalesce("score", "d.score").alias("score"),
        F.when(mine, "own").when(F.col("d").isNotNull(), "inherited").alias("origin"), F.when(mine, F.col("path")).otherwise(F.col("d.path")).alias("source_path"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """documents as a tree of files: source/digits of doc_id div 10 without zeros at the end/doc_id."""
    digits = F.regexp_replace(F.floor(F.abs("doc_id") / 10).cast("string"), "0+$", "")
    tree = F.array_join(F.filter(F.split(digits, ""), lambda d: d != ""), "/")
    return docs.select(F.concat_ws("/", F.coalesce("source", F.lit("none")), F.when(tree != "", tree), F.col("doc_id").cast("string")).alias("path"), "text", "doc_id")


def scan_documents(docs: DataFrame) -> DataFrame:
    """The rows of op8: doc_id, path, licence, score, origin, source_path. Rows without a doc_id are left out: they have no path."""
    files = as_files(docs.where("doc_id is not null"))
    return scan(files).select(F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), "path", "licence", "score", "origin", "source_path")
