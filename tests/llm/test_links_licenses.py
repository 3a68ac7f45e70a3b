"""Tool calls and licences against SQL, and odd inputs."""

import json
import math
import os
import random
import re
import textwrap
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, license_texts, licenses, queries, toolcalls


@pytest.mark.parametrize("name,table", [("op6_tool_calls", "conversations"), ("op8_licenses", "documents")])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_queries_against_sql(spark, name, table, sf):
    folder = f"/root/testdata/{sf}"
    db = duckdb.connect()
    db.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    df = queries.queries()[name](spark, folder)
    found = db.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert names == df.columns
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, found.fetchall()))
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval"))


SCHEMAS = {"f": {"n": ("integer", True, 1, 9), "s": ("string", False, None, 3), "b": ("boolean", False, None, None), "x": ("number", False, None, None)}}


def test_validation_and_canonical_json(spark):
    cases = [
        ("f", '{"n": 3}', None), ("f", '{"n": 0}', "range n"), ("f", '{"n": "3"}', "type n"), ("f", "{}", "missing n"), ("f", '{"n": null}', "missing n"), ("f", '{"n":1,"s":"abcd"}', "range s"),
        ("f", '{"n":1,"z":1,"y":2}', "unexpected y"), ("f", '{"n":1,"b":true,"x":1.5}', None), ("f", '{"n":1,"b":"true"}', "type b"), ("f", "{oops", "JSON"), ("f", "[1]", "JSON"), ("f", None, "JSON"), ("g", "{}", "tool"), (None, "{}", "tool"), ("f", '{"n":1,"x":2}', None),
    ]
    calls = spark.createDataFrame([(f"c{i}", "k", n, a, ["c1"] if i == 4 else None) for i, (n, a, _) in enumerate(cases)], "call_id string, conversation string, name string, arguments string, after array<string>")
    results = spark.createDataFrame([("c0", "done"), ("c0", "again"), ("c99", "lost"), (None, "x"), ("c1", None)], "call_id string, content string")
    got = {r.call_id: r for r in toolcalls.link(calls, results, SCHEMAS).collect()}
    assert [got[f"c{i}"].problem for i in range(len(cases))] == [p for _, _, p in cases]
    assert got["c99"].state == "no call" and got["c1"].state == "linked" and got["c2"].state == "no result" and len(got) == len(cases) + 1
    assert got["c0"].message == '{"arguments":{"n":3},"call_id":"c0","name":"f","result":"again"}' and got["c0"].n_results == 2
    assert [i for i, _ in sorted(enumerate(cases), key=lambda c: got[f"c{c[0]}"].position)] == [*sorted((i for i in range(len(cases)) if i != 4), key=lambda i: f"c{i}"), 4]
    assert '"after":["c1"]' in got["c4"].message and got["c99"].position is None
    row = spark.createDataFrame([('{"b": {"z": 1, "a": [1, {"d": 2, "c": "é\\n"}]}, "a": null}',)], "j string").select(toolcalls.canonical("j").alias("j")).first().j
    assert row == json.dumps(json.loads('{"b": {"z": 1, "a": [1, {"d": 2, "c": "é\\n"}]}, "a": null}'), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def walked(after):
    """Depths by looking at every call again until nothing changes."""
    depth, known = {}, {c: {a for a in x or () if a in after} for c, x in after.items()}
    while True:
        new = {c: 1 + max((depth[a] for a in x), default=-1) for c, x in known.items() if c not in depth and x <= set(depth)}
        if not new:
            return {c: depth.get(c) for c in after}
        depth |= new


def test_depths(spark):
    rng = random.Random(4)
    after = {f"n{i}": [f"n{i - 1}"] if i else None for i in range(100)}
    after |= {"x": ["y"], "y": ["x"], "z": ["x"], "self": ["self"], "lost": ["nobody", None], "tree1": ["n5"], "tree2": ["n5", "n5"], "half": ["x", "n3"], "wide": ["n7", "n90", "tree1", "nobody"], "on": ["wide"], "both": ["on", "n99", "wide"], "far": ["both"]}
    after |= {f"r{i}": [f"r{rng.randrange(i)}" for _ in range(rng.randint(0, 3))] if i else [] for i in range(60)}
    after |= {f"star{i}": ["n0"] for i in range(300)}
    calls = spark.createDataFrame(list(after.items()), "call_id string, after array<string>")
    assert {r.call_id: r.depth for r in toolcalls.depths(calls).collect()} == walked(after)
    assert toolcalls.depths(calls.limit(0)).count() == 0


def test_positions_are_a_topological_order_of_each_conversation(spark):
    rows = [(f"c{i}", i % 3 if i < 900 else 7, i * 37 % 11) for i in range(1500)] + [("none", 1, None), ("nowhere", None, 0)]
    got = {r.call_id: r.position for r in toolcalls.positions(spark.createDataFrame(rows, "call_id string, conversation long, depth long")).collect()}
    for k in (0, 1, 2, 7, None):
        order = sorted((d, c) for c, x, d in rows if x == k and d is not None)
        assert [got[c] for _, c in order] == list(range(1, len(order) + 1))
    assert "none" not in got


def test_a_join_deals_frequent_keys_out(spark):
    left = spark.createDataFrame([(i, 1 if i < 500 else i % 7) for i in range(600)] + [(9, None)], "x long, k long")
    right = spark.createDataFrame([(k, f"v{k}", j) for k in range(5) for j in range(2)] + [(None, "no", 0)], "k long, share string, shares long")
    got = sorted(map(tuple, common.spread_join(left, right, "k", "x", 50).select("k", "x", "share", "shares").collect()))
    assert got == sorted(map(tuple, left.join(right, "k").select("k", "x", "share", "shares").collect())) and len(got) > 1000


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "hi ?"), (1, 0, "user", "dup"), (1, 1, "assistant", None), (None, 0, "user", "x"), (2, None, "user", "x"), (3, 0, None, "x"), (4, 0, "user", None), (5, 0, "user", ""), (6, 0, "user", "w " * 5000)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, call_id int")
    got = {r.call_id: r for r in toolcalls.link_conversations(turns).collect()}
    assert set(got) == {"call_1_0", "call_4_0", "call_5_0", "call_6_0"}
    assert (got["call_1_0"].n_calls, got["call_1_0"].state) == (2, "linked")
    assert [got[f"call_{i}_0"].problem for i in (4, 5, 6)] == ["missing text", "range text", "range text"]
    assert toolcalls.link_conversations(turns.limit(0)).count() == 0


def test_odd_files(spark):
    mit, gpl = "Released under the MIT License.", "Licensed under the GNU General Public License, version 3."
    rows = [
        ("a/LICENSE", "some words\n" + mit), ("a/x", "no notice"), ("a/b/y", None), ("a/b/c/LICENSE", "text\n" + gpl), ("a/b/c/d/z", ""), ("a/b/c/own", mit.upper() + "\nmore text"), ("top", "nothing"), (None, mit),
        ("a/x", "no notice"), ("e/1", "x\n" + mit), ("e/0", "x\n" + gpl), ("e/2", "word " * 20_000), ("f", "licensed " * 30), ("ab/q", "q"), ("g/only", mit),
    ]
    files = spark.createDataFrame([(*r, 1) for r in rows], "path string, text string, score int")
    got = licenses.scan(files.select("path", "text")).collect()
    assert len(got) == len(rows)
    by = {r.path: (r.licence, r.origin, r.source_path) for r in got}
    assert by == {
        "a/LICENSE": ("MIT", "own", "a/LICENSE"), "a/x": ("MIT", "inherited", "a/LICENSE"), "a/b/y": ("MIT", "inherited", "a/LICENSE"), "a/b/c/LICENSE": ("GPL-3.0", "own", "a/b/c/LICENSE"),
        "a/b/c/d/z": ("GPL-3.0", "inherited", "a/b/c/LICENSE"), "a/b/c/own": ("MIT", "own", "a/b/c/own"), "top": (None, None, None), None: (None, None, None), "e/1": ("MIT", "own", "e/1"), "e/0": ("GPL-3.0", "own", "e/0"),
        "e/2": ("GPL-3.0", "inherited", "e/0"), "f": (None, None, None), "ab/q": (None, None, None), "g/only": ("MIT", "own", "g/only"),
    }
    assert licenses.scan(files.limit(0)).count() == 0


def best_of(text, idf, vectors, unknown):
    """The highest cosine of one text to a template, and its licence."""
    v = {t: n * idf.get(t, unknown) for t, n in Counter(licenses.tokens(text)).items()}
    norm = math.sqrt(sum(y * y for y in v.values())) or 1
    return max((round(sum(y * t.get(z, 0) for z, y in v.items()) / norm, 6), name) for name, t in vectors)


def test_no_text_is_left_out_that_reaches_a_template(spark):
    templates = licenses.all_templates()
    idf, vectors = licenses.weights(templates)
    rng = random.Random(2)
    lines = [" ".join([text] * 3 + [f"w{i}" for i in range(k)]) for _, text in templates[::5] for k in (5, 40)]
    for _, text in templates:
        w = text.split()
        lines += [" ".join(x for x in w if rng.random() > d) + " " + " ".join(rng.choices(["the", "x", "mit", "by"], k=k)) for d in (0, 0.1, 0.3, 0.5) for k in (0, 1, 3)]
    df = spark.createDataFrame([(x,) for x in lines], "raw string").withColumn("words", licenses.words_of(F.col("raw")))
    kept = [r.k for r in df.select(licenses.reachable(F.col("words"), idf, vectors, licenses.LEAST).alias("k")).collect()]
    assert all(k or best_of(x, idf, vectors, licenses.unknown_idf(templates))[0] < licenses.LEAST for x, k in zip(lines, kept, strict=True))
    assert not all(kept) and not df.select(licenses.reachable(licenses.words_of(F.lit("the work is under a version of the program")), idf, vectors, licenses.LEAST)).first()[0]


def test_no_words_of_texts_are_sent(spark):
    plan = licenses.notices(spark.createDataFrame([("a", "MIT License")], "path string, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(path" in plan and "Join" not in plan


def commented(text, sign):
    lines = textwrap.wrap(text, 70)
    return "\n".join(f"{sign} {x}" for x in lines)


def test_headers_and_licence_texts_are_found(spark):
    texts = license_texts.TEXTS
    code = "\n\nimport os\n\ndef f(x):\n    return x + 1  # the same\n"
    cases = {
        "MIT": [texts["MIT"][0].replace("year holder", "2019 Jane Roe"), "Copyright (c) 2020 J. Doe\n\n" + textwrap.fill(texts["MIT"][1]) + "\n\n" + textwrap.fill(texts["MIT"][2]), "// Licensed under the MIT license." + code, "# SPDX-License-Identifier: MIT" + code],
        "Apache-2.0": [commented(texts["Apache-2.0"][0], "//") + code, "/*\n" + commented(texts["Apache-2.0"][0], " *") + "\n *\n" + commented(texts["Apache-2.0"][1], " *") + "\n */" + code, "# SPDX-License-Identifier: Apache-2.0"],
        "BSD-3-Clause": [textwrap.fill(texts["BSD-3-Clause"][0].replace("year, holder", "1999, The Regents"))],
        "BSD-2-Clause": [commented(texts["BSD-2-Clause"][0].replace("year, holder", "2001 X Y"), "--")],
        "GPL-3.0": [commented(texts["GPL-3.0"][0], "#") + code, "words before\n" + "This work is licensed under the GNU General Public License, version 3."],
        "GPL-2.0": [commented(texts["GPL-2.0"][0], "*") + code],
        "LGPL-2.1": [commented(texts["LGPL-2.1"][0], ";") + code],
        "MPL-2.0": [commented(texts["MPL-2.0"][0], "%") + code],
        "ISC": ["Copyright 2000 Someone\n\n" + textwrap.fill(texts["ISC"][0]) + code],
        "CC-BY-NC-4.0": ["text\nLicensed under CC BY-NC 4.0."],
        "CC-BY-4.0": ["CC BY 4.0"],
    }
    rows = [(f"{name}/{i}/f", x) for name, found in cases.items() for i, x in enumerate(found)]
    # whole licence files, where the machine has them
    folder = "/usr/share/common-licenses"
    for name, file in (("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("BSD-3-Clause", "BSD")):
        if os.path.exists(f"{folder}/{file}"):
            with open(f"{folder}/{file}") as f:
                rows.append((f"{name}/whole/LICENSE", f.read()))
            rows.append((f"{name}/whole/src/main.c", "int main() { return 0; }"))
    rows += [("none/a", code), ("none/b", "the licence of this work is unknown, as is the version of the program"), ("none/c", "word " * 50_000)]
    got = {r.path: r for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {p: r.licence for p, r in got.items()} == {p: None if p.startswith("none") else p.split("/")[0] for p, _ in rows}
    assert all(r.origin == "inherited" and r.source_path.endswith("whole/LICENSE") for p, r in got.items() if p.endswith("main.c"))


def test_scores_equal_brute_force(spark):
    """Lines, blocks and wholes of texts with parts of templates, as the SQL is too slow on whole tables of such texts."""
    templates = licenses.all_templates()
    idf, vectors = licenses.weights(templates)
    rng, rows = random.Random(6), []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            w = [x for x in rng.choice(templates)[1].split() if rng.random() > rng.choice([0, 0.05, 0.3])]
            parts.append(rng.choice(["\n", " "]).join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9)))
            parts.append(rng.choice(["\n", "\n\n", "\n * \n#\n", " plain words \n", "\n---\n"]))
        rows.append((f"d{i}", "".join(parts)))
    expected = {}
    for path, text in rows:
        blocks = re.split(licenses.BLANK.replace("(", "(?:"), text)
        units = [(0, k, x) for k, x in enumerate(text.split("\n"))] + [(1, k, x) for k, x in enumerate(blocks) if "\n" in x] + [(2, 0, text)] * (len(blocks) > 1)
        found = []
        for kind, place, x in units:
            score, _ = best_of(x, idf, vectors, licenses.unknown_idf(templates))
            names = [n for n, v in vectors if best_of(x, idf, [(n, v)], licenses.unknown_idf(templates))[0] == score]
            if score >= licenses.LEAST:
                found.append((-score, kind, place, min(names)))
        if found:
            score, kind, place, name = min(found)
            expected[path] = (name, kind, place, -score)
    got = {r.path: (r.licence, r.kind, r.place, r.score) for r in licenses.notices(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in expected.items()}
    assert all(abs(got[k][3] - expected[k][3]) < 2e-6 for k in got) and len(got) > 50
