"""Trees walked in the JVM: the rows, faults and numbers that the Python reader gives."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from lectern.functions import markers
from lectern.operators.nodes import parse_files
from lectern.sources import usj_variant as uv

FILES = "corpus_id string, path string, kind string, text string"


def tree(r: random.Random, depth: int = 0) -> dict | str:
    kind = r.choice(["para", "char", "note", "verse", "chapter", "ms", "table", "table:row", "table:cell", "sidebar", "figure", "ref", "periph", "optbreak", "text", "text"])
    if kind == "text":
        return r.choice(["", "plain", "Ünï “q” \\ \n", '"quoted"', "{", "[1]", "null", "5"])
    node: dict = {"type": kind}
    if kind in ("para", "char", "table:cell", "ms", "note"):
        node["marker"] = {"para": r.choice(["p", "s1", "q2", "mt", "r"]), "char": r.choice(["w", "nd"]), "table:cell": r.choice(["tc1", "thr2", "tc1-3"]), "ms": "qt-s", "note": "f"}[kind]
    if kind in ("verse", "chapter"):
        node["number"] = r.choice(["1", "12", "3-5", "4a", "⑤", "²", "⑫-⑬"] if kind == "verse" else ["1", "①", "255"])
    if kind == "note":
        node["caller"] = "+"
    for key in ("sid", "altnumber", "pubnumber", "category", "align", "lemma", "x-own"):
        if r.random() < 0.15:
            node[key] = r.choice(["a", "é", ""])
    if kind not in ("verse", "chapter", "ms", "optbreak"):
        few = 1 if kind in ("figure", "ref") else 4
        node["content"] = [] if depth > 8 else [tree(r, depth + 1) for _ in range(r.randint(0, few))]
    return node


def book(*content) -> dict:
    return {"type": "USJ", "version": "3.1", "content": [{"type": "book", "marker": "id", "code": "GEN", "content": ["about"]}, *content]}


def compare(spark, texts: list[str], with_messages: bool = True):
    files = spark.createDataFrame([("c", f"{i:04}.usj", "usj", t) for i, t in enumerate(texts)], FILES)
    key = lambda x: (x["path_name"], -1 if x["seq"] is None else x["seq"])
    ours, theirs = parse_files(files, trees_in_jvm=True), parse_files(files)
    if not with_messages:
        ours, theirs = (d.withColumn("message", F.lit("")) for d in (ours, theirs))
    assert ours.columns == theirs.columns and [f.dataType for f in ours.schema] == [f.dataType for f in theirs.schema]
    got, want = (sorted(d.collect(), key=key) for d in (ours, theirs))
    assert got == want
    return got


def test_random_trees(spark):
    r = random.Random(8)
    rows = compare(spark, [json.dumps(book(*[tree(r) for _ in range(r.randint(0, 6))]), ensure_ascii=r.random() < 0.5) for _ in range(120)])
    assert len(rows) > 800 and max(x["depth"] or 0 for x in rows) > 6


def test_faults(spark):
    para = lambda **more: book({"type": "para", "marker": "p", "content": ["x"]} | more)
    bad = [
        para(marker="zz"), para(marker="p3"), para(marker="s9"), para(marker="p-1"), book({"type": "para"}), book({"type": "char", "marker": "w"}), book({"type": "unknown"}), book({"type": "note", "marker": "f", "content": []}),
        book({"type": "chapter"}), book({"type": "chapter", "number": "0"}), book({"type": "chapter", "number": "x"}), book({"type": "verse", "number": "5-3"}), book({"type": "verse", "number": "256"}), book({"type": "ref", "content": ["a", "b"]}), {"type": "para", "marker": "p"}, {"type": "USJ"},
        book({"type": "table:cell", "marker": "tc1-"}), book({"type": "table:cell", "marker": "tc3-2"}), book({"type": "para", "marker": "p", "content": [{"type": "USJ"}]}),
    ]
    rows = compare(spark, [json.dumps(b) for b in bad])
    assert len(rows) == len(bad) and all(x["severity"] == "error" for x in rows)
    rows = compare(spark, ["", "{", "[1]", '"text"', "5", "null", json.dumps({"type": 5})], with_messages=False)
    assert all(x["severity"] == "error" for x in rows)


def test_deep_and_wide(spark):
    deep: dict | str = "x"
    for _ in range(120):
        deep = {"type": "char", "marker": "w", "content": [deep, "y"]}
    wide = [{"type": "para", "marker": "p", "content": [f"t{i}"]} for i in range(3000)]
    rows = compare(spark, [json.dumps(book(deep)), json.dumps(book(*wide))])
    assert max(x["depth"] for x in rows) == 121


def test_numbers_and_markers(spark):
    r = random.Random(2)
    texts = ["5", "5-7", "7-5", "a5b", "5a-7b", "5-", "-5", "", "0", "255", "256", "00012", "⑩", "¼", "²³", "㉑-㉕", "一5", "٣", "5-7-9", *("".join(r.choices("0123456789-ab²", k=r.randint(1, 5))) for _ in range(300))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", uv.verse_range(F.col("t")).alias("v"), uv.digits(F.col("t")).alias("d"))
    for x in df.collect():
        assert (tuple(x["v"]) if x["v"] else None) == markers.verse_range(x["t"]), x
        assert x["d"] == markers.digits(x["t"]), x
    names = [*markers.CONTENT, *(b + n for b in ("p", "q", "tc", "th", "k", "zz", "liv", "qt") for n in ("1", "5", "99", "0", "1-2", "2-1", "-", "-1", "1-", "-s", "1-e", "12-12", "99999999999999"))]
    df = spark.createDataFrame([(t,) for t in names], "t string").select("t", uv.marker_fault(F.col("t")).alias("f"), uv.parse_marker(F.col("t")).alias("m"))
    for x in df.collect():
        try:
            m = markers.parse_marker(x["t"])
            said, parsed = None, (m.base, m.low, None)
        except markers.MarkerError as e:
            said, parsed = str(e), (None, None, e.kind)
        assert x["f"] == said and tuple(x["m"]) == parsed, x


def test_ids(spark):
    texts = ["GEN 5", "GEN5", "GEN 5:10", "GEN 5:10-12", "5EZ 1:1-1", "gen 5", "GEN 5:", "GEN", "", "GEN 5:1-2-3", "In the third chapter"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", markers.sid_column(F.col("t")).alias("r"))
    for x in df.collect():
        want = markers.parse_sid(x["t"])
        assert (tuple(x["r"]) if x["r"] else None) == ((*want, markers.format_sid(*want)) if want else None), x


def test_a_fold_of_levels_is_as_deep_as_json_is_read(spark):
    """The walk copies what it holds at each step: a few steps for a tree of few levels, which took a thousand, and enough for the deepest one."""
    import time

    assert sum(uv.FOLDS) == uv.DEPTH and len(uv.FOLDS) + uv.FOLDS[0] < 20
    deep = '{"type":"char","marker":"nd","content":[' * 450 + '"end"' + "]}" * 450
    wide = ",".join(f'{{"type":"para","marker":"p","content":[{{"type":"verse","marker":"v","number":"{k % 200 + 1}"}},"text {k}"]}}' for k in range(20_000))
    tree = lambda body: f'{{"type":"USJ","version":"3.1","content":[{{"type":"book","marker":"id","code":"GEN"}},{body}]}}'
    files = spark.createDataFrame([("a", "1", tree(deep)), ("a", "2", tree(wide))], "corpus_id string, path string, text string").repartition(1)
    began = time.time()
    got = {r["path_name"]: (r["n"], r["deepest"], r["faults"]) for r in uv.parse_trees(files).groupBy("path_name").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deepest"), F.count("message").alias("faults")).collect()}
    assert got == {"1": (453, 451, 0), "2": (60_002, 2, 0)}
    assert time.time() - began < 30
