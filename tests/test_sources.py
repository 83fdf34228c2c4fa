from __future__ import annotations

import json
import zipfile

import corpus
import pytest

from lectern.operators import nodes as nd
from lectern.sources import files, usfm, usj


def test_notes():
    """A note in a text is the note that read_note gives, whatever characters it holds."""
    for caller, body, want in (
        ("+", r"\ft of old \tl selah\tl* and so on", [{"type": "char", "marker": "ft", "content": ["of old ", {"type": "char", "marker": "tl", "content": ["selah"]}, " and so on"]}]),
        ("-", r"\fr 2.4 \ft see there", [{"type": "char", "marker": "fr", "content": ["2.4 "]}, {"type": "char", "marker": "ft", "content": ["see there"]}]),
    ):
        note = usfm.read_note(rf"\f {caller} {body}\f*")
        assert (note["type"], note["marker"], note["caller"], note["content"]) == ("note", "f", caller, want)
        tree, said = usfm.read_usfm(f"\\id GEN\n\\c 1\n\\p\n\\v 1 before \\f {caller} {body}\\f* after")
        assert said == [] and note in tree["content"][2]["content"]
    for text, kind in ((r"\x - \xt one\x*\x - \xt two\x* three", "length"), (r"\q1 a line", "not_a_note")):
        with pytest.raises(usfm.NoteError) as e:
            usfm.read_note(text)
        assert e.value.kind == kind


def test_defaults_and_diagnostics():
    tree, said = usfm.read_usfm("\\id gen\n\\c x\n\\p\n\\v y text \\zz odd\\zz*\n\\q9 far")
    kinds = [n["type"] for n in tree["content"]]
    assert kinds == ["book", "chapter", "para", "para"] and tree["content"][1]["number"] == "1"
    assert tree["content"][3]["marker"] == "p" and {d["severity"] for d in said} == {"warning", "error"}


def test_tables_sidebars_milestones_attributes():
    text = "\\id GEN\n\\c 1\n\\p\n\\v 1 a \\w gnat|lemma=\"gnats\"\\w* b // c \\qt1-s |who=\"x\"\\*d\n\\tr \\th1 H\\tcr2 R\n\\tr \\tc1 x\n\\esb \\cat p\\cat*\n\\p in\n\\esbe\n\\p out \\fig cap|src=\"a.jpg\"\\fig*"
    tree, said = usfm.read_usfm(text)
    assert said == []
    content = tree["content"]
    assert [n["type"] for n in content] == ["book", "chapter", "para", "table", "sidebar", "para"]
    inline = content[2]["content"]
    assert inline[2] == {"type": "char", "marker": "w", "content": ["gnat"], "lemma": "gnats"}
    assert [x["type"] for x in inline if isinstance(x, dict)] == ["verse", "char", "optbreak", "ms"]
    assert [(c["marker"], c["align"]) for c in content[3]["content"][0]["content"]] == [("th1", "start"), ("tcr2", "end")]
    assert content[5]["content"][-1] == {"type": "figure", "marker": "fig", "content": ["cap"], "src": "a.jpg"}


def test_json_documents_are_checked():
    good = {"type": "USJ", "version": "3.1", "content": [{"type": "chapter", "marker": "c", "number": "1"}, {"type": "para", "marker": "p", "content": ["x"]}]}
    assert usj.read_json(json.dumps(good)) == good
    for bad in ("[]", "{", '{"type": "para"}', '{"type": "USJ", "content": [{"type": "para", "marker": "nope"}]}', '{"type": "USJ", "content": [{"type": "chapter", "number": "0"}]}', '{"type": "USJ", "content": [{"type": "odd"}]}'):
        with pytest.raises(usj.DocumentError):
            usj.read_json(bad)


def test_flatten_and_nest_are_inverse():
    for text in (corpus.GEN, corpus.EXO):
        tree, _ = usfm.read_usfm(text)
        (back,) = usj.nest(usj.flatten(tree))
        strip = lambda n: n if isinstance(n, str) else {k: ([strip(c) for c in v] if k == "content" else v) for k, v in n.items() if not (k == "content" and not v)}
        assert strip(back) == strip(tree)


def test_files_folders_and_zips(spark, tmp_path):
    root = corpus.write(tmp_path)
    with zipfile.ZipFile(f"{root}/packed.zip", "w") as z:
        z.writestr("a/01.USFM", corpus.EXO)
        z.writestr("a/", "")
        z.writestr("b.txt", "x")
    found = files.read_files(spark, root)
    assert sorted((r["corpus_id"], r["path"], r["kind"]) for r in found.select("corpus_id", "path", "kind").collect()) == [
        ("packed", "a/01.USFM", "usfm"), ("packed", "b.txt", "other"), ("small", "01-GEN.usfm", "usfm"), ("small", "02-EXO.usfm", "usfm"), ("small", "corpus.toml", "config"), ("small", "cover.png", "image"), ("small", "notes.doc", "other"),
    ]
    assert files.read_files(spark, root, frozenset(["packed"])).where("corpus_id = 'packed'").count() == 0
    assert sorted(r["path"] for r in files.skipped(found).collect()) == ["b.txt", "notes.doc"]


def test_the_first_file_of_a_book_counts(spark, tmp_path):
    root = corpus.write(tmp_path)
    (tmp_path / "corpora" / "small" / "09-GEN-again.usfm").write_text("\\id GEN\n\\c 1\n\\p\n\\v 1 other")
    (tmp_path / "corpora" / "small" / "10.usj").write_text("{")
    parsed = nd.parse_files(files.documents(files.read_files(spark, root)))
    assert {(r["path_name"], r["ignored"]) for r in nd.books_of(parsed).collect()} == {("01-GEN.usfm", False), ("02-EXO.usfm", False), ("09-GEN-again.usfm", True)}
    assert {(r["path"], r["severity"]) for r in nd.diagnostics(parsed).collect()} == {("09-GEN-again.usfm", "warning"), ("10.usj", "error")}
    assert nd.nodes(parsed).where("text = 'other'").count() == 0


def test_data_source(spark, tmp_path):
    from lectern.sources.datasource import register

    root = corpus.write(tmp_path)
    register(spark)
    df = spark.read.format("usfm").load(root)
    assert {r[0] for r in df.select("code").distinct().collect()} == {"GEN", "EXO"}
    assert df.where("code = 'EXO' and type = 'verse'").count() == 3


def test_a_batch_of_many_files_is_given_out_in_parts(spark):
    """A worker holds the rows of a part, not those of all files that came together."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    text = json.dumps({"type": "USJ", "version": "3.1", "content": [{"type": "book", "marker": "id", "code": "GEN"}, *[{"type": "para", "marker": "p", "content": ["x"], "n": "y"} for _ in range(500)]]})
    n = 60
    batch = pa.RecordBatch.from_pydict({"corpus_id": ["a"] * n, "path": [f"{i}.usj" for i in range(n)], "kind": ["usj"] * n, "text": [*[text] * (n - 1), "{"]})
    schema = to_arrow_schema(nd.parse_files(spark.createDataFrame([], "corpus_id string, path string, kind string, text string")).schema)
    sizes, paths = [], set()
    for part in nd.read_batches(iter([batch]), schema):
        sizes.append(part.num_rows)
        paths |= set(part.column("path_name").to_pylist())
    assert sum(sizes) == (n - 1) * 1002 + 1 and max(sizes) <= nd.AT_ONCE and len(paths) == n
