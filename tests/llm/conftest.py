from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents rows of (doc_id, text)."""

    def make(rows, columns: str = DOCS):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], columns)

    return make


@pytest.fixture(scope="session")
def sf(tmp_path_factory, spark, make_docs):
    """A folder of small tables: clean, junk, copies, near copies, leaks, notices, nulls."""
    import random

    r = random.Random(5)
    syllables = "an ti re on he the ing er ou ea st nd in at es".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    junk = lambda n: " | ".join(word() for _ in range(n))
    items = [(i, prose(25)) for i in range(6)]
    rows, labels = [], []
    base = [prose(80) for _ in range(4)]
    line = prose(12)
    for i in range(120):
        kind = i % 8
        text = junk(60) if kind == 0 else prose(40) + "\n" + line + "\n" + prose(30) if kind == 1 else base[i % 4] if kind == 2 else base[i % 4].replace(base[i % 4].split()[20], word()) if kind == 3 else prose(30) + "\n" + items[i % 6][1] + "\n" + prose(20) if kind == 4 else prose(90)
        rows.append((i, text))
        labels.append((i, 0 if kind == 0 else 1, 0))
    rows += [(500, None), (501, ""), (502, "one"), (None, prose(20)), (7, prose(70)), (7, prose(70)), (8, rows[8][1])]
    root = tmp_path_factory.mktemp("sf")
    make_docs(rows).coalesce(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)
