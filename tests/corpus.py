"""A small corpus of our own for tests: two books with headings, a bridge, a label, notes and word attributes."""

GEN = r"""\id GEN A small book
\h Beginnings
\toc1 The Book of Beginnings
\toc2 Beginnings
\toc3 Beg
\mt1 Beginnings
\cl Chapter
\c 1
\s1 The light
\p
\v 1 At first there was a river and a stone.
\v 2 The River ran \nd dark\nd* by night.\f + \ft a note about water\f*
\s1 The trees
\b
\s2 By the river
\p
\v 3-4 Then trees grew, tree by tree,
\q1 and the stone slept
\p
\v 5 until \w morning|lemma="dawn light"\w* came to the stone, the stone.
\c 2
\p
\v 1 A second day, a second stone.
"""
EXO = r"""\id EXO Another
\h Roads
\c 1
\p
\v 1 A road went out of the river valley.
\v 2 Two roads, one stone.
\c 3
\p
\v 1 The last road.
"""
CONFIG = r"""
display_name = "Small"
text_direction = "ltr"
book_order = ["GEN", "EXO"]
[book_aliases]
common = { First = ["1", "One"] }
[book_aliases.books]
GEN = ["Start", ["First", ["Book", "Bk"]]]
[search]
languages = ["eng"]
ignored_words = ["the", "The", "a"]
[[footnotes.river]]
bible_ranges = [["GEN 1", "EXO 1"]]
footnote = "\\f +\\ft A river.\\f*"
[[footnotes."second stone"]]
bible_ranges = ["GEN 2:1"]
footnote = "\\f +\\ft Stones.\\f*"
"""


def write(root) -> str:
    folder = root / "corpora" / "small"
    folder.mkdir(parents=True)
    (folder / "01-GEN.usfm").write_text(GEN)
    (folder / "02-EXO.usfm").write_text(EXO)
    (folder / "corpus.toml").write_text(CONFIG)
    (folder / "cover.png").write_bytes(b"x")
    (folder / "notes.doc").write_bytes(b"x")
    return str(root / "corpora")
