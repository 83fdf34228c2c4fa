"""JSON documents as node rows in the JVM: the same rows as usj.flatten gives, without a Python worker.

The text is parsed once into a VARIANT. Spark's types do not recurse, so a tree is walked level by level: a fold keeps the nodes of the lowest level so far and goes on to their
children until there are none. Then the nodes are sorted by their paths, which is page order, and the last node below each is read off the depths: among the
nodes of its depth or less it is the one before the next. A file is one row until its nodes are exploded; nothing is shuffled. Checks are made node by
node, and the first fault in page order makes the file one error row, as in usj.check.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markers import CELLS, CONTENT, TITLES
from ..functions.markers import parse_marker as parse_one
from .usj import INDEXED, KNOWN, NEEDS, NODE_FIELDS

#: Levels of a tree that the walk is ready for; JSON itself is read to a thousand.
DEPTH = 1000
#: The same in folds of so many levels: a fold copies all it holds at each step, done or not, and most trees end in the first.
FOLDS = (8, 24, 96, 384, 488)
KEYS = ("type", "marker", "number", "altnumber", "pubnumber", "sid", "code", "caller", "category", "align")
NAMES = [f.strip().split(" ")[0] for f in NODE_FIELDS.replace("map<string,string>", "map").split(",")]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Numbers and markers --------------------------------------------------------------------------------------------------


def _numerals() -> tuple[str, dict[str, str]]:
    """Signs of numbers that are no \\p{N}, and what signs of numbers become in ASCII digits."""
    signs = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and c.isnumeric()]
    plain = {c: p for c in signs if (p := unicodedata.normalize("NFKD", c)) != c and p.isascii() and p.isdigit()}
    return "".join(c for c in signs if unicodedata.category(c)[0] != "N"), plain


LETTERS, PLAIN = _numerals()
NUMERAL = rf"[\p{{N}}{LETTERS}]"
#: Numbers as nearly all are written; a sign before the end of a line is not among them.
SIMPLE = r"^[0-9]{1,3}\z"


def _number(c: Column) -> Column:
    """A SIMPLE number from 1 to 255."""
    return let(c.cast("int"), lambda n: F.when(n.between(1, 255), n))


def digits(c: Column) -> Column:
    """A number from 1 to 255 in digits, those of other forms (circled, raised) among them; else null."""
    one = {k: v for k, v in PLAIN.items() if len(v) == 1}
    several = {k: v for k, v in PLAIN.items() if len(v) > 1}

    def of(c: Column) -> Column:
        spread = c
        for k, v in several.items():
            spread = F.replace(spread, F.lit(k), F.lit(v))
        whole = F.when(c.rlike(f"[{''.join(several)}]"), spread).otherwise(c)
        plain = F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(whole, "".join(one), "".join(one.values()))).otherwise(c)
        n = F.regexp_extract(plain, r"^0*([0-9]{1,3})$", 1).try_cast("int")
        return F.when(c.rlike(SIMPLE), _number(c)).otherwise(let(n, lambda n: F.when(n.between(1, 255), n)))

    return let(c, of)


def verse_range(c: Column) -> Column:
    """(first, last) of `5` or `5-7`, each possibly null; letters around the numbers are dropped."""
    bare = lambda s: digits(F.regexp_extract(s, f"(?s)({NUMERAL}.*{NUMERAL}|{NUMERAL})", 1))

    def of(parts: Column) -> Column:
        both = lambda first: F.struct(first.alias("first"), F.when(F.size(parts) > 1, bare(F.get(parts, F.lit(1)))).otherwise(first).alias("last"))
        return let(let(bare(parts[0]), both), lambda r: F.when(r["first"] <= r["last"], r))

    one = lambda n: F.when(n.isNotNull(), F.struct(n.alias("first"), n.alias("last")))
    return F.when(c.rlike(SIMPLE), let(_number(c), one)).otherwise(let(F.split(c, "-", 2), of))


def parse_marker(c: Column) -> Column:
    """(base, low, error) of a content marker, as markers.parse_marker has them: the kind of an error, or the base and its first number."""
    tops = F.expr("map(" + ", ".join(f"'{m}', {n}" for m, n in CONTENT.items()) + ")")
    shape = r"^([a-z]+?)([0-9]*)(?:-(?:([0-9]*)|([se])))?$"
    part = lambda k: F.regexp_extract(c, shape, k)
    number = lambda s: F.coalesce(s.try_cast("long"), F.lit(1 << 40))

    def of(x: Column) -> Column:
        low = F.when(x["number"] != "", number(x["number"])).otherwise(F.when(x["top"] > 0, 1))
        high = F.when(x["second"] != "", number(x["second"])).otherwise(low)
        ok = (x["top"] > 0) & low.between(1, x["top"]) & high.between(low, x["top"])
        error = (
            F.when(x["top"].isNull(), F.when(F.element_at(tops, c).isNull(), "unknown"))
            .when(x["side"] != "", "unknown")
            .when(c.contains("-") & (~x["base"].isin(*CELLS) | (x["second"] == "") | (x["number"] == "")), "number")
            .when((x["number"] != "") & ~ok, "range")
        )
        # a name that ends in digits is whole, without a number
        return let(error, lambda e: F.struct(F.when(e.isNull(), F.when(x["top"].isNull(), c).otherwise(x["base"])).alias("base"), F.when(e.isNull(), low).cast("int").alias("low"), e.alias("error")))

    return let(F.struct(F.element_at(tops, part(1)).alias("top"), part(1).alias("base"), part(2).alias("number"), part(3).alias("second"), part(4).alias("side")), of)


def _fine(marker: str) -> bool:
    try:
        return bool(parse_one(marker))
    except ValueError:
        return False


#: Markers that are right as they stand: nearly all, which need not be taken apart.
FINE = sorted(filter(_fine, (f"{m}{k or ''}" for m, top in CONTENT.items() for k in range(top + 1))))


def marker_fault(c: Column) -> Column:
    """The message of markers.parse_marker for a marker that is none; null for one that is."""
    return F.when(~F.coalesce(c.isin(*FINE), F.lit(False)), let(parse_marker(c), lambda m: F.when(m["error"].isNotNull(), F.concat(m["error"], F.lit(" marker '"), c, F.lit("'")))))


# The walk -------------------------------------------------------------------------------------------------------------


def _missing(x: Column, node: Column) -> Column:
    """The message for the first key that a kind needs and a node lacks."""
    out = F.lit(None).cast("string")
    kind = x["type"]
    needed = F.expr("map(" + ", ".join(f"'{k}', array({', '.join(repr(n) for n in need)})" for k, need in NEEDS.items() if need) + ")")
    lacks = F.filter(F.coalesce(F.element_at(needed, kind), F.array().cast("array<string>")), lambda key: ~F.map_contains_key(node, key))
    return F.when(F.size(lacks) > 0, F.concat(kind, F.lit(" without "), F.get(lacks, F.lit(0)))).otherwise(out)


def _fault(x: Column, node: Column, depth: Column) -> Column:
    kind = x["type"]
    known = F.coalesce(kind.isin(*NEEDS), F.lit(False)) & ((depth > 0) | (kind == "USJ"))
    number = F.when((kind == "chapter") & digits(x["number"]).isNull() | (kind == "verse") & verse_range(x["number"]).isNull(), F.concat(kind, F.lit(" number '"), F.coalesce(x["number"], F.lit("")), F.lit("'")))
    many = F.when(kind.isin("book", "figure", "ref") & (F.size(x["content"]) > 1), F.concat(kind, F.lit(" with more than one text")))
    return F.when(~known, "a document is a tree of known nodes under one USJ root").otherwise(F.coalesce(_missing(x, node), F.when(kind.isin("para", "char", "table:cell"), marker_fault(x["marker"])), F.when(kind.isin("chapter", "verse"), number), many))


def _facts(n: Column) -> Column:
    """The fields of a node (path, v, indexed, in_para), and its fault."""
    shape = "struct<" + ", ".join(f"{k}: string" for k in KEYS) + ", content: array<variant>>"
    v, path = n["v"], n["path"]

    def of(x: Column) -> Column:
        node, s, text = x["node"], x["s"], x["text"]
        kind = F.when(text.isNotNull(), "text").otherwise(s["type"])
        base = F.rtrim(s["marker"], F.lit("0123456789"))
        span = F.when(kind == "verse", verse_range(s["number"])).when(kind == "chapter", let(digits(s["number"]), lambda n: F.struct(n.alias("first"), n.alias("last"))))
        attrs = F.transform_values(F.map_filter(node, lambda k, _: ~k.isin(*KNOWN)), lambda _, a: F.when(F.substring(F.to_json(a), 1, 1) == '"', a.cast("string")).otherwise(F.to_json(a)))
        return F.struct(
            path.alias("path"), F.size(path).alias("depth"), kind.alias("type"), s["marker"].alias("marker"), base.alias("marker_base"), text.alias("text"), s["number"].alias("number_str"), span["first"].alias("number_first"), span["last"].alias("number_last"),
            s["altnumber"].alias("alt_number"), s["pubnumber"].alias("pub_number"), s["sid"].alias("sid"), s["code"].alias("code"), s["caller"].alias("caller"), s["category"].alias("category"), s["align"].alias("align"),
            F.coalesce(attrs, F.create_map().cast("map<string,string>")).alias("attrs"), _title(kind, s["marker"]).alias("is_title"), n["indexed"].alias("is_index"), F.coalesce(F.size(s["content"]), F.lit(0)).alias("child_count"), n["in_para"].alias("in_para"),
            F.when(text.isNull(), _fault(s, node, F.size(path))).alias("fault"),
        )

    # a text is a string; what is neither that nor an object has no type, which is a fault
    text = F.when((F.size(path) > 0) & (F.schema_of_variant(v) == "STRING"), v.cast("string"))

    def parted(t: Column) -> Column:
        other = t.isNull()
        return F.struct(F.when(other, v.try_cast("map<string,variant>")).alias("node"), F.when(other, F.try_variant_get(v, "$", shape)).alias("s"), t.alias("text"))

    return let(let(text, parted), of)


def _title(kind: Column, marker: Column) -> Column:
    return F.coalesce((kind == "para") & F.rtrim(marker, F.lit("0123456789")).isin(*TITLES), F.lit(False))


NODE = "struct<path: array<int>, v: variant, indexed: boolean, in_para: boolean>"


def _nodes(tree: Column) -> Column:
    """All nodes of a tree, level by level."""
    root = F.struct(F.array().cast("array<int>").alias("path"), tree.alias("v"), F.lit(True).alias("indexed"), F.lit(False).alias("in_para"))

    def children(n: Column) -> Column:
        own = F.try_variant_get(n["v"], "$", "struct<type: string, marker: string, content: array<variant>>")

        def of(x: Column) -> Column:
            below = n["indexed"] & F.coalesce(x["type"].isin(*INDEXED), F.lit(False)) & ~_title(x["type"], x["marker"])
            return F.transform(x["content"], lambda c, i: F.struct(F.concat(n["path"], F.array(i)).alias("path"), c.alias("v"), below.alias("indexed"), F.coalesce(x["type"] == "para", F.lit(False)).alias("in_para")))

        return F.coalesce(let(own, of), F.array().cast(f"array<{NODE}>"))

    def level(done: Column, _: Column) -> Column:
        now = done["now"]
        return F.when(F.size(now) == 0, done).otherwise(F.struct(F.flatten(F.transform(now, children)).alias("now"), F.concat(done["all"], now).alias("all")))

    start = F.struct(F.array(root).cast(f"array<{NODE}>").alias("now"), F.array().cast(f"array<{NODE}>").alias("all"))

    def levels(done: Column, width: Column) -> Column:
        return F.when(F.size(done["now"]) == 0, done).otherwise(F.aggregate(F.sequence(F.lit(1), width), done, level))

    return F.aggregate(F.array(*map(F.lit, FOLDS)), start, levels, lambda done: done["all"])


def _lasts(depths: Column) -> Column:
    """For nodes in page order, of these depths, the place of the last one below each."""

    def of_depth(d: Column) -> Column:
        def ends(places: Column) -> Column:
            each = F.transform(places, lambda p, k: F.struct(p.alias("at"), (F.coalesce(F.get(places, k + 1), F.size(depths)) - 1).alias("last")))
            return F.filter(each, lambda x: F.get(depths, x["at"]) == d)

        return let(F.filter(F.sequence(F.lit(0), F.size(depths) - 1), lambda p: F.get(depths, p) <= d), ends)

    return F.transform(F.array_sort(F.flatten(F.transform(F.sequence(F.lit(0), F.array_max(depths)), of_depth))), lambda x: x["last"])


def parse_trees(files: DataFrame) -> DataFrame:
    """JSON files (corpus_id, path, text) as the rows of nodes.parse_files: node rows, or one error for a file that cannot be read."""
    parsed = files.select("corpus_id", F.col("path").alias("path_name"), F.try_parse_json("text").alias("tree"))
    walked = parsed.select("corpus_id", "path_name", F.when(F.col("tree").isNotNull(), _nodes(F.col("tree"))).alias("nodes"))
    # a VARIANT has no order, so that paths are sorted with the places of their nodes
    in_order = F.array_sort(F.transform("nodes", lambda n, i: F.struct(n["path"].alias("path"), i.alias("at"))))
    facts = walked.select("corpus_id", "path_name", F.transform(in_order, lambda x: let(F.get("nodes", x["at"]), _facts)).alias("rows"))
    fault = F.when(F.col("rows").isNull(), "the file is no JSON").otherwise(F.get(F.filter("rows", lambda r: r["fault"].isNotNull()), F.lit(0))["fault"])
    code = F.get(F.filter("rows", lambda r: r["type"] == "book"), F.lit(0))["code"]
    told = facts.select("corpus_id", "path_name", fault.alias("fault"), code.alias("code_found"), "rows")
    fine = F.col("fault").isNull()
    # worked out once, not for each node again
    lasts = let(F.transform("rows", lambda r: r["depth"]), _lasts)
    told = told.select("corpus_id", "path_name", "fault", F.when(fine, F.col("code_found")).alias("code_found"), F.when(fine, F.arrays_zip(F.col("rows").alias("r"), lasts.alias("last"))).alias("rows"))
    each = told.select("corpus_id", "path_name", "code_found", "fault", F.posexplode_outer("rows").alias("seq", "row"))
    places = {"seq": F.col("seq"), "last": F.col("row.last")}
    types = {f.strip().split(" ")[0]: f.strip().split(" ")[1] for f in NODE_FIELDS.replace("map<string,string>", "map").split(",")}
    nodes = [places.get(c, F.col(f"row.r.{c}")).cast("map<string,string>" if types[c] == "map" else types[c]).alias(c) for c in NAMES]
    return each.select("corpus_id", "path_name", "code_found", *nodes, F.when(F.col("fault").isNotNull(), "error").alias("severity"), F.col("fault").alias("message"), F.lit(None).cast("int").alias("position"))
