"""Short links: lists of references, stored under an id or carried by the code itself.

Links are in Parquet files, or in a table of a SQL database by JDBC. Ids are claimed one creator at a time: by a file that only one can make, or by the
transaction that inserts the row.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import Catalog, load
from ..functions.codec import CodecError, base59_decode, base59_encode, decode_number, encode_number
from ..functions.references import Reference, display, parse_references
from ..sources.store import Store

SCHEMA = "id long, refs_key string, refs array<struct<book_ord:int,chapter:int,v_first:int,v_last:int>>"
STEP = 4000


class LinkError(ValueError):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def choose(stored: int | None, top: int, number: int | None, read_only: bool, offensive: Callable[[str], bool]) -> tuple[str, int]:
    """(kind, value) that a list of references gets: the id it is stored under, its own number if that is short, or the next id that may be given out.

    top is the largest id in use, number that of the list's code, if it has one.
    """
    if stored is not None:
        return "id", stored
    if number is not None and (number < top + 1 or read_only) and not offensive(base59_encode(number)):
        return "encoded", number
    if read_only:
        raise LinkError(409, "the links cannot be written, and the list has no code")
    new = top + 1
    while offensive(base59_encode(new)):
        new += STEP
    return "new", new


#: Words that no code should spell, whatever signs stand for their letters; a list of one's own may take its place.
OFFENSIVE = ("anal", "anus", "arse", "bitch", "cock", "cunt", "dick", "fuck", "nazi", "piss", "porn", "rape", "shit", "slut", "tits", "twat", "whore")
ALIKE = str.maketrans("013457895", "oleastbgs")


def offensive(code: str) -> bool:
    """Whether a code of more than one sign spells an offensive word."""
    plain = code.lower().translate(ALIKE)
    return len(code) > 1 and any(w in plain or w in plain.replace("l", "i") for w in OFFENSIVE)


class ParquetLinks:
    """Links in Parquet files, a folder for each id, so that creators do not meet. The file of an id in `_claims` can be made by one of them only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.files = Store(spark, path)

    def table(self) -> DataFrame:
        if not any(name.endswith(".parquet") for name in self.files.listing()):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(self.path)

    def add(self, new: int, key: str, refs: list[Reference]) -> bool:
        """Whether the id was free; if so, the list is stored under it."""
        if not self.files.claim(f"_claims/{new}"):
            return False
        row = [(new, key, [(r.book, r.chapter, r.first, r.last) for r in refs])]
        self.spark.createDataFrame(row, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/link-{new}")
        return True


class JdbcLinks:
    """Links in a table (id bigint primary key, refs_key varchar) of a SQL database; reading pushes its conditions down."""

    def __init__(self, spark: SparkSession, url: str, name: str = "short_links"):
        self.spark, self.url, self.name = spark, url, name

    def table(self) -> DataFrame:
        rows = self.spark.read.jdbc(self.url, self.name)
        columns = {c.lower(): c for c in rows.columns}
        part = lambda x, i: F.split(x, r"\.")[i].cast("int")
        refs = F.transform(F.split("refs_key", r"\|"), lambda x: F.struct(part(x, 0).alias("book_ord"), part(x, 1).alias("chapter"), part(x, 2).alias("v_first"), part(x, 3).alias("v_last")))
        return rows.select(F.col(columns["id"]).alias("id"), F.col(columns["refs_key"]).alias("refs_key")).withColumn("refs", refs)

    def add(self, new: int, key: str, refs: list[Reference]) -> bool:
        """One transaction; an id that is there already is another creator's."""
        jvm = self.spark._jvm
        con = jvm.java.sql.DriverManager.getConnection(self.url)
        try:
            con.setAutoCommit(False)
            insert = con.prepareStatement(f"INSERT INTO {self.name} (id, refs_key) VALUES (?, ?)")
            insert.setLong(1, new)
            insert.setString(2, key)
            try:
                insert.executeUpdate()
            except Py4JJavaError as e:
                con.rollback()
                if isinstance_of(e, jvm, "java.sql.SQLIntegrityConstraintViolationException"):
                    return False
                raise
            con.commit()
            return True
        finally:
            con.close()


def isinstance_of(e: Py4JJavaError, jvm, name: str) -> bool:
    return jvm.java.lang.Class.forName(name).isInstance(e.java_exception)


class LinkStore:
    """Links in a folder, or wherever `links` keeps them; `forbidden` tells codes that must not be given out."""

    def __init__(self, spark: SparkSession, path: str | ParquetLinks | JdbcLinks, catalog: Catalog | None = None, read_only: bool = False, forbidden: Callable[[str], bool] | None = None):
        self.spark, self.links, self.catalog = spark, ParquetLinks(spark, path) if isinstance(path, str) else path, catalog or load()
        self.read_only, self.forbidden = read_only, forbidden or offensive

    def create(self, text: str) -> dict:
        """{type, value}: the id of a stored list, the code of a short one, or a new id; ids that spell offence are passed over."""
        parts = parse_references(text, self.catalog)
        if not parts or any(p.error for p in parts):
            raise LinkError(400, "; ".join(p.message for p in parts if p.error) or "no references")
        refs = [p.reference for p in parts]
        key = "|".join(f"{r.book}.{r.chapter}.{r.first}.{r.last}" for r in refs)
        known = self.links.table()
        there = known.where(F.col("refs_key") == key).agg(F.min("id")).first()[0]
        top = known.agg(F.max("id")).first()[0] or 0
        try:
            number = encode_number(refs, self.catalog)
        except CodecError as e:
            if e.kind != "too_big":
                raise LinkError(400, str(e)) from e
            number = None
        kind, value = choose(there, top, number, self.read_only, self.forbidden)
        while kind == "new":
            if self.links.add(value, key, refs):
                kind = "id"
            else:  # another creator was faster
                kind, value = choose(None, value, None, False, self.forbidden)
        return {"type": kind, "value": base59_encode(value)}

    def resolve(self, kind: str, value: str) -> list[str]:
        try:
            number = base59_decode(value)
            refs = decode_number(number, self.catalog) if kind == "encoded" else None
        except CodecError as e:
            raise LinkError(400, str(e)) from e
        if refs is None:
            row = self.links.table().where(F.col("id") == number).select("refs").first() if number < 2**63 else None
            if row is None:
                raise LinkError(404, f"no link {value!r}")
            refs = [Reference(*r) for r in row["refs"]]
        return [display(r, self.catalog) for r in refs]
