"""Token ids in files compressed by a Re-Pair grammar.

Documents are dealt by range of their ids and sorted within tasks; a task encodes them one after another and closes a shard every SHARD_IDS ids or so, at the end of a
document. A shard's ids become dense symbols, and then frequent pairs of neighbouring symbols are replaced by new symbols,
round after round: in a round pairs are counted exactly, and the most frequent ones are taken as long as no two of them can overlap (none begins
with what another ends with), so that replacing them at once is the same as one after another. No pair reaches over the end of a document, so each
document has symbols of its own.

The files are Parquet, written by Spark's committer, a row a shard (FILE): the shard's place (task, shard), its alphabet (dense symbol to id), its
rules (pairs of symbols; the k-th rule makes symbol len(alphabet) + k of earlier ones), the expansion length of each rule, the symbols, and for each
document its id, first symbol and first token. A symbol takes two bytes where they suffice. MANIFEST has a row a task with the ids of the tasks before it. A range of ids is
read by bisecting documents and expansion lengths and expanding its symbols alone.

Encoding is the tokenizers library's. Its model turns words to ids; what comes before (composition, lower case, the split) is done here for texts in Latin letters, with the file's
own pattern, as the library takes seven times as long for it. Any other text goes through the library whole. Tests compare both on odd texts.

Defined results: a null text counts as empty, and has the end id alone. Null ids come first; rows of equal ids follow each other by a hash of their texts, and rows that repeat have a place each. A text of any length is
one document of one shard, which may be larger for it. An empty table gives files without shards and no rows. Columns other than the id and the text are not read,
whatever their names.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, ship, store

END_ID = 1
SHARD_IDS = 1 << 20
#: A pair needs so many occurrences to become a rule, and a round so many replacements of a thousand symbols to be followed by another.
LEAST, WORTH = 12, 50
ROUNDS = 12
#: Words whose ids a worker remembers.
KNOWN = 400_000
FILE = "task int, shard int, first_token long, alphabet binary, rules binary, lengths binary, symbols binary, width int, docs array<bigint>, doc_symbols binary, doc_tokens binary, n_tokens long"


# Encoding -------------------------------------------------------------------------------------------------------------

#: What no text may hold that is encoded word by word: anything but Latin letters, common signs and the blanks that both this code and the library part words at.
ODD = re.compile("[^\t-\r -~\x85\xa0-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]")
CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f]")
ADDED = "<|"  # how the added tokens of the file begin
#: The split pattern of the vocabulary file, checked against the file when it is read.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, others from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordBpe:
    """The ids of a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        split = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] if told["pre_tokenizer"].get("pretokenizers") else None
        kinds = [n["type"] for n in (told.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = split == SPLIT and kinds == NORMALIZERS and all(t["content"].startswith(ADDED) for t in told.get("added_tokens", []))
        self.pieces = Pieces(Words(self.library.model))

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not self.by_word or ADDED in text or not text.isascii() and ODD.search(text) or text.isascii() and CONTROL.search(text):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        pieces = self.pieces
        if len(pieces) > KNOWN:
            pieces.clear()
            pieces.words.clear()
        low = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
        return b"".join([pieces[p] for p in low.split()])


class Words(dict):
    """The ids of words; one that isn't there yet is worked out and stays."""

    def __init__(self, model):
        self.model, self.letters = model, byte_letters()

    def __missing__(self, word: str) -> bytes:
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        found = self[word] = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        return found


def plain_split() -> re.Pattern:
    """SPLIT for pieces without blanks of texts without ODD characters, in classes of the re module, which is three times as fast."""
    signs = [c for c in map(chr, range(0x21, 0x2100)) if not ODD.match(c) and not c.isspace()]
    letters, numbers = ("".join(re.escape(c) for c in signs if unicodedata.category(c)[0] == k) for k in "LN")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{letters}{numbers}]+")


class Pieces(dict):
    """The ids of what stands between blanks: a word, or several by the file's pattern."""

    def __init__(self, words: Words):
        self.words, self.pattern = words, plain_split()

    def __missing__(self, piece: str) -> bytes:
        words = self.words
        found = self[piece] = words[piece] if piece.isalpha() else b"".join([words[w] for w in self.pattern.findall(piece)])
        return found


@functools.lru_cache(maxsize=2)
def bpe(path: str) -> WordBpe:
    return WordBpe(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# The grammar ----------------------------------------------------------------------------------------------------------


def chosen_pairs(keys: np.ndarray, counts: np.ndarray, bits: int, most: int) -> np.ndarray:
    """Of pairs and their counts those to replace together: by falling count, no one's first symbol another's second."""
    order = np.argsort(-counts, kind="stable")[: 4 * most]
    firsts: set[int] = set()
    seconds: set[int] = set()
    out = []
    for k in keys[order].tolist():
        a, b = k >> bits, k & ((1 << bits) - 1)
        # a pair of one symbol twice overlaps with itself only, which replace() sorts out
        if a in seconds or b in firsts:
            continue
        out.append(k)
        firsts.add(a)
        seconds.add(b)
        if len(out) == most:
            break
    return np.sort(np.array(out, dtype=keys.dtype))


def compress(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(alphabet, rules, symbols, ends) of ids whose documents end before the places `ends`; the new ends are places of symbols."""
    if int(ids.max()) < 1 << 24:  # places in a table of all ids; sorting would take longer
        there = np.zeros(int(ids.max()) + 1, dtype=bool)
        there[ids] = True
        alphabet, symbols = np.flatnonzero(there), (np.cumsum(there) - 1)[ids]
    else:
        alphabet, symbols = np.unique(ids, return_inverse=True)
    size = len(alphabet)
    narrow = size < 1 << 16
    bits, key = (16, np.uint32) if narrow else (32, np.uint64)
    most_symbols = 1 << bits
    symbols = symbols.astype(np.uint16 if narrow else np.uint32)
    last = np.zeros(len(ids), dtype=bool)
    last[ends - 1] = True
    rules: list[np.ndarray] = []
    for _ in range(ROUNDS):
        if len(symbols) < 2:
            break
        keys = (symbols[:-1].astype(key) << key(bits)) | symbols[1:]
        inner = keys[~last[:-1]]
        inner.sort()
        at = np.flatnonzero(np.concatenate(([True], inner[1:] != inner[:-1]))) if len(inner) else np.zeros(0, dtype=np.int64)
        counts = np.diff(np.append(at, len(inner)))
        often = counts >= LEAST
        room = most_symbols - size
        if not often.any() or not room:
            break
        pairs = chosen_pairs(inner[at[often]], counts[often], bits, min(room, 4096))
        before = len(symbols)
        symbols, last = replace(symbols, last, keys, pairs, size, bits)
        rules.append(np.stack([pairs >> key(bits), pairs & key(most_symbols - 1)], axis=1).astype(np.uint32))
        size += len(pairs)
        if 1000 * (before - len(symbols)) < WORTH * before:
            break
    told = np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.uint32)
    return alphabet.astype(np.uint32), told, symbols, np.flatnonzero(last) + 1


def replace(symbols: np.ndarray, last: np.ndarray, keys: np.ndarray, pairs: np.ndarray, first: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols with the k-th pair replaced by symbol first + k, from the left."""
    begins, goes_on = np.zeros(1 << bits if bits == 16 else int(symbols.max()) + 1, dtype=bool), None
    goes_on = begins.copy()
    begins[(pairs >> pairs.dtype.type(bits)).astype(np.int64)] = True
    goes_on[(pairs & pairs.dtype.type((1 << bits) - 1)).astype(np.int64)] = True
    may = np.flatnonzero(begins[symbols[:-1]] & goes_on[symbols[1:]] & ~last[:-1])
    rule = np.searchsorted(pairs, keys[may])
    rule[rule == len(pairs)] = 0
    hit = pairs[rule] == keys[may]
    may, rule = may[hit], rule[hit]
    near = np.diff(may) == 1
    if near.any():  # neighbouring hits are runs of one symbol; of them every other counts, from the left
        place = np.arange(len(may))
        since = place - np.maximum.accumulate(np.where(np.concatenate(([True], ~near)), place, 0))
        may, rule = may[since % 2 == 0], rule[since % 2 == 0]
    symbols, last = symbols.copy(), last.copy()
    symbols[may] = (first + rule).astype(symbols.dtype)
    last[may] = last[may + 1]
    stays = np.ones(len(symbols), dtype=bool)
    stays[may + 1] = False
    return symbols[stays], last[stays]


def expansion_lengths(size: int, rules: np.ndarray) -> np.ndarray:
    """How many ids each symbol stands for, by symbol."""
    out = np.ones(size + len(rules), dtype=np.int64)
    for at, (a, b) in enumerate(rules.tolist(), size):
        out[at] = out[a] + out[b]
    return out


class Shard:
    """A row of the files, read."""

    def __init__(self, row: dict):
        self.task, self.shard, self.first_token = row["task"], row["shard"], row["first_token"]
        self.alphabet = np.frombuffer(row["alphabet"], dtype="<u4")
        self.rules = np.frombuffer(row["rules"], dtype="<u4").reshape(-1, 2)
        self.symbols = np.frombuffer(row["symbols"], dtype=f"<u{row['width']}")
        self.lengths = np.concatenate((np.ones(len(self.alphabet), dtype=np.int64), np.frombuffer(row["lengths"], dtype="<u4")))
        self.docs = row["docs"]
        self.doc_symbols = np.append(np.frombuffer(row["doc_symbols"], dtype="<u8"), len(self.symbols)).astype(np.int64)
        self.doc_tokens = np.append(np.frombuffer(row["doc_tokens"], dtype="<u8"), row["n_tokens"]).astype(np.int64)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that some symbols stand for: rules are undone level by level."""
        size = len(self.alphabet)
        symbols = symbols.astype(np.int64)
        while len(big := np.flatnonzero(symbols >= size)):
            takes = np.ones(len(symbols), dtype=np.int64)
            takes[big] = 2
            at = np.cumsum(takes) - takes
            out = np.empty(len(symbols) + len(big), dtype=np.int64)
            out[at] = symbols
            pair = self.rules[symbols[big] - size]
            out[at[big]], out[at[big] + 1] = pair[:, 0], pair[:, 1]
            symbols = out
        return self.alphabet[symbols]

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.doc_symbols[k] : self.doc_symbols[k + 1]])

    def between(self, start: int, stop: int) -> np.ndarray:
        """The ids from place `start` of the shard up to `stop`; only the symbols that hold them are expanded."""
        start, stop = max(start, 0), min(stop, int(self.doc_tokens[-1]))
        if start >= stop:
            return self.alphabet[:0]
        # whole documents before are passed over; within the range's documents, symbols by their expansion lengths
        a = int(np.searchsorted(self.doc_tokens, start, side="right")) - 1
        b = int(np.searchsorted(self.doc_tokens, stop, side="left"))
        symbols = self.symbols[self.doc_symbols[a] : self.doc_symbols[b]]
        after = np.cumsum(self.lengths[symbols]) + self.doc_tokens[a]
        low = int(np.searchsorted(after, start, side="right"))
        high = int(np.searchsorted(after, stop, side="left")) + 1
        held = self.expand(symbols[low:high])
        skip = start - int(after[low] - self.lengths[symbols[low]])
        return held[skip : skip + stop - start]


def shard_row(task: int, shard: int, first: int, docs: list, parts: list[bytes]) -> dict:
    ids = np.frombuffer(b"".join(parts), dtype="<u4")
    sizes = np.array([len(p) // 4 for p in parts], dtype=np.int64)
    ends = np.cumsum(sizes)
    alphabet, rules, symbols, symbol_ends = compress(ids, ends)
    starts = lambda e: np.concatenate(([0], e[:-1])).astype("<u8").tobytes()
    width = symbols.dtype.itemsize
    lengths = expansion_lengths(len(alphabet), rules)[len(alphabet) :]
    return {
        "task": task, "shard": shard, "first_token": first, "alphabet": alphabet.astype("<u4").tobytes(), "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(),
        "symbols": symbols.astype(f"<u{width}").tobytes(), "width": width, "docs": docs, "doc_symbols": starts(symbol_ends), "doc_tokens": starts(ends), "n_tokens": int(ends[-1]),
    }


ARROW = pa.schema(
    [("task", pa.int32()), ("shard", pa.int32()), ("first_token", pa.int64()), ("alphabet", pa.binary()), ("rules", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary()), ("width", pa.int32()), ("docs", pa.list_(pa.int64())), ("doc_symbols", pa.binary()), ("doc_tokens", pa.binary()), ("n_tokens", pa.int64())]
)


# Files ----------------------------------------------------------------------------------------------------------------


def write(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Write the ids of all documents, in ascending order of their ids; the shards (FILE) and the manifest (task, n_tokens, start), as they are read back.

    Without a path the files lie with the session's stored tables. tasks: how many tasks write; by default as many as a shuffle has.
    """
    spark = docs.sparkSession
    ship(spark)
    name = tokenizer or default_tokenizer()
    end = np.array([end_id], dtype="<u4").tobytes()

    @lean
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(name)
        ids, parts, held, shard, first, task = [], [], 0, 0, 0, 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([shard_row(task, shard, first, ids, parts)], schema=ARROW)

        for batch in batches:
            for task_, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                task, text = task_, text.as_py()
                part = (model.ids(text) if text else b"") + end
                ids.append(doc)
                parts.append(part)
                held += len(part) // 4
                if held >= SHARD_IDS:
                    yield close()
                    ids, parts, first, held, shard = [], [], first + held, 0, shard + 1
        if parts:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("tie")]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*[tasks] * bool(tasks), *order).sortWithinPartitions(*order)
    made = dealt.select(F.spark_partition_id().alias("task"), "doc_id", "text").mapInArrow(encode, FILE)
    if path is None:
        shards = store(made)
    else:
        made.write.parquet(f"{path}/shards")
        shards = spark.read.schema(made.schema).parquet(f"{path}/shards")
    each = shards.groupBy("task").agg(F.sum("n_tokens").alias("n_tokens"))
    before = Window.partitionBy(F.lit(0)).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    manifest = each.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    if path is None:
        return shards, store(manifest)
    manifest.write.parquet(f"{path}/manifest")
    return read(spark, path)


def read(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """The shards and the manifest of files."""
    return spark.read.schema(FILE).parquet(f"{path}/shards"), spark.read.schema("task int, n_tokens long, start long").parquet(f"{path}/manifest")


def documents(shards: DataFrame, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids (array; left out unless with_ids) of every document in the files."""
    ship(shards.sparkSession)
    more = ", ids array<bigint>" * with_ids
    schema = pa.schema([("task", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.list_(pa.int64()))] * with_ids])

    @lean
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a shard at a time
                s = Shard(batch.slice(k, 1).to_pylist()[0])
                ids = s.expand(s.symbols).astype("<u4")
                parts = [ids[a:b] for a, b in zip(s.doc_tokens[:-1].tolist(), s.doc_tokens[1:].tolist(), strict=True)]
                for at in range(0, len(parts), 2000):
                    some = parts[at : at + 2000]
                    columns = [
                        [s.task] * len(some), s.docs[at : at + 2000], s.first_token + s.doc_tokens[at : at + len(some)], [len(p) for p in some], [zlib.crc32(p) for p in some],
                    ]
                    if with_ids:
                        columns.append([p.tolist() for p in some])
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    found = shards.mapInArrow(decode, "task int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + more)
    # a row of 20 bytes a task
    placed = found.join(F.broadcast(manifest.select("task", F.col("start").alias("before"))), "task")
    return placed.withColumn("start", F.col("before") + F.col("start")).drop("task", "before")


def ids_between(shards: DataFrame, manifest: DataFrame, ranges: DataFrame) -> DataFrame:
    """(range_id, start, ids) of ranges (range_id, start, stop) of places in the whole sequence, a row for each shard that a range lies in.

    Shards meet ranges by their places; of a shard only the symbols of a range are expanded.
    """
    ship(shards.sparkSession)
    base = shards.join(F.broadcast(manifest.select("task", F.col("start").alias("before"))), "task").withColumn("low", F.col("before") + F.col("first_token"))
    # a shard is as long as SHARD_IDS and a document; places go by buckets of that length, so that a range meets the shards of its own buckets only
    bucket = lambda c: F.floor(c / SHARD_IDS).cast("long")
    over = base.withColumn("bucket", F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("low") + F.col("n_tokens") - 1))))
    wanted = ranges.where("stop > start").select("range_id", "start", "stop", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("stop") - 1))).alias("bucket"))
    # a pair meets in the first bucket that both have, and only there
    met = over.join(wanted, "bucket").where((F.col("start") < F.col("low") + F.col("n_tokens")) & (F.col("stop") > F.col("low")) & (F.col("bucket") == F.greatest(bucket(F.col("low")), bucket(F.col("start")))))

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = Shard(row).between(row["start"] - row["low"], row["stop"] - row["low"])
                yield pa.RecordBatch.from_arrays([pa.array([row["range_id"]], pa.int64()), pa.array([max(row["start"], row["low"])], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64()))], names=["range_id", "start", "ids"])

    return met.select(*shards.columns, "range_id", "start", "stop", "low").mapInArrow(cut, "range_id bigint, start bigint, ids array<bigint>")
