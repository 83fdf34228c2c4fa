"""N-gram Jaccard self-join by token-combination prefixes, and the components of its links.

A document is the set of its word n-grams (tokens, 64-bit hashes). Equal sets are one class, a node; the join runs on nodes.

Order and classes. A sketch counts, for every document, its tokens in 2**SKETCH_BITS counters (never too low). Tokens whose counter
exceeds a multiple of the mean are frequent, the others rare. All sets are ordered alike: rare tokens first, by counter, then
by hash.

Signatures. Linked sets share at least o = ceil(t * n) tokens, n being either size, so their first n - o + k tokens share k at
least. If the first shared token is rare, it is among the first n - o + 1 tokens of both: every rare token there is a signature of its
own. Otherwise all shared tokens are frequent. Frequent tokens fall into m parts by hash; prefixes extended to k = m + 1 shared tokens
have two in one part: every pair of frequent tokens of a part is a signature. m follows the size (a sixteenth of it, as a
power of two; a set signs for the one or two powers that a linked set of smaller or equal size may use), so signatures are
linear in the set size.

Links. Every signature says how many tokens its set can share if it is the signature of the first shared token: that token and what
follows it, or all frequent ones. Pairs for which that is too little are left out there; a linked pair meets where it is enough.
Within a signature, members meet the member that can share most (the hub) only; a hot signature is salted by its counter, and the
hubs of its lanes meet in turn. A pair is looked at further only if the parity bitmaps of its sets allow a link. Each node is verified with one hub first, then with hubs of other components. What remains are
signatures whose members still lie in several components: there, and only there, every pair from different components that those
bounds and short bitmaps allow is looked at. No link that joins components is lost, and a group of m near copies costs about m checks, not m * m.

Verification is exact on the hashed n-grams of the whole texts: the hub's text and its members' stream through a task, one set
at a time. A bit table of bounded size keeps texts without candidates from the shuffle, and texts travel compressed.

The sketch grows with the table, from 2**SKETCH_BITS to 2**MOST_SKETCH_BITS counters (64 MB); beyond that counters get coarser, which costs
candidates and never links. A node that holds more than a thousandth of the rows gets its component by a broadcast of at most a
thousand nodes, so that its rows are not shuffled.

Defined results: an empty table gives no rows; columns other than the id and the text are not read, whatever their names; texts of any length
are read whole. Words are what ASCII white space parts, in ASCII lower case. Fewer than n words: the whole sequence is the one
token; none, or a null text: the empty set, which links with nothing. Rows that repeat an id are rows of their own; a
component's id is the least non-null id in it. Two distinct sets whose 64-bit fingerprints meet are told apart by a
second fingerprint, and the run starts anew under another seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, hash128, lean, ship, store
from .components import components

N, PERCENT = 5, 75
SKETCH_BITS, MOST_SKETCH_BITS, FREQUENT_TIMES, FREQUENT_LEAST = 20, 24, 2, 32
#: Bytes of input, as the plan estimates them, for each counter of the sketch.
BYTES_A_COUNTER = 4096
#: A node is hot beyond this share of the rows: one in so many.
HOT_SHARE = 1000
#: Members of a lane of a hot signature, and of a chunk of a hub's candidates.
LANE, CHUNK = 512, 256
BLOCK_BITS, FLAG_BITS = 12, 22
#: Bytes that are part of a word: all but [\x20\x09-\x0D].
IN_WORD = np.array([c not in b" \t\n\x0b\f\r" for c in range(256)])
LONG, LEAST_BITS, MOST_BITS = 256, 512, 1 << 14
_MIX = [np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


class WordHash:
    """Hashes of the words of a text, all at once.

    A word is the sum over its bytes of a random value of the byte times a power of an odd number, modulo 2**64. Running sums over the
    whole text and the inverse powers give every word's sum whatever its place. Words of more than LONG bytes, where such sums
    can be made to meet, take another hash.
    """

    def __init__(self, seed: int):
        self.seed = seed
        random = np.random.default_rng(1234 + seed)
        self.value = random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.odd = 0x5851F42D4C957F2D + 2 * seed
        self.grow(1 << 12)

    def grow(self, size: int) -> None:
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(size, self.odd, dtype=np.uint64))
            self.inverse = np.cumprod(np.full(size, pow(self.odd, -1, 1 << 64), dtype=np.uint64))

    def __call__(self, text: bytes) -> np.ndarray:
        raw = np.frombuffer(text, dtype=np.uint8)
        if len(raw) > len(self.power):
            self.grow(max(len(raw), 2 * len(self.power)))
        inner = np.zeros(len(raw) + 2, dtype=bool)
        inner[1:-1] = IN_WORD[raw]
        edge = np.flatnonzero(inner[1:] != inner[:-1])
        start, end = edge[::2], edge[1::2]
        with np.errstate(over="ignore"):
            sums = np.zeros(len(raw) + 1, dtype=np.uint64)
            np.cumsum(self.value[raw] * self.power[: len(raw)], out=sums[1:])
            out = (sums[end] - sums[start]) * self.inverse[start]
        size = end - start
        if len(size) and size.max() > LONG:
            for i in np.flatnonzero(size > LONG):
                out[i] = xxhash.xxh64_intdigest(text[start[i] : end[i]], self.seed)
        return out


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * _MIX[0]
        x = (x ^ (x >> np.uint64(33))) * _MIX[1]
        return x ^ (x >> np.uint64(33))


def tokens(text: str | None, words: WordHash, n: int = N) -> np.ndarray:
    """The sorted distinct hashes of the word n-grams of a text."""
    codes = mix(words(text.encode("utf-8", "surrogatepass").lower())) if text else np.zeros(0, dtype=np.uint64)
    if not len(codes):
        return codes
    width = min(n, len(codes))
    with np.errstate(over="ignore"):
        # a sum of mixed codes under odd factors, one for each place
        h = codes[: len(codes) - width + 1] + np.uint64(width)
        for j in range(1, width):
            h += codes[j : len(codes) - width + 1 + j] * np.uint64(pow(0xD6E8FEB86659FD93, j, 1 << 64))
    h = np.sort(mix(h))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def bitmap(tok: np.ndarray) -> bytes:
    """The parities of the tokens over twice as many bits as tokens, rounded up to a power of two within bounds."""
    bits = min(MOST_BITS, max(LEAST_BITS, 2 << (len(tok) - 1).bit_length()))
    return np.packbits((np.bincount((tok % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


#: Longs of the short bitmap that the join of open signatures compares.
SHORT = 8


def short_bitmap(bits: bytes) -> np.ndarray:
    """A bitmap folded, or repeated with zeros, to SHORT longs: bits that differ in it differ in the whole one."""
    x = np.frombuffer(bits, dtype=np.int64)
    return np.bitwise_xor.reduce(x.reshape(-1, SHORT), axis=0) if len(x) >= SHORT else np.concatenate([x, np.zeros(SHORT - len(x), dtype=np.int64)])


def may_link(a: bytes, n_a: int, b: bytes, n_b: int, percent: int) -> bool:
    """False only if the sets cannot be linked: bits that differ are at most as many as tokens that only one set has.

    The longer bitmap folds to the shorter, as a token's place in it is its place in the longer modulo the shorter.
    """
    if n_a * 100 < n_b * percent or n_b * 100 < n_a * percent:
        return False
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    if len(x) != len(y):
        x, y = (np.bitwise_xor.reduce(z.reshape(-1, min(len(x), len(y))), axis=0) for z in (x, y))
    differ = (int.from_bytes(x.tobytes()) ^ int.from_bytes(y.tobytes())).bit_count()
    # with d tokens in one set only, both = (n_a + n_b - d) / 2 and either = (n_a + n_b + d) / 2
    return 100 * (n_a + n_b - differ) >= percent * (n_a + n_b + differ)


def node_of(tok: np.ndarray, seed: int) -> tuple[int, int]:
    """Two fingerprints of a set, as signed 64-bit integers."""
    whole = xxhash.xxh3_128_intdigest(tok.tobytes(), seed)
    low, high = whole & (1 << 64) - 1, whole >> 64
    return low - (1 << 64) if low >> 63 else low, high - (1 << 64) if high >> 63 else high


def count_blocks(counts: np.ndarray) -> pd.DataFrame:
    """A table of counters in rows of equal blocks, compressed; blocks without counts are left out."""
    import zstandard

    small = zstandard.ZstdCompressor(level=1)
    blocks = counts.reshape(-1, 1 << BLOCK_BITS)
    full = np.flatnonzero(blocks.any(axis=1))
    return pd.DataFrame({"block": full.astype("int32"), "counts": [small.compress(blocks[i].astype("<u4").tobytes()) for i in full]})


def counters(compressed: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(compressed), dtype="<u4")


def sum_blocks(rows: DataFrame, bits: int) -> np.ndarray:
    """The sum of the tables of all tasks: 2**bits counters, whatever the input; the driver gets one row a block."""

    @lean
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, None
        for batch in batches:
            for block, counts in zip(batch["block"], batch["counts"], strict=True):
                own = counters(counts).astype(np.uint64)
                if block != at:
                    if at is not None:
                        yield row(at, total)
                    at, total = block, own
                else:
                    total = total + own
        if at is not None:
            yield row(at, total)

    def row(block: int, total: np.ndarray) -> pd.DataFrame:
        return count_blocks(np.minimum(total, (1 << 32) - 1)).assign(block=np.array([block], dtype="int32"))

    out = np.zeros((1 << bits) >> BLOCK_BITS << BLOCK_BITS, dtype=np.uint32).reshape(-1, 1 << BLOCK_BITS)
    for r in rows.repartition("block").sortWithinPartitions("block").mapInPandas(add, "block int, counts binary").collect():
        out[r["block"]] = counters(r["counts"])
    return out.reshape(-1)


def sketch_bits(docs: DataFrame) -> int:
    """The size of the sketch, by the size of docs."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(MOST_SKETCH_BITS, max(SKETCH_BITS, (size // BYTES_A_COUNTER).bit_length()))


def read_sets(docs: DataFrame, seed: int, n: int, sketch: int) -> DataFrame:
    """A row (doc_id, t1, t2, n, node, other, bits) for each document and, from each task, its rows (block, counts) of the sketch.

    t1 and t2 are hashes of the text as it is; with the id they name a row, up to rows that repeat whole.
    """
    facts_of = ["doc_id", "t1", "t2", "n", "node", "other", "bits"]
    given = docs.select("doc_id", "text", *[h.alias(c) for h, c in zip(hash128(F.coalesce("text", F.lit(""))), ("t1", "t2"), strict=True)])

    @lean
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, counts, known = WordHash(seed), np.zeros(1 << sketch, dtype=np.uint32), set()
        for batch in batches:
            sizes, nodes, others, bits = [], [], [], []
            for text in batch["text"]:
                tok = tokens(text, words, n)
                node, other = node_of(tok, seed) if len(tok) else (None, None)
                sizes.append(len(tok))
                nodes.append(node)
                others.append(other)
                bits.append(bitmap(tok) if len(tok) else None)
                if node is not None and node not in known:
                    known.add(node)
                    np.add.at(counts, (tok >> np.uint64(64 - sketch)).astype(np.int64), 1)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "t1": batch["t1"], "t2": batch["t2"], "n": pd.array(sizes, dtype="Int64"), "node": pd.array(nodes, dtype="Int64"), "other": pd.array(others, dtype="Int64"), "bits": pd.Series(bits, dtype=object), "block": pd.array([None] * len(sizes), dtype="Int32"), "counts": pd.Series([None] * len(sizes), dtype=object)})
        blocks = count_blocks(counts)
        if len(blocks):
            yield blocks.assign(**dict.fromkeys(facts_of))[[*facts_of, "block", "counts"]].astype({c: "Int64" for c in facts_of if c != "bits"})

    return given.mapInPandas(read, "doc_id long, t1 long, t2 long, n long, node long, other long, bits binary, block int, counts binary")


def needed(n: int, percent: int) -> int:
    """The least number of tokens that a set of n shares with a linked one."""
    return -(-n * percent // 100)


def parts_of(n: int, percent: int) -> list[int]:
    """The numbers of parts that a set of n signs for: those of n and of the smallest size linked with it."""
    smallest = max(1, needed(n, percent))
    return sorted({max(1, (1 << (k.bit_length() - 1)) >> 4) for k in range(smallest, n + 1) if k in (smallest, n) or k & (k - 1) == 0}) if n < 64 else sorted({max(1, 1 << e >> 4) for e in range(smallest.bit_length() - 1, n.bit_length())})


def signatures(tok: np.ndarray, freq: np.ndarray, limit: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, counter of its rarer token, most tokens it can share) of a set; freq holds the counters of its tokens.

    If a rare token is the first that two sets share, they share no more than it and what follows it; if the first is frequent,
    no more than their frequent tokens. The last column is that number.
    """
    n = len(tok)
    if needed(n, percent) < 2:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)  # linked with equal sets only
    frequent = freq > limit
    order = np.lexsort((tok, freq))  # rare tokens come first, as their counters are lower
    first = n - needed(n, percent)
    n_rare = n - int(frequent.sum())
    singles = order[: min(first + 1, n_rare)]
    out, hot, left = [tok[singles]], [freq[singles]], [n - np.arange(len(singles))]
    for m in parts_of(n, percent):
        own = order[n_rare : first + m + 1]
        if len(own) < 2:
            continue
        part = (mix(tok[own]) >> np.uint64(8)) % np.uint64(m)
        own = own[np.lexsort((tok[own], part))]
        part = np.sort(part)
        for gap in range(1, len(own)):
            same = part[gap:] == part[:-gap]
            if not same.any():
                break
            a, b = own[:-gap][same], own[gap:][same]
            with np.errstate(over="ignore"):
                out.append(mix(tok[a] * np.uint64(0x9E3779B97F4A7C15) + mix(tok[b]) + np.uint64(m)))
            hot.append(np.minimum(freq[a], freq[b]))
            left.append(np.full(len(a), n - n_rare))
    return np.concatenate(out), np.concatenate(hot), np.concatenate(left)


#: Bits of a set's size, and of what it can share, in the packed column of a signature; larger ones count as the largest.
SIZE_BITS = 25


def packed_facts(lanes: np.ndarray, n: int, left: np.ndarray) -> np.ndarray:
    top = (1 << SIZE_BITS) - 1
    left = np.full(len(left), top) if n >= top else left
    return np.minimum(lanes, 8191).astype(np.int64) << 2 * SIZE_BITS | min(n, top) << SIZE_BITS | left.astype(np.int64)


def facts(c: Column) -> tuple[Column, Column, Column]:
    """lanes, n, left of a packed column."""
    mask = F.lit((1 << SIZE_BITS) - 1).cast("long")
    return F.shiftright(c, 2 * SIZE_BITS).cast("int"), F.shiftright(c, SIZE_BITS).bitwiseAND(mask), c.bitwiseAND(mask)


def enough(left: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether sets of n_a and n_b tokens can be linked that share `left` at most."""
    return left * (100 + percent) >= (n_a + n_b) * percent


def sign(docs: DataFrame, table, limit: int, seed: int, n: int, percent: int) -> DataFrame:
    """(sig, facts, node) of every distinct set of a task; facts packs lanes, n and left."""

    @lean
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, counts, known = WordHash(seed), table.value, set()
        shift = np.uint64(65 - len(counts).bit_length())
        for batch in batches:
            sigs, packed, nodes, held = [], [], [], 0
            for text in batch["text"]:
                tok = tokens(text, words, n)
                if not len(tok) or (node := node_of(tok, seed)[0]) in known:
                    continue
                known.add(node)
                sig, hot, left = signatures(tok, counts[(tok >> shift).astype(np.int64)].astype(np.int64), limit, percent)
                sigs.append(sig)
                packed.append(packed_facts(1 + hot // LANE, len(tok), left))
                nodes.append(np.full(len(sig), node, dtype=np.int64))
                held += len(sig)
                if held > 500_000:
                    yield frame(sigs, packed, nodes)
                    sigs, packed, nodes, held = [], [], [], 0
            if held:
                yield frame(sigs, packed, nodes)

    def frame(sigs, packed, nodes) -> pd.DataFrame:
        return pd.DataFrame({"sig": np.concatenate(sigs).view(np.int64), "facts": np.concatenate(packed), "node": np.concatenate(nodes)})

    return docs.select("text").mapInPandas(emit, "sig long, facts long, node long")


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both


def verify(pairs: DataFrame, texts: DataFrame, seed: int, n: int) -> DataFrame:
    """(hub, node, both, either) of distinct pairs (hub, node); texts has (node, packed text) of every node in them."""
    counted = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    chunked = pairs.join(counted, "hub").select("hub", F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("chunk"), "node")
    members = chunked.join(texts, "node").select("hub", "chunk", F.lit(1).alias("member"), "node", "packed")
    hubs = chunked.select("hub", "chunk").distinct().join(texts.withColumnRenamed("node", "hub"), "hub").select("hub", "chunk", F.lit(0).alias("member"), F.col("hub").alias("node"), "packed")
    met = members.unionByName(hubs).repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "member")

    @lean
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, hub = WordHash(seed), np.zeros(0, dtype=np.uint64)
        for batch in batches:
            out = []
            for h, is_member, node, packed in zip(batch["hub"], batch["member"], batch["node"], batch["packed"], strict=True):
                tok = tokens(unpack(packed), words, n)
                if is_member:
                    out.append((h, node, *similarity(hub, tok)))
                else:
                    hub = tok
            yield pd.DataFrame(out, columns=["hub", "node", "both", "either"]).astype("int64")

    return met.mapInPandas(check, "hub long, node long, both long, either long")


def pack(text: str) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(text.encode("utf-8", "surrogatepass"))


def unpack(packed: bytes) -> str:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed).decode("utf-8", "surrogatepass")


def flag_table(hashes: DataFrame) -> np.ndarray:
    """Which of 2**FLAG_BITS buckets the hashes (t1) fall in."""

    @lean
    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << FLAG_BITS, dtype=np.uint8)
        for batch in batches:
            counts[bucket(batch["t1"].to_numpy(dtype=np.int64))] = 1
        yield count_blocks(counts)

    return sum_blocks(hashes.select("t1").mapInPandas(mark, "block int, counts binary"), FLAG_BITS) > 0


def flags_of(spark: SparkSession, hashes: DataFrame) -> Broadcast:
    """The buckets of the hashes (t1) as bits, for all tasks."""
    return spark.sparkContext.broadcast(np.packbits(flag_table(hashes)))


def in_table(flags: Broadcast, t1: Column) -> Column:
    """False only if no hash of the table is t1."""

    @F.pandas_udf("boolean")
    @lean
    def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = np.unpackbits(flags.value).astype(bool)
        for hashes in batches:
            yield pd.Series(table[bucket(hashes.to_numpy(dtype=np.int64))], index=hashes.index)

    return test(t1)


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FLAG_BITS)).astype(np.int64)


def texts_of(docs: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, packed text) of the wanted nodes, from one document of each, found by its id and the hashes of its text."""
    row = ["doc_id", "t1", "t2"]
    # the rows of a node meet in their minimum before anything is joined
    chosen = sets.where("node is not null").groupBy("node").agg(F.min(F.struct(*row)).alias("row")).join(nodes, "node", "left_semi")
    chosen = store(chosen.select("node", *[F.col(f"row.{c}").alias(f"c_{c}") for c in row]))
    flags = flags_of(docs.sparkSession, chosen.select(F.col("c_t1").alias("t1")))

    @lean
    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, known = np.unpackbits(flags.value).astype(bool), set()
        for batch in batches:
            own = batch[table[bucket(batch["t1"].to_numpy(dtype=np.int64))]]
            # rows that repeat whole go on once
            fresh = []
            for key in zip(own["doc_id"].astype("Int64").astype(object), own["t1"], own["t2"], strict=True):
                fresh.append(key not in known)
                known.add(key)
            own = own[np.array(fresh, dtype=bool)]
            yield pd.DataFrame({"doc_id": own["doc_id"].astype("Int64"), "t1": own["t1"], "t2": own["t2"], "packed": pd.Series([pack(t) for t in own["text"]], index=own.index, dtype=object)})

    hashed = docs.where("text is not null").select("doc_id", "text", *[h.alias(c) for h, c in zip(hash128(F.col("text")), ("t1", "t2"), strict=True)])
    packed = hashed.mapInPandas(likely, "doc_id long, t1 long, t2 long, packed binary")
    same = [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in row]
    return store(packed.join(chosen, same[0] & same[1] & same[2]).select("node", "packed"))


def short_column(bits: Column) -> Column:
    @F.pandas_udf("array<long>")
    def short(blobs: pd.Series) -> pd.Series:
        return pd.Series([short_bitmap(b) for b in blobs], index=blobs.index, dtype=object)

    return short(bits)


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (hub, node) that sizes and bitmaps do not rule out; pairs are stored. The hub of a large group is in many: the facts of hot hubs are broadcast, HOT_SHARE of them at most."""
    known = sets.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    hubs = known.select(F.col("node").alias("hub"), F.col("n").alias("n_hub"), F.col("bits").alias("bits_hub"))
    hot = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") * HOT_SHARE > pairs.count()).select("hub")
    met = pairs.join(F.broadcast(hubs.join(F.broadcast(hot), "hub", "left_semi")), "hub").unionByName(pairs.join(F.broadcast(hot), "hub", "left_anti").join(hubs, "hub"))

    @F.pandas_udf("boolean")
    @lean
    def may(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, n_a, b, n_b in batches:
            yield pd.Series([may_link(*x, percent) for x in zip(a, n_a, b, n_b, strict=True)], dtype=bool)

    return met.join(known, "node").where(may("bits", "n", "bits_hub", "n_hub")).select(*pairs.columns)


def links_within(members: DataFrame, sets: DataFrame, docs: DataFrame, seed: int, n: int, percent: int) -> DataFrame:
    """Links (u, v) between nodes, enough to join every component; members are (sig, facts, node)."""
    linked = F.col("both") * 100 >= F.col("either") * percent

    def links(checked: DataFrame) -> DataFrame:
        return checked.where(linked).select(F.col("hub").alias("u"), F.col("node").alias("v"))

    lanes, size, left = facts(F.col("facts"))
    # a node falls into another lane of each of its hot signatures, so that it meets the best hub of its group in some
    lane = F.when(lanes > 1, F.pmod(F.xxhash64("sig", "node"), lanes)).otherwise(0).cast("int")
    own = Window.partitionBy("sig", "lane")
    members = members.select("sig", lane.alias("lane"), lanes.alias("lanes"), "node", size.alias("n"), left.alias("left"))
    # sets that stand in several tasks come several times
    members = members.withColumn("last", F.lag("node").over(own.orderBy("node"))).where(F.col("last").isNull() | (F.col("last") != F.col("node"))).drop("last")
    # who cannot be linked with even the smallest member has nothing to do in a signature; lanes of a hot one do not know the whole
    members = members.withColumns({"small": F.min("n").over(own), "most": F.max("left").over(own)})
    members = members.where((F.col("lanes") > 1) | enough(F.least("left", "most"), F.col("n"), F.col("small"), percent)).drop("small", "most")
    # the hub of a lane is the member that can share most; in a group of near copies that is one with few edits
    best = F.struct("left", "node", "n")
    met = members.withColumns({"hub": F.max(best).over(own), "low": F.min("node").over(own), "high": F.max("node").over(own)})
    first = store(met.where((F.col("low") != F.col("high")) | (F.col("lanes") > 1)).select("sig", "lanes", "node", "n", "left", "hub"))
    tops = first.where("lanes > 1").select("sig", "hub").distinct().withColumn("top", F.max("hub").over(Window.partitionBy("sig")))
    upper = tops.select("sig", F.col("hub.node").alias("node"), F.col("hub.n").alias("n"), F.col("hub.left").alias("left"), F.col("top").alias("hub"))
    meets = first.select("sig", "node", "n", "left", "hub").union(upper)
    fit = enough(F.least("left", "hub.left"), F.col("n"), F.col("hub.n"), percent) & (F.col("hub.node") != F.col("node"))
    pairs = meets.where(fit).groupBy(F.col("hub.node").alias("hub"), "node").agg(F.max("hub.left").alias("shares"))
    met_pairs = store(pairs)
    pairs = store(possible(met_pairs, sets, percent))
    # pairs of different components within a signature may need texts of nodes that no hub pair holds; they come later
    texts = texts_of(docs, pairs.select(F.col("hub").alias("node")).union(pairs.select("node")).distinct(), sets)

    # each node with its best hub first: that joins most groups, and spares the other hubs of the same group
    once = pairs.groupBy("node").agg(F.max_by("hub", F.struct("shares", "hub")).alias("hub")).select("hub", "node")
    found = store(links(verify(once, texts, seed, n)))
    roots = store(components(found))
    stored_pairs, pairs = pairs, pairs.select("hub", "node")
    others = apart(pairs.join(once, ["hub", "node"], "left_anti"), roots)
    found = store(found.union(links(verify(store(others), texts, seed, n))))
    roots = store(components(found))

    rooted = first.select("sig", "node", "n", "left").join(roots, "node", "left").select("sig", "node", "n", "left", F.coalesce("root", "node").alias("root"))

    def open_(rows: DataFrame) -> DataFrame:
        """Signatures whose members lie in several components, and their least size."""
        return rows.groupBy("sig").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.min("n").alias("least")).where("a <> b").select("sig", "least")

    # members that cannot be linked with even the smallest member go; most signatures are then of one component
    alive = rooted.join(open_(rooted), "sig").where(enough(F.col("left"), F.col("n"), F.col("least"), percent)).drop("least")
    short = sets.where("node is not null").groupBy("node").agg(F.first("bits").alias("bits")).select("node", short_column(F.col("bits")).alias("short"))
    rest = store(alive.join(open_(alive).select("sig"), "sig", "left_semi").join(short, "node"))
    a, b = rest.alias("a"), rest.alias("b")
    differ = sum((F.bit_count(F.col("a.short")[i].bitwiseXOR(F.col("b.short")[i])) for i in range(SHORT)), F.lit(0))
    total = F.col("a.n") + F.col("b.n")
    fits = enough(F.least("a.left", "b.left", "a.n", "b.n"), F.col("a.n"), F.col("b.n"), percent) & ((total - differ) * 100 >= (total + differ) * percent)
    cross = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root")) & fits)
    cross = cross.select(F.col("a.node").alias("hub"), F.col("b.node").alias("node")).distinct()
    met_cross = store(cross)
    cross = store(possible(met_cross, sets, percent).join(pairs, ["hub", "node"], "left_anti"))
    more = cross.select(F.col("hub").alias("node")).union(cross.select("node")).distinct()
    more_texts = texts_of(docs, more, sets) if cross.take(1) else texts
    out = store(found.union(links(verify(cross, more_texts, seed, n))))
    forget(first, met_pairs, stored_pairs, rest, met_cross, cross, texts, more_texts)
    return out


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    of_node = roots.select("node", F.col("root").alias("node_root"))
    of_hub = roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    met = pairs.join(of_node, "node", "left").join(of_hub, "hub", "left")
    return met.where(F.coalesce("node_root", "node") != F.coalesce("hub_root", "hub")).select("hub", "node")


def joined_sets(docs: DataFrame, n: int = N, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t1, t2, n, node) of every row of docs (doc_id, text), and (node, component_id, size) of every node; size counts its rows."""
    spark = docs.sparkSession
    ship(spark)
    seed, sketch = 0, sketch_bits(docs)
    while True:
        both = store(read_sets(docs, seed, n, sketch))
        sets = both.where("block is null").drop("block", "counts")
        meet = sets.where("node is not null").groupBy("node").agg(F.min("other").alias("a"), F.max("other").alias("b"))
        if not meet.where("a <> b").take(1):
            break
        forget(both)
        seed += 1
    counts = sum_blocks(both.where("block is not null").select("block", "counts"), sketch)
    limit = int(FREQUENT_TIMES * counts.mean() + FREQUENT_LEAST)
    members = sign(docs, spark.sparkContext.broadcast(counts), limit, seed, n, percent)
    roots = components(links_within(members, sets, docs, seed, n, percent))
    least = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size"))
    rooted = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return sets.select("doc_id", "t1", "t2", "n", "node"), store(rooted.join(named, "root").select("node", "root", "component_id", "size"))


def with_nodes(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """sets, left-joined with the columns of their nodes; rows of hot nodes are not shuffled."""
    total = nodes.agg(F.sum("size")).first()[0] or 0
    hot = nodes.where(F.col("size") * HOT_SHARE > total)  # fewer than HOT_SHARE nodes, whatever the data
    met = sets.join(F.broadcast(hot), "node")
    # rows without a node have nothing to meet
    rest = sets.where("node is not null").join(F.broadcast(hot.select("node")), "node", "left_anti").join(nodes, "node")
    none = sets.where("node is null").select(*[sets[c] for c in sets.columns], *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in nodes.columns if c != "node"])
    return met.unionByName(rest).unionByName(none)


def join_components(docs: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets, nodes = joined_sets(docs, n, percent)
    out = with_nodes(sets, nodes)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row of docs of every component, with its columns; rows without words are in no group and stay.

    It is the row of the least doc_id (a null id is the largest), then of the least hash of its text; of rows that repeat both, any one.
    """
    sets, nodes = joined_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")), n, percent)
    key = ["doc_id", "t1", "t2"]
    # the rows of a node meet in their minimum before anything is joined
    least = sets.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), *key)).alias("best")).join(nodes.select("node", "root"), "node")
    best = least.groupBy("root").agg(F.min("best").alias("best")).select(*[F.col(f"best.{c}").alias(f"b_{c}") for c in key])
    rows = sets.where("node is not null").groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).select(*[F.col(c).alias(f"k_{c}") for c in key], "copies")

    def same(one: str, other: str) -> Column:
        x, y, z = (F.col(f"{one}{c}").eqNullSafe(F.col(f"{other}{c}")) for c in key)
        return x & y & z

    gone = store(rows.join(best, same("k_", "b_"), "left_anti"))
    again = store(rows.where("copies > 1").join(best, same("k_", "b_"), "left_semi"))
    t1, t2 = hash128(F.coalesce("text", F.lit("")))
    given = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("r_doc_id"), t1.alias("r_t1"), t2.alias("r_t2"))
    # most rows stay; a bit table of bounded size tells most of them, whose texts are then not shuffled
    marked = given.withColumn("asked", in_table(flags_of(docs.sparkSession, gone.select(F.col("k_t1").alias("t1")).union(again.select("k_t1"))), F.col("r_t1")))
    kept = marked.where("asked").join(gone, same("r_", "k_"), "left_anti")
    if again.take(1):  # rows that repeat whole
        copies = kept.join(again, same("r_", "k_"), "left_semi").groupBy("r_doc_id", "r_t1", "r_t2").agg(F.first("row").alias("row"))
        kept = kept.join(again, same("r_", "k_"), "left_anti").select("row").union(copies.select("row"))
    kept = marked.where(~F.col("asked")).select("row").union(kept.select("row"))
    return kept.select("row.*")
