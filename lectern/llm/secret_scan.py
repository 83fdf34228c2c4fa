"""Secrets by dictionary-primed compression novelty, beside three fixed patterns.

The patterns (assign, access, hex) are found first. The method then measures candidates: strings of LEAST or more letters, digits and
signs in a sensitive context: a word such as token, credential or private key within REACH characters before or after, or the lines of a
private key block. Candidates with nothing but blanks and signs between them are a block and share its context. A run of such
characters is parted at its '=' and at the sensitive words it holds, so that in key=value the value is measured by itself (from PART_LEAST
characters); a run without such a part is measured whole.

Novelty is the number of bytes that zstandard adds for the candidate, over its length. The compressor is primed with dictionaries (names and values
usual in configuration and code, words of names, ordinary prose, and the words that several documents of the corpus, and a share of all, hold, so that no
single document's secret is in them) and has then read the surrounding text, AROUND characters on either side, in a block of its own. Words of names, and what
stands nearby already, are matches and cost little; a random string has no match and costs its length or more. All is in lower case, as a
name written in another case is the same name, while a random string stays without a match. Candidates at or above the threshold that touch no span
of the patterns are reported as `novel`. Copies stay in the surrounding text, so that what repeats there is not novel; only the text after a
candidate ends at its next copy, so that a secret's first place is measured by itself. Later places of a string that was novel at its first are
reported with it.

Defined results: a null text is an empty one; spans are in code points with exclusive ends; whole texts are read, of any length; spans of different kinds that
start together are in the order of the kinds. Rows that repeat are scanned each. An empty table gives no rows; other columns are not read, whatever their names.
Memory is that of one Arrow batch and the dictionary.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, ship

KINDS = ("assign", "access", "hex", "novel")
#: The patterns and lengths of the contract.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_MIN, ACCESS_MIN = 8, 16
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words whose neighbourhood is sensitive.
CONTEXT_WORDS = ("password", "passwd", "passphrase", "secret", "token", "api_key", "apikey", "credential", "private_key", "private key", "authorization", "bearer", "access_key", "access key", "client_id", "auth_key", "signature")
CONTEXT = re.compile("|".join(map(re.escape, CONTEXT_WORDS)), re.IGNORECASE | re.ASCII)
#: Characters of a candidate, and of a value after '=' or a sensitive word.
LEAST, PART_LEAST = 16, 10
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=\-]{{{LEAST},}}")
#: What parts a run: '=' before a value (at the end it is padding), and a word with the signs around it.
PARTING = re.compile(rf"=+(?=[^=])|[_\-]*(?:{CONTEXT.pattern})[_/\-]*", re.IGNORECASE | re.ASCII)
#: Characters between a candidate and its sensitive word, characters of surrounding text on either side, and the least novelty of a secret.
REACH, AROUND, NOVELTY = 48, 512, 1.0
#: Bytes of a block of the compressor.
SLICE = 48
#: The rows that must hold a word of the dictionary, at least and as a share of all; the words taken.
WORD_DOCS, WORD_SHARE, MAX_WORDS = 3, 0.003, 4000
#: What stands between candidates of one block, and the head and end of a private key.
BETWEEN = re.compile(r"[\W_]*")
KEY_HEAD, KEY_END = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----"), "-----END "

#: The identifiers that prime the compressor: names and values as they stand in configuration and code.
IDENTIFIERS = """
password = "changeme" passwd: secret_key = os.environ["SECRET_KEY"] api_key = getenv("API_KEY") token = request.headers["Authorization"]
Authorization: Bearer client_id client_secret access_key_id secret_access_key private_key public_key username user_name hostname
localhost 127.0.0.1 example.com https://www.example.com/api/v1/users config.yaml settings.json application.properties database_url
connection_string postgresql:// mysql:// redis:// mongodb:// true false null none undefined default production development staging
import from return function class static const public private protected void string integer boolean float double self.this
getElementById createElement addEventListener document.window console.log print format join split replace length append insert
your_password_here your-api-key-here placeholder xxxxxxxxxxxxxxxx 0000000000000000 1234567890123456 abcdefghijklmnopqrstuvwxyz
ABCDEFGHIJKLMNOPQRSTUVWXYZ 2020-01-01T00:00:00Z Content-Type: application/json User-Agent: Mozilla/5.0 Accept-Encoding: gzip deflate
"""

#: Words that names in code and configuration are made of.
NAME_WORDS = """
access account action active address admin agent application archive array async attribute auth backup base batch billing body boolean bucket buffer build button cache callback
category channel check child class client clock cloud code collection column command commit config connection console constant container content context control copy core count
create current customer database date default delete deploy device directory display document domain download email enable encode endpoint engine entity entry environment error
event execute export external factory field file filter folder format frame function gateway generate global group handler hash header history host image import index info input
insert instance integer interface internal international item key label language layout length level library limit line link list listener load local location logger login main
manager master member memory message method mobile mode model module monitor name native network next node notification number object offset operation option order output owner
package parameter parent path payload payment permission plugin point policy pool position prefix primary process product production profile project property provider public query
queue range rate read record reference region register remote remove render repository request reset resource response result return role root route rule save schedule schema
script search section secure select send sequence server service session setting shared size sort source space stack stage start state status step storage store stream string
style summary sync system table target task template test theme thread time timeout title total trace transaction transfer transform trigger type update upload user util value
variable vendor verify version view visible warning width window worker write year zone
"""

#: Ordinary prose.
PROSE = """
When the first settlers came up the river they found a wide valley with good soil, a few scattered farms and an old mill beside the water.
Nobody remembered who had built it, but the wheel still turned every spring, and people from both sides used to bring their grain there.
After some years a road was made through the hills; then a market grew around the bridge, houses followed, and by the end of the century
the place had become a small town with its own school, several workshops, a quiet square, and a church whose bells could be heard for miles.
"""


def primer(words: Iterable[str] = ()) -> bytes:
    """The dictionary, the most frequent words last, where a match costs least; words are those of the corpus, the most frequent first."""
    return f"{' '.join(reversed(list(words)))} {PROSE}{IDENTIFIERS}{NAME_WORDS}".lower().encode("utf-8", "surrogatepass")


class Novelty:
    """Marginal compressed size of a string in its surroundings, over its length.

    The string stands inside a line of prose that the dictionary holds, so that its block is always stored in parts, not as it is; what the line costs alone
    is taken away.
    """

    LINE = (PROSE[1:51].lower().encode(), PROSE[51:101].lower().encode())

    def __init__(self, dictionary: bytes | None = None, level: int = 13):
        import zstandard

        known = zstandard.ZstdCompressionDict(primer() if dictionary is None else dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters.from_level(level, min_match=3, window_log=18, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.zstd, self.end = zstandard.ZstdCompressor(dict_data=known, compression_params=settings), zstandard.COMPRESSOBJ_FLUSH_BLOCK
        self.line = self.added(b"-", b"")

    def added(self, context: bytes, value: bytes) -> int:
        """Bytes of a block that holds value, after blocks that hold context.

        Blocks are of SLICE bytes: of so few, the compressor stores what is not a match as it is, whatever its alphabet.
        """
        one = self.zstd.compressobj()
        for at in range(0, len(context), SLICE):
            one.compress(context[at : at + SLICE])
            one.flush(self.end)
        size = 0
        for at in range(0, max(1, len(value)), SLICE):
            size += len(one.compress(self.LINE[0] + value[at : at + SLICE] + self.LINE[1])) + len(one.flush(self.end))
        return size

    def __call__(self, text: str, start: int, end: int) -> float:
        own, before, after = text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]
        after = after.partition(own)[0]
        context, value = (x.lower().encode("utf-8", "surrogatepass") for x in (after + "\n" + before, own))
        return (self.added(context, value) - self.line * -(-len(value) // SLICE)) / len(value)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns, leftmost and not overlapping within a kind."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def parts(start: int, run: str) -> list[tuple[int, int]]:
    """The spans of the parts of a run that are long enough, or that of the run where none is."""
    edges = [0, *(x for m in PARTING.finditer(run) for x in m.span()), len(run)]
    found = [(start + a, start + b) for a, b in zip(edges[::2], edges[1::2]) if b - a >= (LEAST if len(edges) == 2 else PART_LEAST)]
    return found or [(start, start + len(run))]


def key_blocks(text: str) -> Iterator[tuple[int, int]]:
    """The spans from the head of a private key to its end."""
    at = 0
    while head := KEY_HEAD.search(text, at):
        at = text.find(KEY_END, head.end())
        if at < 0:
            return
        yield head.end(), at


def blocks(text: str) -> Iterator[list[tuple[int, int]]]:
    """The candidates, those with only blanks and signs between them together."""
    block: list[tuple[int, int]] = []
    for start, end in (span for m in CANDIDATE.finditer(text) for span in parts(m.start(), m[0])):
        if block and not (start - block[-1][1] <= REACH and BETWEEN.fullmatch(text, block[-1][1], start)):
            yield block
            block = []
        block.append((start, end))
    if block:
        yield block


def novel_spans(text: str, taken: list[tuple[int, int, int]], novelty, threshold: float = NOVELTY) -> list[tuple[int, int, int]]:
    low = text.lower()
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    words = [m.span() for m in CONTEXT.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    keys = list(key_blocks(text))

    def sensitive(start: int, end: int) -> bool:
        before, after, key = bisect_right(ends, start) - 1, bisect_left(starts, end), bisect_right(keys, (start, len(text))) - 1
        return before >= 0 and start - ends[before] <= REACH or after < len(starts) and starts[after] - end <= REACH or key >= 0 and start < keys[key][1]

    found, t, known = [], 0, set()
    for start, end in (span for block in blocks(text) if any(sensitive(*span) for span in block) for span in block):
        while t < len(taken) and taken[t][2] <= start and t + 1 < len(taken):
            t += 1
        if any(s < end and start < e for s, _, e in taken[max(0, t - 2) : t + 3]):
            continue
        if text[start:end] in known or novelty(text, start, end) >= threshold:
            known.add(text[start:end])
            found.append((start, 3, end))
    return found


def scan_text(text: str | None, novelty, threshold: float = NOVELTY) -> list[tuple[int, int, int]]:
    text = text or ""
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, novelty, threshold))


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """The words of the dictionary that come from the corpus, the most frequent first: runs of 3 to 15 letters, parted at changes of case, that WORD_DOCS rows of any, and WORD_SHARE of all, hold. Rows that repeat count once."""
    rows = docs.select(F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"))
    counted = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    there = counted.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    least = max(WORD_DOCS, math.ceil(there * WORD_SHARE))
    # eight bytes for each row that repeats whole, its id too, which are few; so no text is shuffled but theirs
    twice = F.broadcast(counted.where("n > 1").select("h"))
    once = rows.join(twice, "h", "left_anti").unionByName(rows.join(twice, "h", "left_semi").groupBy("h").agg(F.min("text").alias("text")))
    word = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[A-Z]?[a-z]{2,14}|[A-Z]{3,15}"), F.lit(0)), F.lower)))
    held = once.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return [r["word"] for r in held.orderBy(F.desc("n"), "word").limit(MAX_WORDS).collect()]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = NOVELTY) -> DataFrame:
    """doc_id and findings, an array of (start, kind, end, value) by start, then kind, of every row."""
    ship(docs.sparkSession)
    # MAX_WORDS words of 15 letters at most
    dictionary = docs.sparkSession.sparkContext.broadcast(primer(corpus_words(docs, id_col, text_col)))

    @lean
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        novelty = Novelty(dictionary.value)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                spans = scan_text(text, novelty, threshold)
                rows.append([{"start": s, "kind": KINDS[k], "end": e, "value": text[s:e]} for s, k, e in spans])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "findings": rows})

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInPandas(find, "doc_id long, findings array<struct<start: long, kind: string, end: long, value: string>>")


def joined(findings: Column) -> Column:
    """kind:start:end of each finding, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def count_of(findings: Column, kind: str) -> Column:
    return F.size(F.filter(findings, lambda f: f["kind"] == kind)).cast("long")
