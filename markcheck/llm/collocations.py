"""Phrase collocations by dynamic itemset counting.

The corpus is cut into shards that are scanned in turn, round and round. Words are counted from the first scan on; a
longer phrase becomes active with the scan after the one in which both of its subphrases (without its last, and without
its first word) have been seen often enough, and is then counted in one full round of shards, so that several lengths
are counted in the same scan. No phrase is listed beforehand: a scan finds out from two tables of buckets, in which
scan each subphrase was found frequent. Phrases that share a bucket can only make others active that need not be, which
costs counts but changes none.

Scans count by 57-bit keys. One last scan gives the frequent keys their phrases; should two phrases share a key, which
tells in that scan, the phrases of such keys are counted once more by their text. Only phrases of one 64-bit hash in one
task would not be told apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from markcheck.llm.shingles import mix, slices
from markcheck.scratch import materialize

#: Words of the longest phrase, and shards of a round.
LONGEST, SHARDS = 3, 2
#: Bits of a bucket number: each table of buckets is of 2^BITS bytes, before compression, at any size of the corpus.
BITS = 24
#: The same for the set of buckets that hold what is to be named: 2^NAMED bits.
NAMED = 27
#: Documents and bytes of text that are counted at a time.
ROWS, BYTES = 20_000, 2_500_000
#: Parts in which the ranking of a language is begun.
PARTS = 32
#: A bucket that holds nothing frequent.
NEVER = 255
#: A key's lowest bits: length of the phrase, and above them the scan in which its count began.
LENGTH, BEGUN = 3, 31

_CUT = bytes.maketrans(b".,;:!?\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n" * 9 + b" abcdefghijklmnopqrstuvwxyz")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_BASE = 0x9E3779B97F4A7C15
#: What a byte adds to the hash of its word.
_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=3) for b in range(256)], np.uint64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of the base of word hashes, and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _POWERS[k] = np.cumprod(factors)
    return [p[:n] for p in _POWERS]


class Words:
    """Words of some texts, one after the other, with keys of the phrases that begin at each."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.text = b"\n" + (b"\n".join(texts)).translate(_CUT) + b"\n"
        data = np.frombuffer(self.text, np.uint8)
        cut = data == 10
        inside = ~(cut | (data == 32))
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edges[::2], edges[1::2]
        up, down = _powers(len(data))
        sums = _BYTE[data]  # eight bytes for each of the text: changed in place, and let go
        sums *= up
        np.cumsum(sums, out=sums)
        own = sums[self.end - 1]
        own -= sums[self.start - 1]
        own *= down[self.start]
        del sums
        piece = np.cumsum(cut, dtype=np.int32)[self.start]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.doc = np.searchsorted(ends, self.start - 1, side="right")
        seeds = np.fromiter((xxhash.xxh3_64_intdigest(x.encode(), seed=7) for x in langs), np.uint64, len(langs))
        h = mix(own ^ seeds[self.doc]) if len(own) else own
        self.hashes, self.keys, self.valid = h, [], []
        total = np.zeros(len(h), np.uint64)
        for k in range(LONGEST):
            n = max(0, len(h) - k)
            total = total[:n] + h[k:] * _ODD[k]
            self.keys.append((mix(total + np.uint64(k)) & ~np.uint64(127)) | np.uint64(k + 1))
            self.valid.append(np.flatnonzero(piece[:n] == piece[k:]))

    def names(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the phrases at ``at``, apart from their keys."""
        total = np.full(len(at), length, np.uint64)
        for k in range(length):
            total += self.hashes[at + k] * _ODD[LONGEST + k]
        return mix(total)

    def phrases(self, at: np.ndarray, length: int) -> list[bytes]:
        """Words of the phrases at ``at``, with one space between two."""
        lo, hi = self.start[at], self.end[at + length - 1]
        size = sum(self.end[at + k] - self.start[at + k] for k in range(length)) + length - 1
        out = [self.text[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        for i in np.flatnonzero(size != hi - lo).tolist():
            out[i] = b" ".join(out[i].split(b" ")) if b"  " not in out[i] else b" ".join(w for w in out[i].split(b" ") if w)
        return out


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _wanted(keys: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Which keys fall in a bucket whose bit is set."""
    bucket = _bucket(keys, NAMED)
    return (flags[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 > 0


def _times(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each stands."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(first, append=len(keys))


def _packed(found: np.ndarray) -> bytes:
    return zstandard.compress(found.tobytes(), 1)


def _unpacked(tables: Broadcast) -> list[np.ndarray]:
    return [np.frombuffer(zstandard.decompress(t), np.uint8) for t in tables.value]


def _active(words: Words, found: list[np.ndarray], scan: int, shards: int) -> Iterator[np.ndarray]:
    """Per length, the keys to be counted in this scan, each with the scan in which its count began."""
    begin = np.zeros(len(words.keys[0]), np.uint8)
    for k in range(LONGEST):
        at = words.valid[k]
        if k:
            since = found[k - 1][_bucket(words.keys[k - 1], BITS)]
            later = np.maximum(since[:-1], since[1:])
            begin = np.where(later == NEVER, NEVER, later + 1).astype(np.uint8)
        own = begin[at].astype(np.int64)
        counted = (own <= scan) & (scan < own + shards)
        yield words.keys[k][at[counted]] | (own[counted].astype(np.uint64) << np.uint64(2))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str]]]:
    for b in slices(batches, ROWS, BYTES):
        langs = b.column(b.schema.get_field_index("lang")).to_pylist()
        yield Words(b.column(b.schema.get_field_index("text")).cast(pa.binary()).to_pylist(), langs), langs


def _scan(tables: Broadcast, scan: int, shards: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for words, _ in _batches(batches):
            found = _unpacked(tables) if found is None else found
            for keys in _active(words, found, scan, shards):
                if len(keys):
                    distinct, times = _times(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(times)], ["key", "f"])

    return run


def _name(tables: Broadcast, counting: bool) -> Callable:
    """Phrases whose bucket holds a wanted one: each once a task, or, if ``counting``, with its times in every batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = None, np.zeros(0, np.uint64)
        for words, langs in _batches(batches):
            wanted = _unpacked(tables)[0] if wanted is None else wanted
            lang = pa.array(langs, pa.string())
            if not counting:
                totals = pa.array(np.bincount(words.doc, minlength=len(langs)))
                nothing = pa.nulls(len(langs))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(langs), np.int64)), lang, nothing.cast(pa.string()), totals], ["key", "lang", "phrase", "f"])
            for k in range(LONGEST):
                at = words.valid[k]
                at = at[_wanted(words.keys[k][at], wanted)]
                names, first, times = np.unique(words.names(at, k + 1), return_index=True, return_counts=True)
                if not counting and len(seen):
                    old = seen[np.minimum(np.searchsorted(seen, names), len(seen) - 1)] == names
                    names, first, times = names[~old], first[~old], times[~old]
                if not len(names):
                    continue
                if not counting:
                    seen = np.sort(np.concatenate((seen, names)))
                at = at[first]
                phrase = pa.array(words.phrases(at, k + 1), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(words.keys[k][at].view(np.int64)), lang.take(pa.array(words.doc[at])), phrase, pa.array(times)], ["key", "lang", "phrase", "f"])

    return run


def _length() -> Column:
    return F.col("key").bitwiseAND(F.lit(LENGTH).cast("long"))


def _flags(keys: DataFrame, bits: int) -> np.ndarray:
    """Bit set of the buckets that ``keys`` fall in: at most 2^(bits - 6) rows go to the driver."""
    block = F.shiftrightunsigned("key", 70 - bits).alias("block")
    table = keys.groupBy(block).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(key, {64 - bits}) & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), "<i8")
    out[table.column("block").to_numpy()] = table.column("bits").to_numpy()
    return out.view(np.uint8)


def counted(rows: DataFrame, least: int, shards: int = SHARDS) -> DataFrame:
    """``key, f`` of the phrases that ``rows(text, lang, shard)`` hold ``least`` times or more, by scans in turn.

    A phrase that is active from scan ``b`` on is counted in scans ``b`` to ``b + shards - 1``, that is in every shard.
    """
    spark = rows.sparkSession
    found = [np.full(1 << BITS, NEVER, np.uint8) for _ in range(LONGEST - 1)]
    begins = {1: 0}  # last scan with which a phrase of a length can become active, so far
    begun = F.shiftright("key", 2).bitwiseAND(F.lit(BEGUN).cast("long"))
    state, done, scan = None, [], 0
    while scan < max(begins.values()) + shards:
        tables = spark.sparkContext.broadcast([_packed(t) for t in found])
        fresh = rows.where(F.col("shard") == scan % shards).select("text", "lang").mapInArrow(_scan(tables, scan, shards), "key long, f long")
        state = (fresh if state is None else state.unionByName(fresh)).groupBy("key").agg(F.sum("f").alias("f"))
        over = begun + shards <= scan + 1
        state = materialize(state.where(~over | (F.col("f") >= least)), f"phrases-{scan}")
        for n in range(1, LONGEST):
            new = np.unpackbits(_flags(state.where((F.col("f") >= least) & (_length() == n)), BITS), bitorder="little").view(bool) & (found[n - 1] == NEVER)
            if new.any():
                found[n - 1][new] = scan
                begins[n + 1] = scan + 1
        done.append(state.where(over).select(F.col("key").bitwiseAND(F.lit(~(BEGUN << 2)).cast("long")).alias("key"), "f"))
        state = state.where(~over)
        tables.destroy()
        scan += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _named(rows: DataFrame, keys: DataFrame, counting: bool) -> DataFrame:
    """``key, lang, phrase, f`` of what may have one of ``keys``."""
    tables = rows.sparkSession.sparkContext.broadcast([_packed(_flags(keys, NAMED))])
    found = rows.select("text", "lang").mapInArrow(_name(tables, counting), "key long, lang string, phrase string, f long")
    return materialize(found.groupBy("key", "lang", "phrase").agg(F.sum("f").alias("f")), "phrases-named")


def phrases(docs: DataFrame, least: int = 10, shards: int = SHARDS, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, f`` of every phrase of up to three words that a language holds ``least`` times, and ``lang, n``."""
    if 2 * shards > BEGUN:
        raise ValueError(f"at most {BEGUN // 2} shards")
    text, lang = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    rows = docs.select(text.alias("text"), lang.alias("lang")).withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)))
    keys = counted(rows, least, shards)
    named = _named(rows, keys, counting=False)
    totals = named.where("phrase is null and f > 0").select("lang", F.col("f").alias("n"))
    found = materialize(named.where("phrase is not null").select("key", "lang", "phrase").join(keys, "key"), "phrases-found")
    clashing = found.groupBy("key").count().where("count > 1").select("key")
    if not clashing.isEmpty():
        again = _named(rows, clashing, counting=True).join(clashing, "key", "left_semi").where(F.col("f") >= least)
        found = found.join(clashing, "key", "left_anti").unionByName(again)
    return found.select("lang", "phrase", _length().cast("int").alias("words"), "f"), totals


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, shards: int = SHARDS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``top`` collocations of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased by A-Z, cut into pieces at ``.,;:!?`` and line ends, and these into words at spaces and tabs.
    A phrase of two or three words that occurs ``a`` times, ``least`` or more, is scored by its weakest cut, 10^6 a^2 /
    (l r) rounded down, of equally weak cuts the first. Phrases that are half the time or more part of a longer one that
    was counted are left out. Null texts are empty, a null language is ``und``; repeated rows count as often as they
    stand; a text goes through a task whole, so memory follows the longest; other columns and their names do not
    matter; an empty table gives no rows. Where scores, counts and phrases are compared, phrases go by their bytes.
    """
    found, totals = phrases(docs, least, shards, text_col, lang_col)
    words = F.split("phrase", " ")
    part = lambda lo, n: F.array_join(F.slice(words, lo, n), " ")
    longer = found.where(F.col("words") > 1)
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    cuts = longer.select("lang", "phrase", F.col("f").alias("a"), "words", cut.alias("k")).select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    sides = found.select("lang", F.col("phrase").alias("side"), F.col("f").alias("of"))
    cuts = cuts.join(sides.withColumnsRenamed({"side": "left", "of": "l"}), ["lang", "left"]).join(sides.withColumnsRenamed({"side": "right", "of": "r"}), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"__up": F.lit(1_000_000).cast("decimal(7,0)") * wide("a") * wide("a"), "__down": wide("l") * wide("r")}).withColumn("score", F.expr("__up div __down"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    inner = F.explode(F.array_distinct(F.array(part(1, F.col("words") - 1), part(2, F.col("words") - 1))))
    covered = longer.where(F.col("words") > 2).select("lang", inner.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("__longer"))
    best = best.join(covered, ["lang", "phrase"], "left").where("__longer is null or 100 * __longer < 50 * a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = best.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("__at", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order))).where(F.col("__at") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), g AS (
  SELECT lang, 1 AS words, unnest(ws) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w
), f AS (
  SELECT lang, words, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 10
), n AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
), c AS (
  SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, words)) AS k FROM f WHERE words > 1
), s AS (
  SELECT c.lang, c.phrase, c.words, c.a, c.k, l.f AS l, r.f AS r, (1000000 * c.a * c.a) // (l.f * r.f) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[:c.k], ' ')
         JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.k + 1:], ' ')
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), o AS (
  SELECT lang, unnest([array_to_string(string_split(phrase, ' ')[:2], ' '), array_to_string(string_split(phrase, ' ')[2:], ' ')]) AS phrase, a AS longer
  FROM b WHERE words = 3
), d AS (
  SELECT DISTINCT b.lang, b.phrase FROM b JOIN o USING (lang, phrase) WHERE 100 * o.longer >= 50 * b.a
), k AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM b ANTI JOIN d USING (lang, phrase)
)
SELECT k.lang, k.rank::BIGINT AS rank, k.phrase, k.a::BIGINT AS a, k.l::BIGINT AS l, k.r::BIGINT AS r, n.n, k.score::BIGINT AS score
FROM k JOIN n USING (lang) WHERE k.rank <= 2000
"""
