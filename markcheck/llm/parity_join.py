"""N-gram Jaccard join with parity sketches.

A parity sketch keeps, per part of the hash space, the XOR of a set's token hashes there. Two sets differ in at
least as many tokens as they differ in parts, and sets of sizes a and b that reach the similarity differ in at
most D = (a + b)(1 - t)/(1 + t) tokens. So of the parts that hold the same tokens of a set at both sizes, all but D
must agree: their XOR values are the signatures that documents are joined on. The number of parts grows with the
size band of a set by splitting one part after the other, so neighbouring sizes share most parts, and a part whose
tokens stay together in the split keeps its value. Every document knows how many signatures it is sure to share with
any partner, so it can leave out that many but one. It leaves out those that come last in one order of all
signatures, which puts the frequent ones of a sample last: two documents that share enough then still meet in the
first one that they share, whatever the sample says. The few (short) documents that are sure of none emit all and
also join on the tokens of an ordinary prefix.

Candidates of a signature are, by size band, its smallest document with every other one, all pairs where these are
few. A sketch of single bits, one parity per bit and at least 1.5 bits a token, then drops pairs whose Hamming
distance exceeds D (the larger of two sketches is folded to the size of the smaller), and the shingles of the others
are compared. Signatures with many documents in several components get a second look (``_second_look``), so no link
is lost and no group is spelled out in pairs. Equal sets are one class throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markcheck.llm._drop import without
from markcheck.llm._sample import Frequencies, frequent, times_of
from markcheck.llm.components import components
from markcheck.llm.shingles import SLICE, SLICE_BYTES, WIDTH, mix, shingle_set, shingle_sets, slices, starts_of
from markcheck.scratch import materialize

#: Parts per token. The more, the more signatures a document has, is sure of and leaves out.
PARTS = 4
#: Bits of the sketch that joins compare, and bits a token of the wide one, before rounding up to a power of two.
SKETCH, BITS = 512, 1.5
#: A signature with no more documents than this has all its pairs compared.
SMALL = 8
#: Signatures that one group of the matching step holds on average; a more frequent one is dealt to several groups.
BUCKET = 100_000
#: Signatures that a task holds before it deals them to groups, so that rows stay few however many groups there are.
HELD = 200_000

_NARROW = "doc_id long, n long, fp1 long, fp2 long, sketch array<bigint>, wide binary"
_PACKED = "bucket long, sigs binary, docs binary, sizes binary"
_MATCHED = "many boolean, sig long, band int, a long, b long"
_U = np.uint64
_STEPS = np.arange(7)
#: Signatures of a document that tell where it first meets another, see ``_meetings``.
TOPS = 16
#: Pairs that are broadcast to the scan of the texts; more are joined by shuffling the texts.
BROADCAST = 1_000_000


def _parts(size: np.ndarray) -> np.ndarray:
    return np.maximum(1, np.ceil(PARTS * size)).astype(np.int64)


def _bit_length(x: np.ndarray) -> np.ndarray:
    high = (x >> _U(32)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.frexp((x & _U(0xFFFFFFFF)).astype(np.float64))[1])


def _split(tokens: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The number of parts at which the cell of the first ``bits`` bits is the last that is still whole."""
    return np.where(bits < 40, (1 << np.minimum(bits, 40)) + (tokens >> _U(1) >> (_U(63) - np.minimum(bits, 40).astype(_U))).astype(np.int64), 1 << 62)


def _signatures(tokens: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of token sets, the set that each is of, and by set how many any similar one is sure to share.

    ``tokens`` are the sorted sets one after the other, ``counts`` their sizes, none of them 0.
    """
    of = np.repeat(np.arange(len(counts)), counts)
    n_parts = _parts(counts)
    d = np.frexp(n_parts.astype(np.float64))[1] - 1
    at = (tokens >> (63 - d).astype(_U)[of]).astype(np.int64)  # part if split
    deep = at < (2 * (n_parts - (1 << d)))[of]
    cell = np.where(deep, at, at >> 1)
    fresh = np.ones(len(tokens), bool)
    fresh[1:] = (cell[1:] != cell[:-1]) | (deep[1:] != deep[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(tokens)) - 1
    xor, owner = np.bitwise_xor.reduceat(tokens, first), of[first]

    # bits that a token has in common with the one before it in its set, -1 where there is none
    common = np.full(len(tokens) + 1, -1)
    common[1:-1] = np.where(of[1:] == of[:-1], 64 - _bit_length(tokens[1:] ^ tokens[:-1]), -1)
    near = np.maximum(common[first], common[last + 1])
    since = np.where(near < 0, 0, _split(tokens[first], np.maximum(near, 0)) + 1)  # below, another token joins the part
    until = np.where(first == last, 1 << 62, _split(tokens[first], 64 - _bit_length(tokens[first] ^ tokens[last])))

    low, high = -(-counts * percent // 100), counts * 100 // percent
    # partners by size: one bound for all larger ones, as these share the less the larger they are, then steps below
    span = (counts - low)[:, None]
    sizes = np.concatenate([high[:, None], low[:, None] + span * _STEPS[:-1] // _STEPS[-1]], 1)
    upper = np.concatenate([high[:, None], low[:, None] + span * _STEPS[1:] // _STEPS[-1]], 1)
    theirs, cells = _parts(sizes), starts_of(owner)
    shared = np.stack([np.add.reduceat((since <= q[owner]) & (q[owner] <= until), cells) for q in theirs.T], 1)
    return mix(xor + _U(0x632BE59BD9B4E019)), owner, (shared - (counts[:, None] + upper) * (100 - percent) // (100 + percent)).min(1)


def _emitted(tokens: np.ndarray, counts: np.ndarray, percent: int, frequencies: Frequencies) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures to join on, the set that each is of, and how often the sample has them."""
    sig, owner, sure = _signatures(tokens, counts, percent)
    often = times_of(sig, frequencies)
    order = np.lexsort((sig, often, owner))
    sig, owner, often = sig[order], owner[order], often[order]
    starts = starts_of(owner)
    total = np.bincount(owner, minlength=len(counts))
    rank = np.arange(len(sig)) - starts[owner]
    keep = rank <= (total - sure)[owner]
    # sets that are sure of none: all their signatures, and a prefix of their tokens
    unsure = sure < 1
    of = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(tokens)) - (np.cumsum(counts) - counts)[of]
    prefix = np.flatnonzero(unsure[of] & (place <= (counts - -(-counts * percent // 100))[of]))
    keep |= unsure[owner]
    return (
        np.concatenate([sig[keep], mix(tokens[prefix] ^ _U(0x5851F42D4C957F2D))]),
        np.concatenate([owner[keep], of[prefix]]),
        np.concatenate([often[keep], np.zeros(len(prefix), np.int64)]),
    )


def _sketches(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """By set the sketch of ``SKETCH`` bits, as rows of 64-bit values, and the wide one."""
    bits = np.maximum(SKETCH, 1 << (np.frexp((BITS * counts).astype(np.int64) - 0.5)[1]))
    ends = np.cumsum(bits)
    of = np.repeat(np.arange(len(counts)), counts)
    at = (mix(tokens) & (bits - 1).astype(_U)[of]).astype(np.int64) + (ends - bits)[of]
    odd = (np.bincount(at, minlength=int(ends[-1])) & 1).astype(np.uint8)
    small = np.bitwise_xor.reduceat(odd.reshape(-1, SKETCH), (ends - bits) // SKETCH, axis=0)
    packed = np.packbits(odd).tobytes()
    return np.packbits(small, axis=1).view(np.int64), [packed[(e - n) // 8 : e // 8] for e, n in zip(ends.tolist(), bits.tolist(), strict=True)]


def _distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two wide sketches at the size of the smaller."""
    if len(a) < len(b):
        a, b = b, a
    x, size = int.from_bytes(a, "big"), len(a)
    while size > len(b):
        size //= 2
        x = (x >> (8 * size)) ^ (x & ((1 << (8 * size)) - 1))
    return (x ^ int.from_bytes(b, "big")).bit_count()


def _prints(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum(counts) - counts
    return np.add.reduceat(mix(tokens * _U(3)), starts).view(np.int64), np.bitwise_xor.reduceat(mix(tokens * _U(5) + _U(1)), starts).view(np.int64)


def _sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token sets of the rows, those that have any: tokens, sizes, rows."""
    texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary()).to_pylist()
    tokens, counts = shingle_sets(texts, width)
    rows = np.flatnonzero(counts)
    return tokens, counts[rows], rows


def _ids(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.get_field_index("doc_id"))


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE, SLICE_BYTES):
            tokens, counts, rows = _sets(b, width)
            n, fp1, fp2 = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            sketch, wide = np.zeros((b.num_rows, SKETCH // 64), np.int64), [b""] * b.num_rows
            if len(rows):
                n[rows] = counts
                fp1[rows], fp2[rows] = _prints(tokens, counts)
                sketch[rows], found = _sketches(tokens, counts)
                for k, x in zip(rows.tolist(), found, strict=True):
                    wide[k] = x
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * (SKETCH // 64)), pa.array(sketch.ravel()))
            yield pa.RecordBatch.from_arrays([_ids(b), pa.array(n), pa.array(fp1), pa.array(fp2), lists, pa.array(wide, pa.binary())], ["doc_id", "n", "fp1", "fp2", "sketch", "wide"])

    return run


def _all_signatures(width: int, percent: int):
    def run(batch: pa.RecordBatch) -> np.ndarray:
        tokens, counts, rows = _sets(batch, width)
        return _signatures(tokens, counts, percent)[0] if len(rows) else np.zeros(0, np.uint64)

    return run


def _pack(width: int, percent: int, buckets: int, frequencies, weight: float):
    """Per bucket and some slices one row with signatures and documents; only the first of equal sets in a slice takes part.

    Sizes are negative where a signature is dealt to several groups.
    """

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        bucket, *columns = map(np.concatenate, zip(*held, strict=True))
        held.clear()
        order = np.argsort(bucket, kind="stable")
        bucket, columns = bucket[order], [x[order] for x in columns]
        cut = starts_of(bucket)
        ends = np.append(cut[1:], len(bucket))
        packed = [pa.array([x[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary()) for x in columns]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), *packed], ["bucket", "sigs", "docs", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in slices(batches, SLICE, SLICE_BYTES):
            b = b.filter(_ids(b).is_valid())
            tokens, counts, rows = _sets(b, width)
            if not len(rows):
                continue
            _, once = np.unique(np.stack([counts, *_prints(tokens, counts)], 1), axis=0, return_index=True)
            first = np.zeros(len(counts), bool)
            first[once] = True
            tokens, counts, rows = tokens[np.repeat(first, counts)], counts[first], rows[first]
            sig, owner, often = _emitted(tokens, counts, percent, frequencies.value)
            doc = _ids(b).to_numpy(zero_copy_only=False)[rows][owner].astype(np.int64)
            deals = np.maximum(1, often * weight / BUCKET).astype(_U)
            salt = mix(doc.view(_U) + _U(1)) % deals
            size = np.where(deals > 1, -counts[owner], counts[owner]).astype(np.int32)
            held.append(((mix(sig + salt * _U(0x9E3779B97F4A7C15)) % _U(buckets)).astype(np.int64), sig, doc, size))
            if sum(len(h[0]) for h in held) >= HELD:
                yield flush(held)
        if held:
            yield flush(held)

    return run


def _band(size: np.ndarray, percent: int) -> np.ndarray:
    """Band of a size; similar sets are in one band or in neighbouring ones."""
    return np.floor(np.log(size) / max(0.01, 1.001 * math.log(100 / percent))).astype(np.int32)


def _match(percent: int):
    def run(group: pa.Table) -> pa.Table:
        """Candidate pairs of a bucket, then (signature, band, centre, document) of its signatures with many documents."""
        sig, doc, size = (np.concatenate([np.frombuffer(x, t) for x in group.column(c).to_pylist()]) for c, t in (("sigs", np.int64), ("docs", np.int64), ("sizes", np.int32)))
        group = None
        dealt, size = size < 0, np.abs(size)
        band = _band(size, percent)
        order = np.lexsort((doc, band, sig))
        sig, doc, size, band, dealt = sig[order], doc[order], size[order].astype(np.int64), band[order], dealt[order]
        run = np.cumsum(np.concatenate(([True], sig[1:] != sig[:-1]))) - 1
        few = (np.bincount(run) <= SMALL)[run] & ~dealt  # however few are here, other groups hold more
        pairs = []
        for k in range(1, min(SMALL, len(doc))):
            i = np.flatnonzero(few[:-k] & (run[:-k] == run[k:]))
            i = i[100 * np.minimum(size[i], size[i + k]) >= percent * np.maximum(size[i], size[i + k])]
            pairs.append(np.stack([doc[i], doc[i + k]], 1))
        sig, doc, size, band, run = (x[~few] for x in (sig, doc, size, band, run))
        cell = np.cumsum(np.concatenate(([True], (run[1:] != run[:-1]) | (band[1:] != band[:-1]))))[: len(run)] - 1
        start = starts_of(cell)
        centre = doc[start]
        if len(start):
            below = np.flatnonzero(np.concatenate(([False], (run[start][1:] == run[start][:-1]) & (band[start][1:] == band[start][:-1] + 1)))[cell])
            for of, i in ((cell, np.arange(len(doc))), (cell[below] - 1, below)):
                near = 100 * np.minimum(size[start[of]], size[i]) >= percent * np.maximum(size[start[of]], size[i])
                pairs.append(np.stack([centre[of[near]], doc[i[near]]], 1))
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *pairs])
        pairs = np.sort(pairs[pairs[:, 0] != pairs[:, 1]], 1)
        if len(pairs):
            order = np.lexsort((pairs[:, 1], pairs[:, 0]))
            pairs = pairs[order]
            pairs = pairs[np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(1)))]
        none = np.zeros(len(pairs), np.int64)
        return pa.table(
            {
                "many": np.concatenate([none.astype(bool), np.ones(len(doc), bool)]),
                "sig": np.concatenate([none, sig]),
                "band": np.concatenate([none.astype(np.int32), band]),
                "a": np.concatenate([pairs[:, 0], centre[cell]]),
                "b": np.concatenate([pairs[:, 1], doc]),
            }
        )

    return run


def _compare(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for b in slices(batches, SLICE, SLICE_BYTES, "b_text"):
            keep = []
            texts = (b.column(b.schema.get_field_index(n)).cast(pa.large_binary()) for n in ("a_text", "b_text"))
            for a, one, other in zip(b.column(0).to_pylist(), *texts, strict=True):
                if a != last or mine is None:
                    last, mine = a, shingle_set(one.as_py(), width)
                theirs = shingle_set(other.as_py(), width)
                both = len(np.intersect1d(mine, theirs, assume_unique=True))
                keep.append(100 * both >= percent * (len(mine) + len(theirs) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _close(percent: int, a: str = "a", b: str = "b") -> Column:
    """What sizes and sketches say: False only for pairs under the similarity."""
    n_a, n_b = F.col(f"{a}_n"), F.col(f"{b}_n")
    hamming = sum((F.bit_count(F.col(f"{a}_sketch")[i].bitwiseXOR(F.col(f"{b}_sketch")[i])) for i in range(1, SKETCH // 64)), F.bit_count(F.col(f"{a}_sketch")[0].bitwiseXOR(F.col(f"{b}_sketch")[0])))
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & ((100 + percent) * hamming <= (100 - percent) * (n_a + n_b))


def _near(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in ("a_n", "b_n", "a_wide", "b_wide")), strict=True)
            keep = [(100 + percent) * _distance(x, y) <= (100 - percent) * (n + m) for n, m, x, y in rows]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _candidates(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of classes that sizes and sketches do not rule out."""
    for x in "ab":
        pairs = pairs.join(reps.select(F.col("class_id").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("n", "sketch", "wide"))), x)
    return pairs.where(_close(percent)).select("a", "b", "a_n", "b_n", "a_wide", "b_wide").mapInArrow(_near(percent), "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose shingles reach the similarity; texts travel, as they pack better than hashes."""
    side = F.broadcast if pairs.count() <= BROADCAST else lambda x: x
    one = texts.join(side(pairs.select("a").distinct()), F.col("doc_id") == F.col("a")).select("a", F.col("text").alias("a_text"))
    other = texts.join(side(pairs), F.col("doc_id") == F.col("b")).select("a", "b", F.col("text").alias("b_text"))
    found = other.join(one, "a").select("a", "b", "a_text", "b_text").mapInArrow(_compare(width, percent), "a long, b long")
    return materialize(found.distinct(), "verified")


def _linked(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links that connect all that ``pairs`` can connect, and the components they make.

    Each class is compared with its smallest candidate first; pairs inside one component then need no comparison.
    """
    links = _verified(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), texts, width, percent)
    found = components(links)
    for x in "ab":
        pairs = pairs.join(found.toDF(x, f"{x}_label"), x, "left").withColumn(f"{x}_label", F.coalesce(f"{x}_label", x))
    rest = materialize(pairs.where("a_label <> b_label").select("a", "b").join(links, ["a", "b"], "left_anti"), "rest")
    more = _verified(rest, texts, width, percent)
    if more.isEmpty():
        return links, found
    links = links.unionByName(more)
    return links, components(links)


def similar(docs: DataFrame, percent: int = 75, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, class_id``.

    Documents link when the Jaccard similarity of their word shingles is at least ``percent``; ``component_id`` is
    the smallest id that links reach, ``class_id`` the smallest id with the same shingles. Texts without words, and
    nulls, have no shingles and link with nothing; a row without an id is described but takes part in no link;
    rows that repeat an id are one document. Shingles are compared by 64-bit hashes. Other columns are ignored. A text
    of any length is read whole; a task's memory follows its longest text.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    info = materialize(texts.mapInArrow(_describe(width), _NARROW), "shingle-sets")
    total, rows = info.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequencies, weight = frequent(texts, rows, _all_signatures(width, percent))
    shared = docs.sparkSession.sparkContext.broadcast(frequencies)
    buckets = max(16, int(0.4 * total / BUCKET))

    linkable = info.where("doc_id is not null and n > 0")
    classes = linkable.groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("class_id"))
    members = materialize(linkable.join(classes, ["n", "fp1", "fp2"]).dropDuplicates(["doc_id", "n", "fp1", "fp2"]).select("doc_id", "class_id", "n", "sketch", "wide"), "classes")
    packed = texts.mapInArrow(_pack(width, percent, buckets, shared, weight), _PACKED)
    matched = materialize(packed.groupBy("bucket").applyInArrow(_match(percent), _MATCHED), "matched")

    # an id on several texts has several classes, which are one component
    several = members.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a <> b")
    several = materialize(members.join(several, "doc_id").select("doc_id", "class_id", "a").distinct(), "same-id")
    of = members.where("doc_id <> class_id").select("doc_id", "class_id").unionByName(several.select("doc_id", "class_id")).distinct()
    same = several.select("a", F.col("class_id").alias("b")).where("a <> b").distinct()
    pairs = matched.where("not many").select("a", "b").unionByName(_across(matched.where("many"))).distinct()
    pairs = _as_classes(pairs, of, "a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    reps = members.where("doc_id = class_id")
    pairs = materialize(_candidates(pairs, reps, percent), "pairs")
    links, found = _linked(pairs, texts, width, percent)

    many = _as_classes(matched.where("many").select("sig", "band", F.col("b").alias("class_id")), of, "class_id").distinct()
    more = _second_look(many, reps, found, pairs, percent)
    more = same if more.isEmpty() else same.unionByName(_verified(more, texts, width, percent))
    if not more.isEmpty():
        found = components(links.unionByName(more))
    found = found.toDF("class_id", "component_id")
    labelled = members.select("doc_id", "class_id").join(found, "class_id", "left").groupBy(F.col("doc_id").alias("id"))
    labelled = labelled.agg(F.min("class_id").alias("class_id"), F.min(F.coalesce("component_id", "class_id")).alias("component_id"))
    out = info.join(labelled, info["doc_id"] == labelled["id"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def _as_classes(rows: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with documents replaced by the class that stands for them."""
    for x in columns:
        rows = rows.join(of.toDF(x, "__class"), x, "left").withColumn(x, F.coalesce("__class", x)).drop("__class")
    return rows


def _across(many: DataFrame) -> DataFrame:
    """Pairs of the centres of a signature and band that was dealt to several groups."""
    centres = many.where("a = b").select("sig", "band", "a")
    first = centres.groupBy("sig", "band").agg(F.min("a").alias("least"), F.count("*").alias("n")).where("n > 1")
    return centres.join(first, ["sig", "band"]).where("a <> least").select(F.col("least").alias("a"), F.col("a").alias("b"))


def _meetings(live: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of classes of different components that meet in a signature and that sizes and sketches do not rule out.

    Near copies share very many signatures. Two classes that share one of the ``TOPS`` most frequent of each are made a
    pair by the first of these alone, others by every signature that they share.
    """
    order = live.groupBy("sig").agg((-F.count("*")).alias("__order"))
    tops = live.join(order, "sig").groupBy("class_id").agg(F.array_sort(F.collect_set(F.struct("__order", "sig"))).alias("__tops"), (F.min("band") == F.max("band")).alias("__one"))
    # a class of several bands, by an id on several texts, does not meet others alike in all its signatures
    tops = tops.select("class_id", F.when(F.col("__one"), F.slice("__tops.sig", 1, TOPS)).otherwise(F.expr("cast(array() as array<bigint>)")).alias("tops"))
    live = materialize(live.join(tops, "class_id"), "second-look")
    a, b = (live.select("sig", "band", F.col("class_id").alias(x), F.col("component").alias(f"{x}_component"), F.col("n").alias(f"{x}_n"), *(F.col(c).alias(f"{x}_{c}") for c in ("sketch", "tops"))) for x in "ab")
    b = b.withColumn("own", F.col("band")).withColumn("band", F.explode(F.array("band", F.col("band") - 1)))
    first = F.coalesce(F.get(F.array_intersect("a_tops", "b_tops"), F.lit(0)), F.col("sig"))
    pairs = a.join(b, ["sig", "band"]).where(((F.col("own") > F.col("band")) | (F.col("a") < F.col("b"))) & (F.col("a_component") != F.col("b_component")) & _close(percent) & (first == F.col("sig")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _second_look(many: DataFrame, reps: DataFrame, found: DataFrame, done: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that only signatures with many documents could have brought together and did not.

    Of a signature whose documents are all in one component nothing more is to be learnt. Of the others, pairs of
    different components that sizes and sketches do not rule out, and that were not compared before, are compared.
    """
    held = many.join(found.toDF("class_id", "component"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    several = held.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("sig")
    several = materialize(several, "live-signatures")  # read anew, so that the join can split what a frequent one holds
    live = held.join(several, "sig").join(reps.select("class_id", "n", "sketch"), "class_id")
    pairs = _meetings(materialize(live, "live-rows"), percent).distinct().join(done, ["a", "b"], "left_anti")
    return materialize(_candidates(pairs, reps, percent), "more-pairs")


def keep_one(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the smallest id of every component; columns stay as they are.

    Rows without an id, without words and without text stay; rows that repeat an id stay or go together.
    """
    return without(docs, similar(docs, percent, id_col=id_col, text_col=text_col).where("doc_id <> component_id").select("doc_id"), id_col)
