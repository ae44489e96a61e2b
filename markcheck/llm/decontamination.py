"""Benchmark decontamination as a prefix-filtered set join.

A window of item words can only occur where its rarest word occurs, so that word alone is its necessary prefix.
Words are ordered by how often they occur in all documents; every place in a document that holds a prefix word is
a candidate, the positional bound asks for the window's second rarest word at its own offset and the length bound
for room on both sides, and what is left is compared word by word.

The benchmark is the stated query set: it goes through in blocks of bounded bytes, each broadcast, so neither its
size nor a hot passage moves a document's text through a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markcheck.llm.shingles import SLICE, SLICE_BYTES, slices

#: Words of a window; shorter items are one window.
WINDOW = 13
#: Bytes of item texts in a block.
BLOCK_BYTES = 4 << 20

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(c if c >= 0x80 or c in _KEEP else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all characters beyond ASCII."""
    return text.translate(_TABLE).split() if text else []


def _binary(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def _frequencies(vocabulary) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = vocabulary.value, Counter()
        for b in batches:
            for text in _binary(b, "text"):
                seen.update(w for w in words_of(text) if w in known)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return run


def _index(items: list[tuple[str, list[bytes]]], often: dict[bytes, int], width: int) -> dict[bytes, list[tuple]]:
    """By prefix word: (item, first word of the window, its length, prefix offset, second offset and word)."""
    index: dict[bytes, list[tuple]] = {}
    for at, (_, words) in enumerate(items):
        size = min(width, len(words))
        rarity = [(often.get(w, 0), w) for w in words]
        for start in range(len(words) - size + 1):
            order = sorted(range(start, start + size), key=rarity.__getitem__)
            if not rarity[order[0]][0]:
                continue  # its rarest word is in no document
            second = order[1 % size]
            index.setdefault(words[order[0]], []).append((at, start, size, order[0] - start, second - start, words[second]))
    return index


def _find(words: list[bytes], index: dict[bytes, list[tuple]], items: list) -> tuple[list[tuple[int, int]], set[int]]:
    spans, found = [], set()
    for place in [i for i, w in enumerate(words) if w in index]:
        for at, start, size, offset, second, other in index[words[place]]:
            begin = place - offset
            if begin < 0 or begin + size > len(words) or words[begin + second] != other:
                continue
            if words[begin : begin + size] == items[at][1][start : start + size]:
                spans.append((begin, begin + size))
                found.add(at)
    return spans, found


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(block, text_col: str) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, index = block.value
        for b in slices(batches, SLICE, SLICE_BYTES, text_col):
            names = b.schema.names
            counts, spans, ids = [], [], []
            old = zip(b.column(names.index("__spans")).to_pylist(), b.column(names.index("__items")).to_pylist(), strict=True)
            for text, (was, had) in zip(_binary(b, text_col), old, strict=True):
                words = words_of(text)
                hits, found = _find(words, index, items)
                counts.append(len(words))
                spans.append([{"start": x, "end": y} for x, y in _union(hits + [(s["start"], s["end"]) for s in was])] if hits else was)
                ids.append(sorted({*had, *(items[at][0] for at in found)}))
            made = {"__words": pa.array(counts, pa.int64()), "__spans": pa.array(spans, _SPANS), "__items": pa.array(ids, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([made.get(n, b.column(i)) for i, n in enumerate(names)], names)

    return run


def _annotated(rows: DataFrame, benchmark: DataFrame, width: int, block_bytes: int, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """``rows`` with ``__words``, ``__spans``, ``__items``, ``__hit`` and ``__contaminated``."""
    spark = rows.sparkSession
    asked = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    total = asked.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))

    empty = {"__words": F.lit(0).cast("long"), "__spans": F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"), "__items": F.expr("cast(array() as array<string>)")}
    out = rows.withColumns(empty)
    schema = out.schema
    for block in range(blocks):
        items = [(r.item, w) for r in asked.where(F.col("block") == block).select("item", "text").toLocalIterator() if (w := words_of(r.text.encode()))]
        vocabulary = spark.sparkContext.broadcast({w for _, words in items for w in words})
        often = rows.select(F.col(text_col).alias("text")).mapInArrow(_frequencies(vocabulary), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
        often = {bytes(r.word): r.n for r in often.toLocalIterator()} if items else {}  # no more words than the block has
        out = out.mapInArrow(_scan(spark.sparkContext.broadcast((items, _index(items, often, width))), text_col), schema)

    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.withColumn("__hit", hit).withColumn("__contaminated", (F.col("__hit") > 0) & (20 * F.col("__hit") >= F.col("__words")))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, spans, items, n_hit, n_items, items_sha256, contaminated``.

    ``spans`` are the merged word ranges that lie inside an occurrence of an item window, ``items`` the item ids as
    sorted strings. A document is contaminated when at least a twentieth of its words are hit. Null and empty texts
    have no words; items without words or text match nothing; an item without an id counts as the id ''. Repeated
    rows stay repeated; other columns are ignored; an empty benchmark or table is fine; a text of any length is read
    whole.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _annotated(rows, benchmark, width, block_bytes, "text", item_col, item_text_col).select(
        "doc_id",
        F.col("__words").alias("n_words"),
        F.col("__spans").alias("spans"),
        F.col("__items").alias("items"),
        F.col("__hit").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
        F.col("__contaminated").alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without its contaminated rows, each judged by itself, also where rows repeat an id; columns stay as they are.

    Nulls and texts without words stay, as does everything where the benchmark is empty.
    """
    return _annotated(docs, benchmark, width, block_bytes, text_col, item_col, item_text_col).where(~F.col("__contaminated")).select(*docs.columns)


ORACLE = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM wins),
places AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM lowered, sizes WHERE len(w) >= size)
), hits AS (
  SELECT doc_id, item_id, i, size FROM places JOIN wins USING (size, gram)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS joined FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id
)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM lowered LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
