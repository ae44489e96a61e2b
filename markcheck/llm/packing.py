"""Packing of documents into fixed windows of tokens by best-fit decreasing.

A document's ids are cut into full windows, which need no packing, and a rest. Rests are dealt evenly to shards of a
fixed number of rows, and each shard is packed in one task: longest rest first, into the open window whose remaining
capacity is the least that suffices, which a segment tree over capacities finds. What best fit leaves open is then
closed: the emptiest windows are cut to fill the gaps of the fullest, and the one window a shard is left with is
split at powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markcheck.llm.shingles import slices
from markcheck.scratch import materialize

#: Rests of a shard: what one task packs at once.
SHARD = 20_000
#: Gaps of up to this share of a window stay open, as filling them would cut documents into slivers.
SLACK = 128
#: Documents and bytes of text that are encoded at a time; characters after which a long text is cut at a space.
ROWS, BYTES, STRETCH = 500, 4_000_000, 1_000_000
#: Bytes of an id.
WIDTH = 4

#: How byte-level vocabularies cut texts, possessively where nothing can be given back.
_CUTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_BREAK = re.compile(r"[!-~](?= [!-~])")


def _bytes_by_character() -> dict[str, int]:
    """The bytes that characters of a byte-level vocabulary stand for: visible ones for themselves, others from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b < 127 or 161 <= b and b != 173]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Ids of texts as the tokenizers library gives them for a file of byte-level BPE without normalisation.

    Where the file's merges stand in the order of their ids, they are applied by tiktoken, which takes a quarter of
    the time; tests compare the two over every code point. Any other file is left to tokenizers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = self._ranked(json.loads(Path(path).read_text(encoding="utf-8")))

    def _ranked(self, file: dict):
        import tiktoken

        model, cut = file["model"], file.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or file.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            return None
        special = {t["content"]: t["id"] for t in file.get("added_tokens", ())}
        own, byte = {t: i for t, i in model["vocab"].items() if t not in special}, _bytes_by_character()
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(own.values())[256:] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in file.get("added_tokens", ())):
            return None
        return tiktoken.Encoding("ranked", pat_str=_CUTS, mergeable_ranks={bytes(map(byte.__getitem__, t)): i for t, i in own.items()}, special_tokens=special)

    def whole(self, text: str) -> bytes:
        """The ids of ``text`` by tokenizers, each as four little-endian bytes."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The same, the faster way where there is one; a long text goes in stretches."""
        if self.fast is None:
            return self.whole(text)
        return b"".join(self.fast.encode_to_numpy(part, allowed_special="all", disallowed_special=()).astype("<u4", copy=False).tobytes() for part in _stretches(text))


def _stretches(text: str) -> Iterator[str]:
    """``text`` cut at spaces between visible ASCII characters, where the tokenizer cuts too; special strings hold no space."""
    lo = 0
    while lo < len(text):
        cut = _BREAK.search(text, lo + STRETCH) if len(text) - lo > STRETCH else None
        hi = cut.end() if cut else len(text)
        yield text[lo:hi]
        lo = hi


class Capacities:
    """Segment tree over the remaining capacities 0 to ``window``: how many open windows have each."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, number: int) -> None:
        self.open[capacity].append(number)
        at = self.size + capacity
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Takes out an open window of the smallest capacity that is ``least`` or more: capacity and number."""
        at = self.size + least
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        capacity = at - self.size
        number = self.open[capacity].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return capacity, number


def best_fit(lengths: list[int], window: int) -> list[list[int]]:
    """Items by window; items come longest first, each no longer than ``window``."""
    capacities, windows = Capacities(window), []
    for item, length in enumerate(lengths):
        found = capacities.take(length)
        if found is None:
            windows.append([item])
            capacities.add(window - length, len(windows) - 1)
        else:
            capacity, number = found
            windows[number].append(item)
            capacities.add(capacity - length, number)
    return windows


def closed(windows: list[list[int]], lengths: list[int], window: int, slack: int) -> list[list[tuple[int, int, int]]]:
    """Windows as pieces ``(item, from, length)``: gaps over ``slack`` filled from the emptiest windows, the last split."""
    fill = [sum(lengths[i] for i in w) for w in windows]
    out = [[(i, 0, lengths[i]) for i in w] for w in windows]
    gaps = sorted((k for k in range(len(out)) if window - fill[k] > slack), key=lambda k: (-fill[k], k))
    done = [out[k] for k in range(len(out)) if window - fill[k] <= slack]
    head, tail = 0, len(gaps) - 1
    while head < tail:
        into, of = gaps[head], gaps[tail]
        item, start, length = out[of].pop()
        n = min(length, window - fill[into])
        out[into].append((item, start, n))
        fill[into] += n
        fill[of] -= n
        if n < length:
            out[of].append((item, start + n, length - n))
        if window - fill[into] <= slack:
            done.append(out[into])
            head += 1
        if not out[of]:
            tail -= 1
    if head == tail:
        done += _powers(out[gaps[head]], fill[gaps[head]])
    return done


def _powers(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """The pieces of one window over windows whose lengths are the powers of two that add up to ``total``."""
    out, left = [], list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        room, own = total & (1 << bit), []
        while room:
            item, start, length = left.pop()
            n = min(length, room)
            own.append((item, start, n))
            if n < length:
                left.append((item, start + n, length - n))
            room -= n
        if own:
            out.append(own)
    return out


#: Encoders of this worker process.
_READY: dict[str, Encoder] = {}


def _crc(ids: bytes) -> int:
    return zlib.crc32(ids)


def _pieces(locate: Callable[[], str], window: int, end_id: int, narrow: bool) -> Callable:
    """Full windows, and rests with their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = locate()
        if path not in _READY:
            _READY[path] = Encoder(path)
        encode, end = _READY[path].encode, end_id.to_bytes(WIDTH, "little")
        for b in slices(batches, ROWS, BYTES):
            row, start, length, crc, total, rest = [], [], [], [], [], []
            for k, text in enumerate(b.column(b.schema.get_field_index("text")).to_pylist()):
                ids = encode(text or "") + end
                n = len(ids) // WIDTH
                for lo in range(0, n, window):
                    own = ids[lo * WIDTH : (lo + window) * WIDTH]
                    size = len(own) // WIDTH
                    row.append(k)
                    start.append(lo)
                    length.append(size)
                    crc.append(_crc(own))
                    total.append(n)
                    rest.append(None if size == window else np.frombuffer(own, "<u4").astype("<u2").tobytes() if narrow else own)
            ids_of = b.column(b.schema.get_field_index("doc_id")).take(pa.array(row, pa.int64()))
            longs = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays([ids_of, *longs, pa.array(rest, pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rest"])

    return run


def _pack(window: int, slack: int, narrow: bool) -> Callable:
    """Packs the rows of a task, and numbers its sequences behind those of the tasks before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held = TaskContext.get().partitionId() << 32, list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        del held
        column = {n: table.column(n).combine_chunks() for n in table.column_names}
        start, length, crc, total = (column[n].to_pylist() for n in ("start", "length", "ids_crc32", "doc_tokens"))
        rest = column["rest"]
        order = sorted(range(len(length)), key=lambda k: (-length[k], total[k], start[k], crc[k]))
        lengths = [length[k] for k in order]
        rows: list[tuple[int, int, int, int, int, int]] = []
        for number, pieces in enumerate(closed(best_fit(lengths, window), lengths, window, slack)):
            offset = 0
            for item, lo, n in pieces:
                k = order[item]
                if n == length[k]:
                    own = crc[k]
                else:
                    ids = np.frombuffer(rest[k].as_py(), "<u2" if narrow else "<u4")[lo : lo + n]
                    own = _crc(ids.astype("<u4").tobytes())
                rows.append((k, start[k] + lo, n, own, first + number, offset))
                offset += n
        at, begin, size, own, sequence, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        take = pa.array(at)
        yield from pa.Table.from_arrays(
            [column["doc_id"].take(take), pa.array(begin), pa.array(size), pa.array(own), column["doc_tokens"].take(take), pa.array(sequence), pa.array(offset)],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        ).to_batches(max_chunksize=10_000)

    return run


def bundled_vocabulary() -> str:
    """Path, on the machine that asks, of the 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packed(docs: DataFrame, window: int = 1024, end_id: int = 0, vocabulary: str | Callable[[], str] = bundled_vocabulary, shard: int = SHARD, id_bits: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its ids and ``end_id``. Full windows are sequences of their own; rests are packed best fit first,
    ``shard`` of them at a time. Gaps over 1/128 of a window are filled with parts of the emptiest windows. A sequence
    may be shorter than ``window`` by that share, or be of a power of two. ``id_bits`` is 16, or 32 for vocabularies
    of more than 65,536 ids. Null and empty texts are ``end_id`` alone; rows that repeat an id or a text are documents
    of their own; a null id stays null; a very long text is encoded in stretches, its memory follows its length; other
    columns are ignored; an empty table gives no rows.
    """
    locate = vocabulary if callable(vocabulary) else lambda: vocabulary
    narrow, slack = id_bits <= 16, window // SLACK
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long"
    cut = materialize(rows.mapInArrow(_pieces(locate, window, end_id, narrow), f"{shape}, rest binary"), "token-pieces")
    rests = cut.where("rest is not null")
    shards = max(1, -(-rests.count() // shard))
    packs = rests.repartition(shards).mapInArrow(_pack(window, slack, narrow), f"{shape}, sequence_id long, offset long")
    # A full window's number follows from its place in the written table; negative, so that it meets no packed one.
    full = cut.where("rest is null").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packs.unionByName(full)
