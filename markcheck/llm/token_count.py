"""Token counts by byte-pair merging over a heap and a linked list.

Only the count is wanted, so no identifiers are made: a text of ``n`` symbols that takes ``m`` merges has ``n - m``
tokens, plus the extra bytes of symbols that the vocabulary lacks.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Distinct words whose counts a worker keeps; beyond it the memory is emptied, which changes no count.
MEMO = 300_000


class PieceModel:
    """Vocabulary of a piece model with byte fallback, identity normalisation and a leading space mark."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ordinary = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        pieces = {model.id_to_piece(i): -model.get_score(i) for i in ordinary}
        self.rank = pieces
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece holds a space after other characters; words can't be merged apart")
        inner = {c for p in pieces if len(p) > 1 for c in p}
        #: Characters that no merge can involve: texts are cut there first.
        self.cuts = [c for c in "\n\r\t" if c not in inner]

    def count(self, word: str) -> int:
        """Tokens of one stretch that is merged on its own."""
        rank, symbols = self.rank, list(word)
        n = len(symbols)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(rank[p], i, p) for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in rank]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, piece = heapq.heappop(heap)
            left = symbols[i]
            if left is None or (j := after[i]) < 0 or left + symbols[j] != piece:
                continue  # one of the two has been merged since
            merges += 1
            symbols[i], symbols[j] = piece, None
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (p := piece + symbols[k]) in rank:
                    heapq.heappush(heap, (rank[p], i, p))
            h = before[i]
            if h >= 0 and (p := symbols[h] + piece) in rank:
                heapq.heappush(heap, (rank[p], h, p))
        return n - merges + sum(len(c.encode()) - 1 for c in symbols if c is not None and len(c) == 1 and c not in rank)


class Counter(dict):
    """Counts by word, filled on demand."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model
        self.split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        n = self.model.count(word)
        if len(word) < 100:
            self[word] = n
        return n

    def text(self, text: str) -> int:
        if not text:
            return 0
        lines = [SPACE + text.replace(" ", SPACE)]
        for c in self.model.cuts:
            lines = [part for line in lines for part in line.split(c)] if c in text else lines
        cost = len(lines) - 1
        if cost and any(c in self.model.rank for c in self.model.cuts):
            cost = sum(text.count(c) * (1 if c in self.model.rank else len(c.encode())) for c in self.model.cuts)
        get = self.__getitem__
        for line in lines:
            if SPACE + SPACE in line or line.endswith(SPACE):
                cost += sum(map(get, self.split(line)))
            elif line:
                first, *words = line.split(SPACE)
                cost += sum(map(get, [SPACE + w for w in words])) + (get(first) if first else 0)
        return cost


def counter(path: str) -> Counter:
    return Counter(PieceModel(path))


#: Counters of this worker process.
_READY: dict[tuple, Counter] = {}


def _counts(make: Callable[[str], Counter], locate: Callable[[], str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = locate()
        if (make, path) not in _READY:
            _READY[make, path] = make(path)
        count = _READY[make, path]
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            n = pa.array([0 if t is None else count.text(t) for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    return run


def bundled_model() -> str:
    """Path, on the machine that asks, of the 32k piece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(docs: DataFrame, model_path: str | Callable[[], str] = bundled_model, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``; no shuffle.

    ``model_path`` is a path, or a function that gives it on each worker. Null and empty texts have 0 bytes and
    tokens; a long text is merged word by word, so memory follows its length; other columns are ignored.
    """
    locate = model_path if callable(model_path) else lambda: model_path
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(_counts(counter, locate), f"doc_id {id_type}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
