"""Packing keeps every id once, wastes little, and finds the tightest window; ids are those of the tokenizers library."""

import random
import zlib
from collections import defaultdict

import pytest

from markcheck.llm import packing, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(packing.bundled_vocabulary())


def test_ids_are_those_of_the_library_for_every_code_point(encoder):
    assert encoder.fast is not None
    for lo in range(0, 0x110000, 128):
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in range(lo, lo + 128) if not 0xD800 <= c < 0xE000)
        assert encoder.encode(text) == encoder.whole(text), hex(lo)


def test_ids_of_odd_and_long_texts(encoder, monkeypatch):
    texts = ["", " ", "a  b", "x \n y", "don't 'sx !'s", "a<|endoftext|>b <|endoftext|> c", "\r\n a\r\n b ", "word.\n\n  next", "'s 's''ll", "a\xa0b \xa0 c", "日本 語 テ", "\t\ta "]
    rng = random.Random(1)
    texts += ["".join(rng.choice("ab 's.,\n\t1é²\xa0A'll \x85日​") for _ in range(rng.randrange(1, 40))) for _ in range(2_000)]
    for stretch in (1_000_000, 6):
        monkeypatch.setattr(packing, "STRETCH", stretch)
        assert all(encoder.encode(t) == encoder.whole(t) for t in texts)
    long = " ".join(texts) * 20
    monkeypatch.setattr(packing, "STRETCH", 5_000)
    assert encoder.encode(long) == encoder.whole(long)


def tightest(lengths, window):
    """Best fit by looking at every open window."""
    rooms, windows = [], []
    for item, n in enumerate(lengths):
        fits = [(room, k) for k, room in enumerate(rooms) if room >= n]
        if fits:
            room = min(fits)[0]
            k = max(k for r, k in fits if r == room and k == max(fits_k for fr, fits_k in fits if fr == room))
        else:
            rooms.append(window)
            windows.append([])
            k = len(rooms) - 1
        rooms[k] -= n
        windows[k].append(item)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_takes_the_tightest_window(seed):
    rng = random.Random(seed)
    window = rng.choice([1, 7, 16, 100])
    lengths = sorted((rng.randint(1, window) for _ in range(rng.randrange(120))), reverse=True)
    windows = packing.best_fit(lengths, window)
    assert sorted(i for w in windows for i in w) == list(range(len(lengths)))
    assert sorted(window - sum(lengths[i] for i in w) for w in windows) == tightest(lengths, window)
    closed = packing.closed(windows, lengths, window, slack := window // 8)
    parts = defaultdict(list)
    open_ones = 0
    for w in closed:
        total = sum(n for _, _, n in w)
        assert total <= window and all(n > 0 for _, _, n in w)
        open_ones += window - total > slack and total & (total - 1) > 0
        for item, start, n in w:
            parts[item].append((start, n))
    assert open_ones == 0
    for item, own in parts.items():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at == lengths[item]
    assert len(parts) == len(lengths)


def check(rows, docs, encoder, window=1024):
    """Every id of every document in one piece, sequences gapless; gives the share of padding."""
    sequences, total, padding = defaultdict(list), 0, 0
    for r in rows:
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
        total += at
        padding += window - at if at & (at - 1) else 0
    got, want = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for doc_id, text in docs:
        want[doc_id].append(encoder.whole(text or "") + bytes(4))
    assert set(got) == set(want)
    for doc_id, texts in want.items():
        assert sum(n for _, n, _, _ in got[doc_id]) == sum(len(t) // 4 for t in texts)
        for start, n, crc, tokens in got[doc_id]:
            assert any(len(t) // 4 == tokens and zlib.crc32(t[4 * start : 4 * (start + n)]) == crc for t in texts)
    return padding / max(1, total)


@pytest.mark.parametrize("shard", [20_000, 40])
def test_query_packs_every_id_with_little_padding(spark, encoder, shard):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frame = registry.QUERIES["op13_packing"](spark, SF) if shard == 20_000 else packing.packed(docs, shard=shard)
    assert check(frame.collect(), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], encoder) < 0.02


def test_odd_documents(spark, encoder):
    word = "lorem ipsum "
    docs = [(1, None), (2, ""), (3, word * 3000), (3, "again"), (None, "no id"), (None, "no id"), (4, "x" * 50_000), (5, "<|endoftext|>"), *((n, word * 300) for n in range(10, 40))]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, start int, rest string")
    for window in (1024, 64, 1):
        rows = packing.packed(frame, window=window).collect()
        assert check(rows, docs, encoder, window) < 0.02
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    wide = packing.packed(frame, id_bits=32).collect()
    assert check(wide, docs, encoder) < 0.02
