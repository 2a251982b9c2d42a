import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm import data

from voxstrata.llm import packing

RAW = Path(f"{packing.TOKENIZER_DIR}/{packing.VOCABULARY}").read_bytes()


@pytest.fixture(scope="module")
def encoder():
    return packing.UnitEncoder(RAW)


def whole(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def ids_of(encoder, texts):
    batch = pa.RecordBatch.from_pydict({"k": pa.array(range(len(texts))), "t": pa.array(texts, pa.string())})
    return [d[1].tolist() for d in packing._documents(batch, encoder, 1)]


def test_units_encode_like_whole_texts(encoder):
    rng = random.Random(5)
    signs = ["a", "bc", ".", "!\"", " ", "\n", "\t", " ", "　", "é", "漢", "'s", "12", "<|endoftext|>", "\x1c", " ", "  ", "\r\n", "。", "🙂"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(3000)] + [None, ""]
    assert ids_of(encoder, texts) == [whole(encoder, t) for t in texts]


def test_long_texts_in_blocks(encoder, monkeypatch):
    texts = ["\n" * 60_000, " " * 60_000 + "x", "word " * 20_000, "漢" * 30_000, "a.\n b  c " * 9_000]
    expected = [whole(encoder, t) for t in texts]
    monkeypatch.setattr(packing, "BLOCK", 1000)
    assert ids_of(encoder, texts) == expected


def test_hashes_that_collide(encoder, monkeypatch):
    other = packing.UnitEncoder(RAW)
    monkeypatch.setattr(packing, "span_hashes", lambda data, starts, ends, lower: (ends - starts).astype(np.uint64))
    texts = ["one two six ten", "for the cat", "dog"]
    assert ids_of(other, texts) == [whole(encoder, t) for t in texts]


def test_a_full_table_starts_anew(encoder, monkeypatch):
    monkeypatch.setattr(packing, "KEPT_UNITS", 20)
    monkeypatch.setattr(packing, "SLOT_BITS", 4)
    other = packing.UnitEncoder(RAW)
    rng = random.Random(6)
    for _ in range(20):
        texts = [data.text(rng, 12) for _ in range(3)]
        assert ids_of(other, texts) == [whole(encoder, t) for t in texts]


def brute_cost(places, penalties, length, sequence):
    cost = [0]
    free = {packing.SHORTEST << k for k in range(12)}
    for j in range(1, len(places)):
        sizes = ((places[j] - places[i], cost[i]) for i in range(j))
        cost.append(min(c + (0 if s in free else length - s) for s, c in sizes if s <= length) + sequence + penalties[j])
    return cost


def test_cuts_are_the_cheapest(monkeypatch):
    monkeypatch.setattr(packing, "SHORTEST", 4)
    rng = random.Random(7)
    for length in (8, 32, 64):
        for _ in range(60):
            places = np.cumsum([0] + [rng.randrange(1, length // 2) for _ in range(rng.randrange(1, 60))])
            penalties = np.array([0] + [rng.choice([0, 4, 32]) for _ in places[1:]])
            cost, back = packing.least_cost_cuts(places, penalties, length, 3)
            assert cost.tolist() == brute_cost(places.tolist(), penalties.tolist(), length, 3)
            assert all(0 < places[j] - places[back[j]] <= length for j in range(1, len(places)))


def test_places_of_cuts():
    units = np.array([3, 10, 40, 45, 90, 100, 300])
    stops = np.array([False, True, False, False, True, True, True])
    places, penalties = packing.possible_cuts(np.array([0, 100, 300]), units, stops)
    assert places[:4].tolist() == [10, 45, 74, 90] and penalties[:4].tolist() == [4, 32, 32, 4]
    assert places[4:].tolist() == list(range(132, 300, 32)) and set(penalties[4:].tolist()) == {32}
    assert packing.possible_cuts(np.array([0, 0, 0]), units[:0], stops[:0])[0].tolist() == []


def total_cost(packer, documents):
    pieces = [p for d in documents for p in packer.add(*d)] + list(packer.end())
    return pieces, packer.sequences


def test_sending_early_changes_nothing():
    rng = random.Random(8)
    documents = []
    for k in range(300):
        n = rng.choice([1, 5, 40, 300, 700])
        units = np.array(sorted(rng.sample(range(1, n + 1), max(1, n // 3))))
        places, penalties = packing.possible_cuts(np.array([0, n]), units, np.array([rng.random() < 0.1 for _ in units]))
        documents.append((k, np.arange(n, dtype=np.uint32), np.append(places, n), np.append(penalties, 0)))

    def cost(pieces):
        windows = defaultdict(int)
        for _, _, size, _, _, sequence, _ in pieces:
            windows[sequence] += size
        parted = sum(1 for _, first, size, _, n, _, _ in pieces if first + size < n)
        return sum(0 if v in (64, 128) else 128 - v for v in windows.values()) + 16 * len(windows), parted

    (early, _), (late, _) = (total_cost(packing.Packer(length=128, stretch=s), documents) for s in (400, 1 << 40))
    assert [p[:3] + p[4:] for p in early] == [p[:3] + p[4:] for p in late] or cost(early) == cost(late)
    assert sum(p[2] for p in early) == sum(len(d[1]) for d in documents)


def test_every_id_in_one_piece(spark, encoder):
    rows = data.awkward(random.Random(9)) + [(900 + i, data.text(random.Random(i), 3000), "en", "s", 0) for i in range(6)]
    df = data.clashing(data.frame(spark, rows)).withColumns({"ids": F.lit(1), "start": F.lit(2), "offset": F.lit(3)}).repartition(2)
    pieces = packing.pack(df, stretch=4000).collect()
    documents = defaultdict(list)
    for p in pieces:
        documents[p.doc_id].append(p)
        assert len(p.ids) == 4 * p.length and 0 < p.length <= 2048 and p.start + p.length <= p.doc_tokens
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(np.array(whole(encoder, r[1]), "<u4").tobytes())
    for key, own in documents.items():
        if len(texts[key]) == 1:
            own = sorted(own, key=lambda p: p.start)
            assert b"".join(bytes(p.ids) for p in own) == texts[key][0] and sum(p.length for p in own) == own[0].doc_tokens
            assert all(a.start + a.length == b.start for a, b in zip(own[:-1], own[1:], strict=True))
        else:
            assert sorted(b"".join(bytes(p.ids) for p in own)) == sorted(b"".join(texts[key]))
    windows = defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append((p.offset, p.length))
    for parts in windows.values():
        upto = 0
        for offset, size in sorted(parts):
            assert offset == upto
            upto += size
        assert upto <= 2048
    tokens = sum(p.length for p in pieces)
    put = packing.sequences(packing.pack(df, stretch=4000))
    sums = put.agg(F.sum("padding").alias("p"), F.sum("n_tokens").alias("n"), F.sum(F.octet_length("ids")).alias("b")).first()
    assert sums.n == tokens and sums.b == 4 * tokens and sums.p < 0.05 * tokens


def test_little_padding_on_the_tables(spark, sf_dir):
    pieces = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sums = packing.sequences(pieces).agg(F.sum("padding").alias("p"), F.sum("n_tokens").alias("n")).first()
    assert sums.p < 0.01 * sums.n
    query = packing.op12_packing(spark, sf_dir).orderBy("sequence_id", "offset").first()
    piece = pieces.orderBy("sequence_id", "offset").first()
    assert query.ids_crc32 == zlib.crc32(bytes(piece.ids))


def test_empty_table(spark):
    assert packing.pack(data.empty(spark)).count() == 0
    assert packing.sequences(packing.pack(data.empty(spark))).count() == 0
