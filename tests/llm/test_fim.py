import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F
from tests.llm import data

from voxstrata.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(key, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def table():
    rng = random.Random(11)
    rows = data.awkward(rng)
    signs = ["a", "é", "漢", " ", "\n", "\t", " ", "🙂", "<", "P>", "<S"]
    rows += [(1000 + i, "".join(rng.choice(signs) for _ in range(rng.randrange(60))), "en", "s", 0) for i in range(300)]
    return rows + [(2000 + i, f"one {mark} two three", "en", "s", 0) for i, mark in enumerate(["<P>", "<S>", "<M>", "<P", "S>"] * 4)]


def test_against_lists(spark):
    rows = table()
    made = fim.fill_in_middle(data.clashing(data.frame(spark, rows)).withColumns({"form": F.lit(1), "output": F.lit(2)}))
    got = made.withColumn("text", fim.restored(F.col("output"), F.col("form"))).collect()
    expected = [(r[0], *brute(r[0], r[1]), r[1] or "") for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fim.fill_in_middle(data.empty(spark)).count() == 0


def test_checkpoints_and_blocks_give_every_cut():
    rng = random.Random(3)
    for every, block in ((1, 1), (2, 3), (3, 7), (5, 64), (256, 1 << 20)):
        text = "".join(rng.choice([" ", "\n", "é", "漢x", "word", "  "]) for _ in range(150))
        raw = np.frombuffer(text.encode(), np.uint8)
        index, units = fim.Checkpoints(raw, every, block), UNIT.findall(text)
        assert index.n == len(units) and len(index.units) == len(units) // every + 1
        for k in range(len(units) + 1):
            before = "".join(units[:k])
            assert index.cut(k) == (len(before.encode()), len(before))


def test_very_long_texts():
    for text in (" " * 3_000_000, "é" * 1_500_000, "ab \n" * 1_000_000):
        raw = np.frombuffer(text.encode(), np.uint8)
        for key in range(8):
            n, form, *chars, out = fim.transform(raw, key)
            assert (n, form, *chars, out.decode()) == brute(key, text)


def test_batches_of_outputs(spark, monkeypatch):
    monkeypatch.setattr(fim, "SEND_BYTES", 50)
    rows = table()
    got = fim.fill_in_middle(data.frame(spark, rows)).select("doc_id", "output").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((r[0], brute(r[0], r[1])[-1]) for r in rows), key=str)
