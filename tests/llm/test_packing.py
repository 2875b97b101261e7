import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import packing
from plumbline.llm.registry import BYTE_BPE, tokenizer

PATH = tokenizer(BYTE_BPE)


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def check(pieces, docs, plain):
    """Every id of every document lies in one piece, and sequences have no gaps or padding."""
    want = {}
    for i, t in docs:
        want.setdefault(i, []).append([*plain.encode(t or "", add_special_tokens=False).ids, 1])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    assert by_doc.keys() == want.keys()
    for i, own in by_doc.items():
        if len(want[i]) > 1:  # rows that repeat an id
            assert sum(p["length"] for p in own) == sum(map(len, want[i]))
            continue
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            ids = want[i][0][at : at + p["length"]]
            assert p["start"] == at and p["doc_tokens"] == len(want[i][0])
            assert p["ids_crc32"] == zlib.crc32(np.asarray(ids, "<u4").tobytes())
            at += p["length"]
        assert at == len(want[i][0])
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= packing.WINDOW and at & (at - 1) == 0
        assert {p["sequence_length"] for p in own} == {at} and len({p["step_group"] for p in own}) == 1


def test_given_documents(small, plain):
    docs = [(r["doc_id"], r["text"]) for r in small.collect()]
    check(packing.packed(small, PATH).collect(), docs, plain)


def test_messy_rows(messy, nothing, plain):
    docs = [(r["doc_id"], r["text"]) for r in messy.select("doc_id", "text").collect()]
    check(packing.packed(messy, PATH).collect(), docs, plain)
    assert packing.packed(nothing, PATH).collect() == []


def test_pieces_give_the_ids_of_the_whole(plain):
    r = random.Random(5)
    parts = ["a", "b's", " ", "  ", "\n", "\t", " \n ", ".", "é", "日本", "<|endoftext|>", "12", "'", "’s", " ", " x", "\x0b", "\x0c", "\x1c"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(3000)]
    got = packing.Encoder(PATH).encode(texts)
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_memory_of_pieces_is_emptied(monkeypatch, plain):
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 5)
    e = packing.Encoder(PATH)
    for k in range(4):
        t = " ".join(f"t{k}{i}" for i in range(8))
        assert np.frombuffer(e.encode([t])[0], "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_pack(seed):
    r = random.Random(seed)
    lengths = [r.choice([1, r.randrange(1, 300), r.randrange(1, 9000)]) for _ in range(r.randrange(0, 200))]
    windows = packing.pack(lengths)
    seen = defaultdict(list)
    for size, pieces in windows:
        assert size & (size - 1) == 0 and size <= packing.WINDOW
        assert sum(n for _, _, n in pieces) == size
        for item, start, n in pieces:
            seen[item].append((start, n))
    for item, n in enumerate(lengths):
        at = 0
        for start, size in sorted(seen[item]):
            assert start == at
            at += size
        assert at == n
    small = [s for s, _ in windows if s < min(packing.TIERS)]
    assert len(small) <= 8


def test_blocks(small, plain, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 5000)
    ids, tokens = [1, 2], [b"\1\0\0\0" * 3000, b"\1\0\0\0"]
    batch, number = packing._block(ids, tokens, 7)
    assert number > 7 and sum(batch["length"].to_pylist()) == 3001


def test_step_groups_over_blocks_and_tasks(spark, monkeypatch):
    # two blocks in one task: groups go on in the second one
    tokens = [b"\1\0\0\0" * 2048] * 40
    filled = {}
    one, number = packing._block(list(range(40)), tokens, 5 << packing.TASK_BITS, filled)
    two, _ = packing._block(list(range(40, 80)), tokens, number, filled)
    other, _ = packing._block(list(range(80)), tokens * 2, 6 << packing.TASK_BITS, {})
    sizes = defaultdict(int)
    for batch in (one, two, other):
        for p in batch.to_pylist():
            sizes[p["step_group"]] += p["length"]
    # 80 windows a task: two full groups and the rest
    assert sorted(sizes.values()) == sorted([packing.STEP_TOKENS] * 4 + [80 * 2048 - 2 * packing.STEP_TOKENS] * 2)


def test_groups_of_many_tasks(spark):
    text = "some words that repeat " * 4000
    df = spark.range(96).selectExpr("id doc_id").withColumn("text", F.lit(text)).repartition(4, "doc_id")
    rows = packing.packed(df, PATH).collect()
    sizes, lengths = defaultdict(int), defaultdict(set)
    for p in rows:
        sizes[p["step_group"]] += p["length"]
        lengths[p["step_group"]].add((p["sequence_length"], p["sequence_id"] >> packing.TASK_BITS))
    assert max(sizes.values()) == packing.STEP_TOKENS
    assert all(len(x) == 1 for x in lengths.values())
    short = [x for g, n in sizes.items() if n < packing.STEP_TOKENS for x in lengths[g]]
    assert len(short) == len(set(short))  # one unfilled group a task and length
