import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import bestfit, packing, registry
from plumbline.llm.tokens import Encoder, encoder


def by_hand(sizes, window):
    """One window after another: largest first, then pairs for the smallest, on plain lists."""
    left = sorted(sizes, reverse=True)
    out = []
    while left:
        mine, room = [], window
        for size in list(left):
            if size <= room:
                mine.append(size)
                left.remove(size)
                room -= size
        while room:
            small = min(mine)
            pairs = [
                (a + b, abs(a - b), a, b) for i, a in enumerate(left) for b in left[i + 1 :]
                if small < a + b <= room + small
            ]
            if not pairs:
                break
            total, _, a, b = max(pairs)
            mine.remove(small)
            left.remove(a)
            left.remove(b)
            mine += [a, b]
            left = sorted([*left, small], reverse=True)
            room += small - total
        out.append(sorted(mine))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_patterns_are_the_windows_of_the_plain_method(seed):
    r = random.Random(seed)
    window = r.choice([10, 30, 100])
    sizes = [r.randint(1, window if seed % 2 else max(2, window // 2)) for _ in range(r.randint(1, 90))]
    want = Counter(map(tuple, by_hand(sizes, window)))
    got = Counter()
    for used, repeats in bestfit.patterns(Counter(sizes), window):
        got[tuple(sorted(s for s, n in used.items() for _ in range(n)))] += repeats
    assert got == want


def test_a_pair_takes_the_place_of_the_smallest():
    assert list(bestfit.patterns({7: 1, 2: 1, 1: 0}, 10)) == [({7: 1, 2: 1}, 1)]
    used, room = bestfit._window({60: 1, 30: 1, 20: 2}, [20, 30, 60], 100)
    assert used == {60: 1, 20: 2} and room == 0  # 60 + 30 leaves 10; 20 + 20 for the 30 leaves none


def test_layout_places_every_piece_once():
    counts = {1: 1000, 3: 70, 50: 20, 99: 7, 100: 5, 40: 33}
    layout = bestfit.Layout(counts, 100)
    filled = {}
    for size, n in counts.items():
        number, offset = layout.place(np.full(n, size), np.arange(n))
        for w, o in zip(number.tolist(), offset.tolist()):
            filled.setdefault(w, []).append((o, size))
    assert sorted(filled) == list(range(layout.windows))
    for parts in filled.values():
        at = 0
        for o, size in sorted(parts):
            assert o == at
            at += size
        assert at <= 100
    assert layout.windows == -(-sum(s * n for s, n in counts.items()) // 100)


def test_patterns_do_not_grow_with_the_counts():
    r = random.Random(4)
    counts = {s: r.randint(0, 50) for s in range(1, 2049)}
    few = len(list(bestfit.patterns(counts)))
    many = len(list(bestfit.patterns({s: n * 10**9 + r.randint(0, 10**6) for s, n in counts.items()})))
    assert few < 6200 and many < 6200


def check(rows, docs, window=bestfit.WINDOW):
    model = Encoder(registry.tokenizer(registry.BYTE_BPE)).model
    want = []
    for doc, text in docs:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, bestfit.END], "<u4")
        start, upto, piece = 0, len(ids) % window or window, 0
        while start < len(ids):
            want.append((doc, piece, start, upto - start, zlib.crc32(ids[start:upto].tobytes())))
            start, upto, piece = upto, upto + window, piece + 1
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert Counter(got) == Counter(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    sizes = [length for *_, length, _ in want]
    assert len(bins) == sum(n for _, n in bestfit.patterns(Counter(sizes), window))
    return len(bins), -(-sum(sizes) // window)


def test_query(spark, folder, small):
    rows = registry.op12_best_fit_packing(spark, folder).collect()
    used, least = check(rows, [(r.doc_id, r.text) for r in small.collect()])
    assert used <= least + 2


def test_messy_table(messy, nothing):
    path = registry.tokenizer(registry.BYTE_BPE)
    check(bestfit.best_two_fit(messy, path).collect(), [(r.doc_id, r.text) for r in messy.collect()])
    check(bestfit.best_two_fit(messy, path, window=64).collect(), [(r.doc_id, r.text) for r in messy.collect()], 64)
    assert bestfit.best_two_fit(nothing, path).count() == 0


def test_sequences_do_not_depend_on_the_tasks(small):
    path = registry.tokenizer(registry.BYTE_BPE)
    counts = set()
    for parts in (1, 7):
        rows = bestfit.best_two_fit(small.repartition(parts), path).collect()
        counts.add(len({r.sequence_id for r in rows}))
    assert len(counts) == 1


def test_encoder_forgets_without_harm(small):
    texts = [r.text or "" for r in small.limit(60).collect()]
    path = registry.tokenizer(registry.BYTE_BPE)
    tiny = Encoder(path, memory=50_000)
    got = [code for t in texts for code in tiny.encode([t])]
    plain = Encoder(path).model
    assert got == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@given(st.lists(st.text(st.one_of(st.sampled_from("ab'st re1.,\n\t\x0b\x1c-<|>"), st.characters(codec="utf-8")))))
@settings(max_examples=300, deadline=None)
def test_encoder_gives_the_tokenizers_ids(texts):
    path = registry.tokenizer(registry.BYTE_BPE)
    own = encoder(path)
    texts = [*texts, "it's we're  <|endoftext|>x, 'tis\n\n end ", " a  b\r\n'll"]
    want = [np.array(own.model.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert own.encode(texts) == want


@pytest.mark.parametrize("kind", [Encoder, packing.Encoder])
def test_new_words_are_encoded_together(kind):
    path = registry.tokenizer(registry.BYTE_BPE)
    own = kind(path)
    plain, asked = own.model, []

    class Counting:
        def encode_batch_fast(self, texts, **settings):
            asked.extend(texts)
            return plain.encode_batch_fast(texts, **settings)

        encode_batch = encode_batch_fast

    for part in (own, getattr(own, "heads", own), getattr(own, "tails", own)):
        part.model = Counting()
    text = "first " + " ".join(f"wörd{i * 7919}," for i in range(6_000))
    texts = [text, text + " ", "  " + text, "a\n b\nc", "", " ", "<|endoftext|> x<|endoftext|>y"]
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert own.encode(texts) == want and own.encode([]) == []
    assert len(asked) < 30


def test_pieces_with_line_breaks_are_encoded_together():
    code, alone = Encoder(registry.tokenizer(registry.BYTE_BPE)), []
    each = code._each
    code._each = lambda pieces: alone.extend(pieces) or each(pieces)
    texts = [f"head {i} word{i}\nnext{i}\t{i}\n\n end{i}\r\n {i}　x\x1c" for i in range(300)]
    got = code.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [code.model.encode(t).ids for t in texts]
    assert alone == []
