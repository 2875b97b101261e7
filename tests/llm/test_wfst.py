import random

import numpy as np
import pytest
import sentencepiece

from plumbline.llm import wfst
from plumbline.llm.registry import PIECE_BPE, tokenizer

PATH = tokenizer(PIECE_BPE)
ODD = ["", " ", "a", " a", "a  b", "   ", "a\n b\t\tc ", "日本語テキスト 🙂 x", "aaaa aaaaaa", "▁x▁▁y", "\x00\x01",
       " \n ", " the   the", "hello   world  ", "1234567 89", "<s> </s> <0x0A>", "...... ----", "don't", "é"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_same_ids_and_texts_as_the_library(small, library):
    texts = [r["text"] for r in small.collect()] + ODD
    r = random.Random(2)
    letters = "aeinst hlorTHE.,'-\n▁é日"
    texts += ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(2000)]
    t = wfst.transducer(PATH)
    for text in texts:
        ids = np.frombuffer(t.encode(text), "<i4").tolist()
        assert ids == library.encode(text), repr(text)
        assert t.decode(ids) == library.decode(ids)


def test_messy_rows(messy, nothing, library):
    rows = {(r["doc_id"], r["text"]) for r in messy.select("doc_id", "text").collect()}
    out = wfst.encoded(messy, PATH)
    got = {(r["doc_id"], tuple(r["ids"]), r["n_tokens"]) for r in out.collect()}
    want = set()
    for i, t in rows:
        ids = tuple(library.encode(t or ""))
        want.add((i, ids, len(ids)))
    assert got == want
    assert all(r["round_trip"] for r in out.collect())
    assert wfst.encoded(nothing, PATH).collect() == []


def test_decoding_is_the_inverse(small):
    back = wfst.decoded(wfst.encoded(small, PATH), PATH).select("doc_id", "text")
    assert sorted(map(tuple, back.collect())) == sorted((r["doc_id"], r["text"]) for r in small.collect())
    assert wfst.decoded(back.selectExpr("cast(null as array<int>) ids"), PATH).first()["text"] is None


def test_unigram_path_is_the_cheapest():
    def field(n, kind, value):
        return bytes([n << 3 | kind]) + value

    def text(n, data):
        return field(n, 2, bytes([len(data)]) + data)

    pieces = [("<unk>", 0.0, 2), ("▁a", -2.0, 1), ("b", -1.5, 1), ("▁ab", -3.6, 1), ("▁", -1.0, 1), ("a", -0.8, 1)]
    data = b"".join(
        text(1, text(1, p.encode()) + field(2, 5, np.float32(s).tobytes()) + field(3, 0, bytes([k])))
        for p, s, k in pieces
    )
    t = wfst.Transducer(wfst.Model(data))
    # ▁ a b costs 3.3, ▁a b 3.5, ▁ab 3.6
    assert t.shortest("▁ab") == ["▁", "a", "b"]
    assert np.frombuffer(t.encode("ab zz"), "<i4").tolist() == [4, 5, 2, 4, 0]


def test_arcs_of_a_merge_model_are_sought_in_depth(library):
    """Few arcs are weighed for each piece of a long word, and blocked paths are left again."""
    r = random.Random(3)
    words = ["▁" + "".join(r.choice("aeinsthlor") for _ in range(r.randrange(1, 60))) for _ in range(400)]
    t = wfst.Transducer(wfst.transducer(PATH).model)
    asked, weight = [], t.weight
    t.weight = lambda last, piece: asked.append(piece) or weight(last, piece)
    found = [t.shortest(w) for w in words]
    assert ["".join(p) for p in found] == words
    assert [[t.id_of[x] for x in p] for p in found] == [library.encode(w[1:]) for w in words]
    assert len(asked) <= 2 * sum(map(len, found))
