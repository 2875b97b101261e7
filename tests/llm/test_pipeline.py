import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from plumbline.llm import langid
from tests.llm import test_exact, test_minhash, test_packing, test_substring


def brute(docs, dictionaries):
    """(doc_id, text) after each of the first four stages."""
    judge = langid.Classifier(dictionaries)
    rows = [(i, t) for i, t in docs if not judge.classify(t)[3]]
    yield rows
    kept = {i for i, best, *_ in test_exact.expected(rows) if i == best}
    rows = [(i, t) for i, t in rows if i in kept]
    yield rows
    root = test_minhash.expected(rows)
    rows = [(i, t) for i, t in rows if root.get(i, i) == i]
    yield rows
    cut = {i: removed for i, _, removed, _ in test_substring.expected(rows)}
    texts = {}
    for i, t in rows:
        words = t.encode().split()
        grams = [tuple(words[k : k + 13]) for k in range(len(words) - 12)]
        texts[i] = (words, grams)
    first = {}
    for i, (_, grams) in texts.items():
        for g in grams:
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        words, grams = texts[i]
        gone = {k + j for k, g in enumerate(grams) if first[g] < i for j in range(13)}
        assert len(gone) == cut[i]
        out.append((i, b" ".join(w for k, w in enumerate(words) if k not in gone).decode() if gone else t))
    yield out


def test_every_stage_against_brute_force(spark, small, folder, tmp_path):
    from tokenizers import Tokenizer

    docs, plain = small, Tokenizer.from_file(test_packing.PATH)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    wanted = brute(rows, langid.fit(docs))
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], wanted, strict=True):
        out = stage(spark, docs, folder)
        assert out.columns == small.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got = sorted((r["doc_id"], r["text"]) for r in docs.collect())
        assert got == sorted(want), name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    test_packing.check(pieces, want, plain)
    whole = corpus_pipeline.run(spark, folder).collect()
    key = lambda p: (p["doc_id"], p["start"], p["length"], p["ids_crc32"])
    tokens = {(p["doc_id"], p["doc_tokens"]) for p in whole}
    assert tokens == {(p["doc_id"], p["doc_tokens"]) for p in pieces}
    assert sum(p["length"] for p in whole) == sum(p["length"] for p in pieces)
    assert len({key(p) for p in whole}) == len(whole)


def test_messy_and_empty_tables(spark, messy, nothing, folder):
    for docs in (messy, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns, name
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()


def test_registered_queries():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in names if k.startswith("op")}
    assert names["pipeline"] is corpus_pipeline.run
    assert {k for k in entry.oracle_sql() if k.startswith("op")} == {
        "op1_exact_dedup", "op2_minhash_near_dedup", "op3_nearest_neighbours", "op8_substring_dedup"
    }
    assert np.all([4 <= len(corpus_pipeline.STAGES) <= 5])
