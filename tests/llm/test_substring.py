import hashlib

from plumbline.llm.substring import repeats, without_repeats


def expected(rows, width=13):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - width + 1) if i is not None else ():
            g = tuple(w[k : k + width])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - width + 1) if i is not None else ():
            if first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df, **kw):
    out = repeats(df, **kw).select("doc_id", "n_words", "n_removed", "kept_sha256")
    return sorted(map(tuple, out.collect()), key=str)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_given_documents(small):
    assert got(small) == expected(rows_of(small))


def test_messy_rows(messy):
    assert got(messy) == expected(rows_of(messy))


def test_runs_and_passages_without_pairs(spark):
    # runs of one word hold no pair symbol; passages are cut at every offset
    body = " ".join(f"b{i}" for i in range(40))
    rows = [(i, " ".join(["a"] * (11 + i)) + f" x{i} " + body) for i in range(6)]
    rows += [(10 + k, " ".join(f"b{i}" for i in range(k, k + 14))) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == expected(rows)
    assert got(df, width=9) == expected(rows, 9)


def test_texts_that_are_left(small, nothing):
    left = {r["doc_id"]: r for r in without_repeats(small).collect()}
    for i, n, removed, digest in expected(rows_of(small)):
        words = left[i]["text"].encode().split()
        assert len(words) == n - removed
        assert hashlib.sha256(b" ".join(words)).hexdigest() == digest
    same = {r["doc_id"]: r["text"] for r in small.collect()}
    assert all(left[i]["text"] == same[i] for i, _, removed, _ in expected(rows_of(small)) if not removed)
    assert without_repeats(nothing).collect() == [] and repeats(nothing).collect() == []
    assert without_repeats(small).schema == small.schema
