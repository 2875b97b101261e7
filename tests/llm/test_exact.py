import hashlib
import re
from collections import defaultdict

from plumbline.llm.exact import CUT, exact_dedup, exact_groups


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for norm, own in groups.items():
        best = max(own, key=lambda x: (len(x[1]), x[0] is not None, -(x[0] or 0)))[0]
        digest = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, best, len(own), i == best, digest) for i, _ in own]
    return sorted(out, key=str)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_messy_rows(messy):
    got = sorted(map(tuple, exact_groups(messy).collect()), key=str)
    assert got == expected(rows_of(messy))


def test_colliding_hashes_are_told_apart(small, messy):
    for docs in (small, messy):
        got = sorted(map(tuple, exact_groups(docs, hash_bits=5).collect()), key=str)
        assert got == expected(rows_of(docs))


def test_empty_table(nothing):
    assert exact_groups(nothing).collect() == []
    assert exact_dedup(nothing).columns == nothing.columns


def test_kept_documents(small):
    kept = exact_dedup(small)
    want = {i for i, best, *_ in expected(rows_of(small)) if i == best}
    assert {r["doc_id"] for r in kept.collect()} == want
    assert kept.columns == small.columns


def test_one_row_of_every_group_stays(spark, messy):
    """Null ids, repeated ids and repeated rows: as many rows as groups, each the preferred one."""
    more = [(None, "alone"), (None, "pair"), (None, "pair"), (30, "one id"), (30, "two texts"), (31, "two  texts"),
            (32, "same"), (32, "same"), (33, "a b"), (33, "ab "), (34, "null beats no id"), (None, "null beats noid")]
    extra = spark.createDataFrame(more, "doc_id long, text string")
    docs = messy.unionByName(extra, allowMissingColumns=True)
    groups = defaultdict(list)
    for i, t in rows_of(docs):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t))

    def place(row):
        i, t = row
        own = hashlib.sha256(t.encode()).hexdigest() if t is not None else ""
        return (len(t or ""), i is not None, -(i or 0), own)

    want = sorted((max(own, key=place) for own in groups.values()), key=str)
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(rows_of(kept), key=str) == want
    assert (None, "alone") in want and (None, "pair") in want and (32, "same") in want


def test_chunks_cover_the_text_and_follow_its_content():
    text = "".join(f"Sentence number {i} ends in {chr(97 + i * 7 % 26)}." for i in range(400))
    cut = re.compile(CUT)
    parts = cut.findall(text)
    assert "".join(parts) == text
    shifted = cut.findall("Something new in front of it all." + text)
    assert len(set(parts) & set(shifted)) > len(parts) / 2


def test_native_plan(small):
    plan = exact_groups(small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_smallest_and_largest_ids(spark):
    least, most = -(2**63), 2**63 - 1
    rows = [(least, "a b"), (most, "ab"), (0, "a b"), (None, "a b"), (most, "c"), (least, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, exact_groups(docs).collect()), key=str)
    assert got == expected(rows)
    assert sorted(r.doc_id for r in exact_dedup(docs).collect()) == [least, least, most]
