import zlib

from plumbline.llm import langid
from plumbline.llm.langid import Classifier, fit, language_filter, languages


def test_held_out_accuracy(spark, folder):
    docs = spark.read.parquet(folder.replace("sf0.001", "sf0.01") + "/documents.parquet")
    out = languages(docs).withColumn("held", langid.held_out())
    rows = out.join(docs.select("doc_id", "lang"), "doc_id").where("held").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_learns_from_the_right_rows(spark):
    rows = [(i, f"text number {i} " * 3, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else "en") for i in range(60)]
    rows += [(100, None, "zz"), (101, "no label here", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(fit(df)) == {"en"}
    assert len(fit(df, rows=3, snippet=10)["en"]) <= 3 * 11


def test_messy_rows(messy, nothing):
    got = languages(messy, {"en": b"the quick brown fox jumps", "de": b"der schnelle braune fuchs"})
    rows = got.collect()
    assert len(rows) == messy.count()
    bare = {1, 2, 3, 11}
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in rows if r["doc_id"] in bare)
    assert all(r["lang_pred"] != "und" for r in rows if r["doc_id"] not in bare | {None})
    assert languages(nothing).collect() == []
    assert {r["lang_pred"] for r in languages(messy.limit(5), {}).collect()} <= {"und"}


def test_narrow_margins_are_rejected():
    same = Classifier({"a": b"some words of a text", "b": b"some words of a text"})
    name, score, margin, rejected = same.classify("other words of a text")
    assert (name, score, margin, rejected) == ("a", 0.5, 0.0, True)


def test_filter_keeps_rows_as_they_are(small, nothing):
    kept = language_filter(small)
    assert kept.schema == small.schema
    assert kept.count() >= 0.95 * small.count()
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in small.collect()}
    assert language_filter(nothing).collect() == []


def test_against_plain_loops(spark):
    words = {"aa": "the house and the garden of a friend", "bb": "das haus und der garten vom freund"}
    rows = [(i, f"{words[k]} {i} " * (i % 4 + 1), k) for i, k in enumerate(list(words) * 40)]
    rows += [(200, None, "aa"), (201, "7 8 9", "bb"), (202, words["aa"] * 400, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    import zstandard as z

    # the bound is not reached, so every labelled text is learned from, in the order of its hash
    learned = [r for r in rows if r[1] and r[2] and zlib.crc32(str(r[0]).encode()) % 5]
    order = {r["doc_id"]: r["h"] for r in df.selectExpr("doc_id", "xxhash64(doc_id) h").collect()}
    packers = {}
    for k in sorted(words):
        own = sorted((r for r in learned if r[2] == k), key=lambda r: (order[r[0]], r[0]))
        content = "\n".join(r[1] for r in own).lower().encode()
        d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        packers[k] = z.ZstdCompressor(
            level=langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False
        )
    got = {r["doc_id"]: r for r in languages(df, fit(df, snippet=1000)).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        if not text or not any(c.isalpha() for c in text):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        data = text.lower().encode()
        sizes = {
            k: sum(len(p.compress(data[a : a + langid.BLOCK])) for a in range(0, len(data), langid.BLOCK))
            for k, p in packers.items()
        }
        best = min(sizes, key=lambda k: (sizes[k], k))
        assert got[i]["lang_pred"] == best
        margin = min(1.0, (max(sizes.values()) - sizes[best]) / sizes[best])
        assert abs(got[i]["margin"] - margin) < 1e-12
        assert got[i]["rejected"] == (margin < langid.MARGIN)
