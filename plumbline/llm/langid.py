"""Language by compression: the dictionary that shortens a text most names its language.

For each language a raw-content dictionary is cut from a bounded sample of labelled texts.  A text
is compressed in blocks of ``BLOCK`` bytes, all of it, with every dictionary; the smallest sum
wins.  Blocks keep a long text from becoming its own dictionary, so its margin stays in proportion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAMPLE_ROWS = 300  # labelled rows a language
SNIPPET = 200  # characters taken of each
LANGUAGES = 500  # more labels than this are an error, not a language list
BLOCK = 4096  # bytes
LEVEL = 5
SHARPNESS = 24.0
MARGIN = 0.001  # relative saving below which a prediction is rejected
UNKNOWN = "und"
FOLDS, HELD_OUT = 5, 0
PREDICTION = "lang_pred string, score double, margin double, rejected boolean"
NAMES = [x.split()[0] for x in PREDICTION.split(", ")]


def held_out(doc_id="doc_id", folds: int = FOLDS, fold: int = HELD_OUT):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, snippet: int = SNIPPET) -> dict[str, bytes]:
    """One dictionary a language from at most ``rows`` labelled texts of it, chosen by hash.

    At most ``rows * snippet`` characters a language reach the driver.  Rows with null text or
    lang, and held-out rows, are not learned from.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    width = F.length("text")
    # a piece from a place that depends on the row, so that openings are not preferred
    place = 1 + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(width - snippet, F.lit(1)))
    cut = F.substring("text", place.cast("int"), F.lit(snippet))
    # cut before the ranking, so that a language's rows are short wherever they are sorted
    pieces = known.select("lang", "doc_id", cut.alias("piece"))
    chosen = pieces.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows)
    found: dict[str, list[tuple[int, str]]] = {}
    for r in chosen.collect():
        found.setdefault(r["lang"], []).append((r["rank"], r["piece"]))
    if len(found) > LANGUAGES:
        raise ValueError(f"{len(found)} language labels; at most {LANGUAGES} are expected")
    # the closest bytes are the cheapest to refer to; the order is by hash, so neutral
    return {k: "\n".join(p for _, p in sorted(v)).lower().encode() for k, v in sorted(found.items())}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        self.names = list(dictionaries)
        self.packers = []
        for content in dictionaries.values():
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.packers.append(
                z.ZstdCompressor(
                    level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False,
                    write_dict_id=False,
                )
            )

    def classify(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, relative saving over the second best, whether it is rejected."""
        if not self.names or not isinstance(text, str) or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0, True
        data = text.lower().encode("utf-8", "replace")
        sizes = np.zeros(len(self.names))
        for at in range(0, len(data), BLOCK):
            block = data[at : at + BLOCK]
            sizes += [len(p.compress(block)) for p in self.packers]
        best = int(sizes.argmin())
        # bits a byte, relative to the best language
        odds = np.exp(-SHARPNESS * (sizes - sizes[best]) / sizes[best])
        second = np.delete(sizes, best).min() if len(sizes) > 1 else np.inf
        margin = float(min(1.0, (second - sizes[best]) / sizes[best]))
        return self.names[best], float(1 / odds.sum()), margin, margin < MARGIN


def judge(spark, dictionaries: dict[str, bytes]):
    """Column function from a text to its prediction."""
    # at most LANGUAGES * SAMPLE_ROWS * SNIPPET characters
    shared = spark.sparkContext.broadcast(dictionaries)

    @F.pandas_udf(PREDICTION)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Classifier(shared.value)
        for texts in batches:
            yield pd.DataFrame([model.classify(t) for t in texts], columns=NAMES)

    return predict


def languages(docs: DataFrame, dictionaries: dict[str, bytes] | None = None) -> DataFrame:
    """Prediction for every row: doc_id, lang_pred, score, margin, rejected.

    Only the text decides, case apart.  Null texts and those without a letter are ``und``, score 0,
    rejected; so is every text if nothing was learned.  Equal sizes go to the first language by
    name, with margin 0, so rejected.  Repeated rows are judged alike; other columns are ignored;
    an empty table gives no rows.
    """
    predict = judge(docs.sparkSession, fit(docs) if dictionaries is None else dictionaries)
    return docs.select("doc_id", predict("text").alias("p")).select("doc_id", "p.*")


def language_filter(docs: DataFrame) -> DataFrame:
    """Rows whose language is told with enough margin, as they are."""
    predict = judge(docs.sparkSession, fit(docs))
    return docs.where(~predict("text")["rejected"])
