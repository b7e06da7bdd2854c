import re
import zlib

import pytest

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def remainder(doc_id, of):
    return zlib.crc32(str(doc_id).encode()) % of


def prose(seed, n, letters="abcdefghij"):
    """n made-up words."""
    import random
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(n))


#: Texts every operator must take: null, empty, blank, one word, no letter, repeated, very long, other scripts, a lone mark.
ODD_TEXTS = [None, "", " \t\n", "word", "12 34 !!", "word", "é漢字😀 ñ", "a" * 5000, prose(1, 3000), prose(1, 3000), "▁ ▁▁", "\x00 x"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, with a null id, a repeated row, null columns and clashing extra columns."""
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "null id", "en", "s1", 7), (None, None, None, None, None), rows[8]]
    from pyspark.sql import functions as F
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "score", "hash", "count", "n", "row", "label", "size", "component_id", "id", "a", "b", "band", "anchor"):
        frame = frame.withColumn(name, F.lit(1))
    return frame


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(12)] + [(None, None, None)], "doc_id long, quality int, toxic int")
