import random

import pytest
import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, row string, spans long, kept string, size long, copies int"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'x' * rng.randrange(3)}" for _ in range(n))


def place(row):
    """Sort key of (doc_id, text, ...): nulls first, then by the hash of the text, then the text."""
    hashed = 42 if row[1] is None else xxhash.xxh64_intdigest(row[1].encode(), 42)
    return row[0] is not None, row[0] or 0, hashed - (1 << 64) if hashed >> 63 else hashed, (row[1] or "").encode()


@pytest.fixture(scope="session")
def rows():
    """Nulls in any column, empty, blank and long texts, repeated rows and ids, copies, shared passages, other scripts."""
    rng = random.Random(5)
    base = [words(rng, rng.randrange(1, 400)) for _ in range(30)]
    passage = words(rng, 80)
    out = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(base)]
    out += [(100, None, None, None, None), (101, "", "en", "s1", 0), (102, " \n\t ", "de", "s2", 3), (103, base[3], "en", None, 1), (103, base[3], "en", None, 1)]
    out += [(104, base[4] + " " + passage, "en", "s0", 1), (105, passage + "\n" + base[5], "en", "s0", 1), (106, words(rng, 20_000), "en", "s3", 1), (107, "Ärger ünd öde " * 40, "de", "s1", 1), (108, "文字" * 200, None, "s1", 1)]
    out += [(None, base[6], "en", "s0", 1), (109, base[7].upper(), "en", "s1", 1), (109, words(rng, 50), "fr", "s1", 1), (110, base[8] + " tail", "en", "s2", 1), (111, "<|endoftext|> a  b \r\n c", "en", "s2", 1)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(*r, "a", "b", 7, "c", 8, 9) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
