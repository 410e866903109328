import random
import re
import tempfile

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="session")
def documents():
    """(doc_id, text) of the smallest table, with nulls, ties, repeated rows, long texts and pasted passages."""
    rnd = random.Random(7)
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    long = [t for _, t in rows if len(t) > 800]
    for k in range(60):
        a, b = rnd.choice(long), rnd.choice(long)
        at = rnd.randint(0, len(a) - 500)
        rows.append((10_000 + k, b[:rnd.randint(0, 200)] + " " + a[at:at + rnd.randint(150, 500)] + "\n" + rnd.choice(long)[3:rnd.randint(5, 300)]))
    for k in range(20):  # near copies
        words = rnd.choice(long).split(" ")
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = "zz"
        rows.append((20_000 + k, " ".join(words)))
    rows += [(1, "ab cd " * 300)] * 2 + [(30_000, None), (30_001, ""), (30_002, " \n\t "), (30_003, "a"), (30_004, "A b"), (None, rows[3][1]), (None, None),
                                         (30_005, "x" * 3000), (30_006, "q " * 4000)]
    return rows


@pytest.fixture
def table(spark):
    """Writes rows as a Parquet table of several files and reads it."""

    def make(rows, schema, files=4):
        path = tempfile.mkdtemp(prefix="run-") + "/t"
        spark.createDataFrame(rows, schema).repartition(files).write.parquet(path)
        return spark.read.parquet(path)

    return make
