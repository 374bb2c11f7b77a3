"""Corpus operators against their SQL, on the small tables and on made-up texts."""

import random

import duckdb
import pytest

from driftline.llm import decontaminate, oracles, pii, queries, simhash, substrings

DATA = "/root/testdata/sf0.001"


def duck(**tables):
    c = duckdb.connect()
    for name, rows in tables.items():
        c.register(name, rows.toArrow())
    return c


def same(df, c, name):
    want = c.execute(oracles.ORACLES[name])
    order = [df.columns.index(x[0]) for x in want.description]
    assert sorted(df.columns) == sorted(x[0] for x in want.description)
    assert sorted((tuple(r[k] for k in order) for r in df.collect()), key=str) == sorted(want.fetchall(), key=str)


def made(spark, texts):
    return spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")


@pytest.mark.parametrize("name", ["op2_simhash", "op3_suffix_dedup", "op5_decontaminate", "op6_pii"])
def test_table(spark, name):
    c = duck(documents=spark.read.parquet(f"{DATA}/documents.parquet"), benchmark=spark.read.parquet(f"{DATA}/benchmark.parquet"))
    same(getattr(queries, name)(spark, DATA), c, name)


def test_fingerprints(spark):
    r = random.Random(5)
    base = [r.choice(["A", "é", "\U0001f600", "word", "x" * 30, "y" * 90]) + str(k) for k in range(120)]
    texts = [None, "", " \n", "One", "one two"]
    for k in range(60):
        texts.append("\t".join(w if r.random() > 0.004 * (k % 3) else "other" for w in base[: 40 + k % 4]))
    docs = made(spark, texts)
    same(simhash.near_duplicates(docs), duck(documents=docs), "op2_simhash")


def test_removal(spark):
    r = random.Random(1)
    parts = ["".join(r.choice("abé \U0001f600") for _ in range(n)) for n in (150, 260, 399, 700)]
    texts = [None, "", "a" * 399, "a" * 400, "b" * 401, "ab" * 900]
    texts += ["".join(r.choice(parts) if r.random() < 0.7 else str(r.random()) for _ in range(r.randint(0, 7))) for _ in range(60)]
    docs = made(spark, texts + texts[3:9])
    same(substrings.remove(docs).drop("kept"), duck(documents=docs), "op3_suffix_dedup")


def test_windows(spark):
    r = random.Random(2)
    words = lambda n: "".join(r.choice(["a", "B", "é", "7"]) + r.choice([" ", "_", "\n", ".."]) for _ in range(n))
    items = [words(n) for n in (0, 1, 5, 12, 13, 14, 30)] + [None, words(3)]
    texts = [None, "", "..."] + [words(r.randint(0, 20)) + r.choice(items[:7]) + words(r.randint(0, 20)) for _ in range(80)]
    docs = made(spark, texts)
    bench = spark.createDataFrame([(i if i != 2 else None, t) for i, t in enumerate(items)] + [(11, items[5])], "item_id long, text string")
    same(decontaminate.report(docs, bench).drop("spans"), duck(documents=docs, benchmark=bench), "op5_decontaminate")


def test_personal_data(spark):
    r = random.Random(4)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def piece():
        kind = r.randrange(8)
        if kind == 0:
            return f"{digits(3)}-{digits(2)}-{digits(4)}"
        if kind == 1:
            return f"{r.choice(['', '('])}{digits(3)}{r.choice(['', ')'])}{r.choice(' .-')}{digits(3)}{r.choice(' .-')}{digits(4)}"
        if kind == 2:
            return r.choice(["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82WEST12345698765432", "DE88 3704 0044 0532 0130 00", "AB" + digits(16)])
        if kind == 3:
            return r.choice(["4111 1111 1111 1111", "10.0.0.1", "1.2.3.256", "a@b.c", "+1 555 123 4567"])
        if kind == 4:
            return r.choice([" call ", " SSN ", " social ", " fax:", " mobile", " x" * 25])
        return r.choice(["_", "-", "+", ".", "(", " ", "é", "\U0001f600", "\n", "A", "b", "", "", " AND ", "\x01"])

    texts = [None, ""] + ["".join(piece() + r.choice(["", " ", " "]) for _ in range(r.randint(1, 14))) for _ in range(2500)]
    docs = made(spark, texts)
    found = pii.digest(docs)
    assert all(found.where(found.spans.contains(k)).count() > 40 for k in pii.PATTERNS)
    same(found, duck(documents=docs), "op6_pii")
