"""The rules' ledger against SQL, and ablations against plain counts."""

from collections import Counter

import duckdb
from pyspark.sql import functions as F

from tidemark.llm import quality_rules as Q


def texts():
    return [None, "", " \n\t ", "a " * 80, "one two three " * 30, " ".join(f"word{i}" for i in range(60)), "LOUD " * 60, "\n".join(["same line of words"] * 20 + [f"line {i}" for i in range(30)]),
            "# $ % & * | < > " * 20, " ".join("x" * 50 + str(i) for i in range(55)), "é字 " * 70, "a b c a b c", "\x0b\x0c\r words \r\n and\x0bmore " * 20]


def test_ledger_against_sql(spark, tmp_path):
    rows = list(enumerate(texts()))
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("failed", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.verdict(Q.ledger(spark.read.parquet(f"{tmp_path}/documents.parquet")))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed", "kept"]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"select {', '.join(names)} from ({Q.ORACLE})").fetchall()
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want)


def test_ablations_against_counts(spark):
    bits = [0, 0, 1, 1, 2, 3, 5, 8, 64, 66, 127, 4]
    entries = spark.createDataFrame([(i, b) for i, b in enumerate(bits)], "doc_id long, failed long")
    for policy, names in Q.POLICIES.items():
        got = {r["rule"]: tuple(r)[1:] for r in Q.ablations(entries, policy).select("rule", "n_failed", "n_only", "n_kept_without").collect()}
        whole, want = Q.mask(names), {}
        count = Counter(b & whole for b in bits)
        for n in names:
            one = Q.mask((n,))
            want[n] = tuple(sum(c for b, c in count.items() if test(b)) for test in (lambda b: b & one, lambda b: b == one, lambda b: not b & ~one))  # noqa: B023
        assert got == want
