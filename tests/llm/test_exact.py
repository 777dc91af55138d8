"""Cases in which hashes, rounding or stored state could give wrong results."""

import numpy as np
from pyspark.sql import functions as F

from terralith.llm import jaccard, language, repeats, secrets, topk
from terralith.llm.common import word_hashes


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_that_defeat_polynomials_modulo_a_power_of_two(spark):
    one, two = thue_morse(2048), thue_morse(2048, "b", "a")
    data = np.frombuffer((one + " " + two).encode(), np.uint8)
    hashed = word_hashes(data, np.array([0, len(data)]))[0]
    assert hashed[0] != hashed[1]
    docs = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in jaccard.classes(docs).collect()} == {(1, 1), (2, 2), (3, 1)}
    h = repeats.BlockHashes(data)
    assert h.of(np.array([0]), np.array([2048]))[0] != h.of(np.array([2049]), np.array([4097]))[0]


def test_scores_beyond_floating_point(spark):
    big = float(2**20)
    rows = [(0, [big, 1 / 256, 0.0])] + [(i, [big, i / 256, 0.0]) for i in (3, 1, 2)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in topk.search(d, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(k, i, 2**56 + i) for k, i in ((1, 3), (2, 2), (3, 1))]


def test_numbers_are_not_letters(spark):
    d = spark.createDataFrame([(i, "the house and the tree" if i % 2 else "das haus und der baum", "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "\u00bd \u00b2 \u2167"), (2, ""), (3, None), (4, "the tree")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(asked, d).collect()} == {1: "und", 2: "und", 3: "und", 4: "en"}
    assert language.identify(asked.where("false"), d).count() == 0


def test_a_stored_ledger_scans_only_what_it_lacks(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    d = spark.createDataFrame([(1, "token = abcdefgh12345678"), (2, "clean"), (3, None), (3, "clean")], "doc_id long, text string")
    first = sorted((r["doc_id"], len(r["spans"])) for r in secrets.scan_with(path, d).collect())
    assert first == [(1, 1), (2, 0), (3, 0), (3, 0)] and spark.read.parquet(path).count() == 3
    assert sorted((r["doc_id"], len(r["spans"])) for r in secrets.scan_with(path, d).collect()) == first
    assert spark.read.parquet(path).count() == 3
    secrets.scan_with(path, d.union(spark.createDataFrame([(9, "f00dfeedf00dfeed")], d.schema)))
    assert spark.read.parquet(path).count() == 4
    secrets.scan_with(path, d.limit(0), "secrets-2")
    assert spark.read.parquet(path).count() == 4
