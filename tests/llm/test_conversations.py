"""Operators 11 to 13, and very long or odd inputs of earlier ones, against SQL of the contract and brute force."""

import os
import random
import sys
import time

import duckdb
import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from oracle import compare

from terralith.llm import jaccard, language, personal, repair, secrets, setsketch, trie

TURNS = "conv_id long, turn long, role string, text string, prefix int, cost string"


def stored(spark, tmp_path, name, rows, schema, parts=3):
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(f"file://{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return f"file://{tmp_path}", con


def messy(pick, conversations, texts):
    for c in conversations:
        for _ in range(pick.choice([0, 1, 2, 3, 5, 9, 14])):
            yield c, pick.choice([None, *range(9)]), pick.choice(["user", "assistant", "system", "tool", None, "u", ""]), pick.choice(texts), 1, "x"


def test_repair_equals_sql(spark, tmp_path):
    rows = list(messy(random.Random(5), [*range(400), None], ["hi.", "ok!", "no", "", "  ", "yes?\n", "a.", None, "é"]))
    sf, con = stored(spark, tmp_path, "conversations", rows + rows[:40], TURNS)
    compare(repair.op11_repair(spark, sf), con, repair.oracle_sql())


def cheapest(codes):
    """Least (cost, audit) by trying edits row by row, all of them kept as sets of states."""
    best = {0: (0, "")}

    def inserted(b):
        for _ in range(3):
            for s, (c, a) in list(b.items()):
                to = repair.TURN[s]
                b[to] = min(b.get(to, (10**9, "")), (c + 5, a + "I"))
        return b

    for code in codes:
        kind, pen = divmod(ord(code) - 65, 3)
        after = {}
        for s, (c, a) in inserted(dict(best)).items():
            ways = [(s, 2, "D")]
            if pen < 2:
                ways += [(repair.TURN[s], 1 + 5 * pen, "R")] + ([(repair.KEEPS[kind, s], 5 * pen, "K")] if repair.KEEPS[kind, s] >= 0 else [])
            for to, cost, letter in ways:
                after[to] = min(after.get(to, (10**9, "")), (c + cost, a + letter))
        best = after
    best = inserted(dict(best))
    return min(best[s] for s in (0, 3) if s in best)


def test_ranks_choose_the_least_audit():
    pick = random.Random(2)
    # letters K and R of equal length decide; the forward search keeps one audit a state, the least
    codes = ["".join(chr(65 + 3 * pick.randrange(4) + pick.randrange(3)) for _ in range(pick.choice([0, 1, 2, 3, 7, 40, 300]))) for _ in range(300)]
    costs, audits = repair.repair(codes)
    assert [(c, a) for c, a in zip(costs, audits, strict=True)] == [cheapest(c) for c in codes]


def test_one_long_conversation(spark):
    n = 3000
    rows = [(7, k, "user" if k % 2 == 0 else "assistant", f"turn {k}.", 1, "") for k in range(n)]
    conv = spark.createDataFrame(rows, TURNS)
    r = repair.repaired(conv).collect()
    assert len(r) == 1 and len(r[0]["audit"]) > 0.9 * n
    # no conversation 0: the turns after the first three at most are left, in one chain
    got = trie.nodes(conv).agg(F.count("*"), F.max("depth"), F.max("n_children"), F.sum("n_leaves")).first()
    assert got[1] >= n - 3 and got[0] == got[1] + 1 == got[3] and got[2] == 1


def test_trie_equals_sql(spark, tmp_path):
    pick = random.Random(9)
    rows = []
    for c in [*range(-60, 260), None]:
        for k in range(pick.choice([0, 1, 2, 3, 5, 9, 14])):
            turn = pick.choice([None, *range(9)]) if pick.random() < 0.2 else k
            rows.append((c, turn, ["user", "assistant"][k % 2] if pick.random() < 0.95 else None, f"hello there {k}" if pick.random() < 0.93 else pick.choice([None, "", "x y"]), 1, ""))
    sf, con = stored(spark, tmp_path, "conversations", rows + rows[:30], TURNS)
    compare(trie.op13_trie(spark, sf), con, trie.oracle_sql())


def test_trie_lists_many_members_in_order(spark, tmp_path):
    rows = [(c, 0, "user", "same", 1, "") for c in range(9000, 0, -1)]
    sf, con = stored(spark, tmp_path, "conversations", rows, TURNS)
    compare(trie.op13_trie(spark, sf), con, trie.oracle_sql())


def test_empty_tables(spark):
    none = spark.createDataFrame([], TURNS)
    assert repair.repaired(none).count() == trie.nodes(none).count() == 0
    assert setsketch.classes(spark.createDataFrame([], "doc_id long, text string, n int, bucket string")).count() == 0


def near_copies(seed):
    pick = random.Random(seed)
    vocabulary = ["".join(pick.choice("abcdefgh") for _ in range(pick.randint(2, 6))) for _ in range(300)]
    prose = lambda n: [pick.choice(vocabulary) for _ in range(n)]
    texts = [prose(pick.randint(1, 200)) for _ in range(40)]
    for size, changes in ((60, 6), (40, 1), (40, 3), (30, 9)):  # groups around a text, some members farther from it than from each other
        base = prose(160)
        for _ in range(size):
            w = list(base)
            for _ in range(pick.randint(0, changes)):
                w[pick.randrange(len(w))] = pick.choice(vocabulary)
            texts.append(w)
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)]
    rows += [(900, rows[50][1]), (901, rows[51][1].upper()), (902, None), (903, " \n"), (904, "one two"), (905, "One two"), (906, "")]
    # a document of two different rows
    rows += [(52, rows[120][1])]
    return [(i, t, 1, "x") for i, t in rows]


def test_setsketch_equals_sql(spark, tmp_path):
    for seed in (1, 2):
        rows = [r for r in near_copies(seed) if r[0] != 52]
        sf, con = stored(spark, tmp_path / str(seed), "documents", rows, "doc_id long, text string, n int, bucket string")
        compare(setsketch.op12_setsketch(spark, sf), con, setsketch.ORACLE_SQL)
        compare(jaccard.op10_jaccard(spark, sf), con, setsketch.link_sql(80))


def test_rows_of_one_document_are_one(spark):
    rows = near_copies(1)
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in setsketch.classes(spark.createDataFrame(rows, "doc_id long, text string, n int, bucket string")).collect()}
    own = {c for (i, _), c in got.items() if i == 52}
    assert len(own) == 1


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    for n, j in ((1, 1.0), (40, 0.85), (300, 0.5), (4000, 0.85)):
        c = round(2 * n * j / (1 + j))
        off = []
        for _ in range(20):
            x = rng.integers(0, 2**63, 2 * n - c, dtype=np.uint64)
            a, b = x[:n], x[n - c :]
            k = setsketch.sketches(np.concatenate([a, b]), np.array([0, n, 2 * n]))
            assert (setsketch.merge(k[0], k[1]) == setsketch.sketches(x, np.array([0, len(x)]))[0]).all()
            off.append(setsketch.similarity(k[:1], k[1:], np.array([float(n)]), np.array([float(n)]))[0] - c / (2 * n - c))
        assert abs(np.mean(off)) < 0.04 and np.abs(off).max() < 0.2


def test_patterns_take_linear_time():
    million = 10**6
    odd = ["eyJ", "eyJ.", "eyJaaaaaaaa.", "1.", "1.2.3.4 ", "0", "00.", "a@", "@a.", "a@b.c", "+1", "+1 (", "4 ", "4-", "-----BEGIN ", "-----BEGIN A PRIVATE KEY-----", "-----END A ", "password ", "secret=", "token:", "AKIA", "gh", "ghp_", "abc", " ", "a.", "."]
    for piece in odd:
        text = piece * (million // len(piece))
        for f in (secrets.find_secrets, personal.patterns):
            start = time.process_time()
            f(text)
            assert time.process_time() - start < 5, (piece, f)


def test_web_tokens_equal_the_pattern():
    import re

    pattern = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
    pick = random.Random(4)
    for _ in range(5000):
        t = "".join(pick.choice(["eyJ", "abcdefgh", ".", ".", " ", "eyJabcdefgh1", "x", "-_"]) for _ in range(pick.randint(0, 18)))
        assert [s[1:] for s in secrets.find_secrets(t) if s[0] == "jwt"] == [m.span() for m in pattern.finditer(t)], t


def test_addresses_with_thousands_of_zeros():
    t = "x 1.2.3." + "0" * 5000 + "1 y and 1.2.3." + "0" * 5000 + "256"
    assert personal.patterns(t) == [("ip", 2, 2 + 6 + 5001)]


def test_languages_of_long_texts_are_learned(spark):
    german, english = "der hund und die katze gehen über straßen ", "the dog and the cat walk across some streets "
    rows = [(k, german * 600 + str(k), "de", 1) for k in range(20)] + [(100 + k, english * 3 + str(k), "en", 1) for k in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, h int")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(d, d).collect()}
    assert all(got[i] == lang for i, _, lang, _ in rows)
    only = d.where("lang = 'de'")
    assert {r["lang_pred"] for r in language.identify(only, only).collect()} == {"de"}
