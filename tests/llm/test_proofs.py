"""Operators held against the contract's own patterns, formulas written out, and a pipeline in plain Python."""

import random
import re
import unicodedata
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from terralith.llm import bpe, language, mixing, personal, quality, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digits(s):
    return [int(c) for c in s if c in "0123456789"]


def luhn(s):
    d = digits(s)[::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def literal(patterns, text):
    found = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(patterns) for m in re.finditer(p, text) if ok(m)]
    return [(name, a, b) for a, _, name, b in sorted(found)]


PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m[0])) <= 19 and luhn(m[0])),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m[0])) <= 15),
]
SECRETS = [
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
]


def test_patterns_equal_the_contract():
    pick = random.Random(3)
    some = ["a@b.c", "x.y@", "@b", ".com", "@", "1.2.3.4", "256.", "10.", "4591 6095 2396 9405", "4111-1111", "7", "12", " ", "-", "+1 (586) 555", "+", "8430", ").", "é", "\n", "４", "a"]
    more = ["password", "PassWd", "api_key", "APIKEY", "token", "secret", "'", '"', ":", "=", " ", "abcdef012345", "AKIA", "ABCDEFGH12", "deadbeef", "K", "ſecret", "\n", "-", "."]
    for _ in range(6000):
        t = "".join(pick.choice(some) for _ in range(pick.randint(0, 14)))
        assert personal.patterns(t) == literal(PERSONAL, t), t
        t = "".join(pick.choice(more) for _ in range(pick.randint(0, 14)))
        assert [s for s in secrets.find_secrets(t) if s[0] in secrets.BASE_KINDS] == literal(SECRETS, t), t


def labelled_table(n, seed):
    """Marked sentences with made-up numbers and addresses; dates, versions, orders and handles are not marked."""
    pick = random.Random(seed)
    d = lambda k: "".join(pick.choice("0123456789") for _ in range(k))
    area = lambda: str(pick.randint(201, 989))

    def value(kind):
        if kind == "phone":
            return pick.choice([f"({area()}) 555-{d(4)}", f"{area()}-555-{d(4)}", f"{area()}.555.{d(4)}", f"1-800-555-{d(4)}", f"+1 ({area()}) 555-{d(4)}"])
        if kind == "email":
            return f"{pick.choice('abcdk')}{pick.choice(['.', '_', ''])}{pick.choice(['meyer', 'rossi', 'novak'])}{d(2)}@{pick.choice(['mail', 'post', 'box'])}{d(1)}.{pick.choice(['example.com', 'example.org'])}"
        if kind == "ip":
            return ".".join(str(pick.randint(1, 254)) for _ in range(4))
        body = "4" + d(14)
        card = next(body + c for c in "0123456789" if luhn(body + c))
        return pick.choice(["", " ", "-"]).join(card[k : k + 4] for k in (0, 4, 8, 12))

    def plain():
        return pick.choice([f"in {pick.randint(1800, 2030)}", f"version {d(1)}.{d(1)}", f"pages {d(2)}-{d(3)}", f"on 20{d(2)}-0{pick.randint(1, 9)}-1{d(1)}", f"{d(3)} people", f"order {d(8)}", f"at 1{d(1)}:4{d(1)}", f"{d(1)},{d(3)}.{d(2)} in all", "see @handle", f"x{d(2)} and y{d(2)}"])

    before, after = ["Please use", "the contact is", "we noted", "ask for", "found :", "ou bien", "siehe", "it says"], ["tomorrow", "if needed", ", thanks", ". Then wait", "and go", "bitte", "again"]
    out = []
    for _ in range(n):
        kind, a, b = pick.choice(personal.KINDS), pick.choice(before), pick.choice(after)
        out.append(f"{a} [{kind}:{value(kind)}] {b}" if pick.random() < 0.6 else f"{a} {plain()} {b} {plain()}")
    return out


def test_field_on_held_out_sentences(spark):
    """Precision and recall without any pattern: of the built-in table, and of one that is passed in."""
    held = labelled_table(400, 1)
    marks = [re.search(r"\[(\w+):([^\]]+)\]", s) for s in held]
    texts = [re.sub(r"\[\w+:([^\]]+)\]", r"\1", s) for s in held]
    want = {(k, m[1], m.start(), m.start() + len(m[2])) for k, m in enumerate(marks) if m}
    table = spark.createDataFrame([(s, 1) for s in [*labelled_table(300, 2), None, "", "in 1999", "in 1999"]], "sentence string, text int")
    for sentences, recall in ((personal.SENTENCES, 0.85), (personal.sentences_of(table), 0.98)):
        got = {(k, *s) for k, spans in enumerate(personal.more_spans(personal.crf(sentences), texts, [[] for _ in texts])) for s in spans}
        assert len(got & want) >= 0.98 * len(got), len(got & want) / len(got)
        assert len(got & want) >= recall * len(want), len(got & want) / len(want)


def test_field_from_a_table_that_is_passed_in(spark):
    docs = spark.createDataFrame([(1, "ring 469-555-0306 or 10.0.0.7", "x"), (2, None, "y")], "doc_id long, text string, spans string")
    rows = lambda table: {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in personal.find(docs, table).collect()}
    none = spark.createDataFrame([], "sentence string")
    some = spark.createDataFrame([("ring [phone:469-555-0306] or 2019",)] * 3, "sentence string")
    assert rows(none) == {1: ["ip"], 2: []}
    assert rows(some) == {1: ["phone", "ip"], 2: []}
    assert personal.find(docs.where("false")).count() == 0


def plain_votes(t):
    t = t or ""
    w, n = WORD.findall(t), len(WORD.findall(t))
    seen = {}
    for i in range(n - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    again = len({p + k for v in seen.values() if len(v) > 1 for p in v for k in range(8)})
    lines = [x for x in t.split("\n") if WORD.search(x)]
    chars, symbols, marks = sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), t.count("!")
    upper, letters = sum(unicodedata.category(c) == "Lu" for c in t), sum(unicodedata.category(c)[0] == "L" for c in t)
    both = [(n < 20, n >= 50), (chars > 20 * n or chars < 2 * n, 3 * n <= chars <= 12 * n), (10 * len(set(w)) < 2 * n, 10 * len(set(w)) >= 4 * n)]
    both += [(x, False) for x in (5 * symbols > n, 20 * symbols > chars, 5 * marks > n, 3 * upper > letters and letters >= 20, 100 * again > 15 * n, 10 * (len(lines) - len(set(lines))) > 3 * len(lines))]
    return tuple(-1 if bad else 1 if good else 0 for bad, good in both), n < 20 or 100 * again > 30 * n


def plain_verdicts(texts):
    """(kept, posterior) of each text, by EM over the texts one by one."""
    judged = [plain_votes(t) for t in texts]
    votes = np.array([v for v, _ in judged])
    share, bad, good = 0.85, np.tile(quality.PRIOR_BAD, (9, 1)), np.tile(quality.PRIOR_GOOD, (9, 1))

    def posterior():
        g, b = (np.prod([c[k, votes[:, k] + 1] for k in range(9)], axis=0) for c in (good, bad))
        return share * g / (share * g + (1 - share) * b)

    for _ in range(12):
        p = posterior()
        extra = quality.PRIOR_WEIGHT * len(texts)
        count = lambda weight, prior: np.array([[weight[votes[:, k] == v].sum() + extra * q for v, q in zip((-1, 0, 1), prior, strict=True)] for k in range(9)])
        good, bad = (c / c.sum(axis=1, keepdims=True) for c in (count(p, quality.PRIOR_GOOD), count(1 - p, quality.PRIOR_BAD)))
        low = np.minimum(good[:, :1], quality.MAX_FALSE_ALARMS)
        good = np.hstack([low, good[:, 1:] * (1 - low) / good[:, 1:].sum(axis=1, keepdims=True)])
        share = min(0.99, max(0.5, p.mean()))
    p = posterior().round(6)
    return [(not failed and x >= 0.5, x) for (_, failed), x in zip(judged, p, strict=True)]


def test_quality_equals_plain_em_and_meets_the_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["kept"], r["quality"]) for r in quality.op2_quality_rules(spark, sf).collect()}
    want = dict(zip(rows, plain_verdicts(list(rows.values())), strict=True))
    assert {i: k for i, (k, _) in got.items()} == {i: k for i, (k, _) in want.items()}
    assert max(abs(got[i][1] - want[i][1]) for i in rows) < 1e-5
    labels = [(r["quality"], got[r["doc_id"]][0]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in got and r["quality"] is not None]
    bad, good = [k for q, k in labels if q == 0], [k for q, k in labels if q == 1]
    assert sum(bad) <= 0.05 * len(bad) and sum(good) >= 0.95 * len(good)


def test_language_equals_the_kernel_written_out(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang IS NOT NULL AND length(text) BETWEEN 50 AND 3000").orderBy("doc_id").collect()
    train, held = rows[:60], rows[60:110]

    def grams(t):
        s = "".join(c if c.isalpha() else " " for c in t.lower())
        s = re.sub(" +", " ", s)
        return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}

    langs, each = sorted({r["lang"] for r in train}), 8
    marks = [r for name in langs for r in [x for x in train if x["lang"] == name][:each]]
    known = set().union(*(grams(r["text"]) for r in marks))
    base = [grams(r["text"]) for r in marks]

    def kernel(t):
        g = grams(t) & known
        return np.array([len(g & b) / np.sqrt(len(g) * len(b)) for b in base])

    k = np.array([kernel(r["text"]) for r in marks])
    values, vectors = np.linalg.eigh(k)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.array([kernel(r["text"]) for r in train]) @ root
    y = np.array([[float(r["lang"] == name) for name in langs] for r in train])
    beta = np.linalg.solve(phi.T @ phi + language.RIDGE * len(train) * np.eye(phi.shape[1]), phi.T @ y)
    want = np.array([kernel(r["text"]) for r in held]) @ root @ beta
    names, scores = language.Model([r["text"] for r in train], [r["lang"] for r in train], landmarks=each).predict([r["text"] for r in held])
    assert names == [langs[k] for k in want.argmax(axis=1)]
    assert np.abs(np.clip(want.max(axis=1), 0, 1) - scores).max() < 1e-3


def plain_classes(texts):
    low = {i: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "") for i, t in texts.items()}
    words = {i: WORD.findall(t) for i, t in low.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return root


def test_pipeline_equals_plain_python(spark, tmp_path):
    import corpus_pipeline

    sf = f"file://{tmp_path}/in"
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    # some texts get a secret, one is null
    more = F.when(F.col("doc_id") == 3, F.lit(None)).when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit(" token = abcdefgh12345678 and deadbeefdeadbeef")))
    given.withColumn("text", F.when((F.col("doc_id") == 3) | (F.col("doc_id") % 10 == 1), more).otherwise(F.col("text"))).write.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: (r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kept = {i: t for (i, t), (ok, _) in zip(texts.items(), plain_verdicts([t for t, _ in texts.values()]), strict=True) if ok}
    kept = {i: kept[i] for i, c in plain_classes({i: t for i, (t, _) in kept.items()}).items() if i == c}

    def clean(t):
        out, at = "", 0
        for kind, a, b in secrets.find_secrets(t):
            if a >= at:
                out += t[at:a] + f"[{kind}]"
            at = max(at, b)
        return out + t[at:]

    rows = [(i, clean(t), s) for i, (t, s) in kept.items()]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    copies = {i: (2 * taken + size) // (2 * size) for i, taken, size in con.sql(f"SELECT doc_id, taken, size FROM ({mixing.ORACLE_SQL})").fetchall() if size}
    slow = bpe.default_codec().slow
    want = Counter()
    for i, t, _ in rows:
        if copies.get(i):
            want[i, tuple(slow.encode(t, add_special_tokens=False).ids)] = copies[i]
    assert any("[assign] and [hex]" in t for _, t, _ in rows) and max(copies.values()) > 1 and min(copies.values()) == 0
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want
