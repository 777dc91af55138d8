"""Secret scans with a ledger of content-addressed blobs.

Every version of every file is addressed by the SHA-256 of its text. Only pairs of blob and rule version
that the ledger doesn't hold are scanned, one copy of each blob; findings are then joined back to all
rows (paths) that carry the blob.

Defined results: a null text is the empty blob, without findings; repeated rows and equal texts share one
scan and each get its findings; an empty table gives an empty result and leaves the ledger as it was.
Spans count code points, the end exclusive.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import materialize, small_batches, table

RULE_VERSION = "secrets-1"
#: Kinds in the order in which spans with the same start are listed.
BASE_KINDS = ("assign", "access", "hex")
MORE_KINDS = ("jwt", "pem", "ghtoken")
#: Up to this many blobs (unseen ones, or those with spans) are broadcast to the texts; more are met by a shuffle.
FEW = 100_000
LEDGER = "blob string, rule_version string, spans array<struct<kind:string,start:int,end:int>>"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
#: A maximal run of the class is long enough or it isn't: a counted repeat finds the same runs.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_DOTTED = re.compile(r"[A-Za-z0-9_.-]{32,}")
_PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:(?!-----BEGIN)[\s\S])*?-----END (?:[A-Z]+ )*PRIVATE KEY-----")
_GH = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")


def _web_tokens(text: str):
    """Spans of three dotted parts of letters, digits, _ and -: from the first eyJ of one that has 8 more, eyJ and 8
    more, and 8. Runs are taken once and split at their dots, so a text of any kind takes linear time."""
    for run in _DOTTED.finditer(text):
        parts, at, k = run[0].split("."), run.start(), 0
        while k < len(parts):
            start = parts[k].find("eyJ") if k + 2 < len(parts) else -1
            if start >= 0 and len(parts[k]) - start >= 11 and parts[k + 1].startswith("eyJ") and len(parts[k + 1]) >= 11 and len(parts[k + 2]) >= 8:
                end = at + len(parts[k]) + len(parts[k + 1]) + len(parts[k + 2]) + 2
                yield at + start, end
                at, k = end + 1, k + 3
            else:
                at, k = at + len(parts[k]) + 1, k + 1


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if "eyJ" in text:
        found += [("jwt", a, b) for a, b in _web_tokens(text)]
    if "PRIVATE KEY-----" in text:
        found += [("pem", *m.span()) for m in _PEM.finditer(text)]
    if "gh" in text:
        found += [("ghtoken", *m.span()) for m in _GH.finditer(text)]
    order = {k: i for i, k in enumerate(BASE_KINDS + MORE_KINDS)}
    return sorted(found, key=lambda s: (s[1], order[s[0]]))


def _scan(batches):
    import pyarrow as pa

    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        rows = [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t or "")] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(rows, spans)], ["blob", "spans"])


def address(versions: DataFrame) -> DataFrame:
    """Adds blob, the address of the text."""
    return versions.withColumn("blob", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


def update_ledger(versions: DataFrame, paths: DataFrame, ledger: DataFrame | None, rule_version: str = RULE_VERSION) -> DataFrame:
    """The ledger with all blobs of versions (key, text) scanned under rule_version.

    paths: (key, blob) of the same rows. One row a blob is chosen by key, and only its text is scanned.
    """
    small_batches(versions.sparkSession)
    unseen = paths.groupBy("blob").agg(F.min("key").alias("key"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
        unseen = materialize(unseen, "secret-unseen")
    # after the first run few blobs are unseen: then no text is shuffled, and a known blob's text goes nowhere
    few = ledger is not None and unseen.count() <= FEW
    todo = address(versions).join(unseen.hint("broadcast" if few else "shuffle_hash"), ["key", "blob"]).select("blob", "text")
    found = todo.mapInArrow(_scan, "blob string, spans array<struct<kind:string,start:int,end:int>>")
    found = found.groupBy("blob").agg(F.first("spans").alias("spans")).select("blob", F.lit(rule_version).alias("rule_version"), "spans")
    found = materialize(found, "secret-ledger")
    return found if ledger is None else ledger.select("blob", "rule_version", "spans").unionByName(found)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "text")


def scan(docs: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(doc_id, blob, spans) of every row of docs, and the ledger for the next call."""
    paths = materialize(address(docs.select("doc_id", "text")).select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "blob"), "secret-paths")
    ledger = update_ledger(keyed(docs), paths, ledger, rule_version)
    found = ledger.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans")
    rows = paths.join(found, "blob", "left")
    none = F.from_json(F.lit("[]"), "array<struct<kind:string,start:int,end:int>>")
    return rows.select("doc_id", "blob", F.coalesce("spans", none).alias("spans")), ledger


def scan_with(path: str, docs: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """scan() with a ledger stored as Parquet under path: known pairs are read from it, new ones appended."""
    spark = docs.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    held = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    ledger = spark.read.schema(LEDGER).parquet(path) if held else None
    rows, now = scan(docs, ledger, rule_version)
    known = ledger.where(F.col("rule_version") == rule_version).select("blob", "rule_version") if held else None
    new = now if known is None else now.join(known, ["blob", "rule_version"], "left_anti").where(F.col("rule_version") == rule_version)
    materialize(new, "secret-new").write.mode("append").parquet(path)
    return rows


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every secret replaced by its kind in brackets; rows and other columns stay."""
    spark = docs.sparkSession
    small_batches(spark)
    paths = materialize(address(keyed(docs)).select("key", "blob"), "secret-paths")
    ledger = update_ledger(keyed(docs), paths, None)
    hot = ledger.where(F.size("spans") > 0).select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    # the ledger is a written table: what is counted here is what is sent
    hot = hot.hint("broadcast" if hot.count() <= FEW else "merge")
    blob = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    joined = docs.join(hot, blob == hot["__blob"], "left")
    return joined.select(*[_redact(F.col("text"), F.col("__spans")).alias(c) if c == "text" else docs[f"`{c}`"] for c in docs.columns])


def _redact(text: Column, spans: Column) -> Column:
    """Overlapping spans are cut as one, under the first one's kind."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, s):
        gap = F.when(s["start"] >= a["at"], F.concat(F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], gap).alias("out"))

    done = lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1))
    return F.when(spans.isNull(), text).otherwise(F.aggregate(spans, start, step, done))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    rows, _ = scan(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    return rows.select(
        "doc_id",
        *[F.size(of_kind(spans, k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(spans_text(of_kind(spans, *BASE_KINDS)), 256).alias("base_sha256"),
        spans_text(spans).alias("spans"),
    )


#: RE2 forms of the rules above: matches and the pieces between them give the offsets.
_SQL_RULES = {
    "assign": r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "ghtoken": r"gh[pousr]_[A-Za-z0-9]{36,}",
}
_SQL_TEST = {"assign": "length(regexp_extract(m, '[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 12", "access": "length(m) >= 18", "hex": "length(m) >= 16", "jwt": "true", "ghtoken": "true"}


def oracle_sql() -> str:
    parts = "\nUNION ALL\n".join(
        f"""SELECT doc_id, '{k}' AS kind, {n} AS o, m, CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS st
FROM (SELECT doc_id, ms, p, unnest(ms) AS m, generate_subscripts(ms, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{r}') AS ms, regexp_split_to_array(coalesce(text, ''), '{r}') AS p FROM documents))
WHERE {_SQL_TEST[k]}"""
        for n, (k, r) in enumerate(_SQL_RULES.items())
    )
    return f"""
WITH f AS ({parts}),
g AS (SELECT doc_id, kind, o, kind || ':' || st || ':' || (st + length(m)) AS s, st FROM f),
a AS (SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
  string_agg(s, ',' ORDER BY st, o) FILTER (o < 3) AS base, string_agg(s, ',' ORDER BY st, o) AS spans FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN a USING (doc_id)
"""
