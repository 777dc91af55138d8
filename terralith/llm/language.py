"""Language identification by a string kernel: blended-spectrum n-gram presence, Nystroem landmarks and
one-versus-rest kernel ridge regression.

The kernel of two texts is the number of 1- to 3-grams of letters and spaces that both hold, over the
square root of the product of their own numbers. Grams are those of the landmarks' texts, in any script. Landmarks
and training rows are a sample of labelled rows: per language up to PER_LANGUAGE texts of at most TRAIN_CHARS
code points, chosen by a hash of doc_id, or LONG of its shortest where all of a language are longer; over MAX_LANGUAGES languages share what so many would get, at least one
text each, so none is left out. Scoring is over whole texts, in batches: one flag for each gram a
text holds, times a matrix that folds the landmark kernels and the ridge weights together.

Defined results: texts that are null or hold no letter get `und` and score 0; where no labelled row is
given, all do; repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import small_batches, table

#: Bounds of the training sample: texts a language, code points a text, and languages that get so many texts.
PER_LANGUAGE, TRAIN_CHARS, MAX_LANGUAGES = 300, 20_000, 500
#: Texts of a language that has longer ones only.
LONG = 8
LANDMARKS = 60
#: Rows are drawn by a hash below this, so that a share of any number of rows can be told.
DRAWS = 10**15
RIDGE = 1e-3
UNKNOWN = "und"

@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: a letter's code point + 1, anything else 1 (a space)."""
    return np.array([c + 1 if chr(c).isalpha() else 1 for c in range(0x110000)], np.int64)


class Grams:
    """Codes of 1- to 3-grams: three letters of 21 bits each (0: none) in 63 bits, so no two grams share a code."""

    known = np.zeros(0, np.int64)

    def codes(self, text: str) -> np.ndarray:
        """All gram codes of a text; runs of other characters are one space."""
        a = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        if not len(a):
            return a
        a = a[np.r_[True, (a[1:] != 1) | (a[:-1] != 1)]]
        two = a[:-1] << 21 | a[1:]
        return np.concatenate([a, two, two[:-1] << 21 | a[2:]])

    def keep(self, codes: list[np.ndarray]) -> int:
        """From now on only grams of these texts count; their number."""
        self.known = np.unique(np.concatenate(codes))
        return len(self.known)

    def present(self, text: str, flags: np.ndarray) -> np.ndarray:
        """Known grams of a text; flags is scratch space, left as it was."""
        codes = self.codes(text)
        at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        flags[at[self.known[at] == codes]] = True
        found = np.flatnonzero(flags)
        flags[found] = False
        return found


class Model:
    """weights: gram x language, the kernel with every landmark folded into the ridge's coefficients."""

    def __init__(self, texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.langs = sorted(set(langs))
        order = sorted(range(len(texts)), key=lambda i: (langs[i], i))
        landmarks = share_out(landmarks, len(self.langs))
        marks = [i for name in self.langs for i in [k for k in order if langs[k] == name][:landmarks]]
        self.grams = Grams()
        v = self.grams.keep([self.grams.codes(texts[i]) for i in marks])
        self.flags = np.zeros(v, bool)

        def rows(which):
            m = np.zeros((len(which), v), np.float32)
            for r, i in enumerate(which):
                m[r, self.grams.present(texts[i], self.flags)] = 1
            return m / np.sqrt(np.maximum(m.sum(axis=1, keepdims=True), 1))

        base = rows(marks)
        values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
        good = values > 1e-6 * values.max(initial=1)
        root = vectors[:, good] / np.sqrt(values[good])  # Nystroem features: k(x, landmarks) @ root
        gram, cross = np.zeros((good.sum(), good.sum())), np.zeros((good.sum(), len(self.langs)))
        for at in range(0, len(texts), 256):
            which = list(range(at, min(at + 256, len(texts))))
            phi = (rows(which) @ base.T).astype(np.float64) @ root
            gram += phi.T @ phi
            cross += phi.T @ np.array([[1.0 if langs[i] == name else 0.0 for name in self.langs] for i in which])
        solved = np.linalg.solve(gram + ridge * len(texts) * np.eye(len(gram)), cross)
        self.weights = (base.T.astype(np.float64) @ (root @ solved)).astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.flags) != len(self.weights):
            self.flags = np.zeros(len(self.weights), bool)
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        which = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        for at in range(0, len(which), 64):
            part = which[at : at + 64]
            found = [self.grams.present(texts[i], self.flags) for i in part]
            ends = np.cumsum([0, *map(len, found)])
            # a row of presences times the weights: the sum of its grams' weights
            sums = np.add.reduceat(np.vstack([self.weights[np.concatenate(found)], np.zeros((1, self.weights.shape[1]), np.float32)]), np.minimum(ends[:-1], ends[-1]), axis=0)
            for k, i in enumerate(part):
                f = sums[k] / max(1, len(found[k])) ** 0.5 if len(found[k]) else np.zeros(len(self.langs))
                best = int(np.argmax(f))
                names[i], scores[i] = self.langs[best], float(min(1.0, max(0.0, f[best])))
        return names, scores


def share_out(each: int, languages: int) -> int:
    """What a language gets of each."""
    return max(1, min(each, each * MAX_LANGUAGES // languages))


def threshold(rows: int, per_language: int) -> int:
    """Draws below it take about 1.5 x per_language + 20 of so many rows, so that a small share never comes out empty."""
    return min(DRAWS, -(-(3 * per_language + 40) * DRAWS // (2 * rows)))


def shortest(long: DataFrame) -> DataFrame:
    """lang, text of the shortest text in each of LONG classes of every language, by the texts' hash."""
    keyed = long.select("lang", "text", F.char_length("text").alias("chars"), F.xxhash64("text").alias("h"))
    least = keyed.groupBy("lang", F.pmod("h", F.lit(LONG)).alias("class")).agg(F.min(F.struct("chars", "h")).alias("s")).select("lang", "s.*")
    return keyed.join(F.broadcast(least), ["lang", "chars", "h"]).dropDuplicates(["lang", "chars", "h"]).select("lang", "text")


def sample(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """Texts and languages of the training sample, the same in every run; labelled: doc_id, text, lang."""
    lettered = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    few = F.char_length("text") <= TRAIN_CHARS
    sizes = {r["lang"]: r["n"] for r in lettered.groupBy("lang").agg(F.count_if(few).alias("n")).collect()}
    if not sizes:
        return [], []
    per_language = share_out(per_language, len(sizes))
    part = lambda seed, below: F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), F.lit(below))
    draw = part("language", 1_000_000) * F.lit(DRAWS // 1_000_000) + part("language-2", DRAWS // 1_000_000)
    shares = labelled.sparkSession.createDataFrame([(k, threshold(max(1, n), per_language)) for k, n in sizes.items()], "lang string, below long")
    # about 1.5 x per_language + 20 texts a language come to the driver, and no more than twice as many
    rows = lettered.where(few).select("lang", "text", draw.alias("d"), F.xxhash64("text").alias("h")).join(F.broadcast(shares), "lang").where("d < below").drop("below")
    # rows of one doc_id share a draw: where these are many, the least by draw and text come, the same in every run
    rows = rows.orderBy("d", "h", "lang").limit((3 * per_language + 40) * len(sizes) + 1000).collect()
    out, taken = [], {}
    for r in sorted(rows, key=lambda r: (r["d"], r["h"])):
        if taken.setdefault(r["lang"], 0) < per_language:
            taken[r["lang"]] += 1
            out.append((r["text"], r["lang"]))
    none = [k for k, n in sizes.items() if n == 0]
    if none:
        out += sorted((r["text"], r["lang"]) for r in shortest(lettered.where(F.col("lang").isin(none))).collect())
    return [t for t, _ in out], [g for _, g in out]


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs, learned from labelled (doc_id, text, lang)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts, langs = sample(labelled)
    model = spark.sparkContext.broadcast(Model(texts, langs)) if texts else None

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            names, scores = model.value.predict(texts) if model else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, docs.where(~held_out(F.col("doc_id"))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
