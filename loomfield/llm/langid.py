"""Language identification by string kernels (operator 8).

Kernel: blended-spectrum presence kernel over character n-grams, n = 1 to 4 (the number of distinct n-grams two
texts share, over the geometric mean of their own numbers), on letters of the lower-cased text, every run of other
characters being one space. n-grams are hashed to 2**BITS buckets. Landmarks are a fixed share of the training
sample; a text x becomes phi(x) = K(L,L)^(-1/2) k(L,x) (Nystroem), and one ridge regression for each language
against the rest gives weights W. Scores of a batch are k(X,L) K(L,L)^(-1/2) W; as k is linear in presence
vectors, the product is regrouped as X (L' K^(-1/2) W), one sparse batched matrix product with a
(buckets x languages) matrix.

The model is fitted on the driver from a bounded sample of labelled texts: at most QUOTA a language and SAMPLE in all, but
LEAST_QUOTA of every language however many there are; those with the smallest hashes of their ids, as bucket numbers (at most
SAMPLE_GRAMS a text, the smallest). No language that has a labelled text is left out, and landmarks grow with languages.
Prediction is row by row, over whole texts, in Arrow batches: no shuffle, nothing collected. For up to DENSE languages the
model sent to executors has 2**BITS x languages floats; for more, n-grams have WIDE_BITS buckets and the model has the
landmarks' buckets and the factor behind them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

BITS, WIDE_BITS, ORDERS = 17, 21, 4
#: The sample: at most QUOTA texts a language and SAMPLE in all, but LEAST_QUOTA a language; grams of one text in it.
QUOTA, SAMPLE, LEAST_QUOTA, SAMPLE_GRAMS = 400, 4096, 8, 1 << 14
#: Landmarks: at most LANDMARKS a language and ALL_LANDMARKS in all, but LEAST_LANDMARKS a language.
LANDMARKS, ALL_LANDMARKS, LEAST_LANDMARKS, DENSE, RIDGE = 80, 320, 4, 16, 1e-2
UNKNOWN = "und"
_HASH_RANGE = 1 << 30
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


class Grams:
    """Distinct n-gram buckets of texts; keeps its scratch bitmap between calls."""

    def __init__(self, bits: int = BITS) -> None:
        self.bits = bits
        self.seen = np.zeros(1 << bits, bool)

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted bucket numbers; empty if the text is null or has no letter."""
        if not text:
            return np.zeros(0, np.int64)
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[c]
        if not letter.any():
            return np.zeros(0, np.int64)
        c = np.where(letter, c, 32).astype(np.uint64)
        keep = np.ones(len(c), bool)
        keep[1:] = letter[1:] | letter[:-1]
        c = np.concatenate([[np.uint64(32)], c[keep], [np.uint64(32)]]).astype(np.uint64)
        h = np.zeros(len(c), np.uint64)
        for n in range(1, ORDERS + 1):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :] + np.uint64(n)
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            self.seen[(mixed >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found


class Landmarks:
    """Buckets of the landmarks, each with the landmarks that have it."""

    def __init__(self, grams: list[np.ndarray]) -> None:
        self.size = len(grams)
        bucket, owner = np.concatenate(grams), np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
        order = np.argsort(bucket, kind="stable")
        self.owner = owner[order]
        self.keys, starts = np.unique(bucket[order], return_index=True)
        self.starts = np.r_[starts, len(order)]

    def shared(self, g: np.ndarray) -> np.ndarray:
        """How many of the buckets each landmark has."""
        at = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
        at = at[self.keys[at] == g]
        n = self.starts[at + 1] - self.starts[at]
        rows = np.repeat(self.starts[at] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(at) else np.zeros(0, np.int64)
        return np.bincount(self.owner[rows], minlength=self.size)

    def weights(self, inner: np.ndarray, buckets: int) -> np.ndarray:
        """(buckets x languages): the rows of inner, summed over each bucket's landmarks."""
        out = np.zeros((buckets, inner.shape[1]), np.float32)
        if len(self.keys):
            out[self.keys] = np.add.reduceat(inner[self.owner], self.starts[:-1], axis=0)
        return out


@dataclass
class Model:
    languages: list[str]
    known: np.ndarray  # whether a text of the sample has the bucket
    texts: dict[str, int]  # of the sample, by language
    weights: np.ndarray | None = None  # buckets x languages, where these are few
    landmarks: Landmarks | None = None  # else
    inner: np.ndarray | None = None  # landmarks x languages
    bits: int = BITS

    def scores(self, grams: list[np.ndarray]) -> np.ndarray:
        """Batch scores, texts x languages: the sparse presence matrix, row-normalised, times the weights."""
        sizes = np.array([len(g) for g in grams])
        out = np.zeros((len(grams), len(self.languages)))
        full = np.flatnonzero(sizes)
        if len(full) and self.languages:
            if self.weights is not None:
                sums = np.add.reduceat(self.weights[np.concatenate([grams[i] for i in full])], np.r_[0, np.cumsum(sizes[full])[:-1]], axis=0)
            else:
                sums = np.stack([self.landmarks.shared(grams[i]) for i in full]).astype(np.float32) @ self.inner
            out[full] = sums / np.sqrt(sizes[full])[:, None]
        return out

    def familiar(self, grams: list[np.ndarray]) -> np.ndarray:
        """The share of each text's buckets that the sample has, above what buckets drawn at random would have (0 for these).

        It does not depend on the number of languages; texts of unlearned scripts and letter junk are near 0.
        """
        chance = float(self.known.mean())
        share = np.array([self.known[g].mean() if len(g) else 0.0 for g in grams])
        return np.clip((share - chance) / max(1 - chance, 1e-9), 0, 1)


def fit(grams: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, bits: int = BITS) -> Model:
    """Nystroem features and one-versus-rest kernel ridge regression on a sample in hash order."""
    languages = sorted(set(labels))
    known = np.zeros(1 << bits, bool)
    if not languages:
        return Model([], known, {}, np.zeros((1 << bits, 0), np.float32), bits=bits)
    number = {x: k for k, x in enumerate(languages)}
    label = np.array([number[x] for x in labels])
    most = max(1, min(landmarks, max(LEAST_LANDMARKS, ALL_LANDMARKS // len(languages))))
    mark = np.concatenate([np.flatnonzero(label == k)[:most] for k in range(len(languages))])
    marks = Landmarks([grams[i] for i in mark])
    scale = 1 / np.sqrt([len(grams[i]) for i in mark])
    cross = np.stack([marks.shared(g) * scale / np.sqrt(len(g)) for g in grams])
    near = cross[mark]
    values, vectors = np.linalg.eigh(near.astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    phi = cross @ root
    target = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    texts = np.bincount(label, minlength=len(languages))
    weight = np.sqrt(len(labels) / len(languages) / texts[label])[:, None]
    w = np.linalg.solve((phi * weight).T @ (phi * weight) + ridge * np.eye(phi.shape[1]), (phi * weight).T @ (target * weight))
    inner = (scale[:, None] * (root @ w)).astype(np.float32)
    for g in grams:
        known[g] = True
    counts = dict(zip(languages, texts.tolist(), strict=True))
    if len(languages) > DENSE:
        return Model(languages, known, counts, landmarks=marks, inner=inner, bits=bits)
    return Model(languages, known, counts, marks.weights(inner, 1 << bits), bits=bits)


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 4; 2 is the held-out fold."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def _gram_rows(bits: int):
    def run(batches):
        grams = Grams(bits)
        for batch in batches:
            found = [grams(x)[:SAMPLE_GRAMS].astype(np.int32).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["lang", "u", "grams"])

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quota: int = QUOTA) -> Model:
    """A model of the labelled texts outside the held-out fold, from the quota a language with the smallest id hashes."""
    known = docs.filter(F.col(lang_col).isNotNull() & (fold(id_col) != 2)).select(
        F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(id_col), F.lit(_HASH_RANGE)).alias("u"), F.col(text_col).alias("text")
    )
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a language
    if not counts:
        return fit([], [])
    bits = BITS if len(counts) <= DENSE else WIDE_BITS
    quota = max(1, min(quota, max(LEAST_QUOTA, SAMPLE // len(counts))))
    # a hash below `most` holds the quota with room to spare
    most = [(row["lang"], int(_HASH_RANGE * min(1.0, (quota + 4 * quota**0.5 + 10) / row["n"]))) for row in counts]
    table = docs.sparkSession.createDataFrame(most, "lang string, most long")
    chosen = known.withColumn("lang", F.col("lang").cast("string")).join(F.broadcast(table), "lang").filter("u < most").select("lang", "u", "text")
    rows = sorted(chosen.mapInArrow(_gram_rows(bits), "lang string, u long, grams binary").collect())
    grams, labels, used = [], [], dict.fromkeys((r["lang"] for r in rows), 0)
    for lang, _, raw in rows:
        if raw and used[lang] < quota:
            used[lang] += 1
            labels.append(lang)
            grams.append(np.frombuffer(raw, np.int32))
    return fit(grams, labels, bits=bits)


def annotated(docs: DataFrame, model: Model, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score", familiar_name: str | None = None) -> DataFrame:
    """docs with two more columns: the predicted language and its score (softmax of doubled regression scores).

    With familiar_name, a third is the share of the text's n-grams that the sample knows, chance taken off.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        known = shared.value
        grams = Grams(known.bits)
        for batch in batches:
            text, named, sure, near = batch.column(place), [], [], []
            for at in range(0, len(text), 256):
                found = [grams(x) for x in text.slice(at, 256).to_pylist()]
                s = known.scores(found)
                if familiar_name:
                    near += known.familiar(found).tolist()
                if not s.shape[1]:
                    named += [UNKNOWN] * len(found)
                    sure += [0.0] * len(found)
                    continue
                p = 1 / np.exp(2 * (s - s.max(axis=1, keepdims=True))).sum(axis=1)
                named += [known.languages[b] if len(g) else UNKNOWN for b, g in zip(s.argmax(axis=1), found, strict=True)]
                sure += [round(float(x), 6) if len(g) else 0.0 for x, g in zip(p, found, strict=True)]
            more = [pa.array(near, pa.float64())] if familiar_name else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(named, pa.string()), pa.array(sure, pa.float64()), *more], [*batch.schema.names, lang_name, score_name, *extra])

    extra = [familiar_name] if familiar_name else []
    schema = StructType([*docs.schema.fields, StructField(lang_name, StringType()), StructField(score_name, DoubleType()), *[StructField(x, DoubleType()) for x in extra]])
    return docs.mapInArrow(run, schema)


#: On documents the least familiar text of a learned language has 0.74 (sf0.001); Finnish, not learned, has 0.51.
#: A sample of fewer than ENOUGH texts of a language does not know it, so a smaller share is asked for in proportion.
FAMILIAR, ENOUGH = 0.6, 16


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", familiar: float = FAMILIAR) -> DataFrame:
    """The rows of docs, with all their columns, whose text is of a learned language: `und` goes, and so does a text
    of whose n-grams the sample knows less than that share (scripts and languages not learned, letter junk).

    The share doesn't depend on the number of languages; of which language a text is does not matter, only that it is of one.
    """
    model = train(docs, id_col, text_col, lang_col)
    names = []
    for name in ("lang", "score", "familiar"):
        while name in (*docs.columns, *names):
            name = f"_{name}"
        names.append(name)
    rows = annotated(docs, model, text_col, *names)
    few = {x: n for x, n in model.texts.items() if n < ENOUGH}
    share = F.lit(1.0)
    if few:
        table = F.create_map(*(y for x, n in few.items() for y in (F.lit(x), F.lit(n / ENOUGH))))
        share = F.coalesce(F.element_at(table, F.col(names[0])), F.lit(1.0))
    return rows.filter((F.col(names[0]) != UNKNOWN) & (F.col(names[2]) >= familiar * share)).drop(*names)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    A null text, or one without a letter, is `und` with score 0. With no labelled text to learn from all are.
    A null id is not held out and not learned from. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = annotated(rows, train(docs, id_col, text_col, lang_col))
    return found.select("doc_id", F.coalesce(fold("doc_id") == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
