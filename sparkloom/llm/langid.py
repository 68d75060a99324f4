"""Language identification by a blended-spectrum string kernel.

A text's features are the distinct 1-, 2- and 3-grams of its lower-cased characters (everything that is no letter is
a blank). k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|). Nystroem landmarks, drawn per language, map a text to
K_mm^(-1/2) k(x, landmarks); one-versus-rest kernel ridge regression on these gives a decision value per language.
Texts are scored in batches: presence matrix times landmark matrix times coefficients.

A text is of no learned language if too few of its n-grams are known to any: a language knows those in at least one of
KNOWN_IN of its sampled rows, and asks of a text the share FAR of what its own rows have typically known of them by the
others (taken as TYPICAL at least, where few rows tell little). The share is forgiven SLACK / sqrt(n-grams), so that a
short text is only rejected on strong evidence. Nothing of this depends on how many languages are learned.

The classifier is fitted on a bounded sample: at most TRAIN_ROWS labelled rows over all languages (a language gets an
equal share, at least 8), in order of a hash, texts of up to SAMPLE_CHARS first; everything is scored whole.

Defined results: a null text or one without a letter is `und` with score 0; rows with null lang or text, or without a
letter, are not learned from; a null doc_id counts as the empty text in the fold; without anything to learn from all
is `und`; repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm import common

TRAIN_ROWS, LANDMARKS, SAMPLE_CHARS, RIDGE, SHARPNESS, BATCH, CHUNK = 3000, 160, 20_000, 1e-4, 3.0, 128, 1 << 17
KNOWN_IN, FAR, TYPICAL, SLACK = 250, 0.65, 0.5, 2.0
#: Every code point: a letter (any Unicode category L) or not.
_LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str) -> np.ndarray:
    """Sorted codes of the text's distinct 1- to 3-grams; empty if it has no letter. 21 bits a character."""
    parts, letters = [], False
    for at in range(0, len(text), CHUNK):
        x = np.frombuffer(text[max(0, at - 2) : at + CHUNK].lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        letter = _LETTER[x]
        letters |= bool(letter.any())
        x = np.where(letter, x, np.uint64(32))
        two = x[:-1] << np.uint64(21) | x[1:]
        three = two[:-1] << np.uint64(21) | x[2:]
        parts.append(np.unique(np.concatenate([x, two, three])))
    return (parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))) if letters else np.empty(0, np.uint64)


class Classifier:
    """Nystroem kernel ridge regression; fitted on (lang, gram codes) rows."""

    def __init__(self, samples: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> None:
        self.langs = sorted({lang for lang, _ in samples})
        if not samples:
            return
        by_lang = {lang: [g for x, g in samples if x == lang] for lang in self.langs}  # in order of langs
        each = max(2, landmarks // len(self.langs))
        marks = [g for own in by_lang.values() for g in own[:each]]
        self.vocabulary = np.unique(np.concatenate(marks))
        self.landmarks = np.zeros((len(self.vocabulary), len(marks)), np.float32)
        for k, g in enumerate(marks):
            self.landmarks[np.searchsorted(self.vocabulary, g), k] = 1
        self.norms = np.sqrt([len(g) for g in marks]).astype(np.float32)
        values, vectors = np.linalg.eigh(self.kernel(marks).astype(np.float64))
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        phi = self.kernel([g for _, g in samples]).astype(np.float64) @ root
        y = np.where(np.array([lang for lang, _ in samples])[:, None] == np.array(self.langs)[None], 1.0, -1.0)
        mean, shift = phi.mean(0), y.mean(0)
        weights = np.linalg.solve((phi - mean).T @ (phi - mean) + ridge * len(samples) * np.eye(phi.shape[1]), (phi - mean).T @ (y - shift))
        self.coefficients, self.intercept = root @ weights, shift - mean @ weights
        known, self.least_known = {}, np.empty(len(self.langs))
        for k, (lang, own) in enumerate(by_lang.items()):
            codes, rows = np.unique(np.concatenate(own), return_counts=True)
            need = max(1, len(own) // KNOWN_IN)
            known[lang] = codes[rows >= need]
            by_others = codes[rows > need]
            self.least_known[k] = FAR * max(TYPICAL, np.median([np.isin(g, by_others, assume_unique=True).mean() for g in own]))
        self.known_codes = np.unique(np.concatenate(list(known.values())))
        self.known = np.stack([np.isin(self.known_codes, known[lang], assume_unique=True) for lang in self.langs], 1)

    def familiar(self, g: np.ndarray) -> float:
        """By how much the share of known n-grams exceeds what the nearest language asks for; negative: of no language."""
        i = np.searchsorted(self.known_codes, g)
        i[i == len(self.known_codes)] = 0
        share = self.known[i[self.known_codes[i] == g]].sum(0) / len(g)
        return float((share - self.least_known).max() + SLACK / np.sqrt(len(g)))

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        """Similarity of texts (rows) and landmarks: a batched matrix product."""
        out = np.empty((len(texts), len(self.norms)), np.float32)
        for at in range(0, len(texts), BATCH):
            some = texts[at : at + BATCH]
            x = np.zeros((len(some), len(self.vocabulary)), np.float32)
            for row, g in zip(x, some, strict=True):
                i = np.searchsorted(self.vocabulary, g)
                i[i == len(self.vocabulary)] = 0
                row[i[self.vocabulary[i] == g]] = 1
            out[at : at + BATCH] = x @ self.landmarks / np.sqrt(np.array([max(1, len(g)) for g in some], np.float32))[:, None] / self.norms
        return out

    def predict(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """(language, score from 0 to 1, familiar()) of each text."""
        found = [grams(t) for t in texts]
        if not self.langs:
            return [("und", 0.0, -1.0)] * len(texts)
        values = self.kernel(found).astype(np.float64) @ self.coefficients + self.intercept
        odds = np.exp(SHARPNESS * (values - values.max(1, keepdims=True)))
        best, score = values.argmax(1), 1 / odds.sum(1)
        return [(self.langs[b], float(s), self.familiar(g)) if len(g) else ("und", 0.0, -1.0) for g, b, s in zip(found, best, score, strict=True)]


def _sample_grams(batches):
    for batch in batches:
        codes = [grams(t).view(np.int64) for t in batch.column("text").to_pylist()]
        yield pa.record_batch({"lang": batch.column("lang"), "h": batch.column("h"), "codes": pa.array(codes, pa.list_(pa.int64()))})


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Classifier:
    """A classifier from rows of docs (doc_id, text, lang) outside the held-out fold."""
    ids, text = common.col("doc_id").cast("long"), common.col("text")
    # not \p{L}: the sample's grams decide in the end
    labelled = docs.where((common.id_remainder(common.col("doc_id"), 4) != 2) & common.col("lang").isNotNull() & text.rlike(r"\p{L}"))
    keyed = labelled.select(ids.alias("doc_id"), F.xxhash64(text).alias("tie"), common.col("lang").cast("string").alias("lang"), (F.length(text) > SAMPLE_CHARS).alias("long"))
    keyed = common.table(keyed.withColumn("h", F.xxhash64("doc_id", "tie")), "labelled")
    languages = keyed.select("lang").distinct().count()
    first = Window.partitionBy("lang").orderBy("long", "h")
    picked = keyed.withColumn("n", F.row_number().over(first)).where(F.col("n") <= max(8, train_rows // max(1, languages))).select(F.col("doc_id").alias("d"), "tie", "lang", "h").distinct()
    texts = docs.select(ids.alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), common.col("lang").cast("string").alias("l")).withColumn("t", F.xxhash64("text"))
    # the sample's bound is the broadcast's bound
    chosen = texts.join(F.broadcast(picked), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("tie")) & (F.col("l") == F.col("lang"))).dropDuplicates(["h", "lang"])
    rows = chosen.select("lang", "h", "text").mapInArrow(common.tidy(_sample_grams), "lang string, h long, codes array<bigint>").toArrow().to_pandas().sort_values(["h", "lang"])
    return Classifier([(r.lang, np.asarray(r.codes, np.int64).view(np.uint64)) for r in rows.itertuples() if len(r.codes)])


def _predict(model):
    def run(batches):
        for batch in batches:
            langs, scores, values = [], [], []
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), BATCH):
                for lang, score, value in model.value.predict(texts[at : at + BATCH]):
                    langs.append(lang)
                    scores.append(score)
                    values.append(value)
            columns = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] != "text"] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(values, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [n for n in batch.schema.names if n != "text"] + ["lang_pred", "score", "familiar"])

    return run


def predict(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, tie (hash of the text), held_out, lang_pred, score, familiar of every row of docs (doc_id, text)."""
    common.bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(classifier)
    text = common.text_of()
    rows = docs.select(common.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), (common.id_remainder(common.col("doc_id"), 4) == 2).alias("held_out"), text.alias("text"))
    return rows.mapInArrow(common.tidy(_predict(model)), "doc_id long, tie long, held_out boolean, lang_pred string, score double, familiar double")


def keep_languages(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) without those of no language: `und`, or too few n-grams known to any learned language.

    Null and letterless texts go; of equal rows all go or all stay; without a labelled row all go; an empty table stays
    empty; other columns, whatever their names, pass through.
    """
    found = predict(docs, fit(docs)).where((F.col("lang_pred") == "und") | (F.col("familiar") < 0))
    return common.without(docs, common.table(found.select("doc_id", "tie").distinct(), "no-language"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs)).select("doc_id", "held_out", "lang_pred", "score")
