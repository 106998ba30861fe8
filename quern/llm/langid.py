"""Language identification by error-correcting output codes.

Each language has a codeword. For each of its bits a binary classifier over hashed byte n-grams says
on which side a text lies; loss-weighted decoding takes the language whose codeword the bits
violate least, and flags texts for which the second codeword is about as near.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import named
from .tokens import text_runs

_GRAMS = (3, 4)
_TABLE_BITS = 15  # values of the hash of each gram size
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B)
_LETTERS_ONLY = bytes(b | 0x20 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_FEATURES = len(_GRAMS) << _TABLE_BITS


def codewords(languages: int, seed: int = 11) -> np.ndarray:
    """Codeword (+1, -1) of each language, a row each: all splits for up to 6 languages, else random ones.

    Up to 6 languages: the exhaustive code, which has 2**(n-1) - 1 bits and distance 2**(n-2). More:
    the best of many random codes of about 10 log2(n) bits, by its least distance.
    """
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 6:
        bits = np.array([[(column >> k) & 1 for column in range(1, 1 << (languages - 1))] for k in range(languages - 1)])
        return np.vstack([np.ones(bits.shape[1]), np.where(bits, -1.0, 1.0)])
    rng = np.random.default_rng(seed)
    width = int(np.ceil(10 * np.log2(languages)))
    best, least = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(languages, width))
        apart = (width - code @ code.T) / 2 + np.eye(languages) * width
        if apart.min() > least and (np.abs(code.sum(axis=0)) < languages).all():
            best, least = code, apart.min()
    return best


def _gram_indices(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table index of the 3-gram and the 4-gram that begin at each byte (both at the last but three)."""
    b = data.astype(np.uint32)
    three = b[:-3] | (b[1:-2] << np.uint32(8)) | (b[2:-1] << np.uint32(16))
    four = three | (b[3:] << np.uint32(24))
    shift = np.uint32(32 - _TABLE_BITS)
    return (three * np.uint32(_MULTIPLIERS[0])) >> shift, ((four * np.uint32(_MULTIPLIERS[1])) >> shift) + np.uint32(1 << _TABLE_BITS)


def _joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, each between spaces and ending in four of them, and where each begins."""
    parts = [b" " + (t or "").encode().translate(_LETTERS_ONLY) + b"    " for t in texts]
    starts = np.cumsum([0, *[len(p) for p in parts[:-1]]])
    return np.frombuffer(b"".join(parts), np.uint8), starts


def gram_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of all features over some texts together; grams of spaces alone count nothing."""
    total = np.zeros(_FEATURES, np.int64)
    for low, high in text_runs(texts):
        data, _ = _joined(texts[low:high])
        for index in _gram_indices(data):
            total += np.bincount(index, minlength=_FEATURES)
    return total


def _blank_features() -> list[int]:
    return [int(i[0]) for i in _gram_indices(np.full(4, 32, np.uint8))]


@dataclass
class LanguageCodes:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    scale: np.ndarray  # of each bit's classifier
    trust: np.ndarray  # weight of each bit in decoding

    @classmethod
    def fit(cls, docs: DataFrame, text_col="text", lang_col="lang", sample_per_language: int = 4000, smoothing: float = 0.5, seed: int = 5) -> LanguageCodes:
        """Learn from rows with text and language, at most about sample_per_language of each.

        The sample is spread by hash of the text and counted on the executors; the driver sees one
        row for each (language, feature), and half of the sample's languages and bit values.
        """
        rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
        sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
        languages = sorted(sizes)
        code = codewords(len(languages))
        place = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30))
        bound = F.coalesce(*[F.when(F.col("lang") == name, F.lit(int(min(1.0, sample_per_language / sizes[name]) * (1 << 30)))) for name in languages]) if languages else F.lit(0)
        sample = rows.where(place < bound).withColumn("fit", (place % 2 == 0).cast("int"))

        def counted(batches):
            held: dict[str, np.ndarray] = {}
            for batch in batches:
                langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
                for name in set(langs.tolist()):
                    held[name] = held.get(name, 0) + gram_counts([texts[k] for k in np.flatnonzero(langs == name)])
            for name, counts in held.items():
                used = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(used)), pa.array(used), pa.array(counts[used])], names=["lang", "feature", "n"])

        grams = sample.where("fit = 1").select("lang", "text").mapInArrow(counted, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
        counts = np.zeros((len(languages), _FEATURES))
        at = {name: k for k, name in enumerate(languages)}
        for r in grams.collect():
            counts[at[r["lang"]], r["feature"]] = r["n"]
        counts[:, _blank_features()] = 0
        share = (counts + smoothing) / (counts + smoothing).sum(axis=1, keepdims=True)
        weights = np.zeros((_FEATURES, code.shape[1]), np.float32)
        for bit in range(code.shape[1]):
            yes, no = code[:, bit] > 0, code[:, bit] < 0
            if yes.any() and no.any():
                weights[:, bit] = np.log(share[yes].mean(axis=0)) - np.log(share[no].mean(axis=0))
        weights[_blank_features()] = 0
        model = cls(languages, code, weights, np.ones(code.shape[1]), np.ones(code.shape[1]))
        model._calibrate(sample.where("fit = 0").select("lang", "text"))
        return model

    def _calibrate(self, held: DataFrame) -> None:
        """Scale each bit so that its margins on the other half have a typical size of 3; trust it by how often it is right."""
        code = self.code
        spark = held.sparkSession
        sent = spark.sparkContext.broadcast(self.weights)
        at = {name: k for k, name in enumerate(self.languages)}

        def summed(batches):
            for batch in batches:
                margin = bit_margins(batch.column(1).to_pylist(), sent.value)
                signed = margin * code[[at[x] for x in batch.column(0).to_pylist()]]
                rows = [np.arange(margin.shape[1]), np.full(margin.shape[1], len(margin)), np.abs(signed).sum(axis=0), (signed > 0).sum(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array(r.astype(k)) for r, k in zip(rows, (np.int64, np.int64, np.float64, np.int64), strict=True)], names=["bit", "n", "size", "right"])

        found = held.mapInArrow(summed, "bit long, n long, size double, right long").groupBy("bit").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.sum("right").alias("right"))
        for r in found.collect():
            if r["n"] and r["size"]:
                self.scale[r["bit"]] = 3 * r["n"] / r["size"]
                self.trust[r["bit"]] = max(0.05, 2 * r["right"] / r["n"] - 1)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its score and the loss by which the second is farther."""
        z = margins * self.scale
        loss = np.stack([(self.trust * np.logaddexp(0, -word * z)).sum(axis=1) for word in self.code], axis=1) / self.trust.sum() * self.code.shape[1]
        nearest = loss.argmin(axis=1)
        first = loss[np.arange(len(loss)), nearest]
        score = 1 / np.exp(first[:, None] - loss).sum(axis=1)
        rest = loss.copy()
        rest[np.arange(len(loss)), nearest] = np.inf
        return nearest, score, rest.min(axis=1, initial=np.inf) - first


def bit_margins(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """Mean log-odds of each bit over the n-grams of each whole text."""
    out = []
    for low, high in text_runs(texts, 500_000):
        data, starts = _joined(texts[low:high])
        three, four = _gram_indices(data)
        value = weights[three]
        value += weights[four]
        lengths = np.diff(np.append(starts, len(data)))
        out.append(np.add.reduceat(value, starts, axis=0) / lengths[:, None])
    return np.concatenate(out) if out else np.zeros((0, weights.shape[1]))


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def predict_languages(docs: DataFrame, codes: LanguageCodes, text_col="text", ambiguous_below: float = 0.2, names=("lang_pred", "score", "ambiguous")) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous added, under these or other names.

    lang_pred is a learned language, or `und` (score 0) where the text is null or has no letter or
    nothing was learned. ambiguous: `und`, or the second codeword is nearer than ambiguous_below in
    loss. Only the text is an input of a prediction; columns of docs with those names, in any case, are replaced.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(codes)
    columns = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    at = columns.index(text_col)

    def predicted(batches):
        codes = sent.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            known = np.array([_has_letter(t) for t in texts], bool) & (len(codes.languages) > 0)
            told, scores, unsure = np.array(["und"] * len(texts), object), np.zeros(len(texts)), np.ones(len(texts), bool)
            if known.any():
                nearest, score, lead = codes.decode(bit_margins([t for t, k in zip(texts, known, strict=True) if k], codes.weights))
                told[known], scores[known], unsure[known] = np.array(codes.languages, object)[nearest], score, lead < ambiguous_below
            made = [pa.array(told.tolist(), pa.string()), pa.array(scores), pa.array(unsure)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*columns, *names])

    given = docs.select(*[named(c) for c in columns])
    schema = given.schema
    for name, kind in zip(names, ("string", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    # numbered, as not every name can be passed to a worker
    return given.toDF(*[f"c{k}" for k in range(len(columns))]).mapInArrow(predicted, schema)
