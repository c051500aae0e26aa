"""Language ID with error-correcting output codes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices

#: Hashed n-gram features, and rows of the training sample in all (at most twice that).
FEATURES = 4096
TRAIN_ROWS = 2000
#: Features are scaled by this in training, against the constant column.
SCALE = 8
#: A decision is ambiguous when the nearest codeword's share is below this.
AMBIGUOUS = 0.6
EXHAUSTIVE = 6
LETTER = regex.compile(r"\p{L}")


def _letters_table() -> np.ndarray:
    """Bytes as the features see them: ASCII that is no letter becomes a space."""
    table = np.arange(256, dtype=np.uint8)
    for b in range(128):
        table[b] = b if chr(b).isalpha() else 32
    return table


TABLE = _letters_table()


def featurise(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte 1-, 2- and 3-grams of the whole text
    in lower case; a vector of length 1."""
    b = TABLE[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8)]
    b = b[np.r_[True, (b[1:] != 32) | (b[:-1] != 32)]].astype(np.uint32)
    counts = np.zeros(FEATURES)
    shift = np.uint32(32 - FEATURES.bit_length() + 1)
    code = b.copy()
    for n in range(3):
        if n:
            code = (code[:-1] << np.uint32(8)) | b[n:]
        hashed = ((code + np.uint32(n << 28)) * np.uint32(0x9E3779B1)) >> shift
        counts += np.bincount(hashed, minlength=FEATURES)
    return np.sqrt(counts / max(1.0, counts.sum()))


def code_matrix(classes: int, seed: int = 0) -> np.ndarray:
    """Codewords of +1 and -1, a row for each class.  Up to EXHAUSTIVE classes every
    split of the classes is a column; beyond, the best of 64 random matrices by the
    smallest distance between two rows, with 8 columns a doubling of the classes."""
    if classes < 2:
        return np.ones((classes, 0))
    if classes <= EXHAUSTIVE:
        columns = range(2 ** (classes - 1) - 1)
        return np.array([[1.0] * len(columns), *[[1.0 if k >> c & 1 else -1.0 for k in columns] for c in range(classes - 1)]])
    draw = np.random.Generator(np.random.PCG64(seed))
    bits = 8 * int(np.ceil(np.log2(classes)))
    best, best_gap = None, -1
    for _ in range(64):
        m = draw.integers(0, 2, (classes, bits)) * 2.0 - 1
        gap = (bits - (m @ m.T - bits * 2 * np.eye(classes)).max()) / 2
        if gap > best_gap and (np.abs(m.sum(axis=0)) < classes).all():
            best, best_gap = m, gap
    return best


def design(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Training matrix of sparse rows (numbers, values): scaled by SCALE, and a last column of ones."""
    x = np.zeros((len(rows), FEATURES + 1), np.float32)
    for line, (at, values) in zip(x, rows):
        line[at] = values.astype(np.float32) * SCALE
        line[-1] = 1
    return x


def fit_bits(x: np.ndarray, signs: np.ndarray, rounds: int = 150, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regressions, one a column of ``signs``, by accelerated gradient steps."""
    w = np.zeros((x.shape[1], signs.shape[1]), x.dtype)
    ahead, t, step = w, 1.0, 1.0 / (0.25 * 65 / 8 + ridge)
    for _ in range(rounds):
        margin = np.clip(signs * (x @ ahead), -30, 30)
        slope = x.T @ (-signs / (1 + np.exp(margin))) / len(x) + ridge * ahead
        new = ahead - step * slope.astype(x.dtype)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + ((t - 1) / t2) * (new - w), new, t2
    return w


class CodeModel:
    """Languages, their codewords, the classifiers, and each bit's weight for each language."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, trust: np.ndarray) -> None:
        self.languages, self.code, self.weights, self.trust = languages, code, weights, trust

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str]) -> CodeModel:
        """Fit on a training matrix (see design).  A bit's weight for a language is how often it is
        right on its training rows, so weights are equal where every bit is learned well."""
        languages = sorted(set(langs))
        code = code_matrix(len(languages))
        own = np.array([languages.index(k) for k in langs], int)
        if not code.shape[1]:
            return cls(languages, code, np.zeros((FEATURES + 1, 0)), np.zeros(code.shape))
        weights = fit_bits(x, code[own].astype(np.float32))
        right = ((x @ weights) * code[own]) > 0
        trust = np.array([right[own == c].mean(axis=0) for c in range(len(languages))])
        weights = weights.astype(float)
        weights[:-1] *= SCALE
        return cls(languages, code, weights, trust)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest language's number, its share): the loss of a codeword is the weighted
        sum of the bits' logistic losses; shares are the losses' soft minimum."""
        if len(self.languages) < 2:
            return np.zeros(len(x), int), np.ones(len(x))
        margin = x @ self.weights[:-1] + self.weights[-1]
        loss = (self.trust[None] * np.logaddexp(0, -self.code[None] * margin[:, None, :])).sum(axis=2)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        return best, share[np.arange(len(x)), best]


def training_rows(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """About ``rows`` labelled rows, as many of each language as far as there are, by a hash of the id;
    what a language with few rows leaves goes to the others."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = sorted((r[0], r[1]) for r in labelled.groupBy("lang").count().collect())
    if not counts:
        return labelled.limit(0)
    scale, share, left = 1 << 30, {}, rows
    for k, (lang, n) in enumerate(sorted(counts, key=lambda c: c[1])):
        share[lang] = min(n, left / (len(counts) - k))
        left -= share[lang]
    limits = [F.lit(x) for lang, n in counts for x in (lang, min(scale, int(scale * share[lang] / n)))]
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(scale))
    return labelled.where(drawn < F.create_map(*limits)[F.col("lang")])


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> CodeModel | None:
    """Fit on a bounded sample of (doc_id, text, lang); None without labelled rows."""

    names = ["lang", "at", "x"]

    def features(batches):
        for batch in batches:
            out = []
            for part in slices(batch):
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if LETTER.search(text):
                        x = featurise(text)
                        at = np.flatnonzero(x).astype(np.uint16)
                        out.append((lang, at.tobytes(), x[at].astype(np.float16).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, (pa.string(), pa.binary(), pa.binary()))], names=names)

    sample = training_rows(docs, rows).select("text", "lang").mapInArrow(features, "lang string, at binary, x binary")
    bounded = sample.orderBy(F.xxhash64("lang", "at", "x"), "lang", "at", "x").limit(2 * rows)  # ids that repeat may exceed it
    got = sorted((r.lang, bytes(r.at), bytes(r.x)) for r in bounded.collect())
    if not got:
        return None
    return CodeModel.fit(design([(np.frombuffer(a, np.uint16), np.frombuffer(x, np.float16)) for _, a, x in got]), [lang for lang, _, _ in got])


NAMES = ("lang_pred", "score", "ambiguous")


def predict(docs: DataFrame, model: CodeModel | None, keep: list[str] | None = None, text_col: str = "text", names: tuple = NAMES) -> DataFrame:
    """Columns ``keep`` of ``docs`` with the language, its share (0 to 1) and whether it is ambiguous,
    as ``names``; a kept column of such a name gives way.

    A null text, one without any letter, and every text where nothing was learned get
    ``und`` with score 0.  Every row is predicted from its whole text alone.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    read = docs.select(*keep) if text_col in keep else docs.select(*keep, text_col)
    at = read.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch, 512):
                texts = part.column(at).to_pylist()
                good = [i for i, t in enumerate(texts) if model is not None and t and LETTER.search(t)]
                lang, score = ["und"] * len(texts), np.zeros(len(texts))
                if good:
                    best, share = model.decode(np.stack([featurise(texts[i]) for i in good]))
                    for i, b in zip(good, best):
                        lang[i] = model.languages[b]
                    score[good] = share
                new = [pa.array(lang, pa.string()), pa.array(score), pa.array(score < AMBIGUOUS)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *new], names=[*keep, *names])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[: len(keep)]]
    kinds = [f"`{n}` {k}" for n, k in zip(names, ("string", "double", "boolean"))]
    return read.mapInArrow(run, ", ".join([*fields, *kinds]))


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, keep: list[str] | None = None, rows: int = TRAIN_ROWS, names: tuple = NAMES, held: str = "held_out") -> DataFrame:
    """Learn from the rows of ``docs`` (doc_id, text, lang) that are not held out, then
    predict every row; adds ``held`` and the columns of ``names`` (see predict).

    Rows with a null id are never held out nor learned from.
    """
    learn = docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    keep = [c for c in (docs.columns if keep is None else keep) if c != held]
    return predict(docs.withColumn(held, held_out()), fit(learn, rows), [*keep, held], names=names)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return identify(docs, ["doc_id"])
