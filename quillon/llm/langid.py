"""Language identification in two steps: the family, then the language within it.

Whole texts become counts of hashed byte n-grams (1 to 3 bytes, letters only), square-rooted and scaled
to length 1. Linear support vector machines (squared hinge, dual coordinate descent) are trained
on the driver from a bounded sample: one for each pair of families, and one for each pair of
languages of a family. A text's family is the one with most wins, then its language among the
family's; the score is the least certain of the wins that decided (0 to 1).

Defined cases: a text that is null or has no letter is "und" with score 0; without rows to learn
from every text is; rows without lang or text are not learned from; a null doc_id isn't held out;
repeated rows are predicted alike; an empty table gives no rows; other columns are ignored; texts are taken
whole, long ones in pieces; bytes that aren't UTF-8 count as no letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import decoded, fresh, release

#: Features, and the most rows that are learned from in all.
DIM, TRAIN_ROWS = 4096, 4000
#: Bytes of text that are worked on together.
PIECE = 2 << 20

# Language families by ISO 639-1 code. Any other language is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "nb", "nn", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "uralic": ("et", "fi", "hu"),
    "semitic": ("ar", "he", "mt"),
    "dravidian": ("kn", "ml", "ta", "te"),
}
_FAMILY = {code: f for f, codes in FAMILIES.items() for code in codes}


def family(lang: str) -> str:
    return _FAMILY.get(lang.split("-")[0].lower(), lang)


_TABLE = np.full(256, 32, dtype=np.uint8)
_TABLE[128:] = np.arange(128, 256)
_TABLE[97:123] = np.arange(97, 123)
_TABLE[65:91] = np.arange(97, 123)


def _counts(raw: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Counts of hashed n-grams; raw: mapped bytes, rows: the text that each belongs to."""
    x = raw.astype(np.uint32)
    base = rows.astype(np.int64) * DIM
    out = np.zeros(n * DIM)
    gram = x
    for j in range(3):
        if j:
            gram = gram[:-1] * np.uint32(257) + x[j:]
        h = (gram * np.uint32(2654435761) + np.uint32(j * 97)) >> np.uint32(20)
        same = rows[: len(gram)] == rows[j:] if j else slice(None)
        out += np.bincount((base[: len(gram)] + h)[same], minlength=n * DIM)
    return out.reshape(n, DIM)


def features(texts: list[str]) -> np.ndarray:
    """One row of DIM features for each text."""
    out = np.zeros((len(texts), DIM), dtype=np.float32)
    raws = [_TABLE[np.frombuffer((t or "").encode("utf-8", "replace"), dtype=np.uint8)] for t in texts]
    at = 0
    while at < len(raws):
        stop, size = at, 0
        while stop < len(raws) and stop - at < 256 and (stop == at or size + len(raws[stop]) <= PIECE):
            size += len(raws[stop])
            stop += 1
        if size > PIECE:  # one long text, in pieces that overlap by two bytes
            got = np.zeros((1, DIM))
            for i in range(0, size, PIECE):
                piece = raws[at][i : i + PIECE + 2]
                got += _counts(piece, np.zeros(len(piece), dtype=np.int64), 1)
        else:
            got = _counts(np.concatenate(raws[at:stop]), np.repeat(np.arange(stop - at), [len(r) for r in raws[at:stop]]), stop - at)
        got[:, (32 * 2654435761 % 2**32) >> 20] = 0  # blanks alone
        got = np.sqrt(got)
        out[at:stop] = got / np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-9)
        at = stop
    return out


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 12) -> np.ndarray:
    """Weights (the last: bias) of a linear machine with squared hinge loss; y: +1 or -1. Either
    side counts the same in all."""
    share = np.where(y > 0, (y < 0).sum(), (y > 0).sum()) * 2 / len(y)
    shift = 0.5 / (c * np.maximum(share, 1e-3))
    w, bias, alpha, norm = np.zeros(x.shape[1]), 0.0, np.zeros(len(x)), np.einsum("ij,ij->i", x, x, dtype=np.float64) + 1 + shift
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            grad = y[i] * (x[i] @ w + bias) - 1 + shift[i] * alpha[i]
            new = max(0.0, alpha[i] - grad / norm[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                bias += (new - alpha[i]) * y[i]
                alpha[i] = new
    return np.append(w, bias)


def fit(x: np.ndarray, langs: list[str]) -> dict:
    """The machines: {"families": {family: [lang]}, "pairs": {(a, b): weights}}; in a pair, a > 0."""
    names, codes = sorted(set(langs)), np.array(langs)
    families: dict[str, list[str]] = {}
    for name in names:
        families.setdefault(family(name), []).append(name)
    of_family = np.array([family(v) for v in langs])
    pairs = {("family", *p): svm(x[m], np.where(of_family[m] == p[0], 1.0, -1.0)) for p in combinations(sorted(families), 2) for m in [np.isin(of_family, p)]}
    for members in families.values():
        pairs |= {("lang", *p): svm(x[m], np.where(codes[m] == p[0], 1.0, -1.0)) for p in combinations(members, 2) for m in [np.isin(codes, p)]}
    return {"families": families, "pairs": pairs}


def _vote(x: np.ndarray, names: list[str], kind: str, pairs: dict) -> tuple[np.ndarray, np.ndarray]:
    """For each row the place in names with most wins (ties: the largest sum of margins) and the
    certainty of its least certain comparison."""
    wins, sums = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
    least = np.ones((len(x), len(names)))
    for (i, a), (j, b) in combinations(enumerate(names), 2):
        w = pairs[kind, a, b]
        d = x @ w[:-1] + w[-1]
        p = 1 / (1 + np.exp(-np.clip(3 * d, -30, 30)))
        wins[:, i] += d >= 0
        wins[:, j] += d < 0
        sums[:, i] += np.clip(d, -1, 1)
        sums[:, j] -= np.clip(d, -1, 1)
        least[:, i] = np.minimum(least[:, i], p)
        least[:, j] = np.minimum(least[:, j], 1 - p)
    best = np.argmax(wins + sums / (10.0 * len(names) + 10), axis=1)
    return best, least[np.arange(len(x)), best]


def predict(model: dict, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The language of each text, and its score."""
    has = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], dtype=bool)
    langs, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
    if not model["families"] or not has.any():
        return langs.tolist(), score
    x = features([t for t, h in zip(texts, has, strict=True) if h])
    names = sorted(model["families"])
    fam, sure = _vote(x, names, "family", model["pairs"])
    got = np.full(len(x), "und", dtype=object)
    for i, name in enumerate(names):
        m = fam == i
        if m.any():
            members = model["families"][name]
            best, p = _vote(x[m], members, "lang", model["pairs"])
            got[m], sure[m] = np.array(members, dtype=object)[best], np.minimum(sure[m], p)
    langs[has], score[has] = got, sure
    return langs.tolist(), score


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            x = features(decoded(part.column(1))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """Learns from docs (text, lang and a sampling number in [0, 1), named draw). At most about
    train_rows rows, the same number for each language, those with the lowest draws."""
    docs = docs.filter("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return {"families": {}, "pairs": {}}
    each = max(1, train_rows // len(counts))
    cut = F.create_map(*[v for lang, n in counts.items() for v in (F.lit(lang), F.lit(min(1.0, each / n)))])
    rows = docs.filter(F.col("draw") < cut[F.col("lang")]).select("lang", "text").mapInArrow(_featured, "lang string, x binary").toArrow()
    if not rows.num_rows:
        return {"families": {}, "pairs": {}}
    langs, x = rows.column("lang").to_pylist(), np.empty((rows.num_rows, DIM), dtype=np.float32)
    for i, b in enumerate(rows.column("x")):
        x[i] = np.frombuffer(b.as_buffer(), dtype=np.float16)
    del rows
    return fit(x, langs)


def _predictor(shared, text_at: int, drop_text: bool, new: tuple[str, str]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                langs, score = predict(model, decoded(part.column(text_at)))
                kept = [j for j in range(part.num_columns) if j != text_at or not drop_text]
                yield pa.RecordBatch.from_arrays([*[part.column(j) for j in kept], pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[*[part.schema.names[j] for j in kept], *new])

    return of


def with_language(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, drop_text: bool = False, new: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and the score as columns of the new names, which docs mustn't have. learn: the rows
    that may be learned from."""
    if fresh(docs, *new) != list(new):
        raise ValueError(f"the table has a column {new[0]} or {new[1]} already")
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), text_col), F.lit(1 << 30)) / float(1 << 30)
    model = train(docs.filter(learn).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), draw.alias("draw")), train_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [f for f in docs.schema if f.name != text_col or not drop_text]
    schema = T.StructType([*kinds, T.StructField(new[0], T.StringType()), T.StructField(new[1], T.DoubleType())])
    return docs.mapInArrow(_predictor(shared, docs.columns.index(text_col), drop_text, new), schema)


def held_out(id_col: str = "doc_id", folds: int = 3, held: int = 1) -> Column:
    """Whether crc32(id as text) mod folds is held; a null id isn't held out."""
    fold = F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(folds))
    return F.coalesce(fold == held, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document. Those held out are not learned from."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, folds, held).alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    out = with_language(rows, ~F.col("held_out"), "doc_id", "text", "lang", train_rows, drop_text=True)
    return out.select("doc_id", "held_out", "lang_pred", "score")
