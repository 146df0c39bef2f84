"""Language identification with a byte convolutional network, trained in numpy.

A window is WINDOW bytes of a text. Bytes have learned vectors; filters of several
widths slide over them; each filter's maximum over the window goes through a
rectifier into a softmax over the languages. Training takes windows from a
bounded sample of labelled documents. A text's windows cover all of it; their
probabilities are averaged by their numbers of letters.

For prediction, vectors and filters are multiplied out into tables by byte and
by pair of bytes, so that a filter of any width is a few table rows added up.

Defined cases: null texts and texts without a letter are `und` with score 0;
the `most` most frequent languages are learned (a bound of 3000 by default);
without learned languages all texts are; a null doc_id is not held out and not
learned from; equal probabilities go to the first language in order; repeated
rows are predicted each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.textcore import slices, text_buffer
from reelspark.session import ship

WINDOW, WIDTHS, FILTERS, VECTOR = 256, (2, 3, 4), 16, 8
SAMPLE_DOCS, WINDOWS_PER_DOC, STEPS, BATCH, SEED = 3000, 4, 400, 64, 42
LEARNED_FROM = 4  # shares of documents by checksum; the third is held out
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[9, 10, 11, 12, 13]] = 32
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % LEARNED_FROM == 2, F.lit(False))


class Network:
    """Parameters by name, and the languages in order."""

    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.w = {"vector": rng.normal(0, 0.3, (256, VECTOR))}
        for k in WIDTHS:
            self.w[f"filter{k}"] = rng.normal(0, (k * VECTOR) ** -0.5, (k * VECTOR, FILTERS))
            self.w[f"bias{k}"] = np.zeros(FILTERS)
        self.w["out"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages)))
        self.w["out_bias"] = np.zeros(len(languages))
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy of windows x with languages y."""
        w, n = self.w, len(x)
        seen = w["vector"][x]
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        pooled, where = [], {}
        patches = {}
        for k in WIDTHS:
            m = x.shape[1] - k + 1
            patches[k] = np.concatenate([seen[:, j : j + m] for j in range(k)], axis=2)
            z = patches[k] @ w[f"filter{k}"]
            where[k] = z.argmax(1)
            pooled.append(np.take_along_axis(z, where[k][:, None], 1)[:, 0] + w[f"bias{k}"])
        top = np.concatenate(pooled, axis=1)
        act = np.maximum(top, 0)
        p = _softmax(act @ w["out"] + w["out_bias"])
        p[np.arange(n), y] -= 1
        p /= n
        grad["out"], grad["out_bias"] = act.T @ p, p.sum(0)
        back = (p @ w["out"].T) * (top > 0)
        for i, k in enumerate(WIDTHS):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            best = np.take_along_axis(patches[k], where[k][:, :, None], 1)  # (n, filters, k * vector)
            grad[f"filter{k}"] = np.einsum("nf,nfd->df", g, best)
            grad[f"bias{k}"] = g.sum(0)
            to = g[:, :, None] * w[f"filter{k}"].T[None]
            for j in range(k):
                np.add.at(grad["vector"], x[np.arange(n)[:, None], where[k] + j], to[:, :, j * VECTOR : (j + 1) * VECTOR])
        return grad

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for t in range(1, steps + 1):
            pick = rng.integers(0, len(x), BATCH)
            rate = 0.01 * (1 - t / (steps + 1))
            for k, g in self.step(x[pick], y[pick]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.w[k] -= (rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self

    def tables(self) -> dict:
        """Sums of a filter's parts by byte (odd widths' last) and by pair of bytes."""
        w, out = self.w, {}
        for k in WIDTHS:
            by_byte = [w["vector"] @ w[f"filter{k}"][j * VECTOR : (j + 1) * VECTOR] for j in range(k)]
            pairs = [(by_byte[j][:, None] + by_byte[j + 1][None]).reshape(65536, FILTERS) for j in range(0, k - 1, 2)]
            out[k] = (pairs, by_byte[-1] if k % 2 else None)
        return out

    def probabilities(self, x: np.ndarray, tables: dict) -> np.ndarray:
        pair = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        pooled = []
        for k, (pairs, single) in tables.items():
            m = x.shape[1] - k + 1
            z = pairs[0][pair[:, :m]]
            for j, table in enumerate(pairs[1:], 1):
                z += table[pair[:, 2 * j : 2 * j + m]]
            if single is not None:
                z += single[x[:, k - 1 :]]
            pooled.append(z.max(1) + self.w[f"bias{k}"])
        return _softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ self.w["out"] + self.w["out_bias"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts of a column (the last of each padded with zeros), their rows and numbers of letters."""
    data, offsets = text_buffer(column)
    sizes = np.diff(offsets)
    per = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), per)
    begin = (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * WINDOW + np.repeat(offsets[:-1], per)
    size = np.minimum(WINDOW, np.repeat(offsets[1:], per) - begin)
    raw, letters = np.zeros((len(row), WINDOW), np.uint8), np.zeros(len(row), np.int64)
    place = np.arange(WINDOW)
    for k in range(0, len(row), 4096):
        there = place < size[k : k + 4096, None]
        some = raw[k : k + 4096]
        some[there] = data[(begin[k : k + 4096, None] + place)[there]]
        letters[k : k + 4096] = LETTER[some].sum(1)
        some[:] = FOLD[some]
    return raw, row, letters


def sample(docs: DataFrame, most: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, and windows with their languages from at most 2 * most documents, about as many of each language."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = rows.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()}  # a row for each language
    languages = sorted(counts)
    if not languages:
        return [], np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64)
    share = F.create_map(*(F.lit(v) for lang in languages for v in (lang, min(1.0, most / len(languages) / counts[lang]))))
    taken = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                x, row, letters = windows(batch.column(1))
                keep = []
                for k in range(batch.num_rows):
                    own = np.flatnonzero((row == k) & (letters > 0))
                    keep += own[np.linspace(0, len(own) - 1, min(len(own), WINDOWS_PER_DOC)).astype(int)].tolist() if len(own) else []
                raw = [x[i].tobytes() for i in keep]
                yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(row[keep], pa.int64())), pa.array(raw, pa.binary())], names=["lang", "bytes"])

    got = taken.mapInArrow(run, "lang string, bytes binary").orderBy(F.xxhash64("lang", "bytes"), "lang", "bytes").limit(2 * most * WINDOWS_PER_DOC).collect()
    got = sorted((r["lang"], bytes(r["bytes"])) for r in got)
    place = {lang: k for k, lang in enumerate(languages)}
    x = np.frombuffer(b"".join(b for _, b in got), np.uint8).reshape(-1, WINDOW)
    return languages, x, np.array([place[lang] for lang, _ in got], np.int64)


def train(docs: DataFrame, most: int = SAMPLE_DOCS) -> Network | None:
    languages, x, y = sample(docs, most)
    return Network(languages).train(x, y) if len(x) else None


def _has_letter(column: pa.Array, ascii_letter: np.ndarray) -> np.ndarray:
    out = ascii_letter.copy()
    for k in np.flatnonzero(~out):
        out[k] = any(c.isalpha() for c in column[k].as_py() or "")
    return out


def predict(docs: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    network = train(docs, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables() if network else None
        names = pa.array([*(network.languages if network else []), "und"])
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                n = batch.num_rows
                best, score = np.full(n, len(names) - 1), np.zeros(n)
                if network:
                    x, row, letters = windows(batch.column(2))
                    total, weight = np.zeros((n, len(names) - 1)), np.zeros(n)
                    for at in range(0, len(x), 1024):
                        p = network.probabilities(x[at : at + 1024], tables)
                        np.add.at(total, row[at : at + 1024], p * letters[at : at + 1024, None])
                        np.add.at(weight, row[at : at + 1024], letters[at : at + 1024])
                    plain = np.zeros(n, bool)
                    lower = (x >= 97) & (x <= 122)
                    np.logical_or.at(plain, row, lower.any(1))
                    known = _has_letter(batch.column(2), plain) & (weight > 0)
                    best[known] = total[known].argmax(1)
                    score[known] = total[known].max(1) / weight[known]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names.take(pa.array(best)), pa.array(np.clip(score, 0, 1))], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
