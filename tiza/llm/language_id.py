"""Language identification by a byte convolutional network.

The network embeds the bytes of a fixed-length window, runs filters of several widths over them, takes each filter's maximum
and feeds those to a softmax. It is trained in numpy on a bounded sample of labelled texts and applied to the windows that
tile each whole text; a text's logits are the mean over its windows. Predictions use the text alone.

For inference, a filter's response is a sum over its bytes, so responses to all byte pairs are tabulated once per task, and
two lookups give the response of a filter up to four bytes wide.

Texts that are null or have no letter get `und` with score 0, as do all texts when nothing is labelled. Very long texts are
judged by all their windows, some at a time. Repeated rows are rows like others, each with its prediction, which equal texts share;
an empty table gives no rows. Of equally likely languages the first by name wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiza.llm.common import table

WINDOW, EMBED, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 16
#: Bounds of the training sample: languages, the most frequent first; documents a language, windows a document, windows in all.
LABELS = 1000
SAMPLE_DOCS, SAMPLE_WINDOWS, SAMPLE_MOST = 600, 4, 20_000
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.003, 7
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
BATCH_WINDOWS = 256


def windows_of(data: bytes) -> np.ndarray:
    """Windows that cover all bytes: one after another, the last ending with the text; short texts are padded with zeros."""
    b = np.frombuffer(data, np.uint8)
    if len(b) <= WINDOW:
        return np.concatenate([b, np.zeros(WINDOW - len(b), np.uint8)])[None]
    whole = b[: len(b) // WINDOW * WINDOW].reshape(-1, WINDOW)
    return whole if len(b) % WINDOW == 0 else np.concatenate([whole, b[-WINDOW:][None]])


class Network:
    """Parameters by name and the labels in their order."""

    def __init__(self, labels: list[str], seed: int = SEED):
        r = np.random.default_rng(seed)
        self.labels = labels
        self.p = {"E": r.normal(0, 0.5, (256, EMBED)).astype("f4")}
        for w in WIDTHS:
            self.p[f"W{w}"] = r.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype("f4")
            self.p[f"b{w}"] = np.zeros(FILTERS, "f4")
        self.p["V"] = r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype("f4")
        self.p["c"] = np.zeros(len(labels), "f4")

    def _step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy; through the maxima they reach one place per filter and window."""
        p, n = self.p, len(x)
        pooled, kept = [], []
        emb = p["E"][x]
        for w in WIDTHS:
            cols = np.lib.stride_tricks.sliding_window_view(emb, w, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - w + 1, w * EMBED)
            z = cols @ p[f"W{w}"]
            at = z.argmax(1)
            top = np.take_along_axis(z, at[:, None], 1)[:, 0] + p[f"b{w}"]
            pooled.append(np.maximum(top, 0))
            kept.append((cols, at, top > 0))
        h = np.concatenate(pooled, 1)
        q = h @ p["V"] + p["c"]
        q = np.exp(q - q.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(n), y] -= 1
        q /= n
        g = {"V": h.T @ q, "c": q.sum(0), "E": np.zeros_like(p["E"])}
        back = q @ p["V"].T
        for k, (w, (cols, at, on)) in enumerate(zip(WIDTHS, kept, strict=True)):
            d = back[:, k * FILTERS : (k + 1) * FILTERS] * on
            picked = cols[np.arange(n)[:, None], at]  # windows x filters x (w * EMBED)
            g[f"W{w}"] = np.einsum("nfk,nf->kf", picked, d)
            g[f"b{w}"] = d.sum(0)
            de = np.einsum("nf,kf->nfk", d, p[f"W{w}"]).reshape(n, FILTERS, w, EMBED)
            for j in range(w):
                np.add.at(g["E"], x[np.arange(n)[:, None], at + j], de[:, :, j])
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Network:
        r, t = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), BATCH):
                t += 1
                rows = order[i : i + BATCH]
                for k, g in self._step(x[rows], y[rows]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype("f4")
        return self

    def tables(self) -> list[tuple[np.ndarray, np.ndarray | None, int]]:
        """For each width: responses to its first two bytes by pair, to the rest by byte or pair, and the rest's length."""
        out = []
        for w in WIDTHS:
            one = [self.p["E"] @ self.p[f"W{w}"].reshape(w, EMBED, FILTERS)[j] for j in range(w)]
            pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
            rest = None if w == 2 else one[2] if w == 3 else pair(one[2], one[3])
            out.append((pair(one[0], one[1]), rest, w - 2))
        return out

    def logits(self, x: np.ndarray, tables: list) -> np.ndarray:
        pairs = (x[:, :-1].astype(np.uint16) << 8) | x[:, 1:]
        pooled = []
        for w, (first, rest, more) in zip(WIDTHS, tables, strict=True):
            z = first.take(pairs if not more else pairs[:, :-more], axis=0)
            if more:
                z += rest.take(x[:, 2:] if more == 1 else pairs[:, 2:], axis=0)
            pooled.append(np.maximum(z.max(1) + self.p[f"b{w}"], 0))
        return np.concatenate(pooled, 1) @ self.p["V"] + self.p["c"]


def sample_windows(labelled: DataFrame, docs: int = SAMPLE_DOCS, windows: int = SAMPLE_WINDOWS, most: int = SAMPLE_MOST) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, label numbers and labels from labelled(key, text, lang); key is a uniform hash that picks the sample.

    About `docs` texts a language, `windows` a text at places that the key sets, `most` windows in all reach the driver."""
    # at most LABELS rows, so texts need no shuffle to meet their language's count
    per = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LABELS)
    chosen = labelled.join(F.broadcast(per), "lang").where(F.col("key") % 1_000_003 < F.lit(float(docs)) / F.col("n") * 1_000_003)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lang, key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if LETTER.search(text):
                    tiles = windows_of(text.encode())
                    picked = np.random.default_rng(key).permutation(len(tiles))[:windows]
                    out += [(lang, key, i, tiles[w].tobytes()) for i, w in enumerate(picked)]
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "key", "i", "data"])

    cuts = chosen.select("lang", "key", "text").mapInArrow(cut, "lang string, key bigint, i int, data binary")
    rows = cuts.orderBy("key", "i", "lang", "data").limit(most).collect()
    labels = sorted({r.lang for r in rows})
    x = np.frombuffer(b"".join(r.data for r in rows), np.uint8).reshape(-1, WINDOW)
    return x, np.array([labels.index(r.lang) for r in rows], np.int64), labels


def train(labelled: DataFrame, **bounds) -> Network | None:
    """A network fitted to labelled(key, text, lang), which has no null text or lang; None if no text has a letter."""
    x, y, labels = sample_windows(labelled, **bounds)
    return Network(labels).fit(x, y) if labels else None


def predict(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): one row for each row of docs, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(network)  # a few thousand parameters

    def judge(text: str, tables: list) -> tuple[str, float]:
        net = shared.value
        x = windows_of(text.encode())
        q = sum(net.logits(x[i : i + BATCH_WINDOWS], tables).sum(0, dtype=np.float64) for i in range(0, len(x), BATCH_WINDOWS)) / len(x)
        q = np.exp(q - q.max())
        best = int(q.argmax())
        return net.labels[best], float(min(1.0, q[best] / q.sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value.tables() if shared.value else None
        for b in batches:
            out = []
            for text in b.column(1):
                text = text.as_py()
                out.append(judge(text, tables) if tables and text and LETTER.search(text) else (UNKNOWN, 0.0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): trained on documents whose fold is not 1, applied to all."""
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    learn = d.where(fold(F.col("doc_id")) != 1).where("text is not null and lang is not null")
    network = train(learn.select(F.crc32(F.concat(F.lit("sample "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("key"), "text", "lang"))
    return predict(d, network).select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
