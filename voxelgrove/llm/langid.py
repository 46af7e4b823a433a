"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of bytes, gives every position a language distribution from both directions, and a
document's probabilities are the mean over all its positions. It is trained in numpy by backpropagation
through time on a bounded sample: PER_LANG texts of each language, WINDOWS stretches of each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import part_of, text_batches

HIDDEN = 8
#: The bounds of the training sample and the training's length.
PER_LANG, MAX_LANGS, WINDOWS, SPAN, EPOCHS, BATCH = 160, 200, 3, 64, 14, 128
#: Bytes of a window and windows of a batch, when documents are read.
STEP, LANES = 128, 1024
_LETTER = re.compile(r"[^\W\d_]")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class ByteBiGRU:
    """z, r = gates; n = tanh(x + r * (U h)); h' = (1 - z) n + z h, once in each direction."""

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.classes, self.h = classes, hidden
        self.p = {}
        for d in "fb":
            self.p["E" + d] = rng.normal(0, 0.3, (256, 3 * hidden))
            self.p["U" + d] = rng.normal(0, 0.4 / np.sqrt(hidden), (hidden, 3 * hidden))
            self.p["W" + d] = rng.normal(0, 0.3, (hidden, len(classes)))
        self.p["b"] = np.zeros(len(classes))

    def _forward(self, x: np.ndarray, d: str) -> list[tuple]:
        hid, h, out = self.h, np.zeros((x.shape[1], self.h)), []
        for t in range(len(x)):
            e, u = self.p["E" + d][x[t]], h @ self.p["U" + d]
            z, r = sigmoid(e[:, :hid] + u[:, :hid]), sigmoid(e[:, hid : 2 * hid] + u[:, hid : 2 * hid])
            n = np.tanh(e[:, 2 * hid :] + r * u[:, 2 * hid :])
            out.append((h, z, r, n, u[:, 2 * hid :]))
            h = (1 - z) * n + z * h
        out.append((h,))
        return out

    def loss_and_grads(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions; x: (time, batch) bytes, y: (batch) classes."""
        steps, batch = x.shape
        runs = {"f": self._forward(x, "f"), "b": self._forward(x[::-1], "b")}
        hf = np.stack([s[0] for s in runs["f"][1:]])
        hb = np.stack([s[0] for s in runs["b"][1:]])[::-1]
        logits = hf @ self.p["Wf"] + hb @ self.p["Wb"] + self.p["b"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        loss = -np.log(prob[:, np.arange(batch), y] + 1e-30).mean()
        dl = prob
        dl[:, np.arange(batch), y] -= 1
        dl /= steps * batch
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["b"] = dl.sum(axis=(0, 1))
        for d, hs, xs, grad in (("f", hf, x, dl), ("b", hb[::-1], x[::-1], dl[::-1])):
            g["W" + d] = np.einsum("tbh,tbk->hk", hs, grad)
            into, dh = grad @ self.p["W" + d].T, np.zeros((batch, self.h))
            for t in range(steps - 1, -1, -1):
                h, z, r, n, un = runs[d][t]
                dh = dh + into[t]
                dn, dz = dh * (1 - z) * (1 - n * n), dh * (h - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                du = np.concatenate([dz, dr, dn * r], axis=1)
                np.add.at(g["E" + d], xs[t], np.concatenate([dz, dr, dn], axis=1))
                g["U" + d] += h.T @ du
                dh = dh * z + du @ self.p["U" + d].T
        return float(loss), g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = 0.02, seed: int = 5) -> float:
        """Adam; x: (windows, time) bytes. Gives back the last loss."""
        rng, loss, step = np.random.default_rng(seed), 0.0, 0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(order), batch):
                some = order[s : s + batch]
                loss, g = self.loss_and_grads(x[some].T, y[some])
                step += 1
                for k, a in g.items():
                    m[k], v[k] = 0.9 * m[k] + 0.1 * a, 0.99 * v[k] + 0.01 * a * a
                    self.p[k] -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return loss

    def reader(self) -> dict[str, np.ndarray]:
        """Weights as predict() takes them: float32, features first, gates halved for tanh."""
        half = np.repeat([0.5, 0.5, 1.0], self.h)
        out = {"b": self.p["b"].astype(np.float32)[:, None]}
        for d in "fb":
            out["E" + d] = np.ascontiguousarray((self.p["E" + d] * half).T.astype(np.float32))
            out["U" + d] = np.ascontiguousarray((self.p["U" + d] * half).T.astype(np.float32))
            out["W" + d] = np.ascontiguousarray(self.p["W" + d].T.astype(np.float32))
        return out


def _sweep(w: dict[str, np.ndarray], d: str, x: np.ndarray, valid: np.ndarray | None) -> np.ndarray:
    """States (time, hidden, lanes) after each byte of x (time, lanes), in the order of d."""
    hid = len(w["E" + d]) // 3
    out = np.empty((len(x), hid, x.shape[1]), np.float32)
    h = np.zeros((hid, x.shape[1]), np.float32)
    for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
        e = np.take(w["E" + d], x[t], axis=1)
        u = w["U" + d] @ h
        e[: 2 * hid] += u[: 2 * hid]
        g = np.tanh(e[: 2 * hid])
        g += 1
        n = e[2 * hid :]
        g *= 0.5
        u[2 * hid :] *= g[hid:]
        n += u[2 * hid :]
        np.tanh(n, out=n)
        h = n + g[:hid] * (h - n)
        if valid is not None and not valid[t].all():
            h *= valid[t]
        out[t] = h
    return out


def predict(w: dict[str, np.ndarray], texts: list[bytes]) -> np.ndarray:
    """(texts, classes): class probabilities of each text, the mean over the positions of all its windows."""
    k = len(w["b"])
    total, sizes = np.zeros((len(texts), k)), np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), -(-sizes // STEP))
    lane_at = np.concatenate([np.arange(0, n, STEP) for n in sizes if n]) if sizes.sum() else np.empty(0, np.int64)
    for s in range(0, len(owner), LANES):
        own, at = owner[s : s + LANES], lane_at[s : s + LANES]
        left = np.minimum(STEP, sizes[own] - at)
        x = np.zeros((len(own), STEP), np.uint8)
        for i, (o, a, n) in enumerate(zip(own.tolist(), at.tolist(), left.tolist())):
            x[i, :n] = np.frombuffer(texts[o], np.uint8, n, a)
        x = np.ascontiguousarray(x.T)
        valid = np.arange(STEP)[:, None] < left
        hf, hb = _sweep(w, "f", x, None), _sweep(w, "b", x, valid.astype(np.float32))
        sums = np.zeros((k, len(own)))
        for t in range(STEP):
            logits = w["Wf"] @ hf[t]
            logits += w["Wb"] @ hb[t]
            logits += w["b"]
            np.exp(logits, out=logits)
            logits *= valid[t] / logits.sum(axis=0)
            sums += logits
        for c in range(k):
            total[:, c] += np.bincount(own, sums[c], len(texts))
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-30)


def training_sample(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, windows, classes): PER_LANG texts of each language by a hash of the id, WINDOWS stretches of each.

    Every labelled text with a letter can be drawn, however short; a stretch of fewer than SPAN bytes is repeated.

    Each task keeps its own first PER_LANG of a language before the shuffle, so no language gathers in one
    task, and at most MAX_LANGS * PER_LANG * WINDOWS * SPAN characters reach the driver: a sample of more is an error."""
    ok = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike("\\p{L}"))
    piece = [F.substr(F.col(text_col), (F.pmod(F.xxhash64(id_col, F.lit(k)), F.greatest(F.length(text_col) - SPAN, F.lit(1))) + 1).cast("int"), F.lit(SPAN)) for k in range(WINDOWS)]
    rows = ok.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col, F.lit(1)).alias("order"), F.array(*piece).alias("pieces"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("order", "pieces"))).where(F.col("k") <= PER_LANG)
    found = rows.orderBy("lang", "k").limit(MAX_LANGS * PER_LANG + 1).collect()
    if len(found) > MAX_LANGS * PER_LANG:
        raise ValueError(f"over {MAX_LANGS} languages of {PER_LANG} texts: raise MAX_LANGS, or give rare languages one name")
    langs = sorted({r["lang"] for r in found})
    at, x, y = {v: i for i, v in enumerate(langs)}, [], []
    for r in found:
        for p in r["pieces"]:
            b = p.encode()
            if b:
                x.append(np.frombuffer((b * (SPAN // len(b) + 1))[:SPAN], np.uint8))
                y.append(at[r["lang"]])
    return langs, np.array(x, dtype=np.uint8).reshape(-1, SPAN), np.array(y, dtype=np.int64)


def identify_languages(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", with_text: bool = False) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row; with_text: the row's other columns too, from its whole text alone.

    held_out: rows not learned from; by default crc32(doc_id as text) mod 4 = 2, and rows without an id. A null
    text or one without a letter is und with score 0; so is every text when nothing could be learned. Rows are judged each
    by itself, so repeated rows come back as often; equal probabilities give the first language by name; a text of any length
    is read whole, window by window. An empty table gives an empty one. One pass over the texts, without a shuffle; the network (a few thousand numbers) goes with the tasks."""
    text_batches(docs.sparkSession)
    held = F.coalesce(part_of(id_col, 4) == 2 if held_out is None else held_out, F.lit(True))
    langs, x, y = training_sample(docs, ~held, id_col, text_col, lang_col)
    model = ByteBiGRU(langs or ["und"])
    if langs:
        model.fit(x, y)
    weights = model.reader()

    own = ("doc_id", "held_out", "lang_pred", "score")
    rest = [c for c in docs.columns if with_text and c not in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(2).to_pylist()
                known = np.array([bool(langs and t and _LETTER.search(t)) for t in texts], dtype=bool)
                prob = predict(weights, [t.encode() if k else b"" for t, k in zip(texts, known)])
                best = prob.argmax(axis=1)
                names = [langs[i] if k else "und" for i, k in zip(best, known)]
                score = np.where(known, prob[np.arange(len(best)), best], 0.0).clip(0, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(score, pa.float64()), *part.columns[3:]], names=[*own, *rest])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("__text"), *rest)
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema) if rest else ""
    return rows.mapInArrow(run, f"doc_id long, held_out boolean, lang_pred string, score double{more}")
