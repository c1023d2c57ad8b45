"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy."""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .textnp import SPACE, grouped, word_hashes

WINDOW = 64
STRIDE = 32
HIDDEN = 8
WORD_ROWS, CHAR_ROWS, WIDTH = 1 << 15, 1 << 13, 8
#: The bound of the labelled sample that the model is fitted on: rows of each label, bytes of a text, bytes of each label's texts.
SAMPLE_TOXIC, SAMPLE_CLEAN, TEXT_BYTES, SAMPLE_BYTES = 1200, 2400, 1 << 20, 24 << 20
EPOCHS, NOISY, BATCH, RATE = 9, 0.3, 256, 0.012
#: The share of the sample that the network doesn't see and the last regression is fitted on, and the least number of steps.
CALIBRATION, LEAST_STEPS = 0.25, 180
WORD_DROP, DECAY = 0.4, 2e-3
FLOOR = -12.0
#: Bytes of a long text whose windows are computed at once.
PIECE = 400_000

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


class Words:
    """Words of some texts: their buckets, their character 4-grams (with marked ends), and each text's number of words."""

    def __init__(self, texts: list[bytes]):
        parts = [self._read([texts[i] for i in group]) for group in grouped(texts)] or [self._read([])]
        self.count, self.bucket, self.gram, self.grams, self.begin = (np.concatenate(x) for x in zip(*parts))
        self.first = np.cumsum(self.grams) - self.grams

    @staticmethod
    def _read(texts: list[bytes]) -> tuple:
        low = [t.lower() for t in texts]  # ASCII letters alone
        hashes, count = word_hashes(low)
        data = np.frombuffer(b"\n" + b"\n".join(low) + b"\n\n\n\n", np.uint8)
        space = SPACE[data]
        begin = np.flatnonzero(~space[1:] & space[:-1]) + 1
        end = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        bucket = (hashes >> np.uint64(49)).astype(np.int32)
        data = np.where(space, np.uint8(32), data).astype(np.uint32)
        gram = data[:-3] | data[1:-2] << 8 | data[2:-1] << 16 | data[3:] << 24
        short = begin[end - begin == 1] - 1
        gram[short] &= np.uint32(0xFFFFFF)
        valid = ~space[1:-2] & ~space[2:-1]
        valid[short] = True
        at = np.flatnonzero(valid)
        gram = ((gram[at] * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int32)
        return count, bucket, gram, np.maximum(end - begin - 1, 1), begin - 1


def windows(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and text of every window: each ``STRIDE`` words, the last one ends with the text."""
    n = np.where(count > WINDOW, -(-(count - WINDOW) // STRIDE) + 1, (count > 0).astype(np.int64))
    text = np.repeat(np.arange(len(count)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    length = np.minimum(count, WINDOW)[text]
    start = np.minimum(k * STRIDE, count[text] - length) + (np.cumsum(count) - count)[text]
    return start, length, text


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_model(seed: int = 11) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    g = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
    m = {"word": g(WORD_ROWS, WIDTH, scale=0.05), "char": g(CHAR_ROWS, WIDTH, scale=0.3)}
    for d in "fb":
        m |= {f"W{d}": g(2 * WIDTH, 3 * HIDDEN, scale=0.35), f"U{d}": g(HIDDEN, 3 * HIDDEN, scale=0.35), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return m | {"A": g(2 * HIDDEN, HIDDEN, scale=0.35), "a": np.zeros(HIDDEN, np.float32), "v": g(HIDDEN, scale=0.5), "w": g(2 * HIDDEN, scale=0.5), "o": np.zeros(1, np.float32)}


def _inputs(m: dict, w: Words) -> np.ndarray:
    """Word vector and mean character 4-gram vector of each word."""
    if not len(w.bucket):
        return np.zeros((0, 2 * WIDTH), np.float32)
    chars = np.add.reduceat(m["char"][w.gram], w.first, axis=0) / w.grams[:, None].astype(np.float32)
    return np.hstack([m["word"][w.bucket], chars])


def _recur(m: dict, d: str, x: np.ndarray, mask: np.ndarray | None, keep: list | None) -> np.ndarray:
    steps, n = x.shape[:2]
    h = np.zeros((n, HIDDEN), np.float32)
    out = np.empty((steps, n, HIDDEN), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        u, a = h @ m[f"U{d}"], x[t]
        zr = _sigmoid(a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(a[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
        new = c + z * (h - c)
        if mask is not None:
            new = np.where(mask[t][:, None], new, h)
        if keep is not None:
            keep.append((t, h, z, r, c, u[:, 2 * HIDDEN :]))
        out[t] = h = new
    return out


def _attend(m: dict, h: np.ndarray, mask: np.ndarray | None):
    e = np.tanh(h @ m["A"] + m["a"])
    s = e @ m["v"]
    if mask is not None:
        s = np.where(mask, s, np.float32(-1e9))
    s = np.exp(s - s.max(0))
    alpha = s / s.sum(0)
    c = np.einsum("tn,tnk->nk", alpha, h)
    return e, alpha, c, c @ m["w"] + m["o"][0]


def _logits(m: dict, w: Words, start: np.ndarray, length: np.ndarray, chunk: int = 2048) -> np.ndarray:
    x = _inputs(m, w)
    x = np.hstack([x @ m["Wf"] + m["cf"], x @ m["Wb"] + m["cb"]])
    out = np.empty(len(start), np.float32)
    full = length == WINDOW
    for pick in (np.flatnonzero(full), np.flatnonzero(~full)):
        for i in range(0, len(pick), chunk):
            at = pick[i : i + chunk]
            steps = int(length[at].max())
            t = np.arange(steps)[:, None]
            mask = None if full[at[0]] else t < length[at]
            p = x[start[at] + (t if mask is None else np.minimum(t, length[at] - 1))]
            h = np.concatenate([_recur(m, "f", p[..., : 3 * HIDDEN], mask, None), _recur(m, "b", p[..., 3 * HIDDEN :], mask, None)], 2)
            out[at] = _attend(m, h, mask)[3]
    return out


def _long_logits(m: dict, t: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Logit and first word of every window of one long text, the same windows as of a short one.

    The text is read a piece at a time; what stays of a piece begins with its last
    window's first word, so that the last window of the text always finds its words.
    """
    at, held, word, nxt, logits, starts = 0, b"", 0, 0, [], []
    while True:
        cut = at + PIECE
        gap = _SPACE.search(t, cut) if cut < len(t) else None
        cut = gap.start() if gap else len(t)
        held += t[at:cut]
        at = cut
        w = Words([held])
        n = int(w.count[0])
        start = np.arange(nxt, n - WINDOW + 1, STRIDE)
        if at == len(t):
            end = max(0, n - WINDOW)
            if n and (len(start) and start[-1] < end or not len(start) and (nxt == 0 or end > nxt - STRIDE)):
                start = np.append(start, end)
        if len(start):
            logits.append(_logits(m, w, start, np.minimum(n - start, WINDOW)))
            starts.append(start + word)
        if at == len(t):
            break
        back = int(start[-1]) if len(start) else max(0, nxt - STRIDE)
        nxt = int(start[-1]) + STRIDE - back if len(start) else nxt - back
        held = held[int(w.begin[back]) :] if n else b""
        word += back
    return np.concatenate([np.zeros(0, np.float32), *logits]), np.concatenate([np.zeros(0, np.int64), *starts])


def window_logits(m: dict, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logit, text and first word (within its text) of every window, in order of text and word."""
    out = [(np.zeros(0, np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for group in grouped(texts, PIECE):
        if len(group) == 1 and len(texts[group[0]]) > PIECE:
            logit, start = _long_logits(m, texts[group[0]])
            out.append((logit, np.full(len(start), group[0]), start))
        else:
            w = Words([texts[i] for i in group])
            start, length, text = windows(w.count)
            out.append((_logits(m, w, start, length), np.asarray(group)[text], start - (np.cumsum(w.count) - w.count)[text]))
    return tuple(np.concatenate(x) for x in zip(*out))


def text_features(m: dict, texts: list[bytes]) -> np.ndarray:
    """For each text: its best window's logit, the best that doesn't overlap that window, and log of its windows."""
    out = np.full((len(texts), 3), FLOOR)
    out[:, 2] = 0
    logit, text, start = window_logits(m, texts)
    if len(logit):
        first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        many = np.diff(np.append(first, len(text)))
        best = np.maximum.reduceat(logit, first)
        place = np.flatnonzero(np.repeat(best, many) == logit)
        where = np.zeros(len(texts), np.int64)
        where[text[place][::-1]] = start[place][::-1]  # the first of equals
        apart = np.abs(start - where[text]) >= WINDOW
        second = np.maximum.reduceat(np.where(apart, logit, FLOOR), first)
        out[text[first]] = np.stack([best, second, np.log1p(many)], 1)
    return np.clip(out, FLOOR, -FLOOR)


def _gradients(m: dict, w: Words, start, length, label, weight, r) -> dict:
    """Gradients of the weighted logistic loss of some windows; some words show only their characters."""
    steps = int(length.max())
    t = np.arange(steps)[:, None]
    mask = t < length
    at = start + np.minimum(t, length - 1)
    flat = at.ravel()
    n_grams = w.grams[flat]
    gram = w.gram[np.repeat(w.first[flat] - (np.cumsum(n_grams) - n_grams), n_grams) + np.arange(n_grams.sum())]
    first = np.cumsum(n_grams) - n_grams
    seen = (r.random(len(flat)) >= WORD_DROP).astype(np.float32)[:, None]
    x = np.hstack([m["word"][w.bucket[flat]] * seen, np.add.reduceat(m["char"][gram], first, axis=0) / n_grams[:, None].astype(np.float32)])
    keep = {"f": [], "b": []}
    hs = [_recur(m, d, (x @ m[f"W{d}"] + m[f"c{d}"]).reshape(steps, -1, 3 * HIDDEN), mask, keep[d]) for d in "fb"]
    h = np.concatenate(hs, 2)
    e, alpha, c, logit = _attend(m, h, mask)
    p = _sigmoid(logit)
    dl = (weight * (p - label)).astype(np.float32)
    g = {"o": np.array([dl.sum()], np.float32), "w": c.T @ dl}
    dc = dl[:, None] * m["w"]
    da = np.einsum("nk,tnk->tn", dc, h)
    ds = alpha * (da - (alpha * da).sum(0))
    dh = alpha[..., None] * dc
    g["v"] = np.einsum("tn,tnk->k", ds, e)
    de = ds[..., None] * m["v"] * (1 - e**2)
    g["a"] = de.sum((0, 1))
    g["A"] = np.einsum("tnk,tnj->kj", h, de)
    dh = dh + de @ m["A"].T
    dx = np.zeros_like(x)
    for d, part in (("f", dh[..., :HIDDEN]), ("b", dh[..., HIDDEN:])):
        carry = np.zeros_like(part[0])
        da3 = np.zeros((steps, len(label), 3 * HIDDEN), np.float32)
        gu = np.zeros_like(m[f"U{d}"])
        for step, prev, z, r, cand, un in reversed(keep[d]):
            total = part[step] + carry
            new = np.where(mask[step][:, None], total, 0)
            carry = total - new + new * z
            dn = new * (1 - z) * (1 - cand**2)
            dz = new * (prev - cand) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            da3[step] = np.hstack([dz, dr, dn])
            du = np.hstack([dz, dr, dn * r])
            gu += prev.T @ du
            carry = carry + du @ m[f"U{d}"].T
        flat3 = da3.reshape(-1, 3 * HIDDEN)
        g[f"U{d}"], g[f"c{d}"], g[f"W{d}"] = gu, flat3.sum(0), x.T @ flat3
        dx += flat3 @ m[f"W{d}"].T
    dchar = np.repeat(dx[:, WIDTH:] / n_grams[:, None], n_grams, axis=0)
    dword = dx[:, :WIDTH] * seen
    g["word"] = np.stack([np.bincount(w.bucket[flat], dword[:, k], WORD_ROWS) for k in range(WIDTH)], 1).astype(np.float32)
    g["char"] = np.stack([np.bincount(gram, dchar[:, k], CHAR_ROWS) for k in range(WIDTH)], 1).astype(np.float32)
    return g


def train(texts: list[bytes], labels: np.ndarray, total: tuple[int, int] | None = None, seed: int = 5) -> dict[str, np.ndarray]:
    """A model from labelled texts.

    The first epochs give every sampled window its text's label; in the others a
    text is judged by its best windows, found by scoring all its windows. A logistic
    regression on the best, the best apart from it and the number of windows then maps texts
    to scores. It is fitted on the share ``CALIBRATION`` of each label's texts, which the
    network hasn't seen (all texts where a label has only one), with classes weighted to ``total``,
    the clean and toxic rows that the sample stands for.
    """
    m = new_model(seed)
    labels = np.asarray(labels, np.float32)
    if not len(texts) or labels.min() == labels.max():
        m["beta"] = np.array([0, 0, 0, 4.0 if len(texts) and labels.min() > 0 else -4.0])
        m["scale"] = np.array([[0.0, 0, 0], [1, 1, 1]])
        return m
    r = np.random.default_rng(seed)
    apart = np.zeros(len(texts), bool)
    for x in (labels > 0, labels <= 0):
        apart[r.permutation(np.flatnonzero(x))[: int(np.ceil(CALIBRATION * x.sum())) if x.sum() > 1 else 0]] = True
    if not 0 < labels[apart].sum() < apart.sum():
        apart[:] = False
    held, held_labels = ([t for t, x in zip(texts, apart) if x], labels[apart]) if apart.any() else (texts, labels)
    texts, labels = [t for t, x in zip(texts, apart) if not x], labels[~apart]
    w = Words(texts)
    start, length, text = windows(w.count)
    balance = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    first, second = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    step = 0
    a_text = np.minimum(np.bincount(text, minlength=len(texts)), np.where(labels > 0, 2, 3)).sum()
    epochs = int(max(EPOCHS, -(-LEAST_STEPS * BATCH // max(1, a_text))))
    for epoch in range(epochs):
        key = r.random(len(text)).astype(np.float32)
        if epoch >= epochs * NOISY:
            key = -window_logits(m, texts)[0]
        order = np.lexsort((key, text))
        many = np.bincount(text, minlength=len(texts))
        rank = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        use = order[rank < np.where(labels[text[order]] > 0, 2, 3)]
        use = r.permutation(use)
        rate = RATE * (1 - epoch / epochs) + RATE / 10
        for i in range(0, len(use), BATCH):
            at = use[i : i + BATCH]
            g = _gradients(m, w, start[at], length[at], labels[text[at]], balance[text[at]].astype(np.float32) / len(at), r)
            step += 1
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.002 * (v * v - second[k])
                if k in ("word", "char"):
                    m[k] *= 1 - rate * DECAY
                m[k] -= (rate / (1 - 0.9**step) * first[k] / (np.sqrt(second[k] / (1 - 0.998**step)) + 1e-7)).astype(np.float32)
    texts, labels = held, held_labels
    x = text_features(m, texts)
    m["scale"] = np.stack([x.mean(0), x.std(0) + 1e-6])
    x = np.hstack([(x - m["scale"][0]) / m["scale"][1], np.ones((len(x), 1))])
    clean, toxic = total or (int((labels == 0).sum()), int((labels > 0).sum()))
    weight = np.where(labels > 0, toxic / (labels > 0).sum(), clean / (labels == 0).sum())
    weight = weight / weight.mean()
    beta = np.zeros(4)
    for _ in range(30):  # Newton steps of the regression
        p = _sigmoid(x @ beta)
        grad = x.T @ (weight * (p - labels)) + 0.05 * beta
        beta -= np.linalg.solve((x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x + 0.05 * np.eye(4), grad)
    m["beta"] = beta
    return m


def score_texts(m: dict, texts: list[bytes]) -> np.ndarray:
    x = (text_features(m, texts) - m["scale"][0]) / m["scale"][1]
    return _sigmoid(x @ m["beta"][:3] + m["beta"][3])


def is_held_out(doc_id):
    """Rows whose crc32 of the id as text is divisible by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> dict[str, np.ndarray]:
    """A model from labelled rows of ``docs(doc_id, text)`` that are not held out.

    ``labels(doc_id, toxic)``; repeated labels of an id count once, by their largest.
    The sample: at most ``toxic`` and ``clean`` rows, the first by a hash of the id, of texts
    of at most ``TEXT_BYTES``, as far as each label's texts fit into ``SAMPLE_BYTES``. One task
    trains on it; only the weights, about 1.4 MB, go to the driver.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    pick = known.where("label > 0").orderBy(*order).limit(toxic).union(known.where("label = 0").orderBy(*order).limit(clean))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(pick), "doc_id").where(F.octet_length("text") <= TEXT_BYTES)
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    so_far = Window.partitionBy("label").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("size", F.sum(F.octet_length("text")).over(so_far)).where(F.col("size") <= SAMPLE_BYTES).select("doc_id", "text", "label")
    size = known.agg(F.count_if(F.col("label") == 0).alias("n_clean"), F.count_if(F.col("label") > 0).alias("n_toxic"))
    rows = rows.withColumn("task", F.lit(0)).join(F.broadcast(size), how="left")  # one row

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        model = train([t.encode() for t in pdf["text"]], pdf["label"].to_numpy(), (int(pdf["n_clean"].iat[0]), int(pdf["n_toxic"].iat[0])))
        out = io.BytesIO()
        np.savez(out, **model)
        return pd.DataFrame({"model": [out.getvalue()]})

    found = rows.groupBy("task").applyInPandas(learn, "model binary").collect()
    return dict(np.load(io.BytesIO(found[0]["model"]))) if found else train([], np.zeros(0))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """All rows and columns of ``docs`` with ``toxicity_score double``, from the whole ``text`` alone.

    Null and empty texts get the score of a text without windows; repeated rows and
    null ids score like others; an empty table gives an empty result. A column that
    has the name of the score is replaced.
    """
    docs = docs.drop("toxicity_score")
    schema = StructType([*docs.schema.fields, StructField("toxicity_score", DoubleType())])
    at = docs.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score_texts(model, texts), pa.float64())], [*b.schema.names, "toxicity_score"])

    return docs.mapInArrow(apply, schema)


def keep_clean(docs: DataFrame, model: dict, below: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with their own columns, whose score is below ``below``."""
    at = docs.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()]
            yield b.filter(pa.array(score_texts(model, texts) < below))

    return docs.mapInArrow(apply, docs.schema)


def held_out_crc(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0
