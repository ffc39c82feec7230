"""Language ID: a bidirectional gated recurrent network over bytes.

Both directions run over the UTF-8 bytes of a text, every position gets a
probability for each language from the two states that meet there, and the
document's probabilities are the mean over its positions.  A text is cut into
windows of ``WINDOW`` bytes that are read together with ``CONTEXT`` bytes before and
after, so the work for a text grows with its length alone, a very long text needs no
more memory than a short one, and each byte is labelled exactly once.

The network is written and trained (backpropagation through time, Adam) in numpy on
the driver.  It learns from a bounded sample of labelled rows: of each language those
with the smallest hash of id and text, ``TRAIN_DOCS`` rows at most, as long as the rows
before have less than ``TRAIN_CHARS`` characters together (a text longer than that by
itself is not drawn); the split by crc32 is kept out.  These two bound what comes to
the driver.  A drawn row is learned whole: every window of ``TRAIN_BYTES`` bytes of its
text is seen once, in an order shuffled over all.  The trained weights, a few thousand
numbers, go to the executors inside the function.

Nulls and odd input: a null text and a text without any letter (a character of one of the
categories L) get ``und`` and score 1.0, an empty one too; repeated rows are predicted one by one alike; a null id is
predicted but never learned from, a null language is never learned from; an empty table gives no rows; if nothing can be learned from (no
labelled row), every text gets ``und`` with score 0.0; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelframe.llm.common import crc_mod, read

WINDOW, CONTEXT = 224, 16
HIDDEN = 8
TRAIN_DOCS, TRAIN_CHARS = 2000, 1_000_000
TRAIN_BYTES = 64
BATCH = 128
UND = "und"
WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter; signs like a raised 2 count as words for the pattern, but are none."""
    return any(m[0].isalpha() for m in WORDLIKE.finditer(text or ""))


class BiGRU:
    """Two gated recurrent layers over bytes and a softmax at every position.

    Bytes enter by a table lookup (256 x 3 hidden), as a one-hot product would give.
    Gates: z and r by sigmoid, candidate by tanh, h' = (1 - z) h + z n.
    """

    def __init__(self, n_out: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p |= {f"E{d}": f(256, 3 * hidden), f"U{d}": f(hidden, 2 * hidden), f"V{d}": f(hidden, hidden)}
        self.p |= {"O": f(2 * hidden, n_out), "c": np.zeros(n_out, np.float32)}

    def _run(self, x: np.ndarray, d: str, keep: bool = False):
        """States after each step of x (steps, batch); the parts of each step if asked for."""
        n, (steps, batch) = self.hidden, x.shape
        E, U, V = self.p[f"E{d}"], self.p[f"U{d}"], self.p[f"V{d}"]
        h, out, parts = np.zeros((batch, n), np.float32), np.empty((steps, batch, n), np.float32), []
        for t in range(steps):
            e = E[x[t]]
            zr = h @ U
            zr += e[:, : 2 * n]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[:, :n], zr[:, n:]
            rh = r * h
            c = rh @ V
            c += e[:, 2 * n :]
            np.tanh(c, out=c)
            if keep:
                parts.append((h, z.copy(), r.copy(), rh, c.copy()))
            c -= h
            c *= z
            h = h + c
            out[t] = h
        return out, parts

    def logits(self, x: np.ndarray) -> np.ndarray:
        """(steps, batch, languages) for bytes x (steps, batch)."""
        n, (O, c) = self.hidden, (self.p["O"], self.p["c"])
        a, _ = self._run(x, "f")
        b, _ = self._run(x[::-1], "b")
        return a @ O[:n] + b[::-1] @ O[n:] + c

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of all positions, and its gradients through time.

        y: a language for each column of x; weight (steps, batch): 0 for padding.
        """
        n, p = self.hidden, self.p
        a, pa_ = self._run(x, "f", True)
        b, pb = self._run(x[::-1], "b", True)
        both = np.concatenate([a, b[::-1]], axis=2)
        s = both @ p["O"] + p["c"]
        s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=2, keepdims=True)
        at = np.arange(x.shape[1])
        total = max(1.0, float(weight.sum()))
        loss = float(-(np.log(s[:, at, y] + 1e-9) * weight).sum() / total)
        s[:, at, y] -= 1
        s *= weight[:, :, None] / np.float32(total)
        g = {"O": np.einsum("tbh,tbk->hk", both, s), "c": s.sum(axis=(0, 1))}
        back = s @ p["O"].T
        for d, xs, parts, grads in (("f", x, pa_, back[:, :, :n]), ("b", x[::-1], pb, back[::-1, :, n:])):
            U, V = p[f"U{d}"], p[f"V{d}"]
            gE, gU, gV = np.zeros_like(p[f"E{d}"]), np.zeros_like(U), np.zeros_like(V)
            gh = np.zeros((x.shape[1], n), np.float32)
            pre = np.empty((x.shape[0], x.shape[1], 3 * n), np.float32)
            for t in range(x.shape[0] - 1, -1, -1):
                h, z, r, rh, c = parts[t]
                gh = gh + grads[t]
                gc = gh * z * (1 - c * c)
                grh = gc @ V.T
                gzr = np.concatenate([gh * (c - h) * z * (1 - z), grh * h * r * (1 - r)], axis=1)
                gV += rh.T @ gc
                gU += h.T @ gzr
                gh = gh * (1 - z) + grh * r + gzr @ U.T
                pre[t, :, : 2 * n], pre[t, :, 2 * n :] = gzr, gc
            np.add.at(gE, xs.ravel(), pre.reshape(-1, 3 * n))
            g |= {f"E{d}": gE, f"U{d}": gU, f"V{d}": gV}
        return loss, g

    def train(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int | None = None, batch: int = BATCH, rate: float = 0.01, seed: int = 7) -> float:
        """Adam over ``steps`` batches of the columns of x (all columns once, and 300 at least, if not given), shuffled anew when used up; the last tenth's mean loss."""
        steps = steps or max(300, -(-len(y) // batch))
        rng, losses, order = np.random.default_rng(seed), [], np.empty(0, int)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            while len(order) < batch:
                order = np.concatenate([order, rng.permutation(len(y))])
            own, order = order[:batch], order[batch:]
            loss, g = self.gradients(x[:, own], y[own], weight[:, own])
            losses.append(loss)
            now = rate * (1 - 0.9 * step / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, v in g.items():
                np.clip(v, -1, 1, out=v)
                m[k] += 0.1 * (v - m[k])
                s[k] += 0.001 * (v * v - s[k])
                self.p[k] -= (now * m[k] / (np.sqrt(s[k]) + 1e-8)).astype(np.float32)
        return float(np.mean(losses[-max(1, steps // 10) :]))


class Model:
    """A trained network and its languages; predicts whole texts in blocks of windows."""

    def __init__(self, langs: list[str], net: BiGRU | None):
        self.langs, self.net = langs, net

    def pooled(self, raw: list[bytes], block: int = 2048) -> np.ndarray:
        """Mean of the position probabilities of each byte string (none may be empty)."""
        lengths = np.array([len(x) for x in raw])
        windows = -(-lengths // WINDOW)
        owner = np.repeat(np.arange(len(raw)), windows)
        first = np.concatenate([[0], np.cumsum(windows)[:-1]])
        nth = np.arange(len(owner)) - first[owner]
        # all bytes in one row, with a gap of zero bytes between texts
        gap = WINDOW + 2 * CONTEXT
        starts = np.concatenate([[0], np.cumsum(lengths + gap)[:-1]]) + gap
        flat = np.zeros(int(lengths.sum()) + gap * (len(raw) + 1) + gap, np.uint8)
        for s, x in zip(starts, raw, strict=True):
            flat[s : s + len(x)] = np.frombuffer(x, np.uint8)
        begin = starts[owner] + nth * WINDOW
        size = np.minimum(WINDOW, lengths[owner] - nth * WINDOW)
        total = np.zeros((len(raw), len(self.langs)))
        order = np.argsort(size, kind="stable")  # short windows together: no steps over padding
        for i in range(0, len(order), block):
            own = order[i : i + block]
            steps = int(size[own].max()) + 2 * CONTEXT
            x = flat[(begin[own] - CONTEXT)[None, :] + np.arange(steps)[:, None]]
            s = self.net.logits(x)[CONTEXT : steps - CONTEXT]
            np.exp(s, out=s)
            s *= 1 / s.sum(axis=2, keepdims=True)
            s *= (np.arange(len(s))[:, None] < size[own][None, :])[:, :, None]
            np.add.at(total, owner[own], s.sum(axis=0))
        return total / lengths[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = [UND] * len(texts), [1.0 if self.net else 0.0] * len(texts)
        own = [i for i, t in enumerate(texts) if self.net and has_letter(t)]
        at = 0
        while at < len(own):  # parts of bounded size
            to, size = at, 0
            while to < len(own) and (size < 4_000_000 or to == at):
                size += len(texts[own[to]])
                to += 1
            p = self.pooled([texts[i].encode("utf-8", "surrogatepass") for i in own[at:to]])
            best = p.argmax(axis=1)
            for i, b, row in zip(own[at:to], best, p, strict=True):
                lang[i], score[i] = self.langs[b], float(min(1.0, row[b]))
            at = to
        return lang, score


def windows(raw: list[bytes], lang: list[int], size: int = TRAIN_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all byte strings: bytes (size, windows), language and weight (0 for padding)."""
    many = np.array([-(-len(b) // size) for b in raw])
    x, w = np.zeros((int(many.sum()), size), np.uint8), np.zeros((int(many.sum()), size), np.float32)
    at = 0
    for b, n in zip(raw, many, strict=True):
        x[at : at + n].reshape(-1)[: len(b)] = np.frombuffer(b, np.uint8)
        w[at : at + n].reshape(-1)[: len(b)] = 1
        at += n
    return np.ascontiguousarray(x.T), np.repeat(np.array(lang), many), np.ascontiguousarray(w.T)


def train(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", hold_out: int = 5, docs: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> Model:
    """Learn from rows with a language whose crc32(id) mod ``hold_out`` is not 0."""
    at = F.xxhash64(id_col, text_col)
    able = F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, hold_out) != 0)
    # counts by language say which hashes are small enough to look at, so no language goes to one task whole
    many = {r[0]: r[1] for r in documents.where(able).groupBy(lang_col).count().collect()}
    if not many:
        return Model([], None)
    cut = F.create_map(*(F.lit(v) for lang, n in many.items() for v in (lang, 4.0 * docs / n)))
    low = (F.col("at") / F.lit(2.0**64) + 0.5 < F.element_at(cut, F.col("lang"))) & F.col("n").between(1, chars)
    seen = documents.where(able).select(F.col(lang_col).alias("lang"), at.alias("at"), F.length(text_col).alias("n")).where(low).distinct()  # repeated rows fold before they meet
    top = W.partitionBy("lang").orderBy("at", "n")
    drawn = seen.withColumns({"k": F.row_number().over(top), "sum": F.sum("n").over(top) - F.col("n")}).where((F.col("k") <= docs) & (F.col("sum") < chars)).select("lang", "at")
    texts = documents.where(able).select(F.col(lang_col).alias("lang"), at.alias("at"), F.col(text_col).alias("t"))
    rows = texts.join(F.broadcast(drawn), ["lang", "at"]).dropDuplicates(["lang", "at"]).collect()  # drawn: ``docs`` rows of a language at most
    rows.sort(key=lambda r: (r["lang"], r["at"]))
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return Model([], None)
    x, y, w = windows([r["t"].encode("utf-8", "surrogatepass") for r in rows], [langs.index(r["lang"]) for r in rows])
    net = BiGRU(len(langs))
    net.train(x, y, w)
    return Model(langs, net)


def identify(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: the columns ``keep`` (the id if none), lang_pred, score."""
    keep = keep or [id_col]
    source = documents.select(*keep, F.col(text_col).alias("__text"))
    schema = documents.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = model.predict(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
