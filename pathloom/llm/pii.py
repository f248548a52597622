"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions trained in NumPy.

The patterns give the base spans. The tagger is trained on labelled spans, those that the patterns find in a bounded
sample of documents (SAMPLE_DOCUMENTS, least hashes of doc_id; SAMPLE_WINDOWS windows of WINDOW characters). In training, characters are
changed at random within spans, so it learns shape and surroundings. It tags windows that overlap by half around every digit and at sign of a text (each of its four kinds holds
one of them), decodes each window by Viterbi, and reconciles windows globally: each character takes its tag from the window in
whose middle it is most nearly. A tagged run that touches no base span, looks complete and is sure enough is added as kind ``near_email``, ``near_ip``,
``near_card`` or ``near_phone``: numbers that fail a check digit, addresses with a slip. Base spans stay.

Everything is one pass without a shuffle; the model's weights (about 40 kB) are broadcast.

Defined cases: null and empty texts have no spans; without any span in the sample nothing is added; repeated rows are each
reported; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import blocks, bounded_sample

KINDS = ["email", "ip", "card", "phone"]
ADDED = [f"near_{k}" for k in KINDS]
IP = re.compile(r"[0-9]++(\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")

WINDOW = 64
SAMPLE_DOCUMENTS = 1200
SAMPLE_WINDOWS = 2400
CHARACTERS = 130  # 0: beyond the text; 1 to 128: ASCII; 129: others
EMBEDDING, HIDDEN = 10, 16
TAGS = 1 + 2 * len(KINDS)  # 0: outside; 1 + 2k: begins kind k; 2 + 2k: inside kind k
SURE = 0.9  # mean probability of a run's tags


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[0::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from the at signs: linear in the text whatever it holds."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        if domain:
            low = at
            while low > done and text[low - 1].isascii() and (text[low - 1].isalnum() or text[low - 1] in "._%+-"):
                low -= 1
            if low < at:
                out.append((low, domain.end()))
                done = domain.end()
                at = text.find("@", done)
                continue
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every pattern match that passes its test."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(int(x.lstrip("0")[:4] or 0) <= 255 for x in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() and c.isascii() for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def characters(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(codes < 128, codes + 1, CHARACTERS - 1).astype(np.int16)


def tags_of(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(n, np.int8)
    for kind, a, b in reversed(spans):  # of overlapping ones the first kind counts
        tags[a:b] = 2 + 2 * kind
        tags[a] = 1 + 2 * kind
    return tags


def windows_around(codes: np.ndarray) -> np.ndarray:
    """Starts of the half-overlapping windows that have a digit or an at sign within reach."""
    marks = np.flatnonzero(((codes >= 49) & (codes <= 58)) | (codes == 65))
    if not len(marks):
        return marks
    half = WINDOW // 2
    cells = np.unique(np.concatenate([marks // half + d for d in (-2, -1, 0, 1)]))
    return cells[(cells >= -1) & (cells * half < len(codes))] * half


def cut(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The windows as rows; places before and after the text are 0."""
    padded = np.concatenate([np.zeros(WINDOW, codes.dtype), codes, np.zeros(WINDOW, codes.dtype)])
    return padded[starts[:, None] + WINDOW + np.arange(WINDOW)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """Weights: e embeddings; w, b of the two LSTMs; u, c of the tag scores; t transitions."""

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int) -> Tagger:
        r = np.random.default_rng(seed)
        p = {"e": r.normal(0, 0.5, (CHARACTERS, EMBEDDING)), "u": r.normal(0, 0.3, (2 * HIDDEN, TAGS)), "c": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS))}
        for d in "fb":
            p["w" + d] = r.normal(0, 0.25, (EMBEDDING + HIDDEN, 4 * HIDDEN))
            p["b" + d] = np.r_[np.ones(HIDDEN), np.zeros(3 * HIDDEN)]  # forget gates start open
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def _lstm(self, x: np.ndarray, d: str, kept: list | None) -> np.ndarray:
        """States of one direction over x (time, rows, embedding)."""
        w, b = self.p["w" + d], self.p["b" + d]
        n, rows, _ = x.shape
        h = np.zeros((rows, HIDDEN), np.float32)
        c = np.zeros_like(h)
        out = np.empty((n, rows, HIDDEN), np.float32)
        from_x = x.reshape(-1, EMBEDDING) @ w[:EMBEDDING] + b
        from_x = from_x.reshape(n, rows, -1)
        for t in range(n):
            z = from_x[t] + h @ w[EMBEDDING:]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            f, i, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            before, h_before = c, h
            c = f * c + i * g
            s = np.tanh(c)
            h = o * s
            out[t] = h
            if kept is not None:
                kept.append((f, i, o, g, before, s, h_before))
        return out

    def emissions(self, windows: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """Tag scores (time, rows, TAGS)."""
        x = self.p["e"][windows.T]
        steps = {"f": [], "b": []} if kept is not None else {"f": None, "b": None}
        h = np.concatenate([self._lstm(x, "f", steps["f"]), self._lstm(x[::-1], "b", steps["b"])[::-1]], 2)
        if kept is not None:
            kept |= {"x": x, "h": h, **steps}
        return h @ self.p["u"] + self.p["c"]

    def gradients(self, windows: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss for a row, -log of the CRF's probability of its tags, and its gradients."""
        kept: dict = {}
        s = self.emissions(windows, kept)
        n, rows, _ = s.shape
        y, t = tags.T, self.p["t"]
        ahead, back = np.empty_like(s), np.zeros_like(s)
        ahead[0] = s[0]
        for k in range(1, n):
            ahead[k] = s[k] + _log_sum(ahead[k - 1][:, :, None] + t, 1)
        for k in range(n - 2, -1, -1):
            back[k] = _log_sum(t + (s[k + 1] + back[k + 1])[:, None, :], 2)
        total = _log_sum(ahead[-1], 1)
        each = np.arange(rows)
        path = sum(s[k, each, y[k]] for k in range(n)) + sum(t[y[k - 1], y[k]] for k in range(1, n))
        d_s = np.exp(ahead + back - total[:, None])
        d_t = np.zeros_like(t)
        for k in range(1, n):
            pair = ahead[k - 1][:, :, None] + t + (s[k] + back[k])[:, None, :] - total[:, None, None]
            d_t += np.exp(pair).sum(0)
            np.add.at(d_t, (y[k - 1], y[k]), -1)
        for k in range(n):
            d_s[k, each, y[k]] -= 1
        d_s /= rows
        g = {"t": d_t / rows, "c": d_s.sum((0, 1)), "u": kept["h"].reshape(-1, 2 * HIDDEN).T @ d_s.reshape(-1, TAGS)}
        d_h = d_s @ self.p["u"].T
        d_x = np.zeros_like(kept["x"])
        for d, part, x in (("f", d_h[:, :, :HIDDEN], kept["x"]), ("b", d_h[::-1, :, HIDDEN:], kept["x"][::-1])):
            w = self.p["w" + d]
            d_w, d_z_all = np.zeros_like(w), np.empty((n, rows, 4 * HIDDEN), np.float32)
            carry_h, carry_c = np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32)
            for k in range(n - 1, -1, -1):
                f, i, o, gate, before, sq, h_before = kept[d][k]
                dh = part[k] + carry_h
                dc = dh * o * (1 - sq * sq) + carry_c
                dz = np.concatenate([dc * before * f * (1 - f), dc * gate * i * (1 - i), dh * sq * o * (1 - o), dc * i * (1 - gate * gate)], 1)
                d_z_all[k] = dz
                d_w[EMBEDDING:] += h_before.T @ dz
                carry_h, carry_c = dz @ w[EMBEDDING:].T, dc * f
            flat = d_z_all.reshape(-1, 4 * HIDDEN)
            d_w[:EMBEDDING] = x.reshape(-1, EMBEDDING).T @ flat
            g["w" + d], g["b" + d] = d_w, flat.sum(0)
            back_x = (flat @ w[:EMBEDDING].T).reshape(x.shape)
            d_x += back_x if d == "f" else back_x[::-1]
        g["e"] = np.zeros_like(self.p["e"])
        np.add.at(g["e"], windows.T.ravel(), d_x.reshape(-1, EMBEDDING))
        return float((total - path).mean()), g

    def decode(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi tags of each window, and the probability that the scores alone give each."""
        s, t = self.emissions(windows), self.p["t"]
        n, rows, _ = s.shape
        came = np.empty(s.shape, np.int8)
        best = s[0]
        for k in range(1, n):
            step = best[:, :, None] + t
            came[k] = step.argmax(1)
            best = step.max(1) + s[k]
        tags = np.empty((rows, n), np.int8)
        tags[:, -1] = best.argmax(1)
        each = np.arange(rows)
        for k in range(n - 1, 0, -1):
            tags[:, k - 1] = came[k, each, tags[:, k]]
        sure = np.exp(s - _log_sum(s, 2)[:, :, None])
        return tags, np.take_along_axis(sure.transpose(1, 0, 2), tags[:, :, None].astype(np.int64), 2)[:, :, 0]


def fit(windows: np.ndarray, tags: np.ndarray, epochs: int = 14, batch: int = 48, rate: float = 0.012, seed: int = 3) -> Tagger:
    """Train by Adam; within spans a digit or letter is now and then replaced by another one."""
    rng = np.random.default_rng(seed)
    model = Tagger.fresh(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    steps, at = epochs * -(-len(windows) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for rows in (order[i : i + batch] for i in range(0, len(order), batch)):
            x, y = windows[rows].copy(), tags[rows]
            swap = (y > 0) & (rng.random(x.shape) < 0.15)
            digit, letter = swap & (x >= 49) & (x <= 58), swap & (x >= 98) & (x <= 123)
            x[digit] = rng.integers(49, 59, digit.sum())
            x[letter] = rng.integers(98, 124, letter.sum())
            _, g = model.gradients(x, y)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            at += 1
            lr = rate * (1 - at / (steps + 1))
            for k, v in g.items():
                v = v * min(1.0, 5.0 / (norm + 1e-9))
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                model.p[k] -= lr * (first[k] / (1 - 0.9**at)) / (np.sqrt(second[k] / (1 - 0.99**at)) + 1e-8)
    return model


def tag_texts(model: Tagger, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
    """(kind, start, end, mean probability) of the runs that the model tags in each text."""
    codes = [characters(t) for t in texts]
    starts = [windows_around(c) for c in codes]
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    todo = [i for i, s in enumerate(starts) if len(s)]
    if not todo:
        return out
    all_windows = np.concatenate([cut(codes[i], starts[i]) for i in todo])
    parts = [model.decode(all_windows[k : k + 1024]) for k in range(0, len(all_windows), 1024)]
    tags, sure = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
    quarter, at = WINDOW // 4, 0
    for i in todo:
        n = len(starts[i])
        whole, prob = np.zeros(len(codes[i]), np.int8), np.zeros(len(codes[i]), np.float32)
        for k, s in enumerate(starts[i].tolist()):  # the middle of each window, where it sees most on both sides
            low, high = s + quarter, s + WINDOW - quarter
            low = 0 if s <= 0 and low > 0 else low
            low, high = max(low, 0), min(high, len(whole))
            if high > low:
                whole[low:high] = tags[at + k, low - s : high - s]
                prob[low:high] = sure[at + k, low - s : high - s]
        at += n
        kind = np.where(whole > 0, (whole.astype(np.int16) - 1) // 2, -1)
        begins = (whole > 0) & ((whole % 2 == 1) | (kind != np.concatenate([[-2], kind[:-1]])))
        for a in np.flatnonzero(begins).tolist():
            b = a + 1
            while b < len(whole) and kind[b] == kind[a] and not begins[b]:
                b += 1
            out[i].append((int(kind[a]), a, b, float(prob[a:b].mean())))
    return out


def complete(kind: int, text: str) -> bool:
    """Does a tagged run have what makes up its kind?"""
    digits = sum(c in "0123456789" for c in text)
    if kind == 0:
        return 0 < text.find("@") < len(text) - 2
    return digits >= (4 if kind == 1 else 12 if kind == 2 else 8) and (kind != 1 or text.count(".") == 3)


def added_spans(base: list[tuple[int, int, int]], tagged: list[tuple[int, int, int, float]], text: str) -> list[tuple[int, int, int]]:
    return [
        (k, a, b)
        for k, a, b, p in tagged
        if p >= SURE and complete(k, text[a:b]) and all(b <= x or a >= y for _, x, y in base)
    ]


def train(docs: DataFrame) -> Tagger | None:
    """Fit on windows around digits and at signs of a bounded sample of documents, labelled by the patterns."""
    marked = docs.filter(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]"))
    sample = bounded_sample(marked.select("doc_id", "text"), F.col("doc_id"), SAMPLE_DOCUMENTS, docs.count(), spare=10)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            rows, ids = [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), texts.to_pylist()):
                codes = characters(text)
                starts = windows_around(codes)
                x, y = cut(codes, starts).astype(np.uint8), cut(tags_of(len(codes), base_spans(text)), starts).astype(np.uint8)
                rows += [a.tobytes() + b.tobytes() for a, b in zip(x, y)]
                ids += [f"{i}:{s}" for s in starts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(rows, pa.binary())], names=["id", "window"])

    labelled = sample.mapInArrow(label, "id string, window binary")
    order = F.xxhash64(F.lit(11), "id")
    rows = labelled.orderBy(order, "id").limit(SAMPLE_WINDOWS).collect()
    both = np.frombuffer(b"".join(r["window"] for r in rows), np.uint8).reshape(-1, 2, WINDOW)
    if not both[:, 1].any():
        return None
    return fit(both[:, 0].astype(np.int16), both[:, 1].astype(np.int64))


def _joined(spans: list[tuple[int, int, int]], names: list[str]) -> str:
    return ",".join(f"{names[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """Per row: doc_id, counts of base spans, base_sha256, spans (base and added), n_added."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            texts = texts.to_pylist()
            base = [base_spans(t) for t in texts]
            tagged = tag_texts(shared.value, texts) if shared.value else [[] for _ in texts]
            added = [added_spans(b, m, t) for b, m, t in zip(base, tagged, texts)]
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
            listed = [_joined(b, KINDS) for b in base]
            every = [_joined(b + [(k + len(KINDS), x, y) for k, x, y in a], KINDS + ADDED) for b, a in zip(base, added)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *counts,
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed], pa.string()),
                    pa.array(every, pa.string()),
                    pa.array([len(a) for a in added], pa.int64()),
                ],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"],
            )

    columns = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(
        scan, f"doc_id {kind}, {columns}, base_sha256 string, spans string, n_added long"
    )


def personal_data(docs: DataFrame) -> DataFrame:
    return find(docs, train(docs))
