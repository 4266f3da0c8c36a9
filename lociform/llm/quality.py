"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Emissions come from character-class features of the line and
of its two neighbours, transitions are learnt, and forward-backward gives each line's
marginal. The document's raw quality is the mean marginal weighted by line length; a
logistic of its logit brings it to the scale of the labels. Training sees documents as
chains of equal labels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociform.llm.common import if_small, map_batches, parts_of, table, utf8

#: At most so many labelled rows are fitted on, those of the smallest hash of their id.
TRAIN_ROWS = 8000
#: Documents of more lines are not fitted on: their features would be too much for the driver. They are scored as all others.
TRAIN_LINES = 5000
CUT = 0.3
#: Byte classes: lower, upper, digit, above ASCII, space, bar, mark (#$%&*), shout (!), stop (.,;:?), other.
CLASSES = 10
CLASS = np.full(256, 9, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128, 256)), b" \t", b"|", b"#$%&*", b"!", b".,;:?")):
    CLASS[list(_chars)] = _k
WIDTH = CLASSES + 9
FEATURES = 3 * WIDTH + 1


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, line lengths, lines of each text); an empty or null text is one empty line."""
    raws = [utf8(t) for t in texts]
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    kinds = CLASS[data]
    counts = np.stack([np.add.reduceat(kinds == k, starts, dtype=np.int32) for k in range(CLASSES)], 1).astype(np.float64)
    counts[:, 9] -= 1  # the line's end
    length = (ends - starts).astype(np.float64)
    per = np.array([r.count(b"\n") + 1 for r in raws], np.int64)
    share = counts / np.maximum(length, 1)[:, None]
    words = counts[:, 4] + 1
    seen = _repeats(data, starts, ends, per)
    each = words[:, None]
    letters = np.maximum(counts[:, 0] + counts[:, 1] + counts[:, 3], 1)
    fresh = _fresh(data, starts, ends)
    own = np.column_stack([counts[:, 5:8] / each, counts[:, 1] / letters, fresh, share, np.log1p(length) / 8, np.minimum(length / words, 40) / 20, seen, length == 0])
    first = np.zeros(len(own), bool)
    first[np.cumsum(per) - per] = True
    last = np.zeros(len(own), bool)
    last[np.cumsum(per) - 1] = True
    before = np.where(first[:, None], 0, np.roll(own, 1, 0))
    after = np.where(last[:, None], 0, np.roll(own, -1, 0))
    return np.column_stack([own, before, after, np.ones(len(own))]), length, per


def _fresh(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Share of a line's words that differ from those before in the line; 1 for a line of less than three."""
    raw = data.tobytes()
    out = np.ones(len(starts))
    for i, (a, z) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        words = raw[a:z].split()
        if len(words) > 2:
            out[i] = len(set(words)) / len(words)
    return out


def _repeats(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, per: np.ndarray) -> np.ndarray:
    """1 for a line that its text holds before."""
    raw = data.tobytes()
    out = np.zeros(len(starts))
    at = 0
    for n in per.tolist():
        seen: set[bytes] = set()
        for i in range(at, at + n) if n > 1 else ():
            line = raw[starts[i] : ends[i]]
            if line in seen:
                out[i] = 1
            seen.add(line)
        at += n
    return out


def marginals(emit: np.ndarray, per: np.ndarray, step: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginal of good for each line, log partition of each chain, expected transitions (2, 2).

    ``emit``: log potential of good (bad has 0). Chains are run together, the longest first.
    """
    order = np.argsort(-per, kind="stable")
    first = (np.cumsum(per) - per)[order]
    n = per[order]
    top = int(n[0]) if len(n) else 0
    live = [int(np.searchsorted(-n, -t, "left")) for t in range(top)]  # chains longer than t
    forward = np.zeros((len(emit), 2))
    log_z = np.zeros(len(n))
    for t in range(top):
        rows = first[: live[t]] + t
        e = np.column_stack([np.zeros(len(rows)), emit[rows]])
        if t == 0:
            forward[rows] = start + e
        else:
            a = forward[rows - 1]
            forward[rows] = np.logaddexp(a[:, :1] + step[0], a[:, 1:] + step[1]) + e
    ends = first + n - 1
    log_z = np.logaddexp(forward[ends, 0], forward[ends, 1])
    backward = np.zeros((len(emit), 2))
    moved = np.zeros((2, 2))
    for t in range(top - 2, -1, -1):
        rows = first[: live[t + 1]] + t
        b = backward[rows + 1] + np.column_stack([np.zeros(len(rows)), emit[rows + 1]])
        backward[rows] = np.logaddexp(step[:, 0] + b[:, :1], step[:, 1] + b[:, 1:])
        joint = np.exp(forward[rows][:, :, None] + step + b[:, None, :] - log_z[: live[t + 1], None, None])
        moved += joint.sum(0)
    p = 1 / (1 + np.exp(np.clip(forward[:, 0] + backward[:, 0] - forward[:, 1] - backward[:, 1], -500, 500)))
    out = np.zeros(len(n))
    out[order] = log_z
    return p, out, moved


class LineField:
    """The field's weights, and the logistic from a document's mean marginal to its score."""

    def __init__(self) -> None:
        self.weights, self.step, self.start, self.scale = np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(2), (1.0, 0.0)

    def fit(self, features: np.ndarray, length: np.ndarray, per: np.ndarray, labels: np.ndarray, rounds: int = 120) -> LineField:
        """Adam on the mean log likelihood, then Newton steps for the logistic. No rows: every score is 0.5."""
        if not len(per):
            return self
        of_line = np.repeat(labels, per).astype(float)
        firsts = np.cumsum(per) - per
        same = np.array([(per[labels == k] - 1).sum() for k in (0, 1)], float)
        size = FEATURES + 6
        x, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
        for k in range(1, rounds + 1):
            step, start = x[FEATURES : FEATURES + 4].reshape(2, 2), x[FEATURES + 4 :]
            p, _, moved = marginals(features @ x[:FEATURES], per, step, start)
            g = np.concatenate([(of_line - p) @ features, (np.diag(same) - moved).ravel(), [((1 - labels) - (1 - p[firsts])).sum(), (labels - p[firsts]).sum()]])
            g = g / len(per) - 1e-4 * x
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            x = x + 0.2 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        self.weights, self.step, self.start = x[:FEATURES], x[FEATURES : FEATURES + 4].reshape(2, 2), x[FEATURES + 4 :]
        z = self.raw(features, length, per)
        a, b = 1.0, 0.0
        for _ in range(25):
            q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w = q * (1 - q) + 1e-6
            g = np.array([((labels - q) * z).sum() - 0.1 * (a - 1), (labels - q).sum() - 0.1 * b])
            h = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
            d = np.linalg.solve(h, g)
            a, b = max(0.05, a + float(np.clip(d[0], -1, 1))), b + float(np.clip(d[1], -1, 1))
        self.scale = (a, b)
        return self

    def raw(self, features: np.ndarray, length: np.ndarray, per: np.ndarray) -> np.ndarray:
        """Logit of the length-weighted mean marginal of each document."""
        p, _, _ = marginals(features @ self.weights, per, self.step, self.start)
        at = np.cumsum(per) - per
        weight = np.maximum(length, 1)
        mean = np.add.reduceat(p * weight, at) / np.add.reduceat(weight, at) if len(per) else np.zeros(0)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-(a * self.raw(*line_features(texts)) + b)))


def is_held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> LineField:
    """A field fitted on at most ``rows`` labelled documents of at most ``TRAIN_LINES`` lines outside the held-out fifth.

    Executors turn texts into line features; these reach the driver. Without labels the
    field scores every document 0.5.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(if_small(chosen, rows), "doc_id")

    def features(b: dict[str, list]) -> dict[str, list]:
        short = [i for i, t in enumerate(b["text"]) if utf8(t).count(b"\n") < TRAIN_LINES]
        b = {k: [v[i] for i in short] for k, v in b.items()}
        if not short:
            return b | {"x": [], "length": []}
        x, length, per = line_features(b["text"])
        cut = np.cumsum(per)
        parts = [slice(a, z) for a, z in zip(cut - per, cut, strict=True)]
        return {"doc_id": b["doc_id"], "quality": b["quality"], "x": [x[s].astype(np.float32).tobytes() for s in parts], "length": [length[s].tobytes() for s in parts]}

    got = sorted(map_batches(texts.select("doc_id", "quality", "text"), features, "doc_id long, quality int, x binary, length binary").collect())
    if not got:
        return LineField()
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), np.float32).astype(float).reshape(-1, FEATURES)
    length = np.frombuffer(b"".join(bytes(r["length"]) for r in got))
    per = np.array([len(r["length"]) // 8 for r in got])
    return LineField().fit(x, length, per, np.array([r["quality"] for r in got]))


def score(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of each whole text; a null text counts as empty.

    Null ids and repeated rows are kept; other columns are not read; no rows give no rows.
    """

    def rows(b: dict[str, list]) -> dict[str, list]:
        s = field.scores(b["text"]) if b["text"] else np.zeros(0)
        return {"doc_id": b["doc_id"], "score": s.tolist(), "predicted": [int(x >= CUT) for x in s]}

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), rows, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, field: LineField, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least 0.3, with all their columns."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for part in parts_of(batch):
                s = field.scores(part.column(part.schema.get_field_index(text_col)).to_pylist())
                yield part.filter(pa.array(s >= CUT))

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Score and decision of every whole text; a null text counts as empty, repeated and null ids are kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
