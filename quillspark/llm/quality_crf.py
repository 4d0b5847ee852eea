"""Quality classifier: a linear-chain conditional random field over lines, summed up to documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import arrow_map, chunks

#: Labelled rows that the field is fitted on (those of least hash), the only sample here.
SAMPLE = 4000
#: Lines, padding included, that pass through the field together at most, but for a longer text, which comes alone.
TOGETHER = 100_000
#: Rounds of fitting, step and pull towards zero; documents that pass through the field together.
EPOCHS, STEP, DECAY, GROUP = 40, 0.03, 1e-4, 256

#: The classes of bytes that features count.
_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&|<>@^~=+_\\/{}[]", b"!?", b".,;:'\"()-", b" \t\r\v\f", b"|")
_LUT = np.zeros((len(_CLASSES), 256), np.float32)
for _k, _c in enumerate(_CLASSES):
    _LUT[_k, list(_c)] = 1
#: Features of a line itself; each comes again for the line before and the line after, and there is a constant.
OWN = len(_CLASSES) + 7
WIDTH = 3 * OWN + 1


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines x WIDTH features, bytes of each line); the text alone decides."""
    lines = text.encode().split(b"\n")
    data = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    sizes = np.array([len(x) for x in lines])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    own = np.zeros((len(lines), OWN), np.float32)
    size = np.maximum(sizes, 1)
    for k in range(len(_CLASSES)):
        own[:, k] = np.add.reduceat(_LUT[k][data], starts) / size
    seen: set[bytes] = set()
    for n, line in enumerate(lines):
        words = line.split()
        m = len(words)
        own[n, -7] = min(m, 60) / 60
        own[n, -6] = m == 0
        own[n, -5] = len(line) / max(m, 1) / 10
        own[n, -4] = 1 - len(set(words)) / m if m else 0
        own[n, -3] = line in seen
        own[n, -2] = line[-1:] in (b".", b"!", b"?")
        own[n, -1] = m < 4
        seen.add(line)
    np.clip(own, -4, 4, own)
    near = np.zeros((len(lines) + 2, OWN), np.float32)
    near[1:-1] = own
    return np.hstack([own, near[:-2], near[2:], np.ones((len(lines), 1), np.float32)]), sizes + 1


def _pad(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    most = max(map(len, items))
    out = np.zeros((len(items), most, WIDTH), np.float32)
    there = np.zeros((len(items), most), bool)
    for k, x in enumerate(items):
        out[k, : len(x)] = x
        there[k, : len(x)] = True
    return out, there


def _lse(x: np.ndarray) -> np.ndarray:
    m = x.max(-1, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(-1, keepdims=True)))[..., 0]


def marginals(scores: np.ndarray, there: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of (bad, good) of each line, and expected moves between neighbours, by forward-backward."""
    n, t, _ = scores.shape
    ahead, back = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0]
    for k in range(1, t):
        new = _lse(ahead[:, k - 1][:, None, :] + move.T[None]) + scores[:, k]
        ahead[:, k] = np.where(there[:, k, None], new, ahead[:, k - 1])
    for k in range(t - 2, -1, -1):
        new = _lse((scores[:, k + 1] + back[:, k + 1])[:, None, :] + move[None])
        back[:, k] = np.where(there[:, k + 1, None], new, 0)
    total = _lse(ahead[:, -1])
    one = np.exp(ahead + back - total[:, None, None])
    pair = ahead[:, :-1, :, None] + move[None, None] + (scores + back)[:, 1:, None, :] - total[:, None, None, None]
    pair = np.where(there[:, 1:, None, None], np.exp(np.minimum(pair, 0)), 0)
    return one, pair


def fit(examples: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(weights of (bad, good), moves): a line's label is its document's; likelihood is climbed by Adam."""
    w, move = np.zeros((WIDTH, 2)), np.zeros((2, 2))
    rng = np.random.default_rng(5)
    order = sorted(range(len(examples)), key=lambda k: len(examples[k][0]))
    groups: list[list[int]] = []
    for k in order:  # by length, so the last one is the longest
        if not groups or len(groups[-1]) == GROUP or (len(groups[-1]) + 1) * len(examples[k][0]) > TOGETHER:
            groups.append([])
        groups[-1].append(k)
    m = [np.zeros_like(w), np.zeros_like(move)]
    v = [np.zeros_like(w), np.zeros_like(move)]
    step = 0
    for _ in range(EPOCHS):
        for g in rng.permutation(len(groups)):
            x, there = _pad([examples[k][0] for k in groups[g]])
            y = np.array([examples[k][1] for k in groups[g]])
            one, pair = marginals(x @ w, there, move)
            want = np.zeros_like(one)
            want[np.arange(len(y)), :, y] = 1
            lines = there.sum()
            # Documents weigh alike, whatever their lengths.
            share = (there / there.sum(1, keepdims=True))[..., None]
            gw = np.einsum("ntf,ntk->fk", x, (want - one) * share) / len(y) - DECAY * w
            wish = np.zeros((2, 2))
            np.add.at(wish, (y, y), there.sum(1) - 1)
            gm = (wish - pair.sum((0, 1))) / lines - DECAY * move
            step += 1
            for p, grad, a, b in ((w, gw, m[0], v[0]), (move, gm, m[1], v[1])):
                a += 0.1 * (grad - a)
                b += 0.01 * (grad**2 - b)
                p += STEP * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return w, np.clip(move, -2, 2)


def score(texts: list[str], w: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The chance of a good line, averaged over a text's lines by their bytes."""
    found = [line_features(t) for t in texts]
    out = np.zeros(len(texts))
    order = sorted(range(len(texts)), key=lambda k: len(found[k][0]))
    at = 0
    while at < len(order):
        longest, n = 0, 0
        while at + n < len(order) and n < GROUP and (n == 0 or (n + 1) * len(found[order[at + n]][0]) < TOGETHER):
            n += 1
        part = order[at : at + n]
        longest = max(len(found[k][0]) for k in part)
        scores, there = np.zeros((n, longest, 2)), np.zeros((n, longest), bool)
        for r, k in enumerate(part):
            scores[r, : len(found[k][0])] = found[k][0] @ w
            there[r, : len(found[k][0])] = True
        one, _ = marginals(scores, there, move)
        for r, k in enumerate(part):
            size = found[k][1]
            out[k] = (one[r, : len(size), 1] * size).sum() / size.sum()
        at += n
    return np.clip(out, 0, 1)


def _scores(model: tuple[np.ndarray, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches):
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score(b.column(2).to_pylist(), *model), pa.float64())], names=["doc_id", "held_out", "score"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """The field, fitted on all lines of at most *sample* labelled ids that aren't held out."""
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id").select("text", "quality", F.xxhash64("doc_id", "text").alias("at"))
    return fit([(line_features(r[0])[0], int(r[1])) for r in texts.orderBy("at").toLocalIterator()])


def held_out(doc_id: F.Column) -> F.Column:
    """Whether the id's hash sets a row aside; a null id does as its text would be empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def quality_crf(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row of *docs*: doc_id, held_out, score (0 to 1, higher for better) and predicted (score >= 0.3).

    The field sees a text's lines and their neighbours alone. Labels come from rows that aren't held out; a row
    labelled more than once has its worst label. Without usable labels all scores are 0.5. Null texts count as empty and are
    scored as one empty line; repeated rows are scored each; null ids are held out, as their hash says.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    out = arrow_map(rows, lambda it: _scores(model.value, it), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
