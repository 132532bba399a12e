"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in NumPy by backpropagation through time on a bounded sample of labelled rows. It labels every
byte of every text; a document's probabilities are the mean of its positions'. Texts are cut into segments that start
with a few bytes of their neighbour, so that states are warm where they count, and all segments of a batch are run as
one array.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, reject boolean"
UNKNOWN = "und"
#: Bytes of a segment, bytes of warm-up before it, and segments run at once.
SEGMENT, WARM, AT_ONCE = 256, 16, 4096
#: Labelled rows learned from, at most, for each language and in all, and the characters taken of each, at a hashed place.
SAMPLE, TOTAL, CROP = 1500, 300_000, 128
#: Languages at most: the network has an output for each, and its weights are in the memory of every task.
LANGUAGES = 1000
HIDDEN, STEPS, BATCH, SPAN, RATE = 8, 240, 192, 64, 0.02
#: A document is rejected whose best language's probability is less than this above chance, as a share of what it could be:
#: with four languages, one that has no language for half of its positions.
LEAST = 1 / 3
PAD = 256


@dataclass
class Network:
    """x: what a byte adds to the gates (update, reset, candidate); u: what the state adds; both for two directions."""

    languages: list[str]
    x: np.ndarray
    u: np.ndarray
    v: np.ndarray
    c: np.ndarray

    @classmethod
    def new(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        n = len(languages)
        return cls(languages, draw(2, PAD + 1, 3 * hidden, scale=0.3), draw(2, hidden, 3 * hidden, scale=0.3), draw(2, hidden, n, scale=0.3), np.zeros(n, np.float32))


def _sigmoid(a: np.ndarray) -> np.ndarray:
    a *= 0.5
    np.tanh(a, out=a)
    a += 1
    a *= 0.5
    return a


def _step(net: Network, seen: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """seen: (2, rows) bytes. Gives the new states, gates, candidate and what the state added to it."""
    k = h.shape[2]
    gate = np.matmul(h, net.u)
    took = np.stack([net.x[0].take(seen[0], 0), net.x[1].take(seen[1], 0)])
    gate[..., : 2 * k] += took[..., : 2 * k]
    _sigmoid(gate[..., : 2 * k])
    z, r, added = gate[..., :k], gate[..., k : 2 * k], gate[..., 2 * k :]
    new = np.tanh(took[..., 2 * k :] + r * added)
    return new + z * (h - new), z, r, new, added


def _softmax(a: np.ndarray) -> np.ndarray:
    a = np.exp(a - a.max(-1, keepdims=True))
    return a / a.sum(-1, keepdims=True)


def gradients(net: Network, seen: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over all positions of seen (rows, span), and its gradients by x, u, v and c."""
    rows, span = seen.shape
    k = net.u.shape[1]
    order = np.stack([seen.T, seen.T[::-1]], 1)  # (span, 2, rows), each direction in its order
    inside = (order != PAD)[..., None]  # a state outside the text is zero
    h = np.zeros((span + 1, 2, rows, k), np.float32)
    kept = []
    for t in range(span):
        new, *gates = _step(net, order[t], h[t])
        h[t + 1] = new * inside[t]
        kept.append(gates)
    out = np.stack([h[1:, 0], h[1:, 1][::-1]], 1)  # by position
    prob = _softmax(np.einsum("tdbk,dkl->tbl", out, net.v) + net.c)
    real = (seen.T != PAD)[..., None]
    count = max(1, int(real.sum()))
    loss = -float((np.log(prob[:, np.arange(rows), label] + 1e-9) * real[..., 0]).sum()) / count
    prob[:, np.arange(rows), label] -= 1
    d = prob * real / np.float32(count)
    dv, dc = np.einsum("tdbk,tbl->dkl", out, d), d.sum((0, 1))
    back = np.einsum("tbl,dkl->tdbk", d, net.v)
    back[:, 1] = back[::-1, 1].copy()
    du, dx, down = np.zeros_like(net.u), np.zeros_like(net.x), np.zeros((2, rows, k), np.float32)
    for t in reversed(range(span)):
        z, r, new, added = kept[t]
        down = (down + back[t]) * inside[t]
        into = down * (1 - z) * (1 - new * new)
        gate = np.concatenate([down * (h[t] - new) * z * (1 - z), into * added * r * (1 - r), into], 2)
        for side in (0, 1):
            np.add.at(dx[side], order[t, side], gate[side])
        gate[..., 2 * k :] *= r
        du += np.matmul(h[t].transpose(0, 2, 1), gate)
        down = down * z + np.matmul(gate, net.u.transpose(0, 2, 1))
    return loss, [dx, du, dv, dc]


def train(texts: list[str], langs: list[str], steps: int = STEPS, seed: int = 7) -> Network:
    """Adam on random spans of the texts; each language is drawn equally often."""
    names = sorted(set(langs))
    net = Network.new(names, seed=seed)
    if len(names) < 2:
        return net
    rng = np.random.default_rng(seed)
    raw = [np.frombuffer(t.encode()[: 4 * CROP], np.uint8).astype(np.int16) for t in texts]
    of = [np.array([i for i, x in enumerate(langs) if x == n]) for n in names]
    weights = [net.x, net.u, net.v, net.c]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        label = rng.integers(0, len(names), BATCH)
        seen = np.full((BATCH, SPAN), PAD, np.int16)
        for row, lang in enumerate(label):
            own = raw[rng.choice(of[lang])]
            at = rng.integers(0, max(1, len(own) - SPAN + 1))
            part = own[at : at + SPAN]
            seen[row, : len(part)] = part
        _, grads = gradients(net, seen, label)
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        for w, g, a, b in zip(weights, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return net


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """(texts, languages): the mean probabilities of each text's positions; rows of empty texts are zero."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    parts = -(-size // SEGMENT)
    total = np.zeros((len(texts), len(net.languages)))
    owner = np.repeat(np.arange(len(texts)), parts)
    if not owner.size:
        return total
    start = np.cumsum(size) - size
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    left = piece * SEGMENT
    # Space on both sides of all bytes, so that warm-up never runs out of the array.
    flat = np.full(int(size.sum()) + 2 * (SEGMENT + WARM), PAD, np.int16)
    flat[SEGMENT + WARM : SEGMENT + WARM + int(size.sum())] = np.frombuffer(b"".join(texts), np.uint8)
    k = net.u.shape[1]
    for a in range(0, len(owner), AT_ONCE):
        own = owner[a : a + AT_ONCE]
        at = left[a : a + AT_ONCE, None] + np.arange(-WARM, SEGMENT + WARM)
        seen = np.where((at >= 0) & (at < size[own, None]), flat[start[own, None] + at + SEGMENT + WARM], PAD)
        span = int(min(SEGMENT, (size[own] - left[a : a + AT_ONCE]).max()))
        seen = np.ascontiguousarray(seen[:, : WARM + span + WARM].T)
        outside = seen == PAD
        some = outside.any(1)
        h = np.zeros((2, len(own), k), np.float32)
        logits = np.zeros((span, len(own), len(net.languages)), np.float32)
        for t in range(WARM + span):
            h = _step(net, (seen[t], seen[-1 - t]), h)[0]
            for side, at_t in ((0, t), (1, -1 - t)):
                if some[at_t]:
                    h[side, outside[at_t]] = 0
            if t >= WARM:
                logits[t - WARM] += h[0] @ net.v[0]
                logits[span - 1 - (t - WARM)] += h[1] @ net.v[1]
        logits += net.c
        real = ~outside[WARM : WARM + span]
        sums = np.zeros((len(own), len(net.languages)))
        for t in range(0, span, 32):
            prob = _softmax(logits[t : t + 32])
            sums += (prob * real[t : t + 32, :, None]).sum(0)
        np.add.at(total, own, sums)
    return total / np.maximum(size, 1)[:, None]


def fold(doc_id: str, parts: int):
    """The remainder of an id's checksum; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def sample(docs: DataFrame, doc_id: str, text: str, lang: str, parts: int, per_language: int = SAMPLE) -> list[tuple[str, str]]:
    """(text part, language) of labelled rows outside fold 0: those with the least hashes, and of each a part at a hashed place."""
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l"))
    rows = rows.filter(F.col("l").isNotNull() & (fold("i", parts) != 0)).withColumn("h", F.xxhash64("i", F.lit("sample")))
    counts = rows.groupBy("l").count().limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"there may be {LANGUAGES} languages at most")
    if not counts:
        return []
    per_language = min(per_language, max(1, TOTAL // len(counts)))
    # A share of each language's rows that leaves a few times too many; then the least hashes.
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["l"], min(1.0, 4.0 * per_language / r["count"]))])
    rows = rows.filter(F.col("h") / F.lit(2.0**64) + 0.5 < share[F.col("l")]).filter(F.length("t") > 0)
    place = (F.pmod(F.xxhash64("i", F.lit("place")), F.greatest(F.lit(1), F.length("t") - CROP + 1)) + 1).cast("int")
    rows = rows.select("l", "h", F.substring(F.col("t"), place, F.lit(CROP)).alias("t"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))).filter(F.col("n") <= per_language)
    return [(r["t"], r["l"]) for r in sorted(rows.select("t", "l", "n").collect(), key=lambda r: (r["l"], r["n"]))]


def rejected(score: float, languages: int, least: float = LEAST) -> bool:
    """Whether a document's best probability is too little above chance; 0 always is."""
    chance = 1 / languages if languages > 1 else 0.0
    return score <= 0 or score - chance < least * (1 - chance) and languages > 1


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", parts: int = 5, per_language: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, reject.

    Learns from rows with a language whose id's checksum has a remainder other than 0 by parts; at most per_language
    rows of each language, and TOTAL // languages if that is less, chosen by hash: a bound on what the driver holds, that
    leaves no language out; more than LANGUAGES of them are an error. Predictions use whole texts alone, of any length. A null text or one without a letter is
    `und` with score 0, and rejected; so is a text whose best language is less than `least` above chance. Without
    labelled rows every text is `und`. No shuffle but the sample's. Repeated rows give repeated results; an empty table
    gives no rows; other columns aren't read, whatever their names.
    """
    predict, languages = _predictor(docs, doc_id, text, lang, parts, per_language)

    def run(batches):
        for batch in batches:
            names, scores = predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array([rejected(s, languages, least) for s in scores], pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "reject"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), (fold(doc_id, parts) == 0).alias("held_out"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", parts: int = 5, per_language: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """The rows that identify() doesn't reject, with all their columns, whatever their names.

    Rows without text or letters go, and so do all rows where there is nothing to learn from. Repeated rows are judged
    alike. An empty table stays empty.
    """
    (predict, languages), place = _predictor(docs, doc_id, text, lang, parts, per_language), docs.columns.index(text)

    def run(batches):
        for batch in batches:
            _, scores = predict(batch.column(place).to_pylist())
            yield batch.filter(pa.array([not rejected(s, languages, least) for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _predictor(docs: DataFrame, doc_id: str, text: str, lang: str, parts: int, per_language: int):
    """A trained function from texts to names and scores, and how many languages it knows."""
    labelled = sample(docs, doc_id, text, lang, parts, per_language)
    net = train([t for t, _ in labelled], [n for _, n in labelled])

    def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        which = [i for i, t in enumerate(texts) if net.languages and t is not None and any(map(str.isalpha, t))]
        if which:
            for i, p in zip(which, pooled(net, [texts[i].encode("utf-8", "surrogatepass") for i in which]), strict=True):
                best = int(p.argmax())
                names[i], scores[i] = net.languages[best], float(min(1.0, p[best]))
        return names, scores

    return predict, len(net.languages)
