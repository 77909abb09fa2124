"""Language identification with a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation
through time.

A text is cut into pieces of ``PIECE`` bytes, all of them. Two recurrent layers read a piece from either end; at every
position both states give a probability for each language. A document's probability of a language is the mean over all
its positions, its prediction the most probable language and the score that probability.

The network is fitted on the driver on a bounded sample: of each language at most ``SAMPLE_DOCUMENTS`` labelled documents in
the order of a hash of doc_id, and of each at most ``SAMPLE_PIECES`` pieces, evenly spread over the whole text. Documents
whose crc32(doc_id as text) is divisible by 5 are held out. Prediction reads nothing but the text.

Defined cases: ``und`` with score 0 for a null text and for a text without letters, and for all where no document is
labelled. A row without doc_id counts as held out. Rows are judged one by one, so repeated rows get equal results; other
columns are kept by ``accepted``, ignored by ``identify``. An empty table gives no rows."""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from appconv.llm.common import batches_by_bytes, table

FOLDS = 5
SAMPLE_DOCUMENTS = 300
SAMPLE_PIECES = 4
PIECE = 96
UNITS = 12
UPDATES = 160
LANES = 256
RATE = 0.02
# A document is accepted in a language that has at least half of the probability over its positions; below that no language
# has the majority.
LEAST_SCORE = 0.5
UNKNOWN = "und"
_SEED = 7
_READ_LANES = 1024

PREDICTED = "lang_pred string, score double"


class Network(NamedTuple):
    languages: list[str]
    weights: dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _forward(weights: dict[str, np.ndarray], side: str, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States at every position of x (positions, lanes); with ``keep`` also what the way back needs."""
    units = weights[f"u_{side}"].shape[0]
    inputs, recurrent, bias = weights[f"w_{side}"], weights[f"u_{side}"], weights[f"b_{side}"]
    state = np.zeros((x.shape[1], units), np.float32)
    states, kept = np.empty((x.shape[0], x.shape[1], units), np.float32), []
    for t in range(x.shape[0]):
        given, held = inputs[x[t]], state @ recurrent + bias
        gates = _sigmoid(given[:, : 2 * units] + held[:, : 2 * units])
        update, reset = gates[:, :units], gates[:, units:]
        new = np.tanh(given[:, 2 * units :] + reset * held[:, 2 * units :])
        if keep:
            kept.append((state, update, reset, new, held[:, 2 * units :]))
        state = new + update * (state - new)
        states[t] = state
    return states, kept


def _backward(weights: dict[str, np.ndarray], side: str, x: np.ndarray, kept: list, d_states: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients by going back through time."""
    inputs, recurrent = weights[f"w_{side}"], weights[f"u_{side}"]
    d_inputs, d_recurrent = np.zeros_like(inputs), np.zeros_like(recurrent)
    d_bias = np.zeros_like(weights[f"b_{side}"])
    d_state = np.zeros_like(d_states[0])
    for t in range(x.shape[0] - 1, -1, -1):
        before, update, reset, new, held = kept[t]
        d_state = d_state + d_states[t]
        d_new = d_state * (1 - update) * (1 - new * new)
        d_update = d_state * (before - new) * update * (1 - update)
        d_reset = d_new * held * reset * (1 - reset)
        d_given = np.concatenate([d_update, d_reset, d_new], axis=1)
        d_held = np.concatenate([d_update, d_reset, d_new * reset], axis=1)
        np.add.at(d_inputs, x[t], d_given)
        d_recurrent += before.T @ d_held
        d_bias += d_held.sum(axis=0)
        d_state = d_state * update + d_held @ recurrent.T
    return {f"w_{side}": d_inputs, f"u_{side}": d_recurrent, f"b_{side}": d_bias}


def _probabilities(weights: dict[str, np.ndarray], ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
    scores = ahead @ weights["v_ahead"] + back @ weights["v_back"] + weights["c"]
    scores = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return scores / scores.sum(axis=-1, keepdims=True)


def position_probabilities(weights: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """x (positions, lanes) of bytes -> (positions, lanes, languages)."""
    ahead, _ = _forward(weights, "ahead", x)
    back, _ = _forward(weights, "back", x[::-1])
    return _probabilities(weights, ahead, back[::-1])


def gradients(weights: dict[str, np.ndarray], x: np.ndarray, labels: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
    """Mean loss over the positions and its gradients."""
    ahead, kept_ahead = _forward(weights, "ahead", x, True)
    back, kept_back = _forward(weights, "back", x[::-1], True)
    back = back[::-1]
    p = _probabilities(weights, ahead, back)
    lanes = np.arange(labels.size)
    count = mask.sum()
    loss = -(np.log(p[:, lanes, labels] + 1e-12) * mask).sum() / count
    d = p.copy()
    d[:, lanes, labels] -= 1
    d *= (mask / count)[:, :, None]
    flat = d.reshape(-1, d.shape[-1])
    out = {
        "v_ahead": ahead.reshape(flat.shape[0], -1).T @ flat,
        "v_back": back.reshape(flat.shape[0], -1).T @ flat,
        "c": flat.sum(axis=0),
    }
    out |= _backward(weights, "ahead", x, kept_ahead, d @ weights["v_ahead"].T)
    out |= _backward(weights, "back", x[::-1], kept_back, (d @ weights["v_back"].T)[::-1])
    return float(loss), out


def start_weights(languages: int, units: int = UNITS, seed: int = _SEED) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    weights = {"c": np.zeros(languages, np.float32)}
    for side in ("ahead", "back"):
        weights[f"w_{side}"] = draw.normal(0, 0.3, (256, 3 * units)).astype(np.float32)
        weights[f"u_{side}"] = draw.normal(0, units**-0.5, (units, 3 * units)).astype(np.float32)
        weights[f"b_{side}"] = np.zeros(3 * units, np.float32)
        weights[f"v_{side}"] = draw.normal(0, units**-0.5, (units, languages)).astype(np.float32)
    return weights


def pieces(text: str) -> np.ndarray:
    """All bytes of a text as rows of ``PIECE``, the last filled up with zeros."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(-(-data.size // PIECE) * PIECE, np.uint8)
    out[: data.size] = data
    return out.reshape(-1, PIECE)


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], updates: int = UPDATES) -> Network:
    """rows (pieces, PIECE) of bytes with the number of their language."""
    weights = start_weights(len(languages))
    draw = np.random.default_rng(_SEED)
    mean = {k: np.zeros_like(v) for k, v in weights.items()}
    square = {k: np.zeros_like(v) for k, v in weights.items()}
    share = 1 / np.bincount(labels, minlength=len(languages))[labels]
    for step in range(1, updates + 1):
        # Every language gets as many lanes, however many pieces it has.
        chosen = draw.choice(labels.size, LANES, p=share / share.sum())
        x = np.ascontiguousarray(rows[chosen].T)
        _, found = gradients(weights, x, labels[chosen], (x > 0).astype(np.float32))
        norm = np.sqrt(sum(float((g * g).sum()) for g in found.values()))
        rate = RATE * min(1.0, 2 * (1 - step / (updates + 1)))
        for k, g in found.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            weights[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return Network(languages, {k: v.astype(np.float32) for k, v in weights.items()})


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _sample_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for lang, order, text in zip(batch["lang"], batch["place"], batch["text"], strict=True):
            own = pieces(text)
            take = np.unique(np.linspace(0, own.shape[0] - 1, SAMPLE_PIECES).astype(int))
            rows += [(lang, order, own[k].tobytes()) for k in take]
        yield pd.DataFrame(rows, columns=["lang", "place", "bytes"])


def fit(documents: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS) -> Network:
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    labelled = documents.filter(F.col("lang").isNotNull() & ~held_out() & (F.length("text") > 0)).select("doc_id", "lang", "text")
    # Few rows by language, whatever the size of the corpus: only hashes small enough for twice the sample go on to be ordered.
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("documents")).collect()
    if not sizes:
        return Network([], {})
    reach = {r["lang"]: 2 * sample_documents / r["documents"] if r["documents"] > 10 * sample_documents else 1.0 for r in sizes}
    limits = F.create_map(*[F.lit(x) for lang, share in reach.items() for x in (lang, share * float(1 << 63))])
    near = labelled.withColumn("hash", place).filter(F.col("hash") <= limits[F.col("lang")])
    order = Window.partitionBy("lang").orderBy("hash", "doc_id", F.xxhash64("text"))
    first = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= sample_documents)
    sample = first.mapInPandas(_sample_pieces, "lang string, place int, bytes binary").collect()
    sample = sorted((r.lang, r.place, bytes(r.bytes)) for r in sample)
    languages = sorted({lang for lang, _, _ in sample})
    if not languages:
        return Network([], {})
    rows = np.frombuffer(b"".join(b for _, _, b in sample), np.uint8).reshape(-1, PIECE)
    labels = np.array([languages.index(lang) for lang, _, _ in sample])
    return train(rows, labels, languages)


def has_letter(text: str) -> bool:
    """A character of Unicode's letter categories; numbers in other shapes (², ½, ①, Ⅻ) are none."""
    return any(map(str.isalpha, text))


def predict(network: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    open_ = [k for k, t in enumerate(texts) if t and has_letter(t)] if network.languages else []
    sums = np.zeros((len(open_), len(network.languages)))
    size = np.zeros(len(open_))
    held: list[np.ndarray] = []
    owner: list[np.ndarray] = []

    def read() -> None:
        rows, of = np.concatenate(held), np.concatenate(owner)
        for k in range(0, rows.shape[0], _READ_LANES):
            x = np.ascontiguousarray(rows[k : k + _READ_LANES].T)
            p = position_probabilities(network.weights, x) * (x > 0)[:, :, None]
            np.add.at(sums, of[k : k + _READ_LANES], p.sum(axis=0))
            np.add.at(size, of[k : k + _READ_LANES], (x > 0).sum(axis=0))
        held.clear()
        owner.clear()

    lanes = 0
    for place, k in enumerate(open_):
        own = pieces(texts[k])
        held.append(own)
        owner.append(np.full(own.shape[0], place))
        lanes += own.shape[0]
        if lanes >= 16 * _READ_LANES:
            read()
            lanes = 0
    if held:
        read()
    for place, k in enumerate(open_):
        best = int(sums[place].argmax())
        names[k], scores[k] = network.languages[best], min(1.0, float(sums[place, best] / max(1.0, size[place])))
    return names, scores


def predictor(network: Network) -> Column:
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            names, scores = predict(network, batch.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": np.array(scores, "float64")})

    return F.pandas_udf(run, PREDICTED)(F.col("text"))


def identify(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text, lang) -> doc_id, held_out, lang_pred, score."""
    found = documents.select("doc_id", held_out().alias("held_out"), predictor(fit(documents)).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def accepted(documents: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents in a learned language, with their own columns."""
    batches_by_bytes(documents.sparkSession)
    name = "found"
    while name in documents.columns:
        name += "_"
    found = documents.withColumn(name, predictor(fit(documents)))
    return found.filter((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= least_score)).drop(name)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
