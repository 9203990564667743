"""Language identification with a bidirectional gated recurrent network over bytes.

A text is read in windows of WINDOW bytes, the state starting anew in each. Every byte moves a
forward and a backward gated recurrent unit (HIDDEN wide each); the two states at a position
give it a distribution over the languages (the position's label), and a document's
probabilities are the mean over all positions of its whole text. Training is plain numpy:
backpropagation through time with Adam, on TRAIN_WINDOWS windows of each of at most TRAIN_DOCS
labelled documents, drawn by hash and spread over the languages (the documented bound of the fit);
the trained weights, a few thousand numbers, are sent to the tasks that read the texts. The
windows of the training documents are all that goes to the driver. Documents are never shuffled.

Defined results: `und` with score 0 if a text is null or has no letter; without any labelled
document every text is `und`; repeated rows get the same result. Equal probabilities go to the
first language by name. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from evidence_surface.llm.words import buffers, slices

WINDOW = 64
HIDDEN = 8
TRAIN_DOCS = 2000
TRAIN_WINDOWS = 4  # of each training document, spread evenly
EPOCHS = 6
BATCH = 256
RATE = 0.02
LANES = 1024  # windows that a task carries through the network at once
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Unit:
    """One gated recurrent unit: `table` has the input part of the gates for each byte (256 and
    one more for padding): update, reset, candidate."""

    def __init__(self, rng: np.random.Generator):
        self.table = (rng.standard_normal((257, 3 * HIDDEN)) * 0.3).astype(np.float32)
        self.gates = (rng.standard_normal((HIDDEN, 2 * HIDDEN)) * 0.3).astype(np.float32)
        self.candidate = (rng.standard_normal((HIDDEN, HIDDEN)) * 0.3).astype(np.float32)
        self.weights = [self.table, self.gates, self.candidate]

    def forward(self, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of (steps, lanes) bytes; what `backward` needs goes to `keep`."""
        steps, lanes = codes.shape
        state = np.zeros((lanes, HIDDEN), np.float32)
        out = np.empty((steps, lanes, HIDDEN), np.float32)
        for t in range(steps):
            given = self.table[codes[t]]
            both = _sigmoid(given[:, : 2 * HIDDEN] + state @ self.gates)
            update, reset = both[:, :HIDDEN], both[:, HIDDEN:]
            new = np.tanh(given[:, 2 * HIDDEN :] + (reset * state) @ self.candidate)
            if keep is not None:
                keep.append((codes[t], state, update, reset, new))
            state = state + update * (new - state)
            out[t] = state
        return out

    def backward(self, keep: list, above: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weights, from the gradients of all states."""
        table, gates, candidate = (np.zeros_like(w) for w in self.weights)
        after = np.zeros_like(above[0])
        for t in range(len(keep) - 1, -1, -1):
            codes, state, update, reset, new = keep[t]
            after = after + above[t]
            d_new = after * update * (1 - new * new)
            d_update = after * (new - state) * update * (1 - update)
            held = d_new @ self.candidate.T
            d_reset = held * state * reset * (1 - reset)
            d_both = np.concatenate([d_update, d_reset], axis=1)
            candidate += (reset * state).T @ d_new
            gates += state.T @ d_both
            np.add.at(table, codes, np.concatenate([d_both, d_new], axis=1))
            after = after * (1 - update) + held * reset + d_both @ self.gates.T
        return [table, gates, candidate]


class Network:
    """Two units and the weights of the positions' labels."""

    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages, self.ahead, self.back = languages, Unit(rng), Unit(rng)
        self.label = (rng.standard_normal((2 * HIDDEN, len(languages))) * 0.3).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [*self.ahead.weights, *self.back.weights, self.label, self.bias]

    def positions(self, codes: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(states, probabilities) of each position of (steps, lanes) bytes; 256 is padding."""
        ahead = self.ahead.forward(codes, keep and keep[0])
        back = self.back.forward(codes[::-1], keep and keep[1])[::-1]
        states = np.concatenate([ahead, back], axis=2)
        scores = states @ self.label + self.bias
        scores -= scores.max(axis=2, keepdims=True)
        np.exp(scores, out=scores)
        return states, scores / scores.sum(axis=2, keepdims=True)

    def gradients(self, codes: np.ndarray, wanted: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over positions and its gradients; `wanted`: a language for each lane."""
        keep: tuple[list, list] = ([], [])
        states, probability = self.positions(codes, keep)
        real = (codes < 256).astype(np.float32)
        each = real / real.sum()
        lanes = np.arange(codes.shape[1])
        loss = -float((np.log(np.maximum(probability[:, lanes, wanted], 1e-12)) * each).sum())
        d_scores = probability
        d_scores[:, lanes, wanted] -= 1
        d_scores *= each[:, :, None]
        flat = d_scores.reshape(-1, len(self.languages))
        label, bias = states.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(axis=0)
        above = d_scores @ self.label.T
        ahead = self.ahead.backward(keep[0], above[:, :, :HIDDEN])
        back = self.back.backward(keep[1], above[::-1, :, HIDDEN:])
        return loss, [*ahead, *back, label, bias]


def _windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, text) first bytes of all windows of all texts, and the text of each."""
    many = -(-np.diff(offsets) // WINDOW)
    text = np.repeat(np.arange(len(many)), many)
    first = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    return offsets[text] + first * WINDOW, text


def _codes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """(steps, windows) of bytes, 256 beyond a text's end."""
    at = starts[None, :] + np.arange(WINDOW)[:, None]
    inside = at < stops[None, :]
    return np.where(inside, data[np.minimum(at, len(data) - 1)].astype(np.int64), 256)


def train(pieces: list[bytes], langs: list[str], seed: int = 0, epochs: int = EPOCHS) -> Network:
    """`pieces`: windows of at most WINDOW bytes; `langs`: the language of each."""
    languages = sorted(set(langs))
    network, rng = Network(languages, seed), np.random.default_rng(seed)
    if not pieces:
        return network
    sizes = np.array([len(p) for p in pieces])
    stops = np.cumsum(sizes)
    codes = _codes(np.frombuffer(b"".join(pieces), np.uint8), stops - sizes, stops)
    wanted = np.searchsorted(languages, np.array(langs))
    weights = network.weights()
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    batches = -(-len(pieces) // BATCH)
    step, steps = 0, epochs * batches
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(pieces)), batches):
            _, gradients = network.gradients(codes[:, part], wanted[part])
            step += 1
            rate = RATE * (1 - 0.9 * step / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for w, g, m, s in zip(weights, gradients, mean, square):
                np.clip(g, -1, 1, out=g)
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= (rate * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
    return network


class _Reader:
    """A trained unit laid out for reading only: one row per gate, one column per window."""

    def __init__(self, unit: Unit):
        self.table, self.gates, self.candidate = (np.ascontiguousarray(w.T) for w in unit.weights)

    def states(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        """State after each of (steps, lanes) bytes, in order; the array is used again."""
        state = np.zeros((HIDDEN, codes.shape[1]), np.float32)
        given = np.empty((3 * HIDDEN, codes.shape[1]), np.float32)
        for row in codes:
            np.take(self.table, row, axis=1, out=given, mode="clip")
            both, new = given[: 2 * HIDDEN], given[2 * HIDDEN :]
            both += self.gates @ state
            both *= 0.5
            np.tanh(both, out=both)
            both *= 0.5
            both += 0.5
            new += self.candidate @ (both[HIDDEN:] * state)
            np.tanh(new, out=new)
            new -= state
            new *= both[:HIDDEN]
            state += new
            yield state


def pooled(network: Network, texts: pa.Array) -> np.ndarray:
    """Mean probabilities over the positions of each text; zero for empty ones."""
    data, offsets = buffers(texts)
    starts, text = _windows(data, offsets)
    total = np.zeros((len(texts), len(network.languages)))
    ahead, back = _Reader(network.ahead), _Reader(network.back)
    label, bias = np.ascontiguousarray(network.label.T), network.bias[:, None]
    for a in range(0, len(starts), LANES):
        lanes = slice(a, a + LANES)
        codes = _codes(data, starts[lanes], offsets[text[lanes] + 1])
        forward = [s.copy() for s in ahead.states(codes)]
        sums = np.zeros((len(network.languages), codes.shape[1]), np.float32)
        for t, state in zip(range(WINDOW - 1, -1, -1), back.states(codes[::-1])):
            scores = label[:, :HIDDEN] @ forward[t] + label[:, HIDDEN:] @ state + bias
            scores -= scores.max(axis=0)
            np.exp(scores, out=scores)
            scores /= scores.sum(axis=0)
            scores *= codes[t] < 256
            sums += scores
        np.add.at(total, text[lanes], sums.T)
    return total / np.maximum(np.diff(offsets), 1)[:, None]


def _predict(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    network = sent.value
    for whole in batches:
        for batch in slices(whole, "text"):
            texts = batch.column("text")
            lettered = np.array([t is not None and _LETTER.search(t) is not None for t in texts.to_pylist()], bool)
            best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            if network is None:
                lettered[:] = False
            elif lettered.any():
                probability = pooled(network, texts)
                best, score = probability.argmax(axis=1), np.minimum(probability.max(axis=1), 1.0)
            named = [network.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(named, pa.string()),
                    pa.array(np.where(lettered, score, 0.0)),
                ],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )


def pieces(text: Column) -> Column:
    """TRAIN_WINDOWS windows of a text, or all it has if these are fewer, spread evenly."""
    data = text.cast("binary")
    many = F.ceil(F.octet_length(text) / WINDOW).cast("int")
    some = F.least(many, F.lit(TRAIN_WINDOWS))
    return F.transform(
        F.sequence(F.lit(0), some - 1),
        lambda o: F.substring(data, F.floor(o * many / some).cast("int") * WINDOW + 1, F.lit(WINDOW)),
    )


def quota(counts: list[int], most: int) -> int:
    """The greatest number of documents per language that keeps all below `most`, but 1 at least."""
    left, counts = most, sorted(counts)
    for i, count in enumerate(counts):
        each = left // (len(counts) - i)
        if count > each:
            return max(each, 1)
        left -= count
    return max([1, *counts])


def training_rows(
    labelled: DataFrame, most: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """doc_id, lang, pieces of the documents that train: of each language the same number, drawn
    by hash, or all it has. The windows are cut where the texts are read; nothing else leaves."""
    rows = labelled.where(F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0)).select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    each, space = quota(list(counts.values()), most), 1 << 40
    shares = [(lang, int(min(1.0, 1.2 * each / n + 20 / n) * space)) for lang, n in counts.items()]
    shares = labelled.sparkSession.createDataFrame(shares, "lang string, share long")
    spot = F.pmod(F.xxhash64("doc_id", "lang", "text"), F.lit(space))
    near = rows.withColumn("spot", spot).join(F.broadcast(shares), "lang").where(F.col("spot") <= F.col("share"))
    cut = near.select("doc_id", "lang", "spot", pieces(F.col("text")).alias("pieces"))
    first = Window.partitionBy("lang").orderBy("spot", "doc_id")
    return cut.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= each).select("doc_id", "lang", "pieces")


def fit(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> Network | None:
    """Trains on windows of at most TRAIN_DOCS of the rows of `labelled`, those with text and
    language; if there are more languages, on a document of each."""
    sample = training_rows(labelled, TRAIN_DOCS, id_col, text_col, lang_col).collect()
    sample.sort(key=lambda r: (str(r["doc_id"]), r["lang"], r["pieces"]))
    cut = [(bytes(p), r["lang"]) for r in sample for p in r["pieces"]]
    return train([p for p, _ in cut], [lang for _, lang in cut]) if cut else None


def predict_language(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, lang_pred, score. Documents whose
    crc32(id as text) mod 4 is 2 are held out of training."""
    held_out = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    network = fit(docs.where(~held_out), id_col, text_col, lang_col)
    sent = docs.sparkSession.sparkContext.broadcast(network)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(
        lambda b: _predict(b, sent), f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    )
