"""Language identification by a linear-chain conditional random field over words.

Each line of a text is a chain of words; each word gets a language. Emissions are weights of hashed
features: prefixes, suffixes, character n-grams, word length and the languages in whose lexicon the word
stands. Transition weights between languages are learned too. Forward-backward gives each word's
probabilities. ``predict`` derives two things from them: spans, the longest stretches of words whose likeliest
language is the same, and the text's language, the one with most expected words; its score is their share.

A run of letters of more than ``RUN_BYTES`` bytes, as in scripts written without spaces, is cut into
consecutive pieces of that length that are words of the chain like any other, so all of it is read.

Learning uses at most ``TRAIN_ROWS`` labelled rows per language, those of the smallest hash of their
identifier, and of each at most ``TRAIN_LINES`` lines spread evenly over the whole text, up to ``LINE_CHARS``
characters of each; the bounds are parameters, and only what they leave is brought to the driver. Every language
with a labelled row is learned; the weights sent to tasks are 256 KiB per language, whatever the number of rows.
Lines of different documents are put in one chain, so that switches between languages occur in learning as they
do in mixed text. Prediction covers every word of every text in map tasks.

Defined cases: null text or text without a letter is ``und`` with score 0; with nothing to learn from,
every text is; letters of unknown scripts get whatever language the learned weights favour; repeated rows
are each predicted; what is ``und`` has no spans; other columns pass through, result columns are named by the
caller's prefix, and one that is there already is an error.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm import words as W
from kinweave.llm.columns import let

TRAIN_ROWS = 150
TRAIN_LINES = 20
LINE_CHARS = 5000
#: Words of a line beyond which a chain for learning is cut into several.
TRAIN_CHAIN = 60
FEATURE_BITS = 16
EPOCHS = 4
#: Bytes of a run of letters that make one word.
RUN_BYTES = 64
#: Word emissions a task remembers.
_MEMORY = 200_000
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
_LETTER_IN_SPARK = r"[A-Za-z\x{80}-\x{10FFFF}]"
UNDETERMINED = "und"


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (features, languages)
    transitions: np.ndarray  # (from, to)
    start: np.ndarray
    lexicon: dict[str, tuple[int, ...]]

    def features(self, word: str) -> list[int]:
        return _features(word, self.lexicon)


def _features(word: str, lexicon: dict[str, tuple[int, ...]]) -> list[int]:
    """Slots of a word's features."""
    lower = word.lower()
    w = f"<{lower}>"
    known = lexicon.get(lower)
    names = [f"l{min(len(word), 12)}", *([f"x{known}"] if known else ["unlisted"]), *(f"in{language}" for language in known or ())]
    for k in range(2, min(5, len(w) + 1)):
        names += [f"p{w[:k]}", f"s{w[-k:]}"]
    names += {w[i:i + 3] for i in range(len(w) - 2)}
    crc, mask = zlib.crc32, (1 << FEATURE_BITS) - 1
    return [crc(x.encode()) & mask for x in sorted(set(names))]


def _forward_backward(pot: np.ndarray, step: np.ndarray, start: np.ndarray, first: np.ndarray, length: np.ndarray
                      ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward, backward, marginals) of all chains at once; chain c is rows ``first[c]`` to ``first[c] + length[c]``.

    ``pot`` holds exponentials of emissions; each row is scaled to one, which marginals do not notice.
    """
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    alive = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), "right")
    forward, backward = np.empty_like(pot), np.ones_like(pot)
    rows = first
    now = pot[rows] * start
    forward[rows] = now / now.sum(1, keepdims=True)
    for t in range(1, int(length[0])):
        rows = first[:alive[t]] + t
        now = (forward[rows - 1] @ step) * pot[rows]
        forward[rows] = now / now.sum(1, keepdims=True)
    for t in range(int(length[0]) - 2, -1, -1):
        rows = first[:alive[t + 1]] + t
        now = (backward[rows + 1] * pot[rows + 1]) @ step.T
        backward[rows] = now / now.sum(1, keepdims=True)
    marginal = forward * backward
    return forward, backward, marginal / marginal.sum(1, keepdims=True)


def _runs(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds) of runs of letters, long ones cut into pieces of whole characters."""
    starts, ends, bounds = W.find_words(body, offsets, W.LETTERS)
    pieces = -(-(ends - starts) // RUN_BYTES)
    if pieces.max(initial=1) == 1:
        return starts, ends, bounds
    upto = np.cumsum(pieces)
    inner = np.arange(upto[-1]) - np.repeat(upto - pieces, pieces)
    cut = np.repeat(starts, pieces) + RUN_BYTES * inner
    for _ in range(3):  # back to the first byte of a character
        cut[(inner > 0) & ((body[cut] & 0xC0) == 0x80)] -= 1
    stop = np.append(cut[1:], 0)
    stop[upto - 1] = ends
    return cut, stop, np.append(0, upto)[bounds]


def _learn_chains(rows: list[tuple[str, str]], lines: int) -> list[list[tuple[str, str]]]:
    """Chains of (word, language): lines of a document, each followed by a line of some other document."""
    pool: list[list[tuple[str, str]]] = []
    for text, language in rows:
        found = [x for x in text.split("\n") if _LETTER.search(x.encode())]
        chosen = found[::max(1, -(-len(found) // lines))]
        for line in chosen:
            body = np.frombuffer(line.encode(), np.uint8)
            starts, ends, _ = _runs(body, np.array([0, len(body)]))
            words = [body[a:b].tobytes().decode("utf-8", "ignore") for a, b in zip(starts, ends)]
            pool.extend([[(w, language) for w in words[i:i + TRAIN_CHAIN]] for i in range(0, len(words), TRAIN_CHAIN)])
    pool.sort(key=lambda c: zlib.crc32(" ".join(w for w, _ in c).encode()))
    half = len(pool) // 2
    return [a + b for a, b in zip(pool[:half], pool[half:])] + pool[2 * half:]


def learn(rows: list[tuple[str, str]], lines: int = TRAIN_LINES) -> Model | None:
    """Maximum likelihood by stochastic gradients with adaptive steps; None without any word."""
    chains = _learn_chains(sorted(rows), lines)
    if not chains:
        return None
    languages = sorted({language for _, language in rows})
    number = {x: i for i, x in enumerate(languages)}
    counts: dict[str, Counter] = {}
    for chain in chains:
        for word, language in chain:
            counts.setdefault(word.lower(), Counter())[number[language]] += 1
    lexicon = {w: tuple(sorted(k for k, n in c.items() if n >= 0.2 * c.total())) for w, c in counts.items() if c.total() >= 4}

    vocabulary = sorted({w for chain in chains for w, _ in chain})
    place = {w: i for i, w in enumerate(vocabulary)}
    slots = [_features(w, lexicon) for w in vocabulary]
    flat, begin = np.concatenate(slots), np.concatenate(([0], np.cumsum([len(s) for s in slots])))[:-1]
    n, size = len(languages), 1 << FEATURE_BITS
    weights, seen = np.zeros((size, n)), np.full((size, n), 1e-3)
    step, step_seen = np.zeros((n, n)), np.full((n, n), 1e-3)
    batch = 64
    batches = [chains[i:i + batch] for i in range(0, len(chains), batch)]
    for _ in range(EPOCHS):
        for part in batches:
            word = np.array([place[w] for chain in part for w, _ in chain])
            gold = np.array([number[x] for chain in part for _, x in chain])
            length = np.array([len(chain) for chain in part])
            first = np.cumsum(length) - length
            used, inverse = np.unique(word, return_inverse=True)
            emission = np.stack([weights[slots[w]].sum(0) for w in used])[inverse]
            pot = np.exp(emission - emission.max(1, keepdims=True))
            power = np.exp(step)
            forward, backward, marginal = _forward_backward(pot, power, np.ones(n), first, length)
            miss = -marginal
            miss[np.arange(len(gold)), gold] += 1
            per_word = np.zeros((len(used), n))
            np.add.at(per_word, inverse, miss)
            where = np.concatenate([slots[w] for w in used])
            spread = np.repeat(per_word, [len(slots[w]) for w in used], axis=0)
            touched, back = np.unique(where, return_inverse=True)
            slope = np.zeros((len(touched), n))
            np.add.at(slope, back, spread)
            slope = slope / len(part) - 1e-4 * weights[touched]
            seen[touched] += slope ** 2
            weights[touched] += 0.3 * slope / np.sqrt(seen[touched])
            inner = np.setdiff1d(np.arange(len(word)), first)
            joint = forward[inner - 1][:, :, None] * power * (pot[inner] * backward[inner])[:, None, :]
            expected = (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            observed = np.zeros((n, n))
            np.add.at(observed, (gold[inner - 1], gold[inner]), 1)
            slope = (observed - expected) / len(part) - 1e-3 * step
            step_seen += slope ** 2
            step += 0.3 * slope / np.sqrt(step_seen)
    return Model(languages, weights.astype(np.float32), np.exp(step).astype(np.float32), np.ones(n, np.float32), lexicon)


class _Labeller:
    """Languages of the words of whole texts under one model."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.place: dict[int, int] = {}
        self.emissions = np.zeros((1024, len(self.model.languages)), np.float32)

    def _learned(self, words: list[str]) -> np.ndarray:
        slots = [self.model.features(w) for w in words]
        begin = np.cumsum([0, *map(len, slots[:-1])])
        emission = np.add.reduceat(self.model.weights[np.concatenate(slots)], begin)
        return np.exp(np.maximum(emission - emission.max(1, keepdims=True), -30))

    def _potentials(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        unique, sample, inverse = np.unique(W.hash_words(body, starts, ends, W.LETTERS), return_index=True, return_inverse=True)
        if len(self.place) > _MEMORY:
            self._clear()
        keys = unique.tolist()
        new = [k for k, key in enumerate(keys) if key not in self.place]
        if new:
            words = [body[starts[sample[k]]:ends[sample[k]]].tobytes().decode("utf-8", "ignore") for k in new]
            n = len(self.place)
            self.place.update((keys[k], n + j) for j, k in enumerate(new))
            while n + len(new) > len(self.emissions):
                self.emissions = np.concatenate((self.emissions, np.zeros_like(self.emissions)))
            self.emissions[n:n + len(new)] = self._learned(words)
        return self.emissions[np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))][inverse]

    def marginals(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, bounds) of the words of some texts, and each word's probabilities of the languages."""
        starts, ends, bounds = _runs(body, offsets)
        if not len(starts):
            return starts, ends, bounds, np.zeros((0, len(self.model.languages)))
        breaks = np.union1d(np.searchsorted(starts, np.flatnonzero(body == 10)), bounds[:-1])
        breaks = breaks[breaks < len(starts)]
        length = np.diff(np.append(breaks, len(starts)))
        pot = self._potentials(body, starts, ends)
        return starts, ends, bounds, _forward_backward(pot, self.model.transitions, self.model.start, breaks, length)[2]


def _shares(bounds: np.ndarray, marginal: np.ndarray) -> np.ndarray:
    """Expected words of each language in each text, as shares; zero without words."""
    out = np.zeros((len(bounds) - 1, marginal.shape[1]))
    row = np.repeat(np.arange(len(out)), np.diff(bounds))
    for k in range(out.shape[1]):
        out[:, k] = np.bincount(row, marginal[:, k], len(out))
    return out / np.maximum(out.sum(1, keepdims=True), 1e-12)


def _stretches(body: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, marginal: np.ndarray
               ) -> tuple[np.ndarray, ...]:
    """(text, start, end, language, mean probability) of every longest stretch of words of one language, in code points of its text."""
    label = marginal.argmax(1)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    first = np.flatnonzero(np.append(True, (label[1:] != label[:-1]) | (row[1:] != row[:-1]))[:len(label)])
    last = np.append(first[1:], len(label))[:len(first)] - 1
    point = np.append(0, np.cumsum((body & 0xC0) != 0x80))
    sure = np.append(0.0, np.cumsum(marginal.max(1, initial=0)))
    of = row[first]
    base = point[offsets[of]]
    return of, point[starts[first]] - base, point[ends[last]] - base, label[first], np.minimum(1.0, (sure[last + 1] - sure[first]) / (last + 1 - first))


def _lines(text: Column, lines: int, chars: int) -> Column:
    """Lines with a letter, at most ``lines`` spread evenly over the text and ``chars`` characters of each."""
    found = F.filter(F.split(text, "\n"), lambda x: x.rlike(_LETTER_IN_SPARK))
    chosen = let(found, lambda x: F.filter(x, lambda _, i: i % F.greatest(F.lit(1), F.ceil(F.size(x) / lines)) == 0))
    return F.array_join(F.transform(chosen, lambda x: F.substring(x, 1, chars)), "\n")


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        rows_per_language: int = TRAIN_ROWS, lines_per_row: int = TRAIN_LINES, line_chars: int = LINE_CHARS) -> Model | None:
    """Model of the languages of ``labelled``, from the bounded sample described above."""
    known = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    counts = known.groupBy("l").count().collect()
    if not counts:
        return None
    # Twice the share of rows that is wanted, so that hardly ever too few pass; then exactly the smallest hashes.
    draw = F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(1 << 40))
    shares = {r["l"]: min(1.0, (2 * rows_per_language + 50) / r["count"]) for r in counts}
    passed = F.create_map(*[F.lit(x) for k, v in shares.items() for x in (k, int(v * (1 << 40)))])[F.col("l")]
    rank = F.row_number().over(Window.partitionBy("l").orderBy("draw", F.xxhash64("t")))
    drawn = known.withColumn("draw", draw).where(F.col("draw") < passed).withColumn("rank", rank).where(F.col("rank") <= rows_per_language)
    chosen = drawn.select(_lines(F.col("t"), lines_per_row, line_chars).alias("t"), "l")
    return learn([(r["t"], r["l"]) for r in chosen.collect()], lines_per_row)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``<prefix>lang_pred``, ``<prefix>score`` and ``<prefix>spans``: (start, end, lang, score), in code points, end exclusive."""
    names = [f"{prefix}lang_pred", f"{prefix}score", f"{prefix}spans"]
    if {c.lower() for c in docs.columns} & {n.lower() for n in names}:
        raise ValueError(f"the documents already have a column of {names}; choose another prefix")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    kinds = (T.StringType(), T.DoubleType(), T.ArrayType(span))
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds)]])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _Labeller(sent.value) if sent.value else None
        known = np.array(sent.value.languages if sent.value else [], object)
        for batch in batches:
            data, offsets = W.utf8(batch.column(at))
            languages, scores, spans = [], [], [(np.zeros(0, np.int64), *[np.zeros(0, np.int64)] * 3, np.zeros(0))]
            for low, high in W.row_groups(offsets, 4 * W.PIECE):
                body, part = data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
                if not labeller:
                    languages += [UNDETERMINED] * (high - low)
                    scores += [0.0] * (high - low)
                    continue
                words = labeller.marginals(body, part)
                shares = _shares(*words[2:])
                best = shares.argmax(1)
                ascii_letter = np.concatenate(([0], np.cumsum(((body | 32) >= 97) & ((body | 32) <= 122))))
                found = np.array([bool(shares[i, best[i]] > 0 and (
                    ascii_letter[part[i + 1]] > ascii_letter[part[i]]
                    or any(c.isalpha() for c in body[part[i]:part[i + 1]].tobytes().decode("utf-8", "replace")))) for i in range(high - low)])
                languages += [known[best[i]] if found[i] else UNDETERMINED for i in range(high - low)]
                scores += [float(min(1.0, shares[i, best[i]])) if found[i] else 0.0 for i in range(high - low)]
                of, *rest = _stretches(body, part, *words)
                spans.append((low + of[found[of]], *[x[found[of]] for x in rest]))
            of, start, end, label, sure = [np.concatenate(x) for x in zip(*spans)]
            first = np.append(0, np.cumsum(np.bincount(of, minlength=batch.num_rows))).astype(np.int32)
            parts = [pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(known[label] if len(label) else [], pa.string()), pa.array(sure, pa.float64())]
            listed = pa.ListArray.from_arrays(pa.array(first), pa.StructArray.from_arrays(parts, ["start", "end", "lang", "score"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64()), listed],
                                             schema=pa.schema([*batch.schema, (names[0], pa.string()), (names[1], pa.float64()), (names[2], listed.type)]))

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from learning."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def language_report(docs: DataFrame) -> DataFrame:
    """One row per document: whether it was kept from learning, its language and score, how many stretches of one language it has."""
    W.small_batches(docs.sparkSession)
    model = fit(docs.where(~F.coalesce(held_out(), F.lit(False))))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def keep_identified(docs: DataFrame, least_score: float = 0.4) -> DataFrame:
    """Documents with a language of at least that share of their words; all columns as they were."""
    W.small_batches(docs.sparkSession)
    model = fit(docs.where(~F.coalesce(held_out(), F.lit(False))))
    found = predict(docs, model, prefix="crf_")
    return found.where((F.col("crf_lang_pred") != UNDETERMINED) & (F.col("crf_score") >= least_score)).select(*[F.col(f"`{c}`") for c in docs.columns])
