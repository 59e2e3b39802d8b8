"""Quality rules over whole texts, with a linear-chain conditional random field that marks each line as content or boilerplate.

The field has two labels. A line's features are binned measures (length, shares of symbols, digits, capitals and
punctuation, repetition); transitions between labels are learned too. Lines have no labels of their own: a line's label
is hidden, and its document's label is a noisy sign of it, since a bad document holds content lines as well. The likelihood
of those signs is climbed on a bounded sample of labelled documents and on sequences joined from runs of lines of
both classes, which show the field how labels change. Viterbi decoding then reads the labels of a document's lines.
A document is retained if enough of its words stand on content lines and the plain rules don't reject it.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, base_failed boolean, kept boolean"
#: Upper ends of the bins of each measure of a line (fixed values).
BINS = {
    "words": (1, 3, 8, 20, 60),
    "word_bytes": (2.0, 3.5, 5.0, 7.0, 10.0),
    "symbols": (0.0, 0.02, 0.05, 0.1, 0.2),
    "digits": (0.0, 0.05, 0.15, 0.4),
    "capitals": (0.0, 0.05, 0.15, 0.4, 0.8),
    "marks": (0.0, 0.03, 0.08, 0.2),
    "new_words": (0.2, 0.4, 0.6, 0.8, 0.95),
    "seen": (0.5,),
    "bare": (0.1, 0.5, 0.9),
}
N_FEATURES = sum(len(b) + 1 for b in BINS.values())
#: Lines of a training sequence at most: a longer document is several sequences.
TRAIN_LINES = 64
#: How much likelier the sign of a line's document is if the line is of that class: by the document's label, bad and good.
SIGNS = (3.0, 50.0)
#: Lines of a run in a joined sequence, and runs of a joined sequence, at most.
RUN_LINES, RUNS = 6, 6


def _lut(characters: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(characters)] = 1
    return out


_SYMBOL, _DIGIT = _lut(b"#*$%&|<>"), _lut(b"0123456789")
_UPPER, _LOWER = _lut(bytes(range(65, 91))), _lut(bytes(range(97, 123)))
_MARK = _lut(b"!?;:,.()[]{}\"'/\\=+-_~^`@")
_BARE = _lut(b"#*$%&|<>!?;:,.()[]{}\"'/\\=+-_~^`@0123456789")
_POINT = np.array([(b & 0xC0) != 0x80 for b in range(256)], np.uint8)


def _between(lut: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many bytes of each span are marked in lut: a byte of memory for each byte of text."""
    out, some = np.zeros(len(begin), np.int64), end > begin
    if some.any():
        at = np.stack([begin[some], end[some]], 1).ravel()
        out[some] = np.add.reduceat(np.append(lut[data], np.uint8(0)), at, dtype=np.int64)[::2]
    return out


def _repeated(key: np.ndarray) -> np.ndarray:
    """For each key: whether it stands elsewhere too."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k), bool)
    if len(k) > 1:
        eq = k[1:] == k[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.empty(len(k), bool)
    out[order] = same
    return out


def _again(key: np.ndarray) -> np.ndarray:
    """For each key: whether it stands earlier too."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    out = np.zeros(len(k), bool)
    if len(k) > 1:
        out[order[1:]] = k[1:] == k[:-1]
    return out


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text, and its lines with a word: their text, words and features."""
    n = len(offsets) - 1
    begin, end = common.spans(data, offsets)
    first = np.searchsorted(begin, offsets, "left")
    h = common.hashes(data, begin, end)
    doc = np.repeat(np.arange(n), np.diff(first))
    out = {"n_words": np.diff(first)}
    out["word_chars"] = np.zeros(n, np.int64)
    np.add.at(out["word_chars"], doc, _between(_POINT, data, begin, end))
    out["n_symbols"] = _between(_SYMBOL, data, offsets[:-1], offsets[1:])
    covered = np.zeros(len(h) + 1, np.int64)
    if len(h) >= 3:
        inside = doc[2:] == doc[:-2]
        at = np.flatnonzero(inside)
        salt = common.mix(doc[at].astype(np.uint64) + np.uint64(1))
        at = at[_repeated(common.grams(h, 3)[at] ^ salt)]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + 3, -1)
    mask = np.cumsum(covered)[:-1] > 0
    out["n_repeat_words"] = np.bincount(doc[mask], minlength=n)
    # Lines: a text's pieces between line feeds; those without a word count nowhere.
    breaks = np.flatnonzero(data == 10)
    b = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks + 1)
    b = b[b < len(data)]
    e = np.empty_like(b)
    if len(b):
        e[:-1], e[-1] = b[1:], len(data)
        e = np.where((e > b) & (data[e - 1] == 10), e - 1, e)
    w0, w1 = np.searchsorted(begin, b, "left"), np.searchsorted(begin, e, "left")
    full = w1 > w0
    b, e, w0, w1 = b[full], e[full], w0[full], w1[full]
    line_doc = np.searchsorted(offsets, b, "right") - 1
    key = common.hashes(data, b, e) ^ common.mix(line_doc.astype(np.uint64) + np.uint64(1))
    seen = _again(key)
    out["n_dup_lines"] = np.bincount(line_doc[seen], minlength=n)
    words, size = w1 - w0, np.maximum(1, e - b)
    fresh = np.zeros(len(h) + 1, np.int64)
    np.cumsum(~_again(h ^ common.mix(doc.astype(np.uint64) + np.uint64(1))), out=fresh[1:])
    letters = np.maximum(1, _between(_UPPER, data, b, e) + _between(_LOWER, data, b, e))
    bare = np.zeros(len(h) + 1, np.int64)
    np.cumsum(_between(_BARE, data, begin, end) == end - begin, out=bare[1:])
    values = {
        "words": words,
        "word_bytes": (e - b) / words - 1,
        "symbols": _between(_SYMBOL, data, b, e) / size,
        "digits": _between(_DIGIT, data, b, e) / size,
        "capitals": _between(_UPPER, data, b, e) / letters,
        "marks": _between(_MARK, data, b, e) / size,
        "new_words": (fresh[w1] - fresh[w0]) / words,
        "seen": seen.astype(float),
        "bare": (bare[w1] - bare[w0]) / words,
    }
    columns, at = [], 0
    for name, ends in BINS.items():
        columns.append(at + np.searchsorted(np.array(ends, float), values[name], "left"))
        at += len(ends) + 1
    out |= {"line_doc": line_doc, "line_words": words, "line_features": np.stack(columns, 1).astype(np.uint8) if len(b) else np.zeros((0, len(BINS)), np.uint8)}
    return out


def _joined(sequences: list[np.ndarray], labels: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training sequences, each with its lines' signs: the documents, and as many joins of runs of lines from either class."""
    out = [(s[k : k + TRAIN_LINES], np.full(len(s[k : k + TRAIN_LINES]), y)) for s, y in zip(sequences, labels, strict=True) for k in range(0, len(s), TRAIN_LINES)]
    of = [[s for s, y in zip(sequences, labels, strict=True) if y == q] for q in range(2)]
    if of[0] and of[1]:
        rng = np.random.default_rng(17)
        for _ in range(len(sequences)):
            first, runs = int(rng.integers(2)), []
            for k in range(int(rng.integers(2, RUNS + 1))):
                q = (first + k) % 2
                s = of[q][int(rng.integers(len(of[q])))]
                at, n = int(rng.integers(len(s))), int(rng.integers(1, RUN_LINES + 1))
                runs.append((s[at : at + n], np.full(len(s[at : at + n]), q)))
            out.append((np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])))
    return out


class _Sequences:
    """Sequences of lines by place: first all first lines, longest sequences first, then all second lines, and so on."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        parts = sorted(parts, key=lambda p: -len(p[0]))
        length = np.array([len(s) for s, _ in parts])
        self.n = [int((length > t).sum()) for t in range(int(length[0]))]
        self.at = np.r_[0, np.cumsum(self.n)]
        flat = np.r_[0, np.cumsum(length)[:-1]]
        order = np.concatenate([flat[:n] + t for t, n in enumerate(self.n)])
        self.x = np.concatenate([s for s, _ in parts])[order]
        sign = np.concatenate([y for _, y in parts])[order]
        self.signs = np.where(sign[:, None] == np.arange(2), np.log(np.array(SIGNS))[sign][:, None], 0.0)
        count = np.bincount(sign, minlength=2)
        self.weight = (len(sign) / (2 * np.maximum(count, 1)))[sign]
        # A line and the one after it in its sequence.
        self.before = np.concatenate([self.at[t] + np.arange(n) for t, n in enumerate(self.n[1:])] or [np.zeros(0, np.int64)])
        self.after = np.arange(self.n[0], len(sign))

    def expect(self, score: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each line's probabilities of the labels, and the weighted sum of those of neighbouring pairs."""
        e, step, at = np.exp(score - score.max(1, keepdims=True)), np.exp(moves - moves.max()), self.at
        a, b = e.copy(), np.ones_like(e)
        a[: self.n[0]] /= a[: self.n[0]].sum(1, keepdims=True)
        for t in range(1, len(self.n)):
            here = a[at[t - 1] : at[t - 1] + self.n[t]] @ step * e[at[t] : at[t + 1]]
            a[at[t] : at[t + 1]] = here / here.sum(1, keepdims=True)
        for t in range(len(self.n) - 2, -1, -1):
            here = (e[at[t + 1] : at[t + 2]] * b[at[t + 1] : at[t + 2]]) @ step.T
            b[at[t] : at[t] + self.n[t + 1]] = here / here.sum(1, keepdims=True)
        p = a * b
        p /= p.sum(1, keepdims=True)
        pair = a[self.before][:, :, None] * step * (e[self.after] * b[self.after])[:, None]
        pair /= pair.sum((1, 2), keepdims=True)
        weight = (self.weight[self.before] + self.weight[self.after]) / 2
        return p, (pair * weight[:, None, None]).sum(0)


class LineField:
    """weights: a score for each feature and label; moves: for each pair of neighbouring labels; label 1 is content."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    @classmethod
    def blank(cls) -> LineField:
        """Without labelled lines every line is content."""
        return cls(np.tile([0.0, 0.1], (N_FEATURES, 1)), np.zeros((2, 2)))

    def dumps(self) -> str:
        return json.dumps([self.weights.tolist(), self.moves.tolist()])

    @classmethod
    def loads(cls, s: str) -> LineField:
        return cls(*map(np.array, json.loads(s)))

    @classmethod
    def fit(cls, sequences: list[np.ndarray], labels: list[int], steps: int = 80, rate: float = 0.15, ridge: float = 1e-3) -> LineField:
        """Climbs the likelihood of the documents' labels as signs of their lines' hidden labels; classes weigh alike.

        The slope is the difference of two expectations by forward and backward sums: with the signs, and without them.
        """
        if not sequences:
            return cls.blank()
        batch = _Sequences(_joined(sequences, labels))
        weights, moves = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
        state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
        for step in range(1, steps + 1):
            score = sum(weights[batch.x[:, k]] for k in range(len(BINS)))
            free, free_pairs = batch.expect(score, moves)
            held, held_pairs = batch.expect(score + batch.signs, moves)
            slope = (held - free) * batch.weight[:, None]
            g = np.stack([sum(np.bincount(batch.x[:, k], weights=slope[:, q], minlength=N_FEATURES) for k in range(len(BINS))) for q in range(2)], 1)
            for at, (value, slope_of) in enumerate(((weights, g), (moves, held_pairs - free_pairs))):
                d = slope_of / batch.weight.sum() - ridge * value
                m, v = state[2 * at], state[2 * at + 1]
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return cls(weights, moves)

    def decode(self, features: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The likeliest labels of the lines of many texts (Viterbi): doc numbers them, in order."""
        n = len(doc)
        if not n:
            return np.zeros(0, np.int8)
        score = self.weights[features].sum(1)
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        length = np.diff(np.r_[first, n])
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        best, back = score.copy(), np.zeros((n, 2), np.int8)
        for t in range(1, int(length[0])):
            at = first[: int(np.searchsorted(-length, -t, "left"))] + t
            through = best[at - 1][:, :, None] + self.moves
            back[at] = through.argmax(1)
            best[at] += through.max(1)
        label = np.zeros(n, np.int8)
        last = first + length - 1
        label[last] = best[last].argmax(1)
        for t in range(int(length[0]) - 1, 0, -1):
            at = first[: int(np.searchsorted(-length, -t, "left"))] + t
            label[at - 1] = back[at, label[at]]
        return label


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, most_chars: int = 200_000) -> LineField:
    """Learns from at most per_class labelled documents of each class (quality 1 and 0), those whose ids hash lowest.

    Only ids outside the held-out fold count, and texts of up to most_chars; lines of larger ones teach nothing. Texts are
    measured where they are: the driver gets a byte for each feature of a line, of 2 * TRAIN_LINES lines a document at most.
    No labels, or none that match: every line counts as content.
    """

    def run(batches):
        common.release("words")
        for batch in batches:
            data, offsets = common.utf8(batch.column(2))
            rows = []
            for a, b in common.slices(offsets):
                m = measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                at = np.searchsorted(m["line_doc"], np.arange(b - a + 1))
                rows += [m["line_features"][p : min(q, p + 2 * TRAIN_LINES)].tobytes() for p, q in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["doc_id", "label", "lines"])

    sample = common.labelled_sample(docs, labels, "quality", per_class, most_chars)
    lines = sample.mapInArrow(run, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, label int, lines binary")
    got = lines.where(F.length("lines") > 0).orderBy("doc_id").select("label", "lines").toArrow()
    field = LineField.fit([np.frombuffer(x, np.uint8).reshape(-1, len(BINS)) for x in got.column("lines").to_pylist()], got.column("label").to_pylist())
    common.release()
    return field


def judge(docs: DataFrame, field: LineField, min_share: float = 0.5, text: str = "text") -> DataFrame:
    """docs with the columns of SCHEMA (which replace any of the same names).

    A null or empty text, or one without words, has counts of 0 and content_share 0, fails the plain rules and
    is not kept. Equal rows get equal verdicts.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    rest = docs.drop(*names)
    model = field.dumps()

    def run(batches):
        common.release("words")
        made = LineField.loads(model)
        for batch in batches:
            data, offsets = common.utf8(batch.column(batch.schema.get_field_index(text)))
            parts = [_judged(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], made, min_share) for a, b in common.slices(offsets)]
            more = [pa.array(np.concatenate([p[k] for p in parts]) if parts else []) for k in range(len(names))]
            kinds = [pa.int64()] * 5 + [pa.float64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(a.cast(k) for a, k in zip(more, kinds, strict=True))], [*batch.schema.names, *names])

    types = {n: t for n, t in (x.split() for x in SCHEMA.split(", "))}
    schema = rest.withColumns({n: F.lit(None).cast(t) for n, t in types.items()}).schema
    return rest.mapInArrow(run, schema)


def _judged(data: np.ndarray, offsets: np.ndarray, field: LineField, min_share: float) -> list[np.ndarray]:
    m = measure(data, offsets)
    label = field.decode(m["line_features"], m["line_doc"])
    on = np.bincount(m["line_doc"], weights=m["line_words"] * label, minlength=len(offsets) - 1)
    share = on / np.maximum(1, m["n_words"])
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return [m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"], share, failed, ~failed & (share >= min_share)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    field = fit(docs, common.read(spark, sf_dir, "labels"))
    return judge(docs.select("doc_id", "text"), field).drop("text")
