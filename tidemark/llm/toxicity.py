"""Toxicity by weak supervision.

Voters are lexicon words and patterns (the begin of a word): a fixed lexicon, and those that stand out in labelled
texts. A generative model takes the class of every text as hidden: how often each voter fires in either class is
estimated by expectation-maximisation, on texts with and without labels, and voters that fire together beyond that share
their weight, by estimated correlations. A given label is one more voter, which is right with a stated probability. A linear
classifier is trained on the posterior labels. Without labels of both classes, the lexicon votes alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

#: Lexicon of insults (fixed values).
LEXICON = ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "trash", "scum", "pathetic", "worthless", "disgusting", "clown", "imbecile", "vermin", "filth")
#: Bytes of a word's begin that are a pattern each.
BEGINS = (4, 5, 6)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and word begins, in lower case, and the number of the text of each."""
    begin, end = common.spans(data, offsets, ~_WORD)
    doc = np.searchsorted(offsets, begin, "right") - 1
    out, owner = [common.hashes(data, begin, end, lower=True)], [doc]
    for n in BEGINS:
        some = end - begin > n
        out.append(common.hashes(data, begin[some], begin[some] + n, lower=True) ^ np.uint64(n))
        owner.append(doc[some])
    return np.concatenate(out), np.concatenate(owner)


def _lexicon() -> np.ndarray:
    data, offsets = common.utf8(pa.array(LEXICON))
    return common.words(data, offsets)[0]


def label_model(votes: np.ndarray, label: np.ndarray, weight: np.ndarray, trust: float = 0.97, rounds: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The posterior of class 1 for each text, the voters' rates in either class, and their correlations within the classes.

    votes: text by voter, whether it fires. label: 0, 1 or -1 (none) is one more voter, right with probability trust. weight: of each
    text, so that a sample with other shares than the corpus's counts rightly. Without any label, class 1 is the one in which
    voters fire: the more of them do, the likelier it is at the start.
    """
    said = np.where(label < 0, 0.0, np.where(label == 1, 1.0, -1.0)) * np.log(trust / (1 - trust))
    post = np.where(label < 0, 0.05 if (label >= 0).any() else np.clip(1 - 0.3 ** votes.sum(1), 0.02, 0.98), 1 / (1 + np.exp(-said)))
    together = np.eye(votes.shape[1])
    for k in range(rounds + 1):
        share = [weight * (1 - post), weight * post]
        rate = np.stack([(s @ votes + 0.01) / (s.sum() + 1.0) for s in share])
        if k == rounds:
            break
        if k % 5 == 0:  # voters that say the same share their weight
            together = _correlations(votes, share, rate)
        voice = 1 / np.maximum(together, 0).sum(1)
        gain = np.log(rate[1] / rate[0]) * voice
        calm = np.log((1 - rate[1]) / (1 - rate[0])) * voice
        prior = np.clip(share[1].sum() / weight.sum(), 1e-6, 1 - 1e-6)
        odds = np.log(prior / (1 - prior)) + votes @ gain + (1 - votes) @ calm + said
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, rate, together


def _correlations(votes: np.ndarray, share: list[np.ndarray], rate: np.ndarray) -> np.ndarray:
    out = np.zeros((votes.shape[1], votes.shape[1]))
    for s, r in zip(share, rate, strict=True):
        centred = votes - r
        cov = (centred * s[:, None]).T @ centred / max(s.sum(), 1e-9)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        out += s.sum() / sum(x.sum() for x in share) * cov / np.outer(sd, sd)
    np.fill_diagonal(out, 1.0)
    return out


def threshold(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The cut of scores that gets the most labels right by weight; in the middle of the widest gap that does."""
    order = np.argsort(score, kind="stable")
    s, y, w = score[order], label[order], weight[order]
    right = np.r_[0, np.cumsum(w * (y == 0))] + (w * (y == 1)).sum() - np.r_[0, np.cumsum(w * (y == 1))]
    ends = np.r_[s[0] - 1, s, s[-1] + 1]
    between = np.diff(ends) > 0  # equal scores can't be cut
    at = np.flatnonzero(between & (right >= right[between].max() - 1e-9 * w.sum()))
    wide = at[np.argmax(np.diff(ends)[at])]
    return float((ends[wide] + ends[wide + 1]) / 2)


class Classifier:
    """hashes: the features, sorted; weights: theirs; bias. A score is the logistic of bias + weights of the features there."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.hashes, self.weights, self.bias = hashes, weights, bias
        self.coarse = np.zeros(1 << 20, bool)
        self.coarse[hashes & np.uint64((1 << 20) - 1)] = True

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of text and feature, each once."""
        h, doc = features(data, offsets)
        some = self.coarse[h & np.uint64((1 << 20) - 1)]
        h, doc = h[some], doc[some]
        at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        hit = self.hashes[at] == h if len(self.hashes) else np.zeros(0, bool)
        pair = np.unique(doc[hit].astype(np.int64) * max(1, len(self.hashes)) + at[hit])
        return pair // max(1, len(self.hashes)), pair % max(1, len(self.hashes))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, at = self.hits(data, offsets)
        x = self.bias + np.bincount(doc, weights=self.weights[at], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, unlabelled: int = 2000, most_voters: int = 400, most_chars: int = 20_000, clean_weight: float = 10.0) -> Classifier:
    """Learns from at most per_class labelled texts of each class and unlabelled ones without, of the training fold and up to most_chars long.

    most_voters is the size of the model: the voters besides the lexicon. clean_weight: how many toxic texts missed are as bad as a clean
    one that is marked, where the threshold is set. Without labels of both classes the lexicon votes alone;
    if no voter fires in any text, every score is the low prior.
    """
    counts = {r.y: r.n for r in labels.where(common.training_row(F.col("doc_id"))).groupBy(F.col("toxic").cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    sample = common.labelled_sample(docs, labels, "toxic", per_class, most_chars, unlabelled).orderBy("doc_id").select("text", F.coalesce("label", F.lit(-1)).alias("label")).toArrow()
    y = sample.column("label").to_numpy().astype(int)
    n = [int((y == q).sum()) for q in range(2)]
    # The labelled classes weigh as in all labels; texts without a label weigh as much as those together.
    each = np.array([counts.get(q, 0) / max(1, n[q]) for q in range(2)] + [max(1, sum(counts.get(q, 0) for q in range(2))) / max(1, (y < 0).sum())])
    weight = each[y] if all(n) else np.ones(len(y))
    data, offsets = common.utf8(sample.column("text"))
    pairs = [(np.zeros(0, np.uint64), np.zeros(0, np.int32))]
    for a, b in common.slices(offsets):
        h, doc = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order] + a
        new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
        pairs.append((h[new], doc[new].astype(np.int32)))
    h, doc = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    value, place = np.unique(h, return_inverse=True)
    pick = np.flatnonzero(np.isin(value, _lexicon()))
    if all(n):
        fired = [np.bincount(place[y[doc] == q], minlength=len(value)) for q in range(2)]
        rate = [(fired[q] + 0.2) / (n[q] + 1.0) for q in range(2)]
        # Voters: fire in a few toxic texts, and much more often there; or are in the lexicon.
        good = (fired[1] >= max(2, n[1] / 700)) & (rate[1] >= 8 * rate[0]) & (fired[1] * each[1] >= 3 * fired[0] * each[0])
        gain = np.where(good, fired[1] * np.log(rate[1] / rate[0]), -1.0)
        pick = np.union1d(np.argsort(-gain, kind="stable")[:most_voters][: int((gain > 0).sum())], pick[rate[1][pick] > rate[0][pick]])
    if not len(pick):
        return Classifier(np.zeros(0, np.uint64), np.zeros(0), -3.0 if n[0] or not n[1] else 3.0)
    chosen = value[pick]
    model = Classifier(chosen, np.zeros(len(chosen)), 0.0)
    votes = np.zeros((len(y), len(chosen)))
    found = np.minimum(np.searchsorted(chosen, h), len(chosen) - 1)
    ok = chosen[found] == h
    votes[doc[ok], found[ok]] = 1
    # Without labels a vote leaves 0.3 of the doubt: a few words can't tell their own accuracies.
    post = label_model(votes, y, weight)[0] if all(n) else np.clip(1 - 0.3 ** votes.sum(1), 0.02, 0.98)
    # The classifier: logistic regression on posterior labels, by Newton steps with a ridge.
    x = np.c_[votes, np.ones(len(y))]
    beta = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1.0)
    ridge[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (post - p)) - ridge * beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), slope)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    if all(n):
        known = y >= 0
        beta[-1] -= threshold((x @ beta)[known], y[known], (weight * np.where(y == 0, clean_weight, 1.0))[known])
    model.weights, model.bias = beta[:-1], float(beta[-1])
    common.release()
    return model


def score(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """docs with score and predicted (1 if score >= 0.5); columns of these names are replaced.

    A null or empty text, or one without a known feature, has the score that no voter's firing gives. Texts count whole.
    """
    rest = docs.drop("score", "predicted")
    parts = (model.hashes, model.weights, model.bias)

    def run(batches):
        common.release("words")
        made = Classifier(*parts)
        for batch in batches:
            data, offsets = common.utf8(batch.column(batch.schema.get_field_index(text)))
            got = [made.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in common.slices(offsets)]
            s = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return rest.mapInArrow(run, rest.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    model = fit(docs, common.read(spark, sf_dir, "labels"))
    held = F.coalesce(~common.training_row(F.col("doc_id")), F.lit(False))
    return score(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
