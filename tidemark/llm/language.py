"""Language identification that allows for several languages in a text.

Every language has a letter model: the probability of a letter after the two before it, over lower-case UTF-8 bytes.
A text is cut into short windows; the language of a window is hidden. Expectation-maximisation estimates the
text's proportions of the languages from the windows' likelihoods, and languages with the least share are dropped
from the set one after another; the set with the best penalised likelihood stands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidemark.llm import common

WINDOW = 48
#: Probabilities that are looked up at once, at least one window's.
LOOKED_UP = 1 << 22
SYMBOLS = 64
UNKNOWN = "und"


def _symbols() -> np.ndarray:
    """Bytes to symbols: 0 for all that are no letters, 1 to 26 for letters, the rest for bytes beyond ASCII."""
    out = np.zeros(256, np.int32)
    for k in range(26):
        out[65 + k] = out[97 + k] = k + 1
    for b in range(128, 256):
        out[b] = 27 + b % 37
    return out


_SYMBOL = _symbols()
_UPPER_LATIN = np.zeros(256, np.uint8)
_UPPER_LATIN[0x80:0x9F] = 0x20
_UPPER_LATIN[0x97] = 0


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte, the number of the three symbols that end there; texts begin after two non-letters."""
    if not len(data):
        return np.zeros(0, np.int32)
    after = np.zeros(len(data), np.uint8)
    after[1:] = (data[:-1] == 0xC3) * _UPPER_LATIN[data[1:]]  # capital letters of Latin-1
    s = _SYMBOL[data + after]
    out = s.copy()
    out[1:] += SYMBOLS * s[:-1]
    out[2:] += SYMBOLS * SYMBOLS * s[:-2]
    begin = offsets[:-1][np.diff(offsets) > 0]
    out[begin] = s[begin]
    second = begin + 1
    second = second[(second < len(data)) & ~np.isin(second, begin)]
    out[second] = s[second] + SYMBOLS * s[second - 1]
    return out


class Languages:
    """names, and a table with the logarithm of a symbol's probability after two others, for each language."""

    def __init__(self, names: list[str], table: np.ndarray):
        self.names, self.table = names, table

    @classmethod
    def fit(cls, counts: dict[str, np.ndarray]) -> Languages:
        """counts: for each language, how often each run of three symbols occurs."""
        columns = []
        for name in sorted(counts):
            c3 = counts[name].astype(float).reshape(SYMBOLS, SYMBOLS, SYMBOLS)
            c2, c1 = c3.sum(0), c3.sum((0, 1))
            p1 = (c1 + 0.5) / (c1.sum() + 0.5 * SYMBOLS)
            p2 = (c2 + 4 * p1) / (c2.sum(1, keepdims=True) + 4)
            p3 = (c3 + 4 * p2[None]) / (c3.sum(2, keepdims=True) + 4)
            columns.append(np.log(p3).reshape(-1).astype(np.float32))
        return cls(sorted(counts), np.stack(columns, 1) if columns else np.zeros((SYMBOLS**3, 0), np.float32))

    def predict(self, data: np.ndarray, offsets: np.ndarray, rounds: int = 12, price: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
        """The number of the leading language (-1: none) and its share of each text."""
        n, k = len(offsets) - 1, len(self.names)
        best, share = np.full(n, -1), np.zeros(n)
        size = np.diff(offsets)
        some = np.flatnonzero(size > 0)
        if not k or not len(some):
            return best, share
        windows = -(-size[some] // WINDOW)
        first = np.r_[0, np.cumsum(windows)[:-1]]
        doc = np.repeat(np.arange(len(some)), windows)
        begin = offsets[some][doc] + WINDOW * (np.arange(len(doc)) - first[doc])
        runs, like = _trigrams(data, offsets), np.empty((len(begin), k), np.float32)
        step = max(1, LOOKED_UP // (WINDOW * k))
        for a in range(0, len(begin), step):
            there = begin[a : a + step]
            end = begin[a + step] if a + step < len(begin) else len(runs)
            like[a : a + step] = np.add.reduceat(self.table[runs[there[0] : end]], there - there[0], axis=0)
        top = like.max(1, keepdims=True)
        base = np.add.reduceat(top[:, 0].astype(float), first)
        like = np.exp(np.maximum(like - top, -60))
        alive = np.ones((len(some), k), bool)
        kept_score, kept_share = np.full(len(some), -np.inf), np.zeros((len(some), k))
        for left in range(k, 0, -1):
            p = alive / alive.sum(1, keepdims=True)
            for _ in range(rounds if left > 1 else 1):
                w = like * p[doc].astype(np.float32)
                w /= np.maximum(w.sum(1, keepdims=True), 1e-37)
                p = np.add.reduceat(w, first, axis=0) / windows[:, None] if left > 1 else p
            total = base + np.add.reduceat(np.log(np.maximum((like * p[doc].astype(np.float32)).sum(1), 1e-37)).astype(float), first)
            score = total - price * (left - 1) * np.log(windows + 1.0)
            better = score > kept_score
            kept_score[better], kept_share[better] = score[better], p[better]
            least = np.where(alive, p, np.inf).argmin(1)
            alive[np.arange(len(some)), least] = False
        best[some], share[some] = kept_share.argmax(1), np.clip(kept_share.max(1), 0, 1)
        return best, share


def fit(docs: DataFrame, sample_rows: int = 6000, most_languages: int = 1000, most_chars: int = 200_000) -> Languages:
    """Learns from at most sample_rows texts, as many of each language, whose ids hash lowest.

    Only rows of the training fold with a language count, and texts of up to most_chars. No such row: no languages. Runs of
    letters are counted where the texts are; the driver gets the counts, at most 64 ** 3 for each language.
    """
    rows = docs.select("doc_id", "text", "lang").where(common.training_row(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") <= most_chars))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not counts:
        return Languages.fit({})
    each = max(1, sample_rows // len(counts))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    limit = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, 1.5 * each / n) * (1 << 30)))])
    some = rows.where(place < F.element_at(limit, F.col("lang"))).withColumn("place", place).orderBy("place", "doc_id").limit(2 * sample_rows)
    nth = F.row_number().over(W.Window.partitionBy("lang").orderBy("place", "doc_id", "text"))
    some = some.withColumn("nth", nth).where(F.col("nth") <= each).select("lang", "text")

    def run(batches):
        common.release()
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), object)
            for name in sorted(set(lang)):
                data, offsets = common.utf8(batch.column(1).take(pa.array(np.flatnonzero(lang == name))))
                for a, b in common.slices(offsets):
                    n = np.bincount(_trigrams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "run", "n"])

    found = some.mapInArrow(run, "lang string, run int, n long").groupBy("lang", "run").agg(F.sum("n").alias("n")).toArrow()
    lang, at, n = np.array(found.column("lang").to_pylist(), object), found.column("run").to_numpy(), found.column("n").to_numpy()
    made = Languages.fit({name: np.bincount(at[lang == name], weights=n[lang == name], minlength=SYMBOLS**3) for name in set(lang)})
    common.release()
    return made


def identify(docs: DataFrame, languages: Languages, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (the share of that language); columns of these names are replaced.

    A text that is null or has no letter gets `und` and score 0, and so does every text if no language was
    learned. Ties go to the language that comes first by name. Long texts count whole.
    """
    rest = docs.drop("lang_pred", "score")
    model = docs.sparkSession.sparkContext.broadcast((languages.names, languages.table))  # one table of 1 MB for each language

    def run(batches):
        common.release()
        made = Languages(*model.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            data, offsets = common.utf8(column)
            pred, score = [], []
            for a, b in common.slices(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                best, share = made.predict(part, at)
                has = np.zeros(len(part) + 1, np.int64)
                np.cumsum((_SYMBOL[part] > 0) & (part < 128), out=has[1:])
                letters = has[at[1:]] > has[at[:-1]]
                for i in np.flatnonzero(~letters & (np.diff(at) > 0)):
                    letters[i] = any(map(str.isalpha, column[a + int(i)].as_py()))
                pred += [made.names[i] if ok and i >= 0 else UNKNOWN for i, ok in zip(best, letters, strict=True)]
                score.append(np.where(letters & (best >= 0), share, 0.0))
            more = [pa.array(pred, pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "lang_pred", "score"])

    return rest.mapInArrow(run, rest.withColumn("lang_pred", F.lit("").cast("string")).withColumn("score", F.lit(0.0)).schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    held = F.coalesce(~common.training_row(F.col("doc_id")), F.lit(False))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), fit(docs)).drop("text")
