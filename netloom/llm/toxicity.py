"""Toxicity by weak supervision.

1. Terms (words, and word beginnings) that labelled rows tie to toxic texts are found on a bounded sample.
2. Voters: the toxic terms dealt into word and beginning lexicons, rates of toxic terms, and surface patterns. Each votes
   on every text; the texts of each vote pattern are counted over all rows (at most 2 ** voters patterns).
3. A generative label model (two classes, a rate per voter and class) is fitted to all patterns by EM, with the labelled
   rows as anchors. Correlation between voters beyond the class is estimated in each step and divides their weight.
4. A linear classifier on the terms learns the label model's posteriors of documents, labelled or not, from their votes alone;
   labels only place its bias. It scores every text.

Samples: about ``TOXIC`` toxic and ``CLEAN`` clean labelled rows, and about as many documents that a first label model takes for
either, all drawn by a hash.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, Shared, cut, if_small, map_rows

TOXIC, CLEAN, TERMS, LEXICON, LEXICONS, STEPS = 4000, 8000, 2000, 400, 5, 200
#: Lengths of word beginnings; a beginning counts only where the word goes on.
PREFIXES = (4, 5, 6, 7, 8)
LETTERS = re.compile(r"[^\W\d_]+").findall
#: Surface patterns that vote by themselves: shouting, piled-up exclamation marks, masked letters.
PATTERNS = (r"(?:\b[A-Z]{3,}\b\W+){3}", r"!{3,}", r"\b[A-Za-z]+\*+[A-Za-z]+\b")
#: A text in which at least one word in so many is toxic gets the vote of that rate's voter.
RATES = (20, 40, 100)


def terms_of_word(word: str) -> list[str]:
    return [word, *[f"{word[:n]}-" for n in PREFIXES if len(word) > n]]


def distinct_words(text: str | None) -> Counter:
    return Counter(LETTERS(text.lower())) if text else Counter()


@dataclass
class Voters:
    """The lexicons (term -> voter numbers) and patterns; a vote pattern is a bit mask."""

    lexicon: dict[str, int]

    @property
    def n(self) -> int:
        return 2 * LEXICONS + len(RATES) + len(PATTERNS)

    def voter(self):
        patterns = [re.compile(p).search for p in PATTERNS]
        memo = Memo(lambda w: sum({1 << self.lexicon[t] for t in terms_of_word(w) if t in self.lexicon}), 150_000)

        def vote(text: str | None, words: Counter) -> int:
            mask = toxic = total = 0
            for w, n in words.items():
                total += n
                if m := memo[w]:
                    mask |= m
                    toxic += n
            for k, rate in enumerate(RATES):
                mask |= (toxic > 0 and rate * toxic >= total) << 2 * LEXICONS + k
            for k, p in enumerate(patterns):
                mask |= (p(text) is not None) << 2 * LEXICONS + len(RATES) + k if text else 0
            return mask

        return vote


def bits(masks: np.ndarray, n: int) -> np.ndarray:
    return (np.asarray(masks, np.int64)[:, None] >> np.arange(n) & 1).astype(np.float64)


@dataclass
class LabelModel:
    toxic: np.ndarray
    clean: np.ndarray
    weight: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = np.log(self.prior / (1 - self.prior)) + (votes * np.log(self.toxic / self.clean) + (1 - votes) * np.log((1 - self.toxic) / (1 - self.clean))) @ self.weight
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def fit_label_model(votes: np.ndarray, counts: np.ndarray, known: np.ndarray, labels: np.ndarray, rounds: int = 30) -> LabelModel:
    """EM over vote patterns with their counts; ``known`` votes with 0/1 ``labels`` anchor the classes."""

    def rates(v, w):
        return (v.T @ w + 0.5) / (w.sum() + 1)

    y = labels.astype(np.float64)
    share = float(np.clip(y.mean() if len(y) else 0.05, 1e-4, 0.5))
    model = LabelModel(rates(known, y), rates(known, 1 - y), np.ones(votes.shape[1]), share)
    every, weight = np.concatenate([votes, known]), np.concatenate([counts, np.ones(len(known))]).astype(np.float64)
    for _ in range(rounds):
        p = np.concatenate([model.posterior(votes), y])
        one, zero = weight * p, weight * (1 - p)
        model.toxic, model.clean = rates(every, one), rates(every, zero)
        model.prior = float(np.clip(one.sum() / weight.sum(), 1e-4, 0.9))
        tie = np.zeros((votes.shape[1],) * 2)
        for w, mean in ((one, model.toxic), (zero, model.clean)):
            r = (every - mean) * np.sqrt(w)[:, None]
            c = r.T @ r
            d = np.sqrt(np.maximum(np.diag(c), 1e-9))
            tie += 0.5 * c / np.outer(d, d)
        np.fill_diagonal(tie, 0)
        model.weight = 1 / (1 + np.maximum(tie, 0).sum(1))
    return model


@dataclass
class Classifier:
    terms: dict[str, int]
    weight: np.ndarray
    bias: float

    def scorer(self):
        memo = Memo(lambda w: tuple(self.terms[t] for t in terms_of_word(w) if t in self.terms), 150_000)

        def score(text: str | None) -> float:
            found = {k for w in distinct_words(text) for k in memo[w]}
            z = self.bias + float(self.weight[list(found)].sum()) if found else self.bias
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


def fit_classifier(x: np.ndarray, target: np.ndarray, known: np.ndarray, labels: np.ndarray, terms: dict[str, int], steps: int = STEPS) -> Classifier:
    """Logistic regression of soft targets on ``x`` (Adam, L2); then the bias that separates the labelled rows ``known`` best, mid-gap."""
    w, b = np.zeros(x.shape[1], np.float32), np.float32(np.log(max(target.mean(), 1e-3) / max(1 - target.mean(), 1e-3)))
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    target = target.astype(np.float32)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = np.r_[x.T @ (p - target) / len(x) + 3e-4 * w, (p - target).mean()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1].astype(np.float32), b - np.float32(step[-1])
    z = known @ w + b
    order = np.argsort(z, kind="stable")
    s, y = z[order], labels[order]
    wrong = np.r_[0, np.cumsum(y)] + np.r_[(1 - y).sum(), (1 - y).sum() - np.cumsum(1 - y)]  # cut before k: toxic below + clean above
    k = np.flatnonzero(wrong == wrong.min())
    k = int(k[len(k) // 2])
    at = s[0] - 1 if k == 0 else s[-1] + 1 if k == len(s) else (s[k - 1] + s[k]) / 2
    return Classifier(terms, w, float(b - at))


def drawn_by(key: F.Column, share: float) -> F.Column:
    return F.pmod(key, F.lit(1 << 40)) < F.lit(int(min(share, 1.0) * (1 << 40)))


def learn(docs: DataFrame, labels: DataFrame) -> Classifier:
    """From ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, both without what is held out.

    Labels seed the lexicons, anchor the label model's classes and place the bias; the classifier's targets are the label
    model's posteriors of documents, from their votes alone. Null texts vote as empty ones. Of an id with several labels the
    highest counts; null ids and labels teach nothing; repeated rows count each; ties of terms go to the first in order; extra
    columns are ignored. Without labelled texts of both kinds, also in empty tables, the classifier knows no term and scores
    every text alike, at the share of toxic labels (0.05 without labels).
    """
    docs, spark = docs.select("doc_id", "text"), docs.sparkSession
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    labelled = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, drawn_by(F.xxhash64("doc_id"), TOXIC / labelled.get(1, 1))).otherwise(drawn_by(F.xxhash64("doc_id"), CLEAN / labelled.get(0, 1)))
    sample = cut(docs.join(if_small(cut(known.where(share))), "doc_id").select("text", "toxic"))
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        share = n1 / (n1 + n0) if n1 + n0 else 0.05
        return Classifier({}, np.zeros(0, np.float32), float(np.log(np.clip(share, 0.01, 0.49) / (1 - np.clip(share, 0.01, 0.49)))))

    def count(batches):
        import pyarrow as pa

        tally: dict[str, list[int]] = {}

        def flush():
            out = pa.RecordBatch.from_pydict({"term": pa.array(list(tally), pa.string()), "a": pa.array([x[0] for x in tally.values()], pa.int64()), "b": pa.array([x[1] for x in tally.values()], pa.int64())})
            tally.clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for t in {t for w in distinct_words(text) for t in terms_of_word(w)}:
                    tally.setdefault(t, [0, 0])[0 if toxic else 1] += 1
                if len(tally) > 300_000:
                    yield flush()
        yield flush()

    terms = sample.mapInArrow(count, "term string, a bigint, b bigint").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    odds = F.log((F.col("a") + 0.1) / (n1 - F.col("a") + 0.1)) - F.log((F.col("b") + 0.1) / (n0 - F.col("b") + 0.1))
    scored = cut(terms.where("a + b >= 3").withColumn("z", odds / F.sqrt(1 / (F.col("a") + 0.1) + 1 / (F.col("b") + 0.1))).withColumn("sure", odds * F.sqrt(F.col("a"))))
    positive = scored.where(f"a >= 3 AND a * {n0} >= 20 * b * {n1}").orderBy(F.desc("sure"), "term").limit(LEXICON).collect()
    useful = scored.orderBy(F.desc(F.abs("z")), "term").limit(TERMS - LEXICON).collect()
    index = {t: k for k, t in enumerate(dict.fromkeys([*(r["term"] for r in positive), *(r["term"] for r in useful)]))}
    dealt: dict[bool, int] = {True: 0, False: 0}
    lexicon = {}
    for r in positive:
        start = r["term"].endswith("-")
        lexicon[r["term"]] = LEXICONS * start + dealt[start] % LEXICONS
        dealt[start] += 1
    voters = Voters(lexicon)

    def finder():
        vote = voters.voter()
        tell = Memo(lambda w: tuple(index[t] for t in terms_of_word(w) if t in index), 150_000)
        return vote, lambda words: sorted({k for w in words for k in tell[w]})

    def anchored():
        vote, find = finder()

        def out(row):
            words = distinct_words(row["text"])
            yield vote(row["text"], words), row["toxic"], find(words)

        return out

    drawn = map_rows(sample, anchored, "mask bigint, toxic int, found array<int>").collect()
    drawn.sort(key=lambda r: (r["mask"], r["toxic"], r["found"]))
    votes, y = bits([r["mask"] for r in drawn], voters.n), np.array([r["toxic"] for r in drawn])
    # A first model, of the anchors alone, tells which texts to draw more often; how likely each kind is comes from the labels.
    first = fit_label_model(votes, np.zeros(len(votes)), votes, y, rounds=1)
    total, toxic_share = docs.count(), min(max(labelled.get(1, 0) / max(sum(labelled.values()), 1), 0.005), 0.5)
    draw = [int(min(1.0, n / max(total * s, 1)) * (1 << 40)) for n, s in ((CLEAN, 1 - toxic_share), (TOXIC, toxic_share))]

    def all_votes():
        vote, find = finder()
        likely = Memo(lambda mask: bool(first.posterior(bits([mask], voters.n))[0] >= 0.5), 100_000)

        def out(rows):
            seen = Counter()
            for r in rows:
                words = distinct_words(r["text"])
                mask = vote(r["text"], words)
                seen[mask] += 1
                if r["draw"] < draw[likely[mask]]:
                    yield mask, None, find(words)
            for mask, n in seen.items():
                yield mask, n, None

        return out

    voted = cut(map_rows(docs.select("text", F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 40)).alias("draw")), all_votes, "mask bigint, n bigint, found array<int>", chunks=True))
    patterns = voted.where("n IS NOT NULL").groupBy("mask").agg(F.sum("n").alias("n")).orderBy("mask").collect()  # 2 ** voters at most
    rows = sorted(voted.where("n IS NULL").select("mask", "found").collect())  # about CLEAN + TOXIC
    model = fit_label_model(bits([r["mask"] for r in patterns], voters.n), np.array([r["n"] for r in patterns]), votes, y)

    def features(found):
        x = np.zeros((len(found), len(index)), np.float32)
        for k, at in enumerate(found):
            x[k, at] = 1
        return x

    x = features([r["found"] for r in rows])
    return fit_classifier(x, model.posterior(bits([r["mask"] for r in rows], voters.n)), features([r["found"] for r in drawn]), y, index)


def score(docs: DataFrame, classifier: Classifier, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row, from the text alone. Null and empty texts score the bias alone; long
    texts are read whole. Ids may be null or repeat; other columns are ignored; an empty table gives no rows."""
    kind = dict(docs.dtypes)[id_col]
    sent = Shared(docs.sparkSession, classifier)  # at most TERMS terms

    def make():
        of = sent.value.scorer()
        return lambda row: [(row["doc_id"], of(row["text"]))]

    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, f"doc_id {kind}, score double")


def held_out(id_col: str = "doc_id"):
    """Rows whose crc32(id as text) mod 5 is 0 teach nothing."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
