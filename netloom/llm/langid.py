"""Language identification by interpolated Kneser-Ney character models, one per language.

A text is its stream of lower-cased words of letters, each framed by a mark; contexts don't cross words. Character
n-grams of the training texts are counted in Spark (partial counts per task, then sums); the model of each language is
kept in sorted arrays of n-gram hashes with log-probability and back-off weight. A text's language is that of the lowest
cross-entropy per character. Rejection is calibrated with training texts that were kept out of the counts, and with their
beginnings for the short length classes. Per language and length class they give the cross-entropy that all but a small
share of texts stay under; scored without their own language, they show what texts of a language that was not learned cost.
Where the two are apart the limit lies halfway, else it is the first.

The training rows are a bounded sample: about ``per_language`` texts of each language, those with the smallest hash of
id and text. This bounds the model on the driver and in the workers. Everything else covers all rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE_1, Shared, map_rows, mix

ORDER, PER_LANGUAGE, CALIBRATION_SHARE = 5, 2000, 5
#: Rejection: this quantile of the calibration texts' cross-entropy, and the one of texts scored without their language.
QUANTILE, FOREIGN = 0.999, 0.01
#: Upper ends of the length classes, in letters.
LENGTHS = (16, 64, 256, 1024)
MARK = "\x02"
LETTERS = re.compile(r"[^\W\d_]+").findall


def letter_words(text: str | None) -> list[str]:
    """Runs of letters, in lower case; figures such as \u00b2 or \u2167, which a word pattern takes in, are none."""
    words = LETTERS(text.lower()) if text else []
    if words and not "".join(words).isalpha():
        words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split(" ")
        words = [w for w in words if w]
    return words


def length_class(n: int) -> int:
    return sum(n > x for x in LENGTHS)


def beginnings(text: str | None) -> list[str]:
    """The first words of a text up to the two shortest length classes' ends, where it is longer."""
    words, out = letter_words(text), []
    ends = np.cumsum([len(w) for w in words])
    for most in LENGTHS[:2]:
        k = int(np.searchsorted(ends, most, "right"))
        if 0 < k < len(words):
            out.append(" ".join(words[:k]))
    return out


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order the hash of the n-gram that ends at each position (those that would begin before 0 are void)."""
    out, sums = [], codes.astype(np.uint64) + np.uint64(1)
    first, power = sums, np.uint64(1)
    with np.errstate(over="ignore"):
        for n in range(1, order + 1):
            if n > 1:
                power = power * np.uint64(BASE_1)
                sums = sums.copy()
                sums[n - 1 :] += first[: len(first) - n + 1] * power
            out.append(mix(sums + np.uint64(n)))
    return out


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Table:
    """One language's model: sorted n-gram hashes with interpolated log-probability, and contexts with log back-off weight."""

    grams: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    back: np.ndarray
    floor: float

    def costs(self, grams: list[np.ndarray], room: np.ndarray) -> np.ndarray:
        """Nats of each position, given the n-grams that end there and how many characters its word has up to it."""
        cost, open_ = np.zeros(len(room)), np.arange(len(room))
        for n in range(len(grams), 0, -1):
            here = open_[room[open_] >= n]
            if not len(here):
                continue
            h = grams[n - 1][here]
            k = np.minimum(self.grams.searchsorted(h), len(self.grams) - 1)
            hit = self.grams[k] == h
            cost[here[hit]] -= self.logp[k[hit]]
            miss = here[~hit]
            if n == 1:
                cost[miss] -= self.floor
            else:
                h = grams[n - 2][miss - 1]
                k = np.minimum(self.contexts.searchsorted(h), len(self.contexts) - 1)
                seen = self.contexts[k] == h
                cost[miss[seen]] -= self.back[k[seen]]
            done = np.zeros(len(room), bool)
            done[here[hit]] = True
            open_ = open_[~done[open_]]
        return cost


@dataclass
class Model:
    langs: list[str]
    tables: list[Table]
    order: int = ORDER
    limits: dict[tuple[str, int], float] = field(default_factory=dict)

    def word_costs(self, words: list[str]) -> np.ndarray:
        """A row per word: nats for its letters and end mark in each language."""
        text = MARK + MARK.join(words) + MARK
        codes = codes_of(text)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.r_[0, ends[:-1]]
        grams, room = gram_hashes(codes, self.order), np.ones(len(codes), np.int64)
        room[0] = 0
        room[1:] = np.arange(1, len(codes)) - np.repeat(starts, [len(w) + 1 for w in words]) + 1
        return np.column_stack([np.add.reduceat(t.costs(grams, room)[1:], starts) for t in self.tables])

    def scorer(self, memory: int = 300_000):
        """texts -> list of (lang, cross-entropy, probability, letters); costs of words are remembered, boundedly."""
        known: dict[str, int] = {}
        costs = np.zeros((0, len(self.langs)))

        def score(texts: list[str | None]):
            nonlocal costs
            split = [letter_words(t) for t in texts]
            if len(known) > memory:
                known.clear()
                costs = costs[:0]
            new = list({w for words in split for w in words if w not in known}) if self.langs else []
            if new:
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                costs = np.concatenate([costs[: len(known) - len(new)], self.word_costs(new)])
            out = []
            for words in split:
                if not words or not self.langs:
                    out.append(("und", None, 0.0, 0))
                    continue
                letters = sum(map(len, words))
                total = costs[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(0)
                mean = total / (letters + len(words))
                best = int(mean.argmin())
                odds = np.exp(-(mean - mean[best]) * min(letters + len(words), 200))
                out.append((self.langs[best], float(mean[best]), float(1 / odds.sum()), letters))
            return out

        return score

    def rejects(self, lang: str, cross: float | None, letters: int) -> bool:
        return cross is None or cross > self.limits.get((lang, length_class(letters)), np.inf)


def kneser_ney(counts: dict[str, int], order: int) -> Table:
    """Interpolated Kneser-Ney from counts of n-grams of the full order and of those that begin a word (shorter)."""
    level: list[Counter] = [Counter() for _ in range(order + 1)]
    for gram, n in counts.items():
        level[len(gram)][gram] += n
    # Below the highest order a count is the number of different left neighbours, except at a word's start.
    kept: list[Counter] = [Counter() for _ in range(order + 1)]
    kept[order] = Counter(level[order])
    for n in range(order - 1, 0, -1):
        starts = {g: c for g, c in level[n].items() if g[0] == MARK and n > 1}
        kept[n] = Counter(starts)
        for gram in kept[n + 1]:
            if gram[1:] not in starts and (gram[1] != MARK or n == 1):
                kept[n][gram[1:]] += 1
    prob: dict[str, float] = {}
    back: dict[str, float] = {}
    alphabet = len(kept[1]) + 1
    singles = sum(kept[1].values())
    d = 0.75
    for g, c in kept[1].items():
        prob[g] = max(c - d, 0) / singles + d * len(kept[1]) / singles / alphabet
    floor = d * len(kept[1]) / max(singles, 1) / alphabet if singles else 1.0
    for n in range(2, order + 1):
        ones, twos = sum(c == 1 for c in kept[n].values()), sum(c == 2 for c in kept[n].values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        sums, kinds = Counter(), Counter()
        for g, c in kept[n].items():
            sums[g[:-1]] += c
            kinds[g[:-1]] += 1
        for ctx, s in sums.items():
            back[ctx] = d * kinds[ctx] / s
        for g, c in kept[n].items():
            prob[g] = max(c - d, 0) / sums[g[:-1]] + back[g[:-1]] * prob.get(g[1:], floor)

    def arrays(x: dict[str, float]):
        names, h = list(x), np.zeros(len(x), np.uint64)
        for n in range(1, order + 1):
            if here := [k for k, g in enumerate(names) if len(g) == n]:
                h[here] = gram_hashes(codes_of("".join(names[k] for k in here)), order)[n - 1][n - 1 :: n]
        at = np.argsort(h)
        return h[at], np.log(np.maximum(np.array(list(x.values()), np.float64), 1e-12))[at]

    return Table(*arrays(prob), *arrays(back), float(np.log(floor)))


def _counts(rows: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n) of the texts of (lang, text): n-grams of the full order, and shorter ones that begin a word."""

    def run(batches):
        import pyarrow as pa

        words: dict[str, Counter] = {}

        def flush():
            grams = Counter()
            for lang, count in words.items():
                for w, n in count.items():
                    framed = MARK + w + MARK
                    for end in range(2, len(framed) + 1):
                        grams[lang, framed[max(0, end - order) : end]] += n
            words.clear()
            keys = list(grams)
            return pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in keys], pa.string()), "gram": pa.array([k[1] for k in keys], pa.string()), "n": pa.array([grams[k] for k in keys], pa.int64())})

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(letter_words(text))
            if sum(map(len, words.values())) > 300_000:
                yield flush()
        if words:
            yield flush()

    return rows.mapInArrow(run, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(rows: DataFrame, *, order: int = ORDER, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from ``rows(doc_id, text, lang)``; rows with null text or language teach nothing.

    Of each language about ``per_language`` texts are used, one in ``CALIBRATION_SHARE`` of them for the limits of
    rejection only. A language whose sampled texts hold no letter is not learned; without any the model says ``und``.
    Repeated rows count each, but are drawn or left out together; extra columns are ignored.
    """
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    keyed = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("draw"))
    # The smallest draws of each language: a threshold from the language's size, so no group is sorted in one task.
    sizes = {r["lang"]: r["n"] for r in keyed.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], [], order)
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))])[F.col("lang")]
    sample = keyed.where(F.pmod("draw", F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text", F.pmod(F.shiftright("draw", 24), F.lit(CALIBRATION_SHARE)).alias("fold"))
    grams: dict[str, dict[str, int]] = {lang: {} for lang in langs}
    for r in _counts(sample.where("fold <> 0"), order).toPandas().itertuples():
        grams[r.lang][r.gram] = r.n
    # A language with few texts may have all of them in the fold for calibration; it learns from these.
    few = [lang for lang in langs if not grams[lang]]
    if few:
        for r in _counts(sample.where("fold = 0").where(F.col("lang").isin(few)), order).toPandas().itertuples():
            grams[r.lang][r.gram] = r.n
    langs = [lang for lang in langs if grams[lang]]
    if not langs:
        return Model([], [], order)
    sample = sample.where(F.col("lang").isin(langs))
    model = Model(langs, [kneser_ney(grams[lang], order) for lang in langs], order)

    def calibrate():
        score = model.scorer()
        others = {lang: Model([x for x in langs if x != lang], [t for x, t in zip(langs, model.tables, strict=True) if x != lang], order).scorer() for lang in langs}

        def out(rows):
            for row in rows:
                texts = [row["text"], *beginnings(row["text"])]
                for lang, cross, _, letters in score(texts):
                    if cross is not None and lang == row["lang"]:
                        yield lang, length_class(letters), False, cross
                for lang, cross, _, letters in others[row["lang"]](texts):
                    if cross is not None:
                        yield lang, length_class(letters), True, cross

        return out

    found = map_rows(sample.where("fold = 0").select("lang", "text"), calibrate, "lang string, size int, alien boolean, cross double", chunks=True)
    cost = F.percentile("cross", F.array(F.lit(FOREIGN), F.lit(QUANTILE)))
    limits = {(r["lang"], r["size"], r["alien"]): r for r in found.groupBy("lang", "size", "alien").agg(cost.alias("q"), F.count("*").alias("n")).collect()}
    for lang in langs:
        clean = [r for (x, _, alien), r in limits.items() if x == lang and not alien]
        widest = max((r["q"][1] for r in clean), default=np.inf)
        for size in range(len(LENGTHS) + 1):
            own, alien = limits.get((lang, size, False)), limits.get((lang, size, True))
            q = own["q"][1] if own and own["n"] >= 50 else widest
            low = alien["q"][0] if alien and alien["n"] >= 5 else q
            model.limits[lang, size] = float(max(q, (q + low) / 2))
    return model


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, cross_entropy, rejected`` for every row, from its text alone.

    ``und`` with score 0 and rejected: text null, or without a letter, or no language learned. ``score`` is the share of
    the best language in the likelihoods at the text's mean cross-entropy. Ties go to the language first in order. Ids may
    be null or repeat; long texts are read whole; other columns are ignored, so names can't clash. An empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    sent = Shared(docs.sparkSession, model)  # bounded by per_language

    def make():
        model = sent.value
        score = model.scorer()

        def out(rows):
            for row, (lang, cross, sure, letters) in zip(rows, score([r["text"] for r in rows]), strict=True):
                yield row["doc_id"], lang, sure, cross, model.rejects(lang, cross, letters)

        return out

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, make, f"doc_id {kind}, lang_pred string, score double, cross_entropy double, rejected boolean", chunks=True)


def held_out(id_col: str = "doc_id"):
    """Rows whose crc32(id as text) mod 4 is 2 teach nothing."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
