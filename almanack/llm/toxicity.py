"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from almanack.llm.session import drop, write
from almanack.llm.textkit import LOWER, NOT_ITEM_WORD, SLICE_BYTES, U64, WordHasher, byte_set, row_starts, text_slices, word_bounds

#: Labelled texts of each class, by the order of a hash of their ids, that the model is fitted on.
#: They stay whole in the tasks; the driver holds their features and the entries of the lexicon.
ROWS_PER_CLASS = 4000
#: Bytes of the word prefixes that may enter the lexicon; 0 is the whole word.
PREFIXES = (0, 4, 5, 6)
#: Fixed list: second-person pronouns of common languages.
SECOND_PERSON = "you your yours yourself du dich dir dein deine ihr euch euer tu te ti toi ton ta tes vous votre vos usted ustedes tus vosotros os".split()
#: Digits and signs read as letters.
LEET = LOWER.copy()
LEET[[ord(c) for c in "013457@$!"]] = [ord(c) for c in "oieastasi"]
_UPPER, _ALPHA = byte_set(range(65, 91)), byte_set([*range(65, 91), *range(97, 123), *range(128, 256)])
_DIGIT, _EXCLAIM, _ASK, _SIGN = byte_set(range(48, 58)), byte_set(b"!"), byte_set(b"?"), byte_set(b"*@$#%&_+^~")
NEAR = 4
FEATURES = 13


def _entries(hasher: WordHasher, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Per prefix length, a hash of that prefix of each word (0 where the word is no longer than it)."""
    prefix = hasher.bytes.prefix(hasher.values[data])
    out = []
    for n in PREFIXES:
        stop = ends if not n else np.minimum(starts + n, ends)
        h = hasher.bytes.ranges(prefix, starts, stop) ^ U64(n * 0x51ED27)
        out.append(np.where(ends - starts > n, h, U64(0)))
    return out


def text_entries(data: np.ndarray, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Distinct entries of one whole text, and how often each occurs, up to three times."""
    data = LOWER[data]
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]), NOT_ITEM_WORD)
    found, times = np.unique(np.concatenate(_entries(hasher, data, starts, ends)), return_counts=True)
    return found[found != 0], np.minimum(times[found != 0], 3)


def learn_lexicons(entries: DataFrame, rows: list[tuple[int, int, int]], least: int = 3, odds: float = 2.5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted hashes and weights (log-odds of occurrence in toxic texts) of words and prefixes, learned from all
    texts but those of fold 0, from all but those of fold 1, and from all.

    entries are (hash, fold, toxic, times), one for each text and entry; rows are (fold, toxic, texts). Counts
    are summed in the tasks; only what enters a lexicon reaches the driver. An entry's occurrences, up to
    three a text, must be unlikely to fall in toxic texts by chance given the number of candidates, so that
    a small sample yields a small lexicon.
    """
    seen = {(f, y): n for f, y, n in rows}
    sums = [
        F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == y), F.lit(1) if v == "n" else F.col("times")).otherwise(0)).alias(f"{v}{f}{y}")
        for v in "nt" for f in (0, 1) for y in (0, 1)
    ]
    counted = write(entries.groupBy("hash").agg(*sums))
    subsets = [(1,), (0,), (0, 1)]
    of = lambda v, y, folds: sum((F.col(f"{v}{f}{y}") for f in folds), F.lit(0))
    known = counted.agg(*[F.count_if(of("n", 0, s) + of("n", 1, s) > 0).alias(f"k{i}") for i, s in enumerate(subsets)]).first()
    weights = []
    for i, s in enumerate(subsets):
        n_a, n_b = (sum(seen.get((f, y), 0) for f in s) for y in (1, 0))
        if not n_a or not n_b or not known[i]:
            weights.append(F.lit(None).cast("double"))
            continue
        a, b = of("n", 1, s), of("n", 0, s)
        evidence = of("t", 1, s) * float(np.log((n_a + n_b) / n_a)) - 3 * of("t", 0, s)
        weight = F.log((a + 0.5) / (n_a + 1.0)) - F.log((b + 0.5) / (n_b + 1.0))
        weights.append(F.when((a >= max(least, 0.004 * n_a)) & (weight >= odds) & (evidence >= 0.8 * float(np.log(known[i]))), weight))
    kept = counted.select("hash", *(w.alias(f"w{i}") for i, w in enumerate(weights))).where("w0 IS NOT NULL OR w1 IS NOT NULL OR w2 IS NOT NULL").toPandas()
    drop(counted)
    out = []
    for i in range(len(subsets)):
        w = kept[f"w{i}"].to_numpy(float)
        hashes = kept["hash"].to_numpy(np.int64).view(U64)[~np.isnan(w)]
        order = np.argsort(hashes)
        out.append((hashes[order], w[~np.isnan(w)][order]))
    return out


def features(data: np.ndarray, off: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray], hasher: WordHasher) -> np.ndarray:
    """Rows x FEATURES dense features of whole texts."""
    n_rows, hashes, weights = len(off) - 1, *lexicon
    lower = LOWER[data]
    starts, ends, rows = word_bounds(lower, off, NOT_ITEM_WORD)
    n_words = np.bincount(rows, minlength=n_rows)
    per_word = np.maximum(1, n_words)

    def lookup(source: np.ndarray, starts, ends) -> np.ndarray:
        best = np.zeros(len(starts))
        if len(hashes) and len(starts):
            for h in _entries(hasher, source, starts, ends):
                at = np.searchsorted(hashes, h)
                at[at == len(hashes)] = 0
                best = np.maximum(best, np.where(hashes[at] == h, weights[at], 0))
        return best

    best = lookup(lower, starts, ends)
    hit = best > 0
    pronoun_hashes = np.sort(np.array([hasher.bytes.ranges(hasher.bytes.prefix(hasher.values[np.frombuffer(w.encode(), np.uint8)]), np.array([0]), np.array([len(w.encode())]))[0] for w in SECOND_PERSON], U64))
    words = hasher.word_hashes(lower, starts, ends)
    at = np.searchsorted(pronoun_hashes, words)
    at[at == len(pronoun_hashes)] = 0
    pronoun = np.flatnonzero(pronoun_hashes[at] == words) if len(words) else np.zeros(0, int)
    near = np.zeros(n_rows)
    hits = np.flatnonzero(hit)
    if len(pronoun) and len(hits):
        i = np.searchsorted(pronoun, hits)
        for j in (np.maximum(i - 1, 0), np.minimum(i, len(pronoun) - 1)):
            close = (np.abs(pronoun[j] - hits) <= NEAR) & (rows[pronoun[j]] == rows[hits])
            near += np.bincount(rows[hits[close]], minlength=n_rows)
    sums = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[off])
    size = np.maximum(1, np.diff(off))
    letters = np.maximum(1, sums(_ALPHA[data]))
    # a sign or digit between two letters, and words of the lexicon once such signs are read as letters
    inner = np.zeros(len(data), bool)
    if len(data) > 2:
        inner[1:-1] = (_SIGN | _DIGIT)[data[1:-1]] & _ALPHA[data[:-2]] & _ALPHA[data[2:]]
    odd = np.flatnonzero(inner)
    hidden = np.zeros(n_rows)
    if len(odd):
        leet = LEET[data]
        s, e, r = word_bounds(leet, off, NOT_ITEM_WORD)
        holder = np.unique(np.searchsorted(s, odd, "right") - 1)
        holder = holder[holder >= 0]
        hidden = np.bincount(r[holder], lookup(leet, s[holder], e[holder]) > 0, n_rows)
    strongest = np.zeros(n_rows)
    np.maximum.at(strongest, rows[hits], best[hits])
    count = np.bincount(rows[hits], minlength=n_rows)
    return np.column_stack([
        count / per_word, np.log1p(count), np.bincount(rows, best, n_rows) / per_word, strongest, near / per_word, np.log1p(near),
        sums(_UPPER[data]) / letters, sums(_EXCLAIM[data]) / size, sums(_ASK[data]) / size, sums(_SIGN[data]) / size,
        sums(inner) / per_word, hidden, np.log1p(n_words),
    ])


class BoostedTrees:
    """Logistic gradient boosting over quantile-binned features with trees of fixed depth."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 2.0, least: float = 4.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins)[1:-1])) for c in x.T]
        binned = self._binned(x)
        mean = np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4)
        self.base, self.model = float(np.log(mean / (1 - mean))), []
        f, n_features = np.full(len(y), self.base), x.shape[1]
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = w * (y - p), w * p * (1 - p)
            node, nodes = np.zeros(len(y), int), 1
            splits = []
            for _ in range(self.depth):
                best = [(1e-6, 0, self.bins)] * nodes
                for j in range(n_features):
                    at = node * self.bins + binned[:, j]
                    gs, hs, ns = (np.bincount(at, v, nodes * self.bins).reshape(nodes, self.bins).cumsum(1) for v in (g, h, np.ones(len(y))))
                    gr, hr, nr = gs[:, -1:] - gs, hs[:, -1:] - hs, ns[:, -1:] - ns
                    gain = gs**2 / (hs + self.ridge) + gr**2 / (hr + self.ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + self.ridge)
                    gain[(ns < self.least) | (nr < self.least)] = 0
                    for k in range(nodes):
                        b = int(np.argmax(gain[k]))
                        if gain[k, b] > best[k][0]:
                            best[k] = (gain[k, b], j, b)
                feature, cut = np.array([b[1] for b in best]), np.array([b[2] for b in best])
                splits.append((feature, cut))
                node = node * 2 + (binned[np.arange(len(y)), feature[node]] > cut[node])
                nodes *= 2
            leaf = np.bincount(node, g, nodes) / (np.bincount(node, h, nodes) + self.ridge)
            self.model.append((splits, self.rate * leaf))
            f += self.rate * leaf[node]
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned, at = self._binned(x), np.arange(len(x))
        f = np.full(len(x), self.base)
        for splits, leaf in self.model:
            node = np.zeros(len(x), int)
            for feature, cut in splits:
                node = node * 2 + (binned[at, feature[node]] > cut[node])
            f += leaf[node]
        return f


def isotonic(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots (score, non-decreasing mean) for linear interpolation."""
    known, at = np.unique(score, return_inverse=True)
    blocks: list[list[float]] = []  # weight, weighted sum, first and last score
    for s, total, weight in zip(known, np.bincount(at, w * y), np.bincount(at, w)):
        blocks.append([weight, total, s, s])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
    xs = [x for b in blocks for x in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
    ys = [y for b in blocks for y in ((b[1] / b[0],) * (2 if b[3] > b[2] else 1))]
    return np.array(xs), np.clip(ys, 0, 1)


class ToxicityModel:
    """Lexicon, trees and calibration from labelled texts; `rate` is the share of label 1 in all labels.

    lexicons are those of learn_lexicons; x is the texts x FEATURES array by the lexicon that has not seen a text's fold.
    """

    def __init__(self, lexicons, x: np.ndarray, toxic: np.ndarray, folds: np.ndarray, rate: float):
        self.rate, self.model = rate, None
        if len(toxic) < 10 or not 0 < toxic.mean() < 1:
            return
        w = np.where(toxic == 1, rate / toxic.mean(), (1 - rate) / (1 - toxic.mean()))
        raw = np.zeros(len(toxic))
        # the lexicon that a row's features come from, and the trees that its calibration score
        # comes from, have not seen its label
        for fold in (0, 1):
            m = BoostedTrees().fit(x[folds != fold], toxic[folds != fold], w[folds != fold]) if (folds != fold).any() else None
            if m is not None and (folds == fold).any():
                raw[folds == fold] = m.raw(x[folds == fold])
        self.knots = isotonic(raw, toxic, w)
        self.lexicon = lexicons[2]
        self.model = BoostedTrees().fit(x, toxic, w)

    def scores(self, data: np.ndarray, off: np.ndarray, hasher: WordHasher) -> np.ndarray:
        if self.model is None:
            return np.full(len(off) - 1, self.rate)
        return np.interp(self.model.raw(features(data, off, self.lexicon, hasher)), *self.knots)


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> ToxicityModel:
    """Fit on at most rows_per_class texts of each label, of rows whose crc32(doc_id as text) mod 4 is not 2."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    share = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = [marked.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class) for y in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", text.alias("text"))
    # whole texts, read twice by the tasks
    sample = write(sample.withColumn("hash", F.xxhash64("text")).withColumn("fold", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(2)).cast("int")))
    order = [("doc_id", "ascending"), ("hash", "ascending")]

    def count(batches):
        hasher = WordHasher()
        for batch, raw, off in text_slices(batches):
            found = [text_entries(raw[a:b], hasher) for a, b in zip(off[:-1], off[1:])]
            row = pa.array(np.repeat(np.arange(len(found)), [len(e) for e, _ in found]))
            flat = [np.concatenate(x) for x in zip(*found)]
            yield pa.RecordBatch.from_arrays([pa.array(flat[0].view(np.int64)), batch.column("fold").take(row), batch.column("toxic").cast(pa.int32()).take(row), pa.array(flat[1].astype(np.int8))], ["hash", "fold", "toxic", "times"])

    rows = [tuple(r) for r in sample.groupBy("fold", F.col("toxic").cast("int")).agg(F.count("*")).collect()]
    lexicons = learn_lexicons(sample.mapInArrow(count, "hash long, fold int, toxic int, times tinyint"), rows)

    def measure(batches):
        hasher = WordHasher()
        for batch, raw, off in text_slices(batches):
            fold = batch.column("fold").to_numpy()
            x = np.where(fold[:, None] == 0, *(features(raw, off, lexicons[f], hasher) for f in (0, 1)))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), batch.column("fold"), batch.column("toxic").cast(pa.int32()), flat], ["doc_id", "hash", "fold", "toxic", "x"])

    found = sample.mapInArrow(measure, f"doc_id {dict(sample.dtypes)['doc_id']}, hash long, fold int, toxic int, x array<double>").toArrow().sort_by(order)
    x = np.array(found.column("x").combine_chunks().flatten()).reshape(found.num_rows, FEATURES)
    drop(sample)
    return ToxicityModel(lexicons, x, found.column("toxic").to_numpy().astype(float), found.column("fold").to_numpy(), share.get(1, 0) / max(1, sum(share.values())))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, keep_clean: bool = False) -> DataFrame:
    """Score every whole text; with keep_clean=True return instead the rows of docs not predicted toxic.

    Features are densities of a lexicon of words and word prefixes learned from the labels, their
    nearness to second-person pronouns, capitals, punctuation and obfuscation rates. The trees are
    fitted on a bounded sample (see fit) and calibrated on rows held out in turn. Scoring is one
    narrow pass. Returns doc_id, held_out, score and predicted (1 if score >= threshold, else 0).

    Null and empty texts get the score of a text without words. Without labels of both kinds the
    score is the share of label 1, 0 without labels. A null id isn't held out; several labels of one
    id count as their greatest; equal rows each get their row; keep_clean keeps all columns.
    """
    model = fit(docs, labels)

    if keep_clean:
        def clean(batches):
            hasher = WordHasher()
            for batch, raw, off in text_slices(batches, limit=SLICE_BYTES):
                yield batch.filter(pa.array(model.scores(raw, off, hasher) < threshold))

        return docs.mapInArrow(clean, docs.schema)

    def run(batches):
        hasher = WordHasher()
        for batch, raw, off in text_slices(batches, limit=SLICE_BYTES):
            score = model.scores(raw, off, hasher)
            held = pa.array([x == 2 for x in batch.column("rem").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), held, pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    kind = dict(docs.dtypes)["doc_id"]
    source = docs.select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4).alias("rem"))
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
