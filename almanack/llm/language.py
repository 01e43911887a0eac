"""Language mixtures of documents by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from almanack.llm.textkit import text_slices

#: Hash bins of byte trigrams.
BINS = 1 << 14
#: Labelled documents (about) of each language that the model is learned from.
ROWS_PER_LANGUAGE = 2000
#: Lower-cased letters and bytes of longer characters stay; all else is a space.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def _bins(folded: np.ndarray) -> np.ndarray:
    """Bin of each trigram of one text with a space on both sides; runs of spaces give none."""
    x = np.concatenate(([32], folded, [32])).astype(np.uint32)
    grams = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    grams = grams[~((x[1:-1] == 32) & ((x[:-2] == 32) | (x[2:] == 32)))]
    return ((grams * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


def _learn(docs: DataFrame, rows_per_language: int) -> tuple[list[str], np.ndarray]:
    """All languages and log-likelihood table (BINS x languages) from a hash sample of labelled rows."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((BINS, 0))
    share = docs.sparkSession.createDataFrame([(lang, min(1.0, rows_per_language / n)) for lang, n in sorted(sizes.items())], "lang string, share double")
    # one row a language, as the table of likelihoods has one column a language
    sample = labelled.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.col("share") * 1_000_003)

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        for batch, raw, off in text_slices(batches):
            folded = FOLD[raw]
            for r, lang in enumerate(batch.column("lang").to_pylist()):
                counts.setdefault(lang, np.zeros(BINS, np.int64))
                counts[lang] += np.bincount(_bins(folded[off[r] : off[r + 1]]), minlength=BINS)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], ["lang", "bin", "n"])

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    langs, table = sorted(sizes), np.full((BINS, len(sizes)), 0.1)
    place = {lang: i for i, lang in enumerate(langs)}
    for r in counted.toLocalIterator():  # at most BINS rows a language
        table[r.bin, place[r.lang]] += r.n
    return langs, np.log(table / table.sum(0))


def mixture(counts: np.ndarray, likelihoods: np.ndarray, penalty: float, rounds: int = 12) -> np.ndarray:
    """Proportions of the languages in a text of n-gram counts with likelihoods (n-grams x languages).

    EM from equal shares; then languages are dropped, least share first, while the penalised
    log-likelihood, ll - penalty * languages * log(n), doesn't fall.
    """
    n = counts.sum()

    def fit(use: list[int], shares: np.ndarray) -> tuple[np.ndarray, float]:
        p = likelihoods[:, use]
        for _ in range(rounds):
            mixed = p @ shares
            new = shares * ((counts / mixed) @ p) / n
            done = np.abs(new - shares).max() < 1e-3
            shares = new
            if done:
                break
        return shares, float(counts @ np.log(p @ shares)) - penalty * len(use) * np.log(n + 1)

    use = list(range(likelihoods.shape[1]))
    shares, best = fit(use, np.full(len(use), 1 / len(use)))
    while len(use) > 1:
        low = int(np.argmin(shares))
        fewer = use[:low] + use[low + 1 :]
        start = np.delete(shares, low)
        trial, value = fit(fewer, start / start.sum() if start.sum() > 0 else np.full(len(fewer), 1 / len(fewer)))
        if value < best:
            break
        use, shares, best = fewer, trial, value
    out = np.zeros(likelihoods.shape[1])
    out[use] = shares
    return out


def _has_letter(text: np.ndarray) -> bool:
    if (((text | 32) >= 97) & ((text | 32) <= 122)).any():
        return True
    return bool((text >= 128).any()) and any(c.isalpha() for c in text.tobytes().decode("utf-8", "replace"))


def languages(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, penalty: float = 1.0, mixtures: bool = False) -> DataFrame:
    """The main language of every whole text, and its share.

    Learns byte-trigram likelihoods from text and lang of rows whose crc32(doc_id as text) mod 3 is
    not 1: about rows_per_language rows of each lang, by a hash of the id. The table takes 128 KB a
    language and EM's time grows with the square of their number. Each text's proportions are fitted by EM over its trigram counts, and languages
    dropped while the penalised likelihood allows. Returns doc_id, held_out, lang_pred (largest
    share, least name on ties) and score (that share); with mixtures=True also the map of shares.

    `und` and 0 for null text or one without a letter, and where nothing could be learned. A null id
    has no remainder: it is neither learned from nor held out. Equal rows each get their row.
    """
    ids = docs.select("doc_id", "text", "lang", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3).alias("rem"))
    langs, table = _learn(ids.where("rem <> 1"), rows_per_language)
    likelihoods = np.exp(table)

    def run(batches):
        for batch, raw, off in text_slices(batches):
            folded, found, scores, shares = FOLD[raw], [], [], []
            for r in range(batch.num_rows):
                a, b = off[r], off[r + 1]
                counts = np.bincount(_bins(folded[a:b]), minlength=BINS) if b > a and langs and _has_letter(raw[a:b]) else None
                at = np.flatnonzero(counts) if counts is not None else ()
                if not len(at):
                    found.append("und")
                    scores.append(0.0)
                    shares.append([])
                    continue
                m = mixture(counts[at].astype(float), likelihoods[at], penalty)
                best = int(np.argmax(m))
                found.append(langs[best])
                scores.append(float(min(1.0, max(0.0, m[best]))))
                shares.append([(langs[i], float(m[i])) for i in np.flatnonzero(m)])
            held = pa.array([x == 1 for x in batch.column("rem").to_pylist()])
            arrays = [batch.column("doc_id"), held, pa.array(found, pa.string()), pa.array(scores, pa.float64())]
            if mixtures:
                arrays.append(pa.array(shares, pa.map_(pa.string(), pa.float64())))
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if mixtures:
        schema = schema.add("shares", T.MapType(T.StringType(), T.DoubleType()))
    names = schema.names
    return ids.select("doc_id", "text", "rem").mapInArrow(run, schema)
