"""Keyword, vector and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from almanack.session import keep, spread


def term_frequencies(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(id, term, tf), summed before the shuffle."""
    return docs.select(F.col(id_col).alias("id"), F.explode(tokens).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, id_col: str, tokens: Column, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of documents with enough of the query's distinct terms: all of two, else 60 %, rounded up.

    One narrow pass over the texts leaves a row of small numbers for each document, its length and how often it has each
    term; lengths and document frequencies are summed from those, and each document is scored where it lies. Nothing but
    one row is shuffled or broadcast.
    """
    terms = list(dict.fromkeys(query))
    need = len(terms) if len(terms) <= 2 else -(-6 * len(terms) // 10)
    counts = [(F.size("t") - F.size(F.array_remove("t", q))).alias(f"tf{i}") for i, q in enumerate(terms)]
    # kept, so that texts are cut once: a filter on the counts would be pushed below them and cut the text again for each
    sized = keep(docs.select(F.col(id_col).alias("id"), tokens.alias("t")).select("id", F.size("t").alias("dl"), *counts))
    tf = [F.col(f"tf{i}") for i in range(len(terms))]
    stats = sized.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.array(*[F.count_if(c > 0) for c in tf]).alias("df"))
    have = sum((F.when(c > 0, 1).otherwise(0) for c in tf), F.lit(0))
    hits = sized.where(have >= need).join(F.broadcast(stats))

    def part(i):
        df = F.get("df", F.lit(i))
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        return F.when(tf[i] > 0, idf * tf[i] * (k1 + 1) / (tf[i] + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).otherwise(0.0)

    return hits.select("id", sum((part(i) for i in range(len(terms))), F.lit(0.0)).alias("score"))


def prune_to_best(hits: DataFrame, share: float = 0.3, score: str = "score") -> DataFrame:
    """Hits of at least that share of the best score."""
    return hits.join(F.broadcast(hits.agg(F.max(score).alias("_best")))).where(F.col(score) >= share * F.col("_best")).drop("_best")


def cut_semantic(hits: DataFrame, floor: float = 0.40, window: float = 0.16, least: float | None = None, limit: int = 200, sim: str = "sim") -> DataFrame:
    """At most `limit` hits within `window` of the best and at least `least` (else floor); none at all if the best is under `floor`."""
    best = F.broadcast(hits.agg(F.max(sim).alias("_best")))
    near = (F.col("_best") >= floor) & (F.col(sim) >= F.greatest(F.lit(floor if least is None else least), F.col("_best") - window))
    return hits.join(best).where(near).drop("_best").orderBy(F.desc(sim), "id").limit(limit)


def veto(keyword: DataFrame, semantic: DataFrame, least: float = 0.26) -> DataFrame:
    """Keyword hits without those whose similarity is known and low."""
    return keyword.join(semantic.select("id", "sim"), "id", "left").where(F.coalesce("sim", F.lit(1.0)) >= least).drop("sim")


def _ranked(hits: DataFrame, score: str, limit: int) -> DataFrame:
    """Zero-based ranks of the best `limit` hits: a top-k first, so the window sees no more rows."""
    top = hits.orderBy(F.desc(score), "id").limit(limit)
    return top.select("id", (F.row_number().over(Window.orderBy(F.desc(score), "id")) - 1).alias("r"))


def fuse(keyword: DataFrame, semantic: DataFrame, k: float = 60, w_keyword: float = 0.9, w_semantic: float = 1.0, limit: int = 2000) -> DataFrame:
    """Reciprocal-rank fusion of the two lists' best `limit`."""
    a, b = _ranked(keyword, "score", limit).withColumnRenamed("r", "a"), _ranked(semantic, "sim", limit).withColumnRenamed("r", "b")
    part = lambda w, c: F.coalesce(F.lit(float(w)) / (k + F.col(c)), F.lit(0.0))
    return a.join(b, "id", "full").select("id", (part(w_keyword, "a") + part(w_semantic, "b")).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def semantic_scan(vectors: DataFrame, id_col: str, vector_col: str, query: list[float]) -> DataFrame:
    """(id, sim): exact cosine of every row with the query, scaled to length 1, as a literal."""
    norm = sum(x * x for x in query) ** 0.5 or 1.0
    q = F.array(*[F.lit(x / norm) for x in query])
    return vectors.select(F.col(id_col).alias("id"), cosine(F.col(vector_col), q).alias("sim"))


def hybrid(keyword: DataFrame, semantic: DataFrame | None, scope: DataFrame | None = None, limit: int = 200, keywords: int = 2000, scope_first: bool = False) -> DataFrame:
    """The best `limit` of pruned keyword hits and cut semantic hits, vetoed and fused; keyword hits alone without vectors.

    With a scope (id) only its rows are searched, and once the best meaning match is good enough the next dozen
    may be less so. The scope applies to the best `keywords` hits of all, which may leave a small scope few of them;
    with scope_first it applies before, so that a scope has all its hits whatever is found outside.
    """
    inside = lambda df: df if scope is None else df.join(scope.select("id"), "id", "left_semi")
    best = lambda df: df.orderBy(F.desc("score"), "id").limit(keywords)
    keyword = keep(best(inside(keyword)) if scope_first else inside(best(keyword)))  # read several times below
    keyword = prune_to_best(keyword).orderBy(F.desc("score"), "id").limit(limit)
    if semantic is None:
        return keyword
    if scope is None:
        near = cut_semantic(semantic, limit=limit)
    else:
        semantic = semantic.join(scope.select("id"), "id", "left_semi")
        near = cut_semantic(semantic, window=0.2, least=0.30, limit=min(limit, 12))
    return fuse(veto(keyword, semantic), near, limit=limit).orderBy(F.desc("score"), "id").limit(limit)


def weighted_terms(rows: DataFrame, fields: list[tuple[Column, float]], boost: Column, short: Column) -> DataFrame:
    """(id, term, weight) of rows (id, ...): term counts, each field's by its weight, saturated and boosted; a title of
    three words or fewer counts 1.15 times."""
    weighed = lambda tokens, weight: F.transform(tokens, lambda x: F.struct(x.alias("term"), F.lit(float(weight)).alias("w")))
    each = F.flatten(F.array(*[weighed(tokens, weight) for tokens, weight in fields]))
    tf = spread(rows, "id").select("id", (boost * F.when(short, 1.15).otherwise(1.0)).alias("boost"), F.explode(each).alias("x"))  # dealt by id, so terms need no other shuffle
    summed = tf.groupBy("id", "boost", F.col("x.term").alias("term")).agg(F.sum("x.w").alias("f"))
    return summed.select("id", "term", F.round(F.col("f") / (F.col("f") + 1.2) * F.col("boost"), 3).alias("weight"))


def index_or_title(index_hits: DataFrame, rows: DataFrame, title: Column, words: list[str]) -> DataFrame:
    """(id): rows that the index found, and rows whose title holds all words."""
    lower, every = F.lower(title), F.lit(True)
    for w in words:
        every = every & F.contains(lower, F.lit(w.lower()))
    return index_hits.select("id").union(rows.where(every).select("id")).distinct()


def inverted_index(weighted: DataFrame, shard: Column, postings: int | None = 400) -> DataFrame:
    """(shard, term, df, id, weight) from (id, term, boost, tf) or (id, term, weight): the best `postings` of each term, or all."""
    rows = weighted
    if "weight" not in weighted.columns:
        rows = weighted.groupBy("id", "term").agg(F.max("boost").alias("boost"), F.sum("tf").alias("tf"))
        rows = rows.select("id", "term", F.round(F.col("boost") * F.col("tf") / (F.col("tf") + 1.2), 3).alias("weight"))
    rows = keep(rows)  # texts are cut into terms once, for weights and for frequencies
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    if postings is not None:
        order = Window.partitionBy("term").orderBy(F.desc("weight"), "id")
        rows = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= postings).drop("_r")
    return rows.join(df, "term").select(shard.alias("shard"), "term", "df", "id", "weight")


def rank_index(index: DataFrame, n_docs: int, query: list[str], all_at: int = 10) -> DataFrame:
    """(id, score, have): known terms only; if `all_at` rows or more have all of them, those alone."""
    hits = index.where(F.col("term").isin(query))
    known = hits.agg(F.countDistinct("term").alias("known"))
    scored = hits.groupBy("id").agg(F.sum(F.col("weight") * F.log(1 + F.lit(float(n_docs)) / F.col("df"))).alias("score"), F.count("*").alias("have"))
    scored = scored.join(F.broadcast(known))
    full = F.broadcast(scored.agg(F.count_if(F.col("have") == F.col("known")).alias("full")))
    return scored.join(full).where((F.col("known") <= 1) | (F.col("full") < all_at) | (F.col("have") == F.col("known"))).select("id", "score", "have")


def suggest(neighbours: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """(title, n): titles near seeds (seed, title) that aren't known, by the number of seeds; twice as many as are wanted, since some
    will be of no use."""
    fresh = neighbours.join(known.select("title"), "title", "left_anti")
    return fresh.groupBy("title").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "title").limit(2 * most)


def type_radar(neighbours: DataFrame, known: DataFrame, types: DataFrame, covered: list[str], most: int = 30, least: int = 3, shown: int = 40, examples: int = 6) -> DataFrame:
    """(type, n, examples): kinds of things that are often met around what is known but that no data set covers.

    neighbours (dataset, seed, title) are what lies near the seeds of each data set; known (dataset, title) is rejected, the rest is counted by
    seeds, and of each data set the 2 * most titles of most support are candidates, whose types (title, type) are tallied over all
    data sets. Counts come before the ranks, so a title or type near a third of all seeds is one sum; the first examples are cut by a top-k.
    """
    fresh = neighbours.groupBy("dataset", "title").agg(F.count("*").alias("n")).join(known.select("dataset", "title").distinct(), ["dataset", "title"], "left_anti")
    best = Window.partitionBy("dataset").orderBy(F.desc("n"), "title")
    candidates = fresh.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= 2 * most).drop("_r")
    met = candidates.join(types.select("title", F.lower("type").alias("type")), "title").where(~F.col("type").isin(covered))
    tally = met.groupBy("type").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    first = Window.partitionBy("type").orderBy("title")
    some = met.select("type", "title").distinct().withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= examples).groupBy("type").agg(F.sort_array(F.collect_list("title")).alias("examples"))
    return tally.join(some, "type").orderBy(F.desc("n"), "type").limit(shown)
