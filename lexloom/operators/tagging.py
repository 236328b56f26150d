"""Tags from term scores, consensus of extractors, and tag quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.functions.constants import ERROR_PATTERNS, GENRE_WEIGHTS, STOPWORDS_EN, STOPWORDS_KO

DOC = "doc_id"


def stopwords(lang: Column) -> Column:
    """Stop words of a guessed language: Korean ones for ko, English ones otherwise."""
    return F.when(lang == "ko", F.array(*map(F.lit, STOPWORDS_KO))).otherwise(F.array(*map(F.lit, STOPWORDS_EN)))


def is_stopword(lang: Column, term: Column) -> Column:
    """Whether a term is a stop word of a guessed language; looked up by hash."""
    return F.when(lang == "ko", term.isin(*STOPWORDS_KO)).otherwise(term.isin(*STOPWORDS_EN))


def genre_weight(genre: Column, term: Column) -> Column:
    """Weight of a term in a genre, 1.0 where none is set."""
    table = F.create_map(*[F.lit(x) for g, ws in GENRE_WEIGHTS.items() for t, w in ws.items() for x in (f"{g}|{t}", w)])
    return F.coalesce(F.element_at(table, F.concat_ws("|", genre, term)), F.lit(1.0))


def tagging_terms(docs: DataFrame) -> DataFrame:
    """(doc_id, genre, term, tf, first_pos, dl, in_topic): counted tagging tokens without stop words.

    ``docs``: (doc_id, text, title, genre); the title is the topic sentence.
    ``dl`` counts tokens before stop words go.  Ids must be distinct.
    """
    base = docs.select(DOC, "genre", X.tagging_tokens(F.col("text")).alias("t"), X.tagging_tokens(F.col("title")).alias("topic"), X.guess_language(F.col("text")).alias("lang")).withColumn("dl", F.size("t"))
    placed = base.select(DOC, "genre", "dl", "topic", "lang", F.posexplode("t").alias("p", "term")).where(~is_stopword(F.col("lang"), F.col("term")))
    counted = placed.groupBy(DOC, "genre", "dl", "term").agg(F.count("*").alias("tf"), F.min("p").alias("first_pos"), F.first(F.array_contains("topic", F.col("term"))).alias("in_topic"))
    return counted


def term_df(docs: DataFrame) -> DataFrame:
    """(term, df) of tagging tokens over all documents, stop words included."""
    return docs.select(F.explode(F.array_distinct(X.tagging_tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    by = W.partitionBy(DOC)
    ranked = scored.withColumn("rank", F.row_number().over(by.orderBy(F.desc(F.round("raw", 9)), "first_pos")))
    return ranked.where(F.col("rank") <= k).withColumn("score", F.round(F.col("raw") / F.max("raw").over(by), 6))


def tfidf_tags(terms: DataFrame, df: DataFrame, n_docs: Column, k: int = 12) -> DataFrame:
    """(doc_id, tag, score, tf, df, weight, from_topic, rank): tf * (ln((N + 1) / (df + 1)) + 1), times the genre's weight and 1.3 for topic words, over the document's best."""
    weight = genre_weight(F.col("genre"), F.col("term"))
    raw = F.col("tf") * (F.log((n_docs + 1) / (F.col("df") + 1)) + 1) * weight * F.when(F.col("in_topic"), 1.3).otherwise(1.0)
    scored = terms.join(df, "term").withColumn("raw", raw).withColumn("weight", weight)
    return _best(scored, k).select(DOC, F.col("term").alias("tag"), "score", "tf", "df", "weight", F.col("in_topic").alias("from_topic"), "rank")


def bm25_tags(terms: DataFrame, df: DataFrame, n_docs: Column, avgdl: Column, k: int = 12, topic: bool = True, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The same with BM25 weights: ln((N - df + 0.5) / (df + 0.5) + 1) * tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl))."""
    weight = genre_weight(F.col("genre"), F.col("term"))
    idf = F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    raw = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl)) * weight
    if topic:
        raw = raw * F.when(F.col("in_topic"), 1.3).otherwise(1.0)
    scored = terms.join(df, "term").withColumn("raw", raw).withColumn("weight", weight)
    return _best(scored, k).select(DOC, F.col("term").alias("tag"), "score", "tf", "df", "weight", F.col("in_topic").alias("from_topic"), "rank", "first_pos", "dl")


def topic_relevance(tag: Column, topic: Column, first_pos: Column, dl: Column) -> Column:
    """Nearness of a tag to the topic's tokens: 1 for one of them, 0.5 for a part of one or round one, 0.3 for six tenths of the characters; 0.1 more near the start."""
    chars = lambda c: F.array_distinct(F.split(c, ""))
    shared = lambda t: F.size(F.array_intersect(chars(tag), chars(t))) >= 0.6 * F.least(F.length(tag), F.length(t))
    base = F.when(F.exists(topic, lambda t: t.contains(tag) | tag.contains(t)), 0.5).when(F.exists(topic, shared), 0.3).otherwise(0.0)
    early = F.when((base > 0) & (first_pos < dl * 0.3), 0.1).otherwise(0.0)
    return F.when(F.size(topic) == 0, 0.0).when(F.array_contains(topic, tag), 1.0).otherwise(F.round(base + early, 1))


def topic_boost(tags: DataFrame, topics: DataFrame, k: int = 12, factor: float = 2.0) -> DataFrame:
    """(doc_id, tag, relevance, score, rank): of twice as many BM25 tags, the nearest to the topic first; scores times 1 + relevance * factor, over the first row's.

    ``topics``: (doc_id, topic array) without stop words.
    """
    by = W.partitionBy(DOC)
    near = tags.join(topics, DOC, "left").withColumn("topic", F.coalesce("topic", F.array().cast("array<string>")))
    rel = near.withColumn("relevance", topic_relevance(F.col("tag"), F.col("topic"), F.col("first_pos"), F.col("dl")))
    boosted = rel.withColumn("boosted", F.round(F.col("score") * (1 + F.col("relevance") * factor), 6))
    ranked = boosted.withColumn("rank", F.row_number().over(by.orderBy(F.desc("relevance"), F.desc("boosted"), "tag")))
    first = F.first("boosted").over(by.orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return ranked.withColumn("score", F.round(F.col("boosted") / first, 9)).where(F.col("rank") <= k).select(DOC, "tag", "relevance", "score", "rank")


def frequency_tags(docs: DataFrame, k: int = 12) -> DataFrame:
    """(doc_id, phrase, score, rank): the most frequent tokens over the most frequent one; ties by first occurrence."""
    placed = docs.select(DOC, F.posexplode(X.tagging_tokens(F.col("text"), synonyms=False)).alias("p", "phrase"))
    counted = placed.groupBy(DOC, "phrase").agg(F.count("*").alias("n"), F.min("p").alias("first_pos"))
    by = W.partitionBy(DOC)
    ranked = counted.withColumn("rank", F.row_number().over(by.orderBy(F.desc("n"), "first_pos"))).withColumn("score", F.round(F.col("n") / F.max("n").over(by), 6))
    return ranked.where(F.col("rank") <= k).select(DOC, "phrase", "score", "rank")


def domain_pattern(phrase: Column) -> Column:
    """Whether a phrase is an error code or a product or module name in capitals."""
    codes = "(?i)(" + "|".join(ERROR_PATTERNS) + ")"
    parts = F.filter(F.split(phrase, "_"), lambda p: p != "")
    modules = phrase.contains("_") & F.forall(parts, lambda p: p.rlike("^[A-Z][A-Z0-9]*"))
    return phrase.rlike(codes) | phrase.rlike("^[A-Z][A-Z0-9_]*[A-Z0-9]$") | modules


def merge_candidates(sources: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, tag, norm_key, n_phrases, domain, best, one column per source): candidates of several extractors under their normalised tag.

    Spellings meet under the normalised key with the best score of each
    source; of the keys of a tag the best one stays (ties by key).
    """
    parts = [p.select(DOC, F.lit(name).alias("source"), "phrase", "score") for name, p in sources.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    keyed = every.withColumn("tag", X.normalize_phrase(F.col("phrase"))).withColumn("norm_key", X.normalize_key(F.col("phrase"))).where("tag <> '' AND norm_key <> ''")
    per_key = keyed.groupBy(DOC, "norm_key").agg(
        F.min("tag").alias("tag"), F.count_distinct("phrase").alias("n_phrases"), F.max(domain_pattern(F.col("phrase"))).alias("domain"), F.max("score").alias("best"), *[F.max(F.when(F.col("source") == s, F.col("score"))).alias(s) for s in sources]
    )
    rank = F.row_number().over(W.partitionBy(DOC, "tag").orderBy(F.desc("best"), "norm_key"))
    return per_key.withColumn("_r", rank).where("_r = 1").drop("_r")


def candidate_scores(merged: DataFrame, term_scores: DataFrame, most: int = 50) -> DataFrame:
    """(doc_id, tag, stat, stat_rank): mean score of a tag's tokens that the document has, over the document's best; ``term_scores``: (doc_id, term, raw)."""
    parts = merged.select(DOC, "tag", F.explode(F.split("tag", "_")).alias("term"))
    mean = parts.join(term_scores, [DOC, "term"]).groupBy(DOC, "tag").agg(F.round(F.avg("raw"), 9).alias("m"))
    by = W.partitionBy(DOC)
    ranked = mean.withColumn("stat", F.round(F.col("m") / F.max("m").over(by), 6)).withColumn("stat_rank", F.row_number().over(by.orderBy(F.desc("m"), "tag")))
    return ranked.where(F.col("stat_rank") <= most).select(DOC, "tag", "stat", "stat_rank")


def consensus(merged: DataFrame, stats: DataFrame, a: str, b: str, top: int = 15, k: int = 12, weights: tuple[float, float, float] = (0.3, 0.3, 0.4), alpha: float = 0.2, exception_rank: int = 3) -> DataFrame:
    """(doc_id, tag, confidence, votes, fallback, rank): tags on which extractors ``a``, ``b`` and the statistic agree.

    A tag passes with two votes, or with one where it is a domain pattern
    among the first statistics; confidence is the weighted mean of its
    available scores times 1 + alpha * (votes - 2).  Where fewer than ``k``
    pass, tags with a statistic of 0.3 and a vote fill up at eight tenths.
    """
    by = W.partitionBy(DOC)
    place = lambda c: F.row_number().over(by.orderBy(F.col(c).desc_nulls_last(), "tag"))
    j = merged.join(stats, [DOC, "tag"], "left").withColumn("_ra", place(a)).withColumn("_rb", place(b))
    va = (F.col(a).isNotNull() & (F.col("_ra") <= top)).cast("int")
    vb = (F.col(b).isNotNull() & (F.col("_rb") <= top)).cast("int")
    vs = (F.coalesce("stat_rank", F.lit(999)) <= top).cast("int")
    j = j.withColumn("vs", vs).withColumn("votes", va + vb + vs)
    wa, wb, wt = (F.when(F.col(a).isNotNull(), weights[0]).otherwise(0.0), F.when(F.col(b).isNotNull(), weights[1]).otherwise(0.0), F.when(F.col("vs") == 1, weights[2]).otherwise(0.0))
    stat = F.coalesce("stat", F.lit(0.0))
    total = wa + wb + wt
    mean = F.when(total > 0, (wa * F.coalesce(a, F.lit(0.0)) + wb * F.coalesce(b, F.lit(0.0)) + wt * stat) / total)
    gate = (F.col("votes") >= 2) | ((F.col("votes") == 1) & F.col("domain") & (F.coalesce("stat_rank", F.lit(999)) <= exception_rank))
    strict = F.round(F.coalesce(mean, F.lit(0.0)) * F.when(F.col("votes") >= 2, 1 + alpha * (F.col("votes") - 2)).otherwise(1.0), 6)
    loose = F.round(F.coalesce(mean, stat) * (1 + alpha * F.greatest(F.lit(0), F.col("votes") - 1)) * 0.8, 6)
    scored = j.withColumn("fallback", ~gate).withColumn("confidence", F.when(gate, strict).otherwise(loose)).where(gate | ((stat >= 0.3) & (F.col("votes") >= 1)))
    rank = F.row_number().over(by.orderBy("fallback", F.desc("confidence"), "tag"))
    kept = scored.withColumn("_r", rank).where(F.col("_r") <= k)
    final = F.row_number().over(by.orderBy(F.desc("confidence"), "tag"))
    return kept.withColumn("rank", final).select(DOC, "tag", "confidence", "votes", "fallback", "rank")


def tag_quality(tags: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, coverage, diversity, confidence_avg, support_avg, overall, good): quality of a document's tags.

    ``tags``: (doc_id, tag, confidence, votes).  Coverage is the share of tags
    that stand in the text, diversity the distinct words over all words of the
    tags; the overall score weighs coverage .3, diversity .2, genre .2 (a
    constant .5 where no genre words apply), confidence .2, support .1.
    """
    lists = tags.groupBy(DOC).agg(F.collect_list("tag").alias("t"), F.round(F.avg("confidence"), 9).alias("confidence_avg"), F.round(F.avg("votes"), 9).alias("support_avg"))
    low = F.lower(F.coalesce("text", F.lit("")))
    words = F.flatten(F.transform("t", lambda x: F.split(x, "_")))
    j = lists.join(docs.select(DOC, "text"), DOC)
    shown = j.withColumn("_l", low).withColumn("coverage", F.round(F.size(F.filter("t", lambda x: F.col("_l").contains(F.lower(x)))) / F.size("t"), 9)).withColumn("diversity", F.round(F.least(F.lit(1.0), F.size(F.array_distinct(words)) / F.size(words)), 9))
    overall = F.col("coverage") * 0.3 + F.col("diversity") * 0.2 + 0.5 * 0.2 + F.least(F.lit(1.0), F.col("confidence_avg")) * 0.2 + F.least(F.lit(1.0), F.col("support_avg") / 3) * 0.1
    return shown.withColumn("overall", F.round(overall, 9)).withColumn("good", F.col("overall") > 0.7).select(DOC, "coverage", "diversity", "confidence_avg", "support_avg", "overall", "good")


def sliced(docs: DataFrame, size: int = 50_000, over: int = 100_000) -> DataFrame:
    """(doc_id, slice, text): texts over ``over`` characters in slices of ``size``, others whole."""
    n = F.length("text")
    count = F.when(n > over, F.ceil(n / size)).otherwise(1).cast("int")
    part = docs.select(DOC, "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("slice"), (n > over).alias("_long"))
    return part.select(DOC, "slice", F.when(F.col("_long"), F.substring("text", F.col("slice") * size + 1, F.lit(size))).otherwise(F.col("text")).alias("text"))


def merge_slices(tags: DataFrame, k: int = 12) -> DataFrame:
    """(doc_id, tag, confidence, rank) of (doc_id, tag, confidence) tagged by slice: the best confidence of each tag whatever its case."""
    best = tags.groupBy(DOC, F.lower("tag").alias("tag")).agg(F.max("confidence").alias("confidence"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy(DOC).orderBy(F.desc("confidence"), "tag"))).where(F.col("rank") <= k)
