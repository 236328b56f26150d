"""Keyword extraction, ensembles, tags, consensus, and rule classifiers over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.functions.constants import DENY_PHRASES, ERROR_PATTERNS, GENRE_RULES, GENRE_RULES_LIGHT, GENRE_WEIGHTS, PRODUCTS, STOPWORDS_EN, STOPWORDS_KO
from lexloom.operators import classify as C
from lexloom.operators import evaluation as E
from lexloom.operators import keywords as K
from lexloom.operators import postings as P
from lexloom.operators import retrieval as R
from lexloom.operators import tagging as T
from lexloom.plans import retrieval_queries as Q
from lexloom.plans.retrieval_queries import _POST, _keywords, _metric_sql
from lexloom.plans.text_queries import SIMPLE_SQL, TAGGING_SQL
from lexloom.session import spread, table

CATEGORIES = {"procedure": "절차", "report": "보고", "issue": "장애", "resolution": "조치", "application": "신청", "form": "양식", "maintenance": "점검", "guide": "안내", "record": "기록"}


def _docs(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "title", "text", "genre"), "doc_id")


def _n(spark, d):
    return table(spark, d, "documents").agg(F.count("*")).scalar()


def _avgdl(spark, d):
    return P.corpus_stats(spread(table(spark, d, "documents").select("text")), X.tagging_tokens(F.col("text"))).select("avgdl").scalar()


def _rake(spark, d, k=30):
    return K.rake(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), k=k, max_chars=None)


def _tfidf_phrases(spark, d, k=30):
    return _keywords(spark, d, k).select("doc_id", F.col("term").alias("phrase"), "rank")


def rake_keywords(spark, d):
    """The 30 best RAKE phrases of every document."""
    return _rake(spark, d)


def yake_keywords(spark, d):
    """The 30 best YAKE phrases of every document."""
    return K.yake(spread(table(spark, d, "documents").select("doc_id", "text")))


def ensemble_union2(spark, d):
    """RAKE and TF-IDF keywords one after the other, at most 20."""
    parts = [K.as_lists(_rake(spark, d, 10)), K.as_lists(_tfidf_phrases(spark, d, 10))]
    return K.ordered_union(parts, 20).select("doc_id", F.array_join("kw", "|").alias("kw"))


def ensemble_union3(spark, d):
    """RAKE, TF-IDF and frequency keywords one after the other, uncapped."""
    parts = [K.as_lists(_rake(spark, d, 10)), K.as_lists(_tfidf_phrases(spark, d, 10)), K.as_lists(T.frequency_tags(_docs(spark, d), 10))]
    return K.ordered_union(parts, None).select("doc_id", F.array_join("kw", "|").alias("kw"))


def _votes(spark, d, k=10):
    return K.weighted_vote([(_rake(spark, d, 2 * k), 0.7), (_tfidf_phrases(spark, d, 2 * k), 0.3)], k)


def weighted_vote(spark, d):
    """The ten keywords with most rank votes, RAKE 70 to TF-IDF 30."""
    return _votes(spark, d)


def mmr_diversity(spark, d):
    """Ten keywords chosen for relevance and diversity out of sixty voted ones."""
    return K.diverse(_votes(spark, d, 60), 10).select("doc_id", F.array_join("kw", "|").alias("kw"))


def _model_lists(spark, d, k=30):
    """(model, doc_id, kw array): keywords of each document by TF-IDF, RAKE, and both one after the other."""
    rake, tfidf = _rake(spark, d, k), _tfidf_phrases(spark, d, k)
    half = lambda p: K.as_lists(p.where(F.col("rank") <= k // 2))
    lists = {"tfidf": K.as_lists(tfidf), "rake": K.as_lists(rake), "ensemble": K.ordered_union([half(rake), half(tfidf)], k)}
    return _tagged(lists)


def _yake_lists(spark, d, k=30):
    """The same by YAKE, and by YAKE and RAKE voting by rank."""
    yake = K.yake(spread(table(spark, d, "documents").select("doc_id", "text")), k=k)
    votes = K.weighted_vote([(_rake(spark, d, k), 0.5), (yake, 0.5)], k)
    return _tagged({"yake": K.as_lists(yake), "rake_yake": K.as_lists(votes)})


def _tagged(lists):
    parts = [df.select(F.lit(name).alias("model"), "doc_id", "kw") for name, df in lists.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def _fused_metrics(spark, d, lists, names):
    """Metrics of BM25 mixed with a tenth of the overlap with each model's keywords, and of BM25 alone; one row a model."""
    terms = Q._terms(spark, d).select("qid", "term")
    words = lists.select("model", "doc_id", F.array_distinct(X.simple_tokens(F.array_join("kw", " "))).alias("w"))
    kw = R.overlap(words.select("model", "doc_id", F.size("w").alias("n_k"), F.explode("w").alias("term")), terms, ("model",)).withColumnRenamed("score", "kw")
    bm = Q._bm25(spark, d).select("qid", "doc_id", F.col("score").alias("bm"), F.explode(F.array(*[F.lit(n) for n in ("bm25", *names)])).alias("model"))
    cand = bm.join(kw, ["model", "qid", "doc_id"], "left").withColumn("kw", F.coalesce("kw", F.lit(0.0)))
    score = F.when(F.col("model") == "bm25", F.col("bm")).otherwise(R.max_score(F.lit(0.1), ("model",)))
    runs = R.top_k(cand.select("model", "qid", "doc_id", score.alias("score")), Q.TOP, by=("model",))
    return E.metrics(runs, Q._qrels(spark, d), (1, 10), ("model",))


def model_metrics(spark, d):
    """NDCG, recall and reciprocal rank of BM25 alone and with the keywords of each model; one row a model."""
    return _fused_metrics(spark, d, _model_lists(spark, d), ("tfidf", "rake", "ensemble"))


def model_metrics_yake(spark, d):
    """The same with YAKE, and with RAKE and YAKE voting."""
    return _fused_metrics(spark, d, _yake_lists(spark, d), ("yake", "rake_yake"))


def model_keyword_quality(spark, d):
    """Overlap with the queries, coverage, diversity and number of each model's keywords."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", X.simple_tokens(F.col("text")).alias("tokens"))
    questions = Q._questions(spark, d).select("qid", X.simple_tokens(F.col("text")).alias("tokens"))
    return E.keyword_quality(_model_lists(spark, d), docs, questions, Q._qrels(spark, d), ("model",))


def frequency_tags(spark, d):
    """The twelve most frequent tokens of every document."""
    return T.frequency_tags(_docs(spark, d))


def tfidf_tags(spark, d):
    """The twelve best tags of every document by TF-IDF, with the genre's and the title's words raised."""
    docs = _docs(spark, d)
    return T.tfidf_tags(T.tagging_terms(docs), T.term_df(docs), _n(spark, d))


def bm25_tags(spark, d):
    """The same by BM25."""
    docs = _docs(spark, d)
    return T.bm25_tags(T.tagging_terms(docs), T.term_df(docs), _n(spark, d), _avgdl(spark, d)).drop("first_pos", "dl")


def candidate_bm25(spark, d):
    """Candidates of RAKE and frequency with the mean BM25 weight of their tokens, over the document's best."""
    docs = _docs(spark, d)
    idf = F.log((_n(spark, d) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    raw = idf * F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("dl") / _avgdl(spark, d)))
    terms = T.tagging_terms(docs).join(T.term_df(docs), "term").select("doc_id", "term", raw.alias("raw"))
    return T.candidate_scores(_merged(spark, d), terms)


def fallback_keywords(spark, d):
    """The first hundred distinct tokens of the documents without a RAKE phrase of three words."""
    docs = _docs(spark, d)
    phrases = _rake(spark, d).where(F.size(F.split("phrase", " ")) == 3)
    return K.fallback_keywords(docs, phrases, X.simple_tokens(F.col("text"))).select("doc_id", F.array_join("kw", "|").alias("kw"))


def padded_run(spark, d):
    """The hundred best documents by keyword overlap, filled up with documents that score 0 where there are fewer."""
    run = R.top_k(Q._overlap(spark, d), Q.TOP)
    return R.pad(run, Q._questions(spark, d), table(spark, d, "documents"), Q.TOP)


def topic_boost_tags(spark, d):
    """BM25 tags ordered by their nearness to the title."""
    docs = _docs(spark, d)
    tags = T.bm25_tags(T.tagging_terms(docs), T.term_df(docs), _n(spark, d), _avgdl(spark, d), k=24, topic=False)
    topics = docs.select("doc_id", F.array_distinct(F.array_except(X.tagging_tokens(F.col("title")), T.stopwords(X.guess_language(F.col("text"))))).alias("topic"))
    return T.topic_boost(tags, topics)


def _merged(spark, d):
    return T.merge_candidates({"rake": _rake(spark, d, 15), "freq": T.frequency_tags(_docs(spark, d), 15)})


def candidate_merge(spark, d):
    """RAKE phrases and frequent tokens under their normalised tags."""
    return _merged(spark, d).drop("domain")


def _consensus(spark, d):
    docs = _docs(spark, d)
    merged = _merged(spark, d)
    terms = T.tagging_terms(docs).join(T.term_df(docs), "term")
    scores = terms.select("doc_id", "term", (F.col("tf") * (F.log((_n(spark, d) + 1) / (F.col("df") + 1)) + 1)).alias("raw"))
    return T.consensus(merged, T.candidate_scores(merged, scores), "rake", "freq")


def consensus_tags(spark, d):
    """Tags on which RAKE, frequency and TF-IDF agree."""
    return _consensus(spark, d)


def consensus_tags_yake(spark, d):
    """Tags on which RAKE, YAKE and TF-IDF agree."""
    docs = _docs(spark, d)
    merged = T.merge_candidates({"rake": _rake(spark, d, 15), "yake": K.yake(docs, k=15)})
    terms = T.tagging_terms(docs).join(T.term_df(docs), "term")
    scores = terms.select("doc_id", "term", (F.col("tf") * (F.log((_n(spark, d) + 1) / (F.col("df") + 1)) + 1)).alias("raw"))
    return T.consensus(merged, T.candidate_scores(merged, scores), "rake", "yake")


def tag_quality(spark, d):
    """Quality of the consensus tags."""
    return T.tag_quality(_consensus(spark, d), _docs(spark, d))


def semantic_jaccard(spark, d):
    """Confidence of the consensus tags adjusted by their words' Jaccard overlap with the title."""
    tags = _consensus(spark, d).join(table(spark, d, "documents").select("doc_id", "title"), "doc_id")
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    sem = X.jaccard(words(F.col("tag")), words(F.coalesce("title", F.lit(""))))
    return tags.select("doc_id", "tag", F.round(F.col("confidence") * 0.7 + sem * 0.3, 9).alias("adjusted"))


def chunked_tag_merge(spark, d):
    """Frequent tokens of texts cut into slices of 5,000 characters, merged by document."""
    parts = T.sliced(table(spark, d, "documents").where(F.col("text").isNotNull()), 5000, 10_000)
    keyed = parts.select(F.struct("doc_id", "slice").alias("doc_id"), "text")
    tags = T.frequency_tags(keyed).select(F.col("doc_id.doc_id").alias("doc_id"), F.col("phrase").alias("tag"), F.col("score").alias("confidence"))
    return T.merge_slices(tags)


def genre_classify(spark, d):
    """Genre of every document by the tagger's rules."""
    return C.classify_genre(_docs(spark, d), GENRE_RULES, 120, ["doc_id"])


def genre_light(spark, d):
    """Genre of every document by the light rules."""
    return C.classify_genre(_docs(spark, d), GENRE_RULES_LIGHT, 80, ["doc_id"])


def entities_light(spark, d):
    """Customers, products, versions and error codes named in every document."""
    return C.extract_entities(_docs(spark, d), ["doc_id"])


def domain_pattern(spark, d):
    """Entity names that are error codes or module names."""
    return table(spark, d, "entities").where(F.col("name").isNotNull()).groupBy("name").agg(F.count("*").alias("n")).where(T.domain_pattern(F.col("name")))


def meaningful_answer(spark, d):
    """Entries of the question log by the portal's verdict and the answer predicate."""
    log = P.latest(table(spark, d, "qna_log").select("entry_id", "logged_at", "portal_answer_snippet", "has_answer"), "entry_id", "logged_at")
    return log.groupBy("has_answer", C.is_meaningful(F.col("portal_answer_snippet")).alias("meaningful")).agg(F.count("*").alias("n"))


def followup_parse(spark, d):
    """Distinct lines of every answer without bullets and numbers."""
    log = P.latest(table(spark, d, "qna_log").select("entry_id", "logged_at", "portal_answer_snippet"), "entry_id", "logged_at")
    qs = C.follow_ups(F.col("portal_answer_snippet"))
    return log.where(F.size(qs) > 0).select("entry_id", F.array_join(qs, "|").alias("lines"), F.size(qs).alias("n"))


def effective_category(spark, d):
    """Documents by effective category; the declared type stands for a manual one where it is md, the language for an automatic one where it is missing."""
    manual = F.when(F.col("doc_type") == "md", F.lit("기술문서"))
    auto = F.when(F.col("lang").isNull(), F.lit("미분류"))
    return table(spark, d, "documents").groupBy(C.effective_category(manual, auto, F.col("genre"), CATEGORIES).alias("category")).agg(F.count("*").alias("n"))


def kmeans_category(spark, d):
    """Clusters of the embeddings named by the majority of their labels."""
    return C.kmeans_categories(table(spark, d, "embeddings"))


QUERIES = {f.__name__: f for f in (rake_keywords, yake_keywords, ensemble_union2, ensemble_union3, weighted_vote, mmr_diversity, model_metrics, model_metrics_yake, model_keyword_quality, frequency_tags, tfidf_tags, bm25_tags, topic_boost_tags, candidate_bm25, fallback_keywords, padded_run, candidate_merge, consensus_tags, consensus_tags_yake, tag_quality, semantic_jaccard, chunked_tag_merge, genre_classify, genre_light, entities_light, domain_pattern, meaningful_answer, followup_parse, effective_category, kmeans_category)}


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_LANG = "CASE WHEN regexp_matches(text, '[가-힣]') THEN 'ko' ELSE 'en' END"
_RAKE = _POST.rstrip() + rf"""
, rp AS (SELECT doc_id, list_filter(list_transform(string_split(array_to_string(list_transform(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}_ ]+', ' | ', 'g'), ' +'),
         lambda w: CASE WHEN list_contains({_list(K.STOPWORDS)}, w) THEN '|' ELSE w END), ' '), '|'), lambda p: trim(p)), lambda p: length(p) >= 2 AND len(string_split(p, ' ')) <= 3) AS p FROM documents),
rph AS (SELECT doc_id, phrase, count(*) AS n FROM (SELECT doc_id, unnest(p) AS phrase FROM rp) GROUP BY 1, 2),
rws AS (SELECT doc_id, word, sum(n * m) / sum(n) AS ws FROM (SELECT doc_id, n, len(string_split(phrase, ' ')) AS m, unnest(string_split(phrase, ' ')) AS word FROM rph) GROUP BY 1, 2),
rsum AS (SELECT doc_id, phrase, round(sum(ws), 6) AS raw FROM (SELECT doc_id, phrase, unnest(string_split(phrase, ' ')) AS word FROM rph) JOIN rws USING (doc_id, word) GROUP BY 1, 2),
rake AS (SELECT doc_id, phrase, round(raw / max(raw) OVER (PARTITION BY doc_id), 6) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY raw DESC, phrase) AS rank FROM rsum),
fp AS (SELECT doc_id, unnest(t) AS phrase, unnest(range(len(t))) AS p FROM (SELECT doc_id, list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+|[가-힣]{{2,}}'), lambda t: length(t) >= 2 AND NOT regexp_full_match(t, '[0-9]+')), lambda t: lower(t)) AS t FROM documents)),
fc AS (SELECT doc_id, phrase, count(*) AS n, min(p) AS first_pos FROM fp GROUP BY 1, 2),
freq AS (SELECT doc_id, phrase, round(n / max(n) OVER (PARTITION BY doc_id), 6) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS rank FROM fc)
"""
_TERMS = rf"""
, tt AS (SELECT doc_id, genre, text, {TAGGING_SQL.format('text')} AS t, {TAGGING_SQL.format('title')} AS topic, CASE WHEN {_LANG} = 'ko' THEN {_list(STOPWORDS_KO)} ELSE {_list(STOPWORDS_EN)} END AS stop FROM documents),
tp AS (SELECT doc_id, genre, len(t) AS dl, topic, stop, unnest(t) AS term, unnest(range(len(t))) AS p FROM tt),
tdf AS (SELECT term, count(DISTINCT doc_id) AS df FROM tp GROUP BY 1),
tc AS (SELECT doc_id, any_value(genre) AS genre, any_value(dl) AS dl, term, count(*) AS tf, min(p) AS first_pos, any_value(list_contains(topic, term)) AS in_topic FROM tp WHERE NOT list_contains(stop, term) GROUP BY doc_id, term),
tstats AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM tt),
tw AS (SELECT tc.*, df, n_docs, avgdl, coalesce(MAP {{{", ".join(f"'{g}|{t}': {w}" for g, ws in GENRE_WEIGHTS.items() for t, w in ws.items())}}}[genre || '|' || term], 1.0)::DOUBLE AS weight FROM tc JOIN tdf USING (term), tstats)
"""
_TF = "tf * (ln((n_docs + 1.0) / (df + 1)) + 1)"
_BM = "ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * weight"
_TOPIC = " * CASE WHEN in_topic THEN 1.3::DOUBLE ELSE 1.0 END"


def _tags_sql(raw: str, k: int) -> str:
    return f"SELECT *, round(raw / max(raw) OVER (PARTITION BY doc_id), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(raw, 9) DESC, first_pos) AS rank FROM (SELECT *, {raw} AS raw FROM tw)) WHERE rank <= {k}"


_PHRASE = rf"array_to_string({TAGGING_SQL.format('phrase')}, '_')"
_KEY = r"""regexp_replace(regexp_replace(replace(lower(regexp_replace(regexp_replace(regexp_replace(phrase, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '^[.,;:!?()\[\]{}"''\-]+|[.,;:!?()\[\]{}"''\-]+$', '', 'g')), '_', ' '), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"""
_DOMAIN = "(regexp_matches(phrase, '(?i)({0})') OR regexp_matches(phrase, '^[A-Z][A-Z0-9_]*[A-Z0-9]$') OR (contains(phrase, '_') AND len(list_filter(list_filter(string_split(phrase, '_'), lambda p: p <> ''), lambda p: NOT regexp_matches(p, '^[A-Z][A-Z0-9]*'))) = 0))".format("|".join(ERROR_PATTERNS))
_MERGE = rf"""
, ca AS (SELECT doc_id, 'rake' AS source, phrase, score FROM rake WHERE rank <= 15 UNION ALL SELECT doc_id, 'freq', phrase, score FROM freq WHERE rank <= 15),
ck AS (SELECT *, CASE WHEN length({_PHRASE}) >= 2 THEN {_PHRASE} ELSE '' END AS tag, {_KEY} AS norm_key FROM ca),
cm AS (SELECT doc_id, norm_key, min(tag) AS tag, count(DISTINCT phrase) AS n_phrases, max({_DOMAIN}) AS domain, max(score) AS best, max(CASE WHEN source = 'rake' THEN score END) AS rake, max(CASE WHEN source = 'freq' THEN score END) AS freq FROM ck WHERE tag <> '' AND norm_key <> '' GROUP BY 1, 2),
merged AS (SELECT * EXCLUDE (_r) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, tag ORDER BY best DESC, norm_key) AS _r FROM cm) WHERE _r = 1)
"""
_CONSENSUS = _RAKE + _TERMS + _MERGE + rf"""
, cs AS (SELECT doc_id, tag, round(avg(raw), 9) AS m FROM (SELECT doc_id, tag, unnest(string_split(tag, '_')) AS term FROM merged) JOIN (SELECT doc_id, term, {_TF} AS raw FROM tw) USING (doc_id, term) GROUP BY 1, 2),
stat AS (SELECT * FROM (SELECT doc_id, tag, round(m / max(m) OVER (PARTITION BY doc_id), 6) AS stat, row_number() OVER (PARTITION BY doc_id ORDER BY m DESC, tag) AS stat_rank FROM cs) WHERE stat_rank <= 50),
v0 AS (SELECT merged.*, stat, stat_rank, row_number() OVER (PARTITION BY doc_id ORDER BY rake DESC NULLS LAST, tag) AS ra, row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC NULLS LAST, tag) AS rb FROM merged LEFT JOIN stat USING (doc_id, tag)),
v1 AS (SELECT *, (coalesce(stat_rank, 999) <= 15)::INT AS vs, (rake IS NOT NULL AND ra <= 15)::INT + (freq IS NOT NULL AND rb <= 15)::INT + (coalesce(stat_rank, 999) <= 15)::INT AS votes FROM v0),
v2 AS (SELECT *, CASE WHEN rake IS NULL THEN 0 ELSE 0.3::DOUBLE END AS wa, CASE WHEN freq IS NULL THEN 0 ELSE 0.3::DOUBLE END AS wb, CASE WHEN vs = 1 THEN 0.4::DOUBLE ELSE 0 END AS wt, votes >= 2 OR (votes = 1 AND domain AND coalesce(stat_rank, 999) <= 3) AS gate FROM v1),
v3 AS (SELECT *, CASE WHEN wa + wb + wt > 0 THEN (wa * coalesce(rake, 0) + wb * coalesce(freq, 0) + wt * coalesce(stat, 0)) / (wa + wb + wt) END AS mean FROM v2),
v4 AS (SELECT doc_id, tag, votes, NOT gate AS fallback, CASE WHEN gate THEN round(coalesce(mean, 0) * CASE WHEN votes >= 2 THEN 1 + 0.2::DOUBLE * (votes - 2) ELSE 1 END, 6) ELSE round(coalesce(mean, coalesce(stat, 0)) * (1 + 0.2::DOUBLE * greatest(0, votes - 1)) * 0.8::DOUBLE, 6) END AS confidence
       FROM v3 WHERE gate OR (coalesce(stat, 0) >= 0.3 AND votes >= 1)),
cons AS (SELECT doc_id, tag, confidence, votes, fallback, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, tag) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY fallback, confidence DESC, tag) AS _r FROM v4) WHERE _r <= 12)
"""


_MODEL_LISTS = """
, ml AS (SELECT 'tfidf' AS model, doc_id, term AS phrase FROM kws WHERE rank <= 30 UNION ALL SELECT 'rake', doc_id, phrase FROM rake WHERE rank <= 30
         UNION ALL SELECT 'ensemble', doc_id, phrase FROM (SELECT doc_id, lower(trim(phrase)) AS phrase FROM rake WHERE rank <= 15 UNION SELECT doc_id, term FROM kws WHERE rank <= 15))
"""


def _model_metrics_sql() -> str:
    names = ("tfidf", "rake", "ensemble")
    ranked = lambda source: f"(SELECT * FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM {source}) WHERE rank <= {Q.TOP})"
    runs = {"bm25": ranked("(SELECT qid, doc_id, bm AS score FROM cand)")} | {n: ranked(f"(SELECT qid, doc_id, score FROM mf WHERE model = '{n}')") for n in names}
    return _RAKE + _MODEL_LISTS + f"""
        , mt AS (SELECT DISTINCT model, doc_id, unnest({SIMPLE_SQL.format('phrase')}) AS term FROM ml), mn AS (SELECT model, doc_id, count(*) AS n_k FROM mt GROUP BY 1, 2),
        mo AS (SELECT model, qid, doc_id, round(0.7::DOUBLE * n / n_q + 0.3::DOUBLE * n / (n_q + n_k - n), 9) AS kw FROM (SELECT model, qid, doc_id, count(*) AS n FROM mt JOIN qterm USING (term) GROUP BY 1, 2, 3) JOIN n_q USING (qid) JOIN mn USING (model, doc_id)),
        mc AS (SELECT m.model, bm.qid, bm.doc_id, bm.score AS bm, coalesce(mo.kw, 0.0) AS kw FROM bm CROSS JOIN (SELECT unnest({list(names)}) AS model) m LEFT JOIN mo ON mo.model = m.model AND mo.qid = bm.qid AND mo.doc_id = bm.doc_id),
        mf AS (SELECT model, qid, doc_id, round(0.9 * (bm / CASE WHEN max(bm) OVER q = 0 THEN 1 ELSE max(bm) OVER q END) + 0.1 * (kw / CASE WHEN max(kw) OVER q = 0 THEN 1 ELSE max(kw) OVER q END), 6) AS score FROM mc WINDOW q AS (PARTITION BY model, qid))
        """ + " UNION ALL ".join(f"SELECT '{n}' AS model, * FROM ({_metric_sql(r, (1, 10))})" for n, r in runs.items())  # fmt: skip


_WORDS = "list_distinct(list_filter(regexp_split_to_array(phrase, '[^a-z0-9]+'), lambda w: length(w) >= 2))"
_MODEL_QUALITY = r"""
, mw AS (SELECT model, doc_id, phrase, {words} AS w FROM ml),
k AS (SELECT model, doc_id, count(*) AS n, list_distinct(flatten(list(w))) AS kt, sum(len(w)) AS total FROM mw GROUP BY 1, 2),
dt AS (SELECT doc_id, list_distinct(t) AS dt FROM toks),
shape AS (SELECT model, round(avg(CASE WHEN len(dt) > 0 THEN len(list_intersect(dt, kt)) / len(dt) END), 6) AS coverage, round(avg(CASE WHEN total > 0 THEN least(1.0::DOUBLE, len(kt) / total) END), 6) AS diversity, round(avg(n), 6) AS avg_keywords FROM k JOIN dt USING (doc_id) GROUP BY 1),
ql AS (SELECT qid, list(term) AS q FROM qterm GROUP BY 1),
o AS (SELECT m.model, round(avg(coalesce(len(list_intersect(q, kt)) / len(q), 0)), 6) AS qko FROM qrels JOIN ql USING (qid) CROSS JOIN (SELECT DISTINCT model FROM k) m LEFT JOIN k ON k.model = m.model AND k.doc_id = qrels.doc_id GROUP BY 1)
SELECT model, qko, coverage, diversity, avg_keywords FROM shape LEFT JOIN o USING (model)"""


def _re(p: str) -> str:
    return C.bounded(p).replace("'", "''")


def _genre_sql(rules: dict[str, list[str]], lines: int) -> str:
    sums = ", ".join("(" + " + ".join(f"regexp_matches(b, '{_re(p)}')::INT" for p in pats) + f") AS s{i}" for i, pats in enumerate(rules.values()))
    n = len(rules)
    most = "greatest(" + ", ".join(f"s{i}" for i in range(n)) + ")"
    name = "CASE WHEN m = 0 THEN 'unknown' " + " ".join(f"WHEN s{i} = m THEN '{g}'" for i, g in enumerate(rules)) + " END"
    shows = "CASE genre " + " ".join(f"WHEN '{g}' THEN regexp_matches(lower(x), '{'|'.join(f'(?:{_re(p)})' for p in pats)}')" for g, pats in rules.items()) + " ELSE false END"
    return rf"""
        WITH b AS (SELECT doc_id, text, lower(coalesce(title, '') || chr(10) || coalesce(text, '')) AS b FROM documents), s AS (SELECT doc_id, text, {sums} FROM b), m AS (SELECT *, {most} AS m FROM s),
        g AS (SELECT doc_id, {name} AS genre, m AS hits, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1:{lines}] AS lines FROM m),
        l AS (SELECT doc_id, genre, i, x FROM (SELECT doc_id, genre, unnest(lines) AS x, unnest(range(len(lines))) AS i FROM g)),
        e AS (SELECT doc_id, string_agg(left(x, 180), chr(10) ORDER BY i) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM l WHERE {shows}) WHERE r <= 3 GROUP BY 1)
        SELECT doc_id, genre, hits, CASE WHEN genre = 'unknown' THEN 0.2 ELSE round(least(0.95, 0.35 + 0.12 * hits), 3) END::DOUBLE AS confidence, coalesce(evidence, '') AS evidence FROM g LEFT JOIN e USING (doc_id)"""


_EDGE = r"(?:[^\p{L}\p{N}_]|$)"
_BEGIN = r"(?:^|[^\p{L}\p{N}_])"
_LATEST_QNA = "WITH q AS (SELECT entry_id, max((logged_at, portal_answer_snippet, has_answer)) AS b FROM qna_log GROUP BY 1), a AS (SELECT entry_id, b[2] AS a, b[3] AS has_answer FROM q)"
_TRIMMED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"

ORACLE = {
    "rake_keywords": _RAKE + "SELECT doc_id, phrase, score, rank FROM rake WHERE rank <= 30",
    "ensemble_union2": _RAKE + """
        , l AS (SELECT doc_id, 0 AS i, rank, phrase FROM rake WHERE rank <= 10 UNION ALL SELECT doc_id, 1, rank, term FROM kws WHERE rank <= 10),
        o AS (SELECT doc_id, lower(trim(phrase)) AS p, min((i, rank)) AS o FROM l GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS r FROM o)
        SELECT doc_id, string_agg(p, '|' ORDER BY r) AS kw FROM r WHERE r <= 20 GROUP BY 1""",
    "ensemble_union3": _RAKE + """
        , l AS (SELECT doc_id, 0 AS i, rank, phrase FROM rake WHERE rank <= 10 UNION ALL SELECT doc_id, 1, rank, term FROM kws WHERE rank <= 10 UNION ALL SELECT doc_id, 2, rank, phrase FROM freq WHERE rank <= 10),
        o AS (SELECT doc_id, lower(trim(phrase)) AS p, min((i, rank)) AS o FROM l GROUP BY 1, 2)
        SELECT doc_id, string_agg(p, '|' ORDER BY o) AS kw FROM o GROUP BY 1""",
    "weighted_vote": _RAKE + """
        , v AS (SELECT doc_id, lower(trim(phrase)) AS phrase, 0.7::DOUBLE * (1 - (rank - 1) / 21) AS v FROM rake WHERE rank <= 20 UNION ALL SELECT doc_id, term, 0.3::DOUBLE * (1 - (rank - 1) / 21) FROM kws WHERE rank <= 20),
        s AS (SELECT doc_id, phrase, round(sum(v), 6) AS score FROM v GROUP BY 1, 2)
        SELECT * FROM (SELECT doc_id, phrase, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase) AS rank FROM s) WHERE rank <= 10""",
    "model_metrics": _model_metrics_sql(),
    "model_keyword_quality": _RAKE + _MODEL_LISTS + _MODEL_QUALITY.format(words=_WORDS),
    "frequency_tags": _RAKE + "SELECT doc_id, phrase, score, rank FROM freq WHERE rank <= 12",
    "tfidf_tags": _RAKE + _TERMS + "SELECT doc_id, term AS tag, score, tf, df, weight, in_topic AS from_topic, rank FROM (" + _tags_sql(_TF + " * weight" + _TOPIC, 12) + ")",
    "bm25_tags": _RAKE + _TERMS + "SELECT doc_id, term AS tag, score, tf, df, weight, in_topic AS from_topic, rank FROM (" + _tags_sql(_BM + _TOPIC, 12) + ")",
    "topic_boost_tags": _RAKE + _TERMS + f"""
        , b AS ({_tags_sql(_BM, 24)}),
        tpc AS (SELECT doc_id, list_filter(list_distinct(topic), lambda x: NOT list_contains(stop, x)) AS topic FROM tt),
        r0 AS (SELECT b.doc_id, term AS tag, score, first_pos, dl, t.topic,
               len(list_filter(t.topic, lambda x: contains(x, term) OR contains(term, x))) > 0 AS part,
               len(list_filter(t.topic, lambda x: len(list_intersect(list_distinct(string_split(term, '')), list_distinct(string_split(x, '')))) >= 0.6::DOUBLE * least(length(term), length(x)))) > 0 AS shared FROM b JOIN tpc t USING (doc_id)),
        r1 AS (SELECT *, CASE WHEN part THEN 0.5 WHEN shared THEN 0.3 ELSE 0 END::DOUBLE AS base FROM r0),
        r2 AS (SELECT *, CASE WHEN len(topic) = 0 THEN 0 WHEN list_contains(topic, tag) THEN 1 ELSE round(base + CASE WHEN base > 0 AND first_pos < dl * 0.3::DOUBLE THEN 0.1 ELSE 0 END, 1) END::DOUBLE AS relevance FROM r1),
        r3 AS (SELECT *, round(score * (1 + relevance * 2), 6) AS boosted FROM r2),
        r4 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY relevance DESC, boosted DESC, tag) AS rank FROM r3),
        f AS (SELECT doc_id, boosted AS first FROM r4 WHERE rank = 1)
        SELECT doc_id, tag, relevance, round(boosted / first, 9) AS score, rank FROM r4 JOIN f USING (doc_id) WHERE rank <= 12""",
    "candidate_bm25": _RAKE + _TERMS + _MERGE + f"""
        , cs AS (SELECT doc_id, tag, round(avg(raw), 9) AS m FROM (SELECT doc_id, tag, unnest(string_split(tag, '_')) AS term FROM merged) JOIN (SELECT doc_id, term, {_BM.removesuffix(' * weight')} AS raw FROM tw) USING (doc_id, term) GROUP BY 1, 2)
        SELECT * FROM (SELECT doc_id, tag, round(m / max(m) OVER (PARTITION BY doc_id), 6) AS stat, row_number() OVER (PARTITION BY doc_id ORDER BY m DESC, tag) AS stat_rank FROM cs) WHERE stat_rank <= 50""",
    "fallback_keywords": _RAKE + """
        , w3 AS (SELECT DISTINCT doc_id FROM rake WHERE rank <= 30 AND len(string_split(phrase, ' ')) = 3), f AS (SELECT doc_id, list_filter(t, lambda x, i: list_position(t, x) = i)[1:100] AS kw FROM toks WHERE doc_id NOT IN (SELECT doc_id FROM w3))
        SELECT doc_id, array_to_string(kw, '|') AS kw FROM f WHERE len(kw) > 0""",
    "padded_run": _POST + f"""
        , r AS (SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM ov) WHERE rank <= {Q.TOP}),
        f AS (SELECT item_id AS qid, doc_id FROM eval_items, (SELECT DISTINCT doc_id FROM documents ORDER BY doc_id LIMIT {Q.TOP})),
        u AS (SELECT * FROM r UNION ALL SELECT f.qid, f.doc_id, 0, NULL FROM f LEFT JOIN r ON r.qid = f.qid AND r.doc_id = f.doc_id WHERE r.qid IS NULL)
        SELECT * FROM (SELECT qid, doc_id, score::DOUBLE AS score, row_number() OVER (PARTITION BY qid ORDER BY rank NULLS LAST, doc_id) AS rank FROM u) WHERE rank <= {Q.TOP}""",
    "candidate_merge": _RAKE + _MERGE + "SELECT * EXCLUDE (domain) FROM merged",
    "consensus_tags": _CONSENSUS + "SELECT * FROM cons",
    "tag_quality": _CONSENSUS + """
        , l AS (SELECT doc_id, list(tag) AS t, round(avg(confidence), 9) AS confidence_avg, round(avg(votes), 9) AS support_avg FROM cons GROUP BY 1),
        q AS (SELECT doc_id, confidence_avg, support_avg, round(len(list_filter(t, lambda x: contains(lower(coalesce(text, '')), lower(x)))) / len(t), 9) AS coverage, flatten(list_transform(t, lambda x: string_split(x, '_'))) AS w FROM l JOIN documents USING (doc_id)),
        o AS (SELECT doc_id, coverage, round(least(1.0::DOUBLE, len(list_distinct(w)) / len(w)), 9) AS diversity, confidence_avg, support_avg FROM q)
        SELECT *, round(coverage * 0.3::DOUBLE + diversity * 0.2::DOUBLE + 0.1::DOUBLE + least(1.0::DOUBLE, confidence_avg) * 0.2::DOUBLE + least(1.0::DOUBLE, support_avg / 3) * 0.1::DOUBLE, 9) AS overall,
               round(coverage * 0.3::DOUBLE + diversity * 0.2::DOUBLE + 0.1::DOUBLE + least(1.0::DOUBLE, confidence_avg) * 0.2::DOUBLE + least(1.0::DOUBLE, support_avg / 3) * 0.1::DOUBLE, 9) > 0.7 AS good FROM o""",
    "semantic_jaccard": _CONSENSUS + r"""
        , w AS (SELECT doc_id, tag, confidence, list_distinct(list_filter(regexp_split_to_array(lower(tag), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS b FROM cons JOIN documents USING (doc_id)),
        j AS (SELECT *, len(list_intersect(a, b)) AS i, len(list_distinct(list_concat(a, b))) AS u FROM w)
        SELECT doc_id, tag, round(confidence * 0.7::DOUBLE + CASE WHEN u = 0 THEN 0 ELSE i / u END * 0.3::DOUBLE, 9) AS adjusted FROM j""",
    "chunked_tag_merge": r"""
        WITH s AS (SELECT doc_id, i, CASE WHEN length(text) > 10000 THEN substring(text, (i * 5000 + 1)::BIGINT, 5000) ELSE text END AS text FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) > 10000 THEN ceil(length(text) / 5000)::BIGINT ELSE 1 END)) AS i FROM documents WHERE text IS NOT NULL)),
        p AS (SELECT doc_id, i, unnest(t) AS tag, unnest(range(len(t))) AS p FROM (SELECT doc_id, i, list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+|[가-힣]{2,}'), lambda t: length(t) >= 2 AND NOT regexp_full_match(t, '[0-9]+')), lambda t: lower(t)) AS t FROM s)),
        c AS (SELECT doc_id, i, tag, count(*) AS n, min(p) AS f FROM p GROUP BY 1, 2, 3),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY n DESC, f) AS rank, round(n / max(n) OVER (PARTITION BY doc_id, i), 6) AS score FROM c),
        b AS (SELECT doc_id, tag, max(score) AS confidence FROM r WHERE rank <= 12 GROUP BY 1, 2)
        SELECT * FROM (SELECT doc_id, tag, confidence, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, tag) AS rank FROM b) WHERE rank <= 12""",
    "genre_classify": _genre_sql(GENRE_RULES, 120),
    "genre_light": _genre_sql(GENRE_RULES_LIGHT, 80),
    "entities_light": rf"""
        WITH b AS (SELECT doc_id, coalesce(title, '') || chr(10) || coalesce(text, '') AS b FROM documents), w AS (SELECT doc_id, b, regexp_replace(b, '([^\p{{L}}\p{{N}}_.\-])', '\1\1', 'g') AS b2 FROM b)
        SELECT DISTINCT doc_id, 'customer' AS entity_type, unnest(regexp_extract_all(b, '([A-Za-z가-힣0-9]{{1,8}}\s*사){_EDGE}', 1)) AS name FROM w
        UNION SELECT doc_id, 'product', unnest(list_filter({_list(PRODUCTS)}, lambda p: contains(lower(b), lower(p)))) FROM w
        UNION SELECT doc_id, 'version', unnest(regexp_extract_all(b2, '{_BEGIN}([0-9]+\.[0-9]+(?:\.[0-9]+)?){_EDGE}', 1)) FROM w
        UNION SELECT doc_id, 'issue', unnest(regexp_extract_all(b2, '{_BEGIN}([A-Za-z_]+Exception){_EDGE}', 1)) FROM w
        UNION SELECT doc_id, 'issue', unnest(regexp_extract_all(b2, '{_BEGIN}([A-Z]{{2,5}}-[0-9]{{3,5}}){_EDGE}', 1)) FROM w""",
    "domain_pattern": f"SELECT name, count(*) AS n FROM (SELECT name, name AS phrase FROM entities WHERE name IS NOT NULL) WHERE {_DOMAIN} GROUP BY 1",
    "meaningful_answer": _LATEST_QNA + f", m AS (SELECT has_answer, coalesce(length({_TRIMMED.format('a')}) >= 20 AND NOT ({' OR '.join(f"contains({_TRIMMED.format('a')}, '{p}')" for p in DENY_PHRASES)}), false) AS meaningful FROM a) SELECT has_answer, meaningful, count(*) AS n FROM m GROUP BY 1, 2",
    "followup_parse": _LATEST_QNA + r"""
        , l AS (SELECT entry_id, list_filter(list_transform(regexp_split_to_array(a, '\r\n|\r|\n'), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^[\-0-9.)(]+\s*', ''), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM a),
        u AS (SELECT entry_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM l)
        SELECT entry_id, array_to_string(l, '|') AS lines, len(l) AS n FROM u WHERE len(l) > 0""",
    "effective_category": f"SELECT coalesce(CASE WHEN doc_type = 'md' THEN '기술문서' END, CASE WHEN lang IS NULL THEN '미분류' END, MAP {{{', '.join(f"'{k}': '{v}'" for k, v in CATEGORIES.items())}}}[genre], '기타') AS category, count(*) AS n FROM documents GROUP BY 1",
}
