"""Search, feedback, stores, chunks and dashboards over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators import analytics as A
from lexloom.operators import chunking as H
from lexloom.operators import images as M
from lexloom.operators import postings as P
from lexloom.operators import search as S
from lexloom.operators import store as ST
from lexloom.plans import retrieval_queries as R
from lexloom.plans import tagging_queries as Q
from lexloom.session import spread, table

SPACE = r"[\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}]+"
AS_OF = "2024-01-31 00:00:00"
QUERY = "server 로그파일"
ISSUE_QUERY = "server error"


def _tags(spark, d):
    return Q.tfidf_tags(spark, d)


def _index(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "title", "genre", F.col("title").alias("topic"), "text")
    return S.document_index(docs, _tags(spark, d))


def _feedback(spark, d):
    kind = F.when(F.col("event_type").isin("click", "purchase"), "like").when(F.col("event_type") == "error", "dislike")
    return table(spark, d, "events").select(F.col("user_id").alias("doc_id"), "ts", kind.alias("feedback"))


def tag_index(spark, d):
    """Inverted index of the TF-IDF tags."""
    return S.tag_index(_tags(spark, d))


def document_index(spark, d):
    """Documents with their tags."""
    return _index(spark, d).select("doc_id", "title", "genre", F.array_join("tags", "|").alias("tags"))


def stage1_filter(spark, d):
    """The hundred documents whose tags match the query best."""
    return S.stage1(S.tag_index(_tags(spark, d)), QUERY)


def two_stage_search(spark, d):
    """Detailed scores of the documents that the tags select, with the feedback boost."""
    first = S.stage1(S.tag_index(_tags(spark, d)), QUERY)
    docs = _index(spark, d).join(first.select("doc_id"), "doc_id", "left_semi")
    return S.stage2(docs, QUERY, S.feedback_boosts(_feedback(spark, d), AS_OF))


def legacy_search(spark, d):
    """Detailed scores over all documents, without the tag filter."""
    return S.stage2(_index(spark, d), ISSUE_QUERY, None, 50)


def topic_search(spark, d):
    """Documents whose title holds the words of the query."""
    return S.topic_search(_index(spark, d), "the server was", 50)


def feedback_boost(spark, d):
    """Feedback boost of every subject that was voted on."""
    return S.feedback_boosts(_feedback(spark, d), AS_OF).withColumn("last_ts", F.unix_timestamp("last_ts"))


def entity_latest(spark, d):
    """The entity store as of its last rows."""
    return ST.entity_latest(table(spark, d, "entities")).select("entity_id", "name", "entity_type", F.size(F.coalesce("aliases", F.array().cast("array<string>"))).alias("n_aliases"), F.unix_timestamp("created_at").alias("created_s"), F.unix_timestamp("updated_at").alias("updated_s"), "first_seen", "last_seen", "n_rows")


def entity_timeline(spark, d):
    """The last 200 events of every subject, and whether its last error was followed by a purchase."""
    t = ST.timelines(table(spark, d, "events"), "user_id", "event_id", "ts", "event_type", 200, "error", "purchase")
    return t.select("user_id", "n_events", "status", F.size("timeline").alias("n_kept"), F.array_join(F.transform(F.slice("timeline", -3, 3), lambda e: e["id"].cast("string")), ",").alias("last_ids"))


def linked_artifacts(spark, d):
    """Artifacts by the entities seen in them."""
    return ST.linked_artifacts(table(spark, d, "entities"), table(spark, d, "chunks"))


def incremental_new_docs(spark, d):
    """Records of the last batch that no earlier batch had."""
    corpus = table(spark, d, "corpus").select("doc_id", "batch_id")
    last = corpus.agg(F.max("batch_id")).scalar()
    return ST.new_rows(corpus.where(F.col("batch_id") == last).select("doc_id").distinct(), corpus.where(F.col("batch_id") < last), "doc_id")


def deleted_states(spark, d):
    """Saved states whose batch has no record with text."""
    return ST.gone_rows(table(spark, d, "tagging_state").select("state_id", "batch_id").distinct(), table(spark, d, "corpus").where("length(text) > 0"), "batch_id")


def gap_queue(spark, d):
    """Entries of the question log by status: done where a document was made, failed where none was although the answer says nothing."""
    log = P.latest(table(spark, d, "qna_log").select("entry_id", "logged_at", "has_answer", "doc_created"), "entry_id", "logged_at")
    results = log.where(F.col("has_answer").isNotNull()).select("entry_id", F.col("logged_at").alias("at"), F.coalesce("doc_created", F.lit(False)).alias("ok"))
    return ST.with_status(log.select("entry_id"), results, "entry_id").groupBy("status").agg(F.count("*").alias("n"))


def pending_questions(spark, d):
    """The 50 oldest entries without a document."""
    log = P.latest(table(spark, d, "qna_log").select("entry_id", "logged_at", "question", "doc_created"), "entry_id", "logged_at")
    return ST.pending(log.select("entry_id", "question"), log.where("doc_created"), "entry_id", 50)


def chunk_policy(spark, d):
    """Documents by chunk size policy."""
    p = H.size_policy(F.length("text"))
    return table(spark, d, "documents").where(F.col("text").isNotNull()).groupBy(p.target.alias("target"), p.least.alias("least"), p.overlap.alias("overlap")).agg(F.count("*").alias("n"))


def chunks_made(spark, d):
    """Chunks of every document."""
    docs = spread(table(spark, d, "documents").select("doc_id", "title", "text", "genre")).select("doc_id", X.normalize_text(F.col("text")).alias("text"), "genre", F.array_distinct(X.tagging_tokens(F.col("title"))).alias("topic"))
    return H.chunk_documents(docs)


def _distinct_chunks(spark, d):
    return P.latest(table(spark, d, "chunks").select("chunk_id", "ingested_at", "doc_id", "chunk_index", "text", "genre", "title"), "chunk_id", "ingested_at")


def _quoted(spark, d):
    head = F.lower(F.substring(F.col("title"), 1, 12))
    return _distinct_chunks(spark, d).withColumn("quoted", F.coalesce(F.lower("text").contains(head), F.lit(False)))


def chunk_report(spark, d):
    """Chunk figures of every document."""
    return H.chunk_report(_quoted(spark, d))


def chunk_histogram(spark, d):
    """Chunks by length."""
    return A.histogram(_distinct_chunks(spark, d).select(F.length("text").alias("n_chars")), "n_chars", 100)


def rag_export(spark, d):
    """Chunks with their metadata in front."""
    return A.rag_rows(_distinct_chunks(spark, d))


def report_markdown(spark, d):
    """Every entry of the question log as a short report."""
    log = P.latest(table(spark, d, "qna_log").select("entry_id", "logged_at", "question", "portal_answer_snippet", "analysis_summary"), "entry_id", "logged_at")
    return log.select("entry_id", A.markdown({"Question": F.col("question"), "Answer": F.col("portal_answer_snippet"), "Analysis": F.col("analysis_summary")}).alias("report"))


def front_matter(spark, d):
    """Every document as Markdown with front matter."""
    return table(spark, d, "documents").select("doc_id", A.front_matter({"title": F.col("title"), "genre": F.col("genre"), "chars": F.col("n_chars")}, F.col("text")).alias("markdown"))


def genre_dashboard(spark, d):
    """Documents by genre and declared language."""
    return A.dashboard(table(spark, d, "documents"), "genre", "lang").withColumn("last_modified", F.unix_timestamp("last_modified"))


def topic_groups(spark, d):
    """The ten most frequent titles."""
    return A.topic_groups(table(spark, d, "documents"))


def confidence_buckets(spark, d):
    """Consensus tags by confidence."""
    return Q.consensus_tags(spark, d).groupBy(A.confidence_bucket(F.col("confidence")).alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.col("fallback").cast("int")).alias("n_fallback"))


def algorithm_usage(spark, d):
    """Candidates by the extractors that found them."""
    algorithms = F.filter(F.array(F.when(F.col("rake").isNotNull(), "rake"), F.when(F.col("freq").isNotNull(), "freq")), lambda a: a.isNotNull())
    return Q._merged(spark, d).select(F.explode(algorithms).alias("algorithm")).groupBy("algorithm").agg(F.count("*").alias("n"))


def tags_per_genre(spark, d):
    """Mean number and score of tags by genre."""
    tags = _tags(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("score").alias("s"))
    return tags.join(table(spark, d, "documents").select("doc_id", "genre"), "doc_id").groupBy(F.coalesce("genre", F.lit("none")).alias("genre")).agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tags"), F.round(F.sum("s") / F.sum("n"), 9).alias("mean_score"))


def evidence_hits(spark, d):
    """Chunks that hold the beginning of their document's title, and where."""
    return _quoted(spark, d).where("quoted").select("chunk_id", "doc_id", F.expr("instr(lower(text), lower(substring(title, 1, 12))) - 1").alias("at"))


def search_many(spark, d):
    """Both search stages for every hundredth document's title, its first two words, against all documents."""
    words = F.filter(F.split(F.lower("title"), r"\s+"), lambda w: w != "")
    queries = table(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.array_join(F.slice(words, 1, 2), " ").alias("query"))
    return S.search_many(_index(spark, d), S.tag_index(_tags(spark, d)), queries, S.feedback_boosts(_feedback(spark, d), AS_OF))


def index_updated(spark, d):
    """Index of the tags after documents of one source were deleted and those of one genre ingested anew with their first six tags."""
    tags = _tags(spark, d)
    docs = table(spark, d, "documents").select("doc_id", "genre", "doc_type")
    fresh = S.tag_index(tags.where("rank <= 6").join(docs.where("genre = 'report'").select("doc_id"), "doc_id", "left_semi"))
    return S.update_index(S.tag_index(tags), fresh, docs.where("doc_type = 'pdf' AND coalesce(genre, '') <> 'report'").select("doc_id"))


def viewer_filters(spark, d):
    """Documents in English with a topic and a tag that holds 'ser'."""
    docs = _index(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return A.viewer_filter(docs, language="en", has_topic=True, tag="SER").select("doc_id", F.array_join("tags", "|").alias("tags"))


def category_log(spark, d):
    """Categories in force of every subject: views and clicks set the automatic one, purchases the manual one, errors take it back."""
    log = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("ts").alias("at"), F.when(F.col("event_type") != "error", F.concat("event_type", F.lit("-"), F.floor("value").cast("string"))).alias("category"), F.when(F.col("event_type").isin("purchase", "error"), "manual").otherwise("auto").alias("by"))
    return ST.category_overlay(log)


def category_list(spark, d):
    """Event types as a list of categories after a log of additions and removals by subject."""
    events = table(spark, d, "events")
    log = events.select(F.concat("event_type", F.lit("-"), (F.col("user_id") % 50).cast("string")).alias("name"), F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") == "error", "remove").when(F.col("value") < 50, "remove").otherwise("add").alias("op"))
    return ST.edit_categories(events.select(F.concat(F.col("event_type"), F.lit("-0")).alias("name")).distinct(), log, "click-0")


def artifacts_outer(spark, d):
    """Artifacts by document as the chunks have them, as the entities name them, or both; those of no chunk have no document."""
    named = table(spark, d, "entities").select(F.explode(F.array("provenance.first_seen_artifact_id", "provenance.last_seen_artifact_id")).alias("image_id")).distinct().withColumn("parent_doc_id", F.lit(None).cast("string"))
    return M.payload_with_queue(table(spark, d, "chunks").select(F.col("artifact_id").alias("image_id"), "doc_id").distinct(), named)


def labels_merged(spark, d):
    """Subjects of events as an image queue: the last event is the last label, one with an error is ignored."""
    events = table(spark, d, "events").select(F.col("user_id").alias("image_id"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("label"), (F.col("event_type") == "error").alias("ignored"))
    queue = table(spark, d, "customer").select(F.col("c_custkey").alias("image_id"))
    return M.merge_labels(queue, events).groupBy("labeled", "ignored", "label").agg(F.count("*").alias("n"))


def withdrawn_states(spark, d):
    """Saved states whose batch is no longer in the input, once the last batch was withdrawn."""
    corpus = table(spark, d, "corpus").select("batch_id")
    kept = corpus.where(F.col("batch_id") < corpus.agg(F.max("batch_id")).scalar())
    return ST.gone_rows(table(spark, d, "tagging_state").select("state_id", "batch_id").distinct(), kept, "batch_id")


def chunk_coverage(spark, d):
    """Characters other than white space that the chunks of every document hold, overlaps not counted."""
    texts = spread(table(spark, d, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("whole")))
    spans = chunks_made(spark, d).select("doc_id", "start_offset", "end_offset")
    body = F.expr("substring(whole, start_offset + 1, end_offset - start_offset)")
    return spans.join(texts, "doc_id").groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace(body, SPACE, ""))).alias("n_chars"))


def markdown_pieces(spark, d):
    """Every document as Markdown pieces of packed paragraphs."""
    return H.chunk_markdown(spread(table(spark, d, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("text"))))


def document_quotes(spark, d):
    """Chunks that hold whole sentences of documents, with the number of those sentences and the first document; sentences are counted by document before they meet the chunks."""
    docs = table(spark, d, "documents").select("doc_id", F.explode(R._sentences(F.col("text"))).alias("s")).groupBy("s").agg(F.min("doc_id").alias("first"))
    chunks = _distinct_chunks(spark, d).select("chunk_id", F.explode(R._sentences(F.col("text"))).alias("s"))
    return chunks.join(docs, "s").groupBy("chunk_id").agg(F.count("*").alias("n_quotes"), F.min("first").alias("first_doc"))


def item_counters(spark, d):
    """Chunks of every document, those without a genre and those without text."""
    return M.counters(_distinct_chunks(spark, d), "doc_id", F.col("genre").isNotNull(), F.length(F.trim("text")) > 0)


def item_tags(spark, d):
    """Distinct sections of every document as tags."""
    tags = M.tag_union(table(spark, d, "chunks"), "doc_id", F.col("section_path"))
    return tags.select("doc_id", F.array_join("tags", "|").alias("tags"))


QUERIES = {f.__name__: f for f in (tag_index, document_index, stage1_filter, two_stage_search, legacy_search, topic_search, search_many, index_updated, viewer_filters, category_log, category_list, artifacts_outer, labels_merged, withdrawn_states, chunk_coverage, markdown_pieces, document_quotes, feedback_boost, entity_latest, entity_timeline, linked_artifacts, incremental_new_docs, deleted_states, gap_queue, pending_questions, chunk_policy, chunks_made, evidence_hits, chunk_report, chunk_histogram, rag_export, report_markdown, front_matter, genre_dashboard, topic_groups, confidence_buckets, algorithm_usage, tags_per_genre, item_counters, item_tags)}

_TAGS = Q._RAKE + Q._TERMS + ", tg AS (SELECT doc_id, term AS tag, score, in_topic AS from_topic, rank FROM (" + Q._tags_sql(Q._TF + " * weight" + Q._TOPIC, 12) + "))"
_INDEX = _TAGS + ", ti AS (SELECT lower(tag) AS tag, doc_id, max(score) AS tag_score, max(from_topic) AS from_topic FROM tg GROUP BY 1, 2), tl AS (SELECT doc_id, list(tag ORDER BY rank) AS tags FROM tg GROUP BY 1), di AS (SELECT doc_id, title, genre, title AS topic, text, coalesce(tags, []) AS tags FROM documents LEFT JOIN tl USING (doc_id))"
_BOOSTS = f"""
, fb AS (SELECT user_id AS doc_id, ts, CASE WHEN event_type IN ('click', 'purchase') THEN 'like' WHEN event_type = 'error' THEN 'dislike' END AS feedback FROM events),
fv AS (SELECT doc_id, sum((feedback = 'like')::INT)::BIGINT AS likes, sum((feedback = 'dislike')::INT)::BIGINT AS dislikes, max(ts) AS last_ts, arg_max(feedback, (ts, feedback)) AS last FROM fb WHERE feedback IS NOT NULL GROUP BY 1),
fd AS (SELECT *, floor((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(last_ts))) / 86400) AS days, 0.5::DOUBLE + likes / (likes + dislikes) * 1.5::DOUBLE AS base FROM fv),
boosts AS (SELECT doc_id, likes, dislikes, last_ts, round(CASE WHEN days <= 7 THEN least(2.0::DOUBLE, base + 0.2::DOUBLE * (1 - days / 7)) ELSE base END, 6) AS boost, CASE WHEN last = 'like' THEN 'liked' ELSE 'disliked' END AS status FROM fd)
"""


def _any_sql(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _stage1_sql(q: str) -> str:
    words = q.lower().split()
    return f"""
, s1 AS (SELECT doc_id, round(sum(tag_score * CASE WHEN from_topic THEN 1.5::DOUBLE ELSE 1 END * CASE WHEN tag = '{q}' THEN 2 WHEN contains(tag, '{q}') OR contains('{q}', tag) THEN 1.5::DOUBLE ELSE 1 END), 6) AS score FROM ti
         WHERE {_any_sql('tag', words)} OR len(list_filter(string_split(tag, ' '), lambda t: t <> '' AND contains('{q}', t))) > 0 GROUP BY 1),
stage1 AS (SELECT * FROM s1 ORDER BY score DESC, doc_id LIMIT 100)"""


def _stage2_sql(source: str, q: str, boosted: bool, limit: int) -> str:
    words = q.lower().split()
    weights = " ".join(f"WHEN genre = '{g}' THEN {next(v for k, v in ws.items() if k in q)}" for g, ws in S.SEARCH_WEIGHTS.items() if any(k in q for k in ws))
    weight = f"CASE {weights} ELSE 1 END" if weights else "1"
    return f"""
, a AS (SELECT doc_id, genre, lower(coalesce(topic, '')) AS tp, lower(coalesce(title, '')) AS tt, lower(coalesce(text, '')) AS tx, tags FROM {source}),
p AS (SELECT doc_id, genre, CASE WHEN contains(tp, '{q}') THEN 100 WHEN {_any_sql('tp', words)} THEN 50 ELSE 0 END AS p, CASE WHEN contains(tt, '{q}') THEN 30 WHEN {_any_sql('tt', words)} THEN 15 ELSE 0 END AS t,
      coalesce(list_sum(list_transform(tags, lambda x: CASE WHEN lower(x) = '{q}' THEN 20 WHEN contains(lower(x), '{q}') OR contains('{q}', lower(x)) THEN 10 WHEN {_any_sql('lower(x)', words)} THEN 5 ELSE 0 END)), 0) AS g,
      contains(tx, '{q}') AS whole, {_any_sql('tx', words)} AS partly FROM a),
b AS (SELECT *, ((p + t + g + CASE WHEN whole THEN 5 WHEN partly THEN 1 ELSE 0 END) * ({weight})::DOUBLE)::DOUBLE AS base FROM p WHERE p + t + g > 0)
SELECT doc_id, round(base, 2) AS base_score, array_to_string(list_filter([CASE WHEN p = 100 THEN 'topic' WHEN p = 50 THEN 'topic part' END, CASE WHEN t = 30 THEN 'title' WHEN t = 15 THEN 'title part' END, CASE WHEN g > 0 THEN 'tags' END, CASE WHEN whole THEN 'text' END], lambda r: r IS NOT NULL), ',') AS reasons,
       {'coalesce(boost, 1.0::DOUBLE)' if boosted else '1.0::DOUBLE'} AS feedback_boost, round(base * {'coalesce(boost, 1.0::DOUBLE)' if boosted else '1'}, 2) AS score FROM b {'LEFT JOIN boosts USING (doc_id)' if boosted else ''} ORDER BY score DESC, doc_id LIMIT {limit}"""


_CHUNKS = "ch AS (SELECT chunk_id, b.doc_id, b.chunk_index, b.text, b.genre, b.title FROM (SELECT chunk_id, max(struct_pack(ingested_at := ingested_at, doc_id := doc_id, chunk_index := chunk_index, text := text, genre := genre, title := title)) AS b FROM chunks GROUP BY 1))"
_QLOG = "q AS (SELECT entry_id, max(struct_pack(logged_at := logged_at, {0})) AS b FROM qna_log GROUP BY 1)"
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_QUOTED = "coalesce(contains(lower(text), lower(left(title, 12))), false)"
_TOPIC_WORDS = ["the", "server", "was"]

_MANY = r"""
, q AS (SELECT doc_id AS qid, array_to_string(list_filter(regexp_split_to_array(lower(title), '\s+'), lambda w: w <> '')[1:2], ' ') AS low FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL),
qw AS (SELECT qid, low, list_distinct(string_split(low, ' ')) AS words FROM q WHERE low <> ''),
sm AS (SELECT qid, doc_id, round(sum(tag_score * CASE WHEN from_topic THEN 1.5::DOUBLE ELSE 1 END * CASE WHEN tag = low THEN 2 WHEN contains(tag, low) OR contains(low, tag) THEN 1.5::DOUBLE ELSE 1 END), 6) AS score FROM ti, qw
       WHERE len(list_filter(words, lambda w: contains(tag, w))) > 0 OR len(list_filter(string_split(tag, ' '), lambda t: t <> '' AND contains(low, t))) > 0 GROUP BY 1, 2),
st AS (SELECT qid, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM sm) WHERE r <= 100),
sj AS (SELECT qid, doc_id, genre, low, words, lower(coalesce(topic, '')) AS tp, lower(coalesce(title, '')) AS tt, lower(coalesce(text, '')) AS tx, tags FROM st JOIN di USING (doc_id) JOIN qw USING (qid)),
sp AS (SELECT qid, doc_id, CASE WHEN contains(tp, low) THEN 100 WHEN len(list_filter(words, lambda w: contains(tp, w))) > 0 THEN 50 ELSE 0 END AS p, CASE WHEN contains(tt, low) THEN 30 WHEN len(list_filter(words, lambda w: contains(tt, w))) > 0 THEN 15 ELSE 0 END AS t,
       coalesce(list_sum(list_transform(tags, lambda x: CASE WHEN lower(x) = low THEN 20 WHEN contains(lower(x), low) OR contains(low, lower(x)) THEN 10 WHEN len(list_filter(words, lambda w: contains(lower(x), w))) > 0 THEN 5 ELSE 0 END)), 0) AS g,
       contains(tx, low) AS whole, len(list_filter(words, lambda w: contains(tx, w))) > 0 AS partly, {weight}::DOUBLE AS w FROM sj),
sb AS (SELECT *, ((p + t + g + CASE WHEN whole THEN 5 WHEN partly THEN 1 ELSE 0 END) * w)::DOUBLE AS base FROM sp WHERE p + t + g > 0),
sf AS (SELECT qid, doc_id, round(base, 2) AS base_score, coalesce(boost, 1.0::DOUBLE) AS feedback_boost, round(base * coalesce(boost, 1.0::DOUBLE), 2) AS score,
       array_to_string(list_filter([CASE WHEN p = 100 THEN 'topic' WHEN p = 50 THEN 'topic part' END, CASE WHEN t = 30 THEN 'title' WHEN t = 15 THEN 'title part' END, CASE WHEN g > 0 THEN 'tags' END, CASE WHEN whole THEN 'text' END], lambda r: r IS NOT NULL), ',') AS reasons FROM sb LEFT JOIN boosts USING (doc_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sf) WHERE rank <= 20"""
_MANY_WEIGHT = "CASE " + " ".join(f"WHEN genre = '{g}' THEN CASE " + " ".join(f"WHEN contains(low, '{k}') THEN {v}" for k, v in by.items()) + " ELSE 1.0 END" for g, by in S.SEARCH_WEIGHTS.items()) + " ELSE 1.0 END"

ORACLE = {
    "search_many": _INDEX + _BOOSTS + _MANY.replace("{weight}", _MANY_WEIGHT),
    "index_updated": _INDEX + """
        , dn AS (SELECT doc_id FROM documents WHERE genre = 'report' OR doc_type = 'pdf')
        SELECT * FROM ti WHERE doc_id NOT IN (SELECT doc_id FROM dn) UNION ALL SELECT lower(tag), doc_id, max(score), max(from_topic) FROM tg WHERE rank <= 6 AND doc_id IN (SELECT doc_id FROM documents WHERE genre = 'report') GROUP BY 1, 2""",
    "viewer_filters": _INDEX + r"SELECT di.doc_id, array_to_string(tags, '|') AS tags FROM di JOIN documents USING (doc_id) WHERE lang = 'en' AND coalesce(length(regexp_replace(topic, '^\s+|\s+$', '', 'g')), 0) > 0 AND len(list_filter(tags, lambda t: contains(lower(t), 'ser'))) > 0",
    "category_log": """
        WITH l AS (SELECT user_id AS doc_id, ts, CASE WHEN event_type <> 'error' THEN event_type || '-' || floor(value)::BIGINT::VARCHAR ELSE '' END AS c, event_type IN ('purchase', 'error') AS m FROM events WHERE user_id IS NOT NULL)
        SELECT doc_id, nullif((max(struct_pack(ts := ts, c := c)) FILTER (m)).c, '') AS manual, nullif((max(struct_pack(ts := ts, c := c)) FILTER (NOT m)).c, '') AS auto FROM l GROUP BY 1""",
    "category_list": """
        WITH l AS (SELECT event_type || '-' || (user_id % 50)::VARCHAR AS name, arg_max(CASE WHEN event_type = 'error' OR value < 50 THEN 'remove' ELSE 'add' END, (ts, event_id)) AS op FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL GROUP BY 1)
        SELECT DISTINCT name FROM (SELECT event_type || '-0' AS name FROM events UNION ALL SELECT name FROM l WHERE op = 'add') WHERE name NOT IN (SELECT name FROM l WHERE op = 'remove' AND name <> 'click-0')""",
    "artifacts_outer": """
        WITH p AS (SELECT artifact_id AS i, min(doc_id) AS d FROM chunks WHERE artifact_id IS NOT NULL GROUP BY 1), e AS (SELECT DISTINCT unnest([provenance.first_seen_artifact_id, provenance.last_seen_artifact_id]) AS i FROM entities), n AS (SELECT i, true AS q FROM e WHERE i IS NOT NULL)
        SELECT d AS doc_id, count(p.i) AS n_payload, count(q) AS n_queued, count(CASE WHEN p.i IS NOT NULL AND q THEN 1 END) AS n_both FROM p FULL JOIN n ON p.i = n.i GROUP BY 1""",
    "labels_merged": """
        WITH l AS (SELECT user_id AS i, arg_max(event_type, (ts, event_id)) AS label FROM events WHERE user_id IS NOT NULL GROUP BY 1)
        SELECT l.i IS NOT NULL AND NOT coalesce(label = 'error', false) AS labeled, coalesce(label = 'error', false) AS ignored, label, count(*) AS n FROM customer LEFT JOIN l ON c_custkey = l.i GROUP BY 1, 2, 3""",
    "withdrawn_states": "SELECT DISTINCT state_id, batch_id FROM tagging_state WHERE batch_id IS NULL OR batch_id NOT IN (SELECT batch_id FROM corpus WHERE batch_id < (SELECT max(batch_id) FROM corpus))",
    "chunk_coverage": f"SELECT doc_id, length(regexp_replace(text, '{SPACE}', '', 'g')) AS n_chars FROM documents WHERE length(trim({_TRIM.format('text')})) > 0",
    "document_quotes": rf"""
        WITH {_CHUNKS}, cs AS (SELECT DISTINCT chunk_id, regexp_replace(lower(s), '[^0-9a-z가-힣]+', '', 'g') AS s FROM (SELECT chunk_id, unnest(regexp_split_to_array(text, '[.!?。]\s+|[.!?。]$')) AS s FROM ch)),
        ds AS (SELECT regexp_replace(lower(s), '[^0-9a-z가-힣]+', '', 'g') AS s, min(doc_id) AS first FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?。]\s+|[.!?。]$')) AS s FROM documents) GROUP BY 1)
        SELECT chunk_id, count(*) AS n_quotes, min(first) AS first_doc FROM cs JOIN ds USING (s) WHERE length(s) >= 20 GROUP BY 1""",
    "tag_index": _INDEX + "SELECT * FROM ti",
    "document_index": _INDEX + "SELECT doc_id, title, genre, array_to_string(tags, '|') AS tags FROM di",
    "stage1_filter": _INDEX + _stage1_sql(QUERY) + "SELECT * FROM stage1",
    "two_stage_search": _INDEX + _stage1_sql(QUERY) + _BOOSTS + _stage2_sql("(SELECT * FROM di WHERE doc_id IN (SELECT doc_id FROM stage1))", QUERY, True, 20),
    "legacy_search": _INDEX + _stage2_sql("di", ISSUE_QUERY, False, 50),
    "topic_search": f"""
        WITH t AS (SELECT doc_id, lower(title) AS t FROM documents WHERE title IS NOT NULL AND title <> ''),
        s AS (SELECT doc_id, CASE WHEN contains(t, 'the server was') THEN 100 ELSE round(({' + '.join(f"contains(t, '{w}')::INT" for w in _TOPIC_WORDS)}) / 3 * 50, 6) END::DOUBLE AS score FROM t)
        SELECT * FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50""",
    "feedback_boost": "WITH x AS (SELECT 1)" + _BOOSTS + "SELECT * EXCLUDE (last_ts), floor(epoch(last_ts))::BIGINT AS last_ts FROM boosts",
    "entity_latest": """
        WITH r AS (SELECT entity_id, max(struct_pack(u := updated_at, n := name, t := entity_type, a := aliases, l := provenance.last_seen_artifact_id)) AS n, min(struct_pack(c := created_at, f := provenance.first_seen_artifact_id)) AS o, count(*) AS n_rows FROM entities WHERE entity_id IS NOT NULL GROUP BY 1)
        SELECT entity_id, n.n AS name, n.t AS entity_type, len(coalesce(n.a, [])) AS n_aliases, floor(epoch(o.c))::BIGINT AS created_s, floor(epoch(n.u))::BIGINT AS updated_s, o.f AS first_seen, n.l AS last_seen, n_rows FROM r""",
    "entity_timeline": """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events), k AS (SELECT user_id, count(*) AS n_kept, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) FILTER (r <= 3) AS last_ids FROM r WHERE r <= 200 GROUP BY 1),
        s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1), n AS (SELECT user_id, count(*) AS n_events FROM events GROUP BY 1)
        SELECT user_id, n_events, CASE WHEN last = 'error' THEN 'active' ELSE 'unknown' END AS status, n_kept, last_ids FROM k JOIN n USING (user_id) LEFT JOIN s USING (user_id)""",
    "linked_artifacts": """
        WITH s AS (SELECT DISTINCT entity_id, artifact_id FROM (SELECT entity_id, unnest([provenance.first_seen_artifact_id, provenance.last_seen_artifact_id]) AS artifact_id FROM entities) WHERE artifact_id IS NOT NULL),
        c AS (SELECT artifact_id, count(*) AS n_entities FROM s GROUP BY 1), o AS (SELECT artifact_id, min(doc_id) AS doc_id FROM chunks GROUP BY 1)
        SELECT artifact_id, doc_id, n_entities FROM c LEFT JOIN o USING (artifact_id)""",
    "incremental_new_docs": "WITH l AS (SELECT max(batch_id) AS b FROM corpus) SELECT DISTINCT doc_id FROM corpus, l WHERE batch_id = b AND doc_id NOT IN (SELECT doc_id FROM corpus, l WHERE batch_id < b AND doc_id IS NOT NULL)",
    "deleted_states": "SELECT DISTINCT state_id, batch_id FROM tagging_state WHERE batch_id IS NULL OR batch_id NOT IN (SELECT batch_id FROM corpus WHERE length(text) > 0 AND batch_id IS NOT NULL)",
    "gap_queue": "WITH " + _QLOG.format("has_answer := has_answer, doc_created := doc_created") + " SELECT CASE WHEN b.has_answer IS NULL THEN 'PENDING' WHEN coalesce(b.doc_created, false) THEN 'DONE' ELSE 'FAILED' END AS status, count(*) AS n FROM q GROUP BY 1",
    "pending_questions": "WITH " + _QLOG.format("question := question, doc_created := doc_created") + " SELECT entry_id, b.question AS question FROM q WHERE NOT coalesce(b.doc_created, false) ORDER BY entry_id LIMIT 50",
    "chunk_policy": """
        WITH n AS (SELECT length(text) AS n FROM documents WHERE text IS NOT NULL)
        SELECT CASE WHEN n < 500 THEN least(256, n // 2) WHEN n > 10000 THEN 768 ELSE 512 END AS target, CASE WHEN n < 500 THEN least(64, n // 4) WHEN n > 10000 THEN 256 ELSE 128 END AS least, CASE WHEN n < 500 THEN 48 WHEN n > 10000 THEN 128 ELSE 96 END AS overlap, count(*) AS n FROM n GROUP BY 1, 2, 3""",
    "evidence_hits": f"WITH {_CHUNKS} SELECT chunk_id, doc_id, instr(lower(text), lower(left(title, 12))) - 1 AS at FROM ch WHERE {_QUOTED}",
    "chunk_report": f"WITH {_CHUNKS} SELECT doc_id, count(*) AS n_chunks, round(avg(length(text)), 6) AS mean_chars, max(length(text)) AS longest, sum({_QUOTED}::INT)::BIGINT AS n_quoted, round(sum({_QUOTED}::INT) / count(*), 6) AS mapping_rate FROM ch GROUP BY 1",
    "chunk_histogram": f"WITH {_CHUNKS} SELECT length(text) // 100 * 100 AS bucket, count(*) AS n FROM ch WHERE text IS NOT NULL GROUP BY 1",
    "rag_export": f"WITH {_CHUNKS} SELECT doc_id || '__c' || printf('%04d', chunk_index) AS chunk_key, '[title: ' || coalesce(title, '-') || ' | genre: ' || coalesce(genre, '-') || ']' || chr(10) || coalesce(text, '') AS body FROM ch",
    "report_markdown": "WITH " + _QLOG.format("question := question, a := portal_answer_snippet, s := analysis_summary") + f""", r AS (SELECT entry_id, {_TRIM.format('b.question')} AS q, {_TRIM.format('b.a')} AS a, {_TRIM.format('b.s')} AS s FROM q)
        SELECT entry_id, concat_ws(chr(10), '## Question', coalesce(nullif(q, ''), '-'), '## Answer', coalesce(nullif(a, ''), '-'), '## Analysis', coalesce(nullif(s, ''), '-')) AS report FROM r""",
    "front_matter": "SELECT doc_id, '---' || chr(10) || 'title: ' || coalesce(title, '') || chr(10) || 'genre: ' || coalesce(genre, '') || chr(10) || 'chars: ' || coalesce(n_chars::VARCHAR, '') || chr(10) || '---' || chr(10) || chr(10) || coalesce(text, '') AS markdown FROM documents",
    "genre_dashboard": f"SELECT coalesce(genre, 'none') AS genre, coalesce(lang, 'none') AS lang, count(*) AS n_docs, sum(n_chars)::BIGINT AS chars, sum((coalesce(length({_TRIM.format('text')}), 0) = 0)::INT)::BIGINT AS n_empty, floor(epoch(max(modified_at)))::BIGINT AS last_modified FROM documents GROUP BY 1, 2",
    "topic_groups": f"SELECT left({_TRIM.format('title')}, 50) AS topic, count(*) AS n FROM documents WHERE length({_TRIM.format('title')}) > 0 GROUP BY 1 ORDER BY n DESC, topic LIMIT 10",
    "confidence_buckets": Q._CONSENSUS + "SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'mid' ELSE 'low' END AS bucket, count(*) AS n, sum(fallback::INT)::BIGINT AS n_fallback FROM cons GROUP BY 1",
    "algorithm_usage": Q._RAKE + Q._MERGE + "SELECT 'rake' AS algorithm, count(rake) AS n FROM merged UNION ALL SELECT 'freq', count(freq) FROM merged",
    "item_counters": f"WITH {_CHUNKS} SELECT doc_id, count(*) AS total, sum((genre IS NULL)::INT)::BIGINT AS unlabeled, sum((NOT coalesce(length(trim(text)) > 0, false))::INT)::BIGINT AS missing FROM ch GROUP BY 1",
    "item_tags": r"WITH t AS (SELECT DISTINCT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(section_path, '^\s+|\s+$', '', 'g'), '^#', ''), '\s+', '_', 'g')) AS t FROM chunks) SELECT doc_id, string_agg(t, '|' ORDER BY t) AS tags FROM t WHERE t <> '' GROUP BY 1",
    "tags_per_genre": _TAGS + ", g AS (SELECT doc_id, count(*) AS n, sum(score) AS s FROM tg GROUP BY 1) SELECT coalesce(genre, 'none') AS genre, count(*) AS n_docs, sum(n)::BIGINT AS n_tags, round(sum(s) / sum(n), 9) AS mean_score FROM g JOIN documents USING (doc_id) GROUP BY 1",
}
