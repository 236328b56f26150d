"""Rule classifiers, entity extraction, answer predicates and clusters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.constants import DENY_PHRASES, PRODUCTS
from lexloom.functions.text import trim_space

_BEFORE, _AFTER = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"


def bounded(pattern: str) -> str:
    """The pattern with \\b at its ends written out as the border of a Unicode word."""
    head = _BEFORE if pattern.startswith(r"\b") else ""
    tail = _AFTER if pattern.endswith(r"\b") else ""
    return head + pattern.removeprefix(r"\b").removesuffix(r"\b") + tail


def has_pattern(text: Column, pattern: str) -> Column:
    """Whether a text has a pattern; plain words are looked for as such, and the word borders round them are only tested where they stand."""
    core = pattern.removeprefix(r"\b").removesuffix(r"\b")
    words = core.split("|") if core == pattern else [core]
    if not all(w and re.fullmatch(r"[\w ]+", w) for w in words):
        return text.rlike(bounded(pattern))
    found = text.contains(words[0])
    for w in words[1:]:
        found = found | text.contains(w)
    return found if core == pattern else found & text.rlike(bounded(pattern))


def genre_scores(blob: Column, rules: dict[str, list[str]]) -> dict[str, Column]:
    """Number of each genre's patterns that the lower-cased text has."""
    return {g: sum((has_pattern(blob, p).cast("int") for p in pats[1:]), has_pattern(blob, pats[0]).cast("int")) for g, pats in rules.items()}


def classify_genre(docs: DataFrame, rules: dict[str, list[str]], max_lines: int, keys: list[str]) -> DataFrame:
    """keys, genre, hits, confidence, evidence: the genre with most patterns in title and text, the first in the rules' order on ties.

    Confidence is 0.35 + 0.12 per pattern, at most 0.95, and 0.2 for
    ``unknown``; the evidence is up to three of the first lines that show a
    pattern of the genre, 180 characters each, joined by LF.
    """
    blob = F.lower(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    scored = docs.select(*keys, "text", blob.alias("_b")).select(*keys, "text", F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("o"), F.lit(g).alias("g")) for i, (g, s) in enumerate(genre_scores(F.col("_b"), rules).items())]).alias("_s"))
    best = scored.withColumn("_m", F.array_max("_s"))
    named = best.select(*keys, "text", F.when(F.col("_m.s") > 0, F.col("_m.g")).otherwise("unknown").alias("genre"), F.col("_m.s").alias("hits"))
    lines = F.slice(F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n"), trim_space), lambda x: x != ""), 1, max_lines)

    def shows(line: Column) -> Column:
        low, test = F.lower(line), F.lit(False)
        for g, pats in rules.items():
            test = F.when(F.col("genre") == g, low.rlike("|".join(f"(?:{bounded(p)})" for p in pats))).otherwise(test)
        return test

    quotes = F.transform(F.slice(F.filter(lines, shows), 1, 3), lambda x: F.substring(x, 1, 180))
    confidence = F.when(F.col("genre") == "unknown", 0.2).otherwise(F.round(F.least(F.lit(0.95), 0.35 + 0.12 * F.col("hits")), 3))
    return named.select(*keys, "genre", "hits", confidence.alias("confidence"), F.array_join(quotes, "\n").alias("evidence"))


def extract_entities(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, entity_type, name: distinct customers ("X사"), products, versions, exceptions and error codes of title and text."""
    blob = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))

    def found(kind: str, pattern: str, group: int = 1) -> Column:
        return F.transform(F.regexp_extract_all("_b", F.lit(pattern), F.lit(group)), lambda n: F.struct(F.lit(kind).alias("t"), n.alias("n")))

    edge = r"(?![\p{L}\p{N}_])"
    start = r"(?<![\p{L}\p{N}_])"
    products = F.filter(F.array(*[F.struct(F.lit("product").alias("t"), F.lit(p).alias("n")) for p in PRODUCTS]), lambda e: F.lower("_b").contains(F.lower(e["n"])))
    parts = [
        found("customer", rf"([A-Za-z가-힣0-9]{{1,8}}\s*사){edge}"),
        products,
        found("version", rf"{start}([0-9]+\.[0-9]+(?:\.[0-9]+)?){edge}"),
        found("issue", rf"{start}([A-Za-z_]+Exception){edge}"),
        found("issue", rf"{start}([A-Z]{{2,5}}-[0-9]{{3,5}}){edge}"),
    ]
    every = docs.select(*keys, blob.alias("_b")).select(*keys, F.array_distinct(F.concat(*parts)).alias("_e"))
    return every.select(*keys, F.explode("_e").alias("e")).select(*keys, F.col("e.t").alias("entity_type"), F.col("e.n").alias("name"))


def is_meaningful(answer: Column) -> Column:
    """Whether an answer has 20 characters and none of the wordings that tell nothing; null gives false."""
    t = trim_space(answer)
    deny = F.lit(False)
    for p in DENY_PHRASES:
        deny = deny | t.contains(p)
    return F.coalesce((F.length(t) >= 20) & ~deny, F.lit(False))


def follow_ups(text: Column) -> Column:
    """Distinct lines without bullets and numbers, in order."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: trim_space(F.regexp_replace(trim_space(x), r"^[\-0-9.)(]+\s*", "")))
    return F.array_distinct(F.filter(lines, lambda x: x != ""))


def effective_category(manual: Column, auto: Column, genre: Column, names: dict[str, str], other: str = "기타") -> Column:
    """The manual category, else the automatic one, else the genre's, else ``other``."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(manual, auto, F.element_at(table, genre), F.lit(other))


def kmeans_categories(vectors: DataFrame, label: str = "label", vec_id: str = "vec_id", vec: str = "embedding", k: int | None = None, seed: int = 42) -> DataFrame:
    """(vec_id, cluster, category, confidence): clusters named by the majority of their labels; confidence is 1 - 0.5 * distance over the cluster's greatest."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = vectors.where(F.col(vec).isNotNull()).select(vec_id, label, array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    model = KMeans(k=k or 10, seed=seed, maxIter=20).fit(data)
    centers = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    placed = model.transform(data).withColumn("cluster", F.col("prediction"))
    gaps = F.zip_with(vector_to_array("features"), F.element_at(centers, F.col("cluster") + 1), lambda a, b: (a - b) * (a - b))
    far = placed.withColumn("dist", F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)))
    votes = far.groupBy("cluster", label).agg(F.count("*").alias("n"))
    names = votes.groupBy("cluster").agg(F.min_by(F.col(label), F.struct(-F.col("n"), F.col(label))).alias("category"))
    most = far.groupBy("cluster").agg(F.max("dist").alias("most"))
    confidence = F.when(F.col("most") == 0, 1.0).otherwise(1 - 0.5 * F.col("dist") / F.col("most"))
    return far.join(names, "cluster").join(most, "cluster").select(vec_id, "cluster", "category", F.round(confidence, 6).alias("confidence"))

