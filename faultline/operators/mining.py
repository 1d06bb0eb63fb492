"""Mining: keyword counts and clusters of unexplained failures, and rules from labelled signals."""

from __future__ import annotations

import math
import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import (
    CountVectorizerModel, ElementwiseProduct, Normalizer, RegexTokenizer, StopWordsRemover, StringIndexer, VectorAssembler,
)
from pyspark.ml.fpm import FPGrowth
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import cut_lineage, written_table

# Words the keyword count ignores.
KEYWORD_STOPWORDS = [
    "the", "a", "an", "is", "was", "of", "in", "to", "and", "or", "at", "by", "for", "with", "on", "not", "no",
    "it", "this", "that", "be", "are", "were", "as", "has", "have", "had", "did", "do", "does", "step", "agent",
    "run", "code", "file", "error", "exit", "none", "true", "false", "from", "but", "its", "which", "their", "there",
]
KEYWORD = r"(?U)\b[a-z][a-z_]{2,}\b"
TERMS, CLUSTERS, STARTS, SEED = 300, 3, 10, 42
TREE_DEPTH, MIN_SUPPORT, MIN_PRECISION = 5, 3, 0.85


def other_bucket(cards: DataFrame) -> DataFrame:
    return cards.filter(F.col("primary_category") == "OTHER")


def card_text() -> Column:
    """Root cause and evidence texts of a card, blanks left out."""
    evidence = F.flatten(F.transform("evidence", lambda e: F.array(e["excerpt"], e["why"])))
    parts = F.concat(F.array("root_cause"), F.coalesce(evidence, F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, lambda p: F.length(p) > 0), " ")


def keyword_counts(texts: DataFrame) -> DataFrame:
    """How often each keyword occurs over all ``text`` rows."""
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(KEYWORD), F.lit(0))
    words = texts.select(F.explode(tokens).alias("term"))
    return words.filter(~F.col("term").isin(KEYWORD_STOPWORDS)).groupBy("term").agg(F.count("*").alias("count"))


def top_keywords(texts: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most frequent keywords; equal counts in alphabetical order."""
    return keyword_counts(texts).orderBy(F.desc("count"), "term").limit(n)


def _kept_words(stop_words: list[str]) -> str:
    """A pattern for whole words of two letters and more that are none of ``stop_words``.

    Letters are Unicode's word characters; ASCII ones are told without its tables.
    """
    letter = r"[a-zA-Z0-9_[[^\x00-\x7F]&&\w]]"
    ignored = "|".join(sorted({w.lower() for w in stop_words if re.fullmatch(r"\w\w+", w)}))
    return f"(?U)(?<!{letter})" + (f"(?!(?:{ignored})(?!{letter}))" if ignored else "") + f"{letter}{letter}+"


def grams(texts: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """Add ``words``, those of two letters and more without ``stop_words`` (Spark's English list), and ``grams``, the
    words and their neighbouring pairs."""
    ignored = StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else stop_words
    kept = RegexTokenizer(inputCol="text", outputCol="words", pattern=_kept_words(ignored), gaps=False).transform(
        texts.withColumn("text", F.coalesce("text", F.lit(""))))
    return kept.withColumn("grams", _with_pairs())


def _with_pairs() -> Column:
    following = F.slice("words", F.lit(2), F.size("words"))
    pairs = F.filter(F.zip_with("words", following, lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull())
    return F.concat("words", pairs)


def _held(rows: DataFrame, items: Column) -> DataFrame:
    """The fields of the structs in each row's array ``items``, and whether it is the ``first`` such item of the row.

    Equal items of a row are neighbours once sorted, so this needs no shuffle.
    """
    ordered = rows.select(F.sort_array(items).alias("_items"))
    before = F.concat(F.slice("_items", 1, 1), F.col("_items"))
    held = ordered.select(F.posexplode(F.arrays_zip(F.col("_items").alias("item"), before.alias("before"))).alias("at", "held"))
    held = held.filter(F.col("held.item").isNotNull())
    return held.select("held.item.*", ((F.col("at") == 0) | (F.col("held.item") != F.col("held.before"))).alias("first"))


def _counts(held: DataFrame, *keys: str) -> DataFrame:
    return held.groupBy(*keys).agg(F.count("*").alias("count"), F.count_if("first").alias("document_count"))


def term_weights(counted: DataFrame, n_terms: int = TERMS) -> DataFrame:
    """``term, count, document_count, weight`` of the ``n_terms`` most frequent terms of rows from ``grams``.

    Equal counts are taken in alphabetical order, so the vocabulary does not depend on partitions. The weight is
    ln((1 + rows) / (1 + rows with the term)) + 1.

    A pair occurs at most as often as each of its words, and its first word comes before it in the alphabet. So a
    pair can be a term only if its first word is one of the ``n_terms`` first words, and its second word occurs as
    often as the last of these at least. Only such pairs are counted.
    """
    return _weights(written_table(counted.select("words")), n_terms)


def _weights(counted: DataFrame, n_terms: int) -> DataFrame:
    """``term_weights`` of written rows, which are read twice."""
    rows = counted.agg(F.count("*")).scalar()
    words = written_table(_counts(_held(counted, F.arrays_zip(F.col("words").alias("term"))), "term"))
    leading = words.orderBy(F.desc("count"), "term").limit(n_terms).collect()  # n_terms rows
    least = min(r["count"] for r in leading) if len(leading) == n_terms else 0
    frequent = written_table(words.filter(F.col("count") >= least).select(F.col("term").alias("b")))
    both = _held(counted, F.arrays_zip(F.col("words").alias("a"), F.slice("words", F.lit(2), F.size("words")).alias("b")))
    both = both.filter(F.col("b").isNotNull() & F.col("a").isin([r["term"] for r in leading])).join(frequent, "b", "left_semi")
    pairs = _counts(both, "a", "b").select(F.concat("a", F.lit(" "), "b").alias("term"), "count", "document_count")
    top = words.unionByName(pairs).orderBy(F.desc("count"), "term").limit(n_terms)
    return top.withColumn("weight", F.log((1 + rows) / (1 + F.col("document_count"))) + 1)


def tfidf(texts: DataFrame, n_terms: int = TERMS, stop_words: list[str] | None = None):
    """Add ``features``: unit TF-IDF vectors over the ``n_terms`` most frequent words and word pairs.
    Returns the frame and the vocabulary, by falling count and then by term."""
    # Words are cut out of the texts once; what follows reads them several times.
    kept = written_table(grams(texts, stop_words).drop("grams"))
    top = _weights(kept.select("words"), n_terms).orderBy(F.desc("count"), "term").collect()  # n_terms rows
    vocabulary = [r["term"] for r in top]
    if not vocabulary:
        return kept.drop("words").withColumn("features", array_to_vector(F.array().cast("array<double>"))), vocabulary
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="_tf")
    weighted = ElementwiseProduct(scalingVec=Vectors.dense([r["weight"] for r in top]), inputCol="_tf", outputCol="_weighted").transform(
        counter.transform(kept.withColumn("grams", _with_pairs())).drop("words", "grams"))
    unit = Normalizer(inputCol="_weighted", outputCol="features").transform(weighted)
    return unit.drop("_tf", "_weighted"), vocabulary


def best_of_starts(vectors: DataFrame, k: int, starts: int = STARTS, seed: int = SEED):
    """KMeans models from ``starts`` seeds, trained side by side on the same cached rows; the one of least cost.

    Equal costs take the lower seed. Returns the model and every start's cost.
    """
    vectors.persist()
    try:
        def fit(own: int):
            return KMeans(k=k, seed=own, featuresCol="features", predictionCol="cluster").fit(vectors)

        # Threads only submit jobs; the work of all starts is in the cluster's tasks.
        with ThreadPoolExecutor(max_workers=starts) as pool:
            models = list(pool.map(fit, range(seed, seed + starts)))
    finally:
        vectors.unpersist()
    costs = [m.summary.trainingCost for m in models]
    return models[min(range(starts), key=lambda i: (costs[i], i))], costs


def cluster_texts(texts: DataFrame, k: int = CLUSTERS, key: str = "run_id", starts: int = STARTS):
    """KMeans over the texts: ``(members, terms)`` with ``cluster`` per key and the centroids as
    ``cluster, term, weight``.

    Rows are dealt by the digest of their key and sorted, so the starts do not depend on how the texts came.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digest = F.md5(F.col(key).cast("string"))
    vectors, vocabulary = tfidf(texts.select(key, "text"))
    dealt = cut_lineage(vectors.drop("text").repartition(parts, digest).sortWithinPartitions(digest))
    model, _ = best_of_starts(dealt, k, starts)
    members = model.transform(dealt).select(key, "cluster")
    # At most k x 300 numbers: the model itself.
    centers = [
        (c, vocabulary[i], float(w)) for c, center in enumerate(model.clusterCenters()) for i, w in enumerate(center)
    ]
    terms = texts.sparkSession.createDataFrame(centers, "cluster INT, term STRING, weight DOUBLE")
    return members, terms


def cluster_report(texts: DataFrame, k: int = CLUSTERS, key: str = "run_id", n_terms: int = 10, n_members: int = 5) -> DataFrame:
    """Per cluster its size, its strongest terms and its first members."""
    members, terms = cluster_texts(texts, k, key)
    strongest = Window.partitionBy("cluster").orderBy(F.desc("weight"), "term")
    top = terms.withColumn("rank", F.row_number().over(strongest)).filter(F.col("rank") <= n_terms)
    top = top.groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("top_terms")
    )
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
    # The rank filter keeps at most n_members rows per cluster and task before the shuffle.
    by_key = Window.partitionBy("cluster").orderBy(key)
    head = members.withColumn("_rank", F.row_number().over(by_key)).filter(F.col("_rank") <= n_members)
    shown = head.groupBy("cluster").agg(F.array_sort(F.collect_list(key)).alias("members"))
    return sizes.join(top, "cluster").join(shown, "cluster")


def explain_other(cards: DataFrame, by: str = "clusters", k: int = CLUSTERS) -> DataFrame:
    """The OTHER cards ``by`` "clusters" (which need at least ``k`` cards) or by "keywords"."""
    if by not in ("clusters", "keywords"):
        raise ValueError(f"unknown way to explain: {by}")
    texts = other_bucket(cards).select("run_id", card_text().alias("text"))
    return cluster_report(texts, k) if by == "clusters" else top_keywords(texts)


# ---------------------------------------------------------------------------------------------
# Rules from labels

# The features rules are mined from.
FEATURES = [
    "produced_patch", "no_file_edits", "ran_tests", "tests_passed", "finished_without_testing", "finished_on_red",
    "hit_resource_limit", "catastrophic_edit", "verified_without_editing", "step_count", "n_repeated_commands",
    "n_error_fingerprints", "n_infra_fps", "n_env_fps", "n_tool_fps", "unique_files_opened",
    "assertion_after_edit", "narrow_file_search",
]


def with_gold(cards: DataFrame, gold: DataFrame) -> DataFrame:
    """``true_label``: the human label where there is one, else the card's category, else OTHER."""
    human = gold.select("run_id", F.col("true_category").alias("_gold"))
    return cards.join(human, "run_id", "left").withColumn(
        "true_label", F.coalesce("_gold", "primary_category", F.lit("OTHER"))
    ).drop("_gold")


def features(signals: DataFrame, *keep: str) -> DataFrame:
    """The 18 numeric features of each run."""
    return signals.select(*keep, *[F.coalesce(F.col(f).cast("int"), F.lit(0)).alias(f) for f in FEATURES])


def class_distribution(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("true_label").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "true_label")


def fit_tree(labelled: DataFrame, depth: int = TREE_DEPTH, min_support: int = MIN_SUPPORT):
    """Fit a decision tree on ``FEATURES`` and ``true_label``; returns (model, labels, scored frame with
    ``leaf`` and ``prediction``)."""
    index = StringIndexer(inputCol="true_label", outputCol="label", stringOrderType="alphabetAsc").fit(labelled)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(index.transform(labelled))
    tree = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=min_support, seed=SEED, leafCol="leaf").fit(rows)
    return tree, index.labels, tree.transform(rows)


def training_accuracy(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 4).alias("accuracy")
    )


_CONDITION = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>|in|not in) (.+)\)$")


def leaf_paths(tree) -> list[str]:
    """The conditions that lead to each leaf, in the tree's own leaf order (at most 2^depth leaves)."""
    paths, stack = [], []
    for line in tree.toDebugString.splitlines()[1:]:
        found = _CONDITION.match(line)
        if found:
            depth = len(found[1])
            while stack and stack[-1][0] >= depth:
                stack.pop()
            stack.append((depth, f"{FEATURES[int(found[3])]} {found[4]} {float(found[5]):.1f}"))
        elif "Predict:" in line:
            depth = len(line) - len(line.lstrip())
            while stack and stack[-1][0] >= depth:
                stack.pop()
            paths.append(" AND ".join(condition for _, condition in stack) or "(root)")
    return paths


def tree_rules(labelled: DataFrame, min_precision: float = MIN_PRECISION, min_support: int = MIN_SUPPORT, depth: int = TREE_DEPTH) -> DataFrame:
    """Leaves that are precise enough, as rules ``label, precision, support, rule``, best first."""
    tree, labels, scored = fit_tree(labelled, depth, min_support)
    per_label = scored.groupBy("leaf", "label").agg(F.count("*").alias("n"))
    leaves = per_label.groupBy("leaf").agg(
        F.sum("n").alias("support"), F.max(F.struct("n", (-F.col("label")).alias("_l"))).alias("best")
    )
    names = F.array(*[F.lit(x) for x in labels])
    paths = F.array(*[F.lit(p) for p in leaf_paths(tree)])
    rules = leaves.select(
        names[(-F.col("best._l")).cast("int")].alias("label"),
        (F.col("best.n") / F.col("support")).alias("precision"), "support", paths[F.col("leaf").cast("int")].alias("rule"),
    )
    kept = rules.filter((F.col("precision") >= min_precision) & (F.col("support") >= min_support))
    return kept.withColumn("precision", F.round("precision", 3)).orderBy(F.desc("precision"), F.desc("support"), "rule")


#: The boolean signals; conjunctions are mined over all of them unless others are named.
FLAGS = [
    "produced_patch", "no_file_edits", "ran_tests", "tests_passed", "finished_without_testing", "finished_on_red",
    "hit_resource_limit", "catastrophic_edit", "verified_without_editing", "assertion_after_edit", "narrow_file_search",
]


def conjunction_rules(
    labelled: DataFrame, flags: list[str] | None = None, min_precision: float = MIN_PRECISION,
    min_support: int = MIN_SUPPORT, label: str = "true_label",
) -> DataFrame:
    """Every conjunction of ``flags`` (all boolean signals) that is precise enough for one label: the flags that
    take part are 0 or 1, the others null; the empty conjunction counts too. A null flag is 0.

    Conjunctions are the frequent sets of items ``flag=value`` and the label, grown level by level from sets that
    are frequent themselves, so sets that no ``min_support`` rows share are never built. ``min_precision`` must be
    above one half, so that a conjunction has one label at most.
    """
    flags = flags or FLAGS
    if min_precision <= 0.5:
        raise ValueError("a precision of one half or less does not single out a label")
    shown = [F.concat(F.lit(f"{f}="), F.coalesce(F.col(f).cast("int"), F.lit(0)).cast("string")) for f in flags]
    rows = labelled.filter(F.col(label).isNotNull()).select(F.array(*shown, F.concat(F.lit(_LABEL), F.col(label))).alias("items"))
    rows = cut_lineage(rows)
    n = rows.count()
    if n < min_support:
        return rows.sparkSession.createDataFrame(
            [], ", ".join(f"{f} int" for f in flags) + ", label string, precision double, support bigint")
    # A label's rows in a rule are at least as many as this, and so are the rule's own.
    least = min(min_support, math.ceil(min_precision * min_support))
    found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n).fit(rows).freqItemsets
    whole = rows.groupBy(F.array().cast("array<string>").alias("items")).agg(F.count("*").alias("freq"))
    sets = found.unionByName(whole).select(
        F.array_sort(F.filter("items", lambda i: ~i.startswith(_LABEL))).alias("body"),
        F.get(F.filter("items", lambda i: i.startswith(_LABEL)), 0).alias("label"), "freq")
    rules = sets.groupBy("body").agg(
        F.max(F.when(F.col("label").isNull(), F.col("freq"))).alias("support"),
        F.max(F.when(F.col("label").isNotNull(), F.col("freq"))).alias("hits"),
        F.max_by("label", F.when(F.col("label").isNotNull(), F.col("freq"))).alias("label"),
    )
    precision = F.col("hits") / F.col("support")
    kept = rules.filter((F.col("support") >= min_support) & (precision >= min_precision))
    values = [F.when(F.array_contains("body", f"{f}=1"), 1).when(F.array_contains("body", f"{f}=0"), 0).alias(f) for f in flags]
    return kept.select(*values, F.substring("label", len(_LABEL) + 1, 1 << 30).alias("label"), F.round(precision, 4).alias("precision"), "support")


_LABEL = "label="
