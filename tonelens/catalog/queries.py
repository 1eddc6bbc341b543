"""One function per query: ``(spark, sf_dir) -> DataFrame``.  Each runs over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tonelens.catalog.lexicons import CONVERSATIONS, DOCUMENTS, GUIDANCE, STOP_WORDS
from tonelens.functions import scores as S
from tonelens.functions.sql import register_functions
from tonelens.functions.text import clean_text, word_tokens
from tonelens.operators.lexicon import Lexicon
from tonelens.operators import cleaning, conversation, experiments, leakage, messages, metrics, models, profiling, requests, sampling, tfidf
from tonelens.plans.workdir import materialise
from tonelens.sources import artifacts
from tonelens.sources import corpus as files
from tonelens.sources.samples import with_extra
from tonelens.sources.tables import read_table
from tonelens.streaming import accounting
from tonelens.streaming import conversations as stream_conversations
from tonelens.streaming import messages as stream_messages
from tonelens.streaming import windows as stream_windows
from tonelens.streaming.sinks import read_file_stream, run_to_table
from tonelens.plans.workdir import work_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet")


def r6(name: str) -> F.Column:
    return F.round(F.col(name).cast("double"), 6).alias(name)


# -- shared inputs ----------------------------------------------------------------------------------------------

def raw_labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their toxic label, null where there is none."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Raw labelled rows ``(row_id, text, label)``, not cleaned."""
    return cleaning.to_labelled(raw_labelled(spark, sf), "text", "toxic", "doc_id")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.prepare_corpus(raw_labelled(spark, sf), "text", "toxic", "doc_id")


def with_model_prob(df: DataFrame) -> DataFrame:
    """A stand-in model probability; every fifth document has none and falls back to the rules."""
    return df.withColumn("p", F.when(F.col("doc_id") % 5 != 0, (F.col("n_chars") % 97) / 96.0))


def scored_documents(spark: SparkSession, sf: str) -> DataFrame:
    return messages.score_messages(table(spark, sf, "documents"), DOCUMENTS)


def binary_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with the lexicon's probability of a toxic text."""
    scored = messages.score_messages(labelled(spark, sf).withColumnRenamed("label", "truth"), DOCUMENTS)
    prob = F.round(1.0 - F.col("score_sincere"), 4)
    return scored.select("row_id", "text", F.col("truth").alias("label"), prob.alias("prob")).withColumn(
        "prediction", S.threshold_label(F.col("prob"))
    )


def four_class(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with a four-label truth derived from toxic and quality, and the lexicon's label."""
    truth = (
        F.when((F.col("toxic") == 1) & (F.col("quality") == 0), 3)
        .when(F.col("toxic") == 1, 2)
        .when(F.col("quality") == 0, 1)
        .otherwise(0)
    )
    labels = table(spark, sf, "labels").select("doc_id", truth.alias("true_id"))
    joined = table(spark, sf, "documents").select("doc_id", "text").join(labels, "doc_id")
    return metrics.with_label_names(messages.score_messages(joined, DOCUMENTS), "true_id", "truth")


def guidance(spark: SparkSession) -> DataFrame:
    rows = [(label, *found) for label, found in GUIDANCE.items()]
    return spark.createDataFrame(rows, "label string, sanity_check string, coping_strategies array<string>, suggested_responses array<string>")


# -- preparation ------------------------------------------------------------------------------------------------

@query
def clean_corpus(spark, sf):
    """Class balance of the prepared corpus."""
    return profiling.class_balance(corpus(spark, sf)).select("label", "n", r6("share"))


@query
def prepared_corpus(spark, sf):
    return corpus(spark, sf)


@query
def clean_urls(spark, sf):
    pages = table(spark, sf, "pages")
    both = pages.select("page_id", F.lit("url").alias("part"), F.col("url").alias("text")).unionByName(
        pages.select("page_id", F.lit("html").alias("part"), F.col("html").alias("text"))
    )
    kept = cleaning.drop_empty(cleaning.clean(both))
    return kept.groupBy("part").agg(
        F.count("*").alias("n"), F.countDistinct("text").alias("n_texts"), F.sum(F.length("text")).alias("n_chars")
    )


@query
def clean_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", clean_text(F.col("text")).alias("text"))


# -- profile ----------------------------------------------------------------------------------------------------

@query
def class_balance(spark, sf):
    return profiling.class_balance(labelled(spark, sf)).select("label", "n", r6("share"))


@query
def corpus_summary(spark, sf):
    out = profiling.corpus_summary(labelled(spark, sf))
    return out.select("label", "n", r6("mean_words"), "total", r6("percent"), "duplicates")


@query
def duplicate_count(spark, sf):
    return cleaning.duplicate_count(table(spark, sf, "documents"))


@query
def length_stats(spark, sf):
    return profiling.length_stats(labelled(spark, sf)).select("label", r6("mean_words"), r6("mean_chars"))


@query
def length_histogram(spark, sf):
    out = profiling.length_histogram(labelled(spark, sf))
    return out.select("label", "measure", "bin", r6("bin_start"), r6("bin_end"), "n")


@query
def top_unigrams(spark, sf):
    return profiling.top_ngrams(labelled(spark, sf), STOP_WORDS, 1, 20)


@query
def top_bigrams(spark, sf):
    return profiling.top_ngrams(labelled(spark, sf), STOP_WORDS, 2, 15)


@query
def term_frequency(spark, sf):
    """Counts of every content word of all documents."""
    return profiling.term_frequency(table(spark, sf, "documents"), STOP_WORDS, 1)


# -- splits and samples -----------------------------------------------------------------------------------------

@query
def stratified_split(spark, sf):
    return sampling.three_way_split(table(spark, sf, "labels").select("doc_id", "toxic"), label="toxic", key="doc_id")


@query
def document_split(spark, sf):
    """All documents, stratified by language."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return sampling.three_way_split(docs, label="lang", key="doc_id")


@query
def stratified_subsample(spark, sf):
    return sampling.stratified_subsample(
        table(spark, sf, "labels").select("doc_id", "toxic"), 0.3, label="toxic", key="doc_id"
    )


@query
def kfold_assignment(spark, sf):
    return sampling.stratified_folds(table(spark, sf, "labels").select("doc_id", "toxic"), 5, label="toxic", key="doc_id")


def four_label_corpus(spark, sf):
    """Documents recoded into the label space, and conversation turns by role."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    recoded = sampling.recode_binary(docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("row_id"), F.col("toxic").alias("label")))
    turns = table(spark, sf, "conversations").select(
        F.concat_ws("-", F.lit("c"), F.col("conv_id"), F.col("turn")).alias("row_id"),
        F.when(F.col("role") == "user", 2).otherwise(3).alias("label"),
    )
    return sampling.union_corpora(recoded, turns)


@query
def balanced_cap(spark, sf):
    return sampling.balanced_sample(four_label_corpus(spark, sf))


@query
def trial_rows(spark, sf):
    return sampling.first_rows(four_label_corpus(spark, sf), 64)


# -- leakage ----------------------------------------------------------------------------------------------------

@query
def leakage_audit(spark, sf):
    """Per benchmark item: how many of its shingles the documents contain."""
    return leakage.quoted_passages(table(spark, sf, "benchmark"), "item_id", table(spark, sf, "documents"), "doc_id")


@query
def leakage_by_document(spark, sf):
    return leakage.shared_shingles(table(spark, sf, "documents"), "doc_id", table(spark, sf, "benchmark"), "item_id")


@query
def leakage_free(spark, sf):
    docs = table(spark, sf, "documents")
    return leakage.without_quotes(docs, "doc_id", table(spark, sf, "benchmark"), "item_id").select("doc_id", "source")


def _held_out_languages(spark, sf):
    docs = table(spark, sf, "documents")
    split = sampling.stratified_split(docs.select("doc_id", "lang", "text"), 0.15, label="lang", key="doc_id")
    return split.filter("held_out"), split.filter(~F.col("held_out"))


@query
def leakage_exact(spark, sf):
    """Held-out documents whose cleaned text is in the rest of the corpus."""
    held_out, train = _held_out_languages(spark, sf)
    return leakage.exact_leaks(held_out, train).select("doc_id", "lang")


@query
def leakage_exact_clean(spark, sf):
    held_out, train = _held_out_languages(spark, sf)
    return leakage.exact_clean(held_out, train).select("doc_id", "lang")


# -- features ---------------------------------------------------------------------------------------------------

@query
def tfidf_vocabulary(spark, sf):
    vocabulary = tfidf.fit_vocabulary(table(spark, sf, "documents"))
    return vocabulary.select("term", F.col("idx").cast("long").alias("idx"), "tf", "df", r6("idf"))


@query
def tfidf_vocabulary_capped(spark, sf):
    """A cap that falls among terms of one frequency."""
    vocabulary = tfidf.fit_vocabulary(table(spark, sf, "documents"), max_features=500)
    return vocabulary.select("term", F.col("idx").cast("long").alias("idx"), "tf", "df", r6("idf"))


@query
def tfidf_weights(spark, sf):
    docs = table(spark, sf, "documents")
    vocabulary = tfidf.fit_vocabulary(docs)
    return tfidf.transform_long(docs, vocabulary, key="doc_id").select("doc_id", "term", r6("weight"))


# -- evaluation -------------------------------------------------------------------------------------------------

@query
def majority_baseline(spark, sf):
    """Majority class of the labels and the metrics of predicting it everywhere."""
    rows = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = models.MajorityModel.fit(rows)
    out = metrics.evaluate_binary(model.transform(rows))
    return out.select(
        F.lit(model.majority).alias("majority"), "n", *[r6(m) for m in metrics.METRICS]
    )


@query
def class_weights(spark, sf):
    return models.class_weights(table(spark, sf, "labels"), "toxic").select("toxic", "n", r6("weight"))


@query
def binary_metrics(spark, sf):
    out = metrics.binary_metrics(binary_scored(spark, sf))
    return out.select("n", r6("accuracy"), r6("precision"), r6("recall"), r6("f1"))


@query
def roc_auc(spark, sf):
    return metrics.roc_auc(binary_scored(spark, sf)).select(r6("auc"))


@query
def roc_auc_events(spark, sf):
    """AUC of an event's value as a score for errors: many distinct scores."""
    events = table(spark, sf, "events").select((F.col("event_type") == "error").cast("int").alias("label"), F.col("value").alias("prob"))
    return metrics.roc_auc(events).select(r6("auc"))


@query
def confusion_matrix(spark, sf):
    out = metrics.confusion_matrix(four_class(spark, sf), "truth", "label")
    return out.select(
        F.col("label_no").cast("long").alias("label_no"),
        "true_label",
        F.col("pred_Sincere").alias("pred_sincere"),
        F.col("pred_Sarcastic").alias("pred_sarcastic"),
        F.col("`pred_Passive-Aggressive`").alias("pred_passive"),
        F.col("pred_Gaslighting").alias("pred_gaslighting"),
    )


@query
def per_class_report(spark, sf):
    out = metrics.per_class_report(four_class(spark, sf), "truth", "label")
    return out.select("label", r6("precision"), r6("recall"), r6("f1"), "support", "weak")


@query
def report_summary(spark, sf):
    out = metrics.report_summary(four_class(spark, sf), "truth", "label")
    return out.select(r6("accuracy"), r6("macro_precision"), r6("macro_recall"), r6("macro_f1"), "support")


@query
def per_example(spark, sf):
    return metrics.per_example(four_class(spark, sf), "text", "truth", "label", "confidence")


@query
def error_table(spark, sf):
    out = metrics.error_table(binary_scored(spark, sf), 5)
    return out.select("row_id", "text", "true_label", "predicted_label", r6("confidence"))


def _expectations(spark, sf):
    own = four_class(spark, sf).select("text", F.col("truth").alias("expected"))
    extra = table(spark, sf, "conversations").select("text", F.lit("Sincere").alias("expected"))
    return messages.score_messages(with_extra(own, extra), DOCUMENTS)


@query
def stress_eval(spark, sf):
    out = metrics.pass_rate(_expectations(spark, sf), "expected", "label")
    return out.select("total", "correct", r6("accuracy"), "verdict")


@query
def stress_results(spark, sf):
    results = metrics.stress_results(_expectations(spark, sf))
    return results.groupBy("expected", "predicted", "passed").agg(
        F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence")
    )


@query
def model_comparison(spark, sf):
    """Three scorers of the labelled documents: the majority class, the lexicon, the text length."""
    base = materialise(binary_scored(spark, sf), "scored")
    majority = models.MajorityModel.fit(base)
    by_length = base.withColumn("prob", F.least(F.length("text") / 5000.0, F.lit(1.0))).withColumn(
        "prediction", S.threshold_label(F.col("prob"))
    )
    out = metrics.model_comparison({"majority": majority.transform(base), "lexicon": base, "length": by_length})
    return out.select("model", *[r6(m) for m in metrics.METRICS])


# -- lexicon scoring --------------------------------------------------------------------------------------------

@query
def pattern_scores(spark, sf):
    out = messages.pattern_scores(table(spark, sf, "documents"), DOCUMENTS)
    return out.select("doc_id", r6("gl_pattern"), r6("pa_pattern"), r6("sa_pattern"))


_KEYWORD_COLS = ["gl_keywords", "pa_keywords", "sa_keywords", "si_keywords"]


@query
def keyword_scores(spark, sf):
    out = scored_documents(spark, sf)
    hits = [F.col(c).cast("long").alias(c) for c in _KEYWORD_COLS]
    return out.select("doc_id", *hits, *S.SCORE_COLS.values())


@query
def keyword_scores_indexed(spark, sf):
    """The same hits by the index that serves long keyword lists."""
    out = messages.keyword_hits_indexed(table(spark, sf, "documents"), DOCUMENTS, "doc_id")
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in _KEYWORD_COLS])


def _large_lexicon(spark, sf) -> Lexicon:
    """5 000 of the documents' own words as keywords, dealt to three labels by the number of documents they are in."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    counts = table(spark, sf, "documents").select(F.explode(words).alias("w")).filter(F.length("w") > 5).groupBy("w").agg(F.count("*").alias("n"))
    chosen = counts.orderBy(F.md5("w"), "w").limit(5000).collect()
    sides = ("Gaslighting", "Passive-Aggressive", "Sarcastic")
    return Lexicon(keywords={l: sorted(r["w"] for r in chosen if r["n"] % 3 == i) for i, l in enumerate(sides)})


@query
def keyword_scores_large(spark, sf):
    """Hits of a lexicon of 5 000 keywords, by the index."""
    out = messages.keyword_hits_indexed(table(spark, sf, "documents"), _large_lexicon(spark, sf), "doc_id")
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in _KEYWORD_COLS[:3]])


@query
def pattern_scores_table(spark, sf):
    """Shares of 5 000 patterns, two endings of the documents' own words, from a lexicon that is a table."""
    words = _large_lexicon(spark, sf).to_dataframe(spark).filter("kind = 'keyword'")
    ended = F.concat(F.lit("(?:^|[^a-z])"), F.col("pattern"), F.lit("(?:s|ed)?(?:$|[^a-z])"))
    lexicon = Lexicon.from_dataframe(words.select("label", F.lit("regex").alias("kind"), "ord", ended.alias("pattern")))
    out = messages.pattern_scores_indexed(table(spark, sf, "documents"), lexicon)
    return out.select("doc_id", r6("gl_pattern"), r6("pa_pattern"), r6("sa_pattern"))


@query
def fused_scores(spark, sf):
    docs = with_model_prob(table(spark, sf, "documents"))
    out = messages.score_messages(docs, DOCUMENTS, prob="p")
    return out.select("doc_id", "method", *S.SCORE_COLS.values(), "label", "confidence", "severity")


@query
def ranked_scores(spark, sf):
    out = messages.ranked_scores(scored_documents(spark, sf), ["doc_id"])
    return out.withColumn("rank", F.col("rank").cast("long"))


@query
def message_analysis(spark, sf):
    out = messages.analyse_messages(table(spark, sf, "documents"), DOCUMENTS, guidance=guidance(spark))
    return out.select(
        "doc_id", "label", "confidence", "severity", *S.SCORE_COLS.values(),
        F.concat_ws("|", "pattern_highlights").alias("highlights"),
        "sanity_check",
        F.concat_ws("|", "coping_strategies").alias("coping"),
        F.concat_ws("|", "suggested_responses").alias("responses"),
    )


@query
def request_quarantine(spark, sf):
    checked = requests.check_messages(table(spark, sf, "documents"))
    return checked.groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("outcome")).agg(
        F.count("*").alias("n"), F.sum("doc_id").alias("id_sum")
    )


@query
def conversation_requests(spark, sf):
    """Documents as messages, their source as the conversation: all conversations are over the limit but short ones."""
    docs = table(spark, sf, "documents").select(F.col("source").alias("conv_id"), "text")
    turns = table(spark, sf, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("conv_id"), "text")
    return requests.check_conversations(docs.unionByName(turns))


@query
def prediction_display(spark, sf):
    """Polarity, confidence and percent text for the stand-in probability, else for the lexicon's."""
    docs = with_model_prob(table(spark, sf, "documents"))
    own = docs.filter(F.col("p").isNotNull()).select("doc_id", F.col("p").alias("prob"))
    lexicon = scored_documents(spark, sf).select("doc_id", F.round(1.0 - F.col("score_sincere"), 4).alias("prob"))
    best = messages.best_available(docs.select("doc_id"), {"model": own, "lexicon": lexicon}, "doc_id")
    out = messages.predicted_polarity(best)
    return out.select("doc_id", "model_used", "polarity", r6("confidence"), "confidence_text", "prob_4")


# -- conversations ----------------------------------------------------------------------------------------------

_VERDICT = [
    "n_sincere", "n_sarcastic", "n_passive", "n_gaslighting", "n_window", "n_toxic", "pattern_detected",
    "dominant_pattern", "escalation_detected", "overall_severity", "context_note", "banner",
]


@query
def conversation_audit(spark, sf):
    out = conversation.audit_conversations(table(spark, sf, "conversations"), CONVERSATIONS, guidance=guidance(spark))
    return out.select("conv_id", *_VERDICT, "sanity_check")


@query
def conversation_results(spark, sf):
    """The analysed messages inside the audit, one row each."""
    out = conversation.audit_conversations(table(spark, sf, "conversations"), CONVERSATIONS, results=True)
    return out.select("conv_id", F.inline("individual_results")).select(
        "conv_id", "turn", "message", "label", "confidence", "all_scores.score_gaslighting", "severity",
        F.concat_ws("|", "pattern_highlights").alias("highlights"),
    )


@query
def rolling_audit(spark, sf):
    out = conversation.rolling_audit(table(spark, sf, "conversations"), CONVERSATIONS)
    return out.select("conv_id", "turn", "label", *_VERDICT)


@query
def rolling_audit_by_source(spark, sf):
    """Twenty long conversations (all documents of a source), cut into chunks of 250 turn numbers."""
    docs = table(spark, sf, "documents").select(F.col("source").alias("conv_id"), F.col("doc_id").alias("turn"), "text")
    out = conversation.rolling_audit(docs, DOCUMENTS, chunk_turns=250)
    return out.select("conv_id", "turn", "label", *_VERDICT)


# -- vectors ----------------------------------------------------------------------------------------------------

@query
def softmax_argmax(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return vectors.withColumn("p", S.softmax(F.col("x"))).select(
        "vec_id",
        S.argmax(F.col("x")).cast("long").alias("top"),
        F.round(F.array_max("p"), 6).alias("top_prob"),
        F.round(F.get("p", F.lit(0)), 6).alias("first_prob"),
    )


# -- learning ---------------------------------------------------------------------------------------------------

def features(spark, sf):
    """Split the prepared corpus, fit on train, store the features of every split."""
    prepared = materialise(corpus(spark, sf), "corpus")
    split = sampling.three_way_split(prepared)
    return models.build_features(split)


@query
def lr_fit_predict(spark, sf):
    fitted = features(spark, sf)
    classifier = models.TextClassifier.fit(fitted.split("train"), grid_c=[1.0], grid_penalty=["l2"])
    return classifier.transform(fitted.split("test")).select("row_id", "label", "prediction", "prob")


@query
def lr_grid(spark, sf):
    fitted = features(spark, sf)
    classifier = models.TextClassifier.fit(fitted.split("train"))
    return spark.createDataFrame([(classifier.params["C"], classifier.params["penalty"], classifier.params["cv_f1"])], "c double, penalty string, cv_f1 double")


@query
def lr_top_features(spark, sf):
    fitted = features(spark, sf)
    classifier = models.TextClassifier.fit(fitted.split("train"), grid_c=[1.0], grid_penalty=["l2"])
    return classifier.top_features(fitted.vocabulary)


@query
def lr_round_trip(spark, sf):
    """Per penalty: for how many rows a classifier that was stored and loaded predicts what the fitted one does."""
    fitted, rows = features(spark, sf), []
    for penalty in ("l1", "l2"):
        classifier = models.TextClassifier.fit(fitted.split("train"), grid_c=[1.0], grid_penalty=[penalty])
        path = work_path(spark, "classifier")
        classifier.save(spark, path)
        loaded = models.TextClassifier.load(spark, path)
        first, second = (m.transform(fitted.rows).select("row_id", F.struct("prediction", "prob").alias(name)) for m, name in ((classifier, "p"), (loaded, "q")))
        same = first.join(second, "row_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("p") == F.col("q")).alias("n_same"))
        rows.append(same.select(F.lit(penalty).alias("penalty"), "n_rows", "n_same"))
    return rows[0].union(rows[1])


@query
def lr_certificate(spark, sf):
    """Per penalty: how far the fit is from its optimum, next to the gradient it began with."""
    train, rows = features(spark, sf).split("train"), []
    for penalty in ("l1", "l2"):
        classifier = models.TextClassifier.fit(train, grid_c=[1.0], grid_penalty=[penalty])
        rows.append(models.optimality(classifier, train).select(F.lit(penalty).alias("penalty"), "violation", "start"))
    return rows[0].union(rows[1])


@query
def train_all(spark, sf):
    return experiments.train_all(features(spark, sf)).comparison


@query
def learning_curve(spark, sf):
    return experiments.learning_curve(features(spark, sf))


def _length_scorer():
    """A stand-in for an external model: a logistic curve over the text length."""
    import numpy as np

    def predict(texts):
        return np.array([1.0 / (1.0 + np.exp(-(len(t) - 1500) / 1000.0)) for t in texts])

    return predict


@query
def batch_model_scores(spark, sf):
    out = models.score_text(table(spark, sf, "documents"), _length_scorer)
    return out.select("doc_id", r6("prob"))


def _length_logits():
    """A stand-in for an external model of three classes."""
    import numpy as np

    def predict(texts):
        n = np.array([len(t) for t in texts]) / 1000.0
        return np.stack([2.0 - n, n, 3.0 * n - 4.0], axis=1)

    return predict


@query
def logit_scores(spark, sf):
    """Logits of a caller's model, their softmax and its largest class."""
    out = models.score_logits(table(spark, sf, "documents"), _length_logits, 3).withColumn("p", S.softmax(F.col("logits")))
    return out.select("doc_id", S.argmax(F.col("logits")).cast("long").alias("top"), F.round(F.array_max("p"), 6).alias("top_prob"))


# -- sources and sinks: written by the library, read back by it ---------------------------------------------------

@query
def io_jsonl(spark, sf):
    """Labelled documents as JSON Lines."""
    path = work_path(spark, "jsonl")
    rows = labelled(spark, sf).select(F.col("text").alias("headline"), F.col("label").alias("is_sarcastic"), F.col("row_id").cast("string").alias("article_link"))
    rows.write.json(path)
    return files.read_jsonl(spark, path)


@query
def io_splits(spark, sf):
    """The prepared corpus in three folders."""
    path = work_path(spark, "splits")
    third = F.col("row_id") % 3
    files.write_splits(corpus(spark, sf).withColumn("split", F.when(third == 0, "train").when(third == 1, "val").otherwise("test")), path)
    parts = [df.withColumn("split", F.lit(name)) for name, df in files.read_splits(spark, path).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def io_features(spark, sf):
    """Stored feature vectors of a small vocabulary, in long form again."""
    path = work_path(spark, "features")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    vocabulary = tfidf.fit_vocabulary(docs, max_features=500)
    tfidf.write_features(tfidf.with_features(docs, vocabulary).drop("text"), path)
    rows = tfidf.read_features(spark, path, [docs.schema["doc_id"]]).withColumn("v", F.unwrap_udt("features"))
    long = rows.select("doc_id", F.inline(F.arrays_zip(F.col("v.indices").alias("idx"), F.col("v.values").alias("weight"))))
    return long.join(vocabulary.select("idx", "term"), "idx").select("doc_id", "term", r6("weight"))


@query
def io_comparison(spark, sf):
    path = work_path(spark, "comparison")
    artifacts.write_comparison(model_comparison(spark, sf), path)
    return artifacts.read_comparison(spark, path)


@query
def io_report(spark, sf):
    """The per-class table of a stored evaluation report."""
    path = work_path(spark, "report")
    report = metrics.evaluation_report(four_class(spark, sf), "text", "truth", "label", "confidence")
    artifacts.write_report(report, path)
    schema = "label string, precision double, recall double, f1 double, support long, weak boolean"
    out = artifacts.read_report(spark, path, {"per_class": schema})["per_class"]
    return out.select("label", r6("precision"), r6("recall"), r6("f1"), "support", "weak")


@query
def io_errors(spark, sf):
    path = work_path(spark, "errors")
    artifacts.write_table(error_table(spark, sf), path)
    return artifacts.read_table(spark, path, "row_id long, text string, true_label int, predicted_label int, confidence double")


@query
def io_majority(spark, sf):
    """A stored majority model, applied."""
    path = work_path(spark, "majority")
    rows = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    models.MajorityModel.fit(rows).save(spark, path)
    return models.MajorityModel.load(spark, path).transform(rows).select("doc_id", "label", "prediction", "prob")


@query
def missing_texts(spark, sf):
    """Every seventh text is taken away and counts as an empty one."""
    docs = table(spark, sf, "documents").withColumn("text", F.when(F.col("doc_id") % 7 != 0, F.col("text")))
    return cleaning.fill_missing_text(docs).select("doc_id", F.length("text").cast("long").alias("n"))


@query
def top_coefficients(spark, sf):
    """Words by the difference of their shares of toxic and of other documents."""
    rows = labelled(spark, sf).select("label", F.explode(F.array_distinct(word_tokens(F.col("text")))).alias("term"))
    counts = rows.groupBy("term").agg(F.count_if(F.col("label") == 1).alias("t"), F.count_if(F.col("label") != 1).alias("o"))
    sizes = labelled(spark, sf).agg(F.count_if(F.col("label") == 1).alias("nt"), F.count_if(F.col("label") != 1).alias("no")).first()
    share = F.round(F.col("t") / F.lit(float(sizes["nt"])) - F.col("o") / F.lit(float(sizes["no"])), 6)
    return models.top_coefficients(counts.select("term", share.alias("coefficient"))).withColumn("rank", F.col("rank").cast("long"))


@query
def sql_functions(spark, sf):
    """The scoring expressions as SQL functions."""
    register_functions(spark, DOCUMENTS)
    table(spark, sf, "documents").createOrReplaceTempView("sql_function_documents")
    return spark.sql("""
        SELECT doc_id, cleaned, round(s.passive_aggressive_patterns, 6) AS pa_pattern, CAST(s.sincere_keywords AS BIGINT) AS si_keywords,
          s.sincere AS score_sincere, s.gaslighting AS score_gaslighting, severity(0.5D, 'Sarcastic') AS mid
        FROM (SELECT doc_id, clean_text(text) AS cleaned, message_scores(text) AS s FROM sql_function_documents)""")


@query
def gappy_metrics(spark, sf):
    """Every third labelled row lost its score."""
    rows = binary_scored(spark, sf)
    there = F.col("row_id") % 3 != 0
    gappy = rows.withColumns({c: F.when(there, F.col(c)) for c in ("prob", "prediction")})
    out = metrics.evaluate_binary(gappy)
    return out.select("n", "n_scored", *[r6(m) for m in metrics.METRICS])


@query
def external_model(spark, sf):
    """A caller's probabilities for two thirds of the labelled rows, next to all of them."""
    rows = labelled(spark, sf)
    given = rows.filter(F.col("row_id") % 3 != 0).select("row_id", F.least(F.length("text") / 5000.0, F.lit(1.0)).alias("prob"))
    out = metrics.binary_metrics(experiments.external_predictions(rows, given))
    return out.select("n", "n_scored", r6("accuracy"), r6("precision"), r6("recall"), r6("f1"))


# -- streams ----------------------------------------------------------------------------------------------------

_TURNS = "conv_id long, turn long, role string, text string"
_EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
_DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@query
def stream_message_scores(spark, sf):
    """Documents as a message stream into two sinks; the result reads both back."""
    out = work_path(spark, "stream-scores")
    stream = read_file_stream(spark, sf, _DOCS, "documents.parquet").select("doc_id", "text")
    running = stream_messages.start_scoring(stream, f"{out}/good", f"{out}/bad", f"{out}/checkpoint", DOCUMENTS, availableNow=True)
    running.awaitTermination()
    good = spark.read.parquet(f"{out}/good").select("doc_id", F.lit("ok").alias("outcome"), "label", "confidence")
    bad = spark.read.parquet(f"{out}/bad").select(
        "doc_id", F.col("reject_reason").alias("outcome"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("confidence")
    )
    return good.unionByName(bad)


@query
def stream_accounts(spark, sf):
    """Where the messages of the document stream went, from the query's progress."""
    out = work_path(spark, "stream-accounts")
    stream = read_file_stream(spark, sf, _DOCS, "documents.parquet").select("doc_id", "text")
    running = stream_messages.start_scoring(stream, f"{out}/good", f"{out}/bad", f"{out}/checkpoint", DOCUMENTS, availableNow=True)
    running.awaitTermination()
    return accounting.account_table(spark, running, stream_messages.ACCOUNT)


@query
def stream_conversation_audit(spark, sf):
    turns = read_file_stream(spark, sf, _TURNS, "conversations.parquet")
    timed = turns.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn") * 10))
    audited = stream_conversations.audit_stream(timed, CONVERSATIONS)
    return run_to_table(audited, "stream-audit").select("conv_id", "turn", "label", *_VERDICT)


@query
def stream_audit_by_source(spark, sf):
    """Twenty long conversations (all documents of a source) through the streaming audit."""
    docs = read_file_stream(spark, sf, _DOCS, "documents.parquet")
    turns = docs.select(
        F.col("source").alias("conv_id"), F.col("doc_id").alias("turn"), "text", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 10).alias("ts")
    )
    audited = stream_conversations.audit_stream(turns, DOCUMENTS)
    return run_to_table(audited, "stream-sources").select("conv_id", "turn", "label", *_VERDICT)


def _event_stream(spark, sf):
    return read_file_stream(spark, sf, _EVENTS, "events.parquet").select("ts", "user_id", F.col("event_type").alias("label"))


def _as_text(name: str):
    """UTC text, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(name, F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias(name)


@query
def stream_label_windows(spark, sf):
    counts = stream_windows.tumbling_label_counts(_event_stream(spark, sf), "6 hours")
    return run_to_table(counts, "stream-tumbling").select(_as_text("window_start"), _as_text("window_end"), "label", "n")


@query
def stream_sliding_windows(spark, sf):
    counts = stream_windows.sliding_label_counts(_event_stream(spark, sf), "6 hours", "2 hours")
    return run_to_table(counts, "stream-sliding").select(_as_text("window_start"), _as_text("window_end"), "label", "n")


@query
def stream_session_windows(spark, sf):
    counts = stream_windows.session_label_counts(_event_stream(spark, sf), "12 hours", "user_id")
    return run_to_table(counts, "stream-session").select("user_id", _as_text("window_start"), "label", "n")
