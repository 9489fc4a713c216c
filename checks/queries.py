"""Queries over the given tables, one per operator."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.config import CasewiseError
from casewise.functions import labels
from casewise.functions import text as T
from casewise.functions.numbers import percent, round_exact
from casewise.operators import evaluate, hierarchy, profile, refine, routing, similar, split, tfidf
from casewise.operators.prepare import macro_table, modeling_table, prepare_texts, split_blank
from casewise.plans.eda import eda_report
from casewise.plans.scoring import score_batch
from casewise.plans.training import TrainingResult, train_job
from casewise.session import materialize, scratch_path
from casewise.sources import model_store
from casewise.sources import records as source
from casewise.streaming.scoring_stream import score_stream
from checks import data

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


# --- sources -------------------------------------------------------------------------------


@query("schema_check")
def _schema_check(spark, sf):
    return source.schema_check(data.records(spark, sf))


@query("dataset_summary")
def _dataset_summary(spark, sf):
    return source.dataset_summary(data.records(spark, sf))


@query("dataset_preview")
def _dataset_preview(spark, sf):
    return source.dataset_preview(data.records(spark, sf))


# --- text functions ------------------------------------------------------------------------


def _texts(spark, sf):
    return data.records(spark, sf).select("id_registro", "texto")


def _counted(df, tokens):
    return df.withColumn("_t", tokens).select(
        "id_registro", F.array_join("_t", " ").alias("tokens"), F.size("_t").cast("bigint").alias("n_tokens")
    )


@query("normalize_text")
def _normalize_text(spark, sf):
    return _texts(spark, sf).withColumn("texto", T.normalize_text(F.col("texto")))


@query("clean_whitespace")
def _clean_whitespace(spark, sf):
    return _texts(spark, sf).withColumn("texto", T.clean_whitespace(F.col("texto")))


@query("tokenize")
def _tokenize(spark, sf):
    return _counted(_texts(spark, sf), T.tokenize(F.col("texto")))


@query("strip_punct")
def _strip_punct(spark, sf):
    return _counted(_texts(spark, sf), T.strip_punctuation(T.tokenize(F.col("texto"))))


@query("remove_stopwords")
def _remove_stopwords(spark, sf):
    return _counted(_texts(spark, sf), T.remove_stopwords(T.lower_tokens(T.tokenize(F.col("texto")))))


@query("prepare_texts")
def _prepare_texts(spark, sf):
    prepared = prepare_texts(_texts(spark, sf))
    return prepared.select(
        "id_registro", "texto_original", "texto_processado", F.size("texto_tokens").cast("bigint").alias("n_tokens")
    )



@query("summarize_text")
def _summarize_text(spark, sf):
    text = F.col("texto")
    return _texts(spark, sf).select(
        "id_registro", T.summarize(text, 180).alias("resumo_180"), T.summarize(text, 220).alias("resumo_220")
    )


@query("reject_blank")
def _reject_blank(spark, sf):
    turns = data.table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.when(F.col("role") == "system", F.lit("  ")).otherwise(F.col("text")).alias("texto"),
    )
    valid, rejected = split_blank(turns)
    kept = valid.select("id", "texto", F.lit(None).cast("string").alias("reason"))
    return kept.unionByName(rejected.withColumn("texto", F.lit("")))


# --- filters -------------------------------------------------------------------------------


@query("modeling_table")
def _modeling_table(spark, sf):
    return modeling_table(data.records(spark, sf)).select(
        "id_registro", "classe_macro", "classe_detalhada", "texto_processado"
    )



@query("macro_table")
def _macro_table(spark, sf):
    return macro_table(data.records(spark, sf))



# --- profile -------------------------------------------------------------------------------


@query("text_stats")
def _text_stats(spark, sf):
    return profile.text_stats(data.records(spark, sf))


@query("dist_macro")
def _dist_macro(spark, sf):
    return profile.distribution(data.records(spark, sf), "classe_macro")


@query("dist_channel")
def _dist_channel(spark, sf):
    return profile.distribution(data.records(spark, sf), "canal_origem")


@query("dist_detailed_top")
def _dist_detailed_top(spark, sf):
    return profile.top_distribution(data.records(spark, sf), "classe_detalhada", 8)


@query("dist_detailed_labelled")
def _dist_detailed_labelled(spark, sf):
    return profile.top_distribution(data.records(spark, sf), "classe_detalhada", 10, missing=None)


@query("overview")
def _overview(spark, sf):
    return profile.overview(data.records(spark, sf))


@query("overview_landed")
def _overview_landed(spark, sf):
    """Three batches, one of them without a stored sketch; their labels are few, so the estimates are exact."""
    landing = scratch_path(spark, "landing")
    records = data.records(spark, sf)
    german, english = F.col("classe_macro") == "de", F.col("classe_macro") == "en"
    source.land_batch(records.where(german), landing, "upload", "1", sketch=True)
    source.land_batch(records.where(english), landing, "upload", "2")
    rest = ~F.coalesce(german | english, F.lit(False))
    source.land_batch(records.where(rest), landing, "upload", "3", sketch=True)
    return profile.landed_overview(spark, landing)


@query("text_metrics")
def _text_metrics(spark, sf):
    return profile.text_metrics(data.records(spark, sf))


@query("macro_profile")
def _macro_profile(spark, sf):
    return profile.macro_profile(data.records(spark, sf))


@query("hierarchy_summary")
def _hierarchy_summary(spark, sf):
    return profile.hierarchy_summary(data.records(spark, sf))


@query("examples_by_macro")
def _examples_by_macro(spark, sf):
    return profile.examples_by_macro(data.records(spark, sf)).withColumn("posicao", F.col("posicao").cast("bigint"))


@query("sample_by_macro")
def _sample_by_macro(spark, sf):
    return profile.sample_by_macro(data.records(spark, sf))


# --- features ------------------------------------------------------------------------------


def _tokens_for_vectors(spark, sf):
    prepared = prepare_texts(_texts(spark, sf))
    return prepared.select("id_registro", tfidf.vector_tokens(F.col("texto_processado")).alias("vt"))


@query("vector_tokens")
def _vector_tokens(spark, sf):
    return _counted(_tokens_for_vectors(spark, sf), F.col("vt"))


@query("ngrams")
def _ngrams(spark, sf):
    terms = _tokens_for_vectors(spark, sf).withColumn("t", tfidf.with_ngrams(F.col("vt")))
    return terms.select(
        "id_registro", F.array_join("t", "|").alias("terms"), F.size("t").cast("bigint").alias("n_terms")
    )


def _scoped_terms(spark, sf):
    usable = modeling_table(data.records(spark, sf)).select(
        F.col("id_registro").alias("id"),
        tfidf.macro_scope(F.col("classe_macro")).alias("scope"),
        "texto_processado",
    )
    return tfidf.with_terms(usable, "texto_processado").drop("texto_processado")


@query("vocabulary")
def _vocabulary(spark, sf):
    fitted = tfidf.fit_vocabulary(_scoped_terms(spark, sf), 5000, tfidf.EVERYTHING)
    return fitted.withColumns({"idf": round_exact(F.col("idf"), 6), "place": F.col("place").cast("bigint")})


@query("tfidf_weights")
def _tfidf_weights(spark, sf):
    docs = materialize(_scoped_terms(spark, sf), "terms")
    fitted = materialize(tfidf.fit_vocabulary(docs, 5000, tfidf.EVERYTHING), "vocabulary")
    both = docs.withColumn("scope", F.explode(F.array("scope", F.lit(tfidf.EVERYTHING))))
    weights = tfidf.explode_vectors(tfidf.vectorize(both, fitted))
    return weights.withColumns({"weight": round_exact(F.col("weight"), 6), "place": F.col("place").cast("bigint")})


@query("tfidf_plain")
def _tfidf_plain(spark, sf):
    texts = macro_table(data.records(spark, sf)).select(
        F.col("id_registro").alias("id"), F.lit(tfidf.EVERYTHING).alias("scope"), "texto"
    )
    docs = tfidf.with_terms(texts, "texto").drop("texto")
    fitted = materialize(tfidf.fit_vocabulary(docs, 5000), "vocabulary")
    weights = tfidf.explode_vectors(tfidf.vectorize(docs, fitted, sublinear=False))
    return weights.select("id", F.col("place").cast("bigint").alias("place"), round_exact(F.col("weight"), 6).alias("weight"))


# --- retrieval -----------------------------------------------------------------------------


@query("retrieval_scope")
def _retrieval_scope(spark, sf):
    queries = data.predicted_cases(spark, sf).select("id", "macro")
    return similar.retrieval_scope(queries, similar.known_macros(data.records(spark, sf)))


def _rank_as_long(cases):
    return cases.withColumn("rank", F.col("rank").cast("bigint"))


@query("tfidf_cosine")
def _tfidf_cosine(spark, sf):
    found = similar.similar_cases(
        data.predicted_cases(spark, sf), data.records(spark, sf), k=1, restrict_to_macro=False
    )
    return found.select("id", "history_id", "similarity")


@query("similar_topk")
def _similar_topk(spark, sf):
    return _rank_as_long(
        similar.similar_cases(data.predicted_cases(spark, sf), data.records(spark, sf), k=5, restrict_to_macro=False)
    )


@query("similar_cases")
def _similar_cases(spark, sf):
    return _rank_as_long(similar.similar_cases(data.predicted_cases(spark, sf), data.records(spark, sf)))


@query("few_shot_examples")
def _few_shot_examples(spark, sf):
    found = similar.few_shot_examples(QUERIES["similar_cases"](spark, sf))
    shown = F.transform(
        "few_shot_examples",
        lambda shot: F.concat_ws(
            "|",
            shot["rank"],
            shot["macro_class"],
            shot["detailed_class"],
            shot["priority"],
            shot["justification"],
            F.md5(shot["text"]),
        ),
    )
    return found.select("id", "scope", "used_count", F.array_join(shown, ";").alias("examples"))


@query("priority_history")
def _priority_history(spark, sf):
    text = F.coalesce("texto", F.lit(""))
    return data.records(spark, sf).select(
        "id_registro",
        labels.history_priority(text).alias("priority"),
        labels.history_priority(text, data.HIGH_TERMS, data.MEDIUM_TERMS).alias("priority_test_terms"),
    )


# --- split and evaluation ------------------------------------------------------------------


def _modeling(spark, sf):
    usable = modeling_table(data.records(spark, sf))
    return materialize(
        usable.select("id_registro", "classe_macro", "classe_detalhada", "texto_original", "texto_processado"),
        "modeling",
    )


def _split(spark, sf):
    return split.train_test_split(_modeling(spark, sf))


@query("stratified_split")
def _stratified_split(spark, sf):
    return _split(spark, sf).table.select("id_registro", "classe_macro", "split")


@query("split_guards")
def _split_guards(spark, sf):
    """What the guards say of the whole table and of each channel alone, many of which are small."""
    labelled = modeling_table(data.records(spark, sf)).select("canal_origem", "classe_macro")
    every = labelled.withColumn("canal_origem", F.lit("todos")).unionByName(labelled)
    sizes: dict[str, dict[str, int]] = {}
    for row in every.groupBy("canal_origem", "classe_macro").count().collect():
        sizes.setdefault(row["canal_origem"], {})[row["classe_macro"]] = row["count"]
    rows = []
    for channel, classes in sorted(sizes.items()):
        total = sum(classes.values())
        try:
            split.check_trainable(classes)
            outcome = split.stratification_warning(classes, math.ceil(total * 0.2)) or "estratificado"
        except CasewiseError as error:
            outcome = str(error)
        rows.append((channel, total, len(classes), outcome))
    return spark.createDataFrame(rows, "canal string, registros bigint, classes bigint, resultado string")


@query("class_weights")
def _class_weights(spark, sf):
    weights = split.class_weights(_split(spark, sf).train, "classe_macro")
    return weights.withColumn("weight", round_exact(F.col("weight"), 6))


@query("taxonomy")
def _taxonomy(spark, sf):
    return hierarchy.taxonomy(_split(spark, sf).train).withColumn(
        "detail_options", F.array_join("detail_options", ", ")
    )


@query("fallback_label")
def _fallback_label(spark, sf):
    return hierarchy.fallback_label(_split(spark, sf).train)


def _top_details(train):
    sizes = train.groupBy("classe_macro", "classe_detalhada").agg(F.count(F.lit(1)).alias("c"))
    return materialize(
        sizes.groupBy("classe_macro").agg(F.min_by("classe_detalhada", F.struct(-F.col("c"), "classe_detalhada")).alias("detail")),
        "top-details",
    )


def _predictions(spark, sf):
    """Test rows with the language as predicted macro and the most frequent detail of a macro, or of all if it has none."""
    parts = _split(spark, sf)
    tops = _top_details(parts.train)
    fallback = materialize(hierarchy.fallback_label(parts.train), "fallback").select(F.col("label").alias("fallback"))
    tested = data.with_language(parts.test.withColumnRenamed("texto_original", "texto").drop("texto_processado"))
    for macro, detail in (("macro", "guess"), ("classe_macro", "oracle")):
        tested = tested.join(tops.select(F.col("classe_macro").alias(macro), F.col("detail").alias(detail)), macro, "left")
    tested = tested.join(F.broadcast(fallback), F.lit(True), "left")  # one row
    for detail in ("guess", "oracle"):
        tested = tested.withColumn(detail, F.coalesce(detail, "fallback"))
    levels = [
        F.struct(F.lit(level).alias("level"), F.col(expected).alias("expected"), F.col(guess).alias("predicted"))
        for level, expected, guess in (
            (evaluate.MACRO, "classe_macro", "macro"),
            (evaluate.DETAILED, "classe_detalhada", "guess"),
            (evaluate.DETAILED_ORACLE, "classe_detalhada", "oracle"),
        )
    ]
    return parts, tested.select("id_registro", "texto", F.inline(F.array(*levels)))


def _counts(spark, sf):
    return evaluate.confusion_counts(_predictions(spark, sf)[1])


@query("confusion_matrix")
def _confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(_counts(spark, sf))


@query("weighted_metrics")
def _weighted_metrics(spark, sf):
    return evaluate.weighted_metrics(_counts(spark, sf))


@query("class_report")
def _class_report(spark, sf):
    return evaluate.class_report(_counts(spark, sf))


@query("class_report_sorted")
def _class_report_sorted(spark, sf):
    return evaluate.class_report_sorted(_counts(spark, sf))


@query("macro_f1")
def _macro_f1(spark, sf):
    parts, predictions = _predictions(spark, sf)
    return evaluate.quick_metrics(evaluate.confusion_counts(predictions), parts.train, "classe_macro")


@query("prediction_examples")
def _prediction_examples(spark, sf):
    examples = evaluate.prediction_examples(_predictions(spark, sf)[1])
    return examples.withColumn("posicao", F.col("posicao").cast("bigint"))


@query("error_propagation")
def _error_propagation(spark, sf):
    return evaluate.error_propagation(evaluate.weighted_metrics(_counts(spark, sf)))


@query("risk_classes")
def _risk_classes(spark, sf):
    return evaluate.risk_classes(evaluate.class_report(_counts(spark, sf)))


# --- refinement and routing ----------------------------------------------------------------


def _contexts(spark, sf):
    """New cases with predicted macro, valid classes and baseline detail, without few-shot."""
    train = _split(spark, sf).train
    known = materialize(hierarchy.taxonomy(train), "taxonomy")
    tops = _top_details(train).select(F.col("classe_macro").alias("macro"), F.col("detail").alias("baseline_detail"))
    cases = hierarchy.valid_details(data.predicted_cases(spark, sf), known).join(tops, "macro", "left")
    return cases.withColumn("few_shot_examples", refine.no_examples())


def _contexts_with_examples(spark, sf):
    cases = materialize(_contexts(spark, sf).drop("few_shot_examples"), "contexts")
    found = similar.similar_cases(cases, data.records(spark, sf))
    shots = similar.few_shot_examples(found).select("id", "few_shot_examples")
    shots = shots.withColumn(
        "few_shot_examples",
        F.transform(
            "few_shot_examples",
            lambda shot: F.struct(*[shot[name].alias(name) for name in refine.FEW_SHOT_FIELDS]),
        ),
    )
    joined = cases.join(shots, "id", "left")
    return joined.withColumn("few_shot_examples", F.coalesce("few_shot_examples", refine.no_examples()))


@query("valid_details")
def _valid_details(spark, sf):
    return _contexts(spark, sf).select(
        "id", "macro", F.array_join("valid_classes", ", ").alias("valid_classes"), F.col("valid_classes").isNotNull().alias("known")
    )


@query("build_prompts")
def _build_prompts(spark, sf):
    prompts = refine.build_prompts(_contexts_with_examples(spark, sf))
    return prompts.select("id", F.size("few_shot_examples").cast("bigint").alias("few_shot_count"), "prompt")


def _refiner_texts(spark, sf):
    cases = _contexts(spark, sf)
    return cases.withColumn("refiner_text", T.with_channel(F.col("texto"), F.col("canal_origem")))


@query("lexical_refine")
def _lexical_refine(spark, sf):
    chosen = refine.lexical_class(F.col("refiner_text"), F.col("valid_classes"), data.DETAIL_KEYWORDS)
    return _refiner_texts(spark, sf).select("id", "macro", chosen.alias("detailed_class"))


@query("priority_refine")
def _priority_refine(spark, sf):
    text = F.col("refiner_text")
    return _refiner_texts(spark, sf).select(
        "id",
        labels.refiner_priority(text).alias("priority"),
        labels.refiner_priority(text, data.HIGH_TERMS, data.MEDIUM_TERMS).alias("priority_test_terms"),
    )


@query("ambiguity")
def _ambiguity(spark, sf):
    flag = labels.ambiguous(F.col("refiner_text"), F.col("valid_classes"))
    return _refiner_texts(spark, sf).select("id", flag.alias("ambiguous_case"))


@query("parse_responses")
def _parse_responses(spark, sf):
    cases = _contexts(spark, sf)
    answers = data.responses(cases).select("id", "body", "error")
    parsed = refine.parse_responses(cases.select("id", "valid_classes").join(answers, "id"))
    return parsed.drop("valid_classes")


_REFINED = (
    "id", "provider", "requested_provider", "mode", "status", "fallback_reason", "detailed_class",
    "justification", "priority", "ambiguous_case",
)


def _refined(spark, sf):
    cases = _contexts(spark, sf)
    return refine.refine(cases, data.responses(cases), "remote", data.DETAIL_KEYWORDS)


@query("refine_with_fallback")
def _refine_with_fallback(spark, sf):
    return _refined(spark, sf).select(*_REFINED)


@query("refine")
def _refine(spark, sf):
    refined = refine.refine(_contexts_with_examples(spark, sf), keywords=data.DETAIL_KEYWORDS)
    return refined.select(*_REFINED, "baseline_detail", "few_shot_count")


@query("confidence_band")
def _confidence_band(spark, sf):
    sure = F.col("confidence")
    return data.predicted_cases(spark, sf).select(
        "id",
        "confidence",
        labels.confidence_band(sure).alias("confidence_band"),
        percent(sure).alias("confidence_percent"),
    )


@query("routing")
def _routing(spark, sf):
    return routing.route(_refined(spark, sf)).select("id", "confidence_level", *routing._FIELDS)


# --- files and composite jobs --------------------------------------------------------------


@query("csv_scan")
def _csv_scan(spark, sf):
    path = scratch_path(spark, "csv")
    writer = data.records(spark, sf).write.option("header", True).option("quoteAll", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return source.load_records(spark, path)


@query("land_batch")
def _land_batch(spark, sf):
    landing = scratch_path(spark, "landing")
    source.land_batch(data.records(spark, sf), landing, "upload", "first")
    return source.read_landing(spark, landing).drop(source.ARRIVED)


@query("latest_batch")
def _latest_batch(spark, sf):
    """One batch per language, named so that neither text nor number order is that of arrival."""
    landing = scratch_path(spark, "landing")
    records = data.records(spark, sf)
    known = F.col("classe_macro").isin("de", "es", "fr")
    for batch, rows in (
        ("9", records.where(F.col("classe_macro") == "de")),
        ("10", records.where(F.col("classe_macro").isin("es", "fr"))),
        ("007", records.where(~F.coalesce(known, F.lit(False)))),
    ):
        source.land_batch(rows, landing, "upload", batch)
    return source.latest_batch(source.read_landing(spark, landing), "upload").drop("source")


@query("eda_report")
def _eda_report(spark, sf):
    report = eda_report(data.records(spark, sf))

    def section(name, label, value):
        return report[name].select(F.lit(name).alias("section"), label.alias("label"), value.cast("string").alias("value"))

    stats = report["text_stats"]
    sections = [section(name, F.col("label"), F.col("value")) for name in ("macro", "channel", "detailed_top")]
    sections.append(section("overview", F.col("indicador"), F.col("valor")))
    sections.append(section("dataset", F.col("columns"), F.col("row_count")))
    sections += [section("text_stats", F.lit(name), F.col(name)) for name in stats.columns]
    place = F.concat_ws("|", "macro_class", F.col("posicao").cast("string"), "id_registro")
    sections.append(section("examples_by_macro", place, F.md5(F.col("texto"))))
    combined = sections[0]
    for part in sections[1:]:
        combined = combined.unionByName(part)
    return combined


_TRAINED: dict[tuple[str, str], TrainingResult] = {}


def _trained(spark, sf) -> TrainingResult:
    """The training job, run once per session and table directory."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TRAINED:
        _TRAINED[key] = train_job(data.records(spark, sf), scratch_path(spark, "model"))
    return _TRAINED[key]


def _coefficients(model, linear):
    """A stored linear model as (model, label, term, coefficient) rows; the intercept has no term."""
    scope = F.when(F.col("model").startswith("detail:macro:"), F.substring("model", 8, 1 << 30)).otherwise(
        F.lit(tfidf.EVERYTHING)
    )
    shown = round_exact(F.col("coefficient"), 6).alias("coefficient")
    long = linear.select(
        "model", "label", scope.alias("scope"), F.posexplode("coefficients").alias("at", "coefficient")
    ).withColumn("place", F.col("at") + 1)
    terms = long.join(model.vocabulary.select("scope", "place", "term"), ["scope", "place"])
    starts = linear.select("model", "label", F.lit(None).cast("string").alias("term"), F.col("intercept").alias("coefficient"))
    return terms.select("model", "label", "term", "coefficient").unionByName(starts).select("model", "label", "term", shown)


@query("train_macro")
def _train_macro(spark, sf):
    model = _trained(spark, sf).model
    return _coefficients(model, model.macro_linear)


@query("train_detailed")
def _train_detailed(spark, sf):
    model = _trained(spark, sf).model
    return _coefficients(model, model.detailed_linear.where(F.col("model") != hierarchy.GLOBAL_DETAIL_MODEL))


@query("train_global")
def _train_global(spark, sf):
    model = _trained(spark, sf).model
    return _coefficients(model, model.detailed_linear.where(F.col("model") == hierarchy.GLOBAL_DETAIL_MODEL))


def _test_level(level):
    def run(spark, sf):
        return _trained(spark, sf).predictions.where(F.col("level") == level)

    return run


query("predict_macro")(_test_level(evaluate.MACRO))
query("predict_detailed")(_test_level(evaluate.DETAILED))
query("predict_detailed_oracle")(_test_level(evaluate.DETAILED_ORACLE))


@query("train_job")
def _train_job(spark, sf):
    return _trained(spark, sf).reports["class_report"]


@query("model_store")
def _model_store(spark, sf):
    """Test texts predicted again by the model as stored and loaded."""
    trained = _trained(spark, sf)
    loaded, _ = model_store.load_model(spark, trained.paths["metadata"].rsplit("/versions/", 1)[0])
    rows = trained.split.test.withColumn("id", F.col("id_registro"))
    return loaded.predict_macro(rows, "macro", "confidence").select("id", "macro", "confidence")


def _scored_columns(scored):
    return scored.select(
        "id", "macro", "confidence", "confidence_percent", "baseline_detail", "detailed_class", "similar_scope", "similar_count",
        "provider", "mode", "status", "priority", "ambiguous_case", "decision", "queue", "review_required",
    )


@query("score_batch")
def _score_batch(spark, sf):
    index = similar.HistoryIndex.build(data.records(spark, sf))
    scored, _ = score_batch(data.cases(spark, sf), _trained(spark, sf).model, index, keywords=data.DETAIL_KEYWORDS)
    return _scored_columns(scored)


@query("score_stream")
def _score_stream(spark, sf):
    """The same cases as a stream of landed files."""
    landed, target = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    arriving = data.cases(spark, sf)
    arriving.write.parquet(landed)
    stream = spark.readStream.schema(arriving.schema).parquet(landed)
    index = similar.HistoryIndex.build(data.records(spark, sf))
    checkpoint = scratch_path(spark, "stream-checkpoint")
    running = score_stream(stream, _trained(spark, sf).model, index, target, checkpoint, keywords=data.DETAIL_KEYWORDS)
    running.awaitTermination()
    return _scored_columns(spark.read.parquet(f"{target}/scored"))
