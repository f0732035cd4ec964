"""Answer and retrieval metrics, runs and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trilayer.functions.canonical import compatible
from trilayer.functions.session import materialise
from trilayer.functions.text import doc_key, expected_fold, json_object, normalise_answer, tokens

# Metrics for which less is better.
LOWER_IS_BETTER = ["verbose_hit_rate", "truncated_rate", "unparsed_rate"]
KS = (1, 5, 10, 20)


def gold_docs(facts: Column, paragraphs: Column, source: Column) -> Column:
    """Cited titles, then supporting paragraphs' titles, else the source; distinct in order."""
    cited = F.transform(F.coalesce(facts, F.array().cast("array<array<string>>")), lambda f: f[0])
    none = F.array().cast("array<struct<title:string,is_supporting:boolean>>")
    supporting = F.transform(F.filter(F.coalesce(paragraphs, none), lambda p: p["is_supporting"]), lambda p: p["title"])
    all_ = F.concat(cited, supporting)
    found = F.when(F.size(all_) > 0, all_).otherwise(F.array(source))
    return F.array_distinct(F.filter(found, lambda t: F.coalesce(t, F.lit("")) != ""))


def gold_answers(answers: Column, aliases: Column) -> Column:
    """Answers and aliases, distinct in order, blank ones dropped."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(F.coalesce(answers, none), F.coalesce(aliases, none)), lambda a: F.trim(a) != ""))


def _texts(preds: DataFrame) -> DataFrame:
    """What the metrics compare, in compatibility form."""
    return compatible(preds.select("example_id", "prediction", "gold_answers"), "prediction", "gold_answers")


def exact_match(preds: DataFrame) -> DataFrame:
    """(example_id, value): 1 if any gold answer has the prediction's comparison form."""
    preds = _texts(preds)
    p = normalise_answer(F.col("prediction"), folded=True)
    return preds.select("example_id", F.exists("gold_answers", lambda g: normalise_answer(g, folded=True) == p).cast("double").alias("value"))


def token_f1(preds: DataFrame) -> DataFrame:
    """(example_id, value): best multiset overlap F1 over gold answers; nothing in common or empty: 0."""
    g = _texts(preds).select("example_id", tokens(F.col("prediction"), folded=True).alias("p"), F.posexplode_outer("gold_answers").alias("g_no", "gold")).withColumn("g", tokens(F.col("gold"), folded=True))
    p_n = g.select("example_id", "g_no", F.explode("p").alias("t")).groupBy("example_id", "g_no", "t").agg(F.count("*").alias("a"))
    g_n = g.select("example_id", "g_no", F.explode("g").alias("t")).groupBy("example_id", "g_no", "t").agg(F.count("*").alias("b"))
    both = p_n.join(g_n, ["example_id", "g_no", "t"]).groupBy("example_id", "g_no").agg(F.sum(F.least("a", "b")).alias("same"))
    f = g.select("example_id", "g_no", F.size("p").alias("np"), F.size("g").alias("ng")).join(both, ["example_id", "g_no"], "left")
    f1 = F.coalesce(2.0 * F.col("same") / (F.col("np") + F.col("ng")), F.lit(0.0))
    return f.groupBy("example_id").agg(F.max(f1).alias("value"))


def str_acc(preds: DataFrame, window: int = 200, verbosity: int = 10) -> DataFrame:
    """(example_id, hit, verbose, truncated): any gold answer's tokens stand in the first ``window`` of the prediction."""
    preds = _texts(preds)
    p = tokens(F.col("prediction"), folded=True)
    line = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    d = preds.select("example_id", p.alias("p"), F.transform("gold_answers", lambda g: tokens(g, folded=True)).alias("g"))
    hit = F.exists("g", lambda g: (F.size(g) > 0) & F.contains(line(F.slice("p", 1, window)), line(g)))
    shortest = F.array_min(F.transform(F.filter("g", lambda g: F.size(g) > 0), F.size))
    return d.select("example_id", hit.alias("hit"), (hit & (F.size("p") > verbosity * shortest)).alias("verbose"), (F.size("p") > window).alias("truncated"))


def str_acc_audit(scores: DataFrame) -> DataFrame:
    """(str_acc, verbose_hit_rate, truncated_rate)."""
    n = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    rate = F.coalesce(F.count_if("verbose") / F.nullif(F.count_if("hit"), F.lit(0)), F.lit(0.0))
    return scores.agg(n(F.col("hit")).alias("str_acc"), rate.alias("verbose_hit_rate"), n(F.col("truncated")).alias("truncated_rate"))


def _ranks(retrieved: DataFrame) -> DataFrame:
    """Distinct document keys of (example_id, rank, title), ranked anew."""
    r = compatible(retrieved.select("example_id", "rank", "title"), "title").withColumn("key", doc_key(F.col("title"), folded=True)).where("key <> ''").groupBy("example_id", "key").agg(F.min("rank").alias("rank"))
    return r.withColumn("place", F.row_number().over(Window.partitionBy("example_id").orderBy("rank", "key")))


def _golds(examples: DataFrame) -> DataFrame:
    g = compatible(examples.select("example_id", F.explode("gold_docs").alias("t")), "t").select("example_id", doc_key(F.col("t"), folded=True).alias("key"))
    return g.where("key <> ''").distinct()


def recall_at_k(examples: DataFrame, retrieved: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(example_id, k, value): share of gold documents among the first k distinct ones; no gold: 0."""
    hit = _golds(examples).join(_ranks(retrieved).select("example_id", "key", "place"), ["example_id", "key"], "left")
    k = F.explode(F.array(*[F.lit(x) for x in ks])).alias("k")
    s = hit.select("example_id", "place", k).groupBy("example_id", "k").agg((F.count_if(F.col("place") <= F.col("k")) / F.count("*")).alias("value"))
    every = examples.select("example_id", k)
    return every.join(s, ["example_id", "k"], "left").fillna(0.0, ["value"])


def _overlap(examples: DataFrame, retrieved: DataFrame) -> DataFrame:
    g, r = _golds(examples), _ranks(retrieved).select("example_id", "key")
    n_g = g.groupBy("example_id").agg(F.count("*").alias("n_gold"))
    n_r = r.groupBy("example_id").agg(F.count("*").alias("n_found"))
    n = g.join(r, ["example_id", "key"]).groupBy("example_id").agg(F.count("*").alias("n_both"))
    return examples.select("example_id").join(n_g, "example_id", "left").join(n_r, "example_id", "left").join(n, "example_id", "left").fillna(0)


def evidence_recall(examples: DataFrame, retrieved: DataFrame) -> DataFrame:
    o = _overlap(examples, retrieved)
    return o.select("example_id", F.coalesce(F.col("n_both") / F.nullif("n_gold", F.lit(0)), F.lit(0.0)).alias("value"))


def context_relevance(examples: DataFrame, retrieved: DataFrame) -> DataFrame:
    o = _overlap(examples, retrieved)
    return o.select("example_id", F.coalesce(F.col("n_both") / F.nullif("n_found", F.lit(0)), F.lit(0.0)).alias("value"))


def parse_verdict(reply: Column) -> Column:
    """correct, incorrect or unparsed."""
    v = F.lower(F.trim(F.get_json_object(json_object(reply), "$.verdict")))
    return F.when(v.isin("correct", "incorrect"), v).otherwise(F.lit("unparsed"))


def judge_prompts(preds: DataFrame) -> DataFrame:
    """(example_id, prompt): question, gold answers and prediction between fences."""
    part = lambda name, c: F.concat(F.lit(f"<<<{name}>>>\n"), F.replace(F.coalesce(c, F.lit("")), F.lit("<<<"), F.lit("< < <")), F.lit(f"\n<<<END {name}>>>\n"))
    return preds.select("example_id", F.concat(part("QUESTION", F.col("question")), part("GOLD", F.array_join("gold_answers", "; ")), part("ANSWER", F.col("prediction"))).alias("prompt"))


def judge(preds: DataFrame, fn) -> DataFrame:  # noqa: ANN001
    """(example_id, verdict) of a user's batch function over prompts (frame with reply and error)."""
    r = judge_prompts(preds).mapInPandas(lambda it: (fn(b) for b in it), "example_id long, reply string, error string")
    return r.select("example_id", F.when(F.col("error").isNotNull(), F.lit("error")).otherwise(parse_verdict(F.col("reply"))).alias("verdict"))


def judge_summary(verdicts: DataFrame) -> DataFrame:
    rate = lambda v: F.coalesce(F.avg((F.col("verdict") == v).cast("double")), F.lit(0.0))
    return verdicts.agg(rate("correct").alias("accuracy"), rate("unparsed").alias("unparsed_rate"))


def score_run(examples: DataFrame, preds: DataFrame, retrieved: DataFrame | None = None, verdicts: DataFrame | None = None, ks: tuple[int, ...] = KS) -> DataFrame:
    """(metric, value) of one run, all metrics from one set of predictions; a missing or failed one scores as wrong.

    examples (example_id, gold_answers, and gold_docs where ``retrieved`` is
    given), preds (example_id, prediction, failed), retrieved (example_id, rank,
    title), verdicts (example_id, verdict) as ``judge`` gives them.  Answers
    alone: exact_match, token_f1, str_acc with its audit rates, failures;
    retrieval adds recall@k, evidence_recall and context_relevance, a judge its
    accuracy and the share of verdicts that couldn't be read.
    """
    p = examples.select("example_id", "gold_answers").join(preds.select("example_id", "prediction", "failed"), "example_id", "left")
    lost = F.coalesce("failed", F.lit(True))
    p = materialise(p.select("example_id", "gold_answers", lost.alias("failed"), F.when(lost, F.lit("")).otherwise(F.col("prediction")).alias("prediction")))
    mean = lambda df, name: df.agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("value")).select(F.lit(name).alias("metric"), "value")
    each = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in df.columns])).alias("x")).select("x.*")
    parts = [mean(exact_match(p), "exact_match"), mean(token_f1(p), "token_f1"), each(str_acc_audit(str_acc(p)))]
    parts.append(each(p.agg(F.count_if("failed").cast("double").alias("failures"))))
    if retrieved is not None:
        at = recall_at_k(examples, retrieved, ks).groupBy("k").agg(F.avg("value").alias("value"))
        parts.append(at.select(F.concat(F.lit("recall@"), F.col("k").cast("string")).alias("metric"), "value"))
        parts += [mean(evidence_recall(examples, retrieved), "evidence_recall"), mean(context_relevance(examples, retrieved), "context_relevance")]
    if verdicts is not None:
        # an example without a verdict counts as not correct
        parts.append(each(judge_summary(examples.select("example_id").join(verdicts, "example_id", "left").fillna("error", ["verdict"])).select(F.col("accuracy").alias("llm_acc"), "unparsed_rate")))
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q)
    return out


def aggregate_runs(metrics: DataFrame) -> DataFrame:
    """(metric, mean, stdev, min, max, n, ci95) over runs of (run, metric, value)."""
    m = metrics.groupBy("metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("stdev"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n"))
    return m.withColumn("ci95", 1.96 * F.col("stdev") / F.sqrt("n"))


def compare_golden(reference: DataFrame, current: DataFrame, sigmas: float = 2.0, floor: float = 0.01) -> DataFrame:
    """(metric, delta, outcome): better, worse, same or missing; delta positive when better.

    A change counts beyond ``sigmas`` of the greater deviation, or beyond
    ``floor`` where both are 0.
    """
    r = reference.select("metric", F.col("mean").alias("was"), F.col("stdev").alias("s1"))
    c = current.select("metric", F.col("mean").alias("now"), F.col("stdev").alias("s2"))
    j = r.join(c, "metric", "full_outer")
    sign = F.when(F.col("metric").isin(LOWER_IS_BETTER), F.lit(-1.0)).otherwise(F.lit(1.0))
    j = j.withColumn("delta", sign * (F.col("now") - F.col("was"))).withColumn("s", F.greatest("s1", "s2"))
    limit = F.when(F.col("s") > 0, sigmas * F.col("s")).otherwise(F.lit(floor))
    out = F.when(F.col("delta").isNull(), "missing").when(F.col("delta") > limit, "better").when(F.col("delta") < -limit, "worse").otherwise("same")
    return j.select("metric", "delta", out.alias("outcome"))


def sample(examples: DataFrame, n: int, seed: int, order_col: str = "example_id") -> DataFrame:
    """n examples by seeded hash, in their own order."""
    return examples.orderBy(F.xxhash64(F.col(order_col), F.lit(seed)), order_col).limit(n).orderBy(order_col)


def expected_hits(answers: DataFrame) -> DataFrame:
    """(kind, n, hits) of (kind, answer, expect), null kind the total: all expected strings stand in the answer."""
    a = answers.withColumn("hit", F.forall("expect", lambda e: F.contains(expected_fold(F.col("answer")), expected_fold(e))))
    return a.rollup("kind").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


def passage_identity(ranked: DataFrame) -> DataFrame:
    """The source label, else the first line of the passage."""
    return ranked.withColumn("title", F.coalesce(F.nullif("source", F.lit("")), F.substring_index("content", "\n", 1)))
