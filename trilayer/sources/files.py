"""Corpora, questions, block sidecars, intake folders, snapshots and golden sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trilayer.functions.text import basename, hash_id
from trilayer.operators.evaluation import gold_answers, gold_docs

BLOCK = "type string, blockid string, format string, content string, heading string, parent_headings array<string>, level int, session_type string, table_slice string, _corrupt string"
_QUESTION = "id string, _id string, question string, answer string, answers array<string>, answer_aliases array<string>, type string, source string, supporting_facts array<array<string>>, paragraphs array<struct<title:string,is_supporting:boolean>>"
_GROUPED = f"source string, questions map<string,array<struct<{_QUESTION.replace(' string', ':string').replace(' array', ':array').replace(', ', ',')}>>>"
# Strategy letters of file names and rules.
STRATEGIES = "FRP"
OPTIONS = "ite!" + STRATEGIES


def read_corpus(spark: SparkSession, path: str, limit: int | None = None, multi_line: bool = True) -> DataFrame:
    """(idx, title, text) of JSON lists (or JSON lines); blank texts dropped, in file order."""
    d = spark.read.schema("title string, text string").json(path, multiLine=multi_line).select(F.monotonically_increasing_id().alias("idx"), "title", "text")
    d = d.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return d.orderBy("idx").limit(limit) if limit else d


#: Tasks a core for a folder of many small files; Spark would make one of every few files.
TASKS = 32


def _in_few_tasks(files: DataFrame) -> DataFrame:
    return files.coalesce(TASKS * files.sparkSession.sparkContext.defaultParallelism)


def write_texts(texts: DataFrame, path: str) -> None:
    """Each value of the one column as a file of its own, put in its place by the task that wrote it."""
    texts.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)


def read_text_corpus(spark: SparkSession, path: str, title: str) -> DataFrame:
    """One document for each whole file."""
    return _in_few_tasks(spark.read.text(path, wholetext=True).select(F.lit(title).alias("title"), F.col("value").alias("text"), F.col("_metadata.file_path").alias("file_path")))


def _examples(q: DataFrame) -> DataFrame:
    ok = F.when(F.trim(F.coalesce("question", F.lit(""))) == "", F.raise_error(F.lit("a record has no question"))).otherwise(F.col("question"))
    answers = F.when(F.col("answers").isNotNull(), F.col("answers")).otherwise(F.array_compact(F.array("answer")))
    return q.select(F.coalesce("id", "_id").alias("example_id"), ok.alias("question"), gold_answers(answers, F.col("answer_aliases")).alias("gold_answers"), gold_docs(F.col("supporting_facts"), F.col("paragraphs"), F.col("source")).alias("gold_docs"), F.coalesce("type", F.lit("")).alias("question_type"))


def read_questions(spark: SparkSession, path: str, types: list[str] | None = None, limit: int | None = None, multi_line: bool = True) -> DataFrame:
    """Examples of flat records and of records that group questions by type."""
    flat = spark.read.schema(_QUESTION + ", questions string").json(path, multiLine=multi_line).where("questions is null").drop("questions")
    grouped = spark.read.schema(_GROUPED).json(path, multiLine=multi_line).where("questions is not null")
    g = grouped.select(F.col("source").alias("_s"), F.explode("questions").alias("_type", "_qs")).select("_s", "_type", F.explode("_qs").alias("q"))
    cols = [c for c in flat.columns if c not in ("type", "source")]
    g = g.select(*[F.col(f"q.{c}").alias(c) for c in cols], F.col("_type").alias("type"), F.coalesce("q.source", "_s").alias("source"))
    out = _examples(flat.unionByName(g))
    if types:
        out = out.where(F.col("question_type").isin(types))
    return out.limit(limit) if limit else out


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Content rows of block sidecars; malformed lines are skipped."""
    b = spark.read.schema(BLOCK).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    return b.where("_corrupt is null and type = 'content'").drop("_corrupt").withColumn("file_path", F.col("_metadata.file_path"))


def sidecar(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks with ids, one meta row per document) of (doc_id, pos, content, heading); blank blocks dropped."""
    b = blocks.where(F.trim(F.coalesce("content", F.lit(""))) != "")
    b = b.withColumn("blockid", F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("pos").cast("string"), F.coalesce("heading", F.lit("")), "content")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n\n")
    return b, b.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sha2(text, 256).alias("sha256"))


def write_blocks(blocks: DataFrame, path: str) -> None:
    b, meta = sidecar(blocks)
    rows = b.withColumn("type", F.lit("content")).unionByName(meta.withColumn("type", F.lit("meta")), allowMissingColumns=True)
    rows.write.mode("overwrite").partitionBy("doc_id").json(path)


def scan_dir(spark: SparkSession, path: str, doc_status: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """New files below a folder: (doc_id, file_path, content); hidden ones, excluded folders and known contents are skipped.

    A document that failed may come again.
    """
    f = _in_few_tasks(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
    f = f.select(hash_id(F.col("content"), "doc-").alias("doc_id"), F.col("path").alias("file_path"), "content")
    f = f.where(~F.rlike("file_path", F.lit(r"/\.[^/]+")))
    for x in exclude or []:
        f = f.where(~F.contains("file_path", F.lit(f"/{x}/")))
    return f.join(doc_status.where("status <> 'failed'").select("doc_id"), "doc_id", "left_anti")


def decode_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs, rejects) of binary contents: strict UTF-8; blank, byte-literal and PDF payloads are rejected with a reason."""
    text = F.when(F.expr("is_valid_utf8(content)"), F.decode("content", "UTF-8"))
    pdf = F.substring("content", 1, 4) == F.lit(b"%PDF")
    t = files.withColumn("text", text)
    why = F.when(pdf, "needs a parser").when(F.col("text").isNull(), "not UTF-8").when(F.rlike("text", F.lit(r"^\s*$")), "blank").when(F.rlike(F.trim("text"), F.lit(r"^b['\"]")), "byte literal")
    t = t.withColumn("reason", why)
    return t.where("reason is null").drop("reason", "content"), t.where("reason is not null").select("doc_id", "file_path", "reason")


def route_files(files: DataFrame, rules: DataFrame, default: str = "legacy") -> DataFrame:
    """Engine and chunk strategy of each file_path.

    A ``[engine-OPTIONS]`` mark in the name comes first, then the first rule
    (no, pattern as a regular expression, engine, options) that its suffix meets.
    """
    name = F.lower(basename(F.col("file_path")))
    raw = F.regexp_extract(basename(F.col("file_path")), r"\[([A-Za-z]+)(?:-([A-Za-z]*))?\]", 1)
    opts = F.regexp_extract(basename(F.col("file_path")), r"\[([A-Za-z]+)(?:-([A-Za-z]*))?\]", 2)
    f = files.withColumn("_suffix", F.regexp_extract(name, r"\.([^.\[\]]*)$", 1)).withColumn("_e", F.lower(raw)).withColumn("_o", opts)
    # each distinct suffix meets the rules once, whatever the number of files
    met = f.select("_suffix").distinct().join(rules, F.rlike(F.col("_suffix"), F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")$"))))
    best = f.join(met.groupBy("_suffix").agg(F.min_by(F.struct("engine", "options"), "no").alias("rule")), "_suffix", "left")
    options = F.coalesce(F.nullif("_o", F.lit("")), F.col("rule.options"), F.lit(""))
    letter = F.regexp_extract(options, f"([{STRATEGIES}])", 1)
    return best.select("file_path", F.coalesce(F.nullif("_e", F.lit("")), F.col("rule.engine"), F.lit(default)).alias("engine"), F.when(letter == "", F.lit("F")).otherwise(letter).alias("strategy"))


def glob_pattern(glob: Column) -> Column:
    """Regular expression of a shell pattern: ``*``, ``?``, ``[set]`` and ``[!set]``, all else as it stands."""
    tokens = F.regexp_extract_all(glob, F.lit(r"(?s)\[!?+(?:\]|[^\]])[^\]]*\]|."), F.lit(0))
    quoted = lambda c: F.regexp_replace(c, r"([^\w-])", r"\\$1")

    def one(t: Column) -> Column:
        inner = F.substring(t, F.lit(2), F.length(t) - 2)
        negated = F.startswith(inner, F.lit("!"))
        members = F.when(negated, F.concat(F.lit("^"), quoted(F.substring(inner, F.lit(2), F.length(inner))))).otherwise(quoted(inner))
        return F.when(F.length(t) > 1, F.concat(F.lit("["), members, F.lit("]"))).when(t == "*", F.lit(".*")).when(t == "?", F.lit(".")).otherwise(F.regexp_replace(t, r"([^\w])", r"\\$1"))

    return F.concat(F.lit("(?s)^"), F.array_join(F.transform(tokens, one), ""), F.lit("$"))


def _engine_name(hint: Column) -> Column:
    """Name of an engine without options and arguments."""
    return F.lower(F.trim(F.regexp_extract(hint, r"^([^(-]*)", 1)))


def route_parsers(files: DataFrame, rules: DataFrame, engines: DataFrame, default: str = "legacy") -> DataFrame:
    """(file_path, engine, options, strategy, error) of each row of ``files``.

    ``rules`` are (no, pattern, hint): the shell pattern must meet the suffix, the
    hint is an engine, and after a hyphen its options.  ``engines`` are (engine,
    suffix) rows of what can be parsed now.  A mark before the suffix,
    ``name.[engine-options].ext`` or ``name.[-options].ext``, comes first, then the
    first rule whose engine takes the suffix, then the default.  Letters that are no
    option are left out; the strategy is the first of F, R and P, F without any.  A
    mark that names no engine, or one that doesn't take the suffix, is an error of
    that row alone, whose engine is then null.  A null path has all null.
    """
    name = basename(F.col("file_path"))
    mark = F.regexp_extract_all(name, F.lit(r"\.\[([^\]]*)\]\.[^.]+$"), F.lit(1))
    f = files.select("file_path", F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1)).alias("suffix"), F.trim(F.get(mark, F.lit(0))).alias("mark"))
    f = f.withColumn("marked", F.nullif(_engine_name(F.col("mark")), F.lit("")))
    f = f.withColumn("mark_options", F.when(F.contains("mark", F.lit("-")), F.regexp_extract("mark", r"(?s)^[^-]*-(.*)$", 1)))
    known = engines.select(F.lower("engine").alias("engine"), F.lower("suffix").alias("suffix")).distinct()
    # each distinct suffix meets the rules once, whatever the number of files
    met = f.select("suffix").distinct().join(rules, F.rlike(F.col("suffix"), glob_pattern(F.lower(F.trim("pattern")))))
    met = met.withColumn("engine", _engine_name(F.col("hint"))).join(known, ["engine", "suffix"], "left_semi")
    met = met.groupBy("suffix").agg(F.min_by(F.struct("engine", F.regexp_extract("hint", r"(?s)^[^-]*-(.*)$", 1).alias("options")), "no").alias("rule"))
    f = f.join(met, "suffix", "left")
    names = known.select(F.col("engine").alias("marked")).distinct().withColumn("is_engine", F.lit(True))
    takes = known.select(F.col("engine").alias("marked"), "suffix").withColumn("takes", F.lit(True))
    f = f.join(names, "marked", "left").join(takes, ["marked", "suffix"], "left")
    bare = F.startswith("mark", F.lit("-"))
    error = (
        F.when(F.col("mark") == "", F.lit("empty hint"))
        .when(F.col("mark").isNotNull() & ~bare & F.col("is_engine").isNull(), F.lit("unknown engine"))
        .when(F.col("is_engine") & F.col("takes").isNull(), F.lit("engine does not take the suffix"))
    )
    letters = lambda c: F.coalesce(F.regexp_replace(c, f"[^{OPTIONS}]", ""), F.lit(""))
    options = F.coalesce(F.nullif(letters(F.col("mark_options")), F.lit("")), letters(F.col("rule.options")))
    strategy = F.regexp_extract(options, f"([{STRATEGIES}])", 1)
    out = f.withColumn("error", error).select("file_path", F.coalesce("marked", "rule.engine", F.lit(default)).alias("engine"), options.alias("options"), F.when(strategy == "", F.lit("F")).otherwise(strategy).alias("strategy"), "error")
    ok = F.col("error").isNull() & F.col("file_path").isNotNull()
    return out.select("file_path", *[F.when(ok, F.col(c)).alias(c) for c in ("engine", "options", "strategy")], "error")


def read_extractions(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Records of extraction files, raw JSON lists kept as text."""
    d = spark.read.schema("docs array<struct<idx:string,passage:string,extracted_entities:string,extracted_triples:string,failed:boolean,error:string>>").json(path, multiLine=multi_line)
    return d.select(F.explode("docs").alias("d")).select("d.*")


def save_golden(examples: DataFrame, stats: DataFrame, path: str, version: int = 1) -> None:
    spark = examples.sparkSession
    examples.write.mode("overwrite").parquet(f"{path}/examples")
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    spark.range(1).select(F.lit("golden-set").alias("format"), F.lit(version).alias("version")).write.mode("overwrite").json(f"{path}/manifest")


def load_golden(spark: SparkSession, path: str, version: int = 1) -> tuple[DataFrame, DataFrame]:
    """What ``save_golden`` wrote; a foreign format or a newer version is an error."""
    m = spark.read.schema("format string, version int").json(f"{path}/manifest").first()
    if m is None or m["format"] != "golden-set" or m["version"] > version:
        raise ValueError(f"not a golden set of version {version} or less: {m}")
    return spark.read.parquet(f"{path}/examples"), spark.read.parquet(f"{path}/stats")


def path_url(path: Column) -> Column:
    return F.concat(F.lit("file://"), path)
