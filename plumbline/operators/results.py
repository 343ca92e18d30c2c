"""Consolidation of answers into one best value per (project, parameter), and upkeep of stored results."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import written

KEY = ["project", "parameter"]
# Words of an explanation that tell of inference.
INFERENCE_SIGNALS = ("inferred", "assumed", "estimated", "approximately", "likely", "probably", "implied", "not explicitly")
CAP = 0.75
MAX_PARAMETERS = 10_000
RETRY_ABOVE, RETRY_AT_MOST = 0.5, 0.6
_FENCE = "^\\s*```[a-z]*\\s*|\\s*```\\s*$"
ANSWER = "map<string, struct<found boolean, value string, value_numeric double, unit string, confidence double, source_numbers array<int>, explanation string>>"


def parsed_answers(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """answer_id, parameter, found, value, unit, confidence, reason for each expected (answer_id, parameter).

    response_text is JSON keyed by parameter, maybe in a code fence. Of an answer that is cut off, the whole objects before the cut count. One that is no JSON finds nothing, reason
    `JSON parse failed`; an expected parameter that is absent has the reason `Missing in response`.
    """
    body = F.regexp_replace("response_text", _FENCE, "")
    whole = F.from_json(body, ANSWER)
    parsed = answers.select("answer_id", body.alias("body"), whole.alias("m")).select("answer_id", F.coalesce("m", F.from_json(closed_prefix(F.when(F.col("m").isNull(), F.col("body"))), ANSWER)).alias("m"))
    # Each answer is parsed once: its parameters are looked up where it meets those that are expected.
    joined = expected.join(parsed, "answer_id", "left").select("answer_id", "parameter", F.col("m").isNotNull().alias("valid"), F.try_element_at("m", F.col("parameter")).alias("a"))
    found = F.coalesce("a.found", F.lit(False))
    reason = F.when(~F.col("valid"), "JSON parse failed").when(F.col("a").isNull(), "Missing in response")
    return joined.select("answer_id", "parameter", found.alias("found"), F.col("a.value").alias("value"), F.col("a.unit").alias("unit"), capped_confidence(found, F.col("a.value"), F.col("a.confidence"), F.col("a.explanation")).alias("confidence"), reason.alias("reason"))


#: A string, whole or cut off, a bracket, or what lies between. Possessive, so that long strings cost their length only.
_JSON_TOKEN = r'(?s)"(?:[^"\\]|\\.)*+\\?(?:"|\z)|[{}\[\]]|[^"{}\[\]]++'


def closed_prefix(body: Column) -> Column:
    """The longest prefix of cut-off JSON that ends at a brace and, its open braces closed, may be JSON; null without one.

    One pass over strings and brackets: the first object that closes at top level ends it; else the last brace that leaves
    nothing but objects open. Braces in strings don't count.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("open"), F.lit(0).alias("end"), F.lit(0).alias("left"), F.lit(False).alias("done"))

    def step(s: Column, token: Column) -> Column:
        opens, closes = token.isin("{", "["), token.isin("}", "]")
        at = s["at"] + F.length(token)
        stack = F.when(opens, F.concat(s["open"], token)).when(closes, F.substring(s["open"], F.lit(1), F.greatest(F.length(s["open"]) - 1, F.lit(0)))).otherwise(s["open"])
        good = (token == "}") & (F.length(s["open"]) > 0) & ~F.contains(stack, F.lit("["))
        return F.when(s["done"], s).otherwise(F.struct(at.alias("at"), stack.alias("open"), F.when(good, at).otherwise(s["end"]).alias("end"), F.when(good, F.length(stack)).otherwise(s["left"]).alias("left"), (closes & (F.length(stack) == 0)).alias("done")))

    found = F.aggregate(F.regexp_extract_all(body, F.lit(_JSON_TOKEN), F.lit(0)), start, step)
    return F.transform(F.array(found), lambda s: F.when(s["end"] > 0, F.concat(F.substring(body, F.lit(1), s["end"]), F.repeat(F.lit("}"), s["left"]))))[0]


def capped_confidence(found: Column, value: Column, confidence: Column, explanation: Column) -> Column:
    """0.75 at most where the explanation tells of inference; 0 where something is found but has no value."""
    said = F.lower(F.coalesce(explanation, F.lit("")))
    inferred = F.lit(False)
    for signal in INFERENCE_SIGNALS:
        inferred = inferred | said.contains(signal)
    c = F.coalesce(confidence, F.lit(0.0))
    return F.when(found & (F.coalesce(value, F.lit("")) == ""), 0.0).when((c > CAP) & inferred, CAP).otherwise(c)


def stored_form(results: DataFrame) -> DataFrame:
    """A result that is not found has no value and no confidence."""
    return results.withColumn("value", F.when(F.col("found"), F.col("value"))).withColumn("confidence", F.when(F.col("found"), F.col("confidence")).otherwise(0.0))


def best_per_key(results: DataFrame) -> DataFrame:
    """Found beats not found, then the higher confidence wins, then the first."""
    rank = F.struct(F.col("found").alias("f"), F.when(F.col("found"), F.col("confidence")).otherwise(0.0).alias("c"), (-F.col("ordinal")).alias("o"))
    rest = [c for c in results.columns if c not in KEY]
    return results.groupBy(*KEY).agg(F.max_by(F.struct(*rest), rank).alias("best")).select(*KEY, "best.*")


def pass_overlay(first: DataFrame, second: DataFrame) -> DataFrame:
    """The found rows of the first pass; the second pass fills what they lack."""
    found = first.where("found").withColumn("pass", F.lit(1))
    return found.unionByName(second.withColumn("pass", F.lit(2)).join(found.select(*KEY), KEY, "left_anti"))


def not_found_fill(expected: DataFrame, results: DataFrame) -> DataFrame:
    """`results` and a null row for each expected (project, parameter) that they lack."""
    missing = expected.select(*KEY).join(results.select(*KEY), KEY, "left_anti")
    return results.unionByName(missing.withColumn("found", F.lit(False)).withColumn("confidence", F.lit(0.0)), allowMissingColumns=True)


def upsert(target: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of `target` that `new` has no row for, and the last row a key (by ordinal) of `new`."""
    latest = new.withColumn("n", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("ordinal").desc()))).where("n = 1").drop("n")
    return target.join(latest.select(*KEY), KEY, "left_anti").unionByName(latest)


def replace_documents(target: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of the documents in `new` are replaced by its rows; running it twice changes nothing."""
    return target.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)


def source_rollup(citations: DataFrame) -> DataFrame:
    """Per key and document: pages and sections in the order of first citation, and whether the document is the primary source.

    citations: project, parameter, ordinal, doc_id, page, section. The primary is the document cited first.
    """
    ordered = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", c))), lambda x: x[c]))
    rows = citations.groupBy(*KEY, "doc_id").agg(ordered("page").alias("pages"), ordered("section").alias("sections"), F.min("ordinal").alias("first"))
    of_key = Window.partitionBy(*KEY)
    return rows.select(*KEY, "doc_id", "pages", "sections", (F.col("first") == F.min("first").over(of_key)).alias("is_primary"), (F.count("*").over(of_key) > 1).alias("multi_source"))


def run_metrics(results: DataFrame) -> DataFrame:
    """Per project: total, found and not found, per pass, and the mean confidence of what is found."""
    return results.groupBy("project").agg(F.count("*").alias("n_total"), F.count_if("found").alias("n_found"), F.count_if(~F.col("found")).alias("n_not_found"), F.count_if(F.col("pass") == 1).alias("n_pass1"), F.count_if(F.col("pass") == 2).alias("n_pass2"), F.avg(F.when(F.col("found"), F.col("confidence"))).alias("mean_confidence"))


def parameter_report(results: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Results with the name of their document and the text of their chunk, where these exist."""
    return results.join(documents, "doc_id", "left").join(chunks, "chunk_id", "left")


def without_orphans(results: DataFrame, archived: DataFrame) -> DataFrame:
    """Results whose document is not among the archived."""
    return results.join(archived.select("doc_id").distinct(), "doc_id", "left_anti")


def repointed(results: DataFrame, archived: DataFrame) -> DataFrame:
    """project, parameter, doc_id, n_left, action: archived sources go, the next becomes the primary (`kept` or `moved`); without
    any left the row is marked `extract_again`. results: project, parameter and sources, an ordered array of document ids."""
    rows = results.select(*KEY, F.col("sources")[0].alias("was"), F.posexplode("sources").alias("at", "doc_id"))
    left = rows.join(archived.select("doc_id").distinct(), "doc_id", "left_anti").groupBy(*KEY).agg(F.min_by("doc_id", "at").alias("doc_id"), F.count("*").alias("n_left"))
    joined = results.select(*KEY, F.col("sources")[0].alias("was")).join(left, KEY, "left")
    action = F.when(F.col("doc_id").isNull(), "extract_again").when(F.col("doc_id") == F.col("was"), "kept").otherwise("moved")
    return joined.select(*KEY, "doc_id", F.coalesce("n_left", F.lit(0)).alias("n_left"), action.alias("action"))


def cascade_deleted(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """What is left of each table, all keyed by doc_id, when the documents `doomed` go; results also go with their chunks."""
    ids = doomed.select("doc_id").distinct()
    gone_chunks = tables["chunks"].join(ids, "doc_id", "left_semi").select("chunk_id")
    left = {name: t.join(ids, "doc_id", "left_anti") for name, t in tables.items()}
    return left | {"results": left["results"].join(gone_chunks, "chunk_id", "left_anti")}


def projects_deleted(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """What is left of each table, all keyed by project, when the projects `doomed` go."""
    ids = doomed.select("project").distinct()
    return {name: t.join(ids, "project", "left_anti") for name, t in tables.items()}


def prompts(windows: DataFrame, parameters: DataFrame, size: int = 25) -> DataFrame:
    """project, window_no, batch_no, names, context of each window (project, window_no, context) and batch of `size` parameters
    (name, place). The batches are one small array: a catalog has some hundred names, and more than MAX_PARAMETERS raise."""
    if parameters.limit(MAX_PARAMETERS + 1).count() > MAX_PARAMETERS:
        raise ValueError(f"more than {MAX_PARAMETERS} parameters to ask for")
    batch = parameters.withColumn("batch_no", F.floor((F.row_number().over(Window.orderBy("place")) - 1) / size).cast("long"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda p: p["name"])
    batches = batch.groupBy("batch_no").agg(names.alias("names")).agg(F.array_sort(F.collect_list(F.struct("batch_no", "names"))))
    return windows.withColumn("__all", batches.scalar()).select("project", "window_no", "context", F.inline("__all"))


def keyword_answer(context: str, names: list[str]) -> str:
    """An answer that needs no model: JSON with each name that the context holds, its value the name itself."""
    return json.dumps({n: {"found": True, "value": n} for n in names if n.lower() in context.lower()})


def answered(prompt_rows: DataFrame, ask: Callable[[str, list[str]], str]) -> DataFrame:
    """Prompt rows with the response_text of a user's function of context and names; where it fails the text is null."""

    def one(context: str, names: list[str]) -> str | None:
        try:
            return ask(context, list(names))
        except Exception:  # the caller's function, of any kind
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(response_text=[one(c, n) for c, n in zip(f["context"], f["names"], strict=True)])

    return prompt_rows.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in prompt_rows.dtypes) + ", response_text string")


def asked_again(parsed: DataFrame) -> DataFrame:
    """answer_id, parameter to ask for once more: those an answer lacks, where more than half of its parameters were lost at first
    (`unparsed`) and what is still missing after recovery is at most 60%."""
    shares = parsed.groupBy("answer_id").agg(F.avg(F.col("unparsed").cast("int")).alias("lost"), F.avg(F.col("reason").isNotNull().cast("int")).alias("missing"))
    again = shares.where((F.col("lost") > RETRY_ABOVE) & (F.col("missing") <= RETRY_AT_MOST)).select("answer_id")
    return parsed.where("reason is not null").join(again, "answer_id", "left_semi").select("answer_id", "parameter")


def answered_with_retry(prompt_rows: DataFrame, ask: Callable[[str, list[str]], str]) -> DataFrame:
    """answer_id, parameter, found, value, unit, confidence, reason and again, of prompt rows (answer_id, context, names): the
    whole exchange with a user's function, at most twice a prompt.

    Answers are asked for once and written. Where more than half of an answer's parameters can't be read, what lies whole
    before the cut counts; if at most 60% are then missing, these alone are asked for once more with the same context (`again`).
    The second answer is read as it is, and what it finds takes the place of what was missing. A row of a prompt and name
    comes out for each name, whatever fails.
    """
    first = written(answered(prompt_rows.select("answer_id", "context", "names"), ask), "answers")
    expected = first.select("answer_id", F.explode(F.array_distinct("names")).alias("parameter"))
    strict = F.from_json(F.regexp_replace("response_text", _FENCE, ""), ANSWER)
    read = first.select("answer_id", strict.alias("m"))
    lost = expected.join(read, "answer_id").select("answer_id", "parameter", F.try_element_at("m", F.col("parameter")).isNull().alias("unparsed"))
    parsed = parsed_answers(first, expected).join(lost, ["answer_id", "parameter"])
    parsed = written(parsed, "parsed-answers")
    missing = asked_again(parsed)
    places = first.select("answer_id", F.posexplode(F.array_distinct("names")).alias("place", "parameter"))
    ordered = missing.join(places, ["answer_id", "parameter"]).groupBy("answer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "parameter"))), lambda x: x["parameter"]).alias("names"))
    second = written(answered(ordered.join(first.select("answer_id", "context"), "answer_id"), ask), "second-answers")
    asked = second.select("answer_id", F.explode("names").alias("parameter"))
    whole = second.withColumn("response_text", F.when(F.from_json(F.regexp_replace("response_text", _FENCE, ""), ANSWER).isNotNull(), F.col("response_text")))
    better = parsed_answers(whole, asked).select("answer_id", "parameter", F.struct("found", "value", "unit", "confidence", "reason").alias("__b"))
    rows = parsed.join(better, ["answer_id", "parameter"], "left")
    taken = F.coalesce(F.col("__b.found"), F.lit(False))
    pick = lambda c: F.when(taken, F.col(f"__b.{c}")).otherwise(F.col(c)).alias(c)
    return rows.select("answer_id", "parameter", *[pick(c) for c in ("found", "value", "unit", "confidence", "reason")], F.col("__b").isNotNull().alias("again"))



def duplicate_uploads(uploads: DataFrame, documents: DataFrame) -> DataFrame:
    """Uploads (project, filename) whose name the project has already."""
    return uploads.join(documents, ["project", "filename"], "left_semi")


def backfilled_sources(log: DataFrame, documents: DataFrame) -> DataFrame:
    """log_id, sources: the sources (array of filename, doc_id) of a project's log rows, a missing doc_id taken from the project's
    documents (project, filename, doc_id) by name, the smallest where names repeat. Order and rows without sources stay."""
    ids = documents.groupBy("project", "filename").agg(F.min("doc_id").alias("__id"))
    rows = log.select("log_id", "project", F.posexplode_outer("sources").alias("at", "s")).withColumn("filename", F.col("s.filename")).join(ids, ["project", "filename"], "left")
    source = F.when(F.col("at").isNotNull(), F.struct("at", "filename", F.coalesce("s.doc_id", "__id").alias("doc_id")))
    return rows.groupBy("log_id").agg(F.transform(F.array_sort(F.collect_list(source)), lambda s: F.struct(s["filename"].alias("filename"), s["doc_id"].alias("doc_id"))).alias("sources"))


def result_json(rows: DataFrame, folder: str) -> None:
    """Writes a JSON line for each file with its results (file, parameter, ...) under `results`, in the order of parameters."""
    fields = F.struct("parameter", *[c for c in rows.columns if c not in ("file", "parameter")])
    rows.groupBy("file").agg(F.array_sort(F.collect_list(fields)).alias("results")).write.mode("overwrite").json(folder)
