"""Fuzzy matching of measurements to a catalog, checks against specifications, and reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import BROADCAST_ROWS, written

# What a match must reach, and the factors to its score.
MIN_SCORE, MIN_OVERLAP, AGREEMENT, BONUS = 0.30, 0.40, 0.05, 1.10
KEYWORD_BONUS, WRONG_DIRECTION, WRONG_SHEET = 1.20, 0.50, 0.70
#: White space that parts words, as the inside of a character class: that of Unicode.
WHITE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Distinct texts and catalog entries that one task compares.
TEXTS, ENTRIES = 20_000, 2_000
#: Answers for more than 1 / HOT_SHARE of all measurements are sent to all tasks: there are fewer than HOT_SHARE.
HOT_SHARE = 1_000
_BUCKETS = 64


def _tokens(text: Column) -> Column:
    """The distinct lower-case words, in the order of their code points."""
    return F.array_sort(F.array_distinct(F.array_remove(F.split(F.lower(text), f"[{WHITE}]+"), "")))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit of an integer for each character of the longer text."""
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    left = full
    for c in b:
        hit = left & places.get(c, 0)
        left = ((left + hit) | (left - hit)) & full
    return len(a) - left.bit_count()


def token_set_ratio(a: set[str], b: set[str]) -> float:
    """Similarity from 0 to 1 of two sets of words: the best ratio among what they share, and that with the rest of either.

    Texts are the sorted words joined by spaces, a ratio is 1 less insertions and deletions by both lengths. 1 where one set
    holds the other, 0 where one is empty.
    """
    shared, own, other = a & b, " ".join(sorted(a - b)), " ".join(sorted(b - a))
    if not a or not b:
        return 0.0
    if shared and (not own or not other):
        return 1.0
    base = len(" ".join(shared))
    space = base > 0
    with_own, with_other = base + space + len(own), base + space + len(other)
    both = with_own + with_other
    best = (both - (len(own) + len(other) - 2 * common_subsequence(own, other))) / both
    if not shared:
        return best
    return max(best, 2 * base / (base + with_own), 2 * base / (base + with_other))


def _profiles(texts: list[str]) -> np.ndarray:
    """How often each of _BUCKETS classes of characters occurs: the smaller counts of two texts sum to no less than their longest common subsequence."""
    out = np.zeros((len(texts), _BUCKETS), np.int32)
    for i, text in enumerate(texts):
        np.add.at(out[i], np.frombuffer(text.encode("utf-32-le"), "<u4") % _BUCKETS, 1)
    return out


def _ratios(texts: pa.Table, entries: pa.Table, least: float) -> pa.Table:
    """(tokens, entry_id, overlap, keyword_hit) of pairs that reach `least`.

    Texts that share a word with a name are found by their words; of the others those whose lengths and characters leave
    room for the ratio are compared.
    """
    strings = texts.column("tokens").to_pylist()
    sets, by_word = [set(s.split(" ")) - {""} for s in strings], {}
    for i, words in enumerate(sets):
        for w in words:
            by_word.setdefault(w, []).append(i)
    lengths, profiles = np.array([len(s) for s in strings], np.int64), _profiles(strings)
    out = []
    for entry, names in zip(entries.column("entry_id").to_pylist(), entries.column("names").to_pylist(), strict=True):
        best: dict[int, float] = {}
        for name in names:
            words, joined = set(name), " ".join(name)
            near = {i for w in words for i in by_word.get(w, ())}
            roomy = np.flatnonzero(2 * np.minimum(lengths, len(joined)) >= least * (lengths + len(joined)))
            room = 2 * np.minimum(profiles[roomy], _profiles([joined])).sum(1) >= least * (lengths[roomy] + len(joined))
            for i in near | set(roomy[room].tolist()):
                best[i] = max(best.get(i, 0.0), token_set_ratio(sets[i], words))
        for i, ratio in best.items():
            if ratio >= least:
                out.append((strings[i], entry, ratio, any(all(w in strings[i] for w in name) for name in names)))
    columns = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.float64(), pa.bool_()), strict=True)], names=["tokens", "entry_id", "overlap", "keyword_hit"])


def overlaps(texts: DataFrame, entries: DataFrame, n_texts: int, n_entries: int, least: float = MIN_OVERLAP) -> DataFrame:
    """tokens, entry_id, overlap and keyword_hit of pairs of `texts` (tokens) and `entries` (entry_id, names: arrays of words).

    The overlap is the best token-set ratio of an entry's names; it is a hit if all words of a name occur in the text. Each
    block of entries meets each part of the texts in a task of its own.
    """
    parts, blocks = max(1, -(-n_texts // TEXTS)), max(1, -(-n_entries // ENTRIES))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = texts.select("tokens", F.pmod(F.xxhash64("tokens"), F.lit(parts)).cast("int").alias("part"), numbers(blocks).alias("block"))
    right = entries.select("entry_id", "names", F.pmod(F.xxhash64("entry_id"), F.lit(blocks)).cast("int").alias("block"), numbers(parts).alias("part"))
    pairs = left.groupBy("part", "block").cogroup(right.groupBy("part", "block"))
    return pairs.applyInArrow(lambda t, e: _ratios(t, e, least), "tokens string, entry_id long, overlap double, keyword_hit boolean")


def fuzzy_match(measurements: DataFrame, catalog: DataFrame, min_score: float = MIN_SCORE, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """measure_id, entry_id, score, overlap, keyword_hit, direction_ok and sheet_ok: each measurement's best catalog entry, the
    smallest entry_id on ties, if it reaches min_score.

    measurements: measure_id, context_words, source_text, direction, sheet_type; catalog: entry_id, name, aliases, direction,
    sheet_types. The overlap is the greatest token-set ratio of context and source text and the name or an alias; below
    min_overlap an entry does not count. A fifth more, at most 1, if all words of a name occur in the text, half
    where directions differ (ANY fits all), 0.7 of it where the sheet's type is not among the entry's (UNKNOWN and none fit).
    Measurements with the same words, direction and type of sheet are scored once; the answers of frequent ones are sent to
    all tasks, so none is a hot key.
    """
    text = F.concat_ws(" ", F.array_join("context_words", " "), F.coalesce("source_text", F.lit("")))
    key = ["tokens", "way", "sheet_type"]
    m = measurements.select("measure_id", F.array_join(_tokens(text), " ").alias("tokens"), F.coalesce("direction", F.lit("ANY")).alias("way"), F.coalesce("sheet_type", F.lit("UNKNOWN")).alias("sheet_type"))
    asked = written(m.groupBy(*key).agg(F.count("*").alias("n")), "asked")
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    entries = catalog.select(F.col("entry_id").cast("long").alias("entry_id"), F.transform(names, _tokens).alias("names"), F.coalesce("direction", F.lit("ANY")).alias("entry_way"), F.coalesce("sheet_types", F.array().cast("array<string>")).alias("types"))
    entries = written(entries, "catalog")
    total, n_entries = asked.agg(F.sum("n")).first()[0] or 0, entries.count()
    texts = asked.select("tokens").where("tokens <> ''").distinct()
    near = overlaps(texts, entries.select("entry_id", "names"), texts.count(), n_entries, min_overlap)
    few = entries.drop("names")
    rows = asked.join(near, "tokens").join(F.broadcast(few) if n_entries <= BROADCAST_ROWS else few, "entry_id")
    rows = rows.withColumn("direction_ok", (F.col("entry_way") == "ANY") | (F.col("way") == "ANY") | (F.col("entry_way") == F.col("way")))
    rows = rows.withColumn("sheet_ok", (F.size("types") == 0) | (F.col("sheet_type") == "UNKNOWN") | F.array_contains("types", F.col("sheet_type")))
    score = F.when(F.col("keyword_hit"), F.least(F.lit(1.0), F.col("overlap") * KEYWORD_BONUS)).otherwise(F.col("overlap"))
    score = score * F.when(F.col("direction_ok"), 1.0).otherwise(WRONG_DIRECTION) * F.when(F.col("sheet_ok"), 1.0).otherwise(WRONG_SHEET)
    scored = rows.withColumn("score", F.bround(score, 4)).where(F.col("score") >= min_score)
    fields = ("entry_id", "score", "overlap", "keyword_hit", "direction_ok", "sheet_ok")
    best = scored.groupBy(*key, "n").agg(F.max_by(F.struct(*fields), F.struct("score", -F.col("entry_id"))).alias("b"))
    best = written(best.select(*key, "n", "b.entry_id", "b.score", F.bround("b.overlap", 4).alias("overlap"), "b.keyword_hit", "b.direction_ok", "b.sheet_ok"), "answers")
    frequent = F.col("n") * HOT_SHARE > total
    hot, cold = F.broadcast(best.where(frequent).drop("n")), best.where(~frequent).drop("n")
    found = m.join(hot, key).unionByName(m.join(hot, key, "left_anti").join(cold, key))
    return found.select("measure_id", *fields)


def best_candidates(matched: DataFrame, thresholds: DataFrame) -> DataFrame:
    """entry_id, measure_id, value, confidence: per entry the candidate with the best confidence * score, the smallest measure_id
    on ties; a tenth more confidence, at most 1, if another differs by at most 5 percent of the greater of its value and 1;
    entries below their threshold go. Entries with many candidates are no hot key: both steps combine before they shuffle."""
    first = F.struct(F.coalesce(-(F.col("confidence") * F.col("score")), F.lit(float("inf"))), "measure_id")
    best = matched.groupBy("entry_id").agg(F.min_by(F.struct("measure_id", "value", "confidence"), first).alias("b"), F.count("*").alias("n")).select("entry_id", "b.*", "n")
    best = written(best, "candidates")
    values = best.where("n > 1").select("entry_id", F.col("value").alias("__best"))
    near = F.abs(F.col("value") - F.col("__best")) <= AGREEMENT * F.greatest("__best", F.lit(1.0))
    beside = matched.select("entry_id", "value").join(F.broadcast(values) if best.count() <= BROADCAST_ROWS else values, "entry_id")
    agrees = beside.groupBy("entry_id").agg((F.count_if(near) > 1).alias("agreed"))
    lifted = best.drop("n").join(agrees, "entry_id", "left").withColumn("confidence", F.when(F.col("agreed"), F.least(F.lit(1.0), F.col("confidence") * BONUS)).otherwise(F.col("confidence")))
    return lifted.join(thresholds, "entry_id").where(F.col("confidence") >= F.col("threshold")).select("entry_id", "measure_id", "value", F.round("confidence", 6).alias("confidence"))


def spec_check(values: DataFrame, specs: DataFrame) -> DataFrame:
    """values (name, value) with status and delta against specs (name, spec_value, tolerance, direction MIN, MAX or EXACT)."""
    j = values.join(specs, "name", "left")
    delta = F.col("value") - F.col("spec_value")
    ok = F.when(F.col("direction") == "MIN", delta >= -F.col("tolerance")).when(F.col("direction") == "MAX", delta <= F.col("tolerance")).otherwise(F.abs(delta) <= F.col("tolerance"))
    return j.select(*values.columns, delta.alias("delta"), F.when(F.col("spec_value").isNull(), "NO_SPEC").when(ok, "MATCH").otherwise("CONFLICT").alias("status"))


def extraction_summary(report: DataFrame) -> DataFrame:
    """Per sheet: entries, extracted, not found, conflicts and the mean confidence of what is extracted."""
    return report.groupBy("sheet").agg(F.count("*").alias("n_entries"), F.count_if("found").alias("n_extracted"), F.count_if(~F.col("found")).alias("n_not_found"), F.count_if(F.col("status") == "CONFLICT").alias("n_conflicts"), F.round(F.avg(F.when(F.col("found"), F.col("confidence"))), 6).alias("mean_confidence"))


def batch_totals(summaries: DataFrame) -> DataFrame:
    """One row: sheets, extracted, conflicts and the mean of the sheets' mean confidences, a sheet without any as 0; 0 of no sheets."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    mean = F.coalesce(F.avg(F.coalesce("mean_confidence", F.lit(0.0))), F.lit(0.0))
    return summaries.agg(F.count("*").alias("n_sheets"), total("n_extracted"), total("n_conflicts"), F.round(mean, 6).alias("mean_confidence"))


def unmatched_report(measurements: DataFrame, matched: DataFrame) -> DataFrame:
    """Positive measurements (measure_id, value_mm, unit, source_text, x, y, layer, confidence) that are in no row of `matched`, rounded."""
    left = measurements.where("value_mm > 0").join(matched.select("measure_id"), "measure_id", "left_anti")
    return left.select("measure_id", F.bround("value_mm", 3).alias("value"), "unit", "source_text", F.bround("x", 2).alias("x"), F.bround("y", 2).alias("y"), "layer", F.bround("confidence", 3).alias("confidence"))
