"""Checks and repairs on decoded transcripts, responses and queue cards, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.numbers import valid_interval
from cadenza.functions.text import bound
from cadenza.operators.intervals import in_order, upto

#: Seconds that a word may end beyond its recording, and by which source words may overlap.
END_SLACK, SOURCE_SLACK = 0.25, 0.05
STATES = ("queued", "transcribing", "aligning", "done", "cached", "skipped", "error", "cancelled", "interrupted")
TEXT_FIELDS = "start double, end double, text string, probability double"


def word_is_valid(word: Column, duration: Column) -> Column:
    """A decoded word: an interval that ends with the recording, a text, and a finite probability or none."""
    p = word["probability"]
    fine = valid_interval(word["start"], word["end"]) & (word["end"] <= duration + END_SLACK) & word["text"].rlike(r"\S")
    return F.coalesce(fine, F.lit(False)) & (p.isNull() | (~F.isnan(p) & (F.abs(p) < float("inf"))))


def segment_is_valid(segment: Column, duration: Column) -> Column:
    """An interval with a text, all of whose words are valid."""
    words = F.coalesce(segment["words"], F.array())
    fine = valid_interval(segment["start"], segment["end"]) & (segment["end"] <= duration + END_SLACK) & segment["text"].rlike(r"\S")
    return F.coalesce(fine, F.lit(False)) & F.forall(words, lambda w: word_is_valid(w, duration))


def transcript_is_valid(segments: Column, duration: Column) -> Column:
    """One bad segment rejects the whole transcript."""
    return (duration > 0) & F.forall(segments, lambda s: segment_is_valid(s, duration))


def valid_transcripts(segments: DataFrame, duration: Column) -> DataFrame:
    """Segments (rec, start, end, text, words) to (rec, valid, n_segments, n_bad): one bad segment rejects its recording."""
    fine = segment_is_valid(F.struct("start", "end", "text", "words"), duration) & (duration > 0)
    return segments.withColumn("_ok", F.coalesce(fine, F.lit(False))).groupBy("rec").agg(F.bool_and("_ok").alias("valid"), F.count("*").alias("n_segments"), F.count_if(~F.col("_ok")).alias("n_bad"))


def flat_words(segments: DataFrame) -> DataFrame:
    """Segments (rec, words) to (rec, k, start, end, text): the valid words of a recording in one order, by their times."""
    words = segments.select("rec", F.explode("words").alias("_w")).select("rec", "_w.*")
    words = words.where(valid_interval(F.col("start"), F.col("end")) & (F.trim("text") != ""))
    k = F.row_number().over(Window.partitionBy("rec").orderBy("start", "end", "text")).cast("long")
    return words.withColumn("k", k).select("rec", "k", "start", "end", "text")


def zipped(a: Column, b: Column) -> Column:
    """Pairs (a, b) by position, or null where the arrays differ in length or one is null."""
    return F.when(F.size(a) == F.size(b), F.transform(a, lambda x, k: F.struct(x.alias("a"), F.get(b, k).alias("b"))))


def source_words_are_valid(words: DataFrame, start: Column, end: Column) -> DataFrame:
    """Per recording: may the source words stand in for aligned ones? All are intervals, in order and inside, to 0.05 s."""
    fine = valid_interval(F.col("start"), F.col("end")) & (F.col("start") >= F.coalesce(F.lag("end").over(in_order()), start) - SOURCE_SLACK)
    fine = fine & (F.col("start") >= start - SOURCE_SLACK) & (F.col("end") <= end + SOURCE_SLACK)
    return words.withColumn("_ok", F.coalesce(fine, F.lit(False))).groupBy("rec").agg(F.bool_and("_ok").alias("usable"))


def commits(middle: Column, start: Column, end: Column, is_final: Column) -> Column:
    """Half-open, but for the final window, which has what lies behind its end too."""
    return (start <= middle) & (is_final | (middle < end))


def committed_segments(segments: DataFrame, low: Column, high: Column) -> DataFrame:
    """Segments (.., start, end, text, words) that a window commits: by their words' middles, or, without words, by their own.

    Words outside are dropped, and a segment that has lost all its words with them; start, end and text then follow the words.
    """
    had = F.size(F.coalesce("words", F.array())) > 0
    own = F.filter("words", lambda w: ((w["start"] + w["end"]) / 2 >= low) & ((w["start"] + w["end"]) / 2 < high) & (w["end"] > w["start"]))
    middle = (F.col("start") + F.col("end")) / 2
    out = segments.withColumns({"_had": had, "_own": own})
    out = out.where(F.when(F.col("_had"), F.size("_own") > 0).otherwise((middle >= low) & (middle < high) & (F.col("end") > F.col("start"))))
    first, last = F.get("_own", F.lit(0))["start"], F.element_at("_own", -1)["end"]
    text = F.trim(F.array_join(F.transform("_own", lambda w: w["text"]), ""))
    new = {"start": first, "end": last, "text": text, "words": F.col("_own")}
    out = out.withColumns({c: F.when(F.col("_had"), x).otherwise(F.trim(c) if c == "text" else F.col(c)) for c, x in new.items()})
    return out.where("text != ''").drop("_had", "_own")


def classify_card(forced: Column, outputs: Column, sidecars: Column, expected: Column) -> Column:
    """Before any file is hashed: forced cards run, complete ones are candidates for the cache, others run."""
    return F.when(forced, "queued").when((outputs >= expected) & (sidecars >= expected), "candidate").otherwise("queued")


def admits_cache(present: Column, same_recognition: Column, same_layout: Column, broken: Column, width_waived: Column) -> Column:
    """A cached result holds if its files are there, both fingerprints agree, and the text breaks no rule, or only a width that was waived."""
    return present & same_recognition & same_layout & ((F.size(broken) == 0) | (width_waived & (F.size(F.array_remove(broken, "width")) == 0)))


def normal_state(state: Column) -> Column:
    """A known state in lower case, or queued."""
    clean = F.lower(F.trim(F.coalesce(state, F.lit(""))))
    return F.when(clean.isin(*STATES), clean).otherwise("queued")


def one_segment(text: Column, words: Column, duration: Column) -> Column:
    """A recogniser's output as segments: from its words' span, or its text over the whole recording; none without both."""
    span = F.struct(F.array_min(F.transform(words, lambda w: w["start"])).alias("start"), F.array_max(F.transform(words, lambda w: w["end"])).alias("end"), F.trim(text).alias("text"), words.alias("words"))
    whole = F.struct(F.lit(0.0).alias("start"), duration.alias("end"), F.trim(text).alias("text"), words.alias("words"))
    return F.when(F.size(words) > 0, F.array(span)).when(F.trim(text) != "", F.array(whole)).otherwise(F.filter(F.array(whole), lambda _: F.lit(False)))


def cleaned_tokens(tokens: Column, offset: Column, start: Column, end: Column) -> Column:
    """A worker's token rows moved by the window's offset; those without text, that aren't intervals or lie outside the segment are left out."""
    moved = F.transform(tokens, lambda x: F.struct((x["start"] + offset).alias("start"), (x["end"] + offset).alias("end"), x["text"].alias("text")))
    return F.filter(moved, lambda x: F.coalesce((x["text"] != "") & (x["end"] > x["start"]) & (x["start"] >= start) & (x["end"] <= end), F.lit(False)))


def remove_float_overlaps(df: DataFrame, step: float = 1e-9) -> DataFrame:
    """Starts moved to the end before where they lie under it, ends at least ``step`` behind their starts.

    end_i = max(end_i, start_i + step) as it was, carried on: with i the row's place, end_i - i * step is a running maximum.
    """
    w = in_order()
    i = (F.row_number().over(w) - 1) * step
    out = df.withColumn("_i", i).withColumn("_stop", F.col("_i") + F.max(F.greatest("end", F.col("start") + step) - F.col("_i")).over(upto(w)))
    return out.withColumns({"start": F.greatest("start", F.coalesce(F.lag("_stop").over(w), F.lit(0.0))), "end": F.col("_stop")}).drop("_i", "_stop")


def proportional_parts(text: Column, parts: Column) -> Column:
    """A text cut at the floor of k n / m: between words, or between characters where there are fewer words than parts; null where there are fewer of these too."""
    cut = lambda k, n: F.floor(k * n / parts).cast("int")
    places = F.sequence(F.lit(0), (parts - 1).cast("int"))

    def by_word(words: Column) -> Column:
        return F.transform(places, lambda k: F.array_join(F.slice(words, cut(k, F.size(words)) + 1, cut(k + 1, F.size(words)) - cut(k, F.size(words))), " "))

    def by_letter(words: Column) -> Column:
        # fewer words than parts: their letters as an array, so that a part is found without counting through those before
        return bound(F.split(F.array_join(words, ""), ""), lambda x: F.when(F.size(x) >= parts, F.transform(places, lambda k: F.array_join(F.slice(x, cut(k, F.size(x)) + 1, cut(k + 1, F.size(x)) - cut(k, F.size(x))), ""))))

    return bound(F.filter(F.split(text, r"\s+"), lambda x: x != ""), lambda words: F.when(F.size(words) >= parts, by_word(words)).when(F.size(words) > 0, by_letter(words)))


def signature(*parts: Column) -> Column:
    """Runtime parts in lower case, or null if one is missing."""
    clean = [F.nullif(F.lower(F.trim(p)), F.lit("")) for p in parts]
    return F.when(F.forall(F.array(*clean), lambda x: x.isNotNull()), F.array_join(F.array(*clean), "/"))


def milliseconds(seconds: Column) -> Column:
    """Rounded half to even; null for what is no number or too large for a long."""
    ms = F.rint(seconds * 1000)
    return F.when((F.abs(ms) < 2.0**63) & ~F.isnan(ms), ms.cast("long"))
