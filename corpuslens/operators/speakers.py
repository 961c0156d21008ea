"""Recordings: words of captions, long segments split, speakers named by captions that overlap them and by what is known of the talk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import transcripts

#: A segment's most seconds and the least before a cut; the share of overlapped seconds that names a speaker; the share of the talk
#: that makes a main voice.
LONGEST, EARLIEST, SHARE, MAIN = 15.0, 8.0, 0.6, 0.08
#: Seconds of a bucket in which segments meet captions.
BUCKET = 16
#: Roles in the order in which they are given.
ROLES = ("interviewer", "interviewee")


def cue_words(cues: DataFrame, rec: str = "rec") -> DataFrame:
    """(rec, cue, n, word, start, end, speaker) of cues (rec, cue, start, end, text, speaker): a cue's words spread evenly over its time, times to
    hundredths. Cues without a word give none."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    rows = cues.select(rec, "cue", "start", "end", "speaker", F.size(words).alias("size"), F.posexplode(words).alias("n", "word"))
    step = (F.col("end") - F.col("start")) / F.col("size")
    at = lambda k: F.round(F.col("start") + k * step, 2)
    return rows.select(rec, "cue", "n", "word", at(F.col("n")).alias("start"), at(F.col("n") + 1).alias("end"), "speaker")


def cut_places(word: list[str], start: np.ndarray, end: np.ndarray, longest: float = LONGEST, earliest: float = EARLIEST) -> list[int]:
    """Where a segment's words are cut so that no piece takes over `longest` seconds: behind the last word that ends a sentence or clause
    at `earliest` seconds or later; else at the longest pause there, the last of equal ones; else before the word that goes over."""
    n = len(word)
    stop = np.array([w[-1:] in tuple(".?!,;") for w in word], dtype=bool)
    pause = np.append(start[1:] - end[:-1], 0.0)
    out, a = [], 0
    while a < n:
        over = np.flatnonzero(end[a:] - start[a] > longest)
        b = max(a + int(over[0]), a + 1) if len(over) else n  # one word may be longer than that
        if b >= n:
            break
        inside = np.arange(a, b - 1)
        late = inside[end[inside] - start[a] >= earliest]
        ends = late[stop[late]]
        if len(ends):
            b = int(ends[-1]) + 1
        elif len(late):
            b = int(late[np.flatnonzero(pause[late] == pause[late].max())[-1]]) + 1
        out.append(b)
        a = b
    return out


def split_segments(words: DataFrame, rec: str = "rec", longest: float = LONGEST) -> DataFrame:
    """(rec, seg, piece, first, last, start, end, text) of words (rec, seg, n, word, start, end): segments in pieces of `longest` seconds at most. A
    segment's words meet in one row, a recording's never do."""
    kind, seg_kind = words.schema[rec].dataType.simpleString(), words.schema["seg"].dataType.simpleString()
    whole = words.groupBy(rec, "seg").agg(F.array_sort(F.collect_list(F.struct("n", "word", F.col("start").cast("double").alias("s"), F.col("end").cast("double").alias("e")))).alias("w"))
    types = [("piece", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("start", pa.float64()), ("end", pa.float64()), ("text", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, w in enumerate(batch.column(2).to_pylist()):
                text, start, end = [x["word"] or "" for x in w], np.array([x["s"] for x in w]), np.array([x["e"] for x in w])
                cuts = [0, *cut_places(text, start, end, longest), len(w)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    at.append(i)
                    rows.append((k, w[a]["n"], w[b - 1]["n"], float(start[a]), float(end[b - 1]), " ".join(text[a:b])))
            take = pa.array(at, pa.int32())
            columns = [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *columns], [rec, "seg", *(n for n, _ in types)])

    return whole.select(rec, "seg", "w").mapInArrow(run, f"{rec} {kind}, seg {seg_kind}, piece int, first long, last long, start double, end double, text string")


def caption_votes(segments: DataFrame, cues: DataFrame, rec: str = "rec") -> DataFrame:
    """(rec, sid, name, seconds) of segments (rec, sid, start, end) and cues (rec, start, end, speaker): for how many seconds a speaker's segments
    overlap cues under a name. Both are dealt by buckets of time, so that a long recording is many tasks' work; an overlap counts in the
    first bucket that both share."""
    a = segments.select(rec, "sid", F.col("start").cast("double").alias("lo"), F.col("end").cast("double").alias("hi"))
    b = cues.where("speaker <> ''").select(rec, F.col("speaker").alias("name"), F.col("start").cast("double").alias("s"), F.col("end").cast("double").alias("e"))
    both = transcripts.overlapping(a.where("hi > lo"), b.where("e > s"), rec, BUCKET)
    return both.groupBy(rec, "sid", "name").agg(F.sum(F.least("hi", "e") - F.greatest("lo", "s")).alias("seconds"))


def named_speakers(segments: DataFrame, cues: DataFrame, known: DataFrame, intake: DataFrame, rec: str = "rec") -> DataFrame:
    """(rec, sid, name, how) for every speaker of segments (rec, sid, start, end, text).

    how: voice, a name known before (known: rec, sid, name); caption, the name whose cues overlap the speaker longest, if those are 60 % of
    all overlapped seconds and nobody has the name yet, the speaker heard first before others; intake (intake: rec, interviewer, interviewee), for main
    voices, of 8 % of the talk or more, that have no name: with both names free the two who talk most get them, the one with the larger
    share of segments that end in a question mark asks (of equals the one who talks more), a single free name goes to the one who talks
    most; else unnamed, "Speaker 1" and so on in the order in which they are heard. A recording's speakers, not its segments, meet in
    one place."""
    length = F.col("end") - F.col("start")
    asks = F.rtrim(F.coalesce("text", F.lit(""))).endswith("?")
    people = segments.groupBy(rec, "sid").agg(F.sum(length).cast("double").alias("talk"), F.avg(asks.cast("double")).alias("rate"), F.min("start").alias("since"))
    voice = known.where("name <> ''").select(rec, "sid", F.col("name").alias("voice"))
    people = people.join(voice, [rec, "sid"], "left")
    votes = caption_votes(segments, cues, rec)
    best = votes.groupBy(rec, "sid").agg(F.max_by(F.struct("name", "seconds"), F.struct("seconds", F.col("name"))).alias("b"), F.sum("seconds").alias("all")).where(F.col("b.seconds") >= SHARE * F.col("all"))
    open_ = people.where("voice is null").join(best.select(rec, "sid", F.col("b.name").alias("caption")), [rec, "sid"])
    open_ = open_.join(voice.select(rec, F.col("voice").alias("caption")), [rec, "caption"], "left_anti")
    first = Window.partitionBy(rec, "caption").orderBy("since", "sid")
    once = open_.withColumn("k", F.row_number().over(first)).where("k = 1").select(rec, "sid", "caption")
    people = people.join(once, [rec, "sid"], "left").withColumn("name", F.coalesce("voice", "caption"))
    # by recording: what is free, and who may get it
    w, by_talk = Window.partitionBy(rec), Window.partitionBy(rec).orderBy(F.desc("talk"), "sid")
    people = people.withColumns({"all": F.sum("talk").over(w), "names": F.collect_set("name").over(w)}).join(intake.select(rec, *ROLES), rec, "left")
    free = F.filter(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("name")) for r in ROLES]), lambda x: F.coalesce(x["name"] != "", F.lit(False)) & ~F.array_contains("names", x["name"]))
    main = F.col("name").isNull() & (F.col("talk") >= MAIN * F.col("all"))
    people = people.withColumns({"free": free, "place": F.sum(main.cast("int")).over(by_talk.rowsBetween(Window.unboundedPreceding, 0)), "main": main})
    two = F.col("main") & (F.col("place") <= 2)
    rates = F.collect_list(F.when(two, F.struct("place", "rate"))).over(w)
    people = people.withColumns({"mains": F.count_if("main").over(w), "rates": F.array_sort(rates)})
    asker = F.when(F.get("rates", F.lit(0))["rate"] >= F.get("rates", F.lit(1))["rate"], 1).otherwise(2)
    both = (F.size("free") == 2) & (F.col("mains") >= 2)
    given = F.when(two & both, F.when(F.col("place") == asker, F.get("free", F.lit(0))["name"]).otherwise(F.get("free", F.lit(1))["name"]))
    given = F.when((F.size("free") == 1) & F.col("main") & (F.col("place") == 1), F.get("free", F.lit(0))["name"]).otherwise(given)
    people = people.withColumn("given", given)
    nobody = F.col("name").isNull() & F.col("given").isNull()
    n = F.sum(nobody.cast("int")).over(Window.partitionBy(rec).orderBy("since", "sid").rowsBetween(Window.unboundedPreceding, 0))
    how = F.when(F.col("voice").isNotNull(), "voice").when(F.col("caption").isNotNull(), "caption").when(F.col("given").isNotNull(), "intake").otherwise("unnamed")
    return people.withColumn("n", n).select(rec, "sid", F.coalesce("name", "given", F.concat(F.lit("Speaker "), F.col("n").cast("string"))).alias("name"), how.alias("how"))
