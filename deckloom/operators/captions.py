"""Speech units and captions: what is said in one breath, and what stands on one line."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from deckloom.functions.arrays import first_above, halvings, running
from deckloom.functions.intervals import meet
from deckloom.functions.text import bound, stripped
from deckloom.operators.narration import PAGE, estimate_duration, thousandths

# Words that begin a new movement of a script.
TURNS = (
    "但是", "不过", "反过来", "另一方面", "接下来", "回到", "所以", "因此", "第一", "第二", "第三", "首先", "其次", "最后", "总的来说", "换句话说",
)
# Silence before an emphasised sentence, one that turns, and any other.
PAUSE_EMPHASIS, PAUSE_TURN, PAUSE_SENTENCE = 1.20, 0.95, 0.75
# Marks at which a caption may break, and marks that captions leave out at their ends.
BREAKS = "，,。！？!?；;…"
EDGES = "，,。！？!?；;、：:…—－·「」『』（）()《》〈〉【】\"'“”‘’ "
LINE, LEAST_CUE, AUDIBLE = 28, 0.8, 0.45


def _class(marks: str) -> str:
    return "[" + "".join("\\" + c if c in "[]()-\\^\"'" else c for c in marks) + "]"


def beat_before(text: Column, emphasis: Column, turns: Sequence[str] = TURNS) -> Column:
    """TIM-2: seconds of silence that a sentence asks for before it: emphasis, then a turn in its first 4 characters; else
    0."""
    head = F.substring(F.regexp_replace(text, "^[　 \t]+", ""), 1, 4)
    turn = head.rlike("^(?:" + "|".join(w for w in turns if len(w) <= 4) + ")")
    return F.when(emphasis, PAUSE_EMPHASIS).when(turn, PAUSE_TURN).otherwise(0.0)


def plan_units(segments: DataFrame, turns: Sequence[str] = TURNS, short: float = 2.2, longest: float = 15.0) -> DataFrame:
    """TIM-1, TIM-2: ``unit_seq, pause_before`` for each sentence ``seg_seq, text, emphasis``.

    A sentence opens a unit if it asks for a pause, if the unit before it has ``short`` seconds or would pass
    ``longest``. The time spent starts again with each unit, so the sentences of a scene are folded in order; a scene is
    small. The first unit has no pause. Null emphasis is none.
    """
    beat = beat_before(F.col("text"), F.coalesce("emphasis", F.lit(False)), turns)
    weight = F.greatest(estimate_duration(F.col("text")), F.lit(0.05))
    rows = segments.select(*PAGE, F.struct("seg_seq", weight.alias("w"), beat.alias("beat")).alias("s"))
    rows = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list("s")).alias("s"))
    kind = "struct<out:array<struct<seg_seq:int,unit_seq:int,pause_before:double>>,unit:int,spent:double>"
    start = F.struct(F.array().alias("out"), F.lit(0).alias("unit"), F.lit(0.0).alias("spent")).cast(kind)

    def step(state: Column, s: Column) -> Column:
        first = state["unit"] == 0
        opens = first | (s["beat"] > 0) | (state["spent"] >= short) | (state["spent"] + s["w"] > longest)
        unit = F.when(opens, state["unit"] + 1).otherwise(state["unit"])
        pause = F.when(first | ~opens, 0.0).when(s["beat"] > 0, s["beat"]).otherwise(PAUSE_SENTENCE)
        row = F.struct(s["seg_seq"].alias("seg_seq"), unit.alias("unit_seq"), pause.alias("pause_before"))
        spent = F.when(opens, s["w"]).otherwise(state["spent"] + s["w"])
        return F.struct(F.concat(state["out"], F.array(row)).alias("out"), unit.alias("unit"), spent.alias("spent")).cast(kind)

    return rows.select(*PAGE, F.inline(F.aggregate("s", start, step)["out"]))


def unit_texts(segments: DataFrame, planned: DataFrame) -> DataFrame:
    """TIM-1: ``unit_seq, pause_before, text`` of units: their sentences one after the other."""
    rows = segments.join(planned, [*PAGE, "seg_seq"])
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_seq", "text"))), lambda s: s["text"]), "")
    return rows.groupBy(*PAGE, "unit_seq").agg(F.max("pause_before").alias("pause_before"), said.alias("text"))


def match_boundaries(expected: DataFrame, pauses: DataFrame, bonus: float = 1.0) -> DataFrame:
    """TIM-6: ``seg_seq, at``: a pause for each boundary ``seg_seq, expected``, in order, so that distance less ``bonus``
    times the pause's length is smallest in sum; the earlier pause on ties.

    A scene with fewer pauses than boundaries gives no rows. Pauses ``end, duration`` lie in the scene. A scene's boundaries are
    few, so each scene is matched in one row, and scenes go to Python many at a time.
    """

    def assign(want: np.ndarray, middle: np.ndarray, length: np.ndarray) -> np.ndarray:
        n, m = len(want), len(middle)
        if m < n:
            return np.zeros(0)
        # best[j]: least cost of the boundaries from i on with the pauses from j on.
        best, takes, own = np.zeros(m + 1), np.zeros((n, m), dtype=bool), bonus * length
        for i in range(n - 1, -1, -1):
            use = np.abs(middle - want[i]) - own + best[1:]
            best = np.append(np.minimum.accumulate(use[::-1])[::-1], np.inf)
            takes[i] = use <= best[1:]
        picked, j = np.zeros(n), 0
        for i in range(n):
            j += int(np.argmax(takes[i, j:]))
            picked[i] = middle[j]
            j += 1
        return picked

    @F.pandas_udf(ArrayType(DoubleType()))
    def assigned(want: pd.Series, middle: pd.Series, length: pd.Series) -> pd.Series:
        return pd.Series([assign(*x) for x in zip(want, middle, length, strict=True)], dtype=object)

    a = expected.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("seg_seq", "expected"))).alias("__b"))
    p = pauses.select(*PAGE, F.struct((F.col("end") - F.col("duration") / 2).alias("m"), F.col("duration").alias("d")).alias("p"))
    p = p.groupBy(*PAGE).agg(F.array_sort(F.collect_list("p")).alias("__p"))
    rows = a.join(p, PAGE).select(*PAGE, F.col("__b.seg_seq").alias("s"), assigned(F.col("__b.expected"), F.col("__p.m"), F.col("__p.d")).alias("at"))
    return rows.filter(F.size("at") > 0).select(*PAGE, F.inline(F.arrays_zip("s", "at")).alias("seg_seq", "at"))


def caption_parts(text: Column, line: int = LINE) -> Column:
    """LAY-1: clauses without the marks around them, those over a line cut in equal parts: ``text, at_mark``."""
    clauses = F.filter(F.transform(F.split(text, f"(?<={_class(BREAKS)})"), lambda c: F.btrim(c, F.lit(EDGES))), lambda c: c != "")

    def cut(c: Column) -> Column:
        n = F.length(c)
        size = F.ceil(n / F.ceil(n / line)).cast("int")
        part = lambda i, k: F.struct(F.substring(c, i * k + 1, k).alias("text"), (i == 0).alias("at_mark"))
        pieces = bound(size, lambda k: F.transform(F.sequence(F.lit(0), F.ceil(n / k).cast("int") - 1), lambda i: part(i, k)))
        return F.when(n <= line, F.array(F.struct(c.alias("text"), F.lit(True).alias("at_mark")))).otherwise(pieces)

    return F.flatten(F.transform(clauses, cut))


def chunk_captions(segments: DataFrame, line: int = LINE) -> DataFrame:
    """LAY-1: ``cue_seq, text`` of each sentence: clauses are put on one line, with a space between, while they fit and
    begin at a mark. A text of marks alone stays as it is; a blank or null one gives none."""
    rows = segments.withColumn("__t", stripped(F.col("text"))).filter("__t <> ''")
    rows = rows.select(*PAGE, "seg_seq", F.posexplode(_lines(F.col("__t"), line)).alias("i", "text"))
    return rows.select(*PAGE, "seg_seq", (F.col("i") + 1).alias("cue_seq"), "text")


def _lines(text: Column, line: int) -> Column:
    """The captions of a stripped text, bound, as a generator works its columns out anew wherever they are used."""
    empty = F.array().cast("array<string>")

    def step(out: Column, part: Column) -> Column:
        last = F.element_at(out, -1)
        joins = (F.size(out) > 0) & part["at_mark"] & (F.length(last) + 1 + F.length(part["text"]) <= line)
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat_ws(" ", last, part["text"])))
        return F.when(F.size(out) == 0, F.array(part["text"])).when(joins, joined).otherwise(F.concat(out, F.array(part["text"])))

    return bound(F.aggregate(caption_parts(text, line), empty, step), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(text)))


def timed_lines(text: Column, start: Column, end: Column, line: int = LINE, least: float = LEAST_CUE) -> Column:
    """LAY-1 and LAY-2 of a sentence in its row: its captions ``cue_seq, start, end, text`` in order, by the steps of ``caption_times``;
    none if the sentence is blank or has no span."""
    span = end - start

    def timed(lines: Column, w: Column, to: Column) -> Column:
        at = lambda c: thousandths(start + span * c / F.get(to, F.size(to) - 1))
        return F.transform(lines, lambda t, i: F.struct((i + 1).alias("cue_seq"), at(F.get(to, i) - F.get(w, i)).alias("start"), at(F.get(to, i)).alias("end"), t.alias("text")))

    def weighed(lines: Column) -> Column:
        chars = F.aggregate(lines, F.lit(0), lambda n, t: n + F.length(t))
        share = lambda t, n: F.greatest(span * F.length(t) / n, F.least(F.lit(least), span / F.size(lines)))
        weights = bound(chars, lambda n: F.transform(lines, lambda t: F.floor(share(t, n) * 1e6).cast("long")))
        return bound(weights, lambda w: bound(running(w), lambda to: timed(lines, w, to)))

    said = F.filter(F.array(stripped(text)), lambda t: (t != "") & (end > start))
    return F.flatten(F.transform(said, lambda t: bound(_lines(t, line), weighed)))


def timed_captions(sentences: DataFrame) -> DataFrame:
    """LAY-1 and LAY-2 of sentences that hold their ``start, end``: ``cue_seq, start, end, text`` beside the other columns; no caption moves."""
    kept = [c for c in sentences.columns if c not in ("text", "start", "end")]
    return sentences.select(*kept, F.inline(timed_lines(F.col("text"), F.col("start"), F.col("end"))))


def page_captions(sentences: Column) -> Column:
    """The captions of a page's sentences in order: ``seg_seq, cue_seq, start, end, text``."""
    own = lambda s: F.transform(
        timed_lines(s["text"], s["start"], s["end"]), lambda c: F.struct(s["seg_seq"].alias("seg_seq"), *[c[k].alias(k) for k in ("cue_seq", "start", "end", "text")])
    )
    return F.flatten(F.transform(sentences, own))


def split_on_pages(pages: DataFrame, audible: float = AUDIBLE, least: float = LEAST_CUE) -> DataFrame:
    """LAY-1 to LAY-3 of pages that hold their ``sentences`` (``seg_seq, text, start, end``) and ``pauses`` (``end, duration``): a
    caption finds the first audible pause after its beginning by halving, in its own row, so nothing moves."""
    heard = F.filter("pauses", lambda p: p["duration"] >= audible)
    rows = pages.select(*PAGE, "sentences", F.array_sort(F.transform(heard, lambda p: p["end"] - p["duration"] / 2)).alias("__pauses"))
    # Outer, as Spark would else ask beforehand if a page has sentences, and so split its text twice; pages without any give no captions.
    rows = rows.select(*PAGE, "__pauses", halvings(F.size("__pauses")).alias("__steps"), F.inline_outer("sentences"))
    at = first_above(F.col("__pauses"), F.col("__steps"), F.col("start") + least)
    rows = timed_captions(rows).withColumn("__at", at).drop("__pauses", "__steps")
    return _cut(rows.withColumn("__at", F.when(F.col("__at") < F.col("end") - least, F.col("__at"))))


def caption_times(captions: DataFrame, times: DataFrame, least: float = LEAST_CUE) -> DataFrame:
    """LAY-2: ``start, end`` of captions within their sentence's ``start, end``.

    Shares follow the lengths, with a floor of ``least`` seconds or an equal part, then are scaled to the sentence. They
    are whole microseconds, so sums don't depend on order. Sentences without a span give none.
    """
    key = [*PAGE, "seg_seq"]
    t = times.select(*key, F.col("start").alias("__s"), F.col("end").alias("__e")).filter("__e > __s")
    rows = captions.join(t, key)
    whole, run = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("cue_seq")
    span = F.col("__e") - F.col("__s")
    rows = rows.withColumns({"__n": F.count("*").over(whole), "__chars": F.sum(F.length("text")).over(whole)})
    share = F.greatest(span * F.length("text") / F.col("__chars"), F.least(F.lit(least), span / F.col("__n")))
    rows = rows.withColumn("__w", F.floor(share * 1e6).cast("long"))
    rows = rows.withColumns({"__to": F.sum("__w").over(run), "__all": F.sum("__w").over(whole)})
    at = lambda c: thousandths(F.col("__s") + span * c / F.col("__all"))
    return rows.select(*key, "cue_seq", at(F.col("__to") - F.col("__w")).alias("start"), at(F.col("__to")).alias("end"), "text")


def split_at_pauses(cues: DataFrame, pauses: DataFrame, audible: float = AUDIBLE, least: float = LEAST_CUE) -> DataFrame:
    """LAY-3: ``part, start, end, text``: a caption with an audible pause inside is cut at the space nearest to it.

    The first pause in time counts, if it leaves ``least`` seconds on both sides; a caption without a space stays. The join is
    by scene and buckets of time.
    """
    key = [*PAGE, "seg_seq", "cue_seq"]
    p = pauses.filter(F.col("duration") >= audible).select(*PAGE, (F.col("end") - F.col("duration") / 2).alias("__at"))
    inside = (F.col("start") + least < F.col("__at")) & (F.col("__at") < F.col("end") - least)
    first = meet(p, cues.select(*key, "start", "end"), PAGE, "__at", "start", "end").filter(inside).groupBy(*key).agg(F.min("__at").alias("__at"))
    return _cut(cues.join(first, key, "left"))


def _cut(rows: DataFrame) -> DataFrame:
    """Captions, those with a moment ``__at`` cut at the space nearest to it."""
    key = [*PAGE, "seg_seq", "cue_seq"]
    share = (F.col("__at") - F.col("start")) / F.greatest(F.col("end") - F.col("start"), F.lit(0.001))
    places = F.filter(F.sequence(F.lit(0), F.length("text") - 1), lambda i: F.substring(F.col("text"), i + 1, F.lit(1)) == " ")
    near = F.array_min(F.transform(places, lambda i: F.struct(F.abs(i / F.length("text") - F.col("__share")).alias("d"), i.alias("i"))))["i"]
    rows = rows.withColumn("__share", share).withColumn("__cut", F.when(F.col("__at").isNotNull() & F.contains("text", F.lit(" ")), near))
    at = thousandths(F.col("__at"))
    part = lambda n, a, b, t: F.struct(F.lit(n).alias("part"), a.alias("start"), b.alias("end"), t.alias("text"))
    left = part(1, F.col("start"), at, F.substring(F.col("text"), F.lit(1), F.col("__cut")))
    right = part(2, at, F.col("end"), F.substring(F.col("text"), F.col("__cut") + 2, F.length("text")))
    kept = part(1, F.col("start"), F.col("end"), F.col("text"))
    return rows.select(*key, F.inline(F.when(F.col("__cut").isNull(), F.array(kept)).otherwise(F.array(left, right))))
