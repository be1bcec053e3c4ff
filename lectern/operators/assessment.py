"""Assessment and scheduling: grading, cards, distractors, spaced repetition, study plans."""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.ranks import ranked
from lectern.operators.retrieval import token_f1

#: Ids are whole numbers; groups are sorted in slices of so many.
SLICE = 4096


def grade(rows: DataFrame, kind: str, answer: str, expected: str, least: float = 0.78) -> DataFrame:
    """is_correct: objective kinds need the same normalised answer, open ones a token F1 of at least the mark. A null answer is wrong."""
    given, want = T.normalize_term(F.coalesce(answer, F.lit(""))), T.normalize_term(F.col(expected))
    words = lambda c: F.regexp_extract_all(c, F.lit("[a-z0-9]+"), F.lit(0))
    f1 = token_f1(F.col("__a"), F.col("__b"))
    return rows.withColumns({"__a": words(given), "__b": words(want)}).withColumn("f1", F.round(f1, 6)).withColumn("is_correct", F.when(F.col(kind) == "open", F.col("f1") >= least).otherwise(given == want)).drop("__a", "__b")


def cloze(sentences: DataFrame, sentence: str, term: str) -> DataFrame:
    """front and back: the first whole-word place of the term, whatever its case, is blanked out."""
    low = F.lower(F.col(sentence))
    padded = F.concat(F.lit(" "), F.regexp_replace(low, rf"[^\p{{L}}\p{{N}}_]", " "), F.lit(" "))
    at = F.instr(padded, F.concat(F.lit(" "), F.lower(term), F.lit(" ")))
    front = F.concat(F.substring(sentence, F.lit(1), at - 1), F.lit("____"), F.substring(sentence, at + F.length(term), F.length(sentence)))
    return sentences.withColumn("at", at).where("at > 0").withColumns({"front": front, "back": F.col(term)}).drop("at")


def distractors(terms: DataFrame, group: str, term: str, weight: str, most: int = 3) -> DataFrame:
    """(group, term, distractor, rank): for each term the next terms by weight around the group's ring that do not hold it nor are held by it.

    A ring of neighbours instead of all pairs: so many rows a term, whatever the group's size.
    """
    w = Window.partitionBy(group)
    k, n = F.row_number().over(w.orderBy(F.desc(weight), term)) - 1, F.count("*").over(w)
    ring = terms.select(group, term, k.alias("k"), n.alias("n"))
    near = ring.select(group, term, "n", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(3 * most), F.col("n") - 1)), lambda s: F.struct(s.alias("s"), ((F.col("k") + s) % F.col("n")).alias("k")))).alias("x")).where("n > 1").select(group, term, "x.s", "x.k")
    other = ring.select(group, F.col(term).alias("distractor"), "k")
    ok = near.join(other, [group, "k"]).where(~F.contains("distractor", term) & ~F.contains(term, "distractor"))
    rank = F.row_number().over(Window.partitionBy(group, term).orderBy("s")).cast("long")
    return ok.withColumn("rank", rank).where(F.col("rank") <= most).select(group, term, "distractor", "rank")


def blended_difficulty(label: Column, words: Column, frequency: Column, reasoning: Column) -> Column:
    """label 0 to 2, one more for each of: four words or more, a frequency of at most 1, two reasoning sentences or more; at most 2."""
    more = (words >= 4).cast("int") + (frequency <= 1).cast("int") + (reasoning >= 2).cast("int")
    return F.least(F.lit(2), F.greatest(F.lit(0), label + more))


QUALITY = {"again": 1, "hard": 3, "good": 4, "easy": 5}


def sm2_step(state: Column, q: Column) -> Column:
    """One review of quality q on (ease, interval, repetitions)."""
    ease = F.greatest(F.lit(1.3), state["ease"] + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02))
    again = q < 3
    interval = F.when(again, 1.0).when(state["repetitions"] == 0, 1.0).when(state["repetitions"] == 1, 6.0).otherwise(F.bround(state["interval"] * ease))
    return F.struct(ease.alias("ease"), interval.cast("double").alias("interval"), F.when(again, 0).otherwise(state["repetitions"] + 1).cast("int").alias("repetitions"))


def sm2_replay(reviews: DataFrame, *keys: str) -> DataFrame:
    """(keys, reviews, ease, interval, repetitions) after a card's reviews in order of time and id.

    A card's log is a short list, which is folded within the row.
    """
    known = F.create_map(*(F.lit(x) for p in QUALITY.items() for x in p))
    log = F.array_sort(F.collect_list(F.struct("reviewed_at", "review_id", F.try_element_at(known, "rating").alias("q"))))
    start = F.struct(F.lit(2.5).alias("ease"), F.lit(0.0).alias("interval"), F.lit(0).alias("repetitions"))
    state = F.aggregate("log", start, lambda s, r: sm2_step(s, r["q"]))
    rows = reviews.groupBy(*keys).agg(log.alias("log"))
    return rows.select(*keys, F.size("log").cast("long").alias("reviews"), state.alias("s")).select(*keys, "reviews", F.round("s.ease", 6).alias("ease"), F.col("s.interval").cast("long").alias("interval"), F.col("s.repetitions").cast("long").alias("repetitions"))


def study_topics(sections: DataFrame, accuracy: DataFrame) -> DataFrame:
    """sections with (weak, minutes, importance): minutes = max(15, round(10 pages x (1 + .75 weak))), x .9, 1 or 1.25 by difficulty; importance 1 + weak + .25 x. Topics without answers are not weak.

    sections has (topic, pages, difficulty 0 to 2, ...), accuracy (topic, accuracy %); topics meet whatever their case.
    """
    x = F.element_at(F.array(F.lit(0.9), F.lit(1.0), F.lit(1.25)), F.col("difficulty") + 1)
    weak = 1 - F.coalesce("accuracy", F.lit(100.0)) / 100
    joined = sections.join(accuracy.select(F.lower("topic").alias("t"), "accuracy"), F.lower("topic") == F.col("t"), "left")
    return joined.select(*sections.columns, F.round(weak, 6).alias("weak"), F.greatest(F.lit(15), F.bround(10 * F.col("pages") * x * (1 + 0.75 * weak)).cast("long")).alias("minutes"), F.round(1 + weak + 0.25 * x, 6).alias("importance"))


def type_quotas(rows: DataFrame, kind: str) -> DataFrame:
    """(kind, quota): the number of rows shared evenly among all kinds, the first ones get what is left over."""
    total = rows.agg(F.count("*").alias("total"))
    kinds = ranked(rows.select(F.col(kind).alias("kind")).distinct().withColumn("__all", F.lit(0)), ["__all"], F.substring("kind", 1, 2), [F.col("kind")], "i", "n")
    return kinds.crossJoin(F.broadcast(total)).select("kind", (F.expr("total div n") + (F.col("i") <= F.col("total") % F.col("n")).cast("int")).cast("long").alias("quota"))  # total is one row


def balance(rows: DataFrame, group: str, flag: str, id_col: str) -> DataFrame:
    """Of each group's true and false rows the larger class is cut to 7 // 3 of the other, so that neither share exceeds 70 %."""
    n = lambda v: F.count_if(F.col(flag) == v)
    counts = rows.groupBy(group).agg(n(True).alias("t"), n(False).alias("f"))
    placed = ranked(rows, [group, flag], F.floor(F.col(id_col) / SLICE), [F.col(id_col)], "r")
    most = F.when(F.col(flag), F.expr("7 * f div 3")).otherwise(F.expr("7 * t div 3"))
    return placed.join(counts, group).where(F.col("r") <= most).drop("r", "t", "f")


def exam_paper(questions: DataFrame, section: str, id_col: str, options: Column, marks: Column) -> DataFrame:
    """(section, number, id, option_letter, option, marks, section_marks)."""
    q = questions.select(section, id_col, options.alias("o"), marks.alias("marks"))
    q = ranked(q, [section], F.floor(F.col(id_col) / SLICE), [F.col(id_col)], "number").join(q.groupBy(section).agg(F.sum("marks").alias("section_marks")), section)
    rows = q.select(section, "number", id_col, "marks", "section_marks", F.posexplode("o").alias("p", "option"))
    return rows.select(section, "number", id_col, F.char(F.col("p") + 65).alias("option_letter"), "option", "marks", "section_marks")


def marking_scheme(questions: DataFrame, section: str, id_col: str, answer: Column, marks: Column) -> DataFrame:
    """(section, number, id, answer, marks, total_marks): a paper's answers, numbered as in exam_paper(), and the marks of the whole."""
    q = ranked(questions.select(section, id_col, answer.alias("answer"), marks.alias("marks")), [section], F.floor(F.col(id_col) / SLICE), [F.col(id_col)], "number")
    total = q.agg(F.sum("marks").alias("total_marks"))
    return q.crossJoin(F.broadcast(total)).select(section, "number", id_col, "answer", "marks", "total_marks")  # one row


def attempt_flags(attempts: DataFrame, questions: Column, limit_seconds: int, least_each: int = 3) -> DataFrame:
    """attempts (attempt_id, elapsed_seconds, ...) with late, beyond the limit, and suspicious, in less than so many seconds a question."""
    return attempts.withColumns({"late": F.col("elapsed_seconds") > limit_seconds, "suspicious": F.col("elapsed_seconds") < least_each * questions})


def study_plan(topics: DataFrame, key: str, days: int, daily_minutes: int) -> DataFrame:
    """(key, day, seq, topic, activity, minutes) of (key, topic, weak, importance, minutes).

    Topics go by weakness, importance and title. Those for which there is still time
    before the last two days are taken, the others have a row `omitted` without a
    day. Study fills day after day up to the daily minutes less those kept for
    revision (15, if 45 or more are given); a topic's first day ends in a quiz of up
    to 10 minutes. One, three and seven days on, 15 minutes of revision follow where
    they fit. A last or next to last day with nothing to revise gets the weakest topic.

    The order matters, so one learner's plan is made by one task; its rows are that
    learner's topics.
    """
    kind = topics.schema[key].dataType.simpleString()
    a_revision, per_day = min(15, daily_minutes), daily_minutes - min(15, max(0, daily_minutes - 30))
    last_study = days - 2 if days > 1 else 0

    def plan(frame: pd.DataFrame) -> pd.DataFrame:
        todo = sorted(frame.itertuples(), key=lambda r: (-r.weak, -r.importance, r.topic.casefold()))
        taken, omitted, left = [], [], last_study * per_day
        for r in todo:
            if r.minutes <= left:
                taken.append(r)
                left -= r.minutes
            else:
                omitted.append(r)
        held: dict[int, list[tuple[str | None, str, int]]] = {d: [] for d in range(days)}
        # the study minutes of all days are one line, which the topics cut in turn
        began, at = {}, 0
        for r in taken:
            first = at // per_day - (at > 0 and at % per_day == 0)  # a day that the topic before filled still counts
            began[r.Index], end = first, at + int(r.minutes)
            while at < end:
                day = at // per_day
                n = min(end, (day + 1) * per_day) - at
                quiz = min(10, n) if day == first else 0
                held[day] += [(r.topic, kind, m) for kind, m in (("read_summary", n - quiz), ("take_quiz", quiz)) if m]
                at += n
        for r in taken:
            for day in (began[r.Index] + gap for gap in (1, 3, 7)):
                if day < days and sum(x[2] for x in held[day]) + a_revision <= daily_minutes:
                    held[day].append((r.topic, "revise_weak_topic" if r.weak > 0 else "review_flashcards", a_revision))
        weakest = next((r.topic for r in taken if r.weak > 0), taken[0].topic if taken else None)
        for day in range(max(0, days - 2), days):
            held[day] = [x for x in held[day] if x[1] in ("review_flashcards", "revise_weak_topic")] or [(weakest, "revise_weak_topic" if weakest else "review_flashcards", a_revision)]
        rows = [(day, k, *x) for day in range(days) for k, x in enumerate(held[day])] + [(None, k, r.topic, "omitted", int(r.minutes)) for k, r in enumerate(omitted)]
        out = pd.DataFrame([(frame[key].iloc[0], *r) for r in rows], columns=[key, "day", "seq", "topic", "activity", "minutes"])
        return out.astype({"day": "Int32"})

    return topics.groupBy(key).applyInPandas(plan, f"{key} {kind}, day int, seq int, topic string, activity string, minutes int")
