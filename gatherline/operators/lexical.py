"""Lexical features per speaker or per window.

Counts add up over turns, so they are summed per row first and combined per key;
only vocabularies and n-grams are exploded, and they are counted per (key, word)
before anything is grouped per key. Phrases are counted inside turns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatherline.functions import lexicons as L
from gatherline.functions import text as T
from gatherline.functions.exprs import ratio
from gatherline.operators import windows
from gatherline.operators.groups import gini, herfindahl, z_within
from gatherline.operators.ordered import join_on, next_, ordered_scan


#: Characters of text whose n-grams one task counts.
CHARS_PER_TASK = 2_000_000


def _count_entropy(counts: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """From (keys, item, _n): total, unique, hapax and entropy in bits."""
    t = F.sum("_n")
    h = F.log2(t) - F.sum(F.col("_n") * F.log2("_n")) / t
    return counts.groupBy(*keys).agg(
        t.alias(f"n_{prefix}"), F.count(F.lit(1)).alias(f"unique_{prefix}"), F.count_if(F.col("_n") == 1).alias(f"hapax_{prefix}"),
        h.alias(f"{prefix}_entropy"))


def sized(df: DataFrame, keys: Sequence[str], text: str, per_task: int = CHARS_PER_TASK) -> tuple[DataFrame, int]:
    """``df`` and the number of tasks that its text fills, one a core at least. Where keys have more text than a task's share, ``_heavy`` tells their rows.

    The sizes are exact; the driver gets one row for each heavy key and one for all others.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    n = df.select(*[F.col(k).alias(a) for k, a in zip(keys, names, strict=True)], F.length(text).alias("_n")).groupBy(*names).agg(F.sum("_n").alias("_n"))
    found = n.groupBy(F.when(F.col("_n") > per_task, F.struct(*names)).alias("_key")).agg(F.sum("_n").alias("_n"))
    rows = found.toArrow()
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-sum(x or 0 for x in rows.column("_n").to_pylist()) // per_task))
    rows = rows.filter(rows.column("_key").is_valid())
    if not rows.num_rows:
        return df, parts
    heavy = df.sparkSession.createDataFrame(rows, found.schema).select("_key.*", F.lit(True).alias("_heavy"))
    same = [F.col(k).eqNullSafe(F.col(a)) for k, a in zip(keys, names, strict=True)]
    return df.join(F.broadcast(heavy), same, "left").drop(*names).withColumn("_heavy", F.col("_heavy").isNotNull()), parts


def item_entropy(df: DataFrame, keys: Sequence[str], items, prefix: str, parts: int | None = None) -> DataFrame:
    """Counts and entropy of the items of an array column per key.

    Rows that are dealt by key are counted where they are. Keys marked by ``sized`` are dealt by item, to ``parts`` tasks.
    """
    marked = [c for c in df.columns if c == "_heavy"]
    d = df.select(*keys, *marked, F.explode(items).alias("_item"))

    def counted(x):
        return _count_entropy(x.groupBy(*keys, "_item").agg(F.count(F.lit(1)).alias("_n")), keys, prefix)

    if not marked:
        return counted(d)
    return counted(d.filter(~F.col("_heavy"))).unionByName(counted(d.filter("_heavy").repartition(parts, *keys, "_item")))


def text_ngrams(df: DataFrame, keys: Sequence[str], text: str, n: int, prefix: str, per_task: int = CHARS_PER_TASK) -> DataFrame:
    """Counts and entropy of the n-grams inside the texts of each key.

    Texts are dealt by key, and cut into words and counted there, so the n-grams themselves are shuffled for heavy keys only.
    """
    d, parts = sized(df.select(*keys, text), keys, text, per_task)
    words = T.tokens(text).alias("_words")
    if "_heavy" not in d.columns:
        return item_entropy(d.repartition(parts, *keys).select(*keys, words), keys, T.ngrams("_words", n), prefix)
    light = d.filter(~F.col("_heavy")).repartition(parts, *keys).select(*keys, words)
    heavy = d.filter("_heavy").select(*keys, words, "_heavy")
    return item_entropy(light, keys, T.ngrams("_words", n), prefix).unionByName(item_entropy(heavy, keys, T.ngrams("_words", n), prefix, parts))


def with_following_words(df: DataFrame, keys: Sequence[str], order: Sequence, words: str, parts: int | None = None) -> DataFrame:
    """Add ``_next2``: up to two words that follow each non-empty turn, so n-grams may cross turns."""
    d = df.filter(F.size(words) > 0)
    ahead = F.when(F.col("_n1").isNotNull(), F.concat(F.col(words), F.array("_n1"))).otherwise(F.col(words))
    d = ordered_scan(d, keys, order, {"_n1": next_(F.element_at(F.col(words), 1))},
                     then=[({"_head": F.slice(ahead, 1, 2)}, {"_nh": next_("_head")})], parts=parts)
    return d.withColumn("_next2", F.coalesce("_nh", F.array().cast("array<string>"))).drop("_head", "_nh", "_n1")


def stream_ngrams(df: DataFrame, keys: Sequence[str], order: Sequence, words: str, text: str, per_task: int = CHARS_PER_TASK) -> DataFrame:
    """Unigram, bigram and trigram counts and entropies of the words of each key in order; ``text`` is what they were cut from."""
    d, parts = sized(df, keys, text, per_task)
    d = with_following_words(d, keys, order, words, parts)
    ext = lambda n: T.ngrams(F.concat(F.col(words), F.slice("_next2", 1, n - 1)), n)
    out = item_entropy(d, keys, F.col(words), "unigram", parts)
    for n, name in ((2, "bigram"), (3, "trigram")):
        out = out.join(item_entropy(d, keys, ext(n), name, parts), list(keys), "left")
    zero = [f"{a}_{n}" for n in ("bigram", "trigram") for a in ("n", "unique", "hapax")] + ["bigram_entropy", "trigram_entropy"]
    return out.fillna(0, zero)


def turn_counts(text: str, words: str, questions: str = "marks") -> dict[str, Column]:
    """Additive per-turn counts; ``questions`` picks the plain or the larger-of-two rule."""
    q = T.question_marks(text) if questions == "marks" else T.question_count(text)
    return {
        "word_count": F.size(words), "char_count": F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w)),
        "long_words": F.size(F.filter(words, lambda w: F.length(w) > 6)),
        "agreement_count": T.marker_count(words, L.AGREEMENT), "hedging_count": T.marker_count(words, L.HEDGING),
        "certainty_count": T.marker_count(words, L.CERTAINTY), "positive_count": T.marker_count(words, L.POSITIVE),
        "negative_count": T.marker_count(words, L.NEGATIVE), "question_count": q, "suggestion_count": T.suggestion_count(text),
        "i_count": T.marker_count(words, L.FIRST_SINGULAR), "we_count": T.marker_count(words, L.FIRST_PLURAL),
        **T.discourse_counts(words, text),
    }


def _summed(df: DataFrame, keys: Sequence[str], counts: dict[str, Column], more: Sequence[Column] = ()) -> DataFrame:
    d = df.withColumns({f"_t_{k}": v for k, v in counts.items()})
    return d.groupBy(*keys).agg(*[F.sum(f"_t_{k}").cast("long").alias(k) for k in counts], *more)


def speaker_lexicon(df: DataFrame, keys: Sequence[str], order: Sequence, text: str, duration: str) -> DataFrame:
    """Lexical profile per key (speaker and task): richness, diversity, markers, rates."""
    d = df.withColumn("_words", T.tokens(text))
    f = _summed(d, keys, turn_counts(text, "_words", "larger"), [F.sum(duration).alias("speaking_time_s")])
    f = f.join(stream_ngrams(d, keys, order, "_words", text), list(keys), "left")
    n = F.col("word_count")
    share = lambda c: F.coalesce(ratio(c, "word_count"), F.lit(0.0))
    minutes = F.when(F.col("speaking_time_s") > 0, F.col("speaking_time_s") / 60.0)
    both = F.col("positive_count") + F.col("negative_count")
    return f.withColumns({
        "ttr": share("unique_unigram"), "mean_word_len": share("char_count"), "long_word_ratio": share("long_words"), "hapax_ratio": share("hapax_unigram"),
        "bigram_diversity": F.coalesce(ratio("unique_bigram", "n_bigram"), F.lit(0.0)),
        "trigram_diversity": F.coalesce(ratio("unique_trigram", "n_trigram"), F.lit(0.0)), "agreement_rate": share("agreement_count"),
        "question_rate_per_min": F.coalesce(F.col("question_count") / minutes, F.lit(0.0)),
        "suggestion_rate_per_min": F.coalesce(F.col("suggestion_count") / minutes, F.lit(0.0)),
        "sentiment_ratio": F.when(both > 0, (F.col("positive_count") - F.col("negative_count")) / both).otherwise(0.0),
        "we_i_ratio": ratio("we_count", F.col("we_count") + F.col("i_count")),
    }).withColumn("word_count", n)


def lexical_windows(df: DataFrame, keys: Sequence[str], order: Sequence, text: str, onset: str, speaker: str, participants: Sequence[str], width: float) -> DataFrame:
    """Group text features per window 0..last, empty windows kept; balance and cohesion of turns."""
    d = windows.fixed_bins(df.filter(F.col(speaker).isin(*participants)), onset, width).withColumn("_words", T.tokens(text))
    wk = [*keys, "window_index"]
    counts = turn_counts(text, "_words")
    f = _summed(d, wk, counts, [F.count(F.lit(1)).alias("n_turns"), F.count_distinct(speaker).alias("n_speakers")])
    coh = windows.turn_cohesion(d, wk, order, "_words").groupBy(*wk).agg(F.avg("cohesion").alias("turn_cohesion"))
    grams = stream_ngrams(d, wk, order, "_words", text).select(*wk, F.col("unique_unigram").alias("unique_words"), "bigram_entropy", "trigram_entropy")
    grid = d.select(*wk).distinct().withColumn(speaker, F.explode(F.array(*[F.lit(p) for p in participants])))
    said = d.groupBy(*wk, speaker).agg(F.sum(F.size("_words")).cast("double").alias("_w"))
    said = join_on(grid, said, [*wk, speaker], "left").fillna(0.0, ["_w"])
    bal = gini(said, wk, "_w", "word_gini", None).join(herfindahl(said, wk, [speaker], F.sum("_w"), "word_hhi"), wk)
    last = d.groupBy(*keys).agg(F.max("window_index").alias("_last"))
    spine = last.withColumn("window_index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last")))).drop("_last")
    out = windows.zero_fill(spine, f.join(grams, wk, "left").join(coh, wk, "left").join(bal, wk, "left"), keys, [*counts, "n_turns", "n_speakers", "unique_words"])
    pos, neg = F.col("positive_count"), F.col("negative_count")
    some = F.col("word_count") > 0
    return out.withColumns({
        "ttr": ratio("unique_words", "word_count"), "mean_word_len": ratio("char_count", "word_count"), "long_word_ratio": ratio("long_words", "word_count"),
        "sentiment_ratio": F.when(some, (pos - neg) / (pos + neg + 1)), "social_composite": ratio(F.col("agreement_count") + pos, "word_count"),
        "we_i_ratio": ratio("we_count", F.col("we_count") + F.col("i_count")), "window_start_s": F.col("window_index") * F.lit(float(width)),
    })


def norm_scores(df: DataFrame, keys: Sequence[str], words, norms: DataFrame, word_col: str = "word", score: str = "score") -> DataFrame:
    """Mean, population sd and coverage of a word-norm table over the words of each key.

    The norms, one row per word, are joined to the words first (broadcast where their size allows, else a join
    that can be split at frequent words); sums per key combine before the only other shuffle.
    """
    w = df.select(*keys, F.explode(words).alias("_w"))
    j = w.join(norms.select(F.col(word_col).alias("_w"), F.col(score).cast("double").alias("_s")), "_w", "left")
    return j.groupBy(*keys).agg(F.avg("_s").alias("norm_mean"), F.stddev_pop("_s").alias("norm_sd"), (F.count("_s") / F.count(F.lit(1))).alias("norm_coverage"))


def lexical_composites(df: DataFrame, social: Sequence[str], complexity: Sequence[str], words: str) -> DataFrame:
    """Whole-table z composites (population sd): social, complexity, log word count."""
    from gatherline.functions.exprs import row_mean

    cols = [*social, *complexity]
    d = df.withColumn("_log", F.log1p(words))
    d = z_within(d, [], [*cols, "_log"], "_cz", population=True, zero_neutral=False)
    return d.withColumns({
        "social_z": row_mean([f"{c}_cz" for c in social]), "complexity_z": row_mean([f"{c}_cz" for c in complexity]), "verbosity_z": F.col("_log_cz"),
    }).drop("_log", "_log_cz", *[f"{c}_cz" for c in cols])


def relabel_overlaps(events: DataFrame, segments: DataFrame, keys: Sequence[str], event_id: str, onset: str, end: str, speaker: str, text: str) -> DataFrame:
    """Timing class and context label of each overlap event from the speech around it.

    A completion needs another speaker's segment that trails off and ends between 1.5 s
    before and 0.3 s after the event's onset.
    """
    from gatherline.operators.interaction import timing_class
    from gatherline.operators.intervals import within_join
    from gatherline.operators.joins import surrounding_segments

    s = surrounding_segments(events, segments, keys, event_id, onset, end, [text])
    diff = F.abs(F.col(f"seg_b.{onset}") - F.col(f"seg_a.{onset}")) * 1000.0
    s = s.withColumn("timing", timing_class((F.col(end) - F.col(onset)) * 1000.0, diff))
    trail = segments.filter(T.trails_off(text)).select(*keys, F.col(speaker).alias("_ts"), F.col(end).alias("_te"))
    span = events.select(*keys, event_id, speaker, (F.col(onset) - 1.5).alias("_a"), (F.col(onset) + 0.3).alias("_z"))
    done = within_join(trail, span, keys, "_te", ("_a", "_z"), 4.0, closed=True, extra=F.col("_ts") != F.col(speaker))
    done = done.select(*keys, event_id).distinct().withColumn("completion", F.lit(True))
    s = join_on(s, done, [*keys, event_id], "left").withColumn("completion", F.coalesce("completion", F.lit(False)))
    return s.withColumn("context", T.context_label("timing", f"seg_a.{text}", f"seg_b.{text}", "completion"))


def dialogue_acts(df: DataFrame, text: str) -> DataFrame:
    """Hits of each act per row, scaled by the number of its cues and at most 1, and the ``dominant`` act.

    The text is lowered once and the hits counted once; the choice works on the counts.
    """
    acts = list(L.ACT_CUES)
    d = df.withColumn("_low", F.lower(text)).withColumns(T.act_scores("_low", lowered=True))
    dominant = T.dominant_act({a: F.col(a) for a in acts})
    scaled = {a: F.least(F.lit(1.0), F.col(a) / F.lit(float(len(L.ACT_CUES[a])))) for a in acts}
    return d.withColumn("dominant", dominant).withColumns(scaled).drop("_low")
