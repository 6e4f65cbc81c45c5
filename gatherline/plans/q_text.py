"""Queries over text, vectors and speech segments."""

from pyspark.sql import functions as F

from gatherline.functions import exprs as X
from gatherline.functions import lexicons as L
from gatherline.functions import normalise as N
from gatherline.functions import text as T
from gatherline.operators import lexical, segments
from gatherline.plans.bindings import ANNOTATIONS, TURNS, annotations, turns, vectors
from gatherline.plans.registry import query, rounded, table

_TOK = r"""regexp_extract_all(lower(regexp_replace(text, '\[.*?\]', '', 'g')), '[a-z0-9'']+')"""

# spoken phrases added to the turns, so that cues occur
PHRASES = ("we could try it?", "yeah exactly", "no, wait", "i think maybe...", "what do you think", "you know, because", "let's go with it", "however i am not sure")


def _lit(words):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _said(df):
    idx = ((F.col("conv_id") + F.col("turn")) % len(PHRASES) + 1).cast("int")
    return df.withColumn("text", F.concat("text", F.lit(" "), F.element_at(F.array(*[F.lit(p) for p in PHRASES]), idx)))


_SAID = TURNS + f""", sd AS (SELECT conv_id, turn, speaker, onset, duration, "end", text || ' ' || [{_lit(PHRASES)}][(conv_id + turn) % {len(PHRASES)} + 1] AS text FROM u)"""


def _markers(ws, words):
    return f"len([w FOR w IN {ws} IF w IN ({_lit(words)})])"


def _pats(text, pats):
    return "len(regexp_extract_all(" + text + ", '(?i)(" + "|".join(pats).replace("'", "''") + ")'))"


def _counts(text, ws, q):
    dm = ", ".join(f"{_markers(ws, L.DISCOURSE_WORDS[k])} + {_pats(text, L.DISCOURSE_PHRASES[k])} AS dm_{k}" for k in L.DISCOURSE_WORDS)
    marks = f"length({text}) - length(replace({text}, '?', ''))"
    if q == "larger":
        marks = f"greatest({marks}, len(regexp_extract_all({text}, '(?i)(?:^|[.!?]\\s*)({'|'.join(L.QUESTION_WORDS)})\\b')))"
    return f"""len({ws}) AS word_count, coalesce(list_sum([length(w) FOR w IN {ws}]), 0) AS char_count, len([w FOR w IN {ws} IF length(w) > 6]) AS long_words,
  {_markers(ws, L.AGREEMENT)} AS agreement_count, {_markers(ws, L.HEDGING)} AS hedging_count, {_markers(ws, L.CERTAINTY)} AS certainty_count, {_markers(ws, L.POSITIVE)} AS positive_count,
  {_markers(ws, L.NEGATIVE)} AS negative_count, {marks} AS question_count, {_pats(text, L.SUGGESTION_PATTERNS)} AS suggestion_count, {_markers(ws, L.FIRST_SINGULAR)} AS i_count,
  {_markers(ws, L.FIRST_PLURAL)} AS we_count, {dm}"""


_COUNT_COLS = ["word_count", "char_count", "long_words", "agreement_count", "hedging_count", "certainty_count", "positive_count", "negative_count",
               "question_count", "suggestion_count", "i_count", "we_count", *[f"dm_{k}" for k in L.DISCOURSE_WORDS]]


def _grams(ws, n):
    return f"[array_to_string(list_slice({ws}, i, i + {n - 1}), ' ') FOR i IN range(1, len({ws}) - {n - 2})]"


@query("tokens", f"SELECT doc_id, len({_TOK}) AS n_words, md5(array_to_string({_TOK}, ' ')) AS digest FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents").withColumn("w", T.tokens("text"))
    return d.select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("ngram_entropy", f"""WITH t AS (SELECT doc_id, {_TOK} AS ws FROM documents), g AS (SELECT doc_id, unnest({_grams('ws', 2)}) AS g FROM t), c AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY 1, 2)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_bigram, count(*) AS unique_bigram, count(*) FILTER (n = 1) AS hapax_bigram, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS bigram_entropy FROM c GROUP BY 1""")
def _(spark, sf):
    return rounded(lexical.text_ngrams(table(spark, sf, "documents"), ["doc_id"], "text", 2, "bigram"))


@query("marker_counts", f"WITH t AS (SELECT doc_id, text, {_TOK} AS ws FROM documents) SELECT doc_id, {_counts('text', 'ws', 'marks')} FROM t")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", T.tokens("text").alias("w"))
    return d.select("doc_id", *[v.cast("long").alias(k) for k, v in lexical.turn_counts("text", "w").items()])


@query("pronoun_ratio", "WITH " + _SAID + f""", t AS (SELECT conv_id, turn, {_TOK} AS ws FROM sd), c AS (SELECT conv_id, turn, {_markers('ws', L.FIRST_SINGULAR)} AS i, {_markers('ws', L.FIRST_PLURAL)} AS w FROM t)
SELECT conv_id, turn, i AS i_count, w AS we_count, CASE WHEN i + w > 0 THEN round(w * 1.0::DOUBLE / (i + w), 6) END AS we_i_ratio FROM c""")
def _(spark, sf):
    d = _said(turns(spark, sf)).withColumn("w", T.tokens("text"))
    i, w = T.marker_count("w", L.FIRST_SINGULAR).cast("long"), T.marker_count("w", L.FIRST_PLURAL).cast("long")
    return rounded(d.select("conv_id", "turn", i.alias("i_count"), w.alias("we_count"), X.ratio(w, w + i).alias("we_i_ratio")))


def _gram_ctes(src, key):
    out = ""
    for n, name in ((1, "unigram"), (2, "bigram"), (3, "trigram")):
        out += f""", g{n} AS (SELECT {key}, count(*) AS unique_{name}, CAST(sum(n) AS BIGINT) AS n_{name}, count(*) FILTER (n = 1) AS hapax_{name}, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS {name}_entropy
  FROM (SELECT {key}, g, count(*) AS n FROM (SELECT {key}, unnest({_grams('ws', n)}) AS g FROM {src}) GROUP BY ALL) GROUP BY {key})"""
    return out


_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _COUNT_COLS)


@query("speaker_lexicon", "WITH " + _SAID + f""", t AS (SELECT conv_id, speaker, turn, duration, text, {_TOK} AS ws FROM sd), k AS (SELECT conv_id, speaker, turn, duration, {_counts('text', 'ws', 'larger')} FROM t),
f AS (SELECT conv_id, speaker, {_SUMS}, sum(duration) AS st FROM k GROUP BY 1, 2), j AS (SELECT conv_id, speaker, flatten(list(ws ORDER BY turn)) AS ws FROM t GROUP BY 1, 2){_gram_ctes('j', 'conv_id, speaker')}
SELECT conv_id, speaker, {', '.join(_COUNT_COLS)}, round(st, 6) AS speaking_time_s, n_unigram, unique_unigram, hapax_unigram, round(unigram_entropy, 6) AS unigram_entropy, coalesce(n_bigram, 0) AS n_bigram, coalesce(unique_bigram, 0) AS unique_bigram,
  coalesce(hapax_bigram, 0) AS hapax_bigram, round(coalesce(bigram_entropy, 0), 6) AS bigram_entropy, coalesce(n_trigram, 0) AS n_trigram, coalesce(unique_trigram, 0) AS unique_trigram, coalesce(hapax_trigram, 0) AS hapax_trigram,
  round(coalesce(trigram_entropy, 0), 6) AS trigram_entropy, round(unique_unigram * 1.0::DOUBLE / word_count, 6) AS ttr, round(char_count * 1.0::DOUBLE / word_count, 6) AS mean_word_len, round(long_words * 1.0::DOUBLE / word_count, 6) AS long_word_ratio,
  round(hapax_unigram * 1.0::DOUBLE / word_count, 6) AS hapax_ratio, coalesce(round(unique_bigram * 1.0::DOUBLE / n_bigram, 6), 0) AS bigram_diversity, coalesce(round(unique_trigram * 1.0::DOUBLE / n_trigram, 6), 0) AS trigram_diversity,
  round(agreement_count * 1.0::DOUBLE / word_count, 6) AS agreement_rate, round(question_count / (st / 60), 6) AS question_rate_per_min, round(suggestion_count / (st / 60), 6) AS suggestion_rate_per_min,
  CASE WHEN positive_count + negative_count > 0 THEN round((positive_count - negative_count) * 1.0::DOUBLE / (positive_count + negative_count), 6) ELSE 0 END AS sentiment_ratio,
  CASE WHEN we_count + i_count > 0 THEN round(we_count * 1.0::DOUBLE / (we_count + i_count), 6) END AS we_i_ratio
FROM f JOIN g1 USING (conv_id, speaker) LEFT JOIN g2 USING (conv_id, speaker) LEFT JOIN g3 USING (conv_id, speaker)""")
def _(spark, sf):
    return rounded(lexical.speaker_lexicon(_said(turns(spark, sf)), ["conv_id", "speaker"], ["turn"], "text", "duration"))


@query("lexical_windows", "WITH " + _SAID + f""", t AS (SELECT conv_id, CAST(floor(onset / 20.0::DOUBLE) AS BIGINT) AS window_index, speaker, turn, text, {_TOK} AS ws FROM sd WHERE onset >= 0),
k AS (SELECT conv_id, window_index, speaker, turn, {_counts('text', 'ws', 'marks')} FROM t), f AS (SELECT conv_id, window_index, {_SUMS}, count(*) AS n_turns, count(DISTINCT speaker) AS n_speakers FROM k GROUP BY 1, 2),
j AS (SELECT conv_id, window_index, flatten(list(ws ORDER BY turn)) AS ws FROM t GROUP BY 1, 2){_gram_ctes('j', 'conv_id, window_index')},
ne AS (SELECT *, lag(ws) OVER (PARTITION BY conv_id, window_index ORDER BY turn) AS pw FROM t WHERE len(ws) > 0),
co AS (SELECT conv_id, window_index, avg(len(list_intersect(list_distinct(ws), list_distinct(pw))) * 1.0::DOUBLE / len(list_distinct(list_concat(ws, pw)))) AS c FROM ne WHERE pw IS NOT NULL GROUP BY 1, 2),
sp AS (SELECT w.conv_id, w.window_index, p.p, coalesce(sum(word_count), 0) AS x FROM (SELECT DISTINCT conv_id, window_index FROM t) w CROSS JOIN (SELECT unnest(['user', 'assistant', 'system']) AS p) p LEFT JOIN k ON k.conv_id = w.conv_id AND k.window_index = w.window_index AND k.speaker = p.p GROUP BY 1, 2, 3),
ba AS (SELECT conv_id, window_index, CASE WHEN sum(x) > 0 THEN sum((2 * i - 4) * x) / (3.0::DOUBLE * sum(x)) END AS g, CASE WHEN sum(x) > 0 THEN sum(x * x) / (sum(x) * 1.0::DOUBLE)**2 END AS h FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, window_index ORDER BY x) AS i FROM sp) GROUP BY 1, 2),
spine AS (SELECT conv_id, unnest(range(0, max(window_index) + 1)) AS window_index FROM t GROUP BY 1)
SELECT conv_id, window_index, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _COUNT_COLS)}, coalesce(n_turns, 0) AS n_turns, coalesce(n_speakers, 0) AS n_speakers, coalesce(unique_unigram, 0) AS unique_words,
  CASE WHEN g1.n_unigram > 0 THEN round(coalesce(bigram_entropy, 0), 6) END AS bigram_entropy, CASE WHEN g1.n_unigram > 0 THEN round(coalesce(trigram_entropy, 0), 6) END AS trigram_entropy, round(c, 6) AS turn_cohesion, round(g, 6) AS word_gini, round(h, 6) AS word_hhi,
  round(unique_unigram * 1.0::DOUBLE / word_count, 6) AS ttr, round(char_count * 1.0::DOUBLE / word_count, 6) AS mean_word_len, round(long_words * 1.0::DOUBLE / word_count, 6) AS long_word_ratio,
  CASE WHEN word_count > 0 THEN round((positive_count - negative_count) * 1.0::DOUBLE / (positive_count + negative_count + 1), 6) END AS sentiment_ratio, CASE WHEN word_count > 0 THEN round((agreement_count + positive_count) * 1.0::DOUBLE / word_count, 6) END AS social_composite,
  CASE WHEN we_count + i_count > 0 THEN round(we_count * 1.0::DOUBLE / (we_count + i_count), 6) END AS we_i_ratio, window_index * 20.0::DOUBLE AS window_start_s
FROM spine LEFT JOIN f USING (conv_id, window_index) LEFT JOIN g1 USING (conv_id, window_index) LEFT JOIN g2 USING (conv_id, window_index) LEFT JOIN g3 USING (conv_id, window_index) LEFT JOIN co USING (conv_id, window_index) LEFT JOIN ba USING (conv_id, window_index)""")
def _(spark, sf):
    w = lexical.lexical_windows(_said(turns(spark, sf)), ["conv_id"], ["turn"], "text", "onset", "speaker", ["user", "assistant", "system"], 20.0)
    return rounded(w)


@query("norm_scores", f"""WITH lx AS (SELECT DISTINCT w, 1 + length(w) % 5 AS s FROM (SELECT unnest({_TOK}) AS w FROM benchmark)), t AS (SELECT doc_id, unnest({_TOK}) AS w FROM documents)
SELECT doc_id, round(avg(s), 6) AS norm_mean, round(stddev_pop(s), 6) AS norm_sd, round(count(s) * 1.0::DOUBLE / count(*), 6) AS norm_coverage FROM t LEFT JOIN lx USING (w) GROUP BY 1""")
def _(spark, sf):
    norms = table(spark, sf, "benchmark").select(F.explode(T.tokens("text")).alias("word")).distinct().withColumn("score", 1 + F.length("word") % 5)
    return rounded(lexical.norm_scores(table(spark, sf, "documents"), ["doc_id"], T.tokens("text"), norms))


_ACTS = "WITH " + _SAID + ", a AS (SELECT conv_id, turn, " + ", ".join(
    "(" + " + ".join("contains(lower(text), '" + c.replace("'", "''") + "')::INT" for c in cues) + (" + contains(text, '?')::INT" if act == "question" else "") + f") AS {act}"
    for act, cues in L.ACT_CUES.items()) + " FROM sd)"


@query("dialogue_acts", _ACTS + "SELECT conv_id, turn, " + ", ".join(f"round(least(1, {a} * 1.0::DOUBLE / {len(c)}), 6) AS {a}" for a, c in L.ACT_CUES.items())
       + ", CASE WHEN greatest(" + ", ".join(L.ACT_CUES) + ") = 0 THEN 'statement' " + " ".join(f"WHEN {a} = greatest({', '.join(L.ACT_CUES)}) THEN '{a}'" for a in L.ACT_CUES) + " END AS dominant FROM a")
def _(spark, sf):
    d = lexical.dialogue_acts(_said(turns(spark, sf)).select("conv_id", "turn", "text"), "text")
    return rounded(d.drop("text"))


def _q(p):
    return p.replace("'", "''")


_SUP = f"""(regexp_matches(lower(X), '{_q(L.SUPPORT)}') OR (len(regexp_split_to_array(trim(X), '\\s+')) <= 4 AND regexp_matches(trim(X), '(?i){_q(L.SHORT_SUPPORT)}')))"""
_CON = f"""(regexp_matches(lower(X), '{_q(L.CONFLICT[0])}') OR regexp_matches(lower(X), '{_q(L.CONFLICT[1])}'))"""
_RELABEL = "WITH " + ANNOTATIONS + f""", ph AS (SELECT [{_lit(PHRASES)}] AS p), tx AS (SELECT ann.*, onset + duration * 20 AS "end", p[event_id % {len(PHRASES)} + 1] AS text FROM ann, ph),
sp AS (SELECT * FROM tx WHERE type = 'SPK'), ev AS (SELECT event_id, group_id, task_id, speaker, onset, onset + duration / 1000 AS "end" FROM tx WHERE type = 'OVL'),
ov AS (SELECT ev.event_id, sp.event_id AS sid, row_number() OVER (PARTITION BY ev.event_id ORDER BY sp.onset) AS rn FROM ev JOIN sp ON ev.group_id = sp.group_id AND ev.task_id = sp.task_id AND ev.onset < sp."end" AND sp.onset < ev."end"),
er AS (SELECT ev.event_id, sp.event_id AS sid, row_number() OVER (PARTITION BY ev.event_id ORDER BY sp.onset DESC) AS rn FROM ev JOIN sp ON ev.group_id = sp.group_id AND ev.task_id = sp.task_id AND sp.onset < ev.onset),
k AS (SELECT event_id, max(sid) FILTER (rn = 1) AS o1, max(sid) FILTER (rn = 2) AS o2 FROM ov GROUP BY 1), q AS (SELECT event_id, max(sid) FILTER (rn = 1) AS e1, max(sid) FILTER (rn = 2) AS e2 FROM er GROUP BY 1),
ab AS (SELECT ev.*, CASE WHEN o2 IS NOT NULL THEN o1 WHEN o1 IS NOT NULL THEN coalesce(e1, o1) WHEN e1 IS NOT NULL AND e2 IS NOT NULL THEN e2 END AS a,
       CASE WHEN o2 IS NOT NULL THEN o2 WHEN o1 IS NOT NULL THEN CASE WHEN e1 IS NOT NULL THEN o1 END WHEN e1 IS NOT NULL AND e2 IS NOT NULL THEN e1 END AS b FROM ev LEFT JOIN k USING (event_id) LEFT JOIN q USING (event_id)),
cm AS (SELECT DISTINCT ev.event_id FROM ev JOIN sp ON ev.group_id = sp.group_id AND ev.task_id = sp.task_id AND ev.speaker <> sp.speaker AND sp."end" >= ev.onset - 1.5 AND sp."end" <= ev.onset + 0.3 WHERE regexp_matches(sp.text, '{L.TRAILS_OFF}')),
g AS (SELECT ab.event_id, coalesce(x.text, '') AS ta, coalesce(y.text, '') AS tb, ("end" - ab.onset) * 1000 AS ms, abs(y.onset - x.onset) * 1000 AS diff, cm.event_id IS NOT NULL AS completion
  FROM (SELECT event_id, group_id, task_id, onset, "end", a, b FROM ab) ab LEFT JOIN (SELECT event_id AS sid, onset, text FROM sp) x ON x.sid = a LEFT JOIN (SELECT event_id AS sid, onset, text FROM sp) y ON y.sid = b LEFT JOIN cm USING (event_id)),
h AS (SELECT *, CASE WHEN diff < 200 THEN 'simultaneous' WHEN ms < 250 THEN 'backchannel_ovl' WHEN ms < 500 THEN 'smooth' WHEN ms < 1000 THEN 'competitive' ELSE 'floor_fight' END AS timing, CASE WHEN tb <> '' THEN tb ELSE ta END AS said,
  {_SUP.replace('X', 'ta')} OR {_SUP.replace('X', 'tb')} AS sup, {_CON.replace('X', 'ta')} OR {_CON.replace('X', 'tb')} AS con FROM g)
SELECT event_id, timing, completion, CASE WHEN completion AND said <> '' AND NOT regexp_matches(trim(said), '(?i){L.JUST_AGREES}') THEN 'completion' WHEN sup AND NOT con AND timing IN ('smooth', 'competitive', 'floor_fight') THEN 'collaborative'
  WHEN con AND NOT sup AND timing IN ('competitive', 'floor_fight') THEN 'competitive' ELSE '' END AS context FROM h"""


@query("relabel_overlaps", _RELABEL)
def _(spark, sf):
    a = annotations(spark, sf)
    text = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("event_id") % len(PHRASES) + 1).cast("int"))
    seg = a.filter("type = 'SPK'").select("group_id", "task_id", "speaker", "onset", (F.col("onset") + F.col("duration") * 20).alias("end"), text.alias("text"))
    ev = a.filter("type = 'OVL'").select("event_id", "group_id", "task_id", "speaker", "onset", (F.col("onset") + F.col("duration") / 1000).alias("end"))
    r = lexical.relabel_overlaps(ev, seg, ["group_id", "task_id"], "event_id", "onset", "end", "speaker", "text")
    return r.select("event_id", "timing", "completion", "context")


@query("context_labels", "WITH " + _SAID + f""", p AS (SELECT conv_id, turn, text AS tb, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS ta,
  CASE WHEN duration * 20 < 500 THEN 'smooth' WHEN duration * 20 < 1000 THEN 'competitive' ELSE 'floor_fight' END AS timing FROM sd),
h AS (SELECT *, {_SUP.replace('X', 'ta')} OR {_SUP.replace('X', 'tb')} AS sup, {_CON.replace('X', 'ta')} OR {_CON.replace('X', 'tb')} AS con, regexp_matches(ta, '{L.TRAILS_OFF}') AS completion FROM p)
SELECT conv_id, turn, CASE WHEN completion AND tb <> '' AND NOT regexp_matches(trim(tb), '(?i){L.JUST_AGREES}') THEN 'completion' WHEN sup AND NOT con THEN 'collaborative'
  WHEN con AND NOT sup AND timing IN ('competitive', 'floor_fight') THEN 'competitive' ELSE '' END AS context FROM h""")
def _(spark, sf):
    from gatherline.operators.ordered import ordered_scan, prev

    d = ordered_scan(_said(turns(spark, sf)), ["conv_id"], ["turn"], {"ta": prev("text")})
    ms = F.col("duration") * 20
    timing = F.when(ms < 500, "smooth").when(ms < 1000, "competitive").otherwise("floor_fight")
    label = F.when(F.col("text").isNotNull(), T.context_label(timing, "ta", "text", T.trails_off("ta"))).otherwise("")
    return d.select("conv_id", "turn", label.alias("context"))


@query("vector_similarity", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def _(spark, sf):
    e = vectors(spark, sf)
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return rounded(e.join(b, "vec_id").select("vec_id", X.cosine("embedding", "next").alias("cosine")))


@query("word_overlap", f"""WITH t AS (SELECT doc_id, list_distinct({_TOK}) AS ws FROM documents)
SELECT a.doc_id, CASE WHEN len(a.ws) > 0 AND len(b.ws) > 0 THEN round(len(list_intersect(a.ws, b.ws)) * 1.0::DOUBLE / len(list_distinct(list_concat(a.ws, b.ws))), 6) ELSE 0 END AS jaccard FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.array_distinct(T.tokens("text")).alias("ws"))
    b = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("ws").alias("next"))
    return rounded(d.join(b, "doc_id").select("doc_id", X.jaccard("ws", "next").alias("jaccard")))


@query("utc_text", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("seconds", X.epoch_seconds("ts"))
    return e.select("event_id", X.utc_text("seconds").alias("utc"))


@query("likert_scores", """SELECT l_orderkey, l_linenumber, l_partkey, round(((l_quantity % 5 + 1) + (6 - (l_partkey % 5 + 1))) / 2, 6) AS e, round(CASE WHEN l_suppkey % 6 < 5 THEN ((l_linenumber % 5 + 1) + (6 - (l_suppkey % 6 + 1))) / 2.0 ELSE l_linenumber % 5 + 1 END, 6)::DOUBLE AS a FROM lineitem""")
def _(spark, sf):
    names = ["strongly disagree", "disagree", "neutral", "agree", "strongly agree"]
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") % 5).cast("int").alias("q"), (F.col("l_partkey") % 5).cast("int").alias("p"),
        (F.col("l_linenumber") % 5).cast("int").alias("n"), (F.col("l_suppkey") % 6).cast("int").alias("s"))
    say = lambda c: F.initcap(F.get(F.array(*[F.lit(x) for x in names]), F.col(c)))
    li = li.select("l_orderkey", "l_linenumber", "l_partkey", *[say(c).alias(c) for c in "qpns"])
    return rounded(segments.likert_scores(li, ["l_orderkey", "l_linenumber", "l_partkey"], [("q", "e", False), ("p", "e", True), ("n", "a", False), ("s", "a", True)],
                                          {x: i + 1 for i, x in enumerate(names)}))


@query("demographic_folding", """SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%HIGH%' THEN 'phd' WHEN o_orderpriority LIKE '%LOW%' THEN 'bachelor' ELSE lower(o_orderpriority) END AS education,
  CASE WHEN o_custkey % 3 = 0 THEN CAST(o_custkey % 90 AS VARCHAR) WHEN o_custkey % 3 = 1 THEN CAST((o_custkey % 60 + o_custkey % 60 + 9) // 2 AS VARCHAR) ELSE '65' END AS age FROM orders""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_custkey")
    exact = F.when(k % 3 == 0, (k % 90).cast("string"))
    band = F.when(k % 3 == 1, F.concat((k % 60).cast("string"), F.lit("-"), (k % 60 + 9).cast("string"))).otherwise("65+")
    edu = F.when(F.col("o_orderpriority").contains("HIGH"), "PhD degree").when(F.col("o_orderpriority").contains("LOW"), "a Bachelor").otherwise(F.col("o_orderpriority"))
    return o.select("o_orderkey", N.fold(edu, N.EDUCATION).alias("education"), N.age_text(exact, band).alias("age"))


@query("pooled_vectors", """WITH d AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(0, 64)) AS d FROM embeddings), m AS (SELECT label, d, avg(x) AS m, count(*) AS n FROM d GROUP BY 1, 2)
SELECT label, CAST(max(n) AS BIGINT) AS n_vectors, round(max(m) FILTER (d = 0), 6) AS v0, round(max(m) FILTER (d = 63), 6) AS v63, round(sqrt(sum(m * m)), 6) AS norm FROM m GROUP BY 1""")
def _(spark, sf):
    m = segments.mean_vector(vectors(spark, sf), ["label"], "embedding")
    return rounded(m.select("label", "n_vectors", F.get("vector", F.lit(0)).alias("v0"), F.get("vector", F.lit(63)).alias("v63"), F.sqrt(X.dot("vector", "vector")).alias("norm")))


@query("lexical_composites", f"""WITH t AS (SELECT doc_id, text, {_TOK} AS ws FROM documents), c AS (SELECT doc_id, {_markers('ws', L.DISCOURSE_WORDS['additive'])}::DOUBLE AS a, {_markers('ws', L.DISCOURSE_WORDS['causal'])}::DOUBLE AS b,
  len(list_distinct(ws)) * 1.0::DOUBLE / nullif(len(ws), 0) AS ttr, len([w FOR w IN ws IF length(w) > 6])::DOUBLE AS lw, ln(1 + len(ws)) AS lg FROM t),
z AS (SELECT doc_id, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS za, (b - avg(b) OVER ()) / nullif(stddev_pop(b) OVER (), 0) AS zb, (ttr - avg(ttr) OVER ()) / stddev_pop(ttr) OVER () AS zt, (lw - avg(lw) OVER ()) / stddev_pop(lw) OVER () AS zl, (lg - avg(lg) OVER ()) / stddev_pop(lg) OVER () AS zg FROM c)
SELECT doc_id, round(list_avg([x FOR x IN [za, zb] IF x IS NOT NULL]), 6) AS social_z, round(list_avg([x FOR x IN [zt, zl] IF x IS NOT NULL]), 6) AS complexity_z, round(zg, 6) AS verbosity_z FROM z""")
def _(spark, sf):
    d = table(spark, sf, "documents").withColumn("w", T.tokens("text"))
    d = d.select("doc_id", T.marker_count("w", L.DISCOURSE_WORDS["additive"]).cast("double").alias("a"), T.marker_count("w", L.DISCOURSE_WORDS["causal"]).cast("double").alias("b"),
                 X.ratio(F.size(F.array_distinct("w")), F.size("w")).alias("ttr"), F.size(F.filter("w", lambda x: F.length(x) > 6)).cast("double").alias("lw"), F.size("w").alias("n"))
    return rounded(lexical.lexical_composites(d, ["a", "b"], ["ttr", "lw"], "n").select("doc_id", "social_z", "complexity_z", "verbosity_z"))


@query("within_task_composite", """WITH o AS (SELECT o_orderkey, o_orderpriority AS p, o_totalprice AS a, (o_custkey % 100)::DOUBLE AS b FROM orders),
z AS (SELECT *, (a - avg(a) OVER w) / stddev_samp(a) OVER w AS za, (b - avg(b) OVER w) / stddev_samp(b) OVER w AS zb FROM o WINDOW w AS (PARTITION BY p))
SELECT o_orderkey, CASE WHEN p = '1-URGENT' THEN round((za + zb) / 2, 6) WHEN p = '5-LOW' THEN round(za, 6) END AS score, CASE WHEN p = '1-URGENT' THEN round((a + b) / 2, 6) WHEN p = '5-LOW' THEN round(a, 6) END AS score_raw FROM z""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("p"), F.col("o_totalprice").alias("a"), (F.col("o_custkey") % 100).cast("double").alias("b"))
    return rounded(segments.within_task_composite(o, "p", {"1-URGENT": ["a", "b"], "5-LOW": ["a"]}, "score").select("o_orderkey", "score", "score_raw"))


@query("zones", """WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
SELECT vec_id, CASE WHEN x * x + y * y <= 0.01 THEN 'centre' WHEN x BETWEEN -0.1 AND 0.3 AND y BETWEEN 0 AND 0.3 THEN 'table' WHEN x BETWEEN -0.5 AND 0 AND y BETWEEN -0.5 AND 0.1 THEN 'wall' ELSE 'other' END AS zone FROM e""")
def _(spark, sf):
    z = [{"name": "wall", "priority": 3, "x0": -0.5, "x1": 0.0, "y0": -0.5, "y1": 0.1}, {"name": "centre", "priority": 1, "cx": 0.0, "cy": 0.0, "r": 0.1},
         {"name": "table", "priority": 2, "x0": -0.1, "x1": 0.3, "y0": 0.0, "y1": 0.3}]
    e = vectors(spark, sf).select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return e.select("vec_id", X.zone_of("x", "y", z).alias("zone"))


@query("segment_confidence", """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS e, l_quantity * 4000 AS room FROM lineitem),
m AS (SELECT l_orderkey, list(e ORDER BY e DESC) AS es FROM t GROUP BY 1), r AS (SELECT t.*, CASE WHEN e = es[1] THEN es[2] ELSE es[1] END AS mo FROM t JOIN m USING (l_orderkey)),
c AS (SELECT *, e / mo AS energy_ratio, CASE WHEN mo IS NULL OR e / mo >= 2.0 THEN 'confident' ELSE 'uncertain' END AS conf FROM r WHERE mo IS NULL OR e / mo >= 1.5)
SELECT l_orderkey, l_linenumber, l_partkey, round(energy_ratio, 6) AS energy_ratio, CASE WHEN conf = 'uncertain' AND e / room < 0.3 THEN 'MODERATOR' ELSE 'P' END AS speaker,
  CASE WHEN conf = 'uncertain' AND (e / room > 0.5 OR e / room < 0.3) THEN 'confident' ELSE conf END AS confidence FROM c""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("e"), (F.col("l_quantity") * 4000).alias("room"), F.lit("P").alias("speaker"))
    c = segments.room_resolve(segments.energy_confidence(li, ["l_orderkey"], "e"), "e", "room", "speaker", 0.5, 0.3)
    return rounded(c.select("l_orderkey", "l_linenumber", "l_partkey", "energy_ratio", "speaker", "confidence"))


@query("frame_dominance", """WITH f AS (SELECT l_suppkey % 50 AS g, l_orderkey AS fr, l_linenumber * 1000000 + l_partkey AS mic, max(l_extendedprice) AS rms FROM lineitem GROUP BY ALL),
k AS (SELECT g, fr, list(rms ORDER BY rms DESC) AS r, count(*) FILTER (rms > 20000) AS loud FROM f GROUP BY 1, 2), d AS (SELECT g, r[1] AS a, greatest(coalesce(r[2], 20000), 20000) AS b, loud FROM k)
SELECT g, count(*) AS n_frames, round(avg((a > 20000 AND a / b >= 1.5)::INT), 6) AS dominated_share, round(coalesce(1 - avg(CASE WHEN loud >= 2 THEN (a / b >= 1.5)::INT END), 0), 6) AS crosstalk_share FROM d GROUP BY 1""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    f = li.groupBy((F.col("l_suppkey") % 50).alias("g"), F.col("l_orderkey").alias("fr"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("mic")).agg(F.max("l_extendedprice").alias("rms"))
    return rounded(segments.frame_dominance(f, ["g"], "fr", "mic", "rms", 20000.0, 1.5))


@query("scored_windows", """SELECT (doc_id // 20) AS window_index, count(*) AS n, round(avg(quality), 6) AS mean_quality, CAST(sum(toxic) AS BIGINT) AS toxic, round(avg(n_chars), 6) AS mean_chars FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    j = table(spark, sf, "labels").join(d, "doc_id").withColumn("window_index", F.expr("doc_id div 20"))
    return rounded(j.groupBy("window_index").agg(F.count("*").alias("n"), F.avg("quality").alias("mean_quality"), F.sum("toxic").alias("toxic"), F.avg("n_chars").alias("mean_chars")))


@query("profile_assignment", """WITH e AS (SELECT vec_id, CAST(label AS VARCHAR) AS m, CAST(embedding AS DOUBLE[]) AS v, vec_id % 7 AS q, (vec_id % 11) * 0.2::DOUBLE AS dur FROM embeddings),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY m ORDER BY q DESC, vec_id) <= 10), d AS (SELECT m, unnest(v) AS x, unnest(range(0, 64)) AS d FROM b), a AS (SELECT m, d, avg(x) AS x FROM d GROUP BY 1, 2),
p AS (SELECT m, list(x ORDER BY d) AS p FROM a GROUP BY 1), s AS (SELECT vec_id, dur, p.m, round(list_cosine_similarity(v, p), 9) AS s FROM e, p),
t AS (SELECT vec_id, dur, m, s FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, m) = 1)
SELECT vec_id, CASE WHEN dur >= 0.8 AND s >= 0.25 THEN m ELSE 'MODERATOR' END AS assigned, round(s, 6) AS score FROM t""")
def _(spark, sf):
    e = vectors(spark, sf).select("vec_id", F.col("label").cast("string").alias("m"), "embedding", (F.col("vec_id") % 7).alias("q"), ((F.col("vec_id") % 11) * 0.2).alias("dur"))
    p = segments.profiles(e, "m", "q", "embedding", 10, "vec_id")
    return rounded(segments.assign_profiles(e, p, "m", "embedding", "dur", 0.25, 0.8, "MODERATOR").select("vec_id", "assigned", "score"))
