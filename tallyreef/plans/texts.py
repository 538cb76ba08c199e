"""Queries on comments: cleaning, words, n-grams, TF-IDF, overlap scores and prompts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import strings as X
from ..operators import text as T
from ..operators.base import r6, ranked
from ..sources import views as V
from .registry import register
from .sqlviews import r6 as q6
from .sqlviews import sql

L = "long"


def reg(name, build, query=None):
    register(name, build, sql(query) if query else None)


def lem(s, d, pol=None):
    out = V.lemmas(s, d)
    return out.where(F.col("polarity") == pol) if pol else out


# --- words ---------------------------------------------------------------------------------------------------------

_PUNCT = X.PUNCTUATION.replace("'", "''")
_words = "len(list_filter(string_split_regex(translate(text, '{p}', '{b}'), '\\s+'), lambda x: x <> ''))".format(p=_PUNCT, b=" " * len(X.PUNCTUATION))
_nw = lambda: F.size(X.split_words(X.spaced(F.col("text")))).cast(L)
reg("min_words", lambda s, d: V.comments(s, d).select("review_id", _nw().alias("n_words")).where("n_words >= 300"), f"SELECT * FROM (SELECT review_id, {_words} AS n_words FROM comments) WHERE n_words >= 300")
reg("len_range", lambda s, d: V.comments(s, d).select("review_id", V.word_count(F.col("text")).alias("n_words")).where("n_words BETWEEN 10 AND 300"), r"SELECT * FROM (SELECT review_id, len(list_filter(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), lambda x: x <> '')) AS n_words FROM comments) WHERE n_words BETWEEN 10 AND 300")
reg("word_count", lambda s, d: V.comments(s, d).select("review_id", V.word_count(F.col("text")).alias("n_words")), r"SELECT review_id, len(list_filter(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), lambda x: x <> '')) AS n_words FROM comments")
# RE2 has neither back-references nor look-ahead: checked by rows and by unit tests
reg("tokenize_clean", lambda s, d: V.comments(s, d).select("review_id", F.posexplode(X.clean_tokens(F.col("text"))).alias("pos", "token")))
reg("strip_accents", lambda s, d: V.comments(s, d).select("review_id", X.strip_accents(F.col("text")).alias("plain")), f"SELECT review_id, translate(lower(text), '{X.ACCENTS}', '{X.PLAIN}') AS plain FROM comments")


def lemma_lookup(s, d):
    t = lem(s, d)
    dictionary = t.select(F.col("lemma").alias("token")).distinct().where("length(token) > 3").select("token", F.regexp_replace("token", "(ing|ed|s)$", "").alias("stem"))
    return t.join(dictionary, t.lemma == dictionary.token, "left").where("stem IS NOT NULL").groupBy("stem").agg(F.count("*").alias("n"))


reg("lemma_lookup", lemma_lookup, "SELECT regexp_replace(lemma, '(ing|ed|s)$', '') AS stem, count(*) AS n FROM lemmas WHERE length(lemma) > 3 GROUP BY 1")


def pos_simplify(s, d):
    tag = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("VER:"), F.col("pos").cast("string"))).when(F.col("pos") % 3 == 1, "NOM").otherwise("ADJ")
    t = lem(s, d).select("lemma", X.simple_pos(tag).alias("tag"))
    return t.where((F.col("tag") != "VER") | F.col("lemma").rlike("(er|ir|re)$")).groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("lemma").alias("n_lemmas"))


reg("pos_simplify", pos_simplify, "SELECT tag, count(*) AS n, count(DISTINCT lemma) AS n_lemmas FROM (SELECT lemma, CASE WHEN pos % 3 = 0 THEN 'VER' WHEN pos % 3 = 1 THEN 'NOM' ELSE 'ADJ' END AS tag FROM lemmas) WHERE tag <> 'VER' OR regexp_matches(lemma, '(er|ir|re)$') GROUP BY 1")
_join = lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lemma"))), lambda x: x["lemma"]), " ")
reg("doc_reassemble", lambda s, d: lem(s, d).groupBy("review_id").agg(_join().alias("doc")), "SELECT review_id, string_agg(lemma, ' ' ORDER BY pos) AS doc FROM lemmas GROUP BY 1")

# --- frequencies ---------------------------------------------------------------------------------------------------

_freq = (lambda src: f"SELECT lemma AS term, count(*) AS n, count(*) / (SELECT count(DISTINCT review_id) FROM {src}) AS freq FROM {src} GROUP BY 1")
POS, NEG = "(SELECT * FROM lemmas WHERE polarity = 'positive')", "(SELECT * FROM lemmas WHERE polarity = 'negative')"
reg("words_freq", lambda s, d: T.frequencies(lem(s, d)).select("term", "n", r6("freq").alias("freq")), f"SELECT term, n, {q6('freq')} AS freq FROM ({_freq('lemmas')})")
_blocked = ", ".join(f"'{w}'" for w in X.BLOCK_LIST)
reg("corpus_topn", lambda s, d: lem(s, d).where(F.col("pos") % 4 != 0).where(~F.col("lemma").isin(X.BLOCK_LIST)).groupBy("lemma").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lemma").limit(200), f"SELECT lemma, count(*) AS n FROM lemmas WHERE pos % 4 <> 0 AND lemma NOT IN ({_blocked}) GROUP BY 1 ORDER BY n DESC, lemma LIMIT 200")
reg("diff_freq", lambda s, d: T.difference(T.frequencies(lem(s, d, "positive")), T.frequencies(lem(s, d, "negative"))).select("term", r6("diff").alias("diff")), f"SELECT a.term, {q6('a.freq - b.freq')} AS diff FROM ({_freq(POS)}) a JOIN ({_freq(NEG)}) b ON b.term = a.term")


def word_freq_by_item(s, d):
    n = lem(s, d).groupBy("item_id", "lemma").agg(F.count("*").alias("n"))
    return n.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("item_id"))))


reg("word_freq_by_item", word_freq_by_item, f"SELECT item_id, lemma, n, {q6('n / sum(n) OVER (PARTITION BY item_id)')} AS share FROM (SELECT item_id, lemma, count(*) AS n FROM lemmas GROUP BY 1, 2)")


def word_freq_by_tag(s, d):
    tags = V.item_tags(s, d).select("item_id", "tag").where("item_id < 20")
    n = lem(s, d).groupBy("item_id", "lemma").agg(F.count("*").alias("c")).join(tags, "item_id").groupBy("tag", "lemma").agg(F.sum("c").alias("n"))
    share = n.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("tag"))))
    return ranked(share, "tag", [F.desc("n"), "lemma"], 12)


reg("word_freq_by_tag", word_freq_by_tag, f"SELECT tag, lemma, n, share, rank FROM (SELECT *, {q6('n / sum(n) OVER (PARTITION BY tag)')} AS share, row_number() OVER (PARTITION BY tag ORDER BY n DESC, lemma) AS rank FROM (SELECT tag, lemma, CAST(sum(c) AS BIGINT) AS n FROM (SELECT item_id, lemma, count(*) AS c FROM lemmas GROUP BY 1, 2) l JOIN item_tags t ON t.item_id = l.item_id WHERE t.item_id < 20 GROUP BY 1, 2)) WHERE rank <= 12")


def _vocab(desc):
    def build(s, d):
        mean = V.comments(s, d).where("polarity IS NOT NULL").groupBy("item_id").agg(r6(F.avg((F.col("polarity") == "positive").cast("double"))).alias("m"))
        best = mean.orderBy(F.desc("m") if desc else F.asc("m"), "item_id").limit(6)
        return lem(s, d).join(best, "item_id", "left_semi").groupBy("lemma").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lemma").limit(100)

    return build


for _n, _desc in (("best_items_vocab", True), ("worst_items_vocab", False)):
    reg(_n, _vocab(_desc), f"SELECT lemma, count(*) AS n FROM lemmas WHERE item_id IN (SELECT item_id FROM (SELECT item_id, {q6('avg(CAST(polarity = ' + chr(39) + 'positive' + chr(39) + ' AS DOUBLE))')} AS m FROM comments WHERE polarity IS NOT NULL GROUP BY 1) ORDER BY m {'DESC' if _desc else 'ASC'}, item_id LIMIT 6) GROUP BY 1 ORDER BY n DESC, lemma LIMIT 100")


def vocabularies(s, d):
    """Words more frequent in positive and in negative comments."""
    diff = T.difference(T.frequencies(lem(s, d, "positive")), T.frequencies(lem(s, d, "negative"))).withColumn("diff", r6("diff"))
    return diff.select(F.col("term").alias("lemma"), (F.col("diff") > 0).cast("double").alias("is_pos"), (F.col("diff") < 0).cast("double").alias("is_neg"))


VOC = f"(SELECT a.term AS lemma, CAST({q6('a.freq - b.freq')} > 0 AS DOUBLE) AS is_pos, CAST({q6('a.freq - b.freq')} < 0 AS DOUBLE) AS is_neg FROM ({_freq(POS)}) a JOIN ({_freq(NEG)}) b ON b.term = a.term)"


def _shares(s, d, keys, where=None):
    t = lem(s, d).where(where) if where else lem(s, d)
    z = (lambda c: F.coalesce(F.col(c), F.lit(0.0)))
    return t.join(vocabularies(s, d), "lemma", "left").groupBy(*keys).agg(F.avg(z("is_pos")).alias("pos"), F.avg(z("is_neg")).alias("neg"))


def _qshares(keys, where=""):
    return f"SELECT {keys}, avg(coalesce(is_pos, 0)) AS pos, avg(coalesce(is_neg, 0)) AS neg FROM lemmas l LEFT JOIN {VOC} v ON v.lemma = l.lemma {where} GROUP BY ALL"


_two = lambda: [r6("pos").alias("pos"), r6("neg").alias("neg")]
_q2 = f"{q6('pos')} AS pos, {q6('neg')} AS neg"
reg("positive_vocab_share", lambda s, d: _shares(s, d, ["review_id"]).select("review_id", *_two()), f"SELECT review_id, {_q2} FROM ({_qshares('review_id')})")
reg("item_sentiment_share", lambda s, d: _shares(s, d, ["item_id"]).select("item_id", *_two()), f"SELECT item_id, {_q2} FROM ({_qshares('item_id')})")
reg("user_sentiment_share", lambda s, d: _shares(s, d, ["user_id", "polarity"], "polarity IS NOT NULL").select("user_id", "polarity", *_two()), f"SELECT user_id, polarity, {_q2} FROM ({_qshares('user_id, polarity', 'WHERE polarity IS NOT NULL')})")


def sentiment_share_avg(s, d):
    part = (lambda k: _shares(s, d, [k]).agg(r6(F.avg("pos")).alias("pos"), r6(F.avg("neg")).alias("neg")).withColumn("by", F.lit(k)))
    return part("item_id").unionByName(part("user_id"))


reg("sentiment_share_avg", sentiment_share_avg, " UNION ALL ".join(f"SELECT {q6('avg(pos)')} AS pos, {q6('avg(neg)')} AS neg, '{k}' AS by FROM ({_qshares(k)})" for k in ("item_id", "user_id")))
reg("missing_desc_ratio", lambda s, d: V.phrases(s, d).agg(r6(F.avg((F.col("phrase").isNull() | F.col("phrase").rlike(r"^\s*$")).cast("double"))).alias("ratio")), rf"SELECT {q6('avg(CAST(phrase IS NULL OR regexp_matches(phrase, ' + chr(39) + '^' + chr(92) + 's*$' + chr(39) + ') AS DOUBLE))')} AS ratio FROM phrases")

# --- bigrams -------------------------------------------------------------------------------------------------------

GR = "(SELECT * FROM (SELECT review_id, user_id, item_id, polarity, pos, lemma || ' ' || lead(lemma) OVER (PARTITION BY review_id ORDER BY pos) AS gram FROM lemmas) WHERE gram IS NOT NULL)"
reg("bigrams", lambda s, d: T.bigrams(lem(s, d)).groupBy("review_id", "gram").agg(F.count("*").alias("n")), f"SELECT review_id, gram, count(*) AS n FROM {GR} GROUP BY 1, 2")
_raw = (lambda p: f"SELECT gram AS term, count(*) AS n, count(*) / (SELECT count(*) FROM lemmas WHERE {p}) AS freq FROM {GR} WHERE {p} GROUP BY 1")
reg("bigram_raw_freq", lambda s, d: T.raw_frequencies(T.bigrams(lem(s, d)), lem(s, d)).select("term", "n", r6("freq", 9).alias("freq")), f"SELECT term, n, {q6('freq', 9)} AS freq FROM ({_raw('true')})")
_rf = (lambda s, d, p: T.raw_frequencies(T.bigrams(lem(s, d, p)), lem(s, d, p)))
_pp, _nn = "polarity = 'positive'", "polarity = 'negative'"
reg("bigram_diff_freq", lambda s, d: T.difference(_rf(s, d, "positive"), _rf(s, d, "negative")).select("term", r6("diff", 8).alias("diff")), f"SELECT a.term, {q6('a.freq - b.freq', 8)} AS diff FROM ({_raw(_pp)}) a JOIN ({_raw(_nn)}) b ON b.term = a.term")
reg("bigram_doc_freq", lambda s, d: T.bigrams(lem(s, d)).groupBy("gram").agg(F.count_distinct("item_id").alias("n_items")).where("n_items >= 2"), f"SELECT * FROM (SELECT gram, count(DISTINCT item_id) AS n_items FROM {GR} GROUP BY 1) WHERE n_items >= 2")


def polar_counts(s, d, grams=True, keys=("item_id",)):
    rows = T.bigrams(lem(s, d)) if grams else lem(s, d).withColumnRenamed("lemma", "gram")
    n = rows.where("polarity IS NOT NULL").groupBy(*keys, "polarity", F.col("gram").alias("term")).agg(F.count("*").alias("n"))
    return n.where(F.col("polarity") == "negative").drop("polarity"), n.where(F.col("polarity") == "positive").drop("polarity")


def overlap(s, d, grams=True):
    """Overlap of each item's negative comments, as prediction, with its positive ones, as reference."""
    return T.clipped(*polar_counts(s, d, grams), ["item_id"])


def _qoverlap(grams=True):
    src = GR if grams else "(SELECT *, lemma AS gram FROM lemmas)"
    return f"SELECT item_id, CAST(sum(least(np, nr)) AS BIGINT) AS common, CAST(sum(np) AS BIGINT) AS n_pred, CAST(sum(nr) AS BIGINT) AS n_ref FROM (SELECT item_id, gram, count(*) FILTER (polarity = 'negative') AS np, count(*) FILTER (polarity = 'positive') AS nr FROM {src} WHERE polarity IS NOT NULL GROUP BY 1, 2) GROUP BY 1"


reg("clipped_overlap", lambda s, d: overlap(s, d), _qoverlap())
reg("bigram_common_count", lambda s, d: overlap(s, d).select("item_id", "common"), f"SELECT item_id, common FROM ({_qoverlap()})")
reg("bigram_common_prop", lambda s, d: overlap(s, d).select("item_id", r6(F.coalesce(F.try_divide("common", "n_pred"), F.lit(0.0))).alias("prop")), f"SELECT item_id, {q6('coalesce(common / nullif(n_pred, 0), 0)')} AS prop FROM ({_qoverlap()})")
for _n, _g in (("rouge_1", False), ("rouge_2", True)):
    reg(_n, lambda s, d, g=_g: overlap(s, d, g).select("item_id", r6(T.recall()).alias("score")), f"SELECT item_id, {q6('coalesce(common * 100.0 / nullif(n_ref, 0), 0)')} AS score FROM ({_qoverlap(_g)})")
reg("bigram_precision", lambda s, d: overlap(s, d).select("item_id", r6(T.precision()).alias("score")), f"SELECT item_id, {q6('coalesce(common * 100.0 / nullif(n_pred, 0), 0)')} AS score FROM ({_qoverlap()})")


def rouge2_topx(s, d, x=50):
    pred, ref = polar_counts(s, d)
    return T.clipped(T.top_terms(pred, ["item_id"], x).drop("rank"), ref, ["item_id"]).select("item_id", r6(T.recall()).alias("score"))


_pr = "(SELECT item_id, gram AS term, count(*) AS n FROM {g} WHERE polarity = '{p}' GROUP BY 1, 2)"
PREDS, REFS = _pr.format(g=GR, p="negative"), _pr.format(g=GR, p="positive")
reg("rouge2_topx", rouge2_topx, f"SELECT item_id, {q6('coalesce(sum(least(np, nr)) * 100.0 / nullif(sum(nr), 0), 0)')} AS score FROM (SELECT coalesce(p.item_id, r.item_id) AS item_id, coalesce(p.n, 0) AS np, coalesce(r.n, 0) AS nr FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, term) AS rank FROM {PREDS}) WHERE rank <= 50) p FULL JOIN {REFS} r ON r.item_id = p.item_id AND r.term = p.term) GROUP BY 1")


def topx_sweep(s, d, most=300):
    """Recall with the x most frequent bigrams for every x at once, by a running sum over the rank."""
    pred, ref = polar_counts(s, d)
    top = T.top_terms(pred, ["item_id"], most).join(ref.withColumnRenamed("n", "nr"), ["item_id", "term"], "left").withColumn("c", F.least("n", F.coalesce("nr", F.lit(0))))
    run = F.sum("c").over(Window.partitionBy("item_id").orderBy("rank"))
    total = ref.groupBy("item_id").agg(F.sum("n").alias("total"))
    return top.withColumn("common", run).join(total, "item_id").select("item_id", F.col("rank").alias("x"), r6(F.col("common") * 100.0 / F.col("total")).alias("score"))


SWEEP = f"SELECT t.item_id, t.rank AS x, {q6('sum(least(t.n, coalesce(r.n, 0))) OVER (PARTITION BY t.item_id ORDER BY t.rank) * 100.0 / total')} AS score FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, term) AS rank FROM {PREDS}) WHERE rank <= 300) t JOIN (SELECT item_id, sum(n) AS total FROM {REFS} GROUP BY 1) m ON m.item_id = t.item_id LEFT JOIN {REFS} r ON r.item_id = t.item_id AND r.term = t.term"
reg("topx_sweep", topx_sweep, SWEEP)
_curve = (lambda s, d: topx_sweep(s, d).groupBy("x").agg(F.avg("score").alias("mean")))
reg("curve_smooth", lambda s, d: _curve(s, d).select("x", r6(F.avg("mean").over(Window.orderBy("x").rowsBetween(-1, 1)), 5).alias("smooth")), f"SELECT x, {q6('avg(mean) OVER (ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)', 5)} AS smooth FROM (SELECT x, avg(score) AS mean FROM ({SWEEP}) GROUP BY 1)")


def bleu_2(s, d):
    one, two = overlap(s, d, False), overlap(s, d, True)
    both = one.select("item_id", F.col("common").alias("c1"), F.col("n_pred").alias("p1"), F.col("n_ref").alias("r1")).join(two.select("item_id", F.col("common").alias("c2"), F.col("n_pred").alias("p2")), "item_id", "left")
    both = both.fillna(0, ["c2", "p2"])
    return both.select("item_id", r6(T.bleu([("c1", "p1"), ("c2", "p2")], "p1", "r1")).alias("score"))


reg("bleu_2", bleu_2, f"SELECT a.item_id, {q6('CASE WHEN a.n_pred = 0 OR a.common = 0 OR (coalesce(b.n_pred, 0) > 0 AND b.common = 0) THEN 0 ELSE 100 * CASE WHEN a.n_pred >= a.n_ref THEN 1 ELSE exp(1 - a.n_ref / a.n_pred) END * exp((ln(a.common / a.n_pred) + CASE WHEN coalesce(b.n_pred, 0) > 0 THEN ln(b.common / b.n_pred) ELSE 0 END) / (1 + CAST(coalesce(b.n_pred, 0) > 0 AS INT))) END')} AS score FROM ({_qoverlap(False)}) a LEFT JOIN ({_qoverlap(True)}) b ON b.item_id = a.item_id")
reg("bleu1_byhand", lambda s, d: T.clipped(*polar_counts(s, d, False, ("item_id", "user_id")), ["item_id", "user_id"]).groupBy("item_id").agg(r6(F.avg(T.precision())).alias("bleu1"), r6(F.avg(T.recall())).alias("rouge1")), f"SELECT item_id, {q6('avg(coalesce(c * 100.0 / nullif(p, 0), 0))')} AS bleu1, {q6('avg(coalesce(c * 100.0 / nullif(r, 0), 0))')} AS rouge1 FROM (SELECT item_id, user_id, sum(least(np, nr)) AS c, sum(np) AS p, sum(nr) AS r FROM (SELECT item_id, user_id, lemma, count(*) FILTER (polarity = 'negative') AS np, count(*) FILTER (polarity = 'positive') AS nr FROM lemmas WHERE polarity IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1")

# --- TF-IDF --------------------------------------------------------------------------------------------------------

UNI = "(SELECT review_id, lemma AS term FROM lemmas WHERE length(lemma) >= 2)"
BI = "(SELECT * FROM (SELECT review_id, lemma || ' ' || lead(lemma) OVER (PARTITION BY review_id ORDER BY pos) AS term FROM lemmas WHERE length(lemma) >= 2) WHERE term IS NOT NULL)"


def _qtfidf(src):
    return f"(SELECT review_id, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY review_id)) AS weight FROM (SELECT t.review_id, t.term, tf, tf * (ln((1 + docs) / (1 + df)) + 1) AS w FROM (SELECT review_id, term, count(*) AS tf FROM {src} GROUP BY 1, 2) t JOIN (SELECT term, count(DISTINCT review_id) AS df, (SELECT count(DISTINCT review_id) FROM {src}) AS docs FROM {src} GROUP BY 1) f ON f.term = t.term WHERE df >= 5 AND df <= 0.8 * docs))"


def tfidf(s, d, grams):
    rows = lem(s, d).where("length(lemma) >= 2")
    return T.tfidf(T.bigrams(rows), "gram") if grams else T.tfidf(rows, "lemma")


for _n, _g, _src in (("tfidf_uni", False, UNI), ("tfidf_bi", True, BI)):
    reg(_n, lambda s, d, g=_g: tfidf(s, d, g).select("review_id", "term", r6("weight").alias("weight")), f"SELECT review_id, term, {q6('weight')} AS weight FROM {_qtfidf(_src)}")
reg("tfidf_keep", lambda s, d: tfidf(s, d, True).where(r6("weight") >= 0.13).select("review_id", "term"), f"SELECT review_id, term FROM {_qtfidf(BI)} WHERE {q6('weight')} >= 0.13")
reg("tfidf_keep_uni", lambda s, d: ranked(tfidf(s, d, False).where(r6("weight") >= 0.1), "review_id", [F.desc("tf"), "term"], 10).select("review_id", "term", "rank"), f"SELECT review_id, term, rank FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY tf DESC, term) AS rank FROM {_qtfidf(UNI)} WHERE {q6('weight')} >= 0.1) WHERE rank <= 10")


def tfidf_survival(s, d):
    b = tfidf(s, d, True).groupBy(F.floor(r6("weight") * 20).cast(L).alias("bin")).agg(F.count("*").alias("n"))
    return b.select("bin", F.sum("n").over(Window.orderBy("bin").rowsBetween(0, Window.unboundedFollowing)).alias("at_least"))


reg("tfidf_survival", tfidf_survival, f"SELECT bin, CAST(sum(n) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS at_least FROM (SELECT CAST(floor({q6('weight')} * 20) AS BIGINT) AS bin, count(*) AS n FROM {_qtfidf(BI)} GROUP BY 1)")

# --- prompts -------------------------------------------------------------------------------------------------------

reg("batch_assign", lambda s, d: T.batches(V.turns(s, d), "conv_id", "turn", "n_words", 120), """WITH RECURSIVE o AS (SELECT conv_id, turn, n_words, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM turns),
b AS (SELECT conv_id, turn, k, CASE WHEN n_words > 120 THEN 1 ELSE 0 END AS batch, n_words AS s FROM o WHERE k = 1
UNION ALL SELECT o.conv_id, o.turn, o.k, CASE WHEN s + n_words > 120 THEN batch + 1 ELSE batch END, CASE WHEN s + n_words > 120 THEN n_words ELSE s + n_words END FROM b JOIN o ON o.conv_id = b.conv_id AND o.k = b.k + 1)
SELECT conv_id, turn, CAST(batch AS BIGINT) AS batch FROM b""")


def prompt_messages(s, d):
    b = T.batches(V.turns(s, d), "conv_id", "turn", "n_words", 120).join(V.turns(s, d).select("conv_id", "turn", "text"), ["conv_id", "turn"])
    lines = b.groupBy("conv_id", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("lines"))
    per = lines.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("batch", "lines"))), lambda x: x["lines"]).alias("batches"))
    m = per.select("conv_id", T.prompt("user", F.col("batches")).alias("messages"))
    return m.select("conv_id", F.size("messages").cast(L).alias("n_messages"), F.aggregate("messages", F.lit(0).cast(L), lambda a, x: a + F.length(x["content"])).alias("n_chars"))


_plen = len(T.PROMPTS["user"]) + 1
reg("prompt_messages", prompt_messages, f"""WITH RECURSIVE o AS (SELECT conv_id, turn, text, n_words, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM turns),
b AS (SELECT conv_id, turn, text, k, CASE WHEN n_words > 120 THEN 1 ELSE 0 END AS batch, n_words AS s FROM o WHERE k = 1
UNION ALL SELECT o.conv_id, o.turn, o.text, o.k, CASE WHEN s + n_words > 120 THEN batch + 1 ELSE batch END, CASE WHEN s + n_words > 120 THEN n_words ELSE s + n_words END FROM b JOIN o ON o.conv_id = b.conv_id AND o.k = b.k + 1)
SELECT conv_id, count(*) AS n_messages, CAST(sum(c) + {_plen} AS BIGINT) AS n_chars FROM (SELECT conv_id, batch, sum(length(text)) + count(*) - 1 AS c FROM b GROUP BY 1, 2) GROUP BY 1""")
