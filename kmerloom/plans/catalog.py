"""Named queries over the driver tables and the SQL that must give the same rows.

Roles: the letters A, C, G, T of documents.text are the sequences, those of
benchmark.text the support sequences of a model and the sequences of pairwise
kernels; labels.quality is the class; line items are intervals on suppliers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom import engine
from kmerloom.functions import sequences as S
from kmerloom.functions.weights import Filter, Params
from kmerloom.operators import background, estimates, intervals, kernels, metrics, profiles, scoring, svm, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Word length, fixed places and distance of the document queries, and of the pairwise ones.
DOC = Params(L=5, K=3, d=2)
PAIR = dict(L=6, K=4, d=2)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.clean_sequences(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.col("text").alias("seq")))


def item_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.clean_sequences(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq_id"), F.col("text").alias("seq")))


def item_alphas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model on the benchmark items: weight 0.5 with the sign of the id's parity."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq_id"), F.when(F.col("item_id") % 2 == 0, 0.5).otherwise(-0.5).alias("alpha"))


_DOCS = "s AS (SELECT doc_id AS id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq FROM documents WHERE length(regexp_replace(text, '[^ACGTacgt]', '', 'g')) > 0)"
_ITEMS = _DOCS.replace("doc_id", "item_id").replace("FROM documents", "FROM benchmark")


def _bag_sql(source: str, L: int, rc: bool = True, name: str = "bag", s: str = "s") -> str:
    both = f"SELECT id, seq FROM {s}" + (f" UNION ALL SELECT id, reverse(translate(seq, 'ACGT', 'TGCA')) FROM {s}" if rc else "")
    return (source + ", " if source else "") + f"{name}_b AS ({both}), {name}_w AS (SELECT id, substr(seq, p, {L}) AS u FROM (SELECT id, seq, unnest(range(1, length(seq) - {L} + 2)) AS p FROM {name}_b WHERE length(seq) >= {L})), {name} AS (SELECT id, u, count(*) AS n FROM {name}_w GROUP BY id, u)"


#: Fixed values of the SQL, not taken from the engine: weights by distance of the registered settings (L=6, K=4 by
#: filter; L=5, K=3 truncated), the pseudo-count's factor and constant, and the minimum-norm weights of L=5, K=3.
PAIR_WEIGHTS = {
    0: [0.46606445312500006, 0.09887695312500003, -0.006591796874999998],
    1: [0.39319580793380743, 0.11171936988830569, 0.0195533037185669],
    2: [15.0, 5.0, 1.0],
    3: [22.0, 6.0, 1.0],
    4: [154.0, 64.0, 40.0],
}
PAIR_PSEUDO = (0.021956889759167108, 0.39150764678197475)
DOC_WEIGHTS = [0.3016815185546875, 0.099700927734375, 0.022247314453125, 0.0, 0.0, 0.0]
DOC_NORM_WEIGHTS = [0.03671875, -0.006901041666666667, 0.0015625, -0.000390625]


def _weights_sql(weights: list[float], d: int) -> str:
    return "CASE m " + " ".join(f"WHEN {m} THEN CAST({w!r} AS DOUBLE)" for m, w in enumerate(weights[: d + 1])) + " ELSE 0.0 END"


# --- sequences and words -----------------------------------------------------------


@query(f"WITH {_DOCS} SELECT id AS seq_id, seq, CAST(length(seq) AS INTEGER) AS n FROM s")
def clean_seq(spark, sf_dir):
    return document_seqs(spark, sf_dir).withColumn("n", F.length("seq"))


@query(f"WITH {_DOCS} SELECT id AS seq_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM s")
def revcomp(spark, sf_dir):
    return document_seqs(spark, sf_dir).select("seq_id", S.reverse_complement(F.col("seq")).alias("rc"))


@query("SELECT doc_id AS seq_id, round(length(regexp_replace(upper(text), '[^GC]', '', 'g')) / length(text), 9) AS gc FROM documents WHERE length(text) > 0")
def gc_content(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    return d.select(F.col("doc_id").alias("seq_id"), F.round(S.gc_content(F.col("text")), 9).alias("gc"))


@query(f"WITH {_DOCS} SELECT id AS seq_id, seq[1:2] || CASE WHEN length(seq) > 2 THEN 'G' || seq[4:] ELSE '' END AS mutated FROM s")
def point_mutation(spark, sf_dir):
    return document_seqs(spark, sf_dir).select("seq_id", S.mutate(F.col("seq"), F.lit(2), F.lit("G")).alias("mutated"))


@query(f"WITH {_DOCS}, d AS (SELECT id, translate(seq, 'ACGT', '0123') AS q FROM s), p AS (SELECT id, CAST(substr(q, i, 1) AS INTEGER) + 4 * CAST(substr(q, i + 1, 1) AS INTEGER) AS x FROM (SELECT id, q, unnest(range(1, length(q))) AS i FROM d)) SELECT x, count(*) AS n FROM p GROUP BY x")
def dinucleotide_counts(spark, sf_dir):
    return document_seqs(spark, sf_dir).select(F.explode(S.dinucleotides(F.col("seq"))).alias("x")).groupBy("x").agg(F.count("*").alias("n"))


@query(f"WITH {_DOCS} SELECT id AS seq_id, CAST(len(list_filter(range(1, length(seq) - 2), lambda i: regexp_full_match(substr(seq, i, 4), 'A..T'))) AS INTEGER) AS hits FROM s")
def pattern_hits(spark, sf_dir):
    return document_seqs(spark, sf_dir).select("seq_id", S.pattern_hits(F.col("seq"), "A..T").alias("hits"))


@query(f"WITH {_bag_sql(_DOCS, 5)} SELECT id AS seq_id, u, n FROM bag")
def lmer_bag(spark, sf_dir):
    return words.bag(document_seqs(spark, sf_dir), 5)


@query(f"WITH {_bag_sql(_DOCS, 5)} SELECT id AS seq_id, count(*) AS n_distinct, CAST(sum(n) AS BIGINT) AS n_total FROM bag GROUP BY id")
def distinct_lmers(spark, sf_dir):
    return words.word_totals(words.bag(document_seqs(spark, sf_dir), 5))


@query(f"WITH {_bag_sql(_DOCS, 6)} SELECT CAST(k AS INTEGER) AS depth, count(DISTINCT substr(u, 1, k)) AS n_prefixes FROM bag, range(1, 7) r(k) GROUP BY k")
def prefix_counts(spark, sf_dir):
    return words.prefix_counts(words.bag(document_seqs(spark, sf_dir), 6), 6)


@query(f"WITH {_bag_sql(_DOCS, 5)} SELECT u, count(*) AS n_seqs, CAST(sum(n) AS BIGINT) AS n_total FROM bag GROUP BY u")
def posting_sizes(spark, sf_dir):
    return words.document_frequency(words.bag(document_seqs(spark, sf_dir), 5))


@query(f"WITH {_bag_sql(_DOCS, 5)}, {_bag_sql(_ITEMS.replace('s AS', 't AS'), 5, name='other', s='t')} SELECT id AS seq_id, u, n FROM bag WHERE u IN (SELECT u FROM other)")
def lmer_lookup(spark, sf_dir):
    return words.lookup(words.bag(document_seqs(spark, sf_dir), 5), words.bag(item_seqs(spark, sf_dir), 5))


@query("SELECT conv_id AS seq_id, count(*) AS n_rows FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return words.duplicate_ids(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("seq_id")))


def _masks_sql(L: int, K: int) -> str:
    each = ["||".join(f"substr(u, {i + 1}, 1)" if i in m else "'.'" for i in range(L)) for m in words.masks(L, K)]
    return "unnest([" + ", ".join(each) + "])"


@query(f"WITH {_bag_sql(_DOCS, 5)}, c AS (SELECT u, sum(n) AS n FROM bag GROUP BY u) SELECT f, CAST(sum(n) AS BIGINT) AS n FROM (SELECT {_masks_sql(5, 3)} AS f, n FROM c) GROUP BY f")
def gapped_counts(spark, sf_dir):
    counts = words.document_frequency(words.bag(document_seqs(spark, sf_dir), 5)).select("u", F.col("n_total").alias("n"))
    return words.gapped_counts(counts, 5, 3)


@query(f"WITH {_bag_sql(_DOCS, 5)}, q AS (SELECT DISTINCT doc_id AS id, quality FROM labels), c AS (SELECT quality, u, sum(n) AS n FROM bag JOIN q USING (id) GROUP BY quality, u), g AS (SELECT f, sum(CASE WHEN quality = 1 THEN n ELSE 0 END) AS p, sum(CASE WHEN quality = 0 THEN n ELSE 0 END) AS q FROM (SELECT quality, {_masks_sql(5, 3)} AS f, n FROM c) GROUP BY f) SELECT f, CAST(p AS BIGINT) AS n_pos, CAST(q AS BIGINT) AS n_neg, CAST(trunc(1e6 * (p - q) / (p + q)) AS INTEGER) AS ratio FROM g")
def posneg_ratio(spark, sf_dir):
    label = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq_id"), "quality").distinct()
    bags = words.bag(document_seqs(spark, sf_dir), 5).join(label, "seq_id").groupBy("quality", "u").agg(F.sum("n").alias("n"))
    counts = words.gapped_counts(bags, 5, 3, ["quality"])
    return words.class_ratio(counts.where("quality = 1"), counts.where("quality = 0"))


@query(f"WITH {_bag_sql(_DOCS, 5)}, {_bag_sql(_ITEMS.replace('s AS', 't AS'), 5, name='other', s='t')}, c AS (SELECT u, sum(n) AS n FROM bag GROUP BY u), g AS (SELECT f, sum(n) AS n FROM (SELECT {_masks_sql(5, 3)} AS f, n FROM c) GROUP BY f), w AS (SELECT u, {_masks_sql(5, 3)} AS h FROM (SELECT DISTINCT u FROM other)), j AS (SELECT u, hamming(f, h) AS m, n FROM w JOIN g ON regexp_replace(f, '[^.]', 'x', 'g') = regexp_replace(h, '[^.]', 'x', 'g')) SELECT u, CAST(m AS INTEGER) AS m, CAST(sum(n) AS BIGINT) AS total FROM j GROUP BY u, m")
def gapped_mismatch_counts(spark, sf_dir):
    counts = words.document_frequency(words.bag(document_seqs(spark, sf_dir), 5)).select("u", F.col("n_total").alias("n"))
    return estimates.mismatch_counts(words.bag(item_seqs(spark, sf_dir), 5), words.gapped_counts(counts, 5, 3), 5, 3)


_ESTIMATES = f"{_bag_sql(_DOCS, 5)}, {_bag_sql(_ITEMS.replace('s AS', 't AS'), 5, name='other', s='t')}, c AS (SELECT u, sum(n) AS n FROM bag GROUP BY u), g AS (SELECT f, sum(n) AS n FROM (SELECT {_masks_sql(5, 3)} AS f, n FROM c) GROUP BY f), w AS (SELECT u, {_masks_sql(5, 3)} AS h FROM (SELECT DISTINCT u FROM other)), j AS (SELECT u, hamming(f, h) AS m, n FROM w JOIN g ON regexp_replace(f, '[^.]', 'x', 'g') = regexp_replace(h, '[^.]', 'x', 'g')), e AS (SELECT u, sum(n * {_weights_sql(DOC_NORM_WEIGHTS, 3)}) AS estimate FROM j GROUP BY u)"


@query(f"WITH {_ESTIMATES} SELECT e.u, round(estimate, 8) AS estimate, round(log10((coalesce(n, 0) + 0.011123657227) / (greatest(estimate, 0) + 0.011123657227)), 4) + 0.0 AS log10_ratio FROM e LEFT JOIN c ON c.u = e.u")
def word_estimates(spark, sf_dir):
    """Minimum-norm counts of the items' words in the documents, and the log10 ratio to the count seen."""
    b = words.document_frequency(words.bag(document_seqs(spark, sf_dir), 5)).select("u", F.col("n_total").alias("n"))
    e = estimates.ml_estimate(words.bag(item_seqs(spark, sf_dir), 5), words.gapped_counts(b, 5, 3), 5, 3)
    j = e.join(b, "u", "left").fillna(0, ["n"])
    ratio = estimates.log10_ratio(F.col("n").cast("double"), F.col("estimate"), DOC.weights())
    return j.select("u", F.round("estimate", 8).alias("estimate"), (F.round(ratio, 4) + 0.0).alias("log10_ratio"))


# --- kernels ---------------------------------------------------------------------------


def _profile_sql(L: int, d: int, rc: bool = True) -> str:
    return f"{_bag_sql(_ITEMS, L, rc)}, p AS (SELECT a.id AS i, b.id AS j, hamming(a.u, b.u) AS m, CAST(sum(a.n * b.n) AS BIGINT) AS cnt FROM bag a JOIN bag b ON a.id >= b.id WHERE hamming(a.u, b.u) <= {d} GROUP BY 1, 2, 3)"


def _kernel_sql(params: Params) -> str:
    d, c = params.max_distance, _weights_sql(PAIR_WEIGHTS[params.filter], params.max_distance)
    if params.pseudo_count:
        factor, constant = PAIR_PSEUDO
        product = f"t AS (SELECT id, sum(n) AS t FROM bag GROUP BY id), v AS (SELECT i, j, sum(cnt * {c}) AS v FROM p GROUP BY i, j), x AS (SELECT a.id AS i, b.id AS j, coalesce(v, 0) + (a.t + b.t) * CAST({factor!r} AS DOUBLE) + CAST({constant!r} AS DOUBLE) AS x FROM t a JOIN t b ON a.id >= b.id LEFT JOIN v ON v.i = a.id AND v.j = b.id)"
    else:
        product = f"x AS (SELECT i, j, sum(cnt * {c}) AS x FROM p GROUP BY i, j)"
    return f"WITH {_profile_sql(params.L, d, params.both_strands)}, {product}, n AS (SELECT i AS id, sqrt(x) AS z FROM x WHERE i = j) SELECT x.i, x.j, round(CASE WHEN x.i = x.j THEN 1.0 WHEN x < 1e-50 THEN 0.0 ELSE x / (a.z * b.z) END, 6) AS k FROM x JOIN n a ON a.id = x.i JOIN n b ON b.id = x.j UNION ALL SELECT id, id, 1.0 FROM s WHERE id NOT IN (SELECT id FROM n)"


@query(f"WITH {_profile_sql(6, 2)} SELECT i, j, CAST(m AS INTEGER) AS m, cnt FROM p")
def mismatch_profile(spark, sf_dir):
    return profiles.profile(words.packed_bag(item_seqs(spark, sf_dir), 6), 6, 2)


@query(f"WITH {_profile_sql(6, 2)} SELECT i, j, CAST(m AS INTEGER) AS m, cnt FROM p")
def mismatch_profile_gapped(spark, sf_dir):
    return profiles.profile(words.packed_bag(item_seqs(spark, sf_dir), 6), 6, 2, plan="gapped")


@query(f"WITH {_bag_sql(_DOCS, 5)} SELECT a.id AS seq_id, CAST(hamming(a.u, b.u) AS INTEGER) AS m, CAST(sum(a.n * b.n) AS BIGINT) AS cnt FROM bag a JOIN bag b ON a.id = b.id GROUP BY 1, 2")
def self_profile(spark, sf_dir):
    return profiles.self_profile(words.packed_bag(document_seqs(spark, sf_dir), 5), 5, 5)


def _kernel(name: str, **options) -> None:
    params = Params(**(PAIR | options))

    def run(spark, sf_dir):
        items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq_id"), F.col("text").alias("seq"))
        k = kernels.kernel(items, params)
        return k.select("i", "j", F.round("k", 6).alias("k"))

    run.__name__ = name
    query(_kernel_sql(params))(run)


for _t in Filter:
    # 2 covers L - K, so that the gapped kernel is the dot product of gapped counts
    _kernel(f"kernel_t{int(_t)}", filter=_t)
_kernel("kernel_pseudo", pseudo_count=True)
_kernel("kernel_norc", both_strands=False)


# --- models ------------------------------------------------------------------------------


def _score_sql(doc_text: str = "text") -> str:
    c_all, c_d = _weights_sql(DOC_WEIGHTS, DOC.L), _weights_sql(DOC_WEIGHTS, DOC.d)
    docs = _DOCS if doc_text == "text" else _DOCS.replace("SELECT doc_id AS id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq", f"SELECT doc_id AS id, {doc_text} AS seq")
    norm = "{n} AS (SELECT id, sqrt(sum(cnt * {c})) AS z FROM (SELECT a.id, hamming(a.u, b.u) AS m, sum(a.n * b.n) AS cnt FROM {b} a JOIN {b} b ON a.id = b.id GROUP BY 1, 2) GROUP BY id)"
    return (
        f"{_bag_sql(docs, DOC.L)}, {_bag_sql(_ITEMS.replace('s AS', 't AS'), DOC.L, name='sv', s='t')}, {norm.format(n='nd', c=c_all, b='bag')}, {norm.format(n='ns', c=c_all, b='sv')}, "
        f"model AS (SELECT u, sum(n * CASE WHEN id % 2 = 0 THEN 0.5 ELSE -0.5 END / z) AS w FROM sv JOIN ns USING (id) GROUP BY u), words AS (SELECT DISTINCT u FROM bag), "
        f"ws AS (SELECT u, sum(w * {c_d}) AS score FROM (SELECT words.u, hamming(words.u, model.u) AS m, w FROM words, model) WHERE m <= {DOC.d} GROUP BY u), raw AS (SELECT id, sum(n * score) AS raw FROM bag JOIN ws USING (u) GROUP BY id), "
        "scored AS (SELECT s.id, coalesce(raw, 0) / z AS score FROM s LEFT JOIN raw USING (id) LEFT JOIN nd USING (id))"
    )


@query(f"WITH {_score_sql()} SELECT id AS seq_id, round(score, 6) + 0.0 AS score FROM scored")
def svm_score(spark, sf_dir):
    model = scoring.fold_model(item_alphas(spark, sf_dir), item_seqs(spark, sf_dir), DOC)
    return scoring.classify(document_seqs(spark, sf_dir), model, DOC).select("seq_id", (F.round("score", 6) + 0.0).alias("score"))


_ALT = "CASE WHEN length(regexp_replace(text, '[^ACGTacgt]', '', 'g')) > 2 THEN upper(regexp_replace(text, '[^ACGTacgt]', '', 'g'))[1:2] || 'G' || upper(regexp_replace(text, '[^ACGTacgt]', '', 'g'))[4:] ELSE upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) END"


@query(f"SELECT r.id AS seq_id, round(a.score - r.score, 6) + 0.0 AS delta FROM (WITH {_score_sql()} SELECT * FROM scored) r JOIN (WITH {_score_sql(_ALT)} SELECT * FROM scored) a USING (id)")
def delta_score(spark, sf_dir):
    ref = document_seqs(spark, sf_dir)
    alt = ref.withColumn("seq", S.mutate(F.col("seq"), F.lit(2), F.lit("G")))
    model = scoring.fold_model(item_alphas(spark, sf_dir), item_seqs(spark, sf_dir), DOC)
    return scoring.delta(ref, alt, model, DOC).select("seq_id", (F.round("delta", 6) + 0.0).alias("delta"))


@query(f"WITH {_score_sql()}, every AS (SELECT list_reduce(list_transform(range(5), lambda k: list_value('A', 'C', 'G', 'T')[1 + (x // CAST(4 ** (4 - k) AS BIGINT)) % 4]), lambda a, b: a || b) AS w, x FROM range(1024) r(x)) SELECT x AS u, round(sum(CASE WHEN m <= {DOC.d} THEN mw * {_weights_sql(DOC_WEIGHTS, DOC.d)} ELSE 0 END), 6) + 0.0 AS score FROM (SELECT x, hamming(every.w, model.u) AS m, model.w AS mw FROM every, model) GROUP BY x")
def score_all_words(spark, sf_dir):
    model = scoring.fold_model(item_alphas(spark, sf_dir), item_seqs(spark, sf_dir), DOC)
    return scoring.score_all_words(model, DOC).select("u", (F.round("score", 6) + 0.0).alias("score"))


def _item_labels(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq_id"), (F.col("item_id") % 2 == 0).cast("int").alias("label"))


@query()
def svm_train(spark, sf_dir):
    return svm.train(QUERIES["kernel_t1"](spark, sf_dir), _item_labels(spark, sf_dir))


@query()
def svm_ascent(spark, sf_dir):
    return svm.train(QUERIES["kernel_t1"](spark, sf_dir), _item_labels(spark, sf_dir), solver="ascent")


@query()
def svm_cross_validation(spark, sf_dir):
    """Settings with their areas; the first row of the best is the one that is refitted."""
    return engine.train_cv(QUERIES["kernel_t1"](spark, sf_dir), _item_labels(spark, sf_dir), [0.1, 1.0, 10.0]).settings


@query()
def svm_cv_means(spark, sf_dir):
    """Per sequence the mean and deviation of its predictions over two repeats, at the best setting."""
    return engine.train_cv(QUERIES["kernel_t1"](spark, sf_dir), _item_labels(spark, sf_dir), [0.1, 1.0], repeats=2).means


@query()
def svm_refit(spark, sf_dir):
    """The model of all sequences at the best setting."""
    return engine.train_cv(QUERIES["kernel_t1"](spark, sf_dir), _item_labels(spark, sf_dir), [0.1, 1.0]).model


@query("SELECT item_id AS seq_id, CAST(row_number() OVER (ORDER BY md5('folds-1' || CAST(item_id AS VARCHAR)), item_id) % 5 + 1 AS INTEGER) AS cv_set FROM benchmark")
def cv_folds(spark, sf_dir):
    return svm.assign_folds(_item_labels(spark, sf_dir), 5)


_FOLDS = "f AS (SELECT item_id AS seq_id, row_number() OVER (ORDER BY md5('folds-1' || CAST(item_id AS VARCHAR)), item_id) % 5 + 1 AS cv_set FROM benchmark), o AS (SELECT *, row_number() OVER (ORDER BY seq_id) - 1 AS place, count(*) OVER () AS n FROM f)"


@query(f"WITH {_FOLDS} SELECT CAST(r AS INTEGER) AS repeat, a.seq_id, CAST(b.cv_set AS INTEGER) AS cv_set FROM range(1, 4) t(r), o a JOIN o b ON b.place = (a.place + r) % a.n")
def cv_rotated_folds(spark, sf_dir):
    return svm.rotate_folds(svm.assign_folds(_item_labels(spark, sf_dir), 5), 3)


# --- metrics -----------------------------------------------------------------------------


def _scored(spark, sf_dir):
    """Documents' lengths as a score of their quality, by language."""
    q = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).distinct()
    return table(spark, sf_dir, "documents").join(q, "doc_id").select(F.col("lang").alias("fold"), F.col("n_chars").cast("double").alias("score"), "label")


_SCORED = "x AS (SELECT lang AS fold, CAST(n_chars AS DOUBLE) AS score, quality AS label FROM documents JOIN (SELECT DISTINCT doc_id, quality FROM labels) USING (doc_id)), c AS (SELECT fold, score, sum(label) AS pos, sum(1 - label) AS neg FROM x GROUP BY fold, score), r AS (SELECT fold, score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY fold) AS p, sum(neg) OVER (PARTITION BY fold) AS n FROM c WINDOW w AS (PARTITION BY fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"


@query(f"WITH {_SCORED}, b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY fold ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) SELECT fold, round(sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0), 9) AS auroc FROM b GROUP BY fold")
def auroc(spark, sf_dir):
    return metrics.auroc(_scored(spark, sf_dir)).select("fold", F.round("auroc", 9).alias("auroc"))


@query(f"WITH {_SCORED}, g AS (SELECT fold, (tp / nullif(p, 0) - coalesce(lag(tp / nullif(p, 0)) OVER (PARTITION BY fold ORDER BY score DESC), 0)) * (tp / (tp + fp)) AS a FROM r) SELECT fold, round(sum(a), 9) AS auprc FROM g GROUP BY fold")
def auprc(spark, sf_dir):
    return metrics.auprc(_scored(spark, sf_dir)).select("fold", F.round("auprc", 9).alias("auprc"))


@query(f"WITH {_SCORED} SELECT fold, score, round(tp / nullif(p, 0), 9) AS tpr, round(fp / nullif(n, 0), 9) AS fpr, round(tp / (tp + fp), 9) AS precision FROM r")
def roc_curve(spark, sf_dir):
    return metrics.curve(_scored(spark, sf_dir)).select("fold", "score", *(F.round(c, 9).alias(c) for c in ("tpr", "fpr", "precision")))


# --- intervals ---------------------------------------------------------------------------


def _intervals(spark, sf_dir, flag: str) -> DataFrame:
    """Line items as intervals: the supplier is the chromosome, the order the start, the quantity the width."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)
    return li.select(F.col("l_suppkey").cast("string").alias("chrom"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + F.col("l_quantity").cast("bigint") - 1).alias("end"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))


_IV = "{n} AS (SELECT l_suppkey AS chrom, l_orderkey AS lo, l_orderkey + CAST(l_quantity AS BIGINT) - 1 AS hi, l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_returnflag = '{f}')"
_OVERLAP = f"{_IV.format(n='a', f='A')}, {_IV.format(n='b', f='R')}, o AS (SELECT a.id AS id_a, b.id AS id_b, least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1 AS width FROM a JOIN b ON a.chrom = b.chrom AND a.lo <= b.hi AND b.lo <= a.hi WHERE a.hi >= a.lo AND b.hi >= b.lo)"


@query(f"WITH {_OVERLAP} SELECT id_a, id_b, CAST(width AS BIGINT) AS width FROM o")
def interval_overlaps(spark, sf_dir):
    return intervals.overlaps(_intervals(spark, sf_dir, "A"), _intervals(spark, sf_dir, "R"), 64)


@query(f"WITH {_OVERLAP} SELECT a.id, round(coalesce(w, 0) / (hi - lo + 1), 9) AS fraction FROM a LEFT JOIN (SELECT id_a, sum(width) AS w FROM o GROUP BY id_a) ON id = id_a")
def overlap_fraction(spark, sf_dir):
    f = intervals.covered_fraction(_intervals(spark, sf_dir, "A"), _intervals(spark, sf_dir, "R"), 64)
    return f.select("id", F.round("fraction", 9).alias("fraction"))


@query("WITH g AS (SELECT n_nationkey AS ord, n_name AS chrom, CAST(200 * (1 + n_regionkey) AS BIGINT) AS length FROM nation), c AS (SELECT *, coalesce(sum(length) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g) SELECT o_orderkey AS id, o_custkey AS pos, chrom, CAST(o_custkey - before AS BIGINT) AS \"offset\" FROM orders JOIN c ON o_custkey > before AND o_custkey <= before + length")
def genome_positions(spark, sf_dir):
    g = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("chrom"), (200 * (1 + F.col("n_regionkey"))).cast("bigint").alias("length"))
    return intervals.locate(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("pos")), g).select("id", "pos", "chrom", "offset")


@query("WITH g AS (SELECT s_suppkey AS chrom, CAST(40000 AS BIGINT) AS length FROM supplier WHERE s_nationkey < 20), a AS (SELECT l_suppkey AS chrom, l_orderkey AS lo, l_orderkey + CAST(l_quantity AS BIGINT) - 1 AS hi, l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_returnflag = 'A') SELECT id, CAST(a.chrom AS VARCHAR) AS chrom FROM a LEFT JOIN g ON a.chrom = g.chrom WHERE length IS NULL OR hi > length OR lo < 1")
def bad_intervals(spark, sf_dir):
    sizes = table(spark, sf_dir, "supplier").where("s_nationkey < 20").select(F.col("s_suppkey").cast("string").alias("chrom"), F.lit(40000).cast("bigint").alias("length"))
    return intervals.bad_intervals(_intervals(spark, sf_dir, "A"), sizes).select("id", "chrom")


@query()
def null_sequences(spark, sf_dir):
    """Matched background of the middle half of each benchmark item, drawn from all items."""
    genome = item_seqs(spark, sf_dir).select(F.col("seq_id").cast("string").alias("chrom"), "seq")
    n = F.length("seq").cast("bigint")
    pos = item_seqs(spark, sf_dir).where(n >= 8).select(F.col("seq_id").alias("id"), F.col("seq_id").cast("string").alias("chrom"), (F.floor(n / 4) + 1).alias("start"), F.floor(3 * n / 4).alias("end"), F.lit("+").alias("strand"))
    masks = pos.select("chrom", F.lit(5).cast("bigint").alias("start"), F.lit(6).cast("bigint").alias("end"))
    return background.null_sequences(pos, genome, masks)
