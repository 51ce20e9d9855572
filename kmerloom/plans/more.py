"""Further named queries: sources and sinks (written, read again), weights, single words, log ratios, and small operators.

Imported by the catalog's users beside kmerloom.plans.catalog, whose tables it fills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom import engine
from kmerloom.functions import sequences as S
from kmerloom.functions import weights as W
from kmerloom.functions.weights import Filter, Params
from kmerloom.operators import background, estimates, intervals, kernels, metrics, profiles, scoring, svm, words
from kmerloom.sources import fasta, tables

from .catalog import _DOCS, _ITEMS, _SCORED, DOC, DOC_WEIGHTS, PAIR, PAIR_WEIGHTS, QUERIES, _bag_sql, _kernel_sql, _masks_sql, _scored, _weights_sql, document_seqs, item_alphas, item_seqs, query, table
from .lineage import saved, shared_path

_ITEM_BAG5 = f"{_bag_sql(_ITEMS, 5)}"


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("seq_id", F.concat(F.lit("d"), F.col("seq_id").cast("string")))


# --- sources and sinks -------------------------------------------------------------------


@query(f"WITH {_DOCS} SELECT 'd' || id AS seq_id, seq, 'd' || id || chr(9) || length(seq) AS header FROM s")
def fasta_files(spark, sf_dir):
    """All sequences written as FASTA and read again."""
    path = shared_path(spark, "fasta")
    fasta.write_fasta(_named(document_seqs(spark, sf_dir)), path)
    return fasta.read_fasta(spark, path)


@query(f"WITH {_DOCS} SELECT 'd' || id AS seq_id, CAST(id % 2 AS VARCHAR) AS label, seq FROM s")
def tab_files(spark, sf_dir):
    path = shared_path(spark, "tab")
    tables.write_tab(document_seqs(spark, sf_dir).withColumn("label", F.col("seq_id") % 2).transform(_named), path)
    return tables.read_tab(spark, path)


@query("SELECT * FROM (VALUES ('one', 'ACGT'), ('two', 'GG')) t(seq_id, seq)")
def literal_source(spark, sf_dir):
    return tables.literal(spark, one="ACGT", two="GG")


@query("SELECT 'd' || doc_id AS seq_id FROM documents")
def id_files(spark, sf_dir):
    path = shared_path(spark, "ids")
    table(spark, sf_dir, "documents").select(F.concat(F.lit(" d"), F.col("doc_id").cast("string"), F.lit(" more")).alias("value")).write.text(path)
    return tables.read_ids(spark, path)


@query("SELECT CAST(item_id AS VARCHAR) AS seq_id, CAST(CASE WHEN item_id % 2 = 0 THEN 0.5 ELSE -0.5 END AS DOUBLE) AS alpha FROM benchmark")
def weight_files(spark, sf_dir):
    path = shared_path(spark, "alphas")
    tables.write_alphas(item_alphas(spark, sf_dir), path)
    return tables.read_alphas(spark, path)


@query(f"WITH {_ITEMS} SELECT CAST(item_id AS VARCHAR) AS seq_id, CAST(CASE WHEN item_id % 2 = 0 THEN 0.5 ELSE -0.5 END AS DOUBLE) AS alpha, seq FROM benchmark JOIN s ON s.id = item_id")
def model_files(spark, sf_dir):
    """A model written as two files, read again and matched by id."""
    a, q = shared_path(spark, "model"), shared_path(spark, "support")
    engine.write_model(item_alphas(spark, sf_dir), item_seqs(spark, sf_dir), a, q)
    alphas, seqs = engine.read_model(spark, a, q)
    return scoring.support(alphas, seqs).select("seq_id", "alpha", "seq")


@query("SELECT 'ACGT' AS alphabet")
def alphabet_file(spark, sf_dir):
    path = shared_path(spark, "alphabet")
    spark.createDataFrame([("A\nC\ng\nT",)], "value string").write.text(path)
    return spark.createDataFrame([(tables.read_alphabet(spark, path),)], "alphabet string")


@query(f"WITH k AS ({_kernel_sql(Params(**PAIR))}), o AS (SELECT item_id AS id, row_number() OVER (ORDER BY item_id) - 1 AS n FROM benchmark), e AS (SELECT a.n AS i, b.n AS j FROM o a, o b), t AS (SELECT a.n AS i, b.n AS j, k FROM k JOIN o a ON a.id = k.i JOIN o b ON b.id = k.j) SELECT e.i, e.j, coalesce(t.k, 0.0) AS k FROM e LEFT JOIN t ON t.i = greatest(e.i, e.j) AND t.j = least(e.i, e.j)")
def kernel_files(spark, sf_dir):
    """The kernel as a lower-triangular text file, read into both triangles."""
    k = QUERIES["kernel_t1"](spark, sf_dir)
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")).withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1))
    from .ranks import by_quantile, running_sums

    n = saved(running_sums(by_quantile(ids, "id", "_all"), "_slot", [F.col("id")], {"n": "_one"}).select("id", "n"))
    at = lambda c: n.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"))
    path = shared_path(spark, "kernel")
    tables.write_kernel_text(k.join(at("i"), "i").join(at("j"), "j").select(F.col("n_i").alias("i"), F.col("n_j").alias("j"), "k"), path)
    return tables.read_kernel_text(spark, path).select("i", "j", F.round("k", 6).alias("k"))


@query("SELECT doc_id || chr(9) || printf('%.6f', n_chars / 7.0) AS value FROM documents")
def score_files(spark, sf_dir):
    path = shared_path(spark, "scores")
    tables.write_scores(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), (F.col("n_chars") / 7.0).alias("score")), path)
    return spark.read.text(path)


@query("SELECT doc_id || ' ' || CAST(n_chars % 100000 - 99.5 AS DOUBLE) AS value FROM documents")
def delta_files(spark, sf_dir):
    path = shared_path(spark, "delta")
    tables.write_delta(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), (F.col("n_chars") % 100000 - 99.5).alias("delta")), path)
    return spark.read.text(path)


@query("SELECT doc_id || chr(9) || printf('%.5f', n_chars / 3.0) || chr(9) || CASE WHEN doc_id % 2 = 1 THEN '1' ELSE '-1' END || chr(9) || doc_id % 5 AS value FROM documents")
def prediction_files(spark, sf_dir):
    path = shared_path(spark, "predictions")
    d = table(spark, sf_dir, "documents")
    tables.write_cv_predictions(d.select(F.col("doc_id").alias("seq_id"), (F.col("n_chars") / 3.0).alias("cvpred_mean"), (F.col("doc_id") % 2).alias("label"), (F.col("doc_id") % 5 + 1).alias("cv_set")), path)
    return spark.read.text(path)


@query("SELECT * FROM (VALUES ('0' || chr(9) || '0.5' || chr(9) || '0.75' || chr(9) || '0.625'), ('1' || chr(9) || '2.0' || chr(9) || '1.0' || chr(9) || '0.5')) t(value)")
def area_files(spark, sf_dir):
    path = shared_path(spark, "areas")
    tables.write_auc_table(spark.createDataFrame([(0, 0.5, 0.75, 0.625), (1, 2.0, 1.0, 0.5)], "idx int, c double, auroc double, auprc double"), path)
    return spark.read.text(path)


def _line_intervals(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'")
    return li.select(F.concat(F.lit("chr"), F.col("l_suppkey").cast("string")).alias("chrom"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + F.col("l_quantity").cast("bigint") - 1).alias("end"))


@query("SELECT 'chr' || l_suppkey AS chrom, l_orderkey AS start, CAST(l_orderkey + CAST(l_quantity AS BIGINT) - 1 AS BIGINT) AS \"end\", '*' AS strand FROM lineitem WHERE l_returnflag = 'A'")
def bed_files(spark, sf_dir):
    path = shared_path(spark, "bed")
    tables.write_bed(_line_intervals(spark, sf_dir), path)
    return tables.read_bed(spark, path)


@query("SELECT 'chr' || l_suppkey || chr(9) || l_orderkey || chr(9) || (l_orderkey + CAST(l_quantity AS BIGINT) - 1) AS value FROM lineitem WHERE l_returnflag = 'A'")
def bed_files_one_based(spark, sf_dir):
    """BED lines with the 1-based start left as it is."""
    path = shared_path(spark, "bed1")
    tables.write_bed(_line_intervals(spark, sf_dir), path, zero_based=False)
    return spark.read.text(path)


@query(f"WITH {_DOCS} SELECT CAST(id AS VARCHAR) AS chrom, CAST(t AS INTEGER) AS tile, substr(seq, 100 * t + 1, 100) AS seq FROM (SELECT id, seq, unnest(range(0, (length(seq) + 99) // 100)) AS t FROM s)")
def genome_tiles(spark, sf_dir):
    """The sequences as a genome, cut into tiles of 100 letters."""
    return intervals.tiles(document_seqs(spark, sf_dir).select(F.col("seq_id").cast("string").alias("chrom"), "seq"), 100)


def _genome_and_intervals(spark, sf_dir):
    g = document_seqs(spark, sf_dir).select(F.col("seq_id").cast("string").alias("chrom"), "seq")
    n = F.length("seq").cast("bigint")
    iv = g.where(n >= 8).select("chrom", (F.floor(n / 4) + 1).alias("start"), F.floor(3 * n / 4).alias("end"), F.when(F.col("chrom").cast("bigint") % 2 == 0, "+").otherwise("-").alias("strand"))
    return g, iv


_MIDDLE = f"{_DOCS}, m AS (SELECT id, CAST(id AS VARCHAR) AS chrom, length(seq) // 4 + 1 AS start, (3 * length(seq)) // 4 AS e, seq, CASE WHEN id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM s WHERE length(seq) >= 8), q AS (SELECT *, substr(seq, start, e - start + 1) AS x FROM m)"


@query(f"WITH {_MIDDLE} SELECT chrom, CAST(start AS BIGINT) AS start, CAST(e AS BIGINT) AS \"end\", strand, CASE WHEN strand = '+' THEN x ELSE reverse(translate(x, 'ACGT', 'TGCA')) END AS seq FROM q")
def interval_sequences(spark, sf_dir):
    """The middle half of every sequence, fetched through tiles of 64 letters; every other one from the other strand."""
    g, iv = _genome_and_intervals(spark, sf_dir)
    return intervals.fetch(iv, g, 64).select("chrom", "start", "end", "strand", "seq")


@query(f"WITH {_MIDDLE} SELECT chrom || '_' || start || '_' || e || '_neg_' || row_number() OVER (ORDER BY chrom, start, e) AS seq_id, x AS seq FROM q")
def interval_files(spark, sf_dir):
    """Intervals as FASTA records named by place, suffix and number."""
    g, iv = _genome_and_intervals(spark, sf_dir)
    path = shared_path(spark, "intervals")
    fasta.write_fasta(fasta.interval_names(intervals.fetch(iv.withColumn("strand", F.lit("+")), g, 64), "neg").select("seq_id", "seq"), path)
    return fasta.read_fasta(spark, path).select("seq_id", "seq")


# --- packed words and predicates -----------------------------------------------------------


@query(f"WITH {_DOCS} SELECT id AS seq_id, substr(seq, 4, 6) AS part, substr(seq, 1, 3) AS head FROM s")
def subsequences(spark, sf_dir):
    return document_seqs(spark, sf_dir).select("seq_id", S.subsequence(F.col("seq"), 3, 6).alias("part"), S.subsequence(F.col("seq"), -2, 5).alias("head"))


_CODE = "(strpos('ACGT', substr({w}, 1, 1)) - 1) * 256 + (strpos('ACGT', substr({w}, 2, 1)) - 1) * 64 + (strpos('ACGT', substr({w}, 3, 1)) - 1) * 16 + (strpos('ACGT', substr({w}, 4, 1)) - 1) * 4 + strpos('ACGT', substr({w}, 5, 1)) - 1"


@query(f"WITH {_bag_sql(_DOCS, 5)} SELECT DISTINCT u AS word, CAST({_CODE.format(w='u')} AS BIGINT) AS code, CAST({_CODE.format(w='reverse(translate(u, {q}ACGT{q}, {q}TGCA{q}))'.replace('{q}', chr(39)))} AS BIGINT) AS rc_code FROM bag")
def packed_words(spark, sf_dir):
    """Distinct words with their numbers, those of their reverse complements, and the words unpacked again."""
    b = words.packed_bag(document_seqs(spark, sf_dir), 5).select(F.col("u").alias("code")).distinct()
    return b.select(S.unpack(F.col("code"), 5).alias("word"), "code", S.reverse_complement_code(F.col("code"), 5).alias("rc_code"))


@query(f"WITH x AS (SELECT conv_id AS id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq FROM conversations), s AS (SELECT * FROM x WHERE length(seq) > 0), {_bag_sql('', 4).removeprefix(', ')} SELECT id AS seq_id, u, n FROM bag")
def merged_bags(spark, sf_dir):
    """Turns of one conversation are sequences of one id: their words merge."""
    c = words.clean_sequences(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("seq_id"), F.col("text").alias("seq")))
    return words.bag(c, 4)


@query(f"WITH {_DOCS} SELECT id AS seq_id, seq FROM s WHERE (id + 1) % 7 = 3")
def partition_rows(spark, sf_dir):
    return words.partition_filter(document_seqs(spark, sf_dir).withColumn("ordinal", F.col("seq_id") + 1), 7, 3).select("seq_id", "seq")


@query(f"WITH {_bag_sql(_DOCS, 5)} SELECT id AS seq_id, u, n FROM bag WHERE substr(u, 1, 1) IN ('A', 'C')")
def first_letter_words(spark, sf_dir):
    return words.first_letters(words.bag(document_seqs(spark, sf_dir), 5))


@query(f"WITH {_bag_sql(_DOCS, 5)} SELECT u, id AS seq_id, n FROM bag WHERE n > 1")
def word_postings(spark, sf_dir):
    return words.postings(words.bag(document_seqs(spark, sf_dir), 5)).where("n > 1")


@query(f"WITH {_bag_sql(_DOCS, 5)}, c AS (SELECT u, sum(n) AS n FROM bag GROUP BY u), g AS (SELECT {_masks_sql(5, 3)} AS f, n FROM c) SELECT f, CAST(sum(n) AS BIGINT) AS n FROM g WHERE substr(f, 1, 1) IN ('A', 'C') GROUP BY f")
def gapped_counts_half(spark, sf_dir):
    """Gapped words with their first place fixed, the half of them that the other strand doesn't give."""
    counts = words.document_frequency(words.bag(document_seqs(spark, sf_dir), 5)).select("u", F.col("n_total").alias("n"))
    return words.gapped_counts(counts, 5, 3, half=True)


@query("SELECT doc_id AS seq_id, (CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 3 = 1 THEN 0.25 ELSE -0.25 END)::DOUBLE AS alpha FROM documents WHERE doc_id % 3 <> 0")
def support_rows(spark, sf_dir):
    a = F.when(F.col("doc_id") % 3 == 0, 1e-12).when(F.col("doc_id") % 3 == 1, 0.25).otherwise(-0.25)
    return svm.support(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), a.alias("alpha")))


# --- weights ---------------------------------------------------------------------------------

#: Weights by distance at the default settings (L=10, K=6, M=2), by filter; of the full one the first three.
_DEFAULTS = {
    "truncated": [0.16959830600535497, 0.05573480820748955, 0.014950497890822588, 0.0027788987208623426, 0.0002526271564420311, 0, 0, 0, 0, 0, 0],
    "gapped": [210, 84, 28, 7, 1, 0, 0, 0, 0, 0, 0],
    "wildcard": [56, 10, 1, 0, 0, 0, 0, 0, 0, 0, 0],
    "mismatch": [436, 112, 64, 18, 6, 0, 0, 0, 0, 0, 0],
}
_ROWS = ", ".join(f"('{name}', {m}, {float(w)!r})" for name, ws in _DEFAULTS.items() for m, w in enumerate(ws))


@query(f"SELECT kind, CAST(m AS INTEGER) AS m, round(CAST(w AS DOUBLE), 9) AS w FROM (VALUES {_ROWS}) t(kind, m, w)")
def default_weights(spark, sf_dir):
    kinds = {"truncated": Filter.TRUNCATED, "gapped": Filter.GAPPED, "wildcard": Filter.WILDCARD, "mismatch": Filter.MISMATCH}
    rows = [(name, m, w) for name, f in kinds.items() for m, w in enumerate(Params(filter=f).weights())]
    return spark.createDataFrame(rows, "kind string, m int, w double").select("kind", "m", F.round("w", 9).alias("w"))


#: Minimum-norm weights times C(L,K) 4^L of published settings.
_ML = {(15, 7): [18575560, -5145388.57, 1463262.86, -424597.71, 125173.71, -37374.86, 11276.57, -3432], (13, 7): [5382976, -1397214.9, 379120, -106206.4, 30470.4, -8904, 2640, -792]}
_ML_ROWS = ", ".join(f"({L}, {K}, {m}, {float(w)!r})" for (L, K), ws in _ML.items() for m, w in enumerate(ws))


@query(f"SELECT CAST(l AS INTEGER) AS l, CAST(k AS INTEGER) AS k, CAST(m AS INTEGER) AS m, round(CAST(w AS DOUBLE), 1) AS w FROM (VALUES {_ML_ROWS}) t(l, k, m, w)")
def minimum_norm_weights(spark, sf_dir):
    rows = [(L, K, m, w) for L, K in _ML for m, w in enumerate(W.ml_weights(L, K, normalised=False))]
    return spark.createDataFrame(rows, "l int, k int, m int, w double").select("l", "k", "m", F.round("w", 1).alias("w"))


@query("SELECT CAST(n AS INTEGER) AS n, CAST(r AS INTEGER) AS r, CAST(CASE WHEN r > n THEN 0 ELSE round(gamma(n + 1) / (gamma(r + 1) * gamma(n - r + 1))) END AS DOUBLE) AS c FROM range(0, 12) a(n), range(0, 12) b(r)")
def binomials(spark, sf_dir):
    return spark.createDataFrame([(n, r, W.choose(n, r)) for n in range(12) for r in range(12)], "n int, r int, c double")


@query("SELECT * FROM (VALUES ('full', 10), ('truncated', 4), ('gapped', 4), ('wildcard', 2), ('mismatch', 4)) t(kind, d)")
def automatic_distances(spark, sf_dir):
    kinds = {"full": Filter.FULL, "truncated": Filter.TRUNCATED, "gapped": Filter.GAPPED, "wildcard": Filter.WILDCARD, "mismatch": Filter.MISMATCH}
    return spark.createDataFrame([(name, Params(d=-1, filter=f).max_distance) for name, f in kinds.items()], "kind string, d int")


@query(f"WITH {_bag_sql(_ITEMS, 5)}, p AS (SELECT a.id AS i, b.id AS j, hamming(a.u, b.u) AS m, sum(a.n * b.n) AS cnt FROM bag a JOIN bag b ON a.id >= b.id GROUP BY 1, 2, 3), x AS (SELECT i, j, sum(cnt / (1.0 + m) / (1.0 + m)) AS x FROM p WHERE m <= 2 GROUP BY i, j), n AS (SELECT i AS id, sqrt(x) AS z FROM x WHERE i = j) SELECT x.i, x.j, round(CASE WHEN x.i = x.j THEN 1.0 ELSE x / (a.z * b.z) END, 6) AS k FROM x JOIN n a ON a.id = x.i JOIN n b ON b.id = x.j UNION ALL SELECT id, id, 1.0 FROM s WHERE id NOT IN (SELECT id FROM n)")
def kernel_own_weights(spark, sf_dir):
    """A kernel with the caller's weights 1 / (1 + m)^2, up to distance 2."""
    k = kernels.kernel(item_seqs(spark, sf_dir), Params(L=5, K=3, d=2, custom=lambda m: 1.0 / (1.0 + m) / (1.0 + m)))
    return k.select("i", "j", F.round("k", 6).alias("k"))


# --- joins of words -----------------------------------------------------------------------------


@query(f"WITH {_ITEM_BAG5} SELECT a.id AS i, b.id AS j, CAST(hamming(a.u, b.u) AS INTEGER) AS m, CAST(sum(a.n * b.n) AS BIGINT) AS cnt FROM bag a JOIN bag b ON a.id >= b.id GROUP BY 1, 2, 3")
def mismatch_profile_all(spark, sf_dir):
    """Word pairs at every distance: what the pairwise comparison of two bags gives."""
    p = profiles.profile(words.packed_bag(item_seqs(spark, sf_dir), 5), 5, 5, plan="gapped")
    return p.select("i", "j", F.col("m").cast("int").alias("m"), "cnt")


_WORD = "ACGTA"


@query(f"WITH {_bag_sql(_DOCS, 5)} SELECT id AS seq_id, CAST(hamming(u, '{_WORD}') AS INTEGER) AS m, CAST(sum(n) AS BIGINT) AS cnt FROM bag GROUP BY 1, 2")
def word_against_bags(spark, sf_dir):
    return profiles.word_profile(words.packed_bag(document_seqs(spark, sf_dir), 5), S.pack(F.lit(_WORD)), 5)


@query(f"WITH {_bag_sql(_DOCS, 5)} SELECT id AS seq_id, CAST(hamming(u, '{_WORD}') AS INTEGER) AS m, CAST(sum(n) AS BIGINT) AS cnt FROM bag WHERE hamming(u, '{_WORD}') <= 2 GROUP BY 1, 2")
def word_against_bags_bounded(spark, sf_dir):
    return profiles.word_profile(words.packed_bag(document_seqs(spark, sf_dir), 5), S.pack(F.lit(_WORD)), 5, 2)


@query(f"WITH {_bag_sql(_DOCS, 5)}, p AS (SELECT id, hamming(u, '{_WORD}') AS m, sum(n) AS cnt FROM bag GROUP BY 1, 2) SELECT id AS seq_id, round(sum(cnt * {_weights_sql(DOC_WEIGHTS, 5)}), 6) AS score FROM p GROUP BY id")
def word_scores(spark, sf_dir):
    """The weighted matches of one word with every sequence."""
    s = scoring.score_word(words.packed_bag(document_seqs(spark, sf_dir), 5), S.pack(F.lit(_WORD)), DOC)
    return s.select("seq_id", F.round("score", 6).alias("score"))


_BINARY = "s AS (SELECT item_id AS id, regexp_replace(translate(text, 'abAB', 'ABAB'), '[^AB]', '', 'g') AS seq FROM benchmark WHERE length(regexp_replace(text, '[^ABab]', '', 'g')) > 0)"


@query(f"WITH {_bag_sql(_BINARY, 4, rc=False)} SELECT a.id AS i, b.id AS j, CAST(hamming(a.u, b.u) AS INTEGER) AS m, CAST(sum(a.n * b.n) AS BIGINT) AS cnt FROM bag a JOIN bag b ON a.id >= b.id WHERE hamming(a.u, b.u) <= 2 GROUP BY 1, 2, 3")
def mismatch_profile_two_letters(spark, sf_dir):
    """The letters A and B alone: an alphabet of two, one strand."""
    d = words.clean_sequences(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq_id"), F.col("text").alias("seq")), alphabet="AB")
    p = profiles.profile(words.packed_bag(d, 4, alphabet="AB"), 4, 2, b=2)
    return p.select("i", "j", F.col("m").cast("int").alias("m"), "cnt")


@query(f"WITH {_bag_sql(_ITEMS, 6)}, p AS (SELECT a.id AS i, b.id AS j, hamming(a.u, b.u) AS m, sum(a.n * b.n) AS cnt FROM bag a JOIN bag b ON a.id >= b.id GROUP BY 1, 2, 3), x AS (SELECT i, j, sum(cnt * {_weights_sql(PAIR_WEIGHTS[1], 2)}) AS x FROM p WHERE m <= 2 GROUP BY i, j), n AS (SELECT i AS id, sqrt(x) AS z FROM x WHERE i = j) SELECT x.i, x.j, round(CASE WHEN x.i = x.j THEN 1.0 ELSE x / (a.z * b.z) END, 6) AS k FROM x JOIN n a ON a.id = x.i JOIN n b ON b.id = x.j UNION ALL SELECT id, id, 1.0 FROM s WHERE id NOT IN (SELECT id FROM n)")
def kernel_all_distances(spark, sf_dir):
    """The pairwise form, which counts every distance with a weight, though the maximum is 1."""
    k = kernels.kernel(item_seqs(spark, sf_dir), Params(L=6, K=4, d=1), all_distances=True)
    return k.select("i", "j", F.round("k", 6).alias("k"))


@query(f"WITH k AS ({_kernel_sql(Params(**PAIR))}), b AS (SELECT i, j, k FROM k UNION ALL SELECT j, i, k FROM k WHERE i <> j) SELECT i, round(sum(k * CASE WHEN j % 2 = 0 THEN 0.5 ELSE -0.5 END), 8) + 0.0 AS score FROM b GROUP BY i")
def pairwise_scores(spark, sf_dir):
    """Scores from kernel rows and weights."""
    s = scoring.kernel_scores(kernels.full_matrix(QUERIES["kernel_t1"](spark, sf_dir)), item_alphas(spark, sf_dir))
    return s.select("i", (F.round("score", 8) + 0.0).alias("score"))


@query(f"WITH k AS ({_kernel_sql(Params(**PAIR))}), b AS (SELECT i, j, k FROM k UNION ALL SELECT j, i, k FROM k WHERE i <> j), a AS (SELECT item_id AS id, CASE WHEN item_id % 2 = 0 THEN 0.5 ELSE -0.5 END AS alpha FROM benchmark) SELECT round((SELECT sum(abs(alpha)) FROM a) - sum(x.alpha * y.alpha * k) / 2, 8) AS objective FROM b JOIN a x ON x.id = i JOIN a y ON y.id = j")
def dual_objective(spark, sf_dir):
    o = svm.objective(kernels.full_matrix(QUERIES["kernel_t1"](spark, sf_dir)), item_alphas(spark, sf_dir))
    return o.select(F.round("objective", 8).alias("objective"))


# --- estimates ----------------------------------------------------------------------------------

_COUNTS = f"{_bag_sql(_DOCS, 5)}, c AS (SELECT u, sum(n) AS n FROM bag GROUP BY u), g AS (SELECT f, sum(n) AS n FROM (SELECT {_masks_sql(5, 3)} AS f, n FROM c) GROUP BY f)"


def _feature_counts(spark, sf_dir):
    counts = words.document_frequency(words.bag(document_seqs(spark, sf_dir), 5)).select("u", F.col("n_total").alias("n"))
    return counts, words.gapped_counts(counts, 5, 3)


@query(f"WITH {_COUNTS} SELECT round(sum(n) / 640.0, 4) AS mean, round(sum(n * n) / 640.0 - (sum(n) / 640.0) ** 2, 2) AS variance FROM g")
def feature_moments(spark, sf_dir):
    m = estimates.table_moments(_feature_counts(spark, sf_dir)[1], 5, 3)
    return m.select(F.round("mean", 4).alias("mean"), F.round("variance", 2).alias("variance"))


@query(f"WITH {_COUNTS}, a AS (SELECT sum(ln(1 + n)) / 640.0 AS mean FROM g) SELECT f, round(ln(1 + n) - mean, 6) + 0.0 AS n FROM g, a")
def feature_log_counts(spark, sf_dir):
    return estimates.log_counts(_feature_counts(spark, sf_dir)[1], 5, 3).select("f", (F.round("n", 6) + 0.0).alias("n"))


@query(f"WITH {_COUNTS}, a AS (SELECT sum(ln(1 + n)) / 640.0 AS mean FROM g), l AS (SELECT f, ln(1 + n) - mean AS n FROM g, a), w AS (SELECT u, {_masks_sql(5, 3)} AS h FROM c), j AS (SELECT u, hamming(f, h) AS m, n FROM w JOIN l ON regexp_replace(f, '[^.]', 'x', 'g') = regexp_replace(h, '[^.]', 'x', 'g')) SELECT u, round(sum(n * CASE m WHEN 0 THEN 0.03671875 WHEN 1 THEN -0.006901041666666667 WHEN 2 THEN 0.0015625 ELSE -0.000390625 END), 6) + 0.0 AS estimate FROM j GROUP BY u")
def log_estimates(spark, sf_dir):
    """Minimum-norm estimates on centred log counts, of all words of the documents."""
    counts, features = _feature_counts(spark, sf_dir)
    return estimates.log_estimate(counts, features, 5, 3).select("u", (F.round("estimate", 6) + 0.0).alias("estimate"))


@query(f"WITH {_COUNTS}, w AS (SELECT u, {_masks_sql(5, 3)} AS h FROM c), j AS (SELECT u, hamming(f, h) AS m, n FROM w JOIN g ON regexp_replace(f, '[^.]', 'x', 'g') = regexp_replace(h, '[^.]', 'x', 'g')) SELECT u, round(sum(n * CASE m WHEN 0 THEN 0.03671875::DOUBLE WHEN 1 THEN -0.006901041666666667::DOUBLE WHEN 2 THEN 0.0015625::DOUBLE ELSE -0.000390625::DOUBLE END), 8) + 0.0 AS estimate FROM j GROUP BY u")
def basis_estimates(spark, sf_dir):
    """Counts of the documents' words as the orthogonal basis of at most 3 places gives them: the minimum-norm estimate by another way."""
    counts, _ = _feature_counts(spark, sf_dir)
    e = estimates.basis_estimate(counts, estimates.basis_counts(counts, 5, 3), 5, 3)
    return e.select("u", (F.round("estimate", 8) + 0.0).alias("estimate"))


_STEP = "list_value(CASE WHEN d{i} < 1 THEN 1 WHEN d{i} = 1 THEN -1 ELSE 0 END, CASE WHEN d{i} < 2 THEN 1 WHEN d{i} = 2 THEN -2 ELSE 0 END, CASE WHEN d{i} < 3 THEN 1 ELSE -3 END)"


@query(f"WITH {_bag_sql(_DOCS, 5)}, c AS (SELECT substr(u, 1, 2) AS u, sum(n) AS n FROM bag GROUP BY 1), x AS (SELECT strpos('ACGT', substr(u, 1, 1)) - 1 AS d1, strpos('ACGT', substr(u, 2, 1)) - 1 AS d2, n FROM c), y AS (SELECT n, {_STEP.format(i=1)} AS a, {_STEP.format(i=2)} AS b FROM x), t AS (SELECT '' AS p, '' AS v, n AS z FROM y UNION ALL SELECT '0', CAST(j AS VARCHAR), n * a[j] FROM y, range(1, 4) r(j) UNION ALL SELECT '1', CAST(j AS VARCHAR), n * b[j] FROM y, range(1, 4) r(j) UNION ALL SELECT '0,1', j || '' || k, n * a[j] * b[k] FROM y, range(1, 4) r(j), range(1, 4) q(k)) SELECT p, v, CAST(sum(z) AS BIGINT) AS n FROM t WHERE z <> 0 GROUP BY p, v")
def basis_coefficients(spark, sf_dir):
    """Coefficients of the first two letters' counts on the orthogonal basis."""
    c = words.bag(document_seqs(spark, sf_dir), 5).groupBy(F.substring("u", 1, 2).alias("u")).agg(F.sum("n").alias("n"))
    return estimates.basis_counts(c, 2, 2)


@query("WITH d AS (SELECT DISTINCT n_chars % 50 AS a, doc_id % 40 AS b FROM documents), g AS (SELECT a, b, -4 + i * (8 / 200.0::DOUBLE) AS r FROM d, range(200) t(i)), l AS (SELECT a, b, r, r * r / 2.0 + (a - exp(r) * b) * (a - exp(r) * b) / (3.0 * (1 + exp(2 * r))) + ln(1 + exp(2 * r)) AS loss FROM g) SELECT a, b, round(min_by(r, loss), 6) + 0.0 AS r FROM l GROUP BY a, b")
def likeliest_log_ratios(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("n_chars") % 50).alias("a"), (F.col("doc_id") % 40).alias("b")).distinct()
    r = estimates.map_log_ratio(F.col("a").cast("double"), F.col("b").cast("double"), 3.0, 2.0, points=200)
    return d.select("a", "b", (F.round(r, 6) + 0.0).alias("r"))


# --- patterns and sparse products ------------------------------------------------------------------


@query(f"WITH {_COUNTS}, x AS (SELECT f FROM g WHERE n % 5 = 0) SELECT a.f AS a, b.f AS b, CAST(list_product([CASE WHEN substr(a.f, i, 1) = '.' AND substr(b.f, i, 1) = '.' THEN 4 WHEN substr(a.f, i, 1) = '.' OR substr(b.f, i, 1) = '.' OR substr(a.f, i, 1) = substr(b.f, i, 1) THEN 1 ELSE 0 END FOR i IN range(1, 6)]) AS BIGINT) AS n FROM x a, x b WHERE a.f <= b.f")
def common_words(spark, sf_dir):
    """Full words that pairs of gapped words share."""
    f = saved(_feature_counts(spark, sf_dir)[1].where("n % 5 = 0").select("f"))
    # a few hundred gapped words at most (C(5,3) 4^3 = 640 exist)
    pairs = f.select(F.col("f").alias("a")).join(F.broadcast(f.select(F.col("f").alias("b"))), F.col("a") <= F.col("b"))
    return pairs.select("a", "b", S.common_words(F.col("a"), F.col("b")).alias("n"))


@query(f"WITH {_COUNTS} SELECT f, round((length(regexp_replace(f, '[^AT]', '', 'g')) - length(regexp_replace(f, '[^CG]', '', 'g'))) * ln(1.25), 9) + 0.0 AS log_odds FROM g")
def pattern_log_odds(spark, sf_dir):
    f = _feature_counts(spark, sf_dir)[1]
    return f.select("f", (F.round(S.background_log_odds(F.col("f")), 9) + 0.0).alias("log_odds"))


@query(f"WITH {_DOCS} SELECT id AS seq_id, CAST(len(list_filter(range(1, length(seq) - 1), lambda i: regexp_full_match(substr(seq, i, 3), 'G.C'))) AS INTEGER) AS hits FROM s")
def pattern_hits_any_case(spark, sf_dir):
    return document_seqs(spark, sf_dir).select("seq_id", S.pattern_hits(F.lower(F.col("seq")), "g.c").alias("hits"))


@query("WITH d AS (SELECT l_orderkey AS i, l_partkey AS j, l_linenumber AS k FROM lineitem) SELECT i, CAST(sum(k * (j % 3 - 1)) AS BIGINT) AS y FROM d GROUP BY i")
def sparse_product(spark, sf_dir):
    """A sparse matrix (orders by parts) times a vector."""
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_linenumber").alias("k"))
    v = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq_id"), (F.col("p_partkey") % 3 - 1).alias("alpha"))
    return scoring.kernel_scores(m, v).select("i", F.col("score").cast("bigint").alias("y"))


# --- metrics and folds --------------------------------------------------------------------------------


@query("SELECT lang AS idx, count(*) AS n, round(avg(n_chars), 6) AS cvpred_mean, round(stddev_samp(n_chars), 6) AS cvpred_sd FROM documents GROUP BY lang")
def prediction_means(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("idx"), "n_chars")
    return d.groupBy("idx").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("cvpred_mean"), F.round(F.stddev_samp("n_chars"), 6).alias("cvpred_sd"))


@query(f"WITH {_SCORED}, b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY fold ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c), a AS (SELECT fold, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auroc FROM b GROUP BY fold) SELECT fold AS idx, round(auroc, 9) AS auroc FROM a ORDER BY auroc DESC NULLS LAST, fold LIMIT 1")
def best_setting(spark, sf_dir):
    t = metrics.auroc(_scored(spark, sf_dir)).withColumnRenamed("fold", "idx")
    return metrics.best_setting(t).select("idx", F.round("auroc", 9).alias("auroc"))


@query("SELECT doc_id AS seq_id, CAST(n_chars % 4 + 1 AS INTEGER) AS cv_set FROM documents")
def callers_folds(spark, sf_dir):
    """Folds that a caller numbers from 7 on, moved to begin with 1."""
    return svm.shifted_folds(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), (F.col("n_chars") % 4 + 7).cast("int").alias("cv_set")))


# --- background sets -------------------------------------------------------------------------------------

_SIZES = "g AS (SELECT n_nationkey AS ord, n_name AS chrom, CAST(200 * (1 + n_regionkey) AS BIGINT) AS length FROM nation), c AS (SELECT *, coalesce(sum(length) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(length) OVER () AS whole FROM g)"


@query(f"WITH {_SIZES}, w AS (SELECT p_partkey AS id, 10 + p_size AS len FROM part), d AS (SELECT id, len, t, CAST('0x' || substr(md5('5:' || id || ':' || t), 1, 15) AS BIGINT) % (SELECT max(whole) FROM c) + 1 AS pos FROM w, range(1, 41) r(t)), l AS (SELECT id, len, t, chrom, pos - before AS o FROM d JOIN c ON pos > before AND pos <= before + length WHERE pos - before + len - 1 <= length), m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t) AS k FROM l) SELECT id, chrom, CAST(o AS BIGINT) AS start, CAST(o + len - 1 AS BIGINT) AS \"end\", CASE WHEN CAST('0x' || substr(md5('5:' || id), 1, 15) AS BIGINT) % 2 = 0 THEN '+' ELSE '-' END AS strand FROM m WHERE k = 1")
def random_intervals(spark, sf_dir):
    """An interval of a given length for each part, at a place drawn again until it lies in one chromosome."""
    g = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("chrom"), (200 * (1 + F.col("n_regionkey"))).cast("bigint").alias("length"))
    w = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 10).cast("bigint").alias("len"))
    return background.random_intervals(w, g, 5, 40).select("id", "chrom", "start", "end", "strand")


@query("WITH t AS (SELECT p_partkey AS id, md5('1:' || p_partkey) AS h FROM part), n AS (SELECT CAST(round_even(count(*) * 1.5, 0) AS BIGINT) - count(*) AS extra FROM t), o AS (SELECT id, row_number() OVER (ORDER BY h) AS k FROM t) SELECT id AS target, 1 + CAST(k <= extra AS BIGINT) AS copies FROM o, n")
def target_replicas(spark, sf_dir):
    """Targets one and a half times."""
    r = background.replicas(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), 1.5)
    return r.groupBy("target").agg(F.count("*").alias("copies"))


@query("SELECT p_partkey AS target_id FROM part WHERE p_size <= 45")
def matched_targets(spark, sf_dir):
    """Targets that have a candidate of their own size and shade; those without are left out."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") / 1e7).alias("gc"), F.lit(100).cast("bigint").alias("len"), F.lit(0.0).alias("rep"), "p_size")
    t = p.withColumn("stratum", F.col("id") % 16)
    c = p.where("p_size <= 45").withColumn("stratum", F.col("id") % 16)
    m = background.greedy_match(t, c, gc_tol=1e-9, strata=["stratum"])
    return m.where("target_id = candidate_id").select("target_id")
