"""Registered queries: orders by mode, table layouts, degree orthologs, line orders, members and nulls of fusions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karyospark.functions import color as K
from karyospark.functions import scalars as Z
from karyospark.operators import coords as C
from karyospark.operators import fusion as U
from karyospark.operators import groups as G
from karyospark.operators import hits as H
from karyospark.operators import mixing as M
from karyospark.operators import order as O
from karyospark.operators import ribbon as R
from karyospark.sources import formats as T

from . import fixtures as X
from .fixtures import with_tables
from .queries_groups import _COLLAPSE, _HYPS, _SIZED, RANKED_TRIALS, _hyp, _mv, groups4, mixing_genes, number_of_rbh, sized
from .queries_hits import CPS, STRICT
from .queries_rest import _folder

SP = list("ABCD")
SCAFS = "A_scaf, B_scaf, C_scaf, D_scaf"
MODES = ["optimal-size", "custom", "optimal-top", "optimal-chr-or", "optimal-random"]
NULL_TRIALS = 4


def chrom_order_modes(spark, sf_dir):
    o = X.orth(spark, sf_dir)
    shared = lambda x, y: o.groupBy(F.col(f"{x}_scaf").alias("ref_scaf"), F.col(f"{y}_scaf").alias("scaf")).agg((F.lit(1.0) / F.count(F.lit(1))).alias("p"))
    pairs = {(x, y): shared(x, y) for x, y in ("AB", "BA", "BC", "CB")}
    custom = {"B": O.ranked_order(C.chrom_order_by_size(o, "B"), F.md5("scaf"), "scaf")}
    parts = []
    for mode in MODES:
        orders = O.chrom_order_modes(mode, o, list("ABC"), pairs, custom if mode in ("custom", "optimal-chr-or") else None)
        parts += [rows.select(F.lit(mode).alias("mode"), F.lit(s).alias("species"), "scaf", "rank") for s, rows in orders.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def match_ribbon_tables(spark, sf_dir):
    o = X.orth(spark, sf_dir)
    tables = {("A", "C"): o.where(number_of_rbh() % 2 == 0), ("B", "C"): o.where(number_of_rbh() % 3 == 0), ("A", "B"): o}
    matched = R.match_ribbon_tables(tables, ["A", "C", "B"])
    return matched[0].select("rbh", F.lit("A_C").alias("pair")).unionByName(matched[1].select("rbh", F.lit("C_B").alias("pair")))


def distinct_flatten(spark, sf_dir):
    nested = X.orth(spark, sf_dir).groupBy("A_scaf", "B_scaf").agg(F.collect_set(F.array("C_scaf", "D_scaf")).alias("nested"))
    return nested.select("A_scaf", "B_scaf", F.array_join(F.sort_array(Z.distinct_flatten(F.col("nested"))), ",").alias("partners"))


def tuple_key(spark, sf_dir):
    return X.orth(spark, sf_dir).groupBy(Z.tuple_key(*[F.col(f"{s}_scaf") for s in SP]).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def dot_alpha(spark, sf_dir):
    color = F.when(number_of_rbh() % 3 == 0, F.col("color")).otherwise("#12AB34")
    return X.orth(spark, sf_dir).select("rbh", K.dot_alpha(number_of_rbh() % 4 == 0, color).alias("alpha"))


def dot_size(spark, sf_dir):
    rows = X.profile_hits(spark, sf_dir)
    most = rows.agg(F.max("bitscore")).first()[0]
    return rows.select("qseqid", "sseqid", F.round(Z.dot_size(F.col("bitscore"), F.lit(most)), 6).alias("size"))


def _cells(table: DataFrame, keys: list[str]) -> DataFrame:
    """A row per cell, with the column's place in the table."""
    cells = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for k, c in enumerate(table.columns)])
    return table.select(*keys, F.inline(cells))


def group_columns(spark, sf_dir):
    rows = sized(spark, sf_dir).drop("alpha").withColumn("gene_group", F.lit("None")).withColumn("aside", F.lit(1))
    table = G.order_group_columns(rows.select(*reversed(rows.columns)), SP)
    return _cells(table, [F.col(f"{s}_scaf").alias(f"{s}_key") for s in SP])


def profile_columns(spark, sf_dir):
    best = H.hmm_best_per_gene(X.profile_hits(spark, sf_dir))
    table = H.add_species_columns(X.lg_db(spark).withColumn("B_gene", F.concat(F.lit("b"), "rbh")), best, X.chrom(spark, sf_dir).where("species = 'C'"), "C")
    return _cells(G.order_profile_columns(table.select(*reversed(table.columns)), ["B"], ["C"]), [F.col("rbh").alias("key")])


def nway_rbh_degree(spark, sf_dir):
    return H.nway_rbh(H.strict_links(X.top_links(spark, sf_dir, CPS, pident=True)), ["C", "P", "S"], mode="degree")


def top_hits_by_run(spark, sf_dir):
    rows = X.profile_hits(spark, sf_dir)
    bucket = F.expr("cast(substring(sseqid, 2) as bigint)") % 3
    line = F.struct(bucket.alias("b"), F.col("qseqid"), (-F.col("bitscore")).alias("s"), F.col("sseqid"))
    return H.top_hits_by_run(rows.withColumn("line", line), "line", 2).drop("line")


def chrom_last_line(spark, sf_dir):
    path = _folder(spark, "chrom")
    rows = X.chrom(spark, sf_dir).where("species = 'P'").drop("species")
    again = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.expr("cast(substring(protein, 2) as int) % 3"))))
    lines = again.withColumn("start", F.col("start") - 7 * F.col("k")).orderBy("protein", "k")
    lines.select("protein", "scaf", "strand", "start", "stop").write.csv(path, sep="\t")
    return T.read_chrom(spark, path)


def color_by_hits(spark, sf_dir):
    long = C.to_long(X.orth(spark, sf_dir), SP)
    k = F.expr("cast(substring(gene, 3) as bigint)")
    by_hit = long.where(k % 3 != 0).select("gene", F.concat(F.substring("gene", 1, 1), k % 5).alias("gene_group"), F.concat(F.lit("#00000"), k % 7).alias("color"))
    by_id = X.lg_db(spark).select(F.col("rbh").alias("gene"), "gene_group", "color")
    return O.color_by_ids_or_hits(long, by_id, by_hit, SP)


def fusion_members(spark, sf_dir):
    tables = U.hypothesis(groups4(spark, sf_dir), "A", "B", "C", "D")
    return U.fusion_members(tables, X.orth(spark, sf_dir), SP)


def _null(rows: DataFrame) -> DataFrame:
    return rows.select("scaf", "gene_group_a", "gene_group_b", F.round("mode", 6).alias("mode"), F.round("p_value_unmixed", 6).alias("p_value_unmixed"), F.round("m_percent_of_way_to_mode", 4).alias("percent"))


def mixing_null_mode(spark, sf_dir):
    return _null(M.mixing_null(M.mixing_value(mixing_genes(spark, sf_dir))))


def mixing_null_compressed(spark, sf_dir):
    return _null(M.mixing_null(M.mixing_value(mixing_genes(spark, sf_dir), compress=True), compress=True))


_NAMES = "chrom_order_modes match_ribbon_tables distinct_flatten tuple_key dot_alpha dot_size group_columns profile_columns nway_rbh_degree top_hits_by_run chrom_last_line color_by_hits fusion_members mixing_null_mode mixing_null_compressed"
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_K = "CAST(substr(rbh, 4) AS BIGINT)"


def _opt(name: str, x: str, y: str, before: str) -> str:
    """CTE: scaffolds of y in the order of their best partner in ``before``, an order of x."""
    return f"{name} AS (SELECT q.y scaf, row_number() OVER (ORDER BY q.z[2], q.z[1], q.y) - 1 r FROM (SELECT y, min((p, {before}.r)) z FROM (SELECT {x}_scaf x, {y}_scaf y, 1.0::DOUBLE / count(*) p FROM orth GROUP BY 1, 2) JOIN {before} ON {before}.scaf = x GROUP BY 1) q)"


_ORDERS = ", ".join(
    [
        *[f"s{s} AS (SELECT {s}_scaf scaf, row_number() OVER (ORDER BY count(*) DESC, {s}_scaf) - 1 r FROM orth GROUP BY 1)" for s in "ABC"],
        "cb AS (SELECT scaf, row_number() OVER (ORDER BY md5(scaf), scaf) - 1 r FROM sB)",
        "ra AS (SELECT scaf, row_number() OVER (ORDER BY md5('0:' || scaf), scaf) - 1 r FROM sA)",
        _opt("tb", "A", "B", "sA"), _opt("tc", "B", "C", "tb"), _opt("oc", "B", "C", "cb"), _opt("oa", "B", "A", "cb"), _opt("rb", "A", "B", "ra"), _opt("rc", "B", "C", "rb"),
    ]
)
_BY_MODE = {"optimal-size": ("sA", "sB", "sC"), "custom": ("sA", "cb", "sC"), "optimal-top": ("sA", "tb", "tc"), "optimal-chr-or": ("oa", "cb", "oc"), "optimal-random": ("ra", "rb", "rc")}


def _cells_sql(keys: str, columns: list[str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, {k} place, '{c}' AS \"column\", CAST(\"{c}\" AS VARCHAR) AS \"value\" FROM {source}" for k, c in enumerate(columns))


_GROUP_COLUMNS = ["gene_group", "count", "alpha_type", *[f"{s}_scaf" for s in SP], "aside"]
_KEYS = ", ".join(f"{s}_scaf {s}_key" for s in SP)
_DEGREE = f"""{STRICT},
ln AS (SELECT DISTINCT query_species || chr(9) || qseqid a, target_species || chr(9) || sseqid b FROM strict),
dg AS (SELECT x FROM (SELECT a x FROM ln UNION ALL SELECT b FROM ln) GROUP BY 1 HAVING count(*) = 2),
kp AS (SELECT * FROM ln WHERE a IN (SELECT x FROM dg) AND b IN (SELECT x FROM dg)),
lb AS (SELECT x, x AS root FROM dg UNION SELECT CASE WHEN kp.a = lb.x THEN kp.b ELSE kp.a END, root FROM lb JOIN kp ON kp.a = lb.x OR kp.b = lb.x),
cc AS (SELECT x, min(root) root FROM lb GROUP BY 1),
fd AS (SELECT """ + ", ".join(f"min(CASE WHEN x LIKE '{s}' || chr(9) || '%' THEN substr(x, 3) END) {s}_gene" for s in "CPS") + " FROM cc GROUP BY root HAVING count(*) = 3)"

_RUNS = """rn AS (SELECT *, unnest(range(2, n_a + n_b + 1)) r FROM cn),
ch AS (SELECT *, CAST(floor(r / 2) AS BIGINT) h, lgamma(n_a + n_b + 1) - lgamma(n_a + 1) - lgamma(n_b + 1) q FROM rn),
ps AS (SELECT *, CASE WHEN r % 2 = 0 THEN CASE WHEN h <= n_a AND h <= n_b THEN exp(ln(2) + lgamma(n_a) - lgamma(h) - lgamma(n_a - h + 1) + lgamma(n_b) - lgamma(h) - lgamma(n_b - h + 1) - q) ELSE 0 END
  ELSE CASE WHEN h <= n_a - 1 AND h <= n_b THEN exp(lgamma(n_a) - lgamma(h + 1) - lgamma(n_a - h) + lgamma(n_b) - lgamma(h) - lgamma(n_b - h + 1) - q) ELSE 0 END + CASE WHEN h <= n_a AND h <= n_b - 1 THEN exp(lgamma(n_a) - lgamma(h) - lgamma(n_a - h + 1) + lgamma(n_b) - lgamma(h + 1) - lgamma(n_b - h) - q) ELSE 0 END END p FROM ch)"""
_PK = "scaf, gene_group_a, gene_group_b"
_M = "(changes - 1) / nullif(2 * n_a * n_b / (n_a + n_b) - 1, 0)"


def _trials(s: str, trials: int) -> str:
    """CTEs up to tr: trials with the species' scaffolds dealt by hash ranks, and the fusion summary of each."""
    return f"""bp AS (SELECT {s}_scaf, row_number() OVER (ORDER BY rbh) k FROM orth),
br AS (SELECT CAST(t.i AS INTEGER) trial, rbh, row_number() OVER (PARTITION BY t.i ORDER BY md5(t.i || ':' || rbh), rbh) k FROM orth, range({trials}) t(i)),
pm AS (SELECT br.trial, orth.* EXCLUDE ({s}_scaf), bp.{s}_scaf FROM br JOIN bp USING (k) JOIN orth ON orth.rbh = br.rbh),
g4 AS (SELECT trial, {SCAFS}, count(*) "count", """ + ", ".join(f"min({x}_pos) {x}_lo, max({x}_pos) {x}_hi" for x in SP) + f""" FROM pm GROUP BY ALL HAVING count(*) >= {U.LEAST_COUNT}),
""" + ",\n".join(_hyp(*h, f"t{h[0]}", "trial, ") for h in _HYPS) + """,
ts AS (""" + " UNION ALL ".join(f"SELECT trial, '{a}' hyp, {b}_scaf x, {c}_scaf y, max(\"count\") ms, sum(\"count\") su, count(*) n FROM t{a} WHERE mixed GROUP BY ALL" for a, b, c in _HYPS) + f"""),
tm AS (SELECT trial, hyp, max(ms) max_single, CAST(max(su) AS BIGINT) max_grouping, CAST(sum(su) AS BIGINT) total, count(*) n_groupings, CAST(sum(su) / sum(n) AS DOUBLE) mean FROM ts GROUP BY 1, 2),
tr AS (SELECT CAST(t.i AS INTEGER) trial, h.hyp, coalesce(max_single, 0) max_single, coalesce(max_grouping, 0) max_grouping, coalesce(total, 0) total, coalesce(n_groupings, 0) n_groupings, coalesce(mean, 0) mean
  FROM range({trials}) t(i) JOIN (VALUES ('B'), ('C'), ('D')) h(hyp) ON true LEFT JOIN tm ON tm.trial = t.i AND tm.hyp = h.hyp)"""


#: B permuted.
_TRIALS = _trials("B", NULL_TRIALS)
_OBSERVED = f"""o4 AS (SELECT {SCAFS}, count(*) "count", """ + ", ".join(f"min({s}_pos) {s}_lo, max({s}_pos) {s}_hi" for s in SP) + f""" FROM orth GROUP BY ALL HAVING count(*) >= {U.LEAST_COUNT}),
""" + ",\n".join(_hyp(*h, f"o{h[0]}").replace("FROM g4", "FROM o4") for h in _HYPS) + """,
os AS (""" + " UNION ALL ".join(f"SELECT '{a}' hyp, {b}_scaf x, {c}_scaf y, max(\"count\") ms, sum(\"count\") su, count(*) n FROM o{a} WHERE mixed GROUP BY ALL" for a, b, c in _HYPS) + """),
obs AS (SELECT hyp, max(ms) max_single, CAST(max(su) AS BIGINT) max_grouping, CAST(sum(su) AS BIGINT) total, count(*) n_groupings, CAST(sum(su) / sum(n) AS DOUBLE) mean FROM os GROUP BY 1)"""
_HIT = {m: f"(tr.{m} >= obs.{m} AND tr.{m} <> 0)" for m in U.METRICS}
_HITS = {**_HIT, **{f"{a}+{b}": f"{_HIT[a]} AND {_HIT[b]}" for a, b in combinations(U.METRICS, 2)}}

ORACLES = {
    "chrom_order_modes": with_tables("orth", f"WITH {_ORDERS} " + " UNION ALL ".join(f"SELECT '{mode}' AS \"mode\", '{s}' species, scaf, r AS \"rank\" FROM {cte}" for mode, ctes in _BY_MODE.items() for s, cte in zip("ABC", ctes, strict=True))),
    "match_ribbon_tables": with_tables("orth", f"SELECT rbh, 'A_C' pair FROM orth WHERE {_K} % 2 = 0 UNION ALL SELECT rbh, 'C_B' FROM orth WHERE {_K} % 3 = 0"),
    "distinct_flatten": with_tables("orth", "SELECT A_scaf, B_scaf, string_agg(DISTINCT x, ',' ORDER BY x) partners FROM (SELECT A_scaf, B_scaf, C_scaf x FROM orth UNION ALL SELECT A_scaf, B_scaf, D_scaf FROM orth) GROUP BY 1, 2"),
    "tuple_key": with_tables("orth", "SELECT A_scaf || '_' || B_scaf || '_' || C_scaf || '_' || D_scaf AS \"key\", count(*) n FROM orth GROUP BY 1"),
    "dot_alpha": with_tables("orth", f"SELECT rbh, CASE WHEN {_K} % 4 <> 0 THEN 0.25 WHEN {_K} % 3 = 0 THEN 0.75 ELSE 0.9 END::DOUBLE alpha FROM orth"),
    "dot_size": with_tables("profile_hits", "SELECT qseqid, sseqid, round(60 * bitscore / (SELECT max(bitscore) FROM profile_hits), 6) AS \"size\" FROM profile_hits"),
    "group_columns": with_tables("orth", f"WITH {_SIZED}, tb AS (SELECT *, 'None' gene_group, 1 aside FROM sized) " + _cells_sql(_KEYS, _GROUP_COLUMNS, "tb")),
    "profile_columns": with_tables("profile_hits lg_db chrom", "WITH t AS (SELECT * FROM profile_hits QUALIFY row_number() OVER (PARTITION BY sseqid ORDER BY bitscore DESC, qseqid) = 1), best AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY qseqid ORDER BY bitscore DESC, sseqid) = 1), tb AS (SELECT lg_db.*, 'b' || rbh B_gene, best.sseqid C_gene, scaf C_scaf, \"start\" C_pos FROM lg_db LEFT JOIN best ON best.qseqid = rbh LEFT JOIN chrom ON species = 'C' AND protein = best.sseqid) " + _cells_sql('rbh AS "key"', ["rbh", "color", "gene_group", "B_gene", "C_gene", "C_pos", "C_scaf"], "tb")),
    "nway_rbh_degree": "WITH RECURSIVE " + with_tables("hits", f"WITH {_DEGREE} SELECT 'rbh3way_C_P_S_' || row_number() OVER (ORDER BY C_gene, P_gene, S_gene) rbh, * FROM fd WHERE C_gene IS NOT NULL AND P_gene IS NOT NULL AND S_gene IS NOT NULL")[5:],
    "top_hits_by_run": with_tables("profile_hits", "SELECT *, CAST(row_number() OVER (PARTITION BY qseqid, CAST(substr(sseqid, 2) AS BIGINT) % 3 ORDER BY bitscore DESC, sseqid) AS INTEGER) place FROM profile_hits QUALIFY place <= 2"),
    "chrom_last_line": with_tables("chrom", "WITH l AS (SELECT protein, scaf, strand, \"start\" - 7 * (CAST(substr(protein, 2) AS BIGINT) % 3) AS \"start\", stop FROM chrom WHERE species = 'P') SELECT *, CAST(floor(\"start\" + (stop - \"start\") / 2) AS BIGINT) middle FROM l"),
    "color_by_hits": with_tables("orth", f"WITH k AS (SELECT rbh, {_K} k FROM orth) SELECT rbh, CASE WHEN k % 3 <> 0 THEN 'D' || (k % 5) ELSE 'None' END gene_group, CASE WHEN k % 3 <> 0 THEN '#00000' || (k % 7) ELSE '#000000' END color FROM k"),
    "fusion_members": with_tables("orth", f"WITH {_OBSERVED} SELECT oB.*, rbh FROM oB JOIN (SELECT {SCAFS}, rbh FROM orth) USING ({SCAFS})"),
    "mixing_null_mode": with_tables("orth", _mv("g") + f""", {_RUNS},
tp AS (SELECT {_PK}, n_a, n_b, changes, arg_max(r, (round(ln(p), 9), -r)) FILTER (WHERE p > 0) r, sum(p) FILTER (WHERE r <= changes + 1) p FROM ps GROUP BY ALL),
md AS (SELECT *, {_M} m, (r - 2) / nullif(2 * n_a * n_b / (n_a + n_b) - 1, 0) md FROM tp)
SELECT {_PK}, round(md, 6) AS \"mode\", round(least(1, p), 6) p_value_unmixed, round(least(1.0, m / nullif(md, 0)) * 100, 4) AS percent FROM md"""),
    "mixing_null_compressed": with_tables("orth", _mv(_COLLAPSE) + f""", {_RUNS},
tp AS (SELECT {_PK}, n_a, n_b, changes, coalesce(sum(p) FILTER (WHERE r % 2 = 0 AND r > 2), 0) even, coalesce(max(p) FILTER (WHERE r % 2 = 1), 0) odd, arg_max(r, p) FILTER (WHERE r % 2 = 1) r, coalesce(sum(p) FILTER (WHERE r % 2 = 1 AND r > changes), 0) above FROM ps GROUP BY ALL),
md AS (SELECT *, {_M} m, CASE WHEN even >= odd THEN 2 ELSE 2 * r * (r - 2) / (r * r - 2 * r - 1) END::DOUBLE md, CASE WHEN changes > 1 THEN least(1, even + CASE WHEN changes % 2 = 0 THEN above ELSE 0 END) END p FROM tp)
SELECT {_PK}, round(md, 6) AS \"mode\", round(p, 6) p_value_unmixed, round(least(1.0, m / nullif(md, 0)) * 100, 4) AS percent FROM md"""),
    "fusion_null": with_tables("orth", f"WITH {_TRIALS} SELECT * FROM tr"),
    "fusion_null_batches": " UNION ALL ".join(f"SELECT '{s}' permuted, CAST(trial AS BIGINT) trial, * EXCLUDE (trial) FROM (" + with_tables("orth", f"WITH {_trials(s, RANKED_TRIALS)} SELECT * FROM tr") + ")" for s in SP[1:]),
    "empirical_p": with_tables("orth", f"WITH {_TRIALS}, {_OBSERVED}, ep AS (" + " UNION ALL ".join(f"SELECT obs.hyp, count(*) n_trials, '{m}' metric, count(*) FILTER (WHERE {h}) hits FROM tr JOIN obs ON obs.hyp = tr.hyp GROUP BY 1" for m, h in _HITS.items()) + ") SELECT *, CASE WHEN hits > 0 THEN hits / n_trials END p FROM ep"),
    "trial_histograms": with_tables("orth", f"WITH {_TRIALS} SELECT hyp, metric, \"value\", count(*) n FROM (" + " UNION ALL ".join(f"SELECT hyp, '{m}' metric, CAST({m} AS DOUBLE) AS \"value\" FROM tr" for m in U.METRICS) + ") GROUP BY 1, 2, 3"),
}
