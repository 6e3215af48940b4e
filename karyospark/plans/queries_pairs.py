"""Registered queries of the pairwise workload: coordinates, tests, breaks, tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from karyospark.operators import coords as C
from karyospark.operators import hits as H
from karyospark.operators import peaks as P
from karyospark.operators import stats as S

from . import fixtures as X
from .fixtures import with_tables
from .queries_hits import STRICT

CP = [("C", "P"), ("P", "C")]


def rbh_genes(spark, sf_dir):
    return H.strict_links(X.top_links(spark, sf_dir, CP, pident=True)).select(F.concat(F.lit("rbh_"), "qseqid").alias("rbh"), F.col("qseqid").alias("C_gene"), F.col("sseqid").alias("P_gene"))


def annotate_coords(spark, sf_dir):
    return C.annotate_coords(rbh_genes(spark, sf_dir), X.chrom(spark, sf_dir), ["C", "P"])


def synteny_pairs(spark, sf_dir):
    """Reciprocal best hits to significant scaffold pairs."""
    pairs = S.fisher_pairs(annotate_coords(spark, sf_dir), "C_scaf", "P_scaf")
    return pairs.where("p <= 100").select("C_scaf", "P_scaf", "n", F.round("neg_log10_p", 6).alias("neg_log10_p"))


def annotated(spark, sf_dir):
    """The pairwise table of A and B with pieces and indices."""
    rbh = X.orth(spark, sf_dir).select("rbh", "gene_group", "color", *[f"{s}_{c}" for s in "AB" for c in ("gene", "scaf", "pos")])
    for s in "AB":
        rbh = C.gene_index(C.assign_breakchrom(rbh, orth_breaks(spark), s), s)
    return rbh


def orth_breaks(spark):
    return spark.createDataFrame([("A", "A3", 500000), ("A", "A7", 250000), ("A", "A7", 750000), ("B", "B2", 400000)], "species string, scaf string, break_pos bigint")


def tested(spark, sf_dir):
    return S.fisher_exact(S.fisher_exact(annotated(spark, sf_dir), "A_scaf", "B_scaf", "whole_FET"), "A_breakchrom", "B_breakchrom", "break_FET")


def gene_index(spark, sf_dir):
    return annotated(spark, sf_dir).select("rbh", *[f"{s}_{c}" for s in "AB" for c in ("breakchrom", "ix", "break_ix")])


def assign_breakchrom(spark, sf_dir):
    rbh = annotate_coords(spark, sf_dir)
    for s in ("C", "P"):
        rbh = C.assign_breakchrom(rbh, X.breaks(spark), s)
    return rbh


def break_intervals(spark, sf_dir):
    return C.break_intervals(X.breaks(spark)).join(X.chromsize(spark, sf_dir).select("species", "scaf"), ["species", "scaf"], "left_semi")


def scaffold_pair_counts(spark, sf_dir):
    return S.scaffold_pair_counts(X.orth(spark, sf_dir), "A_scaf", "B_scaf")


def fisher_whole(spark, sf_dir):
    return S.fisher_pairs(annotated(spark, sf_dir), "A_scaf", "B_scaf").select("A_scaf", "B_scaf", "n", F.round("neg_log10_p", 6).alias("neg_log10_p"))


def fisher_break(spark, sf_dir):
    return S.fisher_pairs(annotated(spark, sf_dir), "A_breakchrom", "B_breakchrom").select("A_breakchrom", "B_breakchrom", "n", F.round("neg_log10_p", 6).alias("neg_log10_p"))


def filter_significant(spark, sf_dir):
    return S.filter_significant(tested(spark, sf_dir), 0.05, "whole_FET").select("rbh", "A_scaf", "B_scaf")


def break_statistic(spark, sf_dir):
    rows = annotated(spark, sf_dir).select("rbh", *[f"{s}_{c}" for s in "AB" for c in ("breakchrom", "break_ix")])
    out = S.break_statistic(S.cut(S.break_statistic(rows, "A", "B")), "B", "A")
    return out.select("rbh", F.round("A_D", 6).alias("A_D"), F.round("B_D", 6).alias("B_D"))


#: What breaks of A are found by; rows go whole through the statistic.
FOR_BREAKS = ["A_scaf", "A_ix", "A_breakchrom", "A_break_ix", "B_breakchrom"]


def auto_breaks(spark, sf_dir):
    return P.auto_breaks(S.break_statistic(annotated(spark, sf_dir).select(*FOR_BREAKS), "A", "B"), "A")


def auto_breaks_with_manual(spark, sf_dir):
    """Found breaks and those set by hand, at the last gene that ends before each."""
    rows = S.cut(S.break_statistic(annotated(spark, sf_dir).select(*FOR_BREAKS, "A_gene", "A_pos"), "A", "B"))
    genes = rows.select(F.col("A_scaf").alias("scaf"), F.col("A_gene").alias("gene"), F.col("A_pos").alias("stop"))
    by_hand = S.manual_break_rows(orth_breaks(spark).where("species = 'A'").select("scaf", "break_pos"), genes)
    at = rows.select(F.col("A_gene").alias("gene"), F.col("A_ix").alias("ix"), F.col("A_D").alias("d"))
    return P.auto_breaks(rows, "A", by_hand.join(at, "gene").select("scaf", "ix", "d"))


def filtered_pair_groups(spark, sf_dir):
    return S.filtered_pair_groups(tested(spark, sf_dir), "A", "B", F.lit("#123456")).select("rbh", "gene_group", "color")


def summary_pieces(spark, sf_dir):
    return S.summary_pieces(tested(spark, sf_dir), "A", "B").select("A_breakchrom", "B_breakchrom", "n")


def summary_whole(spark, sf_dir):
    return S.summary_pieces(tested(spark, sf_dir), "A", "B", "whole_FET", "scaf").select("A_scaf", "B_scaf", "n")


def _grouped(spark, sf_dir):
    k = F.expr("cast(substring(rbh, 4) as bigint)")
    return tested(spark, sf_dir).withColumn("gene_group", F.concat(F.lit("L"), k % 7)).withColumn("color", F.concat(F.lit("#00000"), k % 3))


def summary_groups(spark, sf_dir):
    return S.summary_groups(_grouped(spark, sf_dir), "A", "B").select("A_scaf", "B_scaf", "gene_group", "n", "color")


def modal_color(spark, sf_dir):
    return S.modal_color(_grouped(spark, sf_dir))


def alg_decay(spark, sf_dir):
    return S.alg_decay(_grouped(spark, sf_dir))


def alg_decay_detail(spark, sf_dir):
    return S.alg_decay_detail(_grouped(spark, sf_dir), "B")


def chrom_order_by_size(spark, sf_dir):
    return C.chrom_order_by_size(X.orth(spark, sf_dir), "B")


def plotted(spark, sf_dir):
    rbh = annotated(spark, sf_dir)
    return C.plot_coordinates(rbh, "A", C.chrom_order_by_size(rbh, "A"), C.pseudo_chromsizes(rbh, "A"))


def plot_coordinates(spark, sf_dir):
    return plotted(spark, sf_dir).select("rbh", "A_plotindex", "A_plotpos")


def axis_annotations(spark, sf_dir):
    return C.axis_annotations(plotted(spark, sf_dir), "A")


def break_lines(spark, sf_dir):
    return C.break_lines(plotted(spark, sf_dir), "A")


def d_widths(spark, sf_dir):
    return S.d_widths(plotted(spark, sf_dir), "A").select("rbh", "A_Dwidths")


def _sizes(spark, sf_dir):
    ranked = X.chromsize(spark, sf_dir).withColumn("len", F.col("len") + F.length("scaf") * 1000)
    return ranked.withColumn("rank", F.row_number().over(W.partitionBy("species").orderBy(F.col("len").desc(), "scaf")))


def scaffold_offsets(spark, sf_dir):
    return C.scaffold_offsets(_sizes(spark, sf_dir))


def d_bars(spark, sf_dir):
    sizes = C.scaffold_offsets(_sizes(spark, sf_dir)).where("species = 'C'").select("scaf", "len", "offset")
    genes = X.chrom(spark, sf_dir).where("species = 'C'").select("scaf", F.col("protein").alias("gene"), "start", "stop")
    return S.d_bars(genes, sizes)


def manual_break_rows(spark, sf_dir):
    genes = X.chrom(spark, sf_dir).where("species = 'C'").select("scaf", F.col("protein").alias("gene"), "start", "stop")
    return S.manual_break_rows(X.breaks(spark).where("species = 'C'").select("scaf", "break_pos"), genes, None)


def manual_breaks_on_axis(spark, sf_dir):
    genes = X.chrom(spark, sf_dir).where("species = 'C'").select("scaf", F.col("protein").alias("gene"), "stop")
    early = spark.createDataFrame([("CN5", 0), ("CN0", -1)], "scaf string, break_pos bigint")
    breaks = X.breaks(spark).where("species = 'C'").select("scaf", "break_pos").unionByName(early)
    return S.manual_break_rows(breaks, genes, C.scaffold_offsets(_sizes(spark, sf_dir)).where("species = 'C'"))


def filter_scaffolds(spark, sf_dir):
    sizes = X.chromsize(spark, sf_dir).where("scaf <> 'CN3' AND scaf <> 'Brand#2'")
    return C.filter_scaffolds(annotate_coords(spark, sf_dir), sizes, ["C", "P"])


def filter_min_scaf_size(spark, sf_dir):
    return C.filter_min_scaf_size(C.pseudo_chromsizes(X.orth(spark, sf_dir), "B"), 999_900)


def pseudo_chromsizes(spark, sf_dir):
    return C.pseudo_chromsizes(X.orth(spark, sf_dir), "A")


def annotate_gene_group(spark, sf_dir):
    rbh = X.orth(spark, sf_dir)
    k = F.expr("cast(substring(gene, 3) as bigint)")
    genes = rbh.select(F.col("A_gene").alias("gene")).where(k % 3 == 0).unionByName(rbh.select(F.col("B_gene").alias("gene")).where(k % 5 == 0))
    return C.annotate_gene_group(rbh, genes.withColumn("gene_group", F.concat(F.substring("gene", 1, 1), k % 7)), ["A", "B"]).select("rbh", "gene_group")


def to_long(spark, sf_dir):
    return C.to_long(X.orth(spark, sf_dir), list("ABCD"))


def to_wide(spark, sf_dir):
    return C.to_wide(C.to_long(X.orth(spark, sf_dir), list("ABCD")), list("ABCD"))


_NAMES = "annotate_coords synteny_pairs gene_index assign_breakchrom break_intervals scaffold_pair_counts fisher_whole fisher_break filter_significant break_statistic auto_breaks auto_breaks_with_manual filtered_pair_groups summary_pieces summary_whole summary_groups modal_color alg_decay alg_decay_detail chrom_order_by_size plot_coordinates axis_annotations break_lines d_widths scaffold_offsets d_bars manual_break_rows manual_breaks_on_axis filter_scaffolds filter_min_scaf_size pseudo_chromsizes annotate_gene_group to_long to_wide"
QUERIES = {n: globals()[n] for n in _NAMES.split()}

def _fet(source: str, a: str, b: str, name: str) -> str:
    """CTEs ``{name}_n`` and ``{name}``: pair counts, and ln of the uncapped Bonferroni p."""
    return f"""
{name}_n AS (SELECT {a} ka, {b} kb, count(*) n FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
{name}_m AS (SELECT *, sum(n) OVER (PARTITION BY ka) r, sum(n) OVER (PARTITION BY kb) c, sum(n) OVER () t FROM {name}_n),
{name}_x AS (SELECT ka, kb, n, r, c, t, unnest(range(n, CAST(least(r, c) AS BIGINT) + 1)) x FROM {name}_m),
{name}_l AS (SELECT ka, kb, n, lgamma(r+1) - lgamma(x+1) - lgamma(r-x+1) + lgamma(t-r+1) - lgamma(c-x+1) - lgamma(t-r-c+x+1) - lgamma(t+1) + lgamma(c+1) + lgamma(t-c+1) l FROM {name}_x),
{name}_t AS (SELECT ka, kb, n, max(l) m FROM {name}_l GROUP BY 1, 2, 3),
{name} AS (SELECT l.ka, l.kb, l.n, least(0, any_value(m) + ln(sum(exp(l - m)))) + ln((SELECT count(DISTINCT ka) FROM {name}_n) * (SELECT count(DISTINCT kb) FROM {name}_n)) lnp
  FROM {name}_l l JOIN {name}_t t ON l.ka = t.ka AND l.kb = t.kb GROUP BY 1, 2, 3)"""


_COORDS = """g AS (SELECT 'rbh_' || qseqid rbh, qseqid C_gene, sseqid P_gene FROM strict WHERE query_species = 'C' AND target_species = 'P'),
coords AS (SELECT rbh, C_gene, c.scaf C_scaf, c."start" C_pos, P_gene, p.scaf P_scaf, p."start" P_pos FROM g LEFT JOIN chrom c ON c.species = 'C' AND c.protein = C_gene LEFT JOIN chrom p ON p.species = 'P' AND p.protein = P_gene)"""
_RBH = f"{STRICT},\n{_COORDS}"


def _piece(s: str, breaks: str) -> str:
    return f"coalesce((SELECT label FROM {breaks} i WHERE i.species = '{s}' AND i.scaf = {s}_scaf AND lo <= {s}_pos AND {s}_pos < hi), {s}_scaf || ':0-end')"


def _intervals(breaks: str) -> str:
    return f"""edges AS (SELECT species, scaf, CAST(break_pos AS BIGINT) lo FROM {breaks} UNION SELECT species, scaf, 0 FROM {breaks}),
iv AS (SELECT *, coalesce(lead(lo) OVER (PARTITION BY species, scaf ORDER BY lo), 9999999999) hi FROM edges),
intervals AS (SELECT *, scaf || ':' || lo || '-' || CASE WHEN hi = 9999999999 THEN 'end' ELSE CAST(hi AS VARCHAR) END AS label FROM iv)"""


_OB = "ob AS (SELECT * FROM (VALUES ('A', 'A3', 500000), ('A', 'A7', 250000), ('A', 'A7', 750000), ('B', 'B2', 400000)) b(species, scaf, break_pos))"
ANN = f"""{_OB}, {_intervals('ob')},
pieces AS (SELECT rbh, gene_group, color, A_gene, A_scaf, A_pos, B_gene, B_scaf, B_pos, {_piece('A', 'intervals')} A_breakchrom, {_piece('B', 'intervals')} B_breakchrom FROM orth),
ann AS (SELECT *, """ + ", ".join(f"row_number() OVER (PARTITION BY {s}_{k} ORDER BY {s}_pos, {s}_gene) - 1 {s}_{n}" for s in "AB" for k, n in (("scaf", "ix"), ("breakchrom", "break_ix"))) + " FROM pieces)"
WHOLE, _B = _fet("ann", "A_scaf", "B_scaf", "w"), _fet("ann", "A_breakchrom", "B_breakchrom", "b")
_TESTED = f"""{ANN}, {WHOLE}, {_B},
tested AS (SELECT ann.*, exp(w.lnp) whole_FET, exp(b.lnp) break_FET FROM ann LEFT JOIN w ON w.ka = A_scaf AND w.kb = B_scaf LEFT JOIN b ON b.ka = A_breakchrom AND b.kb = B_breakchrom)"""
_GROUPED = f"""{_TESTED}, grouped AS (SELECT * REPLACE ('L' || (CAST(substr(rbh, 4) AS BIGINT) % 7) AS gene_group, '#00000' || (CAST(substr(rbh, 4) AS BIGINT) % 3) AS color) FROM tested)"""
_MODAL = "modal AS (SELECT gene_group, color FROM (SELECT gene_group, color, count(*) n FROM grouped GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY gene_group ORDER BY n DESC, color) = 1)"


def _d(s: str, o: str) -> str:
    """D of species s: squared gaps of counts over partner pieces, by counting rows in the two frames."""
    k, ix, op = f"{s}_breakchrom", f"{s}_break_ix", f"{o}_breakchrom"
    return f"""n{s} AS (SELECT {k}, count(*) n FROM ann GROUP BY 1),
e{s} AS (SELECT x.rbh, y.{op} c, sum(CASE WHEN y.{ix} <= x.{ix} THEN CASE WHEN x.{ix} >= 19 THEN -1 ELSE 0 END ELSE CASE WHEN x.{ix} + 20 <= n - 1 THEN 1 ELSE 0 END END) v
  FROM ann x JOIN ann y ON x.{k} = y.{k} AND y.{ix} BETWEEN x.{ix} - 19 AND x.{ix} + 20 JOIN n{s} ON n{s}.{k} = x.{k} GROUP BY 1, 2),
d{s} AS (SELECT a.rbh, CASE WHEN a.{ix} = n - 1 THEN 0 ELSE sqrt(sum(v * v) / 400.0) END D FROM e{s} JOIN ann a ON a.rbh = e{s}.rbh JOIN n{s} ON n{s}.{k} = a.{k} GROUP BY a.rbh, a.{ix}, n)"""


_ORDER_A = """o AS (SELECT A_scaf scaf, count(*) n, max(A_pos) len FROM ann GROUP BY 1), oo AS (SELECT *, row_number() OVER (ORDER BY n DESC, scaf) - 1 "rank" FROM o),
st AS (SELECT scaf, coalesce(sum(n) OVER (ORDER BY "rank" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) g, coalesce(sum(len) OVER (ORDER BY "rank" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) off FROM oo),
plotted AS (SELECT ann.*, CAST(g + A_ix AS BIGINT) A_plotindex, CAST(off + A_pos AS BIGINT) A_plotpos FROM ann JOIN st ON scaf = A_scaf)"""
_SIZES = """sz AS (SELECT species, scaf, len + length(scaf) * 1000 len FROM chromsize),
sr AS (SELECT *, CAST(row_number() OVER (PARTITION BY species ORDER BY len DESC, scaf) AS INTEGER) "rank" FROM sz),
so AS (SELECT *, CAST(coalesce(sum(len) OVER (PARTITION BY species ORDER BY "rank" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) "offset", CAST(sum(len) OVER (PARTITION BY species) AS BIGINT) total FROM sr)"""
LP = "round(-lnp / ln(10), 6) neg_log10_p"

ORACLES = {
    "annotate_coords": with_tables("hits chrom", f"WITH {_RBH} SELECT * FROM coords"),
    "synteny_pairs": with_tables("hits chrom", f"WITH {_RBH}, {_fet('coords', 'C_scaf', 'P_scaf', 'w')} SELECT ka C_scaf, kb P_scaf, n, {LP} FROM w WHERE lnp <= ln(100)"),
    "gene_index": with_tables("orth", f"WITH {ANN} SELECT rbh, A_breakchrom, A_ix, A_break_ix, B_breakchrom, B_ix, B_break_ix FROM ann"),
    "assign_breakchrom": with_tables("hits chrom breaks", f"WITH {_RBH}, {_intervals('breaks')} SELECT *, {_piece('C', 'intervals')} C_breakchrom, {_piece('P', 'intervals')} P_breakchrom FROM coords"),
    "break_intervals": with_tables("chromsize breaks", f"WITH {_intervals('breaks')} SELECT * FROM intervals SEMI JOIN chromsize USING (species, scaf)"),
    "scaffold_pair_counts": with_tables("orth", "SELECT A_scaf, B_scaf, count(*) n, CASE WHEN grouping(A_scaf) = 0 AND grouping(B_scaf) = 0 THEN 'pair' WHEN grouping(A_scaf) = 0 THEN 'a' WHEN grouping(B_scaf) = 0 THEN 'b' ELSE 'all' END AS level FROM orth GROUP BY GROUPING SETS ((A_scaf, B_scaf), (A_scaf), (B_scaf), ())"),
    "fisher_whole": with_tables("orth", f"WITH {ANN}, {WHOLE} SELECT ka A_scaf, kb B_scaf, n, {LP} FROM w"),
    "fisher_break": with_tables("orth", f"WITH {ANN}, {_B} SELECT ka A_breakchrom, kb B_breakchrom, n, {LP} FROM b"),
    "filter_significant": with_tables("orth", f"WITH {_TESTED} SELECT rbh, A_scaf, B_scaf FROM tested WHERE whole_FET <= 0.05"),
    "break_statistic": with_tables("orth", f"WITH {ANN}, {_d('A', 'B')}, {_d('B', 'A')} SELECT rbh, round(dA.D, 6) A_D, round(dB.D, 6) B_D FROM dA JOIN dB USING (rbh)"),
    "filtered_pair_groups": with_tables("orth", f"WITH {_TESTED} SELECT rbh, A_scaf || '_' || B_scaf gene_group, '#123456' color FROM tested WHERE whole_FET <= 0.05"),
    "summary_pieces": with_tables("orth", f"WITH {_TESTED} SELECT A_breakchrom, B_breakchrom, count(*) n FROM tested WHERE break_FET <= 0.1 GROUP BY 1, 2"),
    "summary_whole": with_tables("orth", f"WITH {_TESTED} SELECT A_scaf, B_scaf, count(*) n FROM tested WHERE whole_FET <= 0.1 GROUP BY 1, 2"),
    "summary_groups": with_tables("orth", f"WITH {_GROUPED}, {_MODAL}, s AS (SELECT A_scaf, B_scaf, gene_group, count(*) n FROM grouped WHERE whole_FET <= 1 GROUP BY 1, 2, 3 HAVING count(*) >= 5) SELECT s.*, color FROM s JOIN modal USING (gene_group)"),
    "modal_color": with_tables("orth", f"WITH {_GROUPED}, {_MODAL} SELECT * FROM modal"),
    "alg_decay": with_tables("orth", f"WITH {_GROUPED} SELECT gene_group, count(*) FILTER (WHERE whole_FET <= 0.05) conserved, count(*) FILTER (WHERE whole_FET > 0.05) scattered, count(*) total FROM grouped GROUP BY 1"),
    "alg_decay_detail": with_tables("orth", f"WITH {_GROUPED} SELECT gene_group, B_scaf scaf, count(*) FILTER (WHERE whole_FET <= 0.05) conserved, count(*) FILTER (WHERE whole_FET > 0.05) scattered FROM grouped GROUP BY 1, 2"),
    "chrom_order_by_size": with_tables("orth", 'SELECT *, row_number() OVER (ORDER BY n DESC, scaf) - 1 AS "rank" FROM (SELECT B_scaf scaf, count(*) n FROM orth GROUP BY 1)'),
    "plot_coordinates": with_tables("orth", f"WITH {ANN}, {_ORDER_A} SELECT rbh, A_plotindex, A_plotpos FROM plotted"),
    "axis_annotations": with_tables("orth", f'WITH {ANN}, {_ORDER_A}, e AS (SELECT A_scaf scaf, min(A_plotindex) "first", max(A_plotindex) "last", count(*) n FROM plotted GROUP BY 1) SELECT *, "first" + ("last" - "first") / 2.0 middle, CASE WHEN lead("first") OVER (ORDER BY "first") IS NOT NULL THEN "last" + 0.5 END divider, CAST(sum(n) OVER (ORDER BY "first") AS BIGINT) genes_so_far FROM e'),
    "break_lines": with_tables("orth", f"WITH {ANN}, {_ORDER_A}, l AS (SELECT A_scaf scaf, max(A_plotindex) m FROM plotted GROUP BY 1) SELECT A_scaf scaf, A_breakchrom breakchrom, max(A_plotindex) + 0.5 line FROM plotted JOIN l ON scaf = A_scaf WHERE A_breakchrom NOT LIKE '%end' GROUP BY 1, 2, m HAVING max(A_plotindex) <> m"),
    "d_widths": with_tables("orth", f"WITH {ANN}, {_ORDER_A} SELECT rbh, coalesce(A_plotpos - lag(A_plotpos) OVER (PARTITION BY A_scaf ORDER BY A_plotindex), 0) A_Dwidths FROM plotted"),
    "scaffold_offsets": with_tables("chromsize", f'WITH {_SIZES} SELECT *, "offset" + len / 2.0 tick FROM so'),
    "d_bars": with_tables("chromsize", f"""WITH {_SIZES}, g AS (SELECT c.scaf, protein gene, "start" + "offset" s, stop + "offset" e, "offset" o, len FROM chrom c JOIN so ON so.species = 'C' AND c.species = 'C' AND so.scaf = c.scaf),
x AS (SELECT *, count(*) OVER (PARTITION BY scaf) n, coalesce((lag(e) OVER w + s) / 2.0, o) l, coalesce((e + lead(s) OVER w) / 2.0, o + len) r FROM g WINDOW w AS (PARTITION BY scaf ORDER BY s, e, gene))
SELECT scaf, gene, CASE WHEN n = 1 THEN -1 ELSE l END::DOUBLE AS "left", CASE WHEN n = 1 THEN -1 ELSE r END::DOUBLE AS "right", CASE WHEN n = 1 THEN -1 ELSE (l + r) / 2 END::DOUBLE AS middle, CASE WHEN n = 1 THEN 1 ELSE r - l + 1 END::DOUBLE AS width FROM x"""),
    "manual_break_rows": with_tables("chrom breaks", "SELECT b.scaf, CAST(b.break_pos AS BIGINT) AS break_pos, max_by(protein, (stop, protein)) gene, max(stop) stop FROM breaks b JOIN chrom c ON c.species = 'C' AND b.species = 'C' AND c.scaf = b.scaf AND stop <= b.break_pos GROUP BY 1, 2"),
    "manual_breaks_on_axis": with_tables("chromsize breaks", f"""WITH {_SIZES}, g AS (SELECT c.scaf, protein, stop + "offset" e FROM chrom c JOIN so ON so.species = 'C' AND c.species = 'C' AND so.scaf = c.scaf),
mb AS (SELECT b.scaf, break_pos, break_pos + "offset" e FROM (SELECT scaf, CAST(break_pos AS BIGINT) AS break_pos FROM breaks WHERE species = 'C' UNION ALL VALUES ('CN5', 0), ('CN0', -1)) b JOIN so ON so.species = 'C' AND so.scaf = b.scaf)
SELECT mb.scaf, break_pos, max_by(g.scaf, (g.e, protein, g.scaf)) gene_scaf, max_by(protein, (g.e, protein, g.scaf)) gene, max(g.e) stop FROM mb JOIN g ON g.e <= mb.e GROUP BY 1, 2"""),
    "filter_scaffolds": with_tables("hits chrom", f"WITH {_RBH} SELECT * FROM coords WHERE C_scaf <> 'CN3' AND P_scaf <> 'Brand#2'"),
    "filter_min_scaf_size": with_tables("orth", "SELECT 'B' species, B_scaf scaf, max(B_pos) len FROM orth GROUP BY 2 HAVING max(B_pos) >= 999900"),
    "pseudo_chromsizes": with_tables("orth", "SELECT 'A' species, A_scaf scaf, max(A_pos) len FROM orth GROUP BY 2"),
    "annotate_gene_group": with_tables("orth", "SELECT rbh, CASE WHEN k % 5 = 0 THEN 'B' || (k % 7) WHEN k % 3 = 0 THEN 'A' || (k % 7) ELSE 'None' END gene_group FROM (SELECT rbh, CAST(substr(rbh, 4) AS BIGINT) k FROM orth)"),
    "to_long": with_tables("orth", " UNION ALL ".join(f"SELECT rbh, '{s}' species, {s}_gene gene, {s}_scaf scaf, {s}_pos pos FROM orth" for s in "ABCD")),
    "to_wide": with_tables("orth", "SELECT * EXCLUDE (gene_group, color) FROM orth"),
}
