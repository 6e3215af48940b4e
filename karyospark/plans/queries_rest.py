"""Registered queries: text formats, checks, orders, ribbons, sampling."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from karyospark.operators import coords as C
from karyospark.operators import hits as H
from karyospark.operators import order as O
from karyospark.operators import ribbon as R
from karyospark.operators import sampling as D
from karyospark.operators import stats as S
from karyospark.operators import validate as V
from karyospark.operators.lineage import cut, shared_dir
from karyospark.sources import formats as T

from . import fixtures as X
from .fixtures import with_tables
from .queries_groups import joined_lists, number_of_rbh
from .queries_pairs import ANN, LP, WHOLE, annotated


def _folder(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fasta_round_trip(spark, sf_dir):
    path = _folder(spark, "fasta")
    T.write_fasta(X.fasta(spark, sf_dir), path)
    return T.read_fasta(spark, path).withColumn("seq", F.md5("seq"))


def blast6_round_trip(spark, sf_dir):
    path = _folder(spark, "hits")
    X.hits(spark, sf_dir, [("C", "S")]).select(*H.HIT_COLUMNS).write.csv(path, sep="\t")
    return T.read_blast6(spark, path)


def hmm_tblout(spark, sf_dir):
    rows = X.profile_hits(spark, sf_dir)
    line = F.concat_ws("   ", "sseqid", F.lit("-"), F.concat("qseqid", F.lit(".aligned")), F.lit("-"), F.col("evalue").cast("string"), F.col("bitscore").cast("string"), F.lit("0.1 1 1 0.1 1.0 1 0 0 1 1 1 1 -"))
    lines = rows.select(line.alias("value")).unionByName(spark.range(2).select(F.lit("# a comment").alias("value")))
    return T.parse_hmm_tblout(lines)


def gff_to_chrom(spark, sf_dir):
    return T.parse_ncbi_gff(X.gff_lines(spark, sf_dir))


def chromsizes(spark, sf_dir):
    return T.chromsizes(X.fasta(spark, sf_dir), "doc")


def chrom_middle(spark, sf_dir):
    rows = X.chrom(spark, sf_dir).where("species = 'P'").drop("species")
    return T.chrom_with_middle(rows.unionByName(rows.withColumn("start", F.col("start") - 7)))


def rbh_round_trip(spark, sf_dir):
    path = _folder(spark, "rbh")
    rows = X.orth(spark, sf_dir).withColumn("A_gene", F.when(number_of_rbh() % 9 == 0, "nan").otherwise(F.col("A_gene"))).withColumn("B_pos", F.when(number_of_rbh() % 7 != 0, F.col("B_pos")))
    T.write_rbh(rows, path)
    return T.read_rbh(spark, path)


def groupby_round_trip(spark, sf_dir):
    path = _folder(spark, "groupby")
    o = X.orth(spark, sf_dir).groupBy("A_scaf", "B_scaf").agg(F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_list("rbh")).alias("rbh"), F.sort_array(F.collect_list("C_gene")).alias("C_gene"))
    T.write_groupby(o, path)
    return joined_lists(T.read_groupby(spark, path, ["rbh", "C_gene"]))


def genome_coords(spark, sf_dir):
    sizes = C.pseudo_chromsizes(X.orth(spark, sf_dir), "D").withColumn("rank", F.expr("cast(substring(scaf, 2) as int)"))
    return T.genome_coords(sizes)


def _proteins(spark, sf_dir):
    o = X.orth(spark, sf_dir)
    long = C.to_long(o, ["A", "B"])
    return long, long.select("species", "gene", F.upper(F.md5("gene")).alias("seq"))


def rbh_to_fasta_bundle(spark, sf_dir):
    long, proteins = _proteins(spark, sf_dir)
    return T.rbh_to_fasta_bundle(long, proteins).drop("bucket")


def validate_chrom(spark, sf_dir):
    rows = X.chrom(spark, sf_dir).select("protein", "scaf", "strand", F.col("start").cast("string").alias("start"), F.col("stop").cast("string").alias("stop"))
    k = F.expr("try_cast(substring(protein, 2) as bigint)")
    bad = rows.withColumn("strand", F.when(k % 50 == 0, "*").otherwise(F.col("strand"))).withColumn("start", F.when(k % 70 == 0, "x1").otherwise(F.col("start"))).withColumn("scaf", F.when(k % 90 == 0, F.concat(F.lit(" "), "scaf")).otherwise(F.col("scaf"))).withColumn("stop", F.when(k == 33, "stop").otherwise(F.col("stop")))
    return joined_lists(V.validate_chrom(bad))


def duplicate_ids(spark, sf_dir):
    rows = X.fasta(spark, sf_dir)
    return V.duplicate_ids(rows.unionByName(rows.where(F.length("seq") % 5 == 0)))


def duplicate_sequences(spark, sf_dir):
    return V.duplicate_sequences(X.fasta(spark, sf_dir))


def _refs(spark, sf_dir):
    chrom = X.chrom(spark, sf_dir)
    k = F.expr("try_cast(substring(protein, 2) as bigint)")
    return chrom, chrom.where(k % 11 != 0).select(F.col("protein").alias("id")), chrom.where("scaf NOT LIKE '%7'").select(F.col("scaf").alias("id")).distinct()


def validate_chrom_refs(spark, sf_dir):
    return V.validate_chrom_refs(*_refs(spark, sf_dir))


def filter_proteins_to_chrom(spark, sf_dir):
    rows = X.fasta(spark, sf_dir)
    chrom = X.table(spark, sf_dir, "customer").select(F.concat(F.lit("doc"), F.col("c_custkey") * 2).alias("protein"))
    again = rows.withColumn("line", F.lit(1)).unionByName(rows.withColumn("line", F.lit(2)).withColumn("seq", F.lit("X")))
    return V.filter_proteins_to_chrom(again, chrom, "line").withColumn("seq", F.md5("seq"))


def validate_lg_db(spark, sf_dir):
    lg = X.lg_db(spark)
    names = X.profile_hits(spark, sf_dir).select(F.col("qseqid").alias("name")).distinct().where("name NOT LIKE '%3'").unionByName(spark.range(3).select(F.concat(F.lit("Q"), "id").alias("name")))
    return V.validate_lg_db(lg, names)


def validate_rbh_annotations(spark, sf_dir):
    k = number_of_rbh()
    o = X.orth(spark, sf_dir).withColumn("gene_group", F.when(k % 40 != 0, F.col("gene_group"))).withColumn("color", F.when(k % 30 == 0, "#zz").otherwise(F.col("color")))
    found = o.select("rbh", F.when(k % 100 == 0, 3).otherwise(4).alias("n"))
    return joined_lists(V.validate_rbh_annotations(o, found, list("ABCD")))


def drop_duplicate_species_columns(spark, sf_dir):
    o = X.orth(spark, sf_dir)
    twin = o.withColumn("E_gene", F.col("B_gene")).withColumn("E_scaf", F.col("B_scaf")).withColumn("E_pos", F.col("B_pos"))
    return V.drop_duplicate_species_columns(twin, list("ABCDE"))


def analysis_pairs(spark, sf_dir):
    return V.analysis_pairs(X.chrom(spark, sf_dir).select("species").distinct(), ["C"])


def union_tables(spark, sf_dir):
    o = X.orth(spark, sf_dir)
    return o.select("rbh", "A_gene", "B_gene").unionByName(o.select("rbh", "C_gene", "A_gene"), allowMissingColumns=True)


def _pair_p(spark, sf_dir):
    return S.fisher_pairs(annotated(spark, sf_dir), "A_scaf", "B_scaf")


def chrom_order_optimized(spark, sf_dir):
    rows = _pair_p(spark, sf_dir).select(F.col("A_scaf").alias("ref_scaf"), F.col("B_scaf").alias("scaf"), F.round(F.col("neg_log10_p") * -1, 6).alias("p"))
    return O.chrom_order_optimized(rows, C.chrom_order_by_size(X.orth(spark, sf_dir), "A"))


def y_order_by_x(spark, sf_dir):
    o = X.orth(spark, sf_dir)
    return O.y_order_by_x(o, "A", "B", C.chrom_order_by_size(o, "A"))


def _dot(spark, sf_dir):
    rows = annotated(spark, sf_dir)
    pairs = cut(S.fisher_pairs(rows, "A_scaf", "B_scaf").select(F.col("A_scaf").alias("x_scaf"), F.col("B_scaf").alias("y_scaf"), "p"))
    index = rows.groupBy(F.col("A_scaf").alias("x_scaf"), F.col("B_scaf").alias("y_scaf")).agg(F.avg("A_ix").alias("mean_ix"))
    return pairs, C.chrom_order_by_size(rows, "A").select("scaf", "rank"), index


def dotplot_order(spark, sf_dir):
    x, y = O.dotplot_order(*_dot(spark, sf_dir))
    return x.withColumn("axis", F.lit("x")).unionByName(y.withColumn("axis", F.lit("y")))


def connected_components(spark, sf_dir):
    return O.scaffold_components(_dot(spark, sf_dir)[0])


def component_sizes(spark, sf_dir):
    return O.component_sizes(connected_components(spark, sf_dir))


def color_by_lg(spark, sf_dir):
    o = X.orth(spark, sf_dir)
    k = F.expr("cast(substring(gene, 3) as bigint)")
    long = C.to_long(o, list("ABCD"))
    names = long.where(k % 3 != 0).select("gene", F.when(k % 4 == 0, "None").otherwise(F.concat(F.substring("gene", 1, 1), k % 5)).alias("gene_group"), F.when(k % 2 == 0, "#000000").otherwise(F.concat(F.lit("#00000"), k % 7)).alias("color"))
    return O.color_by_lg(long, names, list("ABCD"))


def match_species_to_lg(spark, sf_dir):
    o = X.orth(spark, sf_dir)
    name = O.match_species_to_lg(o.select(F.col("B_gene").alias("gene")), o, list("ABCD"))
    return o.agg(F.count("B_gene").alias("n")).withColumn("species", F.lit(name))


def ribbon_gene_index(spark, sf_dir):
    o = X.orth(spark, sf_dir)
    return R.ribbon_gene_index([o.where(number_of_rbh() % 2 == 0), o.where(number_of_rbh() % 3 == 0), o.select("rbh", "D_gene", "D_scaf", "D_pos")], "B")


def _layout(spark, sf_dir):
    o = X.orth(spark, sf_dir)
    parts = []
    for s in "AC":
        order = C.chrom_order_by_size(o, s).join(C.pseudo_chromsizes(o, s).withColumnRenamed("len", "bp"), "scaf")
        parts.append(order.select("species", "scaf", "rank", "bp", F.col("n").alias("genes")))
    return R.ribbon_chrom_layout(parts[0].unionByName(parts[1]))


def ribbon_chrom_layout(spark, sf_dir):
    out = _layout(spark, sf_dir)
    return out.select("species", "scaf", "rank", "bp", "genes", *[F.round(c, 9).alias(c) for c in ("bp_share", "bp_offset", "genes_share", "genes_offset")])


def ribbon_segments(spark, sf_dir):
    o = X.orth(spark, sf_dir).withColumn("whole_FET", F.when(number_of_rbh() % 4 == 0, 0.5).otherwise(0.01))
    index = {s: R.ribbon_gene_index([o], s) for s in "AC"}
    out = R.ribbon_segments(o, "A", "C", _layout(spark, sf_dir), index, plot_all=True)
    return out.select("rbh", "opacity", *[F.round(f"{s}_x_{u}", 9).alias(f"{s}_x_{u}") for s in "AC" for u in ("bp", "genes")])


def downsample_genes(spark, sf_dir):
    return D.downsample_genes(X.chrom(spark, sf_dir).drop("species"))


def synthetic_genome(spark, sf_dir):
    return D.synthetic_genome(X.chrom(spark, sf_dir)).select("id", F.length("seq").cast("bigint").alias("len"), F.md5("seq").alias("seq_md5"))


_NAMES = "fasta_round_trip blast6_round_trip hmm_tblout gff_to_chrom chromsizes chrom_middle rbh_round_trip groupby_round_trip genome_coords rbh_to_fasta_bundle validate_chrom duplicate_ids duplicate_sequences validate_chrom_refs filter_proteins_to_chrom validate_lg_db validate_rbh_annotations drop_duplicate_species_columns analysis_pairs union_tables chrom_order_optimized y_order_by_x dotplot_order connected_components component_sizes color_by_lg match_species_to_lg ribbon_gene_index ribbon_chrom_layout ribbon_segments downsample_genes synthetic_genome"
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_K = "CAST(substr(rbh, 4) AS BIGINT)"
_VIOL = """, d AS (SELECT DISTINCT rule, shown FROM v QUALIFY dense_rank() OVER (PARTITION BY rule ORDER BY shown) <= 3) SELECT v.rule, count(*) n, (SELECT string_agg(shown, ',' ORDER BY shown) FROM d WHERE d.rule = v.rule) examples FROM v GROUP BY v.rule"""
_SIZE = "SELECT {s}_scaf scaf, count(*) n, max({s}_pos) bp, CAST(row_number() OVER (ORDER BY count(*) DESC, {s}_scaf) - 1 AS BIGINT) \"rank\" FROM orth GROUP BY 1"
_LAYOUT = f"""ch AS (SELECT 'A' species, * FROM ({_SIZE.format(s='A')}) UNION ALL SELECT 'C', * FROM ({_SIZE.format(s='C')})),
g AS (SELECT species, scaf, "rank", bp, n genes, count(*) OVER (PARTITION BY species) c FROM ch),
g2 AS (SELECT *, CASE WHEN c = 1 THEN 0 WHEN c < 10 THEN 0.12 WHEN c > 50 THEN 0.5 ELSE 0.12 + (c - 10) / 40 * 0.38 END gap FROM g),
ly AS (SELECT species, scaf, "rank", bp, genes, """ + ", ".join(f'{u} / sum({u}) OVER (PARTITION BY species) * (1 - gap) {u}_share, coalesce(sum({u}) OVER (PARTITION BY species ORDER BY "rank" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum({u}) OVER (PARTITION BY species) * (1 - gap) + CASE WHEN c > 1 THEN gap / (c - 1) ELSE 0 END * (row_number() OVER (PARTITION BY species ORDER BY "rank") - 1) {u}_offset' for u in ("bp", "genes")) + " FROM g2)"
_X = ", ".join(f"round(l{s}.bp_offset + {s}_pos / l{s}.bp * l{s}.bp_share, 9) {s}_x_bp, round(l{s}.genes_offset + i{s}.ix / l{s}.genes * l{s}.genes_share, 9) {s}_x_genes" for s in "AC")
_DOT = f"""{ANN}, {WHOLE}, xs AS (SELECT A_scaf scaf, row_number() OVER (ORDER BY count(*) DESC, A_scaf) - 1 rk FROM ann GROUP BY 1),
sg AS (SELECT 'x:' || ka a, 'y:' || kb b FROM w WHERE exp(lnp) <= 0.05),
nd AS (SELECT a name FROM sg UNION SELECT b FROM sg)"""
_CC = """lb AS (SELECT name, name AS root FROM nd UNION SELECT CASE WHEN sg.a = lb.name THEN sg.b ELSE sg.a END, root FROM lb JOIN sg ON sg.a = lb.name OR sg.b = lb.name),
cc AS (SELECT name, min(root) component FROM lb GROUP BY 1)"""
_DOT_CC = "WITH RECURSIVE " + with_tables("orth", f"WITH {_DOT}, {_CC}")[5:]

ORACLES = {
    "fasta_round_trip": with_tables("fasta", "SELECT id, \"desc\", md5(seq) seq FROM fasta WHERE seq <> ''"),
    "blast6_round_trip": with_tables("hits", "SELECT * EXCLUDE (query_species, target_species) FROM hits WHERE query_species = 'C' AND target_species = 'S'"),
    "hmm_tblout": with_tables("profile_hits", "SELECT qseqid, sseqid, 50.0::DOUBLE pident, 50 length, 0 mismatch, 0 gapopen, 0 qstart, 0 qend, 0 sstart, 0 send, evalue, bitscore FROM profile_hits"),
    "gff_to_chrom": with_tables("gff_lines", "WITH f AS (SELECT \"value\", string_split(\"value\", chr(9)) f FROM gff_lines), r AS (SELECT \"value\", regexp_extract(f[9], '(?:^|;)protein_id=([^;]*)', 1) protein, f[1] scaf, f[7] strand, CAST(f[4] AS BIGINT) s, CAST(f[5] AS BIGINT) e FROM f WHERE f[3] = 'CDS') SELECT protein, min_by(scaf, \"value\") scaf, min_by(strand, \"value\") strand, min(s) AS \"start\", max(e) stop FROM r GROUP BY 1"),
    "chromsizes": with_tables("fasta", "SELECT 'doc' species, id scaf, CAST(sum(length(seq)) AS BIGINT) len FROM fasta GROUP BY 2"),
    "chrom_middle": with_tables("chrom", "SELECT protein, scaf, strand, \"start\", stop, CAST(floor(\"start\" + (stop - \"start\") / 2) AS BIGINT) middle FROM chrom WHERE species = 'P'"),
    "rbh_round_trip": with_tables("orth", f"SELECT * REPLACE (CASE WHEN {_K} % 9 <> 0 THEN A_gene END AS A_gene, CASE WHEN {_K} % 7 <> 0 THEN B_pos END AS B_pos) FROM orth"),
    "groupby_round_trip": with_tables("orth", 'SELECT A_scaf, B_scaf, count(*) "count", string_agg(rbh, \',\' ORDER BY rbh) rbh, string_agg(C_gene, \',\' ORDER BY C_gene) C_gene FROM orth GROUP BY 1, 2'),
    "genome_coords": with_tables("orth", "WITH s AS (SELECT D_scaf scaf, max(D_pos) len FROM orth GROUP BY 1), c AS (SELECT *, CAST(sum(len) OVER (ORDER BY CAST(substr(scaf, 2) AS INTEGER)) AS BIGINT) cumsum FROM s) SELECT *, cumsum - len plotstart FROM c"),
    "rbh_to_fasta_bundle": with_tables("orth", "SELECT rbh, 2::BIGINT n, '>' || rbh || '_A' || chr(10) || upper(md5(A_gene)) || chr(10) || '>' || rbh || '_B' || chr(10) || upper(md5(B_gene)) AS \"value\" FROM orth"),
    "validate_chrom": with_tables("chrom", """WITH k AS (SELECT *, CAST(substr(protein, 2) AS BIGINT) k FROM chrom), v AS (
SELECT 'strand' rule, protein shown FROM k WHERE k % 50 = 0 UNION ALL SELECT 'start is no number', protein FROM k WHERE k % 70 = 0 UNION ALL SELECT 'blank at an edge', protein FROM k WHERE k % 90 = 0
UNION ALL SELECT 'header', protein FROM k WHERE k = 33 UNION ALL SELECT 'stop is no number', protein FROM k WHERE k = 33)""" + _VIOL),
    "duplicate_ids": with_tables("fasta", "SELECT id, 2::BIGINT n FROM fasta WHERE length(seq) % 5 = 0"),
    "duplicate_sequences": with_tables("fasta", "SELECT * FROM (SELECT id, min(id) OVER (PARTITION BY seq) first_id FROM fasta) WHERE id <> first_id"),
    "validate_chrom_refs": with_tables("chrom", "SELECT 'protein' kind, protein AS \"name\" FROM chrom WHERE CAST(substr(protein, 2) AS BIGINT) % 11 = 0 UNION SELECT 'scaffold', scaf FROM chrom WHERE scaf LIKE '%7'"),
    "filter_proteins_to_chrom": with_tables("fasta", "SELECT id, md5(seq) seq FROM fasta WHERE id IN (SELECT 'doc' || (c_custkey * 2) FROM customer)"),
    "validate_lg_db": with_tables("profile_hits lg_db", "WITH n AS (SELECT DISTINCT qseqid AS name FROM profile_hits WHERE qseqid NOT LIKE '%3' UNION SELECT 'Q' || i FROM range(3) t(i)) SELECT rbh AS \"name\", 'profiles' missing_in FROM lg_db WHERE rbh NOT IN (SELECT name FROM n) UNION SELECT name, 'rbh' FROM n WHERE name NOT IN (SELECT rbh FROM lg_db)"),
    "validate_rbh_annotations": with_tables("orth", f"WITH k AS (SELECT rbh shown, {_K} k FROM orth), v AS (SELECT 'no gene_group' rule, shown FROM k WHERE k % 40 = 0 UNION ALL SELECT 'invalid color', shown FROM k WHERE k % 30 = 0 UNION ALL SELECT 'sequences', shown FROM k WHERE k % 100 = 0)" + _VIOL),
    "drop_duplicate_species_columns": with_tables("orth", "SELECT * FROM orth"),
    "analysis_pairs": with_tables("chrom", "WITH sp AS (SELECT DISTINCT species FROM chrom) SELECT x.species a, y.species b FROM sp x JOIN sp y ON x.species < y.species WHERE 'C' IN (x.species, y.species)"),
    "union_tables": with_tables("orth", "SELECT rbh, A_gene, B_gene, NULL C_gene FROM orth UNION ALL SELECT rbh, A_gene, NULL, C_gene FROM orth"),
    "chrom_order_optimized": with_tables("orth", f"WITH {ANN}, {WHOLE}, xs AS (SELECT A_scaf scaf, row_number() OVER (ORDER BY count(*) DESC, A_scaf) - 1 rk FROM orth GROUP BY 1), q AS (SELECT ka, kb, -n0 p FROM (SELECT ka, kb, {LP.replace('neg_log10_p', 'n0')} FROM w)), b AS (SELECT kb scaf, min((p, rk)) z FROM q JOIN xs ON xs.scaf = ka GROUP BY 1) SELECT scaf, row_number() OVER (ORDER BY z[2], z[1], scaf) - 1 AS \"rank\" FROM b"),
    "y_order_by_x": with_tables("orth", "WITH xs AS (SELECT A_scaf, row_number() OVER (ORDER BY count(*) DESC, A_scaf) - 1 rk FROM orth GROUP BY 1), c AS (SELECT B_scaf, A_scaf, count(*) n, min_by(A_pos, (B_pos, B_gene)) f FROM orth GROUP BY 1, 2), m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY B_scaf ORDER BY n DESC, A_scaf) = 1) SELECT B_scaf scaf, row_number() OVER (ORDER BY rk, f, B_scaf) - 1 AS \"rank\" FROM m JOIN xs USING (A_scaf)"),
    "connected_components": _DOT_CC + " SELECT name AS \"name\", component FROM cc",
    "dotplot_order": _DOT_CC
    + """, xo AS (SELECT scaf, rk, coalesce((SELECT component FROM cc WHERE name = 'x:' || scaf), 'alone:' || scaf) comp FROM xs),
xr AS (SELECT scaf, comp, row_number() OVER (ORDER BY ld, rk) - 1 r FROM (SELECT *, min(rk) OVER (PARTITION BY comp) ld FROM xo)),
yb AS (SELECT kb scaf, min_by(ka, (lnp, ka)) best FROM w GROUP BY 1),
yc AS (SELECT scaf, coalesce((SELECT component FROM cc WHERE name = 'y:' || scaf), (SELECT comp FROM xr WHERE xr.scaf = best)) comp FROM yb),
mi AS (SELECT A_scaf a, B_scaf b, avg(A_ix) m FROM ann GROUP BY 1, 2),
yf AS (SELECT yc.scaf, min((xr.r, m)) f FROM yc JOIN mi ON mi.b = yc.scaf JOIN xr ON xr.scaf = mi.a AND xr.comp = yc.comp GROUP BY 1)
SELECT scaf, r AS "rank", 'x' axis FROM xr UNION ALL SELECT scaf, row_number() OVER (ORDER BY f[1], f[2], scaf) - 1, 'y' FROM yf""",
    "component_sizes": _DOT_CC + ", s AS (SELECT count(*) size FROM cc GROUP BY component) SELECT size AS \"size\", count(*) n FROM s GROUP BY 1",
    "color_by_lg": with_tables("orth", f"WITH k AS (SELECT rbh, {_K} k FROM orth) SELECT rbh, CASE WHEN k % 3 <> 0 AND k % 4 <> 0 THEN 'D' || (k % 5) ELSE 'None' END gene_group, CASE WHEN k % 3 <> 0 AND k % 2 <> 0 THEN '#00000' || (k % 7) ELSE '#000000' END color FROM k"),
    "match_species_to_lg": with_tables("orth", "SELECT 'B' species, count(B_gene) n FROM orth"),
    "ribbon_gene_index": with_tables("orth", f"WITH g AS (SELECT B_scaf scaf, B_gene gene, B_pos pos FROM orth WHERE {_K} % 2 = 0 OR {_K} % 3 = 0) SELECT *, row_number() OVER (PARTITION BY scaf ORDER BY pos, gene) - 1 ix FROM g"),
    "ribbon_chrom_layout": with_tables("orth", f"WITH {_LAYOUT} SELECT species, scaf, \"rank\", bp, genes, round(bp_share, 9) bp_share, round(bp_offset, 9) bp_offset, round(genes_share, 9) genes_share, round(genes_offset, 9) genes_offset FROM ly"),
    "ribbon_segments": with_tables("orth", f"WITH {_LAYOUT}, " + ", ".join(f"i{s} AS (SELECT rbh, row_number() OVER (PARTITION BY {s}_scaf ORDER BY {s}_pos, {s}_gene) - 1 ix FROM orth)" for s in "AC") + f" SELECT orth.rbh, CASE WHEN {_K.replace('rbh', 'orth.rbh')} % 4 = 0 THEN 0.1 ELSE 0.8 END::DOUBLE opacity, {_X} FROM orth " + " ".join(f"JOIN ly l{s} ON l{s}.species = '{s}' AND l{s}.scaf = {s}_scaf JOIN i{s} ON i{s}.rbh = orth.rbh" for s in "AC")),
    "downsample_genes": with_tables("chrom", "WITH k AS (SELECT * FROM chrom WHERE CAST('0x' || substr(md5(protein), 1, 8) AS BIGINT) % 100 < 10), l AS (SELECT *, CASE WHEN floor((stop - \"start\") / 100) = 0 THEN 10 ELSE CAST(floor((stop - \"start\") / 100) AS BIGINT) END len FROM k), s AS (SELECT *, CAST(sum(len) OVER (PARTITION BY scaf ORDER BY \"start\", protein ROWS UNBOUNDED PRECEDING) AS BIGINT) e FROM l) SELECT protein, scaf, strand, e - len AS \"start\", e stop FROM s"),
    "synthetic_genome": with_tables("chrom", "WITH s AS (SELECT scaf id, repeat('GATTACA', CAST(floor(max(stop) / 7) + 2 AS INTEGER)) seq FROM chrom GROUP BY 1) SELECT id, length(seq) len, md5(seq) seq_md5 FROM s"),
}
