"""Registered queries over ortholog groups: rates, merging, mixing, fusions, colors."""

from __future__ import annotations

from pyspark.sql import functions as F

from karyospark.functions import color as K
from karyospark.functions import scalars as Z
from karyospark.operators import coords as C
from karyospark.operators import fusion as U
from karyospark.operators import fusion_trials as T
from karyospark.operators import groups as G
from karyospark.operators import mixing as M
from karyospark.operators import permute as P

from . import fixtures as X
from .fixtures import with_tables

SP = list("ABCD")
SCAFS = "A_scaf, B_scaf, C_scaf, D_scaf"
FDR_SIZES = 4999
PERMUTATIONS = 10_000
RANKED_TRIALS = 3
#: For each permuted species.
FUSION_TRIALS = 1000


def number_of_rbh():
    return F.expr("cast(substring(rbh, 4) as bigint)")


def grouped(spark, sf_dir):
    return G.group_by_scaffolds(X.orth(spark, sf_dir).drop("gene_group", "color"), SP)


def list_parts_sql(rows: int, columns: list[str]) -> str:
    """Groups with their lists in parts of so many orthologs."""
    lists = ", ".join(f"string_agg(CAST({c} AS VARCHAR), ',' ORDER BY rbh) {c}" for c in columns)
    return with_tables("orth", f"WITH pl AS (SELECT *, count(*) OVER (PARTITION BY {SCAFS}) \"count\", CAST(floor((row_number() OVER (PARTITION BY {SCAFS} ORDER BY rbh) - 1) / {rows}) AS BIGINT) AS part FROM orth) SELECT {SCAFS}, \"count\", part, {lists} FROM pl GROUP BY {SCAFS}, \"count\", part")


def joined_lists(df):
    """Array columns as text, so that engines compare alike."""
    return df.select(*[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def group_by_scaffolds(spark, sf_dir):
    return joined_lists(grouped(spark, sf_dir))


def group_by_scaffolds_in_parts(spark, sf_dir):
    return joined_lists(G.group_by_scaffolds(X.orth(spark, sf_dir).select("rbh", *[f"{s}_scaf" for s in SP], "A_gene", "A_pos"), SP, rows=64))


def fdr(spark):
    s = F.col("id")
    return spark.range(1, FDR_SIZES + 1).select(s.alias("size"), F.when((s % 3 == 0) | (s > 400), 0.0).otherwise(1 / s).alias("alpha"))


def sized(spark, sf_dir):
    return G.attach_alpha(G.group_sizes(X.orth(spark, sf_dir), SP), fdr(spark))


def attach_alpha(spark, sf_dir):
    return sized(spark, sf_dir).withColumn("alpha", F.round("alpha", 9))


def name_groups(spark, sf_dir):
    return G.name_groups(sized(spark, sf_dir), SP).drop("alpha", "alpha_type")


def unwrap_groups(spark, sf_dir):
    return G.unwrap_groups(grouped(spark, sf_dir))


def colors_long(spark, sf_dir):
    return G.colors_long(X.orth(spark, sf_dir), ["A", "D"])


def merge_tables(spark, sf_dir):
    o = X.orth(spark, sf_dir).select("rbh", *[f"{s}_{c}" for s in SP for c in ("gene", "scaf")])
    cols = lambda *sp: ["rbh", *[f"{s}_{c}" for s in sp for c in ("gene", "scaf")]]
    one = o.where(number_of_rbh() % 2 == 0).select(*cols("A", "B", "C"))
    two = o.where(number_of_rbh() % 3 == 0).withColumn("B_gene", F.when(number_of_rbh() % 5 == 0, F.concat(F.lit("Bg"), number_of_rbh() + 6)).otherwise(F.col("B_gene"))).select(*cols("A", "B", "D"))
    three = o.where(number_of_rbh() % 7 == 0).withColumn("A_gene", F.when(number_of_rbh() % 2 == 0, F.col("A_gene"))).select(*cols("A", "B", "C", "D"))
    return [one, two, three]


def merge_rbh(spark, sf_dir):
    return G.merge_rbh(merge_tables(spark, sf_dir), ["A", "B"])


def fdr_table(spark, sf_dir):
    seen = G.group_sizes(X.orth(spark, sf_dir), SP).select(F.col("count").alias("size"), F.lit(1).alias("n"))
    return G.fdr_table(seen, 1000, 800)


def group_size_fdr(spark, sf_dir):
    state = P.drawn_state(X.orth(spark, sf_dir), SP, PERMUTATIONS, tuples=False)
    return G.fdr_table(P.size_observations(state), PERMUTATIONS)


def combo_fdr_drawn(spark, sf_dir):
    state = G.cut(P.drawn_state(X.orth(spark, sf_dir), ["A", "B"], PERMUTATIONS))
    return G.tail_probabilities(P.combo_observations(state, ["A", "B"]), ["A_scaf", "B_scaf"], PERMUTATIONS)


def ranked_state(spark, sf_dir, species):
    """Trials of two runs, put together."""
    orth, first = X.orth(spark, sf_dir), RANKED_TRIALS // 2
    runs = [P.state_of(G.cut(G.permuted_by_rank(orth, species, n, first=k)), species, n) for k, n in ((0, first), (first, RANKED_TRIALS - first))]
    return G.cut(P.merge_states(*runs))


def combo_fdr(spark, sf_dir):
    state = ranked_state(spark, sf_dir, ["A", "B"])
    return G.tail_probabilities(P.combo_observations(state, ["A", "B"]), ["A_scaf", "B_scaf"], RANKED_TRIALS)


def combo_significance(spark, sf_dir):
    return P.combo_significance(G.group_sizes(X.orth(spark, sf_dir), ["A", "B"]), ranked_state(spark, sf_dir, ["A", "B"]), ["A", "B"])


def ranked_group_sizes(spark, sf_dir):
    return P.size_observations(P.state_of(G.permuted_by_rank(X.orth(spark, sf_dir), SP, RANKED_TRIALS), SP, RANKED_TRIALS))


def ranked_group_size_fdr(spark, sf_dir):
    return G.fdr_table(P.size_observations(ranked_state(spark, sf_dir, SP)), RANKED_TRIALS)


def shuffle_column(spark, sf_dir):
    return G.shuffle_column(X.orth(spark, sf_dir), "B_scaf", "rbh", 2)


def mixing_genes(spark, sf_dir):
    o = X.orth(spark, sf_dir).withColumn("gene_group", F.concat(F.lit("L"), F.floor(number_of_rbh() / 3).cast("bigint") % 4))
    return o.select(F.lit("C").alias("species"), F.col("C_scaf").alias("scaf"), F.col("C_gene").alias("gene"), F.col("C_pos").alias("pos"), "gene_group")


def mixing_ranges(spark, sf_dir):
    sizes = C.pseudo_chromsizes(X.orth(spark, sf_dir), "C")
    return M.mixing_ranges(mixing_genes(spark, sf_dir), sizes).withColumn("percent", F.round("percent", 6))


def mixing_value(spark, sf_dir):
    return M.mixing_value(mixing_genes(spark, sf_dir)).withColumn("m", F.round("m", 6))


def gene_strings(spark, sf_dir):
    return M.gene_strings(mixing_genes(spark, sf_dir), part=64)


def mixing_value_compressed(spark, sf_dir):
    return M.mixing_value(mixing_genes(spark, sf_dir), compress=True).withColumn("m", F.round("m", 6))


def mixing_null(spark, sf_dir):
    out = M.mixing_null(M.mixing_value(mixing_genes(spark, sf_dir)))
    return out.select("scaf", "gene_group_a", "gene_group_b", F.round("p_value_unmixed", 6).alias("p_value_unmixed"))


def groups4(spark, sf_dir):
    return U.fusion_groups(X.orth(spark, sf_dir), SP)


def fusion_groups(spark, sf_dir):
    return groups4(spark, sf_dir)


def fusion_candidates(spark, sf_dir):
    return U.fusion_candidates(groups4(spark, sf_dir), "C", "D").select(*[f"{s}_scaf" for s in SP], "count")


def resolve_outgroup_dups(spark, sf_dir):
    return U.resolve_outgroup_dups(U.fusion_candidates(groups4(spark, sf_dir), "C", "D"), "A", "B", "C", "D").select(*[f"{s}_scaf" for s in SP], "count")


def fusion_tables(spark, sf_dir):
    return U.hypothesis(groups4(spark, sf_dir), "A", "B", "C", "D")


def fusion_stats(spark, sf_dir):
    return joined_lists(U.fusion_stats(U.hypothesis(groups4(spark, sf_dir), "A", "B", "C", "D"), "C", "D"))


def derived_fissions(spark, sf_dir):
    return U.derived_fissions(groups4(spark, sf_dir), SP).select(*[f"{s}_scaf" for s in SP], "count", "fission_in")


def polytomies(spark, sf_dir):
    return U.polytomies(groups4(spark, sf_dir), SP).select(*[f"{s}_scaf" for s in SP], "count")


def annotate_support(spark, sf_dir):
    return U.annotate_support(groups4(spark, sf_dir), SP).select(*[f"{s}_scaf" for s in SP], "count", "data_support")


def fusion_summary(spark, sf_dir):
    return U.fusion_summary(groups4(spark, sf_dir), SP).withColumn("mean", F.round("mean", 6))


def fusion_null(spark, sf_dir):
    return U.fusion_null(X.orth(spark, sf_dir), SP, "B", 4)


def fusion_null_batches(spark, sf_dir):
    """Trials by hash ranks for each species in turn."""
    return T.fusion_null_batches(X.orth(spark, sf_dir), SP, SP[1:], RANKED_TRIALS, ranked=True)


def fusion_null_drawn(spark, sf_dir):
    return T.fusion_null_batches(X.orth(spark, sf_dir), SP, SP[1:], FUSION_TRIALS)


def fusion_p_drawn(spark, sf_dir):
    return U.empirical_p(fusion_null_drawn(spark, sf_dir), U.fusion_summary(groups4(spark, sf_dir), SP), ["permuted"])


def empirical_p(spark, sf_dir):
    return U.empirical_p(fusion_null(spark, sf_dir), U.fusion_summary(groups4(spark, sf_dir), SP))


def trial_histograms(spark, sf_dir):
    return U.trial_histograms(fusion_null(spark, sf_dir))


def colors(spark, sf_dir):
    c = F.concat(F.lit("#"), F.substring(F.md5("p_name"), 1, 6))
    rows = X.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, "#12x456").otherwise(c).alias("color"))
    return rows.select("p_partkey", K.is_valid_hex(F.col("color")).alias("ok"), *[F.when(K.is_valid_hex(F.col("color")), v).alias(n) for n, v in (("brightness", F.round(K.brightness(F.col("color")), 6)), ("saturation", F.round(K.saturation(F.col("color")), 6)), ("text", K.text_color(F.col("color"))))])


def assign_color(spark, sf_dir):
    return X.table(spark, sf_dir, "part").select("p_partkey", K.assign_color(F.col("p_name")).alias("color"))


def collapse_runs(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", F.md5(Z.collapse_runs(F.col("text"))).alias("collapsed"))


_NAMES = "group_by_scaffolds group_by_scaffolds_in_parts attach_alpha name_groups unwrap_groups colors_long merge_rbh fdr_table group_size_fdr combo_fdr combo_fdr_drawn combo_significance ranked_group_sizes ranked_group_size_fdr shuffle_column mixing_ranges mixing_value gene_strings mixing_value_compressed mixing_null fusion_groups fusion_candidates resolve_outgroup_dups fusion_tables fusion_stats derived_fissions polytomies annotate_support fusion_summary fusion_null fusion_null_batches fusion_null_drawn fusion_p_drawn empirical_p trial_histograms colors assign_color collapse_runs"
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_FDR = 'fdr AS (SELECT i AS "size", CASE WHEN i % 3 = 0 OR i > 400 THEN 0 ELSE 1.0 / i END::DOUBLE AS alpha FROM range(1, 5000) t(i))'
_SIZED = f"""{_FDR}, gs AS (SELECT {SCAFS}, count(*) "count" FROM orth GROUP BY ALL),
sized AS (SELECT gs.*, (SELECT max_by(alpha, "size") FROM fdr WHERE "size" <= "count" AND alpha > 0) alpha, CASE WHEN (SELECT alpha FROM fdr WHERE "size" = "count") > 0 THEN 'equal_to' ELSE 'less_than' END alpha_type FROM gs)"""
_BRIGHT = "(299 * ('0x' || substr({c}, 2, 2))::INTEGER + 587 * ('0x' || substr({c}, 4, 2))::INTEGER + 114 * ('0x' || substr({c}, 6, 2))::INTEGER)"
_TOP = "greatest(('0x' || substr({c}, 2, 2))::INTEGER, ('0x' || substr({c}, 4, 2))::INTEGER, ('0x' || substr({c}, 6, 2))::INTEGER)"
_LOW = "least(('0x' || substr({c}, 2, 2))::INTEGER, ('0x' || substr({c}, 4, 2))::INTEGER, ('0x' || substr({c}, 6, 2))::INTEGER)"
_SAT = f"CASE WHEN {_TOP} > 0 THEN ({_TOP} - {_LOW}) / {_TOP} ELSE 0 END"


def _assigned(key: str) -> str:
    c = f"'#' || substr(md5({key} || ':' || i), 1, 6)"
    return f"(SELECT coalesce(min_by(c, i) FILTER (WHERE b > 127 AND b < 300 AND s > 0.3 AND s < 0.8), min_by(c, i)) FROM (SELECT i, c, {_BRIGHT.format(c='c')} / 1000 b, {_SAT.format(c='c')} s FROM (SELECT i, {c} c FROM range(64) t(i))))"


_MG = "mg AS (SELECT 'C' species, C_scaf scaf, C_gene gene, C_pos pos, 'L' || (CAST(floor(CAST(substr(rbh, 4) AS BIGINT) / 3) AS BIGINT) % 4) gene_group FROM orth), ends AS (SELECT species, scaf, gene_group, count(*) n, min(pos) lo, max(pos) hi FROM mg GROUP BY ALL HAVING count(*) >= 3)"
_MV = f"""{_MG}, pr AS (SELECT a.species, a.scaf, a.gene_group ga, b.gene_group gb FROM ends a JOIN ends b USING (species, scaf) WHERE a.gene_group < b.gene_group),
st AS (SELECT species, scaf, ga gene_group_a, gb gene_group_b, string_agg(CASE WHEN gene_group = ga THEN 'A' ELSE 'B' END, '' ORDER BY pos, gene) g FROM mg JOIN pr USING (species, scaf) WHERE gene_group IN (ga, gb) GROUP BY ALL)"""


def _mv(string: str) -> str:
    return f"""WITH {_MV}, cl AS (SELECT species, scaf, gene_group_a, gene_group_b, {string} genestring FROM st),
cn AS (SELECT *, length(replace(genestring, 'B', '')) n_a, length(replace(genestring, 'A', '')) n_b, (SELECT count(*) FROM range(2, length(genestring) + 1) t(i) WHERE genestring[i] <> genestring[i - 1]) changes FROM cl)"""


def _ranked(species: list[str]) -> str:
    """CTEs up to perm(trial, rbh, scaffolds): columns but the first dealt by hash ranks."""
    first = f"SELECT t.i trial, rbh, {species[0]}_scaf FROM orth, range({RANKED_TRIALS}) t(i)"
    parts = [
        f"q{s} AS (SELECT m.trial, m.rbh, p.{s}_scaf FROM (SELECT t.i trial, rbh, row_number() OVER (PARTITION BY t.i ORDER BY md5(t.i || ':{s}:' || rbh), rbh) k FROM orth, range({RANKED_TRIALS}) t(i)) m JOIN (SELECT {s}_scaf, row_number() OVER (ORDER BY rbh) k FROM orth) p USING (k))"
        for s in species[1:]
    ]
    joins = " ".join(f"JOIN q{s} USING (trial, rbh)" for s in species[1:])
    return ", ".join([f"qf AS ({first})", *parts, f"perm AS (SELECT * FROM qf {joins})"])


_COLLAPSE = "list_reduce(list_transform(range(1, length(g) + 1), lambda i: g[i]), lambda a, b: CASE WHEN right(a, 1) = b THEN a ELSE a || b END)"
_G4 = "g4 AS (SELECT " + SCAFS + ", count(*) \"count\", " + ", ".join(f"min({s}_pos) {s}_lo, max({s}_pos) {s}_hi" for s in SP) + " FROM orth GROUP BY ALL HAVING count(*) >= {least})"


def _hyp(a: str, b: str, c: str, n: str, by: str = "") -> str:
    """CTEs up to {n}: the fusion table with a as sister, from g4, within each value of ``by``."""
    p = f"{by}{b}_scaf, {c}_scaf"
    return f"""{n}1 AS (SELECT * FROM g4 QUALIFY count(*) OVER (PARTITION BY {p}) >= 2),
{n}2 AS (SELECT *, count(*) OVER (PARTITION BY {p}, A_scaf) > 1 dup FROM {n}1),
{n}3 AS (SELECT *, count(*) FILTER (WHERE dup) OVER w dups, count(*) FILTER (WHERE NOT dup) OVER w singles, max(CASE WHEN NOT dup THEN {a}_scaf END) OVER w sa FROM {n}2 WINDOW w AS (PARTITION BY {p})),
{n}4 AS (SELECT * FROM {n}3 WHERE NOT (dup AND dups > 1 AND (singles > 1 OR (singles = 1 AND {a}_scaf = sa)))),
{n}r AS (SELECT * FROM {n}4 QUALIFY count(*) OVER (PARTITION BY {p}, A_scaf) = 1),
{n}p AS (SELECT x.A_scaf oa, y.A_scaf ob, x.{a}_scaf aa, y.{a}_scaf ab, {p}, x."count" na, y."count" nb,
  x.{a}_scaf <> y.{a}_scaf AND NOT (greatest(x."count", y."count") > 7 * least(x."count", y."count") AND least(x."count", y."count") <= 10)
  AND ((greatest(x.{b}_lo, y.{b}_lo) <= least(x.{b}_hi, y.{b}_hi)) OR (greatest(x.{c}_lo, y.{c}_lo) <= least(x.{c}_hi, y.{c}_hi))) mixed
  FROM {n}r x JOIN {n}r y USING ({p}) WHERE (x.A_scaf, x.{a}_scaf) < (y.A_scaf, y.{a}_scaf)),
{n} AS (SELECT oa A_scaf, aa {a}_scaf, {p}, na "count", mixed FROM {n}p UNION SELECT ob, ab, {p}, nb, mixed FROM {n}p)"""


_HYPS = [("B", "C", "D"), ("C", "B", "D"), ("D", "B", "C")]
_ALL_HYPS = ",\n".join(_hyp(*h, f"h{h[0]}") for h in _HYPS)
_SMALL = _G4.format(least=5)
_FLAGS = [(f"EXISTS (SELECT 1 FROM h{a} h WHERE h.mixed = {m} AND " + " AND ".join(f"h.{s}_scaf = g4.{s}_scaf" for s in SP) + ")", f"{a}_{x}") for x, m in (("sis", "true"), ("FU", "false")) for a, _, _ in _HYPS]
_FLAGS += [(f"count(*) OVER (PARTITION BY {', '.join(f'{s}_scaf' for s in SP if s != a)}) > 1", f"{a}_DerFissOrOGfus") for a in "BCD"] + [("count(*) OVER (PARTITION BY B_scaf, C_scaf, D_scaf) > 1", "B_C_D_polytomy")]

ORACLES = {
    "group_by_scaffolds": list_parts_sql(G.LIST_ROWS, ["rbh", *[f"{s}_{c}" for s in SP for c in ("gene", "pos")]]),
    "group_by_scaffolds_in_parts": list_parts_sql(64, ["rbh", "A_gene", "A_pos"]),
    "attach_alpha": with_tables("orth", f"WITH {_SIZED} SELECT * REPLACE (round(alpha, 9) AS alpha) FROM sized"),
    "name_groups": with_tables("orth", f"WITH {_SIZED}, nm AS (SELECT * EXCLUDE (alpha, alpha_type), alpha, 'A_B_C_D_' || row_number() OVER (ORDER BY \"count\" DESC, {SCAFS}) gene_group FROM sized) SELECT * EXCLUDE (alpha), CASE WHEN alpha <= 0.05 THEN {_assigned('gene_group')} ELSE '#000000' END color FROM nm"),
    "unwrap_groups": with_tables("orth", "SELECT * EXCLUDE (gene_group, color) FROM orth"),
    "colors_long": with_tables("orth", " UNION ALL ".join(f"SELECT '{s}' species, {s}_scaf scaf, {s}_pos pos, {s}_gene gene, color, gene_group, rbh FROM orth" for s in "AD")),
    "fdr_table": with_tables("orth", f"WITH s AS (SELECT count(*) \"size\" FROM orth GROUP BY {SCAFS}), c AS (SELECT \"size\", count(*) n FROM s GROUP BY 1) SELECT i AS \"size\", coalesce(n, 0) n, coalesce(n, 0) / 1000 AS alpha FROM range(1, 801) t(i) LEFT JOIN c ON \"size\" = i"),
    "merge_rbh": with_tables("orth", """WITH k AS (SELECT *, CAST(substr(rbh, 4) AS BIGINT) k FROM orth),
u AS (SELECT 0 t, A_gene, A_scaf, B_gene, B_scaf, C_gene, C_scaf, NULL D_gene, NULL D_scaf FROM k WHERE k % 2 = 0
  UNION ALL SELECT 1, A_gene, A_scaf, CASE WHEN k % 5 = 0 THEN 'Bg' || (k + 6) ELSE B_gene END, B_scaf, NULL, NULL, D_gene, D_scaf FROM k WHERE k % 3 = 0
  UNION ALL SELECT 2, CASE WHEN k % 2 = 0 THEN A_gene END, A_scaf, B_gene, B_scaf, C_gene, C_scaf, D_gene, D_scaf FROM k WHERE k % 7 = 0),
o AS (SELECT *, (t, A_scaf, B_scaf, C_gene, C_scaf, D_gene, D_scaf) z FROM u WHERE A_gene IS NOT NULL AND B_gene IS NOT NULL),
m AS (SELECT A_gene, B_gene, """ + ", ".join(f"min_by({c}, z) FILTER (WHERE {c} IS NOT NULL) {c}" for c in ("A_scaf", "B_scaf", "C_gene", "C_scaf", "D_gene", "D_scaf")) + """ FROM o GROUP BY 1, 2),
n AS (SELECT *, """ + " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in ("A_gene", "B_gene", "A_scaf", "B_scaf", "C_gene", "C_scaf", "D_gene", "D_scaf")) + """ nancount FROM m),
a AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY A_gene ORDER BY nancount, A_gene, B_gene) = 1),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY B_gene ORDER BY nancount, A_gene, B_gene) = 1),
c AS (SELECT * FROM b QUALIFY C_gene IS NULL OR row_number() OVER (PARTITION BY C_gene ORDER BY nancount, A_gene, B_gene) = 1),
d AS (SELECT * FROM c QUALIFY D_gene IS NULL OR row_number() OVER (PARTITION BY D_gene ORDER BY nancount, A_gene, B_gene) = 1)
SELECT *, 'mer_A_B_C_D_' || row_number() OVER (ORDER BY A_gene, B_gene) rbh FROM d"""),
    "shuffle_column": with_tables("orth", "WITH p AS (SELECT rbh, B_scaf, row_number() OVER (ORDER BY rbh) k FROM orth), m AS (SELECT CAST(t.i AS INTEGER) trial, rbh, row_number() OVER (PARTITION BY t.i ORDER BY md5(t.i || ':' || rbh), rbh) k FROM orth, range(2) t(i)) SELECT trial, m.rbh, p.B_scaf FROM m JOIN p USING (k)"),
    "ranked_group_sizes": with_tables("orth", f"WITH {_ranked(SP)}, tc AS (SELECT trial, {SCAFS}, count(*) n FROM perm GROUP BY ALL) SELECT n AS \"size\", count(DISTINCT trial) n FROM tc GROUP BY 1"),
    "ranked_group_size_fdr": with_tables("orth", f"WITH {_ranked(SP)}, tc AS (SELECT trial, {SCAFS}, count(*) n FROM perm GROUP BY ALL) SELECT n AS \"size\", count(DISTINCT trial) n, count(DISTINCT trial) / {RANKED_TRIALS} alpha FROM tc GROUP BY 1"),
    "combo_fdr": with_tables("orth", f"WITH {_ranked(['A', 'B'])}, tc AS (SELECT trial, A_scaf, B_scaf, count(*) n FROM perm GROUP BY ALL), ob AS (SELECT A_scaf, B_scaf, n AS \"size\", count(*) n FROM tc GROUP BY 1, 2, 3), al AS (FROM ob UNION ALL SELECT A_scaf, B_scaf, 0, {RANKED_TRIALS} - sum(n) FROM ob GROUP BY 1, 2 HAVING sum(n) < {RANKED_TRIALS}) SELECT A_scaf, B_scaf, \"size\", CAST(n AS BIGINT) n, greatest(sum(n) OVER (PARTITION BY A_scaf, B_scaf ORDER BY \"size\" DESC) / {RANKED_TRIALS}, 1 / {RANKED_TRIALS}) p FROM al"),
    "combo_significance": with_tables("orth", f"WITH {_ranked(['A', 'B'])}, tc AS (SELECT trial, A_scaf, B_scaf, count(*) n FROM perm GROUP BY ALL), mx AS (SELECT trial, max(n) most FROM tc GROUP BY 1), g AS (SELECT A_scaf, B_scaf, count(*) \"count\" FROM orth GROUP BY ALL) SELECT A_scaf, B_scaf, \"count\", greatest((SELECT count(*) FROM tc WHERE tc.A_scaf = g.A_scaf AND tc.B_scaf = g.B_scaf AND n >= \"count\") / {RANKED_TRIALS}, 1 / {RANKED_TRIALS}) p, greatest((SELECT count(*) FROM mx WHERE most >= \"count\") / {RANKED_TRIALS}, 1 / {RANKED_TRIALS}) p_family FROM g"),
    "gene_strings": with_tables("orth", f"WITH {_MV} SELECT species, scaf, gene_group_a, gene_group_b, k AS part, substr(g, CAST(k * 64 + 1 AS BIGINT), 64) genestring FROM (SELECT *, unnest(range(0, CAST(ceil(length(g) / 64) AS BIGINT))) k FROM st)"),
    "mixing_ranges": with_tables("orth", f"WITH {_MG} SELECT a.species, a.scaf, a.gene_group gene_group_a, a.n n_a, a.lo lo_a, a.hi hi_a, b.gene_group gene_group_b, b.n n_b, b.lo lo_b, b.hi hi_b, greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) bases_covered, len, round(100 * greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) / len, 6) AS percent FROM ends a JOIN ends b USING (species, scaf) JOIN (SELECT C_scaf scaf, max(C_pos) len FROM orth GROUP BY 1) s ON s.scaf = a.scaf WHERE a.gene_group < b.gene_group"),
    "mixing_value": with_tables("orth", _mv("g") + " SELECT * EXCLUDE (genestring), round((changes - 1) / nullif(2 * n_a * n_b / (n_a + n_b) - 1, 0), 6) m FROM cn"),
    "mixing_value_compressed": with_tables("orth", _mv(_COLLAPSE) + " SELECT * EXCLUDE (genestring), round((changes - 1) / nullif(2 * n_a * n_b / (n_a + n_b) - 1, 0), 6) m FROM cn"),
    "mixing_null": with_tables("orth", _mv("g") + """, rn AS (SELECT *, unnest(range(2, changes + 2)) r FROM cn),
ch AS (SELECT *, CAST(floor(r / 2) AS BIGINT) h FROM rn),
pr2 AS (SELECT scaf, gene_group_a, gene_group_b, CASE WHEN r % 2 = 0 THEN CASE WHEN h <= n_a AND h <= n_b THEN exp(ln(2) + lgamma(n_a) - lgamma(h) - lgamma(n_a - h + 1) + lgamma(n_b) - lgamma(h) - lgamma(n_b - h + 1) - q) ELSE 0 END
  ELSE CASE WHEN h <= n_a - 1 AND h <= n_b THEN exp(lgamma(n_a) - lgamma(h + 1) - lgamma(n_a - h) + lgamma(n_b) - lgamma(h) - lgamma(n_b - h + 1) - q) ELSE 0 END + CASE WHEN h <= n_a AND h <= n_b - 1 THEN exp(lgamma(n_a) - lgamma(h) - lgamma(n_a - h + 1) + lgamma(n_b) - lgamma(h + 1) - lgamma(n_b - h) - q) ELSE 0 END END p
  FROM (SELECT *, lgamma(n_a + n_b + 1) - lgamma(n_a + 1) - lgamma(n_b + 1) q FROM ch))
SELECT scaf, gene_group_a, gene_group_b, round(least(1, sum(p)), 6) p_value_unmixed FROM pr2 GROUP BY ALL"""),
    "fusion_groups": with_tables("orth", f"WITH {_SMALL} SELECT * FROM g4"),
    "fusion_candidates": with_tables("orth", f'WITH {_SMALL} SELECT {SCAFS}, "count" FROM g4 QUALIFY count(*) OVER (PARTITION BY C_scaf, D_scaf) >= 2'),
    "resolve_outgroup_dups": with_tables("orth", f'WITH {_SMALL}, {_hyp("B", "C", "D", "h")} SELECT {SCAFS}, "count" FROM hr'),
    "fusion_tables": with_tables("orth", f"WITH {_SMALL}, {_hyp('B', 'C', 'D', 'h')} SELECT * FROM h"),
    "fusion_stats": with_tables("orth", f"WITH {_SMALL}, {_hyp('B', 'C', 'D', 'h')} SELECT C_scaf, D_scaf, mixed, string_agg(CAST(\"count\" AS VARCHAR), ',' ORDER BY \"count\") counts FROM h GROUP BY ALL"),
    "derived_fissions": with_tables("orth", f"WITH {_SMALL} " + " UNION ALL ".join(f"SELECT * FROM (SELECT {SCAFS}, \"count\", '{a}' fission_in FROM g4 QUALIFY count(*) OVER (PARTITION BY {', '.join(f'{s}_scaf' for s in SP if s != a)}) > 1)" for a in "BCD")),
    "polytomies": with_tables("orth", f'WITH {_SMALL} SELECT {SCAFS}, "count" FROM g4 QUALIFY count(*) OVER (PARTITION BY B_scaf, C_scaf, D_scaf) > 1'),
    "annotate_support": with_tables("orth", f'WITH {_SMALL}, {_ALL_HYPS}, lb AS (SELECT {SCAFS}, "count", concat_ws(\'_\', ' + ", ".join(f"CASE WHEN {f} THEN '{n}' END" for f, n in _FLAGS) + ") t FROM g4) SELECT * EXCLUDE (t), CASE WHEN t = '' THEN 'singleton' ELSE t END data_support FROM lb"),
    "fusion_summary": with_tables("orth", f"WITH {_SMALL}, {_ALL_HYPS}, s AS (" + " UNION ALL ".join(f"SELECT '{a}' hyp, {b}_scaf x, {c}_scaf y, max(\"count\") ms, sum(\"count\") su, count(*) n FROM h{a} WHERE mixed GROUP BY ALL" for a, b, c in _HYPS) + ") SELECT hyp, max(ms) max_single, CAST(max(su) AS BIGINT) max_grouping, CAST(sum(su) AS BIGINT) total, count(*) n_groupings, round(sum(su) / sum(n), 6) mean FROM s GROUP BY 1"),
    "colors": f"WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '#12x456' ELSE '#' || substr(md5(p_name), 1, 6) END color FROM part), k AS (SELECT *, regexp_matches(color, '^.[0-9A-Fa-f]{{6}}$') ok FROM c), v AS (SELECT p_partkey, ok, CASE WHEN ok THEN color ELSE '#000000' END c FROM k) SELECT p_partkey, ok, CASE WHEN ok THEN round({_BRIGHT.format(c='c')} / 1000, 6) END brightness, CASE WHEN ok THEN round({_SAT.format(c='c')}, 6) END saturation, CASE WHEN ok THEN CASE WHEN {_BRIGHT.format(c='c')} / 1000 > 186 OR c = '#000000' THEN '#000000' ELSE '#FFFFFF' END END \"text\" FROM v",
    "collapse_runs": "WITH c AS (SELECT doc_id, unnest(string_split(text, '')) c, generate_subscripts(string_split(text, ''), 1) i FROM documents), k AS (SELECT *, lag(c) OVER (PARTITION BY doc_id ORDER BY i) p FROM c) SELECT doc_id, md5(string_agg(c, '' ORDER BY i) FILTER (WHERE p IS DISTINCT FROM c)) collapsed FROM k GROUP BY 1",
    "assign_color": f"SELECT p_partkey, {_assigned('p_name')} color FROM part",
}
