"""SQL of the analysis queries."""

from __future__ import annotations

from locusforge.plans import reference as q

_CTES = {
    "p": """p0 AS (SELECT sample, lower(trim(chrom)) AS chrom, CAST(pos AS BIGINT) AS pos, coalesce(gene, 'NA') AS gene, CAST(A AS BIGINT) AS A, CAST(C AS BIGINT) AS C, CAST(G AS BIGINT) AS G, CAST(T AS BIGINT) AS T,
  row_number() OVER (PARTITION BY sample, lower(trim(chrom)), pos ORDER BY loaded_at DESC NULLS LAST, A DESC, C DESC, G DESC, T DESC, gene DESC NULLS LAST) AS r
  FROM profile WHERE sample IS NOT NULL AND chrom IS NOT NULL AND pos IS NOT NULL AND A IS NOT NULL AND C IS NOT NULL AND G IS NOT NULL AND T IS NOT NULL),
p AS (SELECT sample, chrom, pos, gene, A, C, G, T, A + C + G + T AS cov FROM p0 WHERE r = 1)""",
    "s": "s AS (SELECT DISTINCT lower(trim(scaffold)) AS scaffold, genome FROM stb WHERE removed_at IS NULL AND genome IS NOT NULL AND scaffold IS NOT NULL)",
    "b": "b AS (SELECT DISTINCT lower(trim(scaffold)) AS scaffold, start_pos AS s0, end_pos AS e0 FROM genomes_bed_file WHERE removed_at IS NULL AND scaffold IS NOT NULL)",
    "c": r"""c0 AS (SELECT *, upper(trim(regexp_replace(trim(sample_1), '\.parquet$', '', 'i'))) AS a, upper(trim(regexp_replace(trim(sample_2), '\.parquet$', '', 'i'))) AS z,
  CASE WHEN genome_pop_ani <= 1 THEN genome_pop_ani * 100 ELSE genome_pop_ani END AS ani FROM comparison),
c1 AS (SELECT genome, least(a, z) AS sample_1, greatest(a, z) AS sample_2, ani AS genome_pop_ani, total_positions, share_allele_pos, max_consecutive_length, shared_genes_count, identical_gene_count, perc_id_genes,
  row_number() OVER (PARTITION BY genome, least(a, z), greatest(a, z) ORDER BY compared_at DESC NULLS LAST, ani DESC NULLS LAST, total_positions DESC NULLS LAST, share_allele_pos DESC NULLS LAST,
    max_consecutive_length DESC NULLS LAST, shared_genes_count DESC NULLS LAST, identical_gene_count DESC NULLS LAST, perc_id_genes DESC NULLS LAST) AS r
  FROM c0 WHERE genome IS NOT NULL AND a IS NOT NULL AND z IS NOT NULL AND a <> z),
c AS (SELECT * FROM c1 WHERE r = 1)""",
    "o": "o AS (SELECT upper(trim(sample)) AS sample, min(population) AS population FROM sample_population WHERE sample IS NOT NULL GROUP BY 1)",
    "g": """g0 AS (SELECT upper(trim(profile_name)) AS profile_name, profile_location, scaffold_location, reference_db_id, gene_db_id,
  row_number() OVER (PARTITION BY upper(trim(profile_name)) ORDER BY registered_at DESC NULLS LAST, profile_location DESC NULLS LAST, scaffold_location DESC NULLS LAST, reference_db_id DESC NULLS LAST, gene_db_id DESC NULLS LAST) AS r
  FROM profile_registry WHERE profile_name IS NOT NULL),
g AS (SELECT profile_name, profile_location, scaffold_location, reference_db_id, gene_db_id FROM g0 WHERE r = 1)""",
    "f": f"f AS (SELECT * FROM p WHERE cov >= {q.MIN_COV})",
    "e": f"""top AS (SELECT max(cov) AS cov FROM p),
lk AS (SELECT unnest(range(1, (SELECT cov FROM top) + 1)) AS cov), kk AS (SELECT unnest(range(0, 100 + CAST((SELECT cov FROM top) // 1000 AS INTEGER))) AS k),
lt AS (SELECT cov, k, exp(-cov * 0.001 / 3 + CASE WHEN k = 0 THEN 0 ELSE k * ln(cov * 0.001 / 3) END - lgamma(k + 1)) AS px FROM lk CROSS JOIN kk),
lu AS (SELECT cov, k, 1 - sum(px) OVER (PARTITION BY cov ORDER BY k ROWS UNBOUNDED PRECEDING) + px AS at_least FROM lt),
lm AS (SELECT cov, max(k) AS lim FROM lu WHERE at_least > 0.05 GROUP BY cov),
e AS (SELECT sample, chrom, pos, gene, {", ".join(f"CASE WHEN {x} >= lim THEN {x} ELSE 0 END AS {x}" for x in "ACGT")} FROM p JOIN lm ON lm.cov = p.cov WHERE p.cov >= {q.MIN_COV})""",
    "sh": """bl0 AS (SELECT *, sum(CASE WHEN surr = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY sample_1, sample_2, scaffold ORDER BY pos ROWS UNBOUNDED PRECEDING) AS grp FROM l),
lg AS (SELECT l.*, coalesce(s.genome, 'NA') AS genome FROM bl0 l LEFT JOIN s ON s.scaffold = l.scaffold)""",
    "gl": "gl AS (SELECT s.genome, sum(b.e0 - b.s0) AS genome_length FROM b LEFT JOIN s ON s.scaffold = b.scaffold GROUP BY 1)",
    "br": """br AS (SELECT p.sample, s.genome, CAST(count(*) AS DOUBLE) / nullif(max(gl.genome_length), 0) AS breadth FROM p LEFT JOIN s ON s.scaffold = p.chrom LEFT JOIN gl ON gl.genome = s.genome
  WHERE p.cov >= 1 GROUP BY p.sample, s.genome)""",
    "r": "r AS (SELECT gene, chrom AS scaffold, min(pos) AS s0, max(pos) AS e0 FROM p WHERE gene <> 'NA' GROUP BY 1, 2)",
    "i": """i AS (SELECT c.genome, CASE WHEN x.population = y.population THEN 'within_population_' ELSE 'between_population_' END || least(x.population, y.population) || '|' || greatest(x.population, y.population) AS label,
  least(x.population, y.population) AS lo, greatest(x.population, y.population) AS hi, c.max_consecutive_length AS v
  FROM c JOIN o x ON x.sample = c.sample_1 JOIN o y ON y.sample = c.sample_2 WHERE c.perc_id_genes <= 15 AND c.total_positions > 10000 AND x.population IS NOT NULL AND y.population IS NOT NULL)""",
    "rp": """n AS (SELECT DISTINCT profile_name FROM g), d AS (SELECT DISTINCT sample_1, sample_2 FROM c),
rp AS (SELECT n.profile_name AS profile_1, m.profile_name AS profile_2 FROM n JOIN n m ON n.profile_name < m.profile_name
  LEFT JOIN d ON d.sample_1 = n.profile_name AND d.sample_2 = m.profile_name WHERE d.sample_1 IS NULL)""",
}
_WIDTH = "(50000.0 / 9999)"


def _with(*names: str) -> str:
    return "WITH " + ",\n".join(_CTES.get(n, n) for n in names) + "\n"


def _loci(source: str, surr: str, where: str = "x.sample < y.sample") -> str:
    return f"""l AS (SELECT x.sample AS sample_1, y.sample AS sample_2, x.chrom AS scaffold, x.pos, x.gene, {surr} AS surr FROM {source} x JOIN {source} y ON y.chrom = x.chrom AND y.pos = x.pos WHERE {where})"""


_DOT = "(x.A*y.A + x.C*y.C + x.G*y.G + x.T*y.T)"
_POP = _loci("f", _DOT)
_CON_EXPR = "CASE WHEN " + " OR ".join(f"(x.{b} = greatest(x.A, x.C, x.G, x.T) AND y.{b} = greatest(y.A, y.C, y.G, y.T))" for b in "ACGT") + " THEN 1 ELSE 0 END"
_COS_EXPR = f"""CASE WHEN {_DOT} / (sqrt(CAST(x.A*x.A + x.C*x.C + x.G*x.G + x.T*x.T AS DOUBLE)) * sqrt(CAST(y.A*y.A + y.C*y.C + y.G*y.G + y.T*y.T AS DOUBLE))) >= 0.6 THEN 1 ELSE 0 END"""
_LOCI_SUMMARY = """SELECT sample_1, sample_2, scaffold, CAST(count(*) AS BIGINT) AS n_loci, CAST(count(*) FILTER (WHERE surr > 0) AS BIGINT) AS n_shared, CAST(sum(surr) AS BIGINT) AS sum_surr,
  CAST(count(*) FILTER (WHERE gene <> 'NA') AS BIGINT) AS n_in_genes FROM l GROUP BY 1, 2, 3"""
_COMPARE = f"""t AS (SELECT sample_1, sample_2, genome, count(*) AS n, count(*) FILTER (WHERE surr > 0) AS sh FROM lg GROUP BY 1, 2, 3),
bb AS (SELECT sample_1, sample_2, genome, max(n) AS longest FROM (SELECT sample_1, sample_2, genome, scaffold, grp, count(*) AS n FROM lg GROUP BY 1, 2, 3, 4, 5) q GROUP BY 1, 2, 3),
ge AS (SELECT sample_1, sample_2, genome, count(*) AS gn, count(*) FILTER (WHERE n = sh) AS gi FROM (SELECT sample_1, sample_2, genome, gene, count(*) AS n, count(*) FILTER (WHERE surr > 0) AS sh FROM lg GROUP BY 1, 2, 3, 4) q
  WHERE n >= {q.MIN_GENE} AND gene <> 'NA' GROUP BY 1, 2, 3),
cg AS (SELECT t.genome, CAST(t.n AS BIGINT) AS total_positions, CAST(t.sh AS BIGINT) AS share_allele_pos, CAST(t.sh AS DOUBLE) / t.n * 100 AS genome_pop_ani, CAST(bb.longest AS BIGINT) AS max_consecutive_length,
  CAST(ge.gn AS BIGINT) AS shared_genes_count, CAST(ge.gi AS BIGINT) AS identical_gene_count, CAST(ge.gi AS DOUBLE) / ge.gn * 100 AS perc_id_genes, t.sample_1, t.sample_2
  FROM t JOIN bb ON bb.sample_1 = t.sample_1 AND bb.sample_2 = t.sample_2 AND bb.genome = t.genome
  LEFT JOIN ge ON ge.sample_1 = t.sample_1 AND ge.sample_2 = t.sample_2 AND ge.genome = t.genome)"""
_SCOPED = "s AS (SELECT * FROM s1 WHERE genome IN (" + ", ".join(f"'{g}'" for g in q.SCOPE.split(",")) + "))"
_S1 = _CTES["s"].replace("s AS", "s1 AS", 1)
_ALL_SAMPLES = "bs AS (SELECT DISTINCT sample FROM p), bt AS (SELECT bs.sample, br.genome, br.breadth FROM bs LEFT JOIN br ON br.sample = bs.sample AND br.genome IS NOT NULL)"
_SHARING = f"""w AS (SELECT genome, sample FROM br WHERE breadth >= {q.MIN_BREADTH}), nn AS (SELECT sample, count(*) AS n FROM w GROUP BY 1),
h AS (SELECT c.sample_1, c.sample_2, count(*) AS k FROM c JOIN w a ON a.genome = c.genome AND a.sample = c.sample_1 JOIN w z ON z.genome = c.genome AND z.sample = c.sample_2
  WHERE c.total_positions > 10000 AND c.genome_pop_ani >= 99.9 GROUP BY 1, 2),
hh AS (SELECT h.*, a.n AS n1, z.n AS n2, x.population AS p1, y.population AS p2 FROM h JOIN nn a ON a.sample = h.sample_1 JOIN nn z ON z.sample = h.sample_2 JOIN o x ON x.sample = h.sample_1 JOIN o y ON y.sample = h.sample_2
  WHERE x.population IS NOT NULL AND y.population IS NOT NULL),
ss AS (SELECT p1 || '_' || p2 AS pair, sample_1 AS sample, sample_2 AS other, CAST(k AS DOUBLE) / n1 AS rate FROM hh UNION ALL SELECT p2 || '_' || p1, sample_2, sample_1, CAST(k AS DOUBLE) / n2 FROM hh)"""
_DIST = f"""z AS (SELECT genome, label LIKE 'within%' AS own, lo, hi, count(v) AS n FROM i WHERE v IS NOT NULL GROUP BY 1, 2, 3, 4),
pr AS (SELECT z.genome, z.lo, z.hi, z.n AS nb, a.n AS na, b.n AS nc FROM z LEFT JOIN z a ON a.own AND a.genome = z.genome AND a.lo = z.lo LEFT JOIN z b ON b.own AND b.genome = z.genome AND b.lo = z.hi WHERE NOT z.own),
fit AS (SELECT genome, lo, hi FROM pr WHERE nb >= 5 AND na >= 5 AND nc >= 5),
vv AS (SELECT f.genome, f.lo, f.hi, false AS own, i.v FROM fit f JOIN i ON i.genome = f.genome AND i.lo = f.lo AND i.hi = f.hi
  UNION ALL SELECT f.genome, f.lo, f.hi, true, i.v FROM fit f JOIN i ON i.genome = f.genome AND i.lo = i.hi AND (i.lo = f.lo OR i.lo = f.hi)),
hb AS (SELECT genome, lo, hi, own, least(CAST(floor(v / {_WIDTH}) AS BIGINT), 9998) AS bin, count(*) AS n FROM vv WHERE v BETWEEN 0 AND 50000 GROUP BY 1, 2, 3, 4, 5),
hc AS (SELECT *, CAST(sum(n) OVER (PARTITION BY genome, lo, hi, own ORDER BY bin DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(n) OVER (PARTITION BY genome, lo, hi, own) AS share FROM hb),
ed AS (SELECT genome, lo, hi, max(bin) FILTER (WHERE own) AS w, max(bin) FILTER (WHERE NOT own) AS b FROM hc WHERE share >= 0.001 GROUP BY 1, 2, 3),
di AS (SELECT pr.genome, pr.lo || '-' || pr.hi AS pair, coalesce((ed.w - ed.b) * {_WIDTH}, -1.0) AS distance FROM pr LEFT JOIN ed ON ed.genome = pr.genome AND ed.lo = pr.lo AND ed.hi = pr.hi)"""


_PILEUP = "SELECT sample || '|' || chrom AS chrom, CAST(pos AS INTEGER) AS pos, 'NA' AS gene, CAST(A AS INTEGER) AS A, CAST(C AS INTEGER) AS C, CAST(G AS INTEGER) AS G, CAST(T AS INTEGER) AS T FROM p"


_ZERO_FILLED = (
    _with("p", "f", _loci("f", _DOT, f"x.sample = '{q.SINGLE_PAIR[0]}' AND y.sample = '{q.SINGLE_PAIR[1]}'"), "s", "sh", _COMPARE)
    + f"""SELECT coalesce(cg.genome, a.genome) AS genome, {", ".join(f"coalesce(cg.{x}, 0) AS {x}" for x in "total_positions share_allele_pos genome_pop_ani max_consecutive_length shared_genes_count identical_gene_count perc_id_genes".split())},
  '{q.SINGLE_PAIR[0]}' AS sample_1, '{q.SINGLE_PAIR[1]}' AS sample_2 FROM cg FULL JOIN (SELECT DISTINCT genome FROM s) a ON a.genome = cg.genome"""
)
_GENE_PILEUP = _with("p", "r", "w AS (SELECT DISTINCT chrom, pos FROM p)", "k AS (SELECT w.chrom, w.pos, r.gene, row_number() OVER (PARTITION BY w.chrom, w.pos ORDER BY r.s0 DESC NULLS LAST, r.gene DESC NULLS LAST) AS rn FROM w LEFT JOIN r ON r.scaffold = w.chrom AND w.pos BETWEEN r.s0 AND r.e0)") + "SELECT p.chrom, CAST(p.pos AS INTEGER) AS pos, coalesce(k.gene, 'NA') AS gene, CAST(A AS INTEGER) AS A, CAST(C AS INTEGER) AS C, CAST(G AS INTEGER) AS G, CAST(T AS INTEGER) AS T FROM p JOIN k ON k.rn = 1 AND k.chrom = p.chrom AND k.pos = p.pos"


def oracle_sql() -> dict[str, str]:
    counts = "CAST(A AS BIGINT) AS A, CAST(C AS BIGINT) AS C, CAST(G AS BIGINT) AS G, CAST(T AS BIGINT) AS T"
    pop1, pop2 = q.POPULATIONS
    return {
        "coverage_filter": _with("p", "f") + f"SELECT sample, chrom, pos, {counts}, CAST(cov AS BIGINT) AS cov FROM f",
        "error_adjust": _with("p", "e") + f"SELECT sample, chrom, pos, {counts} FROM e",
        "shared_loci_popani": _with("p", "f", _POP) + _LOCI_SUMMARY,
        "shared_loci_conani": _with("p", "f", _loci("f", _CON_EXPR)) + _LOCI_SUMMARY,
        "shared_loci_cosani": _with("p", "f", _loci("f", _COS_EXPR)) + _LOCI_SUMMARY,
        "contiguity_blocks": _with("p", "f", _POP, "s", "sh", "bk AS (SELECT sample_1, sample_2, scaffold, grp, count(*) AS n, max(pos) - min(pos) AS w FROM bl0 GROUP BY 1, 2, 3, 4)")
        + "SELECT sample_1, sample_2, scaffold, CAST(count(*) AS BIGINT) AS n_blocks, CAST(max(n) AS BIGINT) AS longest, CAST(sum(n * grp) AS BIGINT) AS \"check\", CAST(max(w) AS BIGINT) AS widest FROM bk GROUP BY 1, 2, 3",
        "longest_blocks": _with("p", "f", _POP, "s", "sh", _COMPARE) + "SELECT sample_1, sample_2, genome, max_consecutive_length FROM cg",
        "genome_popani": _with("p", "f", _POP, "s", "sh", _COMPARE) + "SELECT sample_1, sample_2, genome, total_positions, share_allele_pos, genome_pop_ani FROM cg",
        "gene_ani_summary": _with("p", "f", _POP, "s", "sh", _COMPARE) + "SELECT sample_1, sample_2, genome, shared_genes_count, identical_gene_count, perc_id_genes FROM cg WHERE shared_genes_count IS NOT NULL",
        "compare_genomes": _with("p", "f", _POP, "s", "sh", _COMPARE) + "SELECT * FROM cg",
        "compare_genomes_error_model": _with("p", "e", _loci("e", _CON_EXPR), "s", "sh", _COMPARE) + "SELECT * FROM cg",
        "compare_genomes_scoped": _with("p", _S1, _SCOPED, f"f AS (SELECT * FROM p WHERE cov >= {q.MIN_COV} AND chrom IN (SELECT scaffold FROM s))", _POP, "sh", _COMPARE) + "SELECT * FROM cg",
        "compare_remaining_pairs": _with("p", "f", "c", "g", "rp", _POP.replace("l AS (", "l1 AS (", 1), "l AS (SELECT l1.* FROM l1 JOIN rp ON rp.profile_1 = l1.sample_1 AND rp.profile_2 = l1.sample_2)", "s", "sh", _COMPARE) + "SELECT * FROM cg",
        "compare_genes": _with("p", "f", _POP, "s", "sh") + f"SELECT sample_1, sample_2, genome, gene, CAST(count(*) AS BIGINT) AS total_positions, CAST(count(*) FILTER (WHERE surr > 0) AS BIGINT) AS share_allele_pos, CAST(count(*) FILTER (WHERE surr > 0) AS DOUBLE) / count(*) * 100 AS ani FROM lg GROUP BY 1, 2, 3, 4 HAVING count(*) >= {q.MIN_GENE}",
        "compare_zero_filled": _ZERO_FILLED,
        "unique_scaffolds": _with("p") + "SELECT DISTINCT chrom AS scaffold FROM p",
        "strain_heterogeneity": _with("p", "s") + "SELECT p.sample, s.genome, CAST(count(*) AS BIGINT) AS total_sites_at_5_coverage, CAST(count(*) FILTER (WHERE CAST(greatest(A, C, G, T) AS DOUBLE) / cov < 0.8) AS BIGINT) AS heterogeneous_sites, CAST(count(*) FILTER (WHERE CAST(greatest(A, C, G, T) AS DOUBLE) / cov < 0.8) AS DOUBLE) / count(*) AS strain_heterogeneity FROM p LEFT JOIN s ON s.scaffold = p.chrom WHERE cov >= 5 GROUP BY 1, 2",
        "genome_length": _with("s", "b", "gl") + "SELECT genome, CAST(genome_length AS BIGINT) AS genome_length FROM gl",
        "genome_breadth": _with("p", "s", "b", "gl", "br") + "SELECT * FROM br",
        "breadth_matrix_full_join": _with("p", "s", "b", "gl", "br", _ALL_SAMPLES) + "SELECT * FROM (PIVOT bt ON sample USING max(breadth) GROUP BY genome) WHERE genome IS NOT NULL",
        "breadth_unpivot": _with("p", "s", "b", "gl", "br", "bs AS (SELECT DISTINCT sample FROM p)", "bg AS (SELECT DISTINCT genome FROM br WHERE genome IS NOT NULL)")
        + "SELECT bg.genome, bs.sample, coalesce(br.breadth, 0.0) AS breadth FROM bg CROSS JOIN bs LEFT JOIN br ON br.genome = bg.genome AND br.sample = bs.sample",
        "gene_ranges": _with("p", "r") + "SELECT scaffold || '_' || regexp_extract(gene, '([^_]*)$', 1) AS gene, scaffold, s0 AS \"start\", e0 AS \"end\" FROM r",
        "gene_loc_explode": _with("p", "r", "b") + "SELECT scaffold, gene, CAST(e0 - s0 + 1 AS BIGINT) AS n, CAST((s0 + e0) * (e0 - s0 + 1) // 2 AS BIGINT) AS sum_pos FROM r WHERE scaffold IN (SELECT scaffold FROM b)",
        "gene_range_annotate": _with("p", "r", "w AS (SELECT DISTINCT chrom, pos FROM p)", "k AS (SELECT w.chrom, w.pos, r.gene, row_number() OVER (PARTITION BY w.chrom, w.pos ORDER BY r.s0 DESC NULLS LAST, r.gene DESC NULLS LAST) AS rn FROM w LEFT JOIN r ON r.scaffold = w.chrom AND w.pos BETWEEN r.s0 AND r.e0)") + "SELECT chrom, pos, coalesce(gene, 'NA') AS gene FROM k WHERE rn = 1",
        "bed_segments": _with("b", "m AS (SELECT scaffold, max(e0) AS n FROM b GROUP BY 1)", "k AS (SELECT scaffold, n, unnest(range(0, n, 50000)) AS s0 FROM m WHERE n > 0)") + "SELECT scaffold, CAST(s0 AS BIGINT) AS \"start\", CAST(least(s0 + 50000, n) AS BIGINT) AS \"end\" FROM k",
        "pileup_clean_count": _with("p") + f"SELECT sample, chrom, pos, {counts} FROM p",
        "pileup_batch": _with("p") + _PILEUP,
        "pileup_stream": _with("p") + _PILEUP,
        "incremental_completion": _with("p", "f", "c", "g", "rp", _POP.replace("l AS (", "l1 AS (", 1), "l AS (SELECT l1.* FROM l1 JOIN rp ON rp.profile_1 = l1.sample_1 AND rp.profile_2 = l1.sample_2)", "s", "sh", _COMPARE)
        + "SELECT * FROM cg UNION ALL SELECT genome, total_positions, share_allele_pos, genome_pop_ani, max_consecutive_length, shared_genes_count, identical_gene_count, perc_id_genes, sample_1, sample_2 FROM c",
        "null_model": """WITH n AS (SELECT unnest(range(1, 10001)) AS cov), k AS (SELECT unnest(range(0, 30)) AS k),
t AS (SELECT cov, k, exp(-cov * 0.001 / 3 + CASE WHEN k = 0 THEN 0 ELSE k * ln(cov * 0.001 / 3) END - lgamma(k + 1)) AS px FROM n CROSS JOIN k),
u AS (SELECT cov, k, 1 - sum(px) OVER (PARTITION BY cov ORDER BY k ROWS UNBOUNDED PRECEDING) + px AS at_least FROM t)
SELECT cov, CAST(max(k) AS BIGINT) AS max_error_count FROM u WHERE at_least > 0.05 GROUP BY cov""",
        "remaining_pairs": _with("c", "g", "rp") + "SELECT * FROM rp",
        "completion_table": _with("c", "g", "rp") + "SELECT profile_1 AS sample_name_1, profile_2 AS sample_name_2, a.profile_location AS profile_location_1, z.profile_location AS profile_location_2, a.scaffold_location AS scaffold_location_1, z.scaffold_location AS scaffold_location_2 FROM rp LEFT JOIN g a ON a.profile_name = profile_1 LEFT JOIN g z ON z.profile_name = profile_2",
        "merge_distinct": _with("g") + "SELECT * FROM g UNION SELECT upper(trim(profile_name)), profile_location, scaffold_location, reference_db_id, gene_db_id FROM profile_registry WHERE profile_name IS NOT NULL",
        "profile_names": _with("c") + "SELECT sample_1 AS profile_name FROM c UNION SELECT sample_2 FROM c",
        "strain_sharing": _with("p", "s", "b", "gl", "br", "c", "o", _SHARING) + "SELECT * FROM ss",
        "ibs_labels": _with("c", "o", "i") + "SELECT genome, label, CAST(count(*) AS BIGINT) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(max(v) AS BIGINT) AS longest FROM i GROUP BY 1, 2",
        "ibs_lists": _with("c", "o", "i", "il AS (SELECT genome, label, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS list FROM i GROUP BY 1, 2)") + "SELECT genome, coalesce(COLUMNS(* EXCLUDE genome), '-1') FROM (PIVOT il ON label USING max(list) GROUP BY genome)",
        "ibs_cdf": _with("c", "o", "i", f"hb AS (SELECT genome, label, least(CAST(floor(v / {_WIDTH}) AS BIGINT), 9998) AS bin, count(*) AS n FROM i WHERE v BETWEEN 0 AND 50000 GROUP BY 1, 2, 3)")
        + f"SELECT genome, label, bin, (bin + 1) * {_WIDTH} AS upper_edge, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER (PARTITION BY genome, label ORDER BY bin DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(n) OVER (PARTITION BY genome, label) AS share_at_or_above FROM hb",
        "ibs_distance": _with("c", "o", "i", _DIST) + "SELECT * FROM di",
        "ibs_heatmap": _with("c", "o", "i", _DIST, "d0 AS (SELECT genome, pair, greatest(distance, 0.0) AS distance FROM di)", "gs AS (SELECT genome, sum(distance) AS row_sum FROM d0 GROUP BY 1 HAVING sum(distance) > 0)", "ps AS (SELECT pair FROM d0 GROUP BY 1 HAVING sum(distance) > 0)")
        + "SELECT d0.genome, d0.pair, d0.distance, round(gs.row_sum, 6) AS row_sum FROM d0 JOIN gs ON gs.genome = d0.genome JOIN ps ON ps.pair = d0.pair",
        "identical_vs_popani": _with("c", "o") + f"""SELECT CASE WHEN x.population = y.population THEN x.population || '-' || y.population ELSE '{pop1}-{pop2}' END AS relationship, c.sample_1, c.sample_2, c.perc_id_genes, c.genome_pop_ani
FROM c LEFT JOIN o x ON x.sample = c.sample_1 LEFT JOIN o y ON y.sample = c.sample_2 WHERE c.genome = '{q.GENOME}' AND c.shared_genes_count > 100 AND c.total_positions > 10000
  AND x.population IN ('{pop1}', '{pop2}') AND y.population IN ('{pop1}', '{pop2}')""",
        "similarity_matrix": _with("c", f"m1 AS (SELECT sample_1, sample_2, genome_pop_ani FROM c WHERE genome = '{q.GENOME}' AND total_positions > 10000)", "m2 AS (SELECT * FROM m1 UNION ALL SELECT sample_2, sample_1, genome_pop_ani FROM m1)",
            "sm AS (SELECT DISTINCT sample_1 AS s FROM m2)", "m AS (SELECT * FROM m2 UNION ALL SELECT s, s, 100.0 FROM sm)", "kp AS (SELECT sample_2 AS s FROM m WHERE genome_pop_ani IS NOT NULL GROUP BY 1 HAVING (SELECT count(*) FROM sm) - count(*) <= 200)")
        + "SELECT a.s AS sample_1, z.s AS sample_2, coalesce(m.genome_pop_ani, 97.0) AS genome_pop_ani FROM kp a CROSS JOIN kp z LEFT JOIN m ON m.sample_1 = a.s AND m.sample_2 = z.s",
        "sampled_sharing": _with("p", "s", "b", "gl", "br", "c", "o", _SHARING) + "SELECT pair, CAST(least(count(*), 20) AS BIGINT) AS n FROM ss GROUP BY 1",
        "chunk_split": _with("b", "k AS (SELECT *, row_number() OVER (ORDER BY scaffold, s0, e0) - 1 AS rn, greatest(count(*) OVER () // 7, 1) AS size FROM b)") + "SELECT CAST(least(rn // size, 6) AS BIGINT) AS chunk, CAST(count(*) AS BIGINT) AS n, min(scaffold) AS \"first\", max(scaffold) AS \"last\" FROM k GROUP BY 1",
        "breadth_tables_collected": _with("p", "s", "b", "gl", "br") + "SELECT genome, sample, breadth FROM br WHERE genome IS NOT NULL AND breadth IS NOT NULL",
        "fasta_segments": _with("b", f"m AS (SELECT scaffold, max(e0) // {q.PER_BASE} AS n FROM b GROUP BY 1)", f"k AS (SELECT scaffold, n, unnest(range(0, n, {q.SEGMENT})) AS s0 FROM m WHERE n > 0)") + f"SELECT scaffold, CAST(s0 AS BIGINT) AS \"start\", CAST(least(s0 + {q.SEGMENT}, n) AS BIGINT) AS \"end\" FROM k",
        "gene_fasta_file": _with("p", "r") + "SELECT scaffold || '_' || regexp_extract(gene, '([^_]*)$', 1) AS gene, scaffold, s0 AS \"start\", e0 AS \"end\" FROM r",
        "merged_parquet_files": _with("p") + f"SELECT sample, chrom, pos, gene, {counts} FROM p",
        "pileup_with_genes": _GENE_PILEUP,
        "pileup_stream_with_genes": _GENE_PILEUP,
        "compare_light_mode": _ZERO_FILLED,
        "tsv_round_trip": _with("s", "b") + "SELECT b.scaffold, CAST(s0 AS BIGINT) AS \"start\", CAST(e0 AS BIGINT) AS \"end\", s.genome FROM b LEFT JOIN s ON s.scaffold = b.scaffold",
        "csv_round_trip": _with("g") + "SELECT * FROM g",
        "config_round_trip": "SELECT 'gen_00003,gen_00000,gen_00001' AS scope_1, 'gen_00002, gen_00001,gen_00000' AS scope_2, true AS compatible, 'gen_00000,gen_00001' AS common, CAST(5 AS BIGINT) AS min_cov",
        "profile_database": _with("p", "g") + "SELECT DISTINCT profile_name, reference_db_id, gene_db_id FROM g WHERE profile_name IN (SELECT sample FROM p)",
        "comparison_database": _with("p", "c", "g", "rp") + "SELECT * FROM rp WHERE profile_1 IN (SELECT sample FROM p) AND profile_2 IN (SELECT sample FROM p)",
        "ibs_survival_lists": _with("c", "o", "i", "iv AS (SELECT * FROM i WHERE v IS NOT NULL)", f"hb AS (SELECT genome, label, least(CAST(floor(v / {_WIDTH}) AS BIGINT), 9998) AS bin, count(*) AS n FROM iv WHERE v BETWEEN 0 AND 50000 GROUP BY 1, 2, 3)",
            f"hl AS (SELECT genome, label, count(*) AS n_steps, (max(bin) + 1) * {_WIDTH} AS top_edge FROM hb GROUP BY 1, 2)", "ev AS (SELECT x.genome, y.label FROM (SELECT DISTINCT genome FROM iv) x CROSS JOIN (SELECT DISTINCT label FROM iv) y)")
        + "SELECT ev.genome, ev.label, CAST(coalesce(hl.n_steps, 1) AS INTEGER) AS n_steps, CAST(coalesce(hl.top_edge, -1.0) AS DOUBLE) AS top_edge, CAST(CASE WHEN hl.n_steps IS NULL THEN -1 ELSE 1 END AS DOUBLE) AS last_share FROM ev LEFT JOIN hl ON hl.genome = ev.genome AND hl.label = ev.label WHERE hl.n_steps IS NOT NULL OR NOT EXISTS (SELECT 1 FROM iv WHERE iv.genome = ev.genome AND iv.label = ev.label)",
        "genome_sample_count": _with("c") + f"SELECT genome, CAST(count(DISTINCT s) AS BIGINT) AS n_samples FROM (SELECT genome, sample_1 AS s FROM c UNION ALL SELECT genome, sample_2 FROM c) z WHERE genome = '{q.GENOME}' GROUP BY 1",
    }
