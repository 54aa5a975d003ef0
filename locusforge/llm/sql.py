"""SQL of the training-data queries that SQL can express."""

from __future__ import annotations

_PAIRS = r"""c0 AS (SELECT *, upper(trim(regexp_replace(trim(sample_1), '\.parquet$', '', 'i'))) AS a, upper(trim(regexp_replace(trim(sample_2), '\.parquet$', '', 'i'))) AS b FROM comparison),
c AS (SELECT *, least(a, b) AS x, greatest(a, b) AS y FROM c0 WHERE genome IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND a <> b)"""

_P1 = f"""WITH {_PAIRS},
p0 AS (SELECT sample || '|' || lower(trim(chrom)) AS k, CAST(pos AS BIGINT) AS ord, A, C, G, T,
  row_number() OVER (PARTITION BY sample, lower(trim(chrom)), pos ORDER BY loaded_at DESC, A DESC, C DESC, G DESC, T DESC) AS r
  FROM profile WHERE sample IS NOT NULL AND chrom IS NOT NULL AND A IS NOT NULL AND C IS NOT NULL AND G IS NOT NULL AND T IS NOT NULL),
p1 AS (SELECT *, lag(ord) OVER w AS ord0, lag(A) OVER w AS a0, lag(C) OVER w AS c0, lag(G) OVER w AS g0, lag(T) OVER w AS t0
  FROM p0 WHERE r = 1 WINDOW w AS (PARTITION BY k ORDER BY ord)),
p2 AS (SELECT k, ord, sum(CASE WHEN ord - ord0 <= 3 AND abs(A - a0) <= 1 AND abs(C - c0) <= 1 AND abs(G - g0) <= 1 AND abs(T - t0) <= 1 THEN 0 ELSE 1 END)
  OVER (PARTITION BY k ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run FROM p1),
q0 AS (SELECT DISTINCT x || '|' || y || '|' || genome AS k, compared_at AS ord, max(max_consecutive_length) OVER (PARTITION BY x, y, genome, compared_at) AS v
  FROM c WHERE max_consecutive_length IS NOT NULL),
q1 AS (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY ord) AS v0 FROM q0),
q2 AS (SELECT k, ord, sum(CASE WHEN abs(v - v0) <= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run FROM q1)
SELECT 'profile' AS seq_table, k AS seq_key, CAST(min(ord) AS BIGINT) AS run_start, CAST(max(ord) AS BIGINT) AS run_end, CAST(count(*) AS BIGINT) AS n_rows
FROM p2 GROUP BY k, run HAVING count(*) >= 5
UNION ALL SELECT 'comparison', k, CAST(strftime(min(ord), '%Y%m%d%H%M%S') AS BIGINT), CAST(strftime(max(ord), '%Y%m%d%H%M%S') AS BIGINT), CAST(count(*) AS BIGINT)
FROM q2 GROUP BY k, run HAVING count(*) >= 3"""

_P5 = f"""WITH RECURSIVE {_PAIRS},
ranked AS (SELECT genome, x, y, CASE WHEN genome_pop_ani <= 1 THEN genome_pop_ani * 100 ELSE genome_pop_ani END AS ani, total_positions,
  row_number() OVER (PARTITION BY genome, x, y ORDER BY compared_at DESC, CASE WHEN genome_pop_ani <= 1 THEN genome_pop_ani * 100 ELSE genome_pop_ani END DESC, total_positions DESC) AS r
  FROM c WHERE genome_pop_ani IS NOT NULL AND compared_at IS NOT NULL),
links AS (SELECT genome, x, y FROM ranked WHERE r = 1 AND ani >= 99.9 AND total_positions > 10000),
both_ways AS (SELECT genome, x, y FROM links UNION SELECT genome, y, x FROM links),
reach(genome, s, t) AS (SELECT genome, x, x FROM both_ways UNION SELECT r.genome, r.s, b.y FROM reach r JOIN both_ways b ON b.genome = r.genome AND b.x = r.t)
SELECT genome, min(t) AS group_sample, s AS sample FROM reach GROUP BY genome, s"""


_P4 = """WITH p AS (SELECT lower(trim(chrom)) AS key, coalesce(strftime(loaded_at, '%Y-%m'), 'none') AS month, A, C, G, T FROM profile WHERE chrom IS NOT NULL),
v AS (SELECT key, month, 'A' AS metric, A AS v FROM p UNION ALL SELECT key, month, 'C', C FROM p UNION ALL SELECT key, month, 'G', G FROM p
  UNION ALL SELECT key, month, 'T', T FROM p UNION ALL SELECT key, month, 'sum', CAST(A AS BIGINT) + C + G + T FROM p),
m AS (SELECT DISTINCT lower(trim(scaffold)) AS key, genome FROM stb WHERE removed_at IS NULL AND genome IS NOT NULL AND scaffold IS NOT NULL),
s AS (SELECT 'scaffold' AS scope, key, month, metric, v, count(*) AS n FROM v WHERE v IS NOT NULL GROUP BY ALL),
g AS (SELECT 'genome' AS scope, genome AS key, month, metric, v, sum(n) AS n FROM s JOIN m USING (key) GROUP BY ALL),
u AS (SELECT * FROM s UNION ALL SELECT * FROM g),
w AS (SELECT * FROM u UNION ALL SELECT scope, key, 'all', metric, v, sum(n) FROM u GROUP BY scope, key, metric, v),
c AS (SELECT *, sum(n) OVER (PARTITION BY scope, key, month, metric ORDER BY v) AS run, sum(n) OVER (PARTITION BY scope, key, month, metric) AS total FROM w)
SELECT scope, key, month, metric, CAST(max(total) AS BIGINT) AS n, """ + ", ".join(f"CAST(min(v) FILTER (WHERE run * 100 >= {p} * total) AS BIGINT) AS p{p}" for p in (25, 50, 75, 90, 99)) + """,
  CAST(max(total) // 34000 * 34 AS BIGINT) AS rank_error FROM c GROUP BY scope, key, month, metric"""


def _items(name: str, lengths: str, capacity: int) -> str:
    """A whole number of full batches and a rest of each item; all batches hold."""
    return f"SELECT k AS {name}, CAST(ceil(n / {capacity}.0) AS BIGINT) AS n_pieces, CAST(n AS BIGINT) AS length, true AS whole, true AS fits FROM ({lengths}) z WHERE n > 0"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1,
        "p2_scaffold_items": _items("scaffold", "SELECT lower(trim(scaffold)) AS k, sum(e - s) AS n FROM (SELECT DISTINCT lower(trim(scaffold)) AS scaffold, start_pos AS s, end_pos AS e FROM genomes_bed_file WHERE scaffold IS NOT NULL AND end_pos > start_pos) q GROUP BY 1", 500_000),
        "p2_genome_items": _items("genome", "SELECT genome AS k, max(genome_length) AS n FROM genome_lengths WHERE genome IS NOT NULL GROUP BY 1", 10_000_000),
        "p4_percentiles": _P4,
        "p5_found": _P5,
        "p7_covered": "SELECT doc_id, CAST(coalesce(length(text), 0) AS INTEGER) AS last_char FROM documents",
        "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
