"""DuckDB SQL for the queries over raw files and artifacts."""

from __future__ import annotations

from loomgrid import config
from loomgrid.plans.general_sql import NUMBER_GENES, TEXT_GENES, missing_sql, number_sql
from loomgrid.plans.reference_sql import SQL as REFERENCE
from loomgrid.plans.reference_sql import with_ctes

SQL: dict[str, str] = {}
_NA = ", ".join(f"'{t}'" for t in config.NA_TOKENS)


def _known(col: str) -> str:
    return f"CASE WHEN {col} NOT IN ({_NA}) THEN {col} END"


def _label(c: str) -> str:
    symbol, _, n = c.rpartition("_")
    return f"{symbol.upper()} ({n})" if n.isdigit() else c


def put(name: str, ctes: list[str], body: str, recursive: bool = False) -> None:
    SQL[name] = with_ctes(ctes, body, recursive)


_FLAGGED = "lower(trim(isdefaultentryformodel)) IN ('true', '1', '1.0', 'yes', 't')"
_FIRST = f"f AS MATERIALIZED (SELECT * FROM (SELECT *, {_known('trim(modelid)')} AS k, row_number() OVER (PARTITION BY trim(modelid) ORDER BY row_id) AS r FROM expression_profile WHERE {_FLAGGED}) WHERE r = 1 AND k IS NOT NULL)"
_CELLS = [f"SELECT k AS row_key, '{_label(c)}' AS col_key, round(({number_sql(c)})::FLOAT::DOUBLE, 4) AS value FROM f" for c in NUMBER_GENES] + [
    f"SELECT k, '{_label(c)}', round(try_cast(trim({c}) AS FLOAT)::DOUBLE, 4) FROM f WHERE (SELECT count(*) FROM expression_profile WHERE trim({c}) NOT IN ({_NA}) AND try_cast(trim({c}) AS DOUBLE) IS NULL) = 0" for c in TEXT_GENES
]
SQL["ingest_expression"] = f"WITH {_FIRST} " + " UNION ALL ".join(_CELLS)
_WIDE = "(SELECT k.m, g.canonical_label AS lab, eff.v FROM (SELECT DISTINCT m FROM eff) k, gene_id_map g LEFT JOIN eff ON eff.m = k.m AND eff.e = g.entrez)"
put("ingest_effects", ["eff"], f"SELECT m AS row_key, lab AS col_key, round(v::FLOAT::DOUBLE, 4) AS value FROM {_WIDE}")
put("ingest_first_lines", ["eff"], f", h AS (SELECT DISTINCT m FROM eff ORDER BY m LIMIT 100) SELECT count(DISTINCT m) AS n_rows, max(m) AS last_row, count(v) AS n_values, (SELECT count(*) FROM gene_id_map)::INT AS n_columns FROM {_WIDE} SEMI JOIN h USING (m)")
SQL["ingest_metadata"] = f"""SELECT k AS model, {_known('patientid')} AS patient, {_known('oncotreelineage')} AS lineage, age, 'PediatricModelType' AS missing_columns
  FROM (SELECT *, {_known('modelid')} AS k, row_number() OVER (PARTITION BY modelid ORDER BY row_id) AS r FROM depmap_model) WHERE r = 1 AND k IS NOT NULL"""
put("ingest_response", ["eff"], """SELECT 'present' AS status, true AS transposed, count(DISTINCT m) AS n_lines, count(DISTINCT e) AS n_compounds, count(v) AS n_values, round(sum(v), 2) AS total FROM eff
  UNION ALL SELECT 'absent', NULL, NULL, NULL, NULL, NULL""")
put("ingest_counts", ["pc", "spl"], """SELECT k.e AS col_key, count(*) AS n, count(CASE WHEN h.m IS NULL THEN NULL WHEN pc.e IS NULL THEN 0 ELSE pc.v END) AS n_known, count(*) FILTER (pc.v > 0) AS n_positive
  FROM spl, (SELECT entrez AS e FROM gene_id_map) k LEFT JOIN (SELECT DISTINCT m FROM pc) h ON h.m = spl.m LEFT JOIN pc ON pc.m = spl.m AND pc.e = k.e GROUP BY 1""")
put("cached_map", ["map"], "SELECT e AS entrez, target FROM map")
put("saved_matrix", ["expr"], "SELECT m AS row_key, e AS col_key, round(v::FLOAT::DOUBLE, 4) AS value FROM expr")
put("saved_table", ["meta"], ", k AS (SELECT l AS lineage, count(*) AS n FROM meta GROUP BY 1) SELECT form, lineage, n FROM k, (VALUES ('csv'), ('parquet')) f(form)")
put("gene_socket", ["space"], "SELECT (SELECT count(*) FROM space) AS n_genes, pos, e AS entrez, symbol, symbol || ' (' || e || ')' AS canonical FROM space")
put("saved_components", ["pc"], "SELECT 'X' AS part, count(*) FILTER (v <> 0) AS n FROM pc UNION ALL SELECT 'obs', count(DISTINCT m) FROM pc UNION ALL SELECT 'var', count(DISTINCT e) FROM pc")
SQL["saved_embeddings"] = "SELECT 'ACH-' || lpad(vec_id::VARCHAR, 6, '0') AS row_key, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 3) AS total FROM embeddings"
put("canonical_matrix", ["expr", "space"], "SELECT expr.m AS row_key, pos, symbol || ' (' || e || ')' AS canonical, round(v, 6) AS value FROM expr JOIN space USING (e)")
put("ordered_equality", ["space"], "SELECT count(*) AS n, count(*) FILTER (label_a IS DISTINCT FROM label_b) AS n_apart, count(*) FILTER (label_a IS DISTINCT FROM label_b) = 0 AS equal FROM space")
SQL["concat_by_position"] = """SELECT split, sex AS sex_raw, count(*) AS n FROM (SELECT split, row_number() OVER (ORDER BY row_id) AS r FROM split_assignment) a
  JOIN (SELECT sex, row_number() OVER (ORDER BY row_id) AS r FROM depmap_model) b USING (r) WHERE split IS NOT NULL AND sex IS NOT NULL GROUP BY ALL"""
put("straddle_examples", ["asg"], ", t AS (SELECT g FROM asg GROUP BY g HAVING count(DISTINCT s) > 1) SELECT (SELECT count(*) FROM t) AS n, (SELECT string_agg(g, ', ' ORDER BY g) FROM (SELECT g FROM t ORDER BY g LIMIT 5)) AS examples")
put("conflict_examples", ["elab"], ", t AS (SELECT e FROM elab WHERE e IS NOT NULL GROUP BY e HAVING count(*) > 1) SELECT (SELECT count(*) FROM t) AS n, (SELECT string_agg(e, ', ' ORDER BY e) FROM (SELECT e FROM t ORDER BY e LIMIT 10)) AS examples")
put("complete_models", ["meta"], f"SELECT m AS model_id, p AS patient_id, l AS lineage FROM meta WHERE p IS NOT NULL AND l IS NOT NULL AND NOT {missing_sql('disease')}")
put("task_sizes", ["eff", "prof", "spl"], """, b AS (SELECT DISTINCT m FROM eff SEMI JOIN prof USING (m)), c AS (SELECT count(*) FILTER (s = 'train') AS t, count(*) FILTER (s = 'val') AS v FROM b JOIN spl USING (m))
  SELECT 'crispr' AS task, t AS n_train, v AS n_eval, t >= 10 AND v >= 5 AS available FROM c UNION ALL SELECT 'prism', 0, 0, false""")
SQL["saved_splits"] = REFERENCE["greedy_split"].replace("SELECT g AS grp, l AS stratum, size, split FROM f", "SELECT m AS model_id, split FROM mem JOIN f USING (g)")
