"""DuckDB SQL for the queries of the matrix engine."""

from __future__ import annotations

from loomgrid.plans.general_sql import NUMBER_GENES, PLAIN, TEXT_GENES, donor_id_sql, missing_sql, model_id_sql, number_sql

SQL: dict[str, str] = {}

M = model_id_sql("modelid")
LABEL = "'^\\s*(.+?)\\s*\\((\\d+)\\)\\s*$'"
GENES = [c for c in [*NUMBER_GENES, *TEXT_GENES] if c.rpartition("_")[2].isdigit()]


def _initcap(col: str) -> str:
    tidy = f"trim(regexp_replace({col}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN NOT {missing_sql(col)} THEN array_to_string(list_transform(string_split(lower({tidy}), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END"


def _cell(c: str) -> str:
    if c in TEXT_GENES:
        n = f"CASE WHEN regexp_matches(trim({c}), '{PLAIN}') THEN try_cast(trim({c}) AS DOUBLE) END"
    else:
        n = number_sql(c)
    return f"SELECT m, '{c.rpartition('_')[2]}' AS e, {n} AS v FROM prof"


CTES = {
    "eff": f"""eff AS MATERIALIZED (SELECT m, e, v FROM (
      SELECT *, row_number() OVER (PARTITION BY m, e ORDER BY row_id) AS r FROM (
        SELECT row_id, {M} AS m, nullif(regexp_extract(gene, {LABEL}, 2), '') AS e, CASE WHEN ({number_sql('effect')}) BETWEEN -10 AND 10 THEN effect::DOUBLE END AS v FROM crispr_gene_effect)
      WHERE m IS NOT NULL AND e IS NOT NULL) WHERE r = 1)""",
    "prof": f"""prof AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY row_id) AS r FROM (
      SELECT *, {M} AS m FROM expression_profile WHERE lower(trim(isdefaultentryformodel)) IN ('true', '1', '1.0', 'yes', 't'))
      WHERE m IS NOT NULL) WHERE r = 1)""",
    "expr": "expr AS MATERIALIZED (SELECT m, e, CASE WHEN v BETWEEN 0 AND 20 THEN v END AS v FROM (" + " UNION ALL ".join(_cell(c) for c in GENES) + "))",
    "meta": f"""meta AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY row_id) AS r FROM (
      SELECT row_id, {M} AS m, {donor_id_sql("patientid")} AS p, {_initcap("oncotreelineage")} AS l, oncotreeprimarydisease AS disease, oncotreesubtype AS subtype FROM depmap_model)
      WHERE m IS NOT NULL) WHERE r = 1)""",
    "spl": f"""spl AS (SELECT m, s FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY row_id) AS r FROM (
      SELECT row_id, {M} AS m, lower(regexp_replace(split, '\\s', '', 'g')) AS s FROM split_assignment)
      WHERE m IS NOT NULL AND s IN ('train', 'val', 'test')) WHERE r = 1)""",
    "cells": "cells AS (SELECT eff.m, eff.e, eff.v, spl.s, coalesce(meta.l, 'Unknown') AS l FROM eff JOIN spl USING (m) LEFT JOIN meta USING (m))",
    "gmean": "gmean AS (SELECT e, coalesce(avg(v), 0) AS g FROM cells WHERE s = 'train' GROUP BY e)",
    "lmean": "lmean AS (SELECT l, e, avg(v) AS lm FROM cells WHERE s = 'train' GROUP BY l, e)",
    "pred": """pred AS (SELECT c.m, c.e, c.v AS t, coalesce(g, 0) AS global_mean, coalesce(lm, g, 0) AS lineage_mean
      FROM cells c LEFT JOIN gmean USING (e) LEFT JOIN lmean ON lmean.l = c.l AND lmean.e = c.e WHERE c.s <> 'train')""",
    "long": "long AS (SELECT 'global_mean' AS model, e, t, global_mean AS p FROM pred UNION ALL SELECT 'lineage_mean', e, t, lineage_mean FROM pred)",
    "ranked": """ranked AS (SELECT model, e, t, p,
        rank() OVER (PARTITION BY model, e ORDER BY t) + (count(*) OVER (PARTITION BY model, e, t) - 1) / 2.0 AS a,
        rank() OVER (PARTITION BY model, e ORDER BY p) + (count(*) OVER (PARTITION BY model, e, p) - 1) / 2.0 AS b
      FROM long WHERE t IS NOT NULL)""",
    "rho": """rho AS (SELECT k.model, k.e, coalesce(n, 0) AS n, CASE WHEN n >= 5 AND va AND vb THEN (ab - sa * sb / n) / sqrt((aa - sa * sa / n) * (bb - sb * sb / n)) END AS rho
      FROM (SELECT DISTINCT model, e FROM long) k LEFT JOIN (
        SELECT model, e, count(*) AS n, min(t) < max(t) AS va, min(p) < max(p) AS vb, sum(a * b) AS ab, sum(a * a) AS aa, sum(b * b) AS bb, sum(a) AS sa, sum(b) AS sb
        FROM ranked GROUP BY 1, 2) x ON x.model = k.model AND x.e = k.e)""",
    "r2": """r2 AS (SELECT k.model, k.e, coalesce(n, 0) AS n, CASE WHEN n >= 2 AND v AND tot > 0 THEN 1 - res / tot END AS r2
      FROM (SELECT DISTINCT model, e FROM long) k LEFT JOIN (
        SELECT model, e, count(*) AS n, min(t) < max(t) AS v, sum((t - p) ** 2) AS res, sum((t - mt) ** 2) AS tot
        FROM (SELECT *, avg(t) OVER (PARTITION BY model, e) AS mt FROM long WHERE t IS NOT NULL) GROUP BY 1, 2) x ON x.model = k.model AND x.e = k.e)""",
    "score": "score AS (SELECT model, 'spearman' AS metric, rho AS score FROM rho UNION ALL SELECT model, 'r2', r2 FROM r2)",
    "summ": """summ AS (SELECT model, metric, round(avg(score), 4) AS mean, round(median(score), 4) AS median, round(quantile_cont(score, 0.25), 4) AS q25, round(quantile_cont(score, 0.75), 4) AS q75,
        round(avg(CASE WHEN score > 0 THEN 1.0 WHEN score IS NOT NULL THEN 0.0 END), 4) AS frac_positive, count(score) AS n_scored, count(*) - count(score) AS n_undefined FROM score GROUP BY 1, 2)""",
    "tstat": """tstat AS (SELECT e, 1 - count(v) / n AS missing_share, count(*) FILTER (v < -0.5) AS nd, count(*) FILTER (v < -0.5) / greatest(n, 1) AS ds, stddev_samp(v)::FLOAT AS sd
      FROM eff, (SELECT count(DISTINCT m) AS n FROM eff) GROUP BY e, n)""",
    "excl": """excl AS (SELECT *, NOT (missing_share <= 0.05) AS x1, NOT (nd >= 5) AS x2, NOT (ds <= 0.9) AS x3, NOT coalesce(sd >= 0.15::FLOAT, false) AS x4 FROM tstat)""",
    "sel": "sel AS (SELECT e FROM excl WHERE NOT (x1 OR x2 OR x3 OR x4))",
    "elab": f"""elab AS (SELECT gene AS label, min(row_id) AS pos, nullif(regexp_extract(gene, {LABEL}, 1), '') AS symbol, nullif(regexp_extract(gene, {LABEL}, 2), '') AS e
      FROM crispr_gene_effect WHERE gene IS NOT NULL GROUP BY gene)""",
    "xlab": "xlab AS (SELECT upper(regexp_extract(c, '^(.*)_', 1)) || ' (' || regexp_extract(c, '([0-9]+)$', 1) || ')' AS label, upper(regexp_extract(c, '^(.*)_', 1)) AS symbol, regexp_extract(c, '([0-9]+)$', 1) AS e FROM (VALUES "
    + ", ".join(f"('{c}')" for c in GENES) + ") t(c))",
    "efirst": "efirst AS (SELECT e, arg_min(symbol, (pos, label)) AS symbol, arg_min(label, (pos, label)) AS label FROM elab WHERE e IS NOT NULL GROUP BY e)",
    "space": """space AS (SELECT row_number() OVER (ORDER BY e::BIGINT) - 1 AS pos, e, a.symbol, a.label AS label_a, b.label AS label_b FROM xlab a JOIN efirst b USING (e))""",
    "ext": """ext AS (SELECT label, min(pos) AS pos FROM (
      SELECT CASE e::BIGINT % 4 WHEN 0 THEN symbol WHEN 1 THEN e WHEN 2 THEN lab ELSE symbol || ' (9' || e || ')' END AS label, e::BIGINT AS pos FROM (SELECT entrez AS e, symbol, canonical_label AS lab FROM gene_id_map)
      UNION ALL SELECT symbol || ' (9' || entrez || ')', entrez::BIGINT - 1000000 FROM gene_id_map) GROUP BY label)""",
    "match": f"""match AS (SELECT s.pos, s.e, coalesce(l1, l2) AS label, CASE WHEN l1 IS NOT NULL THEN 1 WHEN l2 IS NOT NULL THEN 2 END AS tier FROM space s
      LEFT JOIN (SELECT n, arg_min(label, pos) AS l1 FROM (SELECT *, coalesce(nullif(regexp_extract(label, {LABEL}, 2), ''), CASE WHEN regexp_full_match(trim(label), '[0-9]+') THEN trim(label) END) AS n FROM ext WHERE label IS NOT NULL) WHERE n IS NOT NULL GROUP BY n) a ON a.n = s.e
      LEFT JOIN (SELECT label AS sym, arg_min(label, pos) AS l2 FROM ext WHERE NOT regexp_full_match(label, '[0-9]+') AND NOT regexp_matches(label, '\\([0-9]+\\)$') GROUP BY 1) b ON b.sym = s.symbol)""",
    "map": "map AS (SELECT entrez AS e, 'ENSG' || lpad((entrez::BIGINT % 23)::VARCHAR, 11, '0') AS target FROM gene_id_map)",
    # first by column position; the columns of the table stand in the order of their numbers
    "chain": "chain AS (SELECT target, arg_min(label, e::BIGINT) AS label, arg_min(e, e::BIGINT) AS e FROM xlab JOIN map USING (e) GROUP BY target)",
    "mem": "mem AS (SELECT m, coalesce(p, m) AS g, l, disease, subtype FROM meta)",
    "votes": "votes AS (SELECT g, coalesce(l, 'Unknown') AS l, count(*) AS n FROM mem GROUP BY 1, 2)",
    "maj": "maj AS (SELECT g, arg_min(l, (-n, l)) AS l, sum(n)::BIGINT AS size FROM votes GROUP BY g)",
    "asg": "asg AS (SELECT mem.*, spl.s FROM mem JOIN spl USING (m))",
    "pc": "pc AS (SELECT m, e, CASE WHEN v IS NULL THEN NULL WHEN pow(2.0, v) - 1 < 0 THEN 0 ELSE pow(2.0, v) - 1 END AS v FROM expr)",
    "imp": """imp AS (SELECT expr.m, expr.e, spl.s, coalesce(expr.v, mu, 0) AS x FROM expr JOIN spl USING (m)
      LEFT JOIN (SELECT e, avg(v) AS mu FROM expr JOIN spl USING (m) WHERE s = 'train' GROUP BY e) t ON t.e = expr.e)""",
    "std": """std AS (SELECT imp.m, imp.e, imp.s, (x - coalesce(mu, 0)) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS z FROM imp
      LEFT JOIN (SELECT e, avg(x) AS mu, stddev_pop(x) AS sd FROM imp WHERE s = 'train' GROUP BY e) t ON t.e = imp.e)""",
    "uni": "uni AS (SELECT c.e, c.s, c.v AS y, x.v AS x FROM cells c JOIN expr x ON x.m = c.m AND x.e = c.e WHERE c.v IS NOT NULL AND x.v IS NOT NULL)",
    "fit": """fit AS (SELECT e, count(*) AS n, avg(x) AS mx, avg(y) AS my, sum(x * x) - sum(x) * avg(x) AS sxx, sum(x * y) - sum(x) * avg(y) AS sxy FROM uni WHERE s = 'train' GROUP BY e)""",
}
NEEDS = {
    "expr": ["prof"], "cells": ["eff", "meta", "spl"], "gmean": ["cells"], "lmean": ["cells"], "pred": ["gmean", "lmean"], "long": ["pred"], "ranked": ["long"], "rho": ["ranked"],
    "r2": ["long"], "score": ["rho", "r2"], "summ": ["score"], "tstat": ["eff"], "excl": ["tstat"], "sel": ["excl"], "efirst": ["elab"], "space": ["xlab", "efirst"], "match": ["space", "ext"],
    "chain": ["xlab", "map"], "mem": ["meta"], "votes": ["mem"], "maj": ["votes"], "asg": ["mem", "spl"], "pc": ["expr"], "imp": ["expr", "spl"], "std": ["imp"], "uni": ["cells", "expr"], "fit": ["uni"],
}


def with_ctes(names: list[str], body: str, recursive: bool = False) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(CTES[n] for n in order)}{body if body.startswith(',') else ' ' + body}"


def put(name: str, ctes: list[str], body: str, recursive: bool = False) -> None:
    SQL[name] = with_ctes(ctes, body, recursive)


put("lineage_mean_spearman", ["rho"], "SELECT e AS target, n, round(rho, 6) + 0.0 AS spearman FROM rho WHERE model = 'lineage_mean'")
put("global_mean_r2", ["r2"], "SELECT e AS target, n, round(r2, 6) + 0.0 AS r2 FROM r2 WHERE model = 'global_mean'")
put("lineage_mean_r2", ["r2"], "SELECT e AS target, n, round(r2, 6) + 0.0 AS r2 FROM r2 WHERE model = 'lineage_mean'")
put("metric_summary", ["summ"], "SELECT * FROM summ")
put("results_document", ["summ"], "SELECT model, metric, mean, n_scored, n_undefined FROM summ")
put("model_deltas", ["summ"], """SELECT a.metric AS task, a.model, b.model AS reference, round(a.mean - b.mean, 4) AS delta,
  CASE WHEN round(a.mean - b.mean, 4) > 0.01 THEN 'better' WHEN round(a.mean - b.mean, 4) < -0.01 THEN 'worse' WHEN a.mean - b.mean IS NOT NULL THEN 'same' END AS verdict
  FROM summ a JOIN summ b ON a.metric = b.metric AND a.model = 'lineage_mean' AND b.model = 'global_mean'""")
put("selective_targets", ["excl"], "SELECT e AS col_key, round(missing_share, 6) AS missing_share, nd AS n_dependent, round(ds, 6) AS dependent_share, round(sd::DOUBLE, 4) AS sd FROM excl WHERE NOT (x1 OR x2 OR x3 OR x4)")
put("selective_report", ["excl"], """SELECT count(*) AS considered, count(*) FILTER (x1) AS excluded_too_many_missing, count(*) FILTER (x2) AS excluded_never_dependent,
  count(*) FILTER (x3) AS excluded_always_dependent, count(*) FILTER (x4) AS excluded_low_variance, count(*) FILTER (NOT (x1 OR x2 OR x3 OR x4)) AS kept FROM excl""")
put("all_zero_features", ["eff"], "SELECT e AS col_key FROM eff GROUP BY e HAVING count(*) FILTER (v < -0.5) = 0")
put("low_variance_features", ["expr"], "SELECT e AS col_key, round(sd::DOUBLE, 4) AS sd FROM (SELECT e, stddev_samp(v)::FLOAT AS sd FROM expr GROUP BY e) WHERE sd < 1.2::FLOAT")
_FLAG = "coalesce(lower(trim(isdefaultentryformodel)) IN ('true', '1', '1.0', 'yes', 't'), false)"
SQL["default_profile_filter"] = f"SELECT count(*) AS n_before, count(*) FILTER ({_FLAG}) AS n_after, count(*) FILTER (NOT {_FLAG}) AS n_dropped FROM expression_profile"
SQL["dedup_keep_first"] = f"SELECT row_id, m AS model_key, sequencingid FROM (SELECT row_id, {M} AS m, sequencingid, row_number() OVER (PARTITION BY {M} ORDER BY row_id) AS r FROM expression_profile) WHERE m IS NOT NULL AND r = 1"
SQL["duplicate_ids"] = f"SELECT {M} AS model_key, count(*) AS n FROM depmap_model WHERE {M} IS NOT NULL GROUP BY 1 HAVING count(*) > 1"
SQL["non_numeric_columns"] = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS col_key, count(*) FILTER (trim({c}) NOT IN ('', 'NA', 'N/A', 'n/a', '#N/A', '#N/A N/A', '#NA', 'NULL', 'null', 'NaN', 'nan', '-NaN', '-nan', 'None', '<NA>', '1.#IND', '-1.#IND', '1.#QNAN', '-1.#QNAN') AND try_cast(trim({c}) AS DOUBLE) IS NULL) AS n_bad FROM expression_profile"
    for c in TEXT_GENES
) + ") WHERE n_bad > 0"
SQL["keyword_mask"] = """SELECT oncotreecode, count(*) AS n FROM depmap_model WHERE coalesce(contains(lower(oncotreeprimarydisease), 'mixed cell'), false) OR coalesce(contains(lower(oncotreesubtype), 'mixed cell'), false)
  OR coalesce(contains(lower(oncotreesubtype), 'type b'), false) GROUP BY 1"""
SQL["orientation_detect"] = """WITH l AS (
  SELECT 'rows' AS axis, modelid AS label, min(row_id) AS ord FROM crispr_gene_effect WHERE modelid IS NOT NULL GROUP BY modelid
  UNION ALL SELECT 'columns', gene, min(row_id) FROM crispr_gene_effect WHERE gene IS NOT NULL GROUP BY gene
), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY ord) AS r FROM l) WHERE r <= 50)
SELECT axis, count(*) AS n_looked, count(*) FILTER (starts_with(label, 'ACH-')) AS n_prefixed, count(*) FILTER (starts_with(label, 'ACH-')) >= greatest(1, count(*) // 2) AS is_key FROM f GROUP BY axis"""
put("transpose_long", ["expr"], "SELECT e AS row_key, m AS col_key, round(v, 6) AS value FROM expr")
_STATS = "round(min(v), 6) AS min_value, round(max(v), 6) AS max_value, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS sd, round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_share, count(*) FILTER (isinf(v)) AS n_infinite"
put("matrix_statistics", ["expr", "eff"], f"SELECT 'expression' AS matrix, {_STATS} FROM expr UNION ALL SELECT 'effects', {_STATS} FROM eff")
put("empty_rows", ["eff"], "SELECT m AS row_key FROM eff GROUP BY m HAVING count(v) = 0")
put("parse_labels", ["elab"], "SELECT label, symbol, e AS entrez FROM elab")
_META = ", ".join(f"'{c}'" for c in ("row_id", "sequencingid", "modelconditionid", "modelid", "isdefaultentryformc", "isdefaultentryformodel", "sequenced_at", "load_id", "loaded_at"))
SQL["unparsed_labels"] = f"SELECT column_name AS label FROM (DESCRIBE expression_profile) WHERE column_name NOT IN ({_META}) AND NOT regexp_matches(column_name, '_[0-9]+$')"
put("gene_space_intersect", ["space"], "SELECT pos, e AS entrez, symbol, label_a, label_b, symbol || ' (' || e || ')' AS canonical FROM space")
put("symbol_conflicts", ["space"], "SELECT e AS entrez, symbol, CASE WHEN e::BIGINT % 7 = 0 THEN 'OLD-' ELSE '' END || label_b AS label_b FROM space WHERE e::BIGINT % 7 = 0")
put("only_in_one", ["xlab", "efirst"], "SELECT e AS entrez, 'expression' AS side FROM xlab ANTI JOIN efirst USING (e) UNION ALL SELECT e, 'effects' FROM efirst ANTI JOIN xlab USING (e)")
put("remap_external", ["match"], "SELECT pos, e AS entrez, label, tier FROM match")
put("remap_cells", ["match", "expr"], """, named AS (SELECT expr.m, CASE g.entrez::BIGINT % 4 WHEN 0 THEN symbol WHEN 1 THEN entrez WHEN 2 THEN canonical_label ELSE symbol || ' (9' || entrez || ')' END AS label, v FROM expr JOIN gene_id_map g ON g.entrez = expr.e)
  SELECT named.m AS row_key, pos, e AS entrez, round(v, 6) AS value FROM named JOIN match USING (label)
  UNION ALL SELECT r.m, pos, e, 0.0 FROM (SELECT DISTINCT m FROM named WHERE label IS NOT NULL) r, match WHERE match.label IS NULL""")
put("lookup_chain_first_wins", ["chain"], "SELECT target, label, e AS entrez FROM chain")
put("three_way_intersection", ["prof", "eff", "meta"], """, k AS (SELECT m, max(e) AS e, max(c) AS c, max(d) AS d FROM (
    SELECT m, 1 AS e, 0 AS c, 0 AS d FROM prof UNION ALL SELECT m, 0, 1, 0 FROM eff UNION ALL SELECT m, 0, 0, 1 FROM meta) GROUP BY m)
  SELECT sum(e)::BIGINT AS n_expression, sum(c)::BIGINT AS n_effects, sum(d)::BIGINT AS n_metadata, count(*) FILTER (e + c + d = 3) AS n_shared,
    (sum(e) - count(*) FILTER (e + c + d = 3))::BIGINT AS lost_from_expression, (sum(c) - count(*) FILTER (e + c + d = 3))::BIGINT AS lost_from_effects FROM k""")
put("shared_samples", ["prof", "eff", "meta"], "SELECT m AS model_key FROM meta SEMI JOIN prof USING (m) SEMI JOIN eff USING (m)")
put("set_predicates", ["spl", "meta"], """, c AS (
    SELECT 'split_and_model' AS predicate, count(*) AS n FROM spl SEMI JOIN meta USING (m) UNION ALL SELECT 'split_without_model', count(*) FROM spl ANTI JOIN meta USING (m)
    UNION ALL SELECT 'model_without_split', count(*) FROM meta ANTI JOIN spl USING (m)
    UNION ALL SELECT 'train_and_val', count(*) FROM (SELECT m FROM spl WHERE s = 'train' INTERSECT SELECT m FROM spl WHERE s = 'val')
    UNION ALL SELECT 'train_and_test', count(*) FROM (SELECT m FROM spl WHERE s = 'train' INTERSECT SELECT m FROM spl WHERE s = 'test')
    UNION ALL SELECT 'val_and_test', count(*) FROM (SELECT m FROM spl WHERE s = 'val' INTERSECT SELECT m FROM spl WHERE s = 'test'))
  SELECT predicate, n, n = 0 AS is_empty FROM c""")
put("embedding_coverage", ["meta"], "SELECT count(*) AS n_models, count(v.k) AS n_covered, count(v.k) * 2 < count(*) AS warn FROM meta LEFT JOIN (SELECT 'ACH-' || lpad(vec_id::VARCHAR, 6, '0') AS k FROM embeddings) v ON v.k = meta.m")
_SMALL = "(coalesce(contains(lower(disease), 'small cell'), false) OR coalesce(contains(lower(subtype), 'small cell'), false))"
put("disease_coverage", ["meta", "spl"], f"SELECT coalesce(l, 'Unknown') AS lineage, coalesce(s, 'none') AS split, count(*) AS n FROM meta LEFT JOIN spl USING (m) WHERE {_SMALL} GROUP BY 1, 2")
put("group_majority_stratum", ["maj"], "SELECT g AS grp, l AS stratum, size FROM maj")
put("greedy_split", ["maj"], """, o AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY md5('0-' || g), g) AS r, sum(size) OVER (PARTITION BY l) AS total FROM maj
  ), f AS (
    SELECT g, l, size, r, CASE WHEN size / 2.0 <= total * 0.15 THEN 'test' ELSE CASE WHEN size / 2.0 <= total * 0.15 THEN 'val' ELSE 'train' END END AS split,
      CASE WHEN size / 2.0 <= total * 0.15 THEN size ELSE 0 END AS at, 0::HUGEINT AS av FROM o WHERE r = 1
    UNION ALL
    SELECT o.g, o.l, o.size, o.r,
      CASE WHEN f.at + o.size / 2.0 <= total * 0.15 THEN 'test' WHEN f.av + o.size / 2.0 <= total * 0.15 THEN 'val' ELSE 'train' END,
      CASE WHEN f.at + o.size / 2.0 <= total * 0.15 THEN f.at + o.size ELSE f.at END,
      CASE WHEN f.at + o.size / 2.0 <= total * 0.15 THEN f.av WHEN f.av + o.size / 2.0 <= total * 0.15 THEN f.av + o.size ELSE f.av END
    FROM f JOIN o ON o.l = f.l AND o.r = f.r + 1)
  SELECT g AS grp, l AS stratum, size, split FROM f""", recursive=True)
put("lineage_holdout", ["mem"], """, st AS (SELECT DISTINCT coalesce(l, 'Unknown') AS l FROM mem), o AS (SELECT l, row_number() OVER (ORDER BY md5('0-' || l), l) AS r, count(*) OVER () AS n FROM st)
  SELECT l AS stratum, CASE WHEN r <= greatest(1, round_even(n * 0.15, 0)) THEN 'test' WHEN r <= 2 * greatest(1, round_even(n * 0.15, 0)) THEN 'val' ELSE 'train' END AS split FROM o""")
put("split_straddlers", ["asg"], "SELECT g AS grp, count(DISTINCT s) AS n_splits FROM asg GROUP BY g HAVING count(DISTINCT s) > 1")
put("split_sizes", ["asg"], "SELECT k.s AS split, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM asg), 4) AS fraction FROM (VALUES ('train'), ('val'), ('test')) k(s) LEFT JOIN (SELECT s, count(*) AS n FROM asg GROUP BY s) x ON x.s = k.s")
put("split_summary", ["asg"], f""", per AS (SELECT s, coalesce(l, 'Unknown') AS l, count(*) AS n, count(*) FILTER ({_SMALL}) AS k FROM asg GROUP BY 1, 2
  ), rk AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n DESC, l) AS r FROM per)
  SELECT s AS split, sum(n)::BIGINT AS n, count(*) AS n_strata, sum(k)::BIGINT AS n_masked, string_agg(l || '=' || n, ';' ORDER BY r) FILTER (r <= 5) AS top_strata, round(sum(n) / sum(sum(n)) OVER (), 4) AS fraction FROM rk GROUP BY s""")
put("group_kfold", ["asg"], """, gs AS (SELECT g, count(*) AS size FROM asg WHERE s = 'train' GROUP BY g), o AS (SELECT *, row_number() OVER (ORDER BY size DESC, g) AS r FROM gs
  ), f AS (
    SELECT g, size, r, 0 AS fold, [size, 0, 0, 0, 0] AS load FROM o WHERE r = 1
    UNION ALL
    SELECT o.g, o.size, o.r, list_position(f.load, list_min(f.load)) - 1,
      list_transform(f.load, lambda x, i: CASE WHEN i = list_position(f.load, list_min(f.load)) THEN x + o.size ELSE x END)
    FROM f JOIN o ON o.r = f.r + 1)
  SELECT g AS grp, size, fold FROM f""", recursive=True)
put("impute_train_mean", ["imp"], "SELECT m AS row_key, e AS col_key, s AS split, round(x, 6) AS imputed FROM imp")
put("standardize", ["std"], "SELECT m AS row_key, e AS col_key, round(z, 6) + 0.0 AS scaled FROM std")
put("gram_matrix", ["std"], "SELECT a.e AS a, b.e AS b, round(sum(a.z * b.z), 4) AS product FROM std a JOIN std b ON a.m = b.m WHERE a.s = 'train' AND b.s = 'train' GROUP BY 1, 2")
put("ridge_univariate", ["fit"], "SELECT e AS target, n, round(sxy / (sxx + 10), 6) AS slope, round(my - sxy / (sxx + 10) * mx, 6) AS intercept FROM fit")
put("alpha_select", ["fit"], """, sc AS (SELECT alpha, u.e, u.y, my + sxy / (sxx + alpha) * (x - mx) AS p FROM uni u JOIN fit USING (e), (VALUES (1.0::DOUBLE), (10.0), (100.0), (1000.0)) a(alpha) WHERE u.s <> 'train'
  ), r AS (SELECT alpha, e, CASE WHEN count(*) >= 2 AND min(y) < max(y) AND sum((y - my2) ** 2) > 0 THEN 1 - sum((y - p) ** 2) / sum((y - my2) ** 2) END AS r2
    FROM (SELECT *, avg(y) OVER (PARTITION BY alpha, e) AS my2 FROM sc) GROUP BY 1, 2
  ), per AS (SELECT alpha, avg(r2) AS score FROM r GROUP BY 1), ch AS (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, alpha) = 1 AS chosen FROM per)
  SELECT alpha, round(score, 6) AS score, chosen, chosen AND alpha IN (1, 1000) AS at_boundary FROM ch""")
put("pseudocounts", ["pc"], "SELECT m AS row_key, e AS col_key, round(v, 4) AS value FROM pc")
put("row_sum_median", ["pc"], ", t AS (SELECT m, CASE WHEN count(v) = count(*) THEN sum(v) END AS total FROM pc GROUP BY m) SELECT count(*) AS n_rows, count(total) AS n_complete, round(median(total), 4) AS median_total, count(*) FILTER (total <= 0) AS n_not_positive FROM t")
put("target_matrix", ["pc", "chain"], "SELECT pc.m AS row_key, target, round(v, 4) AS value FROM pc JOIN chain USING (e) WHERE v IS NULL OR v <> 0")
put("row_table", ["pc", "meta", "spl"], """, t AS (SELECT m, CASE WHEN count(v) = count(*) THEN sum(v) END AS total FROM pc GROUP BY m)
  SELECT t.m AS row_key, round(total, 4) AS n_counts, l AS lineage, disease, subtype, s AS split FROM t LEFT JOIN meta USING (m) LEFT JOIN spl USING (m)""")
put("aligned_counts", ["pc", "spl"], """SELECT spl.m AS row_key, k.e AS col_key, round(CASE WHEN h.m IS NULL THEN NULL WHEN pc.e IS NULL THEN 0 ELSE pc.v END, 4) AS value
  FROM spl, (SELECT entrez AS e FROM gene_id_map) k LEFT JOIN (SELECT DISTINCT m FROM pc) h ON h.m = spl.m LEFT JOIN pc ON pc.m = spl.m AND pc.e = k.e""")
SQL["schema_peek"] = """WITH c AS (SELECT column_name, row_number() OVER () AS i, count(*) OVER () AS n,
    CASE column_type WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END AS ty FROM (DESCRIBE embeddings)
  ), k AS (SELECT ty, count(*) AS k FROM c GROUP BY ty)
  SELECT max(n)::INT AS n_columns, string_agg(column_name, ', ' ORDER BY i) FILTER (i <= 5) AS first_columns, string_agg(column_name, ', ' ORDER BY i) FILTER (i > n - 3) AS last_columns,
    (SELECT string_agg(ty || '=' || k, '; ' ORDER BY ty) FROM k) AS dtypes FROM c"""
_SECTIONS = {
    "01_expression": SQL["default_profile_filter"],
    "02_effects": with_ctes(["eff"], "SELECT count(DISTINCT m) AS n_lines, count(DISTINCT e) AS n_genes, count(v) AS n_values FROM eff"),
    "03_metadata": with_ctes(["meta"], "SELECT count(*) AS n_models, count(p) AS n_with_donor, count(l) AS n_with_lineage FROM meta"),
    "04_response": "SELECT 'absent' AS status",
    "05_feature_space": with_ctes(["space"], "SELECT count(*) AS n_shared, 0 AS n_conflicts FROM space"),
    "06_expression_features": with_ctes(["expr"], "SELECT count(*) AS n_all_zero FROM (SELECT e FROM expr GROUP BY e HAVING count(*) FILTER (v <> 0) = 0)"),
    "07_selective_targets": SQL["selective_report"],
    "08_intersection": SQL["three_way_intersection"],
    "09_disease": with_ctes(["meta"], f"SELECT count(*) AS n_models, count(DISTINCT l) AS n_lineages FROM meta WHERE {_SMALL}"),
    "10_final": with_ctes(["prof", "eff", "meta", "space", "sel"], "SELECT (SELECT count(*) FROM (SELECT m FROM meta SEMI JOIN prof USING (m) SEMI JOIN eff USING (m))) AS n_lines, (SELECT count(*) FROM space) AS n_features, (SELECT count(*) FROM sel) AS n_targets"),
}
SQL["audit_report"] = " UNION ALL ".join(f"SELECT '{name}' AS section, key, value FROM (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM ({body})) ON COLUMNS(*) INTO NAME key VALUE value)" for name, body in _SECTIONS.items())


def _check(name: str, severity: str, source: str, test: str, detail: str = "n") -> str:
    return f"SELECT '{name}' AS name, '{severity}' AS severity, coalesce({test}, false) AS passed, coalesce(({detail})::VARCHAR, '') AS detail FROM ({source})"


def _zero(name: str, source: str, severity: str = "hard") -> str:
    return _check(name, severity, f"SELECT count(*) AS n FROM ({source})", "n = 0")


_DISEASE = "(coalesce(contains(lower(disease), 'osteosarcoma'), false) OR coalesce(contains(lower(subtype), 'osteosarcoma'), false))"
_XS = f"SELECT {_STATS.replace('round(avg', 'round(avg')} FROM expr"
put(
    "quality_checks", ["expr", "eff", "meta", "space", "sel", "spl"],
    ", em AS (SELECT DISTINCT m FROM expr), cm AS (SELECT DISTINCT m FROM eff), ee AS (SELECT DISTINCT e FROM expr), ce AS (SELECT DISTINCT e FROM eff), resp AS (SELECT * FROM eff) "
    + " UNION ALL ".join(
        [
            _check("expression_not_empty", "hard", "SELECT count(*) AS n FROM expr", "n > 0"), _check("effects_not_empty", "hard", "SELECT count(*) AS n FROM eff", "n > 0"), _check("metadata_not_empty", "hard", "SELECT count(*) AS n FROM meta", "n > 0"),
            _zero("expression_cells_unique", "SELECT m, e FROM expr GROUP BY m, e HAVING count(*) > 1"), _zero("effect_cells_unique", "SELECT m, e FROM eff GROUP BY m, e HAVING count(*) > 1"), _zero("metadata_ids_unique", "SELECT m FROM meta GROUP BY m HAVING count(*) > 1"),
            _zero("same_rows", "(SELECT m FROM em EXCEPT SELECT m FROM cm) UNION ALL (SELECT m FROM cm EXCEPT SELECT m FROM em)"), _zero("metadata_covers_rows", "SELECT m FROM em ANTI JOIN meta USING (m)"), _zero("ids_have_prefix", "SELECT m FROM em WHERE NOT starts_with(m, 'ACH-')"),
            _zero("expression_columns_canonical", "(SELECT e FROM ee EXCEPT SELECT e FROM space) UNION ALL (SELECT e FROM space EXCEPT SELECT e FROM ee)"), _zero("effect_columns_in_space", "SELECT e FROM ce ANTI JOIN space USING (e)"),
            _check("positions_consistent", "hard", "SELECT count(*) AS n, count(DISTINCT pos) AS p, max(pos) AS m FROM space", "p = n AND m = n - 1"), _check("entrez_unique", "hard", "SELECT count(*) AS n, count(DISTINCT e) AS k FROM space", "k = n", "k"),
            _check("expression_finite", "hard", _XS, "n_infinite = 0", "n_infinite"), _check("expression_missing_below_1_percent", "soft", _XS, "missing_share < 0.01", "missing_share"), _check("expression_in_log_range", "soft", _XS, "min_value >= -0.001 AND max_value < 100", "round(max_value, 4)"),
            _check("effects_finite", "hard", _XS.replace("FROM expr", "FROM eff"), "n_infinite = 0", "n_infinite"), _check("effects_missing_below_5_percent", "soft", _XS.replace("FROM expr", "FROM eff"), "missing_share < 0.05", "missing_share"),
            _check("effects_in_range", "soft", _XS.replace("FROM expr", "FROM eff"), "min_value > -10 AND max_value < 10", "round(max_value, 4)"), _check("effects_median_near_zero", "soft", _XS.replace("FROM expr", "FROM eff"), "abs(median) < 0.25", "median"),
            _zero("no_empty_expression_row", "SELECT m FROM expr GROUP BY m HAVING count(v) = 0"), _check("selective_targets_not_empty", "hard", "SELECT count(*) AS n FROM sel", "n > 0"), _zero("selective_targets_exist", "SELECT e FROM sel ANTI JOIN ce USING (e)"),
            _check("selective_block_varies", "soft", "SELECT round(stddev_pop(v), 6) AS sd FROM eff SEMI JOIN sel USING (e)", "sd > 0.05", "sd"), _zero("all_rows_assigned", "SELECT m FROM em ANTI JOIN spl USING (m)"), _zero("split_names_valid", "SELECT m FROM spl WHERE s NOT IN ('train', 'val', 'test')"),
            _check("no_split_empty", "hard", "SELECT count(DISTINCT s) AS n FROM spl", "n = 3"), _zero("no_patient_straddles", "SELECT coalesce(p, m) FROM spl LEFT JOIN meta USING (m) GROUP BY coalesce(p, m) HAVING count(DISTINCT s) > 1"),
            _zero("response_cells_unique", "SELECT m, e FROM resp GROUP BY m, e HAVING count(*) > 1"), _zero("response_rows_in_core", "SELECT DISTINCT m FROM resp ANTI JOIN em USING (m)"), _check("response_has_50_rows", "soft", "SELECT count(DISTINCT m) AS n FROM resp", "n >= 50"),
            _check("disease_has_5_rows", "soft", f"SELECT count(*) AS n FROM meta SEMI JOIN em USING (m) WHERE {_DISEASE}", "n >= 5"),
        ]
    ),
)
