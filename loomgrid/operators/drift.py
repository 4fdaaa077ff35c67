"""Schemas that drift between the files of a producer's series."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrid.sources.staging import stage


def explode_records(raw: DataFrame) -> DataFrame:
    """One row per record and field: ``series, seq, file_name, raw_id, field_name, json_type, value``.

    ``json_type`` is string, number, boolean, object or array, NULL for a JSON
    null; ``value`` is the scalar as text, for an object or array its JSON.
    Texts that are no JSON object (NULL, broken, repeated keys) have no fields.
    """
    parsed = raw.select("series", "seq", "file_name", "raw_id", F.try_parse_json("record_text").alias("_v"))
    fields = raw.sparkSession.tvf.variant_explode(F.col("_v").outer())
    kind = F.schema_of_variant("value")
    json_type = (
        F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array").when(kind != "VOID", "number")
    )
    return parsed.lateralJoin(fields).filter(F.col("key").isNotNull()).select(
        "series", "seq", "file_name", "raw_id", F.col("key").alias("field_name"), json_type.alias("json_type"), F.col("value").cast("string").alias("value")
    )


def comparable(value: Column, json_type: Column) -> Column:
    """The value as a text that survives a change of type: an object counts as its first text, truth as 1 or 0."""
    inner = F.regexp_extract(value, r'"[^"]*":\s*"([^"]*)"', 1)
    text = F.lower(F.trim(F.when(json_type == "object", inner).otherwise(value)))
    text = F.when(text.isin("true", "yes", "t", "y"), "1").when(text.isin("false", "no", "f", "n"), "0").otherwise(text)
    return F.when(text != "", F.regexp_replace(text, r"^([+-]?[0-9]+)\.0+$", "$1"))


@dataclass
class Drift:
    """``fields``: exploded records with ``idx``, the file's place in its series; ``catalogue``: per file and
    field its JSON types; ``changes``: ``series, seq, file_name, field_name, change_kind, old_name``;
    ``records``: every record with ``unreadable``, true if its text is no JSON object."""

    records: DataFrame
    fields: DataFrame
    catalogue: DataFrame
    changes: DataFrame


#: A type's bit in the catalogue.
TYPES = ["array", "boolean", "number", "object", "string"]


def _catalogue(fields: DataFrame) -> DataFrame:
    """Per file and field: records, types in order, and about how many values; combined before the shuffle, so no value travels."""
    bit = F.lit(0)
    for i, name in enumerate(TYPES):
        bit = F.when(F.col("json_type") == name, 1 << i).otherwise(bit)
    packed = fields.groupBy("series", "idx", "seq", "file_name", "last_idx", "field_name").agg(
        F.count("*").alias("n_records"), F.bit_or(bit).alias("_bits"), F.approx_count_distinct("comp", 0.02).alias("n_about")
    )
    types = F.array_compact(F.array(*[F.when(F.col("_bits").bitwiseAND(1 << i) > 0, F.lit(name)) for i, name in enumerate(TYPES)]))
    return packed.withColumn("types", types).drop("_bits")


def schema_drift(raw: DataFrame, agreement: float = 0.95, normal: Callable[[Column], Column] | None = None) -> Drift:
    """Changes of each file against the file before it in its series.

    ``raw`` has ``raw_id, series, seq, file_name, record_text``.  The order of
    files is ``seq``, not arrival.  A field is in a file if any record has its
    key, null or not.  Lifespans are islands of consecutive files; their starts
    are ``added``, the files after their ends ``removed``.  Where a field ends
    and another starts in the same step, they are one field ``renamed`` if their
    values agree for at least ``agreement`` of the records in both files; each
    name takes part in one renaming.  ``normal`` makes one text of the spellings
    of a value that count as equal.  Records are matched by the best shared
    identifying field, which may itself be renamed.  ``retyped``: a JSON type
    that the field did not have in the file before (a file with nothing but
    nulls keeps the types seen last).  An empty table has no changes.

    The catalogue is made of names and types alone.  Values are read only of
    files on either side of a step in which one field ends and another starts,
    and of those only of these fields and of fields that may tell records apart.
    """
    normal = normal or (lambda c: c)
    files = raw.select("series", "seq", "file_name").distinct()
    by_series = W.partitionBy("series").orderBy("seq", "file_name")
    # one row per file, so that a series' window stays as small as its chain of files
    files = files.withColumn("idx", F.row_number().over(by_series)).withColumn("last_idx", F.count("*").over(W.partitionBy("series")))
    files = stage(files, "files")
    placed = lambda which: raw.join(which, ["series", "seq", "file_name"])
    exploded = lambda rows: explode_records(rows).withColumn("comp", comparable(F.col("value"), F.col("json_type"))).join(files, ["series", "seq", "file_name"])
    fields = exploded(raw)
    catalogue = stage(_catalogue(fields), "catalogue")
    life = W.partitionBy("series", "field_name").orderBy("idx")
    spans = (
        catalogue.withColumn("starts", (F.col("idx") > 1) & (F.coalesce(F.lag("idx").over(life), F.lit(0)) != F.col("idx") - 1))
        .withColumn("ends", (F.col("idx") < F.col("last_idx")) & (F.coalesce(F.lead("idx").over(life), F.lit(0)) != F.col("idx") + 1))
        .withColumn("island", F.col("idx") - F.row_number().over(life))
    )
    seen = F.when(F.size("types") > 0, F.col("types"))
    within = W.partitionBy("series", "field_name", "island").orderBy("idx")
    spans = spans.withColumn("prev_types", F.last(seen, ignorenulls=True).over(within.rowsBetween(W.unboundedPreceding, -1)))
    spans = spans.withColumn("last_types", F.last(seen, ignorenulls=True).over(within.rowsBetween(W.unboundedPreceding, W.currentRow)))

    started = spans.filter("starts").select("series", "idx", F.col("field_name").alias("new_name"), F.col("types").alias("new_types"))
    ended = spans.filter("ends").select("series", (F.col("idx") + 1).alias("idx"), F.col("field_name").alias("old_name"), F.col("last_types").alias("old_types"))
    steps = stage(started.join(ended, ["series", "idx"]), "steps")
    at = ["series", "idx"]
    at_steps = steps.select(*at).distinct()

    def telling(step: int) -> DataFrame:
        """Fields of one side of a step that may tell its records apart."""
        own = catalogue.select("series", (F.col("idx") + step).alias("idx"), "field_name", "n_about").join(at_steps, at, "left_semi")
        return own.withColumn("_most", F.max("n_about").over(W.partitionBy(*at))).filter(F.col("n_about") >= 0.7 * F.col("_most")).select(*at, "field_name")

    wanted = telling(1).unionByName(steps.select(*at, F.col("old_name").alias("field_name"))).distinct().withColumn("side", F.lit("old"))
    wanted = wanted.unionByName(telling(0).unionByName(steps.select(*at, F.col("new_name").alias("field_name"))).distinct().withColumn("side", F.lit("new")))
    # a file may be the new one of a step and the old one of the next
    wanted = wanted.withColumn("step", F.col("idx")).withColumn("idx", F.when(F.col("side") == "old", F.col("idx") - 1).otherwise(F.col("idx")))
    needed = files.join(wanted.select("series", "idx").distinct(), ["series", "idx"], "left_semi").select("series", "seq", "file_name")
    of_steps = explode_records(placed(needed)).withColumn("comp", comparable(F.col("value"), F.col("json_type"))).filter("comp is not null")
    of_steps = of_steps.join(files.select("series", "seq", "file_name", "idx"), ["series", "seq", "file_name"]).join(wanted, ["series", "idx", "field_name"])
    values = stage(of_steps.select("series", F.col("step").alias("idx"), "side", "field_name", "raw_id", "comp"), "values")

    def side(which: str) -> DataFrame:
        return values.filter(F.col("side") == which).select(*at, F.col("field_name").alias(f"{which}_field"), "raw_id", "comp")

    old, new = side("old"), side("new")

    def identifying(which: str, own: DataFrame) -> DataFrame:
        """Distinct values of the fields with nearly as many as any."""
        each = own.select(*at, f"{which}_field", "comp").distinct()
        counted = each.groupBy(*at, f"{which}_field").agg(F.count("*").alias(f"{which}_distinct"))
        best = counted.withColumn("_most", F.max(f"{which}_distinct").over(W.partitionBy(*at))).filter(F.col(f"{which}_distinct") >= 0.8 * F.col("_most")).drop("_most")
        return each.join(best, [*at, f"{which}_field"])

    shared = (
        identifying("old", old).join(identifying("new", new), [*at, "comp"])
        .groupBy(*at, "old_field", "new_field").agg(F.count("*").alias("n"), (F.max("old_distinct") + F.max("new_distinct")).alias("distinct"))
    )
    # of the pairs that share most values, the one that tells most records apart
    shared = shared.withColumn("_most", F.max("n").over(W.partitionBy(*at))).filter(F.col("n") >= 0.8 * F.col("_most"))
    best = W.partitionBy(*at).orderBy(F.desc("distinct"), F.desc("n"), F.desc(F.col("old_field") == F.col("new_field")), "old_field", "new_field")
    link = stage(shared.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select(*at, "old_field", "new_field"), "link")
    old_keys = old.join(link.select(*at, "old_field"), [*at, "old_field"]).select(*at, "raw_id", F.col("comp").alias("record_key"))
    new_keys = new.join(link.select(*at, "new_field"), [*at, "new_field"]).select(*at, "raw_id", F.col("comp").alias("record_key"))

    def keyed(values: DataFrame, keys: DataFrame, names: DataFrame, which: str) -> DataFrame:
        """Values of candidate fields by record key; a record that comes twice counts once."""
        own = values.join(names.select(*at, F.col(f"{which}_name").alias(f"{which}_field")).distinct(), [*at, f"{which}_field"], "left_semi")
        return own.join(keys, [*at, "raw_id"]).groupBy(*at, "record_key", F.col(f"{which}_field").alias(f"{which}_name")).agg(F.min("comp").alias(f"{which}_value"))

    pairs = keyed(old, old_keys, steps, "old").join(keyed(new, new_keys, steps, "new"), [*at, "record_key"])
    same = normal(F.col("old_value")) == normal(F.col("new_value"))
    scored = pairs.groupBy(*at, "old_name", "new_name").agg(F.avg(same.cast("int")).alias("agree"), F.count("*").alias("n")).filter(F.col("agree") >= agreement)
    order = [F.desc("agree"), F.desc("n"), "old_name", "new_name"]
    for name in ("old_name", "new_name"):
        scored = scored.withColumn("_r", F.row_number().over(W.partitionBy(*at, name).orderBy(*order))).filter("_r = 1").drop("_r")
    renamed = stage(steps.join(scored.select(*at, "old_name", "new_name"), [*at, "old_name", "new_name"]), "renamed")

    none = F.lit(None).cast("string")
    news = lambda now, before: F.size(F.array_except(now, before)) > 0
    added = started.join(renamed.select(*at, "new_name"), [*at, "new_name"], "left_anti").select(*at, F.col("new_name").alias("field_name"), F.lit("added").alias("change_kind"), none.alias("old_name"))
    removed = ended.join(renamed.select(*at, "old_name"), [*at, "old_name"], "left_anti").select(*at, F.col("old_name").alias("field_name"), F.lit("removed").alias("change_kind"), none.alias("old_name"))
    renames = renamed.select(*at, F.col("new_name").alias("field_name"), F.lit("renamed").alias("change_kind"), "old_name")
    retyped = spans.filter(news(F.col("types"), F.col("prev_types"))).select(*at, "field_name", F.lit("retyped").alias("change_kind"), none.alias("old_name"))
    retyped_too = renamed.filter(news(F.col("new_types"), F.col("old_types"))).select(*at, F.col("new_name").alias("field_name"), F.lit("retyped").alias("change_kind"), none.alias("old_name"))
    changes = added.unionByName(removed).unionByName(renames).unionByName(retyped).unionByName(retyped_too)
    changes = changes.join(files.select("series", "idx", "seq", "file_name"), at).select("series", "seq", "file_name", "field_name", "change_kind", "old_name")
    is_object = F.schema_of_variant(F.try_parse_json("record_text")).startswith("OBJECT")
    records = raw.select("raw_id", "series", "seq", "file_name", (~F.coalesce(is_object, F.lit(False))).alias("unreadable"))
    return Drift(records, fields, catalogue, changes)


@dataclass(frozen=True)
class Alias:
    canonical: str
    json_type: str
    names: tuple[str, ...]


def alias_table(drift: Drift) -> list[Alias]:
    """Names that renamings tie together, under the one that most files use, with the type most files have.

    Works on names and types only, which are few however long the files are.
    """
    uses, types = Counter(), {}
    for r in drift.catalogue.groupBy("field_name", "types").agg(F.count("*").alias("n")).collect():
        uses[r["field_name"]] += r["n"]
        for t in r["types"]:
            types.setdefault(r["field_name"], Counter())[t] += r["n"]
    parent = {name: name for name in uses}

    def root(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r in drift.changes.filter("change_kind = 'renamed'").select("old_name", "field_name").distinct().collect():
        parent[root(r["old_name"])] = root(r["field_name"])
    groups: dict[str, list[str]] = {}
    for name in uses:
        groups.setdefault(root(name), []).append(name)
    out = []
    for names in groups.values():
        names.sort(key=lambda x: (-uses[x], x))
        votes = sum((types.get(x, Counter()) for x in names), Counter())
        kind = min(votes, key=lambda t: (-votes[t], t)) if votes else "string"
        out.append(Alias(names[0], "string" if kind in ("object", "array") else kind, tuple(names)))
    return sorted(out, key=lambda a: a.canonical)


def plain_text(value: Column, json_type: Column) -> Column:
    """The value as a text; NULL for an object that says more than one text or number.

    Members that are null or false add nothing.  A true one does: ``{"id": "MC-1", "alt": true}`` stands for
    ``MC-1-alt``, ``MC-1-alt2`` and so on alike, so no text of the other form may be made of it.
    """
    members = F.map_values(F.try_parse_json(value).try_cast("map<string,variant>"))
    told = F.transform(members, lambda m: F.struct(F.schema_of_variant(m).alias("kind"), m.cast("string").alias("text")))
    told = F.filter(told, lambda m: (m["kind"] != "VOID") & ((m["kind"] != "BOOLEAN") | (m["text"] == "true")))
    one = F.get(told, F.lit(0))
    scalar = (one["kind"] != "BOOLEAN") & ~one["kind"].startswith("OBJECT") & ~one["kind"].startswith("ARRAY")
    return F.when(json_type != "object", value).when(json_type == "object", F.when((F.size(told) == 1) & scalar, one["text"]))


def unified_table(drift: Drift, aliases: list[Alias]) -> DataFrame:
    """One row per record with one column per canonical field, cast to its type.

    A value that cannot be cast is NULL and its field is listed in
    ``cast_failed``.  An object of one text or number counts as that
    (:func:`plain_text`); any other stays whole, as JSON, in a text column and
    is listed too.  ``object_values`` has every object as it was delivered, so
    that no member is lost.  A record without fields has a row of NULLs;
    ``unreadable`` tells texts that are no JSON object.
    """
    is_object = F.col("json_type") == "object"
    texts = drift.fields.withColumn("_plain", plain_text(F.col("value"), F.col("json_type")))
    found = F.struct(F.coalesce("_plain", "value").alias("text"), (is_object & F.col("_plain").isNull()).alias("whole"))
    aggs = [F.max(F.when(F.col("field_name").isin(list(a.names)) & F.col("value").isNotNull(), found)).alias(f"_{a.canonical}") for a in aliases]
    objects = F.array_sort(F.collect_list(F.when(is_object, F.struct("field_name", "value"))))
    record = ["raw_id", "series", "seq", "file_name"]
    wide = drift.records.join(texts.groupBy(*record).agg(*aggs, objects.alias("_objects")), record, "left")
    cols, failed = [], []
    for a in aliases:
        text, whole = F.col(f"`_{a.canonical}`.text"), F.col(f"`_{a.canonical}`.whole")
        if a.json_type == "number":
            cast = text.try_cast("double")
        elif a.json_type == "boolean":
            low = F.lower(F.trim(text))
            cast = F.when(low.isin("true", "yes", "1", "t", "1.0"), True).when(low.isin("false", "no", "0", "f", "0.0"), False)
        else:
            cast = text
        cols.append(cast.alias(a.canonical))
        failed.append(F.when(text.isNotNull() & (cast.isNull() | whole), F.lit(a.canonical)))
    return wide.select(
        *record, *cols, F.array_join(F.array_compact(F.array(*failed)), ",").alias("cast_failed"), F.coalesce("_objects", F.array()).alias("object_values"), "unreadable"
    )
