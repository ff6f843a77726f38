"""Joins that never lose rows silently: strict, overlay, result, grouped, full and anti joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.model import Field, Snapshot

MAX_RESULTS = 32


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def _refuse(found: DataFrame, message: str) -> None:
    row = found.limit(1).collect()
    if row:
        raise ValueError(f"{message}: {tuple(row[0])}")


def _refuse_any(checks: list[tuple[DataFrame, str]]) -> None:
    """One job for several refusals: a row of each, the first of which is told."""
    each = [df.limit(1).select(F.lit(i).alias("i"), F.concat_ws(", ", *[F.col(f"`{c}`").cast("string") for c in df.columns]).alias("row")) for i, (df, _) in enumerate(checks)]
    found = sorted(reduce(DataFrame.unionByName, each).collect())
    if found:
        raise ValueError(f"{checks[found[0]['i']][1]}: {found[0]['row']}")


def _matches(left: list[str], right: list[str], as_text: bool) -> Column:
    cast = lambda c: F.col(c).cast("string") if as_text else F.col(c)
    return reduce(lambda a, b: a & b, [cast(f"l.{x}") == cast(f"r.{y}") for x, y in zip(left, right, strict=True)])


def strict_join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], *, many: str | None = None, allow_unused: bool = False, as_text: bool = False, check: bool = True) -> DataFrame:
    """Inner join in which each left row must match.

    The right keys must be unique, unless ``many`` names a column to take the matching right rows as a list. Right rows without
    a left one are refused unless ``allow_unused``; no column may be overwritten. ``check=False`` only builds the plan."""
    extra = [c for c in right.columns if c not in right_keys]
    if clash := set(left.columns) & ({many} if many else set(extra)):
        raise ValueError(f"the join would overwrite {sorted(clash)}")
    on = _matches(left_keys, right_keys, as_text)
    if check:
        _check_strict(left, right, left_keys, right_keys, many is None, not allow_unused, as_text)
    if many:
        packed = right.groupBy(*right_keys).agg(F.sort_array(F.collect_list(F.struct(*extra))).alias(many))
        return left.alias("l").join(packed.alias("r"), on).select("l.*", f"r.{many}")
    return left.alias("l").join(right.alias("r"), on).select("l.*", *[f"r.{c}" for c in extra])


def _check_strict(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], unique: bool, all_used: bool, as_text: bool) -> None:
    """One job for all refusals: both sides' keys are counted before they meet, so that a common key is one row."""
    def keys(df: DataFrame, names: list[str], side: str) -> DataFrame:
        as_ = [(F.col(f"`{c}`").cast("string") if as_text else F.col(f"`{c}`")).alias(f"k{i}") for i, c in enumerate(names)]
        return df.select(*as_).groupBy(*[f"k{i}" for i in range(len(names))]).agg(F.count(F.lit(1)).alias(side))

    names = [f"k{i}" for i in range(len(left_keys))]
    l, r = keys(left, left_keys, "left"), keys(right, right_keys, "right")
    both = l.join(r, names, "full")  # null keys match nothing
    row = F.struct(*names)
    checks = {"no match for": F.col("right").isNull()}
    if unique:
        checks["the lookup key repeats"] = F.col("right") > 1
    if all_used:
        checks["unused lookup row"] = F.col("left").isNull()
    got = both.agg(*[F.min(F.when(c, row)).alias(f"c{i}") for i, c in enumerate(checks.values())]).first()
    for message, found in zip(checks, got, strict=True):
        if found is not None:
            raise ValueError(f"{message}: {tuple(found)}")


def overlay_join(base: DataFrame, overlay: DataFrame, base_key: str, overlay_key: str, name: str = "overlay") -> DataFrame:
    """All rows of ``base``, with the list of the overlay rows of their key (compared as text); an empty list without any."""
    packed = overlay.groupBy(F.col(overlay_key).cast("string").alias("_k")).agg(F.sort_array(F.collect_list(F.struct(*overlay.columns))).alias(name))
    out = base.join(packed, base[base_key].cast("string") == F.col("_k"), "left").drop("_k")
    return out.withColumn(name, F.coalesce(name, F.array().cast(dict(packed.dtypes)[name])))


def overlay_report(base: DataFrame, overlay: DataFrame, base_key: str, overlay_key: str) -> DataFrame:
    """check, rows: repeated base keys, overlay rows that match nothing or several rows, overlay rows without a key, base rows without one."""
    b, o = base.select(F.col(base_key).cast("string").alias("k")), overlay.select(F.col(overlay_key).cast("string").alias("k"))
    twice = b.where("k is not null").groupBy("k").count().where("count > 1")
    counts = [("duplicate_base_keys", twice), ("unmatched_overlay", o.where("k is not null").join(b, "k", "left_anti")), ("multiply_matched_overlay", o.join(twice, "k", "left_semi")), ("overlay_without_key", o.where("k is null")), ("base_without_key", b.where("k is null"))]
    return reduce(DataFrame.unionByName, [d.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("check"), "rows") for n, d in counts])


def join_results(snapshot: Snapshot, artifact: str, results: DataFrame, fields: dict[str, str], *, check: bool = True) -> Snapshot:
    """Left join of an artifact's results on the record id, as fields ``prediction.<artifact>.<key>``.

    ``fields``: the dtype of each result column. Repeated ids, ids that aren't in the snapshot and names that exist are refused."""
    names = {k: f"prediction.{artifact}.{k}" for k in fields}
    if clash := set(names.values()) & set(snapshot.fields):
        raise ValueError(f"fields exist already: {sorted(clash)}")
    if len({f.split(".")[1] for f in [*snapshot.fields, *names.values()] if f.startswith("prediction.")}) > MAX_RESULTS:
        raise ValueError(f"at most {MAX_RESULTS} artifacts")
    if check:
        _refuse_any([(duplicates(results, "id"), "the result repeats an id"), (results.select("id").join(snapshot.records.select("id"), "id", "left_anti"), "the result has an unknown id")])
    start = len(snapshot.records.columns)
    columns = {k: f"f_{start + i}" for i, k in enumerate(fields)}
    own = results.select(F.col("id").alias("_result_id"), *[F.col(k).alias(c) for k, c in columns.items()])
    rows = snapshot.records.join(own, F.col("id") == F.col("_result_id"), "left").drop("_result_id")
    return snapshot.with_fields(rows, {names[k]: Field(names[k], dtype, columns[k]) for k, dtype in fields.items()})


def attach_results(records: DataFrame, artifact: str, results: DataFrame, columns: list[str], *, asset_records: DataFrame | None = None) -> DataFrame:
    """All records with ``prediction.<artifact>.<column>`` of the results of their id; a value that is there gives way to a result, not to a missing one.

    ``asset_records``: the records of the asset unit, which join the population if results are of assets and aren't in it. ``unjoined`` counts what no record takes."""
    if asset_records is not None:
        records = records.unionByName(asset_records.join(records.select("id"), "id", "left_anti"), allowMissingColumns=True)
    own = results.select(F.col("id").alias("_id"), F.lit(True).alias("_has"), *[F.col(f"`{c}`").alias(f"_r{i}") for i, c in enumerate(columns)])
    out = records.join(own, F.col("id") == F.col("_id"), "left")
    for i, c in enumerate(columns):
        name = f"prediction.{artifact}.{c}"
        before = F.col(f"`{name}`") if name in records.columns else F.lit(None)
        out = out.withColumn(name, F.when(F.col("_has"), F.col(f"_r{i}")).otherwise(before))
    return out.drop("_id", "_has", *[f"_r{i}" for i in range(len(columns))])


def unjoined(records: DataFrame, results: DataFrame) -> DataFrame:
    """items_unjoined: results whose id isn't a record's, or is null. They are counted, never lost silently."""
    return results.join(records.select("id").distinct(), "id", "left_anti").agg(F.count(F.lit(1)).alias("items_unjoined"))


def column_of_ids(ids: DataFrame, records: DataFrame, column: str, results: DataFrame | None = None) -> DataFrame:
    """ord, id, value for each of the ids (ord, id), in their order: the record's value, or its result's where ``results`` is given.

    An id that isn't a record's has no value, even if there is a result of it; an id that is asked for twice is there twice."""
    source = records.select(F.col("id").alias("_s"), *([F.col(f"`{column}`").alias("value")] if results is None else []))
    out = ids.join(source, F.col("id") == F.col("_s"), "left")
    if results is not None:
        own = results.select(F.col("id").alias("_r"), F.col(f"`{column}`").alias("value"))
        out = out.join(own, F.col("_s") == F.col("_r"), "left")
    return out.select("ord", "id", "value").orderBy("ord")


def assemble_graph(images: DataFrame, single: dict[str, DataFrame], multiple: dict[str, tuple[DataFrame, str]], qas: DataFrame, regions: DataFrame, links: DataFrame, *, check: bool = True) -> DataFrame:
    """One row for each image, with what other tables say of it, and one for each link whose ends aren't there.

    images: image_id and columns. single: tables with one row for an image at most; multiple: tables with a list for each image, with the
    column that orders it. qas (qa_id, image_id) and regions (region_id, image_id) tell whose they are; links (qa_id, region_id) belong to the
    image of their qa, or else of their region. A link whose qa and region are unknown is an orphan: ``orphan_qa`` and ``orphan_region`` name it.
    Refused: rows of images that aren't there, repeated images, regions and qas, and links whose qa and region are of different images."""
    whose = links.join(qas.select("qa_id", F.col("image_id").alias("_q")), "qa_id", "left").join(regions.select("region_id", F.col("image_id").alias("_g")), "region_id", "left")
    if check:
        checks = [(duplicates(table, key), f"the {name} repeats") for name, (table, key) in {"image": (images, "image_id"), "qa": (qas, "qa_id"), "region": (regions, "region_id")}.items()]
        checks += [(table.select("image_id").join(images.select("image_id"), "image_id", "left_anti"), f"{name} has an unknown image") for name, table in {**single, **{n: t for n, (t, _) in multiple.items()}, "qas": qas, "regions": regions}.items()]
        checks += [(duplicates(table, "image_id"), f"{name} repeats an image") for name, table in single.items()]
        _refuse_any([*checks, (whose.where(F.col("_q") != F.col("_g")).select("qa_id", "region_id"), "the qa and the region are of different images")])
    out = images
    for name, table in single.items():
        out = out.join(table.select("image_id", F.struct(*[c for c in table.columns if c != "image_id"]).alias(name)), "image_id", "left")
    for name, (table, order) in multiple.items():
        packed = table.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in table.columns if c not in ("image_id", order)]))).alias(name))
        out = out.join(packed, "image_id", "left").withColumn(name, F.coalesce(name, F.array().cast(dict(packed.dtypes)[name])))
    of_image = whose.withColumn("image_id", F.coalesce("_q", "_g"))
    mapped = of_image.where("image_id is not null").groupBy("image_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("qa_id", "region_id")))).alias("qa_to_region"))
    orphans = of_image.where("image_id is null").select(F.col("qa_id").alias("orphan_qa"), F.col("region_id").alias("orphan_region"))
    return out.join(mapped, "image_id", "left").unionByName(orphans, allowMissingColumns=True)


def records_by_id(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of the ids (ord, id), each id once, at its first place; ids without a row are refused by ``missing_ids``."""
    wanted = ids.groupBy("id").agg(F.min("ord").alias("ord"))
    return records.join(wanted, "id")


def missing_ids(records: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(records, "id", "left_anti").select("id").distinct()


def group_tables(base: DataFrame, key: str, tables: dict[str, tuple[DataFrame, str, list[str]]], *, order: dict[str, str] | None = None, few: bool = False) -> DataFrame:
    """Each row of ``base`` with an array of structs from each table (rows, key column, columns), in the order of the columns or of ``order``. ``few``: the tables have few keys, and their lists go to all tasks."""
    out = base
    for name, (rows, at, columns) in tables.items():
        first = [order[name]] if order and name in order else []
        packed = rows.groupBy(F.col(at).alias(f"_{name}")).agg(F.sort_array(F.collect_list(F.struct(*first, *[c for c in columns if c not in first]))).alias(name))
        out = out.join(F.broadcast(packed) if few else packed, F.col(key) == F.col(f"_{name}"), "left").drop(f"_{name}")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(dict(packed.dtypes)[name])))
    return out


def with_objects(captions: DataFrame, images: DataFrame, objects: DataFrame, classes: DataFrame, *, by: str = "image_id") -> DataFrame:
    """A row for each caption (caption_id, image_id, text), with its image's columns and the list of its objects (object_id, image_id, class_id, and
    more) by id, each with its class's name. Captions and objects of unknown images, objects of unknown classes and repeated ids are refused.

    ``by``: where images that are alike in one of their few-valued columns have the same objects, that column, which the objects then have instead of image_id: each list is made once, and not for each image."""
    for name, (table, key) in {"caption": (captions, "caption_id"), "object": (objects, "object_id")}.items():
        _refuse(duplicates(table, key), f"the {name} repeats")
    named = strict_join(objects, classes.select("class_id", F.col("name").alias("class_name")), ["class_id"], ["class_id"], allow_unused=True)
    _refuse(objects.join(images.select(by), by, "left_anti").select("object_id"), "the object has an unknown image")
    with_images = strict_join(captions, images, ["image_id"], ["image_id"], allow_unused=True)
    return group_tables(with_images, by, {"objects": (named, by, ["object_id", *[c for c in named.columns if c not in ("object_id", by)]])}, few=by != "image_id")


def agree(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The keys at which two tables that describe the same things differ: missing on one side, or unequal in a column."""
    l, r = left.select(key, *[F.col(c).alias(f"l_{c}") for c in columns]).withColumn("in_left", F.lit(True)), right.select(F.col(key).alias("_k"), *[F.col(c).alias(f"r_{c}") for c in columns]).withColumn("in_right", F.lit(True))
    both = l.join(r, F.col(key) == F.col("_k"), "full")
    unequal = reduce(lambda a, b: a | b, [~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")) for c in columns])
    return both.where(F.col("in_left").isNull() | F.col("in_right").isNull() | unequal).select(F.coalesce(key, "_k").alias(key), F.coalesce("in_left", F.lit(False)).alias("in_left"), F.coalesce("in_right", F.lit(False)).alias("in_right"))


def contiguous(rows: DataFrame, key: str, step: str, first: int = 1) -> DataFrame:
    """Keys whose steps aren't first, first + 1, ... without gaps or repeats."""
    got = rows.groupBy(key).agg(F.count(F.lit(1)).alias("steps"), F.countDistinct(step).alias("distinct_steps"), F.min(step).alias("least"), F.max(step).alias("most"))
    return got.where((F.col("steps") != F.col("distinct_steps")) | (F.col("least") != first) | (F.col("most") - F.col("least") + 1 != F.col("steps"))).select(key, "steps")


def collapse_variants(rows: DataFrame, key: str, condition: str, value: str, expected: int) -> DataFrame:
    """key, variants (condition to value) of the keys that have each of the ``expected`` conditions once."""
    got = rows.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct(condition, value)))).alias("variants"), F.count(F.lit(1)).alias("n"), F.countDistinct(condition).alias("c"))
    return got.where((F.col("n") == expected) & (F.col("c") == expected)).select(key, "variants")


def pivot_folds(rows: DataFrame, key: str, fold: str, split: str, folds: list) -> DataFrame:
    """key and a column ``split_<fold>`` for each fold; a key that repeats within a fold is null there and counted in ``repeats``."""
    out = rows.groupBy(key).agg(*[F.when(F.count_if(F.col(fold) == f) == 1, F.max(F.when(F.col(fold) == f, F.col(split)))).alias(f"split_{f}") for f in folds], *[F.count_if(F.col(fold) == f).alias(f"_n{f}") for f in folds])
    return out.withColumn("repeats", F.lit(0) + sum((F.when(F.col(f"_n{f}") > 1, 1).otherwise(0) for f in folds), F.lit(0))).drop(*[f"_n{f}" for f in folds])


def union_keyed(left: DataFrame, right: DataFrame, key: str, status: str, absent: str) -> DataFrame:
    """Full join on ``key``: rows that only ``right`` has get ``absent`` as their status."""
    return left.join(right, key, "full").withColumn(status, F.coalesce(F.col(status), F.lit(absent)))


def resolve_aliases(mentions: DataFrame, aliases: DataFrame, name: str, alias: str, target: str) -> DataFrame:
    """Each mention with the sorted targets that its normalised name stands for, and ``resolution``: none, one or ambiguous."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    known = aliases.groupBy(norm(F.col(alias)).alias("_a")).agg(F.sort_array(F.collect_set(target)).alias("targets"))
    out = mentions.join(known, norm(F.col(name)) == F.col("_a"), "left").drop("_a")
    n = F.coalesce(F.size("targets"), F.lit(0))
    return out.withColumn("resolution", F.when(F.coalesce(n, F.lit(0)) < 1, "none").when(n == 1, "one").otherwise("ambiguous"))


def decode(c: Column, names: list[str] | dict) -> Column:
    """Codes to names: by position in a list, or by key; unknown codes are null."""
    if isinstance(names, list):
        return F.when(c >= 0, F.get(F.array(*map(F.lit, names)), c.cast("int")))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c)


def invert_map(rows: DataFrame, key: str, members: str, member: str) -> DataFrame:
    """(key, [members]) to (member, sorted keys)."""
    return rows.select(F.col(key).alias("_key"), F.explode(members).alias(member)).groupBy(member).agg(F.sort_array(F.collect_set("_key")).alias(key))
