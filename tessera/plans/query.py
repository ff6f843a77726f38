"""The query plan: filter, search, sort, sample, page; and the counts that go with a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scalars import seeded_rank, stratum
from tessera.model import Page, Query, Snapshot
from tessera.plans.predicate import compile_filter, orderable

#: Bytes of a page, and rows of a sample, at most; bytes of whole records that a task may hold to sort them.
PAGE_BYTES, MAX_SAMPLE, SORT_BYTES = 32_000_000, 10_000, 256_000_000


def check(snapshot: Snapshot, query: Query) -> None:
    if (query.snapshot_id, query.unit, query.population_scope) != (snapshot.snapshot_id, snapshot.unit, snapshot.population_scope):
        raise ValueError("the query is of another snapshot, unit or population")


def matching(snapshot: Snapshot, query: Query) -> DataFrame:
    """The population that filter and search match."""
    check(snapshot, query)
    out = snapshot.records.where(compile_filter(query.filter, snapshot.columns))
    return out.where(F.instr(F.col("search_text"), F.lower(F.lit(query.search))) > 0) if query.search else out


def ordering(snapshot: Snapshot, query: Query) -> list[Column]:
    """Missing values are last in both directions, and ids decide ties; without keys, rows have the snapshot's order."""
    if not query.sort:
        return [F.col("row_ordinal"), F.col("id")] if "row_ordinal" in snapshot.records.columns else [F.col("id")]
    out = []
    for key in query.sort:
        field = snapshot.columns.get(key["field_id"])
        if field is None:
            raise ValueError(f"unknown field {key['field_id']}")
        c = orderable(field)
        out.append(c.desc_nulls_last() if key.get("direction", "asc") == "desc" else c.asc_nulls_last())
    return out if any(k["field_id"] == "id" for k in query.sort) else [*out, F.col("id").asc()]


def sampled(snapshot: Snapshot, query: Query, rows: DataFrame) -> tuple[DataFrame, list[Column], int | None]:
    """The sample of ``rows``, its order, and its size at most; without a sample, all rows in the query's order.

    source: the first rows; random: by a seeded hash of the ids; stratified: the strata in turn, each by that hash."""
    if not query.sample:
        return rows, ordering(snapshot, query), None
    method, size = query.sample.get("method", "source"), query.sample.get("size", 100)
    if not isinstance(size, int) or not 1 <= size <= MAX_SAMPLE:
        raise ValueError(f"a sample has 1 to {MAX_SAMPLE} rows")
    if method == "source":
        by = ordering(snapshot, query)
        return rows.orderBy(*by).limit(size), by, size
    rows = rows.withColumn("_rank", seeded_rank(F.col("id"), int(query.sample.get("seed", 0))))
    if method == "random":
        by = [F.col("_rank"), F.col("id")]
    elif method == "stratified":
        field = snapshot.columns[query.sample["field_id"]]
        rows = rows.withColumn("_stratum", stratum(F.col(f"`{field.column}`"), field.dtype))
        turn = F.row_number().over(Window.partitionBy("_stratum").orderBy("_rank", "id"))
        rows = rows.withColumn("_turn", turn).where(F.col("_turn") <= size)  # a stratum gives at most the whole sample: cut before the shuffle
        by = [F.col("_turn"), F.col("_stratum")]
    else:
        raise ValueError(f"unknown sampling method {method}")
    return rows.orderBy(*by).limit(size), by, size


def plan(snapshot: Snapshot, query: Query, columns: list[str] | None = None, *, late: bool | None = None) -> DataFrame:
    """The page's rows as a lazy plan, in order, with ``position`` from 0 in the (sampled) population's order.

    The order and limit are one top-k: each task keeps a page at most. ``late``: only ids and what decides the order take part in it, and whole rows are
    fetched for the page's ids (a broadcast of at most 1000), for one more scan. By default so if the records are large enough for it."""
    rows, by, size = sampled(snapshot, query, matching(snapshot, query))
    offset = query.offset()
    if size is not None and offset > size:
        raise ValueError("the cursor is beyond the sample")
    if late is None:
        late = (offset + query.limit) * snapshot.max_record_bytes * 4 > SORT_BYTES
    page = rows.orderBy(*by).offset(offset).limit(query.limit)
    page = page.withColumn("position", F.row_number().over(Window.orderBy(*by)) - 1 + offset)  # a page of at most 1000 rows
    names = columns or [c for c in snapshot.records.columns if c not in ("search_text", "row_ordinal")]
    if late:
        keys = page.select(F.col("id").alias("_key"), "position")  # the scan below it reads no other columns
        page = snapshot.records.join(F.broadcast(keys), F.col("id") == F.col("_key")).orderBy("position")
    return page.select(*[F.col(f"`{c}`") for c in names], "position")


def run(snapshot: Snapshot, query: Query) -> Page:
    """The page with exact counts and the next cursor; a page ends before PAGE_BYTES."""
    narrow = matching(snapshot, query)
    matched = snapshot.count if snapshot.count is not None and not query.filter and not query.search else narrow.count()
    in_sample = min(int(query.sample.get("size", 100)), matched) if query.sample else matched
    offset = query.offset()
    if offset > in_sample:
        raise ValueError("the cursor is beyond the sample")
    rows = plan(snapshot, query)
    rows = rows.withColumn("_size", F.octet_length(F.to_json(F.struct("*")))).withColumn("_bytes", F.sum("_size").over(Window.orderBy("position")))
    fits = F.col("_bytes") <= PAGE_BYTES
    got = rows.agg(F.count(F.lit(1)).alias("asked"), F.count_if(fits).alias("fit"), F.max(F.when(F.col("position") == offset, F.col("_size"))).alias("first")).first()
    if (got["first"] or 0) > PAGE_BYTES:
        raise ValueError(f"the record at {offset} is over the {PAGE_BYTES} bytes of a page")
    rows, returned = rows.where(fits).drop("_bytes", "_size"), got["fit"]
    end = offset + returned
    warnings = []
    if returned < got["asked"]:
        warnings.append("the page is shorter, as its bytes are bounded; go on with its cursor")
    if query.sample and query.sample.get("method") == "stratified":
        warnings.append("a stratified sample doesn't tell how frequent values are")
    if snapshot.population_scope != "complete":
        warnings.append(f"counts are of a {snapshot.population_scope} snapshot, not of the whole population")
    return Page(rows, matched, in_sample, offset, returned, query.cursor_at(end) if end < in_sample else None, tuple(warnings))


def ids(snapshot: Snapshot, query: Query, most: int) -> DataFrame:
    """All ids that a query selects, sample applied; a selection of over ``most`` is refused."""
    rows, _, _ = sampled(snapshot, query, matching(snapshot, query))
    chosen = rows.select("id")
    if chosen.limit(most + 1).count() > most:
        raise ValueError(f"the selection has over {most} rows")
    return chosen


def tool_search(records: DataFrame, term: str, approved: DataFrame | None = None) -> DataFrame:
    """The records whose text or question has the term, whatever its case, of those whose ids are approved; an empty term finds all."""
    rows = records if approved is None else records.join(approved.select("id").distinct(), "id", "left_semi")
    if not term:
        return rows
    return rows.where(F.contains(F.lower(F.concat_ws("\n", F.coalesce("text", F.lit("")), F.coalesce("question", F.lit("")))), F.lit(term.lower())))
