"""Pages, totals and envelopes over a filtered table."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from courtside.operators.rankindex import STRETCH_ROWS, rank_index
from courtside.operators.statquery import StatQuery, matching, order_columns, response_rows
from courtside.schemas import AUDIT_COLUMNS, CREDENTIAL_RESPONSE, TableSpec
from courtside.sources.tables import listed_credentials

# A page that ends within this many rows is served by one bounded heap per task; one further
# down, or a larger one, by counting rows per stretch of the order. Both give the same rows.
HEAP_ROWS = 100_000
PIVOTS = 32
# Stretches that may lie around a page before the pivots between them are drawn anew.
REFINED_STRETCHES = 8
# Rows of a JSON document that are gathered into one value.
PIECE_ROWS = 10_000
# A stamp that is not set shows as null instead of being left out; stamps keep their microseconds.
JSON_OPTIONS = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def page_rows(
    rows: DataFrame, spec: TableSpec, query: StatQuery, heap_rows: int = HEAP_ROWS
) -> DataFrame:
    """Rows of the requested page, in page order."""
    order = query.order(spec)
    found = matching(rows, query)
    if query.offset + query.page_size <= heap_rows:
        return _slice(found, order, query.offset, query.page_size)
    return deep_slice(found, order, query.offset, query.page_size, heap_rows)


def numbered_page(rows: DataFrame, spec: TableSpec, query: StatQuery, heap_rows: int = HEAP_ROWS) -> DataFrame:
    """Rows of the requested page with ``_number``, from 0 on in page order."""
    order = query.order(spec)
    found = matching(rows, query)
    if query.offset + query.page_size <= heap_rows:
        page = _slice(found, order, query.offset, query.page_size)
        # The window runs over at most heap_rows rows.
        return page.withColumn("_number", F.row_number().over(Window.orderBy(*order_columns(order))) - 1)
    return deep_slice(found, order, query.offset, query.page_size, heap_rows, numbered=True)


def _slice(rows: DataFrame, order, offset: int, limit: int) -> DataFrame:
    ordered = rows.orderBy(*order_columns(order))
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def after(order: list[tuple[str, bool]], boundary) -> Column:
    """Rows strictly behind ``boundary``, one value per order column.

    The leading column sorts either way with nulls last. The others are the natural key,
    ascending and never null, so they compare as one struct.
    """
    (column, descending), value = order[0], boundary[0]
    col, keys = F.col(column), [name for name, _ in order[1:]]
    if value is None:
        beyond = F.lit(False)
    else:
        beyond = ((col < F.lit(value)) if descending else (col > F.lit(value))) | col.isNull()
    if not keys:
        return F.coalesce(beyond, F.lit(False))
    held = F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, boundary[1:])])
    return F.coalesce(beyond, F.lit(False)) | (
        col.eqNullSafe(F.lit(value)) & (F.struct(*[F.col(k) for k in keys]) > held)
    )


def _not_before(order, boundary) -> Column:
    """Bound on the leading column alone, in a form the Parquet scan can use."""
    (column, descending), value = order[0], boundary[0]
    if value is None:
        return F.col(column).isNull()
    bound = (F.col(column) <= F.lit(value)) if descending else (F.col(column) >= F.lit(value))
    return bound | F.col(column).isNull()


def page_after(rows: DataFrame, spec: TableSpec, query: StatQuery, boundary) -> DataFrame:
    """The page that follows ``boundary``: the last row's sort value and key."""
    order = query.order(spec)
    found = matching(rows, query).filter(_not_before(order, boundary) & after(order, boundary))
    return _slice(found, order, 0, query.page_size)


def deep_slice(
    rows: DataFrame,
    order,
    offset: int,
    limit: int,
    heap_rows: int = HEAP_ROWS,
    stretch_rows: int = STRETCH_ROWS,
    numbered: bool = False,
) -> DataFrame:
    """Exact ``orderBy.offset.limit`` for any offset and any limit, distributed.

    A few pivot rows are drawn, and one parallel aggregate counts the rows between neighbouring
    pivots; only the stretches that hold the page are read on. That is repeated inside
    them until few rows around the page are left. Then the page is a bounded heap, or, if it is large itself, its
    rows are stored in sorted ranges of about ``stretch_rows`` and found by their place there. What returns to
    the driver is pivots and counts. Equal rows share a stretch. ``numbered`` adds ``_number``, from 0 on in the slice.
    """
    columns = [column for column, _ in order]
    draw = F.xxhash64(*[F.col(c) for c in columns])
    region, held_here = rows, None
    while True:
        drawn = region.select(*columns).orderBy(draw, *columns).limit(PIVOTS).distinct()
        pivots = [tuple(pivot) for pivot in drawn.orderBy(*order_columns(order)).collect()]
        stretch = _pivots_passed(order, pivots, 0, len(pivots))
        held = dict(region.groupBy(stretch.alias("stretch")).agg(F.count(F.lit(1))).collect())
        # Rows ahead of each stretch.
        ahead = list(accumulate((held.get(i, 0) for i in range(len(pivots) + 1)), initial=0))
        if offset >= ahead[-1]:
            return rows.withColumn("_number", F.lit(0).cast("bigint")).limit(0) if numbered else rows.limit(0)
        last = min(offset + limit, ahead[-1])
        low = next(i for i in range(len(pivots) + 1) if ahead[i + 1] > offset)
        high = next(i for i in range(len(pivots) + 1) if ahead[i + 1] >= last)
        if low > 0:
            region = region.filter(_not_before(order, pivots[low - 1]) & after(order, pivots[low - 1]))
        if high < len(pivots):
            region = region.filter(~after(order, pivots[high]))
        offset, limit, before, held_here = offset - ahead[low], last - offset, held_here, ahead[high + 1] - ahead[low]
        if offset + limit <= heap_rows:
            page = _slice(region, order, offset, limit)
            number = F.row_number().over(Window.orderBy(*order_columns(order))) - 1
            return page.withColumn("_number", number.cast("bigint")) if numbered else page
        # So few rows around the page that sorting them costs less than another count, or nothing was
        # gained because equal rows fill a stretch.
        if held_here - limit <= REFINED_STRETCHES * stretch_rows or held_here == before:
            return rank_index(region, order, held_here, stretch_rows=stretch_rows).page(offset, limit, numbered)


def _pivots_passed(order, pivots, low: int, high: int) -> Column:
    """How many of the sorted pivots a row lies behind, by halving."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(after(order, pivots[middle]), _pivots_passed(order, pivots, middle + 1, high)).otherwise(
        _pivots_passed(order, pivots, low, middle)
    )


def page_meta(rows: DataFrame, query: StatQuery) -> DataFrame:
    """One row: total, page, pageSize, pages. A plain aggregate, so counting is parallel."""
    size = F.lit(query.page_size).cast("bigint")
    total = matching(rows, query).agg(F.count(F.lit(1)).alias("total"))
    return total.select(
        "total",
        F.lit(query.page).cast("bigint").alias("page"),
        size.alias("pageSize"),
        F.expr(f"(total + {query.page_size} - 1) div {query.page_size}").alias("pages"),
    )


def page_with_meta(rows: DataFrame, spec: TableSpec, query: StatQuery) -> DataFrame:
    """Page rows, each carrying total and page count; an empty page gives one row of nulls with them."""
    counted = page_meta(rows, query)
    meta = counted.select(F.struct("total", "pages")).scalar()
    page = page_rows(rows, spec, query)
    filled = page.select("*", meta["total"].alias("total"), meta["pages"].alias("pages"))
    shown = page.limit(1).agg(F.count(F.lit(1))).scalar()
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in page.schema.fields]
    return filled.unionByName(counted.where(shown == 0).select(*nothing, "total", "pages"))


def page_pieces(rows: DataFrame, spec: TableSpec, query: StatQuery, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(piece, envelope): one JSON document of the page's rows in order, audit stamps included, and the paging numbers,
    cut behind every ``piece_rows`` rows.

    The pieces one after the other are the document, whatever its size; a page of up to ``piece_rows`` rows, or of
    none, is one piece. No group holds more rows than a piece.
    """
    names = {**spec.response_names, **dict(AUDIT_COLUMNS)}
    page = numbered_page(rows, spec, query)
    row = F.to_json(F.struct(*[F.col(c).alias(r) for c, r in names.items() if c in page.columns]), JSON_OPTIONS)
    cut = page.select(F.expr(f"_number div {piece_rows}").alias("piece"), F.struct("_number", row.alias("json")).alias("row"))
    held = cut.groupBy("piece").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    shown = F.least(F.lit(query.page_size), F.greatest(F.col("total") - query.offset, F.lit(0)))
    meta = page_meta(rows, query).select(F.to_json(F.struct("*")).alias("numbers"), F.floor((shown - 1) / piece_rows).alias("last"))
    pieces = meta.select("numbers", "last", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest("last", F.lit(0)))).alias("piece"))
    text = F.array_join(F.transform("rows", lambda r: r["json"]), ",")
    first, final = F.col("piece") == 0, F.col("piece") >= F.col("last")
    document = F.concat(
        F.when(first, '{"data":[').otherwise(","),
        F.coalesce(text, F.lit("")),
        F.when(final, F.concat(F.lit('],"pagination":'), F.col("numbers"), F.lit("}"))).otherwise(""),
    )
    return pieces.join(held, "piece", "left").select("piece", document.alias("envelope")).orderBy("piece")


def page_envelope(rows: DataFrame, spec: TableSpec, query: StatQuery) -> DataFrame:
    """The page's JSON document, in pieces if it is large; see ``page_pieces``."""
    return page_pieces(rows, spec, query).select("envelope")


def write_page(rows: DataFrame, spec: TableSpec, query: StatQuery, path: str, files: int = 8) -> None:
    """The document as text files whose contents, in the order of their names, are the document.

    Spark's own committer publishes the files together, so a lost task or a failed job leaves none behind.
    """
    pieces = page_pieces(rows, spec, query)
    pieces.repartitionByRange(files, "piece").sortWithinPartitions("piece").select("envelope").write.mode("errorifexists").text(path)


def json_rows(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """One JSON object per row, unpaged, audit stamps included."""
    return response_rows(rows, spec, with_audit=True).select(F.to_json(F.struct("*"), JSON_OPTIONS).alias("json"))


def credential_json(credentials: DataFrame) -> DataFrame:
    """One JSON object per listed credential, its hash as base64 text."""
    shown = listed_credentials(credentials)
    row = F.struct(*[F.col(c).alias(r) for c, r in CREDENTIAL_RESPONSE.items()])
    return shown.select(F.to_json(row, JSON_OPTIONS).alias("json"))


def write_json_rows(rows: DataFrame, spec: TableSpec, path: str) -> None:
    response_rows(rows, spec, with_audit=True).write.mode("errorifexists").options(**JSON_OPTIONS).json(path)
