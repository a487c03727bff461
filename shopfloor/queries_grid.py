"""Registered grid queries: search, sort, page, page info and column types.

Search runs over the whole ``documents`` table (whole texts); sort and page
over the price list and sales; column types over a text rendering of sales.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import catalog as C
from .operators import grid as G
from .queries import register
from .sources.fixtures import RetailTables

DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars"]
SMART_TEXT = 'licen "of the"'
PHRASE_TEXT = '"the. in"'
REGEX_TEXT = r"licen[cs]e \d{2}"
COLUMN_TEXT = ("data", {"source": "src1"})
PAGE_START, PAGE_LENGTH = 75, 25
INFO_START, INFO_LENGTH = 10, 10


# ---- the grid's rules, stated for DuckDB on their own ----------------------------
# (nothing here is taken from the operators, so a misread rule shows as a difference)


def _sql_cell(expr: str, markup: str = "FALSE") -> str:
    """Search text of a text column's cell; ``markup`` says whether the column is html."""
    spaced = f"regexp_replace(coalesce({expr}, ''), '[\\r\\n]', ' ', 'g')"
    v = f"(CASE WHEN {markup} THEN regexp_replace({spaced}, '<.*?>', '', 'g') ELSE {spaced} END)"
    read = f"regexp_replace({v}, '<[A-Za-z/!][^>]*>', '', 'g')"
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        read = f"replace({read}, '{ref}', '{char}')"
    return f"(CASE WHEN contains({v}, '&') THEN {read} ELSE {v} END)"


# the first row decides whether the text column is html
_FIRST_MARKUP = "(SELECT coalesce(min_by(text IN ('', '-') OR contains(text, '<'), doc_id), TRUE) FROM documents)"
_ROW = f"""concat(doc_id, '  ', {_sql_cell('text', _FIRST_MARKUP)}, '  ', {_sql_cell('lang')}, '  ',
  {_sql_cell('source')}, '  ', n_chars)"""
_SMART = f"(contains(lower({_ROW}), 'licen') AND contains(lower({_ROW}), 'of the'))"
_PHRASE = f"contains(lower({_ROW}), 'the. in')"


def documents(t: RetailTables) -> DataFrame:
    """The documents table with the columns the grid shows (whole texts)."""
    return t.raw("documents").select(*DOC_COLS)


# ---- search -------------------------------------------------------------------

_SELECT = f"SELECT {', '.join(DOC_COLS)} FROM documents WHERE"


@register("grid_search", f"{_SELECT} {_SMART}")
def grid_search(t: RetailTables) -> DataFrame:
    """Documents matching a smart search (words in any order, quoted phrase kept)."""
    return G.grid_search(documents(t), SMART_TEXT, position="doc_id")


@register("grid_search_phrase", f"{_SELECT} {_PHRASE}")
def grid_search_phrase(t: RetailTables) -> DataFrame:
    """Documents with a phrase that often stands across a line break."""
    return G.grid_search(documents(t), PHRASE_TEXT, position="doc_id")


@register("grid_search_removed", f"{_SELECT} NOT {_SMART}")
def grid_search_removed(t: RetailTables) -> DataFrame:
    """Documents the smart search removes (search complement)."""
    return G.grid_search(documents(t), SMART_TEXT, keep="removed", position="doc_id")


@register(
    "grid_search_regex",
    rf"{_SELECT} regexp_matches({_ROW}, 'licen[cs]e', 'i') AND regexp_matches({_ROW}, '\d{{2}}')",
)
def grid_search_regex(t: RetailTables) -> DataFrame:
    """Documents matching every regex word, case-insensitive."""
    return G.grid_search(documents(t), REGEX_TEXT, regex=True, position="doc_id")


@register(
    "grid_search_column",
    f"{_SELECT} contains(lower({_ROW}), 'data') AND contains(lower({_sql_cell('source')}), 'src1')",
)
def grid_search_column(t: RetailTables) -> DataFrame:
    """Documents matching a global search and a search on the source column."""
    return G.grid_search(documents(t), COLUMN_TEXT[0], column_search=COLUMN_TEXT[1], position="doc_id")


@register(
    "grid_page_info",
    f"""WITH c AS (SELECT count(*) AS records_total, count(*) FILTER (WHERE {_SMART}) AS records_display FROM documents)
SELECT cast({INFO_START // INFO_LENGTH} AS BIGINT) AS page, cast(ceil(records_display / {INFO_LENGTH}) AS BIGINT) AS pages,
  cast({INFO_START} AS BIGINT) AS start, cast(least({INFO_START + INFO_LENGTH}, records_display) AS BIGINT) AS "end",
  cast({INFO_LENGTH} AS BIGINT) AS length, records_total, records_display FROM c""",
)
def grid_page_info(t: RetailTables) -> DataFrame:
    """Paging summary of the smart search over documents (second page of 10)."""
    docs = documents(t)
    match = G.search_condition(G.row_text(docs, position="doc_id"), SMART_TEXT)
    return G.grid_page_info(docs, match, INFO_START, INFO_LENGTH)


# ---- sort and page ---------------------------------------------------------------

PRICE_ORDER = [("country_name", "asc"), ("retailprice", "desc")]
PRICE_TYPES = {"country_name": "string"}
PRICE_POSITION = ["item_id", "country_id"]
_PRICE_ORDER_SQL = "lower(country_name), retailprice DESC NULLS LAST, item_id, country_id"
_PRICE_LIST_SQL = """SELECT ic.item_id, i.sku, c.name AS country_name, ic.country_id, ic.retailprice
FROM v_item i JOIN v_item_country ic ON i.id = ic.item_id JOIN v_country c ON ic.country_id = c.id"""


@register(
    "grid_sort",
    f"SELECT *, row_number() OVER (ORDER BY {_PRICE_ORDER_SQL}) AS row_pos FROM ({_PRICE_LIST_SQL}) p",
)
def grid_sort(t: RetailTables) -> DataFrame:
    """Price list in grid order (country name, then price high to low), with each row's place."""
    return G.grid_rank(C.price_list(t), PRICE_ORDER, PRICE_POSITION, PRICE_TYPES)


@register(
    "grid_page",
    f"SELECT * FROM ({_PRICE_LIST_SQL}) p ORDER BY {_PRICE_ORDER_SQL} LIMIT {PAGE_LENGTH} OFFSET {PAGE_START}",
)
def grid_page(t: RetailTables) -> DataFrame:
    """Fourth page of 25 rows of the sorted price list."""
    return G.grid_page(C.price_list(t), PAGE_START, PAGE_LENGTH, PRICE_ORDER, PRICE_POSITION, PRICE_TYPES)


@register(
    "grid_page_deep",
    f"""SELECT id, item_id, quantity FROM v_line ORDER BY quantity DESC, id
LIMIT {PAGE_LENGTH} OFFSET (SELECT count(*) // 2 FROM v_line)""",
)
def grid_page_deep(t: RetailTables) -> DataFrame:
    """A page in the middle of all lines by quantity, found by position."""
    lines = t.line.select("id", "item_id", "quantity")
    return G.grid_page(lines, lines.count() // 2, PAGE_LENGTH, [("quantity", "desc")], "id")


@register("grid_page_rest", f"SELECT event_id, ts, value FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id) AS p FROM events) WHERE p > 40")
def grid_page_rest(t: RetailTables) -> DataFrame:
    """All events after the first forty, newest first (page length -1)."""
    rows = t.raw("events").select("event_id", "ts", "value")
    return G.grid_page(rows, 40, -1, [("ts", "desc")], "event_id")


@register(
    "grid_sort_events",
    """SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS row_pos FROM events""",
)
def grid_sort_events(t: RetailTables) -> DataFrame:
    """Events in time order (timestamps with fractions), with each row's place."""
    return G.grid_rank(t.raw("events").select("event_id", "ts"), [("ts", "asc")], "event_id")


@register(
    "grid_sort_events_text",
    """SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS row_pos FROM events""",
)
def grid_sort_events_text(t: RetailTables) -> DataFrame:
    """Events by the ISO text of their time (detected as dates, with fraction and zone), newest first."""
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("stamp")
    rows = t.raw("events").select("event_id", text)
    return G.grid_rank(rows, [("stamp", "desc")], "event_id").select("event_id", "row_pos")


@register(
    "grid_sort_default",
    """SELECT ps_partkey, ps_suppkey, qty, row_number() OVER (ORDER BY qty, ps_partkey, ps_suppkey) AS row_pos
FROM (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, cast(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY ALL)""",
)
def grid_sort_default(t: RetailTables) -> DataFrame:
    """Quantities per part and supplier sorted without any given type (numbers as numbers)."""
    rows = t.raw("lineitem").groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).agg(
        F.sum("l_quantity").cast("long").alias("qty")
    )
    return G.grid_rank(rows, [("qty", "asc")], ["ps_partkey", "ps_suppkey"])


def sales_text(t: RetailTables) -> DataFrame:
    """Sales rendered as the grid shows them (dates and amounts as text, links as HTML)."""
    s = t.sale
    return s.select(
        "id",
        "createddate",
        F.date_format("createddate", "M/d/yyyy").alias("created_text"),
        F.concat(F.lit("$"), F.format_number("amountdue", 2)).alias("amount_text"),
        F.concat(F.lit('<a href="#">'), F.col("id").cast("string"), F.lit("</a>")).alias("link_html"),
        F.concat(F.lit("<b>"), F.col("currency"), F.lit("</b>")).alias("note_html"),
        "currency",
        "amountdue",
    )


_SALES_TEXT_SQL = """SELECT id, createddate, strftime(createddate, '%-m/%-d/%Y') AS created_text,
  concat('$', format('{:,.2f}', amountdue)) AS amount_text, concat('<a href="#">', cast(id AS VARCHAR), '</a>') AS link_html,
  concat('<b>', currency, '</b>') AS note_html, currency, amountdue FROM v_sale"""


@register(
    "grid_sort_typed",
    f"""SELECT id, created_text, amount_text, row_number() OVER (ORDER BY createddate DESC, amountdue, id) AS row_pos
FROM ({_SALES_TEXT_SQL}) s""",
)
def grid_sort_typed(t: RetailTables) -> DataFrame:
    """Sales sorted on typed text keys: M/d/yyyy dates newest first, then $-formatted amounts."""
    rows = sales_text(t).select("id", "created_text", "amount_text")
    return G.grid_rank(rows, [("created_text", "desc"), ("amount_text", "asc")], "id",
                       {"created_text": "date", "amount_text": "num-fmt"})


# ---- column types --------------------------------------------------------------------

_TYPE_COLS = ["id", "createddate", "created_text", "amount_text", "link_html", "note_html", "mixed_html", "currency", "amountdue"]


def _typed_sales(t: RetailTables) -> DataFrame:
    """The sales grid with one more column, in which only the first row holds markup."""
    mixed = F.when(F.col("id") == 1, F.lit("<i>first</i>")).otherwise(F.col("currency"))
    return sales_text(t).withColumn("mixed_html", mixed)


def _types_sql() -> str:
    rows = f"""SELECT *, CASE WHEN id = 1 THEN '<i>first</i>' ELSE currency END AS mixed_html FROM ({_SALES_TEXT_SQL})"""
    number = "regexp_full_match({0}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')"
    plain = "translate({0}, '$,', '')"
    bare = "regexp_replace({0}, '<.*?>', '', 'g')"

    def text(c: str) -> str:
        tests = [
            ("num", number.format(f"trim({c})")),
            ("date", f"(try_strptime({c}, ['%Y-%m-%d', '%m/%d/%Y']) IS NOT NULL)"),
            ("num-fmt", number.format(plain.format(c))),
            ("html-num", number.format(bare.format(c))),
            ("html-num-fmt", number.format(plain.format(bare.format(c)))),
        ]
        blank = f"({c} IS NULL OR {c} IN ('', '-'))"
        whens = " ".join(f"WHEN bool_and({blank} OR {test}) THEN '{kind}'" for kind, test in tests)
        return f"CASE {whens} WHEN min_by({blank} OR contains({c}, '<'), id) THEN 'html' ELSE 'string' END"

    known = {"id": "'num'", "createddate": "'date'", "amountdue": "'num'"}
    parts = [
        f"SELECT '{c}' AS column_name, {i} AS position, {known.get(c) or text(c)} AS type FROM s GROUP BY ALL"
        if c not in known else f"SELECT '{c}' AS column_name, {i} AS position, {known[c]} AS type"
        for i, c in enumerate(_TYPE_COLS)
    ]
    return f"WITH s AS ({rows})\n" + "\nUNION ALL ".join(parts)


@register("grid_column_types", _types_sql())
def grid_column_types(t: RetailTables) -> DataFrame:
    """Grid type of every column of the sales grid."""
    return G.grid_column_types(_typed_sales(t), _TYPE_COLS, position="id")


# ---- texts as the pages show them ------------------------------------------------------

_SHOWN = ["'%-m/%-d/%Y, %-I:%M:%S %p'", "'%Y/%m/%d %H:%M:%S'", "'%b %-d, %Y %H:%M:%S'", "'%a, %d %b %Y %H:%M:%S GMT'"]
_SHOWN_SQL = f"""SELECT event_id, strftime(date_trunc('second', ts), {_SHOWN[0]}) AS us_text, strftime(date_trunc('second', ts), {_SHOWN[1]}) AS slashed_text,
  strftime(date_trunc('second', ts), {_SHOWN[2]}) AS month_text, strftime(date_trunc('second', ts), {_SHOWN[3]}) AS zone_text, strftime(ts, '%A') AS day_text FROM events"""
# the oracle reads the texts back with a parser of its own
_READ_SHOWN = [f"try_strptime({{0}}, {f})" for f in _SHOWN]


def shown_events(t: RetailTables) -> DataFrame:
    """Events with their time in the renderings of the staff pages (12-hour clock, slashes, month names, a zone name)."""
    texts = {"us_text": "M/d/yyyy, h:mm:ss a", "slashed_text": "yyyy/MM/dd HH:mm:ss", "month_text": "MMM d, yyyy HH:mm:ss",
             "zone_text": "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "day_text": "EEEE"}
    return t.raw("events").select("event_id", *[F.date_format("ts", f).alias(n) for n, f in texts.items()])


def _shown_order(col: str, k: int) -> str:
    return f"""SELECT event_id, {col}, row_number() OVER (ORDER BY {_READ_SHOWN[k].format(col)} DESC, event_id) AS row_pos FROM ({_SHOWN_SQL})"""


@register("grid_sort_shown_dates", _shown_order("us_text", 0))
def grid_sort_shown_dates(t: RetailTables) -> DataFrame:
    """Events by the text the order pages show (date and 12-hour time, detected as dates), newest first."""
    return G.grid_rank(shown_events(t).select("event_id", "us_text"), [("us_text", "desc")], "event_id")


@register("grid_sort_month_names", _shown_order("zone_text", 3))
def grid_sort_month_names(t: RetailTables) -> DataFrame:
    """Events by a text with weekday, month name and zone name, newest first."""
    return G.grid_rank(shown_events(t).select("event_id", "zone_text"), [("zone_text", "desc")], "event_id")


_SHOWN_COLS = ["us_text", "slashed_text", "month_text", "zone_text", "day_text"]


@register(
    "grid_types_shown_dates",
    f"WITH s AS ({_SHOWN_SQL})\n" + "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, {i} AS position, CASE WHEN bool_and({_READ_SHOWN[i].format(c)} IS NOT NULL) THEN 'date' ELSE 'string' END AS type FROM s"
        for i, c in enumerate(_SHOWN_COLS[:-1])
    ) + "\nUNION ALL SELECT 'day_text', 4, 'string'",
)
def grid_types_shown_dates(t: RetailTables) -> DataFrame:
    """Grid types of the renderings: dates, but for a bare weekday."""
    return G.grid_column_types(shown_events(t), _SHOWN_COLS, position="event_id")


@register(
    "grid_sort_characters",
    """SELECT c_custkey, label, row_number() OVER (ORDER BY kind, lower(c_name), c_custkey) AS row_pos
FROM (SELECT c_custkey, c_name, c_custkey % 3 AS kind, concat(CASE c_custkey % 3 WHEN 0 THEN 'z' WHEN 1 THEN '😀' ELSE 'ﬁ' END, c_name) AS label FROM customer)""",
)
def grid_sort_characters(t: RetailTables) -> DataFrame:
    """Customers by a label that begins with a letter, a surrogate pair or a ligature: the order of code units."""
    lead = F.element_at(F.array(F.lit("z"), F.lit("😀"), F.lit("ﬁ")), (F.col("c_custkey") % 3 + 1).cast("int"))
    rows = t.raw("customer").select("c_custkey", F.concat(lead, "c_name").alias("label"))
    return G.grid_rank(rows, [("label", "asc")], "c_custkey", {"label": "string"})


# ---- many searches, further grid options -------------------------------------------------


@register(
    "grid_search_many",
    f"""WITH q AS (
  SELECT item_id AS search_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
d AS MATERIALIZED (SELECT doc_id, lower({_ROW}) AS body FROM documents)
SELECT search_id, doc_id FROM q, d WHERE contains(body, concat_ws(' ', w[1], w[2])) AND contains(body, coalesce(w[3], '')) AND contains(body, coalesce(w[7], ''))""",
)
def grid_search_many(t: RetailTables) -> DataFrame:
    """All documents that a smart search for the beginning of a benchmark item keeps (a phrase and two words), for all items at once."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    quoted = F.concat(F.lit('"'), F.concat_ws(" ", F.get(w, 0), F.get(w, 1)), F.lit('"'))
    searches = t.raw("benchmark").select(F.col("item_id").alias("search_id"), F.concat_ws(" ", quoted, F.get(w, 2), F.get(w, 6)).alias("text"))
    return G.grid_search_many(documents(t), searches, "doc_id")


@register(
    "grid_search_custom",
    f"{_SELECT} contains(lower({_ROW}), 'licen') AND n_chars > 2000 AND lang <> 'en'",
)
def grid_search_custom(t: RetailTables) -> DataFrame:
    """A search narrowed by the caller's own filter functions."""
    return G.grid_search(documents(t), "licen", extra=[F.col("n_chars") > 2000, F.col("lang") != "en"], position="doc_id")


@register(
    "grid_search_tags",
    f"""SELECT id, note_html FROM (SELECT id, concat('<b class="note">', currency, ' ', id, '</b>') AS note_html FROM v_sale)
WHERE contains(lower(regexp_replace(note_html, '<.*?>', '', 'g')), 'd 1') AND NOT contains(regexp_replace(note_html, '<.*?>', '', 'g'), 'class')""",
)
def grid_search_tags(t: RetailTables) -> DataFrame:
    """Notes in markup: tags are dropped before the search (nothing is found by a tag's attribute)."""
    note = F.concat(F.lit('<b class="note">'), "currency", F.lit(" "), F.col("id").cast("string"), F.lit("</b>")).alias("note_html")
    rows = t.sale.select("id", note)
    return G.grid_search(rows, '"d 1"', cols=["note_html"], position="id")


@register(
    "grid_sort_through",
    """SELECT p_partkey, p_type, p_size, p_retailprice,
  row_number() OVER (ORDER BY p_size, p_retailprice DESC, lower(p_type), p_partkey) AS row_pos FROM part""",
)
def grid_sort_through(t: RetailTables) -> DataFrame:
    """Parts sorted through other columns, with a fixed sort before and after."""
    rows = t.raw("part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    return G.grid_rank(
        rows, [("p_partkey", "desc")], "p_partkey", {"p_type": "string"}, fixed_pre=[("p_size", "asc")], fixed_post=[("p_type", "asc")],
        data_sort={"p_partkey": ["p_retailprice"]},
    )


@register("grid_sort_first_column", "SELECT p_type, p_partkey, row_number() OVER (ORDER BY lower(p_type), p_partkey) AS row_pos FROM part")
def grid_sort_first_column(t: RetailTables) -> DataFrame:
    """Parts by the default sort: the first column, ascending."""
    return G.grid_rank(t.raw("part").select("p_type", "p_partkey"), position="p_partkey", types={"p_type": "string"})
