"""Table-grid operators over any DataFrame: search, sort, paging, page info, column types.

The staff pages let a user search, sort and page a whole result set.  Here
each step is a DataFrame operator, so it runs over all rows on the cluster:

* search -> one ``filter`` over a per-row search text (JVM string functions);
* sort   -> ``orderBy`` on typed sort keys plus a caller-supplied position
            column, which makes the sort stable and the order total;
* page   -> a top-K for a page near the top; any other page by order
            statistics of the keys, so that only a small range is sorted;
* info   -> both counts in one aggregate pass;
* types  -> one aggregate pass over all columns.
"""

from __future__ import annotations

import json
import re
from html.entities import html5 as HTML5
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.datetext import is_date, may_be_date, parse_date
from ..plans.ids import number_rows
from ..plans.joins import broadcast_limit, is_small
from ..plans.materialize import sized_side, write_table

# FIXED VALUES — the grid's own rules, which results must follow.
# Characters the grid strips from formatted numbers: ' , $ £ € ¥ % thin space, narrow no-break space.
FORMAT_CHARS = "',$£€¥%\u2009\u202F"
NUMBER_RE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
MARKUP_RE = "<.*?>"  # what the cleaner of an HTML column drops
TAG_RE = "<[A-Za-z/!][^>]*>"  # what a browser takes for a tag
WORD_RE = r'"[^"]+"|[^ ]+'  # a word or quoted phrase of a smart search
TYPE_ORDER = ["num", "date", "num-fmt", "html-num", "html-num-fmt", "html"]
ENTITY_RE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?"
# References to the C1 range mean the characters of this code page, as in every browser.
LEGACY_CODE_PAGE = "cp1252"


def _as_text(df: DataFrame, c: str) -> Column:
    return F.col(c).cast("string")


def _legacy_character(code: int) -> str:
    try:
        return bytes([code]).decode(LEGACY_CODE_PAGE)
    except UnicodeDecodeError:
        return chr(code)


def decode_entities(value: Column) -> Column:
    """Character references decoded as a browser does: all named ones (a legacy name also without its
    semicolon, the longest that fits), decimal and hexadecimal ones."""
    named = F.from_json(F.lit(json.dumps(HTML5)), "map<string,string>")
    legacy = F.array(*[F.lit(n) for n in sorted(n for n in HTML5 if not n.endswith(";"))])
    low = F.from_json(F.lit(json.dumps({str(c): _legacy_character(c) for c in range(0x80, 0xA0)})), "map<string,string>")

    def decoded(e: Column) -> Column:
        body = F.substring(e, 2, 1 << 20)
        digits = F.regexp_replace(body, "[#xX;]", "")
        code = F.when(body.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits)
        code = F.coalesce(code.try_cast("int"), F.lit(0x110000))  # too long a number is no code point
        bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        point = F.when(bad, F.lit(0xFFFD)).otherwise(code)
        char = F.coalesce(
            F.try_element_at(low, code.cast("string")), F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        )
        prefix = F.array_max(F.filter(legacy, lambda n: body.startswith(n)))
        name = F.coalesce(
            F.try_element_at(named, body),
            F.concat(F.try_element_at(named, prefix), F.substr(body, F.length(prefix) + 1)),
            e,
        )
        return F.when(body.startswith("#"), char).otherwise(name)

    parts, found = F.split(value, ENTITY_RE), F.regexp_extract_all(value, F.lit(ENTITY_RE), F.lit(0))
    pieces = F.zip_with(parts, F.transform(found, decoded), lambda p, d: F.concat(p, F.coalesce(d, F.lit(""))))
    return F.array_join(pieces, "")


def _flat(value: Column, kind: str) -> Column:
    """A cell's text before references are read: line breaks made blanks, an html column's markup dropped."""
    v = F.coalesce(value, F.lit(""))
    if kind in ("string", "html"):
        v = F.replace(F.replace(v, F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    else:
        v = F.when(F.instr(v, "&") == 0, _unbroken(v)).otherwise(v)
    return F.regexp_replace(v, MARKUP_RE, "") if kind == "html" else v


def _unbroken(v: Column) -> Column:
    return F.replace(F.replace(v, F.lit("\r")), F.lit("\n"))


def _read(v: Column) -> Column:
    """A cell with '&' is read as HTML: tags dropped, character references decoded, line breaks that are left removed."""
    return F.when(F.instr(v, "&") > 0, _unbroken(decode_entities(F.regexp_replace(v, TAG_RE, "")))).otherwise(v)


def cell_text(value: Column, kind: str = "string") -> Column:
    """Search text of one cell, cleaned by its column's type.

    In string and html columns line breaks become spaces, and an html column
    loses its markup.  Whatever the type, a cell with '&' is read as HTML
    (tags dropped, character references decoded), and line breaks that are
    left are removed.  NULL is ''.
    """
    return _read(_flat(value, kind))


def row_text(df: DataFrame, cols: Sequence[str] | None = None, types: dict[str, str] | None = None,
             position: str | None = None) -> Column:
    """Searchable text of a row: its cells, cleaned by column type, joined by two spaces.

    ``types`` are the columns' grid types; those left out come from the schema
    or are detected (see ``column_types``).
    """
    cols = list(cols or df.columns)
    kinds = column_types(df, cols, types, position)
    # a number's text has no entities or line breaks: nothing to clean
    cells = [
        F.coalesce(_as_text(df, c), F.lit("")) if isinstance(df.schema[c].dataType, T.NumericType) else _flat(_as_text(df, c), kinds[c])
        for c in cols
    ]
    # references are read in one lambda over the cells, so their table stands in the plan once, not once a column;
    # whether there are any is seen from the raw cells, which flattening gives no '&'
    raw = [_as_text(df, c) for c in cols if not isinstance(df.schema[c].dataType, T.NumericType)]
    any_reference = F.lit(False)
    for v in raw:
        any_reference = any_reference | (F.instr(F.coalesce(v, F.lit("")), "&") > 0)
    return F.when(any_reference, F.array_join(F.transform(F.array(*cells), _read), "  ")).otherwise(F.concat_ws("  ", *cells))


def search_terms(text: str, smart: bool = True) -> list[str]:
    """Split a smart search into words; double quotes keep a phrase together."""
    if not smart:
        return [text]
    words = re.findall(WORD_RE, text)
    return [w[1:-1] if w.startswith('"') and w.endswith('"') and len(w) > 1 else w for w in words]


def search_condition(text_col: Column, text: str, regex: bool = False, smart: bool = True,
                     case_insensitive: bool = True) -> Column:
    """Every term must occur in the text (as a regex when ``regex``)."""
    terms = search_terms(text, smart)
    if not terms:
        return F.lit(True)
    bound = F.lower(text_col) if case_insensitive and not regex else text_col

    def all_terms(txt: Column) -> Column:
        cond = None
        for term in terms:
            if regex:
                c = txt.rlike(("(?iu)" if case_insensitive else "") + term)
            else:
                c = F.instr(txt, term.lower() if case_insensitive else term) > 0
            cond = c if cond is None else cond & c
        return cond

    if len(terms) == 1:
        return all_terms(bound)
    # several terms: the (lowered) text is built once per row and bound to the
    # lambda variable; written directly, every term would rebuild it (the
    # optimizer inlines a projected column back into the filter)
    return F.exists(F.array(bound), all_terms)


def grid_search(
    df: DataFrame,
    text: str = "",
    cols: Sequence[str] | None = None,
    regex: bool = False,
    smart: bool = True,
    case_insensitive: bool = True,
    column_search: dict[str, str] | None = None,
    extra: Sequence[Column] = (),
    keep: str = "applied",
    types: dict[str, str] | None = None,
    position: str | None = None,
) -> DataFrame:
    """Rows matching the global search, every column search and ``extra`` predicates
    (the caller's own filter functions, as Columns).

    ``keep='applied'`` returns the matches, ``'removed'`` the rows the search
    removed, ``'none'`` all rows.  ``types`` and ``position`` are those of ``row_text``.
    """
    column_search = column_search or {}
    kinds = column_types(df, [*(cols or df.columns), *column_search], types, position)
    cond = search_condition(row_text(df, cols, kinds), text, regex, smart, case_insensitive)
    for col, term in column_search.items():
        cond = cond & search_condition(cell_text(_as_text(df, col), kinds[col]), term, regex, smart, case_insensitive)
    for pred in extra:
        cond = cond & pred
    if keep == "none":
        return df
    if keep == "removed":
        return df.filter(~F.coalesce(cond, F.lit(False)))
    return df.filter(cond)


GRAM = 3
RIVALS = 3  # pieces of a search, the rarest by their grams, whose words are listed to find its rarest one
SIDE_TIMES = 4  # of the broadcast limit: the words that lead to searches, looked up beside the texts so that these need no shuffle


def _grams(text: Column, lengths: Sequence[int]) -> Column:
    """The distinct character grams of a text of the given lengths.

    A lookahead finds one gram at every place.  Beside a character outside the
    basic plane it may also give a gram that begins in its second half; such a
    gram is in no search, or only names a row that containment then refutes.
    """
    found = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths]
    return F.array_distinct(F.concat(*found))


def _pieces(term: Column) -> Column:
    """A term parted at its blanks, each part with the blanks beside it: a text that
    holds the term has every piece in one of its words, written between two blanks."""
    parts = F.split(term, " ")
    last = F.size(parts) - 1
    blank = lambda there: F.when(there, F.lit(" ")).otherwise(F.lit(""))
    return F.transform(parts, lambda p, i: F.concat(blank(i > 0), p, blank(i < last)))


def _search_grams(asked: DataFrame) -> DataFrame:
    """_search, piece, gram: the grams of GRAM characters of every piece of a search's terms.

    Shorter pieces are left to the trial of all terms; a search that has no
    other is looked up by them, each its own gram.
    """
    pieces = asked.select("_search", F.explode("terms").alias("term")).select("_search", F.explode(_pieces(F.col("term"))).alias("piece")).distinct()
    listed = pieces.groupBy("_search").agg(F.collect_list("piece").alias("pieces"))
    long = F.filter("pieces", lambda p: F.length(p) >= GRAM)
    used = listed.select("_search", F.explode(F.when(F.size(long) > 0, long).otherwise(F.col("pieces"))).alias("piece"))
    own = F.when(F.length("piece") < GRAM, F.array("piece")).otherwise(_grams(F.col("piece"), [GRAM]))
    return used.select("_search", "piece", F.explode(own).alias("gram"))


def grid_search_many(df: DataFrame, searches: DataFrame, position: str, cols: Sequence[str] | None = None,
                     types: dict[str, str] | None = None) -> DataFrame:
    """search_id and ``position`` of every row that a smart search of ``searches`` (search_id, text) keeps.

    Searches are not tried on rows one by one, nor is every text cut into
    grams.  Rows and terms are parted at blanks.  The pieces of the terms are
    looked up by grams in the distinct words of all rows; every search takes the
    piece that the fewest rows hold, and the words with it lead to the rows where
    all its terms are tried.  ``position`` must identify a row; rows that share
    one are met with each other, as in a join by it.
    A search without words keeps all rows and is not listed.
    """
    word = F.regexp_extract_all(F.lower("text"), F.lit(WORD_RE), F.lit(0))
    bare = F.transform(word, lambda w: F.when(w.rlike('^".+"$'), F.regexp_replace(w, '^"|"$', "")).otherwise(w))
    asked = searches.select("search_id", F.array_distinct(bare).alias("terms")).filter((F.size("terms") > 0) & F.col("search_id").isNotNull())
    asked = asked.groupBy("search_id", "terms").agg(F.count(F.lit(1)).alias("times"))
    asked = write_table(asked.select("*", F.monotonically_increasing_id().alias("_search")), "grid-searches")
    wanted = write_table(_search_grams(asked), "grid-search-grams")
    lengths = [r[0] for r in wanted.select(F.length("gram")).distinct().collect()]
    if not lengths:
        return df.select(position).limit(0).select(F.lit(None).cast(searches.schema["search_id"].dataType).alias("search_id"), position)

    # explode_outer: from a plain explode Spark infers a filter that takes every text apart a second time
    texts = df.filter(F.col(position).isNotNull()).select(
        F.col(position).alias("_row"), F.monotonically_increasing_id().alias("_copy"), F.lower(row_text(df, cols, types, position)).alias("body"))
    rows = texts.select("*", F.explode_outer(F.array_distinct(F.split("body", " "))).alias("word"))
    words = write_table(rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "grid-words")
    spaced = F.concat(F.lit(" "), "word", F.lit(" "))
    spelled = words.select("*", F.explode_outer(_grams(spaced, sorted(lengths))).alias("gram"))
    counts = spelled.join(sized_side(wanted.select("gram").distinct(), "grid-grams"), "gram").groupBy("gram").agg(F.sum("n").alias("n"))
    # a gram that no word holds counts 0: its search finds nothing
    bound = wanted.join(counts, "gram", "left").groupBy("_search", "piece").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"))
    few = bound.groupBy("_search").agg(F.slice(F.sort_array(F.collect_list(F.struct("g.n", "g.gram", "piece"))), 1, RIVALS).alias("few"))
    few = write_table(few.select("_search", F.inline("few")).drop("n"), "grid-few")
    lookup = sized_side(few.select("gram", "piece").distinct(), "grid-pieces")
    found = write_table(spelled.join(lookup, "gram").filter(F.contains(spaced, F.col("piece"))).select("piece", "word", "n"), "grid-found")
    held = few.join(found.groupBy("piece").agg(F.sum("n").alias("n")), "piece", "left")
    rarest = held.groupBy("_search").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("p")).select("_search", "p.piece")
    rarest = write_table(rarest.join(asked.select("_search", "terms"), "_search"), "grid-rarest")
    chosen = write_table(found.join(rarest.select("_search", "piece"), "piece").select("word", "_search"), "grid-chosen")

    # the term of the piece is nearly sure to hold: the others are tried first
    own = lambda t: F.contains(t, F.col("piece"))
    terms = rarest.select("_search", F.concat(F.filter("terms", lambda t: ~own(t)), F.filter("terms", own)).alias("terms"))
    holds = F.forall("terms", lambda t: F.contains(F.col("body"), t))
    if is_small(chosen, SIDE_TIMES * broadcast_limit(df)) and is_small(rarest):
        # the text is at hand where its words are looked up; a row may hold several words of a search
        near = rows.join(F.broadcast(chosen.join(F.broadcast(terms), "_search")), "word")
        # the number keeps the trial out of the join, which with it would copy the text to every word
        near = near.withColumn("_near", F.monotonically_increasing_id())
        met = near.filter((F.col("_near") >= 0) & holds).select("_search", "_row", "_copy").distinct()
    else:
        # no text is carried to the words' shuffle
        near = rows.select("_row", "word").join(chosen, "word").select("_row", "_search").distinct()
        met = texts.join(near.join(terms, "_search"), "_row").filter(holds)
    met = met.groupBy("_search", "_row").agg(F.count(F.lit(1)).alias("n")).join(asked.select("_search", "search_id", "times"), "_search")
    each = F.explode(F.array_repeat(F.lit(0), (F.col("n") * F.col("n") * F.col("times")).cast("int")))
    return met.select("search_id", F.col("_row").alias(position), each).select("search_id", position)


# ---- sorting ----------------------------------------------------------------


def _empty(s: Column) -> Column:
    return s.isNull() | (s == "") | (s == "-")


def _text_order(s: Column) -> Column:
    """Texts are compared by UTF-16 code units, as in a browser: U+1F600 (a surrogate pair) before U+FB01."""
    return F.encode(s, "UTF-16BE")


def sort_key(value: Column, kind: str = "string", dtype: T.DataType | None = None) -> Column:
    """Typed sort key of a cell.

    A numeric, date or timestamp column sorts on its own values under the types
    ``num`` and ``date``.  Text is read by type: string: lower case, blank -> '';
    html: markup dropped, lower case; num and its variants: formatting stripped,
    then a number, blank -> NULL (first ascending, like minus infinity); date:
    see ``functions.datetext``, anything else -> epoch 0.
    """
    s = value.cast("string")
    if kind == "string":
        return _text_order(F.when(_empty(s), F.lit("")).otherwise(F.lower(s)))
    if kind == "html":
        return _text_order(F.when(_empty(s), F.lit("")).otherwise(F.lower(F.regexp_replace(s, MARKUP_RE, ""))))
    if kind in ("num", "num-fmt", "html-num", "html-num-fmt"):
        if isinstance(dtype, T.NumericType):
            return value
        t = s
        if kind.startswith("html"):
            t = F.regexp_replace(t, MARKUP_RE, "")
        if kind.endswith("fmt"):
            t = F.translate(t, FORMAT_CHARS, "")
        return F.when(_empty(s), F.lit(None).cast("double")).otherwise(_to_double(t))
    if kind == "date":
        moment = value.cast("timestamp") if isinstance(dtype, _MOMENTS) else parse_date(s)
        return F.coalesce(F.unix_micros(moment), F.lit(0))
    raise ValueError(f"unknown sort type {kind}")


def _to_double(t: Column) -> Column:
    return F.when(t.rlike(NUMBER_RE), F.trim(t).cast("double"))


def sort_spec(
    df: DataFrame,
    order: Sequence[tuple[str, str]] | None = None,
    position: Sequence[str] | str | None = None,
    types: dict[str, str] | None = None,
    fixed_pre: Sequence[tuple[str, str]] = (),
    fixed_post: Sequence[tuple[str, str]] = (),
    data_sort: dict[str, Sequence[str]] | None = None,
) -> list[tuple[Column, str]]:
    """(key expression, 'asc'|'desc') pairs of a stable multi-column grid sort.

    ``order`` is a list of (column, 'asc'|'desc'); the default is the first
    column ascending.  ``position`` names the column(s) holding each row's
    original position: they break ties, so equal keys keep their order and
    the result order is total.  ``types`` gives columns' sort types; a type left
    out comes from the schema, or for text is detected (see ``column_types``);
    ``fixed_pre`` / ``fixed_post`` always sort first /
    last; ``data_sort`` sorts a column by other columns instead.
    """
    order = list(order) if order else [(df.columns[0], "asc")]
    data_sort = data_sort or {}
    targets = [(t, direction) for col, direction in [*fixed_pre, *order, *fixed_post] for t in data_sort.get(col, [col])]
    pos = [position] if isinstance(position, str) else list(position or [])
    kinds = column_types(df, [t for t, _ in targets], types, pos[0] if len(pos) == 1 else None)
    spec = [(sort_key(F.col(t), kinds[t], df.schema[t].dataType), direction) for t, direction in targets]
    return [*spec, *[(F.col(p), "asc") for p in pos]]


def keyed_frame(df: DataFrame, *args, **kwargs) -> tuple[DataFrame, list[Column], list[str]]:
    """``df`` with every sort key projected into a column (computed once per
    row, so the sort compares plain values instead of re-running regexes and
    date parsing per comparison), the sort orders, and the key column names."""
    spec = sort_spec(df, *args, **kwargs)
    names = [f"_k{i}" for i in range(len(spec))]
    keyed = df.select("*", *[expr.alias(n) for (expr, _), n in zip(spec, names)])
    orders = [
        F.col(n).desc_nulls_last() if direction == "desc" else F.col(n).asc_nulls_first()
        for (_, direction), n in zip(spec, names)
    ]
    return keyed, orders, names


def grid_sort(df: DataFrame, *args, **kwargs) -> DataFrame:
    """The rows in grid order (see ``sort_spec``).

    A logical global sort: a later ``limit`` / ``offset`` becomes a top-K per
    task (no full shuffle) and keeps the order.
    """
    keyed, orders, names = keyed_frame(df, *args, **kwargs)
    return keyed.orderBy(*orders).drop(*names)


def grid_rank(df: DataFrame, *args, rank_col: str = "row_pos", **kwargs) -> DataFrame:
    """Every row with its 1-based place in the grid order, without a single-task window."""
    keyed, orders, names = keyed_frame(df, *args, **kwargs)
    return number_rows(keyed, orders, id_col=rank_col).drop(*names)


TOP_ROWS = 10_000  # a page within the first rows is a top-K; a deeper one is found by order statistics
SPLITTERS = 64  # ranges a round cuts the keys into


def _after(names: Sequence[str], directions: Sequence[str], row: Sequence) -> Column:
    """Whether a row's keys come after those of ``row`` in grid order (nulls first ascending, last descending)."""
    cond = F.lit(False)
    for name, direction, value in reversed(list(zip(names, directions, row))):
        key, same = F.col(name), F.col(name).eqNullSafe(F.lit(value))
        if value is None:
            later = key.isNotNull() if direction != "desc" else F.lit(False)
        else:
            later = F.coalesce(key < F.lit(value), F.lit(True)) if direction == "desc" else F.coalesce(key > F.lit(value), F.lit(False))
        cond = later | (same & cond)
    return cond


def _cut_to(keyed: DataFrame, names: list[str], directions: list[str], orders: list[Column], start: int, stop: int | None) -> tuple[DataFrame, int] | None:
    """A small range of ``keyed`` that holds the rows start+1 .. stop (None: start+1 alone), and how many rows come before it.

    Every round takes sampled keys as splitters, counts the rows between them
    in one aggregate over the key columns and goes on with the ranges that are
    wanted.  None when the keys do not tell the rows apart.
    """
    stop = start + 1 if stop is None else stop
    part, before = keyed, 0
    size = part.count()
    while size > TOP_ROWS:
        sample = part.select(*names).sample(min(1.0, 40.0 * SPLITTERS / size), seed=11).orderBy(*orders).limit(100 * SPLITTERS).collect()
        picked = list(dict.fromkeys(tuple(r) for r in sample[:: max(1, len(sample) // SPLITTERS)]))
        if not picked:
            return None
        beyond = [_after(names, directions, r) for r in picked]
        counts = part.agg(*[F.count_if(c) for c in beyond]).first()
        upto = [size - n for n in counts]  # rows up to and with each splitter
        low = max((k for k, n in enumerate(upto) if before + n <= start), default=None)
        high = min((k for k, n in enumerate(upto) if before + n >= stop), default=None)
        if high is not None:
            part = part.filter(~beyond[high])
        if low is not None:
            part = part.filter(beyond[low])
        smaller = (upto[high] if high is not None else size) - (upto[low] if low is not None else 0)
        if smaller >= size:
            return None
        before, size = before + (upto[low] if low is not None else 0), smaller
    return part, before


def grid_page(df: DataFrame, start: int = 0, length: int = 10, *args, **kwargs) -> DataFrame:
    """One page in grid order: rows start+1 .. start+length (length -1 = all that follow); further arguments as ``sort_spec``.

    A page within the first TOP_ROWS rows is a top-K per task.  A deeper page
    is found by order statistics: the keys' ranges are counted and refined
    until the wanted one is small, and only that range is sorted.  What follows
    a row (length -1) is a filter on that row's keys.  Where equal keys leave
    the order open, rows are numbered by a range-partitioned sort instead.
    """
    start = max(start, 0)
    rest = length is None or length < 0
    if not rest and start + length <= TOP_ROWS:
        return grid_sort(df, *args, **kwargs).offset(start).limit(length)
    if rest and start == 0:
        return grid_sort(df, *args, **kwargs)
    keyed, orders, names = keyed_frame(df, *args, **kwargs)
    directions = [direction for _, direction in sort_spec(df, *args, **kwargs)]
    found = _cut_to(keyed, names, directions, orders, start - 1 if rest else start, None if rest else start + length)
    if found is not None:
        part, before = found
        if not rest:
            return part.orderBy(*orders).offset(start - before).limit(length).drop(*names)
        last = part.orderBy(*orders).offset(start - 1 - before).limit(1).select(*names).collect()
        if not last:
            return df.limit(0)
        if keyed.filter(~_after(names, directions, last[0])).count() == start:
            return keyed.filter(_after(names, directions, last[0])).orderBy(*orders).drop(*names)
    ranked = grid_rank(df, *args, rank_col="_row_pos", **kwargs)
    wanted = F.col("_row_pos") > start
    if not rest:
        wanted = wanted & (F.col("_row_pos") <= start + length)
    return ranked.filter(wanted).orderBy("_row_pos").drop("_row_pos")


def page_number_start(page: int | str, current_start: int, length: int, total: int | None = None) -> int:
    """Start row after a paging action: 'first', 'previous', 'next', 'last' or a page number.

    ``total`` is the number of rows shown after search.  With no rows or
    ``length`` -1 the start is 0; a page number whose start lies beyond the
    rows goes back to the first page; 'next' stays put on the last page.
    """
    if length < 0 or total == 0:
        return 0
    if page == "first":
        return 0
    if page == "previous":
        return max(current_start - length, 0)
    if page == "next":
        nxt = current_start + length
        return nxt if total is None or nxt < total else current_start
    if page == "last":
        if total is None:
            raise ValueError("the last page needs the row count")
        return ((total - 1) // length) * length
    start = int(page) * length
    return 0 if total is not None and start > total else start


def grid_page_info(df: DataFrame, match: Column, start: int = 0, length: int = 10) -> DataFrame:
    """Page, pages, start, end, length, total and shown rows in one aggregate pass."""
    counts = df.agg(F.count(F.lit(1)).alias("records_total"), F.count_if(match).alias("records_display"))
    shown = F.col("records_display")
    if length is None or length < 0:
        page, pages, end, ln = F.lit(0), F.lit(1), shown, F.lit(-1)
    else:
        page = F.lit(start // length)
        pages = F.ceil(shown / F.lit(length))
        end = F.least(F.lit(start + length), shown)
        ln = F.lit(length)
    return counts.select(
        page.cast("long").alias("page"),
        pages.cast("long").alias("pages"),
        F.lit(start).cast("long").alias("start"),
        end.cast("long").alias("end"),
        ln.cast("long").alias("length"),
        F.col("records_total").cast("long").alias("records_total"),
        shown.cast("long").alias("records_display"),
    )


# ---- type detection --------------------------------------------------------


# What may begin a number, a formatted number or markup; no text that begins otherwise passes a number's detector.
NUMBER_LEAD_RE = "^[\\s0-9+.<" + FORMAT_CHARS + "-]"
ALL_TYPES = (1 << (len(TYPE_ORDER) - 1)) - 1


def _is_number(s: Column) -> Column:
    return s.rlike(NUMBER_RE)


def type_mask(s: Column) -> Column:
    """Which detectors a value passes, one bit for each of TYPE_ORDER but html; a blank passes all.

    The first character decides for nearly every text: what no number, markup
    or date can begin with passes nothing and is not looked at any further.
    """
    bit = {name: 1 << k for k, name in enumerate(TYPE_ORDER[:-1])}
    num, fmt_, html_num, html_fmt = bit["num"], bit["num-fmt"], bit["html-num"], bit["html-num-fmt"]
    fmt = F.translate(s, FORMAT_CHARS, "")
    stripped = F.regexp_replace(s, MARKUP_RE, "")
    bare = F.translate(stripped, FORMAT_CHARS, "")
    plain = F.when(_is_number(s), num | fmt_ | html_num | html_fmt).when(_is_number(fmt), fmt_ | html_fmt).otherwise(0)
    marked = F.when(_is_number(stripped), html_num | html_fmt).when(_is_number(bare), html_fmt).otherwise(0)
    numeric = F.when(s.rlike(NUMBER_LEAD_RE), F.when(F.instr(s, "<") > 0, marked).otherwise(plain)).otherwise(0)
    date = F.when(is_date(s), bit["date"]).otherwise(0)
    return F.when(_empty(s), ALL_TYPES).when(~s.rlike(NUMBER_LEAD_RE) & ~may_be_date(s), 0).otherwise(numeric.bitwiseOR(date))


_MOMENTS = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _schema_type(df: DataFrame, c: str) -> str | None:
    """The type a column has whatever its values: numbers and moments pass their detector on every row."""
    dtype = df.schema[c].dataType
    return "num" if isinstance(dtype, T.NumericType) else "date" if isinstance(dtype, _MOMENTS) else None


def _markup(s: Column, position: str | None) -> Column:
    """Aggregate: whether the grid takes a column for html (its first row, else any row, holds markup)."""
    markup = F.instr(s, "<") > 0
    if position is None:
        return F.bool_or(F.coalesce(markup, F.lit(False)))
    # min over (position, flag): the smallest position's flag, as a hash aggregate over plain values
    return F.min_by(F.coalesce(_empty(s) | markup, F.lit(True)), F.col(position))


def _kind(mask: Column, html: Column) -> Column:
    """The type of a column from the bits all its values pass (NULL: no rows)."""
    kind = F.when(html, F.lit("html")).otherwise(F.lit("string"))
    for k in reversed(range(len(TYPE_ORDER) - 1)):
        kind = F.when(F.getbit(mask, F.lit(k)) == 1, F.lit(TYPE_ORDER[k])).otherwise(kind)
    return kind


def grid_column_types(df: DataFrame, cols: Sequence[str] | None = None, position: str | None = None) -> DataFrame:
    """Grid type of every column, one row per column, in one aggregate pass.

    A text column has the first of num, date, num-fmt, html-num, html-num-fmt
    that every value passes: one bit mask per value, folded by ``bit_and``.
    Else it is html when the grid meets markup: the grid looks at its first
    row only (blank or with '<'), which is the row of the smallest
    ``position``; without a position, one value with '<' is enough.  Else, and
    for an empty table, it is string.
    """
    cols = list(cols or df.columns)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        if _schema_type(df, c) is None:
            s = F.col(c).cast("string")
            aggs += [F.bit_and(type_mask(s)).alias(f"_m{i}"), _markup(s, position).alias(f"_h{i}")]
    flags = df.agg(*aggs)
    rows = []
    for i, c in enumerate(cols):
        known = _schema_type(df, c)
        kind = F.lit(known) if known else _kind(F.col(f"_m{i}"), F.col(f"_h{i}"))
        rows.append(F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"), kind.alias("type")))
    return flags.select(F.inline(F.array(*rows)))


PROBE = 20  # rows looked at first: a column with one value that passes no detector is html or string


def _settled(df: DataFrame, cols: Sequence[str], position: str) -> dict[str, str]:
    """Types of the columns that a few rows and the first row decide (see ``grid_column_types``), without a full pass."""
    texts = [F.col(c).cast("string") for c in cols]
    # a value that passes nothing settles that the column is no number and no date
    masks = df.limit(PROBE).agg(*[F.bit_and(type_mask(s)).alias(f"_m{i}") for i, s in enumerate(texts)]).first()
    done = [i for i in range(len(cols)) if masks[i] == 0]
    if not done:
        return {}
    least = df.agg(F.min(position)).first()[0]
    if least is None:
        return {}
    first = df.filter(F.col(position) == F.lit(least)).agg(*[_markup(texts[i], position).alias(f"_h{i}") for i in done]).first()
    return {cols[i]: "html" if first[k] else "string" for k, i in enumerate(done)}


def column_types(df: DataFrame, cols: Sequence[str], given: dict[str, str] | None = None, position: str | None = None) -> dict[str, str]:
    """Column -> grid type: the given one, else the schema's, else detected (a full pass only over columns that a few rows do not decide)."""
    kinds = {c: (given or {}).get(c) or _schema_type(df, c) for c in dict.fromkeys(cols)}
    open_ = [c for c, kind in kinds.items() if kind is None]
    if open_ and position is not None:
        kinds |= _settled(df, open_, position)
        open_ = [c for c, kind in kinds.items() if kind is None]
    if open_:
        kinds |= {r["column_name"]: r["type"] for r in grid_column_types(df, open_, position).collect()}
    return kinds


def detect_types(df: DataFrame, cols: Sequence[str] | None = None, position: str | None = None) -> dict[str, str]:
    """Column -> detected grid type (the result has one row per column)."""
    return column_types(df, list(cols or df.columns), None, position)
