"""HTML page corpus jobs (SURVEY H*).

pages (page_id, html) -> one parse job -> one row per table, then
relevance, scoring and selection as DataFrame expressions.

The parse step is the only Python: the standard-library ``html.parser``
builds a small element tree per page inside ``mapInArrow`` (bs4/lxml are
not installed), applies the removal rules and emits table metadata and
cell texts. A malformed page costs one error row, never the job.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Fixed values that must equal the reference's.
REMOVED_TAGS = ["script", "style", "nav", "header", "footer", "aside", "meta", "link", "noscript"]
WIKI_NAV_SELECTORS = ["div.navbox", "div.infobox", "div.vertical-navbox", "div.navbox-inner", "table.navbox",
                      "div.hatnote", "div.dablink", "div.rellink", "div.noprint", "div.printfooter", "div.catlinks",
                      "div#mw-navigation"]
DEFAULT_KEYWORDS = ["table", "data", "list", "ranking", "gross", "revenue", "sales", "statistics", "results",
                    "information", "details", "overview"]
FILM_HEADER_WORDS = ["rank", "title", "film", "gross", "worldwide", "year", "peak"]
BEST_TABLE_HEADER_WORDS = ["rank", "title", "gross", "film"]
FILM_INDICATOR_WORDS = ["avatar", "avengers", "titanic", "billion"]
CAPTION_FILM_WORDS = ["highest", "gross", "film"]
LIKELY_CAPTION_WORDS = ["highest", "gross", "film", "movie", "box office"]
LIKELY_HEADER_WORDS = ["rank", "film", "title", "worldwide", "gross", "year", "peak"]
SCRAPED_COLUMN_NAMES = ["Rank", "Peak", "Title", "Worldwide_Gross", "Year"]
SECTION_CLASS_PATTERN = r"(?i)(content|main|article|data|table)"

# Characters of pages in one batch of parsed rows, about, and parse tasks for each core.
PARSED_CHARS = 1_000_000
TASKS_PER_CORE = 4

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
IMPLIED = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}, "li": {"li"}, "p": {"p"},
           "option": {"option"}}
SCOPE = {"table", "tbody", "thead", "tfoot", "ul", "ol", "select", "div", "body", "html"}


class _Comment(str):
    pass


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent = tag, dict(attrs), [], parent

    def classes(self):
        return (self.attrs.get("class") or "").split()

    def iter(self):
        for c in self.children:
            if isinstance(c, _Node):
                yield c
                yield from c.iter()

    def find_all(self, tags):
        return [n for n in self.iter() if n.tag in tags]

    def strings(self):
        for c in self.children:
            if isinstance(c, _Node):
                yield from c.strings()
            elif not isinstance(c, _Comment):
                yield c

    def text(self, strip=False):
        if strip:
            return "".join(s.strip() for s in self.strings())
        return "".join(self.strings())

    def remove(self):
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def html(self):
        inner = "".join(c.html() if isinstance(c, _Node) else ("" if isinstance(c, _Comment) else c)
                        for c in self.children)
        if self.tag == "#root":
            return inner
        attrs = "".join(f' {k}="{v}"' if v is not None else f" {k}" for k, v in self.attrs.items())
        if self.tag in VOID:
            return f"<{self.tag}{attrs}>"
        return f"<{self.tag}{attrs}>{inner}</{self.tag}>"


class _TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root", {}, None)
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        closes = IMPLIED.get(tag)
        if closes:
            for i in range(len(self.stack) - 1, 0, -1):
                t = self.stack[i].tag
                if t in SCOPE:
                    break
                if t in closes:
                    del self.stack[i:]
                    break
        node = _Node(tag, attrs, self.stack[-1])
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1].children.append(_Node(tag, attrs, self.stack[-1]))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)

    def handle_comment(self, data):
        self.stack[-1].children.append(_Comment(data))


def parse(html: str) -> _Node:
    b = _TreeBuilder()
    b.feed(html or "")
    b.close()
    return b.root


def _drop_comments(node: _Node) -> None:
    node.children = [c for c in node.children if not isinstance(c, _Comment)]
    for c in node.children:
        if isinstance(c, _Node):
            _drop_comments(c)


def _selector_match(n: _Node, selector: str) -> bool:
    if "#" in selector:
        tag, ident = selector.split("#")
        return n.tag == tag and n.attrs.get("id") == ident
    tag, cls = selector.split(".")
    return n.tag == tag and cls in n.classes()


def clean_tree(root: _Node, wiki: bool) -> None:
    """H2 unwanted tags, H3 comments (removed; a stated deviation), H4 wiki rules."""
    for n in list(root.iter()):
        if n.tag in REMOVED_TAGS:
            n.remove()
    _drop_comments(root)
    if not wiki:
        return
    for n in list(root.iter()):
        if n.parent is None:
            continue
        if any(_selector_match(n, s) for s in WIKI_NAV_SELECTORS):
            n.remove()
        elif n.tag in ("div", "section") and re.search(r"(?i)references|citations", n.attrs.get("class") or ""):
            n.remove()
        elif n.tag == "span" and "mw-editsection" in n.classes():
            n.remove()
        elif n.tag == "sup" and "reference" in n.classes():
            n.remove()


def _cell_text(cell: _Node) -> str:
    """H8: sup dropped, links unwrapped (text kept), empty elements ignored."""
    parts = []

    def walk(n):
        for c in n.children:
            if isinstance(c, _Node):
                if c.tag != "sup":
                    walk(c)
            elif not isinstance(c, _Comment):
                parts.append(c)
    walk(cell)
    return "".join(p.strip() for p in parts)


def _own_rows(table: _Node):
    """tr elements of this table, not of tables nested inside it."""
    out = []

    def walk(n):
        for c in n.children:
            if isinstance(c, _Node):
                if c.tag == "table":
                    continue
                if c.tag == "tr":
                    out.append(c)
                walk(c)
    walk(table)
    return out


def _cells(tr: _Node):
    out = []

    def walk(n):
        for c in n.children:
            if isinstance(c, _Node):
                if c.tag in ("td", "th"):
                    out.append(c)
                elif c.tag != "table":
                    walk(c)
    walk(tr)
    return out


def _span(cell, name: str, most: int) -> int:
    """A span attribute; anything but a positive number counts as 1. ``most``: HTML's own limit."""
    value = (cell.attrs.get(name) or "").strip()
    return min(max(int(value), 1), most) if value.isdecimal() else 1


def _grid(rows: list[list]) -> list[list[str]]:
    """Cell texts row by row, with a cell's text in every place that it spans."""
    out, below = [], {}          # below: column -> (rows still to fill, text)
    for cells in rows:
        line, left = [], list(reversed(cells))
        while left or len(line) in below:
            at = len(line)
            if at in below:
                n, text = below.pop(at)
                line.append(text)
                if n > 1:
                    below[at] = (n - 1, text)
                continue
            cell = left.pop()
            text, down = _cell_text(cell), _span(cell, "rowspan", 65534)
            for _ in range(_span(cell, "colspan", 1000)):
                if down > 1:
                    below[len(line)] = (down - 1, text)
                line.append(text)
        out.append(line)
    return out


def _numbers(root: _Node) -> dict[int, tuple[int, int]]:
    """Place of every element (by ``id``) when elements are counted as they open and as they close:
    one lies inside another if it opens later and closes earlier."""
    out, opened, closed, todo = {}, 0, 0, [(root, None)]
    while todo:
        node, pre = todo.pop()
        if pre is None:
            todo.append((node, opened))
            opened += 1
            todo.extend((c, None) for c in reversed(node.children) if isinstance(c, _Node))
        else:
            out[id(node)] = (pre, closed)
            closed += 1
    return out


def _is_formatting(table: _Node) -> bool:
    return len(table.find_all({"tr"})) <= 2 or len(table.find_all({"td", "th"})) < 4


def _simple_html(node: _Node, in_table: bool = False) -> str:
    """An element as the cleaned page holds it: tables with one fixed class, cells without
    attributes and with their plain text, nested layout tables replaced by their text."""
    if node.tag == "table":
        if in_table and _is_formatting(node):
            return node.text(strip=True)
        attrs = ' class="cleaned-table"'
    elif node.tag in ("td", "th") and not node.find_all({"table"}):
        return f"<{node.tag}>{_cell_text(node)}</{node.tag}>"
    elif in_table and node.tag in ("sup", "a"):
        return "" if node.tag == "sup" else "".join(c for c in node.strings())
    else:
        attrs = "" if node.tag in ("td", "th") else "".join(f' {k}="{v}"' if v is not None else f" {k}" for k, v in node.attrs.items())
    if node.tag in VOID:
        return f"<{node.tag}{attrs}>"
    inside = "".join(_simple_html(c, in_table or node.tag == "table") if isinstance(c, _Node) else "" if isinstance(c, _Comment) else c
                     for c in node.children)
    return f"<{node.tag}{attrs}>{inside}</{node.tag}>"


PAGE_SCHEMA = ("page_id long, title string, wiki boolean, original_tables int, cleaned_tables int, "
               "original_size long, cleaned_size long, n_section_divs int, error string, "
               "tables array<struct<table_idx: int, caption: string, caption_raw: string, headers: array<string>, "
               "headers_raw: array<string>, classes: array<string>, row_count: int, col_count: int, cell_count: int, "
               "nested_tables int, text: string, rows: array<array<string>>, pre: int, post: int, plain: string, "
               "simple_size: long>>, divs array<struct<div_idx: int, pre: int, post: int, text: string, simple_size: long>>")


def parse_page(page_id, html, keywords=tuple(DEFAULT_KEYWORDS)):
    """One page -> metadata dict matching PAGE_SCHEMA."""
    try:
        html = html or ""
        root = parse(html)
        original_tables = len(root.find_all({"table"}))
        low = html.lower()
        wiki = "wikipedia.org" in low
        clean_tree(root, wiki)
        titles = [n for n in root.iter() if n.tag == "title"]
        title = titles[0].text() if titles else None
        at = _numbers(root)
        tables = []
        for i, t in enumerate(root.find_all({"table"})):
            caps = t.find_all({"caption"})
            ths = t.find_all({"th"})
            trs = t.find_all({"tr"})
            first = trs[0].find_all({"td", "th"}) if trs else []
            rows = _grid([_cells(tr) for tr in _own_rows(t)])
            tables.append({
                "table_idx": i,
                "caption": caps[0].text(strip=True) if caps else None,
                "caption_raw": caps[0].text() if caps else None,
                "headers": [h.text(strip=True) for h in ths],
                "headers_raw": [h.text() for h in ths],
                "classes": t.classes(),
                "row_count": len(trs), "col_count": len(first),
                "cell_count": len(t.find_all({"td", "th"})),
                "nested_tables": len(t.find_all({"table"})),
                "text": t.text(), "rows": rows, "pre": at[id(t)][0], "post": at[id(t)][1], "plain": t.text(strip=True),
                "simple_size": len(_simple_html(t))})
        boxes = [d for d in root.iter() if d.tag == "div" and re.search(SECTION_CLASS_PATTERN, d.attrs.get("class") or "")]
        divs = [{"div_idx": i, "pre": at[id(d)][0], "post": at[id(d)][1], "text": d.text(), "simple_size": len(_simple_html(d))}
                for i, d in enumerate(boxes)]
        cleaned = root.html()
        return {"page_id": page_id, "title": title, "wiki": wiki, "original_tables": original_tables,
                "cleaned_tables": len(tables), "original_size": len(html), "cleaned_size": len(cleaned),
                "n_section_divs": sum(any(k.lower() in d["text"].lower() for k in keywords) for d in divs), "error": None,
                "tables": tables, "divs": divs}
    except Exception as e:  # noqa: BLE001 - one bad page is one error row
        return {"page_id": page_id, "title": None, "wiki": None, "original_tables": None, "cleaned_tables": None,
                "original_size": len(html or ""), "cleaned_size": None, "n_section_divs": None,
                "error": f"{type(e).__name__}: {e}", "tables": [], "divs": []}


def parse_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The parse job: one output row per page (tables nested).

    Whole pages travel to Python in Arrow batches, whose bytes Spark bounds
    (``spark.sql.execution.arrow.maxBytesPerBatch``); each page is parsed once, and rows leave in
    batches of about PARSED_CHARS characters of pages. A page that fails keeps its error row.

    Parsing costs far more than reading, and a file of many small pages is one input split: the pages
    are dealt to ``TASKS_PER_CORE`` tasks a core, at least as many as there are shuffle partitions.
    """
    spark = pages.sparkSession
    n = max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = to_arrow_schema(StructType.fromDDL(PAGE_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, chars = [], 0
            for p, h in zip(batch.column(0), batch.column(1)):
                rows.append(parse_page(int(p.as_py()), h.as_py()))
                chars += rows[-1]["original_size"]
                if chars >= PARSED_CHARS:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, chars = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
    return pages.select(F.col(id_col).cast("long").alias(id_col), F.col(html_col)).repartition(n).mapInArrow(run, PAGE_SCHEMA)


def failed_pages(parsed: DataFrame) -> DataFrame:
    """H1: pages that could not be parsed, counted by error; ``page_tables`` has no rows of them."""
    return parsed.filter("error is not null").groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def page_tables(parsed: DataFrame) -> DataFrame:
    """H1: one row per (page, table)."""
    return parsed.select("page_id", F.explode("tables").alias("t")).select("page_id", "t.*")


def _contains_any(text: Column, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w.lower())
    return hit


def _count_words(text: Column, words) -> Column:
    return sum((F.when(text.contains(w), 1).otherwise(0) for w in words), F.lit(0))


def relevance(tables: DataFrame, keywords=DEFAULT_KEYWORDS) -> DataFrame:
    """H5: caption keyword, wikitable class, keyword in the first five
    headers, or more than five rows."""
    kw = [k.lower() for k in keywords]
    cap = F.lower(F.coalesce("caption_raw", F.lit("")))
    head5 = F.lower(F.array_join(F.slice("headers_raw", 1, 5), " "))
    wikit = F.exists("classes", lambda c: F.lower(c).contains("wikitable"))
    rel = (F.col("caption_raw").isNotNull() & _contains_any(cap, kw)) | wikit | \
          ((F.size("headers_raw") > 0) & _contains_any(head5, kw)) | (F.col("row_count") > 5)
    return tables.withColumn("relevant", rel)


def strategy(tables: DataFrame, keywords=DEFAULT_KEYWORDS) -> DataFrame:
    """H7: strategy rank 1 wikitable, 2 sortable, 3 keyword text with >= 3
    rows, 4 >= 3 film header words; 5 = fallback (top 3 by cell count with
    >= 10 cells) only on pages where no table matched 1-4."""
    cls = F.lower(F.array_join("classes", " "))
    text = F.lower(F.coalesce("text", F.lit("")))
    heads = F.lower(F.array_join("headers_raw", " "))
    s = (F.when(cls.rlike("wikitable"), 1).when(cls.rlike("sortable"), 2)
          .when(_contains_any(text, keywords) & (F.col("row_count") >= 3), 3)
          .when((F.size("headers_raw") > 0) & (_count_words(heads, FILM_HEADER_WORDS) >= 3), 4))
    t = tables.withColumn("strategy", s)
    page = Window.partitionBy("page_id")
    any_hit = F.max(F.col("strategy").isNotNull().cast("int")).over(page)
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(
        F.when(F.col("cell_count") >= 10, 0).otherwise(1), F.col("cell_count").desc(), F.col("table_idx")))
    t = t.withColumn("_any", any_hit).withColumn("_rk", rank)
    fallback = (F.col("_any") == 0) & (F.col("cell_count") >= 10) & (F.col("_rk") <= 3)
    return t.withColumn("strategy", F.when(F.col("strategy").isNotNull(), F.col("strategy"))
                        .when(fallback, F.lit(5))).drop("_any", "_rk")


def formatting_flag(tables: DataFrame) -> DataFrame:
    """H9: a table with <= 2 rows or < 4 cells is layout, not data."""
    return tables.withColumn("is_formatting", (F.col("row_count") <= 2) | (F.col("cell_count") < 4))


def _data_shape(tables: DataFrame) -> DataFrame:
    n_rows = F.greatest(F.size("rows") - 1, F.lit(0))
    n_cols = F.aggregate(F.transform("rows", lambda r: F.size(r)), F.lit(0), lambda a, b: F.greatest(a, b))
    return tables.withColumn("data_rows", n_rows).withColumn("data_cols", n_cols)


def best_table_score(tables: DataFrame) -> DataFrame:
    """+10 if > 20 data rows, +5 if >= 4 columns, +15 if a header
    names rank/title/gross/film, +2 per indicator word in the content."""
    t = _data_shape(tables)
    header_row = F.lower(F.array_join(F.coalesce(F.col("rows")[0], F.array().cast("array<string>")), " "))
    content = F.lower(F.array_join(F.flatten("rows"), " "))
    score = (F.when(F.col("data_rows") > 20, 10).otherwise(0) + F.when(F.col("data_cols") >= 4, 5).otherwise(0)
             + F.when(_contains_any(header_row, BEST_TABLE_HEADER_WORDS), 15).otherwise(0)
             + 2 * _count_words(content, FILM_INDICATOR_WORDS))
    return t.withColumn("score", score)


def pick_first_best(scored: DataFrame, score: str = "score") -> DataFrame:
    """Per page the highest score > 0, earliest table on ties."""
    w = Window.partitionBy("page_id").orderBy(F.col(score).desc(), F.col("table_idx"))
    return scored.filter(F.col(score) > 0).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def film_score(tables: DataFrame) -> DataFrame:
    """Caption +10 (highest/gross/film), rank +5, film|title +5,
    gross|worldwide +5, year +3, > 50 rows +5 or > 20 rows +3, wikitable +3."""
    cap = F.lower(F.coalesce("caption_raw", F.lit("")))
    heads = F.lower(F.array_join("headers_raw", " "))
    has_h = F.size("headers_raw") > 0
    wikit = F.exists("classes", lambda c: F.lower(c).contains("wikitable"))
    s = (F.when(F.col("caption_raw").isNotNull() & _contains_any(cap, CAPTION_FILM_WORDS), 10).otherwise(0)
         + F.when(has_h & heads.contains("rank"), 5).otherwise(0)
         + F.when(has_h & (heads.contains("film") | heads.contains("title")), 5).otherwise(0)
         + F.when(has_h & (heads.contains("gross") | heads.contains("worldwide")), 5).otherwise(0)
         + F.when(has_h & heads.contains("year"), 3).otherwise(0)
         + F.when(F.col("row_count") > 50, 5).when(F.col("row_count") > 20, 3).otherwise(0)
         + F.when(wikit, 3).otherwise(0))
    return tables.withColumn("film_score", s)


def likely_data_table(tables: DataFrame) -> DataFrame:
    """Flag and reasons (caption, headers, size, wikitable class)."""
    cap = F.lower(F.coalesce("caption", F.lit("")))
    heads = F.lower(F.array_join("headers", " "))
    wikit = F.exists("classes", lambda c: F.lower(c).contains("wikitable"))
    # fixed output labels
    reasons = F.filter(F.array(
        F.when(F.col("caption").isNotNull() & _contains_any(cap, LIKELY_CAPTION_WORDS), F.lit("Relevant caption")),
        F.when((F.size("headers") > 0) & _contains_any(heads, LIKELY_HEADER_WORDS), F.lit("Film-related headers")),
        F.when(F.col("row_count") > 20, F.format_string("Large dataset (%d rows)", F.col("row_count"))),
        F.when(wikit, F.lit("Wikipedia data table class"))), lambda x: x.isNotNull())
    return tables.withColumn("reasons", reasons).withColumn("likely_data_table", F.size("reasons") > 0)


def page_summary(parsed: DataFrame) -> DataFrame:
    """Title and number of tables per page."""
    return parsed.select("page_id", F.coalesce(F.trim("title"), F.lit("No title")).alias("title"),
                         F.col("cleaned_tables").alias("total_tables"))


def table_summary(tables: DataFrame) -> DataFrame:
    """Caption, first five headers, dimensions and classes per table."""
    return tables.select("page_id", "table_idx", F.coalesce("caption", F.lit("None")).alias("caption"),
                         F.when(F.size("headers") > 0, F.array_join(F.slice("headers", 1, 5), ", "))
                         .otherwise(F.lit("None")).alias("headers"),
                         F.format_string("%d rows x %d columns", "row_count", "col_count").alias("dimensions"),
                         F.when(F.size("classes") > 0, F.array_join("classes", ", ")).otherwise(F.lit("None"))
                         .alias("classes"))


def _inside(inner: str, outer: str) -> Column:
    """Containment by the numbers of opening and closing."""
    return (F.col(f"{inner}.pre") > F.col(f"{outer}.pre")) & (F.col(f"{inner}.post") < F.col(f"{outer}.post"))


def sections(parsed: DataFrame, keywords=tuple(DEFAULT_KEYWORDS)) -> DataFrame:
    """H6: the parts that a cleaned page keeps: relevant tables (``relevance``), and divs of a content
    class whose text has a keyword; on a page with neither, all tables (``fallback``).

    One row per part: ``page_id, kind, idx, pre, post, simple_size, fallback`` and ``within``, the
    number of the page's kept parts around it (such a part appears again inside those).
    """
    part = ["page_id", "kind", "idx", "pre", "post", "simple_size"]
    every = page_tables(parsed).withColumn("kind", F.lit("table")).withColumn("idx", F.col("table_idx"))
    tables = relevance(every, keywords).filter("relevant").select(*part)
    divs = parsed.select("page_id", F.explode("divs").alias("d")).select("page_id", "d.*") \
        .filter(_contains_any(F.lower("text"), keywords)).withColumn("kind", F.lit("div")).withColumn("idx", F.col("div_idx")).select(*part)
    found = tables.unionByName(divs)
    rest = every.select(*part).join(found.select("page_id").distinct(), "page_id", "left_anti")
    kept = found.withColumn("fallback", F.lit(False)).unionByName(rest.withColumn("fallback", F.lit(True)))
    around = kept.alias("i").join(kept.alias("o"), (F.col("i.page_id") == F.col("o.page_id")) & _inside("i", "o")) \
        .groupBy("i.page_id", "i.kind", "i.idx").agg(F.count(F.lit(1)).alias("within"))
    return kept.join(around, ["page_id", "kind", "idx"], "left").withColumn("within", F.coalesce("within", F.lit(0)))


def nested_tables(parsed: DataFrame) -> DataFrame:
    """H9: every table inside another one: ``page_id, outer_idx`` (the table right around it),
    ``table_idx, depth, is_formatting, replaced_by`` (the text that stands in its place if it is only
    layout, else NULL) and ``gone`` (it, or a table around it that is itself inside one, is only
    layout, so the cleaned page does not hold it)."""
    t = formatting_flag(page_tables(parsed)).select("page_id", "table_idx", "pre", "post", "is_formatting", "plain")
    pairs = t.alias("i").join(t.alias("o"), (F.col("i.page_id") == F.col("o.page_id")) & _inside("i", "o")).select(
        "i.*", F.col("o.table_idx").alias("outer"), F.col("o.is_formatting").alias("outer_formatting"), F.col("o.pre").alias("outer_pre"))
    inner = pairs.groupBy("page_id", "table_idx", "is_formatting", "plain").agg(
        F.max_by("outer", "outer_pre").alias("outer_idx"), F.count(F.lit(1)).alias("depth"),
        # the outermost table is inside none, so it stays
        F.count_if("outer_formatting").alias("n_layout"), F.min_by("outer_formatting", "outer_pre").alias("top_layout"))
    above = F.col("n_layout") - F.col("top_layout").cast("int") > 0
    return inner.select("page_id", "outer_idx", "table_idx", "depth", "is_formatting",
                        F.when(F.col("is_formatting"), F.col("plain")).alias("replaced_by"), (F.col("is_formatting") | above).alias("gone"))


# The page around the kept parts.
CLEANED_PAGE = "<html><head><title>Cleaned Page</title></head><body></body></html>"


def cleaning_metrics(parsed: DataFrame, keywords=tuple(DEFAULT_KEYWORDS)) -> DataFrame:
    """Tables and size before and after cleaning, and the share that went: what is counted
    after it is the cleaned page, the kept ``sections`` with simplified tables. A table that stands
    in several kept parts counts in each; layout tables inside tables are text by then."""
    kept = sections(parsed, keywords)
    tables = page_tables(parsed).select("page_id", "table_idx", "pre", "post")
    gone = nested_tables(parsed).filter("gone").select("page_id", "table_idx")
    whole = tables.join(gone, ["page_id", "table_idx"], "left_anti")
    own = (F.col("k.kind") == "table") & (F.col("t.table_idx") == F.col("k.idx"))
    held = kept.alias("k").join(whole.alias("t"), (F.col("k.page_id") == F.col("t.page_id")) & (own | _inside("t", "k"))) \
        .groupBy("k.page_id").agg(F.count(F.lit(1)).cast("int").alias("cleaned_tables"))
    sizes = kept.groupBy("page_id").agg(F.sum("simple_size").alias("parts"))
    m = parsed.select("page_id", "original_tables", "original_size", "error").join(held, "page_id", "left").join(sizes, "page_id", "left")
    m = m.withColumn("cleaned_tables", F.when(F.col("error").isNull(), F.coalesce("cleaned_tables", F.lit(0)))) \
        .withColumn("cleaned_size", F.when(F.col("error").isNull(), F.coalesce("parts", F.lit(0)) + len(CLEANED_PAGE)))
    ratio = F.when(F.col("original_size") > 0, 1 - F.col("cleaned_size") / F.col("original_size")).otherwise(0.0)
    return m.select("page_id", "original_tables", "cleaned_tables", "original_size", "cleaned_size", ratio.alias("reduction_ratio"))


def scraped_rows(tables: DataFrame, key_pattern: str = r"^\d+$", money_col: int | None = None) -> DataFrame:
    """Cell rows of the chosen tables as (page, table, row, cells) with
    the key-column filter and money cleaning ('$' and ',' removed) on the
    chosen column. Cells stay an array; ``named_cells`` names them."""
    rows = tables.select("page_id", "table_idx", F.posexplode("rows").alias("row_idx", "cells"))
    rows = rows.filter(F.col("cells")[0].rlike(key_pattern))
    if money_col is not None:
        rows = rows.withColumn("money", F.regexp_replace(F.col("cells")[money_col], r"[$,]", "").try_cast("double"))
    return rows


def named_cells(rows: DataFrame, names=tuple(SCRAPED_COLUMN_NAMES)) -> DataFrame:
    """``scraped_rows`` with the first cells under ``names`` by position; a row with fewer cells
    has NULL in the others."""
    return rows.select(*[c for c in rows.columns if c != "cells"], *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def extraction_metadata(tables: DataFrame, sample_rows: int = 3) -> DataFrame:
    """Per page with a scored table the tables found, the best table's place, rows, columns,
    score and column names, and its first ``sample_rows`` data rows (cells joined by ``|``). One pass
    over the parsed tables: the count is a window of the same rows that the choice is made of."""
    counted = best_table_score(tables).withColumn("tables_found", F.count(F.lit(1)).over(Window.partitionBy("page_id")))
    best = pick_first_best(counted)
    sample = F.transform(F.slice("rows", 2, sample_rows), lambda r: F.array_join(r, "|"))
    return best.select("page_id", "tables_found", F.col("table_idx").alias("best_table_idx"), F.col("data_rows").alias("best_rows"),
                       F.col("data_cols").alias("best_cols"), F.col("score").alias("best_score"),
                       F.array_join(F.col("rows")[0], ",").alias("columns"), sample.alias("sample"))


def remove_blocks_regex(html: Column) -> Column:
    """H2/H3 regex twin: script and style blocks and comments removed."""
    return F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")
